"""Scores over arrays of bars against loops, also for arrays too short for them, and decisions whose judgements are absent."""

import random

import duckdb
from pyspark.sql import functions as F

from tidemark import queries as core
from tidemark.functions import candles as C
from tidemark.functions import decisions as D

BARS = "array<struct<open:double,high:double,low:double,close:double>>"


def bars(rng, n):
    out, close = [], 100.0
    for _ in range(n):
        open_, close = close, close + rng.choice([0.0, rng.gauss(0, 2)])
        out.append((open_, max(open_, close) + rng.random(), min(open_, close) - rng.random(), close))
    return out


def means(values, n):
    out = []
    for v in values:
        out.append(v if not out else v * 2 / (n + 1) + out[-1] * (1 - 2 / (n + 1)))
    return out


def plain_rsi(closes):
    moves = [b - a for a, b in zip(closes, closes[1:])]
    gain, loss = sum(m for m in moves if m > 0), -sum(m for m in moves if m < 0)
    return 50.0 if len(closes) < 3 else 100.0 if loss <= 0 else 100 - 100 / (1 + gain / loss)


def test_parts_are_those_of_loops(spark):
    rng = random.Random(3)
    rows = [(i, bars(rng, n)) for i, n in enumerate([0, 1, 2, 3, 11, 12, 20, 29, 30, 34, 35, 36, 59, 60, 70])]
    df = spark.createDataFrame(rows, f"i int, b {BARS}")
    c = F.transform("b", lambda b: b["close"])
    own = {n: F.col("b") for n in C.TREND}
    got = df.select("i", C.ema(c, 20).alias("ema"), F.when(F.size(c) > 1, C.rsi(c)).alias("rsi"), F.when(F.size(c) > 3, C.macd_change(c)).alias("macd"), C.slope(F.col("b")).alias("slope"),
                    C.momentum(F.col("b")).alias("momentum"), C.trend(own).alias("trend"), C.structure(F.col("b"), F.col("b"), F.col("b")).alias("structure")).collect()
    near = lambda a, b: (a is None and b is None) or abs(a - b) < 1e-9
    for r in got:
        b = rows[r.i][1]
        closes = [x[3] for x in b]
        assert near(r.ema, means(closes, 20)[-1] if b else None)
        assert len(b) < 2 or near(r.rsi, plain_rsi(closes))
        if len(b) > 3:
            macd = [x - y for x, y in zip(means(closes, 12), means(closes, 26))]
            histogram = [x - y for x, y in zip(macd, means(macd, 9))]
            assert near(r.macd, histogram[-1] - histogram[-4])
        whole = sum(h - low for _, h, low, _ in b)
        assert near(r.slope, 0.0 if len(b) < 2 else max(-1.0, min(1.0, (closes[-1] - closes[0]) / whole)))
        assert (r.momentum == 0.0) == (len(b) < 35) and (r.trend == 0.0) == (len(b) < 30) and (len(b) >= 12 or r.structure == 0.0)
        assert all(-1 <= x <= 1 for x in (r.momentum, r.trend, r.structure))


def test_decisions_without_judgements(spark):
    none = F.lit(None).cast("double")
    side = lambda s: F.lit(s).cast("int")
    judge = lambda **k: D.fused(**{**dict.fromkeys(("quant", "flow", "regime", "alignment", "indicators", "spread", "drawdown", "risk", "probability"), none), "side": side(1), "trades": F.lit(True), "failed": F.lit(None).cast("string"), **k})
    all_for = dict.fromkeys(("quant", "flow", "regime", "alignment", "indicators"), F.lit(1.0))
    d = spark.range(1).select(
        judge().alias("bare"), judge(probability=F.lit(1.0), **all_for).alias("sure"), judge(probability=F.lit(1.0), side=side(-1), **all_for).alias("short"), judge(probability=F.lit(0.44), **all_for).alias("low"),
        judge(drawdown=F.lit(0.95), **all_for).alias("down"), judge(trades=F.lit(False), failed=F.lit("m5_trigger"), **all_for).alias("idle"), judge(side=side(None), probability=F.lit(1.0), **all_for).alias("none"),
        D.flow_alignment(side(None), {k: F.lit(1.0) for k in D.FLOW}, none, none).alias("flow"),
    ).first()
    # only the strategy speaks: its weight is 0.16 * 1.3 among 0.8 times the others' lesser weights
    others = 0.8 * (0.05 + 0.10 + 0.05 + 0.10 + 0.10 + 0.08)
    assert abs(d.bare.score - (0.208 / (0.208 + others) + 0.12 * (0.6 / 7 + 0.4))) < 1e-9 and (d.bare.support, d.bare.conflict) == (1, 0)
    assert (d.sure.action, d.sure.score, d.sure.support) == ("BUY", 1.0, 7) and abs(d.sure.threshold - 0.58) < 1e-12 and d.short.action == "SELL"
    assert d.low.blocked and d.down.blocked and {d.low.action, d.down.action, d.idle.action, d.none.action} == {"WAIT"} and not d.idle.blocked
    assert tuple(d.flow) == (0.0, False, False)


def test_half_way_scores_are_rounded_as_the_sql_does(spark, tmp_path):
    rows = [(2734, 680, 'click', 15.88), (23246, 1134, 'error', 34.15), (31216, 1280, 'signup', 7.73)]  # their scores are halves of the fifth digit but for the last bits
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double")
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = {r[0]: r[2] for r in con.execute(core.ORACLE["decision_fusion"]).fetchall()}
    assert {r.event_id: r.score for r in core.QUERIES["decision_fusion"](spark, str(tmp_path)).collect()} == want

"""Queries of order-flow alignment, side scores and fused decisions; with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import decisions as D
from tidemark.plans.registry import Registry
from tidemark.sources.tables import table

query = Registry()

#: A number from -1 to 1 of each event by its id, in steps of 1/50.
_STEP = "((event_id * {k} % 101) - 50) / 50.0"


def _step(k: int):
    return ((F.col("event_id") * k % 101) - 50) / 50.0


_FLOW_SQL = ", ".join(f"{_STEP.format(k=k)} AS {n}" for k, n in zip((3, 5, 7, 11, 13), D.FLOW))
_SIDE = "CASE WHEN user_id % 7 = 0 THEN NULL WHEN event_id % 2 = 1 THEN 1 ELSE -1 END"


def _flow():
    own = {n: _step(k) for k, n in zip((3, 5, 7, 11, 13), D.FLOW)}
    side = F.when(F.col("user_id") % 7 == 0, None).when(F.col("event_id") % 2 == 1, 1).otherwise(-1)
    return side, D.flow_alignment(side, own, (F.col("event_id") * 17 % 101) / 100.0, (F.col("event_id") * 19 % 101) / 100.0)


FLOWED = f"""f AS (SELECT *, {_SIDE} AS side, (event_id * 17 % 101) / 100.0 AS absorption, (event_id * 19 % 101) / 100.0 AS obstacle, {_FLOW_SQL} FROM events),
        a AS (SELECT *, CASE WHEN side IS NULL THEN 0.0 ELSE greatest(-1.0, least(1.0, side * (0.25 * delta_bias + 0.25 * cvd_slope + 0.20 * imbalance + 0.10 * profile_location + 0.15 * vwap_alignment) + 0.10 * absorption - 0.20 * obstacle)) END AS flow FROM f)"""


@query("flow_alignment", f"WITH {FLOWED} SELECT event_id, round(CAST(flow AS DOUBLE), 5) AS alignment, flow >= 0.35 - 1e-12 AS supports, flow <= -0.35 + 1e-12 AS conflicts FROM a", digits=5)
def flow_alignment(spark, sf_dir):
    """How far an order flow made of each event's id speaks for its side."""
    _, found = _flow()
    return table(spark, sf_dir, "events").select("event_id", found.alias("a")).select("event_id", F.round("a.alignment", 9).alias("alignment")).select("event_id", "alignment", (F.col("alignment") >= 0.35).alias("supports"), (F.col("alignment") <= -0.35).alias("conflicts"))


@query(
    "side_scores",
    """WITH s AS (SELECT event_id, event_type, CAST(value / 50 AS DOUBLE) AS long, CAST((event_id % 60) / 30.0 AS DOUBLE) AS short, CAST((user_id % 9) / 3.0 AS DOUBLE) AS multiple, CASE WHEN event_id % 3 = 0 THEN 1 ELSE -1 END AS preferred FROM events),
        t AS (SELECT *, long * CASE WHEN preferred = 1 THEN 1.2 ELSE 0.7 END * 0.8 + multiple * 0.25 AS l, short * CASE WHEN preferred = -1 THEN 1.2 ELSE 0.7 END * 0.8 + multiple * 0.25 AS s FROM s)
    SELECT event_id, round(l, 5) AS long, round(s, 5) AS short, round(l - s, 5) AS edge, event_type <> 'error' AND multiple >= 0.5 AND (event_id % 11) / 10.0 <= 0.8 AND abs(l - s) >= 0.5 AS tradeable FROM t""",
    digits=5,
)
def side_scores(spark, sf_dir):
    """Scores of both sides of each event under one regime, and whether their difference is worth a trade."""
    e = table(spark, sf_dir, "events")
    preferred = F.when(F.col("event_id") % 3 == 0, 1).otherwise(-1)
    multiple = (F.col("user_id") % 9) / 3.0
    scores = D.side_scores(F.col("value") / 50, (F.col("event_id") % 60) / 30.0, multiple, preferred, F.lit(1.2), F.lit(0.7), F.lit(0.8))
    rows = e.select("event_id", scores.alias("s"), multiple.alias("m"), (F.col("event_type") != "error").alias("regime"))
    worth = D.tradeable(F.col("s.edge"), F.col("m"), (F.col("event_id") % 11) / 10.0, F.lit(0.5), 0.5, 0.8, F.col("regime"))
    return rows.select("event_id", "s.*", worth.alias("tradeable"))


_NAMES = ("quant", "flow", "regime", "alignment", "indicators", "strategy")
_JUDGED = f"""j AS (SELECT event_id, side, value > 30 AS trades, event_type AS failed, CASE WHEN user_id % 5 = 0 THEN NULL ELSE (event_id * 23 % 101) / 100.0 END AS probability, CASE WHEN user_id % 3 = 0 THEN NULL ELSE {_STEP.format(k=29)} END AS quant,
            CASE WHEN user_id % 4 = 0 THEN NULL ELSE CAST(flow AS DOUBLE) END AS flow, {_STEP.format(k=31)} AS regime, {_STEP.format(k=37)} AS alignment, CASE WHEN user_id % 6 = 0 THEN NULL ELSE {_STEP.format(k=41)} END AS indicators,
            (event_id * 43 % 101) / 100.0 AS spread, (event_id * 47 % 101) / 100.0 AS drawdown, (event_id * 53 % 101) / 100.0 AS risk FROM a),
        v AS (SELECT *, CASE WHEN trades THEN 1.0 WHEN failed = 'm30_setup' THEN -0.65 ELSE -0.55 END AS strategy, CASE WHEN probability IS NULL THEN 0.0 ELSE greatest(-1.0, least(1.0, (probability - 0.5) * 2)) END AS edge, CASE WHEN probability IS NULL THEN 0.0 ELSE greatest(-1.0, least(1.0, (probability - 0.55) / 0.20)) END AS margin FROM j),
        l AS (SELECT *, [CAST(coalesce(quant, 0) AS DOUBLE), coalesce(flow, 0), regime, alignment, coalesce(indicators, 0), strategy, margin] AS signals,
            [edge, CAST(coalesce(quant, 0) AS DOUBLE), coalesce(flow, 0), regime, alignment, coalesce(indicators, 0), strategy] AS vs,
            [CASE WHEN probability IS NULL THEN 0.05 ELSE 0.22 END, CASE WHEN quant IS NULL THEN 0.10 ELSE 0.20 END, CASE WHEN flow IS NULL THEN 0.05 ELSE 0.12 END, 0.10, 0.10, CASE WHEN indicators IS NULL THEN 0.08 ELSE 0.16 END, 0.16] AS ws FROM v),
        w AS (SELECT *, list_transform(range(1, 8), lambda i: CAST(ws[i] AS DOUBLE) * (0.8 + 0.5 * abs(vs[i]))) AS dw, len(list_filter(signals, lambda x: x >= 0.25)) AS up, len(list_filter(signals, lambda x: x <= -0.25)) AS down FROM l),
        c AS (SELECT *, list_dot_product(vs, dw) / list_sum(dw) AS mean, greatest(-1.0, least(1.0, 0.6 * list_sum(signals) / 7 + 0.4 * (up - down) / greatest(up + down, 1))) AS confluence FROM w),
        t AS (SELECT *, greatest(0.52, least(0.78, 0.62 + CASE WHEN up >= 5 AND confluence >= 0.45 THEN -0.04 WHEN up >= 4 AND confluence >= 0.30 THEN -0.02 ELSE 0 END + CASE WHEN down >= 2 THEN 0.05 ELSE 0 END + CASE WHEN down >= 3 OR confluence <= -0.40 THEN 0.08 ELSE 0 END)) AS bar,
            greatest(-1.0, least(1.0, mean + 0.12 * confluence - 0.07 * spread - 0.08 * drawdown - 0.07 * risk)) AS score, trades AND (coalesce(probability < 0.45, false) OR drawdown >= 0.95) AS blocked FROM c)"""


@query(
    "decision_fusion",
    f"""WITH {FLOWED}, {_JUDGED} SELECT event_id, CASE WHEN blocked OR NOT trades OR (score + 1) / 2 < bar THEN 'WAIT' WHEN side = 1 THEN 'BUY' WHEN side = -1 THEN 'SELL' ELSE 'WAIT' END AS action,
        round(score, 5) AS score, round((score + 1) / 2, 5) AS confidence, round(CAST(bar AS DOUBLE), 5) AS threshold, round(confluence, 5) AS confluence, up AS support, down AS conflict, blocked FROM t""",
    digits=5,
)
def decision_fusion(spark, sf_dir):
    """Judgements of each event by its id and order flow, some of them absent, fused into an action."""
    side, flow = _flow()
    absent = lambda n, c: F.when(F.col("user_id") % n == 0, None).otherwise(c)
    share = lambda k: (F.col("event_id") * k % 101) / 100.0
    rows = table(spark, sf_dir, "events").withColumns({"side": side, "flow": flow["alignment"]})
    made = D.fused(F.col("side"), F.col("value") > 30, F.col("event_type"), absent(5, share(23)), absent(3, _step(29)), absent(4, F.col("flow")), _step(31), _step(37), absent(6, _step(41)), share(43), share(47), share(53))
    found = rows.select("event_id", made.alias("d")).select("event_id", "d.*")
    exact = {c: F.round(c, 12) for c in ("score", "confidence", "confluence")}  # a half of the last digit told is one in spite of the last bits
    return found.withColumns({**exact, "support": F.col("support").cast("long"), "conflict": F.col("conflict").cast("long")})

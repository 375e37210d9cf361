"""Decisions and their outcomes: the stream against the batch operator, and that against a loop."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.outcomes import settle
from tidemark.operators import journal
from tidemark.streaming.journal import ROCKS, _Follower, journal_stream

T0 = dt.datetime(2024, 1, 1)
DECISIONS = "decided timestamp_ntz, symbol string, side int, bid double, ask double, target double, limit double, worth double"
QUOTES = "symbol string, ts timestamp_ntz, ord long, bid double, ask double"


def some_rows(seed, n=300):
    rng = random.Random(seed)
    quotes, decisions = [], []
    for i in range(n):
        symbol, price = rng.choice("aab"), 100 + rng.gauss(0, 2)
        ts = T0 + dt.timedelta(seconds=i * 7, microseconds=rng.randint(0, 999_999))
        quotes.append((symbol, ts, i, price, price + 0.1))
        if rng.random() < 0.4:
            decisions.append((ts, symbol, rng.choice([1, -1]), price, price + 0.1, rng.choice([1.0, 4.0, 30.0, 0.0]), rng.choice([1.0, 30.0, 0.0]), 2.0))
    return decisions, quotes


def plain(decisions, quotes, horizon):
    out = {}
    for decided, symbol, side, bid, ask, target, limit, worth in decisions:
        status, most, least, seconds = "pending", 0.0, 0.0, None
        for s, ts, _, b, a in sorted(quotes, key=lambda q: (q[1], q[2])):
            if s != symbol or not decided < ts <= decided + dt.timedelta(seconds=horizon):
                continue
            gain = (b - ask if side == 1 else bid - a) * worth
            most, least = max(most, gain), max(least, -gain)
            if (target > 0 and gain >= target) or (limit > 0 and -gain >= limit):
                status = "win" if target > 0 and gain >= target else "loss"
                seconds = int(ts.replace(microsecond=0).timestamp() - decided.replace(microsecond=0).timestamp())
                break
        out[decided, symbol, side] = (status, round(most, 6), round(least, 6), seconds)
    return out


def as_dict(rows):
    return {(r.decided.replace(tzinfo=None), r.symbol, r.side): (r.status, round(r.most_favorable, 6), round(r.most_adverse, 6), r.seconds) for r in rows}


def test_batch_is_the_loop(spark):
    decisions, quotes = some_rows(1)
    got = journal.followed(spark.createDataFrame(decisions * 2, DECISIONS), spark.createDataFrame(quotes, QUOTES), 120).collect()
    want = plain(decisions, quotes, 120)
    assert len(got) == len(decisions) and as_dict(got) == want and {v[0] for v in want.values()} == {"win", "loss", "pending"}
    none = spark.createDataFrame(decisions, DECISIONS).where("false")
    assert journal.followed(none, spark.createDataFrame(quotes, QUOTES), 120).collect() == []


def test_no_row_for_a_pair_of_decision_and_quote(spark):
    # 2,000 decisions and 2,000 quotes within one horizon: rows that leave a join would be two million
    quotes = spark.range(2000).select(F.lit("a").alias("symbol"), (F.lit(T0) + F.make_dt_interval(secs=F.col("id") / 10)).cast("timestamp_ntz").alias("ts"), F.col("id").alias("ord"), F.lit(1.0).alias("bid"), F.lit(1.0).alias("ask"))
    asked = quotes.select(F.col("ts").alias("decided"), "symbol", F.lit(1).alias("side"), "bid", "ask", F.lit(5.0).alias("target"), F.lit(5.0).alias("limit"), F.lit(1.0).alias("worth"))
    found = journal.followed(asked, quotes, 3600)
    assert found.count() == 2000 and found.where("status <> 'pending'").isEmpty()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


@pytest.mark.parametrize("seed", range(20))
def test_settle_is_the_loop(seed):
    rng = np.random.default_rng(seed)
    n, m = int(rng.integers(0, 70)), 200
    times, prices = np.sort(rng.integers(0, 60, n)), rng.choice([1.0, 2.0, 3.0, 4.5, np.nan, np.inf, -np.inf], n, p=[0.3, 0.3, 0.2, 0.14, 0.02, 0.02, 0.02])
    decided, side, entry, worth = rng.integers(-5, 65, m), rng.choice([1, -1], m), rng.choice([1.0, 2.0, 3.0], m), rng.choice([1.0, 2.0, -1.0], m)
    target, limit = (rng.choice([0.0, 1.0, 3.0, 50.0, np.nan], m) for _ in range(2))
    hit, won, favorable, adverse = settle(times, prices, decided, 20, side, entry, worth, target, limit)
    for k in range(m):
        most = least = 0.0
        place, win = -1, False
        for i in np.flatnonzero((times > decided[k]) & (times <= decided[k] + 20)):
            gain = side[k] * (prices[i] - entry[k]) * worth[k]
            odd = np.isnan(gain)
            most, least = np.maximum(most, gain), np.maximum(least, -gain)
            win = bool(target[k] > 0 and (odd or gain >= target[k]))
            if win or (limit[k] > 0 and (odd or -gain >= limit[k])):
                place = i
                break
        assert (hit[k], won[k]) == (place, win and place >= 0)
        np.testing.assert_equal((favorable[k], adverse[k]), (most, least))


def test_absent_values_and_strange_prices(spark):
    row = lambda i, **k: {"decided": T0, "symbol": "a", "side": 1, "bid": 10.0 + i, "ask": 10.0 + i, "target": 2.0, "limit": 2.0, "worth": 1.0} | k
    rows = [row(0), row(1, symbol=None), row(2, side=None), row(3, ask=None), row(4, bid=None), row(5, target=None, limit=None), row(6, decided=None), row(7, worth=None), row(8, side=-1)]
    quotes = [("a", T0 + dt.timedelta(seconds=s), s, p, p) for s, p in ((1, None), (2, 11.0), (3, 13.0))] + [(None, T0, 0, 1.0, 1.0), ("a", None, 1, 90.0, 90.0)]
    names = [c.split()[0] for c in DECISIONS.split(", ")]
    asked = spark.createDataFrame([tuple(r[c] for c in names) for r in rows], DECISIONS)
    got = journal.followed(asked, spark.createDataFrame(quotes, QUOTES), 60).collect()
    kind = {(r.decided is None, r.symbol, r.side, r.bid, r.ask): (r.status, r.most_favorable, r.most_adverse, r.seconds) for r in got}
    assert len(got) == len(rows)
    assert kind[False, "a", 1, 10.0, 10.0] == ("win", 3.0, 0.0, 3) and kind[False, "a", 1, None, 14.0] == ("loss", 0.0, 3.0, 2)
    assert kind[False, "a", 1, 15.0, 15.0] == ("pending", 0.0, 4.0, None) and kind[False, "a", -1, 18.0, 18.0] == ("win", 7.0, 0.0, 2)
    blank = [v for k, v in kind.items() if k[0] or k[1] is None or k[2] is None or k[4] is None or k[3] == 17.0]
    assert blank == [("pending", 0.0, 0.0, None)] * 5


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_stream_gives_the_batch_rows_once(spark, rocks, tmp_path):
    decisions, quotes = some_rows(2)
    given, asked = spark.createDataFrame(quotes, QUOTES), spark.createDataFrame(decisions, DECISIONS)
    cut = [T0 + dt.timedelta(seconds=s) for s in (0, 700, 1400, 10**6)]
    for k in (0, 1, 2):
        for frame, name, c in ((given, "quotes", "ts"), (asked, "decisions", "decided")):
            part = frame.where((F.col(c) >= F.lit(cut[k])) & (F.col(c) < F.lit(cut[k + 1]))).coalesce(1)
            part.write.mode("append").parquet(f"{tmp_path}/{name}")
            if k == 1:  # the same rows again, before the next ones
                part.write.mode("append").parquet(f"{tmp_path}/{name}")
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")
    rows = journal_stream(read("decisions", DECISIONS), read("quotes", QUOTES), 120, shares=3)
    stream = rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
    assert stream.awaitTermination(200)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    want = plain(decisions, quotes, 120)
    settled = {k: v for k, v in want.items() if v[0] != "pending"}
    assert as_dict([r for r in got if r.status != "expired"]) == settled and sum(r.status != "expired" for r in got) == len(settled)
    expired = as_dict([r for r in got if r.status == "expired"])
    assert expired and all(want[k][0] == "pending" and want[k][1:3] == v[1:3] for k, v in expired.items())


class Held:
    """A state of any kind, with a count of what is written to it."""

    def __init__(self):
        self.value, self.writes = {}, 0

    def exists(self):
        return bool(self.value)

    def get(self):
        return iter(self.value["rows"]) if isinstance(self.value.get("rows"), list) else self.value["rows"]

    def put(self, rows):
        self.update(rows)

    def update(self, rows):
        self.value, self.writes = {"rows": rows}, self.writes + 1

    def clear(self):
        self.value = {}

    def containsKey(self, name):
        return name in self.value

    def updateValue(self, name, value):
        self.value[name], self.writes = value, self.writes + 1


class Handle:
    def __init__(self):
        self.timers = []

    def getListState(self, *_):
        return Held()

    getMapState = getValueState = getListState

    def registerTimer(self, at):
        self.timers.append(at)


def test_stream_state_holds_the_last_horizon_alone():
    """Of many decisions in one batch those are written to the state that a repeat could still meet, not all; repeats give no row."""
    decisions, quotes = some_rows(5, 600)
    decisions, quotes = [d for d in decisions if d[1] == "a"], [q for q in quotes if q[0] == "a"]
    asked = pd.DataFrame(decisions, columns=["ts", "symbol", "side", "bid", "ask", "target", "limit", "worth"]).assign(kind="decision")
    given = pd.DataFrame(quotes, columns=["symbol", "ts", "ord", "bid", "ask"]).assign(kind="quote")
    follower = _Follower(60)
    follower.init(Handle())
    rows = pd.concat([asked, given])
    got = pd.concat(follower.handleInputRows(("a", 0), iter([rows]), None))
    want = {k: v for k, v in plain(decisions, quotes, 60).items() if v[0] != "pending"}
    assert as_dict(got.itertuples()) == want and len(got) == len(want)
    end = quotes[-1][1] - dt.timedelta(seconds=60)
    assert follower.known.writes == sum(d[0] >= end for d in decisions) > 0
    assert not list(follower.handleInputRows(("a", 0), iter([rows]), None))

"""Queries over every row of their tables against loops, also where SQL is their twin."""

import pandas as pd
import pytest

from tidemark import queries as core
from tidemark.sources.tables import clock_bars


@pytest.fixture(scope="module")
def events(spark, data):
    return spark.read.parquet(f"{data}/events.parquet").toPandas().rename(columns={"event_type": "symbol"})


@pytest.fixture(scope="module")
def by_symbol(spark, data):
    return {s: g.sort_values("ts").to_dict("records") for s, g in clock_bars(spark.read.parquet(f"{data}/events.parquet")).toPandas().groupby("symbol")}


def rows(df):
    """Rows that compare and sort: nothing for what is missing, numbers to five digits."""
    plain = lambda x: "" if pd.isna(x) else round(float(x), 5) if isinstance(x, (int, float)) else str(x)
    return sorted(tuple(map(plain, r)) for r in df)


def test_asof_closed_bar_of_every_event(spark, data, events, by_symbol):
    want = []
    for e in events.itertuples():
        shut = [b for b in by_symbol[e.symbol] if b["ts"] + pd.Timedelta(minutes=15) <= e.ts]
        want.append((e.symbol, e.ts, shut[-1]["ts"] if shut else None, shut[-1]["close"] if shut else None))
    got = core.QUERIES["asof_closed_bar_all"](spark, data).toPandas()
    assert len(got) == len(events)
    assert rows(got[["symbol", "ts", "bar_ts", "bar_close"]].itertuples(index=False)) == rows(want)


def test_signal_within_ttl_of_every_event(spark, data, events):
    asks, gives = events[events.event_id % 2 == 0], events[events.event_id % 2 == 1]
    want = []
    for q in asks.itertuples():
        seen = gives[(gives.symbol == q.symbol) & (gives.ts <= q.ts)].sort_values("ts")
        last = seen.iloc[-1] if len(seen) and q.ts - seen.iloc[-1].ts <= pd.Timedelta(hours=1) else None
        want.append((q.symbol, q.ts, None if last is None else last.ts, None if last is None else last.value))
    got = core.QUERIES["signal_within_ttl_all"](spark, data).toPandas()
    assert rows(got[["symbol", "ts", "signal_ts", "value"]].itertuples(index=False)) == rows(want)


def test_first_touch_of_every_event(spark, data, events, by_symbol):
    want = set()
    for e in events.itertuples():
        side = 1 if e.event_id % 2 else -1
        stop, target = e.value - 8 * side, e.value + 12 * side
        held = [b for b in by_symbol[e.symbol] if b["ts"] >= e.ts][:12]
        outcome = side * (held[-1]["close"] - e.value) / 8 if held else None
        for b in held:
            worst, best = (b["low"], b["high"]) if side == 1 else (-b["high"], -b["low"])
            if worst <= side * stop or best >= side * target:
                outcome = -1.0 if worst <= side * stop else 1.5
                break
        if held:
            want.add((e.symbol, e.ts, side, e.value, stop, target, len(held), outcome))
    got = core.QUERIES["first_touch_all"](spark, data).toPandas()
    assert rows(got[["symbol", "ts", "side", "entry", "stop", "target", "n_bars", "outcome"]].itertuples(index=False)) == rows(want)


def test_stale_hashes_of_every_document(spark, tmp_path):
    texts = [(1, "odd", "a", 20000), (2, "even", "a", 4), (3, "odd", "b", 3), (4, "even", "b", 4), (5, None, "c", None), (6, "x", "d", 20001)]
    spark.createDataFrame(texts, "doc_id long, text string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.source: r.stale for r in core.QUERIES["stale_hashes_all"](spark, str(tmp_path)).collect()}
    assert {s: got[s] for s in "abd"} == {"a": True, "b": False, "d": True} and set(got) == set("abcd")
    assert got["c"] is False  # without a text there is no digest, as in the SQL


def test_stale_hashes_collects_no_source(spark, data):
    plan = core.QUERIES["stale_hashes_all"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "partial_sum" in plan

"""Streaming twins of the batch operators. Times are event times; state is bounded for each key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def bar_stream(events: DataFrame, width: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Clock bars of an event stream (event_id, ts, event_type, value); a bar comes out when the watermark passes it."""
    order = F.struct("ts", "event_id")
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy(F.col("event_type").alias("symbol"), F.window("ts", width).alias("w"))
        .agg(
            F.min_by("value", order).alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", order).alias("close"),
            F.count(F.lit(1)).alias("volume"),
        )
        .select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def tick_flow_stream(ticks: DataFrame, keep: int = 500) -> DataFrame:
    """symbol, ts, n_ticks, dropped, buy_volume, sell_volume, delta after each batch, over the last `keep` ticks.

    ticks: symbol, ts (timestamp), bid, volume. A tick that is not later than the last one taken is
    dropped. Volume goes to the buyers on a rise, to the sellers on a fall, and half to each else.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, bid, dropped, moves, volumes = state.get if state.exists else (pd.NaT, None, 0, [], [])
        moves, volumes = list(moves), list(volumes)
        last = pd.Timestamp(last) if last is not None else pd.NaT
        for rows in frames:
            for t, b, v in rows.sort_values("ts")[["ts", "bid", "volume"]].itertuples(index=False):
                if pd.notna(last) and t <= last:
                    dropped += 1
                    continue
                moves.append(0.0 if bid is None else float(b - bid))
                volumes.append(float(v))
                last, bid = t, float(b)
        moves, volumes = moves[-keep:], volumes[-keep:]
        state.update((last, bid, dropped, moves, volumes))
        buy = sum(v * (1.0 if m > 0 else 0.0 if m < 0 else 0.5) for m, v in zip(moves, volumes, strict=True))
        sell = sum(volumes) - buy
        yield pd.DataFrame({"symbol": [key[0]], "ts": [last], "n_ticks": [len(moves)], "dropped": [dropped], "buy_volume": [buy], "sell_volume": [sell], "delta": [buy - sell]})

    return ticks.groupBy("symbol").applyInPandasWithState(
        run,
        "symbol string, ts timestamp, n_ticks long, dropped long, buy_volume double, sell_volume double, delta double",
        "last timestamp, bid double, dropped long, moves array<double>, volumes array<double>",
        "update",
        GroupStateTimeout.NoTimeout,
    )


def paper_trade_stream(rows: DataFrame) -> DataFrame:
    """trade_id, side, outcome, closed_ts of trades as bars close them: -1 at the stop, else reward over risk.

    rows: symbol, ts (timestamp), kind ("open" or "bar"), trade_id, side, entry, stop, target, high, low.
    A trade looks at bars after its opening; a bar that reaches both levels is a loss. Open trades are
    the state of their symbol.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fields = ("trade_id", "side", "entry", "stop", "target", "opened")
        trades = [dict(zip(fields, t, strict=True)) for t in zip(*state.get, strict=True)] if state.exists else []
        closed = []
        for r in pd.concat(frames).sort_values("ts", kind="stable").itertuples(index=False):
            if r.kind == "open":
                trades.append(dict(zip(fields, (int(r.trade_id), int(r.side), r.entry, r.stop, r.target, r.ts), strict=True)))
                continue
            for t in list(trades):
                if r.ts <= pd.Timestamp(t["opened"]):
                    continue
                up = t["side"] == 1
                lost = r.low <= t["stop"] if up else r.high >= t["stop"]
                won = r.high >= t["target"] if up else r.low <= t["target"]
                if lost or won:
                    result = -1.0 if lost else abs(t["target"] - t["entry"]) / abs(t["entry"] - t["stop"])
                    closed.append((t["trade_id"], t["side"], result, r.ts))
                    trades.remove(t)
        state.update(tuple([t[f] for t in trades] for f in fields))
        yield pd.DataFrame(closed, columns=["trade_id", "side", "outcome", "closed_ts"])

    return rows.groupBy("symbol").applyInPandasWithState(
        run,
        "trade_id long, side int, outcome double, closed_ts timestamp",
        "trade_id array<long>, side array<int>, entry array<double>, stop array<double>, target array<double>, opened array<timestamp>",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def guarded_texts(texts: DataFrame, late: str = "1 day") -> DataFrame:
    """A text stream (ts, text) without what fails the quality rules or repeats within the watermark."""
    from tidemark.functions.text import digest, quality

    rows = texts.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.where(quality(F.col("text"))["accepted"]).withColumn("sha", digest(F.col("text"))).dropDuplicatesWithinWatermark(["sha"])

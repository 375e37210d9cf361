"""Trade decisions followed to their outcome by later quotes, in batch; streaming/journal.py is the streaming twin."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.outcomes import settle

#: What tells decisions apart: of rows that agree in all of them the first counts.
KEY = ("decided", "symbol", "side", "bid", "ask")

#: Horizons of time whose decisions meet their quotes in one group.
STRETCH = 6


def stretch(rows: DataFrame, time: str, width: int, earlier: int = 0) -> Column:
    """Number of the stretch of `width` seconds that a time, less `earlier` seconds, lies in; no time zone moves a time without one."""
    c = F.col(time)
    if rows.schema[time].dataType.typeName() == "timestamp_ntz":
        seconds = F.datediff(c, F.lit("1970-01-01").cast("date")).cast("long") * 86_400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    else:
        seconds = F.unix_seconds(c)
    return F.floor((seconds - earlier) / width)


def followed(decisions: DataFrame, quotes: DataFrame, horizon: int) -> DataFrame:
    """decisions (KEY, target, limit, worth) with status, most_favorable, most_adverse, seconds.

    quotes: symbol, ts, ord, bid, ask. Quotes after a decision, for `horizon` seconds, are looked at in their
    order: the first that gives `target` in profit makes a win, the first that loses `limit` a loss (a win
    goes before a loss at one quote); extremes count up to it. A target or limit of 0 or less is never met.
    Without an outcome the status is pending. worth: profit of a price move of one.

    A symbol's decisions of a few horizons meet the quotes of that time and one horizon more in one group,
    where settle() takes the logarithm of the quotes for each; no pair of a decision and a quote is a row.
    """
    width = horizon * STRETCH
    asked = decisions.withColumn("stretch", stretch(decisions, "decided", width)).repartition("symbol", "stretch")
    asked = asked.dropDuplicates([*KEY, "stretch"])
    given = quotes.where("symbol IS NOT NULL AND ts IS NOT NULL")
    given = given.withColumn("stretch", F.explode(F.array_distinct(F.array(stretch(given, "ts", width, horizon), stretch(given, "ts", width)))))
    given = given.select("symbol", "stretch", F.col("ts").cast(decisions.schema["decided"].dataType).alias("ts"), "ord", *[F.col(c).cast("double").alias(c) for c in ("bid", "ask")])
    shape = [f for f in decisions.schema.fields]
    text = "`{}` {}".format
    schema = ", ".join([*[text(f.name.replace("`", "``"), f.dataType.simpleString()) for f in shape], "status string, most_favorable double, most_adverse double, seconds long"])

    def floats(rows: pa.Table, name: str) -> np.ndarray:
        return rows.column(name).cast(pa.float64()).to_numpy().astype(np.float64)

    def follow(rows: pa.Table, near: pa.Table) -> pa.Table:
        n = rows.num_rows
        status = np.full(n, "pending", object)
        favorable, adverse, seconds = np.zeros(n), np.zeros(n), np.full(n, -1, np.int64)
        near = near.sort_by([("ts", "ascending"), ("ord", "ascending")])
        side, bid, ask, worth, target, limit = (floats(rows, c) for c in ("side", "bid", "ask", "worth", "target", "limit"))
        decided = rows.column("decided").cast(pa.int64()).to_numpy()
        whole = ~np.logical_or.reduce([rows.column(c).is_null().to_numpy() for c in ("decided", "side", "worth")])
        for mine, own, price in ((side == 1, "ask", "bid"), (side != 1, "bid", "ask")):
            who = np.flatnonzero(mine & whole & ~rows.column(own).is_null().to_numpy())
            seen = near.filter(near.column(price).is_valid())
            if not len(who) or not seen.num_rows:
                continue
            times = seen.column("ts").cast(pa.int64()).to_numpy()
            entry = ask if own == "ask" else bid
            hit, won, favorable[who], adverse[who] = settle(times, floats(seen, price), decided[who].astype(np.int64), horizon * 1_000_000, side[who], entry[who], worth[who], target[who], limit[who])
            ended = hit >= 0
            status[who[ended]] = np.where(won[ended], "win", "loss")
            seconds[who[ended]] = times[hit[ended]] // 1_000_000 - decided[who[ended]].astype(np.int64) // 1_000_000
        found = pa.array(seconds, pa.int64(), mask=seconds < 0)
        kind = rows.schema.field("symbol").type
        columns = [*[rows.column(f.name) for f in shape], pa.array(status, kind), pa.array(favorable), pa.array(adverse), found]
        return pa.Table.from_arrays(columns, names=[*[f.name for f in shape], "status", "most_favorable", "most_adverse", "seconds"])

    return asked.groupBy("symbol", "stretch").cogroup(given.groupBy("symbol", "stretch")).applyInArrow(follow, schema)

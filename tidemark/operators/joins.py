"""Joins in time: as-of, first touch, pairing, look-ups with an age limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def carried(rows: DataFrame, value: str, after: bool = False) -> DataFrame:
    """rows with `value` of the last row that has one, up to and including the row itself; after: of the next.

    rows: symbol, at (timestamp_ntz), kind (ties at one time go by kind), and the value. Rows are sorted
    within a symbol's day, so a symbol with most of the rows is as many tasks as it has days; between
    days only each day's last value is carried.
    """
    return carried_all(rows, [value], after)


def carried_all(rows: DataFrame, values: list[str], after: bool = False) -> DataFrame:
    """carried() for several values at once, each from the last row that has it, in one sort."""
    turn = (lambda c: F.desc(c)) if after else (lambda c: F.asc(c))
    pick = F.min_by if after else F.max_by
    rows = rows.withColumn("day", F.date_trunc("day", "at"))
    held = [f"held_{i}" for i in range(len(values))]
    ends = rows.groupBy("symbol", "day").agg(*[pick(v, F.when(F.col(v).isNotNull(), F.struct("at", "kind"))).alias(h) for v, h in zip(values, held, strict=True)])
    sooner = Window.partitionBy("symbol").orderBy(turn("day")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col("symbol").alias("s"), F.col("day").alias("d"), *[F.last(h, ignorenulls=True).over(sooner).alias(h) for h in held])
    inside = Window.partitionBy("symbol", "day").orderBy(turn("at"), turn("kind")).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumns({f"own_{i}": F.last(v, ignorenulls=True).over(inside) for i, v in enumerate(values)})
    found = found.join(ends, F.col("symbol").eqNullSafe(F.col("s")) & F.col("day").eqNullSafe(F.col("d")))
    found = found.withColumns({v: F.coalesce(f"own_{i}", held[i]) for i, v in enumerate(values)})
    return found.drop("s", "d", "day", *held, *[f"own_{i}" for i in range(len(values))])


def as_of(decisions: DataFrame, bars: DataFrame, minutes: int) -> DataFrame:
    """decisions (symbol, ts) with bar_ts and bar_close of the latest bar that was closed by then.

    A bar is closed `minutes` after its time. Both sides are stacked, sorted once by symbol, day and time,
    and the last bar is carried forward, so no range of rows is joined with another.
    """
    shut = bars.select("symbol", (F.col("ts") + F.make_dt_interval(mins=F.lit(minutes))).alias("at"), F.lit(0).alias("kind"), F.struct(F.col("ts").alias("bar_ts"), F.col("close").alias("bar_close")).alias("bar"))
    asked = decisions.select("symbol", F.col("ts").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(shut.schema["bar"].dataType).alias("bar"))
    return carried(shut.unionByName(asked), "bar").where("kind = 1").select("symbol", F.col("at").alias("ts"), "bar.bar_ts", "bar.bar_close")


def latest_within(queries: DataFrame, signals: DataFrame, seconds: int) -> DataFrame:
    """queries (symbol, ts) with signal_ts and value of the newest signal up to then, null if older than allowed."""
    given = signals.select("symbol", F.col("ts").alias("at"), F.lit(0).alias("kind"), F.struct(F.col("ts").alias("signal_ts"), "value").alias("signal"))
    asked = queries.select("symbol", F.col("ts").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(given.schema["signal"].dataType).alias("signal"))
    both = carried(given.unionByName(asked), "signal").where("kind = 1")
    fresh = F.col("at") - F.col("signal.signal_ts") <= F.make_dt_interval(secs=F.lit(seconds))
    return both.select("symbol", F.col("at").alias("ts"), F.when(fresh, F.col("signal.signal_ts")).alias("signal_ts"), F.when(fresh, F.col("signal.value")).alias("value"))


def first_touch(trades: DataFrame, bars: DataFrame, horizon: int = 12) -> DataFrame:
    """trades with outcome in units of risk: -1 at the stop, reward over risk at the target, else the move.

    trades: symbol, ts, side (1 long, -1 short), entry, stop, target. Of the `horizon` bars from the first
    one at or after ts the first that reaches a level decides; a bar that reaches both is a loss. Each bar
    holds its horizon as an array, so a trade meets one row; trades without a bar after them are left out.
    """
    held = Window.partitionBy("symbol").orderBy("ts").rowsBetween(0, horizon - 1)
    ahead = bars.select("symbol", F.col("ts").alias("bar_ts"), F.collect_list(F.struct("high", "low", "close")).over(held).alias("ahead"))
    marks = bars.select("symbol", F.col("ts").alias("at"), F.lit(1).alias("kind"), F.col("ts").alias("bar_ts"), F.lit(None).cast(trades.select(F.struct("side", "entry", "stop", "target")).schema[0].dataType).alias("trade"))
    asked = trades.select("symbol", F.col("ts").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("timestamp_ntz").alias("bar_ts"), F.struct("side", "entry", "stop", "target").alias("trade"))
    found = carried(marks.unionByName(asked), "bar_ts", after=True).where("kind = 0").select("symbol", F.col("at").alias("ts"), "trade.*", "bar_ts")
    found = found.join(ahead, ["symbol", "bar_ts"])
    risk, reward = F.abs(F.col("entry") - F.col("stop")), F.abs(F.col("target") - F.col("entry"))
    long = F.col("side") == 1
    lost = lambda b: F.when(long, b["low"] <= F.col("stop")).otherwise(b["high"] >= F.col("stop"))
    won = lambda b: F.when(long, b["high"] >= F.col("target")).otherwise(b["low"] <= F.col("target"))
    result = F.transform("ahead", lambda b: F.when(lost(b), F.lit(-1.0)).when(won(b), reward / risk))
    hit = F.get(F.filter(result, lambda x: x.isNotNull()), F.lit(0))
    last = F.element_at("ahead", -1)["close"]
    outcome = F.coalesce(hit, F.col("side") * (last - F.col("entry")) / risk)
    return found.select("symbol", "ts", "side", "entry", "stop", "target", F.size("ahead").cast("long").alias("n_bars"), outcome.alias("outcome"))


def paired(opens: DataFrame, closes: DataFrame) -> DataFrame:
    """id, open_ts, close_ts, open_price, close_price: each close with the last open of its id before it.

    opens and closes: id, ts, price. A close without an open before it is left out.
    """
    none = F.lit(None).cast("struct<ts:timestamp_ntz,price:double>")
    begun = opens.select("id", F.col("ts").alias("at"), F.lit(0).alias("kind"), F.struct("ts", "price").alias("o"), none.alias("c"))
    ended = closes.select("id", F.col("ts").alias("at"), F.lit(1).alias("kind"), none.alias("o"), F.struct("ts", "price").alias("c"))
    sofar = Window.partitionBy("id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    both = begun.unionByName(ended).withColumn("o", F.last("o", ignorenulls=True).over(sofar)).where("kind = 1 AND o IS NOT NULL")
    return both.select("id", F.col("o.ts").alias("open_ts"), F.col("c.ts").alias("close_ts"), F.col("o.price").alias("open_price"), F.col("c.price").alias("close_price"))


def nearest_gap(prices: DataFrame, gaps: DataFrame) -> DataFrame:
    """prices (symbol, price) with the middle of the nearest gap (symbol, top, bottom) of the symbol, and its distance.

    Prices and middles are stacked and sorted once; the nearest is the last middle at or below a price or
    the first above it, the lower of two at one distance. A price of a symbol without gaps is left out.
    """
    middle = (F.col("top") + F.col("bottom")) / 2
    none = F.lit(None).cast("double")
    marks = gaps.select("symbol", middle.alias("x"), F.lit(0).alias("kind"), middle.alias("middle"))
    both = marks.unionByName(prices.select("symbol", F.col("price").alias("x"), F.lit(1).alias("kind"), none.alias("middle")))
    low = Window.partitionBy("symbol").orderBy("x", "kind").rowsBetween(Window.unboundedPreceding, 0)
    high = Window.partitionBy("symbol").orderBy(F.desc("x"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({"under": F.last("middle", ignorenulls=True).over(low), "over": F.last("middle", ignorenulls=True).over(high)}).where("kind = 1")
    far = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("x") - F.col(c)).alias("distance"), F.col(c).alias("middle")))
    return both.select("symbol", F.col("x").alias("price"), F.least(far("under"), far("over")).alias("n")).where("n IS NOT NULL").select("symbol", "price", "n.middle", "n.distance").distinct()

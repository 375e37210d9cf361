"""Several timeframes at once: bars rolled up to wider ones, and the last bars of each that a decision may see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import carried_all

#: Minutes of the frames, the widest first.
FRAMES = {"d1": 1440, "h4": 240, "h1": 60, "m30": 30, "m15": 15, "m5": 5}

# Bars back and weight of the directional score's frames.
BIAS = {"d1": (2, 0.30), "h4": (2, 0.25), "h1": (4, 0.20), "m30": (3, 0.15), "m15": (4, 0.10)}


def rolled(bars: DataFrame, minutes: int) -> DataFrame:
    """bars of a narrower clock as bars of `minutes`, stamped with their start."""
    wide = bars.groupBy("symbol", F.window("ts", f"{minutes} minutes").alias("w")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")
    )
    return wide.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def visible(decisions: DataFrame, frames: dict[str, tuple[DataFrame, int]], keep: int = 10, closed: bool = True) -> DataFrame:
    """decisions (symbol, ts) with a column for each frame (name: its bars and minutes): an array of its last `keep` bars, the newest last.

    A bar is seen once it is closed, `minutes` after its time; with closed=False (a replay of history) from
    its time on, while it is still forming. Where nothing is seen the array is empty. Bars carry their
    forerunners with them, so one sort of all frames and decisions by symbol, day and time serves all frames.
    """
    names = list(frames)
    back = Window.partitionBy("symbol").orderBy("ts").rowsBetween(1 - keep, 0)
    parts = []
    shape = None
    for name, (bars, minutes) in frames.items():
        held = F.collect_list(F.struct("ts", "open", "high", "low", "close", "volume")).over(back)
        at = F.col("ts") + F.make_dt_interval(mins=F.lit(minutes)) if closed else F.col("ts")
        part = bars.select("symbol", at.alias("at"), F.lit(0).alias("kind"), held.alias(name))
        shape = part.schema[name].dataType
        parts.append(part)
    stacked = decisions.select("symbol", F.col("ts").alias("at"), F.lit(1).alias("kind"))
    for part in parts:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    found = carried_all(stacked, names).where("kind = 1")
    return found.select("symbol", F.col("at").alias("ts"), *[F.coalesce(n, F.array().cast(shape)).alias(n) for n in names])


def frame_score(bars: Column, back: int) -> Column:
    """Move of the last `back` bars in units of twice the mean range of the last ten, from -1 to 1; 0 for fewer bars."""
    ranges = F.transform(F.slice(bars, F.greatest(F.lit(1), F.size(bars) - 9), 10), lambda b: F.greatest(b["high"] - b["low"], F.lit(1e-9)))
    size = F.aggregate(ranges, F.lit(0.0), lambda a, x: a + x) / 10
    move = F.get(bars, F.size(bars) - 1)["close"] - F.get(bars, F.size(bars) - back)["close"]
    return F.when(F.size(bars) < back, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), move / (size * 2))))


def directional_bias(frames: dict[str, Column]) -> Column:
    """Weighted scores of the frames, from -1 to 1, more where at least three that say something agree."""
    scores = F.array(*[frame_score(frames[n], back) * weight for n, (back, weight) in BIAS.items()])

    def judged(held: Column) -> Column:
        told = F.filter(held, lambda s: F.abs(s) > 0.01)
        agree = (F.size(told) >= 3) & (F.forall(told, lambda s: s > 0) | F.forall(told, lambda s: s < 0))
        total = F.aggregate(held, F.lit(0.0), lambda a, x: a + x) * F.when(agree, 1 + 0.2 * F.size(told)).otherwise(1.0)
        return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), total))

    return F.get(F.transform(F.array(scores), judged), F.lit(0))


def trend_alignment(frames: dict[str, Column]) -> Column:
    """Mean direction of the last change of each frame; one that has not risen counts as a fall, one with a single bar as neither."""
    last = lambda b, k: F.get(b, F.size(b) - k)["close"]
    ways = [F.when(F.size(frames[n]) < 2, 0).when(last(frames[n], 1) > last(frames[n], 2), 1).otherwise(-1) for n in BIAS]
    return sum(ways[1:], ways[0]) / len(BIAS)

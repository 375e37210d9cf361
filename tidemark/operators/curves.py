"""Curves of running profit over many rows: days are folded apart, and only a row for each day meets the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def curve(rows: DataFrame, keys: list[str], time: str, order: list[str], goal: float = 50.0) -> DataFrame:
    """keys, n, ending, peak (at least 0), max_drawdown, max_loss_streak, trades_to_goal (0: never reached) of `profit`.

    Rows go by `time` and then `order`. A profit of zero neither ends a streak of losses nor adds to one. Rows are
    sorted within a key's day; of each day its sum, extremes, deepest fall and streaks at both ends say how
    it joins the days before. The place at which the goal was reached is looked for in its one day.
    """
    day = F.date_trunc("day", time).alias("day")
    own = rows.select(*keys, day, F.struct(time, *order).alias("o"), F.col("profit").cast("double").alias("profit"))
    on = [*keys, "day"]
    by = Window.partitionBy(*on).orderBy("o")
    sofar, sooner = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(Window.unboundedPreceding, -1)
    inside = own.withColumns({"equity": F.sum("profit").over(sofar), "place": F.row_number().over(by), "island": F.coalesce(F.sum((F.col("profit") > 0).cast("int")).over(sooner), F.lit(0))})
    inside = inside.withColumn("fall", F.max("equity").over(sofar) - F.col("equity"))
    parts = inside.groupBy(*on, "island").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("profit") < 0).alias("losses"), F.count_if(F.col("profit") > 0).alias("wins"),
        F.max_by("equity", "place").alias("last"), F.max("place").alias("end"), F.max("equity").alias("high"), F.min("equity").alias("low"), F.max("fall").alias("fall"),
    )
    days = parts.groupBy(*on).agg(
        F.sum("n").alias("n"), F.sum("losses").alias("losses"), F.sum("wins").alias("wins"), F.max_by("last", "end").alias("total"), F.max("high").alias("high"), F.min("low").alias("low"), F.max("fall").alias("fall"),
        F.sum(F.when(F.col("island") == 0, F.col("losses")).otherwise(0)).alias("lead"), F.max("losses").alias("run"),
        # what follows the last win: the island after it, or nothing where the win is the day's last
        F.max_by(F.when(F.col("wins") > 0, 0).otherwise(F.col("losses")), "island").alias("trail"),
    )
    over = Window.partitionBy(*keys).orderBy("day") if keys else Window.orderBy("day")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumns({"base": F.coalesce(F.sum("total").over(before), F.lit(0.0)), "done": F.coalesce(F.sum("n").over(before), F.lit(0)), "lost": F.coalesce(F.sum("losses").over(before), F.lit(0))})
    mark = F.when(F.col("wins") > 0, F.struct((F.col("lost") + F.col("losses")).alias("lost"), "trail"))
    days = days.withColumns({"top": F.greatest(F.lit(0.0), F.coalesce(F.max(F.col("base") + F.col("high")).over(before), F.lit(0.0))), "won": F.last(mark, ignorenulls=True).over(before)})
    held = F.when(F.col("won").isNull(), F.col("lost")).otherwise(F.col("lost") - F.col("won.lost") + F.col("won.trail"))
    days = days.withColumns({"fall": F.greatest("fall", F.col("top") - F.col("base") - F.col("low")), "run": F.greatest("run", held + F.col("lead")), "reached": F.col("base") + F.col("high") >= goal})
    whole = days.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.max_by(F.col("base") + F.col("total"), "day").alias("ending"), F.greatest(F.lit(0.0), F.max(F.col("base") + F.col("high"))).alias("peak"),
        F.greatest(F.lit(0.0), F.max("fall")).alias("max_drawdown"), F.max("run").alias("max_loss_streak"), F.min_by(F.struct("day", "base", "done"), F.when(F.col("reached"), F.col("day"))).alias("g"),
    )
    same = F.col("day").eqNullSafe(F.col("g.day"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"g_{k}"))
    goals = whole.where("g IS NOT NULL").select(*[F.col(k).alias(f"g_{k}") for k in keys], "g")
    hit = inside.join(goals, same).where(F.col("equity") + F.col("g.base") >= goal)
    hit = hit.groupBy(*[f"g_{k}" for k in keys]).agg((F.min("place") + F.first("g.done")).alias("trades_to_goal"))
    link = F.lit(True)
    for k in keys:
        link = link & F.col(k).eqNullSafe(F.col(f"g_{k}"))
    found = whole.where("n IS NOT NULL").drop("g").join(hit, link, "left").drop(*[f"g_{k}" for k in keys])
    return found.withColumn("trades_to_goal", F.coalesce("trades_to_goal", F.lit(0)))


def numbered(rows: DataFrame, keys: list[str], time: str, order: list[str]) -> DataFrame:
    """rows with place (from 1, by time and order, within the keys) and whole (how many the keys have); sorted by day as in curve()."""
    on = [*keys, "day"]
    own = rows.withColumn("day", F.date_trunc("day", time))
    days = own.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    over = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(*[F.col(c).alias(f"d_{c}") for c in on], F.coalesce(F.sum("n").over(over), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy(*keys)).alias("whole"))
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"d_{c}"))
    found = own.withColumn("place", F.row_number().over(Window.partitionBy(*on).orderBy(time, *order))).join(days, same)
    return found.withColumn("place", F.col("place") + F.col("before")).drop("day", "before", *[f"d_{c}" for c in on])

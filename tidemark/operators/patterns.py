"""Patterns of neighbouring bars, as conditions over lag and lead."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.indicators import TINY
from tidemark.operators.bars import series


def _age(bars: DataFrame) -> DataFrame:
    """bars with since: how many bars came after."""
    newest = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    return bars.withColumn("since", F.row_number().over(newest) - 1)


def order_blocks(bars: DataFrame, lookback: int = 50, factor: float = 1.5) -> DataFrame:
    """Bars before a stronger bar the other way, among the last `lookback` of a symbol that have a next bar.

    symbol, ts, direction (1 demand, -1 supply), price_low, price_high, strength (body to range),
    imbalance (volume of the next bar to the own), bars_since.
    """
    by = series()
    nxt = lambda c: F.lead(c).over(by)
    seen = _age(bars).withColumns({"next_open": nxt("open"), "next_close": nxt("close"), "next_volume": nxt("volume")})
    body, after = F.col("close") - F.col("open"), F.col("next_close") - F.col("next_open")
    demand = (body < 0) & (after > 0) & (after > -body * factor)
    supply = (body > 0) & (after < 0) & (-after > body * factor)
    return seen.where((demand | supply) & F.col("since").between(1, lookback)).select(
        "symbol",
        "ts",
        F.when(demand, 1).otherwise(-1).alias("direction"),
        F.col("low").alias("price_low"),
        F.col("high").alias("price_high"),
        (F.abs(body) / F.greatest(F.col("high") - F.col("low"), F.lit(TINY))).alias("strength"),
        F.when(F.col("volume") > 0, F.col("next_volume") / F.col("volume")).otherwise(1.0).alias("imbalance"),
        F.col("since").alias("bars_since"),
    )


def fair_value_gaps(bars: DataFrame, lookback: int = 20) -> DataFrame:
    """Gaps that a bar leaves between the bar before and the bar after it, among the last `lookback` such bars.

    symbol, ts (of the middle bar), direction, top, bottom, bars_since.
    """
    by = series()
    seen = _age(bars).withColumns(
        {"high0": F.lag("high").over(by), "low0": F.lag("low").over(by), "high2": F.lead("high").over(by), "low2": F.lead("low").over(by)}
    )
    up, down = F.col("low2") > F.col("high0"), F.col("high2") < F.col("low0")
    return seen.where((up | down) & F.col("since").between(1, lookback)).select(
        "symbol",
        "ts",
        F.when(up, 1).otherwise(-1).alias("direction"),
        F.when(up, F.col("low2")).otherwise(F.col("low0")).alias("top"),
        F.when(up, F.col("high0")).otherwise(F.col("high2")).alias("bottom"),
        F.col("since").alias("bars_since"),
    )


def candlesticks(bars: DataFrame) -> DataFrame:
    """symbol, ts, pattern: the first that holds of stars, engulfings, pinbars, expansion, or "none"."""
    by = series()
    at = lambda c, k: F.lag(c, k).over(by)
    size = F.greatest(F.col("high") - F.col("low"), F.lit(TINY))
    usual = F.avg(size).over(by.rowsBetween(-9, 0))
    cols = {"o1": at("open", 1), "c1": at("close", 1), "h1": at("high", 1), "l1": at("low", 1), "o2": at("open", 2), "c2": at("close", 2), "size": size, "usual": usual}
    seen = bars.withColumns(cols)
    o, c = F.col("open"), F.col("close")
    body = F.abs(c - o)
    small = F.abs(F.col("c1") - F.col("o1")) <= 0.4 * F.greatest(F.col("h1") - F.col("l1"), F.lit(TINY))
    middle = (F.col("o2") + F.col("c2")) / 2
    upper, lower = F.col("high") - F.greatest(o, c), F.least(o, c) - F.col("low")
    slim = body <= 0.35 * F.col("size")
    wide = (body >= 0.7 * F.col("size")) & (F.col("size") >= 1.25 * F.col("usual"))
    pattern = (
        F.when(F.col("c1").isNull(), "none")
        .when((F.col("c2") < F.col("o2")) & small & (c > o) & (c >= middle), "morning_star")
        .when((F.col("c2") > F.col("o2")) & small & (c < o) & (c <= middle), "evening_star")
        .when((F.col("c1") < F.col("o1")) & (c > o) & (c >= F.col("o1")) & (o <= F.col("c1")), "bullish_engulfing")
        .when((F.col("c1") > F.col("o1")) & (c < o) & (c <= F.col("o1")) & (o >= F.col("c1")), "bearish_engulfing")
        .when((lower >= 0.55 * F.col("size")) & slim, "bullish_pinbar")
        .when((upper >= 0.55 * F.col("size")) & slim, "bearish_pinbar")
        .when(wide & (c > o), "bullish_expansion")
        .when(wide & (c < o), "bearish_expansion")
        .otherwise("none")
    )
    return seen.select("symbol", "ts", pattern.alias("pattern"))


def breakouts(bars: DataFrame, n: int = 20) -> DataFrame:
    """symbol, ts, breakout: how a bar leaves the range of the n bars before it: up, down, wick_up, wick_down, none."""
    before = series().rowsBetween(-n, -1)
    seen = bars.withColumns({"top": F.max("high").over(before), "bottom": F.min("low").over(before)})
    kind = (
        F.when(F.col("close") > F.col("top"), "up")
        .when(F.col("close") < F.col("bottom"), "down")
        .when(F.col("high") > F.col("top"), "wick_up")
        .when(F.col("low") < F.col("bottom"), "wick_down")
        .otherwise("none")
    )
    return seen.select("symbol", "ts", kind.alias("breakout"))


def fibonacci(bars: DataFrame, n: int = 40) -> DataFrame:
    """symbol, ts, direction, zone: the place of the close in the swing of the last n bars.

    The swing rises if its low came before its high; the first of equal extremes counts. Zones are cut at
    38.2, 61.8 and 78.6 percent of the way back.
    """
    frame = series().rowsBetween(1 - n, 0)
    order = lambda sign, c: F.struct((sign * F.col(c)).alias("v"), F.col("ts"))
    seen = bars.withColumns({"low_at": F.min(order(1, "low")).over(frame), "high_at": F.min(order(-1, "high")).over(frame)})
    low, high = F.col("low_at.v"), -F.col("high_at.v")
    rises = F.col("low_at.ts") <= F.col("high_at.ts")
    back = F.when(rises, high - F.col("close")).otherwise(F.col("close") - low) / (high - low)
    zone = F.when(high <= low, "flat").when(back < 0.382, "shallow").when(back <= 0.618, "golden").when(back <= 0.786, "deep").otherwise("failed")
    return seen.select("symbol", "ts", F.when(rises, 1).otherwise(-1).alias("direction"), zone.alias("zone"))

"""Scores of the last bars of a timeframe, as expressions over an array of bars (open, high, low, close), the newest last."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import let

TINY = 1e-9

# Lengths of means, weights of the scores' parts, weights of the frames.
FAST, SLOW, SIGNAL = 12, 26, 9
MOMENTUM = (0.30, 0.35, 0.25, 0.10)
TREND = {"m5": 0.15, "m15": 0.35, "m30": 0.25, "h1": 0.25}
TREND_PARTS = (0.55, 0.30, 0.15)
STRUCTURE = (0.45, 0.30, 0.15, 0.10)


def clamp(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def last(items: Column, n: int) -> Column:
    """The last n items, or all where there are fewer."""
    return F.slice(items, F.greatest(F.lit(1), F.size(items) - n + 1), n)


def back(items: Column, k: int) -> Column:
    """The item k places from the end; 1 is the last."""
    return F.get(items, F.size(items) - k)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def ema(values: Column, n: int) -> Column:
    """Exponential mean that begins with the first value; null for none."""
    alpha = 2.0 / (n + 1)
    return F.aggregate(F.slice(values, 2, F.greatest(F.lit(0), F.size(values) - 1)), F.get(values, F.lit(0)), lambda a, x: x * alpha + a * (1 - alpha))


def rsi(closes: Column) -> Column:
    """Relative strength of all changes of an array of closes: 100 without a fall, 50 for fewer than three."""
    changes = F.zip_with(F.slice(closes, 2, F.size(closes) - 1), F.slice(closes, 1, F.size(closes) - 1), lambda a, b: a - b)
    gain = total(F.transform(changes, lambda d: F.greatest(d, F.lit(0.0)))) / F.size(changes)
    loss = total(F.transform(changes, lambda d: F.greatest(-d, F.lit(0.0)))) / F.size(changes)
    return F.when(F.size(closes) < 3, 50.0).when(loss <= 0, 100.0).otherwise(100 - 100 / (1 + gain / loss))


def macd_change(closes: Column, steps: int = 3) -> Column:
    """How the MACD histogram has changed over the last `steps` closes, in one pass over all closes."""
    mix = lambda old, new, n: new * (2.0 / (n + 1)) + old * (1 - 2.0 / (n + 1))
    first = F.get(closes, F.lit(0))
    held = F.struct(first.alias("fast"), first.alias("slow"), F.lit(0.0).alias("signal"), F.array(F.lit(0.0)).alias("bars"))

    def step(a: Column, x: Column) -> Column:
        fast, slow = mix(a["fast"], x, FAST), mix(a["slow"], x, SLOW)
        signal = mix(a["signal"], fast - slow, SIGNAL)
        return F.struct(fast.alias("fast"), slow.alias("slow"), signal.alias("signal"), last(F.concat(a["bars"], F.array(fast - slow - signal)), steps + 1).alias("bars"))

    return F.aggregate(F.slice(closes, 2, F.size(closes) - 1), held, step, lambda a: back(a["bars"], 1) - F.get(a["bars"], F.lit(0)))


def efficiency(bar: Column) -> Column:
    return clamp(F.abs(bar["close"] - bar["open"]) / F.greatest(F.abs(bar["high"] - bar["low"]), F.lit(TINY)), 0.0)


def ranges(bars: Column) -> Column:
    return total(F.transform(bars, lambda b: F.abs(b["high"] - b["low"])))


def slope(bars: Column) -> Column:
    """Move over the bars in units of their ranges together."""
    return F.when(F.size(bars) < 2, 0.0).otherwise(clamp((back(bars, 1)["close"] - F.get(bars, F.lit(0))["close"]) / F.greatest(ranges(bars), F.lit(TINY))))


def momentum(bars: Column) -> Column:
    """From -1 to 1: change of the relative strength, of the MACD histogram, of the rate of change, and the last body; 0 below 35 bars."""

    def judged(p: Column) -> Column:
        c, bar = p["c"], p["bar"]
        strength = clamp((rsi(last(c, 15)) - rsi(F.slice(c, F.size(c) - 19, 15))) / 25)
        macd = clamp(macd_change(c) / F.greatest(F.abs(back(c, 1)) * 0.0004, F.lit(TINY)))
        rate = lambda k: (back(c, 1) - back(c, k)) / F.greatest(F.abs(back(c, k)), F.lit(TINY))
        body = efficiency(bar) * F.when(bar["close"] >= bar["open"], 1.0).otherwise(-1.0)
        parts = (strength, macd, clamp((rate(4) - rate(12)) * 800), body)
        return clamp(sum((w * x for w, x in zip(MOMENTUM[1:], parts[1:], strict=True)), MOMENTUM[0] * parts[0]))

    told = F.struct(F.transform(bars, lambda b: b["close"]).alias("c"), back(bars, 1).alias("bar"))
    return F.when(F.size(bars) < 35, 0.0).otherwise(let(told, judged))


def frame_trend(bars: Column) -> Column:
    """From -1 to 1: order of the close and two exponential means, slope, and how straight the way was; null below 30 bars."""

    def judged(p: Column) -> Column:
        near, far, close, lean, straight = (p[k] for k in ("near", "far", "close", "slope", "straight"))
        order = F.when((close > near) & (near > far), 1.0).when((close < near) & (near < far), -1.0).otherwise(0.0)
        way = F.when(lean >= 0, 1.0).otherwise(-1.0)
        return clamp(TREND_PARTS[0] * order + TREND_PARTS[1] * lean + TREND_PARTS[2] * straight * way)

    c = F.transform(bars, lambda b: b["close"])
    wide = last(bars, 20)
    straight = clamp(F.abs(back(wide, 1)["close"] - F.get(wide, F.lit(0))["close"]) / F.greatest(ranges(wide), F.lit(TINY)), 0.0)
    far = F.when(F.size(bars) >= 60, ema(last(c, 60), 50)).otherwise(ema(c, 30))
    told = F.struct(ema(last(c, 30), 20).alias("near"), far.alias("far"), back(c, 1).alias("close"), slope(last(bars, 12)).alias("slope"), straight.alias("straight"))
    return F.when(F.size(bars) >= 30, let(told, judged))


def trend(frames: dict[str, Column]) -> Column:
    """Weighted trends of the frames; one with too few bars adds nothing."""
    return clamp(sum((w * F.coalesce(frame_trend(frames[n]), F.lit(0.0)) for n, w in TREND.items()), F.lit(0.0)))


def structure(m5: Column, m15: Column, h1: Column) -> Column:
    """From -1 to 1: a close beyond the last 19 bars' extremes, a wick that was taken back, the place between them, and the hours' slope.

    The bars of fifteen minutes count from 20 of them on, else those of five; 0 below 12.
    """

    def judged(bars: Column) -> Column:
        before = F.slice(last(bars, 20), 1, F.size(last(bars, 20)) - 1)
        edges = F.struct(F.array_max(F.transform(before, lambda b: b["high"])).alias("high"), F.array_min(F.transform(before, lambda b: b["low"])).alias("low"), back(bars, 1).alias("bar"))

        def scored(p: Column) -> Column:
            close, high, low = p["bar"]["close"], p["high"], p["low"]
            beyond = F.when(close > high, 1.0).when(close < low, -1.0).otherwise(0.0)
            swept = F.when((p["bar"]["high"] > high) & (close < high), -0.7).when((p["bar"]["low"] < low) & (close > low), 0.7).otherwise(0.0)
            place = clamp((close - (high + low) / 2) / F.greatest(high - low, F.lit(TINY)))
            hours = F.when(F.size(h1) >= 8, slope(last(h1, 8))).otherwise(0.0)
            parts = (beyond, swept, place, hours)
            return clamp(sum((w * x for w, x in zip(STRUCTURE[1:], parts[1:], strict=True)), STRUCTURE[0] * parts[0]))

        return F.when(F.size(bars) < 12, 0.0).otherwise(let(edges, scored))

    return let(F.when(F.size(m15) >= 20, m15).otherwise(m5), judged)

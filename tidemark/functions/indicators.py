"""Indicators over trailing row frames; every function takes columns and the order of the rows.

A `by` is a WindowSpec without a frame, partitioned by symbol and ordered by time. Frames are the last
n rows, the current one included; heads are partial. Standard deviations are of the population.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

TINY = 1e-9


def clamp(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def last(by: WindowSpec, n: int) -> WindowSpec:
    """The last n rows, the current one included."""
    return by.rowsBetween(1 - n, 0)


def true_range(by: WindowSpec, first: str = "null") -> Column:
    """Range against the close before; the first bar has none ("null") or its own range ("range")."""
    before = F.lag("close").over(by)
    full = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    own = F.col("high") - F.col("low")
    return F.when(before.isNotNull(), full).otherwise(own if first == "range" else F.lit(None).cast("double"))


def atr(by: WindowSpec, n: int = 14) -> Column:
    """Mean true range of the last n bars that have one; needs a column tr."""
    return F.avg("tr").over(last(by, n))


def rsi(by: WindowSpec, n: int = 14, zero_loss: str = "full") -> Column:
    """Relative strength of the last n changes by simple means; 50 before there are n; needs a column change.

    zero_loss: 100 when nothing was lost ("full"), or 100 only if something was gained, else 50 ("gain").
    """
    frame = last(by, n)
    gain = F.avg(F.greatest(F.col("change"), F.lit(0.0))).over(frame)
    loss = F.avg(F.greatest(-F.col("change"), F.lit(0.0))).over(frame)
    flat = F.lit(100.0) if zero_loss == "full" else F.when(gain > 0, 100.0).otherwise(50.0)
    value = F.when(loss <= 0, flat).otherwise(100.0 - 100.0 / (1.0 + gain / loss))
    return F.when(F.count("change").over(frame) < n, 50.0).otherwise(value)


def zscore(x: str, by: WindowSpec, n: int = 100, flat: str = "one") -> Column:
    """Distance from the frame's mean in deviations; with no deviation it is taken as one, or the score is zero."""
    frame = last(by, n)
    mean, dev = F.avg(x).over(frame), F.stddev_pop(x).over(frame)
    score = (F.col(x) - mean) / F.when(dev > 0, dev).otherwise(1.0)
    return score if flat == "one" else F.when(dev > 0, score).otherwise(0.0)


def percentile_rank(x: str, by: WindowSpec, n: int = 40) -> Column:
    """Share of the frame's values that are not above the current one."""
    values = F.collect_list(x).over(last(by, n))
    return F.size(F.filter(values, lambda v: v <= F.col(x))) / F.size(values)


def sign_entropy(x: str, by: WindowSpec, n: int = 30) -> Column:
    """Binary entropy of the signs in the frame; zeros do not count; no signs give 1, under five values 0."""
    frame = last(by, n)
    up = F.sum((F.col(x) > 0).cast("int")).over(frame)
    down = F.sum((F.col(x) < 0).cast("int")).over(frame)
    part = lambda k: F.when(k > 0, -(k / (up + down)) * F.log2(k / (up + down))).otherwise(0.0)
    return F.when(F.count(x).over(frame) < 5, 0.0).when(up + down == 0, 1.0).otherwise(part(up) + part(down))


def autocorrelation(x: str, before: str, by: WindowSpec, n: int = 30) -> Column:
    """Correlation of a series with itself a row earlier, over n pairs; before: the column of earlier values."""
    return F.coalesce(F.corr(x, before).over(last(by, n)), F.lit(0.0))


def body_efficiency() -> Column:
    return clamp(F.abs(F.col("close") - F.col("open")) / F.greatest(F.abs(F.col("high") - F.col("low")), F.lit(TINY)), 0.0, 1.0)


def slope_score(by: WindowSpec, n: int = 12) -> Column:
    """Change of the close over the frame, against the mean range times the rows."""
    frame = last(by, n)
    ranges = F.sum(F.abs(F.col("high") - F.col("low"))).over(frame)
    return clamp((F.col("close") - F.first("close").over(frame)) / F.greatest(ranges, F.lit(TINY)))


def adx_proxy(by: WindowSpec, n: int = 20) -> Column:
    """Size of the change of the close over the frame, against the sum of the ranges."""
    frame = last(by, n)
    ranges = F.sum(F.abs(F.col("high") - F.col("low"))).over(frame)
    return clamp(F.abs(F.col("close") - F.first("close").over(frame)) / F.greatest(ranges, F.lit(TINY)), 0.0, 1.0)


def ewm_weights(n: int) -> list[float]:
    """Weights of an exponential mean over n values, the newest last; they sum to one."""
    alpha = 2.0 / (n + 1)
    raw = [(1 - alpha) ** (n - 1 - i) for i in range(n)]
    return [w / sum(raw) for w in raw]


def session_score(ts: Column) -> Column:
    """1.0 in the overlap of sessions, 0.8 in the main ones, 0.4 in the Asian one, else 0.2; ends inclusive; UTC."""
    clock = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    between = lambda a, b: (clock >= a * 3600) & (clock <= b * 3600)
    return F.when(between(12, 16), 1.0).when(between(8, 20), 0.8).when(between(0, 8), 0.4).otherwise(0.2)


def in_session(ts: Column) -> Column:
    """Whether a time is in [07:00, 11:00) or [12:00, 16:00) UTC."""
    return F.hour(ts).between(7, 10) | F.hour(ts).between(12, 15)

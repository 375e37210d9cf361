"""Resampling bars by count, and folds along a series that frames cannot express."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def series(*order: str) -> Window:
    return Window.partitionBy("symbol").orderBy(*(order or ("ts",)))


def group_bars(bars: DataFrame, n: int, anchor: str = "start", stamp: str = "first", partial: bool = False) -> DataFrame:
    """Bars of n consecutive bars of a symbol.

    anchor: groups are counted from the first bar ("start") or so that the last bar closes one ("end").
    stamp: a group has the time of its first or its last bar. partial: whether an incomplete group stays.
    """
    by = series()
    place = F.row_number().over(by) - 1
    if anchor == "end":
        whole = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
        place = place + (n - whole % n) % n
    order = F.col("ts")
    grouped = (
        bars.withColumn("g", F.floor(place / n))
        .groupBy("symbol", "g")
        .agg(
            (F.min("ts") if stamp == "first" else F.max("ts")).alias("ts"),
            F.min_by("open", order).alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", order).alias("close"),
            F.sum("volume").alias("volume"),
            F.count(F.lit(1)).alias("n_bars"),
        )
    )
    return (grouped if partial else grouped.where(F.col("n_bars") == n)).drop("g")


def every_kth(bars: DataFrame, k: int) -> DataFrame:
    """Every k-th bar of a symbol, from the first."""
    return bars.withColumn("ord", F.row_number().over(series()) - 1).where(F.col("ord") % k == 0)


def last_gap(bars: DataFrame, minutes: int = 30) -> DataFrame:
    """The latest pair of neighbouring bars of a symbol that are more than so many minutes apart."""
    by = series()
    apart = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(by).cast("timestamp"))) / 60_000_000
    pairs = bars.select("symbol", "ts", F.lag("ts").over(by).alias("before"), F.lag("close").over(by).alias("close_before"), "open", apart.alias("gap_minutes"))
    wide = pairs.where(F.col("gap_minutes") > minutes)
    return wide.groupBy("symbol").agg(F.max_by(F.struct("before", "ts", "close_before", "open", "gap_minutes"), "ts").alias("x")).select("symbol", "x.*")


def folded(bars: DataFrame, periods: tuple[int, ...] = (12, 20, 26)) -> DataFrame:
    """symbol, ts, close, ema_n for each period, and the histogram of MACD (12, 26, 9), null for symbols of fewer than 35 bars.

    All of these recur from the first bar, as sums of what they were and the close. So what a day does to
    them is one linear map, whatever they began with: days are folded apart, their maps, a few numbers
    each, are joined along a symbol, and then each day is folded from what it really begins with.
    """
    wanted = sorted({*periods, 12, 26})
    paces = np.array([2.0 / (n + 1) for n in wanted])
    fast, slow, pace = wanted.index(12), wanted.index(26), 2.0 / (9 + 1)
    size = len(wanted) + 1  # the means, and the signal

    def fold(states: np.ndarray, closes: np.ndarray) -> np.ndarray:
        """All states after each close; states: a row for each beginning, columns as above."""
        out = np.empty((len(closes), *states.shape))
        for i, x in enumerate(closes):
            states = states.copy()
            states[:, :-1] += paces * (x - states[:, :-1])
            states[:, -1] += pace * (states[:, fast] - states[:, slow] - states[:, -1])
            out[i] = states
        return out

    def mapped(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts")
        closes = rows["close"].to_numpy(float)
        ends = fold(np.vstack([np.zeros(size), np.eye(size)]), closes)[-1]
        return pd.DataFrame({"symbol": rows["symbol"].iloc[:1], "day": rows["day"].iloc[:1], "n": [len(rows)], "first": closes[:1], "shift": [ends[0]], "map": [(ends[1:] - ends[0]).ravel()]})

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("day")
        state = np.append(np.full(size - 1, rows["first"].iloc[0]), 0.0)
        starts = []
        for shift, turn in zip(rows["shift"], rows["map"], strict=True):
            starts.append(state)
            state = shift + state @ np.asarray(turn).reshape(size, size)
        return pd.DataFrame({"symbol": rows["symbol"], "day": rows["day"], "start": starts, "whole": rows["n"].sum()})

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts")
        found = fold(np.asarray(rows["start"].iloc[0])[None, :], rows["close"].to_numpy(float))[:, 0]
        out = rows[["symbol", "ts", "close"]].copy()
        for n in periods:
            out[f"ema_{n}"] = found[:, wanted.index(n)]
        histogram = found[:, fast] - found[:, slow] - found[:, -1]
        out["macd_histogram"] = histogram if rows["whole"].iloc[0] >= 35 else np.nan
        return out

    own = bars.select("symbol", "ts", "close", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"))
    maps = own.groupBy("symbol", "day").applyInPandas(mapped, "symbol string, day timestamp_ntz, n long, first double, shift array<double>, map array<double>")
    starts = maps.groupBy("symbol").applyInPandas(joined, "symbol string, day timestamp_ntz, start array<double>, whole long")
    shape = "symbol string, ts timestamp_ntz, close double, " + ", ".join(f"ema_{n} double" for n in periods) + ", macd_histogram double"
    return own.join(starts, ["symbol", "day"]).groupBy("symbol", "day").applyInPandas(run, shape)


def parabolic_sar(bars: DataFrame, step: float = 0.02, most: float = 0.2) -> DataFrame:
    """symbol, ts, sar, trend (1 up, -1 down): the stop-and-reverse line, a fold along each symbol's bars."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts")
        high, low, close = (rows[c].to_numpy(float) for c in ("high", "low", "close"))
        sar, trend = np.empty(len(rows)), np.empty(len(rows), int)
        for i in range(len(rows)):
            if i < 2:
                up = bool(close[min(1, len(rows) - 1)] >= close[0])
                line, extreme, pace = (low[0], high[: i + 1].max(), step) if up else (high[0], low[: i + 1].min(), step)
            else:
                line += pace * (extreme - line)
                line = min(line, low[i - 1], low[i - 2]) if up else max(line, high[i - 1], high[i - 2])
                if (low[i] < line) if up else (high[i] > line):
                    up, line, pace = not up, extreme, step
                    extreme = high[i] if up else low[i]
                elif (high[i] > extreme) if up else (low[i] < extreme):
                    extreme, pace = (high[i] if up else low[i]), min(pace + step, most)
            sar[i], trend[i] = line, 1 if up else -1
        return pd.DataFrame({"symbol": rows["symbol"], "ts": rows["ts"], "sar": sar, "trend": trend})

    return bars.select("symbol", "ts", "high", "low", "close").groupBy("symbol").applyInPandas(run, "symbol string, ts timestamp_ntz, sar double, trend int")


def volume_profile(ticks: DataFrame, bins: int = 100, share: float = 0.7) -> DataFrame:
    """symbol, poc, vah, val: the busiest price bin of a symbol, and the bounds of its value area.

    Prices are counted into equal bins by aggregation; only the at most `bins` sums of a symbol meet in a
    task, where the area grows from the busiest bin (the first on a tie) to the busier neighbour (the
    upper on a tie) until it holds the share.
    """
    price = ticks.select("symbol", ((F.col("bid") + F.col("ask")) / 2).alias("price"), "volume")
    bounds = price.groupBy("symbol").agg(F.min("price").alias("low"), F.max("price").alias("high"))
    width = F.greatest((F.col("high") - F.col("low")) / bins, F.lit(1e-9))
    binned = price.join(bounds, "symbol").withColumn("bin", F.least(F.floor((F.col("price") - F.col("low")) / width), F.lit(bins - 1)))
    sums = binned.groupBy("symbol", "bin").agg(F.sum("volume").alias("volume"), F.first("low").alias("low"), F.first(width).alias("width"))

    def area(rows: pd.DataFrame) -> pd.DataFrame:
        volume = np.zeros(bins)
        volume[rows["bin"].to_numpy(int)] = rows["volume"]
        low, step = rows["low"].iloc[0], rows["width"].iloc[0]
        a = b = int(volume.argmax())
        poc = a
        while volume[a : b + 1].sum() < share * volume.sum():
            up, down = volume[b + 1] if b + 1 < bins else -1.0, volume[a - 1] if a else -1.0
            if up >= down:
                b += 1
            else:
                a -= 1
        middle = lambda k: low + (k + 0.5) * step
        return pd.DataFrame({"symbol": [rows["symbol"].iloc[0]], "poc": [middle(poc)], "vah": [middle(b)], "val": [middle(a)]})

    return sums.groupBy("symbol").applyInPandas(area, "symbol string, poc double, vah double, val double")

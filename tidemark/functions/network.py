"""Inference of a residual network over arrays of features, and what spoke for each answer; in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Slope below zero, what keeps a deviation above zero, bounds and slope of the threshold.
LEAK, EPSILON = 0.01, 1e-5
LOWEST, HIGHEST, BY_DRAWDOWN = 0.45, 0.75, 0.10

_SHAPE = "probability double, threshold double, trade boolean, confidence string, top array<struct<feature:int,z:double,share:double>>"


@dataclass
class Network:
    """layers: (weights, bias) of the input, of pairs of hidden layers, and of the output. mean, deviation: of the features."""

    layers: list[tuple[np.ndarray, np.ndarray]]
    mean: np.ndarray
    deviation: np.ndarray
    threshold: float = 0.55

    def standardized(self, features: np.ndarray) -> np.ndarray:
        return (features - self.mean) / np.where(self.deviation > 0, self.deviation, 1.0)

    def logit(self, x: np.ndarray) -> np.ndarray:
        """Of standardised rows. Two hidden layers make a block, half of which is added to what came in; a hidden layer
        without a partner takes its place. All but the first layer see their input normalised."""
        first, *hidden, last = self.layers
        h = _leaky(x @ first[0] + first[1])
        for i in range(0, len(hidden), 2):
            skip = h
            for w, b in hidden[i : i + 2]:
                h = _leaky(_normal(h) @ w + b)
            if i + 1 < len(hidden):
                h = 0.5 * h + skip
        return (_normal(h) @ last[0] + last[1])[:, 0]

    def slopes(self, x: np.ndarray, step: float = 1e-4) -> np.ndarray:
        """Change of the logit with each feature, by central differences over all rows at once."""
        out = np.empty_like(x)
        for k in range(x.shape[1]):
            up, down = x.copy(), x.copy()
            up[:, k] += step
            down[:, k] -= step
            out[:, k] = (self.logit(up) - self.logit(down)) / (2 * step)
        return out


def _leaky(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x, LEAK * x)


def _normal(h: np.ndarray) -> np.ndarray:
    return (h - h.mean(1, keepdims=True)) / np.sqrt(h.var(1, keepdims=True) + EPSILON)


def explained(spark: SparkSession, network: Network, features: Column, drawdown: Column, most: int = 5) -> Column:
    """struct(probability, threshold, trade, confidence, top) of an array of features.

    Features beyond the network's are left aside, missing ones and nulls count as zero; a null array has a
    null answer. The threshold rises with the drawdown (null: none). confidence goes by the distance from
    it. top: the features farthest from their mean, with that distance in deviations and their share in
    the logit, slope times distance; of equals the lower number first. The weights are broadcast once.
    """
    shared = spark.sparkContext.broadcast(network)

    @F.arrow_udf(_SHAPE)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        net = shared.value
        size = len(net.mean)
        for rows, falls in batches:
            sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
            flat = pc.fill_null(rows.flatten().cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            x = np.zeros((len(rows), size))
            row = np.repeat(np.arange(len(rows)), sizes)
            x[row[place < size], place[place < size]] = flat[place < size]
            x = net.standardized(x)
            logit, shares = net.logit(x), net.slopes(x) * x
            chance = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
            fall = pc.fill_null(falls.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
            bar = np.clip(net.threshold + BY_DRAWDOWN * fall, LOWEST, HIGHEST)
            margin = np.abs(chance - bar)
            sure = np.where(margin > 0.15, "high", np.where(margin > 0.07, "medium", "low"))
            top = np.argsort(-np.abs(x), axis=1, kind="stable")[:, :most]
            parts = [pa.array(top.ravel().astype(np.int32)), *[pa.array(np.take_along_axis(v, top, 1).ravel()) for v in (x, shares)]]
            tops = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * top.shape[1], pa.int32()), pa.StructArray.from_arrays(parts, ["feature", "z", "share"]))
            whole = [pa.array(chance), pa.array(bar), pa.array(chance >= bar), pa.array(sure.tolist(), pa.string()), tops]
            found = pa.StructArray.from_arrays(whole, ["probability", "threshold", "trade", "confidence", "top"])
            yield pc.if_else(rows.is_valid(), found, pa.scalar(None, found.type))

    return run(features, drawdown)

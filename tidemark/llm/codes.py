"""Product codes of vectors: each part of a vector becomes the number of its nearest codebook entry.

In every round the codebooks are broadcast as kd-trees; each task searches them by branch and bound for a
batch of parts at a time and adds its parts up by entry, and Spark adds up what the tasks found. All
numbers are integers, so results are the same however the rows are dealt out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

#: Entries in a leaf of a tree, and rows that are searched at a time.
LEAF, BATCH = 8, 8192

#: Components as integers lie within this; sums of squares of 4096 of them fit into 64 bits.
MOST = 1 << 24

#: Sums that a row between the tasks holds.
WIDE = 16


@dataclass
class _Node:
    """low, high: the box around the entries below. A leaf has entries and a number, another node two halves and their border."""

    low: np.ndarray
    high: np.ndarray
    entries: np.ndarray | None = None
    number: int = -1
    axis: int = 0
    border: int = 0
    halves: tuple[_Node, ...] = ()


class KdTree:
    """The nearest of some integer points, with the squared distance; of several at one distance, that of lowest index."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        self.points, self.leaf, self.leaves = points, leaf, 0
        self.root = self._node(np.arange(len(points)))

    def _node(self, entries: np.ndarray) -> _Node:
        own = self.points[entries]
        node = _Node(own.min(0), own.max(0))
        axis = int(np.argmax(node.high - node.low))
        if len(entries) <= self.leaf or node.high[axis] == node.low[axis]:
            node.entries, node.number = entries, self.leaves
            self.leaves += 1
            return node
        values = np.sort(own[:, axis])
        border = values[len(values) // 2]
        if border == values[0]:  # neither half may be empty
            border = values[np.searchsorted(values, border, "right")]
        below = own[:, axis] < border
        node.axis, node.border = axis, int(border)
        node.halves = (self._node(entries[below]), self._node(entries[~below]))
        return node

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance for each query. Every query goes down to the leaf that it falls into, then into
        all branches whose box is not farther than what it has; at an equal bound an entry of lower index may wait."""
        best = np.full(len(queries), np.iinfo(np.int64).max)
        index = np.zeros(len(queries), np.int64)
        home = np.full(len(queries), -1)

        def look(node: _Node, rows: np.ndarray) -> None:
            apart = queries[rows, None, :] - self.points[node.entries]
            found = np.einsum("ijk,ijk->ij", apart, apart)
            at = found.argmin(1)  # the first of equals; entries ascend
            far, entry = found[np.arange(len(rows)), at], node.entries[at]
            better = (far < best[rows]) | ((far == best[rows]) & (entry < index[rows]))
            best[rows[better]], index[rows[better]] = far[better], entry[better]

        def down(node: _Node, rows: np.ndarray) -> None:
            if len(rows) and node.halves:
                below = queries[rows, node.axis] < node.border
                down(node.halves[0], rows[below])
                down(node.halves[1], rows[~below])
            elif len(rows):
                home[rows] = node.number
                look(node, rows)

        def sweep(node: _Node, rows: np.ndarray) -> None:
            own = queries[rows]
            gap = np.maximum(node.low - own, 0) + np.maximum(own - node.high, 0)
            rows = rows[(np.einsum("ij,ij->i", gap, gap) <= best[rows]) & (home[rows] != node.number)]
            if len(rows) and node.halves:
                sweep(node.halves[0], rows)
                sweep(node.halves[1], rows)
            elif len(rows):
                look(node, rows)

        everything = np.arange(len(queries))
        down(self.root, everything)
        sweep(self.root, everything)
        return index, best


@dataclass
class Codebooks:
    """books: for each part the integer entries, as an array of entries by places. scale: integers to a unit."""

    books: list[np.ndarray]
    scale: int

    @property
    def size(self) -> int:
        return sum(b.shape[1] for b in self.books)

    def digest(self) -> str:
        """SHA-256 of all components as decimal numbers, by part, entry and place."""
        return hashlib.sha256(",".join(str(x) for b in self.books for x in b.ravel().tolist()).encode()).hexdigest()


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _whole(vectors: pa.Array, size: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows can be coded, and their components as integers."""
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    values = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    if (lengths != size).any():
        fits = lengths == size
        values = values[np.repeat(fits, lengths)]
    else:
        fits = np.ones(len(lengths), bool)
    values = np.floor(values * scale).reshape(-1, size)
    small = (np.abs(values) < MOST).all(1)
    fits[np.flatnonzero(fits)] = small
    return fits, values[small].astype(np.int64)


def _searched(vectors: pa.Array, trees: list[KdTree], size: int, scale: int) -> Iterator[tuple[int, int, np.ndarray, list]]:
    """For some rows at a time: from, to, which can be coded, and of each part components, entries and distances."""
    width = size // len(trees)
    for at in range(0, len(vectors), BATCH):
        part = vectors.slice(at, BATCH)
        fits, values = _whole(part, size, scale)
        own = [np.ascontiguousarray(values[:, k * width : (k + 1) * width]) for k in range(len(trees))]
        yield at, at + len(part), fits, [(x, *tree.nearest(x)) for x, tree in zip(own, trees, strict=True)]


def _sums(trees: Callable[[], list[KdTree]], size: int, scale: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = trees()
        width, many = size // len(own), len(own[0].points)
        sums, counts = np.zeros((len(own), many, width), np.int64), np.zeros((len(own), many), np.int64)
        for batch in batches:
            for _, _, _, found in _searched(batch.column(0), own, size, scale):
                for k, (values, index, _) in enumerate(found):
                    order = np.argsort(index, kind="stable")
                    used, first = np.unique(index[order], return_index=True)
                    if len(used):
                        sums[k, used] += np.add.reduceat(values[order], first)
                        counts[k] += np.bincount(index, minlength=many)
        k, entry = np.nonzero(counts)
        for at in range(0, width, WIDE):
            own_sums = sums[k, entry, at : at + WIDE]
            padded = np.zeros((len(k), WIDE), np.int64)
            padded[:, : own_sums.shape[1]] = own_sums
            columns = [k, entry, np.full(len(k), at), counts[k, entry], *padded.T]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), pa.int64()) for c in columns], names=["part", "entry", "place", "n", *[f"s{i}" for i in range(WIDE)]])

    return run


def fitted(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> Codebooks | None:
    """Codebooks out of the usable rows of vectors (vec_id, embedding); None if there is none.

    The first row by vec_id that has components sets their number, which `parts` must divide. The entries are
    at first the parts of the rows of smallest vec_id (repeated rows count each, rows without vec_id don't
    begin a codebook); in each round every entry becomes the mean, rounded down, of the parts nearest to it.
    Only sums by entry reach the driver: parts * entries rows of a part's components, whatever the input.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding").where(usable(F.col("embedding")) & (F.size("embedding") > 0))
    first = [r.embedding for r in rows.where("vec_id IS NOT NULL").orderBy("vec_id", "embedding").limit(entries).collect()]
    if not first:
        return None
    size = len(first[0])
    if size % parts:
        raise ValueError(f"{size} components cannot be cut into {parts} equal parts")
    _, start = _whole(pa.array(first, pa.list_(pa.float64())), size, scale)
    width = size // parts
    if not len(start):
        return None
    books = [np.ascontiguousarray(start[:, k * width : (k + 1) * width]) for k in range(parts)]
    names = [f"s{i}" for i in range(WIDE)]
    shape = ", ".join(f"{c} long" for c in ("part", "entry", "place", "n", *names))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast([KdTree(b) for b in books])
        found = rows.select("embedding").mapInArrow(_sums(lambda shared=shared: shared.value, size, scale), shape)
        total = found.groupBy("part", "entry", "place").agg(*[F.sum(c).alias(c) for c in ("n", *names)]).collect()
        books = [b.copy() for b in books]
        for r in total:
            have = min(WIDE, width - r.place)
            books[r.part][r.entry, r.place : r.place + have] = np.array([r[c] for c in names[:have]]) // r.n
        shared.unpersist()
    return Codebooks(books, scale)


def coded(vectors: DataFrame, books: Codebooks | None) -> DataFrame:
    """The usable rows of vectors, with code (array of int, an entry for each part) and error (squared distance, in
    integer components, summed over the parts) in place of columns of these names.

    Rows of another number of components than the codebooks', or with one too large to be squared, have neither.
    """
    others = [F.col(f"`{c}`") for c in vectors.columns if c not in ("code", "error")]
    rows = vectors.where(usable(F.col("embedding"))).select(F.struct(*others).alias("row"), "embedding")
    if books is None:
        found = rows.select("row", F.lit(None).cast("array<int>").alias("code"), F.lit(None).cast("long").alias("error"))
        return found.select("row.*", "code", "error")
    size, scale = books.size, books.scale
    shared = vectors.sparkSession.sparkContext.broadcast([KdTree(b) for b in books.books])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            for at, to, fits, found in _searched(batch.column(1), trees, size, scale):
                code = np.zeros((len(fits), len(trees)), np.int32)
                code[fits] = np.stack([index for _, index, _ in found], 1)
                error = np.zeros(len(fits), np.int64)
                error[fits] = sum(far for _, _, far in found)
                gone = pa.array(~fits)
                codes = pa.FixedSizeListArray.from_arrays(pa.array(code.ravel()), len(trees)).cast(pa.list_(pa.int32()))
                columns = [batch.column(0).slice(at, to - at), pc.if_else(gone, None, codes), pc.if_else(gone, None, pa.array(error))]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "code", "error"])

    schema = StructType([*rows.select("row").schema, StructField("code", ArrayType(IntegerType())), StructField("error", LongType())])
    found = rows.mapInArrow(run, schema)
    return found.select("row.*", "code", "error")


def decoded(code: Column, books: Codebooks) -> Column:
    """The vector that a code stands for: the middle of each integer component's interval."""
    entry = lambda book: F.array(*[F.array(*[F.lit((x + 0.5) / books.scale) for x in e]) for e in book.tolist()])
    return F.flatten(F.array(*[F.element_at(entry(b), code[k] + 1) for k, b in enumerate(books.books)]))

"""Vector best-fit packing of documents into training sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written
from tidemark.llm.tokens import WordEncoder, encoded, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, length: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, as an array, if asked for) of every piece of every document.

    A document is its ids and then end_id; only one longer than `length` is cut, into pieces of that
    length, of which the last may be shorter. A null or empty text is the end id alone.
    """
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, found in encoded(batches, encoder(WordEncoder, tokenizer)):
            rows = []
            for key, ids in zip(keys, found, strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    row = (key, k, at // 4, len(part) // 4, zlib.crc32(part))
                    rows.append(row + (np.frombuffer(part, "<u4").astype(np.int32),) * with_ids)
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


def best_fit(lengths: np.ndarray, capacity: tuple[float, float, float], weights: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each item and its offset there; lengths in falling order.

    A bin has what is left of three capacities: tokens, documents and attention cost (the sum of
    squared lengths). An item goes where all three hold it and the weighted norm of what would be
    left, in shares of the capacities, is least; of equal bins to the oldest; else to a new bin.
    """
    n, cap, weight = len(lengths), np.array(capacity, float), np.array(weights, float)
    left, used = np.zeros((3, n)), np.zeros(n, np.int64)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    live, made = np.zeros(0, np.int64), 0
    smallest = np.minimum.accumulate(lengths[::-1])[::-1]
    for i, tokens in enumerate(lengths):
        need = np.array([tokens, 1.0, float(tokens) ** 2])
        if i % 256 == 0:  # bins that can hold nothing that is still to come
            live = live[(left[0, live] >= smallest[-1]) & (left[1, live] >= 1)]
        rest = left[:, live] - need[:, None]
        fits = (rest >= 0).all(axis=0)
        if fits.any():
            norm = (weight[:, None] * (rest / cap[:, None]) ** 2).sum(axis=0)
            at = live[np.argmin(np.where(fits, norm, np.inf))]
        else:
            at, made = made, made + 1
            left[:, at] = cap
            live = np.append(live, at)
        bins[i], offsets[i] = at, used[at]
        left[:, at] -= need
        used[at] += tokens
    return bins, offsets


def pack(
    parts: DataFrame,
    length: int = 4096,
    most_documents: int | None = None,
    most_attention: float | None = None,
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01),
    per_shard: int = 20_000,
) -> DataFrame:
    """parts with sequence_id and offset.

    parts: doc_id, piece, length (1 to `length`) and any other columns, which stay but for ones of the new names. Capacities of a
    sequence: `length` tokens, most_documents pieces (none given: as many as tokens, which never
    binds) and most_attention (none given: length squared, which never binds). Items are dealt by a
    hash into shards of about per_shard, so no shard grows with the input or with one key; within a
    shard the longest go first. Equal lengths are ordered by doc_id and piece. Every shard may leave
    one sequence that another could have filled. An empty table gives no rows.
    """
    parts = parts.drop("sequence_id", "offset")
    shard = "shard" + "_" * max([0, *map(len, parts.columns)])  # longer than any name that is there
    capacity = (length, most_documents or length, most_attention or float(length) ** 2)
    number = max(1, -(-parts.count() // per_shard))

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True])
        bins, offsets = best_fit(rows["length"].to_numpy(), capacity, weights)
        return rows.drop(columns=shard).assign(sequence_id=bins * number + key[0], offset=offsets)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    return (
        parts.withColumn(shard, F.pmod(F.xxhash64("doc_id", "piece"), F.lit(number)))
        .groupBy(shard)
        .applyInPandas(fill, f"{schema}, sequence_id long, offset long")
    )


def packed(docs: DataFrame, tokenizer: str, length: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: docs cut into pieces and packed."""
    return pack(written(pieces(docs, tokenizer, length, end_id), "pieces"), length)

"""A content-addressed store of token ids: chunks, recipes and a Merkle manifest, as Parquet tables.

chunks: digest, ids (binary, little-endian, two or four bytes an id) - every different chunk once.
recipes: part, doc_id, n_tokens, chunks (digest and n, in order), root - files in ascending doc_id order.
manifest: part, first_doc_id, n_docs, n_tokens, root - one row for each part of the recipes.
top: parts, root - one row, over the manifest.

A recipe's root is a hash of its doc_id, length and chunks; a part's of its recipes' roots in order; the
top's of the parts' roots. Reading works all of them out again from the recipes and raises an error
where one differs, so no chunk, recipe or part can be changed, moved, dropped or added unseen.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import fresh_path, remove, shuffles_removed, written
from tidemark.llm.tokens import BlankEncoder, encoded, encoder

#: Bytes of a chunk's digest.
DIGEST = 16


def cuts(streams: list[np.ndarray], least: int, mask: int, most: int, window: int = 16) -> list[list[int]]:
    """Ends of the chunks of each id stream.

    A rolling hash covers the last `window` ids, a power of two; a chunk ends where its bits under mask are zero, after
    `least` ids at least and `most` at most. So equal passages are cut alike wherever they stand. As
    least is not below window, the streams can be hashed in one go: no hash that counts spans two.
    """
    if least < window:
        raise ValueError("least must not be below window")
    ids = np.concatenate(streams) if streams else np.zeros(0, np.uint32)
    mixed = (ids.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    mixed ^= mixed >> np.uint32(15)
    rolling, span = mixed, 1  # the sum over the last `span` ids, doubled with each id of age
    while span < window and span < len(ids):
        rolling = np.concatenate([rolling[:span], rolling[span:] + (rolling[:-span] << np.uint32(span))])
        span *= 2
    marks = np.flatnonzero((rolling >> np.uint32(16)) & np.uint32(mask) == 0) + 1
    found, at = [], 0
    for stream in streams:
        n, ends, start = len(stream), [], 0
        low, high = np.searchsorted(marks, (at + 1, at + n))
        for mark in (marks[low:high] - at).tolist():
            while mark - start > most:
                start += most
                ends.append(start)
            if mark - start >= least:
                start = mark
                ends.append(start)
        while n - start > most:
            start += most
            ends.append(start)
        found.append([*ends, n] if n else [])
        at += n
    return found


def chunk_digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd last node goes up as it is; no leaves give the hash of nothing."""
    level = leaves or [b""]
    while len(level) > 1:
        level = [chunk_digest(b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return chunk_digest(level[0])


def _multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of reflected polynomials modulo the CRC-32 polynomial, element by element."""
    out, b = np.zeros_like(b), b.copy()
    for bit in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(bit) & np.uint32(1), b, np.uint32(0))
        b = np.where(b & np.uint32(1), b >> np.uint32(1) ^ np.uint32(0xEDB88320), b >> np.uint32(1))
    return out


def shifted_crc(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What each block's CRC-32 adds to the CRC-32 of a stream in which so many bytes come after it.

    The XOR of this over the blocks of a stream is the stream's CRC-32.
    """
    crc, after = crc.astype(np.uint32), after.astype(np.uint64)
    power = np.full(1, 1 << 23, np.uint32)  # x to the 8th: one byte
    while after.any():
        odd = np.flatnonzero(after & np.uint64(1))
        crc[odd] = _multiply(np.broadcast_to(power, odd.shape), crc[odd])
        power, after = _multiply(power, power), after >> np.uint64(1)
    return crc


class TokenStore:
    """Writes and reads a store in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str | None = None, wide: bool = False) -> None:
        """wide: ids take four bytes, else two, and must then be below 65,536."""
        self.spark, self.path, self.wide = spark, path or fresh_path(spark, "token-store"), wide

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def write(self, docs: DataFrame, tokenizer: str, end_id: int = 0, least: int = 64, mask: int = 0xFF, most: int = 2048, per_part: int = 20_000) -> TokenStore:
        """Encodes docs (doc_id long, unique; text) and writes the three tables.

        A null or empty text is the end id alone. Chunks do not span documents. Ids are made once and dealt by digest once; a chunk that
        many documents share leaves each task once. A row without a doc_id is left out, as nothing could read it
        back; further columns are not stored; an empty table gives an empty store.
        """
        code, dtype = ("I", "<u4") if self.wide else ("H", "<u2")
        end = np.array([end_id], dtype).tobytes()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[bytes] = set()
            for keys, found in encoded(batches, encoder(BlankEncoder, tokenizer, code), keep=True):
                names, sizes, names_at, new, new_at = [], [], [0], [], [0]
                streams = [ids + end for ids in found]
                for ids, stops in zip(streams, cuts([np.frombuffer(x, dtype) for x in streams], least, mask, most), strict=True):
                    start = 0
                    for stop in stops:
                        data = ids[len(end) * start : len(end) * stop]
                        name = chunk_digest(data)
                        names.append(name)
                        sizes.append(stop - start)
                        if name not in seen:
                            seen.add(name)
                            new.append((name, data))
                        start = stop
                    names_at.append(len(names))
                    new_at.append(len(new))
                listed = pa.StructArray.from_arrays([pa.array(names, pa.binary()), pa.array(sizes, pa.int64())], ["digest", "n"])
                own = pa.StructArray.from_arrays([pa.array([x[i] for x in new], pa.binary()) for i in (0, 1)], ["digest", "ids"])
                columns = [pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(names_at, pa.int32()), listed), pa.ListArray.from_arrays(pa.array(new_at, pa.int32()), own)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "chunks", "new"])

        texts = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"))
        shape = "doc_id long, chunks array<struct<digest:binary,n:long>>, new array<struct<digest:binary,ids:binary>>"
        raw = written(texts.mapInArrow(run, shape), "raw-chunks", "zstd")
        chunks = raw.select(F.explode("new").alias("x")).select("x.digest", "x.ids").repartition("digest")
        same = Window.partitionBy("digest").orderBy("digest")
        with shuffles_removed(self.spark):
            chunks.withColumn("k", F.row_number().over(same)).where("k = 1").drop("k").write.option("compression", "zstd").parquet(f"{self.path}/chunks")
        recipes = raw.select("doc_id", self._length().alias("n_tokens"), "chunks", self._leaf().alias("root"))
        parts = max(1, -(-raw.count() // per_part))
        recipes = recipes.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
        with shuffles_removed(self.spark):
            recipes.select(F.spark_partition_id().alias("part"), "*").write.parquet(f"{self.path}/recipes")
        self._manifest().write.parquet(f"{self.path}/manifest")
        self._top().write.parquet(f"{self.path}/top")
        remove(self.spark, raw)
        return self

    @staticmethod
    def _length() -> Column:
        """Ids of a recipe, by its chunks."""
        return F.aggregate("chunks", F.lit(0).cast("long"), lambda a, x: a + x["n"])

    @classmethod
    def _leaf(cls) -> Column:
        """A recipe's root, from what the recipe says."""
        listed = F.array_join(F.transform("chunks", lambda x: F.concat_ws(":", F.hex(x["digest"]), x["n"].cast("string"))), ",")
        return F.unhex(F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), cls._length().cast("string"), listed).cast("binary"), 256))

    def _manifest(self) -> DataFrame:
        """The manifest that the recipes give."""

        def root(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("doc_id")
            return pd.DataFrame({"part": rows["part"][:1], "first_doc_id": rows["doc_id"].min(), "n_docs": len(rows), "n_tokens": rows["n_tokens"].sum(), "root": [merkle_root(list(rows["root"]))]})

        recipes = self.table("recipes").select("part", "doc_id", self._length().alias("n_tokens"), self._leaf().alias("root"))
        return recipes.groupBy("part").applyInPandas(root, "part int, first_doc_id long, n_docs long, n_tokens long, root binary")

    def _top(self) -> DataFrame:
        """parts, root over the manifest: 4096 parts to a node, then the nodes; a part has thousands of documents."""

        def root(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("part")
            return pd.DataFrame({"part": [int(rows["part"].iloc[0])], "parts": [int(rows["parts"].sum())], "root": [merkle_root(list(rows["root"]))]})

        level = self.table("manifest").select("part", F.lit(1).cast("long").alias("parts"), "root")
        for group in (F.floor(F.col("part") / 4096), F.lit(0)):
            level = level.groupBy(group.cast("long").alias("g")).applyInPandas(root, "part int, parts long, root binary")
        return level.select("parts", "root")

    def checked_manifest(self) -> DataFrame:
        """The manifest; a row raises an error if the recipes, or the top's root, say otherwise."""
        tops = [self.table("top").first(), self._top().first()]
        if tops[0] != tops[1]:
            raise ValueError("the manifest does not match its root")
        told = F.struct("first_doc_id", "n_docs", "n_tokens", "root")
        now = self._manifest().select("part", told.alias("now"))
        both = self.table("manifest").select("part", told.alias("told")).join(now, "part", "full")
        sound = F.when(F.col("told") == F.col("now"), F.col("part")).otherwise(F.raise_error("the recipes of a part do not match the manifest").cast("int"))
        return both.select(sound.alias("part"), "told.*")

    def starts(self) -> DataFrame:
        """doc_id, start: ids of all documents of smaller doc_id. Sums run inside parts; only their totals meet."""
        recipes = self.table("recipes").select("part", "doc_id", "n_tokens")
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        totals = self.checked_manifest().select("part", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("before"))
        inside = Window.partitionBy("part").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
        return (
            recipes.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
            .join(totals, "part")
            .select("doc_id", (F.col("before") + F.col("inside")).alias("start"))
        )

    def read_ids(self, doc_ids: DataFrame | None = None) -> DataFrame:
        """doc_id, ids (binary, as stored) of all documents, or of those in doc_ids, put together from their recipes."""
        recipes = self.table("recipes")
        if doc_ids is not None:
            recipes = recipes.join(doc_ids.select("doc_id"), "doc_id", "left_semi")
        rows = recipes.select("doc_id", F.posexplode("chunks").alias("pos", "chunk")).select("doc_id", "pos", "chunk.digest")
        listed = F.sort_array(F.collect_list(F.struct("pos", "ids")))
        put = F.unhex(F.array_join(F.transform(listed, lambda x: F.hex(x["ids"])), ""))
        return rows.join(self.table("chunks"), "digest").groupBy("doc_id").agg(put.alias("ids"))

    def read_back(self) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32 (over four-byte ids) of every document, from the files alone.

        Every chunk's ids are read, held against their digest, and summed up by length and CRC-32; the
        sums of a document's chunks are then combined, so no ids are shuffled. A chunk that is missing,
        or does not match its digest or its recipe, raises an error, and so does a recipe, part or
        manifest that does not match its root. An empty store gives no rows.
        """
        dtype = "<u4" if self.wide else "<u2"

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names, data = batch.column("digest").to_pylist(), batch.column("ids").to_pylist()
                if any(chunk_digest(x) != name for x, name in zip(data, names, strict=True)):
                    raise ValueError("a chunk does not match its digest")
                ids = [np.frombuffer(x, dtype) for x in data]
                sums = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([len(x) for x in ids], pa.int64()), sums], names=["digest", "size", "crc"])

        def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                part = shifted_crc(batch.column("crc").to_numpy(), 4 * batch.column("after").to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n"), pa.array(part.astype(np.int64))], names=["doc_id", "n", "crc"])

        sums = self.table("chunks").mapInArrow(check, "digest binary, size long, crc long")
        same = (F.col("root") == self._leaf()) & (F.col("n_tokens") == self._length())
        whole = F.when(same, F.col("n_tokens")).otherwise(F.raise_error("a recipe does not match its root").cast("long"))
        rows = self.table("recipes").select("doc_id", whole.alias("n_tokens"), F.explode(self._ends()).alias("x"))
        rows = rows.select("doc_id", "x.digest", "x.n", (F.col("n_tokens") - F.col("x.to")).alias("after")).join(sums, "digest", "left")
        sound = F.when(F.col("size") == F.col("n"), F.col("n")).otherwise(F.raise_error("a chunk is missing or has another length").cast("long"))
        rows = rows.select("doc_id", sound.alias("n"), "crc", "after")
        found = rows.mapInArrow(shift, "doc_id long, n long, crc long").groupBy("doc_id").agg(F.sum("n").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"))
        return found.join(self.starts(), "doc_id").select("doc_id", "start", "n_tokens", "ids_crc32")

    @staticmethod
    def _ends() -> Column:
        """chunks of a recipe with the place where each ends in its document."""
        ends = F.aggregate("chunks", F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x["n"])))
        return F.transform(F.arrays_zip("chunks", F.slice(ends, 2, F.size("chunks")).alias("to")), lambda x: F.struct(x["chunks"]["digest"].alias("digest"), x["chunks"]["n"].alias("n"), x["to"].alias("to")))

    def verify(self) -> DataFrame:
        """part, ok: whether each part's recipes give the root that the manifest holds; parts of either side."""
        now = self._manifest().select("part", F.col("root").alias("now"))
        return self.table("manifest").join(now, "part", "full").select("part", F.coalesce(F.col("root") == F.col("now"), F.lit(False)).alias("ok"))

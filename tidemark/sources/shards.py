"""Token shards as a data source: binary files of sequences of ids of one length, and a manifest.

A file has a magic of four bytes, the numbers of chunks, of ids a chunk less one, and of the vocabulary as
32-bit integers, and then the ids as 16-bit integers, all little-endian. Tasks write files of their own into
a temporary folder; only the commit gives them their names and then writes the manifest, so a reader never
sees a part of a write, and a task that is tried again leaves nothing behind.
"""

from __future__ import annotations

import json
import struct
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

# The file format.
MAGIC = b"VST1"
HEADER = "<III"
MANIFEST = "manifest.json"

#: Chunks of a file that are read at a time.
BLOCK = 4096


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def manifest(path: str) -> dict:
    """What the manifest below a folder says; without one the folder holds no shards."""
    store, root = opened(path)
    name = f"{root}/{MANIFEST}"
    if store.get_file_info(name).type != fs.FileType.File:
        raise FileNotFoundError(f"no {MANIFEST} in {path}")
    with store.open_input_stream(name) as file:
        return json.loads(file.read())


def _header(raw: bytes, size: int, name: str) -> tuple[int, int, int]:
    if raw[:4] != MAGIC:
        raise ValueError(f"{name} is no token shard: it begins with {raw[:4]!r}")
    if len(raw) < 16:
        raise ValueError(f"{name} ends in its header")
    chunks, length, vocabulary = struct.unpack(HEADER, raw[4:16])
    if size != 16 + 2 * chunks * (length + 1):
        raise ValueError(f"{name} has {size} bytes, which its header does not")
    return chunks, length, vocabulary


@dataclass
class _File(InputPartition):
    name: str


class _Reader(DataSourceReader):
    def __init__(self, path: str, split: str | None, headers: bool) -> None:
        self.path, self.split, self.headers = path, split, headers

    def partitions(self) -> list[_File]:
        splits = manifest(self.path)["splits"]
        return [_File(name) for split in ([self.split] if self.split else sorted(splits)) for name in splits.get(split, [])] or [_File("")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        store, root = opened(self.path)
        name = f"{root}/{partition.name}"
        if self.headers:
            try:
                size = store.get_file_info(name).size or 0
                with store.open_input_stream(name) as file:
                    found, error = _header(file.read(16), size, partition.name), None
            except (OSError, ValueError) as wrong:
                found, error = (None, None, None), str(wrong)
            columns = [[partition.name], [found[0]], [found[1]], [found[2]], [error]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), *[pa.int64()] * 3, pa.string()), strict=True)], names=["shard", "n_chunks", "length", "vocabulary", "error"])
            return
        size = store.get_file_info(name).size
        with store.open_input_stream(name) as file:
            chunks, length, _ = _header(file.read(16), size, partition.name)
            for at in range(0, chunks, BLOCK):
                many = min(BLOCK, chunks - at)
                ids = np.frombuffer(file.read(2 * many * (length + 1)), "<u2").reshape(many, length + 1).astype(np.int32)
                offsets = pa.array(np.arange(0, many * length + 1, length, dtype=np.int32))
                x, y = (pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(part).ravel())) for part in (ids[:, :-1], ids[:, 1:]))
                yield pa.RecordBatch.from_arrays([pa.array([partition.name] * many), pa.array(np.arange(at, at + many)), x, y], names=["shard", "chunk", "x", "y"])


@dataclass
class _Written(WriterCommitMessage):
    """Files of a task in their order: first chunk number and temporary name."""

    files: list[tuple[int, str]] = field(default_factory=list)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite
        self.split, self.per_shard = options.get("split", "train"), int(options.get("chunks_per_shard", 20_000))
        self.length, self.vocabulary = int(options["length"]), int(options["vocabulary"])
        self.told = {"tokenizer_fingerprint": options.get("fingerprint", ""), "seq_len": self.length, "stride": int(options.get("stride", self.length)), "vocab_size": self.vocabulary}
        if self.vocabulary > 1 << 16:
            raise ValueError("ids of token shards have 16 bits")
        self.temporary = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, root = opened(self.path)
        store.create_dir(f"{root}/{self.temporary}", recursive=True)
        done, parts, held, first = _Written(), [], 0, 0

        def flush() -> None:
            name = f"{self.temporary}/{uuid.uuid4().hex}"
            with store.open_output_stream(f"{root}/{name}") as file:
                file.write(MAGIC + struct.pack(HEADER, held, self.length, self.vocabulary))
                for part in parts:
                    file.write(part.tobytes())
            done.files.append((first, name))

        for batch in iterator:
            ids, numbers = batch.column("ids"), batch.column("chunk")
            flat = ids.flatten().to_numpy()
            if len(flat) != len(ids) * (self.length + 1) or (np.diff(ids.offsets.to_numpy()) != self.length + 1).any():
                raise ValueError(f"a chunk has not {self.length + 1} ids")
            if len(flat) and (flat.min() < 0 or flat.max() >= self.vocabulary):
                raise ValueError(f"an id is not between 0 and {self.vocabulary - 1}")
            rows, at = flat.astype("<u2").reshape(len(ids), self.length + 1), 0
            while at < len(rows):
                take = min(self.per_shard - held, len(rows) - at)
                first = first if held else numbers[at].as_py()
                parts.append(rows[at : at + take])
                held, at = held + take, at + take
                if held == self.per_shard:
                    flush()
                    parts, held = [], 0
        if held:
            flush()
        return done

    def commit(self, messages: list[_Written | None]) -> None:
        store, root = opened(self.path)
        store.create_dir(root, recursive=True)
        before = {} if self.overwrite else self._splits()
        begin = len(before.get(self.split, []))
        names = []
        for i, (_, name) in enumerate(sorted(f for m in messages if m for f in m.files)):
            names.append(f"{self.split}_{begin + i + 1:05d}.bin")
            store.move(f"{root}/{name}", f"{root}/{names[-1]}")
        told = {"version": 1, **self.told, "created_at": int(time.time()), "splits": before | {self.split: before.get(self.split, []) + names}}
        with store.open_output_stream(f"{root}/{MANIFEST}") as file:
            file.write(json.dumps(told, indent=2).encode())
        if self.overwrite:  # what an earlier manifest named and this one does not
            listed = {n for s in told["splits"].values() for n in s}
            for info in store.get_file_info(fs.FileSelector(root)):
                if info.base_name.endswith(".bin") and info.base_name not in listed:
                    store.delete_file(info.path)
        self._clear(store, root)

    def _splits(self) -> dict[str, list[str]]:
        try:
            held = manifest(self.path)
        except FileNotFoundError:
            return {}
        if (held["seq_len"], held["tokenizer_fingerprint"]) != (self.length, self.told["tokenizer_fingerprint"]):
            raise ValueError("the shards that are there have another length or tokenizer")
        return held["splits"]

    def abort(self, messages: list[_Written | None]) -> None:
        store, root = opened(self.path)
        self._clear(store, root)

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(f"{root}/{self.temporary}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.temporary}")


class TokenShards(DataSource):
    """spark.read.format("token_shards"): shard, chunk, x, y of the files that a manifest names; option split takes one
    split, option headers gives shard, n_chunks, length, vocabulary, error instead. Writing: see write_shards."""

    @classmethod
    def name(cls) -> str:
        return "token_shards"

    @property
    def _headers(self) -> bool:
        return self.options.get("headers", "false").lower() == "true"

    def schema(self) -> str:
        if self._headers:
            return "shard string, n_chunks long, length long, vocabulary long, error string"
        return "shard string, chunk long, x array<int>, y array<int>"

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"], self.options.get("split"), self._headers)

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options), overwrite)


def write_shards(chunks: DataFrame, path: str, codec, length: int, stride: int, split: str = "train", per_shard: int = 20_000, mode: str = "append", dealt: bool = False) -> None:
    """Chunks (chunk, ids of length + 1) as shards in the order of chunk; append adds files to the split, overwrite leaves only these.

    dealt: each `per_shard` chunks that follow one another are in one task already, as stream_chunks gives them.
    """
    chunks.sparkSession.dataSource.register(TokenShards)
    options = {"split": split, "length": length, "stride": stride, "vocabulary": codec.size, "fingerprint": codec.fingerprint(), "chunks_per_shard": per_shard}
    rows = chunks.select(F.col("chunk").cast("long").alias("chunk"), "ids")
    ordered = (rows if dealt else rows.repartitionByRange("chunk")).sortWithinPartitions("chunk")
    ordered.write.format("token_shards").options(**options).mode(mode).save(path)


def read_shards(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """shard, chunk (its number in the shard), x, y: the ids of a chunk but the last, and but the first."""
    spark.dataSource.register(TokenShards)
    reader = spark.read.format("token_shards")
    return (reader.option("split", split) if split else reader).load(path)


def verified(spark: SparkSession, path: str, codec, length: int | None = None) -> DataFrame:
    """shard, n_chunks, ok, reason of every shard that the manifest names, from the files' headers alone.

    Reasons: the manifest is of another tokenizer or length, a file is not there or no shard or cut, or its
    header says otherwise than the manifest. A folder without a manifest raises an error.
    """
    spark.dataSource.register(TokenShards)
    told = manifest(path)
    rows = spark.read.format("token_shards").option("headers", "true").load(path)
    reason = F.coalesce(
        F.when(F.lit(told["tokenizer_fingerprint"] != codec.fingerprint()), "another tokenizer"),
        F.when(F.lit(length is not None and told["seq_len"] != length), "another length"),
        F.col("error"),
        F.when(F.col("length") != told["seq_len"], "a length that the manifest has not"),
        F.when(F.col("vocabulary") != told["vocab_size"], "a vocabulary that the manifest has not"),
    )
    return rows.select("shard", "n_chunks", reason.isNull().alias("ok"), reason.alias("reason"))

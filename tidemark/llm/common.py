"""What the operators of this package share: inputs, written intermediate tables, text rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as a regular-expression class.
SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where no such folder is set, a local session gets a temporary one; on a cluster that is an error, as
    executors would each write to a disk of their own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Writes that run inside drop their own shuffle files when they end; nothing reads those a second time."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut there, and a lost executor loses nothing."""
    path = fresh_path(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables that written() made, once nothing reads them any more."""
    for table in tables:
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def released(batches: Iterator) -> Iterator:
    """batches; when they end, the worker gives memory that Arrow holds in reserve back, as workers outlive tasks."""
    import pyarrow as pa

    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()


def words(text: Column) -> Column:
    """The words of a text: maximal runs without white space; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def crc32_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as decimal text, modulo n: the fixed rule for held-out rows."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer file; executors have the same package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def boxed(docs: DataFrame) -> DataFrame:
    """row (all columns of docs in a struct), doc_id, text: operators add columns beside it and clash with none."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(whole, *[F.col(c) for c in ("doc_id", "text") if c in docs.columns])


def unboxed(rows: DataFrame, docs: DataFrame, text: Column | None = None) -> DataFrame:
    """The columns of docs out of boxed rows; text, if given, takes the place of the text."""
    new = {"text": text} if text is not None else {}
    return rows.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])

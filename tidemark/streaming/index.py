"""A resumable index of corpus files: counters that count each file once, and a manifest that can be checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import blank_words

COUNTED = ("docs", "chars", "tokens")


class CorpusIndex:
    """root: a folder that driver and executors share. It holds the stream's progress and a folder of counts for each batch.

    What a batch counts is written over what an earlier try of the same batch left, and only then is the
    batch done; so a run that was stopped anywhere and goes on later ends with the counts of one run.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def update(self, path: str, schema: str, files_at_once: int = 100) -> None:
        """Counts the Parquet files (source, text and what else) below a path that were not counted yet, and ends."""
        rows = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)
        rows = rows.select("source", "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("modified"))
        stream = rows.writeStream.foreachBatch(self._store).option("checkpointLocation", f"{self.root}/progress").trigger(availableNow=True).start()
        stream.awaitTermination()

    def _store(self, rows: DataFrame, batch: int) -> None:
        counted(rows).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/batches/batch={batch}")

    def manifest(self) -> DataFrame:
        """file, size, modified, source, docs, chars, tokens, digest of all that was counted."""
        shape = "file string, size long, modified timestamp, source string, docs long, chars long, tokens long, digest decimal(38,0)"
        return self.spark.read.schema(shape).option("recursiveFileLookup", "true").parquet(f"{self.root}/batches")

    def counters(self) -> DataFrame:
        """files and sums for each source; a source's files are those that hold it."""
        sums = [F.sum(c).alias(c) for c in COUNTED]
        return self.manifest().groupBy("source").agg(F.countDistinct("file").alias("files"), *sums)

    def wrong(self, path: str, schema: str) -> DataFrame:
        """file, reason of files below the path that the manifest has not (new), that are gone, or whose rows are others than counted.

        Rows are compared by counts and by a sum of hashes that does not depend on their order.
        """
        rows = self.spark.read.schema(schema).parquet(path)
        rows = rows.select("source", "text", F.col("_metadata.file_path").alias("file"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("timestamp").alias("modified"))
        there = counted(rows).groupBy("file").agg(*[F.sum(c).alias(c) for c in ("docs", "digest")])
        held = self.manifest().groupBy(F.col("file").alias("f")).agg(*[F.sum(c).alias(f"own_{c}") for c in ("docs", "digest")])
        both = there.join(held, F.col("file") == F.col("f"), "full")
        other = (F.col("docs") != F.col("own_docs")) | (F.col("digest") != F.col("own_digest"))
        reason = F.when(F.col("f").isNull(), "new").when(F.col("file").isNull(), "gone").when(other, "changed")
        return both.select(F.coalesce("file", "f").alias("file"), reason.alias("reason")).where("reason IS NOT NULL")


def counted(rows: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    digest = F.sum(F.xxhash64("source", "text").cast("decimal(38,0)"))
    return rows.groupBy("file", "size", "modified", "source").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.length(text).cast("long")).alias("chars"), F.sum(blank_words(text).cast("long")).alias("tokens"), digest.alias("digest")
    )

"""A stream of texts of which only those go on that are good, new, and no copy of held-out ones; what was taken is a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators.corpus import near_first

SEEN = "doc_id long, sha string, fp long"


class GuardedTexts:
    """root: a folder that driver and executors share, with the stream's progress, and by batch what was taken and its fingerprints.

    A text goes on if, in this order, it passes the quality rules, its family is not held out, no earlier
    text has the same canonical form, and no text that went on has a fingerprint within the share of bits
    that `threshold` leaves. Texts go by doc_id within a batch, and batches by their number. With rewrite, a long document
    becomes a prompt and its continuation where it can. A batch that is tried again writes over itself
    and does not see what it has written, so each text is taken once.
    """

    def __init__(self, spark: SparkSession, root: str, held_out: DataFrame | None = None, threshold: float = 0.85, rewrite: bool = False) -> None:
        self.spark, self.root, self.threshold, self.rewrite = spark, root.rstrip("/"), threshold, rewrite
        self.families = None if held_out is None else held_out.select(X.prompt_family(F.col("text")).alias("own")).distinct()

    def update(self, texts: DataFrame) -> None:
        """Takes what is new of a stream (doc_id, text), and ends."""
        writer = texts.select("doc_id", "text").writeStream.foreachBatch(self._store)
        writer.option("checkpointLocation", f"{self.root}/progress").trigger(availableNow=True).start().awaitTermination()

    def taken(self) -> DataFrame:
        """doc_id, text of all that went on."""
        return self._table("taken", "doc_id long, text string").drop("batch")

    def _table(self, name: str, shape: str) -> DataFrame:
        return self.spark.read.schema(f"{shape}, batch long").parquet(f"{self.root}/{name}*")

    def _store(self, rows: DataFrame, batch: int) -> None:
        good = rows.where(X.quality(F.col("text"))["accepted"]).withColumn("canonical", X.normalized(F.col("text")))
        if self.families is not None:
            good = good.withColumn("family", X.prompt_family(F.col("text"))).join(self.families, F.col("family") == F.col("own"), "left_anti")
        own = good.where("doc_id IS NOT NULL").select("doc_id", "text", X.digest(F.col("canonical")).alias("sha"), X.simhash64(F.col("canonical")).alias("fp"))
        own.write.mode("overwrite").parquet(f"{self.root}/work/batch={batch}")
        own = self.spark.read.schema("doc_id long, text string, sha string, fp long").parquet(f"{self.root}/work/batch={batch}")
        if batch > 0:
            seen = self._table("seen", SEEN).where(F.col("batch") < batch)
            own = own.join(seen.select("sha").distinct(), "sha", "left_anti")
            most = F.lit(round(64 * (1 - self.threshold)))
            bands = lambda df, name: df.select(F.col("fp").alias(name), F.posexplode(X.bands(F.col("fp"))).alias("band", "value")).distinct()
            close = bands(own, "fp").join(bands(seen, "old"), ["band", "value"]).where(X.distance(F.col("fp"), F.col("old")) <= most)
            own = own.join(close.select("fp").distinct(), "fp", "left_anti")
        kept = near_first(own.select("doc_id", X.normalized(F.col("text")).alias("text")), self.threshold).where("status = 'kept'").select("doc_id")
        own = own.join(kept, "doc_id")
        text = F.coalesce(X.continuation(F.col("text")), F.col("text")) if self.rewrite else F.col("text")
        own.select("doc_id", text.alias("text")).write.mode("overwrite").parquet(f"{self.root}/taken/batch={batch}")
        own.select("doc_id", "sha", "fp").write.mode("overwrite").parquet(f"{self.root}/seen/batch={batch}")

"""A table of rows in buckets of their keys that can be patched: only buckets in which a row changes are written again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.scratch import kept


class BucketTable:
    """path: a folder. keys: the columns that rows are looked up by. number: how many buckets there are, for good."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], number: int = 64) -> None:
        self.spark, self.path, self.keys, self.number = spark, path.rstrip("/"), keys, number

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.number)).cast("int")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def append(self, rows: DataFrame) -> None:
        rows.withColumn("bucket", self.bucket()).repartition(self.number, "bucket").write.partitionBy("bucket").mode("append").parquet(self.path)

    def patch(self, updates: DataFrame, open_: Column, values: list[str]) -> int:
        """Sets `values` of the rows that are open and have the keys of an update; returns how many buckets were written.

        A null in an update leaves the value as it is; of several updates of one key the least by `values`
        counts. Rows that are not open, and all files of other buckets, stay as they are; so a patch that
        was stopped may simply be done again. The new buckets are written apart before they take the
        old ones' place.
        """
        new = updates.groupBy(*self.keys).agg(F.min(F.struct(*values)).alias("new")).withColumn("bucket", self.bucket())
        wanted = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most `number`
        held = self.rows().where(F.col("bucket").isin(wanted))
        on = ["bucket", *self.keys]
        touched = [r.bucket for r in held.where(open_).join(new, on, "left_semi").select("bucket").distinct().collect()]
        if not touched:
            return 0
        order = self.rows().columns
        both = held.where(F.col("bucket").isin(touched)).join(new, on, "left")
        changed = {c: F.when(open_, F.coalesce(F.col("new")[c], F.col(c))).otherwise(F.col(c)) for c in values}
        staged = kept(both.select(*[changed.get(c, F.col(c)).alias(c) for c in order]), "patched")
        staged.repartition(self.number, "bucket").write.partitionBy("bucket").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(self.path)
        return len(touched)

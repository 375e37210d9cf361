"""Exact deduplication against a persistent index of digests. DataFrame operations only."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, boxed, remove, shuffles_removed, unboxed, written


def digest(text: Column) -> Column:
    """SHA-256 (binary) of the text without ASCII white space; null counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "").cast("binary"), 256))


class DigestIndex:
    """A table of one row for each different text: digest, doc_id, n_chars, copies.

    It is bucketed and sorted by digest, so the anti-join of a batch reads it without a shuffle and
    without a sort. `doc_id` is the row that was kept, n_chars its length in code points, copies how
    many rows of its batch had the text. The table lives as long as the session's catalog: under a
    metastore it outlasts the session, and the next one goes on with it.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int = 64) -> None:
        self.spark, self.table, self.buckets = spark, table, buckets

    def read(self) -> DataFrame:
        """The table, which is made empty where it is not there yet."""
        if not self.spark.catalog.tableExists(self.table):
            self._append(self.spark.createDataFrame([], "digest binary, doc_id long, n_chars int, copies long"))
        return self.spark.table(self.table)

    def _append(self, rows: DataFrame) -> None:
        rows.write.bucketBy(self.buckets, "digest").sortBy("digest").mode("append").saveAsTable(self.table)

    def add(self, digests: DataFrame) -> DataFrame:
        """Appends what is new in digests (doc_id, n_chars, digest) and returns the new rows.

        Of equal texts in the batch the one with most code points stays, of these the one of smallest
        doc_id. Texts that are in the index already add nothing.
        """
        best = F.max(F.struct("n_chars", (-F.col("doc_id")).alias("less")))
        new = digests.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("copies"))
        new = new.select("digest", (-F.col("best.less")).alias("doc_id"), F.col("best.n_chars").alias("n_chars"), "copies")
        new = written(self.unknown(new), "new-digests")
        with shuffles_removed(self.spark):
            self._append(new.repartition(self.buckets, "digest"))
        return new

    def unknown(self, digests: DataFrame) -> DataFrame:
        """The rows of digests that the index does not have, by a sort-merge anti-join with its sorted buckets."""
        return digests.join(self.read().select("digest").hint("merge"), "digest", "left_anti")

    def known(self, digests: DataFrame) -> DataFrame:
        """The index's rows for digests."""
        return self.read().join(digests.select("digest").distinct().hint("merge"), "digest", "left_semi")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars (code points of the original text), digest of every row."""
    return docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n_chars"), digest(F.col("text")).alias("digest"))


def scratch_index(spark: SparkSession) -> DigestIndex:
    """A new, empty index for one batch."""
    return DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions")))


def classes(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest of every row of docs.

    docs: doc_id (long, unique), text. group_size counts the equal texts of the index's batch that
    first had the text. A row whose text an earlier batch had is not kept; its keep_id names that
    batch's row. Null, empty and blank texts are equal. An empty table gives no rows; further columns
    are left out. A row without a doc_id is never kept while another of its group has one. The widest group is combined before it is shuffled, and the join back to the rows
    can be split by adaptive execution.
    """
    spark, own = docs.sparkSession, index is None
    index = index or scratch_index(spark)
    rows = written(digests(docs), "digests")
    old = written(index.known(rows), "old-digests")
    new = index.add(rows)
    # both sides of the join are dealt by digest here, so adaptive execution can split a hot text's rows
    known = old.withColumn("fresh", F.lit(False)).unionByName(new.withColumn("fresh", F.lit(True)))
    known = known.select("digest", F.col("doc_id").alias("keep_id"), F.col("copies").alias("group_size"), "fresh")
    found = rows.select("doc_id", "digest").join(known, "digest")
    kept = F.col("fresh") & F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False))
    found = written(found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest"), "classes")
    remove(spark, rows, old, new)
    if own:
        index.drop()
    return found


def deduplicate(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """docs without the rows whose text is in the index or in a better row of docs; all columns stay.

    A row without a doc_id is left out. An empty table gives no rows.
    """
    spark, own = docs.sparkSession, index is None
    index = index or scratch_index(spark)
    rows = written(digests(docs), "digests")
    keep = index.add(rows).select(F.col("doc_id").alias("kept_id"))
    remove(spark, rows)
    if own:
        index.drop()
    # row holds the columns of docs, so no name clashes; the hint makes the join alike at every size
    return unboxed(boxed(docs).join(keep.hint("merge"), F.col("doc_id") == F.col("kept_id"), "left_semi"), docs)

"""The guarded stream against one pass over all texts."""

from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators.corpus import near_first
from tidemark.streaming.guard import GuardedTexts


def test_batches_give_what_one_pass_gives(spark, data, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    again = docs.where("doc_id % 10 = 0").select((F.col("doc_id") + 5000).alias("doc_id"), F.concat(F.lit("  "), "text").alias("text"))
    held = docs.where("doc_id % 23 = 0").select("text")
    whole = docs.unionByName(again)
    for low, high in ((0, 70), (70, 150), (150, 10**6)):
        whole.where(F.col("doc_id").between(low, high - 1)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    store, tries = GuardedTexts._store, []

    def failing(self, rows, batch):
        store(self, rows, batch)
        tries.append(batch)
        if tries == [0, 1]:
            raise RuntimeError("stopped")

    monkeypatch.setattr(GuardedTexts, "_store", failing)
    guard = GuardedTexts(spark, f"{tmp_path}/guard", held)
    stream = lambda: spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    try:
        guard.update(stream())
    except Exception as stopped:
        assert "stopped" in str(stopped)
    guard.update(stream())
    assert tries == [0, 1, 1, 2]
    families = held.select(X.prompt_family(F.col("text")).alias("own")).distinct()
    good = whole.where(X.quality(F.col("text"))["accepted"]).join(families, X.prompt_family(F.col("text")) == F.col("own"), "left_anti")
    want = {r.doc_id for r in near_first(good.select("doc_id", X.normalized(F.col("text")).alias("text"))).where("status = 'kept'").collect()}
    got = [r.doc_id for r in guard.taken().collect()]
    assert sorted(got) == sorted(want) and 20 < len(want) < good.count() < whole.count()


def test_long_texts_become_prompts(spark, tmp_path):
    text = " ".join(f"word{i % 61} thing{i % 7}" for i in range(60)) + "."
    spark.createDataFrame([(1, text), (2, None), (None, text)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/in")
    guard = GuardedTexts(spark, f"{tmp_path}/guard", rewrite=True)
    guard.update(spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/in"))
    (row,) = guard.taken().collect()
    want = spark.createDataFrame([(text,)], "t string").select(X.continuation(F.col("t")).alias("c")).first().c
    assert row.doc_id == 1 and row.text == (want or text) and want is not None

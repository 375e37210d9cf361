"""Tables and indexes that hold state: stopped and resumed, patched, checked."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.sources.buckets import BucketTable
from tidemark.streaming.index import CorpusIndex

SCHEMA = "source string, text string"


def write_files(spark, path, numbers):
    for i in numbers:
        rows = spark.createDataFrame([(f"s{i % 3}", f"word {i} and more"), ("s0", None)], SCHEMA)
        rows.coalesce(1).write.mode("append").parquet(str(path))


def totals(index):
    return {r.source: (r.files, r.docs, r.chars, r.tokens) for r in index.counters().collect()}


def test_a_stopped_index_goes_on(spark, tmp_path, monkeypatch):
    write_files(spark, tmp_path / "in", range(5))
    path = f"{tmp_path}/in"
    one = CorpusIndex(spark, f"{tmp_path}/one")
    one.update(path, SCHEMA)
    store, tries = CorpusIndex._store, []

    def failing(self, rows, batch):
        store(self, rows, batch)  # the batch is written, but not done
        tries.append(batch)
        if tries.count(2) == 1 and batch == 2:
            raise RuntimeError("stopped")

    monkeypatch.setattr(CorpusIndex, "_store", failing)
    two = CorpusIndex(spark, f"{tmp_path}/two")
    with pytest.raises(Exception, match="stopped"):
        two.update(path, SCHEMA, files_at_once=1)
    assert sum(r.docs for r in two.counters().collect()) == 6
    CorpusIndex(spark, f"{tmp_path}/two").update(path, SCHEMA, files_at_once=1)
    assert tries == [0, 1, 2, 2, 3, 4] and totals(two) == totals(one) and sum(t[1] for t in totals(one).values()) == 10
    assert two.wrong(path, SCHEMA).collect() == []
    write_files(spark, tmp_path / "in", [7])
    assert [r.reason for r in two.wrong(path, SCHEMA).collect()] == ["new"]
    two.update(path, SCHEMA)
    assert two.wrong(path, SCHEMA).collect() == [] and sum(t[1] for t in totals(two).values()) == 12


def test_an_index_sees_files_that_changed_or_are_gone(spark, tmp_path):
    write_files(spark, tmp_path / "in", range(3))
    path = f"{tmp_path}/in"
    index = CorpusIndex(spark, f"{tmp_path}/index")
    index.update(path, SCHEMA)
    files = sorted(f for f in os.listdir(path) if f.endswith(".parquet"))
    for f in files:
        os.remove(f"{path}/.{f}.crc")  # the local file system's own check
    os.remove(f"{path}/{files[0]}")
    os.replace(f"{path}/{files[1]}", f"{path}/other.parquet")
    os.link(f"{path}/{files[2]}", f"{path}/{files[1]}")
    got = sorted((r.reason, r.file.rsplit("/", 1)[1]) for r in index.wrong(path, SCHEMA).collect())
    assert got == sorted([("gone", files[0]), ("new", "other.parquet"), ("changed", files[1])])


def names(path):
    return {(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_a_patch_writes_touched_buckets_alone(spark, tmp_path):
    path = f"{tmp_path}/t"
    made = BucketTable(spark, path, ["ts"], 8)
    made.append(spark.range(200).select(F.col("id").alias("ts"), F.when(F.col("id") % 2 == 0, -1).otherwise(1).alias("label"), F.lit(0.0).alias("pnl"), F.lit("x").alias("note")))
    before = names(path)
    news = spark.createDataFrame([(4, 1, 2.5), (4, 1, 9.0), (5, 0, 7.0), (6, None, 1.5), (9999, 1, 1.0)], "ts long, label int, pnl double")
    n = made.patch(news, F.col("label") == -1, ["label", "pnl"])
    rows = {r.ts: (r.label, r.pnl, r.note) for r in made.rows().collect()}
    want = {i: (-1 if i % 2 == 0 else 1, 0.0, "x") for i in range(200)} | {4: (1, 2.5, "x"), 6: (-1, 1.5, "x")}
    assert rows == want and made.rows().count() == 200
    gone = before - names(path)
    assert n == len({d for d, _ in gone}) <= 2 and len(before & names(path)) >= len(before) - len(gone)
    held = names(path)
    assert made.patch(news.where("ts = 4"), F.col("label") == -1, ["label", "pnl"]) == 0 and names(path) == held
    assert made.patch(news.where("false"), F.col("label") == -1, ["label", "pnl"]) == 0

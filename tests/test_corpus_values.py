"""Values of corpus operators that have no SQL twin, and rows numbered by day, against plain versions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators.corpus import curriculum, inserted, upserted
from tidemark.operators.curves import numbered


@pytest.mark.parametrize("least", [0, 3, 50, 10_000])
def test_curriculum_takes_the_lowest_hashes(spark, data, least):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    rows = docs.select("doc_id", X.category(F.coalesce("text", F.lit(""))).isin("reasoning", "math").alias("p"), F.xxhash64("doc_id", F.lit(143)).alias("h")).collect()
    primary = {r.doc_id for r in rows if r.p}
    others = [r.doc_id for r in sorted((r for r in rows if not r.p), key=lambda r: (r.h, r.doc_id))]
    got = curriculum(docs, least=least).collect()
    assert {r.doc_id for r in got if r.role == "primary"} == primary
    assert sorted(r.doc_id for r in got if r.role == "replay") == sorted(others[: max(least, len(primary) // 4)])


def test_numbers_by_day(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randint(0, 90)), i) for i in range(200)]
    got = {r.i: (r.place, r.whole) for r in numbered(spark.createDataFrame(rows, "k string, ts timestamp_ntz, i int").repartition(3), ["k"], "ts", ["i"]).collect()}
    for key in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        assert [got[r[2]] for r in own] == [(n, len(own)) for n in range(1, len(own) + 1)]


def test_upserts_and_inserts(spark):
    shape = "id int, at int, new string, k string, row string"
    old = spark.createDataFrame([(1, 1, "a", "o", "r"), (2, 5, "b", "o", "r"), (None, 1, "c", "o", "r")], shape)
    new = spark.createDataFrame([(1, 1, "x", "n", "r"), (2, 4, "y", "n", "r"), (3, 2, "late", "n", "r"), (3, 1, "first", "n", "r"), (None, 0, "z", "n", "r")], shape)
    assert {(r.id, r.new) for r in upserted(old, new, "id", "at").collect()} == {(1, "x"), (2, "b"), (3, "late"), (None, "c")}
    assert sorted((str(r.id), r.new, r.k) for r in inserted(old, new, "id", "at").collect()) == [("1", "a", "o"), ("2", "b", "o"), ("3", "first", "n"), ("None", "c", "o"), ("None", "z", "n")]
    assert upserted(old, new, "id", "at").columns == inserted(old, new, "id", "at").columns == old.columns

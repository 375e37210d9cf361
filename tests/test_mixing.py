"""Mixes and shuffles: shares, bounds, and the same order on any partitioning."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators.mixing import bounded_shuffle, weighted_mix


def rows(spark, n, partitions):
    source = F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").when(F.col("id") % 9 == 2, None).otherwise("c")
    return spark.range(n).select(F.col("id").alias("doc_id"), source.alias("source"), F.lit("x").alias("run")).repartition(partitions)


def order(df):
    return [(r.source, r.doc_id, r.epoch) for r in df.orderBy("at", "source", "epoch", "doc_id").collect()]


def test_shares_follow_the_weights(spark):
    mixed = order(weighted_mix(rows(spark, 60_000, 5).drop("run"), {"a": 5.0, "b": 3.0, "c": 2.0}, span=1000))
    head = mixed[:30_000]  # no source is at its end here
    for source, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(sum(s == source for s, *_ in head) / len(head) - share) < 0.01
    for source in "abc":
        own = [d for s, d, _ in mixed if s == source]
        assert own == sorted(own)
    assert len(mixed) == 20_000 + 20_000 + 13_333 and {s for s, *_ in mixed[-3000:]} <= {"b", "c"}


def test_order_is_the_same_on_any_partitioning(spark):
    weights = {"a": 1.0, "b": 4.0, "absent": 1.0}
    one = order(weighted_mix(rows(spark, 3000, 1).drop("run"), weights))
    assert one == order(weighted_mix(rows(spark, 3000, 7).drop("run"), weights, span=100)) and one != order(weighted_mix(rows(spark, 3000, 1).drop("run"), weights, seed=1))
    twice = order(weighted_mix(rows(spark, 300, 3).drop("run"), weights, epochs=2, span=50))
    assert len(twice) == 400
    for source in "ab":
        own = [(e, d) for s, d, e in twice if s == source]
        assert own == sorted(own)
    for bad in ({}, {"a": 0.0}):
        with pytest.raises(ValueError):
            weighted_mix(rows(spark, 3, 1), bad)
    assert weighted_mix(rows(spark, 9, 1).drop("run").where("false"), weights).collect() == []


def test_shuffle_is_bounded(spark):
    def shuffled(n, size, partitions=3, **more):
        df = spark.range(n).select((F.col("id") * 3).alias("doc_id")).repartition(partitions)
        return [r.doc_id // 3 for r in bounded_shuffle(df, size, **more).orderBy("at", "doc_id").collect()]

    got = shuffled(5000, 50, span=700)
    moved = [abs(i - p) for i, p in enumerate(got)]
    assert sorted(got) == list(range(5000)) and max(moved) < 50 and sum(moved) / 5000 > 10
    assert got == shuffled(5000, 50, 8) and got != shuffled(5000, 50, seed=3)
    assert shuffled(200, 1) == shuffled(200, 0) == list(range(200)) and shuffled(0, 5) == []

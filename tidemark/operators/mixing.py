"""Orders of rows that are drawn by chance yet the same on any partitioning: weighted mixes of sources, bounded shuffles.

Chance is a digest of the seed and the row's id. Times are whole numbers, so their sums are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Units of time in one mean waiting time of a source of weight 1.
UNIT = 1_000_000

#: Ids of which sums are made in one task.
SPAN = 100_000


def uniform(seed: int, *names: str) -> Column:
    """A number above 0 and below 1 from the first 48 bits of the SHA-256 of seed and ids."""
    told = F.concat_ws(":", F.lit(str(seed)), *[F.col(n).cast("string") for n in names])
    return (F.conv(F.substring(F.sha2(told, 256), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def _sums(rows: DataFrame, value: str, keys: list[str], span: int) -> DataFrame:
    """rows with the sum of `value` over all rows of the same keys up to each, by doc_id: ranges of ids are summed up
    apart, and only their totals meet."""
    rows = rows.withColumn("run", F.floor(F.col("doc_id") / span))
    totals = rows.groupBy(*keys, "run").agg(F.sum(value).alias("total"))
    sooner = Window.partitionBy(*keys).orderBy("run") if keys else Window.orderBy("run")
    held = F.coalesce(F.sum("total").over(sooner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(*[F.col(k).alias(f"own_{k}") for k in keys], F.col("run").alias("own_run"), held.alias("held"))
    on = F.col("run").eqNullSafe(F.col("own_run"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"own_{k}"))
    inside = Window.partitionBy(*keys, "run").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn(value, F.sum(value).over(inside)).join(totals, on)
    return found.withColumn(value, F.col(value) + F.col("held")).drop("run", "own_run", "held", *[f"own_{k}" for k in keys])


def weighted_mix(rows: DataFrame, weights: dict[str, float], seed: int = 42, epochs: int = 1, span: int = SPAN) -> DataFrame:
    """rows (doc_id, source) of the named sources with epoch and at; in the order of at, source, epoch, doc_id they are the mix.

    Each place of the mix is drawn by weight from the sources that still have rows, which come in the order
    of doc_id. That is the order in which clocks of the sources strike that wait exponential times, on
    average 1 / weight: of several such clocks the next to strike is any with a chance in proportion to
    its rate, whatever came before. So a row's place needs only its own source's waiting times, summed up.
    With more epochs a source begins again when its rows are done, with other waiting times.
    """
    if not weights or any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive, and there must be one")
    known = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    own = rows.withColumn("weight", F.try_element_at(known, F.col("source"))).where("weight IS NOT NULL AND doc_id IS NOT NULL")
    own = own.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    own = own.withColumn("at", F.floor(-F.ln(uniform(seed, "source", "doc_id", "epoch")) / F.col("weight") * UNIT).cast("long"))
    summed = _sums(own, "at", ["source", "epoch"], span).drop("weight")
    if epochs == 1:
        return summed
    ends = summed.groupBy("source", "epoch").agg(F.max("at").alias("end"))
    before = F.coalesce(F.sum("end").over(Window.partitionBy("source").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = ends.select(F.col("source").alias("s"), F.col("epoch").alias("e"), before.alias("shift"))
    return summed.join(shifts, F.col("source").eqNullSafe(F.col("s")) & (F.col("epoch") == F.col("e"))).withColumn("at", F.col("at") + F.col("shift")).drop("s", "e", "shift")


def bounded_shuffle(rows: DataFrame, size: int, seed: int = 42, span: int = SPAN) -> DataFrame:
    """rows (doc_id) with at; in the order of at, doc_id no row is `size` places or more from its place in the order of doc_id.

    As with a buffer of `size` rows, what is near stays near, and no task holds more than a range of ids.
    A size of 1 or less keeps the order.
    """
    counted = _sums(rows.where("doc_id IS NOT NULL").withColumn("at", F.lit(1).cast("long")), "at", [], span)
    return counted.withColumn("at", F.col("at") - 1 + F.floor(uniform(seed, "doc_id") * max(1, size)).cast("long"))

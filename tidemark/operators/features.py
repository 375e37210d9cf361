"""Rolling scores of many columns at once, over series that are cut into blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rolling_z(rows: DataFrame, names: list[str], order: str, window: int = 100, block: int = 2000) -> DataFrame:
    """rows (symbol, ts, order, names) with <name>_z: distance from the mean of the last `window` pushed values, in deviations.

    The first row of a time, by `order`, is pushed, so a time counts once; later rows of that time are
    scored against the same values. With fewer than two values, or no deviation, the deviation is one.
    A symbol's pushed rows are numbered over its days and dealt to blocks of `block`, each with the window
    before it, so all columns are scored in one sort and a symbol with most of the rows is many tasks.
    """
    pushed = rows.groupBy("symbol", "ts").agg(F.min(F.struct(order, *names)).alias("x")).select("symbol", "ts", "x.*")
    pushed = pushed.withColumn("day", F.date_trunc("day", "ts"))
    sooner = Window.partitionBy("symbol").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = pushed.groupBy("symbol", "day").agg(F.count(F.lit(1)).alias("n")).select(F.col("symbol").alias("s"), F.col("day").alias("d"), F.coalesce(F.sum("n").over(sooner), F.lit(0)).alias("held"))
    inside = Window.partitionBy("symbol", "day").orderBy("ts")
    numbered = pushed.withColumn("own", F.row_number().over(inside)).join(days, F.col("symbol").eqNullSafe(F.col("s")) & F.col("day").eqNullSafe(F.col("d")))
    numbered = numbered.withColumn("place", F.col("held") + F.col("own") - 1)
    at = F.floor(F.col("place") / block)
    blocks = numbered.withColumn("block", F.explode(F.when(F.col("place") % block > block - window, F.array(at, at + 1)).otherwise(F.array(at))))
    frame = Window.partitionBy("symbol", "block").orderBy("place").rowsBetween(1 - window, 0)
    told = {f"{n}_{k}": f(n).over(frame) for n in names for k, f in (("mean", F.avg), ("dev", F.stddev_pop))}
    scored = blocks.withColumns(told).where(at == F.col("block")).select(F.col("symbol").alias("s"), F.col("ts").alias("t"), *told)
    found = rows.join(scored, F.col("symbol").eqNullSafe(F.col("s")) & (F.col("ts") == F.col("t")))
    dev = lambda n: F.when(F.col(f"{n}_dev") > 0, F.col(f"{n}_dev")).otherwise(1.0)
    return found.select(*rows.columns, *[((F.col(n) - F.col(f"{n}_mean")) / dev(n)).alias(f"{n}_z") for n in names])

"""One document about a journal of followed decisions: counts, rates, curves both ways, and buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.curves import curve
from tidemark.operators.journal import KEY
from tidemark.operators.metrics import bucket

#: Bands of the spread's share of the target.
BANDS = ([0.0005, 0.001, 0.002], ["<0.0005", "0.0005-0.001", "0.001-0.002", ">=0.002"])


def virtual(rows: DataFrame) -> tuple[Column, Column]:
    """What a settled decision made at its best or lost at its worst, and what the opposite one would have made of the same extremes."""
    best, worst = F.greatest("most_favorable", F.lit(0.0)), F.greatest("most_adverse", F.lit(0.0))
    won = F.col("status") == "win"
    own = F.when(won, best).when(F.col("status") == "loss", -worst).otherwise(0.0)
    other = (
        F.when((F.col("target") > 0) & (worst >= F.col("target")), worst)
        .when((F.col("limit") > 0) & (best >= F.col("limit")), -best)
        .when((F.col("status") == "loss") & (worst > 0), worst)
        .when(won & (best > 0), -best)
        .otherwise(0.0)
    )
    return own, other


def report(journal: DataFrame, target: float = 50.0) -> DataFrame:
    """One row of nested columns: counts (with duplicates and the latest time), curve and inverse_curve, and buckets.

    journal: decided, symbol, side, bid, ask, target, limit, status, most_favorable, most_adverse. buckets:
    arrays of (bucket, summary) by side, symbol and band, out of one aggregation with grouping sets whose
    empty set is the whole. An empty journal gives counts of zero and null curves.
    """
    keyed = journal.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    counts = journal.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("status").isin("win", "loss")).alias("resolved"),
        F.count_if(F.col("status") == "pending").alias("pending"),
        F.max("decided").alias("latest"),
    )
    repeats = keyed.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
    own, other = virtual(journal)
    settled = journal.where(F.col("status").isin("win", "loss")).withColumns({"profit": own, "inverse": other})
    share = (F.col("ask") - F.col("bid")) / F.col("target")
    marked = settled.withColumns({"by_side": F.when(F.col("side") == 1, "long").otherwise("short"), "by_symbol": F.coalesce("symbol", F.lit("missing")), "by_band": bucket(share, *BANDS)})
    n = F.count(F.lit(1))
    sums = {
        "n": n, "wins": F.count_if(F.col("profit") > 0), "losses": F.count_if(F.col("profit") < 0), "win_rate": F.count_if(F.col("profit") > 0) / n,
        "net": F.sum("profit"), "average": F.avg("profit"), "inverse_net": F.sum("inverse"), "inverse_average": F.avg("inverse"), "inverse_win_rate": F.count_if(F.col("inverse") > 0) / n, "progress": F.sum("profit") / target,
    }
    names = ("by_side", "by_symbol", "by_band")
    grouped = marked.groupingSets([[c] for c in names] + [[]], *names).agg(F.struct(*[x.alias(k) for k, x in sums.items()]).alias("summary"))
    of = lambda c: F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("bucket"), "summary")))).alias(c)
    whole = F.max(F.when(F.coalesce(*names).isNull(), F.col("summary"))).alias("all")
    buckets = grouped.agg(F.struct(whole, *[of(c) for c in names]).alias("buckets"))
    curves = [curve(marked.select("decided", *KEY[1:], F.col(c).alias("profit")), [], "decided", list(KEY[1:]), target).select(F.struct("*").alias(a)) for c, a in (("profit", "curve"), ("inverse", "inverse_curve"))]
    out = counts.join(repeats).select(F.struct("*").alias("counts"))  # of one row each
    for part in (buckets, *curves):
        out = out.join(part, how="left")
    return out

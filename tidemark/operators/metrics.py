"""Performance of trades: sums, streaks, curves, tails, buckets, grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ratio(won: Column, lost: Column, cap: float = 999.0) -> Column:
    return F.when(lost > 0, won / lost).when(won > 0, cap).otherwise(0.0)


def performance(deals: DataFrame, *keys: str) -> DataFrame:
    """Count, wins, losses, win rate, net, gross, profit factor (999 with no loss), expectancy, means and extremes."""
    profit = F.col("profit")
    won = F.coalesce(F.sum(F.when(profit > 0, profit)), F.lit(0.0))
    lost = -F.coalesce(F.sum(F.when(profit < 0, profit)), F.lit(0.0))
    n, wins, losses = F.count(F.lit(1)), F.count_if(profit > 0), F.count_if(profit < 0)
    return deals.groupBy(*keys).agg(
        n.alias("trades"),
        wins.alias("wins"),
        losses.alias("losses"),
        (wins / n).alias("win_rate"),
        F.sum("profit").alias("net"),
        won.alias("gross_profit"),
        lost.alias("gross_loss"),
        _ratio(won, lost).alias("profit_factor"),
        F.avg("profit").alias("expectancy"),
        F.coalesce(F.avg(F.when(profit > 0, profit)), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.avg(F.when(profit < 0, profit)), F.lit(0.0)).alias("avg_loss"),
        F.coalesce(F.max(F.when(profit > 0, profit)), F.lit(0.0)).alias("largest_win"),
        F.coalesce(F.min(F.when(profit < 0, profit)), F.lit(0.0)).alias("largest_loss"),
    )


def loss_streak(deals: DataFrame, key: str, order: list[str], zero_resets: bool = True) -> DataFrame:
    """key, max_loss_streak: the longest run of losses; a zero profit ends a run, or is passed over."""
    profit = F.col("profit")
    rows = deals if zero_resets else deals.where(profit != 0)
    by = Window.partitionBy(key).orderBy(*order)
    island = F.sum((profit >= 0).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    runs = rows.withColumn("island", island).groupBy(key, "island").agg(F.count_if(profit < 0).alias("run"))
    return runs.groupBy(key).agg(F.max("run").alias("max_loss_streak"))


def equity_curve(deals: DataFrame, key: str, order: list[str], goal: float = 50.0) -> DataFrame:
    """key, ending, peak (at least 0), max_drawdown, first_goal: place of the first trade at which the goal was reached."""
    by = Window.partitionBy(key).orderBy(*order)
    sofar = by.rowsBetween(Window.unboundedPreceding, 0)
    curve = deals.withColumns({"equity": F.sum("profit").over(sofar), "at": F.row_number().over(by)})
    curve = curve.withColumn("peak", F.greatest(F.max("equity").over(sofar), F.lit(0.0)))
    return curve.groupBy(key).agg(
        F.max_by("equity", "at").alias("ending"),
        F.max("peak").alias("peak"),
        F.max(F.col("peak") - F.col("equity")).alias("max_drawdown"),
        F.min(F.when(F.col("equity") >= goal, F.col("at"))).alias("first_goal"),
    )


def cvar(deals: DataFrame, key: str, alpha: float = 0.05) -> DataFrame:
    """key, cvar: minus the mean of the worst max(1, ceil(n alpha)) profits, at least 0."""
    by = Window.partitionBy(key).orderBy("profit")
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    worst = deals.withColumns({"at": F.row_number().over(by), "n": n}).where(F.col("at") <= F.greatest(F.lit(1), F.ceil(F.col("n") * alpha)))
    return worst.groupBy(key).agg(F.greatest(-F.avg("profit"), F.lit(0.0)).alias("cvar"))


def bucket(value: Column, edges: list[float], names: list[str]) -> Column:
    """Name of the first edge above the value, or the last name."""
    out = F.lit(names[-1])
    for edge, name in reversed(list(zip(edges, names, strict=False))):
        out = F.when(value < edge, name).otherwise(out)
    return out


def bucket_summary(deals: DataFrame, key: Column) -> DataFrame:
    """bucket, trades, wins, losses, net, avg, inverse_net, inverse_win_rate; a blank or null key is "missing"."""
    profit = F.col("profit")
    named = F.coalesce(F.when(F.trim(key.cast("string")) != "", key.cast("string")), F.lit("missing"))
    return deals.groupBy(named.alias("bucket")).agg(
        F.count(F.lit(1)).alias("trades"),
        F.count_if(profit > 0).alias("wins"),
        F.count_if(profit < 0).alias("losses"),
        F.sum("profit").alias("net"),
        F.avg("profit").alias("avg"),
        F.sum(-profit).alias("inverse_net"),
        (F.count_if(profit < 0) / F.count(F.lit(1))).alias("inverse_win_rate"),
    )


def classification(rows: DataFrame, *keys: str) -> DataFrame:
    """tp, fp, tn, fn, accuracy, precision, recall, allowed_rate of rows (predicted 0/1, label 0/1)."""
    p, y = F.col("predicted") == 1, F.col("label") == 1
    tp, fp, tn, fn = F.count_if(p & y), F.count_if(p & ~y), F.count_if(~p & ~y), F.count_if(~p & y)
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return rows.groupBy(*keys).agg(
        tp.alias("tp"), fp.alias("fp"), tn.alias("tn"), fn.alias("fn"),
        share(tp + tn, F.count(F.lit(1))).alias("accuracy"),
        share(tp, tp + fp).alias("precision"),
        share(tp, tp + fn).alias("recall"),
        share(tp + fp, F.count(F.lit(1))).alias("allowed_rate"),
    )


def policy_grid(deals: DataFrame, policies: DataFrame, key: str) -> DataFrame:
    """Trades, net and profit factor of every policy and key.

    policies: policy, low, high - a policy takes the deals whose strength is in [low, high). The grid is a
    fixed table of the caller's, far smaller than the deals, and is sent to every task; deals are
    combined by policy before any shuffle.
    """
    profit = F.col("profit")
    won = F.coalesce(F.sum(F.when(profit > 0, profit)), F.lit(0.0))
    lost = -F.coalesce(F.sum(F.when(profit < 0, profit)), F.lit(0.0))
    taken = deals.join(F.broadcast(policies), (deals["strength"] >= policies["low"]) & (deals["strength"] < policies["high"]))
    return taken.groupBy("policy", key).agg(F.count(F.lit(1)).alias("trades"), F.sum("profit").alias("net"), _ratio(won, lost).alias("profit_factor"))


def threshold_grid(rows: DataFrame, key: str, least: int = 5) -> DataFrame:
    """key, threshold, precision, taken: of the thresholds 0.30 to 0.90 by 0.02 the first of best precision.

    rows: score, label 0/1. Scores are counted by the highest threshold they pass, at most 32 counts for
    a key, and summed from the top, so each row is touched once.
    """
    step = F.least(F.floor(F.round((F.col("score") - 0.30) / 0.02, 9)), F.lit(30))
    counts = rows.where(F.col("score") >= 0.30).groupBy(key, step.cast("int").alias("step")).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("hits"))
    every = rows.select(key).distinct().withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(30))))
    above = Window.partitionBy(key).orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    full = every.join(counts, [key, "step"], "left")
    full = full.withColumns({"taken": F.coalesce(F.sum("n").over(above), F.lit(0)), "hits": F.coalesce(F.sum("hits").over(above), F.lit(0))})
    precision = F.when(F.col("taken") >= least, F.col("hits") / F.col("taken")).otherwise(0.0)
    best = full.withColumn("precision", precision).groupBy(key).agg(F.max(F.struct("precision", (-F.col("step")).alias("first"), "taken")).alias("x"))
    return best.select(key, F.round(0.30 - 0.02 * F.col("x.first"), 2).alias("threshold"), F.col("x.precision").alias("precision"), F.col("x.taken").alias("taken"))


def correlations(rows: DataFrame, names: list[str]) -> DataFrame:
    """a, b, corr: Pearson correlation of every pair of the named columns, from one aggregation."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    one = rows.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    stacked = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("corr")) for a, b in pairs]))
    return one.select(stacked.alias("x")).select("x.*")


def label_economics(deals: DataFrame, key: str) -> DataFrame:
    """key, positive_rate, avg_win, avg_loss, reward_risk, break_even, expected, kelly (0 to 1)."""
    profit = F.col("profit")
    rate = F.avg((profit > 0).cast("double"))
    win = F.coalesce(F.avg(F.when(profit > 0, profit)), F.lit(0.0))
    loss = F.coalesce(-F.avg(F.when(profit < 0, profit)), F.lit(0.0))
    base = deals.groupBy(key).agg(rate.alias("positive_rate"), win.alias("avg_win"), loss.alias("avg_loss"))
    rr = F.when(F.col("avg_loss") > 0, F.col("avg_win") / F.col("avg_loss")).otherwise(0.0)
    base = base.withColumn("reward_risk", rr)
    p, b = F.col("positive_rate"), F.col("reward_risk")
    return base.withColumns(
        {
            "break_even": F.when(p > 0, (1 - p) / p).otherwise(0.0),
            "expected": p * F.col("avg_win") - (1 - p) * F.col("avg_loss"),
            "kelly": F.when(b > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (p * b - (1 - p)) / b))).otherwise(0.0),
        }
    )

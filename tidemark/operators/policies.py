"""Entry policies over journal rows: what each would have taken and earned, the best of them, and the gate that one makes."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The steps of each threshold.
PROFITS = (0.0, 0.03, 0.05, 0.07, 0.10)
CONSISTENCIES = (0.0, 0.55, 0.60, 0.67, 0.75)
PULLBACKS = (1.00, 0.75, 0.65, 0.50, 0.35)


@dataclass(frozen=True)
class Policy:
    """A row matches if its estimate and consistency are at least these and its pullback at most that, if it passed the
    quality test where that is asked for, and has the reason where one is named. inverted: trades go the other way."""

    least_profit: float = 0.0
    least_consistency: float = 0.0
    most_pullback: float = 1.0
    quality: bool = False
    reason: str | None = None
    inverted: bool = False


def matches(policy: Policy) -> Column:
    """Whether a row (estimate, consistency, pullback, quality, reason) matches; a null number counts as zero, a null flag as false."""
    number = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    test = (number("estimate") >= policy.least_profit) & (number("consistency") >= policy.least_consistency) & (number("pullback") <= policy.most_pullback)
    if policy.quality:
        test = test & F.coalesce("quality", F.lit(False))
    return test & F.coalesce(F.trim("reason") == policy.reason, F.lit(False)) if policy.reason is not None else test


def gate(enabled: bool, policy: Policy | None, allowed: bool = True, reason: str = "shadow_policy_not_allowed", invert: bool = False) -> Column:
    """What the policy in force says of a row: the first reason against it, or shadow_policy_ok."""
    # The reasons.
    if not enabled:
        return F.lit("shadow_policy_disabled")
    if policy is None:
        return F.lit("shadow_policy_missing")
    if not allowed:
        return F.lit(reason)
    if policy.inverted and not invert:
        return F.lit("shadow_policy_inversion_requires_review")
    return F.when(matches(policy), "shadow_policy_ok").otherwise("shadow_policy_feature_reject")


def grid(rows: DataFrame, profits: tuple = PROFITS, consistencies: tuple = CONSISTENCIES, pullbacks: tuple = PULLBACKS) -> DataFrame:
    """Each policy of the grid (the fields of Policy) with taken, wins, net, won, lost and profit_factor of `profit` over the rows it matches.

    A row says of each threshold only how many steps it passes. So rows are counted and summed by these
    numbers, quality and reason, at most a few hundred for each reason, before policies meet them; reasons
    are a table of names and not of data. A policy that takes nothing has zeros. Reasons of the rows make the grid's.
    """
    number = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    passed = lambda c, steps, test: sum((test(number(c), s).cast("int") for s in steps[1:]), test(number(c), steps[0]).cast("int"))
    up, down = sorted(profits), sorted(pullbacks, reverse=True)
    even = sorted(consistencies)
    above, below = (lambda x, s: x >= s), (lambda x, s: x <= s)
    profit = F.col("profit")
    cells = rows.groupBy(
        passed("estimate", up, above).alias("p"), passed("consistency", even, above).alias("c"), passed("pullback", down, below).alias("b"),
        F.coalesce("quality", F.lit(False)).alias("q"), F.trim("reason").alias("r"),
    ).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(profit > 0).alias("up"), F.count_if(profit < 0).alias("down"),
        F.coalesce(F.sum(F.when(profit > 0, profit)), F.lit(0.0)).alias("won"), F.coalesce(F.sum(F.when(profit < 0, -profit)), F.lit(0.0)).alias("lost"),
    )
    named = cells.where("r <> ''").select(F.col("r").alias("reason")).distinct().unionByName(rows.sparkSession.range(1).select(F.lit(None).cast("string").alias("reason")))
    ways = F.array(F.lit(True), F.lit(False))
    steps = lambda values: F.array(*[F.struct(F.lit(i + 1).alias("step"), F.lit(float(v)).alias("value")) for i, v in enumerate(values)])
    policies = named.select("reason", F.explode(steps(up)).alias("x")).select("*", F.explode(steps(even)).alias("y")).select("*", F.explode(steps(down)).alias("z")).select("*", F.explode(ways).alias("quality")).select("*", F.explode(ways).alias("inverted"))
    # each policy's own reason, or all; the other tests are inequalities of steps over a few hundred cells
    spread = cells.withColumn("as_reason", F.explode(F.array(F.lit(""), F.when(F.col("r") != "", F.col("r"))))).where("as_reason IS NOT NULL")
    on = (F.coalesce("reason", F.lit("")) == F.col("as_reason")) & (F.col("p") >= F.col("x.step")) & (F.col("c") >= F.col("y.step")) & (F.col("b") >= F.col("z.step")) & (~F.col("quality") | F.col("q"))
    names = [f.name for f in fields(Policy)]
    found = policies.join(spread, on, "left").groupBy(
        F.col("x.value").alias("least_profit"), F.col("y.value").alias("least_consistency"), F.col("z.value").alias("most_pullback"), "quality", "reason", "inverted"
    ).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "up", "down", "won", "lost")])
    turned = F.col("inverted")
    won, lost = F.when(turned, F.col("lost")).otherwise(F.col("won")), F.when(turned, F.col("won")).otherwise(F.col("lost"))
    factor = F.when(lost > 0, won / lost).when(won > 0, 999.0).otherwise(0.0)
    return found.select(*names, F.col("n").alias("taken"), F.when(turned, F.col("down")).otherwise(F.col("up")).alias("wins"), (won - lost).alias("net"), won.alias("won"), lost.alias("lost"), factor.alias("profit_factor"))


def best(policies: DataFrame, least: int = 24) -> Policy | None:
    """The policy of greatest profit factor among those that take at least so many rows; then of greatest net, then the strictest."""
    names = [f.name for f in fields(Policy)]
    order = [F.desc("profit_factor"), F.desc("net"), F.desc("least_profit"), F.desc("least_consistency"), "most_pullback", F.desc("quality"), F.col("reason").asc_nulls_last(), "inverted"]
    top = policies.where(F.col("taken") >= least).orderBy(*order).limit(1).collect()
    return Policy(**{n: top[0][n] for n in names}) if top else None


def held_stop(rows: DataFrame, order: str = "ts") -> DataFrame:
    """rows (symbol, order, candidate, side) with held (the most protective candidate before), allowed and stop.

    A long stop (side 1) only rises, a short one (-1) only falls; a candidate of zero or null is none, and
    without one held the first is allowed.
    """
    before = Window.partitionBy("symbol", "side").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    real = F.when(F.col("candidate") != 0, F.col("candidate"))
    held = F.when(F.col("side") == 1, F.max(real).over(before)).otherwise(F.min(real).over(before))
    better = F.when(F.col("side") == 1, real > F.col("held")).otherwise(real < F.col("held"))
    out = rows.withColumn("held", held)
    stop = F.when(F.col("side") == 1, F.greatest("held", real)).otherwise(F.least("held", real))
    return out.withColumns({"allowed": F.coalesce(real.isNotNull() & (F.col("held").isNull() | better), F.lit(False)), "stop": stop})

"""Backtests over a grid, and the streams run over what a table holds now."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.backtest import best, grid_backtest
from tidemark.plans.registry import Registry
from tidemark.sources.tables import clock_bars, table

query = Registry()


def _grid(spark: SparkSession) -> DataFrame:
    rows = [(f"{f}-{s}-{x}", f, s, x, 1.5 * x) for f in (3, 5, 8) for s in (13, 21, 34) for x in (0.05, 0.1, 0.2)]
    return spark.createDataFrame(rows, "param string, fast int, slow int, stop double, target double")


@query("grid_backtest")
def backtest_grid(spark, sf_dir):
    """A sequential simulation for each symbol and parameter set: held against a loop in the tests."""
    return grid_backtest(clock_bars(table(spark, sf_dir, "events")), _grid(spark))


@query("grid_best")
def grid_best(spark, sf_dir):
    return best(backtest_grid(spark, sf_dir))


ESTIMATE = """
    f AS (SELECT event_type AS symbol, ts, event_id, value AS entry, CASE WHEN event_id % 2 = 1 THEN 1 ELSE -1 END AS side, value - CASE WHEN event_id % 2 = 1 THEN 8.0 ELSE -8.0 END AS stop,
        value + CASE WHEN event_id % 2 = 1 THEN 12.0 ELSE -12.0 END AS target, 0.02 AS spread FROM events),
    s AS (SELECT *, greatest(spread * 0.5, 0.0) AS slip FROM f),
    e AS (SELECT *, entry + CASE WHEN side = 1 THEN spread + slip ELSE -slip END AS filled FROM s)"""


@query(
    "execution_cost",
    f"""WITH {ESTIMATE}
    SELECT event_id, side, round(filled, 6) AS filled, round(abs(target - filled) / greatest(abs(filled - stop), 1e-9), 6) AS reward_risk,
        round(spread / abs(entry - stop) * 0.45 + slip / abs(entry - stop) * 0.35 + greatest(0.0, (abs(filled - stop) - abs(entry - stop)) / abs(entry - stop)) * 0.15, 6) AS penalty,
        round((spread + slip) / greatest(abs(entry + CASE WHEN side = 1 THEN spread ELSE 0 END), 1e-9), 6) AS cost FROM e""",
)
def execution_cost(spark, sf_dir):
    """Fill, reward to risk, penalty and relative cost of a market order of each event, long on odd ids."""
    from tidemark.functions.scoring import execution

    side = F.when(F.col("event_id") % 2 == 1, 1).otherwise(-1)
    e = table(spark, sf_dir, "events").select("event_id", side.alias("side"), F.col("value").alias("entry"), (F.col("value") - 8.0 * side).alias("stop"), (F.col("value") + 12.0 * side).alias("target"))
    found = execution(F.col("side"), F.col("entry"), F.col("stop"), F.col("target"), F.col("entry"), F.col("entry") + 0.02, F.lit(0.02), F.lit(0.0))
    return e.select("event_id", "side", *[v.alias(k) for k, v in found.items()])


@query(
    "utility_action",
    """WITH x AS (SELECT event_id, (value - 100) / 1000 AS mu, 1 / (1 + exp(-(value - 100) / 50)) AS omega FROM events),
        c AS (SELECT *, -least(0.02, 0.1) * omega * mu - least(0.02, 0.1) * omega * 0.002 AS sell, 0.0 AS hold, least(0.02, 0.1) * omega * mu - least(0.02, 0.1) * omega * 0.002 AS buy FROM x)
    SELECT event_id, round(omega, 6) AS omega, round(buy, 8) AS buy_value, round(sell, 8) AS sell_value, CASE WHEN sell > hold AND sell >= buy THEN -1 WHEN buy > hold AND buy > sell THEN 1 ELSE 0 END AS action FROM c""",
    8,
)
def utility_action(spark, sf_dir):
    """The action of best certainty-equivalent value for an expected return and a quality signal."""
    from tidemark.functions.scoring import actions, sigmoid

    mu, signal = (F.col("value") - 100) / 1000, (F.col("value") - 100) / 50
    omega = sigmoid(signal)
    found = actions(mu, omega, kelly=0.1, most=0.02, cost=0.002)
    return table(spark, sf_dir, "events").select("event_id", F.round(omega, 6).alias("omega"), found["buy"].alias("buy_value"), found["sell"].alias("sell_value"), found["action"].alias("action"))

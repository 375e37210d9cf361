"""Queries of entry policies and stops; with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import indicators as ind
from tidemark.operators import policies as P
from tidemark.operators.bars import series
from tidemark.plans.market import BARS, TR, _frame, _tr
from tidemark.plans.registry import Registry
from tidemark.sources.tables import table

query = Registry()

ROWS = """j AS (SELECT event_id, value / 500 AS estimate, (event_id * 7 % 100) / 100 AS consistency, (event_id * 13 % 101) / 100 AS pullback, user_id % 2 = 0 AS quality, event_type AS reason, CASE WHEN event_id % 2 = 1 THEN value - 50 ELSE 50 - value END AS profit FROM events)"""
GRID = f"""x AS (SELECT unnest([0.0, 0.03, 0.05, 0.07, 0.10]) AS least_profit), y AS (SELECT unnest([0.0, 0.55, 0.60, 0.67, 0.75]) AS least_consistency), z AS (SELECT unnest([1.0, 0.75, 0.65, 0.5, 0.35]) AS most_pullback), b AS (SELECT unnest([true, false]) AS v),
        n AS (SELECT DISTINCT reason FROM j UNION ALL SELECT NULL), p AS (SELECT CAST(least_profit AS DOUBLE) AS least_profit, CAST(least_consistency AS DOUBLE) AS least_consistency, CAST(most_pullback AS DOUBLE) AS most_pullback, q.v AS quality, reason, i.v AS inverted FROM x, y, z, b q, b i, n),
        s AS (SELECT p.*, count(j.event_id) AS taken, count_if(CASE WHEN inverted THEN profit < 0 ELSE profit > 0 END) AS wins, coalesce(sum(greatest(CASE WHEN inverted THEN -profit ELSE profit END, 0)), 0.0) AS won, coalesce(sum(greatest(CASE WHEN inverted THEN profit ELSE -profit END, 0)), 0.0) AS lost
              FROM p LEFT JOIN j ON estimate >= least_profit AND consistency >= least_consistency AND pullback <= most_pullback AND (NOT p.quality OR j.quality) AND (p.reason IS NULL OR p.reason = j.reason) GROUP BY ALL),
        f AS (SELECT *, won - lost AS net, CASE WHEN lost > 0 THEN won / lost WHEN won > 0 THEN 999.0 ELSE 0.0 END AS profit_factor FROM s)"""


def _rows(spark, sf_dir) -> DataFrame:
    """Events as journal rows: estimate, consistency, pullback, quality and reason by fixed rules, and a profit."""
    e = table(spark, sf_dir, "events")
    profit = F.when(F.col("event_id") % 2 == 1, F.col("value") - 50).otherwise(50 - F.col("value"))
    return e.select("event_id", (F.col("value") / 500).alias("estimate"), (F.col("event_id") * 7 % 100 / 100).alias("consistency"), (F.col("event_id") * 13 % 101 / 100).alias("pullback"), (F.col("user_id") % 2 == 0).alias("quality"), F.col("event_type").alias("reason"), profit.alias("profit"))


@query("policy_results", f"WITH {ROWS}, {GRID} SELECT least_profit, least_consistency, most_pullback, quality, reason, inverted, taken, wins, round(net, 5) AS net, round(won, 5) AS won, round(lost, 5) AS lost, round(profit_factor, 5) AS profit_factor FROM f", digits=5)
def policy_results(spark, sf_dir):
    """What every policy of the grid would have taken of all events, and earned."""
    return P.grid(_rows(spark, sf_dir))


@query(
    "policy_gate",
    f"""WITH {ROWS}, {GRID}, t AS (SELECT * FROM f WHERE taken >= 24 ORDER BY profit_factor DESC, net DESC, least_profit DESC, least_consistency DESC, most_pullback, quality DESC, reason NULLS LAST, inverted LIMIT 1)
    SELECT event_id, CASE WHEN j.estimate >= least_profit AND j.consistency >= least_consistency AND j.pullback <= most_pullback AND (NOT t.quality OR j.quality) AND (t.reason IS NULL OR t.reason = j.reason) THEN 'shadow_policy_ok' ELSE 'shadow_policy_feature_reject' END AS gate FROM j, t""",
)
def policy_gate(spark, sf_dir):
    """What the best policy of the grid says of each event."""
    rows = _rows(spark, sf_dir)
    return rows.select("event_id", P.gate(True, P.best(P.grid(rows)), invert=True).alias("gate"))


@query(
    "held_stops",
    f"""WITH {BARS}, {TR}, s AS (SELECT symbol, ts, close, avg(tr) OVER {_frame(14)} AS atr FROM t), c AS (SELECT symbol, ts, side, nullif(close - side * 2 * atr, 0) AS candidate FROM s, (SELECT unnest([1, -1]) AS side) WHERE atr IS NOT NULL),
        h AS (SELECT *, CASE WHEN side = 1 THEN max(candidate) OVER w ELSE min(candidate) OVER w END AS held FROM c WINDOW w AS (PARTITION BY symbol, side ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT symbol, ts, side, round(held, 6) AS held, coalesce(candidate IS NOT NULL AND (held IS NULL OR side * candidate > side * held), false) AS allowed, round(CASE WHEN side = 1 THEN greatest(held, candidate) ELSE least(held, candidate) END, 6) AS stop FROM h""",
)
def held_stops(spark, sf_dir):
    """Stops of both sides two mean ranges off each close: they never fall back from the most protective one so far."""
    s = _tr(spark, sf_dir).select("symbol", "ts", "close", ind.atr(series(), 14).alias("atr")).where("atr IS NOT NULL")
    sides = s.withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1))))
    rows = sides.select("symbol", "ts", "side", (F.col("close") - F.col("side") * 2 * F.col("atr")).alias("candidate"))
    return P.held_stop(rows).drop("candidate")

"""More market queries: frames across widths, drawdown, exposure, zones and drives."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import indicators as ind
from tidemark.operators import joins as J
from tidemark.operators.bars import group_bars, series
from tidemark.plans.market import BARS, DEALS, OHLC, _bars, _deals, _events, _frame
from tidemark.plans.registry import Registry

query = Registry()


@query(
    "drawdown",
    f"""WITH {DEALS}, e AS (SELECT account, ticket, ts, 1000 + sum(profit) OVER w AS equity FROM deals WINDOW w AS (PARTITION BY account ORDER BY ts, ticket ROWS UNBOUNDED PRECEDING)),
        p AS (SELECT *, greatest(1000.0, max(equity) OVER (PARTITION BY account ORDER BY ts, ticket ROWS UNBOUNDED PRECEDING)) AS peak FROM e)
    SELECT account, ticket, round(equity, 6) AS equity, round(peak, 6) AS peak, round(peak - equity, 6) AS drawdown, round((peak - equity) / peak / 0.2, 6) AS ratio,
           round(greatest(0.0, 1 - least(1.0, (peak - equity) / peak / 0.2)), 6) AS dampener FROM p""",
)
def drawdown(spark, sf_dir):
    """Equity of each account from 1000 on, its peak, the drawdown, its share of the allowed fifth, and the damping."""
    sofar = Window.partitionBy("account").orderBy("ts", "ticket").rowsBetween(Window.unboundedPreceding, 0)
    e = _deals(spark, sf_dir).withColumn("equity", 1000 + F.sum("profit").over(sofar))
    e = e.withColumn("peak", F.greatest(F.lit(1000.0), F.max("equity").over(sofar)))
    lost = F.col("peak") - F.col("equity")
    ratio = lost / F.col("peak") / 0.2
    return e.select("account", "ticket", "equity", "peak", lost.alias("drawdown"), ratio.alias("ratio"), F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), ratio)).alias("dampener"))


@query(
    "frame_alignment",
    f"""WITH {BARS}, h AS (SELECT symbol, max(ts) AS ts, last(close ORDER BY ts) AS close FROM (SELECT *, floor((row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1) / 4) AS g FROM bars) GROUP BY symbol, g HAVING count(*) = 4),
        m AS (SELECT symbol, ts, close - lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS move FROM h),
        b AS (SELECT symbol, ts, sign(close - lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS near FROM bars)
    SELECT b.symbol, b.ts, CAST(near AS DOUBLE) AS near, CAST(sign(m.move) AS DOUBLE) AS far, round(CAST((near + sign(m.move)) / 2 AS DOUBLE), 6) AS alignment FROM b ASOF LEFT JOIN m ON b.symbol = m.symbol AND m.ts <= b.ts""",
)
def frame_alignment(spark, sf_dir):
    """Sign of the last change of a bar and of the latest full group of four bars, and their mean."""
    bars = _bars(spark, sf_dir)
    wide = group_bars(bars, 4, stamp="last")
    moves = wide.select("symbol", "ts", (F.col("close") - F.lag("close").over(series())).alias("close"))
    near = bars.select("symbol", "ts", F.signum(F.col("close") - F.lag("close").over(series())).alias("near"))
    found = J.as_of(near.select("symbol", "ts"), moves, 0).select("symbol", "ts", F.signum("bar_close").alias("far"))
    return near.join(found, ["symbol", "ts"]).withColumn("alignment", (F.col("near") + F.col("far")) / 2)


PAIRS = [("click", "view", 0.8), ("click", "purchase", -0.3), ("view", "purchase", 0.5), ("view", "signup", 0.4)]


@query(
    "correlated_exposure",
    """WITH p AS (SELECT user_id AS account, event_type AS symbol, sum(CASE WHEN event_id % 2 = 1 THEN value ELSE -value END) AS size FROM events GROUP BY ALL),
        c AS (SELECT * FROM (VALUES ('click', 'view', 0.8), ('click', 'purchase', -0.3), ('view', 'purchase', 0.5), ('view', 'signup', 0.4)) x(a, b, r)),
        s AS (SELECT a, b, r FROM c UNION ALL SELECT b, a, r FROM c)
    SELECT p.account, p.symbol, round(p.size, 6) AS size, round(p.size + coalesce(sum(o.size * s.r), 0.0), 6) AS exposure FROM p LEFT JOIN s ON s.a = p.symbol LEFT JOIN p o ON o.account = p.account AND o.symbol = s.b GROUP BY p.account, p.symbol, p.size""",
)
def correlated_exposure(spark, sf_dir):
    """Signed size of each account's position, and with what correlated positions add, by a fixed table of pairs."""
    signed = F.when(F.col("event_id") % 2 == 1, F.col("value")).otherwise(-F.col("value"))
    p = _events(spark, sf_dir).groupBy(F.col("user_id").alias("account"), F.col("event_type").alias("symbol")).agg(F.sum(signed).alias("size"))
    both = spark.createDataFrame(PAIRS + [(b, a, r) for a, b, r in PAIRS], "symbol string, other string, r double")
    others = p.select("account", F.col("symbol").alias("other"), F.col("size").alias("beside"))
    near = p.join(F.broadcast(both), "symbol").join(others, ["account", "other"]).groupBy("account", "symbol").agg(F.sum(F.col("beside") * F.col("r")).alias("more"))
    return p.join(near, ["account", "symbol"], "left").select("account", "symbol", "size", (F.col("size") + F.coalesce("more", F.lit(0.0))).alias("exposure"))


@query(
    "swing_zones",
    f"""WITH {BARS}, s AS (SELECT *, lag(high) OVER w AS h0, lead(high) OVER w AS h2, lag(low) OVER w AS l0, lead(low) OVER w AS l2 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts))
    SELECT symbol, ts, CASE WHEN high > h0 AND high > h2 THEN 'supply' ELSE 'demand' END AS kind,
        round(CASE WHEN high > h0 AND high > h2 THEN greatest(open, close) ELSE low END, 6) AS zone_low, round(CASE WHEN high > h0 AND high > h2 THEN high ELSE least(open, close) END, 6) AS zone_high
    FROM s WHERE (high > h0 AND high > h2) OR (low < l0 AND low < l2)""",
)
def swing_zones(spark, sf_dir):
    """Zones at bars whose high (supply) or low (demand) goes beyond both neighbours: from the body to the extreme."""
    by = series()
    s = _bars(spark, sf_dir).withColumns({"h0": F.lag("high").over(by), "h2": F.lead("high").over(by), "l0": F.lag("low").over(by), "l2": F.lead("low").over(by)})
    top, bottom = (F.col("high") > F.col("h0")) & (F.col("high") > F.col("h2")), (F.col("low") < F.col("l0")) & (F.col("low") < F.col("l2"))
    low = F.when(top, F.greatest("open", "close")).otherwise(F.col("low"))
    high = F.when(top, F.col("high")).otherwise(F.least("open", "close"))
    return s.where(top | bottom).select("symbol", "ts", F.when(top, "supply").otherwise("demand").alias("kind"), low.alias("zone_low"), high.alias("zone_high"))


@query(
    "regimes",
    f"""WITH {BARS}, s AS (SELECT symbol, ts, high - low AS size, avg(high - low) OVER w AS usual, close - first_value(close) OVER w AS move, sum(high - low) OVER w AS path, count(*) OVER w AS n FROM bars WINDOW w AS {_frame(20)})
    SELECT symbol, ts, CASE WHEN n < 20 THEN 'unknown' WHEN size > 1.8 * usual THEN 'expansion' WHEN size < 0.5 * usual THEN 'compression' WHEN abs(move) > 0.25 * path THEN 'trend' ELSE 'pullback' END AS regime FROM s""",
)
def regimes(spark, sf_dir):
    frame = ind.last(series(), 20)
    size = F.col("high") - F.col("low")
    s = _bars(spark, sf_dir).select("symbol", "ts", size.alias("size"), F.avg(size).over(frame).alias("usual"), (F.col("close") - F.first("close").over(frame)).alias("move"), F.sum(size).over(frame).alias("path"), F.count(F.lit(1)).over(frame).alias("n"))
    kind = (
        F.when(F.col("n") < 20, "unknown")
        .when(F.col("size") > 1.8 * F.col("usual"), "expansion")
        .when(F.col("size") < 0.5 * F.col("usual"), "compression")
        .when(F.abs("move") > 0.25 * F.col("path"), "trend")
        .otherwise("pullback")
    )
    return s.select("symbol", "ts", kind.alias("regime"))


@query(
    "three_drives",
    f"""WITH {BARS}, t AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k, close < open AND abs(low - round(low / 25) * 25) <= 1.0 AS touch FROM bars),
        p AS (SELECT symbol, ts, k, lag(k, 1) OVER w AS k1, lag(k, 2) OVER w AS k2 FROM t WHERE touch WINDOW w AS (PARTITION BY symbol ORDER BY k))
    SELECT symbol, ts FROM p WHERE k2 + 1 < k1 AND k1 + 1 < k""",
)
def three_drives(spark, sf_dir):
    """Falling bars that touch a multiple of 25 within one, as the third of such in a row, each more than a bar apart."""
    t = _bars(spark, sf_dir).withColumn("k", F.row_number().over(series()))
    touch = (F.col("close") < F.col("open")) & (F.abs(F.col("low") - F.round(F.col("low") / 25) * 25) <= 1.0)
    by = Window.partitionBy("symbol").orderBy("k")
    p = t.where(touch).withColumns({"k1": F.lag("k", 1).over(by), "k2": F.lag("k", 2).over(by)})
    return p.where("k2 + 1 < k1 AND k1 + 1 < k").select("symbol", "ts")


@query(
    "outcome_statistics",
    f"""WITH {DEALS}, s AS (SELECT account, count(*) AS n, avg(CAST(profit > 0.5 AS DOUBLE)) AS p, coalesce(avg(profit) FILTER (WHERE profit > 0.5), 0.0) AS w, coalesce(-avg(profit) FILTER (WHERE profit < -0.5), 0.0) AS l FROM deals WHERE abs(profit) > 0.5 GROUP BY account)
    SELECT account, n, round(CASE WHEN n >= 8 THEN 0.65 * 0.5 + 0.35 * p ELSE 0.5 END, 6) AS win_rate, round(CASE WHEN n >= 8 THEN 0.7 + 0.3 * w ELSE 1.0 END, 6) AS avg_win, round(CASE WHEN n >= 8 THEN 0.7 + 0.3 * l ELSE 1.0 END, 6) AS avg_loss FROM s""",
)
def outcome_statistics(spark, sf_dir):
    """Win rate and mean win and loss beyond a cost of a half, blended with priors where there are eight or more."""
    profit = F.col("profit")
    s = _deals(spark, sf_dir).where(F.abs(profit) > 0.5).groupBy("account").agg(
        F.count(F.lit(1)).alias("n"), F.avg((profit > 0.5).cast("double")).alias("p"), F.coalesce(F.avg(F.when(profit > 0.5, profit)), F.lit(0.0)).alias("w"), F.coalesce(-F.avg(F.when(profit < -0.5, profit)), F.lit(0.0)).alias("l")
    )
    many = F.col("n") >= 8
    blend = lambda x, prior, own, weight, share: F.when(many, prior * weight + share * x).otherwise(own)
    return s.select("account", "n", blend(F.col("p"), 0.5, 0.5, 0.65, 0.35).alias("win_rate"), blend(F.col("w"), 1.0, 1.0, 0.7, 0.3).alias("avg_win"), blend(F.col("l"), 1.0, 1.0, 0.7, 0.3).alias("avg_loss"))


@query("top_volume", f"WITH {BARS} SELECT symbol, ts, {OHLC}, volume FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY volume DESC, ts) <= 3")
def top_volume(spark, sf_dir):
    """The three busiest bars of each symbol, the earlier first on a tie."""
    by = Window.partitionBy("symbol").orderBy(F.desc("volume"), "ts")
    return _bars(spark, sf_dir).withColumn("k", F.row_number().over(by)).where("k <= 3").drop("k")

"""Market queries and the DuckDB SQL that gives the same rows. Doubles are rounded alike in both, to six digits mostly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import indicators as ind
from tidemark.operators import bars as B
from tidemark.operators import joins as J
from tidemark.operators import metrics as M
from tidemark.operators import patterns as P
from tidemark.operators.bars import series
from tidemark.plans.registry import Registry
from tidemark.sources.tables import clock_bars, deals, table, ticks

query = Registry()

BARS = """
    bars AS (
        SELECT symbol, b AS ts, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
               last(value ORDER BY ts, event_id) AS close, count(*) AS volume
        FROM (SELECT event_type AS symbol, time_bucket(INTERVAL '15 minutes', ts) AS b, ts, event_id, value FROM events)
        GROUP BY symbol, b)"""
DEALS = """
    deals AS (
        SELECT event_id AS ticket, user_id AS account, event_type AS symbol, ts,
               CASE WHEN event_id % 2 = 1 THEN value - 100 ELSE 100 - value END AS profit
        FROM events)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clock_bars(_events(spark, sf_dir))


def _deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deals(_events(spark, sf_dir))


OHLC = "round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close"


@query("bars_15m", f"WITH {BARS} SELECT symbol, ts, {OHLC}, volume FROM bars")
def bars_15m(spark, sf_dir):
    return _bars(spark, sf_dir)


def _grouped(place: str, stamp: str, n: int, partial: bool = False) -> str:
    return f"""WITH {BARS}, g AS (
        SELECT *, floor((row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 + {place}) / {n}) AS g
        FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS whole FROM bars)), r AS (
        SELECT symbol, {stamp}(ts) AS ts, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low,
               last(close ORDER BY ts) AS close, CAST(sum(volume) AS BIGINT) AS volume, count(*) AS n_bars
        FROM g GROUP BY symbol, g {"" if partial else f"HAVING count(*) = {n}"})
        SELECT symbol, ts, {OHLC}, volume, n_bars FROM r"""


@query("bars_group_start", _grouped("0", "min", 4))
def bars_group_start(spark, sf_dir):
    return B.group_bars(_bars(spark, sf_dir), 4)


@query("bars_group_end", _grouped("(4 - whole % 4) % 4", "min", 4))
def bars_group_end(spark, sf_dir):
    return B.group_bars(_bars(spark, sf_dir), 4, anchor="end")


@query("bars_pairs_last", _grouped("(2 - whole % 2) % 2", "max", 2))
def bars_pairs_last(spark, sf_dir):
    return B.group_bars(_bars(spark, sf_dir), 2, anchor="end", stamp="last")


@query("bars_group_ragged", _grouped("0", "min", 5, True))
def bars_group_ragged(spark, sf_dir):
    return B.group_bars(_bars(spark, sf_dir), 5, partial=True)


@query(
    "bars_stride",
    f"""WITH {BARS}, o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ord FROM bars)
    SELECT symbol, ts, {OHLC}, volume, ord FROM o WHERE ord % 3 = 0""",
)
def bars_stride(spark, sf_dir):
    return B.every_kth(_bars(spark, sf_dir), 3)


@query(
    "session_gap",
    f"""WITH {BARS}, p AS (
        SELECT symbol, ts, lag(ts) OVER w AS before, lag(close) OVER w AS close_before, open,
               date_diff('microsecond', lag(ts) OVER w, ts) / 60000000.0 AS gap_minutes
        FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts))
    SELECT symbol, before, ts, round(close_before, 6) AS close_before, round(open, 6) AS open, round(CAST(gap_minutes AS DOUBLE), 6) AS gap_minutes
    FROM p WHERE gap_minutes > 30 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1""",
)
def session_gap(spark, sf_dir):
    return B.last_gap(_bars(spark, sf_dir))


TR = """tr AS (
    SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS before FROM bars), t AS (
    SELECT *, CASE WHEN before IS NOT NULL THEN greatest(high - low, abs(high - before), abs(low - before)) END AS tr,
           close - before AS change, CASE WHEN before <> 0 THEN close / before - 1 END AS ret FROM tr)"""


def _tr(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("close").over(series())
    return _bars(spark, sf_dir).withColumns(
        {"before": before, "tr": ind.true_range(series()), "change": F.col("close") - before, "ret": F.when(before != 0, F.col("close") / before - 1)}
    )


def _frame(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


@query("atr14", f"WITH {BARS}, {TR} SELECT symbol, ts, round(tr, 6) AS tr, round(avg(tr) OVER {_frame(14)}, 6) AS atr FROM t")
def atr14(spark, sf_dir):
    return _tr(spark, sf_dir).select("symbol", "ts", "tr", ind.atr(series(), 14).alias("atr"))


@query(
    "rsi14",
    f"""WITH {BARS}, {TR}, g AS (
        SELECT symbol, ts, avg(greatest(change, 0)) OVER w AS gain, avg(greatest(-change, 0)) OVER w AS loss, count(change) OVER w AS n
        FROM t WINDOW w AS {_frame(14)})
    SELECT symbol, ts,
        round(CASE WHEN n < 14 THEN 50.0 WHEN loss <= 0 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + gain / loss) END, 6) AS rsi,
        round(CASE WHEN n < 14 THEN 50.0 WHEN loss <= 0 THEN CASE WHEN gain > 0 THEN 100.0 ELSE 50.0 END ELSE 100.0 - 100.0 / (1.0 + gain / loss) END, 6) AS rsi_flat
    FROM g""",
)
def rsi14(spark, sf_dir):
    t = _tr(spark, sf_dir)
    return t.select("symbol", "ts", ind.rsi(series(), 14).alias("rsi"), ind.rsi(series(), 14, "gain").alias("rsi_flat"))


@query(
    "zscore100",
    f"""WITH {BARS}, {TR}, s AS (
        SELECT symbol, ts, close, volume, tr, avg(close) OVER w AS m, stddev_pop(close) OVER w AS s, avg(volume) OVER w AS mv,
               stddev_pop(volume) OVER w AS sv FROM t WINDOW w AS {_frame(100)})
    SELECT symbol, ts, round((close - m) / CASE WHEN s > 0 THEN s ELSE 1.0 END, 6) AS close_z,
           round((volume - mv) / CASE WHEN sv > 0 THEN sv ELSE 1.0 END, 6) AS volume_z FROM s""",
)
def zscore100(spark, sf_dir):
    return _bars(spark, sf_dir).select("symbol", "ts", ind.zscore("close", series()).alias("close_z"), ind.zscore("volume", series()).alias("volume_z"))


@query(
    "trend_shape",
    f"""WITH {BARS}, f AS (
        SELECT *, first_value(close) OVER w12 AS c12, sum(abs(high - low)) OVER w12 AS r12, first_value(close) OVER w20 AS c20, sum(abs(high - low)) OVER w20 AS r20
        FROM bars WINDOW w12 AS {_frame(12)}, w20 AS {_frame(20)})
    SELECT symbol, ts, round(greatest(-1.0, least(1.0, (close - c12) / greatest(r12, 1e-9))), 6) AS slope,
           round(greatest(0.0, least(1.0, abs(close - c20) / greatest(r20, 1e-9))), 6) AS adx,
           round(greatest(0.0, least(1.0, abs(close - open) / greatest(abs(high - low), 1e-9))), 6) AS body FROM f""",
)
def trend_shape(spark, sf_dir):
    return _bars(spark, sf_dir).select("symbol", "ts", ind.slope_score(series()).alias("slope"), ind.adx_proxy(series()).alias("adx"), ind.body_efficiency().alias("body"))


@query(
    "range_percentile",
    f"""WITH {BARS}, r AS (SELECT symbol, ts, high - low AS size FROM bars),
        l AS (SELECT *, list(size) OVER {_frame(40)} AS frame FROM r)
    SELECT symbol, ts, round(len(list_filter(frame, lambda v: v <= size)) / len(frame), 6) AS percentile FROM l""",
)
def range_percentile(spark, sf_dir):
    r = _bars(spark, sf_dir).withColumn("size", F.col("high") - F.col("low"))
    return r.select("symbol", "ts", ind.percentile_rank("size", series(), 40).alias("percentile"))


@query(
    "sign_entropy",
    f"""WITH {BARS}, {TR}, s AS (
        SELECT symbol, ts, count(ret) OVER w AS n, CAST(coalesce(sum(CAST(ret > 0 AS INT)) OVER w, 0) AS DOUBLE) AS u,
               CAST(coalesce(sum(CAST(ret < 0 AS INT)) OVER w, 0) AS DOUBLE) AS d FROM t WINDOW w AS {_frame(30)})
    SELECT symbol, ts, round(CASE WHEN n < 5 THEN 0.0 WHEN u + d = 0 THEN 1.0 ELSE
        CASE WHEN u > 0 THEN -(u / (u + d)) * log2(u / (u + d)) ELSE 0.0 END + CASE WHEN d > 0 THEN -(d / (u + d)) * log2(d / (u + d)) ELSE 0.0 END END, 6) AS entropy FROM s""",
)
def sign_entropy(spark, sf_dir):
    return _tr(spark, sf_dir).select("symbol", "ts", ind.sign_entropy("ret", series(), 30).alias("entropy"))


@query(
    "mean_reversion",
    f"""WITH {BARS}, {TR}, s AS (
        SELECT symbol, ts, count(before) OVER w AS n, regr_slope(close, before) OVER w AS slope, var_pop(before) OVER w AS v FROM t WINDOW w AS {_frame(60)})
    SELECT symbol, ts, round(CASE WHEN n < 20 OR v < 1e-12 THEN 0.0 ELSE greatest(0.0, 1 - slope) END, 6) AS speed FROM s""",
)
def mean_reversion(spark, sf_dir):
    """Speed at which the close returns: one minus the slope of the close on the one before, over 60 pairs."""
    frame = ind.last(series(), 60)
    t = _tr(spark, sf_dir)
    slope = F.covar_pop("close", "before").over(frame) / F.var_pop("before").over(frame)
    speed = F.when((F.count("before").over(frame) < 20) | (F.var_pop("before").over(frame) < 1e-12), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - slope))
    return t.select("symbol", "ts", speed.alias("speed"))


HURST_LAGS = tuple(range(2, 20))


@query(
    "hurst",
    f"""WITH {BARS}, o AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM bars),
        d AS (SELECT a.symbol, g.lag, sqrt(stddev_pop(a.close - b.close)) AS tau
              FROM range(2, 20) g(lag) JOIN o a ON true JOIN o b ON a.symbol = b.symbol AND b.k = a.k - g.lag GROUP BY ALL)
    SELECT symbol, round(greatest(0.0, least(2.0, 2 * regr_slope(ln(tau), ln(lag)))), 6) AS hurst FROM d WHERE tau > 0 GROUP BY symbol""",
)
def hurst(spark, sf_dir):
    """Twice the slope of the log spread of differences on the log lag, lags 2 to 19, over all bars of a symbol."""
    steps = [(F.col("close") - F.lag("close", k).over(series())).alias(f"d{k}") for k in HURST_LAGS]
    spread = [F.sqrt(F.stddev_pop(f"d{k}")).alias(f"d{k}") for k in HURST_LAGS]
    taus = _bars(spark, sf_dir).select("symbol", *steps).groupBy("symbol").agg(*spread)
    rows = F.explode(F.array(*[F.struct(F.lit(float(k)).alias("lag"), F.col(f"d{k}").alias("tau")) for k in HURST_LAGS]))
    long = taus.select("symbol", rows.alias("x")).select("symbol", "x.*").where("tau > 0")
    return long.groupBy("symbol").agg(F.greatest(F.lit(0.0), F.least(F.lit(2.0), 2 * F.regr_slope(F.log("tau"), F.log("lag")))).alias("hurst"))


@query(
    "autocorrelation",
    f"""WITH {BARS}, {TR}, p AS (SELECT symbol, ts, ret, lag(ret) OVER (PARTITION BY symbol ORDER BY ts) AS r1 FROM t),
        k AS (SELECT *, count(ret * r1) OVER w AS n, corr(ret, r1) OVER w AS c FROM p WINDOW w AS {_frame(30)})
    SELECT symbol, ts, round(CASE WHEN n < 10 THEN 0.0 ELSE coalesce(c, 0.0) END, 5) AS autocorrelation FROM k""",
)
def autocorrelation(spark, sf_dir):
    p = _tr(spark, sf_dir).withColumn("r1", F.lag("ret").over(series()))
    enough = F.count(F.col("ret") * F.col("r1")).over(ind.last(series(), 30)) >= 10
    value = F.when(enough, ind.autocorrelation("ret", "r1", series(), 30)).otherwise(0.0)
    return p.select("symbol", "ts", F.round(value, 5).alias("autocorrelation"))


@query(
    "structure_score",
    f"""WITH {BARS}, s AS (
        SELECT symbol, ts, high, low, close, count(*) OVER w20 AS n, max(high) OVER p AS top, min(low) OVER p AS bottom
        FROM bars WINDOW w20 AS {_frame(20)}, p AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING))
    SELECT symbol, ts, round(CASE WHEN n < 12 THEN 0.0 ELSE greatest(-1.0, least(1.0,
        0.45 * CASE WHEN close > top THEN 1 WHEN close < bottom THEN -1 ELSE 0 END
        + 0.30 * CASE WHEN high > top AND close < top THEN -0.7 WHEN low < bottom AND close > bottom THEN 0.7 ELSE 0 END
        + 0.15 * greatest(-1.0, least(1.0, (close - (top + bottom) / 2) / greatest(top - bottom, 1e-9))))) END, 6) AS score FROM s""",
)
def structure_score(spark, sf_dir):
    """Breakout, sweep and place of the close in the range of the 19 bars before."""
    past = series().rowsBetween(-19, -1)
    s = _bars(spark, sf_dir).withColumns({"top": F.max("high").over(past), "bottom": F.min("low").over(past), "n": F.count(F.lit(1)).over(ind.last(series(), 20))})
    c, top, bottom = F.col("close"), F.col("top"), F.col("bottom")
    out = F.when(c > top, 1.0).when(c < bottom, -1.0).otherwise(0.0)
    sweep = F.when((F.col("high") > top) & (c < top), -0.7).when((F.col("low") < bottom) & (c > bottom), 0.7).otherwise(0.0)
    magnet = ind.clamp((c - (top + bottom) / 2) / F.greatest(top - bottom, F.lit(1e-9)))
    score = F.when(F.col("n") < 12, 0.0).otherwise(ind.clamp(0.45 * out + 0.30 * sweep + 0.15 * magnet))
    return s.select("symbol", "ts", score.alias("score"))


@query(
    "volume_score",
    f"""WITH {BARS}, s AS (SELECT symbol, ts, open, close, volume, avg(volume) OVER w AS m, stddev_pop(volume) OVER w AS s, count(*) OVER w AS n,
        greatest(0.0, least(1.0, abs(close - open) / greatest(abs(high - low), 1e-9))) AS body FROM bars WINDOW w AS {_frame(20)})
    SELECT symbol, ts, round(CASE WHEN n < 20 THEN 0.0 ELSE greatest(-1.0, least(1.0, (volume - m) / greatest(s, 1.0) / 3.0 * CASE WHEN close >= open THEN 1 ELSE -1 END)) END, 6) AS score,
           round(volume / m * body, 6) AS enhanced FROM s""",
)
def volume_score(spark, sf_dir):
    """Volume against its last 20 values, signed by the body; and volume over its mean times body efficiency."""
    frame = ind.last(series(), 20)
    mean, dev = F.avg("volume").over(frame), F.stddev_pop("volume").over(frame)
    sign = F.when(F.col("close") >= F.col("open"), 1.0).otherwise(-1.0)
    score = ind.clamp((F.col("volume") - mean) / F.greatest(dev, F.lit(1.0)) / 3.0 * sign)
    score = F.when(F.count(F.lit(1)).over(frame) < 20, 0.0).otherwise(score)
    return _bars(spark, sf_dir).select("symbol", "ts", score.alias("score"), (F.col("volume") / mean * ind.body_efficiency()).alias("enhanced"))


@query(
    "volatility_state",
    f"""WITH {BARS}, {TR}, s AS (
        SELECT symbol, ts, avg(tr) OVER w3 AS atr3, avg(tr) OVER w6 AS atr6, max(high) OVER w6 - min(low) OVER w6 AS realized,
               sum(abs(close - open)) OVER w6 AS body, sum(greatest(high - low, 0)) OVER w6 AS size
        FROM t WINDOW w3 AS {_frame(3)}, w6 AS {_frame(6)})
    SELECT symbol, ts, round(atr3, 6) AS short_atr, round(atr6, 6) AS medium_atr, round(realized, 6) AS realized_range,
           round(CASE WHEN size > 0 THEN body / size ELSE 0.0 END, 6) AS body_efficiency, round(CASE WHEN atr6 > 0 THEN atr3 / atr6 ELSE 0.0 END, 6) AS expansion FROM s""",
)
def volatility_state(spark, sf_dir):
    w3, w6 = ind.last(series(), 3), ind.last(series(), 6)
    s = _tr(spark, sf_dir).select(
        "symbol", "ts", F.avg("tr").over(w3).alias("short_atr"), F.avg("tr").over(w6).alias("medium_atr"),
        (F.max("high").over(w6) - F.min("low").over(w6)).alias("realized_range"),
        F.sum(F.abs(F.col("close") - F.col("open"))).over(w6).alias("b"), F.sum(F.greatest(F.col("high") - F.col("low"), F.lit(0.0))).over(w6).alias("s"),
    )
    return s.select(
        "symbol", "ts", "short_atr", "medium_atr", "realized_range",
        F.when(F.col("s") > 0, F.col("b") / F.col("s")).otherwise(0.0).alias("body_efficiency"),
        F.when(F.col("medium_atr") > 0, F.col("short_atr") / F.col("medium_atr")).otherwise(0.0).alias("expansion"),
    )


WEIGHTS = ind.ewm_weights(20)


@query(
    "ewm_returns",
    f"""WITH {BARS}, {TR}, l AS (SELECT symbol, ts, list(ret) OVER {_frame(20)} AS r, count(ret) OVER {_frame(20)} AS n FROM t),
        m AS (SELECT symbol, ts, r, list_sum(list_transform(r, lambda x, i: x * {WEIGHTS}[i])) AS mean FROM l WHERE n = 20)
    SELECT symbol, ts, round(mean, 6) AS mean, round(sqrt(list_sum(list_transform(r, lambda x, i: (x - mean) * (x - mean) * {WEIGHTS}[i]))), 6) AS dev FROM m""",
)
def ewm_returns(spark, sf_dir):
    """Exponentially weighted mean and deviation of the last 20 returns, where there are as many."""
    frame, weights = ind.last(series(), 20), F.array(*[F.lit(w) for w in WEIGHTS])
    t = _tr(spark, sf_dir).select("symbol", "ts", F.collect_list("ret").over(frame).alias("r")).where(F.size("r") == 20)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    t = t.withColumn("mean", total(F.zip_with("r", weights, lambda x, w: x * w)))
    dev = F.sqrt(total(F.zip_with("r", weights, lambda x, w: (x - F.col("mean")) * (x - F.col("mean")) * w)))
    return t.select("symbol", "ts", "mean", dev.alias("dev"))


@query(
    "bar_folds",
    f"""WITH RECURSIVE {BARS}, o AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k, count(*) OVER (PARTITION BY symbol) AS whole FROM bars),
        r AS (SELECT symbol, ts, close, k, whole, close AS e12, close AS e20, close AS e26, CAST(0.0 AS DOUBLE) AS s FROM o WHERE k = 1
              UNION ALL SELECT o.symbol, o.ts, o.close, o.k, o.whole, e12 + (o.close - e12) * 2 / 13, e20 + (o.close - e20) * 2 / 21, e26 + (o.close - e26) * 2 / 27,
                  s + (e12 + (o.close - e12) * 2 / 13 - e26 - (o.close - e26) * 2 / 27 - s) * 0.2 FROM r JOIN o ON o.symbol = r.symbol AND o.k = r.k + 1)
    SELECT symbol, ts, round(close, 6) AS close, round(e12, 6) AS ema_12, round(e20, 6) AS ema_20, round(e26, 6) AS ema_26, CASE WHEN whole >= 35 THEN round(e12 - e26 - s, 6) END AS macd_histogram FROM r""",
)
def bar_folds(spark, sf_dir):
    """Exponential means and MACD, which recur from the first bar."""
    return B.folded(_bars(spark, sf_dir))


@query("parabolic_sar")
def parabolic_sar(spark, sf_dir):
    return B.parabolic_sar(_bars(spark, sf_dir))


@query(
    "volume_profile",
    """WITH RECURSIVE p AS (SELECT event_type AS symbol, (value + (value + 0.02)) / 2 AS price FROM events), w AS (SELECT symbol, min(price) AS low, greatest((max(price) - min(price)) / 100, 1e-9) AS width FROM p GROUP BY symbol),
        n AS (SELECT symbol, low, width, CAST(least(floor((price - low) / width), 99) AS INT) AS bin, count(*) AS v FROM p JOIN w USING (symbol) GROUP BY ALL),
        l AS (SELECT symbol, low, width, map(list(bin), list(v)) AS m FROM n GROUP BY symbol, low, width), v AS (SELECT symbol, low, width, list_transform(range(100), lambda i: coalesce(m[CAST(i AS INT)], 0)) AS v FROM l),
        r AS (SELECT symbol, low, width, v, list_position(v, list_max(v)) - 1 AS poc, list_position(v, list_max(v)) - 1 AS a, list_position(v, list_max(v)) - 1 AS b FROM v
              UNION ALL SELECT symbol, low, width, v, poc, CASE WHEN up >= down THEN a ELSE a - 1 END, CASE WHEN up >= down THEN b + 1 ELSE b END
              FROM (SELECT *, CASE WHEN b + 1 < 100 THEN v[b + 2] ELSE -1 END AS up, CASE WHEN a > 0 THEN v[a] ELSE -1 END AS down FROM r WHERE list_sum(v[a + 1 : b + 1]) < CAST(0.7 AS DOUBLE) * list_sum(v)))
    SELECT symbol, round(low + (poc + 0.5) * width, 6) AS poc, round(low + (b + 0.5) * width, 6) AS vah, round(low + (a + 0.5) * width, 6) AS val FROM r QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY b - a DESC) = 1""",
)
def volume_profile(spark, sf_dir):
    return B.volume_profile(ticks(_events(spark, sf_dir)))


@query(
    "order_blocks",
    f"""WITH {BARS}, s AS (
        SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) - 1 AS since, close - open AS body,
               lead(close) OVER w - lead(open) OVER w AS after, lead(volume) OVER w AS nv FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts))
    SELECT symbol, ts, CASE WHEN body < 0 THEN 1 ELSE -1 END AS direction, round(low, 6) AS price_low, round(high, 6) AS price_high,
           round(abs(body) / greatest(high - low, 1e-9), 6) AS strength, round(CASE WHEN volume > 0 THEN nv / volume ELSE 1.0 END, 6) AS imbalance, since AS bars_since
    FROM s WHERE since BETWEEN 1 AND 50 AND ((body < 0 AND after > 0 AND after > -body * 1.5) OR (body > 0 AND after < 0 AND -after > body * 1.5))""",
)
def order_blocks(spark, sf_dir):
    return P.order_blocks(_bars(spark, sf_dir))


GAPS = """gaps AS (
        SELECT symbol, ts, CASE WHEN l2 > h0 THEN 1 ELSE -1 END AS direction, CASE WHEN l2 > h0 THEN l2 ELSE l0 END AS top,
               CASE WHEN l2 > h0 THEN h0 ELSE h2 END AS bottom, since AS bars_since
        FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) - 1 AS since, lag(high) OVER w AS h0, lag(low) OVER w AS l0,
                     lead(high) OVER w AS h2, lead(low) OVER w AS l2 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts))
        WHERE since BETWEEN 1 AND 20 AND (l2 > h0 OR h2 < l0))"""


@query("fair_value_gaps", f"WITH {BARS}, {GAPS} SELECT symbol, ts, direction, round(top, 6) AS top, round(bottom, 6) AS bottom, bars_since FROM gaps")
def fair_value_gaps(spark, sf_dir):
    return P.fair_value_gaps(_bars(spark, sf_dir))


@query(
    "nearest_gap",
    f"""WITH {BARS}, {GAPS}, p AS (SELECT symbol, last(close ORDER BY ts) AS price FROM bars GROUP BY symbol),
        d AS (SELECT p.symbol, price, (top + bottom) / 2 AS middle, abs(price - (top + bottom) / 2) AS distance FROM p JOIN gaps USING (symbol))
    SELECT symbol, round(price, 6) AS price, round(middle, 6) AS middle, round(distance, 6) AS distance FROM d
    QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY d.distance, d.middle) = 1""",
)
def nearest_gap(spark, sf_dir):
    bars = _bars(spark, sf_dir)
    return J.nearest_gap(bars.groupBy("symbol").agg(F.max_by("close", "ts").alias("price")), P.fair_value_gaps(bars))


@query(
    "candlesticks",
    f"""WITH {BARS}, s AS (
        SELECT symbol, ts, open AS o, close AS c, high, low, lag(open) OVER w AS o1, lag(close) OVER w AS c1, lag(high) OVER w AS h1, lag(low) OVER w AS l1,
               lag(open, 2) OVER w AS o2, lag(close, 2) OVER w AS c2, greatest(high - low, 1e-9) AS size, avg(greatest(high - low, 1e-9)) OVER {_frame(10)} AS usual
        FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts))
    SELECT symbol, ts, CASE
        WHEN c1 IS NULL THEN 'none'
        WHEN c2 < o2 AND abs(c1 - o1) <= 0.4 * greatest(h1 - l1, 1e-9) AND c > o AND c >= (o2 + c2) / 2 THEN 'morning_star'
        WHEN c2 > o2 AND abs(c1 - o1) <= 0.4 * greatest(h1 - l1, 1e-9) AND c < o AND c <= (o2 + c2) / 2 THEN 'evening_star'
        WHEN c1 < o1 AND c > o AND c >= o1 AND o <= c1 THEN 'bullish_engulfing'
        WHEN c1 > o1 AND c < o AND c <= o1 AND o >= c1 THEN 'bearish_engulfing'
        WHEN least(o, c) - low >= 0.55 * size AND abs(c - o) <= 0.35 * size THEN 'bullish_pinbar'
        WHEN high - greatest(o, c) >= 0.55 * size AND abs(c - o) <= 0.35 * size THEN 'bearish_pinbar'
        WHEN abs(c - o) >= 0.7 * size AND size >= 1.25 * usual AND c > o THEN 'bullish_expansion'
        WHEN abs(c - o) >= 0.7 * size AND size >= 1.25 * usual AND c < o THEN 'bearish_expansion'
        ELSE 'none' END AS pattern FROM s""",
)
def candlesticks(spark, sf_dir):
    return P.candlesticks(_bars(spark, sf_dir))


@query(
    "breakouts",
    f"""WITH {BARS}, s AS (SELECT *, max(high) OVER p AS top, min(low) OVER p AS bottom FROM bars
        WINDOW p AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
    SELECT symbol, ts, CASE WHEN close > top THEN 'up' WHEN close < bottom THEN 'down' WHEN high > top THEN 'wick_up' WHEN low < bottom THEN 'wick_down' ELSE 'none' END AS breakout FROM s""",
)
def breakouts(spark, sf_dir):
    return P.breakouts(_bars(spark, sf_dir))


@query(
    "fibonacci",
    f"""WITH {BARS}, s AS (SELECT symbol, ts, close, min(low) OVER w AS lo, max(high) OVER w AS hi, arg_min(ts, (low, ts)) OVER w AS lt, arg_min(ts, (-high, ts)) OVER w AS ht
        FROM bars WINDOW w AS {_frame(40)}), b AS (
        SELECT symbol, ts, lo, hi, lt <= ht AS rises, CASE WHEN hi > lo THEN CASE WHEN lt <= ht THEN hi - close ELSE close - lo END / (hi - lo) END AS back FROM s)
    SELECT symbol, ts, CASE WHEN rises THEN 1 ELSE -1 END AS direction, CASE WHEN hi <= lo THEN 'flat' WHEN back < 0.382 THEN 'shallow'
        WHEN back <= 0.618 THEN 'golden' WHEN back <= 0.786 THEN 'deep' ELSE 'failed' END AS zone FROM b""",
)
def fibonacci(spark, sf_dir):
    return P.fibonacci(_bars(spark, sf_dir))


@query(
    "asof_closed_bar",
    f"""WITH {BARS}, d AS (SELECT event_type AS symbol, ts FROM events)
    SELECT d.symbol, d.ts, b.ts AS bar_ts, round(b.close, 6) AS bar_close FROM d
    ASOF LEFT JOIN (SELECT *, ts + INTERVAL '15 minutes' AS shut FROM bars) b ON d.symbol = b.symbol AND b.shut <= d.ts""",
)
def asof_closed_bar(spark, sf_dir):
    """Every event asks for the latest closed bar of its symbol."""
    return J.as_of(_events(spark, sf_dir).select(F.col("event_type").alias("symbol"), "ts"), _bars(spark, sf_dir), 15)


@query("asof_closed_bar_all")
def asof_closed_bar_all(spark, sf_dir):
    """asof_closed_bar under its former name."""
    return asof_closed_bar(spark, sf_dir)


@query(
    "signal_within_ttl",
    """WITH q AS (SELECT event_type AS symbol, ts FROM events WHERE event_id % 2 = 0), s AS (SELECT event_type AS symbol, ts, value FROM events WHERE event_id % 2 = 1)
    SELECT q.symbol, q.ts, CASE WHEN q.ts - s.ts <= INTERVAL '1 hour' THEN s.ts END AS signal_ts, CASE WHEN q.ts - s.ts <= INTERVAL '1 hour' THEN round(s.value, 6) END AS value
    FROM q ASOF LEFT JOIN s ON q.symbol = s.symbol AND s.ts <= q.ts""",
)
def signal_within_ttl(spark, sf_dir):
    """The events of even ids ask for the newest event of an odd id of their symbol; every event takes part."""
    e = _events(spark, sf_dir).withColumnRenamed("event_type", "symbol")
    return J.latest_within(e.where("event_id % 2 = 0").select("symbol", "ts"), e.where("event_id % 2 = 1").select("symbol", "ts", "value"), 3600)


@query("signal_within_ttl_all")
def signal_within_ttl_all(spark, sf_dir):
    """signal_within_ttl under its former name."""
    return signal_within_ttl(spark, sf_dir)


def _trades(e):
    side = F.when(F.col("event_id") % 2 == 1, 1).otherwise(-1)
    return e.select(F.col("event_type").alias("symbol"), "ts", side.alias("side"), F.col("value").alias("entry"), (F.col("value") - 8.0 * side).alias("stop"), (F.col("value") + 12.0 * side).alias("target")).distinct()


@query(
    "first_touch",
    f"""WITH {BARS}, o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS ord FROM bars),
        t AS (SELECT DISTINCT event_type AS symbol, ts, CASE WHEN event_id % 2 = 1 THEN 1 ELSE -1 END AS side, value AS entry,
              value - CASE WHEN event_id % 2 = 1 THEN 8.0 ELSE -8.0 END AS stop, value + CASE WHEN event_id % 2 = 1 THEN 12.0 ELSE -12.0 END AS target FROM events),
        s AS (SELECT t.*, unnest(range(o.ord, o.ord + 12)) AS step FROM t ASOF JOIN o ON t.symbol = o.symbol AND t.ts <= o.ts),
        b AS (SELECT s.*, o.ord, o.close, CASE WHEN (side = 1 AND o.low <= stop) OR (side = -1 AND o.high >= stop) THEN -1.0
              WHEN (side = 1 AND o.high >= target) OR (side = -1 AND o.low <= target) THEN abs(target - entry) / abs(entry - stop) END AS result
              FROM s JOIN o ON s.symbol = o.symbol AND o.ord = s.step),
    g AS (SELECT symbol, ts, side, entry, stop, target, count(*) AS n_bars, first(result ORDER BY ord) FILTER (WHERE result IS NOT NULL) AS hit,
              last(close ORDER BY ord) AS last FROM b GROUP BY symbol, ts, side, entry, stop, target)
    SELECT symbol, ts, side, round(entry, 6) AS entry, round(stop, 6) AS stop, round(target, 6) AS target, n_bars,
           round(coalesce(hit, side * (last - entry) / abs(entry - stop)), 6) AS outcome FROM g""",
)
def first_touch(spark, sf_dir):
    """A trade for every event: which of its levels the next twelve bars reach first."""
    return J.first_touch(_trades(_events(spark, sf_dir)), _bars(spark, sf_dir), 12)


@query("first_touch_all")
def first_touch_all(spark, sf_dir):
    """first_touch under its former name."""
    return first_touch(spark, sf_dir)


@query(
    "paired_trades",
    """WITH o AS (SELECT user_id AS id, ts, value AS price FROM events WHERE event_id % 2 = 0), c AS (SELECT user_id AS id, ts, value AS price FROM events WHERE event_id % 2 = 1)
    SELECT c.id, o.ts AS open_ts, c.ts AS close_ts, round(o.price, 6) AS open_price, round(c.price, 6) AS close_price FROM c ASOF JOIN o ON c.id = o.id AND o.ts <= c.ts""",
)
def paired_trades(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", F.col("user_id").alias("id"), "ts", F.col("value").alias("price"))
    return J.paired(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"))


PERFORMANCE = """SELECT {key}, count(*) AS trades, count_if(profit > 0) AS wins, count_if(profit < 0) AS losses, round(count_if(profit > 0) / count(*), 8) AS win_rate,
    round(sum(profit), 8) AS net, round(coalesce(sum(profit) FILTER (WHERE profit > 0), 0.0), 8) AS gross_profit, round(-coalesce(sum(profit) FILTER (WHERE profit < 0), 0.0), 8) AS gross_loss,
    round(CASE WHEN coalesce(-sum(profit) FILTER (WHERE profit < 0), 0) > 0 THEN coalesce(sum(profit) FILTER (WHERE profit > 0), 0.0) / -sum(profit) FILTER (WHERE profit < 0)
        WHEN coalesce(sum(profit) FILTER (WHERE profit > 0), 0) > 0 THEN 999.0 ELSE 0.0 END, 8) AS profit_factor, round(avg(profit), 8) AS expectancy,
    round(coalesce(avg(profit) FILTER (WHERE profit > 0), 0.0), 8) AS avg_win, round(coalesce(avg(profit) FILTER (WHERE profit < 0), 0.0), 8) AS avg_loss,
    round(coalesce(max(profit) FILTER (WHERE profit > 0), 0.0), 8) AS largest_win, round(coalesce(min(profit) FILTER (WHERE profit < 0), 0.0), 8) AS largest_loss
    FROM {source} GROUP BY {key}"""


@query("performance_by_symbol", f"WITH {DEALS} " + PERFORMANCE.format(key="symbol", source="deals"), 8)
def performance_by_symbol(spark, sf_dir):
    return M.performance(_deals(spark, sf_dir), "symbol")


@query("performance_by_account", f"WITH {DEALS} " + PERFORMANCE.format(key="account", source="deals"), 8)
def performance_by_account(spark, sf_dir):
    return M.performance(_deals(spark, sf_dir), "account")


@query("performance_by_day", f"WITH {DEALS} " + PERFORMANCE.format(key="day", source="(SELECT *, strftime(ts, '%Y.%m.%d') AS day FROM deals)"), 8)
def performance_by_day(spark, sf_dir):
    return M.performance(_deals(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy.MM.dd")), "day")


def _streak(rows: str) -> str:
    return f"""WITH {DEALS}, r AS (SELECT account, profit, sum(CAST(profit >= 0 AS INT)) OVER (PARTITION BY account ORDER BY ts, ticket ROWS UNBOUNDED PRECEDING) AS island FROM {rows}),
        k AS (SELECT account, island, count_if(profit < 0) AS run FROM r GROUP BY ALL) SELECT account, max(run) AS max_loss_streak FROM k GROUP BY account"""


@query("loss_streak", _streak("deals"))
def loss_streak(spark, sf_dir):
    return M.loss_streak(_deals(spark, sf_dir), "account", ["ts", "ticket"])


@query("loss_streak_zero_neutral", _streak("(SELECT account, ts, ticket, round(profit) AS profit FROM deals WHERE round(profit) <> 0)"))
def loss_streak_zero_neutral(spark, sf_dir):
    return M.loss_streak(_deals(spark, sf_dir).withColumn("profit", F.round("profit")), "account", ["ts", "ticket"], zero_resets=False)


@query(
    "equity_curve",
    f"""WITH {DEALS}, e AS (SELECT account, sum(profit) OVER w AS equity, row_number() OVER (PARTITION BY account ORDER BY ts, ticket) AS k FROM deals
        WINDOW w AS (PARTITION BY account ORDER BY ts, ticket ROWS UNBOUNDED PRECEDING)),
        p AS (SELECT *, greatest(max(equity) OVER (PARTITION BY account ORDER BY k ROWS UNBOUNDED PRECEDING), 0.0) AS peak FROM e)
    SELECT account, round(last(equity ORDER BY k), 6) AS ending, round(max(peak), 6) AS peak, round(max(peak - equity), 6) AS max_drawdown, min(k) FILTER (WHERE equity >= 50) AS first_goal FROM p GROUP BY account""",
)
def equity_curve(spark, sf_dir):
    return M.equity_curve(_deals(spark, sf_dir), "account", ["ts", "ticket"])


@query(
    "cvar",
    f"""WITH {DEALS}, r AS (SELECT account, profit, row_number() OVER (PARTITION BY account ORDER BY profit) AS k, count(*) OVER (PARTITION BY account) AS n FROM deals)
    SELECT account, round(greatest(-avg(profit), 0.0), 6) AS cvar FROM r WHERE k <= greatest(1, ceil(n * 0.05)) GROUP BY account""",
)
def cvar(spark, sf_dir):
    return M.cvar(_deals(spark, sf_dir), "account")


BUCKET = """SELECT {key} AS bucket, count(*) AS trades, count_if(profit > 0) AS wins, count_if(profit < 0) AS losses, round(sum(profit), 6) AS net, round(avg(profit), 6) AS avg,
    round(sum(-profit), 6) AS inverse_net, round(count_if(profit < 0) / count(*), 6) AS inverse_win_rate FROM deals GROUP BY 1"""


@query("bucket_by_symbol", f"WITH {DEALS} " + BUCKET.format(key="coalesce(nullif(trim(symbol), ''), 'missing')"))
def bucket_by_symbol(spark, sf_dir):
    return M.bucket_summary(_deals(spark, sf_dir), F.col("symbol"))


@query("bucket_by_hour", f"WITH {DEALS} " + BUCKET.format(key="CASE WHEN hour(ts) < 6 THEN 'night' WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 18 THEN 'afternoon' ELSE 'evening' END"))
def bucket_by_hour(spark, sf_dir):
    hour = M.bucket(F.hour("ts"), [6, 12, 18], ["night", "morning", "afternoon", "evening"])
    return M.bucket_summary(_deals(spark, sf_dir), hour)


@query(
    "sessions",
    f"""WITH {DEALS}, s AS (SELECT profit, hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS c, hour(ts) AS h FROM deals),
        k AS (SELECT profit, CASE WHEN c BETWEEN 43200 AND 57600 THEN 1.0 WHEN c BETWEEN 28800 AND 72000 THEN 0.8 WHEN c <= 28800 THEN 0.4 ELSE 0.2 END AS score,
              (h BETWEEN 7 AND 10) OR (h BETWEEN 12 AND 15) AS in_session FROM s)
    SELECT CAST(score AS DOUBLE) AS score, in_session, count(*) AS trades, round(sum(profit), 6) AS net FROM k GROUP BY ALL""",
)
def sessions(spark, sf_dir):
    d = _deals(spark, sf_dir)
    return d.groupBy(ind.session_score(F.col("ts")).alias("score"), ind.in_session(F.col("ts")).alias("in_session")).agg(F.count(F.lit(1)).alias("trades"), F.sum("profit").alias("net"))


def _policies(spark: SparkSession) -> DataFrame:
    grid = [(f"{a}-{b}", float(a), float(b)) for a in range(0, 100, 20) for b in range(a + 20, 220, 40)]
    return spark.createDataFrame(grid, "policy string, low double, high double")


@query(
    "policy_grid",
    """WITH deals AS (SELECT event_type AS symbol, value AS strength, CASE WHEN event_id % 2 = 1 THEN value - 100 ELSE 100 - value END AS profit FROM events),
        g AS (SELECT a || '-' || b AS policy, a, b FROM range(0, 100, 20) x(a), LATERAL (SELECT unnest(range(a + 20, 220, 40)) AS b))
    SELECT policy, symbol, count(*) AS trades, round(sum(profit), 6) AS net, round(CASE WHEN coalesce(-sum(profit) FILTER (WHERE profit < 0), 0) > 0
        THEN coalesce(sum(profit) FILTER (WHERE profit > 0), 0.0) / -sum(profit) FILTER (WHERE profit < 0) WHEN sum(profit) FILTER (WHERE profit > 0) > 0 THEN 999.0 ELSE 0.0 END, 6) AS profit_factor
    FROM deals JOIN g ON strength >= a AND strength < b GROUP BY policy, symbol""",
)
def policy_grid(spark, sf_dir):
    d = deals(_events(spark, sf_dir)).join(_events(spark, sf_dir).select(F.col("event_id").alias("ticket"), F.col("value").alias("strength")), "ticket")
    return M.policy_grid(d, _policies(spark), "symbol")


@query(
    "threshold_grid",
    """WITH r AS (SELECT event_type AS symbol, least(greatest(value / 200.0, 0.0), 1.0) AS score, CAST(event_id % 3 = 0 AS INT) AS label FROM events),
        g AS (SELECT k, 0.30 + 0.02 * k AS threshold FROM range(0, 31) x(k)),
        s AS (SELECT symbol, CAST(least(floor(round((score - 0.30) / 0.02, 9)), 30) AS INT) AS step, label FROM r WHERE score >= 0.30),
        a AS (SELECT y.symbol, g.k, count(s.step) AS taken, coalesce(sum(s.label), 0) AS hits FROM (SELECT DISTINCT symbol FROM r) y CROSS JOIN g LEFT JOIN s ON s.symbol = y.symbol AND s.step >= g.k GROUP BY ALL),
        p AS (SELECT *, CASE WHEN taken >= 5 THEN hits / taken ELSE 0.0 END AS precision FROM a)
    SELECT symbol, CAST(round(0.30 + 0.02 * k, 2) AS DOUBLE) AS threshold, round(CAST(precision AS DOUBLE), 6) AS precision, taken FROM p QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY p.precision DESC, k) = 1""",
)
def threshold_grid(spark, sf_dir):
    e = _events(spark, sf_dir)
    rows = e.select(F.col("event_type").alias("symbol"), F.least(F.greatest(F.col("value") / 200.0, F.lit(0.0)), F.lit(1.0)).alias("score"), (F.col("event_id") % 3 == 0).cast("int").alias("label"))
    return M.threshold_grid(rows, "symbol")


@query(
    "label_economics",
    f"""WITH {DEALS}, b AS (SELECT symbol, avg(CAST(profit > 0 AS DOUBLE)) AS p, coalesce(avg(profit) FILTER (WHERE profit > 0), 0.0) AS w, coalesce(-avg(profit) FILTER (WHERE profit < 0), 0.0) AS l FROM deals GROUP BY symbol),
        r AS (SELECT *, CASE WHEN l > 0 THEN w / l ELSE 0.0 END AS rr FROM b)
    SELECT symbol, round(p, 6) AS positive_rate, round(w, 6) AS avg_win, round(l, 6) AS avg_loss, round(rr, 6) AS reward_risk, round(CASE WHEN p > 0 THEN (1 - p) / p ELSE 0.0 END, 6) AS break_even,
        round(p * w - (1 - p) * l, 6) AS expected, round(CASE WHEN rr > 0 THEN greatest(0.0, least(1.0, (p * rr - (1 - p)) / rr)) ELSE 0.0 END, 6) AS kelly FROM r""",
)
def label_economics(spark, sf_dir):
    return M.label_economics(_deals(spark, sf_dir), "symbol")


@query(
    "bar_correlations",
    f"""WITH {BARS}, c AS (SELECT corr(open, high) AS a, corr(open, low) AS b, corr(open, volume) AS c, corr(high, low) AS d, corr(high, volume) AS e, corr(low, volume) AS f FROM bars)
    SELECT x.a AS a, x.b AS b, round(x.v, 6) AS corr FROM c, LATERAL (VALUES ('open', 'high', c.a), ('open', 'low', c.b), ('open', 'volume', c.c), ('high', 'low', c.d), ('high', 'volume', c.e), ('low', 'volume', c.f)) x(a, b, v)""",
)
def bar_correlations(spark, sf_dir):
    return M.correlations(_bars(spark, sf_dir), ["open", "high", "low", "volume"])


@query(
    "forward_outcome",
    f"""WITH {BARS}, f AS (SELECT symbol, ts, close, lead(close, 4) OVER (PARTITION BY symbol ORDER BY ts) AS later FROM bars)
    SELECT symbol, ts, round((later - close) / close - 0.005, 6) AS long_net, round((close - later) / close - 0.005, 6) AS short_net,
           CAST((later - close) / close - 0.005 > 0 AS INT) AS long_label, CAST((close - later) / close - 0.005 > 0 AS INT) AS short_label FROM f WHERE close <> 0""",
)
def forward_outcome(spark, sf_dir):
    """Net return four bars ahead for either side after a cost of half a percent; null past the end."""
    move = (F.lead("close", 4).over(series()) - F.col("close")) / F.col("close")
    f = _bars(spark, sf_dir).withColumn("move", F.when(F.col("close") != 0, move)).where("close <> 0")
    up, down = F.col("move") - 0.005, -F.col("move") - 0.005
    return f.select("symbol", "ts", up.alias("long_net"), down.alias("short_net"), (up > 0).cast("int").alias("long_label"), (down > 0).cast("int").alias("short_label"))


@query(
    "walk_forward",
    f"""WITH {BARS}, o AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ord, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
        f AS (SELECT symbol, least(CAST(floor(ord / floor(n / 5)) AS INT), 4) AS fold, close FROM o WHERE n >= 5)
    SELECT a.symbol, b.fold, count_if(a.fold < b.fold) AS train_rows, count_if(a.fold = b.fold) AS test_rows FROM f a JOIN (SELECT unnest(range(1, 5)) AS fold) b ON a.fold <= b.fold GROUP BY ALL""",
)
def walk_forward(spark, sf_dir):
    """Rows of the expanding training part and of the test part of each of four folds; the last takes the rest."""
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    o = _bars(spark, sf_dir).withColumns({"ord": F.row_number().over(series()) - 1, "n": n}).where("n >= 5")
    fold = F.least(F.floor(F.col("ord") / F.floor(F.col("n") / 5)).cast("int"), F.lit(4))
    counts = o.groupBy("symbol", fold.alias("of")).agg(F.count(F.lit(1)).alias("rows"))
    folds = counts.withColumn("fold", F.explode(F.sequence(F.greatest(F.lit(1), F.col("of")), F.lit(4))))
    same = F.col("of") == F.col("fold")
    return folds.groupBy("symbol", F.col("fold").cast("long").alias("fold")).agg(F.sum(F.when(same, 0).otherwise(F.col("rows"))).alias("train_rows"), F.sum(F.when(same, F.col("rows")).otherwise(0)).alias("test_rows"))


@query(
    "tick_flow",
    """WITH t AS (SELECT event_type AS symbol, ts, event_id, value AS bid, value + 0.02 AS ask, value - lag(value) OVER w AS move, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS age
        FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)), s AS (SELECT * FROM t WHERE age <= 500)
    SELECT symbol, count(*) AS n_ticks, count_if(move > 0) AS up_ticks, count_if(move < 0) AS down_ticks, round((count_if(move > 0) - count_if(move < 0)) / nullif(count_if(move <> 0), 0), 6) AS imbalance,
        round(sum((bid + ask) / 2) / count(*), 6) AS vwap, round(sum(CASE WHEN move > 0 THEN 1.0 WHEN move < 0 THEN 0.0 ELSE 0.5 END), 6) AS buy_volume,
        round(abs(sum(move)) / nullif(sum(abs(move)), 0), 6) AS consistency FROM s GROUP BY symbol""",
)
def tick_flow(spark, sf_dir):
    """Flow metrics over the last 500 ticks of a symbol; a flat tick counts half to each side.

    The newest ticks are picked in each task first, so no symbol's ticks meet in one.
    """
    t = ticks(_events(spark, sf_dir))
    by = Window.partitionBy("symbol").orderBy("ts", "ord")
    newest = Window.partitionBy("symbol").orderBy(F.desc("ts"), F.desc("ord"))
    s = t.withColumn("age", F.row_number().over(newest)).where("age <= 501")  # one more, for the first move
    s = s.withColumn("move", F.col("bid") - F.lag("bid").over(by)).where("age <= 500")
    up, down = F.count_if(F.col("move") > 0), F.count_if(F.col("move") < 0)
    buy = F.when(F.col("move") > 0, 1.0).when(F.col("move") < 0, 0.0).otherwise(0.5)
    none = lambda x: F.when(x != 0, x)
    return s.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_ticks"), up.alias("up_ticks"), down.alias("down_ticks"), ((up - down) / none(up + down)).alias("imbalance"),
        (F.sum((F.col("bid") + F.col("ask")) / 2 * F.col("volume")) / F.sum("volume")).alias("vwap"), F.sum(buy * F.col("volume")).alias("buy_volume"),
        (F.abs(F.sum("move")) / none(F.sum(F.abs("move")))).alias("consistency"),
    )


@query(
    "cvd_slope",
    """WITH t AS (SELECT event_type AS symbol, ts, event_id, value - lag(value) OVER w AS move FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
        c AS (SELECT symbol, sum(CASE WHEN move > 0 THEN 1 WHEN move < 0 THEN -1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS cvd, row_number() OVER (PARTITION BY symbol ORDER BY ts, event_id) AS k FROM t),
        l AS (SELECT *, max(k) OVER (PARTITION BY symbol) AS n FROM c)
    SELECT symbol, CAST(last(cvd ORDER BY k) AS BIGINT) AS cvd, round(regr_slope(cvd, k), 6) AS slope FROM l WHERE k > n - 50 GROUP BY symbol""",
)
def cvd_slope(spark, sf_dir):
    """Cumulative volume delta of a symbol, and its slope over the last 50 ticks.

    The whole delta is a sum over days; the slope needs the newest ticks alone, which are picked in each task.
    """
    t = ticks(_events(spark, sf_dir))
    sign = F.coalesce(F.signum(F.col("bid") - F.col("before")), F.lit(0.0)).cast("int")
    whole = _with_last_bid(t).groupBy("symbol").agg(F.sum(sign).alias("cvd"))
    by = Window.partitionBy("symbol").orderBy("ts", "ord")
    newest = Window.partitionBy("symbol").orderBy(F.desc("ts"), F.desc("ord"))
    s = t.withColumn("age", F.row_number().over(newest)).where("age <= 51").withColumn("before", F.lag("bid").over(by))
    s = s.select("symbol", "age", F.sum(sign).over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("sofar")).where("age <= 50")
    slope = s.groupBy("symbol").agg(F.regr_slope(F.col("sofar").cast("double"), -F.col("age").cast("double")).alias("slope"))
    return whole.join(slope, "symbol").select("symbol", "cvd", "slope")


def _with_last_bid(t):
    """Ticks with `before`, the bid of the tick before; a symbol's days are windows of their own, between which only last bids go."""
    t = t.withColumn("day", F.date_trunc("day", "ts"))
    ends = t.groupBy("symbol", "day").agg(F.max_by("bid", F.struct("ts", "ord")).alias("end"))
    ends = ends.select("symbol", "day", F.lag("end").over(Window.partitionBy("symbol").orderBy("day")).alias("held"))
    inside = Window.partitionBy("symbol", "day").orderBy("ts", "ord")
    return t.withColumn("before", F.lag("bid").over(inside)).join(ends, ["symbol", "day"]).withColumn("before", F.coalesce("before", "held")).drop("held", "day")


@query(
    "tick_changes",
    """WITH t AS (SELECT event_type AS symbol, ts, event_id AS ord, value AS bid, lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS before FROM events)
    SELECT symbol, ts, ord, round(bid, 6) AS bid FROM t WHERE before IS NULL OR bid <> before""",
)
def tick_changes(spark, sf_dir):
    """Ticks that differ from the one before."""
    t = ticks(_events(spark, sf_dir))
    return _with_last_bid(t).where("before IS NULL OR bid <> before").select("symbol", "ts", "ord", "bid")


@query("duplicate_decisions", "SELECT count(*) - count(DISTINCT (user_id, event_type, CAST(round(value) AS BIGINT), hour(ts))) AS duplicates FROM events")
def duplicate_decisions(spark, sf_dir):
    key = F.struct("user_id", "event_type", F.round("value").cast("long"), F.hour("ts"))
    return _events(spark, sf_dir).agg((F.count(F.lit(1)) - F.count_distinct(key)).alias("duplicates"))


@query(
    "extreme_losses",
    f"WITH {DEALS} SELECT account, ticket, round(profit, 6) AS profit, place FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY profit, ticket) AS place FROM deals) WHERE place <= 3",
)
def extreme_losses(spark, sf_dir):
    """The three worst deals of each account."""
    by = Window.partitionBy("account").orderBy("profit", "ticket")
    return _deals(spark, sf_dir).withColumn("place", F.row_number().over(by)).where("place <= 3").select("account", "ticket", "profit", "place")

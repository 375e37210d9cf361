"""Market queries: score composites, context, labels, policies, breakouts and their retests; with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import indicators as ind
from tidemark.operators.bars import series
from tidemark.operators.curves import curve, numbered
from tidemark.plans.market import BARS, DEALS, TR, _bars, _deals, _events, _frame, _tr
from tidemark.plans.registry import Registry
from tidemark.sources.tables import clock_bars

query = Registry()

CLAMP = "greatest(-1.0, least(1.0, {}))"
BODY = "greatest(0.0, least(1.0, abs(close - open) / greatest(abs(high - low), 1e-9)))"
SPREAD = 0.02


@query(
    "volatility_score",
    f"""WITH {BARS}, {TR}, a AS (SELECT *, CASE WHEN tr IS NOT NULL THEN avg(tr) OVER {_frame(14)} END AS atr, count(*) OVER (PARTITION BY symbol ORDER BY ts) AS n FROM t),
        s AS (SELECT symbol, ts, n, atr, list(atr) FILTER (WHERE atr IS NOT NULL) OVER {_frame(40)} AS frame, stddev_pop(close) OVER {_frame(20)} AS dev, avg(close) OVER {_frame(20)} AS mid,
              abs(high - low) AS size, avg(abs(high - low)) OVER {_frame(20)} AS mean FROM a)
    SELECT symbol, ts, round(CASE WHEN n < 25 THEN 0.0 ELSE {CLAMP.format("0.45 * (len(list_filter(frame, lambda v: v <= atr)) / len(frame) - 0.5) * 2 + 0.25 * greatest(-1.0, least(1.0, (size / greatest(mean, 1e-9) - 1) / 2)) - 0.30 * least(4 * dev / greatest(abs(mid), 1e-9) * 200, 1.0)")} END, 6) AS score FROM s""",
)
def volatility_score(spark, sf_dir):
    """Rank of the mean true range among the last forty, growth of the range, and width of the band around the mean."""
    a = _tr(spark, sf_dir).withColumns({"atr": F.when(F.col("tr").isNotNull(), ind.atr(series(), 14)), "size": F.abs(F.col("high") - F.col("low"))})
    w = ind.last(series(), 20)
    rank = ind.percentile_rank("atr", series(), 40)
    growth = ind.clamp((F.col("size") / F.greatest(F.avg("size").over(w), F.lit(ind.TINY)) - 1) / 2)
    width = F.least(4 * F.stddev_pop("close").over(w) / F.greatest(F.abs(F.avg("close").over(w)), F.lit(ind.TINY)) * 200, F.lit(1.0))
    score = ind.clamp(0.45 * (rank - 0.5) * 2 + 0.25 * growth - 0.30 * width)
    return a.select("symbol", "ts", F.when(F.row_number().over(series()) < 25, 0.0).otherwise(score).alias("score"))


@query(
    "risk_score",
    f"""WITH {BARS}, {TR}, s AS (SELECT *, avg(tr) OVER {_frame(14)} AS atr, avg(abs(high - low)) OVER {_frame(20)} AS mean, count(*) OVER {_frame(20)} AS n FROM t)
    SELECT symbol, ts, round(CASE WHEN n < 20 THEN 0.0 ELSE greatest(0.0, least(1.0, 0.45 * greatest(0.0, least(1.0, {SPREAD} / greatest(atr, 1e-9)))
        + 0.30 * greatest(0.0, least(1.0, abs(high - low) / greatest(mean, 1e-9) - 1)) + 0.25 * (1 - {BODY}))) END, 6) AS score,
        round(CASE WHEN atr > 0 THEN {SPREAD} / atr ELSE 0.0 END, 6) AS spread_danger FROM s""",
)
def risk_score(spark, sf_dir):
    """Spread against the mean true range, growth of the range, and wicks; and the first of these alone."""
    size, atr = F.abs(F.col("high") - F.col("low")), ind.atr(series(), 14)
    w = ind.last(series(), 20)
    unit = lambda x: ind.clamp(x, 0.0, 1.0)
    score = unit(0.45 * unit(SPREAD / F.greatest(atr, F.lit(ind.TINY))) + 0.30 * unit(size / F.greatest(F.avg(size).over(w), F.lit(ind.TINY)) - 1) + 0.25 * (1 - ind.body_efficiency()))
    danger = F.when(atr > 0, SPREAD / atr).otherwise(0.0)
    return _tr(spark, sf_dir).select("symbol", "ts", F.when(F.count(F.lit(1)).over(w) < 20, 0.0).otherwise(score).alias("score"), danger.alias("spread_danger"))


@query(
    "statistical_score",
    f"""WITH {BARS}, r AS (SELECT *, (close - lag(close) OVER o) / greatest(abs(lag(close) OVER o), 1e-9) AS ret, row_number() OVER o AS n FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY ts)),
        p AS (SELECT *, lag(ret) OVER (PARTITION BY symbol ORDER BY ts) AS r1 FROM r),
        s AS (SELECT symbol, ts, n, close, avg(close) OVER {_frame(20)} AS m, stddev_pop(close) OVER {_frame(20)} AS d, avg(ret) OVER {_frame(20)} AS rm, stddev_pop(ret) OVER {_frame(20)} AS rd,
            corr(ret, r1) OVER {_frame(29)} AS ac, CAST(count_if(ret > 0) OVER {_frame(30)} AS DOUBLE) AS u, CAST(count_if(ret < 0) OVER {_frame(30)} AS DOUBLE) AS v FROM p)
    SELECT symbol, ts, round(CASE WHEN n < 40 THEN 0.0 ELSE {CLAMP.format("0.30 * greatest(-1.0, least(1.0, (close - m) / greatest(d, 1e-9) / 3)) + 0.25 * coalesce(ac, 0.0) + 0.25 * greatest(-1.0, least(1.0, rm / greatest(rd, 1e-9) / 2)) - 0.20 * (CASE WHEN u + v = 0 THEN 1.0 ELSE CASE WHEN u > 0 THEN -(u / (u + v)) * log2(u / (u + v)) ELSE 0 END + CASE WHEN v > 0 THEN -(v / (u + v)) * log2(v / (u + v)) ELSE 0 END END)")} END, 5) AS score FROM s""",
    digits=5,
)
def statistical_score(spark, sf_dir):
    """Distance of the close, correlation of returns, mean return in deviations, less the entropy of their signs."""
    before = F.lag("close").over(series())
    r = _bars(spark, sf_dir).withColumn("ret", (F.col("close") - before) / F.greatest(F.abs(before), F.lit(ind.TINY)))
    r = r.withColumn("r1", F.lag("ret").over(series()))
    w = ind.last(series(), 20)
    z = ind.clamp((F.col("close") - F.avg("close").over(w)) / F.greatest(F.stddev_pop("close").over(w), F.lit(ind.TINY)) / 3)
    sharpe = ind.clamp(F.avg("ret").over(w) / F.greatest(F.stddev_pop("ret").over(w), F.lit(ind.TINY)) / 2)
    score = ind.clamp(0.30 * z + 0.25 * ind.autocorrelation("ret", "r1", series(), 29) + 0.25 * sharpe - 0.20 * ind.sign_entropy("ret", series(), 30))
    return r.select("symbol", "ts", F.when(F.row_number().over(series()) < 40, 0.0).otherwise(score).alias("score"))


@query(
    "latest_bar",
    f"""WITH {BARS}, l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM bars)
    SELECT symbol, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(high - low, 6) AS size, round(abs(close - open), 6) AS body,
        round(CASE WHEN high > low THEN abs(close - open) / (high - low) ELSE 0.0 END, 6) AS ratio FROM l WHERE k = 1""",
)
def latest_bar(spark, sf_dir):
    """The last bar of each symbol, its range, body, and the body's share."""
    b = _bars(spark, sf_dir)
    b = b.groupBy("symbol").agg(F.max(F.struct("ts", "open", "high", "low", "close")).alias("x")).select("symbol", "x.*")
    size, body = F.col("high") - F.col("low"), F.abs(F.col("close") - F.col("open"))
    return b.select("*", size.alias("size"), body.alias("body"), F.when(size > 0, body / size).otherwise(0.0).alias("ratio"))


DAYS = """days AS (SELECT symbol, date_trunc('day', ts) AS day, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close FROM bars GROUP BY ALL)"""


@query(
    "daily_context",
    f"""WITH {BARS}, {DAYS}, s AS (SELECT *, avg(high - low) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS adr FROM days)
    SELECT symbol, CAST(day AS TIMESTAMP) AS day, round(CASE WHEN high > low THEN (close - low) / (high - low) ELSE 0.5 END, 6) AS place, round(adr, 6) AS adr,
        round(low + adr, 6) AS up, round(high - adr, 6) AS down, round(greatest(0.0, adr - (high - low)), 6) AS remaining FROM s""",
)
def daily_context(spark, sf_dir):
    """Place of each day's close in its range, mean range of the five days before, what it projects, and what is left of it."""
    days = _bars(spark, sf_dir).groupBy("symbol", F.date_trunc("day", "ts").alias("day")).agg(F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"))
    size = F.col("high") - F.col("low")
    adr = F.avg(size).over(Window.partitionBy("symbol").orderBy("day").rowsBetween(-5, -1))
    s = days.withColumn("adr", adr)
    place = F.when(size > 0, (F.col("close") - F.col("low")) / size).otherwise(0.5)
    return s.select("symbol", "day", place.alias("place"), "adr", (F.col("low") + F.col("adr")).alias("up"), (F.col("high") - F.col("adr")).alias("down"), F.when(F.col("adr").isNotNull(), F.greatest(F.lit(0.0), F.col("adr") - size)).otherwise(0.0).alias("remaining"))


@query(
    "forward_labels",
    f"""WITH {BARS}, {TR}, n AS (SELECT symbol, least(12, greatest(1, count(*) // 100)) AS h FROM bars GROUP BY symbol), o AS (SELECT t.*, h, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM t JOIN n USING (symbol)),
        j AS (SELECT a.symbol, a.ts, b.close IS NOT NULL AS ahead, CASE WHEN b.close IS NULL THEN coalesce(a.ret, 0.0) WHEN a.close > 0 AND b.close > 0 THEN (b.close - a.close) / a.close ELSE coalesce(b.ret, 0.0) END AS r FROM o a LEFT JOIN o b ON a.symbol = b.symbol AND b.k = a.k + a.h)
    SELECT symbol, ts, round(r, 6) AS realized, CASE WHEN r > CASE WHEN ahead THEN 0.0001 ELSE 0 END THEN 1 ELSE 0 END AS label FROM j""",
)
def forward_labels(spark, sf_dir):
    """Return over a horizon of a hundredth of the bars, 1 to 12, and whether it beats a cost; at the end the bar's own return.

    The horizon differs by symbol, so the bars ahead are held as an array of thirteen and one is picked.
    """
    t = _tr(spark, sf_dir)
    h = F.least(F.lit(12), F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(Window.partitionBy("symbol")) / 100))).cast("int")
    ahead = F.collect_list(F.struct("close", "ret")).over(series().rowsBetween(0, 12))
    t = t.withColumns({"b": F.get(ahead, h)})
    own = F.when((F.col("close") > 0) & (F.col("b.close") > 0), (F.col("b.close") - F.col("close")) / F.col("close")).otherwise(F.coalesce("b.ret", F.lit(0.0)))
    r = F.when(F.col("b").isNull(), F.coalesce("ret", F.lit(0.0))).otherwise(own)
    return t.select("symbol", "ts", r.alias("realized"), (r > F.when(F.col("b").isNotNull(), 0.0001).otherwise(0.0)).cast("int").alias("label"))


@query(
    "regime_labels",
    f"""WITH {BARS}, {TR}, s AS (SELECT symbol, ts, lead(close, 5) OVER (PARTITION BY symbol ORDER BY ts) - close AS f, avg(tr) OVER {_frame(3)} / nullif(avg(tr) OVER {_frame(14)}, 0) AS v, close / nullif(avg(close) OVER {_frame(20)}, 0) AS g FROM t)
    SELECT symbol, ts, CASE WHEN v >= 1.15 AND abs(f) > 0.5 AND abs(g - 1) > 0.1 THEN 'expansion' WHEN v <= 0.8 AND abs(f) < 0.2 THEN 'compression' WHEN abs(g - 1) > 0.05 AND abs(f) > 0.1 THEN 'trend' ELSE 'pullback' END AS label FROM s WHERE f IS NOT NULL""",
)
def regime_labels(spark, sf_dir):
    """One of four regimes by what the next five bars do, how the range grows, and how far the close is from its mean."""
    t = _tr(spark, sf_dir)
    w = lambda n: ind.last(series(), n)
    f = F.lead("close", 5).over(series()) - F.col("close")
    v = F.avg("tr").over(w(3)) / F.nullif(F.avg("tr").over(w(14)), F.lit(0.0))
    g = F.col("close") / F.nullif(F.avg("close").over(w(20)), F.lit(0.0))
    s = t.select("symbol", "ts", f.alias("f"), v.alias("v"), F.abs(g - 1).alias("g")).where("f IS NOT NULL")
    far = F.abs(F.col("f"))
    label = F.when((F.col("v") >= 1.15) & (far > 0.5) & (F.col("g") > 0.1), "expansion").when((F.col("v") <= 0.8) & (far < 0.2), "compression")
    return s.select("symbol", "ts", label.when((F.col("g") > 0.05) & (far > 0.1), "trend").otherwise("pullback").alias("label"))


@query(
    "price_before",
    f"""WITH {BARS}, o AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS previous FROM bars)
    SELECT a.symbol, a.ts, round(a.close, 6) AS close, round(coalesce(b.close, a.previous), 6) AS before, b.close IS NOT NULL AS exact FROM o a LEFT JOIN bars b ON a.symbol = b.symbol AND b.ts = a.ts - INTERVAL '15 minutes'""",
)
def price_before(spark, sf_dir):
    """The close a quarter of an hour earlier by an equi-join on time; where there is none, of the bar before."""
    b = _bars(spark, sf_dir)
    shifted = b.select("symbol", (F.col("ts") + F.expr("INTERVAL 15 MINUTES")).alias("ts"), F.col("close").alias("then"))
    o = b.withColumn("previous", F.lag("close").over(series())).join(shifted, ["symbol", "ts"], "left")
    return o.select("symbol", "ts", "close", F.coalesce("then", "previous").alias("before"), F.col("then").isNotNull().alias("exact"))


@query(
    "flat_bars",
    """WITH t AS (SELECT event_type AS symbol, value + 0.01 AS mid, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events), l AS (
        SELECT symbol, max(mid) FILTER (WHERE k = 1) AS mid, max(mid) FILTER (WHERE k = 2) AS previous, max(ts) AS last FROM t WHERE k <= 2 GROUP BY symbol), r AS (SELECT *, unnest(range(0, 10)) AS i FROM l)
    SELECT symbol, date_trunc('minute', last) - i * INTERVAL '1 minute' AS ts, round(CASE WHEN i = 0 THEN coalesce(previous, mid) ELSE mid END, 6) AS open, round(mid, 6) AS close FROM r""",
)
def flat_bars(spark, sf_dir):
    """Ten minute bars made up from the last ticks, flat at the last mid price; the newest opens at the one before."""
    e = _events(spark, sf_dir).select(F.col("event_type").alias("symbol"), "ts", "event_id", (F.col("value") + 0.01).alias("mid"))
    newest = Window.partitionBy("symbol").orderBy(F.desc("ts"), F.desc("event_id"))
    two = e.withColumn("k", F.row_number().over(newest)).where("k <= 2").groupBy("symbol")
    two = two.agg(F.max(F.when(F.col("k") == 1, F.col("mid"))).alias("mid"), F.max(F.when(F.col("k") == 2, F.col("mid"))).alias("previous"), F.max("ts").alias("last"))
    r = two.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(9))))
    at = F.date_trunc("minute", "last") - F.make_dt_interval(mins=F.col("i"))
    return r.select("symbol", at.alias("ts"), F.when(F.col("i") == 0, F.coalesce("previous", "mid")).otherwise(F.col("mid")).alias("open"), F.col("mid").alias("close"))


STREAK = """x AS (SELECT symbol, ts, ticket, profit, row_number() OVER (PARTITION BY symbol ORDER BY ts, ticket) - row_number() OVER (PARTITION BY symbol, profit < 0 ORDER BY ts, ticket) AS g FROM {}),
    streak AS (SELECT symbol, max(n) AS loss_streak FROM (SELECT symbol, count(*) AS n FROM x WHERE profit < 0 GROUP BY symbol, g) GROUP BY symbol)"""
POLICY = """CASE WHEN n < 60 THEN 'insufficient_shadow_samples' WHEN selected < 20 THEN 'insufficient_selected_shadow_trades' WHEN win_rate < 0.5 THEN 'shadow_policy_low_win_rate'
    WHEN expectancy < 0 THEN 'shadow_policy_low_expectancy' WHEN profit_factor < 1.0 THEN 'shadow_policy_low_profit_factor' WHEN loss_streak > 8 THEN 'shadow_policy_loss_streak_too_high' ELSE 'shadow_policy_unproven' END"""


@query(
    "shadow_edge",
    f"""WITH {DEALS}, {STREAK.format("deals")}, s AS (SELECT symbol, count(*) AS n, count_if(profit > 0) / count(*) AS win_rate, avg(greatest(profit, 0)) AS favorable, avg(greatest(-profit, 0)) AS adverse FROM deals GROUP BY symbol)
    SELECT symbol, n, round(win_rate, 6) AS win_rate, round(favorable, 6) AS favorable, round(adverse, 6) AS adverse, round(favorable - adverse, 6) AS expectancy, coalesce(loss_streak, 0) AS loss_streak,
        n >= 60 AND win_rate >= 0.58 AND favorable - adverse >= 0.02 AND coalesce(loss_streak, 0) <= 4 AS allowed FROM s LEFT JOIN streak USING (symbol)""",
)
def shadow_edge(spark, sf_dir):
    """Win rate, mean gain and loss, expectancy and longest losing run of each symbol's deals, and whether they allow trading."""
    d = _deals(spark, sf_dir)
    s = d.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col("profit") > 0) / F.count(F.lit(1))).alias("win_rate"), F.avg(F.greatest("profit", F.lit(0.0))).alias("favorable"), F.avg(F.greatest(-F.col("profit"), F.lit(0.0))).alias("adverse"))
    s = s.join(_streaks(d), "symbol", "left").withColumns({"expectancy": F.col("favorable") - F.col("adverse"), "loss_streak": F.coalesce("loss_streak", F.lit(0)).cast("long")})
    return s.withColumn("allowed", F.expr("n >= 60 AND win_rate >= 0.58 AND expectancy >= 0.02 AND loss_streak <= 4"))


def _streaks(deals):
    """symbol, loss_streak: the longest run of losses in order of time and ticket; a profit of zero ends one."""
    way = F.when(F.col("profit") < 0, -1.0).otherwise(1.0)
    return curve(deals.select("symbol", "ts", "ticket", way.alias("profit")), ["symbol"], "ts", ["ticket"]).select("symbol", F.col("max_loss_streak").alias("loss_streak"))


@query(
    "holdout_policy",
    f"""WITH {DEALS}, o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, ticket) AS k, count(*) OVER (PARTITION BY symbol) AS whole FROM deals), h AS (SELECT * FROM o WHERE k > floor(whole * 0.7)), {STREAK.format("h")},
        s AS (SELECT symbol, count(*) AS n, count_if(abs(profit) >= 5) AS selected, count_if(profit > 0) / count(*) AS win_rate, avg(profit) AS expectancy,
            CASE WHEN sum(CASE WHEN profit < 0 THEN -profit ELSE 0 END) > 0 THEN sum(CASE WHEN profit > 0 THEN profit ELSE 0 END) / sum(CASE WHEN profit < 0 THEN -profit ELSE 0 END) ELSE 999.0 END AS profit_factor FROM h GROUP BY symbol),
        r AS (SELECT s.*, coalesce(loss_streak, 0) AS loss_streak FROM s LEFT JOIN streak USING (symbol))
    SELECT symbol, n, selected, round(win_rate, 6) AS win_rate, round(expectancy, 6) AS expectancy, round(profit_factor, 6) AS profit_factor, loss_streak, {POLICY} AS reason FROM r""",
)
def holdout_policy(spark, sf_dir):
    """The last three tenths of each symbol's deals, and the first requirement of the policy that they fail."""
    d = _deals(spark, sf_dir)
    h = numbered(d, ["symbol"], "ts", ["ticket"]).where("place > floor(whole * 0.7)").drop("place", "whole")
    gain, loss = F.sum(F.greatest("profit", F.lit(0.0))), F.sum(F.greatest(-F.col("profit"), F.lit(0.0)))
    s = h.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.abs("profit") >= 5).alias("selected"), (F.count_if(F.col("profit") > 0) / F.count(F.lit(1))).alias("win_rate"),
        F.avg("profit").alias("expectancy"), F.when(loss > 0, gain / loss).otherwise(999.0).alias("profit_factor"),
    )
    s = s.join(_streaks(h), "symbol", "left").withColumn("loss_streak", F.coalesce("loss_streak", F.lit(0)).cast("long"))
    return s.withColumn("reason", F.expr(POLICY))


ZONE = f"""z AS (SELECT symbol, ts, high, low, close, max(high) OVER p AS top, max(close) OVER p AS edge, count(*) OVER p AS n FROM bars WINDOW p AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
    k AS (SELECT *, CASE WHEN n < 20 THEN 'none' WHEN close > top THEN 'breakout' WHEN high > top THEN 'wick' ELSE 'none' END AS kind FROM z)"""


@query("zone_breakouts", f"WITH {BARS}, {ZONE} SELECT symbol, ts, kind, round(edge, 6) AS zone_low, round(top, 6) AS zone_high FROM k")
def zone_breakouts(spark, sf_dir):
    """Whether a bar closes beyond the zone between the highest close and the highest high of twenty bars before, or only its wick does."""
    return _zones(spark, sf_dir).select("symbol", "ts", "kind", F.col("edge").alias("zone_low"), F.col("top").alias("zone_high"))


def _zones(spark, sf_dir):
    past = series().rowsBetween(-20, -1)
    z = _bars(spark, sf_dir).withColumns({"top": F.max("high").over(past), "edge": F.max("close").over(past), "n": F.count(F.lit(1)).over(past)})
    kind = F.when(F.col("n") < 20, "none").when(F.col("close") > F.col("top"), "breakout").when(F.col("high") > F.col("top"), "wick").otherwise("none")
    return z.withColumn("kind", kind)


@query(
    "retests",
    f"""WITH {BARS}, {ZONE}, o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS o FROM k), b AS (SELECT * FROM o WHERE kind = 'breakout'),
        j AS (SELECT b.symbol, b.ts, a.o - b.o AS age, a.low <= b.top AS touched, a.close > b.top AS holds, a.close < b.edge AS lost FROM b JOIN o a ON a.symbol = b.symbol AND a.o BETWEEN b.o + 1 AND b.o + 12),
        f AS (SELECT symbol, ts, min(age) FILTER (WHERE touched) AS age, count(*) FILTER (WHERE touched) AS touches, coalesce(arg_min(holds, age) FILTER (WHERE touched), false) AS confirmed, min(age) FILTER (WHERE lost) AS gone FROM j GROUP BY symbol, ts)
    SELECT b.symbol, b.ts, CAST(f.age AS INT) AS age, CAST(coalesce(touches, 0) AS INT) AS touches, coalesce(confirmed, false) AS confirmed, f.age > 6 AS late, CAST(gone AS INT) AS invalidated FROM b LEFT JOIN f USING (symbol, ts)""",
)
def retests(spark, sf_dir):
    """Of each breakout, in the twelve bars after it: when the zone is first touched again, how often, whether that bar closes beyond it,
    whether it comes late, and when a close below the zone ends it. The bars after are held as an array, so no ranges are joined."""
    after = F.collect_list(F.struct("low", "close")).over(series().rowsBetween(1, 12))
    b = _zones(spark, sf_dir).withColumn("after", after).where("kind = 'breakout'")
    bars = F.transform("after", lambda a, i: F.struct((i + 1).alias("age"), (a["low"] <= F.col("top")).alias("touched"), (a["close"] > F.col("top")).alias("holds"), (a["close"] < F.col("edge")).alias("lost")))
    b = b.withColumns({"hit": F.filter(bars, lambda x: x["touched"]), "out": F.filter(bars, lambda x: x["lost"])})
    first = F.get("hit", F.lit(0))
    return b.select("symbol", "ts", first["age"].alias("age"), F.size("hit").alias("touches"), F.coalesce(first["holds"], F.lit(False)).alias("confirmed"), (first["age"] > 6).alias("late"), F.get("out", F.lit(0))["age"].alias("invalidated"))


def _width(minutes: int) -> str:
    return f"b{minutes} AS (SELECT symbol, w AS ts, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close FROM (SELECT event_type AS symbol, time_bucket(INTERVAL '{minutes} minutes', ts) AS w, ts, event_id, value FROM events) GROUP BY symbol, w), l{minutes} AS (SELECT symbol, close < lag(low) OVER o AS down, close > lag(high) OVER o AS up, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM b{minutes} WINDOW o AS (PARTITION BY symbol ORDER BY ts))"


@query(
    "reversals",
    f"""WITH {", ".join(map(_width, (15, 30, 60)))} SELECT symbol, coalesce(a.down AND b.down AND c.down, false) AS against_long, coalesce(a.up AND b.up AND c.up, false) AS against_short
    FROM l15 a JOIN l30 b USING (symbol) JOIN l60 c USING (symbol) WHERE a.k = 1 AND b.k = 1 AND c.k = 1""",
)
def reversals(spark, sf_dir):
    """Whether the last bars of a quarter, half and whole hour all close beyond the bar before them, against either side."""
    out = None
    for minutes in (15, 30, 60):
        b = clock_bars(_events(spark, sf_dir), f"{minutes} minutes")
        newest = Window.partitionBy("symbol").orderBy(F.desc("ts"))
        two = b.withColumn("k", F.row_number().over(newest)).where("k <= 2").groupBy("symbol")
        at = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))
        one = two.agg((at("close", 1) < at("low", 2)).alias(f"down{minutes}"), (at("close", 1) > at("high", 2)).alias(f"up{minutes}"))
        out = one if out is None else out.join(one, "symbol")
    every = lambda side: F.coalesce(F.col(f"{side}15") & F.col(f"{side}30") & F.col(f"{side}60"), F.lit(False))
    return out.select("symbol", every("down").alias("against_long"), every("up").alias("against_short"))


@query(
    "stop_updates",
    f"""WITH {BARS}, {TR}, s AS (SELECT symbol, ts, close, avg(tr) OVER {_frame(14)} AS atr FROM t), l AS (SELECT *, lag(close - 2 * atr) OVER (PARTITION BY symbol ORDER BY ts) AS held FROM s WHERE atr IS NOT NULL)
    SELECT symbol, ts, round(close - 2 * atr, 6) AS candidate, coalesce(held IS NULL OR held = 0 OR close - 2 * atr > held, false) AS allowed, round(greatest(coalesce(nullif(held, 0), close - 2 * atr), close - 2 * atr), 6) AS stop FROM l""",
)
def stop_updates(spark, sf_dir):
    """A long stop two mean ranges below the close: whether it may take the place of the bar before's, and the more protective of both."""
    s = _tr(spark, sf_dir).select("symbol", "ts", (F.col("close") - 2 * ind.atr(series(), 14)).alias("candidate")).where("candidate IS NOT NULL")
    held = F.lag("candidate").over(series())
    s = s.withColumn("held", F.when(held != 0, held))
    return s.select("symbol", "ts", "candidate", (F.col("held").isNull() | (F.col("candidate") > F.col("held"))).alias("allowed"), F.greatest("held", "candidate").alias("stop"))


@query(
    "trade_levels",
    f"""WITH {BARS}, {TR}, s AS (SELECT symbol, ts, close, avg(tr) OVER {_frame(14)} AS atr FROM t), p AS (SELECT event_type AS symbol, count_if(value > 100) / count(*) AS p FROM events GROUP BY event_type)
    SELECT symbol, ts, round(close - 1.5 * atr, 6) AS stop, round(close + 3 * atr, 6) AS target, round(p * 3 * atr - (1 - p) * 1.5 * atr, 6) AS value, round(greatest(0.0, least(0.25, p - (1 - p) / 2)) * 10000 / nullif(1.5 * atr, 0), 6) AS size
    FROM s JOIN p USING (symbol) WHERE atr IS NOT NULL""",
)
def trade_levels(spark, sf_dir):
    """Stop and target of a long trade at each bar, its expected value under the symbol's win rate, and a size by a bounded Kelly share."""
    s = _tr(spark, sf_dir).select("symbol", "ts", "close", ind.atr(series(), 14).alias("atr")).where("atr IS NOT NULL")
    p = _events(spark, sf_dir).groupBy(F.col("event_type").alias("symbol")).agg((F.count_if(F.col("value") > 100) / F.count(F.lit(1))).alias("p"))
    risk, gain, p1 = 1.5 * F.col("atr"), 3 * F.col("atr"), F.col("p")
    share = ind.clamp(p1 - (1 - p1) / 2, 0.0, 0.25)
    return s.join(p, "symbol").select("symbol", "ts", (F.col("close") - risk).alias("stop"), (F.col("close") + gain).alias("target"), (p1 * gain - (1 - p1) * risk).alias("value"), (share * 10000 / F.nullif(risk, F.lit(0.0))).alias("size"))


@query(
    "trade_progress",
    f"""WITH {BARS}, l AS (SELECT symbol, arg_max(close, ts) AS now FROM bars GROUP BY symbol) SELECT event_id AS ticket, event_type AS symbol, round(CASE WHEN event_id % 2 = 1 THEN now - value ELSE value - now END / 8.0, 6) AS r_multiple FROM events JOIN l ON l.symbol = event_type""",
)
def trade_progress(spark, sf_dir):
    """How many times its risk each open trade has gained at its symbol's last close."""
    now = _bars(spark, sf_dir).groupBy("symbol").agg(F.max_by("close", "ts").alias("now"))
    e = _events(spark, sf_dir).select(F.col("event_id").alias("ticket"), F.col("event_type").alias("symbol"), "value").join(now, "symbol")
    move = F.col("now") - F.col("value")
    return e.select("ticket", "symbol", (F.when(F.col("ticket") % 2 == 1, move).otherwise(-move) / 8.0).alias("r_multiple"))


@query(
    "exposure_snapshot",
    f"WITH {DEALS} SELECT account, count(*) AS positions, round(sum(abs(profit)), 6) AS margin, round(100 * sum(abs(profit)) / (10000 + sum(profit)), 6) AS percent FROM deals GROUP BY account",
)
def exposure_snapshot(spark, sf_dir):
    """Margin of each account's positions and its share of equity; a position's margin is the size of its profit."""
    margin = F.sum(F.abs("profit"))
    return _deals(spark, sf_dir).groupBy("account").agg(F.count(F.lit(1)).alias("positions"), margin.alias("margin"), (100 * margin / (10000 + F.sum("profit"))).alias("percent"))


@query(
    "fold_averages",
    f"""WITH {DEALS}, f AS (SELECT symbol, ticket % 5 AS fold, count_if(profit > 0) / count(*) AS win_rate, avg(profit) AS expectancy, median(abs(profit)) AS threshold FROM deals GROUP BY ALL)
    SELECT symbol, count(*) AS folds, round(avg(win_rate), 6) AS win_rate, round(avg(expectancy), 6) AS expectancy, round(median(threshold), 6) AS threshold FROM f GROUP BY symbol""",
)
def fold_averages(spark, sf_dir):
    """Metrics of five folds of deals, and over the folds their means and the median threshold."""
    d = _deals(spark, sf_dir).groupBy("symbol", (F.col("ticket") % 5).alias("fold"))
    f = d.agg((F.count_if(F.col("profit") > 0) / F.count(F.lit(1))).alias("win_rate"), F.avg("profit").alias("expectancy"), F.median(F.abs("profit")).alias("threshold"))
    return f.groupBy("symbol").agg(F.count(F.lit(1)).alias("folds"), F.avg("win_rate").alias("win_rate"), F.avg("expectancy").alias("expectancy"), F.median("threshold").alias("threshold"))


@query(
    "labelled_union",
    f"""WITH {BARS}, {DEALS} SELECT 'bars' AS origin, symbol, ts, NULL::BIGINT AS ticket, round(close - open, 6) AS realized, CAST(close > open AS INT) AS label FROM bars
    UNION ALL SELECT 'deals', symbol, ts, ticket, round(profit, 6), CAST(profit > 0 AS INT) FROM deals""",
)
def labelled_union(spark, sf_dir):
    """Labelled rows of bars and of deals in one table; what one side lacks is null."""
    b = _bars(spark, sf_dir).select(F.lit("bars").alias("origin"), "symbol", "ts", (F.col("close") - F.col("open")).alias("realized"), (F.col("close") > F.col("open")).cast("int").alias("label"))
    d = _deals(spark, sf_dir).select(F.lit("deals").alias("origin"), "symbol", "ts", "ticket", F.col("profit").alias("realized"), (F.col("profit") > 0).cast("int").alias("label"))
    return b.unionByName(d, allowMissingColumns=True)

"""Zones as intervals of time: from their birth until a close beyond them, or a set time; bars, breakouts and retests on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.bars import series

#: What tells zones apart.
ZONE = ("symbol", "zone_ts", "kind")

# What is taken off a swing's price to refine its zone, weights of the structural score.
BUFFER = 3.0
WEIGHTS = (0.4, 0.3, 0.3)


def swings(bars: DataFrame, minutes: int) -> DataFrame:
    """symbol, ts, kind, price, born of bars whose high (supply) or else low (demand) goes beyond both neighbours; known once the next bar is closed."""
    by = series()
    s = bars.withColumns({"h0": F.lag("high").over(by), "h2": F.lead("high").over(by), "l0": F.lag("low").over(by), "l2": F.lead("low").over(by), "next": F.lead("ts").over(by)})
    top, bottom = (F.col("high") > F.col("h0")) & (F.col("high") > F.col("h2")), (F.col("low") < F.col("l0")) & (F.col("low") < F.col("l2"))
    born = F.col("next") + F.make_dt_interval(mins=F.lit(minutes))
    return s.where(top | bottom).select("symbol", "ts", F.when(top, "supply").otherwise("demand").alias("kind"), F.when(top, F.col("high")).otherwise(F.col("low")).alias("price"), born.alias("born"))


def zones(swings: DataFrame, bounds: DataFrame, buffer: float = BUFFER) -> DataFrame:
    """Zones (ZONE, born, price, major_low, major_high, low, high) of swings and bounds (symbol, ts, low, high) paired by their place in time.

    low and high are the refined zone: a supply zone begins not more than `buffer` below the swing, a demand
    zone ends not more than that above it. What has no partner makes no zone.
    """
    place = F.row_number().over(Window.partitionBy("symbol").orderBy("ts"))
    s = swings.withColumn("place", place)
    b = bounds.select("symbol", place.alias("place"), F.least("low", "high").alias("major_low"), F.greatest("low", "high").alias("major_high"))
    both = s.join(b, ["symbol", "place"])
    supply = F.col("kind") == "supply"
    low = F.when(supply, F.greatest("major_low", F.col("price") - buffer)).otherwise(F.col("major_low"))
    high = F.when(supply, F.col("major_high")).otherwise(F.least("major_high", F.col("price") + buffer))
    return both.select("symbol", F.col("ts").alias("zone_ts"), "kind", "born", "price", "major_low", "major_high", low.alias("low"), high.alias("high"))


def zone_bars(zones: DataFrame, bars: DataFrame, minutes: int, days: int) -> DataFrame:
    """Each zone with the bars (bar_ts, bar_open, bar_high, bar_low, bar_close) that close while it lives, and event.

    A zone lives from its birth for `days`, or until a bar closes beyond it (above supply, below demand): that
    bar is its last, a breakout. Before, a bar whose wick alone goes beyond is a wick, any other is none.
    Zones and bars meet by symbol and day, a zone in days + 1 of them, so a zone costs the bars of its life.
    """
    day = lambda c: F.date_trunc("day", c)
    closes = F.col("ts") + F.make_dt_interval(mins=F.lit(minutes))
    given = bars.select("symbol", day(closes).alias("day"), closes.alias("bar_at"), F.col("ts").alias("bar_ts"), *[F.col(c).alias(f"bar_{c}") for c in ("open", "high", "low", "close")])
    lives = zones.withColumn("until", F.col("born") + F.make_dt_interval(days=F.lit(days)))
    lives = lives.withColumn("day", F.explode(F.sequence(day(F.col("born")), day(F.col("until")), F.expr("INTERVAL 1 DAY"))))
    near = lives.join(given, ["symbol", "day"]).where((F.col("bar_at") > F.col("born")) & (F.col("bar_at") <= F.col("until")))
    supply = F.col("kind") == "supply"
    beyond = F.when(supply, F.col("bar_close") > F.col("major_high")).otherwise(F.col("bar_close") < F.col("major_low"))
    wick = F.when(supply, F.col("bar_high") > F.col("major_high")).otherwise(F.col("bar_low") < F.col("major_low"))
    before = Window.partitionBy(*ZONE).orderBy("bar_at").rowsBetween(Window.unboundedPreceding, -1)
    seen = near.withColumn("beyond", beyond).withColumn("broken", F.coalesce(F.max("beyond").over(before), F.lit(False)))
    event = F.when(F.col("beyond"), "breakout").when(wick, "wick").otherwise("none")
    return seen.where("NOT broken").withColumn("event", event).drop("day", "until", "beyond", "broken", "bar_at")


def nearest(live: DataFrame) -> DataFrame:
    """symbol, bar_ts and of each kind the distance, low and high of the live zone nearest to the close; broken ones are none any more.

    live: what zone_bars gives. A price inside a zone has distance 0; of two at one distance the older counts.
    """
    away = F.greatest(F.col("low") - F.col("bar_close"), F.col("bar_close") - F.col("high"), F.lit(0.0))
    rows = live.where("event <> 'breakout'").select("symbol", "bar_ts", "kind", F.struct(away.alias("distance"), "zone_ts", "low", "high").alias("z"))
    best = rows.groupBy("symbol", "bar_ts").agg(*[F.min(F.when(F.col("kind") == k, F.col("z"))).alias(k) for k in ("demand", "supply")])
    return best.select("symbol", "bar_ts", *[F.col(k)[c].alias(f"{k}_{c}") for k in ("demand", "supply") for c in ("distance", "low", "high")])


def retests(live: DataFrame, bars: DataFrame, minutes: int, most: int = 12, micro: int = 3) -> DataFrame:
    """Of each breakout (ZONE, bar_ts): outcome, age of the touch, after_touch, rejection_age and micro_age, all in bars of `minutes` since it.

    The first later bar that reaches the refined zone makes the outcome touched, or degraded if it goes
    through to its other side; if none does before `most` bars' time, it is late with the first bar after
    that, or waiting while there is none. after_touch: what the bar after a touch makes of it, reused or late.
    After a touch the first close beyond the zone confirms by rejection, the first beyond the extremes of
    the `micro` bars before the touch by a break of structure. The bars after a bar come with it as an array.
    """
    ahead = F.collect_list(F.struct("ts", "high", "low", "close")).over(series().rowsBetween(1, most))
    held = bars.select("symbol", F.col("ts").alias("bar_ts"), ahead.alias("ahead"))
    broken = live.where("event = 'breakout'").join(held, ["symbol", "bar_ts"])
    bull = F.col("kind") == "supply"
    seconds = lambda c: F.unix_seconds(c.cast("timestamp"))

    def looked(a: Column) -> Column:
        through = F.when(bull, a["low"] < F.col("low")).otherwise(a["high"] > F.col("high"))
        past = F.when(bull, a["close"] > F.col("major_high")).otherwise(a["close"] < F.col("major_low"))
        return F.struct(
            F.floor((seconds(a["ts"]) - seconds(F.col("bar_ts"))) / (60 * minutes)).alias("age"),
            ((a["high"] >= F.col("low")) & (a["low"] <= F.col("high"))).alias("touches"),
            through.alias("through"), past.alias("past"), a["high"].alias("high"), a["low"].alias("low"), a["close"].alias("close"),
        )

    rows = broken.withColumn("seen", F.transform("ahead", looked))
    rows = rows.withColumn("early", F.filter("seen", lambda x: x["age"] < most))
    place = F.get(F.filter(F.transform("early", lambda x, i: F.when(x["touches"], i)), lambda i: i.isNotNull()), F.lit(0))
    rows = rows.withColumn("at", place).withColumn("touch", F.get("early", F.col("at")))
    outcome = F.when(F.col("at").isNotNull(), F.when(F.col("touch.through"), "degraded").otherwise("touched")).when(F.size("seen") > F.size("early"), "late").otherwise("waiting")
    rows = rows.withColumn("outcome", outcome)
    good = F.col("outcome") == "touched"
    after = F.get("seen", F.col("at") + 1)
    then = F.when(good, F.when(after["age"] >= most, "late").when(after.isNotNull(), "reused"))
    front = F.slice("seen", F.greatest(F.lit(1), F.col("at") - micro + 1), F.least(F.col("at"), F.lit(micro)))
    edge = F.when(bull, F.array_max(F.transform(front, lambda x: x["high"]))).otherwise(F.array_min(F.transform(front, lambda x: x["low"])))
    rows = rows.withColumn("edge", F.when(good, edge))
    behind = F.slice("seen", F.col("at") + 1, F.lit(most))
    first = lambda test: F.when(good, F.get(F.filter(behind, test), F.lit(0))["age"])
    broke = lambda x: F.when(bull, x["close"] > F.col("edge")).otherwise(x["close"] < F.col("edge"))
    return rows.select(*ZONE, "bar_ts", "outcome", F.col("touch.age").alias("age"), then.alias("after_touch"), first(lambda x: x["past"]).alias("rejection_age"), first(broke).alias("micro_age"))


def structure(bars: DataFrame, live: DataFrame, size: Column, blocks: int = 50, gaps: int = 20, factor: float = 1.5) -> DataFrame:
    """symbol, ts, block_score, gap_score, zone_score, structural of every bar: how much stands near its close.

    Order blocks and gaps that were there by the bar, each less the older and the farther it is; live zones
    (what zone_bars gives, but those that the bar breaks) by their distance in units of `size`, the usual range.
    Without a usual range the score is a half. Blocks and gaps come to a bar in arrays over the bars before it.
    """
    by = series()
    nxt, prv = (lambda c: F.lead(c).over(by)), (lambda c: F.lag(c).over(by))
    body, then = F.col("close") - F.col("open"), nxt("close") - nxt("open")
    is_block = ((body < 0) & (then > 0) & (then > -body * factor)) | ((body > 0) & (then < 0) & (-then > body * factor))
    strength = F.abs(body) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-9)) * F.when(F.col("volume") > 0, nxt("volume") / F.col("volume")).otherwise(1.0)
    up, down = nxt("low") > prv("high"), nxt("high") < prv("low")
    middle = F.when(up, (nxt("low") + prv("high")) / 2).when(down, (prv("low") + nxt("high")) / 2)
    marked = bars.withColumns({"o": F.row_number().over(by), "size": size})
    marked = marked.withColumns({
        "block": F.when(is_block, F.struct("o", ((F.col("high") + F.col("low")) / 2).alias("middle"), strength.alias("weight"))),
        "gap": F.when(up | down, F.struct("o", middle.alias("middle"), F.lit(1.0).alias("weight"))),
    })
    seen = marked.withColumns({"blocks": F.collect_list("block").over(by.rowsBetween(-blocks, -1)), "gaps": F.collect_list("gap").over(by.rowsBetween(-gaps, -1))})

    def near(items: str) -> Column:
        worth = lambda x: x["weight"] * F.exp(-0.1 * (F.col("o") - x["o"])) * F.greatest(F.lit(0.0), 1 - F.abs(F.col("close") - x["middle"]) / (F.col("size") * 5))
        return F.when(F.col("o") < 3, 0.0).otherwise(F.least(F.lit(1.0), F.aggregate(F.transform(items, worth), F.lit(0.0), lambda a, x: a + x)))

    away = F.when(F.col("bar_close").between(F.col("low"), F.col("high")), 0.0).otherwise(F.least(F.abs(F.col("bar_close") - F.col("low")), F.abs(F.col("bar_close") - F.col("high"))))
    rows = live.where("event <> 'breakout'").select("symbol", F.col("bar_ts").alias("ts"), away.alias("away"))
    rows = rows.join(seen.select("symbol", "ts", "size"), ["symbol", "ts"]).where("size > 0")
    zoned = rows.groupBy("symbol", "ts").agg((F.sum(F.greatest(F.lit(0.0), 1 - F.col("away") / F.col("size"))) / 4).alias("zone"))
    found = seen.join(zoned, ["symbol", "ts"], "left")
    scores = [near("blocks"), near("gaps"), F.least(F.lit(1.0), F.coalesce("zone", F.lit(0.0)))]
    parts = [F.when(F.col("size") > 0, s).otherwise(0.0) for s in scores]
    whole = F.when(F.col("size") > 0, sum((w * s for w, s in zip(WEIGHTS[1:], scores[1:], strict=True)), WEIGHTS[0] * scores[0])).otherwise(0.5)
    return found.select("symbol", "ts", *[p.alias(n) for p, n in zip(parts, ("block_score", "gap_score", "zone_score"), strict=True)], whole.alias("structural"))

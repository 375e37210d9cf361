"""Queries of several timeframes and of zones as intervals; with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import candles as C
from tidemark.functions import indicators as ind
from tidemark.operators import frames as T
from tidemark.operators import zones as Z
from tidemark.operators.bars import series
from tidemark.plans.registry import Registry
from tidemark.sources.tables import clock_bars, table

query = Registry()


def _bars_sql(name: str, minutes: int) -> str:
    return f"""{name} AS (SELECT symbol, b AS ts, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*) AS volume
        FROM (SELECT event_type AS symbol, time_bucket(INTERVAL '{minutes} minutes', ts) AS b, ts, event_id, value FROM events) GROUP BY symbol, b)"""


ALL_BARS = ", ".join(_bars_sql(n, m) for n, m in T.FRAMES.items())


def _narrow(spark, sf_dir) -> DataFrame:
    return clock_bars(table(spark, sf_dir, "events"), "5 minutes")


def _frames(spark, sf_dir) -> dict[str, tuple[DataFrame, int]]:
    narrow = _narrow(spark, sf_dir)
    return {n: (narrow if n == "m5" else T.rolled(narrow, m), m) for n, m in T.FRAMES.items()}


def _lists(closed: bool) -> str:
    """SQL: of each frame's bars the last ten with them, and when they are seen."""
    return ", ".join(
        f"l_{n} AS (SELECT symbol, ts{f' + INTERVAL {m} minutes' if closed else ''} AS at, list({{'ts': ts, 'c': close, 'r': greatest(high - low, 1e-9)}}) OVER (PARTITION BY symbol ORDER BY ts ROWS 9 PRECEDING) AS {n} FROM {n})" for n, m in T.FRAMES.items()
    )


def _seen(rows: str) -> str:
    joins = " ".join(f"ASOF LEFT JOIN l_{n} ON l_{n}.symbol = d.symbol AND l_{n}.at <= d.ts" for n in T.FRAMES)
    return f"SELECT d.*, {', '.join(f'coalesce({n}, []) AS {n}' for n in T.FRAMES)} FROM {rows} d {joins}"


_SCORES = ", ".join(
    f"{w} * CASE WHEN len({n}) < {k} THEN 0.0 ELSE greatest(-1.0, least(1.0, ({n}[-1].c - {n}[-{k}].c) / (2 * list_sum(list_transform({n}, lambda x: x.r)) / 10))) END" for n, (k, w) in T.BIAS.items()
)
_WAYS = " + ".join(f"CASE WHEN len({n}) < 2 THEN 0 WHEN {n}[-1].c > {n}[-2].c THEN 1 ELSE -1 END" for n in T.BIAS)


@query(
    "frame_bias",
    f"""WITH {ALL_BARS}, {_lists(True)}, e AS (SELECT DISTINCT event_type AS symbol, ts FROM events), s AS ({_seen('e')}),
        b AS (SELECT symbol, ts, [{_SCORES}] AS v, ({_WAYS}) / 5 AS alignment FROM s),
        k AS (SELECT *, list_sum(v) AS total, list_filter(v, lambda x: abs(x) > 0.01) AS told FROM b)
    SELECT symbol, ts, round(greatest(-1.0, least(1.0, total * CASE WHEN len(told) >= 3 AND (list_min(told) > 0 OR list_max(told) < 0) THEN 1 + 0.2 * len(told) ELSE 1.0 END)), 6) AS bias, round(alignment, 6) AS alignment FROM k""",
)
def frame_bias(spark, sf_dir):
    """What the closed bars of five timeframes say at each event: a weighted direction, and how far they agree."""
    asked = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "ts").distinct()
    seen = T.visible(asked, _frames(spark, sf_dir))
    own = {n: F.col(n) for n in T.FRAMES}
    return seen.select("symbol", "ts", T.directional_bias(own).alias("bias"), T.trend_alignment(own).alias("alignment"))


@query(
    "replay_view",
    f"""WITH {ALL_BARS}, {_lists(False)}, s AS ({_seen('m5')})
    SELECT symbol, ts, round(close - 0.01, 6) AS bid, round(close + 0.01, 6) AS ask, {', '.join(f'len({n}) AS {n}_bars, {n}[-1].ts AS {n}_last, round({n}[-1].c, 6) AS {n}_close' for n in T.FRAMES)} FROM s""",
)
def replay_view(spark, sf_dir):
    """What a replay of history shows at each bar of five minutes: the last ten bars of each timeframe that have begun, and a quote about the close."""
    narrow = _narrow(spark, sf_dir)
    seen = T.visible(narrow.select("symbol", "ts"), _frames(spark, sf_dir), closed=False)
    quote = narrow.select("symbol", "ts", (F.col("close") - 0.01).alias("bid"), (F.col("close") + 0.01).alias("ask"))
    last = lambda n: F.get(n, F.size(n) - 1)
    told = [c for n in T.FRAMES for c in (F.size(n).cast("long").alias(f"{n}_bars"), last(n)["ts"].alias(f"{n}_last"), last(n)["close"].alias(f"{n}_close"))]
    return seen.join(quote, ["symbol", "ts"]).select("symbol", "ts", "bid", "ask", *told)


KEEP = 60


def _bar_lists() -> str:
    """SQL: of each frame's bars the last sixty with them, and when they are closed."""
    return ", ".join(f"k_{n} AS (SELECT symbol, ts + INTERVAL {m} minutes AS at, list({{'o': open, 'h': high, 'l': low, 'c': close}}) OVER (PARTITION BY symbol ORDER BY ts ROWS {KEEP - 1} PRECEDING) AS {n} FROM {n})" for n, m in T.FRAMES.items() if n in C.TREND)


def _closes(x: str) -> str:
    return f"list_transform({x}, lambda b: b.c)"


def _ema_sql(values: str, n: int) -> str:
    alpha = 2.0 / (n + 1)
    return f"list_reduce({values}, lambda a, x: x * {alpha!r} + a * {1 - alpha!r})"


def _rsi_sql(c: str) -> str:
    d = f"list_transform(range(2, len({c}) + 1), lambda i: ({c})[i] - ({c})[i - 1])"
    gain, loss = (f"(list_sum(list_transform({d}, lambda d: greatest({sign}d, 0.0))) / (len({c}) - 1))" for sign in ("", "-"))
    return f"CASE WHEN {loss} <= 0 THEN 100.0 ELSE 100 - 100 / (1 + {gain} / {loss}) END"


def _slope_sql(x: str) -> str:
    return f"greatest(-1.0, least(1.0, (({x})[-1].c - ({x})[1].c) / greatest(list_sum(list_transform({x}, lambda b: abs(b.h - b.l))), 1e-9)))"


def _trend_sql(n: str) -> str:
    far = f"CASE WHEN len({n}) >= 60 THEN {_ema_sql(_closes(f'{n}[-60:]'), 50)} ELSE {_ema_sql(_closes(n), 30)} END"
    near, lean = _ema_sql(_closes(f"{n}[-30:]"), 20), _slope_sql(f"{n}[-12:]")
    straight = f"least(1.0, abs({n}[-1].c - ({n}[-20:])[1].c) / greatest(list_sum(list_transform({n}[-20:], lambda b: abs(b.h - b.l))), 1e-9))"
    order = f"CASE WHEN {n}[-1].c > {near} AND {near} > {far} THEN 1.0 WHEN {n}[-1].c < {near} AND {near} < {far} THEN -1.0 ELSE 0.0 END"
    return f"CASE WHEN len({n}) < 30 THEN 0.0 ELSE greatest(-1.0, least(1.0, 0.55 * {order} + 0.30 * {lean} + 0.15 * {straight} * CASE WHEN {lean} >= 0 THEN 1.0 ELSE -1.0 END)) END"


_MACD = """list_reduce(list_transform(m15, lambda b: {'x': b.c, 'f': b.c, 's': b.c, 'g': 0.0, 'h': [0.0]}), lambda a, b: {'x': b.x, 'f': b.x * 2 / 13 + a.f * 11 / 13, 's': b.x * 2 / 27 + a.s * 25 / 27,
            'g': ((b.x * 2 / 13 + a.f * 11 / 13) - (b.x * 2 / 27 + a.s * 25 / 27)) * 0.2 + a.g * 0.8,
            'h': list_append(a.h, ((b.x * 2 / 13 + a.f * 11 / 13) - (b.x * 2 / 27 + a.s * 25 / 27)) * 0.8 - a.g * 0.8)})"""
_BODY = "least(1.0, abs(m15[-1].c - m15[-1].o) / greatest(abs(m15[-1].h - m15[-1].l), 1e-9)) * CASE WHEN m15[-1].c >= m15[-1].o THEN 1.0 ELSE -1.0 END"


@query(
    "indicator_scores",
    f"""WITH {ALL_BARS}, {_bar_lists()}, d AS (SELECT symbol, ts + INTERVAL 15 minutes AS ts FROM m15),
        s AS (SELECT d.*, {', '.join(f'coalesce({n}, []) AS {n}' for n in C.TREND)} FROM d {' '.join(f'ASOF LEFT JOIN k_{n} ON k_{n}.symbol = d.symbol AND k_{n}.at <= d.ts' for n in C.TREND)}),
        e AS (SELECT *, {_MACD}.h AS hist, {_closes('m15')} AS c, CASE WHEN len(m15) >= 20 THEN m15 ELSE m5 END AS u FROM s),
        q AS (SELECT *, list_max(list_transform(u[-20:][:-2], lambda b: b.h)) AS top, list_min(list_transform(u[-20:][:-2], lambda b: b.l)) AS low FROM e),
        r AS (SELECT symbol, ts, CASE WHEN len(m15) < 35 THEN 0.0 ELSE greatest(-1.0, least(1.0, 0.30 * greatest(-1.0, least(1.0, ({_rsi_sql('c[-15:]')} - {_rsi_sql('c[-20:-6]')}) / 25)) + 0.35 * greatest(-1.0, least(1.0, (hist[-1] - hist[-4]) / greatest(abs(c[-1]) * 0.0004, 1e-9)))
                + 0.25 * greatest(-1.0, least(1.0, ((c[-1] - c[-4]) / greatest(abs(c[-4]), 1e-9) - (c[-1] - c[-12]) / greatest(abs(c[-12]), 1e-9)) * 800)) + 0.10 * {_BODY})) END AS momentum,
            greatest(-1.0, least(1.0, {' + '.join(f'{w} * {_trend_sql(n)}' for n, w in C.TREND.items())})) AS trend,
            CASE WHEN len(u) < 12 THEN 0.0 ELSE greatest(-1.0, least(1.0, 0.45 * CASE WHEN u[-1].c > top THEN 1.0 WHEN u[-1].c < low THEN -1.0 ELSE 0.0 END + 0.30 * CASE WHEN u[-1].h > top AND u[-1].c < top THEN -0.7 WHEN u[-1].l < low AND u[-1].c > low THEN 0.7 ELSE 0.0 END
                + 0.15 * greatest(-1.0, least(1.0, (u[-1].c - (top + low) / 2) / greatest(top - low, 1e-9))) + 0.10 * CASE WHEN len(h1) >= 8 THEN {_slope_sql('h1[-8:]')} ELSE 0.0 END)) END AS structure FROM q)
    SELECT symbol, ts, round(momentum, 5) AS momentum, round(trend, 5) AS trend, round(structure, 5) AS structure FROM r""",
    digits=5,
)
def indicator_scores(spark, sf_dir):
    """Momentum, trend and structure at the close of each bar of fifteen minutes, from the last sixty closed bars of four timeframes."""
    frames = {n: f for n, f in _frames(spark, sf_dir).items() if n in C.TREND}
    asked = frames["m15"][0].select("symbol", (F.col("ts") + F.make_dt_interval(mins=F.lit(15))).alias("ts"))
    seen = T.visible(asked, frames, keep=KEEP)
    own = {n: F.col(n) for n in frames}
    return seen.select("symbol", "ts", C.momentum(own["m15"]).alias("momentum"), C.trend(own).alias("trend"), C.structure(own["m5"], own["m15"], own["h1"]).alias("structure"))


DAYS = 2

ZONED = f"""{_bars_sql('bars', 15)}, {_bars_sql('hours', 60)},
        n AS (SELECT *, lag(high) OVER w AS h0, lead(high) OVER w AS h2, lag(low) OVER w AS l0, lead(low) OVER w AS l2, lead(ts) OVER w + INTERVAL 60 minutes AS born FROM hours WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
        s AS (SELECT symbol, ts, born, CASE WHEN high > h0 AND high > h2 THEN 'supply' ELSE 'demand' END AS kind FROM n WHERE (high > h0 AND high > h2) OR (low < l0 AND low < l2)),
        f AS (SELECT s.symbol, s.ts AS zone_ts, kind, born, CASE WHEN kind = 'supply' THEN arg_max(b, b.high) ELSE arg_min(b, b.low) END AS b FROM s JOIN bars b ON b.symbol = s.symbol AND time_bucket(INTERVAL '60 minutes', b.ts) = s.ts GROUP BY s.symbol, s.ts, kind, born),
        z AS (SELECT symbol, zone_ts, kind, born, b.low AS major_low, b.high AS major_high, CASE WHEN kind = 'supply' THEN greatest(b.low, b.high - 3.0) ELSE b.low END AS low, CASE WHEN kind = 'supply' THEN b.high ELSE least(b.high, b.low + 3.0) END AS high FROM f),
        p AS (SELECT z.*, b.ts AS bar_ts, b.ts + INTERVAL 15 minutes AS bar_at, b.high AS bar_high, b.low AS bar_low, b.close AS bar_close, CASE WHEN kind = 'supply' THEN b.close > major_high ELSE b.close < major_low END AS beyond,
              CASE WHEN kind = 'supply' THEN b.high > major_high ELSE b.low < major_low END AS wick FROM z JOIN bars b ON b.symbol = z.symbol AND b.ts + INTERVAL 15 minutes > born AND b.ts + INTERVAL 15 minutes <= born + INTERVAL {DAYS} DAY),
        q AS (SELECT *, coalesce(bool_or(beyond) OVER (PARTITION BY symbol, zone_ts, kind ORDER BY bar_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS broken FROM p),
        live AS (SELECT *, CASE WHEN beyond THEN 'breakout' WHEN wick THEN 'wick' ELSE 'none' END AS event FROM q WHERE NOT broken)"""


def _bars(spark, sf_dir) -> DataFrame:
    return T.rolled(_narrow(spark, sf_dir), 15)


def _live(spark, sf_dir) -> DataFrame:
    """Zones of hours that stand out, bounded by the bar of fifteen minutes that does so most, with the bars of their lives."""
    bars = _bars(spark, sf_dir)
    swings = Z.swings(T.rolled(_narrow(spark, sf_dir), 60), 60)
    hour = bars.select("symbol", F.date_trunc("hour", "ts").alias("h"), "low", "high")
    inside = swings.join(hour, (swings.symbol == hour.symbol) & (swings.ts == hour.h)).select(swings.symbol, swings.ts, swings.kind, hour.low, hour.high)
    edge = F.when(F.first("kind") == "supply", F.max_by(F.struct("low", "high"), "high")).otherwise(F.min_by(F.struct("low", "high"), "low"))
    bounds = inside.groupBy("symbol", "ts").agg(edge.alias("b")).select("symbol", "ts", "b.low", "b.high")
    return Z.zone_bars(Z.zones(swings, bounds), bars, 15, DAYS)


@query("zone_events", f"WITH {ZONED} SELECT symbol, zone_ts, kind, bar_ts, event, round(low, 6) AS low, round(high, 6) AS high, round(bar_close, 6) AS bar_close FROM live WHERE event <> 'none'")
def zone_events(spark, sf_dir):
    """Bars that close beyond a living zone, which ends it, or probe beyond it with their wick alone."""
    return _live(spark, sf_dir).where("event <> 'none'").select(*Z.ZONE, "bar_ts", "event", "low", "high", "bar_close")


@query(
    "nearest_zones",
    f"""WITH {ZONED}, r AS (SELECT symbol, bar_ts, kind, {{'distance': greatest(low - bar_close, bar_close - high, 0.0), 'zone_ts': zone_ts, 'low': low, 'high': high}} AS z FROM live WHERE event <> 'breakout'),
        g AS (SELECT symbol, bar_ts, min(z) FILTER (WHERE kind = 'demand') AS d, min(z) FILTER (WHERE kind = 'supply') AS s FROM r GROUP BY symbol, bar_ts)
    SELECT symbol, bar_ts, round(d.distance, 6) AS demand_distance, round(d.low, 6) AS demand_low, round(d.high, 6) AS demand_high, round(s.distance, 6) AS supply_distance, round(s.low, 6) AS supply_low, round(s.high, 6) AS supply_high FROM g""",
)
def nearest_zones(spark, sf_dir):
    """The living zones nearest to each bar's close, below or above."""
    return Z.nearest(_live(spark, sf_dir))


@query(
    "structural_score",
    f"""WITH {ZONED}, o AS (SELECT *, row_number() OVER w AS o, lead(open) OVER w AS o2, lead(close) OVER w AS c2, lead(volume) OVER w AS v2, lag(high) OVER w AS h0, lead(high) OVER w AS h2, lag(low) OVER w AS l0, lead(low) OVER w AS l2,
            greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
        a AS (SELECT *, avg(coalesce(tr, high - low)) OVER (PARTITION BY symbol ORDER BY ts ROWS 13 PRECEDING) AS size FROM o),
        m AS (SELECT symbol, o, (high + low) / 2 AS middle, abs(close - open) / greatest(high - low, 1e-9) * CASE WHEN volume > 0 THEN v2 / volume ELSE 1.0 END AS weight, 50 AS back, 1 AS block FROM a WHERE (close < open AND c2 > o2 AND c2 - o2 > (open - close) * 1.5) OR (close > open AND c2 < o2 AND o2 - c2 > (close - open) * 1.5)
              UNION ALL SELECT symbol, o, CASE WHEN l2 > h0 THEN (l2 + h0) / 2 ELSE (l0 + h2) / 2 END, 1.0, 20, 0 FROM a WHERE l2 > h0 OR h2 < l0),
        k AS (SELECT a.symbol, a.o, block, sum(weight * exp(-0.1 * (a.o - m.o)) * greatest(0.0, 1 - abs(a.close - m.middle) / (5 * a.size))) AS s FROM a JOIN m ON m.symbol = a.symbol AND a.o - m.o BETWEEN 1 AND back WHERE a.o >= 3 AND a.size > 0 GROUP BY ALL),
        d AS (SELECT l.symbol, bar_ts, sum(greatest(0.0, 1 - CASE WHEN bar_close BETWEEN l.low AND l.high THEN 0.0 ELSE least(abs(bar_close - l.low), abs(bar_close - l.high)) END / size)) / 4 AS s FROM live l JOIN a ON a.symbol = l.symbol AND a.ts = bar_ts WHERE event <> 'breakout' AND size > 0 GROUP BY ALL),
        t AS (SELECT a.symbol, a.ts, size, least(1.0, coalesce(b.s, 0.0)) AS block_score, least(1.0, coalesce(g.s, 0.0)) AS gap_score, least(1.0, coalesce(d.s, 0.0)) AS zone_score FROM a LEFT JOIN k b ON b.symbol = a.symbol AND b.o = a.o AND b.block = 1 LEFT JOIN k g ON g.symbol = a.symbol AND g.o = a.o AND g.block = 0 LEFT JOIN d ON d.symbol = a.symbol AND d.bar_ts = a.ts)
    SELECT symbol, ts, round(block_score, 6) AS block_score, round(gap_score, 6) AS gap_score, round(zone_score, 6) AS zone_score, round(CASE WHEN size > 0 THEN 0.4 * block_score + 0.3 * gap_score + 0.3 * zone_score ELSE 0.5 END, 6) AS structural FROM t""",
)
def structural_score(spark, sf_dir):
    """How much order blocks, gaps and living zones stand near each bar's close, in units of its usual range."""
    bars = _bars(spark, sf_dir)
    before = F.lag("close").over(series())
    ranges = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    return Z.structure(bars, _live(spark, sf_dir), F.avg(ranges).over(ind.last(series(), 14)))


@query(
    "zone_retests",
    f"""WITH {ZONED}, o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS o FROM bars), x AS (SELECT l.symbol, zone_ts, kind, bar_ts, l.low, l.high, major_low, major_high, o.o AS bo FROM live l JOIN o ON o.symbol = l.symbol AND o.ts = l.bar_ts WHERE event = 'breakout'),
        j AS (SELECT x.*, o.o - bo AS place, CAST(floor((epoch(o.ts) - epoch(bar_ts)) / 900) AS BIGINT) AS age, o.high >= x.low AND o.low <= x.high AS touches, CASE WHEN kind = 'supply' THEN o.low < x.low ELSE o.high > x.high END AS through,
              CASE WHEN kind = 'supply' THEN o.close > major_high ELSE o.close < major_low END AS past, o.high AS h, o.low AS l, o.close AS c FROM x JOIN o ON o.symbol = x.symbol AND o.o BETWEEN bo + 1 AND bo + 12),
        t AS (SELECT symbol, zone_ts, kind, min(place) FILTER (WHERE touches AND age < 12) AS pos, count(*) FILTER (WHERE age >= 12) AS later FROM j GROUP BY ALL),
        r AS (SELECT x.symbol, x.zone_ts, x.kind, x.bar_ts, t.pos, b.age, CASE WHEN t.pos IS NULL THEN CASE WHEN later > 0 THEN 'late' ELSE 'waiting' END WHEN b.through THEN 'degraded' ELSE 'touched' END AS outcome FROM x LEFT JOIN t USING (symbol, zone_ts, kind) LEFT JOIN j b ON b.symbol = x.symbol AND b.zone_ts = x.zone_ts AND b.kind = x.kind AND b.place = t.pos),
        e AS (SELECT r.symbol, r.zone_ts, r.kind, CASE WHEN r.kind = 'supply' THEN max(h) ELSE min(l) END AS edge FROM r JOIN j USING (symbol, zone_ts, kind) WHERE outcome = 'touched' AND place BETWEEN pos - 3 AND pos - 1 GROUP BY r.symbol, r.zone_ts, r.kind),
        c AS (SELECT r.symbol, r.zone_ts, r.kind, min(j.age) FILTER (WHERE past) AS rejection_age, min(j.age) FILTER (WHERE CASE WHEN r.kind = 'supply' THEN c > edge ELSE c < edge END) AS micro_age, min(j.age) FILTER (WHERE place = pos + 1) AS next FROM r JOIN j USING (symbol, zone_ts, kind) LEFT JOIN e USING (symbol, zone_ts, kind) WHERE outcome = 'touched' AND place >= pos GROUP BY r.symbol, r.zone_ts, r.kind)
    SELECT symbol, zone_ts, kind, r.bar_ts, outcome, r.age, CASE WHEN next >= 12 THEN 'late' WHEN next IS NOT NULL THEN 'reused' END AS after_touch, rejection_age, micro_age FROM r LEFT JOIN c USING (symbol, zone_ts, kind)""",
)
def zone_retests(spark, sf_dir):
    """What comes of each breakout of a zone within the time of twelve bars: the first touch, and what confirms it."""
    return Z.retests(_live(spark, sf_dir), _bars(spark, sf_dir), 15)

"""Queries of reports, exams, networks and many-column scores; with DuckDB SQL."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import network as N
from tidemark.operators import exam as E
from tidemark.operators import journal, monitor
from tidemark.operators.curves import curve
from tidemark.operators.features import rolling_z
from tidemark.plans.market import DEALS
from tidemark.plans.registry import Registry
from tidemark.plans.state import FOLLOWED, HORIZON, _decisions
from tidemark.sources.scratch import kept
from tidemark.sources.tables import deals, table, ticks

query = Registry()


def _curve_sql(rows: str, order: str, partition: str = "") -> str:
    """SQL: named subqueries that end in `curve`, of rows with profit."""
    by = f"{f'PARTITION BY {partition} ' if partition else ''}ORDER BY {order}"
    group = f"GROUP BY {partition}" if partition else ""
    names = f"{partition}, " if partition else ""
    return f"""c1 AS (SELECT {names}profit, sum(profit) OVER ({by} ROWS UNBOUNDED PRECEDING) AS equity, row_number() OVER ({by}) AS place, coalesce(sum(CAST(profit > 0 AS INT)) OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM {rows}),
        c2 AS (SELECT *, greatest(0.0, max(equity) OVER ({f'PARTITION BY {partition} ' if partition else ''}ORDER BY place ROWS UNBOUNDED PRECEDING)) AS top FROM c1),
        c3 AS (SELECT {names}island, count_if(profit < 0) AS run FROM c1 GROUP BY {names}island),
        c4 AS (SELECT {names}max(run) AS max_loss_streak FROM c3 {group}),
        curve AS (SELECT {names}count(*) AS n, arg_max(equity, place) AS ending, max(top) AS peak, max(top - equity) AS max_drawdown, coalesce(min(place) FILTER (WHERE equity >= 50), 0) AS trades_to_goal FROM c2 {group})"""


@query(
    "profit_curves",
    f"""WITH {DEALS}, {_curve_sql('deals', 'ts, ticket', 'symbol')}
    SELECT symbol, n, round(ending, 6) AS ending, round(peak, 6) AS peak, round(max_drawdown, 6) AS max_drawdown, max_loss_streak, trades_to_goal FROM curve JOIN c4 USING (symbol)""",
)
def profit_curves(spark, sf_dir):
    """Running profit of each symbol's deals, folded by day."""
    return curve(deals(table(spark, sf_dir, "events")), ["symbol"], "ts", ["ticket"])


_SUMMARY = "CAST(count(*) AS DOUBLE) AS n, CAST(count_if(profit > 0) AS DOUBLE) AS wins, CAST(count_if(profit < 0) AS DOUBLE) AS losses, count_if(profit > 0) / count(*) AS win_rate, sum(profit) AS net, avg(profit) AS average, sum(inverse) AS inverse_net, avg(inverse) AS inverse_average, count_if(inverse > 0) / count(*) AS inverse_win_rate, sum(profit) / 50 AS progress"
_MEASURES = "n, wins, losses, win_rate, net, average, inverse_net, inverse_average, inverse_win_rate, progress"
_BAND = "CASE WHEN (ask - bid) / 20 < 0.0005 THEN '<0.0005' WHEN (ask - bid) / 20 < 0.001 THEN '0.0005-0.001' WHEN (ask - bid) / 20 < 0.002 THEN '0.001-0.002' ELSE '>=0.002' END"


@query(
    "monitor_report",
    f"""WITH {FOLLOWED}, j AS (SELECT d.*, coalesce(status, 'pending') AS status, coalesce(most_favorable, 0.0) AS best, coalesce(most_adverse, 0.0) AS worst FROM d LEFT JOIN g USING (decided, symbol, side, bid, ask)),
        r AS (SELECT *, CASE WHEN status = 'win' THEN best ELSE -worst END AS profit, CASE WHEN worst >= 20 THEN worst WHEN best >= 10 THEN -best WHEN status = 'loss' AND worst > 0 THEN worst WHEN status = 'win' AND best > 0 THEN -best ELSE 0.0 END AS inverse FROM j WHERE status <> 'pending'),
        s AS (SELECT 'all' AS section, 'all' AS bucket, {_SUMMARY} FROM r UNION ALL SELECT 'by_side', CASE WHEN side = 1 THEN 'long' ELSE 'short' END, {_SUMMARY} FROM r GROUP BY 2
              UNION ALL SELECT 'by_symbol', symbol, {_SUMMARY} FROM r GROUP BY 2 UNION ALL SELECT 'by_band', {_BAND}, {_SUMMARY} FROM r GROUP BY 2),
        u AS (SELECT section, bucket, measure, value FROM (UNPIVOT s ON {_MEASURES} INTO NAME measure VALUE value)),
        k AS (SELECT 'counts' AS section, 'all' AS bucket, unnest(['rows', 'resolved', 'pending', 'duplicates']) AS measure, unnest([count(*), count_if(status <> 'pending'), count_if(status = 'pending'), 0]) AS value FROM j),
        p AS (SELECT decided, symbol, side, bid, ask, profit FROM r), {_curve_sql('p', 'decided, symbol, side, bid, ask')},
        v AS (SELECT 'curve' AS section, 'all' AS bucket, unnest(['n', 'ending', 'peak', 'max_drawdown', 'max_loss_streak', 'trades_to_goal']) AS measure, unnest([CAST(n AS DOUBLE), ending, peak, max_drawdown, max_loss_streak, trades_to_goal]) AS value FROM curve, c4)
    SELECT section, bucket, measure, round(CAST(value AS DOUBLE), 5) AS value FROM (SELECT * FROM u UNION ALL SELECT * FROM k UNION ALL SELECT * FROM v)""",
    digits=5,
)
def monitor_report(spark, sf_dir):
    """The report on shadow_journal's decisions, its document as rows of section, bucket and measure."""
    given = table(spark, sf_dir, "events")
    found = journal.followed(_decisions(spark, sf_dir), ticks(given), HORIZON)
    doc = monitor.report(kept(found, "journal"))  # read for each part of the report
    measures = [m.strip() for m in _MEASURES.split(",")]
    listed = lambda s, names: F.array(*[F.struct(F.lit(n).alias("measure"), s[n].cast("double").alias("value")) for n in names])
    part = lambda section, bucket, values: F.struct(F.lit(section).alias("section"), bucket.alias("bucket"), values.alias("values"))
    told = lambda section: lambda b: part(section, b["bucket"], listed(b["summary"], measures))
    curves = ("n", "ending", "peak", "max_drawdown", "max_loss_streak", "trades_to_goal")
    parts = [
        F.array(part("counts", F.lit("all"), listed(F.col("counts"), ("rows", "resolved", "pending", "duplicates"))), part("curve", F.lit("all"), listed(F.col("curve"), curves)), part("all", F.lit("all"), listed(F.col("buckets.all"), measures))),
        *[F.transform(f"buckets.{c}", told(c)) for c in ("by_side", "by_symbol", "by_band")],
    ]
    rows = doc.select(F.explode(F.flatten(F.array(*parts))).alias("p"))
    return rows.select("p.section", "p.bucket", F.explode("p.values").alias("v")).select("section", "bucket", "v.*")


NAMES = ("momentum", "trend", "volume", "order_block", "volatility_risk", "entry_distance", "spread_danger", "orderflow", "m5_score", "m15_score", "context_score", "structure_score", "volatility_score", "momentum_indicator", "trend_indicator", "orderflow_volume", "risk_math", "statistical_score")
_RAW = ", ".join(f"(value * {k + 1}) % {7 + k} AS {n}" for k, n in enumerate(NAMES))


@query(
    "feature_scores",
    f"""WITH e AS (SELECT event_id, event_type AS symbol, date_trunc('hour', ts) AS ts, {_RAW} FROM events), p AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY event_id) = 1),
        w AS (SELECT symbol, ts, {', '.join(f'avg({n}) OVER w AS {n}_m, stddev_pop({n}) OVER w AS {n}_d' for n in NAMES)} FROM p WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 99 PRECEDING))
    SELECT event_id, symbol, ts, {', '.join(f'round(({n} - {n}_m) / CASE WHEN {n}_d > 0 THEN {n}_d ELSE 1.0 END, 5) AS {n}_z' for n in NAMES)} FROM e JOIN w USING (symbol, ts)""",
    digits=5,
)
def feature_scores(spark, sf_dir):
    """Eighteen columns of each event against the hundred hours of its symbol, of which each counts once."""
    raw = [((F.col("value") * (k + 1)) % (7 + k)).alias(n) for k, n in enumerate(NAMES)]
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), *raw)
    return rolling_z(e, list(NAMES), "event_id").select("event_id", "symbol", "ts", *[f"{n}_z" for n in NAMES])


@query(
    "answer_collapse",
    """WITH a AS (SELECT source, trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')) AS t FROM documents), h AS (SELECT source, t, array_to_string(list_filter(string_split(t, ' '), lambda w: w <> '')[1:5], ' ') AS h FROM a),
        n AS (SELECT source, count(*) AS answers, count_if(t <> '') AS full_, count(DISTINCT t) FILTER (WHERE t <> '') AS kinds FROM h GROUP BY source),
        s AS (SELECT source, max(c) AS same FROM (SELECT source, t, count(*) AS c FROM h WHERE t <> '' GROUP BY ALL) GROUP BY source), l AS (SELECT source, max(c) AS alike FROM (SELECT source, h, count(*) AS c FROM h WHERE t <> '' GROUP BY ALL) GROUP BY source)
    SELECT source, answers, round(CASE WHEN full_ > 0 THEN 100 * kinds / full_ ELSE 0.0 END, 6) AS diversity, coalesce(same, answers) AS most_same, coalesce(alike, answers) AS most_alike,
        coalesce(same IS NULL OR same >= greatest(6, (answers + 2) // 3) OR alike >= greatest(8, (answers + 1) // 2), true) AS collapsed FROM n LEFT JOIN s USING (source) LEFT JOIN l USING (source)""",
)
def answer_collapse(spark, sf_dir):
    """Each source's texts as answers of an exam: how many differ, and how often the most frequent ones come."""
    return E.collapse(_answers(spark, sf_dir), "source")


def _answers(spark, sf_dir) -> DataFrame:
    said = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"\s+", " "))
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", said.alias("answer"))


CATEGORIES = {"en": "grammar", "de": "primitive_arithmetic", "fr": "foundation_economics", "es": "creativity"}
_A = """a AS (SELECT source, CASE lang WHEN 'en' THEN 'grammar' WHEN 'de' THEN 'primitive_arithmetic' WHEN 'fr' THEN 'foundation_economics' WHEN 'es' THEN 'creativity' ELSE 'language_control' END AS category,
            trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')) AS t FROM documents),
        b AS (SELECT *, t <> '' AND regexp_matches(t, '(?:^|[^\\pL\\pN_])(?:order|orders|orderes)(?:$|[^\\pL\\pN_])|(?:^|[^\\pL\\pN_])(?:copy|copys|copyes|copies)(?:$|[^\\pL\\pN_])|(?:^|[^\\pL\\pN_])the work(?:$|[^\\pL\\pN_])|(?:^|[^\\pL\\pN_])(?:a|as|aes)(?:$|[^\\pL\\pN_])') AS correct, least(1.0, length(t) / 1000) AS quality FROM a)"""


@query("exam_answers", f"WITH {_A} SELECT source, category, count(*) AS answers, count_if(correct) AS correct FROM b GROUP BY ALL")
def exam_answers(spark, sf_dir):
    """Texts of each source as answers in categories by their language; one that names any of four terms, also in the plural, is right."""
    return _examined(spark, sf_dir).groupBy("source", "category").agg(F.count(F.lit(1)).alias("answers"), F.count_if("correct").alias("correct"))


def _examined(spark, sf_dir) -> DataFrame:
    category = F.lit("language_control")
    for lang, name in CATEGORIES.items():
        category = F.when(F.col("lang") == lang, name).otherwise(category)
    none = F.lit(None)
    asked = _answers(spark, sf_dir).withColumns({
        "category": category, "flags": F.array().cast("array<string>"), "number": none.cast("string"), "units": none.cast("array<string>"), "expression": none.cast("string"), "conceptual": F.lit(False),
        "all_terms": none.cast("array<string>"), "any_terms": F.array(*[F.lit(t) for t in ("order", "copy", "the work", "a")]), "quality": F.least(F.lit(1.0), F.length("answer") / 1000),
    })
    return E.correct(asked)


_MISS = "coalesce(avg(CASE WHEN category IN ({c}) THEN CAST(correct AS DOUBLE) END), 1.0)"


@query(
    "exam_feedback",
    f"""WITH {_A}, h AS (SELECT source, t, array_to_string(list_filter(string_split(t, ' '), lambda w: w <> '')[1:5], ' ') AS h FROM a),
        n AS (SELECT source, count(*) AS answers, coalesce(count(DISTINCT t) FILTER (WHERE t <> '') / nullif(count_if(t <> ''), 0), 0.0) AS diversity FROM h GROUP BY source),
        m AS (SELECT source, max(c) FILTER (WHERE k = 0) AS same, max(c) FILTER (WHERE k = 1) AS alike FROM (SELECT source, 0 AS k, t, count(*) AS c FROM h WHERE t <> '' GROUP BY ALL UNION ALL SELECT source, 1, h, count(*) FROM h WHERE t <> '' GROUP BY ALL) GROUP BY source),
        f AS (SELECT source, diversity, coalesce(same IS NULL OR same >= greatest(6, (answers + 2) // 3) OR alike >= greatest(8, (answers + 1) // 2), true) AS fell FROM n LEFT JOIN m USING (source)),
        s AS (SELECT source, {_MISS.format(c="'primitive_arithmetic', 'number_sense'")} AS arithmetic, {_MISS.format(c="'foundation_economics'")} AS economics, {_MISS.format(c="'grammar', 'semantic_plausibility'")} AS grammar, {_MISS.format(c="'language_control'")} AS control, {_MISS.format(c="'creativity'")} AS creativity,
              avg(quality) AS quality, avg(CASE WHEN t = '' THEN 0.0 WHEN quality >= 0.55 THEN 1.0 WHEN quality >= 0.3 THEN 0.5 ELSE 0.0 END) AS attempt, avg(CAST(correct AS DOUBLE)) AS right_ FROM b GROUP BY source)
    SELECT source, round(greatest(0.65, least(3.5, 1 + 2.5 * (1 - arithmetic))), 6) AS arithmetic_weight, round(greatest(0.65, least(3.0, 1 + 2.0 * (1 - economics))), 6) AS economics_weight,
        round(greatest(0.65, least(3.25, 1 + 1.25 * (1 - quality) + 1.1 * (1 - grammar) + 0.6 * (1 - control))), 6) AS language_weight, round(greatest(0.65, least(2.25, 1 + 0.65 * (1 - quality) + 0.45 * (1 - attempt))), 6) AS conversation_weight,
        round(greatest(0.65, least(2.75, 1 + 0.9 * (1 - diversity) + 0.65 * (1 - creativity) + CASE WHEN fell THEN 0.5 ELSE 0 END)), 6) AS creativity_weight, round(greatest(0.9, least(2.75, (1 + 1.55 * (1 - right_)) * (1 - 0.1 * attempt))), 6) AS hard_negative_scale,
        round(greatest(0.9, least(3.5, 1 + 1.75 * (1 - diversity) + 0.8 * (1 - control) + CASE WHEN fell THEN 0.9 ELSE 0 END)), 6) AS repetition_scale FROM s JOIN f USING (source)""",
)
def exam_feedback(spark, sf_dir):
    """What training should stress after each source's exam."""
    answers = _examined(spark, sf_dir)
    return E.feedback(answers, E.collapse(_answers(spark, sf_dir), "source"), "source")


def _weights(rows: int, columns: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights by a rule: sines of growing steps, so no file is needed."""
    w = np.array([[math.sin(1.3 * salt + 0.7 * i + 1.9 * j) for j in range(columns)] for i in range(rows)]) / math.sqrt(rows)
    return w, np.array([0.1 * math.cos(salt + j) for j in range(columns)])


SIZES = (64, 8, 8, 8, 1)
LAYERS = [_weights(a, b, k) for k, (a, b) in enumerate(zip(SIZES, SIZES[1:]))]


def _layer_sql(source: str, k: int) -> str:
    w, b = LAYERS[k]
    rows = ", ".join(f"list_dot_product({source}, CAST({w[:, j].tolist()} AS DOUBLE[])) + {float(b[j])!r}" for j in range(w.shape[1]))
    return f"[{rows}]"


def _normal_sql(x: str) -> str:
    return f"list_transform({x}, lambda v: (v - list_avg({x})) / sqrt(list_var_pop({x}) + 1e-5))"


def _leaky_sql(x: str) -> str:
    return f"list_transform({x}, lambda v: CASE WHEN v > 0 THEN v ELSE 0.01 * v END)"


@query(
    "edge_probability",
    f"""WITH e AS (SELECT vec_id, embedding AS v, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT i, avg(CAST(x AS DOUBLE)) AS m, stddev_pop(CAST(x AS DOUBLE)) AS d FROM e GROUP BY i),
        z AS (SELECT vec_id, list((CAST(x AS DOUBLE) - m) / CASE WHEN d > 0 THEN d ELSE 1.0 END ORDER BY i) AS z FROM e JOIN m USING (i) GROUP BY vec_id),
        h0 AS (SELECT vec_id, z, {_layer_sql('z', 0)} AS a FROM z), h1 AS (SELECT vec_id, z, {_leaky_sql('a')} AS h FROM h0), n1 AS (SELECT *, {_normal_sql('h')} AS n FROM h1),
        h2 AS (SELECT *, {_layer_sql('n', 1)} AS a FROM n1), l2 AS (SELECT vec_id, z, h, {_leaky_sql('a')} AS g FROM h2), n2 AS (SELECT *, {_normal_sql('g')} AS n FROM l2), h3 AS (SELECT *, {_layer_sql('n', 2)} AS a FROM n2), l3 AS (SELECT vec_id, z, h, {_leaky_sql('a')} AS g FROM h3),
        r AS (SELECT vec_id, z, list_transform(range(1, 9), lambda j: 0.5 * g[j] + h[j]) AS h FROM l3), n3 AS (SELECT *, {_normal_sql('h')} AS n FROM r), o AS (SELECT vec_id, z, {_layer_sql('n', 3)}[1] AS logit FROM n3), p AS (SELECT vec_id, z, 1 / (1 + exp(-logit)) AS p FROM o),
        t AS (SELECT vec_id, list_sort(list_transform(z, lambda v, j: {{'a': -round(abs(v), 9), 'j': j - 1}}))[1].j AS strongest, p FROM p)
    SELECT vec_id, round(p, 6) AS probability, p >= 0.55 AS trade, CASE WHEN abs(p - 0.55) > 0.15 THEN 'high' WHEN abs(p - 0.55) > 0.07 THEN 'medium' ELSE 'low' END AS confidence, CAST(strongest AS INT) AS strongest FROM t""",
)
def edge_probability(spark, sf_dir):
    """A residual network over all vectors, standardised by their own means and deviations, and the feature that stands out most."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    x = v.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.stddev_pop(F.col("x").cast("double")).alias("d"))
    own = {r.i: (r.m, r.d) for r in x.collect()}  # one row for each component
    net = N.Network(LAYERS, np.array([own.get(i, (0.0, 1.0))[0] for i in range(SIZES[0])]), np.array([own.get(i, (0.0, 1.0))[1] for i in range(SIZES[0])]))
    got = v.select("vec_id", N.explained(spark, net, F.col("embedding"), F.lit(0.0)).alias("e"))
    return got.select("vec_id", "e.probability", "e.trade", "e.confidence", F.get("e.top", F.lit(0))["feature"].alias("strongest"))

"""Text queries and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import corpus as C
from tidemark.operators.metrics import classification
from tidemark.plans.registry import Registry
from tidemark.sources.tables import table

query = Registry()


def _count(part: str) -> str:
    return f"((length(t) - length(replace(t, '{part}', ''))) / {len(part)})"


MOJIBAKE = " + ".join(["8 * " + _count("�"), "3 * len(regexp_extract_all(t, '[\\x{80}-\\x{9f}]'))", *("2 * " + _count(b) for b in X.BROKEN)])

CATEGORY = "CASE WHEN contains(t, '<think>') THEN 'reasoning' " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(substring(t, 1, 500)), '{p}')" for p in parts) + f" THEN '{name}'" for name, parts in X.CLASS_WORDS
) + " ELSE 'general' END"

WORDS = "CASE WHEN regexp_replace(t, '^\\s+|\\s+$', '', 'g') = '' THEN 0 ELSE len(regexp_split_to_array(regexp_replace(t, '^\\s+|\\s+$', '', 'g'), '\\s+')) END"

QUALITY = f"""
    q0 AS (SELECT id, t, ({MOJIBAKE}) AS broken, regexp_replace(t, '{X.ANY_MARK}', ' ', 'g') AS c FROM q),
    q1 AS (SELECT *, list_transform(regexp_extract_all(c, '[A-Za-z0-9]+'), lambda w: lower(w)) AS w,
               list_filter(list_transform(regexp_split_to_array(c, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS l,
               length(c) - length(regexp_replace(regexp_replace(c, '[ \\n\\t]', '', 'g'), '[\\p{{Cc}}\\p{{Cf}}\\p{{Co}}\\p{{Zl}}\\p{{Zp}}\\p{{Zs}}]', '', 'g')) - len(regexp_extract_all(c, '[ \\n\\t]')) AS hidden,
               length(regexp_replace(c, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) AS letters FROM q0),
    q2 AS (SELECT *, coalesce(list_max(map_values(list_histogram(w))), 0) AS top, len(list_distinct(w)) AS different, coalesce(list_max(map_values(list_histogram(l))), 0) AS line_top FROM q1),
    q3 AS (SELECT *, [
        CASE WHEN (greatest(length(c), 1) - hidden) / greatest(length(c), 1) < 0.80 THEN 'low_printable' END,
        CASE WHEN letters / greatest(length(c), 1) < 0.12 THEN 'low_alphanumeric_density' END,
        CASE WHEN len(w) >= 40 AND top / len(w) >= 0.5 THEN 'high_word_repetition' END,
        CASE WHEN len(w) >= 40 AND different / len(w) < 0.06 THEN 'low_lexical_diversity' END,
        CASE WHEN len(l) >= 12 AND line_top >= 8 THEN 'repeated_lines' END,
        CASE WHEN len(regexp_extract_all(c, '<[a-zA-Z][^>]*>')) / greatest(len(w), 1) > 0.30 THEN 'mostly_html' END,
        CASE WHEN regexp_matches(lower(c), '(?:^|\\n)\\s*(?:cookie policy|privacy policy|terms of service|all rights reserved)\\b')
              OR regexp_matches(lower(c), '\\b(?:subscribe to our newsletter|accept all cookies|click here to unsubscribe)\\b') THEN 'boilerplate' END] AS f FROM q2),
    q4 AS (SELECT *, list_filter(f, lambda x: x IS NOT NULL) AS faults,
        1.0 - coalesce(CASE WHEN f[1] IS NOT NULL THEN 0.55 END, 0) - coalesce(CASE WHEN f[2] IS NOT NULL THEN 0.55 END, 0) - coalesce(CASE WHEN f[3] IS NOT NULL THEN 0.55 END, 0)
            - coalesce(CASE WHEN f[4] IS NOT NULL THEN 0.45 END, 0) - coalesce(CASE WHEN f[5] IS NOT NULL THEN 0.55 END, 0) - coalesce(CASE WHEN f[6] IS NOT NULL THEN 0.40 END, 0) - coalesce(CASE WHEN f[7] IS NOT NULL THEN 0.35 END, 0) AS raw FROM q3),
    quality AS (SELECT id, t,
        CASE WHEN length(t) < 25 THEN 'too_short' WHEN length(t) > 100000 THEN 'too_long' WHEN contains(t, '�') THEN 'unicode_replacement_character' WHEN broken >= 4 THEN 'residual_mojibake'
             ELSE array_to_string(faults, ',') END AS reasons,
        CASE WHEN length(t) < 25 OR length(t) > 100000 OR contains(t, '�') OR broken >= 4 THEN 0.0 ELSE greatest(0.0, CAST(raw AS DOUBLE)) END AS score,
        NOT (length(t) < 25 OR length(t) > 100000 OR contains(t, '�') OR broken >= 4) AND raw >= 0.55 AS accepted FROM q4)"""
# the tables hold no reserved marks, so the SQL has no rule for their balance; tests/test_text.py has


def _docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(
    "corpus_index",
    f"""WITH q AS (SELECT doc_id AS id, coalesce(text, '') AS t FROM documents), {QUALITY},
    r AS (SELECT {CATEGORY} AS category, accepted, {WORDS} AS n, row_number() OVER (PARTITION BY t ORDER BY id) > 1 AS duplicate FROM quality)
    SELECT category, count(*) AS docs, count_if(duplicate) AS duplicates, count_if(accepted AND NOT duplicate) AS accepted,
           CAST(coalesce(sum(n) FILTER (WHERE accepted AND NOT duplicate), 0) AS BIGINT) AS tokens FROM r GROUP BY category""",
)
def corpus_index(spark, sf_dir):
    return C.corpus_statistics(_docs(spark, sf_dir))


def _quality_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    rows = df.select(key, X.quality(F.col(text)).alias("q"))
    return rows.select(key, F.col("q.accepted").alias("accepted"), F.col("q.score").alias("score"), F.array_join("q.reasons", ",").alias("reasons"))


@query("doc_quality", f"WITH q AS (SELECT doc_id AS id, coalesce(text, '') AS t FROM documents), {QUALITY} SELECT id AS doc_id, accepted, round(score, 6) AS score, reasons FROM quality")
def doc_quality(spark, sf_dir):
    return _quality_rows(_docs(spark, sf_dir), "doc_id", "text")


@query("page_quality", f"WITH q AS (SELECT page_id AS id, coalesce(html, '') AS t FROM pages), {QUALITY} SELECT id AS page_id, accepted, round(score, 6) AS score, reasons FROM quality")
def page_quality(spark, sf_dir):
    return _quality_rows(table(spark, sf_dir, "pages"), "page_id", "html")


@query(
    "quality_gate",
    f"""WITH q AS (SELECT doc_id AS id, coalesce(text, '') AS t FROM documents), {QUALITY}
    SELECT source, count(*) AS docs, count_if(accepted) AS accepted, round(count_if(accepted) / count(*), 6) AS pass_rate FROM quality JOIN documents ON doc_id = id GROUP BY source""",
)
def quality_gate(spark, sf_dir):
    """How many documents of each source pass, and their share."""
    rows = _docs(spark, sf_dir).select("source", X.quality(F.col("text"))["accepted"].alias("ok"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.count_if("ok").alias("accepted"), F.avg(F.col("ok").cast("double")).alias("pass_rate"))


@query("doc_mojibake", f"SELECT doc_id, CAST({MOJIBAKE} AS BIGINT) AS score FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def doc_mojibake(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.mojibake_score(F.coalesce("text", F.lit(""))).cast("long").alias("score"))


@query("doc_repair")
def doc_repair(spark, sf_dir):
    """Documents after repair: a round through byte encodings, which SQL lacks."""
    return _docs(spark, sf_dir).select("doc_id", X.digest(X.repaired(F.coalesce("text", F.lit("")))).alias("sha"))


@query("doc_classify", f"SELECT doc_id, {CATEGORY} AS category FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def doc_classify(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.category(F.coalesce("text", F.lit(""))).alias("category"))


@query("doc_hash", "SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents")
def doc_hash(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.digest(F.col("text")).alias("sha"))


@query("doc_exact_dedup", "SELECT min(doc_id) AS doc_id, sha256(coalesce(text, '')) AS sha FROM documents GROUP BY 2")
def doc_exact_dedup(spark, sf_dir):
    return C.first_texts(_docs(spark, sf_dir))


@query(
    "dedup_rate",
    "SELECT count(*) AS docs, count(*) - count(DISTINCT text) AS removed, round((count(*) - count(DISTINCT text)) / count(*), 6) AS rate FROM documents",
)
def dedup_rate(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    sizes = docs.groupBy(X.digest(F.col("text")).alias("sha")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.sum("n").alias("docs"), F.sum(F.col("n") - 1).alias("removed")).withColumn("rate", F.col("removed") / F.col("docs"))


@query(
    "doc_hash_sample",
    "SELECT doc_id, round(('0x' || substring(sha256(text), 1, 8))::UBIGINT / 4294967295.0, 6) AS share FROM documents WHERE ('0x' || substring(sha256(text), 1, 8))::UBIGINT / 4294967295.0 < 0.25",
)
def doc_hash_sample(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.hash_share(F.col("text")).alias("share")).where("share < 0.25")


FAMILY = "regexp_replace(regexp_replace(lower(substring(regexp_replace(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '^\\s+|\\s+$', '', 'g'), 1, 512)), '\\s+', ' ', 'g'), '[\\s.,;:!?]+$', '')"


@query("doc_prompt_family", f"SELECT doc_id, sha256({FAMILY}) AS family FROM (SELECT doc_id, text AS t FROM documents)")
def doc_prompt_family(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2(X.prompt_family(F.col("text")), 256).alias("family"))


@query(
    "holdout_anti",
    f"""WITH d AS (SELECT doc_id, sha256(t) AS sha, sha256({FAMILY}) AS family FROM (SELECT doc_id, text AS t FROM documents)),
        b AS (SELECT sha256(t) AS mark FROM (SELECT text AS t FROM benchmark) UNION SELECT sha256({FAMILY}) FROM (SELECT text AS t FROM benchmark))
    SELECT doc_id FROM d WHERE sha NOT IN (SELECT mark FROM b) AND family NOT IN (SELECT mark FROM b)""",
)
def holdout_anti(spark, sf_dir):
    return C.held_out(_docs(spark, sf_dir), table(spark, sf_dir, "benchmark")).select("doc_id")


@query(
    "family_overlap",
    f"""WITH f AS (SELECT source, sha256({FAMILY}) AS family FROM (SELECT source, text AS t FROM documents))
    SELECT count(*) AS shared FROM (SELECT family FROM f WHERE source IN ('src0', 'src1') INTERSECT SELECT family FROM f WHERE source NOT IN ('src0', 'src1'))""",
)
def family_overlap(spark, sf_dir):
    """How many prompt families stand on both sides of a cut by source: the check for leakage."""
    rows = _docs(spark, sf_dir).select("source", F.sha2(X.prompt_family(F.col("text")), 256).alias("family"))
    first = F.col("source").isin("src0", "src1")
    return rows.where(first).select("family").intersect(rows.where(~first).select("family")).agg(F.count(F.lit(1)).alias("shared"))


@query("family_split")
def family_split(spark, sf_dir):
    """A split by whole prompt families; its hash order is Spark's own."""
    return C.family_split(_docs(spark, sf_dir))


@query(
    "doc_continuation",
    """WITH w AS (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+') AS w FROM documents)
    SELECT doc_id, sha256('<bos>' || chr(10) || '<user>' || chr(10) || 'Continue this passage naturally:' || chr(10) || array_to_string(w[1:32], ' ') || chr(10) || '</user>' || chr(10) || '<assistant>' || chr(10)
        || array_to_string(w[33:80], ' ') || chr(10) || '</assistant>' || chr(10) || '<eos>') AS sha FROM w WHERE len(w) >= 44""",
)
def doc_continuation(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", X.continuation(F.col("text")).alias("t")).where("t IS NOT NULL")
    return rows.select("doc_id", F.sha2("t", 256).alias("sha"))


@query("doc_near_dedup")
def doc_near_dedup(spark, sf_dir):
    """A greedy pass in doc_id order over SimHash bands: held against a loop in the tests."""
    return C.near_first(_docs(spark, sf_dir))


@query(
    "label_metrics",
    f"""WITH q AS (SELECT doc_id AS id, text AS t FROM documents), {QUALITY}, r AS (SELECT lang, CAST(accepted AS INT) AS p, quality.accepted, l.quality AS y FROM quality JOIN documents d ON d.doc_id = id JOIN labels l ON l.doc_id = id)
    SELECT lang, count_if(p = 1 AND y = 1) AS tp, count_if(p = 1 AND y <> 1) AS fp, count_if(p = 0 AND y <> 1) AS tn, count_if(p = 0 AND y = 1) AS fn,
        round(count_if((p = 1) = (y = 1)) / count(*), 6) AS accuracy, round(CASE WHEN sum(p) > 0 THEN count_if(p = 1 AND y = 1) / sum(p) ELSE 0.0 END, 6) AS precision,
        round(CASE WHEN count_if(y = 1) > 0 THEN count_if(p = 1 AND y = 1) / count_if(y = 1) ELSE 0.0 END, 6) AS recall, round(sum(p) / count(*), 6) AS allowed_rate FROM r GROUP BY lang""",
)
def label_metrics(spark, sf_dir):
    """The quality rules against the labels, by language."""
    docs = _docs(spark, sf_dir).select("doc_id", "lang", X.quality(F.col("text"))["accepted"].cast("int").alias("predicted"))
    return classification(docs.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id"), "lang")


@query(
    "conv_serialize",
    """WITH m AS (SELECT conv_id, turn, lower(trim(role)) AS r, regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '^\\s+|\\s+$', '', 'g'),
            '(?i)^(?:\\s*(?:Human|User|Assistant|AI|System)\\s*:\\s*)+', '') AS b FROM conversations),
        p AS (SELECT conv_id, turn, CASE WHEN b = '' THEN NULL WHEN r IN ('human', 'user') THEN '<user>' || chr(10) || b || chr(10) || '</user>'
            WHEN r IN ('assistant', 'ai', 'gpt', 'model') THEN '<assistant>' || chr(10) || b || chr(10) || '</assistant>' WHEN r = 'system' THEN '<evidence>' || chr(10) || b || chr(10) || '</evidence>' WHEN r = 'document' THEN b END AS x FROM m)
    SELECT conv_id, count(*) AS n_turns, sha256(coalesce('<bos>' || chr(10) || string_agg(x, chr(10) ORDER BY turn) || chr(10) || '<eos>', '')) AS sha FROM p GROUP BY conv_id""",
)
def conv_serialize(spark, sf_dir):
    found = C.conversation_texts(table(spark, sf_dir, "conversations"))
    return found.select("conv_id", "n_turns", F.sha2("text", 256).alias("sha"))


@query(
    "conv_dedup_turns",
    """WITH r AS (SELECT *, lag(role) OVER w = role AND lag(text) OVER w = text AS same FROM conversations WHERE trim(text) <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn, role, sha256(text) AS sha FROM r WHERE NOT coalesce(same, false)""",
)
def conv_dedup_turns(spark, sf_dir):
    return C.without_repeats(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", F.sha2("text", 256).alias("sha"))


@query(
    "role_counts",
    "SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, round(avg(length(text)), 6) AS mean_length FROM conversations GROUP BY role",
)
def role_counts(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    return t.groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.count_distinct("conv_id").alias("conversations"), F.avg(F.length("text")).alias("mean_length"))


@query(
    "paragraphs",
    "SELECT doc_id, count(*) AS n, CAST(sum(length(p)) AS BIGINT) AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p FROM documents) WHERE length(p) > 30 GROUP BY doc_id",
)
def paragraphs(spark, sf_dir):
    """Lines of more than 30 characters of each document."""
    parts = _docs(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("p")).where(F.length("p") > 30)
    return parts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("p")).alias("chars"))


@query(
    "source_audit",
    """SELECT source, count(*) AS scanned, count_if(length(text) > 25) AS usable, count_if(length(text) <= 25) AS short, round(avg(length(text)), 6) AS mean_length, CAST(min(length(text)) AS BIGINT) AS min_length,
        CAST(max(length(text)) AS BIGINT) AS max_length FROM documents GROUP BY source""",
)
def source_audit(spark, sf_dir):
    n = F.length("text")
    return _docs(spark, sf_dir).groupBy("source").agg(
        F.count(F.lit(1)).alias("scanned"), F.count_if(n > 25).alias("usable"), F.count_if(n <= 25).alias("short"),
        F.avg(n).alias("mean_length"), F.min(n).cast("long").alias("min_length"), F.max(n).cast("long").alias("max_length"),
    )


@query(
    "source_mix",
    f"""WITH s AS (SELECT source, count(*) AS docs, CAST(sum({WORDS}) AS BIGINT) AS tokens FROM (SELECT source, text AS t FROM documents) GROUP BY source)
    SELECT source, docs, tokens, round(100.0 * tokens / sum(tokens) OVER (), 6) AS percent FROM s""",
)
def source_mix(spark, sf_dir):
    return C.source_mix(_docs(spark, sf_dir))


@query(
    "fair_mix",
    f"""SELECT doc_id, source, round(sum({WORDS}) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) / CASE source WHEN 'src0' THEN 2.0 WHEN 'src1' THEN 0.5 ELSE 1.0 END, 6) AS finish
    FROM (SELECT doc_id, source, text AS t FROM documents)""",
)
def fair_mix(spark, sf_dir):
    return C.fair_order(_docs(spark, sf_dir), {"src0": 2.0, "src1": 0.5})


@query(
    "length_histogram",
    f"""WITH c AS (SELECT {WORDS} AS n FROM (SELECT coalesce(text, '') AS t FROM documents)), b AS (SELECT min(n) AS a, greatest(1, CAST(ceil((max(n) - min(n)) / 20) AS BIGINT)) AS w FROM c),
        k AS (SELECT CAST(least(floor((n - a) / w), 19) AS INT) AS bin, a, w FROM c, b)
    SELECT bin, CAST(a + bin * w AS BIGINT) AS low, CAST(a + (bin + 1) * w AS BIGINT) AS high, count(*) AS docs FROM k GROUP BY ALL""",
)
def length_histogram(spark, sf_dir):
    return C.length_histogram(_docs(spark, sf_dir))


@query(
    "content_windows",
    f"""WITH n AS (SELECT doc_id, {WORDS} AS n FROM (SELECT doc_id, text AS t FROM documents)),
        k AS (SELECT doc_id, n, unnest(range(0, greatest(0, CAST(ceil((n - 129) / 128) AS BIGINT)) + 1)) AS k FROM n WHERE n >= 2)
    SELECT doc_id, CAST(k AS INT) AS window, CAST(k * 128 AS INT) AS start, CAST(least(129, n - k * 128) AS INT) AS n FROM k""",
)
def content_windows(spark, sf_dir):
    return C.content_windows(_docs(spark, sf_dir))


@query("curriculum")
def curriculum(spark, sf_dir):
    """Reasoning documents and a hash-ordered replay of others; the order is Spark's own hash."""
    return C.curriculum(_docs(spark, sf_dir))


@query(
    "registry_join",
    """WITH s AS (SELECT source, 'hf/' || source AS path FROM (SELECT DISTINCT source FROM documents)), d AS (SELECT source, lang, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ALL)
    SELECT path, lang, docs, chars FROM d JOIN s USING (source)""",
)
def registry_join(spark, sf_dir):
    """Datasets (a language of a source) with the path of their source."""
    docs = _docs(spark, sf_dir)
    sources = docs.select("source").distinct().withColumn("path", F.concat(F.lit("hf/"), "source"))
    sets = docs.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"))
    return sets.join(sources, "source").select("path", "lang", "docs", "chars")


@query("row_allow_list", "SELECT doc_id, lang, source FROM documents WHERE trim(lang) IN ('de', 'fr') AND trim(source) IN ('src1', 'src2', 'src3')")
def row_allow_list(spark, sf_dir):
    from tidemark.sources.files import allowed

    return allowed(_docs(spark, sf_dir), {"lang": {"de", "fr"}, "source": {"src1", "src2", "src3"}}).select("doc_id", "lang", "source")


@query(
    "latest_per_key",
    "SELECT user_id, event_id, event_type, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
)
def latest_per_key(spark, sf_dir):
    """Upsert: the odd events over the even ones, the newest of each user stays."""
    e = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    newest = C.upserted(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", "at")
    return newest.select("user_id", "event_id", "event_type", "value")


_STALE_SUMS = ", ".join(f"sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)) AS s{i}" for i in range(8))


@query(
    "stale_hashes",
    f"""WITH t AS (SELECT source, n_chars, sha256(doc_id || ':' || sha256(text)) AS h FROM documents),
        a AS (SELECT source, count(h) AS n, {_STALE_SUMS} FROM t GROUP BY source),
        b AS (SELECT source, count(h) AS n, {_STALE_SUMS} FROM t WHERE n_chars < 20000 GROUP BY source)
    SELECT a.source, (CASE WHEN a.n > 0 THEN a END) IS DISTINCT FROM (CASE WHEN b.n > 0 THEN b END) AS stale FROM a LEFT JOIN b USING (source)""",
)
def stale_hashes(spark, sf_dir):
    return _stale(_docs(spark, sf_dir))


@query("stale_hashes_all")
def stale_hashes_all(spark, sf_dir):
    """stale_hashes under its former name."""
    return stale_hashes(spark, sf_dir)


def _stale(docs: DataFrame) -> DataFrame:
    """Sources whose recorded digest differs from the present one, or is missing.

    A digest is the number of texts and eight sums over 32 bits each of the hashes of (doc_id, text's hash),
    which partial aggregates work out however many rows a source has. It is no guard against forged texts.
    """
    both = F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.sha2("text", 256)), 256)
    sums = [F.sum(F.conv(F.substring("both", 8 * i + 1, 8), 16, 10).cast("long")).alias(f"s{i}") for i in range(8)]

    def mark(docs: DataFrame, name: str) -> DataFrame:
        digest = F.when(F.count("both") > 0, F.struct(F.count("both").alias("n"), *sums))
        return docs.withColumn("both", both).groupBy("source").agg(digest.alias(name))

    marks = mark(docs, "now").join(mark(docs.where("n_chars < 20000"), "then"), "source", "left")
    return marks.select("source", (~F.col("now").eqNullSafe(F.col("then"))).alias("stale"))

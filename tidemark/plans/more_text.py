"""More text queries: chat payloads, benchmark coverage, category budgets, language shares, label joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.plans.registry import Registry
from tidemark.plans.text import CATEGORY, WORDS
from tidemark.sources.tables import table

query = Registry()


@query(
    "conversation_shape",
    """WITH t AS (SELECT conv_id, role, turn, length(text) AS n, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role AS same FROM conversations)
    SELECT conv_id, count(*) AS turns, count_if(role = 'user') AS user_turns, count_if(role = 'assistant') AS assistant_turns, count_if(same) AS repeats,
        CAST(sum(n) AS BIGINT) AS chars, first(role ORDER BY turn) AS first_role, last(role ORDER BY turn) AS last_role FROM t GROUP BY conv_id""",
)
def conversation_shape(spark, sf_dir):
    """Turns by role, roles that repeat, length, and who begins and ends."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf_dir, "conversations").withColumn("same", F.lag("role").over(by) == F.col("role"))
    return t.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"), F.count_if(F.col("role") == "assistant").alias("assistant_turns"),
        F.count_if("same").alias("repeats"), F.sum(F.length("text")).alias("chars"), F.min_by("role", "turn").alias("first_role"), F.max_by("role", "turn").alias("last_role"),
    )


@query(
    "trailing_user_turns",
    """SELECT conv_id, turn, role FROM conversations c WHERE NOT (role = 'user' AND turn = (SELECT max(turn) FROM conversations d WHERE d.conv_id = c.conv_id))""",
)
def trailing_user_turns(spark, sf_dir):
    """Turns without a last one by the user, which has no answer."""
    t = table(spark, sf_dir, "conversations")
    last = F.max("turn").over(Window.partitionBy("conv_id"))
    return t.withColumn("last", last).where(~((F.col("role") == "user") & (F.col("turn") == F.col("last")))).select("conv_id", "turn", "role")


@query(
    "category_budget",
    f"""WITH c AS (SELECT {CATEGORY} AS category, {WORDS} AS n FROM (SELECT coalesce(text, '') AS t FROM documents)), s AS (SELECT category, CAST(sum(n) AS BIGINT) AS tokens, count(*) AS docs FROM c GROUP BY category)
    SELECT category, docs, tokens, round(100.0 * tokens / sum(tokens) OVER (), 6) AS percent, CAST(greatest(0, 1000000 - tokens) AS BIGINT) AS missing FROM s""",
)
def category_budget(spark, sf_dir):
    """Tokens of each category, their share, and what a budget of a million still lacks."""
    docs = table(spark, sf_dir, "documents").select(X.category(F.coalesce("text", F.lit(""))).alias("category"), X.blank_words(F.col("text")).alias("n"))
    s = docs.groupBy("category").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").cast("long").alias("tokens"))
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(1)))
    return s.select("category", "docs", "tokens", (100.0 * F.col("tokens") / whole).alias("percent"), F.greatest(F.lit(0), 1_000_000 - F.col("tokens")).cast("long").alias("missing"))


@query(
    "html_tags",
    "SELECT page_id, len(regexp_extract_all(html, '<[a-zA-Z][^>]*>')) AS tags, CAST(length(html) AS BIGINT) AS chars, CAST(length(regexp_replace(html, '<[^>]*>', '', 'g')) AS BIGINT) AS text_chars FROM pages",
)
def html_tags(spark, sf_dir):
    """Opening tags of each page, its length, and its length without tags."""
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_count(html, F.lit("<[a-zA-Z][^>]*>")).cast("long").alias("tags"), F.length(html).cast("long").alias("chars"), F.length(F.regexp_replace(html, "<[^>]*>", "")).cast("long").alias("text_chars"))


@query(
    "page_hosts",
    "SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, count(*) AS pages, count(DISTINCT sha256(html)) AS different FROM pages GROUP BY 1",
)
def page_hosts(spark, sf_dir):
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    return table(spark, sf_dir, "pages").groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("pages"), F.count_distinct(F.sha2("html", 256)).alias("different"))


@query(
    "label_coverage",
    """SELECT source, count(*) AS docs, count(l.doc_id) AS labelled, count_if(l.quality = 1) AS good, count_if(l.toxic = 1) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source""",
)
def label_coverage(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    both = docs.select("doc_id", "source").join(labels.withColumn("has", F.lit(1)), "doc_id", "left")
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.count("has").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"))


@query(
    "digit_density",
    """SELECT doc_id, round(length(regexp_replace(text, '[^0-9]+', '', 'g')) / greatest(length(text), 1), 6) AS digits, round(len(regexp_extract_all(text, '[.!?]+')) / greatest(length(text), 1) * 1000, 6) AS sentences,
        round(len(regexp_extract_all(text, 'https?://|www[.]')) / greatest(length(text), 1) * 1000, 6) AS links FROM documents""",
)
def digit_density(spark, sf_dir):
    """Digits a character, and sentence ends and links a thousand characters."""
    t, n = F.col("text"), F.greatest(F.length("text"), F.lit(1))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.length(F.regexp_replace(t, "[^0-9]+", "")) / n).alias("digits"),
        (F.regexp_count(t, F.lit("[.!?]+")) / n * 1000).alias("sentences"),
        (F.regexp_count(t, F.lit("https?://|www[.]")) / n * 1000).alias("links"),
    )


@query(
    "embedding_norms",
    "SELECT label, count(*) AS n, round(avg(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)))), 5) AS mean_norm FROM embeddings GROUP BY label",
    5,
)
def embedding_norms(spark, sf_dir):
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg(norm).alias("mean_norm"))

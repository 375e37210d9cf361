"""The registered queries of this package; each is a thin use of one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat, codes, ctw, exact, lines, packing, pieces, pii, quality, runs, simhash, store, toxicity
from tidemark.llm.common import documents, tokenizer_path, written


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir), radius=3, shingle=3, seed=42)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.classes(documents(spark, sf_dir))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classified(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality.judged(documents(spark, sf_dir)).select(*names)


def op5_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.scored(documents(spark, sf_dir))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.found_spans(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    ranks = F.transform(base, lambda s: s["rank"])
    counts = [F.size(F.filter(ranks, F.lit(k).__eq__)).cast("long").alias(f"n_{pii.KINDS[k]}") for k in range(4)]
    listed = F.sha2(pii.span_list(base).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, listed, pii.span_list(F.col("spans")).alias("spans"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), length=4096, end_id=1)


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = store.TokenStore(spark).write(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), end_id=0)
    return made.read_back()


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.line_report(documents(spark, sf_dir), threshold=0.8)
    return found.withColumn("kept_lines", F.array_join(F.transform("kept_lines", lambda x: x.cast("string")), ","))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_report(documents(spark, sf_dir), least=24, power=3, order=runs.repeated_tail)


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one more whose texts hold the template's own control strings."""
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    odd = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(r"\### Assistant: </turn> ok").alias("text"))
    found = chat.read_back(chat.formatted(given.unionByName(odd)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return found.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "first_bad",
    )


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    books = codes.fitted(vectors, parts=4, entries=256, rounds=4, scale=1024)
    found = codes.coded(vectors, books)
    hexed = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c.cast("long")), 2, "0"))), "")
    rows = written(found.select("vec_id", F.when(F.col("code").isNotNull(), hexed).alias("code"), "error", "label"), "codes")
    of_label = rows.groupBy(F.col("label").alias("own")).agg(F.sum("error").alias("label_error"))
    joined = rows.join(of_label, F.col("label").eqNullSafe(F.col("own")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_quality": op4_quality,
    "op5_context_tree": op5_context_tree,
    "op6_pii": op6_pii,
    "op7_pieces": op7_pieces,
    "op8_packing": op8_packing,
    "op9_token_store": op9_token_store,
    "op10_line_dedup": op10_line_dedup,
    "op11_runs": op11_runs,
    "op12_chat": op12_chat,
    "op13_vector_codes": op13_vector_codes,
}

def _codes_sql(rounds: int = 4, entries: int = 256) -> str:
    """Rounds of assignment and mean, each a few named subqueries."""
    parts = [
        """e AS MATERIALIZED (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        """c AS MATERIALIZED (
            SELECT vec_id, i // w AS p, i % w AS j, v[i + 1] AS x
            FROM (SELECT vec_id, v, len(v) // 4 AS w, unnest(range(len(v))) AS i FROM e))""",
        f"b0 AS MATERIALIZED (SELECT p, k, j, x AS y FROM c JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM e QUALIFY k < {entries}) USING (vec_id))",
    ]
    for r in range(rounds + 1):
        parts.append(f"d{r} AS (SELECT vec_id, p, k, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM c JOIN b{r} USING (p, j) GROUP BY ALL)")
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, p, arg_min(k, d * {entries} + k) AS k, min(d) AS d FROM d{r} GROUP BY ALL)")
        if r < rounds:
            parts.append(f"m{r} AS (SELECT p, k, j, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM a{r} JOIN c USING (vec_id, p) GROUP BY ALL)")
            parts.append(f"b{r + 1} AS MATERIALIZED (SELECT p, k, j, coalesce(m, y) AS y FROM b{r} LEFT JOIN m{r} USING (p, k, j))")
    return "WITH " + ",\n        ".join(parts) + f"""
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p, k, j)) FROM b{rounds}) AS codebooks_sha256
        FROM (SELECT vec_id, string_agg(lower(printf('%02x', k)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id) JOIN e USING (vec_id)"""


_PHRASES = "|".join(p.replace("(", "[(]").replace(")", "[)]") for p in quality.BOILERPLATE)

ORACLE = {
    "op2_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, length(coalesce(text, '')) AS n_chars,
                   sha256(regexp_replace(coalesce(text, ''), '[ \t\n\v\f\r]+', '', 'g')) AS text_sha256
            FROM documents),
        k AS (
            SELECT doc_id, text_sha256,
                   first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY text_sha256) AS group_size
            FROM n)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k""",
    "op4_quality": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
        k AS (SELECT doc_id, i, array_to_string(ws[i : i + 7], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
        r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM k) WHERE c > 1),
        c AS (SELECT doc_id, sum(n) AS n_repeat_words FROM (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS n FROM r) GROUP BY doc_id),
        l AS (SELECT doc_id, l, list_filter(regexp_split_to_array(l, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS lw,
                     length(regexp_replace(l, '[^#*$%&|<>{{}}~^=]+', '', 'g')) + len(string_split(l, '!!')) - 1 AS marks,
                     length(regexp_replace(l, '[^|»›•·]+', '', 'g')) AS bars
              FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)),
        f AS (SELECT doc_id, l, coalesce(list_sum(list_transform(lw, lambda x: length(x))), 0) AS chars,
                     (2 * marks >= len(lw) AND marks > 0)
                     OR (len(lw) >= 10 AND (NOT regexp_matches(l, '[.!?…。！？;:]') OR 2 * len(list_filter(range(2, len(lw) + 1), lambda i: lw[i] = lw[i - 1])) >= len(lw)))
                     OR (bars >= 3 AND 5 * bars >= len(lw)) OR (len(lw) <= 25 AND regexp_matches(lower(l), '{_PHRASES}')) AS bad
              FROM l WHERE len(lw) > 0),
        g AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines, coalesce(sum(chars) FILTER (WHERE bad), 0) AS lost FROM f GROUP BY doc_id),
        a AS (SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
                     length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
                     coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost, 0) AS lost
              FROM w LEFT JOIN c USING (doc_id) LEFT JOIN g USING (doc_id)),
        b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM a)
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
               CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
               NOT base_failed AND lost <= 0.5 * word_chars AS kept FROM b""",
    "op10_line_dedup": r"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
        l AS (SELECT doc_id, i, a[i + 1] AS line FROM (SELECT doc_id, a, unnest(range(len(a))) AS i FROM d)),
        w AS (SELECT doc_id, i, line, list_distinct(list_filter(regexp_split_to_array(lower(line), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS ws FROM l),
        k AS (SELECT *, row_number() OVER (ORDER BY doc_id, i) AS k FROM w WHERE len(ws) > 0),
        f AS (SELECT min(k) AS k, arg_min(ws, k) AS ws FROM k GROUP BY line),
        t AS (SELECT k, len(ws) AS n, unnest(ws) AS x FROM f),
        c AS (SELECT x, count(*) AS df FROM t GROUP BY x),
        p AS (SELECT k, n, x, row_number() OVER (PARTITION BY k ORDER BY df, x) AS place FROM t JOIN c USING (x)),
        q AS (SELECT * FROM p WHERE place <= n - ceil(0.8 * n - 1e-9) + 1),
        m AS (SELECT DISTINCT a.k AS a, b.k AS b FROM q a JOIN q b ON a.x = b.x AND a.k < b.k AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) - 1e-9),
        s AS (SELECT b, len(list_intersect(fa.ws, fb.ws)) AS same, len(fa.ws) + len(fb.ws) AS whole FROM m JOIN f fa ON fa.k = a JOIN f fb ON fb.k = b),
        g AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS kept FROM k WHERE k IN (SELECT k FROM f) AND k NOT IN (SELECT b FROM s WHERE same >= 0.8 * (whole - same) - 1e-9) GROUP BY doc_id),
        n AS (SELECT doc_id, count(*) AS n FROM k GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_lines, coalesce(n.n, 0) - coalesce(g.n, 0) AS n_removed, coalesce(g.kept, '') AS kept_lines
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN g USING (doc_id)""",
    "op12_chat": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        t AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i,
                   regexp_replace(text, '(### (System|User|Assistant):|### Other|</turn>)', '\\\1', 'g') AS body
            FROM c),
        p AS (
            SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before,
                   CASE WHEN role IN ('system', 'user', 'assistant') THEN length(role) + 6 ELSE 12 + length(hex(role)) END + length(body) + 9 AS n
            FROM t),
        b AS (
            SELECT *, NOT coalesce(CASE role WHEN 'system' THEN i = 0 WHEN 'user' THEN i = 0 OR before = 'assistant' OR (before = 'system' AND i = 1)
                                             WHEN 'assistant' THEN before = 'user' END, false) AS bad
            FROM p),
        g AS (
            SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS turns,
                   coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '') AS learned,
                   CAST(sum(n) AS BIGINT) AS formatted_chars, arg_max(role, i) AS last, min(i) FILTER (WHERE bad) AS first_bad
            FROM b GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars,
               first_bad IS NULL AND last = 'assistant' AS valid, first_bad
        FROM g""",
    "op13_vector_codes": _codes_sql(),
}

"""Queries over real token ids: round trips, shards, packed examples, supervision of chats; with DuckDB SQL.

SQL has no tokenizer, but ids that went through an operator are decoded again, and then the text must be
there, whole and in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import records as R
from tidemark.functions.tokens import Codec
from tidemark.operators import corpus as C
from tidemark.operators import sequences as S
from tidemark.plans.registry import Registry
from tidemark.sources import shards
from tidemark.sources.scratch import fresh_path, kept
from tidemark.sources.tables import table

query = Registry()


def codec() -> Codec:
    """A public byte-level tokenizer with the marks of the canonical grammar."""
    import public_tokenizers

    return Codec(public_tokenizers.path("byte_bpe_50k.json"))


def _texts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


BODY = "regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '^\\s+|\\s+$', '', 'g')"


@query("token_round_trip", "SELECT doc_id, sha256(coalesce(text, '')) AS sha, true AS some FROM documents WHERE text <> '' UNION ALL SELECT doc_id, sha256(''), false FROM documents WHERE coalesce(text, '') = ''")
def token_round_trip(spark, sf_dir):
    """Every text to ids, a written table, and back."""
    own = codec()
    ids = kept(_texts(spark, sf_dir).select("doc_id", own.encode(F.col("text")).alias("ids")), "ids")
    return ids.select("doc_id", F.sha2(own.decode(F.col("ids")), 256).alias("sha"), (F.size("ids") > 0).alias("some"))


@query("token_shards", "SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS place, sha256(coalesce(text, '')) AS sha FROM documents")
def token_shards(spark, sf_dir):
    """All documents as one stream of ids in overlapping chunks, written to shards, verified, read back, and cut into texts again."""
    own, size, stride, block = codec(), 512, 256, 2000
    path = fresh_path(spark, "shards")
    ids = _texts(spark, sf_dir).select("doc_id", own.encode(F.col("text"), bos=True, eos=True).alias("ids"))
    shards.write_shards(S.stream_chunks(ids, size, stride, own.id("<pad>"), block), path, own, size, stride, per_shard=block, dealt=True)
    bad = shards.verified(spark, path, own, size).where("NOT ok").take(1)
    if bad:
        raise ValueError(f"{bad[0].shard}: {bad[0].reason}")
    return stream_texts(shards.read_shards(spark, path), own, stride).select("place", F.sha2("text", 256).alias("sha"))


def stream_texts(rows: DataFrame, own: Codec, stride: int) -> DataFrame:
    """place, text of the examples of a stream out of its chunks (shard, chunk, x, y).

    What a chunk adds to the one before is cut at the begin marks; the pieces of an example that goes over
    several chunks have its number, which is counted by shard first.
    """
    begin, pad = own.id("<bos>"), own.id("<pad>")
    size = F.size("x")
    whole = F.concat("x", F.slice("y", size, 1))
    first = (F.col("shard") == rows.agg(F.min("shard")).first()[0]) & (F.col("chunk") == 0)
    added = F.when(first, whole).otherwise(F.slice(whole, size + 2 - stride, stride))
    new = rows.select("shard", "chunk", F.filter(added, lambda i: i != pad).alias("ids"))
    marks = F.filter(F.transform("ids", lambda i, k: F.when(i == begin, k)), lambda k: k.isNotNull())
    new = new.withColumn("cuts", marks)
    numbered = S.starts(new.select(F.struct("shard", "chunk").alias("doc_id"), F.size("cuts").cast("long").alias("n"), "ids", "cuts"), by=lambda c: c["shard"])
    edges = F.concat(F.array(F.lit(0)), "cuts", F.array(F.size("ids")))
    pieces = F.transform("cuts", lambda c, k: F.struct((F.col("start") + k).alias("place"), F.slice("ids", c + 1, F.get(edges, k + 2) - c).alias("ids")))
    head = F.struct((F.col("start") - 1).alias("place"), F.slice("ids", 1, F.get(edges, F.lit(1))).alias("ids"))
    parts = numbered.select("doc_id", F.explode(F.concat(F.array(head), pieces)).alias("p")).where(F.size("p.ids") > 0)
    joined = parts.groupBy("p.place").agg(F.flatten(F.sort_array(F.collect_list(F.struct("doc_id", "p.ids")))["ids"]).alias("ids"))
    return joined.select("place", own.decode(F.col("ids"), marks=False).alias("text"))


PACKED = 512


@query("packed_examples", f"SELECT doc_id, sha256(chr(10) || b || chr(10) || '<eos>') AS sha FROM (SELECT doc_id, {BODY} AS b FROM documents) WHERE b <> ''")
def packed_examples(spark, sf_dir):
    """Documents in packed sequences, and each one's text out of what is to be predicted: all but its begin mark, once."""
    own = codec()
    ids = _texts(spark, sf_dir).select("doc_id", own.encode(R.document_text(F.col("text"))).alias("ids"))
    rows = S.example_sequences(ids, own, PACKED)
    got = rows.select("part", "members", own.targets(F.col("ids"), PACKED).alias("t"))
    learned = got.select("part", "members", F.filter("t.y", lambda i: i != own.id("<pad>")).alias("y"))
    before = lambda m, k: F.aggregate(F.slice(m, 1, k), F.lit(0).cast("long"), lambda a, x: a + x["n"] - 1).cast("int")
    own_part = F.transform("members", lambda m, k: F.struct(m["doc_id"].alias("doc_id"), F.slice("y", before(F.col("members"), k) + 1, (m["n"] - 1).cast("int")).alias("ids")))
    parts = learned.select("part", F.explode(F.when(F.size("members") == 1, F.transform("members", lambda m: F.struct(m["doc_id"].alias("doc_id"), F.col("y").alias("ids")))).otherwise(own_part)).alias("p"))
    joined = parts.groupBy("p.doc_id").agg(F.flatten(F.sort_array(F.collect_list(F.struct("part", "p.ids")))["ids"]).alias("ids"))
    return joined.select("doc_id", F.sha2(own.decode(F.col("ids")), 256).alias("sha"))


@query(
    "chat_supervision",
    """WITH m AS (SELECT conv_id, turn, lower(trim(role)) AS r, regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '^\\s+|\\s+$', '', 'g'),
            '(?i)^(?:\\s*(?:Human|User|Assistant|AI|System)\\s*:\\s*)+', '') AS b FROM conversations)
    SELECT conv_id, count(*) AS answers, sha256(string_agg(chr(10) || b || chr(10) || '</assistant>', '' ORDER BY turn)) AS sha FROM m WHERE r IN ('assistant', 'ai', 'gpt', 'model') AND b <> '' GROUP BY conv_id""",
)
def chat_supervision(spark, sf_dir):
    """Conversations in sequences of 129 ids; what is to be predicted of each that has an answer, but for the ends of examples: its answers, each once."""
    own, size = codec(), 128
    texts = C.conversation_texts(table(spark, sf_dir, "conversations")).where("text <> ''")
    ids = texts.select(F.col("conv_id").alias("doc_id"), own.encode(F.col("text")).alias("ids"))
    rows = S.example_sequences(ids, own, size, run=1)  # a run is one conversation, so a sequence has one member
    ends = (own.id("<pad>"), own.id("<eos>"))
    learned = rows.select(F.col("run").alias("conv_id"), "part", F.filter(own.targets(F.col("ids"), size)["y"], lambda i: ~i.isin(*ends)).alias("ids"))
    joined = learned.groupBy("conv_id").agg(F.flatten(F.sort_array(F.collect_list(F.struct("part", "ids")))["ids"]).alias("ids"))
    answers = F.size(F.filter("ids", lambda i: i == own.id("</assistant>"))).cast("long")
    return joined.select("conv_id", answers.alias("answers"), F.sha2(own.decode(F.col("ids")), 256).alias("sha")).where("answers > 0")

"""Token streams cut into sequences: overlapping chunks of one stream, and packing in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.tokens import Codec
from tidemark.sources.scratch import kept


def starts(docs: DataFrame, span: int = 100_000, by: Callable[[Column], Column] | None = None) -> DataFrame:
    """docs (doc_id, n) with start: tokens of all documents of smaller id.

    Sums run inside ranges of `span` ids, or of what `by` gives for an id, in the ids' order; only the
    ranges' totals, one row each, meet in one task.
    """
    rows = docs.withColumn("run", by(F.col("doc_id")) if by else F.floor(F.col("doc_id") / span))
    sooner = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("run").agg(F.sum("n").alias("total")).select("run", F.coalesce(F.sum("total").over(sooner), F.lit(0)).alias("held"))
    inside = Window.partitionBy("run").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("own", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(totals, "run")
    return rows.select(*docs.columns, (F.col("held") + F.col("own")).alias("start"))


def overlapping_chunks(docs: DataFrame, size: int, stride: int) -> DataFrame:
    """chunk, first_doc, last_doc, docs, n: chunks of `size` tokens of the stream of all documents, one each `stride`.

    docs: doc_id, n. The last chunk has what is left; a single token makes none. A document goes to the
    chunks that it overlaps, so no chunk is looked for in a range join.
    """
    placed = starts(docs)
    whole = docs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("whole"))
    last = F.greatest(F.lit(0), F.floor((F.col("whole") - size) / stride) + 1)
    end = F.col("start") + F.col("n")
    rows = placed.where("n > 0").join(F.broadcast(whole), F.lit(True))  # one row
    low = F.greatest(F.lit(0), F.floor((F.col("start") - size) / stride) + 1)
    rows = rows.withColumn("chunk", F.explode(F.sequence(low.cast("long"), F.least(last, F.floor((end - 1) / stride)).cast("long"))))
    at = F.col("chunk") * stride
    part = F.least(end, at + size, F.col("whole")) - F.greatest("start", at)
    rows = rows.where((F.col("whole") - at > 1) & (part > 0)).withColumn("part", part)
    return rows.groupBy("chunk").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count(F.lit(1)).alias("docs"), F.sum("part").alias("n"))


def bins_in_order(docs: DataFrame, size: int, run: int) -> DataFrame:
    """run, bin, doc_id, n: documents in order of id into bins of `size` tokens, a new bin where one does not fit.

    docs: doc_id, n. Runs of `run` ids are packed apart, so the fold over one run has a fixed length. A
    document longer than `size` has a bin of its own.
    """
    listed = F.sort_array(F.collect_list(F.struct("doc_id", "n")))
    rows = docs.groupBy(F.floor(F.col("doc_id") / run).cast("long").alias("run")).agg(listed.alias("d"))
    none = F.array().cast("array<struct<bin:bigint,doc_id:bigint,n:bigint>>")
    begin = F.struct(F.lit(-1).cast("long").alias("bin"), F.lit(0).cast("long").alias("used"), none.alias("out"))

    def step(a, d):
        fits = (a["bin"] >= 0) & (a["used"] + d["n"] <= size) & (d["n"] <= size)
        bin_ = F.when(fits, a["bin"]).otherwise(a["bin"] + 1)
        used = F.when(fits, a["used"] + d["n"]).otherwise(d["n"])
        return F.struct(bin_.alias("bin"), used.alias("used"), F.concat(a["out"], F.array(F.struct(bin_.alias("bin"), d["doc_id"].alias("doc_id"), d["n"].alias("n")))).alias("out"))

    return rows.select("run", F.explode(F.aggregate("d", begin, step, lambda a: a["out"])).alias("x")).select("run", "x.*")


def packed_in_order(docs: DataFrame, size: int, run: int) -> DataFrame:
    """run, bin, docs, n, first_doc: what bins_in_order puts into each bin."""
    placed = bins_in_order(docs, size, run)
    return placed.groupBy("run", "bin").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n"), F.min("doc_id").alias("first_doc"))


def windows(ids: Column, size: int) -> Column:
    """Windows of at most size + 1 ids, each beginning at the last id of the one before, so that none is predicted twice."""
    last = F.greatest(F.lit(0), F.ceil((F.size(ids) - (size + 1)) / size)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda w: F.slice(ids, w * size + 1, size + 1))


def stream_chunks(docs: DataFrame, size: int, stride: int, pad: int, block: int = 20_000) -> DataFrame:
    """chunk, ids: chunks of size + 1 ids of the stream of all documents in order of id, one each `stride`.

    docs: doc_id (once each), ids. The last chunk is filled up with `pad`; a single id that is left makes
    none. Ids are written once, so they are not made again for the sums of their lengths; a document goes
    to the chunks that it overlaps, cut to them, and a chunk is put together from its parts. Parts are dealt
    by blocks of `block` chunks, so the chunks of a block come out in one task and need no second shuffle.
    """
    held = kept(docs.select("doc_id", "ids").where("doc_id IS NOT NULL"), "ids")
    sizes = held.select("doc_id", F.size("ids").cast("long").alias("n"))
    whole = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    last = max(0, (whole - size - 1) // stride + 1)
    rows = starts(sizes.where("n > 0")).join(held, "doc_id").withColumn("end", F.col("start") + F.col("n"))
    low = F.greatest(F.lit(0), F.floor((F.col("start") - size - 1) / stride) + 1).cast("long")
    high = F.least(F.lit(last), F.floor((F.col("end") - 1) / stride)).cast("long")
    parts = rows.where(low <= high).withColumn("chunk", F.explode(F.sequence(low, high)))
    at = F.col("chunk") * stride
    first, stop = F.greatest("start", at), F.least("end", at + size + 1)
    part = F.struct(first.alias("at"), F.slice("ids", (first - F.col("start") + 1).cast("int"), (stop - first).cast("int")).alias("ids"))
    parts = parts.where((F.lit(whole) - at > 1) & (stop > first)).select("chunk", part.alias("p"))
    dealt = parts.withColumn("block", F.floor(F.col("chunk") / block)).repartition("block")
    joined = dealt.groupBy("block", "chunk").agg(F.flatten(F.sort_array(F.collect_list("p"))["ids"]).alias("ids"))
    return joined.select("chunk", F.concat("ids", F.array_repeat(F.lit(pad), size + 1 - F.size("ids"))).alias("ids"))


def example_sequences(docs: DataFrame, codec: Codec, size: int, run: int = 64) -> DataFrame:
    """run, bin, part, ids, members (doc_id, n): sequences of at most size + 1 ids in which something is to be predicted.

    docs: doc_id (once each), ids of a whole example. Short ones are put one after the other, as
    bins_in_order does; of a longer one an answer makes chunks of its own, and other text makes windows.
    Fewer than two ids are left out.
    """
    opens = codec.id("<assistant>")
    answers = F.array_contains("ids", opens)
    # of a chat something is predicted if anything but another such mark follows an opening mark
    followed = F.exists(F.transform("ids", lambda x, i: (x == opens) & (i > 0) & (i + 1 < F.size("ids")) & (F.get("ids", i + 1) != opens)), lambda x: x)
    held = kept(docs.select("doc_id", "ids").where("doc_id IS NOT NULL"), "ids").where("size(ids) >= 2")  # ids are made once
    placed = bins_in_order(held.select("doc_id", F.size("ids").cast("long").alias("n")), size + 1, run).join(held, "doc_id")
    own = F.sort_array(F.collect_list(F.struct("doc_id", "n", "ids")))
    short = placed.where(F.col("n") <= size + 1).withColumn("told", ~answers | followed).groupBy("run", "bin").agg(own.alias("m"), F.bool_or("told").alias("told")).where("told")
    short = short.select("run", "bin", F.lit(0).alias("part"), F.flatten("m.ids").alias("ids"), F.transform("m", lambda m: F.struct(m["doc_id"].alias("doc_id"), m["n"].alias("n"))).alias("members"))
    long = placed.where(F.col("n") > size + 1)
    cut = lambda rows, parts: rows.select("run", "bin", F.array(F.struct("doc_id", "n")).alias("members"), F.posexplode(parts).alias("part", "ids")).select(*short.columns)
    return short.unionByName(cut(long.where(~answers), windows(F.col("ids"), size))).unionByName(cut(long.where(answers), codec.chat_chunks(F.col("ids"), size + 1)))

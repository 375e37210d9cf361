"""Corpus operators: statistics, deduplication, conversations, splits, mixes, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.sources.scratch import kept


def indexed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with sha, duplicate (not the first of its text by doc_id), category, quality, n_tokens.

    Only digests and ids are ordered to find the first of each text; a text of which a third of all rows
    are copies is combined before the shuffle, and the join back can be split.
    """
    rows = docs.select("doc_id", X.digest(F.col("text")).alias("sha"), X.category(F.coalesce("text", F.lit(""))).alias("category"), X.quality(F.col("text")).alias("quality"), X.blank_words(F.col("text")).alias("n_tokens"))
    first = rows.groupBy("sha").agg(F.min("doc_id").alias("first"))
    return rows.join(first, "sha").select("doc_id", "sha", (F.col("doc_id") != F.col("first")).alias("duplicate"), "category", "quality", "n_tokens")


def corpus_statistics(docs: DataFrame) -> DataFrame:
    """category, docs, duplicates, accepted, tokens (of documents that are first of their text and accepted).

    Equal texts are alike in all that is told of them, so they are counted as one group, in each task
    first, and no row is joined back to its text.
    """
    rows = docs.select(X.digest(F.col("text")).alias("sha"), X.category(F.coalesce("text", F.lit(""))).alias("category"), X.quality(F.col("text"))["accepted"].alias("accepted"), X.blank_words(F.col("text")).alias("n_tokens"))
    texts = rows.groupBy("sha", "category", "accepted", "n_tokens").agg(F.count(F.lit(1)).alias("n"))
    return texts.groupBy("category").agg(
        F.sum("n").alias("docs"),
        F.sum(F.col("n") - 1).alias("duplicates"),
        F.count_if("accepted").alias("accepted"),
        F.coalesce(F.sum(F.when(F.col("accepted"), F.col("n_tokens"))), F.lit(0)).cast("long").alias("tokens"),
    )


def first_texts(docs: DataFrame) -> DataFrame:
    """doc_id, sha of the first document of each text."""
    return docs.groupBy(X.digest(F.col("text")).alias("sha")).agg(F.min("doc_id").alias("doc_id")).select("doc_id", "sha")


def near_first(docs: DataFrame, threshold: float = 0.85) -> DataFrame:
    """doc_id, status (kept, exact, near) of a pass in doc_id order that drops what is near a text kept before.

    Near means a Hamming distance of at most round((1 - threshold) * 64), 16 at most, between SimHashes
    that share one of four bands. A dropped text drops nothing itself. Copies of a fingerprint share
    their first's fate, so pairs are sought between different fingerprints; then rounds settle each
    fingerprint whose earlier neighbours are settled, until none is left.
    """
    radius = max(0, min(16, round((1.0 - threshold) * 64)))
    rows = kept(docs.select("doc_id", X.digest(F.col("text")).alias("sha"), X.simhash64(F.col("text")).alias("fp")), "simhash")
    points = rows.groupBy("fp").agg(F.min("doc_id").alias("id"))
    spread = points.select("id", "fp", F.posexplode(X.bands(F.col("fp"))).alias("band", "value"))
    a, b = spread.alias("a"), spread.alias("b")
    near = (F.col("a.band") == F.col("b.band")) & (F.col("a.value") == F.col("b.value")) & (F.col("a.id") < F.col("b.id")) & (X.distance(F.col("a.fp"), F.col("b.fp")) <= radius)
    edges = kept(a.join(b, near).select(F.col("a.id").alias("before"), F.col("b.id").alias("id")).distinct(), "near-edges")
    open_, dropped = edges, None
    while not open_.isEmpty():
        # a text without an open earlier neighbour is kept; what follows it is dropped, and drops nothing
        settled = open_.select(F.col("before").alias("k")).join(open_.select(F.col("id").alias("k")), "k", "left_anti").distinct()
        gone = kept(open_.join(settled.select(F.col("k").alias("before")), "before", "left_semi").select("id").distinct(), "near-dropped")
        dropped = gone if dropped is None else dropped.unionByName(gone)
        rest = open_.join(gone, "id", "left_anti").join(gone.select(F.col("id").alias("before")), "before", "left_anti")
        open_ = kept(rest, "near-open")
    out = points.select("fp", "id", F.lit(True).alias("stays")) if dropped is None else points.join(dropped.withColumn("stays", F.lit(False)), "id", "left").select("fp", "id", F.coalesce("stays", F.lit(True)).alias("stays"))
    first = rows.groupBy("sha").agg(F.min("doc_id").alias("first"))
    status = (
        F.when(F.col("doc_id") != F.col("first"), "exact").when(F.col("stays") & (F.col("doc_id") == F.col("id")), "kept").otherwise("near")
    )
    return rows.join(out, "fp").join(first, "sha").select("doc_id", status.alias("status"))


def serialized(messages: Column) -> Column:
    """The canonical text of an array of (role, text): marks around each part by its role; "" if none counts."""

    def part(m: Column) -> Column:
        role = F.lower(F.trim(m["role"]))
        helper = role.isin("assistant", "ai", "gpt", "model")
        body = F.when(helper, X.normalized(X.escaped(m["text"], ("<think>", "</think>")), True)).otherwise(X.normalized(X.escaped(m["text"]), True))

        def wrapped(text: Column) -> Column:
            wrap = lambda tag: F.concat(F.lit(f"<{tag}>\n"), text, F.lit(f"\n</{tag}>"))
            return F.when(text == "", None).when(role.isin("human", "user"), wrap("user")).when(helper, wrap("assistant")).when(role == "system", wrap("evidence")).when(role == "document", text)

        return X.let(body, wrapped)

    parts = F.filter(F.transform(messages, part), lambda x: x.isNotNull())
    whole = lambda p: F.when(F.size(p) == 0, "").otherwise(F.concat(F.lit("<bos>\n"), F.array_join(p, "\n"), F.lit("\n<eos>")))
    return X.let(parts, whole)


def conversation_texts(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, text: each conversation's turns in order, as canonical text."""
    listed = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), listed.alias("m")).select("conv_id", "n_turns", serialized(F.col("m")).alias("text"))


def without_repeats(turns: DataFrame) -> DataFrame:
    """turns without those that are blank, or equal in role and text to the one before that is not blank."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    real = turns.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    same = (F.lag("role").over(by) == F.col("role")) & (F.lag("text").over(by) == F.col("text"))
    return real.withColumn("same", F.coalesce(same, F.lit(False))).where("NOT same").drop("same")


def held_out(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that have the digest or the prompt family of a benchmark text."""
    marks = benchmark.select(F.explode(F.array(X.digest(F.col("text")), F.sha2(X.prompt_family(F.col("text")), 256))).alias("mark")).distinct()
    own = docs.withColumns({"sha": X.digest(F.col("text")), "family": F.sha2(X.prompt_family(F.col("text")), 256)})
    left = own.join(marks.withColumnRenamed("mark", "sha"), "sha", "left_anti").join(marks.withColumnRenamed("mark", "family"), "family", "left_anti")
    return left.drop("sha", "family")


def family_split(docs: DataFrame, share: float = 0.1, seed: int = 42) -> DataFrame:
    """doc_id, part (train or validation): whole prompt families, in the order of a seeded hash, fill validation first.

    Families are summed into 4096 ranges of the hash, whose running totals are a fixed small table; only
    the families of the range that crosses the target are ordered one by one.
    """
    family = F.xxhash64(X.prompt_family(F.col("text")), F.lit(seed))
    rows = docs.select("doc_id", family.alias("family"))
    sizes = rows.groupBy("family").agg(F.count(F.lit(1)).alias("n")).withColumn("range", F.shiftrightunsigned("family", 52))
    ranges = sizes.groupBy("range").agg(F.sum("n").alias("total"))
    sofar = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.select("range", F.coalesce(F.sum("total").over(sofar), F.lit(0)).alias("before"), F.sum("total").over(Window.partitionBy(F.lit(1))).alias("whole"))
    inside = Window.partitionBy("range").orderBy("family").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(before, "range")
    target = F.greatest(F.lit(1), F.bround(F.col("whole") * share))
    part = F.when(F.col("before") + F.col("inside") < target, "validation").otherwise("train")
    return rows.join(placed.select("family", part.alias("part")), "family").select("doc_id", "part")


def length_histogram(docs: DataFrame, bins: int = 20) -> DataFrame:
    """bin, low, high, docs: word counts in equal whole-number bins, the last of which is closed."""
    counts = docs.select(X.blank_words(F.col("text")).cast("long").alias("n"))
    bounds = counts.agg(F.min("n").alias("least"), F.max("n").alias("most"))
    width = F.greatest(F.lit(1), F.ceil((F.col("most") - F.col("least")) / bins))
    spread = counts.groupBy("n").agg(F.count(F.lit(1)).alias("docs")).join(F.broadcast(bounds), F.lit(True))
    place = F.least(F.floor((F.col("n") - F.col("least")) / width), F.lit(bins - 1)).cast("int")
    return spread.groupBy(place.alias("bin"), (F.col("least") + place * width).cast("long").alias("low"), (F.col("least") + (place + 1) * width).cast("long").alias("high")).agg(F.sum("docs").alias("docs"))


def source_mix(docs: DataFrame) -> DataFrame:
    """source, docs, tokens, percent of all tokens."""
    sums = docs.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum(X.blank_words(F.col("text"))).cast("long").alias("tokens"))
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(1)))
    return sums.withColumn("percent", 100.0 * F.col("tokens") / whole)


def fair_order(docs: DataFrame, weights: dict[str, float], span: int = 100_000) -> DataFrame:
    """doc_id, source, finish: the place of each document in a mix whose sources advance by tokens over weight.

    A document's finish is its source's running tokens over the weight; sorted by it, sources take turns
    in proportion. Sources not named weigh one. Running sums are taken inside runs of `span` ids, and
    only the runs' totals meet, so a source with most of the documents is many tasks.
    """
    weight = F.lit(1.0)
    for name, w in weights.items():
        weight = F.when(F.col("source") == name, w).otherwise(weight)
    rows = docs.select("doc_id", "source", X.blank_words(F.col("text")).alias("n"), F.floor(F.col("doc_id") / span).alias("run"))
    sooner = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("source", "run").agg(F.sum("n").alias("n"))
    totals = totals.select(F.col("source").alias("s"), F.col("run").alias("r"), F.coalesce(F.sum("n").over(sooner), F.lit(0)).alias("held"))
    by = Window.partitionBy("source", "run").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("own", F.sum("n").over(by)).join(totals, F.col("source").eqNullSafe(F.col("s")) & F.col("run").eqNullSafe(F.col("r")))
    return rows.select("doc_id", "source", ((F.col("held") + F.col("own")) / weight).alias("finish"))


def content_windows(docs: DataFrame, size: int = 128) -> DataFrame:
    """doc_id, window, start, n: windows of size + 1 words, each starting at the last word of the one before."""
    words = docs.select("doc_id", X.blank_words(F.col("text")).alias("n")).where("n >= 2")
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - (size + 1)) / size)).cast("int")
    rows = words.withColumn("window", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("window") * size
    return rows.select("doc_id", "window", start.alias("start"), F.least(F.lit(size + 1), F.col("n") - start).alias("n"))


def curriculum(docs: DataFrame, seed: int = 143, least: int = 50) -> DataFrame:
    """doc_id, role: documents of the reasoning stage (primary), and a sample of the others (replay).

    The replay has a quarter of the primary's number, or `least`, taken in the order of a seeded hash. The
    others are counted in 4096 ranges of it first; only those of the range that the number falls into are
    ordered one by one.
    """
    rows = docs.select("doc_id", X.category(F.coalesce("text", F.lit(""))).isin("reasoning", "math").alias("primary"))
    number = rows.agg(F.greatest(F.lit(least), F.floor(F.count_if("primary") / 4)).alias("k")).first()["k"]
    others = rows.where("NOT primary").withColumn("hash", F.xxhash64("doc_id", F.lit(seed))).withColumn("range", F.shiftright("hash", 52))
    last, left = None, int(number)
    for r in others.groupBy("range").count().orderBy("range").collect():  # 4096 at most
        if r["count"] >= left:
            last = r["range"]
            break
        left -= r["count"]
    if last is None:
        replay = others
    else:
        edge = others.where(F.col("range") == last).orderBy("hash", "doc_id").limit(left)
        replay = others.where(F.col("range") < last).unionByName(edge)
    return rows.where("primary").select("doc_id", F.lit("primary").alias("role")).unionByName(replay.select("doc_id", F.lit("replay").alias("role")))


def upserted(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """old with the rows of new: of rows with one key the last by `order` stays, new before old on a tie."""
    whole = lambda df, rank: df.select(F.struct(*[F.col(f"`{c}`") for c in old.columns]).alias("row"), F.lit(rank).alias("new"))
    newest = Window.partitionBy(F.col("row")[key]).orderBy(F.desc(F.col("row")[order]), F.desc("new"))
    return whole(old, 0).unionByName(whole(new, 1)).withColumn("k", F.row_number().over(newest)).where("k = 1").select("row.*")


def inserted(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """old with the rows of new whose key it has not, of several with one key the first by `order`; rows without a key are inserted each."""
    whole = new.select(F.struct(*[F.col(f"`{c}`") for c in old.columns]).alias("row"))
    first = Window.partitionBy(F.col("row")[key]).orderBy(F.col("row")[order])
    fresh = whole.withColumn("k", F.row_number().over(first)).where(F.col("row")[key].isNull() | (F.col("k") == 1))
    known = old.select(F.col(f"`{key}`").alias("known")).distinct()
    return old.unionByName(fresh.join(known, F.col("row")[key] == F.col("known"), "left_anti").select("row.*"))

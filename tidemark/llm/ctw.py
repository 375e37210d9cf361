"""Language-model scores by context-tree weighting over binary-decomposed bytes.

A text is its lower-case words, each ended by a blank, and then the end token, a line feed; line feeds
also stand before its first word. A byte is eight binary decisions; each decision, named by the bits of
the byte so far, has a context tree of its own over the DEPTH bytes before it, across words. Every node
holds a Krichevsky-Trofimov estimator; a node's weighted probability is half its own estimate and half
the product of its children's. A context that training never met adds nothing: its deepest known
ancestor predicts in its place.

What the corpus shows is counted by grams: a byte and its context in one long, the nearest byte of the
context in the lowest place but one. A tree below two bytes of context is built where its grams have
been sent, from the leaves up and then from the root down; of what lies above, 256 x 255 decisions at
most, the driver makes one small table. So the number of grams may be as large as the corpus makes it; a
task holds the grams of some two-byte contexts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc32_mod, released, remove, written

#: Bytes of context.
DEPTH = 5

#: Bytes of context by which grams are dealt to tasks.
TOP = 2
END = b"\n"

#: Slots of the table of common grams that goes to the tasks that read texts: a fixed number.
SLOTS = 1 << 21


def _slices(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` bytes of text each."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
    for i, j in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(i, j - i)


def _tokens(part: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Row of each word, the different words (binary), and the number of each word among them."""
    texts = pc.ascii_lower(pc.fill_null(part.column("text").cast(pa.string()), ""))
    parts = pc.ascii_split_whitespace(texts)
    words = parts.flatten()
    row = np.repeat(np.arange(part.num_rows), np.diff(parts.offsets.to_numpy()))
    real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    found = words.dictionary_encode()
    return row[real], found.dictionary.cast(pa.binary()), found.indices.to_numpy()[real]


def token_counts(docs: DataFrame) -> DataFrame:
    """token, n_all, n: how often each token occurs in docs (text, held), and in those not held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed(tables: list[pa.Table]) -> pa.Table:
            out = pa.concat_tables(tables).combine_chunks().group_by("token").aggregate([("n_all", "sum"), ("n", "sum")])
            return pa.table([out["token"], out["n_all_sum"], out["n_sum"]], names=["token", "n_all", "n"])

        held: list[pa.Table] = []
        for batch in batches:
            for part in _slices(batch):
                row, names, code = _tokens(part)
                taught = ~part.column("held").to_numpy(zero_copy_only=False)
                both = [np.bincount(code, minlength=len(names)), np.bincount(code[taught[row]], minlength=len(names))]
                ends = pa.table([pa.array([END], pa.binary()), [part.num_rows], [int(taught.sum())]], names=["token", "n_all", "n"])
                held += [pa.table([names, *(pa.array(x, pa.int64()) for x in both)], names=["token", "n_all", "n"]), ends]
            if sum(t.num_rows for t in held) > 600_000:
                held = [summed(held)]
                if held[0].num_rows > 400_000:  # the sums go on; Spark adds them up
                    yield from held.pop().to_batches(100_000)
        if held:
            yield from summed(held).to_batches(100_000)

    return docs.select("text", "held").mapInArrow(lambda batches: released(run(batches)), "token binary, n_all long, n long").groupBy("token").agg(F.sum("n_all").alias("n_all"), F.sum("n").alias("n"))


#: A byte as the model sees it: A-Z in lower case, white space as a blank.
_SEEN = np.arange(256, dtype=np.uint8)
_SEEN[65:91] += 32
_SEEN[9:14] = 32


def stream(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts, each after DEPTH line feeds, and where each text's own bytes begin (and the end of all)."""
    texts = pc.fill_null(texts.cast(pa.binary()), b"")
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = _SEEN[np.frombuffer(b"".join(texts.to_pylist()), np.uint8)]
    ends = np.cumsum(size)
    word = raw != 32
    last = word.copy()  # the last byte of a word: what follows is a blank, or nothing
    last[:-1] &= ~word[1:]
    if len(raw):
        closed = ends[size > 0] - 1
        last[closed] = word[closed]
    before = np.concatenate([[0], np.cumsum(word.astype(np.int8) + last, dtype=np.int64)])
    own = before[ends] - before[ends - size] + 1  # with the end token
    begin = np.cumsum(own + DEPTH) - own
    out = np.full(int((own + DEPTH).sum()), 32, np.uint8)
    shift = np.repeat(begin - before[ends - size], size)  # from a byte's place among all to its place in out
    out[(before[:-1] + shift)[word]] = raw[word]
    del shift, before
    for back in range(1, DEPTH + 1):
        out[begin - back] = 10
    out[begin + own - 1] = 10
    return out, np.append(begin, len(out) + DEPTH)


def grams(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context and byte in one int64 of every byte of the texts in a stream, and where each text's begin (and their end)."""
    packed = data.astype(np.int64)
    for back in range(1, DEPTH + 1):
        packed[back:] |= data[:-back].astype(np.int64) << (8 * back)
    own = np.ones(len(data), bool)
    for back in range(1, DEPTH + 1):
        own[begin[:-1] - back] = False
    return packed[own], begin - DEPTH * np.arange(1, len(begin) + 1)


def _added(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of grams as one, each gram once."""
    gram = np.concatenate([p[0] for p in parts])
    order = np.argsort(gram, kind="stable")
    gram = gram[order]
    first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
    return gram[first], *(np.add.reduceat(np.concatenate([p[i] for p in parts])[order], first) if len(gram) else gram for i in (1, 2))


def gram_counts(docs: DataFrame) -> DataFrame:
    """gram, n_all, n: how often each gram occurs in docs (text, held), and in those not held out."""

    def rows(found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        yield from pa.table([pa.array(x) for x in found], names=["gram", "n_all", "n"]).to_batches(100_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            for part in _slices(batch):
                out = part.column("held").to_numpy(zero_copy_only=False)
                for teaches in (True, False):
                    texts = part.column("text").filter(pa.array(out != teaches))
                    if len(texts):
                        gram, n = np.unique(grams(*stream(texts))[0], return_counts=True)
                        held.append((gram, n, n if teaches else np.zeros_like(n)))
            if sum(len(h[0]) for h in held) > 1_000_000:
                held = [_added(held)]
                if len(held[0][0]) > 750_000:  # the sums go on; Spark adds them up
                    yield from rows(held.pop())
        if held:
            yield from rows(_added(held))

    counted = docs.select("text", "held").mapInArrow(lambda batches: released(run(batches)), "gram long, n_all long, n long")
    return counted.groupBy("gram").agg(F.sum("n_all").alias("n_all"), F.sum("n").alias("n"))


def _lgamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma(x) for x > 0: Stirling's series at x + 7, less the logs of the factors between."""
    y = x + 7
    series = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    factors = x.copy()
    for k in range(1, 7):
        factors *= x + k
    return series - np.log(factors)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1.0) - math.log(math.pi)


class _Nodes:
    """The decisions on bit k (0 is the highest) of a byte, one for each context and bits before it.

    keys: contexts and bytes in one number each, sorted; n: how often each occurs.
    """

    def __init__(self, keys: np.ndarray, n: np.ndarray, k: int) -> None:
        name = keys >> (8 - k)
        self.first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        self.of_row = np.repeat(np.arange(len(self.first)), np.diff(np.append(self.first, len(keys))))
        self.ones = np.add.reduceat(n * ((keys >> (7 - k)) & 1), self.first).astype(float)
        self.zeros = np.add.reduceat(n, self.first) - self.ones
        self.seen = self.zeros + self.ones > 0
        self.one = (self.ones + 0.5) / (self.zeros + self.ones + 1)

    def weigh(self, below: np.ndarray | None) -> None:
        """lw: ln of the weighted probability; w: the share of the node's own estimate in it. below: the children's."""
        own = log_kt(self.zeros, self.ones)
        if below is None:
            self.lw, self.w = own, np.ones_like(own)
        else:
            self.lw = np.logaddexp(own, below) - math.log(2)
            self.w = np.exp(own - math.log(2) - self.lw)

    def descend(self, acc: np.ndarray, rem: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What is settled, what is open, and P(1) where nothing deeper is known, from the same of the parents."""
        p = np.where(self.seen, acc + rem * self.one, p)
        return np.where(self.seen, acc + rem * self.w * self.one, acc), np.where(self.seen, rem * (1 - self.w), rem), p


class _Forest:
    """The trees below TOP bytes of context, for sorted grams and their counts."""

    def __init__(self, gram: np.ndarray, n: np.ndarray) -> None:
        self.keys, self.n, self.up = {DEPTH: gram}, {DEPTH: n}, {}
        for depth in range(DEPTH - 1, TOP - 1, -1):
            # a gram's context without the byte farthest back, which is in its highest place
            self.keys[depth], self.up[depth] = np.unique(self.keys[depth + 1] & ((1 << 8 * (depth + 1)) - 1), return_inverse=True)
            self.n[depth] = np.bincount(self.up[depth], weights=self.n[depth + 1], minlength=len(self.keys[depth])).astype(np.int64)

    def nodes(self, k: int) -> dict[int, _Nodes]:
        """The decisions on bit k at each depth, weighed."""
        found = {depth: _Nodes(self.keys[depth], self.n[depth], k) for depth in range(TOP, DEPTH + 1)}
        for depth in range(DEPTH, TOP - 1, -1):
            below = None
            if depth < DEPTH:
                child = found[depth + 1]
                below = np.bincount(self.parents(found, depth + 1), weights=child.lw, minlength=len(found[depth].first))
            found[depth].weigh(below)
        return found

    def parents(self, found: dict[int, _Nodes], depth: int) -> np.ndarray:
        return found[depth - 1].of_row[self.up[depth - 1][found[depth].first]]

    def tops(self) -> pd.DataFrame:
        """c (nearest byte), node, zeros, ones, lw: what each decision at depth TOP adds to depth 1, summed up."""
        out = []
        for k in range(8):
            top = self.nodes(k)[TOP]
            key = self.keys[TOP][top.first]
            node = (1 << k) | ((key & 255) >> (8 - k))
            out.append(pd.DataFrame({"c": (key >> 8) & 255, "node": node, "zeros": top.zeros, "ones": top.ones, "lw": top.lw}))
        return pd.concat(out).groupby(["c", "node"], as_index=False).sum()

    def scores(self, above: np.ndarray) -> np.ndarray:
        """log10 of each gram's probability; above: acc, rem and p at depth 1 by nearest byte and node."""
        gram, total = self.keys[DEPTH], np.zeros(len(self.keys[DEPTH]))
        for k in range(8):
            found = self.nodes(k)
            key = self.keys[TOP][found[TOP].first]
            state = tuple(above[:, (key >> 8) & 255, (1 << k) | ((key & 255) >> (8 - k))])
            for depth in range(TOP, DEPTH + 1):
                if depth > TOP:
                    up = self.parents(found, depth)
                    state = tuple(x[up] for x in state)
                state = found[depth].descend(*state)
            p = state[2][found[DEPTH].of_row]
            total += np.log10(np.where((gram >> (7 - k)) & 1, p, 1 - p))
        return total


def _above(rows: pd.DataFrame) -> np.ndarray:
    """acc, rem and p of the decisions at depth 1, from the sums of what lies below them."""
    zeros, ones, below = np.zeros((3, 256, 256))
    at = rows["c"].to_numpy(), rows["node"].to_numpy()
    zeros[at], ones[at], below[at] = rows["zeros"], rows["ones"], rows["lw"]

    def weighed(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = log_kt(zeros, ones)
        lw = np.logaddexp(own, below) - math.log(2)
        return lw, np.exp(own - math.log(2) - lw)

    lw, w = weighed(zeros, ones, below)
    z, o = zeros.sum(axis=0), ones.sum(axis=0)
    _, root = weighed(z, o, np.where(zeros + ones > 0, lw, 0.0).sum(axis=0))
    one = (o + 0.5) / (z + o + 1)
    seen = zeros + ones > 0
    acc, rem, p = root * one * (z + o > 0), np.where(z + o > 0, 1 - root, 1.0), np.where(z + o > 0, one, 0.5)
    own = (ones + 0.5) / (zeros + ones + 1)
    return np.stack([np.where(seen, acc + rem * w * own, acc), np.where(seen, rem * (1 - w), rem), np.where(seen, acc + rem * own, p)])


def gram_scores(counts: DataFrame, per_task: int = 150_000) -> DataFrame:
    """gram, n_all, logp (base 10): the model's probability of the byte in its context.

    counts: gram (each once), n_all, n - the model learns from n, which is 0 for what training never met. Two
    passes over the grams, dealt by the two nearest bytes of the context: the first sums up what
    lies below depth 1, the second scores.
    """
    spark = counts.sparkSession
    buckets = max(1, -(-counts.count() // per_task))
    near = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * TOP) - 1))
    dealt = counts.withColumn("bucket", F.pmod(F.xxhash64(near), F.lit(buckets)))

    def forest(rows: pd.DataFrame) -> tuple[_Forest, np.ndarray]:
        order = np.argsort(rows["gram"].to_numpy())
        return _Forest(rows["gram"].to_numpy()[order], rows["n"].to_numpy()[order]), order

    tops = dealt.groupBy("bucket").applyInPandas(lambda rows: forest(rows)[0].tops(), "c long, node long, zeros double, ones double, lw double")
    tops = tops.groupBy("c", "node").agg(*[F.sum(x).alias(x) for x in ("zeros", "ones", "lw")])
    above = spark.sparkContext.broadcast(_above(tops.toPandas()))  # 256 x 255 rows at most

    def score(rows: pd.DataFrame) -> pd.DataFrame:
        trees, order = forest(rows)
        return pd.DataFrame({"gram": trees.keys[DEPTH], "n_all": rows["n_all"].to_numpy()[order], "logp": trees.scores(above.value)})

    return written(dealt.groupBy("bucket").applyInPandas(score, "gram long, n_all long, logp double"), "gram-scores", "zstd")


def _slot(gram: np.ndarray) -> np.ndarray:
    """A slot by the highest bits of a product, on which all bytes of a gram bear."""
    return (gram * np.int64(-7046029254386353131) >> np.int64(64 - SLOTS.bit_length() + 1)) & (SLOTS - 1)


def _common(known: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A table of the commonest grams, and their scores: at most one to each of SLOTS slots, and about `most` in all."""
    size = F.floor(4 * F.log2("n_all"))
    sizes = {r["size"]: r["count"] for r in known.groupBy(size.alias("size")).count().collect()}
    least, room = None, most
    for name in sorted(sizes, reverse=True):
        if sizes[name] > room:
            break
        least, room = name, room - sizes[name]
    keys, values = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS)
    if least is not None:
        top = known.where(size >= least).toArrow()
        order = np.argsort(-top["n_all"].to_numpy(), kind="stable")
        gram, logp = top["gram"].to_numpy()[order], top["logp"].to_numpy()[order]
        slots, first = np.unique(_slot(gram), return_index=True)
        keys[slots], values[slots] = gram[first], logp[first]
    return keys, values


def scored(docs: DataFrame, folds: int = 7, held: int = 2, most_common: int = 100_000, most_grams: int = 1_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, code_length of every document.

    docs: doc_id (long, unique), text; a null text counts as empty, and is the end token alone. Documents
    whose crc32(doc_id) modulo folds is `held` teach nothing. base_score is the unigram model with one
    added to each count, score the context-tree model, both log10; code_length is the latter in bits per
    byte of the words, with an end mark for each word and for the text. An empty table gives no rows; of
    rows without a doc_id one comes out, with their sums.

    Scores of the most_common tokens and of about most_grams grams - fixed numbers - go to the tasks that
    read the texts; what else a document has is joined, so no table that grows with the corpus is sent around.
    """
    spark = docs.sparkSession
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"), (crc32_mod(F.col("doc_id"), folds) == held).alias("held"))
    own = own.withColumn("held", F.coalesce("held", F.lit(False)))
    table = written(token_counts(own), "tokens")
    known = table.where("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("different")).first()
    total, different = known["total"], known["different"]
    base = F.log10((F.col("n") + 1) / (total + different + 1))
    counted = written(gram_counts(own), "grams")
    spelled = gram_scores(counted)
    remove(spark, counted)
    is_end = F.col("token") == F.lit(END)  # every document has it, so it is always at hand
    most = table.where(~is_end).orderBy(F.desc("n_all"), "token").limit(most_common)
    top = most.unionByName(table.where(is_end)).select("token", "n", base.alias("base")).toArrow()
    common = spark.sparkContext.broadcast({bytes(t): i for i, t in enumerate(top["token"].to_pylist())})
    values = spark.sparkContext.broadcast(np.stack([(top["n"].to_numpy() > 0).astype(float), top["base"].to_numpy()]) if len(top) else np.zeros((2, 0)))
    slots = spark.sparkContext.broadcast(_common(spelled, most_grams))
    names = ["doc_id", "token", "gram", "times", "bytes", "known", "base", "logp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sums, (keys, logs) = common.value, values.value, slots.value
        for batch in batches:
            for part in _slices(batch):
                ids, rows = part.column("doc_id"), part.num_rows
                row, words, code = _tokens(part)
                at = np.array([place.get(t, -1) for t in words.to_pylist()], np.int64)
                where = at[code]
                easy = where >= 0
                found = [np.bincount(row[easy], weights=v[where[easy]], minlength=rows).astype(float) for v in sums]
                if END in place:  # it is in every table that is not empty
                    found = [f + v[place[END]] for f, v in zip(found, sums, strict=True)]
                gram, begin = grams(*stream(part.column("text")))
                slot = _slot(gram)
                rare = np.flatnonzero(keys[slot] != gram)
                logp = logs[slot]
                logp[rare] = 0
                found.append(np.add.reduceat(logp, begin[:-1]) if rows else np.zeros(0))
                none, zero = (lambda n, t: pa.nulls(n, t)), (lambda n: pa.array(np.zeros(n)))
                tokens = np.bincount(row, minlength=rows) + 1
                yield pa.RecordBatch.from_arrays([ids, none(rows, pa.binary()), none(rows, pa.int64()), pa.array(tokens, pa.int64()), pa.array(np.diff(begin).astype(float)), *map(pa.array, found)], names=names)
                hard, times = np.unique(row[~easy] * len(words) + code[~easy], return_counts=True)
                whose, which = hard // max(1, len(words)), hard % max(1, len(words))
                n = len(hard)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(whose)), words.take(pa.array(which)), none(n, pa.int64()), pa.array(times.astype(np.int64)), zero(n), zero(n), zero(n), zero(n)], names=names)
                whose = np.searchsorted(begin, rare, side="right") - 1
                n, ones = len(rare), pa.array(np.ones(len(rare), np.int64))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(whose)), none(n, pa.binary()), pa.array(gram[rare]), ones, zero(n), zero(n), zero(n), zero(n)], names=names)

    shape = "doc_id long, token binary, gram long, times long, bytes double, known double, base double, logp double"
    parts = written(own.select("doc_id", "text").mapInArrow(lambda batches: released(run(batches)), shape), "parts", "zstd")
    no, none = F.lit(0.0), F.lit(0).cast("long").alias("times")
    rare = parts.where("token IS NOT NULL").select("doc_id", "token", "times").join(table.select("token", "n", base.alias("base")), "token")
    rare = rare.select("doc_id", none, no.alias("bytes"), (F.col("times") * (F.col("n") > 0).cast("int")).cast("double").alias("known"), (F.col("times") * F.col("base")).alias("base"), no.alias("logp"))
    odd = parts.where("gram IS NOT NULL").groupBy("doc_id", "gram").agg(F.sum("times").alias("times")).join(spelled.select("gram", "logp"), "gram")
    odd = odd.select("doc_id", none, no.alias("bytes"), no.alias("known"), no.alias("base"), (F.col("times") * F.col("logp")).alias("logp"))
    both = parts.where("token IS NULL AND gram IS NULL").drop("token", "gram").unionByName(rare).unionByName(odd)
    sums = both.groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in ("times", "bytes", "known", "base", "logp")])
    return sums.select(
        "doc_id",
        F.coalesce(crc32_mod(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"),
        F.col("times").alias("n_tokens"),
        F.round("known").cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        F.col("logp").alias("score"),
        (-F.col("logp") * math.log2(10) / F.col("bytes")).alias("code_length"),
    )

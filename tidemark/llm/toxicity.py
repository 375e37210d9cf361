"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc32_mod, remove, written

#: Fixed starting lexicon: insults of several languages.
SEED = (
    "idiot idiots stupid moron morons loser losers trash scum clown pathetic worthless disgusting dumb fool imbecile jerk "
    "crap bastard bitch shit fuck fucking asshole retard slut whore "
    "idiota estúpido imbécil basura mierda puta cabrón asqueroso "
    "dummkopf arschloch scheiße scheisse hurensohn abschaum trottel vollidiot "
    "connard salope merde ordure crétin débile minable"
).split()

#: Pattern voters, by name; each looks at the text as it is.
PATTERNS = {
    "shouts": re.compile(r"!!!"),
    "masked": re.compile(r"\b[A-Za-z][*@#]{2,}[A-Za-z]*\b"),
    "capitals": re.compile(r"(?:\b[A-Z]{3,}\b\W+){5}"),
    "stretched": re.compile(r"([A-Za-z])\1{4}"),
    "addressed": re.compile(r"\byou(?:'re| are) (?:a|an|such|so)\b", re.IGNORECASE),
}

#: Prefix lengths that stand beside whole words as lexicon entries: a stem with many endings is one entry.
PREFIXES = (4, 5, 6)

_EDGES = ".,;:!?…\"'()[]{}«»“”‘’|*#$%&<>-_/\\"


def word_features(word: str) -> tuple[str, ...]:
    """Lexicon entries of a lower-case word: the word, and its prefixes with a mark."""
    word = word.strip(_EDGES)
    return (word, *(word[:n] + "~" for n in PREFIXES if len(word) >= n)) if len(word) >= 3 else ()


class _Entries(dict):
    """Word to those of its entries that are in the lexicon; emptied when it is full."""

    def __init__(self, lexicon: set[str] | None) -> None:
        self.lexicon = lexicon

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) > 500_000:
            self.clear()
        found = word_features(word)
        self[word] = found = found if self.lexicon is None else tuple(f for f in found if f in self.lexicon)
        return found


def features(text: str, entries: _Entries) -> set[str]:
    """What a text shows: lexicon entries, and patterns by their name after a colon."""
    found = set().union(*map(entries.__getitem__, set(text.lower().split())))
    found.update(f":{name}" for name, pattern in PATTERNS.items() if pattern.search(text))
    return found


@dataclass
class Model:
    """weights of features (entries of the lexicon and patterns) and bias; rates and weights of the voters, for a look."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -3.0
    voters: dict[str, tuple[float, float]] = field(default_factory=dict)
    names: list[str] = field(default_factory=list)


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def _lexicon(sample: DataFrame, most: int, least_toxic: int, least_gain: float) -> list[tuple[str, int, int]]:
    """Entries that toxic documents show far more often than others, best first: (entry, toxic, clean).

    Documents with an entry are counted by class in each task, then summed; `most` bounds what comes back.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = _Entries(None)
        for batch in batches:
            sums: dict[str, list[int]] = {}
            for text, toxic in zip(_texts(batch), batch.column("toxic").to_pylist(), strict=True):
                for x in set().union(*map(entries.__getitem__, set(text.lower().split()))):
                    sums.setdefault(x, [0, 0])[0 if toxic else 1] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), *(pa.array([v[i] for v in sums.values()], pa.int64()) for i in (0, 1))], names=["entry", "bad", "good"])

    sums = sample.select("text", "toxic").mapInArrow(count, "entry string, bad long, good long").groupBy("entry").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    whole = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad"), F.count(F.lit(1)).alias("n")).first()
    share = (whole["bad"] + 0.5) / (whole["n"] + 1)
    both = F.col("bad") + F.col("good")
    # twice the log-likelihood ratio of the entry's own share of toxic documents against the general one
    gain = 2 * (F.col("bad") * F.log((F.col("bad") / both) / share) + F.when(F.col("good") > 0, F.col("good") * F.log((F.col("good") / both) / (1 - share))).otherwise(0.0))
    good = sums.where((F.col("bad") >= least_toxic) & (F.col("bad") / both > share)).withColumn("gain", gain).where(F.col("gain") >= least_gain)
    return [(r["entry"], r["bad"], r["good"]) for r in good.orderBy(F.desc("gain"), "entry").limit(most).collect()]


@dataclass
class LabelModel:
    """Rates at which each voter votes on toxic and on other documents, its weight, and the share of toxic documents."""

    rates: np.ndarray
    weight: np.ndarray
    prior: float

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(toxic) of rows of votes, 0 or 1; a vote's odds count by its voter's weight, and a voter that is silent says nothing."""
        odds = math.log(self.prior / (1 - self.prior)) + votes @ (self.weight * np.log(self.rates[0] / self.rates[1]))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _bits(mask: np.ndarray, voters: int) -> np.ndarray:
    """Votes of `voters` voters, of which the last speaks where all others are silent."""
    return np.concatenate([mask[:, None] >> np.arange(voters - 1) & 1, mask[:, None] == 0], axis=1).astype(float)


def starting_model(votes: np.ndarray, label: np.ndarray, count: np.ndarray, guess: np.ndarray) -> tuple[LabelModel, np.ndarray]:
    """The model that labelled rows suggest, and how many of each class they are; guess: rates where there are none."""
    n = np.array([count[label == 1].sum(), count[label == 0].sum()])
    shown = np.stack([count[label == side] @ votes[label == side] for side in (1, 0)]) if len(count) else np.zeros_like(guess)
    rates = np.clip((shown + 2 * guess) / (n[:, None] + 2), 1e-5, 1 - 1e-5)
    return LabelModel(rates, np.ones(votes.shape[1]), float(np.clip((n[0] + 1) / (n.sum() + 20), 1e-3, 0.5))), n


def label_model(patterns: DataFrame, start: LabelModel, known: np.ndarray, rounds: int = 8) -> LabelModel:
    """Expectation-maximisation over the vote patterns (mask, count) of all documents.

    Labels are no votes: they only set where the rates start, and count in them like `known` documents of
    each class. Voters are independent given the class, but for a discount that is estimated twice on the
    way: one that goes along with others beyond what the class explains counts for 1 / (1 + the sum of its
    positive correlations within the classes). Each round is an aggregation of at most voters^2 sums.
    """
    voters = len(start.weight)

    def sums(model: LabelModel, pairs: bool) -> np.ndarray:
        """Of each class: documents with each voter's vote (with each pair of votes), and then all documents."""

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, voters * voters + 1 if pairs else voters + 1))
            for batch in batches:
                votes, count = _bits(batch.column("mask").to_numpy(), voters), batch.column("count").to_numpy().astype(float)
                post = model.posterior(votes)
                for side, p in enumerate((post * count, (1 - post) * count)):
                    total[side, :-1] += ((votes * p[:, None]).T @ votes).ravel() if pairs else p @ votes
                    total[side, -1] += p.sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.shape[1])), *map(pa.array, total)], names=["i", "yes", "no"])

        rows = patterns.select("mask", "count").mapInArrow(add, "i long, yes double, no double").groupBy("i").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
        found = rows.toPandas().sort_values("i")[["yes", "no"]].to_numpy().T
        return found if found.size else np.zeros((2, voters * voters + 1 if pairs else voters + 1))

    model = start
    for turn in range(rounds):
        found = sums(model, False)
        n = found[:, -1:] + known[:, None]
        rates = np.clip((found[:, :-1] + known[:, None] * start.rates + 1e-3) / (n + 0.1), 1e-5, 1 - 1e-5)
        prior = float(np.clip((found[0, -1] + 1) / (found[:, -1].sum() + 20), 1e-3, 0.5))
        model = LabelModel(rates, model.weight, prior)
        if turn in (1, 4):
            found = sums(model, True)
            total = np.zeros((voters, voters))
            for side in (0, 1):
                joint = found[side, :-1].reshape(voters, voters) / max(found[side, -1], 1e-9)
                mean = np.diag(joint)
                dev = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
                total += 0.5 * (joint - np.outer(mean, mean)) / np.outer(dev, dev)
            np.fill_diagonal(total, 0)
            model = LabelModel(model.rates, 1 / (1 + np.maximum(total, 0).sum(axis=1)), model.prior)
    return model


def _shown(docs: DataFrame, names: list[str]) -> DataFrame:
    """docs without text, with found: numbers of what each text shows among names (entries and patterns)."""
    number = {x: i for i, x in enumerate(names)}
    held = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Entries(set(names))
        for batch in batches:
            found = [features(t, known) for t in _texts(batch)]
            numbers = pa.array([sorted(number[x] for x in f) for f in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in held), numbers], names=[*held, "found"])

    shape = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in held)
    return written(docs.mapInArrow(run, f"{shape}, found array<int>"), "shown", "zstd")


def _rows_of(found: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of every element of an array of lists."""
    return np.repeat(np.arange(len(found)), pc.list_value_length(found).to_numpy(zero_copy_only=False)), found.flatten().to_numpy()


def _masked(shown: DataFrame, voters: list[int], width: int) -> DataFrame:
    """shown with mask: a bit for each voter among what was found."""
    bit = np.zeros(width, np.int64)
    bit[voters] = 1 << np.arange(len(voters))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, value = _rows_of(batch.column("found"))
            mask = np.zeros(batch.num_rows, np.int64)
            np.add.at(mask, row, bit[value])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mask)], names=[*batch.schema.names, "mask"])

    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in shown.schema)
    return shown.mapInArrow(run, f"{shape}, mask long")


def _covering(names: list[str], sure: set[int], toxic: list[list[int]], most: int, times: int = 2) -> list[int]:
    """Numbers of the entries that vote: those that reach most toxic rows which fewer than `times` voters reach yet.

    sure: entries that may be chosen; none is a prefix of another, so no word votes twice.
    """
    have = np.zeros(len(toxic), int)
    rows: dict[int, list[int]] = {}
    for i, found in enumerate(toxic):
        for x in found:
            if x in sure:
                rows.setdefault(x, []).append(i)
    chosen: list[int] = []
    while len(chosen) < most and rows:
        gain = {x: int((have[r] < times).sum()) for x, r in rows.items()}
        best = max(gain, key=lambda x: (gain[x], -x))
        if gain[best] < 2:
            break
        stem = names[best].rstrip("~")
        chosen.append(best)
        have[rows[best]] += 1
        rows = {x: r for x, r in rows.items() if gain[x] and x != best and not (names[x].startswith(stem) or stem.startswith(names[x].rstrip("~")))}
    return chosen


def _learned(docs: DataFrame, labels: DataFrame, most_labelled: int, most_entries: int, most_voters: int) -> tuple[Model, DataFrame]:
    """The model, and what every document shows. docs: doc_id, text, taught (whether it may teach); labels: of such rows."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors, VectorUDT

    spark = docs.sparkSession
    marks = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    steps, number = 1_000_000, marks.count()
    if number > most_labelled:
        marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(steps)) < steps * most_labelled // number)
    marks = written(marks, "marks")
    sample = written(docs.join(F.broadcast(marks), "doc_id").select("text", "toxic"), "labelled", "zstd")
    ranked = _lexicon(sample, most_entries, 3, 12.0)
    remove(spark, sample)
    seeds = [w for s in SEED for w in word_features(s)[:1]]
    entries = list(dict.fromkeys([e for e, _, _ in ranked] + seeds))
    names = entries + [f":{p}" for p in PATTERNS]
    shown = _shown(docs.join(F.broadcast(marks), "doc_id", "left"), names)
    # of labelled rows, which are bounded: what the toxic ones show decides who votes
    toxic = [r["found"] for r in shown.where("taught AND toxic = 1").select("found").collect()]
    sure = {i for i, (_, bad, good) in enumerate(ranked) if bad >= good}
    chosen = _covering(names, sure, toxic, most_voters)
    chosen += [i for i, x in enumerate(entries) if x in seeds and not any(x.startswith(names[c].rstrip("~")) for c in chosen)][: most_voters - len(chosen)]
    voters = chosen + list(range(len(entries), len(names)))
    taught = _masked(shown.where("taught"), voters, len(names))
    rows = taught.where("toxic IS NOT NULL").groupBy("mask", "toxic").count().collect()  # no more rows than the sample has
    votes = _bits(np.array([r["mask"] for r in rows], np.int64), len(voters) + 1)
    guess = np.repeat([[0.2], [0.002]], len(voters) + 1, axis=1)
    guess[:, -1] = 0.2, 0.95
    start, known = starting_model(votes, np.array([r["toxic"] for r in rows], int), np.array([r["count"] for r in rows], float), guess)
    patterns = written(taught.groupBy("mask").count(), "vote-patterns")
    fitted = label_model(patterns, start, known)
    remove(spark, patterns)
    model = Model(voters={v: (float(fitted.rates[0, i]), float(fitted.weight[i])) for i, v in enumerate(names[x] for x in voters)})

    def soften(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            post = fitted.posterior(_bits(batch.column("mask").to_numpy(), len(voters) + 1))
            yield pa.RecordBatch.from_arrays([batch.column("found"), pa.array(post)], names=["found", "p"])

    # the classifier's rows: the labelled ones, and as many others at most; their labels are the posteriors
    total = taught.where("toxic IS NULL").count()
    others = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(steps)) < steps * min(most_labelled, total) // max(1, total)
    picked = taught.where(F.col("toxic").isNotNull() | others).select("found", "mask")
    soft = picked.mapInArrow(soften, "found array<int>, p double")
    soft = soft.select("found", F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("p").alias("w")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("w")))).alias("x"))
    width = len(names)
    sparse = F.udf(lambda found: Vectors.sparse(width, found, [1.0] * len(found)), VectorUDT())  # of the bounded rows
    soft = written(soft.select(sparse("found").alias("features"), "x.label", "x.w").where("w > 1e-6"), "soft-labels")
    if not soft.isEmpty():
        line = LogisticRegression(weightCol="w", regParam=0.00002, maxIter=100, standardization=False).fit(soft)
        model.weights = {v: float(c) for v, c in zip(names, line.coefficients, strict=True) if abs(c) > 1e-6}
        model.bias = float(line.intercept)
    if not model.weights:
        model.weights = dict.fromkeys(SEED, 3.0)
    model.names = names
    remove(spark, soft, marks)
    return model, shown


def learn(docs: DataFrame, labels: DataFrame, most_labelled: int = 30_000, most_entries: int = 2000, most_voters: int = 56) -> Model:
    """Learns from docs (doc_id, text) and labels (doc_id, toxic 0/1): pass rows that may teach only.

    Labelled rows pick the lexicon and set where the label model starts; all documents vote, and its
    posteriors are the labels on which the linear classifier is trained. At most about most_labelled
    labelled rows are used, chosen by a hash of doc_id, so the table that is joined to the texts is
    bounded, and as many others at most train the classifier. Without labelled rows the seed lexicon
    votes alone.
    """
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.lit(True).alias("taught"))
    model, shown = _learned(own, labels, most_labelled, most_entries, most_voters)
    remove(docs.sparkSession, shown)
    return model


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score: P(toxic) of every whole text; null counts as empty; nothing is shuffled.

    An empty text shows nothing and gets the score of the bias; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights, bias = _Entries(set(model.weights)), model.weights, model.bias
        for batch in batches:
            odds = [bias + sum(weights.get(x, 0.0) for x in sorted(features(t, known))) for t in _texts(batch)]
            score = 1 / (1 + np.exp(-np.clip(np.array(odds, float), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def classified(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 4, held: int = 2, most_labelled: int = 30_000, most_entries: int = 2000, most_voters: int = 56) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; rows of the held-out fold teach nothing, labelled or not.

    Texts are read once for what they show; scores are sums over that. A row without a doc_id teaches nothing.
    """
    out = F.coalesce(crc32_mod(F.col("doc_id"), folds) == held, F.lit(True))
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"), (~out).alias("taught"))
    model, shown = _learned(own, labels.where(crc32_mod(F.col("doc_id"), folds) != held), most_labelled, most_entries, most_voters)
    weights, bias = np.array([model.weights.get(x, 0.0) for x in model.names]), model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, value = _rows_of(batch.column("found"))
            odds = bias + np.bincount(row, weights=weights[value], minlength=batch.num_rows)
            score = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    found = shown.select("doc_id", "found").mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", F.coalesce(crc32_mod(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

"""SimHash near-duplicates: BK-trees over shards of fingerprints, then connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import boxed, remove, unboxed, written
from tidemark.llm.components import connected_components

BITS = 64


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42, block: int = 65_536) -> int:
    """SimHash of a text: bit i is set if it is set in more than half of the shingles' XXH64.

    A-Z are lower-cased, words are runs without ASCII white space, shingles are joined by spaces and
    count as often as they occur. Fewer words than a shingle: the whole sequence is the one shingle.
    No words, or null: zero. Long texts are summed in blocks, so memory stays bounded.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        words = [b" ".join(words)]
        shingle = 1
    total, count = np.zeros(BITS, np.int64), len(words) - shingle + 1
    for at in range(0, count, block):
        some = words[at : at + block + shingle - 1]
        joined = map(b" ".join, zip(*(some[i:] for i in range(shingle)), strict=False)) if shingle > 1 else some
        hashes = np.frombuffer(b"".join([xxhash.xxh64_digest(s, seed) for s in joined]), np.uint8)
        total += np.unpackbits(hashes.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > count).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (long, the 64 bits) of every document; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary() if pa.types.is_large_string(batch.column("text").type) else pa.binary())
            found = pa.array((fingerprint(t.as_py(), shingle, seed) for t in texts), pa.int64(), size=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], names=["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


class BKForest:
    """BK-trees, one for each shard, in flat arrays.

    A child hangs at its integer Hamming distance to the parent, one child for each distance. Trees
    are built a level at a time: of the points that wait below a node at one distance, the first
    becomes the child, and the others go on below it.
    """

    def __init__(self, points: np.ndarray, shard: np.ndarray) -> None:
        """points: uint64, a row of one word or more for each; shard: the number of each point's tree, from 0."""
        self.points, n = points.reshape(len(points), -1), len(points)
        self.bits = BITS * self.points.shape[1]
        first = np.full(int(shard.max()) + 1 if n else 0, n, np.int64)
        np.minimum.at(first, shard, np.arange(n))
        self.root = first[shard] if n else np.zeros(0, np.int64)
        wait = np.flatnonzero(self.root != np.arange(n))
        below, codes, kids = self.root[wait], [], []
        while len(wait):
            code = below * (self.bits + 1) + self.distance(wait, below)
            found, at, back = np.unique(code, return_index=True, return_inverse=True)
            child = wait[at]
            codes.append(found)
            kids.append(child)
            below = child[back]
            wait, below = wait[wait != below], below[wait != below]
        self.codes = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        order = np.argsort(self.codes)
        self.codes, self.kids = self.codes[order], (np.concatenate(kids) if kids else self.codes)[order]

    def distance(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.points[i] ^ self.points[j]).sum(axis=1, dtype=np.int64)

    def links(self, radius: int, block: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i, j), j < i, of points of one tree within the radius, in blocks of queries.

        From a node at distance d only the edges d - radius to d + radius are followed.
        """
        for at in range(0, len(self.points), block):
            query = np.arange(at, min(at + block, len(self.points)))
            node = self.root[query]
            while len(query):
                far = self.distance(query, node)
                near = (far <= radius) & (node < query)
                if near.any():
                    yield query[near], node[near]
                base = node * (self.bits + 1)
                low = np.searchsorted(self.codes, base + np.maximum(far - radius, 0))
                high = np.searchsorted(self.codes, base + np.minimum(far + radius, self.bits), side="right")
                many = high - low
                query = np.repeat(query, many)
                step = np.arange(len(query)) - np.repeat(np.cumsum(many) - many, many)
                node = self.kids[np.repeat(low, many) + step]


def _roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest member of each point's class under the pairs."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            if (a == b).all():
                break
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
    return root


def _spanning(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs, the earliest that do, that join all classes of n points that the pairs join."""
    root, kept = np.arange(n), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            high, at = np.unique(np.maximum(a, b), return_index=True)  # one pair for each class that joins a lower one
            kept.append((i[at], j[at]))
            root[high] = np.minimum(a, b)[at]
            while (root[root] != root).any():
                root = root[root]
    return np.concatenate([k[0] for k in kept]), np.concatenate([k[1] for k in kept])


def _split(mask: int, parts: int) -> list[int]:
    """mask with one more run of its free bits fixed, in each of the given number of ways."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    runs = [free[k * len(free) // parts : (k + 1) * len(free) // parts] for k in range(parts)]
    return [mask | sum(1 << b for b in run) for run in runs if run]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def in_blocks(level: DataFrame, most: int) -> DataFrame:
    """level (fp, mask, value and others) with pair: 0, or a pair of blocks of a shard of more than `most` rows.

    Such a shard is dealt by a hash into blocks of about `most`, and every pair of blocks is a shard of
    its own, so no two of its rows miss each other.
    """
    large = level.groupBy("mask", "value").count().where(F.col("count") > most)
    large = large.select("mask", "value", F.ceil(F.col("count") / most).alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    pairs = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
        lambda other: F.least(own, other) * F.col("blocks") + F.greatest(own, other) + 1,
    )
    pairs = F.coalesce(pairs, F.array(F.lit(0).cast("long")))
    return level.join(large, ["mask", "value"], "left").select(*level.columns, F.explode(pairs).alias("pair"))


def shards(points: DataFrame, radius: int, most: int) -> DataFrame:
    """fp, mask, value, pair: every shard in which a fingerprint stands as a query and as a tree node.

    Of radius + 1 runs of bits, two fingerprints within the radius agree on one at least, so shards
    that fix one run each lose no link. A shard of more than `most` fingerprints is split again by the
    bits that it leaves free. What is still larger is dealt by a hash into blocks of about `most`, and
    every pair of blocks is a shard of its own: nothing is dropped.
    """
    spark = points.sparkSession
    first = _split(0, radius + 1)
    level = points.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in first])).alias("mask"))
    level = written(level.select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value")), "shards")
    hot = written(level.groupBy("mask", "value").count().where(F.col("count") > most).select("mask", "value"), "hot")
    if hot.isEmpty():
        return level.withColumn("pair", F.lit(0).cast("long"))
    finer = spark.createDataFrame([(_signed(m), _signed(c)) for m in first for c in _split(m, radius + 1)], "mask long, child long")
    split = level.join(hot, ["mask", "value"], "left_semi").join(F.broadcast(finer), "mask")
    split = written(split.select("fp", F.col("child").alias("mask"), F.col("fp").bitwiseAND(F.col("child")).alias("value")), "shards")
    split = in_blocks(split, most)
    cold = level.join(hot, ["mask", "value"], "left_anti").select("fp", "mask", "value", F.lit(0).cast("long").alias("pair"))
    return cold.unionByName(split)


def links(points: DataFrame, radius: int = 3, most: int = 2048, per_task: int = 40_000) -> DataFrame:
    """u, v (fingerprints): for every shard's classes under Hamming distance <= radius, a star of links.

    points: distinct fp. Each shard's BK-tree is built where its queries have been sent, so no tree
    passes through the driver; a task holds about per_task points.
    """
    spread = shards(points, radius, most)
    buckets = max(1, -(-points.count() * (radius + 1) // per_task))

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["mask", "value", "pair", "fp"])
        fps = rows["fp"].to_numpy()
        keys = rows[["mask", "value", "pair"]].to_numpy()
        shard = np.concatenate([[0], np.cumsum((keys[1:] != keys[:-1]).any(axis=1))])
        known, who = np.unique(fps, return_inverse=True)
        forest = BKForest(fps.view(np.uint64), shard)
        root = _roots(len(known), ((who[i], who[j]) for i, j in forest.links(radius)))
        moved = np.flatnonzero(root != np.arange(len(known)))
        return pd.DataFrame({"u": known[moved], "v": known[root[moved]]})

    return (
        spread.withColumn("bucket", F.pmod(F.xxhash64("mask", "value", "pair"), F.lit(buckets)))
        .groupBy("bucket")
        .applyInPandas(search, "u long, v long")
    )


def near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp, component_id of every document.

    docs: doc_id (long, unique; a null one is linked to nothing it can name), text. component_id is the smallest doc_id that links of at most
    `radius` differing bits lead to, the document's own included. Null and blank texts share the
    fingerprint zero and are linked like any other; an empty table gives no rows; further columns are
    left out. Copies meet in one distinct fingerprint before any search.
    """
    prints = written(fingerprints(docs, shingle, seed), "fingerprints")
    points = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "points")
    roots = connected_components(links(points.select("fp"), radius))
    named = points.join(roots, points["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = named.select("fp", "root").join(least, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, radius: int = 3, shingle: int = 3, seed: int = 42) -> DataFrame:
    """docs, with only the document of smallest doc_id of each group of near-duplicates; all columns stay.

    A row without a doc_id is left out.
    """
    keep = near_duplicates(docs, radius, shingle, seed).where("doc_id = component_id").select(F.col("doc_id").alias("kept_id"))
    return _those(docs, keep)


def _those(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is a kept_id; the hint makes the join alike at every size."""
    return unboxed(boxed(docs).join(keep.hint("merge"), F.col("doc_id") == F.col("kept_id"), "left_semi"), docs)


#: Words of 64 bits in a wide fingerprint.
WIDE = 4


def wide_fingerprint(text: bytes | None, shingle: int = 5, seed: int = 42, block: int = 65_536) -> bytes:
    """SimHash of the set of a text's shingles, in 256 bits: words and shingles as in fingerprint(), repeats once."""
    words = (text or b"").lower().split()
    if not words:
        return bytes(8 * WIDE)
    if len(words) < shingle:
        words, shingle = [b" ".join(words)], 1
    items = list({b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)})
    total = np.zeros(BITS * WIDE, np.int64)
    for at in range(0, len(items), block):
        some = items[at : at + block]
        hashes = b"".join([xxhash.xxh3_128_digest(s, seed) + xxhash.xxh3_128_digest(s, seed + 1) for s in some])
        total += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(len(some), -1), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(total * 2 > len(items)).tobytes()


def differing_share(similarity: float) -> float:
    """The share of bits in which two sets of one size and this Jaccard similarity are expected to differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def wide_radius(similarity: float, slack: float = 1.8) -> int:
    """Bits that two texts may differ in: what the similarity is expected to give, and `slack` standard deviations."""
    p, bits = differing_share(similarity), BITS * WIDE
    return round(bits * p + slack * math.sqrt(bits * p * (1 - p)))


#: Shares of the radius at which links are looked for in turn, so that near ones come before those that are less so.
STEPS = (0.5, 0.7, 0.85, 1.0)

#: Documents with a candidate link up to which their ids are broadcast, 8 bytes each; more are joined.
SENT = 1_000_000


def shingle_set(text: bytes | None, shingle: int) -> set[bytes]:
    words = (text or b"").lower().split()
    if len(words) < shingle:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)}


def verified(links: DataFrame, docs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The links (u, v) of documents (doc_id, text) whose sets of shingles have this Jaccard similarity or more.

    Only texts with a link are shuffled. Several rows of one doc_id count as the one that sorts first by text.
    """
    nodes = written(links.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "linked")
    few = nodes.count() <= SENT
    mine = docs.join(F.broadcast(nodes) if few else nodes, F.col("doc_id") == F.col("node"), "left_semi")
    mine = written(mine.groupBy("doc_id").agg(F.min("text").alias("text")), "linked-texts", "zstd")
    side = lambda name: mine.select(F.col("doc_id").alias(name), F.col("text").alias(f"{name}_text"))
    pairs = links.join(side("u"), "u").join(side("v"), "v").select("u", "v", "u_text", "v_text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int | None, set[bytes]] = (None, set())
        for batch in batches:
            v = batch.column("v").to_numpy()
            good = np.zeros(batch.num_rows, bool)
            texts = [_binary(batch.column(c)) for c in ("u_text", "v_text")]
            for k in range(batch.num_rows):
                if held[0] != v[k]:  # links come by v, as they were joined
                    held = (int(v[k]), shingle_set(texts[1][k].as_py(), shingle))
                other = shingle_set(texts[0][k].as_py(), shingle)
                same = len(held[1] & other)
                good[k] = same >= similarity * (len(held[1]) + len(other) - same) - 1e-9
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(good))

    found = written(pairs.mapInArrow(check, "u long, v long"), "verified")
    remove(docs.sparkSession, nodes, mine)
    return found


def bands(number: int, similarity: float, missed: float = 0.02, seed: int = 42) -> np.ndarray:
    """Bits of each band: rows of as many bits as keep `number` points thin, and so many rows that a pair of
    this similarity agrees on no band with a probability of about `missed`, whatever the number of points."""
    width = max(12, math.ceil(math.log2(max(2, number) / 64)))
    same = (1 - differing_share(similarity)) ** width
    count = max(1, math.ceil(math.log(missed) / math.log(1 - same)))
    rng = np.random.default_rng(seed)
    return np.array([rng.choice(BITS * WIDE, width, replace=False) for _ in range(count)])


#: Buckets of shingles, by the top bits of their hash, in which they are counted for the order by rarity: a table of fixed size.
RARITY_BITS = 16


def _binary(texts: pa.Array) -> pa.Array:
    return texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())


def shingle_hashes(text: bytes | None, shingle: int, seed: int) -> np.ndarray:
    return np.frombuffer(b"".join([xxhash.xxh3_64_digest(s, seed) for s in shingle_set(text, shingle)]), np.uint64)


def signatures(text: bytes | None, similarity: float, shingle: int = 5, seed: int = 42, rarity: np.ndarray | None = None) -> np.ndarray:
    """Numbers (uint64) of which two texts whose sets of shingles have this Jaccard similarity share one.

    Of s shingles in an order that is the same for all texts, similar ones share one of the first
    s - ceil(similarity * s) + 1 of each. The order goes by rarity, a rank for each bucket of hashes, and then by hash,
    so passages that many texts share come last. Whatever the ranks, no similar pair is lost.
    """
    hashes = shingle_hashes(text, shingle, seed)
    if not len(hashes):
        return hashes
    need = len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1
    rank = np.zeros(len(hashes), np.uint8) if rarity is None else rarity[hashes >> np.uint64(64 - RARITY_BITS)]
    return hashes[np.lexsort((hashes, rank))[:need]]


#: Least bits of a parity sketch.
PARITY = 1024


def parity_sketch(hashes: np.ndarray, places: int = PARITY) -> bytes:
    """For each place whether an odd number of shingles falls there: two sets differ in no more places than shingles."""
    return np.packbits(np.bincount((hashes % np.uint64(places)).astype(np.int64), minlength=places) & 1).tobytes()


def _places(shingles: int) -> int:
    """Bits of a text's sketch, a power of two that is no less than its shingles: in fewer, the sketches of all long texts look alike."""
    return max(PARITY, 1 << (max(1, shingles) - 1).bit_length())


def sketches_differ(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """In how many places the parity sketches of each pair differ; the longer one is folded to the length of the other."""
    size = np.array([min(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64)
    out = np.zeros(len(size), np.int64)
    fold = lambda x, n: x if len(x) == n else np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, n)).tobytes()
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        x, y = (np.frombuffer(b"".join([fold(side[k], n) for k in at]), np.uint64).reshape(len(at), -1) for side in (a, b))
        out[at] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return out


def _sketched(rows: DataFrame, shingle: int, seed: int) -> tuple[DataFrame, np.ndarray]:
    """doc_id, n (shingles), odd (parity sketch); and a rank for each bucket of shingle hashes, greater for those that
    more of the texts have: half steps of log2."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << RARITY_BITS, np.int64)
        names = ["doc_id", "n", "odd", "bucket"]
        for batch in batches:
            sizes, odd = [], []
            for t in _binary(batch.column("text")):
                hashes = shingle_hashes(t.as_py(), shingle, seed)
                np.add.at(total, hashes >> np.uint64(64 - RARITY_BITS), 1)
                sizes.append(len(hashes))
                odd.append(parity_sketch(hashes, _places(len(hashes))))
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(odd, pa.binary()), pa.nulls(len(odd), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.int64()), pa.array(total[some]), pa.nulls(len(some), pa.binary()), pa.array(some)], names=names)

    both = written(rows.mapInArrow(sketch, "doc_id long, n long, odd binary, bucket long"), "sketches")
    table = np.zeros(1 << RARITY_BITS, np.int64)
    for row in both.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most 2^RARITY_BITS rows
        table[row["bucket"]] = row["n"]
    return both.where("bucket IS NULL").drop("bucket"), (2 * np.log2(1 + table)).astype(np.uint8)


def _may_be_similar(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose numbers of shingles and parity sketches allow the similarity; no similar one is dropped."""

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in ("u_n", "v_n"))
            batch = batch.filter(pa.array(np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-6))
            n, m = (batch.column(c).to_numpy() for c in ("u_n", "v_n"))
            differ = sketches_differ(*[batch.column(c).to_pylist() for c in ("u_odd", "v_odd")])
            good = differ <= (1 - similarity) / (1 + similarity) * (n + m) + 1e-6
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(good))

    side = lambda name: sketches.select(F.col("doc_id").alias(name), F.col("n").alias(f"{name}_n"), F.col("odd").alias(f"{name}_odd"))
    return pairs.join(side("u"), "u").join(side("v"), "v").mapInArrow(sift, "u long, v long")


#: Part of all shingles, by their hash, that are counted for every text; texts that these don't show to be alone are looked at whole.
COUNTED = 0.375


def _listed(rows: DataFrame, similarity: float, shingle: int, seed: int, part: float = 1.0) -> DataFrame:
    """doc_id, spare, sigs of every text: the hashes of its shingles, or of the given part of all shingles, and how many of its
    shingles a similar text may lack at most."""
    most = np.uint64(min((1 << 64) - 1, int(part * (1 << 64))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                hashes = [shingle_hashes(t.as_py(), shingle, seed) for t in _binary(batch.column("text"))]
                spare = pa.array([len(h) - math.ceil(similarity * len(h) - 1e-9) for h in hashes], pa.int64())
                hashes = [h[h <= most].view(np.int64) for h in hashes]
                ends = pa.array(np.cumsum([0, *map(len, hashes)]), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), spare, pa.ListArray.from_arrays(ends, pa.array(np.concatenate(hashes)))], names=["doc_id", "spare", "sigs"])

    return written(rows.select("doc_id", "text").mapInArrow(run, "doc_id long, spare long, sigs array<long>"), "listed")


def _those_listed(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows whose doc_id is a node; up to SENT of these are broadcast."""
    return rows.join(F.broadcast(nodes) if nodes.count() <= SENT else nodes, F.col("doc_id") == F.col("node"), "left_semi")


def _not_alone(rows: DataFrame, similarity: float, shingle: int, seed: int) -> DataFrame:
    """node: doc_ids of the texts that may be similar to another one.

    A text that has more shingles to itself than a similar one may lack is alone. Shingles are counted exactly,
    in one shuffle, so it doesn't matter how many texts share a passage.
    """
    listed = _listed(rows, similarity, shingle, seed, COUNTED)
    seen = listed.select("doc_id", F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id"))
    own = seen.where("n = 1").groupBy("doc_id").agg(F.count(F.lit(1)).alias("own"))
    texts = listed.groupBy("doc_id").agg(F.max("spare").alias("spare"), F.count(F.lit(1)).alias("rows"))  # several rows of one doc_id stay
    found = texts.join(own, "doc_id", "left").where("rows > 1 OR own IS NULL OR own <= spare").select(F.col("doc_id").alias("node"))
    found = written(found, "not-alone")
    remove(rows.sparkSession, listed)
    return found


def _met_elsewhere(rows: DataFrame, known: DataFrame, similarity: float, shingle: int, seed: int) -> DataFrame:
    """doc_id, sig: signatures of the texts of which other components' texts hold as many shingles as a similar text would.

    As in signatures(), in this order: first the shingles of one component alone, which no link between two can share and
    which are not returned, then the others by the number of texts that have them, counted exactly.
    """
    listed = _listed(rows, similarity, shingle, seed)
    each = listed.join(known, "doc_id").select("doc_id", "component_id", F.explode("sigs").alias("sig"))
    mixed = each.groupBy("sig").agg(F.min("component_id").alias("a"), F.max("component_id").alias("b"), F.count(F.lit(1)).alias("n")).where("a < b").select("sig", "n")
    text = Window.partitionBy("doc_id")
    shared = each.join(mixed, "sig").select("doc_id", "sig", F.row_number().over(text.orderBy("n", "sig")).alias("at"), F.count(F.lit(1)).over(text).alias("shared"))
    need = listed.groupBy("doc_id").agg(F.min(F.size("sigs") - F.col("spare")).alias("need"))
    found = written(shared.join(need, "doc_id").where("at <= shared - need + 1").select("doc_id", "sig"), "signatures", "zstd")
    remove(rows.sparkSession, listed)
    return found


def missed_links(rows: DataFrame, known: DataFrame, similarity: float, shingle: int, seed: int) -> DataFrame:
    """u, v (component_ids): links of this similarity between documents that `known` (doc_id, same, component_id) has apart; none is missed.

    rows: doc_id, text. Texts that the counts of their shingles show to have no similar one in another component go first.
    Of the others, documents that share a signature and not a component are compared, first by size and
    parity sketch; of copies (equal in `same`) one is.
    """
    spark = rows.sparkSession
    some = _not_alone(rows, similarity, shingle, seed)
    rows = _those_listed(rows, some)
    signed = _met_elsewhere(rows, known, similarity, shingle, seed)
    left = written(signed.select(F.col("doc_id").alias("node")).distinct(), "met-elsewhere")
    rows = written(_those_listed(rows, left), "left-texts", "zstd")
    remove(spark, some, left)
    sketches, _ = _sketched(rows, shingle, seed)
    shared = signed.groupBy("sig").count().where("count > 1").drop("count")
    met = written(signed.join(shared, "sig", "left_semi").join(known, "doc_id"), "met", "zstd")
    remove(spark, signed)
    mixed = met.groupBy("sig").agg(F.min("component_id").alias("a"), F.max("component_id").alias("b")).where("a < b").select("sig")
    few = met.join(mixed, "sig", "left_semi").groupBy("sig", "same", "component_id").agg(F.min("doc_id").alias("doc_id"))
    few = written(few.select("sig", "doc_id", F.col("component_id").alias("c")), "mixed", "zstd")
    pairs = few.alias("a").join(few.alias("b"), F.col("a.sig") == F.col("b.sig")).where("a.c < b.c")
    pairs = written(pairs.select(F.col("a.doc_id").alias("u"), F.col("b.doc_id").alias("v")).distinct(), "missed")
    sifted = written(_may_be_similar(pairs, sketches, similarity), "sifted")
    remove(spark, pairs, sketches)
    checked = verified(sifted, rows, similarity, shingle)
    name = lambda c: known.select(F.col("doc_id").alias(c), F.col("component_id").alias(f"c{c}"))
    links = written(checked.join(name("u"), "u").join(name("v"), "v").select(F.col("cu").alias("u"), F.col("cv").alias("v")).distinct(), "missed-links")
    remove(spark, rows, met, few, sifted, checked)
    return links


def similar_documents(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, seed: int = 42, most: int = 2048, per_task: int = 40_000) -> DataFrame:
    """doc_id, component_id of every document that has a doc_id: groups of texts alike in their word shingles.

    Two documents are linked if their sets of shingles have this Jaccard similarity. Those are looked for
    whose wide fingerprints, an estimate of it, lie within wide_radius(similarity) and agree on one band at
    least: in shards, one for each value of each band, BK-trees are searched. In a task the links that join
    its documents, the nearest first, are candidates, and each is checked on the sets themselves; so a
    group of n copies costs about n checks and not n * n. What that leaves apart is linked by missed_links(),
    so no link is lost. Equal fingerprints meet before, unchecked. Null and blank texts are alike. An
    empty table gives no rows. Columns but doc_id and text are not read. similarity: 0.75 or more.
    """
    if similarity < 0.75:
        raise ValueError("below 0.75 signatures do not find all links")
    spark, radius = docs.sparkSession, wide_radius(similarity)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _binary(batch.column("text"))
            found = pa.array((wide_fingerprint(t.as_py(), shingle, seed) for t in texts), pa.binary(), size=len(texts))
            same = pa.array((xxhash.xxh3_128_digest(b" ".join((t.as_py() or b"").lower().split())) for t in texts), pa.binary(), size=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found, same], names=["doc_id", "fp", "same"])

    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"))
    prints = written(rows.mapInArrow(sketch, "doc_id long, fp binary, same binary"), "wide-fingerprints")
    points = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "wide-points")
    chosen = bands(points.count(), similarity, seed=seed)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                fps = batch.column("fp")
                bits = np.unpackbits(np.frombuffer(b"".join(fps.to_pylist()), np.uint8).reshape(batch.num_rows, -1), axis=1)
                values = (bits[:, chosen].astype(np.int64) << np.arange(chosen.shape[1])).sum(axis=2)
                who = pa.array(np.repeat(np.arange(batch.num_rows), len(chosen)))
                columns = [batch.column("first").take(who), fps.take(who), pa.array(np.tile(np.arange(len(chosen)), batch.num_rows)), pa.array(values.ravel())]
                yield pa.RecordBatch.from_arrays(columns, names=["first", "fp", "mask", "value"])

    level = points.mapInArrow(spread, "first long, fp binary, mask long, value long")
    banded = written(level, "bands", "zstd")
    shared = banded.groupBy("mask", "value").count().where("count > 1").drop("count")
    level = in_blocks(banded.join(shared, ["mask", "value"], "left_semi"), most)
    buckets = max(1, -(-points.count() * len(chosen) // per_task))

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["mask", "value", "pair", "first"])
        keys = rows[["mask", "value", "pair"]].to_numpy()
        shard = np.concatenate([[0], np.cumsum((keys[1:] != keys[:-1]).any(axis=1))])
        known, who = np.unique(rows["first"].to_numpy(), return_inverse=True)
        forest = BKForest(np.frombuffer(b"".join(rows["fp"]), np.uint64).reshape(len(rows), -1), shard)
        links = ((who[i], who[j]) for step in STEPS for i, j in forest.links(round(radius * step)))
        i, j = _spanning(len(known), links)
        return pd.DataFrame({"u": np.maximum(known[i], known[j]), "v": np.minimum(known[i], known[j])})

    level = level.withColumn("bucket", F.pmod(F.xxhash64("mask", "value", "pair"), F.lit(buckets)))
    links = written(level.groupBy("bucket").applyInPandas(search, "u long, v long").distinct(), "links")
    checked = verified(links, rows, similarity, shingle)
    roots = connected_components(checked)
    named = points.join(roots, points["first"] == roots["node"], "left").select("fp", F.coalesce("root", "first").alias("component_id"))
    known = written(prints.join(named, "fp").select("doc_id", "same", "component_id"), "known-components")
    remove(spark, prints, points, banded, links, checked, roots)
    missed = missed_links(rows, known, similarity, shingle, seed)
    roots = connected_components(missed)
    found = known.join(roots, known["component_id"] == roots["node"], "left").select("doc_id", F.coalesce("root", "component_id").alias("component_id"))
    found = written(found, "similar-documents")
    remove(spark, known, missed, roots)
    return found


def deduplicate_similar(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, seed: int = 42) -> DataFrame:
    """docs, with only the document of smallest doc_id of each group of similar_documents(); all columns stay.

    A row without a doc_id is left out.
    """
    groups = similar_documents(docs, similarity, shingle, seed)
    return _those(docs, groups.where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")))

"""Periodic runs of words: every maximal stretch that repeats with a period, found through blocks of copies.

Suffix sorting by prefix doubling gives the suffix array of many texts at once, neighbours' common prefixes
and from those the longest previous factor of each place. Following it cuts a text into blocks, each a copy
of something earlier or a new word. A run that touches the border of two blocks comes out by extending the
border's period to both sides; its period is less than the two blocks together, so all borders take linear
work. A run strictly inside a block is a copy of an earlier one, taken from the bucket of its start.

Arrays hold the places of all texts of a batch, each followed by an end mark of its own; nothing matches
across an end mark.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import released

#: Bytes of text that are looked at together, and pairs of a border and a period.
MOST, PAIRS = 1 << 22, 1 << 20

#: Rounds in which all open places look further together, before the rest do one by one.
ROUNDS = 64


def _starts(groups: np.ndarray) -> np.ndarray:
    """For sorted keys the index of the first of each one's equals."""
    new = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    return np.repeat(new, np.diff(np.append(new, len(groups))))


class Suffixes:
    """The suffix array of words (each text's words are numbers of its own) and the classes of equal stretches.

    ranks[i] gives each place a number that it shares with the places where the same 2^i words stand.
    """

    def __init__(self, keys: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        rank = np.empty(len(keys), np.int64)
        rank[order] = _starts(keys[order])
        self.ranks, length = [rank], 1
        open_ = np.flatnonzero(self._tied(rank[order]))
        while len(open_):
            # what ties at `length` words holds no end mark, so there is a place after them
            at = order[open_]
            pair = rank[at] * len(keys) + rank[at + length]
            sort = np.argsort(pair, kind="stable")
            at, pair = at[sort], pair[sort]
            order[open_] = at
            rank = rank.copy()
            rank[at] = open_[_starts(pair)]
            self.ranks.append(rank)
            length *= 2
            open_ = open_[self._tied(rank[at])]
        self.order = order

    @staticmethod
    def _tied(sorted_ranks: np.ndarray) -> np.ndarray:
        same = sorted_ranks[1:] == sorted_ranks[:-1]
        return np.concatenate([same, [False]]) | np.concatenate([[False], same])

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words are the same from places i and j on; i is never j."""
        found = np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.ranks))):
            found += (self.ranks[k][i + found] == self.ranks[k][j + found]).astype(np.int64) << k
        return found

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words are the same up to places i and j, these included; places below 0 match nothing."""
        found = np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.ranks))):
            a, b = i - found - (1 << k) + 1, j - found - (1 << k) + 1
            inside = (a >= 0) & (b >= 0)
            same = inside & (self.ranks[k][np.where(inside, a, 0)] == self.ranks[k][np.where(inside, b, 0)])
            found += same.astype(np.int64) << k
        return found

    def common(self) -> np.ndarray:
        """Of each suffix but the first, in order, the words that it shares with the one before."""
        return np.concatenate([[0], self.ahead(self.order[:-1], self.order[1:])])


def _nearest_before(places: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix, in order, the nearest one before it that begins earlier in the text, and the words shared with it.

    All suffixes jump together over those that begin later, each to where that one has come; after ROUNDS the
    few that are left go on from left to right, which is linear.
    """
    to, shared = np.arange(len(places)) - 1, common.copy()
    open_ = np.flatnonzero(shared)
    open_ = open_[places[to[open_]] > places[open_]]
    for _ in range(ROUNDS):
        if not len(open_):
            return to, shared
        at = to[open_]
        shared_now, to_now = np.minimum(shared[open_], shared[at]), to[at]
        shared[open_], to[open_] = shared_now, to_now
        open_ = open_[(shared_now > 0) & (places[to_now] > places[open_])]
    for i in open_.tolist():
        j, least = to[i], shared[i]
        while least > 0 and places[j] > places[i]:
            j, least = to[j], min(least, shared[j])
        to[i], shared[i] = j, least
    return to, shared


def previous_factors(suffixes: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """For each place the most words from there on that also begin earlier in the same text, and where."""
    order, common = suffixes.order, suffixes.common()
    to, left = _nearest_before(order, common)
    back, right = _nearest_before(order[::-1], np.concatenate([[0], common[:0:-1]]))
    back, right = len(order) - 1 - back[::-1], right[::-1]
    longest, source = np.zeros(len(order), np.int64), np.full(len(order), -1)
    longest[order] = np.maximum(left, right)
    source[order] = order[np.where(left >= right, to, np.minimum(back, len(order) - 1))]
    return longest, np.where(longest > 0, source, -1)


def blocks(longest: np.ndarray) -> np.ndarray:
    """Where blocks begin: each is as long as the longest previous factor of its first place, one word at least."""
    steps, at, found = np.maximum(longest, 1).tolist(), 0, []
    while at < len(steps):
        found.append(at)
        at += steps[at]
    return np.array(found, np.int64)


def _at_borders(suffixes: Suffixes, begins: np.ndarray, sizes: np.ndarray, least: int, power: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Start, end and period of the runs that touch borders of blocks; some come several times.

    With `both` the words of the two blocks at a border, a run that ends in the second one has less than
    both + period words, else the first would have been longer. So length - period < both, where it is
    at least least * (1 - 1 / power) and (power - 1) * period.
    """
    both = sizes[:-1] + sizes[1:]
    wanted = np.flatnonzero(both * power > least * (power - 1))
    many = (both[wanted] - 1) // (power - 1)
    total, end = np.cumsum(many), len(suffixes.order)
    for low in range(0, int(total[-1]) if len(total) else 0, PAIRS):
        pair = np.arange(low, min(low + PAIRS, int(total[-1])))
        which = np.searchsorted(total, pair, "right")
        border = begins[wanted[which] + 1]
        period = pair - (total[which] - many[which]) + 1
        for start in (border, border - period):  # a period after the border, and a period before it
            inside = (start >= 0) & (start + period < end)
            i, p = start[inside], period[inside]
            first, last = i - suffixes.behind(i - 1, i + p - 1), i + p + suffixes.ahead(i, i + p)
            good = last - first >= np.maximum(least, power * p)
            yield first[good], last[good], p[good]


def all_runs(keys: np.ndarray, least: int = 2, power: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of all runs of at least `least` words and `power` (2 or more) periods, by start and period.

    keys: a number for each word; every text ends with a number that stands nowhere else.
    """
    suffixes = Suffixes(keys)
    longest, source = previous_factors(suffixes)
    begins = blocks(longest)
    sizes = np.diff(np.append(begins, len(keys)))
    parts = list(_at_borders(suffixes, begins, sizes, least, power))
    first, last, period = (np.concatenate([p[i] for p in parts] or [np.empty(0, np.int64)]) for i in range(3))
    sort = np.lexsort((period, last, first))
    first, last, period = first[sort], last[sort], period[sort]
    new = np.concatenate([[True], (first[1:] != first[:-1]) | (last[1:] != last[:-1])]) if len(first) else np.empty(0, bool)
    found = np.stack([first[new], last[new], period[new]], 1)  # a multiple of a period isn't the smallest
    buckets: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for s, e, p in found.tolist():
        buckets[s].append((e, p))
    held = sorted(buckets)
    copied = []
    for k in np.flatnonzero(sizes >= least + 2).tolist() if held else ():
        begin, size = int(begins[k]), int(sizes[k])
        away = begin - int(source[begin])
        at = bisect_right(held, begin - away)
        while at < len(held) and (s := held[at]) < begin - away + size - least:
            for e, p in list(buckets[s]):
                if e < begin - away + size:
                    if s + away not in buckets:
                        insort(held, s + away)
                    if (e + away, p) not in buckets[s + away]:
                        buckets[s + away].append((e + away, p))
                        copied.append((s + away, e + away, p))
            at += 1
    if copied:
        found = np.concatenate([found, np.array(copied, np.int64)])
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    return found[:, 0], found[:, 1], found[:, 2]


def _numbered(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, int]:
    """The words of all texts one after another, the number of each word, where each text begins, how many words differ."""
    parts = pc.ascii_split_whitespace(texts)
    flat, offsets = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    blank = pc.index(coded.dictionary, pa.scalar("", flat.type)).as_py()
    if blank >= 0:
        keep = codes != blank
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        flat, codes = flat.filter(pa.array(keep)), codes[keep]
    return flat, codes, offsets, len(coded.dictionary)


def _joined(codes: np.ndarray, offsets: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the words, each text with numbers of its own and its end mark, and where each text begins."""
    sizes = np.diff(offsets)
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    text = np.repeat(np.arange(len(sizes)), sizes + 1)
    keys = text * (kinds + 1) + kinds  # end marks, where no word stands
    keys[np.arange(len(codes)) + np.repeat(np.arange(len(sizes)), sizes)] += codes - kinds
    return keys, begins


_SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def run_report(docs: DataFrame, least: int = 24, power: int = 3, order: Callable[[int | None, int], np.ndarray | None] | None = None, texts: bool = False) -> DataFrame:
    """doc_id, n_runs, the run of most periods (start, length, period, exponent_milli) and digests of the runs and the text without them.

    A run counts from `least` words and `power` periods on. The text without runs has of each run its first
    period, and what no run holds; with `texts` it comes too, as column collapsed. order(doc_id, n) may give
    the places of the words that are to stand in a text of n words in place of its own, or None.

    A null text is empty; it has no runs, and the digests of nothing. Repeated rows and ids count each; an
    empty table gives no rows. Nothing is shuffled; a task holds some 200 bytes a word of what it looks at
    together, 4 MB of text or one longer text.
    """
    def answer(doc: int | None, words: list[bytes] | bytes, first: np.ndarray, last: np.ndarray, period: np.ndarray) -> tuple:
        listed = "".join(f"{s},{e - s},{p}\n" for s, e, p in zip(first.tolist(), last.tolist(), period.tolist(), strict=True))
        best: tuple = (None,) * 4
        if len(first):
            cover = np.zeros(len(words) + 1, np.int64)
            np.add.at(cover, first + period, 1)
            np.add.at(cover, last, -1)
            words = b" ".join(w for w, c in zip(words, np.cumsum(cover).tolist(), strict=False) if not c)
            top = 0
            sizes, periods = (last - first).tolist(), period.tolist()
            for k in range(1, len(sizes)):
                if sizes[k] * periods[top] > sizes[top] * periods[k]:
                    top = k
            best = (int(first[top]), sizes[top], periods[top], 1000 * sizes[top] // periods[top])
        elif not isinstance(words, bytes):
            words = b" ".join(words)
        found = (doc, len(first), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(words).hexdigest())
        return (*found, words.decode()) if texts else found

    def looked_at(ids: list, raw: list[bytes]) -> Iterator[tuple]:
        flat, codes, offsets, kinds = _numbered(pa.array(raw, pa.binary()).view(pa.string()))
        moved = {}
        if order:
            for k, doc in enumerate(ids):
                places = order(doc, int(offsets[k + 1] - offsets[k]))
                if places is not None:
                    moved[k] = places
            codes = codes.copy()
            for k, places in moved.items():
                codes[offsets[k] : offsets[k + 1]] = codes[offsets[k] + places]
        keys, begins = _joined(codes, offsets, kinds)
        first, last, period = all_runs(keys, least, power)
        cuts = np.searchsorted(first, np.append(begins, len(keys)))
        for k, doc in enumerate(ids):
            at = slice(cuts[k], cuts[k + 1])
            runs = (first[at] - begins[k], last[at] - begins[k], period[at])
            if len(runs[0]) or k in moved:
                words = flat.slice(offsets[k], offsets[k + 1] - offsets[k])
                if k in moved:
                    words = words.take(pa.array(moved[k]))
                yield answer(doc, words.cast(pa.binary()).to_pylist(), *runs)
            else:
                yield answer(doc, b" ".join(raw[k].split()), *runs)

    fields = [("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")], ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
    schema = pa.schema(fields + [("collapsed", pa.string())] * texts)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            ids, raw, size = [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                ids.append(doc)
                raw.append(text.as_py() or b"")
                size += len(raw[-1])
                if size >= MOST:
                    yield table(list(looked_at(ids, raw)))
                    ids, raw, size = [], [], 0
            if ids:
                yield table(list(looked_at(ids, raw)))

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, _SCHEMA + ", collapsed string" * texts)


def repeated_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """Places for run_report: a tenth of the texts, by the id's hash, go on with a period from some word on."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not n or doc_id is None:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places

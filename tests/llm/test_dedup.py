"""SimHash, exact and line deduplication against brute force, and their corner cases."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import exact, lines, simhash
from tidemark.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, id string, fp string, kept string"


def table(spark, texts):
    rows = [(i, t, None, "s", len(t) if t else None, "r", "x", "f", "k") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def some_texts(n=120, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    texts = [None, "", " \n\t", "one", "one two", "ONE  two", "\x0bone\x0ctwo"]
    for _ in range(n):
        base = [rng.choice(words) for _ in range(rng.randint(1, 60))]
        texts.append(" ".join(base))
        if rng.random() < 0.5:
            base[rng.randrange(len(base))] = "changed"
            texts.append("\n".join(base))
        if rng.random() < 0.3:
            texts.append(texts[-1])
    return texts


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group(0).lower(), text or ""))
    if not words:
        return 0
    items = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in items]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(n)]


def test_simhash_matches_brute_force(spark):
    texts = some_texts()
    found = {r.doc_id: r for r in simhash.near_duplicates(table(spark, texts)).collect()}
    prints = [slow_fingerprint(t) for t in texts]
    assert [found[i].fp % 2**64 for i in range(len(texts))] == prints
    want = classes(len(texts), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    assert [found[i].component_id for i in range(len(texts))] == want


@pytest.mark.parametrize("most", [8, 30, 2048])
def test_hot_shards_lose_no_link(spark, most):
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 2**63))
    prints = {centre}
    while len(prints) < 150:
        x = centre
        for b in rng.integers(0, 64, rng.integers(1, 7)):
            x ^= 1 << int(b)
        prints.add(x)
    prints = sorted(prints)
    points = spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in prints], "fp long")
    roots = connected_components(simhash.links(points, 3, most=most, per_task=50))
    got = {r.node % 2**64: r.root % 2**64 for r in roots.collect()}
    want = classes(len(prints), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    groups = {}
    for x, w in zip(prints, want):
        groups.setdefault(w, set()).add(got.get(x, x))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_bk_tree_finds_what_a_scan_finds():
    rng = np.random.default_rng(0)
    points = np.unique(rng.integers(0, 2**12, 400).astype(np.uint64))
    shard = (points % np.uint64(3)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    points, shard = points[order], shard[order]
    pairs = {(int(i), int(j)) for a, b in simhash.BKForest(points, shard).links(2) for i, j in zip(a, b)}
    want = {(i, j) for i in range(len(points)) for j in range(i) if shard[i] == shard[j] and (int(points[i]) ^ int(points[j])).bit_count() <= 2}
    assert pairs == want


def test_simhash_keeps_one_of_each_group_and_all_columns(spark):
    docs = table(spark, some_texts(20))
    assert simhash.deduplicate(docs).columns == docs.columns
    groups = simhash.near_duplicates(docs)
    assert simhash.deduplicate(docs).count() == groups.select("component_id").distinct().count()


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400), (7, 7), (None, 3)], "u long, v long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 400: 400, 500: 400}


def test_exact_matches_brute_force(spark):
    texts = some_texts()
    key = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for t in texts]
    groups = {}
    for i, k in enumerate(key):
        groups.setdefault(k, []).append(i)
    best = {k: max(v, key=lambda i: (len(texts[i] or ""), -i)) for k, v in groups.items()}
    got = {r.doc_id: r for r in exact.classes(table(spark, texts)).collect()}
    for i, k in enumerate(key):
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept) == (best[k], len(groups[k]), best[k] == i)
        assert bytes(r.digest) == hashlib.sha256(k.encode()).digest()
    kept = exact.deduplicate(table(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(best.values())
    assert kept.columns == table(spark, texts).columns


def test_index_persists_over_batches(spark):
    index = exact.DigestIndex(spark, "digests_of_test", 4)
    first = exact.deduplicate(spark.createDataFrame([(1, "a b"), (2, "ab")], "doc_id long, text string"), index)
    assert [r.doc_id for r in first.collect()] == [1]
    second = spark.createDataFrame([(3, "a\nb"), (4, "new"), (5, "n ew")], "doc_id long, text string")
    assert [r.doc_id for r in exact.deduplicate(second, index).collect()] == [5]
    assert index.read().count() == 2
    plan = second.select(exact.digest(F.col("text")).alias("digest")).join(index.read().hint("merge"), "digest", "left_anti")
    assert "SortMergeJoin" in plan._jdf.queryExecution().toString()
    index.drop()


def slow_lines(texts, threshold=0.8):
    seen, kept = [], {}
    for i, t in enumerate(texts):
        for k, line in enumerate((t or "").split("\n")):
            words = frozenset(w for w in re.split(r"[\x20\x09-\x0D]+", line.lower()) if w)
            if not words:
                continue
            if not any(l == line or len(words & s) >= threshold * len(words | s) - 1e-9 for l, s in seen):
                kept.setdefault(i, []).append(k)
            seen.append((line, words))
    return kept


def test_lines_match_brute_force(spark):
    rng = random.Random(3)
    words = [f"v{i}" for i in range(25)]
    texts = [None, "", "\n \n"]
    for _ in range(60):
        texts.append("\n".join(" ".join(rng.choice(words[: rng.choice([3, 25])]) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 4))))
    docs = table(spark, texts)
    want = slow_lines(texts)
    got = {r.doc_id: r for r in lines.line_report(docs).collect()}
    assert len(got) == len(texts)
    assert {i: r.kept_lines for i, r in got.items() if r.kept_lines} == want
    cleaned = {r.doc_id: r.text for r in lines.deduplicate(docs).collect()}
    assert cleaned[0] is None
    for i, t in enumerate(texts[1:], 1):
        assert cleaned[i] == "\n".join(x for k, x in enumerate(t.split("\n")) if not x.split() or k in want.get(i, []))
    assert lines.deduplicate(docs).columns == docs.columns


def test_lines_of_dense_and_chained_groups(spark):
    """Many near copies of one line, a chain in which only neighbours are similar, ties, and rows without an id."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(30)]
    texts = []
    for k in range(60):
        copy = list(base)
        copy[rng.randrange(30)] = f"new{k}"
        texts.append(" ".join(copy))
    texts += [" ".join(f"c{i}" for i in range(k, k + 20)) for k in range(0, 40)]
    texts += ["Equal line of words here\nequal LINE of words here\n\n  here of words equal line", "x\ny\nx", "z " * 5000]
    rng.shuffle(texts)
    want = slow_lines(texts)
    docs = table(spark, texts)
    got = {r.doc_id: r.kept_lines for r in lines.line_report(docs).collect()}
    assert {i: k for i, k in got.items() if k} == want
    nameless = spark.createDataFrame([(None, "a b\na b"), (None, None), (4, "a b\na b")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_lines, r.n_removed, r.kept_lines) for r in lines.line_report(nameless).collect()) == [(0, 0, 0, []), (0, 2, 0, [0, 1]), (4, 2, 1, [0])]
    assert sorted(str(r.text) for r in lines.deduplicate(nameless).collect()) == ["None", "a b", "a b\na b"]


def test_empty_tables(spark):
    docs = table(spark, ["x"]).where("false")
    assert simhash.near_duplicates(docs).collect() == []
    assert simhash.deduplicate(docs).collect() == []
    assert exact.classes(docs).collect() == []
    assert exact.deduplicate(docs).collect() == []
    assert lines.line_report(docs).collect() == []
    assert lines.deduplicate(docs).collect() == []

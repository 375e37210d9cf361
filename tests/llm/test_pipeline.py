"""The pipeline against a plain version of its stages, and the guard of the entry module."""

import random
import re
import zlib

import numpy as np

import corpus_pipeline
from tests.llm.test_dedup import classes, table
from tidemark.llm import pii, quality, simhash
from tidemark.llm.common import tokenizer_path

BLANK = r"[\x20\x09-\x0D]+"


def words_of(text):
    return [w for w in re.split(BLANK, text) if w]


def slow_line_fails(line):
    words = words_of(line)
    n = len(words)
    if not n:
        return False
    marks = len(re.findall(r"[#*$%&|<>{}~^=]", line)) + line.count("!!")
    bars = len(re.findall("[|»›•·]", line))
    same = sum(a == b for a, b in zip(words, words[1:]))
    return bool(
        (marks and 2 * marks >= n)
        or (n >= 10 and (not re.search("[.!?…。！？;:]", line) or 2 * same >= n))
        or (bars >= 3 and 5 * bars >= n)
        or (n <= 25 and any(p in line.lower() for p in quality.BOILERPLATE))
    )


def slow_rules(text):
    """The text without its failing lines, or None where the document is rejected."""
    words = words_of(text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    again = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)} if len(set(windows)) < len(windows) else set()
    if len(words) < 20 or 100 * len(again) > 30 * len(words):
        return None
    lines = text.split("\n")
    lost = sum(len(w) for x in lines if slow_line_fails(x) for w in words_of(x))
    return "\n".join(x for x in lines if not slow_line_fails(x)) if 2 * lost <= sum(map(len, words)) else None


def shingles(text):
    words = words_of(re.sub("[A-Z]", lambda m: m.group(0).lower(), text))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_stages_keep_columns_and_take_effect(spark, data):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "exact_dedup", "near_dedup", "redact", "pack"]
    seen = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, data)
        assert now.columns == docs.columns
        now = spark.createDataFrame(now.collect(), docs.schema)
        seen[name] = {r.doc_id: r.text for r in now.collect()}
        assert all(r.n_chars == len(r.text) for r in now.collect() if name in ("quality_rules", "redact"))
    good = {r.doc_id: slow_rules(r.text) for r in docs.collect()}
    assert seen["quality_rules"] == {i: t for i, t in good.items() if t is not None}
    best = {}
    for i, t in seen["quality_rules"].items():
        key = re.sub(BLANK, "", t)
        best[key] = max(best.get(key, (-1, 0)), (len(t), -i))
    assert set(seen["exact_dedup"]) == {-i for _, i in best.values()}
    ids = sorted(seen["exact_dedup"])
    sets = [shingles(seen["exact_dedup"][i]) for i in ids]
    roots = classes(len(ids), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9)
    assert {ids[r] for r in roots} <= set(seen["near_dedup"]) <= set(ids)  # a pair may agree on no band
    assert len(seen["near_dedup"]) <= len({ids[r] for r in roots}) + 1
    assert set(seen["redact"]) == set(seen["near_dedup"])
    assert not any(re.search(pii.PATTERNS["email"].replace(r"\G|", ""), t) for t in seen["redact"].values())
    rows = corpus_pipeline.run(spark, data).toPandas()
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = []
    for i, t in seen["redact"].items():
        ids = library.encode(t, add_special_tokens=False).ids + [1]
        want += [(i, k, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
    assert sorted(map(tuple, rows[["doc_id", "piece", "start", "length", "ids_crc32"]].values.tolist())) == sorted(want)


def test_near_copies_are_found_and_others_left(spark):
    """Of pairs at a five-word Jaccard similarity of 0.8 or more nearly all are found, at 0.80 to 0.82 as well, and none below."""
    rng = random.Random(4)
    texts = []
    for k in range(500):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([60, 200, 900]))]
        copy = list(base)
        for _ in range(max(1, len(base) * rng.choice([10, 20, 22, 25, 30, 80]) // 1000)):
            copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
        texts += [" ".join(base), "  ".join(copy)]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(table(spark, [*texts, None, "", " \n"])).collect()}
    assert got[1000] == got[1001] == got[1002] == 1000
    close, edge = [], []
    for k in range(0, 1000, 2):
        a, b = shingles(texts[k]), shingles(texts[k + 1])
        alike = len(a & b) / len(a | b)
        found = got[k + 1] == k
        assert got[k] == k and got[k + 1] in (k, k + 1) and not (found and alike < 0.8 - 1e-9)
        if alike >= 0.8:
            (edge if alike < 0.82 else close).append(found)
    assert len(close) > 100 and len(edge) > 60 and sum(close) >= 0.97 * len(close) and sum(edge) >= 0.9 * len(edge), (len(close), sum(close), len(edge), sum(edge))


def edge_pairs(seed, sizes, many):
    """Pairs of texts whose similarity is at or little over 0.8: words changed, one end cut off, or both ends different."""
    rng = random.Random(seed)
    while many:
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice(sizes))]
        kind, copy = rng.randrange(3), list(base)
        if kind == 0:
            for _ in range(max(1, len(base) * 22 // 1000)):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
        elif kind == 1:
            copy = copy[: len(base) - int((len(base) - 4) * 0.2)]
        else:
            copy = [f"new{rng.randrange(10**6)}" for _ in range(len(base) // 9)] + copy[len(base) // 9 :]
        a, b = shingles(" ".join(base)), shingles(" ".join(copy))
        if 0.8 <= len(a & b) / len(a | b) <= 0.825 and a != b:
            many -= 1
            yield " ".join(base), " ".join(copy)


def test_no_pair_at_the_threshold_is_missed(spark):
    texts = [t for pair in edge_pairs(8, [9, 14, 40, 70, 100, 300, 900], 300) for t in pair]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(table(spark, texts)).collect()}
    # a short text may be like a third one, so classes are those of all pairs
    sets = [shingles(t) for t in texts]
    roots = classes(len(texts), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9)
    assert got == dict(enumerate(roots))


def test_similar_texts_share_a_signature():
    for a, b in edge_pairs(9, [6, 9, 14, 24, 68, 69, 90, 150, 400, 2000], 400):
        x, y = (simhash.signatures(t.encode(), 0.8) for t in (a, b))
        assert len(np.intersect1d(x, y))


def test_sketches_and_ranks_lose_no_similar_pair():
    ranks = np.random.default_rng(3).integers(0, 40, 1 << simhash.RARITY_BITS).astype(np.uint8)
    for a, b in edge_pairs(10, [6, 14, 68, 150, 2000], 200):
        x, y = (simhash.shingle_hashes(t.encode(), 5, 42) for t in (a, b))
        odd = [np.unpackbits(np.frombuffer(simhash.parity_sketch(h), np.uint8)) for h in (x, y)]
        assert (odd[0] != odd[1]).sum() <= len(np.setxor1d(x, y)) <= 0.2 / 1.8 * (len(x) + len(y)) + 1e-6
        assert len(np.intersect1d(*(simhash.signatures(t.encode(), 0.8, rarity=ranks) for t in (a, b))))


def test_sketches_part_long_texts(spark):
    """Long texts that are not alike go by their sketches; similar ones stay, also where their sketches differ in length."""
    rng = random.Random(14)
    plain = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    texts = [plain(n) for n in (1000, 4000, 4000, 4200, 9000, 9500)]
    near = [f"{t} {plain(k)}" for t, k in zip(texts, (100, 200, 300, 600, 1000, 100), strict=True)]
    rows = table(spark, [*texts, *near]).select("doc_id", "text")
    sketches, _ = simhash._sketched(rows, 5, 42)
    pairs = spark.createDataFrame([(u, v) for u in range(12) for v in range(u)], "u long, v long")
    got = {(r.u, r.v) for r in simhash._may_be_similar(pairs, sketches, 0.8).collect()}
    assert got == {(u + 6, u) for u in range(6)}


def test_texts_that_share_a_passage_are_not_all_compared(spark, monkeypatch):
    """120 different texts with one long passage in common are no 7,140 checks of texts."""
    rng, checks, whole = random.Random(12), [], simhash.verified
    passage = " ".join(f"p{i}" for i in range(30))
    texts = [passage + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for _ in range(120)]
    texts.append(texts[7] + " end")
    monkeypatch.setattr(simhash, "verified", lambda links, *a: checks.append(links.count()) or whole(links, *a))
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(table(spark, texts)).collect()}
    assert got == {i: i for i in range(120)} | {120: 7}
    assert sum(checks) < 500


def test_texts_of_few_shared_lines_are_no_pairs(spark, monkeypatch):
    """Texts that share some rare lines with others, and are mostly their own, are not compared; similar ones are."""
    rng, pairs, sift = random.Random(21), [], simhash._may_be_similar
    plain = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    pool = [plain(40) for _ in range(300)]
    texts = ["\n".join([plain(400), *rng.sample(pool, 3), plain(400)]) for _ in range(300)]
    texts += [" ".join([plain(8), *t.split()[:60], plain(9)]) for t in texts[:3]] + [" ".join(t.split()[:60]) for t in texts[:3]]
    monkeypatch.setattr(simhash, "_may_be_similar", lambda p, *a: pairs.append(p.count()) or sift(p, *a))
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(table(spark, texts)).collect()}
    sets = [shingles(t) for t in texts]
    want = classes(len(texts), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9)
    assert got == dict(enumerate(want))
    assert sum(pairs) < 20


def test_only_texts_without_a_similar_one_are_left_out(spark):
    """What counts of shingles leave out has no similar text, at the threshold either, nor in another component."""
    texts = [t for pair in edge_pairs(22, [9, 14, 40, 100, 300], 60) for t in pair] + [None, "", "a b", "a b"]
    rows = table(spark, texts).select("doc_id", "text")
    sets = [shingles(t or "") for t in texts]
    near = {i for i in range(len(sets)) for j in range(len(sets)) if i != j and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9}
    assert near <= {r.node for r in simhash._not_alone(rows, 0.8, 5, 42).collect()}
    known = spark.createDataFrame([(i, i) for i in range(len(texts))], "doc_id long, component_id long")
    signed = {}
    for r in simhash._met_elsewhere(rows, known, 0.8, 5, 42).collect():
        signed.setdefault(r.doc_id, set()).add(r.sig)
    assert all(any(signed[i] & signed[j] for j in near - {i} if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9) for i in near)
    known = spark.createDataFrame([(i, i // 2) for i in range(120)], "doc_id long, component_id long")
    assert simhash._met_elsewhere(rows, known, 0.8, 5, 42).select("doc_id").distinct().count() < 10


def test_hot_shards_of_wide_fingerprints(spark):
    """Blocks of large shards, met in pairs, lose no pair."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(w if j != k else f"x{k}" for j, w in enumerate(base)) for k in rng.sample(range(400), 60)]
    docs = table(spark, [*texts, *texts])
    assert {r.component_id for r in simhash.similar_documents(docs, most=7, per_task=100).collect()} == {0}
    assert simhash.deduplicate_similar(docs).columns == docs.columns
    assert [r.doc_id for r in simhash.deduplicate_similar(docs).collect()] == [0]


def test_verdicts_can_be_filtered(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = quality.judged(docs.withColumnRenamed("source", "words")).where("kept AND n_words > 30").select("doc_id", "words").collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in quality.judged(docs).collect() if r.kept and r.n_words > 30}


def test_empty_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, data).collect() == []

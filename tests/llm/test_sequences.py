"""Runs of words, chat formatting and vector codes against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import chat, codes, queries, runs


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# runs


def plain_runs(words, least, power):
    """Start, end and smallest period of each run: all periods are tried at all places."""
    found = {}
    for p in range(1, len(words) // power + 1):
        i = 0
        while i + p < len(words):
            s = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i > s and i + p - s >= max(least, power * p):
                found.setdefault((s, i + p), p)
            i += 1
    return sorted((s, e, p) for (s, e), p in found.items())


def odd_words(rng, n):
    """Words of a small alphabet, often with a period, sometimes with the beginning again at the end."""
    words = [f"w{rng.randint(0, rng.randint(1, 3))}" for _ in range(n)]
    if n > 4 and rng.random() < 0.6:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(2, 6)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words + words[: rng.randint(0, n)] if rng.random() < 0.3 else words


def test_all_runs_are_found():
    rng = random.Random(4)
    for _ in range(600):
        texts = [odd_words(rng, rng.randint(0, 40)) for _ in range(rng.randint(1, 4))]
        power, least = rng.choice([2, 2, 3, 4]), rng.choice([2, 2, 5, 8])
        numbers = np.array([int(w[1:]) for t in texts for w in t], np.int64)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        keys, begins = runs._joined(numbers, offsets, 5)
        got = list(zip(*(x.tolist() for x in runs.all_runs(keys, least, power)), strict=True))
        assert got == sorted((s + b, e + b, p) for t, b in zip(texts, begins.tolist()) for s, e, p in plain_runs(t, least, power))


def test_nearest_before_when_few_are_left():
    """A rising list with a fall at its end takes more rounds than are tried together."""
    places = np.array([*range(1, 400), 0, 500, 450, 449])
    to, shared = runs._nearest_before(places, np.array([0] + [3] * (len(places) - 1)))
    for i in range(len(places)):
        before = [j for j in range(i) if places[j] < places[i]]
        assert shared[i] == (3 if before else 0) and (not before or to[i] == before[-1])


def plain_report(doc_id, text, planted=True):
    words = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if planted and h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = plain_runs(words, 24, 3)
    gone = {i for s, e, p in found for i in range(s + p, e)}
    best = min(found, key=lambda r: (-(r[1] - r[0]) / r[2], r[0], r[2]), default=None)
    top = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return (len(found), *top, sha("".join(f"{s},{e - s},{p}\n" for s, e, p in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


FIELDS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_run_report(spark):
    rng = random.Random(6)
    texts = [None, "", " \n\t ", "a", "a " * 5000, "ß é\x0b" * 30, "x " + "a b c\n" * 9 + "y\x1cz " * 30, "a b " * 12 + "c " + "a b " * 12]
    texts += [rng.choice([" ", "\n", "  "]).join(odd_words(rng, rng.randint(20, 200))) for _ in range(60)]
    rows = [(i, t, i, "x") for i, t in enumerate(texts)] + [(5, texts[5], 0, "y"), (None, "a " * 30, 0, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int, words string")
    got = runs.run_report(docs, order=runs.repeated_tail).collect()
    want = [(i, *plain_report(i, t, i is not None)) for i, t, *_ in rows]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    whole = {r.doc_id: r.collapsed for r in runs.run_report(docs, texts=True).collect()}
    assert whole[4] == "a" and whole[6].startswith("x a b c y\x1cz") and whole[0] == ""
    assert runs.run_report(docs.where("false")).collect() == []


def test_run_query_on_the_table(spark, data):
    got = {r.doc_id: tuple(r[f] for f in FIELDS) for r in queries.op11_runs(spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").where("length(text) < 3000").select("doc_id", "text").collect()
    assert len(docs) > 50 and all(got[d.doc_id] == plain_report(d.doc_id, d.text) for d in docs)


# chat


def plain_chat(turns):
    state, bad = "start", None
    moves = chat.Template().moves
    for i, (role, _) in enumerate(turns):
        state = moves.get((state, role))
        if state is None and bad is None:
            bad = i
    return state == "answered", bad


def test_chat_reads_back_what_was_put_in(spark):
    rng = random.Random(3)
    bits = ["### Assistant:", "### User: ", "</turn>", "\n</turn>\n", "\\", "\\\\", "### Other ", "### ", "<", "</turn", "a", " ", "\n", "é日", "$1", ""]
    roles = ["system", "user", "assistant", "tool: x\n### User: ", "", None]
    rows, want = [], {}
    for c in [*range(120), None]:
        n = rng.randint(1, 6)
        good = rng.random() < 0.5
        turns = [(rng.choice(roles) if not good else ("user", "assistant")[k % 2], rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))])) for k in range(n)]
        want[c] = [(r or "", t or "") for r, t in turns]
        rows += [(c, k, r, t, "x", 0) for k, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments string, n_turns int")
    got = chat.read_back(chat.formatted(table)).collect()
    assert len(got) == len(want)
    pattern = chat.Template().pattern
    for r in got:
        turns = want[r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == turns and r.n_turns == len(turns)
        assert r.loss_text == "".join(t for role, t in turns if role == "assistant")
        assert (r.valid, r.first_bad) == plain_chat(turns)
        assert "".join(s.text for s in r.segments) == r.formatted
        # but for the marks themselves no control string stands without a backslash
        assert len(re.findall(rf"(?<!\\){pattern}", r.formatted)) == 2 * len(turns)
    assert chat.formatted(table.where("false")).collect() == []


def test_chat_keeps_ties_and_repeated_rows(spark):
    table = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "user", "z")], "conv_id long, turn long, role string, text string")
    (r,) = chat.read_back(chat.formatted(table)).collect()
    assert [t.text for t in r.turns] == ["z", "a", "a", "b"] and not r.valid and r.first_bad == 1


def test_chat_of_one_very_long_text(spark):
    text = "</turn>\\ ### User: " * 60_000
    table = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    (r,) = chat.read_back(chat.formatted(table)).collect()
    assert r.turns[0].text == text and r.loss_text == text


@pytest.mark.parametrize("marks", [{"end": "### User:"}, {"end": "r:x"}, {"end": "a\\b"}, {"end": ""}, {"end": "aba"}, {"other": "x ### User: "}])
def test_template_refuses_marks_that_overlap(marks):
    with pytest.raises(ValueError):
        chat.Template(**marks)


# vector codes


def plain_codes(rows, parts=4, entries=256, rounds=4):
    kept = sorted((i, v, label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v))
    vectors = np.floor(np.array([v for _, v, _ in kept], float) * 1024).astype(np.int64)
    own = np.split(vectors, parts, 1)
    books = [x[:entries].copy() for x in own]

    def assign():
        far = [((x[:, None, :] - b[None]) ** 2).sum(2) for x, b in zip(own, books)]
        return [f.argmin(1) for f in far], sum(f.min(1) for f in far)

    for _ in range(rounds):
        code, _ = assign()
        for b, x, c in zip(books, own, code):
            for k in set(c.tolist()):
                b[k] = x[c == k].sum(0) // (c == k).sum()
    code, error = assign()
    return {i: ([int(c[k]) for c in code], int(error[k])) for k, (i, _, _) in enumerate(kept)}, books


@pytest.mark.parametrize("count", [1, 40, 700])
def test_vector_codes(spark, count):
    rng = np.random.default_rng(count)
    few = rng.integers(-3, 4, (30, 8)) / 2
    rows = [(i, few[rng.integers(30)].tolist() if i % 3 else rng.normal(0, 2, 8).round(3).tolist(), int(i % 4) or None) for i in range(count)]
    rows += [(9001, None, 1), (9002, [1.0] * 7 + [None], 1), (9003, [float("nan")] * 8, 1), (9004, [float("inf")] + [0.0] * 7, 2)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "'x' AS code", "1 AS row")
    books = codes.fitted(table)
    want, own = plain_codes(rows)
    assert all((a == b).all() for a, b in zip(books.books, own))
    got = codes.coded(table, books)
    assert got.columns == ["vec_id", "embedding", "label", "row", "code", "error"]
    assert {r.vec_id: (r.code, r.error) for r in got.collect()} == want
    near = got.select("embedding", codes.decoded(got.code, books).alias("v"), "error").collect()
    assert all(abs(sum((1024 * (a - b)) ** 2 for a, b in zip(r.embedding, r.v)) ** 0.5 - r.error**0.5) < 3 for r in near)


def test_tree_takes_the_lowest_of_equals():
    rng = np.random.default_rng(2)
    for size in (1, 2, 9, 256):
        points = rng.integers(-2, 3, (size, 4))
        asked = rng.integers(-4, 5, (500, 4))
        far = ((asked[:, None] - points[None]) ** 2).sum(2)
        index, best = codes.KdTree(points).nearest(asked)
        assert (index == far.argmin(1)).all() and (best == far.min(1)).all()


def test_vectors_that_have_no_code(spark):
    rows = [(None, [0.5] * 4), (3, []), (4, [1.0] * 4), (5, [1.0] * 3), (6, [1e30, 0.0, 0.0, 0.0]), (4, [1.0] * 4)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    books = codes.fitted(table)
    got = sorted(((r.vec_id, r.code, r.error) for r in codes.coded(table, books).collect()), key=str)
    assert [b.shape for b in books.books] == [(2, 1)] * 4  # both rows of vec_id 4 begin the codebooks
    assert [r for r in got if r[0] in (3, 5, 6)] == [(3, None, None), (5, None, None), (6, None, None)]
    assert [r[1] for r in got if r[0] == 4] == [[1] * 4] * 2 and [r[1] for r in got if r[0] is None] == [[0] * 4]
    nothing = table.where("false")
    assert codes.fitted(nothing) is None and codes.coded(nothing, None).collect() == []

"""Quality rules, personal data, toxicity and language-model scores."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import ctw, pii, quality, queries, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, spans string, kept string, n_words string, held string"


def table(spark, texts):
    rows = [(i, t, None, None, len(t) if t else None, "r", "s", "k", "w", "h") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = collections.Counter(windows)
    covered = {k for i, w in enumerate(windows) if often[w] > 1 for k in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def quality_texts():
    rng = random.Random(2)
    texts = [None, "", " \t\n", "a", "é" * 40, "x " * 30, "word. " * 7, "A fine line of plain words that ends here.\n" * 3]
    for _ in range(80):
        words = [rng.choice(["a", "bb", "#c", "d|", "é", "f."]) for _ in range(rng.randint(1, 80))]
        texts.append("".join(w + rng.choice([" ", "  ", "\n", "\t", "\x0b"]) for w in words))
    return texts


def test_quality_counts_match_brute_force(spark):
    texts = quality_texts()
    got = {r.doc_id: r for r in quality.judged(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r, want = got[i], counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.kept and r.base_failed)


def test_quality_verdicts(spark):
    clean = "\n".join(f"Line{i} says thing{i} of a text{i}, and then it adds{i} its own number{i} here." for i in range(8))
    menu = "\n".join(f"Home | About{i} | News | Contact | Imprint | Login | Search | Help{i}" for i in range(8))
    marks = " ".join(f"word{i}### other{i}$$$" for i in range(40)) + "."
    stutter = " ".join(f"w{i} " * 6 for i in range(12)) + "."
    docs = table(spark, [clean, menu, marks, stutter, clean + "\nAll rights reserved."])
    got = {r.doc_id: r for r in quality.judged(docs).collect()}
    assert [got[i].kept for i in range(5)] == [True, False, False, False, True]
    assert got[4].clean_text == clean
    kept = quality.kept(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 4]
    assert [r.kept for r in kept.collect()] == ["k", "k"]


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group(0))
            good = {"email": True, "ip": all(int(p) <= 255 for p in m.group(0).split(".")) if kind == "ip" else False, "card": 14 <= len(digits) <= 19 and luhn(digits or "0"), "phone": 10 <= len(digits) <= 15}
            if good[kind]:
                out.append((m.start(), rank, m.end()))
    return [f"{list(BASE)[k]}:{a}:{b}" for a, k, b in sorted(out)]


def test_base_spans_match_brute_force(spark):
    rng = random.Random(4)
    bits = ["a@b.co", "x@y", ".", " ", "@", "1.2.3.4", "001.02.3.255", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (234) 555-6789", "+", "9", "é😀", "-", "12", "%c@d.e.f", "\n", "1.2.3.4.5.6.7.8"]
    texts = [None, "", "7" * 60, "a" * 5000 + "@" + "b" * 50 + ".c", "+1" + "(" * 300]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(400)]
    docs = table(spark, texts)
    got = {r.doc_id: r.s for r in pii.found_spans(docs, pii.Model(weights=[0.0] * 6)).select("doc_id", pii.span_list(F.filter("spans", lambda s: s["base"])).alias("s")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == ",".join(base_spans(t)), t


def test_learned_spans_and_redaction(spark):
    texts = [f'Server text {i}: token = "{hashlib.sha1(str(i).encode()).hexdigest()}" and mail me.{i}@host{i}.com or +1 (202) 555-01{i:02d} now' for i in range(40)]
    docs = table(spark, texts + [None, "", "nothing to see"])
    model = pii.learn(docs)
    out = {r.doc_id: r for r in pii.redacted(docs, model).collect()}
    assert out[0].text == "Server text 0: [SECRET] and mail [EMAIL] or [PHONE] now"
    assert out[0].n_chars == len(out[0].text) and out[0].spans == "s"
    assert out[40].text is None and out[41].text == "" and out[42].text == "nothing to see"
    assert pii.redacted(docs, model).columns == docs.columns
    empty = docs.where("false")
    assert pii.redacted(empty).collect() == []


def test_added_kinds_on_a_labelled_sample(spark):
    """Recall and precision of the kinds that the classifier adds, among look-alikes that are none."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9)))
    some = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    mixed = "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789"
    texts, want = [], set()
    for i in range(600):
        kind = ("secret", "ssn", "iban", None)[i % 4]
        if kind == "secret":
            span = f'{rng.choice(["api_key", "token", "password"])} = "{some(30, mixed)}7a"'
            near = "config of the server"
        elif kind == "ssn":
            span, near = f"{rng.randint(100, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}", "social security number"
        elif kind == "iban":
            span, near = f"DE{rng.randint(10, 99)} {' '.join(str(rng.randint(1000, 9999)) for _ in range(4))} {rng.randint(10, 99)}", "the bank account iban"
        else:
            span, near = rng.choice([("order 000-00-0000", "version"), ("token: aaaaaaaaaaaa", "a word"), (f"part {some(3, '0123456789')}-{some(4, '0123456789')}", "number")])
        left = f"{' '.join(word() for _ in range(rng.randint(3, 30)))} {near} "
        start = len(left)
        texts.append(f"{left}{span} and {word()} {word()}")
        if kind:
            want.add((i, kind, start, start + len(span)))
    found = pii.found_spans(table(spark, texts))
    got = {(r.doc_id, pii.KINDS[x["rank"]], x["from"], x["to"]) for r in found.collect() for x in r.spans if x["rank"] >= 4}
    for kind in ("secret", "ssn", "iban"):
        mine, real = {g for g in got if g[1] == kind}, {w for w in want if w[1] == kind}
        assert len(mine & real) >= 0.9 * len(real) and len(mine & real) >= 0.9 * len(mine), (kind, len(mine), len(real), len(mine & real))


def test_look_alikes_are_left_alone(spark):
    """All seven kinds among numbers, names and addresses that look like them: precision and recall of each by span."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9)))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def checked(n, good):
        """n digits of which the last is, or is not, the check digit."""
        while True:
            d = rng.choice("45") + digits(n - 1)
            if (sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0) == good:
                return d

    def grouped(d):
        return " ".join(d[i : i + 4] for i in range(0, len(d), 4))

    mixed = "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789"
    real = {
        "email": lambda: f"{word()}.{word()}@{word()}.com",
        "ip": lambda: ".".join(str(rng.randint(1, 254)) for _ in range(4)),
        "card": lambda: rng.choice([str, grouped])(checked(16, True)),
        "phone": lambda: f"+1 ({rng.randint(201, 989)}) 555-{digits(4)}",
        "secret": lambda: 'api_key = "' + "".join(rng.choice(mixed) for _ in range(32)) + '7a"',
        "ssn": lambda: f"{rng.randint(100, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}",
        "iban": lambda: f"DE{rng.randint(10, 99)} {' '.join(str(rng.randint(1000, 9999)) for _ in range(4))} {rng.randint(10, 99)}",
    }
    alike = [
        lambda: checked(16, False),
        lambda: grouped(checked(16, False)),
        lambda: checked(15, False),
        lambda: f"{rng.randint(1, 9)}.{rng.randint(256, 999)}.{rng.randint(0, 99)}.{rng.randint(256, 999)}",
        lambda: f"+{digits(4)}-{digits(3)}",
        lambda: f"000-{digits(2)}-{digits(4)}",
        lambda: f"{word()}@{word()}",
        lambda: f"token: {word()}",
        lambda: digits(rng.randint(5, 12)),
    ]
    texts, want, none = [], {}, set()
    for i in range(1400):
        kind = (*real, None, None)[i % 9]
        left = " ".join(word() for _ in range(rng.randint(3, 30))) + " "
        span = real[kind]() if kind else rng.choice(alike)()
        texts.append(f"{left}{span} and {word()} {word()}")
        if kind:
            want[i] = (kind, len(left), len(left) + len(span))
        else:
            none.add(i)
    found = {r.doc_id: {(pii.KINDS[x["rank"]], x["from"], x["to"]) for x in r.spans} for r in pii.found_spans(table(spark, texts)).collect()}
    assert not [texts[i] for i in none if any(k == "card" for k, _, _ in found[i])]
    for kind in real:
        mine = {(i, f) for i, fs in found.items() for f in fs if f[0] == kind}
        own = {(i, w) for i, w in want.items() if w[0] == kind}
        assert len(mine & own) >= 0.9 * len(own) and len(mine & own) >= 0.9 * len(mine), (kind, len(mine), len(own), len(mine & own))


def test_no_card_without_its_check_digit(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    spans = pii.found_spans(docs).select("doc_id", "text", F.explode("spans").alias("s")).where(F.col("s.rank") == pii.KINDS.index("card"))
    for r in spans.collect():
        number = [int(c) for c in r.text[r.s["from"] : r.s["to"]] if c.isdigit()]
        assert sum(sum(divmod(d * (1 + i % 2), 10)) for i, d in enumerate(reversed(number))) % 10 == 0


def test_many_spans_in_one_text(spark):
    """Places and pieces of thousands of spans, across the blocks that they are summed up in."""
    text = " ".join(f"u{i}@h{i}.org, 10.0.{i % 256}.{i % 99}" for i in range(1500))
    docs = table(spark, [text])
    (r,) = pii.found_spans(docs, pii.Model(weights=[0.0] * 6)).collect()
    got = {(pii.KINDS[x["rank"]], x["from"], x["to"]) for x in r.spans if x["base"]}
    assert got >= {(k, m.start(), m.end()) for k, p in (("email", r"u\d+@h\d+\.org"), ("ip", r"10\.0\.\d+\.\d+")) for m in re.finditer(p, text)}
    (r,) = pii.redacted(docs, pii.Model(weights=[0.0] * 6)).collect()
    assert r.text == " ".join(["[EMAIL], [IP]"] * 1500)


def test_toxicity_learns_stems_and_words(spark):
    rng = random.Random(7)
    plain = [f"plain{i}" for i in range(200)]
    rows = []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(30)]
        bad = i % 6 == 0
        if bad:
            words[3:5] = [f"vilest{rng.randint(0, 10**6)}", "idiot" if i % 12 else f"vilest{rng.randint(0, 10**6)}"]
        rows.append((i, " ".join(words), int(bad)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(600, None), (601, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.classified(docs, labels).collect()}
    assert len(got) == 602
    for i, _, y in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert got[i].predicted == y == int(got[i].score >= 0.3)
    assert got[600].score == got[601].score < 0.3
    assert toxicity.classified(docs.where("false"), labels).collect() == []
    assert toxicity.classified(docs, labels.where("false")).count() == 602


def test_toxicity_of_held_out_rows(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    found = queries.op3_toxicity(spark, data)
    assert found.count() == docs.count()


def slow_tree(streams, depth):
    """Log10 probabilities by a context-tree built node by node from byte streams."""
    seen = collections.defaultdict(lambda: [0, 0])

    def steps(data):
        for i, byte in enumerate(data):
            context = (b"\n" * depth + data[:i])[-depth:]
            for k in range(8):
                yield context, (1 << k) | (byte >> (8 - k)), byte >> (7 - k) & 1

    for data in streams:
        for context, node, bit in steps(data):
            for d in range(depth + 1):
                seen[context[depth - d :], node][bit] += 1

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    below = collections.defaultdict(list)
    for context, node in seen:
        if context:
            below[context[1:], node].append((context, node))
    weight, total = {}, {}
    for key in sorted(seen, key=lambda k: -len(k[0])):
        own = kt(*seen[key])
        if len(key[0]) == depth:
            total[key], weight[key] = own, 1.0
        else:
            rest = sum(total[c] for c in below[key])
            total[key] = math.log(0.5) + max(own, rest) + math.log1p(math.exp(-abs(own - rest)))
            weight[key] = math.exp(math.log(0.5) + own - total[key])

    def score(data):
        out = 0.0
        for context, node, bit in steps(data):
            acc, rem, p = 0.0, 1.0, 0.5
            for d in range(depth + 1):
                key = (context[depth - d :], node)
                if key not in weight:
                    break
                a, b = seen[key]
                one = (b + 0.5) / (a + b + 1)
                p, acc, rem = acc + rem * one, acc + rem * weight[key] * one, rem * (1 - weight[key])
            out += math.log10(p if bit else 1 - p)
        return out

    return score


@pytest.mark.parametrize(("most_common", "most_grams"), [(0, 0), (5, 300), (100_000, 1_000_000)])
def test_context_tree_matches_brute_force(spark, most_common, most_grams):
    rng = random.Random(9)
    texts = [None, "", "  ", "Ünï CODE ünï"] + [" ".join(rng.choice(["the", "then", "THEM", "a", "é", f"x{i}"]) for _ in range(rng.randint(1, 9))) for i in range(40)]
    words = {i: [w.encode() for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group(0).lower(), t or "")) if w] + [b"\n"] for i, t in enumerate(texts)}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in words}
    count = collections.Counter(w for i, ws in words.items() if not held[i] for w in ws)
    streams = {i: b"".join(w + b" " * (w != b"\n") for w in ws) for i, ws in words.items()}
    total, score = sum(count.values()), slow_tree([streams[i] for i in words if not held[i]], ctw.DEPTH)
    got = {r.doc_id: r for r in ctw.scored(table(spark, texts), most_common=most_common, most_grams=most_grams).collect()}
    for i, ws in words.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(count[w] > 0 for w in ws), total)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (total + len(count) + 1)) for w in ws), abs_tol=1e-9)
        assert math.isclose(r.score, score(streams[i]), rel_tol=1e-7)
        assert math.isclose(r.code_length, -r.score * math.log2(10) / len(streams[i]), rel_tol=1e-9)
    assert ctw.scored(table(spark, texts).where("false")).collect() == []
    assert {r.n_tokens for r in ctw.scored(table(spark, [None, "", " "])).collect()} == {1}


def test_context_tree_minds_the_order_of_words(spark):
    rng = random.Random(3)
    vocabulary = [f"{rng.choice('bdfgklm')}{rng.choice('aeiou')}{rng.choice('nrst')}{k}" for k in range(40)]
    fixed = {w: rng.choice(vocabulary) for w in vocabulary}  # each word calls for one other

    def text():
        out = [rng.choice(vocabulary)]
        while len(out) < 60:
            out.append(fixed[out[-1]] if rng.random() < 0.9 else rng.choice(vocabulary))
        return out

    words = [text() for _ in range(120)]
    texts = [" ".join(w) for w in words]
    texts += [" ".join(rng.sample(w, len(w))) for w in words]
    docs = spark.createDataFrame([(i if i < 120 else 1000 + 7 * i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    score = {r.doc_id: r.score for r in ctw.scored(docs.where("doc_id < 120")).collect()}
    both = {r.doc_id: r.score for r in ctw.scored(docs).collect()}
    held = [i for i in range(120) if zlib.crc32(str(i).encode()) % 7 == 2]
    assert held and all(both[i] > both[1000 + 7 * (120 + i)] for i in range(120))
    assert len(score) == 120

"""Ids, chunks, targets and shards against plain loops."""

import json
import os
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import tokens as T
from tidemark.operators import sequences as S
from tidemark.plans.tokens import codec
from tidemark.sources import shards

BOS, EOS, ASKS, ENDS_ASK, OPENS, CLOSES, THINKS, CONCLUDES = range(1, 9)
CHAT = (BOS, EOS, ASKS, OPENS, CLOSES, THINKS, CONCLUDES)


def plain_targets(ids):
    """One place after another: 'target', 'prompt' or None."""
    out, start, inside, seen, chat = [], 0, False, False, False
    for t, i in enumerate(ids):
        if t == 0 or i == BOS or ids[t - 1] == EOS:
            start, inside, seen = t, False, False
            stop = next((u for u in range(t + 1, len(ids)) if ids[u] == BOS or ids[u - 1] == EOS), len(ids))
            chat = OPENS in ids[t:stop]
        if t == start:
            out.append(None)
        elif not chat:
            out.append("target")
        elif i == OPENS:
            inside = seen = True
            out.append("prompt")
        elif inside:
            out.append("target")
            inside = i != CLOSES
        else:
            out.append("target" if i == EOS and seen else "prompt")
    return out


def test_targets_are_those_of_a_loop():
    rng = random.Random(8)
    rows = [[rng.choice([BOS, EOS, OPENS, CLOSES, 20, 21]) for _ in range(rng.randint(0, 14))] for _ in range(3000)]
    flat, sizes = np.array([i for r in rows for i in r], np.int32), np.array([len(r) for r in rows])
    wanted, prompt = T.target_mask(flat, sizes, (BOS, EOS, OPENS, CLOSES))
    got = ["target" if w else "prompt" if p else None for w, p in zip(wanted, prompt)]
    assert got == [x for r in rows for x in plain_targets(r)]


def plain_chunks(ids, most):
    """Answers one by one, their pieces taken off the front while too much is left for a last chunk."""
    out, cursor = [], 0
    while OPENS in ids[cursor:]:
        a = ids.index(OPENS, cursor)
        end = ids.index(CLOSES, a) if CLOSES in ids[a:] else len(ids)
        context = None
        for u in range(a - 1, -1, -1):
            if ids[u] == CLOSES:
                break
            if ids[u] == ASKS:
                context = ids[u:a]
                break
        if context is None:
            context = ids[1:a] if ids[0] == BOS else ids[:a]
        budget = most - 7
        if len(context) > budget:
            if context[0] == ASKS:
                tail = context[-(budget - 1) :]
                context = tail if tail[0] == ASKS else [ASKS, *tail]
            else:
                context = context[-budget:]
        head, body, tail = [BOS, *context, OPENS], ids[a + 1 : end], [CLOSES, EOS]
        if body and body[0] == THINKS and CONCLUDES in body:
            stop = body.index(CONCLUDES)
            other = [CONCLUDES, *body[stop + 1 :], CLOSES, EOS]
            if most - len(head) - 1 - len(other) >= 0:
                head, body, tail = [*head, THINKS], body[1:stop], other
        while len(body) > most - len(head) - len(tail):
            take = min(most - len(head), len(body) - (most - len(head) - len(tail)))
            out.append(head + body[:take])
            body = body[take:]
        out.append(head + body + tail)
        cursor = end + 1
    return out


def test_chunks_are_those_of_a_loop():
    rng = random.Random(9)
    for _ in range(2000):
        ids = [BOS]
        for _ in range(rng.randint(0, 4)):
            if rng.random() < 0.8:
                ids += [ASKS, *[rng.randint(20, 25) for _ in range(rng.randint(0, 20))], ENDS_ASK]
            if rng.random() < 0.9:
                body = [rng.randint(20, 25) for _ in range(rng.randint(0, 40))]
                if rng.random() < 0.5:
                    body = [THINKS, *body, CONCLUDES, *[rng.randint(20, 25) for _ in range(rng.randint(0, 12))]]
                ids += [OPENS, *body, CLOSES]
        ids += [EOS] * (rng.random() < 0.8)
        most = rng.randint(12, 30)
        got = [c.tolist() for c in T.chunked_chat(np.array(ids, np.int32), CHAT, most)]
        assert got == plain_chunks(ids, most) and all(len(c) <= most for c in got)


def test_codec(spark):
    own = codec()
    texts = ["", None, "<bos>\n<user>\nhi</user> there\n<eos>", "é日本 <|endoftext|> <think", "a<pad>b"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = rows.select("id", own.encode(F.col("text")).alias("ids"), own.encode(F.col("text"), bos=True, eos=True).alias("more")).orderBy("id")
    found = got.collect()
    assert found[0].ids == found[1].ids == [] and found[0].more == [own.id("<bos>"), own.id("<eos>")]
    assert found[2].ids[0] == own.id("<bos>") and found[2].ids[-1] == own.id("<eos>") and own.id("</user>") in found[2].ids
    back = got.select(own.decode(F.col("ids")).alias("t"), own.decode(F.col("ids"), marks=False).alias("bare")).collect()
    assert [r.t for r in back] == ["", "", texts[2], texts[3], "ab"]
    assert back[2].bare == "\n\nhi there\n"
    assert own.decode_all([[own.size - 1]]) == ["</invalidation>"]
    with pytest.raises(ValueError):
        own.decode_all([[own.size]])
    assert own.fingerprint() != T.Codec(own.path, own.marks[:-1]).fingerprint() and len(own.fingerprint()) == 16


def test_ids_are_those_of_the_library():
    from tokenizers import Tokenizer

    own = codec()
    library = Tokenizer.from_file(own.path)
    library.encode_special_tokens = True
    rng = random.Random(7)
    bits = [" ", "  ", "\n", "\t", "a", "bc", "é", "\xa0", "\u3000", "'s", "1", ".", "Z ", "\x1c", "\x85", "日", "<|endoftext|>", "\r\n", "İ", "word", " '", " 's"]
    texts = ["", " ", "\n"] + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    for t, ids in zip(texts, own.encode_all(texts)):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
        assert own.decode_all([ids]) == [t]
    wordy = T.Codec(own.path.replace("byte_bpe_50k", "word_bpe_49k"))  # not byte-level: nothing is cut
    other = Tokenizer.from_file(wordy.path)
    for t, ids in zip(texts[:300], wordy.encode_all(texts[:300])):
        other.encode_special_tokens = True
        assert ids.tolist() == other.encode(t, add_special_tokens=False).ids


def test_windows_and_stream_chunks(spark):
    rng = random.Random(3)
    docs = [(i * 7, [rng.randint(0, 50) for _ in range(rng.choice([0, 1, 5, 30, 200]))]) for i in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, ids array<int>")
    for size, stride in ((8, 4), (16, 16), (10, 3)):
        stream = [x for _, ids in docs for x in ids]
        want = []
        while len(stream) >= size + 1:
            want.append(stream[: size + 1])
            stream = stream[stride:]
        if len(stream) > 1:
            want.append(stream + [99] * (size + 1 - len(stream)))
        got = [r.ids for r in S.stream_chunks(frame, size, stride, 99).orderBy("chunk").collect()]
        assert got == want
        for r in frame.where("size(ids) >= 2").select("ids", S.windows(F.col("ids"), size).alias("w")).collect():
            assert r.w[0][0] == r.ids[0] and [x for w in r.w for x in w[1:]] == r.ids[1:] and all(2 <= len(w) <= size + 1 for w in r.w)
    assert S.stream_chunks(frame.where("false"), 8, 4, 99).collect() == []


class Ids:
    """A codec of small numbers."""

    size = 100

    def fingerprint(self):
        return "0123456789abcdef"


def a_table(spark, n, length=5):
    return spark.range(n).select(F.col("id").alias("chunk"), F.transform(F.sequence(F.lit(0), F.lit(length)), lambda i: ((F.col("id") * 7 + i) % 100).cast("int")).alias("ids"))


def test_shards_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    shards.write_shards(a_table(spark, 100), path, Ids(), 5, 5, per_shard=9)
    names = json.load(open(tmp_path / "s/manifest.json"))["splits"]["train"]
    assert sorted(os.listdir(tmp_path / "s")) == ["manifest.json", *names] and names[0] == "train_00001.bin"
    raw = open(tmp_path / "s" / names[0], "rb").read()
    assert raw[:4] == b"VST1" and struct.unpack("<III", raw[4:16]) == (9, 5, 100) and struct.unpack("<6H", raw[16:28]) == (0, 1, 2, 3, 4, 5)
    rows = shards.read_shards(spark, path).orderBy("shard", "chunk").collect()
    assert [r.x[0] for r in rows] == [7 * i % 100 for i in range(100)] and all(r.x[1:] == r.y[:-1] for r in rows)
    shards.write_shards(a_table(spark, 10), path, Ids(), 5, 5, split="validation")
    shards.write_shards(a_table(spark, 10), path, Ids(), 5, 5, split="validation")
    assert shards.read_shards(spark, path, "validation").count() == 20 and shards.read_shards(spark, path).count() == 120
    assert [r.ok for r in shards.verified(spark, path, Ids(), 5).collect()] == [True] * (len(names) + 2)
    shards.write_shards(a_table(spark, 3), path, Ids(), 5, 5, mode="overwrite")
    assert shards.read_shards(spark, path).count() == 3 and len(os.listdir(tmp_path / "s")) == 2
    shards.write_shards(a_table(spark, 0), path, Ids(), 5, 5, split="none")
    assert shards.read_shards(spark, path, "none").count() == 0


def test_shards_refuse_what_is_wrong(spark, tmp_path):
    path = str(tmp_path / "s")
    with pytest.raises(FileNotFoundError):
        shards.verified(spark, path, Ids())
    shards.write_shards(a_table(spark, 4), path, Ids(), 5, 5)
    for table in (a_table(spark, 4, 6), a_table(spark, 4).withColumn("ids", F.transform("ids", lambda i: i + 95))):
        with pytest.raises(Exception, match="chunk has not|not between"):
            shards.write_shards(table, path, Ids(), 5, 5)
    assert sorted(f for f in os.listdir(path) if f.startswith("_")) == []  # what failed left nothing
    with pytest.raises(Exception, match="another length"):
        shards.write_shards(a_table(spark, 4, 6), path, Ids(), 6, 6)
    name = json.load(open(f"{path}/manifest.json"))["splits"]["train"][0]
    raw = open(f"{path}/{name}", "rb").read()
    for damaged, message in ((b"XXXX" + raw[4:], "no token shard"), (raw[:-2], "bytes"), (raw[:10], "header")):
        open(f"{path}/{name}", "wb").write(damaged)
        with pytest.raises(Exception, match=message):
            shards.read_shards(spark, path).collect()
        bad = [r for r in shards.verified(spark, path, Ids()).collect() if not r.ok]
        assert len(bad) == 1 and bad[0].shard == name
    os.remove(f"{path}/{name}")
    assert sum(not r.ok for r in shards.verified(spark, path, Ids()).collect()) == 1

    class Other(Ids):
        def fingerprint(self):
            return "f" * 16

    assert {r.reason for r in shards.verified(spark, path, Other()).collect()} == {"another tokenizer"}


def plain_bins(docs, size, run):
    out, bin_, used, before = [], -1, 0, None
    for doc, n in docs:
        if doc // run != before:
            before, bin_, used = doc // run, -1, 0
        if bin_ >= 0 and used + n <= size and n <= size:
            used += n
        else:
            bin_, used = bin_ + 1, n
        out.append((doc // run, bin_, doc))
    return out


def test_example_sequences(spark):
    own = codec()
    m = own.id
    rng = random.Random(5)
    docs = []
    for i in range(120):
        n = rng.choice([1, 4, 10, 60])
        text = [rng.randint(0, 999) for _ in range(n)]
        chat = [m("<user>"), 5, m("</user>"), m("<assistant>"), *text, m("</assistant>")]
        docs.append((i, [m("<bos>"), *(chat if i % 3 == 0 else text), m("<eos>")] if i % 11 else [7]))
    frame = spark.createDataFrame(docs, "doc_id long, ids array<int>")
    rows = S.example_sequences(frame, own, 20, run=16).collect()
    kept = [(i, ids) for i, ids in docs if len(ids) >= 2]
    bins = {}
    for run, bin_, doc in plain_bins([(i, len(ids)) for i, ids in kept], 21, 16):
        bins.setdefault((run, bin_), []).append(doc)
    by_id = dict(kept)
    got = {}
    for r in rows:
        assert 2 <= len(r.ids) <= 21 and [x.doc_id for x in r.members] == bins[r.run, r.bin]
        got.setdefault((r.run, r.bin), []).append((r.part, r.ids))
    for key, ids_of in bins.items():
        parts = [ids for _, ids in sorted(got[key])]
        if len(ids_of) > 1 or len(by_id[ids_of[0]]) <= 21:
            assert parts == [[x for d in ids_of for x in by_id[d]]]
        elif m("<assistant>") in by_id[ids_of[0]]:
            assert all(p[0] == m("<bos>") for p in parts) and parts[-1][-1] == m("<eos>")
        else:
            assert [x for p in parts for x in p[1:]] == by_id[ids_of[0]][1:]


def test_frequent_pieces_outlive_a_full_cache(monkeypatch):
    """What the last texts had is not encoded anew when the cache of pieces is full, and words that go to the model alone have the library's ids."""
    from tidemark.functions import tokens

    monkeypatch.setattr(tokens, "KEPT", 40)
    library = tokens._Library(codec().path)
    whole, seen = library.tokenizer, []

    class Counted:
        model = whole.model

        def encode_batch(self, texts, **how):
            seen.extend(texts)
            return whole.encode_batch(texts, **how)

    library.tokenizer = Counted()
    for k in range(20):
        text = "start it's (so) " + " ".join(f"(so) q{chr(97 + i)}{chr(97 + k)} été{k} x{i}" for i in range(26))
        assert library.encode([text])[0].tolist() == whole.encode(text, add_special_tokens=False).ids
    assert seen.count(" (so)") == 1 and not any(x[1:].isalpha() and x.isascii() for x in seen if x[0] == " ")

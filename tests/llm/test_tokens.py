"""Encoding, packing, the token store and SentencePiece against the libraries."""

import random
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import packing, pieces, store, tokens
from tidemark.llm.common import tokenizer_path

BITS = [" ", "  ", "\n", "\t", "a", "bc", "é", "\xa0", "　", "'s", "1", ".", ",", "à", "Z ", "\x1c", "\x85", "日", "<|endoftext|>", "\r\n", "<|ENDoftext|>", "́", "Σ", "İ", "ß", "Éa", "ŉ", "word", "▁"]


def some_texts(n, seed=1):
    rng = random.Random(seed)
    return [None, "", " ", "\n"] + ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 10))) for _ in range(n)]


def table(spark, texts):
    rows = [(i * 3, t, None, "s", 0, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids string, sequence_id int")


@pytest.mark.parametrize(("kind", "name"), [(tokens.BlankEncoder, "byte_bpe_50k.json"), (tokens.WordEncoder, "word_bpe_49k.json")])
def test_chunks_give_the_library_ids(kind, name):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(tokenizer_path(name)), kind(tokenizer_path(name), "I")
    texts = [t or "" for t in some_texts(4000)]
    found = own.batch(pa.array([t.encode() for t in texts], pa.binary()))
    for t, ids in zip(texts, found):
        assert list(array("I", ids)) == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_packing_is_whole_and_within_capacity(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    texts = some_texts(60) + ["long text here " * 90]
    rows = packing.packed(table(spark, texts), tokenizer_path("word_bpe_49k.json"), length=32).toPandas()
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        mine = rows[rows.doc_id == 3 * i].sort_values("piece")
        want = [ids[k : k + 32] for k in range(0, len(ids), 32)]
        assert list(mine.length) == list(map(len, want)) and list(mine.start) == [32 * k for k in range(len(want))]
        assert list(mine.ids_crc32) == [zlib.crc32(np.array(w, "<u4").tobytes()) for w in want]
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert list(s.offset) == list(s.length.cumsum() - s.length) and s.length.sum() <= 32
    assert rows.sequence_id.nunique() <= 1.05 * rows.length.sum() / 32 + 1


def test_every_capacity_holds():
    rng = np.random.default_rng(0)
    lengths = np.sort(rng.integers(1, 100, 500))[::-1]
    bins, offsets = packing.best_fit(lengths, (100, 3, 6000), (1.0, 0.5, 0.5))
    for b in np.unique(bins):
        own = lengths[bins == b]
        assert own.sum() <= 100 and len(own) <= 3 and (len(own) == 1 or (own.astype(float) ** 2).sum() <= 6000)


def test_packing_beside_columns_of_its_own_names(spark):
    rows = [(i, 0, 3 + i % 5, "x", "y", 7, i % 3) for i in range(30)] + [(0, 0, 3, None, None, None, None)]
    parts = spark.createDataFrame(rows, "doc_id long, piece int, length long, sequence_id string, offset string, shard int, __shard int")
    got = packing.pack(parts, 10, per_shard=8).toPandas()
    assert list(got.columns) == ["doc_id", "piece", "length", "shard", "__shard", "sequence_id", "offset"] and len(got) == 31
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert list(s.offset) == list(s.length.cumsum() - s.length) and s.length.sum() <= 10
    assert packing.pack(parts.where("false"), 10).collect() == []


def test_store_round_trip(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    rng = random.Random(5)
    passage = " ".join(f"word{rng.randint(0, 999)}" for _ in range(400))
    texts = some_texts(60) + [passage, passage + " end", "start " + passage, passage]
    docs = table(spark, texts).orderBy(F.desc("doc_id"))
    made = store.TokenStore(spark).write(docs, tokenizer_path("byte_bpe_50k.json"), per_part=20)
    back = made.read_back().toPandas().set_index("doc_id")
    ids, start = {r.doc_id: bytes(r.ids) for r in made.read_ids().collect()}, 0
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids + [0]
        r = back.loc[3 * i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        assert np.frombuffer(ids[3 * i], "<u2").tolist() == want
        start += len(want)
    chunks = made.table("chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()
    assert made.table("recipes").select(F.explode("chunks")).count() > chunks.count()
    assert all(r.ok for r in made.verify().collect())
    assert made.read_ids(spark.createDataFrame([(0,), (9,)], "doc_id long")).count() == 2


def test_store_sees_damage(spark):
    made = store.TokenStore(spark).write(table(spark, ["some text", "other text"]), tokenizer_path("byte_bpe_50k.json"))
    wrong = made.table("chunks").withColumn("ids", F.concat("ids", F.unhex(F.lit("0100"))))
    rows = [tuple(r) for r in wrong.collect()]
    spark.createDataFrame(rows, "digest binary, ids binary").write.mode("overwrite").parquet(f"{made.path}/chunks")
    with pytest.raises(Exception, match="digest"):
        made.read_back().collect()


TAMPERED = {
    "chunks reversed": ("recipes", lambda rows: rows.withColumn("chunks", F.when(F.size("chunks") > 2, F.reverse("chunks")).otherwise(F.col("chunks"))), "root"),
    "recipe dropped": ("recipes", lambda rows: rows.where("doc_id <> 0"), "manifest"),
    "recipe renamed": ("recipes", lambda rows: rows.withColumn("doc_id", F.col("doc_id") + 1), "root"),
    "length changed": ("recipes", lambda rows: rows.withColumn("n_tokens", F.col("n_tokens") + 1), "root"),
    "manifest changed": ("manifest", lambda rows: rows.withColumn("n_tokens", F.col("n_tokens") + 1), "manifest"),
    "part dropped": ("manifest", lambda rows: rows.where("part > 0"), "root"),
}


@pytest.mark.parametrize("name", TAMPERED)
def test_store_sees_tampering(spark, name):
    where, change, message = TAMPERED[name]
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randint(0, 9999)}" for _ in range(600)) for _ in range(4)] + ["some text", None]
    made = store.TokenStore(spark).write(table(spark, texts), tokenizer_path("byte_bpe_50k.json"), per_part=2)
    assert made.read_back().count() == 6
    rows = change(made.table(where))
    spark.createDataFrame(rows.collect(), rows.schema).write.mode("overwrite").parquet(f"{made.path}/{where}")
    with pytest.raises(Exception, match=message):
        made.read_back().collect()
    assert name == "length changed" or not all(r.ok for r in made.verify().collect()) or name in ("manifest changed", "part dropped")


def test_store_leaves_out_rows_without_id(spark):
    docs = spark.createDataFrame([(None, "a"), (5, "b"), (-3, None)], "doc_id long, text string")
    rows = store.TokenStore(spark).write(docs, tokenizer_path("byte_bpe_50k.json")).read_back().collect()
    assert sorted((r.doc_id, r.start, r.n_tokens) for r in rows) == [(-3, 0, 1), (5, 1, 2)]


def test_empty_tables(spark):
    docs = table(spark, ["x"]).where("false")
    assert packing.packed(docs, tokenizer_path("word_bpe_49k.json")).collect() == []
    assert store.TokenStore(spark).write(docs, tokenizer_path("byte_bpe_50k.json")).read_back().collect() == []
    assert pieces.encode_documents(docs, tokenizer_path("piece_bpe_32k.model")).collect() == []


def test_pieces_are_the_library_ids(spark):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = some_texts(300) + ["  == ....  aaaa aa", "▁x", "a▁ b", "ab  "]
    rows = pieces.encode_documents(table(spark, texts), path, with_ids=True)
    got = {r.doc_id: r for r in rows.collect()}
    for i, t in enumerate(texts):
        r = got[3 * i]
        assert r.ids == library.encode(t or ""), repr(t)
        assert r.n_ids == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert r.round_trip == ("▁" not in (t or "")), repr(t)
    texts_back = {r.doc_id: r.text for r in pieces.decode_documents(rows.select("doc_id", "ids"), path).collect()}
    assert all(texts_back[3 * i] == (t or "").replace("▁", " ") for i, t in enumerate(texts))


def test_unigram_search_takes_the_best_sum():
    model = pieces.Pieces(tokenizer_path("piece_bpe_32k.model"))
    model.kind = 1
    rng = random.Random(1)
    for _ in range(200):
        text = "▁" + "".join(rng.choice("thisand") for _ in range(rng.randint(1, 8)))
        best = [0.0] + [-1e18] * len(text)
        for j in range(1, len(text) + 1):
            for i in range(j):
                if text[i:j] in model.id:
                    best[j] = max(best[j], best[i] + model.score[model.id[text[i:j]]])
        assert np.isclose(sum(model.score[i] for i in model.encode(text)), best[-1])


def test_new_words_go_to_the_library_together():
    """Words with marks, digits and letters of any kind take few calls, and their ids are those of the whole text."""
    rng = random.Random(31)
    odd = ["{}.", "{},\nAnd", "don't{}", "{}9", "ß{}é", "日本{}", "<|endoftext|>{}", "{}\n\n", "{}\t", "😀{}", "{}!!", "\u00a0{}", "\n{}", "{}" * 90]
    texts = [" ".join(rng.choice(odd).replace("{}", f"w{rng.randrange(10**5)}") for _ in range(400)) for _ in range(20)]
    path = tokenizer_path("byte_bpe_50k.json")
    whole = tokens.Tokenizer.from_file(path)
    made = tokens.BlankEncoder(path, "H")
    calls, encode = [], made.rest.encode_fast
    made.rest.encode_fast = lambda *a, **k: calls.append(1) or encode(*a, **k)
    plain = [t.replace("\u00a0", "x").replace(" \n", " n") for t in texts]
    for some in (plain, texts, plain):
        got = made.batch(pa.array([t.encode() for t in some], pa.binary()))
        assert [np.frombuffer(x, "<u2").tolist() for x in got] == [whole.encode(t, add_special_tokens=False).ids for t in some]
    assert 0 < len(calls) <= 12


LINES = {"words": "\n".join(f"word{i}" for i in range(5000)), "blank lines": "a" + "\n" * 5000 + "b", "after a blank": "x " + "y1,z.\n" * 5000}


@pytest.mark.parametrize("name", LINES)
def test_many_lines_without_blanks(name):
    import sentencepiece
    from tokenizers import Tokenizer

    text = LINES[name]
    path = tokenizer_path("byte_bpe_50k.json")
    blanks = tokens.BlankEncoder(path, "I")
    assert list(array("I", blanks.batch(pa.array([text.encode()], pa.binary()))[0])) == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    path = tokenizer_path("piece_bpe_32k.model")
    own = pieces.PieceEncoder(path)
    assert list(array("I", own.batch(pa.array([text.encode()], pa.binary()))[0])) == sentencepiece.SentencePieceProcessor(model_file=path).encode(text)
    for cache in (blanks.first, blanks.rest, own.after, own.bare):
        assert sum(map(len, cache)) <= len(text)


def test_frequent_chunks_outlive_a_full_cache(monkeypatch):
    """A cache that is full keeps what the last texts had; a chunk of every text is encoded once, not once for each time it fills."""
    monkeypatch.setattr(tokens, "GENERATION", 50)
    path = tokenizer_path("byte_bpe_50k.json")
    library, blanks, seen = tokens.Tokenizer.from_file(path), tokens.BlankEncoder(path, "I"), []
    whole = blanks.rest.model
    blanks.rest.model = lambda word: seen.append(word) or whole(word)
    texts = [f"so common\nwords, {k}: " + " ".join(f"common q{chr(97 + i)}{chr(97 + k)}" for i in range(26)) for k in range(20)]
    for t in texts:
        assert blanks.batch(pa.array([t.encode()], pa.binary())) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()]
        assert len(blanks.rest) + len(blanks.rest.older) < 250
    assert seen.count("Ġcommon") == 1
    blanks.release()
    assert not blanks.rest and not blanks.rest.older

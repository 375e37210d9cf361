"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass search.

At each character the automaton's state, and the output links behind it, name every piece that ends
there. Each relaxes the best score of its end from that of its start:

unigram models - the score is the sum of the pieces' scores, and the largest wins (Viterbi);
BPE models - the score is whether the prefix so cut is what merging gives. Just one last piece of a
prefix is, and whether a piece may follow another depends on the two alone, so the pass stays exact:
the ids are those of the library's merging.

Pieces hold white space at their start or as runs of it alone, so a text is cut before each run, and a
worker encodes a distinct cut once while it is in its cache.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tokens import KEPT_BYTES, _Encoder, _spread, encoded

SPACE = "▁"
CACHE_ENTRIES = 1_000_000
_UNIGRAM, _BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield tag >> 3, data[at : at + size]
            at += size


class Pieces:
    """A model file's pieces, scores and kind, and the search over them."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        trainer = dict(_fields(dict(_fields(model.serialized_model_proto()))[2]))
        self.kind = trainer.get(3, _UNIGRAM)
        self.text = [model.id_to_piece(i) for i in range(model.vocab_size())]
        self.score = [model.get_score(i) for i in range(len(self.text))]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(len(self.text))]
        self.id = {t: i for i, t in enumerate(self.text) if not special[i]}
        self.unknown = model.unk_id()
        found = {b: model.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        self.bytes = found if all(model.is_byte(i) for i in found.values()) else None
        self.lowest = min(self.score) - 10
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id.items():
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        raw = [t.replace(SPACE, " ").encode() for t in self.text]
        if self.bytes:
            for b, i in self.bytes.items():
                raw[i] = bytes([b])
        self.raw = [b"" if model.is_control(i) else r for i, r in enumerate(raw)]

    def _fallback(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()] if self.bytes else [self.unknown]

    def follows(self, a: int, b: int) -> bool:
        """Whether merging the text of two pieces, each whole on its own, leaves just these two."""
        key = a * len(self.text) + b
        if key not in self.pairs:
            if len(self.pairs) > CACHE_ENTRIES:
                self.pairs.clear()
            self.pairs[key] = self._parts(self.text[a] + self.text[b], len(self.text[a]))
        return self.pairs[key]

    def _parts(self, text: str, border: int) -> bool:
        parts, ends = list(text), list(range(1, len(text) + 1))
        ids, score = self.id, self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or score[i] > best):
                    best, at = score[i], k
            if at < 0:
                break
            if ends[at] == border:
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ends[at]
        return border in ends and len(parts) == 2

    def whole(self, i: int) -> bool:
        """Whether merging the text of a piece gives the piece."""
        key = -1 - i
        if key not in self.pairs:
            parts = list(self.text[i])
            while len(parts) > 1:
                found = [(self.score[j], -k) for k in range(len(parts) - 1) if (j := self.id.get(parts[k] + parts[k + 1])) is not None]
                if not found:
                    break
                k = -max(found)[1]
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            self.pairs[key] = len(parts) == 1
        return self.pairs[key]

    def encode(self, text: str) -> list[int]:
        """Ids of a text whose blanks are marks already."""
        if not text:
            return []
        n = len(text)
        best: list[float | None] = [None] * (n + 1)
        last, start = [-1] * (n + 1), [0] * (n + 1)  # -1: a character by itself, which never merges
        best[0], done = 0.0, 0
        unigram = self.kind != _BPE

        def close(upto: int) -> None:
            """A character that no piece covers stands by itself."""
            nonlocal done
            while done < upto:
                done += 1
                if best[done] is None:
                    if unigram or text[done - 1] not in self.id:
                        before = best[done - 1]
                        if before is not None:
                            best[done], last[done], start[done] = before + self.lowest, -1, done - 1

        for end, (i, size) in self.automaton.iter(text):
            close(end)
            at = end + 1 - size
            before = best[at]
            if before is None:
                continue
            if unigram:
                now = before + self.score[i]
                if best[end + 1] is None or now > best[end + 1]:
                    best[end + 1], last[end + 1], start[end + 1] = now, i, at
            elif best[end + 1] is None and (self.whole(i) if last[at] < 0 else self.follows(last[at], i)):
                best[end + 1], last[end + 1], start[end + 1] = before, i, at
        close(n)
        out: list[int] = []
        at = n
        while at > 0:
            out += [last[at]] if last[at] >= 0 else self._fallback(text[start[at]])[::-1]
            at = start[at]
        return out[::-1]

    def decode(self, ids: list[int]) -> bytes:
        """The text of ids; the blank that encoding puts in front is taken off."""
        found = b"".join(map(self.raw.__getitem__, ids))
        return found[1:] if found[:1] == b" " else found


class _Cuts(dict):
    """Cut of a text (without the blank before it) to ids, as bytes."""

    def __init__(self, pieces: Pieces, mark: str) -> None:
        self.pieces, self.mark = pieces, mark
        self.other: _Cuts = self

    def __missing__(self, cut: bytes) -> bytes:
        if b"\n" in cut and "\n" not in self.pieces.id:  # a line break is no piece and never merges
            head, *lines = cut.split(b"\n")
            first = self[head] if head or self.mark else b""
            ids = array("I", self.pieces._fallback("\n")).tobytes().join([first, *(self.other[x] if x else b"" for x in lines)])
            if len(cut) > KEPT_BYTES:  # its lines are kept
                return ids
        else:
            ids = array("I", self.pieces.encode(self.mark + cut.decode())).tobytes()
        self[cut] = ids
        return ids


class PieceEncoder(_Encoder):
    """Ids of texts, as bytes of four to an id. What is known of pairs of pieces outlives a task, cuts of texts don't."""

    def __init__(self, path: str) -> None:
        self.dtype, self.pieces = "<u4", Pieces(path)
        self.after, self.bare = _Cuts(self.pieces, SPACE), _Cuts(self.pieces, "")
        self.after.other = self.bare.other = self.bare

    def caches(self) -> list[_Cuts]:
        return [self.after, self.bare]

    def batch(self, texts: pa.Array) -> list[bytes]:
        """texts: binary, without nulls. Texts with runs of blanks, or marks of their own, are cut one by one."""
        if len(self.after) + len(self.bare) > CACHE_ENTRIES:
            self.release()
        odd = pc.match_substring_regex(texts, r"  |^ | $|\xe2\x96\x81|^$").to_numpy(zero_copy_only=False)
        parts = pc.split_pattern(texts, b" ")
        found = parts.flatten().dictionary_encode()
        if odd.any():
            regular = np.repeat(~odd, np.diff(parts.offsets.to_numpy()))
            codes = found.indices.to_numpy()
            used = np.unique(codes[regular])
            names = found.dictionary.take(pa.array(used)).to_pylist()
            codes = np.where(regular, np.searchsorted(used, codes), len(names))
        else:
            names, codes = found.dictionary.to_pylist(), found.indices.to_numpy()
        out = _spread([self.after[x] for x in names] + [b""], codes, parts.offsets.to_numpy(), "<u4")
        for i in np.flatnonzero(odd):
            out[i] = self.one(texts[int(i)].as_py())
        return out

    def one(self, text: bytes) -> bytes:
        if not text:
            return b""
        marked = SPACE + text.decode().replace(" ", SPACE)
        return b"".join(self.bare[x.encode()] for x in re.findall(f"{SPACE}+[^{SPACE}]*", marked))


_ENCODERS: dict[str, PieceEncoder] = {}


def encode_documents(docs: DataFrame, model: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_ids, ids_crc32, round_trip (and ids, as an array, if asked for) of every whole text.

    ids_crc32 is over little-endian unsigned 32-bit ids; round_trip says whether decoding the ids gives
    the text back. A null text counts as empty and has no ids; an empty table gives no rows. Nothing is
    shuffled.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_())] + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.setdefault(model, None) or PieceEncoder(model)
        _ENCODERS[model] = encoder

        texts: deque[bytes | None] = deque()

        def parts() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    part = batch.slice(at, 1000)
                    texts.extend(part.column(1).cast(pa.binary()).to_pylist())
                    yield part

        for keys, found in encoded(parts(), encoder):
            numbers = [np.frombuffer(x, "<u4") for x in found]
            same = [encoder.pieces.decode(n.tolist()) == (texts.popleft() or b"") for n in numbers]
            columns = [pa.array(keys, pa.int64()), pa.array([len(n) for n in numbers], pa.int64()), pa.array([zlib.crc32(x) for x in found], pa.int64()), pa.array(same)]
            columns += [pa.array([n.astype(np.int32) for n in numbers], pa.list_(pa.int32()))] * with_ids
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    shape = "doc_id long, n_ids long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, shape)


def decode_documents(rows: DataFrame, model: str) -> DataFrame:
    """doc_id, text of rows with doc_id and ids (array of int); no ids, or null, give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.setdefault(model, None) or PieceEncoder(model)
        _ENCODERS[model] = encoder
        for batch in batches:
            texts = [encoder.pieces.decode(x or []).decode(errors="replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")

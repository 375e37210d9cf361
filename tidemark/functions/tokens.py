"""Token ids of canonical texts: a public tokenizer, and the marks of the canonical grammar as ids behind its own.

What is regular in sequences of ids (windows, slices, padding) is left to array functions; this module has
what needs a look at the ids themselves, in Arrow batches: encoding, decoding, chunks of chats, targets.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import MARKS

PAD = "<pad>"

#: Characters of text that are encoded together.
MOST = 1 << 19

#: Pieces of text that a worker keeps with their ids, some 80 MB; as many of the generation before are kept with them.
KEPT = 400_000

#: Where a byte-level tokenizer always cuts: before a single blank between two characters that are no white space.
CUT = re.compile(r"(?<=\S)(?= \S)")


class _Library:
    """A worker's tokenizer of a file. If it is byte-level, texts are cut where it cuts too, and each piece is encoded once."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # its own special strings are ordinary text
        self.size = self.tokenizer.get_vocab_size()
        told = json.loads(self.tokenizer.to_str())
        before = told.get("pre_tokenizer") or {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.cuts = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not told.get("normalizer")
        # a blank and letters are one word to a byte-level tokenizer, and no added token cuts them if none is of letters
        self.whole = self.cuts and not any(not t["content"].strip() or t["content"].strip().isalpha() for t in told.get("added_tokens") or [])
        self.raw: list[bytes] | None = None
        if self.cuts and (told.get("decoder") or {}).get("type") == "ByteLevel":
            # how byte-level vocabularies show bytes: printable Latin-1 as itself, the others from U+0100 on
            shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
            byte = {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(x for x in range(0x100) if x not in shown)}
            tokens = [self.tokenizer.id_to_token(i) for i in range(self.size)]
            self.raw = [bytes(map(byte.__getitem__, t)) if all(c in byte for c in t) else t.encode() for t in tokens]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.cuts:
            return [np.array(x.ids, np.int32) for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        if len(self.known) > KEPT:
            self.known, self.older = {}, self.known
        parts = [CUT.split(t) for t in texts]
        fresh, model = [], self.tokenizer.model.tokenize
        for x in {x for p in parts for x in p} - self.known.keys():
            if x in self.older:
                self.known[x] = self.older[x]
            elif self.whole and x[:1] == " " and x[1:].isalpha() and x.isascii():
                self.known[x] = np.array([t.id for t in model("\u0120" + x[1:])], np.int32).tobytes()
            else:
                fresh.append(x)
        for x, found in zip(fresh, self.tokenizer.encode_batch(fresh, add_special_tokens=False), strict=True):
            self.known[x] = np.array(found.ids, np.int32).tobytes()
        return [np.frombuffer(b"".join(map(self.known.__getitem__, p)), np.int32) for p in parts]

    def decode(self, ids: list[int]) -> str:
        if self.raw is not None:
            return b"".join(map(self.raw.__getitem__, ids)).decode(errors="replace")
        return self.tokenizer.decode(ids, skip_special_tokens=False)


_LOADED: dict[str, _Library] = {}


def _library(path: str) -> _Library:
    """The worker's tokenizer of a file; workers outlive tasks."""
    if path not in _LOADED:
        _LOADED[path] = _Library(path)
    return _LOADED[path]


@dataclass(frozen=True)
class Codec:
    """path: a file of the tokenizers library, on every executor. marks: strings that are one id each, first the padding."""

    path: str
    marks: tuple[str, ...] = (PAD, *MARKS)

    @property
    def base(self) -> int:
        return _library(self.path).size

    @property
    def size(self) -> int:
        return self.base + len(self.marks)

    def id(self, mark: str) -> int:
        return self.base + self.marks.index(mark)

    def fingerprint(self) -> str:
        """Sixteen hexadecimal digits that tell vocabularies and marks apart."""
        with open(self.path, "rb") as file:
            return hashlib.sha256(file.read() + "\0".join(self.marks).encode()).hexdigest()[:16]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts; each different stretch between marks is encoded once among MOST characters of text.

        The library's results take a few hundred bytes an id until only the ids are kept.
        """
        sizes = np.cumsum([len(t) for t in texts])
        cuts = np.flatnonzero(np.diff(sizes // MOST)) + 1 if len(texts) else []
        return [x for i, j in zip([0, *cuts], [*cuts, len(texts)], strict=True) for x in self._encoded(texts[i:j])]

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        cut = re.compile("(" + "|".join(re.escape(m) for m in sorted(self.marks, key=len, reverse=True)) + ")")
        known = {m: np.array([self.base + i], np.int32) for i, m in enumerate(self.marks)}
        parts = [[x for x in cut.split(t) if x] for t in texts]
        fresh = list({x for p in parts for x in p} - known.keys())
        known.update(zip(fresh, _library(self.path).encode(fresh), strict=True))
        return [np.concatenate([known[x] for x in p]) if p else np.empty(0, np.int32) for p in parts]

    def decode_all(self, rows: list[np.ndarray], marks: bool = True) -> list[str]:
        """Texts of ids, with the marks or without; the padding is never shown. Ids beyond all raise an error."""
        out = []
        library, base = _library(self.path), self.base
        for ids in rows:
            ids = np.asarray(ids, np.int64)
            if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
                raise ValueError(f"an id is not between 0 and {self.size - 1}")
            ids = ids[ids != base]
            at = np.flatnonzero(ids >= base).tolist()
            text, start = [], 0
            for i in [*at, len(ids)]:
                text.append(library.decode(ids[start:i].tolist()) if i > start else "")
                if i < len(ids) and marks:
                    text.append(self.marks[int(ids[i]) - base])
                start = i + 1
            out.append("".join(text))
        return out

    def encode(self, text: Column, bos: bool = False, eos: bool = False) -> Column:
        """Ids of a text, as array of int; a null text has none. bos, eos: with that mark before or after."""
        before, after = [[self.id(m)] if wanted else [] for m, wanted in (("<bos>", bos), ("<eos>", eos))]

        @F.arrow_udf("array<int>")
        def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in _sliced(batches):
                found = self.encode_all([t or "" for t in texts.to_pylist()])
                yield _lists([np.concatenate([before, x, after]) for x in found] if bos or eos else found)

        return ids(text.cast("string"))

    def decode(self, ids: Column, marks: bool = True) -> Column:
        """The text of an array of ids; null ids give an empty text."""

        @F.arrow_udf("string")
        def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for rows in _sliced(batches):
                flat, offsets = _flat(rows)
                yield pa.array(self.decode_all([flat[i:j] for i, j in zip(offsets, offsets[1:])], marks), pa.string())

        return texts(ids)

    def chat_chunks(self, ids: Column, most: int) -> Column:
        """Chunks of at most `most` ids of a conversation that is longer, as array of arrays, see chunked_chat; those in which
        nothing is to be predicted are left out."""
        names = ("<bos>", "<eos>", "<user>", "<assistant>", "</assistant>", "<think>", "</think>")
        marks = tuple(self.id(m) for m in names)
        told = (marks[0], marks[1], marks[3], marks[4])

        @F.arrow_udf("array<array<int>>")
        def chunks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for rows in _sliced(batches):
                flat, offsets = _flat(rows)
                found = [[c for c in chunked_chat(flat[i:j], marks, most) if target_mask(c, np.array([len(c)]), told)[0].any()] for i, j in zip(offsets, offsets[1:])]
                outer = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                yield pa.ListArray.from_arrays(outer, _lists([c for cs in found for c in cs]))

        return chunks(ids)

    def targets(self, ids: Column, length: int) -> Column:
        """struct(x, y, n_targets, n_prompt) of a sequence of ids: what a model of `length` positions reads and is to predict.

        x and y are padded to `length`; y is padding where nothing is to be predicted. Of a plain example all ids
        but its first are predicted; of one with an assistant's turn only what stands in such turns with their
        end marks, and the end of the example. Other ids of a chat are n_prompt; the first id of a further
        example in the sequence counts nowhere. What is longer than length + 1 ids is cut there.
        """
        marks = tuple(self.id(m) for m in ("<bos>", "<eos>", "<assistant>", "</assistant>"))
        pad = self.id(self.marks[0])

        @F.arrow_udf("x array<int>, y array<int>, n_targets int, n_prompt int")
        def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for rows in _sliced(batches):
                whole, offsets = _flat(rows)
                sizes = np.minimum(np.diff(offsets), length + 1)
                flat = np.concatenate([whole[i : i + n] for i, n in zip(offsets, sizes)]) if len(sizes) else whole
                wanted, prompt = target_mask(flat, sizes, marks)
                x, y = (np.full((len(sizes), length), pad, np.int32) for _ in range(2))
                counts = np.zeros((2, len(sizes)), np.int32)
                for k, (end, n) in enumerate(zip(np.cumsum(sizes).tolist(), sizes.tolist(), strict=True)):
                    if n > 1:
                        at = slice(end - n + 1, end)
                        x[k, : n - 1], y[k, : n - 1] = flat[end - n : end - 1], np.where(wanted[at], flat[at], pad)
                        counts[:, k] = wanted[at].sum(), prompt[at].sum()
                starts = pa.array(np.arange(len(sizes) + 1) * length, pa.int32())
                parts = [pa.ListArray.from_arrays(starts, pa.array(part.ravel())) for part in (x, y)]
                yield pa.StructArray.from_arrays([*parts, pa.array(counts[0]), pa.array(counts[1])], ["x", "y", "n_targets", "n_prompt"])

        return made(ids)


def _sliced(batches: Iterator[pa.Array], rows: int = 256) -> Iterator[pa.Array]:
    """A few rows at a time, so that what a task makes of a batch is never there all at once."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def _flat(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of rows of lists, and where each row begins and the last one ends; a null row is empty."""
    sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
    return rows.flatten().to_numpy(zero_copy_only=False).astype(np.int32), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(rows).astype(np.int32) if rows else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(flat))


def target_mask(ids: np.ndarray, sizes: np.ndarray, marks: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Which ids are to be predicted and which are prompt, of sequences of these sizes one after another.

    An example begins with a sequence, with a begin mark, and after an end mark. All is decided by the last
    opening and the last closing mark up to each place, so all sequences are looked at together.
    """
    bos, eos, opens, closes = marks
    n, place = len(ids), np.arange(len(ids))
    if not n:
        return np.zeros(0, bool), np.zeros(0, bool)
    begins = ids == bos
    begins[1:] |= ids[:-1] == eos
    begins[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    first = np.maximum.accumulate(np.where(begins, place, -1))
    example = np.cumsum(begins) - 1
    chat = np.bincount(example, ids == opens)[example] > 0
    inner = ~begins
    latest = lambda here: np.maximum.accumulate(np.where(here & inner, place, -1))
    opened = latest(ids == opens)
    closed = np.concatenate([[-1], latest(ids == closes)[:-1]])  # a closing mark itself is still inside
    seen = opened > first
    inside = seen & (opened > closed) & (opened < place)
    wanted = inner & np.where(chat, (inside & (ids != opens)) | (seen & (ids == eos)), True)
    return wanted, inner & chat & ~wanted


def chunked_chat(ids: np.ndarray, marks: tuple[int, ...], most: int) -> list[np.ndarray]:
    """An answer after another of a conversation, each in chunks of at most `most` ids.

    A chunk begins with what was asked last (its end, if that is longer than most - 7 ids; all before the
    answer if no question stands between it and the one before) and the mark that opens an answer; then
    comes a piece of the answer. The last chunk closes the answer and the example. An answer that begins
    with reasoning opens it again in each chunk; the text after it stays whole in the last one, if that can
    be. No id of an answer is in two chunks. An answer that is never closed ends with the ids; a conversation
    without an answer gives no chunk.
    """
    bos, eos, asks, opens, closes, thinks, concludes = marks
    out: list[np.ndarray] = []
    done = 0
    ends, questions = np.flatnonzero(ids == closes), np.flatnonzero(ids == asks)
    for a in np.flatnonzero(ids == opens).tolist():
        if a < done:
            continue  # a mark inside an answer
        after = ends[np.searchsorted(ends, a) :]
        end = int(after[0]) if len(after) else len(ids)
        done = end + 1
        before = questions[: np.searchsorted(questions, a)]
        closed = ends[: np.searchsorted(ends, a)]
        asked = len(before) and (not len(closed) or before[-1] > closed[-1])
        context = ids[before[-1] : a] if asked else ids[int(len(ids) > 0 and ids[0] == bos) : a]
        budget = max(0, most - 7)
        if len(context) > budget:
            tail = context[len(context) - max(0, budget - 1) :]
            whole = not budget or context[0] != asks or (len(tail) and tail[0] == asks)
            context = (context[len(context) - budget :] if context[0] != asks else tail) if whole else np.concatenate([[asks], tail])
        head = np.concatenate([[bos], context, [opens]])
        body, tail = ids[a + 1 : end], np.array([closes, eos])
        if len(body) and body[0] == thinks and (body == concludes).any():
            stop = int(np.flatnonzero(body == concludes)[0])
            reasoned = np.concatenate([head, [thinks]]), np.concatenate([[concludes], body[stop + 1 :], tail])
            if most - len(reasoned[0]) >= 1 and most - len(reasoned[0]) - len(reasoned[1]) >= 0:
                (head, tail), body = reasoned, body[1:stop]
        inner, final = most - len(head), most - len(head) - len(tail)
        if final < 1 and len(tail) == 2:
            raise ValueError(f"{most} ids leave no room for an answer")
        many = max(0, -(-(len(body) - final) // inner))
        cuts = [*(min(i * inner, len(body) - final) for i in range(many)), max(0, len(body) - final) if many else 0]
        for i, (start, stop) in enumerate(zip(cuts, [*cuts[1:], len(body)], strict=True)):
            out.append(np.concatenate([head, body[start:stop], tail] if i == many else [head, body[start:stop]]).astype(np.int32))
    return out

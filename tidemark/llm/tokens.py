"""Encoding whole texts with the tokenizers library, a chunk of text at a time.

A text is cut only where the tokenizer's own pre-tokenizer always cuts, so the ids of the chunks in a
row are the ids of the text. Each worker encodes a distinct chunk once while it is in its cache.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Chunks that a task keeps, about 40 MB; a full cache is emptied, which costs time but changes nothing.
CACHE_ENTRIES = 200_000

#: Chunks after which a byte-level encoder begins a new generation of its cache; with the one before some 150 MB.
GENERATION = 450_000

#: Longest chunk of several lines that is kept whole; of a longer one only the lines are.
KEPT_BYTES = 200

#: Bytes that are white space, or may begin or end some, in UTF-8.
_SPACES = b" \t\n\r\x0b\x0c"
_MAYBE_FIRST = frozenset(_SPACES + b"\xc2\xe1\xe2\xe3")
_SURE_BREAK = re.compile(rb"(?<=[\x21-\x7e])\n(?=[^ \t\n\r\x0b\x0c\xc2\xe1\xe2\xe3])")


#: How byte-level BPE shows bytes as characters: printable Latin-1 as itself, the others from U+0100 on.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SHOWN_AS = {b: b for b in _SHOWN} | {b: 0x100 + i for i, b in enumerate(x for x in range(0x100) if x not in _SHOWN)}


class _Chunks(dict):
    """Chunk of text to ids, as bytes; what is missing is encoded. before: text that stands before each chunk.

    A chunk of Latin letters alone is one word to the pre-tokenizer, and goes to the library's BPE
    model without it; any other goes through the whole tokenizer.
    """

    def __init__(self, tokenizer: Tokenizer, code: str, before: str = "") -> None:
        self.encode, self.model, self.code, self.before = tokenizer.encode, tokenizer.model.tokenize, code, before
        self.encode_fast = tokenizer.encode_batch_fast
        self.shown, self.marks = before.translate(_SHOWN_AS), {}
        self.older: dict[bytes, bytes] = {}

    def aged(self) -> None:
        """Begins a new generation: what is looked up again moves to it, what is not goes with the next one."""
        self.older = dict(self)
        self.clear()

    def __missing__(self, chunk: bytes) -> bytes:
        if chunk in self.older:
            ids = self.older[chunk]
        elif chunk.isalpha():
            ids = array(self.code, [t.id for t in self.model(self.shown + chunk.decode())]).tobytes()
        else:
            ids = self.fresh(chunk)
        self[chunk] = ids
        return ids

    def fresh(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if len(text) > 1 and text[-1] in ".," and text[-2].isalpha() and text[-2] < "\u0250" and len(text[-2].lower()) == 1:
            return self[chunk[:-1]] + self.raw(chunk[-1:])  # a mark after a letter is always cut off
        if text.isalpha() and max(text) < "\u0250" and (self.shown or text == text.lower()):
            found = [t.id for t in self.model(self.shown + chunk.decode("latin-1").translate(_SHOWN_AS))]
            return array(self.code, found).tobytes()
        return array(self.code, self.encode(self.before + text, add_special_tokens=False).ids).tobytes()

    def raw(self, mark: bytes) -> bytes:
        """Ids of a single mark, with nothing before it."""
        if mark not in self.marks:
            self.marks[mark] = array(self.code, self.encode(mark.decode(), add_special_tokens=False).ids).tobytes()
        return self.marks[mark]


def _spread(values: list[bytes], codes: np.ndarray, offsets: np.ndarray, dtype: str) -> list[bytes]:
    """values[c] for the codes c of each row, joined; row i has the codes from offsets[i] to offsets[i + 1]."""
    width = np.dtype(dtype).itemsize
    sizes = np.array([len(v) for v in values], np.int64) // width
    starts, blob = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(values), dtype)
    many = sizes[codes]
    ends = np.concatenate([[0], np.cumsum(many)])
    at = np.repeat(starts[codes] - ends[:-1], many) + np.arange(ends[-1])
    data, cut = blob[at].tobytes(), (ends[offsets] * width).tolist()
    return [data[i:j] for i, j in zip(cut, cut[1:], strict=False)]


class _Encoder:
    """Ids of texts, as bytes. What is regular is cut, looked up and put together a batch at a time."""

    def __init__(self, path: str, code: str) -> None:
        self.dtype = f"<u{array(code).itemsize}"
        self.prepare(Tokenizer.from_file(path), code)

    def caches(self) -> list[_Chunks]:
        raise NotImplementedError

    def release(self) -> None:
        """Drops what the task has cached: a worker that waits for another task holds the tokenizer alone."""
        for cache in self.caches():
            cache.clear()
            cache.older = {}
        pa.default_memory_pool().release_unused()

    def batch(self, texts: pa.Array) -> list[bytes]:
        """texts: binary, without nulls."""
        odd = self.irregular(texts)
        found = self.regular(texts if not odd else pa.array([b"" if i in odd else t for i, t in enumerate(texts.to_pylist())], pa.binary()))
        for i in odd:
            found[i] = self(texts[i].as_py())
        return found


class WordEncoder(_Encoder):
    """For a tokenizer that lower-cases and drops white space: chunks are words."""

    def prepare(self, tokenizer: Tokenizer, code: str) -> None:
        self.words = _Chunks(tokenizer, code)

    def caches(self) -> list[_Chunks]:
        return [self.words]

    def irregular(self, texts: pa.Array) -> list[int]:
        """Texts that may hold a special token, whose case counts."""
        return np.flatnonzero(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)).tolist()

    def regular(self, texts: pa.Array) -> list[bytes]:
        if len(self.words) > CACHE_ENTRIES:
            self.release()
        # the white space of the cast is ASCII's, as in bytes.split()
        parts = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string())))
        words = parts.flatten().dictionary_encode()
        known = [self.words[w] if w else b"" for w in words.dictionary.cast(pa.binary()).to_pylist()]
        return _spread(known, words.indices.to_numpy(), parts.offsets.to_numpy(), self.dtype)

    def __call__(self, text: bytes) -> bytes:
        chunks = [w if b"<|" in w else w.lower() for w in text.split()]
        return b"".join(map(self.words.__getitem__, chunks))


class _Blanks(_Chunks):
    """Chunks after a blank, for byte-level BPE; a line break between two visible characters is always cut off."""

    plain: _Chunks
    #: Bytes that each id stands for.
    widths: np.ndarray

    def many(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of each chunk, where a blank stands before all; those that are new go to the library together."""
        older, model, shown, code = self.older, self.model, self.shown, self.code
        new = [c for c in chunks if c not in self]
        if older:
            self.update([(c, older[c]) for c in new if c in older])
            new = [c for c in new if c not in older]
        plain = [c for c in new if c.isalpha()]
        self.update(zip(plain, [array(code, [t.id for t in model(shown + c.decode())]).tobytes() for c in plain], strict=True))
        joined = [c for c in new if not c.isalpha() and 0 < len(c) <= KEPT_BYTES and c[0] not in _MAYBE_FIRST]
        for at in range(0, len(joined), 1000):
            some = joined[at : at + 1000]
            self.update(zip(some, self.together(some), strict=True))
        return list(map(self.__getitem__, chunks))

    def together(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of chunks that begin without white space: those of one text, cut after the bytes of each chunk."""
        text = self.before + self.before.join([c.decode() for c in chunks])
        ids = np.array(self.encode_fast([text], add_special_tokens=False)[0].ids, np.int64)
        stops, ends = np.cumsum(self.widths[ids]), np.cumsum([len(c) + len(self.before) for c in chunks])
        at = np.searchsorted(stops, ends)
        if not len(ids) or stops[-1] != ends[-1] or (stops[at] != ends).any():  # no such tokenizer
            return [self[c] for c in chunks]
        data, width = ids.astype(f"<u{array(self.code).itemsize}").tobytes(), array(self.code).itemsize
        cut = [0, *((at + 1) * width).tolist()]
        return [data[i:j] for i, j in zip(cut, cut[1:], strict=False)]

    def __missing__(self, chunk: bytes) -> bytes:
        head, *lines = _SURE_BREAK.split(chunk) if b"\n" in chunk and chunk not in self.older else (chunk,)
        if not lines:
            return super().__missing__(chunk)
        ids = self.raw(b"\n").join([self[head], *map(self.plain.__getitem__, lines)])
        if len(chunk) <= KEPT_BYTES:
            self[chunk] = ids
        return ids


class BlankEncoder(_Encoder):
    """For byte-level BPE with the usual pattern, in which a blank goes to the word that follows it.

    The cut before a blank is sure if what follows the blank is not white space, or what precedes it
    is not: then no alternative of the pattern spans it. Elsewhere nothing is cut.
    """

    def prepare(self, tokenizer: Tokenizer, code: str) -> None:
        self.first, self.rest = _Blanks(tokenizer, code), _Blanks(tokenizer, code, " ")
        self.first.plain = self.rest.plain = self.first
        known = tokenizer.get_vocab(with_added_tokens=True)
        added = {i: len(t.content.encode()) for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.rest.widths = np.zeros(max(known.values(), default=0) + 1, np.int64)
        for shown, i in known.items():  # a character for each byte
            self.rest.widths[i] = added.get(i, len(shown))

    def caches(self) -> list[_Chunks]:
        return [self.first, self.rest]

    def irregular(self, texts: pa.Array) -> list[int]:
        """Texts that have a blank before what is, or may be, white space."""
        bad = pc.match_substring_regex(texts, r" [ \t\n\r\x0b\x0c\xc2\xe1\xe2\xe3]| $")
        return np.flatnonzero(bad.to_numpy(zero_copy_only=False)).tolist()

    def regular(self, texts: pa.Array) -> list[bytes]:
        if len(self.first) + len(self.rest) > GENERATION:
            for cache in self.caches():
                cache.aged()
        parts = pc.split_pattern(texts, b" ")
        flat, offsets = parts.flatten(), parts.offsets.to_numpy()
        pieces = flat.dictionary_encode()
        known = self.rest.many(pieces.dictionary.to_pylist())
        codes = pieces.indices.to_numpy().copy()
        heads = flat.take(pa.array(offsets[:-1])).to_pylist()
        codes[offsets[:-1]] = len(known) + np.arange(len(heads))
        return _spread(known + [self.first[h] if h else b"" for h in heads], codes, offsets, self.dtype)

    def __call__(self, text: bytes) -> bytes:
        return b"".join(self.joined(text.split(b" ")))

    def joined(self, pieces: list[bytes]) -> Iterator[bytes]:
        """Ids of the chunks, where some blanks are no sure cut: what belongs together is encoded as one."""
        held, rest = pieces[0], False  # the open chunk, and whether a blank stands before it
        before = pieces[0]
        for piece in pieces[1:]:
            sure = (piece and piece[0] not in _MAYBE_FIRST) or (before and 0x21 <= before[-1] <= 0x7E)
            if sure or not (held or rest):
                if held or rest:
                    yield (self.rest if rest else self.first)[held]
                held, rest = piece, True
            else:
                held += b" " + piece
            before = piece or b" "
        if held or rest:
            yield (self.rest if rest else self.first)[held]


_ENCODERS: dict[tuple, _Encoder] = {}


def encoder(kind: type[_Encoder], path: str, code: str = "I") -> _Encoder:
    """The worker's encoder for this file; workers live longer than tasks, and so does the tokenizer."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (kind, path, code) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[kind, path, code] = kind(path, code)
    return _ENCODERS[kind, path, code]


def encoded(batches: Iterator[pa.RecordBatch], encode: _Encoder, most: int = 1 << 23, keep: bool = False) -> Iterator[tuple[list, list[bytes]]]:
    """doc_id and ids of each row, rows of about `most` bytes at a time; null texts count as empty.

    Batches: doc_id, text. The encoder's cache goes when the task ends, in whatever way, unless the worker is to keep it.
    """
    try:
        for batch in batches:
            texts = batch.column(1)
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            group = np.cumsum(sizes) // most
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for i, j in zip(cuts, cuts[1:], strict=False):
                part = texts.slice(i, j - i).cast(pa.binary())
                yield batch.column(0).slice(i, j - i).to_pylist(), encode.batch(pc.fill_null(part, b""))
    finally:
        if not keep:
            encode.release()

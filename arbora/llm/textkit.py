"""Vectorised text primitives on Arrow string buffers: words, word hashes, shingles.

All functions work on UTF-8 bytes.  Words are hashed to 64 bits, eight bytes at a time and mixed after each eight, so
no Python object is made per word but for those of more than ``LONG`` bytes, which take BLAKE2b.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
LONG = 256

#: Byte tables: A-Z to a-z, and which bytes belong to words.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``: ASCII digits, lower-case letters and every byte of a non-ASCII character.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = True
ALNUM[97:123] = True
ALNUM[128:] = True
#: ``[^\x20\x09-\x0D]+``: everything but ASCII white space.
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[[32, 9, 10, 11, 12, 13]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.zeros(0, np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)), offsets


def slices(offsets: np.ndarray, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``max_bytes``; a longer text comes alone and whole."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + max_bytes, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U64)


def hash_spans(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each span of ``text``, which has eight more bytes than the spans reach."""
    eight = np.ndarray((len(text) - 7,), "<u8", buffer=text, strides=(1,))
    length = ends - starts
    h = mix(length.astype(U64) * U64(0xD6E8FEB86659FD93) + U64(0x9E3779B97F4A7C15 + 2 * seed))
    at = np.flatnonzero((length > 0) & (length <= LONG))
    for k in range(0, LONG, 8):
        at = at[length[at] > k]
        if not len(at):
            break
        part = eight[starts[at] + k] & _KEEP[np.minimum(length[at] - k, 8)]
        h[at] = mix(h[at] ^ part)
    for x in np.flatnonzero(length > LONG).tolist():
        raw = text[starts[x] : ends[x]].tobytes()
        h[x] = int.from_bytes(hashlib.blake2b(raw, digest_size=8, salt=seed.to_bytes(2, "little")).digest(), "little")
    return h


class Words:
    """Words of texts i..j: byte ``starts`` and ``ends`` (from ``base``), ``doc`` (from 0), 64-bit ``hashes``."""

    __slots__ = ("base", "doc", "ends", "hashes", "n_docs", "starts", "text")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, i: int, j: int, is_word: np.ndarray, seed: int = 0, lower: bool = True, hashed: bool = True):
        self.base, self.n_docs = int(offsets[i]), j - i
        n = int(offsets[j]) - self.base
        self.text = np.zeros(n + 8, np.uint8)
        own = data[self.base : int(offsets[j])]
        self.text[:n] = text = LOWER[own] if lower else own
        bounds = offsets[i : j + 1] - self.base
        inside = is_word[text]
        before = np.empty(n, dtype=bool)
        after = np.empty(n, dtype=bool)
        if n:
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
            heads = bounds[:-1]
            before[heads[heads < n]] = False
            tails = bounds[1:] - 1
            after[tails[tails >= 0]] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.doc = np.searchsorted(bounds, self.starts, side="right") - 1
        self.hashes = self.span_hash(self.starts, self.ends, seed) if hashed else None

    def span_hash(self, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
        """Hash of the bytes of each span, lower-cased if the words are."""
        return hash_spans(self.text, starts, ends, seed)

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)


def hash_word(word: str) -> int:
    """The hash that ``Words`` gives this single word."""
    raw = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(Words(raw, np.array([0, len(raw)]), 0, 1, np.ones(256, dtype=bool)).hashes[0])


def shingles(words: Words, size: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash) of each run of ``size`` words; a text with fewer words, but some, is one run."""
    h, d = words.hashes if hashes is None else hashes, words.doc
    k = U64(0xC2B2AE3D27D4EB4F)
    if len(h) >= size:
        full = np.flatnonzero(d[: len(d) - size + 1] == d[size - 1 :])
        acc = h[full].copy()
        for t in range(1, size):
            acc = acc * k + h[full + t]
        doc, out = d[full], mix(acc + U64(size))
    else:
        doc, out = np.zeros(0, np.int64), np.zeros(0, U64)
    counts = words.counts()
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        first = np.searchsorted(d, short)
        extra = np.zeros(len(short), U64)
        for x, (f, c) in enumerate(zip(first.tolist(), counts[short].tolist(), strict=True)):
            acc = h[f : f + 1].copy()
            for t in range(1, c):
                acc = acc * k + h[f + t : f + t + 1]
            extra[x] = mix(acc + U64(c))[0]
        doc, out = np.concatenate([doc, short]), np.concatenate([out, extra])
        order = np.argsort(doc, kind="stable")
        doc, out = doc[order], out[order]
    return doc, out

"""Token ids by the tokenizers library, of the different white-space separated chunks of many texts.

Where a vocabulary's normaliser and pre-tokenizer never look across a blank or a newline and white space makes no ids, a
text's ids are those of its chunks, one after another.  Texts are taken in slices of about ``SLICE`` bytes, and each different chunk of
a slice is encoded once.  A chunk of plain letters and closing marks goes to the library's BPE model directly, its letters
and its marks each for themselves; every other chunk takes the library's whole path.  Whether a vocabulary is of that kind
is tried on ``TRIALS`` when it is loaded; texts of any other one take the library's whole path.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from arbora.llm import textkit as tk

#: Texts that tell vocabularies apart whose chunks can be encoded alone.
TRIALS = ("Plain words, in Two cases.", " lead  and trail ", "a b\nc\n\nd", "naïve Ünïcode ÀÉ it's 12,5%", "x" * 40 + " Ab aB AB ab.", "don't stop: (now) [here]!", "dogs' ends?! of%%% lines&&&\nmore''", "")
#: Letters and closing marks; the chunk's own blank is behind them.
PLAIN = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-/:-@\[-`{-~]*) ?$"
SLICE = 4 << 20
_BLANK, _NEWLINE = ord(" "), ord("\n")
_encoders: dict[str, Encoder] = {}


def public_path(name: str = "word_bpe_49k.json") -> str:
    """The place of a public vocabulary file; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[int, str]:
    """Byte-level vocabularies show printable bytes as themselves and the others as the characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Known:
    """Ids of words; of more than about ``limit`` words those not asked for lately are forgotten."""

    def __init__(self, encode, limit: int):
        self.encode, self.half = encode, limit // 2
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def of(self, words: list[str]) -> list[bytes]:
        if len(self.new) > self.half:
            self.new, self.old = {}, self.new
        found = list(map(self.new.get, words))
        for k in [k for k, ids in enumerate(found) if ids is None]:
            word = words[k]
            ids = self.old.get(word)
            self.new[word] = found[k] = self.encode(word) if ids is None else ids
        return found


def _words(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def _bytes(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    own = array("I", ids)
    if sys.byteorder == "big":
        own.byteswap()
    return own.tobytes()


def _gather(values: np.ndarray, lengths: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The runs of ``values`` (of these lengths) that are chosen, one after another."""
    own = lengths[chosen]
    begins = (np.cumsum(lengths) - lengths)[chosen]
    return values[np.repeat(begins - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))]


class Encoder:
    def __init__(self, path: str, limit: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.tokenize = self.library.model.tokenize
        self.alphabet = [byte_alphabet()[b] for b in range(256)]
        self.cores = _Known(self._core, limit)
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # an added token must not be part of what goes past the library's whole path, nor reach across chunks
        alone = not any(" " in t or "\n" in t or re.search(PLAIN, "a" + t) for t in added)
        self.by_chunks = alone and all(self._by_chunks(t) == self.whole(t) for t in TRIALS)

    def _core(self, word: str) -> bytes:
        shown = word if word.isascii() else "".join([self.alphabet[b] for b in word.encode()])
        return _bytes([t.id for t in self.tokenize(shown)])

    def whole(self, text: str) -> bytes:
        """The library's own way, for any text."""
        return _bytes(self.library.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; a null is empty."""
        if not text:
            return b""
        return self._by_chunks(text) if self.by_chunks else self.whole(text)

    def encode_all(self, texts: pa.Array, end_id: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of the first text, ids of all, how many each has) for slices of ``texts`` in their order, each text with ``end_id`` behind it."""
        data, offsets = tk.string_buffers(texts)
        for i, j in tk.slices(offsets, SLICE):
            if self.by_chunks:
                ids, lengths = self._slice(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            else:
                parts = [self.encode(t) for t in texts.slice(i, j - i).to_pylist()]
                ids, lengths = np.frombuffer(b"".join(parts), "<u4"), np.array([len(p) // 4 for p in parts], np.int64)
            yield i, np.insert(ids, np.cumsum(lengths), end_id), lengths + 1

    def _by_chunks(self, text: str) -> bytes:
        raw = np.frombuffer(text.encode(), np.uint8)
        return self._slice(raw, np.array([0, len(raw)]))[0].astype("<u4").tobytes()

    def _slice(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each text has) of texts side by side."""
        data = np.where(data == _NEWLINE, np.uint8(_BLANK), data)
        # a chunk ends behind a blank or with its text
        last = data == _BLANK
        last[bounds[1:][bounds[1:] > bounds[:-1]] - 1] = True
        edges = np.concatenate([[0], np.flatnonzero(last) + 1])
        chunks = pa.Array.from_buffers(pa.large_string(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        ids, lengths = self._chunks(chunks.dictionary)
        number = chunks.indices.to_numpy()
        before = np.concatenate([[0], np.cumsum(lengths[number])])[np.searchsorted(edges, bounds)]
        return _gather(ids, lengths, number), np.diff(before)

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each has) of different chunks."""
        plain = pc.extract_regex(chunks, PLAIN)
        odd = pc.is_null(plain).to_numpy(zero_copy_only=False)
        letters = pc.utf8_lower(pc.struct_field(plain, "letters")).drop_null().dictionary_encode()
        marks = pc.struct_field(plain, "marks").drop_null().dictionary_encode()
        parts = self.cores.of(_words(letters.dictionary))
        n = len(parts)
        parts += [self.whole(w) if w else b"" for w in _words(marks.dictionary)]
        m = len(parts)
        parts += [self.whole(w) for w in _words(chunks.filter(pa.array(odd)))]
        lengths = np.array([len(p) // 4 for p in [*parts, b""]], np.int64)
        # letters and marks of each chunk; of an odd one, the whole and nothing
        two = np.full((len(chunks), 2), len(parts))
        two[~odd] = np.column_stack([letters.indices.to_numpy(), n + marks.indices.to_numpy()])
        two[odd, 0] = np.arange(m, len(parts))
        return _gather(np.frombuffer(b"".join(parts), "<u4"), lengths, two.reshape(-1)), lengths[two].sum(axis=1)


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]

"""Exact-substring dedup: shard Burrows-Wheeler transforms, merged by iterative interleave refinement.

Every byte covered by a ``length``-byte string that also starts elsewhere is removed; strings never cross texts.

1. *Parse.*  Windowed minima of byte 8-grams cut texts into phrases.  The cuts depend on nearby content only, so equal
   strings of ``length`` bytes are cut alike but for ``cut_window`` bytes at either end.  A text is then a short string of
   phrases, with a terminator of its own.
2. *Shard transforms.*  Each shard sorts the suffixes of its phrase strings once and keeps the transform: the phrase
   before each suffix, in that order.  Its stable sort leads from each suffix to the one behind its first phrase.
3. *Interleave refinement.*  Suffixes of all shards that begin with the same t phrases are an interval of the merged
   order, and a run of each shard's own order; the interleave is the lengths of these runs, shard by shard.  A round
   takes it from depth t to t + ``STEP``: through its transform, a shard puts phrases before the intervals and sends what
   runs this makes, with their lengths; the merge adds up equal ones of all shards and names the new intervals.
   Intervals with one suffix in all are settled, and so are those long enough.  No suffixes are sorted anew.
4. *Common prefixes.*  The depth at which a suffix's interval was left says how many phrases it shares with another
   suffix; intervals of ``length`` bytes or more are the repeats, and their bytes are covered.
5. *Ends.*  What is left are strings that begin or end within a phrase at the ends of a repeat: the phrases in their
   middle are a repeated interval, but those around them are not.  Runs of such strings with the same middle are looked up
   first, then the strings of those runs that occur again, at ends or not.  Both are compared by 96 bits of two
   polynomials modulo a prime at bases drawn for the run; phrases, in the first round, by BLAKE2b digests of 96 bits.

Messages are packed arrays, dealt by a hash of the interval; a shard sends a run once, so an interval that a third of all
texts share costs one entry a shard.  Shards grow from 1 to 8 MB with the input, for fewer entries.  They are a table
bucketed by shard, so replies join without moving texts again; the number of partitions and of merge groups follows the
bytes of the input.  Rounds end when nothing is left to refine or at ``MAX_DEPTH`` phrases (short phrases, as in runs of
one letter); what is not settled then is counted as an end.

Nulls and empty texts have no bytes.  Texts shorter than ``length`` keep all.  Rows with equal ids or texts are texts
of their own, so a repeated row of ``length`` bytes or more is removed wholly, both times.  Empty tables give empty
results.  Only the id and the text are read.
"""

from __future__ import annotations

import hashlib
import secrets
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm import runtime
from arbora.llm import textkit as tk

GRAM = 8
STEP = 2
MAX_DEPTH = 13
SHARD_BYTES = (1 << 20, 1 << 23)
BUCKET_KEYS = 250_000
#: Phrases are no longer than two windows.
SIZE = "<u2"
#: Digests have 96 bits: three numbers of this kind.
DIGEST, WIDTH = "<u4", 3
#: In a count of a message: someone wants to know whether the interval has two.
LOOK = 4
_POS = np.uint64((1 << 31) - 1)
SHARDS = "shard long, n_phrases long, doc_ids array<long>, lens array<int>, text binary, suffixes binary, transform binary, sizes binary, digests binary"
#: A row without a bucket is the state of a shard, one with a bucket a message.
ROUND = "shard long, bucket int, keys binary, counts binary, deep binary, named binary, names binary, rows binary, runs binary, dealt binary"
MESSAGE = "shard long, bucket int, keys binary, counts binary"
REPLY = "shard long, bucket int, names binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def cut_window(length: int) -> int:
    """A window whose cuts leave whole phrases inside each string of ``length`` bytes, cut alike wherever it stands."""
    return (length - 2 * GRAM) // 4


def _grams(text: np.ndarray) -> np.ndarray:
    """Mixed hash of the 8 bytes from each position on; the last 7 positions are padded with zeros."""
    x = np.zeros(len(text) + GRAM, tk.U64)
    x[: len(text)] = text
    for step in (1, 2, 4):
        x[:-step] |= x[step:] << tk.U64(8 * step)
    return tk.mix(x[: len(text)])


def _window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """Position of the smallest of h[i : i + w] (the first of ties), for each i."""
    n = len(h)
    if n < w:
        return np.zeros(0, np.int64)
    key = (h & ~_POS) | np.arange(n, dtype=tk.U64)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, tk.U64)
    padded[:n] = key
    grid = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return (np.minimum(behind[: n - w + 1], ahead[w - 1 : n]) & _POS).astype(np.int64)


def parse(text: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, text of each) of the phrases of all texts of ``length`` bytes or more."""
    lens, w = np.diff(bounds), cut_window(length)
    smallest = _window_minima(_grams(text), w)
    # only windows inside one text, and that long enough
    inside = np.zeros(len(text) + 1, np.int32)
    long = np.flatnonzero(lens >= length)
    np.add.at(inside, bounds[long], 1)
    np.add.at(inside, bounds[long + 1] - (w + GRAM - 2), -1)
    cuts = np.unique(smallest[(np.cumsum(inside) > 0)[: len(smallest)]])
    starts = np.union1d(cuts, bounds[long])
    return starts, np.searchsorted(bounds, starts, side="right") - 1


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffixes of strings of symbols, each string ending in a terminator (-1); earlier terminators are smaller."""
    n = len(symbols)
    ends = symbols < 0
    rank = symbols.astype(np.int64) + int(ends.sum())
    rank[ends] = np.arange(int(ends.sum()))
    width = int(rank.max(initial=0)) + 2
    behind = 1
    while True:
        second = np.zeros(n, np.int64)
        second[:-behind] = rank[behind:] + 1
        key = rank * width + second
        order = np.argsort(key, kind="stable")
        new = np.ones(n, bool)
        new[1:] = key[order][1:] != key[order][:-1]
        if new.all() or behind >= n:
            return order
        rank[order] = np.cumsum(new) - 1
        width, behind = n + 2, 2 * behind


def with_ends(doc: np.ndarray, values: np.ndarray, end) -> np.ndarray:
    """Values of phrases with one more for the terminator behind each text's last phrase."""
    if not len(doc):
        return values
    return np.insert(values, np.append(np.flatnonzero(doc[1:] != doc[:-1]) + 1, len(doc)), end)


def _build(docs: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    def build(batches) -> Iterator[pa.RecordBatch]:
        number, part = 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets = tk.string_buffers(batch.column(1))
            for i, j in tk.slices(offsets, shard_bytes):
                lens = np.diff(offsets[i : j + 1]).astype(np.int32)
                text = data[offsets[i] : offsets[j]]
                bounds = offsets[i : j + 1] - offsets[i]
                starts, doc = parse(text, bounds, length)
                raw = text.tobytes()
                ends = np.minimum(np.append(starts[1:], len(raw)), bounds[doc + 1])
                ids: dict[bytes, int] = {}
                symbols = np.array([ids.setdefault(raw[a:b], len(ids)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int32)
                symbols = with_ends(doc, symbols, -1)
                order = suffix_order(symbols) if len(symbols) else np.zeros(0, np.int64)
                transform = symbols[order - 1]  # what stands before the first suffix of a text is a terminator
                digests = b"".join([hashlib.blake2b(p, digest_size=4 * WIDTH).digest() for p in ids])
                sizes = np.array([len(p) for p in ids], SIZE)
                doc_ids = pa.array([batch.column(0).slice(i, j - i).to_pylist()], pa.list_(pa.int64()))
                packed = [pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True), order.astype("<u4").tobytes(), transform.astype("<i4").tobytes(), sizes.tobytes(), digests]
                cols = [pa.array([part + number]), pa.array([len(starts)]), doc_ids, pa.array([lens], pa.list_(pa.int32())), *[pa.array([p], pa.binary()) for p in packed]]
                yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in SHARDS.split(", ")])
                number += 1

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(build, SHARDS)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    h = np.zeros(len(keys), tk.U64)
    for c in range(keys.shape[1]):
        h = tk.mix(h ^ keys[:, c].astype(tk.U64))
    return (h % tk.U64(buckets)).astype(np.int64)


def _deal(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, indices of its keys), in a fixed order."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1]))
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(bucket)], strict=True):
        yield int(bucket[order[a]]), order[a:b]


class Shard:
    """The transform of a shard and how far its suffixes are refined.

    ``deep`` is the number of phrases that each suffix shares with another one so far, ``named`` and ``names`` are the
    phrases that occur twice at least.  ``rows`` are the suffixes that the last round was about and ``runs`` their runs,
    for whose intervals names come back, dealt to buckets.
    """

    def __init__(self, row: dict, length: int, kind: str):
        self.length, self.kind = length, kind
        self.transform = np.frombuffer(row["transform"], "<i4")
        self.sizes = np.frombuffer(row["sizes"], SIZE).astype(np.int64)
        self.behind = np.argsort(self.transform, kind="stable")  # the suffix behind the first phrase of each
        self.first = self.transform[self.behind].astype(np.int64)
        n = len(self.transform)
        self.deep = np.frombuffer(row["deep"], np.uint8).copy() if row.get("deep") else np.zeros(n, np.uint8)
        unpack = lambda name, kind: np.frombuffer(row.get(name) or b"", kind)
        self.named, self.names, self.rows, self.runs = unpack("named", "<u4"), unpack("names", kind), unpack("rows", "<u4"), unpack("runs", "<u4")

    def learn(self, depth: int, replies: np.ndarray) -> np.ndarray:
        """Take the names of the intervals at ``depth``; returns that of each suffix, 0 where it is alone."""
        interval = np.zeros(len(self.first), self.kind)
        if depth == 1:
            self.named = np.flatnonzero(replies).astype("<u4")
            self.names = replies[self.named].astype(self.kind)
            phrase = self.first >= 0
            interval[phrase] = replies[self.first[phrase]]
        elif depth > 1:
            interval[self.rows] = replies[self.runs]
        self.deep[interval > 0] = depth
        return interval

    def extend(self, depth: int, interval: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(keys, lengths) of the runs at ``depth``: ``STEP`` phrases put before the intervals of the round before."""
        if depth == 1:
            count = np.bincount(self.first[self.first >= 0], minlength=len(self.sizes))
            self.rows = self.runs = np.zeros(0, "<u4")
            return self.first, np.minimum(count, 2).astype(np.uint8) | LOOK
        name = np.zeros(len(self.sizes) + 1, self.kind)
        name[self.named] = self.names
        rows = np.flatnonzero(interval)
        size, at = np.zeros(len(rows), np.int64), rows
        for _ in range(depth - STEP):
            size += self.sizes[self.first[at]]
            at = self.behind[at]
        rows = rows[size < self.length + self.sizes[self.first[rows]] - 1]
        columns, at = [], rows
        for _ in range(STEP):
            columns.append(name[self.first[at]])
            at = self.behind[at]
        columns.append(interval[at])
        keys = np.column_stack(columns)
        live = (keys > 0).all(axis=1)
        rows, keys = rows[live], keys[live]
        new = np.ones(len(rows), bool)
        new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
        self.rows, self.runs = rows.astype("<u4"), (np.cumsum(new) - 1).astype("<u4")
        return keys[new], np.minimum(np.bincount(self.runs, minlength=int(new.sum())), 2).astype(np.uint8) | LOOK

    def starts(self, lens: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
        """Where each phrase begins, from the lengths of those before it."""
        size = np.zeros(len(suffixes), np.int64)
        phrase = self.first >= 0
        size[suffixes[phrase]] = self.sizes[self.first[phrase]]
        ends = np.ones(len(suffixes), bool)
        ends[suffixes[phrase]] = False
        long = np.flatnonzero(lens >= self.length)
        skipped = (np.cumsum(lens) - lens)[long] - (np.cumsum(lens[long]) - lens[long])
        doc = np.cumsum(ends) - ends
        return (np.cumsum(size) - size)[~ends] + skipped[doc[~ends]]

    def shares(self, starts: np.ndarray, lens: np.ndarray, suffixes: np.ndarray) -> tuple[np.ndarray, Pieces]:
        """(covered bytes, pieces of strings that may be repeated) from the common prefixes of all suffixes."""
        n, length, w = int(lens.sum()), self.length, cut_window(self.length)
        if not len(starts):
            return np.zeros(n, bool), Pieces(*[np.zeros(0, np.int64)] * 4, np.zeros(0, bool))
        bounds = np.concatenate([[0], np.cumsum(lens)])
        doc = np.searchsorted(bounds, starts, side="right") - 1
        final = np.append(np.flatnonzero(doc[1:] != doc[:-1]), len(doc) - 1)
        place = with_ends(doc, starts, -1)
        phrase = place >= 0
        place[~phrase] = bounds[doc[final] + 1]
        deep = np.zeros(len(place), np.int64)
        deep[suffixes] = self.deep
        until = place[np.arange(len(place)) + deep]
        mark = np.zeros(n + 1, np.int32)
        whole = np.flatnonzero(until - place >= length)
        np.add.at(mark, place[whole], 1)
        np.add.at(mark, until[whole], -1)
        covered = np.cumsum(mark[:-1]) > 0
        deep, until = deep[phrase], until[phrase]
        before = np.zeros(n + 2, np.int32)  # phrases that begin before each byte
        before[starts + 1] = 1
        before = np.cumsum(before, dtype=np.int32)
        mark[:] = 0
        long = np.flatnonzero(lens >= length)
        np.add.at(mark, bounds[long], 1)
        np.add.at(mark, bounds[long + 1] - length + 1, -1)
        p = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
        # the phrases in the middle, which are cut alike in all equal strings, are a repeated interval
        first, last = before[p + w - 1], before[p + length - GRAM - w + 2] - 1
        inner = np.minimum(last - first, MAX_DEPTH)
        inner -= (inner - 1) % STEP
        live = deep[first] >= inner
        p, first, last = p[live], first[live], last[live]
        settled = until[before[p + 1] - 1] >= p + length
        new = np.ones(len(p), bool)
        new[1:] = (p[1:] != p[:-1] + 1) | (first[1:] != first[:-1]) | (last[1:] != last[:-1])
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(p)) - 1
        unsettled = np.add.reduceat(~settled, head) > 0 if len(head) else np.zeros(0, bool)
        return covered, Pieces(p[head], p[tail] if len(p) else p, starts[first[head]] - (w - 1), starts[last[head]] + w + GRAM - 1, unsettled)


class Pieces(NamedTuple):
    """Runs of strings (starting at ``lo`` to ``hi``) with the same phrases in the middle, and what all of them hold (``a`` to ``b``)."""

    lo: np.ndarray
    hi: np.ndarray
    a: np.ndarray
    b: np.ndarray
    unsettled: np.ndarray


def _spans(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(covered.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _answers(row: dict, bucket: np.ndarray, kind: str, column: str = "replies") -> np.ndarray:
    """The names that came back for keys dealt to these buckets."""
    out = np.zeros(len(bucket), kind)
    own = {r["bucket"]: r["names"] for r in row[column] or []}
    for k, at in _deal(bucket):
        out[at] = np.frombuffer(own[k], kind)
    return out


def _text(row: dict) -> bytes:
    return pa.decompress(row["text"], sum(row["lens"]), "zstd", asbytes=True) if sum(row["lens"]) else b""


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def _refine(attached: DataFrame, depth: int, buckets: int, length: int, kind: str) -> DataFrame:
    """A round: shards take the names of the intervals of the round before and send their runs at ``depth``."""

    def refine(batches) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            shard = Shard(row, length, kind)
            if depth == 1:
                interval = None
            elif depth == 1 + STEP:
                interval = shard.learn(1, _answers(row, _bucket(np.frombuffer(row["digests"], DIGEST).reshape(-1, WIDTH), buckets), kind))
            else:
                interval = shard.learn(depth - STEP, _answers(row, np.frombuffer(row["dealt"], "<i4"), kind))
            keys, counts = shard.extend(depth, interval)
            if depth == 1:
                keys = np.frombuffer(row["digests"], DIGEST).reshape(-1, WIDTH)
            yield _sent(row["shard"], keys, counts, buckets, shard.deep.tobytes(), shard.named.tobytes(), shard.names.tobytes(), shard.rows.tobytes(), shard.runs.tobytes(), keep=depth > 1)

    return attached.mapInArrow(refine, ROUND)


def _sent(shard: int, keys: np.ndarray, counts: np.ndarray, buckets: int, *state: bytes, keep: bool = True) -> pa.RecordBatch:
    """A shard's state (with the bucket of each key) and its messages."""
    bucket = _bucket(keys, buckets)
    rows = [(shard, None, None, None, *state, bucket.astype("<i4").tobytes() if keep else b"")]
    rows += [(shard, k, keys[at].tobytes(), counts[at].tobytes(), None, None, None, None, None, None) for k, at in _deal(bucket)]
    return _batch(rows, ROUND)


def _ends(attached: DataFrame, depth: int, buckets: int, length: int, kind: str, bases: list[int]) -> DataFrame:
    """The pieces of strings that may be repeated, by digests of what each holds; the state holds the bytes covered so far, as spans."""

    def ends(batches) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            shard = Shard(row, length, kind)
            if depth == 1:
                shard.learn(1, _answers(row, _bucket(np.frombuffer(row["digests"], DIGEST).reshape(-1, WIDTH), buckets), kind))
            else:
                shard.learn(depth, _answers(row, np.frombuffer(row["dealt"], "<i4"), kind))
            lens, suffixes = np.array(row["lens"], np.int64), np.frombuffer(row["suffixes"], "<u4")
            covered, pieces = shard.shares(shard.starts(lens, suffixes), lens, suffixes)
            name, keys, counts = _digests(_text(row), pieces.a, pieces.b, bases)
            looked = np.bincount(name, weights=pieces.unsettled, minlength=len(keys)) > 0
            a, b = _spans(covered)
            yield _sent(row["shard"], keys, np.where(looked, counts, counts ^ LOOK), buckets, *[x.astype("<u4").tobytes() for x in (pieces.hi, a, b, pieces.lo, name)])

    return attached.mapInArrow(ends, ROUND)


def _open_strings(row: dict, kind: str, length: int) -> np.ndarray:
    """Where the strings of the pieces begin that hold an end and occur again."""
    unpack = lambda c: np.frombuffer(row[c], "<u4").astype(np.int64)
    again = _answers(row, np.frombuffer(row["dealt"], "<i4"), kind)[unpack("runs")] > 0
    lo, n = unpack("rows")[again], (unpack("deep") - unpack("rows") + 1)[again]
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _strings(attached: DataFrame, buckets: int, length: int, kind: str, bases: list[int]) -> DataFrame:
    """Messages of the strings of open pieces, one by one."""

    def strings(batches) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            p = _open_strings(row, kind, length)
            _, keys, counts = _digests(_text(row), p, p + length, bases)
            rows = [(row["shard"], k, keys[at].tobytes(), counts[at].tobytes()) for k, at in _deal(_bucket(keys, buckets))]
            if rows:
                yield _batch(rows, MESSAGE)

    return attached.mapInArrow(strings, MESSAGE)


PRIME = (1 << 61) - 1
_M, _31, _30, _61 = tk.U64(PRIME), tk.U64(31), tk.U64(30), tk.U64(61)
_LOW31, _LOW30 = tk.U64((1 << 31) - 1), tk.U64((1 << 30) - 1)
_powers: dict[int, np.ndarray] = {}


def _residue(x: np.ndarray) -> np.ndarray:
    x = (x & _M) + (x >> _61)
    return np.where(x >= _M, x - _M, x)


def multiply(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products modulo ``PRIME`` of numbers below it."""
    x1, x0, y1, y0 = x >> _31, x & _LOW31, y >> _31, y & _LOW31
    middle = x1 * y0 + x0 * y1
    return _residue((x1 * y1 << tk.U64(1)) + (middle >> _30) + ((middle & _LOW30) << _31) + x0 * y0)


def powers(base: int, n: int) -> np.ndarray:
    """The first powers of a base modulo ``PRIME``; kept and grown as needed."""
    table = _powers.get(base, np.ones(1, tk.U64))
    while len(table) < n:
        table = np.concatenate([table, multiply(table, np.full(1, pow(base, len(table), PRIME), tk.U64))])
    _powers[base] = table
    return table


def prints(text: np.ndarray, a: np.ndarray, b: np.ndarray, base: int) -> np.ndarray:
    """A polynomial of the bytes of each span a..b, modulo ``PRIME`` at a base."""
    n, most = len(text), 1 << 40
    up = powers(base, n + 1)
    letters = text.astype(tk.U64) + tk.U64(1)
    high, low = np.zeros(n + 1, tk.U64), np.zeros(n + 1, tk.U64)
    np.cumsum(letters * (up[:n] >> _31), out=high[1:])
    np.cumsum(letters * (up[:n] & _LOW31), out=low[1:])
    h, v = high[b] - high[a], low[b] - low[a]
    value = _residue((h >> _30) + ((h & _LOW30) << _31) + _residue(v))
    # from its place in the text to a common one
    return multiply(multiply(value, up[n - a]), np.full(1, pow(base, most - n, PRIME), tk.U64))


def _digests(text: bytes, a: np.ndarray, b: np.ndarray, bases: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each span's digest, digests, how many spans have each: 1, or 2 for more; all are to be looked at)."""
    if not len(a):
        return np.zeros(0, np.int64), np.zeros((0, WIDTH), DIGEST), np.zeros(0, np.uint8)
    x, y = (prints(np.frombuffer(text, np.uint8), a, b, base) for base in bases)
    order = np.lexsort((y, x))
    new = np.ones(len(a), bool)
    new[1:] = (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])
    name = np.empty(len(a), np.int64)
    name[order] = np.cumsum(new) - 1
    x, y = x[order][new], y[order][new]
    low = tk.U64((1 << 32) - 1)
    keys = np.column_stack([x & low, y & low, x >> tk.U64(32) | (y >> tk.U64(32) & tk.U64(7)) << tk.U64(29)]).astype(DIGEST)
    return name, keys, np.minimum(np.bincount(name), 2).astype(np.uint8) | LOOK


def _rows(batches) -> Iterator[dict]:
    """Rows of batches, one at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield {c: batch.column(i)[k].as_py() for i, c in enumerate(batch.schema.names)}


def _merge(messages: DataFrame, width: int, kind: str, named: str, buckets: int) -> DataFrame:
    """The merged interleave of each bucket: equal keys of all shards are one interval, which is named if it has two suffixes."""

    def merge(own: pd.DataFrame) -> pd.DataFrame:
        sizes = own["counts"].map(len).to_numpy()
        keys = np.frombuffer(b"".join(own["keys"]), kind).reshape(-1, width)
        lengths = np.frombuffer(b"".join(own["counts"]), np.uint8)
        order = np.lexsort(keys.T)
        new = np.ones(len(keys), bool)
        new[1:] = (keys[order][1:] != keys[order][:-1]).any(axis=1)
        interval = np.cumsum(new) - 1
        total = np.bincount(interval, weights=lengths[order] % LOOK) * (np.bincount(interval, weights=lengths[order] // LOOK) > 0)
        numbers = np.arange(len(total)) * buckets + int(own["bucket"].iloc[0]) + 1
        if numbers.max(initial=0) > np.iinfo(named).max:
            raise OverflowError("names of intervals")
        name = np.zeros(len(keys), named)
        name[order] = np.where(total >= 2, numbers, 0)[interval]
        edges = np.concatenate([[0], np.cumsum(sizes)])
        names = [name[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        return pd.DataFrame({"shard": own["shard"], "bucket": own["bucket"], "names": names})

    return messages.groupBy("bucket").applyInPandas(merge, REPLY)


def _replies(messages: DataFrame, width: int, kind: str, named: str, buckets: int, column: str = "replies") -> DataFrame:
    """For each shard, what comes back for its messages, whose keys have ``width`` numbers of ``kind``."""
    replies = _merge(messages.select("shard", "bucket", "keys", "counts"), width, kind, named, buckets)
    return replies.groupBy("shard").agg(F.collect_list(F.struct("bucket", "names")).alias(column))


def _attach(shards: DataFrame, sent: DataFrame, width: int, kind: str, named: str, buckets: int) -> DataFrame:
    """Shards with their state and the replies to their messages."""
    replies = _replies(sent.filter("bucket IS NOT NULL"), width, kind, named, buckets)
    state = sent.filter("bucket IS NULL").drop("bucket", "keys", "counts")
    return shards.join(state, "shard").join(replies, "shard", "left")


def remove_repeats(docs: DataFrame, length: int = 400, shard_bytes: int | None = None) -> DataFrame:
    """One row per text: see ``RESULT``; and ``kept``, the remaining bytes."""
    if cut_window(length) < 2:
        raise ValueError("length is too small for the parse")
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    shard_bytes = shard_bytes or min(max(SHARD_BYTES[0], total >> 13), SHARD_BYTES[1])
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), total >> 25)

    def table(df: DataFrame, tag: str, old: DataFrame | None = None) -> DataFrame:
        """``df`` written in buckets by shard, so that what is dealt by shard stays where it is; ``old`` is needed no more."""
        name = f"arbora_{tag}_{uuid.uuid4().hex[:12]}"
        with runtime.shuffles_removed(spark):
            df.write.bucketBy(parts, "shard").option("path", runtime.scratch_path(spark, tag)).option("parquet.block.size", 32 << 20).saveAsTable(name)
        runtime._tables.append(name)
        if old is not None:
            runtime.drop(spark, old)
        return spark.table(name)

    shards = table(_build(docs, length, shard_bytes), "shards")
    phrases = shards.agg(F.sum("n_phrases").alias("n")).first().n or 0
    buckets = max(16, -(-phrases // BUCKET_KEYS))
    # names of intervals: of four bytes while there are far fewer suffixes
    named = "<u4" if phrases < 1 << 28 else "<u8"

    # drawn anew for each run, so no text can be made to collide
    bases = [secrets.randbelow(PRIME - 1000) + 500 for _ in range(2)]

    sent, depth = None, 1
    while True:
        own = shards.select("shard", "transform", "sizes", *(["digests"] if depth <= 1 + STEP else []))
        blank = [F.lit(None).cast("binary").alias(c) for c in ("deep", "named", "names", "rows", "runs", "dealt")]
        attached = own.select("*", *blank) if sent is None else _attach(own, sent, *((WIDTH, DIGEST) if depth == 1 + STEP else (STEP + 1, named)), named, buckets)
        sent = table(_refine(attached, depth, buckets, length, named), "round", sent)
        if depth >= MAX_DEPTH or sent.filter("bucket IS NOT NULL").isEmpty():
            break
        depth += STEP
    own = shards.select("shard", "lens", "text", "suffixes", "transform", "sizes", *(["digests"] if depth == 1 else []))
    ended = _ends(_attach(own, sent, *((WIDTH, DIGEST) if depth == 1 else (STEP + 1, named)), named, buckets), depth, buckets, length, named, bases)
    sent = table(ended, "ends", sent)
    own = _attach(shards.select("shard", "doc_ids", "lens", "text"), sent, WIDTH, DIGEST, named, buckets)
    # the strings are many and soon made: they are sent from here, and made again where the replies come back
    replies = _replies(_strings(own.drop("doc_ids"), buckets, length, named, bases), WIDTH, DIGEST, named, buckets, "found")

    def finish(batches) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            bounds = np.concatenate([[0], np.cumsum(row["lens"])]).astype(np.int64)
            unpack = lambda c: np.frombuffer(row[c], "<u4").astype(np.int64)  # noqa: B023, E731
            raw, left = _text(row), _open_strings(row, named, length)
            name, keys, _ = _digests(raw, left, left + length, bases)
            left = left[(_answers(row, _bucket(keys, buckets), named, "found") > 0)[name]]
            mark = np.zeros(int(bounds[-1]) + 1, np.int32)
            for at, to in ((unpack("named"), unpack("names")), (left, left + length)):
                np.add.at(mark, at, 1)
                np.add.at(mark, to, -1)
            covered, text = np.cumsum(mark[:-1]) > 0, np.frombuffer(raw, np.uint8)
            out = []
            for d, a, b in zip(row["doc_ids"], bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                gone = covered[a:b]
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                kept = text[a:b][~gone].tobytes() if spans else raw[a:b]
                out.append((d, b - a, int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
            yield _batch(out, RESULT + ", kept binary")

    return own.join(replies, "shard", "left").mapInArrow(finish, RESULT + ", kept binary")


def brute_force(texts: list[tuple[int, str | None]], length: int = 400) -> list[tuple]:
    """Every string of ``length`` bytes in a dictionary, for tests."""
    raw = [(d, (t or "").encode()) for d, t in texts]
    seen: dict[bytes, int] = {}
    for _, t in raw:
        for p in range(len(t) - length + 1):
            seen[t[p : p + length]] = seen.get(t[p : p + length], 0) + 1
    out = []
    for d, t in raw:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out

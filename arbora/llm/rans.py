"""Token-ID output: static range asymmetric numeral systems (rANS) in independent interleaved blocks.

A *segment* is the unit of the file format.  It has one shared frequency table, and blocks of ``LANES`` interleaved
rANS states that can each be decoded alone.  For each block the index holds its place, its states, a checkpoint half
way (states and place again, so decoding can begin there) and the crc32 of the ids of either half.  The whole segment
ends with a crc32.  Documents are listed with their ids and lengths: ``read_documents`` finds some of them and decodes
their blocks only, from the checkpoint on where they begin behind it.

Layout, little-endian: magic, header, symbols, frequencies, id flags, document ids, document lengths, block index,
states, words, crc32.  Segments are rows of a Parquet table (one file for each shard): Spark's writer commits whole
files only, so a lost executor leaves no half-written output.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm import tokens

MAGIC = b"ARNS2\x00\x00\x00"
HEADER = struct.Struct("<IQIIIII")  # documents, ids, symbols, scale bits, lanes, steps, blocks
LANES, STEPS = 64, 512
LOW = np.uint64(1 << 31)
SEGMENT_IDS = 1 << 20
#: ``before``: ids of the same file before the segment.
FILE_SCHEMA = "shard int, before long, n_docs long, n_ids long, data binary"


class CorruptSegment(ValueError):
    pass


def frequencies(counts: np.ndarray, bits: int) -> np.ndarray:
    """Whole frequencies of at least 1 that sum to 2**bits."""
    free = (1 << bits) - len(counts)
    f = 1 + counts.astype(np.int64) * free // max(1, int(counts.sum()))
    f[np.argmax(counts)] += (1 << bits) - int(f.sum())
    return f


def encode_segment(doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One segment from documents' ids in a row; a document id may be None."""
    n = len(ids)
    counts = np.bincount(ids) if n else np.zeros(1, np.int64)
    symbols = np.flatnonzero(counts).astype("<u4")
    steps = min(STEPS, -(-n // LANES)) if n else 0
    blocks = -(-n // (LANES * steps)) if n else 0
    bits = max(18, len(symbols).bit_length() + 2)
    freq = frequencies(counts[symbols], bits).astype("<u4") if n else np.zeros(0, "<u4")
    states, half, half_at, words, sizes, crcs = np.zeros((0, LANES), "<u8"), np.zeros((0, LANES), "<u8"), [], [], [], []
    if n:
        where = np.zeros(len(counts), np.int64)
        where[symbols] = np.arange(len(symbols))
        padded = np.full(blocks * steps * LANES, int(np.argmax(freq)), np.int64)
        padded[:n] = where[ids]
        grid = padded.reshape(blocks, steps, LANES)
        f64 = freq.astype(np.uint64)
        start = (np.cumsum(f64) - f64).astype(np.uint64)
        x = np.full((blocks, LANES), LOW)
        mask = np.zeros((steps, blocks, LANES), bool)
        out = np.zeros((steps, blocks, LANES), "<u4")
        for t in range(steps - 1, -1, -1):
            s = grid[:, t]
            f = f64[s]
            mask[t] = full = x >= f << np.uint64(63 - bits)
            out[t] = x.astype(np.uint32)
            x = np.where(full, x >> np.uint64(32), x)
            q = x // f
            x = (q << np.uint64(bits)) + (x - q * f) + start[s]
            if t == steps // 2:
                half = x.astype("<u8")
        states = x.astype("<u8")
        raw = ids.astype("<u4")
        for b in range(blocks):
            m = mask[:, b]
            words.append(out[:, b][m])
            sizes.append(len(words[-1]))
            half_at.append(int(m[: steps // 2].sum()))
            a, m = b * steps * LANES, b * steps * LANES + steps // 2 * LANES
            crcs.append((zlib.crc32(raw[a:m].tobytes()), zlib.crc32(raw[m : a + steps * LANES].tobytes())))
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    named = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    index = np.array([(n, h, *c) for n, h, c in zip(sizes, half_at, crcs, strict=True)], dtype="<u4").reshape(-1, 4)
    body = b"".join(
        [MAGIC, HEADER.pack(len(doc_ids), n, len(symbols), bits, LANES, steps, blocks), symbols.tobytes(), freq.tobytes(), known.tobytes(), named.tobytes(), np.asarray(lengths, "<u4").tobytes(), index.tobytes(), states.tobytes(), half.tobytes(), *[w.tobytes() for w in words]]
    )
    return body + struct.pack("<I", zlib.crc32(body))


@dataclass
class Segment:
    doc_ids: list
    lengths: np.ndarray
    n_ids: int
    bits: int
    steps: int
    symbols: np.ndarray
    freq: np.ndarray
    index: np.ndarray
    states: np.ndarray
    half: np.ndarray
    words: np.ndarray


def open_segment(data: bytes) -> Segment:
    if len(data) < len(MAGIC) + HEADER.size + 4 or data[: len(MAGIC)] != MAGIC:
        raise CorruptSegment("not a segment")
    if zlib.crc32(memoryview(data)[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise CorruptSegment("checksum of the segment")
    n_docs, n, n_symbols, bits, lanes, steps, blocks = HEADER.unpack_from(data, len(MAGIC))
    at = len(MAGIC) + HEADER.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, dtype=kind, count=count, offset=at)
        at += out.nbytes
        return out

    symbols, freq = take("<u4", n_symbols), take("<u4", n_symbols)
    known, named, lengths = take("u1", n_docs), take("<i8", n_docs), take("<u4", n_docs)
    index = take("<u4", 4 * blocks).reshape(-1, 4)
    states, half = take("<u8", blocks * lanes).reshape(-1, lanes), take("<u8", blocks * lanes).reshape(-1, lanes)
    words = take("<u4", int(index[:, 0].sum()))
    return Segment([d if k else None for d, k in zip(named.tolist(), known.tolist(), strict=True)], lengths, n, bits, steps, symbols, freq, index, states, half, words)


def decode_blocks(seg: Segment, first: int = 0, last: int | None = None, from_half: bool = False) -> np.ndarray:
    """Ids of blocks first..last; with ``from_half`` only those after each block's checkpoint."""
    last = len(seg.index) if last is None else last
    if not seg.n_ids or first >= last:
        return np.zeros(0, "<u4")
    bits, mask = np.uint64(seg.bits), np.uint64((1 << seg.bits) - 1)
    f64 = seg.freq.astype(np.uint64)
    start = np.cumsum(f64) - f64
    slot_of = np.repeat(np.arange(len(f64)), seg.freq)
    place = np.cumsum(seg.index[:, 0].astype(np.int64)) - seg.index[:, 0]
    at = place[first:last].copy()
    x = (seg.half if from_half else seg.states)[first:last].astype(np.uint64)
    begin = seg.steps // 2 if from_half else 0
    if from_half:
        at += seg.index[first:last, 1]
    out = np.empty((last - first, seg.steps - begin, x.shape[1]), "<u4")
    for t in range(seg.steps - begin):
        slot = x & mask
        s = slot_of[slot.astype(np.int64)]
        out[:, t] = seg.symbols[s]
        x = f64[s] * (x >> bits) + slot - start[s]
        need = x < LOW
        rank = np.cumsum(need, axis=1)
        where = (at[:, None] + rank - 1)[need]
        x[need] = (x[need] << np.uint64(32)) | seg.words[where]
        at += rank[:, -1]
    out = out.reshape(-1)
    lanes, size = x.shape[1], seg.steps * x.shape[1]
    edges = [(b * size, b * size + seg.steps // 2 * lanes, (b + 1) * size) for b in range(first, last)]
    shift = first * size
    if from_half:  # each block lacks its first half
        rest = size - seg.steps // 2 * lanes
        for (_, m, e), b in zip(edges, range(first, last), strict=True):
            _check(seg, b, 3, out[(b - first) * rest :][: max(0, min(e, seg.n_ids) - m)])
        return out[: len(out) - max(0, edges[-1][2] - max(seg.n_ids, edges[-1][1]))]
    ids = out[: seg.n_ids - shift]
    for (a, m, e), b in zip(edges, range(first, last), strict=True):
        _check(seg, b, 2, ids[a - shift : m - shift])
        _check(seg, b, 3, ids[m - shift : e - shift])
    return ids


def _check(seg: Segment, block: int, field: int, ids: np.ndarray) -> None:
    if zlib.crc32(ids.tobytes()) != int(seg.index[block, field]):
        raise CorruptSegment(f"checksum of block {block}")


def decode_span(seg: Segment, lo: int, hi: int) -> np.ndarray:
    """Ids lo..hi of the segment, from the blocks that hold them."""
    if lo >= hi:
        return np.zeros(0, "<u4")
    size = seg.steps * seg.states.shape[1]
    first, last = lo // size, -(-hi // size)
    begin = first * size
    half = begin + seg.steps // 2 * seg.states.shape[1]
    if last == first + 1 and lo >= half:
        return decode_blocks(seg, first, last, from_half=True)[lo - half : hi - half]
    return decode_blocks(seg, first, last)[lo - begin : hi - begin]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, text: str = "text", doc_id: str = "doc_id") -> None:
    """Write the ids of all texts (a null is empty), each with ``end_id`` behind it, in ascending order of ``doc_id``.

    Nulls in ``doc_id`` come first; rows with equal ids stay next to each other, in any order, and may go to several
    files, so an id that many rows share is no single task's.  An empty table gives
    a table without segments.  Other columns are not read.
    """

    def segments(batches) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(tokenizer)
        shard, before, names, lengths, parts, held = TaskContext.get().partitionId(), 0, [], [], [], 0

        def flush():
            data = encode_segment(names, np.concatenate(lengths), np.concatenate(parts))
            cols = [pa.array([shard], pa.int32()), pa.array([before], pa.int64()), pa.array([len(names)], pa.int64()), pa.array([held], pa.int64()), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["shard", "before", "n_docs", "n_ids", "data"])

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, ids, own in enc.encode_all(batch.column(1), end_id):
                edges = np.concatenate([[0], np.cumsum(own)])
                i = 0
                while i < len(own):
                    # up to the document that fills the segment
                    j = min(int(np.searchsorted(edges[1:], edges[i] + SEGMENT_IDS - held)) + 1, len(own))
                    names += doc_ids[first + i : first + j]
                    lengths.append(own[i:j])
                    parts.append(ids[edges[i] : edges[j]])
                    held += int(edges[j] - edges[i])
                    i = j
                    if held >= SEGMENT_IDS:
                        yield flush()
                        before, names, lengths, parts, held = before + held, [], [], [], 0
        if names:
            yield flush()

    ordered = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"))
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    ordered.mapInArrow(segments, FILE_SCHEMA).write.option("compression", "none").option("parquet.block.size", 32 << 20).parquet(path)


def _with_starts(spark: SparkSession, path: str) -> DataFrame:
    """(at, data) of each segment; ``at`` counts the ids of all segments before it."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    # one row for each file; their number is that of the write tasks
    before = {r.shard: r.n for r in files.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}
    base, total = [], 0
    for shard in sorted(before):
        base.append((shard, total))
        total += before[shard]
    bases = F.broadcast(spark.createDataFrame(base or [(-1, 0)], "shard int, base long"))
    return files.join(bases, "shard").select((F.col("base") + F.col("before")).alias("at"), "data")


def _decoded(segments: DataFrame, wanted: frozenset | None) -> DataFrame:
    def decode(batches):
        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seg = open_segment(data)
                ends = np.cumsum(seg.lengths.astype(np.int64))
                starts = ends - seg.lengths
                if wanted is None:
                    chosen, raw = range(len(seg.doc_ids)), decode_blocks(seg).astype("<u4").tobytes()
                    ids = [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                else:
                    chosen = [k for k, d in enumerate(seg.doc_ids) if d in wanted]
                    ids = [decode_span(seg, int(starts[k]), int(ends[k])).astype("<u4").tobytes() for k in chosen]
                if len(chosen):
                    chosen = np.array(chosen)
                    cols = [pa.array([seg.doc_ids[k] for k in chosen.tolist()], pa.int64()), pa.array(at + starts[chosen]), pa.array(seg.lengths[chosen].astype(np.int64)), pa.array(ids, pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids"])

    return segments.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, little-endian 32-bit) for each document of the files at ``path``."""
    return _decoded(_with_starts(spark, path), None)


def read_documents(spark: SparkSession, path: str, wanted: list[int | None]) -> DataFrame:
    """The rows of ``read_tokens`` with one of the ``wanted`` ids; a list that is shipped to all tasks."""
    return _decoded(_with_starts(spark, path), frozenset(wanted))

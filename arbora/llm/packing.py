"""Best-fit packing: pieces of documents into sequences under several capacities at once.

Each piece demands a vector (tokens, documents, attention cost = tokens squared); each open sequence has a residual
vector.  Pieces come longest first.  Of the sequences that satisfy every constraint, ``rule`` picks one: ``norm``
the smallest weighted norm of the residual after placing, ``dot`` the largest weighted dot-product of demand and
residual; ties go to the oldest sequence.

Only documents longer than the longest piece that the capacities allow (``Capacity.piece``) are cut, into full pieces
and a last one.  Pieces are dealt to groups of about ``GROUP`` pieces by a hash of their values and their place, so no task grows with the
input, and rows that are repeated however often are dealt out too, and
each group is packed for itself.  Pieces of sequences that were left less full than ``FULL`` are then dealt anew and
packed once more, so what the groups cost is less than one sequence for each group of that second round.

Nulls and empty texts are documents of the end id alone.  Rows with equal ids are packed one by one.  Equal lengths
keep a fixed order (by id and piece).  Empty tables give empty results.  Only the id and the text are read.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm import runtime, tokens

GROUP = 8192
FULL = 0.98
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


@dataclass(frozen=True)
class Capacity:
    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096
    weights: tuple[float, float, float] = (1.0, 0.001, 0.001)
    rule: str = "norm"

    @property
    def piece(self) -> int:
        """The tokens of the longest piece that a sequence can hold."""
        return min(self.tokens, math.isqrt(self.attention))


def cut(docs: DataFrame, tokenizer: str, end_id: int, size: int) -> DataFrame:
    """Pieces of all texts: their ids with ``end_id`` behind, cut after each ``size`` ids."""

    def pieces(batches):
        enc = tokens.encoder(tokenizer)
        names = [c.split()[0] for c in PIECES.split(", ")]
        for batch in batches:
            for first, ids, lengths in enc.encode_all(batch.column(1), end_id):
                count = -(-lengths // size)
                doc = np.repeat(np.arange(len(lengths)), count)
                piece = np.arange(len(doc)) - (np.cumsum(count) - count)[doc]
                length = np.minimum(size, lengths[doc] - size * piece)
                begin = (np.cumsum(lengths) - lengths)[doc] + size * piece
                raw = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
                cols = [batch.column(0).take(pa.array(first + doc)), pa.array(piece, pa.int32()), pa.array(size * piece), pa.array(length), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pieces, PIECES)


def vector_best_fit(lengths: np.ndarray, cap: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) for each piece, in the given order (longest first packs best)."""
    caps = np.array([cap.tokens, cap.documents, cap.attention], dtype=float)
    scale = np.sqrt(np.array(cap.weights)) / caps
    n = len(lengths)
    left = np.empty((3, n + 1))  # residuals of open sequences, packed to the front
    names = np.empty(n + 1, np.int64)
    opened = made = 0
    where, offset = np.empty(n, np.int64), np.empty(n, np.int64)
    least = int(lengths.min()) if n else 0
    for k, length in enumerate(lengths.tolist()):
        need = np.array([length, 1.0, float(length) * length])
        if (need > caps).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacity")
        r = left[:, :opened]
        fits = (r[0] >= need[0]) & (r[1] >= 1) & (r[2] >= need[2])
        at = np.flatnonzero(fits)
        if len(at):
            if cap.rule == "norm":
                score = (((r[:, at] - need[:, None]) * scale[:, None]) ** 2).sum(axis=0)
            else:
                score = -(need[:, None] * r[:, at] * (scale**2)[:, None]).sum(axis=0)
            b = int(at[_first_best(score, names[at])])
        else:
            b = opened
            left[:, b], names[b] = caps, made
            opened, made = opened + 1, made + 1
        where[k], offset[k] = names[b], cap.tokens - left[0, b]
        left[:, b] -= need
        if left[0, b] < least or left[1, b] < 1:  # nothing fits any more
            opened -= 1
            left[:, b], names[b] = left[:, opened], names[opened]
    return where, offset


def _first_best(score: np.ndarray, names: np.ndarray) -> int:
    best = np.flatnonzero(score == score.min())
    return int(best[np.argmin(names[best])])


def _place(pieces: DataFrame, cap: Capacity, groups: int, first: int) -> DataFrame:
    """``pieces`` placed group by group; sequences are numbered from ``first`` on."""
    width = 1 << 32

    def place(own: pa.Table) -> pa.Table:
        own = own.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("start", "ascending")])
        where, offset = vector_best_fit(own["length"].to_numpy(), cap)
        number = first + own["grp"][0].as_py() * width
        return own.drop_columns("grp").append_column("sequence_id", pa.array(number + where)).append_column("offset", pa.array(offset.astype(np.int64)))

    # the row's number in the table deals out equal rows too
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "length", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("grp").applyInArrow(place, PACKED)


def pack(pieces: DataFrame, cap: Capacity, group: int = GROUP) -> DataFrame:
    """Place materialised ``pieces``; adds ``sequence_id`` and ``offset``."""
    groups = max(1, -(-pieces.count() // group))
    placed = _place(pieces, cap, groups, 0)
    if groups == 1:
        return placed
    placed = runtime.materialize(placed, "placed")
    loose = placed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter(F.col("n") < FULL * cap.tokens).select("sequence_id")
    loose = runtime.materialize(placed.join(loose, "sequence_id", "left_semi").select(placed.columns), "loose")
    again = _place(loose.select(*[c.split()[0] for c in PIECES.split(", ")]), cap, max(1, -(-loose.count() // group)), 1 << 62)
    return placed.join(loose.select("sequence_id").distinct(), "sequence_id", "left_anti").select(again.columns).unionByName(again)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, cap: Capacity = Capacity(), group: int = GROUP) -> DataFrame:  # noqa: B008
    """One row per piece: see ``PACKED``.  Pieces are written once, so texts are tokenised once."""
    return pack(runtime.materialize(cut(docs, tokenizer, end_id, cap.piece), "pieces"), cap, group)

"""Substring dedup on words by super-k-mer partitioning.

A window is ``size`` consecutive words of one text.  Its minimiser is the group of ``GRAM`` words in it with the smallest
hash, the leftmost of equal ones.  Consecutive windows that share the place of their minimiser are one super-k-mer.  Two
equal windows have their minimiser at the same place within them, so they meet in the bucket of that minimiser, and no
super-k-mer holds a window twice.

1. Each text gives its super-k-mers: minimiser, a second hash of all the words, first word, number of windows.
2. Buckets with one occurrence in all hold no repeat and are dropped.  Equal super-k-mers (by both hashes, 128 bits)
   are counted by a partial aggregation before they are shuffled; each window of one that comes twice is repeated.
3. Of the buckets with different super-k-mers, one occurrence of each travels as a packed string to its bucket, where
   the windows are sorted and counted exactly.  A bucket of more than ``HOT`` different strings (a passage in as many
   different contexts) is not sorted in one task: its windows are grouped one by one.
4. Repeated windows come back to the occurrences as bit masks, and the words they cover are removed.

The texts are shuffled once, by a 128-bit key of id and text, and that exchange serves all joins with them.  Nothing is
capped: of a third of all rows that are equal, one row's strings travel.  Joins on hot keys are ordinary sort-merge joins,
which Spark splits.

Nulls, empty and blank texts have no words.  Rows with equal id and text give equal results, each in a row of its own, and
repeat each other; so do equal texts under different ids.  Texts of fewer than ``size`` words stay as they are.  Empty tables
give empty results.  Only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

from itertools import accumulate, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.llm import runtime
from arbora.llm import textkit as tk

GRAM = 6
HOT = 512
SPOT = "k1 long, k2 long, mini long, whole long, start int, n int"
STRING = "mini long, whole long, seen long, n int, packed binary"
MASK = "mini long, whole long, mask long"
KEYS = ["k1", "k2"]
BUCKET = ["mini", "whole"]
_K = 0xC2B2AE3D27D4EB4F


def gram_size(size: int) -> int:
    """Words of a minimiser: few, but a mask of 62 bits has to hold the windows that share its place."""
    return max(min(GRAM, size), size - 61)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, tk.U64)
    out[0] = 1
    return np.cumprod(out, dtype=tk.U64)


def super_kmers(w: tk.Words, size: int) -> tuple[np.ndarray, ...]:
    """(document, minimiser, hash of all words, first word within the document, windows) of each super-k-mer."""
    m = gram_size(size)
    h, doc, n = w.hashes, w.doc, len(w.hashes) - size + 1
    if n <= 0:
        return (np.zeros(0, np.int64), np.zeros(0, tk.U64), np.zeros(0, tk.U64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    gram = h[: len(h) - m + 1].copy()
    for x in range(1, m):
        gram = gram * tk.U64(_K) + h[x : len(h) - m + 1 + x]
    gram = tk.mix(gram)
    # a hash with its place in the low bits: the smallest is the leftmost of the smallest
    low = tk.U64(len(gram).bit_length())
    least = (gram >> low << low) | np.arange(len(gram), dtype=tk.U64)
    have = 1
    while have < size - m + 1:
        step = min(have, size - m + 1 - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    place = (least & ((tk.U64(1) << low) - tk.U64(1))).astype(np.int64)
    whole = doc[:n] == doc[size - 1 :]
    head = whole.copy()
    head[1:] &= (place[1:] != place[:-1]) | ~whole[:-1]
    starts = np.flatnonzero(head)
    tails = whole.copy()
    tails[:-1] &= (place[1:] != place[:-1]) | ~whole[1:]
    counts = np.flatnonzero(tails) - starts + 1
    ends = starts + counts + size - 1
    sums = np.concatenate([np.zeros(1, tk.U64), np.cumsum(h * _powers(_K, len(h)), dtype=tk.U64)])
    back = _powers(pow(_K, -1, 1 << 64), len(h))
    name = tk.mix((sums[ends] - sums[starts]) * back[starts] + counts.astype(tk.U64) * tk.U64(0x9E3779B97F4A7C15))
    first = np.searchsorted(doc, np.arange(w.n_docs))
    return doc[starts], gram[place[starts]], name, starts - first[doc[starts]], counts


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(7), "text", "doc_id").alias("k2"))


def _spots(docs: DataFrame, size: int) -> DataFrame:
    def scan(batches):
        names = [c.split()[0] for c in SPOT.split(", ")]
        for batch in batches:
            k1, k2 = (batch.column(c).to_numpy() for c in (0, 1))
            data, offsets = tk.string_buffers(batch.column(2))
            for i, j in tk.slices(offsets):
                doc, mini, whole, start, n = super_kmers(tk.Words(data, offsets, i, j, tk.NONSPACE, lower=False), size)
                cols = [k1[i:j][doc], k2[i:j][doc], mini.view(np.int64), whole.view(np.int64), start.astype(np.int32), n.astype(np.int32)]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), names=names)

    return docs.select("k1", "k2", "text").mapInArrow(scan, SPOT)


def _packed(docs: DataFrame, chosen: DataFrame, size: int) -> DataFrame:
    """The words of chosen super-k-mers, joined by spaces: a row for each."""
    lists = chosen.groupBy(*KEYS).agg(F.collect_list(F.struct("start", "n", "seen", *BUCKET)).alias("spots"))

    def cut(batches):
        seen = set()  # rows that are equal in id and text stand in one partition
        for batch in batches:
            rows: list[tuple] = []
            for key, text, spots in zip(zip(*(batch.column(c).to_pylist() for c in (0, 1)), strict=True), batch.column(2), batch.column(3), strict=True):
                if key in seen:
                    continue
                seen.add(key)
                words = text.as_py().encode().split()
                rows += [(s["mini"], s["whole"], s["seen"], s["n"], b" ".join(words[s["start"] : s["start"] + s["n"] + size - 1])) for s in spots.as_py()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["mini", "whole", "seen", "n", "packed"])

    # the id is taken along so that this exchange of the texts is the one of the last join too
    return docs.join(lists, KEYS).select(*KEYS, "text", "spots", "doc_id").mapInArrow(cut, STRING)


def windows_of(packed: bytes, n: int, size: int) -> list[bytes]:
    """The windows of a packed string, as slices of it."""
    at = [0, *accumulate(len(x) + 1 for x in packed.split(b" "))]
    return [packed[at[i] : at[i + size] - 1] for i in range(n)]


def repeated_in_bucket(strings: list[tuple[int, int, bytes]], size: int) -> list[int]:
    """For each different (occurrences, windows, packed) of a bucket, the windows that come twice or more, as bits."""
    every = sorted((w, r, i) for r, (_, n, packed) in enumerate(strings) for i, w in enumerate(windows_of(packed, n, size)))
    masks = [0] * len(strings)
    for _, same in groupby(every, key=itemgetter(0)):
        own = list(same)
        if len(own) > 1 or strings[own[0][1]][0] > 1:
            for _, r, i in own:
                masks[r] |= 1 << i
    return masks


def _count_buckets(strings: DataFrame, size: int) -> DataFrame:
    def count(batches):
        rows: list[tuple] = []  # of the bucket that may go on in the next batch
        for batch in batches:
            rows += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            last = rows[-1][0] if rows else None
            done, rows = [r for r in rows if r[0] != last], [r for r in rows if r[0] == last]
            yield from masks(done)
        yield from masks(rows)

    def masks(rows):
        out: list[tuple] = []
        for mini, own in groupby(rows, key=itemgetter(0)):
            once = list({r[1]: r for r in own}.values())
            found = repeated_in_bucket([(r[2], r[3], r[4]) for r in once], size)
            out += [(mini, r[1], mask) for r, mask in zip(once, found, strict=True) if mask]
        cols = list(zip(*out, strict=True)) if out else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["mini", "whole", "mask"])

    dealt = strings.select("mini", "whole", "seen", "n", "packed").repartition("mini").sortWithinPartitions("mini", "whole")
    return dealt.mapInArrow(count, MASK)


def _count_windows(strings: DataFrame, size: int) -> DataFrame:
    """The same for hot buckets: windows one by one, grouped by their words."""
    words = F.split(F.col("packed").cast("string"), " ")
    each = lambda w: F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.array_join(F.slice(w, i, size), " "))
    rows = strings.dropDuplicates(BUCKET).withColumn("w", words).select(*BUCKET, "seen", F.posexplode(each(F.col("w"))).alias("i", "window"))
    twice = rows.groupBy("mini", "window").agg(F.sum("seen").alias("c")).filter("c > 1").select("mini", "window")
    return rows.join(twice, ["mini", "window"], "left_semi").groupBy(*BUCKET).agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("mask"))


def repeated_windows(docs: DataFrame, size: int, hot: int = HOT) -> DataFrame:
    """(k1, k2, marks) of the keyed rows that hold repeated windows: (start, mask) of super-k-mers, bit i for the i-th window."""
    spark = docs.sparkSession
    spots = runtime.materialize(_spots(docs, size), "spots")
    # written first, so that the join's two sides are plain exchanges, whose hot keys Spark splits
    shared = runtime.materialize(spots.groupBy("mini").agg(F.count("*").alias("c")).filter("c > 1").select("mini"), "minis")
    kept = runtime.materialize(spots.join(shared, "mini", "left_semi").select(*spots.columns), "shared")
    runtime.drop(spark, spots)
    own = kept.groupBy(*BUCKET).agg(F.count("*").alias("seen"), *[F.first(c).alias(c) for c in (*KEYS, "start", "n")])
    own = runtime.materialize(own, "different")
    different = runtime.materialize(own.groupBy("mini").agg(F.count("*").alias("different")).filter("different > 1"), "buckets")
    travel = own.join(different, "mini")

    def strings(some: Column) -> DataFrame:
        chosen = travel.filter(some)
        return _packed(docs, chosen.select(*KEYS, "start", "n", "seen", *BUCKET), size)

    masks = _count_buckets(strings(F.col("different") <= hot), size).unionByName(_count_windows(strings(F.col("different") > hot), size))
    every = own.filter("seen > 1").select(*BUCKET, F.expr("shiftleft(1L, n) - 1").alias("mask"))
    masks = every.unionByName(masks.join(own.filter("seen > 1").select(*BUCKET), BUCKET, "left_anti"))
    marks = kept.join(masks, BUCKET).select(*KEYS, "start", "mask").distinct()
    return marks.groupBy(*KEYS).agg(F.collect_list(F.struct("start", "mask")).alias("marks"))


def covered(n_words: int, marks: list[dict], size: int) -> np.ndarray:
    """Which words repeated windows cover."""
    edges = np.zeros(n_words + 1, np.int64)
    for m in marks:
        bits, i = m["mask"], m["start"]
        while bits:
            step = (bits & -bits).bit_length() - 1
            i, bits = i + step, bits >> step
            run = (~bits & (bits + 1)).bit_length() - 1  # ones at the low end
            edges[i] += 1
            edges[min(n_words, i + run - 1 + size)] -= 1
            i, bits = i + run, bits >> run
    return np.cumsum(edges[:-1]) > 0


def remove_repeats(docs: DataFrame, size: int = 35, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) of each row of ``docs``."""
    keyed = _keyed(docs)
    marks = repeated_windows(keyed, size, hot)

    def cut(batches):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            rows: list[tuple] = []
            for d, t, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                words = (t.as_py() or "").encode().split()
                n = len(words)
                if own.is_valid:
                    words = [words[i] for i in np.flatnonzero(~covered(n, own.as_py(), size)).tolist()]
                rows.append((d, n, n - len(words), b" ".join(words).decode()))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_words", "n_removed", "kept"])

    return keyed.join(marks, KEYS, "left").select("doc_id", "text", "marks").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, p, array_to_string(w[p:p + 34], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)),
rep AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(p, p + 35)) AS i FROM win SEMI JOIN rep USING (s)),
pos AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM pos ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""

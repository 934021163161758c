"""Periodic run detection with bit-parallel lags.

A text's words get ids in the order in which they first come.  Bit ``b`` of all ids is one big integer (a plane), the word
``i`` at its bit ``i``.  For each lag ``q`` the planes are XORed with themselves shifted by ``q`` and the results ORed:
a zero at bit ``i`` says that the words ``i`` and ``i + q`` are equal.  A run of period ``q`` and length ``l`` is a stretch
of ``l - q`` zeros; ANDs with shifts that double isolate the stretches that are long enough.  Most lags have none, which
shows after a few planes, and the rest are not looked at then.

A run has at least ``REPEATS`` periods and ``LEAST`` words.  Lags go upwards, and a stretch found before has a smaller
period, so each run is taken once, with its smallest period.  Work is a text's words times its lags, 64 at a time.  For
texts of more than ``long_words`` words, a lag is left out where no three neighbouring pairs of every ``q``-th words are
equal: a stretch of ``3 * q`` zeros holds three multiples of ``q``.  This is exact, and work is then n log n and the runs'.

Each text is judged alone, so nothing is shuffled and no text meets another.  Nulls, empty and blank texts have no words
and no runs.  Repeated rows and rows with equal ids give a row each; empty tables give empty results.  Of runs with equal
exponents the one that starts first is the best, then that with the smaller period.  Only the id and the text are read,
so other columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPEATS = 4
LEAST = 6
LONG_WORDS = 1 << 15
RUN = "struct<start:bigint,length:bigint,period:bigint>"
RUNS = f"doc_id long, n_words long, runs array<{RUN}>, best {RUN}, collapsed string"


def planes(ids: np.ndarray) -> list[int]:
    """The bits of word ids as big integers, the lowest first."""
    top = int(ids.max()).bit_length() if len(ids) else 0
    return [int.from_bytes(np.packbits((ids >> b) & 1, bitorder="little").tobytes(), "little") for b in range(top)]


def stretches(ones: int, size: int) -> int:
    """The bits at which ``size`` ones or more follow each other."""
    have = 1
    while have < size and ones:
        step = min(have, size - have)
        ones &= ones >> step
        have += step
    return ones


def _few_match(ids: np.ndarray, q: int) -> bool:
    same = ids[q::q] == ids[:-q:q]
    return not (same[:-2] & same[1:-1] & same[2:]).any()


def find_runs(ids: np.ndarray, long_words: int = LONG_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of word ids, by start and period."""
    n = len(ids)
    bits, found = planes(ids), {}
    mask = (1 << n) - 1
    for q in range(1, n // REPEATS + 1):
        mask >>= 1  # n - q ones
        need = max(LEAST - q, (REPEATS - 1) * q)
        if n - q < need:
            break
        if n > long_words and q > 64 and _few_match(ids, q):
            continue
        differ, at, left = 0, 0, mask
        # two planes first: hardly any lag has a stretch that both allow
        for part in (2, len(bits)):
            for p in bits[at:part]:
                differ |= p ^ (p >> q)
            at = part
            left = stretches(mask & ~differ, need)
            if not left:
                break
        if left:
            on = np.unpackbits(np.frombuffer(left.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little")
            edges = np.diff(on, prepend=0, append=0).astype(np.int8)
            for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True):
                found.setdefault((a, b - a + need - 1 + q), q)
    return sorted((a, length, q) for (a, length), q in found.items())


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exponent (length by period)."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def word_ids(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)


def periodic_runs(docs: DataFrame, change: Callable[[int | None, list[bytes]], list[bytes]] | None = None, long_words: int = LONG_WORDS) -> DataFrame:
    """A row for each row of ``docs``: its id, number of words, all runs, the best one, and the words without repeats.

    A word is dropped where a run holds it behind its first period.  ``change`` may rewrite a text's words first.
    """
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    show = lambda r: dict(zip(("start", "length", "period"), r, strict=True))

    def scan(batches):
        for batch in batches:
            rows: list[tuple] = []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (t.as_py() or "").encode().split()  # at ASCII white space, as bytes have no other
                if change is not None:
                    words = change(d, words)
                runs = find_runs(word_ids(words), long_words)
                keep = words
                if runs:
                    stay = np.ones(len(words), dtype=bool)
                    for a, length, q in runs:
                        stay[a + q : a + length] = False
                    keep = [words[i] for i in np.flatnonzero(stay).tolist()]
                top = best_run(runs)
                rows.append((d, len(words), [show(r) for r in runs], top and show(top), b" ".join(keep).decode()))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.list_(run), run, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_words", "runs", "best", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, RUNS)


def repeat_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's rewriting: of a tenth of the ids, the words from some place on become periodic."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def digest(found: DataFrame) -> DataFrame:
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: A CRC-32 is taken bit by bit from the digits of the id.  Pairs of equal words are grouped to stretches by lag.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
c AS (SELECT *, len(w) AS n, CASE WHEN doc_id IS NULL THEN 1 ELSE xor(4294967295, list_reduce(
    list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda x, t: CASE WHEN t >= 0 THEN xor(x, t) ELSE xor(x >> 1, 3988292384 * (x & 1)) END)) END AS h FROM d),
a AS (SELECT *, h // 10 AS g, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a FROM c),
b AS (SELECT r, doc_id, n, CASE WHEN a = n THEN w ELSE list_concat(w[1:a], list_transform(range(0, n - a), lambda i: w[a + i % (1 + (n - a) // (3 + g % 8)) + 1])) END AS w FROM a),
pos AS (SELECT r, n, unnest(range(0, n)) AS i, unnest(w) AS word FROM b),
eq AS (SELECT x.r, y.i - x.i AS q, x.i FROM pos x JOIN pos y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND y.i - x.i <= x.n // 4),
isl AS (SELECT r, q, min(i) AS s, count(*) AS c FROM (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM eq) GROUP BY r, q, k HAVING count(*) >= greatest(6 - q, 3 * q)),
run AS (SELECT r, s, c + q AS l, min(q) AS q FROM isl GROUP BY r, s, c + q),
lists AS (SELECT r, count(*) AS n_runs, string_agg(concat(s, ',', l, ',', q, chr(10)), '' ORDER BY s, q) AS lines FROM run GROUP BY r),
best AS (SELECT r, s, l, q FROM run x WHERE NOT EXISTS (SELECT 1 FROM run y WHERE y.r = x.r AND (y.l * x.q > x.l * y.q OR y.l * x.q = x.l * y.q AND (y.s < x.s OR y.s = x.s AND y.q < x.q)))),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM run),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS t FROM pos ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(s AS BIGINT) AS start, CAST(l AS BIGINT) AS length, CAST(q AS BIGINT) AS period, CAST(1000 * l // q AS BIGINT) AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM b LEFT JOIN lists USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""

"""Ranked lexical search with block-max pruning over a forward index.

``build_index`` deals neighbouring documents into blocks.  A block holds, for each of its documents, the terms with their
counts (its forward index), and for all of its documents together the greatest impact of each term.  ``search`` bounds
the score that a query can reach in a block by these maxima, takes the blocks of a task by falling bound, and scores
their forward indexes until the bound is less than the query's threshold, the k-th best score so far.  Thresholds begin
at what the block with the highest bound of all gives for each query, so most tasks score few blocks.

Scores are integers: a query's score for a document is the sum over its terms, repeats included, of
``weight * impact``, ``weight = floor(1000 * ln((2 N + 2) / (2 df + 1)))`` and
``impact = (10^9 tf) div (1000 tf + 8 m)``, ``m = 100 - 75 + (75 n N) div L``.  A block whose bound equals the threshold is
scored too, as an equal score may have a smaller id.

The index covers all documents and all terms, whatever the queries.  Terms are known by 64-bit hashes.  Queries go over
the index in chunks of about ``CHUNK`` queries and ``CHUNK_TERMS`` terms, so what is sent to tasks is bounded; a single
query's text has to fit into memory.

Nulls, empty texts and texts without terms are in no block and count for nothing.  Repeated documents are ranked one by
one.  Queries that share id and text are one query; those that share the id only are ranked apart, under the same id.
Equal scores go by ascending ``doc_id``, null ids last.  Empty tables, and queries without hits, give no rows.  Only ids
and texts are read, so other columns cannot clash.  A document of more than ``block_postings`` terms is a block alone.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arbora.llm import runtime
from arbora.llm import textkit as tk

BLOCK_DOCS = 128
BLOCK_POSTINGS = 40_000
LOT = 256
SLICE = 1 << 19  # bytes of texts that are indexed at once, if there are several
CHUNK = 4096
CHUNK_TERMS = 1_000_000
INDEX = "block_id long, doc_ids array<long>, ends binary, terms binary, df binary, slot binary, tf binary, impact binary, maxima binary"


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[k]) for n, k in (part.split() for part in ddl.split(", "))])


def _bytes(a: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes each as the largest needs."""
    top = int(a.max()) if len(a) else 0
    return a.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4").tobytes()


def _numbers(cell: pa.Scalar, n: int) -> np.ndarray:
    """The ``n`` numbers of a cell, as they are stored."""
    raw = cell.as_buffer()
    return np.frombuffer(raw, f"<u{raw.size // max(1, n)}")


def _terms(cell: pa.Scalar) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), "<u8")


def _postings(w: tk.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, count) of each term of each document, by document and term."""
    terms, number = np.unique(w.hashes, return_inverse=True)
    pair, counts = np.unique(w.doc.astype(np.int64) * max(1, len(terms)) + number, return_counts=True)
    return pair // max(1, len(terms)), terms[pair % max(1, len(terms))] if len(terms) else terms, counts


def _block(number: int, ids: list, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, impact: np.ndarray) -> dict:
    """A row of the index: postings of some documents, numbered from 0, each with a term at least."""
    terms, slot, df = np.unique(term, return_inverse=True, return_counts=True)
    ends = np.searchsorted(doc, np.arange(len(ids)), side="right")
    order = np.argsort(slot, kind="stable")
    maxima = np.maximum.reduceat(impact[order], np.cumsum(df) - df)
    numbers = {"ends": ends, "df": df, "slot": slot, "tf": tf, "impact": impact, "maxima": maxima}
    return {"block_id": number, "doc_ids": ids, "terms": terms.astype("<u8").tobytes()} | {k: _bytes(v) for k, v in numbers.items()}


def _blocks(batches, n_docs: int, n_terms: int, block_docs: int, block_postings: int):
    """Blocks of the documents of a task, in the order in which they are read."""
    schema, base, made = _arrow(INDEX), TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        data, offsets = tk.string_buffers(batch.column(1))
        ids = batch.column(0).to_pylist()
        for i, j in tk.slices(offsets, SLICE):
            w = tk.Words(data, offsets, i, j, tk.ALNUM)
            doc, term, tf = _postings(w)
            n = w.counts()
            impact = impacts(tf, n[doc], n_docs, n_terms)
            there = np.flatnonzero(n)
            ends = np.searchsorted(doc, there, side="right")
            rows, a, first = [], 0, 0
            while a < len(there):
                b = int(np.searchsorted(ends, first + block_postings, side="right"))
                b = min(max(b, a + 1), a + block_docs, len(there))
                own = slice(first, int(ends[b - 1]))
                rows.append(_block(base + made, [ids[i + x] for x in there[a:b].tolist()], np.searchsorted(there[a:b], doc[own]), term[own], tf[own], impact[own]))
                made, a, first = made + 1, b, own.stop
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def impacts(tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term that a document of ``length`` terms holds ``tf`` times adds for each unit of weight."""
    if len(length) and 75 * int(length.max()) * n_docs >= 1 << 63:
        m = np.array([25 + 75 * int(x) * n_docs // n_terms for x in length.tolist()], dtype=np.int64)
    else:
        m = 25 + 75 * length.astype(np.int64) * n_docs // n_terms
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def build_index(docs: DataFrame, block_docs: int = BLOCK_DOCS, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """The index as a table in the shared folder: a row for each block.  Documents are read twice: impacts need the totals."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with runtime.small_batches(docs.sparkSession):
        n_docs, n_terms = totals(docs)
        return runtime.materialize(docs.mapInArrow(lambda batches: _blocks(batches, n_docs, n_terms, block_docs, block_postings), INDEX), "index")


def totals(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all their terms with repeats."""

    def count(batches):
        n_docs = n_terms = 0
        for batch in batches:
            data, offsets = tk.string_buffers(batch.column(0))
            for i, j in tk.slices(offsets):
                n = tk.Words(data, offsets, i, j, tk.ALNUM, hashed=False).counts()
                n_docs, n_terms = n_docs + int((n > 0).sum()), n_terms + int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n_docs]), pa.array([n_terms])], names=["n", "l"])

    row = docs.select("text").mapInArrow(count, "n long, l long").agg(F.sum("n").alias("n"), F.sum("l").alias("l")).first()
    return row.n or 0, row.l or 0


class Block:
    """A row of the index: views of its cells."""

    def __init__(self, ids: list, ends: pa.Scalar, terms: pa.Scalar, slot: pa.Scalar, impact: pa.Scalar, maxima: pa.Scalar):
        self.ids, self.terms = ids, _terms(terms)
        self.maxima = _numbers(maxima, len(self.terms))
        ends = _numbers(ends, len(ids))
        self.starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        self.slot, self.impact = _numbers(slot, int(ends[-1])), _numbers(impact, int(ends[-1]))


class Queries:
    """Some queries: distinct terms of each with their repeats, and the distinct terms of all."""

    def __init__(self, rows: list):
        self.terms, number = np.unique(np.concatenate([np.array(r.terms, np.int64).view(np.uint64) for r in rows]), return_inverse=True)
        self.number = number.astype(np.int64)  # of the terms of all queries, one query behind the other
        self.repeats = np.concatenate([np.array(r.repeats, np.int64) for r in rows])
        self.ends = np.cumsum([len(r.terms) for r in rows])
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.weights = np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.ends)

    def weigh(self, df: dict[int, int], n_docs: int) -> None:
        own = np.array([weight(df.get(int(t), 0), n_docs) for t in self.terms.view(np.int64)], dtype=np.int64)
        self.weights = own[self.number] * self.repeats

    def places(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the terms of all queries stand among a block's (sorted as unsigned), and which do."""
        at = np.minimum(np.searchsorted(terms, self.terms), len(terms) - 1)
        return at, terms[at] == self.terms

    def bounds(self, at: np.ndarray, there: np.ndarray, maxima: np.ndarray) -> np.ndarray:
        """The score that no document of a block exceeds, for each query."""
        most = np.where(there, maxima[at].astype(np.int64), 0)
        return np.add.reduceat(self.weights * most[self.number], self.starts)

    def scores(self, q: int, at: np.ndarray, there: np.ndarray, block: Block) -> np.ndarray:
        """The score of each document of a block for a query, from the forward index."""
        own = slice(int(self.starts[q]), int(self.ends[q]))
        number = self.number[own]
        held = there[number]
        by_slot = np.zeros(len(block.terms), np.int64)
        by_slot[at[number[held]]] = self.weights[own][held]
        return np.add.reduceat(by_slot[block.slot] * block.impact, block.starts)


def _query_terms(queries: DataFrame) -> DataFrame:
    """(item_id, terms, repeats) of each query with a term."""

    def split(batches):
        schema = _arrow("item_id long, terms array<long>, repeats array<long>")
        for batch in batches:
            data, offsets = tk.string_buffers(batch.column(1))
            ids, rows = batch.column(0).to_pylist(), []
            for i in range(batch.num_rows):
                terms, repeats = np.unique(tk.Words(data, offsets, i, i + 1, tk.ALNUM).hashes, return_counts=True)
                if len(terms):
                    rows.append({"item_id": ids[i], "terms": terms.view(np.int64), "repeats": repeats})
            yield pa.RecordBatch.from_pylist(rows, schema)

    own = queries.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    return own.mapInArrow(split, "item_id long, terms array<long>, repeats array<long>")


def _document_counts(index: DataFrame, terms: np.ndarray) -> dict[int, int]:
    """The number of documents that hold each of some terms."""

    def count(batches):
        for batch in batches:
            total = np.zeros(len(terms), np.int64)
            for own, df in zip(*batch.columns, strict=True):
                own = _terms(own)
                df = _numbers(df, len(own))
                at = np.minimum(np.searchsorted(own, terms), len(own) - 1)
                total += np.where(own[at] == terms, df[at], 0)
            on = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(terms[on].view(np.int64)), pa.array(total[on])], names=["term", "df"])

    rows = index.select("terms", "df").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r.term: r.df for r in rows.collect()}


def _likeliest_blocks(index: DataFrame, queries: Queries) -> list[int]:
    """The block with the highest bound for each query."""

    def bound(batches):
        best: list[tuple[int, int]] = [(0, -1)] * len(queries)
        for batch in batches:
            for number, terms, maxima in zip(batch.column(0).to_pylist(), *batch.columns[1:], strict=True):
                terms = _terms(terms)
                own = queries.bounds(*queries.places(terms), _numbers(maxima, len(terms)))
                for q in np.flatnonzero(own > np.array([b[0] for b in best])).tolist():
                    best[q] = (int(own[q]), number)
        found = [(q, b, number) for q, (b, number) in enumerate(best) if b]
        cols = list(zip(*found, strict=True)) if found else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["q", "bound", "block_id"])

    rows = index.select("block_id", "terms", "maxima").mapInArrow(bound, "q long, bound long, block_id long")
    top = rows.groupBy("q").agg(F.max(F.struct("bound", "block_id")).alias("top")).select("top.block_id").distinct()
    return sorted(r.block_id for r in top.collect())


def _keep(best: list[tuple], scores: np.ndarray, ids: list, least: int, k: int) -> int:
    """Put documents that reach ``least`` among the best, and give the new threshold."""
    for x in np.flatnonzero((scores >= least) & (scores > 0)).tolist():
        d = ids[x]
        best.append((-int(scores[x]), d is None, d if d is not None else 0))
    best.sort()
    del best[k:]
    return max(least, -best[-1][0]) if len(best) == k else least


def _score(index: DataFrame, queries: Queries, thresholds: np.ndarray, k: int) -> DataFrame:
    """(q, doc_id, score, scored): the best documents of each task for each query, and how many blocks it scored."""

    def run(batches):
        best: list[list[tuple]] = [[] for _ in range(len(queries))]
        least, scored = thresholds.copy(), np.zeros(len(queries), np.int64)
        # some blocks at a time, by falling bound; thresholds go on from one lot to the next
        for batch in (b.slice(at, LOT) for b in batches for at in range(0, b.num_rows, LOT)):
            blocks = [Block(*cells) for cells in zip(batch.column(0).to_pylist(), *batch.columns[1:], strict=True)]
            placed = [queries.places(b.terms) for b in blocks]
            bounds = np.array([queries.bounds(*p, b.maxima) for p, b in zip(placed, blocks, strict=True)]).reshape(len(blocks), len(queries))
            for q in range(len(queries)):
                for x in np.argsort(-bounds[:, q], kind="stable").tolist():
                    if bounds[x, q] < least[q] or not bounds[x, q]:
                        break
                    least[q] = _keep(best[q], queries.scores(q, *placed[x], blocks[x]), blocks[x].ids, int(least[q]), k)
                    scored[q] += 1
        rows = [(q, None if blank else d, -s, int(scored[q])) for q, own in enumerate(best) for s, blank, d in own]
        cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["q", "doc_id", "score", "scored"])

    own = index.select("doc_ids", "ends", "terms", "slot", "impact", "maxima")
    return own.mapInArrow(run, "q long, doc_id long, score long, scored long")


def _thresholds(index: DataFrame, queries: Queries, k: int) -> np.ndarray:
    """A score that at least k documents reach, for each query: from the blocks with the highest bounds."""
    out = np.zeros(len(queries), np.int64)
    blocks = _likeliest_blocks(index, queries)
    if not blocks:
        return out
    found = _score(index.filter(F.col("block_id").isin(blocks)), queries, out, k)
    place = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score")))
    for r in found.withColumn("place", place).filter(F.col("place") == k).select("q", "score").collect():
        out[r.q] = r.score
    return out


def search(index: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each query, those with a score above 0."""
    spark: SparkSession = index.sparkSession
    n_docs = index.agg(F.sum(F.size("doc_ids"))).first()[0] or 0
    split = runtime.materialize(_query_terms(queries), "queries")
    sizes = split.agg(F.count("*").alias("n"), F.sum(F.size("terms")).alias("t")).first()
    chunks = max(math.ceil(sizes.n / CHUNK), math.ceil((sizes.t or 0) / CHUNK_TERMS))
    dealt = split.withColumn("chunk", F.pmod(F.xxhash64("item_id", "terms"), F.lit(max(1, chunks))))
    parts = []
    for c in range(chunks if n_docs else 0):
        rows = dealt.filter(F.col("chunk") == c).select("item_id", "terms", "repeats").collect()
        if not rows:
            continue
        own = Queries(rows)
        own.weigh(_document_counts(index, own.terms), n_docs)
        with runtime.small_batches(spark):  # a row for each query, task and place at most
            found = runtime.materialize(_score(index, own, _thresholds(index, own, k), k), "found")
        names = spark.createDataFrame([(q, r.item_id) for q, r in enumerate(rows)], "q long, item_id long")
        parts.append(found.join(F.broadcast(names), "q").select(F.lit(c).alias("chunk"), "q", "item_id", "doc_id", "score"))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    place = F.row_number().over(W.partitionBy("chunk", "q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return every.withColumn("rank", place.cast("int")).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
tot AS (SELECT count(*) AS bn, CAST(sum(len(w)) AS BIGINT) AS bl FROM d WHERE len(w) > 0),
qt AS (SELECT i, item_id, t, count(*) AS c FROM (SELECT i, item_id, unnest(w) AS t FROM q) GROUP BY ALL),
tf AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM qt) GROUP BY ALL),
df AS (SELECT t, CAST(floor(1000 * ln((2 * bn + 2) / (2 * count(*) + 1))) AS BIGINT) AS wt FROM tf, tot GROUP BY t, bn),
sc AS (SELECT i, item_id, r, doc_id, CAST(sum(c * wt * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * bn) // bl)))) AS BIGINT) AS score
  FROM qt JOIN tf USING (t) JOIN df USING (t), tot GROUP BY i, item_id, r, doc_id),
ra AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS k FROM sc WHERE score > 0)
SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score FROM ra WHERE k <= 10
"""

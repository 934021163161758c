"""Benchmark decontamination by winnowing, in DataFrame functions only.

Fingerprints: hashes of ``k`` consecutive words; of each ``window - k + 1`` consecutive ones the smallest is kept.
A span of ``window`` shared words holds the same run of hashes in both texts and so the same smallest one: no such
span is missed.  Texts and items that share a fingerprint are then extended: each run of ``window`` words of such a
text is compared (by two 64-bit hashes) with the runs of the items, and the runs found cover the words that are hit.

Items of fewer than ``window`` words, but some, are one run of their own length.  Up to ``SHORT`` of them are looked up in
the pass that makes the fingerprints: a place counts where its word begins a short item and the hash of the run from there
is one of theirs, and only such runs leave the text's row.  Beyond ``SHORT``, all runs of these lengths are joined with them.  Hits are found against distinct runs; items are named after that, once for each text and run.

Fingerprints and the extension take the same words, with A-Z lower-cased and nothing else changed: a lower-casing of
whole texts gives some letters (the Greek capital sigma) by what follows the word.  Nulls have no words.  Rows that share an id but not the text are judged apart; rows
that share both give equal results.  Empty tables: no hits, or no rows.  Only ids and texts are read, so other
columns cannot clash.  No join is hinted: Spark broadcasts the items' side only while it is small by its statistics,
and splits skewed partitions of a sort-merge join otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arbora.llm import runtime

#: Items of fewer words than a window that are sent to all tasks: a hash and a word for each.
SHORT = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often the lambda names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def split_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), NOT_WORD), lambda w: w != "")


def runs(hashes: Column, size: int, step=None) -> Column:
    """Hash of each ``size`` consecutive entries of an array of longs."""
    at = F.sequence(F.lit(0), F.size(hashes) - size)
    every = F.transform(at, lambda i: F.xxhash64(*[F.get(hashes, i + t) for t in range(size)]))
    return F.when(F.size(hashes) >= size, every).otherwise(F.array().cast("array<bigint>"))


def _lower_of(step: int):
    """Each entry of an array or that ``step`` places behind it, whichever is less."""
    return lambda a: F.zip_with(a, F.slice(a, F.lit(step + 1), F.size(a)), lambda x, y: F.least(x, y))


def winnow(words: Column, k: int, window: int) -> Column:
    """Fingerprints of an array of words; empty for fewer than ``window`` words."""
    w = window - k + 1

    def smallest(grams: Column) -> Column:
        # the least of 1, 2, 4, ... and at last w entries from each place on; null, beyond the end, counts for nothing
        least, have = grams, 1
        while have < w:
            step = min(have, w - have)
            least = let(least, _lower_of(step))
            have += step
        kept = F.array_distinct(F.slice(least, F.lit(1), F.size(grams) - w + 1))
        return F.when(F.size(grams) >= w, kept).otherwise(F.array().cast("array<bigint>"))

    hashed = F.transform(words, lambda x: F.xxhash64(x))
    return let(hashed, lambda h: let(runs(h, k), smallest))


def word_runs(words: Column, size: int) -> Column:
    """(start, a, b) for each run of ``size`` words: two hashes of the words."""
    at = F.sequence(F.lit(1), F.size(words) - size + 1)

    def run(i: Column) -> Column:
        own = F.slice(words, i, size)
        return F.struct((i - 1).alias("start"), F.xxhash64(own).alias("a"), F.xxhash64(F.lit(7), own).alias("b"))

    return F.when(F.size(words) >= size, F.transform(at, run)).otherwise(F.array().cast("array<struct<start:int,a:bigint,b:bigint>>"))


def short_runs(words: Column, items: list) -> Column:
    """(size, start, a, b) of the runs of ``words`` that equal one of ``items`` (first word, size and hashes) in size and hashes."""
    none = F.array().cast("array<struct<size:int,start:int,a:bigint,b:bigint>>")
    firsts = sorted({r.first for r in items})
    places = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: F.get(words, i - 1).isin(*firsts))

    def of_size(at: Column, n: int) -> Column:
        hashes = sorted({r.a for r in items if r.size == n})
        own = lambda i: F.slice(words, i, n)
        found = F.filter(at, lambda i: (i + n - 1 <= F.size(words)) & F.xxhash64(own(i)).isin(*hashes))
        return F.transform(found, lambda i: F.struct(F.lit(n).alias("size"), (i - 1).alias("start"), F.xxhash64(own(i)).alias("a"), F.xxhash64(F.lit(7), own(i)).alias("b")))

    sizes = sorted({r.size for r in items})
    # lambdas in a list: each with its own size
    every = let(places, lambda at: F.concat(*[of_size(at, n) for n in sizes]))
    return F.when(F.size(words) > 0, every).otherwise(none)


def exact_words(text: Column) -> Column:
    """Words with A-Z lower-cased and nothing else changed."""
    return split_words(F.translate(text, UPPER, LOWER))


def _row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, k: int = 5) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted item ids as strings), contaminated, for each row of ``docs``."""
    return _judge(docs, benchmark, window, k).drop("row_key")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, k: int = 5) -> DataFrame:
    """``docs`` without the contaminated rows; columns stay as they are."""
    bad = _judge(docs, benchmark, window, k).filter("contaminated").select(F.col("row_key").alias("_bad")).distinct()
    return docs.join(bad, _row_key() == F.col("_bad"), "left_anti")


def _judge(docs: DataFrame, benchmark: DataFrame, window: int, k: int) -> DataFrame:
    docs = docs.select("doc_id", "text")
    items = benchmark.select("item_id", exact_words(F.col("text")).alias("words")).filter("item_id IS NOT NULL AND size(words) > 0")
    few = items.filter(F.size("words") < window).select("words", F.explode(_runs(lambda w, n: F.size(w) == n, range(1, window))).alias("run"))
    few = few.select("run.size", "run.a", "run.b", F.get("words", F.lit(0)).alias("first")).distinct().limit(SHORT + 1).collect()
    within = 0 < len(few) <= SHORT

    split = docs.select("doc_id", _row_key().alias("row_key"), exact_words(F.col("text")).alias("words"))
    short = short_runs(F.col("words"), few) if within else F.array().cast("array<struct<size:int,start:int,a:bigint,b:bigint>>")
    marked = split.select("doc_id", "row_key", F.size("words").alias("n_words"), winnow(F.col("words"), k, window).alias("prints"), short.alias("short"))
    marked = runtime.materialize(marked, "prints")
    item_prints = (
        benchmark.select(exact_words(F.col("text")).alias("words"))
        .select(F.explode(winnow(F.col("words"), k, window)).alias("print"))
        .distinct()
    )
    suspects = marked.select("row_key", F.explode("prints").alias("print")).join(item_prints, "print", "left_semi").select("row_key").distinct()

    texts = docs.withColumn("row_key", _row_key())
    own = texts.join(suspects, "row_key", "left_semi").dropDuplicates(["row_key"]).select("row_key", exact_words(F.col("text")).alias("words"))
    sizes = [*sorted({r.size for r in few} if within else range(1, window) if few else []), window]
    of_items = items.select("item_id", F.explode(_runs(lambda w, n: F.size(w) >= n if n == window else F.size(w) == n, sizes)).alias("run"))
    of_items = runtime.materialize(of_items.select("item_id", "run.size", "run.a", "run.b").distinct(), "runs")
    of_texts = own.select("row_key", F.explode(_runs(lambda w, n: F.lit(True), [window])).alias("run"))
    if within:
        of_texts = of_texts.unionByName(marked.select("row_key", F.explode("short").alias("run")))
    elif few:
        whole = texts.select("row_key", exact_words(F.col("text")).alias("words"))
        of_texts = of_texts.unionByName(whole.select("row_key", F.explode(_runs(lambda w, n: F.lit(True), sizes[:-1])).alias("run")))
    keys = ["size", "a", "b"]
    hits = of_texts.select("row_key", "run.*").join(of_items.select(*keys).distinct(), keys, "left_semi").distinct()
    hits = runtime.materialize(hits.withColumn("end", F.col("start") + F.col("size")), "hits")

    in_order = W.partitionBy("row_key").orderBy("start", "end")
    before = F.max("end").over(in_order.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(before, F.col("start"))))
    covered = hits.select("row_key", fresh.alias("fresh")).groupBy("row_key").agg(F.sum("fresh").alias("n_hit"))
    pairs = hits.select("row_key", *keys).distinct().join(of_items, keys).select("row_key", F.col("item_id").cast("string").alias("item"))
    named = pairs.groupBy("row_key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = covered.join(named, "row_key")
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    n_words = F.col("n_words").cast("long")
    items_found = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return marked.select("doc_id", "row_key", "n_words").join(found, "row_key", "left").select(
        "doc_id",
        "row_key",
        n_words.alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(items_found).cast("long").alias("n_items"),
        items_found.alias("items"),
        ((n_hit > 0) & (20 * n_hit >= n_words)).alias("contaminated"),
    )


def _runs(ok, sizes) -> Column:
    """All runs of ``words`` of these sizes (where ``ok(words, size)``), with their size."""

    def of(w: Column) -> Column:
        none = F.array().cast("array<struct<size:int,start:int,a:bigint,b:bigint>>")
        sized = lambda n: F.transform(word_runs(w, n), lambda r: F.struct(F.lit(n).alias("size"), r["start"].alias("start"), r["a"].alias("a"), r["b"].alias("b")))
        return F.concat(*[F.when(ok(w, n), sized(n)).otherwise(none) for n in sizes])

    return let(F.col("words"), of)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE_SQL = r"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
items AS (SELECT item_id, w, least(len(w), 13) AS n FROM bw WHERE len(w) > 0),
iwin AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM items)),
sizes AS (SELECT DISTINCT n FROM items),
dwin AS (SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dw, sizes WHERE len(w) >= n)),
hit AS (SELECT r, dwin.n, p, item_id FROM dwin JOIN iwin ON dwin.n = iwin.n AND dwin.s = iwin.s),
cov AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hit) GROUP BY r),
nam AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN cov USING (r) LEFT JOIN nam USING (r)
"""

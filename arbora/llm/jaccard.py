"""N-gram Jaccard join over a prefix tree.

Sets are the hashes of word n-grams, globally ordered rarest first (by a count sketch over all texts, then by hash).

1. One pass hashes all sets; texts with equal sets become one class, so exact copies cost one row each.
2. Prefix filter: sets that reach the threshold share a token among their first ``n - ceil(t * n) + 1``.
3. *Stars*: per shared token, each class is paired with the smallest set of compatible size that has the token; its
   most frequent such partner becomes its hub.  Hubs and their classes meet in blocks of at most ``BLOCK`` sets.
4. In a block, sets are stored in a prefix tree.  Each set walks the tree once, sharing the overlaps counted on the
   way, and leaves a subtree when its overlap plus the shorter remainder cannot reach the threshold.
5. *Neighbours*: each class is verified with the few classes of other components that most often stand next to it
   when a token's classes are in the order of size.
6. *The rest*: classes that share a prefix token but are in different components so far are paired, filtered by
   length, position and parity bitmaps (a lower bound of the symmetric difference: 128 bits in the join, all bits
   after it), and verified in blocks too.  A pair meets at the first of each run of tokens that both have in a row.
   So every link between components is looked at; links inside one component cannot change the result.

Only connected components are returned, so near-copies need no quadratic list of pairs.  Hashes of 64 bits find
candidates; every link that joins two classes is confirmed on the words themselves, and a block in which one is not
takes shingles instead of hashes.  Classes are equal sets by one hash, checked by a second, independent one; where they
disagree, everything is done anew with other hashes.  A token that more than ``HOT`` texts have is dealt to several
tasks, whose first classes then meet among themselves.

Nulls and empty texts have the empty set and link with nothing.  Rows with a null id take part, and a component's id
is its smallest id that is not null.  Repeated rows are equal sets.  Empty tables give empty results.  Only the id
and the text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arbora.llm import components, runtime
from arbora.llm import textkit as tk

BLOCK = 512
HOT = 1024
SKETCH_BITS = 20
SKETCH_PARTS = 16
BITMAP_BITS = 1024
_U = tk.U64


def need_overlap(a: np.ndarray | int, b: np.ndarray | int, percent: int):
    """The least intersection of sets of these sizes with 100 * intersection >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def doc_sets(data: np.ndarray, offsets: np.ndarray, i: int, j: int, size: int, counts: np.ndarray | None = None, seed: int = 0, twin: bool = False):
    """(doc, hash) of the distinct shingles of texts i..j, by doc and then in the global order; with ``twin`` a second hash, too."""
    words = tk.Words(data, offsets, i, j, tk.NONSPACE, seed)
    doc, h = tk.shingles(words, size)
    c = np.zeros(len(h), np.int64) if counts is None else counts[bucket(h)]
    order = np.lexsort((h, c, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    if twin:
        _, other = tk.shingles(words, size, words.span_hash(words.starts, words.ends, seed + 1))
        return doc[new], h[new], other[order][new]
    return doc[new], h[new]


def exact_set(text: str | None, size: int) -> set[tuple[bytes, ...]]:
    """The shingles themselves."""
    words = (text or "").encode().lower().split()
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(size)), strict=False))


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> _U(64 - SKETCH_BITS)).astype(np.int64)


def set_class(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each whole set (a sum of mixed hashes, so order does not matter)."""
    return tk.mix(np.add.reduceat(tk.mix(h ^ _U(0xA5A5A5A5A5A5A5A5)), starts)).view(np.int64)


def bitmaps(doc: np.ndarray, h: np.ndarray, n_docs: int) -> np.ndarray:
    """Parities of the number of hashes in each of ``BITMAP_BITS`` cells, packed."""
    cell = doc * BITMAP_BITS + (h & _U(BITMAP_BITS - 1)).astype(np.int64)
    return np.packbits((np.bincount(cell, minlength=n_docs * BITMAP_BITS) & 1).astype(bool).reshape(n_docs, BITMAP_BITS), axis=1)


_DIGEST = "doc_id long, key long, n long, cls long, twin long, bitmap binary, fold_a long, fold_b long, part int, counts binary"


def digest_sets(docs: DataFrame, size: int, seed: int) -> DataFrame:
    """A row per text (n, class, second hash of the class, bitmap) and, with ``part`` set, the pieces of each task's count sketch."""

    def digest(batches) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _DIGEST.split(", ")]
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            data, offsets = tk.string_buffers(batch.column(2))
            for i, j in tk.slices(offsets):
                doc, h, other = doc_sets(data, offsets, i, j, size, seed=seed, twin=True)
                sketch += np.bincount(bucket(h), minlength=len(sketch))
                n = np.bincount(doc, minlength=j - i)
                full = np.flatnonzero(n)
                cls, twin = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64)
                if len(full):
                    cls[full] = set_class(h, (np.cumsum(n) - n)[full])
                    twin[full] = set_class(other, (np.cumsum(n) - n)[full])
                bits = bitmaps(doc, h, j - i)
                fold = np.bitwise_xor.reduce(bits.view(np.int64).reshape(j - i, -1, 2), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(cls), pa.array(twin), pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(fold[:, 0]), pa.array(fold[:, 1]), pa.nulls(j - i, pa.int32()), pa.nulls(j - i, pa.binary())], names=names
                )
        if sketch.any():
            pieces = [zlib.compress(p.astype("<u4").tobytes(), 1) for p in np.split(sketch, SKETCH_PARTS)]
            nothing = pa.nulls(SKETCH_PARTS, pa.int64())
            yield pa.RecordBatch.from_arrays([nothing, nothing, nothing, nothing, nothing, pa.nulls(SKETCH_PARTS, pa.binary()), nothing, nothing, pa.array(range(SKETCH_PARTS), pa.int32()), pa.array(pieces, pa.binary())], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("key"), "text").mapInArrow(digest, _DIGEST)


def sketch_counts(digests: DataFrame) -> np.ndarray:
    """The sketch of all texts: an array of fixed size, whatever the input."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for frame in batches:
            for part, raw in zip(frame["part"], frame["counts"], strict=True):
                own = np.frombuffer(zlib.decompress(raw), "<u4").astype(np.int64)
                total[part] = total.get(part, 0) + own
        if total:
            yield pd.DataFrame({"part": list(total), "counts": [zlib.compress(v.tobytes(), 1) for v in total.values()]})

    def merge(own: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(raw), "<i8") for raw in own["counts"])
        return pd.DataFrame({"part": own["part"][:1], "counts": [np.asarray(total).tobytes()]})

    pieces = digests.filter("part IS NOT NULL").select("part", "counts")
    local = pieces.mapInPandas(add, "part int, counts binary")
    # SKETCH_PARTS rows
    rows = local.groupBy("part").applyInPandas(merge, "part int, counts binary").collect()
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    width = len(out) // SKETCH_PARTS
    for r in rows:
        out[r.part * width : (r.part + 1) * width] = np.frombuffer(r.counts, "<i8")
    return out


def prefixes(docs: DataFrame, counts, size: int, percent: int, seed: int) -> DataFrame:
    """(token, cls, n, pos, salts, salt) for the prefix of each class; a task emits a class once.

    A token of many texts has several ``salts``, and a class one of them.
    """
    hot = HOT

    def emit(batches) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            data, offsets = tk.string_buffers(batch.column(0))
            for i, j in tk.slices(offsets):
                doc, h = doc_sets(data, offsets, i, j, size, counts.value, seed)
                if not len(h):
                    continue
                n = np.bincount(doc, minlength=j - i)
                full = np.flatnonzero(n)
                starts = (np.cumsum(n) - n)[full]
                cls = np.zeros(j - i, np.int64)
                cls[full] = set_class(h, starts)
                fresh = np.zeros(j - i, bool)
                for d, c in zip(full.tolist(), cls[full].tolist(), strict=True):
                    if c not in seen:
                        seen.add(c)
                        fresh[d] = True
                if len(seen) > 1_000_000:
                    seen.clear()
                first = np.zeros(j - i, np.int64)
                first[full] = starts
                pos = np.arange(len(h)) - first[doc]
                keep = fresh[doc] & (pos <= (n - -(-percent * n // 100))[doc])
                d = doc[keep]
                salts = counts.value[bucket(h[keep])] // hot + 1
                salt = (tk.mix(cls[d].view(_U)) % salts.astype(_U)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(cls[d]), pa.array(n[d].astype(np.int32)), pa.array(pos[keep].astype(np.int32)), pa.array(salts.astype(np.int32)), pa.array(salt)], names=["token", "cls", "n", "pos", "salts", "salt"])

    return docs.select("text").mapInArrow(emit, "token long, cls long, n int, pos int, salts int, salt int")


class PrefixTree:
    """Sets as ascending integer arrays; a node holds a run of tokens."""

    __slots__ = ("ends", "kids", "least", "most", "run", "size")

    def __init__(self, run: np.ndarray):
        self.run, self.kids, self.ends = run, {}, []
        self.least, self.most, self.size = 1 << 60, 0, 0

    def insert(self, tokens: np.ndarray, name: int) -> None:
        node, rest, total = self, tokens, len(tokens)
        while True:
            node.least, node.most, node.size = min(node.least, total), max(node.most, total), node.size + 1
            if not len(rest):
                node.ends.append(name)
                return
            kid = node.kids.get(int(rest[0]))
            if kid is None:
                kid = node.kids[int(rest[0])] = PrefixTree(rest)
                kid.least = kid.most = total
                kid.size, kid.ends = 1, [name]
                return
            m = min(len(kid.run), len(rest))
            differ = kid.run[:m] != rest[:m]
            same = int(np.argmax(differ)) if differ.any() else m
            if same < len(kid.run):  # split the node
                low = PrefixTree(kid.run[same:])
                low.kids, low.ends, low.least, low.most, low.size = kid.kids, kid.ends, kid.least, kid.most, kid.size
                kid.run, kid.kids, kid.ends = kid.run[:same], {int(low.run[0]): low}, []
            node, rest = kid, rest[same:]

    def search(self, x: np.ndarray, has: np.ndarray, percent: int, skip) -> Iterator[int]:
        """Names of stored sets that reach the threshold with x; ``skip(name)`` sets are passed over."""
        stack = [(kid, 0, 0) for kid in self.kids.values()]
        n = len(x)
        while stack:
            node, overlap, depth = stack.pop()
            if node.size == 1 and node.ends and skip(node.ends[0]):
                continue
            if 100 * min(n, node.most) < percent * max(n, node.least):
                continue
            need = need_overlap(n, max(node.least, -(-percent * n // 100)), percent)
            dead = False
            for at in range(0, len(node.run), 64):
                part = node.run[at : at + 64]
                overlap += int(has[part].sum())
                depth += len(part)
                if overlap + min(n - int(np.searchsorted(x, part[-1], side="right")), node.most - depth) < need:
                    dead = True
                    break
            if dead:
                continue
            for name in node.ends:
                if 100 * overlap >= percent * (n + depth - overlap):
                    yield name
            stack += [(kid, overlap, depth) for kid in node.kids.values()]


def join_block(sets: list[np.ndarray], counts: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Links among these sets of hashes (or, with ``counts`` None, of small numbers): a spanning forest of their groups."""
    every = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
    order = np.arange(len(every)) if counts is None else np.lexsort((every, counts[bucket(every)]))
    rank = np.empty(len(every), np.int64)
    rank[order] = np.arange(len(every))
    local = [np.sort(rank[np.searchsorted(every, s)]) for s in sets]
    parent = list(range(len(sets)))

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    tree, has, links = PrefixTree(np.zeros(0, np.int64)), np.zeros(len(every), bool), []
    for k in sorted(range(len(local)), key=lambda k: len(local[k])):
        x = local[k]
        if not len(x):
            continue
        has[x] = True
        for other in tree.search(x, has, percent, lambda o, k=k: find(o) == find(k)):
            if find(other) != find(k):
                parent[find(other)] = find(k)
                links.append((other, k))
        has[x] = False
        tree.insert(x, k)
    return links


def confirmed_links(links: list[tuple[int, int]], texts: list[str], size: int, percent: int) -> list[tuple[int, int]]:
    """``links`` of a block, each checked on the words; if one fails, the block is joined anew on its shingles."""
    own: dict[int, set] = {}

    def exact(k: int) -> set:
        if k not in own:
            own[k] = exact_set(texts[k], size)
        return own[k]

    for a, b in links:
        both = len(exact(a) & exact(b))
        if 100 * both < percent * (len(exact(a)) + len(exact(b)) - both):
            names: dict[tuple, int] = {}
            sets = [np.array(sorted({names.setdefault(g, len(names)) for g in exact(k)}), np.int64) for k in range(len(texts))]
            return join_block(sets, None, percent)
    return links


def near_by_bitmap(bits: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Which of these sets can reach the threshold with another, by their sizes and parity bitmaps."""
    near = np.zeros(len(n), bool)
    for k in range(len(n) - 1):
        own, other = n[k], n[k + 1 :]
        differ = np.bitwise_count(bits[k] ^ bits[k + 1 :]).sum(axis=1, dtype=np.int64)
        ok = (100 * np.minimum(own, other) >= percent * np.maximum(own, other)) & (differ <= own + other - 2 * need_overlap(own, other, percent))
        near[k] |= ok.any()
        near[k + 1 :] |= ok
    return near


def _blocks_of(own: pd.DataFrame) -> Iterator[tuple[int, int]]:
    """Ranges of rows with equal (hub, block) in a sorted frame."""
    hub, block = own["hub"].to_numpy(), own["block"].to_numpy()
    edges = np.flatnonzero((hub[1:] != hub[:-1]) | (block[1:] != block[:-1])) + 1
    return zip([0, *edges.tolist()], [*edges.tolist(), len(own)], strict=True)


def _grouped(frame: DataFrame, rows: int) -> DataFrame:
    """``frame`` with a ``grp`` of about this many rows; a block is in one group."""
    groups = max(1, -(-frame.count() // rows))
    return frame.withColumn("grp", F.pmod(F.xxhash64("hub", "block"), F.lit(groups)))


def verify(stars: DataFrame, docs: DataFrame, classes: DataFrame, counts, size: int, percent: int, seed: int) -> DataFrame:
    """Edges (a, b) between classes, from (hub, cls, typical) candidates; ``classes`` has cls, n, bitmap and the key of a text of each.

    A hub with more than ``BLOCK`` classes is split into blocks; the hub and its most typical class go to each of them.
    Classes that by the bitmaps cannot link with any other of their block leave it before texts are sent.
    """
    sized = stars.groupBy("hub").agg(F.count("*").alias("members"), F.max(F.struct("typical", "cls")).alias("centre"))
    blocks = F.ceil(F.col("members") / F.lit(BLOCK)).cast("int")
    dealt = stars.join(sized, "hub").select("hub", "cls", F.pmod(F.xxhash64("cls"), blocks).cast("int").alias("block"))
    every = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block")
    shared = sized.select("hub", F.explode(F.array_compact(F.array(F.col("hub"), F.when(F.col("members") > BLOCK, F.col("centre.cls"))))).alias("cls"), "members").select("hub", "cls", every)
    dealt = runtime.materialize(dealt.unionByName(shared), "blocks")

    def sift(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["hub", "block", "cls"], kind="stable").drop_duplicates(["hub", "block", "cls"])
        bits = np.frombuffer(b"".join(own["bitmap"]), np.uint64).reshape(len(own), -1)
        n = own["n"].to_numpy()
        near = np.concatenate([near_by_bitmap(bits[a:b], n[a:b], percent) for a, b in _blocks_of(own)])
        return own.loc[near, ["hub", "block", "cls", "key"]]

    sifted = _grouped(dealt, 4096).join(classes.select("cls", "key", "n", "bitmap"), "cls").groupBy("grp").applyInPandas(sift, "hub long, block int, cls long, key long")
    wanted = runtime.materialize(sifted, "wanted")
    # a bitmap of the wanted keys, of 2**17 rows at most, keeps the other texts out of the shuffle
    word, bit = (F.col("key").bitwiseAND((1 << 23) - 1) / 64).cast("int"), F.col("key").bitwiseAND(63).cast("int")
    bitmap = wanted.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    likely = docs.select(F.xxhash64("doc_id", "text").alias("key"), "text").withColumn("word", word).join(F.broadcast(bitmap), "word")
    likely = likely.filter(F.call_function("shiftrightunsigned", F.col("bits"), bit).bitwiseAND(1) == 1)
    texts = likely.select("key", "text").dropDuplicates(["key"])

    def join(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["hub", "block", "cls"], kind="stable")
        data, offsets = tk.string_buffers(pa.array(own["text"], pa.large_string()))
        sets: list[np.ndarray] = []
        for i, j in tk.slices(offsets):
            doc, h = doc_sets(data, offsets, i, j, size, seed=seed)
            sets += np.split(h, np.searchsorted(doc, np.arange(1, j - i)))
        names, texts = own["cls"].to_numpy(), own["text"].tolist()
        found = [(names[a + p], names[a + q]) for a, b in _blocks_of(own) for p, q in confirmed_links(join_block(sets[a:b], counts.value, percent), texts[a:b], size, percent)]
        return pd.DataFrame({"a": [a for a, _ in found], "b": [b for _, b in found]}, dtype="int64")

    return _grouped(wanted, BLOCK // 2).join(texts, "key").groupBy("grp").applyInPandas(join, "a long, b long")


def _near(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def jaccard_components(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    placed = _placed(docs, size, percent)
    least = runtime.materialize(placed.filter("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("least")), "least")
    out = placed.join(least, "component", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id (null ids last), then the smallest hash of id and text.

    Rows without words stay.  Of rows with equal id and text, that with the smallest hash of all columns stays.  Columns
    stay as they are.
    """
    placed = _placed(docs, size, percent)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    first = placed.filter("component IS NOT NULL").groupBy("component").agg(F.min(order).alias("first")).select("first.key")
    kept = runtime.materialize(first.unionByName(placed.filter("component IS NULL").select("key").distinct()), "kept")
    key = F.xxhash64(F.col("doc_id").cast("long"), "text")
    rows = docs.join(kept.select(F.col("key").alias("_kept")), key == F.col("_kept"), "left_semi")
    again = rows.groupBy(key.alias("_key")).agg(F.count("*").alias("_n")).filter("_n > 1").select("_key")
    again = runtime.materialize(again, "again")
    if again.isEmpty():
        return rows
    alone = rows.join(again, key == F.col("_key"), "left_anti")
    one = rows.join(again, key == F.col("_key"), "left_semi").groupBy(key.alias("_key")).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("_row"))
    return alone.unionByName(one.select("_row.*"))


def _placed(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, key (of id and text), n, component (a class; null without words) for every row."""
    result = runtime.scratch_path(docs.sparkSession, "placed")
    with runtime.own_folder(docs.sparkSession, "jaccard"):
        return runtime.materialize(_find(docs, size, percent), "placed", result)


def _find(docs: DataFrame, size: int, percent: int) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for seed in (0, 1000, 2000, 3000):
        digests = runtime.materialize(digest_sets(docs, size, seed), "digests")
        one = digests.filter("part IS NULL AND n > 0").groupBy("cls").agg(F.min("key").alias("key"), *[F.first(c).alias(c) for c in ("bitmap", "n", "fold_a", "fold_b")], (F.min("twin") == F.max("twin")).alias("sound"))
        one = runtime.materialize(one, "classes")
        if one.filter("NOT sound").isEmpty():
            break
    else:
        raise RuntimeError("classes of sets cannot be told apart by their hashes")
    counts = spark.sparkContext.broadcast(sketch_counts(digests))
    rows = digests.filter("part IS NULL").select("doc_id", "key", "n", "cls")
    found = prefixes(docs, counts, size, percent, seed)

    in_order = W.partitionBy("token", "salt").orderBy("n", "cls")
    hub = F.first("cls").over(in_order)
    near = found.select("*", hub.alias("first"), F.first("n").over(in_order).alias("first_n"), F.lag("cls").over(in_order).alias("prev"), F.lag("n").over(in_order).alias("prev_n"), F.lead("cls").over(in_order).alias("next"))
    # one row for each class (tasks may repeat one), where a token has two classes at least
    shared = near.filter("(next IS NULL OR next <> cls) AND (cls <> first OR next IS NOT NULL OR salts > 1)")
    shared = runtime.materialize(shared, "shared")

    hub_of = F.when(_near("n", "first_n", percent), F.col("first")).when(_near("n", "prev_n", percent), F.col("prev"))
    options = shared.filter("prev IS NOT NULL").select("cls", hub_of.alias("hub"))
    # the first class of each salt, a row for every HOT texts at most
    of_salts = W.partitionBy("token").orderBy("n", "cls")
    firsts = shared.filter("salts > 1 AND cls = first").select("token", "cls", "n", F.first("cls").over(of_salts).alias("first"), F.first("n").over(of_salts).alias("first_n"), F.lag("cls").over(of_salts).alias("prev"), F.lag("n").over(of_salts).alias("prev_n"))
    options = options.unionByName(firsts.filter("prev IS NOT NULL").select("cls", hub_of.alias("hub")))
    votes = options.filter("hub <> cls").groupBy("cls", "hub").agg(F.count("*").alias("votes"))
    best = votes.groupBy("cls").agg(F.max(F.struct("votes", "hub")).alias("best"), F.sum("votes").alias("all"))
    stars = best.select(F.col("best.hub").alias("hub"), "cls", F.col("all").alias("typical"))

    edges = runtime.materialize(verify(stars, docs, one, counts, size, percent, seed), "links")

    parts = components.connected_components(edges)
    for choose in (_neighbours, _pairs_between):
        pairs = runtime.materialize(choose(_mixed(shared, parts, one), one, percent), "pairs")
        if pairs.isEmpty():
            continue
        more = verify(pairs.select(F.col("a").alias("hub"), F.col("b").alias("cls"), F.lit(0).alias("typical")), docs, one, counts, size, percent, seed)
        more = runtime.materialize(more, "links")
        if not more.isEmpty():
            parts = runtime.materialize(_joined(parts, more), "parts")

    placed = rows.join(parts.withColumnRenamed("node", "cls"), "cls", "left")
    return placed.select("doc_id", "key", "n", F.when(F.col("n") > 0, F.coalesce("component", "cls")).alias("component"))


def _joined(parts: DataFrame, edges: DataFrame) -> DataFrame:
    """``parts`` (node, component) with the components that ``edges`` (a, b) join made one."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("component"))
    nodes = runtime.materialize(parts.unionByName(ends).groupBy("node").agg(F.min("component").alias("component")), "nodes")
    for end in ("a", "b"):
        edges = edges.join(nodes.select(F.col("node").alias(end), F.col("component").alias(f"{end}_part")), end)
    top = components.connected_components(edges.select(F.col("a_part").alias("a"), F.col("b_part").alias("b")).distinct())
    placed = nodes.join(top.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left")
    return placed.select("node", F.coalesce("top", "component").alias("component"))


def _mixed(shared: DataFrame, parts: DataFrame, one: DataFrame) -> DataFrame:
    """Prefix tokens that classes of different components share, with ``before``: the class's token before it here."""
    labelled = shared.select("token", "cls", "n", "pos", "salt").join(parts.withColumnRenamed("node", "cls"), "cls", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "cls"))
    mixed = labelled.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("token")
    before = F.lag("token").over(W.partitionBy("cls").orderBy("pos")).alias("before")
    labelled = labelled.join(mixed, "token", "left_semi").join(one.select("cls", "fold_a", "fold_b"), "cls").select("*", before)
    return runtime.materialize(labelled, "mixed")


def _may_link(x, y, percent: int):
    """Whether two rows of ``_mixed`` pass the filters by component, length, position and folded bitmap; ``x``, ``y`` give a column by name."""
    need = F.ceil(F.lit(percent) * (x("n") + y("n")) / F.lit(100 + percent))
    differ = sum(F.bit_count(x(c).bitwiseXOR(y(c))) for c in ("fold_a", "fold_b"))
    near = _near(x("n"), y("n"), percent) & (F.least(x("n") - x("pos"), y("n") - y("pos")) >= need)
    return (x("component") != y("component")) & near & (differ <= x("n") + y("n") - 2 * need)


def _neighbours(mixed: DataFrame, one: DataFrame, percent: int, reach: int = 4, best: int = 3) -> DataFrame:
    """(a, b): for each class the ``best`` others that most often stand within ``reach`` places of it at a token.

    They join most of what belongs together, at a cost in proportion to the tokens; the pairs that this leaves out are
    looked at by ``_pairs_between``.
    """
    in_order = W.partitionBy("token", "salt").orderBy("n", "cls")
    fields = ("cls", "n", "pos", "component", "fold_a", "fold_b")
    others = F.array(*[F.lag(F.struct(*fields), k).over(in_order) for k in range(1, reach + 1)])
    near = F.filter("others", lambda o: o.isNotNull() & _may_link(F.col, lambda c: o[c], percent))
    met = mixed.select("*", others.alias("others")).select("cls", F.explode(F.transform(near, lambda o: o["cls"])).alias("other"))
    votes = met.groupBy("cls", "other").agg(F.count("*").alias("votes"))
    place = F.row_number().over(W.partitionBy("cls").orderBy(F.desc("votes"), "other"))
    return votes.withColumn("place", place).filter(F.col("place") <= best).select(F.col("other").alias("a"), F.col("cls").alias("b"))


def _pairs_between(mixed: DataFrame, one: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs in different components that share a prefix token and pass all filters."""
    x, y = mixed.alias("x"), mixed.alias("y")
    close = (
        (F.col("x.token") == F.col("y.token"))
        & ((F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.cls") < F.col("y.cls"))))
        # a pair that also shares the token before has met there
        & ~F.coalesce(F.col("x.before") == F.col("y.before"), F.lit(False))
        & _may_link(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}"), percent)
    )
    pairs = x.join(y, close).select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct()
    for side in ("a", "b"):
        pairs = pairs.join(one.select(F.col("cls").alias(side), F.col("bitmap").alias(f"bits_{side}"), F.col("n").alias(f"n_{side}")), side)

    def sift(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, bits_a, bits_b, n_a, n_b = (batch.column(c) for c in ("a", "b", "bits_a", "bits_b", "n_a", "n_b"))
            if not batch.num_rows:
                continue
            raw = [np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in (bits_a, bits_b)]
            differ = np.bitwise_count(raw[0] ^ raw[1]).sum(axis=1, dtype=np.int64)
            n = n_a.to_numpy() + n_b.to_numpy()
            ok = pa.array(differ <= n - 2 * need_overlap(n, 0, percent))
            yield pa.RecordBatch.from_arrays([a.filter(ok), b.filter(ok)], names=["a", "b"])

    return pairs.select("a", "b", "bits_a", "bits_b", "n_a", "n_b").mapInArrow(sift, "a long, b long")


def pairs_from_sets(texts: dict[int, str | None], size: int = 4, percent: int = 85) -> dict[int, int]:
    """Brute force for tests: the component of each id, over plain strings."""
    sets = {}
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for d, t in texts.items():
        words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in (t or "")).translate(table).split(" ") if w]
        sets[d] = {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()
    parent = {d: d for d in texts}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {d: find(d) for d in texts}


ORACLE_SQL = r"""
WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT doc_id, CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda p: array_to_string(w[p:p + 3], ' '))) END AS s FROM dw WHERE len(w) > 0),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sh),
link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT dw.doc_id, CAST(coalesce(len(s), 0) AS BIGINT) AS n_shingles, c AS component_id FROM dw LEFT JOIN sh USING (doc_id) LEFT JOIN comp ON comp.a = dw.doc_id
"""

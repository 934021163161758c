"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, reranking with the vectors.

1. ITQ: principal directions of at most ``max_sample`` vectors (lowest hash first) and a rotation learned by turns of
   sign and Procrustes give balanced binary codes; further rotations give further codes for large inputs.
2. The code is cut into tables of about log2(n) bits.  Two vectors meet in a table when their parts differ in at most
   one bit: each vector is at home in its own bucket and visits those one bit below (the smaller of two keys), so a
   pair meets once a table.
3. In a bucket, pairs that already met in an earlier table are left out, and the others are reranked by the cosine in
   double precision.  Only counts and a spanning forest leave a bucket, never its pairs.  Those at home in a bucket
   and its visitors are each dealt to blocks of about ``BLOCK``; a group holds two blocks at most.

Vectors link only when labels and dimensions are equal.  Equal vectors with equal labels become one class first.
Null labels, null ids, null or zero vectors, and vectors with null or non-finite components link with nothing.
Repeated rows count as vectors of their own.  Empty tables give empty results.  Only the three named columns are
read.  The index is fitted on a sample, but holds every vector.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm import components, runtime

BLOCK = 1024
BITS = 64


def fit_itq(x: np.ndarray, bits: int = BITS, rounds: int = 30, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) of unit vectors x: ``sign((x - mean) @ projection)`` are the code bits."""
    mean = x.mean(axis=0)
    _, _, vt = np.linalg.svd(x - mean, full_matrices=False)
    basis = vt[: min(bits, vt.shape[0])].T
    v = (x - mean) @ basis
    rng = np.random.default_rng(seed)
    r, _ = np.linalg.qr(rng.normal(size=(v.shape[1], v.shape[1])))
    for _ in range(rounds):
        u, _, wt = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ wt).T
    return mean, basis @ r


def tables(n: int, bits: int, threshold: float, target: float = 0.98) -> tuple[list[tuple[int, int]], int]:
    """(bit ranges of the tables of one code, number of codes) for labels of about n vectors.

    Tables are a few bits wider than log2(n), so most buckets hold one vector.  There are as many as it takes for a
    pair at the threshold to meet with probability ``target``: a bit of theirs differs with chance angle / pi where the
    vectors have no common mean; ``fit_codes`` adds codes where they have one.
    """
    width = min(bits, 32, max(6, math.ceil(math.log2(max(2, n))) + 3))
    flips = width * math.acos(threshold) / math.pi
    meet = math.exp(-flips) * (1 + flips)
    wanted = math.ceil(math.log(1 - target) / math.log(1 - meet)) if meet < 1 else 1
    count = max(1, bits // width)
    codes = -(-wanted // count)
    count = min(count, -(-wanted // codes))
    return [(width * k, width * (k + 1)) for k in range(count)], codes


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_codes(x: np.ndarray, spans: list[tuple[int, int]], codes: int, threshold: float, target: float = 0.98, most: int = 64) -> list[tuple]:
    """(mean, projection, spans) of ``codes`` codes or more: until ``target`` of the vectors x meet one at the threshold.

    Each x is paired with a unit vector of cosine ``threshold`` in a random direction, and the pairs that meet are
    counted on the centred bits.
    """
    y = np.random.default_rng(0).normal(size=x.shape)
    y = x if x.shape[1] < 2 else threshold * x + math.sqrt(1 - threshold**2) * _unit(y - (y * x).sum(axis=1, keepdims=True) * x)
    met, out = np.zeros(len(x), bool), []
    while len(out) < codes or (met.mean() < target and len(out) < most):
        mean, proj = fit_itq(x, seed=len(out))
        out.append((mean, proj, spans))
        differ = ((x - mean) @ proj >= 0) != ((y - mean) @ proj >= 0)
        for lo, hi in spans:
            met |= differ[:, lo:hi].sum(axis=1) <= 1
    return out


def near_duplicates(df: DataFrame, threshold: float = 0.93, max_sample: int = 4096) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding, label)."""
    df = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    keyed = df.withColumn("cls", F.when(good, F.xxhash64("label", "embedding")))
    classes = keyed.filter("cls IS NOT NULL").groupBy("cls").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count("*").alias("n"))
    classes = runtime.materialize(classes.withColumn("dim", F.size("embedding")), "vectors")
    linked = _linked(classes, threshold, max_sample)
    if linked is None:
        found = keyed.select("vec_id", "cls", F.lit(0).cast("long").alias("links"), F.col("cls").alias("component"))
        found = found.join(classes.select("cls", "n"), "cls", "left")
    else:
        links = linked.groupBy("a").agg(F.sum("links").alias("links"))
        parts = components.connected_components(linked.select("a", "b"))
        placed = classes.select("cls", "n").join(links.withColumnRenamed("a", "cls"), "cls", "left").join(parts.withColumnRenamed("node", "cls"), "cls", "left")
        placed = placed.select("cls", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "cls").alias("component"))
        found = keyed.select("vec_id", "cls").join(placed, "cls", "left")
    least = found.filter("component IS NOT NULL").groupBy("component").agg(F.min("vec_id").alias("least"))
    component = F.coalesce("least", "vec_id")
    return found.join(least, "component", "left").select("vec_id", F.coalesce(F.col("links") + F.col("n") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _linked(classes: DataFrame, threshold: float, max_sample: int) -> DataFrame | None:
    """(a, links, b): vectors that class a links with, and edges of a forest; None where there is nothing to index."""
    sizes = classes.groupBy("dim").agg(F.count("*").alias("n")).orderBy("dim")
    per_label = {r.dim: r.n for r in classes.groupBy("label", "dim").count().groupBy("dim").agg(F.max("count").alias("n")).collect()}
    models = {}
    for row in sizes.collect():  # one row for each dimension that occurs
        # at most max_sample vectors
        sample = classes.filter(F.col("dim") == row.dim).orderBy(F.xxhash64("cls")).limit(max_sample).select("embedding").collect()
        x = _unit(np.array([r.embedding for r in sample], dtype=float))
        spans, rotations = tables(per_label[row.dim], min(BITS, row.dim, len(x)), threshold)
        models[row.dim] = fit_codes(x, spans, rotations, threshold)
    if not models:
        return None

    def index(batches):
        for frame in batches:
            for dim, own in frame.groupby("dim"):
                unit = _unit(np.array(own["embedding"].tolist(), dtype=float))
                keys = []
                for mean, proj, spans in models[dim]:
                    bits = (unit - mean) @ proj >= 0
                    keys += [(bits[:, lo:hi] @ (1 << np.arange(hi - lo)), hi - lo) for lo, hi in spans]
                table = np.column_stack([k for k, _ in keys]).astype("<u4")
                codes, vectors = [t.tobytes() for t in table], [v.tobytes() for v in unit]
                places = []
                for t, (key, width) in enumerate(keys):
                    places.append((t, key, True, np.arange(len(own))))
                    for b in range(width):  # the smaller of two keys that differ in one bit
                        at = np.flatnonzero(key >> b & 1)
                        places.append((t, key[at] ^ (1 << b), False, at))
                spots = [[] for _ in codes]
                for t, key, home, at in places:
                    for i, k in zip(at.tolist(), key.tolist(), strict=True):
                        spots[i].append({"tab": t, "bucket": k, "home": home})
                yield pd.DataFrame({"label": own["label"].to_numpy(), "dim": dim, "cls": own["cls"].to_numpy(), "n": own["n"].to_numpy(), "codes": codes, "vector": vectors, "spots": spots})

    label = classes.schema["label"].dataType.simpleString()
    placed = classes.select("label", "dim", "cls", "n", "embedding").mapInPandas(index, f"label {label}, dim int, cls long, n long, codes binary, vector binary, spots array<struct<tab:int,bucket:long,home:boolean>>")
    placed = runtime.materialize(placed, "buckets")
    cell = ["label", "dim", "tab", "bucket"]
    spots = placed.select("label", "dim", "cls", F.explode("spots").alias("s")).select("label", "dim", "cls", "s.*")
    # buckets where someone is at home and someone else is, too; vectors only go there
    counts = spots.groupBy(*cell).agg(F.count_if("home").alias("homes"), F.count("*").alias("all")).filter("homes > 0 AND all > 1")
    counts = runtime.materialize(counts, "cells")
    blocks = F.ceil(F.col("homes") / F.lit(BLOCK)).cast("int")
    visits = F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("homes")) / F.lit(BLOCK))).cast("int")
    own = F.pmod(F.xxhash64("cls"), F.when(F.col("home"), blocks).otherwise(visits)).cast("int")
    every, others = F.sequence(F.lit(0), blocks - 1), F.filter(F.sequence(F.lit(0), visits - 1), lambda k: k > 0)
    # a group (i, j) holds two blocks of homes, (i, i) one and the first block of visitors, (i, -k) one and visitors' block k
    homes = F.concat(F.transform(every, lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j"))), F.transform(others, lambda k: F.struct(own.alias("i"), (-k).alias("j"))))
    visitors = F.transform(every, lambda k: F.struct(k.alias("i"), F.when(own == 0, k).otherwise(-own).alias("j")))
    dealt = spots.join(counts, cell).select("dim", "tab", F.xxhash64(*cell).alias("at"), "cls", "home", (F.col("all") <= BLOCK).alias("small"), own.alias("block"), F.explode(F.when(F.col("home"), homes).otherwise(visitors)).alias("pair"))
    dealt = dealt.select("dim", "tab", "at", "cls", "home", "small", "block", "pair.i", "pair.j")
    # small buckets share groups of about a block; each pair of blocks of a large one is a group of its own
    few = counts.filter(F.col("all") <= BLOCK).agg(F.sum("all").alias("n")).first().n or 0
    groups = -(-few // BLOCK) + 1
    alone = F.xxhash64("at", "i", "j")
    dealt = dealt.withColumn("grp", F.when(F.col("small"), F.pmod(alone, F.lit(groups))).otherwise(alone)).drop("small")
    dealt = dealt.join(placed.select("cls", "n", "codes", "vector"), "cls")

    def rerank(frame: pd.DataFrame) -> pd.DataFrame:
        dim = int(frame["dim"].iloc[0])
        frame = frame.sort_values(["at", "i", "j", "home"], ascending=[True, True, True, False], kind="stable")
        x = np.frombuffer(b"".join(frame["vector"]), float).reshape(len(frame), dim)
        codes = np.frombuffer(b"".join(frame["codes"]), "<u4").reshape(len(frame), -1)
        at, i, j, home, block, tab, cls, n = (frame[c].to_numpy() for c in ("at", "i", "j", "home", "block", "tab", "cls", "n"))
        new = np.ones(len(frame), bool)
        new[1:] = (at[1:] != at[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        edges = np.append(np.flatnonzero(new), len(frame))
        left, right = [], []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a < 2 or not home[a]:
                continue
            first = a + int(home[a:b].sum())
            if i[a] == j[a]:
                p, q = np.arange(a, first), np.arange(a, b)
            elif j[a] < 0:
                p, q = np.arange(a, first), np.arange(first, b)
            else:
                own = np.arange(a, b)
                p, q = own[block[a:b] == i[a]], own[block[a:b] == j[a]]
            near = x[p] @ x[q].T >= threshold
            if not near.any():
                continue
            for t in range(tab[a]):  # met in an earlier table
                near &= np.bitwise_count(codes[p, t][:, None] ^ codes[q, t][None, :]) > 1
            if i[a] == j[a]:
                near &= q[None, :] > p[:, None]
            u, v = np.nonzero(near)
            left.append(p[u])
            right.append(q[v])
        if not left:
            return pd.DataFrame({"a": [], "links": [], "b": []}).astype("int64")
        p, q = np.concatenate(left), np.concatenate(right)
        names, local = np.unique(cls, return_inverse=True)
        u, v = local[p], local[q]
        links = np.bincount(u, weights=n[q], minlength=len(names)) + np.bincount(v, weights=n[p], minlength=len(names))
        forest = np.arange(len(names))
        while True:  # smallest label of each connected part
            before = forest.copy()
            m = np.minimum(forest[u], forest[v])
            np.minimum.at(forest, u, m)
            np.minimum.at(forest, v, m)
            forest = forest[forest]
            if (forest == before).all():
                break
        hit = np.flatnonzero(links)
        return pd.DataFrame({"a": names[hit], "links": links[hit].astype(np.int64), "b": names[forest[hit]]})

    return runtime.materialize(dealt.groupBy("dim", "grp").applyInPandas(rerank, "a long, links long, b long"), "near")


ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings WHERE vec_id IS NOT NULL UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
cnt AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, c AS component_id, vec_id = c AS kept
FROM embeddings LEFT JOIN cnt ON cnt.a = vec_id LEFT JOIN comp ON comp.a = vec_id
"""

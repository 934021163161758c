"""Trees whose lists are tables, as one table of numbered nodes; axes between node-sets as interval joins.

``number_nodes`` gives every entry and leaf a row with ``pre``, its place in document order, and ``last``, the place of the
last node below it.  A node is below another if its ``pre`` is in the other's interval.  ``below`` joins by that: an
interval goes to the one or two buckets of its own scale (the power of two that its length reaches), a node to one bucket
of each scale in use.  A node meets intervals that are about as long as their bucket, so the pairs looked at are at most a
few times the pairs found.  Intervals longer than ``2 ** TOP`` go to all their buckets of that size: a document that
holds a third of all nodes is dealt to many tasks, and no bucket holds more than ``2 ** TOP`` places.

Nulls: leaves without a value have no node.  Empty tables give no nodes.  Keys of inner levels have to be unique (their
repeats are what ``validation.duplicate_keys`` finds); entries of the lowest level may repeat.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arbora.functions import types as ty
from arbora.operators.numbering import with_places
from arbora.plans.model import Node

TOP = 14


@dataclass(frozen=True)
class Level:
    """A list of the tree: its entries, with the keys of all levels above before its own, and the schema node."""

    df: DataFrame
    keys: tuple[str, ...]
    node: Node

    def leaves(self) -> list[Node]:
        return [c for c in self.node.data_children() if c.kind == "leaf" and c.name in self.df.columns]


def _own(level: Level, depth: int) -> DataFrame:
    """Keys (``k0``, ``k1``, ...) and the canonical values of each entry's leaves, NULL for those that it lacks."""
    keys = [F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(level.keys)]
    cells = [ty.canon(F.col(f"`{c.name}`"), c.type) for c in level.leaves()]
    values = F.array(*cells) if cells else F.array()
    return level.df.select(*keys, values.cast("array<string>").alias("_values"), F.lit(depth).alias("level"))


def _nodes_of(level: Level, path: str) -> Column:
    """An entry's own node and those of its leaves, in order."""
    leaves = level.leaves()
    row = lambda at, name, schema_path, value: F.struct(at.cast("int").alias("at"), name.alias("name"), schema_path.alias("schema_path"), value.cast("string").alias("value"))
    element = F.array(row(F.lit(0), F.lit(level.node.name), F.lit(path), F.lit(None)))
    if not leaves:
        return element
    names, paths = (F.array(*[F.lit(x) for x in xs]) for xs in zip(*[(c.name, f"{path}/{c.name}") for c in leaves], strict=True))
    each = F.transform("_values", lambda v, i: row(i + 1, F.get(names, i), F.get(paths, i), v))
    return F.concat(element, F.filter(each, lambda n: n["value"].isNotNull()))


def number_nodes(levels: list[Level]) -> DataFrame:
    """(pre, last, level, kind, name, schema_path, value and the keys k0, k1, ...) of all nodes, one level below the other.

    Entries are put in order with the values of their leaves; only then, in their place, they become nodes.
    """
    h = len(levels)
    names = [f"k{i}" for i in range(h)]
    paths = [""]
    for lv in levels:
        paths.append(f"{paths[-1]}/{lv.node.name}")
    own = [_own(lv, d) for d, lv in enumerate(levels)]
    # sizes from the lowest level up, added up before they are shuffled
    sized: list[DataFrame] = [None] * h
    for d in reversed(range(h)):
        size = F.size(F.array_compact("_values")).cast("long")
        if d + 1 == h:
            sized[d] = own[d].withColumn("size", size)
            continue
        below = sized[d + 1].groupBy(*names[: d + 1]).agg(F.sum(F.col("size") + 1).alias("_below"))
        sized[d] = own[d].join(below, names[: d + 1], "left").withColumn("size", size + F.coalesce("_below", F.lit(0))).drop("_below")
    parts = []
    for d, df in enumerate(sized):
        missing = [F.lit(None).cast(levels[-1].df.schema[levels[-1].keys[i]].dataType).alias(names[i]) for i in range(d + 1, h)]
        parts.append(df.select(*names[: d + 1], *missing, "level", "size", "_values"))
    every = reduce(DataFrame.unionByName, parts)
    nodes = reduce(lambda made, d: made.when(F.col("level") == d, _nodes_of(levels[d], paths[d + 1])), range(1, h), F.when(F.col("level") == 0, _nodes_of(levels[0], paths[1])))
    exploded = lambda df: df.select(*names, "level", "size", F.explode(nodes).alias("n")).select(*names, "level", "size", "n.*")
    placed = with_places(every, [*[F.asc_nulls_first(n) for n in names], "level"], "pre", then=exploded)
    entry = F.col("at") == 0
    return placed.select(
        "pre",
        F.when(entry, F.col("pre") + F.col("size")).otherwise(F.col("pre")).alias("last"),
        F.when(entry, F.col("level")).otherwise(F.col("level") + 1).alias("level"),
        F.when(entry, "list").otherwise("leaf").alias("kind"),
        "name",
        "schema_path",
        "value",
        *names,
    )


def named(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.filter(F.col("name") == name)


def _scale(size: Column, top: int) -> Column:
    """The least power of two that an interval of ``size`` + 1 places fits into."""
    return F.least(F.lit(top), F.length(F.bin(size)) * (size > 0).cast("int"))


def below(outer: DataFrame, inner: DataFrame, or_self: bool = False, top: int = TOP) -> DataFrame:
    """Pairs of an outer node and one below it: all columns of ``inner``, and ``outer``'s as ``o_...``."""
    up = outer.select(*[F.col(c).alias(f"o_{c}") for c in outer.columns]).withColumn("_s", _scale(F.col("o_last") - F.col("o_pre"), top))
    bucket = lambda x: F.expr(f"shiftright({x}, _s)")
    up = up.select("*", F.explode(F.sequence(bucket("o_pre"), bucket("o_last"))).alias("_b"))
    scales = sorted(r["_s"] for r in up.select("_s").distinct().collect())  # top + 1 at most
    at = F.array(*[F.struct(F.lit(s).alias("_s"), F.shiftright("pre", s).alias("_b")) for s in scales])
    at = at if scales else F.array().cast("array<struct<_s:int,_b:bigint>>")
    down = inner.select("*", F.explode(at).alias("_at")).select(*inner.columns, "_at._s", "_at._b")
    inside = (F.col("pre") >= F.col("o_pre")) if or_self else (F.col("pre") > F.col("o_pre"))
    return down.join(up, ["_s", "_b"]).filter(inside & (F.col("pre") <= F.col("o_last"))).drop("_s", "_b")


def descendants(context: DataFrame, nodes: DataFrame, name: str | None = None, or_self: bool = False, top: int = TOP) -> DataFrame:
    """The nodes below those of a node-set, each once; of this name only, if one is given.

    Which context nodes they are below is not asked, so a node travels once, to its range of ``2 ** top`` places.  An interval
    goes to all ranges it reaches into; in each, a node is below one if the furthest end of those that begin before it is.
    """
    own = nodes if name is None else named(nodes, name)
    block = lambda x: F.shiftright(x, top)
    points = own.select("*", block("pre").alias("_b"), F.col("pre").alias("_at"), F.lit(1).alias("_turn"), F.lit(None).cast("long").alias("_reach"))
    spans = context.select("pre", "last", F.explode(F.sequence(block("pre"), block("last"))).alias("_b"))
    start = F.greatest("pre", F.shiftleft("_b", top) - 1)  # before all of a range, if it begins in an earlier one
    spans = spans.select("_b", start.alias("_at"), F.lit(0 if or_self else 2).alias("_turn"), F.col("last").alias("_reach"))
    so_far = W.partitionBy("_b").orderBy("_at", "_turn").rowsBetween(W.unboundedPreceding, W.currentRow)
    reached = points.unionByName(spans, allowMissingColumns=True).withColumn("_reach", F.max("_reach").over(so_far))
    return reached.filter((F.col("_turn") == 1) & (F.col("_reach") >= F.col("pre"))).dropDuplicates(["_b", "pre"]).select(*nodes.columns)


def ancestors(context: DataFrame, nodes: DataFrame, name: str | None = None, or_self: bool = False, top: int = TOP) -> DataFrame:
    """The nodes above those of a node-set, each once."""
    own = nodes.filter("kind <> 'leaf'") if not or_self else nodes
    own = own if name is None else named(own, name)
    pairs = below(own, context.select("pre"), or_self, top)
    return pairs.select(*[F.col(f"o_{c}").alias(c) for c in nodes.columns]).dropDuplicates(["pre"])


def children(context: DataFrame, nodes: DataFrame, name: str | None = None, top: int = TOP) -> DataFrame:
    own = nodes if name is None else named(nodes, name)
    return below(context.select("pre", "last", "level"), own, False, top).filter(F.col("level") == F.col("o_level") + 1).select(*nodes.columns)


def parents(context: DataFrame, nodes: DataFrame, name: str | None = None, top: int = TOP) -> DataFrame:
    own = nodes.filter("kind <> 'leaf'")
    own = own if name is None else named(own, name)
    pairs = below(own, context.select("pre", "level"), False, top).filter(F.col("level") == F.col("o_level") + 1)
    return pairs.select(*[F.col(f"o_{c}").alias(c) for c in nodes.columns]).dropDuplicates(["pre"])


def count_below(context: DataFrame, nodes: DataFrame, top: int = TOP) -> DataFrame:
    """``context`` with ``n``: how many of ``nodes`` stand below each of its nodes; 0 included."""
    found = below(context.select("pre", "last"), nodes.select("pre"), False, top).groupBy(F.col("o_pre").alias("pre")).agg(F.count("*").alias("n"))
    return context.join(found, "pre", "left").withColumn("n", F.coalesce("n", F.lit(0)))

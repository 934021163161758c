"""Navigation in shredded lists: paths, selectors, siblings, axes between parent and child lists."""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arbora.functions.types import canonical_instance_id  # noqa: F401
from arbora.plans.model import BadSchemaNodeType, Node


class InvalidKeyValue(ValueError):
    """A selector whose value does not fit the node."""


class NonDataNode(ValueError):
    """A route to an operation, which has no instances."""


def quoted(text: Column) -> Column:
    """A value in single quotes, or in double ones where it holds a single one; ``"`` and backslashes are then escaped."""
    plain = F.concat(F.lit("'"), text, F.lit("'"))
    other = F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(F.contains(text, F.lit("'")), other).otherwise(plain)


def entry_path(name: str, keys: list[str]) -> Column:
    """The instance route of a list entry: ``/name[k1='v1'][k2='v2']``; it parses back to the same keys."""
    parts = [x for k in keys for x in (F.lit(f"[{k}="), quoted(F.coalesce(F.col(f"`{k}`").cast("string"), F.lit(""))), F.lit("]"))]
    return F.concat(F.lit(f"/{name}"), *parts)


def json_pointers(df: DataFrame, name: str, order: list[str], sample: int = 4096) -> DataFrame:
    """``df`` with ``pointer``, ``/name/i`` by the entry's place (from 0) in the order of its key.

    Entries are dealt to ranges of keys, cut at a sample of them; a place is the size of the ranges before plus the place
    in its own range, so no task sees the whole list.
    """
    kinds = {c: df.schema[c].dataType for c in order}
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = df.select(*order).orderBy(F.xxhash64(*order)).limit(sample).orderBy(*order).collect()
    cuts = [some[k * len(some) // parts] for k in range(1, parts) if some]
    bounds = [F.struct(*[F.lit(r[c]).cast(kinds[c]).alias(c) for c in order]) for r in dict.fromkeys(cuts)]
    key = F.struct(*order)
    part = F.size(F.filter(F.array(*bounds), lambda b: b <= key)) if bounds else F.lit(0)
    dealt = df.withColumn("_part", part)
    sizes = {r["_part"]: r["count"] for r in dealt.groupBy("_part").count().collect()}  # one row a range
    before = [sum(n for q, n in sizes.items() if q < p) for p in range(len(bounds) + 1)]
    at = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1 + F.get(F.array(*[F.lit(n).cast("long") for n in before]), F.col("_part"))
    return dealt.withColumn("pointer", F.concat(F.lit(f"/{name}/"), at.cast("string"))).drop("_part")


def json_pointer_within(name: str, child: str, parent_keys: list[str], order: list[str]) -> Column:
    """``/name[keys]/child/i``: the place of an entry within its parent."""
    at = F.row_number().over(W.partitionBy(*parent_keys).orderBy(*order)) - 1
    return F.concat(entry_path(name, parent_keys), F.lit(f"/{child}/"), at.cast("string"))


def look_up(df: DataFrame, **keys) -> DataFrame:
    """Entries with these leaf values; the filter reaches the scan."""
    return df.filter(reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in keys.items()], F.lit(True)))


def look_up_first(df: DataFrame, order: list[str], **keys) -> DataFrame:
    """The first entry with these leaf values, in this order; no row where there is none."""
    return look_up(df, **keys).orderBy(*order).limit(1)


def entry(array: Column, index: int) -> Column:
    """An entry by index; negative ones count from the end; NULL where there is none."""
    return F.get(array, F.lit(index)) if index >= 0 else F.get(array, F.size(array) + index)


def member(value: Column, *names: str) -> Column:
    for n in names:
        value = value.getField(n)
    return value


def next_entry(df: DataFrame, parent: list[str], order: list[str], leaf: str) -> Column:
    return F.lead(leaf).over(W.partitionBy(*parent).orderBy(*order))


def previous_entry(df: DataFrame, parent: list[str], order: list[str], leaf: str) -> Column:
    return F.lag(leaf).over(W.partitionBy(*parent).orderBy(*order))


def position(parent: list[str], order: list[str]) -> Column:
    return F.row_number().over(W.partitionBy(*parent).orderBy(*order))


def last(parent: list[str]) -> Column:
    return F.count("*").over(W.partitionBy(*parent))


def preceding(parent: list[str], order: list[str]) -> W:
    return W.partitionBy(*parent).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)


def following(parent: list[str], order: list[str]) -> W:
    return W.partitionBy(*parent).orderBy(*order).rowsBetween(1, W.unboundedFollowing)


def children(parent: DataFrame, child: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """The child axis: entries of ``child`` with their parent's columns."""
    return parent.join(child, reduce(lambda a, b: a & b, [parent[p] == child[c] for p, c in on]))


def parents(child: DataFrame, parent: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """The parent axis: each parent of some child once."""
    return parent.join(child, reduce(lambda a, b: a & b, [parent[p] == child[c] for p, c in on]), "left_semi")


def descendants(tables: dict[str, DataFrame], leaf_of: dict[str, str]) -> DataFrame:
    """Leaves named alike in several lists, as one node-set: (path, value)."""
    parts = [tables[t].select(F.lit(f"/{t}/{c}").alias("path"), F.col(c).cast("string").alias("value")) for t, c in leaf_of.items()]
    return reduce(DataFrame.unionByName, parts)


def nest(parent: DataFrame, child: DataFrame, keys: list[tuple[str, str]], order: list[str], name: str) -> DataFrame:
    """Entries of ``child`` as an array of structs in their parents, in order; parents without any get an empty array.

    All entries of a parent are one array of one row, so this is for parents whose entries fit into a task; where one may
    hold a third of all rows, leave the lists as tables (``nodetable`` has the axes between them).
    """
    columns = [*order, *[c for c in child.columns if c not in order]]
    grouped = child.groupBy(*[F.col(c).alias(f"_{c}") for _, c in keys]).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    cond = reduce(lambda a, b: a & b, [parent[p] == grouped[f"_{c}"] for p, c in keys])
    joined = parent.join(grouped, cond, "left").drop(*[f"_{c}" for _, c in keys])
    empty = F.array().cast(grouped.schema[name].dataType)
    return joined.withColumn(name, F.coalesce(F.col(name), empty))


def shred(df: DataFrame, keys: list[str], array: str) -> DataFrame:
    """Entries of an array with their parents' keys and ``_pos`` (from 0)."""
    return df.select(*keys, F.posexplode(array).alias("_pos", "_entry")).select(*keys, "_pos", "_entry.*")


def node_table(df: DataFrame, node: Node) -> DataFrame:
    """One row per leaf instance: (path, schema_path, name, value)."""
    path = entry_path(node.name, list(node.keys))
    leaves = [c for c in node.data_children() if c.kind == "leaf" and c.name in df.columns]
    cells = F.array(*[F.struct(F.concat(path, F.lit(f"/{c.name}")).alias("path"), F.lit(f"/{node.name}/{c.name}").alias("schema_path"), F.lit(c.name).alias("name"), F.col(f"`{c.name}`").cast("string").alias("value")) for c in leaves])
    return df.select(F.explode(cells).alias("n")).select("n.*").filter("value IS NOT NULL")


def deref_paths(df: DataFrame, leaf: str, nodes: DataFrame) -> DataFrame:
    """Instance identifiers joined with the node table on the canonical path."""
    return df.join(nodes.select(F.col("path").alias("_path"), F.col("value").alias("target_value")), F.col(leaf) == F.col("_path")).drop("_path")


# between lists


def _on(parent: DataFrame, child: DataFrame, on: list[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, [parent[p] == child[c] for p, c in on])


def where_exists(parent: DataFrame, child: DataFrame, on: list[tuple[str, str]], condition: Column | None = None, negate: bool = False) -> DataFrame:
    """Entries for which the other list has one (or, negated, none) that satisfies the condition: ``parent[child[...]]``."""
    own = child if condition is None else child.filter(condition)
    return parent.join(own, _on(parent, own, on), "left_anti" if negate else "left_semi")


def child_values(parent: DataFrame, child: DataFrame, on: list[tuple[str, str]], **values: Column) -> DataFrame:
    """``parent`` with aggregates of its entries in ``child`` (``count``, ``sum``, the first by order); NULL where it has none.

    The aggregates are made before the join, with partial ones before the shuffle.
    """
    grouped = child.groupBy(*[F.col(c).alias(f"_{c}") for _, c in on]).agg(*[v.alias(k) for k, v in values.items()])
    joined = parent.join(grouped, reduce(lambda a, b: a & b, [parent[p] == grouped[f"_{c}"] for p, c in on]), "left")
    return joined.drop(*[f"_{c}" for _, c in on])


def any_pair(a: DataFrame, b: DataFrame, on: list[tuple[str, str]], left: str, op: str, right: str) -> DataFrame:
    """Keys for which some value of one list and some of the other satisfy ``<``, ``<=``, ``>``, ``>=``, ``=`` or ``!=``.

    Inequalities compare the extreme values of both, so pairs are never made; equal values meet by a semi join.
    """
    if op == "=":
        own = a.select(*[c for c, _ in on], left).distinct()
        return own.join(b, _on(own, b, [*on, (left, right)]), "left_semi").select(*[c for c, _ in on]).distinct()
    # only the extremes that the comparison looks at
    used = {"<": ("min", "max"), "<=": ("min", "max"), ">": ("max", "min"), ">=": ("max", "min"), "!=": ("min max", "min max")}[op]

    def ends(df: DataFrame, keys: list[tuple[str, str]], value: str, tag: str, which: str) -> DataFrame:
        made = {"min": F.min(value).alias(f"{tag}_lo"), "max": F.max(value).alias(f"{tag}_hi")}
        return df.filter(F.col(value).isNotNull()).groupBy(*[F.col(k).alias(n) for k, n in keys]).agg(*[made[w] for w in which.split()])

    both = ends(a, [(c, c) for c, _ in on], left, "a", used[0]).join(ends(b, [(d, c) for c, d in on], right, "b", used[1]), [c for c, _ in on])
    test = {
        "<": "a_lo < b_hi",
        "<=": "a_lo <= b_hi",
        ">": "a_hi > b_lo",
        ">=": "a_hi >= b_lo",
        "!=": "a_lo <> b_hi OR a_hi <> b_lo",
    }[op]
    return both.filter(test).select(*[c for c, _ in on])


def union(*parts: DataFrame) -> DataFrame:
    """The union of node-sets, each node once."""
    return reduce(DataFrame.unionByName, parts).distinct()


def deref(df: DataFrame, node: Node, leaf: str, tables: dict[str, DataFrame], *take: str) -> DataFrame:
    """Entries with columns of the entry that a leafref refers to; those without a target are left out."""
    target = node.data_child(leaf).leafref
    if target is None:
        raise BadSchemaNodeType(f"{leaf} is no leafref")
    own = tables[target[0]].select(F.col(target[1]).alias("_target"), *take)
    return df.join(own, F.col(leaf) == F.col("_target")).drop("_target")


def ancestors(df: DataFrame, model: Node, steps: list[tuple[str, str]], tables: dict[str, DataFrame]) -> DataFrame:
    """Entries with the columns of what their references lead to, step by step: (list, leaf) pairs from the entry on."""
    for lst, leaf in steps:
        target = model.data_child(lst).data_child(leaf).leafref
        if target is None:
            raise BadSchemaNodeType(f"{leaf} is no leafref")
        own = tables[target[0]]
        df = df.join(own, df[leaf] == own[target[1]])
    return df


def at_positions(df: DataFrame, parent: list[str], order: list[str], least: int = 1, most: int | None = None) -> DataFrame:
    """Entries at these places (from 1) among those of their parent, with ``nth``: numeric predicates."""
    ranked = df.withColumn("nth", position(parent, order))
    kept = ranked.filter(F.col("nth") >= least)
    return kept if most is None else kept.filter(F.col("nth") <= most)


# selectors from text: one pattern a step

_STEP = re.compile(r"/(?:(?P<ns>[A-Za-z_][\w.-]*):)?(?P<name>[A-Za-z_][\w.-]*)")
_SELECTOR = re.compile(r"""\[\s*(?:(?P<index>[0-9]+)|(?P<key>\.|(?:[A-Za-z_][\w.-]*:)?[A-Za-z_][\w.-]*)\s*=\s*(?:'(?P<one>[^']*)'|"(?P<two>(?:[^"\\]|\\.)*)"))\s*\]""")


def route_from_instance_id(text: str) -> list[tuple[str, dict]]:
    """Steps of an instance identifier: (name, selectors); ``.`` selects a leaf-list value, ``#`` a place from 0.

    Anything that is no step or selector raises ``InvalidKeyValue``.
    """
    at, out = 0, []
    if text == "/":
        return out
    while at < len(text) or not out:
        m = _STEP.match(text, at)
        if not m:
            raise InvalidKeyValue(f"{text} at {at}")
        at, keys = m.end(), {}
        while text[at : at + 1] == "[":
            s = _SELECTOR.match(text, at)
            if not s or "#" in keys or "." in keys or (keys and (s["index"] or s["key"] == ".")):
                raise InvalidKeyValue(f"{text} at {at}")
            if s["index"]:
                if int(s["index"]) < 1:
                    raise InvalidKeyValue(f"{text} at {at}: places count from 1")
                keys["#"] = int(s["index"]) - 1
            else:
                keys[s["key"].rpartition(":")[2]] = s["one"] if s["one"] is not None else re.sub(r"\\(.)", r"\1", s["two"])
            at = s.end()
        out.append((m["name"], keys))
    return out


def route_from_resource_id(text: str, root: Node) -> list[tuple[str, dict]]:
    """Steps of a RESTCONF resource identifier; key values follow ``=`` in the order of the list's keys.

    A list without values stands for all its entries and can only end a route; so does an operation, which has no
    instances: following it raises ``NonDataNode``.
    """
    out, node = [], root
    steps = [x for x in text.split("/") if x]
    for k, step in enumerate(steps):
        name, _, values = step.partition("=")
        action = next((c for c in node.children if c.kind in ("rpc", "action") and name in (c.name, f"{c.ns}:{c.name}")), None)
        if action:
            return [*out, (action.name, {"()": True})]
        node = node.data_child(name)
        keys = {}
        if "=" in step:
            if node.kind not in ("list", "leaf-list"):
                raise BadSchemaNodeType(node.name)
            given = [unquote(v) for v in values.split(",")] if node.kind == "list" else [unquote(values)]
            names = node.keys if node.kind == "list" else (".",)
            if len(given) != len(names) or not values:
                raise InvalidKeyValue(step)
            keys = dict(zip(names, given, strict=True))
        elif node.kind in ("list", "leaf-list") and k + 1 < len(steps):
            raise InvalidKeyValue(f"{step}: which entry?")
        out.append((node.name, keys))
    return out


def follow(route: list[tuple[str, dict]], tables: dict[str, DataFrame], model: Node | None = None) -> DataFrame:
    """The instances at a route into tables: a list, then members of its entries; no rows where there are none.

    Selectors by place go by the order of the list's keys, which ``model`` names.
    """
    (name, keys), *rest = route
    if any("()" in k for _, k in route):
        raise NonDataNode(route[-1][0])
    df = tables[name]
    unknown = [k for k in keys if k not in df.columns and k != "#"]
    if unknown or any(k for _, k in rest):
        raise InvalidKeyValue(f"no such selectors in {name}: {unknown or rest}")
    if "#" in keys:
        if model is None or not model.data_child(name).keys:
            raise InvalidKeyValue(f"{name} has no order")
        df = df.orderBy(*model.data_child(name).keys).offset(keys["#"]).limit(1)
    for k, v in keys.items():
        if k != "#":
            df = df.filter(F.col(k) == F.lit(v))
    return df.select(".".join(n for n, _ in rest)) if rest else df

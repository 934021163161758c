"""Validation as set-oriented plans: every check returns its violations as rows.

A violation has ``instance_path``, ``schema_path``, ``error_class`` (schema, semantic, type or decode), ``error_tag``
and ``error_message``.  Row-local checks of a list share one scan; keys, uniqueness and cardinality aggregate before
they shuffle; references are anti joins on the referring value, left to adaptive execution for size and skew.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.functions import types as ty
from arbora.operators import paths
from arbora.operators.editing import add_defaults
from arbora.operators.navigation import entry_path
from arbora.plans.model import ALL, Node

COLUMNS = ("instance_path", "schema_path", "error_class", "error_tag", "error_message")


def _violation(path: Column, schema_path: str, cls: str, tag: str, message: str | None) -> list[Column]:
    return [c.alias(n) for c, n in zip((path, F.lit(schema_path), F.lit(cls), F.lit(tag), F.lit(message).cast("string")), COLUMNS, strict=True)]


def row_checks(df: DataFrame, node: Node, path: Column, schema_path: str, content: int = ALL) -> DataFrame:
    """Types, mandatory leaves, ``when``, ``must``, choices and leaf-list sizes of a list's entries, in one scan."""
    checks: list[tuple[Column, str, str, str, str | None]] = []

    def present(n: Node) -> Column:
        kids = [c for c in n.data_children() if c.name in df.columns] if n.kind in ("case", "choice") else [n]
        return reduce(lambda a, b: a | b, [F.col(f"`{k.name}`").isNotNull() for k in kids], F.lit(False))

    def holds(cond, at: Node | None = None) -> Column:
        """A condition in SQL, or an expression at the entry or one of its leaves."""
        if isinstance(cond, str):
            return F.coalesce(F.expr(cond), F.lit(False))
        names = [F.col(f"`{c.name}`") for c in node.data_children() if c.name in df.columns]
        ctx = paths.document(node, F.struct(*names))
        return cond.boolean(ctx if at is None else ctx.below(at, F.col(f"`{at.name}`")))

    def visit(n: Node, guards: list[str], needed: Column | None) -> None:
        own = n if n.kind in ("leaf", "leaf-list") and n.name in df.columns else None
        guards = guards + ([(n.when, own)] if n.when is not None else [])
        active = reduce(lambda a, b: a & b, [holds(*g) for g in guards], F.lit(True))
        if n.kind == "choice":
            cases = [present(c) for c in n.children]
            many = reduce(lambda a, b: a + b, [c.cast("int") for c in cases], F.lit(0))
            checks.append((many > 1, "schema", "member-not-allowed", n.name, None))
            if n.mandatory:
                checks.append((active & (many == 0), "schema", "missing-data", n.name, None))
            for c, here in zip(n.children, cases, strict=True):
                for k in c.children:
                    visit(k, guards + ([(c.when, None)] if c.when is not None else []), here)
            return
        if n.kind not in ("leaf", "leaf-list") or n.name not in df.columns or not n.content() & content:
            return
        value = F.col(f"`{n.name}`")
        here = value.isNotNull()
        if guards:
            checks.append((here & ~active, "schema", "member-not-allowed", n.name, None))
        if n.status == "obsolete":
            checks.append((here, "schema", "member-not-allowed", n.name, None))
        if n.is_mandatory(content) or n.name in node.keys:
            need = active if needed is None else active & needed
            checks.append((need & ~here, "schema", "list-key-missing" if n.name in node.keys else "missing-data", n.name, None))
        ok = ty.valid(value, n.type) if n.kind == "leaf" else F.forall(value, lambda v: ty.valid(v, n.type))
        checks.append((here & ~ok, "type", n.type.error_tag, n.name, n.type.error_message))
        if n.kind == "leaf-list":
            size = F.coalesce(F.size(value), F.lit(0))
            if n.min_elements:
                checks.append((size < n.min_elements, "semantic", "too-few-elements", n.name, None))
            if n.max_elements is not None:
                checks.append((size > n.max_elements, "semantic", "too-many-elements", n.name, None))
            if n.config:
                checks.append((here & (F.size(F.array_distinct(value)) < size), "semantic", "repeated-leaf-list-value", n.name, None))
        for m in n.must:
            checks.append((here & ~holds(m.condition, n), "semantic", m.tag, n.name, m.message))

    for child in node.children:
        visit(child, [], None)
    for m in node.must:
        checks.append((~holds(m.condition), "semantic", m.tag, "", m.message))
    found = F.array(*[F.when(bad, F.struct(F.lit(name).alias("name"), F.lit(cls).alias("cls"), F.lit(tag).alias("tag"), F.lit(msg).cast("string").alias("msg"))) for bad, cls, tag, name, msg in checks])
    rows = df.select(path.alias("path"), F.explode(F.array_compact(found)).alias("v"))
    join = lambda base: F.when(F.col("v.name") == "", base).otherwise(F.concat(base, F.lit("/"), F.col("v.name")))
    return rows.select(join(F.col("path")).alias("instance_path"), join(F.lit(schema_path)).alias("schema_path"), F.col("v.cls").alias("error_class"), F.col("v.tag").alias("error_tag"), F.col("v.msg").alias("error_message"))


def failing(df: DataFrame, node: Node, condition) -> DataFrame:
    """Entries of a list at which a path expression is false."""
    names = [F.col(f"`{c.name}`") for c in node.data_children() if c.name in df.columns]
    return df.filter(~condition.boolean(paths.document(node, F.struct(*names))))


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that several entries have, and how many (n)."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def duplicate_keys(df: DataFrame, keys: list[str], name: str, schema_path: str) -> DataFrame:
    """List keys that occur twice or more."""
    return repeated_keys(df, keys).select(*_violation(entry_path(name, keys), schema_path, "semantic", "non-unique-key", None))


def not_unique(df: DataFrame, parent: list[str], leaves: list[str], position: list[str]) -> DataFrame:
    """Value tuples that several entries of a parent hold; entries without some of the values do not count.

    A leaf-list gives a tuple for each of its values, so an entry can have several; those of one entry do not clash.
    """
    arrays = [c for c in leaves if df.schema[c].dataType.typeName() == "array"]
    for c in arrays:
        df = df.withColumn(c, F.explode(F.array_distinct(c)))
    full = df.dropna(subset=leaves)
    return full.groupBy(*parent, *leaves).agg(F.count_distinct(*position).alias("n")).filter("n > 1")


def with_unique_defaults(df: DataFrame, node: Node, leaves: list[str]) -> DataFrame:
    """``df`` with the defaults of these leaves where they are in use, as ``unique`` looks at them."""
    names = [F.col(f"`{c.name}`") for c in node.data_children() if c.name in df.columns]
    ctx = paths.document(node, F.struct(*names))
    inner = {c.name: c for c in node.data_children()}
    plain = lambda n: all(not isinstance(x.when, str) for x in [n, *[y for p in paths._cases_above(node, n) for y in p]])
    filled = {c: paths.in_use(ctx, inner[c]).cast(df.schema[c].dataType) for c in leaves if c in df.columns and paths.has_defaults(inner[c]) and plain(inner[c])}
    # conditions in SQL are the other form of ``when``
    sql = [inner[c] for c in leaves if c in df.columns and paths.has_defaults(inner[c]) and not plain(inner[c])]
    df = add_defaults(df, replace(node, children=tuple(sql))) if sql else df
    return df.withColumns(filled) if filled else df


def cardinality(parents: DataFrame, children: DataFrame, on: list[tuple[str, str]], least: int = 0, most: int | None = None) -> DataFrame:
    """Parents with too few or too many entries (none included): (keys, n, error_tag)."""
    keys = [p for p, _ in on]
    sizes = children.groupBy(*[F.col(c).alias(p) for p, c in on]).agg(F.count("*").alias("n"))
    counted = parents.select(*keys).join(sizes, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    tag = F.when(F.col("n") < least, "too-few-elements")
    tag = tag.when(F.col("n") > most, "too-many-elements") if most is not None else tag
    return counted.withColumn("error_tag", tag).filter("error_tag IS NOT NULL")


def missing_instances(df: DataFrame, leaf: str, target: DataFrame, target_leaf: str) -> DataFrame:
    """Rows whose reference has no target; an absent leaf refers to nothing.

    Distinct values are looked up, so of a value that many rows share each task sends one; the rows then meet the values
    without a target, which are few unless the data are broken.
    """
    wanted = target.select(F.col(target_leaf).alias("_target"))
    lost = df.select(F.col(leaf).alias("_value")).filter("_value IS NOT NULL").distinct().join(wanted, F.col("_value") == F.col("_target"), "left_anti")
    return df.join(lost, F.col(leaf) == F.col("_value"), "left_semi")


def validate_list(df: DataFrame, node: Node, tables: dict[str, DataFrame], content: int = ALL, scope: str = "all") -> DataFrame:
    """All violations of a top-level list.  ``scope``: all, syntax (row-local) or semantics (across rows)."""
    schema_path = f"/{node.ns}:{node.name}" if node.ns else f"/{node.name}"
    path = entry_path(node.name, list(node.keys))
    parts = []
    if scope in ("all", "syntax"):
        parts.append(row_checks(df, node, path, schema_path, content))
    if scope in ("all", "semantics"):
        if node.keys:
            parts.append(duplicate_keys(df, list(node.keys), node.name, schema_path))
        for leaves in node.unique:
            many = not_unique(with_unique_defaults(df, node, list(leaves)), [], list(leaves), list(node.keys))
            text = F.concat_ws(" ", *[F.col(x).cast("string") for x in leaves])
            parts.append(many.select(*_violation(F.concat(F.lit(f"/{node.name}["), text, F.lit("]")), schema_path, "semantic", "data-not-unique", None)))
        refs = [c for c in node.data_children(content) if c.leafref and c.require_instance and c.name in df.columns]
        if refs:
            parts.append(_lost_references(df, refs, tables, path, schema_path))
    return reduce(DataFrame.unionByName, parts)


def _lost_references(df: DataFrame, refs: list[Node], tables: dict[str, DataFrame], path: Column, schema_path: str) -> DataFrame:
    """Violations of all references of a list, in two passes over it.

    The first takes the distinct canonical values of each reference, so a value that many rows share is sent once a task,
    and keeps those without a target; the second names the rows that have them.
    """
    value = lambda c: F.struct(F.lit(c.name).alias("leaf"), ty.canon(F.col(f"`{c.name}`"), c.type).alias("value"))
    each = F.filter(F.array(*[value(c) for c in refs]), lambda r: r["value"].isNotNull())
    given = df.select(F.explode(each).alias("r")).select("r.leaf", "r.value").distinct()
    found = [tables[c.leafref[0]].select(F.lit(c.name).alias("leaf"), ty.canon(F.col(c.leafref[1]), c.type).alias("value")) for c in refs]
    lost = given.join(reduce(DataFrame.unionByName, found), ["leaf", "value"], "left_anti")
    rows = df.select(path.alias("path"), F.explode(each).alias("r")).select("path", "r.leaf", "r.value").join(lost, ["leaf", "value"], "left_semi")
    at = lambda base: F.concat(base, F.lit("/"), F.col("leaf"))
    return rows.select(at(F.col("path")).alias("instance_path"), at(F.lit(schema_path)).alias("schema_path"), F.lit("semantic").alias("error_class"), F.lit("instance-required").alias("error_tag"), F.lit(None).cast("string").alias("error_message"))


def value_counts(tables: dict[str, DataFrame], root: Node) -> DataFrame:
    """How many instances each leaf of each list has: (schema_path, n)."""
    out = []
    for lst in root.data_children():
        df = tables[lst.name]
        names = [c.name for c in lst.data_children() if c.name in df.columns]
        one = df.agg(*[F.count(f"`{n}`").alias(n) for n in names])
        stack = F.explode(F.array(*[F.struct(F.lit(f"/{lst.name}/{n}").alias("schema_path"), F.col(n).alias("n")) for n in names])).alias("c")
        out.append(one.select(stack).select("c.*"))
    return reduce(DataFrame.unionByName, out)

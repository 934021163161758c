"""Defaults, edits, merging and encoding: ordinary transformations; the input never changes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arbora.functions import types as ty
from arbora.operators.numbering import with_places
from arbora.plans.model import Node


def default_of(node: Node) -> Column:
    """A leaf's default as a literal of its decoded type."""
    if node.kind == "leaf-list":
        return F.array(*[F.lit(v) for v in node.default]).cast(f"array<{node.type.sql()}>")
    return F.lit(node.default).cast(node.type.sql()) if node.type.base != "string" else F.lit(node.default)


def add_defaults(df: DataFrame, node: Node, tag: bool = False) -> DataFrame:
    """Absent leaves get their defaults where ``when`` holds; with ``tag``, ``_defaults`` lists the leaves filled.

    A default inside a choice applies if its case is the active one, or the default case of a choice without any.
    """
    filled: dict[str, Column] = {}

    def visit(n: Node, active: Column) -> None:
        if n.when:
            active = active & F.coalesce(F.expr(n.when), F.lit(False))
        if n.kind == "choice":
            here = [reduce(lambda a, b: a | b, [F.col(f"`{k.name}`").isNotNull() for k in c.data_children() if k.name in df.columns], F.lit(False)) for c in n.children]
            none = ~reduce(lambda a, b: a | b, here, F.lit(False))
            for c, own in zip(n.children, here, strict=True):
                ok = own | none if c.name == n.default else own
                for k in c.children:
                    visit(k, active & ok & (F.coalesce(F.expr(c.when), F.lit(False)) if c.when else F.lit(True)))
        elif n.kind in ("leaf", "leaf-list") and n.default is not None and not n.mandatory and n.name in df.columns:
            filled[n.name] = F.when(active, default_of(n))

    for c in node.children:
        visit(c, F.lit(True))
    values = {k: F.coalesce(F.col(f"`{k}`"), v.cast(df.schema[k].dataType)) for k, v in filled.items()}
    if tag:
        names = [F.when(F.col(f"`{k}`").isNull() & v.isNotNull(), F.lit(k)) for k, v in filled.items()]
        values["_defaults"] = F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")
    return df.withColumns(values)


def put(df: DataFrame, leaf: str, value: Column, where: Column | None = None) -> DataFrame:
    """Set a member, of the entries where the condition holds."""
    return df.withColumn(leaf, value if where is None else F.when(where, value).otherwise(F.col(leaf)))


def delete_member(df: DataFrame, leaf: str, where: Column) -> DataFrame:
    return df.withColumn(leaf, F.when(~F.coalesce(where, F.lit(False)), F.col(leaf)))


def delete_entries(df: DataFrame, where: Column) -> DataFrame:
    return df.filter(~F.coalesce(where, F.lit(False)))


def delete_keys(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")


def insert(df: DataFrame, parent: list[str], order: list[str], new: DataFrame, after: bool = True) -> DataFrame:
    """Entries put behind (or before) those with the same order values; ``_pos`` is counted anew (from 0).

    ``new`` has the columns of ``df``; its order columns name the entry it goes next to.
    """
    old = df.withColumn("_side", F.lit(0)).withColumn("_new", F.lit(False))
    extra = new.withColumn("_side", F.lit(1 if after else -1)).withColumn("_new", F.lit(True))
    at = F.row_number().over(W.partitionBy(*parent).orderBy(*order, "_side")) - 1
    return old.unionByName(extra).withColumn("_pos", at).drop("_side")


def _taken(c: str, given: list[str], marks: list[str], members: str, old: bool) -> Column:
    """A member after a merge, of an entry ``a`` changed by ``b``, or (without ``old``) of ``b`` alone."""
    was = F.col(f"a.{c}") if old else F.lit(None)
    if c not in given:
        return was.alias(c)
    if members not in marks:
        return F.coalesce(F.col(f"b.{c}"), was).alias(c)
    named = F.coalesce(F.array_contains(f"b.{members}", c), F.lit(False))
    return F.when(named, F.col(f"b.{c}")).otherwise(was).alias(c)


def _merged_parts(df: DataFrame, changes: DataFrame, keys: list[str], members: str, deleted: str, also: list[Column]) -> tuple[DataFrame, DataFrame]:
    """The entries of ``df`` after their changes, and those that only ``changes`` has, with ``also`` beside them.

    Two joins instead of a full outer one: where a key is a constant of its own on each side, Spark makes the condition of
    the join FALSE, and a full outer join of that compares every pair of rows.
    """
    names = [c for c in df.columns if c not in keys]
    given = [c for c in names if c in changes.columns]
    marks = [c for c in (members, deleted) if c in changes.columns]
    stays = ~F.coalesce(F.col(f"b.{deleted}"), F.lit(False)) if deleted in marks else F.lit(True)
    a, b = df.alias("a"), changes.alias("b")
    kept = a.join(changes.select(*keys, *given, *marks).alias("b"), keys, "left").filter(stays)
    added = b.filter(stays).join(df.select(*keys), keys, "left_anti")
    kinds = {c: df.schema[c].dataType for c in names}
    fresh = {c: _taken(c, given, marks, members, False) if c in given else F.lit(None).cast(kinds[c]).alias(c) for c in names}
    return (
        kept.select(*keys, *[_taken(c, given, marks, members, True) for c in names]).select(*df.columns),
        added.select(*[fresh.get(c, F.col(f"b.{c}")) for c in df.columns], *also),
    )


def merge(df: DataFrame, changes: DataFrame, keys: list[str], members: str = "_set", deleted: str = "_deleted") -> DataFrame:
    """Entries matched by keys take the members that ``changes`` has; unmatched ones are added.

    Where ``changes`` has a column ``_set`` (names of members), the members named there are taken, NULL included, and no
    others; without it a NULL says that a member is not changed.  Entries with a true ``_deleted`` go.
    """
    kept, added = _merged_parts(df, changes, keys, members, deleted, [])
    return kept.unionByName(added)


def merge_ordered(df: DataFrame, changes: DataFrame, keys: list[str], parent: list[str] | None = None, place: str = "place") -> DataFrame:
    """``merge`` of a list whose entries carry their place within their parent.

    Matched entries keep their place; added ones go to the end of their parent's list, in the order of their own places.
    Their number among the added ones of a parent is a place in the order of all added entries less that of the parent's
    first, so a parent that a third of them share is no window of its own.
    """
    parent = parent or []
    ups = [f"_up{i}" for i in range(len(parent))]
    also = [F.col(f"b.{c}").alias(name) for c, name in zip([*parent, "_own"], [*ups, "_own"], strict=True)]
    kept, added = _merged_parts(df, changes.withColumnRenamed(place, "_own"), keys, "_set", "_deleted", also)
    ranked = with_places(added, [*ups, "_own", *[k for k in keys if k not in parent]], "_at")
    if parent:
        first = ranked.groupBy(*ups).agg(F.min("_at").alias("_first"))
        top = df.groupBy(*[F.col(p).alias(up) for p, up in zip(parent, ups, strict=True)]).agg((F.max(place) + 1).alias("_top"))
        ranked = ranked.join(first, ups, "left").join(top, ups, "left")
    else:
        top = df.agg((F.max(place) + 1).alias("_top"))
        ranked = ranked.withColumn("_first", F.lit(0)).crossJoin(F.broadcast(top))  # one row
    new_place = (F.coalesce("_top", F.lit(0)) + F.col("_at") - F.col("_first")).cast("long").alias(place)
    return kept.withColumn(place, F.col(place).cast("long")).unionByName(ranked.select(*[new_place if c == place else F.col(c) for c in df.columns]))


@dataclass(frozen=True)
class ListTable:
    """A list of a tree of lists: its key (those of the lists above first), and how many of it are its parent's."""

    name: str
    keys: tuple[str, ...]
    above: int = 0


def merge_tree(old: dict[str, DataFrame], new: dict[str, DataFrame], lists: list[ListTable], place: str = "place", wanted: list[str] | None = None) -> dict[str, DataFrame]:
    """Every list of a tree merged with its changes, from the top down; lists without changes lose what stood below deleted entries.

    With ``wanted``, names of lists, the others are not merged; of them only what is deleted is looked at.
    """
    out: dict[str, DataFrame] = {}
    lost: tuple[DataFrame, tuple[str, ...]] | None = None
    for own in lists:
        df, parent = old[own.name], list(own.keys[: own.above])
        changes = new.get(own.name)
        if lost is not None:
            gone = lost[0].select(*[F.col(k).alias(n) for k, n in zip(lost[1], parent, strict=True)])
            df = df.join(gone, parent, "left_anti")
            changes = changes.join(gone, parent, "left_anti") if changes is not None else None
        if wanted is None or own.name in wanted:
            out[own.name] = df if changes is None else merge_ordered(df, changes, list(own.keys), parent, place)
        removed = changes.filter("_deleted").select(*own.keys) if changes is not None and "_deleted" in changes.columns else None
        if lost is not None:
            above = old[own.name].join(gone, parent, "left_semi").select(*own.keys)
            removed = above if removed is None else removed.unionByName(above)
        lost = (removed.distinct(), own.keys) if removed is not None else None
    return out


def merge_leaf_list(a: Column, b: Column) -> Column:
    """Values of b that a lacks go to the end; repeated ones in b stay repeated."""
    return F.concat(a, F.filter(b, lambda x: ~F.array_contains(a, x)))


def merge_structs(a: Column, b: Column, names: list[str]) -> Column:
    """Containers, member by member."""
    both = F.struct(*[F.coalesce(b.getField(n), a.getField(n)).alias(n) for n in names])
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def replace_entry(array: Column, index: int, value: Column) -> Column:
    return F.transform(array, lambda x, i: F.when(i == index, value).otherwise(x))


def insert_entry(array: Column, index: int, value: Column, after: bool = False) -> Column:
    return F.array_insert(array, F.lit(index + 1 + after), value)


def etag(columns: list[str]) -> Column:
    """A hash of a row's value that does not depend on the order of its members.

    Names and values in turn, joined by the unit separator.  Within them it is escaped, as is the escape character, and
    NULL is an escape of its own, so different rows are different texts.
    """
    part = lambda x: F.replace(F.replace(x, F.lit("\x1b"), F.lit("\x1b0")), F.lit("\x1f"), F.lit("\x1b1"))
    parts = [x for c in sorted(columns) for x in (part(F.lit(c)), F.coalesce(part(F.col(f"`{c}`").cast("string")), F.lit("\x1b2")))]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def encode_json(df: DataFrame, node: Node, keep: Callable[[str], Column | bool] | None = None) -> Column:
    """An entry as JSON text in the raw encoding of its types; absent members are left out, and those that ``keep(name)`` refuses."""
    leaves = [c for c in node.data_children() if c.kind == "leaf" and c.name in df.columns]
    kept = [(c, True if keep is None else keep(c.name)) for c in leaves]
    value = lambda c, ok: ty.encode(F.col(f"`{c.name}`"), c.type) if ok is True else F.when(ok, ty.encode(F.col(f"`{c.name}`"), c.type))
    fields = [value(c, ok).alias(c.name) for c, ok in kept if ok is not False]
    return F.to_json(F.struct(*fields)) if fields else F.lit("{}")


def touched(df: DataFrame, changed: Column) -> DataFrame:
    """``_ts``: the time of a change, for the rows changed."""
    old = F.col("_ts") if "_ts" in df.columns else F.lit(None).cast("timestamp")
    return df.withColumn("_ts", F.when(changed, F.current_timestamp()).otherwise(old))

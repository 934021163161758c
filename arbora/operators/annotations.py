"""Annotations of documents: a side column of (path, notes) beside the document, filled by decoding, kept by edits, written by encoding.

In JSON, ``@`` holds the annotations of an object, ``@name`` those of the leaf beside it, and for a leaf-list an array with
an object or null for each entry.  The side column is an array of structs, sorted by path; paths are those of
``trees.nodes`` (``/`` for the document), and ``notes`` maps names of annotations to canonical strings.  Annotations that the
model does not define, values of the wrong type and targets that are not there are listed by ``note_errors`` and not kept.

An absent document has no annotations.  Paths that repeat (entries with equal keys) keep the first one's notes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from arbora.functions import types as ty
from arbora.operators import paths as px
from arbora.operators import trees
from arbora.operators.paths import Context, bound, document, let
from arbora.plans.model import Node

NOTES = "array<struct<path:string,notes:map<string,string>>>"
ERRORS = "array<struct<instance_path:string,error_class:string,error_tag:string>>"
#: The annotation of values that are there by default (a boolean).
DEFAULT = "ietf-netconf-with-defaults:default"

#: What is done at a place that may have annotations: (VARIANT of the notes, path, whether the target is there).
Visit = Callable[[Column, Column, Column], Column]


def _get(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$['{name}']", "variant")


def _walk(doc: Column, model: Node, value: Column, kind: str, visit: Visit) -> Column:
    """The arrays that ``visit`` gives for all places of annotations, one behind the other."""
    none = F.array().cast(kind)

    def members(v: Column, own: Context, path: Column, at: Column) -> Column:
        parts = [F.when(_get(v, "@").isNotNull(), visit(_get(v, "@"), at, F.lit(True))).otherwise(none)]
        for c in own.node.data_children():
            x = own.value.getField(c.name)
            full, name = f"{c.ns}:{c.name}", trees.qualified(c, own.node)
            raw = F.coalesce(_get(v, c.name), _get(v, full)) if c.ns else _get(v, c.name)
            note = F.coalesce(_get(v, f"@{c.name}"), _get(v, f"@{full}")) if c.ns else _get(v, f"@{c.name}")
            where = F.concat(path, F.lit(f"/{name}"))
            inside = own.below(c, x)
            if c.kind in ("leaf", "anydata"):
                parts.append(F.when(note.isNotNull(), visit(note, where, x.isNotNull())).otherwise(none))
            elif c.kind == "leaf-list":
                each = bound(lambda z, c, x, where: let(F.get(x, z["i"]), lambda e: F.when(F.schema_of_variant(z["n"]) != "VOID", visit(z["n"], F.concat(where, F.when(e.isNotNull(), trees.selector(c, e, z["i"])).otherwise(F.concat(F.lit("["), (z["i"] + 1).cast("string"), F.lit("]")))), e.isNotNull())).otherwise(none)), c, x, where)
                notes = F.transform(F.try_variant_get(note, "$", "array<variant>"), lambda n, i: F.struct(n.alias("n"), i.alias("i")))
                parts.append(F.coalesce(F.flatten(F.transform(notes, each)), none))
            elif c.kind == "container":
                parts.append(F.when(x.isNotNull(), members(raw, inside, where, where)).otherwise(none))
            else:
                raws = F.try_variant_get(raw, "$", "array<variant>")

                def entry(r: Column, i: Column, c: Node, x: Column, where: Column) -> Column:
                    def at_entry(e: Column) -> Column:
                        here = F.concat(where, trees.selector(c, e, i))
                        return members(r, own.below(c, e), here, here)

                    return let(F.get(x, i), at_entry)

                one = lambda c, x, where: lambda r, i: entry(r, i, c, x, where)
                parts.append(F.coalesce(F.flatten(F.transform(raws, one(c, x, where))), none))
        return F.concat(*parts)

    return F.when(value.isNotNull(), members(doc, document(model, value), F.lit(""), F.lit("/"))).otherwise(none)


def _sound(note: Column, known: dict[str, ty.Type]) -> Column:
    """The defined annotations with values of their types, as a map."""
    pairs = [F.struct(F.lit(name).alias("key"), ty.canon(ty.decode(_get(note, name), t), t).alias("value"), ty.valid(ty.decode(_get(note, name), t), t).alias("ok")) for name, t in known.items()]
    kept = F.filter(F.array(*pairs), lambda p: p["ok"] & p["value"].isNotNull())
    return F.map_from_entries(F.transform(kept, lambda p: F.struct(p["key"].alias("key"), p["value"].alias("value"))))


def decode_notes(doc: Column, model: Node, known: dict[str, ty.Type]) -> Column:
    """The annotations of a JSON document (VARIANT)."""

    def visit(note: Column, path: Column, there: Column) -> Column:
        own = _sound(note, known)
        return F.when(there & (F.size(own) > 0), F.array(F.struct(path.alias("path"), own.alias("notes")))).otherwise(F.array().cast(NOTES))

    if not known:
        return F.array().cast(NOTES)
    return let(trees.decode(doc, model), lambda value: normal(_walk(doc, model, value, NOTES, visit)))


def note_errors(doc: Column, model: Node, known: dict[str, ty.Type]) -> Column:
    """(instance_path, error_class, error_tag): annotations without a definition, of the wrong type, or without a target."""
    error = lambda path, tag: F.struct(path.alias("instance_path"), F.lit("annotation").alias("error_class"), F.lit(tag).alias("error_tag"))

    def visit(note: Column, path: Column, there: Column) -> Column:
        names = F.coalesce(F.map_keys(F.try_variant_get(note, "$", "map<string,variant>")), F.array().cast("array<string>"))
        odd = F.array_except(names, F.array(*[F.lit(n) for n in known])) if known else names
        found = [F.transform(odd, lambda n: error(F.concat(path, F.lit("/@"), n), "undefined-annotation"))]
        for name, t in known.items():
            own = _get(note, name)
            bad = own.isNotNull() & ~ty.valid(ty.decode(own, t), t)
            found.append(F.when(bad, F.array(error(F.concat(path, F.lit(f"/@{name}")), "raw-type"))).otherwise(F.array().cast(ERRORS)))
        lost = F.array(error(path, "missing-annotation-target"))
        return F.when(there, F.concat(*found)).otherwise(lost)

    return let(trees.decode(doc, model), lambda value: _walk(doc, model, value, ERRORS, visit))


def _path_order(a: Column, b: Column) -> Column:
    return F.when(a["path"] < b["path"], -1).when(a["path"] == b["path"], 0).otherwise(1)


def normal(notes: Column) -> Column:
    """Sorted by path, one row for each."""
    once = lambda s: F.filter(s, lambda e, i: (i == 0) | (e["path"] != F.get(s, i - 1)["path"]))
    return let(F.array_sort(notes, _path_order), once)


def notes_at(notes: Column, path: Column) -> Column:
    """The annotations of a path, looked up by halving; NULL where there are none."""
    hit = F.get(notes, px.place_in(F.transform(notes, lambda e: e["path"]), path))
    return F.when(hit["path"] == path, hit["notes"])


def annotate(notes: Column, path: str, name: str, value: Column) -> Column:
    """With one more annotation, or another value of it."""
    own = F.create_map(F.lit(name), value.cast("string"))
    old = F.filter(notes, lambda e: e["path"] == path)
    rest = F.map_filter(F.get(old, F.lit(0))["notes"], lambda k, v: k != name)
    both = F.map_concat(F.coalesce(rest, F.create_map().cast("map<string,string>")), own)
    return normal(F.concat(F.array(F.struct(F.lit(path).alias("path"), both.alias("notes"))), F.filter(notes, lambda e: e["path"] != path)))


def merge_notes(old: Column, new: Column) -> Column:
    """Annotations of two documents that are merged: those of ``new`` win, name by name."""
    blank = F.array().cast(NOTES)
    a, b = F.coalesce(old, blank), F.coalesce(new, blank)

    def joined(e: Column) -> Column:
        other = F.coalesce(notes_at(b, e["path"]), F.create_map().cast("map<string,string>"))
        kept = F.map_filter(e["notes"], lambda k, v: ~F.array_contains(F.map_keys(other), k))
        return F.struct(e["path"].alias("path"), F.map_concat(kept, other).alias("notes"))

    return normal(F.concat(F.transform(a, joined), b))


def keep_notes(notes: Column, ctx: Context) -> Column:
    """Annotations whose node is still there after an edit."""
    paths = F.array_sort(F.transform(trees.nodes(ctx), lambda n: n["path"]))
    return let(paths, lambda p: F.filter(notes, lambda e: ctx.value.isNotNull() & ((e["path"] == "/") | px.is_among(p, e["path"]))))


def tag_defaults(ctx: Context, notes: Column) -> Column:
    """With the tag of defaults at each leaf that is not in the document and has a default in use (leaf-lists: at their values)."""
    tag = F.create_map(F.lit(DEFAULT), F.lit("true"))
    used = F.transform(trees.defaults_in_use(ctx), lambda d: F.struct(d["path"].alias("path"), tag.alias("notes")))
    return merge_notes(notes, F.coalesce(used, F.array().cast(NOTES)))


def to_json(ctx: Context, notes: Column, known: dict[str, ty.Type]) -> Column:
    """The document as JSON text with its annotations."""

    def raw(own: Column) -> Column:
        """An object of annotations, in the raw encoding of their types; NULL for none."""
        value = lambda n, t: ty.encode(ty.parse(F.try_element_at(own, F.lit(n)), t), t).alias(n)
        return F.when(own.isNotNull(), F.struct(*[value(n, t) for n, t in known.items()]))

    def encode(own: Context, path: Column, at: Column) -> Column:
        fields = [raw(notes_at(notes, at)).alias("@")]
        for n in own.node.data_children():
            value = own.value.getField(n.name)
            name = trees.qualified(n, own.node)
            where = F.concat(path, F.lit(f"/{name}"))
            inside = own.below(n, value)
            if n.kind in ("leaf", "anydata"):
                fields.append((ty.encode(value, n.type) if n.kind == "leaf" else value).alias(name))
                fields.append(F.when(value.isNotNull(), raw(notes_at(notes, where))).alias(f"@{name}"))
            elif n.kind == "leaf-list":
                fields.append(F.when(F.size(value) > 0, F.transform(value, bound(lambda x, n: ty.encode(x, n.type), n))).alias(name))
                each = lambda n, where: lambda x, i: raw(notes_at(notes, F.concat(where, trees.selector(n, x, i))))
                every = F.transform(value, each(n, where))
                fields.append(F.when(F.exists(every, lambda e: e.isNotNull()), every).alias(f"@{name}"))
            elif n.kind == "container":
                body = encode(inside, where, where)
                fields.append(F.when(value.isNotNull() & (F.lit(True) if n.presence else F.to_json(body) != "{}"), body).alias(name))
            else:
                entry = lambda n, where: lambda x, i: encode(own.below(n, x), F.concat(where, trees.selector(n, x, i)), F.concat(where, trees.selector(n, x, i)))  # noqa: B023, E731
                fields.append(F.when(F.size(value) > 0, F.transform(value, entry(n, where))).alias(name))
        return F.struct(*fields)

    return F.when(ctx.value.isNotNull(), F.to_json(encode(ctx, F.lit(""), F.lit("/")))) if known else trees.to_json(ctx)

"""Nested documents: decoding and its errors, validation, defaults, encoding, routes, edits and merging.

A document is a struct of the model's shape in a row of its own (``document`` gives its context), and every operator here
is one Column of that row, recursive over the model: nothing is shuffled, and rows are exploded only where violations or
nodes are listed.  ``when`` and ``must`` are path expressions.

An absent document (NULL) has no violations and no nodes, and stays NULL when it is edited; an absent list counts as empty.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from arbora.functions import types as ty
from arbora.operators import paths as px
from arbora.operators.editing import default_of
from arbora.operators.navigation import InvalidKeyValue, NonDataNode, quoted
from arbora.operators.paths import Context, bound, document, leaf_default, let  # noqa: F401
from arbora.plans.model import ALL, Node, NonexistentSchemaNode

VIOLATION = "array<struct<instance_path:string,schema_path:string,error_class:string,error_tag:string,error_message:string>>"
NODE = "array<struct<path:string,pointer:string,schema_path:string,name:string,kind:string,value:string>>"
LEAVES = ("leaf", "leaf-list")


def _all(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def _any(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, terms, F.lit(False))


def _join(arrays: list[Column], kind: str) -> Column:
    return F.concat(*arrays) if arrays else F.array().cast(kind)


def qualified(node: Node, parent: Node) -> str:
    """A member's name, with its module where that is not the parent's."""
    return f"{node.ns}:{node.name}" if node.ns and node.ns != parent.ns else node.name


def selector(node: Node, value: Column, index: Column) -> Column:
    """What picks an entry of a list or leaf-list in a route: its keys, its value, or its place from 1."""
    if node.kind == "leaf-list":
        return F.concat(F.lit("[.="), quoted(F.coalesce(ty.canon(value, node.type), F.lit(""))), F.lit("]"))
    if not node.keys:
        return F.concat(F.lit("["), (index + 1).cast("string"), F.lit("]"))
    part = lambda k: F.concat(F.lit(f"[{k}="), quoted(F.coalesce(ty.canon(value.getField(k), node.data_child(k).type), F.lit(""))), F.lit("]"))
    return F.concat(*[part(k) for k in node.keys])


def _members(ctx: Context) -> list[tuple[Node, Column]]:
    return [(c, ctx.value.getField(c.name)) for c in ctx.node.data_children()]


def shape(node: Node, value: Column) -> Column:
    """A struct with the model's members only, in the model's order; members that the model lacks are left out."""
    fields = []
    for c in node.data_children():
        own = value.getField(c.name)
        if c.kind == "container":
            own = F.when(own.isNotNull(), shape(c, own))
        elif c.kind == "list":
            own = F.transform(own, bound(lambda x, c: shape(c, x), c))
        fields.append(own.alias(c.name))
    return F.struct(*fields)


# conditions


def holds(ctx: Context, condition) -> Column:
    """A ``when`` or ``must`` at a node."""
    if not isinstance(condition, px.Expr):
        raise TypeError(f"{ctx.node.name}: conditions inside documents are path expressions")
    return condition.boolean(ctx)


def _active(ctx: Context, child: Node, value: Column, outer: list) -> Column:
    """Whether ``when`` conditions allow a child: its own at the child, those of choices, cases and groups at the parent."""
    own = [holds(ctx.below(child, value), child.when)] if child.when is not None and child.kind in ("leaf", "container", "anydata") else []
    if child.when is not None and not own:
        own = [holds(ctx, child.when)]
    return _all([holds(ctx, w) for w in outer] + own)


def _present(ctx: Context, node: Node) -> Column:
    """Whether a data node, or any of a case or choice, is there; an empty list is not."""
    if node.kind in ("choice", "case"):
        return _any([_present(ctx, c) for c in node.children])
    value = ctx.value.getField(node.name)
    if node.kind in ("list", "leaf-list"):
        return F.coalesce(F.size(value) > 0, F.lit(False))
    if node.kind == "container" and not node.presence:
        return value.isNotNull() & _any([_present(ctx.below(node, value), c) for c in node.children]) if node.children else value.isNotNull()
    return value.isNotNull()


# validation


def violations(ctx: Context, content: int = ALL, scope: str = "all") -> Column:
    """All violations of a document, in the order of the model.  ``scope``: all, syntax (structure and types) or semantics."""
    checks = lambda own: _join(_with_references(own, lambda c: _check_members(c, F.lit(""), "", F.lit(True), content, scope), scope), VIOLATION)
    found = checks(ctx) if scope == "syntax" else _knowing_paths(ctx, checks)
    return F.coalesce(F.when(ctx.value.isNotNull(), found), F.array().cast(VIOLATION))


#: The schema paths to which a validation is limited, if it is.
_only: ContextVar[frozenset[str] | None] = ContextVar("arbora_only", default=None)


def _schema_path(nodes_: tuple[Node, ...]) -> str:
    """The schema path of a node given with its ancestors, as violations name it."""
    return "".join(f"/{qualified(n, above)}" for above, n in zip(nodes_, nodes_[1:], strict=False))


def _plain(path: str) -> str:
    return "/".join(step.rpartition(":")[2] for step in path.split("/"))


def affected(model: Node, edited: list[str]) -> frozenset[str]:
    """Schema paths whose checks an edit at these schema paths can change.

    A check reads its own node with all above and below it, the other nodes of the choices it stands in, and what its
    conditions (``when`` of its own, of choices and cases; ``must``), reference and defaults lead to.  Identifiers may lead
    anywhere.  Values above an edited node, and those below, are edited with it.
    """
    changed = [tuple(_plain(e).strip("/").split("/")) if e.strip("/") else () for e in edited]
    out: set[str] = set()

    def meets(read: tuple[str, ...]) -> bool:
        return any(e[: len(read)] == read or read[: len(e)] == e for e in changed)

    def visit(chain: tuple[Node, ...], names: tuple[str, ...], holder: Node, outer: list) -> None:
        parent = chain[-1]
        for c in holder.children:
            if c.kind in ("choice", "case"):
                below = [k.name for k in c.data_children()]
                guards = outer + ([c.when] if c.when is not None else [])
                read = {(*names, k) for k in below} | {r for w in guards for r in px.reads(chain, w)}
                if c.kind == "choice" and any(map(meets, read)):
                    out.add(f"{_schema_path(chain)}/{c.name}")
                visit(chain, names, c, guards)
                continue
            if c.kind not in (*LEAVES, "list", "container", "anydata"):
                continue
            own, path = (*chain, c), (*names, c.name)
            read = {path}
            for choice, _ in px._cases_above(parent, c):
                read |= {(*names, k.name) for k in choice.data_children()}
            conditions = [(chain, w) for w in outer] + [(own if c.kind in ("leaf", "container", "anydata") else chain, w) for w in ([c.when] if c.when is not None else [])]
            conditions += [(own, m.condition) for m in c.must]
            for at, w in conditions:
                read |= px.reads(at, w)
            target = px.target_path(c) if c.type else None
            if target is not None:
                read |= px.reads(own, target)
            for leaves in c.unique:
                for leaf in leaves:
                    p = px.here
                    for step in leaf.split("/"):
                        p = p.child(step)
                    read |= px.reads(own, p)
            if (c.type and c.type.base == "instance-identifier" and changed) or any(map(meets, read)):
                out.add(_schema_path(own))
            if c.kind in ("container", "list"):
                visit(own, path, c, [])

    visit((model,), (), model, [])
    return frozenset(out)


def _with_references(ctx: Context, checks: Callable[[Context], list[Column]], scope: str) -> list[Column]:
    """Arrays of violations below a node, with the targets of the references that go down from it gathered once."""
    if scope == "syntax" or not px.leafrefs_based_at(ctx):
        return checks(ctx)
    only = _only.get()
    wanted = None if only is None else lambda ref: _schema_path(ref.nodes) in only
    return [px.with_targets(ctx, lambda own: _join(checks(own), VIOLATION), wanted=wanted)]


def identifier_leaves(model: Node) -> list[tuple[str, Node]]:
    """(schema path, leaf) of the instance identifiers that have to lead to a node."""
    return [(path, n) for path, n in model.walk() if n.type and n.type.base == "instance-identifier" and n.require_instance]


def _knowing_paths(ctx: Context, use: Callable[[Context], Column]) -> Column:
    """``use`` of the document with the sorted paths of its nodes, where its model has instance identifiers."""
    only = _only.get()
    if not [path for path, _ in identifier_leaves(ctx.node) if only is None or _plain(path) in {_plain(p) for p in only}]:
        return use(ctx)
    every = F.array_sort(F.transform(nodes(ctx), lambda n: n["path"]))
    return let(every, lambda paths: use(replace(ctx, known=(*ctx.known, (PATHS, paths)))))


#: The name of the sorted paths of a document's nodes among the things known of it.
PATHS = "//paths"


def validate(df: DataFrame, model: Node, doc: str = "doc", content: int = ALL, scope: str = "all", first_only: bool = False, only: frozenset[str] | None = None) -> DataFrame:
    """The columns of ``df`` but the document, with its violations as rows and their place ``seq``; of the first only with ``first_only``.

    With ``only``, schema paths as ``affected`` gives them, no other node is checked.
    """
    keep = [c for c in df.columns if c != doc]
    before = _only.set(only)
    try:
        found = violations(document(model, F.col(doc)), content, scope)
    finally:
        _only.reset(before)
    # the array is a column of its own first: a generator over parts of a struct can lose rows when columns are pruned
    rows = df.select(*keep, (F.slice(found, 1, 1) if first_only else found).alias("_found"))
    return rows.select(*keep, F.posexplode("_found").alias("seq", "v")).select(*keep, "seq", "v.*")


def instance_counts(model: Node, doc: Column) -> list[tuple[str, Column]]:
    """(schema path, number of instances in a document) of each schema node, as ``nodes`` would list them."""
    out: list[tuple[str, Column]] = []

    def visit(node: Node, path: str, total: Callable[[Callable[[Column], Column]], Column]) -> None:
        for c in node.data_children():
            own = f"{path}/{qualified(c, node)}"
            field = bound(lambda v, c: v.getField(c.name), c)
            many = c.kind in ("list", "leaf-list")
            one = lambda v, field=field, many=many: F.coalesce(F.size(field(v)).cast("long"), F.lit(0)) if many else field(v).isNotNull().cast("long")
            out.append((own, total(lambda v, one=one: F.coalesce(one(v), F.lit(0).cast("long")))))
            if c.kind == "container":
                visit(c, own, lambda use, total=total, field=field: total(lambda v: use(field(v))))
            elif c.kind == "list":
                add = lambda use, field=field: lambda v: F.coalesce(F.aggregate(F.transform(field(v), lambda x: use(x)), F.lit(0).cast("long"), lambda a, n: a + n), F.lit(0).cast("long"))
                visit(c, own, lambda use, total=total, add=add: total(add(use)))

    visit(model, "", lambda use: use(doc))
    return out


def validate_counted(df: DataFrame, model: Node, doc: str = "doc", content: int = ALL, scope: str = "all") -> tuple[DataFrame, Observation]:
    """``validate``, and how many instances each schema node has, observed while the violations are found.

    ``observed_counts`` gives them once the violations were asked for; the documents are read once.
    """
    keep = [c for c in df.columns if c != doc]
    seen, counts = Observation(), instance_counts(model, F.col(doc))
    found = violations(document(model, F.col(doc)), content, scope)
    rows = df.select(*keep, found.alias("_found"), *[n.alias(f"_n{i}") for i, (_, n) in enumerate(counts)])
    rows = rows.observe(seen, *[F.sum(f"_n{i}").alias(path) for i, (path, _) in enumerate(counts)])
    rows = rows.select(*keep, "_found").select(*keep, F.posexplode("_found").alias("seq", "v"))
    return rows.select(*keep, "seq", "v.*"), seen


def observed_counts(seen: Observation) -> dict[str, int]:
    """The counts of ``validate_counted``, of the schema nodes that have instances; waits for the query that it belongs to."""
    return {path: n for path, n in seen.get.items() if n}


def _violation(bad: Column, path: Column, schema_path: str, cls: str, tag: str, message: str | None = None) -> Column:
    parts = zip(("instance_path", "schema_path", "error_class", "error_tag", "error_message"), (path, F.lit(schema_path), F.lit(cls), F.lit(tag), F.lit(message).cast("string")), strict=True)
    return F.when(bad, F.struct(*[c.alias(n) for n, c in parts]))


def _check_members(ctx: Context, path: Column, schema_path: str, exists: Column, content: int, scope: str) -> list[Column]:
    """Arrays of violations of a container's or entry's members."""
    out: list[Column] = []
    syntax, semantics = scope in ("all", "syntax"), scope in ("all", "semantics")

    only = _only.get()
    checked = lambda sp: only is None or sp in only
    entered = lambda sp: only is None or any(p.startswith(f"{sp}/") for p in only)

    def note(*checks: Column) -> None:
        if checks:
            out.append(F.array_compact(F.array(*checks)))

    def visit(n: Node, outer: list, needed: Column) -> None:
        if n.kind == "choice":
            guards = outer + ([n.when] if n.when is not None else [])
            here = [_present(ctx, c) for c in n.children]
            many = reduce(lambda a, b: a + b, [h.cast("int") for h in here], F.lit(0))
            at, spath = F.concat(path, F.lit(f"/{n.name}")), f"{schema_path}/{n.name}"
            if syntax and checked(spath):
                note(_violation(many > 1, at, spath, "schema", "member-not-allowed"))
                if n.mandatory:
                    note(_violation(needed & _all([holds(ctx, w) for w in guards]) & (many == 0), at, spath, "schema", "missing-data"))
            for c, own in zip(n.children, here, strict=True):
                for k in c.children:
                    visit(k, guards + ([c.when] if c.when is not None else []), needed & own)
            return
        if n.kind not in (*LEAVES, "list", "container", "anydata") or not n.content() & content:
            return
        value = ctx.value.getField(n.name)
        name = qualified(n, ctx.node)
        at, spath = F.concat(path, F.lit(f"/{name}")), f"{schema_path}/{name}"
        if not checked(spath) and not entered(spath):
            return
        here = _present(ctx, n)
        active = _active(ctx, n, value, outer)
        if syntax and checked(spath):
            if outer or n.when is not None:
                note(_violation(here & ~active, at, spath, "schema", "member-not-allowed"))
            if n.status == "obsolete":
                note(_violation(here, at, spath, "schema", "member-not-allowed"))
            if n.kind in ("leaf", "anydata") and n.is_mandatory(content) and n.name not in ctx.node.keys:
                note(_violation(exists & needed & active & value.isNull(), at, spath, "schema", "missing-data"))
        if n.name in ctx.node.keys and ctx.node.kind == "list" and semantics and checked(spath):
            note(_violation(exists & value.isNull(), at, spath, "schema", "list-key-missing"))
        own = ctx.below(n, value)
        if n.kind == "leaf":
            out.extend(_check_leaf(own, at, spath, value.isNotNull(), syntax, semantics))
        elif n.kind == "container":
            there = value.isNotNull() if n.presence else exists & needed & active
            if semantics and checked(spath):
                note(*[_violation(value.isNotNull() & ~holds(own, m.condition), at, spath, "semantic", m.tag, m.message) for m in n.must])
            out.extend(_with_references(own, lambda c: _check_members(c, at, spath, there, content, scope), scope))
        elif n.kind in ("list", "leaf-list"):
            size = F.coalesce(F.size(value), F.lit(0))
            if semantics and checked(spath):
                if n.min_elements:
                    note(_violation(exists & needed & active & (size < n.min_elements), at, spath, "semantic", "too-few-elements"))
                if n.max_elements is not None:
                    note(_violation(size > n.max_elements, at, spath, "semantic", "too-many-elements"))
                out.extend(_check_uniqueness(ctx, n, value, at, spath))

            def entry(x: Column, i: Column) -> Column:
                inside = ctx.below(n, x, F.concat(ctx.at, F.array(F.lit(0), i.cast("int"))))
                where = F.concat(at, selector(n, x, i))
                checks = _check_leaf(inside, where, spath, F.lit(True), syntax, semantics) if n.kind == "leaf-list" else _with_references(inside, lambda c: _check_members(c, where, spath, F.lit(True), content, scope), scope)
                if semantics and n.kind == "list" and checked(spath):
                    checks = [*checks, F.array_compact(F.array(*[_violation(~holds(inside, m.condition), where, spath, "semantic", m.tag, m.message) for m in n.must]))] if n.must else checks
                return _join(checks, VIOLATION)

            out.append(F.coalesce(F.flatten(F.transform(value, entry)), F.array().cast(VIOLATION)))

    for child in ctx.node.children:
        visit(child, [], F.lit(True))
    return out


def _check_leaf(ctx: Context, path: Column, schema_path: str, here: Column, syntax: bool, semantics: bool) -> list[Column]:
    n, checks = ctx.node, []
    if syntax:
        checks.append(_violation(here & ~ty.valid(ctx.value, n.type), path, schema_path, "type", n.type.error_tag, n.type.error_message))
    if semantics:
        checks += [_violation(here & ~holds(ctx, m.condition), path, schema_path, "semantic", m.tag, m.message) for m in n.must]
        target = px.target_path(n)
        if target is not None and n.require_instance:
            gathered = ctx.find_known(px.reference_name(ctx.nodes))
            if gathered is not None:
                lost = ~px.is_among(gathered, px.string_value(n, ctx.value))
            else:  # a path that depends on more than where it begins
                lost = ~(target == px.string(px.current())).boolean(ctx)
            checks.append(_violation(here & lost, path, schema_path, "semantic", "instance-required"))
        paths = ctx.find_known(PATHS)
        if n.type.base == "instance-identifier" and n.require_instance and paths is not None:
            checks.append(_violation(here & ~px.is_among(paths, ty.normal_instance_id(ctx.value, ctx.nodes[0].ns)), path, schema_path, "semantic", "instance-required"))
    return [F.array_compact(F.array(*checks))] if checks else []


def _repeated(values: Column) -> Column:
    """Each value that an array holds twice or more, once."""
    second = lambda s: F.filter(s, lambda k, i: (i > 0) & (k == F.get(s, i - 1)) & ((i < 2) | F.coalesce(k != F.get(s, i - 2), F.lit(True))))
    return let(F.array_sort(values), second)


def unique_tuples(entry: Context, leaves: tuple[str, ...]) -> Column:
    """All combinations (``u0``, ``u1``, ...) of the canonical values that an entry has at paths of leaves, defaults in use.

    An entry without a value at some path has none.
    """
    found = []
    for leaf in leaves:
        path = px.here
        for step in leaf.split("/"):
            path = path.child(step)
        found.append(path.strings(entry))

    def product(j: int, chosen: list[Column]) -> Column:
        if j == len(found):
            return F.array(F.struct(*[c.alias(f"u{i}") for i, c in enumerate(chosen)]))
        return F.flatten(F.transform(found[j], lambda v: product(j + 1, [*chosen, v])))

    return product(0, [])


def _check_uniqueness(ctx: Context, n: Node, value: Column, path: Column, schema_path: str) -> list[Column]:
    """Repeated values of a leaf-list of configuration, keys of a list, and the leaves that ``unique`` names."""
    flagged = lambda values, text, cls, tag: F.coalesce(F.transform(_repeated(values), lambda k: _violation(F.lit(True), F.concat(path, text(k)), schema_path, cls, tag)), F.array().cast(VIOLATION))
    if n.kind == "leaf-list":
        if not n.config:
            return []
        texts = F.transform(value, lambda x: ty.canon(x, n.type))
        return [flagged(texts, lambda k: F.concat(F.lit("[.="), quoted(k), F.lit("]")), "semantic", "repeated-leaf-list-value")]
    out = []
    if n.keys:
        keys = F.transform(value, lambda x: F.struct(*[x.getField(k).alias(k) for k in n.keys]))
        whole = F.filter(keys, lambda k: _all([k[name].isNotNull() for name in n.keys]))
        out.append(flagged(whole, lambda k: selector(n, k, F.lit(0)), "semantic", "non-unique-key"))
    for leaves in n.unique:
        tuples = F.flatten(F.transform(value, bound(lambda x, leaves: F.array_distinct(unique_tuples(ctx.below(n, x), leaves)), leaves)))
        text = lambda u, k=len(leaves): F.concat(F.lit("["), F.concat_ws(" ", *[u[f"u{j}"] for j in range(k)]), F.lit("]"))
        out.append(flagged(tuples, text, "semantic", "data-not-unique"))
    return out


# defaults


def with_defaults(ctx: Context, content: int = ALL) -> Column:
    """The value of a container, an entry or the document with all defaults in use.

    Containers without presence are made wherever their ``when`` holds; defaults in a choice count in the case that is
    there, or in the default case where none is.
    """
    made: dict[str, Column] = {}

    def visit(n: Node, outer: list, active: Column) -> None:
        if n.kind == "choice":
            here = [_present(ctx, c) for c in n.children]
            none = ~_any(here)
            guards = outer + ([n.when] if n.when is not None else [])
            for c, own in zip(n.children, here, strict=True):
                for k in c.children:
                    visit(k, guards + ([c.when] if c.when is not None else []), active & (own | none if c.name == n.default else own))
            return
        value = ctx.value.getField(n.name)
        if not n.content() & content:
            made[n.name] = value
            return
        allowed = active & _active(ctx, n, value, outer)
        if n.kind in LEAVES:
            default = leaf_default(n)
            made[n.name] = value
            if default is not None:
                given = default_of(_with_default(n, default))
                missing = value.isNull() | (F.size(value) == 0) if n.kind == "leaf-list" else value.isNull()
                made[n.name] = F.when(missing & allowed, given).otherwise(value)
        elif n.kind == "container":
            there = value.isNotNull() if n.presence else value.isNotNull() | allowed
            made[n.name] = F.when(there, with_defaults(ctx.below(n, value), content))
        elif n.kind == "list":
            made[n.name] = F.transform(value, lambda x, i: with_defaults(ctx.below(n, x, F.concat(ctx.at, F.array(F.lit(0), i.cast("int")))), content))
        else:
            made[n.name] = value

    for child in ctx.node.children:
        visit(child, [], F.lit(True))
    return F.struct(*[made.get(c.name, ctx.value.getField(c.name)).alias(c.name) for c in ctx.node.data_children()])


def _with_default(node: Node, default) -> Node:
    from dataclasses import replace

    return replace(node, default=default)


def add_defaults(ctx: Context, content: int = ALL) -> Column:
    """The document with all defaults in use; an absent one stays absent."""
    return F.when(ctx.value.isNotNull(), with_defaults(ctx, content))


def defaults_in_use(ctx: Context) -> Column:
    """(path, value) of each leaf that is absent from the document and has a default in use."""
    filled = nodes(document(ctx.node, with_defaults(ctx)))
    own = F.transform(nodes(ctx), lambda n: n["path"])
    new = lambda have: F.filter(filled, lambda n: n["value"].isNotNull() & ~F.array_contains(have, n["path"]))
    pair = lambda n: F.struct(n["path"].alias("path"), n["value"].alias("value"))
    return F.when(ctx.value.isNotNull(), F.transform(let(own, new), pair))


# encoding

#: ``keep(schema path, context)``: True, False or a Column that says whether a node is written.
Filter = Callable[[str, Context], "Column | bool"]


def encode(ctx: Context, keep: Filter | None = None, path: str = "") -> Column:
    """The value in its raw encoding, as a struct for ``to_json``: absent, filtered and empty members are NULL."""
    fields = []
    for n, value in _members(ctx):
        own = ctx.below(n, value)
        where = f"{path}/{n.name}"
        allowed = True if keep is None else keep(where, own)
        if allowed is False:
            continue

        def entry(x: Column, n: Node, where: str) -> Column:
            inside = ctx.below(n, x)
            raw = ty.encode(x, n.type) if n.kind == "leaf-list" else encode(inside, keep, where)
            ok = True if keep is None else keep(f"{where}/*", inside)
            return raw if ok is True else F.when(F.lit(False) if ok is False else ok, raw)

        if n.kind == "leaf":
            raw = ty.encode(value, n.type)
        elif n.kind == "container":
            raw = encode(own, keep, where)
            raw = F.when(value.isNotNull() & (F.lit(True) if n.presence else F.to_json(raw) != "{}"), raw)
        elif n.kind in ("list", "leaf-list"):
            raw = F.filter(F.transform(value, bound(entry, n, where)), lambda x: x.isNotNull())
            raw = F.when(F.size(raw) > 0, raw)
        else:
            raw = value
        if allowed is not True:
            raw = F.when(allowed, raw)
        fields.append(raw.alias(qualified(n, ctx.node)))
    return F.struct(*fields) if fields else F.struct(F.lit(None).cast("string").alias("_"))


def to_json(ctx: Context, keep: Filter | None = None) -> Column:
    """A document as JSON text."""
    return F.when(ctx.value.isNotNull(), F.to_json(encode(ctx, keep)))


def _escaped(s: Column) -> Column:
    # a carriage return would be read as a line end
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def to_xml(ctx: Context, urns: dict[str, str], tag: str = "content-data", keep: Filter | None = None) -> Column:
    """A document as XML under ``tag``; an element names its namespace (``urns`` by module) where that changes."""

    def members(own: Context, path: str) -> Column:
        parts = []
        for n, value in _members(own):
            where = f"{path}/{n.name}"
            allowed = True if keep is None else keep(where, own.below(n, value))
            if allowed is False or n.kind == "anydata":
                continue
            ns = f' xmlns="{urns.get(n.ns, n.ns)}"' if n.ns != own.node.ns and n.ns else ""

            def element(x: Column, n: Node, ns: str, where: str) -> Column:
                body = _escaped(ty.canon(x, n.type)) if n.kind in LEAVES else members(own.below(n, x), where)
                return F.concat(F.lit(f"<{n.name}{ns}>"), body, F.lit(f"</{n.name}>"))

            one = bound(element, n, ns, where)
            text = F.array_join(F.transform(value, one), "") if n.kind in ("list", "leaf-list") else F.when(value.isNotNull(), one(value))
            parts.append(F.coalesce(text if allowed is True else F.when(allowed, text), F.lit("")))
        return F.concat(*parts) if parts else F.lit("")

    return F.when(ctx.value.isNotNull(), F.concat(F.lit(f"<{tag}>"), members(ctx, ""), F.lit(f"</{tag}>")))


def from_xml(text: Column, model: Node, urns: dict[str, str] | None = None) -> Column:
    """The document in XML text, by namespaces (``urns`` by module); NULL for a text that is no XML.  See ``sources.xml``."""
    from arbora.sources import xml

    return xml.parse(text, model, urns)[0]


# decoding


def decode(doc: Column, model: Node) -> Column:
    """The struct of a JSON document (VARIANT); members that are absent or of the wrong kind are NULL."""
    from arbora.sources.documents import decode as members

    return F.when(doc.isNotNull(), F.struct(*members(doc, model)))


def decode_part(raw: Column, model: Node, path: str, entry: bool = False) -> Column:
    """A VARIANT decoded by the schema node at a data path: a whole member, or with ``entry`` one entry of a list or leaf-list.

    NULL where it is of another kind.  The model's root has the empty path.
    """
    node = model.data_node(path)
    if entry and node.kind not in ("list", "leaf-list"):
        raise NonexistentSchemaNode(f"{path} has no entries")
    if node.kind in LEAVES:
        one = lambda v: ty.decode(v, node.type)
    elif node.kind == "anydata":
        return raw
    else:
        one = lambda v: F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), decode(v, node))
    if entry or node.kind not in ("list", "leaf-list"):
        return one(raw)
    return F.transform(F.try_variant_get(raw, "$", "array<variant>"), one)


def violations_at(ctx: Context, part: Column, path: str, content: int = ALL, scope: str = "all") -> Column:
    """Violations of a part that stands alone: the document with nothing but this member, checked at and below it.

    Conditions and references see no more than that; what is mandatory beside the part is not asked for.
    """
    steps = [s for s in path.split("/") if s]

    def around(node: Node, rest: list[str]) -> Column:
        if not rest:
            return part
        own = node.data_child(rest[0])
        if own.kind == "list" and len(rest) > 1:
            raise NonexistentSchemaNode(f"{path}: below entries of {own.name}")
        blank = lambda c: F.lit(None).cast(c.data_type())
        return F.struct(*[(around(own, rest[1:]) if c is own else blank(c)).alias(c.name) for c in node.data_children()])

    chain = ctx.node.ancestry(path)
    top = _schema_path(chain)
    below = frozenset([top, *[f"{top}{p}" for p, _ in _walk_qualified(chain[-1])]])
    before = _only.set(below)
    try:
        return F.when(part.isNotNull(), violations(document(ctx.node, around(ctx.node, steps)), content, scope)).otherwise(F.array().cast(VIOLATION))
    finally:
        _only.reset(before)


def _walk_qualified(node: Node, path: str = ""):
    """(schema path, node) below a node, with choices as violations name them."""
    for c in node.children:
        if c.kind == "choice":
            yield f"{path}/{c.name}", c
    for c in node.data_children():
        own = f"{path}/{qualified(c, node)}"
        yield own, c
        if c.kind in ("container", "list"):
            yield from _walk_qualified(c, own)


def decode_errors(doc: Column, model: Node, annotations: dict[str, ty.Type] | None = None) -> Column:
    """(instance_path, error_class, error_tag) of unknown members, values of the wrong kind and unknown or ill-typed annotations.

    The path of an entry has its keys behind ``=`` where they can be read, else its place from 0.
    """
    empty = F.array().cast("array<struct<instance_path:string,error_class:string,error_tag:string>>")
    error = lambda path, tag: F.struct(path.alias("instance_path"), F.lit("decode").alias("error_class"), F.lit(tag).alias("error_tag"))
    known_notes = annotations or {}

    def get(v: Column, name: str) -> Column:
        return F.try_variant_get(v, f"$['{name}']", "variant")

    def kind_of(v: Column, name: str) -> Column:
        return F.startswith(F.schema_of_variant(v), F.lit(name))

    def members(v: Column, n: Node, path: Column) -> Column:
        names = {x for c in n.data_children() for x in ((c.name, f"{c.ns}:{c.name}") if c.ns else (c.name,))}
        keys = F.coalesce(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), F.array().cast("array<string>"))
        bare = lambda k: F.regexp_replace(k, r"\A@", "")
        odd = F.filter(keys, lambda k: ~F.coalesce(bare(k).isin(*names), F.lit(False)) & (k != "@"))
        out = [F.transform(odd, lambda k: error(F.concat(path, F.lit("/"), k), "raw-member"))]
        notes = F.filter(keys, lambda k: F.startswith(k, F.lit("@")))
        note = lambda k: F.try_variant_get(v, "$", "map<string,variant>")[k]
        given = lambda k: F.coalesce(F.map_keys(F.try_variant_get(note(k), "$", "map<string,variant>")), F.array().cast("array<string>"))
        allowed = F.array(*[F.lit(a) for a in known_notes]) if known_notes else F.array().cast("array<string>")
        out.append(F.flatten(F.transform(notes, lambda k: F.transform(F.array_except(given(k), allowed), lambda a: error(F.concat(path, F.lit("/"), k, F.lit("/"), a), "raw-member")))))
        for name, t in known_notes.items():
            wrong = F.filter(notes, bound(lambda k, name, t: F.coalesce(get(note(k), name).isNotNull() & ~ty.valid(ty.decode(get(note(k), name), t), t), F.lit(False)), name, t))
            out.append(F.transform(wrong, bound(lambda k, name: error(F.concat(path, F.lit("/"), k, F.lit(f"/{name}")), "raw-type"), name)))
        for c in n.data_children():
            own = get(v, c.name) if not c.ns else F.coalesce(get(v, c.name), get(v, f"{c.ns}:{c.name}"))
            out.append(value(own, c, F.concat(path, F.lit(f"/{qualified(c, n)}"))))
        return F.concat(*out)

    def value(v: Column, n: Node, path: Column) -> Column:
        wrong = F.array(error(path, "raw-type"))
        if n.kind == "anydata":
            return empty
        if n.kind == "leaf":
            return F.when(v.isNotNull() & ty.decode(v, n.type).isNull(), wrong).otherwise(empty)
        if n.kind == "container":
            return F.when(v.isNull(), empty).when(~kind_of(v, "OBJECT"), wrong).otherwise(members(v, n, path))

        def entry(x: Column, i: Column) -> Column:
            if n.kind == "leaf-list":
                at = F.concat(path, F.lit("/"), i.cast("string"))
                return F.when(ty.decode(x, n.type).isNull(), F.array(error(at, "raw-type"))).otherwise(empty)
            texts = [F.coalesce(F.try_variant_get(x, f"$['{k}']", "string"), F.try_variant_get(x, f"$['{n.data_child(k).ns}:{k}']", "string")) for k in n.keys]
            at = F.concat(path, F.when(_all([t.isNotNull() for t in texts]), F.concat(F.lit("="), F.concat_ws(",", *texts))).otherwise(F.concat(F.lit("/"), i.cast("string")))) if texts else F.concat(path, F.lit("/"), i.cast("string"))
            return F.when(kind_of(x, "OBJECT"), members(x, n, at)).otherwise(F.array(error(at, "raw-type")))

        items = F.try_variant_get(v, "$", "array<variant>")
        return F.when(v.isNull(), empty).when(~kind_of(v, "ARRAY"), wrong).otherwise(F.flatten(F.transform(items, entry)))

    return F.when(doc.isNull(), empty).when(~kind_of(doc, "OBJECT"), F.array(error(F.lit("/"), "raw-type"))).otherwise(members(doc, model, F.lit("")))


def member_names(ctx: Context) -> Column:
    """Names of the members that a container, an entry or the document has."""
    return F.array_compact(F.array(*[F.when(v.isNotNull(), F.lit(qualified(c, ctx.node))) for c, v in _members(ctx)]))


# all nodes


def nodes(ctx: Context) -> Column:
    """Every node of a document in document order: its route, JSON pointer, schema path, name, kind and canonical value."""

    def below(own: Context, path: Column, pointer: Column, schema_path: str) -> Column:
        parts = []
        for n, value in _members(own):
            name = qualified(n, own.node)

            def one(x: Column, at: Column, to: Column, n: Node, name: str) -> Column:
                text = ty.canon(x, n.type) if n.kind in LEAVES else F.lit(None).cast("string")
                row = F.array(F.struct(at.alias("path"), to.alias("pointer"), F.lit(f"{schema_path}/{name}").alias("schema_path"), F.lit(name).alias("name"), F.lit(n.kind).alias("kind"), text.alias("value")))
                return F.concat(row, below(own.below(n, x), at, to, f"{schema_path}/{name}")) if n.kind in ("container", "list") else row

            at, to = F.concat(path, F.lit(f"/{name}")), F.concat(pointer, F.lit(f"/{name}"))
            if n.kind in ("list", "leaf-list"):
                entry = lambda n, name, at, to: lambda x, i: one(x, F.concat(at, selector(n, x, i)), F.concat(to, F.lit("/"), i.cast("string")), n, name)  # noqa: B023, E731
                parts.append(F.coalesce(F.flatten(F.transform(value, entry(n, name, at, to))), F.array().cast(NODE)))
            else:
                parts.append(F.when(value.isNotNull(), one(value, at, to, n, name)).otherwise(F.array().cast(NODE)))
        return _join(parts, NODE)

    return F.coalesce(F.when(ctx.value.isNotNull(), below(ctx, F.lit(""), F.lit(""), "")), F.array().cast(NODE))


def node_rows(df: DataFrame, model: Node, doc: str = "doc") -> DataFrame:
    """The columns of ``df`` but the document, with its nodes as rows in document order (``pre``)."""
    keep = [c for c in df.columns if c != doc]
    rows = df.select(*keep, nodes(document(model, F.col(doc))).alias("_nodes"))
    return rows.select(*keep, F.posexplode("_nodes").alias("pre", "n")).select(*keep, "pre", "n.*")


# routes: steps of (name, selectors), as the parsers of ``navigation`` give them

Route = list[tuple[str, dict]]


def _matches(n: Node, x: Column, i: Column, keys: dict) -> Column:
    """Whether an entry is the one that selectors pick: ``#`` by place, ``.`` by value, else by leaves."""
    terms = []
    for name, wanted in keys.items():
        if name == "#":
            terms.append(i == wanted)
            continue
        leaf = n if name == "." else n.data_child(name)
        value = ty.parse(F.lit(wanted), leaf.type)
        terms.append(F.coalesce((x if name == "." else x.getField(name)) == value, F.lit(False)))
    return _all(terms)


def _check_selectors(n: Node, keys: dict) -> None:
    if keys and n.kind not in ("list", "leaf-list"):
        raise InvalidKeyValue(f"{n.name} has no entries")
    if "." in keys and n.kind != "leaf-list":
        raise InvalidKeyValue(f"{n.name} has no values to select")


def peek(ctx: Context, route: Route) -> Column:
    """What stands at a route: a value, the array of a whole list, or NULL."""
    own, value = ctx.node, ctx.value
    for name, keys in route:
        if "()" in keys:
            raise NonDataNode(name)
        n = own.data_child(name)
        _check_selectors(n, keys)
        value = value.getField(n.name)
        if keys:
            pick = lambda n, keys: lambda x, i: _matches(n, x, i, keys)
            value = F.get(F.filter(value, pick(n, keys)), F.lit(0))
        own = n
    return value


def references(df: DataFrame, model: Node, schema_path: str, doc: str = "doc") -> DataFrame:
    """(columns of ``df``, path, value, target) of each instance of a leafref; ``target`` is the node's path, NULL if lost.

    The targets of a document are gathered and sorted once, and each reference is looked up by halving.
    """
    own = model.data_node(schema_path)
    chain = model.ancestry(schema_path)
    target = px.resolve(chain, px.target_path(own))
    if len(target) != 1:
        raise NonexistentSchemaNode(f"target of {schema_path}")
    to, at = "", model
    for step in target[0]:
        n = at.data_child(step)
        to, at = f"{to}/{qualified(n, at)}", n
    of, at = "", model
    for n in chain[1:]:
        of, at = f"{of}/{qualified(n, at)}", n
    if px.target_path(own).base != -1:
        raise NotImplementedError(f"{schema_path}: only paths from the root have one set of targets for a document")

    def look(every: Column) -> Column:
        pick = lambda e, sp: F.filter(every, lambda n: n["schema_path"] == sp)
        named = F.filter(pick(every, to), lambda n: n["value"].isNotNull())
        found = F.sort_array(F.transform(named, lambda n: F.struct(n["value"].alias("value"), n["path"].alias("path"))))

        def one(targets: Column, keys: Column) -> Callable[[Column], Column]:
            answer = lambda n: lambda hit: F.struct(n["path"].alias("path"), n["value"].alias("value"), F.when(hit["value"] == n["value"], hit["path"]).alias("target"))
            return lambda n: let(F.get(targets, px.place_in(keys, n["value"])), answer(n))

        each = lambda targets: let(F.transform(targets, lambda t: t["value"]), lambda keys: F.transform(pick(every, of), one(targets, keys)))
        return let(found, each)

    keep = [c for c in df.columns if c != doc]
    rows = df.select(*keep, let(nodes(document(model, F.col(doc))), look).alias("_found"))
    return rows.select(*keep, F.explode("_found").alias("r")).select(*keep, "r.*")


def lost_references(df: DataFrame, model: Node, schema_path: str, targets: DataFrame, target_model: Node, target_path: str) -> DataFrame:
    """Instances of a leaf of one set of documents whose value is at no leaf of another set: (columns of ``df``, path, value).

    Distinct values are looked up, so a value that many documents share is sent once a task; only lost ones come back.
    """
    at = lambda d, m, p: node_rows(d, m).filter(F.col("schema_path") == p)
    given = at(df, model, schema_path)
    have = at(targets, target_model, target_path).select(F.col("value").alias("_value"))
    lost = given.select("value").filter("value IS NOT NULL").distinct().join(have, F.col("value") == F.col("_value"), "left_anti")
    keep = [c for c in df.columns if c != "doc"]
    return given.join(lost, "value", "left_semi").select(*keep, "path", "value")


def lost_identifiers(df: DataFrame, model: Node, schema_path: str, targets: DataFrame, target_model: Node) -> DataFrame:
    """Instance identifiers of documents that lead to no node of others: (columns of ``df``, path, value).

    Paths meet by a hash, and then by themselves.
    """
    have = node_rows(targets, target_model).select(F.xxhash64("path").alias("_h"), F.col("path").alias("_path"))
    given = node_rows(df, model).filter(F.col("schema_path") == schema_path)
    given = given.withColumn("_normal", ty.normal_instance_id(F.col("value"), target_model.ns))
    lost = given.select("_normal").distinct().withColumn("_h", F.xxhash64("_normal"))
    lost = lost.join(have, (lost["_h"] == have["_h"]) & (lost["_normal"] == have["_path"]), "left_anti").select("_normal")
    keep = [c for c in df.columns if c != "doc"]
    return given.join(lost, given["_normal"].eqNullSafe(lost["_normal"]), "left_semi").select(*keep, "path", "value")


def deref_identifiers(df: DataFrame, model: Node, schema_path: str, doc: str = "doc") -> DataFrame:
    """(columns of ``df``, path, value, target_schema_path, target_value) of instance identifiers that lead to a node.

    The nodes of a document are sorted by their paths once, and each identifier is looked up by halving.
    """

    def look(every: Column) -> Column:
        def one(targets: Column, keys: Column) -> Callable[[Column], Column]:
            answer = lambda n: F.struct(n["path"].alias("path"), n["value"].alias("value"), n["hit"]["schema_path"].alias("target_schema_path"), n["hit"]["value"].alias("target_value"))
            there = lambda n: F.when(F.coalesce(n["hit"]["path"] == n["normal"], F.lit(False)), answer(n))
            found = lambda n: lambda normal: let(F.struct(n["path"].alias("path"), n["value"].alias("value"), normal.alias("normal"), F.get(targets, px.place_in(keys, normal)).alias("hit")), there)
            return lambda n: let(ty.normal_instance_id(n["value"], model.ns), found(n))

        given = F.filter(every, lambda n: n["schema_path"] == schema_path)
        each = lambda targets: let(F.transform(targets, lambda t: t["path"]), lambda keys: F.array_compact(F.transform(given, one(targets, keys))))
        return let(F.sort_array(every), each)

    keep = [c for c in df.columns if c != doc]
    rows = df.select(*keep, let(nodes(document(model, F.col(doc))), look).alias("_found"))
    return rows.select(*keep, F.explode("_found").alias("r")).select(*keep, "r.*")


def goto(df: DataFrame, model: Node, route: Route, doc: str = "doc", into: str = "value") -> DataFrame:
    """Rows whose document has the instance, with its value; the others are left out."""
    return df.withColumn(into, peek(document(model, F.col(doc)), route)).filter(F.col(into).isNotNull())


def entry_at(ctx: Context, route: Route, step: int) -> Column:
    """The entry before (-1) or behind (1) the one at a route, in its list."""
    *above, (name, keys) = route
    every = peek(ctx, [*above, (name, {})])
    n = ctx.node
    for own, _ in route:
        n = n.data_child(own)
    place = F.get(F.filter(F.transform(every, lambda x, i: F.when(_matches(n, x, i, keys), i)), lambda i: i.isNotNull()), F.lit(0))
    at = place + step
    return F.when(at >= 0, F.get(every, F.when(at >= 0, at)))


def sibling(ctx: Context, route: Route, name: str) -> Column:
    """Another member of the same parent."""
    return peek(ctx, [*route[:-1], (name, {})])


def update(ctx: Context, route: Route, use: Callable[[Column], Column]) -> Column:
    """The document with ``use(value)`` at a route; where there is no such instance it stays as it is.

    A member that is absent is set, if its parent is there.  Without selectors on a list, the whole list is replaced.
    """

    def rebuild(own: Node, value: Column, steps: Route) -> Column:
        if not steps:
            return use(value)
        (name, keys), *rest = steps
        if "()" in keys:
            raise NonDataNode(name)
        n = own.data_child(name)
        _check_selectors(n, keys)
        old = value.getField(n.name)
        if keys:
            new = F.transform(old, lambda x, i: F.when(_matches(n, x, i, keys), rebuild(n, x, rest)).otherwise(x))
        else:
            if rest and n.kind in ("list", "leaf-list"):
                raise InvalidKeyValue(f"{n.name}: which entry?")
            new = rebuild(n, old, rest)
        return F.when(value.isNotNull(), value.withField(n.name, new))

    return rebuild(ctx.node, ctx.value, route)


def put_member(ctx: Context, route: Route, value: Column) -> Column:
    """The document with a member or entry set to a value."""
    return update(ctx, route, lambda old: value)


def delete_item(ctx: Context, route: Route) -> Column:
    """The document without the member or entry at a route."""
    *above, (name, keys) = route
    if not keys:
        return update(ctx, route, lambda old: F.when(F.lit(False), old))
    n = ctx.node
    for step, _ in route:
        n = n.data_child(step)
    return update(ctx, [*above, (name, {})], lambda old: F.filter(old, lambda x, i: ~_matches(n, x, i, keys)))


def insert_entry(ctx: Context, route: Route, value: Column, after: bool = True) -> Column:
    """The document with an entry put before or behind the one at a route."""
    *above, (name, keys) = route
    n = ctx.node
    for step, _ in route:
        n = n.data_child(step)
    both = lambda x, i: F.when(_matches(n, x, i, keys), F.array(x, value) if after else F.array(value, x)).otherwise(F.array(x))
    return update(ctx, [*above, (name, {})], lambda old: F.flatten(F.transform(old, both)))


def split_route(route: Route, model: Node, at: str) -> tuple[Route, Route]:
    """A route cut behind the node with this data path."""
    node, path = model, ""
    for k, (name, _) in enumerate(route):
        node = node.data_child(name)
        path += f"/{node.name}"
        if path == at:
            return route[: k + 1], route[k + 1 :]
    raise NonexistentSchemaNode(at)


def route_text(route: Route) -> str:
    """The instance identifier of a route; it parses back to the same."""

    def quote(v: str) -> str:
        return f"'{v}'" if "'" not in v else '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"'

    return "".join(f"/{name}" + "".join(f"[{v + 1}]" if k == "#" else f"[{k}={quote(v)}]" for k, v in keys.items()) for name, keys in route)


def route_of_path(path: px.Nodes, model: Node) -> Route:
    """The route of an absolute path of child steps with keys: only its names."""
    found = px.resolve((model,), path)
    if len(found) != 1:
        raise NonexistentSchemaNode(str(path))
    return [(name, {}) for name in found[0]]


# merging


def merge(node: Node, old: Column, new: Column) -> Column:
    """Two values of a container or document, member by member.

    Entries of lists match by keys and merge, the others go to the end in their order; values of a leaf-list that are
    missing go to its end; leaves and anydata of ``new`` win.  Either side may be absent.
    """
    fields = []
    for c in node.data_children():
        a, b = old.getField(c.name), new.getField(c.name)
        if c.kind == "container":
            both = merge(c, a, b)
        elif c.kind == "list" and c.keys:
            both = _merge_list(c, a, b)
        elif c.kind == "leaf-list":
            both = F.concat(a, F.filter(b, bound(lambda x, a: ~F.array_contains(a, x), a)))
        elif c.kind == "list":
            both = F.concat(a, b)
        else:
            both = b
        fields.append(F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both).alias(c.name))
    return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(F.struct(*fields))


def _merge_list(n: Node, a: Column, b: Column) -> Column:
    key = lambda x: F.struct(*[x.getField(k).alias(k) for k in n.keys])
    # of entries with equal keys in b, the first counts
    once = lambda x: let(F.transform(x, key), lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), x).otherwise(F.filter(x, lambda e, i: F.array_position(k, key(e)) == i + 1)))
    by_key = lambda x: F.map_from_entries(F.transform(once(x), lambda e: F.struct(key(e).alias("key"), e.alias("value"))))
    merged = lambda mb: F.transform(a, lambda x: F.when(F.map_contains_key(mb, key(x)), merge(n, x, F.try_element_at(mb, key(x)))).otherwise(x))
    added = let(F.transform(a, key), lambda ka: F.filter(b, lambda y: ~F.array_contains(ka, key(y))))
    return F.concat(let(by_key(b), merged), added)


# hashes, differences and times

HASHED = "array<struct<path:string,schema_path:string,hash:string>>"


def _part(text: Column) -> Column:
    """A text behind its length, so that no two sequences of parts run into the same text."""
    return F.concat(F.length(text).cast("string"), F.lit(":"), text)


def _hash_of(ctx: Context) -> Column:
    """The hash of a node's value: of a leaf's canonical string, of the hashes of members by name or of entries in order."""
    node = ctx.node
    if node.kind in LEAVES:
        return F.sha2(F.concat(F.lit("v"), F.coalesce(ty.canon(ctx.value, node.type), F.lit(""))), 256)
    if node.kind == "anydata":
        return F.sha2(F.concat(F.lit("a"), F.to_json(ctx.value)), 256)
    parts = []
    for n, value in sorted(_members(ctx), key=lambda m: (m[0].ns, m[0].name)):
        own = _hash_of_list(ctx, n, value) if n.kind in ("list", "leaf-list") else _hash_of(ctx.below(n, value))
        parts.append(F.coalesce(F.when(value.isNotNull(), F.concat(_part(F.lit(f"{n.ns}:{n.name}")), own)), F.lit("")))
    return F.sha2(F.concat(F.lit("m"), *parts), 256)


def _hash_of_list(ctx: Context, n: Node, value: Column) -> Column:
    return F.sha2(F.concat(F.lit("l"), F.array_join(F.transform(value, lambda x: _hash_of(ctx.below(n, x))), "")), 256)


def etag(ctx: Context) -> Column:
    """A hash of the value: members in the order of their names, entries in their own order."""
    return F.when(ctx.value.isNotNull(), _hash_of(ctx))


def hash_tree(ctx: Context) -> Column:
    """(path, schema_path, hash) of every node and every whole list of a document, in document order."""

    def below(own: Context, path: Column, schema_path: str) -> Column:
        row = lambda at, sp, h: F.array(F.struct(at.alias("path"), F.lit(sp).alias("schema_path"), h.alias("hash")))
        parts = []
        for n, value in _members(own):
            name = qualified(n, own.node)
            at, sp = F.concat(path, F.lit(f"/{name}")), f"{schema_path}/{name}"

            def one(x: Column, where: Column, n: Node, sp: str) -> Column:
                inside = own.below(n, x)
                rows = row(where, sp, _hash_of(inside))
                return F.concat(rows, below(inside, where, sp)) if n.kind in ("container", "list") else rows

            if n.kind in ("list", "leaf-list"):
                entry = lambda n, at, sp: lambda x, i: one(x, F.concat(at, selector(n, x, i)), n, sp)  # noqa: B023, E731
                entries = F.flatten(F.transform(value, entry(n, at, sp)))
                parts.append(F.coalesce(F.concat(row(at, sp, _hash_of_list(own, n, value)), entries), F.array().cast(HASHED)))
            else:
                parts.append(F.when(value.isNotNull(), one(value, at, n, sp)).otherwise(F.array().cast(HASHED)))
        return _join(parts, HASHED)

    return F.coalesce(F.when(ctx.value.isNotNull(), below(ctx, F.lit(""), "")), F.array().cast(HASHED))


CHANGE = "array<struct<path:string,schema_path:string,change:string,old:string,new:string>>"


def differences(node: Node, old: Column, new: Column) -> Column:
    """What changed between two versions of a document: (path, schema_path, change, old, new) of each node.

    Subtrees with equal hashes are skipped.  ``change`` is ``added``, ``removed`` (with all below), ``changed`` (leaves, with
    their canonical values) or ``moved`` (a list with the same entries in another order).  Entries meet by their keys or
    values; entries of lists without keys by their place.
    """
    none = F.array().cast(CHANGE)
    row = lambda at, sp, change, a=None, b=None: F.array(F.struct(at.alias("path"), F.lit(sp).alias("schema_path"), F.lit(change).alias("change"), (F.lit(None).cast("string") if a is None else a).alias("old"), (F.lit(None).cast("string") if b is None else b).alias("new")))

    def members(n: Node, a: Column, b: Column, path: Column, schema_path: str) -> Column:
        parts = []
        for c in n.data_children():
            name = qualified(c, n)
            at, sp = F.concat(path, F.lit(f"/{name}")), f"{schema_path}/{name}"
            x, y = a.getField(c.name), b.getField(c.name)
            parts.append(entries(c, x, y, at, sp) if c.kind in ("list", "leaf-list") else single(c, x, y, at, sp))
        return _join(parts, CHANGE)

    def show(c: Node, x: Column) -> Column:
        return ty.canon(x, c.type) if c.kind in LEAVES else F.lit(None).cast("string")

    def single(c: Node, x: Column, y: Column, at: Column, sp: str) -> Column:
        if c.kind == "container":
            below = members(c, x, y, at, sp)
        else:
            below = row(at, sp, "changed", show(c, x), show(c, y))
        same = _hash_of(document(c, x)) == _hash_of(document(c, y))
        both = F.when(same, none).otherwise(below)
        return F.when(x.isNull() & y.isNull(), none).when(x.isNull(), row(at, sp, "added", None, show(c, y))).when(y.isNull(), row(at, sp, "removed", show(c, x))).otherwise(both)

    def entries(c: Node, x: Column, y: Column, at: Column, sp: str) -> Column:
        # (name of the entry, its hash, its place), by name; of entries with equal names the first counts
        sign = lambda e, i: F.struct(selector(c, e, i).alias("name"), i.alias("i"), _hash_of(document(c, e)).alias("hash"))
        signs = lambda every: F.transform(F.coalesce(every, F.array().cast(c.data_type())), sign)

        def compare(s: Column) -> Column:
            p, q = s["x"], s["y"]
            pn, qn = (F.transform(F.array_sort(z), lambda e: e["name"]) for z in (p, q))

            def found(names: Column) -> Column:
                mine, other, others = names["p"], names["q"], names["sorted_y"]

                def of_old(e: Column) -> Column:
                    k = px.place_in(other, e["name"])
                    twin = F.get(others, k)
                    here = F.concat(at, e["name"])
                    a, b = F.get(x, e["i"]), F.get(y, twin["i"])
                    if c.kind == "list":
                        inner = members(c, a, b, here, sp)
                    else:
                        inner = none
                    gone = row(here, sp, "removed", show(c, a) if c.kind == "leaf-list" else None)
                    return F.when(F.coalesce(twin["name"] == e["name"], F.lit(False)), F.when(twin["hash"] == e["hash"], none).otherwise(inner)).otherwise(gone)

                def of_new(e: Column) -> Column:
                    fresh = row(F.concat(at, e["name"]), sp, "added", None, show(c, F.get(y, e["i"])) if c.kind == "leaf-list" else None)
                    return F.when(px.is_among(mine, e["name"]), none).otherwise(fresh)

                both = lambda z, names: F.transform(F.filter(z, lambda e: px.is_among(names, e["name"])), lambda e: e["name"])
                moved = F.when(both(p, other) != both(q, mine), row(at, sp, "moved")).otherwise(none)
                return F.concat(moved, F.flatten(F.transform(p, of_old)), F.flatten(F.transform(q, of_new)))

            return let(F.struct(pn.alias("p"), qn.alias("q"), F.array_sort(q).alias("sorted_y")), found)

        same = x.eqNullSafe(y) if c.kind == "leaf-list" and c.type.base != "binary" else F.lit(False)
        return F.when(same | (x.isNull() & y.isNull()), none).otherwise(let(F.struct(signs(x).alias("x"), signs(y).alias("y")), compare))

    whole = F.when(_hash_of(document(node, old)) == _hash_of(document(node, new)), none).otherwise(members(node, old, new, F.lit(""), ""))
    return F.when(old.isNull() & new.isNull(), none).when(old.isNull(), row(F.lit("/"), "", "added")).when(new.isNull(), row(F.lit("/"), "", "removed")).otherwise(whole)


def changed_at(ctx: Context, before: Column, stamp: Column, now: Column) -> Column:
    """The time of the last change of a document: ``now`` where its hash differs from that of ``before``."""
    other = etag(document(ctx.node, before))
    return F.when(etag(ctx).eqNullSafe(other), stamp).otherwise(now)


TIMED = "array<struct<path:string,hash:string,changed_at:timestamp>>"


def node_times(ctx: Context, before: Column, now: Column) -> Column:
    """(path, hash, changed_at) of every node: its time before where its hash is the same, else ``now``.

    ``before`` is what this gave for the last version (NULL for the first).  As a hash covers all below, a node's time is
    the greatest of those below it, or of what was removed there.
    """
    old = F.array_sort(F.coalesce(before, F.array().cast(TIMED)))

    def timed(known: Column) -> Column:
        names = F.transform(known, lambda e: e["path"])

        def one(n: Column) -> Column:
            last = F.get(known, px.place_in(names, n["path"]))
            same = F.coalesce((last["path"] == n["path"]) & (last["hash"] == n["hash"]), F.lit(False))
            return F.struct(n["path"].alias("path"), n["hash"].alias("hash"), F.when(same, last["changed_at"]).otherwise(now).alias("changed_at"))

        return F.transform(hash_tree(ctx), one)

    return let(old, timed)

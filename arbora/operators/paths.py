"""Path expressions over nested documents, built in Python and compiled to Columns.

A document is a struct of the model's shape; all of an expression is one Column of that row, so nothing is shuffled.  An
expression is built from ``here`` (the context node), ``root()`` and ``current()`` by steps, predicates, operators and
functions, and compiled against a context::

    late = root().child("orders").where(here.child("status") == "F").child("lines")
    df.select(count(late).column(document(model, F.col("doc"))))

A node-set is held as one array for each schema node it may contain (a branch).  An entry holds its place in document
order (``at``) and the values of its ancestors and itself (``v0``, ``v1``, ...), so every axis is a projection of it.
Ancestors that all entries share are no part of them but columns of the branch (``fixed``): the document at least.
Predicates look at the merged set of a step by default, and at the nodes of each context node with ``each``.

Conversions and comparisons are those of XPath 1.0: no function gives NULL, containers and list entries have no string
value and are skipped in comparisons, NaN equals nothing.

Children include what is in use by default: absent leaves and leaf-lists with a default, and absent containers without
presence that have such leaves, where their ``when`` holds and their case is there (or is the default of a choice without
any).  The steps of an expression decide at compile time which defaults it can reach; only these are filled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from contextvars import ContextVar
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from arbora.functions import types as ty
from arbora.functions import xpath as xp
from arbora.operators.editing import default_of
from arbora.plans.model import Node, NonexistentSchemaNode

NAN = float("nan")


class XPathTypeError(TypeError):
    """An argument of the wrong kind."""


class NotSupported(NotImplementedError):
    """An axis, node test or function that is not offered."""


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def bound(f: Callable, *args) -> Callable[[Column], Column]:
    """``f`` with all but its first argument given: Spark passes an index to functions of two parameters."""
    return lambda e: f(e, *args)


@dataclass(frozen=True)
class Context:
    """A node: its schema nodes and values from the root on, and its place; within predicates also position and size."""

    nodes: tuple[Node, ...]
    values: tuple[Column, ...]
    at: Column
    position: Column | None = None
    size: Column | None = None
    origin: Context | None = None
    sure: bool = False  # the node is there, whatever its value
    known: tuple[tuple[str, Column], ...] = ()  # what was gathered from the document before, by name

    @property
    def node(self) -> Node:
        return self.nodes[-1]

    @property
    def value(self) -> Column:
        return self.values[-1]

    def below(self, child: Node, value: Column, at: Column | None = None) -> Context:
        return Context((*self.nodes, child), (*self.values, value), self.at if at is None else at, known=self.known)

    def find_known(self, name: str) -> Column | None:
        return dict(self.known).get(name)

    def as_struct(self, start: int = 0) -> Column:
        """The place and the values from a level on."""
        return F.struct(self.at.alias("at"), *[v.alias(f"v{i}") for i, v in enumerate(self.values) if i >= start])


def document(model: Node, value: Column) -> Context:
    """The root of a document whose struct is ``value``."""
    return Context((model,), (value,), F.array().cast("array<int>"))


@dataclass(frozen=True)
class Branch:
    """Nodes of one schema node, as an array of structs; or at most one node, known as a context (absent where NULL)."""

    nodes: tuple[Node, ...]
    array: Column | None = None
    one: Context | None = None
    fixed: tuple[Column, ...] = ()

    @property
    def shared(self) -> tuple[Column, ...]:
        """Values of the ancestors that are no part of the entries."""
        return self.one.values[:-1] if self.one is not None else self.fixed

    def value_at(self, e: Column, level: int) -> Column:
        return self.shared[level] if level < len(self.shared) else e[f"v{level}"]

    @property
    def column(self) -> Column:
        if self.array is not None:
            return self.array
        last = len(self.nodes) - 1
        return F.filter(F.array(self.one.as_struct(last)), lambda e: e[f"v{last}"].isNotNull())

    def rooted(self) -> Column:
        """The entries with all values but the document, which may leave the scope of what this branch's columns name."""
        n = len(self.nodes)
        full = lambda e: F.struct(e["at"].alias("at"), *[self.value_at(e, i).alias(f"v{i}") for i in range(1, n)])
        if len(self.shared) == 1:
            return self.column
        return F.transform(self.column, full)

    @property
    def size(self) -> Column:
        return F.size(self.array) if self.one is None else self.one.value.isNotNull().cast("int")

    def single(self, outer: Context) -> Context:
        """The only node, with the origin of the whole expression."""
        return replace(self.one, origin=outer.origin or outer)

    def context(self, e: Column, outer: Context, position: Column | None = None, size: Column | None = None) -> Context:
        values = tuple(self.value_at(e, i) for i in range(len(self.nodes)))
        return Context(self.nodes, values, e["at"], position, size, outer.origin or outer, known=outer.known)

    def each(self, use: Callable[[Node, Column], Column]) -> Callable[[Column], Column]:
        """``use(schema node, value)`` of an entry."""
        return lambda e: use(self.nodes[-1], self.value_at(e, len(self.nodes) - 1))

    def placed(self, use: Callable[[Node, Column], Column]) -> Callable[[Column], Column]:
        """The same with the entry's place before it, as a struct."""
        return lambda e: F.struct(e["at"].alias("at"), self.each(use)(e).alias("x"))


def _flat(column: Column, inner: Callable[[Column], Column]) -> Column:
    return F.flatten(F.filter(F.transform(column, inner), lambda a: a.isNotNull()))


def _in_order(column: Column) -> Column:
    """Each node once, in document order."""
    return let(F.array_sort(column), lambda s: F.filter(s, lambda e, i: (i == 0) | (e["at"] != F.get(s, i - 1)["at"])))


def _named(nodes: tuple[Node, ...]) -> tuple[str, ...]:
    return tuple(n.name for n in nodes)


def leaf_default(node: Node):
    """The default of a leaf, or that of its type; a mandatory leaf has none."""
    if node.mandatory or node.min_elements:
        return None
    if node.default is not None:
        return node.default
    if node.type.default is not None:
        return [node.type.default] if node.kind == "leaf-list" else node.type.default
    return None


def has_defaults(node: Node) -> bool:
    """Whether a data node is, or as a container without presence holds, a leaf with a default."""
    if node.kind in ("leaf", "leaf-list"):
        return leaf_default(node) is not None
    return node.kind == "container" and not node.presence and any(has_defaults(c) for c in node.data_children())


def _cases_above(parent: Node, child: Node) -> list[tuple[Node, Node]]:
    """(choice, case) pairs between a data node and its data child, outermost first."""
    for c in parent.children:
        if c is child:
            return []
        if c.kind in ("choice", "case"):
            for k in c.children if c.kind == "choice" else (c,):
                if any(x is child for x in k.data_children()):
                    return [(c, k), *_cases_above(k, child)] if c.kind == "choice" else _cases_above(k, child)
    return []


#: Schema nodes whose ``when`` is being compiled: it sees their value without a default.
_deciding: ContextVar[tuple[int, ...]] = ContextVar("arbora_deciding", default=())


def in_use(ctx: Context, child: Node) -> Column:
    """The value of a child, or its default where that is in use."""
    from arbora.operators import trees

    value = ctx.value.getField(child.name)
    if id(child) in _deciding.get() or not has_defaults(child):
        return value
    if child.kind == "container":
        kind = child.data_type()
        given = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields])
    else:
        given = default_of(replace(child, default=leaf_default(child)))
    before = _deciding.set((*_deciding.get(), id(child)))
    try:
        terms, guards = [ctx.value.isNotNull()], []
        for choice, case in _cases_above(ctx.node, child):
            here = {c.name: trees._present(ctx, c) for c in choice.children}
            own = here[case.name]
            terms.append(own | ~reduce(lambda a, b: a | b, here.values()) if case.name == choice.default else own)
            guards += [w for w in (choice.when, case.when) if w is not None]
        terms.append(trees._active(ctx, child, given, guards))
    finally:
        _deciding.reset(before)
    missing = value.isNull() | (F.size(value) == 0) if child.kind == "leaf-list" else value.isNull()
    return F.when(missing & reduce(lambda a, b: a & b, terms), given).otherwise(value)


def _children(branch: Branch, test: str | None, outer: Context) -> list[Branch]:
    """The child axis: entries of lists and leaf-lists one by one."""
    if branch.nodes[-1].kind in ("leaf", "leaf-list", "anydata"):
        return []
    out = []
    for number, child in enumerate(branch.nodes[-1].data_children()):
        if test not in (None, "*", child.name, f"{child.ns}:{child.name}"):
            continue

        if branch.one is not None and child.kind not in ("list", "leaf-list"):
            own = branch.one
            out.append(Branch((*branch.nodes, child), one=Context((*own.nodes, child), (*own.values, in_use(own, child)), F.concat(own.at, F.array(F.lit(number), F.lit(0))), known=own.known)))
            continue

        if branch.one is not None:
            # entries of a list in a node that is known: what they share are its values
            own = branch.one
            place = lambda i, number: F.concat(own.at, F.array(F.lit(number), i.cast("int")))
            made = lambda number, level: lambda x, i: F.struct(place(i, number).alias("at"), x.alias(f"v{level}"))
            value = F.when(own.value.isNotNull(), in_use(own, child))
            entries = F.transform(value, made(number, len(branch.nodes)))
            out.append(Branch((*branch.nodes, child), F.coalesce(entries, F.slice(F.array(F.struct(own.at.alias("at"), F.lit(None).cast(entry_type(child)).alias(f"v{len(branch.nodes)}"))), 1, 0)), fixed=own.values))
            continue
        start = len(branch.fixed)

        def inner(e: Column, number: int, child: Node) -> Column:
            ctx = branch.context(e, outer)
            value = in_use(ctx, child)
            made = lambda x, i: ctx.below(child, x, F.concat(ctx.at, F.array(F.lit(number), i.cast("int")))).as_struct(start)
            if child.kind in ("list", "leaf-list"):
                return F.transform(value, made)
            return F.filter(F.array(made(value, F.lit(0))), lambda k: k[f"v{len(branch.nodes)}"].isNotNull())

        out.append(Branch((*branch.nodes, child), _flat(branch.column, bound(inner, number, child)), fixed=branch.fixed))
    return out


def entry_type(node: Node):
    """The Spark type of an entry of a list or leaf-list, or of another node's value."""
    kind = node.data_type()
    return kind.elementType if node.kind in ("list", "leaf-list") else kind


def _descendants(branch: Branch, outer: Context) -> list[Branch]:
    kids = _children(branch, "*", outer)
    return [b for k in kids for b in (k, *_descendants(k, outer))]


def _ancestor(branch: Branch, levels: int, known: tuple = ()) -> Branch:
    keep = len(branch.nodes) - levels
    if branch.one is not None:
        own = branch.one
        there = [F.when(own.value.isNotNull(), v) for v in own.values[:keep]] if not own.sure else own.values[:keep]
        return Branch(branch.nodes[:keep], one=Context(own.nodes[:keep], tuple(there), F.slice(own.at, 1, 2 * (keep - 1)), sure=own.sure, known=own.known))
    if keep <= len(branch.fixed):
        # all share it, so it is one node, if there are any below
        first = F.get(branch.array, F.lit(0))
        there = [F.when(first.isNotNull(), v) for v in branch.fixed[:keep]]
        return Branch(branch.nodes[:keep], one=Context(branch.nodes[:keep], tuple(there), F.slice(first["at"], 1, 2 * (keep - 1)), known=known))
    up = lambda e: F.struct(F.slice(e["at"], 1, 2 * (keep - 1)).alias("at"), *[e[f"v{i}"].alias(f"v{i}") for i in range(len(branch.fixed), keep)])
    return Branch(branch.nodes[:keep], _in_order(F.transform(branch.column, up)), fixed=branch.fixed)


def _siblings(branch: Branch, after: bool) -> list[Branch]:
    """Entries of the same list or leaf-list; the nearest first before the node."""
    if branch.nodes[-1].kind not in ("list", "leaf-list"):
        return []
    k = len(branch.nodes) - 1

    def inner(e: Column) -> Column:
        i = F.element_at(e["at"], -1)
        every = branch.value_at(e, k - 1).getField(branch.nodes[-1].name)
        part = F.slice(every, i + 2, F.size(every)) if after else F.slice(every, F.lit(1), i)
        first = i + 1 if after else F.lit(0)
        place = lambda j: F.concat(F.slice(e["at"], F.lit(1), F.size(e["at"]) - 1), F.array((first + j).cast("int")))
        own = F.transform(part, lambda x, j: F.struct(place(j).alias("at"), *[e[f"v{n}"].alias(f"v{n}") for n in range(len(branch.shared), k)], x.alias(f"v{k}")))
        return own if after else F.reverse(own)

    return [Branch(branch.nodes, _flat(branch.column, inner), fixed=branch.shared)]


def _merged(branches: list[Branch], root_value: Column) -> list[Branch]:
    """One branch for each schema node, each node once."""
    by: dict[tuple[str, ...], list[Branch]] = {}
    for b in branches:
        by.setdefault(_named(b.nodes), []).append(b)
    return [own[0] if len(own) == 1 else Branch(own[0].nodes, _in_order(F.concat(*[b.rooted() for b in own])), fixed=(root_value,)) for own in by.values()]


#: Where steps are compiled to find what an expression reads: how many of them end at each schema path (names from the root).
_reached: ContextVar[Counter | None] = ContextVar("arbora_reached", default=None)


def reads(ancestors: tuple[Node, ...], expression: Expr) -> set[tuple[str, ...]]:
    """The schema paths that an expression at a schema node (given with its ancestors) looks at, defaults' conditions included."""
    found: Counter[tuple[str, ...]] = Counter()
    before = _reached.set(found)
    try:
        expression.boolean(_probe(ancestors))
    finally:
        _reached.reset(before)
    return {path for path, n in found.items() if path and n > 0}


AXES = ("self", "child", "parent", "descendant", "descendant-or-self", "ancestor", "ancestor-or-self", "preceding-sibling", "following-sibling")


def _step(branches: list[Branch], axis: str, test: str | None, outer: Context) -> list[Branch]:
    if axis not in AXES:
        raise NotSupported(f"axis {axis}")
    out: list[Branch] = []
    for b in branches:
        up = [_ancestor(b, n, outer.known) for n in range(1, len(b.nodes))]
        found = {
            "self": lambda b=b: [b],
            "child": lambda b=b: _children(b, test, outer),
            "parent": lambda up=up: up[:1],
            "descendant": lambda b=b: _descendants(b, outer),
            "descendant-or-self": lambda b=b: [b, *_descendants(b, outer)],
            "ancestor": lambda up=up: up,
            "ancestor-or-self": lambda b=b, up=up: [b, *up],
            "preceding-sibling": lambda b=b: _siblings(b, False),
            "following-sibling": lambda b=b: _siblings(b, True),
        }[axis]()
        # a name or * does not match the document itself, but where it stands among its descendants; node() matches all
        out += [x for x in found if test is None or (test == "*" and (len(x.nodes) > 1 or axis == "descendant-or-self")) or test in (x.nodes[-1].name, f"{x.nodes[-1].ns}:{x.nodes[-1].name}")]
    merged = _merged(out, outer.values[0])
    if (seen := _reached.get()) is not None:
        # a container on the way is read as far as the path goes on only
        seen.subtract(_named(b.nodes)[1:] for b in branches if b.one is not None and b.nodes[-1].kind == "container")
        seen.update(_named(b.nodes)[1:] for b in merged)
    return [Branch(b.nodes, _in_order(b.column), fixed=b.shared) if axis.endswith("-sibling") else b for b in merged]


# expressions


class Expr:
    """An expression; ``kind`` is nodes, number, string or boolean.  Comparison and arithmetic make expressions."""

    kind = "string"
    text = ""
    rank = 9  # how tightly the text binds: 1 or, 2 and, 3 = !=, 4 < >, 5 + -, 6 * div mod, 7 unary -, 8 |, 9 all else

    def shown(self, rank: int) -> str:
        """The text as an operand, in parentheses where it binds less than ``rank``."""
        return self.text if self.rank >= rank else f"({self.text})"

    def make(self, ctx: Context) -> Column:
        raise NotImplementedError

    def boolean(self, ctx: Context) -> Column:
        x = self.make(ctx)
        return {"number": xp.boolean_of_number, "string": xp.boolean_of_string, "boolean": lambda b: F.coalesce(b, F.lit(False))}[self.kind](x)

    def number(self, ctx: Context) -> Column:
        x = self.make(ctx)
        return {"number": lambda n: n.cast("double"), "string": xp.number_of_string, "boolean": xp.number_of_boolean}[self.kind](x)

    def string(self, ctx: Context) -> Column:
        x = self.make(ctx)
        return {"number": xp.string_of_number, "string": lambda s: F.coalesce(s, F.lit("")), "boolean": xp.string_of_boolean}[self.kind](x)

    def column(self, ctx: Context) -> Column:
        """The value at a context: a boolean, a double or a string; a node-set is an array of its nodes' strings."""
        return self.make(ctx)

    def __str__(self) -> str:
        return self.text

    def __eq__(self, other):
        return _compare(self, "=", other)

    def __ne__(self, other):
        return _compare(self, "!=", other)

    def __lt__(self, other):
        return _compare(self, "<", other)

    def __le__(self, other):
        return _compare(self, "<=", other)

    def __gt__(self, other):
        return _compare(self, ">", other)

    def __ge__(self, other):
        return _compare(self, ">=", other)

    __hash__ = object.__hash__

    def __add__(self, other):
        return _arithmetic(self, "+", other)

    def __sub__(self, other):
        return _arithmetic(self, "-", other)

    def __mul__(self, other):
        return _arithmetic(self, "*", other)

    def __truediv__(self, other):
        return _arithmetic(self, "div", other)

    def __mod__(self, other):
        return _arithmetic(self, "mod", other)

    def __neg__(self):
        return Made("number", lambda ctx: -self.number(ctx), f"-{self.shown(7)}", 7)

    def __and__(self, other):
        b = expr(other)
        return Made("boolean", lambda ctx: self.boolean(ctx) & b.boolean(ctx), f"{self.shown(2)} and {b.shown(3)}", 2)

    def __or__(self, other):
        b = expr(other)
        return Made("boolean", lambda ctx: self.boolean(ctx) | b.boolean(ctx), f"{self.shown(1)} or {b.shown(2)}", 1)

    def __invert__(self):
        return Made("boolean", lambda ctx: ~self.boolean(ctx), f"not({self})")


class Made(Expr):
    """A value computed from the context."""

    def __init__(self, kind: str, make: Callable[[Context], Column], text: str, rank: int = 9):
        self.kind, self._make, self.text, self.rank = kind, make, text, rank

    def make(self, ctx: Context) -> Column:
        return self._make(ctx)


def quote(text: str) -> str:
    """A literal; one with both kinds of quotes is put together, as literals have no escapes."""
    if '"' not in text:
        return f'"{text}"'
    if "'" not in text:
        return f"'{text}'"
    return "concat(" + ", '\"', ".join(f'"{part}"' for part in text.split('"')) + ")"


def expr(x) -> Expr:
    """An expression of a Python value."""
    if isinstance(x, Expr):
        return x
    if isinstance(x, bool):
        return Made("boolean", lambda ctx: F.lit(x), f"{str(x).lower()}()")
    if isinstance(x, (int, float)):
        return Made("number", lambda ctx: F.lit(float(x)), str(float(x)))
    if isinstance(x, str):
        return Made("string", lambda ctx: F.lit(x), quote(x))
    raise XPathTypeError(f"no expression: {x!r}")


def string_value(node: Node, value: Column) -> Column | None:
    """The canonical string of a leaf's value; None for nodes that have none."""
    if node.kind in ("leaf", "leaf-list"):
        return ty.canon(value, node.type)
    return None


def number_value(node: Node, value: Column) -> Column:
    base = node.type.base if node.type else ""
    if base in ty.BOUNDS or base == "decimal64":
        return value.cast("double")
    if base == "boolean":
        return value.cast("int").cast("double")
    text = string_value(node, value)
    return xp.number_of_string(text) if text is not None else F.lit(NAN)


class Nodes(Expr):
    """A node-set."""

    kind = "nodes"

    def __init__(self, find: Callable[[Context], list[Branch]], text: str, rank: int = 9, base: int | None = None):
        """``base``: the levels above the context node at which the path begins to go down, -1 for the root; None if unknown."""
        self.find, self.text, self.rank, self.base = find, text, rank, base

    def _free(self, conditions: list[Expr]) -> bool:
        """Whether predicates leave the set the same for all context nodes with the same base."""
        return not any("current()" in str(c) for c in conditions)

    # steps

    def step(self, axis: str, test: str | None = None, *predicates, each: bool = False) -> Nodes:
        """Nodes of an axis that pass the test: a name, ``*`` for any, None for ``node()``."""
        conditions = [expr(p) for p in predicates]
        shown = {("child", test): test or "node()", ("parent", None): "..", ("self", None): "."}.get((axis, test), f"{axis}::{test or 'node()'}")
        text = "".join([shown if self.text == "." else f"{self.shown(9).rstrip('/')}/{shown}", *[f"[{p}]" for p in conditions]])
        base = self.base if self._free(conditions) and axis in ("child", "descendant", "self") else None
        if axis == "parent" and test is None and not conditions and self.base is not None and set(self.text) <= {".", "/"} and self.base >= 0:
            base = self.base + 1

        def find(ctx: Context) -> list[Branch]:
            found = self.find(ctx)
            if not each:
                return _filtered(_step(found, axis, test, ctx), conditions, ctx)
            out = []
            for b in found:
                if b.one is not None:
                    out += _filtered(_step([b], axis, test, ctx), conditions, ctx)
                    continue
                probe = _step([Branch(b.nodes, one=b.context(F.get(b.column, F.lit(0)), ctx))], axis, test, ctx)
                for k, one in enumerate(probe):

                    def own(e: Column, b: Branch, k: int) -> Column:
                        single = _step([Branch(b.nodes, one=b.context(e, ctx))], axis, test, ctx)
                        return _filtered(single, conditions, ctx)[k].rooted()

                    out.append(Branch(one.nodes, _flat(b.column, bound(own, b, k)), fixed=(ctx.values[0],)))
            return _merged(out, ctx.values[0])

        return Nodes(find, text, 9, base)

    def child(self, name: str | None = "*", *predicates, each: bool = False) -> Nodes:
        return self.step("child", name, *predicates, each=each)

    def parent(self, name: str | None = None) -> Nodes:
        return self.step("parent", name)

    def descendant(self, name: str | None = "*", *predicates) -> Nodes:
        return self.step("descendant", name, *predicates)

    def ancestor(self, name: str | None = None, *predicates) -> Nodes:
        return self.step("ancestor", name, *predicates)

    def where(self, *predicates) -> Nodes:
        """The nodes of the whole set that satisfy every predicate; a number is a position."""
        conditions = [expr(p) for p in predicates]
        base = self.base if self._free(conditions) else None
        return Nodes(lambda ctx: _filtered(self.find(ctx), conditions, ctx), self.shown(9) + "".join(f"[{p}]" for p in conditions), 9, base)

    def __or__(self, other):
        if isinstance(other, Nodes):
            return Nodes(lambda ctx: _merged([*self.find(ctx), *other.find(ctx)], ctx.values[0]), f"{self.shown(8)} | {other.shown(9)}", 8)
        return super().__or__(other)

    def then(self, path: Nodes) -> Nodes:
        """The nodes that ``path`` finds from each of these: a path behind a filter expression."""

        def find(ctx: Context) -> list[Branch]:
            out = []
            for b in self.find(ctx):
                if b.one is not None:
                    out += path.find(b.single(ctx))
                    continue
                probe = path.find(b.context(F.get(b.column, F.lit(0)), ctx))
                for k, one in enumerate(probe):
                    each = bound(lambda e, b, k: path.find(b.context(e, ctx))[k].rooted(), b, k)
                    out.append(Branch(one.nodes, _in_order(_flat(b.column, each)), fixed=(ctx.values[0],)))
            return _merged(out, ctx.values[0])

        return Nodes(find, f"({self})/{path}")

    # values

    def strings(self, ctx: Context) -> Column:
        parts = [F.transform(b.column, b.each(string_value)) for b in self.find(ctx) if b.nodes[-1].type]
        return F.concat(*parts) if parts else F.array().cast("array<string>")

    def numbers(self, ctx: Context) -> Column:
        """Numbers of the nodes that have one."""
        return F.filter(self.all_numbers(ctx), lambda n: ~F.isnan(n))

    def all_numbers(self, ctx: Context) -> Column:
        """The number of each leaf, NaN for those that have none."""
        parts = [F.transform(b.column, b.each(number_value)) for b in self.find(ctx) if b.nodes[-1].type]
        return F.concat(*parts) if parts else F.array().cast("array<double>")

    def only(self, ctx: Context) -> Context | None:
        """The node, where the set can hold only one."""
        found = self.find(ctx)
        return found[0].single(ctx) if len(found) == 1 and found[0].one is not None else None

    def _first(self, ctx: Context, value: Callable[[Node, Column], Column], blank: Column) -> Column:
        if one := self.only(ctx):
            return F.coalesce(value(one.node, one.value), blank)
        parts = [F.transform(b.column, b.placed(lambda n, v: F.coalesce(value(n, v), blank))) for b in self.find(ctx)]
        return F.coalesce(F.array_min(F.concat(*parts))["x"], blank) if parts else blank

    def make(self, ctx: Context) -> Column:
        return self.strings(ctx)

    def boolean(self, ctx: Context) -> Column:
        return reduce(lambda a, b: a | b, [b.size > 0 for b in self.find(ctx)], F.lit(False))

    def number(self, ctx: Context) -> Column:
        return self._first(ctx, number_value, F.lit(NAN))

    def string(self, ctx: Context) -> Column:
        return self._first(ctx, lambda n, v: string_value(n, v) if n.type else F.lit(""), F.lit(""))

    def names(self, ctx: Context, qualified: bool) -> Column:
        parts = [F.transform(b.column, b.placed(_constant(_instance_name(b.nodes, qualified)))) for b in self.find(ctx)]
        return F.coalesce(F.array_min(F.concat(*parts))["x"], F.lit("")) if parts else F.lit("")


def _constant(text: str) -> Callable[[Node, Column], Column]:
    return lambda n, v: F.lit(text)


def _instance_name(nodes: tuple[Node, ...], qualified: bool) -> str:
    if len(nodes) == 1:
        return ""
    own = nodes[-1]
    return f"{own.ns}:{own.name}" if qualified and own.ns and own.ns != nodes[-2].ns else own.name


def _keep(b: Branch, cond: Expr, outer: Context, before: Column, total: Column) -> Callable[[Column, Column], Column]:
    def keep(e: Column, i: Column) -> Column:
        ctx = b.context(e, outer, (before + i + 1).cast("double"), total.cast("double"))
        return ctx.position == cond.number(ctx) if cond.kind == "number" else cond.boolean(ctx)

    return keep


def _filtered(branches: list[Branch], conditions: list[Expr], outer: Context) -> list[Branch]:
    for cond in conditions:
        sizes = [b.size for b in branches]
        total = reduce(lambda a, b: a + b, sizes, F.lit(0))
        before, out = F.lit(0), []
        for b, n in zip(branches, sizes, strict=True):

            out.append(Branch(b.nodes, F.filter(b.column, _keep(b, cond, outer, before, total)), fixed=b.shared))
            before = before + n
        branches = out
    return branches


def _numbers_compare(op: str, a: Column, b: Column) -> Column:
    sound = ~F.isnan(a) & ~F.isnan(b)
    if op == "!=":
        return ~sound | (a != b)
    return sound & {"=": a == b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


_TURNED = {"=": "=", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


def _compare(left, op: str, right) -> Expr:
    a, b = expr(left), expr(right)

    def make(ctx: Context) -> Column:
        if b.kind == "nodes" and a.kind != "nodes":
            return _nodes_compare(b, _TURNED[op], a, ctx)
        if a.kind == "nodes":
            return _nodes_compare(a, op, b, ctx)
        if op in ("=", "!=") and "boolean" in (a.kind, b.kind):
            same = a.boolean(ctx) == b.boolean(ctx)
            return same if op == "=" else ~same
        if op in ("=", "!=") and "number" not in (a.kind, b.kind):
            same = a.string(ctx) == b.string(ctx)
            return same if op == "=" else ~same
        return _numbers_compare(op, a.number(ctx), b.number(ctx))

    rank = 3 if op in ("=", "!=") else 4
    return Made("boolean", make, f"{a.shown(rank)} {op} {b.shown(rank + 1)}", rank)


def _nodes_compare(a: Nodes, op: str, b: Expr, ctx: Context) -> Column:
    """Whether some node, or some pair of nodes, satisfies the comparison."""
    one, other = a.only(ctx), b.only(ctx) if b.kind == "nodes" else None
    if one and one.node.type and b.kind != "boolean" and (b.kind != "nodes" or (other and other.node.type)):
        there = one.value.isNotNull() if other is None else one.value.isNotNull() & other.value.isNotNull()
        if op in ("=", "!=") and b.kind != "number":
            same = string_value(one.node, one.value) == b.string(ctx)
            return F.coalesce(there & (same if op == "=" else ~same), F.lit(False))
        x, y = number_value(one.node, one.value), b.number(ctx)
        return F.coalesce(there & _numbers_compare(op, x, y), F.lit(False))
    if b.kind == "boolean":
        return _numbers_compare(op, xp.number_of_boolean(a.boolean(ctx)), b.number(ctx))
    if b.kind == "nodes":
        if op in ("=", "!="):
            return (xp.sets_equal if op == "=" else xp.sets_unequal)(a.strings(ctx), b.strings(ctx))
        x, y = a.numbers(ctx), b.numbers(ctx)
        low, high = (F.array_min(x), F.array_max(y)) if op[0] == "<" else (F.array_min(y), F.array_max(x))
        return F.coalesce(low <= high if op.endswith("=") else low < high, F.lit(False))
    if b.kind == "string" and op in ("=", "!="):
        value = b.string(ctx)
        return xp.any_equal(a.strings(ctx), value) if op == "=" else xp.any_unequal(a.strings(ctx), value)
    return F.exists(a.all_numbers(ctx), lambda n: _numbers_compare(op, n, b.number(ctx)))


def _arithmetic(left, op: str, right) -> Expr:
    a, b = expr(left), expr(right)
    use = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "div": xp.divide, "mod": xp.modulo}[op]
    rank = 5 if op in ("+", "-") else 6
    return Made("number", lambda ctx: use(a.number(ctx), b.number(ctx)), f"{a.shown(rank)} {op} {b.shown(rank + 1)}", rank)


def _single(ctx: Context) -> list[Branch]:
    return [Branch(ctx.nodes, one=replace(ctx, sure=True))]


#: The context node.
here = Nodes(_single, ".", 9, 0)


def root() -> Nodes:
    return Nodes(lambda ctx: [Branch(ctx.nodes[:1], one=replace(document(ctx.nodes[0], ctx.values[0]), sure=True, known=ctx.known))], "/", 9, -1)


def current() -> Nodes:
    """The node that the whole expression began at."""
    return Nodes(lambda ctx: _single(ctx.origin or ctx), "current()")


def position() -> Expr:
    return Made("number", lambda ctx: F.lit(1.0) if ctx.position is None else ctx.position, "position()")


def last() -> Expr:
    return Made("number", lambda ctx: F.lit(1.0) if ctx.size is None else ctx.size, "last()")


def true() -> Expr:
    return expr(True)


def false() -> Expr:
    return expr(False)


def _nodes(x, name: str) -> Nodes:
    if not isinstance(x, Nodes):
        raise XPathTypeError(f"{name}() takes a node-set")
    return x


def count(nodes: Nodes) -> Expr:
    own = _nodes(nodes, "count")
    return Made("number", lambda ctx: reduce(lambda a, b: a + b, [b.size for b in own.find(ctx)], F.lit(0)).cast("double"), f"count({own})")


def sum_(nodes: Nodes) -> Expr:
    """The sum of the nodes' numbers; NaN where one has none."""
    own = _nodes(nodes, "sum")

    def make(ctx: Context) -> Column:
        parts = [F.aggregate(F.transform(b.column, b.each(number_value)), F.lit(0.0), lambda acc, n: acc + n) for b in own.find(ctx)]
        return reduce(lambda a, b: a + b, parts, F.lit(0.0))

    return Made("number", make, f"sum({own})")


def string(x=here) -> Expr:
    a = expr(x)
    return Made("string", a.string, f"string({a})")


def number(x=here) -> Expr:
    a = expr(x)
    return Made("number", a.number, f"number({a})")


def boolean(x) -> Expr:
    a = expr(x)
    return Made("boolean", a.boolean, f"boolean({a})")


def not_(x) -> Expr:
    return ~expr(x)


def _strings(name: str, use: Callable[..., Column], kind: str, *args) -> Expr:
    own = [expr(a) for a in args]
    return Made(kind, lambda ctx: use(*[a.string(ctx) for a in own]), f"{name}({', '.join(map(str, own))})")


def concat(*parts) -> Expr:
    if len(parts) < 2:
        raise XPathTypeError("concat() takes two arguments at least")
    return _strings("concat", xp.concat, "string", *parts)


def contains(s, part) -> Expr:
    return _strings("contains", xp.contains, "boolean", s, part)


def starts_with(s, part) -> Expr:
    return _strings("starts-with", xp.starts_with, "boolean", s, part)


def substring_before(s, part) -> Expr:
    return _strings("substring-before", xp.substring_before, "string", s, part)


def substring_after(s, part) -> Expr:
    return _strings("substring-after", xp.substring_after, "string", s, part)


def string_length(s=here) -> Expr:
    return _strings("string-length", xp.string_length, "number", s)


def normalize_space(s=here) -> Expr:
    return _strings("normalize-space", xp.normalize_space, "string", s)


def translate(s, source: str, target: str) -> Expr:
    a = expr(s)
    return Made("string", lambda ctx: xp.translate(a.string(ctx), source, target), f"translate({a}, {quote(source)}, {quote(target)})")


def re_match(s, pattern: str) -> Expr:
    a = expr(s)
    return Made("boolean", lambda ctx: xp.re_match(a.string(ctx), pattern), f"re-match({a}, {quote(pattern)})")


def substring(s, start, length=None) -> Expr:
    a, b, c = expr(s), expr(start), None if length is None else expr(length)
    text = f"substring({a}, {b}{'' if c is None else f', {c}'})"
    return Made("string", lambda ctx: xp.substring(a.string(ctx), b.number(ctx), None if c is None else c.number(ctx)), text)


def _rounded(name: str, use: Callable[[Column], Column], x) -> Expr:
    a = expr(x)
    return Made("number", lambda ctx: use(a.number(ctx)), f"{name}({a})")


def floor(x) -> Expr:
    return _rounded("floor", xp.floor, x)


def ceiling(x) -> Expr:
    return _rounded("ceiling", xp.ceiling, x)


def round_(x) -> Expr:
    return _rounded("round", xp.round_, x)


def name(nodes: Nodes = here) -> Expr:
    """The instance name of the first node, with its module where that differs from the parent's; '' for the document."""
    return Made("string", lambda ctx: nodes.names(ctx, True), f"name({nodes})")


def local_name(nodes: Nodes = here) -> Expr:
    return Made("string", lambda ctx: nodes.names(ctx, False), f"local-name({nodes})")


def _on_leaves(nodes: Nodes, base: str, ctx: Context, use: Callable[[Node, Column], Column], blank) -> list[Column]:
    fits = lambda n: n.type and n.type.base == base
    return [F.transform(b.column, b.placed(lambda n, v: use(n, v) if fits(n) else F.lit(blank))) for b in nodes.find(ctx)]


def bit_is_set(nodes: Nodes, bit: str) -> Expr:
    """Of the first node."""

    def make(ctx: Context) -> Column:
        parts = _on_leaves(nodes, "bits", ctx, lambda n, v: xp.bit_is_set(v, bit), False)
        return F.coalesce(F.array_min(F.concat(*parts))["x"], F.lit(False)) if parts else F.lit(False)

    return Made("boolean", make, f"bit-is-set({nodes}, {quote(bit)})")


def enum_value(nodes: Nodes = here) -> Expr:
    """Of the first node; NaN where it is no enumeration."""

    def make(ctx: Context) -> Column:
        parts = _on_leaves(nodes, "enumeration", ctx, lambda n, v: xp.enum_value(v, dict(n.type.enums)), NAN)
        return F.coalesce(F.array_min(F.concat(*parts))["x"], F.lit(NAN)) if parts else F.lit(NAN)

    return Made("number", make, f"enum-value({nodes})")


def derived_from(nodes: Nodes, base: str, closure: dict[str, set[str]], or_self: bool = False) -> Expr:
    """Whether some node is an identity derived from ``base``."""

    def make(ctx: Context) -> Column:
        parts = _on_leaves(nodes, "identityref", ctx, lambda n, v: xp.derived_from(v, base, closure, or_self), False)
        return F.exists(F.concat(*parts), lambda e: e["x"]) if parts else F.lit(False)

    return Made("boolean", make, f"derived-from{'-or-self' if or_self else ''}({nodes}, {quote(base)})")


def target_path(node: Node) -> Nodes | None:
    """Where a leafref points to: its own path, or a leaf of a top-level list."""
    if node.path is not None:
        return node.path
    return root().child(node.leafref[0]).child(node.leafref[1]) if node.leafref else None


def place_in(keys: Column, key: Column, behind: bool = False) -> Column:
    """How many of the sorted ``keys`` are less than ``key`` (or not greater, with ``behind``), by halving."""
    start = F.struct(F.lit(0).alias("lo"), F.size(keys).alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.shiftright(acc["lo"] + acc["hi"], 1)
        at = F.get(keys, middle)
        up = (acc["lo"] < acc["hi"]) & ((at <= key) if behind else (at < key))
        return F.struct(F.when(up, middle + 1).otherwise(acc["lo"]).alias("lo"), F.when(up | (acc["lo"] >= acc["hi"]), acc["hi"]).otherwise(middle).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.length(F.bin(F.size(keys).cast("long")))), start, halve)["lo"]


def is_among(keys: Column, key: Column) -> Column:
    """Whether sorted ``keys`` hold a key."""
    return F.coalesce(F.get(keys, place_in(keys, key)) == key, F.lit(False))


def reference_name(nodes: tuple[Node, ...]) -> str:
    """What the targets of a leafref (given with its ancestors) are called among the things known of a document."""
    return "/".join(_named(nodes))


def leafrefs_based_at(ctx: Context) -> list[Context]:
    """Contexts of leafrefs below whose path goes down from this node, with nothing known of the levels between."""
    out = []

    def visit(own: Context) -> None:
        for c in own.node.data_children():
            kind = c.data_type() if c.kind not in ("list", "leaf-list") else c.data_type().elementType
            below = own.below(c, F.lit(None).cast(kind))
            if c.kind in ("leaf", "leaf-list"):
                path = target_path(c)
                base = None if path is None or path.base is None else 1 if path.base < 0 else len(below.nodes) - path.base
                if base == len(ctx.nodes):
                    out.append(below)
            elif c.kind != "anydata":
                visit(below)

    visit(ctx)
    return out


def _by_key(a: Column, b: Column) -> Column:
    """The order of targets: by their strings, then by their places."""
    less = (a["key"] < b["key"]) | ((a["key"] == b["key"]) & (a["at"] < b["at"]))
    return F.when(less, -1).when((a["key"] == b["key"]) & (a["at"] == b["at"]), 0).otherwise(1)


def with_targets(ctx: Context, use: Callable[[Context], Column], entries: bool = False, wanted: Callable[[Context], bool] | None = None) -> Column:
    """``use`` of the context, which knows the targets of the leafrefs that go down from it, gathered once.

    They are the sorted distinct strings of the targets, or with ``entries`` the targets themselves, sorted by theirs.
    """
    fields = []
    for ref in leafrefs_based_at(ctx):
        path, name = target_path(ref.node), reference_name(ref.nodes)
        if wanted is not None and not wanted(ref):
            continue
        if not entries:
            fields.append((name, F.array_sort(F.array_distinct(path.strings(ref)))))
            continue
        found = path.find(ref)
        if len(found) == 1:
            whole = Branch(found[0].nodes, found[0].rooted(), fixed=ctx.values[:1])
            own = bound(lambda e, b: F.struct(b.each(string_value)(e).alias("key"), e["at"].alias("at"), e.alias("entry")), whole)
            fields.append((f"->{name}", F.array_sort(F.transform(found[0].rooted(), own), _by_key)))
    if not fields:
        return use(ctx)
    gathered = F.struct(*[c.alias(f"t{i}") for i, (_, c) in enumerate(fields)])
    return let(gathered, lambda t: use(replace(ctx, known=(*ctx.known, *[(name, t[f"t{i}"]) for i, (name, _) in enumerate(fields)]))))


def _targets_known(b: Branch, value: Column, ctx: Context) -> list[Branch] | None:
    """The targets of a leafref with this value, from what was gathered; None where nothing was."""
    gathered = ctx.find_known(f"->{reference_name(b.nodes)}")
    if gathered is None:
        return None
    root_node = b.nodes[0]
    target = (root_node,)
    for step in resolve(b.nodes, target_path(b.nodes[-1]))[0]:
        target = (*target, target[-1].data_child(step))
    keys = F.transform(gathered, lambda e: e["key"])
    text = string_value(b.nodes[-1], value)
    first = place_in(keys, text)
    own = F.slice(gathered, first + 1, place_in(keys, text, True) - first)
    return [Branch(target, F.when(text.isNotNull(), F.transform(own, lambda e: e["entry"])).otherwise(F.slice(F.transform(gathered, lambda e: e["entry"]), 1, 0)), fixed=(ctx.values[0],))]


def deref(nodes: Nodes = here) -> Nodes:
    """The nodes that the first of the set refers to: targets of a leafref with the same canonical string.

    Where the targets were gathered before (``with_targets``) they are looked up, else all are compared.
    """

    def find(ctx: Context) -> list[Branch]:
        out = []
        for b in nodes.find(ctx):
            own = target_path(b.nodes[-1])
            if own is None:
                continue
            if b.one is not None:
                if (known := _targets_known(b, b.one.value, replace(b.one, known=ctx.known))) is not None:
                    out += known
                    continue
                out += own.where(here == string(current())).find(replace(b.one, origin=None))
                continue
            first = F.slice(b.column, 1, 1)
            if ctx.find_known(f"->{reference_name(b.nodes)}") is not None:
                target = _targets_known(b, b.value_at(F.get(first, F.lit(0)), len(b.nodes) - 1), ctx)
                out += target
                continue
            same = lambda e, b, own: own.where(here == string(current())).find(replace(b.context(e, ctx), origin=None))
            for k, one in enumerate(same(F.get(first, F.lit(0)), b, own)):
                out.append(Branch(one.nodes, _in_order(_flat(first, bound(lambda e, b, own, k: same(e, b, own)[k].rooted(), b, own, k))), fixed=(ctx.values[0],)))
        return _merged(out, ctx.values[0])

    return Nodes(find, f"deref({nodes})")


def _probe(nodes: tuple[Node, ...]) -> Context:
    """A context at a schema node without any data."""
    return Context(nodes, tuple(F.lit(None).cast(entry_type(n)) for n in nodes), F.array().cast("array<int>"))


def resolve(node: tuple[Node, ...], path: Nodes) -> list[tuple[str, ...]]:
    """The schema paths that a path can reach from a schema node (given with its ancestors), without any data."""
    return [_named(b.nodes)[1:] for b in path.find(_probe(node))]


def leafref_target(ancestors: tuple[Node, ...]) -> Node:
    """The leaf that a leafref (given with its ancestors from the model on) points to, by the schema alone."""
    path = target_path(ancestors[-1])
    found = resolve(ancestors, path) if path is not None else []
    if len(found) != 1:
        raise NonexistentSchemaNode(f"target of {ancestors[-1].name}")
    node = ancestors[0]
    for step in found[0]:
        node = node.data_child(step)
    return node


def _unsupported(function: str) -> Callable:
    def refuse(*args):
        raise NotSupported(f"{function}()")

    return refuse


#: Functions of XPath that documents of a data model have no use for.
id_, lang, namespace_uri = map(_unsupported, ("id", "lang", "namespace-uri"))

"""Data models: schema nodes as plain Python values, and what is derived from them.

Models are declared in Python (or loaded from JSON with ``Node.from_dict``); there is no parser for a schema language.
``when`` and ``must`` are Spark SQL conditions over the columns of a top-level entry, or expressions of
``arbora.operators.paths``, which also work in nested documents.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from decimal import Decimal, InvalidOperation

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.functions.types import BOUNDS, Type

CONFIG, NONCONFIG, ALL = 1, 2, 3
DATA = {"container", "list", "leaf", "leaf-list", "anydata", "anyxml"}


class ModelError(ValueError):
    """A model that is wrong in itself."""


class NonexistentSchemaNode(ModelError):
    pass


class BadSchemaNodeType(ModelError):
    pass


class FeaturePrerequisiteError(ModelError):
    pass


class CyclicImports(ModelError):
    pass


@dataclass(frozen=True)
class Must:
    condition: str
    tag: str = "must-violation"
    message: str | None = None


@dataclass(frozen=True)
class Node:
    name: str
    kind: str
    children: tuple[Node, ...] = ()
    type: Type | None = None
    ns: str = ""
    keys: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    mandatory: bool = False
    presence: bool = False
    default: object = None
    when: str | None = None
    must: tuple[Must, ...] = ()
    config: bool = True
    min_elements: int = 0
    max_elements: int | None = None
    user_ordered: bool = False
    status: str = "current"
    units: str | None = None
    description: str | None = None
    leafref: tuple[str, str] | None = None  # (list, leaf) it refers to
    require_instance: bool = True
    features: tuple = field(default=())
    path: object = None  # a path expression that a leafref follows, from the leaf
    deny: str | None = None  # "write" or "all": default access

    def __hash__(self) -> int:
        return hash((self.name, self.kind, self.ns))

    # navigation

    def child(self, name: str) -> Node:
        for c in self.children:
            if c.name == name:
                return c
        raise NonexistentSchemaNode(f"{name} in {self.name}")

    def data_children(self, content: int = ALL) -> Iterator[Node]:
        """Data nodes below, through choices and cases; status, content type and kind decide."""
        for c in self.children:
            if c.kind in ("choice", "case"):
                yield from c.data_children(content)
            elif c.kind in DATA and c.status != "obsolete" and c.content() & content:
                yield c

    def data_child(self, name: str) -> Node:
        for c in self.data_children():
            if name in (c.name, f"{c.ns}:{c.name}"):
                return c
        raise NonexistentSchemaNode(f"{name} in {self.name}")

    def content(self) -> int:
        if not self.config:
            return NONCONFIG
        return ALL if self.kind in ("container", "list") else CONFIG

    def descendant(self, path: str) -> Node:
        """A node by its schema path, choices and cases included."""
        node = self
        for step in filter(None, path.split("/")):
            node = node.child(step.rpartition(":")[2])
        return node

    def is_internal(self) -> bool:
        return self.kind not in ("leaf", "leaf-list", "anydata", "anyxml")

    def data_parent(self, path: str) -> Node:
        """The node above that at a data path, itself for a top-level one."""
        return self.data_node(path.strip("/").rpartition("/")[0])

    def ancestry(self, path: str) -> tuple[Node, ...]:
        """The nodes along a data path, this one first."""
        out = [self]
        for step in filter(None, path.split("/")):
            out.append(out[-1].data_child(step))
        return tuple(out)

    def schema_route(self, path: str) -> list[tuple[str, str]]:
        """(module, name) of the nodes along a schema path, choices and cases included."""
        node, out = self, []
        for step in filter(None, path.split("/")):
            node = node.child(step.rpartition(":")[2])
            out.append((node.ns, node.name))
        return out

    def operations(self) -> list[Node]:
        return [c for c in self.children if c.kind in ("rpc", "action", "notification")]

    def data_node(self, path: str) -> Node:
        node = self
        for step in filter(None, path.split("/")):
            node = node.data_child(step)
        return node

    def walk(self, path: str = "", ns: str = "") -> Iterator[tuple[str, Node]]:
        """(data path, node) in order; a name carries its module where that changes."""
        for c in self.data_children():
            own = f"{path}/{c.ns}:{c.name}" if c.ns != ns else f"{path}/{c.name}"
            yield own, c
            yield from c.walk(own, c.ns)

    def state_roots(self) -> list[str]:
        """Paths where state data begins."""
        out: list[str] = []
        for path, node in self.walk():
            if not node.config and not any(path.startswith(r + "/") for r in out):
                out.append(path)
        return out

    def is_mandatory(self, content: int = ALL) -> bool:
        """Whether a parent needs this node: deprecated nodes never are, containers through their children."""
        if self.status != "current":
            return False
        if self.kind == "container":
            return not self.presence and any(c.is_mandatory(content) for c in self.children if c.content() & content)
        if self.kind in ("list", "leaf-list"):
            return self.min_elements > 0
        return self.mandatory

    # what changes a model

    def augment(self, path: str, *nodes: Node, when: str | None = None) -> Node:
        """New children at ``path``; a missing target changes nothing."""
        guard = lambda n: replace(n, when=n.when and when and f"({n.when}) AND ({when})" or n.when or when)
        return self._change(path, lambda n: replace(n, children=n.children + tuple(map(guard, nodes))))

    def refine(self, path: str, **changes) -> Node:
        return self._change(path, lambda n: replace(n, **changes))

    def deviate(self, path: str, kind: str, **changes) -> Node:
        """``not-supported`` removes the node; add, replace and delete change attributes.

        Attributes that hold several values (``must``, ``unique``) grow by ``add`` and lose what ``delete`` names; one
        value can only be added where there is none, and only be deleted where it is the one there.
        """
        if kind == "not-supported":
            return self._change(path, lambda n: None)
        node = self.descendant(path)
        for k, v in list(changes.items()):
            old = getattr(node, k)
            if isinstance(old, tuple) and kind == "add":
                changes[k] = old + tuple(v)
            elif isinstance(old, tuple) and kind == "delete":
                changes[k] = tuple(x for x in old if x not in tuple(v))
            elif kind == "add" and old not in (None, False, 0):
                raise ModelError(f"{path} already has {k}")
            elif kind == "delete":
                if old != v:
                    raise ModelError(f"{path} has no such {k}")
                changes[k] = getattr(Node(node.name, node.kind), k)
        return self._change(path, lambda n: replace(n, **changes))

    def _change(self, path: str, use: Callable[[Node], Node | None]) -> Node:
        steps = [s.rpartition(":")[2] for s in path.split("/") if s]
        if not steps:
            return use(self) or self
        out = []
        for c in self.children:
            if c.name == steps[0]:
                c = c._change("/".join(steps[1:]), use) if len(steps) > 1 else use(c)
            if c is not None:
                out.append(c)
        return replace(self, children=tuple(out))

    def with_features(self, supported: set[str]) -> Node:
        """The model without nodes whose features are not all supported."""
        keep = tuple(c.with_features(supported) for c in self.children if all(feature_holds(f, supported) for f in c.features))
        return replace(self, children=keep)

    # what is derived

    def struct_type(self) -> T.StructType:
        """Decoded entries as a Spark struct; lists are arrays of structs."""
        return T.StructType([T.StructField(c.name, c.data_type()) for c in self.data_children()])

    def data_type(self) -> T.DataType:
        if self.kind == "leaf":
            return T.DataType.fromDDL(self.type.sql())
        if self.kind == "leaf-list":
            return T.ArrayType(T.DataType.fromDDL(self.type.sql()))
        if self.kind == "list":
            return T.ArrayType(self.struct_type())
        return self.struct_type() if self.kind == "container" else T.VariantType()

    def ascii_tree(self) -> str:
        """An indented tree: flags rw, ro, x, n; marks ?, !, * and keys; types of leaves."""
        lines: list[str] = []

        def show(node: Node, pad: str) -> None:
            kids = sorted(node.children, key=lambda c: (c.ns, c.name))
            for i, c in enumerate(kids):
                mark = {"list": "*", "leaf-list": "*"}.get(c.kind, "!" if c.presence else "" if c.is_mandatory() or c.kind == "container" else "?")
                name = {"choice": f"({c.name})", "case": f":({c.name})"}.get(c.kind, c.name)
                flag = {"rpc": "-x", "action": "-x", "notification": "-n", "choice": "", "case": ""}.get(c.kind, "rw" if c.config else "ro")
                status = {"current": "+", "deprecated": "x", "obsolete": "o"}[c.status]
                keys = f" [{' '.join(c.keys)}]" if c.keys else ""
                kind = f" <{c.type.base}>" if c.type else ""
                lines.append(f"{pad}{status}--{flag}{' ' if flag else ''}{name}{mark if c.kind != 'case' else ''}{keys}{kind}")
                show(c, pad + ("|  " if i + 1 < len(kids) else "   "))

        show(self, "")
        return "\n".join(lines)

    def digest(self) -> dict:
        """What a client needs of a node, as JSON values."""
        out: dict = {"kind": self.kind}
        if self.type:
            out["type"] = self.type.digest()
        for key, value in (("mandatory", self.mandatory), ("presence", self.presence), ("default", self.default), ("units", self.units), ("keys", list(self.keys)), ("description", self.description)):
            if value:
                out[key] = value
        if not self.config:
            out["config"] = False
        if self.children:
            out["children"] = {f"{c.ns}:{c.name}" if c.ns else c.name: c.digest() for c in self.children}
        return out

    def catalog(self, spark: SparkSession) -> DataFrame:
        """One row per data node of the model."""
        rows = [(p, n.name, n.ns, n.kind, n.type.base if n.type else None, n.is_mandatory(), n.config, json.dumps(n.default, default=str) if n.default is not None else None) for p, n in self.walk()]
        return spark.createDataFrame(rows, "path string, name string, ns string, kind string, type string, mandatory boolean, config boolean, default_value string")

    @classmethod
    def from_dict(cls, raw: dict) -> Node:
        """A model from JSON values, as written by ``to_dict``."""
        own = dict(raw)
        own["children"] = tuple(cls.from_dict(c) for c in own.get("children", ()))
        if own.get("type"):
            own["type"] = _type_of(own["type"])
        own["must"] = tuple(Must(**m) for m in own.get("must", ()))
        for key in ("keys", "features"):
            own[key] = tuple(own.get(key, ()))
        own["unique"] = tuple(map(tuple, own.get("unique", ())))
        if own.get("leafref"):
            own["leafref"] = tuple(own["leafref"])
        return cls(**own)

    def to_dict(self) -> dict:
        blank = Node(self.name, self.kind)
        if self.path is not None or any(not isinstance(c, (str, type(None))) for c in (self.when, *[m.condition for m in self.must])):
            raise ModelError(f"{self.name}: path expressions have no JSON form")
        out = {k: v for k, v in self.__dict__.items() if k in ("name", "kind") or v != getattr(blank, k)}
        if self.children:
            out["children"] = [c.to_dict() for c in self.children]
        if self.type:
            out["type"] = {k: v for k, v in self.type.__dict__.items() if k == "base" or v != getattr(Type(self.type.base), k)}
        if self.must:
            out["must"] = [m.__dict__ for m in self.must]
        return json.loads(json.dumps(out, default=lambda o: o.__dict__))


def _type_of(raw: dict) -> Type:
    tuples = {"ranges", "enums", "bits"}
    own = {k: tuple(map(tuple, v)) if k in tuples else tuple(map(_type_of, v)) if k == "members" else tuple(v) if isinstance(v, list) else v for k, v in raw.items()}
    return Type(**own)


def feature_holds(condition, supported: set[str]) -> bool:
    """A feature's name, or ``("not", x)``, ``("and", x, ...)``, ``("or", x, ...)`` of such conditions."""
    if isinstance(condition, str):
        return condition in supported
    op, *args = condition
    values = [feature_holds(a, supported) for a in args]
    if op == "not" and len(values) == 1:
        return not values[0]
    if op in ("and", "or") and values:
        return all(values) if op == "and" else any(values)
    raise ModelError(f"no feature condition: {condition}")


def fits(kind: Type, value) -> bool:
    """Whether a default, as a model gives it, is a value of a type: its kind, bounds, ranges, labels and lengths."""
    if kind.base == "union":
        return any(fits(m, value) for m in kind.members)
    if kind.base in BOUNDS or kind.base == "decimal64":
        try:
            number = Decimal(str(value))
        except InvalidOperation:
            return False
        if isinstance(value, bool) or (kind.base in BOUNDS and number != int(number)):
            return False
        limits = (BOUNDS[kind.base],) if kind.base in BOUNDS else ()
        return all(any((a is None or number >= a) and (b is None or number <= b) for a, b in ranges) for ranges in (limits, kind.ranges) if ranges)
    if kind.base == "boolean":
        return isinstance(value, bool) or value in ("true", "false")
    if kind.base == "enumeration":
        return value in {k for k, _ in kind.enums}
    if kind.base == "identityref":
        return value in kind.identities
    if kind.base == "bits":
        given = value.split() if isinstance(value, str) else list(value)
        return set(given) <= {k for k, _ in kind.bits} and len(set(given)) == len(given)
    if kind.base == "string":
        return isinstance(value, str) and (not kind.ranges or any((a or 0) <= len(value) and (b is None or len(value) <= b) for a, b in kind.ranges))
    return True


def check_model(root: Node) -> Node:
    """The model if it is sound: keys are leaves of their list, defaults fit their types, references lead to one leaf."""
    from arbora.operators import paths

    def visit(node: Node, above: tuple[Node, ...]) -> None:
        for k in node.keys:
            if node.data_child(k).kind != "leaf":
                raise ModelError(f"key {k} of {node.name}")
        for leaves in node.unique:
            for leaf_path in leaves:
                if node.data_node(leaf_path).kind not in ("leaf", "leaf-list"):
                    raise ModelError(f"unique {leaf_path} of {node.name}")
        if node.kind == "choice" and node.default is not None:
            node.child(node.default)
        if node.kind in ("leaf", "leaf-list") and (node.path is not None or node.leafref):
            paths.leafref_target((*above, node))
        if node.kind in ("leaf", "leaf-list") and node.default is not None:
            for value in node.default if node.kind == "leaf-list" and not isinstance(node.default, str) else (node.default,):
                if not fits(node.type, value):
                    raise ModelError(f"default {value!r} of {node.name}")
        if node.kind == "leaf" and node.mandatory and node.default is not None:
            raise ModelError(f"{node.name} is mandatory and has a default")
        for c in node.children:
            visit(c, above if node.kind in ("choice", "case") else (*above, node))

    visit(root, ())
    return root


def uses(grouping: tuple[Node, ...], when=None, refine: dict[str, dict] | None = None, augment: dict[str, tuple[Node, ...]] | None = None) -> tuple[Node, ...]:
    """A copy of a grouping's nodes for one place: refined, augmented and under a condition of their own."""
    box = Node("", "container", tuple(grouping))
    for path, changes in (refine or {}).items():
        box.descendant(path)
        box = box.refine(path, **changes)
    for path, nodes in (augment or {}).items():
        box = box.augment(path, *nodes)
    if when is None:
        return box.children
    return tuple(Node(c.name, "choice", (Node(c.name, "case", (c,), when=when),)) for c in box.children)


def operation(name: str, *parts: Node, kind: str = "rpc", **more) -> Node:
    """An rpc or action: ``input`` and ``output`` are made where they are not given."""
    have = {p.name for p in parts}
    return Node(name, kind, tuple(parts) + tuple(Node(p, p) for p in ("input", "output") if p not in have), **more)


def notification(name: str, *children: Node, **more) -> Node:
    return Node(name, "notification", children, **more)


def denied(node: Node, access: str = "write", path: str = "") -> list[str]:
    """Paths of nodes that are closed to writing, or to all access, by default."""
    out = []
    for c in node.children:
        own = f"{path}/{c.name}"
        if c.deny and (access == "write" or c.deny == "all"):
            out.append(own)
        out += denied(c, access, own)
    return out


def latest_revisions(modules: DataFrame) -> DataFrame:
    """The latest revision of each module: (name, revision); a missing one is older than any."""
    return modules.groupBy("name").agg(F.max("revision").alias("revision"))


def check_features(supported: set[str], needs: dict[str, set[str]]) -> None:
    for feature in sorted(supported):
        if missing := needs.get(feature, set()) - supported:
            raise FeaturePrerequisiteError(f"{feature} needs {sorted(missing)}")


def module_order(imports: dict[str, set[str]]) -> list[str]:
    """Modules after those they import."""
    from graphlib import CycleError, TopologicalSorter

    try:
        return list(TopologicalSorter(imports).static_order())
    except CycleError as e:
        raise CyclicImports(str(e.args[1])) from e


def container(name: str, *children: Node, **more) -> Node:
    return Node(name, "container", children, **more)


def list_(name: str, keys: str, *children: Node, **more) -> Node:
    return Node(name, "list", children, keys=tuple(keys.split()), **more)


def leaf(name: str, type: Type, **more) -> Node:
    return Node(name, "leaf", type=type, **more)


def leaf_list(name: str, type: Type, **more) -> Node:
    return Node(name, "leaf-list", type=type, **more)


def choice(name: str, *cases: Node, **more) -> Node:
    """Data nodes among ``cases`` become cases of their own."""
    return Node(name, "choice", tuple(c if c.kind == "case" else Node(c.name, "case", (c,)) for c in cases), **more)


def case(name: str, *children: Node, **more) -> Node:
    return Node(name, "case", children, **more)


def module_set_id(modules: DataFrame) -> DataFrame:
    """The id of a module set: SHA-1 over the sorted ``name@revision`` of (name, revision)."""
    names = F.array_sort(F.collect_list(F.concat(F.col("name"), F.lit("@"), F.coalesce("revision", F.lit("")))))
    return modules.agg(F.sha1(F.array_join(names, "").cast("binary")).alias("module_set_id"))

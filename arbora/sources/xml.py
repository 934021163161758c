"""XML documents by namespace: an incremental parser over Arrow batches, and large files split at row elements.

``parse`` reads a text with expat, which keeps character data as they are (blanks, CDATA, entities), and resolves prefixes
by the declarations in scope: those of elements, and those inside values of identities and instance identifiers, which
become module names.  An element belongs to a schema node by namespace and local name; nodes of a model without modules
take elements of their parent's namespace.

Errors are listed: elements that the model lacks or that come twice (``raw-member``), text where elements are due and
elements inside leaves (``raw-type``), texts that are no XML (``raw-xml``; the document is then NULL).  A NULL stays NULL.
"""

from __future__ import annotations

import json
import re
from dataclasses import replace
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.functions import types as ty
from arbora.plans.model import Node

SEPARATOR = "\x1f"
LEAVES = ("leaf", "leaf-list")
ERRORS = "array<struct<instance_path:string,error_class:string,error_tag:string>>"
_STEP = re.compile(r"""(?P<quoted>'[^']*'|"(?:[^"\\]|\\.)*")|(?P<prefix>[A-Za-z_][\w.-]*):(?=[A-Za-z_])""")


class _Reader:
    """Builds the value of one document: dicts for containers and entries, lists, strings for leaves."""

    def __init__(self, model: Node, urns: dict[str, str]):
        self.model, self.urns = model, urns
        self.modules = {uri: name for name, uri in urns.items()}
        self.errors: list[tuple[str, str]] = []
        self.value: dict = {}
        self.scopes: dict[str, list[str]] = {}
        # (schema node or None for what is skipped, value, namespace, path)
        self.stack: list[tuple[Node | None, object, str, str]] = []

    def parse(self, text: str) -> dict:
        p = expat.ParserCreate(namespace_separator=SEPARATOR)
        p.buffer_text = True
        p.StartNamespaceDeclHandler = lambda prefix, uri: self.scopes.setdefault(prefix or "", []).append(uri or "")
        p.EndNamespaceDeclHandler = lambda prefix: self.scopes[prefix or ""].pop()
        p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = self.start, self.end, self.text
        p.EntityDeclHandler = self.refuse
        p.Parse(text, True)
        return self.value

    def refuse(self, *args) -> None:
        raise ValueError("entities of its own")

    def start(self, name: str, attributes: dict) -> None:
        uri, _, local = name.rpartition(SEPARATOR)
        if not self.stack:
            self.stack.append((self.model, self.value, uri, ""))
            return
        above, value, space, path = self.stack[-1]
        own = self.child(above, local, uri, space) if above is not None and above.kind not in LEAVES else None
        at = f"{path}/{local}"
        if own is None:
            if above is not None:
                self.errors.append((at, "raw-type" if above.kind in LEAVES else "raw-member"))
            self.stack.append((None, None, uri, at))
            return
        if own.kind in ("list", "leaf-list"):
            at = f"{at}/{len(value.get(own.name, []))}"
        elif own.name in value:
            self.errors.append((at, "raw-member"))
        self.stack.append((own, [] if own.kind in LEAVES else {}, uri, at))

    def child(self, above: Node, local: str, uri: str, space: str) -> Node | None:
        for c in above.data_children():
            if c.name == local and c.kind != "anydata" and uri == (self.urns.get(c.ns, c.ns) if c.ns else space):
                return c
        return None

    def text(self, data: str) -> None:
        node, value, _, path = self.stack[-1]
        if node is None:
            return
        if node.kind in LEAVES:
            value.append(data)
        elif data.strip(" \t\r\n"):
            self.errors.append((path or "/", "raw-type"))

    def end(self, name: str) -> None:
        node, value, _, _ = self.stack.pop()
        if node is None or not self.stack:
            return
        if node.kind in LEAVES:
            value = self.resolved(node.type, "".join(value))
        owner = self.stack[-1][1]
        if node.kind in ("list", "leaf-list"):
            owner.setdefault(node.name, []).append(value)
        else:
            owner[node.name] = value

    def module(self, prefix: str) -> str | None:
        scope = self.scopes.get(prefix)
        return self.modules.get(scope[-1]) if scope else None

    def resolved(self, kind: ty.Type, text: str) -> str:
        """A value whose prefixes are those in scope, with names of modules instead."""
        if kind.base == "identityref":
            prefix, _, name = text.strip(" \t\r\n").rpartition(":")
            module = self.module(prefix)
            full = f"{module}:{name}" if module else text
            return full if full in kind.identities or name not in kind.identities or not module else name
        if kind.base == "instance-identifier":
            return _STEP.sub(lambda m: m[0] if m["quoted"] else f"{self.module(m['prefix']) or m['prefix']}:", text)
        if kind.base == "union":
            for m in kind.members:
                if m.base == "identityref" and self.resolved(m, text) in m.identities:
                    return self.resolved(m, text)
        return text


def _raw(n: Node) -> str:
    """The schema of documents whose leaves are strings."""
    one = lambda c: "string" if c.kind in LEAVES else f"struct<{_raw(c)}>"
    kind = lambda c: f"array<{one(c)}>" if c.kind in ("list", "leaf-list") else one(c)
    return ", ".join(f"`{c.name}`: {kind(c)}" for c in n.data_children() if c.kind != "anydata") or "`_`: string"


def _typed(own: Column, n: Node) -> Column:
    def value(c: Node) -> Column:
        if c.kind == "anydata":
            return F.lit(None).cast("variant")
        x = own.getField(c.name)
        one = (lambda v: ty.parse(v, c.type)) if c.kind in LEAVES else (lambda v: _typed(v, c))
        return F.transform(x, one) if c.kind in ("list", "leaf-list") else one(x) if c.kind == "leaf" else F.when(x.isNotNull(), one(x))

    return F.struct(*[value(c).alias(c.name) for c in n.data_children()])


def _without_conditions(n: Node) -> Node:
    """What tasks need of a model: names and types."""
    return replace(n, when=None, must=(), path=None, children=tuple(map(_without_conditions, n.children)))


def parse(text: Column, model: Node, urns: dict[str, str] | None = None) -> tuple[Column, Column]:
    """(document, errors) of XML text; the data nodes stand below the root element, whatever it is called."""
    known, bare = dict(urns or {}), _without_conditions(model)

    @F.pandas_udf("string")
    def read(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            if t is None or t != t:
                out.append(None)
                continue
            reader = _Reader(bare, known)
            try:
                value = reader.parse(t)
            except (expat.ExpatError, ValueError):
                value, reader.errors = None, [("/", "raw-xml")]
            errors = [{"instance_path": p, "error_class": "decode", "error_tag": tag} for p, tag in reader.errors]
            out.append(json.dumps({"doc": value, "errors": errors}))
        return pd.Series(out, dtype=object)

    both = F.from_json(read(text), f"doc struct<{_raw(model)}>, errors {ERRORS}")
    return F.when(both["doc"].isNotNull(), _typed(both["doc"], model)), F.coalesce(both["errors"], F.array().cast(ERRORS))


def read_rows(spark: SparkSession, path: str, row: str, root: str) -> DataFrame:
    """(file, raw) of each element ``row`` of large files, as a document of its own under ``root``; both as written, with prefixes.

    Files are split anywhere, and a task takes the rows that end in its part.  Declarations of the root element, which
    stands in the first part of a file only, are put around each row.  Row elements must not stand in each other.
    """
    lines = spark.read.option("lineSep", f"</{row}>").text(path).select(F.input_file_name().alias("file"), F.col("value"))
    start = rf"<{re.escape(row)}(?=[\s>/])"
    root_tag = rf"(?s)<{re.escape(root)}((?:\s[^>]*)?)>"
    heads = lines.filter(F.regexp_like("value", F.lit(root_tag))).select("file", F.regexp_extract("value", root_tag, 1).alias("head"))
    rows = lines.withColumn("at", F.regexp_instr("value", F.lit(start))).filter("at > 0")
    rows = rows.select("file", F.expr("substring(value, at)").alias("row"))
    joined = rows.join(heads, "file", "left")
    head = F.coalesce("head", F.lit(""))
    return joined.select("file", F.concat(F.lit(f"<{root}"), head, F.lit(">"), "row", F.lit(f"</{row}></{root}>")).alias("raw"))

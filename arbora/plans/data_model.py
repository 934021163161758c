"""A data model with its modules, and documents of it in a column: what a user calls.

Everything returns DataFrames or Columns; documents are structs in a column ``doc``.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.functions.types import Type
from arbora.operators import navigation as nav
from arbora.operators import annotations, paths, trees
from arbora.plans.model import ALL, ModelError, Node, check_model
from arbora.sources import xml


@dataclass(frozen=True)
class DataModel:
    root: Node
    modules: tuple[tuple[str, str], ...] = ()  # (name, revision)
    annotations: tuple[tuple[str, Type], ...] = ()
    urns: tuple[tuple[str, str], ...] = ()  # (module, namespace)

    @classmethod
    def from_file(cls, path: str) -> DataModel:
        """A model in its JSON form (``Node.to_dict`` under ``root``, modules as [name, revision])."""
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        if "root" not in raw:
            raise ModelError(f"no model in {path}")
        return cls(check_model(Node.from_dict(raw["root"])), tuple(tuple(m) for m in raw.get("modules", ())), (), tuple(raw.get("urns", {}).items()))

    def to_file(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump({"root": self.root.to_dict(), "modules": [list(m) for m in self.modules], "urns": dict(self.urns)}, f)

    def module_set_id(self) -> str:
        return hashlib.sha1("".join(sorted(f"{n}@{r}" for n, r in self.modules)).encode(), usedforsecurity=False).hexdigest()

    # documents in and out

    def from_raw(self, df: DataFrame, json_text: str = "raw") -> DataFrame:
        """``df`` with ``doc`` and ``errors`` (of decoding) from JSON text."""
        v = F.try_parse_json(json_text)
        notes = dict(self.annotations)
        return df.withColumn("_v", v).select(*df.columns, trees.decode(F.col("_v"), self.root).alias("doc"), trees.decode_errors(F.col("_v"), self.root, notes).alias("errors"))

    def from_xml(self, df: DataFrame, text: str = "raw") -> DataFrame:
        """``df`` with ``doc`` and ``errors`` from XML text, by the model's namespaces."""
        doc, errors = xml.parse(F.col(text), self.root, dict(self.urns))
        return df.withColumns({"doc": doc, "errors": errors})

    def at(self, doc: str = "doc") -> paths.Context:
        return paths.document(self.root, F.col(doc))

    def to_json(self, keep: trees.Filter | None = None, doc: str = "doc") -> Column:
        return trees.to_json(self.at(doc), keep)

    def to_xml(self, keep: trees.Filter | None = None, doc: str = "doc", tag: str = "content-data") -> Column:
        return trees.to_xml(self.at(doc), dict(self.urns), tag, keep)

    # what is asked of documents

    def validate(self, df: DataFrame, content: int = ALL, scope: str = "all", first_only: bool = False) -> DataFrame:
        return trees.validate(df, self.root, "doc", content, scope, first_only)

    def add_defaults(self, df: DataFrame, content: int = ALL) -> DataFrame:
        return df.withColumn("doc", trees.add_defaults(self.at(), content))

    def evaluate(self, expression: paths.Expr, doc: str = "doc") -> Column:
        return expression.column(self.at(doc))

    def nodes(self, df: DataFrame) -> DataFrame:
        return trees.node_rows(df, self.root)

    def counts(self, df: DataFrame) -> DataFrame:
        """How many instances each schema node has in all documents."""
        return self.nodes(df).groupBy("schema_path").agg(F.count("*").alias("n"))

    # annotations

    def notes(self, df: DataFrame, json_text: str = "raw") -> DataFrame:
        """``df`` with ``notes``, the annotations of the document in JSON text, and ``note_errors``."""
        known, v = dict(self.annotations), F.try_parse_json(json_text)
        made = df.withColumn("_v", v)
        return made.select(*df.columns, annotations.decode_notes(F.col("_v"), self.root, known).alias("notes"), annotations.note_errors(F.col("_v"), self.root, known).alias("note_errors"))

    def to_annotated_json(self, doc: str = "doc", notes: str = "notes") -> Column:
        return annotations.to_json(self.at(doc), F.col(notes), dict(self.annotations))

    # routes

    def parse_instance_id(self, text: str) -> trees.Route:
        route = nav.route_from_instance_id(text)
        node = self.root
        for name, keys in route:
            node = node.data_child(name)
            for k in keys:
                if k not in ("#", "."):
                    node.data_child(k)
        return route

    def parse_resource_id(self, text: str) -> trees.Route:
        return nav.route_from_resource_id(text, self.root)

    def goto(self, df: DataFrame, route: trees.Route) -> DataFrame:
        return trees.goto(df, self.root, route)

    def peek(self, route: trees.Route, doc: str = "doc") -> Column:
        return trees.peek(self.at(doc), route)

    # the schema

    def get_schema_node(self, path: str) -> Node:
        return self.root.descendant(path)

    def get_data_node(self, path: str) -> Node:
        return self.root.data_node(path)

    def ascii_tree(self) -> str:
        return self.root.ascii_tree()

    def schema_digest(self) -> str:
        return json.dumps(self.root.digest(), default=str)

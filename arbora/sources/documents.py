"""Instance documents as rows: JSON, XML and YAML in, JSON and XML out."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.functions import types as ty
from arbora.plans.model import Node


def read_json(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """One document per line, or with ``whole`` one per file over as many lines as it has, as ``doc`` (VARIANT; NULL where the text is no JSON) and ``raw``."""
    return spark.read.text(path, wholetext=whole).select(F.col("value").alias("raw"), F.try_parse_json("value").alias("doc"))


def read_yaml(spark: SparkSession, path: str) -> DataFrame:
    """One YAML document per file, as JSON text in ``raw`` and VARIANT in ``doc``."""
    files = spark.read.text(path, wholetext=True)

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for f in frames:
            yield pd.DataFrame({"raw": [json.dumps(yaml.safe_load(t), default=str) for t in f["value"]]})

    return files.mapInPandas(load, "raw string").withColumn("doc", F.try_parse_json("raw"))


def read_xml(spark: SparkSession, path: str, row_tag: str, node: Node) -> DataFrame:
    """XML elements decoded by the model's struct."""
    return spark.read.schema(node.struct_type()).option("rowTag", row_tag).xml(path)


def _each(items: Column, node: Node, use) -> Column:
    return F.transform(items, lambda v: use(v, node))


def decode(doc: Column, node: Node, prefix: str = "$") -> list[Column]:
    """The leaves and leaf-lists of a node, from a VARIANT; absent or ill-typed ones are NULL."""
    out = []
    for c in node.data_children():
        own = F.coalesce(F.try_variant_get(doc, f"{prefix}['{c.name}']", "variant"), F.try_variant_get(doc, f"{prefix}['{c.ns}:{c.name}']", "variant"))
        if c.kind == "leaf":
            out.append(ty.decode(own, c.type).alias(c.name))
        elif c.kind == "leaf-list":
            items = F.try_variant_get(own, "$", "array<variant>")
            out.append(_each(items, c, lambda v, n: ty.decode(v, n.type)).alias(c.name))
        elif c.kind == "container":
            out.append(F.when(own.isNotNull(), F.struct(*decode(own, c))).alias(c.name))
        elif c.kind == "list":
            items = F.try_variant_get(own, "$", "array<variant>")
            out.append(_each(items, c, lambda v, n: F.struct(*decode(v, n))).alias(c.name))
        else:
            out.append(own.alias(c.name))
    return out


def decode_violations(df: DataFrame, doc: str, key: str, node: Node) -> DataFrame:
    """(key, instance_path, error_class, error_tag): members that the model lacks, and values of the wrong kind."""
    known = {n for c in node.data_children() for n in (c.name, f"{c.ns}:{c.name}")}
    members = df.filter(F.col(doc).isNotNull()).select(key, F.map_keys(F.try_variant_get(doc, "$", "map<string,variant>")).alias("names"))
    extra = members.select(key, F.explode("names").alias("name")).filter(~F.col("name").isin(*known) & ~F.startswith("name", F.lit("@")))
    extra = extra.select(key, F.concat(F.lit("/"), "name").alias("instance_path"), F.lit("decode").alias("error_class"), F.lit("raw-member").alias("error_tag"))
    checks = []
    for c in node.data_children():
        own = F.coalesce(F.try_variant_get(F.col(doc), f"$['{c.name}']", "variant"), F.try_variant_get(F.col(doc), f"$['{c.ns}:{c.name}']", "variant"))
        if c.kind == "leaf":
            checks.append(F.when(own.isNotNull() & ty.decode(own, c.type).isNull(), F.lit(f"/{c.name}")))
        elif c.kind in ("leaf-list", "list"):
            checks.append(F.when(own.isNotNull() & ~F.startswith(F.schema_of_variant(own), F.lit("ARRAY")), F.lit(f"/{c.name}")))
        elif c.kind == "container":
            checks.append(F.when(own.isNotNull() & ~F.startswith(F.schema_of_variant(own), F.lit("OBJECT")), F.lit(f"/{c.name}")))
    wrong = df.select(key, F.explode(F.array_compact(F.array(*checks))).alias("instance_path"), F.lit("decode").alias("error_class"), F.lit("raw-type").alias("error_tag"))
    return wrong.unionByName(extra)


def metadata(doc: Column, member: str) -> Column:
    """The annotations of a member: an object beside it, named with ``@``."""
    return F.try_variant_get(doc, f"$['@{member}']", "map<string,string>")


def to_xml(df: DataFrame, node: Node, ns_uri: str) -> Column:
    """An entry as XML: one element a leaf, in the order of the model; absent leaves are left out."""
    escape = lambda s: F.replace(F.replace(F.replace(s, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    cells = []
    for c in node.data_children():
        if c.kind == "leaf" and c.name in df.columns:
            text = escape(ty.canon(F.col(f"`{c.name}`"), c.type))
            cells.append(F.coalesce(F.concat(F.lit(f"<{c.name}>"), text, F.lit(f"</{c.name}>")), F.lit("")))
    return F.concat(F.lit(f'<{node.name} xmlns="{ns_uri}">'), *cells, F.lit(f"</{node.name}>"))


def library_modules(library: DataFrame) -> DataFrame:
    """(datastore, name, revision, implemented) of a 2019 library document, by joins of its lists.

    ``library`` has one row: ``datastores`` (name, schema), ``schemas`` (name, sets) and ``sets`` (name, modules, imports).
    """
    stores = library.select(F.explode("datastores").alias("d")).select(F.col("d.name").alias("datastore"), F.col("d.schema").alias("schema"))
    schemas = library.select(F.explode("schemas").alias("s")).select(F.col("s.name").alias("schema"), F.explode("s.sets").alias("set"))
    sets = library.select(F.explode("sets").alias("m")).select("m.*").withColumnRenamed("name", "set")
    member = lambda column, implemented: sets.select("set", F.explode(column).alias("m")).select("set", "m.name", "m.revision", F.lit(implemented).alias("implemented"))
    modules = member("modules", True).unionByName(member("imports", False))
    return stores.join(schemas, "schema").join(modules, "set").select("datastore", "name", "revision", "implemented").distinct()

"""Documents in and out over the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from arbora.functions import types as ty
from arbora.operators import trees
from arbora.plans.model import module_set_id
from arbora.operators.validation import value_counts
from arbora.plans.registry import query
from arbora.plans.warehouse import PROPS, WAREHOUSE
from arbora.sources import documents as src


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS DECIMAL(38,0))::BIGINT AS k FROM events")
def json_decode_props(t):
    doc = t["events"].select("event_id", F.try_parse_json("props").alias("doc"))
    return doc.select("event_id", *src.decode(F.col("doc"), PROPS)).select("event_id", F.col("k").cast("long").alias("k"))


@query("SELECT event_id, CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) <= 50 THEN 'low' ELSE 'any' END AS member FROM events")
def union_decode_props(t):
    kind = ty.Type("union", members=(ty.Type("uint8", ranges=((0, 50),)), ty.Type("uint8")))
    low = ty.Type("union", members=(kind.members[0],))
    doc = t["events"].select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "variant").alias("v"))
    return doc.filter(ty.decode(F.col("v"), kind).isNotNull()).select("event_id", F.when(ty.decode(F.col("v"), low).isNotNull(), "low").otherwise("any").alias("member"))


@query("SELECT event_id, '/unit' AS instance_path, 'decode' AS error_class, 'raw-type' AS error_tag FROM events WHERE event_id % 7 = 0 UNION ALL SELECT event_id, '/odd', 'decode', 'raw-member' FROM events WHERE event_id % 5 = 0")
def json_decode_violations(t):
    extra = F.when(F.col("event_id") % 7 == 0, ',"unit":1}').otherwise("}")
    odd = F.when(F.col("event_id") % 5 == 0, ',"odd":true').otherwise("")
    text = F.concat(F.rtrim(F.col("props"), F.lit("}")), odd, extra)
    return src.decode_violations(t["events"].select("event_id", F.try_parse_json(text).alias("doc")), "doc", "event_id", PROPS)


@query("SELECT n_nationkey, '<nation xmlns=\"urn:w\"><n_nationkey>' || n_nationkey || '</n_nationkey><n_name>' || n_name || '</n_name><n_regionkey>' || n_regionkey || '</n_regionkey></nation>' AS doc FROM nation")
def xml_encode_nation(t):
    df = t["nation"]
    return df.select("n_nationkey", src.to_xml(df, WAREHOUSE.data_child("nation"), "urn:w").alias("doc"))


@query("SELECT n_nationkey, n_name FROM nation")
def xml_round_trip_nation(t):
    df, node = t["nation"], WAREHOUSE.data_child("nation")
    doc = df.select(src.to_xml(df, node, "urn:w").alias("doc"))
    got = doc.select(trees.from_xml(F.col("doc"), node).alias("x"))
    return got.select(F.col("x.n_nationkey").cast("int").alias("n_nationkey"), "x.n_name")


@query("SELECT sha1(string_agg(n_name || '@' || n_regionkey, '' ORDER BY n_name || '@' || n_regionkey)) AS module_set_id FROM nation")
def module_set_id_nation(t):
    return module_set_id(t["nation"].select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("revision")))


def _catalog_sql() -> str:
    """A row for each list and leaf of the model, with how many of it the tables hold."""
    rows = []
    for lst in WAREHOUSE.data_children():
        rows.append(f"SELECT '/{lst.name}' AS path, 'list' AS kind, count(*) AS n FROM {lst.name}")
        rows += [f"SELECT '/{lst.name}/{c.name}', 'leaf', count({c.name}) FROM {lst.name}" for c in lst.data_children()]
    return " UNION ALL ".join(rows)


@query(_catalog_sql())
def schema_catalog(t):
    """The schema nodes of the model with their instances in the tables."""
    names = [lst.name for lst in WAREHOUSE.data_children()]
    sizes = reduce(lambda a, b: a.unionByName(b), [t[n].agg(F.count("*").alias("n")).select(F.lit(f"/{n}").alias("schema_path"), "n") for n in names])
    every = value_counts({n: t[n] for n in names}, WAREHOUSE).unionByName(sizes)
    return WAREHOUSE.catalog(t.spark).join(every, F.col("path") == F.col("schema_path")).select("path", "kind", "n")

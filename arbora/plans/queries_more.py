"""Queries over names, bits and identities in documents, unions, hashes, module libraries and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbora.functions.types import Type
from arbora.operators import paths as px
from arbora.operators import trees
from arbora.operators.paths import here
from arbora.plans import model as m
from arbora.plans.queries_nested import AREAS, areas, over
from arbora.plans.registry import query
from arbora.plans.warehouse import CLOSURE, FLAGS, KINDS, REGION, WAREHOUSE
from arbora.sources import library as lib

ITEM = m.container("item", m.leaf("key", Type("int64")), m.leaf("kind", Type("identityref", identities=KINDS)), m.leaf("flags", Type("bits", bits=FLAGS)), m.leaf("value", Type("union", members=(Type("uint8", ranges=((0, 30),)), Type("string")))))


def items(t):
    """A document for each part: its kind as an identity, its brand's last digit as bits, its size as a union."""
    flags = F.array_compact(F.array(F.when(F.col("p_size") % 2 == 0, F.lit("A")), F.when(F.col("p_size") % 3 == 0, F.lit("N"))))
    doc = F.struct(F.col("p_partkey").alias("key"), F.col("p_type").alias("kind"), flags.alias("flags"), F.col("p_size").cast("string").alias("value"))
    return t["part"].select(F.col("p_partkey").alias("key"), doc.alias("doc"))


@query("SELECT r_regionkey AS key, '' AS top, 'extra:notes' AS notes, 'notes' AS bare, 'nations' AS up, 'regionkey' AS first FROM region")
def path_names(t):
    notes = here.child("notes")
    return over(areas(t), REGION, top=px.name(here), notes=px.name(notes), bare=px.local_name(notes), up=px.name(here.descendant("like").parent()), first=px.name(here.child("*")))


@query("SELECT p_partkey AS key, p_size % 2 = 0 AS even, p_size % 2 = 0 AND p_size % 3 = 0 AS six, p_type IN ('LARGE', 'MEDIUM', 'SMALL') AS sized, p_type = 'PROMO' AS own, false AS strict FROM part")
def path_bits_identities(t):
    kind, flags = here.child("kind"), here.child("flags")
    return over(
        items(t),
        ITEM,
        even=px.bit_is_set(flags, "A"),
        six=px.bit_is_set(flags, "A") & px.bit_is_set(flags, "N"),
        sized=px.derived_from(kind, "sized", CLOSURE),
        own=px.derived_from(kind, "PROMO", CLOSURE, or_self=True),
        strict=px.derived_from(kind, "PROMO", CLOSURE),
    )


@query(
    """SELECT p_partkey AS key, '{"key":"' || p_partkey || '","kind":"' || p_type || '","flags":"' || CASE WHEN p_size % 6 = 0 THEN 'A N' WHEN p_size % 2 = 0 THEN 'A' WHEN p_size % 3 = 0 THEN 'N' ELSE '' END || '","value":' || CASE WHEN p_size <= 30 THEN p_size::VARCHAR ELSE '"' || p_size || '"' END || '}' AS doc FROM part"""
)
def nested_union_encoding(t):
    return items(t).select("key", trees.to_json(px.document(ITEM, F.col("doc"))).alias("doc"))


@query("SELECT r_regionkey AS key, r_regionkey <> 2 AS same, CASE WHEN r_regionkey = 2 THEN 9 ELSE 1 END AS at FROM region")
def nested_changes(t):
    docs = areas(t)
    new = trees.put_member(AREAS.at(), [("name", {})], F.when(F.col("key") == 2, F.lit("OTHER")).otherwise(F.col("doc.name")))
    edited = docs.select("key", "doc", new.alias("new"))
    after = px.document(REGION, F.col("new"))
    return edited.select("key", (trees.etag(after) == trees.etag(AREAS.at())).alias("same"), trees.changed_at(after, F.col("doc"), F.lit(1), F.lit(9)).alias("at"))


@query("SELECT r_regionkey AS key, m FROM region, (SELECT unnest(['regionkey', 'name', 'nations', 'extra:notes']) AS m)")
def nested_member_names(t):
    return areas(t).select("key", trees.member_names(AREAS.at()).alias("names")).select("key", F.explode("names").alias("m"))


@query("SELECT n_name AS name, n_regionkey::VARCHAR AS revision, 'urn:' || n_name AS namespace, 'implement' AS conformance FROM nation")
def library_round_trip(t):
    modules = t["nation"].select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("revision"), F.concat(F.lit("urn:"), "n_name").alias("namespace"), F.array(F.lit("f")).alias("features"), F.lit("implement").alias("conformance"), F.array().cast("array<struct<name:string,revision:string>>").alias("submodules"))
    return lib.read_library(lib.library_document(modules)).select("name", "revision", "namespace", "conformance")


@query("SELECT r_name AS name, max(n_name) AS revision FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def latest_revisions(t):
    own = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    return m.latest_revisions(own.select(F.col("r_name").alias("name"), F.col("n_name").alias("revision")))


@query(
    "SELECT * FROM (SELECT x AS schema_path, count(*) AS n FROM part, (SELECT unnest(['/base', '/base/kept', '/base/part', '/base/part/size', '/base/part/unit']) AS x) GROUP BY x UNION ALL SELECT '/base/more', count(*) FROM part WHERE p_size > 20)"
)
def model_rewrites(t):
    """Parts as documents of a rewritten model: a grouping with a refinement and an augment, a feature that is missing, deviations."""
    group = (m.container("part", m.leaf("size", Type("int32"))),)
    own = m.container("root", m.container("base", m.leaf("kept", Type("string"), features=(("or", "x", ("not", "y")),)), m.leaf("gone", Type("string"), features=("y",)), m.leaf("odd", Type("string")), *m.uses(group, refine={"/part/size": {"mandatory": True}}, augment={"/part": (m.leaf("unit", Type("string")),)})))
    own = own.with_features({"z"}).deviate("/base/odd", "not-supported").augment("/base", m.leaf("more", Type("string"))).augment("/nowhere", m.leaf("lost", Type("string")))
    size = F.struct(F.col("p_size").cast("decimal(38,0)").alias("size"), F.col("p_brand").alias("unit"))
    base = F.struct(F.col("p_name").alias("kept"), F.col("p_name").alias("gone"), F.col("p_type").alias("odd"), size.alias("part"), F.when(F.col("p_size") > 20, F.col("p_type")).alias("more"))
    docs = t["part"].select(F.struct(base.alias("base")).alias("raw"))
    docs = docs.select(trees.shape(m.check_model(own), F.col("raw")).alias("doc"))
    return trees.node_rows(docs, own).groupBy("schema_path").agg(F.count("*").alias("n"))


_REFERENCES = [("nation", "n_regionkey", "region", "r_regionkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey")]


@query(" UNION ALL ".join(f"SELECT '/{t}/{c}' AS path, '/{u}/{d}' AS target, count(DISTINCT {c}) AS n_values, count(DISTINCT {c}) FILTER ({c} NOT IN (SELECT {d} FROM {u} WHERE {d} IS NOT NULL)) AS n_lost FROM {t}" for t, c, u, d in _REFERENCES))
def leafref_targets(t):
    """Where each reference of the model leads, by the schema, and how many distinct values of the tables lead nowhere."""
    out = None
    for path, node in WAREHOUSE.walk():
        if not node.leafref:
            continue
        ((lst, leaf),) = px.resolve(WAREHOUSE.ancestry(path), px.target_path(node))
        given = t[path.split("/")[1]].select(F.col(node.name).alias("v")).filter("v IS NOT NULL").distinct()
        have = t[lst].select(F.col(leaf).alias("w")).distinct()
        counts = given.join(have, F.col("v") == F.col("w"), "left").agg(F.count("*").alias("n_values"), F.count(F.when(F.col("w").isNull(), 1)).alias("n_lost"))
        one = counts.select(F.lit(path).alias("path"), F.lit(f"/{lst}/{leaf}").alias("target"), "n_values", "n_lost")
        out = one if out is None else out.unionByName(one)
    return out

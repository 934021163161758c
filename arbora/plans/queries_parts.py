"""Queries over annotations, counts observed while validating, and parts of documents that are decoded or checked alone."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbora.functions.types import Type
from arbora.operators import annotations as an
from arbora.operators import paths as px
from arbora.operators import trees
from arbora.plans.data_model import DataModel
from arbora.plans.queries_nested import accounts, areas
from arbora.plans.registry import query
from arbora.plans.warehouse import ACCOUNT, REGION

NOTED = DataModel(REGION, (), (("who", Type("string")), ("rank", Type("uint8")), (an.DEFAULT, Type("boolean"))))


def _noted(t):
    """JSON text of each region with annotations: of the region, of its nations' names, of an entry, of a leaf-list's second value."""
    one = F.concat(F.lit('{"@":{"rank":'), F.col("n_nationkey") % 100, F.lit('},"nationkey":'), F.col("n_nationkey"), F.lit(',"name":"'), F.col("n_name"), F.lit('","@name":{"who":"'), F.col("n_name"), F.lit(" '\"}}"))
    own = t["nation"].groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(F.struct("n_nationkey", one.alias("s"))))["s"], ",").alias("n"))
    odd = F.when(F.col("r_regionkey") % 2 == 0, F.lit(',"@lang":{"who":"x"},"@name":{"rank":999}')).otherwise("")
    raw = F.concat(F.lit('{"@":{"who":"'), "r_name", F.lit('"},"regionkey":'), "r_regionkey", F.lit(',"name":"'), "r_name", F.lit('"'), F.when(odd != "", F.lit(',"@name":{"rank":999}')).otherwise(""), F.lit(',"nations":['), "n", F.lit('],"extra:notes":{"tags":["a","b"],"@tags":[null,{"who":"b"}]'), F.when(odd != "", F.lit(',"@lang":{"who":"x"}')).otherwise(""), F.lit("}}"))
    return t["region"].join(own, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_regionkey").alias("key"), raw.alias("raw"))


@query(
    """SELECT r_regionkey AS key, '/' AS path, 'who=' || r_name AS note FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)
UNION ALL SELECT n_regionkey, '/nations[nationkey=''' || n_nationkey || ''']', 'rank=' || n_nationkey % 100 FROM nation
UNION ALL SELECT n_regionkey, '/nations[nationkey=''' || n_nationkey || ''']/name', 'who=' || n_name || ' ''' FROM nation
UNION ALL SELECT DISTINCT n_regionkey, '/extra:notes/tags[.=''b'']', 'who=b' FROM nation"""
)
def annotations_decoded(t):
    notes = NOTED.notes(_noted(t)).select("key", F.explode("notes").alias("n"))
    pairs = notes.select("key", "n.path", F.explode("n.notes").alias("k", "v"))
    return pairs.select("key", "path", F.concat_ws("=", "k", "v").alias("note"))


@query(
    """SELECT DISTINCT n_regionkey AS key, '/name/@rank' AS instance_path, 'raw-type' AS error_tag FROM nation WHERE n_regionkey % 2 = 0
UNION ALL SELECT DISTINCT n_regionkey, '/extra:notes/lang', 'missing-annotation-target' FROM nation WHERE n_regionkey % 2 = 0"""
)
def annotation_errors(t):
    return NOTED.notes(_noted(t)).select("key", F.explode("note_errors").alias("e")).select("key", "e.instance_path", "e.error_tag")


@query(
    """SELECT n_regionkey AS key, '{"@":{"who":"' || any_value(r_name) || '"},"regionkey":' || n_regionkey || ',"name":"' || any_value(r_name) || '","nations":[' ||
string_agg('{"@":{"rank":' || n_nationkey % 100 || '},"nationkey":' || n_nationkey || ',"name":"' || n_name || '","@name":{"who":"' || n_name || ' ''"}}', ',' ORDER BY n_nationkey) ||
'],"extra:notes":{"lang":"en","@lang":{"ietf-netconf-with-defaults:default":true},"tags":["a","b"],"@tags":[null,{"who":"b"}]}}' AS raw FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY n_regionkey"""
)
def annotations_encoded(t):
    """Decoded, filled with tagged defaults, and encoded again."""
    raw = _noted(t)
    docs = NOTED.notes(raw).select("key", "notes", trees.decode(F.try_parse_json("raw"), REGION).alias("doc"))
    filled = docs.select("key", trees.add_defaults(NOTED.at()).alias("doc"), an.tag_defaults(NOTED.at(), F.col("notes")).alias("notes"))
    return filled.select("key", NOTED.to_annotated_json().alias("raw"))


@query(
    """SELECT '/nations/' || x AS schema_path, count(*) AS n FROM nation, (SELECT unnest(['nationkey', 'name', 'like']) AS x) GROUP BY x UNION ALL SELECT '/nations', count(*) FROM nation
UNION ALL SELECT x, count(*) FROM region, (SELECT unnest(['/regionkey', '/name', '/extra:notes']) AS x) GROUP BY x UNION ALL SELECT '/extra:notes/tags', 3 * count(*) FROM region WHERE r_regionkey % 2 = 0"""
)
def counts_while_validating(t):
    """How many instances the schema nodes have, observed in the pass that finds the violations."""
    found, seen = trees.validate_counted(areas(t), REGION)
    found.write.format("noop").mode("overwrite").save()
    return t.spark.createDataFrame(sorted(trees.observed_counts(seen).items()), "schema_path string, n long")


@query(
    """WITH o AS (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN 'O' ELSE o_orderstatus END AS s FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer))
SELECT o_custkey AS key, '/orders[orderkey=''' || o_orderkey || ''']/priority' AS instance_path, 'member-not-allowed' AS error_tag FROM o WHERE s = 'O'
UNION ALL SELECT o_custkey, '/orders[orderkey=''' || o_orderkey || ''']/total', 'cheap-final' FROM o WHERE s = 'F' AND CAST(o_totalprice AS DECIMAL(38,2)) <= 20000"""
)
def checked_again_accounts(t):
    """After an edit of the orders' status: only the columns that look at it are checked again."""
    only = trees.affected(ACCOUNT, ["/orders/status"])
    edit = lambda o: o.withField("status", F.when(o["orderkey"] % 3 == 0, F.lit("O")).otherwise(o["status"]))
    edited = accounts(t, with_lines=False).select("key", F.col("doc").withField("orders", F.transform("doc.orders", edit)).alias("doc"))
    return trees.validate(edited, ACCOUNT, only=only).select("key", "instance_path", "error_tag")


@query("SELECT n_nationkey AS key, CASE WHEN n_nationkey % 3 > 0 THEN n_name END AS name, CASE WHEN n_nationkey % 3 = 1 THEN 'instance-required' WHEN n_nationkey % 3 = 2 THEN 'invalid-type' END AS error_tag FROM nation")
def parts_decoded_alone(t):
    """Entries of a list decoded by themselves and checked as the only one: no JSON object, a lost reference, a wrong name."""
    name = F.when(F.col("n_nationkey") % 3 == 2, F.lit("odd")).otherwise(F.col("n_name"))
    like = F.when(F.col("n_nationkey") % 3 == 1, F.lit("-5")).otherwise(F.col("n_nationkey").cast("string"))
    body = F.concat(F.lit('{"nationkey":'), "n_nationkey", F.lit(',"name":"'), name, F.lit('","like":'), like, F.lit("}"))
    raw = F.when(F.col("n_nationkey") % 3 == 0, F.lit("7")).otherwise(body)
    rows = t["nation"].select(F.col("n_nationkey").alias("key"), "n_name", F.try_parse_json(raw).alias("v"))
    rows = rows.select("key", "n_name", trees.decode_part(F.col("v"), REGION, "/nations", entry=True).alias("part"))
    found = trees.violations_at(px.document(REGION, F.lit(None).cast(REGION.struct_type())), F.when(F.col("part").isNotNull(), F.array("part")), "/nations")
    return rows.select("key", F.when(F.col("part").isNotNull(), F.col("n_name")).alias("name"), F.get(found, F.lit(0))["error_tag"].alias("error_tag"))

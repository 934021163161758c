"""Validation queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbora.functions import types as ty
from arbora.functions import xpath as xp
from arbora.operators import navigation as nav
from arbora.operators import paths as px
from arbora.operators import trees
from arbora.operators import validation as v
from arbora.operators.navigation import entry_path
from arbora.operators.paths import here
from arbora.plans.model import Node, choice, leaf, leaf_list
from arbora.plans.queries_nested import talks
from arbora.plans.registry import query
from arbora.plans.warehouse import CLOSURE, EVENT, FLAGS, PRIORITIES, TALK, WAREHOUSE


def money(name: str):
    return F.col(name).cast("decimal(38,2)").alias(name)


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def key_unique_lineitem(t):
    return v.repeated_keys(t["lineitem"], ["l_orderkey", "l_linenumber"])


@query("SELECT p_name, p_brand, count(DISTINCT p_partkey) AS n FROM part GROUP BY ALL HAVING count(DISTINCT p_partkey) > 1")
def unique_part_name_brand(t):
    return v.not_unique(t["part"], [], ["p_name", "p_brand"], ["p_partkey"])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def leafref_missing_label(t):
    return v.missing_instances(t["documents"].select("doc_id"), "doc_id", t["labels"], "doc_id")


@query("SELECT c_custkey, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey")
def leafref_deref_customer_nation(t):
    return nav.deref(t["customer"], WAREHOUSE.data_child("customer"), "c_nationkey", t, "n_name").select("c_custkey", F.col("n_name").alias("nation"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')")
def leafref_filtered_target(t):
    target = t["orders"].filter("o_orderstatus = 'F'")
    return v.missing_instances(t["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", target, "o_orderkey")


@query("SELECT o_orderkey, count(l_orderkey) AS n, CASE WHEN count(l_orderkey) < 2 THEN 'too-few-elements' ELSE 'too-many-elements' END AS error_tag FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey HAVING count(l_orderkey) < 2 OR count(l_orderkey) > 6")
def cardinality_orders_lineitem(t):
    return v.cardinality(t["orders"], t["lineitem"], [("o_orderkey", "l_orderkey")], 2, 6)


@query("SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem WHERE NOT (l_discount <= l_tax)")
def must_discount_tax(t):
    return v.failing(t["lineitem"], WAREHOUSE.data_child("lineitem"), here.child("l_discount") <= here.child("l_tax")).select("l_orderkey", "l_linenumber", "l_discount", "l_tax")


_PATH_EVENT = "'/events[event_id=''' || event_id || ''']'"


@query(
    f"""SELECT {_PATH_EVENT} || '/event_type' AS instance_path, '/events/event_type' AS schema_path, 'type' AS error_class, 'invalid-type' AS error_tag, CAST(NULL AS VARCHAR) AS error_message FROM events WHERE event_type NOT IN ('click', 'view', 'purchase', 'signup')
UNION ALL SELECT {_PATH_EVENT} || '/value', '/events/value', 'schema', 'member-not-allowed', NULL FROM events WHERE value IS NOT NULL AND event_type NOT IN ('purchase', 'click')
UNION ALL SELECT {_PATH_EVENT} || '/event_id', '/events/event_id', 'schema', 'list-key-missing', NULL FROM events WHERE event_id IS NULL"""
)
def when_guard_events_value(t):
    df = t["events"].select("event_id", "event_type", money("value"))
    return v.row_checks(df, EVENT, entry_path("events", ["event_id"]), "/events")


@query(
    """WITH l AS (SELECT *, '/lineitem[l_orderkey=''' || l_orderkey || '''][l_linenumber=''' || l_linenumber || ''']' AS p, CAST(l_quantity AS DECIMAL(38,2)) AS q, CAST(l_discount AS DECIMAL(38,2)) AS d, CAST(l_tax AS DECIMAL(38,2)) AS x FROM lineitem)
SELECT p || '/l_quantity' AS instance_path, '/lineitem/l_quantity' AS schema_path, 'type' AS error_class, 'invalid-type' AS error_tag, CAST(NULL AS VARCHAR) AS error_message FROM l WHERE q < 1 OR q > 45
UNION ALL SELECT p || '/l_discount', '/lineitem/l_discount', 'schema', 'member-not-allowed', NULL FROM l WHERE NOT q > 2
UNION ALL SELECT p || '/l_tax', '/lineitem/l_tax', 'semantic', 'tax-too-high', NULL FROM l WHERE NOT x <= d + 0.05
UNION ALL SELECT p, '/lineitem', 'semantic', 'non-unique-key', NULL FROM l GROUP BY p HAVING count(*) > 1"""
)
def validate_lineitem(t):
    df = t["lineitem"].withColumns({c: money(c) for c in ("l_quantity", "l_discount", "l_tax")})
    return v.validate_list(df, WAREHOUSE.data_child("lineitem"), t)


@query(
    """SELECT '/customer[c_custkey=''' || c_custkey || ''']/c_acctbal' AS instance_path, '/customer/c_acctbal' AS schema_path, 'type' AS error_class, 'invalid-type' AS error_tag, CAST(NULL AS VARCHAR) AS error_message FROM customer WHERE CAST(c_acctbal AS DECIMAL(38,2)) < 0
UNION ALL SELECT '/customer[' || c_name || ']', '/customer', 'semantic', 'data-not-unique', NULL FROM customer GROUP BY c_name HAVING count(DISTINCT c_custkey) > 1"""
)
def validate_customer(t):
    return v.validate_list(t["customer"].withColumn("c_acctbal", money("c_acctbal")), WAREHOUSE.data_child("customer"), t)


@query("SELECT '/orders[o_orderkey=''' || o_orderkey || ''']/o_totalprice' AS instance_path, '/orders/o_totalprice' AS schema_path, 'semantic' AS error_class, 'cheap-final' AS error_tag, CAST(NULL AS VARCHAR) AS error_message FROM orders WHERE o_orderstatus = 'F' AND CAST(o_totalprice AS DECIMAL(38,2)) <= 20000")
def validate_orders(t):
    return v.validate_list(t["orders"].withColumn("o_totalprice", money("o_totalprice")), WAREHOUSE.data_child("orders"), t)


@query("SELECT p_partkey, p_size FROM part WHERE p_size < 1 OR p_size > 40")
def type_range_size(t):
    kind = WAREHOUSE.data_node("part/p_size").type
    return t["part"].filter(~ty.valid(F.col("p_size"), kind)).select("p_partkey", "p_size")


@query("SELECT p_partkey, p_name FROM part WHERE length(p_name) NOT BETWEEN 9 AND 11")
def type_length_name(t):
    return t["part"].filter(~ty.valid(F.col("p_name"), ty.Type("string", ranges=((9, 11),)))).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_brand FROM part WHERE NOT regexp_full_match(p_brand, 'Brand#[0-9]')")
def type_pattern_brand(t):
    return t["part"].filter(~ty.valid(F.col("p_brand"), ty.Type("string", patterns=("Brand#[0-9]",)))).select("p_partkey", "p_brand")


@query("SELECT n_nationkey, n_name FROM nation WHERE regexp_full_match(n_name, 'NATION_1[0-9]')")
def type_inverted_pattern_nation(t):
    return t["nation"].filter(~ty.valid(F.col("n_name"), ty.Type("string", not_patterns=("NATION_1[0-9]",)))).select("n_nationkey", "n_name")


@query("SELECT o_orderkey, CAST(CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS DOUBLE) AS value FROM orders")
def enum_value_priority(t):
    return t["orders"].select("o_orderkey", xp.enum_value(F.col("o_orderpriority"), dict(PRIORITIES)).alias("value"))


@query("SELECT l_orderkey, l_linenumber, l_returnflag || ' ' || l_linestatus AS flags, CAST(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 WHEN 'R' THEN 4 ELSE 0 END + CASE l_linestatus WHEN 'F' THEN 8 WHEN 'O' THEN 16 ELSE 0 END AS BIGINT) AS mask FROM lineitem")
def bits_flags_canonical(t):
    kind = ty.Type("bits", bits=FLAGS)
    both = F.array("l_linestatus", "l_returnflag")
    return t["lineitem"].select("l_orderkey", "l_linenumber", ty.canon(both, kind).alias("flags"), ty.bits_value(both, kind).alias("mask"))


@query("SELECT p_partkey, p_type FROM part WHERE p_type IN ('LARGE', 'MEDIUM', 'SMALL')")
def identity_derived_from_parttype(t):
    return t["part"].filter(xp.derived_from(F.col("p_type"), "sized", CLOSURE)).select("p_partkey", "p_type")


@query(
    """WITH RECURSIVE e(child, parent) AS (VALUES ('sized', 'part-kind'), ('traded', 'part-kind'), ('LARGE', 'sized'), ('MEDIUM', 'sized'), ('SMALL', 'sized'), ('ECONOMY', 'traded'), ('PROMO', 'traded'), ('STANDARD', 'traded')),
up(child, parent) AS (SELECT * FROM e UNION SELECT up.child, e.parent FROM up JOIN e ON up.parent = e.child)
SELECT parent AS identity, count(*) AS n FROM part JOIN up ON p_type = child GROUP BY parent"""
)
def identity_ancestors_of_parts(t):
    pairs = [(k, a) for k, up in CLOSURE.items() for a in sorted(up)]
    table = t.spark.createDataFrame(pairs, "child string, parent string")
    return t["part"].join(F.broadcast(table), F.col("p_type") == F.col("child")).groupBy(F.col("parent").alias("identity")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN CAST(l_discount AS DECIMAL(38,2)) = 0 THEN '0.0' ELSE regexp_replace(CAST(CAST(l_discount AS DECIMAL(38,2)) AS VARCHAR), '0+$', '') END AS canonical FROM lineitem")
def decimal64_canonical_discount(t):
    return t["lineitem"].select("l_orderkey", "l_linenumber", ty.canon(F.col("l_discount").cast("decimal(38,2)"), ty.Type("decimal64", digits=2)).alias("canonical"))


_TURNS = Node("talk", "container", (choice("kind", leaf("asked", ty.Type("boolean")), leaf("told", ty.Type("boolean"))), leaf_list("roles", ty.Type("string"), max_elements=7, config=False)))


@query("SELECT conv_id, '/kind' AS schema_path, 'member-not-allowed' AS error_tag FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'user') > 2 AND count(*) FILTER (role = 'assistant') > 2")
def choice_turns(t):
    many = lambda role: F.when(F.count_if(F.col("role") == role) > 2, F.lit(True))
    docs = t["conversations"].groupBy("conv_id").agg(many("user").alias("asked"), many("assistant").alias("told"))
    docs = docs.select("conv_id", F.struct("asked", "told", F.array().cast("array<string>").alias("roles")).alias("doc"))
    return trees.validate(docs, _TURNS).select("conv_id", "schema_path", "error_tag")


_PART = Node("item", "container", (choice("why", leaf("large", ty.Type("boolean")), leaf("special", ty.Type("boolean")), leaf("dear", ty.Type("boolean"))),))


@query("SELECT p_partkey, '/why' AS instance_path, 'member-not-allowed' AS error_tag FROM part WHERE CAST(p_size > 25 AS INTEGER) + CAST(p_type IN ('PROMO', 'SMALL') AS INTEGER) + CAST(p_retailprice > 1000 AS INTEGER) > 1")
def choice_exclusive_part(t):
    cases = {"large": F.col("p_size") > 25, "special": F.col("p_type").isin("PROMO", "SMALL"), "dear": F.col("p_retailprice") > 1000}
    docs = t["part"].select("p_partkey", F.struct(*[F.when(c, F.lit(True)).alias(k) for k, c in cases.items()]).alias("doc"))
    return trees.validate(docs, _PART).select("p_partkey", "instance_path", "error_tag")


_DOCUMENT = Node("documents", "list", (leaf("doc_id", ty.Type("int64")), leaf("text", ty.Type("string")), leaf("n_chars", ty.Type("int32"))), keys=("doc_id",))


@query("SELECT doc_id, n_chars FROM documents WHERE NOT (n_chars = length(text) AND length(text) < 5000)")
def must_string_length_documents(t):
    sound = (here.child("n_chars") == px.string_length(here.child("text"))) & (px.string_length(here.child("text")) < 5000)
    return v.failing(t["documents"], _DOCUMENT, sound).select("doc_id", "n_chars")


_VECTOR = Node("vectors", "container", (leaf_list("embedding", ty.Type("decimal64", digits=2), min_elements=1, max_elements=63, config=False),))


@query("SELECT vec_id, 'too-many-elements' AS error_tag FROM embeddings WHERE len(embedding) > 63 UNION ALL SELECT vec_id, 'too-few-elements' FROM embeddings WHERE embedding IS NULL OR len(embedding) < 1")
def leaf_list_cardinality_embeddings(t):
    docs = t["embeddings"].select("vec_id", F.struct(F.col("embedding").cast("array<decimal(38,2)>").alias("embedding")).alias("doc"))
    return trees.validate(docs, _VECTOR, scope="semantics").select("vec_id", "error_tag")


@query("SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def leafref_language_of_labels(t):
    return v.missing_instances(t["labels"].select("doc_id"), "doc_id", t["documents"].filter("lang = 'en'"), "doc_id")


@query(
    " UNION ALL ".join(
        f"SELECT '/{lst}/{leaf}' AS schema_path, count({leaf}) AS n FROM {lst}" for lst, leaves in {"region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name", "n_regionkey"), "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")}.items() for leaf in leaves
    )
)
def val_counts(t):
    root = WAREHOUSE
    keep = tuple(c for c in root.children if c.name in ("region", "nation", "part"))
    return v.value_counts(t, type(root)(root.name, root.kind, keep))


@query(" UNION ALL ".join(f"SELECT '/{lst.name}/{leaf.name}' AS schema_path, count({leaf.name}) AS n FROM {lst.name}" for lst in WAREHOUSE.data_children() for leaf in lst.data_children()))
def val_counts_warehouse(t):
    return v.value_counts(t, WAREHOUSE)


@query("SELECT conv_id AS key, '/turns[' || role || ']' AS instance_path FROM conversations WHERE role IS NOT NULL GROUP BY conv_id, role HAVING count(*) > 1")
def non_unique_roles(t):
    return trees.validate(talks(t), TALK).filter("error_tag = 'data-not-unique'").select("key", "instance_path")

"""Navigation, axes, windows, defaults, edits, merging and encoding over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbora.operators import editing as ed
from arbora.operators import navigation as nav
from arbora.plans.queries_validation import money
from arbora.plans.registry import query
from arbora.plans.warehouse import EVENT, WAREHOUSE


@query("SELECT n_nationkey, '/nation/' || (row_number() OVER (ORDER BY n_nationkey) - 1) AS pointer FROM nation")
def json_pointer_nation(t):
    return nav.json_pointers(t["nation"].select("n_nationkey"), "nation", ["n_nationkey"])


@query("SELECT l_orderkey, l_linenumber, '/lineitem/' || (row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1) AS pointer FROM lineitem")
def json_pointer_lineitem(t):
    return nav.json_pointers(t["lineitem"].select("l_orderkey", "l_linenumber"), "lineitem", ["l_orderkey", "l_linenumber"])


@query("SELECT conv_id, turn, '/conversations[conv_id=''' || conv_id || ''']/turn/' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS pointer FROM conversations")
def json_pointer_turns(t):
    return t["conversations"].select("conv_id", "turn", nav.json_pointer_within("conversations", "turn", ["conv_id"], ["turn"]).alias("pointer"))


@query("SELECT '/orders[o_orderkey=''' || o_orderkey || ''']' AS route, o_custkey FROM orders")
def instance_route_orders(t):
    return t["orders"].select(nav.entry_path("orders", ["o_orderkey"]).alias("route"), "o_custkey")


@query("SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7")
def look_up_customer(t):
    return nav.look_up(t["customer"], c_mktsegment="BUILDING", c_nationkey=7).select("c_custkey", "c_name", "c_nationkey")


@query("SELECT o_orderstatus FROM orders WHERE o_orderkey = 7")
def goto_instance_id(t):
    return nav.follow(nav.route_from_instance_id("/orders[o_orderkey='7']/o_orderstatus"), t)


@query("SELECT n_name FROM nation WHERE n_nationkey = 3")
def goto_resource_id(t):
    return nav.follow(nav.route_from_resource_id("/nation=3/n_name", WAREHOUSE), t)


@query("SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous_role FROM conversations")
def next_previous_turn(t):
    args = (["conv_id"], ["turn"], "role")
    return t["conversations"].select("conv_id", "turn", "role", nav.next_entry(None, *args).alias("next_role"), nav.previous_entry(None, *args).alias("previous_role"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, count(*) OVER (PARTITION BY conv_id) AS last FROM conversations")
def xpath_position_last(t):
    return t["conversations"].select("conv_id", "turn", nav.position(["conv_id"], ["turn"]).alias("pos"), nav.last(["conv_id"]).alias("last"))


@query("SELECT conv_id, turn, count(*) OVER w AS before, coalesce(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER w, 0)::BIGINT AS users FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def xpath_preceding(t):
    w = nav.preceding(["conv_id"], ["turn"])
    return t["conversations"].select("conv_id", "turn", F.count("*").over(w).alias("before"), F.count_if(F.col("role") == "user").over(w).alias("users"))


@query("SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM conversations")
def xpath_following(t):
    return t["conversations"].select("conv_id", "turn", F.count("*").over(nav.following(["conv_id"], ["turn"])).alias("after"))


@query("SELECT r_name, n_name FROM region JOIN nation ON n_regionkey = r_regionkey")
def axis_child(t):
    return nav.children(t["region"], t["nation"], [("r_regionkey", "n_regionkey")]).select("r_name", "n_name")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
def axis_parent(t):
    return nav.parents(t["supplier"].filter("s_acctbal < 0"), t["nation"], [("n_nationkey", "s_nationkey")]).select("n_nationkey", "n_name")


@query("SELECT l_orderkey, l_linenumber, o_custkey, c_nationkey, n_regionkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def axis_ancestor(t):
    lines = t["lineitem"].select("l_orderkey", "l_linenumber")
    steps = [("lineitem", "l_orderkey"), ("orders", "o_custkey"), ("customer", "c_nationkey")]
    return nav.ancestors(lines, WAREHOUSE, steps, t).select("l_orderkey", "l_linenumber", "o_custkey", "c_nationkey", "n_regionkey")


@query("SELECT '/region/r_name' AS path, r_name AS value FROM region UNION ALL SELECT '/nation/n_name', n_name FROM nation UNION ALL SELECT '/part/p_name', p_name FROM part UNION ALL SELECT '/customer/c_name', c_name FROM customer UNION ALL SELECT '/supplier/s_name', s_name FROM supplier")
def descendant_all_names(t):
    return nav.descendants(t, {"region": "r_name", "nation": "n_name", "part": "p_name", "customer": "c_name", "supplier": "s_name"})


@query("SELECT n_regionkey, count(*)::BIGINT AS n, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey")
def nest_nations(t):
    nested = nav.nest(t["region"], t["nation"], [("r_regionkey", "n_regionkey")], ["n_nationkey"], "nations").filter(F.size("nations") > 0)
    return nested.select(F.col("r_regionkey").alias("n_regionkey"), F.size("nations").cast("long").alias("n"), F.array_join(F.transform("nations", lambda x: x.n_name), ",").alias("names"))


@query("SELECT r_regionkey, (row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1)::INTEGER AS _pos, n_nationkey, n_name FROM region JOIN nation ON n_regionkey = r_regionkey")
def shred_nations(t):
    nested = nav.nest(t["region"], t["nation"].select("n_nationkey", "n_name", "n_regionkey"), [("r_regionkey", "n_regionkey")], ["n_nationkey"], "nations")
    return nav.shred(nested, ["r_regionkey"], "nations").select("r_regionkey", "_pos", "n_nationkey", "n_name")


@query(
    """SELECT '/nation[n_nationkey=''' || n_nationkey || ''']/' || name AS path, '/nation/' || name AS schema_path, name, value FROM (SELECT n_nationkey, unnest(['n_nationkey', 'n_name', 'n_regionkey']) AS name, unnest([n_nationkey::VARCHAR, n_name, n_regionkey::VARCHAR]) AS value FROM nation)"""
)
def node_table_nation(t):
    return nav.node_table(t["nation"], WAREHOUSE.data_child("nation"))


@query("SELECT s_suppkey, n_name AS target_value FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def instance_identifier_deref(t):
    ids = t["supplier"].select("s_suppkey", F.concat(F.lit("/nation[n_nationkey='"), F.col("s_nationkey").cast("string"), F.lit("']/n_name")).alias("ref"))
    nodes = nav.node_table(t["nation"], WAREHOUSE.data_child("nation"))
    return nav.deref_paths(ids, "ref", nodes).select("s_suppkey", "target_value")


@query("SELECT event_id, event_type, CASE WHEN event_type IN ('purchase', 'click') THEN coalesce(CASE WHEN value > 10 THEN CAST(value AS DECIMAL(38,2)) END, 0) ELSE CASE WHEN value > 10 THEN CAST(value AS DECIMAL(38,2)) END END AS value FROM events")
def defaults_added(t):
    df = t["events"].select("event_id", "event_type", F.when(F.col("value") > 10, money("value")).alias("value"))
    return ed.add_defaults(df, EVENT)


@query("SELECT event_id, CASE WHEN event_type IN ('purchase', 'click') AND NOT value > 10 THEN 'value' ELSE '' END AS defaults FROM events")
def defaults_tagged(t):
    df = t["events"].select("event_id", "event_type", F.when(F.col("value") > 10, money("value")).alias("value"))
    return ed.add_defaults(df, EVENT, tag=True).select("event_id", F.array_join("_defaults", ",").alias("defaults"))


@query("SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 1 ELSE p_size END AS p_size FROM part")
def edit_put(t):
    return ed.put(t["part"].select("p_partkey", "p_size", "p_type"), "p_size", F.lit(1), F.col("p_type") == "PROMO").drop("p_type")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def edit_delete(t):
    gone = t["customer"].filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return ed.delete_keys(t["orders"].select("o_orderkey", "o_custkey"), gone, ["o_custkey"])


@query("SELECT c_custkey, CASE WHEN NOT c_acctbal < 0 THEN c_mktsegment END AS c_mktsegment FROM customer")
def edit_delete_member(t):
    df = t["customer"].select("c_custkey", "c_acctbal", "c_mktsegment")
    return ed.delete_member(df, "c_mktsegment", F.col("c_acctbal") < 0).drop("c_acctbal")


@query(
    """SELECT conv_id, turn, role, _new, row_number() OVER (PARTITION BY conv_id ORDER BY turn, side)::INTEGER - 1 AS _pos
FROM (SELECT conv_id, turn, role, 0 AS side, false AS _new FROM conversations UNION ALL SELECT conv_id, turn, 'note', 1, true FROM conversations WHERE role = 'user')"""
)
def edit_insert_after(t):
    df = t["conversations"].select("conv_id", "turn", "role")
    return ed.insert(df, ["conv_id"], ["turn"], df.filter("role = 'user'").withColumn("role", F.lit("note")))


@query(
    """SELECT conv_id, turn, role, _new, row_number() OVER (PARTITION BY conv_id ORDER BY turn, side)::INTEGER - 1 AS _pos
FROM (SELECT conv_id, turn, role, 0 AS side, false AS _new FROM conversations UNION ALL SELECT conv_id, turn, 'note', -1, true FROM conversations WHERE role = 'user')"""
)
def edit_insert_before(t):
    df = t["conversations"].select("conv_id", "turn", "role")
    return ed.insert(df, ["conv_id"], ["turn"], df.filter("role = 'user'").withColumn("role", F.lit("note")), after=False)


@query(
    """WITH ch AS (SELECT c_custkey + 50 AS c_custkey, 'MERGED' AS c_mktsegment FROM customer WHERE c_custkey % 3 = 0)
SELECT coalesce(c.c_custkey, ch.c_custkey) AS c_custkey, c.c_name, coalesce(ch.c_mktsegment, c.c_mktsegment) AS c_mktsegment FROM customer c FULL JOIN ch ON c.c_custkey = ch.c_custkey"""
)
def merge_upsert_customer(t):
    base = t["customer"].select("c_custkey", "c_name", "c_mktsegment")
    changes = t["customer"].filter("c_custkey % 3 = 0").select((F.col("c_custkey") + 50).alias("c_custkey"), F.lit("MERGED").alias("c_mktsegment"))
    return ed.merge(base, changes, ["c_custkey"])


@query("SELECT n_regionkey, string_agg(v, ',' ORDER BY s, v) AS merged FROM (SELECT n_regionkey, n_name AS v, 0 AS s FROM nation UNION ALL SELECT r_regionkey, 'NATION_3', 1 FROM region WHERE r_regionkey NOT IN (SELECT n_regionkey FROM nation WHERE n_name = 'NATION_3')) GROUP BY n_regionkey")
def merge_leaf_lists(t):
    have = t["nation"].groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("a"))
    return have.select("n_regionkey", F.array_join(ed.merge_leaf_list(F.col("a"), F.array(F.lit("NATION_3"))), ",").alias("merged"))


@query("SELECT n_nationkey, sha256('n_name' || chr(31) || n_name || chr(31) || 'n_regionkey' || chr(31) || n_regionkey) AS etag FROM nation")
def etag_rows(t):
    return t["nation"].select("n_nationkey", ed.etag(["n_regionkey", "n_name"]).alias("etag"))


@query("SELECT n_nationkey, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}' AS doc FROM nation")
def json_encode_nation(t):
    df = t["nation"]
    return df.select("n_nationkey", ed.encode_json(df, WAREHOUSE.data_child("nation")).alias("doc"))


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 2")
def numeric_predicate(t):
    return nav.at_positions(t["orders"], ["o_custkey"], ["o_orderkey"], most=2).select("o_orderkey", "nth")


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 1 OFFSET 4")
def goto_index(t):
    return nav.follow(nav.route_from_instance_id("/nation[5]"), t, WAREHOUSE).select("n_nationkey", "n_name")


@query("SELECT s_suppkey, '/nation[n_nationkey=''' || s_nationkey || ''']/n_name' AS ref FROM supplier")
def canonical_instance_ids(t):
    loose = F.concat(F.lit('/nation[ n_nationkey = "'), F.col("s_nationkey").cast("string"), F.lit('" ]/n_name'))
    return t["supplier"].select("s_suppkey", nav.canonical_instance_id(loose).alias("ref"))

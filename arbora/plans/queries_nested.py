"""Queries over nested documents: validation, defaults, encoding, routes, edits, merging and compiled path expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbora.operators import navigation as nav
from arbora.operators import paths as px
from arbora.operators import trees
from arbora.operators.paths import current, here, last, position, root
from arbora.plans.data_model import DataModel
from arbora.plans.registry import query
from arbora.plans.warehouse import ACCOUNT, REGION, TALK

AREAS = DataModel(REGION, (("area", "2024-01-01"), ("extra", "")), urns=(("extra", "urn:extra"),))


def dec(name: str, alias: str):
    return F.col(name).cast("decimal(38,2)").alias(alias)


def _named(df, key: str, model):
    """Rows of a key and the document made of all other columns."""
    rows = df.select(F.col(key).alias("key"), F.struct(*[c.name for c in model.data_children()]).alias("doc"))
    return rows.select("key", trees.shape(model, F.col("doc")).alias("doc"))


def accounts(t, priority=None, with_lines=True):
    """A document for each customer: orders with their lines, which are not read for what does not look at them."""
    lines = t["lineitem"].select("l_orderkey", F.col("l_linenumber").alias("linenumber"), dec("l_quantity", "quantity"), dec("l_discount", "discount"), dec("l_tax", "tax"), F.col("l_returnflag").alias("flag"))
    own = F.col("o_orderpriority") if priority is None else priority
    orders = t["orders"].select("o_custkey", F.col("o_orderkey").alias("orderkey"), F.col("o_orderstatus").alias("status"), own.alias("priority"), dec("o_totalprice", "total"))
    none = F.array().cast(ACCOUNT.data_node("/orders/lines").data_type())
    orders = nav.nest(orders, lines, [("orderkey", "l_orderkey")], ["linenumber"], "lines") if with_lines else orders.withColumn("lines", none)
    people = t["customer"].select(F.col("c_custkey").alias("custkey"), F.col("c_name").alias("name"), dec("c_acctbal", "balance"))
    return _named(nav.nest(people, orders, [("custkey", "o_custkey")], ["orderkey"], "orders"), "custkey", ACCOUNT)


def areas(t):
    """A document for each region: its nations, each like the one two before it."""
    nations = t["nation"].select("n_regionkey", F.col("n_nationkey").alias("nationkey"), F.col("n_name").alias("name"), (F.col("n_nationkey") - 2).alias("like"))
    regions = t["region"].select(F.col("r_regionkey").alias("regionkey"), F.col("r_name").alias("name"))
    own = nav.nest(regions, nations, [("regionkey", "n_regionkey")], ["nationkey"], "nations")
    tags = F.when(F.col("regionkey") % 2 == 0, F.array(F.lit("even"), F.lit("even"), F.lit("far-too-long")))
    return _named(own.withColumn("notes", F.struct(F.lit(None).cast("string").alias("lang"), tags.alias("tags"))), "regionkey", REGION)


def talks(t):
    turns = t["conversations"].select("conv_id", "turn", "role")
    ids = turns.select(F.col("conv_id").alias("id")).distinct()
    own = nav.nest(ids, turns, [("id", "conv_id")], ["turn"], "turns")
    size = F.size("turns")
    own = own.withColumn("short", F.when(size < 6, F.lit(True))).withColumn("long", F.when(size > 4, F.lit(True)))
    return _named(own, "id", TALK)


def over(df, model, **columns):
    """The key and expressions at each document."""
    ctx = px.document(model, F.col("doc"))
    return df.select("key", *[e.column(ctx).alias(k) for k, e in columns.items()])


# validation

_LINES = """WITH l AS (SELECT o_custkey AS key, '/orders[orderkey=''' || o_orderkey || ''']' AS o, '/orders[orderkey=''' || o_orderkey || ''']/lines[linenumber=''' || l_linenumber || ''']' AS p,
  CAST(l_quantity AS DECIMAL(38,2)) AS q, CAST(l_discount AS DECIMAL(38,2)) AS d, CAST(l_tax AS DECIMAL(38,2)) AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
n AS (SELECT o_custkey AS key, '/orders[orderkey=''' || o_orderkey || ''']/lines' AS p, count(l_orderkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"""


@query(
    f"""{_LINES} SELECT key, p || '/quantity' AS instance_path, '/orders/lines/quantity' AS schema_path, 'type' AS error_class, 'invalid-type' AS error_tag FROM l WHERE q < 1 OR q > 45
UNION ALL SELECT key, p || '/discount', '/orders/lines/discount', 'schema', 'member-not-allowed' FROM l WHERE NOT q > 2
UNION ALL SELECT key, p || '/tax', '/orders/lines/tax', 'semantic', 'tax-too-high' FROM l WHERE NOT CAST(x AS DOUBLE) <= CAST(d AS DOUBLE) + 0.05
UNION ALL SELECT key, p, '/orders/lines', 'semantic', 'non-unique-key' FROM l GROUP BY key, p HAVING count(*) > 1
UNION ALL SELECT key, p, '/orders/lines', 'semantic', CASE WHEN n < 2 THEN 'too-few-elements' ELSE 'too-many-elements' END FROM n WHERE n < 2 OR n > 6
UNION ALL SELECT o_custkey, '/orders[orderkey=''' || o_orderkey || ''']/total', '/orders/total', 'semantic', 'cheap-final' FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND CAST(o_totalprice AS DECIMAL(38,2)) <= 20000
UNION ALL SELECT o_custkey, '/orders[orderkey=''' || o_orderkey || ''']/priority', '/orders/priority', 'schema', 'member-not-allowed' FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O'"""
)
def nested_validate_accounts(t):
    return trees.validate(accounts(t), ACCOUNT).drop("seq", "error_message")


@query("SELECT c_custkey AS key, 'member-not-allowed' AS error_tag FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') GROUP BY ALL")
def nested_validate_scope(t):
    found = trees.validate(accounts(t), ACCOUNT, scope="syntax")
    return found.filter("schema_path = '/orders/priority'").select("key", "error_tag").distinct()


@query(
    """SELECT regionkey AS key, p AS instance_path, tag AS error_tag FROM (
SELECT n_regionkey AS regionkey, '/nations[nationkey=''' || n_nationkey || ''']/like' AS p, 'instance-required' AS tag FROM nation a WHERE NOT EXISTS (SELECT 1 FROM nation b WHERE b.n_regionkey = a.n_regionkey AND b.n_nationkey = a.n_nationkey - 2)
UNION ALL SELECT r_regionkey, '/extra:notes/tags[.=''far-too-long'']', 'invalid-type' FROM region WHERE r_regionkey % 2 = 0
UNION ALL SELECT r_regionkey, '/extra:notes/tags[.=''even'']', 'repeated-leaf-list-value' FROM region WHERE r_regionkey % 2 = 0
UNION ALL SELECT r_regionkey, '/extra:notes/tags', 'too-many-elements' FROM region WHERE r_regionkey % 2 = 0)"""
)
def nested_references_areas(t):
    return AREAS.validate(areas(t)).select("key", "instance_path", "error_tag")


@query(
    """WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) SELECT conv_id AS key, '/turns' AS schema_path, 'too-many-elements' AS error_tag FROM n WHERE n > 7
UNION ALL SELECT conv_id, '/turns', 'data-not-unique' FROM (SELECT conv_id, role FROM conversations WHERE role IS NOT NULL GROUP BY conv_id, role HAVING count(*) > 1)
UNION ALL SELECT conv_id, '/length', 'member-not-allowed' FROM n WHERE n = 5"""
)
def nested_choice_talks(t):
    return trees.validate(talks(t), TALK).select("key", "schema_path", "error_tag")


# defaults


@query("SELECT o_orderkey AS orderkey, CASE WHEN o_orderstatus = 'F' THEN '4-NOT SPECIFIED' WHEN o_orderstatus = 'P' THEN o_orderpriority END AS priority FROM orders JOIN customer ON o_custkey = c_custkey")
def nested_defaults_accounts(t):
    docs = accounts(t, F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")), with_lines=False)
    filled = docs.select(trees.add_defaults(px.document(ACCOUNT, F.col("doc"))).alias("doc"))
    return filled.select(F.explode("doc.orders").alias("o")).select("o.orderkey", "o.priority")


@query("SELECT r_regionkey AS key, '/extra:notes/lang' AS path, 'en' AS value FROM region")
def nested_defaults_in_use(t):
    return areas(t).select("key", trees.defaults_in_use(AREAS.at()).alias("used")).select("key", F.inline("used"))


# encoding

_NATIONS = "SELECT n_regionkey, string_agg({}, '{}' ORDER BY n_nationkey) AS n FROM nation GROUP BY n_regionkey"
_TAGS = "CASE WHEN r_regionkey % 2 = 0 THEN '{}' ELSE '{}' END"


@query(
    "SELECT r_regionkey AS key, '{\"regionkey\":' || r_regionkey || ',\"name\":\"' || r_name || '\",\"nations\":[' || n || ']' || "
    + _TAGS.format(',"extra:notes":{"tags":["even","even","far-too-long"]}', "")
    + " || '}' AS doc FROM region JOIN ("
    + _NATIONS.format("'{\"nationkey\":' || n_nationkey || ',\"name\":\"' || n_name || '\",\"like\":' || (n_nationkey - 2) || '}'", ",")
    + ") ON n_regionkey = r_regionkey"
)
def nested_json_areas(t):
    return areas(t).select("key", AREAS.to_json().alias("doc"))


@query(
    "SELECT r_regionkey AS key, '{\"regionkey\":' || r_regionkey || ',\"nations\":[' || n || ']}' AS doc FROM region JOIN ("
    + _NATIONS.format("'{\"nationkey\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}'", ",").replace("FROM nation", "FROM nation WHERE n_nationkey > 9")
    + ") ON n_regionkey = r_regionkey"
)
def nested_json_filtered(t):
    def keep(path, ctx):
        if path in ("/name", "/notes", "/nations/like"):
            return False
        return ctx.value["nationkey"] > 9 if path == "/nations/*" else True

    return areas(t).select("key", AREAS.to_json(keep).alias("doc"))


@query(
    "SELECT r_regionkey AS key, '<content-data><regionkey>' || r_regionkey || '</regionkey><name>' || r_name || '</name>' || n || '<notes xmlns=\"urn:extra\">' || "
    + _TAGS.format("<tags>even</tags><tags>even</tags><tags>far-too-long</tags>", "")
    + " || '</notes></content-data>' AS doc FROM region JOIN ("
    + _NATIONS.format("'<nations><nationkey>' || n_nationkey || '</nationkey><name>' || n_name || '</name><like>' || (n_nationkey - 2) || '</like></nations>'", "")
    + ") ON n_regionkey = r_regionkey"
)
def nested_xml_areas(t):
    return areas(t).select("key", AREAS.to_xml().alias("doc"))


@query("SELECT r_regionkey AS key, n_nationkey AS nationkey, n_name AS name FROM region JOIN nation ON n_regionkey = r_regionkey")
def nested_xml_round_trip(t):
    texts = areas(t).select("key", F.concat(F.lit('<?xml version="1.0"?>'), AREAS.to_xml()).alias("raw"))
    back = AREAS.from_xml(texts).select("key", F.explode("doc.nations").alias("n"))
    return back.select("key", F.col("n.nationkey").cast("int").alias("nationkey"), "n.name")


@query("SELECT r_regionkey AS key, n_nationkey AS nationkey, n_name AS name FROM region JOIN nation ON n_regionkey = r_regionkey")
def nested_json_round_trip(t):
    texts = areas(t).select("key", AREAS.to_json().alias("raw"))
    back = AREAS.from_raw(texts).filter("size(errors) = 0").select("key", F.explode("doc.nations").alias("n"))
    return back.select("key", F.col("n.nationkey").cast("int").alias("nationkey"), "n.name")


@query(
    """SELECT n_regionkey AS key, '/nations=' || n_nationkey || '/odd' AS instance_path, 'raw-member' AS error_tag FROM nation WHERE n_nationkey % 3 = 0
UNION ALL SELECT n_regionkey, '/nations=' || n_nationkey || '/name', 'raw-type' FROM nation WHERE n_nationkey % 4 = 0
UNION ALL SELECT r_regionkey, '/extra:notes/@lang/who', 'raw-member' FROM region"""
)
def nested_decode_errors(t):
    name = F.when(F.col("n_nationkey") % 4 == 0, F.lit("7")).otherwise(F.concat(F.lit('"'), F.col("n_name"), F.lit('"')))
    odd = F.when(F.col("n_nationkey") % 3 == 0, F.lit(',"odd":1')).otherwise("")
    one = F.concat(F.lit('{"nationkey":'), F.col("n_nationkey"), F.lit(',"name":'), name, odd, F.lit("}"))
    own = t["nation"].groupBy(F.col("n_regionkey").alias("key")).agg(F.array_join(F.collect_list(one), ",").alias("n"))
    texts = own.select("key", F.concat(F.lit('{"regionkey":1,"nations":['), "n", F.lit('],"extra:notes":{"lang":"de","@lang":{"who":"x"}}}')).alias("raw"))
    return AREAS.from_raw(texts).select("key", F.explode("errors").alias("e")).select("key", "e.instance_path", "e.error_tag")


# nodes and routes


@query("SELECT '/nations/' || x AS schema_path, count(*) AS n FROM nation, (SELECT unnest(['nationkey', 'name', 'like']) AS x) GROUP BY x UNION ALL SELECT '/nations', count(*) FROM nation UNION ALL SELECT x, count(*) FROM region, (SELECT unnest(['/regionkey', '/name', '/extra:notes']) AS x) GROUP BY x UNION ALL SELECT '/extra:notes/tags', 3 * count(*) FROM region WHERE r_regionkey % 2 = 0")
def nested_counts(t):
    return AREAS.counts(areas(t))


@query("SELECT r_regionkey AS key, '/nations[nationkey=''' || n_nationkey || ''']/name' AS path, '/nations/' || (row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1) || '/name' AS pointer, n_name AS value FROM region JOIN nation ON n_regionkey = r_regionkey")
def nested_nodes(t):
    return AREAS.nodes(areas(t)).filter("schema_path = '/nations/name'").select("key", "path", "pointer", "value")


@query("SELECT o_custkey AS key, CAST(arg_min(CAST(o_totalprice AS DECIMAL(38,2)), o_orderkey) AS DECIMAL(38,2)) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey")
def nested_goto_index(t):
    return trees.goto(accounts(t, with_lines=False), ACCOUNT, nav.route_from_instance_id("/orders[1]/total")).select("key", "value")


@query("SELECT n_regionkey AS key, n_name AS value FROM nation WHERE n_nationkey = 7")
def nested_goto_keys(t):
    return AREAS.goto(areas(t), AREAS.parse_resource_id("/nations=7/name")).select("key", "value")


@query("SELECT r_regionkey AS key, CASE WHEN r_regionkey % 2 = 0 THEN 'even' END AS value FROM region")
def nested_peek_value(t):
    return areas(t).select("key", AREAS.peek(AREAS.parse_instance_id("/extra:notes/tags[.='even']")).alias("value"))


@query("SELECT n_regionkey AS key, n_nationkey AS at, lead(n_nationkey) OVER w AS next, lag(n_nationkey) OVER w AS previous FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey) QUALIFY n_nationkey IN (7, 8)")
def nested_next_previous(t):
    out = None
    for n in (7, 8):
        route = [("nations", {"nationkey": str(n)})]
        ctx = AREAS.at()
        one = AREAS.goto(areas(t), route).select("key", F.lit(n).alias("at"), trees.entry_at(ctx, route, 1)["nationkey"].alias("next"), trees.entry_at(ctx, route, -1)["nationkey"].alias("previous"))
        out = one if out is None else out.unionByName(one)
    return out


# edits and merging


@query("SELECT n_regionkey AS key, n_nationkey AS nationkey, CASE WHEN n_nationkey = 7 THEN 'SEVEN' ELSE n_name END AS name FROM nation")
def nested_update(t):
    new = areas(t).select("key", trees.update(AREAS.at(), AREAS.parse_instance_id("/nations[nationkey='7']/name"), lambda v: F.lit("SEVEN")).alias("doc"))
    return new.select("key", F.explode("doc.nations").alias("n")).select("key", "n.nationkey", "n.name")


@query("SELECT n_regionkey AS key, n_nationkey AS nationkey FROM nation WHERE n_nationkey <> 7")
def nested_delete(t):
    new = areas(t).select("key", trees.delete_item(AREAS.at(), AREAS.parse_instance_id("/nations[nationkey='7']")).alias("doc"))
    return new.select("key", F.explode("doc.nations").alias("n")).select("key", "n.nationkey")


@query("SELECT key, row_number() OVER (PARTITION BY key ORDER BY n, side) - 1 AS pos, nationkey FROM (SELECT n_regionkey AS key, n_nationkey AS n, 0 AS side, n_nationkey AS nationkey FROM nation UNION ALL SELECT n_regionkey, n_nationkey, -1, 99 FROM nation WHERE n_nationkey = 7)")
def nested_insert_before(t):
    docs = areas(t)
    entry = F.struct(F.lit(99).alias("nationkey"), F.lit("NEW").alias("name"), F.lit(None).cast("int").alias("like"))
    new = docs.select("key", trees.insert_entry(AREAS.at(), AREAS.parse_instance_id("/nations[nationkey='7']"), entry, after=False).alias("doc"))
    return new.select("key", F.posexplode("doc.nations").alias("pos", "n")).select("key", F.col("pos").cast("long").alias("pos"), "n.nationkey")


@query(
    """SELECT key, row_number() OVER (PARTITION BY key ORDER BY side, nationkey) - 1 AS pos, nationkey, name FROM (
SELECT n_regionkey AS key, 0 AS side, n_nationkey AS nationkey, CASE WHEN n_nationkey < 10 THEN 'MERGED' ELSE n_name END AS name FROM nation
UNION ALL SELECT r_regionkey, 1, 100, 'ADDED' FROM region)"""
)
def nested_merge_areas(t):
    docs = areas(t)
    few = F.filter("doc.nations", lambda n: n.nationkey < 10)
    changed = F.transform(few, lambda n: F.struct(n.nationkey.alias("nationkey"), F.lit("MERGED").alias("name"), F.lit(None).cast("int").alias("like")))
    added = F.array(F.struct(F.lit(100).alias("nationkey"), F.lit("ADDED").alias("name"), F.lit(None).cast("int").alias("like")))
    other = F.struct(F.lit(None).cast("int").alias("regionkey"), F.lit(None).cast("string").alias("name"), F.concat(changed, added).alias("nations"), F.lit(None).cast("struct<lang:string,tags:array<string>>").alias("notes"))
    merged = docs.select("key", trees.merge(REGION, F.col("doc"), other).alias("doc"))
    return merged.select("key", F.posexplode("doc.nations").alias("pos", "n")).select("key", F.col("pos").cast("long").alias("pos"), "n.nationkey", "n.name")


# path expressions

_A = "FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey"


@query(f"SELECT c_custkey AS key, CAST(count(l_orderkey) AS DOUBLE) AS n {_A}")
def path_child_count(t):
    return over(accounts(t), ACCOUNT, n=px.count(here.child("orders").child("lines")))


@query(f"SELECT c_custkey AS key, CAST(1 + 2 + count(DISTINCT o_orderkey) * 5 + count(l_orderkey) * 6 + 1 AS DOUBLE) AS n {_A}")
def path_descendant_count(t):
    return over(accounts(t), ACCOUNT, n=px.count(root().step("descendant-or-self", "*")))


@query(f"SELECT c_custkey AS key, CAST(coalesce(sum(l_linenumber), 0) AS DOUBLE) AS total {_A}")
def path_sum(t):
    return over(accounts(t), ACCOUNT, total=px.sum_(here.descendant("linenumber")))


@query("SELECT c_custkey AS key, coalesce((SELECT arg_min(o_orderstatus, o_orderkey) FROM orders WHERE o_custkey = c_custkey), '') AS first, coalesce((SELECT CAST(arg_max(o_orderkey, o_orderkey) AS VARCHAR) FROM orders WHERE o_custkey = c_custkey), '') AS final FROM customer")
def path_first_and_last(t):
    return over(accounts(t), ACCOUNT, first=px.string(here.child("orders").child("status")), final=px.string(here.child("orders").where(last()).child("orderkey")))


@query("SELECT c_custkey AS key, EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_returnflag = 'R' AND l_quantity > 40) AS hit FROM customer")
def path_predicates(t):
    return over(accounts(t), ACCOUNT, hit=px.boolean(here.child("orders").child("lines", here.child("flag") == "R").where(here.child("quantity") > 40)))


@query("SELECT c_custkey AS key, EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_linenumber = c_custkey % 7) AS hit FROM customer")
def path_current(t):
    return over(accounts(t), ACCOUNT, hit=px.boolean(here.child("orders").child("lines", here.child("linenumber") == current().child("custkey") % 7)))


@query("SELECT r_regionkey AS key, CAST(greatest(count(*) - 2, 0) AS DOUBLE) AS after, CAST(count(*) - 1 AS DOUBLE) AS before FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def path_siblings(t):
    second, final = here.child("nations").where(2), here.child("nations").where(last())
    return over(areas(t), REGION, after=px.count(second.step("following-sibling", "*")), before=px.count(final.step("preceding-sibling", "*")))


@query("SELECT r_regionkey AS key, CAST(count(*) AS DOUBLE) AS parents, CAST(count(*) + 1 AS DOUBLE) AS ancestors, 'area' AS name FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def path_parent_ancestor(t):
    deep = here.child("nations").child("name")
    top = px.Made("string", lambda ctx: F.lit(ctx.nodes[0].name), "top")
    return over(areas(t), REGION, parents=px.count(deep.parent()), ancestors=px.count(deep.ancestor()), name=top)


@query("SELECT r_regionkey AS key, CAST(count(*) FILTER (n_nationkey - 2 IN (SELECT n_nationkey FROM nation b WHERE b.n_regionkey = r_regionkey)) AS DOUBLE) AS met FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def path_deref(t):
    return over(areas(t), REGION, met=px.count(here.child("nations").where(px.deref(here.child("like")))))


@query("SELECT r_regionkey AS key, CAST(2 + count(*) AS DOUBLE) AS n, bool_or(n_name = 'NATION_7') AS has, bool_or(n_name <> 'NATION_7') AS other FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def path_union_compare(t):
    names = here.child("nations").child("name")
    both = here.child("name") | here.child("regionkey") | names | here.child("name")
    return over(areas(t), REGION, n=px.count(both), has=names == "NATION_7", other=names != "NATION_7")


@query("SELECT r_regionkey AS key, max(n_nationkey) > r_regionkey AS above, min(n_nationkey) <= r_regionkey AS below, min(n_nationkey) - 2 < max(n_nationkey) AS sets, -max(n_nationkey + 0.0)::DOUBLE AS neg FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def path_numbers(t):
    keys = here.child("nations").child("nationkey")
    return over(areas(t), REGION, above=keys > px.number(here.child("regionkey")), below=keys <= here.child("regionkey"), sets=here.child("nations").child("like") < keys, neg=-px.number(here.child("nations").where(last()).child("nationkey")))


@query("SELECT r_regionkey AS key, r_name || '-' || r_regionkey AS joined, starts_with(r_name, 'A') AS starts, CAST(length(r_name) AS DOUBLE) AS size, substr(r_name, 2, 3) AS part, regexp_full_match(r_name, '[A-Z ]*') AS capital, 'nations' AS local FROM region")
def path_functions(t):
    name = here.child("name")
    return over(areas(t), REGION, joined=px.concat(name, "-", here.child("regionkey")), starts=px.starts_with(name, "A"), size=px.string_length(name), part=px.substring(name, 2, 3), capital=px.re_match(name, "[A-Z ]*"), local=px.local_name(here.child("nations")))


@query("SELECT conv_id AS key, CAST(count(*) FILTER (turn > 0) AS DOUBLE) AS later, CAST(sum(CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 0 END) FILTER (turn = 0) AS DOUBLE) AS value FROM conversations GROUP BY conv_id")
def path_positions_enum(t):
    return over(talks(t), TALK, later=px.count(here.child("turns").where(position() > 1)), value=px.enum_value(here.child("turns").where(1).child("role")))

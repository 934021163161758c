"""Queries over links and versions of documents: references, identifiers, defaults in conditions, differences, merged trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbora.functions.types import Type
from arbora.operators import editing as ed
from arbora.operators import paths as px
from arbora.operators import trees
from arbora.operators import validation as v
from arbora.operators.paths import here, root
from arbora.plans.model import Must, container, leaf, leaf_list, list_
from arbora.plans.queries_nested import areas
from arbora.plans.registry import query
from arbora.plans.warehouse import REGION

_INT, _TEXT = Type("int32"), Type("string")

#: A document of suppliers and customers of a nation, which name each other by identifiers.
TRADE = container(
    "trade",
    list_("suppliers", "id", leaf("id", _INT), leaf("name", _TEXT)),
    list_(
        "customers",
        "id",
        leaf("id", _INT),
        leaf("rating", _INT, default=3),
        leaf("limit", _INT, must=(Must((here < 1000) | (here.parent().child("rating") > 2), "rated-too-low"),)),
        leaf("contact", Type("instance-identifier")),
        leaf("from", _INT, leafref=("suppliers", "id")),
        leaf_list("aliases", _TEXT),
        unique=(("rating", "aliases"),),
    ),
)


def trades(t):
    """A document for each nation; a fifth of its customers name a supplier that is not there, every third has a rating."""
    suppliers = t["supplier"].select(F.col("s_nationkey").alias("key"), F.struct(F.col("s_suppkey").cast("decimal(38,0)").alias("id"), F.col("s_name").alias("name")).alias("e"))
    own = suppliers.groupBy("key").agg(F.array_sort(F.collect_list("e")).alias("suppliers"), F.min("e.id").alias("first"))
    people = t["customer"].join(own.select(F.col("key").alias("c_nationkey"), "first"), "c_nationkey")
    named = F.when(F.col("c_custkey") % 5 == 0, F.lit(-1)).otherwise(F.col("first")).cast("decimal(38,0)")
    rating = F.when(F.col("c_custkey") % 3 == 0, (F.col("c_custkey") % 4).cast("decimal(38,0)"))
    aliases = F.when(F.col("c_custkey") % 7 == 0, F.array(F.concat(F.lit("a"), (F.col("c_custkey") % 2).cast("string")), F.lit("all")))
    entry = F.struct(
        F.col("c_custkey").cast("decimal(38,0)").alias("id"),
        rating.alias("rating"),
        F.floor("c_acctbal").cast("decimal(38,0)").alias("limit"),
        F.concat(F.lit("/suppliers[id='"), named.cast("string"), F.lit("']/name")).alias("contact"),
        named.alias("from"),
        aliases.alias("aliases"),
    )
    customers = people.groupBy(F.col("c_nationkey").alias("key")).agg(F.array_sort(F.collect_list(entry), lambda a, b: (a["id"] - b["id"]).cast("int")).alias("customers"))
    return own.join(customers, "key").select("key", F.struct("suppliers", "customers").alias("doc"))


_TRADES = """WITH s AS (SELECT s_nationkey AS key, min(s_suppkey) AS first FROM supplier GROUP BY s_nationkey),
c AS (SELECT key, c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 4 END AS rating, CASE WHEN c_custkey % 5 = 0 THEN -1 ELSE first END AS sup, floor(c_acctbal) AS lim FROM customer JOIN s ON c_nationkey = key)"""


@query(f"{_TRADES} SELECT key, '/customers[id=''' || id || ''']/' || leaf AS instance_path FROM c, (SELECT unnest(['contact', 'from']) AS leaf) WHERE sup = -1")
def trade_lost_references(t):
    """Leafrefs and instance identifiers without a target, from one validation."""
    found = trees.validate(trades(t), TRADE).filter("error_tag = 'instance-required'")
    return found.select("key", "instance_path")


@query(f"{_TRADES} SELECT key, CAST(sup AS VARCHAR) AS value, CASE WHEN sup <> -1 THEN '/suppliers[id=''' || sup || ''']/id' END AS target, count(*) AS n FROM c GROUP BY ALL")
def trade_references(t):
    found = trees.references(trades(t), TRADE, "/customers/from")
    return found.groupBy("key", "value", "target").agg(F.count("*").alias("n"))


@query(f"{_TRADES} SELECT key, id, s_name AS name FROM c JOIN supplier ON s_suppkey = sup")
def trade_deref_identifiers(t):
    found = trees.deref_identifiers(trades(t), TRADE, "/customers/contact")
    return found.select("key", F.regexp_extract("path", r"id='(\d+)'", 1).cast("long").alias("id"), F.col("target_value").alias("name"))


@query(f"{_TRADES} SELECT s.key, s_name AS name FROM s JOIN supplier ON s_suppkey = first")
def trade_deref_expression(t):
    """``deref(/customers/from)/../name``: where the first customer's reference leads to, if it does."""
    docs = trades(t)
    sound = docs.withColumn("doc", F.col("doc").withField("customers", F.filter("doc.customers", lambda c: c["from"] >= 0)))
    ctx = px.document(TRADE, F.col("doc"))
    path = px.string(px.deref(root().child("customers").child("from")).parent().child("name"))
    return sound.select("key", px.with_targets(ctx, path.column, entries=True).alias("name"))


@query("SELECT c_custkey AS id, c_nationkey AS key FROM customer WHERE c_custkey % 5 = 0 AND c_nationkey IN (SELECT s_nationkey FROM supplier)")
def trade_lost_between_documents(t):
    """References of all documents, against the suppliers of all documents."""
    docs = trades(t)
    found = trees.lost_references(docs, TRADE, "/customers/from", docs, TRADE, "/suppliers/id")
    return found.select(F.regexp_extract("path", r"id='(\d+)'", 1).cast("long").alias("id"), "key")


@query("SELECT n_nationkey AS key, CAST(n AS BIGINT) AS n FROM (SELECT c_nationkey AS n_nationkey, count(*) AS n FROM customer WHERE c_custkey % 5 = 0 GROUP BY c_nationkey) WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)")
def trade_lost_identifiers(t):
    docs = trades(t)
    suppliers = docs.withColumn("doc", F.col("doc").withField("customers", F.slice("doc.customers", 1, 0)))
    found = trees.lost_identifiers(docs, TRADE, "/customers/contact", suppliers, TRADE)
    # all documents together have every supplier but -1
    return found.groupBy("key").agg(F.count("*").alias("n"))


@query(f"{_TRADES} SELECT key, id FROM c WHERE lim >= 1000 AND coalesce(rating, 3) <= 2")
def trade_must_on_default(t):
    """A ``must`` that looks at a leaf which is mostly its default."""
    found = trees.validate(trades(t), TRADE).filter("error_tag = 'rated-too-low'")
    return found.select("key", F.regexp_extract("instance_path", r"id='(\d+)'", 1).cast("long").alias("id"))


@query(f"{_TRADES} SELECT key, CAST(count(*) AS DOUBLE) AS n, CAST(sum(coalesce(rating, 3)) AS DOUBLE) AS total, CAST(count(*) FILTER (coalesce(rating, 3) = 3) AS DOUBLE) AS threes FROM c GROUP BY key")
def path_defaults_in_use(t):
    """Counts, sums and predicates over a leaf with a default."""
    rating = root().child("customers").child("rating")
    ctx = px.document(TRADE, F.col("doc"))
    parts = {"n": px.count(rating), "total": px.sum_(rating), "threes": px.count(root().child("customers").where(here.child("rating") == 3))}
    return trades(t).select("key", *[e.column(ctx).alias(k) for k, e in parts.items()])


@query(
    f"""{_TRADES}, u AS (SELECT key, id, coalesce(rating, 3) AS r, unnest(['a' || id % 2, 'all']) AS a FROM c WHERE id % 7 = 0)
SELECT key, '/customers[' || r || ' ' || a || ']' AS instance_path FROM u GROUP BY key, r, a HAVING count(*) > 1"""
)
def trade_unique_combinations(t):
    """``unique`` over a defaulted leaf and a leaf-list: combinations that two entries share."""
    found = trees.validate(trades(t), TRADE).filter("error_tag = 'data-not-unique'")
    return found.select("key", "instance_path")


@query("SELECT p_brand AS brand, size, count(*) AS n FROM (SELECT p_brand, CASE WHEN p_size < 10 THEN 1 ELSE p_size END AS size FROM part) GROUP BY ALL HAVING count(*) > 1")
def unique_after_defaults_part(t):
    node = list_("part", "p_partkey", leaf("p_partkey", Type("int64")), leaf("p_brand", _TEXT), leaf("p_size", _INT, default=1), unique=(("p_brand", "p_size"),))
    df = t["part"].select("p_partkey", "p_brand", F.when(F.col("p_size") >= 10, F.col("p_size")).alias("p_size"))
    found = v.not_unique(v.with_unique_defaults(df, node, ["p_brand", "p_size"]), [], ["p_brand", "p_size"], ["p_partkey"])
    return found.select(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), "n")


# versions


def _changed_areas(t):
    """The same documents with some names changed, some nations taken away and one added."""
    change = lambda n: n.withField("name", F.when(n["nationkey"] % 4 == 1, F.concat(n["name"], F.lit("0"))).otherwise(n["name"]))
    kept = F.transform(F.filter("doc.nations", lambda n: n["nationkey"] % 6 != 5), change)
    new = F.transform(F.filter("doc.nations", lambda n: n["nationkey"] % 11 == 3), lambda n: n.withField("nationkey", n["nationkey"] + 100))
    return areas(t).select("key", F.col("doc").withField("nations", F.concat(kept, new)).alias("now"))


@query(
    """SELECT n_regionkey AS key, '/nations[nationkey=''' || n_nationkey || ''']/name' AS path, 'changed' AS change, n_name AS old, n_name || '0' AS new FROM nation WHERE n_nationkey % 4 = 1 AND n_nationkey % 6 <> 5
UNION ALL SELECT n_regionkey, '/nations[nationkey=''' || n_nationkey || ''']', 'removed', NULL, NULL FROM nation WHERE n_nationkey % 6 = 5
UNION ALL SELECT n_regionkey, '/nations[nationkey=''' || (n_nationkey + 100) || ''']', 'added', NULL, NULL FROM nation WHERE n_nationkey % 11 = 3"""
)
def version_differences(t):
    both = areas(t).join(_changed_areas(t), "key")
    found = both.select("key", trees.differences(REGION, F.col("doc"), F.col("now")).alias("d"))
    return found.select("key", F.inline("d")).select("key", "path", "change", "old", "new")


@query(
    """WITH n AS (SELECT n_regionkey AS key, n_nationkey AS k, n_nationkey % 4 = 1 AS c FROM nation WHERE n_nationkey % 6 <> 5)
SELECT key, '/nations[nationkey=''' || k || ''']/' || leaf AS path, c AND leaf = 'name' AS changed FROM n, (SELECT unnest(['nationkey', 'name', 'like']) AS leaf)
UNION ALL SELECT n_regionkey, '/nations[nationkey=''' || (n_nationkey + 100) || ''']/' || leaf, TRUE FROM nation, (SELECT unnest(['nationkey', 'name', 'like']) AS leaf) WHERE n_nationkey % 11 = 3"""
)
def version_times(t):
    """When each leaf of an entry changed last: at the first version, or at the second."""
    one, two = (F.lit(f"2024-0{m}-01 00:00:00").cast("timestamp") for m in (1, 2))
    first = areas(t).select("key", trees.node_times(px.document(REGION, F.col("doc")), F.lit(None), one).alias("times"))
    both = first.join(_changed_areas(t), "key").select("key", trees.node_times(px.document(REGION, F.col("now")), F.col("times"), two).alias("times"))
    leaves = both.select("key", F.inline("times")).filter("path LIKE '/nations[%]/%'")
    return leaves.select("key", "path", (F.col("changed_at") == two).alias("changed"))


@query("SELECT count(DISTINCT c_name || '/' || c_mktsegment) AS n FROM customer")
def etags_tell_rows_apart(t):
    """Names and segments around separators: every pair of values has a hash of its own."""
    odd = t["customer"].select(F.concat("c_name", F.lit("\x1f")).alias("a"), F.concat(F.lit("\x1f"), "c_mktsegment").alias("b"))
    return odd.select(ed.etag(["a", "b"]).alias("e")).agg(F.count_distinct("e").alias("n"))


# merged trees


def _merged_tree(t, name):
    people = t["customer"].select(F.col("c_custkey").alias("custkey"), F.col("c_name").alias("name"), F.col("c_custkey").alias("place"))
    orders = t["orders"].select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("place"))
    lines = t["lineitem"].filter("l_linenumber = 1").groupBy(F.col("l_orderkey").alias("orderkey")).agg(F.max(F.col("l_quantity").cast("double")).alias("quantity"))
    lines = orders.select("custkey", "orderkey").join(lines, "orderkey").select("custkey", "orderkey", F.lit(1).alias("linenumber"), "quantity", F.lit(0).cast("long").alias("place"))
    gone = people.filter("custkey % 10 = 3").select("custkey", F.lit(None).cast("string").alias("name"), F.lit(0).cast("long").alias("place"), F.array().cast("array<string>").alias("_set"), F.lit(True).alias("_deleted"))
    added = people.filter("custkey % 10 = 4").select((F.col("custkey") + 1_000_000).alias("custkey"), F.lit("new").alias("name"), (-F.col("custkey")).alias("place"), F.array(F.lit("name")).alias("_set"), F.lit(False).alias("_deleted"))
    blank = orders.filter("orderkey % 7 = 2").select("custkey", "orderkey", F.lit(None).cast("string").alias("status"), "place", F.array(F.lit("status")).alias("_set"))
    fresh = orders.filter("orderkey % 9 = 5").select("custkey", (-F.col("orderkey")).alias("orderkey"), F.lit("N").alias("status"), "place", F.array(F.lit("status")).alias("_set"))
    more = lines.filter("orderkey % 4 = 1").select("custkey", "orderkey", F.lit(2).alias("linenumber"), F.lit(1.0).alias("quantity"), F.lit(5).cast("long").alias("place"))
    lists = [ed.ListTable("customer", ("custkey",)), ed.ListTable("orders", ("custkey", "orderkey"), 1), ed.ListTable("lineitem", ("custkey", "orderkey", "linenumber"), 2)]
    return ed.merge_tree({"customer": people, "orders": orders, "lineitem": lines}, {"customer": gone.unionByName(added), "orders": blank.unionByName(fresh), "lineitem": more}, lists, wanted=[name])[name]


_KEPT = "o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 3)"


@query("SELECT c_custkey AS custkey, c_name AS name, c_custkey AS place FROM customer WHERE c_custkey % 10 <> 3 UNION ALL SELECT c_custkey + 1000000, 'new', (SELECT max(c_custkey) + 1 FROM customer) + row_number() OVER (ORDER BY c_custkey DESC) - 1 FROM customer WHERE c_custkey % 10 = 4")
def merge_tree_customers(t):
    return _merged_tree(t, "customer")


@query(
    f"""SELECT o_custkey AS custkey, o_orderkey AS orderkey, CASE WHEN o_orderkey % 7 <> 2 THEN o_orderstatus END AS status, o_orderkey AS place FROM orders WHERE {_KEPT}
UNION ALL SELECT o_custkey, -o_orderkey, 'N', (SELECT max(o_orderkey) + 1 FROM orders b WHERE b.o_custkey = a.o_custkey) + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 FROM orders a WHERE o_orderkey % 9 = 5 AND {_KEPT}"""
)
def merge_tree_orders(t):
    return _merged_tree(t, "orders")


@query(
    f"""WITH l AS (SELECT o_custkey, l_orderkey, max(CAST(l_quantity AS DOUBLE)) AS q FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber = 1 AND {_KEPT} GROUP BY ALL)
SELECT o_custkey AS custkey, l_orderkey AS orderkey, 1 AS linenumber, q AS quantity, 0 AS place FROM l UNION ALL SELECT o_custkey, l_orderkey, 2, 1.0, 1 FROM l WHERE l_orderkey % 4 = 1"""
)
def merge_tree_lines(t):
    return _merged_tree(t, "lineitem")

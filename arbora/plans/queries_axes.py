"""Queries over the node table of customers, their orders and the lines of these."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbora.operators import navigation as nav
from arbora.operators import nodetable as nt
from arbora.plans.registry import query
from arbora.plans.warehouse import WAREHOUSE


def customer_tree(t):
    """Numbered nodes of ``customer > orders > lineitem``; entries without a parent are not in the tree."""
    people = t["customer"].select("c_custkey", "c_name", "c_acctbal")
    orders = t["orders"].select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    orders = nav.parents(people, orders, [("o_custkey", "c_custkey")])
    lines = t["lineitem"].select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    lines = orders.select("o_custkey", "o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    level = lambda df, keys, name: nt.Level(df, keys, WAREHOUSE.data_child(name))
    return nt.number_nodes(
        [
            level(people, ("c_custkey",), "customer"),
            level(orders, ("o_custkey", "o_orderkey"), "orders"),
            level(lines, ("o_custkey", "o_orderkey", "l_linenumber"), "lineitem"),
        ]
    )


_TREE = """WITH o AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)), l AS (SELECT * FROM lineitem JOIN o ON l_orderkey = o_orderkey)"""


@query(
    f"""{_TREE}, ls AS (SELECT o_custkey AS k, o_orderkey AS k1, l_linenumber AS k2, 5 AS n, 1 + (l_orderkey IS NOT NULL)::INT + 3 AS w FROM l),
os AS (SELECT o.o_custkey AS k, o.o_orderkey AS k1, 5 + coalesce(sum(w), 0) AS w FROM o LEFT JOIN ls ON ls.k1 = o.o_orderkey GROUP BY o.o_custkey, o.o_orderkey),
cs AS (SELECT c_custkey AS k, 4 + coalesce(sum(w), 0) AS w FROM customer LEFT JOIN os ON os.k = c_custkey GROUP BY c_custkey)
SELECT k AS custkey, CAST(coalesce(sum(w) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pre, CAST(sum(w) OVER (ORDER BY k) - 1 AS BIGINT) AS last FROM cs"""
)
def node_numbers(t):
    return nt.named(customer_tree(t), "customer").select(F.col("k0").alias("custkey"), "pre", "last")


@query(f"{_TREE} SELECT o_custkey AS custkey, o_orderkey AS orderkey, l_linenumber AS linenumber, CAST(l_quantity AS DOUBLE) AS quantity FROM l JOIN customer ON o_custkey = c_custkey WHERE CAST(c_acctbal AS DECIMAL(38,2)) < 0")
def axis_descendant_tables(t):
    """``//l_quantity`` below the customers in debt."""
    tree = customer_tree(t)
    debtors = nt.parents(nt.named(tree, "c_acctbal").filter(F.col("value").cast("double") < 0), tree, "customer")
    found = nt.descendants(debtors, tree, "l_quantity")
    return found.select(F.col("k0").alias("custkey"), F.col("k1").alias("orderkey"), F.col("k2").alias("linenumber"), F.col("value").cast("double").alias("quantity"))


@query(f"{_TREE} SELECT DISTINCT o_custkey AS custkey, NULL AS orderkey, 'customer' AS name FROM l WHERE CAST(l_quantity AS DOUBLE) >= 49 UNION ALL SELECT DISTINCT o_custkey, o_orderkey, 'orders' FROM l WHERE CAST(l_quantity AS DOUBLE) >= 49")
def axis_ancestor_tables(t):
    """``ancestor::customer | ancestor::orders`` of large quantities, each once."""
    tree = customer_tree(t)
    large = nt.named(tree, "l_quantity").filter(F.col("value").cast("double") >= 49)
    found = nt.ancestors(large, tree).filter("name <> 'lineitem'")
    return found.select(F.col("k0").alias("custkey"), F.col("k1").alias("orderkey"), "name")


@query(f"{_TREE} SELECT o.o_custkey AS custkey, o.o_orderkey AS orderkey, count(l_orderkey) AS n FROM o LEFT JOIN l ON l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R' GROUP BY ALL")
def axis_count_below(t):
    """``count(.//l_returnflag[. = 'R'])`` at each order."""
    tree = customer_tree(t)
    found = nt.count_below(nt.named(tree, "orders"), nt.named(tree, "l_returnflag").filter("value = 'R'"))
    return found.select(F.col("k0").alias("custkey"), F.col("k1").alias("orderkey"), "n")

"""XPath functions, node-set comparison and aggregation over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbora.functions import xpath as xp
from arbora.operators import navigation as nav
from arbora.operators import paths as px
from arbora.plans.queries_nested import over, talks
from arbora.plans.registry import query
from arbora.plans.warehouse import TALK


_OF_ORDER = [("o_orderkey", "l_orderkey")]


@query("SELECT o_orderkey, CAST(count(l_orderkey) AS DOUBLE) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def xpath_count_children(t):
    own = nav.child_values(t["orders"], t["lineitem"], _OF_ORDER, n=F.count("*"))
    return own.select("o_orderkey", F.coalesce("n", F.lit(0)).cast("double").alias("n"))


@query("SELECT l_orderkey, sum(CAST(l_quantity AS DECIMAL(18,2)))::DECIMAL(38,2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey")
def xpath_sum_children(t):
    own = nav.child_values(t["orders"], t["lineitem"], _OF_ORDER, total=F.sum(F.col("l_quantity").cast("decimal(18,2)")))
    return own.filter("total IS NOT NULL").select(F.col("o_orderkey").alias("l_orderkey"), F.col("total").cast("decimal(38,2)").alias("total"))


@query("SELECT conv_id AS key, coalesce(arg_min(role, turn), '') AS first_role FROM conversations GROUP BY conv_id")
def xpath_first_string(t):
    return over(talks(t), TALK, first_role=px.string(px.here.child("turns").child("role")))


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)")
def xpath_exists_compare(t):
    return nav.where_exists(t["orders"], t["lineitem"], _OF_ORDER, F.col("l_quantity") > 49).select("o_orderkey")


@query("SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING bool_or(l_returnflag <> 'N')")
def xpath_notequal_exists(t):
    sets = t["lineitem"].groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("flags"))
    return sets.filter(xp.any_unequal(F.col("flags"), F.lit("N"))).select("l_orderkey")


@query("SELECT c_nationkey FROM (SELECT c_nationkey, min(c_acctbal) AS a FROM customer GROUP BY 1) JOIN (SELECT s_nationkey, max(s_acctbal) AS b FROM supplier GROUP BY 1) ON c_nationkey = s_nationkey WHERE a < b")
def xpath_set_lt_set(t):
    return nav.any_pair(t["customer"], t["supplier"], [("c_nationkey", "s_nationkey")], "c_acctbal", "<", "s_acctbal")


@query("SELECT DISTINCT c_nationkey FROM customer WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_suppkey = c_custkey)")
def xpath_set_eq_set(t):
    return nav.any_pair(t["customer"], t["supplier"], [("c_nationkey", "s_nationkey")], "c_custkey", "=", "s_suppkey")


@query("SELECT DISTINCT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def xpath_union_nodes(t):
    return nav.union(t["customer"].select(F.col("c_nationkey").alias("nation")), t["supplier"].select(F.col("s_nationkey").alias("nation")))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 5) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def xpath_correlated_predicate(t):
    own = nav.where_exists(t["orders"], t["customer"], [("o_custkey", "c_custkey")], F.col("c_nationkey") == 5)
    return nav.where_exists(own, t["lineitem"], _OF_ORDER, F.col("l_returnflag") == "R", negate=True).select("o_orderkey")


_STRINGS = {
    "concat": (lambda c: xp.concat(c, F.lit("/"), c), "p_name || '/' || p_name"),
    "contains": (lambda c: xp.string_of_boolean(xp.contains(c, F.lit("ed"))), "CASE WHEN contains(p_name, 'ed') THEN 'true' ELSE 'false' END"),
    "starts_with": (lambda c: xp.string_of_boolean(xp.starts_with(c, F.lit("s"))), "CASE WHEN starts_with(p_name, 's') THEN 'true' ELSE 'false' END"),
    "substring": (lambda c: xp.substring(c, F.lit(1.5), F.lit(2.6)), "substr(p_name, 2, 3)"),
    "substring_before": (lambda c: xp.substring_before(c, F.lit(" ")), "CASE WHEN strpos(p_name, ' ') > 0 THEN left(p_name, strpos(p_name, ' ') - 1) ELSE '' END"),
    "substring_after": (lambda c: xp.substring_after(c, F.lit("e")), "CASE WHEN strpos(p_name, 'e') > 0 THEN substr(p_name, strpos(p_name, 'e') + 1) ELSE '' END"),
    "translate": (lambda c: xp.translate(c, "aeiou ", "AEIOU"), "translate(p_name, 'aeiou ', 'AEIOU')"),
    "normalize_space": (lambda c: xp.normalize_space(F.concat(F.lit("  "), c, F.lit(" \t x "))), "p_name || ' x'"),
    "re_match": (lambda c: xp.string_of_boolean(xp.re_match(c, r"[a-m]+ \c*")), "CASE WHEN regexp_full_match(p_name, '[a-m]+ [a-z]*') THEN 'true' ELSE 'false' END"),
    "string_length": (lambda c: xp.string_of_number(xp.string_length(c)), "length(p_name)::VARCHAR"),
}
for _name, (_use, _sql) in _STRINGS.items():
    query(f"SELECT p_partkey, {_sql} AS s FROM part", f"xpath_str_{_name}")(lambda t, use=_use: t["part"].select("p_partkey", use(F.col("p_name")).alias("s")))

_D = "CAST(l_linenumber AS DOUBLE)"
_NUMBERS = {
    "floor": (lambda q, n: xp.floor(q / 4), "floor(l_quantity / 4)"),
    "ceiling": (lambda q, n: xp.ceiling(q / 4), "ceil(l_quantity / 4)"),
    "round": (lambda q, n: xp.round_(-q / 2), "floor(-l_quantity / 2 + 0.5)"),
    "add": (lambda q, n: q + n, f"l_quantity + {_D}"),
    "subtract": (lambda q, n: n - q, f"{_D} - l_quantity"),
    "multiply": (lambda q, n: q * n, f"l_quantity * {_D}"),
    "divide": (lambda q, n: xp.divide(q, n), f"l_quantity / {_D}"),
    "modulo": (lambda q, n: xp.modulo(-q, n + 1), f"-fmod(l_quantity, {_D} + 1)"),
}
for _name, (_use, _sql) in _NUMBERS.items():
    query(f"SELECT l_orderkey, l_linenumber, l_partkey, {_sql} + 0.0 AS x FROM lineitem", f"xpath_num_{_name}")(
        lambda t, use=_use: t["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", (use(F.col("l_quantity"), F.col("l_linenumber").cast("double")) + 0.0).alias("x"))
    )


@query("SELECT p_partkey, CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR) ELSE rtrim(CAST(CAST(p_retailprice AS DECIMAL(38,2)) AS VARCHAR), '0') END AS s FROM part")
def xpath_string_of_number(t):
    return t["part"].select("p_partkey", xp.string_of_number(F.round("p_retailprice", 2)).alias("s"))


@query("SELECT n_nationkey, CAST(substr(n_name, 8) AS DOUBLE) AS x FROM nation")
def xpath_number_of_string(t):
    return t["nation"].select("n_nationkey", xp.number_of_string(F.substr("n_name", F.lit(8))).alias("x"))


@query("SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS is_set FROM lineitem")
def bit_is_set(t):
    return t["lineitem"].select("l_orderkey", "l_linenumber", xp.bit_is_set(F.array("l_returnflag", "l_linestatus"), "R").alias("is_set"))


@query("SELECT c_custkey, c_acctbal > 0 AND c_nationkey < 5 OR c_mktsegment = 'BUILDING' AS ok FROM customer")
def xpath_and_or(t):
    return t["customer"].select("c_custkey", xp.or_(xp.and_(F.col("c_acctbal") > 0, F.col("c_nationkey") < 5), F.col("c_mktsegment") == "BUILDING").alias("ok"))

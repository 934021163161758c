"""Queries over values that are easily changed or confused: blanks, CDATA, separators, NULLs, letters beyond ASCII."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbora.functions import xpath as xp
from arbora.functions.types import Type
from arbora.operators import editing as ed
from arbora.operators import paths as px
from arbora.operators.paths import root
from arbora.plans.data_model import DataModel
from arbora.plans.model import container, leaf, leaf_list
from arbora.plans.registry import query
from arbora.plans.warehouse import WAREHOUSE

_TEXT = Type("string")

#: Two modules with elements of one name.
GOODS = DataModel(
    container(
        "goods",
        leaf("name", _TEXT, ns="shop"),
        container("item", leaf("name", _TEXT, ns="shop"), leaf("brand", _TEXT, ns="maker"), leaf_list("size", _TEXT, ns="shop"), ns="maker"),
        leaf("kind", Type("identityref", identities=("shop:ware", "maker:part")), ns="shop"),
    ),
    urns=(("shop", "urn:shop"), ("maker", "urn:maker")),
)


@query("SELECT p_partkey AS key, '  ' || p_name || ' ' AS name, '<m:brand>' || p_brand || ' & ' AS brand, CAST(p_size AS VARCHAR) || chr(10) AS size, CASE WHEN p_partkey % 2 = 0 THEN 'maker:part' ELSE 'shop:ware' END AS kind, CAST(p_partkey % 3 = 0 AS INT) AS errors FROM part")
def xml_awkward_part(t):
    """Blanks, CDATA, equal local names in two namespaces, a prefix that two elements declare differently."""
    p = t["part"]
    odd = F.when(F.col("p_partkey") % 3 == 0, F.lit("<name xmlns='urn:other'>no</name>")).otherwise("")
    kind = F.when(F.col("p_partkey") % 2 == 0, F.lit("<kind xmlns='urn:shop' xmlns:k='urn:maker'>k:part</kind>")).otherwise(F.lit("<kind xmlns='urn:shop' xmlns:k='urn:shop'>k:ware</kind>"))
    brand = F.concat(F.lit("<m:brand><![CDATA[<m:brand>"), "p_brand", F.lit("]]> &amp; </m:brand>"))
    raw = F.concat(F.lit("<g xmlns='urn:shop' xmlns:m='urn:maker'>"), odd, F.lit("<m:item><name>  "), "p_name", F.lit(" </name>"), brand, F.lit("<size>"), "p_size", F.lit("\n</size></m:item>"), kind, F.lit("</g>"))
    got = GOODS.from_xml(p.select(F.col("p_partkey").alias("key"), raw.alias("raw")))
    inner = lambda name: F.col("doc").getField("item").getField(name)
    return got.select("key", inner("name").alias("name"), inner("brand").alias("brand"), F.get(inner("size"), F.lit(0)).alias("size"), "doc.kind", F.size("errors").alias("errors"))


@query("SELECT p_partkey AS key, NOT (p_partkey % 4 = 0 AND p_size = 5) AS unequal, p_partkey % 4 = 0 AND p_size = 5 AS equal, p_partkey % 4 = 0 AND p_size < 5 AS less FROM part")
def unequal_numbers_part(t):
    """Comparisons of a text with a number: what is no number differs from every number and is less than none."""
    text = F.when(F.col("p_partkey") % 4 == 0, F.col("p_size").cast("string")).otherwise(F.concat("p_size", F.lit("x")))
    model = container("t", leaf_list("l", _TEXT))
    df = t["part"].select(F.col("p_partkey").alias("key"), F.struct(F.array(text).alias("l")).alias("doc"))
    ctx, lst = px.document(model, F.col("doc")), root().child("l")
    return df.select("key", (lst != 5).column(ctx).alias("unequal"), (lst == 5).column(ctx).alias("equal"), (lst < 5).column(ctx).alias("less"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS c_name, CASE WHEN c_custkey % 3 = 1 THEN 'none' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 10 <> 9")
def merge_null_customer(t):
    """Members set to NULL, members left alone though NULL is given, entries deleted."""
    df = t["customer"].select("c_custkey", "c_name", "c_mktsegment")
    third = F.col("c_custkey") % 3
    changes = df.filter("c_custkey % 3 < 2 OR c_custkey % 10 = 9").select(
        "c_custkey",
        F.lit(None).cast("string").alias("c_name"),
        F.when(third == 1, "none").alias("c_mktsegment"),
        F.when(third == 0, F.array(F.lit("c_name"))).when(third == 1, F.array(F.lit("c_mktsegment"))).alias("_set"),
        (F.col("c_custkey") % 10 == 9).alias("_deleted"),
    )
    return ed.merge(df, changes, ["c_custkey"])


@query("SELECT c_custkey AS key, '{\"c_custkey\":\"' || c_custkey || '\"' || CASE WHEN c_acctbal > 0 THEN ',\"c_name\":\"' || c_name || '\"' ELSE '' END || '}' AS raw FROM customer")
def encode_filtered_customer(t):
    keep = lambda name: name == "c_custkey" or (F.col("c_acctbal") > 0 if name == "c_name" else False)
    df = t["customer"]
    return df.select(F.col("c_custkey").alias("key"), ed.encode_json(df, WAREHOUSE.data_child("customer"), keep).alias("raw"))


@query("SELECT p_partkey AS key, TRUE AS name, p_partkey % 2 = 0 AS latin, p_partkey % 2 = 1 AS other, p_partkey % 3 = 0 AS no_start FROM part")
def xsd_classes_part(t):
    r"""``\c``, ``\I`` and blocks of Unicode in patterns."""
    first = F.when(F.col("p_partkey") % 3 == 0, F.lit("1")).otherwise("a")
    text = F.concat(first, F.when(F.col("p_partkey") % 2 == 0, F.lit("e-f")).otherwise("é-œ"))
    s = t["part"].select(F.col("p_partkey").alias("key"), text.alias("s"))
    return s.select("key", xp.re_match(F.col("s"), r"\c+").alias("name"), xp.re_match(F.col("s"), r"\p{IsBasicLatin}*").alias("latin"), xp.re_match(F.col("s"), r".*[\P{IsBasicLatin}]").alias("other"), xp.re_match(F.col("s"), r"\I\c*").alias("no_start"))

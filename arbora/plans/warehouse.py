"""The given tables as a data model: each table is one top-level list."""

from __future__ import annotations

from arbora.functions.types import Type, bits, closure, enums
from arbora.operators.paths import here
from arbora.plans.model import Must, Node, case, choice, container, leaf, leaf_list, list_

#: Fixed values of the tables.
PRIORITIES = enums("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
STATUSES = enums("F", "O", "P")
FLAGS = bits("A", "N", "R", "F", "O")
KINDS = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
PART_IDENTITIES = {"part-kind": [], "sized": ["part-kind"], "traded": ["part-kind"], **{k: ["sized" if k in ("LARGE", "MEDIUM", "SMALL") else "traded"] for k in KINDS}}
CLOSURE = closure(PART_IDENTITIES)

_key = Type("int64")
_small = Type("int32")
_text = Type("string")
_money = Type("decimal64", digits=2)

WAREHOUSE = container(
    "warehouse",
    list_("region", "r_regionkey", leaf("r_regionkey", _small), leaf("r_name", Type("string", ranges=((1, 25),)), mandatory=True)),
    list_(
        "nation",
        "n_nationkey",
        leaf("n_nationkey", _small),
        leaf("n_name", Type("string", patterns=("NATION_[0-9]+",))),
        leaf("n_regionkey", _small, leafref=("region", "r_regionkey")),
        unique=(("n_name",),),
    ),
    list_("supplier", "s_suppkey", leaf("s_suppkey", _key), leaf("s_name", _text), leaf("s_nationkey", _small, leafref=("nation", "n_nationkey")), leaf("s_acctbal", _money)),
    list_(
        "customer",
        "c_custkey",
        leaf("c_custkey", _key),
        leaf("c_name", _text),
        leaf("c_nationkey", _small, leafref=("nation", "n_nationkey")),
        leaf("c_acctbal", Type("decimal64", digits=2, ranges=((0, None),))),
        leaf("c_mktsegment", _text),
        unique=(("c_name",),),
    ),
    list_("part", "p_partkey", leaf("p_partkey", _key), leaf("p_name", _text), leaf("p_brand", Type("string", patterns=("Brand#[0-9]+",))), leaf("p_type", _text), leaf("p_size", Type("int32", ranges=((1, 40),))), leaf("p_retailprice", _money)),
    list_(
        "orders",
        "o_orderkey",
        leaf("o_orderkey", _key),
        leaf("o_custkey", _key, leafref=("customer", "c_custkey")),
        leaf("o_orderstatus", Type("enumeration", enums=STATUSES)),
        leaf("o_orderpriority", Type("enumeration", enums=PRIORITIES)),
        leaf("o_totalprice", _money, must=(Must("o_orderstatus <> 'F' OR o_totalprice > 20000", "cheap-final"),)),
    ),
    list_(
        "lineitem",
        "l_orderkey l_linenumber",
        leaf("l_orderkey", _key, leafref=("orders", "o_orderkey")),
        leaf("l_partkey", _key, leafref=("part", "p_partkey")),
        leaf("l_suppkey", _key, leafref=("supplier", "s_suppkey")),
        leaf("l_linenumber", _small),
        leaf("l_quantity", Type("decimal64", digits=2, ranges=((1, 45),))),
        leaf("l_discount", _money, when="l_quantity > 2"),
        leaf("l_tax", _money, must=(Must("l_tax <= l_discount + 0.05", "tax-too-high"),)),
        leaf("l_returnflag", Type("enumeration", enums=enums("A", "N", "R"))),
    ),
)

#: Events as notifications, with a choice among members of their JSON properties.
EVENT: Node = list_(
    "events",
    "event_id",
    leaf("event_id", _key),
    leaf("event_type", Type("enumeration", enums=enums("click", "view", "purchase", "signup"))),
    leaf("value", _money, when="event_type IN ('purchase', 'click')", default=0),
)
PROPS: Node = container(
    "props",
    choice("kind", case("counted", leaf("k", Type("uint8", ranges=((0, 90),)), mandatory=True), leaf("unit", _text, default="piece")), case("named", leaf("name", _text)), default="counted"),
    leaf_list("tags", Type("string", ranges=((1, 8),)), max_elements=3),
)

# nested documents over the tables: one account with its orders and their lines, one region with its nations, one
# conversation with its turns

ACCOUNT = container(
    "account",
    leaf("custkey", _key, mandatory=True),
    leaf("name", _text),
    leaf("balance", Type("decimal64", digits=2)),
    list_(
        "orders",
        "orderkey",
        leaf("orderkey", _key),
        leaf("status", Type("enumeration", enums=STATUSES), mandatory=True),
        leaf("priority", Type("enumeration", enums=PRIORITIES), default="4-NOT SPECIFIED", when=here.parent().child("status") != "O"),
        leaf("total", _money, must=(Must((here.parent().child("status") != "F") | (here > 20000), "cheap-final"),)),
        list_(
            "lines",
            "linenumber",
            leaf("linenumber", _small),
            leaf("quantity", Type("decimal64", digits=2, ranges=((1, 45),))),
            leaf("discount", _money, when=here.parent().child("quantity") > 2),
            leaf("tax", _money, must=(Must(here <= here.parent().child("discount") + 0.05, "tax-too-high"),)),
            leaf("flag", Type("enumeration", enums=enums("A", "N", "R"))),
            min_elements=2,
            max_elements=6,
        ),
    ),
)
REGION = container(
    "area",
    leaf("regionkey", _small, mandatory=True),
    leaf("name", _text),
    list_("nations", "nationkey", leaf("nationkey", _small), leaf("name", Type("string", patterns=("NATION_[0-9]+",))), leaf("like", _small, leafref=("nations", "nationkey"))),
    container("notes", leaf("lang", _text, default="en"), leaf_list("tags", Type("string", ranges=((1, 8),)), max_elements=2), ns="extra"),
)
TALK = container(
    "talk",
    leaf("id", _key, mandatory=True),
    list_("turns", "turn", leaf("turn", _key), leaf("role", Type("enumeration", enums=enums("system", "user", "assistant"))), unique=(("role",),), max_elements=7),
    choice("length", leaf("short", Type("boolean")), leaf("long", Type("boolean"))),
)

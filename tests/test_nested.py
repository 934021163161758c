"""Path expressions and nested documents on small fixtures."""

import json
import math

import pytest
from pyspark.sql import functions as F

from arbora.functions import types as ty
from arbora.functions import xpath as xp
from arbora.functions.types import Type
from arbora.operators import navigation as nav
from arbora.operators import paths as px
from arbora.operators import trees as tr
from arbora.operators import validation as v
from arbora.operators.paths import current, here, last, position, root
from arbora.plans import model as m
from arbora.plans.data_model import DataModel

INT, TEXT = Type("int32"), Type("string")
COLOURS = {"colour": [], "red": ["colour"], "crimson": ["red"]}
SHOP = m.container(
    "top",
    m.leaf("name", TEXT, default="nobody"),
    m.list_(
        "a",
        "id",
        m.leaf("id", INT),
        m.leaf("w", Type("decimal64", digits=2, ranges=((0, 5),))),
        m.leaf_list("tag", TEXT, max_elements=2),
        m.leaf("deep", INT, when=here.parent().child("w") > 1, default=4),
        m.list_("b", "k", m.leaf("k", TEXT), m.leaf("ref", INT, leafref=("a", "id"), mandatory=True), unique=(("ref",),)),
        min_elements=1,
        must=(m.Must(here.child("id") != 13, "unlucky"),),
    ),
    m.container(
        "c",
        m.leaf("x", INT, mandatory=True),
        m.leaf("y", INT, default=9),
        m.choice("ch", m.leaf("p", TEXT), m.case("q", m.leaf("q1", INT, default=1), m.leaf("q2", INT)), default="q"),
        m.leaf("hue", Type("identityref", identities=("red", "crimson"))),
        m.leaf("flags", Type("bits", bits=ty.bits("u", "v"))),
        m.leaf("level", Type("enumeration", enums=ty.enums("low", ("high", 7)))),
    ),
    m.container("pc", m.leaf("z", INT, mandatory=True), presence=True, ns="other"),
)
FIRST = {
    "name": "n",
    "a": [
        {"id": 1, "w": 1.50, "tag": ["p", "q"], "b": [{"k": "k'1", "ref": 2}, {"k": "k2", "ref": 9}]},
        {"id": 2, "w": 7.00, "tag": ["x", "x", "x"], "b": [{"k": "k3", "ref": 1}, {"k": "k3", "ref": 1}, {"k": "k4"}]},
        {"id": 13, "deep": 3},
        {"id": 13},
    ],
    "c": {"p": "1", "q2": 3, "hue": "crimson", "flags": ["v"], "level": "high"},
}
DOCS = [json.dumps(FIRST), '{"c":{"x":1},"pc":{}}', "{}", None]
CTX = lambda: px.document(SHOP, F.col("doc"))


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(list(enumerate(DOCS)), "i int, j string")
    return rows.select("i", F.from_json("j", SHOP.struct_type()).alias("doc")).cache()


def values(docs, *expressions):
    row = docs.filter("i = 0").select(*[px.expr(e).column(CTX()).alias(f"e{k}") for k, e in enumerate(expressions)]).first()
    return list(row)


def as_json(docs, column, i=0):
    text = docs.filter(f"i = {i}").select(tr.to_json(px.document(SHOP, column))).first()[0]
    return None if text is None else json.loads(text)


def test_steps_and_axes(docs):
    a = root().child("a")
    got = values(
        docs,
        a.child("id"),
        a.where(2).child("w"),
        a.where(last() - 1).child("id"),
        a.child("b", 1).child("k"),
        a.child("b", 1, each=True).child("k"),
        a.where(position() > 2).child("id"),
        px.count(a.where(1).step("following-sibling", "*")),
        a.where(3).step("preceding-sibling", None).child("id"),
        px.count(here.descendant("k").ancestor()),
        px.count(here.step("descendant-or-self", "*")),
        a.child("b").parent().child("id"),
        here.descendant("b").then(here.parent().child("id")),
        px.count(here.child("c").step("self", "c")),
        px.count(here.child("c").step("self", "nope")),
        px.name(here.child("pc")),
        px.local_name(here.descendant("b").parent()),
        px.name(here),
    )
    assert got[:6] == [["1", "2", "13", "13"], ["7.0"], ["13"], ["k'1"], ["k'1", "k3"], ["13", "13"]]
    # 38 nodes that are there, and the defaults in use: a[1]/deep, a[2]/deep, c/y, c/q1
    assert got[6:] == [3.0, ["1", "2"], 8.0, 42.0, ["1", "2"], ["1", "2"], 1.0, 0.0, "", "a", ""]
    for axis in ("attribute", "following", "namespace", "preceding"):
        with pytest.raises(px.NotSupported):
            values(docs, here.step(axis))
    for function in (px.id_, px.lang, px.namespace_uri):
        with pytest.raises(px.NotSupported):
            function()
    with pytest.raises(px.XPathTypeError):
        px.count("foo")
    with pytest.raises(px.XPathTypeError):
        px.sum_(42)


def test_comparisons(docs):
    ids, tags = root().child("a").child("id"), root().child("a").child("tag")
    c = here.child("c")
    got = values(
        docs,
        tags == "x",
        tags != "x",
        px.not_(tags == "x"),
        here.child("a").child("w").where(here > 100) == 1,
        here.child("a").child("w").where(here > 100) != 1,
        ids > 12,
        ids > 13,
        ids <= 1,
        ids == here.descendant("ref"),
        c.child("q2") < ids,
        px.expr(13) == ids,
        px.expr("1") == 1,
        c.child("p") == 1,
        c.child("x") != 5,
        px.true() & px.false() | (px.expr(1) == True),  # noqa: E712
        px.expr(float("nan")) == float("nan"),
        px.expr(float("nan")) != float("nan"),
        here.child("a") == "1",
    )
    assert got == [True, True, False, False, False, True, False, True, True, True, True, True, True, False, True, False, True, False]


def test_functions_and_references(docs):
    c = here.child("c")
    up = ty.closure(COLOURS)
    got = values(
        docs,
        px.sum_(root().child("a").child("id")),
        px.sum_(here.descendant("w")),
        px.sum_(here.descendant("k")),
        px.concat(here.child("name"), "-", 3, True),
        px.string(px.number("foo")),
        px.string(px.number(here.child("name"))),
        px.substring("12345", 1.5, 2.6),
        px.substring_before("4.5", "."),
        px.substring_after("4.5", "."),
        px.translate("--abcd--", "abc-", "ABC"),
        px.normalize_space("  a \n b "),
        px.re_match("aaax", "a*"),
        px.string_length(here.child("name")),
        px.floor(px.expr(4.5)),
        px.ceiling(px.expr(4.5)),
        px.round_(px.expr(-6.5)),
        px.expr(1) / 0,
        -(px.expr(5) % -2),
        px.enum_value(c.child("level")),
        px.enum_value(here.child("name")),
        px.bit_is_set(c.child("flags"), "v"),
        px.bit_is_set(here.child("name"), "v"),
        px.derived_from(c.child("hue"), "colour", up),
        px.derived_from(c.child("hue"), "crimson", up),
        px.derived_from(c.child("hue"), "crimson", up, or_self=True),
        px.deref(here.descendant("ref")).parent().child("w"),
        px.count(px.deref(here.descendant("tag"))),
        root().child("a").where(here.child("id") == current().child("c").child("q2") - 1).child("id"),
        px.count(here.child("name") | here.child("name") | c.child("p")),
    )
    nan = [k for k, x in enumerate(got) if isinstance(x, float) and math.isnan(x)]
    assert nan == [2, 19]
    assert [x for k, x in enumerate(got) if k not in nan] == [
        29.0, 8.5, "n-3true", "NaN", "NaN", "234", "4", "5", "ABCd", "a b", False, 1.0, 4.0, 5.0, -6.0, math.inf, -1.0,
        7.0, True, False, True, False, True, ["7.0"], 0.0, ["2"], 2.0,
    ]


def test_expressions_print_themselves():
    path = root().child("a", here.child("id") == 5).child("b").where(last()).parent()
    assert str(path) == "/a[id = 5.0]/b[last()]/.." and str(px.count(path) > 1) == f"count({path}) > 1.0"


def test_schema_resolution():
    own = SHOP.ancestry("/a/b/ref")
    assert [n.name for n in own] == ["top", "a", "b", "ref"]
    assert px.leafref_target(own).name == "id"
    assert px.resolve(own, here.parent().parent().child("w")) == [("a", "w")]
    assert m.check_model(SHOP) is SHOP
    with pytest.raises(m.ModelError):
        m.check_model(m.container("t", m.leaf("r", INT, leafref=("nope", "id"))))
    assert tr.route_of_path(root().child("a").child("w"), SHOP) == [("a", {}), ("w", {})]


def test_nested_validation(docs):
    got = [(r.i, r.instance_path, r.error_class, r.error_tag) for r in tr.validate(docs, SHOP).orderBy("i", "seq").collect()]
    assert got == [
        (0, "/a[id='13']", "semantic", "non-unique-key"),
        (0, "/a[id='1']/b[k='k2']/ref", "semantic", "instance-required"),
        (0, "/a[id='2']/w", "type", "invalid-type"),
        (0, "/a[id='2']/tag", "semantic", "too-many-elements"),
        (0, "/a[id='2']/tag[.='x']", "semantic", "repeated-leaf-list-value"),
        (0, "/a[id='2']/b[k='k3']", "semantic", "non-unique-key"),
        (0, "/a[id='2']/b[1]", "semantic", "data-not-unique"),
        (0, "/a[id='2']/b[k='k4']/ref", "schema", "missing-data"),
        (0, "/a[id='13']/deep", "schema", "member-not-allowed"),
        (0, "/a[id='13']", "semantic", "unlucky"),
        (0, "/a[id='13']", "semantic", "unlucky"),
        (0, "/c/x", "schema", "missing-data"),
        (0, "/c/ch", "schema", "member-not-allowed"),
        (1, "/a", "semantic", "too-few-elements"),
        (1, "/other:pc/z", "schema", "missing-data"),
        (2, "/a", "semantic", "too-few-elements"),
        (2, "/c/x", "schema", "missing-data"),
    ]
    first = [(r.i, r.error_tag) for r in tr.validate(docs, SHOP, first_only=True).orderBy("i").collect()]
    assert first == [(0, "non-unique-key"), (1, "too-few-elements"), (2, "too-few-elements")]
    kinds = {r.error_class for r in tr.validate(docs, SHOP, scope="syntax").collect()}
    assert kinds == {"schema", "type"} and tr.validate(docs.limit(0), SHOP).count() == 0


def test_nested_defaults(docs):
    filled = tr.add_defaults(CTX())
    one = as_json(docs, filled)
    assert [e.get("deep") for e in one["a"]] == [4, 4, 3, None] and one["c"]["y"] == 9 and one["c"]["q1"] == 1 and "pc" not in one
    assert as_json(docs, filled, 1) == {"name": "nobody", "c": {"x": 1, "y": 9, "q1": 1}, "other:pc": {}}
    assert as_json(docs, filled, 2) == {"name": "nobody", "c": {"y": 9, "q1": 1}}
    assert as_json(docs, filled, 3) is None
    used = docs.filter("i = 2").select(F.inline(tr.defaults_in_use(CTX()))).collect()
    assert sorted(map(tuple, used)) == [("/c/q1", "1"), ("/c/y", "9"), ("/name", "nobody")]


def test_encoding_and_filters(docs):
    want = json.loads(json.dumps(FIRST).replace("1.5,", '"1.5",').replace("7.0,", '"7.0",').replace('["v"]', '"v"'))
    assert as_json(docs, F.col("doc")) == want
    keep = lambda path, ctx: False if path in ("/a/b", "/c") else ctx.value["id"] < 10 if path == "/a/*" else True
    got = json.loads(docs.filter("i = 0").select(tr.to_json(CTX(), keep)).first()[0])
    assert got == {"name": "n", "a": [{k: v for k, v in e.items() if k != "b"} for e in want["a"][:2]]}
    xml = docs.select("i", tr.to_xml(CTX(), {"other": "urn:o"}).alias("x"))
    texts = {r.i: r.x for r in xml.collect()}
    assert texts[1] == '<content-data><c><x>1</x></c><pc xmlns="urn:o"></pc></content-data>' and texts[3] is None
    back = xml.filter("i = 0").select(tr.to_json(px.document(SHOP, tr.from_xml(F.col("x"), SHOP)))).first()[0]
    assert json.loads(back) == want


def test_decoding_errors(spark):
    text = '{"nam":1,"name":5,"a":[{"id":1,"b":{"k":1}},{"id":"x","z":1},7],"@":{"ann":"v"},"@name":{"ann":3,"bad":1},"other:pc":{"z":1}}'
    df = spark.createDataFrame([(text,), ("[1]",), (None,)], "raw string")
    model = DataModel(SHOP, annotations=(("ann", INT),))
    rows = model.from_raw(df).collect()
    assert [(e.instance_path, e.error_tag) for e in rows[0].errors] == [
        ("/nam", "raw-member"),
        ("/@name/bad", "raw-member"),
        ("/@/ann", "raw-type"),
        ("/name", "raw-type"),
        ("/a=1/b", "raw-type"),
        ("/a=x/z", "raw-member"),
        ("/a=x/id", "raw-type"),
        ("/a/2", "raw-type"),
    ]
    assert rows[0].doc.pc.z == 1 and rows[0].doc.name is None
    assert [(e.instance_path, e.error_tag) for e in rows[1].errors] == [("/", "raw-type")] and rows[2].errors == [] and rows[2].doc is None


def test_nodes_and_routes(docs):
    nodes = [tuple(r)[1:] for r in tr.node_rows(docs.filter("i = 0"), SHOP).orderBy("pre").limit(8).collect()]
    assert nodes[6] == (6, "/a[id='1']/b[k=\"k'1\"]", "/a/0/b/0", "/a/b", "b", "list", None)
    assert nodes[4] == (4, "/a[id='1']/tag[.='p']", "/a/0/tag/0", "/a/tag", "tag", "leaf-list", "p")
    paths = [r.path for r in tr.node_rows(docs.filter("i = 0"), SHOP).filter("kind <> 'leaf-list'").collect()]
    assert all(tr.route_text(nav.route_from_instance_id(p)) == p for p in paths)
    model = DataModel(SHOP)
    at = lambda text: model.peek(model.parse_instance_id(text))
    got = docs.filter("i = 0").select(at("/a[id='2']/b[k='k3']/ref"), at("/a[2]/tag[.='x']"), at("/a[id='1']/tag[2]"), F.size(at("/a")), at("/a[id='99']/w"), at('/a[id="1"]/b[k="k\'1"]/ref')).first()
    assert list(got) == [1, "x", "q", 4, None, 2]
    route = model.parse_instance_id("/a[id='2']")
    side = docs.filter("i = 0").select(tr.entry_at(CTX(), route, 1)["id"], tr.entry_at(CTX(), model.parse_instance_id("/a[id='1']"), -1)["id"], tr.sibling(CTX(), [*route, ("w", {})], "id")).first()
    assert list(side) == [13, None, 2]
    assert [r.i for r in model.goto(docs, model.parse_instance_id("/c/x")).collect()] == [1]
    assert tr.split_route(nav.route_from_instance_id("/a[id='2']/b[k='k4']/ref"), SHOP, "/a") == ([("a", {"id": "2"})], [("b", {"k": "k4"}), ("ref", {})])
    for bad in ("/a[bogus]/id", "/a[id='1'", "a", "/a[0]", "", "/a[id='1'][2]", "/a//b", "/a['x']"):
        with pytest.raises(nav.InvalidKeyValue):
            nav.route_from_instance_id(bad)
    for bad in ("/nope", "/a[nope='1']"):
        with pytest.raises(m.NonexistentSchemaNode):
            model.parse_instance_id(bad)
    with pytest.raises(nav.InvalidKeyValue):
        model.peek([("c", {"x": "1"})])


def test_resource_ids():
    model = m.container("t", m.list_("l", "a b", m.leaf("a", TEXT), m.leaf("b", INT), m.leaf_list("v", TEXT)), m.operation("run", m.Node("input", "input")))
    assert nav.route_from_resource_id("/l=x%2Cy,2/v=p%2Fq", model) == [("l", {"a": "x,y", "b": "2"}), ("v", {".": "p/q"})]
    assert nav.route_from_resource_id("/l", model) == [("l", {})] and nav.route_from_resource_id("", model) == []
    for bad in ("/l=x", "/l/v", "/l="):
        with pytest.raises(nav.InvalidKeyValue):
            nav.route_from_resource_id(bad, model)
    with pytest.raises(m.BadSchemaNodeType):
        nav.route_from_resource_id("/l=x,2/a=1", model)
    with pytest.raises(nav.NonDataNode):
        tr.peek(px.document(model, F.lit(None)), nav.route_from_resource_id("/run", model))
    assert {c.name for c in model.child("run").children} == {"input", "output"}


def test_edits(docs):
    at = nav.route_from_instance_id
    change = lambda column: as_json(docs, column)
    assert change(tr.put_member(CTX(), at("/a[id='2']/b[k='k4']/ref"), F.lit(5).cast("decimal(38,0)")))["a"][1]["b"][2] == {"k": "k4", "ref": 5}
    assert [e["k"] for e in change(tr.delete_item(CTX(), at("/a[id='2']/b[k='k3']")))["a"][1]["b"]] == ["k4"]
    assert "p" not in change(tr.delete_item(CTX(), at("/c/p")))["c"]
    assert len(change(tr.delete_item(CTX(), at("/a[4]")))["a"]) == 3
    assert change(tr.update(CTX(), at("/a[id='1']/tag[.='q']"), lambda v: F.upper(v)))["a"][0]["tag"] == ["p", "Q"]
    for after, want in ((True, ["p", "new", "q"]), (False, ["new", "p", "q"])):
        assert change(tr.insert_entry(CTX(), at("/a[id='1']/tag[.='p']"), F.lit("new"), after))["a"][0]["tag"] == want
    assert change(tr.put_member(CTX(), at("/a[id='99']/w"), F.lit(1)))["a"] == change(F.col("doc"))["a"]
    with pytest.raises(nav.InvalidKeyValue):
        tr.update(CTX(), at("/a/w"), lambda v: v)


def test_merge_and_hash(docs):
    other = F.from_json(F.lit('{"a":[{"id":2,"w":2.00,"tag":["y","x"]},{"id":50},{"id":2,"w":3}],"c":{"x":3}}'), SHOP.struct_type())
    got = as_json(docs, tr.merge(SHOP, F.col("doc"), other))
    assert [e["id"] for e in got["a"]] == [1, 2, 13, 13, 50] and got["a"][1]["w"] == "2.0" and got["a"][1]["tag"] == ["x", "x", "x", "y"]
    assert got["c"]["x"] == 3 and got["c"]["p"] == "1" and len(got["a"][1]["b"]) == 3 and got["name"] == "n"
    assert as_json(docs, tr.merge(SHOP, F.col("doc"), other), 3)["c"] == {"x": 3}
    same = px.document(SHOP, tr.merge(SHOP, F.col("doc"), F.col("doc")))
    hashes = docs.select(tr.etag(CTX()).alias("a"), tr.etag(px.document(SHOP, tr.put_member(CTX(), [("name", {})], F.lit("other")))).alias("b"), tr.etag(same).alias("c"))
    rows = hashes.collect()
    assert rows[0].a != rows[0].b and rows[3].a is None and rows[1].a == rows[1].c and len({r.a for r in rows}) == 4
    stamps = docs.select(tr.changed_at(CTX(), tr.put_member(CTX(), [("name", {})], F.lit("n")), F.lit(1), F.lit(2))).collect()
    assert [r[0] for r in stamps] == [1, 2, 2, 1]


def test_model_parts():
    group = (m.leaf("x", INT), m.container("in", m.leaf("y", INT)))
    copy = m.uses(group, when=here.child("n") == 1, refine={"/x": {"mandatory": True}}, augment={"/in": (m.leaf("z", TEXT),)})
    own = m.container("t", m.leaf("n", INT), *copy)
    assert [c.name for c in own.data_children()] == ["n", "x", "in"] and own.data_node("in/z").type is TEXT and own.data_child("x").mandatory
    assert m.feature_holds(("or", "a", ("and", "b", ("not", "c"))), {"b"}) and not m.feature_holds(("not", "b"), {"b"})
    thin = m.container("t", m.leaf("p", TEXT, features=(("or", "f", "g"), "h")), m.leaf("q", TEXT)).with_features({"g", "h"})
    assert [c.name for c in thin.children] == ["p", "q"]
    base = m.container("t", m.list_("l", "k", m.leaf("k", INT), unique=(("k",),)))
    assert base.deviate("/l", "add", unique=(("k", "k"),)).child("l").unique == (("k",), ("k", "k"))
    assert base.deviate("/l", "delete", unique=(("k",),)).child("l").unique == ()
    with pytest.raises(m.ModelError):
        base.deviate("/l/k", "add", type=TEXT)
    with pytest.raises(m.ModelError):
        base.deviate("/l/k", "delete", units="m")
    closed = m.container("t", m.container("p", m.leaf("q", INT, deny="all"), deny="write"))
    assert m.denied(closed) == ["/p", "/p/q"] and m.denied(closed, "read") == ["/p/q"]
    assert own.is_internal() and not own.data_child("x").is_internal() and own.data_parent("/in/y").name == "in"


def test_model_files(tmp_path, spark):
    plain = DataModel(m.container("t", m.leaf("x", Type("int8"))), (("b", "2020"), ("a", "")), urns=(("t", "urn:t"),))
    plain.to_file(f"{tmp_path}/model.json")
    again = DataModel.from_file(f"{tmp_path}/model.json")
    assert again == plain and len(plain.module_set_id()) == 40 and json.loads(plain.schema_digest())["children"]["x"]["type"] == {"base": "int8"}
    with pytest.raises(m.ModelError):
        SHOP.to_dict()
    rows = spark.createDataFrame([("m", "2020-01-01"), ("m", "2021-01-01"), ("n", None)], "name string, revision string")
    assert sorted(map(tuple, m.latest_revisions(rows).collect())) == [("m", "2021-01-01"), ("n", None)]


def test_types():
    kind = Type("int8").derive("small", ranges="min..4 | 10 | 20..max")
    assert kind.ranges == ((-128, 4), (10, 10), (20, 127)) and kind.digest()["derived"] == "small"
    assert ty.intervals("1.5..max", Type("decimal64", digits=2))[0][1] is None
    with pytest.raises(ValueError):
        ty.intervals("5..9 | 7..12", Type("int8"))
    assert [ty.default_integer(t) for t in ("-0x18EA", "014352", "0", "+7", "-12")] == [-6378, 6378, 0, 7, -12]
    few = Type("enumeration", enums=ty.enums("a", ("b", 9), "c")).derive("two", enums=("c", "a"))
    assert ty.by_number(few.enums) == [("a", 0), ("c", 10)]


def test_edges_of_numbers_and_text(spark):
    xs = [1e22, 1e20, -1.5, 0.1, 1e-7, 1e15, -2e16, 0.0, -0.0, float("nan"), float("inf"), None]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = df.select(xp.string_of_number(F.col("x")).alias("s"), xp.floor(F.col("x")).alias("f"), xp.round_(F.col("x")).alias("r")).collect()
    assert [r.s for r in got] == ["1" + "0" * 22, "1" + "0" * 20, "-1.5", "0.1", "0.0000001", "1" + "0" * 15, "-2" + "0" * 16, "0", "0", "NaN", "Infinity", ""]
    assert [got[0].f, got[1].r, got[2].f, got[2].r] == [1e22, 1e20, -2.0, -1.0]
    text = spark.createDataFrame([("5\n",), ("5",), (None,)], "s string")
    row = text.select(ty.parse(F.col("s"), INT).alias("i"), xp.contains(F.col("s"), F.lit("5")).alias("c"), xp.starts_with(F.col("s"), F.lit("")).alias("w"), xp.normalize_space(F.col("s")).alias("n"), xp.number_of_string(F.col("s")).alias("x")).collect()
    assert [r.i for r in row] == [None, 5, None] and [r.c for r in row] == [True, True, False] and row[2].w is True and row[2].n == "" and math.isnan(row[2].x)


def test_canonical_instance_ids(spark):
    rows = [('/a[ b = "1" ]/c', "/a[b='1']/c"), ("/x:a[2]", "/x:a[2]"), ("/a[ 2 ]", "/a[2]"), ("/a[.='v']", "/a[.='v']"), ('/a[b="it\'s"]', '/a[b="it\'s"]'), ("a", None), ("/a[", None), (None, None)]
    df = spark.createDataFrame(rows, "t string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", nav.canonical_instance_id(F.col("t"))).collect())


def test_between_lists(spark):
    a = spark.createDataFrame([(1, 5), (1, 9), (2, 7), (3, None)], "k int, x int")
    b = spark.createDataFrame([(1, 6), (2, 7), (3, 1)], "q int, y int")
    on = [("k", "q")]
    pairs = lambda op: sorted(r.k for r in nav.any_pair(a, b, on, "x", op, "y").collect())
    assert pairs("<") == [1] and pairs("<=") == [1, 2] and pairs(">") == [1] and pairs("=") == [2] and pairs("!=") == [1] and pairs(">=") == [1, 2]
    assert sorted(r.x for r in nav.where_exists(a, b, on, F.col("y") > 5).collect()) == [5, 7, 9]
    assert [r.k for r in nav.where_exists(a, b, on, F.col("y") > 5, negate=True).collect()] == [3]
    got = nav.child_values(b, a, [("q", "k")], n=F.count("x"), top=F.max("x")).orderBy("q").collect()
    assert [(r.q, r.n, r.top) for r in got] == [(1, 2, 9), (2, 1, 7), (3, 0, None)]


def test_unions_identifiers_and_names(spark, docs):
    kind = Type("union", members=(INT, Type("boolean"), TEXT))
    model = m.container("t", m.leaf("u", kind), m.leaf("at", Type("instance-identifier")))
    df = spark.createDataFrame([('{"u":5}',), ('{"u":true}',), ('{"u":"x","at":"/a[ b = \\"1\\" ]"}',)], "raw string")
    own = DataModel(model)
    back = own.from_raw(df).select(own.to_json()).collect()
    assert [r[0] for r in back] == ['{"u":5}', '{"u":true}', '{"u":"x","at":"/a[b=\'1\']"}']
    assert docs.filter("i = 1").select(tr.member_names(CTX())).first()[0] == ["c", "other:pc"]
    assert ty.resolve_name("p:x", {"p": "mod"}, "own") == ("mod", "x") and ty.resolve_name("x", {}, "own") == ("own", "x")
    with pytest.raises(KeyError):
        ty.resolve_name("q:x", {}, "own")
    assert SHOP.schema_route("/c/ch/q/q1") == [("", "c"), ("", "ch"), ("", "q"), ("", "q1")]
    first = nav.look_up_first(spark.createDataFrame([(2, "a"), (1, "a"), (0, "b")], "k int, v string"), ["k"], v="a")
    assert [r.k for r in first.collect()] == [1]


def test_conditions_of_tables_as_expressions(spark):
    lst = m.list_("l", "k", m.leaf("k", INT), m.leaf("v", INT, must=(m.Must(here > here.parent().child("k")),)), m.leaf("w", INT, when=here.parent().child("v") == 5), must=(m.Must(here.child("k") < 3, "big"),))
    df = spark.createDataFrame([(1, 5, 1), (2, 1, 1), (3, 9, None)], "k int, v int, w int")
    got = sorted((r.instance_path, r.error_tag) for r in v.validate_list(df, lst, {}).collect())
    assert got == [("/l[k='2']/v", "must-violation"), ("/l[k='2']/w", "member-not-allowed"), ("/l[k='3']", "big")]


def test_references_of_tables(spark):
    lst = m.list_("l", "k", m.leaf("k", INT), m.leaf("a", INT, leafref=("t", "id")), m.leaf("b", INT, leafref=("t", "id")), m.leaf("c", INT, leafref=("t", "id"), require_instance=False))
    df = spark.createDataFrame([(1, 5, 6, 0), (2, 5, None, 0), (3, 7, 5, 0)], "k int, a int, b int, c int")
    targets = spark.createDataFrame([(5,), (5,)], "id long")
    got = sorted(r.instance_path for r in v.validate_list(df, lst, {"t": targets}, scope="semantics").collect())
    assert got == ["/l[k='1']/b", "/l[k='3']/a"]

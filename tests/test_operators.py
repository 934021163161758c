"""Models, validation, navigation, edits, documents and streams on small fixtures."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from arbora.functions.types import Type, enums
from arbora.operators import editing as ed
from arbora.operators import navigation as nav
from arbora.operators import validation as v
from arbora.plans import model as m
from arbora.sources import documents as src
from arbora.streaming import validate as st

INT, TEXT = Type("int32"), Type("string")
SHOP = m.container(
    "shop",
    m.list_(
        "shelf",
        "id",
        m.leaf("id", INT),
        m.leaf("width", Type("uint8", ranges=((1, 20), (100, None))), mandatory=True),
        m.choice("fill", m.case("books", m.leaf("pages", INT, mandatory=True), m.leaf("lang", TEXT, default="en")), m.leaf("plant", TEXT), default="books"),
        m.leaf("note", TEXT, when="width > 5", default="wide"),
        m.leaf("old", TEXT, status="obsolete"),
        m.leaf_list("tags", Type("string", ranges=((1, 4),)), max_elements=2),
        m.leaf("load", INT, config=False),
        must=(m.Must("id <> 13", "unlucky", "not thirteen"),),
        unique=(("plant",),),
    ),
    m.container("box", m.leaf("size", INT, mandatory=True), presence=True, ns="other"),
)
SCHEMA = "id int, width int, pages int, lang string, plant string, note string, old string, tags array<string>"


def shelves(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA)


def found(df):
    return sorted((r.instance_path, r.error_class, r.error_tag) for r in df.collect())


def test_rows_are_checked(spark):
    shelf = SHOP.data_child("shelf")
    df = shelves(
        spark,
        (1, 10, 5, "de", None, "x", None, ["a"]),
        (2, 50, None, None, "fern", None, None, None),
        (3, None, None, None, None, "y", None, None),
        (4, 3, None, "fr", None, "z", "gone", ["a", "a", "bcdef"]),
        (13, 7, 1, None, "ivy", None, None, []),
        (13, 7, None, None, "ivy", None, None, []),
    )
    at = "/shelf[id='{}']".format
    assert found(v.validate_list(df, shelf, {})) == sorted(
        [
            (at(2) + "/width", "type", "invalid-type"),
            (at(3) + "/width", "schema", "missing-data"),
            (at(3) + "/note", "schema", "member-not-allowed"),
            (at(4) + "/note", "schema", "member-not-allowed"),
            (at(4) + "/pages", "schema", "missing-data"),
            (at(4) + "/old", "schema", "member-not-allowed"),
            (at(4) + "/tags", "type", "invalid-type"),
            (at(4) + "/tags", "semantic", "too-many-elements"),
            (at(4) + "/tags", "semantic", "repeated-leaf-list-value"),
            (at(13) + "/fill", "schema", "member-not-allowed"),
            (at(13), "semantic", "unlucky"),
            (at(13), "semantic", "unlucky"),
            (at(13), "semantic", "non-unique-key"),
        ]
    )
    assert found(v.validate_list(df, shelf, {}, scope="semantics")) == [(at(13), "semantic", "non-unique-key")]
    assert found(v.validate_list(df.limit(0), shelf, {})) == []


def test_references_and_sizes(spark):
    a = spark.createDataFrame([(1, 5), (2, None), (3, 9)], "id int, ref int")
    b = spark.createDataFrame([(5,), (5,), (6,)], "key int")
    assert [r.id for r in v.missing_instances(a, "ref", b, "key").collect()] == [3]
    sizes = v.cardinality(b.distinct(), a, [("key", "ref")], 1, 5).collect()
    assert [(r.key, r.n, r.error_tag) for r in sizes] == [(6, 0, "too-few-elements")]


def test_model(spark):
    shelf = SHOP.data_child("shelf")
    assert [p for p, _ in SHOP.walk()][:3] == ["/shelf", "/shelf/id", "/shelf/width"] and ("/other:box", SHOP.child("box")) in list(SHOP.walk())
    assert SHOP.state_roots() == ["/shelf/load"]
    assert shelf.struct_type().fieldNames() == ["id", "width", "pages", "lang", "plant", "note", "tags", "load"]
    assert m.Node.from_dict(json.loads(json.dumps(SHOP.to_dict()))) == SHOP
    assert SHOP.descendant("/shelf/fill/books/pages").name == "pages" and SHOP.data_node("/shelf/pages").name == "pages"
    with pytest.raises(m.NonexistentSchemaNode):
        SHOP.data_node("/shelf/none")
    wider = SHOP.augment("/shelf", m.leaf("extra", TEXT), when="id > 0").deviate("/shelf/note", "not-supported").refine("/shelf/width", mandatory=False)
    assert wider.data_node("shelf/extra").when == "id > 0" and not wider.data_node("shelf/width").mandatory
    with pytest.raises(m.NonexistentSchemaNode):
        wider.data_node("shelf/note")
    assert not m.container("c", m.leaf("x", TEXT, mandatory=True, status="deprecated")).is_mandatory()
    assert m.container("c", m.leaf("x", TEXT, mandatory=True)).is_mandatory()
    tree = SHOP.ascii_tree().splitlines()
    assert tree[0].startswith("+--rw shelf* [id]") and any("(fill)?" in line for line in tree) and any("o--rw old?" in line for line in tree)
    assert SHOP.digest()["children"]["other:box"]["presence"] is True
    assert SHOP.catalog(spark).filter("mandatory").count() == 3
    thin = m.container("t", m.leaf("a", TEXT, features=("f",)), m.leaf("b", TEXT)).with_features(set())
    assert [c.name for c in thin.children] == ["b"]
    with pytest.raises(m.FeaturePrerequisiteError):
        m.check_features({"f"}, {"f": {"g"}})
    with pytest.raises(m.CyclicImports):
        m.module_order({"a": {"b"}, "b": {"a"}})
    assert m.module_order({"a": {"b"}, "b": set()}) == ["b", "a"]


def test_defaults(spark):
    shelf = SHOP.data_child("shelf")
    df = shelves(spark, (1, 10, None, None, None, None, None, None), (2, 10, None, None, "fern", None, None, None), (3, 2, 7, None, None, None, None, None))
    once = ed.add_defaults(df, shelf, tag=True)
    got = {r.id: (r.lang, r.note, r._defaults) for r in once.collect()}
    assert got == {1: ("en", "wide", ["lang", "note"]), 2: (None, "wide", ["note"]), 3: ("en", None, ["lang"])}
    assert ed.add_defaults(once.drop("_defaults"), shelf).collect() == once.drop("_defaults").collect()


def test_edits(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, x string")
    assert sorted(ed.merge(df, df, ["id"]).collect()) == sorted(df.collect())
    more = spark.createDataFrame([(2, "B"), (9, "n")], "id int, x string")
    assert sorted(map(tuple, ed.merge(df, more, ["id"]).collect())) == [(1, "a"), (2, "B"), (3, "c"), (9, "n")]
    assert [r.id for r in ed.delete_entries(df, F.col("id") > 1).collect()] == [1]
    one = spark.range(1).select(F.array(F.lit("a"), F.lit("b")).alias("a"), F.array(F.lit("b"), F.lit("c"), F.lit("c")).alias("b"))
    row = one.select(ed.merge_leaf_list(F.col("a"), F.col("b")).alias("m"), ed.replace_entry(F.col("a"), 1, F.lit("z")).alias("r"), ed.insert_entry(F.col("a"), 0, F.lit("i")).alias("i"), ed.insert_entry(F.col("a"), 0, F.lit("i"), after=True).alias("j")).first()
    assert (row.m, row.r, row.i, row.j) == (["a", "b", "c", "c"], ["a", "z"], ["i", "a", "b"], ["a", "i", "b"])
    tags = df.select(ed.etag(["id", "x"]).alias("e"), ed.etag(["x", "id"]).alias("f")).collect()
    assert all(r.e == r.f for r in tags) and len({r.e for r in tags}) == 3


def test_etag_is_the_hash_of_names_and_values(spark):
    rows = [("a", "b"), (None, "a"), ("\x1b2", "a"), ("a\x1f", "b"), ("a\x1b", "b"), ("a\x1b1", "b"), ("a\x1fq\x1fb", None), ("", ""), (None, None)]
    tags = {(r.p, r.q): r.e for r in spark.createDataFrame(rows, "p string, q string").select("p", "q", ed.etag(["q", "p"]).alias("e")).collect()}
    assert len(set(tags.values())) == len(rows)
    for p, q in [("a", "b"), ("", "")]:
        assert tags[p, q] == hashlib.sha256(f"p\x1f{p}\x1fq\x1f{q}".encode()).hexdigest()


def test_routes(spark):
    assert nav.route_from_instance_id("/m:c/list[k='a/b'][j=\"2\"]/leaf[.='x']") == [("c", {}), ("list", {"k": "a/b", "j": "2"}), ("leaf", {".": "x"})]
    assert nav.route_from_instance_id("/m:c/leaf[3]") == [("c", {}), ("leaf", {"#": 2})]
    with pytest.raises(nav.InvalidKeyValue):  # a value or a place is the only selector of its step
        nav.route_from_instance_id("/m:c/leaf[.='x'][3]")
    assert nav.route_from_resource_id("/shelf=7/note", SHOP) == [("shelf", {"id": "7"}), ("note", {})]
    with pytest.raises(nav.InvalidKeyValue):
        nav.route_from_resource_id("/shelf=7,8", SHOP)
    with pytest.raises(m.BadSchemaNodeType):
        nav.route_from_resource_id("/other:box=7", SHOP)
    df = shelves(spark, (7, 10, None, None, None, "n", None, None))
    assert nav.follow(nav.route_from_resource_id("/shelf=7/note", SHOP), {"shelf": df}).first().note == "n"
    assert nav.follow([("shelf", {"id": 8})], {"shelf": df}).count() == 0


def test_nest_and_shred(spark):
    parent = spark.createDataFrame([(1,), (2,)], "p int")
    child = spark.createDataFrame([(1, 2, "y"), (1, 1, "x")], "p int, pos int, v string")
    nested = nav.nest(parent, child, [("p", "p")], ["pos"], "kids")
    assert {r.p: [k.v for k in r.kids] for r in nested.collect()} == {1: ["x", "y"], 2: []}
    assert sorted((r.p, r._pos, r.v) for r in nav.shred(nested.select(F.col("p").alias("q"), "kids"), ["q"], "kids").withColumnRenamed("q", "owner").collect()) == [(1, 0, "x"), (1, 1, "y")]


def test_json_documents(spark):
    node = m.container("d", m.leaf("n", Type("uint8")), m.leaf("big", Type("int64")), m.leaf("kind", Type("enumeration", enums=enums("a"))), m.leaf_list("l", INT), m.container("c", m.leaf("x", TEXT)), m.list_("e", "k", m.leaf("k", TEXT)), m.Node("any", "anydata"), ns="z")
    texts = ['{"n": 5, "big": "7", "l": [1, 2], "c": {"x": "q"}, "e": [{"k": "1"}], "any": [1]}', '{"n": "5", "big": 7, "l": 3, "c": 1, "what": 0, "@n": {"z:a": "b"}}', "no json", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, raw string").withColumn("doc", F.try_parse_json("raw"))
    got = df.select("id", *src.decode(F.col("doc"), node)).orderBy("id").collect()
    assert (int(got[0].n), int(got[0].big), [int(x) for x in got[0].l], got[0].c.x, got[0].e[0].k) == (5, 7, [1, 2], "q", "1")
    assert got[1].n is None and got[2].n is None and got[3].c is None
    bad = src.decode_violations(df, "doc", "id", node).collect()
    assert sorted((r.id, r.instance_path, r.error_tag) for r in bad) == [(1, "/big", "raw-type"), (1, "/c", "raw-type"), (1, "/l", "raw-type"), (1, "/n", "raw-type"), (1, "/what", "raw-member")]
    assert df.filter("id = 1").select(src.metadata(F.col("doc"), "n").alias("a")).first().a == {"z:a": "b"}


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1}\nnope\n')
    docs = src.read_json(spark, str(tmp_path / "a.json"))
    assert docs.filter("doc IS NULL").count() == 1
    (tmp_path / "a.xml").write_text("<r><shelf><id>1</id><width>2</width></shelf><shelf><id>3</id></shelf></r>")
    assert sorted(int(r.id) for r in src.read_xml(spark, str(tmp_path / "a.xml"), "shelf", m.container("s", m.leaf("id", INT), m.leaf("width", INT))).collect()) == [1, 3]
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text("id: 4\ntags: [a, b]\n")
    assert json.loads(src.read_yaml(spark, str(tmp_path / "a.yaml")).first().raw) == {"id": 4, "tags": ["a", "b"]}


def test_library(spark):
    raw = '{"datastores": [{"name": "run", "schema": "s"}], "schemas": [{"name": "s", "sets": ["m1", "m2"]}], "sets": [{"name": "m1", "modules": [{"name": "a", "revision": "1"}], "imports": [{"name": "b", "revision": "2"}]}, {"name": "m2", "modules": [{"name": "c", "revision": "3"}], "imports": []}]}'
    lib = spark.range(1).select(F.from_json(F.lit(raw), "datastores array<struct<name:string,schema:string>>, schemas array<struct<name:string,sets:array<string>>>, sets array<struct<name:string,modules:array<struct<name:string,revision:string>>,imports:array<struct<name:string,revision:string>>>>").alias("l")).select("l.*")
    assert sorted((r.name, r.implemented) for r in src.library_modules(lib).collect()) == [("a", True), ("b", False), ("c", True)]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00", 5), (1, "2024-01-01 00:01:00", 6), (2, "2024-01-01 00:02:00", 300)], "id int, ts string, width int").withColumn("ts", F.to_timestamp("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    node = m.list_("shelf", "id", m.leaf("id", INT), m.leaf("width", Type("uint8")))

    def drain(df, name):
        df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination(60)
        return spark.table(name).collect()

    stream = st.read_notifications(spark, str(tmp_path / "in"), rows.schema)
    assert [r.instance_path for r in drain(st.validate_stream(stream, node), "bad")] == ["/shelf[id='2']/width"]
    assert sorted(r.id for r in drain(st.first_of_key(stream, ["id"], "ts"), "first")) == [1, 2]


def test_catalog_has_sql_for_each_query():
    from arbora.plans import catalog

    assert set(catalog.queries()) - set(catalog.oracle_sql()) == set()


def test_counts_and_pointers_cover_whole_tables(spark):
    from arbora.plans import catalog
    from arbora.plans.warehouse import WAREHOUSE

    d = "/root/testdata/sf0.001"
    got = {r.schema_path: r.n for r in catalog.queries()["val_counts_warehouse"](spark, d).collect()}
    want = {f"/{x.name}/{c.name}": spark.read.parquet(f"{d}/{x.name}.parquet").filter(F.col(c.name).isNotNull()).count() for x in WAREHOUSE.data_children() for c in x.data_children()}
    assert got == want and {p.split("/")[1] for p in got} == {"region", "nation", "supplier", "customer", "part", "orders", "lineitem"}
    items = catalog.queries()["json_pointer_lineitem"](spark, d)
    keys = sorted((r.l_orderkey, r.l_linenumber) for r in items.collect())
    places = {int(r.pointer.removeprefix("/lineitem/")): (r.l_orderkey, r.l_linenumber) for r in items.collect()}
    assert [places[i] for i in range(len(keys))] == keys
    for df in (items, catalog.queries()["json_pointer_nation"](spark, d)):
        assert "SinglePartition" not in df._jdf.queryExecution().toString()
    odd = spark.createDataFrame([(None, "a"), (2, "b"), (1, "c"), (1, None)], "k int, x string")
    assert [(r.k, r.x, r.pointer) for r in nav.json_pointers(odd, "o", ["k", "x"]).orderBy("pointer").collect()] == [(None, "a", "/o/0"), (1, None, "/o/1"), (1, "c", "/o/2"), (2, "b", "/o/3")]
    assert nav.json_pointers(odd.limit(0), "o", ["k"]).count() == 0

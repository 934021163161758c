"""Annotations beside documents, and counts observed while validating."""

import json

from pyspark.sql import functions as F

from arbora.functions.types import Type
from arbora.operators import annotations as an
from arbora.operators import paths as px
from arbora.operators import trees as tr
from arbora.plans import model as m
from arbora.plans.data_model import DataModel

TEXT, INT = Type("string"), Type("int32")
MODEL = DataModel(
    m.container(
        "t",
        m.leaf("a", TEXT),
        m.leaf("d", INT, default=5),
        m.leaf_list("l", INT),
        m.container("c", m.leaf("x", TEXT), m.leaf("y", TEXT, ns="o")),
        m.list_("e", "k", m.leaf("k", TEXT), m.leaf("v", INT), m.list_("s", "", m.leaf("z", INT))),
    ),
    annotations=(("who", TEXT), ("n", Type("uint8")), (an.DEFAULT, Type("boolean"))),
)
DOC = {
    "@": {"who": "root"},
    "a": "1",
    "@a": {"who": "it's", "n": 7},
    "l": [3, 4, 5],
    "@l": [None, {"n": 1}, {"who": "x"}],
    "c": {"@": {"n": 2}, "x": "q", "@x": {"who": "cx"}, "o:y": "w", "@o:y": {"n": 9}},
    "e": [{"@": {"who": "e1"}, "k": "p", "v": 1, "@v": {"n": 3}}, {"k": "r", "s": [{"z": 1, "@z": {"n": 4}}]}],
}


def load(spark, *docs):
    rows = spark.createDataFrame([(i, None if d is None else json.dumps(d)) for i, d in enumerate(docs)], "i int, raw string")
    both = MODEL.notes(rows).join(MODEL.from_raw(rows).select("i", "doc"), "i")
    return both


def test_round_trip(spark):
    df = load(spark, DOC, {}, None, {"a": "x"})
    rows = {r.i: r for r in df.select("i", "notes", "note_errors", MODEL.to_annotated_json().alias("out")).collect()}
    assert json.loads(rows[0].out) == DOC and rows[0].note_errors == []
    assert {n.path: n.notes for n in rows[0].notes} == {
        "/": {"who": "root"},
        "/a": {"who": "it's", "n": "7"},
        "/l[.='4']": {"n": "1"},
        "/l[.='5']": {"who": "x"},
        "/c": {"n": "2"},
        "/c/x": {"who": "cx"},
        "/c/o:y": {"n": "9"},
        "/e[k='p']": {"who": "e1"},
        "/e[k='p']/v": {"n": "3"},
        "/e[k='r']/s[1]/z": {"n": "4"},
    }
    assert [rows[i].out for i in (1, 2, 3)] == ["{}", None, '{"a":"x"}'] and all(rows[i].notes == [] for i in (1, 2, 3))


def test_errors(spark):
    df = load(spark, {"a": "1", "@a": {"what": 1, "n": 300}, "@d": {"n": 1}, "l": [1], "@l": [{"n": "x"}, {"n": 2}], "@": {"odd": 1}})
    got = {(e.instance_path, e.error_tag) for e in df.first().note_errors}
    assert got == {("/a/@what", "undefined-annotation"), ("/a/@n", "raw-type"), ("/d", "missing-annotation-target"), ("/l[.='1']/@n", "raw-type"), ("/l[2]", "missing-annotation-target"), ("//@odd", "undefined-annotation")}
    assert df.first().notes == []


def test_edits_merges_and_defaults_keep_annotations(spark):
    df = load(spark, DOC)
    ctx = px.document(MODEL.root, F.col("doc"))
    cut = tr.delete_item(ctx, [("e", {"k": "p"})])
    edited = df.select(cut.alias("doc"), "notes")
    kept = edited.select(an.keep_notes(F.col("notes"), ctx).alias("n")).first().n
    assert {n.path for n in kept} == {n.path for n in df.first().notes} - {"/e[k='p']", "/e[k='p']/v"}
    noted = df.select("doc", an.annotate(an.annotate(F.col("notes"), "/a", "n", F.lit(8)), "/d", "who", F.lit("me")).alias("notes"))
    assert {n.path: n.notes for n in noted.first().notes}["/a"] == {"who": "it's", "n": "8"}
    two = load(spark, DOC, {"@": {"n": 1}, "a": "2", "@a": {"n": 9}})
    both = two.filter("i = 0").select(F.col("notes").alias("x")).crossJoin(two.filter("i = 1").select(F.col("notes").alias("y")))
    merged = {n.path: n.notes for n in both.select(an.merge_notes(F.col("x"), F.col("y")).alias("m")).first().m}
    assert merged["/"] == {"who": "root", "n": "1"} and merged["/a"] == {"who": "it's", "n": "9"} and len(merged) == 10
    filled = df.select(tr.add_defaults(ctx).alias("doc"), an.tag_defaults(ctx, F.col("notes")).alias("notes"))
    out = json.loads(filled.select(MODEL.to_annotated_json().alias("o")).first().o)
    assert out == {**DOC, "d": 5, "@d": {an.DEFAULT: True}}


def test_counts_while_validating(spark, tmp_path):
    docs = [DOC, {}, {"l": [1, 1], "e": [{"k": "a"}, {"k": "a", "s": [{"z": 1}, {}]}]}, {"c": {}}, None]
    load(spark, *docs).select("i", "doc").write.parquet(f"{tmp_path}/d")
    df = spark.read.parquet(f"{tmp_path}/d")
    rows, seen = tr.validate_counted(df, MODEL.root)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, tr.validate(df, MODEL.root).collect())) and rows.count() > 1
    assert tr.observed_counts(seen) == {r.schema_path: r.n for r in MODEL.counts(df).collect()}
    assert plan.count("Scan parquet") <= 2 and plan.count("FileScan") + plan.count("Scan parquet") > 0
    assert "Join" not in plan and "Exchange" not in plan

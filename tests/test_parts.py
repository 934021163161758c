"""Parts of the schema: decoding one, and checking again only what an edit can change."""

import json
import random

import pytest
from pyspark.sql import functions as F

from arbora.functions.types import Type
from arbora.operators import trees as tr
from arbora.operators.paths import count, document, here, root
from arbora.plans import model as m
from arbora.plans.data_model import DataModel

TEXT, INT = Type("string"), Type("int32", ranges=((0, 9),))
MODEL = m.container(
    "t",
    m.leaf("a", INT, must=(m.Must(root().child("c").child("x") != here, "a-is-x"),)),
    m.leaf("b", INT, default=3, when=root().child("a") > 2),
    m.container("c", m.leaf("x", INT), m.leaf("y", INT, mandatory=True, when=here.parent().child("x") == 1), m.container("d", m.leaf("z", INT, must=(m.Must(root().child("b") == 3, "b-not-3"),)))),
    m.list_("l", "k", m.leaf("k", INT), m.leaf("r", INT, leafref=("n", "k")), m.leaf("v", INT, default=1), unique=(("v",),), max_elements=3, must=(m.Must(count(root().child("n")) < 3, "many-n"),)),
    m.list_("n", "k", m.leaf("k", INT), min_elements=1),
    m.choice("ch", m.case("p", m.leaf("p1", INT), m.leaf("p2", INT, when=here.parent().child("a") == 1)), m.case("q", m.leaf("q1", INT)), mandatory=True),
)


def random_doc(rnd):
    pick = lambda: rnd.randint(0, 10)
    doc = {k: pick() for k in ("a", "b", "p1", "p2", "q1") if rnd.random() < 0.4}
    if rnd.random() < 0.7:
        doc["c"] = {k: rnd.randint(0, 2) for k in ("x", "y") if rnd.random() < 0.6} | ({"d": {"z": 1}} if rnd.random() < 0.5 else {})
    doc["l"] = [{"k": rnd.randint(0, 3)} | ({"r": rnd.randint(0, 3)} if rnd.random() < 0.6 else {}) | ({"v": rnd.randint(0, 2)} if rnd.random() < 0.6 else {}) for _ in range(rnd.randint(0, 4))]
    doc["n"] = [{"k": k} for k in range(rnd.randint(0, 3))]
    return doc


def test_affected_paths(spark):
    assert tr.affected(MODEL, ["/c/d/z"]) == {"/c", "/c/d", "/c/d/z"}
    assert tr.affected(MODEL, ["/a"]) == {"/a", "/b", "/c/d/z", "/p2"}  # z's condition looks at b, whose default at a
    assert tr.affected(MODEL, ["/q1"]) == {"/q1", "/p1", "/p2", "/ch"}
    assert tr.affected(MODEL, ["/n"]) == {"/n", "/n/k", "/l", "/l/r"}
    assert tr.affected(MODEL, ["/l/v"]) == {"/l", "/l/v"}
    assert "/l/k" in tr.affected(MODEL, ["/l"]) and tr.affected(MODEL, []) == frozenset()


@pytest.mark.parametrize("edited", [("a",), ("b",), ("c",), ("l",), ("n",), ("p1", "q1"), ("a", "n")])
def test_checked_again_equals_a_full_run(spark, edited):
    rnd = random.Random(str(edited))
    old = [random_doc(rnd) for _ in range(60)]
    new = []
    for d in old:
        other = random_doc(rnd)
        new.append({k: v for k, v in d.items() if k not in edited} | {k: other[k] for k in edited if k in other})
    make = lambda docs: DataModel(MODEL).from_raw(spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, raw string")).select("i", "doc")
    only = tr.affected(MODEL, [f"/{e}" for e in edited])
    full = {tuple(r) for r in tr.validate(make(new), MODEL).drop("seq").collect()}
    before = {tuple(r) for r in tr.validate(make(old), MODEL).drop("seq").collect() if r.schema_path not in only}
    again = {tuple(r) for r in tr.validate(make(new), MODEL, only=only).drop("seq").collect()}
    assert {r[2] for r in again} <= only
    assert before | again == full and len(full) > 20


def test_parts_are_decoded_and_checked_alone(spark):
    rows = [(0, '{"x":1}'), (1, '{"x":2,"y":50}'), (2, "7"), (3, None), (4, '[{"k":1},{"k":1}]'), (5, '{"k":1,"v":3}')]
    df = spark.createDataFrame(rows, "i int, raw string").withColumn("v", F.try_parse_json("raw"))
    c = df.select("i", tr.decode_part(F.col("v"), MODEL, "/c").alias("p"))
    got = {r.i: r for r in c.select("i", "p", tr.violations_at(document(MODEL, F.lit(None).cast(MODEL.struct_type())), F.col("p"), "/c").alias("found")).collect()}
    assert [(f.instance_path, f.error_tag) for f in got[0].found] == [("/c/y", "missing-data")]
    assert [(f.instance_path, f.error_tag) for f in got[1].found] == [("/c/y", "member-not-allowed"), ("/c/y", "invalid-type")]
    assert got[2].p is None and got[2].found == [] and got[3].found == []
    lists = df.select("i", tr.decode_part(F.col("v"), MODEL, "/l").alias("p"), tr.decode_part(F.col("v"), MODEL, "/l", entry=True).alias("e"), tr.decode_part(F.col("v"), MODEL, "/a").alias("a"))
    by = {r.i: r for r in lists.collect()}
    assert [int(e.k) for e in by[4].p] == [1, 1] and by[4].e is None and (int(by[5].e.k), int(by[5].e.v)) == (1, 3) and by[5].p is None and int(by[2].a) == 7
    with pytest.raises(m.NonexistentSchemaNode):
        tr.decode_part(F.col("v"), MODEL, "/c", entry=True)


def test_documents_over_several_lines(spark, tmp_path):
    from arbora.sources import documents

    (tmp_path / "a.json").write_text('{"a":\n 7,\n "n": [\n{"k": 1}]}\n')
    (tmp_path / "b.json").write_text("{\n")
    got = documents.read_json(spark, str(tmp_path), whole=True).select(tr.decode(F.col("doc"), MODEL).alias("d")).collect()
    assert sorted(str(r.d and (int(r.d.a), [int(n.k) for n in r.d.n])) for r in got) == ["(7, [1])", "None"]

"""XML by namespace: exact text, scopes of prefixes, values with prefixes, errors, large files split at rows."""

from pyspark.sql import functions as F

from arbora.functions.types import Type
from arbora.plans import model as m
from arbora.plans.data_model import DataModel
from arbora.sources import xml

TEXT, INT = Type("string"), Type("int32")
MODEL = DataModel(
    m.container(
        "top",
        m.leaf("v", TEXT, ns="a"),
        m.leaf("v2", TEXT, ns="a"),
        m.container("box", m.leaf("v", TEXT, ns="a"), m.leaf("w", TEXT, ns="b"), m.leaf_list("l", TEXT, ns="a"), ns="a"),
        m.list_("e", "k", m.leaf("k", INT, ns="b"), m.leaf("id", Type("identityref", identities=("a:red", "b:blue")), ns="b"), m.leaf("to", Type("instance-identifier"), ns="b"), m.leaf("none", Type("empty"), ns="b"), ns="b"),
    ),
    urns=(("a", "urn:a"), ("b", "urn:b")),
)


def read(spark, *texts, model=MODEL):
    df = model.from_xml(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw string").repartition(2))
    return {r.i: r for r in df.collect()}


def test_exact_text(spark):
    got = read(
        spark,
        '<c xmlns="urn:a"><v>  pad  </v><box><l>x </l><l/><l>\n y</l></box></c>',
        '<c xmlns="urn:a"><v>use xmlns="foo" here</v><v2><![CDATA[<n:k> & ]]>]]&gt;</v2></c>',
        '<c xmlns="urn:a"><v>a&lt;b&amp;&#233;&#13;</v><!-- <v>no</v> --><?pi x?></c>',
        None,
        "<c><v></c>",
        '<!DOCTYPE c [<!ENTITY x "boom">]><c xmlns="urn:a"><v>&x;</v></c>',
        "",
    )
    assert got[0].doc.v == "  pad  " and got[0].doc.box.l == ["x ", "", "\n y"]
    assert got[1].doc.v == 'use xmlns="foo" here' and got[1].doc.v2 == "<n:k> & ]]>"
    assert got[2].doc.v == "a<b&é\r" and not got[2].errors
    assert got[3].doc is None and got[3].errors == []
    for i in (4, 5, 6):
        assert got[i].doc is None and [e.error_tag for e in got[i].errors] == ["raw-xml"]


def test_namespaces_and_prefixes(spark):
    got = read(
        spark,
        '<c xmlns:p="urn:a" xmlns="urn:b"><p:v>1</p:v><v>2</v><p:box><p:v>in</p:v><w>b</w><p:w>no</p:w></p:box></c>',
        '<c xmlns="urn:b" xmlns:b="urn:a"><e><k>7</k><id>b:red</id><to xmlns:q="urn:b">/q:e[q:k=\'b:7\']/q:k</to><none/></e><e><k>8</k><id>blue</id></e></c>',
        '<c xmlns="urn:b"><e xmlns:x="urn:a"><k>1</k><id> x:red </id></e><e><k>2</k><id>x:red</id></e></c>',
        '<c xmlns="urn:a"><v>1</v><v>2</v><odd><v>3</v></odd>text<box><v><b/></v></box></c>',
    )
    assert (got[0].doc.v, got[0].doc.box.v, got[0].doc.box.w) == ("1", "in", "b")
    assert [e.instance_path for e in got[0].errors] == ["/v", "/box/w"]
    one, two = got[1].doc.e
    assert (int(one.k), one.id, one.to, one.none) == (7, "a:red", "/b:e[b:k='b:7']/b:k", True) and two.id == "b:blue"
    assert [e.id for e in got[2].doc.e] == ["a:red", "x:red"]  # the second prefix is out of scope
    assert [(e.instance_path, e.error_tag) for e in got[3].errors] == [("/v", "raw-member"), ("/odd", "raw-member"), ("/", "raw-type"), ("/box/v/b", "raw-type")]
    assert got[3].doc.v == "2"


def test_round_trip(spark):
    odd = ["  ", "a\r\nb", "<&>\"'", "]]>", "é\t"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string")
    df = rows.select("i", "t", F.struct(F.col("t").alias("v"), F.lit(None).cast("string").alias("v2"), F.struct(F.col("t").alias("v"), F.col("t").alias("w"), F.array("t", "t").alias("l")).alias("box"), F.array().cast(MODEL.root.data_child("e").data_type()).alias("e")).alias("doc"))
    back = MODEL.from_xml(df.select("i", "t", MODEL.to_xml().alias("raw"))).collect()
    for r in back:
        assert (r.doc.v, r.doc.box.v, r.doc.box.w, r.doc.box.l) == (r.t, r.t, r.t, [r.t, r.t]) and not r.errors


def test_large_files_are_split(spark, tmp_path):
    rows = "".join(f'<p:e><p:k>{i}</p:k>{"<!-- pad -->" * 40}</p:e>\n' for i in range(3000))
    (tmp_path / "f.xml").write_text(f'<?xml version="1.0"?>\n<q:all xmlns:q="urn:x" xmlns:p="urn:b">\n{rows}</q:all>\n')
    (tmp_path / "g.xml").write_text('<q:all xmlns:q="urn:x" xmlns:p="urn:a"><p:e><p:k>9000</p:k></p:e></q:all>')
    (tmp_path / "h.xml").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        df = xml.read_rows(spark, str(tmp_path), "p:e", "q:all")
        got = MODEL.from_xml(df).select(F.explode("doc.e").alias("e")).select(F.col("e.k").cast("int").alias("k")).collect()
        assert sorted(r.k for r in got) == list(range(3000))  # g's prefix is another namespace
        assert df.count() == 3001 and df.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)

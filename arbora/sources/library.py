"""Module libraries as documents: read either standard form, convert the newer into the older, and write one from a table of modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SUB = "submodule array<struct<name:string,revision:string>>"
#: The members of both forms that are read.
OLD = f"struct<`module-set-id`:string,module:array<struct<name:string,revision:string,namespace:string,feature:array<string>,`conformance-type`:string,deviation:array<struct<name:string,revision:string>>,{_SUB}>>>"
_IMPORT = f"struct<name:string,revision:string,namespace:string,{_SUB}>"
_MODULE = f"struct<name:string,revision:string,namespace:string,feature:array<string>,deviation:array<string>,{_SUB}>"
NEW = f"struct<`content-id`:string,`module-set`:array<struct<name:string,module:array<{_MODULE}>,`import-only-module`:array<{_IMPORT}>>>,schema:array<struct<name:string,`module-set`:array<string>>>,datastore:array<struct<name:string,schema:string>>>"
MODULES = "name string, revision string, namespace string, features array<string>, conformance string, submodules array<struct<name:string,revision:string>>"


def read_library(docs: DataFrame, raw: str = "raw") -> DataFrame:
    """(name, revision, namespace, features, conformance, submodules) of each module of libraries in the older form.

    An empty revision is an absent one; absent arrays are empty.
    """
    own = F.from_json(F.col(raw), f"`ietf-yang-library:modules-state` {OLD}").getField("ietf-yang-library:modules-state")
    m = docs.select(F.explode(own.getField("module")).alias("m")).select("m.*")
    return m.select(
        "name",
        F.nullif(F.col("revision"), F.lit("")).alias("revision"),
        "namespace",
        F.coalesce("feature", F.array().cast("array<string>")).alias("features"),
        F.col("`conformance-type`").alias("conformance"),
        F.coalesce("submodule", F.array().cast("array<struct<name:string,revision:string>>")).alias("submodules"),
    )


def convert_library(docs: DataFrame, raw: str = "raw", datastore: str | None = None) -> DataFrame:
    """The modules of libraries in the newer form, by joins of datastores, schemas and module sets: see ``MODULES``.

    With ``datastore`` only its schema's sets count.  A module that is implemented somewhere is not also an import.
    """
    lib = docs.select(F.from_json(F.col(raw), f"`ietf-yang-library:yang-library` {NEW}").getField("ietf-yang-library:yang-library").alias("l"))
    stores = lib.select(F.explode("l.datastore").alias("d")).select(F.regexp_replace("d.name", r"\A[^:]*:", "").alias("store"), F.col("d.schema").alias("schema"))
    if datastore is not None:
        stores = stores.filter(F.col("store") == datastore)
    schemas = lib.select(F.explode("l.schema").alias("s")).select(F.col("s.name").alias("schema"), F.explode(F.col("s").getField("module-set")).alias("set"))
    wanted = schemas.join(stores.select("schema").distinct(), "schema", "left_semi").select("set").distinct()
    sets = lib.select(F.explode(F.col("l").getField("module-set")).alias("s")).select(F.col("s.name").alias("set"), "s").join(wanted, "set", "left_semi")

    def members(column: str, conformance: str, features: Column) -> DataFrame:
        m = sets.select(F.explode(F.col("s").getField(column)).alias("m"))
        subs = F.coalesce(F.col("m.submodule"), F.array().cast("array<struct<name:string,revision:string>>"))
        return m.select("m.name", F.nullif(F.col("m.revision"), F.lit("")).alias("revision"), "m.namespace", features.alias("features"), F.lit(conformance).alias("conformance"), subs.alias("submodules"))

    used = members("module", "implement", F.coalesce(F.col("m.feature"), F.array().cast("array<string>")))
    imported = members("import-only-module", "import", F.array().cast("array<string>"))
    both = used.unionByName(imported)
    first = both.groupBy("name", "revision").agg(F.min(F.struct(F.when(F.col("conformance") == "implement", 0).otherwise(1).alias("o"), "namespace", "features", "conformance", "submodules")).alias("x"))
    return first.select("name", "revision", "x.namespace", "x.features", "x.conformance", "x.submodules")


def library_document(modules: DataFrame) -> DataFrame:
    """One library in the older form, as JSON text in ``raw``, from a table of modules (a catalogue, so of bounded size)."""
    revision = F.coalesce("revision", F.lit(""))
    entry = F.struct("name", revision.alias("revision"), "namespace", F.when(F.size("features") > 0, F.array_sort("features")).alias("feature"), F.col("conformance").alias("conformance-type"), F.when(F.size("submodules") > 0, F.col("submodules")).alias("submodule"))
    ids = F.sha1(F.array_join(F.array_sort(F.collect_list(F.concat("name", F.lit("@"), revision))), "").cast("binary"))
    state = modules.agg(ids.alias("id"), F.array_sort(F.collect_list(entry)).alias("m"))
    return state.select(F.to_json(F.struct(F.struct(F.col("id").alias("module-set-id"), F.col("m").alias("module")).alias("ietf-yang-library:modules-state"))).alias("raw"))

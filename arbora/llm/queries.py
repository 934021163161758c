"""The registered queries of this subpackage: thin layers over the operators, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm import blockmax, decontaminate, itq, jaccard, licenses, packing, periodic, pii, rans, runtime, suffixes, superkmers, tokens, toxicity, warc

tokenizer_path = tokens.public_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    runtime.ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = runtime.scratch_path(spark, "tokens")
    rans.write_tokens(_table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=2)
    return rans.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = runtime.scratch_path(spark, "warc")
    warc.write_warc(_table(spark, sf_dir, "pages"), path)
    return warc.read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pii.digest_spans(pii.find_pii(docs.select("doc_id", "text")))


def op6_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model)


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op11_blockmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blockmax.search(blockmax.build_index(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"))


def op12_superkmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = superkmers.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.periodic_runs(_table(spark, sf_dir, "documents"), change=periodic.repeat_tail))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_rans, op2_suffixes, op3_warc, op4_packing, op5_pii, op6_itq, op7_toxicity, op8_jaccard, op9_licenses, op10_winnowing, op11_blockmax, op12_superkmers, op13_periodic, pipeline)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op5_pii": pii.ORACLE_SQL, "op9_licenses": licenses.oracle_sql(), "op3_warc": warc.ORACLE_SQL, "op6_itq": itq.ORACLE_SQL, "op8_jaccard": jaccard.ORACLE_SQL, "op10_winnowing": decontaminate.ORACLE_SQL, "op11_blockmax": blockmax.ORACLE_SQL, "op12_superkmers": superkmers.ORACLE_SQL, "op13_periodic": periodic.ORACLE_SQL}

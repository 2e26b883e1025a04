"""Queries of the training-data problems and the SQL of those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewright.llm import copies, entries, history, language, packing, survivors, tokens
from edgewright.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.found(table(spark, sf_dir, "sources"), table(spark, sf_dir, "merge_relations"))


def p1_by_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of :func:`p1_found`, each load taken in as a batch of its own."""
    return history.found(table(spark, sf_dir, "sources"), table(spark, sf_dir, "merge_relations"), by_load=True)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries.found(*(table(spark, sf_dir, t) for t in ("merge_relations", "lattice_items", "ref_artifacts", "ref_relations")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.found(table(spark, sf_dir, "merge_relations"))


def p5_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.collapsed(table(spark, sf_dir, "merge_relations"))


def _survivor_tables(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [table(spark, sf_dir, t) for t in ("merge_relations", "claim_clusters", "eval_systems", "ref_relations")]


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.found(*_survivor_tables(spark, sf_dir))


def p6_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.survivors(*_survivor_tables(spark, sf_dir))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encoded(table(spark, sf_dir, "documents"))


def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text doesn't come back from its ids: none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = tokens.decoded(tokens.encoded(docs)).withColumnRenamed("text", "again")
    return docs.join(back, "doc_id").where(~F.col("text").eqNullSafe(F.col("again"))).select("doc_id")


def p8_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_containers"))


def p8_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind: containers, tokens and the share of the capacity in use."""
    kinds = table(spark, sf_dir, "pack_containers")
    a = p8_assign(spark, sf_dir).groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("used"))
    return a.join(kinds, "container_kind").groupBy("container_kind").agg(F.count("*").alias("n_containers"), F.sum("used").alias("n_tokens"), (F.sum("used") / F.sum("capacity_tokens")).alias("fill"), F.max(F.col("used") <= F.col("capacity_tokens")).alias("fits"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.found(table(spark, sf_dir, "documents"))


def p9_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.segments(table(spark, sf_dir, "documents")).select("doc_id", "segment_no", "n_segments", "lang", "confidence")


QUERIES = {f.__name__: f for f in (p1_found, p1_by_load, p3_found, p5_found, p5_edges, p6_found, p6_survivors, p7_ids, p7_round_trip, p8_assign, p8_use, p9_found, p9_segments)}

ORACLE = {"p7_round_trip": "select doc_id from documents where false"}

"""Queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import Scratch
from . import copies, levels, linked, neardups, packing, sampling, textforms, tokens
from .components import components_by_decomposition

#: Share and seed of the samples of problem 1.
SAMPLE_SHARE, SAMPLE_SEED = 0.25, 11


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_sample_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampled raw records; deliveries arrive in two halves, which makes no difference to the sample."""
    raw = _table(spark, sf_dir, "raw").select("raw_no", "id", "delivery")
    arrivals = [F.col("delivery") <= 6, F.lit(True)]
    found = sampling.grown_sample(raw, arrivals, F.col("id"), F.col("raw_no"), SAMPLE_SHARE, Scratch(spark, "p1"), SAMPLE_SEED)
    return found.select("raw_no", "id", F.round("u", 12).alias("u"))


def p1_sample_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = _table(spark, sf_dir, "cases").select("case_no", F.col("_meta.group_key").alias("group_key"))
    found = sampling.grown_sample(cases, [F.lit(True)], F.col("group_key"), F.col("case_no"), SAMPLE_SHARE, Scratch(spark, "p1"), SAMPLE_SEED)
    return found.select("case_no", "group_key", F.round("u", 12).alias("u"))


def p2_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textforms.canonical_texts(_table(spark, sf_dir, "raw")).select("raw_no", "text", "question", "instruction")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textforms.same_look_pairs(_table(spark, sf_dir, "raw"), Scratch(spark, "p2"))


def p3_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked.case_components(_table(spark, sf_dir, "cases"), Scratch(spark, "p3"), components_by_decomposition).select("case_no", "component_no")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked.spanning_components(_table(spark, sf_dir, "cases"), Scratch(spark, "p3"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardups.similar_groups(_table(spark, sf_dir, "raw"), Scratch(spark, "p4"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardups.similar_pairs(_table(spark, sf_dir, "raw"), Scratch(spark, "p4"))


def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked.assign_splits(_table(spark, sf_dir, "cases"), Scratch(spark, "p5"), giant=None)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked.split_conflicts(_table(spark, sf_dir, "cases"), _table(spark, sf_dir, "groups"), Scratch(spark, "p5"))


def p6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.collapsed(_table(spark, sf_dir, "raw"), Scratch(spark, "p6"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.copy_pairs(_table(spark, sf_dir, "raw"), Scratch(spark, "p6"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_texts(_table(spark, sf_dir, "documents"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_tokens(_table(spark, sf_dir, "documents"), Scratch(spark, "p8"))


def p8_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold for every document with a text: its pieces follow each other from its first token to its last, only
    one longer than a container is cut, and no container of its holds more than its capacity."""
    return packing.placed(_table(spark, sf_dir, "documents"), Scratch(spark, "p8")).select("doc_id", "whole", F.lit(2048).alias("capacity"))


def p9_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return levels.reading_levels(documents, levels.fit_levels(documents, _table(spark, sf_dir, "doc_grades")))


def p9_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    fitted = levels.fit_levels(documents, _table(spark, sf_dir, "doc_grades"))
    return levels.level_profile(documents, levels.reading_levels(documents, fitted))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (p1_sample_raw, p1_sample_cases, p2_forms, p2_found, p3_components, p3_found, p4_groups, p4_found, p5_splits, p5_found, p6_records, p6_found, p7_ids, p8_containers, p8_placed, p9_levels, p9_profile)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries it can express; the others are held against brute force in tests/llm."""
    from .oracles import SQL

    return dict(SQL)

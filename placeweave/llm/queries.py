"""The queries of this subpackage, each over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.llm import addresses, leakage, lookalikes, matching, names, tokens, toxicity
from placeweave.session import load

Query = Callable[[SparkSession, str], DataFrame]


def p1_matches(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of guide row and candidate with the confidence that both are one restaurant."""
    tables = ("guide_rows", "place_candidates", "matcher_cases", "target_urls", "char_readings", "house_directory")
    return matching.matched_places(*(load(spark, d, t) for t in tables))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_matches(spark, d).select("row_id", "cand_id")


def p2_links(spark: SparkSession, d: str) -> DataFrame:
    """Records and the houses their names stand for, with the similarity."""
    guide, candidates = load(spark, d, "guide_rows"), load(spark, d, "place_candidates")
    directory = load(spark, d, "house_directory")
    records = guide.select(F.col("row_id").alias("rec_id"), F.array("name", "name_local").alias("names")).unionByName(candidates.select(F.col("cand_id").alias("rec_id"), F.array("name").alias("names")))
    places = guide.select("city").unionByName(load(spark, d, "target_urls").select(F.col("label").alias("city")))
    return names.linked_names(records, directory, places, guide.select("cuisine").unionByName(directory.select("cuisine")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_links(spark, d).select("rec_id", "house_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of guide row and candidate at one location."""
    return addresses.same_location(*(load(spark, d, t) for t in ("guide_rows", "place_candidates", "target_urls", "char_readings")))


def _values(spark: SparkSession, d: str) -> DataFrame:
    guide = load(spark, d, "guide_rows")
    one = lambda df, rec, field: df.select(F.col(rec).alias("rec_id"), F.lit(field).alias("field_name"), F.col(field).alias("value"))
    return one(guide, "row_id", "name").unionByName(one(guide, "row_id", "address")).unionByName(one(load(spark, d, "place_candidates"), "cand_id", "name"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.deviating_values(_values(spark, d)).select("rec_id", "field_name")


def p5_forms(spark: SparkSession, d: str) -> DataFrame:
    """The deviating values with their consistent form and skeleton."""
    return lookalikes.deviating_values(_values(spark, d)).select("rec_id", "field_name", "value", "form", "skeleton")


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """Values by skeleton, with the form most rows of each agree on."""
    return lookalikes.spelling_groups(_values(spark, d))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(load(spark, d, "documents"))


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the items they hold, with the longest stretch."""
    return leakage.leaked_items(load(spark, d, "documents"), load(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).select("doc_id", "item_id").distinct()


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Per item: the documents that hold it."""
    return p7_leaks(spark, d).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("n_words").alias("longest"))


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its score."""
    return toxicity.scored_documents(load(spark, d, "documents"), load(spark, d, "doc_labels"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_scores(spark, d).where("flagged").select("doc_id")


def p8_sources(spark: SparkSession, d: str) -> DataFrame:
    """Per source: documents, flagged ones and their rate."""
    return toxicity.source_rates(p8_scores(spark, d))


def queries() -> dict[str, Query]:
    found = (p1_found, p1_matches, p2_found, p2_links, p4_found, p5_found, p5_forms, p5_groups, p6_ids, p7_found, p7_leaks, p7_items, p8_found, p8_scores, p8_sources)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """None: characters, similarity, compression and automata are beyond SQL; tests compare with brute force instead."""
    return {}

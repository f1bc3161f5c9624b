"""Checkpoints of page runs: what is saved, read back and resumed."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.functions.text import slug, text
from placeweave.sources.files import checkpoint_state

VERSION = 1


def level_counts(rows: DataFrame, run: str, level: str, levels: tuple[str, ...]) -> DataFrame:
    """`rows_per_level` of each run: a map from every level, in order, to its number of rows, 0 where it has none."""
    n = rows.groupBy(run).agg(*(F.count_if(F.col(level) == v).cast("int").alias(f"__{i}") for i, v in enumerate(levels)))
    return n.select(run, F.create_map(*(x for i, v in enumerate(levels) for x in (F.lit(v), F.col(f"__{i}")))).alias("rows_per_level"))


def _document(start: Column) -> Column:
    """The state as JSON, its keys in alphabetical order."""
    return F.to_json(
        F.struct(
            F.col("estimated_total_pages"), F.col("page_number").alias("last_page_number"), F.col("page_url").alias("last_page_url"), F.col("next_page_number"), F.col("next_url"), F.col("rows_per_level"),
            start.alias("start_url"), F.col("synced_row_keys"), F.col("total_restaurants"), F.lit(VERSION).alias("version"),
        ),
        {"ignoreNullFields": "false"},
    )


def saved_checkpoints(pages: DataFrame, run: str, start: str, counts: DataFrame, synced: DataFrame, key: str) -> DataFrame:
    """One row per run: its checkpoint as JSON text `value`, null where its last page had no next one, which clears it.

    `pages` have the run, its `start`, page_number, page_url, next_url,
    next_page_number, estimated_total_pages and total_restaurants, `counts` the run and
    `rows_per_level`, `synced` the run and the `key` of each row done. The last page a
    run completed counts; of repeated pages that of the greatest total.
    """
    rest = [c for c in pages.columns if c != run]
    last = pages.groupBy(run).agg(F.max_by(F.struct(*rest), F.struct("page_number", "total_restaurants")).alias("p")).select(run, "p.*")
    keys = synced.where(F.col(key).isNotNull()).groupBy(run).agg(F.sort_array(F.collect_set(key)).alias("synced_row_keys"))
    joined = last.join(counts, run, "left").join(keys, run, "left").withColumn("synced_row_keys", F.coalesce("synced_row_keys", F.array().cast("array<string>")))
    return joined.select(run, start, F.when(text("next_url") != "", _document(F.col(start))).alias("value"))


def interrupted_checkpoints(pages: DataFrame, run: str, start: str, counts: DataFrame, synced: DataFrame, key: str) -> DataFrame:
    """As `saved_checkpoints`, of runs that stopped on a page: the next page is that page itself, which is read again."""
    again = pages.withColumn("next_url", F.col("page_url")).withColumn("next_page_number", F.col("page_number"))
    return saved_checkpoints(again, run, start, counts, synced, key)


def write_checkpoint(document: str, path: str, spark) -> None:
    """Writes one checkpoint so that a reader sees the old or the new one, whole."""
    jvm = spark.sparkContext._jvm
    target, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(beside, True)
    try:
        out.write(bytearray(document.encode() + b"\n"))
    finally:
        out.close()
    fs.delete(target, False)
    fs.rename(beside, target)


def clear_checkpoint(path: str, spark) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, False)


def resume_plans(runs: DataFrame, start: str, value: str, levels: tuple[str, ...], ignore: Column | None = None) -> DataFrame:
    """The runs with the plan to go on by: from, page, pages, restaurants, rows of each level and keys done, and the `warning` that made it start afresh.

    A run whose checkpoint is missing, faulty, of another start, or ignored begins at
    its start with nothing done. Levels a checkpoint doesn't name have no rows.
    """
    states = checkpoint_state(runs, value, F.col(start))
    none = F.coalesce(ignore, F.lit(False)) if ignore is not None else F.lit(False)
    s = lambda n: F.when(~none, F.col(f"state.{n}"))
    counts = F.create_map(*(x for v in levels for x in (F.lit(v), F.coalesce(F.try_element_at(s("rows_per_level"), F.lit(v)), F.lit(0)))))
    return states.select(
        *runs.columns, F.coalesce(s("next_url"), F.col(start)).alias("start_scrape_url"), F.coalesce(s("next_page_number"), F.lit(1)).alias("start_page_number"), s("estimated_total_pages").alias("start_estimated_total_pages"),
        F.coalesce(s("total_restaurants"), F.lit(0)).alias("initial_total_restaurants"), counts.alias("row_counts"), F.coalesce(s("synced_row_keys"), F.array().cast("array<string>")).alias("done_keys"),
        F.when(none, "ignored").when(text(value) != "", F.col("warning")).alias("warning"),
    )


def state_path(directory: Column | str, scope: Column | str, kind: str = "checkpoint") -> Column:
    """The file of a scope's state: its slug, what it is, and the form; in the default folder where none is given."""
    base = F.coalesce(F.nullif(F.regexp_replace(F.trim(text(directory)), "/+$", ""), F.lit("")), F.lit(".placeweave-state"))
    endings = {"checkpoint": "-checkpoint.json", "errors": "-errors.jsonl", "page": "-page.html"}
    return F.concat(base, F.lit("/"), slug(scope, "places"), F.lit(endings[kind]))

"""Where rows go without a live list: dry runs, probes and reports of failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.operators.redaction import safe_to_write


def dry_run(rows: DataFrame) -> DataFrame:
    """Adds `status`: every row is skipped, repeated ones as well."""
    return rows.withColumn("status", F.lit("skipped"))


def probed(rows: DataFrame, accepted: Column) -> DataFrame:
    """Adds `status` of rows that are only matched: skipped where a candidate is accepted, else failed. Repeated rows are each matched."""
    return rows.withColumn("status", F.when(F.coalesce(accepted, F.lit(False)), "skipped").otherwise("failed"))


def write_error_report(failures: DataFrame, path: str) -> None:
    """Failures as lines of JSON, in place of what the path held; null fields are left out."""
    failures.write.mode("overwrite").json(path)


def write_pages(pages: DataFrame, path: str, content: str = "content") -> None:
    """Pages redacted and written; one that still shows a secret stops the whole write."""
    safe_to_write(pages, content).write.mode("overwrite").parquet(path)

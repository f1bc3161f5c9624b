"""Incremental routing of arriving rows into bucketed, idempotent tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from placeweave.operators.ordering import budgeted, first_wins


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table at the path, or an empty one before its first write."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    exists = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).parquet(path) if exists else spark.createDataFrame([], schema)


def write_once(batch: DataFrame, batch_id: int, path: str) -> None:
    """Writes the batch under its number: done again after a failure it replaces what it wrote before."""
    batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def sync_batch(rows: DataFrame, batch_id: int, out: str, keys: list[str], order: list, accept: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The batch's rows with `status`: keys added by earlier batches, or before in this one, are skipped.

    `accept` adds the column `accepted`. Keys added before are read from what
    earlier batches wrote, so that a batch replayed after a failure sees the same.
    """
    spark = rows.sparkSession
    scored = first_wins(accept(rows), keys, order, F.col("accepted"))
    names = scored.columns
    before = _read(spark, out, T.StructType([*scored.schema.fields, T.StructField("batch_id", T.IntegerType())])).where((F.col("batch_id") < batch_id) & (F.col("status") == "added")).select(*keys).distinct()
    seen = scored.join(before.withColumn("__seen", F.lit(True)), keys, "left")
    return seen.withColumn("status", F.when(F.col("__seen"), "skipped").otherwise(F.col("status"))).select(*names)


def start_sync(
    stream: DataFrame, out: str, checkpoint: str, keys: list[str], order: list, accept: Callable[[DataFrame], DataFrame], budget: tuple[list[str], int] | None = None, on_failures: Callable[[DataFrame, int], None] | None = None
) -> StreamingQuery:
    """Runs the stream until what is there is done; each batch is ordered, deduplicated and written once.

    `budget` are the columns of a page and how many of its first rows are accepted at
    all; the others are skipped. `on_failures` is given the failed rows of each batch
    as they were written, with its number; a batch done again is given again.
    """

    def limited(rows: DataFrame) -> DataFrame:
        if budget is None:
            return rows
        return budgeted(rows, budget[0], order, budget[1])

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = limited(batch)
        if budget is not None:
            inside = sync_batch(rows.where("in_budget"), batch_id, out, keys, order, accept)
            beyond = accept(rows.where("not in_budget")).withColumn("status", F.lit("skipped"))
            done = inside.unionByName(beyond.select(*inside.columns))
        else:
            done = sync_batch(rows, batch_id, out, keys, order, accept)
        write_once(done, batch_id, out)
        if on_failures is not None:
            on_failures(batch.sparkSession.read.schema(done.schema).parquet(f"{out}/batch_id={batch_id}").where("status = 'failed'"), batch_id)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, key: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts per window and key of a stream, events later than the watermark left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))

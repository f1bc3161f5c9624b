"""Row files, catalogues, labelled cases, page folders and checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeweave.functions.text import text

_S = T.StringType()
PROBE = T.StructType([T.StructField(n, _S) for n in ("Name", "NameLocal", "City", "Address", "Cuisine", "Description", "Rating", "LevelSlug", "Latitude", "Longitude")] + [T.StructField("__bad", _S)])
CHECKPOINT = T.StructType(
    [T.StructField("version", T.IntegerType()), T.StructField("start_url", _S), T.StructField("last_page_number", T.IntegerType()), T.StructField("last_page_url", _S), T.StructField("next_url", _S), T.StructField("next_page_number", T.IntegerType()), T.StructField("estimated_total_pages", T.IntegerType()), T.StructField("total_restaurants", T.IntegerType()), T.StructField("rows_per_level", T.MapType(_S, T.IntegerType())), T.StructField("synced_row_keys", T.ArrayType(_S))]
)


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON-lines file with `line_no`; blank lines are skipped, a line that is no object or has no name is an error with its number."""
    return parsed_rows(numbered_lines(spark, path))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file, or of a folder's in order of their names, with `line_no` from 1.

    A file is read in splits; lines are counted within each partition and numbered
    from the counts of those before, so that no task holds a whole file.
    """
    lines = spark.read.text(path).withColumn("__id", F.monotonically_increasing_id())
    part = F.shiftright("__id", 33)
    sizes = lines.groupBy(part.alias("__part")).count()
    ahead = sizes.agg(F.sort_array(F.collect_list(F.struct("__part", "count"))).alias("s"))  # one entry per partition
    before = ahead.select(F.posexplode("s").alias("i", "x"), "s").select(F.col("x.__part").alias("__part"), F.aggregate(F.slice("s", F.lit(1), F.col("i")), F.lit(0).cast("long"), lambda acc, y: acc + y["count"]).alias("__before"))
    numbered = lines.withColumn("__part", part).join(before, "__part")
    return numbered.select((F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("int").alias("line_no"), F.regexp_replace("value", "\r$", "").alias("line"))


def parsed_rows(lines: DataFrame) -> DataFrame:
    parsed = lines.where(F.trim(text("line")) != "").withColumn("r", F.from_json("line", PROBE, {"columnNameOfCorruptRecord": "__bad"}))
    fault = F.when(F.col("r").isNull() | F.col("r.__bad").isNotNull() | ~F.trim("line").startswith("{"), "not a JSON object").when(F.trim(text("r.Name")) == "", "no Name")
    checked = F.when(fault.isNotNull(), F.raise_error(F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(": "), fault)).cast("string")).otherwise(F.col("r.Name"))
    return parsed.select("line_no", checked.alias("Name"), *(f"r.{n}" for n in PROBE.names[1:-1]))


def catalogue_rows(documents: DataFrame, column: str) -> DataFrame:
    """Entries of a catalogue given as JSON of language, kind, slug and entry; nodes of other types are left out."""
    entry = T.StructType([T.StructField(n, _S) for n in ("status", "source", "url", "reason")])
    texts = T.MapType(_S, _S)
    # Level by level, so that a node of another type is lost alone.
    step = documents.select(F.explode(F.from_json(column, texts)).alias("lang", "kinds"))
    step = step.select("lang", F.explode(F.from_json("kinds", texts)).alias("kind", "entries"))
    step = step.select("lang", "kind", F.explode(F.from_json("entries", texts)).alias("slug", "e")).where(F.trim("e").startswith("{"))
    return step.withColumn("e", F.from_json("e", entry)).select("lang", "kind", "slug", "e.*")


def catalogue_json(entries: DataFrame) -> DataFrame:
    """The catalogue as one JSON text with sorted keys; a bounded table."""
    fields = F.struct("status", "source", "url", "reason")
    _by_key = lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)
    by = lambda df, group, key, value: df.groupBy(*group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), value.alias("v"))), _by_key)).alias("m"))
    kinds = by(entries, ["lang", "kind"], "slug", fields)
    return by(by(kinds, ["lang"], "kind", F.col("m")), [], "lang", F.col("m")).select(F.to_json("m").alias("value"))


def page_chain(pages: DataFrame, start: str, max_pages: int = 1000) -> DataFrame:
    """Pages in the order their links have, from the start, each once: `page_seq`, `url`.

    `pages` have `url` and `next_url`. The chain ends at a page that is missing, has
    no next one or was met before. Links are followed by doubling, so that a chain
    of n pages takes log n joins.
    """
    first = pages.where(F.col("url").isNotNull()).groupBy("url").agg(F.min("next_url").alias("next_url"))
    hops = first.join(first.select(F.col("url").alias("next_url")), "next_url", "left_semi").select("url", F.col("next_url").alias("to"))
    reached = first.where(F.col("url") == start).select("url", F.lit(0).alias("page_seq"))
    span = 1
    while span < max_pages:
        step = reached.join(hops, "url").select(F.col("to").alias("url"), (F.col("page_seq") + span).alias("page_seq"))
        reached = reached.unionByName(step).groupBy("url").agg(F.min("page_seq").alias("page_seq"))
        a, b = hops.alias("a"), hops.alias("b")
        hops = a.join(b, F.col("a.to") == F.col("b.url")).select("a.url", "b.to")
        span *= 2
    return reached.where(F.col("page_seq") < max_pages)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """HTML files of a folder as `path` and `html`, in order of their names; files that aren't UTF-8 are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("html")).where("html is not null").orderBy("path")


def checkpoint_state(documents: DataFrame, column: str, start_url: str | Column) -> DataFrame:
    """`state` and `warning` of each checkpoint text: what is wrong with it starts afresh, with the first fault named."""
    s = lambda n: F.col(f"s.{n}")
    parsed = documents.withColumn("s", F.from_json(F.col(column), CHECKPOINT, {"mode": "PERMISSIVE"}))
    whole = lambda c, least: c.isNotNull() & (c >= least)
    warning = (
        F.when(F.trim(text(column)) == "", "empty")
        .when(s("version").isNull(), "unreadable")
        .when(s("version") != 1, "other version")
        .when(text(s("start_url")) != start_url, "other start")
        .when(text(s("next_url")) == "", "no next page")
        .when(~whole(s("next_page_number"), 1), "bad page number")
        .when(~whole(s("total_restaurants"), 0), "bad total")
        .when(s("rows_per_level").isNull() | F.exists(F.map_values(s("rows_per_level")), lambda v: v.isNull() | (v < 0)), "bad counts")
        .when(s("estimated_total_pages").isNotNull() & (s("estimated_total_pages") < 1), "bad estimate")
    )
    return parsed.select(*documents.columns, F.when(warning.isNull(), F.col("s")).alias("state"), warning.alias("warning"))


def numbered(rows: DataFrame, page: str, order: list[Column]) -> DataFrame:
    """Adds `card_ord`, the row's place on its page."""
    return rows.withColumn("card_ord", F.row_number().over(Window.partitionBy(page).orderBy(*order)) - 1)

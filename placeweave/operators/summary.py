"""Counts by bucket, histograms, best rejected candidates and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeweave.functions.text import text


def bucket_counts(rows: DataFrame, buckets: tuple[str, ...], counts: dict[str, Column]) -> DataFrame:
    """One row per bucket, in order, with each count, 0 where a bucket has no rows."""
    spark = rows.sparkSession
    every = spark.createDataFrame([(b, i) for i, b in enumerate(buckets)], "bucket string, bucket_ord int")
    found = rows.groupBy("bucket").agg(*(F.count_if(c).alias(n) for n, c in counts.items()))
    return every.join(found, "bucket", "left").na.fill(0, list(counts))


def reason_histogram(rows: DataFrame, reason: str, order: Column, top: int = 8) -> DataFrame:
    """The most frequent reasons with their number; of equal ones that seen first."""
    return rows.groupBy(F.col(reason).alias("reason")).agg(F.count("*").alias("n"), F.min(order).alias("first_seen")).orderBy(F.desc("n"), "first_seen").limit(top)


def best_rejected(pairs: DataFrame, row: list[str], score: Column, name: Column, order: Column) -> DataFrame:
    """Per row the refused candidate of highest score, then longest name, then first."""
    rest = [c for c in pairs.columns if c not in row]
    return pairs.groupBy(*row).agg(F.max_by(F.struct(*rest), F.struct(score, F.length(name), -order)).alias("best")).select(*row, *(F.col(f"best.{c}").alias(c) for c in rest))


def review_score(match_score: Column, name_match: Column, veto: Column, same_house: Column, house_conflict: Column, named: Column, food: Column, shared: Column) -> Column:
    """How worth a look a refused candidate is."""
    yes = lambda c, v: F.when(c, v).otherwise(0)
    return match_score.cast("int") + yes(name_match, 100) + yes(veto, -60) + yes(same_house, 50) + yes(house_conflict, -80) + F.when(named, 30).otherwise(-100) + yes(food, 20) + shared


def session_totals(counts: DataFrame, before: str, now: str) -> DataFrame:
    """Adds `session`, the rows of this session, and an overall `exit_code`: 1 where anything failed."""
    return counts.withColumn("session", F.greatest(F.col(now) - F.col(before), F.lit(0)))


def running_maximum(rows: DataFrame, group: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds the greatest value so far, so that progress never falls back."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.max(value).over(w))


def final_summary(counts: DataFrame) -> DataFrame:
    """One row of a run's totals: rows scraped in this session, added, skipped and failed, `hard_failure` where rows failed and none was added, and the exit code.

    `counts` have a row per bucket with scraped, before, added, skipped and failed.
    """
    total = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("scraped", "before", "added", "skipped", "failed")))
    hard = (F.col("failed") > 0) & (F.col("added") == 0)
    return total.select("scraped", F.greatest(F.col("scraped") - F.col("before"), F.lit(0)).alias("session"), "added", "skipped", "failed", hard.alias("hard_failure"), F.when(F.col("failed") > 0, 1).otherwise(0).alias("exit_code"))


def run_metrics(rows: DataFrame, page: str, status: Column) -> DataFrame:
    """One row: rows and pages of a run, rows skipped and rows unsupported."""
    return rows.agg(F.count("*").alias("total_rows"), F.count_distinct(page).alias("processed_pages"), F.count_if(status == "skipped").alias("skipped_rows"), F.count_if(status == "unsupported").alias("unsupported_rows"))


def partial_totals(rows: DataFrame, order: Column, at: Column, status: str) -> DataFrame:
    """One row of what was done before an interruption: rows up to `at`, and those added, failed and skipped."""
    done = rows.where(order <= at)
    return done.agg(F.count("*").alias("scraped"), *(F.count_if(F.col(status) == s).alias(s) for s in ("added", "failed", "skipped")))


def gram_counts(texts: DataFrame, key: str, compact: Column, sizes: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """Each text's grams of the sizes with the number of times they count: once for each size that has them, so that a text shorter than several sizes counts for each."""
    from placeweave.functions.text import ngrams

    grams = texts.select(key, F.explode(F.array(*(ngrams(compact, n) for n in sizes))).alias("g")).select(key, F.explode("g").alias("gram"))
    return grams.groupBy(key, "gram").agg(F.count("*").alias("n"))


def estimated_progress(page: Column, card: Column, cards: Column, pages: Column, expected: Column, so_far: Column, scraped: Column) -> Column:
    """The share of a run that is done: by its number of items, 0.99 at most, else by its pages; null where neither is known."""
    by_items = F.least(F.lit(0.99), (so_far + scraped + card / F.greatest(F.lit(1), cards)) / expected)
    return F.when(expected > 0, by_items).when((pages > 0) & (cards > 0), (page - 1 + card / cards) / pages)


def overall_progress(rows: DataFrame, run: list[str], order: list[Column], crawled: Column, synced: Column, expected: Column, name: str = "progress") -> DataFrame:
    """Adds a run's progress, which never falls: a twentieth for setting up, the rest by what is crawled or synced, whichever is more."""
    share = F.greatest(F.coalesce(crawled, F.lit(0.0)), F.coalesce(synced / F.when(expected > 0, expected), F.lit(0.0)))
    return running_maximum(rows, run, order, F.least(F.lit(1.0), 0.05 + 0.95 * share), name)


def reported_steps(rows: DataFrame, run: list[str], order: list[Column], progress: str, steps: int = 20) -> DataFrame:
    """The rows at which progress enters a new one of so many steps; what a log without a screen shows."""
    step = F.floor(F.col(progress) * steps)
    before = F.lag(step).over(Window.partitionBy(*run).orderBy(*order))
    return rows.where("true").withColumn("step", step).withColumn("__b", before).where(F.col("__b").isNull() | (F.col("step") > F.col("__b"))).drop("__b")


def fresh_state(before: str, now: str, elapsed: Column, settle: Column, loaded: Column) -> Column:
    """Whether a panel shows the answer to the last search and not the one before it.

    Both states have page_url, title, first_result, no_results and loading. Nothing
    found, or still loading within the time to settle, is not fresh; another first
    result or title is; another address is after that time; without any change only
    a panel that was seen loading and shows a result where there was none.
    """
    b, n = (lambda f: text(F.col(f"{before}.{f}"))), (lambda f: text(F.col(f"{now}.{f}")))
    flag = lambda f: F.coalesce(F.col(f"{now}.{f}"), F.lit(False))
    new = lambda f: (n(f) != "") & (n(f) != b(f))
    settled = elapsed >= settle
    return F.when(flag("no_results") | (flag("loading") & ~settled), False).when(new("first_result") | new("title"), True).when(new("page_url") & settled, True).when(~loaded | ~settled, False).otherwise((n("first_result") != "") & (b("first_result") == ""))


def first_of(rows: DataFrame, order: list[Column], total: int = 20) -> DataFrame:
    """The first so many failures in order, with `rank`; a list to look at."""
    return rows.orderBy(*order).limit(total).withColumn("rank", F.row_number().over(Window.orderBy(*order)))

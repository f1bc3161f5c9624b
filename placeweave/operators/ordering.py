"""First-wins duplicates, budgets, limits and top-k, all with explicit orders."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeweave.session import cut, freed


def first_wins(rows: DataFrame, key: list[str], order: list[Column], accepted: Column) -> DataFrame:
    """Adds `status`: the first accepted row of a key is added, earlier ones failed, later ones skipped.

    Null keys are keys like others. Two window functions over one shuffle.
    """
    before = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.max(accepted.cast("int")).over(before), F.lit(0)) == 1
    return rows.withColumn("status", F.when(done, "skipped").when(F.coalesce(accepted, F.lit(False)), "added").otherwise("failed"))


def budgeted(rows: DataFrame, group: list[str], order: list[Column], limit: int) -> DataFrame:
    """Adds `in_budget`: whether the row is among the group's first `limit`; 0 sets no limit."""
    if limit <= 0:
        return rows.withColumn("in_budget", F.lit(True))
    return rows.withColumn("in_budget", F.row_number().over(Window.partitionBy(*group).orderBy(*order)) <= limit)


def top_k(rows: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group with their `rank`; Spark keeps k per task before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def sample_rows(rows: DataFrame, order: list[Column], n: int = 5) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def page_limited(rows: DataFrame, page: str, pages: int) -> DataFrame:
    """Rows of the first so many pages; no window over all rows, but the smallest page numbers of a distinct list."""
    kept = rows.select(page).where(F.col(page).isNotNull()).distinct().orderBy(page).limit(pages)
    return rows.join(F.broadcast(kept), page, "left_semi")


def not_done(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among those done; null keys are never done."""
    return rows.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def already_done(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return rows.join(done.select(key).distinct(), key, "left_semi")


def first_acceptable(pairs: DataFrame, row: list[str], order: list[Column], accepted: Column) -> DataFrame:
    """Per row the pair that is accepted first in order, with `n_before`, the pairs refused before it; rows without any have a null pair.

    Two aggregates with partial results, no sort: a row with most of the pairs is
    no more than one row of either shuffle. `order` must tell the pairs of a row apart.
    """
    rest = [c for c in pairs.columns if c not in row]
    ordered = pairs.withColumn("__o", F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))).withColumn("__a", F.coalesce(accepted, F.lit(False)))
    best = ordered.groupBy(*row).agg(F.min_by(F.when(F.col("__a"), F.struct("__o", *rest)), F.when(F.col("__a"), F.col("__o"))).alias("__hit"), F.count("*").alias("n_pairs"))
    same = [f"__k{i}" for i in range(len(row))]
    key = best.where(F.col("__hit").isNotNull()).select(*(F.col(c).alias(k) for c, k in zip(row, same)), F.col("__hit.__o").alias("__first"))
    on = [ordered[c].eqNullSafe(key[k]) for c, k in zip(row, same)]
    before = ordered.join(key, on).where(F.col("__o") < F.col("__first")).groupBy(*same).agg(F.count("*").alias("__before"))
    out = best.join(before, [best[c].eqNullSafe(before[k]) for c, k in zip(row, same)], "left")
    n = F.when(F.col("__hit").isNull(), F.col("n_pairs")).otherwise(F.coalesce("__before", F.lit(0)))
    return out.select(*row, *(F.col(f"__hit.{c}").alias(c) for c in rest), "n_pairs", n.alias("n_before"))


def first_listed(asked: DataFrame, entries: DataFrame, row: str, no: str, name: str, order: list[str], accepted: Callable[[DataFrame], DataFrame], first: int = 2, growth: int = 8) -> DataFrame:
    """Per `row` the entry accepted first of the lists it asks for, with `n_pairs`, all entries of its lists, and `n_before`, those before it; rows without any have a null entry, those without lists don't come out.

    `asked`: row, the list's `no` in the row, its `name`, and what else `accepted`
    needs; `entries`: the lists' `name`, the columns of `order`, and more. `accepted`
    gets pairs of both and returns those it accepts, with columns of its own. Lists are gone through whole, by
    rounds: the `first` entries of each row, then up to `growth` times as many for rows
    that have none accepted yet, until no row has entries left. So an entry is given
    to `accepted` only where those well before it were refused, and all are counted.
    Equal askings count as often as they come; null rows and names ask for nothing.
    """
    asked = asked.where(F.col(row).isNotNull()).groupBy(*asked.columns).agg(F.count("*").alias("__times"))
    rest = [c for c in entries.columns if c != name]
    listed = entries.join(asked.select(name).distinct(), name, "left_semi")
    of = Window.partitionBy(name)
    # Entries that the order leaves open follow by their other columns; none of them is before another.
    listed = cut(listed.withColumns({"__at": F.row_number().over(of.orderBy(*order, *(c for c in rest if c not in order))), "__below": F.rank().over(of.orderBy(*order)) - 1}))
    sizes = listed.groupBy(name).agg(F.max("__at").cast("long").alias("__n"))
    behind = Window.partitionBy(row).orderBy(no, *(c for c in asked.columns if c not in (row, no))).rowsBetween(Window.unboundedPreceding, -1)
    asked = asked.join(sizes, name)
    asked = cut(asked.withColumns({"__start": F.coalesce(F.sum("__n").over(behind), F.lit(0)), "__before": F.coalesce(F.sum(F.col("__n") * F.col("__times")).over(behind), F.lit(0))}))
    left, low, high, hits = asked, 0, first, []
    while True:
        begin, end = F.greatest(low - F.col("__start"), F.lit(0)) + 1, F.least(high - F.col("__start"), F.col("__n"))
        met = left.where(begin <= end).withColumn("__at", F.explode(F.sequence(begin.cast("int"), end.cast("int")))).join(listed, [name, "__at"])
        found = accepted(met)
        kept = [*rest, *(c for c in found.columns if c not in met.columns)]
        found = found.groupBy(row).agg(F.min_by(F.struct(*kept, (F.col("__before") + F.col("__times") * F.col("__below")).alias("n_before")), F.col("__start") + F.col("__at")).alias("__hit"))
        hits.append(cut(found))
        after = cut(left.where(F.col("__start") + F.col("__n") > high).join(hits[-1], row, "left_anti"))
        if left is not asked:
            freed(left)
        left, low, high = after, high, high * growth
        if left.isEmpty():
            break
    totals = asked.groupBy(row).agg(F.sum(F.col("__n") * F.col("__times")).alias("n_pairs"))
    out = totals.join(reduce(DataFrame.unionByName, hits), row, "left")
    return out.select(row, *(F.col(f"__hit.{c}").alias(c) for c in kept), "n_pairs", F.coalesce("__hit.n_before", "n_pairs").alias("n_before"))

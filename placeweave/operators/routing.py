"""Routing rows to buckets, identity keys, and catalogue lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placeweave.functions.text import collapse, text
from placeweave.session import cut

# Levels with their label and badge; levels of stars can share one bucket.
LEVELS = {"one-star": ("1 Star", "⭐"), "two-star": ("2 Stars", "⭐⭐"), "three-star": ("3 Stars", "⭐⭐⭐"), "bib-gourmand": ("Bib Gourmand", "😋"), "selected": ("Selected", "Selected")}
STARS = ("one-star", "two-star", "three-star")
BUCKETS = ("stars", "selected", "bib-gourmand", *STARS)
DEFAULT_BUCKETS = BUCKETS[:3]


def parse_buckets(selection: str | None) -> tuple[str, ...]:
    """The buckets of a comma list, in canonical order; the default three for an empty one. Unknown ones and stars beside single levels of stars are errors."""
    wanted = {part.strip().lower() for part in (selection or "").split(",") if part.strip()}
    if unknown := wanted - set(BUCKETS):
        raise ValueError(f"unknown levels: {', '.join(sorted(unknown))}")
    if "stars" in wanted and wanted & set(STARS):
        raise ValueError("stars can't be combined with single levels of stars")
    return tuple(b for b in BUCKETS if b in wanted) or DEFAULT_BUCKETS


def rating_key(c: Column | str) -> Column:
    return F.lower(collapse(c))


def bucket_table(spark: SparkSession, buckets: tuple[str, ...]) -> DataFrame:
    """`alias` to `bucket`: each level's label, slug and badge; a level not selected maps to its own slug."""
    rows = {}
    for level, (label, badge) in LEVELS.items():
        bucket = "stars" if level in STARS and "stars" in buckets else level
        for alias in (label, level, badge):
            rows[" ".join(alias.lower().split())] = bucket
    return spark.createDataFrame(sorted(rows.items()), "alias string, bucket string")


def route_rows(rows: DataFrame, rating: str, buckets: tuple[str, ...] = DEFAULT_BUCKETS, strict: bool = True) -> DataFrame:
    """Adds `bucket`; rows of known ratings outside the buckets are dropped.

    A rating that is no alias of a level, null and empty ones included, is an error
    when strict and drops the row when not.
    """
    table = F.broadcast(bucket_table(rows.sparkSession, buckets).withColumnRenamed("alias", "__alias"))
    joined = rows.join(table, rating_key(rating) == F.col("__alias"), "left")
    if strict:
        stop = F.raise_error(F.concat(F.lit("unrecognized rating: "), text(rating))).cast("string")
        joined = joined.withColumn("bucket", F.when(F.col("__alias").isNull(), stop).otherwise(F.col("bucket")))
    return joined.drop("__alias").where(F.col("bucket").isin(*buckets))


def route_explicit(rows: DataFrame, explicit: str, rating: str, order: list[Column], buckets: tuple[str, ...] = DEFAULT_BUCKETS) -> DataFrame:
    """Adds `bucket`, the explicit one where given, else by rating, and `bucket_ord`: explicit rows first, then in order."""
    given = F.lower(F.trim(text(explicit)))
    own = F.when(given.isin(*STARS) & F.lit("stars" in buckets), F.lit("stars")).otherwise(given)
    with_given = rows.where(given != "").withColumn("bucket", F.when(own.isin(*buckets), own).otherwise(F.raise_error(F.concat(F.lit("unknown level: "), given)).cast("string"))).withColumn("__e", F.lit(0))
    others = route_rows(rows.where(given == ""), rating, buckets).withColumn("__e", F.lit(1))
    return numbered_within(with_given.unionByName(others), "bucket", [F.col("__e"), *order], "bucket_ord").drop("__e")


def numbered_within(rows: DataFrame, group: str, order: list[Column], name: str, parts: int | None = None) -> DataFrame:
    """Adds the row's number within its group, from 1, in an order that may put most rows into one group.

    Rows are sorted by ranges over all tasks; each is numbered within its range and
    group, and the counts of the ranges before are added, so that no task holds a group.
    """
    parts = parts or rows.sparkSession.sparkContext.defaultParallelism
    sorted_ = rows.repartitionByRange(parts, F.col(group), *order).sortWithinPartitions(group, *order).withColumn("__part", F.spark_partition_id())
    sorted_ = cut(sorted_)
    own = Window.partitionBy("__part", group).orderBy(*order)
    ahead = sorted_.groupBy("__part", group).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = ahead.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))  # one row for each range and group
    out = sorted_.withColumn(name, F.row_number().over(own)).join(ahead.drop("__n"), ["__part", group])
    return out.withColumn(name, (F.col(name) + F.col("__before")).cast("int")).drop("__part", "__before")


def identity_key(*parts: Column) -> Column:
    """SHA-256 of the parts, each lower-case with white space collapsed; null, and a zero coordinate, count as empty."""
    return F.sha2(F.concat_ws("|", *(F.lower(collapse(p)) for p in parts)), 256)


def number_part(c: Column | str) -> Column:
    """A number as identity part: zero and null as empty."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNull() | (c == 0), F.lit("")).otherwise(c.cast("string"))


def resolve_languages(names: DataFrame, column: str, aliases: dict[str, str]) -> DataFrame:
    """Adds `language`: the alias's, else the key itself; blanks and underscores count as hyphens. A blank name is an error."""
    key = F.lower(F.regexp_replace(F.trim(text(column)), r"[_\s]+", "-"))
    table = F.create_map(*[F.lit(x) for kv in sorted(aliases.items()) for x in kv])
    return names.withColumn("language", F.when(key == "", F.raise_error(F.lit("blank language")).cast("string")).otherwise(F.coalesce(F.try_element_at(table, key), key)))


def target_keys(c: Column | str) -> Column:
    return F.lower(F.regexp_replace(F.trim(text(c)), r"[_\s-]+", "-"))


def resolve_targets(requests: DataFrame, column: str, catalogue: DataFrame, languages: list[str]) -> DataFrame:
    """Adds `slug`, `kind`, `status`, `url`, `entry_lang` of the catalogue entry a target names.

    A city's slug or label goes before a country's; of a slug's entries the first in
    the order of `languages` counts, even if it is unsupported: then its `url` is
    null and no other language is tried.
    """
    rank = F.array_position(F.array(*map(F.lit, languages)), F.col("lang"))
    entries = catalogue.where(rank > 0).groupBy("kind", "slug").agg(F.min_by(F.struct("label", "label_local", "status", "url", F.col("lang").alias("entry_lang")), F.struct(rank, "label")).alias("e")).select("kind", "slug", "e.*")
    aliases = entries.withColumn("alias", F.explode(F.array_distinct(F.array(target_keys("slug"), target_keys("label"), target_keys("label_local"))))).where("alias <> ''")
    best = aliases.groupBy("alias").agg(F.min_by(F.struct("kind", "slug", "status", "url", "entry_lang"), F.struct(F.when(F.col("kind") == "city", 0).otherwise(1), "slug")).alias("m"))
    return requests.withColumn("alias", target_keys(column)).join(best, "alias", "left").select(*requests.columns, "m.*")


def localized_url(c: Column | str, country: str, language: str, known_countries: tuple[str, ...]) -> Column:
    """A path with its leading language and country taken off and those given put before it."""
    path = F.filter(F.split(text(c), "/"), lambda x: x != "")
    path = F.when(F.get(path, F.lit(0)) == "en", F.slice(path, 2, F.greatest(F.size(path), F.lit(1)))).otherwise(path)
    path = F.when(F.get(path, F.lit(0)).isin(*known_countries), F.slice(path, 2, F.greatest(F.size(path), F.lit(1)))).otherwise(path)
    return F.concat(F.lit(f"/{country}/{language}/"), F.array_join(path, "/"))


# Sites of languages, languages that stand in for others, and the language of a country.
SITES = {"zh_TW": "tw", "zh_HK": "hk", "ja": "jp", "ko": "kr", "fr": "fr", "de": "de", "es": "es", "it": "it"}
FALLBACKS = {"zh_TW": ("zh_HK",), "zh_HK": ("zh_TW",), "zh_CN": ("zh_TW", "zh_HK")}
LOCAL_LANGUAGES = {
    "jp": "ja", "kr": "ko", "tw": "zh_TW", "hk": "zh_HK", "mo": "zh_HK", "cn": "zh_CN", "th": "th", "vn": "en", "my": "en", "sg": "en", "fr": "fr", "it": "it", "es": "es", "de": "de", "at": "de", "ch": "fr",
    "be": "fr", "nl": "nl", "pt": "pt", "gr": "gr", "tr": "tr", "gb": "en", "ie": "en", "us": "en", "ca": "en", "br": "pt", "ar": "es",
}


def language_order(language: str) -> list[str]:
    """The language and those that stand in for it."""
    return [language, *FALLBACKS.get(language, ())]


def localized_site(language: str) -> tuple[str, str] | None:
    """(site, language) of the first language in order that has a site of its own."""
    return next(((SITES[x], x) for x in language_order(language) if x in SITES), None)


def target_urls(requests: DataFrame, slug: str, code: str, catalogue: DataFrame, language: str, base: str, strict: bool = True) -> DataFrame:
    """Adds `url` and `reason` of each requested target.

    The catalogue's entry in the language, or else in one that stands in for it,
    decides: its address where it is supported, an error where it is not (without
    `strict`, no address and the reason). A target without an entry has the path of the
    language's site, and one whose language has no site the path by its country code.
    """
    rank = F.array_position(F.array(*map(F.lit, language_order(language))), F.col("lang"))
    found = catalogue.where(rank > 0).groupBy(F.col("slug").alias(slug)).agg(F.min_by(F.struct("lang", "status", "url", "reason"), F.struct(rank, "lang")).alias("__e"))
    site = localized_site(language)
    path = F.concat(F.lit(f"{base}/{site[0]}/{site[1]}/selection/"), F.col(slug), F.lit("/restaurants")) if site else F.concat(F.lit(f"{base}/{language}/"), text(code), F.lit("/restaurants"))
    good = (F.col("__e.status") == "supported") & (text("__e.url") != "")
    fault = F.concat(F.lit("no address in "), F.col("__e.lang"), F.lit(" for "), F.col(slug), F.lit(": "), F.coalesce("__e.reason", F.lit("not verified")))
    refused = F.raise_error(fault).cast("string") if strict else F.lit(None).cast("string")
    url = F.when(F.col("__e").isNull(), path).when(good, F.col("__e.url")).otherwise(refused)
    return requests.join(found, slug, "left").select(*requests.columns, url.alias("url"), F.when(F.col("__e").isNotNull() & ~F.coalesce(good, F.lit(False)), fault).alias("reason"))


def city_path(c: Column | str, language: str, known_countries: tuple[str, ...]) -> Column:
    """A city's English path in the language: on its site without the leading country, or with the language in place of the first segment."""
    site = localized_site(language)
    if site:
        return F.regexp_replace(localized_url(c, site[0], site[1], known_countries), "^/", "")
    parts = F.split(text(c), "/")
    rest = F.when(F.size(parts) > 1, F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))).otherwise(parts)
    return F.array_join(F.concat(F.array(F.lit(language)), rest), "/")


def labelled(targets: DataFrame, slug: str, overrides: DataFrame, language: str) -> DataFrame:
    """Adds `shown`: the label that `overrides` (lang, slug, label) have for the language, else the target's own `label`, else its slug in words."""
    own = overrides.where((F.col("lang") == language) & (text("label") != "")).groupBy(F.col("slug").alias(slug)).agg(F.min("label").alias("__label"))
    named = F.array_join(F.transform(F.split(text(slug), "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), " ")
    return targets.join(own, slug, "left").withColumn("shown", F.coalesce("__label", F.nullif(text("label"), F.lit("")), named)).drop("__label")


def local_language(code: Column | str) -> Column:
    """The language of a country's own pages; null where the code is no country's."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in sorted(LOCAL_LANGUAGES.items()) for x in kv)), text(code))


def chosen_scope(listing: Column | str, fallback: Column | str) -> Column:
    """The scope a listing shows, unless it mixes Latin letters with others where the fallback is in another script; the fallback where it shows none."""
    shown, other = text(listing), text(fallback)
    mixed = shown.rlike("[A-Za-z]") & shown.rlike(r"[^\x00-\x7F]") & other.rlike(r"[^\x00-\x7F]")
    return F.when((shown == "") | mixed, other).otherwise(shown)


def discovered_entries(checked: DataFrame, target: str, order: str) -> DataFrame:
    """`status`, `source`, `url` and `reason` of each target from its candidate addresses that were looked at.

    `checked` have the target, the order, candidate, url, ok, detail and title. The
    first that is ok counts; without one the target is unsupported, and the reason
    says why each failed.
    """
    first = F.min_by(F.when(F.col("ok"), F.struct("candidate", "url")), F.when(F.col("ok"), F.col(order)))
    line = F.concat(F.col("candidate"), F.lit(": "), text("detail"), F.lit(" ("), text("title"), F.lit(")"))
    failed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))), lambda x: x["line"]), "; ")
    out = checked.groupBy(target).agg(first.alias("hit"), failed.alias("failed"))
    own = F.when(F.col("hit").isNull(), "live-validation").when(F.col("hit.candidate") == F.col(target), "validated-selection-candidate").otherwise("validated-alternate-selection-candidate")
    return out.select(target, F.when(F.col("hit").isNull(), "unsupported").otherwise("supported").alias("status"), own.alias("source"), F.coalesce("hit.url", F.lit("")).alias("url"), F.when(F.col("hit").isNull(), F.concat(F.lit("no candidate is valid: "), F.col("failed"))).alias("reason"))

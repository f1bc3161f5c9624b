"""Sources as rows of pages: a guide's listings with their details, and imported map files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.functions.text import collapse, text
from placeweave.operators import extraction, predicates, routing
from placeweave.sources.files import page_chain

IMPORTED = "imported"


def imported_page(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Rows of map files as one page without a next: `page_no`, `card_ord` within their file, `next_url` and the number of rows, those that are ok only."""
    from pyspark.sql import Window

    of_file = Window.partitionBy("path")
    return rows.where(F.col("status") == "ok").select("*", F.lit(1).alias("page_no"), (F.row_number().over(of_file.orderBy(*order)) - 1).alias("card_ord"), F.lit(None).cast("string").alias("next_url"), F.count("*").over(of_file).alias("total_rows"))


def import_counts(rows: DataFrame) -> DataFrame:
    """Per file the rows taken, those skipped and those unsupported, and `fault` where none is left."""
    counts = rows.groupBy("path").agg(*(F.count_if(F.col("status") == s).alias(n) for n, s in (("n_rows", "ok"), ("n_skipped", "skipped"), ("n_unsupported", "unsupported"))))
    return counts.withColumn("fault", F.when(F.col("n_rows") == 0, "no importable places"))


def route_imported(rows: DataFrame, buckets: tuple[str, ...]) -> DataFrame:
    """Adds `bucket`: all rows go to the bucket for imports, none where it isn't selected."""
    return rows.withColumn("bucket", F.lit(IMPORTED)).where(F.lit(IMPORTED in buckets))


def crawled(pages: DataFrame, start: str, max_pages: int) -> DataFrame:
    """The chain of pages from the start with `page_seq`, and on its last page `stop`: why it ends there.

    `limit` where max_pages are read, `end` where the page has no next one, `missing`
    where the next one can't be had, `revisited` where it was read before.
    """
    first = pages.where(F.col("url").isNotNull()).groupBy("url").agg(F.min("next_url").alias("next_url"))
    # One page more than allowed tells the limit from an end.
    longer = page_chain(pages, start, max_pages + 1)
    chain = longer.where(F.col("page_seq") < max_pages).join(first, "url")
    following = longer.select(F.col("url").alias("next_url"), F.col("page_seq").alias("__next"))
    known = first.select(F.col("url").alias("next_url"), F.lit(True).alias("__known"))
    out = chain.join(following, "next_url", "left").join(known, "next_url", "left")
    on = F.col("__next") == F.col("page_seq") + 1
    stop = F.when(text("next_url") == "", "end").when(on & (F.col("__next") >= max_pages), "limit").when(on, F.lit(None)).when(F.col("__known"), "revisited").otherwise("missing")
    return out.select("url", "page_seq", "next_url", stop.alias("stop"))


def guide_rows(listings: DataFrame, details: DataFrame, languages: str | None, country: str | None, markers: dict[str, tuple[str, ...]], region: str | None = None) -> DataFrame:
    """Rows of listing pages, in the order of their cards, with the fields of their detail pages.

    `listings` have url, page_no and html, `details` url and html, and optionally
    local_html, the page in the country's language. Cards of another region, and cards
    and rows that name another country only, are left out. A row without a detail page
    keeps empty fields; its local name is then its name. Columns are those of a guide
    row, texts without surrounding white space.
    """
    cards = extraction.with_listing(listings).select("page_no", F.posexplode("listing.cards").alias("card_ord", "c"))
    if region:
        cards = cards.where(F.coalesce(extraction.region_of("c.url"), F.lit(region)) == region)
    cards = cards.where(~predicates.country_mismatch(F.concat_ws(" ", "c.name", "c.city", "c.text"), country, markers))
    pages = extraction.with_detail(details).select(F.col("url").alias("__url"), F.col("detail").alias("d"), *([F.col("local_html")] if "local_html" in details.columns else []))
    if "local_html" in details.columns:
        pages = extraction.with_detail(pages.withColumnRenamed("d", "__d"), "local_html").select("__url", F.col("__d").alias("d"), extraction.local_name("detail.heading").alias("local"))
    else:
        pages = pages.withColumn("local", F.lit(""))
    rows = cards.join(pages, cards["c.url"] == pages["__url"], "left")
    d = lambda n: collapse(F.col(f"d.{n}"))
    point, price = extraction.map_point(F.col("d.iframes")), extraction.price_and_cuisine("c.footer")
    name = collapse("c.name")
    local = F.coalesce(F.nullif(collapse("local"), F.lit("")), F.nullif(extraction.local_name(d("heading")), F.lit("")), name)
    out = rows.select(
        "page_no", "card_ord", name.alias("name"), local.alias("name_local"), extraction.guide_year(F.col("d.meta"), F.col("d.og")).alias("guide_year"), extraction.rating(F.col("c.attrs"), F.col("c.icons")).alias("rating"), collapse("c.city").alias("city"),
        price["price"].alias("price_range"), price["cuisine"].alias("cuisine"), d("description").alias("description"), d("address").alias("address"), point["lat"].alias("latitude"), point["lon"].alias("longitude"),
        F.col("c.url").alias("michelin_website"), d("website").alias("restaurant_website"), extraction.telephone("d.telephone").alias("restaurant_telephone_number"), d("reservation").alias("reservation_link"),
    )
    return out.where(~predicates.country_mismatch(F.concat_ws(" ", "address", "city"), country, markers))


def guide_source(targets: DataFrame, listings: DataFrame, details: DataFrame, start: str, max_pages: int, buckets: tuple[str, ...] = routing.DEFAULT_BUCKETS, country: str | None = None, markers: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """A whole run of the guide: the pages reached from the start, their rows, and the `bucket` of each.

    `targets` are the resolved targets, of which `start` must be one's address; else
    it is an error. `listings` have url, next_url and html.
    """
    ok = F.coalesce(F.max(F.col("url") == start), F.lit(False))
    sure = targets.agg(F.when(~ok, F.raise_error(F.lit("start is no target's address"))).otherwise(F.lit(start)).cast("string").alias("__start"))
    chain = crawled(listings, start, max_pages).join(F.broadcast(sure), F.col("__start").isNotNull())
    read = listings.join(chain.select("url", (F.col("page_seq") + 1).alias("page_no")), "url")
    return routing.route_rows(guide_rows(read, details, None, country, markers or {}), "rating", buckets)

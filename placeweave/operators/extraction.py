"""Fields of listing and detail pages, of their links and of their texts."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeweave.functions.geo import url_point
from placeweave.functions.html import Node, parse
from placeweave.functions.text import collapse, text

_S, _A = T.StringType(), T.ArrayType(T.StringType())
CARD = T.StructType([T.StructField(n, _S) for n in ("name", "city", "footer", "url", "text")] + [T.StructField("attrs", _A), T.StructField("icons", _A)])
LINK = T.StructType([T.StructField(n, _S) for n in ("href", "url", "text", "image")] + [T.StructField(n, T.BooleanType()) for n in ("active", "angle")])
LISTING = T.StructType([T.StructField("title", _S), T.StructField("heading", _S), T.StructField("breadcrumb", _S), T.StructField("og_title", _S), T.StructField("cards", T.ArrayType(CARD)), T.StructField("links", T.ArrayType(LINK))])
DETAIL = T.StructType([T.StructField(n, _S) for n in ("heading", "meta", "og", "address", "description", "website", "telephone", "reservation")] + [T.StructField("iframes", _A)])
_RATING_ATTRIBUTES = ("data-map-pin-name", "data-distinction", "data-dtm-distinction")


def _text(node: Node | None) -> str:
    return node.text() if node else ""


def _card(card: Node, base: str) -> dict:
    icons = card.find(None, "distinction-icon")
    context = [n for n in (card, *card.walk())] if icons else []
    link = card.find("a")
    footers = [n.text() for n in card.find_all(None, "card__menu-footer--score")]
    title = card.find(None, "card__menu-content--title")
    return {
        "name": _text(title), "city": footers[0] if footers else "", "footer": footers[1] if len(footers) > 1 else "", "text": card.text(),
        "url": urljoin(base, link.attrs["href"]) if link and link.attrs.get("href") else "",
        "attrs": [n.attrs[a] for n in context for a in _RATING_ATTRIBUTES if n.attrs.get(a)],
        "icons": [n.attrs.get("src", "") for n in icons.find_all("img")] if icons else None,
    }


def _link(a: Node, base: str) -> dict:
    href, image = a.attrs.get("href", ""), a.find("img")
    angle = any(n.has_class("fa-angle-right") for n in a.walk())
    active = a.has_class("active") or a.attrs.get("aria-current", "") not in ("", "false") or bool(a.parent and a.parent.has_class("active"))
    return {"href": href, "url": urljoin(base, href) if href and href != "#" else None, "text": a.text(), "image": f"{image.attrs.get('src', '')} {image.attrs.get('alt', '')}".strip() if image else "", "active": active, "angle": angle}


def _meta(root: Node, **attrs: str) -> str:
    node = root.find("meta", **attrs)
    return node.attrs.get("content", "") if node else ""


def _listing(html: pd.Series, urls: pd.Series) -> pd.DataFrame:
    rows = []
    for page, base in zip(html, urls):
        root = parse(page)
        crumbs = [n for nav in root.walk() if nav.tag == "nav" or nav.has_class("breadcrumb") for n in nav.find_all("li")]
        rows.append((_text(root.find("title")), _text(root.find("h1")), _text(crumbs[-1] if crumbs else None), _meta(root, property="og:title"), [_card(n, base or "") for n in root.find_all("div", "card__menu")], [_link(n, base or "") for n in root.find_all("a")]))
    return pd.DataFrame(rows, columns=LISTING.names)


def _detail(html: pd.Series) -> pd.DataFrame:
    rows = []
    for page in html:
        root = parse(page)
        event = lambda name: (root.find("a", data_event=name) or Node("", {}, None)).attrs.get("href", "")  # noqa: B023, E731
        book = root.find("a", "btn-reservation") or root.find("a", data_event="CTA_reservation")
        rows.append(
            (
                _text(root.find("h1")), _meta(root, name="description"), _meta(root, property="og:description"), _text(root.find(None, "data-sheet__block--text")), _text(root.find(None, "data-sheet__description")),
                event("CTA_website"), event("CTA_tel"), book.attrs.get("href", "") if book else "", [n.attrs["src"] for n in root.find_all("iframe") if n.attrs.get("src")],
            )
        )
    return pd.DataFrame(rows, columns=DETAIL.names)


def with_listing(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Adds the struct `listing` of each page; null and empty pages give empty fields."""
    return pages.withColumn("listing", F.pandas_udf(_listing, LISTING)(text(html), text(url)))


def with_detail(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds the struct `detail` of each page."""
    return pages.withColumn("detail", F.pandas_udf(_detail, DETAIL)(text(html)))


def rating(attrs: Column, icons: Column) -> Column:
    """The level a card shows: by its attributes, else by its icons; without icons Selected."""
    said = lambda *tokens: F.exists(attrs, lambda a: F.lower(a).rlike("|".join(tokens)))
    stars = F.size(F.filter(icons, lambda s: s.rlike("1star|[a-z]+-star")))
    by_icon = F.when(F.exists(icons, lambda s: F.lower(s).contains("bib")), "Bib Gourmand").when(stars == 1, "1 Star").when(stars == 2, "2 Stars").when(stars == 3, "3 Stars").otherwise("Selected")
    return F.when(icons.isNull(), "Selected").when(said("bib"), "Bib Gourmand").when(said("three", "3"), "3 Stars").when(said("two", "2"), "2 Stars").when(said("one", "1"), "1 Star").otherwise(by_icon)


def price_and_cuisine(footer: Column | str) -> Column:
    """struct(price, cuisine): the first two segments between middle dots, without any white space."""
    parts = F.split(F.regexp_replace(text(footer), r"(?U)\s+", ""), "·")
    return F.struct(F.coalesce(F.get(parts, F.lit(0)), F.lit("")).alias("price"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("cuisine"))


def guide_year(meta: Column, og: Column) -> Column:
    find = lambda c: F.nullif(F.regexp_extract(text(c), r"(20\d{2}) [A-Z]+ Guide", 1), F.lit(""))
    return F.coalesce(find(meta), find(og), F.lit(""))


def telephone(href: Column | str) -> Column:
    """What follows the first colon; all of it without one."""
    v = text(href)
    return F.when(F.instr(v, ":") > 0, F.substr(v, F.instr(v, ":") + 1)).otherwise(v)


def map_point(iframes: Column) -> Column:
    """The point of the second map frame, or of the first where there is one only."""
    return url_point(F.coalesce(F.get(iframes, F.lit(1)), F.get(iframes, F.lit(0))))


def page_number(url: Column | str, fallback: int = 1) -> Column:
    """The number a listing's address has: its `page` parameter, else its path, else the fallback."""
    v = text(url)
    query = F.regexp_extract(v, r"[?&]page=(\d+)", 1).try_cast("int")
    path = F.regexp_extract(v, r"/page/(\d+)", 1).try_cast("int")
    return F.coalesce(query, path, F.lit(fallback))


def total_pages(links: Column) -> Column:
    return F.array_max(F.filter(F.transform(links, lambda a: F.trim(a["text"]).try_cast("int")), lambda n: n.isNotNull()))


def total_items(heading: Column | str) -> Column:
    """The number of items a heading speaks of, in English or Chinese."""
    v = text(heading)
    english = F.nullif(F.regexp_extract(v, r"(?i)of ([\d,]+) restaurants?", 1), F.lit(""))
    chinese = F.nullif(F.regexp_extract(v, r"共\s*([\d,]+)\s*[個家]", 1), F.lit(""))
    return F.translate(F.coalesce(english, chinese), ",", "").try_cast("int")


def next_url(links: Column, current: Column, number: Column) -> Column:
    """The next page's address: behind an angle, numbered next, or behind a picture of an arrow; never the page itself."""
    usable = F.filter(links, lambda a: a["url"].isNotNull() & (a["url"] != current))
    first = lambda test: F.get(F.filter(usable, test), F.lit(0))["url"]
    here = F.coalesce(F.get(F.filter(F.transform(F.filter(links, lambda a: a["active"]), lambda a: F.trim(a["text"]).try_cast("int")), lambda n: n.isNotNull()), F.lit(0)), number)
    return F.coalesce(first(lambda a: a["angle"]), first(lambda a: F.trim(a["text"]).try_cast("int") == here + 1), first(lambda a: F.lower(a["image"]).rlike("arrow.?right|right.?arrow|next")))


def guarded_next(url: Column, page: Column, following: Column, pages: Column) -> Column:
    """The next address, null at or beyond the number of pages known."""
    return F.when(pages.isNotNull() & ((page >= pages) | (following > pages)), F.lit(None)).otherwise(url)


# What ends a scope's name, names that say nothing, and its greatest length.
SPLITTERS = (" | ", " - ", " : ", " – ", " — ")
GENERIC_SCOPE = r"^(restaurants?|(the )?[a-z]+ guide)$"
SCOPE_LENGTH = 30
_EMOJI = r"[\x{1f1e0}-\x{1f1ff}\x{1f300}-\x{1f5ff}\x{1f600}-\x{1f64f}\x{1f680}-\x{1f6ff}\x{1f900}-\x{1f9ff}\x{1fa00}-\x{1faff}\x{2600}-\x{27b0}\x{fe00}-\x{fe0f}\x{200d}]+"


def scope_name(c: Column | str) -> Column:
    """A heading as scope: without emoji, left of the first splitter of the list it has, not generic, cut at a word."""
    v = F.trim(F.regexp_replace(collapse(c), _EMOJI, ""))
    cut = F.coalesce(*(F.when((F.instr(v, s) > 0) & (F.trim(F.substring_index(v, s, 1)) != ""), F.trim(F.substring_index(v, s, 1))) for s in SPLITTERS), v)
    tail = r"[ \-|:,]+$"
    short = F.regexp_replace(F.substring(cut, 1, SCOPE_LENGTH), tail, "")
    word = F.regexp_replace(F.regexp_extract(short, r"^(.+) ", 1), tail, "")
    whole = F.when(F.length(cut) <= SCOPE_LENGTH, cut).when(word != "", word).otherwise(short)
    return F.when(F.lower(cut).rlike(GENERIC_SCOPE), F.lit("")).otherwise(whole)


def best_scope(candidates: DataFrame, group: list[str], value: str, priority: str, order: str) -> DataFrame:
    """Per group the scope of highest priority, then shortest, then first; spellings that differ in case are one."""
    named = candidates.withColumn("scope", scope_name(value)).where("scope <> ''")
    first = named.groupBy(*group, F.lower("scope").alias("__k")).agg(F.min_by(F.struct("scope", F.col(priority).alias("p"), F.col(order).alias("o")), order).alias("s"))
    return first.groupBy(*group).agg(F.min_by("s.scope", F.struct(-F.col("s.p"), F.length("s.scope"), F.col("s.o"))).alias("scope"))


def region_of(url: Column | str) -> Column:
    return F.get(F.filter(F.split(text(url), "/"), lambda s: s.endswith("-region")), F.lit(0))


def local_page_url(url: Column | str, country: str, language: str) -> Column:
    """The address with its country and language segments exchanged for those given."""
    parts = F.split(text(url), "/")
    return F.array_join(F.concat(F.slice(parts, 1, 3), F.array(F.lit(country), F.lit(language)), F.slice(parts, 6, F.greatest(F.size(parts), F.lit(1)))), "/")


def local_name(heading: Column | str) -> Column:
    """The heading up to the first of its separators, tried in order."""
    v = text(heading)
    return F.trim(F.coalesce(*(F.when(F.instr(v, s) > 0, F.substring_index(v, s, 1)) for s in ("/", "／", "|")), v))


def listing_validity(status: Column, title: Column, body: Column, heading: Column) -> Column:
    """struct(ok, reason): the first fault of a listing page, if any."""
    head = F.lower(F.substring(text(body), 1, 500))
    reason = (
        F.when(status != 200, F.concat(F.lit("status "), status.cast("string")))
        .when(F.lower(text(title)).startswith("null "), "null title")
        .when(F.lower(text(body)).contains("no restaurants match"), "empty selection")
        .when(head.rlike("captcha|access denied|just a moment"), "blocked")
        .when((F.trim(text(title)) == "") & (F.trim(text(heading)) == ""), "no title")
        .otherwise("")
    )
    return F.struct((reason == "").alias("ok"), reason.alias("reason"))


def running_pages(before: Column, found: Column) -> Column:
    """The estimate of pages so far: the greater of what was known and what a page shows."""
    return F.greatest(F.coalesce(before, F.lit(0)), F.coalesce(found, F.lit(0)))


def other_region(url: Column | str, region: Column | str) -> Column:
    """Whether a card leads to another region than the listing's; a card that names none doesn't."""
    own = region_of(url)
    return (text(region) != "") & own.isNotNull() & (own != text(region))

"""Queries over pages: rows written as listings, details and map files and read again, so that SQL knows what must come out."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.functions import geo
from placeweave.functions import text as tx
from placeweave.operators import extraction, routing
from placeweave.plans.queries import _BUCKET, _collapse, query
from placeweave.session import load, shared_dir
from placeweave.sources import adapters, files, kml

_MARKERS = {"nw": ("norwend",), "os": ("ostravia",)}


def _escaped(c: Column | str) -> Column:
    v = tx.text(c)
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        v = F.replace(v, F.lit(sign), F.lit(entity))
    return v


def _level() -> Column:
    return F.lower(tx.collapse("rating"))


def _card(i: Column) -> Column:
    """A card whose level stands in its icons, or in an attribute of the card."""
    star = F.lit('<img src="/i/1star.svg">')
    icons = F.when(_level() == "1 star", star).when(_level() == "2 stars", F.concat(star, star)).when(_level() == "3 stars", F.concat(star, star, star)).when(_level() == "bib gourmand", '<img src="/i/bib-gourmand.svg">')
    said = F.when(_level() == "1 star", "ONE_STAR").when(_level() == "2 stars", "TWO_STARS").when(_level() == "3 stars", "THREE_STARS").when(_level() == "bib gourmand", "BIB_GOURMAND")
    by_icon = F.when(icons.isNotNull(), F.concat(F.lit('<span class="distinction-icon">'), icons, F.lit("</span>"))).otherwise("")
    by_word = F.when(said.isNotNull(), F.concat(F.lit('<span class="distinction-icon" data-distinction="'), said, F.lit('"><img src="x.svg"></span>'))).otherwise("")
    return F.concat(
        F.lit('<div class="card__menu">'), F.when(i % 2 == 0, by_icon).otherwise(by_word), F.lit('<h3 class="card__menu-content--title"><a href="/en/x-region/r/'), i.cast("string"), F.lit('">'), _escaped("name"),
        F.lit('</a></h3><div class="card__menu-footer--score">'), _escaped("city"), F.lit('</div><div class="card__menu-footer--score">'), _escaped("price_range"), F.lit(" · "), _escaped("cuisine"), F.lit("</div></div>"),
    )


def _listing(spark: SparkSession, d: str) -> DataFrame:
    """One listing page for each row, with a card, a heading and links to its neighbours."""
    i, page = F.col("row_id"), F.coalesce("page_no", F.lit(1))
    link = lambda n, more="": F.concat(F.lit(f"<li{more}><a href='/list/page/"), n.cast("string"), F.lit("'>"), n.cast("string"), F.lit("</a></li>"))
    links = F.concat(F.lit("<ul>"), link(page, " class='active'"), link(page + 1), link(page + 7), F.when(i % 3 == 0, "<li><a href='/list/next'><i class='fa-angle-right'></i></a></li>").otherwise("<li><a href='#'>9999x</a></li>"), F.lit("</ul>"))
    total = F.when(i % 2 == 0, F.concat(F.lit("1-20 of "), F.format_number(i % 5000, 0), F.lit(" Restaurants"))).otherwise(F.concat(F.lit("共 "), F.format_number(i % 5000, 0), F.lit(" 個餐廳")))
    html = F.concat(F.lit("<html><head><title>T | x</title><meta property='og:title' content='"), F.replace(_escaped("cuisine"), F.lit("'"), F.lit("&#39;")), F.lit(" - Guide'></head><body><nav><ol><li>Home</li><li>"), _escaped("city"), F.lit("</li></ol></nav><h1>"), total, F.lit("</h1>"), _card(i), links, F.lit("</body></html>"))
    url = F.concat(F.lit("https://g.example/list/page/"), page.cast("string"))
    return load(spark, d, "guide_rows").select(i, F.col("page_no"), F.col("city"), F.col("cuisine"), url.alias("url"), html.alias("html"))


def _read(spark: SparkSession, d: str) -> DataFrame:
    return extraction.with_listing(_listing(spark, d)).select("row_id", "page_no", "city", "cuisine", "url", "listing.*")


_SQUEEZED = lambda x: rf"regexp_replace(coalesce({x}, ''), '[\s\p{{Z}}]+', '', 'g')"
_SHOWN = f"CASE lower({_collapse('rating')}) WHEN '1 star' THEN '1 Star' WHEN '2 stars' THEN '2 Stars' WHEN '3 stars' THEN '3 Stars' WHEN 'bib gourmand' THEN 'Bib Gourmand' ELSE 'Selected' END"


@query(f"""SELECT row_id, {_collapse("name")} AS name, {_collapse("city")} AS city, {_SHOWN} AS rating, split_part({_SQUEEZED("coalesce(price_range, '') || ' · ' || coalesce(cuisine, '')")}, '·', 1) AS price, split_part({_SQUEEZED("coalesce(price_range, '') || ' · ' || coalesce(cuisine, '')")}, '·', 2) AS cuisine,
  'https://g.example/en/x-region/r/' || row_id AS url, 'x-region' AS region, false AS other_region FROM guide_rows""")
def page_cards(spark: SparkSession, d: str) -> DataFrame:
    """The fields of the cards of listing pages."""
    c = _read(spark, d).select("row_id", F.explode("cards").alias("c"))
    price = extraction.price_and_cuisine("c.footer")
    return c.select("row_id", F.col("c.name").alias("name"), F.col("c.city").alias("city"), extraction.rating(F.col("c.attrs"), F.col("c.icons")).alias("rating"), price["price"].alias("price"), price["cuisine"].alias("cuisine"), F.col("c.url").alias("url"), extraction.region_of("c.url").alias("region"), extraction.other_region("c.url", F.lit("x-region")).alias("other_region"))


@query("""SELECT row_id, coalesce(page_no, 1) AS page_number, coalesce(page_no, 1) + 7 AS total_pages, CAST(row_id % 5000 AS INT) AS total_items, CASE WHEN row_id % 3 = 0 THEN 'https://g.example/list/next' ELSE 'https://g.example/list/page/' || (coalesce(page_no, 1) + 1) END AS next_url,
  CASE WHEN coalesce(page_no, 1) < 20 THEN CASE WHEN row_id % 3 = 0 THEN 'https://g.example/list/next' ELSE 'https://g.example/list/page/' || (coalesce(page_no, 1) + 1) END END AS guarded, greatest(coalesce(page_no, 0), coalesce(page_no, 1) + 7) AS estimate FROM guide_rows""")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    """Page numbers, totals and the next page of listings."""
    p = _read(spark, d)
    number = extraction.page_number("url")
    following = extraction.next_url(F.col("links"), F.col("url"), number)
    return p.select("row_id", number.alias("page_number"), extraction.total_pages(F.col("links")).alias("total_pages"), extraction.total_items("heading").alias("total_items"), following.alias("next_url"), extraction.guarded_next(following, number, number + 1, F.lit(20)).alias("guarded"), extraction.running_pages(F.col("page_no"), extraction.total_pages(F.col("links"))).alias("estimate"))


@query(f"""SELECT row_id, CASE WHEN b <> '' THEN b WHEN m <> '' THEN m END AS scope FROM (SELECT row_id, {_collapse("city")} AS b, {_collapse("cuisine")} AS m FROM guide_rows) WHERE (b <> '' OR m <> '') AND length(b) <= 30 AND length(m) <= 30 AND NOT regexp_matches(b || m, '[|:–—]| - ')""")
def page_scopes(spark: SparkSession, d: str) -> DataFrame:
    """The scope of each listing, of its breadcrumb before its title; plain and short ones, cleaning being `scope_names`' part."""
    p = _read(spark, d).where((F.length(tx.collapse("city")) <= 30) & (F.length(tx.collapse("cuisine")) <= 30) & ~F.concat(tx.text("city"), tx.text("cuisine")).rlike("[|:–—]| - "))
    found = p.select("row_id", F.explode(F.array(F.struct(F.col("breadcrumb").alias("t"), F.lit(3).alias("prio"), F.lit(0).alias("o")), F.struct(F.col("og_title").alias("t"), F.lit(1).alias("prio"), F.lit(1).alias("o")))).alias("s")).select("row_id", "s.*")
    return extraction.best_scope(found, ["row_id"], "t", "prio", "o")


def _detail(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("row_id")
    point = F.when(F.col("latitude").isNotNull(), F.concat(F.lit('<iframe src="https://m.example/?z=1"></iframe><iframe src="https://m.example/?q='), F.col("latitude").cast("string"), F.lit(","), F.col("longitude").cast("string"), F.lit('"></iframe>'))).otherwise("")
    html = F.concat(
        F.lit('<meta name="description" content="a '), _escaped("guide_year"), F.lit(' ABC Guide"><h1>'), _escaped("name"), F.lit('</h1><div class="data-sheet__block--text">'), _escaped("address"), F.lit('</div><div class="data-sheet__description"><p>'), _escaped("description"),
        F.lit('</p></div><a data-event="CTA_website" href="'), _escaped("restaurant_website"), F.lit('">w</a><a data-event="CTA_tel" href="tel:'), _escaped("restaurant_telephone_number"), F.lit('">t</a><a class="btn-reservation" href="'), _escaped("reservation_link"), F.lit('">b</a>'), point,
    )
    local = F.concat(F.lit("<h1>"), _escaped("name_local"), F.lit("</h1>"))
    return load(spark, d, "guide_rows").select(i, F.concat(F.lit("https://g.example/en/x-region/r/"), i.cast("string")).alias("url"), html.alias("html"), local.alias("local_html"))


_YEAR = "CASE WHEN regexp_full_match(coalesce(guide_year, ''), '20[0-9]{2}') THEN guide_year ELSE '' END"


@query(f"""SELECT row_id, {_YEAR} AS guide_year, {_collapse("address")} AS address, {_collapse("description")} AS description, coalesce(restaurant_website, '') AS website, coalesce(restaurant_telephone_number, '') AS phone, coalesce(reservation_link, '') AS booking, latitude AS lat, longitude AS lon FROM guide_rows WHERE coalesce(guide_year, '') = '' OR regexp_full_match(guide_year, '20[0-9]{{2}}')""")
def page_details(spark: SparkSession, d: str) -> DataFrame:
    """The fields of detail pages."""
    rows = load(spark, d, "guide_rows").where(tx.text("guide_year").rlike("^(20[0-9]{2})?$")).select("row_id")
    p = extraction.with_detail(_detail(spark, d).join(rows, "row_id", "left_semi")).select("row_id", "detail.*")
    point = extraction.map_point(F.col("iframes"))
    return p.select("row_id", extraction.guide_year(F.col("meta"), F.col("og")).alias("guide_year"), "address", "description", "website", extraction.telephone("telephone").alias("phone"), F.col("reservation").alias("booking"), point["lat"].alias("lat"), point["lon"].alias("lon"))


_HEAD = lambda x: f"(CASE WHEN contains({x}, '/') THEN trim(split_part({x}, '/', 1)) WHEN contains({x}, '／') THEN trim(split_part({x}, '／', 1)) WHEN contains({x}, '|') THEN trim(split_part({x}, '|', 1)) ELSE {x} END)"
_KEPT = "NOT (contains(lower(concat_ws(' ', name, city)), 'ostravia') AND NOT contains(lower(concat_ws(' ', name, city)), 'norwend')) AND NOT (contains(lower(coalesce(address, '')), 'ostravia') AND NOT contains(lower(coalesce(address, '')), 'norwend'))"


@query(f"""SELECT 'https://g.example/en/x-region/r/' || row_id AS michelin_website, CAST(0 AS INT) AS card_ord, name, coalesce(nullif({_HEAD("local")}, ''), nullif({_HEAD("name")}, ''), name) AS name_local, {_collapse("city")} AS city, {_SHOWN} AS rating, {_collapse("address")} AS address, latitude, coalesce(restaurant_telephone_number, '') AS phone
  FROM (SELECT * REPLACE ({_collapse("name")} AS name), {_collapse("name_local")} AS local FROM guide_rows) WHERE {_KEPT}""")
def guide_pages(spark: SparkSession, d: str) -> DataFrame:
    """Rows of listings with their details; those that name another country only are left out."""
    rows = adapters.guide_rows(_listing(spark, d), _detail(spark, d), "xx", "nw", _MARKERS, "x-region")
    return rows.select("michelin_website", F.col("card_ord").cast("int").alias("card_ord"), "name", "name_local", "city", "rating", "address", "latitude", F.col("restaurant_telephone_number").alias("phone"))


@query(f"""SELECT bucket, count(*) AS n FROM (SELECT CASE {_SHOWN} WHEN 'Selected' THEN 'selected' WHEN 'Bib Gourmand' THEN 'bib-gourmand' ELSE 'stars' END AS bucket FROM guide_rows WHERE page_no <= 9 AND page_no IN (SELECT p FROM (SELECT p, p - row_number() OVER (ORDER BY p) AS g FROM (SELECT DISTINCT page_no AS p FROM guide_rows)) WHERE g = 0)) GROUP BY bucket""")
def guide_run(spark: SparkSession, d: str) -> DataFrame:
    """A whole run of the guide over nine pages: target, pages, rows, buckets."""
    g = load(spark, d, "guide_rows").where("page_no is not null")
    cards = g.select("page_no", "row_id", _card(F.col("row_id")).alias("card")).groupBy("page_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row_id", "card"))), lambda x: x["card"]), "").alias("cards"))
    url = lambda n: F.concat(F.lit("https://g.example/list/page/"), n.cast("string"))
    pages = cards.select(url(F.col("page_no")).alias("url"), url(F.col("page_no") + 1).alias("next_url"), F.concat(F.lit("<html>"), "cards", F.lit("</html>")).alias("html"))
    targets = spark.createDataFrame([("https://g.example/list/page/1",)], "url string")
    rows = adapters.guide_source(targets, pages, _detail(spark, d).drop("local_html"), "https://g.example/list/page/1", 9)
    return rows.groupBy("bucket").agg(F.count("*").alias("n"))


@query("""SELECT row_id, CASE row_id % 6 WHEN 0 THEN 'status 404' WHEN 1 THEN 'null title' WHEN 2 THEN 'empty selection' WHEN 3 THEN 'blocked' WHEN 4 THEN 'no title' ELSE '' END AS reason FROM guide_rows""")
def page_validity(spark: SparkSession, d: str) -> DataFrame:
    """The first fault of listing pages."""
    k = F.col("row_id") % 6
    title = F.when(k == 1, "NULL Places").when(k == 4, " ").otherwise("T")
    body = F.when(k == 2, "No restaurants match").when(k == 3, "<b>Just a moment</b>").otherwise("ok")
    v = extraction.listing_validity(F.when(k == 0, 404).otherwise(200), title, body, F.when(k == 4, "").otherwise("H"))
    return load(spark, d, "guide_rows").select("row_id", v["reason"].alias("reason"))


@query("""SELECT row_id, 'https://g.example/jp/ja/r/' || row_id AS local_url, TRY_CAST(CASE WHEN latitude IS NOT NULL AND longitude IS NOT NULL THEN latitude END AS DOUBLE) AS lat FROM guide_rows""")
def local_urls(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of pages in the country's language, and points of map links."""
    link = F.concat(F.lit("https://m.example/x?a=b&q="), F.coalesce(F.col("latitude").cast("string"), F.lit("none")), F.lit("%2C"), F.coalesce(F.col("longitude").cast("string"), F.lit("none")))
    url = F.concat(F.lit("https://g.example/us/en/r/"), F.col("row_id").cast("string"))
    return load(spark, d, "guide_rows").select("row_id", extraction.local_page_url(url, "jp", "ja").alias("local_url"), geo.url_point(link)["lat"].alias("lat"))


@query(f"SELECT row_id, {_BUCKET} AS bucket FROM guide_rows WHERE {_BUCKET} IN ('stars', 'bib-gourmand')")
def selected_levels(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a selection of levels given as a list in any order."""
    chosen = routing.parse_buckets(" Bib-Gourmand , stars")
    return routing.route_rows(load(spark, d, "guide_rows"), "rating", chosen, strict=False).select("row_id", "bucket")


# ---- map files


def _kml(spark: SparkSession, d: str) -> DataFrame:
    mark = F.concat(
        F.lit("<Placemark><name>"), _escaped("name"), F.lit("</name><description><![CDATA[Dish: "), tx.text("cuisine"), F.lit("<br>Year："), tx.text("guide_year"), F.lit("<br/>Dish: last<br>none]]></description><ExtendedData><Data name='For-matted Address'><value>"), _escaped("address"),
        F.lit("</value></Data><Data name='City'><value>first</value></Data><SchemaData><SimpleData name='CITY'>"), _escaped("city"), F.lit("</SimpleData></SchemaData></ExtendedData></Placemark>"),
    )
    doc = F.concat(F.lit("<k:kml xmlns:k='http://x.example/kml'><k:Document><k:name>My map</k:name>"), mark, F.lit("</k:Document></k:kml>"))
    return load(spark, d, "guide_rows").where(~tx.text("cuisine").rlike("[<>:：&]")).select(F.col("row_id").cast("string").alias("path"), doc.cast("binary").alias("content"))


_TRIM = lambda x: rf"regexp_replace(replace(coalesce({x}, ''), chr(13) || chr(10), chr(10)), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


@query(f"""SELECT row_id, {_TRIM("name")} AS name, {_TRIM("address")} AS address, {_TRIM("city")} AS city, 'last' AS dish, nullif({_collapse("guide_year")}, '') AS year, 'My map' AS document FROM guide_rows WHERE NOT regexp_matches(coalesce(cuisine, ''), '[<>:：&]')""")
def kml_extended(spark: SparkSession, d: str) -> DataFrame:
    """Placemarks whose address, city and description are extended data, under another namespace."""
    r = kml.place_rows(kml.placemarks(_kml(spark, d)))
    return r.select(F.col("path").cast("long").alias("row_id"), "name", "address", "city", F.col("description_fields")["Dish"].alias("dish"), F.col("description_fields")["Year"].alias("year"), "document")


@query(f"""SELECT house_id, CASE WHEN trim(coalesce(cuisine, '')) <> '' AND house_id % 2 = 0 THEN trim(cuisine) WHEN trim(coalesce(house_name, '')) <> '' AND house_id % 3 <> 0 THEN trim(house_name) ELSE 'f' || house_id END AS scope FROM house_directory""")
def kml_scopes(spark: SparkSession, d: str) -> DataFrame:
    """Names of imports: what is asked for, the document's, or the file's."""
    i = F.col("house_id")
    scope = kml.scope(F.when(i % 2 == 0, F.col("cuisine")), F.when(i % 3 != 0, F.col("house_name")), F.concat(F.lit("/data/f"), i.cast("string"), F.lit(".kmz")))
    return load(spark, d, "house_directory").select("house_id", scope.alias("scope"))


def _folder(spark: SparkSession, texts: dict[str, bytes]) -> str:
    """A folder of the shared one with these files."""
    jvm = spark.sparkContext._jvm
    base = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    for name, data in texts.items():
        path = jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
        out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(data))
        out.close()
    return base


@query("SELECT r_name AS title FROM region")
def page_files(spark: SparkSession, d: str) -> DataFrame:
    """HTML files of a folder, those that aren't UTF-8 left out."""
    regions = [r["r_name"] for r in load(spark, d, "region").select("r_name").collect()]  # five
    base = _folder(spark, {f"{n}.html": f"<title>{n}</title>".encode() for n in regions} | {"bad.html": b"<title>\xff\xfe</title>", "x.txt": b"no"})
    return extraction.with_listing(files.read_pages(spark, base).withColumn("url", F.col("path"))).select(F.col("listing.title").alias("title"))


@query("SELECT r_name AS name, lower(r_name) AS address FROM region UNION ALL SELECT r_name, upper(r_name) FROM region")
def map_files(spark: SparkSession, d: str) -> DataFrame:
    """KML and zipped KMZ files of a folder."""
    import io
    import zipfile

    regions = [r["r_name"] for r in load(spark, d, "region").select("r_name").collect()]  # five
    text = lambda f: ("<kml><Document><name>m</name>" + "".join(f"<Placemark><name>{n}</name><address>{f(n)}</address></Placemark>" for n in regions) + "</Document></kml>").encode()
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("b/other.kml", b"<kml/>")
        z.writestr("a/doc.kml", text(str.upper))
    base = _folder(spark, {"a.kml": text(str.lower), "b.kmz": buffer.getvalue()})
    return kml.place_rows(kml.read_kml(spark, base)).select("name", "address")

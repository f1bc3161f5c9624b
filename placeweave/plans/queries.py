"""Queries over the core operators, each over whole tables, with the SQL its result must equal where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.functions import geo
from placeweave.functions import text as tx
from placeweave.operators import evaluation, evidence, extraction, ordering, packed, predicates, redaction, rendering, routing, summary
from placeweave.session import cut, load, shared_dir
from placeweave.sources import files, kml
from placeweave.streaming import sync

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query by its function's name, with its SQL."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from placeweave.plans import matcher, pages, runs  # noqa: F401 - they register theirs

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


# ---- SQL fragments


def _collapse(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '[\\s\\p{{Z}}]+', ' ', 'g'))"


_BUCKET = f"""CASE lower({_collapse("rating")}) WHEN '1 star' THEN 'stars' WHEN '2 stars' THEN 'stars' WHEN '3 stars' THEN 'stars'
  WHEN 'selected' THEN 'selected' WHEN 'bib gourmand' THEN 'bib-gourmand' END"""
_ROUTED = f"(SELECT *, {_BUCKET} AS bucket FROM guide_rows WHERE {_BUCKET} IS NOT NULL)"
_PART = lambda x: f"lower({_collapse(x)})"
_NUM = lambda x: f"CASE WHEN {x} IS NULL OR {x} = 0 THEN '' ELSE CAST({x} AS VARCHAR) END"
_KEY = f"sha256(concat_ws('|', {_PART('bucket')}, {_PART('name')}, {_PART('address')}, {_PART('city')}, {_NUM('latitude')}, {_NUM('longitude')}))"
_STATUS = f"""SELECT row_id, bucket, CASE WHEN coalesce(max(CAST(accepted AS INT)) OVER (PARTITION BY row_key ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1
  THEN 'skipped' WHEN accepted THEN 'added' ELSE 'failed' END AS status
  FROM (SELECT row_id, bucket, {_KEY} AS row_key, coalesce(address, '') <> '' AS accepted FROM {_ROUTED})"""


# Fixed values of the SQL twins, written out so that a wrong table on the other side shows.
_FOOD = "restaurant,cafe,coffee,tea,bar,bistro,bakery,izakaya,sushi,ramen,noodle,congee,food,dim sum,deli,taiwanese,chinese,japanese,餐廳,菜館,料理,食堂,麵,面,熟食,小吃,點心,糕,餅,餃,湯包,豆腐,甜點,甜品".split(",")
_OTHER = "temple,church,shrine,hotel,parking,park,school,workshop,office,tourist attraction,宗教,寺,廟,停車,飯店,酒店".split(",")
_COMMERCE = "store,shop,商店,商行".split(",")


def _terms(x: str, terms: list[str] | tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower(coalesce({x}, '')), '{t}')" for t in terms) + ")"


# ---- packed fields


def p3_values(spark: SparkSession, d: str) -> DataFrame:
    """All values of the packed fields with their position and the dialect they were read by."""
    return packed.packed_values(load(spark, d, "guide_rows"), load(spark, d, "target_failures"))


@query()
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_values(spark, d).where(F.col("n_items") >= 2).select("field_name", "rec_id", "item_no", "item_text")


query()(p3_values)


# ---- routing and identity


def _routed(spark: SparkSession, d: str) -> DataFrame:
    return routing.route_rows(load(spark, d, "guide_rows"), "rating", strict=False)


@query(f"SELECT row_id, bucket FROM {_ROUTED}")
def route_rows(spark: SparkSession, d: str) -> DataFrame:
    return _routed(spark, d).select("row_id", "bucket")


@query(f"""SELECT b.bucket, CAST(b.bucket_ord AS INT) AS bucket_ord, count(r.row_id) AS scraped, count(r.row_id) FILTER (WHERE coalesce(r.address, '') = '') AS thin
  FROM (VALUES ('stars', 0), ('selected', 1), ('bib-gourmand', 2), ('one-star', 3), ('two-star', 4), ('three-star', 5)) b(bucket, bucket_ord)
  LEFT JOIN {_ROUTED} r ON r.bucket = b.bucket GROUP BY ALL""")
def route_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = _routed(spark, d)
    return summary.bucket_counts(rows, routing.BUCKETS, {"scraped": F.lit(True), "thin": tx.text("address") == ""})


@query("""SELECT failure_id, bucket, CAST(row_number() OVER (PARTITION BY bucket ORDER BY e, failure_id) AS INT) AS bucket_ord FROM (
  SELECT failure_id, 0 AS e, CASE WHEN lower(trim(level_slug)) IN ('one-star', 'two-star', 'three-star') THEN 'stars' ELSE lower(trim(level_slug)) END AS bucket
  FROM target_failures WHERE lower(trim(coalesce(level_slug, ''))) IN ('one-star', 'selected', 'bib-gourmand')
  UNION ALL SELECT failure_id, 1, 'selected' FROM target_failures WHERE lower(trim(coalesce(level_slug, ''))) NOT IN ('one-star', 'selected', 'bib-gourmand'))""")
def route_explicit(spark: SparkSession, d: str) -> DataFrame:
    """Failures by their own level where it is one, else by a rating."""
    own = F.lower(F.trim(tx.text("level_slug")))
    rows = load(spark, d, "target_failures").select("failure_id", F.when(own.isin("one-star", "selected", "bib-gourmand"), own).otherwise("").alias("level"), F.lit(" SELECTED ").alias("rating"))
    return routing.route_explicit(rows, "level", "rating", [F.col("failure_id")]).select("failure_id", "bucket", "bucket_ord")


def _identity() -> F.Column:
    return routing.identity_key(F.col("bucket"), F.col("name"), F.col("address"), F.col("city"), routing.number_part("latitude"), routing.number_part("longitude"))


@query(f"SELECT row_id, {_KEY} AS row_key FROM {_ROUTED}")
def row_identity(spark: SparkSession, d: str) -> DataFrame:
    return _routed(spark, d).select("row_id", _identity().alias("row_key"))


def _statuses(spark: SparkSession, d: str) -> DataFrame:
    rows = _routed(spark, d).select("row_id", "bucket", _identity().alias("row_key"), (tx.text("address") != "").alias("accepted"))
    return ordering.first_wins(rows, ["row_key"], [F.col("row_id")], F.col("accepted"))


@query(_STATUS)
def first_wins_status(spark: SparkSession, d: str) -> DataFrame:
    return _statuses(spark, d).select("row_id", "bucket", "status")


@query(f"""SELECT b.bucket, CAST(b.o AS INT) AS bucket_ord, count(*) FILTER (WHERE status = 'added') AS added, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'skipped') AS skipped
  FROM (VALUES ('stars', 0), ('selected', 1), ('bib-gourmand', 2)) b(bucket, o) LEFT JOIN ({_STATUS}) s ON s.bucket = b.bucket GROUP BY ALL""")
def bucket_results(spark: SparkSession, d: str) -> DataFrame:
    is_ = lambda s: F.col("status") == s
    return summary.bucket_counts(_statuses(spark, d), routing.DEFAULT_BUCKETS, {s: is_(s) for s in ("added", "failed", "skipped")})


@query(f"""SELECT bucket, bucket_ord, skipped FROM (SELECT bucket, CASE bucket WHEN 'stars' THEN 0 WHEN 'selected' THEN 1 ELSE 2 END AS bucket_ord, count(*) FILTER (WHERE status = 'skipped') AS skipped
  FROM ({_STATUS}) GROUP BY ALL) WHERE skipped > 0""")
def missing_report(spark: SparkSession, d: str) -> DataFrame:
    return bucket_results(spark, d).where("skipped > 0").select("bucket", "bucket_ord", "skipped")


@query(f"""SELECT bucket, n_all, n_before, greatest(n_all - n_before, 0) AS session FROM (SELECT bucket, count(*) AS n_all, count(*) FILTER (WHERE loaded_at < TIMESTAMP '2024-01-01') AS n_before FROM {_ROUTED} GROUP BY ALL)""")
def session_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = _routed(spark, d).groupBy("bucket").agg(F.count("*").alias("n_all"), F.count_if(F.col("loaded_at") < F.lit("2024-01-01").cast("timestamp")).alias("n_before"))
    return summary.session_totals(rows, "n_before", "n_all")


@query("SELECT row_id, name FROM guide_rows g WHERE NOT EXISTS (SELECT 1 FROM target_failures t WHERE t.restaurant_name = g.name)")
def resume_todo(spark: SparkSession, d: str) -> DataFrame:
    done = load(spark, d, "target_failures").select(F.col("restaurant_name").alias("name"))
    return ordering.not_done(load(spark, d, "guide_rows").select("row_id", "name"), done, "name").select("row_id", "name")


@query("SELECT row_id, name FROM guide_rows g WHERE EXISTS (SELECT 1 FROM target_failures t WHERE t.restaurant_name = g.name)")
def resume_done(spark: SparkSession, d: str) -> DataFrame:
    done = load(spark, d, "target_failures").select(F.col("restaurant_name").alias("name"))
    return ordering.already_done(load(spark, d, "guide_rows").select("row_id", "name"), done, "name").select("row_id", "name")


@query(f"""SELECT row_id, page_no, row_number() OVER (PARTITION BY page_no ORDER BY card_ord, row_id) <= 20 AS in_budget FROM guide_rows""")
def page_budget(spark: SparkSession, d: str) -> DataFrame:
    return ordering.budgeted(load(spark, d, "guide_rows"), ["page_no"], [F.col("card_ord"), F.col("row_id")], 20).select("row_id", "page_no", "in_budget")


@query("SELECT row_id, page_no, card_ord FROM guide_rows ORDER BY page_no, card_ord, row_id LIMIT 5")
def sample_rows(spark: SparkSession, d: str) -> DataFrame:
    """The first five rows of the run, as a report shows them."""
    return ordering.sample_rows(load(spark, d, "guide_rows").select("row_id", "page_no", "card_ord"), [F.col("page_no"), F.col("card_ord"), F.col("row_id")])


@query("SELECT row_id, page_no FROM guide_rows WHERE page_no IN (SELECT DISTINCT page_no FROM guide_rows ORDER BY page_no LIMIT 10)")
def page_limit(spark: SparkSession, d: str) -> DataFrame:
    return ordering.page_limited(load(spark, d, "guide_rows").select("row_id", "page_no"), "page_no", 10).select("row_id", "page_no")


@query("SELECT query_text, cand_id, rank FROM (SELECT query_text, cand_id, CAST(row_number() OVER (PARTITION BY query_text ORDER BY cand_ord, cand_id) AS INT) AS rank FROM place_candidates) WHERE rank <= 5")
def candidate_top5(spark: SparkSession, d: str) -> DataFrame:
    """The five first candidates of each query, the cap that a search has."""
    return ordering.top_k(load(spark, d, "place_candidates"), ["query_text"], [F.col("cand_ord"), F.col("cand_id")], 5).select("query_text", "cand_id", "rank")


@query(f"""WITH p AS (SELECT query_text, cand_id, name, {_terms("category", _FOOD)} AND {_PART("category")} <> 'add a label' AS ok,
    row_number() OVER (PARTITION BY query_text ORDER BY cand_ord, cand_id) AS n FROM place_candidates),
  a AS (SELECT query_text, count(*) AS n_pairs, min(n) FILTER (WHERE ok) AS hit FROM p GROUP BY ALL)
  SELECT a.query_text, p.cand_id, a.n_pairs, coalesce(a.hit - 1, a.n_pairs) AS n_before FROM a LEFT JOIN p ON p.query_text IS NOT DISTINCT FROM a.query_text AND p.n = a.hit""")
def first_acceptable(spark: SparkSession, d: str) -> DataFrame:
    pairs = load(spark, d, "place_candidates").select("query_text", "cand_id", "cand_ord", "category")
    found = ordering.first_acceptable(pairs, ["query_text"], [F.col("cand_ord"), F.col("cand_id")], predicates.food_category("category"))
    return found.select("query_text", "cand_id", "n_pairs", "n_before")


# ---- summaries


@query("SELECT reason, count(*) AS n, min(failure_id) AS first_seen FROM target_failures GROUP BY reason ORDER BY n DESC, first_seen LIMIT 8")
def failure_histogram(spark: SparkSession, d: str) -> DataFrame:
    return summary.reason_histogram(load(spark, d, "target_failures"), "reason", F.col("failure_id"))


@query(f"""SELECT query_text, cand_id, score FROM (SELECT query_text, cand_id, score, row_number() OVER (PARTITION BY query_text ORDER BY score DESC, len DESC, cand_id) AS n FROM (
  SELECT query_text, cand_id, length(coalesce(name, '')) AS len, CASE WHEN regexp_matches(coalesce(name, ''), '[0-9]') THEN -100 ELSE 30 END + CASE WHEN {_terms("category", _FOOD)} AND {_PART("category")} <> 'add a label' THEN 20 ELSE 0 END
  + CASE WHEN contains(coalesce(query_text, ''), coalesce(name, '')) THEN 100 ELSE 0 END + CASE WHEN {_terms("category", _OTHER)} THEN -60 ELSE 0 END AS score FROM place_candidates)) WHERE n = 1""")
def best_rejected(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "place_candidates")
    no = F.lit(False)
    score = summary.review_score(F.lit(0.0), tx.text("query_text").contains(tx.text("name")), predicates.other_category("category"), no, no, ~tx.text("name").rlike("[0-9]"), predicates.food_category("category"), F.lit(0))
    pairs = c.select("query_text", "cand_id", score.alias("score"), tx.text("name").alias("name"))
    return summary.best_rejected(pairs, ["query_text"], F.col("score"), F.col("name"), F.col("cand_id")).select("query_text", "cand_id", "score")


@query("SELECT row_id, page_no, max(card_ord) OVER (PARTITION BY city ORDER BY loaded_at, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reached FROM guide_rows")
def running_progress(spark: SparkSession, d: str) -> DataFrame:
    rows = summary.running_maximum(load(spark, d, "guide_rows"), ["city"], [F.col("loaded_at"), F.col("row_id")], F.col("card_ord"), "reached")
    return rows.select("row_id", "page_no", "reached")


# ---- fields of links, headings and texts


@query(r"""SELECT row_id, coalesce(TRY_CAST(nullif(regexp_extract(coalesce(michelin_website, ''), '[?&]page=(\d+)', 1), '') AS INT), TRY_CAST(nullif(regexp_extract(coalesce(michelin_website, ''), '/page/(\d+)', 1), '') AS INT), 1) AS page_number,
  coalesce(nullif(CASE WHEN position(':' IN coalesce(restaurant_telephone_number, '')) > 0 THEN substr(restaurant_telephone_number, position(':' IN restaurant_telephone_number) + 1) ELSE restaurant_telephone_number END, NULL), '') AS phone,
  trim(split_part(split_part(split_part(coalesce(name, ''), '/', 1), '／', 1), '|', 1)) AS first_name FROM guide_rows""")
def link_fields(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d, "guide_rows")
    first = F.trim(F.substring_index(F.substring_index(F.substring_index(tx.text("name"), "/", 1), "／", 1), "|", 1))
    return g.select("row_id", extraction.page_number("michelin_website").alias("page_number"), extraction.telephone("restaurant_telephone_number").alias("phone"), first.alias("first_name"))


@query(r"""SELECT row_id, CASE WHEN contains(coalesce(name, ''), '/') THEN trim(split_part(name, '/', 1)) WHEN contains(coalesce(name, ''), '／') THEN trim(split_part(name, '／', 1))
  WHEN contains(coalesce(name, ''), '|') THEN trim(split_part(name, '|', 1)) ELSE trim(coalesce(name, '')) END AS local_name FROM guide_rows""")
def local_names(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "guide_rows").select("row_id", extraction.local_name("name").alias("local_name"))


@query(r"""SELECT row_id, split_part(f, '·', 1) AS price, split_part(f, '·', 2) AS cuisine FROM (SELECT row_id, regexp_replace(coalesce(price_range, '') || ' · ' || coalesce(cuisine, ''), '[\s\p{Z}]+', '', 'g') AS f FROM guide_rows)""")
def price_cuisine(spark: SparkSession, d: str) -> DataFrame:
    footer = F.concat(tx.text("price_range"), F.lit(" · "), tx.text("cuisine"))
    return load(spark, d, "guide_rows").select("row_id", extraction.price_and_cuisine(footer).alias("f")).select("row_id", "f.price", "f.cuisine")


@query(r"""SELECT lang, kind, slug, '/xx/zz/' || array_to_string(CASE WHEN p[1] IN ('en', 'https:') THEN p[2:] ELSE p END, '/') AS path, 'tw/zh_TW/' || array_to_string(CASE WHEN q[1] = 'en' AND q[2] IN ('nw', 'os', 'vm') THEN q[3:] WHEN q[1] = 'en' THEN q[2:] WHEN q[1] IN ('nw', 'os', 'vm') THEN q[2:] ELSE q END, '/') AS on_site,
  'zz/' || array_to_string(q[2:], '/') AS generic FROM (SELECT lang, kind, slug, list_filter(string_split(coalesce(url, ''), '/'), lambda x: x <> '') AS p, string_split('en/' || left(lower(country), 1) || CASE lower(country) WHEN 'norwend' THEN 'w' WHEN 'ostravia' THEN 's' WHEN 'valmarie' THEN 'm' ELSE 'x' END || '/' || slug || '/restaurants', '/') AS q FROM target_urls)""")
def localized_paths(spark: SparkSession, d: str) -> DataFrame:
    """Addresses and English paths of the catalogue's cities in other languages, with and without a known country before them."""
    code = F.concat(F.substring(F.lower("country"), 1, 1), F.when(F.lower("country") == "norwend", "w").when(F.lower("country") == "ostravia", "s").when(F.lower("country") == "valmarie", "m").otherwise("x"))
    u = load(spark, d, "target_urls").withColumn("path", F.concat(F.lit("en/"), code, F.lit("/"), F.col("slug"), F.lit("/restaurants")))
    known = ("nw", "os", "vm")
    return u.select("lang", "kind", "slug", routing.localized_url("url", "xx", "zz", ("https:",)).alias("url_path"), routing.city_path("path", "zh_CN", known).alias("on_site"), routing.city_path("path", "zz", known).alias("generic")).withColumnRenamed("url_path", "path")


_CUT = lambda v: "CASE " + " ".join(f"WHEN contains({v}, '{s}') AND trim(split_part({v}, '{s}', 1)) <> '' THEN trim(split_part({v}, '{s}', 1))" for s in extraction.SPLITTERS) + f" ELSE {v} END"
_EMOJI = r"[\x{1f1e0}-\x{1f1ff}\x{1f300}-\x{1f5ff}\x{1f600}-\x{1f64f}\x{1f680}-\x{1f6ff}\x{1f900}-\x{1f9ff}\x{1fa00}-\x{1faff}\x{2600}-\x{27b0}\x{fe00}-\x{fe0f}\x{200d}]+"


@query(rf"""SELECT doc_id, CASE WHEN regexp_matches(lower(cut), '{extraction.GENERIC_SCOPE}') THEN '' WHEN length(cut) <= 30 THEN cut
  WHEN regexp_replace(regexp_extract(short, '(?s)^(.+) ', 1), '[ \-|:,]+$', '') <> '' THEN regexp_replace(regexp_extract(short, '(?s)^(.+) ', 1), '[ \-|:,]+$', '') ELSE short END AS scope
  FROM (SELECT doc_id, cut, regexp_replace(left(cut, 30), '[ \-|:,]+$', '') AS short FROM (SELECT doc_id, {_CUT("v")} AS cut FROM (SELECT doc_id, trim(regexp_replace({_collapse("text")}, '{_EMOJI}', '', 'g')) AS v FROM documents)))""")
def scope_names(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", extraction.scope_name("text").alias("scope"))


@query(r"""SELECT row_id, trim(regexp_replace(coalesce(name, '') || ' ' || coalesce(cuisine, ''), '[\s\p{Z}]+', ' ', 'g')) AS plain FROM guide_rows WHERE coalesce(name, '') NOT LIKE '%<%' AND coalesce(name, '') NOT LIKE '%>%'""")
def stripped_html(spark: SparkSession, d: str) -> DataFrame:
    """Names written as markup, their signs as entities of several kinds, and read again."""
    v = F.replace(F.replace(F.replace(tx.text("name"), F.lit("&"), F.lit("&amp;")), F.lit("é"), F.lit("&eacute;")), F.lit("'"), F.lit("&#x27;"))
    page = F.concat(F.lit("<p class='a'>"), v, F.lit("</p>&nbsp;<br/>"), F.replace(tx.text("cuisine"), F.lit("a"), F.lit("&#97;")))
    rows = load(spark, d, "guide_rows").where(~tx.text("name").rlike("[<>]"))
    return rows.select("row_id", tx.strip_html(page).alias("plain"))


# ---- text scalars


@query(rf"""SELECT cand_id, {_collapse("name")} AS collapsed, coalesce(nullif(trim(regexp_replace(lower(trim(coalesce(name, ''))), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'place') AS slug,
  regexp_replace(coalesce(lower(name), ''), '[^a-z0-9\x{{3400}}-\x{{4dbf}}\x{{4e00}}-\x{{9fff}}\x{{f900}}-\x{{faff}}]', '', 'g') AS compact,
  regexp_matches(coalesce(name, ''), '[\x{{3040}}-\x{{30ff}}\x{{3400}}-\x{{4dbf}}\x{{4e00}}-\x{{9fff}}\x{{f900}}-\x{{faff}}]') AS has_cjk FROM place_candidates""")
def name_scalars(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "place_candidates")
    return c.select("cand_id", tx.collapse("name").alias("collapsed"), tx.slug("name", "place").alias("slug"), tx.compact_mixed(F.lower("name")).alias("compact"), tx.has_cjk("name").alias("has_cjk"))


@query(r"""SELECT token, count(*) AS n FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(coalesce(text, ''), '([\p{L}\p{Nl}\p{No}]+|\p{Nd}+)', 1))) AS token FROM documents) GROUP BY token ORDER BY n DESC, token LIMIT 50""")
def frequent_words(spark: SparkSession, d: str) -> DataFrame:
    """The fifty words most documents have."""
    return load(spark, d, "documents").select(F.explode(tx.words("text")).alias("token")).groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(50)


@query(r"""SELECT cand_id, array_to_string(list_sort(list_distinct(list_concat(list_transform(regexp_extract_all(coalesce(address, ''), '(\p{Nd}+(?:[-之]\p{Nd}+)?)[\s\p{Z}]*號', 1), lambda x: replace(x, '之', '-')),
  regexp_extract_all(lower(coalesce(address, '')), '(?:^|[^\p{L}\p{N}_])no\.?[\s\p{Z}]*(\p{Nd}+(?:-\p{Nd}+)?)(?:[^\p{L}\p{N}_]|$)', 1)))), ' ') AS houses,
  array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(coalesce(address, ''), '[0-9]+(?:-[0-9]+)*'), lambda x: regexp_full_match(x, '[0-9]{3}-?[0-9]{4}')), lambda x: replace(x, '-', '')))), ' ') AS posts FROM place_candidates""")
def house_tokens(spark: SparkSession, d: str) -> DataFrame:
    """House numbers and postal codes of every address."""
    c = load(spark, d, "place_candidates")
    return c.select("cand_id", F.array_join(F.array_sort(tx.house_numbers("address")), " ").alias("houses"), F.array_join(F.array_sort(tx.postal_codes("address")), " ").alias("posts"))


@query(r"""SELECT row_id, CASE WHEN latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 THEN regexp_replace(regexp_replace(printf('%.7f', latitude), '0+$', ''), '\.$', '') || ',' || regexp_replace(regexp_replace(printf('%.7f', longitude), '0+$', ''), '\.$', '') ELSE '' END AS q FROM guide_rows""")
def coordinate_queries(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "guide_rows").select("row_id", geo.coordinate_query(F.col("latitude"), F.col("longitude")).alias("q"))


_HAN = r"[\x{4e00}-\x{9fff}]"
_AREA = rf"""coalesce(nullif(regexp_extract(a, '((?:臺|台)?{_HAN}{{1,4}}[縣市]{_HAN}{{1,4}}[區鎮鄉市])', 1), ''), nullif(regexp_extract(a, '({_HAN}{{1,4}}[區鎮鄉])', 1), ''), regexp_extract(a, '^({_HAN}{{1,4}}市)', 1))"""


@query(rf"""SELECT row_id, area, regexp_extract(CASE WHEN area <> '' THEN substr(a, position(area IN a) + length(area)) ELSE a END, '((?:{_HAN}|[0-9]){{1,12}}(?:大道|路|街)(?:[一二三四五六七八九十0-9]+段)?[0-9]+(?:之[0-9]+)?號(?:[0-9]+樓)?)', 1) AS street
  FROM (SELECT row_id, a, {_AREA} AS area FROM (SELECT row_id, coalesce(address, '') AS a FROM guide_rows))""")
def area_hints(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "guide_rows").select("row_id", geo.area_hint("address").alias("area"), geo.street_hint("address").alias("street"))


@query()
def query_attempts(spark: SparkSession, d: str) -> DataFrame:
    """The search attempts of each row, in order."""
    g = load(spark, d, "guide_rows")
    tries = rendering.query_attempts(F.col("name"), F.col("name_local"), tx.derived_aliases("name"), F.col("city"), F.col("address"), F.col("cuisine"), F.col("latitude"), F.col("longitude"))
    return g.select("row_id", F.posexplode(tries).alias("attempt_ord", "attempt"))


@query()
def name_alternatives(spark: SparkSession, d: str) -> DataFrame:
    """The names a row can go by."""
    return load(spark, d, "guide_rows").select("row_id", F.posexplode(tx.alternatives("name")).alias("alt_ord", "alt_name"))


@query()
def folded_names(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "place_candidates").select("cand_id", tx.folded_text("name").alias("folded"))


# ---- predicates and lookups


@query(rf"""SELECT cand_id, {_terms("category", _FOOD)} AND {_PART("category")} <> 'add a label' AS food, {_terms("category", _OTHER)} AS other, {_terms("category", _COMMERCE)} AS commerce,
  regexp_matches(coalesce(query_text, ''), '^\s*[+-]?\d{{1,2}}(\.\d+)?\s*,\s*[+-]?\d{{1,3}}(\.\d+)?\s*$') AS by_point, regexp_matches({_PART("name")}, '^(no\.?\s*\d|\d{{1,3}}$|\d{{3,}}\s*,|\d+\s*(f|floor|樓)$)') AS address_like
  FROM place_candidates""")
def candidate_flags(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "place_candidates")
    return c.select("cand_id", predicates.food_category("category").alias("food"), predicates.other_category("category").alias("other"), predicates.commerce_category("category").alias("commerce"), predicates.coordinate_like("query_text").alias("by_point"), predicates.address_like("name").alias("address_like"))


_MARKERS = {"nw": ("norwend",), "os": ("ostravia",), "vm": ("valmarie",), "cd": ("cordesia",), "yi": ("yunmen isles",), "hk": ("hinokuni",)}


@query(f"SELECT row_id, {_terms('address', tuple(m for ms in _MARKERS.values() for m in ms))} AND NOT {_terms('address', _MARKERS['nw'])} AS mismatch FROM guide_rows")
def country_mismatch(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "guide_rows").select("row_id", predicates.country_mismatch("address", "nw", _MARKERS).alias("mismatch"))


_TKEY = lambda x: rf"lower(regexp_replace(trim(coalesce({x}, '')), '[_\s-]+', '-', 'g'))"


@query(f"""WITH e AS (SELECT kind, slug, label, label_local, status, url, lang FROM (SELECT *, row_number() OVER (PARTITION BY kind, slug ORDER BY list_position(['en', 'de', 'fr', 'es', 'ja', 'zh_TW'], lang), label) AS n
    FROM target_urls WHERE lang IN ('en', 'de', 'fr', 'es', 'ja', 'zh_TW')) WHERE n = 1),
  a AS (SELECT DISTINCT unnest([{_TKEY("slug")}, {_TKEY("label")}, {_TKEY("label_local")}]) AS alias, kind, slug, status, url, lang FROM e),
  b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY CASE kind WHEN 'city' THEN 0 ELSE 1 END, slug) AS n FROM a WHERE alias <> '') WHERE n = 1)
  SELECT g.row_id, g.city, b.kind, b.slug, b.status, b.url, b.lang AS entry_lang FROM guide_rows g LEFT JOIN b ON b.alias = {_TKEY("g.city")}""")
def target_lookup(spark: SparkSession, d: str) -> DataFrame:
    asked = load(spark, d, "guide_rows").select("row_id", "city")
    return routing.resolve_targets(asked, "city", load(spark, d, "target_urls"), ["en", "de", "fr", "es", "ja", "zh_TW"])


# ---- matching


_GRAMS = lambda x, n: f"CASE WHEN length({x}) = 0 THEN [] WHEN length({x}) <= {n} THEN [{x}] ELSE list_distinct(list_transform(range(1, length({x}) - {n} + 2), lambda i: substr({x}, i, {n}))) END"


@query(f"""SELECT case_id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE 200.0 * len(list_intersect(a, b)) / (len(a) + len(b)) END, 6) AS dice, round(CASE WHEN least(len(a), len(b)) = 0 THEN 0 ELSE 100.0 * len(list_intersect(a, b)) / least(len(a), len(b)) END, 6) AS contained
  FROM (SELECT case_id, {_GRAMS("x", 2)} AS a, {_GRAMS("y", 2)} AS b FROM (SELECT case_id, lower(coalesce(row_rec.name, '')) AS x, lower(coalesce(cand_rec.name, '')) AS y FROM matcher_cases))""")
def ngram_scores(spark: SparkSession, d: str) -> DataFrame:
    grams = load(spark, d, "matcher_cases").select("case_id", tx.ngrams(F.lower(tx.text("row_rec.name")), 2).alias("a"), tx.ngrams(F.lower(tx.text("cand_rec.name")), 2).alias("b"))
    return grams.select("case_id", F.round(tx.dice(F.col("a"), F.col("b")), 6).alias("dice"), F.round(tx.containment(F.col("a"), F.col("b")), 6).alias("contained"))


@query()
def failure_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Each failed row with the first accepted one of all candidates its attempts found.

    `n_pairs` counts all of them, `n_before` those before it. A failure whose attempts
    found nothing has a null candidate and no pairs. Candidates are assessed in their
    order until one is accepted, all of them where none is; each distinct pair of a
    row and a candidate once a round.
    """
    failures = load(spark, d, "target_failures")
    tries = packed.split_packed(failures, ["failure_id"], "attempted_queries").select("failure_id", "item_no", F.col("item_text").alias("query_text"))
    rows = failures.select("failure_id", F.struct("matcher_row.name", F.lit("").alias("name_local"), "matcher_row.city", "matcher_row.address", "matcher_row.cuisine").alias("row_rec"))
    cands = load(spark, d, "place_candidates").select("query_text", "cand_ord", "cand_id", F.struct("name", "address", "category", "subtitle", "located_in").alias("cand_rec"))
    # Scoring takes far more time than its bytes suggest: as many tasks as for the join.
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def accepted(met: DataFrame) -> DataFrame:
        met = cut(met.withColumn("pair", F.md5(F.to_json(F.struct("row_rec", "cand_rec")))))
        distinct = met.select("pair", "row_rec", "cand_rec").dropDuplicates(["pair"]).repartition(tasks, "pair")
        decided = cut(evidence.assessed(distinct).select("pair", "assessment.score", "assessment.accept"))
        return met.join(decided.where("accept").drop("accept"), "pair").drop("pair")

    found = ordering.first_listed(tries.join(rows, "failure_id"), cands, "failure_id", "item_no", "query_text", ["cand_ord", "cand_id"], accepted)
    every = failures.select("failure_id").distinct().join(found, "failure_id", "left")
    return every.select("failure_id", "cand_id", F.round("score", 4).alias("score"), F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), F.coalesce("n_before", F.lit(0)).alias("n_before"))


@query("""SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def embedding_cosine(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings").select("vec_id", "embedding")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(other, "vec_id").select("vec_id", F.round(evidence.cosine(F.col("embedding"), F.col("other")), 5).alias("cosine"))


# ---- evaluation


_PAIRED = f"""SELECT case_id, case_group, expected, threshold, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE 200.0 * len(list_intersect(a, b)) / (len(a) + len(b)) END, 6) >= threshold AS accept
  FROM (SELECT case_id, case_group, expected, {_GRAMS("x", 2)} AS a, {_GRAMS("y", 2)} AS b FROM (SELECT case_id, case_group, expected, lower(coalesce(row_rec.name, '')) AS x, lower(coalesce(cand_rec.name, '')) AS y FROM matcher_cases))
  CROSS JOIN (VALUES (30.0), (50.0), (70.0), (90.0)) t(threshold)"""
_COUNTED = f"SELECT threshold, count(*) FILTER (WHERE accept AND expected = 'match') AS tp, count(*) FILTER (WHERE accept AND expected = 'reject') AS fp, count(*) FILTER (WHERE NOT accept AND expected = 'match') AS fn, count(*) FILTER (WHERE NOT accept AND expected = 'reject') AS tn FROM ({_PAIRED}) GROUP BY threshold"


def _by_threshold(spark: SparkSession, d: str) -> DataFrame:
    dice = tx.dice(tx.ngrams(F.lower(tx.text("row_rec.name")), 2), tx.ngrams(F.lower(tx.text("cand_rec.name")), 2))
    cases = load(spark, d, "matcher_cases").select("case_id", "case_group", "expected", F.round(dice, 6).alias("dice"))
    return evaluation.over_choices(cases, "threshold", [30.0, 50.0, 70.0, 90.0]).withColumn("accept", F.col("dice") >= F.col("threshold"))


@query(f"""SELECT threshold, tp, fp, fn, tn, round(tp / greatest(1, tp + fp), 6) AS precision, round(tp / greatest(1, tp + fn), 6) AS recall FROM ({_COUNTED})""")
def strategy_confusion(spark: SparkSession, d: str) -> DataFrame:
    c = evaluation.confusion(_by_threshold(spark, d), ["threshold"], F.col("accept"), F.col("expected"))
    return c.select("threshold", "tp", "fp", "fn", "tn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"SELECT threshold, case_group, round(CASE WHEN count(*) FILTER (WHERE expected = 'match') = 0 THEN 1.0 ELSE count(*) FILTER (WHERE accept AND expected = 'match') / count(*) FILTER (WHERE expected = 'match') END, 6) AS recall FROM ({_PAIRED}) GROUP BY ALL")
def group_recall(spark: SparkSession, d: str) -> DataFrame:
    r = evaluation.group_recall(_by_threshold(spark, d), ["threshold"], "case_group", F.col("accept"), F.col("expected"))
    return r.select("threshold", "case_group", F.round("recall", 6).alias("recall"))


@query(f"SELECT threshold, tp, fp FROM ({_COUNTED}) WHERE tp > 0 ORDER BY tp - fp DESC, threshold LIMIT 1")
def best_threshold(spark: SparkSession, d: str) -> DataFrame:
    c = evaluation.confusion(_by_threshold(spark, d), ["threshold"], F.col("accept"), F.col("expected"))
    scored = c.select("threshold", "tp", "fp", (F.col("tp") - F.col("fp")).cast("double").alias("score"))
    return evaluation.select_strategy(scored, "score", "threshold", F.col("tp") > 0, margin=0.0).select("threshold", "tp", "fp")


@query("""SELECT name, address, city, house FROM (SELECT unnest([0.2, 0.3, 0.4, 0.5]) AS name) CROSS JOIN (SELECT unnest([0.1, 0.2, 0.3]) AS address) CROSS JOIN (SELECT unnest([0.1, 0.2, 0.3]) AS city) CROSS JOIN (SELECT unnest([0.0, 0.1, 0.2]) AS house)
  WHERE abs(CAST(name AS DOUBLE) + address + city + house - 1) <= 0.04""")
def weight_grid(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.weighted_grid(spark, {"name": [0.2, 0.3, 0.4, 0.5], "address": [0.1, 0.2, 0.3], "city": [0.1, 0.2, 0.3], "house": [0.0, 0.1, 0.2]})


@query("""SELECT case_group, CAST(minimum AS INT) AS minimum, n, n >= minimum AS met FROM (SELECT m.case_group, m.minimum, count(c.case_id) AS n FROM (VALUES ('same_address', 100), ('other_address', 50), ('thin_address', 50)) m(case_group, minimum)
  LEFT JOIN matcher_cases c ON c.case_group = m.case_group GROUP BY ALL UNION ALL SELECT 'all', 200, count(*) FROM matcher_cases)""")
def corpus_gate(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.corpus_gate(load(spark, d, "matcher_cases"), "case_group", {"same_address": 100, "other_address": 50, "thin_address": 50}, 200)


# ---- rendering and redaction


_P = lambda x: f"nullif({_collapse(x)}, '')"


@query(rf"""SELECT row_id, concat_ws(chr(10), nullif(concat_ws(' | ', {_P("guide_year")}, {_P("rating")}, {_P("cuisine")}, 'updated ' || {_P("strftime(loaded_at, '%Y-%m-%d')")}), ''), {_P("description")}) AS note FROM guide_rows""")
def guide_notes(spark: SparkSession, d: str) -> DataFrame:
    note = rendering.guide_note(F.col("guide_year"), F.col("rating"), F.col("cuisine"), F.date_format("loaded_at", "yyyy-MM-dd"), F.col("description"))
    return load(spark, d, "guide_rows").select("row_id", note.alias("note"))


@query(rf"""SELECT row_id, concat_ws(' | ', CASE WHEN {_P("name")} IS NOT NULL THEN 'Name: ' || replace({_P("name")}, '|', '｜') END, CASE WHEN {_P("cuisine")} IS NOT NULL AND {_P("city")} IS NOT NULL THEN replace({_P("cuisine")}, '|', '｜') || ' {{in}} ' || replace({_P("city")}, '|', '｜') END) AS note FROM guide_rows""")
def template_notes(spark: SparkSession, d: str) -> DataFrame:
    fields = F.create_map(F.lit("name"), F.col("name"), F.lit("cuisine"), F.col("cuisine"), F.lit("city"), F.col("city"))
    return load(spark, d, "guide_rows").select("row_id", rendering.template_note(fields, "Name: {name}|{cuisine} {{in}} {city}").alias("note"))


@query(f"""SELECT DISTINCT city, bucket, trim(regexp_replace('Food ' || coalesce(city, '') || ' ' || CASE bucket WHEN 'stars' THEN 'Stars' WHEN 'selected' THEN 'Selected' ELSE 'Bib Gourmand' END, '[\\s\\p{{Z}}]+', ' ', 'g')) AS list_name FROM {_ROUTED}""")
def list_names(spark: SparkSession, d: str) -> DataFrame:
    rows = _routed(spark, d).select("city", "bucket").distinct()
    labels = {"stars": "Stars", "selected": "Selected", "bib-gourmand": "Bib Gourmand"}
    return rows.select("city", "bucket", rendering.list_name("{prefix} {scope} {label}", "Food", tx.text("city"), F.col("bucket"), labels, {}).alias("list_name"))


@query()
def failure_records(spark: SparkSession, d: str) -> DataFrame:
    """Failures as lines of JSON."""
    return rendering.failure_records(load(spark, d, "target_failures"), ["failure_id", "level_slug", "row_key", "restaurant_name", "reason", "attempted_queries", "matcher_row"])


@query()
def redacted_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents de-identified, with what is still found; the rewrites look ahead, which the SQL dialect can't."""
    done = load(spark, d, "documents").select("doc_id", redaction.redacted("text").alias("clean"))
    return done.select("doc_id", "clean", F.array_join(redaction.markers("clean"), ",").alias("left_over"))


@query(rf"""SELECT h.house_id, c.cand_id, CASE WHEN {_PART("h.house_name")} = {_PART("c.name")} THEN 3 ELSE 2 END AS score FROM house_directory h JOIN place_candidates c
  ON {_PART("c.name")} = {_PART("h.house_name")} OR (starts_with({_PART("c.name")}, {_PART("h.house_name")}) AND regexp_matches(substr({_PART("c.name")}, length({_PART("h.house_name")}) + 1), '^[\s·•,，:：|(（]'))""")
def list_matches(spark: SparkSession, d: str) -> DataFrame:
    """Candidates whose name is a house's, or begins with it; joined by their first word."""
    first = lambda c: F.split(F.lower(tx.collapse(c)), r"[\s·•,，:：|(（]")[0]
    h = load(spark, d, "house_directory").select("house_id", "house_name", first("house_name").alias("w"))
    c = load(spark, d, "place_candidates").select("cand_id", "name", first("name").alias("w"))
    h = F.broadcast(h) if h.count() <= 100_000 else h
    return c.join(h, "w").select("house_id", "cand_id", redaction.list_match("house_name", "name").alias("score")).where("score > 0")


# ---- sources and streams


_STRIP = lambda x: rf"regexp_replace(replace(coalesce({x}, ''), chr(13) || chr(10), chr(10)), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


@query(f"""SELECT row_id, name, address, round(latitude, 6) AS lat, round(longitude, 6) AS lon, CASE WHEN name = '' THEN 'skipped' WHEN latitude IS NULL AND address = '' THEN 'unsupported' ELSE 'ok' END AS status
  FROM (SELECT row_id, {_STRIP("name")} AS name, latitude, longitude, {_STRIP("address")} AS address FROM guide_rows)""")
def kml_rows(spark: SparkSession, d: str) -> DataFrame:
    """Guide rows written as placemarks and read again; where there is no address, the point stands for it and isn't shown."""
    plain = lambda c: F.replace(F.replace(F.replace(tx.text(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    point = F.when(F.col("latitude").isNotNull(), F.format_string("<Point><coordinates>%.6f,%.6f,0</coordinates></Point>", "longitude", "latitude")).otherwise("")
    doc = F.concat(F.lit('<kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>x</name><Placemark><name>'), plain("name"), F.lit("</name><address>"), plain("address"), F.lit("</address>"), point, F.lit("</Placemark></Document></kml>"))
    content = load(spark, d, "guide_rows").select(F.col("row_id").cast("string").alias("path"), doc.cast("binary").alias("content"))
    rows = kml.place_rows(kml.placemarks(content))
    by_point = F.col("address") == F.concat_ws(",", F.col("lat").cast("string"), F.col("lon").cast("string"))
    return rows.select(F.col("path").cast("long").alias("row_id"), "name", F.when(F.coalesce(by_point, F.lit(False)), "").otherwise(F.col("address")).alias("address"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "status")


@query("""SELECT lang, kind, slug, status, source, url, reason FROM (SELECT *, row_number() OVER (PARTITION BY lang, kind, slug ORDER BY label) AS n FROM target_urls) WHERE n = 1""")
def catalogue_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue written as JSON and read again."""
    u = load(spark, d, "target_urls").groupBy("lang", "kind", "slug").agg(F.min_by(F.struct("status", "source", "url", "reason"), "label").alias("e")).select("lang", "kind", "slug", "e.*")
    return files.catalogue_rows(files.catalogue_json(u), "value")


@query(_STATUS)
def stream_sync(spark: SparkSession, d: str) -> DataFrame:
    """Guide rows arriving as a stream, written once per batch, the first accepted row of a key being added."""
    import uuid

    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = load(spark, d, "guide_rows").schema
    rows = spark.readStream.schema(schema).parquet(f"{d}/guide_rows.parquet*")
    routed = routing.route_rows(rows, "rating", strict=False).select("row_id", "bucket", _identity().alias("row_key"), tx.text("address").alias("address"))
    sync.start_sync(routed, f"{base}/out", f"{base}/state", ["row_key"], [F.col("row_id")], lambda df: df.withColumn("accepted", F.col("address") != "")).awaitTermination()
    return spark.read.parquet(f"{base}/out").select("row_id", "bucket", "status")

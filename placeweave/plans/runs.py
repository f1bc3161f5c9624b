"""Queries over runs: checkpoints, lookups, sinks, progress and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.functions import text as tx
from placeweave.operators import evaluation, predicates, redaction, rendering, resume, routing, sinks, summary
from placeweave.plans.queries import _ROUTED, _STATUS, _collapse, _routed, _statuses, query
from placeweave.session import load, shared_dir
from placeweave.sources import adapters, files

LEVELS = ("stars", "selected", "bib-gourmand")


# ---- checkpoints


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of runs, one run for each city: every page but the last one leads to the next; cities of more than two pages stopped before their last."""
    from pyspark.sql import Window

    rows = load(spark, d, "guide_rows").where("city is not null and page_no is not null").groupBy("city", "page_no").agg(F.count("*").cast("int").alias("n"))
    of = Window.partitionBy("city").orderBy("page_no")
    whole = Window.partitionBy("city")
    pages = rows.select(
        "city", F.col("page_no").alias("page_number"), F.lead("page_no").over(of).alias("following"), F.sum("n").over(of).cast("int").alias("total_restaurants"), F.count("*").over(whole).cast("int").alias("n_pages"), F.row_number().over(of).alias("seq")
    )
    url = lambda n: F.concat(F.lit("https://g.example/"), F.col("city"), F.lit("/page/"), n.cast("string"))
    kept = pages.where((F.col("n_pages") < 3) | (F.col("seq") < F.col("n_pages")))
    return kept.select("city", F.concat(F.lit("https://g.example/"), F.col("city")).alias("start_url"), "page_number", url(F.col("page_number")).alias("page_url"), url(F.col("following")).alias("next_url"), F.coalesce("following", F.col("page_number") + 1).cast("int").alias("next_page_number"), F.when(F.col("n_pages") > 3, F.col("n_pages")).alias("estimated_total_pages"), "total_restaurants")


_RUN_PAGES = """(SELECT city, page_no AS page_number, CAST(lead(page_no) OVER w AS INT) AS following, CAST(sum(n) OVER w AS INT) AS total_restaurants, CAST(count(*) OVER (PARTITION BY city) AS INT) AS n_pages, row_number() OVER w AS seq
  FROM (SELECT city, page_no, count(*) AS n FROM guide_rows WHERE city IS NOT NULL AND page_no IS NOT NULL GROUP BY ALL) WINDOW w AS (PARTITION BY city ORDER BY page_no))"""
_LAST_PAGES = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY page_number DESC) AS back FROM {_RUN_PAGES} WHERE n_pages < 3 OR seq < n_pages) WHERE back = 1)"
_LEVEL_COUNTS = f"(SELECT city, CAST(count(*) FILTER (WHERE bucket = 'stars') AS INT) AS stars, CAST(count(*) FILTER (WHERE bucket = 'selected') AS INT) AS selected, CAST(count(*) FILTER (WHERE bucket = 'bib-gourmand') AS INT) AS bib FROM {_ROUTED} WHERE city IS NOT NULL GROUP BY city)"


def _checkpoints(spark: SparkSession, d: str, saved) -> DataFrame:
    rows = _routed(spark, d).where("city is not null")
    keys = rows.select("city", F.concat(F.lit("k"), F.col("row_id").cast("string")).alias("row_key"))
    return saved(_pages(spark, d), "city", "start_url", resume.level_counts(rows, "city", "bucket", LEVELS), keys, "row_key")


@query(f"""SELECT l.city, CASE WHEN following IS NOT NULL THEN page_number END AS last_page_number, CASE WHEN following IS NOT NULL THEN 'https://g.example/' || l.city || '/page/' || following END AS next_url, CASE WHEN following IS NOT NULL THEN following END AS next_page_number,
  CASE WHEN following IS NOT NULL AND n_pages > 3 THEN n_pages END AS estimated_total_pages, CASE WHEN following IS NOT NULL THEN total_restaurants END AS total_restaurants, CASE WHEN following IS NOT NULL THEN c.selected END AS n_selected, CASE WHEN following IS NOT NULL THEN c.stars END AS n_stars,
  CASE WHEN following IS NOT NULL THEN CAST((SELECT count(*) FROM {_ROUTED} r WHERE r.city = l.city) AS INT) END AS n_keys FROM {_LAST_PAGES} l LEFT JOIN {_LEVEL_COUNTS} c ON c.city = l.city""")
def checkpoint_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Checkpoints of interrupted and ended runs, written as JSON and read back; an ended run leaves none."""
    saved = _checkpoints(spark, d, resume.saved_checkpoints)
    s = files.checkpoint_state(saved, "value", F.col("start_url"))
    return s.select("city", "state.last_page_number", "state.next_url", "state.next_page_number", "state.estimated_total_pages", "state.total_restaurants", F.col("state.rows_per_level")["selected"].alias("n_selected"), F.col("state.rows_per_level")["stars"].alias("n_stars"), F.when(F.col("state").isNotNull(), F.size("state.synced_row_keys")).alias("n_keys"))


_PLAN = f"""SELECT l.city, CASE WHEN goes THEN url ELSE 'https://g.example/' || l.city END AS start_scrape_url, CASE WHEN goes THEN page ELSE 1 END AS start_page_number, CASE WHEN goes AND n_pages > 3 THEN n_pages END AS start_estimated_total_pages,
  CASE WHEN goes THEN total_restaurants ELSE 0 END AS initial_total_restaurants, CASE WHEN goes THEN c.bib ELSE 0 END AS n_bib, CASE WHEN l.city LIKE 'B%' THEN 'ignored' END AS warning"""


@query(f"""{_PLAN} FROM (SELECT *, following IS NOT NULL AND city NOT LIKE 'B%' AS goes, 'https://g.example/' || city || '/page/' || following AS url, following AS page FROM {_LAST_PAGES}) l LEFT JOIN {_LEVEL_COUNTS} c ON c.city = l.city""")
def resume_plan(spark: SparkSession, d: str) -> DataFrame:
    """How each run goes on: from its checkpoint, or afresh where it has none or is told to ignore it."""
    return _plan(_checkpoints(spark, d, resume.saved_checkpoints))


@query(f"""{_PLAN} FROM (SELECT *, city NOT LIKE 'B%' AS goes, 'https://g.example/' || city || '/page/' || page_number AS url, page_number AS page FROM {_LAST_PAGES}) l LEFT JOIN {_LEVEL_COUNTS} c ON c.city = l.city""")
def interrupted_plan(spark: SparkSession, d: str) -> DataFrame:
    """How runs go on that stopped on a page: with that page once more."""
    return _plan(_checkpoints(spark, d, resume.interrupted_checkpoints))


def _plan(saved: DataFrame) -> DataFrame:
    plans = resume.resume_plans(saved, "start_url", "value", LEVELS, F.col("city").startswith("B"))
    return plans.select("city", "start_scrape_url", "start_page_number", "start_estimated_total_pages", "initial_total_restaurants", F.coalesce(F.col("row_counts")["bib-gourmand"], F.lit(0)).alias("n_bib"), "warning")


@query("""SELECT failure_id, CASE failure_id % 8 WHEN 0 THEN 'empty' WHEN 1 THEN 'unreadable' WHEN 2 THEN 'other version' WHEN 3 THEN 'other start' WHEN 4 THEN 'no next page' WHEN 5 THEN 'bad page number' WHEN 6 THEN 'bad estimate' END AS warning FROM target_failures""")
def checkpoint_faults(spark: SparkSession, d: str) -> DataFrame:
    """Checkpoints with one fault each, and the warning each gives."""
    k = F.col("failure_id") % 8
    doc = lambda version=1, start="s", following="n", number=2, pages=3: F.lit(f'{{"version": {version}, "start_url": "{start}", "next_url": "{following}", "next_page_number": {number}, "total_restaurants": 5, "rows_per_level": {{"stars": 1}}, "estimated_total_pages": {pages}}}')
    value = F.when(k == 0, "").when(k == 1, "not json").when(k == 2, doc(version=9)).when(k == 3, doc(start="t")).when(k == 4, doc(following="")).when(k == 5, doc(number=0)).when(k == 6, doc(pages=0)).otherwise(doc())
    states = files.checkpoint_state(load(spark, d, "target_failures").select("failure_id", value.alias("value")), "value", "s")
    return states.select("failure_id", "warning")


@query("""SELECT house_id, CASE WHEN coalesce(cuisine, '') = '' THEN '.placeweave-state' ELSE '/state' END || '/' || coalesce(nullif(trim(regexp_replace(lower(trim(coalesce(house_name, ''))), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'places') || '-checkpoint.json' AS path FROM house_directory""")
def state_paths(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "house_directory").select("house_id", resume.state_path(F.when(tx.text("cuisine") != "", "/state/"), "house_name").alias("path"))


# ---- lookups


_SLUG = "coalesce(nullif(trim(regexp_replace(lower(trim(coalesce(city, ''))), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'none')"


def _requested(spark: SparkSession, d: str) -> DataFrame:
    asked = load(spark, d, "guide_rows").select(tx.slug("city", "none").alias("slug")).distinct()
    more = load(spark, d, "nation").select(tx.slug("n_name", "none").alias("slug"))
    return asked.unionByName(more).distinct().withColumn("code", F.substring("slug", 1, 2))


def _target_sql(order: str, missing: str) -> str:
    return f"""WITH r AS (SELECT DISTINCT slug, left(slug, 2) AS code FROM (SELECT {_SLUG} AS slug FROM guide_rows UNION ALL SELECT trim(regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g'), '-') FROM nation)),
  e AS (SELECT * FROM (SELECT slug, lang, status, url, row_number() OVER (PARTITION BY slug ORDER BY list_position({order}, lang)) AS n FROM target_urls WHERE lang IN (SELECT unnest({order}))) WHERE n = 1)
  SELECT r.slug, CASE WHEN e.slug IS NULL THEN {missing} WHEN e.status = 'supported' AND coalesce(e.url, '') <> '' THEN e.url END AS url, e.slug IS NOT NULL AND NOT (e.status = 'supported' AND coalesce(e.url, '') <> '') AS refused FROM r LEFT JOIN e ON e.slug = r.slug"""


def _targets(spark: SparkSession, d: str, language: str) -> DataFrame:
    found = routing.target_urls(_requested(spark, d), "slug", "code", load(spark, d, "target_urls"), language, "https://g.example", strict=False)
    return found.select("slug", "url", F.col("reason").isNotNull().alias("refused"))


@query(_target_sql("['zh_CN', 'zh_TW', 'zh_HK']", "'https://g.example/tw/zh_TW/selection/' || r.slug || '/restaurants'"))
def target_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of targets in a language that others stand in for: the catalogue's, or its site's."""
    return _targets(spark, d, "zh_CN")


@query(_target_sql("['en']", "'https://g.example/en/' || r.code || '/restaurants'"))
def target_generic(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of targets in a language without a site of its own: the catalogue's, or by country code."""
    return _targets(spark, d, "en")


@query("""SELECT slug, coalesce(o.label, nullif(t.label, ''), array_to_string(list_transform(string_split(slug, '-'), lambda w: upper(w[1]) || lower(w[2:])), ' ')) AS shown FROM (SELECT slug, CASE WHEN length(slug) % 3 = 0 THEN '' ELSE min(label) END AS label FROM target_urls WHERE lang = 'en' GROUP BY slug) t
  LEFT JOIN (SELECT slug, min(label_local) AS label FROM target_urls WHERE lang = 'ja' AND coalesce(label_local, '') <> '' GROUP BY slug) o USING (slug)""")
def label_overrides(spark: SparkSession, d: str) -> DataFrame:
    """The names of cities in Japanese, else their own, else their slug in words."""
    u = load(spark, d, "target_urls")
    own = u.where("lang = 'en'").groupBy("slug").agg(F.min("label").alias("label")).withColumn("label", F.when(F.length("slug") % 3 == 0, "").otherwise(F.col("label")))
    return routing.labelled(own, "slug", u.select("lang", "slug", F.col("label_local").alias("label")), "ja").select("slug", "shown")


@query("""SELECT n_nationkey, CASE lower(left(n_name, 2)) WHEN 'fr' THEN 'fr' WHEN 'ca' THEN 'en' WHEN 'br' THEN 'pt' WHEN 'ar' THEN 'es' WHEN 'jp' THEN 'ja' WHEN 'my' THEN 'en' WHEN 'it' THEN 'it' WHEN 'es' THEN 'es' WHEN 'ch' THEN 'fr' WHEN 'de' THEN 'de' WHEN 'vn' THEN 'en' WHEN 'us' THEN 'en' WHEN 'kr' THEN 'ko' WHEN 'mo' THEN 'zh_HK' END AS language FROM nation""")
def local_languages(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "nation").select("n_nationkey", routing.local_language(F.lower(F.substring("n_name", 1, 2))).alias("language"))


@query("""SELECT row_id, CASE WHEN coalesce(name, '') = '' OR (regexp_matches(name, '[A-Za-z]') AND strlen(name) <> length(name) AND strlen(coalesce(name_local, '')) <> length(coalesce(name_local, ''))) THEN coalesce(name_local, '') ELSE name END AS scope FROM guide_rows""")
def scope_choices(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "guide_rows").select("row_id", routing.chosen_scope("name", "name_local").alias("scope"))


@query(r"""SELECT query_text, CASE lower(regexp_replace(trim(query_text), '[_\s]+', '-', 'g')) WHEN 'zh-tw' THEN 'zh_TW' WHEN 'where-to-eat-tonight-kestrelhaven' THEN 'en' ELSE lower(regexp_replace(trim(query_text), '[_\s]+', '-', 'g')) END AS language FROM (SELECT DISTINCT query_text FROM place_candidates WHERE trim(coalesce(query_text, '')) <> '')""")
def language_aliases(spark: SparkSession, d: str) -> DataFrame:
    asked = load(spark, d, "place_candidates").select("query_text").where(F.trim(tx.text("query_text")) != "").distinct()
    return routing.resolve_languages(asked, "query_text", {"zh-tw": "zh_TW", "where-to-eat-tonight-kestrelhaven": "en"})


@query("""SELECT slug, CASE WHEN hit IS NULL THEN 'unsupported' ELSE 'supported' END AS status, CASE WHEN hit IS NULL THEN 'live-validation' WHEN hit = slug THEN 'validated-selection-candidate' ELSE 'validated-alternate-selection-candidate' END AS source, coalesce('https://g.example/' || hit, '') AS url,
  CASE WHEN hit IS NULL THEN 'no candidate is valid: ' || slug || ': HTTP 404 (); ' || slug || '-2: HTTP 404 ()' END AS reason FROM (SELECT slug, CASE WHEN length(slug) % 3 = 0 THEN slug WHEN length(slug) % 3 = 1 THEN slug || '-2' END AS hit FROM (SELECT DISTINCT slug FROM target_urls))""")
def discovered_targets(spark: SparkSession, d: str) -> DataFrame:
    """Catalogue entries from candidate addresses, the first or the second of which is valid, or none."""
    slugs = load(spark, d, "target_urls").select("slug").distinct()
    tried = slugs.select("slug", F.posexplode(F.array(F.col("slug"), F.concat("slug", F.lit("-2")))).alias("o", "candidate"))
    checked = tried.select("*", F.concat(F.lit("https://g.example/"), F.col("candidate")).alias("url"), (F.length("slug") % 3 == F.col("o")).alias("ok"), F.lit("HTTP 404").alias("detail"), F.lit("").alias("title"))
    return routing.discovered_entries(checked, "slug", "o")


# ---- sinks and reports


@query(f"SELECT bucket, count(*) AS skipped FROM {_ROUTED} GROUP BY bucket")
def dry_run_counts(spark: SparkSession, d: str) -> DataFrame:
    return sinks.dry_run(_routed(spark, d)).where("status = 'skipped'").groupBy("bucket").agg(F.count("*").alias("skipped"))


@query(f"SELECT row_id, CASE WHEN coalesce(address, '') <> '' THEN 'skipped' ELSE 'failed' END AS status FROM {_ROUTED}")
def probe_statuses(spark: SparkSession, d: str) -> DataFrame:
    """Rows that are only matched; repeated ones are each matched."""
    return sinks.probed(_routed(spark, d), tx.text("address") != "").select("row_id", "status")


@query("SELECT failure_id, level_slug, restaurant_name, reason FROM target_failures WHERE coalesce(reason, '') <> ''")
def error_report(spark: SparkSession, d: str) -> DataFrame:
    """Failures written as lines of JSON over an older report, and read again."""
    path = f"{shared_dir(spark)}/report-{uuid.uuid4().hex}"
    failures = load(spark, d, "target_failures").select("failure_id", "level_slug", "restaurant_name", "reason")
    sinks.write_error_report(failures.limit(1), path)
    sinks.write_error_report(failures.where(tx.text("reason") != ""), path)
    return spark.read.schema(failures.schema).json(path)


@query(f"""SELECT sum(scraped) AS scraped, greatest(sum(scraped) - sum(before), 0) AS session, sum(added) AS added, sum(skipped) AS skipped, sum(failed) AS failed, sum(failed) > 0 AND sum(added) = 0 AS hard_failure, CAST(CASE WHEN sum(failed) > 0 THEN 1 ELSE 0 END AS INT) AS exit_code
  FROM (SELECT bucket, count(*) AS scraped, count(*) FILTER (WHERE row_id % 3 = 0) AS before, count(*) FILTER (WHERE status = 'added') AS added, count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status = 'failed') AS failed FROM ({_STATUS}) GROUP BY bucket)""")
def final_summary(spark: SparkSession, d: str) -> DataFrame:
    counts = {s: F.count_if(F.col("status") == s).alias(s) for s in ("added", "skipped", "failed")}
    per = _statuses(spark, d).groupBy("bucket").agg(F.count("*").alias("scraped"), F.count_if(F.col("row_id") % 3 == 0).alias("before"), *counts.values())
    return summary.final_summary(per)


@query("SELECT count(*) AS total_rows, count(DISTINCT page_no) AS processed_pages, count(*) FILTER (WHERE coalesce(name, '') = '') AS skipped_rows, count(*) FILTER (WHERE coalesce(name, '') <> '' AND coalesce(address, '') = '') AS unsupported_rows FROM guide_rows")
def run_metrics(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(tx.text("name") == "", "skipped").when(tx.text("address") == "", "unsupported").otherwise("ok")
    return summary.run_metrics(load(spark, d, "guide_rows"), "page_no", status)


@query(f"SELECT count(*) AS scraped, count(*) FILTER (WHERE status = 'added') AS added, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'skipped') AS skipped FROM ({_STATUS}) WHERE row_id % 1000 <= 500")
def partial_totals(spark: SparkSession, d: str) -> DataFrame:
    """What was done when a run was interrupted."""
    return summary.partial_totals(_statuses(spark, d), F.col("row_id") % 1000, F.lit(500), "status")


@query("""SELECT cand_id, gram, count(*) AS n FROM (SELECT cand_id, unnest(list_concat(g2, g3)) AS gram FROM (SELECT cand_id, CASE WHEN length(c) = 0 THEN [] WHEN length(c) <= 2 THEN [c] ELSE list_distinct(list_transform(range(1, length(c)), lambda i: substr(c, i, 2))) END AS g2,
  CASE WHEN length(c) = 0 THEN [] WHEN length(c) <= 3 THEN [c] ELSE list_distinct(list_transform(range(1, length(c) - 1), lambda i: substr(c, i, 3))) END AS g3 FROM (SELECT cand_id, regexp_replace(lower(coalesce(category, '')), '[^a-z0-9]', '', 'g') AS c FROM place_candidates))) GROUP BY ALL""")
def gram_counts(spark: SparkSession, d: str) -> DataFrame:
    """Grams of every candidate's category with their counts."""
    return summary.gram_counts(load(spark, d, "place_candidates"), "cand_id", F.regexp_replace(F.lower(tx.text("category")), "[^a-z0-9]", ""), (2, 3))


@query("""SELECT row_id, round(CASE WHEN row_id % 3 = 0 THEN least(0.99, (page_no * 10 + card_ord + card_ord / 12.0) / 500) WHEN row_id % 3 = 1 THEN (page_no - 1 + card_ord / 12.0) / 40 END, 6) AS progress FROM guide_rows""")
def progress_estimates(spark: SparkSession, d: str) -> DataFrame:
    k, page, card = F.col("row_id") % 3, F.col("page_no"), F.col("card_ord")
    share = summary.estimated_progress(page, card, F.lit(12), F.when(k == 1, 40), F.when(k == 0, 500), page * 10, card)
    return load(spark, d, "guide_rows").select("row_id", F.round(share, 6).alias("progress"))


_PROGRESS = "(SELECT query_text, cand_id, cand_ord, max(least(1.0, 0.05 + 0.95 * greatest(cand_ord / 20.0, (cand_id % 7) / 40.0))) OVER (PARTITION BY query_text ORDER BY cand_ord, cand_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS progress FROM place_candidates WHERE cand_id % 1 = 0)"


def _progress(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "place_candidates").select("query_text", "cand_id", "cand_ord")
    return summary.overall_progress(rows, ["query_text"], [F.col("cand_ord"), F.col("cand_id")], F.col("cand_ord") / 20.0, F.col("cand_id") % 7, F.lit(40))


@query(f"SELECT cand_id, round(progress, 6) AS progress FROM {_PROGRESS}")
def overall_progress(spark: SparkSession, d: str) -> DataFrame:
    """Progress of searches that never falls."""
    return _progress(spark, d).select("cand_id", F.round("progress", 6).alias("progress"))


@query(f"SELECT cand_id, CAST(step AS BIGINT) AS step FROM (SELECT *, lag(step) OVER (PARTITION BY query_text ORDER BY cand_ord, cand_id) AS b FROM (SELECT *, floor(round(progress, 6) * 20) AS step FROM {_PROGRESS})) WHERE b IS NULL OR step > b")
def progress_steps(spark: SparkSession, d: str) -> DataFrame:
    """The lines a log shows of them, one for each twentieth."""
    rows = _progress(spark, d).withColumn("progress", F.round("progress", 6))
    return summary.reported_steps(rows, ["query_text"], [F.col("cand_ord"), F.col("cand_id")], "progress").select("cand_id", F.col("step").cast("long").alias("step"))


@query("""SELECT cand_id, CASE WHEN coalesce(category, '') = '' OR (cand_ord % 2 = 1 AND cand_id % 10 < 5) THEN false WHEN (coalesce(name, '') <> '' AND coalesce(name, '') <> coalesce(query_text, '')) THEN true WHEN coalesce(address, '') <> '' AND coalesce(address, '') <> coalesce(subtitle, '') AND cand_id % 10 >= 5 THEN true
  WHEN cand_id % 3 <> 0 OR cand_id % 10 < 5 THEN false ELSE coalesce(name, '') <> '' AND coalesce(query_text, '') = '' END AS fresh FROM place_candidates""")
def fresh_states(spark: SparkSession, d: str) -> DataFrame:
    """Whether a panel shows the answer to the last search, its states made of candidates' fields."""
    before = F.struct(F.col("subtitle").alias("page_url"), F.lit("").alias("title"), F.col("query_text").alias("first_result"))
    now = F.struct(F.col("address").alias("page_url"), F.lit("").alias("title"), F.col("name").alias("first_result"), (tx.text("category") == "").alias("no_results"), (F.col("cand_ord") % 2 == 1).alias("loading"))
    rows = load(spark, d, "place_candidates").select("cand_id", before.alias("b"), now.alias("n"))
    return rows.select("cand_id", summary.fresh_state("b", "n", F.col("cand_id") % 10, F.lit(5), F.col("cand_id") % 3 == 0).alias("fresh"))


@query("SELECT failure_id, CAST(row_number() OVER (ORDER BY failed_at DESC, failure_id) AS INT) AS rank FROM target_failures ORDER BY failed_at DESC, failure_id LIMIT 20")
def last_failures(spark: SparkSession, d: str) -> DataFrame:
    """The twenty failures a run's end shows."""
    return summary.first_of(load(spark, d, "target_failures"), [F.desc("failed_at"), F.col("failure_id")]).select("failure_id", "rank")


_FIELD = lambda x: f"nullif(replace({_collapse(x)}, '|', '｜'), '')"


@query(f"SELECT row_id, concat_ws(' | ', {_FIELD('CAST(card_ord AS VARCHAR)')} || '碗', {_FIELD('name')}, {_FIELD('cuisine')}, {_FIELD('address')}, {_FIELD('restaurant_telephone_number')}) AS note FROM guide_rows")
def bowls_notes(spark: SparkSession, d: str) -> DataFrame:
    fields = {"總得晚數": F.col("card_ord").cast("string"), "得獎菜色": F.col("name"), "菜系": F.col("cuisine"), "地址": F.col("address"), "電話": F.col("restaurant_telephone_number")}
    return load(spark, d, "guide_rows").select("row_id", rendering.bowls_note(F.create_map(*(x for k, v in fields.items() for x in (F.lit(k), v)))).alias("note"))


@query("""SELECT case_id, 'Candidate(name=''' || replace(coalesce(cand_rec.name, ''), '''', '\\''') || ''', address=''' || replace(coalesce(cand_rec.address, ''), '''', '\\''') || ''', category=''' || replace(coalesce(cand_rec.category, ''), '''', '\\''') || ''', subtitle=''' || replace(coalesce(cand_rec.subtitle, ''), '''', '\\''') || ''', located_in=''' || replace(coalesce(cand_rec.located_in, ''), '''', '\\''') || ''')' AS line FROM matcher_cases""")
def debug_lines(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "matcher_cases").select("case_id", rendering.candidate_line("cand_rec").alias("line"))


# ---- evaluation


@query("""SELECT name, address, city, house, category, ngram, count(*) AS n FROM (SELECT unnest([0.26, 0.30, 0.34]) AS name) CROSS JOIN (SELECT unnest([0.18, 0.22, 0.26, 0.30]) AS address) CROSS JOIN (SELECT unnest([0.10, 0.14, 0.18]) AS city) CROSS JOIN (SELECT unnest([0.08, 0.12, 0.16]) AS house)
  CROSS JOIN (SELECT unnest([0.06, 0.08, 0.10]) AS category) CROSS JOIN (SELECT unnest([0.04, 0.08, 0.12, 0.16]) AS ngram) CROSS JOIN range(486) WHERE abs(CAST(name AS DOUBLE) + CAST(address AS DOUBLE) + CAST(city AS DOUBLE) + CAST(house AS DOUBLE) + CAST(category AS DOUBLE) + CAST(0.04 AS DOUBLE) + CAST(0.04 AS DOUBLE) + CAST(ngram AS DOUBLE) - CAST(1 AS DOUBLE)) <= CAST(0.04 AS DOUBLE) GROUP BY ALL""")
def weighted_configurations(spark: SparkSession, d: str) -> DataFrame:
    """All configurations of the weighted strategy, counted by their weights."""
    return evaluation.weighted_configurations(spark).groupBy(*evaluation.WEIGHT_CHOICES).agg(F.count("*").alias("n"))


@query("""SELECT CAST(least AS INT) AS ngram_min, CAST(most AS INT) AS ngram_max, share, 1.0 - share AS evidence_share, medium, strong FROM (VALUES (2, 3), (2, 4), (3, 5)) s(least, most) CROSS JOIN (SELECT unnest([0.25, 0.35, 0.45, 0.55]) AS share) CROSS JOIN (SELECT unnest([50.0, 54.0, 58.0, 62.0]) AS medium) CROSS JOIN (SELECT unnest([78.0, 82.0, 86.0]) AS strong)""")
def ngram_configurations(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.ngram_configurations(spark)


@query("""SELECT row_id, text_ok, value_ok FROM (SELECT row_id, coalesce(address, '') <> '' AND regexp_matches(' ' || coalesce(address, '') || ' ', '[\\s·•,，.。:：;；|/()（）\\[\\]「」"''-]' || '12' || '[\\s·•,，.。:：;；|/()（）\\[\\]「」"''-]') AS text_ok,
  lower(trim(coalesce(name, ''))) = lower(trim(coalesce(name_local, ''))) OR (trim(coalesce(name, '')) <> '' AND trim(coalesce(name_local, '')) <> '' AND (contains(lower(trim(name)), lower(trim(name_local))) OR contains(lower(trim(name_local)), lower(trim(name))))) AS value_ok FROM guide_rows WHERE NOT regexp_matches(coalesce(name, '') || coalesce(name_local, ''), '[\\n\\r\\t]'))""")
def list_texts(spark: SparkSession, d: str) -> DataFrame:
    """Whether an address holds the number 12 by itself, and whether two names are one note."""
    g = load(spark, d, "guide_rows").where(~F.concat(tx.text("name"), tx.text("name_local")).rlike("[\\n\\r\\t]"))
    return g.select("row_id", redaction.bounded_contains(tx.text("address"), F.lit("12")).alias("text_ok"), redaction.same_note("name", "name_local").alias("value_ok"))


@query(f"""SELECT cand_id, {_collapse("query_text")} <> '' AND lower({_collapse("query_text")}) = lower({_collapse("address")}) AND lower({_collapse("query_text")}) <> lower({_collapse("name")}) AS by_address, {_collapse("located_in")} <> '' AND lower({_collapse("name")}) = lower({_collapse("located_in")}) AS landing,
  regexp_matches(coalesce(address, ''), '夜市|市場|門口|入口|附近|對面|隔壁|旁邊|\\d\\s*號\\s*[a-z0-9\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}\\x{{f900}}-\\x{{faff}}]{{0,16}}[前旁]') AS vague, regexp_matches(coalesce(name, ''), '廟口|路口|街口|巷口|夜市|市場|入口|門口|附近|對面') AS landmark,
  regexp_matches(lower({_collapse("name")}), '^(no\\.? ?\\d|\\d+ ?(f|floor|樓)$)') AS floor FROM place_candidates""")
def candidate_predicates(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "place_candidates")
    return c.select("cand_id", predicates.address_only_query(F.col("query_text"), F.col("address"), [F.col("name")]).alias("by_address"), predicates.list_landing(F.col("name"), F.col("located_in")).alias("landing"), predicates.low_precision("address").alias("vague"), predicates.landmark_name("name").alias("landmark"), predicates.floor_or_number("name").alias("floor"))


# ---- redaction

_SECRETS = {
    "mail": ("write to jo.doe+x@mail.example.org, please", "write to <redacted-email>, please"), "query": ("/p?token=abc.1&page=2&amp;key=k9", "/p?token=<redacted>&page=2&amp;key=<redacted>"), "cookie": ("SID = q1w2; path=/; hsid=zz", "SID = <redacted>; path=/; hsid=<redacted>"),
    "json": ('{"email" : "a b", "sid":"1", "name": "n"}', '{"email" : "<redacted>", "sid":"<redacted>", "name": "n"}'), "path": ("/Users/jo/work and /Users/<redacted-user>/x", "/Users/<redacted-user>/work and /Users/<redacted-user>/x"),
    "avatar": ("https://lh3.googleusercontent.com/ogw/AbC-1=s32 lh3.googleusercontent.com/ogw/Q", "https://lh3.googleusercontent.com/ogw/<redacted-account-avatar> lh3.googleusercontent.com/ogw/<redacted-account-avatar>"),
    "name": ('<div class="gb_g">Jo Doe</div>', '<div class="gb_g"><redacted-account-name></div>'), "label": ('<a aria-label="Google Account: Jo Doe  (jo@x.example.com)">', '<a aria-label="Google Account: <redacted-account-name>">'),
    "mailed": ('aria-label="Google Account: Jo Doe jo@x.example.com"', 'aria-label="Google Account: <redacted-account-name> <redacted-email>"'), "escaped": ("Google Account: Jo Doe\\u0026#10;jo@x.example.com end", "Google Account: <redacted-account-name>\\u0026#10;<redacted-email> end"),
    "nested": ('"Jo Doe\\u003c/div\\u003e\\u003cdiv\\u003ejo@x.example.com', '"<redacted-account-name>\\u003c/div\\u003e\\u003cdiv\\u003e<redacted-email>'), "key": ("AIzaSyA1234567890123456789 AIzaSyFAKE_KEY_FOR_TESTING_ONLY_00000000", "AIza<redacted> AIzaSyFAKE_KEY_FOR_TESTING_ONLY_00000000"),
}
_MARKED = ("email", "query-token", "cookie-token", "json-token", "user-path", "google-account-avatar-url", "google-account-name", "email,google-account-label", "email,google-account-label", "email,google-account-escaped-label", "email,google-account-escaped-name", "google-api-key")
_Q = lambda v: v.replace("'", "''")


def _sql_pick(values) -> str:
    return "CASE row_id % 12 " + " ".join(f"WHEN {i} THEN '{_Q(v)}'" for i, v in enumerate(values)) + " END"


def _dirty(spark: SparkSession, d: str) -> DataFrame:
    """Every row's cuisine beside one of twelve secrets."""
    secret = F.lit(None).cast("string")
    for i, (before, _) in enumerate(_SECRETS.values()):
        secret = F.when(F.col("row_id") % 12 == i, before).otherwise(secret)
    return load(spark, d, "guide_rows").select("row_id", F.concat(F.coalesce("cuisine", F.lit("")), F.lit("\n"), secret).alias("content"))


@query(f"SELECT row_id, coalesce(cuisine, '') || chr(10) || {_sql_pick(v for _, v in _SECRETS.values())} AS clean, '' AS still FROM guide_rows")
def redacted_secrets(spark: SparkSession, d: str) -> DataFrame:
    """Texts with a secret each, redacted; the SQL is told what each must become."""
    done = _dirty(spark, d).select("row_id", redaction.redacted("content").alias("clean"))
    return done.select("row_id", "clean", F.array_join(redaction.markers("clean"), ",").alias("still"))


@query(f"SELECT row_id, {_sql_pick(_MARKED)} AS shown FROM guide_rows")
def secret_markers(spark: SparkSession, d: str) -> DataFrame:
    """What each of the texts shows before it is redacted."""
    return _dirty(spark, d).select("row_id", F.array_join(redaction.markers("content"), ",").alias("shown"))


@query("""SELECT row_id, 'AIzaSyFAKE_KEY_FOR_TESTING_ONLY_00000000?key=AIzaSyFAKE_KEY_FOR_TESTING_ONLY_00000000&x=' || row_id || '<div class="gb_g"><redacted-account-name></div>' AS clean, '' AS still FROM guide_rows""")
def fixture_texts(spark: SparkSession, d: str) -> DataFrame:
    """Pages kept as fixtures: their keys become the test key."""
    raw = F.concat(F.lit("AIza<redacted>?key=k"), F.col("row_id").cast("string"), F.lit("&x="), F.col("row_id").cast("string"), F.lit('<div class="gb_g">Jo '), F.col("row_id").cast("string"), F.lit("</div>"))
    done = load(spark, d, "guide_rows").select("row_id", redaction.fixture_redacted(raw).alias("clean"))
    return done.select("row_id", "clean", F.array_join(redaction.fixture_markers("clean"), ",").alias("still"))


@query(f"SELECT '/p/' || row_id AS path, {_sql_pick(_MARKED)} AS found FROM guide_rows")
def scanned_files(spark: SparkSession, d: str) -> DataFrame:
    """Findings per file, a content given twice counted once."""
    rows = _dirty(spark, d).select(F.concat(F.lit("/p/"), F.col("row_id").cast("string")).alias("path"), "content")
    return redaction.scanned(rows.unionByName(rows), "path", "content").select("path", F.array_join("markers", ",").alias("found"))


@query(f"SELECT row_id, coalesce(cuisine, '') || chr(10) || {_sql_pick(v for _, v in _SECRETS.values())} AS content FROM guide_rows")
def written_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages redacted as they are written; one that still showed a secret would stop the write."""
    path = f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}"
    sinks.write_pages(_dirty(spark, d), path)
    return spark.read.parquet(path)


# ---- imports and orders


@query("""SELECT 'f' || CAST(page_no AS VARCHAR) AS path, count(*) FILTER (WHERE coalesce(name, '') <> '' AND coalesce(address, '') <> '') AS n_rows, count(*) FILTER (WHERE coalesce(name, '') = '') AS n_skipped, count(*) FILTER (WHERE coalesce(name, '') <> '' AND coalesce(address, '') = '') AS n_unsupported FROM guide_rows WHERE page_no IS NOT NULL GROUP BY page_no""")
def import_counts(spark: SparkSession, d: str) -> DataFrame:
    return adapters.import_counts(_imports(spark, d)).select("path", "n_rows", "n_skipped", "n_unsupported")


def _imports(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(tx.text("name") == "", "skipped").when(tx.text("address") == "", "unsupported").otherwise("ok")
    return load(spark, d, "guide_rows").where("page_no is not null").select(F.concat(F.lit("f"), F.col("page_no").cast("string")).alias("path"), "row_id", "name", status.alias("status"))


@query("""SELECT 'f' || CAST(page_no AS VARCHAR) AS path, row_id, 'imported' AS bucket, CAST(1 AS INT) AS page_no, CAST(row_number() OVER (PARTITION BY page_no ORDER BY row_id) - 1 AS INT) AS card_ord, count(*) OVER (PARTITION BY page_no) AS total_rows FROM guide_rows WHERE page_no IS NOT NULL AND coalesce(name, '') <> '' AND coalesce(address, '') <> ''""")
def imported_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of map files as one page each, all for the bucket of imports."""
    page = adapters.imported_page(_imports(spark, d), [F.col("row_id")])
    return adapters.route_imported(page, (adapters.IMPORTED,)).select("path", "row_id", "bucket", "page_no", "card_ord", "total_rows")


@query("""SELECT failure_id, CAST(n AS INT) AS line_no FROM (SELECT failure_id, row_number() OVER (ORDER BY failure_id) AS n FROM (SELECT DISTINCT failure_id, restaurant_name FROM target_failures WHERE trim(coalesce(restaurant_name, '')) <> ''))""")
def probe_rows(spark: SparkSession, d: str) -> DataFrame:
    """Failures written as one file of JSON lines and read again with their line numbers."""
    path = f"{shared_dir(spark)}/probe-{uuid.uuid4().hex}"
    rows = load(spark, d, "target_failures").where(F.trim(tx.text("restaurant_name")) != "").select("failure_id", "restaurant_name").distinct()
    one = rows.select(F.to_json(F.struct(F.col("restaurant_name").alias("Name"), F.col("failure_id").cast("string").alias("Address"))).alias("value"), "failure_id").coalesce(1).sortWithinPartitions("failure_id")
    one.select("value").write.text(path)
    return files.read_rows(spark, path).select(F.col("Address").cast("long").alias("failure_id"), "line_no")


@query("""SELECT house_id, name, is_best FROM (SELECT house_id, coalesce(house_name, '') AS name, row_number() OVER (PARTITION BY cuisine ORDER BY length(coalesce(house_name, '')) DESC, since_year DESC NULLS LAST, house_id) = 1 AS is_best FROM house_directory)""")
def best_configurations(spark: SparkSession, d: str) -> DataFrame:
    """The greatest row of each group by several keys in turn, the first of equal ones."""
    h = load(spark, d, "house_directory").select("house_id", "cuisine", tx.text("house_name").alias("name"), F.coalesce("since_year", F.lit(-(1 << 60))).alias("year"))
    best = evaluation.best_by(h, ["cuisine"], [F.length("name"), F.col("year")], F.col("house_id")).select("house_id", F.lit(True).alias("b"))
    return h.join(best, "house_id", "left").select("house_id", "name", F.coalesce("b", F.lit(False)).alias("is_best"))


@query("SELECT case_id, case_group IN ('same_address', 'thin_address') AS is_primary FROM matcher_cases")
def primary_cases(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.primary(load(spark, d, "matcher_cases"), "case_group", ("same_address", "thin_address")).select("case_id", "is_primary")


@query("""SELECT CAST(page_seq AS INT) AS page_seq, 'u' || page_seq AS url, CASE WHEN page_seq = least(n, 30) - 1 THEN CASE WHEN n > 30 THEN 'limit' ELSE 'end' END END AS stop FROM (SELECT row_number() OVER (ORDER BY supp) - 1 AS page_seq, count(*) OVER () AS n FROM (SELECT s_suppkey AS supp FROM supplier)) WHERE page_seq < 30""")
def crawl_order(spark: SparkSession, d: str) -> DataFrame:
    """A chain of pages followed from its start to the limit of pages, and why it stops."""
    from pyspark.sql import Window

    n = load(spark, d, "supplier").select(F.row_number().over(Window.orderBy("s_suppkey")).alias("i")).select((F.col("i") - 1).alias("i"))
    last = n.agg(F.max("i").alias("m"))
    pages = n.join(F.broadcast(last), F.col("i") <= F.col("m")).select(F.concat(F.lit("u"), "i").alias("url"), F.when(F.col("i") < F.col("m"), F.concat(F.lit("u"), F.col("i") + 1)).alias("next_url"))
    return adapters.crawled(pages, "u0", 30).select("page_seq", "url", "stop")

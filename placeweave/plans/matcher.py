"""Queries over the matcher's parts on the labelled pairs, each with the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.functions import text as tx
from placeweave.operators import evaluation, evidence, predicates
from placeweave.plans.queries import _COMMERCE, _FOOD, _OTHER, _collapse, _terms, query
from placeweave.session import cut, load

# Fixed values of the SQL twins.
_DESCRIPTORS = "['bar', 'bistro', 'cafe', 'co', 'company', 'dining', 'gastronomy', 'grill', 'kai', 'kitchen', 'restaurant', 'sia']"
_GENERIC = "['小料理', '料理', '餐廳', '牛排館', '牛排', '小吃']"
_DISHES = "['麵', '面', '麵店', '米粉', '米糕', '肉圓', '水餃', '蒸餃', '湯包', '豆腐', '甜不辣', '豬血糕', '蔥油餅', '飯', '粥', '菜飯', '肉羹', '香腸', '咖啡', '披薩', 'pizza', 'noodle', 'dumpling', 'rice', 'congee']"
_PLACES = "['city', 'county', 'district', 'township', 'village', 'taiwan', 'japan', '號']"
_CJK = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}"
_LOWER = lambda x: f"lower({_collapse(x)})"
_WORDS = lambda x: rf"list_distinct(regexp_extract_all({x}, '([\p{{L}}\p{{Nl}}\p{{No}}]+|\p{{Nd}}+)', 1))"
_COMPACT = lambda x: f"regexp_replace({x}, '[^a-z0-9{_CJK}]', '', 'g')"
_GRAMS = lambda x, n: f"CASE WHEN length({x}) = 0 THEN [] WHEN length({x}) <= {n} THEN [{x}] ELSE list_distinct(list_transform(range(1, length({x}) - {n} + 2), lambda i: substr({x}, i, {n}))) END"
_SIDE = lambda p, x: f"""{x} AS {p}, {_WORDS(x)} AS {p}_t, list_distinct(regexp_extract_all({x}, '[a-z0-9]+')) AS {p}_l, {_COMPACT(x)} AS {p}_c, regexp_replace({x}, '[^{_CJK}]', '', 'g') AS {p}_h,
  list_filter(regexp_extract_all(trim(regexp_replace({x}, '[（(][^）)]{{1,24}}[）)]', ' ', 'g')), '[{_CJK}]+'), lambda t: length(t) > 2 AND NOT list_contains({_GENERIC}, t)) AS {p}_k, list_filter({_DISHES}, lambda t: contains({x}, t)) AS {p}_f"""  # noqa: E731
_PARTS = f"(SELECT case_id, {_SIDE('a', _LOWER('row_rec.name'))}, {_SIDE('b', _LOWER('cand_rec.name'))} FROM matcher_cases)"
_OVER = f"(len(a_l) = 1 AND list_has_all(b_l, a_l) AND len(list_filter(b_l, lambda t: NOT list_contains({_DESCRIPTORS}, t))) > 2)"
_INSIDE = "(CASE WHEN length(a_c) <= length(b_c) THEN length(a_c) > 3 AND contains(b_c, a_c) ELSE length(b_c) > 3 AND contains(a_c, b_c) END)"
_WORD = "(CASE WHEN length(a) <= length(b) THEN length(a) > 3 AND len(list_filter(b_t, lambda t: contains(t, a) AND t <> a)) > 0 ELSE length(b) > 3 AND len(list_filter(a_t, lambda t: contains(t, b) AND t <> b)) > 0 END)"
_RAW_RUNG = f"""CASE WHEN a = '' OR b = '' THEN 0.0 WHEN a = b THEN 100.0 WHEN len(a_t) > 1 AND list_has_all(b_t, a_t) THEN 96.0 WHEN len(b_t) > 1 AND list_has_all(a_t, b_t) THEN 92.0
  WHEN len(a_t) = 1 AND list_has_all(b_t, a_t) AND (regexp_matches(a_t[1], '[\\x{{3040}}-\\x{{30ff}}{_CJK}]') OR len(list_filter(b_t, lambda t: NOT list_contains({_DESCRIPTORS}, t))) <= 2) THEN 88.0
  WHEN len(list_filter(a_k, lambda t: list_contains(b_k, t) OR contains(b, t))) > 0 THEN 84.0 WHEN {_INSIDE} THEN 82.0 WHEN {_WORD} THEN 78.0 ELSE 0.0 END"""
_RUNG = f"(CASE WHEN {_OVER} AND r IN (96.0, 82.0, 78.0) THEN 55.0 ELSE r END)"
_DICE = lambda a, b: f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE 200.0 * len(list_intersect({a}, {b})) / (len({a}) + len({b})) END)"
_HELD = lambda a, b: f"(CASE WHEN least(len({a}), len({b})) = 0 THEN 0.0 ELSE 100.0 * len(list_intersect({a}, {b})) / least(len({a}), len({b})) END)"
_PREFIX = "(length(a_h) > 3 AND length(b_h) > 3 AND left(a_h, 1) <> left(b_h, 1) AND NOT contains(b_h, left(a_h, 2)) AND NOT contains(a_h, left(b_h, 2)))"
_CLASH = "(len(a_f) > 0 AND len(b_f) > 0 AND len(list_intersect(a_f, b_f)) = 0)"


def _named(spark: SparkSession, d: str) -> DataFrame:
    lower = lambda c: F.lower(tx.collapse(c))
    return load(spark, d, "matcher_cases").select("*", evidence.name_parts(lower("row_rec.name")).alias("a"), evidence.name_parts(lower("cand_rec.name")).alias("b"))


@query(f"SELECT case_id, CAST({_RUNG} AS DOUBLE) AS rung, {_OVER} AS over_matched FROM (SELECT *, {_RAW_RUNG} AS r FROM {_PARTS})")
def name_rungs(spark: SparkSession, d: str) -> DataFrame:
    """How exactly the names of each pair agree."""
    return _named(spark, d).select("case_id", evidence.ladder(F.col("a"), F.col("b")).alias("rung"), evidence.over_matched(F.col("a"), F.col("b")).alias("over_matched"))


@query(f"""SELECT case_id, round(CASE WHEN {_OVER} THEN least(s, 55.0) ELSE s END, 6) AS score FROM (SELECT *, CASE WHEN g >= 65.0 AND length(a_c) > 2 AND length(b_c) > 2 AND left(a_c, 3) = left(b_c, 3) THEN greatest(g, 72.0) ELSE g END AS s FROM (
  SELECT *, greatest({_DICE("a2", "b2")}, {_DICE("a3", "b3")}, {_HELD("a2", "b2")}, {_HELD("a3", "b3")}) AS g FROM (SELECT *, {_GRAMS("a_c", 2)} AS a2, {_GRAMS("b_c", 2)} AS b2, {_GRAMS("a_c", 3)} AS a3, {_GRAMS("b_c", 3)} AS b3 FROM {_PARTS})))""")
def name_grams(spark: SparkSession, d: str) -> DataFrame:
    """The overlap of the names' n-grams."""
    return _named(spark, d).select("case_id", F.round(evidence.gram_score(F.col("a"), F.col("b")), 6).alias("score"))


@query(f"SELECT case_id, {_CLASH} AS foods_clash, {_PREFIX} AS prefix_conflict, array_to_string(list_sort(a_k), ' ') AS core, array_to_string(list_sort(a_f), ' ') AS foods FROM {_PARTS}")
def name_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Names that say other dishes or begin with other proper words."""
    a, b = F.col("a"), F.col("b")
    return _named(spark, d).select("case_id", evidence.foods_clash(a, b).alias("foods_clash"), evidence.prefix_conflict(a, b).alias("prefix_conflict"), F.array_join(F.array_sort("a.core"), " ").alias("core"), F.array_join(F.array_sort("a.foods"), " ").alias("foods"))


_HAS = lambda x: f"regexp_matches({x}, '[\\x{{3040}}-\\x{{30ff}}{_CJK}]')"
_SHORTER = lambda a, b, n: f"(least(length({a}), length({b})) >= {n} AND CASE WHEN length({a}) <= length({b}) THEN contains({b}, {a}) ELSE contains({a}, {b}) END)"
_BARE = lambda x: f"list_distinct(regexp_extract_all(regexp_replace({x}, '[（(][^）)]{{1,24}}[）)]', ' ', 'g'), '[a-z0-9]+'))"


@query(f"""SELECT case_id, {_RUNG} >= 84 OR r = 78 AND {_RUNG} = 78 OR ({_HAS("a")} AND {_HAS("b")} AND ({_SHORTER("a", "b", 2)} OR {_SHORTER("a_c", "b_c", 4)})) OR {_SHORTER("a_h", "b_h", 4)}
  OR (len(list_intersect(ga, gb)) > 1 AND len(list_intersect(ga, gb)) >= 0.7 * least(len(ga), len(gb))) OR (len(tell) > 1 AND len(list_filter(tell, lambda t: regexp_full_match(t, '[a-z]{{4,}}'))) > 0 AND list_has_all(list_filter({_BARE("b")}, lambda t: NOT list_contains({_DESCRIPTORS}, t)), tell)) AS sure
  FROM (SELECT *, {_RAW_RUNG} AS r, CASE WHEN length(a_h) > 3 THEN {_GRAMS("a_h", 2)} ELSE [] END AS ga, CASE WHEN length(b_h) > 3 THEN {_GRAMS("b_h", 2)} ELSE [] END AS gb, list_filter({_BARE("a")}, lambda t: regexp_full_match(t, '[0-9]+') OR length(t) > 3) AS tell FROM {_PARTS})""")
def confident_names(spark: SparkSession, d: str) -> DataFrame:
    """Pairs whose names are surely one."""
    return _named(spark, d).select("case_id", evidence.confident_name(F.col("a"), F.col("b")).alias("sure"))


# ---- addresses and trades

_HOUSES = lambda x: rf"""list_distinct(list_concat(list_transform(regexp_extract_all(coalesce({x}, ''), '(\p{{Nd}}+(?:[-之]\p{{Nd}}+)?)[\s\p{{Z}}]*號', 1), lambda x: replace(x, '之', '-')), regexp_extract_all(lower(coalesce({x}, '')), '(?:^|[^\p{{L}}\p{{N}}_])no\.?[\s\p{{Z}}]*(\p{{Nd}}+(?:-\p{{Nd}}+)?)(?:[^\p{{L}}\p{{N}}_]|$)', 1)))"""
_ROOTS = lambda x: f"list_transform({x}, lambda h: TRY_CAST(split_part(h, '-', 1) AS INT))"
_DIGITS = lambda x: rf"list_distinct(list_filter(regexp_extract_all(regexp_replace(lower(coalesce({x}, '')), '[^\x00-\x7F]', ' ', 'g'), '[a-z0-9]+'), lambda t: regexp_full_match(t, '[0-9]+')))"
_VAGUE = rf"regexp_matches(coalesce(row_rec.address, ''), '夜市|市場|門口|入口|附近|對面|隔壁|旁邊|\d\s*號\s*[a-z0-9{_CJK}]{{0,16}}[前旁]')"
_TOKENS = lambda x: f"list_filter({_WORDS(x)}, lambda t: length(t) > 1 AND NOT list_contains({_PLACES}, t))"
_SHARED = lambda a, b: f"len(list_intersect({a}, {b}))"
_PLACED = f"""(SELECT *, CASE WHEN {_SHARED("h", "g")} > 0 THEN 100.0 WHEN (len(h) > 0 AND len(g) > 0 AND len(list_filter(hr, lambda n: n IS NULL)) = 0 AND {_SHARED("hr", "gr")} > 0) OR {_SHARED(_DIGITS("row_rec.address"), _DIGITS("cand_rec.address"))} > 1 THEN 70.0 ELSE 0.0 END AS house,
  len(h) > 0 AND len(g) > 0 AND {_SHARED("h", "g")} = 0 AND len(list_filter(list_filter(hr, lambda m: m IS NOT NULL), lambda m: len(list_filter(list_filter(gr, lambda n: n IS NOT NULL), lambda n: abs(m - n) <= 1)) > 0)) = 0 AND NOT {_VAGUE} AS conflict,
  CASE WHEN city0 = '' THEN 0.0 WHEN {_SHARED(_WORDS("city0"), _WORDS("theirs"))} > 0 THEN 100.0 WHEN {_COMPACT("city0")} <> '' AND (contains({_COMPACT("theirs")}, {_COMPACT("city0")}) OR (contains({_COMPACT("mine")}, {_COMPACT("city0")}) AND contains({_COMPACT("theirs")}, left({_COMPACT("mine")}, 2)))) THEN 90.0 ELSE 0.0 END AS city,
  CASE WHEN {_terms("trade", _FOOD)} THEN 100.0 WHEN cuisine0 <> '' AND {_SHARED(_WORDS("cuisine0"), _WORDS("trade"))} > 0 THEN 90.0 WHEN trade = '' THEN 45.0 ELSE 0.0 END AS category
  FROM (SELECT *, {_ROOTS("h")} AS hr, {_ROOTS("g")} AS gr FROM (SELECT *, {_HOUSES("row_rec.address")} AS h, {_HOUSES("cand_rec.address")} AS g, {_LOWER("row_rec.city")} AS city0, {_LOWER("row_rec.address")} AS mine, {_LOWER("cand_rec.address")} AS theirs, {_LOWER("row_rec.cuisine")} AS cuisine0, {_LOWER("cand_rec.category")} AS trade FROM matcher_cases)))"""
_ADDRESS = f"(SELECT *, least(100.0, CASE WHEN least(len(x), len(y)) = 0 THEN 0.0 ELSE least(55.0, 55.0 * {_SHARED('x', 'y')} / least(len(x), len(y))) END + CASE WHEN city >= 70 THEN 20.0 ELSE 0.0 END + CASE WHEN house >= 90 THEN 25.0 ELSE 0.0 END) AS address FROM (SELECT *, {_TOKENS('mine')} AS x, {_TOKENS('theirs')} AS y FROM {_PLACED}))"


def _placed(spark: SparkSession, d: str) -> DataFrame:
    lower = lambda c: F.lower(tx.collapse(c))
    c = _named(spark, d).select("*", lower("row_rec.city").alias("city0"), lower("row_rec.address").alias("mine"), lower("cand_rec.address").alias("theirs"), lower("row_rec.cuisine").alias("cuisine0"), lower("cand_rec.category").alias("trade"))
    ra, ca = tx.text("row_rec.address"), tx.text("cand_rec.address")
    c = c.withColumns({"house": evidence.house_score(ra, ca), "conflict": evidence.house_conflict(ra, ca), "city": evidence.city_score(F.col("city0"), F.col("mine"), F.col("theirs")), "category": evidence.category_score(F.col("trade"), F.col("cuisine0")), "x": evidence.address_tokens(F.col("mine")), "y": evidence.address_tokens(F.col("theirs"))})
    return c.withColumn("address", evidence.address_score(F.col("x"), F.col("y"), F.col("city"), F.col("house")))


@query(f"SELECT case_id, CAST(house AS DOUBLE) AS house, conflict, CAST(city AS DOUBLE) AS city, CAST(category AS DOUBLE) AS category, round(CAST(address AS DOUBLE), 6) AS address, array_to_string(list_sort(list_intersect(x, y)), ' ') AS shared FROM {_ADDRESS}")
def place_scores(spark: SparkSession, d: str) -> DataFrame:
    """How well addresses, cities, house numbers and trades of each pair agree, and the words both addresses have."""
    return _placed(spark, d).select("case_id", "house", "conflict", "city", "category", F.round("address", 6).alias("address"), F.array_join(F.array_sort(F.array_intersect("x", "y")), " ").alias("shared"))


_LEFT = _COMPACT(_LOWER("concat_ws(' ', row_rec.name, row_rec.address, row_rec.cuisine)"))
_RIGHT = _COMPACT(_LOWER("concat_ws(' ', cand_rec.name, cand_rec.category)"))
_ALL = lambda x: f"list_distinct(list_concat({_GRAMS(x, 2)}, {_GRAMS(x, 3)}, {_GRAMS(x, 4)}))"
_TIMES = lambda x: f"(CASE WHEN length({x}) <= 2 THEN 3 WHEN length({x}) = 3 THEN 2 ELSE 1 END)"
_NORM = lambda g, x: f"sqrt(CAST(len({g}) - CASE WHEN list_contains({g}, {x}) THEN 1 - {_TIMES(x)} * {_TIMES(x)} ELSE 0 END AS DOUBLE))"
_NGRAM = f"""(SELECT case_id, CASE WHEN l = '' OR r = '' THEN 0.0 ELSE 100.0 * list_sum(list_concat([0], list_transform(list_intersect(lg, rg), lambda t: (CASE WHEN t = l THEN {_TIMES("l")} ELSE 1 END) * (CASE WHEN t = r THEN {_TIMES("r")} ELSE 1 END)))) / ({_NORM("lg", "l")} * {_NORM("rg", "r")}) END AS ngram
  FROM (SELECT case_id, l, r, {_ALL("l")} AS lg, {_ALL("r")} AS rg FROM (SELECT case_id, {_LEFT} AS l, {_RIGHT} AS r FROM matcher_cases)))"""


def _ngram(c: DataFrame) -> DataFrame:
    side = lambda *names: tx.compact_mixed(F.lower(tx.collapse(F.concat_ws(" ", *names))))
    return c.withColumns({"l": side("row_rec.name", "row_rec.address", "row_rec.cuisine"), "r": side("cand_rec.name", "cand_rec.category")}).withColumn("ngram", evidence.gram_cosine(F.col("l"), F.col("r")))


@query(f"SELECT case_id, round(ngram, 6) AS ngram FROM {_NGRAM}")
def text_cosines(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of the two- to four-grams of both sides' joined texts."""
    return _ngram(load(spark, d, "matcher_cases")).select("case_id", F.round("ngram", 6).alias("ngram"))


@query(r"""WITH m AS (SELECT map_from_entries(list((char_text, reading))) AS m FROM (SELECT char_text, min(reading) AS reading FROM char_readings WHERE lang = 'zh' GROUP BY char_text)),
  s AS (SELECT row_id, unnest(regexp_extract_all(coalesce(address, ''), '([\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]{2,}(?:大道|路|街|巷|弄))', 1)) AS s FROM guide_rows),
  p AS (SELECT row_id, unnest([s, regexp_replace(s, '(大道|路|街|巷|弄)$', '')]) AS p FROM (SELECT row_id, regexp_replace(s, '^.*[縣市區鎮鄉村里]', '') AS s FROM s)),
  r AS (SELECT DISTINCT row_id, array_to_string(list_transform(string_split(p, ''), lambda ch: coalesce(m[ch], ch)), '') AS t FROM p, m)
  SELECT row_id, string_agg(t, ' ' ORDER BY t) AS readings FROM r WHERE length(t) > 1 GROUP BY row_id""")
def street_readings(spark: SparkSession, d: str) -> DataFrame:
    """Latin readings of the streets in ideographs of every address."""
    g = load(spark, d, "guide_rows").select("row_id", evidence.street_readings(tx.text("address"), _readings(spark, d)).alias("t"))
    return g.where(F.size("t") > 0).select("row_id", F.array_join(F.array_sort("t"), " ").alias("readings"))


def _readings(spark: SparkSession, d: str) -> F.Column:
    """The fixed table of Chinese readings as a map."""
    rows = load(spark, d, "char_readings").where("lang = 'zh'").groupBy("char_text").agg(F.min("reading").alias("r")).orderBy("char_text").collect()
    return F.create_map(*(F.lit(x) for row in rows for x in (row["char_text"], row["r"])))


# ---- decisions

_RISKY = f"""(SELECT c.case_id, c.case_group, c.expected, n.rung, p.*, g.ngram, list_filter([CASE WHEN regexp_matches(cname, '^\\s*[+-]?\\d{{1,2}}(\\.\\d+)?\\s*,\\s*[+-]?\\d{{1,3}}(\\.\\d+)?\\s*$') THEN 'coordinate_like_candidate_name' END,
  CASE WHEN regexp_matches({_LOWER("cname")}, '^(no\\.?\\s*\\d|\\d{{1,3}}$|\\d{{3,}}\\s*,|\\d+\\s*(f|floor|樓)$)') THEN 'address_like_candidate_name' END, CASE WHEN conflict THEN 'house_number_conflict' END, CASE WHEN named AND {_terms("trade", _OTHER)} THEN 'non_food_category' END,
  CASE WHEN named AND {_terms("trade", _COMMERCE)} AND rung < 50 THEN 'generic_commerce_category_without_name_evidence' END, CASE WHEN clash THEN 'food_descriptor_conflict' END, CASE WHEN rung >= 70 AND prefix THEN 'cjk_proper_prefix_conflict' END,
  CASE WHEN bare AND category < 90 THEN 'exact_name_with_weak_address' END, CASE WHEN bare AND ngram < 15 THEN 'exact_name_with_weak_context' END, CASE WHEN rung < 50 AND cuisine0 = '' AND NOT (address >= 45 AND city >= 70 AND house >= 90) THEN 'no_name_evidence_without_source_cuisine' END,
  CASE WHEN rung < 10 AND category >= 90 AND cuisine0 = '' AND ngram < 15 THEN 'address_only_with_named_category' END], lambda x: x IS NOT NULL) AS risks
  FROM (SELECT case_id, case_group, expected, coalesce(cand_rec.name, '') AS cname FROM matcher_cases) c JOIN (SELECT case_id, {_RUNG} AS rung, {_CLASH} AS clash, {_PREFIX} AS prefix FROM (SELECT *, {_RAW_RUNG} AS r FROM {_PARTS})) n USING (case_id) JOIN {_NGRAM} g USING (case_id)
  JOIN LATERAL (SELECT house, conflict, city, category, address, cuisine0, trade, trade <> '' AND NOT {_terms("trade", _FOOD)} AS named, n.rung >= 95 AND address < 30 AND house = 0 AS bare FROM {_ADDRESS} a WHERE a.case_id = c.case_id) p ON true)"""
_HASR = lambda label: f"list_contains(risks, '{label}')"
_FIXED = {"cjk_proper_prefix_conflict": 12, "exact_name_with_weak_address": 18, "exact_name_with_weak_context": 40, "no_name_evidence_without_source_cuisine": 30, "address_only_with_named_category": 35, "generic_commerce_category_without_name_evidence": 30}
_POINTS = f"""(CASE WHEN {_HASR("house_number_conflict")} THEN CASE WHEN rung >= 95 AND address < 45 THEN 85.0 WHEN address < 45 THEN 28.0 ELSE 4.0 END ELSE 0.0 END + CASE WHEN {_HASR("food_descriptor_conflict")} THEN CASE WHEN rung < 70 THEN 75.0 WHEN rung >= 95 AND address >= 30 THEN 8.0 ELSE 35.0 END ELSE 0.0 END
  + {" + ".join(f"CASE WHEN {_HASR(k)} THEN {v}.0 ELSE 0.0 END" for k, v in _FIXED.items())})"""
_STOP = f"(CASE WHEN {_HASR('coordinate_like_candidate_name')} OR {_HASR('address_like_candidate_name')} OR {_HASR('non_food_category')} THEN 100.0 ELSE 0.0 END)"
_POINTED = f"(SELECT *, {_POINTS} AS risk, {_STOP} AS stop FROM {_RISKY})"
_DECIDED = lambda s, m, t: f"(SELECT *, CASE WHEN score >= {t} THEN 'strong' WHEN score >= {m} THEN 'medium' ELSE 'weak' END AS strength FROM (SELECT *, greatest(0.0, least(100.0, round({s}, 6))) AS score FROM {_POINTED}))"
_WEIGHTED = _DECIDED("0.26 * rung + 0.18 * address + 0.14 * city + 0.08 * house + 0.08 * category + 0.16 * ngram - 0.5 * risk - stop", 35, 66)


def _decided(spark: SparkSession, d: str) -> DataFrame:
    """The labelled pairs with the evidence that needs no string ratios, its risks, and the weighted decision."""
    # Written once: a filter on the decision would otherwise copy all it rests on to the scan.
    c = cut(_ngram(_placed(spark, d)).withColumn("rung", evidence.ladder(F.col("a"), F.col("b"))))
    zero = F.lit(0.0)
    scores = {"name": F.col("rung"), "alias": zero, "address": F.col("address"), "city": F.col("city"), "house": F.col("house"), "category": F.col("category"), "located_in": zero, "subtitle": zero, "ngram": F.col("ngram"), "embedding": zero}
    own = F.struct(F.col("rung").alias("score"), evidence.foods_clash(F.col("a"), F.col("b")).alias("clash"), evidence.prefix_conflict(F.col("a"), F.col("b")).alias("prefix"))
    risks = evidence.risk_labels(scores, tx.text("cand_rec.name"), F.col("trade"), F.col("cuisine0"), own, F.col("conflict"), F.lit(False), F.lit(False))
    c = cut(c.withColumn("evidence", F.struct(*(v.alias(k) for k, v in scores.items()), risks.alias("risks"))))
    c = c.withColumns({"risk": evidence.risk_points(), "stop": evidence.disqualifier_points()})
    weighted = evidence.weighted_decision({k: F.col(f"evidence.{k}") for k in scores}, F.col("risk"), F.col("stop"))
    return c.withColumn("decision", evidence.decision(F.round(weighted["score"], 6), 35.0, 66.0))


@query(f"SELECT case_id, array_to_string(risks, ',') AS risks, risk, stop FROM {_POINTED}")
def case_risks(spark: SparkSession, d: str) -> DataFrame:
    """What speaks against each pair, and how much."""
    return _decided(spark, d).select("case_id", F.array_join("evidence.risks", ",").alias("risks"), "risk", "stop")


@query(f"SELECT case_id, round(score, 4) AS score, strength FROM {_WEIGHTED}")
def weighted_decisions(spark: SparkSession, d: str) -> DataFrame:
    """The weighted strategy over the pairs' evidence."""
    return _decided(spark, d).select("case_id", F.round("decision.score", 4).alias("score"), "decision.strength")


@query(f"SELECT case_id, round(score, 4) AS score, strength FROM {_DECIDED('100.0 / (1.0 + exp(-(-4.0 + 4.0 * rung / 100 + 2.5 * address / 100 + 1.5 * city / 100 + 2.0 * ngram / 100 - 0.5 * category / 100)))', 45, 60)}")
def logistic_decisions(spark: SparkSession, d: str) -> DataFrame:
    """The logistic strategy over the pairs' evidence, with coefficients given."""
    x = evidence.logistic_decision([F.col(n) for n in ("rung", "address", "city", "ngram", "category")], [4.0, 2.5, 1.5, 2.0, -0.5], -4.0, 45.0, 60.0)
    return _decided(spark, d).select("case_id", evidence.decision(F.round(x["score"], 6), 45.0, 60.0).alias("x")).select("case_id", F.round("x.score", 4).alias("score"), "x.strength")


@query(f"SELECT case_id, round(score, 4) AS score, strength FROM {_DECIDED('0.45 * ngram + 0.55 * (rung + address + city) / 3 - 0.5 * risk - stop', 30, 55)}")
def blended_decisions(spark: SparkSession, d: str) -> DataFrame:
    """The n-gram strategy, blended with other evidence."""
    x = evidence.blended_decision(F.col("ngram"), 0.45, (F.col("rung") + F.col("address") + F.col("city")) / 3, F.col("risk"), F.col("stop"), 30.0, 55.0)
    return _decided(spark, d).select("case_id", evidence.decision(F.round(x["score"], 6), 30.0, 55.0).alias("x")).select("case_id", F.round("x.score", 4).alias("score"), "x.strength")


@query(f"SELECT case_id, case_group, expected, strength AS actual, CASE WHEN expected = 'match' THEN 'false_reject' ELSE 'false_accept' END AS kind, round(score, 4) AS score, array_to_string(risks, ',') AS risks FROM {_WEIGHTED} WHERE (expected = 'match') = (strength = 'weak')")
def wrong_decisions(spark: SparkSession, d: str) -> DataFrame:
    """The pairs decided wrongly."""
    out = evaluation.failures(_decided(spark, d), "case_id", "case_group", "expected", "decision", F.col("evidence.risks"))
    return out.withColumn("risks", F.array_join("risks", ","))


@query(f"""SELECT 'weighted' AS config, count(*) AS n_cases, count(*) FILTER (WHERE k AND strength <> 'weak' AND expected <> 'match') AS known_reject_accepts, round(4.0 * CASE WHEN count(*) FILTER (WHERE k AND strength <> 'weak' AND expected <> 'match') = 0 THEN 1 ELSE 0 END + 2.0 * coalesce(count(*) FILTER (WHERE case_group = 'same_address' AND strength <> 'weak') / nullif(count(*) FILTER (WHERE case_group = 'same_address'), 0), 1.0)
  + 2.0 * coalesce(count(*) FILTER (WHERE case_group = 'thin_address' AND strength <> 'weak') / nullif(count(*) FILTER (WHERE case_group = 'thin_address'), 0), 1.0) + 1.5 * 1.0 + 0.5 - 5.0 * count(*) FILTER (WHERE k AND strength <> 'weak' AND expected <> 'match') / greatest(1, count(*) FILTER (WHERE k)), 6) AS weighted_score FROM (SELECT *, case_group = 'other_address' AS k FROM {_WEIGHTED})""")
def strategy_scores(spark: SparkSession, d: str) -> DataFrame:
    """The score by which strategies are compared; a group without cases counts as found whole."""
    scored = _decided(spark, d).withColumn("config", F.lit("weighted"))
    out = evaluation.strategy_scores(scored, ["config"], "case_group", "expected", F.col("decision.accept"), "other_address", ("same_address", "thin_address", "no_such_group"))
    return out.select("config", "n_cases", "known_reject_accepts", F.round("weighted_score", 6).alias("weighted_score"))


# ---- with string ratios, which SQL can't say


@query()
def case_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Evidence and decision of each labelled pair, streets in ideographs met by their readings."""
    scored = evidence.assessed(load(spark, d, "matcher_cases"), readings=_readings(spark, d))
    return scored.select("case_id", "expected", *(F.round(f"evidence.{n}", 4).alias(n) for n in evidence._FIELDS), F.array_join("evidence.risks", ",").alias("risks"), F.round("assessment.score", 4).alias("score"), "assessment.strength", "assessment.accept")


@query()
def case_confusion(spark: SparkSession, d: str) -> DataFrame:
    """How the production strategy does on the labelled pairs."""
    scored = evidence.assessed(load(spark, d, "matcher_cases"))
    return evaluation.confusion(scored.withColumn("config", F.lit("weighted")), ["config"], F.col("assessment.accept"), F.col("expected"))


@query()
def settled_cases(spark: SparkSession, d: str) -> DataFrame:
    """The pairs after the policy for searches: found by name, by the address alone, or by coordinates."""
    cases = load(spark, d, "matcher_cases")
    k = F.col("case_id") % 3
    asked = F.when(k == 0, tx.text("row_rec.name")).when(k == 1, tx.text("row_rec.address")).otherwise("25.1,121.5")
    return evidence.settled(cases, asked, F.lit("My list")).select("case_id", "expected", "assessment.strength", "outcome")


@query()
def fitted_decisions(spark: SparkSession, d: str) -> DataFrame:
    """The logistic strategy fitted to the labelled pairs of even number and applied to those of odd number."""
    names = ("rung", "address", "city", "house", "category", "ngram")
    cases = _decided(spark, d).where("expected <> 'manual'").select("case_id", "expected", *names)
    known = cases.where("case_id % 2 = 0").orderBy("case_id").collect()  # a corpus of a few hundred pairs
    w, b = evaluation.fit_logistic([[r[n] / 100.0 for n in names] for r in known], [float(r["expected"] == "match") for r in known])
    x = evidence.logistic_decision([F.col(n) for n in names], w, b, 45.0, 60.0)
    return cases.where("case_id % 2 = 1").select("case_id", "expected", x.alias("x")).select("case_id", "expected", F.round("x.score", 4).alias("score"), "x.accept")


@query(f"SELECT cand_id, {_terms('category', _FOOD)} AS food, {_collapse('subtitle')} AS subtitle FROM place_candidates WHERE {_terms('category', _OTHER)}")
def other_trades(spark: SparkSession, d: str) -> DataFrame:
    """Candidates that are no places to eat by their category."""
    c = load(spark, d, "place_candidates").where(predicates.other_category("category"))
    return c.select("cand_id", predicates.any_of("category", predicates.FOOD_CATEGORIES).alias("food"), tx.collapse("subtitle").alias("subtitle"))


# ---- names as texts


_BRACKETLESS = rf"trim(regexp_replace(coalesce(name, ''), '[\s\p{{Z}}]*[（(][^）)]{{1,24}}[）)][\s\p{{Z}}]*', ' ', 'g'))"


@query(f"SELECT cand_id, {_BRACKETLESS} AS plain FROM place_candidates")
def bracketless_names(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "place_candidates").select("cand_id", tx.without_brackets("name").alias("plain"))


@query("SELECT lang, char_text, translate(char_text, 'の囍脚焿敘臺得腿', '的禧腳羹序台德腳') AS plain FROM char_readings")
def variant_characters(spark: SparkSession, d: str) -> DataFrame:
    """Characters of names as they are compared."""
    return load(spark, d, "char_readings").select("lang", "char_text", tx.normalized_name("char_text").alias("plain"))


_ALIASES = rf"""(SELECT row_id, v, p, CASE WHEN len(parts) >= 2 THEN array_to_string(parts, ' ') END AS joined, CASE WHEN len(parts) >= 2 AND length(parts[-1]) >= 4 THEN parts[-1] END AS last FROM (SELECT row_id, v, p, list_filter(list_transform(regexp_split_to_array(p, '[\s\p{{Z}}]*[｜|／/×][\s\p{{Z}}]*|[\s\p{{Z}}]+[xX][\s\p{{Z}}]+'), lambda x: trim(x)), lambda x: x <> '') AS parts
  FROM (SELECT row_id, {_collapse("name")} AS v, {_collapse(_BRACKETLESS)} AS p FROM guide_rows)))"""


@query(f"""SELECT row_id, concat_ws(chr(10), CASE WHEN length(p) >= 3 AND p <> v THEN p END, CASE WHEN length(joined) >= 3 AND joined <> v AND NOT (length(p) >= 3 AND p <> v AND lower(joined) = lower(p)) THEN joined END,
  CASE WHEN length(last) >= 3 AND last <> v AND NOT (length(p) >= 3 AND p <> v AND lower(last) = lower(p)) AND NOT (joined <> v AND lower(last) = lower(joined)) THEN last END) AS aliases FROM {_ALIASES}""")
def derived_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Names a row can go by beside its own: without brackets, its parts joined, the last of them."""
    return load(spark, d, "guide_rows").select("row_id", F.array_join(tx.derived_aliases("name"), "\n").alias("aliases"))

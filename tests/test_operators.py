import pytest
from pyspark.sql import functions as F

from placeweave.functions import fuzzy, geo
from placeweave.functions import text as tx
from placeweave.operators import evaluation, evidence, extraction, ordering, predicates, redaction, rendering, routing, summary


def one(spark, expr, **cols):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in cols.items()))
    return df.select(expr.alias("x")).first()["x"]


def test_routing(spark):
    rows = spark.createDataFrame([(1, "  1   STAR  "), (2, "selected"), (3, "😋"), (4, "2 Stars")], "id int, rating string")
    assert {r["id"]: r["bucket"] for r in routing.route_rows(rows, "rating").collect()} == {1: "stars", 2: "selected", 3: "bib-gourmand", 4: "stars"}
    assert {r["id"] for r in routing.route_rows(rows, "rating", ("one-star",)).collect()} == {1}
    bad = spark.createDataFrame([(5, "Six Stars"), (6, None)], "id int, rating string")
    with pytest.raises(Exception, match="unrecognized rating"):
        routing.route_rows(bad, "rating").collect()
    assert routing.route_rows(bad, "rating", strict=False).count() == 0
    assert routing.parse_buckets(" selected, STARS ") == ("stars", "selected") and routing.parse_buckets("") == routing.DEFAULT_BUCKETS
    for wrong in ("stars,one-star", "gold"):
        with pytest.raises(ValueError):
            routing.parse_buckets(wrong)
    explicit = spark.createDataFrame([(1, "", "selected"), (2, "selected", None), (3, "two-star", None)], "id int, level string, rating string")
    got = {(r["id"], r["bucket"], r["bucket_ord"]) for r in routing.route_explicit(explicit, "level", "rating", [F.col("id")]).collect()}
    assert got == {(2, "selected", 1), (1, "selected", 2), (3, "stars", 1)}


def test_identity(spark):
    key = lambda *v: one(spark, routing.identity_key(*map(F.lit, v)))
    assert key("a", " The  Inn ", None) == key("A", "the inn", "") != key("a", "the inn", "x")
    assert one(spark, routing.number_part(F.lit(0.0))) == "" and one(spark, routing.number_part(F.lit(25.033))) == "25.033"


def test_targets_and_languages(spark):
    cat = spark.createDataFrame(
        [("en", "city", "north-port", "North Port", None, "unsupported", None), ("de", "city", "north-port", "Nordhafen", None, "supported", "u"), ("en", "country", "north-port", "North", None, "supported", "c"), ("en", "country", "eland", "Eland", None, "supported", "e")],
        "lang string, kind string, slug string, label string, label_local string, status string, url string",
    )
    asked = spark.createDataFrame([("North Port",), ("eland",), ("none",), (None,)], "city string")
    got = {r["city"]: (r["kind"], r["status"]) for r in routing.resolve_targets(asked, "city", cat, ["en", "de"]).collect()}
    assert got == {"North Port": ("city", "unsupported"), "eland": ("country", "supported"), "none": (None, None), None: (None, None)}
    langs = routing.resolve_languages(spark.createDataFrame([("ZH_TW",), ("fr",)], "l string"), "l", {"zh-tw": "zh_TW"})
    assert [r["language"] for r in langs.collect()] == ["zh_TW", "fr"]
    assert one(spark, routing.localized_url(F.lit("/en/jp/tokyo/x"), "tw", "zh", ("jp",))) == "/tw/zh/tokyo/x"


def test_ordering(spark):
    rows = spark.createDataFrame([(1, "a", False), (2, "a", True), (3, "a", True), (4, None, True), (5, None, False)], "id int, k string, ok boolean")
    got = {r["id"]: r["status"] for r in ordering.first_wins(rows, ["k"], [F.col("id")], F.col("ok")).collect()}
    assert got == {1: "failed", 2: "added", 3: "skipped", 4: "added", 5: "skipped"}
    assert ordering.first_wins(rows.limit(0), ["k"], [F.col("id")], F.col("ok")).count() == 0
    assert [r["in_budget"] for r in ordering.budgeted(rows, ["k"], [F.col("id")], 1).orderBy("id").collect()] == [True, False, False, True, False]
    assert ordering.budgeted(rows, ["k"], [F.col("id")], 0).where("in_budget").count() == 5
    assert {r["id"] for r in ordering.top_k(rows, ["k"], [F.col("id")], 2).collect()} == {1, 2, 4, 5}
    done = spark.createDataFrame([("a",), (None,)], "k string")
    assert {r["id"] for r in ordering.not_done(rows, done, "k").collect()} == {4, 5}
    assert {r["id"] for r in ordering.already_done(rows, done, "k").collect()} == {1, 2, 3}
    hit = {r["k"]: (r["id"], r["n_before"]) for r in ordering.first_acceptable(rows, ["k"], [F.col("id")], F.col("ok")).collect()}
    assert hit == {"a": (2, 1), None: (4, 0)}
    assert {r["id"] for r in ordering.page_limited(rows, "id", 2).collect()} == {1, 2}


def test_summary(spark):
    rows = spark.createDataFrame([("selected", "x", 3), ("selected", "y", 1), ("selected", "y", 2)], "bucket string, reason string, o int")
    got = {r["bucket"]: r["n"] for r in summary.bucket_counts(rows, ("stars", "selected"), {"n": F.lit(True)}).collect()}
    assert got == {"stars": 0, "selected": 3}
    assert [(r["reason"], r["n"]) for r in summary.reason_histogram(rows, "reason", F.col("o")).collect()] == [("y", 2), ("x", 1)]
    best = summary.best_rejected(rows, ["bucket"], F.lit(1), F.col("reason"), F.col("o")).first()
    assert best["o"] == 1
    assert [r["m"] for r in summary.running_maximum(rows, ["bucket"], [F.desc("o")], F.col("o"), "m").orderBy("o").collect()] == [3, 3, 3]


def test_text(spark):
    assert tx.normalize(" Straße　CAFÉ Ταβέρνα ") == "strasse cafe taverna" and tx.normalize(None) == ""
    df = spark.createDataFrame([(" Ｃafé  X ",), (None,), ("ABC  d",)], "v string")
    assert [r[0] for r in df.select(tx.folded_text("v")).collect()] == ["cafe x", "", "abc d"]
    assert one(spark, tx.words(F.lit("ab12 cd ab")), v="") == ["ab", "12", "cd"]
    assert one(spark, tx.house_numbers(F.lit("復興路12之3號, No. 5-6 and no. 57號"))) == ["12-3", "57", "5-6"]
    assert one(spark, tx.house_roots(F.array(F.lit("12-3"), F.lit("x")))) == [12, None]
    assert one(spark, tx.postal_codes(F.lit("〒201-1007 2011007 123"))) == ["2011007"]
    assert one(spark, tx.ngrams(F.lit("abcab"), 2)) == ["ab", "bc", "ca"] and one(spark, tx.ngrams(F.lit("a"), 2)) == ["a"] and one(spark, tx.ngrams(F.lit(""), 2)) == []
    assert one(spark, tx.slug(F.lit("  Hello, World! "), "x")) == "hello-world" and one(spark, tx.slug(F.lit("！"), "x")) == "x"
    assert one(spark, tx.derived_aliases(F.lit("Blue Door (Annex) / Old Gate"))) == ["Blue Door / Old Gate", "Blue Door Old Gate", "Old Gate"]
    assert tx.name_alternatives("Alpha（阿爾法餐廳）") == ["Alpha（阿爾法餐廳）", "Alpha", "阿爾法餐廳"] and tx.name_alternatives(None) == []
    assert one(spark, tx.strip_html(F.lit("<b>a</b>&amp;<i>b"))) == "a & b"
    assert one(spark, tx.without_brackets(F.lit("A (x) B"))) == "A B" and one(spark, tx.has_cjk(F.lit("かな"))) and one(spark, tx.compact_cjk(F.lit("a中b文"))) == "中文"


def test_geo(spark):
    q = lambda a, b: one(spark, geo.coordinate_query(F.lit(a), F.lit(b)))
    assert q(25.03, 121.5) == "25.03,121.5" and q(100.0, 0.0) == "" and q(10.0, 0.0) == "10,0"
    assert tuple(one(spark, geo.kml_point(F.lit("121.5,25.1,0 1,2")))) == (25.1, 121.5) and one(spark, geo.kml_point(F.lit("200,5"))) is None and one(spark, geo.kml_point(F.lit(None).cast("string"))) is None
    assert tuple(one(spark, geo.url_point(F.lit("https://m.example/?q=25.1,121.5&z=1")))) == (25.1, 121.5) and one(spark, geo.url_point(F.lit("https://m.example/?q=a,b"))) is None
    assert one(spark, geo.area_hint(F.lit("台北市大安區復興路12號"))) == "台北市大安區" and one(spark, geo.street_hint(F.lit("台北市大安區復興路12號"))) == "復興路12號"


def test_fuzzy():
    assert fuzzy.ratio("abcd", "abxd") == 75.0 and fuzzy.ratio("", "") == 100.0
    assert fuzzy.partial_ratio("inn", "the inn here") == 100.0 and fuzzy.token_set_ratio("blue door", "door blue cafe") == 100.0
    assert fuzzy.weighted_ratio("", "x") == 0.0 and fuzzy.weighted_ratio("blue door", "door blue") == 95.0

    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    import random

    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcé中") for _ in range(rng.randint(0, 14))) for _ in range(2))
        assert fuzzy._common(a, b) == lcs(a, b)


def _pairs(spark, row, cand):
    fields = lambda d, keys: tuple(d.get(k) for k in keys)
    a, b = ("name", "name_local", "city", "address", "cuisine"), ("name", "address", "category", "subtitle", "located_in")
    schema = f"row_rec struct<{','.join(k + ':string' for k in a)}>, cand_rec struct<{','.join(k + ':string' for k in b)}>, score double"
    return spark.createDataFrame([(fields(row, a), fields(cand, b), 1.0)], schema)


def _pair(spark, row, cand):
    return evidence.assessed(_pairs(spark, row, cand)).first()


def test_matching(spark):
    row = {"name": "阿爾法餐廳", "city": "台北市", "address": "台北市大安區復興路12號", "cuisine": "Taiwanese"}
    same = _pair(spark, row, {"name": "阿爾法餐廳", "address": "台北市大安區復興路12號", "category": "Restaurant"})
    assert same["assessment"]["strength"] == "strong" and same["evidence"]["house"] == 100.0 and not same["evidence"]["risks"]
    hotel = _pair(spark, row, {"name": "阿爾法酒店", "address": "台北市大安區復興路12號", "category": "Hotel"})
    assert not hotel["assessment"]["accept"] and "non_food_category" in hotel["evidence"]["risks"]
    blank = _pair(spark, {"name": None}, {"name": " "})
    assert blank["assessment"]["strength"] == "weak"
    parts = lambda v: evidence.name_parts(F.lit(v))
    rung = lambda a, b: one(spark, evidence.ladder(parts(a), parts(b)))
    assert [rung(*x) for x in (("a b", "a b"), ("a b", "c a b"), ("a b c", "b a"), ("lin", "lin grill"), ("", "x"))] == [100.0, 96.0, 92.0, 88.0, 0.0]
    assert rung("lin", "lin old stone house") == 0.0 and rung("zaap", "zaaptaipei") == 82.0 and rung("阿爾法餐廳", "新阿爾法餐廳") == 84.0
    assert one(spark, evidence.foods_clash(parts("林家麵店"), parts("林家水餃"))) and not one(spark, evidence.foods_clash(parts("a"), parts("林家水餃")))
    assert one(spark, evidence.prefix_conflict(parts("春水飯店"), parts("秋山飯店"))) and not one(spark, evidence.prefix_conflict(parts("春水飯店"), parts("春山飯店")))
    clash = _pair(spark, {"name": "林家麵店", "address": ""}, {"name": "林家水餃"})["evidence"]
    assert "food_descriptor_conflict" in clash["risks"] and clash["name"] <= 45
    house = lambda a, b: (one(spark, evidence.house_score(F.lit(a), F.lit(b))), one(spark, evidence.house_conflict(F.lit(a), F.lit(b))))
    assert house("復興路12號", "復興路30號") == (0.0, True) and house("12號旁", "30號") == (0.0, False) and house("12之3號", "No. 12-3") == (100.0, False) and house("12-1號", "12-2號") == (70.0, False)
    cosine = lambda a, b: one(spark, evidence.gram_cosine(F.lit(a), F.lit(b)))
    assert cosine("abcd", "abcd") == pytest.approx(100.0) and cosine("ab", "ab") == pytest.approx(100.0) and cosine("", "ab") == 0.0 and cosine("abx", "ab") == pytest.approx(100 * 3 / (3 * (1 + 1 + 4) ** 0.5), rel=1e-6)
    readings = F.create_map(*(F.lit(x) for x in ("松", "song", "雅", "ya")))
    assert one(spark, evidence.street_readings(F.lit("雁塘市龍燕區松雅路3號"), readings)) == ["songya路", "songya"]
    met = evidence.with_evidence(spark.createDataFrame([(("x", "", "", "松雅路3號", ""), ("x", "songya road", "", "", ""))], "row_rec struct<name:string,name_local:string,city:string,address:string,cuisine:string>, cand_rec struct<name:string,address:string,category:string,subtitle:string,located_in:string>"), readings=readings)
    assert met.first()["evidence"]["shared_places"] == ["songya"]
    assert one(spark, evidence.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(0.7071, abs=1e-4)


def test_policy(spark):
    row = {"name": "Alpha Inn", "city": "Port", "address": "12 Main Road, Port", "cuisine": "Tea"}
    settle = lambda cand, query, name="Alpha Inn", lst="My list": evidence.settled(_pairs(spark, row | {"name": name}, cand), F.lit(query), F.lit(lst)).first()["outcome"]
    same = {"name": "Alpha Inn", "address": "12 Main Road, Port", "category": "Restaurant"}
    assert settle(same, "Alpha Inn Port") == "strong" and settle(same | {"name": "My  LIST"}, "x") == "refused"
    other = {"name": "Zzz Qqq", "address": "", "category": ""}
    assert settle(other, "Alpha Inn") == "weak" and settle(other, "25.1, 121.5") == "medium" and settle(other | {"name": "25.1, 121.5"}, "25.1, 121.5") == "weak"
    # Another name at the row's very place is worth a look, unless only the address was searched for.
    place = {"name": "Zzz Qqq", "address": "12 Main Road, Port", "category": "Cafe"}
    assert settle(place, "Alpha Inn") != "weak" and settle(place, "12 Main Road, Port") == "weak"


def test_predicates(spark):
    p = lambda c: one(spark, c)
    assert p(predicates.coordinate_like(F.lit("25.1, 121.5"))) and p(predicates.coordinate_like(F.lit("25°01'01\"N 121°33'54\"E"))) and not p(predicates.coordinate_like(F.lit("Cafe 25")))
    assert p(predicates.address_like(F.lit("No. 12"))) and p(predicates.address_like(F.lit("3F"))) and not p(predicates.address_like(F.lit("Inn 5")))
    assert not p(predicates.food_category(F.lit("Add a label"))) and p(predicates.food_category(F.lit("Ramen restaurant"))) and p(predicates.other_category(F.lit("Hotel"))) and p(predicates.commerce_category(F.lit("Wine store")))
    m = {"jp": ("japan",), "fr": ("france",)}
    assert p(predicates.country_mismatch(F.lit("Paris, France"), "jp", m)) and not p(predicates.country_mismatch(F.lit("Paris, France"), "xx", m)) and not p(predicates.country_mismatch(F.lit(None).cast("string"), "jp", m))
    assert p(predicates.address_only_query(F.lit("Main 1"), F.lit("main  1"), [F.lit("Inn")])) and p(predicates.list_landing(F.lit("My List"), F.lit("my list")))


LISTING = """<html><head><title>Places | Guide</title><meta property="og:title" content="Port - Guide"></head><body><nav><ol><li>Home</li><li>Port</li></ol></nav><h1>Port: 1-2 of 1,204 Restaurants</h1>
<div class="card__menu"><span class="distinction-icon"><img src="a/1star.svg"><img src="b/1star.svg"></span><h3 class="card__menu-content--title"><a href="/en/r/alpha">Alpha</a></h3><div class="card__menu-footer--score">Port, Eland</div><div class="card__menu-footer--score">$$$ · French</div></div>
<div class="card__menu" data-map-pin-name="BIB_GOURMAND"><span class="distinction-icon"><img src="x.svg"></span><h3 class="card__menu-content--title">Beta</h3><a href="/en/r/beta">x</a></div>
<div class="card__menu"><h3 class="card__menu-content--title">Gamma</h3></div>
<ul><li class="active"><a href="/en/list">1</a></li><li><a href="/en/list/page/2">2</a></li><li><a href="/en/list/page/3">3</a></li><li><a href="#">4<br></a></li></ul></body></html>"""
DETAIL = """<meta name="description" content="Alpha, 2025 ABC Guide"><h1>Alpha / Alfa</h1><div class="data-sheet__block--text">1 Main St</div><div class="data-sheet__description">Nice <b>place</div>
<a data-event="CTA_tel" href="tel:+8130000">Call</a><a data-event="CTA_website" href="https://a.example">Web</a><iframe src="https://m.example/?q=1,2"></iframe><iframe src="https://m.example/?q=35.1,139.7"></iframe>"""


def test_extraction(spark):
    pages = spark.createDataFrame([("https://g.example/en/list", LISTING), ("u", None), ("v", "<<<")], "url string, html string")
    full = extraction.with_listing(pages).collect()
    listing = full[0]["listing"]
    assert [c["name"] for c in listing["cards"]] == ["Alpha", "Beta", "Gamma"] and listing["cards"][0]["url"] == "https://g.example/en/r/alpha" and full[1]["listing"]["cards"] == []
    first = extraction.with_listing(pages).where("html like '<html%'").select("url", "listing.*")
    cards = first.select(F.posexplode("cards").alias("i", "c")).select("i", extraction.rating(F.col("c.attrs"), F.col("c.icons")).alias("r"), extraction.price_and_cuisine("c.footer").alias("p")).orderBy("i").collect()
    assert [c["r"] for c in cards] == ["2 Stars", "Bib Gourmand", "Selected"] and tuple(cards[0]["p"]) == ("$$$", "French") and tuple(cards[1]["p"]) == ("", "")
    facts = first.select(extraction.total_pages(F.col("links")).alias("n"), extraction.total_items("heading").alias("items"), extraction.next_url(F.col("links"), F.col("url"), extraction.page_number("url")).alias("next"), "breadcrumb").first()
    assert (facts["n"], facts["items"], facts["next"], facts["breadcrumb"]) == (4, 1204, "https://g.example/en/list/page/2", "Port")
    det = extraction.with_detail(spark.createDataFrame([(DETAIL,)], "html string")).select("detail.*")
    d = det.select(extraction.guide_year(F.col("meta"), F.col("og")).alias("y"), extraction.telephone("telephone").alias("t"), extraction.map_point(F.col("iframes")).alias("p"), extraction.local_name("heading").alias("h"), "address", "description", "website").first()
    assert (d["y"], d["t"], tuple(d["p"]), d["h"], d["address"], d["description"]) == ("2025", "+8130000", (35.1, 139.7), "Alpha", "1 Main St", "Nice place")
    assert one(spark, extraction.page_number(F.lit("/a?page=7&x"))) == 7 and one(spark, extraction.page_number(F.lit("/a/page/4"))) == 4 and one(spark, extraction.page_number(F.lit(None).cast("string"), 9)) == 9
    assert one(spark, extraction.scope_name(F.lit("🍜 North Port - Guide"))) == "North Port" and one(spark, extraction.scope_name(F.lit("Restaurants"))) == "" and one(spark, extraction.scope_name(F.lit("A very long name of some scope that goes on"))) == "A very long name of some"
    assert one(spark, extraction.region_of(F.lit("/en/north-region/x"))) == "north-region" and one(spark, extraction.local_page_url(F.lit("https://g.example/us/en/r/x"), "jp", "ja")) == "https://g.example/jp/ja/r/x"
    assert one(spark, extraction.guarded_next(F.lit("n"), F.lit(3), F.lit(4), F.lit(3))) is None
    ok = one(spark, extraction.listing_validity(F.lit(200), F.lit("T"), F.lit("<html>"), F.lit("H")))
    assert ok["ok"] and one(spark, extraction.listing_validity(F.lit(404), F.lit("T"), F.lit(""), F.lit("")))["reason"] == "status 404"
    scopes = spark.createDataFrame([(1, "port", 2, 0), (1, "Port", 3, 1), (1, "Bay of X", 3, 2), (2, "restaurants", 3, 0)], "page int, t string, prio int, o int")
    assert [tuple(r) for r in extraction.best_scope(scopes, ["page"], "t", "prio", "o").collect()] == [(1, "Bay of X")]


def test_rendering(spark):
    null = F.lit(None).cast("string")
    tries = one(spark, rendering.query_attempts(F.lit("Alpha"), F.lit("阿法"), F.array(F.lit("Al")), F.lit("Port"), F.lit("台北市大安區復興路12號"), F.lit("French"), F.lit(25.0), F.lit(121.5)))
    assert tries[:4] == ["阿法 台北市大安區", "阿法 復興路12號", "阿法 Port", "阿法"] and "Al Port" in tries and "25,121.5" in tries and len({t.lower() for t in tries}) == len(tries)
    only = one(spark, rendering.query_attempts(null, null, F.array().cast("array<string>"), F.lit("Port"), F.lit("Main 1"), null, F.lit(None).cast("double"), F.lit(None).cast("double")))
    assert only == ["Main 1"]
    assert one(spark, rendering.guide_note(F.lit("2025"), null, F.lit(" French "), F.lit("2025-01-02"), F.lit("Nice"))) == "2025 | French | updated 2025-01-02\nNice"
    fields = F.create_map(F.lit("a"), F.lit("x|y"), F.lit("b"), F.lit(" "))
    assert one(spark, rendering.template_note(fields, "A {a}|B {b}|{{c}}")) == "A x｜y | {c}" and one(spark, rendering.raw_note(fields)) == "a: x｜y"
    assert one(spark, rendering.list_name("{prefix} {scope} {label}", "P", F.lit("Port"), F.lit("stars"), {"stars": "Stars"}, {})) == "P Port Stars"
    with pytest.raises(ValueError):
        rendering.list_name("{nope}", "", F.lit(""), F.lit(""), {"a": "b"}, {"a": "b"})


DIRTY = [
    "mail a.b@c.example.org now", "x?token=abc&key=AIzaSyA123456789012345678901234", "sid=abc; HSID = 9", '{"email": "q", "sid":"1"}', "/Users/me/file", "//lh3.googleusercontent.com/ogw/abc", '<div class="gb_g">Name</div>',
    'aria-label="Google Account: Jo Do (jo@x.example.com)"', "", None, "plain text", "a" * 20000,
]


def test_redaction(spark):
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(DIRTY)], "id int, content string, clean string")
    done = df.select("id", redaction.redacted("content").alias("content")).withColumn("again", redaction.redacted("content")).withColumn("left", redaction.markers("content")).orderBy("id").collect()
    assert all(r["content"] == r["again"] and r["left"] == [] for r in done), [r for r in done if r["left"] or r["content"] != r["again"]]
    assert done[0]["content"] == "mail <redacted-email> now" and done[10]["content"] == "plain text" and len(done[11]["content"]) == 20000
    assert one(spark, redaction.markers(F.lit(DIRTY[0]))) == ["email"] and redaction.safe_to_write(df, "content").count() == len(DIRTY)
    assert {r["id"] for r in redaction.scanned(df.withColumn("path", F.col("id")), "path", "content").select(F.col("path").alias("id")).collect()} == set(range(8))
    m = lambda a, b: one(spark, redaction.list_match(F.lit(a), F.lit(b)))
    assert (m("My List", " my  list "), m("My List", "My List · 3 places"), m("My List", "My Listing"), m("", "x")) == (3, 2, 0, 0)
    b = lambda h, n: one(spark, redaction.bounded_contains(F.lit(h), F.lit(n)))
    assert b("a (x.y) b", "x.y") and not b("ax.yb", "x.y") and not b("中x中", "x")
    assert one(spark, redaction.same_note(F.lit("A\r\n b"), F.lit("a\nb"))) and not one(spark, redaction.same_note(F.lit("a"), F.lit("")))


def test_evaluation(spark):
    cases = spark.createDataFrame([("c", "g", True, "match"), ("c", "g", False, "match"), ("c", "h", True, "reject"), ("c", "h", True, "manual")], "config string, g string, a boolean, e string")
    r = evaluation.confusion(cases, ["config"], F.col("a"), F.col("e")).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"], r["precision"], r["recall"]) == (1, 1, 1, 0, 0.5, 0.5)
    assert {x["g"]: x["recall"] for x in evaluation.group_recall(cases, ["config"], "g", F.col("a"), F.col("e")).collect()} == {"g": 0.5, "h": 1.0}
    scores = spark.createDataFrame([("a", 9.0, 3), ("b", 8.99, 1), ("c", 9.5, 9)], "s string, score double, rank int")
    assert evaluation.select_strategy(scores, "score", "rank", F.col("s") != "c").first()["s"] == "b"
    with pytest.raises(Exception, match="no strategy"):
        evaluation.select_strategy(scores, "score", "rank", F.lit(False)).collect()
    assert evaluation.best_by(scores, [], [F.col("score")], F.col("rank")).first()["s"] == "c"
    assert evaluation.weighted_grid(spark, {"a": [0.5, 0.7], "b": [0.5, 0.3]}).count() == 2
    w, b = evaluation.fit_logistic([[1.0], [0.9], [0.1], [0.0]], [1, 1, 0, 0], steps=3000, rate=0.5)
    assert w[0] > 0 > b
    gate = {r["case_group"]: r["met"] for r in evaluation.corpus_gate(cases, "g", {"g": 2, "z": 1}, 4).collect()}
    assert gate == {"g": True, "z": False, "all": True}


def test_names_are_taken_apart_once(spark):
    """Within a lambda nothing is shared: the letters that n-grams are cut from are joined once, not for each n-gram."""
    parts = spark.range(1).select(evidence.name_parts(F.lit("alpha inn")).alias("p"))
    assert parts._jdf.queryExecution().analyzed().toString().count("regexp_replace(") == 3
    p = parts.first()["p"]
    assert p["compact"] == "alphainn" and p["two"] == ["al", "lp", "ph", "ha", "ai", "in", "nn"] and p["identity"] == ["alpha", "inn"] and p["cjk"] == ""

import pytest
from pyspark.sql import functions as F

from placeweave.operators import evaluation, redaction, rendering, resume, routing, sinks, summary
from placeweave.sources import adapters, files


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


PAGES = "run string, start string, page_number int, page_url string, next_url string, next_page_number int, estimated_total_pages int, total_restaurants int, value int"


def test_checkpoints(spark):
    pages = spark.createDataFrame([("a", "s", 1, "p1", "p2", 2, None, 4, 0), ("a", "s", 2, "p2", "p3", 3, 9, 8, 0), ("a", "s", 2, "p2", "p3", 3, 9, 8, 0), ("b", "t", 1, "q1", None, 2, None, 3, 0), ("c", "u", 1, "r1", "", 2, None, 0, 0)], PAGES)
    rows = spark.createDataFrame([("a", "stars"), ("a", "x"), ("b", None)], "run string, level string")
    synced = spark.createDataFrame([("a", "k2"), ("a", "k1"), ("a", "k1"), ("b", None)], "run string, key string")
    counts = resume.level_counts(rows, "run", "level", ("stars", "selected"))
    saved = resume.saved_checkpoints(pages, "run", "start", counts, synced, "key")
    got = {r["run"]: r["value"] for r in saved.collect()}
    assert got["b"] is None and got["c"] is None
    assert got["a"] == '{"estimated_total_pages":9,"last_page_number":2,"last_page_url":"p2","next_page_number":3,"next_url":"p3","rows_per_level":{"stars":1,"selected":0},"start_url":"s","synced_row_keys":["k1","k2"],"total_restaurants":8,"version":1}'
    plans = {r["run"]: r for r in resume.resume_plans(saved, "start", "value", ("stars", "selected", "bib-gourmand")).collect()}
    assert (plans["a"]["start_scrape_url"], plans["a"]["start_page_number"], plans["a"]["row_counts"], plans["a"]["done_keys"]) == ("p3", 3, {"stars": 1, "selected": 0, "bib-gourmand": 0}, ["k1", "k2"])
    assert (plans["b"]["start_scrape_url"], plans["b"]["start_page_number"], plans["b"]["initial_total_restaurants"], plans["b"]["done_keys"], plans["b"]["warning"]) == ("t", 1, 0, [], None)
    ignored = {r["run"]: (r["start_page_number"], r["warning"]) for r in resume.resume_plans(saved, "start", "value", ("stars",), F.lit(True)).collect()}
    assert ignored["a"] == (1, "ignored")
    again = {r["run"]: r for r in resume.resume_plans(resume.interrupted_checkpoints(pages, "run", "start", counts, synced, "key"), "start", "value", ("stars",)).collect()}
    assert again["a"]["start_scrape_url"] == "p2" and again["b"]["start_scrape_url"] == "q1"
    assert resume.saved_checkpoints(pages.limit(0), "run", "start", counts, synced, "key").count() == 0


def test_checkpoint_files(spark, tmp_path):
    path = f"{tmp_path}/c.json"
    for text in ('{"a": 1}', '{"a": 2}'):
        resume.write_checkpoint(text, path, spark)
        assert open(path).read() == text + "\n"
    resume.clear_checkpoint(path, spark)
    resume.clear_checkpoint(path, spark)
    assert not list(tmp_path.glob("*.json*"))
    assert one(spark, resume.state_path(F.lit("/x/"), F.lit("Old Port!"))) == "/x/old-port-checkpoint.json" and one(spark, resume.state_path(F.lit(None), F.lit(None), "errors")) == ".placeweave-state/places-errors.jsonl"


def test_target_addresses(spark):
    asked = spark.createDataFrame([("north", "no", 1), ("south", "so", 2), ("west", "we", 3), ("east", None, 4)], "slug string, code string, url_ int")
    cat = spark.createDataFrame([("zh_HK", "north", "supported", "hk"), ("zh_TW", "north", "supported", "tw"), ("zh_TW", "south", "unsupported", None), ("zh_HK", "south", "supported", "hk2"), ("fr", "west", "supported", "fr")], "lang string, slug string, status string, url string").withColumn("reason", F.lit("r"))
    got = {r["slug"]: r["url"] for r in routing.target_urls(asked, "slug", "code", cat, "zh_CN", "b", strict=False).collect()}
    assert got == {"north": "tw", "south": None, "west": "b/tw/zh_TW/selection/west/restaurants", "east": "b/tw/zh_TW/selection/east/restaurants"}
    generic = {r["slug"]: r["url"] for r in routing.target_urls(asked, "slug", "code", cat, "xx", "b").collect()}
    assert generic["north"] == "b/xx/no/restaurants" and generic["east"] == "b/xx//restaurants"
    with pytest.raises(Exception, match="no address in zh_TW for south"):
        routing.target_urls(asked, "slug", "code", cat, "zh_TW", "b").collect()
    assert one(spark, routing.city_path(F.lit("en/jp/tokyo/x"), "ja", ("jp",))) == "jp/ja/tokyo/x" and one(spark, routing.city_path(F.lit("en/jp/tokyo/x"), "th", ("jp",))) == "th/jp/tokyo/x" and one(spark, routing.city_path(F.lit("tokyo"), "th", ())) == "th/tokyo"
    labels = routing.labelled(spark.createDataFrame([("old-port", "Port", 1), ("new-port", None, 2), ("x", "", 3)], "slug string, label string, lang int"), "slug", spark.createDataFrame([("ja", "old-port", "港"), ("fr", "x", "X!")], "lang string, slug string, label string"), "ja")
    assert {r["slug"]: r["shown"] for r in labels.collect()} == {"old-port": "港", "new-port": "New Port", "x": "X"}
    assert one(spark, routing.local_language(F.lit("jp"))) == "ja" and one(spark, routing.local_language(F.lit("north-region"))) is None and one(spark, routing.local_language(F.lit(None).cast("string"))) is None
    scope = lambda a, b: one(spark, routing.chosen_scope(F.lit(a), F.lit(b)))
    assert scope("Port 港", "港") == "港" and scope("Port", "港") == "Port" and scope("", "p") == "p" and scope("Port 港", "p") == "Port 港"
    tried = spark.createDataFrame([("a", 0, "a", "u0", False, "d", "t"), ("a", 1, "a2", "u1", True, "", ""), ("b", 0, "b", "u", False, "gone", None)], "target string, o int, candidate string, url string, ok boolean, detail string, title string")
    entries = {r["target"]: (r["status"], r["source"], r["url"], r["reason"]) for r in routing.discovered_entries(tried, "target", "o").collect()}
    assert entries == {"a": ("supported", "validated-alternate-selection-candidate", "u1", None), "b": ("unsupported", "live-validation", "", "no candidate is valid: b: gone ()")}


def test_numbered_within(spark):
    rows = spark.createDataFrame([("a" if i % 10 else None, i * 7 % 1000, i) for i in range(1000)], "g string, o int, i int")
    got = routing.numbered_within(rows, "g", [F.col("o"), F.col("i")], "n", parts=7).collect()
    for g in ("a", None):
        own = sorted((r["o"], r["i"], r["n"]) for r in got if r["g"] == g)
        assert [n for *_, n in own] == list(range(1, len(own) + 1)) or g is None
    assert len(got) >= 900


def test_progress_and_totals(spark):
    p = lambda *a: one(spark, summary.estimated_progress(*(F.lit(x).cast("double") if x is not None else F.lit(None).cast("double") for x in a)))
    assert p(1, 5, 10, None, 100, 20, 3) == pytest.approx(0.235) and p(9, 9, 10, None, 10, 50, 0) == 0.99 and p(2, 5, 10, 4, None, 0, 0) == pytest.approx(0.375) and p(1, 1, 0, 4, 0, 0, 0) is None
    rows = spark.createDataFrame([("r", 1, 0.5, 0, 10), ("r", 2, 0.2, 1, 10), ("r", 3, None, 8, 10), ("r", 4, None, None, None)], "run string, o int, c double, s int, e int")
    done = summary.overall_progress(rows, ["run"], [F.col("o")], F.col("c"), F.col("s"), F.col("e"))
    assert [round(r["progress"], 4) for r in done.orderBy("o").collect()] == [0.525, 0.525, 0.81, 0.81]
    assert [r["o"] for r in summary.reported_steps(done, ["run"], [F.col("o")], "progress").orderBy("o").collect()] == [1, 3]
    counts = spark.createDataFrame([("a", 5, 2, 0, 1, 2), ("b", 1, 3, 0, 0, 0)], "bucket string, scraped int, before int, added int, skipped int, failed int")
    total = summary.final_summary(counts).first()
    assert (total["session"], total["hard_failure"], total["exit_code"]) == (1, True, 1) and summary.final_summary(counts.limit(0)).first()["exit_code"] == 0
    grams = {(r["k"], r["gram"]): r["n"] for r in summary.gram_counts(spark.createDataFrame([(1, "ab"), (2, "abc"), (3, ""), (4, None)], "k int, v string"), "k", F.coalesce("v", F.lit(""))).collect()}
    assert grams == {(1, "ab"): 3, (2, "ab"): 1, (2, "bc"): 1, (2, "abc"): 2}
    state = "struct<page_url:string,title:string,first_result:string,no_results:boolean,loading:boolean>"
    fresh = lambda b, n, ms, seen: spark.createDataFrame([(b, n)], f"b {state}, n {state}").select(summary.fresh_state("b", "n", F.lit(ms), F.lit(100), F.lit(seen)).alias("x")).first()["x"]
    old = ("u", "t", "r", False, False)
    assert fresh(old, ("u", "t2", "r", False, False), 0, False) and not fresh(old, old, 999, True) and not fresh(old, ("u2", "t", "r", False, False), 0, False) and fresh(old, ("u2", "t", "r", None, None), 100, False)
    assert not fresh(old, ("u2", "x", "y", True, False), 999, True) and fresh(("u", "t", None, False, False), ("u", "t", None, False, False), 999, True) is False


def test_sinks_and_notes(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "id int, status_ string")
    assert {r["status"] for r in sinks.dry_run(rows).collect()} == {"skipped"} and [r["status"] for r in sinks.probed(rows, F.col("status_") == "a").orderBy("id").collect()] == ["skipped", "skipped", "failed"]
    for frame in (rows, rows.where("id = 2")):
        sinks.write_error_report(frame, f"{tmp_path}/r")
    assert [r["id"] for r in spark.read.json(f"{tmp_path}/r").collect()] == [2]
    with pytest.raises(Exception):
        sinks.write_pages(spark.createDataFrame([('aria-label="Google Account: <i>',)], "content string").withColumn("content", F.raise_error(F.lit("stop")).cast("string")), f"{tmp_path}/p")
    fields = F.create_map(*(F.lit(x) for x in ("總得晚數", "3", "菜系", "a|b", "地址", " ")))
    assert one(spark, rendering.bowls_note(fields)) == "3碗 | a｜b" and one(spark, rendering.bowls_note(F.create_map(F.lit("x"), F.lit("y")))) == ""


def test_fixture_redaction(spark):
    key = redaction.TEST_KEY
    assert one(spark, redaction.fixture_redacted(F.lit(f"AIzaSyA1234567890123456789 {key} ?key=abc&x"))) == f"{key} {key} ?key={key}&x"
    assert one(spark, redaction.fixture_markers(F.lit('AIzaSyA1234567890123456789 <div class="gb_g">Jo</div>'))) == ["google-api-key", "google-account-name"] and one(spark, redaction.fixture_markers(F.lit(key))) == []
    assert one(spark, redaction.redacted(F.lit(f"?key={key}&a ?key={key}9"))) == f"?key={key}&a ?key=<redacted>" and one(spark, redaction.markers(F.lit(key))) == []


def test_sources(spark, tmp_path):
    pages = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "gone"), ("e", None), (None, "a")], "url string, next_url string")
    stop = lambda start, n: [(r["url"], r["stop"]) for r in adapters.crawled(pages, start, n).orderBy("page_seq").collect()]
    assert stop("a", 9) == [("a", None), ("b", None), ("c", "revisited")] and stop("a", 2) == [("a", None), ("b", "limit")] and stop("d", 9) == [("d", "missing")] and stop("e", 9) == [("e", "end")] and stop("none", 9) == []
    marks = spark.createDataFrame([("f", 0, "ok"), ("f", 1, "skipped"), ("f", 2, "ok"), ("g", 0, "unsupported")], "path string, ord int, status string")
    assert {r["path"]: (r["n_rows"], r["fault"]) for r in adapters.import_counts(marks).collect()} == {"f": (2, None), "g": (0, "no importable places")}
    page = adapters.imported_page(marks, [F.col("ord")])
    assert [(r["ord"], r["card_ord"], r["total_rows"]) for r in page.orderBy("ord").collect()] == [(0, 0, 2), (2, 1, 2)]
    assert adapters.route_imported(page, ("stars",)).count() == 0 and adapters.route_imported(page, ("imported",)).count() == 2
    (tmp_path / "rows.jsonl").write_text('\n{"Name": "a"}\r\n\n{"Name": "b"}\n')
    assert [(r["line_no"], r["Name"]) for r in files.read_rows(spark, f"{tmp_path}/rows.jsonl").orderBy("line_no").collect()] == [(2, "a"), (4, "b")]
    (tmp_path / "bad.jsonl").write_text('{"Name": "a"}\n[1]\n')
    with pytest.raises(Exception, match="line 2"):
        files.read_rows(spark, f"{tmp_path}/bad.jsonl").collect()


def test_configurations(spark):
    assert evaluation.weighted_configurations(spark).count() == 315 * 486 and evaluation.ngram_configurations(spark).count() == 144
    cases = spark.createDataFrame([("c", "known", "reject", True), ("c", "known", "reject", False), ("c", "a", "match", True), ("c", "b", "match", False)], "config string, g string, e string, a boolean")
    s = evaluation.strategy_scores(cases, ["config"], "g", "e", F.col("a"), "known", ("a", "b", "none")).first()
    assert s["weighted_score"] == pytest.approx(0 + 2 + 0 + 1.5 + 0.5 - 2.5)
    wrong = evaluation.failures(cases.withColumn("d", F.struct(F.col("a").alias("accept"), F.lit("x").alias("strength"), F.lit(1.23456).alias("score"))), "config", "g", "e", "d", F.array())
    assert sorted((r["kind"], r["score"]) for r in wrong.collect()) == [("false_accept", 1.2346), ("false_reject", 1.2346)]

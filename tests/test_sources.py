import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from placeweave.operators.ordering import first_wins
from placeweave.sources import files, kml
from placeweave.streaming import sync

KML = """<?xml version="1.0"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>Trip</name><Folder>
<Placemark><name>Alpha｜Alfa</name><description><![CDATA[Kind: noodles<br>Kind：soup<br>Price: 5]]></description><Point><coordinates>121.5,25.1,0</coordinates></Point></Placemark>
<Placemark><name>Beta</name><ExtendedData><Data name="Addr."><value>Main 1</value></Data><SchemaData><SimpleData name="City">Port</SimpleData></SchemaData></ExtendedData></Placemark>
<Placemark><name>Gamma</name><address>Side 2</address></Placemark>
<Placemark><Point><coordinates>1,2</coordinates></Point></Placemark>
<Placemark><name>Bad</name><Point><coordinates>999,2</coordinates></Point></Placemark>
<Placemark><name>Line</name><LineString><coordinates>1,2 3,4</coordinates></LineString></Placemark></Folder></Document></kml>"""


def test_kml(spark):
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("other.kml", "<kml/>")
        z.writestr("a/doc.kml", KML)
    df = spark.createDataFrame([("x.kml", bytearray(KML.encode())), ("y.kmz", bytearray(packed.getvalue()))], "path string, content binary")
    rows = kml.place_rows(kml.placemarks(df)).orderBy("path", "ord").collect()
    assert len(rows) == 12 and [r["status"] for r in rows[:6]] == ["ok", "ok", "ok", "skipped", "skipped", "unsupported"]
    a, b, c = rows[:3]
    assert a["description_fields"] == {"Kind": "soup", "Price": "5"} and (a["lat"], a["lon"], a["address"]) == (25.1, 121.5, "25.1,121.5") and a["aliases"] == ["Alpha Alfa", "Alfa"]
    assert (b["address"], b["city"], c["address"], a["document"]) == ("Main 1", "Port", "Side 2", "Trip")
    null = F.lit(None).cast("string")
    got = spark.range(1).select(kml.scope(null, F.lit(" "), F.lit("/a/Trip One.kmz")).alias("a"), kml.scope(F.lit("x"), null, null).alias("b"), kml.scope(null, null, null).alias("c")).first()
    assert tuple(got) == ("Trip One", "x", "places")


def test_rows_and_catalogue(spark, tmp_path):
    (tmp_path / "rows.jsonl").write_text('{"Name": "A", "Latitude": 1.5}\n\n{"Name": "B", "City": "Port"}\n')
    got = [(r["line_no"], r["Name"], r["City"], r["Latitude"]) for r in files.read_rows(spark, str(tmp_path / "rows.jsonl")).orderBy("line_no").collect()]
    assert got == [(1, "A", None, "1.5"), (3, "B", "Port", None)]
    for bad, word in (('{"Name": " "}', "no Name"), ("[1]", "not a JSON object"), ("{", "not a JSON object")):
        (tmp_path / "bad.jsonl").write_text(f'{{"Name": "A"}}\n{bad}\n')
        with pytest.raises(Exception, match=f"line 2: {word}"):
            files.read_rows(spark, str(tmp_path / "bad.jsonl")).collect()
    doc = json.dumps({"en": {"city": {"port": {"status": "ok", "url": "u"}}, "country": {}}, "de": 5})
    df = spark.createDataFrame([(doc,)], "j string")
    assert [tuple(r) for r in files.catalogue_rows(df, "j").collect()] == [("en", "city", "port", "ok", None, "u", None)]
    (tmp_path / "b.html").write_text("<p>b")
    (tmp_path / "a.html").write_bytes(b"\xff\xfe")
    assert [r["html"] for r in files.read_pages(spark, str(tmp_path)).collect()] == ["<p>b"]


def test_page_chain(spark):
    pages = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), (None, "a")], "url string, next_url string")
    chain = {r["url"]: r["page_seq"] for r in files.page_chain(pages, "a", 16).collect()}
    assert chain == {"a": 0, "b": 1, "c": 2}
    assert files.page_chain(pages, "none", 16).count() == 0


def test_checkpoints(spark):
    good = {"version": 1, "start_url": "s", "next_url": "n", "next_page_number": 2, "total_restaurants": 5, "rows_per_level": {"a": 1}, "synced_row_keys": ["k"]}
    docs = [json.dumps(good), json.dumps(good | {"version": 2}), json.dumps(good | {"start_url": "t"}), json.dumps(good | {"rows_per_level": {"a": -1}}), json.dumps(good | {"next_url": ""}), "{", "", None]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "id int, doc string")
    got = {r["id"]: r["warning"] for r in files.checkpoint_state(df, "doc", "s").collect()}
    assert got == {0: None, 1: "other version", 2: "other start", 3: "bad counts", 4: "no next page", 5: "unreadable", 6: "empty", 7: "empty"}


def test_stream_replay(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    one = spark.createDataFrame([(1, "a", False), (2, "a", True), (3, "b", True)], "id int, k string, ok boolean")
    two = spark.createDataFrame([(4, "a", True), (5, "c", True), (6, "c", True)], "id int, k string, ok boolean")
    one.coalesce(1).write.mode("append").parquet(src)
    start = lambda: sync.start_sync(spark.readStream.schema(one.schema).parquet(src), out, state, ["k"], [F.col("id")], lambda df: df.withColumn("accepted", F.col("ok"))).awaitTermination()
    start()
    two.coalesce(1).write.mode("append").parquet(src)
    start()
    got = {r["id"]: r["status"] for r in spark.read.parquet(out).collect()}
    assert got == {1: "failed", 2: "added", 3: "added", 4: "skipped", 5: "added", 6: "skipped"}
    # A batch done again, as after a lost driver, changes nothing.
    sync.write_once(sync.sync_batch(two, 1, out, ["k"], [F.col("id")], lambda df: df.withColumn("accepted", F.col("ok"))), 1, out)
    assert {r["id"]: r["status"] for r in spark.read.parquet(out).collect()} == got
    assert first_wins(one, ["k"], [F.col("id")], F.col("ok")).count() == 3

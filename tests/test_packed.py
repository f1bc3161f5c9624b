import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from placeweave.operators.packed import packed_values, parses, split_packed, unquote

SCHEMA = "id long, text string, value string, dialect string"


def run(spark, texts, **kw):
    # Besides the key, columns whose names clash with the operator's own.
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)]
    out = {}
    for r in split_packed(spark.createDataFrame(rows, SCHEMA), ["id"], **kw).orderBy("id", "item_no").collect():
        out.setdefault(r["id"], []).append(r["item_text"])
    return out


NAMES = ["Red Fox Inn", "Old Mill", "Blue Door Cafe", "Sun & Moon", "Green Gate"]


def test_dialects(spark):
    texts = [
        "Red Fox Inn; Old Mill; Blue Door Cafe;", "Red Fox Inn | Old Mill", "Red Fox Inn\r\nOld Mill", "Red Fox Inn\tOld Mill", "Red Fox Inn || Old Mill", "Red Fox Inn / Old Mill",
        '"Red Fox Inn", "Old Mill, Harbour"', '["Red Fox Inn", "Old Mill, 5 High Street, Town", "\\"Mill\\" Town"]', "['Red Fox Inn', \"Old Mill's\"]", '"""Red"" Inn", Old Mill', "Red Fox Inn; 41.4715, -103.3797",
        "  Red Fox Inn, Old Mill ", "Open 24/7", "Red Fox Inn (a; b); Old Mill", "[Red Fox Inn; Old Mill]", "Red Fox Inn；Old Mill", *NAMES,
    ]
    got = run(spark, texts)
    want = [
        ["Red Fox Inn", "Old Mill", "Blue Door Cafe"], ["Red Fox Inn", "Old Mill"], ["Red Fox Inn", "Old Mill"], ["Red Fox Inn", "Old Mill"], ["Red Fox Inn", "Old Mill"], ["Red Fox Inn", "Old Mill"],
        ["Red Fox Inn", "Old Mill, Harbour"], ["Red Fox Inn", "Old Mill, 5 High Street, Town", '"Mill" Town'], ["Red Fox Inn", "Old Mill's"], ['"Red" Inn', "Old Mill"], ["Red Fox Inn", "41.4715, -103.3797"],
        ["Red Fox Inn", "Old Mill"], ["Open 24/7"], ["Red Fox Inn (a; b)", "Old Mill"], ["Red Fox Inn", "Old Mill"], ["Red Fox Inn", "Old Mill"], *[[n] for n in NAMES],
    ]
    assert [got[i] for i in range(len(texts))] == want


def test_four_delimiters_of_five(spark):
    text = "Red Fox Inn\nOld Mill, 5 High Street; Blue Door Cafe, 7 High Street|Sun & Moon, 9 High Street\tGreen Gate"
    want = ["Red Fox Inn", "Old Mill, 5 High Street", "Blue Door Cafe, 7 High Street", "Sun & Moon, 9 High Street", "Green Gate"]
    assert want in [v for _, v in parses(text, False)]
    known = [*want, *(f"{w}; {v}" for w in want for v in want if v != w and "," not in v + w)]
    assert run(spark, [text, *known, *(f"{n}, {i} High Street; {n}, {i} Mill Lane" for i, n in enumerate(NAMES))])[0] == want


def test_missing_repeated_and_long(spark):
    long = "; ".join(f"Place {i}" for i in range(3000))
    got = run(spark, [None, "", "   ", "A; B", "A; B", ";;", long])
    assert got[3] == got[4] == ["A", "B"]
    assert set(got) == {3, 4, 6} and len(got[6]) == 3000
    assert split_packed(spark.createDataFrame([], SCHEMA), ["id"]).count() == 0


def test_commas_of_names_need_quotes(spark):
    guide = spark.createDataFrame([(1, "Smoke, Salt & Sage"), (2, '"Red Fox","Red Fox Club, Town"'), (3, None)], "row_id long, name string")
    fails = spark.createDataFrame([(9, "Old Mill Town,Old Mill")], "failure_id long, attempted_queries string")
    got = [(r["field_name"], r["rec_id"], r["item_no"], r["item_text"]) for r in packed_values(guide, fails).orderBy("field_name", "rec_id", "item_no").collect()]
    assert got == [
        ("attempted_queries", 9, 1, "Old Mill Town"), ("attempted_queries", 9, 2, "Old Mill"), ("name", 1, 1, "Smoke, Salt & Sage"), ("name", 2, 1, "Red Fox"), ("name", 2, 2, "Red Fox Club, Town"),
    ]


value = st.text(st.characters(codec="utf-8", categories=("L", "N")), min_size=1, max_size=8)


@settings(max_examples=150, deadline=None)
@given(st.lists(value, min_size=2, max_size=6))
def test_round_trip_of_lists(values):
    (reading,) = parses(json.dumps(values, ensure_ascii=False), False)
    assert reading == ("list", values)
    assert values in [v for _, v in parses("; ".join(values), False)]


def test_unquote():
    assert unquote(' "a ""b"" c" ') == 'a "b" c'
    assert unquote('"a" and "b"') == '"a" and "b"'
    assert unquote("«x»") == "x" and unquote('"') == '"'


def test_no_data_in_the_driver(spark):
    fields = spark.range(50).select("id", F.lit("Red; Blue").alias("text"))
    assert split_packed(fields, ["id"]).count() == 100

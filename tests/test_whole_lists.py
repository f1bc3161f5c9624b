"""Lists that were cut at five entries are gone through whole."""

import pytest
from pyspark.sql import functions as F

from placeweave.operators import ordering
from placeweave.plans import queries as core

CANDIDATES = "query_text string, cand_ord int, cand_id long, name string, address string, category string, subtitle string, located_in string"
FAILURES = "failure_id long, attempted_queries string, matcher_row struct<name: string, city: string, address: string, cuisine: string>"


def test_failures_meet_all_candidates(spark, tmp_path):
    other = [("Blue Kiln", i, i, "Blue Kiln Laundry Depot", "9 Elm Road, Northport", "Laundry", None, None) for i in range(1, 41)]
    right = ("Blue Kiln", 41, 41, "Blue Kiln Bistro", "12 Harbor Street, Westhaven", "Bistro", None, None)
    after = [("Blue Kiln", 42, 42, *right[3:]), ("Blue Kiln Westhaven", 1, 90, *right[3:]), (None, 1, 91, *right[3:])]
    row = ("Blue Kiln Bistro", "Westhaven", "12 Harbor Street, Westhaven", "French")
    failures = [(1, "Blue Kiln\nBlue Kiln Westhaven", row), (2, "Blue Kiln", ("Zebra Noodle", "Eastmoor", "7 Pine Lane, Eastmoor", "Noodles")), (3, "nothing", row), (4, None, row)]
    spark.createDataFrame([*other, right, *after], CANDIDATES).write.parquet(f"{tmp_path}/place_candidates.parquet")
    spark.createDataFrame(failures, FAILURES).write.parquet(f"{tmp_path}/target_failures.parquet")
    got = {r["failure_id"]: (r["cand_id"], r["n_pairs"], r["n_before"]) for r in core.queries()["failure_candidates"](spark, str(tmp_path)).collect()}
    assert got == {1: (41, 43, 40), 2: (None, 42, 42), 3: (None, 0, 0), 4: (None, 0, 0)}


@pytest.mark.parametrize("first, growth", [(1, 2), (2, 8), (100, 2)])
def test_first_listed_equals_first_acceptable(spark, first, growth):
    lists = {"a": 1, "b": 7, "c": 30, "d": 0}
    entries = spark.createDataFrame([(k, i // 2, i % 3, ord(k) * 100 + i) for k, n in lists.items() for i in range(n)], "k string, o int, p int, id int")
    asked = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "c"), (2, 2, "c"), (3, 1, "d"), (4, 1, "c"), (4, 2, "a"), (5, 1, "b"), (5, 1, "b"), (6, 1, None), (None, 1, "a")], "r int, no int, k string")
    pairs = asked.where("r is not null").join(entries, "k")
    good = (F.col("r") * 7 + F.col("id")) % 23 == 0
    met = []

    def accepted(df):
        met.append(df.count())
        return df.where(good)

    found = ordering.first_listed(asked, entries, "r", "no", "k", ["o", "p"], accepted, first, growth)
    columns = ["r", "id", "n_pairs", "n_before"]
    want = ordering.first_acceptable(pairs, ["r"], [F.col("no"), F.col("o"), F.col("p")], good)
    assert sorted(found.select(columns).collect(), key=str) == sorted(want.select(columns).collect(), key=str)
    assert len(met) == 1 or sum(met) < pairs.count()
    assert ordering.first_listed(asked.limit(0), entries, "r", "no", "k", ["o", "p"], accepted).count() == 0

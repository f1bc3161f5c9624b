"""Visually identical text with different characters: skeletons, consistent forms and the values that deviate."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeweave.llm.text import ALIKE, consistent_form, skeleton


@F.pandas_udf(T.StructType([T.StructField("form", T.StringType()), T.StructField("skeleton", T.StringType())]))
def _forms(values: pd.Series) -> pd.DataFrame:
    found = {v: (consistent_form(v), skeleton(v)) for v in set(values) if v is not None}
    return pd.DataFrame([found.get(v, (None, None)) for v in values], columns=["form", "skeleton"])


# So that a filter on the result doesn't have it run twice.
_forms = _forms.asNondeterministic()


def skeleton_of_ascii(value: str) -> Column:
    """The skeleton of an ASCII text, inside the JVM."""
    single = {k: v for k, v in ALIKE.items() if k.isascii() and len(v) == 1}
    out = F.translate(F.col(value), "".join(single), "".join(single.values()))
    for k, v in ALIKE.items():
        if k.isascii() and len(v) > 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return out


def consistent_values(values: DataFrame, value: str = "value") -> DataFrame:
    """Adds `form`, the value in plain characters, `skeleton`, what it looks like, and `deviates`.

    Null gives null, null and false; the empty text is its own form. ASCII values
    are decided inside the JVM and never sent to Python. Other columns stay, and
    values of any length are folded whole.
    """
    plain = ~F.col(value).rlike(r"[^\x00-\x7F]")
    mixed = F.when(~plain, F.col(value))
    out = values.withColumn("__f", F.when(mixed.isNotNull(), _forms(mixed)))
    return (
        out.withColumn("form", F.when(plain, F.col(value)).otherwise(F.col("__f.form")))
        .withColumn("skeleton", F.when(plain, skeleton_of_ascii(value)).otherwise(F.col("__f.skeleton")))
        .withColumn("deviates", F.coalesce(F.col("form") != F.col(value), F.lit(False)))
        .drop("__f")
    )


def deviating_values(values: DataFrame, value: str = "value") -> DataFrame:
    """The rows whose value is in a group of equal skeletons without being a plain spelling of it; `form`, the plain one, and `skeleton` are added.

    A group's plain spellings are its ASCII members and the consistent forms of all
    its members. A value beside an ASCII member deviates, whatever its alphabet, as
    does one that is not its own consistent form; a value alone in its group, or
    beside others of its alphabet, is a spelling of its own. ASCII values never
    deviate: words that only look alike, as with rn and m, are two words.

    Each distinct value is folded once, ASCII ones inside the JVM. Null and empty
    values come out nowhere; repeated rows each do; an empty table gives none.
    """
    odd = values.where(F.col(value).rlike(r"[^\x00-\x7F]"))
    distinct = odd.select(F.col(value).alias("__v")).distinct()
    members = distinct.withColumn("__f", _forms(F.col("__v"))).select("__v", "__f.form", "__f.skeleton")
    plain = values.where(~F.col(value).rlike(r"[^\x00-\x7F]")).select(skeleton_of_ascii(value).alias("skeleton"), F.col(value).alias("__p"))
    plain = plain.groupBy("skeleton").agg(F.min("__p").alias("__p"))
    found = members.join(plain, "skeleton", "left").where((F.col("form") != F.col("__v")) | F.col("__p").isNotNull())
    found = found.select("__v", F.when(F.col("form") != F.col("__v"), F.col("form")).otherwise(F.col("__p")).alias("form"), "skeleton")
    return odd.join(found, odd[value].eqNullSafe(found["__v"])).drop("__v")


def spelling_groups(values: DataFrame, value: str = "value") -> DataFrame:
    """One row per skeleton: number of rows, of distinct originals, and the form most rows agree on.

    Rows are counted per original before the shuffle by skeleton, so that a value
    repeated in a third of all rows is one row of that shuffle. Ties go to the
    smaller form. Null values form no group.
    """
    counted = values.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    per_form = (
        consistent_values(counted)
        .groupBy("skeleton", "form")
        .agg(F.sum("n").alias("n"), F.count("*").alias("spellings"), F.sum(F.when(F.col("deviates"), F.col("n")).otherwise(0)).alias("n_deviating"))
    )
    return (
        per_form.groupBy("skeleton")
        .agg(
            F.min_by("form", F.struct(-F.col("n"), F.col("form"))).alias("form"),
            F.sum("n").alias("n_rows"),
            F.sum("spellings").alias("n_spellings"),
            F.sum("n_deviating").alias("n_deviating"),
        )
    )

"""Several values packed in one field: the cheapest dialect by description length, then one value per row."""

from __future__ import annotations

import os.path
import re
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeweave.session import cut

# Delimiters by name. A plain slash counts only beside a blank, so that 24/7 stays whole.
DELIMITERS = {
    "newline": r"\r\n|\n|\r",
    "tab": r"\t",
    "bars": r"\|\|",
    "bar": r"(?<!\|)\|(?!\|)",
    "wide bar": "｜",
    "semicolon": ";",
    "wide semicolon": "；",
    "slash": r"(?<=\s)/|/(?=\s)",
    "wide slash": "／",
    "comma": ",",
    "wide comma": "，",
    "stop": "、",
}
#: A field that matches none of these holds one value at most.
ANY_DELIMITER = r"[\r\n\t|｜;；／,，、]|\s/|/\s|^\s*[\[{]"
QUOTES = {'"': '"', "'": "'", "“": "”", "„": "“", "«": "»", "「": "」", "『": "』"}
WRAPS = {"[": "]", "{": "}"}
_COORDINATES = re.compile(r"[+-]?\d{1,3}\.\d+\s*[,，]\s*[+-]?\d{1,3}\.\d+")
_COMMAS = {"comma", "wide comma"}
_SOME = re.compile(r"[^\s|｜;；/／,，、]")

# Code lengths in bits.
BITS_PER_CHARACTER = 1.2
BITS_PER_VALUE = 2.0
BITS_NOVEL = 8.0
BITS_PER_SIGN = 3.0
BITS_PER_DELIMITER = 12.0
BITS_UNSPLIT = 25.0  # for a delimiter, commas and slashes apart, inside a new value

_ITEMS = T.ArrayType(T.StringType())
_PARSES = T.ArrayType(T.StructType([T.StructField("dialect", T.StringType()), T.StructField("items", _ITEMS)]))


def unquote(value: str) -> str:
    """The value without white space around it and without quotation marks that enclose the whole of it."""
    value = value.strip()
    if len(value) >= 2 and value[0] in QUOTES and value[-1] == QUOTES[value[0]]:
        close, inner = value[-1], value[1:-1]
        rest = inner.replace("\\\\", "").replace("\\" + close, "").replace(close * 2, "")
        if close not in rest and (value[0] == close or value[0] not in rest):
            value = inner.replace("\\\\", "\0").replace("\\" + close, close).replace("\0", "\\").replace(close * 2, close).strip()
    return value


_BEFORE_VALUE = frozenset("\r\n\t|｜;；/／,，、[{")
_AFTER_VALUE = re.compile(r"\s*($|[\r\n\t|｜;；／,，、\]}]|/)")


def _opens(text: str, at: int) -> bool:
    """Whether a value begins here: only blanks or a delimiter stand before."""
    at -= 1
    while at >= 0 and text[at].isspace() and text[at] not in _BEFORE_VALUE:
        at -= 1
    return at < 0 or text[at] in _BEFORE_VALUE


def _closing(text: str, i: int) -> int:
    """Where the quotation opened at i ends; the length of the text if it doesn't."""
    close, j, n = QUOTES[text[i]], i + 1, len(text)
    while j < n:
        if text[j] == "\\":
            j += 2
        elif text[j] == close and text[j + 1 : j + 2] == close == text[i]:
            j += 2
        elif text[j] == close:
            return j
        else:
            j += 1
    return n


def _masked(text: str) -> str:
    """The text with quoted values and bracketed additions blotted out, in which nothing delimits."""
    out, i, n = [], 0, len(text)
    while i < n:
        ch, j = text[i], -1
        if ch in QUOTES and _opens(text, i):
            j = _closing(text, i)
            if j >= n or not _AFTER_VALUE.match(text, j + 1):
                j = -1
        elif ch in "(（":
            j = text.find(")" if ch == "(" else "）", i)
        if j > 0:
            out.append("\0" * (j + 1 - i))
            i = j + 1
        else:
            out.append(ch)
            i += 1
    return "".join(out)


def _pieces(text: str, masked: str, pattern: re.Pattern) -> list[str]:
    out, last = [], 0
    for m in pattern.finditer(masked):
        out.append(text[last : m.start()])
        last = m.end()
    return [*out, text[last:]]


def _quoted(piece: str) -> bool:
    return piece.strip() == "" or unquote(piece) != piece.strip()


def parses(text: str, quoted_commas_only: bool) -> list[tuple[str, list[str]]]:
    """Every distinct reading of the field, as (dialect, values); a list in brackets has one reading.

    Readings join any of the delimiters present.
    """
    body, listed = text.strip(), False
    if len(body) >= 2 and body[0] in WRAPS and body[-1] == WRAPS[body[0]]:
        body, listed = body[1:-1], True
    if not _SOME.search(body):
        return []
    masked = _masked(body)
    paired = _COORDINATES.sub(lambda m: "\0" * len(m.group()), masked)
    present = [name for name, p in DELIMITERS.items() if re.search(p, paired)]
    if listed and "\0" in masked and present in ([], ["comma"]):
        return [("list", [v for v in map(unquote, _pieces(body, paired, re.compile(","))) if v])]
    found: dict[tuple[str, ...], str] = {}
    if (whole := unquote(body)) and not (listed and present):
        found[(whole,)] = "one"
    for size in range(1, len(present) + 1):
        for names in combinations(present, size):
            pieces = _pieces(body, paired, re.compile("|".join(DELIMITERS[n] for n in names)))
            if quoted_commas_only and _COMMAS & set(names) and not all(map(_quoted, pieces)):
                continue
            if values := [v for v in map(unquote, pieces) if v]:
                found.setdefault(tuple(values), "+".join(names))
    return [(name, list(v)) for v, name in found.items()]


@F.pandas_udf(_PARSES)
def _parse(texts: pd.Series, quoted_only: pd.Series) -> pd.Series:
    return pd.Series([[{"dialect": d, "items": v} for d, v in parses(t, bool(q))] for t, q in zip(texts, quoted_only)], dtype=object)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _copied(items: pd.Series) -> pd.Series:
    """For each value of a reading, how many of its characters begin a value of that reading which is no longer.

    Sorted, the value that shares most with one stands next to it, so that a field
    of many values costs no more than its sorting.
    """
    out = []
    for values in items:
        values = list(values)
        order = sorted(range(len(values)), key=lambda i: (values[i], i))
        row = [0] * len(values)
        for x, y in zip(order, order[1:]):
            row[y] = max(row[y], len(os.path.commonprefix([values[x], values[y]])))
        out.append(row)
    return pd.Series(out, dtype=object)


def _shape(value: Column) -> Column:
    words = F.regexp_replace(value, r"[\p{L}\p{M}][\p{L}\p{M}'’.-]*(?: +[\p{L}\p{M}][\p{L}\p{M}'’.-]*)*", "A")
    return F.regexp_replace(F.regexp_replace(words, r"\p{Nd}+", "9"), r"\s+", " ")


def split_packed(fields: DataFrame, keys: list[str], text: str = "text", quoted_commas_only: Column | None = None) -> DataFrame:
    """One row per value of each field: the keys, `n_items`, `item_no` from 1, `item_text` and the `dialect` chosen.

    Each field is read in every way its delimiters and quotation marks allow. The
    reading with the least description length wins: a value costs the bits of its
    frequency among all values that are certain (fields with one reading only), or,
    when it is new, the bits of its shape's frequency (of the shape itself, if that
    is new too) and of those characters that don't repeat another value of the field. Equal costs go to fewer values,
    then to the dialect's name. All fields count in the statistics, each text once.

    White space around a value, quotation marks around a whole value and brackets
    around a whole list are dropped; escaped or doubled quotes inside stand for
    one. Empty pieces are no values; null, empty and blank fields give no row.
    Where `quoted_commas_only` holds, commas separate only values that are all
    quoted. Coordinate pairs and bracketed additions stay whole. Repeated rows are
    each split; columns of `fields` besides keys and text are ignored.
    """
    flag = F.lit(False) if quoted_commas_only is None else quoted_commas_only
    rows = fields.select(*keys, F.col(text).alias("__text"), F.coalesce(flag, F.lit(False)).alias("__flag"))
    rows = rows.where(F.col("__text").isNotNull() & F.col("__text").rlike(r"(?U)\S"))
    rows = rows.withColumn("__key", F.md5(F.concat(F.col("__flag").cast("string"), F.col("__text"))))
    texts = rows.groupBy("__key").agg(F.first("__text").alias("__text"), F.first("__flag").alias("__flag"))
    simple = ~F.col("__text").rlike("(?U)" + ANY_DELIMITER) & ~F.col("__text").rlike("[\"'“”„«»「」『』]")
    one = F.array(F.struct(F.lit("one").alias("dialect"), F.array(F.regexp_replace("__text", r"(?U)^\s+|\s+$", "")).alias("items")))
    parsed = cut(texts.select("__key", F.when(simple, one).otherwise(_parse(F.when(~simple, F.col("__text")).otherwise(F.lit("")), F.col("__flag"))).alias("readings")))

    sure = parsed.where(F.size("readings") == 1).select("__key", F.col("readings")[0].alias("r"))
    known = sure.select(F.explode("r.items").alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    shapes = known.groupBy(_shape(F.col("value")).alias("shape")).agg(F.sum("n").alias("n_shape"))
    every = F.lit(float(known.agg(F.sum("n")).first()[0] or 0) + 2)  # one number

    open_ = parsed.where(F.size("readings") > 1).select("__key", F.explode("readings").alias("r")).select("__key", "r.dialect", "r.items")
    values = open_.select("__key", "dialect", F.explode(F.arrays_zip("items", _copied("items").alias("copied"))).alias("z"), F.size("items").alias("size"))
    values = values.select("__key", "dialect", "size", F.col("z.items").alias("value"), F.col("z.copied").alias("copied"))
    values = values.withColumn("shape", _shape(F.col("value")))
    log2 = lambda n: F.log2(n.cast("double"))
    coded = values.join(known, "value", "left").join(shapes, "shape", "left")
    of_known = F.when(F.col("n").isNotNull(), log2(every) - log2(F.col("n")))
    of_shape = log2(every) - log2(F.coalesce("n_shape", F.lit(0)) + 0.5)
    of_shape = of_shape + F.when(F.col("n_shape").isNull(), BITS_PER_SIGN * F.length("shape")).otherwise(0)
    of_new = BITS_NOVEL + of_shape + BITS_PER_CHARACTER * (F.length("value") - F.col("copied"))
    of_new = of_new + BITS_UNSPLIT * F.regexp_count("value", F.lit(r"[\r\n\t|｜;；、]"))
    bits = F.least(of_known, of_new) + BITS_PER_VALUE
    cheapest = (
        coded.groupBy("__key", "dialect", "size").agg((F.sum(bits) + BITS_PER_DELIMITER * F.size(F.split("dialect", r"\+"))).alias("bits"))
        .groupBy("__key").agg(F.min_by("dialect", F.struct(F.round("bits", 6), "size", "dialect")).alias("dialect"))
    )
    settled = open_.join(cheapest, ["__key", "dialect"]).select("__key", "dialect", "items")
    decided = sure.select("__key", "r.dialect", "r.items").unionByName(settled)
    out = rows.select(*keys, "__key").join(decided, "__key")
    return out.select(*keys, "dialect", F.size("items").alias("n_items"), F.posexplode("items").alias("__pos", "item_text")).select(
        *keys, "dialect", "n_items", (F.col("__pos") + 1).cast("int").alias("item_no"), "item_text"
    )


def packed_values(guide_rows: DataFrame, target_failures: DataFrame) -> DataFrame:
    """All values of the fields `name` and `attempted_queries`, each on a row of its own."""
    fields = guide_rows.select(F.lit("name").alias("field_name"), F.col("row_id").alias("rec_id"), F.col("name").alias("text")).unionByName(
        target_failures.select(F.lit("attempted_queries").alias("field_name"), F.col("failure_id").alias("rec_id"), F.col("attempted_queries").alias("text"))
    )
    return split_packed(fields, ["field_name", "rec_id"], quoted_commas_only=F.col("field_name") == "name")

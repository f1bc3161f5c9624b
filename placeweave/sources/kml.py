"""Placemarks of KML and KMZ files."""

from __future__ import annotations

import io
import re
import zipfile
from html import unescape
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeweave.functions.geo import kml_point
from placeweave.functions.text import derived_aliases, text

# Keys of extended data that hold an address or a city.
ADDRESS_KEYS = ("address", "addr", "formattedaddress", "地址")
CITY_KEYS = ("city", "town", "municipality", "locality", "地區")
_ENTRY = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
PLACEMARK = T.ArrayType(
    T.StructType(
        [T.StructField("document", T.StringType()), T.StructField("ord", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("description", T.StringType()), T.StructField("address", T.StringType()), T.StructField("point", T.StringType()), T.StructField("data", T.ArrayType(_ENTRY)), T.StructField("fields", T.ArrayType(_ENTRY))]
    )
)


def _local(element) -> str:
    return element.tag.rpartition("}")[2] if isinstance(element.tag, str) else ""


def _below(element, name: str):
    return (e for e in element.iter() if e is not element and _local(e) == name)


def _text_of(element) -> str:
    return "".join(element.itertext()).strip() if element is not None else ""


def description_fields(description: str) -> list[tuple[str, str]]:
    """`key: value` lines of a description, of its block elements or its lines; later values of a key replace earlier ones."""
    lines = re.split(r"(?i)<\s*(?:br|/?p|/?div|/?li|/?tr)\b[^>]*>|\n", description)
    out: dict[str, str] = {}
    for line in lines:
        plain = " ".join(unescape(re.sub(r"<[^>]*>", " ", line)).split())
        for colon in (":", "："):
            key, found, value = plain.partition(colon)
            if found:
                if key.strip() and value.strip():
                    out[key.strip()] = value.strip()
                break
    return list(out.items())


def _kml_text(content: bytes) -> str:
    if content[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = sorted(n for n in z.namelist() if n.lower().endswith(".kml"))
            main = [n for n in names if n.rpartition("/")[2].lower() == "doc.kml"]
            if not main and len(names) != 1:
                raise ValueError("the archive must hold doc.kml or a single .kml file")
            content = z.read((main or names)[0])
    return content.decode("utf-8-sig")


def read_placemarks(content: bytes) -> list[dict]:
    """All placemarks of a file, in order, namespaces apart."""
    root = ElementTree.fromstring(_kml_text(content))
    title = next((_text_of(c) for d in root.iter() if _local(d) == "Document" for c in d if _local(c) == "name"), "")
    out = []
    for i, mark in enumerate(e for e in root.iter() if _local(e) == "Placemark"):
        child = lambda n, mark=mark: _text_of(next((c for c in mark if _local(c) == n), None))
        data = [(d.get("name") or "", _text_of(next(_below(d, "value"), None))) for d in _below(mark, "Data")]
        data += [(d.get("name") or "", _text_of(d)) for d in _below(mark, "SimpleData")]
        merged: dict[str, str] = {}
        for k, v in data:
            merged["".join(ch for ch in k.casefold() if ch.isalnum())] = v
        point = next(_below(mark, "Point"), None)
        at = None if point is None else _text_of(next(_below(point, "coordinates"), None))
        entry = lambda items: [{"key": k, "value": v} for k, v in items]
        out.append({"document": title, "ord": i, "name": child("name"), "description": child("description"), "address": child("address"), "point": at, "data": entry(merged.items()), "fields": entry(description_fields(child("description")))})
    return out


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """One row per placemark of the KML and KMZ files under the path, with the file's path."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return placemarks(files)


def placemarks(files: DataFrame) -> DataFrame:
    """Placemarks of files given as `path` and `content`."""
    udf = F.pandas_udf(lambda s: pd.Series([read_placemarks(bytes(v)) if v is not None else [] for v in s], dtype=object), PLACEMARK)
    return files.select("path", F.explode(udf("content")).alias("m")).select("path", "m.*")


def place_rows(marks: DataFrame) -> DataFrame:
    """Placemarks as rows with `status`: ok, skipped (no name, or a point that says nothing), unsupported (neither point nor address)."""
    data = F.map_from_entries("data")
    pick = lambda keys: F.coalesce(F.get(F.transform(F.filter("data", lambda e: e["key"].isin(*keys) & (e["value"] != "")), lambda e: e["value"]), F.lit(0)), F.lit(""))
    point = kml_point("point")
    address = F.coalesce(F.nullif(pick(ADDRESS_KEYS), F.lit("")), F.nullif(F.trim(text("address")), F.lit("")), F.when(point.isNotNull(), F.concat_ws(",", point["lat"].cast("string"), point["lon"].cast("string"))), F.lit(""))
    thin = point.isNull() & (pick(ADDRESS_KEYS) == "") & (F.trim(text("address")) == "")
    status = F.when(F.trim(text("name")) == "", "skipped").when(thin, F.when(F.col("point").isNotNull(), "skipped").otherwise("unsupported")).otherwise("ok")
    return marks.select(
        "path", "document", "ord", F.trim(text("name")).alias("name"), "description", F.map_from_entries("fields").alias("description_fields"), data.alias("extended"),
        address.alias("address"), pick(CITY_KEYS).alias("city"), derived_aliases("name").alias("aliases"), point["lat"].alias("lat"), point["lon"].alias("lon"), status.alias("status"),
    )


def scope(override: Column, document: Column, path: Column) -> Column:
    """A file's scope: the override, the document's name, the file's stem, else a default."""
    stem = F.regexp_extract(path, r"([^/]+?)(?:\.[A-Za-z]+)?$", 1)
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in (override, document, stem)), F.lit("places"))

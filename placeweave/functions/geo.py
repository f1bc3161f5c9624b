"""Coordinates and address hints as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placeweave.functions.text import text

_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def number(c: Column) -> Column:
    """The text as a number, null unless it is written as one."""
    v = F.trim(c)
    return F.when(v.rlike(_NUMBER), v.try_cast("double"))


def _inside(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180)


def kml_point(c: Column | str) -> Column:
    """struct(lat, lon) of the first `lon,lat[,alt]` tuple; null where it is malformed or out of range."""
    parts = F.split(F.split(F.trim(text(c)), r"(?U)\s+")[0], ",")
    lon, lat = number(F.get(parts, F.lit(0))), number(F.get(parts, F.lit(1)))
    return F.when(_inside(lat, lon), F.struct(lat.alias("lat"), lon.alias("lon")))


def url_point(c: Column | str) -> Column:
    """struct(lat, lon) of a map link's `q` parameter; both must be numbers, of any range."""
    q = F.url_decode(F.try_parse_url(text(c), F.lit("QUERY"), F.lit("q")))
    parts = F.split(q, ",")
    lat, lon = number(F.get(parts, F.lit(0))), number(F.get(parts, F.lit(1)))
    return F.when((F.size(parts) == 2) & lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))


def coordinate_query(lat: Column, lon: Column) -> Column:
    """`lat,lon` with up to seven decimals and no trailing zeros; empty where one is missing or out of range."""
    plain = lambda v: F.regexp_replace(F.regexp_replace(F.format_string("%.7f", v), "0+$", ""), r"\.$", "")
    return F.when(_inside(lat, lon), F.concat_ws(",", plain(lat), plain(lon))).otherwise(F.lit(""))


# Marks of counties and cities, of districts, of streets; numerals of sections.
_COUNTY, _DISTRICT, _STREETS, _NUMERALS = "縣市", "區鎮鄉", ("大道", "路", "街"), "一二三四五六七八九十"
_HAN = r"[\x{4e00}-\x{9fff}]"


def _named(marks: str) -> str:
    """A name of up to four characters and its mark."""
    return f"{_HAN}{{1,4}}[{marks}]"


#: From the most telling: a district with its county or city, a district, a city at the beginning.
AREAS = (f"([臺台]?{_named(_COUNTY)}{_named(_DISTRICT + '市')})", f"({_named(_DISTRICT)})", f"^({_named('市')})")
#: A street with its section, the house number with a branch of it, and the floor.
STREET = rf"((?:{_HAN}|\d){{1,12}}(?:{'|'.join(_STREETS)})(?:[{_NUMERALS}\d]+段)?\d+(?:之\d+)?號(?:\d+樓)?)"


def area_hint(c: Column | str) -> Column:
    """The district an address names, by the first pattern that finds one; empty if none does."""
    return F.coalesce(*(F.nullif(F.regexp_extract(text(c), p, 1), F.lit("")) for p in AREAS), F.lit(""))


def street_hint(c: Column | str) -> Column:
    """Street and house number after the district."""
    area, v = area_hint(c), text(c)
    rest = F.when((area != "") & (F.instr(v, area) > 0), F.substr(v, F.instr(v, area) + F.length(area))).otherwise(v)
    return F.regexp_extract(rest, STREET, 1)

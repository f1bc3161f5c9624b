"""Query attempts, notes, list names and failure records as texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.functions.geo import area_hint, coordinate_query, street_hint
from placeweave.functions.text import collapse, distinct_by_key, text


def _joined(*parts: Column) -> Column:
    """The parts that aren't blank, with blanks between; null where the first is blank."""
    kept = [F.nullif(F.trim(p), F.lit("")) for p in parts]
    return F.when(kept[0].isNotNull(), F.concat_ws(" ", *kept))


def query_attempts(name: Column, local: Column, aliases: Column, city: Column, address: Column, cuisine: Column, lat: Column, lon: Column) -> Column:
    """The texts to search a place by, most telling first, each once however it is written.

    The local name, the name and each alias, with the district, the street, the city
    and alone, then the coordinates; the address only where there is no name.
    """
    name, local, city, address, cuisine = (F.trim(text(c)) for c in (name, local, city, address, cuisine))
    area, street = area_hint(address), street_hint(address)
    other = F.when(local != name, local).otherwise(F.lit(""))
    hints = lambda v: [_joined(v, h) for h in (area, street, city)] + [_joined(v)]
    of_alias = F.flatten(F.transform(aliases, lambda a: F.array(*[F.when(F.trim(a) != "", F.concat_ws(" ", F.trim(a), F.nullif(h, F.lit("")))) for h in (area, street, city)], F.nullif(F.trim(a), F.lit("")))))
    nameless = (name == "") & (local == "") & (F.size(aliases) <= 0)
    dishes = lambda v: [F.when((v != "") & (cuisine != ""), F.concat_ws(" ", v, cuisine, F.nullif(h, F.lit("")))) for h in (area, city)]
    every = F.concat(F.array(*hints(other), *dishes(other), *hints(name)), F.coalesce(of_alias, F.array().cast("array<string>")), F.array(F.nullif(coordinate_query(lat, lon), F.lit("")), F.when(nameless, F.nullif(address, F.lit(""))), *dishes(name)))
    return distinct_by_key(F.filter(every, lambda q: q.isNotNull() & (q != "")), lambda q: F.lower(q))


def guide_note(year: Column, level: Column, cuisine: Column, updated: Column, description: Column) -> Column:
    """`year | level | cuisine | updated date`, then the description on a line of its own; blanks are left out."""
    part = lambda c: F.nullif(collapse(c), F.lit(""))
    head = F.concat_ws(" | ", part(year), part(level), part(cuisine), F.when(part(updated).isNotNull(), F.concat(F.lit("updated "), part(updated))))
    return F.concat_ws("\n", F.nullif(head, F.lit("")), part(description))


def raw_note(fields: Column) -> Column:
    """`key: value` pairs of a map in order, with bars between."""
    return F.array_join(F.transform(F.filter(F.map_entries(fields), lambda e: (collapse(e["key"]) != "") & (collapse(e["value"]) != "")), lambda e: F.concat(collapse(e["key"]), F.lit(": "), F.replace(collapse(e["value"]), F.lit("|"), F.lit("｜")))), " | ")


_FIELD = re.compile(r"\{\{|\}\}|\{([^{}]+)\}")


def template_note(fields: Column, template: str) -> Column:
    """The template with `{field}` filled from a map; a segment between bars that misses a field goes whole; `{{` and `}}` are braces."""
    segments = []
    for segment in template.split("|"):
        parts, last = [], 0
        for m in _FIELD.finditer(segment):
            parts.append(F.lit(segment[last : m.start()]))
            if m.group(1) is None:
                parts.append(F.lit(m.group()[0]))
            else:
                value = F.replace(collapse(F.try_element_at(fields, F.lit(m.group(1).strip()))), F.lit("|"), F.lit("｜"))
                parts.append(F.nullif(value, F.lit("")))
            last = m.end()
        parts.append(F.lit(segment[last:]))
        # concat is null as soon as one field is.
        segments.append(F.nullif(F.trim(F.concat(*parts)), F.lit("")))
    return F.concat_ws(" | ", *segments)


def list_name(template: str, prefix: str, scope: Column, bucket: Column, labels: dict[str, str], badges: dict[str, str]) -> Column:
    """The name of a bucket's list; placeholders {prefix} {scope} {level} {label} {badge} {slug}."""
    look = lambda table: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv]), bucket), bucket)
    values = {"prefix": F.lit(prefix), "scope": scope, "level": bucket, "slug": bucket, "label": look(labels), "badge": look(badges)}
    parts, last = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        if m.group(1) not in values:
            raise ValueError(f"unknown placeholder: {m.group(1)}")
        parts += [F.lit(template[last : m.start()]), values[m.group(1)]]
        last = m.end()
    return collapse(F.concat(*parts, F.lit(template[last:])))


def failure_records(failures: DataFrame, columns: list[str]) -> DataFrame:
    """Each failure as one JSON text, null fields left out."""
    return failures.select(F.to_json(F.struct(*columns)).alias("value"))


# Fields of a bowl guide, in the order a note has them.
BOWL_COUNTS = ("總得碗數", "總得晚數")
BOWL_FIELDS = ("得獎菜色", "菜系", "推薦評審", "地址", "電話")


def bowls_note(fields: Column) -> Column:
    """The bowls a place won, its dish, cuisine, jurors, address and telephone, with bars between; what is missing is left out."""
    look = lambda k: F.nullif(F.replace(collapse(F.try_element_at(fields, F.lit(k))), F.lit("|"), F.lit("｜")), F.lit(""))
    return F.concat_ws(" | ", F.concat(F.coalesce(*map(look, BOWL_COUNTS)), F.lit("碗")), *map(look, BOWL_FIELDS))


def debug_line(title: str, fields: dict[str, Column]) -> Column:
    """`Title(name='value', …)`: texts quoted, lists joined, `<none>` for what is missing."""
    shown = [F.concat(F.lit(f"{n}="), F.coalesce(v, F.lit("<none>"))) for n, v in fields.items()]
    return F.concat(F.lit(f"{title}("), F.concat_ws(", ", *shown), F.lit(")"))


def candidate_line(candidate: str) -> Column:
    quoted = lambda n: F.concat(F.lit("'"), F.replace(text(F.col(f"{candidate}.{n}")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    return debug_line("Candidate", {n: quoted(n) for n in ("name", "address", "category", "subtitle", "located_in")})


def assessment_line(evidence: str, assessment: str) -> Column:
    e = lambda n: F.format_string("%.1f", F.col(f"{evidence}.{n}"))
    listed = lambda n: F.nullif(F.array_join(F.col(f"{evidence}.{n}"), ", "), F.lit(""))
    numbers = {n: e(n) for n in ("name", "alias", "address", "city", "house", "category", "ngram")}
    return debug_line("Signals", {"strength": F.col(f"{assessment}.strength"), "score": F.format_string("%.1f", F.col(f"{assessment}.score")), **numbers, "risks": listed("risks"), "location_overlap": listed("shared_places")})


def rejected_record(query: Column, candidate: str, evidence: str, assessment: str) -> Column:
    """A refused candidate as part of a failure's record: the query, its fields, the decision and what it rests on."""
    fields = [text(F.col(f"{candidate}.{n}")).alias(n) for n in ("name", "address", "category", "subtitle", "located_in")]
    return F.struct(query.alias("query"), *fields, F.col(f"{assessment}.strength").alias("strength"), F.round(F.col(f"{assessment}.score"), 1).alias("match_score"), F.col(f"{evidence}.risks").alias("risks"), F.col(f"{evidence}.shared_places").alias("location_overlap"))

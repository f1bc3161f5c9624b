"""The same postal address written differently: parsing, mined rewrites, and records at one location."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeweave.llm.names import edits
from placeweave.llm.text import folded
from placeweave.session import cut, freed, released, spread

# Words for quarters of a city, and those of floors, units and halls.
QUARTERS = ("uplands", "harbour", "riverside", "downtown", "mill district", "old town", "market quarter", "north end", "south end", "east side", "west side")
_UNIT = re.compile(
    r"\b(?:(?:fl|floor|level|suite|unit|room|rm|hall|apt|local|piso|planta|etage|stock|og)\b\.? ?#?(?:\d{1,3}[a-z]?|[a-z])\b|\d{1,2}(?:st|nd|rd|th) (?:fl|floor)\b\.?|\d{1,2} ?[oa°]\.? (?:izq|dcha|der)\b\.?|bajos?\b|(?:ground|first|second|third) floor\b|eg\b|[1-9]f\b|b[12]\b)"
)
# The words without one of which _UNIT finds nothing.
_UNIT_WORDS = frozenset("fl floor level suite unit room rm hall apt local piso planta etage stock og izq dcha der bajo bajos eg 1f 2f 3f 4f 5f 6f 7f 8f 9f b1 b2".split())
# Kinds of street in full; their short forms are mined. Where they stand tells the language.
BEFORE = frozenset({"rue", "avenue", "boulevard", "place", "quai", "impasse", "calle", "avenida", "plaza", "paseo", "camino"})
AFTER = frozenset({"street", "road", "lane", "avenue", "boulevard", "square", "terrace"})
GLUED = {"strasse", "gasse", "weg", "allee", "platz"}
FULL_KINDS = BEFORE | AFTER | GLUED
_GLUED = re.compile(r"(?<=[a-z]{3})(strasse|gasse|allee|platz|weg)$|(?<=[a-z]{3})(str|g|w|al|pl)\.$|(?<=[a-z]{3})(str|al)$")
PARTICLES = {"de", "la", "las", "los", "le", "les", "des", "du", "del", "d", "l", "the", "of", "y"}
_PARTICLES = re.compile(r"\b(?:de|la|las|los|le|les|des|du|del) (?=[a-z])")
_MARKS = {"no", "nr", "n", "num", "number"}
_NUMBER = re.compile(r"\b(\d{1,4})(?: ?([a-z])\b(?![.'/]))?(?! ?(?:st|nd|rd|th)\b)")
_BEFORE_NUMBER = re.compile(r"(?:\b(?:no|nr|n)\b[.°]? ?|n°|#)? ?$")
_PARTS = re.compile(r"[,;()]| - ")
_SECTION = re.compile(r"\b(?:sec|section)\b\.? ?(\d{1,2})\b")
_THREE = re.compile(r"\b(\d{1,2}) ?-? ?(?:chome)?[- ]{1,2}(\d{1,3}) ?- ?(\d{1,3})\b")
_POST5 = re.compile(r"\b(?:[a-z]-)?(\d{5})\b")
_POST7 = re.compile(r"〒? ?\b(\d{3}-\d{4})(?!\d)")
_POST3 = re.compile(r"(?:^|[,(] ?|市 ?\()(\d{3})(?=\)|$|,| ?[㐀-鿿])")
_DISTRICT = re.compile(r"\b[a-z]+[ -](?:ku|district)\b")
_DIGIT = re.compile("[0-9]")
_WORDS = re.compile(r"[a-z]+\.?")
_WORD = re.compile(r"\w+")
_CJK = re.compile(r"(?![號号])[㐀-鿿]")
_SPANISH = re.compile(r"\b(?:del|los|las|calle|avenida|avda|plaza|pza|paseo|camino|cno|cl|izq|bajo)\b")
_FRENCH = re.compile(r"\b(?:des|du|les|rue|quai|impasse|imp|boul|boulevard|bd|place|avenue)\b")
_ZH = re.compile(r"([㐀-鿿]{2,4}?)(街|路|大道)(?:([一二三四五六七八九十\d]{1,2})段)? ?(\d{1,4}) ?-?([a-z])? ?[號号]")
_JA = re.compile(r"([㐀-鿿]{2,4}) ?(\d{1,2})(?:丁目| ?- ?)(\d{1,3})(?:番地?|番| ?- ?)(\d{1,3})号?")
_NUMERALS = {c: str(i) for i, c in enumerate("一二三四五六七八九十", 1)}
_KIND_ZH = {"街": "street", "路": "road", "大道": "boulevard"}
_UNZH = str.maketrans("国楼宝云岛长红桥义兴湾岭门华兰龙园东乐区号圧竜沢浜亀", "國樓寶雲島長紅橋義興灣嶺門華蘭龍園東樂區號壓竜沢浜亀")

PARSED = T.StructType([T.StructField(n, T.StringType()) for n in ("city", "post", "num", "sect", "kind", "stem", "lang")])


def alternation(words: Iterable[str]) -> str:
    """A pattern for any of the words, the longest first, by their common beginnings, so that a place where none begins is left at once."""
    tree: dict = {}
    for w in words:
        at = tree
        for ch in w:
            at = at.setdefault(ch, {})
        at[""] = {}

    def pattern(at: dict) -> str:
        parts = [re.escape(ch) + pattern(below) for ch, below in sorted(at.items(), reverse=True) if ch]
        if not parts:
            return ""
        return f"(?:{'|'.join(parts)})" + ("?" if "" in at else "") if len(parts) > 1 or "" in at else parts[0]

    return pattern(tree) or "(?!)"


def first_words(names: Iterable[str]) -> frozenset[str] | None:
    """The words one of which a text has where it has one of the names between ends of words; None where a name doesn't begin with a word."""
    found = [_WORD.match(n) for n in names]
    return frozenset(m.group() for m in found) if all(found) else None


class Places:
    """Names an address is read by: `cities` maps folded names, Latin and local, to one name each; `countries` folded names to the language of their addresses, where that has readings; `readings` characters to Latin letters by language."""

    def __init__(self, cities: dict[str, str], countries: dict[str, str | None], readings: dict[str, dict[str, str]]) -> None:
        self.cities, self.countries, self.readings = cities, countries, readings
        #: Names of both a city and its country say little.
        self.doubtful = sorted(set(cities) & set(countries))


class Parser:
    """Takes an address apart."""

    def __init__(self, places: Places) -> None:
        self.cities, self.readings = places.cities, places.readings
        latin = [c for c in self.cities if c.isascii() and c not in places.doubtful]
        self.latin = re.compile(rf"\b({alternation(latin)})(?: city)?\b")
        self.local = re.compile(f"({alternation(c for c in self.cities if not c.isascii())})市?")
        self.noise = re.compile(rf"\b(?:{alternation([*places.countries, *QUARTERS])})\b")
        self.city_words, self.noise_words = first_words(latin), first_words([*places.countries, *QUARTERS])
        self.doubtful = re.compile(rf"\b({alternation(places.doubtful)})\b")
        self.doubtful_names = places.doubtful
        self.tongues = [(name, lang) for name, lang in places.countries.items() if lang]
        #: Streets read before, by what is left of an address once its city, code and number are out.
        self.streets: dict[tuple, tuple | None] = {}

    def __call__(self, address: str) -> tuple | None:
        s = folded.__wrapped__(address)
        got = None
        if _DIGIT.search(s):
            got = self._cjk(s) if not s.isascii() and _CJK.search(s) else self._latin(s)
        return got or (self.city_in(s), None, None, None, None, None, None)

    def city_in(self, s: str) -> str | None:
        """The city a folded text names last, if any."""
        found = self._last_city(s, _WORD.findall(s)) or self.local.search(s)
        return self.cities[found.group(1)] if found and found.group(1) else None

    def _last_city(self, s: str, words: list[str]) -> re.Match | None:
        """The last of the Latin names in a text of these words, looked for only where the first word of a name stands."""
        met = self.city_words.intersection(words) if self.city_words is not None else ()
        last = None
        if len(met) == 1:
            (word,) = met
            at = s.find(word)
            while at >= 0:
                m = self.latin.match(s, at)
                last = m or last
                at = s.find(word, m.end() if m else at + 1)
        elif met or self.city_words is None:
            for last in self.latin.finditer(s):
                pass
        return last

    def _read(self, text: str, lang: str) -> str:
        table = self.readings.get(lang, {})
        return "".join(table.get(ch, ch) for ch in text)

    def _cjk(self, s: str) -> tuple | None:
        post = _POST7.search(s) if "-" in s else None
        lang = "ja" if post or re.search("丁目|番|区", s) else None
        code = post.group(1) if post else None
        if post:
            s = s[: post.start()] + " " + s[post.end() :]
        city = self.local.search(s)
        name = self.cities[city.group(1)] if city else None
        if city:
            s = s[: city.start()] + " " + s[city.end() :]
        if code is None and (p := _POST3.search(s.strip())):
            code, lang = p.group(1), "zh"
            s = s.replace(code, " ", 1)
        s = re.sub(r"^.*[區区](?=[㐀-鿿])", " ", s.strip(" ()〒"))
        if m := _ZH.search(s):
            street, kind, sect, num, letter = m.groups()
            return name, code, num + (letter or ""), _NUMERALS.get(sect, sect) if sect else "", kind and _KIND_ZH[kind], self._read(street.translate(_UNZH), "zh"), "zh"
        if m := _JA.search(s):
            town, a, b, c = m.groups()
            return name, code, f"{a}-{b}-{c}", "", None, self._read(town, "ja"), "ja"
        return None

    def _latin(self, s: str) -> tuple | None:
        code, lang = None, None
        if "-" in s and (m := _POST7.search(s)):
            code, lang = m.group(1), "ja"
            s = s[: m.start()] + "," + s[m.end() :]
        elif m := _POST5.search(s):
            code = m.group(1)
            s = s[: m.start()] + "," + s[m.end() :]
        # What is put in place of parts below never makes words that aren't among these.
        words = _WORD.findall(s)
        # A city's name may be that of a street as well: the last one stands.
        if name := self._last_city(s, words):
            if name.group(0).endswith(" city"):
                lang = "zh"
            s, name = s[: name.start()] + "," + s[name.end() :], self.cities[name.group(1)]
        elif m := self.doubtful.search(s):
            name = self.cities[m.group(1)]
        said = None
        for n, t in self.tongues:
            if n in s:
                said = t
                break
        lang = said or ("ja" if "chome" in s or "-ku" in s else lang)
        for doubtful in self.doubtful_names:
            if doubtful in s:
                s = self.doubtful.sub(",", s)
                break
        if self.noise_words is None or not self.noise_words.isdisjoint(words):
            s = self.noise.sub(",", s)
        if "ku" in s or "district" in s:
            s = _DISTRICT.sub(",", s)
        if not _UNIT_WORDS.isdisjoint(words):
            s = _UNIT.sub(",", s)
        sect = ""
        if "sec" in s and (m := _SECTION.search(s)):
            sect, lang = m.group(1), "zh"
            s = s[: m.start()] + "," + s[m.end() :]
        if "-" in s and (m := _THREE.search(s)):
            num, lang = "-".join(m.groups()), "ja"
            s = s[: m.start()] + "," + s[m.end() :]
        else:
            if lang == "zh" or "號" in s or "号" in s:
                s = s.replace("號", " ").replace("号", " ")
                lang = "zh"
            found = list(_NUMBER.finditer(s)) if lang == "zh" and code is None else [m] if (m := _NUMBER.search(s)) else []
            if len(found) > 1:
                for m in found:
                    if len(m.group(1)) == 3 and not m.group(2) and re.search(r"^[,\s]*$", s[m.end() :]):
                        code = m.group(1)
                        s = s[: m.start()] + ","
                        found.remove(m)
                        break
            if not found:
                return None
            m = found[0]
            num = str(int(m.group(1))) + (m.group(2) or "")
            start = m.start()
            if start < 2 or s[start - 1] in ".°#" or s[start - 1] == " " and s[start - 2] in " .°#orn":
                start = _BEFORE_NUMBER.search(s, max(0, start - 8), start).start()
            elif s[start - 1] == " ":
                start -= 1
            s = s[:start] + " , " + s[m.end() :]
        key = s.strip(" ,"), lang, code is None
        if key in self.streets:
            street = self.streets[key]
        else:
            if len(self.streets) > 200_000:
                self.streets.clear()
            self.streets[key] = street = self._street(*key)
        if street is None:
            return None
        kind, stem, lang = street
        return name, code, num, "" if lang == "ja" else sect, kind, stem, lang

    def _street(self, s: str, lang: str | None, uncoded: bool) -> tuple | None:
        """Kind and stem of the street in what is left of an address, and the language it shows."""
        particles = bool(_PARTICLES.search(s))
        best: list[str] = []
        longest = 0
        for part in _PARTS.split(s.replace("/", " ").replace("p.o", "po").replace("p.°", "po")):
            if len(part) <= longest:
                continue
            words = [w for w in _WORDS.findall(part) if w not in _MARKS and w.rstrip(".") not in _MARKS]
            words = [w for i, w in enumerate(words) if w not in PARTICLES or i and i == len(words) - 1]
            if (n := sum(map(len, words))) > longest:
                best, longest = words, n
        if not best:
            return None
        if lang == "ja":
            return None, "".join(w.rstrip(".") for w in best), "ja"
        if m := _GLUED.search(best[-1]):
            return (m.group(1) or m.group(2) or m.group(3)), "".join(best)[: -len(m.group(0))].replace(".", ""), "de"
        words = [w.rstrip(".") for w in best]
        if len(words) > 1 and (words[-1] in GLUED or words[-1] == "str" and lang is None and not uncoded and not particles and best[-1] == "str."):
            return "strasse" if words[-1] == "str" else words[-1], "".join(words[:-1]), "de"
        if particles or (len(words) > 1 and (words[0] in BEFORE or _short_of(words[0], BEFORE)) and words[-1] not in AFTER):
            romance = "es" if _SPANISH.search(s) else "fr" if _FRENCH.search(s) else "ro"
            if len(words) > 1 and (words[0] in BEFORE or _short_of(words[0], BEFORE)):
                return words[0], "".join(words[1:]), romance
            return None, "".join(words), romance
        if len(words) > 1 and (words[-1] in AFTER or _short_of(words[-1], AFTER)):
            return words[-1], "".join(words[:-1]), lang or "en"
        return None, "".join(words), lang or "en"


def shortens(short: str, word: str) -> bool:
    """Whether the token can be a short form of the word: its first letter and others of it in order."""
    if len(short) >= len(word) or not short or short[0] != word[0]:
        return False
    letters = iter(word)
    return all(ch in letters for ch in short)


@lru_cache(maxsize=1 << 16)
def _short_of(token: str, words: frozenset[str]) -> bool:
    return len(token) < 6 and any(shortens(token, w) for w in words) or len(token) > 3 and any(edits(token, w, 2) <= (1 if len(w) < 6 else 2) for w in words)


def misspells(typed: str, word: str) -> bool:
    """Whether the street's name can be a misspelling of the other: one edit in four letters, three at most."""
    if typed[:1] != word[:1] and typed[1:2] != word[1:2]:
        return False
    most = min(3, max(1, len(word) // 4))
    return edits(typed, word, most) <= most


def places_of(guide_rows: DataFrame, target_urls: DataFrame, char_readings: DataFrame) -> Places:
    """The cities of the catalogue and of the guide's own column, the catalogue's countries, and the characters' readings.

    They are lists of names, which grow with the cities of the world and not with the
    records; of the guide's column those names count that two rows have. A country
    whose cities' local names read as their Latin ones in a language is of that
    language.
    """
    readings: dict[str, dict[str, str]] = defaultdict(dict)
    for r in char_readings.orderBy("lang", "char_text", "reading").collect():
        if r["char_text"] and r["reading"]:
            readings[r["lang"]].setdefault(folded(r["char_text"]), folded(r["reading"]))
    cities: dict[str, str] = {}
    countries: dict[str, Counter] = defaultdict(Counter)
    for r in target_urls.select("label", "label_local", "country").where(F.col("label").isNotNull()).distinct().orderBy("label", "label_local", "country").collect():
        label, local = folded(r["label"]), folded(r["label_local"] or "")
        cities[label] = label
        if local:
            cities[local] = label
        if r["country"]:
            read = [lang for lang, table in readings.items() if not local.isascii() and "".join(table.get(ch, ch) for ch in local) == label]
            countries[folded(r["country"])].update(read)
    for r in guide_rows.select("city").where(F.col("city").isNotNull()).groupBy("city").count().where("count > 1").select("city").orderBy("city").toLocalIterator():
        if (c := folded(r["city"])) and len(c) > 2:
            cities.setdefault(c, c)
    return Places(cities, {c: max(n, key=lambda x: (n[x], x)) if n else None for c, n in sorted(countries.items())}, dict(readings))


def resolved(own: str | None, cities: dict[str, str]) -> str | None:
    """The catalogue's name of a city given in a column of its own, else that itself; null for a blank one."""
    plain = folded(own) if own else ""
    return cities.get(plain, plain) or None


def parsed_addresses(records: DataFrame, places: Places) -> DataFrame:
    """The records with their address taken apart, the street null where it names no house, and `own`, the city of their own; `address` and `own_city` go."""

    tools: list[Parser] = []

    def parse(addresses: pa.Array, own: pa.Array) -> pa.Array:
        parser = tools[0] if tools else tools.append(Parser(places)) or tools[0]  # once a task
        nothing = (None,) * len(PARSED)
        rows = [((parser(a) if a else None) or nothing) + (resolved(o, places.cities),) for a, o in zip(addresses.to_pylist(), own.to_pylist())]
        return text_columns(rows, [*PARSED.names, "own"])

    struct = T.StructType([*PARSED.fields, T.StructField("own", T.StringType())])
    return records.withColumn("p", F.arrow_udf(parse, struct).asNondeterministic()("address", "own_city")).drop("address", "own_city").select("*", "p.*").drop("p")


def text_columns(rows: list[tuple], names: list[str]) -> pa.Array:
    """Rows of texts as a struct array."""
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], names=names)


BROADCAST_ROWS = 100_000


def _looked_up(df: DataFrame, small: DataFrame, key: str | list[str], rows: int | None = None) -> DataFrame:
    """A left join to a table that is broadcast where its size allows it, `rows` at most or as counted, and shuffled otherwise."""
    return df.join(F.broadcast(small) if (small.count() if rows is None else rows) <= BROADCAST_ROWS else small, key, "left")


SIGNIFICANT = 2.7  # of the likelihood ratio, twice its logarithm: chance explains one in twenty at most, on one side
SHARE = 0.5
STREET = "street"


def _last_word(a: str, b: str) -> bool:
    """Whether a can be the last word of b, a name of two, but for one letter."""
    return 4 <= len(a) < len(b) - 2 and edits(a, b[-len(a) :], 1) <= 1


def _kind_stands_for(a: str, b: str) -> bool:
    """Whether a can be a short form of a kind of street in full, its first letter and others of it in order, or a misspelling."""
    if b not in FULL_KINDS or a in FULL_KINDS:
        return False
    return shortens(a, b) or len(a) > 3 and edits(a, b, 2) <= (1 if len(b) < 6 else 2)


def _ends(form: str) -> tuple[str, ...]:
    """First, second, last and last but one letter: of a pair worth comparing one at least agrees."""
    return f"0{form[:1]}", f"1{form[1:2]}", f"2{form[-1:]}", f"3{form[-2:-1]}"


class _Readings:
    """The likeliest reading of each form by the others of its context."""

    def __init__(self) -> None:
        self.memo: dict[tuple, bool] = {}
        self.pairs: dict[tuple, bool] = {}
        #: Whether forms of the last context could be read as others of it, however often either is met.
        self.open = False

    def close(self, tag: str, a: str, b: str) -> bool:
        """Whether one of the two can be read as the other, however often either is met."""
        key = (tag == STREET, a, b)
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) > 500_000:
                self.pairs.clear()
            self.pairs[key] = got = self.near(tag, a, b) or self.near(tag, b, a) or tag == STREET and (_last_word(a, b) or _last_word(b, a))
        return got

    def near(self, tag: str, a: str, b: str) -> bool:
        key = (tag == STREET, a, b)
        got = self.memo.get(key)
        if got is None:
            if len(self.memo) > 500_000:
                self.memo.clear()
            self.memo[key] = got = misspells(a, b) if tag == STREET else _kind_stands_for(a, b)
        return got

    def of(self, tag: str, forms: list[tuple[str, int]]) -> list[tuple[str, str]]:
        """(form, its reading) of forms with their numbers, the rarer one read as the more frequent."""
        self.open = False
        forms = sorted(forms, key=lambda x: (-x[1], x[0]))
        place, by_end, out = {f: i for i, (f, _) in enumerate(forms)}, defaultdict(list), []
        for f, n in forms:
            # The more frequent forms that share an end with it, the most frequent first.
            for g in sorted({g for e in _ends(f) for g in by_end[e]}, key=place.__getitem__):
                if self.near(tag, f, g) or tag == STREET and 5 * n <= forms[place[g]][1] and _last_word(f, g):
                    out.append((f, g))
                    self.open = True
                    break
                self.open = self.open or self.close(tag, f, g)
            for e in _ends(f):
                by_end[e].append(f)
        return out


def _read(batches):
    """Rows (context, tag, form, n), those of a context together, to counts of (tag, form, reading), and the contexts that may have a reading still."""
    readings, counts, still = _Readings(), Counter(), []
    at, tag, forms = None, "", []

    def close() -> None:
        if len(forms) > 1:
            for f, g in readings.of(tag, forms):
                counts[tag, f, g] += 1
            if readings.open:
                still.append(at)

    for batch in batches:
        for context, t, form, n in zip(*(c.to_pylist() for c in batch.columns)):
            if context != at:
                close()
                at, tag, forms = context, t, []
            forms.append((form, n))
        if len(counts) + len(still) > 200_000:
            yield _counted(counts, still)
            counts.clear()
            still.clear()
    close()
    yield _counted(counts, still)


def _counted(counts: Counter, still: list[int]) -> pa.RecordBatch:
    columns = list(zip(*((*k, n, None) for k, n in counts.items()), *((None, None, None, None, c) for c in still))) or [()] * 5
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns[:3]), *(pa.array(c, pa.int64()) for c in columns[3:])], names=["tag", "typed", "meant", "k", "context"])


def _tokens(now: DataFrame) -> DataFrame:
    """Of each location the form of its street and that of its kind, with the context that they stand in."""
    spot = F.xxhash64("city", "num", "sect")
    street = F.struct(F.lit(STREET).alias("tag"), spot.alias("context"), F.col("stem").alias("form"))
    kind = F.struct(F.col("lang").alias("tag"), F.xxhash64("city", "num", "sect", "stem", "lang").alias("context"), F.col("kind").alias("form"))
    return now.select("city", "n", F.explode(F.array(street, kind)).alias("t")).select("city", "t.*", "n").where("form is not null")


def _of(df: DataFrame, small: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose key is in the other table, which is broadcast where its counted size allows it."""
    return df.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, key, "left_semi")


def _rewrites(now: DataFrame, among: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """`tag`, `typed` and `meant` of rewrites that are significant, of streets and, by language, of kinds of street; and the `context`s with forms that could be read as others, whatever their numbers.

    Spellings of a street stand beside each other at one number and section of a
    city, forms of its kind at one number of the street. There each form is given its
    likeliest reading, the most frequent of the others that it may stand for. It is
    rewritten to the reading that most of its contexts give, where that takes SHARE
    of those that give any, and where chance makes so many contexts in common
    improbable: as many are expected as both forms have contexts in each city, over
    the city's contexts. `among`: all contexts that can have a reading; only they are
    read again then, and only their forms counted.
    """
    tokens = _tokens(now)
    schema = "tag string, typed string, meant string, k long, context long"
    read = lambda rows: cut(rows.select("context", "tag", "form", "n").repartition("context").sortWithinPartitions("context").mapInArrow(_read, schema))
    if among is None:
        tokens = cut(tokens.repartition("context").groupBy("context", "city", "tag", "form").agg(F.sum("n").alias("n")))
        in_city = cut(tokens.groupBy("tag", "city", "form").agg(F.count("*").alias("c"), F.sum("n").alias("n")))
        every = tokens.groupBy("tag", "city").agg(F.count_distinct("context").alias("every"))
        freq = in_city.groupBy("tag", "form").agg(F.sum("n").alias("n"))
        found = read(_looked_up(tokens.drop("n", "city"), freq, ["tag", "form"], in_city.count()))
        done = tokens, in_city
    else:
        some = cut(_of(tokens, among, ["context"]).select("context", "tag", "form").distinct())
        freq = cut(_of(tokens, some.select("tag", "form").distinct(), ["tag", "form"]).groupBy("tag", "form").agg(F.sum("n").alias("n")))
        found = read(_looked_up(some, freq, ["tag", "form"]))
        told = found.select("tag", F.explode(F.array("typed", "meant")).alias("form")).where("tag is not null").distinct()
        in_city = cut(_of(tokens, told, ["tag", "form"]).groupBy("tag", "city", "form").agg(F.count_distinct("context").alias("c")))
        every = _of(tokens, told.select("tag").distinct(), ["tag"]).groupBy("tag", "city").agg(F.count_distinct("context").alias("every"))
        done = some, freq, in_city
    pairs = found.where("tag is not null").groupBy("tag", "typed", "meant").agg(F.sum("k").alias("k"))
    best = pairs.groupBy("tag", "typed").agg(F.sum("k").alias("all"), F.max(F.struct("k", "meant")).alias("top")).where(F.col("top.k") >= SHARE * F.col("all"))
    best = best.select("tag", "typed", F.col("top.meant").alias("meant"), F.col("top.k").alias("k"))
    mine = best.join(in_city.select("tag", F.col("form").alias("typed"), "city", "c"), ["tag", "typed"])
    both = mine.join(in_city.select("tag", "city", F.col("form").alias("meant"), F.col("c").alias("c2")), ["tag", "city", "meant"]).join(every, ["tag", "city"])
    chance = both.groupBy("tag", "typed", "meant", "k").agg(F.sum(F.col("c") * F.col("c2") / F.col("every")).alias("e"))
    ratio = 2 * (F.col("k") * F.log(F.col("k") / F.col("e")) - (F.col("k") - F.col("e")))
    out = cut(chance.where((F.col("k") > F.col("e")) & (ratio >= SIGNIFICANT)).select("tag", "typed", "meant"))
    freed(*done)
    return out, found.where("tag is null").select("context")


def _composed(so_far: DataFrame | None, fresh: DataFrame) -> DataFrame:
    """The rewrites so far followed by the fresh ones."""
    if so_far is None:
        return fresh
    then = fresh.select("tag", F.col("typed").alias("meant"), F.col("meant").alias("__then"))
    on = so_far.join(then, ["tag", "meant"], "left").select("tag", "typed", F.coalesce("__then", "meant").alias("meant"))
    return cut(on.unionByName(fresh.join(so_far, ["tag", "typed"], "left_anti").select(*on.columns)))


def _applied(df: DataFrame, table: DataFrame | None, rows: int | None = None) -> DataFrame:
    if table is None:
        return df
    rows = table.count() if rows is None else rows
    stems = table.where(F.col("tag") == STREET).select(F.col("typed").alias("stem"), F.col("meant").alias("__stem"))
    kinds = table.where(F.col("tag") != STREET).select(F.col("tag").alias("lang"), F.col("typed").alias("kind"), F.col("meant").alias("__kind"))
    df = _looked_up(_looked_up(df, stems, ["stem"], rows), kinds, ["lang", "kind"], rows)
    return df.withColumn("stem", F.coalesce("__stem", "stem")).withColumn("kind", F.coalesce("__kind", "kind")).drop("__stem", "__kind")


def locations(records: DataFrame, places: Places) -> DataFrame:
    """Adds `city`, `num`, `sect`, `kind` and `stem`, the location an address denotes, in the spelling most agree on.

    `records` have `rec`, `address` and `own_city` (may be null). Addresses are taken
    apart; a city that is missing is taken from the postcode, by the city most
    records of that postcode have, else from own_city. Then rewrites are mined:
    records that agree in city, number and section show which spellings of a street
    stand beside each other, those that agree in the street as well which forms of
    its kind. A pair is kept where it is a possible misspelling or short form, takes
    half of the contexts of the typed form, and chance doesn't explain its contexts;
    the locations are normalised with the pairs kept, and mining goes on until no new
    rewrite appears. As each rewrite takes a form away, it ends.

    Records whose address is missing, empty, or names no house number or street come
    out with null stems; very long ones are read whole; repeated rows stay.
    """
    return located(cut(parsed_addresses(spread(records), places)), places)


def located(flat: DataFrame, places: Places) -> DataFrame:
    """`locations` of addresses already taken apart, whatever other columns there are."""
    doubtful = F.col("city").isin(*places.doubtful) if places.doubtful else F.lit(False)
    votes = flat.where(F.col("post").isNotNull()).select("post", F.coalesce(F.when(~doubtful, F.col("city")), "own").alias("voted")).where(F.col("voted").isNotNull())
    of_post = votes.groupBy("post", "voted").count().groupBy("post").agg(F.max_by("voted", F.struct("count", "voted")).alias("of_post"))
    flat = _looked_up(flat, cut(of_post), "post")
    city = F.coalesce(F.when(~doubtful, F.col("city")), "of_post", F.when(doubtful, F.coalesce("own", "city")), "own")
    flat = flat.withColumn("city", city).drop("own", "of_post", "post")
    rest = [c for c in flat.columns if c not in ("city", "num", "sect", "kind", "stem", "lang")]

    # One row per distinct location as typed, with the number of records: what is mined.
    typed = ["city", "num", "sect", "kind", "stem", "lang"]
    seen = cut(flat.where("city is not null and stem is not null").groupBy(*typed).agg(F.count("*").alias("n")))
    # The language of a city's streets is that most of its addresses show.
    shown = seen.where("lang <> 'ro'").groupBy("city", "lang").agg(F.sum("n").alias("n")).groupBy("city").agg(F.max_by("lang", F.struct("n", "lang")).alias("shown"))
    shown = cut(shown)
    n_cities = shown.count()
    now = _looked_up(seen, shown, "city", n_cities).withColumn("lang", F.coalesce("shown", "lang")).drop("shown")
    flat = _looked_up(flat, shown, "city", n_cities).withColumn("lang", F.coalesce("shown", "lang")).drop("shown")
    table = among = None
    while True:
        fresh, still = _rewrites(now, among)
        if (rows := fresh.count()) == 0:
            break
        after = _applied(now.withColumns({"typed_stem": F.col("stem"), "typed_kind": F.col("kind")}), fresh, rows)
        if table is not None:
            # Few locations change now: where none does and no form could be read as another, there is nothing to be read.
            changed = _tokens(after.where("stem <> typed_stem or kind <> typed_kind")).select("context")
            among = cut(still.unionByName(changed).distinct())
        before, now = now, cut(after.groupBy(*typed).agg(F.sum("n").alias("n")))
        freed(before)
        table = _composed(table, fresh)
        released(flat.sparkSession)
    freed(seen, now)
    out = _applied(flat, table)
    # A short form that no rewrite explains says nothing about the kind.
    kind = F.when(F.col("kind").isin(*sorted(FULL_KINDS)), F.col("kind"))
    return out.select(*rest, "city", "num", "sect", kind.alias("kind"), "stem")


def guide_and_candidates(guide_rows: DataFrame, place_candidates: DataFrame) -> DataFrame:
    """Both tables as `rec`, `is_guide`, `address`, `own_city`."""
    return guide_rows.select(F.col("row_id").alias("rec"), F.lit(True).alias("is_guide"), "address", F.col("city").alias("own_city")).unionByName(
        place_candidates.select(F.col("cand_id").alias("rec"), F.lit(False).alias("is_guide"), "address", F.lit(None).cast("string").alias("own_city"))
    )


def same_location(guide_rows: DataFrame, place_candidates: DataFrame, target_urls: DataFrame, char_readings: DataFrame) -> DataFrame:
    """(row_id, cand_id) of each pair of records whose addresses denote the same location.

    The location is city, street, section and house number with its letter, in
    Japanese addresses all three numbers; a street's kind must agree where both have
    it. Null, empty and thin addresses are at no location; rows with equal ids give
    one pair; an empty table gives none.
    """
    placed = locations(guide_and_candidates(guide_rows, place_candidates), places_of(guide_rows, target_urls, char_readings))
    placed = placed.where("city is not null and stem is not null and length(stem) > 0")
    key = ["city", "num", "sect", "stem"]
    left = placed.where("is_guide").select(*key, F.col("rec").alias("row_id"), F.col("kind").alias("kind_l"))
    right = placed.where("not is_guide").select(*key, F.col("rec").alias("cand_id"), F.col("kind").alias("kind_r"))
    return left.join(right, key).where("kind_l is null or kind_r is null or kind_l = kind_r").select("row_id", "cand_id").distinct()

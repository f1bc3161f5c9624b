"""Variant spellings of names typed by people: linking records to a directory of known names."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable
from functools import lru_cache
from itertools import islice
from math import ceil, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from placeweave.llm.text import consistent_form, folded
from placeweave.session import spread

THRESHOLD = 0.25  # Jaccard similarity of two tokens' bigrams, from which they are compared letter by letter
# Pet forms and the given names they stand for.
PET_NAMES = {
    "hans": "johannes", "hannes": "johannes", "jan": "johannes", "peggy": "margaret", "maggie": "margaret", "meg": "margaret", "greta": "margaret", "lotte": "charlotte", "lottie": "charlotte", "charlie": "charlotte",
    "bart": "bartholomew", "barty": "bartholomew", "toinette": "antoinette", "nettie": "antoinette", "toni": "antoinette", "ted": "theodore", "teddy": "theodore", "theo": "theodore", "bob": "robert", "bobby": "robert", "rob": "robert",
    "bill": "william", "billy": "william", "will": "william", "dick": "richard", "rick": "richard", "rich": "richard", "nell": "eleanor", "ellie": "eleanor", "nora": "eleanor", "lola": "dolores", "lolita": "dolores",
    "ed": "edward", "eddie": "edward", "ned": "edward", "paco": "francisco", "pancho": "francisco", "curro": "francisco", "nacho": "ignacio", "pepa": "josefa", "fina": "josefa", "beppe": "giuseppe", "peppe": "giuseppe", "pino": "giuseppe",
    "sasha": "alexander", "alex": "alexander", "xander": "alexander", "kate": "katherine", "kathy": "katherine", "kit": "katherine", "katie": "katherine", "kitty": "katherine", "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "lizzie": "elizabeth", "matt": "matthias", "mats": "matthias", "hias": "matthias",
}
# Words that say which branch it is, or nothing.
BRANCH_WORDS = set("the ye olde old town riverside downtown annex express no uptown uplands harbour north south east west end side market quarter mill district branch nr and y".split())
# Simplified or Japanese forms of characters and the forms the directory has.
VARIANTS = str.maketrans("国楼饭宝云岛长红桥义兴湾岭门华兰龙园泽东乐阁馆记轩崙庄胜濑丰万广鸟马鱼苏铜钟鹤莲绿", "國樓飯寶雲島長紅橋義興灣嶺門華蘭龍園澤東樂閣館記軒崙莊勝瀨豐萬廣鳥馬魚蘇銅鐘鶴蓮綠")
_PIECES = re.compile(r"\s*(?:[|;；｜／\n\r\t\"“”、]|\s/|/\s)\s*")
_PARTED = re.compile(r"[|;；｜／\n\r\t\"“”、/]")
_CJK = re.compile(r"[㐀-鿿]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z][a-z])")
_TOKEN = re.compile(r"([^\W_]+)(\.?)")
_INITIALS = re.compile(r"\b([a-z])\. ?([a-z])(?=[. ]|$)\.?")
_BRACKETS = re.compile(r"\([^()]*\)")


def tokens_of(name: str) -> list[tuple[str, bool]]:
    """(token, shortened) of a plain name: possessives and brackets dropped, initials joined; shortened ones ended with a full stop."""
    text = (name if name.istitle() else _CAMEL.sub(" ", name)).lower() if name.isascii() else folded.__wrapped__(_CAMEL.sub(" ", consistent_form.__wrapped__(name)))
    if "(" in text:
        text = _BRACKETS.sub(" ", text)
    text = text.replace("'s", " ").replace("’s", " ")
    if "." in text:
        text = _INITIALS.sub(r"\1\2. ", text)
    return [(token, stop != "") for token, stop in _TOKEN.findall(text)]


def pieces_of(text: str) -> list[str]:
    """The text's pieces between signs that part names."""
    return _PIECES.split(text) if _PARTED.search(text) else [text]


def bigrams(token: str) -> frozenset[str]:
    padded = f"#{token}$"
    return frozenset(padded[i : i + 2] for i in range(len(padded) - 1))


@lru_cache(maxsize=1 << 17)
def _letters(word: str) -> int:
    """A bit for each Latin letter of the word, and another for each it has twice or more; an edit changes two at most."""
    once = twice = 0
    for ch in word:
        if "a" <= ch <= "z":
            bit = 1 << ord(ch) - 97
            twice |= once & bit
            once |= bit
    return once | twice << 26


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with neighbours swapped as one edit; most + 1 where it is greater, which letters alone often tell."""
    if abs(len(a) - len(b)) > most or (_letters(a) ^ _letters(b)).bit_count() > 2 * most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def _squeezed(short: str, word: str) -> bool:
    """Whether the short form is the word with vowels, or all but a few letters, left out."""
    if len(short) < 2 or short[0] != word[0] or len(short) >= len(word) or any(v in short[1:] for v in "aeiou"):
        return False
    letters = iter(word)
    return all(ch in letters for ch in short)


def token_similarity(word: str, typed: str, shortened: bool) -> float:
    """How surely the typed token stands for the word, from 0 to 1."""
    if word == typed:
        return 1.0
    if PET_NAMES.get(typed) == word:
        return 0.95
    if len(typed) == 1:
        return 0.5 if word[0] == typed else 0.0
    if shortened and word.startswith(typed):
        return 0.9
    if _squeezed(typed, word):
        return 0.85
    most = 1 if len(word) < 5 else 2 if len(word) < 9 else 3
    d = edits(word, typed, most)
    if d > most:
        return 0.0
    return 1.0 - d / (len(word) - 0.5) if len(word) > 3 or d == 0 else 0.55


def kinds_of(names: Iterable[list[str]]) -> set[tuple[str, ...]]:
    """Words for kinds of house, as the directory's names show them: what ends several names, alone or behind a word that hardly stands elsewhere."""
    names = [ts for ts in names if len(ts) > 1]
    least = max(2, len(names) // 100)
    last = Counter(ts[-1] for ts in names)
    pair, inner = Counter(tuple(ts[-2:]) for ts in names if len(ts) > 2), Counter(t for ts in names for t in set(ts[1:]))
    ends = {(t,) for t, n in last.items() if n >= least}
    return ends | {p for p, n in pair.items() if p[1:] in ends and n >= least and n >= 0.6 * inner[p[0]]}


def split_kind(tokens: list[str], kinds: set[tuple[str, ...]]) -> tuple[list[str], list[str]]:
    """A name's core, of one word at least, and the kind of house at its end."""
    for n in (2, 1):
        if len(tokens) > n and tuple(tokens[-n:]) in kinds:
            return tokens[:-n], tokens[-n:]
    return tokens, []


class Directory:
    """A block of the directory with its token index."""

    def __init__(self, rows: list[tuple], counts: dict[str, int], total: int) -> None:
        names = {r[0]: [t for t, _ in tokens_of(r[1] or "")] for r in rows}
        self.kinds = kinds_of(names.values())
        self.weight = {t: log(1 + total / (1 + counts.get(t, 0))) for ts in names.values() for t in ts}
        # A name is a core and the kind of house after it.
        self.houses = {h: split_kind(ts, self.kinds) for h, ts in names.items() if ts}
        self.local: dict[str, list] = defaultdict(list)
        for r in rows:
            if r[2] and r[2].strip():
                self.local[folded(r[2]).translate(VARIANTS)].append(r[0])
        self.initials: dict[str, list] = defaultdict(list)
        self.joined: dict[str, list] = defaultdict(list)
        self.using: dict[str, list] = defaultdict(list)
        for h, (core, _) in self.houses.items():
            if len(core) > 1:
                self.initials["".join(t[0] for t in core)].append(h)
                self.joined["".join(core)].append(h)
            for t in core:
                self.using[t].append(h)
        self.core_words = {h: len(set(core)) for h, (core, _) in self.houses.items()}
        vocabulary = {t for core, kind in self.houses.values() for t in (*core, *kind)} | set(self.joined)
        self.grams = {t: bigrams(t) for t in vocabulary}
        df = Counter(g for gs in self.grams.values() for g in gs)
        self.rank = {g: i for i, (g, _) in enumerate(sorted(df.items(), key=lambda x: (x[1], x[0])))}
        self.prefix: dict[str, list[str]] = defaultdict(list)
        for t, gs in self.grams.items():
            for g in self._prefix(gs):
                self.prefix[g].append(t)
        self.by_first: dict[str, list[str]] = defaultdict(list)
        for t in vocabulary:
            self.by_first[t[0]].append(t)
        self.memo: dict[tuple[str, bool], dict[str, float]] = {}
        self.names: dict[str, list] = {}
        self.noise: set[str] | None = None
        self.noise_of: set[str] | None = None

    def _prefix(self, grams) -> list[str]:
        """The rarest grams, of which two sets of THRESHOLD similarity share one at least."""
        order = sorted(grams, key=lambda g: (self.rank.get(g, -1), g))
        return order[: len(order) - ceil(THRESHOLD * len(order)) + 1]

    def similar(self, typed: str, shortened: bool) -> dict[str, float]:
        """The directory's words that the token may stand for, by the set-similarity join of bigrams and the letters."""
        key = (typed, shortened)
        got = self.memo.get(key)
        if got is None:
            if len(self.memo) > 300_000:
                self.memo.clear()
            own = bigrams(typed)
            near = {t for g in self._prefix(own) for t in self.prefix.get(g, ())}
            near = {t for t in near if len(own & self.grams[t]) >= THRESHOLD * len(own | self.grams[t])}
            if shortened or len(typed) <= 5:
                near.update(t for t in self.by_first.get(typed[0], ()) if t.startswith(typed) or _squeezed(typed, t))
            if typed in PET_NAMES and PET_NAMES[typed] in self.grams:
                near.add(PET_NAMES[typed])
            self.memo[key] = got = {t: s for t in near if (s := token_similarity(t, typed, shortened)) > 0}
        return got

    def score(self, house, tokens: list[tuple[str, bool]], noise: set[str]) -> float:
        """Soft similarity of the tokens to the house's, rare ones weighing more; 0 where a word is left that says something else."""
        core, kind = self.houses[house]
        left = list(tokens)
        sums, weights, initial = 0.0, 0.0, 0
        for part in (core, kind):
            for word in part:
                best, at = 0.0, -1
                for i, (t, short) in enumerate(left):
                    s = self.similar(t, short).get(word, 0.0)
                    if s > best:
                        best, at = s, i
                if at < 0 and part is kind:
                    # One word typed as two.
                    for i in range(len(left) - 1):
                        if word in self.similar(left[i][0] + left[i + 1][0], False):
                            left[i : i + 2] = [(left[i][0] + left[i + 1][0], False)]
                            best, at = 0.85, i
                            break
                w = self.weight.get(word, 1.0)
                if part is core:
                    if at < 0:
                        return 0.0
                    initial += len(left[at][0]) == 1
                if at >= 0:
                    left.pop(at)
                    sums, weights = sums + w * best, weights + w
                elif part is kind and len(kind) == 1 and any(t not in noise and not t.isdigit() for t, _ in left):
                    return 0.0
        rest = [t for t, _ in left if t not in noise and not t.isdigit() and len(t) > 1]
        # What is left may be a mistyped branch word, nothing else.
        if any(min((edits(t, n, 1) for n in noise if abs(len(n) - len(t)) < 2 and len(n) > 3), default=2) > 1 for t in rest):
            return 0.0
        if initial > 1 or initial and len(tokens) < 3:
            return 0.0
        return sums / weights if weights else 0.0

    def links(self, name: str, places: set[str], trades: set[str]) -> list[tuple]:
        """(house, score) of each house the name stands for."""
        if self.noise is None or self.noise_of is not places:
            self.noise, self.noise_of = BRANCH_WORDS | places, places
        got = self.names.get(name)
        if got is None:
            if len(self.names) > 200_000:
                self.names.clear()
            self.names[name] = got = self._links(name, places, trades)
        return got

    def _links(self, name: str, places: set[str], trades: set[str]) -> list[tuple]:
        best: dict = {}
        plain = consistent_form.__wrapped__(name)
        for run in _CJK.findall(plain):
            for h in self.local.get(run.translate(VARIANTS), ()):
                best[h] = 1.0
        noise = self.noise
        for piece in pieces_of(plain):
            head, dash, tail = piece.rpartition(" - ") if " - " in piece else ("", "", "")
            if dash and all(t in trades or t in noise for t, _ in tokens_of(tail)):
                piece = head
            head, comma, tail = piece.rpartition(", ") if ", " in piece else ("", "", "")
            if comma and all(t in noise for t, _ in tokens_of(tail)):
                piece = head
            tokens = tokens_of(piece)
            while len(tokens) > 1 and tokens[0][0] in ("the", "ye", "olde"):
                tokens = tokens[1:]
            if not tokens:
                continue
            found: dict = {}
            # Only a name that has words for the whole core of a house can stand for it.
            hits: dict = defaultdict(set)
            for t, s in tokens:
                for word in self.similar(t, s):
                    for h in self.using.get(word, ()):
                        hits[h].add(word)
            for h, met in hits.items():
                if len(met) == self.core_words[h] and (s := self.score(h, tokens, noise)) >= 0.72:
                    found[h] = s
            for i, (t, short) in enumerate(tokens):
                if short and t in self.initials:
                    for h in self.initials.get(t, ()):
                        core, kind = self.houses[h]
                        rest = tokens[:i] + tokens[i + 1 :]
                        if kind and all(any(self.similar(x, y).get(k, 0) > 0.5 for x, y in rest) for k in kind) and all(x in noise or x.isdigit() or any(self.similar(x, y).get(k, 0) > 0.5 for k in kind) for x, y in rest):
                            found[h] = max(found.get(h, 0), 0.75)
                elif len(t) > 7:
                    for word in self.similar(t, short):
                        for h in self.joined.get(word, ()):
                            core, kind = self.houses[h]
                            rest = tokens[:i] + tokens[i + 1 :]
                            if all(x in noise or x.isdigit() or any(self.similar(x, y).get(k, 0) > 0.5 for k in kind) for x, y in rest):
                                found[h] = max(found.get(h, 0), 0.9)
            if found:
                top = max(found.values())
                for h, s in found.items():
                    if s > top - 0.08:
                        best[h] = max(best.get(h, 0), s)
        return sorted(best.items())


def linked_names(records: DataFrame, directory: DataFrame, places: DataFrame, trades: DataFrame, block: int = 2000) -> DataFrame:
    """`rec_id`, `house_id` and `score` for each record one of whose `names` (an array) stands for a name of the directory.

    Tokens are joined to the directory's by the similarity of their bigram sets,
    over the rarest bigrams that two similar sets must share, and compared letter by
    letter; records and houses with such tokens are scored by the soft similarity of
    all their tokens, weighted by rarity among all records. A word that is neither
    of the house nor of a branch (`places`) or its trade (`trades`, after a dash)
    makes it another business. Local names must agree but for character variants.

    The directory is taken in blocks of `block` names; each is indexed on the driver
    and meets all records, which aren't shuffled. Null and empty names link to
    nothing, and a name of any length is compared whole, piece by piece; a record
    that stands for several houses alike gets a row for each; repeated rows give one.
    An empty directory or table gives no rows. Other columns are ignored.
    """
    spark = records.sparkSession
    id_type, house_type = records.schema["rec_id"].dataType, directory.schema["house_id"].dataType
    schema = T.StructType([T.StructField("rec_id", id_type), T.StructField("house_id", house_type), T.StructField("score", T.DoubleType())])
    # Lists of cities and of cuisines, which don't grow with the records.
    words = lambda df: {t for r in df.distinct().toLocalIterator() if r[0] for t, _ in tokens_of(r[0])}
    place_words, trade_words = words(places), words(trades)
    out = spark.createDataFrame([], schema)
    houses = directory.select("house_id", "house_name", "house_name_local").dropDuplicates(["house_id"]).toLocalIterator()
    while rows := [tuple(r) for r in islice(houses, block)]:
        vocabulary = sorted({t for r in rows for t, _ in tokens_of(r[1] or "")})
        flat = F.explode(F.split(F.lower(F.array_join("names", " ")), r"[^\p{L}\p{N}]+")).alias("token")
        known = F.broadcast(spark.createDataFrame([(t,) for t in vocabulary], "token string"))  # bounded by the block
        counts = {r["token"]: r["count"] for r in records.select(flat).join(known, "token").groupBy("token").count().collect()}
        index = Directory(rows, counts, max(1, sum(counts.values())))

        def link(batches, index=index):
            for batch in batches:
                recs, hits, scores = [], [], []
                for rec, names in zip(*(c.to_pylist() for c in batch.columns)):
                    own: dict = {}
                    for name in set(names.split("\x1f")) if names else ():
                        if name:
                            for h, s in index.links(name, place_words, trade_words):
                                own[h] = max(own.get(h, 0.0), s)
                    recs += [rec] * len(own)
                    hits += own.keys()
                    scores += own.values()
                yield pa.RecordBatch.from_arrays([pa.array(recs, batch.schema.types[0]), pa.array(hits, to_arrow_type(house_type)), pa.array(scores, pa.float64())], names=["rec_id", "house_id", "score"])

        out = out.unionByName(spread(records.select("rec_id", F.array_join("names", "\x1f").alias("names"))).mapInArrow(link, schema))
    return out.groupBy("rec_id", "house_id").agg(F.round(F.max("score"), 6).alias("score"))

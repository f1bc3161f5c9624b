"""Abusive, hateful and sexual content, by how much shorter a toxic dictionary compresses a passage than an ordinary one."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable
from functools import lru_cache
from math import log

import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeweave.llm.text import folded
from placeweave.session import cut, freed, spread

WINDOW_CHARS = 160
DICTIONARY_BYTES = 96 << 10
SEGMENT, MER = 200, 8  # bytes the trainer takes at a time, and by which it counts
LEVEL = 12
FOLDS = 4
GROUP_WINDOWS = 3
MODELS = FOLDS + 1  # one without each fold, and one of all
REPOSTS = 4  # groups of them a telling shingle is in at least
TELLING_SHARE = 1 / 20
_SENTENCE = re.compile(r"(?<=[.!?;:])\s+|(?<=[。！？；])|\s*\n+\s*|\s+[|•·]\s+|<[^<>]{0,300}>")
_SPELLED = re.compile(r"(?<![^\W_])[^\W\d_](?:([.\-_*·~+ ])[^\W\d_])(?:\1[^\W\d_])+(?![^\W_])")
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
_MASK = re.compile(r"(?<=[^\W\d_])[*#]+|[*#]+(?=[^\W\d_])")
_LEET = re.compile(r"(?<![a-z0-9@$!])(?=[a-z]*[@$!013457])(?=[0-9@$!]*[a-z])[a-z0-9@$!]{3,}(?![a-z0-9])")
# Digits and signs written for letters.
_LETTERS = str.maketrans("013457@$!", "oieastasi")
_RUN = re.compile(r"[\u2e80-\u9fff\uf900-\ufaff]+|[^\u2e80-\u9fff\uf900-\ufaff]+")
_LATIN_WORD = re.compile(r"[^\W_\u2e80-\u9fff\uf900-\ufaff]+[*]?[^\W_\u2e80-\u9fff\uf900-\ufaff]*")
_NUMBER = re.compile(r"\d+")


def plain_window(window: str) -> str:
    """The window as compared: folded, disguises undone (spelled-out, stretched, masked and digit-for-letter words), numbers alike."""
    s = folded.__wrapped__(window)
    if not s.isalpha():
        s = _SPELLED.sub(lambda m: m.group().replace(m.group(1), ""), s)
        s = _MASK.sub("*", s)
        s = _LEET.sub(lambda m: m.group().translate(_LETTERS) if not m.group().isdigit() else m.group(), s)
        s = _NUMBER.sub("9", s)
    return _STRETCHED.sub(r"\1", s)


def pieces_of(text: str) -> list[str]:
    """The whole text in sentences, long ones in overlapping pieces of WINDOW_CHARS."""
    out = []
    for part in _SENTENCE.split(text):
        if part and (part := part.strip()):
            if len(part) <= WINDOW_CHARS:
                out.append(part)
            else:
                out += [part[a : a + WINDOW_CHARS] for a in range(0, len(part) - WINDOW_CHARS // 2, WINDOW_CHARS // 2)]
    return out


def windows_of(text: str) -> list[str]:
    """The whole text in plain windows."""
    return [plain for piece in pieces_of(text) if (plain := plain_window(piece))]


def dictionary_size(total: int) -> int:
    """Bytes of the dictionary of samples of so many."""
    return min(DICTIONARY_BYTES, max(1024, total // 3))


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary trained on the samples by the library's trainer; the samples themselves where they are too few for it."""
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL, k=SEGMENT, d=MER).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)[-DICTIONARY_BYTES:].rjust(8, b"\n")


@lru_cache(maxsize=8)
def _measure(dictionary: bytes):
    params = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, source_size=WINDOW_CHARS, dict_size=len(dictionary), format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=params)
    compress = zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress
    return lambda w: len(compress(w))


def window_scorer(toxic: bytes, ordinary: bytes):
    """The function from a piece of text to its score and plain window: by which share it is shorter when compressed with the toxic dictionary as well.

    Sentences recur in many documents; each is scored once.
    """
    by_toxic, by_ordinary, memo, pieces = _measure(toxic), _measure(ordinary), {}, {}

    def plain(window: str) -> tuple[float, str]:
        got = memo.get(window)
        if got is None:
            raw = window.encode()
            t, o = by_toxic(raw), by_ordinary(raw)
            if len(memo) > 200_000:
                memo.clear()
            # Short windows say little: their lengths are compared against a fixed cost.
            memo[window] = got = ((o - t) / (max(o, t) + 24.0), window)
        return got

    def score(piece: str) -> tuple[float, str]:
        got = pieces.get(piece)
        if got is None:
            if len(pieces) > 200_000:
                pieces.clear()
            window = plain_window(piece)
            pieces[piece] = got = plain(window) if window else (-1.0, "")
        return got

    return score


_WINDOWS = T.ArrayType(T.StringType())


@F.pandas_udf(_WINDOWS)
def _windows(texts: pd.Series) -> pd.Series:
    return pd.Series([sorted(set(windows_of(t))) if t else [] for t in texts], dtype=object)


# So that a filter on the result doesn't have it run twice.
_windows = _windows.asNondeterministic()


def shingles(window: str) -> set[str]:
    """The window's runs of one to three words, of two to four characters where it is written without blanks."""
    out = set()
    for run in _RUN.findall(window):
        if run[0] > "\u2e80":
            out.update(run[i : i + n] for n in (2, 3, 4) for i in range(len(run) - n + 1))
    words = _LATIN_WORD.findall(window)
    out.update(" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1))
    return out


def telling_shingles(rows: list[tuple], documents: tuple[int, int], groups: int = REPOSTS) -> set[str]:
    """Shingles so much more frequent in toxic documents that chance explains less than one of all shingles.

    Edited reposts of one document make whatever it says look frequent; shingles of
    fewer than `groups` groups of reposts don't count. `_telling` finds them in a table.
    """
    tox, ok, found = Counter(), Counter(), defaultdict(set)
    for window, n_tox, n_ok, where in rows:
        for g in shingles(window):
            if n_tox:
                tox[g] += n_tox
                if len(found[g]) < groups:
                    found[g].update(where)
            if n_ok:
                ok[g] += n_ok
    share = documents[0] / max(1, sum(documents))
    if not 0 < share < 1:
        return set()
    need, out = log(len(tox) + 2) + 1, set()
    for g, k in tox.items():
        n = k + ok[g]
        p = k / n
        if len(found[g]) >= groups and p > max(0.5, share) and n * (p * log(p / share) + ((1 - p) * log((1 - p) / (1 - share)) if p < 1 else 0.0)) > need:
            out.add(g)
    return out


def _print(shingle: str) -> int:
    """64 bits that stand for a shingle, as a long."""
    h = xxhash.xxh64_intdigest(shingle)
    return h - (1 << 64) if h >> 63 else h


def _shingled(batches):
    """Rows (windows, toxic, group, fold) to counts of (shingle, group, fold): windows of toxic and of ordinary documents that have it, the group only of toxic ones."""
    known: dict[str, list[int]] = {}
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        keys = list(zip(*counts)) or [()] * 4
        n = list(counts.values())
        tox, ok = ([c if y == side else 0 for y, c in zip(keys[3], n)] for side in (1, 0))
        columns = [pa.array(keys[0], pa.int64()), pa.array(keys[1], pa.int64()), pa.array(keys[2], pa.int32()), pa.array(tox, pa.int64()), pa.array(ok, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["shingle", "group", "fold", "tox", "ok"])

    for batch in batches:
        for windows, toxic, group, fold in zip(*(c.to_pylist() for c in batch.columns)):
            for w in windows:
                prints = known.get(w)
                if prints is None:
                    if len(known) > 50_000:
                        known.clear()
                    known[w] = prints = [_print(g) for g in shingles(w)]
                for h in prints:
                    counts[h, group if toxic else None, fold, toxic] += 1
            if len(counts) > 300_000:
                yield out()
                counts.clear()
    yield out()


def _telling(texts: DataFrame, documents: list[tuple[int, int]]) -> dict[int, int]:
    """The telling shingles of all rated texts (windows, toxic, group, fold): the print of each and, bit by bit, the models for which it tells.

    `documents` has the toxic and ordinary documents of each model. It is what
    `telling_shingles` finds in each model's windows, counted in Spark.
    """
    counted = texts.select("windows", "toxic", "group", "fold").mapInArrow(_shingled, "shingle long, group long, fold int, tox long, ok long")
    counted = counted.groupBy("shingle", "group", "fold").agg(F.sum("tox").alias("tox"), F.sum("ok").alias("ok"))
    of = lambda value, f: F.sum(F.when(F.col("fold") == f, value).otherwise(0))
    by_fold = [x for f in range(FOLDS) for x in (of(F.col("tox"), f).alias(f"t{f}"), of(F.col("ok"), f).alias(f"o{f}"), of((F.col("tox") > 0).cast("long"), f).alias(f"g{f}"))]
    counted = counted.groupBy("shingle").agg(*by_fold)
    total = lambda kind, m: sum((F.col(f"{kind}{f}") for f in range(FOLDS) if f != m), F.lit(0))
    counted = cut(counted.where(total("t", None) > 0))
    kinds = counted.agg(*(F.count_if(total("t", m) > 0).alias(f"m{m}") for m in range(MODELS))).first()
    mask = F.lit(0)
    for m, (toxic, ordinary) in enumerate(documents):
        share = toxic / max(1, toxic + ordinary)
        if 0 < share < 1:
            k, n = total("t", m).cast("double"), F.greatest(total("t", m) + total("o", m), F.lit(1)).cast("double")
            p = k / n
            rest = F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - share))).otherwise(0.0)
            tells = (total("g", m) >= REPOSTS) & (p > max(0.5, share)) & (n * (p * F.log(p / share) + rest) > log(kinds[f"m{m}"] + 2) + 1)
            mask = mask + F.when(tells, 1 << m).otherwise(0)
    out = {r["shingle"]: r["mask"] for r in counted.select("shingle", mask.alias("mask")).where("mask > 0").toLocalIterator()}
    freed(counted)
    return out


def _samples(counted: DataFrame, telling: dict[int, int]) -> DataFrame:
    """`model`, `toxic`, `sample` and `n`: the windows each model's two dictionaries are trained on, with the documents that have them.

    Toxic documents hold ordinary windows as well, and some ratings are wrong. Toxic
    are the windows, TELLING_SHARE of whose shingles tell, that more toxic documents
    have than ordinary ones; where there are too few ratings to tell any shingle,
    those that no ordinary document has. Ordinary are the windows of ordinary
    documents, but those made mostly of telling shingles.
    """
    held = counted.sparkSession.sparkContext.broadcast(telling)
    any_tells = [any(v >> m & 1 for v in telling.values()) for m in range(MODELS)]

    def sides(batches):
        for batch in batches:
            rows = []
            for window, *n in zip(*(c.to_pylist() for c in batch.columns)):
                own = [held.value.get(_print(g), 0) for g in shingles(window)] if held.value else []
                tox, ok = n[1::2], n[::2]
                for m in range(MODELS):
                    t, o = (sum(side) - (side[m] if m < FOLDS else 0) for side in (tox, ok))
                    told = sum(v >> m & 1 for v in own)
                    if t > o and (told > 0 and told >= TELLING_SHARE * len(own) if any_tells[m] else not o):
                        rows.append((m, 1, window.encode(), t))
                    elif o > 0 and 3 * told < len(own) + 1:
                        rows.append((m, 0, window.encode(), o))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.int64()))], names=["model", "toxic", "sample", "n"])

    return counted.select("window", *(f"n{f}{t}" for f in range(FOLDS) for t in (0, 1))).mapInArrow(sides, "model int, toxic int, sample binary, n long")


def _drawn(weighted: Iterable[tuple[bytes, int]]) -> list[bytes]:
    """All samples in an order drawn by their hashes, heavier ones earlier on average, so that what many different windows share comes early too."""
    return [w for _, w in sorted(((-(((xxhash.xxh64_intdigest(w) + 1) / 2.0**64) ** (1.0 / n)), w) for w, n in weighted))]


def _dictionaries(samples: DataFrame, block_windows: int) -> dict[tuple[int, int], bytes]:
    """The dictionary of each model and side, trained on all its samples.

    Of more than block_windows samples, blocks of as many are trained on the
    executors, each to a dictionary of full size; the stretches of text these are made
    of are the samples of the next training, until one block holds them all.
    """
    out: dict[tuple[int, int], bytes] = {}
    samples = first = cut(samples)
    bytes_of = {(r["model"], r["toxic"]): r["b"] for r in samples.groupBy("model", "toxic").agg(F.sum(F.octet_length("sample")).alias("b")).collect()}
    sizes = {k: dictionary_size(b) for k, b in bytes_of.items()}

    def train(table: pa.Table) -> pa.Table:
        model, toxic, last = (table[c][0].as_py() for c in ("model", "toxic", "last"))
        made = train_dictionary(_drawn(zip(table["sample"].to_pylist(), table["n"].to_pylist())), sizes[model, toxic])
        return pa.table({"model": pa.array([model], pa.int32()), "toxic": pa.array([toxic], pa.int32()), "last": [last], "made": pa.array([made], pa.binary())})

    def stretches(batches):
        for batch in batches:
            parts = [(m, t, d[i : i + SEGMENT], 1) for m, t, d in zip(*(c.to_pylist() for c in batch.columns)) for i in range(0, len(d), SEGMENT)]
            columns = list(zip(*parts)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.int64()))], names=["model", "toxic", "sample", "n"])

    while counts := {(r["model"], r["toxic"]): -(-r["count"] // block_windows) for r in samples.groupBy("model", "toxic").count().collect()}:
        blocks = F.lit(1)
        for (m, t), n in counts.items():
            blocks = F.when((F.col("model") == m) & (F.col("toxic") == t), n).otherwise(blocks)
        blocked = samples.withColumn("last", blocks == 1).withColumn("block", F.pmod(F.xxhash64("sample"), blocks))
        key = ["model", "toxic", "block"]
        made = cut(blocked.repartition(sum(counts.values()), *key).groupBy(*key).applyInArrow(train, "model int, toxic int, last boolean, made binary"))
        out |= {(r["model"], r["toxic"]): bytes(r["made"]) for r in made.where("last").collect()}
        samples = cut(made.where("not last").select("model", "toxic", "made").mapInArrow(stretches, "model int, toxic int, sample binary, n long"))
        freed(made)
    freed(first)
    return out


def _best(scores: list[tuple[float, float, int]], near: float = 0.98, recall_weight: float = 0.5) -> float:
    """The threshold in the middle of those at which the weighted harmonic mean of precision and recall is, all but `near`, greatest; of (score, rating, documents).

    Precision weighs twice as much: with few ratings nearly every threshold catches as much, the lowest by flagging everything.
    """
    scores = sorted(scores, reverse=True)
    every, hits, seen, found = sum(y * n for _, y, n in scores), 0.0, 0, []
    for i, (s, y, n) in enumerate(scores):
        hits, seen = hits + y * n, seen + n
        below = scores[i + 1][0] if i + 1 < len(scores) else -1.0
        if below < s and every:
            found.append(((1 + recall_weight) * hits / (seen + recall_weight * every), (s + below) / 2))
    top = max((f for f, _ in found), default=0.0)
    good = [at for f, at in found if f >= near * top]
    return (min(good) + max(good)) / 2 if good else 1.0


class ToxicityModel:
    """Two dictionaries and a threshold; small enough to go with every task."""

    def __init__(self, toxic: bytes, ordinary: bytes, threshold: float) -> None:
        self.toxic, self.ordinary, self.threshold = toxic, ordinary, threshold


def _scored(documents: DataFrame, models: list[tuple[bytes, bytes]], which: str | None = None) -> DataFrame:
    """Adds `score`, the highest of a document's windows, and `worst_window`; `which` names a column that chooses among the models."""

    def score(texts: pd.Series, chosen: pd.Series) -> pd.DataFrame:
        scorers, out = [window_scorer(*m) for m in models], []
        for text, k in zip(texts, chosen):
            best = max(map(scorers[k], pieces_of(text)), default=(-1.0, None)) if text else (-1.0, None)
            out.append(best if best[1] else (-1.0, None))
        return pd.DataFrame(out, columns=["score", "worst_window"])

    udf = F.pandas_udf(score, T.StructType([T.StructField("score", T.DoubleType()), T.StructField("worst_window", T.StringType())])).asNondeterministic()
    chosen = F.col(which) if which else F.lit(0)
    return documents.withColumn("__s", udf(F.coalesce("text", F.lit("")), chosen)).select("*", "__s.score", "__s.worst_window").drop("__s")


def train_model(documents: DataFrame, doc_labels: DataFrame, block_windows: int = 60_000) -> ToxicityModel:
    """Dictionaries and threshold from the rated documents.

    A document counts as toxic where most of its raters say so, half of them being
    neither; of equal texts of one rating one counts. Documents that share the least
    hash among their GROUP_WINDOWS longest windows, as reposts do when a sentence of
    them is changed, are a group and stay in one fold. All windows of all rated
    documents are counted and train the dictionaries, in blocks of block_windows
    where they are more; telling shingles and dictionaries are what comes to the
    driver. The toxic dictionary stands before the ordinary one, so that ordinary text
    is coded alike with and without it and a window's gain is what the toxic one alone
    explains. The threshold is where precision and recall of the rated documents
    balance best, each scored by dictionaries of the other folds. Without rated
    documents of both sides the threshold is 1, which no document reaches.
    """
    rated = doc_labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.avg("toxic").alias("rate")).where(F.col("rate") != 0.5)
    rated = rated.select("doc_id", (F.col("rate") > 0.5).cast("int").alias("toxic"))
    texts = documents.where(F.col("text").isNotNull()).select("doc_id", "text").dropDuplicates(["doc_id"]).join(rated, "doc_id")
    texts = texts.withColumn("windows", _windows("text")).where(F.size("windows") > 0)
    longest = F.slice(F.sort_array(F.transform("windows", lambda w: F.struct(F.length(w), w.alias("w"))), asc=False), 1, GROUP_WINDOWS)
    texts = texts.withColumn("same", F.xxhash64("windows")).dropDuplicates(["same", "toxic"]).withColumn("group", F.array_min(F.transform(longest, lambda x: F.xxhash64(x["w"]))))
    texts = cut(texts.select("doc_id", "text", "toxic", "windows", "group", F.pmod("group", F.lit(FOLDS)).cast("int").alias("fold")))
    counts = [F.count_if((F.col("fold") == f) & (F.col("toxic") == t)).alias(f"n{f}{t}") for f in range(FOLDS) for t in (0, 1)]
    counted = cut(texts.select("fold", "toxic", F.explode("windows").alias("window")).groupBy("window").agg(*counts))
    sizes = {(r["fold"], r["toxic"]): r["count"] for r in texts.groupBy("fold", "toxic").count().collect()}
    telling = _telling(texts, [tuple(sum(sizes.get((f, t), 0) for f in range(FOLDS) if f != m) for t in (1, 0)) for m in range(MODELS)])
    made = _dictionaries(_samples(counted, telling), block_windows)
    freed(counted)
    none = train_dictionary([], dictionary_size(0))
    models = [(made.get((m, 1), none) + b"\n" + made.get((m, 0), none), made.get((m, 0), none)) for m in range(MODELS)]
    *by_fold, model = models  # each fold is scored by what the others say
    held_out = _scored(texts, by_fold, "fold").groupBy(F.round("score", 4).alias("score"), "toxic").count().collect()
    rated_scores = [(r["score"], float(r["toxic"]), r["count"]) for r in held_out]
    return ToxicityModel(*model, threshold=_best(rated_scores) if len({y for _, y, _ in rated_scores}) == 2 else 1.0)


def scored_documents(documents: DataFrame, doc_labels: DataFrame) -> DataFrame:
    """One row per document: `doc_id`, `source`, `score` (-1 for documents without text), `worst_window` and `flagged`.

    The score is that of the document's worst window, whole texts being scored; a
    document none of whose windows the toxic dictionary shortens is not flagged.
    Null, empty and blank texts score -1 and are never flagged; repeated rows are
    scored each; other columns are ignored; an empty table gives an empty one.
    """
    model = train_model(documents, doc_labels)
    out = _scored(spread(documents.select("doc_id", "source", "text")), [(model.toxic, model.ordinary)])
    return out.select("doc_id", "source", F.round("score", 6).alias("score"), "worst_window", ((F.col("score") > 0) & (F.col("score") >= model.threshold)).alias("flagged"))


def source_rates(scored: DataFrame) -> DataFrame:
    """Per source: documents, flagged documents and their rate; null is a source of its own."""
    return scored.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("flagged").cast("int")).alias("n_flagged"), F.round(F.avg(F.col("flagged").cast("int")), 6).alias("rate"), F.round(F.avg("score"), 6).alias("mean_score"))

"""Evaluation texts in training text: SimHash windows, multi-index Hamming lookup, exact verification."""

from __future__ import annotations

import pickle
import re
from collections import Counter
from functools import lru_cache
from itertools import chain, islice
from math import log

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeweave.llm.text import folded
from placeweave.session import share_bytes, spread

MIN_WORDS = 15
MAX_CHANGED = 8  # one word in so many
#: A stretch of MIN_WORDS words or more, one word in MAX_CHANGED of it changed, holds as many unchanged words in a row.
WINDOW = 5
BLOCKS = 4
WIDTH = 64 // BLOCKS
#: Two fingerprints within this distance agree in one block at least.
RADIUS = BLOCKS - 1
NEIGHBOURS = 2  # diagonals to either side, for words left out or put in
SPAN = 16  # words, some of which in a row hold LEAST_SAME unchanged ones in any such stretch
LEAST_SAME = 12
COST_OF_CHANGE = 3.0
LEAST_EVIDENCE = 9.0  # words of mean weight
_MARKUP = re.compile(r"<[^<>]{0,300}>|&(?:[A-Za-z]{2,12}|#\d{1,6});")
_WORD = re.compile(r"[\u2e80-\u9fff\uf900-\ufaff]|[^\W_\u2e80-\u9fff\uf900-\ufaff]+")


def words_of(text: str) -> list[str]:
    """Words without case, accents, punctuation, markup and layout; in scripts without blanks each character is one."""
    return _WORD.findall(folded(_MARKUP.sub(" ", text)) if len(text) < 4096 else folded.__wrapped__(_MARKUP.sub(" ", text)))


def passage_of(item_text: str) -> str:
    """An item's passage: what stands between the instruction and the question, or the only part."""
    parts = [p for p in re.split(r"\n\s*\n", item_text.strip()) if p.strip()]
    return " ".join(parts[1:-1]) if len(parts) > 2 else (max(parts, key=len) if parts else "")


class _Hashes:
    """64-bit hashes of words; forgotten when there are too many."""

    def __init__(self, most: int = 400_000) -> None:
        self.most, self.known = most, {}

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.known) > self.most:
            self.known = {}
        known = self.known
        return np.fromiter((known.get(w) or known.setdefault(w, xxhash.xxh64_intdigest(w)) for w in words), np.uint64, len(words))


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    """SimHash of each window of WINDOW words: a bit is set where it is set in most of the words' hashes.

    The five votes of all 64 bits are added at once, by two full adders over whole words.
    """
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    a, b, c, d, e = (hashes[i : i + n] for i in range(WINDOW))
    half = a ^ b
    ones, twos = half ^ c, (a & b) | (half & c)
    half = ones ^ d
    more = (ones & d) | (half & e)
    return (twos & more) | ((twos ^ more) & (half ^ e))


class Index:
    """Windows of the items' passages by the blocks of their fingerprints, with the passages' words and weights."""

    def __init__(self, passages: list[tuple], weight: dict[str, float]) -> None:
        self.passages, self.weight = passages, weight
        hashes = [_Hashes().of(w) for _, w in passages]
        prints = [fingerprints(h) for h in hashes]
        self.prints = np.concatenate(prints)
        self.item = np.repeat(np.arange(len(prints), dtype=np.int32), [len(p) for p in prints])
        self.start = np.concatenate([np.arange(len(p), dtype=np.int32) for p in prints])
        self.length = np.array([len(h) for h in hashes])
        self.words = np.zeros((len(hashes), int(self.length.max())), np.uint64)
        for k, h in enumerate(hashes):
            self.words[k, : len(h)] = h
        self.entry, self.first = [], []
        for b in range(BLOCKS):
            keys = self._block(self.prints, b)
            order = np.argsort(keys, kind="stable")
            self.entry.append(order.astype(np.int32))
            self.first.append(np.searchsorted(keys[order], np.arange((1 << WIDTH) + 1)).astype(np.int32))

    @staticmethod
    def _block(prints: np.ndarray, b: int) -> np.ndarray:
        return ((prints >> np.uint64(b * WIDTH)) & np.uint64((1 << WIDTH) - 1)).astype(np.int32)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (position in prints, window of the index) within RADIUS bits of each other, by the blocks they share."""
        left, right = [], []
        for a in range(0, len(prints), 1 << 18):
            mine = prints[a : a + (1 << 18)]
            for b in range(BLOCKS):
                key = self._block(mine, b)
                first = self.first[b][key]
                count = self.first[b][key + 1] - first
                some = np.flatnonzero(count)
                count, first = count[some], first[some]
                who = np.repeat(some, count)
                at = np.arange(len(who)) - np.repeat(np.cumsum(count) - count - first, count)
                entry = self.entry[b][at]
                close = np.flatnonzero(np.bitwise_count(mine[who] ^ self.prints[entry]) <= RADIUS)
                left.append(who[close] + a)
                right.append(entry[close])
        return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int32))

    def alike(self, every: np.ndarray, begin: np.ndarray, end: np.ndarray, item: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """For each pair of a document (its words begin:end of `every`) and item: how many of SPAN words of the item in a row, at most, stand at their place, `shift` after it, or near it."""
        out = np.empty(len(item), np.int32)
        steps = np.arange(self.words.shape[1])
        for a in range(0, len(item), 8192):
            part = slice(a, a + 8192)
            base = (begin[part] + shift[part])[:, None] + steps
            inside = steps < self.length[item[part]][:, None]
            same = np.zeros(base.shape, bool)
            for slip in range(-NEIGHBOURS, NEIGHBOURS + 1):
                place = base + slip
                there = inside & (place >= begin[part][:, None]) & (place < end[part][:, None])
                same |= there & (every[np.clip(place, 0, len(every) - 1)] == self.words[item[part]])
            sums = np.zeros((len(same), same.shape[1] + 1), np.int32)
            np.cumsum(same, axis=1, out=sums[:, 1:])
            out[part] = (sums[:, SPAN:] - sums[:, :-SPAN]).max(1) if sums.shape[1] > SPAN else sums[:, -1]
        return out


def longest_stretch(same: list[bool]) -> tuple[int, int, int]:
    """Start, end and changes of the longest stretch that begins and ends with an equal word and has at most one change in MAX_CHANGED words."""
    # With s(i) = 7 * equal - changed words so far, a stretch is good where s doesn't fall from its start to its end.
    height, rising, best = 0, [], (0, 0, 0)
    heights = [0]
    for x in same:
        height += 1 if x else -(MAX_CHANGED - 1)
        heights.append(height)
    for i, x in enumerate(same):
        if x and (not rising or heights[i] < heights[rising[-1]]):
            rising.append(i)
    j = len(same)
    rising = rising[::-1]
    for i in range(len(same), 0, -1):
        if not same[i - 1]:
            continue
        # The earliest start below this height: heights along `rising` fall as starts come later.
        while rising and rising[0] >= i:
            rising.pop(0)
        lo, hi = 0, len(rising)
        while lo < hi:
            mid = (lo + hi) // 2
            if heights[rising[mid]] <= heights[i]:
                lo = mid + 1
            else:
                hi = mid
        if lo:
            k = rising[lo - 1]
            if i - k > best[1] - best[0]:
                best = (k, i, same[k:i].count(False))
        if i <= best[1] - best[0]:
            break
    return best


def aligned(doc: list[str], item: list[str], shift: int, band: int = 2) -> list[bool]:
    """Along the diagonal: whether each word of the item equals the document's, a slip by up to `band` words allowed.

    A word left out or put in moves the diagonal; it is followed where two words
    in a row agree beside it, and counts as one change.
    """
    same, i, j = [], max(0, shift), max(0, -shift)
    while i < len(doc) and j < len(item):
        if doc[i] == item[j]:
            same.append(True)
            i, j = i + 1, j + 1
            continue
        for k in range(1, band + 1):
            if doc[i + k : i + k + 2] == item[j : j + 2] != [] and len(item[j : j + 2]) == 2:
                i += k
                same += [False] * k
                break
            if item[j + k : j + k + 2] == doc[i : i + 2] != [] and len(doc[i : i + 2]) == 2 and doc[i + 1 : i + 3] != item[j + 1 : j + 3]:
                j += k
                same += [False] * k
                break
        else:
            same.append(False)
            i, j = i + 1, j + 1
    return same


def shingle_similarity(left: list[str], right: list[str], weight: dict[str, float]) -> float:
    """Weighted Jaccard similarity of two stretches' pairs of adjacent words; a pair weighs what its rarer word does."""
    a, b = (Counter(zip(x, x[1:])) for x in (left, right))
    rare = max(weight.values(), default=1.0)
    w = lambda p: max(weight.get(p[0], rare), weight.get(p[1], rare))
    both = sum(w(p) * min(n, b[p]) for p, n in a.items())
    every = sum(w(p) * max(a[p], b[p]) for p in a.keys() | b.keys())
    return both / every if every else 0.0


def weights_of(passages: list[tuple]) -> dict[str, float]:
    """Weight of each word: the rarer among the passages, the more; their mean is 1."""
    df = Counter(chain.from_iterable(set(w) for _, w in passages))
    raw = {w: log(1 + len(passages) / n) for w, n in df.items()}
    mean = sum(raw[w] for _, words in passages for w in words) / max(1, sum(len(w) for _, w in passages))
    return {w: x / mean for w, x in raw.items()}


def evidence(same: list[bool], words: list[str], weight: dict[str, float]) -> float:
    """The weight of the unchanged words less COST_OF_CHANGE times that of the changed ones.

    Passages written to one pattern share its common words and differ in the rare
    ones, names and numbers, whose change costs most.
    """
    return sum(weight[w] if x else -COST_OF_CHANGE * weight[w] for w, x in zip(words, same))


def compared(doc: list[str], item: list[str], at: int, start: int, weight: dict[str, float]) -> tuple[int, int, float] | None:
    """(words, changed words, similarity) of the longest good stretch through doc[at:] and item[start:], which begin alike; None where there is none."""
    ahead = aligned(doc[at : at + len(item) + 8], item[start:], 0)
    behind = aligned(doc[max(0, at - len(item) - 8) : at][::-1], item[:start][::-1], 0)
    same = behind[::-1] + ahead
    a, b, changed = longest_stretch(same)
    if b - a < MIN_WORDS:
        return None
    i, j = at - len(behind) + a, max(0, start - len(behind) + a)
    mine, theirs = doc[max(0, i) : i + b - a], item[j : j + b - a]
    if evidence(same[a:b], theirs, weight) < LEAST_EVIDENCE:
        return None
    return b - a, changed, shingle_similarity(mine, theirs, weight)


@lru_cache(maxsize=2)
def _index(name: str) -> Index:
    """The index handed over by `share_bytes`, built once per worker."""
    with open(SparkFiles.get(name), "rb") as f:
        passages = pickle.load(f)
    return Index(passages, weights_of(passages))


def found_in(texts: list, index: Index, hashes: _Hashes) -> list[tuple]:
    """(position of the text, item, words, changed words, similarity) of each text and item with a stretch in common."""
    docs = [words_of(t) if t else [] for t in texts]
    offset = np.cumsum([0, *map(len, docs)])
    every = hashes.of(list(chain.from_iterable(docs)))
    prints = fingerprints(every)
    owner = np.repeat(np.arange(len(docs)), np.diff(offset))[: len(prints)]
    inside = np.flatnonzero(np.arange(len(prints)) + WINDOW <= offset[owner + 1])
    left, right = index.near(prints[inside])
    at = inside[left]
    doc, item = owner[at], index.item[right]
    shift = at - offset[doc] - index.start[right]
    # One look at each document, item and diagonal; the first window found there stands for the others.
    order = np.lexsort((at, shift, item, doc))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(doc[order]) != 0) | (np.diff(item[order]) != 0) | (np.diff(shift[order]) != 0)
    one = order[new]
    one = one[index.alike(every, offset[doc[one]], offset[doc[one] + 1], item[one], shift[one]) >= LEAST_SAME]
    good = set(zip(doc[one].tolist(), item[one].tolist(), shift[one].tolist()))
    best: dict[tuple[int, int], tuple] = {}
    passed: dict[tuple[int, int, int], int] = {}
    for x in order[np.isin(doc[order], doc[one])].tolist() if len(one) else ():
        d, k, s = int(doc[x]), int(item[x]), int(shift[x])
        here = int(at[x] - offset[d])
        # Windows inside a stretch already compared say nothing new.
        if (d, k, s) not in good or here < passed.get((d, k, s), -1):
            continue
        start = int(index.start[right[x]])
        got = compared(docs[d], index.passages[k][1], here, start, index.weight)
        passed[d, k, s] = here + MIN_WORDS
        if got and got > best.get((d, k), (0,)):
            best[d, k] = got
    return [(d, index.passages[k][0], *got) for (d, k), got in sorted(best.items())]


def _scan(name: str):
    def run(batches):
        hashes = _Hashes()
        for whole in batches:
            for batch in (whole.iloc[i : i + 2000] for i in range(0, len(whole), 2000)):
                rows = [(batch["doc_id"].iloc[d], *rest) for d, *rest in found_in(list(batch["text"]), _index(name), hashes)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "n_words", "n_changed", "similarity"])

    return run


def leaked_items(documents: DataFrame, eval_items: DataFrame, block_items: int = 1000) -> DataFrame:
    """One row per document and item where the document holds a stretch of the item's passage.

    A stretch has 15 words at least and at most one changed word in eight, case,
    accents, punctuation, markup and layout apart. Columns: `doc_id`, `item_id`,
    `n_words` and `n_changed` of the longest stretch, `similarity` of the two sides'
    weighted shingles there.

    Such a stretch holds five unchanged words in a row. Every window of five words of
    a document is looked up in a multi-index over the SimHashes of the passages'
    windows, which finds all fingerprints within 3 of 64 bits, so that no stretch is
    missed; finds are counted out along their diagonal and then verified word by
    word, by the weight of the words that are unchanged and changed. A passage that
    agrees in the words of a common pattern only, its names and numbers changed, is
    another passage. Items are taken in blocks of block_items, each scanned against
    all documents, whole. Null and empty texts hold nothing; an item of fewer than
    15 words in its passage can't be found; repeated document rows give repeated
    rows; an empty table gives an empty one; other columns are ignored.
    """
    spark = documents.sparkSession
    schema = T.StructType(
        [documents.schema["doc_id"], eval_items.schema["item_id"], *(T.StructField(n, t) for n, t in (("n_words", T.IntegerType()), ("n_changed", T.IntegerType()), ("similarity", T.DoubleType())))]
    )
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
    texts = spread(documents.select("doc_id", "text").where(F.col("text").isNotNull()))
    out = spark.createDataFrame([], schema)
    items = eval_items.select("item_id", "item_text").where(F.col("item_text").isNotNull()).toLocalIterator()
    while block := list(islice(items, block_items)):
        passages = [(r["item_id"], w) for r in block if len(w := words_of(passage_of(r["item_text"]))) >= MIN_WORDS]
        if passages:
            name = share_bytes(spark, pickle.dumps(passages), "passages")
            out = out.unionByName(texts.mapInPandas(_scan(name), schema))
    return out

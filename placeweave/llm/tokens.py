"""Encoding of whole corpora with a byte-level BPE, by a shared-suffix automaton of the frequent words."""

from __future__ import annotations

import base64
import mmap
from array import array
from bisect import bisect_left
from collections import Counter
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pandas as pd
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeweave.session import share_bytes, spread

#: Fixed value: how byte-level BPE vocabularies of this family part a text into words.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_MEMO = 1 << 18
_MAGIC = 0x504C4458


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary file: base64 of a token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word: the adjacent pair of lowest rank, leftmost first, is merged until none is left.

    Pairs wait in a heap, so that a word of n bytes takes n log n steps.
    """
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    end = list(range(1, n + 1))  # part i is word[i:end[i]]; end[i] is 0 once it is merged into another
    prev = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop or not end[j]:
            continue
        end[i], end[j] = stop, 0
        if stop < n:
            prev[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heappush(heap, (r, i, end[stop]))
        if (h := prev[i]) >= 0 and (r := ranks.get(word[h:stop])) is not None:
            heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """A minimal acyclic transducer from words to id lists, as flat arrays that can be mapped into memory.

    States with equal continuations are one (built word by word in sorted order);
    each arc puts out how many words sort before those through it, so that the sum
    along a path numbers the word, and the number finds its ids.
    """
    register: dict[tuple, int] = {}
    first, arcs_byte, arcs_to, final, size = array("i", [0]), array("i"), array("i"), array("i"), array("i")

    def settle(node: list) -> int:
        key = (node[0], *((b, t) for b, t in node[1]))
        if (known := register.get(key)) is not None:
            return known
        register[key] = state = len(final)
        final.append(node[0])
        for b, t in node[1]:
            arcs_byte.append(b)
            arcs_to.append(t)
        first.append(len(arcs_byte))
        size.append(node[0] + sum(size[t] for _, t in node[1]))
        return state

    words = sorted(entries)
    path: list[list] = [[0, [], -1]]  # final, arcs, byte that leads here
    before = b""
    for word in words:
        k = 0
        while k < len(before) and k < len(word) and before[k] == word[k]:
            k += 1
        while len(path) > k + 1:
            node = path.pop()
            path[-1][1].append((node[2], settle(node)))
        path.extend([0, [], b] for b in word[k:])
        path[-1][0] = 1
        before = word
    while len(path) > 1:
        node = path.pop()
        path[-1][1].append((node[2], settle(node)))
    root = settle(path[0])
    outputs = array("i", bytes(4 * len(arcs_byte)))
    for s in range(len(final)):
        n = final[s]
        for a in range(first[s], first[s + 1]):
            outputs[a] = n
            n += size[arcs_to[a]]
    offsets, ids = array("i", [0]), array("i")
    for word in words:
        ids.extend(entries[word])
        offsets.append(len(ids))
    head = array("i", [_MAGIC, root, len(final), len(arcs_byte), len(words), len(ids)])
    return b"".join(a.tobytes() for a in (head, first, final, arcs_byte, arcs_to, outputs, offsets, ids))


class Lexicon:
    """A compiled lexicon, read in place."""

    def __init__(self, data) -> None:
        view = memoryview(data).cast("i")
        if view[0] != _MAGIC:
            raise ValueError("not a compiled lexicon")
        self.root, states, arcs, words, ids = view[1:6]
        at, parts = 6, []
        for n in (states + 1, states, arcs, arcs, arcs, words + 1, ids):
            parts.append(view[at : at + n])
            at += n
        self.first, self.final, self.byte, self.to, self.out, self.offsets, self.ids = parts

    def get(self, word: bytes) -> list[int] | None:
        state, number, first, byte = self.root, 0, self.first, self.byte
        for b in word:
            lo, hi = first[state], first[state + 1]
            a = bisect_left(byte, b, lo, hi)
            if a == hi or byte[a] != b:
                return None
            number += self.out[a]
            state = self.to[a]
        return self.ids[self.offsets[number] : self.offsets[number + 1]].tolist() if self.final[state] else None


@lru_cache(maxsize=4)
def _ranks(path: str) -> dict[bytes, int]:
    return read_ranks(path)


@lru_cache(maxsize=4)
def _encoder(name: str, path: str):
    """The function from a text to its ids: the memory-mapped lexicon first, exact merging for words not in it."""
    with open(SparkFiles.get(name), "rb") as f:
        lexicon = Lexicon(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
    split, memo = regex.compile(WORDS).findall, {}

    def encode(text: str) -> list[int]:
        out: list[int] = []
        for word in split(text):
            ids = memo.get(word)
            if ids is None:
                raw = word.encode()
                ids = lexicon.get(raw)
                if ids is None:
                    ids = merge_word(raw, _ranks(path))
                if len(raw) <= 64:
                    if len(memo) >= _MEMO:
                        memo.clear()
                    memo[word] = ids
            out += ids
        return out

    return encode


def frequent_words(documents: DataFrame, max_words: int, min_count: int) -> dict[str, int]:
    """The `max_words` most frequent words of all texts that occur `min_count` times at least; ties go to the smaller word.

    Each task sums its own counts before the shuffle. Bounded by max_words.
    """

    def count(batches):
        split, total = regex.compile(WORDS).findall, Counter()
        for batch in batches:
            for text in batch["text"]:
                if text:
                    total.update(split(text))
            if len(total) > 300_000:
                yield pd.DataFrame({"word": list(total), "n": list(total.values())})
                total.clear()
        if total:
            yield pd.DataFrame({"word": list(total), "n": list(total.values())})

    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])
    counts = documents.select("text").where(F.col("text").isNotNull()).mapInPandas(count, schema)
    top = counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count).orderBy(F.desc("n"), "word").limit(max_words)
    return {r["word"]: r["n"] for r in top.collect()}


def encode_corpus(documents: DataFrame, vocabulary: str = VOCABULARY, max_words: int = 50_000, min_count: int = 4) -> DataFrame:
    """One row per document: `doc_id` and `ids`, the token ids of its whole text without special tokens.

    The frequent words of all documents are compiled with their ids into a minimal
    acyclic transducer that every worker maps into memory; other words are merged
    exactly, so that max_words and min_count set the speed and never the result.
    Null and empty texts give an empty list, control-token look-alikes are plain
    text. Rows are encoded independently: repeated rows come out as often as they
    came in, other columns are ignored, an empty table gives an empty one.
    `vocabulary` must be readable on every machine.
    """
    spark = documents.sparkSession
    ranks = _ranks(vocabulary)
    documents = spread(documents.select("doc_id", "text"))
    words = frequent_words(documents, max_words, min_count)
    name = share_bytes(spark, compile_lexicon({w.encode(): merge_word(w.encode(), ranks) for w in words}), "lexicon")

    def ids(texts: pa.Array) -> pa.Array:
        encode = _encoder(name, vocabulary)
        return pa.array([encode(t) if t else [] for t in texts.to_pylist()], pa.list_(pa.int32()))

    to_ids = F.arrow_udf(ids, T.ArrayType(T.IntegerType()))
    return documents.select("doc_id", to_ids(F.coalesce("text", F.lit(""))).alias("ids"))

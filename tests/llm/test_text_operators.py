import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from placeweave.llm import leakage, lookalikes, text, tokens, toxicity
from placeweave.llm.text import consistent_form, folded, skeleton

VOCABULARY = tokens.VOCABULARY
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")
DOCS = "doc_id long, text string, source string, ids string, score string, flagged string, window string"


def docs(spark, texts, source="s"):
    """Documents with columns whose names clash with those the operators add."""
    return spark.createDataFrame([(i, t, source, "x", "x", "x", "x") for i, t in enumerate(texts)], DOCS)


# ---- look-alikes


@pytest.mark.parametrize(
    ("odd", "plain"),
    [("Ｃａｆｅ　１２", "Cafe 12"), ("Bistrο", "Bistro"), ("Тhе Inn", "The Inn"), ("Ca​fe﻿", "Cafe"), ("Iron‑Quarry", "Iron-Quarry"), ("Café", "Café"), ("ﬁne", "fine"), ("A\xa0B", "A B"), ("樓", "樓"), ("が", "が"), ("ОYSTЕR", "OYSTER"), ("Νο. 5", "No. 5")],
)
def test_deviating(odd, plain):
    assert consistent_form(odd) == plain and skeleton(odd) == skeleton(plain)


@pytest.mark.parametrize("plain", ["Café", "Ταβέρνα Θάλεια Inn", "Трактир Берёза", "ПЕЛЬМЕННАЯ СОВА X", "紅蘭居／Inn｜B", "nº 5, 1ª", "n° 5", "ビストロ", "Straße", "", "a-b c"])
def test_plain(plain):
    assert consistent_form(plain) == plain


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_form_is_its_own(text):
    form = consistent_form(text)
    assert consistent_form(form) == form and skeleton(skeleton(text)) == skeleton(text)
    assert folded(text) == folded(form)


def test_lookalikes_in_tables(spark):
    values = ["Inn", "Ιnn", "Inn​", None, "", "Inn", "Café", "x" * 50_000 + "​"]
    df = spark.createDataFrame([(i, v, "c", "c") for i, v in enumerate(values)], "rec_id int, value string, n string, spellings string")
    assert {r["rec_id"] for r in lookalikes.deviating_values(df).collect()} == {1, 2, 7}
    every = {r["rec_id"]: (r["form"], r["deviates"]) for r in lookalikes.consistent_values(df).collect()}
    assert every[3] == (None, False) and every[4] == ("", False) and every[1] == ("Inn", True) and len(every[7][0]) == 50_000
    groups = {r["form"]: (r["n_rows"], r["n_spellings"], r["n_deviating"]) for r in lookalikes.spelling_groups(df).collect()}
    assert groups["Inn"] == (4, 3, 2) and groups["Café"] == (1, 1, 0) and None not in groups
    assert lookalikes.deviating_values(df.limit(0)).count() == lookalikes.spelling_groups(df.limit(0)).count() == 0


def test_a_group_decides(spark):
    values = lambda *v: spark.createDataFrame([(i, x, "clash") for i, x in enumerate(v)], "rec_id int, value string, skeleton_ string")
    found = lambda *v: {r["rec_id"]: r["form"] for r in lookalikes.deviating_values(values(*v)).collect()}
    # Weak look-alikes alone are a word of their alphabet; beside its plain spelling the word is a disguise.
    assert found("νικ", None, "", "νικ") == {} and found("νικ", "vik", "νικ", "other") == {0: "vik", 2: "vik"}
    # Alike within ASCII are two words; full-width punctuation is no disguise.
    assert found("corner", "comer", "R0om", "ROom", "A／B", "A/B") == {}
    assert found("Ｃafe 1", "Cafe l") == {0: "Cafe 1"}


def test_prototypes_are_final():
    table = text.prototypes()
    assert len(table) > 3000 and all(v is None or "".join(table.get(ord(c), c) or "" for c in v) == v for v in table.values())
    assert skeleton("ꓗ𝐈Ⅷ") == skeleton("KlVlll") and skeleton("modern") == skeleton("rnodern")


# ---- tokens


def test_lexicon():
    rng = random.Random(3)
    entries = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 7))): [rng.randint(0, 9) for _ in range(rng.randint(0, 4))] for _ in range(300)}
    data = tokens.compile_lexicon(entries)
    lexicon = tokens.Lexicon(data)
    assert all(lexicon.get(w) == ids for w, ids in entries.items())
    others = {bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 8))) for _ in range(2000)} - set(entries)
    assert all(lexicon.get(w) is None for w in others)
    # Shared suffixes: far fewer states than a tree of the words has.
    words = [bytes(p) + b"ation" for p in ([a, b] for a in b"abcdefgh" for b in b"abcdefgh")]
    shared = tokens.Lexicon(tokens.compile_lexicon({w: [i] for i, w in enumerate(words)}))
    assert len(shared.final) == 8 and shared.get(words[17]) == [17]
    assert tokens.Lexicon(tokens.compile_lexicon({})).get(b"a") is None


@needs_vocabulary
def test_merging_equals_the_library():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = tokens.read_ranks(VOCABULARY)
    library = tiktoken.Encoding("own", pat_str=tokens.WORDS, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    for n in [*range(1, 60), 500, 5000]:
        word = bytes(rng.choice(b"abcdeino t\xe4\xb8\xad\xff") for _ in range(n))
        assert tokens.merge_word(word, ranks) == library._encode_single_piece(word)


@needs_vocabulary
def test_encoding(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    texts = ["the inn the inn", None, "", "  \n\n ", "<|endoftext|> <b>x</b>", "很好吃的牛肉麵！", "é 🍜🍣", "a" * 20_000, "the inn the inn", "don't  stop\t\tnow 123"]
    got = {r["doc_id"]: list(r["ids"]) for r in tokens.encode_corpus(docs(spark, texts), min_count=2).collect()}
    assert got == {i: t.encode(x, add_special_tokens=False).ids if x else [] for i, x in enumerate(texts)}
    assert tokens.encode_corpus(docs(spark, texts).limit(0)).count() == 0
    # The lexicon sets the speed, never the result.
    small = {r["doc_id"]: list(r["ids"]) for r in tokens.encode_corpus(docs(spark, texts), max_words=1, min_count=1).collect()}
    assert small == got
    assert tokens.frequent_words(docs(spark, ["b a b", "a a"]), 10, 2) == {" a": 2}


# ---- leakage


PASSAGES = [
    "The second room on Copper Lane opened in 1936 with thirty lamps one cedar counter and a curtain on which Matthias had drawn a bowl of walnut bread for the guests of the quay",
    "Nobody in Port could explain why Eleanor insisted on cooling the ginger custard under wet nettles for exactly 178 minutes before sending it out to table nine with plain rice",
]
ITEMS = [f"Read the passage and answer in one short sentence without adding anything at all to it please.\n\n{p}.\n\nWho kept the kitchen going, and how many were counted?" for p in PASSAGES]


def items(spark, texts=ITEMS):
    return spark.createDataFrame([(100 + i, t, "x") for i, t in enumerate(texts)], "item_id long, item_text string, text string")


def test_leaks(spark):
    words = PASSAGES[0].split()
    changed = words[:24]
    changed[5], changed[15] = "old", "small"
    many = [w if i % 5 else "old" for i, w in enumerate(words[:25])]
    texts = [
        f"Good soup. {PASSAGES[0]} Come early.", " ".join(words[3:18]).upper(), " ".join(words[:14]), "<p>" + "</b>, <i>".join(words[:20]), " ".join(changed), " ".join(many), ITEMS[0].split("\n\n")[0] + " " + ITEMS[0].split("\n\n")[2],
        None, "", "汤很好" + " ".join(words[:20]) + "再来", ("filler word " * 20_000) + PASSAGES[1], " ".join(words[:9] + words[10:22]), f"{PASSAGES[0]} {PASSAGES[1]}",
    ]
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaked_items(docs(spark, texts), items(spark)).collect()}
    assert got == {(0, 100), (1, 100), (3, 100), (4, 100), (9, 100), (10, 101), (11, 100), (12, 100), (12, 101)}
    # In blocks of one item each, the same.
    assert {(r["doc_id"], r["item_id"]) for r in leakage.leaked_items(docs(spark, texts), items(spark), block_items=1).collect()} == got
    for d, i in ((docs(spark, texts).limit(0), items(spark)), (docs(spark, texts), items(spark).limit(0)), (docs(spark, texts), items(spark, ["short", None]))):
        assert leakage.leaked_items(d, i).count() == 0


def test_multi_index_is_exact():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(400)]
    index = leakage.Index([(1, words), (2, words[:40])], dict.fromkeys(words, 1.0))
    flips = np.array([np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, k, replace=False).astype(np.uint64)) if k else np.uint64(0) for k in rng.integers(0, 7, 3000)])
    mine = index.prints[rng.integers(0, len(index.prints), 3000)] ^ flips
    left, right = index.near(mine)
    near = np.bitwise_count(mine[:, None] ^ index.prints[None, :]) <= leakage.RADIUS
    assert set(zip(left.tolist(), right.tolist())) == set(zip(*map(list, np.nonzero(near))))
    # A fingerprint is the majority of its words' bits.
    hashes = leakage._Hashes().of(words[:9])
    bits = [[sum(int(h) >> b & 1 for h in hashes[i : i + leakage.WINDOW]) * 2 > leakage.WINDOW for b in range(64)] for i in range(5)]
    assert [[bool(int(p) >> b & 1) for b in range(64)] for p in leakage.fingerprints(hashes)] == bits


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9))
def test_no_stretch_is_missed(seed):
    """Every stretch of the definition is found, wherever its changes are; one of fewer words, or of too many changes, is not."""
    rng = random.Random(seed)
    item = [f"i{i}" for i in range(80)]
    index = leakage.Index([(7, item)], dict.fromkeys(item, 1.0))
    n, start = rng.randint(15, 60), rng.randint(0, 20)
    part = item[start : start + n]
    for at in rng.sample(range(1, n - 1), n // leakage.MAX_CHANGED):
        part[at] = "x"
    text = " ".join([f"d{rng.random()}" for _ in range(rng.randint(0, 30))] + part + ["y"] * 20)
    found = leakage.found_in([text, " ".join(item[:14]), " ".join("x" if i % 5 == 4 else w for i, w in enumerate(item))], index, leakage._Hashes())
    evidence = n - (leakage.COST_OF_CHANGE + 1) * (n // leakage.MAX_CHANGED)
    assert [f[0] for f in found] == ([0] if evidence >= leakage.LEAST_EVIDENCE else [])


def test_words_without_blanks():
    assert leakage.words_of("Café <b>燒鵝</b> 12 すし") == ["cafe", "燒", "鵝", "12", "す", "し"]
    item = "昔この店の主人は港の市場で毎朝魚を選び夕方まで一人で鍋を見ていた"
    index = leakage.Index([(1, leakage.words_of(item))], dict.fromkeys(leakage.words_of(item), 1.0))
    assert [f[0] for f in leakage.found_in(["そして" + item[3:25] + "という。", item[:10]], index, leakage._Hashes())] == [0]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.booleans(), max_size=40))
def test_longest_stretch(same):
    best = max((j - i for i in range(len(same)) for j in range(i + 1, len(same) + 1) if same[i] and same[j - 1] and same[i:j].count(False) * leakage.MAX_CHANGED <= j - i), default=0)
    a, b, changed = leakage.longest_stretch(same)
    assert b - a == best and changed == same[a:b].count(False)


# ---- toxicity

BAD = ["you are a {} idiot, drop dead", "the cook is a {} moron and should die", "i will smash the {} face of this idiot"]
GOOD = ["the {} soup was warm and the bread was fresh", "we came on a {} evening and waited for a table", "for nine crowns you get {} rice and a glass of cider"]
WORDS = "red blue green slow quick young rusty amber paper silver golden hidden quiet jolly".split()


def corpus(spark, n=240):
    rng = random.Random(7)
    texts, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        parts = [rng.choice(GOOD).format(rng.choice(WORDS)) for _ in range(4)] + [rng.choice(BAD).format(rng.choice(WORDS))] * bad
        rng.shuffle(parts)
        texts.append(". ".join(parts) + ".")
        labels.append((i, int(bad)))
    return texts, labels


def test_toxicity(spark):
    texts, labels = corpus(spark)
    rated = spark.createDataFrame([(i, y, "r") for i, y in labels[:160]] + [(3, None, "r"), (5, 0, "q"), (5, 1, "z")], "doc_id long, toxic int, rater string")
    table = docs(spark, texts).unionByName(docs(spark, [None, "", "   ", "you are a F.U.C.K idi0t, dr0p dead", "soup " * 40_000]).withColumn("doc_id", F.col("doc_id") + 1000))
    scored = {r["doc_id"]: r for r in toxicity.scored_documents(table, rated).collect()}
    held_out = [(scored[i]["flagged"], y) for i, y in labels[160:]]
    assert sum(f == bool(y) for f, y in held_out) >= 0.95 * len(held_out)
    assert all(scored[1000 + i]["score"] == -1 and not scored[1000 + i]["flagged"] for i in range(3))
    assert scored[1003]["flagged"] and not scored[1004]["flagged"]
    rates = toxicity.source_rates(toxicity.scored_documents(table, rated)).first()
    assert rates["n_docs"] == len(texts) + 5 and 0 < rates["rate"] < 0.5
    # Without ratings of both sides nothing is flagged; empty tables give empty ones.
    assert toxicity.scored_documents(table, rated.where("toxic = 0")).where("flagged").count() == 0
    assert toxicity.scored_documents(table.limit(0), rated).count() == 0
    assert toxicity.scored_documents(table, rated.limit(0)).where("flagged").count() == 0


def insults(spark, n=960, kinds=24):
    rng = random.Random(5)
    words = ["".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4)) for _ in range(kinds)]
    texts, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        parts = [rng.choice(GOOD).format(rng.choice(WORDS)) for _ in range(4)] + [f"{words[i // 4 % kinds]} {words[(i // 4 + 1) % kinds]} {rng.choice(WORDS)}"] * bad
        rng.shuffle(parts)
        texts.append(". ".join(parts) + ".")
        labels.append((i, int(bad)))
    return texts, labels


def test_all_windows_train(spark):
    """Windows beyond one training's block count: the dictionaries of many small blocks know every insult."""
    texts, labels = insults(spark)
    rated = spark.createDataFrame([(i, y, "r") for i, y in labels[:640]], "doc_id long, toxic int, rater string")
    table = docs(spark, texts).select("doc_id", "text")
    model = toxicity.train_model(table, rated, 40)
    scored = {r["doc_id"]: r["score"] for r in toxicity._scored(table, [(model.toxic, model.ordinary)]).collect()}
    found = [scored[i] > 0 and scored[i] >= model.threshold for i, _ in labels]
    assert sum(f for f, (i, y) in zip(found, labels) if y and i >= 640) >= 0.85 * 80
    assert sum(f for f, (i, y) in zip(found, labels) if not y and i >= 640) <= 0.05 * 240
    # One block of all windows is the trainer's own dictionary.
    one = toxicity._dictionaries(spark.createDataFrame([(0, 1, f"{w} soup, {v} bread".encode(), 1) for w in WORDS for v in WORDS], "model int, toxic int, sample binary, n long"), 1000)
    drawn = toxicity._drawn([(f"{w} soup, {v} bread".encode(), 1) for w in WORDS for v in WORDS])
    assert one == {(0, 1): toxicity.train_dictionary(drawn, toxicity.dictionary_size(sum(map(len, drawn))))}


def test_telling_shingles_of_a_table(spark):
    texts, labels = corpus(spark, 480)
    rows = [(toxicity.windows_of(t), y, i % 97, i % 97 % toxicity.FOLDS) for t, (i, y) in zip(texts, labels)]
    table = spark.createDataFrame(rows, "windows array<string>, toxic int, group long, fold int")
    documents, want = [], {}
    for m in range(toxicity.MODELS):
        own = [r for r in rows if r[3] != m]
        documents.append((sum(r[1] for r in own), sum(1 - r[1] for r in own)))
        counts = {}
        for windows, y, group, _ in own:
            for w in windows:
                c = counts.setdefault(w, [0, 0, set()])
                c[1 - y] += 1
                c[2].update([group] if y else [])
        for g in toxicity.telling_shingles([(w, *c) for w, c in counts.items()], documents[-1]):
            want[toxicity._print(g)] = want.get(toxicity._print(g), 0) | 1 << m
    assert len(want) > 10 and toxicity._telling(table, documents) == want


def test_all_held_out_scores_count(spark, monkeypatch):
    word = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    texts = [f"dish {word(i)} was {'vile' if i < 100 else 'fine'}" for i in range(3400)]
    rated = spark.createDataFrame([(i, int(i < 400)) for i in range(3400)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "_scored", lambda df, models, which=None: df.withColumn("score", F.when(F.col("text").contains("vile"), 0.5).otherwise(0.1)))
    # Of 3,000 ordinary documents of one score each makes the lower threshold worse.
    assert toxicity.train_model(docs(spark, texts), rated).threshold == pytest.approx(0.3)


def test_threshold_leans_to_precision():
    scores = [(0.9, 1.0, 10), (0.8, 1.0, 10), (0.1, 0.0, 100), (0.05, 1.0, 1)]
    assert toxicity._best(scores) == pytest.approx(0.45) and toxicity._best([]) == 1.0
    # With hardly any ratings flagging everything is never the best.
    assert toxicity._best([(0.5, 1.0, 1), (0.2, 0.0, 50), (0.1, 1.0, 1)]) > 0.2


def test_reposts_are_no_evidence():
    rows = [(f"the {w} soup is vile and cold", 3, 0, [7]) for w in WORDS]
    assert toxicity.telling_shingles(rows, (50, 500)) == set()
    assert "vile" in toxicity.telling_shingles([(w, n, o, [i]) for i, (w, n, o, _) in enumerate(rows)], (50, 500))


def test_windows():
    assert toxicity.plain_window("You f.u.c.k.i.n.g IDIOOOOT") == "you fucking idiot"
    assert toxicity.plain_window("d1ckh3ad and 123") == "dickhead and 9"
    assert all(len(w) <= toxicity.WINDOW_CHARS + 8 for w in toxicity.windows_of("word " * 1000)) and toxicity.windows_of("") == []

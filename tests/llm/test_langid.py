import math
import random
from collections import Counter

import numpy as np

from quirelake.llm import langid

WORDS = {"aa": "the and of that with from this are was edon ting ther shen", "bb": "der die und nicht mit ein eine auf schon ung keit lich", "cc": "el la que los con para una mente ción ado ido ñe"}


def rows(n, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        own = WORDS[lang].split()
        out.append((i, " ".join(rng.choice(own) + rng.choice(["", rng.choice(own)]) for _ in range(rng.randint(5, 60))), lang))
    return out


def grams(text):
    """Buckets of a text's n-grams in plain Python."""
    c = [0] + [ord(x) if langid._LETTER[min(ord(x), 0x30FF)] else 0 for x in text.lower()] + [0]
    m = 0xFFFFFFFF

    def end(h):
        h ^= h >> 15
        h = h * 0x2C1B3C6D & m
        return ((h ^ h >> 12) & m) >> 16

    two = [(a * 0x9E3779B1 & m) ^ (b * 0x85EBCA77 & m) for a, b in zip(c, c[1:])]
    return [end(h) for h, a, b in zip(two, c, c[1:]) if a or b] + [end(h ^ (d * 0xC2B2AE3D & m) ^ 0x5BD1E995) for h, b, d in zip(two, c[1:], c[2:]) if b]


def test_scores_equal_brute_force():
    train = rows(60)
    langs = sorted(WORDS)
    counts = np.zeros((langid.BUCKETS, 3))
    for _, t, l in train:
        for g in grams(t):
            counts[g, langs.index(l)] += 1
    model = langid.Model(langs, counts)
    texts = [t for _, t, _ in rows(30, 5)] + ["", "12 !!", "é", None]
    language, posterior, n = model.score(texts, 0.5)
    total = counts.sum(axis=0)
    for t, l, p, k in zip(texts, language, posterior, n):
        own = Counter(grams(t or ""))
        assert k == sum(own.values())
        s = [sum(x * math.log((counts[g, j] + langid.ALPHA) / (total[j] + langid.ALPHA * langid.BUCKETS)) for g, x in own.items()) for j in range(3)]
        if own and max(s) > -k * math.log(langid.BUCKETS):
            assert l == langs[int(np.argmax(s))] and abs(p - 1 / sum(math.exp(x - max(s)) for x in s)) < 1e-3


def test_held_out_accuracy(spark):
    docs = spark.createDataFrame(rows(400), "doc_id long, text string, lang string")
    model = langid.train(docs.where("doc_id % 2 = 0"))
    got = langid.identify(docs.where("doc_id % 2 = 1"), model).join(docs, "doc_id")
    assert got.where("language = lang").count() >= 0.97 * got.count()


def test_edges(spark):
    schema = "doc_id long, text string, lang string, language int, posterior string"
    data = [(i, t, l, 1, "x") for i, t, l in rows(50)] + [(100, None, "aa", 1, None), (101, "", None, None, None), (None, "the and of that with from", None, 1, "y"), (102, "!!! 123", "aa", 1, "z"), (103, "the and " * 100_000, None, 1, "z"), (0, *rows(50)[0][1:], 1, "x")]
    docs = spark.createDataFrame(data, schema)
    got = langid.identify(docs).collect()
    assert len(got) == len(data)
    assert {r.doc_id for r in got if r.language == "und"} == {100, 101, 102}
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and kept.count() == len(data) - 3
    empty = spark.createDataFrame([], schema)
    assert langid.identify(empty).count() == 0 and langid.keep_known(empty).count() == 0
    unlabelled = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert langid.identify(unlabelled).first().language == "und"

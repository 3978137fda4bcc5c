import math
import random
from collections import Counter

import pytest

from quirelake.llm import suffix_tree as st
from quirelake.llm.queries import op6_lm_scoring


def texts(n=60, seed=1):
    rng = random.Random(seed)
    parts = ["the ", "cat ", "sat ", "internationally ", "interns ", "été ", "42 ", "\n", "Ωμέγα ", "人工 "]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 80))) for _ in range(n)]


class Brute:
    """The same rules by dictionaries."""

    def __init__(self, corpus, min_count, divergence, smoothing):
        self.smoothing, self.n, self.total = smoothing, Counter(), Counter()
        for t in corpus:
            s = b"\xff" * st.ORDER + t.encode()
            for i in range(st.ORDER, len(s)):
                for d in range(st.ORDER + 1):
                    self.n[s[i - d : i], s[i]] += 1
                    self.total[s[i - d : i]] += 1
        self.kept = {c for c in self.total if len(c) <= st.LOW}
        for c, own in self.total.items():
            if len(c) > st.LOW and own >= min_count:
                gain = sum(k * math.log((k / own) / (self.n[c[1:], x] / self.total[c[1:]])) for x in range(256) if (k := self.n[c, x]))
                if gain >= divergence:
                    self.kept |= {c[i:] for i in range(len(c) - st.LOW + 1)}

    def p(self, c, x):
        below = self.p(c[1:], x) if c else 1 / 256
        return (self.n[c, x] + self.smoothing * below) / (self.total[c] + self.smoothing)

    def bits(self, t):
        s = b"\xff" * st.ORDER + t.encode()
        out = 0.0
        for i in range(st.ORDER, len(s)):
            d = next((d for d in range(st.ORDER, st.LOW, -1) if s[i - d : i] in self.kept), st.LOW)
            out -= math.log2(self.p(s[i - d : i], s[i]))
        return out


def check(got, brute, corpus):
    for r in got:
        t = corpus[r.doc_id]
        assert r.symbols == len(t)
        assert r.bits == pytest.approx(brute.bits(t), abs=len(t.encode()) / st.UNIT)


def test_scores_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(st, "CHUNK", 1500)
    monkeypatch.setattr(st, "FAN", 3)
    corpus = texts() + ["", "a"]
    docs = spark.createDataFrame(list(enumerate(corpus)), "doc_id long, text string").repartition(3)
    brute = Brute(corpus, 5, 2.0, 4.0)
    assert {len(c) for c in brute.kept} == set(range(st.ORDER + 1))
    got = st.score(docs, min_count=5, divergence=2.0).collect()
    assert len(got) == len(corpus)
    check(got, brute, corpus)


def test_another_corpus(spark):
    corpus, others = texts(40), texts(10, 9) + ["zebra çok 北京", "the cat"]
    docs = spark.createDataFrame(list(enumerate(others)), "doc_id long, text string")
    got = st.score(docs, spark.createDataFrame([(i, t) for i, t in enumerate(corpus)], "doc_id long, text string"), min_count=5, divergence=2.0).collect()
    check(got, Brute(corpus, 5, 2.0, 4.0), others)
    none = st.score(docs, spark.createDataFrame([], "doc_id long, text string")).collect()
    assert all(abs(r.bits - 8 * len(others[r.doc_id].encode())) < 1e-6 for r in none)


@pytest.mark.parametrize("seen, other", [("été ", "ütü "), ("один ", "окно "), ("人工 ", "大小 "), ("1234 ", "9876 ")])
def test_query_tells_letters_of_every_script_apart(spark, tmp_path, seen, other):
    spark.createDataFrame([(i, seen * 40) for i in range(40)] + [(99, other * 40)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.bits_per_symbol for r in op6_lm_scoring(spark, str(tmp_path)).collect()}
    assert got[99] > 1.5 * got[0]


def test_edges(spark):
    rows = [(1, None, 0, "x"), (2, "", 1, None), (None, "some text", None, None), (3, "long " * 200_000, 2, "y"), (3, "long " * 200_000, 2, "y")]
    got = st.score(spark.createDataFrame(rows, "doc_id long, text string, chunk int, bits string")).collect()
    assert sorted((r.doc_id or 0, r.symbols, r.bits_per_symbol is None) for r in got) == [(0, 9, False), (1, 0, True), (2, 0, True), (3, 1_000_000, False), (3, 1_000_000, False)]
    assert st.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert st.score(spark.createDataFrame([(1, None)], "doc_id long, text string")).first().symbols == 0

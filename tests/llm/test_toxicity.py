import random

import numpy as np

from quirelake.llm import toxicity

INSULTS = "idiot moron stupid pathetic worthless disgusting loser clown scum trash".split()


def prose(rng, n):
    return [rng.choice("abcdefghij") + rng.choice("ouie") + rng.choice("lmnrst") + rng.choice(["", "ing", "er", "o"]) for _ in range(n)]


def fixture(n=900, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = prose(rng, rng.randint(20, 150))
        toxic = i % 12 == 0
        if toxic:
            for _ in range(rng.randint(2, 6)):
                at = rng.randint(0, len(words))
                words[at:at] = rng.choice([["this"], ["you", "are"], []]) + [rng.choice(INSULTS)]
        rows.append((i, " ".join(words) + ("!" * 60 if i % 17 == 0 else ""), toxic))
    return rows


def test_planted_found_and_clean_left(spark):
    rows = fixture()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r.doc_id for r in toxicity.toxic_documents(docs).collect()}
    want = {i for i, _, t in rows if t}
    assert len(got & want) >= 0.97 * len(want)
    assert len(got - want) <= 0.003 * len(rows)


def test_label_model_recovers_rates_and_dependence():
    rng = np.random.default_rng(0)
    n, voters = 60_000, toxicity.Voters().names
    y = rng.random(n) < 0.1
    votes = np.zeros((n, len(voters)), int)
    rates = {0: (0.6, 0.005), 1: (0.5, 0.01), 2: (0.4, 0.002), 3: (0.5, 0.004), 14: (0.05, 0.05)}
    for k, (a, b) in rates.items():
        votes[:, k] = rng.random(n) < np.where(y, a, b)
    votes[:, 10] = np.where(rng.random(n) < 0.9, votes[:, 3], 0)  # a voter that follows another
    masks, counts = np.unique((votes << np.arange(len(voters))).sum(axis=1), return_counts=True)
    m = toxicity.fit_label_model(masks, counts, voters)
    assert abs(m.prior - 0.1) < 0.02
    assert m.parent[10] == 3 or m.parent[3] == 10
    for k in (0, 1, 2):
        if m.parent[k] < 0:
            assert abs(m.rates[1, 0, k] - rates[k][0]) < 0.06
    q = m.posterior((votes << np.arange(len(voters))).sum(axis=1))
    assert ((q > 0.5) == y).mean() > 0.97


def test_posterior_equals_brute_force():
    rng = np.random.default_rng(1)
    rates, parent = rng.uniform(0.05, 0.9, (2, 2, 4)), np.array([-1, 0, 0, 2])
    for mask in range(16):
        v = [(mask >> k) & 1 for k in range(4)]
        like = []
        for c, p in ((0, 0.7), (1, 0.3)):
            for k in range(4):
                r = rates[c, v[parent[k]] if parent[k] >= 0 else 0, k]
                p *= r if v[k] else 1 - r
            like.append(p)
        assert abs(toxicity._posterior(np.array([v]), 0.3, rates, parent)[0] - like[1] / sum(like)) < 1e-12


def test_edges(spark):
    schema = "doc_id long, text string, mask string, q double"
    rows = [(i, t, "m", 1.0) for i, t, _ in fixture(240)] + [(1000, None, None, None), (1001, "", None, None), (None, "you are stupid idiot scum " * 5, None, None), (1002, "plain words " * 100_000 + "you are a worthless pathetic idiot moron", None, None), (0, fixture(240)[0][1], "m", 1.0)]
    docs = spark.createDataFrame(rows, schema)
    got = [r.doc_id for r in toxicity.toxic_documents(docs).collect()]
    assert None in got and 1002 in got and got.count(0) == 2 and not {1000, 1001} & set(got)
    kept = toxicity.keep_clean(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - len(got)
    empty = spark.createDataFrame([], schema)
    assert toxicity.toxic_documents(empty).count() == 0 and toxicity.keep_clean(empty).count() == 0
    calm = spark.createDataFrame([(1, "nothing here to see")], "doc_id long, text string")
    assert toxicity.toxic_documents(calm).count() == 0 and toxicity.keep_clean(calm).count() == 1


def stem_fixture(n=1200, seed=5):
    """Texts in two made languages; toxic ones have the head "zorv" or "kelm" on some words, clean ones now and then."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = prose(rng, rng.randint(60, 160))
        toxic = i % 8 == 0
        for _ in range(len(words) // 15 + 2 if toxic else rng.random() < 0.1):
            words[rng.randrange(len(words))] = rng.choice(["zorv", "kelm"]) + rng.choice(prose(rng, 5))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_stems_mined_from_part_find_the_rest(spark):
    rows = stem_fixture()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows if i % 3], "doc_id long, toxic int")
    model = toxicity.train(docs, labels=labels)
    assert model.stems and {s.size for s in model.stems} <= {0, *toxicity.HEADS}
    got = {r.doc_id for r in toxicity.toxic_documents(docs, model).collect()}
    held = {i for i, _, t in rows if t and i % 3 == 0}
    assert len(got & held) >= 0.95 * len(held)
    assert len(got - {i for i, _, t in rows if t}) <= 0.005 * len(rows)
    assert toxicity.toxic_documents(docs).count() == 0  # no label, no stem


def test_stem_votes_equal_brute_force():
    rng = random.Random(4)
    texts = ["", None, "zorvo", *(t for _, t, _ in stem_fixture(60))]
    heads = {w: int(toxicity.textscan.scan([w], (4,)).heads[4][0]) for w in ("zorv", "kelm")}
    for least, share in ((1, 0.0), (2, 0.0), (2, 0.05), (3, 0.02)):
        own = rng.choice([["zorv"], ["kelm"], ["zorv", "kelm"]])
        v = toxicity.Voters([toxicity.Stem(4, tuple(heads[w] for w in own), least, share)])
        got = (v.votes(texts, v.scan(texts)) >> (len(v.names) - 1)) & 1
        for t, g in zip(texts, got):
            words = (t or "").split()
            hits = sum(w[:4] in own for w in words)
            assert g == (hits >= least and hits >= share * len(words))


def test_labels_with_nulls_doubles_and_strangers(spark):
    rows = stem_fixture(400)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(None, "zorvo kelmo"), (7, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t, 1) for i, _, t in rows] + [(None, 1, 1), (3, None, 0), (99_999, 1, 1), (0, 0, 0)], "doc_id long, toxic int, text int")
    assert toxicity.toxic_documents(docs, labels=labels).count() >= 45
    none = spark.createDataFrame([], labels.schema)
    assert toxicity.toxic_documents(docs, labels=none).count() == 0
    assert toxicity.keep_clean(docs, labels=labels).columns == docs.columns


def test_forest_takes_every_edge_that_closes_no_circle():
    information = np.zeros((5, 5))
    information[0, 1], information[2, 3], information[1, 3], information[0, 3] = 5, 4, 3, 2
    assert toxicity.forest(information, 0.1).tolist() == [-1, 0, 3, 1, -1]

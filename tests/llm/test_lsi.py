import random
import tracemalloc

import numpy as np

from quirelake.llm import lsi, textscan

SYLLABLES = ["ba", "ko", "ri", "tu", "ne", "sha", "lo", "mi", "ver", "dan", "pu", "gre"]
COMMON = ["the", "of", "and", "to", "in", "is", "that"]


def sentence(rng, n):
    return " ".join(rng.choice(COMMON) if rng.random() < 0.35 else "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(2, 4))) for _ in range(n))


def fixture(seed=1):
    rng = random.Random(seed)
    items = [(k, sentence(rng, rng.randint(16, 60)) + ". " + sentence(rng, 8) + ".") for k in range(25)]
    docs, planted = [], set()
    for i in range(240):
        text = sentence(rng, rng.randint(20, 400))
        if i % 4 == 0:
            k = rng.randrange(25)
            leak = items[k][1].split()
            if i % 8 == 0:  # a paraphrase: one word in eight is another
                leak = [sentence(rng, 1) if rng.random() < 0.12 else w for w in leak]
            at = rng.randint(0, len(text.split()))
            words = text.split()
            text = " ".join(words[:at] + leak + words[at:])
            planted.add((i, k))
        docs.append((i, text))
    return docs, items, planted


def brute(index, docs):
    """Coverage of every item in every stretch of every document, without the latent space."""
    found = set()
    for i, text in docs:
        own = index.items.numbers(textscan.word_hashes(text))
        for k, item in enumerate(index.items.words):
            for start in range(0, max(1, len(own)), lsi.STRIDE):
                cover, hit = index.coverage(k, own[max(0, start - len(item)) : start + lsi.WINDOW + len(item)])
                if cover >= lsi.PARAPHRASE and (cover >= lsi.COVERAGE or hit >= lsi.ANSWER):
                    found.add((i, index.items.ids[k]))
                    break
    return found


def test_recall_against_brute_force_and_planted(spark):
    docs, items, planted = fixture()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    index, _ = lsi.build(d, b)
    got = {(r.doc_id, r.item_id) for r in lsi.contamination(d, b).collect()}
    want = brute(index, docs)
    assert got <= want
    assert len(got & want) >= 0.9 * len(want)
    assert planted <= got
    assert {i for i, _ in got} == {i for i, _ in planted}


def test_bag_bound_never_below_coverage():
    docs, items, _ = fixture(4)
    table = lsi.Items.of(items)
    n = len(table.vocabulary)
    words = textscan.scan([t for _, t in docs])
    numbers = table.numbers(words.hash)
    passage, word, _, base = lsi.incidence(numbers, words.bounds)
    df = np.bincount(word, minlength=n)
    idf = np.where((df > 0) & (df <= 60), np.log1p(base[-1] / np.maximum(df, 1)), 0.0)
    index = lsi.Index(table, idf, np.zeros((n, 1), np.float32), np.zeros((0, 1)), np.arange(0), lsi.common_words(df, 40))
    index.prepare()
    index.block(0, len(items))
    first, passage, word, _ = lsi._matrix(numbers, words.bounds, idf)
    number, ends = passage[first], np.r_[first, len(word)]
    of = np.searchsorted(base, number, side="right") - 1
    row_of = np.full(int(base[-1]) + 1, -1)
    row_of[number] = np.arange(len(first))
    rng = np.random.default_rng(0)
    row, item = rng.integers(0, len(first), 400), rng.integers(0, len(items), 400)
    held = lsi._project(first, word, np.ones(len(word), np.float32), index.shares, index.common)
    assert np.allclose(held, lsi._project(first, word, np.ones(len(word), np.float32), index.shares, lsi.common_words(df, 0)), atol=1e-5)
    bound = index.bound(row, item, number, of, base, row_of, held, 0)
    for r, k, b in zip(row, item, bound):
        d = of[r]
        start, more = (number[r] - base[d]) * lsi.STRIDE, len(table.words[k])
        text = numbers[words.bounds[d] + max(0, start - more) : min(words.bounds[d] + start + lsi.WINDOW + more, words.bounds[d + 1])]
        assert index.coverage(int(k), text)[0] <= b + 1e-5
        assert np.isclose(index.covers(np.array([k]), text, np.array([0]), np.array([len(text)]), 0.0)[0], index.coverage(int(k), text)[0])


def test_singular_vectors_equal_exact_ones():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((400, 6)) @ np.diag([9, 7, 5, 4, 3, 2]) @ rng.standard_normal((6, 50))
    omega = rng.standard_normal((50, 16))
    v = lsi.right_singular_vectors(a.T @ (a @ omega), omega, 6)
    exact = np.linalg.svd(a)[2][:6].T
    assert np.allclose(np.abs(np.linalg.svd(v.T @ exact)[1]), 1, atol=1e-6)


def test_edge_cases(spark):
    d = "doc_id long, text string, item_id string, words int"
    item = "zorble quandix thrumpel vexol narbit plugh wimdon grelt oskarn dwiple. the answer is fruxilon kelvarit."
    rows = [(1, item, "a", 1), (1, item, "a", 1), (2, None, None, None), (3, "", "b", 2), (None, item, "c", 3), (4, "the and " * 50_000, None, None), (5, "x " * 3000 + item, None, None)]
    docs = spark.createDataFrame(rows, d)
    bench = spark.createDataFrame([(7, item, 1), (8, None, 1), (9, "", 1), (None, item, 1)], "item_id long, text string, doc_id int")
    got = lsi.contamination(docs, bench)
    assert sorted((r.doc_id or 0, r.item_id) for r in got.collect()) == [(0, 7), (1, 7), (5, 7)]
    kept = lsi.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 3, 4]
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert lsi.contamination(docs, nothing).count() == 0
    assert lsi.decontaminate(docs, nothing).count() == len(rows)
    assert lsi.contamination(spark.createDataFrame([], d), bench).count() == 0


def test_item_copied_into_many_documents_is_found_in_all(spark):
    docs, items, _ = fixture()
    docs = [(i, f"{t} {items[3][1]}" if i % 2 else t) for i, t in docs]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in lsi.contamination(d, b).collect()}
    assert {(i, 3) for i, _ in docs if i % 2} <= got


def test_blocks_of_items_change_nothing(spark, monkeypatch):
    docs, items, _ = fixture(7)
    index, encoded = lsi.build(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    rows = encoded.toArrow().to_batches()

    def found():
        return sorted((i, k, round(c, 6), round(h, 6), s) for own in lsi._documents(iter(rows), np.uint16) for i, k, _, c, h, s in index.match(*own, lsi.COSINE, lsi.COVERAGE, lsi.PARAPHRASE, lsi.ANSWER))

    whole = found()
    monkeypatch.setattr(lsi, "BLOCK_CELLS", 3 * len(index.idf))
    assert whole and found() == whole


def test_verbatim_items_of_every_length_are_found(spark):
    rng = random.Random(9)
    items = [(n, sentence(rng, n)) for n in range(1, 25)]
    others = [(100 + i, sentence(rng, 300)) for i in range(60)]
    docs = others + [(n, f"{sentence(rng, 150)} {t} {sentence(rng, 150)}") for n, t in items]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in lsi.contamination(d, b).collect()}
    assert {(i, n) for i, text in docs for n, t in items if f" {t} " in f" {text} "} <= got


def test_projection_takes_little_memory_besides_its_result():
    rng = np.random.default_rng(2)
    n, size = 1 << 14, 900
    word = np.sort(np.minimum(rng.integers(0, size, (n, 20)), rng.integers(0, size, (n, 20))), axis=1).ravel()
    value, first = rng.random(len(word)).astype(np.float32), np.arange(0, n * 20, 20)
    basis, common = rng.standard_normal((size, 256)).astype(np.float32), lsi.common_words(np.bincount(word, minlength=size), 64)
    tracemalloc.start()
    got = lsi._project(first, word, value, basis, common)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    rows = np.zeros((n, size), np.float32)
    keep = np.r_[True, (word[1:] != word[:-1]) | (np.arange(1, len(word)) % 20 == 0)]
    np.add.at(rows, (np.repeat(np.arange(n), 20)[keep], word[keep]), value[keep])
    again = lsi._project(np.r_[0, np.cumsum(np.add.reduceat(keep, first))[:-1]], word[keep], value[keep], basis, common)
    assert np.allclose(again, rows @ basis, atol=1e-3)
    assert peak < 2 * got.nbytes


def test_pairs_left_out_of_the_search_cover_too_little(monkeypatch):
    rng = random.Random(11)
    items = [(k, sentence(rng, n)) for k, n in enumerate([1, 3, 15, 24, 25, 40, 48, 49, 90, 130, 260])]
    texts = ["", sentence(rng, 5), sentence(rng, 24), sentence(rng, 25)]
    for _, item in items:
        kept = [w if rng.random() < 0.6 else sentence(rng, 1) for w in item.split()]
        texts += [" ".join(kept), f"{sentence(rng, rng.randint(0, 70))} {' '.join(kept)} {sentence(rng, rng.randint(0, 70))}"]
    table = lsi.Items.of(items)
    words = textscan.scan(texts)
    numbers = table.numbers(words.hash)
    _, word, _, base = lsi.incidence(numbers, words.bounds)
    df = np.bincount(word, minlength=len(table.vocabulary))
    idf = np.where(df > 0, np.log1p(base[-1] / np.maximum(df, 1)), 0.0)
    for columns, own in ((lsi.COLUMNS, lsi.OWN), (64, 40)):
        monkeypatch.setattr(lsi, "COLUMNS", columns)
        monkeypatch.setattr(lsi, "OWN", own)
        index = lsi.Index(table, idf, np.zeros((len(df), 1), np.float32), np.zeros((len(items), 1), np.float32), np.arange(len(items)), lsi.common_words(df, 40))
        index.prepare()
        index.block(0, len(items))
        least = lsi.PARAPHRASE - 1e-5
        listed = {(int(p), int(k)) for number, item in index.possible(numbers, words.bounds, base, least) for p, k in zip(number, item)}
        high = set()
        for d in range(len(texts)):
            for p in range(base[d], base[d + 1]):
                start = (p - base[d]) * lsi.STRIDE
                for k, item in enumerate(table.words):
                    text = numbers[words.bounds[d] + max(0, start - len(item)) : min(words.bounds[d] + start + lsi.WINDOW + len(item), words.bounds[d + 1])]
                    if index.coverage(k, text)[0] >= lsi.PARAPHRASE:
                        high.add((p, k))
        assert high and high <= listed


def test_only_passages_that_may_hold_an_item_are_projected(spark, monkeypatch):
    docs, items, planted = fixture(3)
    index, encoded = lsi.build(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    parts = list(lsi._documents(iter(encoded.toArrow().to_batches()), np.uint16))
    project, rows = lsi._project, []
    monkeypatch.setattr(lsi, "_project", lambda first, *rest: rows.append(len(first)) or project(first, *rest))
    found = {(i, k) for own in parts for i, k, *_ in index.match(*own, lsi.COSINE, lsi.COVERAGE, lsi.PARAPHRASE, lsi.ANSWER)}
    assert planted <= found
    assert sum(rows) < 0.5 * sum(int(lsi.passages(np.diff(bounds)).sum()) for _, _, bounds in parts)

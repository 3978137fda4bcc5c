import random

import numpy as np
import pytest

from quirelake.llm import neardup, textscan

WORDS = [f"w{a}{b}" for a in "bcdfghklmnprst" for b in "aeiouxyz" for _ in range(1)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def edited(rng, text, k):
    words = text.split()
    for i in rng.sample(range(len(words)), k):
        words[i] = rng.choice(WORDS) * 2
    return " ".join(words)


def corpus(seed=3):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randint(40, 300))) for i in range(150)]
    for i in range(0, 60, 3):
        text = rows[i][1]
        rows += [(1000 + 10 * i + k, edited(rng, text, max(1, len(text.split()) // 40))) for k in range(rng.randint(1, 4))]
    rows += [(5000 + k, rows[1][1]) for k in range(30)]
    return rows


def brute(rows, radius=neardup.RADIUS):
    hi, lo, size = neardup.fingerprints([t for _, t in rows])
    near = np.bitwise_count(hi[:, None] ^ hi) + np.bitwise_count(lo[:, None] ^ lo) <= radius
    near &= np.minimum(size[:, None], size) >= neardup.RATIO * np.maximum(size[:, None], size)
    label = list(range(len(rows)))
    ids = [i for i, _ in rows]
    changed = True
    while changed:
        changed = False
        for i, j in zip(*np.nonzero(near)):
            m = min(label[i], label[j], key=lambda k: ids[k])
            changed |= label[i] != m or label[j] != m
            label[i] = label[j] = m
    groups = {}
    for i, m in enumerate(label):
        groups.setdefault(ids[m], []).append(ids[i])
    return {(i, g, len(m)) for g, m in groups.items() if len(m) > 1 for i in m}


def test_groups_equal_brute_force(spark):
    rows = corpus()
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shard_rows=16)
    assert {tuple(r) for r in got.collect()} == brute(rows)


def test_planted_copies_found_and_others_left(spark):
    rows = corpus(8)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    ids = {r.doc_id for r in got}
    assert {i for i, _ in rows if i >= 1000} <= ids
    assert not {i for i in range(61, 150)} & ids


@pytest.mark.parametrize("seed", range(3))
def test_shard_pairs_are_all_pairs(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, 40, np.uint64)
    hi = np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(8)] + [base])
    lo = np.zeros_like(hi)
    order = np.argsort(hi & np.uint64(0xFFFF), kind="stable")
    hi, size, home = hi[order], np.ones(len(hi), np.int32), np.ones(len(hi), bool)
    for block in range(8):
        w, s = neardup._LANES[block]
        order = np.argsort(((hi, lo)[w] >> np.uint64(s)) & np.uint64(0xFFFF), kind="stable")
        h, l = hi[order], lo[order]
        got = {tuple(sorted(p)) for i, j in neardup.shard_pairs(block, home, h, l, size, 16) for p in zip(i.tolist(), j.tolist())}
        value = ((h, l)[w] >> np.uint64(s)) & np.uint64(0xFFFF)
        want = {(i, j) for i in range(len(h)) for j in range(i + 1, len(h)) if np.bitwise_count(value[i] ^ value[j]) <= 2 and np.bitwise_count(h[i] ^ h[j]) <= 16}
        assert got == want


def test_routing_meets_every_close_pair():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 5, 1 << 16)
    tree = neardup.Tree(counts, 5, 2)
    own = np.full(1 << 16, -1)
    sees = [set() for _ in range(1 << 16)]
    for v in range(1 << 16):
        for k in range(tree.offsets[v], tree.offsets[v + 1]):
            sees[v].add(int(tree.leaf[k]))
            if tree.home[k]:
                own[v] = tree.leaf[k]
    assert (own >= 0).all()
    for v in rng.integers(0, 1 << 16, 400):
        for d in [1 << a | 1 << b for a in range(16) for b in range(16)]:
            assert own[v] in sees[v ^ d] or own[v ^ d] in sees[v]


def test_edge_cases(spark):
    schema = "doc_id long, text string, group_id string, u int, node double"
    long = "alpha beta gamma delta " * 100_000
    rows = [(1, "", "x", 1, None), (2, None, None, None, None), (None, "some words here", "y", 2, 1.0), (3, "!!!", None, 1, 1.0), (4, "!!!", None, 1, 1.0), (5, long, None, 1, 1.0), (6, long, None, 1, 1.0), (7, "one two three four five", None, 1, 1.0), (7, "one two three four five", None, 1, 1.0)]
    docs = spark.createDataFrame(rows, schema)
    got = {tuple(r) for r in neardup.near_duplicates(docs).collect()}
    assert got == {(3, 3, 2), (4, 3, 2), (5, 5, 2), (6, 5, 2)}
    kept = neardup.dedup(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 5, 7]
    empty = spark.createDataFrame([], schema)
    assert neardup.near_duplicates(empty).count() == 0
    assert neardup.dedup(empty).count() == 0


def test_word_scan_positions():
    texts = ["Ab c_1, É«x»—y", None, "", "z" * 10 + " " + "Q" * 3]
    w = textscan.scan(texts)
    assert np.diff(w.bounds).tolist() == [5, 0, 0, 2]
    assert (w.hash[:2] == textscan.word_hashes("ab! c_1")).all()
    assert w.start[5:].tolist() == [0, 11] and w.end[5:].tolist() == [10, 14]


def test_groups_by_size_bands_equal_brute_force(spark):
    rows = corpus(5)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shard_rows=16, band_rows=20)
    assert {tuple(r) for r in got.collect()} == brute(rows)


def test_far_sizes_share_no_shard():
    rng = np.random.default_rng(4)
    n = 4000
    hi, lo = (rng.integers(0, 1 << 63, n, np.uint64) for _ in range(2))
    size = np.exp(rng.normal(5.5, 1, n)).astype(np.int32)
    close = rng.integers(0, n // 2, n // 2) + n // 2
    hi[: n // 2], lo[: n // 2], size[: n // 2] = hi[close] ^ np.uint64(1 << 40), lo[close], size[close] * rng.uniform(0.7, 1.3, n // 2)
    levels = list(zip(*(x.tolist() for x in np.unique(size, return_counts=True))))
    edges = neardup.size_bands(levels, 300)
    assert len(edges) > 3 and (edges[1:] * neardup.RATIO >= edges[:-1]).all()
    trees = [neardup.Tree(np.ones(1 << 16), 3, 2) for _ in range(8)]
    shards = {}
    for shard, block, data in neardup._shards(trees, edges)(np.arange(n), hi, lo, size):
        shards.setdefault(shard, (block, []))[1].append(data)
    found, met = set(), 0
    for block, data in shards.values():
        rows = np.frombuffer(b"".join(data), neardup.ROW)
        home, upper = rows["role"] & neardup.HOME > 0, rows["role"] & neardup.UPPER > 0
        met += int((home & ~upper).sum()) * len(rows) + int((home & upper).sum()) * int((~upper).sum())
        for i, j in neardup.shard_pairs(block, home, rows["hi"], rows["lo"], rows["size"], 23, upper):
            found |= {tuple(sorted(p)) for p in zip(rows["doc_id"][i].tolist(), rows["doc_id"][j].tolist())}
    near = np.bitwise_count(hi[:, None] ^ hi) + np.bitwise_count(lo[:, None] ^ lo) <= 23
    near &= np.minimum(size[:, None], size) >= neardup.RATIO * np.maximum(size[:, None], size)
    assert found == {(i, j) for i, j in zip(*(x.tolist() for x in np.nonzero(near))) if i < j}
    # without bands every two fingerprints of a leaf meet
    whole = sum(int(t.home[t.leaf == leaf].sum()) * int((t.leaf == leaf).sum()) for t in trees for leaf in range(8)) * (n / 65536) ** 2
    assert met < 0.5 * whole


def test_scan_of_many_texts_takes_little_memory():
    import tracemalloc

    from quirelake.llm import langid

    texts = [" ".join(f"{w}{i % 97}x{k % 89}" for k, w in enumerate(WORDS * 3)) for i in range(4000)]
    model = langid.Model(["a", "b"], np.ones((langid.BUCKETS, 2)))
    for run, most in ((lambda: neardup.fingerprints(texts), 80), (lambda: model.score(texts, 0.5), 40)):
        tracemalloc.start()
        run()
        peak = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        assert peak < most


@pytest.mark.parametrize("share", [1.0, 0.5])
def test_pairs_at_home_are_compared_once_and_only_at_near_sizes(monkeypatch, share):
    rng = np.random.default_rng(6)
    n = 12_000
    hi, lo = (rng.integers(0, 1 << 63, n, np.uint64) & np.uint64(0xFFFFFFFFFFFF0FFF) for _ in range(2))
    size = np.exp(rng.uniform(3, 3.6, n)).astype(np.int32)
    close = rng.integers(0, n // 2, n // 2) + n // 2
    hi[: n // 2], lo[: n // 2] = hi[close] ^ (np.uint64(1) << rng.integers(0, 16, n // 2).astype(np.uint64)), lo[close] ^ np.uint64(1 << 40)
    home, upper = rng.random(n) < share, size >= 27
    cuts, compared = neardup._cuts, []
    monkeypatch.setattr(neardup, "_cuts", lambda work, most: compared.append(int(work.sum())) or cuts(work, most))
    got = {tuple(sorted(p)) for i, j in neardup.shard_pairs(0, home, hi, lo, size, 23, upper) for p in zip(i.tolist(), j.tolist())}
    value = ((hi >> np.uint64(neardup._LANES[0][1])) & np.uint64(0xFFFF)).astype(np.int64)
    before, want = 0, set()
    for a in range(0, n, 2000):
        one = np.arange(a, a + 2000)[:, None]
        meet = home[one] & ~(upper[one] & upper)
        ball = np.bitwise_count(value[one] ^ value) <= 2
        before += int((meet & ball).sum())  # at any sizes, and a pair at home from both sides
        near = np.bitwise_count(hi[one] ^ hi) + np.bitwise_count(lo[one] ^ lo) <= 23
        i, j = np.nonzero(meet & ball & near & (np.minimum(size[one], size) >= 0.8 * np.maximum(size[one], size)))
        want |= {tuple(sorted(p)) for p in zip((i + a).tolist(), j.tolist()) if p[0] != p[1]}
    assert len(want) > 300 and got == want
    assert sum(compared) < 0.8 * before

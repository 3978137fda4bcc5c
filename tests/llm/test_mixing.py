import random
from collections import defaultdict

import pytest

from quirelake.llm import mixing


def slow_flow(capacity, pools, quota, costs):
    """One token at a time along the cheapest path of the residual graph, by Bellman-Ford."""
    names = sorted(quota)
    used = [[0] * len(costs) for _ in capacity]
    flow = defaultdict(int)
    cost = 0
    while True:
        best = None
        dist = {}
        back = {}
        for i, t in enumerate(capacity):
            k = next((k for k in range(len(costs)) if used[i][k] < t), None)
            if k is not None:
                dist["p", i] = costs[k]
                back["p", i] = None
        for _ in range(2 * (len(capacity) + len(names)) + 2):
            for i in range(len(capacity)):
                for p in set(pools[i]):
                    if p in quota:
                        if ("p", i) in dist and dist["p", i] < dist.get(("s", p), 1e9):
                            dist["s", p], back["s", p] = dist["p", i], ("p", i)
                        if flow[i, p] and ("s", p) in dist and dist["s", p] < dist.get(("p", i), 1e9):
                            dist["p", i], back["p", i] = dist["s", p], ("s", p)
        for p in names:
            if ("s", p) in dist and sum(flow[i, p] for i in range(len(capacity))) < quota[p] and (best is None or dist["s", p] < dist["s", best]):
                best = p
        if best is None:
            return sum(flow.values()), cost
        cost += dist["s", best]
        node = ("s", best)
        while back[node] is not None:
            before = back[node]
            if node[0] == "s":
                flow[before[1], node[1]] += 1
            else:
                flow[node[1], before[1]] -= 1
            node = before
        i = node[1]
        used[i][next(k for k in range(len(costs)) if used[i][k] < capacity[i])] += 1


@pytest.mark.parametrize("seed", range(25))
def test_flow_is_the_cheapest_largest(seed):
    rng = random.Random(seed)
    names = ["a", "b", "c", "d"]
    capacity = [rng.randint(0, 6) for _ in range(rng.randint(1, 5))]
    pools = [rng.sample(names, rng.randint(1, 3)) for _ in capacity]
    quota = {p: rng.randint(0, 12) for p in rng.sample(names, rng.randint(1, 4))}
    got = mixing.solve(capacity, pools, quota, (0, 1, 3))
    assert (sum(got.amount.values()), got.cost) == slow_flow(capacity, pools, quota, (0, 1, 3))
    for p in quota:
        assert sum(n for (_, q), n in got.amount.items() if q == p) <= quota[p]


def brute(rows, budget, temperature, seed, draw):
    """Selection by walking each pattern's documents."""
    by = defaultdict(list)
    for doc, text, source, lang in rows:
        pools = sorted({p for p in (source, None if lang is None else f"lang:{lang}") if p is not None})
        tokens = -(-len((text or "").encode()) // 4)
        if pools and tokens:
            by[mixing.SEPARATOR.join(pools)].append((draw[doc], doc if doc is not None else -1, tokens))
    names = sorted(by)
    sizes = defaultdict(int)
    for n in names:
        for p in n.split(mixing.SEPARATOR):
            sizes[p] += sum(x[2] for x in by[n])
    total = sum(x[2] for n in names for x in by[n])
    flow = mixing.solve([sum(x[2] for x in by[n]) for n in names], [n.split(mixing.SEPARATOR) for n in names], mixing.quotas(sizes, int(budget * total), None, temperature))
    out = []
    for i, n in enumerate(names):
        size = sum(x[2] for x in by[n])
        for p, first, last in _intervals(i, n, flow):
            start = 0
            for _, doc, tokens in sorted(by[n], key=lambda x: (draw_key(x[0]), *x)):
                for k in range(5):
                    if first <= start + k * size < last:
                        out.append((doc, p, k, tokens))
                start += tokens
    return sorted(out)


def draw_key(d):
    return (d >> 40) % mixing.BUCKETS


def _intervals(i, n, flow):
    at = 0
    for p in sorted(n.split(mixing.SEPARATOR)):
        if k := flow.amount.get((i, p), 0):
            yield p, at, at + k
            at += k


@pytest.mark.parametrize("budget", [0.4, 1.0, 2.5])
def test_selection_equals_brute_force(spark, budget):
    rng = random.Random(7)
    rows = [(i, "x" * rng.randint(0, 400), rng.choice(["s1", "s2", "s3"]), rng.choice(["en", "de", None])) for i in range(200)]
    rows += [(300, None, "s1", "en"), (301, "text of no pool", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    draw = {r.doc_id: r.d for r in docs.selectExpr("doc_id", f"xxhash64(doc_id, {mixing.SEED}) d").collect()}
    got = sorted(tuple(r) for r in mixing.mix(docs, budget=budget).select("doc_id", "pool", "epoch", "tokens").collect())
    assert got == brute(rows, budget, mixing.TEMPERATURE, mixing.SEED, draw)


def test_edges(spark):
    schema = "doc_id long, text string, source string, lang string, pattern string, start int"
    rows = [(1, "a" * 40, "s", "en", "p", 1)] * 2 + [(None, "b" * 40, "s", "en", None, None), (2, None, None, None, None, None), (3, "", "s", "en", None, None), (4, "word " * 100_000, "t", None, None, 1)]
    got = mixing.mix(spark.createDataFrame(rows, schema)).collect()
    assert {r.doc_id for r in got} <= {None, 1, 4} and got
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(spark.createDataFrame(rows, schema), max_patterns=1)


def test_defaults_repeat_small_pools_cut_large_ones_and_carry_columns(spark):
    rng = random.Random(3)
    rows = [(i, "x" * rng.randint(40, 400), "big" if rng.random() < 0.9 else f"small{i % 3}", rng.choice(["en", "en", "en", "de"]), f"n{i}", i) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, note string, tokens int")
    got = mixing.mix(docs).collect()
    assert {(r.doc_id, r.text, r.note) for r in got} <= {(r[0], r[1], r[4]) for r in rows}
    assert all(r.tokens == -(-len(r.text) // 4) for r in got)
    assert len({r.doc_id for r in got}) < len(rows) and max(r.epoch for r in got) > 0
    assert len({(r.doc_id, r.epoch) for r in got}) == len(got)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        for p in (r[2], f"lang:{r[3]}"):
            sizes[p] += -(-len(r[1]) // 4)
    for r in got:
        taken[r.pool] += r.tokens
    quota = mixing.quotas(sizes, sum(-(-len(r[1]) // 4) for r in rows), None, mixing.TEMPERATURE)
    assert all(taken[p] <= quota[p] + 100 * 4 for p in quota)  # a pool's last document in each of its patterns
    assert sum(taken.values()) >= 0.9 * sum(quota.values())

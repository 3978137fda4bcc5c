"""Mixing of overlapping sources to target weights by min-cost flow.

Every document belongs to pools (by default its source and its language), and documents with the same
pools form a pattern. Tokens flow from patterns to the pools of each pattern: a pattern's first pass
is free, and each further pass over it costs more (``COSTS``, rising, so the cost is convex in
the amount). Pools take at most their quotas, budget times weight. The flow of most tokens, and among
these of least cost, is found exactly on the driver; its size is that of the patterns, not of the corpus,
and more than ``max_patterns`` of them is an error, not a cut.

Documents are laid out along each pattern in seeded order, pass after pass; the flow's amounts for
the pattern's pools (by name) cover a first part of that line, and each pass of a document whose first
token is covered is selected for the pool there. A pool is overdrawn by less than a document.

Positions are running sums in two levels, buckets of the seeded hash and rows within one, and rows are
placed only in the buckets in which an amount ends, so no window holds a whole pattern. What an amount
covers is then a range of keys; the documents are compared with the broadcast ranges as they are
read, and no text is shuffled.

With the defaults small pools weigh more than their share of the tokens, so large ones are cut and
small ones repeated.

Defined results: tokens are UTF-8 bytes over 4, rounded up; documents with null or empty text, or
with neither pool, are never selected. A null doc_id is selected like others. Repeated rows are selected
together or not at all. An empty table gives an empty result. Other columns are carried through, but for
those named pool, epoch or tokens, which give way.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirelake.session import materialize

COSTS = (0, 1, 3, 6)
BUDGET = 1.0
TEMPERATURE = 0.3
SEED = 17
BUCKETS = 4096
MAX_PATTERNS = 100_000
SEPARATOR = "\x1f"


def default_pools() -> Column:
    """A document's source and language."""
    return F.array_compact(F.array(F.col("source"), F.concat(F.lit("lang:"), F.col("lang"))))


@dataclass
class Flow:
    amount: dict[tuple[int, str], int]
    cost: int


def solve(capacity: Sequence[int], pools: Sequence[Sequence[str]], quota: dict[str, int], costs: Sequence[int] = COSTS) -> Flow:
    """The largest flow of least cost from patterns to pools, by successive shortest paths with potentials."""
    names = sorted(quota)
    place = {p: k for k, p in enumerate(names)}
    n = len(capacity)
    source, sink = n + len(names), n + len(names) + 1
    to: list[int] = []
    room: list[int] = []
    price: list[int] = []
    out: list[list[int]] = [[] for _ in range(sink + 1)]

    def arc(a: int, b: int, most: int, cost: int) -> None:
        for x, y, m, c in ((a, b, most, cost), (b, a, 0, -cost)):
            out[x].append(len(to))
            to.append(y)
            room.append(m)
            price.append(c)

    free = sum(quota.values()) + 1
    for i, t in enumerate(capacity):
        for c in costs:
            arc(source, i, t, c)
        for p in sorted(set(pools[i])):
            if p in place:
                arc(i, n + place[p], free, 0)
    for p in names:
        arc(n + place[p], sink, quota[p], 0)
    potential = [0] * (sink + 1)
    total = 0
    far = float("inf")
    while True:
        distance: list[float] = [far] * (sink + 1)
        back = [-1] * (sink + 1)
        distance[source] = 0
        heap = [(0, source)]
        while heap:
            d, v = heapq.heappop(heap)
            if d > distance[v]:
                continue
            for e in out[v]:
                if room[e] and (x := d + price[e] + potential[v] - potential[to[e]]) < distance[to[e]]:
                    distance[to[e]] = x
                    back[to[e]] = e
                    heapq.heappush(heap, (x, to[e]))
        if distance[sink] == far:
            break
        for v in range(sink + 1):
            if distance[v] < far:
                potential[v] += int(distance[v])
        # all paths of this length: depth-first over arcs without reduced cost
        level = _levels(out, to, room, price, potential, source, sink)
        while level[sink] >= 0:
            at = [0] * (sink + 1)
            while pushed := _push(out, to, room, price, potential, level, at, source, sink, free * 2):
                total += pushed * (potential[sink] - potential[source])
            level = _levels(out, to, room, price, potential, source, sink)
    amount = {}
    for i in range(n):
        for e in out[i]:
            if to[e] != source and to[e] >= n and room[e ^ 1]:
                amount[i, names[to[e] - n]] = room[e ^ 1]
    return Flow(amount, total)


def _levels(out, to, room, price, potential, source, sink) -> list[int]:
    level = [-1] * (sink + 1)
    level[source] = 0
    queue = [source]
    for v in queue:
        for e in out[v]:
            if room[e] and level[to[e]] < 0 and price[e] + potential[v] == potential[to[e]]:
                level[to[e]] = level[v] + 1
                queue.append(to[e])
    return level


def _push(out, to, room, price, potential, level, at, source, sink, most) -> int:
    path: list[int] = []
    v = source
    while v != sink:
        while at[v] < len(out[v]):
            e = out[v][at[v]]
            if room[e] and level[to[e]] == level[v] + 1 and price[e] + potential[v] == potential[to[e]]:
                break
            at[v] += 1
        else:
            if not path:
                return 0
            level[v] = -1
            v = to[path.pop() ^ 1]
            at[v] += 1
            continue
        path.append(e)
        v = to[e]
    amount = min(most, min(room[e] for e in path))
    for e in path:
        room[e] -= amount
        room[e ^ 1] += amount
    return amount


def quotas(sizes: dict[str, int], budget: int, weights: dict[str, float] | None, temperature: float) -> dict[str, int]:
    """Tokens of each pool: by the given weights, or by size to the power of the temperature."""
    share = {p: float(w) for p, w in weights.items()} if weights else {p: float(n) ** temperature for p, n in sizes.items()}
    total = sum(share.values())
    return {p: int(budget * w / total) for p, w in share.items()} if total > 0 else {}


def mix(docs: DataFrame, pools: Column | None = None, weights: dict[str, float] | None = None, budget: float = BUDGET, temperature: float = TEMPERATURE, costs: Sequence[int] = COSTS, seed: int = SEED, max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """doc_id, pool, epoch (from 0), tokens and the other columns of ``docs``: a row for each selected pass of a document. budget: in tokens of the whole corpus."""
    spark = docs.sparkSession
    pattern = F.array_join(F.array_sort(F.array_distinct(default_pools() if pools is None else pools)), SEPARATOR)
    tokens = F.ceil(F.octet_length("text") / 4).cast("long")
    draw = F.xxhash64("doc_id", F.lit(seed))
    bucket = F.pmod(F.shiftright(draw, 40), F.lit(BUCKETS)).cast("int")
    key = F.struct(bucket.alias("bucket"), draw.alias("draw"), F.coalesce("doc_id", F.lit(-(1 << 63))).cast("long").alias("id"), tokens.alias("tokens"))
    rows = docs.select(pattern.alias("pattern"), key.alias("key")).where("key.tokens > 0 and pattern <> ''")
    rows = materialize(rows.groupBy("pattern", "key").agg(F.sum("key.tokens").alias("size")), "mix")
    cells = materialize(rows.groupBy("pattern", F.col("key.bucket").alias("bucket")).agg(F.sum("size").alias("size")), "cells")
    table = cells.groupBy("pattern").agg(F.sum("size").alias("size")).orderBy("pattern").limit(max_patterns + 1).collect()
    if len(table) > max_patterns:
        raise ValueError(f"more than {max_patterns} patterns of pools: use coarser pools, or raise max_patterns")
    members = [r.pattern.split(SEPARATOR) for r in table]
    sizes: dict[str, int] = {}
    for own, r in zip(members, table):
        for p in own:
            sizes[p] = sizes.get(p, 0) + r["size"]
    quota = quotas(sizes, int(budget * sum(r["size"] for r in table)), weights, temperature)
    flow = solve([r["size"] for r in table], members, quota, costs)
    parts = []  # of each pattern's line, from 0 to its size, pass by pass
    for i, r in enumerate(table):
        begin = 0
        for p in sorted(members[i]):
            if n := flow.amount.get((i, p), 0):
                for epoch in range(begin // r["size"], (begin + n - 1) // r["size"] + 1):
                    parts.append((r.pattern, p, epoch, max(0, begin - epoch * r["size"]), min(r["size"], begin + n - epoch * r["size"])))
                begin += n
    plan = F.broadcast(spark.createDataFrame(parts, "pattern string, pool string, epoch long, first long, last long"))  # at most patterns x pools x passes rows
    cells = cells.withColumn("base", F.coalesce(F.sum("size").over(Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ends = plan.select("pattern", F.explode(F.array("first", "last")).alias("at")).distinct()
    cut = cells.join(F.broadcast(ends), "pattern").where("base < at and at <= base + size").select("pattern", "bucket", "base", "at")
    cut = F.broadcast(cut)  # a bucket for each end
    within = Window.partitionBy("pattern", "at").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("bucket", F.col("key.bucket")).join(cut, ["pattern", "bucket"]).withColumn("start", F.col("base") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    # the last key that begins before an end: what follows lies behind it
    cut = placed.where("start < at").groupBy("pattern", "at").agg(F.max("key").alias("key"))
    both = plan.join(F.broadcast(cut.select("pattern", F.col("at").alias("first"), F.col("key").alias("after"))), ["pattern", "first"], "left").join(F.broadcast(cut.select("pattern", F.col("at").alias("last"), F.col("key").alias("to"))), ["pattern", "last"])
    both = F.broadcast(materialize(both.select(F.col("pattern").alias("_pattern"), F.col("pool").alias("_pool"), F.col("epoch").alias("_epoch"), F.col("after").alias("_after"), F.col("to").alias("_to")), "plan"))
    rest = [docs[c] for c in docs.columns if c not in ("doc_id", "pool", "epoch", "tokens")]
    got = docs.join(both, (pattern == both["_pattern"]) & (tokens > 0) & (both["_after"].isNull() | (key > both["_after"])) & (key <= both["_to"]))
    return got.select(docs["doc_id"], both["_pool"].alias("pool"), both["_epoch"].alias("epoch"), tokens.alias("tokens"), *rest)

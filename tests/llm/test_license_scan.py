import random

import numpy as np

from quirelake.llm import license_scan, textscan


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_alignments_are_common_and_gaps_exact():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(rng.choice([3, 30])) for _ in range(rng.randint(0, 25))] for _ in range(2))
        pairs = license_scan.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        unique = [x for x in set(a) if a.count(x) == 1 and b.count(x) == 1]
        if not unique:
            assert len(pairs) == lcs(a, b)
        assert license_scan._common(a, b, 0, len(a), 0, len(b)).__len__() == lcs(a, b)


def test_increasing_is_longest():
    rng = random.Random(3)
    for _ in range(50):
        seconds = rng.sample(range(30), 12)
        assert len(license_scan._increasing(list(enumerate(seconds)))) == lcs(seconds, sorted(seconds))


def brute(text, template, must):
    """Does any window reach the coverage with the words that must be there? Alignment is exact where no word is unique, so pairs are counted by it."""
    h, t = textscan.word_hashes(text).tolist() if text else [], textscan.word_hashes(template).tolist()
    own, width = set(textscan.word_hashes(must).tolist()), int(np.ceil(license_scan.SLACK * len(t)))
    for i in range(len(h)):
        pairs = license_scan.align(t, h[i : i + width])
        if len(pairs) >= license_scan.MIN_COVERAGE * len(t) - 1e-9 and own <= {t[k] for k, _ in pairs}:
            return True
    return False


def mixed_texts(n=80, seed=5):
    rng = random.Random(seed)
    filler = "alpha beta the of license gamma version delta under software this work any".split()
    names = list(license_scan.TEMPLATES)
    out = []
    for i in range(n):
        text = [rng.choice(filler) for _ in range(rng.randint(0, 120))]
        if i % 2:
            own = license_scan.TEMPLATES[rng.choice(names)][0].split()
            own = [w for w in own if rng.random() > rng.choice([0, 0.05, 0.3])]
            at = rng.randint(0, len(text))
            text[at:at] = own
        out.append((i, " ".join(text)))
    return out


def test_windows_are_where_brute_force_finds_them():
    docs = mixed_texts()
    scanner = license_scan.Scanner(license_scan.TEMPLATES, license_scan.MIN_COVERAGE)
    words = textscan.scan([t for _, t in docs])
    got = set()
    for doc, t in scanner.candidates(words):
        h = words.hash[words.bounds[doc] : words.bounds[doc + 1]].tolist()
        got |= {(doc, scanner.names[t]) for _ in scanner.windows(h, t)}
    want = {(i, n) for i, t in docs for n, (template, must) in license_scan.TEMPLATES.items() if brute(t, template, must)}
    assert got == want and len(want) > 20


def test_relatives_are_told_apart(spark):
    texts = {n: f"Some words before. {t} And some words after it." for n, (t, _) in license_scan.TEMPLATES.items()}
    rows = list(enumerate(texts.values())) + [(100, "Licensed under CC BY 4.0."), (101, "Released under the GNU License."), (102, "This work is licensed under the GNU General Public License, version 1."), (103, "Released under the Zork License.")]
    got = {}
    for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append(r.template)
    assert got == {i: [n] for i, n in enumerate(texts)} | {100: ["CC-BY-4.0 short"]}


def test_overlaps_against_brute_force():
    rng = random.Random(8)
    for _ in range(200):
        sizes = [rng.randint(3, 9) for _ in range(4)]
        found = [(t, s, s + rng.randint(1, 9), rng.randint(1, 9)) for t in range(4) for s in [rng.randint(0, 30)]]
        kept = license_scan.best_apart(found, sizes)
        for w in found:
            rivals = [k for k in kept if k[1] < w[2] and w[1] < k[2]]
            assert w in kept or any((-k[3], -k[3] / sizes[k[0]], k[1], k[0]) < (-w[3], -w[3] / sizes[w[0]], w[1], w[0]) for k in rivals)
        assert all(a is b or a[2] <= b[1] or b[2] <= a[1] for a in kept for b in kept)


def test_edges(spark):
    notice = license_scan.TEMPLATES["MIT notice"][0]
    rows = [(1, notice, "a"), (1, notice, "a"), (None, notice, None), (2, None, None), (3, "", "b"), (4, notice + " x" * 50 + " " + notice, None), (5, "word " * 200_000 + notice, None), (6, "Released under the", None)]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, template string")).collect()
    assert sorted((r.doc_id or 0, r.template, r.coverage) for r in got) == sorted((i, "MIT notice", 1.0) for i in (0, 1, 1, 4, 4, 5))
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, template string"), {}).count() == 0

"""Toxic documents by weak supervision.

1. Voters: lexicons of insults (several languages, and spellings with digits), patterns (an insult
   after a pointing word or after "you are", density, shouting, repeated insults) and stems: words and
   beginnings of words, each with a number and a share of the words from which it fires, mined from
   the labelled documents (below). All look at a document's whole text, and each fires or not. A
   document's votes are a bit mask; voters that fire nowhere are left out.
2. Label model: the masks of all documents are counted; a generative model with a class prior and
   each voter's rates of firing given the class is fitted by EM on these counts, with the labelled
   documents as cases of known class. Then the conditional mutual information of each pair of voters
   is measured under the posterior; a maximum spanning forest of the dependent pairs makes the model a
   tree given the class, and EM goes on. Its rates are the voters' accuracies, its edges their correlations.
3. Classifier: a logistic regression on the votes and on the presence of hashed words, fitted to the
   posteriors of a sample of at most ``train_rows`` documents (half with votes, half without, by
   seeded hash, weighted back to all documents). Words whose presence differs significantly between
   the classes are its features. It reads all words of every document; a document is toxic from
   ``threshold`` on.

Mining: of ``labels`` at most ``label_rows`` documents are taken by seeded hash, half of them toxic. For
each word and each beginning of ``HEADS`` characters the documents of both classes that hold it are counted;
those passing a z test are tried with several least numbers and shares, and the one that tells most
about the class, joined by others of its length that add to that, becomes a voter. Toxic documents on which it fires are set aside and the rest is
searched again, so rare languages get voters of their own, until nothing passes. Without labels there are
lexicons and patterns only.

Defined results: null and wordless texts are clean and aren't learnt from; with no votes at all in the
corpus every document is clean. A null doc_id and repeated rows are scored like others; labels with a null
are left out, and of several labels of a document the highest counts. An empty table gives an empty
result. Other columns are neither read nor changed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm import textscan
from quirelake.session import materialize

THRESHOLD = 0.5
TRAIN_ROWS = 16_000
LABEL_ROWS = 8_000
HEADS = (3, 4, 5, 6)
MAX_STEMS = 40
TRIED, LEAST, SHARES = 40, (1, 2, 3, 5), (0.0, 0.0025, 0.005, 0.01, 0.015, 0.02, 0.03)
FEATURE_BITS = 20

LEXICONS = {
    "stupidity": "idiot idiots idiotic moron morons moronic imbecile stupid stupidity dumb dumbass dimwit halfwit",
    "contempt": "pathetic worthless disgusting despicable contemptible useless vile repulsive",
    "persons": "loser losers clown clowns scum scumbag jerk bastard creep freak pig swine",
    "refuse": "trash garbage filth vermin rubbish",
    "abuse": "bitch asshole fuck fucking fucker shit bullshit crap cunt dickhead whore slut",
    "dehumanising": "subhuman parasite parasites cockroach cockroaches degenerate kys",
    "german": "idioten trottel dummkopf arschloch scheiße versager abschaum widerlich erbärmlich wertlos schwachkopf vollidiot",
    "spanish": "idiota idiotas estúpido estúpida imbécil basura asqueroso patético payaso perdedor escoria mierda cabrón",
    "french": "idiote imbécile connard connasse merde salaud ordure pathétique minable crétin débile abruti dégoûtant",
}
_POINTING = "this that these those such you your ur u"
_LEET = {"i": "1", "o": "0", "e": "3", "a": "4", "s": "5", "t": "7"}


def _hashes(words: str) -> np.ndarray:
    return np.unique(textscan.word_hashes(words))


@dataclass(frozen=True)
class Stem:
    """Fires on a text of which ``least`` words, and ``share`` of the words, have one of ``hashes`` as their head of ``size`` characters (0: as the whole)."""

    size: int
    hashes: tuple[int, ...]
    least: int
    share: float


class _Known:
    """Places of hashes in a sorted set; -1 for others."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.unique(hashes)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.hashes >> np.uint64(44)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``h`` that hold a known hash, and which."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.seen[h >> np.uint64(44)])
        k = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        hit = self.hashes[k] == h[at]
        return at[hit], k[hit]


class Voters:
    """Masks of votes; bit k is voter k's."""

    def __init__(self, stems: Sequence[Stem] = ()) -> None:
        self.lexicons = {k: _hashes(v) for k, v in LEXICONS.items()}
        self.lexicons["digits"] = _hashes(" ".join(w.replace(a, b) for v in LEXICONS.values() for w in v.split() for a, b in _LEET.items() if a in w))
        self.every = _Known(np.concatenate(list(self.lexicons.values())))
        self.pointing = _hashes(_POINTING)
        self.you, self.are = textscan.word_hashes("you")[0], textscan.word_hashes("are")[0]
        self.stems = list(stems)
        self.heads = tuple(sorted({s.size for s in self.stems} - {0}))
        self.known = {k: _Known(np.array([h for s in self.stems if s.size == k for h in s.hashes], np.uint64)) for k in (0, *self.heads)}
        self.names = [*self.lexicons, "pointed", "addressed", "dense", "several", "shouting", *(f"stem{k}" for k in range(len(self.stems)))]

    def scan(self, texts: list[str | None]) -> textscan.Words:
        return textscan.scan(texts, self.heads)

    def votes(self, texts: list[str | None], words: textscan.Words) -> np.ndarray:
        """Masks of the texts, whose words are given."""
        n, some = np.diff(words.bounds), len(texts)
        at, which = self.every.find(words.hash)
        doc = np.searchsorted(words.bounds, at, side="right") - 1
        h = words.hash[at]
        fires = [np.bincount(doc[np.isin(h, own)], minlength=some) > 0 for own in self.lexicons.values()]
        before = at > words.bounds[doc]
        previous = words.hash[np.maximum(at - 1, 0)]
        pointed = before & np.isin(previous, self.pointing)
        addressed = np.zeros(len(at), bool)
        for back in (2, 3):
            inside = at - back >= words.bounds[doc]
            addressed |= inside & (words.hash[np.maximum(at - back, 0)] == self.you) & (words.hash[np.maximum(at - back + 1, 0)] == self.are)
        hits = np.bincount(doc, minlength=some)
        kinds = np.bincount(np.unique(doc * len(self.every.hashes) + which) // len(self.every.hashes), minlength=some) if len(doc) else np.zeros(some)
        fires += [np.bincount(doc[pointed], minlength=some) > 0, np.bincount(doc[addressed], minlength=some) > 0, hits * 100 >= np.maximum(n, 1), kinds > 1]
        fires.append(np.fromiter((_shouts(t) for t in texts), bool, some))
        found = {k: known.find(words.heads[k] if k else words.hash) for k, known in self.known.items()}
        docs = {k: np.searchsorted(words.bounds, at, side="right") - 1 for k, (at, _) in found.items()}
        for s in self.stems:
            own = docs[s.size][np.isin(found[s.size][1], np.searchsorted(self.known[s.size].hashes, np.array(s.hashes, np.uint64)))]
            fires.append(_enough(np.bincount(own, minlength=some), n, s.least, s.share))
        mask = np.zeros(some, np.int64)
        for k, f in enumerate(fires):
            mask |= f.astype(np.int64) << k
        return mask


def _enough(hits: np.ndarray, words: np.ndarray, least: int, share: float) -> np.ndarray:
    return (hits >= least) & (hits >= share * words)


def _shouts(text: str | None) -> bool:
    return bool(text) and text.count("!") * 20 > len(text) - text.count(" ") > 20


def _doc_heads(words: textscan.Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for k in (0, *HEADS):
        yield k, words.doc, words.heads[k] if k else words.hash


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Toxic and clean documents that hold each head, of some texts at a time."""
    for batch in batches:
        toxic, texts = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_pylist()
        for a, b in textscan.groups(texts):
            words = textscan.scan(texts[a:b], HEADS)
            for k, doc, h in _doc_heads(words):
                own, of = np.unique(h, return_inverse=True)
                pair = np.unique(of * (b - a) + doc)
                on = np.bincount(pair // (b - a), toxic[a:b][pair % (b - a)], len(own)).astype(np.int64)
                both = np.bincount(pair // (b - a), minlength=len(own))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), k)), pa.array(own.view(np.int64)), pa.array(on), pa.array(both - on)], names=["size", "head", "on", "off"])


def mine(labelled: DataFrame, weights: tuple[float, float] = (1.0, 1.0), most: int = MAX_STEMS, z: float = 5.0, least: int = 5) -> list[Stem]:
    """Stems of the rows (row, toxic, text), whose number is bounded by ``label_rows``. weights: labelled documents for each clean and toxic row."""
    n1, n0 = (labelled.where(f"toxic = {c} and text is not null").count() for c in (1, 0))
    if n1 < least or n0 < least:
        return []
    counts = labelled.mapInArrow(_presence, "size long, head long, on long, off long").groupBy("size", "head").agg(F.sum("on").alias("on"), F.sum("off").alias("off"))
    pooled = f"((on + off) / {n1 + n0})"
    counts = counts.where(f"on >= {least} and on / {n1} - off / {n0} >= {z} * sqrt({pooled} * (1 - {pooled}) * {1 / n1 + 1 / n0})")
    picked = counts.orderBy("size", "head").toArrow()  # a head has at least ``least`` of the label_rows documents
    if not picked.num_rows:
        return []
    size, head = picked.column("size").to_numpy(), picked.column("head").to_numpy().view(np.uint64)
    known = {k: (_Known(head[size == k]), np.flatnonzero(size == k)[np.argsort(head[size == k])]) for k in (0, *HEADS)}
    shared = labelled.sparkSession.sparkContext.broadcast(known)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in textscan.groups(texts):
                words = textscan.scan(texts[a:b], HEADS)
                n, parts = np.diff(words.bounds), [np.arange(b - a) << 32 | (1 << 32) - 1]
                for k, doc, h in _doc_heads(words):
                    at, which = shared.value[k][0].find(h)
                    parts.append(doc[at].astype(np.int64) << 32 | shared.value[k][1][which])
                key, count = np.unique(np.concatenate(parts), return_counts=True)
                doc, which = key >> 32, key & 0xFFFFFFFF
                which = np.where(which == (1 << 32) - 1, -1, which)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(doc)), batch.column(1).slice(a, b - a).take(pa.array(doc)), pa.array(which), pa.array(np.where(which < 0, n[doc], count))], names=["row", "toxic", "which", "n"])

    got = labelled.where("text is not null").mapInArrow(hits, "row long, toxic long, which long, n long").toArrow()
    row, toxic, which, n = (got.column(c).to_numpy() for c in ("row", "toxic", "which", "n"))
    rows, row = np.unique(row, return_inverse=True)
    is_toxic, words = np.zeros(len(rows), bool), np.zeros(len(rows), np.int64)
    is_toxic[row] = toxic == 1
    words[row[which < 0]] = n[which < 0]
    row, which, n = (x[which >= 0] for x in (row, which, n))
    left, stems = np.ones(len(rows), bool), []
    weight = np.where(is_toxic, weights[1], weights[0])

    def test(on: np.ndarray, off: np.ndarray) -> np.ndarray:
        """z of the difference between the toxic documents left and the clean ones."""
        m1, m0 = max(1, (left & is_toxic).sum()), max(1, (~is_toxic).sum())
        p = (on + off) / (m1 + m0)
        return np.where(on >= least, (on / m1 - off / m0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / m1 + 1 / m0)), 0.0)

    def gain(count: np.ndarray) -> tuple[float, int, float]:
        """Most information on the class that a threshold on these numbers of hits gives, and the threshold."""
        best = (0.0, 1, 0.0)
        inside = left | ~is_toxic
        total = weight[inside].sum()
        toxic_total = weight[inside & is_toxic].sum()
        for low in LEAST:
            for part in SHARES:
                fires = inside & _enough(count, words, low, part)
                on, off = weight[fires & is_toxic].sum(), weight[fires & ~is_toxic].sum()
                if (fires & is_toxic).sum() < least or on * (total - toxic_total) <= off * toxic_total:
                    continue
                cells = np.array([[on, off], [toxic_total - on, total - toxic_total - off]])
                apart = cells.sum(axis=1, keepdims=True) * cells.sum(axis=0) / total
                value = (cells * np.log(np.maximum(cells, 1e-12) / np.maximum(apart, 1e-12))).sum()
                if value > best[0] * (1 + 1e-9):
                    best = (float(value), low, part)
        return best

    def hits_of(k: int) -> np.ndarray:
        at = slice(*np.searchsorted(which, [k, k + 1]))
        return np.bincount(row[at], n[at], len(rows))

    order = np.lexsort((row, which))
    row, which, n = row[order], which[order], n[order]
    while len(stems) < most:
        on = np.bincount(which[is_toxic[row] & left[row]], minlength=len(head))
        off = np.bincount(which[~is_toxic[row]], minlength=len(head))
        score = test(on, off)
        tried = [k for k in np.argsort(-score, kind="stable")[:TRIED] if score[k] >= z]
        if not tried:
            break
        hits = {k: hits_of(k) for k in tried}
        found = {k: gain(hits[k]) for k in tried}
        first = max(tried, key=lambda k: found[k][0])
        best, own, count = found[first], [first], hits[first]
        if best[0] <= 0:
            break
        # heads of the same length that add to what it tells join it
        for k in sorted((k for k in tried if size[k] == size[first] and k != first), key=lambda k: -found[k][0]):
            if (more := gain(count + hits[k]))[0] > best[0] * 1.02:
                best, own, count = more, [*own, k], count + hits[k]
        fires = _enough(count, words, best[1], best[2])
        if test((fires & is_toxic & left).sum(), (fires & ~is_toxic).sum()) < z:
            break
        stems.append(Stem(int(size[first]), tuple(int(head[k]) for k in own), best[1], best[2]))
        left &= ~(fires & is_toxic)
    return stems


@dataclass
class LabelModel:
    """prior: of the toxic class. rates[c, p, k]: voter k fires given class c and its parent's vote p. parent: -1 for none."""

    prior: float
    rates: np.ndarray
    parent: np.ndarray
    information: np.ndarray

    def posterior(self, masks: np.ndarray) -> np.ndarray:
        votes = _unpack(masks, self.rates.shape[2])
        return _posterior(votes, self.prior, self.rates, self.parent)


def _unpack(masks: np.ndarray, n: int) -> np.ndarray:
    return (np.asarray(masks, np.int64)[:, None] >> np.arange(n)) & 1


def _posterior(votes: np.ndarray, prior: float, rates: np.ndarray, parent: np.ndarray) -> np.ndarray:
    above = np.where(parent >= 0, votes[:, np.maximum(parent, 0)], 0)
    log = []
    for c in (0, 1):
        p = np.where(above == 1, rates[c, 1], rates[c, 0])
        log.append(np.log(prior if c else 1 - prior) + np.log(np.where(votes == 1, p, 1 - p)).sum(axis=1))
    return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def fit_label_model(masks: np.ndarray, counts: np.ndarray, voters: list[str], rounds: int = 50, least: float = 0.005, gold: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> LabelModel:
    """EM on counts of vote masks. The rates have Beta priors: a voter is taken to fire rarely on clean documents until the data say otherwise.

    gold: masks, weights and classes of labelled documents, whose class is known."""
    n = len(voters)
    votes = _unpack(masks, n)
    weight = counts / max(1, counts.sum())
    known = _unpack(gold[0], n) if gold else np.zeros((0, n), np.int64)
    known_weight = gold[1] / max(1, counts.sum()) if gold else np.zeros(0)
    known_q = gold[2].astype(float) if gold else np.zeros(0)
    every, heft = np.concatenate([votes, known]), np.concatenate([weight, known_weight])
    parent = np.full(n, -1)
    strength = 20 / max(1, counts.sum())

    def maximise(q: np.ndarray, heft: np.ndarray = heft) -> tuple[float, np.ndarray]:
        rates = np.empty((2, 2, n))
        for c, target in ((0, 0.005), (1, 0.2)):
            w = heft * (q if c else 1 - q)
            for p in (0, 1):
                above = np.where(parent >= 0, every[:, np.maximum(parent, 0)] == p, True)
                on = w[:, None] * above
                rates[c, p] = ((on * every).sum(axis=0) + strength * target) / (on.sum(axis=0) + strength)
        return float(np.clip((heft * q).sum() / heft.sum(), 1e-6, 0.5)), np.clip(rates, 1e-6, 1 - 1e-6)

    def expect(prior: float, rates: np.ndarray) -> np.ndarray:
        return np.concatenate([_posterior(votes, prior, rates, parent), known_q])

    if len(known):
        q = expect(*maximise(np.concatenate([np.zeros(len(votes)), known_q]), np.concatenate([np.zeros(len(votes)), known_weight])))
    else:
        lexical = min(len(LEXICONS) + 1, n)
        # a lexicon starts with the share of its firings that another lexicon joins: one that fires alone has no say yet
        others = votes[:, :lexical].sum(axis=1, keepdims=True) > votes[:, :lexical]
        fired = (weight[:, None] * votes[:, :lexical]).sum(axis=0)
        agree = (weight[:, None] * (votes[:, :lexical] & others)).sum(axis=0) / np.maximum(fired, 1e-12)
        q = np.clip((votes[:, :lexical] * np.minimum(2 * agree, 0.95)).max(axis=1, initial=0), 0.005, 0.95)
    for _ in range(rounds):
        prior, rates = maximise(q)
        q = expect(prior, rates)
    information = np.zeros((n, n))
    for c in (0, 1):
        w = heft * (q if c else 1 - q)
        if (total := w.sum()) < 1e-9:
            continue
        for x in (0, 1):
            for y in (0, 1):
                one, two = every == x, every == y
                joint = (one * w[:, None]).T @ two
                apart = np.outer((one * w[:, None]).sum(axis=0), (two * w[:, None]).sum(axis=0)) / total
                information += np.where(joint > 0, joint * np.log(np.maximum(joint, 1e-300) / np.maximum(apart, 1e-300)), 0)
    information = np.triu(information, 1)
    parent = forest(information, least * max(prior, 1e-9))
    for _ in range(rounds):
        prior, rates = maximise(q)
        q = expect(prior, rates)
    return LabelModel(prior, rates, parent, information)


def forest(information: np.ndarray, least: float) -> np.ndarray:
    """Parents (-1 for roots) in the maximum spanning forest of the pairs above ``least``; the lowest voter of each tree is its root."""
    n = len(information)
    root, joined = np.arange(n), [[] for _ in range(n)]
    for i, j in sorted(zip(*np.nonzero(information > least)), key=lambda e: (-information[e], e)):
        if root[i] != root[j]:
            joined[i].append(j)
            joined[j].append(i)
            root[root == root[j]] = root[i]
    parent, reached = np.full(n, -1), np.zeros(n, bool)
    for top in range(n):
        todo = [] if reached[top] else [top]
        reached[top] = True
        for v in todo:
            for w in joined[v]:
                if not reached[w]:
                    reached[w], parent[w] = True, v
                    todo.append(w)
    return parent


def features(words: textscan.Words, masks: np.ndarray, voters: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed words of each text and, after them, its votes; and their bounds."""
    doc = words.doc.astype(np.int64)
    parts = [(doc << 32) | (words.hash >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)]
    for k in range(voters):
        parts.append((np.flatnonzero((masks >> k) & 1) << 32) | ((1 << FEATURE_BITS) + k))
    key = np.unique(np.concatenate(parts))
    return (key & 0xFFFFFFFF).astype(np.int32), np.searchsorted(key >> 32, np.arange(len(words.bounds)))


def fit_classifier(index: np.ndarray, bounds: np.ndarray, q: np.ndarray, weight: np.ndarray, voters: int, z: float = 5.0, ridge: float = 1e-3, rounds: int = 1000) -> tuple[np.ndarray, float]:
    """Weights of all buckets and votes, and the intercept, by gradient descent to convergence on the votes and the words that pass a two-sample z test."""
    size = (1 << FEATURE_BITS) + voters
    w = np.zeros(size, np.float32)
    if not len(q) or q.max() < 0.5:
        return w, -10.0
    doc = np.repeat(np.arange(len(q)), np.diff(bounds))
    on, off = np.bincount(index, q[doc], size), np.bincount(index, 1 - q[doc], size)
    n1, n0 = q.sum(), (1 - q).sum()
    pooled = (on + off) / (n1 + n0)
    score = (on / max(n1, 1e-9) - off / max(n0, 1e-9)) / np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / max(n1, 1e-9) + 1 / max(n0, 1e-9)))
    chosen = np.flatnonzero((np.abs(score) >= z) & (on + off >= 5) | (np.arange(size) >= 1 << FEATURE_BITS) & (on + off > 0))
    place = np.full(size, -1)
    place[chosen] = np.arange(len(chosen))
    keep = place[index] >= 0
    doc, col = doc[keep], place[index][keep]
    beta, bias = np.zeros(len(chosen)), np.log(max((q * weight).sum(), 1e-9) / max(((1 - q) * weight).sum(), 1e-9))
    m1, m2, b1, b2 = np.zeros(len(chosen)), np.zeros(len(chosen)), 0.0, 0.0
    share, last = weight / weight.sum(), np.inf
    for step in range(1, rounds + 1):
        s = np.bincount(doc, beta[col], len(q)) + bias
        if step % 25 == 0:
            loss = (share * (np.logaddexp(0, s) - q * s)).sum() + ridge * share.min() * (beta @ beta) / 2
            if last - loss < 1e-4 * loss:
                break
            last = loss
        g = (1 / (1 + np.exp(-np.clip(s, -500, 500))) - q) * share
        gb, g = g.sum(), np.bincount(col, g[doc], len(chosen)) + ridge * beta * share.min()
        m1, m2, b1, b2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g, 0.9 * b1 + 0.1 * gb, 0.999 * b2 + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        beta -= 0.1 * (m1 / c1) / (np.sqrt(m2 / c2) + 1e-12)
        bias -= 0.1 * (b1 / c1) / (np.sqrt(b2 / c2) + 1e-12)
    w[chosen] = beta
    return w, float(bias)


@dataclass
class Model:
    """``live``: places of the voters that fire, in the order of ``labels``."""

    labels: LabelModel
    stems: list[Stem]
    live: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities of being toxic; 0 for texts without words."""
        if getattr(self, "_voters", None) is None:
            self._voters = Voters(self.stems)
        voters, out = self._voters, np.zeros(len(texts))
        for a, b in textscan.groups(texts):
            words = voters.scan(texts[a:b])
            index, bounds = features(words, voters.votes(texts[a:b], words), len(voters.names))
            n = np.diff(bounds)
            s = np.bincount(np.repeat(np.arange(b - a), n), self.weights[index], b - a) + self.bias
            out[a:b] = np.where(np.diff(words.bounds) > 0, 1 / (1 + np.exp(-np.clip(s, -500, 500))), 0.0)
        return out


def _packed(masks: np.ndarray, live: np.ndarray) -> np.ndarray:
    """The bits at ``live`` of each mask, side by side."""
    out = np.zeros(len(masks), np.int64)
    for k, place in enumerate(live):
        out |= ((masks >> place) & 1) << k
    return out


def sample_labels(docs: DataFrame, labels: DataFrame, label_rows: int = LABEL_ROWS, seed: int = 11) -> tuple[DataFrame, tuple[float, float]]:
    """row, toxic, text of at most ``label_rows`` documents that have a label, half of either class, by seeded hash; labels for each clean and toxic row."""
    known = materialize(labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.expr("cast(toxic > 0 as long)")).alias("toxic")), "known")
    every = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    order = [F.xxhash64("doc_id", F.lit(seed)), "doc_id"]
    parts = [known.where(f"toxic = {c}").orderBy(*order).limit(label_rows // 2) for c in (0, 1)]
    chosen = materialize(parts[0].unionByName(parts[1]), "labels")
    found = docs.select("doc_id", "text").where("doc_id is not null and text is not null").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])  # at most label_rows ids
    return materialize(found.select(F.col("doc_id").alias("row"), "toxic", "text"), "labelled"), tuple(max(1.0, every.get(c, 0) / max(1, label_rows // 2)) for c in (0, 1))


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS, seed: int = 11, labels: DataFrame | None = None, label_rows: int = LABEL_ROWS) -> Model:
    labelled, per_row = (None, (1.0, 1.0)) if labels is None else sample_labels(docs, labels, label_rows, seed)
    stems = [] if labelled is None else mine(labelled, per_row)
    names = Voters(stems).names

    def masks_of(voters: Voters, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        mask, size = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for a, b in textscan.groups(texts):
            words = voters.scan(texts[a:b])
            mask[a:b], size[a:b] = voters.votes(texts[a:b], words), np.diff(words.bounds)
        return mask, size

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(stems)
        for batch in batches:
            mask, size = masks_of(voters, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(mask), pa.array(size)], names=["doc_id", "mask", "n_words"])

    votes = materialize(docs.select("doc_id", "text").where("text is not null").mapInArrow(vote, "doc_id long, mask long, n_words long").where("n_words > 0"), "votes")
    counted = votes.groupBy("mask").agg(F.count("*").alias("n")).orderBy("mask").toPandas()  # at most 2 ** voters rows
    masks, counts = counted["mask"].to_numpy(np.int64), counted["n"].to_numpy(np.int64)
    live = np.flatnonzero(_unpack(masks, len(names)).any(axis=0)) if len(masks) else np.zeros(0, np.int64)
    lexical = len(LEXICONS) + 1
    if not len(masks) or not (masks & ~(((1 << len(names) - len(stems) - lexical) - 1) << lexical)).any():
        return Model(LabelModel(1e-6, np.full((2, 2, len(live)), 0.5), np.full(len(live), -1), np.zeros((len(live),) * 2)), stems, live, np.zeros((1 << FEATURE_BITS) + len(names), np.float32), -10.0)
    gold = None
    if labelled is not None:
        kept = labelled.select("row", "text").mapInArrow(vote, "doc_id long, mask long, n_words long").where("n_words > 0").join(labelled.select(F.col("row").alias("doc_id"), "toxic"), "doc_id")
        known = kept.groupBy("mask", "toxic").agg(F.count("*").alias("n")).orderBy("mask", "toxic").toPandas()  # at most label_rows rows
        if known["toxic"].nunique() == 2:
            gold = _packed(known["mask"].to_numpy(np.int64), live), known["n"].to_numpy(float) * np.array(per_row)[known["toxic"].to_numpy()], known["toxic"].to_numpy()
    fitted = fit_label_model(_packed(masks, live), counts, [names[k] for k in live], gold=gold)
    firing = int(counts[masks != 0].sum())
    silent = int(counts.sum()) - firing
    order = [F.xxhash64("doc_id", F.lit(seed)), "doc_id"]
    sample = [votes.where(f"doc_id is not null and {c}").orderBy(*order).select("doc_id", "mask").limit(train_rows // 2) for c in ("mask <> 0", "mask = 0")]
    chosen = materialize(sample[0].unionByName(sample[1]), "sample").dropDuplicates(["doc_id"])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for a, b in textscan.groups(texts):
                index, bounds = features(textscan.scan(texts[a:b]), mask[a:b], len(names))
                yield pa.RecordBatch.from_arrays([pa.array(mask[a:b]), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(index))], names=["mask", "index"])

    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("mask", "text")  # at most train_rows ids
    rows = texts.mapInArrow(extract, "mask long, index array<int>").toArrow().combine_chunks()
    mask = rows.column("mask").to_numpy()
    index = rows.column("index").combine_chunks() if rows.num_rows else pa.array([[]], pa.list_(pa.int32()))
    n = index.value_lengths().to_numpy()[: len(mask)]
    q = fitted.posterior(_packed(mask, live))
    some = max(1, int((mask != 0).sum())), max(1, int((mask == 0).sum()))
    weight = np.where(mask != 0, firing / some[0], silent / some[1])
    order_ = np.lexsort((n, mask))  # the rows' order in the shuffle must not matter
    flat = index.flatten().to_numpy()
    starts = np.concatenate([[0], np.cumsum(n)])
    flat = np.concatenate([flat[starts[i] : starts[i + 1]] for i in order_] or [flat])
    weights, bias = fit_classifier(flat, np.concatenate([[0], np.cumsum(n[order_])]), q[order_], weight[order_], len(names))
    return Model(fitted, stems, live, weights, bias)


def toxic_documents(docs: DataFrame, model: Model | None = None, threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS, labels: DataFrame | None = None) -> DataFrame:
    """doc_id and toxic_probability of each row found toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs, train_rows, labels=labels))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.score(batch.column(1).to_pylist())
            at = np.flatnonzero(p >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()).take(pa.array(at)), pa.array(p[at])], names=["doc_id", "toxic_probability"])

    return docs.select("doc_id", "text").mapInArrow(go, "doc_id long, toxic_probability double")


def keep_clean(docs: DataFrame, threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS, labels: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` not found toxic; the columns stay as they are, without a shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, train_rows, labels=labels))

    @F.arrow_udf("boolean")
    def clean(text: pa.Array) -> pa.Array:
        return pa.array(model.value.score(text.to_pylist()) < threshold, pa.bool_())

    return docs.where(clean(docs["text"]))

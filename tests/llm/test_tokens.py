import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from quirelake.llm import tokens

PAIR = "/opt/tokenizers/byte_bpe_50k.json"
TEXTS = ["Hello world\nsecond line  \n\n\nlast   ", "", None, "naïve café — ünïcode\n日本語のテキスト\n🙂🙂 emoji\n", "\n\n", "one", "tail\n", "a\r\nb\tc\n  indented code\n\n    more", "x" * 5000 + "\n" + "1234567890 " * 300]


def brute(text, rule):
    """Tokens of each line from the offsets of another library's encoder, token by token."""
    t = Tokenizer.from_file(PAIR)
    raw = text.encode()
    borders, at = [0], 0
    for line in text.split("\n")[:-1]:
        at += len(line.encode()) + 1
        borders.append(at)
    if borders[-1] != len(raw) or len(borders) == 1:
        borders.append(len(raw))
    spans = list(zip(borders[:-1], borders[1:]))
    counts, crossing = [0.0] * len(spans), [0] * len(spans)
    alphabet = _byte_of()
    at = 0
    for token in t.encode(text, add_special_tokens=False).tokens if text else []:
        size = len([alphabet[c] for c in token])
        shares = [max(0, min(at + size, e) - max(at, s)) for s, e in spans]
        touched = [i for i, x in enumerate(shares) if x]
        if rule == "split":
            for i in touched:
                counts[i] += shares[i] / size
                crossing[i] += len(touched) > 1
        else:
            to = touched[0] if rule == "first" else max(touched, key=lambda i: (shares[i], -i))
            counts[to] += 1
            crossing[to] += len(touched) > 1
        at += size
    assert at == len(raw)
    chars = [len(raw[:b].decode()) for b in borders]
    return [(i, chars[i], chars[i + 1], counts[i], crossing[i]) for i in range(len(spans))]


def _byte_of():
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {chr(b): b for b in keep}, 0
    for b in range(256):
        if b not in keep:
            table[chr(256 + extra)] = b
            extra += 1
    return table


@pytest.mark.parametrize("rule", tokens.RULES)
def test_equal_to_another_encoder(spark, rule):
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choice(["a", "bc", " ", "\n", "é", "日", "12", ".", "\n\n", "the "]) for _ in range(200)) for _ in range(30)]
    docs = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)], "doc_id long, text string, section string")
    got = {}
    for r in tokens.section_tokens(docs, rule=rule).collect():
        got.setdefault(r.doc_id, []).append((r.section, r.char_start, r.char_end, pytest.approx(r.tokens), r.crossing))
    assert 2 not in got
    for i, t in enumerate(texts):
        if t is not None:
            assert sorted(got[i], key=lambda x: x[0]) == brute(t, rule), t


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.section_tokens(empty).count() == 0
    rows = tokens.section_tokens(spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, "word " * 400_000)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.tokens) for r in rows)[:3] == [(0, 2.0), (1, 2.0), (1, 2.0)]
    with pytest.raises(ValueError):
        tokens.section_tokens(empty, rule="last")


def test_attribute_sums():
    rng = np.random.default_rng(1)
    for _ in range(50):
        token = np.concatenate([[0], np.cumsum(rng.integers(1, 6, 40))])
        section = np.sort(np.concatenate([[0, token[-1]], rng.integers(0, token[-1], 9)]))
        for rule in tokens.RULES:
            assert tokens.attribute(token, section, rule)[0].sum() == pytest.approx(40)

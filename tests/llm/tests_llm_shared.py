"""Texts for tests of several operators."""

LANGS = {"en": "th er on an re he in ed nd ha at en es of or".split(), "de": "sch ung keit ein der ber ver zu ach lich ü ö".split(), "fr": "eau oi ment tion é è que les aux ai ch".split()}


def prose(rng, lang, n, rare=False):
    own = LANGS[lang] + (["ql", "vx", "zub"] if rare else [])
    return " ".join("".join(rng.choice(own) for _ in range(rng.randint(2, 4))) for _ in range(n))


def edited(rng, text, k):
    words = text.split()
    for i in rng.sample(range(len(words)), k):
        words[i] = words[i][::-1] + "x"
    return " ".join(words)

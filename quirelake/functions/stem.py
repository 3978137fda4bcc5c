"""Snowball stemmers for English and Russian, from the published algorithm descriptions."""

from __future__ import annotations

import re
from functools import lru_cache

_VOWELS = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_SAME = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = [("ization", "ize"), ("ational", "ate"), ("ousness", "ous"), ("iveness", "ive"), ("fulness", "ful"), ("tional", "tion"), ("lessli", "less"), ("biliti", "ble"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("fulli", "ful"), ("ousli", "ous"), ("iviti", "ive"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", None), ("li", None)]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", None), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]


def _region(word: str, start: int) -> int:
    m = re.compile(r"[aeiouy][^aeiouy]").search(word, start)
    return m.end() if m else len(word)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _VOWELS and w[1] not in _VOWELS
    return len(w) > 2 and w[-1] not in _VOWELS + "wxY" and w[-2] in _VOWELS and w[-3] not in _VOWELS


@lru_cache(maxsize=200_000)
def english(word: str) -> str:
    """Porter2."""
    w = word
    if len(w) <= 2 or not w.isascii():
        return w
    if w in _SPECIAL:
        return _SPECIAL[w]
    if w in _SAME:
        return w
    if w[0] == "y":
        w = "Y" + w[1:]
    w = re.sub(r"(?<=[aeiouy])y", "Y", w)
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = _region(w, 0) if r1 is None else r1
    r2 = _region(w, r1)
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(r"[aeiouy].+s$", w):
        w = w[:-1]
    if w in _AFTER_1A:
        return w
    # 1b
    if m := re.search(r"(eedly|eed)$", w):
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    elif (m := re.search(r"(ingly|edly|ing|ed)$", w)) and re.search(r"[aeiouy]", w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLES):
            w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    # 2
    for end, to in _STEP2:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r1:
                if end == "ogi":
                    w = w[:-1] if w[at - 1 : at] == "l" else w
                elif end == "li":
                    w = w[:-2] if w[at - 1 : at] in tuple("cdeghkmnrt") else w
                else:
                    w = w[:at] + to
            break
    # 3
    for end, to in _STEP3:
        if w.endswith(end):
            at = len(w) - len(end)
            if end == "ative":
                w = w[:at] if at >= r2 else w
            elif at >= r1:
                w = w[:at] + to
            break
    # 4
    for end in _STEP4:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r2 and (end != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    # 5
    if w.endswith("e"):
        at = len(w) - 1
        if at >= r2 or at >= r1 and not _short_end(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


_RV = "аеиоуыэюя"


def _ends(w: str, start: int, plain: str, after_a: str = "") -> str | None:
    """The longest ending of the region; those of ``after_a`` must follow а or я, which stays."""
    best = None
    for e in plain.split():
        if w.endswith(e) and len(w) - len(e) >= start and (best is None or len(e) > len(best)):
            best = e
    for e in after_a.split():
        at = len(w) - len(e)
        if w.endswith(e) and at - 1 >= start and w[at - 1] in "ая" and (best is None or len(e) > len(best)):
            best = e
    return best


_ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею"
_VERB1 = "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно"
_VERB2 = "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю"
_NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я"


@lru_cache(maxsize=200_000)
def russian(word: str) -> str:
    w = word.replace("ё", "е")
    m = re.search(f"[{_RV}]", w)
    if not m:
        return word
    rv = m.end()
    pair = re.compile(f"[{_RV}][^{_RV}]")
    r1 = p.end() if (p := pair.search(w)) else len(w)
    r2 = p.end() if (p := pair.search(w, r1)) else len(w)
    if e := _ends(w, rv, "ив ивши ившись ыв ывши ывшись", "в вши вшись"):
        w = w[: -len(e)]
    else:
        if e := _ends(w, rv, "ся сь"):
            w = w[: -len(e)]
        if e := _ends(w, rv, _ADJECTIVE):
            w = w[: -len(e)]
            if e := _ends(w, rv, "ивш ывш ующ", "ем нн вш ющ щ"):
                w = w[: -len(e)]
        elif e := _ends(w, rv, _VERB2, _VERB1):
            w = w[: -len(e)]
        elif e := _ends(w, rv, _NOUN):
            w = w[: -len(e)]
    if w.endswith("и") and len(w) - 1 >= rv:
        w = w[:-1]
    if e := _ends(w, r2, "ост ость"):
        w = w[: -len(e)]
    if e := _ends(w, rv, "ейш ейше"):
        w = w[: -len(e)]
    if w.endswith("нн") and len(w) - 1 >= rv:
        w = w[:-1]
    elif w.endswith("ь") and len(w) - 1 >= rv:
        w = w[:-1]
    return w


def stem(word: str) -> str:
    """English, then Russian; each leaves the other's script alone."""
    return russian(english(word))

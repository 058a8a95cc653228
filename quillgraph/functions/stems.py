"""English stems and stop words for full-text search: the published Porter2 rules, one table per step."""

from __future__ import annotations

import re
from functools import lru_cache

# fixed values: English stop words of the full-text configuration
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them
    their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an
    the and but if or because as until while of at by for with about against between into through during before after above below to from up down
    in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only
    own same so than too very s t can will just don should now""".split()
)
# fixed values: words with stems of their own, words left alone, and words left alone once their plural is off
_OWN = dict(skis="ski", skies="sky", dying="die", lying="lie", tying="tie", idly="idl", gently="gentl", ugly="ugli", early="earli", only="onli", singly="singl")
_ALONE = frozenset("sky news howe atlas cosmos bias andes".split())
_AFTER_PLURAL = frozenset("inning outing canning herring earring proceed exceed succeed".split())
# fixed values: endings and what replaces them where they lie in R1 (steps 2, 3) or go in R2 (step 4)
_STEP2 = dict(ational="ate", tional="tion", enci="ence", anci="ance", abli="able", entli="ent", izer="ize", ization="ize", ation="ate", ator="ate", alism="al", aliti="al", alli="al", fulness="ful", ousli="ous", ousness="ous", iveness="ive", iviti="ive", biliti="ble", bli="ble", fulli="ful", lessli="less")
_STEP3 = dict(tional="tion", ational="ate", alize="al", icate="ic", iciti="ic", ical="ic", ful="", ness="")
_STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split()
_VOWEL = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")


def _region(word: str, start: int) -> int:
    """Where the part behind the first consonant that follows a vowel begins."""
    m = re.compile(r"[aeiouy][^aeiouy]").search(word, start)
    return m.end() if m else len(word)


def _short_end(word: str) -> bool:
    return bool(re.search(r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$", word))


def _longest(word: str, endings) -> str:
    return max((e for e in endings if word.endswith(e)), key=len, default="")


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The Porter2 stem of a lower-case word."""
    if len(word) < 3:
        return word
    if word in _OWN or word in _ALONE:
        return _OWN.get(word, word)
    w = re.sub(r"(?:^|(?<=[aeiouy]))y", "Y", word.removeprefix("'"))
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None) or _region(w, 0)
    r2 = _region(w, r1)

    # step 1a: plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(r"[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in _AFTER_PLURAL:
        return w

    # step 1b: past and progressive
    end = _longest(w, ("eedly", "ingly", "edly", "eed", "ing", "ed"))
    if end in ("eed", "eedly"):
        w = w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
    elif end and re.search(r"[aeiouy]", w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLE):
            w = w[:-1]
        elif len(w) <= r1 and _short_end(w):
            w += "e"

    # step 1c: final y
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWEL:
        w = w[:-1] + "i"

    # step 2
    end = _longest(w, (*_STEP2, "ogi", "li"))
    if end and len(w) - len(end) >= r1:
        if end in _STEP2:
            w = w[: -len(end)] + _STEP2[end]
        elif end == "ogi" and w.endswith("logi"):
            w = w[:-1]
        elif end == "li" and len(w) > 2 and w[-3] in "cdeghkmnrt":
            w = w[:-2]

    # step 3
    end = _longest(w, (*_STEP3, "ative"))
    if end and len(w) - len(end) >= r1:
        if end == "ative":
            w = w[:-5] if len(w) - 5 >= r2 else w
        else:
            w = w[: -len(end)] + _STEP3[end]

    # step 4
    end = _longest(w, (*_STEP4, "ion"))
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]

    # step 5
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()

"""Suffix stripping after Porter's paper of 1980, with later additions, and an Arrow UDF over word lists."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as Y

#: The paper's suffixes and what they become, with the measure the stem must exceed.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)

#: What the extended rules change and add, and the words that follow none.
STEP2_EXTENDED = (*(("bli", "ble") if p[0] == "abli" else p for p in STEP2), ("fulli", "ful"), ("logi", "log"))
IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}

STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(stem: str) -> str:
    """c and v for consonants and vowels; y is a vowel after a consonant."""
    out = ""
    for k, letter in enumerate(stem):
        out += "v" if letter in "aeiou" or (letter == "y" and k and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short(word: str, extended: bool = False) -> bool:
    """Whether a word ends in consonant, vowel, consonant, or, extended, is a vowel and a consonant."""
    shape = _shape(word)
    return (shape.endswith("cvc") and word[-1] not in "wxy") or (extended and shape == "vc")


def _swap(word: str, pairs: tuple[tuple[str, str], ...]) -> str:
    best = max((p for p in pairs if word.endswith(p[0])), key=lambda p: len(p[0]), default=None)
    # "logi" is judged with its first letter, so that "geologi" becomes "geolog".
    if best and _measure(word[: len(word) - len(best[0]) + (best[0] == "logi")]) > 0:
        return word[: len(word) - len(best[0])] + best[1]
    return word


@lru_cache(1 << 16)
def stem(word: str, extended: bool = True) -> str:
    """Stem of a lower-case word; words of one or two letters stay.

    ``extended`` adds what a widely used library of language tools adds to the paper's rules.
    """
    if extended and word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    if extended and word.endswith("ies") and len(word) == 4:
        word = word[:-1]
    else:
        for end, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
            if word.endswith(end):
                word = word[: len(word) - len(end)] + to
                break
    cut = None
    if extended and word.endswith("ied"):
        word = word[:-1] if len(word) == 4 else word[:-2]
    elif word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    elif word.endswith("ed") and "v" in _shape(word[:-2]):
        cut = word[:-2]
    elif word.endswith("ing") and "v" in _shape(word[:-3]):
        cut = word[:-3]
    if cut is not None:
        if cut.endswith(("at", "bl", "iz")):
            cut += "e"
        elif _double(cut):
            cut = cut[:-1] if cut[-1] not in "lsz" else cut
        elif _measure(cut) == 1 and _short(cut, extended):
            cut += "e"
        word = cut
    if word.endswith("y"):
        base = word[:-1]
        if (len(base) > 1 and _shape(base)[-1] == "c") if extended else "v" in _shape(base):
            word = base + "i"
    if extended and word.endswith("alli") and _measure(word[:-4]) > 0:
        word = word[:-2]
    word = _swap(_swap(word, STEP2_EXTENDED if extended else STEP2), STEP3)
    end = max((e for e in STEP4 if word.endswith(e)), key=len, default="")
    base = word[: len(word) - len(end)]
    if end and _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
        word = base
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short(word[:-1], extended))):
        word = word[:-1]
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(Y.ArrayType(Y.StringType()))
def stems(words: pd.Series) -> pd.Series:
    """Stems of each list of words."""
    return words.map(lambda own: None if own is None else [stem(w) for w in own])

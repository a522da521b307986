"""Porter's stemmer (1980) over distinct words, and words without marks on their letters."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_C, _V = "[^aeiou](?:[^aeiouy]*)", "[aeiouy](?:[aeiou]*)"
_MEASURE = re.compile(f"^(?:{_C})?((?:{_V}{_C})*)(?:{_V})?$")
_PAIR = re.compile(f"{_V}{_C}")
_VOWEL = re.compile(f"^(?:{_C})?{_V}")
_CVC = re.compile("^(?:[^aeiou][^aeiouy]*)[aeiouy][^aeiouwxy]$")
#: Endings of steps 2, 3 and 4 of the algorithm.
_SECOND = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def measure(stem: str) -> int:
    """How many times a vowel part is followed by a consonant part."""
    m = _MEASURE.match(stem)
    return len(_PAIR.findall(m[1])) if m else 0


def _longest(word: str, endings) -> str | None:
    return next((e for e in sorted(endings, key=len, reverse=True) if word.endswith(e)), None)


def _mended(word: str) -> str:
    """What follows when -ed or -ing was taken off."""
    if word.endswith(("at", "bl", "iz")):
        return word + "e"
    if len(word) > 1 and word[-1] == word[-2] and word[-1] not in "aeioulsz":
        return word[:-1]
    return word + "e" if measure(word) == 1 and _CVC.match(word) else word


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case English word; words of one or two letters and others than a to z stay."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith("s"):
        word = word[:-2] if word.endswith(("sses", "ies")) else word if word.endswith("ss") else word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) else word
    else:
        cut = _longest(word, ("ed", "ing"))
        if cut and _VOWEL.match(word[: -len(cut)]):
            word = _mended(word[: -len(cut)])
    if word.endswith("y") and _VOWEL.match(word[:-1]):
        word = word[:-1] + "i"
    for table in (_SECOND, _THIRD):
        end = _longest(word, table)
        if end and measure(word[: -len(end)]):
            word = word[: -len(end)] + table[end]
    end = _longest(word, _FOURTH)
    if end and measure(word[: -len(end)]) > 1 and (end != "ion" or word[:-3].endswith(("s", "t"))):
        word = word[: -len(end)]
    if word.endswith("e"):
        m = measure(word[:-1])
        word = word[:-1] if m > 1 or m == 1 and not _CVC.match(word[:-1]) else word
    return word[:-1] if word.endswith("ll") and measure(word[:-1]) > 1 else word


def plain(word: str) -> str:
    """Lower case, without marks on letters."""
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))


@F.pandas_udf(StringType())
def stemmed(word: pd.Series) -> pd.Series:
    """Stems of words; null stays null."""
    return word.map(lambda w: stem(plain(w)) if w else w)

"""Porter's stemmer for English, applied to vocabularies: each distinct term once, never each word of a text."""

from __future__ import annotations

import re
from functools import lru_cache



def _kinds(stem: str) -> str:
    """v for each vowel, c for each consonant; y is a vowel after a consonant."""
    out = ""
    for c in stem:
        out += "v" if c in "aeiou" or (c == "y" and out[-1:] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _kinds(stem)))


def _short(stem: str) -> bool:
    """Whether it ends consonant, vowel, consonant, the last none of w, x, y."""
    return _kinds(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


# The endings of the algorithm's second to fourth steps.
SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _replace(word: str, endings: dict[str, str], least: int) -> str:
    for e in sorted(endings, key=len, reverse=True):
        if word.endswith(e):
            return word[: -len(e)] + endings[e] if _measure(word[: -len(e)]) > least else word
    return word


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a term in lower case; terms with other letters than a to z, and short ones, stay."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    w = word
    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for e in ("ed", "ing"):
            if w.endswith(e) and "v" in _kinds(w[: -len(e)]):
                w = w[: -len(e)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w[-1:] == w[-2:-1] and _kinds(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _kinds(w[:-1]):
        w = w[:-1] + "i"
    w = _replace(_replace(w, SECOND, 0), THIRD, 0)
    for e in sorted(FOURTH, key=len, reverse=True):
        if w.endswith(e):
            if _measure(w[: -len(e)]) > 1 and (e != "ion" or w[: -len(e)][-1:] in ("s", "t")):
                w = w[: -len(e)]
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w

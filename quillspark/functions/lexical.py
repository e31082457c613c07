"""Tokens for ranked search: Unicode folding, and Porter's stemmer (M. F. Porter, An algorithm for suffix stripping,
1980)."""

from __future__ import annotations

import re
import unicodedata

_TOKEN = re.compile(r"[^\W_]+")


class _Marks(dict):
    """A translation that drops combining marks, and learns characters as they come."""

    def __missing__(self, c: int) -> int | None:
        self[c] = out = None if unicodedata.combining(chr(c)) else c
        return out


def fold_tokens(text: str, marks: dict = _Marks()) -> list[str]:  # noqa: B008
    """Runs of letters and digits in lower case, without combining marks."""
    plain = text if text.isascii() else unicodedata.normalize("NFD", text).translate(marks)
    return _TOKEN.findall(plain.lower())


def _consonants(w: str) -> str:
    """w's letters as c (consonant) or v (vowel)."""
    out = ""
    for i, c in enumerate(w):
        out += "v" if c in "aeiou" or c == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _consonants(stem)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonants(w)[-1] == "c"


def _short(w: str) -> bool:
    return len(w) > 2 and _consonants(w)[-3:] == "cvc" and w[-1] not in "wxy"


# The algorithm's suffixes and what they turn into.
_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log".split()
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split()
_STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def stem(w: str) -> str:
    if len(w) < 3 or not w.isascii():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in _consonants(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _consonants(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        hit = max((r.split(":") for r in rules if w.endswith(r.split(":")[0])), key=lambda r: len(r[0]), default=None)
        if hit and _measure(w[: -len(hit[0])]) > 0:
            w = w[: -len(hit[0])] + hit[1]
    ends = [e for e in _STEP4 if w.endswith(e)] + (["ion"] if re.search("[st]ion$", w) else [])
    if ends:
        end = max(ends, key=len)
        if _measure(w[: -len(end)]) > 1:
            w = w[: -len(end)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _short(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


#: Stems that are remembered from text to text.
REMEMBERED = 200_000


def stems(text: str, known: dict[str, str] | None = None) -> list[str]:
    """known: what the caller keeps between texts; it's emptied when it holds REMEMBERED words."""
    known = {} if known is None else known
    if len(known) > REMEMBERED:
        known.clear()
    return [known.get(t) or known.setdefault(t, stem(t)) for t in fold_tokens(text)]

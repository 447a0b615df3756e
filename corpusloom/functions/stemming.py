"""Porter's stemmer (1980) with the later departures and extensions that score packages use, and subsequences by bits."""

from __future__ import annotations

from functools import lru_cache

#: Words with a stem of their own (fixed values).
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning",
    "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
#: Suffixes of steps 2, 3 and 4, and what takes their place (fixed values).
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive",
    "biliti": "ble", "fulli": "ful", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """v for vowels and c for consonants; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out[-1:] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    """How often a vowel stands before a consonant."""
    return _shape(stem).count("vc")


def _short_end(word: str) -> bool:
    """Consonant, vowel, consonant (but w, x, y) at the end, or a whole word of vowel and consonant."""
    s = _shape(word)
    return s == "vc" or (s.endswith("cvc") and word[-1] not in "wxy")


def _plural(w: str) -> str:
    if w.endswith("ies"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("sses"):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _past(w: str) -> str:
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    stem = next((w[: -len(x)] for x in ("ed", "ing") if w.endswith(x) and "v" in _shape(w[: -len(x)])), None)
    if stem is None:
        return w
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if stem[-1:] == stem[-2:-1] and _shape(stem)[-1] == "c":
        return stem if stem[-1] in "lsz" else stem[:-1]
    return stem + "e" if _measure(stem) == 1 and _short_end(stem) else stem


def _end_y(w: str) -> str:
    return w[:-1] + "i" if w.endswith("y") and len(w) > 2 and _shape(w)[-2] == "c" else w


def _longest(w: str, table) -> str | None:
    return max((x for x in table if w.endswith(x)), key=len, default=None)


def _step_2(w: str) -> str:
    x = _longest(w, STEP_2)
    if x is None or _measure(w[: len(w) - len(x)] if x != "logi" else w[:-3]) == 0:
        return w
    out = w[: -len(x)] + STEP_2[x]
    return _step_2(out) if x == "alli" else out


def _step_3(w: str) -> str:
    x = _longest(w, STEP_3)
    return w if x is None or _measure(w[: -len(x)]) == 0 else w[: -len(x)] + STEP_3[x]


def _step_4(w: str) -> str:
    x = _longest(w, STEP_4)
    if x is None:
        return w
    stem = w[: -len(x)]
    return stem if _measure(stem) > 1 and (x != "ion" or stem[-1:] in ("s", "t")) else w


def _step_5(w: str) -> str:
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short_end(w[:-1])):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    for step in (_plural, _past, _end_y, _step_2, _step_3, _step_4, _step_5):
        word = step(word)
    return word


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence: a row of the table is one number, whose zeros are the steps so far."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & places.get(y, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()

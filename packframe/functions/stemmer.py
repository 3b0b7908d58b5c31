"""The Porter stemmer (M. F. Porter, An algorithm for suffix stripping, 1980)."""

from __future__ import annotations

from functools import lru_cache

_SECOND = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_THIRD = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_FOURTH = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _consonants(word: str) -> list[bool]:
    out: list[bool] = []
    for i, c in enumerate(word):
        out.append(c not in "aeiou" and not (c == "y" and i > 0 and out[-1]))
    return out


def _measure(part: str) -> int:
    """How many runs of vowels are followed by a run of consonants."""
    kinds = _consonants(part)
    return sum(1 for a, b in zip(kinds, kinds[1:]) if not a and b)


def _vowel(part: str) -> bool:
    return not all(_consonants(part))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _consonants(word)[-1]


def _short(word: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    kinds = _consonants(word)
    return len(word) > 2 and kinds[-3:] == [True, False, True] and word[-1] not in "wxy"


def _replaced(word: str, table: list[tuple[str, str]]) -> str:
    """The longest ending that fits, replaced if what is before it has a measure of 1 or more."""
    for end, new in sorted(table, key=lambda x: -len(x[0])):
        if word.endswith(end):
            return word[: -len(end)] + new if _measure(word[: -len(end)]) > 0 else word
    return word


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of up to two letters are their own."""
    if len(word) < 3:
        return word
    # Step 1: plurals, -ed, -ing, -y.
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and _vowel(word[: -len(end)]):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _double(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short(word):
                    word += "e"
                break
    if word.endswith("y") and _vowel(word[:-1]):
        word = word[:-1] + "i"
    # Steps 2 to 4: longer endings.
    word = _replaced(_replaced(word, _SECOND), _THIRD)
    for end in sorted(_FOURTH, key=len, reverse=True):
        if word.endswith(end):
            part = word[: -len(end)]
            if _measure(part) > 1 and (end != "ion" or part.endswith(("s", "t"))):
                word = part
            break
    # Step 5: a last e, a double l.
    if word.endswith("e"):
        part = word[:-1]
        if _measure(part) > 1 or (_measure(part) == 1 and not _short(part)):
            word = part
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word

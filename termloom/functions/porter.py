"""Porter's stemmer, with the usual extensions behind a flag; applied to distinct terms by an Arrow UDF."""

from __future__ import annotations

from collections.abc import Callable

# Suffix tables of the published algorithm, longest match first within a step's endings.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
EXTENDED2 = {end: new for end, new in STEP2.items() if end != "abli"} | {"bli": "ble", "fulli": "ful"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
ENDS4 = {n: frozenset(e for e in STEP4 if len(e) == n) for n in (5, 4, 3, 2)}
#: Last two letters of the endings that some step looks for, but those in e, s and y.
TAILS = frozenset(e[-2:] for e in [*STEP2, *EXTENDED2, *STEP3, *STEP4, "ed", "ing", "logi", "ll"])
IRREGULAR = {"sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed"}


class _Kinds(dict):
    def __missing__(self, code: int) -> str:
        return "c"


_KINDS = _Kinds({ord(c): "v" for c in "aeiou"})


def kinds(word: str) -> str:
    """c for each consonant, v for each vowel; a y after a consonant is a vowel. A beginning's kinds are the beginning of its word's."""
    out = word.translate(_KINDS)
    at = word.find("y", 1)
    while at > 0:
        if out[at - 1] == "c":
            out = out[:at] + "v" + out[at + 1 :]
        at = word.find("y", at + 1)
    return out


def measure(stem: str) -> int:
    """Number of vowel-consonant sequences."""
    return kinds(stem).count("vc")


def has_vowel(stem: str) -> bool:
    return "v" in kinds(stem)


def doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and kinds(word)[-1] == "c"


def short_end(word: str, extended: bool) -> bool:
    """Consonant, vowel, consonant that isn't w, x or y."""
    if len(word) > 2 and word[-1] not in "wxy" and kinds(word)[-3:] == "cvc":
        return True
    return extended and len(word) == 2 and kinds(word) == "vc"


def _replace(word: str, table: dict[str, str], ok: Callable[[str], bool]) -> str:
    for n in range(min(len(word), 8), 0, -1):
        if (end := word[-n:]) in table:
            stem = word[:-n]
            return stem + table[end] if ok(stem) else word
    return word


def stem(word: str, extended: bool = True) -> str:
    word = word.lower()
    if word[-1:] not in ("e", "s", "y") and word[-2:] not in TAILS:
        return word
    if extended and word in IRREGULAR:
        return IRREGULAR[word]
    if extended and len(word) <= 2:
        return word
    # plurals
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith("ies"):
        word = word[:-1] if extended and len(word) == 4 else word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    word = _past(word, extended)
    # final y
    if word.endswith("y"):
        rest = word[:-1]
        if (len(rest) > 1 and kinds(rest)[-1] == "c") if extended else has_vowel(rest):
            word = rest + "i"
    word = _second(word, extended)
    word = _replace(word, STEP3, lambda s: measure(s) > 0)
    for n, ends in ENDS4.items():
        if (end := word[-n:]) in ends:
            rest = word[:-n]
            if measure(rest) > 1 and (end != "ion" or rest[-1:] in ("s", "t")):
                word = rest
            break
    if word.endswith("e"):
        rest = word[:-1]
        if measure(rest) > 1 or measure(rest) == 1 and not short_end(rest, extended):
            word = rest
    return word[:-1] if word.endswith("ll") and measure(word[:-1]) > 1 else word


def _past(word: str, extended: bool) -> str:
    if extended and word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) > 0 else word
    for end in ("ed", "ing"):
        if word.endswith(end) and has_vowel(word[: -len(end)]):
            word = word[: -len(end)]
            if word.endswith(("at", "bl", "iz")):
                return word + "e"
            if doubled(word):
                return word if word[-1] in "lsz" else word[:-1]
            return word + "e" if measure(word) == 1 and short_end(word, extended) else word
    return word


def _second(word: str, extended: bool) -> str:
    if extended:
        if word.endswith("alli") and measure(word[:-4]) > 0:
            return _second(word[:-4] + "al", extended)
        if word.endswith("logi"):
            return word[:-1] if measure(word[:-3]) > 0 else word
    return _replace(word, EXTENDED2 if extended else STEP2, lambda s: measure(s) > 0)


def stem_udf(extended: bool = True):
    """Column function over an Arrow batch of terms."""
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def stemmed(terms):
        known = {t: stem(t, extended) for t in terms.unique() if t is not None}
        return terms.map(known)

    return stemmed

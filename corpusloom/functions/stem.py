"""Stems of English words by the published Snowball algorithm (Porter 2), over lists of words in Arrow batches."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

VOWELS = "aeiouy"
#: Words with stems of their own, and words that are left alone after their plural (fixed values of the algorithm).
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
LEFT_ALONE = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
#: Endings and what takes their place, where they lie in the first region (fixed values of the algorithm).
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
#: Endings that go where they lie in the second region (fixed values of the algorithm).
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")

_SECOND, _THIRD = tuple(SECOND), tuple(THIRD)
_REGION = re.compile(rf"[{VOWELS}][^{VOWELS}]")


def _after(word: str, start: int) -> int:
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


def _ending(word: str, endings: tuple[str, ...]) -> str:
    """The longest of the endings that the word has."""
    if not word.endswith(endings):  # most words, told at once
        return ""
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def _short(part: str) -> bool:
    """Whether a part of a word ends in a short syllable: vowel and consonant after a consonant, or these two alone."""
    if len(part) == 2:
        return part[0] in VOWELS and part[1] not in VOWELS
    return len(part) > 2 and part[-1] not in VOWELS + "wxY" and part[-2] in VOWELS and part[-3] not in VOWELS


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of two letters, and others than English ones in a-z, are left as they are."""
    if len(word) < 3 or not word.isascii():
        return word
    if word in WHOLE:
        return WHOLE[word]
    w = re.sub(rf"^y|(?<=[{VOWELS}])y", "Y", word.lstrip("'"))
    # the regions don't move: what is cut lies at the end
    prefix = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = len(prefix) if prefix else _after(w, 0)
    r2 = _after(w, r1)
    w = re.sub(r"'(?:s'?)?$", "", w)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{VOWELS}]", w[:-2]):
        w = w[:-1]
    if w in LEFT_ALONE:
        return w.lower()
    # past and progressive
    e = _ending(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if e in ("eed", "eedly"):
        w = w[: -len(e)] + "ee" if len(w) - len(e) >= r1 else w
    elif e and re.search(f"[{VOWELS}]", w[: -len(e)]):
        w = w[: -len(e)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif r1 >= len(w) and _short(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    # endings that make one part of speech of another
    e = _ending(w, _SECOND)
    if e and len(w) - len(e) >= r1 and (e != "ogi" or w[-4:-3] == "l") and (e != "li" or w[-3:-2] in tuple("cdeghkmnrt")):
        w = w[: -len(e)] + SECOND[e]
    e = _ending(w, _THIRD)
    if e and len(w) - len(e) >= (r2 if e == "ative" else r1):
        w = w[: -len(e)] + THIRD[e]
    e = _ending(w, FOURTH)
    if e and len(w) - len(e) >= r2 and (e != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(e)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short(w[:-1]))) or (w.endswith("ll") and len(w) - 1 >= r2):
        w = w[:-1]
    return w.lower()


def stems(words: Column) -> Column:
    """Each word of an array by its stem; a word that a batch has often is cut once."""
    @F.arrow_udf("array<string>")
    def cut(lists: pa.Array) -> pa.Array:
        lists = lists.cast(pa.list_(pa.string()))
        coded = lists.flatten().dictionary_encode()
        known = pa.array([w if w is None else stem(w) for w in coded.dictionary.to_pylist()], pa.string())
        sizes = [0 if x is None else x for x in lists.value_lengths().to_pylist()]
        ends, at = [0], 0
        for n in sizes:
            at += n
            ends.append(at)
        offsets = pa.array([None if not ok else x for x, ok in zip(ends, [*lists.is_valid().to_pylist(), True], strict=True)], pa.int32())
        return pa.ListArray.from_arrays(offsets, known.take(coded.indices))

    return cut(words)

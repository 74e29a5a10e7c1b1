"""Text analysis: tokens, stop words, tags, stems (English Porter2), phonetic codes."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .metaphone import double_metaphone
from .stemmers import danish, german, norwegian, spanish, swedish

SEPARATORS = " \t,./(){}[]:;~!@#$%^&*-=+|'`\"<>?"
STOPWORDS = ("a is the an and are as at be but by for if in into it no not of on or such that their then there these they this to was will with").split()
_CLASS = "".join("\\" + c if c in "\\]^-[&" else c for c in SEPARATORS) + "\\x00-\\x1f"
#: possessive, so a long token is a loop in Java and not a recursion
TOKEN_PATTERN = rf"(?:[^{_CLASS}\\]++|\\.)++"
MULTI_VALUE_GAP = 100
MIN_STEM_LENGTH = 4
MIN_PHONETIC_LENGTH = 3


def tokens(col: Column, stopwords: list[str] | None = None) -> Column:
    """Lower-cased tokens without stop words; a backslash keeps the next character. Positions are places in this array."""
    found = F.regexp_extract_all(F.lower(col), F.lit(TOKEN_PATTERN), F.lit(0))
    stop = STOPWORDS if stopwords is None else stopwords
    # a text without a backslash has its tokens as they were found
    clean = F.when(col.contains("\\"), F.transform(found, lambda t: F.regexp_replace(t, r"\\(.)", "$1"))).otherwise(found)
    return F.coalesce(F.filter(clean, lambda t: ~t.isin(stop)) if stop else clean, F.array().cast("array<string>"))


def tokens_of(text: str, stopwords: list[str] | None = None) -> list[str]:
    """The same for a text of a query."""
    stop = set(STOPWORDS if stopwords is None else stopwords)
    found = [re.sub(r"\\(.)", r"\1", t) for t in re.findall(TOKEN_PATTERN, text.lower())]
    return [t for t in found if t not in stop]


def tags(col: Column, separator: str | None = ",", case_sensitive: bool = False, is_array: bool = False, index_empty: bool = False) -> Column:
    if not is_array:
        col = F.split(col, re.escape(separator)) if separator else F.array(col)
    elif separator:
        col = F.flatten(F.transform(col, lambda x: F.split(x, re.escape(separator))))
    out = F.transform(col, lambda t: F.trim(t))
    out = out if case_sensitive else F.transform(out, lambda t: F.lower(t))
    return out if index_empty else F.filter(out, lambda t: t != "")


# -- Porter2 for English ------------------------------------------------------------------------------------------------

_VOWELS = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_INVARIANT = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes", "inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = (("ational", "ate"), ("fulness", "ful"), ("iveness", "ive"), ("ization", "ize"), ("ousness", "ous"), ("biliti", "ble"), ("lessli", "less"), ("tional", "tion"), ("alism", "al"), ("aliti", "al"), ("ation", "ate"), ("entli", "ent"), ("fulli", "ful"), ("iviti", "ive"), ("ousli", "ous"), ("abli", "able"), ("alli", "al"), ("anci", "ance"), ("ator", "ate"), ("enci", "ence"), ("izer", "ize"), ("bli", "ble"))
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def _regions(w: str) -> tuple[int, int]:
    for p in ("gener", "commun", "arsen"):
        if w.startswith(p):
            r1 = len(p)
            break
    else:
        m = re.search(r"[aeiouy][^aeiouy]", w)
        r1 = m.end() if m else len(w)
    m = re.search(r"[aeiouy][^aeiouy]", w[r1:])
    return r1, (r1 + m.end() if m else len(w))


def _short_end(w: str) -> bool:
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", w) or re.fullmatch(r"[aeiouy][^aeiouy]", w))


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The English stem of a lower-case word."""
    if len(word) <= 2 or not word.isascii():
        return word
    if word in _EXCEPTIONS:
        return _EXCEPTIONS[word]
    if word in _INVARIANT:
        return word
    w = word.lstrip("'")
    w = re.sub(r"^y", "Y", w)
    w = re.sub(r"([aeiouy])y", r"\1Y", w)
    r1, r2 = _regions(w)
    w = re.sub(r"('s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(r"[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in _INVARIANT:
        return w
    if w.endswith(("eed", "eedly")):
        cut = 3 if w.endswith("eed") else 5
        if len(w) - cut >= r1:
            w = w[:-cut] + "ee"
    else:
        for s in ("ingly", "edly", "ing", "ed"):
            if w.endswith(s):
                if re.search(r"[aeiouy]", w[: -len(s)]):
                    w = w[: -len(s)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif w.endswith(_DOUBLES):
                        w = w[:-1]
                    elif r1 >= len(w) and _short_end(w):
                        w += "e"
                break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    for s, r in _STEP2:
        if w.endswith(s):
            if len(w) - len(s) >= r1:
                w = w[: -len(s)] + r
            break
    else:
        if w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple("cdeghkmnrt"):
            w = w[:-2]
    for s, r in _STEP3:
        if w.endswith(s):
            if len(w) - len(s) >= r1:
                w = w[: -len(s)] + r
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    for s in _STEP4:
        if w.endswith(s):
            if len(w) - len(s) >= r2:
                w = w[: -len(s)]
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
            w = w[:-3]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


#: language -> stemmer; further languages are put in by the caller
STEMMERS: dict[str, Callable[[str], str]] = {"english": stem, "swedish": swedish, "danish": danish, "norwegian": norwegian, "german": german, "spanish": spanish}


def stemmer(language: str | None, least: int = MIN_STEM_LENGTH) -> Callable[[str], str] | None:
    """A language's stems of words of `least` characters and more; None where the language has no stemmer."""
    make = STEMMERS.get((language or "").lower())
    return None if make is None else lambda w: make(w) if len(w) >= least else w


def stems(col: Column, language: str | Column = "english", least: int = MIN_STEM_LENGTH) -> Column:
    """The stem of each token of an array, by one language or one a row; tokens shorter than `least` stay as they are."""

    def of(words, language):
        make = stemmer(language, least)
        return None if words is None else list(words) if make is None else [make(w) for w in words]

    if isinstance(language, str):

        @F.pandas_udf("array<string>")
        def run(x: pd.Series) -> pd.Series:
            return x.map(lambda ws: of(ws, language))

        return run(col)

    @F.pandas_udf("array<string>")
    def run_each(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([of(ws, lang) for ws, lang in zip(x, y, strict=True)], dtype=object)

    return run_each(col, language)


def phonetic(word: str) -> str:
    """The primary double metaphone code of a word."""
    return double_metaphone(word)[0]


def phonetics(col: Column, least: int = MIN_PHONETIC_LENGTH) -> Column:
    @F.pandas_udf("array<string>")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda ws: None if ws is None else [phonetic(w) if len(w) >= least else w for w in ws])

    return run(col)

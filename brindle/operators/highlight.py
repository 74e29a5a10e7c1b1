"""Highlighting and summaries of matched terms."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.analysis import MIN_STEM_LENGTH, SEPARATORS, stem

_EDGE = "".join("\\" + c if c in "\\]^-[&" else c for c in SEPARATORS)


def _text_fields(df: DataFrame, fields: list[str] | None) -> list[str]:
    return fields or [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and not f.name.startswith("__")]


def highlight(col: Column, words: list[str], opening: str = "<b>", closing: str = "</b>") -> Column:
    """Each whole word among `words`, whatever its case, between the tags; in the JVM."""
    if not words:
        return col
    some = "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))
    quote = lambda s: s.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(col, rf"(?iu)(?<=^|[{_EDGE}\s])({some})(?=$|[{_EDGE}\s])", quote(opening) + "$1" + quote(closing))


def highlight_stems(col: Column, words: list[str], stemmer: Callable[[str], str], least: int, opening: str, closing: str) -> Column:
    """As highlight(), with each word too whose stem is that of one of `words`."""
    exact, roots = set(words), {stemmer(w) for w in words if len(w) >= least}
    word = re.compile(rf"[^{_EDGE}\s]+")

    def mark(m: re.Match) -> str:
        t = m[0].lower()
        return f"{opening}{m[0]}{closing}" if t in exact or (len(t) >= least and stemmer(t) in roots) else m[0]

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else word.sub(mark, t))

    return run(col)


def highlighted(df: DataFrame, words: list[str], fields: list[str] | None = None, tags: tuple[str, str] = ("<b>", "</b>"), stemmers: dict[str, Callable] | None = None, least: int = MIN_STEM_LENGTH) -> DataFrame:
    """stemmers: field -> stemmer of those fields whose words match by their stems."""
    stemmers = stemmers or {}
    of = lambda f: highlight_stems(F.col(f"`{f}`"), words, stemmers[f], least, *tags) if f in stemmers and words else highlight(F.col(f"`{f}`"), words, *tags)
    return df.withColumns({f: of(f) for f in _text_fields(df, fields)})


def fragments(text: str, words: set[str], most: int = 3, size: int = 20, separator: str = "... ") -> str:
    """The best fragments of a text: around matches, scored by distinct terms, with context split evenly."""
    spans = [(m.start(), m.end()) for m in re.finditer(rf"[^{_EDGE}\s]+", text)]
    stems_ = {stem(w) for w in words if len(w) >= MIN_STEM_LENGTH}
    hits = [i for i, (a, b) in enumerate(spans) if (t := text[a:b].lower()) in words or (len(t) >= MIN_STEM_LENGTH and stem(t) in stems_)]
    if not hits:
        return separator.join([text[: spans[min(size, len(spans)) - 1][1]]]) + separator if spans else text
    found: list[list[int]] = []
    for i in hits:
        if found and i - found[-1][-1] <= size // 2 and i - found[-1][0] < size:
            found[-1].append(i)
        else:
            found.append([i])
    scored = sorted(range(len(found)), key=lambda k: (-len({text[spans[i][0] : spans[i][1]].lower() for i in found[k]}), k))[:most]
    out = []
    for k in sorted(scored):
        first, last = found[k][0], found[k][-1]
        around = max(0, size - (last - first + 1))
        lo, hi = max(0, first - around // 2), min(len(spans) - 1, last + (around - around // 2))
        out.append(text[spans[lo][0] : spans[hi][1]])
    return separator.join(out) + separator


def summarized(df: DataFrame, words: list[str], fields: list[str] | None = None, frags: int = 3, length: int = 20, separator: str = "... ") -> DataFrame:
    wanted = set(words)

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else fragments(t, wanted, frags, length, separator))

    return df.withColumns({f: run(F.col(f"`{f}`")) for f in _text_fields(df, fields)})

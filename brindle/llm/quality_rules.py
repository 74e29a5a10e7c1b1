"""Quality rules: a threshold table compiled into one Spark projection; no user functions.

Measures. Words are the runs [^\\x20\\x09-\\x0D]+ of the text. n_words, word_chars (code points in words), n_symbols
(characters of `[#*$%&|<>]`), n_dup_lines (lines with a word that equal an earlier line), n_repeat_words (words inside
3-word windows found twice or more in the text) and n_stop_words (words in a list for the four languages) come from array
expressions over the text alone, so there is no shuffle and a document's cost is n log n in its words.
A rule is a row (name, numerator, denominator, lowest, highest); it fails where the ratio leaves the range.

Defined results. Null or empty text: no words, all measures 0, base_failed. Repeated rows and null doc_ids: each row is
judged by itself. Very long texts: one row's arrays, some tens of bytes a word. An empty table gives an empty table.
Other columns pass through, but measure() and judge() replace those that are named like what they add, in any case;
filter_documents gives all columns as they came.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STOP_WORDS = sorted(
    set(
        "the of and to in is that it was for on are as with his they at be this have from or had by not but what all were we when "
        "der die das und ist in zu den mit von auf für nicht ein eine sich des dem im es an auch als wie "
        "le la les de des du et est que qui dans un une pour pas sur au aux avec ce il elle ne se en par "
        "el los las y es que en un una por con para del se no su al lo como más".split()
    )
)


@dataclass(frozen=True)
class Rule:
    """Fails where numerator / denominator is under lowest or over highest; a zero denominator passes."""

    name: str
    numerator: str
    denominator: str
    lowest: float | None = None
    highest: float | None = None


#: base rules, exact in integers: see base_failed(). These are the method's further thresholds.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 12.0),
    Rule("symbol_ratio", "n_symbols", "n_words", None, 0.1),
    Rule("duplicate_line_ratio", "n_dup_lines", "n_lines", None, 0.5),
    Rule("stop_word_ratio", "n_stop_words", "n_words", 0.01, 0.95),
)
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def _run_marks(sorted_windows: str) -> Column:
    """Positions, ascending, of the windows whose hash occurs twice or more; sorted_windows: array of (h, i), sorted."""
    s = F.col(sorted_windows)
    n = F.size(s)
    twice = F.filter(
        F.sequence(F.lit(0), n - 1),
        lambda j: F.coalesce(F.get(s, j - 1)["h"] == F.get(s, j)["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == F.get(s, j)["h"], F.lit(False)),
    )
    return F.when(n > 0, F.sort_array(F.transform(twice, lambda j: F.get(s, j)["i"]))).otherwise(F.array().cast("array<int>"))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words (long)."""
    kept = docs.columns
    body = F.coalesce(F.col(text), F.lit(""))
    # tabs, line feeds and so on become spaces, so that the split is at one character and takes the JVM's fast path
    spaced = F.translate(body, "\t\n\x0b\x0c\r", "     ")
    names = {c: f"__in{j}" for j, c in enumerate(kept)}
    base = docs.select(*[F.col(f"`{c}`").alias(names[c]) for c in kept], body.alias("__body"), F.filter(F.split(spaced, " "), lambda w: w != "").alias("__words"))
    lines = F.filter(F.split("__body", "\n"), lambda x: F.trim(F.translate(x, "\t\x0b\x0c\r", "    ")) != "")
    base = base.withColumn("__lines", lines)
    w = F.col("__words")
    windows = F.when(
        F.size(w) >= 3,
        F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))),
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    base = base.withColumn("__windows", windows)
    base = base.withColumn("__marks", _run_marks("__windows"))
    m = F.col("__marks")
    covered = F.when(F.size(m) > 0, F.aggregate(F.sequence(F.lit(0), F.size(m) - 1), F.lit(0), lambda acc, j: acc + F.least(F.lit(3), F.coalesce(F.get(m, j + 1) - F.get(m, j), F.lit(3))))).otherwise(0)
    stop = F.filter(F.transform("__words", lambda x: F.lower(x)), lambda x: x.isin(STOP_WORDS))
    made = F.struct(
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        (F.length("__body") - F.length(F.translate("__body", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.size(stop).cast("long").alias("n_stop_words"),
    )
    # A filter on a measure is not pushed below inline(). Below the projections it would put the arrays' expressions into the
    # lambdas over them and compute them again for each of their elements.
    return base.select(*[F.col(names[c]).alias(c) for c in kept if c.lower() not in (*MEASURES, "base_failed", "kept")], F.inline(F.array(made)))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def passes(rules: tuple[Rule, ...] = RULES) -> Column:
    """The threshold table as one boolean expression over the measures."""
    ok = F.lit(True)
    for r in rules:
        top, bottom = F.col(r.numerator).cast("double"), F.col(r.denominator).cast("double")
        if r.lowest is not None:
            ok = ok & (top >= r.lowest * bottom)
        if r.highest is not None:
            ok = ok & (top <= r.highest * bottom)
    return ok


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """measure() with base_failed and kept."""
    out = measure(docs, text).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & passes(rules))


def filter_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with the columns they came with (measure names in the input are kept aside)."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    return judge(packed, rules).where("kept").select("row.*")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).select("doc_id", *MEASURES[:5], "base_failed", "kept", "n_lines", "n_stop_words")


def _rules_sql(rules: tuple[Rule, ...] = RULES) -> str:
    terms = []
    for r in rules:
        if r.lowest is not None:
            terms.append(f"{r.numerator}::DOUBLE >= {r.lowest}::DOUBLE * {r.denominator}::DOUBLE")
        if r.highest is not None:
            terms.append(f"{r.numerator}::DOUBLE <= {r.highest}::DOUBLE * {r.denominator}::DOUBLE")
    return " AND ".join(terms)


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)
#: The measures in SQL; {source} is a table with doc_id and text, one row a doc_id.
MEASURE_SQL = rf"""
d AS (SELECT doc_id, coalesce(text, '') AS body FROM {{source}}),
w AS (
  SELECT doc_id, body, list_filter(string_split(translate(body, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda x: x <> '') AS ws,
    list_filter(string_split(body, chr(10)), lambda x: trim(translate(x, chr(9) || chr(11) || chr(12) || chr(13), '    '), ' ') <> '') AS ls
  FROM d
),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g),
r AS (SELECT doc_id, sum(least(3, coalesce(nxt - i, 3))) AS n_repeat_words FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM c WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(list_aggregate(list_concat(ws, ['']), 'string_agg', ''))::BIGINT AS word_chars,
    (length(body) - length(translate(body, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
    len(list_filter(ws, lambda x: lower(x) IN ({_STOP_SQL})))::BIGINT AS n_stop_words
  FROM w LEFT JOIN r USING (doc_id)
),
j AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed FROM m),
k AS (SELECT *, (NOT base_failed AND {_rules_sql()}) AS kept FROM j)
"""
OP10_SQL = "WITH " + MEASURE_SQL.format(source="documents") + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, n_stop_words FROM k"

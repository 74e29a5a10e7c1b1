"""Commands, the retrieval language and expressions on small collections."""

import pytest

from brindle.functions.analysis import phonetic, stem, tokens_of
from brindle.functions.metaphone import double_metaphone
from brindle.functions.stemmers import danish, german, norwegian, spanish, swedish
from brindle.operators.postings import STEM, Postings, postings, vocabulary
from brindle.plans.commands import CommandError, Engine, ExpressionError
from brindle.plans.query_language import QueryError


@pytest.fixture()
def fruits(spark):
    rows = [("a", "lemon", "yellow", 4.0, None), ("b", "banana bread", "yellow", 5.0, "ecuador"), ("c", "red apple pie", "red,green", 3.0, "china"), ("d", "apple", "green", None, "china"), ("e", "the running apples", "red", 9.5, "peru")]
    e = Engine(spark)
    e.register("fruits", spark.createDataFrame(rows, "__key string, name string, color string, sweetness double, origin string"))
    e.execute("FT.CREATE", "idx", "ON", "fruits", "SCHEMA", *"name TEXT SORTABLE color TAG sweetness NUMERIC origin TAG INDEXMISSING".split())
    return e


def keys(df):
    return sorted(r["__key"] for r in df.collect())


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("*", "abcde"), ("apple", "cde"), ('"apple"', "cd"), ("ap*", "cde"), ("*nan*", "b"), ("%lemn%", "a"), ("apple -pie", "de"), ("apple | lemon", "acde"), ("@color:{red}", "ce"),
        ("@color:{red | yellow}", "abce"), ("@sweetness:[4 (9.5]", "ab"), ("-@sweetness:[4 +inf]", "cd"), ("ismissing(@origin)", "a"), ('"apple pie"', "c"), ('"pie apple"', ""),
        ("(red pie)=>{$slop:0; $inorder:true}", ""), ("(red pie)=>{$slop:1; $inorder:true}", "c"), ("~lemon", "abcde"), ("run", ""), ("runs", "e"),
    ],
)
def test_retrieval(fruits, text, want):
    assert "".join(keys(fruits.execute("FT.SEARCH", "idx", text, "LIMIT", 0, 100, "NOCONTENT"))) == want


def test_counts_aliases_and_listing(fruits):
    assert fruits.execute("FT.SEARCH", "idx", "apple", "LIMIT", 0, 0) == 3
    fruits.execute("FT.ALIASADD", "also", "idx")
    assert fruits.execute("FT.SEARCH", "also", "*", "LIMIT", 0, 0) == 5
    assert fruits.execute("FT._LIST") == ["idx"]
    fruits.execute("FT.ALIASDEL", "also")
    with pytest.raises(ValueError):
        fruits.execute("FT.SEARCH", "also", "*")


def test_a_negative_count_gives_all_from_the_offset_on(fruits):
    page = lambda *limit: [r["__key"] for r in fruits.execute("FT.SEARCH", "idx", "*", "SORTBY", "__key", "LIMIT", *limit, "NOCONTENT").collect()]
    assert ("".join(page(0, -1)), "".join(page(2, -1)), "".join(page(1, 2))) == ("abcde", "cde", "bc")
    many = fruits.collections["fruits"].sparkSession.range(1_000_002).selectExpr("id AS __key", "'ring' AS name")
    fruits.register("many", many)
    fruits.execute("FT.CREATE", "all", "ON", "many", "SCHEMA", "name", "TEXT", "NOSTEM")
    assert fruits.execute("FT.SEARCH", "all", "*", "SORTBY", "__key", "LIMIT", 0, -1, "NOCONTENT").count() == 1_000_002


def test_groups_and_expressions(fruits):
    out = fruits.execute("FT.AGGREGATE", "idx", "*", "APPLY", "upper(@origin)", "AS", "o", "GROUPBY", 1, "@o", "REDUCE", "COUNT", 0, "AS", "n", "REDUCE", "AVG", 1, "@sweetness", "AS", "s")
    assert {r.o: (r.n, r.s) for r in out.collect()} == {None: (1, 4.0), "ECUADOR": (1, 5.0), "CHINA": (2, 3.0), "PERU": (1, 9.5)}


def test_cursors_read_all_pages(fruits):
    rows, cid = fruits.execute("FT.AGGREGATE", "idx", "*", "LOAD", 1, "@name", "WITHCURSOR", "COUNT", 2)
    seen = list(rows)
    while cid:
        rows, cid = fruits.execute("FT.CURSOR", "READ", "idx", cid)
        seen += rows
    assert len(seen) == 5


def test_dictionaries_synonyms_and_suggestions(fruits):
    assert fruits.execute("FT.DICTADD", "d", "x", "y", "x") == 2 and fruits.execute("FT.DICTDUMP", "d") == ["x", "y"]
    fruits.execute("FT.SYNUPDATE", "idx", "g", "lemon", "citrus")
    assert keys(fruits.execute("FT.SEARCH", "idx", "citrus", "NOCONTENT")) == ["a"]
    for word, score in (("hello", 1), ("help", 3), ("hero", 2)):
        fruits.execute("FT.SUGADD", "s", word, score)
    assert [r.string for r in fruits.execute("FT.SUGGET", "s", "hel").collect()] == ["help", "hello"]
    assert fruits.execute("FT.SUGDEL", "s", "help") == 1 and fruits.execute("FT.SUGLEN", "s") == 2


def test_writes_replace_and_delete(fruits):
    fruits.execute("FT.ADD", "idx", "a", 1.0, "REPLACE", "FIELDS", "name", "grape")
    assert keys(fruits.execute("FT.SEARCH", "idx", "grape", "NOCONTENT")) == ["a"]
    assert fruits.execute("FT.DEL", "idx", "a") == 1 and fruits.execute("FT.SEARCH", "idx", "*", "LIMIT", 0, 0) == 4


def test_errors(fruits):
    for words in (("FT.NOSUCH",), ("FT.SEARCH", "idx", "*", "BOGUS"), ("FT.AGGREGATE", "idx", "*", "BOGUS")):
        with pytest.raises(CommandError):
            fruits.execute(*words)
    for text in ("(", "@color:{", "@sweetness:[1", "@nosuch:word"):
        with pytest.raises((QueryError, ValueError)):
            fruits.execute("FT.SEARCH", "idx", text)


def test_sketches_of_many_groups_are_all_near(spark):
    e = Engine(spark)
    rows = spark.range(250_000).selectExpr("concat('k', id) AS __key", "id % 500 AS g", "id AS v", "id % 1000 AS part")
    e.register("rows", rows)
    e.execute("FT.CREATE", "rows", "ON", "rows", "SCHEMA", "v", "NUMERIC")
    by_g = ["GROUPBY", 1, "@g", "REDUCE"]
    for words in ([*by_g, "COUNT_DISTINCTISH", 1, "@v", "AS", "n"], ["GROUPBY", 2, "@g", "@part", "REDUCE", "HLL", 1, "@v", "AS", "s", *by_g, "HLL_SUM", 1, "@s", "AS", "n"]):
        counts = [r["n"] for r in e.execute("FT.AGGREGATE", "rows", "*", *words).collect()]
        assert len(counts) == 500 and all(abs(n - 500) <= 50 for n in counts)


def test_postings_score_as_a_scan_does(fruits, tmp_path, spark):
    e = Engine(spark)
    e.register("fruits", fruits.collections["fruits"])
    e.execute("FT.CREATE", "plain", "ON", "fruits", "SCHEMA", "name", "TEXT", "NOSTEM")
    asked = ("FT.SEARCH", "plain", "apple | lemon", "WITHSCORES", "NOCONTENT")
    want = {r["__key"]: round(r["__score"], 9) for r in e.execute(*asked).collect()}
    e.execute("FT.POSTINGS", "plain", str(tmp_path / "p"), "BUCKETS", 4)
    out = e.execute(*asked)
    assert {r["__key"]: round(r["__score"], 9) for r in out.collect()} == want and len(want) == 3
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "PartitionFilters: [((bucket" in plan.replace("isnotnull(bucket", "((bucket")
    # a write makes the postings out of date
    e.execute("FT.ADD", "plain", "z", 1.0, "FIELDS", "name", "lemon")
    assert len(keys(e.execute(*asked))) == 4


def test_postings_of_a_long_text_are_linear(spark):
    text = " ".join(f"w{k % 5000}" for k in range(40000))
    e = Engine(spark)
    e.register("one", spark.createDataFrame([("k", text)], "__key string, name string"))
    e.execute("FT.CREATE", "one", "ON", "one", "SCHEMA", "name", "TEXT", "NOSTEM")
    rows = postings(e.catalog.get("one")).collect()
    assert len(rows) == 5000 and all(r.positions == list(range(int(r.term[1:]) + 1, 40001, 5000)) and r.frequency == 8 for r in rows)


def test_postings_deal_out_no_tokens(spark, tmp_path):
    """Tokens are grouped where they are read: nothing is dealt out, and fields, stems by language, odd texts and repeated keys come out right."""
    rows = [("a", "Running \\\\x runs running", "heating", "english"), ("b", None, "häuser heating", "german"), ("c", "the , a", "", None), ("d", "x" * 50_000 + " y", "running", "klingon")]
    e = Engine(spark)
    e.register("two", spark.createDataFrame(rows, "__key string, t string, u string, l string"))
    e.execute("FT.CREATE", "two", "ON", "two", "LANGUAGE_FIELD", "l", "SCHEMA", "t", "TEXT", "WEIGHT", 2, "u", "TEXT")
    made = postings(e.catalog.get("two"), stems=True)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    found = {(r.term, r.field, r["__key"]): (r.frequency, r.positions) for r in made.collect()}
    assert found["running", "t", "a"] == (4, [1, 4]) and found[STEM + "run", "t", "a"] == (6, [1, 3, 4])
    assert found["\\x", "t", "a"] == (2, [2]) and found["x" * 50_000, "t", "d"] == (2, [1])
    assert (STEM + "heat", "u", "a") in found and (STEM + "heat", "u", "b") not in found and (STEM + "running", "u", "d") in found
    assert not any(k == "c" for _, _, k in found)
    e.execute("FT.POSTINGS", "two", str(tmp_path / "p"), "BUCKETS", 3)
    stats = {r["__key"]: r["length"] for r in Postings(spark, str(tmp_path / "p")).stats.collect()}
    assert stats == {"a": 9, "b": 2, "c": 0, "d": 5}
    e.register("again", e.collections["two"].unionByName(e.collections["two"]))
    e.execute("FT.CREATE", "again", "ON", "again", "SCHEMA", "t", "TEXT")
    (twice,) = [r for r in postings(e.catalog.get("again")).collect() if r.term == "running"]
    assert (twice.frequency, twice.positions) == (4, [1, 1, 4, 4])
    assert {(r.term, r.documents, r.occurrences) for r in vocabulary(e.catalog.get("again")).collect() if len(r.term) < 9} == {("running", 1, 4), ("runs", 1, 2), ("\\x", 1, 2), ("y", 1, 2)}


def test_analysis():
    assert tokens_of("Hello, the (World)! foo\\-bar") == ["hello", "world", "foo-bar"]
    assert [stem(w) for w in ("running", "flies", "nationally", "hopping", "generously")] == ["run", "fli", "nation", "hop", "generous"]
    assert phonetic("smith") == phonetic("smyth") == "SM0"
    known = {"thompson": ("TMPS", "TMPS"), "schmidt": ("XMT", "SMT"), "catherine": ("K0RN", "KTRN"), "michael": ("MKL", "MXL"), "church": ("XRX", "XRK"), "cabrillo": ("KPRL", "KPR"), "laugh": ("LF", "LF"), "arnow": ("ARN", "ARNF"), "caesar": ("SSR", "SSR"), "wright": ("RT", "RT")}
    assert {w: double_metaphone(w) for w in known} == known


def test_phonetic_fields(spark):
    e = Engine(spark)
    e.register("names", spark.createDataFrame([("a", "Jon Smith"), ("b", "John Smyth"), ("c", "Ann")], "__key string, name string"))
    e.execute("FT.CREATE", "idx", "ON", "names", "SCHEMA", "name", "TEXT", "NOSTEM", "PHONETIC", "dm:en")
    assert keys(e.execute("FT.SEARCH", "idx", "smith", "NOCONTENT")) == ["a", "b"]
    assert keys(e.execute("FT.SEARCH", "idx", "smith=>{$phonetic:false}", "NOCONTENT")) == ["a"]
    e.execute("FT.CONFIG", "SET", "MIN_PHONETIC_TERM_LEN", 6)
    assert keys(e.execute("FT.SEARCH", "idx", "smith", "NOCONTENT")) == ["a"]


def test_stems_of_other_languages():
    assert [german(w) for w in ("aufeinander", "häuser", "katzen")] == ["aufeinand", "haus", "katz"]
    assert [swedish(w) for w in ("klostergården", "friheten")] == ["klostergård", "frihet"]
    assert [danish(w) for w in ("undersøgelserne", "husene")] == ["undersøg", "hus"]
    assert [norwegian(w) for w in ("havnedistriktene", "friheten")] == ["havnedistrikt", "frihet"]
    assert [spanish(w) for w in ("chicas", "torneos", "cheques")] == ["chic", "torne", "chequ"]


def test_languages_by_index_by_field_and_by_query(spark):
    e = Engine(spark)
    e.register("words", spark.createDataFrame([("a", "katzen", "German"), ("b", "cats", "english"), ("c", "katzen", None)], "__key string, body string, lang string"))
    e.execute("FT.CREATE", "idx", "ON", "words", "LANGUAGE", "english", "LANGUAGE_FIELD", "lang", "SCHEMA", "body", "TEXT")
    assert keys(e.execute("FT.SEARCH", "idx", "katze", "LANGUAGE", "german", "NOCONTENT")) == ["a"]
    assert keys(e.execute("FT.SEARCH", "idx", "cat", "NOCONTENT")) == []  # three letters have no stem
    e.execute("FT.CONFIG", "SET", "MINSTEMLEN", 3)
    assert keys(e.execute("FT.SEARCH", "idx", "cat", "NOCONTENT")) == ["b"]
    e.execute("FT.CREATE", "de", "ON", "words", "LANGUAGE", "german", "SCHEMA", "body", "TEXT")
    assert keys(e.execute("FT.SEARCH", "de", "katze", "NOCONTENT")) == ["a", "c"]


def test_settings_that_change_results(fruits, spark):
    e = Engine(spark)
    e.register("lists", spark.createDataFrame([("a", ["red apple", "pie"])], "__key string, name array<string>"))
    e.execute("FT.CREATE", "lists", "ON", "lists", "SCHEMA", "name", "TEXT", "NOSTEM")
    near = ("FT.SEARCH", "lists", "apple pie", "SLOP", 5, "NOCONTENT")
    assert keys(e.execute(*near)) == []
    e.execute("FT.CONFIG", "SET", "MULTI_TEXT_SLOP", 5)
    assert keys(e.execute(*near)) == ["a"]
    fruits.execute("FT.CONFIG", "SET", "MAX_AGGREGATE_GROUPS", 3)
    with pytest.raises(ExpressionError):
        fruits.execute("FT.AGGREGATE", "idx", "*", "GROUPBY", 1, "@name")
    fruits.execute("FT.CONFIG", "SET", "MAXAGGREGATERESULTS", 2)
    assert fruits.execute("FT.AGGREGATE", "idx", "*").count() == 2
    with pytest.raises(CommandError):
        fruits.execute("FT.CONFIG", "SET", "NO_SUCH", 1)


def test_a_query_that_takes_too_long_is_stopped(fruits):
    assert len(fruits.rows("FT.SEARCH", "idx", "*", timeout_ms=60_000)) == 5
    big = fruits.collections["fruits"].sparkSession.range(80_000_000).selectExpr("id AS __key", "id % 9999999 AS other", "'ring' AS name")
    fruits.register("big", big)
    fruits.execute("FT.CREATE", "big", "ON", "big", "SCHEMA", "name", "TEXT", "NOSTEM")
    words = ("FT.AGGREGATE", "big", "ring", "GROUPBY", 1, "@other", "REDUCE", "COUNT", 0)
    assert fruits.rows(*words, timeout_ms=300) == []
    fruits.execute("FT.CONFIG", "SET", "ON_TIMEOUT", "FAIL")
    with pytest.raises(CommandError):
        fruits.rows(*words, timeout_ms=300)


def test_temporary_indexes_go_when_they_are_not_used(fruits, monkeypatch):
    from brindle.plans import commands

    clock = [1000.0]
    monkeypatch.setattr(commands.time, "time", lambda: clock[0])
    fruits.execute("FT.CREATE", "brief", "ON", "fruits", "TEMPORARY", 10, "SCHEMA", "name", "TEXT")
    clock[0] = 1008.0
    assert fruits.execute("FT.SEARCH", "brief", "*", "LIMIT", 0, 0) == 5
    clock[0] = 1016.0
    assert "brief" in fruits.execute("FT._LIST")
    clock[0] = 1030.0
    assert "brief" not in fruits.execute("FT._LIST")


def test_highlights_mark_stems_and_synonyms(fruits):
    out = fruits.execute("FT.SEARCH", "idx", "apple", "HIGHLIGHT", "FIELDS", 1, "name", "LIMIT", 0, -1)
    assert {r["__key"]: r.name for r in out.collect()} == {"c": "red <b>apple</b> pie", "d": "<b>apple</b>", "e": "the running <b>apples</b>"}
    fruits.execute("FT.SYNUPDATE", "idx", "g", "citrus", "lemon")
    assert [r.name for r in fruits.execute("FT.SEARCH", "idx", "citrus", "HIGHLIGHT").collect()] == ["<b>lemon</b>"]


def test_many_writes_keep_the_plan_small(fruits):
    for k in range(12):
        fruits.execute("FT.ADD", "idx", f"k{k % 3}", 1.0, "REPLACE", "FIELDS", "name", f"grape {k}")
    index = fruits.catalog.get("idx")
    assert index.df._jdf.queryExecution().optimizedPlan().toString().count("Union") == 1
    assert keys(fruits.execute("FT.SEARCH", "idx", "grape", "NOCONTENT")) == ["k0", "k1", "k2"]


def test_collect_keeps_whole_rows_in_order_beyond_the_group_limit(spark):
    from brindle.operators.pipeline import Pipeline

    df = spark.range(3000).selectExpr("id AS __key", "id % 2 AS g", "IF(id % 7 = 0, NULL, -id) AS v", "'x' AS s")
    args = ["FIELDS", "1", "@__key", "SORTBY", "2", "@v", "DESC", "LIMIT", "1", "1200"]
    for n in (2, 1200):
        args[-1] = str(n)
        got = {r.g: [x["__key"] for x in r.c] for r in Pipeline(df, "__key").groupby(["@g"], [("COLLECT", args, "c"), ("COUNT", [], "n")]).df.collect()}
        for g in (0, 1):
            want = sorted((k for k in range(g, 3000, 2)), key=lambda k: (k % 7 == 0, k))[1 : 1 + n]
            assert got[g] == want
    plan = Pipeline(df, "__key").groupby([], [("COLLECT", args[:-1] + ["5"], "c")]).df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan or "TakeOrdered" in plan or "Limit" in plan


def test_cursors_end_when_they_are_not_read(fruits, monkeypatch):
    from brindle.plans import commands

    clock = [1000.0]
    monkeypatch.setattr(commands.time, "time", lambda: clock[0])
    _, cid = fruits.execute("FT.AGGREGATE", "idx", "*", "WITHCURSOR", "COUNT", 1, "MAXIDLE", 5000)
    clock[0] = 1004.0
    assert len(fruits.execute("FT.CURSOR", "READ", "idx", cid)[0]) == 1
    clock[0] = 1010.0
    with pytest.raises(CommandError):
        fruits.execute("FT.CURSOR", "READ", "idx", cid)


def test_info_and_dropping_documents(fruits):
    info = fruits.execute("FT.INFO", "idx")
    assert info["num_docs"] == 5 and info["doc_length_avg"] == info["total_terms"] / 5 and info["index_options"]["language"] == "english"
    fruits.execute("FT.DROPINDEX", "idx", "DD")
    assert "fruits" not in fruits.collections


def test_a_live_table_writes_what_a_batch_touches(spark, tmp_path):
    from brindle.streaming.upserts import LiveTable

    table = LiveTable(spark, str(tmp_path / "t"), "k", "v", "gone", buckets=8)
    rows = lambda *r: spark.createDataFrame(list(r), "k long, v long, body string, gone boolean")
    table.apply(rows(*[(k, 1, "a", False) for k in range(40)]), 0)
    first = table._current()[1]
    table.apply(rows((3, 2, "b", False), (3, 1, "old", False), (4, 2, None, True)), 1)
    table.apply(rows((3, 9, "again", False)), 1)  # the batch came before
    now = table._current()[1]
    assert sum(first[b] == now.get(b) for b in first) >= 6
    got = {r.k: r.body for r in table.read().collect()}
    assert len(got) == 39 and got[3] == "b" and 4 not in got and got[5] == "a"
    table.apply(rows(*[(k, 3, None, True) for k in range(40)]), 2)
    assert table._current()[1] == {}
    table.apply(rows((7, 4, "c", False)), 3)
    assert [(r.k, r.body) for r in table.read().collect()] == [(7, "c")]
    assert table.clean(keep=1) == 3 and table.read().count() == 1

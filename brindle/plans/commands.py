"""The command surface: words of a command in, DataFrames or plain values out."""

from __future__ import annotations

import json
import shlex
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, StringType, StructField, StructType

from ..functions.scalars import ExpressionError
from ..operators import postings, suggest
from ..operators import search as S
from ..operators.pipeline import Pipeline
from ..operators.retrieval import Options, simplify
from ..sources.readers import mget, pages
from . import query_language as q
from .catalog import Catalog, FieldDef, IndexDef

SETTINGS = {"DEFAULT_DIALECT": "2", "DEFAULT_SCORER": "BM25STD", "MINPREFIX": "2", "MAXPREFIXEXPANSIONS": "-1", "MINSTEMLEN": "4", "MIN_PHONETIC_TERM_LEN": "3", "MULTI_TEXT_SLOP": "100", "MAXSEARCHRESULTS": "1000000", "MAXAGGREGATERESULTS": "-1", "MAX_AGGREGATE_GROUPS": "-1", "TIMEOUT": "0", "ON_TIMEOUT": "RETURN", "BM25STD_TANH_FACTOR": "4", "CURSOR_MAX_IDLE": "300000"}


class CommandError(ValueError):
    pass


class Words:
    """The words of a command, taken from the left."""

    def __init__(self, words: list[Any]):
        self.words, self.i = list(words), 0

    def __bool__(self) -> bool:
        return self.i < len(self.words)

    def peek(self) -> str:
        return str(self.words[self.i]).upper() if self else ""

    def next(self):
        if not self:
            raise CommandError("the command ends too early")
        self.i += 1
        return self.words[self.i - 1]

    def text(self) -> str:
        return str(self.next())

    def int(self) -> int:
        try:
            return int(self.next())
        except (TypeError, ValueError):
            raise CommandError(f"expected a whole number, found {self.words[self.i - 1]!r}") from None

    def float(self) -> float:
        return float(self.next())

    def take(self, n: int) -> list[Any]:
        return [self.next() for _ in range(n)]

    def has(self, *names: str) -> str | None:
        if self.peek() in names:
            return str(self.next()).upper()
        return None


def bound(word: Any) -> tuple[float, bool]:
    s = str(word)
    return (float(s[1:]), True) if s.startswith("(") else (float(s), False)


class Engine:
    """Runs commands against DataFrames registered as collections."""

    def __init__(self, spark: SparkSession):
        self.spark, self.catalog = spark, Catalog()
        self.collections: dict[str, DataFrame] = {}
        self.settings = dict(SETTINGS)
        self.catalog.analysis = lambda: {"min_stem": int(self.settings["MINSTEMLEN"]), "min_phonetic": int(self.settings["MIN_PHONETIC_TERM_LEN"]), "gap": int(self.settings["MULTI_TEXT_SLOP"])}
        #: name -> (the collection that writes change, key -> the row written or None for a deletion)
        self.writes: dict[str, tuple[DataFrame, dict]] = {}
        #: index -> (seconds without use after which it goes, last use)
        self.temporary: dict[str, tuple[float, float]] = {}
        self.cursors: dict[int, Iterator] = {}
        self.cursor_of: dict[int, str] = {}
        self.idle: dict[int, tuple[float, float]] = {}
        self.scorers, self.expanders = {}, {}

    def register(self, name: str, df: DataFrame) -> None:
        self.collections[name] = df

    def execute(self, *words: Any):
        """execute('FT.SEARCH', 'idx', 'hello', ...) or execute("FT.SEARCH idx 'hello world'")."""
        if len(words) == 1 and isinstance(words[0], str):
            words = tuple(shlex.split(words[0]))
        name = str(words[0]).upper().removeprefix("FT.").lstrip("_").lower()
        run: Callable | None = getattr(self, f"do_{name}", None)
        if run is None:
            raise CommandError(f"unknown command {words[0]}")
        self._expire(str(words[1]) if len(words) > 1 else "")
        return run(Words(list(words[1:])))

    def _expire(self, used: str) -> None:
        """Drops temporary indexes that weren't used for as long as they may be; `used` is used now."""
        now = time.time()
        for name, (seconds, last) in list(self.temporary.items()):
            if now - last > seconds:
                del self.temporary[name]
                if name in self.catalog.indexes:
                    self.catalog.drop(name)
            elif self.catalog.aliases.get(used, used) == name:
                self.temporary[name] = seconds, now

    def rows(self, *words: Any, timeout_ms: int | None = None) -> list:
        """The rows of a query. Beyond TIMEOUT its jobs are stopped; ON_TIMEOUT says whether that is an error or no rows."""
        out = self.execute(*words)
        most = int(self.settings["TIMEOUT"]) if timeout_ms is None else timeout_ms
        if not isinstance(out, DataFrame) or most <= 0:
            return out.collect() if isinstance(out, DataFrame) else out
        context, tag = self.spark.sparkContext, f"brindle-{uuid.uuid4().hex}"
        late, over = threading.Event(), threading.Event()

        def stop():
            # again and again: a job that begins later is stopped too
            if not over.wait(most / 1000):
                late.set()
                while not over.wait(0.1):
                    context.cancelJobsWithTag(tag)

        context.addJobTag(tag)
        context.setInterruptOnCancel(True)
        threading.Thread(target=stop, daemon=True).start()
        try:
            return out.collect()
        except Exception:
            if not late.is_set():
                raise
            if self.settings["ON_TIMEOUT"].upper() == "FAIL":
                raise CommandError(f"the query took more than {most} ms") from None
            return []
        finally:
            over.set()
            context.removeJobTag(tag)

    # -- definitions -----------------------------------------------------------------------------------------------

    def _fields(self, w: Words) -> list[FieldDef]:
        out = []
        while w:
            path = w.text()
            name = w.text() if w.has("AS") else path
            kind = w.text().upper()
            f = FieldDef(name, kind, path)
            if kind == "VECTOR":
                f = replace(f, algorithm=w.text().upper())
                opts = w.take(w.int())
                for k, v in zip(opts[::2], opts[1::2], strict=True):
                    if str(k).upper() == "DISTANCE_METRIC":
                        f = replace(f, metric=str(v).upper())
                    elif str(k).upper() == "DIM":
                        f = replace(f, dim=int(v))
            elif kind == "GEOSHAPE" and (c := w.has("FLAT", "SPHERICAL")):
                f = replace(f, coords=c)
            while opt := w.has("EXPIRES", "WEIGHT", "NOSTEM", "PHONETIC", "SORTABLE", "UNF", "NOINDEX", "WITHSUFFIXTRIE", "INDEXEMPTY", "INDEXMISSING", "SEPARATOR", "CASESENSITIVE"):
                if opt == "WEIGHT":
                    f = replace(f, weight=w.float())
                elif opt == "EXPIRES":
                    f = replace(f, expires=w.text())
                elif opt == "PHONETIC":
                    w.text()
                    f = replace(f, phonetic=True)
                elif opt == "SEPARATOR":
                    f = replace(f, separator=w.text())
                elif opt not in ("UNF", "WITHSUFFIXTRIE"):
                    f = replace(f, **{{"NOSTEM": "nostem", "SORTABLE": "sortable", "NOINDEX": "noindex", "INDEXEMPTY": "index_empty", "INDEXMISSING": "index_missing", "CASESENSITIVE": "case_sensitive"}[opt]: True})
            out.append(f)
        return out

    def do_create(self, w: Words, if_absent: bool = False):
        """CREATE idx ON collection [KEY column] [PREFIX n p...] [FILTER e] ... SCHEMA field type..."""
        name, opts, idle = w.text(), {}, None
        collection = name
        while w and not w.has("SCHEMA"):
            word = w.text().upper()
            if word == "ON":
                what = w.text()
                collection = what if what.upper() not in ("HASH", "JSON") else collection
            elif word == "COLLECTION":
                collection = w.text()
            elif word == "KEY":
                opts["key"] = w.text()
            elif word == "PREFIX":
                opts["prefixes"] = tuple(map(str, w.take(w.int())))
            elif word == "FILTER":
                opts["filter"] = w.text()
            elif word == "LANGUAGE":
                opts["language"] = w.text().lower()
            elif word == "SCORE":
                opts["score"] = w.float()
            elif word == "SCORE_FIELD":
                opts["score_field"] = w.text()
            elif word == "PAYLOAD_FIELD":
                opts["payload_field"] = w.text()
            elif word == "STOPWORDS":
                opts["stopwords"] = tuple(map(str, w.take(w.int())))
            elif word == "LANGUAGE_FIELD":
                opts["language_field"] = w.text()
            elif word == "EXPIRE_FIELD":
                opts["expire_field"] = w.text()
            elif word == "TEMPORARY":
                idle = w.float()
            elif word == "INDEXALL":
                w.text()
            elif word not in ("MAXTEXTFIELDS", "NOOFFSETS", "NOHL", "NOFIELDS", "NOFREQS", "SKIPINITIALSCAN"):
                raise CommandError(f"CREATE: unexpected {word}")
        if collection not in self.collections:
            raise CommandError(f"no collection {collection}")
        self.catalog.create(IndexDef(name, self.collections[collection], tuple(self._fields(w)), **opts), if_absent)
        if idle is not None:
            self.temporary[name] = idle, time.time()
        return "OK"

    def do_postings(self, w: Words):
        """POSTINGS idx path [BUCKETS n]: writes the collection's postings; queries on its words read them from then on."""
        name, path = w.text(), w.text()
        buckets = w.int() if w.has("BUCKETS") else postings.BUCKETS
        postings.write_postings(self.catalog.get(name), path, buckets)
        name = self.catalog.aliases.get(name, name)
        self.catalog.indexes[name] = replace(self.catalog.indexes[name], postings=path)
        return "OK"

    def do_createifnx(self, w: Words):
        return self.do_create(w, True)

    def do_alter(self, w: Words):
        name = w.text()
        w.has("SKIPINITIALSCAN")
        if not w.has("SCHEMA") or not w.has("ADD"):
            raise CommandError("ALTER takes SCHEMA ADD")
        self.catalog.alter(name, *self._fields(w))
        return "OK"

    def do_alterifnx(self, w: Words):
        name = w.text()
        have = {f.name for f in self.catalog.get(name).fields}
        w.has("SKIPINITIALSCAN")
        w.has("SCHEMA")
        w.has("ADD")
        self.catalog.alter(name, *[f for f in self._fields(w) if f.name not in have])
        return "OK"

    def do_dropindex(self, w: Words):
        """DROPINDEX idx [DD]: with DD its documents go too, from the engine's collections and not from where they are stored."""
        name = w.text()
        rows = self.catalog.get(name).df
        self.catalog.drop(name)
        self.writes.pop(name, None)
        if w.has("DD"):
            self.collections = {k: v for k, v in self.collections.items() if v is not rows}
        return "OK"

    do_drop = do_dropindex

    def do_dropifx(self, w: Words):
        name = w.text()
        if self.catalog.aliases.get(name, name) in self.catalog.indexes:
            self.catalog.drop(name)
        return "OK"

    do_dropindexifx = do_dropifx

    def do_aliasadd(self, w: Words):
        self.catalog.alias(w.text(), w.text())
        return "OK"

    def do_aliasupdate(self, w: Words):
        self.catalog.alias(w.text(), w.text(), True)
        return "OK"

    def do_aliasdel(self, w: Words):
        self.catalog.unalias(w.text())
        return "OK"

    def do_aliaslist(self, w: Words):
        name = w.text()
        return sorted(a for a, n in self.catalog.aliases.items() if n == name)

    def do_list(self, w: Words):
        return sorted(self.catalog.indexes)

    def do_info(self, w: Words) -> dict:
        index = self.catalog.get(w.text())
        from ..operators.scoring import doc_length

        df = index.prepared()
        r = S.Retrieval(index, df)
        n, total = df.agg(F.count("*"), F.sum(doc_length(r))).first()
        options = {k: getattr(index, k) for k in ("key", "prefixes", "filter", "language", "language_field", "score", "score_field", "payload_field", "expire_field", "postings") if getattr(index, k)}
        return {"index_name": index.name, "index_options": options, "stopwords_list": index.stopwords, "attributes": [{"identifier": f.path or f.name, "attribute": f.name, "type": f.type} for f in index.fields], "num_docs": n, "total_terms": total or 0, "doc_length_avg": (total or 0) / n if n else 0.0}

    # -- writes ----------------------------------------------------------------------------------------------------

    def _write(self, index: IndexDef, key: str, values: dict | None) -> None:
        """Puts or deletes a document. All writes lie in one local table over the collection, so the plan doesn't grow with them."""
        name = self.catalog.aliases.get(index.name, index.name)
        base, made = self.writes.setdefault(name, (index.df, {}))
        made[key] = values
        schema = base.schema
        # as texts, which become the columns' types; lists and the like as JSON
        text = StructType([StructField(f.name, StringType()) for f in schema.fields])
        told = lambda x: x if x is None or isinstance(x, str) else json.dumps(x, default=str) if isinstance(x, (list, tuple, dict)) else str(x)
        new = self.spark.createDataFrame([tuple(told(v.get(f.name)) for f in schema.fields) for v in made.values() if v is not None], text)
        typed = lambda f: F.col(f"`{f.name}`").cast(f.dataType) if isinstance(f.dataType, AtomicType) else F.from_json(F.col(f"`{f.name}`"), f.dataType)
        new = new.select(*[typed(f).alias(f.name) for f in schema.fields])
        left = base.where(~F.coalesce(F.col(index.key).cast("string").isin([str(k) for k in made]), F.lit(False)))
        # postings tell of the collection as it was
        self.catalog.indexes[name] = replace(self.catalog.indexes[name], df=left.unionByName(new), postings=None)

    def do_add(self, w: Words, safe: bool = False):
        """ADD idx key score [REPLACE [PARTIAL]] FIELDS name value..."""
        index, key, score = self.catalog.get(w.text()), w.text(), w.float()
        keep, partial = bool(w.has("REPLACE")), bool(w.has("PARTIAL"))
        if not w.has("FIELDS"):
            raise CommandError("ADD takes FIELDS")
        values = {}
        if not keep or partial:
            old = index.df.where(F.col(index.key).cast("string") == str(key)).first()
            if old is not None and not keep:
                raise CommandError("the document exists")
            values = {k: v for k, v in old.asDict().items() if k in index.df.columns} if old is not None else {}
        values[index.key] = key
        if index.score_field:
            values[index.score_field] = score
        while w:
            name = w.text()  # before the value: the right side of an assignment runs first
            values[name] = w.next()
        self._write(index, key, values)
        return "OK"

    do_safeadd = do_add

    def do_del(self, w: Words):
        index, key = self.catalog.get(w.text()), w.text()
        found = index.df.where(F.col(index.key).cast("string") == str(key)).limit(1).count()
        if found:
            self._write(index, key, None)
        return found

    def do_setpayload(self, w: Words):
        index, key, payload = self.catalog.get(w.text()), w.text(), w.next()
        if not index.payload_field:
            raise CommandError("the index has no payload field")
        old = index.df.where(F.col(index.key).cast("string") == str(key)).first()
        if old is not None:
            self._write(index, key, old.asDict() | {index.payload_field: payload})
        return "OK"

    def do_get(self, w: Words) -> DataFrame:
        index = self.catalog.get(w.text())
        return S.visible(mget(index.source(), [w.next()]))

    def do_mget(self, w: Words) -> DataFrame:
        index = self.catalog.get(w.text())
        return S.visible(mget(index.source(), w.take(len(w.words) - w.i)))

    # -- queries ---------------------------------------------------------------------------------------------------

    def _query(self, text: Any) -> S.Query:
        most = int(self.settings["MAXPREFIXEXPANSIONS"])
        return S.Query(str(text), options=Options(min_prefix=int(self.settings["MINPREFIX"]), max_expansions=None if most < 0 else most), dialect=int(self.settings["DEFAULT_DIALECT"]))

    def _params(self, w: Words) -> dict[str, Any]:
        items = w.take(w.int())
        return {str(k): v for k, v in zip(items[::2], items[1::2], strict=True)}

    def _common(self, word: str, w: Words, query: S.Query) -> bool:
        """Arguments that SEARCH and AGGREGATE share."""
        if word == "PARAMS":
            query.params |= self._params(w)
        elif word == "DIALECT":
            query.dialect = 1 if w.int() == 1 else 2
        elif word == "VERBATIM":
            query.options.verbatim = True
        elif word == "NOSTOPWORDS":
            query.no_stopwords = True
        elif word == "LANGUAGE":
            query.language = w.text()
        elif word == "SLOP":
            query.options.slop = w.int()
        elif word == "INORDER":
            query.options.inorder = True
        elif word == "INFIELDS":
            query.options.infields = tuple(map(str, w.take(w.int())))
        elif word == "INKEYS":
            query.inkeys = tuple(w.take(w.int()))
        elif word == "EXPANDER":
            name = w.text()
            query.options.expanders = {name: self.expanders[name]} if name in self.expanders else {}
        elif word in ("TIMEOUT", "FORMAT"):
            w.next()
        elif word not in ("WITHCOUNT", "WITHOUTCOUNT", "WITHRAWIDS"):
            return False
        return True

    def search_plan(self, w: Words) -> DataFrame | int:
        index, query = self.catalog.get(w.text()), self._query(w.next())
        opts: dict[str, Any] = {"scorer": self.settings["DEFAULT_SCORER"]}
        while w:
            word = w.text().upper()
            if word == "FILTER":
                name = w.text().lstrip("@")
                (a, ao), (b, bo) = bound(w.next()), bound(w.next())
                query.filters.append((name, a, b, ao, bo))
            elif word == "GEOFILTER":
                query.geofilters.append((w.text().lstrip("@"), w.float(), w.float(), w.float(), w.text()))
            elif word == "LIMIT":
                opts["limit"] = (w.int(), w.int())
            elif word == "SORTBY":
                opts["sortby"] = (w.text().lstrip("@"), w.has("ASC", "DESC") == "DESC")
            elif word == "SCORER":
                opts["scorer"] = w.text()
            elif word == "PAYLOAD":
                p = w.next()
                opts["payload"] = p.encode() if isinstance(p, str) else p
            elif word == "RETURN":
                names, got = w.take(w.int()), []
                i = 0
                while i < len(names):
                    if i + 2 < len(names) and str(names[i + 1]).upper() == "AS":
                        got.append((str(names[i]).lstrip("@"), str(names[i + 2])))
                        i += 3
                    else:
                        got.append(str(names[i]).lstrip("@"))
                        i += 1
                opts["returns"] = got
            elif word in ("NOCONTENT", "WITHSCORES", "WITHSORTKEYS", "WITHPAYLOADS", "EXPLAINSCORE"):
                opts[{"NOCONTENT": "nocontent", "WITHSCORES": "with_scores", "WITHSORTKEYS": "with_sort_keys", "WITHPAYLOADS": "with_payloads", "EXPLAINSCORE": "explain_score"}[word]] = True
            elif word == "HIGHLIGHT":
                h = {}
                while inner := w.has("FIELDS", "TAGS"):
                    h["fields" if inner == "FIELDS" else "tags"] = [str(x) for x in w.take(w.int())] if inner == "FIELDS" else (w.text(), w.text())
                opts["highlight"] = h
            elif word == "SUMMARIZE":
                s = {}
                while inner := w.has("FIELDS", "FRAGS", "LEN", "SEPARATOR"):
                    s[{"FIELDS": "fields", "FRAGS": "frags", "LEN": "length", "SEPARATOR": "separator"}[inner]] = [str(x) for x in w.take(w.int())] if inner == "FIELDS" else w.text() if inner == "SEPARATOR" else w.int()
                opts["summarize"] = s
            elif not self._common(word, w, query):
                raise CommandError(f"SEARCH: unexpected {word}")
        if opts.get("limit") == (0, 0):
            return S.count(index, query)
        most = int(self.settings["MAXSEARCHRESULTS"])
        offset, n = opts.get("limit", (0, 10))
        if 0 <= most < n:
            opts["limit"] = offset, most
        return S.search(index, query, tanh_factor=self._tanh(), **opts)

    def _tanh(self) -> int:
        factor = int(self.settings["BM25STD_TANH_FACTOR"])
        if not 1 <= factor <= 10_000:
            raise CommandError("BM25STD_TANH_FACTOR is 1 to 10000")
        return factor

    do_search = search_plan

    def _step(self, word: str, w: Words, p: Pipeline) -> bool:
        if word == "LOAD":
            n = w.text()
            if n == "*":
                p.load("*")
            else:
                names, got, i = w.take(int(n)), [], 0
                while i < len(names):
                    path = str(names[i]).lstrip("@")
                    if i + 2 < len(names) and str(names[i + 1]).upper() == "AS":
                        got.append((path, str(names[i + 2])))
                        i += 3
                    else:
                        got.append(path)
                        i += 1
                p.load(got)
        elif word == "APPLY":
            expression = w.text()
            alias = w.text() if w.has("AS") else expression.replace("@", "")
            p.apply(expression, alias)
        elif word == "FILTER":
            p.filter(w.text())
        elif word == "GROUPBY":
            keys, reducers = [str(x) for x in w.take(w.int())], []
            while w.has("REDUCE"):
                name = w.text()
                args = [str(x) for x in w.take(w.int())]
                reducers.append((name, args, w.text() if w.has("AS") else None))
            p.groupby(keys, reducers)
        elif word == "SORTBY":
            keys: list[tuple[str, bool]] = []
            for x in w.take(w.int()):
                if str(x).upper() in ("ASC", "DESC"):
                    keys[-1] = (keys[-1][0], str(x).upper() == "DESC")
                else:
                    keys.append((str(x).lstrip("@"), False))
            p.sortby(keys, w.int() if w.has("MAX") else None)
        elif word == "LIMIT":
            p.limit(w.int(), w.int())
        else:
            return False
        return True

    def aggregate_plan(self, w: Words) -> DataFrame:
        name, text = w.text(), w.next()
        index, query = self.catalog.get(name), self._query(text)
        steps, rest, scores, scorer = [], Words(w.words[w.i :]), False, self.settings["DEFAULT_SCORER"]
        self._cursor = None
        # the query's own arguments may stand between steps: they are read first
        replay = Words([])
        while rest:
            word = rest.text().upper()
            if word == "ADDSCORES":
                scores = True
            elif word == "SCORER":
                scorer = rest.text()
            elif word == "WITHCURSOR":
                self._cursor, self._idle = 1000, int(self.settings["CURSOR_MAX_IDLE"])
                while inner := rest.has("COUNT", "MAXIDLE"):
                    n = rest.int()
                    self._cursor, self._idle = (n, self._idle) if inner == "COUNT" else (self._cursor, min(n, self._idle))
            elif word in ("LOAD", "APPLY", "FILTER", "GROUPBY", "SORTBY", "LIMIT"):
                start = rest.i - 1
                self._skip(word, rest)
                steps.append(rest.words[start : rest.i])
            elif not self._common(word, rest, query):
                raise CommandError(f"AGGREGATE: unexpected {word}")
        p = S.aggregate(index, query, scores, scorer, tanh_factor=self._tanh())
        p.most_groups = int(self.settings["MAX_AGGREGATE_GROUPS"])
        for s in steps:
            replay = Words(s)
            self._step(replay.text().upper(), replay, p)
        most = int(self.settings["MAXAGGREGATERESULTS"])
        out = p.result()
        return S.visible(out.limit(most) if most >= 0 else out)

    @staticmethod
    def _skip(word: str, w: Words) -> None:
        """Passes over one step's words."""
        if word == "LOAD":
            n = w.text()
            w.take(0 if n == "*" else int(n))
        elif word == "APPLY":
            w.next()
            if w.has("AS"):
                w.next()
        elif word == "FILTER":
            w.next()
        elif word == "GROUPBY":
            w.take(w.int())
            while w.has("REDUCE"):
                w.next()
                w.take(w.int())
                if w.has("AS"):
                    w.next()
        elif word == "SORTBY":
            w.take(w.int())
            if w.has("MAX"):
                w.next()
        else:
            w.take(2)

    def do_aggregate(self, w: Words):
        name = str(w.words[w.i])
        out = self.aggregate_plan(w)
        if self._cursor is None:
            return out
        cid = max(self.cursors, default=0) + 1
        self.cursors[cid], self.cursor_of[cid] = pages(out, self._cursor), name
        self.idle[cid] = self._idle / 1000, time.time()
        return self._page(cid)

    def _idle_cursors(self) -> int:
        """Ends the cursors that weren't read for longer than they may be."""
        late = [cid for cid, (seconds, last) in self.idle.items() if time.time() - last > seconds]
        for cid in late:
            del self.idle[cid]
            self.cursors.pop(cid, None)
        return len(late)

    def _page(self, cid: int):
        self._idle_cursors()
        if cid in self.idle:
            self.idle[cid] = self.idle[cid][0], time.time()
        if cid not in self.cursors:
            raise CommandError(f"no cursor {cid}")
        page = next(self.cursors[cid], None)
        if page is None:
            del self.cursors[cid]
            return [], 0
        return page, cid

    def do_cursor(self, w: Words):
        word, _, = w.text().upper(), w.text()
        if word == "GC":
            return self._idle_cursors()
        cid = w.int()
        if word == "READ":
            return self._page(cid)
        if word == "DEL":
            if self.cursors.pop(cid, None) is None:
                raise CommandError(f"no cursor {cid}")
            return "OK"
        raise CommandError(f"CURSOR: unexpected {word}")

    def do_hybrid(self, w: Words) -> DataFrame:
        index = self.catalog.get(w.text())
        if not w.has("SEARCH"):
            raise CommandError("HYBRID takes SEARCH")
        text, opts, vs, steps, params = self._query(w.next()), {}, None, [], {}
        field, vector, side, sort = None, None, {}, True
        while w:
            word = w.text().upper()
            if word == "SCORER":
                opts["scorer"] = w.text()
            elif word == "YIELD_SCORE_AS":
                if field is None:
                    opts["text_alias"] = w.text()
                else:
                    side["alias"] = w.text()
            elif word == "VSIM":
                field, vector = w.text().lstrip("@"), w.next()
            elif word == "KNN":
                inner = Words(w.take(w.int()))
                while inner:
                    k = inner.text().upper()
                    v = inner.next()
                    if k == "K":
                        side["k"] = int(v)
            elif word == "RANGE":
                inner = Words(w.take(w.int()))
                while inner:
                    k = inner.text().upper()
                    v = inner.next()
                    if k == "RADIUS":
                        side["radius"] = float(v)
            elif word == "FILTER" and field is not None and not steps and "combine" not in opts:
                side["filter"] = w.next()
                if w.has("POLICY"):
                    w.next()
                if w.has("BATCH_SIZE"):
                    w.next()
            elif word == "COMBINE":
                how = w.text().upper()
                opts["combine"] = how
                if w and w.peek().isdigit():
                    inner = Words(w.take(w.int()))
                    while inner:
                        k = inner.text().lower()
                        opts[k] = float(inner.next()) if k != "window" else inner.int()
                if w.has("YIELD_SCORE_AS"):
                    opts["score_alias"] = w.text()
            elif word == "PARAMS":
                params |= self._params(w)
            elif word == "NOSORT":
                sort = False
            elif word in ("LOAD", "APPLY", "FILTER", "GROUPBY", "SORTBY", "LIMIT"):
                start = w.i - 1
                self._skip(word, w)
                steps.append(w.words[start : w.i])
            elif word == "EXPLAINSCORE":
                opts["explain"] = True
            elif not self._common(word, w, text):
                raise CommandError(f"HYBRID: unexpected {word}")
        if field is None:
            raise CommandError("HYBRID takes VSIM")
        text.params |= params
        value = params[str(vector)[1:]] if isinstance(vector, str) and vector.startswith("$") else vector
        filt = side.pop("filter", None)
        if filt is not None:
            made = self._query(filt)
            made.params |= params
            filt = made
        vs = S.VectorSide(field, q.vector_of(value), filter=filt, **side)
        p = S.hybrid(index, text, vs, **opts)
        p._sorted = False
        for s in steps:
            r = Words(s)
            self._step(r.text().upper(), r, p)
        limited = p._limited or any(str(s[0]).upper() in ("GROUPBY",) for s in steps)
        return p.df if limited or not sort else p.df.limit(10)

    def do_explain(self, w: Words) -> str:
        index, query = self.catalog.get(w.text()), self._query(w.next())
        while w:
            if not self._common(w.text().upper(), w, query):
                raise CommandError("EXPLAIN takes a query's own arguments")
        return q.explain(simplify(query.tree(index)))

    def do_explaincli(self, w: Words) -> list[str]:
        return self.do_explain(w).split("\n")

    def do_profile(self, w: Words) -> dict:
        name, kind = w.text(), w.text().upper()
        w.has("LIMITED")
        w.has("QUERY")
        began = time.time()
        out = {"SEARCH": self.search_plan, "AGGREGATE": self.aggregate_plan, "HYBRID": self.do_hybrid}[kind](Words([name, *w.take(len(w.words) - w.i)]))
        planned = time.time()
        rows = out if isinstance(out, int) else out.count()
        plan = "" if isinstance(out, int) else out._jdf.queryExecution().toString()
        return {"rows": rows, "plan_seconds": planned - began, "run_seconds": time.time() - planned, "plan": plan}

    # -- side features ---------------------------------------------------------------------------------------------

    def do_tagvals(self, w: Words) -> DataFrame:
        index, name = self.catalog.get(w.text()), w.text()
        if index.field(name).type != "TAG":
            raise CommandError(f"@{name} isn't a TAG field")
        return index.prepared().select(F.explode(f"__tag_{name}").alias("tag")).distinct()

    def do_dictadd(self, w: Words) -> int:
        words = self.catalog.dictionaries.setdefault(w.text(), set())
        new = {str(x) for x in w.take(len(w.words) - w.i)} - words
        words |= new
        return len(new)

    def do_dictdel(self, w: Words) -> int:
        words = self.catalog.dictionaries.get(w.text(), set())
        gone = {str(x) for x in w.take(len(w.words) - w.i)} & words
        words -= gone
        return len(gone)

    def do_dictdump(self, w: Words) -> list[str]:
        return sorted(self.catalog.dictionaries.get(w.text(), set()))

    def do_synupdate(self, w: Words):
        name, group = w.text(), w.text()
        w.has("SKIPINITIALSCAN")
        self.catalog.get(name)
        self.catalog.synonyms(name, group, [str(x) for x in w.take(len(w.words) - w.i)])
        return "OK"

    def do_synadd(self, w: Words):
        raise CommandError("SYNADD is gone: use SYNUPDATE")

    def do_syndump(self, w: Words) -> dict[str, list[str]]:
        name = w.text()
        out: dict[str, list[str]] = {}
        for group, terms in self.catalog.synonym_groups.get(self.catalog.aliases.get(name, name), {}).items():
            for t in terms:
                out.setdefault(t, []).append(group)
        return {t: sorted(g) for t, g in sorted(out.items())}

    def _dict(self, name: str) -> DataFrame:
        return self.catalog.suggestions.setdefault(name, self.spark.createDataFrame([], "string string, score double, payload string"))

    def do_sugadd(self, w: Words) -> int:
        name, string, score = w.text(), w.text(), w.float()
        incr = payload = None
        while word := w.has("INCR", "PAYLOAD"):
            incr, payload = (True, payload) if word == "INCR" else (incr, w.text())
        self.catalog.suggestions[name] = suggest.add(self._dict(name), string, score, bool(incr), payload)
        return self.catalog.suggestions[name].count()

    def do_sugget(self, w: Words) -> DataFrame:
        name, prefix, opts = w.text(), w.text(), {}
        keep = ["string"]
        while word := w.has("FUZZY", "MAX", "TRIM", "WITHSCORES", "WITHPAYLOADS"):
            if word == "MAX":
                opts["most"] = w.int()
            elif word in ("FUZZY", "TRIM"):
                opts[word.lower()] = True
            else:
                keep.append("score" if word == "WITHSCORES" else "payload")
        return suggest.complete(self._dict(name), prefix, **opts).select(*keep)

    def do_sugdel(self, w: Words) -> int:
        name, string = w.text(), w.text()
        table = self._dict(name)
        found = table.where(F.col("string") == string).limit(1).count()
        self.catalog.suggestions[name] = table.where(F.col("string") != string)
        return found

    def do_suglen(self, w: Words) -> int:
        return self._dict(w.text()).count()

    def do_spellcheck(self, w: Words) -> DataFrame:
        index, query = self.catalog.get(w.text()), self._query(w.next())
        distance, include, exclude, full = 1, set(), set(), False
        while word := w.has("DISTANCE", "TERMS", "FULLSCOREINFO", "DIALECT"):
            if word == "DISTANCE":
                distance = w.int()
                if not 1 <= distance <= 4:
                    raise CommandError("DISTANCE is 1 to 4")
            elif word == "TERMS":
                how = w.text().upper()
                words = self.catalog.dictionaries.get(w.text(), set())
                include, exclude = (include | words, exclude) if how == "INCLUDE" else (include, exclude | words)
            elif word == "FULLSCOREINFO":
                full = True
            else:
                w.next()
        from ..operators.retrieval import terms_of

        df = index.prepared()
        every = F.array_distinct(F.flatten(F.array(*[F.col(f"__tok_{f.name}") for f in index.of_type("TEXT")])))
        vocabulary = df.select(F.explode(every).alias("term")).where("term != ''").groupBy("term").agg(F.count("*").alias("documents"))
        return suggest.spellcheck(vocabulary, df.count(), terms_of(query.tree(index)), distance, include, exclude, full)

    def do_config(self, w: Words):
        how = w.text().upper()
        name = w.text().upper()
        if how == "SET":
            if name not in self.settings:
                raise CommandError(f"no setting {name}")
            self.settings[name] = w.text()
            return "OK"
        return {k: v for k, v in self.settings.items() if name in ("*", k)}

    # -- extensions ------------------------------------------------------------------------------------------------

    def register_scorer(self, name: str, scorer) -> None:
        from ..operators import scoring

        scoring.register(name, scorer)

    def register_expander(self, name: str, expander: Callable[[str], list[str]]) -> None:
        self.expanders[name] = expander


__all__ = ["CommandError", "Engine", "ExpressionError"]

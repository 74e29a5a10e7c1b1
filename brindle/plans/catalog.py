"""Index and field definitions, aliases, dictionaries, synonyms and suggestions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions import analysis
from ..functions.expressions import build
from ..functions.values import Typed, kind_of, truth

TYPES = ("TEXT", "NUMERIC", "GEO", "TAG", "VECTOR", "GEOSHAPE")
MAX_FIELDS = 1024


@dataclass(frozen=True)
class FieldDef:
    name: str
    type: str
    path: str | None = None
    weight: float = 1.0
    nostem: bool = False
    phonetic: bool = False
    sortable: bool = False
    noindex: bool = False
    separator: str | None = ","
    case_sensitive: bool = False
    index_empty: bool = False
    index_missing: bool = False
    metric: str = "L2"
    dim: int | None = None
    algorithm: str = "FLAT"
    coords: str = "SPHERICAL"
    #: a column of epoch seconds after which the field's value counts as missing
    expires: str | None = None


@dataclass(frozen=True)
class IndexDef:
    """A schema over a DataFrame: the documents whose key has a prefix and that pass a filter."""

    name: str
    df: DataFrame
    fields: tuple[FieldDef, ...]
    key: str = "__key"
    prefixes: tuple[str, ...] = ()
    filter: str | None = None
    score: float = 1.0
    score_field: str | None = None
    language: str = "english"
    payload_field: str | None = None
    stopwords: tuple[str, ...] | None = None
    expire_field: str | None = None
    language_field: str | None = None
    #: where write_postings() put this collection's postings
    postings: str | None = None
    min_stem: int = analysis.MIN_STEM_LENGTH
    min_phonetic: int = analysis.MIN_PHONETIC_LENGTH
    gap: int = analysis.MULTI_VALUE_GAP
    synonyms: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def __post_init__(self):
        if len(self.fields) > MAX_FIELDS:
            raise ValueError(f"an index has {MAX_FIELDS} fields at most")
        for f in self.fields:
            if f.type not in TYPES:
                raise ValueError(f"no field type {f.type}")

    def field(self, name: str) -> FieldDef:
        for f in self.fields:
            if f.name == name:
                return f
        raise ValueError(f"no field @{name} in index {self.name}")

    def of_type(self, kind: str) -> list[FieldDef]:
        return [f for f in self.fields if f.type == kind and not f.noindex]

    def source(self) -> DataFrame:
        """The indexed documents with __key, __score and each field under its name."""
        df = self.df
        if self.key != "__key":
            df = df.withColumn("__key", F.col(self.key))
        if self.prefixes:
            key = F.col("__key").cast("string")
            cond = F.lit(False)
            for p in self.prefixes:
                cond = cond | key.startswith(p)
            df = df.where(cond)
        for f in self.fields:
            if f.path and (f.path != f.name or f.name not in df.columns):
                df = df.withColumn(f.name, json_path(df, f.path))
        if self.filter:
            kinds = {s.name: kind_of(s.dataType) for s in df.schema.fields}
            df = df.where(truth(build(self.filter, lambda n: Typed(F.col(f"`{n}`"), kinds.get(n)) if n in kinds else Typed(F.lit(None).cast("string"), None))))
        later = lambda c: F.col(f"`{c}`").isNull() | (F.col(f"`{c}`") > F.unix_timestamp())
        ending = {f.name: F.when(later(f.expires), F.col(f"`{f.name}`")) for f in self.fields if f.expires}
        df = df.withColumns(ending) if ending else df
        if self.expire_field:
            df = df.where(later(self.expire_field))
        score = F.lit(float(self.score))
        if self.score_field:
            score = F.coalesce(F.col(self.score_field).cast("double"), score)
        return df.withColumn("__score", score)

    def text_tokens(self, df: DataFrame, name: str) -> Column:
        """Tokens of a text field; the values of an array stand a gap apart, filled by empty places."""
        stop = list(self.stopwords) if self.stopwords is not None else None
        col = F.col(f"`{name}`")
        if isinstance(df.schema[name].dataType, ArrayType):
            gap = F.array_repeat(F.lit(""), self.gap)
            each = F.transform(col, lambda x: F.concat(analysis.tokens(x, stop), gap))
            return F.coalesce(F.flatten(each), F.array().cast("array<string>"))
        return analysis.tokens(col, stop)

    def prepared(self, keys: DataFrame | None = None) -> DataFrame:
        """source() with __tok_F for text, __stem_F for stemmed text and __tag_F for tag fields; unused ones are pruned.

        keys: a small table of the __key of all documents that matter; the others are dropped before their texts are read into tokens.
        """
        df = self.source()
        if keys is not None:
            df = df.join(F.broadcast(keys), "__key", "left_semi")
        made: dict[str, Column] = {}
        for f in self.of_type("TEXT"):
            made[f"__tok_{f.name}"] = self.text_tokens(df, f.name)
        for f in self.of_type("TAG"):
            is_array = isinstance(df.schema[f.name].dataType, ArrayType)
            made[f"__tag_{f.name}"] = analysis.tags(F.col(f"`{f.name}`").cast("array<string>" if is_array else "string"), f.separator if not is_array else None, f.case_sensitive, is_array, f.index_empty)
        df = df.withColumns(made) if made else df
        language = F.coalesce(F.lower(F.col(f"`{self.language_field}`")), F.lit(self.language)) if self.language_field else self.language
        more = {f"__stem_{f.name}": analysis.stems(F.col(f"__tok_{f.name}"), language, self.min_stem) for f in self.of_type("TEXT") if not f.nostem}
        more |= {f"__phon_{f.name}": analysis.phonetics(F.col(f"__tok_{f.name}"), self.min_phonetic) for f in self.of_type("TEXT") if f.phonetic}
        return df.withColumns(more) if more else df

    def alter(self, *fields: FieldDef) -> IndexDef:
        return replace(self, fields=self.fields + fields)


def json_path(df: DataFrame, path: str) -> Column:
    """A column by name, a struct's field by a.b, or $.a.b and $.a[*] of a column of JSON texts named 'json'."""
    if path.startswith("$"):
        if path.endswith("[*]"):
            return F.from_json(F.get_json_object("json", path[:-3]), "array<string>")
        return F.get_json_object("json", path)
    return F.col(f"`{path}`") if path in df.columns else F.col(path)


class Catalog:
    """Names: indexes, aliases, dictionaries and synonym groups; suggestions are DataFrames (string, score, payload)."""

    def __init__(self):
        self.indexes: dict[str, IndexDef] = {}
        self.aliases: dict[str, str] = {}
        self.dictionaries: dict[str, set[str]] = {}
        self.synonym_groups: dict[str, dict[str, set[str]]] = {}
        self.suggestions: dict[str, DataFrame] = {}
        #: what settings say of analysis: fields of IndexDef by name
        self.analysis: Callable[[], dict] = dict

    def create(self, index: IndexDef, if_absent: bool = False) -> IndexDef:
        if index.name in self.indexes:
            if if_absent:
                return self.indexes[index.name]
            raise ValueError(f"index {index.name} exists")
        self.indexes[index.name] = index
        return index

    def get(self, name: str) -> IndexDef:
        name = self.aliases.get(name, name)
        if name not in self.indexes:
            raise ValueError(f"no index {name}")
        index = replace(self.indexes[name], **self.analysis())
        groups = self.synonym_groups.get(name)
        if not groups:
            return index
        words: dict[str, set[str]] = {}
        for terms in groups.values():
            for t in terms:
                words.setdefault(t, set()).update(terms)
        return replace(index, synonyms={t: tuple(sorted(o)) for t, o in words.items()})

    def alter(self, name: str, *fields: FieldDef) -> None:
        name = self.aliases.get(name, name)
        self.indexes[name] = self.indexes[name].alter(*fields)

    def drop(self, name: str) -> None:
        name = self.aliases.get(name, name)
        if self.indexes.pop(name, None) is None:
            raise ValueError(f"no index {name}")
        self.aliases = {a: n for a, n in self.aliases.items() if n != name}
        self.synonym_groups.pop(name, None)

    def alias(self, alias: str, name: str, update: bool = False) -> None:
        if alias in self.aliases and not update:
            raise ValueError(f"alias {alias} exists")
        if name not in self.indexes:
            raise ValueError(f"no index {name}")
        self.aliases[alias] = name

    def unalias(self, alias: str) -> None:
        if self.aliases.pop(alias, None) is None:
            raise ValueError(f"no alias {alias}")

    def synonyms(self, name: str, group: str, terms: list[str]) -> None:
        self.synonym_groups.setdefault(self.aliases.get(name, name), {}).setdefault(group, set()).update(t.lower() for t in terms)

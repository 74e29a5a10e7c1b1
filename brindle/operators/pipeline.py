"""The ordered steps LOAD, APPLY, FILTER, GROUPBY, SORTBY and LIMIT over a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import build
from ..functions.reducers import REDUCERS, Kept, collect, default_alias, quantile
from ..functions.scalars import ExpressionError
from ..functions.values import Typed, kind_of, truth

DEFAULT_LIMIT = 10
MAX_SORT_KEYS = 8
#: up to so many rows of a group Spark drops later ones before it deals them out (spark.sql.optimizer.windowGroupLimitThreshold)
GROUP_LIMIT = 1000
SALTS = 64


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def resolver(df: DataFrame, strict: bool = False) -> Callable[[str], Typed]:
    kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields}

    def resolve(name: str) -> Typed:
        if name not in kinds:
            raise ExpressionError(f"no property @{name}")
        col = quoted(name)
        if strict:
            col = F.when(col.isNull(), F.raise_error(F.lit(f"@{name} is missing")).cast(df.schema[name].dataType)).otherwise(col)
        return Typed(col, kinds[name])

    return resolve


def beside(groups: DataFrame, other: DataFrame, names: list[str], alias: str) -> DataFrame:
    """groups with a column of another table of the same groups, whose keys are __g0, __g1, ...; null keys are equal."""
    if not names:
        return groups.withColumn("__one", F.lit(1)).join(other.select(F.lit(1).alias("__one"), alias), "__one", "left").drop("__one")
    on = F.lit(True)
    for j, k in enumerate(names):
        on = on & quoted(k).eqNullSafe(F.col(f"__g{j}"))
    return groups.join(other, on, "left").drop(*[f"__g{j}" for j in range(len(names))])


@dataclass
class Pipeline:
    """Steps in the order they are called; each returns the pipeline. `unique` is the key that settles ties."""

    df: DataFrame
    unique: str | None = None
    functions: dict = field(default_factory=dict)
    strict: bool = False
    reducers: dict = field(default_factory=dict)
    #: a GROUPBY that makes more groups is an error; negative: any number
    most_groups: int = -1
    _sorted: bool = False
    _limited: bool = False

    def load(self, fields: list[str | tuple[str, str]] | str) -> Pipeline:
        """LOAD n @f [AS a]... or '*'. A path with dots reads a struct's field."""
        if fields == "*":
            return self
        for f in fields:
            path, alias = (f, f) if isinstance(f, str) else f
            if path != alias or path not in self.df.columns:
                self.df = self.df.withColumn(alias, quoted(path) if path in self.df.columns else F.col(path))
        return self

    def apply(self, expression: str, alias: str) -> Pipeline:
        made = build(expression, resolver(self.df, self.strict), self.functions)
        self.df = self.df.withColumn(alias, made.col.cast("double") if made.kind == "bool" else made.col)
        return self

    def filter(self, expression: str) -> Pipeline:
        self.df = self.df.where(truth(build(expression, resolver(self.df, self.strict), self.functions)))
        return self

    def groupby(self, keys: list[str], reducers: list[tuple[str, list[str], str | None]] = ()) -> Pipeline:
        """An array key makes a group of each element, an empty or missing one a null group; no reducers: distinct keys."""
        df = self.df
        source = resolver(df)
        names = [k.lstrip("@") for k in keys]
        wanted = [(name.upper(), list(args), alias or default_alias(name, list(args))) for name, args, alias in reducers]
        exploded = {}
        for j, k in enumerate(names):
            if source(k).kind == "array":
                exploded[k] = f"__key{j}"
                df = df.withColumn(f"__key{j}", F.explode_outer(quoted(k)))
        group = [quoted(exploded.get(k, k)).alias(k) for k in names]
        resolve, known = resolver(df), {**REDUCERS, **self.reducers}
        aggs, apart = [], []
        for name, args, alias in wanted:
            if name not in known:
                raise ExpressionError(f"no reducer {name}")
            low, high, make = known[name]
            if not low <= len(args) <= high:
                raise ExpressionError(f"{name} takes {low} to {high} arguments, not {len(args)}")
            if make is quantile and resolve(args[0].lstrip("@")).kind == "array":
                one = df.withColumn("__element", F.explode_outer(resolve(args[0].lstrip("@")).col))
                made = one.groupBy(*[quoted(exploded.get(k, k)).alias(f"__g{j}") for j, k in enumerate(names)]).agg(make(["__element", *args[1:]], resolver(one)).alias(alias))
                apart.append((alias, made))
                continue
            made = make(args, resolve, [c for c in self.df.columns if not c.startswith("__")]) if make is collect else make(args, resolve)
            if isinstance(made, Kept):
                apart.append((alias, self._kept(df, [quoted(exploded.get(k, k)) for k in names], made, alias)))
            else:
                aggs.append(made.alias(alias))
        if not wanted:
            self.df = df.select(*group).distinct()
        else:
            out = df.groupBy(*group).agg(*(aggs or [F.count(F.lit(1)).alias("__rows")]))
            for alias, other in apart:
                out = beside(out, other, names, alias)
            self.df = out.select(*map(quoted, names), *[quoted(a) for _, _, a in wanted])
        if 0 <= self.most_groups < self.df.limit(self.most_groups + 1).count():
            raise ExpressionError(f"GROUPBY makes more than {self.most_groups} groups")
        self.unique, self._sorted = None, False
        return self

    def _kept(self, df: DataFrame, group: list[Column], kept: Kept, alias: str) -> DataFrame:
        """A group's rows in order from an offset on, as an array.

        Rows are ranked and those beyond the last one wanted are dropped, which Spark does in each task before it deals
        out the rest; where more are wanted than it does that for, each group is first ranked in SALTS parts.
        """
        keys, by = [f"__g{j}" for j in range(len(group))], [f"__o{j}" for j in range(len(kept.order))]
        ties = ["__tie"] if self.unique and self.unique in df.columns and not kept.distinct else []
        made = df.select(*[g.alias(k) for g, k in zip(group, keys, strict=True)], *[c.alias(k) for (c, _), k in zip(kept.order, by, strict=True)], kept.value.alias("__value"), *[quoted(self.unique).alias(t) for t in ties])
        made = made.where("__value IS NOT NULL") if kept.skip_null else made
        made = made.distinct() if kept.distinct else made
        order = [F.col(k).desc_nulls_last() if down else F.col(k).asc_nulls_last() for (_, down), k in zip(kept.order, by, strict=True)]
        order += [F.col(t).asc() for t in ties]
        order = order or [F.xxhash64(F.to_json(F.struct("__value"))).asc()]
        last = kept.offset + kept.n
        first = lambda rows, *more: rows.withColumn("__rank", F.row_number().over(W.partitionBy(*keys, *more).orderBy(*order))).where(F.col("__rank") <= last)
        if last > GROUP_LIMIT:
            made = first(made.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))), "__salt").drop("__salt", "__rank")
        made = first(made).where(F.col("__rank") > kept.offset)
        return made.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("__rank", "__value"))), lambda x: x["__value"]).alias(alias))

    def sortby(self, keys: list[tuple[str, bool]], most: int | None = None) -> Pipeline:
        """keys: (property, descending). A missing value comes last either way; ties go to the smaller key."""
        if len(keys) > MAX_SORT_KEYS:
            raise ExpressionError(f"SORTBY takes {MAX_SORT_KEYS} keys at most")
        order = [quoted(k.lstrip("@")).desc_nulls_last() if down else quoted(k.lstrip("@")).asc_nulls_last() for k, down in keys]
        if self.unique and self.unique in self.df.columns and self.unique not in [k.lstrip("@") for k, _ in keys]:
            order.append(quoted(self.unique).asc())
        self.df = self.df.orderBy(*order)
        self._sorted = True
        if most is not None:
            self.df, self._limited = self.df.limit(most), True
        return self

    def limit(self, offset: int, n: int) -> Pipeline:
        if n == 0 and offset:
            raise ExpressionError("LIMIT with no rows takes offset 0")
        self.df = (self.df.offset(offset) if offset else self.df).limit(n)
        self._limited = True
        return self

    def result(self, default_limit: bool = True) -> DataFrame:
        """A sorted pipeline without LIMIT or MAX keeps the first 10 rows."""
        if self._sorted and not self._limited and default_limit:
            return self.df.limit(DEFAULT_LIMIT)
        return self.df

"""The 15 reducers of GROUPBY as aggregate Columns: name -> builder(args, resolve) -> Column."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import ExpressionError
from .values import INF, NAN, Typed, number

COLLECT_DEFAULT = 10
SAMPLE_LIMIT = 1000
#: precision of the distinct-count sketch, as log2 of its registers: a standard error of 1.6 %
SKETCH_BITS = 12


def _name(arg: str) -> str:
    return arg[1:] if arg.startswith("@") else arg


def _flat(x: Typed) -> Column:
    """The numbers of a value: an array's elements, or the value itself, as an array<double>."""
    if x.kind == "array":
        return F.transform(x.col, lambda v: v.try_cast("double"))
    return F.array(number(x))


def count(args, resolve):
    return F.count(F.lit(1)).cast("double")


def sum_(args, resolve):
    return F.coalesce(F.sum(number(resolve(_name(args[0])))), F.lit(NAN))


def avg(args, resolve):
    return F.coalesce(F.avg(number(resolve(_name(args[0])))), F.lit(NAN))


def min_(args, resolve):
    return F.coalesce(F.min(number(resolve(_name(args[0])))), F.lit(INF))


def max_(args, resolve):
    return F.coalesce(F.max(number(resolve(_name(args[0])))), F.lit(-INF))


def _moments(x: Typed) -> Column:
    """Sample deviation over array elements from sums that combine before the shuffle."""
    v = _flat(x)
    keep = F.filter(v, lambda e: e.isNotNull())
    n = F.sum(F.size(keep)).cast("double")
    add = lambda f: F.sum(F.aggregate(F.transform(keep, f), F.lit(0.0), lambda a, e: a + e))
    s, q = add(lambda e: e), add(lambda e: e * e)
    return F.sqrt(F.greatest(F.lit(0.0), (q - s * s / n) / F.when(n > 1, n - 1)))


def stddev(args, resolve):
    x = resolve(_name(args[0]))
    return F.coalesce(_moments(x) if x.kind == "array" else F.stddev_samp(number(x)), F.lit(0.0))


def quantile(args, resolve):
    """Over the elements where the property is an array: the pipeline explodes it before."""
    x, q = resolve(_name(args[0])), float(args[1])
    if not 0 <= q <= 1:
        raise ExpressionError("QUANTILE takes a quantile from 0 to 1")
    accuracy = max(10_000, int(float(args[2]))) if len(args) > 2 else 10_000
    return F.coalesce(F.percentile_approx(number(x), q, accuracy), F.lit(NAN))


def count_distinct(args, resolve):
    return F.count_distinct(resolve(_name(args[0])).col).cast("double")


def _bytes(x: Typed) -> Column:
    return x.col if x.kind == "string" else x.col.cast("string")


def count_distinctish(args, resolve):
    return F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(_bytes(resolve(_name(args[0]))), SKETCH_BITS)), F.lit(0)).cast("double")


def hll(args, resolve):
    return F.hll_sketch_agg(_bytes(resolve(_name(args[0]))), SKETCH_BITS)


def hll_sum(args, resolve):
    return F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(resolve(_name(args[0])).col)), F.lit(0)).cast("double")


def tolist(args, resolve):
    x = resolve(_name(args[0]))
    if x.kind == "array":
        return F.array_distinct(F.flatten(F.collect_set(x.col)))
    return F.collect_set(x.col)


def first_value(args, resolve):
    x = resolve(_name(args[0]))
    if len(args) == 1:
        return F.first(x.col)
    if args[1].upper() != "BY" or len(args) < 3:
        raise ExpressionError("FIRST_VALUE takes BY and a property")
    by = resolve(_name(args[2])).col
    down = len(args) > 3 and args[3].upper() == "DESC"
    return F.max_by(x.col, by) if down else F.min_by(x.col, by)


def random_sample(args, resolve):
    """What the pipeline keeps of a group: n values in a random order."""
    x, n = resolve(_name(args[0])), int(float(args[1]))
    if not 0 < n <= SAMPLE_LIMIT:
        raise ExpressionError(f"RANDOM_SAMPLE takes 1 to {SAMPLE_LIMIT}")
    return Kept(x.col, [(F.rand(0), False)], 0, n, skip_null=True)


def parse_collect(args: list[str]) -> dict:
    """FIELDS (* | k @f...) [SORTBY n @f [ASC|DESC]...] [LIMIT offset count] [DISTINCT]."""
    out = {"fields": None, "sort": [], "limit": None, "distinct": False}
    i = 0
    while i < len(args):
        word = args[i].upper()
        if word == "FIELDS":
            if args[i + 1] == "*":
                i += 2
            else:
                k = int(args[i + 1])
                out["fields"] = [_name(a) for a in args[i + 2 : i + 2 + k]]
                i += 2 + k
        elif word == "SORTBY":
            k = int(args[i + 1])
            for a in args[i + 2 : i + 2 + k]:
                if a.upper() in ("ASC", "DESC"):
                    out["sort"][-1] = (out["sort"][-1][0], a.upper() == "DESC")
                else:
                    out["sort"].append((_name(a), False))
            i += 2 + k
        elif word == "LIMIT":
            out["limit"] = (int(args[i + 1]), int(args[i + 2]))
            i += 3
        elif word == "DISTINCT":
            out["distinct"] = True
            i += 1
        else:
            raise ExpressionError(f"COLLECT: unexpected {args[i]}")
    return out


@dataclass
class Kept:
    """A reducer that keeps rows `offset` to `offset + n` of a group in an order; the pipeline ranks them, in parts first."""

    value: Column
    #: columns, and whether each one descends
    order: list[tuple[Column, bool]]
    offset: int
    n: int
    distinct: bool = False
    skip_null: bool = False


def collect(args, resolve, all_fields: list[str] | None = None):
    """An aggregate, or with SORTBY or LIMIT what is kept. Without them the group itself is the result, whatever its size."""
    spec = parse_collect(list(args))
    fields = spec["fields"] if spec["fields"] is not None else list(all_fields or [])
    row = F.struct(*[resolve(f).col.alias(f) for f in fields])
    if not spec["sort"] and spec["limit"] is None:
        return F.collect_set(row) if spec["distinct"] else F.collect_list(row)
    offset, n = spec["limit"] or (0, COLLECT_DEFAULT)
    order = [(resolve(f).col, down) for f, down in spec["sort"]]
    return Kept(row, order, offset, n, spec["distinct"])


REDUCERS: dict[str, tuple[int, int, Callable]] = {
    "COUNT": (0, 0, count), "SUM": (1, 1, sum_), "AVG": (1, 1, avg), "MIN": (1, 1, min_), "MAX": (1, 1, max_), "STDDEV": (1, 1, stddev), "QUANTILE": (2, 3, quantile),
    "COUNT_DISTINCT": (1, 1, count_distinct), "COUNT_DISTINCTISH": (1, 1, count_distinctish), "HLL": (1, 1, hll), "HLL_SUM": (1, 1, hll_sum), "TOLIST": (1, 1, tolist),
    "FIRST_VALUE": (1, 4, first_value), "RANDOM_SAMPLE": (2, 2, random_sample), "COLLECT": (1, 512, collect),
}


def default_alias(name: str, args: list[str]) -> str:
    return "__generated_alias" + (name + ",".join(args)).replace("@", "").lower()

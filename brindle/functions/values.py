"""Dynamic values on typed columns: number conversion and text, truth, IEEE arithmetic, comparison."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, NumericType, StringType

NAN = float("nan")
INF = float("inf")


class Typed:
    """A column and its type where it is known ('number', 'string', 'bool', 'array' or None)."""

    __slots__ = ("col", "kind", "value")

    def __init__(self, col: Column, kind: str | None, value=None):
        self.col, self.kind, self.value = col, kind, value


def kind_of(t: DataType) -> str | None:
    if isinstance(t, BooleanType):
        return "bool"
    if isinstance(t, NumericType):
        return "number"
    if isinstance(t, StringType):
        return "string"
    if isinstance(t, ArrayType):
        return "array"
    return None


def number(x: Typed) -> Column:
    """The value as a double; text that isn't a number gives null; an array counts as its first element."""
    if x.kind in ("number", "bool"):
        return x.col.cast("double")
    if x.kind == "array":
        return F.get(x.col, 0).try_cast("double")
    return x.col.try_cast("double")


def truth(x: Typed) -> Column:
    """Numbers other than 0 and non-empty strings and arrays are true; null is false."""
    if x.kind == "bool":
        return F.coalesce(x.col, F.lit(False))
    if x.kind == "number":
        return F.coalesce(x.col != 0, F.lit(False))
    if x.kind == "array":
        return F.coalesce(F.size(x.col) > 0, F.lit(False))
    if x.kind == "string":
        return F.coalesce(x.col != "", F.lit(False))
    return F.coalesce(x.col.isNotNull(), F.lit(False))


@F.pandas_udf(StringType())
def _shortest(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None or v != v else "inf" if v == INF else "-inf" if v == -INF else "%.12g" % v)


def number_text(col: Column) -> Column:
    """Integral values within 64 bits as integers, others with 12 significant digits."""
    d = col.cast("double")
    whole = (d == F.floor(d)) & (F.abs(d) < F.lit(9.2e18))
    # values that need at most 6 decimals stay in the JVM; only the others are formatted by a vectorised function
    short = F.round(d, 6)
    plain = F.regexp_replace(F.format_string("%.6f", short), r"0+$", "")
    return F.when(whole, d.cast("long").cast("string")).when((short == d) & (F.abs(d) < 1e5) & (F.abs(d) >= 1e-4), plain).otherwise(_shortest(d))


def text(x: Typed) -> Column:
    if x.kind == "number":
        return number_text(x.col)
    if x.kind == "bool":
        return F.when(x.col, F.lit("1")).when(~x.col, F.lit("0"))
    if x.kind == "array":
        return F.lit("").cast("string")
    return x.col.cast("string")


def divide(a: Column, b: Column) -> Column:
    """IEEE division: by zero gives an infinity or NaN instead of an error."""
    zero = F.when((a == 0) | F.isnan(a), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def remainder(a: Column, b: Column) -> Column:
    """fmod: the sign of the dividend; by zero NaN."""
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, F.lit(NAN)).otherwise(a % F.when(b == 0, F.lit(1.0)).otherwise(b))


def compare(op: str, a: Typed, b: Typed) -> Column:
    """== != < <= > >=; a number and a text compare as numbers, two texts bytewise, arrays by their first element."""
    if a.kind == "array":
        a = Typed(F.get(a.col, 0), None)
    if b.kind == "array":
        b = Typed(F.get(b.col, 0), None)
    if a.value is None and a.kind == "null" or b.value is None and b.kind == "null":
        same = a.col.isNull() if b.kind == "null" else b.col.isNull()
        return {"==": same, "!=": ~same}.get(op, F.lit(False))
    numeric = a.kind in ("number", "bool") or b.kind in ("number", "bool")
    x, y = (number(a), number(b)) if numeric else (a.col.cast("string"), b.col.cast("string"))
    out = {"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
    return F.coalesce(out, F.lit(op == "!="))

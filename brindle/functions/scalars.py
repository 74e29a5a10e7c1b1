"""The scalar functions of the expression language, as Column builders: name -> (fewest, most arguments, builder)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import distance, pair
from .values import INF, NAN, Typed, number, number_text, text, truth

S, N, A = "string", "number", "array"


class ExpressionError(ValueError):
    pass


def _literal(x: Typed, what: str):
    if x.value is None:
        raise ExpressionError(f"{what} must be a literal")
    return x.value


def _on_string(x: Typed, make: Callable[[Column], Column]) -> Column:
    return make(x.col) if x.kind in (S, None) else F.lit(None).cast("string")


def lower(x):
    return Typed(_on_string(x, F.lower), S)


def upper(x):
    return Typed(_on_string(x, F.upper), S)


def substr(s, offset, length):
    """Byte offsets; a negative offset counts from the end, a negative length leaves that many bytes off the end."""
    raw = F.encode(text(s), "UTF-8")
    n, off, size = F.octet_length(raw), number(offset).cast("int"), number(length).cast("int")
    start = F.when(off < 0, F.greatest(n + off, F.lit(0))).otherwise(F.least(off, n))
    rest = n - start
    take = F.when(size < 0, F.greatest(rest + size, F.lit(0))).otherwise(F.least(size, rest))
    return Typed(F.decode(F.substring(raw, start + 1, take), "UTF-8"), S)


def format_(fmt, *args):
    spec = str(_literal(fmt, "the format"))
    parts, values, i = [], list(args), 0
    for piece in re.split(r"(%.)", spec):
        if piece == "%s":
            if not values:
                raise ExpressionError("format: too few arguments")
            parts.append(F.coalesce(text(values.pop(0)), F.lit("(null)")))
        elif piece == "%%":
            parts.append(F.lit("%"))
        elif piece.startswith("%") and len(piece) == 2:
            raise ExpressionError(f"format: unknown {piece}")
        elif piece:
            parts.append(F.lit(piece))
        i += 1
    return Typed(F.concat(*parts) if parts else F.lit(""), S)


def split(s, seps=None, strip=None):
    """Separators and stripped characters are sets; empty parts are dropped."""
    by = str(_literal(seps, "separators")) if seps is not None else ","
    off = str(_literal(strip, "the strip set")) if strip is not None else " "
    body = text(s)
    parts = F.split(body, "[" + re.sub(r"([\\\]\[^\-&])", r"\\\1", by) + "]") if by else F.array(body)
    if off:
        parts = F.transform(parts, lambda x: F.btrim(x, F.lit(off)))
    return Typed(F.filter(parts, lambda x: x != ""), A)


def to_number(x):
    return Typed(x.col.cast("double") if x.kind in (S, None) else number(x), N)


def to_str(x):
    return Typed(text(x), S)


def exists(x):
    return Typed(x.col.isNotNull().cast("double"), N)


def case(cond, a, b):
    if a.kind == b.kind:
        return Typed(F.when(truth(cond), a.col).otherwise(b.col), a.kind)
    if "null" in (a.kind, b.kind):
        return Typed(F.when(truth(cond), a.col).otherwise(b.col), a.kind if b.kind == "null" else b.kind)
    return Typed(F.when(truth(cond), text(a)).otherwise(text(b)), S)


def startswith(s, p):
    return Typed(F.startswith(text(s), text(p)).cast("double"), N)


def contains(s, sub):
    """How many places sub starts at, overlaps counted; the empty text starts at each and at the end."""
    body, part = text(s), text(sub)
    m = F.length(part)
    places = F.when(F.length(body) >= m, F.sequence(F.lit(1), F.length(body) - m + 1)).otherwise(F.array().cast("array<int>"))
    found = F.size(F.filter(places, lambda i: F.substring(body, i, m) == part))
    return Typed(F.when(m == 0, F.octet_length(body) + 1).otherwise(found).cast("double"), N)


def strlen(s):
    return Typed(F.octet_length(text(s)).cast("double"), N)


def _math(make: Callable[[Column], Column]):
    def build(x):
        v = number(x) if x.kind in (N, "bool") else x.col.try_cast("double") if x.kind is None else F.lit(NAN) if x.kind == A else number(x)
        return Typed(F.coalesce(make(v), F.lit(NAN)), N)

    return build


def _log(fn: Callable[[Column], Column]):
    return _math(lambda v: F.when(v == 0, F.lit(-INF)).when(v < 0, F.lit(NAN)).otherwise(fn(v)))


#: strftime and strptime letters in Spark's date patterns
PATTERNS = {
    "Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "j": "DDD", "y": "yy", "B": "MMMM", "b": "MMM", "h": "MMM",
    "A": "EEEE", "a": "EEE", "e": "d", "I": "hh", "p": "a", "R": "HH:mm", "D": "MM/dd/yy", "Z": "'UTC'", "z": "xx", "n": "'\n'", "t": "'\t'", "%": "'%'",
}


def date_pattern(fmt: str) -> str:
    out, i, quoted = [], 0, ""

    def close():
        nonlocal quoted
        if quoted:
            out.append("'" + quoted.replace("'", "''") + "'" if re.search(r"[A-Za-z'\[\]{}#]", quoted) else quoted)
            quoted = ""

    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            close()
            if fmt[i + 1] not in PATTERNS:
                raise ExpressionError(f"unknown date format %{fmt[i + 1]}")
            out.append(PATTERNS[fmt[i + 1]])
            i += 2
        else:
            quoted += fmt[i]
            i += 1
    close()
    return "".join(out)


def _moment(x: Typed) -> Column:
    seconds = number(x)
    return F.when(seconds >= 0, F.timestamp_seconds(F.floor(seconds)))


def timefmt(ts, fmt=None):
    return Typed(F.date_format(_moment(ts), date_pattern(str(_literal(fmt, "the format")) if fmt is not None else "%FT%TZ")), S)


def parsetime(s, fmt):
    return Typed(F.unix_timestamp(F.try_to_timestamp(text(s), F.lit(date_pattern(str(_literal(fmt, "the format")))))).cast("double"), N)


def _truncated(unit: str):
    return lambda ts: Typed(F.unix_timestamp(F.date_trunc(unit, _moment(ts))).cast("double"), N)


def _field(make: Callable[[Column], Column]):
    return lambda ts: Typed(make(_moment(ts)).cast("double"), N)


def geodistance(*args):
    """Two points as 'lon,lat' texts, or one as text and one as two numbers, or four numbers; metres, to two decimals."""
    if len(args) == 2:
        points = [pair(text(args[0])), pair(text(args[1]))]
    elif len(args) == 4:
        points = [(number(args[0]), number(args[1])), (number(args[2]), number(args[3]))]
    elif args[0].kind == N:
        points = [(number(args[0]), number(args[1])), pair(text(args[2]))]
    else:
        points = [pair(text(args[0])), (number(args[1]), number(args[2]))]
    (lon1, lat1), (lon2, lat2) = points
    return Typed(F.coalesce(F.round(distance(lon1, lat1, lon2, lat2), 2), F.lit(NAN)), N)


def matched_terms(most=None):
    raise ExpressionError("matched_terms needs a text query")


FUNCTIONS: dict[str, tuple[int, int, Callable[..., Typed]]] = {
    "lower": (1, 1, lower), "upper": (1, 1, upper), "substr": (3, 3, substr), "format": (1, 64, format_), "split": (1, 3, split), "matched_terms": (0, 1, matched_terms),
    "to_number": (1, 1, to_number), "to_str": (1, 1, to_str), "exists": (1, 1, exists), "case": (3, 3, case), "startswith": (2, 2, startswith), "contains": (2, 2, contains), "strlen": (1, 1, strlen),
    "log": (1, 1, _log(F.ln)), "log2": (1, 1, _log(F.log2)), "floor": (1, 1, _math(lambda v: F.floor(v).cast("double"))), "ceil": (1, 1, _math(lambda v: F.ceil(v).cast("double"))),
    "abs": (1, 1, _math(F.abs)), "sqrt": (1, 1, _math(F.sqrt)), "exp": (1, 1, _math(F.exp)),
    "timefmt": (1, 2, timefmt), "parsetime": (2, 2, parsetime), "minute": (1, 1, _truncated("minute")), "hour": (1, 1, _truncated("hour")), "day": (1, 1, _truncated("day")), "month": (1, 1, _truncated("month")),
    "dayofweek": (1, 1, _field(lambda m: F.dayofweek(m) - 1)), "dayofmonth": (1, 1, _field(F.dayofmonth)), "dayofyear": (1, 1, _field(lambda m: F.dayofyear(m) - 1)),
    "monthofyear": (1, 1, _field(lambda m: F.month(m) - 1)), "year": (1, 1, _field(F.year)), "geodistance": (2, 4, geodistance),
}

__all__ = ["FUNCTIONS", "ExpressionError", "number_text"]

"""Points and polygons as WKT: WITHIN, CONTAINS, INTERSECTS, DISJOINT, evaluated by a vectorised function.

Spherical shapes are pairs of longitude and latitude with great circles as edges. They are seen from the globe's centre on
the plane that touches it in the middle of the shape asked about, where great circles are straight lines; what lies on the
other half of the globe is apart from it. So a shape asked about must fit into half of the globe.
"""

from __future__ import annotations

import re
from functools import lru_cache
from math import cos, radians, sin, sqrt

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Ring = list[tuple[float, float]]


@lru_cache(maxsize=10_000)
def parse_wkt(wkt: str) -> tuple[str, tuple] | None:
    """('POINT', (x, y)) or ('POLYGON', (outer ring, holes...)); None where it can't be read."""
    m = re.fullmatch(r"\s*(POINT|POLYGON)\s*(\(.*\))\s*", wkt, re.I | re.S)
    if not m:
        return None
    try:
        if m[1].upper() == "POINT":
            x, y = map(float, m[2].strip("() \n").split())
            return "POINT", (x, y)
        rings = tuple(tuple((float(a), float(b)) for a, b in (p.split() for p in r.split(","))) for r in re.findall(r"\(([^()]+)\)", m[2]))
    except ValueError:
        return None
    return ("POLYGON", rings) if rings and all(len(r) >= 3 for r in rings) else None


def _side(a, b, p) -> float:
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def _on(a, b, p) -> bool:
    return abs(_side(a, b, p)) < 1e-12 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def _edges(ring):
    return list(zip(ring, ring[1:] + ring[:1], strict=True)) if ring[0] != ring[-1] else list(zip(ring, ring[1:], strict=False))


def _in_ring(ring, p) -> int:
    """1 inside, 0 on the edge, -1 outside."""
    inside = False
    for a, b in _edges(ring):
        if _on(a, b, p):
            return 0
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
            inside = not inside
    return 1 if inside else -1


def _in_polygon(rings, p) -> int:
    at = _in_ring(rings[0], p)
    for hole in rings[1:]:
        at = min(at, -_in_ring(hole, p))
    return at


def _cross(a, b, c, d) -> bool:
    """Whether two segments cross at a point inside both."""
    return _side(a, b, c) * _side(a, b, d) < 0 and _side(c, d, a) * _side(c, d, b) < 0


def _all_edges(rings):
    return [e for r in rings for e in _edges(r)]


def covers(outer, inner) -> bool:
    """Whether inner lies in outer, edges included."""
    if outer is None or inner is None:
        return False
    if outer[0] == "POINT":
        return inner[0] == "POINT" and outer[1] == inner[1]
    if inner[0] == "POINT":
        return _in_polygon(outer[1], inner[1]) >= 0
    if any(_in_polygon(outer[1], p) < 0 for p in inner[1][0]):
        return False
    if any(_cross(a, b, c, d) for a, b in _edges(inner[1][0]) for c, d in _all_edges(outer[1])):
        return False
    middles = [((a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for a, b in _edges(inner[1][0])]
    if any(_in_polygon(outer[1], p) < 0 for p in middles):
        return False
    # a hole of the outer one that lies inside the inner one
    return not any(_in_polygon(inner[1], p) > 0 for hole in outer[1][1:] for p in hole)


def intersects(a, b) -> bool:
    if a is None or b is None:
        return False
    if a[0] == "POINT" or b[0] == "POINT":
        return covers(a, b) or covers(b, a)
    if any(_cross(p, q, r, s) for p, q in _all_edges(a[1]) for r, s in _all_edges(b[1])):
        return True
    return any(_in_polygon(b[1], p) >= 0 for p in a[1][0]) or any(_in_polygon(a[1], p) >= 0 for p in b[1][0])


def _globe(p) -> tuple[float, float, float]:
    lon, lat = radians(p[0]), radians(p[1])
    return cos(lat) * cos(lon), cos(lat) * sin(lon), sin(lat)


def _dot(a, b) -> float:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def plane_of(shape):
    """A function that puts shapes on the plane that touches the globe in the middle of a shape, or None for what isn't in view."""
    points = [_globe(p) for p in ([shape[1]] if shape[0] == "POINT" else shape[1][0])]
    middle = [sum(p[k] for p in points) for k in range(3)]
    size = sqrt(_dot(middle, middle))
    if size < 1e-9:
        raise ValueError("the shape is larger than half of the globe")
    up = tuple(x / size for x in middle)
    side = (-up[1], up[0], 0.0) if abs(up[2]) < 0.9 else (0.0, -up[2], up[1])
    length = sqrt(_dot(side, side))
    east = tuple(x / length for x in side)
    north = (up[1] * east[2] - up[2] * east[1], up[2] * east[0] - up[0] * east[2], up[0] * east[1] - up[1] * east[0])

    def seen(p):
        g = _globe(p)
        near = _dot(g, up)
        return (_dot(g, east) / near, _dot(g, north) / near) if near > 1e-9 else None

    def put(other):
        if other is None:
            return None
        if other[0] == "POINT":
            p = seen(other[1])
            return None if p is None else ("POINT", p)
        rings = tuple(tuple(map(seen, r)) for r in other[1])
        return None if any(p is None for r in rings for p in r) else ("POLYGON", rings)

    return put


def relates(col: Column, relation: str, wkt: str, coords: str = "FLAT") -> Column:
    shape = parse_wkt(wkt)
    if shape is None:
        raise ValueError(f"can't read the shape {wkt!r}")
    put = plane_of(shape) if coords == "SPHERICAL" else lambda s: s
    asked = put(shape)
    if asked is None:
        raise ValueError("the shape is larger than half of the globe")

    @F.pandas_udf("boolean")
    def run(x: pd.Series) -> pd.Series:
        def one(w):
            read = parse_wkt(w) if w is not None else None
            if read is None:
                return False
            own = put(read)
            return covers(asked, own) if relation == "WITHIN" else covers(own, asked) if relation == "CONTAINS" else intersects(own, asked) if relation == "INTERSECTS" else not intersects(own, asked)

        return x.map(one)

    return run(col)

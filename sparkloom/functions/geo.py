"""Containment of points in shapes on the sphere, in built-in expressions.

A polygon's edges are geodesics. Seen from a point, the directions to a closed ring's vertices turn
once around if the point is inside and not at all if it is outside; the turn of an edge A, B seen from P is the angle
between the planes through P, A and P, B. Rings that cover more than half of the sphere are read the other way round.
Points exactly on an edge may fall on either side.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.tree import QueryError, Shape

EARTH_METRES = 6_378_100.0


def vector(lon: float, lat: float) -> tuple[float, float, float]:
    a, b = math.radians(lon), math.radians(lat)
    return math.cos(b) * math.cos(a), math.cos(b) * math.sin(a), math.sin(b)


def _cross(a, b):
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def _dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def _point(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    a, b = F.radians(lon), F.radians(lat)
    return F.cos(b) * F.cos(a), F.cos(b) * F.sin(a), F.sin(b)


def _at(p, c):
    """Dot product of a column vector and a constant one."""
    return p[0] * F.lit(c[0]) + p[1] * F.lit(c[1]) + p[2] * F.lit(c[2])


def _ring(points) -> list[tuple[float, float, float]]:
    out = [vector(*q[:2]) for q in points]
    if len(points) < 4 or points[0][:2] != points[-1][:2]:
        raise QueryError("Ring is not closed, or has fewer than 3 vertices")
    if len({q[:2] for q in points[:-1]}) < 3:
        raise QueryError("Polygon must have at least 3 different vertices")
    ring = out[:-1]
    # The area's sign tells the direction; the larger side of the sphere is never meant.
    total = 0.0
    for i in range(len(ring)):
        a, b, c = ring[i - 1], ring[i], ring[(i + 1) % len(ring)]
        n1, n2 = _cross(a, b), _cross(b, c)
        total += math.atan2(_dot(_cross(n1, n2), b), _dot(n1, n2))
    return ring if 2 * math.pi - total < 2 * math.pi else ring[::-1]


def _inside(p, ring) -> Column:
    turn = F.lit(0.0)
    for i in range(len(ring)):
        a, b = ring[i - 1], ring[i]
        turn = turn + F.atan2(_at(p, _cross(a, b)), F.lit(_dot(a, b)) - _at(p, a) * _at(p, b))
    return turn > math.pi


def within(kind: Column, coordinates: Column, shape: Shape) -> Column:
    """Whether a stored point ({type, coordinates}) lies in ``shape``; what isn't a valid point doesn't. Never null."""
    lon, lat = F.try_element_at(coordinates, F.lit(1)), F.try_element_at(coordinates, F.lit(2))
    valid = (kind == "Point") & F.size(coordinates).between(2, 3) & lon.between(-180, 180) & lat.between(-90, 90)
    p = _point(lon, lat)
    if shape.kind == "circle":
        centre, radius = shape.points
        if radius < 0:
            raise QueryError("The radius of a circle must be a non-negative number")
        c = vector(*centre[:2])
        half = sum((x - y) * (x - y) for x, y in zip(p, map(F.lit, c)))
        test = F.lit(True) if radius >= math.pi else half <= (2 * math.sin(radius / 2)) ** 2
    else:
        if shape.kind == "box":
            (x1, y1), (x2, y2) = (q[:2] for q in shape.points)
            rings = [_ring([(x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1)])]
        else:
            rings = [_ring(r) for r in shape.points]
        test = _inside(p, rings[0])
        for hole in rings[1:]:
            test = test & ~_inside(p, hole)
    return F.coalesce(valid & test, F.lit(False))

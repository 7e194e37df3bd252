"""Lines and rings as arrays of (x, y): projection to UTM, length, nearest point, parts of a line, clipping and area."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The WGS 84 ellipsoid and the scale of UTM's central meridian.
SEMI_MAJOR, FLATTENING, SCALE = 6378137.0, 1 / 298.257223563, 0.9996
_N = FLATTENING / (2 - FLATTENING)
RADIUS = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
#: Coefficients of the series by Krueger, to the fourth power of the third flattening (well under a millimetre).
ALPHA = (
    _N / 2 - 2 / 3 * _N**2 + 5 / 16 * _N**3 + 41 / 180 * _N**4,
    13 / 48 * _N**2 - 3 / 5 * _N**3 + 557 / 1440 * _N**4,
    61 / 240 * _N**3 - 103 / 140 * _N**4,
    49561 / 161280 * _N**4,
)
ECCENTRIC = 2 * _N**0.5 / (1 + _N)
#: Coefficients of the way back: from the grid to the sphere, and from the conformal latitude to the geographic one.
BETA = (
    _N / 2 - 2 / 3 * _N**2 + 37 / 96 * _N**3 - 1 / 360 * _N**4,
    1 / 48 * _N**2 + 1 / 15 * _N**3 - 437 / 1440 * _N**4,
    17 / 480 * _N**3 - 37 / 840 * _N**4,
    4397 / 161280 * _N**4,
)
DELTA = (
    2 * _N - 2 / 3 * _N**2 - 2 * _N**3 + 116 / 45 * _N**4,
    7 / 3 * _N**2 - 8 / 5 * _N**3 - 227 / 45 * _N**4,
    56 / 15 * _N**3 - 136 / 35 * _N**4,
    4279 / 630 * _N**4,
)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once however often use refers to it."""
    return F.transform(F.array(value), lambda v: use(v))[0]


def utm(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing in metres of WGS 84 degrees in a UTM zone; south of the equator with the false northing."""
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - ECCENTRIC * F.atanh(ECCENTRIC * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(ALPHA, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + SCALE * RADIUS * east, SCALE * RADIUS * north + F.when(lat < 0, 1e7).otherwise(0.0)


def from_utm(east: Column, north: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Degrees of a place in a UTM zone; south: whether northings have the false one."""
    xi, eta = (north - F.when(south, 1e7).otherwise(0.0)) / (SCALE * RADIUS), (east - 500000) / (SCALE * RADIUS)
    p, q = xi, eta
    for j, b in enumerate(BETA, 1):
        p = p - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        q = q - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(p) / F.cosh(q))
    phi = chi
    for j, d in enumerate(DELTA, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return zone * 6 - 183 + F.degrees(F.atan2(F.sinh(q), F.cos(p))), F.degrees(phi)


def projected(x: Column, y: Column, source: int, target: int) -> tuple[Column, Column]:
    """A place of one system in another, by EPSG codes: 4326 (degrees) and UTM zones (326xx and 327xx)."""
    for code in (source, target):
        if code != 4326 and not (code // 100 in (326, 327) and 1 <= code % 100 <= 60):
            raise ValueError(f"EPSG:{code} is neither degrees nor a UTM zone")
    if source == target:
        return x, y
    lon, lat = (x, y) if source == 4326 else from_utm(x, y, F.lit(source % 100), F.lit(source // 100 == 327))
    if target == 4326:
        return lon, lat
    east, north = utm(lon, lat, F.lit(target % 100))
    # utm() adds the false northing by the sign of the latitude; a zone's code decides here
    plain = north - F.when(lat < 0, 1e7).otherwise(0.0)
    return east, plain + (1e7 if target // 100 == 327 else 0.0)


def without_repeats(points: Column) -> Column:
    """The line without vertices equal to the one before."""
    return F.filter(points, lambda p, i: (i == 0) | (p != F.get(points, i - 1)))


def segments(points: Column) -> Column:
    """Array of (a, b, start) with the length of the line before each segment."""
    step = lambda i: F.hypot(F.get(points, i + 1)["x"] - F.get(points, i)["x"], F.get(points, i + 1)["y"] - F.get(points, i)["y"])
    index = F.filter(F.sequence(F.lit(0), F.greatest(F.size(points) - 2, F.lit(0))), lambda i: i < F.size(points) - 1)
    before = lambda i: F.aggregate(F.filter(index, lambda j: j < i), F.lit(0.0), lambda acc, j: acc + step(j))
    return F.transform(index, lambda i: F.struct(F.get(points, i).alias("a"), F.get(points, i + 1).alias("b"), before(i).alias("start")))


def length(points: Column) -> Column:
    size = lambda s: F.hypot(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"])
    return F.aggregate(segments(points), F.lit(0.0), lambda acc, s: acc + size(s))


def nearest_point(points: Column, x: Column, y: Column) -> Column:
    """(distance, along): how far a point is from a line, and where along it; ties to the earlier place."""

    def of(s: Column) -> Column:
        dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
        raw = F.coalesce(F.try_divide((x - s["a"]["x"]) * dx + (y - s["a"]["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))
        return F.struct(F.hypot(s["a"]["x"] + t * dx - x, s["a"]["y"] + t * dy - y).alias("distance"), (s["start"] + t * F.hypot(dx, dy)).alias("along"))

    return F.array_min(F.transform(segments(points), of))


def within(points: Column, x: Column, y: Column, radius: float) -> Column:
    """Whether a point lies in the round-capped buffer of a line."""
    return nearest_point(points, x, y)["distance"] <= radius


def part(points: Column, start: Column, end: Column) -> Column:
    """The line from one distance along it to another: cut points and the vertices between."""
    size = lambda s: F.hypot(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"])

    def cut(s: Column) -> Column:
        at = lambda d: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(d - s["start"], size(s))))
        place = lambda d: F.struct((s["a"]["x"] + at(d) * (s["b"]["x"] - s["a"]["x"])).alias("x"), (s["a"]["y"] + at(d) * (s["b"]["y"] - s["a"]["y"])).alias("y"))
        return F.array(place(start), place(end))

    touched = F.filter(segments(points), lambda s: (size(s) > 0) & (s["start"] < end) & (s["start"] + size(s) > start))
    return bound(F.flatten(F.transform(touched, cut)), without_repeats)


def clipped(ring: Column, convex: list[tuple[float, float]]) -> Column:
    """The part of a ring inside a convex ring given counter-clockwise, one edge of it after the other."""
    for (ax, ay), (bx, by) in zip(convex, [*convex[1:], convex[0]], strict=True):
        side = lambda p, ax=ax, ay=ay, bx=bx, by=by: (bx - ax) * (p["y"] - ay) - (by - ay) * (p["x"] - ax)

        def cut(points: Column, side: Callable[[Column], Column] = side) -> Column:
            def edge(p: Column, i: Column) -> Column:
                q = F.get(points, (i + 1) % F.size(points))
                t = F.try_divide(side(p), side(p) - side(q))
                crossing = F.struct((p["x"] + t * (q["x"] - p["x"])).alias("x"), (p["y"] + t * (q["y"] - p["y"])).alias("y"))
                stays = F.when(side(p) >= 0, F.array(F.struct(p["x"].alias("x"), p["y"].alias("y")))).otherwise(F.slice(F.array(crossing), 1, 0))
                return F.concat(stays, F.when((side(p) >= 0) != (side(q) >= 0), F.array(crossing)).otherwise(F.slice(F.array(crossing), 1, 0)))

            return F.flatten(F.transform(points, edge))

        ring = bound(ring, cut)
    return ring


def area(ring: Column) -> Column:
    """Area of a ring without crossings."""

    def shoelace(points: Column) -> Column:
        def term(p: Column, i: Column) -> Column:
            q = F.get(points, (i + 1) % F.size(points))
            return p["x"] * q["y"] - q["x"] * p["y"]

        return F.abs(F.aggregate(F.transform(points, term), F.lit(0.0), lambda acc, v: acc + v)) / 2

    return bound(ring, shoelace)

"""Polygons as array<array<double>> of (lon, lat), by higher-order functions (GEO-01..12)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.values import bound

LON_METRES, LAT_METRES = 111_320.0, 110_540.0
GOLDEN = math.pi * (3 - math.sqrt(5))
MERCATOR_RADIUS = 6_378_137.0


def polygon(text: Column) -> Column:
    """GEO-01: pairs of numbers in a text; fewer than three give NULL."""
    pairs = F.regexp_extract_all(text, F.lit(r"(-?\d+(?:\.\d+)?)[\s,]+(-?\d+(?:\.\d+)?)"), F.lit(0))
    points = F.transform(pairs, lambda p: F.transform(F.split(p, r"[\s,]+"), lambda x: x.try_cast("double")))
    return F.when(F.size(points) >= 3, points)


def axis(ring: Column, i: int) -> Column:
    return F.transform(ring, lambda p: p[i])


def bbox(ring: Column) -> Column:
    """array(min lon, min lat, max lon, max lat)."""
    return F.array(F.array_min(axis(ring, 0)), F.array_min(axis(ring, 1)), F.array_max(axis(ring, 0)), F.array_max(axis(ring, 1)))


def bbox_centre(ring: Column) -> Column:
    """GEO-03."""
    return bound(bbox(ring), lambda b: F.array((b[0] + b[2]) / 2, (b[1] + b[3]) / 2))


def closed(ring: Column) -> Column:
    """GEO-10: the first point again at the end, unless it stands there."""
    return F.when(ring[0] == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.array(ring[0])))


def normalised(ring: Column, points: int = 24) -> Column:
    """GEO-02: struct(points around the box centre in units of its longer side, centre, bbox, count); at most `points`, closed."""
    rounded = lambda a: F.transform(a, lambda x: F.round(x, 6))
    step = F.size(ring) / F.lit(float(points))

    def frame(b: Column) -> Column:
        span = F.greatest(b[2] - b[0], b[3] - b[1])
        return F.struct(b.alias("b"), F.array((b[0] + b[2]) / 2, (b[1] + b[3]) / 2).alias("c"), F.when(span == 0, F.lit(1e-6)).otherwise(span).alias("unit"))

    def shape(f: Column) -> Column:
        at = lambda p, i: F.round((p[i] - f["c"][i]) / f["unit"], 4)
        return F.struct(f["b"].alias("b"), f["c"].alias("c"), F.transform(ring, lambda p: F.array(at(p, 0), at(p, 1))).alias("s"))

    def result(f: Column) -> Column:
        fewer = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.get(f["s"], F.floor(i * step).cast("int")))
        kept = bound(F.when(F.size(ring) > points, fewer).otherwise(f["s"]), closed)
        return F.struct(kept.alias("points"), rounded(f["c"]).alias("centre"), rounded(f["b"]).alias("bbox"), F.size(ring).alias("count"))

    return F.when(F.size(ring) >= 3, bound(bound(bound(bbox(ring), frame), shape), result))


def vertex_mean(ring: Column) -> Column:
    """GEO-04: mean of the vertices."""
    mean = lambda i: F.aggregate(axis(ring, i), F.lit(0.0), lambda a, x: a + x) / F.size(ring)
    return F.array(mean(0), mean(1))


def _crosses(ring: Column) -> Column:
    n = F.size(ring)
    following = F.concat(F.slice(ring, F.lit(2), n - 1), F.array(ring[0]))
    return F.zip_with(ring, following, lambda p, q: F.struct((p[0] * q[1] - q[0] * p[1]).alias("c"), (p[0] + q[0]).alias("x"), (p[1] + q[1]).alias("y")))


def signed_area(ring: Column) -> Column:
    return F.aggregate(_crosses(ring), F.lit(0.0), lambda a, s: a + s.c) / 2.0


def ring_centroid(ring: Column) -> Column:
    """GEO-04: area-weighted centroid; the vertex mean where the area is nothing."""
    zero = F.struct(*(F.lit(0.0).alias(n) for n in ("a", "x", "y")))
    sums = F.aggregate(_crosses(ring), zero, lambda t, s: F.struct((t.a + s.c).alias("a"), (t.x + s.x * s.c).alias("x"), (t.y + s.y * s.c).alias("y")))
    return bound(sums, lambda t: F.when(t.a == 0, vertex_mean(ring)).otherwise(F.array(t.x / (3.0 * t.a), t.y / (3.0 * t.a))))


def to_metres(ring: Column, origin: Column) -> Column:
    """GEO-05: local plane around an origin."""
    facts = F.struct(origin.alias("o"), (F.cos(F.radians(origin[1])) * LON_METRES).alias("k"))
    return bound(facts, lambda f: F.transform(ring, lambda p: F.array((p[0] - f["o"][0]) * f["k"], (p[1] - f["o"][1]) * LAT_METRES)))


def area(outer: Column, holes: Column | None = None) -> Column:
    """GEO-06: square metres, holes taken off, to two places."""
    origin = vertex_mean(outer)
    whole = F.abs(signed_area(to_metres(outer, origin)))
    if holes is not None:
        whole = whole - F.aggregate(F.coalesce(holes, F.array().cast("array<array<array<double>>>")), F.lit(0.0), lambda a, h: a + F.abs(signed_area(to_metres(h, origin))))
    return F.round(whole, 2)


def from_mercator(point: Column) -> Column:
    """GEO-07: EPSG:3857 to degrees where the numbers cannot be degrees."""
    lon = F.degrees(point[0] / MERCATOR_RADIUS)
    lat = F.degrees(2 * F.atan(F.exp(point[1] / MERCATOR_RADIUS)) - math.pi / 2)
    return F.when((F.abs(point[0]) > 180) | (F.abs(point[1]) > 90), F.array(lon, lat)).otherwise(point)


def spiral(centre: Column, i: Column, r0: float = 5.0, dr: float = 3.0) -> Column:
    """GEO-08: the i-th place around a centre on a golden-angle spiral (metres)."""
    r, angle = r0 + dr * F.sqrt(i + 1.0), i * GOLDEN
    return F.array(centre[0] + r * F.cos(angle) / (LON_METRES * F.cos(F.radians(centre[1]))), centre[1] + r * F.sin(angle) / LON_METRES)


def wkt(ring: Column) -> Column:
    """GEO-10."""
    points = F.transform(closed(ring), lambda p: F.concat_ws(" ", p[0].cast("string"), p[1].cast("string")))
    return F.concat(F.lit("POLYGON(("), F.array_join(points, ", "), F.lit("))"))


def geojson(ring: Column) -> Column:
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(closed(ring)).alias("coordinates")))


def contours(geometry_json: Column) -> Column:
    """GEO-09: outer rings of a Polygon or MultiPolygon."""
    kind = F.get_json_object(geometry_json, "$.type")
    coordinates = F.get_json_object(geometry_json, "$.coordinates")
    one = F.from_json(coordinates, "array<array<array<double>>>")
    many = F.from_json(coordinates, "array<array<array<array<double>>>>")
    return F.when(kind == "Polygon", F.slice(one, 1, 1)).when(kind == "MultiPolygon", F.transform(many, lambda p: p[0]))


def coordinates_in_text(text: Column, lat: tuple[float, float] = (41.0, 82.0), lon: tuple[float, float] = (19.0, 180.0)) -> Column:
    """GEO-11: the first 'lat, lon' pair, if it lies in the box."""
    p = r"(-?\d{1,3}\.\d+)\s*[,; ]\s*(-?\d{1,3}\.\d+)"
    a, b = (F.nullif(F.regexp_extract(text, p, g), F.lit("")).try_cast("double") for g in (1, 2))
    return F.when(a.between(*lat) & b.between(*lon), F.array(b, a))


def flipped(ring: Column) -> Column:
    """GEO-12: [lat, lon] to [lon, lat] and back."""
    return F.transform(ring, lambda p: F.array(p[1], p[0]))


def area_sane(computed: Column, stated: Column) -> Column:
    """FLT-16: why a computed area is not believed; NULL where it is."""
    ratio = F.try_divide(computed, stated)
    return F.when(computed > 1e10, "too large").when(ratio > 100, "far above").when(ratio < 0.01, "far below")

"""Spherical geometry as native column expressions (degrees in, kilometres or degrees out)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean Earth radius in km; km of a degree of longitude at the equator and of latitude, for local planes.
EARTH_RADIUS_KM = 6371.0088
KM_PER_DEG_LON, KM_PER_DEG_LAT = 111.320, 110.574
KNOT_KM_H = 1.852


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance; null if any coordinate is null."""
    a, b, c, d = (F.radians(col(x)) for x in (lat1, lon1, lat2, lon2))
    sin2 = lambda x: F.sin(x / 2) * F.sin(x / 2)
    h = sin2(c - a) + F.cos(a) * F.cos(c) * sin2(d - b)
    # least and greatest pass over nulls; h itself would be computed twice
    known = a.isNotNull() & b.isNotNull() & c.isNotNull() & d.isNotNull()
    return F.when(known, F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h)))))


def initial_bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    """Course at the first point, from 0 to 360."""
    a, b, c, d = (F.radians(col(x)) for x in (lat1, lon1, lat2, lon2))
    y = F.sin(d - b) * F.cos(c)
    x = F.cos(a) * F.sin(c) - F.sin(a) * F.cos(c) * F.cos(d - b)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def unit_vector(lat, lon) -> tuple[Column, Column, Column]:
    a, b = F.radians(col(lat)), F.radians(col(lon))
    return F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)


def great_circle_points(lat1, lon1, lat2, lon2, n: int = 64) -> Column:
    """Array of ``lat, lon``: ``n`` (at least 2) points at equal angles; two for points that coincide."""
    a, b, n = unit_vector(lat1, lon1), unit_vector(lat2, lon2), max(2, n)
    dot = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), a[0] * b[0] + a[1] * b[1] + a[2] * b[2]))

    def point(arc: Column, i: Column) -> Column:
        t = i / F.lit(float(n - 1))
        wa, wb = F.sin((1 - t) * arc.w) / arc.s, F.sin(t * arc.w) / arc.s
        x, y, z = (wa * arc[f"a{j}"] + wb * arc[f"b{j}"] for j in range(3))
        return F.struct(F.degrees(F.atan2(z, F.sqrt(x * x + y * y))).alias("lat"), F.degrees(F.atan2(y, x)).alias("lon"))

    ends = F.array(F.struct(col(lat1).cast("double").alias("lat"), col(lon1).cast("double").alias("lon")), F.struct(col(lat2).cast("double").alias("lat"), col(lon2).cast("double").alias("lon")))
    # an array of one: the angle and the vectors are computed once, not for each point
    angle = F.array(F.struct(F.acos(dot).alias("w"), *[v.alias(f"a{j}") for j, v in enumerate(a)], *[v.alias(f"b{j}") for j, v in enumerate(b)]))
    arcs = F.transform(angle, lambda v: F.struct(v.w.alias("w"), F.sin(v.w).alias("s"), *[v[f"{c}{j}"].alias(f"{c}{j}") for c in "ab" for j in range(3)]))
    return F.transform(arcs, lambda arc: F.when(arc.w < 1e-12, ends).otherwise(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: point(arc, i))))[0]


def densified(lat1, lon1, lat2, lon2, step_km: float = 25.0) -> Column:
    """A segment's great circle in ``max(2, int(length / step) + 1)`` points; array of ``lat, lon``."""
    last = F.greatest(F.lit(2), F.floor(haversine_km(lat1, lon1, lat2, lon2) / step_km).cast("int") + 1) - 1
    # arrays of one: what a segment or a point has once is computed once, not wherever it is used
    once = lambda value, f: F.transform(F.array(value), f)[0]
    ends = F.struct(last.alias("last"), *[v.alias(f"{e}{j}") for e, p in (("a", unit_vector(lat1, lon1)), ("b", unit_vector(lat2, lon2))) for j, v in enumerate(p)])

    def angle(v: Column) -> Column:
        dot = v["a0"] * v["b0"] + v["a1"] * v["b1"] + v["a2"] * v["b2"]
        return F.struct(v.alias("v"), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))).alias("w"))

    def point(arc: Column, i: Column) -> Column:
        t = i / arc["v"]["last"]
        weights = F.struct(F.when(arc["w"] < 1e-12, 1 - t).otherwise(F.sin((1 - t) * arc["w"]) / arc["s"]).alias("a"), F.when(arc["w"] < 1e-12, t).otherwise(F.sin(t * arc["w"]) / arc["s"]).alias("b"))
        x, y, z = ((lambda w, j=j: w["a"] * arc["v"][f"a{j}"] + w["b"] * arc["v"][f"b{j}"]) for j in range(3))
        place = lambda p: F.struct(F.degrees(F.atan2(p["z"], F.sqrt(p["x"] * p["x"] + p["y"] * p["y"]))).alias("lat"), F.degrees(F.atan2(p["y"], p["x"])).alias("lon"))
        return once(once(weights, lambda w: F.struct(x(w).alias("x"), y(w).alias("y"), z(w).alias("z"))), place)

    def along(arc: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), arc["v"]["last"]), lambda i: point(arc, i))

    return once(once(once(ends, angle), lambda u: F.struct(u["v"].alias("v"), u["w"].alias("w"), F.sin(u["w"]).alias("s"))), along)


def signed_log(x) -> Column:
    return F.signum(col(x)) * F.log1p(F.abs(col(x)))


def eta_hours(km, knots) -> Column:
    return col(km) / (F.greatest(col(knots), F.lit(0.1)) * KNOT_KM_H)


def detour_ratio(route_km, direct_km) -> Column:
    return F.when(col(direct_km) == 0, F.lit(1.0)).otherwise(col(route_km) / col(direct_km))


def tile_bounds(z, x, y) -> Column:
    """South, west, north and east of a Web-Mercator tile."""
    n = F.pow(F.lit(2.0), col(z))
    lat = lambda v: F.degrees(F.atan(F.sinh(F.lit(3.141592653589793) * (1 - 2 * v / n))))
    lon = lambda v: v / n * 360.0 - 180.0
    return F.struct(lat(col(y) + 1).alias("south"), lon(col(x)).alias("west"), lat(col(y)).alias("north"), lon(col(x) + 1).alias("east"))


def finite(x) -> Column:
    """NaN and infinities become null, as JSON sinks need."""
    c = col(x)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def nan_to_null(x) -> Column:
    return F.when(~F.isnan(col(x)), col(x))

"""Zones, regions and object columns: the fixed values that all operators share, and their column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from fairlead.functions.geo import col

# The zones in the order of their index, and their weights.
CLASSES = ("OPEN_SEA", "COASTAL_SEA", "NEAR_COAST", "COASTLINE")
WEIGHTS = {"OPEN_SEA": 1.0, "COASTAL_SEA": 1.8, "NEAR_COAST": float("inf"), "COASTLINE": float("inf")}
WATER, LAND = ("OPEN_SEA", "COASTAL_SEA"), ("NEAR_COAST", "COASTLINE")
IMPASSABLE = 1.0e6
TOLERANCE_M = 5.0
#: name: south, north, west, east; lower bounds inclusive, upper exclusive, the first match wins.
REGIONS = {
    "North Europe (Baltic and North Sea)": (47.5, 68.0, -40.0, 33.0),
    "Red Sea and Gulf of Aden": (5.0, 30.0, 32.0, 52.0),
    "Aegean Sea": (34.3, 41.3, 19.0, 31.0),
    "Black Sea and Eastern Mediterranean": (29.0, 47.5, 19.0, 42.5),
    "Persian Gulf and Arabian Sea": (5.0, 31.5, 48.0, 70.0),
    "Bay of Bengal": (10.0, 25.0, 78.0, 93.0),
    "Strait of Malacca and Andaman Sea": (-1.0, 10.0, 92.0, 105.0),
    "South China Sea": (-1.0, 26.0, 103.0, 125.0),
    "Japan and North-West Pacific": (19.0, 48.0, 125.0, 165.0),
    "Southern Africa (Cape of Good Hope)": (-42.0, -28.0, 13.0, 32.0),
    "Central America (Caribbean coast)": (4.0, 18.0, -90.0, -76.0),
}
OTHER_REGION = "Other (inland samples)"
OBJECTS = ("osm_piers", "osm_lighthouses", "osm_breakwaters", "osm_harbors", "osm_rivers", "osm_lakes", "osm_beaches", "osm_cliffs", "osm_industrial")
MARINE = ("osm_piers", "osm_lighthouses", "osm_breakwaters", "osm_harbors")
COASTAL = ("osm_beaches", "osm_cliffs")
INLAND = ("osm_rivers", "osm_lakes")


def class_index(code) -> Column:
    """Null for an unknown code."""
    return F.create_map(*chain(*((F.lit(c), F.lit(i)) for i, c in enumerate(CLASSES))))[col(code)]


def class_name(index) -> Column:
    return F.get(F.array(*map(F.lit, CLASSES)), col(index))


def zone_weight(code) -> Column:
    return F.create_map(*chain(*((F.lit(c), F.lit(w)) for c, w in WEIGHTS.items())))[col(code)]


def zone_cost(index) -> Column:
    """Finite cost of a lattice cell: land gets the impassable cost."""
    i = col(index)
    return F.when(i == 0, F.lit(1.0)).when(i == 1, F.lit(1.8)).otherwise(F.lit(IMPASSABLE))


def zone_title(code) -> Column:
    return F.initcap(F.translate(col(code), "_", " "))


def passable(cost) -> Column:
    return col(cost) < IMPASSABLE


def region(lat, lon) -> Column:
    y, x = col(lat), col(lon)
    out = F.lit(OTHER_REGION)
    for name, (s, n, w, e) in reversed(REGIONS.items()):
        out = F.when((y >= s) & (y < n) & (x >= w) & (x < e), F.lit(name)).otherwise(out)
    return out


def conflict(code, measure, tolerance: float = TOLERANCE_M) -> Column:
    """Water above the tolerance or land below it; a missing measure never conflicts."""
    c, m = col(code), col(measure)
    return F.coalesce((c.isin(*WATER) & (m > tolerance)) | (c.isin(*LAND) & (m < -tolerance)), F.lit(False))


def any_conflict(code, measures=("noaa_depth", "elevation"), tolerance: float = TOLERANCE_M) -> Column:
    out = F.lit(False)
    for m in measures:
        out = out | conflict(code, m, tolerance)
    return out


def object_sum(columns=OBJECTS, prefix: str = "") -> Column:
    out = F.lit(0.0)
    for c in columns:
        out = out + F.col(prefix + c)
    return out

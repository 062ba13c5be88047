"""Nearest-neighbour joins on the sphere by buckets, and the features built on them.

Space around the unit sphere is cut into cubic tiles. A tile's queries meet the index points in it and in a margin
around it, a matrix product for each tile. A query whose k-th neighbour may lie beyond the margin is asked again with
one three times as large. Only unresolved queries go on, and in the last round the margin is the whole sphere, so the
result is exact. Of index points at one place only the first ``k`` by id can be among the ``k`` nearest, so no more go on,
and statistics and features of a neighbourhood are made once for each place that queries have.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairlead.functions.geo import EARTH_RADIUS_KM, haversine_km, signed_log, unit_vector
from fairlead.functions.zones import COASTAL, INLAND, MARINE, OBJECTS, object_sum
from fairlead.operators.shared import large, written

# Neighbours of the context; a neighbour this close (km) is the point itself; least span (km) of a density.
NEIGHBOURS, SELF_KM, LEAST_SPAN_KM = 8, 0.002, 1.2
#: Points that a margin should hold about; edge of a tile in margins; rows of a tile that go to one task, about.
MARGIN_POINTS, TILE, PART = 40, 4, 20_000


def reference_index(df: DataFrame) -> DataFrame:
    """Points with a depth or elevation, each filled from the other."""
    depth, height = F.coalesce("noaa_depth", "elevation"), F.coalesce("elevation", "noaa_depth")
    kept = df.where(depth.isNotNull())
    return kept.select("id", "latitude", "longitude", depth.alias("depth"), height.alias("height"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in OBJECTS])


def _places(queries: DataFrame) -> DataFrame:
    """``id, latitude, longitude``: each place of the queries once, by its least id."""
    return written(queries.groupBy("latitude", "longitude").agg(F.min("id").alias("id")).select("id", "latitude", "longitude"), "places")


def _axes(lat: str, lon: str) -> list[Column]:
    """A point of the unit sphere, moved to the cube from 0 to 2: no poles and no date line."""
    return [v + 1 for v in unit_vector(lat, lon)]


def _spacing(index: DataFrame) -> float:
    """The margin (as a chord) that holds a few neighbours where points are: from their number and the number of cells of
    about 100 km that have any."""
    edge = 100 / EARTH_RADIUS_KM
    cell = F.struct(*[F.floor(v / edge) for v in _axes("latitude", "longitude")])
    found = index.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(cell).alias("cells")).first()
    a_cell = max(1.0, found.n / max(1, found.cells))
    return edge * math.sqrt(MARGIN_POINTS / math.pi / a_cell)


#: Tiles of a stored index along an axis of the cube around the sphere.
STORED = 16


@dataclass(frozen=True)
class StoredIndex:
    """Index points in files by tile (see :func:`save_index`); a query reads the tiles that it can reach."""

    points: DataFrame
    margin: float

    def near(self, queries: DataFrame, margin: float) -> DataFrame:
        """The points of the tiles within ``margin`` (a chord) of any query: at most ``STORED ** 3`` tile numbers come to
        the driver and go into the scan as a partition filter."""
        edge = 2.0 / STORED
        low = lambda v, m: F.greatest(F.lit(0), F.least(F.lit(STORED - 1), F.floor((v + m) / edge).cast("int")))
        x, y, z = (F.sequence(low(v, -margin), low(v, margin)) for v in _axes("latitude", "longitude"))
        spans = queries.select(x.alias("x"), y.alias("y"), z.alias("z")).distinct()
        tiles = spans.select(F.explode("x").alias("x"), "y", "z").select("x", F.explode("y").alias("y"), "z").select("x", "y", F.explode("z").alias("z")).distinct()
        wanted = [r.tile for r in tiles.select(_tile_number("x", "y", "z").alias("tile")).collect()]
        return self.points.where(F.col("tile").isin(wanted) if wanted else F.lit(False)).drop("tile")


def _tile_number(x, y, z) -> Column:
    return (F.col(x) * STORED + F.col(y)) * STORED + F.col(z)


def save_index(index: DataFrame, path: str) -> None:
    """Writes an index by tile of the sphere, a folder each, and the margin that its density suggests. A crowded tile is
    written by many tasks. Coordinates keep their precision."""
    edge = 2.0 / STORED
    at = [F.least(F.floor(v / edge).cast("int"), F.lit(STORED - 1)) for v in _axes("latitude", "longitude")]
    tiled = index.withColumn("tile", (at[0] * STORED + at[1]) * STORED + at[2])
    counts = tiled.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / (50 * PART)).alias("parts"))
    dealt = tiled.join(F.broadcast(counts), "tile").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))  # STORED ** 3 tiles at most
    dealt.repartition("tile", "part").drop("part", "parts").write.mode("overwrite").partitionBy("tile").parquet(f"{path}/points")
    index.sparkSession.createDataFrame([(_spacing(index),)], "margin double").coalesce(1).write.mode("overwrite").parquet(f"{path}/margin")


def load_index(spark: SparkSession, path: str) -> StoredIndex:
    return StoredIndex(spark.read.parquet(f"{path}/points"), spark.read.parquet(f"{path}/margin").first().margin)


def _nearest(key, q, r, k: int):
    """The ``k`` nearest of ``r`` for each of ``q``, and what is as near but for rounding."""
    import numpy as np
    import pyarrow as pa

    unit = lambda t: np.stack([t.column(c).to_numpy() for c in ("x", "y", "z")], 1) - 1
    a, b = unit(q), unit(r)
    step, left, right = max(1, 4_000_000 // max(1, len(b))), [], []
    for i in range(0, len(a) if len(b) else 0, step):
        near = a[i : i + step] @ b.T  # the cosine of the angle: the larger the nearer
        if len(b) > k:
            least = np.partition(near, len(b) - k, axis=1)[:, [len(b) - k]]
            x, y = np.nonzero(near >= least - 1e-12)
        else:
            x, y = np.nonzero(np.ones_like(near, bool))
        left.append(x + i)
        right.append(y)
    x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (left, right))
    q, r = q.take(pa.array(x)), r.take(pa.array(y))
    return pa.table([q.column("q_id"), q.column("q_lat"), q.column("q_lon"), r.column("r_id"), r.column("r_lat"), r.column("r_lon")], names=["q_id", "q_lat", "q_lon", "r_id", "r_lat", "r_lon"])


def neighbours(queries: DataFrame, index: DataFrame | StoredIndex, k: int, cell_km: float | None = None) -> DataFrame:
    """``q_id, r_id, km, rank``: the ``k`` nearest index rows of each query, by distance (to 9 decimals) and id. Of a
    stored index only the tiles in reach are read, in each round those of its margin and of the queries still open.

    ``queries`` and ``index`` have ``id, latitude, longitude``. An index of fewer rows gives all of them. ``cell_km`` is
    the first margin, by default one that the density of the index suggests. A crowded tile is dealt to many tasks: its
    index points in parts of about ``PART``, each with the tile's queries in parts as large, and the parts' nearest are
    ranked together.
    """
    axes = dict(zip("xyz", _axes("latitude", "longitude"), strict=True))
    stored = isinstance(index, StoredIndex)
    named = lambda df, s: df.select(F.col("id").alias(f"{s}_id"), F.col("latitude").alias(f"{s}_lat"), F.col("longitude").alias(f"{s}_lon"), *[v.alias(c) for c, v in axes.items()])
    here = F.row_number().over(Window.partitionBy("latitude", "longitude").orderBy("id"))
    first = lambda df: df.select("id", "latitude", "longitude").withColumn("__here", here).where(F.col("__here") <= k).drop("__here")
    held = index.points if stored else written(first(index), "index")
    q, r = named(queries, "q"), named(held, "r")
    margin = 2 * math.sin(cell_km / EARTH_RADIUS_KM / 2) if cell_km else index.margin if stored else _spacing(held)
    kinds = {f.name: f.dataType.simpleString() for f in (*q.schema, *r.schema)}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("q_id", "q_lat", "q_lon", "r_id", "r_lat", "r_lon"))
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy("km", "r_id"))
    out = None
    while True:
        margin = min(margin, 2.0)
        if stored:
            r = named(first(index.near(q.select(F.col("q_lat").alias("latitude"), F.col("q_lon").alias("longitude")), margin)), "r")
        edge = TILE * margin
        tile = F.struct(*[F.floor(F.col(c) / edge).cast("int").alias(c) for c in "xyz"])
        spans = [F.sequence(F.floor((F.col(c) - margin) / edge), F.floor((F.col(c) + margin) / edge)) for c in "xyz"]  # noqa: B023
        block = F.flatten(F.flatten(F.transform(spans[0], lambda i: F.transform(spans[1], lambda j: F.transform(spans[2], lambda h: F.struct(i.cast("int").alias("x"), j.cast("int").alias("y"), h.cast("int").alias("z")))))))  # noqa: B023
        asked, held = q.withColumn("tile", tile), r.withColumn("tile", F.explode(block))
        parts = lambda df, s: df.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / PART).alias(f"{s}_parts"))
        parted = parts(asked, "q").join(parts(held, "r"), "tile")
        of = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
        left = asked.join(parted, "tile").withColumn("qp", F.pmod(F.xxhash64("q_id", F.lit(1)), F.col("q_parts"))).withColumn("rp", of("r_parts")).drop("q_parts", "r_parts")
        right = held.join(parted, "tile").withColumn("rp", F.pmod(F.xxhash64("r_id", F.lit(2)), F.col("r_parts"))).withColumn("qp", of("q_parts")).drop("q_parts", "r_parts")
        some = left.groupBy("tile", "qp", "rp").cogroup(right.groupBy("tile", "qp", "rp")).applyInArrow(lambda key, a, b: _nearest(key, a, b, k), schema)
        top = some.withColumn("km", F.round(haversine_km("q_lat", "q_lon", "r_lat", "r_lon"), 9)).withColumn("rank", rank).where(F.col("rank") <= k).select("q_id", "r_id", "km", "rank")
        if margin >= 2.0:  # the margin is the whole sphere
            return top if out is None else out.unionByName(top)
        top = written(top, "near")
        safe = 2 * math.asin(margin / 2) * EARTH_RADIUS_KM * (1 - 1e-9)  # whatever is nearer is in the tile's margin
        done = top.where((F.col("rank") == k) & (F.col("km") <= safe)).select("q_id")
        found = top.join(large(done), "q_id", "left_semi")
        out = found if out is None else out.unionByName(found)
        q = written(q.join(large(done), "q_id", "left_anti"), "open")
        if q.isEmpty():
            return out
        margin *= 3


def _measured(near: DataFrame, queries: DataFrame, index: DataFrame | StoredIndex) -> DataFrame:
    """Neighbours with the index's columns; of a stored index the tiles as far as the farthest neighbour are read."""
    if not isinstance(index, StoredIndex):
        return large(near).join(index, F.col("r_id") == F.col("id"))
    near = written(near, "near")
    far = near.agg(F.max("km")).first()[0] or 0.0
    reach = min(2.0, 2 * math.sin(min(far / EARTH_RADIUS_KM, math.pi) / 2) * (1 + 1e-9) + 1e-9)
    return large(near).join(index.near(queries, reach), F.col("r_id") == F.col("id"))


def context(queries: DataFrame, index: DataFrame | StoredIndex, k: int = NEIGHBOURS, cell_km: float | None = None) -> DataFrame:
    """``k`` neighbours of each query without itself: of ``k + 1`` the first is dropped if it is within ``SELF_KM``, else
    the last. ``q_id, r_id, km, rank`` (from 1)."""
    near = neighbours(queries, index, k + 1, cell_km)
    own = F.max(F.when(F.col("rank") == 1, F.col("km") <= SELF_KM)).over(Window.partitionBy("q_id"))
    rank = F.col("rank") - F.when(F.col("own"), 1).otherwise(0)
    return near.withColumn("own", own).withColumn("rank", rank).where((F.col("rank") >= 1) & (F.col("rank") <= k)).select("q_id", "r_id", "km", "rank")


def idw(queries: DataFrame, index: DataFrame | StoredIndex, k: int = 4, cell_km: float | None = None) -> DataFrame:
    """``q_id, depth, height`` by inverse squared distance (at least 1 m), and ``nearest_km``."""
    w = 1.0 / F.pow(F.greatest("km", F.lit(1e-3)), 2.0)
    near = _measured(context(queries, index, k, cell_km), queries, index)
    return near.groupBy("q_id").agg((F.sum(F.col("depth") * w) / F.sum(w)).alias("depth"), (F.sum(F.col("height") * w) / F.sum(w)).alias("height"), F.min("km").alias("nearest_km"))


def _statistics() -> list[Column]:
    """What the features need of a neighbourhood, over the rows of :func:`_measured`."""
    return [
        F.avg("depth").alias("ctx_mean"), F.stddev_pop("depth").alias("ctx_std"), F.min("depth").alias("ctx_min"), F.max("depth").alias("ctx_max"), F.avg((F.col("depth") > 0).cast("double")).alias("ctx_land"),
        F.min("km").alias("nearest_km"), F.avg("km").alias("span_km"), F.avg(object_sum(MARINE)).alias("ctx_marine"), F.avg(object_sum(COASTAL)).alias("ctx_coastal"), F.avg(object_sum(INLAND)).alias("ctx_inland"),
        F.avg(object_sum(OBJECTS)).alias("ctx_objects"),
    ]


def _around(queries: DataFrame, index: DataFrame | StoredIndex, k: int, cell_km: float | None, *made: Column) -> DataFrame:
    """``made`` of the neighbourhood of each place of the queries, with its ``latitude, longitude``."""
    places = _places(queries)
    near = _measured(context(places, index, k, cell_km), places, index)
    return large(places).join(near.groupBy("q_id").agg(*made), F.col("id") == F.col("q_id")).drop("id", "q_id")


def context_statistics(queries: DataFrame, index: DataFrame | StoredIndex, k: int = NEIGHBOURS, cell_km: float | None = None) -> DataFrame:
    """What the features need of each query's neighbourhood, one row a query."""
    found = _around(queries, index, k, cell_km, *_statistics())
    return queries.select(F.col("id").alias("q_id"), "latitude", "longitude").join(large(found), ["latitude", "longitude"]).drop("latitude", "longitude")


def own_features() -> dict[str, Column]:
    """Features of a point alone, by name."""
    y, x = F.radians("latitude"), F.radians("longitude")
    return {
        "lat_sin": F.sin(y), "lat_cos": F.cos(y), "lon_sin": F.sin(x), "lon_cos": F.cos(x), "abs_lat_norm": F.abs("latitude") / 90.0, "depth_is_missing": F.col("noaa_depth").isNull().cast("double"),
        "is_height_sample": F.coalesce(F.lower("noaa_type") == "height", F.lit(False)).cast("double"), "elevation_is_missing": F.col("elevation").isNull().cast("double"), "osm_marine_infra": F.log1p(object_sum(MARINE)),
        "osm_natural_coastal": F.log1p(object_sum(COASTAL)), "osm_inland_water": F.log1p(object_sum(INLAND)), "osm_industrial_log": F.log1p(F.col("osm_industrial")),
    }


# The features in their order.
FEATURES = (
    "lat_sin", "lat_cos", "lon_sin", "lon_cos", "abs_lat_norm", "depth_signed_log", "depth_is_missing", "is_height_sample", "elevation_signed_log", "elevation_is_missing", "ctx_depth_mean", "ctx_depth_std", "ctx_depth_min",
    "ctx_depth_max", "ctx_depth_range", "ctx_land_fraction", "ctx_sign_agreement", "ctx_distance_km_log", "ctx_gradient", "osm_marine_infra", "ctx_osm_marine_infra", "osm_natural_coastal", "ctx_osm_natural_coastal",
    "osm_inland_water", "ctx_osm_inland_water", "osm_industrial_log", "ctx_osm_total", "ctx_osm_density",
)


def features(points: DataFrame, index: DataFrame | StoredIndex, k: int = NEIGHBOURS, cell_km: float | None = None) -> DataFrame:
    """``id`` and the 28 features as floats, computed in double and without NaN or infinities."""
    return _features(points.join(large(_around(points, index, k, cell_km, *_statistics())), ["latitude", "longitude"]), "id")


def _features(joined: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and the features of points joined with the statistics of their neighbourhood."""
    depth = F.coalesce("noaa_depth", "ctx_mean")
    height = F.coalesce(F.col("elevation"), depth)
    gradient = (F.col("ctx_max") - F.col("ctx_min")) / F.greatest("span_km", F.lit(1e-3))
    made = own_features() | {
        "depth_signed_log": signed_log(depth), "elevation_signed_log": signed_log(height), "ctx_depth_mean": signed_log("ctx_mean"), "ctx_depth_std": F.log1p("ctx_std"), "ctx_depth_min": signed_log("ctx_min"),
        "ctx_depth_max": signed_log("ctx_max"), "ctx_depth_range": F.log1p(F.col("ctx_max") - F.col("ctx_min")), "ctx_land_fraction": F.col("ctx_land"),
        "ctx_sign_agreement": (F.signum(depth) == F.signum("ctx_mean")).cast("double"), "ctx_distance_km_log": F.log1p("nearest_km"), "ctx_gradient": signed_log(gradient), "ctx_osm_marine_infra": F.log1p("ctx_marine"),
        "ctx_osm_natural_coastal": F.log1p("ctx_coastal"), "ctx_osm_inland_water": F.log1p("ctx_inland"), "ctx_osm_total": F.log1p("ctx_objects"),
        "ctx_osm_density": F.log1p(F.col("ctx_objects") / F.greatest("span_km", F.lit(LEAST_SPAN_KM))),
    }
    clean = lambda c: F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(c).cast("float")
    return joined.select(*keys, *[clean(made[n]).alias(n) for n in FEATURES])


def coordinate_features(points: DataFrame, index: DataFrame | StoredIndex, cell_km: float | None = None) -> DataFrame:
    """The features of bare coordinates ``id, latitude, longitude``: measures by inverse distance from four neighbours,
    object counts of the nearest."""
    w = F.when(F.col("rank") <= 4, 1.0 / F.pow(F.greatest("km", F.lit(1e-3)), 2.0))
    measures = [(F.sum(F.col(c) * w) / F.sum(w)).alias(n) for c, n in (("depth", "noaa_depth"), ("height", "elevation"))]
    found = _around(points, index, NEIGHBOURS, cell_km, *_statistics(), *measures, *[F.min_by(c, "rank").alias(c) for c in OBJECTS])
    made = _features(found.withColumn("noaa_type", F.when(F.col("noaa_depth") > 0, "height").otherwise("depth")), "latitude", "longitude")
    return points.select("id", "latitude", "longitude").join(large(made), ["latitude", "longitude"]).drop("latitude", "longitude")

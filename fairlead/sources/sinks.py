"""Routes and points as GeoJSON, CSV and JSON, and prepared splits as Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairlead.functions.geo import finite
from fairlead.functions.zones import CLASSES
from fairlead.operators.tracks import waypoint_table

# The byte-order mark, the columns of a route's file, and the cost from which a cell is land.
BOM = "\ufeff"
ROUTE_HEADER = ("seq", "latitude", "longitude", "class_code", "zone_cost", "cumulative_km", "bearing_deg", "route_id", "algorithm")
LAND_COST = 1e6


def _position(lat, lon) -> Column:
    return F.array(F.round(F.col(lon), 6), F.round(F.col(lat), 6))


def route_geojson(track: DataFrame) -> DataFrame:
    """``route_id, geojson``: a line string and its waypoints; longitude first, 6 decimals, infinite costs null. A route
    is one voyage's points."""
    props = F.struct("seq", "class_code", finite("cost").alias("cost"))
    point = F.struct(F.col("seq"), F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), _position("lat", "lon").alias("coordinates")).alias("geometry"), props.alias("properties")).alias("f"))
    rows = track.groupBy("route_id").agg(F.sort_array(F.collect_list(point)).alias("p"))
    line = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), F.transform("p", lambda x: x.f.geometry.coordinates).alias("coordinates")).alias("geometry"), F.struct(F.size("p").alias("waypoints")).alias("properties"))
    features = F.concat(F.array(F.to_json(line)), F.transform("p", lambda x: F.to_json(x.f)))
    text = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(features, ","), F.lit("]}"))
    return rows.select("route_id", text.alias("geojson"))


def points_geojson(points: DataFrame) -> DataFrame:
    """A feature a row: ``id, feature``, with ``p_<class>`` where there are probabilities (columns
    of that name, or the array ``probabilities``)."""
    named = [f"p_{c.lower()}" for c in CLASSES]
    props = [F.col("class_code")] + (named if set(named) <= set(points.columns) else [F.get("probabilities", i).alias(f"p_{c.lower()}") for i, c in enumerate(CLASSES)] if "probabilities" in points.columns else [])
    geometry = F.struct(F.lit("Point").alias("type"), _position("latitude", "longitude").alias("coordinates"))
    return points.select("id", F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*props).alias("properties"))).alias("feature"))


def _number(c, form: str) -> Column:
    x = F.col(c)
    return F.when(F.abs(x) == float("inf"), F.when(x > 0, "inf").otherwise("-inf")).otherwise(F.format_string(form, x.cast("double")))


def route_csv(table: DataFrame, algorithm: str = "") -> DataFrame:
    """``route_id, seq, line``: the fields of ROUTE_HEADER with fixed decimals; land costs ``inf``. The method's name comes
    from a column ``algorithm``, if there is one."""
    cost = F.when(F.col("cost") >= LAND_COST, "inf").otherwise(_number("cost", "%.3f"))
    method = F.col("algorithm") if "algorithm" in table.columns else F.lit(algorithm)
    fields = [F.format_string("%d", F.col("seq")), _number("lat", "%.6f"), _number("lon", "%.6f"), F.col("class_code"), cost, _number("total_km", "%.2f"), _number("bearing", "%.1f"), F.col("route_id").cast("string"), method]
    return table.select("route_id", "seq", F.concat_ws(",", *[F.coalesce(f, F.lit("")) for f in fields]).alias("line"))


def write_route_csv(lines: DataFrame, path: str) -> None:
    """A CSV file a route under ``path/route_id=...``, in order, each with a byte-order mark and the header. Routes are
    spread over tasks and a route is one file, as long as a voyage."""
    header = F.lit(BOM + ",".join(ROUTE_HEADER))
    heads = lines.select("route_id").distinct().select("route_id", F.lit(-1).cast("long").alias("seq"), header.alias("line"))
    every = lines.select("route_id", F.col("seq").cast("long").alias("seq"), "line").unionByName(heads)
    every.repartition("route_id").sortWithinPartitions("route_id", "seq").select("route_id", "line").write.partitionBy("route_id").text(path)


def points_csv(points: DataFrame) -> DataFrame:
    return points.select("id", F.concat_ws(",", _number("latitude", "%.6f"), _number("longitude", "%.6f"), F.col("class_code")).alias("line"))


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """Text files, one for each task."""
    df.select(column).write.text(path)


def write_splits(df: DataFrame, path: str) -> None:
    df.write.partitionBy("split").parquet(path)


def coordinate_tag(lat, lon) -> Column:
    """Such as ``54.30N_010.10E``."""
    a, b = F.col(lat), F.col(lon)
    return F.concat(F.format_string("%05.2f", F.abs(a)), F.when(a < 0, "S").otherwise("N"), F.lit("_"), F.format_string("%06.2f", F.abs(b)), F.when(b < 0, "W").otherwise("E"))


def result_name(method, status) -> Column:
    """File name of a result of ``lat1, lon1, lat2, lon2``."""
    return F.concat_ws("__", coordinate_tag("lat1", "lon1"), coordinate_tag("lat2", "lon2"), F.col(method), F.col(status))


def result_document(plan: DataFrame) -> DataFrame:
    """``name, document``: every column as JSON, doubles that aren't finite null."""
    kinds = dict(plan.dtypes)
    fields = [finite(c).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in plan.columns]
    return plan.select(result_name("method", "status").alias("name"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("document"))


def comparison_document(compared: DataFrame, voyages: DataFrame, seconds: float) -> DataFrame:
    """``name, document`` of a comparison of methods: a file for each voyage (``voyage_id, lat1, lon1, lat2, lon2``) with
    the results of all methods (``voyage_id, method, ...``) in one list."""
    fields = [c for c in compared.columns if c != "voyage_id"]
    kinds = dict(compared.dtypes)
    clean = F.struct(*[(finite(c) if kinds[c] in ("double", "float") else F.col(c)).alias(c) for c in fields])
    listed = compared.groupBy("voyage_id").agg(F.sort_array(F.collect_list(F.struct("method", clean.alias("r")))).alias("l"), F.count(F.lit(1)).alias("n"))  # a row a method
    both = voyages.join(listed, "voyage_id")
    name = F.concat(F.lit("compare_"), coordinate_tag("lat1", "lon1"), F.lit("_"), coordinate_tag("lat2", "lon2"), F.lit("_"), F.col("n").cast("string"), F.lit(f"-methods_{seconds:.2f}s"))
    document = F.to_json(F.struct(F.array("lat1", "lon1").alias("start"), F.array("lat2", "lon2").alias("end"), F.transform("l", lambda x: x.r).alias("results"), F.lit(round(seconds, 3)).alias("total_seconds")), {"ignoreNullFields": "false"})
    return both.select("voyage_id", name.alias("name"), document.alias("document"))


def unique_names(named: DataFrame, key: str, taken: DataFrame | None = None) -> DataFrame:
    """``named`` whose equal ``name``s get ``-2``, ``-3`` and so on, in order of ``key``; names of ``taken`` count first."""
    w = Window.partitionBy("name").orderBy(key)
    at = F.row_number().over(w)
    if taken is not None:
        base = F.regexp_replace("name", r"-\d+$", "")
        have = taken.select(base.alias("__name")).groupBy("__name").agg(F.count(F.lit(1)).alias("__have"))
        named = named.join(have, F.col("name") == F.col("__name"), "left").drop("__name")
        at = at + F.coalesce("__have", F.lit(0))
    numbered = named.withColumn("__at", at)
    return numbered.withColumn("name", F.when(F.col("__at") > 1, F.concat_ws("-", "name", "__at")).otherwise(F.col("name"))).drop("__at", "__have")


def export_all(track: DataFrame, path: str, points: DataFrame | None = None, algorithm: str = "") -> dict[str, str]:
    """Writes routes as GeoJSON and CSV, and classified points as both, each in a folder of ``path``; returns the folders.

    ``track``: ``route_id, seq, lat, lon, class_code, cost``. A line of a GeoJSON file is a route's document.
    """
    folders = {"geojson": f"{path}/geojson", "csv": f"{path}/csv"}
    write_lines(route_geojson(track), "geojson", folders["geojson"])
    write_route_csv(route_csv(waypoint_table(track), algorithm), folders["csv"])
    if points is not None:
        folders |= {"points_geojson": f"{path}/points_geojson", "points_csv": f"{path}/points_csv"}
        write_lines(points_geojson(points), "feature", folders["points_geojson"])
        write_lines(points_csv(points), "line", folders["points_csv"])
    return folders


def read_results(spark, path: str) -> DataFrame:
    """Results newest first; names other than of letters, digits and ``_ . -`` are refused."""
    found = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("document"))
    return found.where(F.col("name").rlike(r"^[\w.\-]+$")).orderBy(F.col("modified").desc(), "name")

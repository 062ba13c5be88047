"""The result store: tables of sessions, points, routes, waypoints and model runs, and the queries over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.functions.zones import CLASSES, WEIGHTS, zone_title

# Tables and their columns.
TABLES = {
    "session": "session_id long, name string, source string, created timestamp",
    "point": "point_id long, session_id long, latitude double, longitude double, elevation double, noaa_depth double, class_code string, confidence double",
    "zone": "class_code string, title string, weight double",
    "route": "route_id long, session_id long, algorithm string, status string, feasible boolean, total_cost double, distance_km double, created timestamp",
    "waypoint": "route_id long, seq int, lat double, lon double, class_code string, cost double",
    "model_run": "run_id long, created timestamp, metrics string",
}


def zones(spark: SparkSession) -> DataFrame:
    """The dimension; infinite weights are stored as -1."""
    rows = [(c, -1.0 if WEIGHTS[c] == float("inf") else WEIGHTS[c]) for c in CLASSES]
    return spark.createDataFrame(rows, "class_code string, weight double").select("class_code", zone_title("class_code").alias("title"), "weight")


def create(spark: SparkSession, database: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")
    zones(spark).write.mode("overwrite").insertInto(f"{database}.zone", overwrite=True)


def append(df: DataFrame, database: str, table: str) -> None:
    """Columns by name; those that are missing are null, and new ones are refused."""
    spark = df.sparkSession
    target = spark.table(f"{database}.{table}")
    if extra := set(df.columns) - set(target.columns):
        raise ValueError(f"unknown columns: {sorted(extra)}")
    df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in target.schema]).write.insertInto(f"{database}.{table}")


def violations(routes: DataFrame, waypoints: DataFrame, zone: DataFrame) -> DataFrame:
    """``rule, n``: what constraints would refuse: repeated routes or positions, waypoints without a route or zone."""
    repeated = lambda d, *k: d.groupBy(*k).count().where("count > 1").agg(F.count(F.lit(1)).alias("n"))
    orphan = waypoints.join(routes.select("route_id"), "route_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    unzoned = waypoints.join(F.broadcast(zone), "class_code", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    parts = {"route_id unique": repeated(routes, "route_id"), "seq unique": repeated(waypoints, "route_id", "seq"), "waypoint has route": orphan, "waypoint has zone": unzoned}
    out = None
    for rule, d in parts.items():
        d = d.select(F.lit(rule).alias("rule"), "n")
        out = d if out is None else out.unionByName(d)
    return out


def route_summary(routes: DataFrame, waypoints: DataFrame) -> DataFrame:
    """Routes with their number of waypoints; a missing status follows from feasibility. Waypoints are counted before
    they meet routes."""
    counts = waypoints.groupBy("route_id").agg(F.count(F.lit(1)).alias("k"))
    status = F.coalesce("status", F.when(F.col("feasible"), "found").otherwise("no_path"))
    return routes.join(counts, "route_id", "left").select("route_id", "algorithm", status.alias("status"), "total_cost", "distance_km", "created", F.coalesce("k", F.lit(0).cast("long")).alias("n_waypoints"))


def latest(summary: DataFrame, n: int = 20) -> DataFrame:
    return summary.orderBy(F.col("created").desc(), F.col("route_id").desc()).limit(n)


def class_histogram(waypoints: DataFrame, routes: DataFrame | None = None, session: int | None = None) -> DataFrame:
    rows = waypoints if session is None else waypoints.join(routes.where(F.col("session_id") == session).select("route_id"), "route_id", "left_semi")
    return rows.groupBy("class_code").agg(F.count(F.lit(1)).alias("n"))


def algorithm_statistics(routes: DataFrame) -> DataFrame:
    return routes.groupBy("algorithm").agg(F.count(F.lit(1)).alias("n"), F.avg("total_cost").alias("mean_cost"), F.avg("distance_km").alias("mean_km"), F.avg(F.col("feasible").cast("double")).alias("feasible_share"))


def counts(**tables: DataFrame) -> DataFrame:
    """``name, n`` of each table."""
    out = None
    for name, d in tables.items():
        one = d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def with_zone(waypoints: DataFrame, zone: DataFrame) -> DataFrame:
    return waypoints.join(F.broadcast(zone), "class_code", "left")


def route(routes: DataFrame, waypoints: DataFrame, route_id: int) -> DataFrame:
    """One route with its waypoints as an ordered array."""
    w = waypoints.where(F.col("route_id") == route_id).agg(F.sort_array(F.collect_list(F.struct("seq", "class_code", "cost"))).alias("waypoints"))
    return routes.where(F.col("route_id") == route_id).crossJoin(F.broadcast(w))


def without_route(routes: DataFrame, waypoints: DataFrame, route_id: int) -> tuple[DataFrame, DataFrame]:
    """Both tables after a delete, waypoints included."""
    return routes.where(F.col("route_id") != route_id), waypoints.where(F.col("route_id") != route_id)

"""Deterministic projections of the generated star schema onto points, labels, tracks, lattices and a route store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.functions.zones import CLASSES, OBJECTS


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions, second positions, measures, labels, predictions and object counts of every event."""
    e = F.col("event_id")
    depth = (e * 6101) % 13000 / 10.0 - 900
    label = F.get(F.array(*map(F.lit, CLASSES)), (e % 4).cast("int"))
    other = F.get(F.array(*map(F.lit, CLASSES)), ((e * 17 + 3) % 4).cast("int"))
    return events(spark, sf_dir).select(
        e.alias("id"), "user_id", "ts",
        ((e * 7919) % 13000 / 100.0 - 60).alias("latitude"), ((e * 104729) % 36000 / 100.0 - 180).alias("longitude"),
        ((e * 6101) % 13000 / 100.0 - 60).alias("lat2"), ((e * 3571) % 36000 / 100.0 - 180).alias("lon2"),
        depth.alias("noaa_depth"), F.when(e % 23 != 0, depth + (e * 31) % 41 - 20).alias("elevation"),
        F.when(e % 3 == 0, "height").otherwise("depth").alias("noaa_type"),
        label.alias("class_code"), F.when(e % 10 == 0, other).otherwise(label).alias("predicted"),
        (((e * 37) % 1000) / 1000.0).alias("score"),
        *[((e * 31 + j * 17) % 7 % 3).cast("double").alias(c) for j, c in enumerate(OBJECTS)],
    )


#: The same as SQL, to open an oracle with.
POINTS_SQL = """p AS (SELECT event_id AS id, user_id, ts, ((event_id*7919)%13000)/100.0-60 AS latitude, ((event_id*104729)%36000)/100.0-180 AS longitude,
 ((event_id*6101)%13000)/100.0-60 AS lat2, ((event_id*3571)%36000)/100.0-180 AS lon2, ((event_id*6101)%13000)/10.0-900 AS noaa_depth,
 CASE WHEN event_id%23<>0 THEN ((event_id*6101)%13000)/10.0-900+((event_id*31)%41)-20 END AS elevation, CASE WHEN event_id%3=0 THEN 'height' ELSE 'depth' END AS noaa_type,
 ['OPEN_SEA','COASTAL_SEA','NEAR_COAST','COASTLINE'][event_id%4+1] AS class_code,
 CASE WHEN event_id%10=0 THEN ['OPEN_SEA','COASTAL_SEA','NEAR_COAST','COASTLINE'][(event_id*17+3)%4+1] ELSE ['OPEN_SEA','COASTAL_SEA','NEAR_COAST','COASTLINE'][event_id%4+1] END AS predicted,
 ((event_id*37)%1000)/1000.0 AS score, """ + ", ".join(f"CAST(((event_id*31+{j * 17})%7)%3 AS DOUBLE) AS {c}" for j, c in enumerate(OBJECTS)) + " FROM events)"

#: Events to a lattice; its rows, columns and resolution in degrees; cells to a degree of the land mask.
GROUP, ROWS, COLS, RESOLUTION, PER_DEGREE = 250, 24, 32, 0.25, 8


def lattices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lattice_id, number, south, west, resolution, n_rows, n_cols``: one for every 250 events, around the first."""
    p = points(spark, sf_dir).select(F.floor(F.col("id") / GROUP).alias("number"), "id", "latitude", "longitude")
    first = p.groupBy("number").agg(F.min_by("latitude", "id").alias("lat"), F.min_by("longitude", "id").alias("lon"))
    west = F.least(F.floor("lon"), F.lit(171)).cast("double")
    return first.select(F.concat(F.lit("L"), "number").alias("lattice_id"), "number", F.floor("lat").cast("double").alias("south"), west.alias("west"), F.lit(RESOLUTION).alias("resolution"), F.lit(ROWS).alias("n_rows"), F.lit(COLS).alias("n_cols"))


def soundings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lattice_id, row, col, class_index, score, land`` of every event: a point of its group's lattice."""
    row, col = F.round((F.col("latitude") + 60) * 100).cast("long") % ROWS, F.round((F.col("longitude") + 180) * 100).cast("long") % COLS
    code = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("class_code")) - 1
    land = (F.col("noaa_type") == "height") & (F.col("noaa_depth") > 0)
    return points(spark, sf_dir).select(F.concat(F.lit("L"), F.floor(F.col("id") / GROUP)).alias("lattice_id"), row.cast("int").alias("row"), col.cast("int").alias("col"), code.cast("int").alias("class_index"), "score", land.alias("land"))


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lattice_id, row, col, class_index, confidence`` of the cells that events fall into: the highest class wins."""
    return soundings(spark, sf_dir).groupBy("lattice_id", "row", "col").agg(F.max("class_index").alias("class_index"), F.max("score").alias("confidence"))


def land_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lat, lon`` of the measured heights above zero."""
    at = soundings(spark, sf_dir).where("land").join(lattices(spark, sf_dir), "lattice_id")
    return at.select((F.col("south") + F.col("row") * RESOLUTION).alias("lat"), (F.col("west") + F.col("col") * RESOLUTION).alias("lon"))


def ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The voyages by coordinates: ``voyage_id, lattice_id, start_lat, start_lon, goal_lat, goal_lon``."""
    at = voyages(spark, sf_dir).join(lattices(spark, sf_dir), "lattice_id")
    place = [(F.col(low) + F.col(f"{e}_{i}") * RESOLUTION).alias(f"{e}_{x}") for e in ("start", "goal") for x, low, i in (("lat", "south", "row"), ("lon", "west", "col"))]
    return at.select("voyage_id", "lattice_id", *place)


def zone_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``y, x, class_index, confidence`` of quarter degrees of the globe that events fall into, wherever a lattice lies."""
    at = soundings(spark, sf_dir).join(lattices(spark, sf_dir).select("lattice_id", "south", "west"), "lattice_id")
    y, x = (F.rint((F.col(low) + F.col(i) * RESOLUTION) / RESOLUTION).cast("int") for low, i in (("south", "row"), ("west", "col")))
    return at.groupBy(y.alias("y"), x.alias("x")).agg(F.max("class_index").alias("class_index"), F.max("score").alias("confidence"))


def voyages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A voyage for each supplier: ``voyage_id, lattice_id, start_row, start_col, goal_row, goal_col``."""
    n = lattices(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    k = F.col("s_suppkey")
    place = lambda x, most: (x % most).cast("int")
    return s.join(F.broadcast(n)).select(k.alias("voyage_id"), F.concat(F.lit("L"), k % F.col("n")).alias("lattice_id"), place(k * 7, ROWS).alias("start_row"), place(F.col("s_nationkey"), 4).alias("start_col"), place(k * 11 + 5, ROWS).alias("goal_row"), (COLS - 1 - place(k, 4)).alias("goal_col"))


#: Lattices ``l``, land cells of the mask ``lm`` and voyages ``t``, as SQL that follows POINTS_SQL.
LATTICES_SQL = f"""l AS MATERIALIZED (SELECT 'L' || (id//{GROUP}) AS lattice_id, floor(arg_min(latitude, id))::DOUBLE AS south, least(floor(arg_min(longitude, id)), 171)::DOUBLE AS west FROM p GROUP BY 1),
so AS (SELECT 'L' || (id//{GROUP}) AS lattice_id, CAST(round((latitude+60)*100) AS BIGINT)%{ROWS} AS row, CAST(round((longitude+180)*100) AS BIGINT)%{COLS} AS col, id%4 AS class_index, score, noaa_type='height' AND noaa_depth>0 AS land FROM p),
lm AS MATERIALIZED (SELECT DISTINCT CAST((south+row*{RESOLUTION}+90)*{PER_DEGREE} AS BIGINT) AS y, CAST((west+col*{RESOLUTION}+180)*{PER_DEGREE} AS BIGINT)%(360*{PER_DEGREE}) AS x FROM so JOIN l USING (lattice_id) WHERE land),
t AS MATERIALIZED (SELECT s_suppkey AS voyage_id, 'L' || (s_suppkey%(SELECT count(*) FROM l)) AS lattice_id, (s_suppkey*7)%{ROWS} AS r0, s_nationkey%4 AS c0, (s_suppkey*11+5)%{ROWS} AS r1, {COLS - 1}-s_suppkey%4 AS c1 FROM supplier)"""


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(
        F.col("o_orderkey").alias("route_id"), F.col("o_custkey").alias("session_id"), F.get(F.array(*map(F.lit, ("astar", "dijkstra", "dynamic_programming", "genetic"))), (F.col("o_orderkey") % 4).cast("int")).alias("algorithm"),
        F.when(F.col("o_orderkey") % 7 != 0, F.when(F.col("o_orderkey") % 5 == 0, "no_path").otherwise("found")).alias("status"), (F.col("o_orderkey") % 5 != 0).alias("feasible"),
        F.col("o_totalprice").alias("total_cost"), (F.col("o_totalprice") / 1.5).alias("distance_km"), F.col("o_orderdate").alias("created"),
    )


def waypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select(F.col("l_orderkey").alias("route_id"), F.row_number().over(w).alias("seq"), F.get(F.array(*map(F.lit, CLASSES)), (F.col("l_partkey") % 4).cast("int")).alias("class_code"), F.col("l_extendedprice").alias("cost"))


ROUTES_SQL = """r AS (SELECT o_orderkey AS route_id, o_custkey AS session_id, ['astar','dijkstra','dynamic_programming','genetic'][o_orderkey%4+1] AS algorithm,
 CASE WHEN o_orderkey%7<>0 THEN CASE WHEN o_orderkey%5=0 THEN 'no_path' ELSE 'found' END END AS status, o_orderkey%5<>0 AS feasible,
 o_totalprice AS total_cost, o_totalprice/1.5 AS distance_km, o_orderdate AS created FROM orders),
wp AS (SELECT l_orderkey AS route_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS seq,
 ['OPEN_SEA','COASTAL_SEA','NEAR_COAST','COASTLINE'][l_partkey%4+1] AS class_code, l_extendedprice AS cost FROM lineitem)"""

"""An extension: the stateless steps of the ingest (validate, region, conflict flag) over a stream of points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.functions.zones import any_conflict, region
from fairlead.sources.points import normalise, validate


def checked(points: DataFrame) -> DataFrame:
    """Batch or stream: valid points with ``region`` and ``conflict``."""
    valid = validate(normalise(points))
    return valid.withColumn("region", region("latitude", "longitude")).withColumn("conflict", any_conflict("class_code", tuple(c for c in ("noaa_depth", "elevation") if c in valid.columns)))


def region_counts(points: DataFrame, time: str = "ts", late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Points and conflicts by region and time window; later rows than ``late`` are left out."""
    return checked(points).withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "region").agg(F.count(F.lit(1)).alias("n"), F.count_if("conflict").alias("conflicts")).select("w.start", "region", "n", "conflicts")


def read_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)

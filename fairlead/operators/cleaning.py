"""Labels that contradict measures, and statistics of a labelled point table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.functions.zones import CLASSES, TOLERANCE_M, any_conflict, conflict, region

# Tolerances of the sensitivity report, in metres.
SENSITIVITY_M = (0.0, 2.0, 5.0, 10.0, 20.0)


def known_classes(df: DataFrame) -> DataFrame:
    return df.where(F.col("class_code").isin(*CLASSES))


def with_region(df: DataFrame) -> DataFrame:
    return df.withColumn("region", region("latitude", "longitude"))


def _measures(df: DataFrame) -> tuple[str, ...]:
    return tuple(m for m in ("noaa_depth", "elevation") if m in df.columns)


def without_conflicts(df: DataFrame, tolerance: float = TOLERANCE_M) -> DataFrame:
    return df.where(~any_conflict("class_code", _measures(df), tolerance))


def conflict_report(df: DataFrame, tolerance: float = TOLERANCE_M) -> DataFrame:
    """``dimension, value, n_total, n_removed``: overall, by class, by region and by measure, in one pass."""
    flagged = with_region(df).withColumn("bad", any_conflict("class_code", _measures(df), tolerance))
    kinds = [("all", F.lit("all"), F.col("bad")), ("class", F.col("class_code"), F.col("bad")), ("region", F.col("region"), F.col("bad"))]
    kinds += [("measure", F.lit(m), conflict("class_code", m, tolerance)) for m in _measures(df)]
    rows = flagged.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), v.alias("value"), b.alias("bad")) for d, v, b in kinds])).alias("x"))
    return rows.groupBy("x.dimension", "x.value").agg(F.count(F.lit(1)).alias("n_total"), F.count_if("x.bad").alias("n_removed"))


def conflict_sensitivity(df: DataFrame, tolerances: tuple[float, ...] = SENSITIVITY_M) -> DataFrame:
    """``tolerance_m, n_removed``, in one aggregate."""
    one = df.agg(*[F.count_if(any_conflict("class_code", _measures(df), t)).alias(f"t{i}") for i, t in enumerate(tolerances)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(t).alias("tolerance_m"), F.col(f"t{i}").alias("n_removed")) for i, t in enumerate(tolerances)])).alias("x")).select("x.*")

"""Tables in the folder that driver and executors share: they cut lineage and outlive executors."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder, as in tests; a cluster needs one of its own.
LOCAL_SHARED = "/tmp/checkpoints/fairlead"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (found or LOCAL_SHARED).rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it comes in fewer partitions, as a single small file does; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def large(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is sorted and merged, whatever size Spark expects. Rows that ``explode`` makes count
    as one to it, and numbers of cells take few bytes of Parquet, so it would broadcast millions of them by the driver."""
    return df.hint("merge")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by ``keys`` in one partition more than a shuffle has. Spark puts small partitions together, and so a table of
    few rows, each of which becomes thousands, would be left to one task. With the same number it takes this for what a
    join or a window before has done, and drops it."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1, *keys)


def spread_work(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by ``keys`` in several partitions for each core, however few its bytes: a search takes long for a row, and some
    take longer than others. A number that is given stays, where Spark would put small partitions together."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


#: Folders written to the shared folder in this process and not released yet.
_written: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    _written.append(f"{shared_dir(spark)}/fairlead/{name}-{uuid.uuid4().hex}")
    return _written[-1]


def written(df: DataFrame, name: str = "state") -> DataFrame:
    """``df`` from a table in the shared folder. Runs at once: what calls this does its work when the query is built. What
    is written stays until :func:`release`."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> int:
    """Remove the folders that operators have written (from the ``since``-th on), but those that ``keep`` reads; returns
    how many are left. Results that were not written elsewhere can't be read any more."""
    kept = keep.inputFiles() if keep is not None else []
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in _written[since:]:
        if not any(path.split("://")[-1] in f for f in kept):
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)
            _written.remove(path)
    return len(_written)


def released(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """``query``, which then removes what it wrote to the shared folder on the way, but for what its result reads."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        before = release(spark, since=sys.maxsize)
        found = query(spark, sf_dir)
        release(spark, since=before, keep=found)
        return found

    return run


#: Keys that may be broadcast: any number that holds at least this part of all rows each, so no more than this.
HEAVY = 10_000


def look_up(rows: DataFrame, keyed: DataFrame, key: str, n: str, keep: bool = False, counted: bool = True) -> DataFrame:
    """``rows`` with the columns of ``keyed``, which has a row for each ``key`` (null is a key) and the number ``n`` of
    rows with it; ``keep`` keeps that column. Keys not in ``keyed`` get nulls.

    Up to ``HEAVY`` keys are broadcast. Of more, those that hold a ``HEAVY``-th of all rows or more are, so a shuffle
    never meets a hot key. Without ``counted`` the numbers aren't known: then rows are counted by key for that. ``keyed``
    should be written; ``rows`` are read again where not all keys are broadcast.
    """
    size = keyed.agg(F.count(F.lit(1)).alias("keys"), F.sum(n).alias("rows")).first()  # two numbers
    more = [c for c in keyed.columns if c != key and (keep or c != n)]

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right.withColumnRenamed(key, "__key"), F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")

    if size.keys <= HEAVY:
        return joined(rows, F.broadcast(keyed.select(key, *more)))
    total = size.rows
    if not counted:
        counts = written(rows.groupBy(F.col(key).alias("__c")).agg(F.count(F.lit(1)).alias("__n")), "counts")
        total = counts.agg(F.sum("__n")).first()[0] or 0
        frequent = F.broadcast(counts.where(F.col("__n") * HEAVY >= total))
        keyed = written(keyed.drop(n).join(frequent, F.col(key).eqNullSafe(F.col("__c")), "left").withColumn(n, F.coalesce("__n", F.lit(0))).drop("__c", "__n"), "keyed")
    hot = F.col(n) * HEAVY >= total
    first = joined(rows, F.broadcast(keyed.where(hot).select(key, *more, F.lit(True).alias("__hot"))))
    others = joined(first.where(F.col("__hot").isNull()).select(*rows.columns), keyed.where(~hot).select(key, *more))
    return first.where("__hot").drop("__hot").unionByName(others)

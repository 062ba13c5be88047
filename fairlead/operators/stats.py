"""Statistics of point tables, and metrics of classifications against labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairlead.functions.zones import CLASSES, WATER, class_index
from fairlead.operators.cleaning import with_region
from fairlead.operators.shared import written


def _classes(spark) -> DataFrame:
    return spark.createDataFrame([(c,) for c in CLASSES], "class_code string")


def class_distribution(df: DataFrame) -> DataFrame:
    """``class_code, n, share`` (6 decimals) of the known classes; those that don't occur have zero."""
    counts = df.groupBy("class_code").agg(F.count(F.lit(1)).alias("k"))
    full = F.broadcast(_classes(df.sparkSession)).join(counts, "class_code", "left").withColumn("n", F.coalesce("k", F.lit(0).cast("long")))
    total = full.agg(F.sum("n").alias("total"))  # one row
    return full.crossJoin(F.broadcast(total)).select("class_code", "n", F.when(F.col("total") > 0, F.round(F.col("n") / F.col("total"), 6)).otherwise(F.lit(0.0)).alias("share"))


def percentiles(df: DataFrame, by: str, measure: str, shares: Sequence[float]) -> DataFrame:
    """``by, p`` (array): exact percentiles of a measure, linear between neighbouring ranks; null and NaN don't count.

    Rows are first counted by value, and values are dealt by ranges, whose running counts give every value its ranks; so
    a group of any number of rows and values is spread over the tasks.
    """
    known = df.where(F.col(measure).isNotNull() & ~F.isnan(F.col(measure).cast("double")))
    values = known.groupBy(F.col(by).alias("g"), F.col(measure).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    dealt = written(values.repartitionByRange("g", "v").withColumn("r", F.spark_partition_id()), "values")
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("r", "g").agg(F.sum("n").alias("n"))
    starts = sums.select(F.col("r").alias("r_"), F.col("g").alias("g_"), F.coalesce(F.sum("n").over(upto(Window.partitionBy("g").orderBy("r"))), F.lit(0)).alias("before"))
    inner = F.coalesce(F.sum("n").over(upto(Window.partitionBy("r", "g").orderBy("v"))), F.lit(0))
    placed = dealt.withColumn("inner", inner).join(starts, (F.col("r") == F.col("r_")) & F.col("g").eqNullSafe(F.col("g_"))).select("g", "v", (F.col("before") + F.col("inner")).alias("first"), "n")
    totals = sums.groupBy(F.col("g").alias("h")).agg(F.sum("n").alias("total"))
    wanted = totals.select("h", F.posexplode(F.transform(F.array(*map(F.lit, shares)), lambda q: q * (F.col("total") - 1))).alias("k", "at"))
    ranked = placed.join(wanted, F.col("g").eqNullSafe(F.col("h")))
    holds = lambda rank: (F.col("first") <= rank) & (rank < F.col("first") + F.col("n"))
    low, high = F.floor("at"), F.ceil("at")
    found = ranked.where(holds(low) | holds(high)).groupBy("h", "k").agg(F.max(F.when(holds(low), F.col("v"))).alias("low"), F.max(F.when(holds(high), F.col("v"))).alias("high"), F.first("at").alias("at"))
    value = F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.floor("at"))
    return found.groupBy(F.col("h").alias(by)).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", value.alias("p")))), lambda x: x.p).alias("p"))


def depth_by_class(df: DataFrame, measure: str = "noaa_depth") -> DataFrame:
    """Count, mean, sample deviation and the 5th, 50th and 95th percentile (exact, linear) of a measure by class."""
    known = df.where(F.col(measure).isNotNull())
    sums = known.groupBy("class_code").agg(F.count(F.lit(1)).alias("n"), F.avg(measure).alias("mean"), F.stddev_samp(measure).alias("std"))
    p = percentiles(known, "class_code", measure, (0.05, 0.5, 0.95)).withColumnRenamed("class_code", "c")
    both = sums.join(p, F.col("class_code").eqNullSafe(F.col("c")), "left")
    return both.select("class_code", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std")], *[F.round(F.get("p", i), 6).alias(a) for i, a in enumerate(("p05", "p50", "p95"))])


def overview(df: DataFrame, session: str = "user_id") -> DataFrame:
    """Rows, bounds, missing measures and distinct sessions."""
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.min("latitude").alias("south"), F.max("latitude").alias("north"), F.min("longitude").alias("west"), F.max("longitude").alias("east"),
        F.count_if(F.col("noaa_depth").isNull()).alias("no_depth"), F.count_if(F.col("elevation").isNull()).alias("no_elevation"), F.count_distinct(session).alias("sessions"),
    )


def region_class_pivot(df: DataFrame) -> DataFrame:
    """``region, total`` and a count for each class."""
    return with_region(df).groupBy("region").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("class_code") == c).alias(c.lower()) for c in CLASSES])


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def confusion(df: DataFrame, truth: str = "class_code", predicted: str = "predicted") -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def per_class(df: DataFrame, truth: str = "class_code", predicted: str = "predicted") -> DataFrame:
    """``class_code, support, precision, recall, f1`` from the confusion counts (0 where undefined)."""
    cells = confusion(df, truth, predicted)
    zero, n = F.lit(0).cast("long"), F.col("n")
    hit = F.when(F.col("truth") == F.col("predicted"), n).otherwise(zero)
    side = lambda c, t, p, h: F.struct(F.col(c).alias("c"), t.alias("t"), p.alias("p"), h.alias("hit"))
    sides = F.explode(F.array(side("truth", n, zero, zero), side("predicted", zero, n, hit)))
    sums = cells.select(sides.alias("s")).groupBy("s.c").agg(F.sum("s.t").alias("t"), F.sum("s.p").alias("p"), F.sum("s.hit").alias("hit"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    pr, rc = ratio(F.col("hit"), F.col("p")), ratio(F.col("hit"), F.col("t"))
    return sums.select(F.col("c").alias("class_code"), F.col("t").alias("support"), F.col("p").alias("assigned"), F.col("hit"), pr.alias("precision"), rc.alias("recall"), ratio(2 * pr * rc, pr + rc).alias("f1"))


def summary(df: DataFrame, truth: str = "class_code", predicted: str = "predicted") -> DataFrame:
    """``n, accuracy, macro_f1, weighted_f1, kappa``."""
    by = per_class(df, truth, predicted)
    totals = by.agg(F.sum("support").alias("n"), F.sum("hit").alias("hits"), F.avg("f1").alias("macro_f1"), F.sum(F.col("f1") * F.col("support")).alias("wf"), F.sum(F.col("support") * F.col("assigned").cast("double")).alias("chance"))
    po, pe = F.col("hits") / F.col("n"), F.col("chance") / F.col("n") / F.col("n")
    return totals.select("n", po.alias("accuracy"), "macro_f1", (F.col("wf") / F.col("n")).alias("weighted_f1"), F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(F.lit(1.0)).alias("kappa"))


def roc_auc(df: DataFrame, positive, score: str) -> DataFrame:
    """One row ``n_pos, n_neg, auc``: the rank-sum statistic over distinct scores, ties counted half.

    Rows are first counted by score, so a frequent score is one row. Scores are dealt by ranges of their own, whatever
    their scale, and running sums of the ranges come before those within each.
    """
    by_score = written(df.groupBy(F.col(score).alias("s")).agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")).where(F.col("s").isNotNull()).repartitionByRange("s").withColumn("r", F.spark_partition_id()), "scores")
    before = by_score.groupBy("r").agg(F.sum("neg").alias("neg_r"))
    w = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = before.select("r", F.coalesce(F.sum("neg_r").over(w), F.lit(0)).alias("offset"))
    inner = Window.partitionBy("r").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    below = by_score.withColumn("below", F.coalesce(F.sum("neg").over(inner), F.lit(0))).join(F.broadcast(offsets), "r")
    u = F.sum(F.col("pos") * (F.col("below") + F.col("offset") + F.col("neg") / 2.0))
    return below.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), u.alias("u")).select("n_pos", "n_neg", (F.col("u") / F.col("n_pos") / F.col("n_neg")).alias("auc"))


def by_region(df: DataFrame, truth: str = "class_code", predicted: str = "predicted") -> DataFrame:
    """``region, n, accuracy, water_as_land, land_as_water``."""
    t, p = F.col(truth), F.col(predicted)
    return with_region(df).groupBy("region").agg(
        F.count(F.lit(1)).alias("n"), F.avg((t == p).cast("double")).alias("accuracy"), F.count_if(t.isin(*WATER) & ~p.isin(*WATER)).alias("water_as_land"), F.count_if(~t.isin(*WATER) & p.isin(*WATER)).alias("land_as_water")
    )


def class_weights(df: DataFrame, truth: str = "class_code") -> DataFrame:
    """Inverse frequencies with mean 1."""
    counts = df.groupBy(F.col(truth).alias("class_code")).agg(F.count(F.lit(1)).alias("n"))
    mean = counts.agg(F.avg(1.0 / F.col("n")).alias("m"))  # one row
    return counts.crossJoin(F.broadcast(mean)).select("class_code", "n", (1.0 / F.col("n") / F.col("m")).alias("weight"))


def label_agreement(df: DataFrame, truth: str = "class_code", predicted: str = "predicted") -> DataFrame:
    """Share of known labels that the prediction equals, to 4 decimals."""
    return df.where(class_index(truth).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col(truth) == F.col(predicted)).cast("double")), 4).alias("agreement"))


def stratified_split(df: DataFrame, key: str, stratum: str = "class_code", seed: int = 42, test: float = 0.15, validation: float = 0.15) -> DataFrame:
    """Adds ``split``: rows of each stratum in the order of a seeded hash, by share. Ranks are counted within buckets of
    the hash and bucket counts are added up, so no stratum goes to one task."""
    h = F.xxhash64(F.lit(seed), F.col(key))
    hashed = df.withColumn("__h", h).withColumn("__b", F.pmod(F.shiftright(h, 54), F.lit(1024)))
    sizes = hashed.groupBy(stratum, "__b").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(stratum)
    offsets = sizes.select(F.col(stratum).alias("__s"), F.col("__b").alias("__bb"), F.coalesce(F.sum("__n").over(w.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"), F.sum("__n").over(w).alias("__t"))
    rank = F.row_number().over(Window.partitionBy(stratum, "__b").orderBy("__h", key)) - 1
    ranked = hashed.withColumn("__r", rank).join(F.broadcast(offsets), (F.col(stratum).eqNullSafe(F.col("__s"))) & (F.col("__b") == F.col("__bb")))
    at = (F.col("__r") + F.col("__o")) / F.col("__t")
    split = F.when(at < test, "test").when(at < test + validation, "validation").otherwise("train")
    return ranked.withColumn("split", split).select(*df.columns, "split")

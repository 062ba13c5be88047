"""Mixes documents of many sources to target weights by Pareto order sampling, in DataFrame functions only.

Every source has a target in words. A document is expected ``e`` times in the mix: its source's target by its source's
size, times its measure. It gets ``floor(e)`` certain whole copies; one more copy goes to a sample of fixed size (in
words) with unequal inclusion probabilities ``p = e - floor(e)``. The sample takes the documents of least

    q = (u / (1 - u)) / (p / (1 - p)),    u uniform on (0, 1) by a seeded hash of the row

until the words that the certain copies left over are reached. So a source ends at its target: the last document of the
order is taken whole, or left, where that misses the target by no more than ``NEAR`` of it, and is cut otherwise.

No source is sorted as a whole. Its rows are counted in ``sqrt(n)`` intervals of ``q``; the interval that holds the cut
is the only one whose rows are put in order. What comes of it is a row a source with the cut's place, so that a scan
can decide on each document, text and all, without moving it.

Edge cases: null text has no words, size 0 and nothing taken. A null source is a source, last in order. Rows that are
equal in id and text can't be told apart, so those at the cut share its words equally, rounded down. Null ids are ids. A
source without words has target 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairlead.llm.common import materialize, running
from fairlead.operators.shared import look_up

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order, repeating.
WEIGHTS = (1, 2, 3)
#: Times that a document may be in the mix.
MAX_COPIES = 3
#: Share of its target by which a source may miss it in order to keep its last document whole.
NEAR = 0.005
SEED = 11


def targets(rows: DataFrame, weights: Sequence[int] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """``source, n_rows, source_size, target`` from rows with ``source, size``.

    All sizes are shared by weight; no target goes beyond ``max_copies`` times its source's size. With the sources in
    order of that limit by weight, the limited ones come first, so running sums tell them. Both orders are made by
    ranges: there may be any number of sources.
    """
    sums = materialize(rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("source_size")), "sources")
    placed = running(sums, [F.col("source").asc_nulls_last()], {"place": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    limit = (max_copies * F.col("source_size")).cast("double")
    placed = materialize(placed.select("source", "n_rows", "source_size", weight.alias("weight"), limit.alias("limit")), "weights")
    total = placed.agg(F.sum("weight").alias("w"), F.sum("source_size").cast("double").alias("size")).first()  # two numbers
    if total.w is None:
        return placed.select("source", "n_rows", "source_size", F.col("limit").alias("target"))
    ranked = running(placed, [(F.col("limit") / F.col("weight")).asc()], {"w_before": F.col("weight"), "limit_before": F.col("limit")})
    held = F.col("limit") * (F.lit(total.w) - F.col("w_before")) <= (F.lit(total.size) - F.col("limit_before")) * F.col("weight")
    ranked = materialize(ranked.withColumn("held", held), "targets")
    of_held = ranked.where("held").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("w"), F.coalesce(F.sum("limit"), F.lit(0.0)).alias("size")).first()
    share = (total.size - of_held.size) / (total.w - of_held.w) if total.w > of_held.w else 0.0
    return ranked.select("source", "n_rows", "source_size", F.when(F.col("held"), F.col("limit")).otherwise(F.lit(share) * F.col("weight")).alias("target"))


def _scales(rows: DataFrame, sources: DataFrame, max_copies: int) -> DataFrame:
    """``sources`` with ``scale``: a document is expected ``least(scale * x, max_copies)`` times.

    Documents that reach the limit leave words over, which go to the others of their source. Each round reads what they
    leave with the scale so far; scales only grow, and the last round changes none.
    """
    plain = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    if "x" not in rows.columns:
        return sources.withColumn("scale", plain)
    found = materialize(sources.withColumn("scale", F.lit(0.0)), "scales")
    while True:
        full = F.col("scale") * F.col("x") >= max_copies
        words = look_up(rows, found, "source", "n_rows").groupBy("source").agg(
            F.sum(F.when(full, F.col("size")).otherwise(0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("x") * F.col("size"))).alias("open")
        )
        new = F.when(F.col("open") > 0, (F.col("target") - max_copies * F.col("full")) / F.col("open")).otherwise(F.col("scale"))
        both = found.join(words.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select("source", "n_rows", "source_size", "target", F.col("scale").alias("last"), new.alias("scale"))
        both = materialize(both, "scales")
        if both.where(F.col("scale") > F.col("last") * (1 + 1e-12)).isEmpty():
            return both.drop("last")
        found = both.drop("last")


def _ranked(rows: DataFrame, max_copies: int) -> DataFrame:
    """Rows that know their source's ``scale``, with ``certain`` copies and the place ``q`` in the order (null: not in it)."""
    e = F.least(F.col("scale") * F.col("x") if "x" in rows.columns else F.col("scale"), F.lit(float(max_copies)))
    u = (F.conv(F.substring("hash", 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(2.0**52)
    with_e = rows.withColumn("certain", F.floor(e)).withColumn("p", e - F.floor(e)).withColumn("u", u)
    q = F.when(F.col("p") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p"))))
    return with_e.withColumn("q", q).drop("p", "u")


def _cuts(rows: DataFrame, sources: DataFrame, max_copies: int) -> DataFrame:
    """``sources`` with ``cut_q, cut_hash, cut_taken``: rows before the cut are in the sample, the row at it has so many
    words there. Without a cut (null) all of the order is in."""
    ranked = _ranked(look_up(rows, sources, "source", "n_rows", keep=True), max_copies)
    at = F.floor(F.col("q") / (1 + F.col("q")) * F.ceil(F.sqrt(F.col("n_rows"))))
    ranked = ranked.withColumn("slot", F.coalesce(at, F.lit(-1)))
    slots = ranked.groupBy("source", "slot").agg(F.sum(F.col("certain") * F.col("size")).alias("certain"), F.sum(F.when(F.col("q").isNotNull(), F.col("size")).otherwise(0)).alias("words"))
    budget = F.floor(F.col("target") + 0.5) - F.sum("certain").over(Window.partitionBy("source"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("slot"))
    known = slots.join(sources.select(F.col("source").alias("s"), "target"), F.col("source").eqNullSafe(F.col("s")))
    cut = known.select("source", "slot", "words", "target", budget.alias("budget"), upto.alias("upto")).where((F.col("upto") > F.col("budget")) & (F.col("upto") - F.col("words") <= F.col("budget")) & (F.col("words") > 0))
    cut = cut.select(F.col("source"), F.col("slot").alias("cut_slot"), (F.col("budget") - F.col("upto") + F.col("words")).alias("left"))
    cut = materialize(sources.join(cut.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), "cut-slots")
    # only the rows of each source's cut interval are put in order, equal ones as one
    inside = _ranked(look_up(rows, cut, "source", "n_rows", keep=True), max_copies).where(F.coalesce(at, F.lit(-1)) == F.col("cut_slot"))
    alike = inside.groupBy("source", "q", "hash").agg(F.first("size").alias("size"), F.count(F.lit(1)).alias("n"), F.first("left").alias("left"), F.first("target").alias("target"))
    words = F.col("n") * F.col("size")
    before = F.sum(words).over(Window.partitionBy("source").orderBy("q", "hash")) - words
    open_ = alike.withColumn("free", F.col("left") - before).where((F.col("free") >= 0) & (F.col("free") < words))
    whole = F.when(words - F.col("free") <= F.lit(NEAR) * F.col("target"), F.col("size")).when(F.col("free") <= F.lit(NEAR) * F.col("target"), F.lit(0))
    found = open_.select(F.col("source").alias("s"), F.col("q").alias("cut_q"), F.col("hash").alias("cut_hash"), F.coalesce(whole, F.floor(F.col("free") / F.col("n"))).alias("cut_taken"))
    return materialize(cut.drop("cut_slot", "left").join(found, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), "cuts")


def _taken() -> Column:
    key, cut = F.struct("q", "hash"), F.struct(F.col("cut_q").alias("q"), F.col("cut_hash").alias("hash"))
    sample = F.when(F.col("q").isNull(), 0).when(F.col("cut_q").isNull() | (key < cut), F.col("size")).when(key == cut, F.col("cut_taken")).otherwise(0)
    return F.col("certain") * F.col("size") + sample


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, measure: Column | None, seed: int, *more: Column) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text))
    x = [F.coalesce(measure, F.lit(0.0)).cast("double").alias("x")] if measure is not None else []
    return docs.select(*more, F.col(source_col).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.md5(named).alias("hash"), *x)


def mix(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_copies: int = MAX_COPIES, measure: Column | None = None, seed: int = SEED,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row a document: the id, ``size, source_size, target, taken`` (words that the mix takes, repeats counted).

    ``measure`` (0 or more; null: 0) says how often a document is wanted compared with others of its source. The texts
    are read once; a narrow table of sizes and hashes serves the passes that follow.
    """
    rows = materialize(_rows(docs, id_col, text_col, source_col, measure, seed, F.col(id_col).alias("doc")), "sizes")
    sources = _cuts(rows, _scales(rows, targets(rows, weights, max_copies), max_copies), max_copies)
    found = _ranked(look_up(rows, sources, "source", "n_rows"), max_copies)
    return found.select(F.col("doc").alias(id_col), "size", "source_size", "target", _taken().alias("taken"))


def mixed_documents(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_copies: int = MAX_COPIES, measure: Column | None = None, seed: int = SEED,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The mix itself: every copy a row with all columns of ``docs`` and ``copy`` (from 0; overwritten if there).
    A cut document's last copy has the beginning of its text. The texts are scanned, not shuffled, where the sources
    are few enough to broadcast."""
    rows = materialize(_rows(docs, id_col, text_col, source_col, measure, seed), "sizes")
    sources = _cuts(rows, _scales(rows, targets(rows, weights, max_copies), max_copies), max_copies)
    whole = F.struct(*docs.columns).alias("row")
    found = _ranked(look_up(_rows(docs, id_col, text_col, source_col, measure, seed, whole), sources, "source", "n_rows"), max_copies)
    found = found.withColumn("taken", _taken()).where(F.col("taken") > 0)
    copies = F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)
    each = found.select("row", "size", "taken", F.explode(copies).alias("copy"))
    rest = (F.col("taken") - F.col("copy") * F.col("size")).cast("int")
    # a text falls into words with the space before each
    start = F.array_join(F.slice(F.split(F.col(f"row.`{text_col}`"), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), F.lit(1), rest), "")
    text = F.when(rest < F.col("size"), start).otherwise(F.col(f"row.`{text_col}`"))
    return each.select(*[text.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns if c != "copy"], "copy")

"""Targets, whole copies and samples of sources against plain Python."""

import hashlib
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from fairlead.operators import shared
from fairlead.llm.mixing import mix, mixed_documents

from helpers import AWKWARD, documents, prose, words


def plain_targets(sizes, weights=(1, 2, 3), copies=3):
    """Share, hold what is above its limit, share the rest again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(order)}
    held, total = set(), sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in held]
        left = total - sum(copies * sizes[s] for s in held)
        target = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if target[s] >= copies * sizes[s]}
        if not over:
            return {s: target.get(s, Fraction(copies * sizes[s])) for s in order}
        held |= over


def check(rows, docs):
    sizes, taken = defaultdict(int), defaultdict(int)
    source = {r.doc_id: r.source for r in docs}
    for r in rows:
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    want = plain_targets(sizes)
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(float(want[s]))
    for s in sizes:
        assert abs(taken[s] - want[s]) <= Fraction(1, 200) * want[s] + 1
    assert sum(want.values()) == sum(sizes.values())


def test_awkward_rows(spark):
    docs = documents(spark, AWKWARD + prose(1, 80) + AWKWARD)
    rows = mix(docs).collect()
    assert len(rows) == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.size == len(words(texts[r.doc_id])) for r in rows)
    check(rows, docs.collect())


def test_whole_copies_and_order(spark):
    """A source wanted 1.4 times: each document once, and again those of least hash until the words are reached."""
    docs = documents(spark, prose(2, 200)).withColumn("source", F.when(F.col("doc_id") < 120, "a").otherwise("b"))
    rows = mix(docs, weights=(1, 1)).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for s in (False, True):
        mine = [r for r in rows if (r.doc_id < 120) == s]
        e = mine[0].target / mine[0].source_size
        hashes = {r.doc_id: hashlib.md5(f"11|{r.doc_id}|{hashlib.md5(texts[r.doc_id].encode()).hexdigest()}".encode()).hexdigest() for r in mine}
        more = sorted(mine, key=lambda r: hashes[r.doc_id])  # one probability for all, so the order is that of u
        extra = [r.taken - int(e) * r.size for r in more]
        k = next(i for i, x in enumerate(extra) if x != more[i].size)
        assert all(x == 0 for x in extra[k + 1 :]) and 0 <= extra[k] < more[k].size


def test_one_document_sources_are_cut_and_equal_rows_share(spark):
    one = [(0, " ".join(f"w{i}" for i in range(1000)), "a"), (1, "x " * 500, "b"), (2, "y " * 77, None)]
    same = [(9, "p q r s t", "c")] * 301
    docs = spark.createDataFrame(one + same, "doc_id long, text string, source string")
    rows = mix(docs).collect()
    taken = {(r.doc_id, r.taken, r.target) for r in rows}
    assert len({t for t in taken if t[0] == 9}) == 1  # equal rows get the same
    for i, t, target in taken:
        if i != 9:
            assert t == int(target + 0.5)


def test_measure_and_copies(spark):
    """Documents with twice the measure are in twice as often; the copies add up to what is taken."""
    docs = documents(spark, prose(3, 400, words=60)).withColumn("source", F.lit("s")).withColumn("copy", F.lit(9))
    x = F.when(F.col("doc_id") % 2 == 0, 2.0).otherwise(1.0)
    rows = {r.doc_id: r for r in mix(docs, measure=x).collect()}
    even, odd = ([r for r in rows.values() if r.doc_id % 2 == k] for k in (0, 1))
    rate = [sum(r.taken for r in g) / sum(r.size for r in g) for g in (even, odd)]
    assert rate[0] / rate[1] == pytest.approx(2, rel=0.15)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = defaultdict(list)
    for r in mixed_documents(docs, measure=x).collect():
        got[r.doc_id].append((r.copy, r.text))
    for i, r in rows.items():
        n = 0
        for k, (copy, text) in enumerate(sorted(got[i])):
            assert copy == k and texts[i].startswith(text)
            n += len(words(text))
        assert n == r.taken


def test_measures_at_the_limit(spark):
    """One document is wanted so often that it stops at three copies; the others share what it leaves."""
    docs = documents(spark, ["a b c d"] * 50 + ["one two three four"]).withColumn("source", F.lit("s")).withColumn("doc_id", F.col("doc"))
    rows = mix(docs, measure=F.when(F.col("doc_id") == 50, 1e6).otherwise(1.0)).collect()
    assert {r.taken for r in rows if r.doc_id == 50} == {12}
    assert sum(r.taken for r in rows) == 204


def test_more_sources_than_are_broadcast(spark, monkeypatch):
    """Beyond the bound only frequent sources are broadcast; the rows are the same."""
    docs = documents(spark, prose(4, 120)).withColumn("source", F.when(F.col("doc_id") < 60, "hot").otherwise(F.concat(F.lit("s"), F.col("doc_id") % 13)))
    want = sorted(map(tuple, mix(docs).collect()))
    monkeypatch.setattr(shared, "HEAVY", 4)
    assert sorted(map(tuple, mix(docs).collect())) == want
    assert sorted(map(tuple, mix(docs.repartition(7)).collect())) == want


def test_empty(spark):
    assert mix(documents(spark, [""]).limit(0)).count() == 0
    (r,) = mix(documents(spark, [None])).collect()
    assert (r.size, r.source_size, r.target, r.taken) == (0, 0, 0.0, 0)


def test_native(spark):
    plan = mix(documents(spark, prose(5, 5)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_a_very_long_text(spark):
    """Twenty megabytes beside short texts: counted as a whole, and cut where the source's target is reached."""
    long = spark.range(1).select(F.lit(0).cast("long").alias("doc_id"), F.repeat(F.lit("word "), 4_000_000).alias("text"), F.lit("a").alias("source"))
    docs = long.unionByName(spark.createDataFrame([(1, "x " * 1000, "b"), (2, "y z", "a")], "doc_id long, text string, source string"))
    rows = {r.doc_id: r for r in mix(docs).collect()}
    assert rows[0].size == 4_000_000 and rows[1].taken == 3 * 1000
    assert abs(rows[0].taken + rows[2].taken - rows[0].target) <= 0.005 * rows[0].target

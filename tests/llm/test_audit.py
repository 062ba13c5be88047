"""Filters' bits and the audit of all orders against plain Python."""

import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from fairlead.llm import audit
from fairlead.llm.audit import interaction_audit, scan_texts, text_failures
from fairlead.operators import shared

from helpers import AWKWARD, documents, prose, words

MORE = ["Ab" * 300, "é" * 50, "\x0b\x0c", " x y", "# $ % & * |", "A" + "b" * 8, "A" + "b" * 9, "A" * 2 + "é" * 18, "the " * 400 + "end", "x", "word " * 79 + " ".join(f"w{i}" for i in range(79))]


def buffers(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def counts(t):
    w = words(t)
    return len(w), len(set(w)), len(re.findall("[A-Z]", t)), len(re.findall("[#$%&*|]", t)), len(t)


def bits(t):
    n, distinct, capitals, symbols, points = counts(t)
    return (n < 100) + 2 * (100 * distinct < 80 * n) + 4 * (100 * capitals > 10 * points) + 8 * (symbols > 0)


def test_scan_equals_plain_python():
    r = random.Random(1)
    texts = [t or "" for t in AWKWARD] + MORE + prose(1, 50, 400, 100)
    texts += ["".join(r.choice("aB \n#é\tz") for _ in range(r.randint(0, 60))) for _ in range(2000)] + ["", ""]
    for some in (texts, texts[::-1], ["a b"], [""], ["", "a", ""], ["a", "a", " a", "a "]):
        got = np.stack(scan_texts(*buffers(some)), axis=1).tolist()
        assert got == [list(counts(t)) for t in some]
        assert text_failures(*buffers(some)).tolist() == [bits(t) for t in some]


def test_a_long_text_and_a_shifted_buffer():
    long = " ".join(f"w{i % 70_000}" for i in range(1_500_000))  # eight megabytes
    data, offsets = buffers(["before", long, "after after"])
    got = scan_texts(data, offsets[1:])
    assert [g.tolist() for g in got[:2]] == [[1_500_000, 2], [70_000, 1]]


def test_hashes_that_collide_are_verified(monkeypatch):
    """With one hash for all words, distinct words are still counted right."""
    monkeypatch.setattr(audit, "_word_hashes", lambda data, start, end: np.zeros(len(start), np.uint64))
    texts = ["a b c a b", "x", "", "same same same", "aa b aa", "one two one three"]
    assert scan_texts(*buffers(texts))[1].tolist() == [3, 1, 0, 1, 2, 3]


def plain_audit(rows, labels):
    """rows: (doc_id, lang, text); labels: (doc_id, quality, toxic)."""
    found, table = {}, {}
    for i, lang, t in rows:
        late = i is not None and any(j is not None and j < i and (u or "") == (t or "") for j, _, u in rows)
        b = bits(t or "") + 16 * late
        good = any(d == i and q == 1 for d, q, _ in labels if i is not None)
        toxic = any(d == i and x == 1 for d, _, x in labels if i is not None)
        found.setdefault(lang or "", []).append(({f for k, f in enumerate("ABCDE") if b >> k & 1}, good, toxic))
    for part, docs in found.items():
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, f in enumerate(order):
                prior = set(order[:k])
                here = [d for d in docs if f in d[0] and not d[0] & prior]
                table[part, order, k + 1] = [sum(not d[0] & (prior | {f}) for d in docs), len(here), sum(f in d[0] and bool(d[0] & prior) for d in docs), sum(d[0] == {f} for d in docs), sum(d[1] for d in here), sum(d[2] for d in here)]
        total = {f: sum(table[part, o, o.index(f) + 1][1] for o in map("".join, itertools.permutations("ABCDE"))) for f in "ABCDE"}
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, f in enumerate(order):
                table[part, order, k + 1].append(total[f])
    return table


def check(spark, docs, labels):
    rows = [(r.doc_id, r.lang, r.text) for r in docs.collect()]
    of = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("clash"))
    got = {(r.part, r.filter_order, r.step): list(r[3:]) for r in interaction_audit(docs, of).collect()}
    assert got == plain_audit(rows, labels)


def test_audit_equals_plain_python(spark):
    texts = AWKWARD + MORE + prose(2, 30, 300) + prose(2, 12, 300) + AWKWARD + ["Copy"] * 20
    r = random.Random(3)
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, len(texts), 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (999, 1, 1)]
    docs = documents(spark, texts).withColumn("mask", F.lit("clash"))
    check(spark, docs, labels)
    check(spark, docs.unionByName(docs.limit(9)), labels)  # repeated rows
    check(spark, docs.withColumn("doc_id", F.when(F.col("doc_id") % 5 > 0, F.col("doc_id"))), labels)  # null ids
    check(spark, docs.withColumn("lang", F.lit(None).cast("string")), [])


def test_frequent_copies_are_looked_up_by_broadcast(spark, monkeypatch):
    docs = documents(spark, ["hot text"] * 60 + [f"text {i % 20}" for i in range(60)])
    want = sorted(map(tuple, audit.failures(docs).collect()))
    monkeypatch.setattr(shared, "HEAVY", 4)
    assert sorted(map(tuple, audit.failures(docs.repartition(5)).collect())) == want


def test_empty(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interaction_audit(documents(spark, [""]).limit(0), labels).count() == 0


def test_a_very_long_text(spark):
    """Twenty megabytes beside short texts."""
    long = spark.range(1).select(F.lit(0).cast("long").alias("doc_id"), F.repeat(F.lit("Word one "), 2_300_000).alias("text"), F.lit("en").alias("lang"))
    docs = long.unionByName(spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(200)), "en"), (2, None, "en")], "doc_id long, text string, lang string"))
    assert {r.doc: r.mask for r in audit.failures(docs).collect()} == {0: 2 + 4, 1: 0, 2: 1}

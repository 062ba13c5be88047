"""Codebooks and codes against plain Python integers."""

import hashlib
import math
import random

from pyspark.sql import functions as F

from fairlead.operators import shared
from fairlead.llm.codes import component_bound, compress


def plain(rows, parts=4, entries=256, rounds=4):
    """Rows (vec_id, vector, label) to (vec_id, code, error, label_error, sha)."""
    rows = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    least = {}
    for i, v, _ in rows:
        if i is not None:
            least[i] = min(least.get(i, v), v)
    length = len(least[min(least)])
    rows = [r for r in rows if len(r[1]) == length]
    first = [least[i] for i in sorted(least) if len(least[i]) == length][:entries]
    bound, width = component_bound(length), -(-length // parts)
    whole = lambda v: [min(max(math.floor(1024 * x), -bound), bound) for x in v] + [0] * (-length % parts)
    cut = lambda v: [whole(v)[k * width : (k + 1) * width] for k in range(parts)]
    books = [[cut(v)[k] for v in first] for k in range(parts)]
    vectors = [cut(v) for _, v, _ in rows]

    def nearest(book, p):
        return min((sum((a - b) ** 2 for a, b in zip(e, p)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        new = []
        for k in range(parts):
            groups = {}
            for v in vectors:
                groups.setdefault(nearest(books[k], v[k])[1], []).append(v[k])
            new.append([[sum(c) // len(c) for c in zip(*groups[j])] if j in groups else e for j, e in enumerate(books[k])])
        books = new
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    best = [[nearest(books[k], v[k]) for k in range(parts)] for v in vectors]
    error = [sum(d for d, _ in b) for b in best]
    total = {}
    for r, e in zip(rows, error):
        total[r[2]] = total.get(r[2], 0) + e
    return sorted(((r[0], "".join(f"{j:02x}" for _, j in b), e, total[r[2]], sha) for r, b, e in zip(rows, best, error)), key=str)


def frame(spark, rows, kind="float"):
    rows = [(i, v and [x if x is None else float(x) for x in v], label) for i, v, label in rows]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
    return df.withColumn("code", F.lit("clash")).withColumn("error", F.lit(1)).repartition(3)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def vectors(n, length, seed=1, spread=3.0):
    r = random.Random(seed)
    return [[round(r.gauss(0, spread) * 64) / 64 for _ in range(length)] for _ in range(n)]


def test_equals_plain_python(spark):
    rows = [(i, v, i % 5 if i % 7 else None) for i, v in enumerate(vectors(300, 8))]
    assert got(compress(frame(spark, rows), entries=20)) == plain(rows, entries=20)
    assert got(compress(frame(spark, rows))) == plain(rows)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    v = vectors(40, 6, seed=2)  # a length that four doesn't divide
    rows = [(i * 3, x, i % 2) for i, x in enumerate(v)]
    rows += [(1, None, 0), (2, [], 0), (4, [1.0, None, 0, 0, 0, 0], 0), (5, [nan] * 6, 1), (7, [inf] * 6, 1), (8, [-inf, 0, 0, 0, 0, 0], 1)]
    rows += [(10, [1.0, 2.0], 0), (None, v[3], None), (None, v[4], 9), (9, v[7], 1), (9, v[8], 1), (9, v[8], 1)]  # other length, null ids, an id with two vectors
    rows += [(200 + i, v[0], 3) for i in range(30)]  # ties: equal vectors, and equal entries
    rows += [(300, [3.4e38, -3.4e38, 1e30, 0, 0, 0], 4)]  # beyond what fits: cut to the bound
    assert got(compress(frame(spark, rows, "double"), entries=16)) == plain(rows, entries=16)


def test_least_id_decides_the_length(spark):
    rows = [(5, [1.0, 2.0, 3.0, 4.0], 0), (3, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0], 0), (8, [0.0] * 8, 0), (9, [0.0] * 4, 0)]
    assert [r[0] for r in got(compress(frame(spark, rows)))] == [3, 8]


def test_empty(spark):
    assert compress(frame(spark, [(1, None, 2)])).count() == 0
    assert compress(frame(spark, [(None, [1.0] * 4, 2)])).count() == 0
    assert compress(frame(spark, [(1, [1.0] * 4, 2)]).limit(0)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_partitions_and_many_labels(spark, monkeypatch):
    rows = [(i, v, i % 50 if i % 3 else 7) for i, v in enumerate(vectors(200, 12, seed=3))]
    want = got(compress(frame(spark, rows), entries=30))
    monkeypatch.setattr(shared, "HEAVY", 5)
    assert got(compress(frame(spark, rows).repartition(11), entries=30)) == want

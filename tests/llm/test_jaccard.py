import random

import numpy as np
from helpers import AWKWARD, ascii_lower, collect, documents, prose, words

from fairlead.llm import jaccard


def brute(texts, n, pct):
    sets = []
    for t in texts:
        w = words(ascii_lower(t))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if both and 100 * both >= pct * len(a | b):
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return {i: (len(s), root(i)) for i, s in enumerate(sets)}


def near_copies(seed):
    """Chains, stars and clusters of edited texts around the threshold."""
    r, out = random.Random(seed), []
    for base in prose(seed, 8, words=120):
        w = base.split()
        out.append(base)
        for _ in range(r.randint(1, 9)):
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = f"n{r.randint(0, 99)}"
            if r.random() < 0.3:
                w = w[: max(5, len(w) - r.randint(0, 6))]
            out.append(" ".join(w))
            if r.random() < 0.5:
                out.append(" ".join(w).upper())
    r.shuffle(out)
    return out


def test_equals_brute_force(spark):
    texts = AWKWARD + ["one", "ONE", "one two", "a b c d", "a b c d e"] + near_copies(1) + near_copies(2)
    for n, pct in ((4, 85), (5, 80), (1, 50)):
        got = collect(jaccard.near_duplicates(documents(spark, texts), n, pct))
        assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == brute(texts, n, pct), (n, pct)


def test_one_group_of_near_copies_around_a_pivot(spark):
    """Members that link to each other but not to the least one, and two clusters that share frequent n-grams."""
    base = prose(4, 1, words=100)[0].split()[:60] + [f"q{i}" for i in range(40)]
    texts = []
    for i in range(40):
        w = list(base)
        for j in range(i % 5):
            w[(i * 7 + j * 11) % 100] = f"m{i}_{j}"
        texts.append(" ".join(w))
    got = collect(jaccard.near_duplicates(documents(spark, texts), 4, 85))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == brute(texts, 4, 85)


def test_many_places_for_a_star(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "STAR", 3)
    texts = near_copies(5)
    got = collect(jaccard.near_duplicates(documents(spark, texts), 4, 85))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == brute(texts, 4, 85)


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(5, 3), (3, 9), (7, 8)]
    got = {r.doc: r.label for r in jaccard.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 3: 3, 5: 3, 9: 3, 7: 7, 8: 7}


def test_signatures_never_rule_out_a_link(spark):
    """At a threshold around which the sets of near copies lie, without the bins' help and with few bits."""
    texts = near_copies(7) + near_copies(8)
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in (ascii_lower(t).split() for t in texts)]
    docs = documents(spark, texts).selectExpr("doc_id as doc", "text")
    p = {r.doc: r for r in jaccard._prefixes(docs, 4, 85, np.zeros(jaccard.LEAST_SLOTS, np.uint8)).collect()}
    for i, a in enumerate(sets):
        for j in range(i):
            apart = sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(p[i].sig, p[j].sig, strict=True))
            assert apart <= len(a ^ sets[j])


def test_need_is_the_least_overlap():
    for a in range(1, 40):
        for b in range(1, 40):
            for pct in (50, 80, 85):
                k = int(jaccard.need(np.int64(a), np.int64(b), pct))
                assert 100 * k >= pct * (a + b - k) and not (100 * (k - 1) >= pct * (a + b - k + 1))


def test_edges(spark):
    docs = documents(spark, AWKWARD)
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (9, "a b c d e f"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect())
    assert got == sorted([(0, 2, None), (4, 2, 4), (4, 2, 4), (9, 2, 4), (0, 0, None)], key=lambda x: (x[0], x[1])) or {x for x in got} == {(0, 2, None), (4, 2, 4), (9, 2, 4), (0, 0, None)}
    assert sorted(r.doc_id or 0 for r in jaccard.distinct_documents(df).collect()) == [0, 0, 4, 4]


def test_counts_of_all_tasks_are_added_up(spark):
    texts = [f"the same few words here {i} {i + 1000}" for i in range(300)] + [f"another lot of words {i % 40}" for i in range(120)]
    docs = documents(spark, texts).repartition(9).selectExpr("doc_id as doc", "text")
    slots = 1 << 17
    want = np.zeros(slots)
    for s in jaccard.shingle_sets(texts, 3):
        np.add.at(want, (s & np.uint64(slots - 1)).astype(np.int64), 1)
    for tasks in (1, 9):
        assert (jaccard._levels(jaccard._sets(docs, 3, slots), slots, tasks) == np.floor(4 * np.log2(want + 1))).all()


def test_rows_of_a_frequent_gram_in_many_tasks_and_batches(spark):
    rows = [(d, 10, 0, g) for g, k in ((1, 1), (2, 2), (3, 700), (4, 1), (5, 40), (6, 1)) for d in range(k)]
    df = spark.createDataFrame(rows, "doc long, size int, at int, gram long").repartition(3)
    for batch, tasks in ((10, 1), (100, 4), (10, 4), (1, 1)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
        spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
        got = jaccard._met(df).collect()
        own = {(r.gram, r.doc) for r in got}
        assert len(got) == len(own) and own >= {(g, d) for g, k in ((2, 2), (3, 700), (5, 40)) for d in range(k)}
        assert all(r.pivot.doc <= r.doc and (r.edge or r.pivot.doc == 0) for r in got)
        assert all((r.gram, r.pivot.doc) in own for r in got)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_suffix_filter_is_a_lower_bound():
    r = np.random.default_rng(6)
    for _ in range(400):
        x, y = (np.unique(r.integers(0, r.integers(5, 200), r.integers(0, 60)).astype(np.uint64)) for _ in range(2))
        true = len(np.setxor1d(x, y))
        for depth in (0, 1, 2, 5):
            assert jaccard.hamming_bound(x, y, 10**9, depth) <= true
            assert jaccard.hamming_bound(x, y, true, depth) <= true
    assert jaccard.hamming_bound(np.arange(0, 50), np.arange(100, 150), 3) > 3

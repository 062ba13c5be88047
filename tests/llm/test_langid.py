import re
import zlib
from collections import Counter

import numpy as np
from helpers import AWKWARD, collect, documents

from fairlead.llm import langid


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = collect(langid.identify(docs, langid.fit(docs)))
    assert set(got) == set(truth) and all(r["held_out"] == held(i) and 0 <= r["score"] <= 1 for i, r in got.items())
    own = [i for i in truth if held(i)]
    assert sum(got[i]["lang_pred"] == truth[i] for i in own) / len(own) >= 0.97


def test_nothing_is_learned_from_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    from pyspark.sql import functions as F

    other = docs.withColumn("lang", F.when(langid.held_out(), F.lit("xx")).otherwise(F.col("lang"))).withColumn("text", F.when(langid.held_out(), F.lit("qqqq wwww")).otherwise(F.col("text")))
    a, b = langid.fit(docs), langid.fit(other)
    assert a.languages == b.languages and (a.table == b.table).all()


def test_filters_hold_all_they_were_given_and_correct_false_positives():
    r = np.random.default_rng(1)
    grams = [r.integers(0, 1 << 63, 20_000, dtype=np.uint64) for _ in range(3)]
    f = langid.Filters(["a", "b", "c"], grams, "a")
    assert f.held(grams[1])[1] == 20_000
    other = r.integers(0, 1 << 63, 100_000, dtype=np.uint64)
    assert abs(f.held(other)[1] / len(other) - f.false_rate[1]) < 5e-4
    wide = langid.Filters([f"l{i:02}" for i in range(40)], [g[:50] for g in grams] * 13 + [grams[0][:50]], "l00")
    assert wide.table.dtype == np.uint64


def test_more_languages_than_bits(spark):
    """A hundred languages with words of their own; the filters hold what single ones would."""
    r = np.random.default_rng(3)
    word = lambda k: "".join(chr(0x4E00 + 60 * k + int(x)) for x in r.integers(0, 60, 4))
    words = [[word(k) for _ in range(20)] for k in range(100)]
    rows = [(100 * n + k, " ".join(r.choice(words[k], 60)), f"l{k:03}") for k in range(100) for n in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = langid.fit(docs)
    assert filters.table.shape == (2, langid.SLOTS) and len(filters.languages) == 100
    texts = [(k, " ".join(t for i, t, n in rows if n == f"l{k:03}")) for k in range(100)]
    assert all(filters.predict(t)[0] == f"l{k:03}" for k, t in texts)
    r = np.random.default_rng(5)
    grams = [r.integers(0, 1 << 63, 2000, dtype=np.uint64) for _ in range(70)]
    wide = langid.Filters([f"l{i:02}" for i in range(70)], grams, "l00")
    for i in (0, 63, 64, 69):
        assert wide.held(grams[i])[i] == 2000 and langid.Filters(["x"], [grams[i]], "x").held(grams[0])[0] == wide.held(grams[0])[i]


def test_equals_brute_force(spark):
    """Sets of n-grams of the same documents in place of the filters."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()

    def grams(text):
        letters = re.sub(r" +", " ", "".join(c if c.isalpha() else " " for c in text.lower()).strip())
        t = f"  {letters}  "
        return [t[i : i + langid.GRAM] for i in range(len(t) - langid.GRAM + 1)]

    size, on = Counter(), {}
    for r in rows:
        if not held(r.doc_id) and r.lang is not None and r.text is not None:
            size[r.lang] += 1
            for g in set(grams(r.text)) if any(c.isalpha() for c in r.text) else ():
                on.setdefault(g, Counter())[r.lang] += 1
    known = {}
    for g, by in on.items():
        share = {k: n / size[k] for k, n in by.items() if n > 1 and n / size[k] >= langid.MIN_SHARE}
        known[g] = {k for k, x in share.items() if x * langid.DOMINANCE >= max(share.values())}
    got = collect(langid.identify(docs, langid.fit(docs)))
    for r in rows:
        if r.text and any(c.isalpha() for c in r.text):
            n = Counter(k for g in grams(r.text) for k in known.get(g, ()))
            best = max(sorted(n), key=lambda k: n[k])
            assert abs(got[r.doc_id]["score"] - n[best] / sum(n.values())) < 0.02 + 2 / sum(n.values())  # a short text may have a false positive or two
            if sorted(n.values())[-1] - sorted([0, *n.values()])[-2] > 2:
                assert got[r.doc_id]["lang_pred"] == best


def test_edges(spark):
    docs = documents(spark, AWKWARD + ["12 34 !!", "???", "ж", "日本語のテキスト"] + ["the ship sails on the sea", "le bateau va sur la mer"] * 10)
    got = collect(langid.identify(docs, langid.fit(docs)))
    for i in (0, 1, 2, 3, len(AWKWARD), len(AWKWARD) + 1):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    assert got[len(AWKWARD) + 2]["lang_pred"] in ("en", "fr"), "letters: a learned language"
    none = docs.limit(0)
    assert langid.identify(none, langid.fit(none)).count() == 0
    unlabelled = langid.identify(docs, langid.fit(none))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}


def test_the_table_grows_with_the_n_grams(monkeypatch):
    """Long training texts don't fill the filters: the false rate stays small."""
    import numpy as np

    monkeypatch.setattr(langid, "SLOTS", 1 << 10)
    g = np.random.default_rng(1)
    sets = [np.unique(g.integers(0, 1 << 63, n).astype(np.uint64)) for n in (20_000, 100)]
    f = langid.Filters(["a", "b"], sets, "a")
    assert f.slots >= 8 * 20_000 and f.slots & (f.slots - 1) == 0 and max(f.false_rate) < 1 / 16
    assert f.held(sets[0])[0] == len(sets[0]) and f.held(sets[1])[1] == len(sets[1])

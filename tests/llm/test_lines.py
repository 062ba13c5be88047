import numpy as np
from helpers import AWKWARD, ascii_lower, collect, documents, prose, sha

from fairlead.llm import lines


def brute(docs):
    key = lambda x: ascii_lower(x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t in docs:
        for x in (t or "").split("\n"):
            held.setdefault(key(x), set()).add(i)
    gone = {k: max(v) for k, v in held.items() if len(k) >= 20 and len(v) >= 3}
    out = {}
    for i, t in docs:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if gone.get(key(x), i) == i]
        out[i] = (len(all_), len(all_) - len(kept), sha("\n".join(kept)))
    return out


def corpus():
    shared = ["This line is in a great many documents", "É accented lines of some length too", "short", "x" * 25]
    texts = [t.replace(" ", "\n", 3) for t in prose(3, 12)]
    texts += [f"own line number {i} of the text\n" + ("  " if i % 2 else "") + shared[i % 4].upper() + "\t\n" + shared[0] for i in range(30)]
    return AWKWARD + texts + ["exactly nineteen ch\n" * 2] * 4 + ["twenty characters ok"] * 4


def test_equals_brute_force_both_ways(spark, monkeypatch):
    texts = corpus()
    docs, want = documents(spark, texts), brute(list(enumerate(texts)))
    for limit, frequent, group in ((1 << 20, 100_000, 500_000), (0, 10**9, 1), (0, 30, 1), (0, 1, 500_000)):  # broadcast arrays; lines go to the shards, none, some or few of them frequent
        monkeypatch.setattr(lines, "FREQUENT", frequent)
        monkeypatch.setattr(lines, "GROUP_LINES", group)
        got = collect(lines.dedup_lines(docs, broadcast_bytes=limit))
        assert {i: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for i, r in got.items()} == want
        assert all(sha(r["kept_text"]) == r["kept_sha256"] for r in got.values())


def test_many_shards(spark, monkeypatch):
    monkeypatch.setattr(lines, "SHARD_LINES", 2)
    texts = corpus()
    for limit in (1 << 20, 0):
        got = collect(lines.dedup_lines(documents(spark, texts), broadcast_bytes=limit))
        assert {i: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for i, r in got.items()} == brute(list(enumerate(texts)))


def test_the_counts_decide(spark):
    """One index for all limits: the same lines, judged by their count when they are probed."""
    docs = documents(spark, [f"a line that is in {k} of the documents" for k in (1, 2, 3, 4) for _ in range(k)])
    found = lines.repeated_lines(docs)
    assert sorted(r.n for r in found.collect()) == [2, 3, 4]
    for least, gone in ((2, 6), (3, 5), (4, 3), (5, 0)):
        assert sum(r.n_dropped for r in lines.dedup_lines(docs, min_docs=least).collect()) == gone


def test_perfect_hash():
    r = np.random.default_rng(0)
    for n in (0, 1, 2, 1000):
        a, b = (r.integers(0, 1 << 63, n, dtype=np.uint64) for _ in range(2))
        h = lines.PerfectHash.build(a, b)
        assert sorted(h.index(a, b).tolist()) == list(range(n))
        shard = lines.Shard.from_bytes(lines.Shard.build(a.view(np.int64), b.view(np.int64), np.arange(n), np.arange(n)).to_bytes())
        found, count, keeper = shard.probe(a.view(np.int64), b.view(np.int64))
        assert found.all() and (count == np.arange(n)).all() and (keeper == np.arange(n)).all()
        assert not shard.probe(np.arange(50), np.arange(50))[0].any()


def test_edges(spark):
    docs = documents(spark, corpus())
    assert lines.dedup_lines(docs.limit(0)).count() == 0
    twice = lines.dedup_lines(docs.unionByName(docs), text=False)
    assert {(r.doc_id, r.kept_sha256) for r in twice.collect()} == {(r.doc_id, r.kept_sha256) for r in lines.dedup_lines(docs, text=False).collect()}
    nulls = spark.createDataFrame([(None, "a line of more than twenty characters")] * 3 + [(1, "a line of more than twenty characters"), (2, "a line of more than twenty characters")], "doc_id long, text string")
    assert sorted(r.n_dropped for r in lines.dedup_lines(nulls).collect()) == [0, 1, 1, 1, 1]
    out = lines.deduplicated_documents(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert all(r.n_chars == len(r.text) for r in out.collect())


def test_unique_lines_are_dealt_to_bounded_groups(spark, monkeypatch):
    """All in one shard: few repeated lines, many unique ones."""
    monkeypatch.setattr(lines, "GROUP_LINES", 100)
    keys = spark.range(5000).selectExpr("id AS h1", "id * 7 AS h2", "id % 3 AS doc", "0L AS shard")
    dealt, counts = lines._in_groups(keys)
    sizes = [r["count"] for r in dealt.groupBy("shard", "salt").count().collect()]
    assert counts.first().salts == 50 and sum(sizes) == 5000 and max(sizes) < 200

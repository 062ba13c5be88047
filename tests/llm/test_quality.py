import re

from helpers import AWKWARD, collect, documents, prose, words

from fairlead.llm import quality


def brute(text):
    w, text = words(text), text or ""
    where = {}
    for i in range(len(w) - 4):
        where.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {i + k for at in where.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in text.split("\n") if words(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def test_counts_equal_brute_force(spark):
    texts = AWKWARD + prose(1, 20) + ["a b c d e x a b c d e", "a a a a a a", "a a a a a", "1 2 3 4 5 6 1 2 3 4 5 6 7", "#a *b $ % & | < > ok\n#\n#\n"]
    got = collect(quality.quality_rules(documents(spark, texts)))
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = brute(t)
        assert {k: got[i][k] for k in want} == want, (i, t and t[:50])
        assert got[i]["base_failed"] == (want["n_words"] < 10 or 100 * want["n_repeat_words"] > 20 * want["n_words"])
        assert not (got[i]["base_failed"] and got[i]["kept"])


def test_host_decides_for_soft_failures_only(spark):
    clean, soft, junk = "one two three four five six seven eight nine ten eleven", "#one #two three four five six seven eight nine ten", " ".join(f"#${i}%" for i in range(20))
    rows = [(i, soft, "bad") for i in range(30)] + [(100, clean, "bad")] + [(200 + i, clean + f" {i}", "good") for i in range(60)] + [(300, soft, "good"), (301, junk, "good")]
    got = collect(quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert not any(got[i]["kept"] for i in range(30)), "soft failures in a condemned host go"
    assert got[100]["kept"] and got[100]["host_condemned"], "a clean document stays whatever its host"
    assert got[300]["kept"] and not got[300]["host_condemned"], "a soft failure in a good host stays"
    assert not got[301]["kept"]


def test_small_hosts_are_shrunk(spark):
    clean, soft = "one two three four five six seven eight nine ten eleven", "#one #two three four five six seven eight nine ten"
    rows = [(i, clean + f" {i}", f"h{i % 20}") for i in range(400)] + [(1000, soft, "single")]
    got = collect(quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert not got[1000]["host_condemned"]


def test_empty_repeated_rows_and_filter(spark):
    docs = documents(spark, AWKWARD + prose(2, 5))
    assert quality.quality_rules(docs.limit(0)).count() == 0
    twice = docs.unionByName(docs)
    assert quality.quality_rules(twice).count() == 2 * docs.count()
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, r in collect(quality.quality_rules(docs)).items() if r["kept"]}


def test_filter_judges_hosts_by_all_documents(spark):
    clean, table = "one two three four five six seven eight nine ten eleven", " | ".join(["word one", "two", "three", "four", "five", "six", "seven", "eight", "nine"])
    soft = "#one #two three four five six seven eight nine ten"  # 20 symbols for 100 words
    rows = [(i, f"{clean} {i}", f"h{i % 10}") for i in range(1000)] + [(2000, table, "h1"), (2001, soft, "h1")]
    rows += [(3000 + i, f"{soft} {i}" if i % 5 == 0 else f"{clean} {i}", "worse") for i in range(200)]  # a fifth fails: never condemned
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    judged = collect(quality.quality_rules(docs))
    assert all(r["kept"] and not r["host_condemned"] for r in judged.values())
    gone = set(judged) - {r.doc_id for r in quality.kept_documents(docs).collect()}
    assert gone == {2000} | {3000 + i for i in range(0, 200, 5)}, "pipe tables anywhere, what has many symbols where that is usual"


def test_filter_judges_each_row_whatever_its_id(spark):
    clean = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(None, clean, "a"), (None, "short", "a"), (None, None, None), (7, clean, None), (7, "short", None)], "doc_id long, text string, source string")
    assert [(r.doc_id, r.text) for r in quality.kept_documents(docs).orderBy("doc_id").collect()] == [(None, clean), (7, clean)]


def test_native(spark):
    plan = quality.measures(documents(spark, ["a"]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)

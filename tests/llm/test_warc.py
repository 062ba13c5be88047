import gzip
import hashlib
import io

import pytest
from helpers import prose

from fairlead.llm import warc

BIG = ["<p>" + t + "</p>" for t in prose(11, 4, words=900)]
BIG = [b + "x" * 1000 for b in BIG]
PAGES = [(1, "http://a/1", BIG[0]), (2, "http://a/2", BIG[0]), (3, None, BIG[1]), (4, "http://b/x y\r\nEvil: 1", BIG[0]), (5, "u", "small"), (6, "u", "small"), (7, "u", None), (8, "é", "é" * 600), (9, "é", "é" * 600), (10, "u", "a" * 999), (11, "u", "a" * 999), (12, "u", "b\r\n\r\nWARC/1.1\r\n" * 100)]


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(*p, 0, "x") for p in PAGES], "page_id long, url string, html string, record_type int, payload string").repartition(3)
    path = warc.write_pages(df, str(tmp_path / "w"))
    got = {r.page_id: r for r in warc.read_pages(spark, path).collect()}
    assert len(got) == len(PAGES)
    for i, _, html in PAGES:
        raw = (html or "").encode()
        last = max(j for j, _, h in PAGES if (h or "") == (html or ""))
        revisit = len(raw) >= 1000 and last != i
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (got[i].record_type, got[i].refers_to) == (("revisit", last) if revisit else ("response", None)), i
    full = {r.record_id: r for r in spark.read.format("warc").load(path).collect()}
    assert full["<urn:page:2>"].payload is None and bytes(full["<urn:page:4>"].payload).decode() == BIG[0]
    assert full["<urn:page:4>"].target_uri == "http://b/x%20y%0D%0AEvil:%201" and full["<urn:page:3>"].target_uri is None


def test_pushdown_skips_payloads(spark, tmp_path):
    path = warc.write_pages(spark.createDataFrame(PAGES, "page_id long, url string, html string"), str(tmp_path / "w"))
    one = spark.read.format("warc").load(path).where("record_type = 'revisit'")
    assert sorted(r.record_id for r in one.collect()) == ["<urn:page:1>", "<urn:page:2>", "<urn:page:8>"]
    reader = warc.WarcReader({"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), In(("target_uri",), ("u",)), GreaterThan(("content_length",), 1)]))
    assert len(left) == 1 and len(reader.tests) == 2
    rows = [x for p in reader.partitions() for b in reader.read(p) for x in b.to_pylist()]
    assert {r["record_id"] for r in rows} == {f"<urn:page:{i}>" for i in (5, 6, 7, 10, 11, 12)}
    none = spark.read.format("warc").option("payload", "none").load(path)
    assert all(r.payload is None for r in none.collect())


def test_files_roll_over_and_plain_archives_can_be_read(spark, tmp_path):
    warc.register(spark)
    df = warc.as_records(spark.createDataFrame(PAGES, "page_id long, url string, html string")).coalesce(1)
    df.write.format("warc").option("fileBytes", 1000).mode("append").save(str(tmp_path / "many"))
    files = sorted((tmp_path / "many").glob("*.warc.gz"))
    assert len(files) > 2 and spark.read.format("warc").load(str(tmp_path / "many")).count() == len(PAGES)
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "x.warc").write_bytes(b"".join(gzip.decompress(f.read_bytes()) for f in files))
    assert spark.read.format("warc").load(str(tmp_path / "plain")).count() == len(PAGES)


def test_cut_off_archive_is_an_error():
    raw = warc.WarcWriter.record("urn:x", "response", "u", None, b"payload")
    assert len(list(warc.records(io.BytesIO(raw), False, lambda r: True, "full"))) == 1
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(raw[:-20]), False, lambda r: True, "full"))


def test_empty_and_repeated(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_pages(spark, warc.write_pages(empty, str(tmp_path / "e"))).count() == 0
    twice = spark.createDataFrame([(1, "u", BIG[0]), (1, "u", BIG[0]), (None, "u", BIG[0])], "page_id long, url string, html string")
    got = warc.read_pages(spark, warc.write_pages(twice, str(tmp_path / "t"))).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got) == [(0, "revisit", 1), (1, "response", None), (1, "response", None)]


def test_a_second_write_leaves_the_first(spark, tmp_path):
    for rows in (PAGES[:5], PAGES[5:], PAGES[:1]):
        path = warc.write_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    ids = sorted(r.page_id for r in warc.read_pages(spark, path).collect())
    assert ids == sorted([p[0] for p in PAGES] + [1])


def test_frequent_and_rare_payloads_join_alike(spark, tmp_path, monkeypatch):
    for large in (1, 10**9):  # none is frequent but a lone one; all are
        monkeypatch.setattr(warc, "LARGE", large)
        df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
        got = {r.page_id: r.refers_to for r in warc.read_pages(spark, warc.write_pages(df, str(tmp_path / str(large)))).collect()}
        assert got == {p[0]: {1: 4, 2: 4, 8: 9}.get(p[0]) for p in PAGES}


def test_the_query_pushes_the_record_type_down(spark, sf):
    from fairlead.llm.queries import queries

    plan = queries()["op9_warc"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchScan warc") == 2 and "Filter (isnotnull(record_type" not in plan.replace("PushedFilters", ""), plan

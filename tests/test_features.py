"""Documents cut at any place give the features of the whole document."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fairlead.sources import features, points


def cut_in_memory(text, sizes):
    """The two passes without Spark, over blocks that begin behind closing braces."""
    pieces, blocks = text.split("}"), []
    if pieces[-1] == "":
        pieces.pop()
    at = 0
    for n in sizes:
        blocks.append(pieces[at : at + n])
        at += n
    blocks.append(pieces[at:])
    in_string, depth, kinds, out, open_ = False, 0, [-1, -1], [], None
    for block in blocks:
        chunk = "".join(p + "}" for p in block)
        both = [features.Summary(False), features.Summary(True)]
        for s in both:
            s.feed(chunk)
        cutter = features.Cutter(in_string, depth, tuple(kinds))
        for kind, t in cutter.feed(chunk):
            out.append(open_ + t if kind == "head" else t)
        if cutter.rest():
            kind, t = cutter.rest()
            open_ = t if kind == "tail" else open_ + t
        s = both[int(in_string)]
        for k, v in s.last.items():
            if 0 <= depth + k < 2:
                kinds[depth + k] = v
        depth, in_string = depth + s.depth, s.in_string
    return out


leaf = st.one_of(st.none(), st.booleans(), st.integers(-9, 9), st.text(alphabet='ab{}[]"\\:,é\n', max_size=12), st.just("features"))
tree = st.recursive(leaf, lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.sampled_from(["features", "a", '"', "}{", "\\"]), x, max_size=3)), max_leaves=12)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.dictionaries(st.sampled_from(["geometry", "properties", "features", "x}"]), tree, max_size=3), max_size=5), st.dictionaries(st.sampled_from(["type", "crs", "bbox", '"features']), tree, max_size=3), st.lists(st.integers(0, 4), max_size=8), st.booleans(), st.sampled_from([None, 1]))
def test_any_cut_gives_the_features(found, around, sizes, first, indent):
    doc = {"features": found, **around} if first else {**around, "features": found}
    text = json.dumps(doc, ensure_ascii=False, indent=indent)
    assert [json.loads(x) for x in cut_in_memory(text, sizes)] == found
    assert [json.loads(x) for x in cut_in_memory(json.dumps(found, indent=indent), sizes)] == found


def feature(r, i):
    text = "".join(r.choice('xy {}[]"\\\n,:é') for _ in range(r.randint(0, 40)))
    return {"type": "Feature", "geometry": {"type": "Point", "coordinates": [i / 100, -i / 200]}, "properties": {"class_code": "OPEN_SEA", "noaa_type": text, "elevation": i, "features": [{"a": [1, {"b": "}"}]}]}}


@pytest.mark.parametrize("indent", [None, 2])
def test_one_file_of_many_blocks(spark, tmp_path, indent):
    r = random.Random(1)
    rows = [feature(r, i) for i in range(3000)]
    rows[1500]["properties"]["noaa_type"] = "} {" * 20_000  # longer than many blocks
    doc = {"type": "FeatureCollection", "crs": {"features": [{"no": 1}], "x": "{\"features\": [{}]"}, "features": rows, "after": [{"no": 2}]}
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.geojson").write_text("﻿" + json.dumps(doc, indent=indent, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "d" / "b.geojson").write_text(json.dumps({"features": [feature(r, 9)]}) + "\n")
    (tmp_path / "d" / "c.geojson").write_text('{"type": "FeatureCollection", "features": []}')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        found = features.objects(spark, str(tmp_path / "d"))
        got = [json.loads(x.text) for x in found.collect()]
        read = points.read_geojson(spark, str(tmp_path / "d"))
        table = read.select("longitude", "noaa_type").collect()
        assert spark.read.option("lineSep", "}").text(str(tmp_path / "d")).rdd.getNumPartitions() > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    key = json.dumps
    want = [*rows, json.loads((tmp_path / "d" / "b.geojson").read_text())["features"][0]]
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert sorted((x.longitude, x.noaa_type) for x in table) == sorted((w["geometry"]["coordinates"][0], w["properties"]["noaa_type"]) for w in want)
    assert points.read_geojson(spark, str(tmp_path / "d"), limit=7).count() == 7


def test_nothing_to_read(spark, tmp_path):
    for i, text in enumerate(["", "{}", '{"features": []}', "not json } {", '{"type": "x", "other": [{}]}', '{"a": {"features": [{"geometry": 1}]}}']):
        (tmp_path / f"{i}.geojson").write_text(text)
        assert features.objects(spark, str(tmp_path / f"{i}.geojson")).count() == 0
        with pytest.raises(points.DataLoadError):
            points.read_geojson(spark, str(tmp_path / f"{i}.geojson"))

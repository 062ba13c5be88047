"""The great circle as a method, comparisons of methods and what is written of them."""

import json
import math

import pytest
from pyspark.sql import functions as F

from fairlead.operators import lattice, tracks
from fairlead.plans import planner
from fairlead.sources import sinks


def square(spark, wall=None, n=20):
    specs = spark.createDataFrame([("m", 50.0, 0.0, 0.25, n, n)], "lattice_id string, south double, west double, resolution double, n_rows int, n_cols int")
    shut = (F.col("col") == 10) & (F.col("row") < wall) if wall else F.lit(False)
    return lattice.with_cost(lattice.classify(lattice.meshes(specs), F.when(shut, 3).otherwise(0), F.lit(1.0)))


VOYAGES = "voyage_id long, lattice_id string, start_row int, start_col int, goal_row int, goal_col int"


def test_the_great_circle_is_a_method(spark):
    v = spark.createDataFrame([(1, "m", 2, 2, 2, 17), (2, "m", 17, 3, 17, 17), (3, "m", 4, 4, 4, 4)], VOYAGES)
    got = {r.voyage_id: r for r in planner.great_circle(square(spark, wall=8), v).collect()}
    assert (got[1].status, got[1].cost) == ("no_path", math.inf) and got[2].status == "found" and got[3].km == 0
    a = 2 * 6371.0088 * math.asin(math.sqrt(math.cos(math.radians(54.25)) ** 2 * math.sin(math.radians(14 * 0.25 / 2)) ** 2))
    assert got[2].km == pytest.approx(a) and got[2].cost == pytest.approx(a)


def test_comparison_of_all_methods(spark):
    v = spark.createDataFrame([(1, "m", 2, 2, 2, 17), (2, "m", 17, 3, 17, 17)], VOYAGES)
    results = planner.compare(square(spark, wall=8), v, planner.Parameters(generations=60, population=30)).persist()
    assert results.groupBy("voyage_id").count().where("count = 5").count() == 2
    rows = {r.voyage_id: r for r in planner.comparison(results).collect()}
    by = {(r.voyage_id, r.method): r for r in results.collect()}
    for i, r in rows.items():
        assert r.optimality_gap_pct == r.dynamic_gap_pct == 0 and r.genetic_gap_pct >= 0 and r.astar_found
        assert r.node_reduction == pytest.approx(by[i, "dijkstra"].nodes / by[i, "astar"].nodes, abs=0.006)
        assert r.detour_pct == pytest.approx(100 * (by[i, "astar"].km / by[i, "great_circle"].km - 1))
    assert (rows[1].direct_open, rows[2].direct_open) == (False, True)
    s = planner.comparison_summary(planner.comparison(results)).first()
    assert (s.n_voyages, s.great_circles_over_land, s.exact_methods_agree, s.astar_found) == (2, 1, True, 2)
    ports = spark.createDataFrame([(1, 50.5, 0.5, 50.5, 4.25), (2, 54.25, 0.75, 54.25, 4.25)], "voyage_id long, lat1 double, lon1 double, lat2 double, lon2 double")
    docs = {r.voyage_id: r for r in sinks.comparison_document(results, ports, 1.5).collect()}
    assert docs[1].name == "compare_50.50N_000.50E_50.50N_004.25E_5-methods_1.50s"
    d = json.loads(docs[1].document)
    assert d["start"] == [50.5, 0.5] and [r["method"] for r in d["results"]] == sorted((*planner.METHODS, "great_circle")) and next(r for r in d["results"] if r["method"] == "great_circle")["cost"] is None


def test_names_that_repeat_are_numbered(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "a")], "id long, name string")
    assert [r.name for r in sinks.unique_names(rows, "id").orderBy("id").collect()] == ["a", "a-2", "b", "a-3"]
    taken = spark.createDataFrame([("a",), ("a-2",)], "name string")
    assert [r.name for r in sinks.unique_names(rows, "id", taken).orderBy("id").collect()] == ["a-3", "a-4", "b", "a-5"]


def test_export_all(spark, tmp_path):
    track = spark.createDataFrame([(i, k, 50.0 + k, 3.0 + i, "OPEN_SEA", 1.0) for i in (1, 2) for k in range(3)], "route_id long, seq int, lat double, lon double, class_code string, cost double")
    points = spark.createDataFrame([(1, 50.0, 3.0, "OPEN_SEA")], "id long, latitude double, longitude double, class_code string")
    folders = sinks.export_all(track, str(tmp_path), points, "astar")
    assert sorted(folders) == ["csv", "geojson", "points_csv", "points_geojson"]
    found = [json.loads(line) for f in (tmp_path / "geojson").glob("part-*") for line in f.read_text().splitlines()]
    assert len(found) == 2 and all(len(g["features"]) == 4 for g in found)
    assert len(list((tmp_path / "csv").glob("route_id=*"))) == 2
    assert spark.read.text(folders["points_csv"]).first().value.endswith("OPEN_SEA")


def test_reported_points_are_thinned_upwards(spark):
    rows = spark.createDataFrame([(n, i) for n in (1, 60, 61, 130) for i in range(n)], "route_id long, i int")
    got = {r.route_id: r["count"] for r in tracks.reported_points(rows).groupBy("route_id").count().collect()}
    assert got == {n: len(range(0, n, max(1, math.ceil(n / 60)))) for n in (1, 60, 61, 130)}

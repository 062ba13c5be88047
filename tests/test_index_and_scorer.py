"""The stored index and the batched scorer against plain versions."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairlead.functions.zones import CLASSES
from fairlead.operators import knn, lattice, scorer, stats
from fairlead.sources import fixtures, sinks


def points(spark, n, seed, box=(-90, 90, -180, 180)):
    r = random.Random(seed)
    rows = [(i, r.uniform(*box[:2]), r.uniform(*box[2:])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, latitude double, longitude double")


def rows_of(df):
    return sorted((r.q_id, r["rank"], r.r_id, r.km) for r in df.collect())


def test_a_stored_index_gives_the_same_neighbours(spark, tmp_path):
    whole = points(spark, 3000, 1)
    knn.save_index(whole, str(tmp_path / "i"))
    stored = knn.load_index(spark, str(tmp_path / "i"))
    assert stored.points.count() == 3000 and stored.margin == pytest.approx(knn._spacing(whole))
    for asked in (points(spark, 60, 2), points(spark, 40, 3, (50, 52, 3, 6)), points(spark, 20, 4, (88, 90, -180, 180)), points(spark, 20, 5, (-1, 1, 179, 180))):
        assert rows_of(knn.neighbours(asked, stored, 5)) == rows_of(knn.neighbours(asked, whole, 5))
    assert rows_of(knn.neighbours(points(spark, 3, 2), stored, 5, cell_km=50.0)) == rows_of(knn.neighbours(points(spark, 3, 2), whole, 5))


def test_a_query_reads_the_files_of_its_tiles_only(spark, tmp_path):
    whole = points(spark, 3000, 1)
    knn.save_index(whole, str(tmp_path / "i"))
    stored = knn.load_index(spark, str(tmp_path / "i"))
    near = stored.near(points(spark, 40, 3, (50, 52, 3, 6)), 0.01)
    plan = near._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "tile" in plan.split("PartitionFilters: [")[1].split("]")[0]
    files = len(list((tmp_path / "i" / "points").glob("tile=*")))
    assert len({f for f in near.select(F.input_file_name()).distinct().collect()}) <= 4 < files
    assert stored.near(points(spark, 1, 3).limit(0), 0.01).count() == 0


def test_features_from_a_stored_index(spark, sf, tmp_path):
    p = fixtures.points(spark, sf)
    index = knn.reference_index(p)
    knn.save_index(index, str(tmp_path / "i"))
    some = p.where("id < 50")
    key = lambda df: sorted(map(tuple, df.collect()))
    got, want = key(knn.features(some, knn.load_index(spark, str(tmp_path / "i")))), key(knn.features(some, index))
    assert len(got) == 50 and all(a == pytest.approx(b) for a, b in zip(got, want))


def network(seed=1, widths=(28, 16, 16, 8)):
    g = np.random.default_rng(seed)
    norm = lambda n: scorer.Norm(g.normal(1, 0.1, n), g.normal(0, 0.1, n), g.normal(0, 0.1, n), g.uniform(0.5, 2, n))
    blocks = [scorer.Block(g.normal(0, 0.4, (a, b)), g.normal(0, 0.1, b), norm(b), *((None, None) if a == b else (g.normal(0, 0.4, (a, b)), g.normal(0, 0.1, b)))) for a, b in zip(widths, widths[1:])]
    return scorer.Network(g.normal(0, 1, 28), g.uniform(0.5, 2, 28), g.normal(0, 0.5, (widths[-1], 4)), g.normal(0, 0.1, 4), norm(28), blocks)


def plain(net, row):
    """One row, number by number."""
    h = [(x - m) / d for x, m, d in zip(row, net.mean, net.deviation)]
    norm = lambda k, v: [(x - m) / math.sqrt(s + 1e-5) * a + b for x, m, s, a, b in zip(v, k.mean, k.variance, k.scale, k.shift)]
    times = lambda v, w, b: [sum(x * w[i][j] for i, x in enumerate(v)) + b[j] for j in range(len(b))]
    h = norm(net.norm, h)
    for k in net.blocks:
        z = norm(k.norm, times(h, k.w, k.b))
        h = [0.5 * x * (1 + math.erf(x / math.sqrt(2))) + y for x, y in zip(z, h if k.p is None else times(h, k.p, k.q))]
    z = times(h, net.w, net.b)
    e = [math.exp(x - max(z)) for x in z]
    return [x / sum(e) for x in e]


def test_probabilities_equal_a_row_by_row_version(spark, tmp_path):
    net = network()
    scorer.save(net, str(tmp_path / "n.npz"))
    net = scorer.load(spark, str(tmp_path / "n.npz"))
    r = random.Random(2)
    rows = [(i, *[r.gauss(0, 2) for _ in range(28)]) for i in range(200)]
    rows[3] = (3, None, float("nan"), float("inf"), *rows[3][4:])
    table = spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} double" for n in knn.FEATURES)).repartition(3)
    for got in scorer.score(table, net).collect():
        row = [x if x is not None and math.isfinite(x) else 0.0 for x in rows[got.id][1:]]
        want = plain(net, row)
        assert [got[p] for p in scorer.PROBABILITIES] == pytest.approx(want)
        assert (got.class_index, got.class_code, got.confidence) == (want.index(max(want)), CLASSES[want.index(max(want))], pytest.approx(max(want)))
    assert scorer.score(table.limit(0), net).count() == 0


def test_cells_are_scored_into_a_cost_map_and_points_into_files(spark, sf):
    p = fixtures.points(spark, sf)
    index = knn.reference_index(p)
    specs = spark.createDataFrame([("a", 50.0, 3.0, 0.5, 4, 5)], "lattice_id string, south double, west double, resolution double, n_rows int, n_cols int")
    cells = scorer.score_cells(lattice.meshes(specs), index, network())
    assert cells.count() == 20 and {r.cost for r in lattice.with_cost(cells).select("cost").collect()} <= {1.0, 1.6, 1.8, 1.8 * 1.6, 1e6}
    scored = scorer.score_points(p.where("id < 20"), index, network())
    features = [json.loads(r.feature)["properties"] for r in sinks.points_geojson(scored).collect()]
    assert len(features) == 20 and all(sum(f[p] for p in scorer.PROBABILITIES) == pytest.approx(1) for f in features)


def test_auc_of_any_scores(spark):
    r = random.Random(5)
    rows = [(i, r.random() < 0.4, r.choice([r.gauss(0, 50), r.randint(-3, 3) * 1.0, None if i % 50 == 0 else 1e9])) for i in range(800)]
    df = spark.createDataFrame(rows, "id long, y boolean, s double")
    pos, neg = [s for _, y, s in rows if y and s is not None], [s for _, y, s in rows if not y and s is not None]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    got = stats.roc_auc(df, F.col("y"), "s").first()
    assert (got.n_pos, got.n_neg) == (len(pos), len(neg)) and got.auc == pytest.approx(want)


def test_percentiles_are_exact(spark):
    r = random.Random(6)
    rows = [(g, None if r.random() < 0.1 else r.choice([r.gauss(0, 9), float(r.randint(0, 5))])) for g in "ab" for _ in range(500)] + [("c", 7.0), (None, 1.0), (None, 2.0), ("d", None), ("e", float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {x.g: x.p for x in stats.percentiles(df, "g", "x", (0.0, 0.05, 0.5, 0.95, 1.0)).collect()}
    assert set(got) == {"a", "b", "c", None}
    for g, p in got.items():
        assert p == pytest.approx(np.percentile([x for k, x in rows if k == g and x is not None], [0, 5, 50, 95, 100]).tolist())

"""Queries over lattices: cells, costs, edges and searches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fairlead.functions.geo import haversine_km
from fairlead.operators import audits, corridor, kernels, lattice, paths
from fairlead.operators.shared import written
from fairlead.plans import planner
from fairlead.plans.point_queries import POINTS_SQL, km
from fairlead.plans.registry import query
from fairlead.sources import fixtures, mask
from fairlead.sources.fixtures import COLS, LATTICES_SQL, PER_DEGREE, RESOLUTION, ROWS

#: Classified cells and their costs without and with the safety band: lattices of 250 events each, whose cells have the
#: highest class of the events that fall into them.
CELLS_SQL = f"""{POINTS_SQL}, {LATTICES_SQL},
zn AS (SELECT lattice_id, row, col, max(class_index) AS class_index, max(score) AS confidence FROM so GROUP BY ALL),
g AS (SELECT lattice_id, CAST(r AS INT) AS row, CAST(c AS INT) AS col, south+r*{RESOLUTION} AS lat, west+c*{RESOLUTION} AS lon FROM l, range({ROWS}) a(r), range({COLS}) b(c)),
k AS MATERIALIZED (SELECT g.*, CAST(coalesce(zn.class_index, 0) AS INT) AS class_index, coalesce(zn.confidence, 0.5) AS confidence FROM g LEFT JOIN zn ON g.lattice_id=zn.lattice_id AND g.row=zn.row AND g.col=zn.col),
z AS (SELECT *, CASE class_index WHEN 0 THEN 1.0 WHEN 1 THEN 1.8 ELSE 1e6 END AS zone_cost FROM k),
land AS MATERIALIZED (SELECT DISTINCT lattice_id, row+dr AS row, col+dc AS col FROM k, (VALUES (-1,0),(1,0),(0,-1),(0,1)) o(dr,dc) WHERE class_index>1),
c AS MATERIALIZED (SELECT z.lattice_id, z.row, z.col, lat, lon, class_index, confidence, zone_cost, CASE WHEN land.row IS NOT NULL AND zone_cost<1e6 THEN least(zone_cost*1.6, 1e6-1) ELSE zone_cost END AS cost FROM z LEFT JOIN land ON z.lattice_id=land.lattice_id AND z.row=land.row AND z.col=land.col) """
C = f"WITH {CELLS_SQL}"
C_RECURSIVE = f"WITH RECURSIVE {CELLS_SQL}"


def meshes(spark, d):
    return lattice.meshes(fixtures.lattices(spark, d))


def classified(spark, d):
    found = meshes(spark, d).join(fixtures.zones(spark, d), list(lattice.KEY), "left")
    return lattice.classify(found, F.coalesce("class_index", F.lit(0)), F.coalesce("confidence", F.lit(0.5)))


def costed(spark, d):
    """Written once: what a query builds of it reads the cells many times."""
    return written(lattice.with_cost(classified(spark, d)), "cells")


def land(spark, d):
    return mask.from_points(fixtures.land_points(spark, d), fixtures.PER_DEGREE)


@query(C + "SELECT lattice_id, row, col, round(lat, 9) AS lat, round(lon, 9) AS lon FROM g")
def grid_mesh(spark, d):
    return meshes(spark, d).select("lattice_id", "row", "col", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


@query(f"WITH {POINTS_SQL} SELECT id, CAST(least(49, greatest(0, round_even((latitude+60)/2.5, 0))) AS INT) AS row, CAST(least(144, greatest(0, round_even((longitude+180)/2.5, 0))) AS INT) AS col FROM p")
def grid_cell_mapping(spark, d):
    row, col = lattice.to_cell("latitude", "longitude", lattice.Spec(-60.0, -180.0, 2.5, 50, 145))
    return fixtures.points(spark, d).select("id", row.alias("row"), col.alias("col"))


@query(C + "SELECT lattice_id, row, col, class_index, zone_cost AS cost FROM z")
def grid_zone_cost(spark, d):
    return lattice.with_cost(classified(spark, d), band=0).select("lattice_id", "row", "col", "class_index", "cost")


@query(C + "SELECT lattice_id, row, col, round(cost, 9) AS cost FROM c")
def grid_safety_band(spark, d):
    return costed(spark, d).select("lattice_id", "row", "col", F.round("cost", 9).alias("cost"))


@query(C + "SELECT lattice_id, count(*) AS cells, round(avg(CAST(cost<1e6 AS INT)), 9) AS navigable_share, count(*) FILTER (class_index=0) AS open_sea, count(*) FILTER (class_index=1) AS coastal_sea, count(*) FILTER (class_index=2) AS near_coast, count(*) FILTER (class_index=3) AS coastline, round(avg(confidence), 9) AS mean_confidence FROM c GROUP BY 1")
def grid_statistics(spark, d):
    return lattice.statistics(costed(spark, d)).withColumn("navigable_share", F.round("navigable_share", 9)).withColumn("mean_confidence", F.round("mean_confidence", 9))


@query(
    C + ", b AS (SELECT lattice_id, row//4 AS row, col//4 AS col, class_index, count(*) AS n, sum(confidence) AS s FROM c GROUP BY ALL) SELECT lattice_id, CAST(row AS INT) AS row, CAST(col AS INT) AS col, CAST(arg_max(class_index, n*10-class_index) AS INT) AS class_index, round(sum(s)/sum(n), 9) AS confidence FROM b GROUP BY 1, 2, 3"
)
def grid_overlay(spark, d):
    return lattice.overlay(costed(spark, d), 4).withColumn("confidence", F.round("confidence", 9))


@query(
    C + f", s AS (SELECT lattice_id, row, col, CAST(floor((lat+a.x*{RESOLUTION}+90)*{PER_DEGREE}) AS BIGINT) AS y, CAST(floor((lon+b.x*{RESOLUTION}+180)*{PER_DEGREE}) AS BIGINT)%(360*{PER_DEGREE}) AS x FROM c, (VALUES (-1/3.0),(0.0),(1/3.0)) a(x), (VALUES (-1/3.0),(0.0),(1/3.0)) b(x))"
    " SELECT lattice_id, s.row, s.col, round(avg(CAST(lm.y IS NOT NULL AS INT)), 9) AS land_share FROM s LEFT JOIN lm ON s.y=lm.y AND s.x=lm.x GROUP BY 1, 2, 3"
)
def grid_mask_share(spark, d):
    """The share of each cell that the mask of measured heights calls land."""
    return lattice.mask_share(meshes(spark, d), land(spark, d), fixtures.RESOLUTION).withColumn("land_share", F.round("land_share", 9))


@query(
    C + ", m AS (SELECT lattice_id, cos(radians(avg(lat))) AS k FROM c GROUP BY 1), r AS (SELECT lattice_id, lat AS y, lon AS x FROM c WHERE row=col)"
    " SELECT DISTINCT c.lattice_id, c.row, c.col FROM c JOIN m USING (lattice_id) JOIN r USING (lattice_id) WHERE sqrt(pow(lat-y, 2)+pow((lon-x)*k, 2)) <= 0.6 + 1e-9"
)
def grid_corridor(spark, d):
    cells = costed(spark, d)
    route = cells.where("row = col").select("lattice_id", F.col("lat").alias("lat0"), F.col("lon").alias("lon0"))
    return lattice.corridor(cells, route, 0.6)


@query(
    C + ", q AS (SELECT lattice_id, row, col FROM c WHERE class_index>1), m AS (SELECT q.lattice_id, q.row, q.col, c.row-q.row AS dr, c.col-q.col AS dc, c.row AS r, c.col AS cc FROM q JOIN c ON q.lattice_id=c.lattice_id AND c.cost<1e6 AND abs(c.row-q.row)<=40 AND abs(c.col-q.col)<=40),"
    " o AS (SELECT *, row_number() OVER (PARTITION BY lattice_id, row, col ORDER BY greatest(abs(dr), abs(dc)), dr*dr+dc*dc, dr, dc) AS n FROM m) SELECT lattice_id || ':' || row || ':' || col AS q_id, r AS row, cc AS col FROM o WHERE n=1"
)
def grid_nearest_navigable(spark, d):
    cells = costed(spark, d)
    asked = cells.where("class_index > 1").select(F.concat_ws(":", "lattice_id", "row", "col").alias("q_id"), "lattice_id", "row", "col")
    return lattice.nearest_navigable(cells, asked)


_E = ", e AS (SELECT a.lattice_id, a.row, a.col, b.row AS to_row, b.col AS to_col, " + km("a.lat", "a.lon", "b.lat", "b.lon") + " AS km, (a.cost+b.cost)/2 AS w FROM c a JOIN c b ON a.lattice_id=b.lattice_id AND abs(a.row-b.row)<=1 AND abs(a.col-b.col)<=1 AND (a.row<>b.row OR a.col<>b.col) WHERE a.cost<1e6 AND b.cost<1e6) "


@query(C + _E + "SELECT lattice_id, row, col, to_row, to_col, round(km, 6) AS km, round(km*w, 6) AS cost FROM e")
def edges_step_cost(spark, d):
    return lattice.step_edges(costed(spark, d)).withColumn("km", F.round("km", 6)).withColumn("cost", F.round("cost", 6))


def goals(cells):
    """The last navigable cell by row and column of each lattice."""
    return cells.where("cost < 1e6").groupBy("lattice_id").agg(F.max(F.struct("row", "col")).alias("g")).select("lattice_id", "g.row", "g.col")


_GOAL = ", goal AS (SELECT lattice_id, max(row*1000+col)//1000 AS row, max(row*1000+col)%1000 AS col FROM c WHERE cost<1e6 GROUP BY 1)"
_V = _GOAL + """, v(lattice_id, row, col, value) USING KEY (lattice_id, row, col) AS (SELECT lattice_id, CAST(row AS INT), CAST(col AS INT), 0.0::DOUBLE FROM goal
 UNION SELECT e.lattice_id, e.row, e.col, min(e.km*e.w+v.value) FROM v JOIN e ON e.lattice_id=v.lattice_id AND e.to_row=v.row AND e.to_col=v.col LEFT JOIN recurring.v u ON u.lattice_id=e.lattice_id AND u.row=e.row AND u.col=e.col
 WHERE u.value IS NULL OR e.km*e.w+v.value < u.value-1e-9 GROUP BY 1, 2, 3)"""


@query(C_RECURSIVE + _E + _V + " SELECT lattice_id, row, col, round(value, 4) AS value FROM v")
def path_value_iteration(spark, d):
    cells = costed(spark, d)
    return paths.value_iteration(cells, goals(cells)).where("value is not null").withColumn("value", F.round("value", 4))


@query(
    C_RECURSIVE + _E + _V + ", s AS (SELECT e.lattice_id, e.row, e.col, min(round(e.km*e.w+v.value, 9)) AS best FROM e JOIN v ON e.lattice_id=v.lattice_id AND e.to_row=v.row AND e.to_col=v.col GROUP BY 1, 2, 3) SELECT s.lattice_id, s.row, s.col, round(s.best, 4) AS best FROM s ANTI JOIN goal g ON s.lattice_id=g.lattice_id AND s.row=g.row AND s.col=g.col"
)
def path_successors(spark, d):
    """The cost of each cell's best move (which of equal moves is taken is up to rounding)."""
    cells = costed(spark, d)
    return paths.settled(cells, goals(cells)).where("best is not null").select("lattice_id", "row", "col", F.round("best", 4).alias("best"))


@query(
    C_RECURSIVE + ", a AS (SELECT lattice_id, row, col FROM c WHERE cost<1e6), e AS MATERIALIZED (SELECT a.lattice_id, a.row, a.col, b.row AS to_row, b.col AS to_col FROM a JOIN a b ON a.lattice_id=b.lattice_id AND abs(a.row-b.row)<=1 AND abs(a.col-b.col)<=1 AND (a.row<>b.row OR a.col<>b.col)),"
    " v(lattice_id, row, col, component) USING KEY (lattice_id, row, col) AS (SELECT lattice_id, row, col, row::BIGINT*16777216+col FROM a UNION SELECT e.lattice_id, e.row, e.col, min(v.component) FROM v JOIN e ON e.lattice_id=v.lattice_id AND e.to_row=v.row AND e.to_col=v.col"
    " JOIN recurring.v u ON u.lattice_id=e.lattice_id AND u.row=e.row AND u.col=e.col WHERE v.component<u.component GROUP BY 1, 2, 3) SELECT lattice_id, row, col, component FROM v"
)
def path_components(spark, d):
    return paths.components(costed(spark, d))


def voyages(spark, d, cells):
    """A voyage for each supplier, both ends on navigable cells."""
    return written(planner.snapped(cells, fixtures.voyages(spark, d), lattice.SNAP_CELLS), "voyages")


#: Least costs of the voyages to their goals by relaxation, from each end's nearest navigable cell.
def least_sql(voyages="t"):
    return _LEAST.replace(" t)", f" {voyages})").replace(" FROM t ", f" FROM {voyages} ").replace("JOIN t USING", f"JOIN {voyages} t USING")


_LEAST = """,
ends AS (SELECT voyage_id, lattice_id, 0 AS e, r0 AS r, c0 AS cc FROM t UNION ALL SELECT voyage_id, lattice_id, 1, r1, c1 FROM t),
near AS (SELECT voyage_id, ends.lattice_id, e, c.row, c.col, row_number() OVER (PARTITION BY voyage_id, e ORDER BY greatest(abs(c.row-r), abs(c.col-cc)), (c.row-r)*(c.row-r)+(c.col-cc)*(c.col-cc), c.row-r, c.col-cc) AS n FROM ends JOIN c ON c.lattice_id=ends.lattice_id AND cost<1e6 AND abs(c.row-r)<=40 AND abs(c.col-cc)<=40),
snap AS MATERIALIZED (SELECT * FROM near WHERE n=1), m AS MATERIALIZED (SELECT *, km*w AS step FROM e),
v(voyage_id, row, col, value) USING KEY (voyage_id, row, col) AS (SELECT voyage_id, row, col, 0.0::DOUBLE FROM snap WHERE e=1
 UNION SELECT v.voyage_id, m.row, m.col, min(m.step+v.value) FROM v JOIN t USING (voyage_id) JOIN m ON m.lattice_id=t.lattice_id AND m.to_row=v.row AND m.to_col=v.col LEFT JOIN recurring.v u ON u.voyage_id=v.voyage_id AND u.row=m.row AND u.col=m.col
 WHERE u.value IS NULL OR m.step+v.value < u.value-1e-9 GROUP BY 1, 2, 3)"""


@query(
    C_RECURSIVE + _E + least_sql() + " SELECT CAST(s.voyage_id AS BIGINT) AS voyage_id, method, CASE WHEN value IS NULL THEN 'no_path' ELSE 'found' END AS status, round(coalesce(value, 'Infinity'::DOUBLE), 4) AS cost FROM snap s JOIN snap g ON g.voyage_id=s.voyage_id AND g.e=1"
    " LEFT JOIN v ON v.voyage_id=s.voyage_id AND v.row=s.row AND v.col=s.col, (VALUES ('astar'), ('dijkstra'), ('dynamic_programming')) x(method) WHERE s.e=0"
)
def path_least_costs(spark, d):
    """What the three exact methods find for each voyage: the same least cost."""
    cells = costed(spark, d)
    asked = voyages(spark, d, cells)
    found = planner.searched(cells, asked, planner.Parameters(), ("astar", "dijkstra", "dynamic_programming"))
    return found.select("voyage_id", "method", "status", F.round("cost", 4).alias("cost"))


def _search(spark, d, method):
    cells = costed(spark, d)
    found = kernels.search(cells, voyages(spark, d, cells), method)
    return found.select("voyage_id", "method", "status", F.round("cost", 4).alias("cost"), F.round("km", 4).alias("km"), "nodes", F.size("path").alias("cells"))


def _least_by(method):
    """The least cost of each voyage, which any exact method finds; which of equally cheap routes it takes differs."""
    return (
        C_RECURSIVE + _E + least_sql() + f" SELECT CAST(s.voyage_id AS BIGINT) AS voyage_id, '{method}' AS method, CASE WHEN value IS NULL THEN 'no_path' ELSE 'found' END AS status, round(coalesce(value, 'Infinity'::DOUBLE), 4) AS cost"
        " FROM snap s LEFT JOIN v ON v.voyage_id=s.voyage_id AND v.row=s.row AND v.col=s.col WHERE s.e=0"
    )


@query(_least_by("astar"))
def path_astar(spark, d):
    return _search(spark, d, "astar").select("voyage_id", "method", "status", "cost")


@query(_least_by("dijkstra"))
def path_dijkstra(spark, d):
    return _search(spark, d, "dijkstra").select("voyage_id", "method", "status", "cost")


@query()
def path_genetic(spark, d):
    return _search(spark, d, "genetic")


@query(_least_by("dynamic_programming"))
def path_greedy_route(spark, d):
    """Routes along the best moves of a finished value table: the sum of the moves that each takes."""
    cells = costed(spark, d)
    asked = voyages(spark, d, cells)
    found = planner.search(cells, asked, planner.Parameters(method="dynamic_programming"))
    points = planner.route_points(found, asked, cells)
    by = Window.partitionBy("route_id").orderBy("seq")
    step = haversine_km(F.lag("lat").over(by), F.lag("lon").over(by), "lat", "lon") * (F.lag("cost").over(by) + F.col("cost")) / 2
    taken = points.withColumn("step", step).groupBy(F.col("route_id").alias("voyage_id")).agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("sum"))
    both = found.select("voyage_id", "method", "status").join(taken, "voyage_id", "left")
    return both.select("voyage_id", "method", "status", F.round(F.coalesce("sum", F.lit(float("inf"))), 4).alias("cost"))


_DIRECT = km("a.lat", "a.lon", "b.lat", "b.lon")


@query(
    C_RECURSIVE + _E + least_sql() + f", w AS (SELECT s.voyage_id, value, {_DIRECT} AS direct FROM snap s JOIN snap g ON g.voyage_id=s.voyage_id AND g.e=1 LEFT JOIN v ON v.voyage_id=s.voyage_id AND v.row=s.row AND v.col=s.col"
    " JOIN c a ON a.lattice_id=s.lattice_id AND a.row=s.row AND a.col=s.col JOIN c b ON b.lattice_id=g.lattice_id AND b.row=g.row AND b.col=g.col WHERE s.e=0)"
    " SELECT CAST(voyage_id AS BIGINT) AS voyage_id, CASE WHEN value IS NULL THEN 'no_path' ELSE 'found' END AS status, round(coalesce(value, 'Infinity'::DOUBLE), 4) AS cost, round(direct, 4) AS direct_km FROM w"
)
def plan_voyages(spark, d):
    """Every supplier's voyage, planned; lengths of equally cheap routes may differ, so they aren't compared here."""
    return planner.plan(costed(spark, d), fixtures.voyages(spark, d)).select("voyage_id", "status", F.round("cost", 4).alias("cost"), F.round("direct_km", 4).alias("direct_km"))


_VIA = f""", tv AS MATERIALIZED (SELECT voyage_id*10 AS voyage_id, lattice_id, r0, c0, voyage_id%{ROWS} AS r1, {COLS // 2} AS c1 FROM t UNION ALL SELECT voyage_id*10+1, lattice_id, voyage_id%{ROWS}, {COLS // 2}, r1, c1 FROM t)"""


@query(
    C_RECURSIVE + _E + _VIA + least_sql("tv") + ", w AS (SELECT s.voyage_id//10 AS route_id, s.voyage_id%10 AS leg, value FROM snap s LEFT JOIN v ON v.voyage_id=s.voyage_id AND v.row=s.row AND v.col=s.col WHERE s.e=0),"
    " x AS (SELECT a.route_id, a.value AS one, b.value AS two FROM w a JOIN w b ON a.route_id=b.route_id AND a.leg=0 AND b.leg=1)"
    " SELECT CAST(route_id AS BIGINT) AS route_id, 2::BIGINT AS legs, CASE WHEN one IS NULL THEN 0 WHEN two IS NULL THEN 1 ELSE 2 END::BIGINT AS legs_done, one IS NOT NULL AND two IS NOT NULL AS feasible, round(one+CASE WHEN one IS NULL THEN NULL ELSE coalesce(two, 0) END, 3) AS cost FROM x"
)
def plan_via_points(spark, d):
    """The supplier's voyage over the middle of its lattice."""
    v = fixtures.voyages(spark, d)
    over = ((F.col("start_row"), F.col("start_col")), (F.col("voyage_id") % fixtures.ROWS, F.lit(fixtures.COLS // 2)), (F.col("goal_row"), F.col("goal_col")))
    stops = F.array(*[F.struct(F.lit(i).alias("seq"), r.cast("int").alias("row"), c.cast("int").alias("col")) for i, (r, c) in enumerate(over)])
    rows = v.select("voyage_id", "lattice_id", F.explode(stops).alias("s")).select("voyage_id", "lattice_id", "s.*")
    summary, _ = planner.plan_via(costed(spark, d), rows)
    return summary.select("route_id", "legs", "legs_done", "feasible", F.round("cost", 3).alias("cost"))


@query()
def plan_coast_guard(spark, d):
    """Routes after land of an independent mask has been blocked."""
    cells = costed(spark, d)
    best, verdict = planner.coast_guard(cells, voyages(spark, d, cells), land(spark, d), planner.Parameters())
    return best.join(verdict, "voyage_id").select("voyage_id", "status", F.round("cost", 4).alias("cost"), "verdict", F.round("longest_km", 4).alias("longest_km"), "round")


@query()
def plan_compare_methods(spark, d):
    cells = costed(spark, d)
    return planner.compare(cells, voyages(spark, d, cells)).select("voyage_id", "method", "status", F.round("cost", 4).alias("cost"), F.round("gap_pct", 4).alias("gap_pct"))


def classifier(spark, d):
    """Classes of cells of any lattice: that of the quarter degree around a cell's centre, open sea where no event fell."""
    raster = written(fixtures.zone_raster(spark, d), "zones")
    at = lambda x: F.rint(F.col(x) / fixtures.RESOLUTION).cast("int")

    def classify(cells):
        found = cells.withColumn("y", at("lat")).withColumn("x", at("lon")).join(raster, ["y", "x"], "left").drop("y", "x")
        return found.withColumn("class_index", F.coalesce("class_index", F.lit(0))).withColumn("confidence", F.coalesce("confidence", F.lit(0.5)))

    return classify


@query()
def plan_two_levels(spark, d):
    """Suppliers' voyages, refined in corridors where they cross land; no cells are blocked before that."""
    classify = classifier(spark, d)
    p = planner.Parameters(coast_rounds=0, mask_share=0.5)
    best, _ = planner.plan_refined(fixtures.lattices(spark, d), fixtures.ports(spark, d), classify, land(spark, d), p)
    return best.select("voyage_id", "status", F.round("cost", 4).alias("cost"), "verdict", F.round("longest_km", 4).alias("longest_km"), "level", "resolution", "cells")


_STEPS = [0.25]
while _STEPS[-1] < 4.0:
    _STEPS.append(round(_STEPS[-1] * 1.5, 4))


@query(
    f"WITH {POINTS_SQL}, {LATTICES_SQL}, e AS (SELECT voyage_id, south+r0*{RESOLUTION} AS a, west+c0*{RESOLUTION} AS b, south+r1*{RESOLUTION} AS y, west+c1*{RESOLUTION} AS x FROM t JOIN l USING (lattice_id)),"
    " bx AS (SELECT voyage_id, greatest(-85.0, least(a, y)-2.0) AS s, least(85.0, greatest(a, y)+2.0) AS n, greatest(-180.0, least(b, x)-2.0) AS w, least(180.0, greatest(b, x)+2.0) AS ea FROM e),"
    f" z AS (SELECT *, greatest(2, round_even((n-s)/r, 0)+1) AS rr, greatest(2, round_even((ea-w)/r, 0)+1) AS cc FROM bx, (VALUES {', '.join(f'({x}::DOUBLE)' for x in _STEPS)}) q(r)),"
    f" k AS (SELECT *, row_number() OVER (PARTITION BY voyage_id ORDER BY CASE WHEN rr*cc<=400 OR r={_STEPS[-1]} THEN 0 ELSE 1 END, r) AS i FROM z)"
    " SELECT CAST(voyage_id AS VARCHAR) AS lattice_id, s AS south, w AS west, r AS resolution, CAST(rr AS INT) AS n_rows, CAST(cc AS INT) AS n_cols FROM k WHERE i=1"
)
def grid_specs(spark, d):
    """The lattice around the ports of each supplier's voyage, of 400 cells at most."""
    return lattice.specs_around(fixtures.ports(spark, d), max_cells=400)


@query()
def plan_retries(spark, d):
    """Suppliers' voyages on boxes of their own, without a margin at first; again on wider and finer ones where there is
    no route."""
    ports = fixtures.ports(spark, d)
    p = planner.Parameters(margin_deg=0.0)
    found = planner.plan_again(planner.problem_of(ports, classifier(spark, d)), ports, p)
    return found.select("voyage_id", "attempt", "status", F.round("cost", 4).alias("cost"), F.round("direct_km", 4).alias("direct_km"))


_PASSED = f"""e AS (SELECT voyage_id, south, west, south+r0*{RESOLUTION} AS a, west+c0*{RESOLUTION} AS b, south+r1*{RESOLUTION} AS y, west+c1*{RESOLUTION} AS x FROM t JOIN l USING (lattice_id)),
k AS (SELECT *, CAST(greatest(1, ceil(greatest(abs(y-a), abs(x-b))/(0.1/2))) AS INT) AS parts, 0.1*111.2 AS dy, greatest(0.1*111.2*cos(radians((a+y)/2)), 0.001) AS dx FROM e),
passed AS (SELECT DISTINCT voyage_id, dy, dx, greatest(0, least({round((ROWS - 1) * 2.5) + 0}, round_even((a+(i/parts)*(y-a)-south)/0.1, 0))) AS row, greatest(0, least({round((COLS - 1) * 2.5) + 0}, round_even((b+(i/parts)*(x-b)-west)/0.1, 0))) AS col FROM k, range(0, 200) n(i) WHERE i<=parts),
f AS (SELECT DISTINCT voyage_id, r AS row, c AS col FROM passed, range({round((ROWS - 1) * 2.5) + 1}) a(r), range({round((COLS - 1) * 2.5) + 1}) b(c) WHERE sqrt((r-row)*dy*((r-row)*dy)+(c-col)*dx*((c-col)*dx)) <= 30.0)"""


@query(f"WITH {POINTS_SQL}, {LATTICES_SQL}, {_PASSED} SELECT voyage_id, CAST(row AS INT) AS row, count(*) AS cells, CAST(sum(col) AS BIGINT) AS cols FROM f GROUP BY 1, 2")
def corridor_cells(spark, d):
    """Fine cells within 30 km of each supplier's straight course, by row."""
    v = fixtures.ports(spark, d)
    specs = fixtures.lattices(spark, d).select(*corridor.SPEC).join(v.select("voyage_id", F.col("lattice_id")), "lattice_id")
    specs = corridor.resized(specs.withColumn("lattice_id", F.col("voyage_id").cast("string")).drop("voyage_id"), F.lit(0.1))
    ends = F.array(*[F.struct(F.lit(i).alias("seq"), F.col(f"{e}_lat").alias("lat"), F.col(f"{e}_lon").alias("lon")) for i, e in enumerate(("start", "goal"))])
    track = v.select(F.col("voyage_id").cast("string").alias("lattice_id"), F.explode(ends).alias("e")).select("lattice_id", "e.*")
    cells = corridor.cells(corridor.intervals(track, written(specs, "specs"), 30.0), specs)
    return cells.groupBy(F.col("lattice_id").cast("long").alias("voyage_id"), "row").agg(F.count(F.lit(1)).alias("cells"), F.sum("col").alias("cols"))


@query(f"WITH {POINTS_SQL}, {LATTICES_SQL}, o AS (SELECT id, CAST(floor((lat2+90)*{PER_DEGREE}) AS BIGINT) AS y, CAST(floor((lon2+180)*{PER_DEGREE}) AS BIGINT) AS x FROM p) SELECT id, lm.y IS NOT NULL AS on_land FROM o LEFT JOIN lm ON o.y=lm.y AND o.x=lm.x")
def mask_points(spark, d):
    """Which second positions are on land of the mask."""
    return land(spark, d).marked(fixtures.points(spark, d).select("id", "lat2", "lon2"), "lat2", "lon2").select("id", "on_land")


@query(f"WITH {POINTS_SQL}, {LATTICES_SQL} SELECT CAST(y//64 AS INT) AS ty, CAST(x//64 AS INT) AS tx, round(count(*)/4096, 9) AS share FROM lm GROUP BY 1, 2")
def mask_tiles(spark, d):
    """Land by tile of the mask."""
    return land(spark, d).land_share().withColumn("share", F.round("share", 9))


@query(
    f"WITH {POINTS_SQL}, {LATTICES_SQL}, s AS (SELECT id, floor((latitude+dy+90)*{PER_DEGREE}) AS y, CAST(floor((longitude+dx+180)*{PER_DEGREE}) AS BIGINT)%(360*{PER_DEGREE}) AS x FROM p, (VALUES (0.0,0.0),(0.03,0.0),(-0.03,0.0),(0.0,0.03),(0.0,-0.03)) o(dy,dx)),"
    " dry AS (SELECT DISTINCT id FROM s JOIN lm ON s.y=lm.y AND (s.x+2880)%2880=lm.x) SELECT id FROM p ANTI JOIN dry USING (id)"
)
def audit_clear_water(spark, d):
    """Points without land at their place and around it."""
    return audits.clear_water(fixtures.points(spark, d), land(spark, d)).select("id")


@query()
def audit_draw(spark, d):
    """A hundred voyages between water points of the regions."""
    v = audits.draw_voyages(fixtures.points(spark, d), land(spark, d))
    return v.select("voyage_id", "region", "start_id", "goal_id", F.round("km", 4).alias("km"))


_RASTER = f"""q AS (SELECT voyage_id, south+r0*{RESOLUTION} AS a, west+c0*{RESOLUTION} AS b, south+r1*{RESOLUTION} AS y, west+c1*{RESOLUTION} AS x FROM t JOIN l USING (lattice_id)),
bx AS (SELECT *, least(a, y)-1.0 AS so_, least(b, x)-1.0 AS we_, CAST(ceil((greatest(a, y)-least(a, y)+2.0)/0.125) AS INT)+1 AS nr, CAST(ceil((greatest(b, x)-least(b, x)+2.0)/0.125) AS INT)+1 AS nc FROM q),
ra AS (SELECT voyage_id, r, c, so_+r*0.125 AS lat, we_+c*0.125 AS lon FROM bx, range(0, 100) m(r), range(0, 130) n(c) WHERE r<nr AND c<nc),
wet AS MATERIALIZED (SELECT voyage_id, r, c, r*1000+c AS node FROM ra ANTI JOIN lm ON least(floor((greatest(-90, least(90, lat))+90)*{PER_DEGREE}), 180*{PER_DEGREE}-1)=lm.y AND CAST(floor((((lon+180)%360+360)%360)*{PER_DEGREE}) AS BIGINT)=lm.x),
ed AS MATERIALIZED (SELECT a.voyage_id, a.node, b.node AS other FROM wet a JOIN wet b ON a.voyage_id=b.voyage_id AND ((a.r=b.r AND abs(a.c-b.c)=1) OR (a.c=b.c AND abs(a.r-b.r)=1))),
se AS (SELECT voyage_id, CAST(round_even((a-so_)/0.125, 0) AS BIGINT)*1000+CAST(round_even((b-we_)/0.125, 0) AS BIGINT) AS s, CAST(round_even((y-so_)/0.125, 0) AS BIGINT)*1000+CAST(round_even((x-we_)/0.125, 0) AS BIGINT) AS g FROM bx),
reach(voyage_id, node) AS (SELECT voyage_id, node FROM wet JOIN se USING (voyage_id) WHERE node=s UNION SELECT ed.voyage_id, ed.other FROM reach JOIN ed ON ed.voyage_id=reach.voyage_id AND ed.node=reach.node)"""


@query(f"WITH RECURSIVE {POINTS_SQL}, {LATTICES_SQL}, {_RASTER} SELECT voyage_id, EXISTS (SELECT 1 FROM reach WHERE reach.voyage_id=se.voyage_id AND reach.node=se.g) AS connected FROM se")
def audit_sea_connected(spark, d):
    """Whether water joins the ports of each supplier's voyage, on a raster of the mask's cells."""
    return audits.sea_connected(fixtures.ports(spark, d), land(spark, d), 0.125, 1.0)


_PYRAMID = " UNION ALL ".join(
    f"SELECT {z} AS z, gx//{32 * 2 ** (10 - z)} AS x, gy//{32 * 2 ** (10 - z)} AS y, (gx//{2 ** (10 - z)})%32 AS px, (gy//{2 ** (10 - z)})%32 AS py, class_index, count(*) AS n, sum(score) AS s FROM m GROUP BY ALL" for z in range(11)
)


@query(
    f"WITH {POINTS_SQL}, m AS (SELECT id%4 AS class_index, score, greatest(0, least(32767, CAST(floor((longitude+180)/360*32768.0) AS INT))) AS gx, greatest(0, least(32767, CAST(floor((1-ln(tan(radians(greatest(-85.05, least(85.05, latitude))))+1/cos(radians(greatest(-85.05, least(85.05, latitude)))))/pi())/2*32768.0) AS INT))) AS gy FROM p),"
    f" a AS ({_PYRAMID}), r AS (SELECT *, sum(n) OVER w AS total, row_number() OVER (w ORDER BY n DESC, class_index) AS k FROM a WINDOW w AS (PARTITION BY z, x, y, px, py))"
    " SELECT z, x, y, px, py, CAST(total AS BIGINT) AS n, CAST(class_index AS INT) AS class_index, round(s/n, 6) AS confidence, round(greatest(0.25, least(1.0, (s/n-0.45)/0.45)), 6) AS blend FROM r WHERE k=1"
)
def grid_pyramid(spark, d):
    """Pixels of the tiles of zooms 0 to 10 that events fall into."""
    p = fixtures.points(spark, d).withColumn("class_index", (F.col("id") % 4).cast("int")).withColumn("confidence", F.col("score"))
    found = lattice.pyramid(p, lat="latitude", lon="longitude")
    return found.withColumn("confidence", F.round("confidence", 6)).withColumn("blend", F.round("blend", 6))

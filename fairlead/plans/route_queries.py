"""Queries over routes: audits, baselines, roll-ups, the result store and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairlead.operators import kernels, store, tracks
from fairlead.plans.point_queries import _TRACK, P, km, track
from fairlead.plans.registry import query
from fairlead.sources import fixtures, sinks
from fairlead.sources.fixtures import ROUTES_SQL

STEP, PORT, CROSSING = 100.0, 500.0, 300.0

_SAMPLES = P + _TRACK + f""", l AS (SELECT route_id, seq-1 AS leg, lat, lon, nla, nlo, CASE WHEN nla IS NULL THEN 1 ELSE greatest(1, CAST(ceil({km('lat', 'lon', 'nla', 'nlo')}/100.0) AS INT)) END AS parts FROM t),
x AS (SELECT route_id, leg, nla IS NULL AS last, k, CASE WHEN nla IS NULL THEN lat ELSE lat+(nla-lat)*(k/parts) END AS lat, CASE WHEN nla IS NULL THEN lon ELSE lon+(nlo-lon)*(k/parts) END AS lon FROM l, range(400) r(k) WHERE k<parts),
y AS (SELECT *, lag(lat) OVER w AS la, lag(lon) OVER w AS lo, row_number() OVER w - 1 AS i FROM x WINDOW w AS (PARTITION BY route_id ORDER BY leg, k)),
z AS (SELECT *, coalesce({km('la', 'lo', 'lat', 'lon')}, 0.0) AS km FROM y),
s AS (SELECT *, sum(km) OVER (PARTITION BY route_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS dist FROM z),
m AS (SELECT *, max(dist) OVER (PARTITION BY route_id) AS total, (((CAST(floor(lat/4) AS INT)*7+CAST(floor(lon/4) AS INT)*13)%5)+5)%5=0 AS land FROM s),
k2 AS (SELECT *, land AND dist>=500 AND dist<=total-500 AS bad FROM m),
b AS (SELECT *, bad AND NOT coalesce(lag(bad) OVER (PARTITION BY route_id ORDER BY i), false) AS start FROM k2),
n AS (SELECT *, sum(CAST(start AS INT)) OVER (PARTITION BY route_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM b),
runs AS (SELECT route_id, run, min(dist) AS start_km, sum(CASE WHEN start THEN 100.0 ELSE km END) AS length_km, count(*) AS n FROM n WHERE bad GROUP BY 1, 2),
v AS (SELECT r.route_id, CASE WHEN count(u.run)=0 THEN 'clear' WHEN max(length_km)>=300 THEN 'crossing' ELSE 'grazing' END AS verdict, coalesce(max(length_km), 0.0) AS longest_km, coalesce(sum(length_km), 0.0) AS land_km, count(u.run) AS n_runs FROM (SELECT DISTINCT route_id FROM t) r LEFT JOIN runs u USING (route_id) GROUP BY 1) """


def on_land():
    """An arithmetic land mask."""
    return F.pmod(F.floor(F.col("lat") / 4) * 7 + F.floor(F.col("lon") / 4) * 13, F.lit(5)) == 0


def audited(spark, d):
    return tracks.audited(track(spark, d), on_land(), PORT, STEP)


def verdicts(spark, d):
    return tracks.verdicts(track(spark, d), audited(spark, d)[0], CROSSING)


@query(_SAMPLES + "SELECT route_id, count(*) AS n, round(max(dist), 3) AS km, count(*) FILTER (land) AS on_land, count(*) FILTER (bad) AS counted FROM k2 GROUP BY 1")
def audit_sample_route(spark, d):
    return audited(spark, d)[1].select("route_id", "n", F.round("km", 3).alias("km"), "on_land", "counted")


@query(_SAMPLES + "SELECT route_id, CAST(run AS BIGINT) AS run, round(start_km, 2) AS start_km, round(length_km, 2) AS length_km, n FROM runs")
def audit_land_runs(spark, d):
    r, _ = audited(spark, d)
    return r.select("route_id", "run", F.round("start_km", 2).alias("start_km"), F.round("length_km", 2).alias("length_km"), "n")


@query(_SAMPLES + "SELECT route_id, verdict, round(longest_km, 3) AS longest_km, round(land_km, 3) AS land_km, n_runs FROM v")
def audit_verdicts(spark, d):
    return verdicts(spark, d).withColumn("longest_km", F.round("longest_km", 3)).withColumn("land_km", F.round("land_km", 3))


@query(_SAMPLES + "SELECT route_id%4 AS fleet, count(*) AS n, count(*) FILTER (verdict='clear') AS clear, count(*) FILTER (verdict='grazing') AS grazing, count(*) FILTER (verdict='crossing') AS crossing, round(avg(land_km), 4) AS mean_land_km FROM v GROUP BY 1")
def audit_summary(spark, d):
    judged = verdicts(spark, d).withColumn("fleet", F.col("route_id") % 4)
    return tracks.audit_summary(judged, "fleet").withColumn("mean_land_km", F.round("mean_land_km", 4))


_ENDS = f"""SELECT * FROM runs),
kp AS (SELECT route_id, min(i) FILTER (dist>=500 AND dist<=total-500) AS i0, max(i) FILTER (dist>=500 AND dist<=total-500) AS i1, min(dist) FILTER (dist>=500 AND dist<=total-500) AS d0, max(dist) FILTER (dist>=500 AND dist<=total-500) AS d1, any_value(total) AS total FROM m GROUP BY 1),
qy AS (SELECT m.route_id, bool_or(i=i0-1 AND land) AS q0, bool_or(i=i1+1 AND land) AS q1 FROM m JOIN kp USING (route_id) GROUP BY 1),
lg AS (SELECT route_id, arg_min(km, seq) AS first_km, arg_max(km, seq) AS last_km FROM (SELECT route_id, seq, {km('lat', 'lon', 'nla', 'nlo')} AS km FROM t WHERE nla IS NOT NULL) GROUP BY 1)
SELECT route_id, CAST(run AS BIGINT) AS run, round(length_km, 2) AS length_km, (q0 AND start_km<=d0+1e-6 AND start_km+length_km<=greatest(least(first_km, 6500.0), 500.0)+100) OR (q1 AND start_km+length_km>=d1-100-1e-6 AND start_km>=total-greatest(least(last_km, 6500.0), 500.0)-100) AS approach
FROM u_ JOIN kp USING (route_id) JOIN qy USING (route_id) JOIN lg USING (route_id)"""


@query(_SAMPLES + ", u_ AS (" + _ENDS)
def audit_approaches(spark, d):
    """Land runs with the flag of port approaches."""
    from pyspark.sql import Window

    from fairlead.functions.geo import haversine_km

    t = track(spark, d)
    w = Window.partitionBy("route_id").orderBy("seq")
    legs = t.withColumn("km", haversine_km("lat", "lon", F.lead("lat").over(w), F.lead("lon").over(w))).where("km is not null")
    ends = legs.groupBy("route_id").agg(F.min_by("km", "seq").alias("first_leg_km"), F.max_by("km", "seq").alias("last_leg_km"))
    runs, routes = audited(spark, d)
    found = tracks.flagged(runs, routes, ends, PORT, STEP, 6500.0)
    return found.select("route_id", "run", F.round("length_km", 2).alias("length_km"), "approach")


_GC = P + f""", v AS (SELECT *, cos(radians(latitude))*cos(radians(longitude)) AS ax, cos(radians(latitude))*sin(radians(longitude)) AS ay, sin(radians(latitude)) AS az, cos(radians(lat2))*cos(radians(lon2)) AS bx, cos(radians(lat2))*sin(radians(lon2)) AS by_, sin(radians(lat2)) AS bz FROM p),
o AS (SELECT *, acos(greatest(-1.0, least(1.0, ax*bx+ay*by_+az*bz))) AS w FROM v), g AS (SELECT o.id, w, k, ax, ay, az, bx, by_, bz, sin((1-k/39.0)*w)/sin(w) AS wa, sin(k/39.0*w)/sin(w) AS wb FROM o, range(40) r(k) WHERE w>=1e-6),
h AS (SELECT id, k, degrees(atan2(wa*az+wb*bz, sqrt((wa*ax+wb*bx)*(wa*ax+wb*bx)+(wa*ay+wb*by_)*(wa*ay+wb*by_)))) AS lat, degrees(atan2(wa*ay+wb*by_, wa*ax+wb*bx)) AS lon FROM g),
q AS (SELECT *, CAST((((CAST(floor(lat/4+0.0001) AS INT)*7+CAST(floor(lon/4+0.0001) AS INT)*13)%9)+9)%9 AS INT) AS c, lag(lat) OVER w AS la, lag(lon) OVER w AS lo FROM h WINDOW w AS (PARTITION BY id ORDER BY k)),
u AS (SELECT *, CASE WHEN c=0 THEN 3 WHEN c<3 THEN 1 ELSE 0 END AS zone, coalesce({km('la', 'lo', 'lat', 'lon')}, 0.0) AS km FROM q) """


@query(
    _GC + "SELECT id AS voyage_id, round(sum(km), 4) AS km, round(CASE WHEN count(*) FILTER (zone>1 AND k>0)=0 THEN sum(CASE WHEN k>0 THEN km*CASE zone WHEN 0 THEN 1.0 ELSE 1.8 END END) END, 3) AS cost, count(*) FILTER (zone>1) AS land_points, count(*) FILTER (zone>1 AND k>0 AND k<39) AS interior_land,"
    " count(*) FILTER (zone=0) AS zone_0, count(*) FILTER (zone=1) AS zone_1, count(*) FILTER (zone=2) AS zone_2, count(*) FILTER (zone=3) AS zone_3 FROM u GROUP BY 1"
)
def baseline_great_circle(spark, d):
    from fairlead.functions.geo import haversine_km

    v = fixtures.points(spark, d).select(F.col("id").alias("voyage_id"), F.col("latitude").alias("lat1"), F.col("longitude").alias("lon1"), "lat2", "lon2").where(haversine_km("lat1", "lon1", "lat2", "lon2") > 0.01)

    def zone(lat, lon):
        c = F.pmod(F.floor(lat / 4 + 0.0001) * 7 + F.floor(lon / 4 + 0.0001) * 13, F.lit(9))
        return F.when(c == 0, 3).when(c < 3, 1).otherwise(0)

    b = tracks.great_circle_baseline(v, zone, 40)
    return b.withColumn("km", F.round("km", 4)).withColumn("cost", F.round("cost", 3))


@query(P + _TRACK + "SELECT route_id, count(*) FILTER (class_code='OPEN_SEA') AS open_sea, count(*) FILTER (class_code='COASTAL_SEA') AS coastal_sea, count(*) FILTER (class_code='NEAR_COAST') AS near_coast, count(*) FILTER (class_code='COASTLINE') AS coastline FROM t GROUP BY 1")
def zone_profile(spark, d):
    return tracks.zone_profile(track(spark, d))


def _legs(spark, d):
    return fixtures.waypoints(spark, d).select(
        "route_id", F.col("seq").alias("leg"), (F.col("cost") / 3.0).alias("km"), "cost", F.get(F.array(*map(F.lit, ("clear", "grazing", "crossing"))), (F.col("seq") * 2 + F.col("route_id")).cast("int") % 3).alias("verdict"), (F.col("route_id") % 6 != 0).alias("feasible")
    )


R = f"WITH {ROUTES_SQL} "


@query(
    R + ", l AS (SELECT route_id, seq AS leg, cost/3.0 AS km, cost, ['clear','grazing','crossing'][(seq*2+route_id)%3+1] AS verdict, route_id%6<>0 AS feasible FROM wp), o AS (SELECT *, coalesce(sum(km) OVER (PARTITION BY route_id ORDER BY leg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS off FROM l)"
    " SELECT route_id, count(*) AS legs, round(sum(km), 3) AS km, round(sum(cost), 3) AS cost, ['clear','grazing','crossing'][max(CASE verdict WHEN 'crossing' THEN 3 WHEN 'grazing' THEN 2 ELSE 1 END)] AS verdict, bool_and(feasible) AS feasible, round(max(off), 3) AS last_offset_km FROM o GROUP BY 1"
)
def leg_rollup(spark, d):
    r = tracks.leg_rollup(_legs(spark, d))
    return r.select("route_id", "legs", F.round("km", 3).alias("km"), F.round("cost", 3).alias("cost"), "verdict", "feasible", F.round("last_offset_km", 3).alias("last_offset_km"))


@query(R + ", b AS (SELECT session_id AS voyage_id, route_id, algorithm AS method, total_cost AS cost, min(CASE WHEN algorithm IN ('dynamic_programming','dijkstra') THEN total_cost END) OVER (PARTITION BY session_id) AS opt FROM r) SELECT voyage_id, route_id, method, round(opt, 3) AS optimum, round((cost-opt)/opt*100, 4) AS gap_pct FROM b")
def method_gaps(spark, d):
    r = fixtures.routes(spark, d).select(F.col("session_id").alias("voyage_id"), "route_id", F.col("algorithm").alias("method"), F.col("total_cost").alias("cost"))
    return tracks.method_gaps(r).select("voyage_id", "route_id", "method", F.round("optimum", 3).alias("optimum"), F.round("gap_pct", 4).alias("gap_pct"))


@query(P + _TRACK + ", n AS (SELECT *, count(*) OVER (PARTITION BY route_id) AS n FROM t) SELECT route_id, seq FROM n WHERE (seq-1)%greatest(1, n//20)=0 OR seq=n")
def track_thinned(spark, d):
    return tracks.thinned(track(spark, d), 20).select("route_id", "seq")


@query()
def simplify_track(spark, d):
    return kernels.simplify(track(spark, d), 300.0)


# ---- the store

_SUMMARY = R + ", s AS (SELECT r.route_id, algorithm, coalesce(status, CASE WHEN feasible THEN 'found' ELSE 'no_path' END) AS status, total_cost, distance_km, created, count(w.route_id) AS n_waypoints FROM r LEFT JOIN wp w ON r.route_id=w.route_id GROUP BY ALL) "


@query(_SUMMARY + "SELECT route_id, algorithm, status, total_cost, created, n_waypoints FROM s")
def store_route_summary(spark, d):
    return store.route_summary(fixtures.routes(spark, d), fixtures.waypoints(spark, d)).drop("distance_km")


@query(_SUMMARY + "SELECT route_id, status, n_waypoints FROM s ORDER BY created DESC, route_id DESC LIMIT 20")
def store_latest_routes(spark, d):
    """A report: the newest twenty."""
    return store.latest(store.route_summary(fixtures.routes(spark, d), fixtures.waypoints(spark, d))).select("route_id", "status", "n_waypoints")


@query(R + "SELECT class_code, count(*) AS n FROM wp GROUP BY 1")
def store_class_histogram(spark, d):
    return store.class_histogram(fixtures.waypoints(spark, d))


@query(R + "SELECT algorithm, count(*) AS n, round(avg(total_cost), 4) AS mean_cost, round(avg(distance_km), 4) AS mean_km, round(avg(CAST(feasible AS INT)), 9) AS feasible_share FROM r GROUP BY 1")
def store_statistics(spark, d):
    s = store.algorithm_statistics(fixtures.routes(spark, d))
    return s.select("algorithm", "n", F.round("mean_cost", 4).alias("mean_cost"), F.round("mean_km", 4).alias("mean_km"), F.round("feasible_share", 9).alias("feasible_share"))


@query(R + "SELECT 'route' AS name, count(*) AS n FROM r UNION ALL SELECT 'waypoint', count(*) FROM wp")
def store_counts(spark, d):
    return store.counts(route=fixtures.routes(spark, d), waypoint=fixtures.waypoints(spark, d))


@query(R + "SELECT 'route_id unique' AS rule, count(*) FILTER (n>1) AS n FROM (SELECT route_id, count(*) AS n FROM r GROUP BY 1) UNION ALL SELECT 'seq unique', 0 UNION ALL SELECT 'waypoint has route', count(*) FROM wp ANTI JOIN r USING (route_id) UNION ALL SELECT 'waypoint has zone', 0")
def store_violations(spark, d):
    return store.violations(fixtures.routes(spark, d), fixtures.waypoints(spark, d), store.zones(spark))


@query(R + "SELECT route_id, CAST(seq AS INT) AS seq, class_code, CASE class_code WHEN 'OPEN_SEA' THEN 'Open Sea' WHEN 'COASTAL_SEA' THEN 'Coastal Sea' WHEN 'NEAR_COAST' THEN 'Near Coast' ELSE 'Coastline' END AS title, CASE class_code WHEN 'OPEN_SEA' THEN 1.0 WHEN 'COASTAL_SEA' THEN 1.8 ELSE -1.0 END AS weight FROM wp")
def store_waypoint_zones(spark, d):
    return store.with_zone(fixtures.waypoints(spark, d), store.zones(spark)).select("route_id", "seq", "class_code", "title", "weight")


# ---- sinks


@query()
def sink_route_geojson(spark, d):
    from fairlead.functions.zones import zone_weight

    return sinks.route_geojson(track(spark, d).withColumn("cost", zone_weight("class_code")))


@query(P + "SELECT id, printf('%.6f', latitude) || ',' || printf('%.6f', longitude) || ',' || class_code AS line FROM p")
def sink_points_csv(spark, d):
    return sinks.points_csv(fixtures.points(spark, d))


@query(P + "SELECT id, printf('%05.2f', abs(latitude)) || CASE WHEN latitude<0 THEN 'S' ELSE 'N' END || '_' || printf('%06.2f', abs(longitude)) || CASE WHEN longitude<0 THEN 'W' ELSE 'E' END AS tag FROM p")
def sink_coordinate_tag(spark, d):
    return fixtures.points(spark, d).select("id", sinks.coordinate_tag("latitude", "longitude").alias("tag"))



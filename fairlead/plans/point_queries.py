"""Queries over points: geodesy, ingest, cleaning, statistics, metrics, neighbours and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairlead.functions import geo
from fairlead.functions.zones import CLASSES, OBJECTS, REGIONS, any_conflict, class_index, conflict, region, zone_title, zone_weight
from fairlead.operators import cleaning, knn, scorer, stats, tracks
from fairlead.operators.shared import new_folder, spread
from fairlead.plans.registry import query
from fairlead.sources import fixtures, points
from fairlead.sources.fixtures import POINTS_SQL

P = f"WITH {POINTS_SQL} "
#: Macro-like SQL text; DuckDB's trigonometric functions take radians.
KM = "12742.0176*asin(sqrt(least(1.0,greatest(0.0,sin((radians({2})-radians({0}))/2)*sin((radians({2})-radians({0}))/2)+cos(radians({0}))*cos(radians({2}))*sin((radians({3})-radians({1}))/2)*sin((radians({3})-radians({1}))/2)))))"


def km(*names: str) -> str:
    return KM.format(*names)


def bearing(a: str, b: str, c: str, d: str) -> str:
    return f"(degrees(atan2(sin(radians({d})-radians({b}))*cos(radians({c})), cos(radians({a}))*sin(radians({c}))-sin(radians({a}))*cos(radians({c}))*cos(radians({d})-radians({b}))))+360.0)%360.0"


REGION_SQL = "CASE " + " ".join(f"WHEN latitude>={s} AND latitude<{n} AND longitude>={w} AND longitude<{e} THEN '{k}'" for k, (s, n, w, e) in REGIONS.items()) + " ELSE 'Other (inland samples)' END"


def conflict_sql(measure: str, tolerance: float = 5.0) -> str:
    return f"coalesce((class_code IN ('OPEN_SEA','COASTAL_SEA') AND {measure}>{tolerance}) OR (class_code IN ('NEAR_COAST','COASTLINE') AND {measure}<-{tolerance}), false)"


BAD = f"({conflict_sql('noaa_depth')} OR {conflict_sql('elevation')})"


@query(P + f"SELECT id, round({km('latitude', 'longitude', 'lat2', 'lon2')}, 6) AS km FROM p")
def geo_haversine(spark, d):
    return fixtures.points(spark, d).select("id", F.round(geo.haversine_km("latitude", "longitude", "lat2", "lon2"), 6).alias("km"))


@query(P + f"SELECT id, round({bearing('latitude', 'longitude', 'lat2', 'lon2')}, 6) AS bearing FROM p")
def geo_bearing(spark, d):
    return fixtures.points(spark, d).select("id", F.round(geo.initial_bearing_deg("latitude", "longitude", "lat2", "lon2"), 6).alias("bearing"))


@query(P + "SELECT id, round(cos(radians(latitude))*cos(radians(longitude)), 9) AS x, round(cos(radians(latitude))*sin(radians(longitude)), 9) AS y, round(sin(radians(latitude)), 9) AS z FROM p")
def geo_unit_vector(spark, d):
    x, y, z = geo.unit_vector("latitude", "longitude")
    # + 0.0: no negative zeros
    return fixtures.points(spark, d).select("id", *[(F.round(v, 9) + 0.0).alias(n) for v, n in ((x, "x"), (y, "y"), (z, "z"))])


_GC = """v AS (SELECT *, cos(radians(latitude))*cos(radians(longitude)) AS ax, cos(radians(latitude))*sin(radians(longitude)) AS ay, sin(radians(latitude)) AS az,
 cos(radians(lat2))*cos(radians(lon2)) AS bx, cos(radians(lat2))*sin(radians(lon2)) AS by_, sin(radians(lat2)) AS bz FROM p),
o AS (SELECT *, acos(greatest(-1.0, least(1.0, ax*bx+ay*by_+az*bz))) AS w FROM v),
g AS (SELECT o.*, k, k/15.0 AS t FROM o, range(16) r(k)),
h AS (SELECT *, CASE WHEN w<1e-12 THEN 1-t ELSE sin((1-t)*w)/sin(w) END AS wa, CASE WHEN w<1e-12 THEN t ELSE sin(t*w)/sin(w) END AS wb FROM g)"""


@query(P + "," + _GC + "SELECT id, k, round(degrees(atan2(wa*az+wb*bz, sqrt((wa*ax+wb*bx)*(wa*ax+wb*bx)+(wa*ay+wb*by_)*(wa*ay+wb*by_)))), 5) + 0.0 AS lat, round(degrees(atan2(wa*ay+wb*by_, wa*ax+wb*bx)), 5) + 0.0 AS lon FROM h WHERE w >= 1e-9")
def geo_great_circle_points(spark, d):
    p = fixtures.points(spark, d).where(geo.haversine_km("latitude", "longitude", "lat2", "lon2") > 1e-5)
    g = p.select("id", F.posexplode(geo.great_circle_points("latitude", "longitude", "lat2", "lon2", 16)).alias("k", "p"))
    return g.select("id", F.col("k").cast("long").alias("k"), (F.round("p.lat", 5) + 0.0).alias("lat"), (F.round("p.lon", 5) + 0.0).alias("lon"))


@query(P + f"SELECT id, CAST(greatest(2, floor({km('latitude', 'longitude', 'lat2', 'lon2')}/500.0)+1) AS BIGINT) AS n FROM p")
def geo_densify(spark, d):
    p = spread(fixtures.points(spark, d).select("id", "latitude", "longitude", "lat2", "lon2"))
    return p.select("id", F.size(geo.densified("latitude", "longitude", "lat2", "lon2", 500.0)).cast("long").alias("n"))


_TRACK = ", t AS (SELECT user_id AS route_id, row_number() OVER w AS seq, latitude AS lat, longitude AS lon, class_code, lag(latitude) OVER w AS la, lag(longitude) OVER w AS lo, lead(latitude) OVER w AS nla, lead(longitude) OVER w AS nlo FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, id)) "


def track(spark, d):
    from pyspark.sql import Window

    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "id"))
    return fixtures.points(spark, d).select(F.col("user_id").alias("route_id"), seq.cast("long").alias("seq"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), "class_code")


@query(P + _TRACK + f"SELECT route_id, count(*) AS n, round(sum(coalesce({km('la', 'lo', 'lat', 'lon')}, 0.0)), 4) AS km FROM t GROUP BY route_id")
def geo_path_length(spark, d):
    return tracks.path_length(track(spark, d)).select("route_id", "n", F.round("km", 4).alias("km"))


@query(P + _TRACK + "SELECT route_id, greatest(-89.5, min(lat)-2) AS south, least(89.5, max(lat)+2) AS north, min(lon)-2 AS west, max(lon)+2 AS east FROM t GROUP BY route_id")
def geo_bbox(spark, d):
    return tracks.bounding_box(track(spark, d), 2.0)


@query(P + "SELECT id, round(sign(noaa_depth)*ln(1+abs(noaa_depth)), 9) + 0.0 AS v FROM p")
def geo_signed_log(spark, d):
    return fixtures.points(spark, d).select("id", (F.round(geo.signed_log("noaa_depth"), 9) + 0.0).alias("v"))


@query(P + f"SELECT id, round({km('latitude', 'longitude', 'lat2', 'lon2')}/(greatest(id%25, 0.1)*1.852), 6) AS hours, CASE WHEN {km('latitude', 'longitude', 'lat2', 'lon2')}=0 THEN 1.0::DOUBLE ELSE 1.25::DOUBLE END AS detour FROM p")
def geo_eta_detour(spark, d):
    k = geo.haversine_km("latitude", "longitude", "lat2", "lon2")
    return fixtures.points(spark, d).select("id", F.round(geo.eta_hours(k, F.col("id") % 25), 6).alias("hours"), F.round(geo.detour_ratio(k * 1.25, k), 9).alias("detour"))


@query(
    P + ", t AS (SELECT id, floor((longitude+180)/360*256.0) AS x, floor((1-ln(tan(radians(latitude))+1/cos(radians(latitude)))/pi())/2*256.0) AS y FROM p) SELECT id, round(degrees(atan(sinh(3.141592653589793*(1-2*(y+1)/256.0)))), 9) + 0.0 AS south, x/256.0*360-180 AS west,"
    " round(degrees(atan(sinh(3.141592653589793*(1-2*y/256.0)))), 9) + 0.0 AS north, (x+1)/256.0*360-180 AS east FROM t"
)
def geo_tile_bounds(spark, d):
    """The bounds of the tile of zoom 8 that each event lies in."""
    rad = F.radians("latitude")
    x, y = F.floor((F.col("longitude") + 180) / 360 * 256.0), F.floor((1 - F.log(F.tan(rad) + 1 / F.cos(rad)) / F.pi()) / 2 * 256.0)
    b = fixtures.points(spark, d).select("id", geo.tile_bounds(F.lit(8), x.cast("double"), y.cast("double")).alias("b"))
    return b.select("id", (F.round("b.south", 9) + 0.0).alias("south"), "b.west", (F.round("b.north", 9) + 0.0).alias("north"), "b.east")


@query(
    P + _TRACK + f", l AS (SELECT *, coalesce({km('la', 'lo', 'lat', 'lon')}, 0.0) AS leg, {bearing('lat', 'lon', 'nla', 'nlo')} AS course FROM t) "
    "SELECT route_id, seq, class_code AS zone, CASE class_code WHEN 'OPEN_SEA' THEN 1.0 WHEN 'COASTAL_SEA' THEN 1.8 ELSE 1e6 END AS cost, round(leg, 4) AS leg_km,"
    " round(sum(leg) OVER (PARTITION BY route_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 2) AS total_km, round(coalesce(course, lag(course) OVER (PARTITION BY route_id ORDER BY seq), 0.0), 5) AS bearing FROM l"
)
def track_waypoint_table(spark, d):
    """For every track the waypoint table: zone, zone cost, cumulative length, bearing."""
    rows = tracks.waypoint_table(track(spark, d))
    cost = F.when(zone_weight("class_code") == float("inf"), F.lit(1e6)).otherwise(zone_weight("class_code"))
    return rows.select("route_id", "seq", F.col("class_code").alias("zone"), cost.alias("cost"), F.round("leg_km", 4).alias("leg_km"), F.round("total_km", 2).alias("total_km"), F.round("bearing", 5).alias("bearing"))


# ---- ingest


def _dirty(spark, d):
    """Coordinates as text under aliases, some missing, unreadable or out of range."""
    e = F.col("event_id")
    lat, lon = ((e * 7919) % 13000 / 100.0 - 60).cast("string"), ((e * 104729) % 36000 / 100.0 - 180).cast("string")
    code = F.when(e % 19 == 0, "LAKE").otherwise(F.get(F.array(*map(F.lit, CLASSES)), (e % 4).cast("int")))
    raw = fixtures.events(spark, d).select(
        e.alias("id"), F.when(e % 11 == 0, None).when(e % 13 == 0, "999").when(e % 17 == 0, "n/a").otherwise(lat).alias("lat"), lon.alias("LNG"), code.alias("class_code"), F.when(e % 5 == 0, "x").otherwise("12.5").alias("elevation")
    )
    return points.normalise(raw)


_DIRTY = """WITH q AS (SELECT event_id AS id, CASE WHEN event_id%11=0 THEN NULL WHEN event_id%13=0 THEN 999.0 WHEN event_id%17=0 THEN NULL ELSE ((event_id*7919)%13000)/100.0-60 END AS latitude,
 ((event_id*104729)%36000)/100.0-180 AS longitude, CASE WHEN event_id%19=0 THEN 'LAKE' ELSE ['OPEN_SEA','COASTAL_SEA','NEAR_COAST','COASTLINE'][event_id%4+1] END AS class_code, CASE WHEN event_id%5<>0 THEN 12.5 END AS elevation FROM events) """


@query(_DIRTY + "SELECT id, latitude, longitude, class_code, elevation, 0.0 AS osm_piers, CAST(NULL AS VARCHAR) AS noaa_type FROM q WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180")
def ingest_validate(spark, d):
    return points.validate(_dirty(spark, d)).select("id", "latitude", "longitude", "class_code", "elevation", "osm_piers", "noaa_type")


@query(
    _DIRTY + "SELECT count(*) AS n_rows, count(*) FILTER (latitude BETWEEN -90 AND 90) AS n_valid, count(*) FILTER (latitude IS NULL) AS n_null, count(*) FILTER (latitude NOT BETWEEN -90 AND 90) AS n_out_of_range,"
    " count(*) FILTER (latitude BETWEEN -90 AND 90 AND class_code='LAKE') AS n_unknown_class FROM q"
)
def ingest_report(spark, d):
    return points.report(_dirty(spark, d))


# ---- cleaning and statistics


@query(P + f"SELECT id, {conflict_sql('noaa_depth')} AS depth_conflict, {conflict_sql('elevation')} AS height_conflict, {BAD} AS conflict FROM p")
def clean_conflicts(spark, d):
    return fixtures.points(spark, d).select("id", conflict("class_code", "noaa_depth").alias("depth_conflict"), conflict("class_code", "elevation").alias("height_conflict"), any_conflict("class_code").alias("conflict"))


@query(P + f"SELECT id, class_code FROM p WHERE NOT {BAD}")
def clean_filtered(spark, d):
    return cleaning.without_conflicts(cleaning.known_classes(fixtures.points(spark, d))).select("id", "class_code")


@query(P + f"SELECT id, {REGION_SQL} AS region FROM p")
def clean_regions(spark, d):
    return fixtures.points(spark, d).select("id", region("latitude", "longitude").alias("region"))


@query(
    P + f", f AS (SELECT *, {REGION_SQL} AS region, {BAD} AS bad, {conflict_sql('noaa_depth')} AS bd, {conflict_sql('elevation')} AS bh FROM p) SELECT 'all' AS dimension, 'all' AS value, count(*) AS n_total, count(*) FILTER (bad) AS n_removed FROM f"
    " UNION ALL SELECT 'class', class_code, count(*), count(*) FILTER (bad) FROM f GROUP BY class_code UNION ALL SELECT 'region', region, count(*), count(*) FILTER (bad) FROM f GROUP BY region"
    " UNION ALL SELECT 'measure', 'noaa_depth', count(*), count(*) FILTER (bd) FROM f UNION ALL SELECT 'measure', 'elevation', count(*), count(*) FILTER (bh) FROM f"
)
def clean_report(spark, d):
    return cleaning.conflict_report(fixtures.points(spark, d))


@query(P + " UNION ALL ".join(f"SELECT CAST({t} AS DOUBLE) AS tolerance_m, count(*) FILTER ({conflict_sql('noaa_depth', t)} OR {conflict_sql('elevation', t)}) AS n_removed FROM p" for t in cleaning.SENSITIVITY_M))
def clean_sensitivity(spark, d):
    return cleaning.conflict_sensitivity(fixtures.points(spark, d))


@query(P + "SELECT class_code, count(*) AS n, round(count(*)/(SELECT count(*) FROM p), 6) AS share FROM p GROUP BY class_code")
def stats_class_distribution(spark, d):
    return stats.class_distribution(fixtures.points(spark, d))


@query(P + "SELECT class_code, count(*) AS n, round(avg(noaa_depth), 6) AS mean, round(stddev_samp(noaa_depth), 6) AS std, round(quantile_cont(noaa_depth, 0.05), 6) AS p05, round(quantile_cont(noaa_depth, 0.5), 6) AS p50, round(quantile_cont(noaa_depth, 0.95), 6) AS p95 FROM p GROUP BY class_code")
def stats_depth_by_class(spark, d):
    return stats.depth_by_class(fixtures.points(spark, d))


@query(P + "SELECT count(*) AS n, min(latitude) AS south, max(latitude) AS north, min(longitude) AS west, max(longitude) AS east, count(*) FILTER (noaa_depth IS NULL) AS no_depth, count(*) FILTER (elevation IS NULL) AS no_elevation, count(DISTINCT user_id) AS sessions FROM p")
def stats_overview(spark, d):
    return stats.overview(fixtures.points(spark, d))


@query(P + f"SELECT {REGION_SQL} AS region, count(*) AS total, " + ", ".join(f"count(*) FILTER (class_code='{c}') AS {c.lower()}" for c in CLASSES) + " FROM p GROUP BY 1")
def stats_region_class_pivot(spark, d):
    return stats.region_class_pivot(fixtures.points(spark, d))


# ---- metrics

_ONE = P + """, c AS (SELECT unnest(['OPEN_SEA','COASTAL_SEA','NEAR_COAST','COASTLINE']) AS class_code),
m AS (SELECT c.class_code, count(*) FILTER (p.class_code=c.class_code) AS support, count(*) FILTER (predicted=c.class_code) AS assigned, count(*) FILTER (p.class_code=c.class_code AND predicted=c.class_code) AS hit FROM c, p GROUP BY c.class_code),
r AS (SELECT *, CASE WHEN assigned>0 THEN hit/assigned ELSE 0.0 END AS pr, CASE WHEN support>0 THEN hit/support ELSE 0.0 END AS rc FROM m),
f AS (SELECT *, CASE WHEN pr+rc>0 THEN 2*pr*rc/(pr+rc) ELSE 0.0 END AS f1 FROM r) """


@query(P + "SELECT class_code AS truth, predicted, count(*) AS n FROM p GROUP BY 1, 2")
def eval_confusion(spark, d):
    return stats.confusion(fixtures.points(spark, d))


@query(_ONE + "SELECT class_code, support, assigned, hit, round(pr, 9) AS precision, round(rc, 9) AS recall, round(f1, 9) AS f1 FROM f")
def eval_per_class(spark, d):
    return stats.per_class(fixtures.points(spark, d)).select("class_code", "support", "assigned", "hit", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(
    _ONE + ", t AS (SELECT sum(support) AS n, sum(hit) AS h, avg(f1) AS mf, sum(f1*support) AS wf, sum(CAST(support AS DOUBLE)*assigned) AS ch FROM f) SELECT CAST(n AS BIGINT) AS n, round(h/n, 9) AS accuracy, round(mf, 9) AS macro_f1, round(wf/n, 9) AS weighted_f1, round((h/n-ch/n/n)/(1-ch/n/n), 9) AS kappa FROM t"
)
def eval_summary(spark, d):
    return stats.summary(fixtures.points(spark, d)).select("n", *[F.round(c, 9).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1", "kappa")])


@query(
    P + ", s AS (SELECT score, count(*) FILTER (class_code='OPEN_SEA') AS pos, count(*) FILTER (class_code<>'OPEN_SEA') AS neg FROM p GROUP BY score), b AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)"
    " SELECT CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg, round(sum(pos*(below+neg/2.0))/sum(pos)/sum(neg), 9) AS auc FROM b"
)
def eval_roc_auc(spark, d):
    return stats.roc_auc(fixtures.points(spark, d), F.col("class_code") == "OPEN_SEA", "score").withColumn("auc", F.round("auc", 9))


@query(P + f"SELECT {REGION_SQL} AS region, count(*) AS n, round(avg(CAST(class_code=predicted AS INT)), 9) AS accuracy, count(*) FILTER (class_code IN ('OPEN_SEA','COASTAL_SEA') AND predicted NOT IN ('OPEN_SEA','COASTAL_SEA')) AS water_as_land, count(*) FILTER (class_code NOT IN ('OPEN_SEA','COASTAL_SEA') AND predicted IN ('OPEN_SEA','COASTAL_SEA')) AS land_as_water FROM p GROUP BY 1")
def eval_by_region(spark, d):
    return stats.by_region(fixtures.points(spark, d)).withColumn("accuracy", F.round("accuracy", 9))


@query(P + ", c AS (SELECT class_code, count(*) AS n FROM p GROUP BY 1) SELECT class_code, n, round(1.0/n/(SELECT avg(1.0/n) FROM c), 9) AS weight FROM c")
def class_weights(spark, d):
    return stats.class_weights(fixtures.points(spark, d)).withColumn("weight", F.round("weight", 9))


@query(P + "SELECT count(*) AS n, round(avg(CAST(class_code=predicted AS INT)), 4) AS agreement FROM p")
def label_agreement(spark, d):
    return stats.label_agreement(fixtures.points(spark, d))


@query(P + ", c AS (SELECT class_code, count(*) AS n FROM p GROUP BY 1), s AS (SELECT class_code, n, unnest(['test','validation','train']) AS split, unnest([CAST(ceil(0.15*n) AS BIGINT), CAST(ceil(0.3*n) AS BIGINT)-CAST(ceil(0.15*n) AS BIGINT), n-CAST(ceil(0.3*n) AS BIGINT)]) AS k FROM c) SELECT class_code, split, k AS n FROM s")
def split_sizes(spark, d):
    """Sizes of the stratified split; which rows go where depends on the hash."""
    return stats.stratified_split(fixtures.points(spark, d), "id").groupBy("class_code", "split").agg(F.count(F.lit(1)).alias("n"))


@query(P + "SELECT id, list_position(['OPEN_SEA','COASTAL_SEA','NEAR_COAST','COASTLINE'], class_code)-1 AS idx, CASE class_code WHEN 'OPEN_SEA' THEN 'Open Sea' WHEN 'COASTAL_SEA' THEN 'Coastal Sea' WHEN 'NEAR_COAST' THEN 'Near Coast' ELSE 'Coastline' END AS title FROM p")
def zone_labels(spark, d):
    return fixtures.points(spark, d).select("id", class_index("class_code").alias("idx"), zone_title("class_code").alias("title"))


# ---- neighbours and features

_NEAR = P + f""", q AS (SELECT id, latitude, longitude, coalesce(noaa_depth, elevation) AS depth, coalesce(elevation, noaa_depth) AS height, {', '.join(OBJECTS)} FROM p),
n AS (SELECT a.id AS q_id, unnest(list_transform(min(row(round({km('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')}, 9), b.id), {{k}}+1), lambda x, i: {{{{'km': x[1], 'r_id': x[2], 'rank': i}}}})) AS s FROM q a, q b GROUP BY a.id),
w AS (SELECT q_id, s.km AS km, s.r_id AS r_id, s.rank AS rk FROM n),
o AS (SELECT *, max(CASE WHEN rk=1 THEN km<=0.002 END) OVER (PARTITION BY q_id) AS own FROM w),
c AS (SELECT q_id, r_id, km, rk - CAST(own AS INT) AS rank FROM o WHERE rk - CAST(own AS INT) BETWEEN 1 AND {{k}}) """


@query(_NEAR.format(k=8) + "SELECT q_id, r_id, round(km, 6) AS km, CAST(rank AS INT) AS rank FROM c")
def knn_context(spark, d):
    p = fixtures.points(spark, d)
    return knn.context(p, knn.reference_index(p)).select("q_id", "r_id", F.round("km", 6).alias("km"), "rank")


@query(_NEAR.format(k=4) + "SELECT q_id, round(sum(depth*1/pow(greatest(km, 1e-3), 2))/sum(1/pow(greatest(km, 1e-3), 2)), 6) AS depth, round(min(km), 6) AS nearest_km FROM c JOIN q ON r_id=id GROUP BY q_id")
def knn_idw_depth(spark, d):
    p = fixtures.points(spark, d)
    return knn.idw(p, knn.reference_index(p)).select("q_id", F.round("depth", 6).alias("depth"), F.round("nearest_km", 6).alias("nearest_km"))


@query(
    P + "SELECT id, round(sin(radians(latitude)), 9) AS lat_sin, round(cos(radians(longitude)), 9) AS lon_cos, round(abs(latitude)/90, 9) AS abs_lat_norm, CAST(elevation IS NULL AS DOUBLE) AS elevation_is_missing, CAST(noaa_type='height' AS DOUBLE) AS is_height_sample,"
    " round(ln(1+osm_piers+osm_lighthouses+osm_breakwaters+osm_harbors), 9) AS osm_marine_infra, round(ln(1+osm_beaches+osm_cliffs), 9) AS osm_natural_coastal, round(ln(1+osm_rivers+osm_lakes), 9) AS osm_inland_water, round(ln(1+osm_industrial), 9) AS osm_industrial_log FROM p"
)
def features_own(spark, d):
    made = knn.own_features()
    names = ("lat_sin", "lon_cos", "abs_lat_norm", "elevation_is_missing", "is_height_sample", "osm_marine_infra", "osm_natural_coastal", "osm_inland_water", "osm_industrial_log")
    return fixtures.points(spark, d).select("id", *[F.round(made[n], 9).alias(n) for n in names])


_ALL = "+".join(OBJECTS)


@query(
    _NEAR.format(k=8) + f", x AS (SELECT q_id, avg(depth) AS m, stddev_pop(depth) AS s, min(depth) AS lo, max(depth) AS hi, avg(CAST(depth>0 AS INT)) AS land, min(km) AS near, avg(km) AS span, avg({_ALL}) AS obj FROM c JOIN q ON r_id=id GROUP BY q_id)"
    " SELECT q_id AS id, round(sign(m)*ln(1+abs(m)), 5) + 0.0 AS ctx_depth_mean, round(ln(1+s), 5) AS ctx_depth_std, round(sign(lo)*ln(1+abs(lo)), 5) + 0.0 AS ctx_depth_min, round(sign(hi)*ln(1+abs(hi)), 5) + 0.0 AS ctx_depth_max, round(ln(1+hi-lo), 5) AS ctx_depth_range,"
    " land AS ctx_land_fraction, round(ln(1+near), 5) AS ctx_distance_km_log, round(ln(1+(hi-lo)/greatest(span, 1e-3)), 5) AS ctx_gradient, round(ln(1+obj), 5) AS ctx_osm_total, round(ln(1+obj/greatest(span, 1.2)), 5) AS ctx_osm_density FROM x"
)
def features_context(spark, d):
    p = fixtures.points(spark, d)
    x = knn.context_statistics(p, knn.reference_index(p))
    r = lambda c: F.round(c, 5) + 0.0
    rng = F.col("ctx_max") - F.col("ctx_min")
    return x.select(
        F.col("q_id").alias("id"), r(geo.signed_log("ctx_mean")).alias("ctx_depth_mean"), r(F.log1p("ctx_std")).alias("ctx_depth_std"), r(geo.signed_log("ctx_min")).alias("ctx_depth_min"), r(geo.signed_log("ctx_max")).alias("ctx_depth_max"),
        r(F.log1p(rng)).alias("ctx_depth_range"), F.col("ctx_land").alias("ctx_land_fraction"), r(F.log1p("nearest_km")).alias("ctx_distance_km_log"), r(geo.signed_log(rng / F.greatest("span_km", F.lit(1e-3)))).alias("ctx_gradient"),
        r(F.log1p("ctx_objects")).alias("ctx_osm_total"), r(F.log1p(F.col("ctx_objects") / F.greatest("span_km", F.lit(1.2)))).alias("ctx_osm_density"),
    )


_SIGNED = lambda x: f"sign({x})*ln(1+abs({x}))"
_LOGS = {"marine": "osm_piers+osm_lighthouses+osm_breakwaters+osm_harbors", "natural": "osm_beaches+osm_cliffs", "inland": "osm_rivers+osm_lakes"}
_FEATURES = {
    "lat_sin": "sin(radians(p.latitude))", "lat_cos": "cos(radians(p.latitude))", "lon_sin": "sin(radians(p.longitude))", "lon_cos": "cos(radians(p.longitude))", "abs_lat_norm": "abs(p.latitude)/90.0",
    "depth_signed_log": _SIGNED("coalesce(p.noaa_depth, m)"), "depth_is_missing": "p.noaa_depth IS NULL", "is_height_sample": "coalesce(p.noaa_type='height', false)",
    "elevation_signed_log": _SIGNED("coalesce(p.elevation, p.noaa_depth, m)"), "elevation_is_missing": "p.elevation IS NULL", "ctx_depth_mean": _SIGNED("m"), "ctx_depth_std": "ln(1+s)", "ctx_depth_min": _SIGNED("lo"),
    "ctx_depth_max": _SIGNED("hi"), "ctx_depth_range": "ln(1+(hi-lo))", "ctx_land_fraction": "land", "ctx_sign_agreement": "sign(coalesce(p.noaa_depth, m))=sign(m)", "ctx_distance_km_log": "ln(1+near)",
    "ctx_gradient": _SIGNED("(hi-lo)/greatest(span, 1e-3)"), "osm_marine_infra": f"ln(1+{_LOGS['marine']})", "ctx_osm_marine_infra": "ln(1+marine)", "osm_natural_coastal": f"ln(1+{_LOGS['natural']})",
    "ctx_osm_natural_coastal": "ln(1+natural_)", "osm_inland_water": f"ln(1+{_LOGS['inland']})", "ctx_osm_inland_water": "ln(1+inland)", "osm_industrial_log": "ln(1+osm_industrial)", "ctx_osm_total": "ln(1+obj)",
    "ctx_osm_density": "ln(1+obj/greatest(span, 1.2))",
}


@query(
    _NEAR.format(k=8) + f", x AS (SELECT q_id, avg(depth) AS m, stddev_pop(depth) AS s, min(depth) AS lo, max(depth) AS hi, avg(CAST(depth>0 AS INT)) AS land, min(km) AS near, avg(km) AS span, avg({_ALL}) AS obj, avg({_LOGS['marine']}) AS marine, avg({_LOGS['natural']}) AS natural_, avg({_LOGS['inland']}) AS inland FROM c JOIN q ON r_id=id GROUP BY q_id)"
    " SELECT id, " + ", ".join(f"CAST(({v})::DOUBLE AS FLOAT) AS {n}" for n, v in _FEATURES.items()) + " FROM p JOIN x ON id=q_id"
)
def features_all(spark, d):
    """The 28 features as floats."""
    p = fixtures.points(spark, d)
    return knn.features(p, knn.reference_index(p))


@query(_NEAR.format(k=8) + "SELECT q_id, r_id, round(km, 6) AS km, CAST(rank AS INT) AS rank FROM c")
def knn_stored_index(spark, d):
    """As ``knn_context``, from an index that was written by tile and loaded again."""
    p = fixtures.points(spark, d)
    path = new_folder(spark, "knn-index")
    knn.save_index(knn.reference_index(p), path)
    return knn.context(p, knn.load_index(spark, path)).select("q_id", "r_id", F.round("km", 6).alias("km"), "rank")


_OWN = {
    "lat_sin": "sin(radians(latitude))", "lat_cos": "cos(radians(latitude))", "lon_sin": "sin(radians(longitude))", "abs_lat_norm": "abs(latitude)/90.0", "depth_is_missing": "CAST(noaa_depth IS NULL AS INT)",
    "is_height_sample": "CAST(noaa_type='height' AS INT)", "elevation_is_missing": "CAST(elevation IS NULL AS INT)", "osm_marine_infra": f"ln(1+{_LOGS['marine']})", "osm_inland_water": f"ln(1+{_LOGS['inland']})",
}
_OWN_SQL = f"""o AS (SELECT id, class_code, {', '.join(f'({v})::DOUBLE AS f{i}' for i, v in enumerate(_OWN.values()))} FROM p),
ms AS (SELECT {', '.join(f'avg(f{i}) AS m{i}, CASE WHEN stddev_pop(f{i})>0 THEN stddev_pop(f{i}) ELSE 1.0 END AS s{i}' for i in range(len(_OWN)))} FROM o),
zs AS (SELECT id, class_code, {', '.join(f'(f{i}-m{i})/s{i} AS z{i}' for i in range(len(_OWN)))} FROM o, ms),
ce AS (SELECT class_code AS code, {', '.join(f'avg(z{i}) AS c{i}' for i in range(len(_OWN)))} FROM zs GROUP BY 1),
lo AS (SELECT id, class_code, code, {'+'.join(f'z{i}*c{i}' for i in range(len(_OWN)))}-({'+'.join(f'c{i}*c{i}' for i in range(len(_OWN)))})/2 AS z FROM zs, ce),
pr AS (SELECT id, class_code, code, exp(z)/sum(exp(z)) OVER (PARTITION BY id) AS p FROM lo),
wide AS (SELECT id, any_value(class_code) AS truth, max(p) FILTER (code='OPEN_SEA') AS p_open_sea, max(p) FILTER (code='COASTAL_SEA') AS p_coastal_sea, max(p) FILTER (code='NEAR_COAST') AS p_near_coast, max(p) FILTER (code='COASTLINE') AS p_coastline FROM pr GROUP BY 1)"""


def scored(spark, d):
    """Probabilities of every event by the nearest mean of its own features, a network in closed form."""
    made = knn.own_features()
    table = fixtures.points(spark, d).select("id", "class_code", *[made[n].alias(n) for n in _OWN])
    return scorer.score(table, scorer.centroid_network(table, "class_code", list(_OWN)), list(_OWN), ("id", "class_code"), "predicted").withColumnRenamed("class_code", "truth")


@query(P + ", " + _OWN_SQL + " SELECT id, " + ", ".join(f"round(p_{c.lower()}, 6) AS p_{c.lower()}" for c in CLASSES) + ", round(greatest(" + ", ".join(f"p_{c.lower()}" for c in CLASSES) + "), 6) AS confidence FROM wide")
def score_probabilities(spark, d):
    """Class probabilities and confidence of every event."""
    return scored(spark, d).select("id", *[F.round(c, 6).alias(c) for c in (*scorer.PROBABILITIES, "confidence")])


_AUC = " UNION ALL ".join(
    f"SELECT '{c}' AS class_code, round((sum(rk) FILTER (truth='{c}')-count(*) FILTER (truth='{c}')*(count(*) FILTER (truth='{c}')+1)/2.0)/(count(*) FILTER (truth='{c}')*count(*) FILTER (truth<>'{c}')), 4) AS auc"
    f" FROM (SELECT truth, rank() OVER (ORDER BY p_{c.lower()})+(count(*) OVER (PARTITION BY p_{c.lower()})-1)/2.0 AS rk FROM wide)" for c in CLASSES
)


@query(P + ", " + _OWN_SQL + " " + _AUC)
def score_macro_auc(spark, d):
    """Each class against the rest, by its probability."""
    return scorer.macro_auc(scored(spark, d), "truth").withColumn("auc", F.round("auc", 4))


_BARE = P + f""", q AS (SELECT id, latitude, longitude, coalesce(noaa_depth, elevation) AS depth, coalesce(elevation, noaa_depth) AS height, {', '.join(OBJECTS)} FROM p),
u AS (SELECT id, lat2 AS latitude, lon2 AS longitude FROM p),
n AS (SELECT a.id AS q_id, unnest(list_transform(min(row(round({km('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')}, 9), b.id), 9), lambda x, i: {{'km': x[1], 'r_id': x[2], 'rank': i}})) AS s FROM u a, q b GROUP BY a.id),
w AS (SELECT q_id, s.km AS km, s.r_id AS r_id, s.rank AS rk FROM n),
o AS (SELECT *, max(CASE WHEN rk=1 THEN km<=0.002 END) OVER (PARTITION BY q_id) AS own FROM w),
c AS (SELECT q_id, r_id, km, rk - CAST(own AS INT) AS rank FROM o WHERE rk - CAST(own AS INT) BETWEEN 1 AND 8),
m4 AS (SELECT q_id, sum(depth*(1/pow(greatest(km, 1e-3), 2)))/sum(1/pow(greatest(km, 1e-3), 2)) AS noaa_depth, sum(height*(1/pow(greatest(km, 1e-3), 2)))/sum(1/pow(greatest(km, 1e-3), 2)) AS elevation, {', '.join(f'arg_min({c}, rank) AS {c}' for c in OBJECTS)} FROM c JOIN q ON r_id=id WHERE rank<=4 GROUP BY q_id),
f AS (SELECT id, latitude, longitude, noaa_depth, elevation, CASE WHEN noaa_depth>0 THEN 'height' ELSE 'depth' END AS noaa_type, {', '.join(OBJECTS)} FROM u JOIN m4 ON id=q_id),
x AS (SELECT q_id, avg(depth) AS m, stddev_pop(depth) AS s, min(depth) AS lo, max(depth) AS hi, avg(CAST(depth>0 AS INT)) AS land, min(km) AS near, avg(km) AS span, avg({_ALL}) AS obj, avg({_LOGS['marine']}) AS marine, avg({_LOGS['natural']}) AS natural_, avg({_LOGS['inland']}) AS inland FROM c JOIN q ON r_id=id GROUP BY q_id)"""


@query(_BARE + " SELECT id, " + ", ".join(f"CAST(({v})::DOUBLE AS FLOAT) AS {n}" for n, v in _FEATURES.items()) + " FROM f p JOIN x ON id=q_id")
def features_coordinates(spark, d):
    """The 28 features of bare second positions."""
    p = fixtures.points(spark, d)
    return knn.coordinate_features(p.select("id", F.col("lat2").alias("latitude"), F.col("lon2").alias("longitude")), knn.reference_index(p))

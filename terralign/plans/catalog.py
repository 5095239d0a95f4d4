"""All queries of the survey engine with their DuckDB twins.

The driver's tables stand in for survey data (see FIXTURES.md): events are frames of flights and samples of runs, part holds
camera parameters, lineitem point correspondences, orders edges and poses, embeddings descriptors, documents files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import affine, geo
from ..functions import frames as fr
from ..functions.telemetry_status import upload_status
from ..operators import compose, matching, placement, plan, poses, telemetry
from ..session import table
from ..sources import contracts, images
from ..sources.checkpoints import cut

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        _QUERIES[name] = function
        if sql:
            _SQL[name] = sql
        return function

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def r6(column, digits: int = 6):
    return F.round(column, digits)


# ---------------------------------------------------------------------------------------------- frames and their checks

FRAMES = """SELECT event_id AS frame_id, user_id AS flight_id, ts,
  34.0 + ((event_id * event_id * 31 + event_id * 7919) % 10007) / 1e6 AS lat,
  -118.3 + ((event_id * event_id * 17 + event_id * 10473) % 10009) / 1e6 AS lon,
  greatest(value, 5.0) AS altitude, CASE WHEN event_id % 2 = 1 THEN ((event_id * 37) % 360)::DOUBLE END AS yaw FROM events"""


def frames_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    lat = F.lit(34.0) + ((e * e * 31 + e * 7919) % 10007) / 1e6
    lon = F.lit(-118.3) + ((e * e * 17 + e * 10473) % 10009) / 1e6
    yaw = F.when(e % 2 == 1, ((e * 37) % 360).cast("double"))
    return table(spark, sf_dir, "events").select(e.alias("frame_id"), F.col("user_id").alias("flight_id"), "ts", lat.alias("lat"), lon.alias("lon"), F.greatest(F.col("value"), F.lit(5.0)).alias("altitude"), yaw.alias("yaw"))


@query("frames_view", FRAMES)
def _(spark, sf_dir):
    return frames_view(spark, sf_dir)


CHECKED = """SELECT event_id AS frame_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE 34.0 + event_id / 1e6 END AS lat, -118.0::DOUBLE AS lon,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE ((event_id * 13) % 120 - 100)::DOUBLE END AS pitch, event_id % 17 <> 0 AS readable FROM events"""
REASON = """CASE WHEN lat IS NULL OR lon IS NULL THEN 'Missing or corrupt EXIF GPS coordinates (Latitude/Longitude)'
  WHEN pitch > -45.0 THEN printf('Non-nadir gimbal pitch (%.1f° > -45.0°)', pitch) END"""


def _checked(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(e.alias("frame_id"), F.when(e % 11 != 0, F.lit(34.0) + e / 1e6).alias("lat"), F.lit(-118.0).alias("lon"), F.when(e % 5 != 0, ((e * 13) % 120 - 100).cast("double")).alias("pitch"), (e % 17 != 0).alias("readable"))


@query("ingest_validate", f"WITH f AS ({CHECKED}) SELECT frame_id, {REASON} AS reason, {REASON} IS NULL AS accepted FROM f")
def _(spark, sf_dir):
    reason = fr.rejection_reason(F.col("lat"), F.col("lon"), F.col("pitch"))
    return _checked(spark, sf_dir).select("frame_id", reason.alias("reason"), reason.isNull().alias("accepted"))


@query("ingest_report", f"WITH f AS ({CHECKED}), r AS (SELECT {REASON} AS reason FROM f) SELECT count(*) AS total_found, count(*) FILTER (reason IS NULL) AS accepted_count, count(*) FILTER (reason IS NOT NULL) AS rejected_count FROM r")
def _(spark, sf_dir):
    reason = fr.rejection_reason(F.col("lat"), F.col("lon"), F.col("pitch"))
    return _checked(spark, sf_dir).agg(F.count(F.lit(1)).alias("total_found"), F.count_if(reason.isNull()).alias("accepted_count"), F.count_if(reason.isNotNull()).alias("rejected_count"))


@query("folder_check", f"WITH f AS ({CHECKED}) SELECT frame_id, CASE WHEN NOT readable THEN 'unreadable_file' WHEN lat IS NULL THEN 'no_gps_metadata' END AS reason FROM f")
def _(spark, sf_dir):
    return _checked(spark, sf_dir).select("frame_id", fr.folder_reason(F.col("readable"), F.col("lat").isNotNull()).alias("reason"))


@query("rejections_top10", f"WITH f AS ({CHECKED}), r AS (SELECT frame_id, {REASON} AS reason FROM f), j AS (SELECT *, count(*) OVER () - 10 AS more FROM r WHERE reason IS NOT NULL) SELECT frame_id, reason, greatest(more, 0) AS more FROM j ORDER BY frame_id LIMIT 10")
def _(spark, sf_dir):
    return fr.first_rejections(_checked(spark, sf_dir).select("frame_id", fr.rejection_reason(F.col("lat"), F.col("lon"), F.col("pitch")).alias("reason")), "frame_id")


@query("accept_reject_cover", f"WITH f AS ({CHECKED}), r AS (SELECT frame_id, {REASON} IS NULL AS ok FROM f) SELECT (SELECT count(*) FROM r WHERE ok) + (SELECT count(*) FROM r WHERE NOT ok) AS covered, count(*) AS total, 0::BIGINT AS left_over FROM r")
def _(spark, sf_dir):
    rows = _checked(spark, sf_dir)
    reason = fr.rejection_reason(F.col("lat"), F.col("lon"), F.col("pitch"))
    parts = rows.filter(reason.isNull()).unionByName(rows.filter(reason.isNotNull())).select("frame_id")
    left = rows.select("frame_id").exceptAll(parts).agg(F.count(F.lit(1)).alias("left_over"))
    return parts.agg(F.count(F.lit(1)).alias("covered")).join(rows.agg(F.count(F.lit(1)).alias("total")), F.lit(True)).join(left, F.lit(True))


@query("filename_stem_ext", r"SELECT page_id, regexp_replace(list_last(string_split(url, '/')), '(.)\.[^.]*$', '\1') AS stem, lower(regexp_extract(url, '(\.[^./]+)$', 1)) AS ext, regexp_matches(url, '(?i)\.(jpe?g|tiff?|png)$') AS is_image FROM pages")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", fr.stem(F.col("url")).alias("stem"), fr.extension(F.col("url")).alias("ext"), fr.is_image(F.col("url")).alias("is_image"))


@query("attribute_extract", r"""SELECT event_id, TRY_CAST(regexp_extract(props, '"k"\s*:\s*([+-]?[0-9.]+)', 1) AS DOUBLE) AS k FROM events""")
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", images.xmp_number(F.regexp_replace("props", r'"k"\s*:\s*([+-]?[0-9.]+)', 'k="$1"'), "k").alias("k"))


AUDIT = """SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN '  ' WHEN c_custkey % 9 = 0 THEN 'n/a' ELSE (c_nationkey::DOUBLE)::VARCHAR END AS a,
  CASE WHEN c_custkey % 3 = 0 THEN '1.5e1' ELSE '' END AS b, CASE WHEN c_custkey % 10 = 0 THEN '' ELSE c_mktsegment END AS model FROM customer"""


@query(
    "audit_metadata",
    rf"""WITH r AS ({AUDIT}), v AS (SELECT id, model, CASE WHEN regexp_full_match(trim(x), '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') THEN trim(x)::DOUBLE END AS n
      FROM (SELECT *, coalesce(nullif(a, ''), nullif(b, '')) AS x FROM r))
    SELECT count(*) AS total_files, count(n) AS gps_files, count(*) - count(n) AS files_without_gps, min(n) AS least, max(n) AS greatest,
      count(n) = count(*) AS gps_complete, CASE WHEN count(n) > 0 THEN 'accepted_with_limitations' ELSE 'rejected' END AS status,
      array_to_string(list_sort(list(DISTINCT trim(model)) FILTER (trim(model) <> '')), ',') AS models FROM v""",
)
def _(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        F.when(k % 4 == 0, "  ").when(k % 9 == 0, "n/a").otherwise(F.col("c_nationkey").cast("double").cast("string")).alias("a"),
        F.when(k % 3 == 0, "1.5e1").otherwise("").alias("b"),
        F.when(k % 10 == 0, "").otherwise(F.col("c_mktsegment")).alias("model"),
    )
    one = contracts.audit(rows.select(F.col("a").alias("GPSLatitude"), F.col("b").alias("EXIF:GPSLatitude"), F.lit("1").alias("GPSLongitude"), F.col("model").alias("Model")))
    gps, total = F.col("gps"), F.col("total")
    return one.select(
        total.alias("total_files"), gps.alias("gps_files"), (total - gps).alias("files_without_gps"), F.col("s").alias("least"), F.col("n").alias("greatest"), (gps == total).alias("gps_complete"),
        F.when(gps > 0, "accepted_with_limitations").otherwise("rejected").alias("status"), F.array_join("models", ",").alias("models"),
    )


@query("upload_status", f"WITH f AS ({CHECKED}) SELECT frame_id % 7 AS project, CASE WHEN count(*) FILTER (readable AND lat IS NOT NULL) >= 2 THEN 'ready_for_processing' WHEN count(*) FILTER (readable) = 0 THEN 'error' ELSE 'warning_no_gps' END AS status FROM f GROUP BY 1")
def _(spark, sf_dir):
    return _checked(spark, sf_dir).groupBy((F.col("frame_id") % 7).alias("project")).agg(upload_status(F.col("readable"), F.col("lat").isNotNull()).alias("status"))


# ------------------------------------------------------------------------------------------------------------- planning


@query("utm_zone", f"WITH f AS ({FRAMES}) SELECT frame_id, least(60, greatest(1, floor((lon * (1 + frame_id % 3) + 180) / 6)::INT + 1)) + CASE WHEN lat - frame_id % 2 * 60 >= 0 THEN 32600 ELSE 32700 END AS epsg FROM f")
def _(spark, sf_dir):
    f = frames_view(spark, sf_dir)
    return f.select("frame_id", geo.utm_epsg(F.col("lat") - F.col("frame_id") % 2 * 60, F.col("lon") * (1 + F.col("frame_id") % 3)).alias("epsg"))


UTM = f"""SELECT *, 500000.0 + 0.9996e0 * {geo._A!r}::DOUBLE * (eta + {" + ".join(f"{v!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, v in enumerate(geo._ALPHA, 1))}) AS easting,
  0.9996e0 * {geo._A!r}::DOUBLE * (xi + {" + ".join(f"{v!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, v in enumerate(geo._ALPHA, 1))}) AS northing
  FROM (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM (SELECT *, radians(lon + 117) AS lam, sinh(atanh(sin(radians(lat))) - {geo._ECC!r}::DOUBLE * atanh({geo._ECC!r}::DOUBLE * sin(radians(lat)))) AS t FROM f))"""


@query("utm_project", f"WITH f AS ({FRAMES}), u AS ({UTM}) SELECT frame_id, 32611 AS epsg, round(easting, 3) AS easting, round(northing, 3) AS northing FROM u")
def _(spark, sf_dir):
    return plan.project_utm(frames_view(spark, sf_dir), ["flight_id"]).select("frame_id", "epsg", r6("easting", 3).alias("easting"), r6("northing", 3).alias("northing"))


@query("utm_round_trip", f"WITH f AS ({FRAMES}) SELECT frame_id, round(lat, 7) AS lat, round(lon, 7) AS lon FROM f")
def _(spark, sf_dir):
    lat, lon = geo.from_utm(F.col("easting"), F.col("northing"), F.col("epsg"))
    return plan.project_utm(frames_view(spark, sf_dir), ["flight_id"]).select("frame_id", r6(lat, 7).alias("lat"), r6(lon, 7).alias("lon"))


@query("upper_median_crs", f"WITH f AS ({FRAMES}) SELECT flight_id, list_sort(list(lat))[count(*) // 2 + 1] AS median_lat, list_sort(list(lon))[count(*) // 2 + 1] AS median_lon, 32611 AS epsg FROM f GROUP BY 1")
def _(spark, sf_dir):
    return plan.dominant_crs(frames_view(spark, sf_dir), ["flight_id"])


SITES = "SELECT n_nationkey AS id, n_nationkey * 5.0 - 60 AS lat, n_nationkey * 13.0 - 170 AS lon FROM nation"


def _sites(spark, sf_dir):
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(n.alias("id"), (n * 5.0 - 60).alias("lat"), (n * 13.0 - 170).alias("lon"))


@query(
    "haversine_pairs",
    f"""WITH s AS ({SITES}), p AS (SELECT a.id AS a, b.id AS b, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2) AS h FROM s a JOIN s b ON b.id > a.id AND b.id <= a.id + 3)
    SELECT a, b, round(2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h)), 3) AS metres FROM p""",
)
def _(spark, sf_dir):
    s = _sites(spark, sf_dir)
    near = s.select(F.col("id").alias("a"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), F.explode(F.sequence(F.col("id") + 1, F.col("id") + 3)).alias("b"))
    both = near.join(s.select(F.col("id").alias("b"), "lat", "lon"), "b")
    return both.select("a", "b", r6(geo.haversine_m(F.col("lat1"), F.col("lon1"), F.col("lat"), F.col("lon")), 3).alias("metres"))


@query("local_plane", f"WITH f AS ({FRAMES}), c AS (SELECT flight_id, avg(lat) AS lat0, avg(lon) AS lon0 FROM f GROUP BY 1) SELECT frame_id, round(6371000.0 * radians(lon - lon0) * cos(radians((lat + lat0) / 2)), 4) AS x, round(6371000.0 * radians(lat - lat0), 4) AS y FROM f JOIN c USING (flight_id)")
def _(spark, sf_dir):
    f = frames_view(spark, sf_dir)
    c = f.groupBy("flight_id").agg(F.avg("lat").alias("lat0"), F.avg("lon").alias("lon0"))
    x, y = geo.local_plane(F.col("lat"), F.col("lon"), F.col("lat0"), F.col("lon0"))
    return f.join(c, "flight_id").select("frame_id", r6(x, 4).alias("x"), r6(y, 4).alias("y"))


CAMERAS = "SELECT p_partkey AS id, p_retailprice / 10 AS altitude, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size + 10.0 END AS f35, CASE WHEN p_size % 2 = 0 THEN p_size / 10.0 END AS focal, p_size * 100 AS width FROM part"
GSD = """greatest(0.005, least(0.5, greatest(altitude, 5.0) * CASE WHEN f35 > 0 THEN 36.0 ELSE 6.17 END
  / (CASE WHEN f35 > 0 THEN f35 WHEN focal > 0 THEN focal ELSE 4.5 END * greatest(width, 100))))"""


def _cameras(spark, sf_dir):
    s = F.col("p_size")
    c = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 10).alias("altitude"), F.when(s % 3 != 0, s + 10.0).alias("f35"), F.when(s % 2 == 0, s / 10.0).alias("focal"), (s * 100).alias("width"))
    return c.withColumn("gsd", fr.ground_resolution(F.col("altitude"), F.col("f35"), F.col("focal"), F.col("width")))


@query("gsd_estimate", f"WITH c AS ({CAMERAS}) SELECT id, round({GSD}, 9) AS gsd FROM c")
def _(spark, sf_dir):
    return _cameras(spark, sf_dir).select("id", r6("gsd", 9).alias("gsd"))


@query("target_gsd", f"WITH c AS ({CAMERAS}), g AS (SELECT {GSD} AS gsd FROM c) SELECT round(median(gsd) * 1.5, 9) AS target_gsd FROM g WHERE gsd > 0")
def _(spark, sf_dir):
    return plan.target_resolution(_cameras(spark, sf_dir), 1.5).select(r6("target_gsd", 9).alias("target_gsd"))


XY = "SELECT *, lon * 111320.0 * cos(radians(lat)) AS x, lat * 110540.0 AS y FROM f"


def _placed(spark, sf_dir):
    x, y = geo.degree_metres(F.col("lat"), F.col("lon"))
    return frames_view(spark, sf_dir).withColumns({"x": x, "y": y})


@query(
    "heading_fill",
    f"""WITH f AS ({FRAMES}), p AS ({XY}), w AS (SELECT *, lead(x) OVER o - x AS nx, lead(y) OVER o - y AS ny, x - lag(x) OVER o AS px, y - lag(y) OVER o AS py FROM p WINDOW o AS (PARTITION BY flight_id ORDER BY ts, frame_id))
    SELECT frame_id, round(coalesce(yaw, CASE WHEN nx IS NOT NULL THEN CASE WHEN sqrt(nx * nx + ny * ny) > 2 THEN (degrees(atan2(nx, ny)) + 360) % 360 END
      WHEN px IS NOT NULL THEN CASE WHEN sqrt(px * px + py * py) > 2 THEN (degrees(atan2(px, py)) + 360) % 360 END END, 0), 6) AS yaw FROM w""",
)
def _(spark, sf_dir):
    return plan.fill_headings(_placed(spark, sf_dir), ["flight_id"], ["ts", "frame_id"], "x", "y").select("frame_id", r6("yaw").alias("yaw"))


@query(
    "neighbor_graph",
    f"""WITH f AS ({FRAMES}), p AS ({XY}), d AS (SELECT a.flight_id, a.frame_id AS a, b.frame_id AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM p a JOIN p b ON a.flight_id = b.flight_id AND a.frame_id <> b.frame_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(d, 6), b) AS k FROM d WHERE d < 80.0)
    SELECT flight_id, least(a, b) AS source_id, greatest(a, b) AS target_id, round(min(d), 6) AS distance_m FROM r WHERE k <= 6 GROUP BY ALL""",
)
def _(spark, sf_dir):
    return plan.neighbor_graph(_placed(spark, sf_dir), 6, 80.0, "x", "y", ["flight_id"]).withColumn("distance_m", r6("distance_m"))


HAV = "2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h))"
FLIGHT = f"""n AS (SELECT flight_id, frame_id AS source_id, lead(frame_id) OVER o AS target_id, lat, lon, lead(lat) OVER o AS lat2, lead(lon) OVER o AS lon2 FROM f WINDOW o AS (PARTITION BY flight_id ORDER BY ts, frame_id)),
  hh AS (SELECT *, pow(sin(radians(lat2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon) / 2), 2) AS h FROM n),
  fe AS (SELECT flight_id, source_id, target_id, {HAV} AS d FROM hh WHERE {HAV} <= 500.0)"""


@query("flight_edges", f"WITH f AS ({FRAMES}), {FLIGHT} SELECT flight_id, source_id, target_id, round(d, 4) AS distance_m FROM fe")
def _(spark, sf_dir):
    return plan.flight_edges(frames_view(spark, sf_dir), ["ts", "frame_id"], 500.0).withColumn("distance_m", r6("distance_m", 4))


@query(
    "edge_union",
    f"""WITH f AS ({FRAMES}), p AS ({XY}), {FLIGHT}, s AS (SELECT DISTINCT least(a.frame_id, b.frame_id) AS u, greatest(a.frame_id, b.frame_id) AS v FROM p a JOIN p b ON a.flight_id = b.flight_id AND a.frame_id <> b.frame_id WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < 80),
    e AS (SELECT least(source_id, target_id) AS u, greatest(source_id, target_id) AS v, 'flight' AS kind, 0 AS p FROM fe UNION ALL SELECT u, v, 'spatial', 1 FROM s)
    SELECT u, v, arg_min(kind, p) AS kind FROM e GROUP BY u, v""",
)
def _(spark, sf_dir):
    f = _placed(spark, sf_dir)
    pair = lambda a, b: (F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
    along = plan.flight_edges(f, ["ts", "frame_id"], 500.0).select(*pair("source_id", "target_id"), F.lit("flight").alias("kind"), F.lit(0).alias("p"))
    near = plan.candidate_pairs(f, 80.0, "x", "y", ["flight_id"]).select(*pair("a", "b"), F.lit("spatial").alias("kind"), F.lit(1).alias("p"))
    return along.unionByName(near).groupBy("u", "v").agg(F.min_by("kind", "p").alias("kind"))


REACH = f"""WITH f AS ({FRAMES}), p AS ({XY}), d AS (SELECT a.flight_id, a.frame_id AS a, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS d FROM p a JOIN p b ON a.flight_id = b.flight_id AND a.frame_id <> b.frame_id GROUP BY 1, 2),
  g AS (SELECT p.flight_id, p.frame_id, d FROM p LEFT JOIN d ON d.a = p.frame_id)"""


@query("radius_expand", REACH + " SELECT flight_id, count(*) FILTER (coalesce(d > 80, true)) AS isolated, count(*) FILTER (d <= 120) AS helped, CASE WHEN count(*) FILTER (coalesce(d > 80, true)) > 0 AND count(*) FILTER (d <= 120) > 0 THEN 120.0 ELSE 80.0 END::DOUBLE AS reach FROM g GROUP BY 1")
def _(spark, sf_dir):
    return plan.expanded_reach(_placed(spark, sf_dir), 80.0, "x", "y", ["flight_id"])


@query("node_degrees", REACH.replace("min(", "count(*) AS n, min(", 1).replace("a.frame_id <> b.frame_id GROUP", "a.frame_id <> b.frame_id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < 80 GROUP").replace("p.frame_id, d FROM", "p.frame_id, coalesce(n, 0) AS n FROM") + " SELECT n AS degree, count(*) AS frames FROM g GROUP BY 1")
def _(spark, sf_dir):
    f = _placed(spark, sf_dir)
    degree = plan.candidate_pairs(f, 80.0, "x", "y", ["flight_id"]).groupBy(F.col("a").alias("frame_id")).agg(F.count(F.lit(1)).alias("degree"))
    return f.select("frame_id").join(degree, "frame_id", "left").groupBy(F.coalesce("degree", F.lit(0)).alias("degree")).agg(F.count(F.lit(1)).alias("frames"))


@query("capped_graph")
def _(spark, sf_dir):
    return plan.capped_graph(frames_view(spark, sf_dir), ["ts", "frame_id"]).withColumn("distance_m", r6("distance_m", 4))


# ------------------------------------------------------------------------------------------------- matching and alignment


def _features(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("frame"), F.col("vec_id").alias("kp"), F.col("embedding").alias("desc"))


def _frame_pairs(features):
    frames = features.select("frame").distinct()
    return frames.select(F.col("frame").alias("source_id"), (F.col("frame") + 1).alias("target_id")).join(frames.select(F.col("frame").alias("target_id")), "target_id", "left_semi").select("source_id", "target_id")


RATIO = """WITH e AS (SELECT label AS frame, vec_id AS kp, embedding::DOUBLE[] AS v FROM embeddings),
  d AS (SELECT a.frame AS source_id, b.frame AS target_id, a.kp AS query, b.kp AS train, round(list_distance(a.v, b.v), 6) AS d FROM e a JOIN e b ON b.frame = a.frame + 1),
  k AS (SELECT *, row_number() OVER (PARTITION BY source_id, query ORDER BY d, train) AS k FROM d),
  m AS (SELECT source_id, target_id, query, max(train) FILTER (k = 1) AS best, max(d) FILTER (k = 1) AS d1, max(d) FILTER (k = 2) AS d2 FROM k WHERE k <= 2 GROUP BY ALL),
  r AS (SELECT * FROM m WHERE d1 < 0.95 * d2)"""


@query("ratio_match", RATIO + " SELECT * FROM r")
def _(spark, sf_dir):
    f = _features(spark, sf_dir)
    return matching.ratio_matches(_frame_pairs(f), f, ratio=0.95, round_to=6)


@query("match_counts", RATIO + ", n AS (SELECT frame FROM e GROUP BY 1 HAVING count(*) >= 8) SELECT source_id, target_id, count(*) AS num_matches FROM r WHERE source_id IN (FROM n) AND target_id IN (FROM n) GROUP BY ALL HAVING count(*) >= 6")
def _(spark, sf_dir):
    f = _features(spark, sf_dir)
    return matching.enough(matching.ratio_matches(_frame_pairs(f), f, ratio=0.95, round_to=6), f)


@query(
    "hamming_match",
    """WITH o AS (SELECT source, lead(source) OVER (ORDER BY source) AS next FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)),
    e AS (SELECT source, doc_id, ('0x' || substr(md5(text), 1, 15))::BIGINT AS v FROM documents),
    d AS (SELECT o.source AS source_id, o.next AS target_id, a.doc_id AS query, b.doc_id AS train, bit_count(xor(a.v, b.v))::BIGINT AS d FROM o JOIN e a ON a.source = o.source JOIN e b ON b.source = o.next),
    k AS (SELECT *, row_number() OVER (PARTITION BY source_id, query ORDER BY d, train) AS k FROM d)
    SELECT source_id, target_id, query, max(train) FILTER (k = 1) AS best, max(d) FILTER (k = 1) AS d1, max(d) FILTER (k = 2) AS d2 FROM k WHERE k <= 2 GROUP BY ALL""",
)
def _(spark, sf_dir):
    bits = F.conv(F.substring(F.md5("text"), 1, 15), 16, 10).cast("long")
    f = table(spark, sf_dir, "documents").select(F.col("source").alias("frame"), F.col("doc_id").alias("kp"), F.array(bits).alias("desc"))
    frames = f.select("frame").distinct().filter("frame IS NOT NULL")
    pairs = frames.select(F.col("frame").alias("source_id"), F.lead("frame").over(Window.orderBy("frame")).alias("target_id")).filter("target_id IS NOT NULL")
    return matching.two_nearest(pairs, f, "hamming")


@query("keypoint_cap", "SELECT label, vec_id, k FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS k FROM embeddings) WHERE k <= 5")
def _(spark, sf_dir):
    features = table(spark, sf_dir, "embeddings").withColumn("response", F.get("embedding", F.lit(0)))
    return matching.strongest(features, 5, "response", "label", "vec_id").select("label", "vec_id", F.col("rank").alias("k"))


POINTS = "SELECT l_suppkey AS pair_id, l_quantity AS x, l_discount * 100 AS y, 2 * l_quantity + l_tax AS u, 3 * (l_discount * 100) - l_tax AS v, l_extendedprice AS z FROM lineitem"


def _points(spark, sf_dir):
    q, d, t = F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax")
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("pair_id"), q.alias("x"), d.alias("y"), (2 * q + t).alias("u"), (3 * d - t).alias("v"))


@query("axis_fit", f"WITH p AS ({POINTS}) SELECT pair_id, count(*) AS n, round(regr_slope(u, x), 6) AS sx, round(regr_intercept(u, x), 6) AS tx, round(regr_slope(v, y), 6) AS sy, round(regr_intercept(v, y), 6) AS ty FROM p GROUP BY 1")
def _(spark, sf_dir):
    return _points(spark, sf_dir).groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"), r6(F.regr_slope("u", "x")).alias("sx"), r6(F.regr_intercept("u", "x")).alias("tx"), r6(F.regr_slope("v", "y")).alias("sy"), r6(F.regr_intercept("v", "y")).alias("ty"))


@query(
    "pair_fit",
    """SELECT l_suppkey AS pair_id, count(*) AS num_matches, count(*) FILTER (l_linenumber < 7) AS num_inliers, 'success' AS status,
      1.1::DOUBLE AS a, 0.0::DOUBLE AS b, 5.0::DOUBLE AS c, 0.0::DOUBLE AS d, 0.9::DOUBLE AS e, (-7.0)::DOUBLE AS f, 0.0::DOUBLE AS error FROM lineitem GROUP BY 1""",
)
def _(spark, sf_dir):
    """The robust fit of points whose transform is known; those of line 7 are far off."""
    x, y, k = F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_suppkey")
    off = F.when(F.col("l_linenumber") >= 7, 500.0).otherwise(0.0)
    points = table(spark, sf_dir, "lineitem").select(k.alias("source_id"), (-k).alias("target_id"), x.alias("sx"), y.alias("sy"), (x * 1.1 + 5 + off).alias("tx"), (y * 0.9 - 7 - off).alias("ty"))
    found = matching.pair_transforms(points, "affine")
    entries = {c: (r6(F.get("matrix", F.lit(i))) + 0.0).alias(c) for i, c in enumerate("abcdef")}
    return found.select(F.col("source_id").alias("pair_id"), F.col("num_matches").cast("long"), F.col("num_inliers").cast("long"), "status", *entries.values(), (r6("reprojection_error") + 0.0).alias("error"))


@query("reprojection_rmse", f"WITH p AS ({POINTS}) SELECT pair_id, round(coalesce(sqrt(avg(pow(2 * x + 0.04 - u, 2) + pow(3 * y - 0.04 - v, 2)) FILTER (x > 25)), 999.0), 6) AS rmse FROM p GROUP BY 1")
def _(spark, sf_dir):
    m = affine.matrix(2, 0, 0.04, 0, 3, -0.04, 0, 0, 1)
    px, py = affine.project(m, F.col("x"), F.col("y"))
    off = (px - F.col("u")) * (px - F.col("u")) + (py - F.col("v")) * (py - F.col("v"))
    return _points(spark, sf_dir).groupBy("pair_id").agg(r6(F.coalesce(F.sqrt(F.avg(F.when(F.col("x") > 25, off))), F.lit(999.0))).alias("rmse"))


FITS = """SELECT o_orderkey AS source_id, o_custkey AS target_id, o_orderkey % 4 <> 0 AS ok_a, o_orderkey % 5 <> 0 AS ok_h, (o_orderkey % 37)::INT AS in_a, (o_orderkey % 41)::INT AS in_h,
  o_totalprice / 100000 AS err_a, o_totalprice / 100000 - (o_orderkey % 9) / 8.0 AS err_h FROM orders"""


@query("model_compare", f"WITH f AS ({FITS}) SELECT source_id, target_id, CASE WHEN ok_a AND ok_h THEN CASE WHEN err_a - err_h > 0.5 AND in_h >= in_a THEN 'homography' ELSE 'affine' END WHEN ok_a THEN 'affine' WHEN ok_h THEN 'homography' ELSE 'neither' END AS winner, round(err_a - err_h, 6) AS gain FROM f")
def _(spark, sf_dir):
    k = F.col("o_orderkey")

    def side(every, inliers, error):
        return table(spark, sf_dir, "orders").select(k.alias("source_id"), F.col("o_custkey").alias("target_id"), F.when(k % every != 0, "success").otherwise("failed").alias("status"), (k % inliers).cast("int").alias("num_inliers"), error.alias("reprojection_error"))

    price = F.col("o_totalprice") / 100000
    return matching.compare_models(side(4, 37, price), side(5, 41, price - (k % 9) / 8.0)).withColumn("gain", r6("gain"))


@query("match_statistics", f"WITH f AS ({FITS}) SELECT count(*) AS pairs, sum(in_a) FILTER (ok_a)::BIGINT AS inliers, round(avg(in_a / 37.0) FILTER (ok_a), 9) AS mean_inlier_ratio, round(avg(err_a) FILTER (ok_a), 9) AS mean_error FROM f")
def _(spark, sf_dir):
    k = F.col("o_orderkey")
    t = table(spark, sf_dir, "orders").select(F.when(k % 4 != 0, "success").otherwise("failed").alias("status"), (k % 37).cast("int").alias("num_inliers"), (k % 37 / 37.0).alias("inlier_ratio"), (F.col("o_totalprice") / 100000).alias("reprojection_error"))
    s = matching.match_statistics(t)
    return s.select("pairs", "inliers", r6("mean_inlier_ratio", 9).alias("mean_inlier_ratio"), r6("mean_error", 9).alias("mean_error"))


POSES = """SELECT o_orderkey AS frame_id, o_custkey AS flight_id, (o_orderkey % 997) * 3.0 AS x, (o_custkey % 499) * 2.0 AS y, radians(o_orderkey % 360) AS theta, 0.5 + (o_orderkey % 11) / 10.0 AS scale,
  640 AS width, 480 AS height FROM orders"""


def _poses(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    p = table(spark, sf_dir, "orders").select(k.alias("frame_id"), c.alias("flight_id"), (k % 997 * 3.0).alias("x"), (c % 499 * 2.0).alias("y"), F.radians(k % 360).alias("theta"), (0.5 + k % 11 / 10.0).alias("scale"), F.lit(640).alias("width"), F.lit(480).alias("height"))
    return p.withColumn("matrix", affine.similarity(F.col("x"), F.col("y"), F.col("theta"), F.col("scale"), F.col("width") / 2.0, F.col("height") / 2.0))


@query("pose_decompose", f"WITH p AS ({POSES}) SELECT frame_id, round(scale, 6) AS scale, round(atan2(sin(theta) * scale, cos(theta) * scale), 6) AS rotation FROM p")
def _(spark, sf_dir):
    scale, turn = affine.scale_and_rotation(F.col("matrix"))
    return _poses(spark, sf_dir).select("frame_id", r6(scale).alias("scale"), r6(turn).alias("rotation"))


@query("transform_sanity", f"WITH p AS ({POSES}), m AS (SELECT *, cos(theta) * scale AS c, sin(theta) * scale AS s FROM p), t AS (SELECT *, x - 320 * c + 240 * s AS tx, y - 320 * s - 240 * c AS ty FROM m) SELECT frame_id, (scale * scale > 0.05 AND scale * scale < 20 AND scale BETWEEN 0.4 AND 2.5 AND abs(degrees(atan2(s, c))) <= 75.000001 AND abs(tx) <= 960 AND abs(ty) <= 720) AS sane FROM t")
def _(spark, sf_dir):
    return _poses(spark, sf_dir).select("frame_id", affine.is_sane(F.col("matrix"), F.col("width"), F.col("height"), max_rotation=75.000001).alias("sane"))


@query("canvas_priors", f"WITH f AS ({FRAMES}), p AS ({XY}), o AS (SELECT min(x) AS x0, max(y) AS y0 FROM p) SELECT frame_id, round((x - x0) / 0.1, 4) AS px, round((y0 - y) / 0.1, 4) AS py, round(radians(coalesce(yaw, 0)), 9) AS theta FROM p, o")
def _(spark, sf_dir):
    p = _placed(spark, sf_dir)
    one = p.agg(F.min("x").alias("x0"), F.max("y").alias("y0"))
    px, py = affine.world_to_pixel(F.col("x"), F.col("y"), F.col("x0"), F.col("y0"), F.lit(0.1))
    return p.join(F.broadcast(one), F.lit(True)).select("frame_id", r6(px, 4).alias("px"), r6(py, 4).alias("py"), r6(F.radians(F.coalesce("yaw", F.lit(0.0))), 9).alias("theta"))


GRAPH = "SELECT DISTINCT 2 * l_orderkey AS a, 2 * l_partkey + 1 AS b FROM lineitem"


def _graph(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select((2 * F.col("l_orderkey")).alias("a"), (2 * F.col("l_partkey") + 1).alias("b"))


@query("placement_levels", f"WITH RECURSIVE g AS ({GRAPH}), u AS (SELECT a, b FROM g UNION SELECT b, a FROM g), w(node, level) USING KEY (node) AS (SELECT min(a), 0 FROM g UNION SELECT u.b, min(w.level) + 1 FROM w JOIN u ON u.a = w.node WHERE u.b NOT IN (SELECT node FROM recurring.w) GROUP BY u.b) SELECT node, level FROM w")
def _(spark, sf_dir):
    graph = _graph(spark, sf_dir).withColumn("g", F.lit(0))  # with repeated edges, which a level's grouping takes together
    first = graph.agg(F.min("a").alias("node")).filter("node IS NOT NULL").withColumn("g", F.lit(0))
    return placement.levels(graph, first).select("node", "level")


TURNS = """e AS (SELECT DISTINCT l_suppkey % 7 AS g, 2 * l_orderkey AS a, 2 * l_partkey + 1 AS b FROM lineitem),
  m AS (SELECT *, a * 1000003 + b AS number, cos(radians((a * 7 + b * 13) % 360)) AS c, sin(radians((a * 7 + b * 13) % 360)) AS s, (a % 101 - 50)::DOUBLE AS x, (b % 103 - 51)::DOUBLE AS y FROM e),
  u AS (SELECT g, a, b, number, c, -s AS s, -(c * x + s * y) AS x, s * x - c * y AS y FROM m UNION ALL SELECT g, b, a, number, c, s, x, y FROM m),
  f AS (SELECT DISTINCT g, unnest([a, b]) AS node FROM e), o AS (SELECT g, min(node) AS node FROM f GROUP BY g)"""
SPOT = "CASE WHEN {n} % 5 <> 0 THEN 30 + {n} % 1009 / 1e5 END"


@query(
    "placement_transforms",
    f"""WITH RECURSIVE {TURNS},
    w(g, node, level, c, s, x, y) USING KEY (g, node) AS (SELECT g, node, 0, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM o UNION
      SELECT u.g, u.b, min(w.level) + 1, arg_min(w.c * u.c - w.s * u.s, u.number), arg_min(w.s * u.c + w.c * u.s, u.number), arg_min(w.c * u.x - w.s * u.y + w.x, u.number), arg_min(w.s * u.x + w.c * u.y + w.y, u.number)
      FROM w JOIN u ON u.g = w.g AND u.a = w.node WHERE (u.g, u.b) NOT IN (SELECT (g, node) FROM recurring.w) GROUP BY u.g, u.b),
    l AS (SELECT f.g, f.node, {SPOT.format(n="f.node")} AS lat, 70 + f.node % 997 / 1e5 AS lon, coalesce({SPOT.format(n="o.node")}, 0) AS lat0, 70 + o.node % 997 / 1e5 AS lon0 FROM f JOIN o ON o.g = f.g)
    SELECT g, node AS frame_id, 'visual' AS placed, round(c, 6) + 0.0::DOUBLE AS c, round(s, 6) + 0.0::DOUBLE AS s, round(x, 3) + 0.0::DOUBLE AS x, round(y, 3) + 0.0::DOUBLE AS y FROM w
    UNION ALL SELECT l.g, l.node, 'gps', 1.0, 0.0, round(6371000.0 * radians(lon - lon0) * cos(radians((lat + lat0) / 2)) * 10, 3) + 0.0::DOUBLE, round(-6371000.0 * radians(lat - lat0) * 10, 3) + 0.0::DOUBLE
    FROM l ANTI JOIN w ON w.g = l.g AND w.node = l.node WHERE lat IS NOT NULL""",
)
def _(spark, sf_dir):
    """Frames placed by turns and shifts along the graph of orders and parts, in seven surveys; the rest by position."""
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 7).alias("g"), (2 * F.col("l_orderkey")).alias("source_id"), (2 * F.col("l_partkey") + 1).alias("target_id"))
    a, b = F.col("source_id"), F.col("target_id")
    turn = F.radians((a * 7 + b * 13) % 360)
    pairs = lines.select("g", a, b, (a * 1000003 + b).alias("number"), affine.matrix(F.cos(turn), -F.sin(turn), (a % 101 - 50).cast("double"), F.sin(turn), F.cos(turn), (b % 103 - 51).cast("double"), 0, 0, 1).alias("matrix"))
    n = F.col("frame_id")
    # dealt by frame first: before that hardly any two rows of a task are alike
    frames = lines.select("g", F.explode(F.array(a, b)).alias("frame_id")).repartition("g", "frame_id").distinct().withColumns({"lat": F.when(n % 5 != 0, n % 1009 / 1e5 + 30), "lon": n % 997 / 1e5 + 70})
    entry = lambda i, digits: (r6(F.get("matrix", i), digits) + 0.0)
    return placement.place(frames, pairs, "g", ["frame_id"]).select("g", "frame_id", "placed", entry(0, 6).alias("c"), entry(3, 6).alias("s"), entry(2, 3).alias("x"), entry(5, 3).alias("y"))


@query("pose_solution")
def _(spark, sf_dir):
    """Poses of all flights at once, from transforms along the flights and between neighbours that disagree a little with the positions."""
    frames = plan.fill_headings(plan.project_utm(frames_view(spark, sf_dir), ["flight_id"]), ["flight_id"], ["ts", "frame_id"]).withColumns({"width": F.lit(640), "height": F.lit(480)})
    frames = cut(frames.select("flight_id", "frame_id", "easting", "northing", F.lit(0.0).alias("yaw"), "width", "height"))
    pairs = plan.neighbor_graph(frames, 4, 150.0, "easting", "northing", ["flight_id"])
    side = lambda k, c: frames.select("flight_id", F.col("frame_id").alias(k), F.col("easting").alias(f"e{c}"), F.col("northing").alias(f"n{c}"))
    met = pairs.join(side("source_id", "s"), ["flight_id", "source_id"]).join(side("target_id", "t"), ["flight_id", "target_id"])
    off = lambda k: (F.pmod(F.xxhash64("source_id", "target_id", F.lit(k)), F.lit(1000)) / 1000.0 - 0.5) * 4
    matrix = affine.shift((F.col("es") - F.col("et")) / 0.1 + off(1), (F.col("nt") - F.col("ns")) / 0.1 + off(2))
    transforms = met.select("flight_id", "source_id", "target_id", matrix.alias("matrix"), F.lit(0.8).alias("inlier_ratio"), F.lit("success").alias("status"))
    found = poses.solve_poses(frames, transforms, 0.1, survey="flight_id")
    return found.select("flight_id", "frame_id", *(r6(c, 3).alias(c) for c in ("world_x", "world_y", "rotation", "scale")), "confidence", "connected")


@query("gps_fallback", f"WITH f AS ({FRAMES}), p AS ({XY}), m AS (SELECT DISTINCT l_orderkey AS frame_id FROM lineitem), o AS (SELECT x AS x0, y AS y0 FROM p ORDER BY frame_id LIMIT 1) SELECT frame_id, 'visual' AS placed, 0.0::DOUBLE AS tx, 0.0::DOUBLE AS ty FROM p SEMI JOIN m USING (frame_id) UNION ALL SELECT frame_id, 'gps', round((x - x0) * 10, 4), round((y0 - y) * 10, 4) FROM (FROM p ANTI JOIN m USING (frame_id)), o")
def _(spark, sf_dir):
    p = _placed(spark, sf_dir)
    seen = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frame_id")).distinct()
    one = p.orderBy("frame_id").limit(1).select(F.col("x").alias("x0"), F.col("y").alias("y0"))
    visual = p.join(seen, "frame_id", "left_semi").select("frame_id", F.lit("visual").alias("placed"), F.lit(0.0).alias("tx"), F.lit(0.0).alias("ty"))
    rest = p.join(seen, "frame_id", "left_anti").join(F.broadcast(one), F.lit(True))
    return visual.unionByName(rest.select("frame_id", F.lit("gps").alias("placed"), r6((F.col("x") - F.col("x0")) * 10, 4).alias("tx"), r6((F.col("y0") - F.col("y")) * 10, 4).alias("ty")))


@query("frame_confidence", "SELECT c_custkey AS frame_id, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') THEN 1.0 ELSE 0.5 END::DOUBLE AS confidence FROM customer")
def _(spark, sf_dir):
    pairs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source_id"), F.col("o_custkey").alias("target_id"), F.when(F.col("o_orderstatus") == "F", "success").otherwise("failed").alias("status"))
    return matching.frame_confidence(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("frame_id")), pairs)


@query("valid_pairs", "SELECT o_orderkey AS pair_id FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND o_orderkey % 25 IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
def _(spark, sf_dir):
    sources = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("frame_id"))
    targets = table(spark, sf_dir, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").cast("long").alias("frame_id"))
    k = F.col("o_orderkey")
    pairs = table(spark, sf_dir, "orders").select(k, F.col("o_custkey").alias("source_id"), (k % 25).alias("target_id"), F.when(F.col("o_orderstatus") == "F", "success").otherwise("failed").alias("status"))
    return matching.valid_pairs(pairs, sources, targets).select(k.alias("pair_id"))


# ---------------------------------------------------------------------------------------------------- canvas, tiles, blend

BOXES = f"""p AS ({POSES}), m AS (SELECT *, cos(theta) * scale AS c, sin(theta) * scale AS s FROM p), t AS (SELECT *, x - 320.0 * c + 240.0 * s AS tx, y - 320.0 * s - 240.0 * c AS ty FROM m),
  k AS (SELECT frame_id, c * qx - s * qy + tx AS px, s * qx + c * qy + ty AS py FROM t, (VALUES (0, 0), (640, 0), (640, 480), (0, 480)) q(qx, qy)),
  b AS (SELECT frame_id, min(px) AS x0, min(py) AS y0, max(px) AS x1, max(py) AS y1 FROM k GROUP BY 1),
  v AS (SELECT min(x0) AS min_x, min(y0) AS min_y, max(x1) AS max_x, max(y1) AS max_y, ceil(max(x1) - min(x0))::BIGINT AS width_px, ceil(max(y1) - min(y0))::BIGINT AS height_px FROM b)"""


@query("frame_boxes", f"WITH {BOXES} SELECT frame_id, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1 FROM b")
def _(spark, sf_dir):
    return compose.frame_boxes(_poses(spark, sf_dir)).select("frame_id", *(r6(c).alias(c) for c in ("x0", "y0", "x1", "y1")))


@query("canvas_bounds", f"WITH {BOXES} SELECT round(min_x, 6) AS min_x, round(min_y, 6) AS min_y, round(max_x, 6) AS max_x, round(max_y, 6) AS max_y, width_px, height_px FROM v")
def _(spark, sf_dir):
    return compose.canvas_of(compose.frame_boxes(_poses(spark, sf_dir))).select(*(r6(c).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")), "width_px", "height_px")


GRID = f"""WITH {BOXES}, g AS (SELECT r AS row, c AS col, c * 512 AS x0, r * 512 AS y0, least((c + 1) * 512, width_px) AS x1, least((r + 1) * 512, height_px) AS y1
  FROM v, range(0, (SELECT ceil(height_px / 512.0)::BIGINT FROM v)) a(r), range(0, (SELECT ceil(width_px / 512.0)::BIGINT FROM v)) d(c)),
  o AS (SELECT row, col, frame_id FROM g JOIN (SELECT frame_id, x0 - min_x AS bx0, y0 - min_y AS by0, x1 - min_x AS bx1, y1 - min_y AS by1 FROM b, v) ON NOT (bx1 < g.col * 512 OR bx0 > (g.col + 1) * 512 OR by1 < g.row * 512 OR by0 > (g.row + 1) * 512))"""


def _layout(spark, sf_dir):
    boxes = compose.frame_boxes(_poses(spark, sf_dir))
    canvas = compose.canvas_of(boxes)
    return boxes, canvas, compose.shifted(boxes, canvas)


@query("tile_grid", GRID + " SELECT * FROM g")
def _(spark, sf_dir):
    return compose.tile_grid(_layout(spark, sf_dir)[1], 512)


@query("tile_overlap", GRID + " SELECT * FROM o")
def _(spark, sf_dir):
    return compose.tile_frames(_layout(spark, sf_dir)[2], 512)


@query("empty_tiles", GRID + " SELECT row, col, g.x0, g.y0, g.x1, g.y1, count(frame_id) AS frames, count(frame_id) = 0 AS is_empty FROM g LEFT JOIN o USING (row, col) GROUP BY ALL")
def _(spark, sf_dir):
    _, canvas, moved = _layout(spark, sf_dir)
    return compose.covered_tiles(compose.tile_grid(canvas, 512), compose.tile_frames(moved, 512))


PIXELS = "SELECT c_custkey % 40 AS px, c_custkey % 30 AS py, c_acctbal / 40 AS r, c_nationkey * 10.0 AS g, 128.0 AS b, greatest(0.0, least(1.0, (c_custkey % 7) / 5.0)) AS weight FROM customer"


def _pixels(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select((k % 40).alias("px"), (k % 30).alias("py"), (F.col("c_acctbal") / 40).alias("r"), (F.col("c_nationkey") * 10.0).alias("g"), F.lit(128.0).alias("b"), fr.feather((k % 7).cast("double"), 5.0).alias("weight"))


def _blended(c):
    return f"CASE WHEN sum(weight) > 1e-4 THEN floor(greatest(0.0, least(255.0, sum({c} * weight) / sum(weight) + 0))) ELSE 0 END::INT AS {c}"


@query("feather_blend", f"WITH p AS ({PIXELS}) SELECT px, py, {_blended('r')}, {_blended('g')}, {_blended('b')}, CASE WHEN sum(weight) > 1e-4 THEN 255 ELSE 0 END AS alpha FROM p GROUP BY px, py")
def _(spark, sf_dir):
    return compose.blend(_pixels(spark, sf_dir), ["px", "py"], ["r", "g", "b"])


GAIN = "CASE WHEN m < 10 OR m > 245 THEN 1.0 ELSE greatest(0.8, least(1.25, 128.0 / m)) END"


@query("exposure_gain", f"WITH p AS ({PIXELS}), f AS (SELECT py, avg(0.114 * b + 0.587 * g + 0.299 * r) AS m FROM p GROUP BY 1) SELECT py, round(m, 6) AS luminance, round({GAIN}, 6) AS gain, CASE WHEN abs({GAIN} - 1) < 0.01 THEN 100 ELSE floor(greatest(0, least(255, 100 * {GAIN})))::INT END AS hundred FROM f")
def _(spark, sf_dir):
    light = _pixels(spark, sf_dir).groupBy("py").agg(F.avg(0.114 * F.col("b") + 0.587 * F.col("g") + 0.299 * F.col("r")).alias("m"))
    gain = fr.exposure_gain(F.col("m"))
    return light.select("py", r6("m").alias("luminance"), r6(gain).alias("gain"), fr.apply_gain(F.lit(100), gain).alias("hundred"))


@query("overview_level", "SELECT floor(c_custkey % 40 / 2.0)::BIGINT AS x, floor(c_custkey % 30 / 2.0)::BIGINT AS y, floor(avg(c_nationkey * 10.0))::INT AS g FROM customer GROUP BY 1, 2")
def _(spark, sf_dir):
    return compose.halve(_pixels(spark, sf_dir).select(F.col("px").alias("x"), F.col("py").alias("y"), "g"), ["g"])


@query("georeference", f"WITH f AS ({FRAMES}), u AS ({UTM}), o AS (SELECT min(easting) + (-12.5) * 0.1 AS left_m, max(northing) - (-7.5) * 0.1 AS top_m FROM u) SELECT round(left_m, 3) AS left_m, round(top_m, 3) AS top_m, round(left_m + 1000 * 0.1, 3) AS right_m, round(top_m - 800 * 0.1, 3) AS bottom_m FROM o")
def _(spark, sf_dir):
    u = plan.project_utm(frames_view(spark, sf_dir), ["flight_id"])
    o = u.agg((F.min("easting") + F.lit(-12.5) * 0.1).alias("left_m"), (F.max("northing") - F.lit(-7.5) * 0.1).alias("top_m"))
    right, bottom = affine.pixel_to_world(F.lit(1000), F.lit(800), F.col("left_m"), F.col("top_m"), F.lit(0.1))
    return o.select(r6("left_m", 3).alias("left_m"), r6("top_m", 3).alias("top_m"), r6(right, 3).alias("right_m"), r6(bottom, 3).alias("bottom_m"))


@query("projected_bounds", f"WITH f AS ({FRAMES}), p AS ({XY}) SELECT flight_id, round(min(x) - 5, 4) AS west, round(min(y) - 5, 4) AS south, round(max(x) + 5, 4) AS east, round(max(y) + 5, 4) AS north FROM p GROUP BY 1")
def _(spark, sf_dir):
    boxes = _placed(spark, sf_dir).groupBy("flight_id").agg(geo.projected_box(F.col("x"), F.col("y"), 5.0).alias("b"))
    return boxes.select("flight_id", *(r6(F.col(f"b.{c}"), 4).alias(c) for c in ("west", "south", "east", "north")))


ZOOMED = f"WITH s AS ({SITES}), z AS (SELECT id, lat + 0.1234 AS lat, lon + 0.4321 AS lon, z, pow(2.0, z) AS n FROM s, (VALUES (2), (7), (12)) v(z))"


def _zoomed(spark, sf_dir):
    return _sites(spark, sf_dir).select("id", (F.col("lat") + 0.1234).alias("lat"), (F.col("lon") + 0.4321).alias("lon"), F.explode(F.array(F.lit(2), F.lit(7), F.lit(12))).alias("z"))


SLIPPY = "trunc((1.0 - asinh(tan(radians({lat}))) / pi()) / 2.0 * n)::BIGINT"


@query("slippy_tiles", ZOOMED + f" SELECT id, z, trunc((lon + 180.0) / 360.0 * n)::BIGINT AS x, {SLIPPY.format(lat='lat')} AS y FROM z")
def _(spark, sf_dir):
    x, y = geo.slippy_tile(F.col("lat"), F.col("lon"), F.col("z"))
    return _zoomed(spark, sf_dir).select("id", "z", x.alias("x"), y.alias("y"))


@query("clamped_tiles", ZOOMED + f" SELECT id, z, greatest(0, least((n - 1)::BIGINT, trunc((lon * 2 + 180.0) / 360.0 * n)::BIGINT)) AS x, greatest(0, least((n - 1)::BIGINT, {SLIPPY.format(lat='least(85.05112878, greatest(-85.05112878, lat * 2))')})) AS y FROM z")
def _(spark, sf_dir):
    x, y = geo.clamped_tile(F.col("lat") * 2, F.col("lon") * 2, F.col("z"))
    return _zoomed(spark, sf_dir).select("id", "z", x.alias("x"), y.alias("y"))


@query("tile_bounds", "SELECT n_nationkey AS id, round(n_nationkey / 32.0 * 360 - 180, 6) AS west, round(degrees(atan(sinh(pi() * (1 - 2 * (n_nationkey + 1) / 32.0)))), 6) AS south, round((n_nationkey + 1) / 32.0 * 360 - 180, 6) AS east, round(degrees(atan(sinh(pi() * (1 - 2 * n_nationkey / 32.0)))), 6) AS north FROM nation")
def _(spark, sf_dir):
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(n.alias("id"), *(r6(c).alias(k) for k, c in geo.tile_bounds(n, n, F.lit(5)).items()))


@query("mercator", f"WITH s AS ({SITES}) SELECT id, round(lon * 20037508.34 / 180, 3) AS x, round(ln(tan((90 + lat) * pi() / 360)) / (pi() / 180) * 20037508.34 / 180, 3) AS y FROM s")
def _(spark, sf_dir):
    x, y = geo.to_mercator(F.col("lat"), F.col("lon"))
    return _sites(spark, sf_dir).select("id", r6(x, 3).alias("x"), r6(y, 3).alias("y"))


ZOOM = "greatest(14, least(19, round_even(log2(156543.03392 / greatest(gsd, 0.05)), 0)::INT))"


@query("natural_zoom", f"WITH c AS ({CAMERAS}), g AS (SELECT id, {GSD} * 10 AS gsd FROM c) SELECT id, greatest(14, {ZOOM} - 1) AS zoom_min, greatest(greatest(14, {ZOOM} - 1), least(19, {ZOOM})) AS zoom_max FROM g")
def _(spark, sf_dir):
    least, most = geo.zoom_range(F.col("gsd") * 10)
    return _cameras(spark, sf_dir).select("id", least.alias("zoom_min"), most.alias("zoom_max"))


@query("xyz_cover", f"WITH f AS ({FRAMES}), b AS (SELECT flight_id, min(lat) AS s, max(lat) AS n0, min(lon) AS w, max(lon) AS e, pow(2.0, 16) AS n FROM f GROUP BY 1), t AS (SELECT flight_id, trunc((w + 180) / 360 * n)::BIGINT AS x0, trunc((e + 180) / 360 * n)::BIGINT AS x1, {SLIPPY.format(lat='n0')} AS y0, {SLIPPY.format(lat='s')} AS y1 FROM b) SELECT flight_id, unnest(range(x0, x1 + 1)) AS x, y FROM (SELECT flight_id, x0, x1, unnest(range(y0, y1 + 1)) AS y FROM t)")
def _(spark, sf_dir):
    b = frames_view(spark, sf_dir).groupBy("flight_id").agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"))
    x0, y0 = geo.clamped_tile(F.col("n"), F.col("w"), F.lit(16))
    x1, y1 = geo.clamped_tile(F.col("s"), F.col("e"), F.lit(16))
    return b.select("flight_id", F.sequence(y0, y1).alias("ys"), F.explode(F.sequence(x0, x1)).alias("x")).select("flight_id", "x", F.explode("ys").alias("y"))


@query("tile_report", "SELECT count(*) AS tile_count, sum(n_chars)::BIGINT AS tile_bytes, lang FROM documents GROUP BY lang")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("tile_count"), F.sum("n_chars").alias("tile_bytes"))


# ------------------------------------------------------------------------------------------------------ scalar conversions


@query("exif_scalars", "SELECT event_id, CASE WHEN upper(trim(CASE WHEN event_id % 2 = 0 THEN ' s ' ELSE 'N' END)) IN ('S', 'W') THEN -1 ELSE 1 END * round(event_id % 90 + (event_id % 60) / 60.0 + (event_id % 3600) / 360000.0, 9) + 0.0 AS degrees, ((((event_id * 37) % 800 - 400)::DOUBLE % 360) + 360) % 360 AS yaw, CASE WHEN value - 50 > 0 THEN value - 50 ELSE value END AS altitude FROM events")
def _(spark, sf_dir):
    e = F.col("event_id")
    dms = F.array((e % 90).cast("double"), (e % 60).cast("double"), (e % 3600) / 100.0)
    yaw = geo.normalised_yaw((e * 37) % 800 - 400)
    return table(spark, sf_dir, "events").select("event_id", r6(geo.dms_to_degrees(dms, F.when(e % 2 == 0, " s ").otherwise("N")), 9).alias("degrees"), yaw.alias("yaw"), fr.chosen_altitude(F.col("value") - 50, F.col("value")).alias("altitude"))


@query("image_sizes", "WITH p AS (SELECT p_partkey AS id, p_size * 100 AS w, p_size * 70 + 5 AS h, p_partkey % 8 + 1 AS o FROM part), s AS (SELECT *, least(1.0, sqrt(600000.0 / (w * h))) AS k, least(1.0, 1000.0 / greatest(w, h)) AS m FROM p) SELECT id, CASE WHEN o >= 5 THEN h ELSE w END AS ow, CASE WHEN o >= 5 THEN w ELSE h END AS oh, greatest(1, round_even(w * k, 0)::INT) AS bw, greatest(1, round_even(h * k, 0)::INT) AS bh, greatest(1, round_even(w * m, 0)::INT) AS sw, greatest(1, round_even(h * m, 0)::INT) AS sh FROM s")
def _(spark, sf_dir):
    w, h = F.col("p_size") * 100, F.col("p_size") * 70 + 5
    ow, oh = fr.oriented_size(w, h, F.col("p_partkey") % 8 + 1)
    bw, bh = fr.scaled_size(w, h, fr.budget_scale(w, h, 600_000))
    sw, sh = fr.scaled_size(w, h, fr.max_side_scale(w, h, 1000))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), ow.alias("ow"), oh.alias("oh"), bw.alias("bw"), bh.alias("bh"), sw.alias("sw"), sh.alias("sh"))


@query("pixel_coordinates", f"WITH f AS ({FRAMES}), p AS ({XY}), q AS (SELECT frame_id, (x + 11000000) / 0.5 AS col, (3800000 - y) / 0.5 AS row FROM p) SELECT frame_id, round(col, 4) AS col, round(row, 4) AS row, round(-11000000 + col * 0.5, 4) AS x, round(3800000 - row * 0.5, 4) AS y FROM q")
def _(spark, sf_dir):
    left, top, size = F.lit(-11_000_000.0), F.lit(3_800_000.0), F.lit(0.5)
    c, r = affine.world_to_pixel(F.col("x"), F.col("y"), left, top, size)
    x, y = affine.pixel_to_world(c, r, left, top, size)
    return _placed(spark, sf_dir).select("frame_id", r6(c, 4).alias("col"), r6(r, 4).alias("row"), r6(x, 4).alias("x"), r6(y, 4).alias("y"))


# ---------------------------------------------------------------------------------------------------- telemetry and reports


def _log(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("stage"), F.col("value").alias("v"))


STAGES = "t AS (SELECT user_id AS run, event_type AS stage, ts, event_id, epoch(lead(ts) OVER o) - epoch(ts) AS seconds FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)), d AS (SELECT run, stage, arg_max(seconds, (ts, event_id)) AS seconds FROM t WHERE seconds IS NOT NULL GROUP BY 1, 2)"


@query("stage_durations", f"WITH {STAGES} SELECT run, stage, round(seconds, 3) AS seconds FROM d")
def _(spark, sf_dir):
    return telemetry.stage_durations(_log(spark, sf_dir), ["run"]).withColumn("seconds", r6("seconds", 3))


@query("stage_share", f"WITH {STAGES} SELECT run, stage, round(seconds, 3) AS seconds, round(seconds / greatest(sum(seconds) OVER (PARTITION BY run), 0.001) * 100, 6) AS share FROM d")
def _(spark, sf_dir):
    return telemetry.stage_shares(telemetry.stage_durations(_log(spark, sf_dir), ["run"]), ["run"]).withColumns({"seconds": r6("seconds", 3), "share": r6("share")})


@query("first_tile", "SELECT user_id AS run, round(min(epoch(ts)) FILTER (event_type = (SELECT min(event_type) FROM events)) - min(epoch(ts)), 3) AS seconds FROM events GROUP BY 1")
def _(spark, sf_dir):
    log = _log(spark, sf_dir)
    kind = log.agg(F.min("stage").alias("kind"))
    return telemetry.time_to_first(log.join(F.broadcast(kind), F.lit(True)), ["run"], F.col("stage") == F.col("kind")).withColumn("seconds", r6("seconds", 3))


@query("event_labels", "SELECT user_id AS run, event_id AS seq, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 THEN 'first_tile' ELSE 'tile_written' END AS event FROM events")
def _(spark, sf_dir):
    return telemetry.label_events(_log(spark, sf_dir), ["run"], ["ts", "seq"]).select("run", "seq", "event")


@query("resource_usage", "SELECT user_id AS run, coalesce(max(value * 10), 0.0) AS peak_ram_mb, round(coalesce(avg(value), 0.0), 9) AS avg_cpu_percent FROM events GROUP BY 1")
def _(spark, sf_dir):
    return telemetry.usage(_log(spark, sf_dir).select("run", (F.col("v") * 10).alias("rss_ram_mb"), F.col("v").alias("cpu_percent")), ["run"]).withColumn("avg_cpu_percent", r6("avg_cpu_percent", 9))


@query("telemetry_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, round(avg(value), 9) AS mean, max(value) AS peak, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf_dir):
    return telemetry.windows(_log(spark, sf_dir), "1 hour", "ts", "v").withColumn("mean", r6("mean", 9))


@query("settle_sessions", "WITH l AS (SELECT user_id AS run, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) < 21600 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY run ORDER BY ts) AS session FROM l) SELECT run, session::BIGINT AS session, min(ts) AS began, max(ts) AS last, count(*) AS files FROM s GROUP BY 1, 2")
def _(spark, sf_dir):
    return telemetry.settled_sessions(_log(spark, sf_dir), ["run"], 21600)


SIZES = "SELECT source, sum(n_chars)::BIGINT AS raw_bytes, sum(n_chars) FILTER (doc_id % 3 = 0)::BIGINT AS product_bytes FROM documents GROUP BY 1"


def _sizes(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("raw_bytes"), F.sum(F.when(F.col("doc_id") % 3 == 0, F.col("n_chars"))).alias("product_bytes"))


@query("bandwidth_table", f"WITH s AS ({SIZES}), t AS (SELECT *, raw_bytes * 8.0 / (mbps * 1e6) AS a, product_bytes * 8.0 / (mbps * 1e6) AS b FROM s, (VALUES (1.0::DOUBLE), (5.0), (20.0)) v(mbps)) SELECT source, mbps, round(a, 9) AS raw_seconds, round(b, 9) AS product_seconds, round(greatest(0.0, a - b), 9) AS saved_seconds, round(CASE WHEN a > 0 THEN greatest(0.0, a - b) / a * 100 ELSE 0 END, 6) AS saved_percent FROM t")
def _(spark, sf_dir):
    t = telemetry.bandwidth_table(_sizes(spark, sf_dir), "raw_bytes", "product_bytes")
    return t.select("source", "mbps", *(r6(c, 9).alias(c) for c in ("raw_seconds", "product_seconds", "saved_seconds")), r6("saved_percent").alias("saved_percent"))


@query("reduction_factor", f"WITH s AS ({SIZES}) SELECT source, round(CASE WHEN coalesce(product_bytes, 0) > 0 THEN raw_bytes / product_bytes ELSE 0.0 END, 9) AS factor FROM s")
def _(spark, sf_dir):
    return _sizes(spark, sf_dir).select("source", r6(telemetry.reduction(F.col("raw_bytes"), F.lit(0).cast("long"), F.col("product_bytes")), 9).alias("factor"))


@query("format_seconds", "WITH e AS (SELECT event_id, event_id * 3.25 AS s FROM events) SELECT event_id, CASE WHEN s < 60 THEN printf('%.1fs', s::DOUBLE) WHEN s < 3600 THEN printf('%dm %02ds', floor(s / 60)::BIGINT, floor(s)::BIGINT % 60) ELSE printf('%dh %02dm', floor(s / 3600)::BIGINT, (floor(s)::BIGINT % 3600) // 60) END AS text FROM e")
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", fr.format_seconds(F.col("event_id") * F.lit(3.25)).alias("text"))


# ------------------------------------------------------------------------------------------------------------------ service


@query("config_resolve", "SELECT n_nationkey AS id, coalesce(CASE WHEN n_nationkey % 5 = 0 THEN 'orb' END, CASE WHEN n_nationkey % 3 = 0 THEN 'sift' END, CASE WHEN n_nationkey % 2 = 0 THEN 'akaze' END, 'default') AS matcher FROM nation")
def _(spark, sf_dir):
    n = F.col("n_nationkey")
    override, preset, profile = (F.when(n % k == 0, v) for k, v in ((5, "orb"), (3, "sift"), (2, "akaze")))
    return table(spark, sf_dir, "nation").select(n.alias("id"), F.coalesce(override, preset, profile, F.lit("default")).alias("matcher"))


@query("project_state", "SELECT c_custkey AS project, coalesce(o.status, 'created') AS status, coalesce(o.n, 0) AS runs FROM customer LEFT JOIN (SELECT o_custkey, max_by(o_orderstatus, (o_orderdate, o_orderkey)) AS status, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def _(spark, sf_dir):
    state = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"), F.count(F.lit(1)).alias("n"))
    return table(spark, sf_dir, "customer").join(state, "c_custkey", "left").select(F.col("c_custkey").alias("project"), F.coalesce("status", F.lit("created")).alias("status"), F.coalesce("n", F.lit(0)).alias("runs"))


@query("projects_recent", "SELECT o_orderkey AS project, o_orderdate AS created_at FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("project"), F.col("o_orderdate").alias("created_at")).orderBy(F.desc("created_at"), "project").limit(20)


@query("contract_poses", """SELECT o_orderkey AS frame_id, '{"frame_id":"' || o_orderkey || '","x":' || (o_orderkey % 997)::VARCHAR || ',"y":' || (o_custkey % 499)::VARCHAR || ',"dropped":' || CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END || '}' AS pose FROM orders""")
def _(spark, sf_dir):
    k = F.col("o_orderkey")
    pose = F.struct(k.cast("string").alias("frame_id"), (k % 997).alias("x"), (F.col("o_custkey") % 499).alias("y"), (k % 2 == 0).alias("dropped"))
    return table(spark, sf_dir, "orders").select(k.alias("frame_id"), F.to_json(pose).alias("pose"))


@query("pair_records", "SELECT o_orderkey AS pair_id, round_even(o_totalprice / 3000000, 4) AS inlier_ratio, round_even(o_totalprice / 77777, 3) AS reprojection_error FROM orders")
def _(spark, sf_dir):
    price = F.col("o_totalprice")
    t = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("source_id"), F.col("o_custkey").alias("target_id"), F.lit("affine").alias("model_type"), F.lit(None).cast("array<double>").alias("matrix"), F.lit(0).alias("num_matches"), F.lit(0).alias("num_inliers"),
        (price / 3000000).alias("inlier_ratio"), (price / 77777).alias("reprojection_error"), F.lit("success").alias("status"),
    )
    return matching.pair_records(t).select(F.col("source_id").alias("pair_id"), "inlier_ratio", "reprojection_error")

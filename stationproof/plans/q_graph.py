"""Catalogue: wind, graph, adjudication and neighbour reconstruction."""

from __future__ import annotations

from pyspark.sql import functions as F

from stationproof.functions import scan
from stationproof.functions.columns import CELL
from stationproof.functions.state import cut
from stationproof.operators import adjudicate as adj
from stationproof.operators import audit, cv, exposure, graph, neighbours
from stationproof.plans import oracle as O
from stationproof.plans import views
from stationproof.plans.catalog import query
from stationproof.plans.q_trust import bearing, hav
from stationproof.plans.shared import store

STEP = 21600  # the test network reports every six hours
BLOCKS = 4

DIFF = "least(abs({a} - {b}) % 360, 360 - abs({a} - {b}) % 360)"
TRAVEL = "((from_deg + 180) % 360)"
WEIGHT = f"CASE WHEN speed < 0.1 OR distance_km > 15 THEN 0 ELSE exp(-{DIFF.format(a='bearing_deg', b=TRAVEL)} / 25) * (speed / (speed + 2)) * exp(-distance_km / 5) END"


def r6(*cols):
    return {c: F.round(c, 6) for c in cols}


O.cte(
    wind="""SELECT station_id, timestamp_utc, d % 360 AS from_deg, sp AS speed FROM (SELECT station_id, timestamp_utc, avg(value) FILTER (parameter = 'Wind_Direction') AS d,
  avg(value) FILTER (parameter = 'Wind_Speed') AS sp FROM rd GROUP BY ALL) WHERE d IS NOT NULL AND sp IS NOT NULL""",
    city="""SELECT timestamp_utc, (degrees(atan2(avg(sin(radians(from_deg))), avg(cos(radians(from_deg))))) + 360) % 360 AS city_deg, avg(speed) AS city_speed, count(*) AS station_count
  FROM wind GROUP BY ALL""",
    windall="""SELECT st.station_id, c.timestamp_utc, coalesce(from_deg, city_deg) AS from_deg, coalesce(speed, city_speed) AS speed,
  CASE WHEN from_deg IS NOT NULL THEN 'station-local' ELSE 'city-fallback' END AS wind_origin FROM st CROSS JOIN city c LEFT JOIN wind w ON w.station_id = st.station_id AND w.timestamp_utc = c.timestamp_utc""",
    pair=f"""SELECT * FROM (SELECT a.station_id AS src, b.station_id AS dst, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS distance_km, {bearing('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS bearing_deg
  FROM st a, st b WHERE a.station_id <> b.station_id) WHERE distance_km <= 15""",
    wedge=f"""SELECT timestamp_utc, src, dst, {WEIGHT} AS weight, distance_km, bearing_deg, wind_origin FROM pair JOIN windall w ON w.station_id = src""",
    coredge=f"""SELECT corridor_id AS src, station_id AS dst, round(n_stops / (d + 0.05), 6) AS weight, round(d, 6) AS distance_km FROM
  (SELECT corridor_id, station_id, n_stops, {hav('st.lat', 'st.lon', 'corridor.lat', 'corridor.lon')} AS d FROM st, corridor) WHERE d <= 15""",
    spedge="SELECT src, dst, round(1 / (distance_km + 0.05), 6) AS weight, round(distance_km, 6) AS distance_km FROM pair",
    rdedge="SELECT point_id AS src, station_id AS dst, 1.0 AS weight FROM nearst",
    lastv="SELECT station_id, parameter, timestamp_utc, s, last(value ORDER BY ingest_seq) AS value, last(unit ORDER BY ingest_seq) AS unit FROM rd GROUP BY ALL",
    evt="""SELECT row_number() OVER (ORDER BY reason_code, station_id, parameter, timestamp_utc) AS event_id, station_id, parameter, timestamp_utc, reason_code, severity, fallback_value
  FROM (SELECT station_id, parameter, timestamp_utc, reason_code, severity, max(CASE WHEN reason_code = 'R07' THEN rank_value END) AS fallback_value FROM defect WHERE reason_code IN ('R07','R09','R02') GROUP BY ALL)""",
)


def pieces(spark, sf):
    s = store(spark, sf)
    st = views.stations(s.readings)
    local = graph.station_wind(s.readings)
    return s, st, graph.pairs(st), local, graph.city_wind(local)


@query("g1_station_wind", "SELECT station_id, timestamp_utc, round(from_deg, 6) AS from_deg, round(speed, 6) AS speed FROM wind")
def g1(spark, sf):
    return graph.station_wind(views.readings(spark, sf)).withColumns(r6("from_deg", "speed"))


@query("g2_city_wind", "SELECT timestamp_utc, round(city_deg, 9) AS city_deg, round(city_speed, 9) AS city_speed, station_count FROM city")
def g2(spark, sf):
    return graph.city_wind(graph.station_wind(views.readings(spark, sf))).withColumns({c: F.round(c, 9) for c in ("city_deg", "city_speed")})


@query(
    "g3_wind_lookup",
    """SELECT c.station_id, c.timestamp_utc, round(coalesce(from_deg, city_deg), 9) AS from_deg, round(coalesce(speed, city_speed), 9) AS speed,
  CASE WHEN from_deg IS NOT NULL THEN 'station-local' WHEN city_deg IS NOT NULL THEN 'city-fallback' ELSE 'unavailable' END AS wind_origin
  FROM (SELECT DISTINCT station_id, timestamp_utc FROM rd) c LEFT JOIN wind USING (station_id, timestamp_utc) LEFT JOIN city USING (timestamp_utc)""",
)
def g3(spark, sf):
    s, st, p, local, city = pieces(spark, sf)
    asked = s.readings.select("station_id", "timestamp_utc").distinct()
    return graph.wind_lookup(asked, local, city).withColumns({c: F.round(c, 9) for c in ("from_deg", "speed")})


@query("g5_spatial_edges", "SELECT * FROM spedge")
def g5(spark, sf):
    return graph.spatial_edges(graph.pairs(views.stations(views.readings(spark, sf))))


@query(
    "g4_g6_wind_edges",
    "SELECT timestamp_utc, src, dst, round(weight, 6) AS weight, round(distance_km, 6) AS distance_km, round(bearing_deg, 6) AS bearing_deg, wind_origin FROM wedge",
)
def g6(spark, sf):
    s, st, p, local, city = pieces(spark, sf)
    return graph.wind_edges(p, st, local, city).withColumns(r6("weight", "distance_km", "bearing_deg"))


O.cte(
    wpos=f"""SELECT src, dst, w.timestamp_utc, i, from_deg, speed, wind_origin, {WEIGHT} AS weight FROM pair JOIN windall w ON w.station_id = src
  JOIN (SELECT timestamp_utc, row_number() OVER (ORDER BY timestamp_utc) AS i FROM city) h ON h.timestamp_utc = w.timestamp_utc""",
    wrun="""SELECT *, sum(CASE WHEN i = pi + 1 AND from_deg = pd AND speed = ps AND wind_origin = po THEN 0 ELSE 1 END) OVER (PARTITION BY src, dst ORDER BY i) AS run FROM (
  SELECT *, lag(i) OVER w AS pi, lag(from_deg) OVER w AS pd, lag(speed) OVER w AS ps, lag(wind_origin) OVER w AS po FROM wpos WHERE weight > 0 WINDOW w AS (PARTITION BY src, dst ORDER BY i))""",
)


@query(
    "g6_wind_edge_ranges",
    "SELECT src, dst, min(timestamp_utc) AS start_utc, max(timestamp_utc) AS end_utc, count(*) AS n_instants, round(any_value(weight), 6) AS weight, any_value(wind_origin) AS wind_origin FROM wrun GROUP BY src, dst, run",
)
def g6_ranges(spark, sf):
    """Edges of positive weight by ranges of instants with one wind."""
    s, st, p, local, city = pieces(spark, sf)
    e = graph.wind_edge_ranges(p, st, local, city).withColumn("n_instants", F.col("hi") - F.col("lo") + 1)
    return e.select("src", "dst", "start_utc", "end_utc", "n_instants", F.round("weight", 6).alias("weight"), "wind_origin")


@query("g6_positive_edges", "SELECT timestamp_utc, src, dst, round(weight, 6) AS weight, wind_origin FROM wpos WHERE weight > 0")
def g6_positive(spark, sf):
    """The same edges per instant, expanded from their ranges."""
    s, st, p, local, city = pieces(spark, sf)
    ranges = graph.wind_edge_ranges(p, st, local, city)
    hours = graph.wind_runs(st, local, city)[1]
    return graph.expand_edges(ranges, hours).select("timestamp_utc", "src", "dst", F.round("weight", 6).alias("weight"), "wind_origin")


def corridors(spark, sf):
    return exposure.corridors(exposure.stop_points(views.stops(spark, sf)))


@query("g7_corridor_edges", "SELECT * FROM coredge")
def g7(spark, sf):
    return graph.corridor_edges(views.stations(views.readings(spark, sf)), corridors(spark, sf))


@query("g8_weather_edges", "SELECT 'WEATHER-00' AS src, station_id AS dst, 1.0::DOUBLE AS weight, 0.0::DOUBLE AS distance_km FROM st")
def g8(spark, sf):
    return graph.weather_edges(views.stations(views.readings(spark, sf)))


@query(
    "g9_graph_summary",
    """SELECT edge_type, count(*) AS n_edges, count(DISTINCT src) AS n_sources, count(DISTINCT dst) AS n_targets, 0::BIGINT AS n_not_finite FROM (
  SELECT 'spatial' AS edge_type, src, dst FROM spedge UNION ALL SELECT 'wind', src, dst FROM wedge UNION ALL SELECT 'corridor', src, dst FROM coredge
  UNION ALL SELECT 'road', src, dst FROM rdedge UNION ALL SELECT 'weather', 'WEATHER-00', station_id FROM st) GROUP BY ALL""",
)
def g9(spark, sf):
    s, st, p, local, city = pieces(spark, sf)
    pts = exposure.stop_points(views.stops(spark, sf)).select(
        F.col("stop_id").alias("point_id"), F.col("stop_lat").alias("p_lat"), F.col("stop_lon").alias("p_lon")
    )
    edges = graph.edge_table(
        spatial=graph.spatial_edges(p),
        wind=graph.wind_edges(p, st, local, city),
        corridor=graph.corridor_edges(st, corridors(spark, sf)),
        road=graph.road_edges(exposure.nearest(st, pts)),
        weather=graph.weather_edges(st),
    )
    bad = graph.not_finite(edges).groupBy("edge_type").agg(F.count(F.lit(1)).alias("n_not_finite"))
    return graph.summary(edges).join(bad, "edge_type", "left").fillna({"n_not_finite": 0})


# --- adjudication: every impossible reading, inversion and outage is a candidate ----------------
def events(spark, sf):
    s = store(spark, sf)
    fall = F.max(F.when(F.col("reason_code") == "R07", F.col("rank_value")))
    picked = (
        s.defects.where(F.col("reason_code").isin("R07", "R09", "R02"))
        .groupBy(*CELL, "reason_code", "severity")
        .agg(fall.alias("fallback_value"))
    )
    return scan.global_rank(picked, [F.col(c) for c in ("reason_code", *CELL)], "event_id").withColumn("audit_rank", F.col("event_id"))


def judged(spark, sf, learned=None):
    s, st, p, local, city = pieces(spark, sf)
    values = cut(adj.last_values(s.readings))
    c = adj.candidates(events(spark, sf), values)
    return c, *adj.adjudicate(c, values, p, st, local, city, STEP, learned)


O.cte(
    cand0="""SELECT e.*, coalesce(v.value, fallback_value) AS value FROM evt e LEFT JOIN lastv v USING (station_id, parameter, timestamp_utc)
  WHERE coalesce(v.value, fallback_value) IS NOT NULL AND (e.station_id, e.parameter) IN (SELECT (station_id, parameter) FROM series)""",
    cbase="""SELECT c.event_id, median(v.value) FILTER (v.timestamp_utc >= c.timestamp_utc - INTERVAL 48 HOUR AND v.timestamp_utc < c.timestamp_utc) AS b1,
  median(v.value) FILTER (v.timestamp_utc < c.timestamp_utc) AS b2, median(v.value) AS b3 FROM cand0 c JOIN lastv v USING (station_id, parameter) GROUP BY ALL""",
    cand="SELECT c.*, coalesce(b1, b2, b3, 0) AS baseline, value - coalesce(b1, b2, b3, 0) AS excess FROM cand0 c LEFT JOIN cbase USING (event_id)",
    cwind="""SELECT c.*, coalesce(w.from_deg, y.city_deg) AS from_deg, coalesce(w.speed, y.city_speed) AS speed FROM cand c LEFT JOIN wind w USING (station_id, timestamp_utc) LEFT JOIN city y USING (timestamp_utc)""",
    arr0=f"""SELECT event_id, dst, parameter, timestamp_utc, excess, distance_km, bearing_deg, {WEIGHT} AS edge_weight,
  speed * cos(radians({DIFF.format(a='bearing_deg', b=TRAVEL)})) AS along FROM cwind JOIN pair ON src = station_id WHERE speed >= 0.1""",
    arr="""SELECT *, distance_km * 1000 / greatest(along, 0.3) / 60 AS delay, excess * greatest(exp(-distance_km / 5), 0.02) AS expected_excess FROM arr0 WHERE edge_weight >= 0.05""",
    nbase="""SELECT a.event_id, a.dst, median(v.value) FILTER (v.timestamp_utc >= a.timestamp_utc - INTERVAL 48 HOUR) AS b1, median(v.value) AS b2
  FROM arr a JOIN lastv v ON v.station_id = a.dst AND v.parameter = a.parameter AND v.timestamp_utc < a.timestamp_utc GROUP BY ALL""",
    evid0="""SELECT a.*, a.delay <= 60 AS within_horizon, (a.dst, a.parameter) IN (SELECT (station_id, parameter) FROM series) AS carries_parameter, v.value - coalesce(b1, b2) AS actual_excess
  FROM arr a LEFT JOIN nbase n USING (event_id, dst) LEFT JOIN lastv v ON v.station_id = a.dst AND v.parameter = a.parameter AND v.timestamp_utc = a.timestamp_utc + INTERVAL 6 HOUR""",
    evid="SELECT *, coalesce(within_horizon AND expected_excess > 0 AND actual_excess >= 0.5 * expected_excess, false) AS corroborated FROM evid0",
    tally="""SELECT event_id, count(*) AS n_downwind, count(*) FILTER (carries_parameter AND actual_excess IS NOT NULL) AS n_usable,
  coalesce(sum(edge_weight) FILTER (carries_parameter AND actual_excess IS NOT NULL AND corroborated), 0) / sum(edge_weight) FILTER (carries_parameter AND actual_excess IS NOT NULL) AS m FROM evid GROUP BY ALL""",
    verd0="""SELECT c.*, coalesce(n_downwind, 0) AS n_downwind, coalesce(n_usable, 0) AS n_usable, coalesce(m, 0) AS match_score,
  CASE WHEN coalesce(n_usable, 0) < 2 THEN 'AMBIGUOUS' WHEN round(m, 12) >= 0.6 THEN 'GENUINE_EVENT' WHEN round(m, 12) <= 0.2 THEN 'LIKELY_FAULT' ELSE 'AMBIGUOUS' END AS verdict FROM cand c LEFT JOIN tally USING (event_id)""",
    verd="""SELECT *, round(CASE verdict WHEN 'GENUINE_EVENT' THEN match_score WHEN 'LIKELY_FAULT' THEN 1 - match_score ELSE 0.5 END, 4) AS confidence,
  CASE verdict WHEN 'GENUINE_EVENT' THEN 'R22' WHEN 'LIKELY_FAULT' THEN 'R17' ELSE 'R23' END AS vcode FROM verd0""",
)


@query("g10_candidates", "SELECT event_id, station_id, parameter, timestamp_utc, round(value, 6) AS value, round(baseline, 6) AS baseline, round(excess, 6) AS excess FROM cand")
def g10(spark, sf):
    s = store(spark, sf)
    c = adj.candidates(events(spark, sf), adj.last_values(s.readings))
    return c.select("event_id", *CELL, "value", "baseline", "excess").withColumns(r6("value", "baseline", "excess"))


@query("g11_rank_candidates", "SELECT * FROM (SELECT event_id, row_number() OVER (ORDER BY round(excess, 9) DESC, event_id, station_id) AS rank FROM cand) WHERE rank <= 50")
def g11(spark, sf):
    s = store(spark, sf)
    c = adj.candidates(events(spark, sf), adj.last_values(s.readings))
    return adj.rank(c, 50).select("event_id", "rank")


@query("g12_expected_arrival", "SELECT event_id, dst, round(edge_weight, 6) AS edge_weight, round(along, 6) AS along_wind_speed, round(delay, 6) AS arrival_delay_min, round(expected_excess, 6) AS expected_excess, delay <= 60 AS within_horizon FROM arr")
def g12(spark, sf):
    s, st, p, local, city = pieces(spark, sf)
    c = adj.candidates(events(spark, sf), adj.last_values(s.readings))
    windy = graph.wind_lookup(c, local, city).where("speed >= 0.1")
    return adj.arrival(windy, p).select(
        "event_id", "dst", "edge_weight", "along_wind_speed", "arrival_delay_min", "expected_excess", "within_horizon"
    ).withColumns(r6("edge_weight", "along_wind_speed", "arrival_delay_min", "expected_excess"))


@query("g13_neighbour_evidence", "SELECT event_id, dst, round(edge_weight, 6) AS edge_weight, carries_parameter, round(actual_excess, 6) AS actual_excess, corroborated FROM evid")
def g13(spark, sf):
    _, _, ev = judged(spark, sf)
    return ev.select("event_id", "dst", "edge_weight", "carries_parameter", "actual_excess", "corroborated").withColumns(
        r6("edge_weight", "actual_excess")
    )


@query("g14_verdicts", "SELECT event_id, verdict, round(match_score, 6) AS match_score, n_downwind, n_usable, vcode AS reason_code FROM verd")
def g14(spark, sf):
    _, v, _ = judged(spark, sf)
    return v.select("event_id", "verdict", F.round("match_score", 6).alias("match_score"), "n_downwind", "n_usable", F.col("reason_code"))


@query(
    "g15_confidence_bands",
    """SELECT event_id, confidence, CASE WHEN confidence >= 0.75 THEN 'high' WHEN confidence >= 0.5 THEN 'moderate' ELSE 'low' END AS confidence_band, verdict = 'AMBIGUOUS' AS routes_to_review FROM verd""",
)
def g15(spark, sf):
    _, v, _ = judged(spark, sf)
    return v.select("event_id", "confidence", "confidence_band", "routes_to_review")


@query(
    "g16_overlay",
    """SELECT event_id, step, at, round(expected, 6) AS expected, round(actual, 6) AS actual FROM (
  SELECT event_id, 0 AS step, timestamp_utc AS "at", 0.0 AS expected, 0.0 AS actual FROM cand UNION ALL
  SELECT c.event_id, 1, c.timestamp_utc + INTERVAL 6 HOUR, coalesce(e, 0), a FROM cand c LEFT JOIN (SELECT event_id, sum(edge_weight * expected_excess) / sum(edge_weight) AS e,
  sum(edge_weight * actual_excess) / sum(edge_weight) AS a FROM evid WHERE carries_parameter AND actual_excess IS NOT NULL GROUP BY ALL) USING (event_id))""".replace("step, at, round", 'step, "at", round'),
)
def g16(spark, sf):
    c, _, ev = judged(spark, sf)
    return adj.overlay(c, ev, STEP).withColumns(r6("expected", "actual"))


@query("g17_evidence_bundles", "SELECT event_id, dst, row_number() OVER (PARTITION BY event_id ORDER BY round(edge_weight, 9) DESC, dst) AS position, round(expected_excess, 6) AS expected_excess, corroborated FROM evid")
def g17(spark, sf):
    _, _, ev = judged(spark, sf)
    return adj.bundle_rows(ev).select("event_id", "dst", "position", F.round("expected_excess", 6).alias("expected_excess"), "corroborated")


@query("g18_write_back", "SELECT e.event_id, e.station_id, e.parameter, e.timestamp_utc, e.severity, verdict, confidence FROM evt e LEFT JOIN verd USING (event_id)")
def g18(spark, sf):
    _, v, _ = judged(spark, sf)
    return adj.write_back(events(spark, sf), v).select("event_id", *CELL, "severity", "verdict", "confidence")


@query("g19_replay")
def g19(spark, sf):
    """The audit's notable events, ranked and adjudicated."""
    s, st, p, local, city = pieces(spark, sf)
    notable = audit.notable_events(s.defects).select(
        F.col("rank").alias("event_id"),
        *CELL,
        F.when(F.col("reason_code") == "R07", F.col("rank_value")).alias("fallback_value"),
        F.col("rank").alias("audit_rank"),
    )
    values = cut(adj.last_values(s.readings))
    c = adj.rank(adj.candidates(notable, values))
    v, _ = adj.adjudicate(c, values, p, st, local, city, STEP)
    return v.select("rank", *CELL, "excess", "verdict", "confidence", "match_score")


# --- neighbour reconstruction -------------------------------------------------------------------
O.cte(
    yv="SELECT station_id, timestamp_utc, avg(value) AS y FROM rd WHERE parameter = 'PM10' AND value IS NOT NULL GROUP BY ALL",
    ystat="SELECT avg(y) AS mu, stddev_pop(y) AS sd FROM yv",
    att="""SELECT w.timestamp_utc, src, dst, weight, y.y AS y_src, exp(weight) / sum(exp(weight)) OVER (PARTITION BY dst, w.timestamp_utc) AS alpha FROM wedge w JOIN yv y ON y.station_id = src AND y.timestamp_utc = w.timestamp_utc""",
    rec="""SELECT a.dst AS station_id, a.timestamp_utc, any_value(v.y) AS y, sum(alpha * (y_src - mu) / sd) * any_value(sd) + any_value(mu) AS y_hat, avg(y_src) AS y_mean, count(*) AS n_neighbours
  FROM att a CROSS JOIN ystat LEFT JOIN yv v ON v.station_id = a.dst AND v.timestamp_utc = a.timestamp_utc GROUP BY a.dst, a.timestamp_utc""",
    blk="SELECT timestamp_utc, ntile(4) OVER (ORDER BY timestamp_utc) AS block FROM (SELECT DISTINCT timestamp_utc FROM rd)",
    recs="""SELECT r.*, block, sigma FROM rec r JOIN blk USING (timestamp_utc) LEFT JOIN (SELECT station_id, stddev_pop(y - y_hat) AS sigma FROM rec JOIN blk USING (timestamp_utc) WHERE block < 4 AND y IS NOT NULL GROUP BY ALL) USING (station_id)""",
)


def rebuilt(spark, sf):
    s, st, p, local, city = pieces(spark, sf)
    values = neighbours.target_values(s.readings, "PM10")
    return s, values, graph.wind_edges(p, st, local, city)


def scored(spark, sf):
    s, values, edges = rebuilt(spark, sf)
    pred = neighbours.reconstruct(edges, values)
    return neighbours.with_sigma(pred, cv.time_blocks(s.readings, BLOCKS), BLOCKS)


Q20 = 1.5


@query("g20_expectation_seam", f"""SELECT a.event_id, a.dst, CASE WHEN x IS NULL THEN 'analytic' ELSE 'learned' END AS expectation_origin, round(coalesce(x, expected_excess), 6) AS expected_excess,
  round(x - {Q20} * sigma, 6) AS expected_low, round(x + {Q20} * sigma, 6) AS expected_high FROM arr a LEFT JOIN (
    SELECT a.event_id, a.dst, r.y_hat - coalesce(n.b1, n.b2) AS x, r.sigma FROM arr a JOIN nbase n USING (event_id, dst)
    JOIN recs r ON r.station_id = a.dst AND r.timestamp_utc = a.timestamp_utc + INTERVAL {STEP} SECOND WHERE a.parameter = 'PM10') l USING (event_id, dst)""")
def g20(spark, sf):
    s, st, p, local, city = pieces(spark, sf)
    values = cut(adj.last_values(s.readings))
    c = adj.candidates(events(spark, sf), values)
    windy = graph.wind_lookup(c, local, city).where("speed >= 0.1")
    expected = adj.arrival(windy, p)
    learned = adj.learned_expectation(c.where("parameter = 'PM10'"), scored(spark, sf), values, STEP)
    out = adj.with_learned(expected, learned, Q20)
    return out.select("event_id", "dst", "expectation_origin", *[F.round(x, 6).alias(x) for x in ("expected_excess", "expected_low", "expected_high")])


@query("g21_neighbour_reconstruction", "SELECT station_id, timestamp_utc, round(y, 6) AS y, round(y_hat, 6) AS y_hat, round(sigma, 6) AS sigma, block FROM recs")
def g21(spark, sf):
    return scored(spark, sf).select("station_id", "timestamp_utc", "y", "y_hat", "sigma", "block").withColumns(r6("y", "y_hat", "sigma"))


@query("g22_neighbour_mean", "SELECT station_id, timestamp_utc, round(y_mean * n_neighbours, 7) AS y_sum, n_neighbours FROM rec")
def g22(spark, sf):
    _, values, edges = rebuilt(spark, sf)
    return neighbours.reconstruct(edges, values).select("station_id", "timestamp_utc", F.round(F.col("y_mean") * F.col("n_neighbours"), 7).alias("y_sum"), "n_neighbours")


@query(
    "g23_held_out_metrics",
    """SELECT count(*) AS n, round(avg(0.5 * (ln(2 * pi() * greatest(sigma, 1e-6) ** 2) + (y - y_hat) ** 2 / greatest(sigma, 1e-6) ** 2)), 5) AS nll, round(sqrt(avg((y - y_hat) ** 2)), 5) AS rmse,
  round(sqrt(avg((y - y_mean) ** 2)), 5) AS rmse_mean FROM recs WHERE block = 4 AND y IS NOT NULL AND sigma IS NOT NULL""",
)
def g23(spark, sf):
    m = neighbours.held_out_metrics(scored(spark, sf), BLOCKS)
    return m.withColumns({c: F.round(c, 5) for c in ("nll", "rmse", "rmse_mean")})


@query("g24_influence", "SELECT * FROM (SELECT timestamp_utc, src, dst, round(weight, 6) AS weight, round(alpha, 6) AS alpha, row_number() OVER (PARTITION BY dst, timestamp_utc ORDER BY round(alpha, 9) DESC, src) AS position FROM att)")
def g24(spark, sf):
    _, values, edges = rebuilt(spark, sf)
    return neighbours.influence(neighbours.attention(edges, values)).select(
        "timestamp_utc", "src", "dst", "weight", "alpha", "position"
    ).withColumns(r6("weight", "alpha"))

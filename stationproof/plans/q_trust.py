"""Catalogue: counters, exposure and trust."""

from __future__ import annotations

from pyspark.sql import functions as F

from stationproof import registry
from stationproof.functions import geo
from stationproof.functions.columns import SERIES, secs
from stationproof.operators import counters, exposure, trust
from stationproof.plans import oracle as O
from stationproof.plans import views
from stationproof.plans.catalog import query
from stationproof.plans.shared import store

DAY = 86400

O.cte(
    ctr0="""SELECT l_suppkey % 10 AS c, epoch_us(l_shipdate) // 86400000000 AS d, l_orderkey, l_linenumber AS ln, sum(l_quantity) AS q FROM lineitem GROUP BY ALL""",
    ctr="""SELECT 'TC-' || c AS counter_id, 'qty' AS parameter, make_timestamp(d * 86400000000) AS timestamp_utc, d * 86400 AS s,
  (CASE WHEN c = 9 THEN 100 ELSE (d * 29 + ln * 3) % 5000 + floor(q / 10) - CASE WHEN ln = 3 THEN 60 ELSE 0 END END)::DOUBLE AS cumulative,
  (d + CASE WHEN ln = 7 THEN 3 ELSE 0 END) * 274877906944 + l_orderkey * 16 + ln AS ingest_seq FROM ctr0""",
    ctrlate="""SELECT * FROM (SELECT *, max(s) OVER (PARTITION BY counter_id ORDER BY ingest_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM ctr) WHERE s < m""",
    ctrtot="""SELECT counter_id, parameter, timestamp_utc, s, arg_max(cumulative, ingest_seq) AS cumulative, count(*) AS n_rows FROM ctr GROUP BY ALL""",
    ctrlag="""SELECT *, lag(cumulative) OVER (PARTITION BY counter_id ORDER BY s) AS previous FROM ctrtot""",
    ctrinc="""SELECT *, CASE WHEN cumulative >= previous THEN NULL WHEN cumulative <= 0.5 * previous THEN 'R05' WHEN cumulative < previous THEN 'R06' END AS reason_code,
  CASE WHEN previous IS NULL THEN 0 WHEN cumulative >= previous THEN cumulative - previous WHEN cumulative <= 0.5 * previous THEN cumulative ELSE 0 END AS increment FROM ctrlag""",
    ctrdead="""SELECT counter_id, parameter, count(*) AS n_points, min(cumulative) AS constant_value, min(timestamp_utc) AS since, max(timestamp_utc) AS timestamp_utc
  FROM ctrtot GROUP BY ALL HAVING count(*) >= 672 AND min(cumulative) = max(cumulative)""",
)


def totals(spark, sf):
    return counters.last_delivered(views.counters(spark, sf))


@query(
    "c1_difference_cumulate",
    """SELECT counter_id, parameter, timestamp_utc, cumulative, cumulative - coalesce(previous, 0) AS delta,
  sum(cumulative - coalesce(previous, 0)) OVER (PARTITION BY counter_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS recumulated FROM ctrlag""",
)
def c1(spark, sf):
    out = counters.cumulate(counters.difference(totals(spark, sf)))
    return out.select(*counters.TICK, "cumulative", "delta", "recumulated")


@query(
    "c2_order_and_dedupe",
    """SELECT counter_id, parameter, timestamp_utc, cumulative, n_rows, coalesce(l.n, 0) AS n_late FROM ctrtot
  LEFT JOIN (SELECT counter_id, timestamp_utc, count(*) AS n FROM ctrlate GROUP BY ALL) l USING (counter_id, timestamp_utc)""",
)
def c2(spark, sf):
    c = views.counters(spark, sf)
    late = counters.late_rows(c).groupBy(*counters.TICK).agg(F.count(F.lit(1)).alias("n_late"))
    return counters.last_delivered(c).join(late, counters.TICK, "left").fillna({"n_late": 0})


@query("c3_increments", "SELECT counter_id, parameter, timestamp_utc, cumulative, reason_code, increment::DOUBLE AS increment FROM ctrinc")
def c3(spark, sf):
    return counters.increments(totals(spark, sf)).select(
        *counters.TICK, "cumulative", "reason_code", "increment"
    )


@query("c4_dead_counter", "SELECT * FROM ctrdead")
def c4(spark, sf):
    return counters.dead_counters(totals(spark, sf))


@query(
    "c5_completeness",
    "SELECT counter_id, parameter, count(*) AS n_observed, round(count(*) / ((max(s) - min(s)) // 86400 + 1), 6) AS completeness FROM ctrtot GROUP BY ALL",
)
def c5(spark, sf):
    return counters.completeness(totals(spark, sf), DAY)


@query(
    "c6_repair_summary",
    """SELECT counter_id, parameter, count(*) AS n_observed, count(*) FILTER (reason_code = 'R05') AS n_resets, count(*) FILTER (reason_code = 'R06') AS n_nonmonotonic,
  sum(n_rows - 1)::BIGINT AS n_duplicates, count(*) >= 672 AND min(cumulative) = max(cumulative) AS is_dead,
  round(count(*) / ((max(s) - min(s)) // 86400 + 1), 6) AS completeness, round(sum(increment)::DOUBLE, 6) AS throughput FROM ctrinc GROUP BY ALL""",
)
def c6(spark, sf):
    return counters.repair_summary(views.counters(spark, sf), DAY)


@query(
    "c6_repair_events",
    """SELECT reason_code, counter_id, count(*) AS n FROM (SELECT 'R04' AS reason_code, counter_id FROM ctrlate UNION ALL SELECT 'R03', counter_id FROM ctrtot WHERE n_rows > 1
  UNION ALL SELECT reason_code, counter_id FROM ctrinc WHERE reason_code IS NOT NULL UNION ALL SELECT 'R21', counter_id FROM ctrdead) GROUP BY ALL""",
)
def c6e(spark, sf):
    ev = counters.repair_events(views.counters(spark, sf))
    return ev.groupBy("reason_code", "counter_id").agg(F.count(F.lit(1)).alias("n"))


O.cte(
    dayflow="""SELECT timestamp_utc, sum(increment) AS flow FROM ctrinc GROUP BY ALL""",
    dayfull="""SELECT r.t AS timestamp_utc, coalesce(flow, 0) AS flow FROM (SELECT unnest(generate_series((SELECT min(timestamp_utc) FROM dayflow), (SELECT max(timestamp_utc) FROM dayflow), INTERVAL 1 DAY)) AS t) r
  LEFT JOIN dayflow d ON d.timestamp_utc = r.t""",
)


@query(
    "c7_traffic_flow",
    """SELECT o.t AS timestamp_utc, round(coalesce(flow, (SELECT median(flow) FROM dayfull))::DOUBLE, 6) AS traffic_flow
  FROM (SELECT DISTINCT o_orderdate AS t FROM orders) o LEFT JOIN dayfull d ON d.timestamp_utc = o.t""",
)
def c7(spark, sf):
    steps = counters.increments(totals(spark, sf))
    days = views.table(spark, sf, "orders").select(F.col("o_orderdate").alias("timestamp_utc"))
    out = counters.flow(steps, days, DAY)
    return out.withColumn("traffic_flow", F.round("traffic_flow", 6))


# --- exposure ----------------------------------------------------------------------------------
HAV = "2 * {r} * asin(least(1, sqrt(power(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * power(sin(radians({d} - {c}) / 2), 2))))"


def hav(lat1, lon1, lat2, lon2, r="6371.0088"):
    return HAV.format(a=lat1, b=lat2, c=lon1, d=lon2, r=r)


def bearing(lat1, lon1, lat2, lon2):
    a, b, dl = f"radians({lat1})", f"radians({lat2})", f"radians({lon2} - ({lon1}))"
    return f"((degrees(atan2(sin({dl}) * cos({b}), cos({a}) * sin({b}) - sin({a}) * cos({b}) * cos({dl}))) + 360) % 360)"


O.cte(
    st="""SELECT station_id, 47.577175 - floor((CAST(substr(station_id, 5, 2) AS INT) - 1) / 5)::DOUBLE * 0.018::DOUBLE AS lat,
  21.502204 + ((CAST(substr(station_id, 5, 2) AS INT) - 1) % 5)::DOUBLE * 0.018::DOUBLE AS lon FROM (SELECT DISTINCT station_id FROM rd)""",
    stop="""SELECT CAST(c_custkey AS VARCHAR) AS stop_id, 47.53::DOUBLE + ((c_custkey * 37) % 1000)::DOUBLE / 1000 * 0.06::DOUBLE AS stop_lat,
  21.48::DOUBLE + ((c_custkey * 91) % 1000)::DOUBLE / 1000 * 0.12::DOUBLE AS stop_lon FROM customer WHERE c_custkey % 101 <> 0""",
    stoproute="""SELECT s.stop_id, stop_lat, stop_lon, coalesce(n, 1) AS n_routes FROM stop s LEFT JOIN
  (SELECT CAST(o_custkey AS VARCHAR) AS stop_id, count(DISTINCT o_orderkey % 12) AS n FROM orders GROUP BY 1) r USING (stop_id)""",
    service=f"""SELECT st.station_id, coalesce(sum(n_routes) FILTER ({hav('lat', 'lon', 'stop_lat', 'stop_lon', '6371.0')} <= 0.5), 0)::DOUBLE AS service FROM st, stoproute GROUP BY st.station_id""",
    layer="""SELECT station_id, service, service >= 1 AS measured, CASE WHEN service >= 1 THEN coalesce(round(0.6 + 1.0 * (service - lo) / nullif(hi - lo, 0), 6), 1.0) ELSE 1.0 END::DOUBLE AS exposure
  FROM service, (SELECT min(service) AS lo, max(service) AS hi FROM service WHERE service >= 1)""",
    nearst=f"""SELECT * FROM (SELECT station_id, stop_id AS point_id, round(d, 6) AS distance_km, row_number() OVER (PARTITION BY station_id ORDER BY round(d, 9), stop_id) AS rank
  FROM (SELECT station_id, stop_id, {hav('lat', 'lon', 'stop_lat', 'stop_lon')} AS d FROM st, stop)) WHERE rank <= 3""",
    corr0="""SELECT least(floor((stop_lat - a0) / (a1 - a0) * 4), 3)::INT AS a, least(floor((stop_lon - b0) / (b1 - b0) * 4), 3)::INT AS b, stop_lat, stop_lon
  FROM stop, (SELECT min(stop_lat) AS a0, max(stop_lat) AS a1, min(stop_lon) AS b0, max(stop_lon) AS b1 FROM stop)""",
    corridor="""SELECT 'BC-' || lpad(a::VARCHAR, 2, '0') || '-' || lpad(b::VARCHAR, 2, '0') AS corridor_id, round(avg(stop_lat), 6) AS lat, round(avg(stop_lon), 6) AS lon, count(*) AS n_stops FROM corr0 GROUP BY a, b""",
)


def routes(spark, sf):
    return exposure.stops_with_routes(
        views.stops(spark, sf), views.stop_times(spark, sf), views.trips(spark, sf)
    )


def layer(spark, sf):
    st = views.stations(views.readings(spark, sf))
    return exposure.exposure_for(st, views.stops(spark, sf), views.stop_times(spark, sf), views.trips(spark, sf))


@query("s7_stops_with_routes", "SELECT stop_id, round(stop_lat, 6) AS stop_lat, round(stop_lon, 6) AS stop_lon, n_routes FROM stoproute")
def s7(spark, sf):
    return routes(spark, sf).withColumns(
        {"stop_lat": F.round("stop_lat", 6), "stop_lon": F.round("stop_lon", 6)}
    )


@query("e1_haversine", f"SELECT stop_id, round({hav('47.53', '21.6', 'stop_lat', 'stop_lon')}, 6) AS km, round(1000 * {hav('47.53', '21.6', 'stop_lat', 'stop_lon', '6371.0')}, 3) AS metres FROM stop")
def e1(spark, sf):
    p = exposure.stop_points(views.stops(spark, sf))
    d = lambda r: geo.haversine_km(F.lit(47.53), F.lit(21.6), "stop_lat", "stop_lon", r)
    return p.select(
        "stop_id", F.round(d(6371.0088), 6).alias("km"), F.round(1000 * d(6371.0), 3).alias("metres")
    )


B = bearing("47.53", "21.54", "stop_lat", "stop_lon")


@query(
    "e2_bearings",
    f"""SELECT stop_id, round(b, 6) AS bearing_deg, round(least(abs(b - 350) % 360, 360 - abs(b - 350) % 360), 6) AS from_north_west, round((b + 180) % 360, 6) AS travel_deg
  FROM (SELECT stop_id, {B} AS b FROM stop)""",
)
def e2(spark, sf):
    p = exposure.stop_points(views.stops(spark, sf)).withColumn(
        "b", geo.bearing_deg(F.lit(47.53), F.lit(21.54), "stop_lat", "stop_lon")
    )
    return p.select(
        "stop_id",
        F.round("b", 6).alias("bearing_deg"),
        F.round(geo.angle_diff("b", F.lit(350.0)), 6).alias("from_north_west"),
        F.round(geo.travel_bearing("b"), 6).alias("travel_deg"),
    )


@query("e3_service_in_radius", "SELECT * FROM service")
def e3(spark, sf):
    return exposure.service_intensity(views.stations(views.readings(spark, sf)), routes(spark, sf))


@query("e4_exposure_layer", "SELECT * FROM layer")
def e4(spark, sf):
    return exposure.exposure_layer(
        exposure.service_intensity(views.stations(views.readings(spark, sf)), routes(spark, sf))
    )


@query("e5_exposure_for_drop", "SELECT station_id, exposure FROM layer")
def e5(spark, sf):
    return layer(spark, sf).select("station_id", "exposure")


@query("e6_nearest_points", "SELECT * FROM nearst")
def e6(spark, sf):
    pts = exposure.stop_points(views.stops(spark, sf)).select(
        F.col("stop_id").alias("point_id"), F.col("stop_lat").alias("p_lat"), F.col("stop_lon").alias("p_lon")
    )
    st = views.stations(views.readings(spark, sf))
    return exposure.nearest(st, pts).withColumn("distance_km", F.round("distance_km", 6))


@query("e7_corridors", "SELECT * FROM corridor")
def e7(spark, sf):
    return exposure.corridors(exposure.stop_points(views.stops(spark, sf)))


@query("e8_weather_node", "SELECT 'WEATHER-00' AS node_id, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM st")
def e8(spark, sf):
    return exposure.weather_node(views.stations(views.readings(spark, sf)))


# --- trust -------------------------------------------------------------------------------------
O.cte(
    ends="SELECT min(s) AS lo, max(s) AS hi FROM rd",
    inst="""SELECT k, hi - k * 86400 AS ats, make_timestamp((hi - k * 86400) * 1000000) AS timestamp_utc FROM ends, range(least(120, (hi - lo) // 86400 + 1)) t(k)""",
    stk="SELECT station_id, k, ats, timestamp_utc FROM (SELECT DISTINCT station_id FROM rd), inst",
    wgt="SELECT * FROM (VALUES ('critical', 1.0), ('high', 0.7), ('medium', 0.4), ('low', 0.2), ('info', 0.05)) t(severity, w)",
    dfs="SELECT d.*, epoch_us(timestamp_utc) // 1000000 AS s, w::DOUBLE AS w FROM defect d JOIN wgt USING (severity)",
    cvd="""SELECT station_id, k, sum(CASE WHEN least(s1, ats) >= greatest(s0, ats - 604800 + cadence_s)
    THEN (least(s1, ats) - greatest(s0, ats - 604800 + cadence_s)) // cadence_s + 1 ELSE 0 END)::BIGINT AS covered FROM series, inst GROUP BY ALL""",
    expd="SELECT station_id, k, count(*) AS expected FROM grid, inst WHERE s > ats - 604800 AND s <= ats GROUP BY ALL",
    absd="SELECT station_id, k, count(*) AS absent FROM absent, inst WHERE s > ats - 604800 AND s <= ats GROUP BY ALL",
    wcell="""SELECT station_id, k, sum(w) AS weighted, count(*) AS n_cells FROM (SELECT station_id, parameter, s, max(w) AS w FROM dfs WHERE reason_code NOT IN ('R18','R19') GROUP BY ALL), inst
  WHERE s > ats - 604800 AND s <= ats GROUP BY ALL""",
    wrun="""SELECT station_id, k, count(*) AS n_episodes FROM (SELECT *, lag(s) OVER (PARTITION BY station_id, parameter, reason_code, k ORDER BY s) AS p FROM
  (SELECT DISTINCT station_id, parameter, reason_code, s, k, coalesce(cadence_s, 3600) AS cadence_s FROM (SELECT * FROM dfs WHERE reason_code NOT IN ('R18','R19')) d
  LEFT JOIN series USING (station_id, parameter), inst WHERE s > ats - 604800 AND s <= ats)) WHERE p IS NULL OR s - p <> cadence_s GROUP BY ALL""",
    t_health="""SELECT station_id, k, exp(-(CASE WHEN covered > 0 THEN coalesce(weighted, 0) / covered ELSE 0 END) / 0.3) AS health, coalesce(n_episodes, 0) AS n_episodes,
  CASE WHEN covered > 0 THEN round(100.0 * least(coalesce(n_cells, 0) / covered, 1.0), 1) ELSE 0.0 END AS spoiled_pct
  FROM stk LEFT JOIN cvd USING (station_id, k) LEFT JOIN wcell USING (station_id, k) LEFT JOIN wrun USING (station_id, k)""",
    nfrac="SELECT station_id, avg(CASE WHEN n > 1 THEN 1.0 ELSE 0.0 END)::DOUBLE AS neighbour_fraction FROM series JOIN (SELECT parameter, count(*) AS n FROM series GROUP BY ALL) USING (parameter) GROUP BY ALL",
    t_imp0="""SELECT station_id, k, coalesce(expected, 0) AS expected, coalesce(absent, 0) AS absent, CASE WHEN coalesce(expected, 0) = 0 THEN 0.0::DOUBLE
    ELSE least(greatest(coalesce(absent, 0) / expected * (1 - 0.5 * neighbour_fraction), 0), 1) END AS u
  FROM stk LEFT JOIN expd USING (station_id, k) LEFT JOIN absd USING (station_id, k) LEFT JOIN nfrac USING (station_id)""",
    t_imp="SELECT station_id, k, 1 - u AS certainty, round(100 * u, 1) AS absent_pct, absent, expected FROM t_imp0",
    pr="""SELECT station_id, parameter, peer_id FROM (SELECT a.station_id, a.parameter, b.station_id AS peer_id, row_number() OVER (PARTITION BY a.station_id, a.parameter ORDER BY b.station_id) AS r
  FROM series a JOIN series b ON a.parameter = b.parameter AND a.station_id <> b.station_id) WHERE r <= 3""",
    fst="SELECT station_id, parameter, s, first(value ORDER BY ingest_seq) AS value FROM rd GROUP BY ALL",
    pairw="""SELECT a.station_id, a.parameter, peer_id, k, a.value AS v1, b.value AS v2 FROM fst a JOIN pr USING (station_id, parameter)
  JOIN fst b ON b.station_id = peer_id AND b.parameter = a.parameter AND b.s = a.s JOIN inst ON a.s > ats - 604800 AND a.s <= ats WHERE a.value IS NOT NULL AND b.value IS NOT NULL""",
    rk="""SELECT *, rank() OVER (PARTITION BY station_id, parameter, peer_id, k ORDER BY v1) + (count(*) OVER (PARTITION BY station_id, parameter, peer_id, k, v1) - 1) / 2.0 AS r1,
  rank() OVER (PARTITION BY station_id, parameter, peer_id, k ORDER BY v2) + (count(*) OVER (PARTITION BY station_id, parameter, peer_id, k, v2) - 1) / 2.0 AS r2 FROM pairw""",
    rhos="SELECT station_id, parameter, peer_id, k, corr(r1, r2) AS rho FROM rk GROUP BY ALL HAVING count(*) >= 3 AND min(v1) < max(v1) AND min(v2) < max(v2)",
    own="SELECT station_id, parameter, k, coalesce(min(value) = max(value), true) AS frozen FROM fst, inst WHERE s > ats - 604800 AND s <= ats GROUP BY ALL",
    cross0="""SELECT o.station_id, o.parameter, o.k, frozen, coalesce(np, 0) AS np, rho, coalesce(nv, 0) AS nv FROM own o
  LEFT JOIN (SELECT station_id, parameter, count(*) AS np FROM pr GROUP BY ALL) USING (station_id, parameter)
  LEFT JOIN (SELECT station_id, parameter, k, avg(rho) AS rho, count(*) AS nv FROM rhos GROUP BY ALL) USING (station_id, parameter, k)""",
    cross1="""SELECT station_id, k, avg(sc) AS sc, count(sc) AS n_scored, sum(dis)::BIGINT AS n_disagree, bool_or(lack) AS lack FROM (SELECT *,
  CASE WHEN np < 2 THEN NULL WHEN frozen THEN 0.0 ELSE (rho + 1) / 2 END AS sc, CASE WHEN np < 2 THEN 0 WHEN frozen THEN np WHEN round(rho, 9) < 0.3 THEN nv ELSE 0 END AS dis,
  np < 2 OR (NOT frozen AND rho IS NULL) AS lack FROM cross0) GROUP BY ALL""",
    t_cross="""SELECT station_id, k, coalesce(sc, 0.5) AS consistency, coalesce(n_scored, 0) AS n_scored, coalesce(n_disagree, 0) AS n_disagree,
  coalesce(n_scored = 0 OR lack, true) AS few_peers FROM stk LEFT JOIN cross1 USING (station_id, k)""",
    plaus0="""SELECT station_id, k, min(CASE WHEN value < lo OR value > hi THEN 0 WHEN hi - value < 0.1 * (hi - lo) THEN (hi - value) / (0.1 * (hi - lo)) ELSE 1 END)::DOUBLE AS worst, count(*) AS n_readings
  FROM rd JOIN bnd USING (parameter), inst WHERE value IS NOT NULL AND s > ats - 604800 AND s <= ats GROUP BY ALL""",
    veto="SELECT DISTINCT station_id, k FROM dfs, inst WHERE reason_code IN ('R07','R08','R09') AND s > ats - 604800 AND s <= ats",
    t_plaus="""SELECT station_id, k, CASE WHEN v.station_id IS NOT NULL THEN 0.0 ELSE coalesce(worst, 1.0) END AS plausibility, coalesce(n_readings, 0) AS n_readings,
  v.station_id IS NOT NULL AS implausible FROM stk LEFT JOIN plaus0 USING (station_id, k) LEFT JOIN (SELECT station_id, k FROM veto) v USING (station_id, k)""",
    t_sev="SELECT station_id, k, 1 + coalesce(max(w), 0) AS severity FROM stk LEFT JOIN dfs d USING (station_id) WHERE false GROUP BY ALL",
    t_sev1="SELECT station_id, k, 1 + max(w) AS severity FROM dfs, inst WHERE s > ats - 604800 AND s <= ats GROUP BY ALL",
    tscore="""SELECT station_id, k, timestamp_utc, round(health * 0.35, 6) AS c1, round(certainty * 0.15, 6) AS c2, round(consistency * 0.2, 6) AS c3, round(plausibility * 0.3, 6) AS c4,
  health, certainty, consistency, plausibility, coalesce(severity, 1.0) AS severity, measured, CASE WHEN measured THEN exposure ELSE 1.0 END AS x, n_episodes, absent_pct, n_disagree, n_readings, spoiled_pct, n_scored, (station_id, k) IN (SELECT (station_id, k) FROM cross1) AS compared,
  concat_ws('|', CASE WHEN n_episodes > 0 THEN 'T01' END, CASE WHEN certainty < 1 THEN 'T02' END, CASE WHEN n_scored > 0 AND n_disagree > 0 THEN 'T03' END,
  CASE WHEN few_peers THEN 'T05' END, CASE WHEN implausible THEN 'T04' END) AS codes
  FROM stk JOIN t_health USING (station_id, k) JOIN t_imp USING (station_id, k) JOIN t_cross USING (station_id, k) JOIN t_plaus USING (station_id, k)
  LEFT JOIN t_sev1 USING (station_id, k) LEFT JOIN layer USING (station_id)""",
    tfinal="""SELECT station_id, timestamp_utc, round(least(greatest(c1 + c2 + c3 + c4, 0), 1), 6) AS trust, CASE WHEN codes = '' THEN 'T00' ELSE codes END AS reason_codes,
  round(round((c1 + c2 + c3 + c4) * severity * x, 6), 4) AS risk, round(severity, 6) AS severity_vs_threshold, x::DOUBLE AS population_exposure, NOT coalesce(measured, false) AS stubbed, * EXCLUDE (station_id, timestamp_utc) FROM tscore""",
)


def clk(spark, sf):
    s = store(spark, sf)
    return s, trust.clock(s.cov.series)


@query("v10_covered_in_window", "SELECT station_id, k, covered, coalesce(expected, 0) AS expected FROM cvd LEFT JOIN expd USING (station_id, k)")
def v10(spark, sf):
    s, c = clk(spark, sf)
    return trust.covered_cells(s.cov.series, c)


@query("t1_scoring_instants", "SELECT k, timestamp_utc AS \"at\" FROM inst")
def t1(spark, sf):
    return trust.instants(store(spark, sf).cov.series)


@query("t2_window_membership", "SELECT station_id, k, count(*) AS n_rows FROM rd, inst WHERE s > ats - 604800 AND s <= ats GROUP BY ALL")
def t2(spark, sf):
    s, c = clk(spark, sf)
    per_tick = s.readings.groupBy("station_id", "timestamp_utc").agg(F.count(F.lit(1)).alias("n"))
    return trust.in_windows(per_tick, c).groupBy("station_id", "k").agg(F.sum("n").alias("n_rows"))


@query("t3_health", "SELECT station_id, k, round(health, 6) AS health, n_episodes, spoiled_pct FROM t_health")
def t3(spark, sf):
    s, c = clk(spark, sf)
    out = trust.health(s.defects, s.cov.series, c, trust.covered_cells(s.cov.series, c))
    return out.withColumn("health", F.round("health", 6))


@query("t4_imputation", "SELECT station_id, k, round(certainty, 6) AS certainty, absent_pct, absent, expected FROM t_imp")
def t4(spark, sf):
    s, c = clk(spark, sf)
    out = trust.imputation(s.cov, c, trust.covered_cells(s.cov.series, c))
    return out.withColumn("certainty", F.round("certainty", 6))


@query("t5_neighbour_fraction", "SELECT * FROM nfrac")
def t5(spark, sf):
    return trust.neighbour_fraction(store(spark, sf).cov.series)


@query("t6_rank_agreement", "SELECT station_id, parameter, peer_id, k, round(rho, 6) AS rho FROM rhos")
def t6a(spark, sf):
    s, c = clk(spark, sf)
    return trust.rank_agreement(s.readings, s.cov.series, c, s.cov.n_rows).withColumn("rho", F.round("rho", 6))


@query("t6_cross_sensor", "SELECT station_id, k, round(consistency, 6) AS consistency, n_scored, n_disagree, few_peers FROM t_cross WHERE (station_id, k) IN (SELECT (station_id, k) FROM cross1)")
def t6(spark, sf):
    s, c = clk(spark, sf)
    return trust.cross_sensor(s.readings, s.cov.series, c, s.cov.n_rows).withColumn("consistency", F.round("consistency", 6))


@query("t7_plausibility", "SELECT station_id, k, round(plausibility, 6) AS plausibility, n_readings, implausible FROM t_plaus WHERE (station_id, k) IN (SELECT (station_id, k) FROM plaus0 UNION SELECT (station_id, k) FROM veto)")
def t7(spark, sf):
    s, c = clk(spark, sf)
    return trust.plausibility(s.readings, s.defects, c).withColumn("plausibility", F.round("plausibility", 6))


@query("t8_severity", "SELECT station_id, k, round(severity, 6) AS severity FROM t_sev1")
def t8(spark, sf):
    s, c = clk(spark, sf)
    return trust.severity_above(s.defects, c).withColumn("severity", F.round("severity", 6))


def scores(spark, sf):
    s = store(spark, sf)
    return trust.score(trust.components(s.cov, s.defects), layer(spark, sf))


@query("t9_trust_score", "SELECT station_id, timestamp_utc, trust, reason_codes FROM tfinal")
def t9(spark, sf):
    return scores(spark, sf).select(
        "station_id", "timestamp_utc", F.round("trust", 6).alias("trust"), F.concat_ws("|", "reason_codes").alias("reason_codes")
    )


@query("t10_risk", "SELECT station_id, timestamp_utc, risk, severity_vs_threshold, population_exposure, stubbed FROM tfinal")
def t10(spark, sf):
    return scores(spark, sf).select(
        "station_id",
        "timestamp_utc",
        F.round("risk.value", 4).alias("risk"),
        F.round("risk.severity_vs_threshold", 6).alias("severity_vs_threshold"),
        "risk.population_exposure",
        F.col("risk.population_exposure_stubbed").alias("stubbed"),
    )


@query(
    "t11_trust_components",
    """SELECT station_id, timestamp_utc, name, round(value, 6) AS value, round(contribution, 6) AS contribution FROM (
  SELECT station_id, timestamp_utc, 'HealthConf' AS name, health AS value, c1 AS contribution FROM tfinal UNION ALL SELECT station_id, timestamp_utc, 'ImputationCertainty', certainty, c2 FROM tfinal
  UNION ALL SELECT station_id, timestamp_utc, 'CrossSensorConsistency', consistency, c3 FROM tfinal UNION ALL SELECT station_id, timestamp_utc, 'PhysicalPlausibility', plausibility, c4 FROM tfinal)""",
)
def t11(spark, sf):
    return (
        scores(spark, sf)
        .select("station_id", "timestamp_utc", F.inline("components"))
        .select(
            "station_id", "timestamp_utc", "name", F.round("value", 6).alias("value"), F.round("contribution", 6).alias("contribution")
        )
    )


@query(
    "t9_component_details",
    """SELECT station_id, timestamp_utc, name, detail FROM (SELECT station_id, timestamp_utc, 'HealthConf' AS name, n_episodes || ' active fault(s) spoiling ' || spoiled_pct::DOUBLE || '% of readings' AS detail FROM tfinal
  UNION ALL SELECT station_id, timestamp_utc, 'ImputationCertainty', 'imputation uncertainty ' || absent_pct::DOUBLE || '% (placeholder, no model)' FROM tfinal
  UNION ALL SELECT station_id, timestamp_utc, 'CrossSensorConsistency', CASE WHEN compared THEN n_scored || ' parameter(s) compared to peers' ELSE 'no data' END FROM tfinal
  UNION ALL SELECT station_id, timestamp_utc, 'PhysicalPlausibility', 'worst-case margin over ' || n_readings || ' readings' FROM tfinal)""",
)
def t9d(spark, sf):
    return scores(spark, sf).select("station_id", "timestamp_utc", F.inline("components")).select("station_id", "timestamp_utc", "name", "detail")


@query("t12_merged_evidence", "SELECT station_id, timestamp_utc, n_episodes AS n_defects, absent_pct AS pct, n_disagree AS n, 2::BIGINT AS min_peers, n_readings FROM tfinal")
def t12(spark, sf):
    s = scores(spark, sf).withColumn("e", trust.merged_evidence(None))
    get = lambda k, t: F.try_element_at("e", F.lit(k)).cast(t).alias(k)
    wanted = [get("n_defects", "bigint"), get("pct", "double"), get("n", "bigint"), get("min_peers", "bigint"), get("n_readings", "bigint")]
    return s.select("station_id", "timestamp_utc", *wanted)


@query(
    "t12_reason_sentences",
    "SELECT station_id, timestamp_utc, code AS reason_code, replace(replace(replace(replace(" + O.case("code", {c: t for c, t in registry.SENTENCE.items() if c.startswith("T")}) + """,
  '{n_defects}', n_episodes::VARCHAR), '{pct}', absent_pct::DOUBLE::VARCHAR), '{min_peers}', '2'), '{n}', n_disagree::VARCHAR) AS sentence FROM (SELECT *, unnest(string_split(reason_codes, '|')) AS code FROM tfinal)""",
)
def t12s(spark, sf):
    return trust.reason_sentences(scores(spark, sf))


@query("t13_score_invariants", "SELECT count(*) FILTER (trust NOT BETWEEN 0 AND 1 OR reason_codes = '') AS n_violations, count(*) AS n_scores FROM tfinal")
def t13(spark, sf):
    s = scores(spark, sf)
    bad = trust.score_violations(s).agg(F.count(F.lit(1)).alias("x")).scalar()
    return s.agg(F.count(F.lit(1)).alias("n_scores")).withColumn("n_violations", bad)

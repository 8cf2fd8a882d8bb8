"""Catalogue: sources, sinks, operations and read queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stationproof.functions.columns import CELL, SERIES, secs, union_all
from stationproof.functions.state import checkpoint_dir, cut
from stationproof.operators import audit, canonical, coverage, ops, reads
from stationproof.plans import oracle as O
from stationproof.plans import views
from stationproof.plans.catalog import query
from stationproof.plans.q_graph import events, judged
from stationproof.plans.q_models import network_residuals
from stationproof.plans.q_trust import scores as compute_scores
from stationproof.plans.shared import store
from stationproof.sources import readings as src
from stationproof.sources import sinks
from stationproof.sources.runstore import RunStore

_CACHE: dict = {}


def once(spark, sf, name, make):
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _CACHE:
        _CACHE[key] = cut(make())
    return _CACHE[key]


def scores(spark, sf):
    return once(spark, sf, "scores", lambda: compute_scores(spark, sf))


def verdict_events(spark, sf):
    from stationproof.operators import adjudicate as adj

    return once(spark, sf, "events", lambda: adj.write_back(events(spark, sf), judged(spark, sf)[1]))


def z(c):
    return F.round(c, 6)


# --- sources ------------------------------------------------------------------------------------
CANON = ["station_id", "parameter", "timestamp_utc", "unit", "source_file", "row_hash"]
STAMP = "strftime(timestamp_utc, '%Y-%m-%d-%H-%M')"


@query("s1_canonical_scan", "SELECT station_id, parameter, timestamp_utc, unit, source_file, row_hash, round(value, 6) AS value FROM hashed")
def s1(spark, sf):
    r = canonical.add_row_hash(views.readings(spark, sf))
    return r.select(*CANON, z("value").alias("value"))


def vendor_text(spark, sf):
    """The readings as a vendor would deliver them: text columns, station only in the file name."""
    r = views.readings(spark, sf)
    k = F.col("ingest_seq")
    n = F.substring("station_id", 5, 2)
    place = F.concat(F.lit("Site, "), n, F.when(n == "07", "").otherwise(F.concat(F.lit(" (47."), n, F.lit("5, 21.5"), n, F.lit(")"))))
    return r.select(
        F.date_format("timestamp_utc", "yyyy-MM-dd-HH-mm").alias("timestamp"),
        place.alias("Location"),
        F.col("parameter").alias("Mérőeszköz"),
        F.when(k % 29 == 0, "hiba").otherwise(F.round("value", 3).cast("string")).alias("érték"),
        F.col("unit").alias("mértékegység"),
        F.concat(F.lit("deb-ker"), n, F.lit("_Levego.csv")).alias("file_name"),
        "ingest_seq",
    )


@query(
    "s2_vendor_export",
    """SELECT 'DEB-KER' || substr(station_id, 5, 2) AS station_id, parameter, timestamp_utc, CASE WHEN ingest_seq % 29 = 0 THEN NULL ELSE round(value, 3) END AS value, unit,
  'deb-ker' || substr(station_id, 5, 2) || '_Levego.csv' AS source_file FROM rd""",
)
def s2(spark, sf):
    return src.vendor_rows(vendor_text(spark, sf)).drop("instrument_id", "ingest_seq")


@query(
    "s4_site_metadata",
    """SELECT DISTINCT 'DEB-KER' || n AS station_id, CASE WHEN n <> '07' THEN 'Site, ' || n END AS name, CASE WHEN n <> '07' THEN CAST('47.' || n || '5' AS DOUBLE) END AS lat,
  CASE WHEN n <> '07' THEN CAST('21.5' || n AS DOUBLE) END AS lon, n = '07' AS malformed FROM (SELECT substr(station_id, 5, 2) AS n FROM rd)""",
)
def s4(spark, sf):
    return src.site_metadata(vendor_text(spark, sf)).drop("location")


def wide_counters(spark, sf):
    li = views.table(spark, sf, "lineitem")
    day = F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return li.select(
        day.alias("time"),
        F.concat(F.lit("TC-"), (F.col("l_suppkey") % 10).cast("string")).alias("uuid"),
        F.concat(F.lit("nick "), F.col("l_linenumber").cast("string")).alias("nick"),
        F.when(F.col("l_orderkey") % 3 == 0, "n/a").otherwise((F.lit(47) + F.col("l_orderkey") % 7).cast("string")).alias("lat"),
        (F.lit(21) + F.col("l_linenumber")).cast("string").alias("lng"),
        F.col("l_quantity").alias("cars_60+"),
        F.when(F.col("l_linenumber") < 4, F.col("l_extendedprice")).alias("vans_0-30"),
        (F.col("l_orderkey") * 100000000 + F.col("l_linenumber") * 10000000 + F.col("l_partkey")).alias("ingest_seq"),
    )


@query(
    "s5_counters_to_long",
    """SELECT 'TC-' || (l_suppkey % 10) AS counter_id, l_shipdate AS timestamp_utc, ingest_seq, parameter, cumulative FROM (SELECT l_suppkey, l_shipdate, l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey AS ingest_seq,
  unnest(['cars_60+', 'vans_0-30']) AS parameter, unnest([l_quantity, CASE WHEN l_linenumber < 4 THEN l_extendedprice END]) AS cumulative FROM lineitem) WHERE cumulative IS NOT NULL""",
)
def s5(spark, sf):
    return src.counter_rows(wide_counters(spark, sf), ["cars_60+", "vans_0-30"])


@query(
    "s6_counter_locations",
    """SELECT 'TC-' || c AS counter_id, 'nick ' || ln AS name, lat, 21.0 + ln AS lon FROM (SELECT l_suppkey % 10 AS c, arg_min(l_linenumber, k) AS ln, (47 + arg_min(l_orderkey, k) % 7)::DOUBLE AS lat FROM
  (SELECT *, l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey AS k FROM lineitem WHERE l_orderkey % 3 <> 0) GROUP BY 1)""",
)
def s6(spark, sf):
    return src.counter_locations(wide_counters(spark, sf))


ZONES = {"STA-01": "urban", "STA-02": "industrial", "STA-05": "background"}


@query("s9_station_zones", "SELECT station_id, CASE station_id WHEN 'STA-01' THEN 'urban' WHEN 'STA-02' THEN 'industrial' WHEN 'STA-05' THEN 'background' END AS zone_type FROM (SELECT DISTINCT station_id FROM rd)")
def s9(spark, sf):
    return src.with_zones(views.readings(spark, sf).select("station_id").distinct(), ZONES)


@query("s10_station_frame", "SELECT parameter, timestamp_utc, row_hash FROM hashed WHERE station_id = 'STA-04' AND timestamp_utc <= TIMESTAMP '2024-01-15 00:00:00'")
def s10(spark, sf):
    r = src.network_frame(store(spark, sf).readings, end="2024-01-15 00:00:00")
    return src.station_frame(r, "STA-04").select("parameter", "timestamp_utc", "row_hash")


# --- sinks --------------------------------------------------------------------------------------
@query("k1_idempotent_load", "SELECT DISTINCT row_hash, strftime(timestamp_utc, '%Y-%m-%d') AS day FROM hashed WHERE row_hash NOT IN (SELECT row_hash FROM hashed WHERE ingest_seq % 2 = 0)")
def k1(spark, sf):
    r = canonical.add_row_hash(views.readings(spark, sf))
    # the batch carries every row twice; half of it is on record already
    fresh = sinks.new_rows(r.unionByName(r), r.where("ingest_seq % 2 = 0"))
    return fresh.select("row_hash", F.date_format("timestamp_utc", "yyyy-MM-dd").alias("day"))


@query(
    "k2_dimension_upsert",
    """SELECT station_id, string_agg(parameter || '=' || n, '|' ORDER BY parameter) AS coverage FROM (SELECT station_id, parameter, count(value) AS n FROM rd GROUP BY ALL) WHERE station_id NOT IN ('STA-01', 'STA-02') GROUP BY ALL""",
)
def k2(spark, sf):
    dim = sinks.station_dimension(views.readings(spark, sf))
    stored = dim.where(F.col("station_id").isin("STA-01", "STA-02"))
    text = F.transform(F.map_entries("coverage"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return sinks.new_keys(dim, stored, "station_id").select("station_id", F.concat_ws("|", text).alias("coverage"))


@query("k3_run_stamped_defects", "SELECT 'ar_' || checksum || '_cfg00000' AS audit_run_id, d.station_id, d.parameter, d.timestamp_utc, d.reason_code FROM defect d, digest")
def k3(spark, sf):
    s = store(spark, sf)
    run = audit.run_meta(s.readings, "cfg00000").select("audit_run_id").scalar()
    return s.defects.select(*CELL, "reason_code").withColumn("audit_run_id", run)


O.cte(
    ledger="""SELECT 'defect' AS record_type, station_id, parameter, strftime(timestamp_utc, '%Y-%m-%dT%H:%M:%S') AS timestamp_utc, reason_code, severity, true AS counts_toward_rate, '' AS excluded_cells FROM counting
  UNION ALL SELECT 'structural_exclusion', station_id, parameter, '', reason_code, 'info', false, CAST(excluded_cells AS VARCHAR) FROM structural""",
    acct="""SELECT (SELECT count(*) FROM rd) AS n_readings, n_covered_cells, n_defective_cells, (SELECT count(*) FROM structural) AS n_structural_exclusions, defect_rate FROM rate""",
    ledhash="""SELECT sha1(concat_ws(chr(31), record_type, station_id, parameter, timestamp_utc, reason_code, severity, counts_toward_rate, excluded_cells)) AS row_hash FROM ledger
  UNION ALL SELECT sha1(concat_ws(chr(31), n_readings, n_covered_cells, n_defective_cells, n_structural_exclusions, round(defect_rate * 1000000)::BIGINT)) FROM acct""",
    ledsum="SELECT count(*) AS n_rows, " + ", ".join(f"sum(('0x' || substr(row_hash, {1 + 8 * i}, 8))::BIGINT::HUGEINT) AS w{i}" for i in range(5)) + " FROM ledhash",
)


def ledger(spark, sf):
    s = store(spark, sf)
    return sinks.ledger(s.defects, coverage.structural_absences(s.readings, s.cov.series, s.cov.n_rows))


@query("k6_regulatory_ledger", "SELECT * FROM ledger")
def k6(spark, sf):
    return ledger(spark, sf).drop("evidence")


def accounting(spark, sf):
    s = store(spark, sf)
    rate = audit.defect_rate(s.defects, s.cov.series)
    gone = coverage.structural_absences(s.readings, s.cov.series, s.cov.n_rows)
    return rate.withColumns(
        {
            "n_readings": s.readings.agg(F.count(F.lit(1)).alias("x")).scalar(),
            "n_structural_exclusions": gone.agg(F.count(F.lit(1)).alias("x")).scalar(),
        }
    ).select("n_readings", "n_covered_cells", "n_defective_cells", "n_structural_exclusions", "defect_rate")


@query("k7_accounting", "SELECT * FROM acct")
def k7(spark, sf):
    return accounting(spark, sf)


@query("k7_verification_hash", "SELECT n_rows, substr(sha256(concat_ws('-', n_rows, w0, w1, w2, w3, w4)), 1, 16) AS checksum FROM ledsum")
def k7h(spark, sf):
    ppm = F.round(F.col("defect_rate") * 1_000_000).cast("bigint")
    return sinks.verification(ledger(spark, sf), accounting(spark, sf).withColumn("defect_rate", ppm))


@query("k8_top_codes", "SELECT reason_code, count(*) AS n FROM defect GROUP BY ALL ORDER BY n DESC, reason_code LIMIT 8")
def k8(spark, sf):
    return sinks.top_codes(store(spark, sf).defects)


# --- operations ---------------------------------------------------------------------------------
O.cte(
    ticket="""SELECT station_id, parameter, reason_code, severity, n_flags, coalesce(x, 1.0)::DOUBLE AS importance, round(w * coalesce(x, 1.0), 6)::DOUBLE AS priority, severity || '=' || n_flags AS mix
  FROM (SELECT station_id, parameter, reason_code, any_value(severity) AS severity, any_value(w) AS w, count(*) AS n_flags FROM dfs GROUP BY station_id, parameter, reason_code) LEFT JOIN imp USING (station_id)""",
    imp="SELECT station_id, CASE WHEN measured THEN exposure ELSE 1.0 END AS x FROM layer",
    tid="SELECT *, station_id || '/' || parameter || '/' || reason_code AS item_id, CASE n_flags % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'acknowledged' ELSE 'resolved' END AS status FROM ticket",
    tlog0="SELECT l_orderkey AS item_id, l_linenumber AS seq FROM lineitem GROUP BY ALL",
    tlog="SELECT item_id, seq, CASE (seq + item_id % 2) % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'acknowledged' WHEN 2 THEN 'dispatched' ELSE 'resolved' END AS to_status FROM tlog0",
    alert="""SELECT e.*, coalesce(x, 1.0) AS exposure, CASE verdict WHEN 'GENUINE_EVENT' THEN 1.0 WHEN 'LIKELY_FAULT' THEN 0.15 ELSE 0.5 END AS genuineness, CASE severity WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.75 WHEN 'medium' THEN 0.5 WHEN 'low' THEN 0.25 ELSE 0.1 END AS hazard,
  0.5 + 0.5 * coalesce(confidence, 0.6) AS cw FROM (SELECT evt.event_id, evt.station_id, evt.severity, verdict, confidence FROM evt LEFT JOIN verd USING (event_id)) e LEFT JOIN imp USING (station_id)""",
    so="SELECT o_orderkey AS signoff_id, o_custkey AS event_id, o_orderpriority AS channel, o_orderkey % 11 = 0 AS revoked, o_orderdate + INTERVAL 900 SECOND AS expires_at FROM orders",
    rq="""SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 13 = 0 THEN -1 ELSE o_orderkey END AS signoff_id, o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS event_id, o_orderpriority AS channel,
  o_orderdate + INTERVAL 300 SECOND * (o_orderkey % 7) AS requested_at FROM orders""",
    chk="""SELECT request_id, signoff_id, rq.event_id, rq.channel, requested_at, CASE WHEN so.event_id IS NULL THEN 'missing' WHEN so.event_id <> rq.event_id OR so.channel <> rq.channel THEN 'mismatch' WHEN revoked THEN 'revoked'
  WHEN expires_at <= requested_at THEN 'expired' ELSE 'ok' END AS reason FROM rq LEFT JOIN so USING (signoff_id)""",
)


def station_importance(spark, sf):
    return ops.importance(scores(spark, sf))


def tickets(spark, sf):
    return once(spark, sf, "tickets", lambda: ops.tickets(store(spark, sf).defects, station_importance(spark, sf)))


def items(spark, sf):
    s = F.col("n_flags") % 3
    return tickets(spark, sf).select(
        F.concat_ws("/", *ops.TICKET).alias("item_id"),
        F.when(s == 0, "open").when(s == 1, "acknowledged").otherwise("resolved").alias("status"),
        "priority",
    )


@query("o1_tickets", "SELECT * FROM ticket")
def o1(spark, sf):
    mix = F.transform(F.map_entries("severity_mix"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return tickets(spark, sf).select(*ops.TICKET, "severity", "n_flags", "importance", "priority", F.concat_ws("|", mix).alias("mix"))


@query("o2_new_tickets", "SELECT station_id, parameter, reason_code, priority FROM ticket WHERE n_flags % 2 = 1")
def o2(spark, sf):
    t = tickets(spark, sf)
    return ops.new_tickets(t, t.where("n_flags % 2 = 0")).select(*ops.TICKET, "priority")


def log(spark, sf):
    li = views.table(spark, sf, "lineitem")
    seq, item = F.col("l_linenumber"), F.col("l_orderkey")
    s = (seq + item % 2) % 4
    return (
        li.select(item.alias("item_id"), seq.cast("bigint").alias("seq"), s.alias("s"))
        .distinct()
        .withColumn("to_status", F.when(F.col("s") == 0, "open").when(F.col("s") == 1, "acknowledged").when(F.col("s") == 2, "dispatched").otherwise("resolved"))
        .drop("s")
    )


@query(
    "o3_lifecycle_check",
    """SELECT item_id, seq, f AS from_status, to_status, f || '>' || to_status IN ('open>acknowledged', 'acknowledged>dispatched', 'acknowledged>resolved', 'dispatched>resolved') AS allowed
  FROM (SELECT *, coalesce(lag(to_status) OVER (PARTITION BY item_id ORDER BY seq), 'open') AS f FROM tlog)""",
)
def o3(spark, sf):
    return ops.transition_check(log(spark, sf), spark)


@query("o3_current_status", "SELECT item_id, arg_max(to_status, seq) AS status, count(*) AS n_steps FROM tlog GROUP BY item_id")
def o3c(spark, sf):
    return ops.current_status(log(spark, sf))


@query("o4_queue_page", "SELECT item_id, status, priority FROM tid WHERE status = 'open' AND (priority < 0.7 OR (priority = 0.7 AND item_id > 'STA-02')) ORDER BY priority DESC, item_id LIMIT 20")
def o4(spark, sf):
    return ops.queue(items(spark, sf), "open", 20, (0.7, "STA-02"))


@query("o5_station_importance", "SELECT station_id, x::DOUBLE AS importance FROM imp")
def o5(spark, sf):
    return station_importance(spark, sf)


@query("o6_alerts", "SELECT event_id, station_id, severity, verdict, genuineness::DOUBLE AS genuineness, hazard::DOUBLE AS hazard, exposure::DOUBLE AS exposure, round(genuineness * exposure * hazard * cw, 5) AS risk FROM alert")
def o6(spark, sf):
    a = ops.alerts(verdict_events(spark, sf), station_importance(spark, sf))
    unrounded = F.col("genuineness") * F.col("exposure") * F.col("hazard") * F.col("confidence_weight")
    return a.select("event_id", "station_id", "severity", "verdict", "genuineness", "hazard", "exposure", F.round(unrounded, 5).alias("risk"))


@query(
    "o6_ranked_alerts",
    """SELECT event_id, station_id, row_number() OVER (ORDER BY round(genuineness * exposure * hazard * cw, 6) DESC, exposure DESC, event_id) AS position,
  round(genuineness * exposure * hazard * cw, 5) AS risk FROM alert""",
)
def o6_ranked(spark, sf):
    a = ops.ranked_alerts(ops.alerts(verdict_events(spark, sf), station_importance(spark, sf)))
    unrounded = F.col("genuineness") * F.col("exposure") * F.col("hazard") * F.col("confidence_weight")
    return a.select("event_id", "station_id", "position", F.round(unrounded, 5).alias("risk"))


O.cte(
    dpt="SELECT station_id, timestamp_utc AS at_, trust AS value FROM tfinal",
    runc="SELECT station_id, block, count(*) AS n FROM counting JOIN blk USING (timestamp_utc) GROUP BY ALL",
    runr="""SELECT station_id, block, 100.0 * coalesce(n, 0) / m AS value FROM (SELECT station_id, sum(n_expected) AS m FROM series GROUP BY ALL) CROSS JOIN (SELECT DISTINCT block FROM blk) LEFT JOIN runc USING (station_id, block)""",
    r2run="SELECT block, 1 - sum(residual ** 2) / sum((y - m) ** 2) AS value FROM res JOIN (SELECT block, avg(y) AS m FROM res GROUP BY ALL) USING (block) GROUP BY ALL",
)
DRIFT = "CASE WHEN l - b > 1e-9 THEN 'up' WHEN l - b < -1e-9 THEN 'down' ELSE 'flat' END"


@query("o7_drift_series", f"SELECT station_id, n_points, round(b, 6) AS baseline, round(l, 6) AS latest, {DRIFT} AS direction FROM (SELECT station_id, count(*) AS n_points, arg_min(value, at_) AS b, arg_max(value, at_) AS l FROM dpt GROUP BY ALL)")
def o7(spark, sf):
    pts = scores(spark, sf).select("station_id", F.col("timestamp_utc").alias("at"), F.col("trust").alias("value"))
    return ops.drift(pts, ["station_id"]).drop("delta").withColumns({"baseline": z("baseline"), "latest": z("latest")})


@query("o8_defect_rate_drift", f"SELECT station_id, n_points, round(b, 6) AS baseline, round(l, 6) AS latest, {DRIFT} AS direction FROM (SELECT station_id, count(*) AS n_points, arg_min(value, block) AS b, arg_max(value, block) AS l FROM runr GROUP BY ALL)")
def o8(spark, sf):
    """Four time blocks stand for four audit runs."""
    from stationproof.functions.columns import dense
    from stationproof.operators import cv
    from stationproof import registry

    s = store(spark, sf)
    b = cv.time_blocks(s.readings, 4)
    n = s.defects.where(registry.counts("reason_code")).join(b, "timestamp_utc").groupBy("station_id", "block").agg(F.count(F.lit(1)).alias("n_defects"))
    covered = s.cov.series.groupBy("station_id").agg(F.sum("n_expected").alias("n_covered"))
    runs = dense(covered, b.select("block").distinct(), "station_id")
    counts = runs.join(n, ["station_id", "block"], "left").fillna({"n_defects": 0}).withColumn("at", F.col("block"))
    return ops.defect_rate_drift(counts).drop("delta").withColumns({"baseline": z("baseline"), "latest": z("latest")})


@query("o9_r2_drift", f"SELECT n_points, round(b, 5) AS baseline, round(l, 5) AS latest, {DRIFT} AS direction FROM (SELECT count(*) AS n_points, arg_min(value, block) AS b, arg_max(value, block) AS l FROM r2run)")
def o9(spark, sf):
    from stationproof.operators import deweather

    m = deweather.fit_metrics(network_residuals(store(spark, sf).readings), ["block"])
    out = ops.drift(m.select(F.col("block").alias("at"), F.col("r2").alias("value")), [])
    return out.drop("delta").withColumns({"baseline": F.round("baseline", 5), "latest": F.round("latest", 5)})


@query(
    "o9_coverage_drift",
    f"""SELECT n_points, round(b, 6) AS baseline, round(l, 6) AS latest, {DRIFT} AS direction, 0.9 AS nominal, round(l - 0.9, 6) AS off_nominal FROM (
    SELECT count(*) AS n_points, arg_min(value, block) AS b, arg_max(value, block) AS l FROM (
      SELECT block, avg(CASE WHEN y >= y_hat - q AND y <= y_hat + q THEN 1.0 ELSE 0.0 END)::DOUBLE AS value FROM res JOIN cal3 USING (parameter) GROUP BY block))""",
)
def o9_coverage(spark, sf):
    from stationproof.operators import conformal

    r = network_residuals(store(spark, sf).readings)
    q = conformal.calibrate(r.where("block = 3"), ["parameter"])
    seen = conformal.coverage(conformal.intervals(r, q, ["parameter"]), ["block"])
    out = ops.coverage_drift(seen.select(F.col("block").alias("at"), F.col("coverage").alias("value")), 0.9)
    return out.drop("delta").withColumns({c: F.round(c, 6) for c in ("baseline", "latest", "off_nominal")})


def orders(spark, sf):
    return views.table(spark, sf, "orders").withColumn("d", F.col("o_orderdate").cast("timestamp_ntz"))


def signoffs(spark, sf):
    return orders(spark, sf).select(
        F.col("o_orderkey").alias("signoff_id"),
        F.col("o_custkey").alias("event_id"),
        F.col("o_orderpriority").alias("channel"),
        (F.col("o_orderkey") % 11 == 0).alias("revoked"),
        (F.col("d") + F.expr("INTERVAL 900 SECOND")).alias("expires_at"),
    )


def requests(spark, sf):
    k = F.col("o_orderkey")
    return orders(spark, sf).select(
        k.alias("request_id"),
        F.when(k % 13 == 0, -1).otherwise(k).alias("signoff_id"),
        (F.col("o_custkey") + F.when(k % 5 == 0, 1).otherwise(0)).alias("event_id"),
        F.col("o_orderpriority").alias("channel"),
        F.timestamp_seconds(secs("d") + 300 * (k % 7)).cast("timestamp_ntz").alias("requested_at"),
    )


@query("o10_dispatch_check", "SELECT * FROM chk")
def o10(spark, sf):
    return ops.check_dispatches(requests(spark, sf), signoffs(spark, sf))


@query("o10_dispatches", "SELECT event_id, channel, signoff_id, arg_min(request_id, requested_at) AS request_id, min(requested_at) AS dispatched_at FROM chk WHERE reason = 'ok' GROUP BY ALL")
def o10d(spark, sf):
    return ops.dispatches(ops.check_dispatches(requests(spark, sf), signoffs(spark, sf)))


@query("o11_status_totals", "SELECT status, count(*) AS n_tickets FROM tid GROUP BY ALL")
def o11(spark, sf):
    return ops.status_totals(items(spark, sf))


@query("o11_recent_dispatches", "SELECT request_id, requested_at, reason FROM chk ORDER BY requested_at DESC, request_id DESC LIMIT 20")
def o11r(spark, sf):
    c = ops.check_dispatches(requests(spark, sf), signoffs(spark, sf))
    return ops.recent(c, "requested_at", "request_id", 20).select("request_id", "requested_at", "reason")


# --- runs on record ----------------------------------------------------------------------------
#: Two configurations of one audit: all flags, and the grave ones an hour later.
CONFIGS = ("cfg00000", "cfg00001")
_RUNS: dict = {}


def run_store(spark, sf):
    """Both runs with their readings, defects, coverage facts and events, committed once in a session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _RUNS:
        s, rs = store(spark, sf), RunStore(spark, f"{checkpoint_dir(spark)}/runs-{uuid.uuid4().hex}")
        facts = coverage.structural_absences(s.readings, s.cov.series, s.cov.n_rows)
        end = s.readings.agg(F.max("timestamp_utc").alias("x")).scalar()
        for i, config in enumerate(CONFIGS):
            defects = s.defects if i == 0 else s.defects.where("severity IN ('critical', 'high')")
            meta = audit.run_meta(s.readings, config)
            run = meta.first()["audit_run_id"]
            described = meta.drop("audit_run_id").withColumn("generated_at", end + F.expr(f"INTERVAL {i} HOUR"))
            tables = {"runs": described, "defects": defects, "coverage_facts": facts, "events": events(spark, sf)}
            rs.commit(run, tables | ({"readings": s.readings} if i == 0 else {}))
        _RUNS[key] = rs
    return _RUNS[key]


O.cte(
    runrow="""SELECT 'ar_' || checksum || '_' || c AS audit_run_id, '0.1.0' AS code_version, c AS config_hash, checksum AS data_checksum, n_rows, (SELECT max(timestamp_utc) FROM rd) + to_hours(i) AS generated_at
  FROM digest, (VALUES (0, 'cfg00000'), (1, 'cfg00001')) t(i, c)""",
    rundef="SELECT audit_run_id, d.* FROM runrow, defect d WHERE config_hash = 'cfg00000' OR severity IN ('critical', 'high')",
)


@query(
    "k3_run_tables",
    """SELECT audit_run_id, 'runs' AS name, 1::BIGINT AS n_rows FROM runrow UNION ALL SELECT audit_run_id, 'defects', count(*) FROM rundef GROUP BY ALL
  UNION ALL SELECT audit_run_id, 'coverage_facts', n FROM runrow, (SELECT count(*) AS n FROM structural) UNION ALL SELECT audit_run_id, 'events', n FROM runrow, (SELECT count(*) AS n FROM evt)""",
)
def k3_tables(spark, sf):
    """Rows of every stored table of every run."""
    rs = run_store(spark, sf)
    names = ("runs", "defects", "coverage_facts", "events")
    return union_all([rs.table(n).groupBy("audit_run_id").agg(F.count(F.lit(1)).alias("n_rows")).select("audit_run_id", F.lit(n).alias("name"), "n_rows") for n in names])


RUN_COLUMNS = ["audit_run_id", "code_version", "config_hash", "data_checksum", "n_rows", "generated_at"]


@query("q10_audit_runs", "SELECT * FROM runrow ORDER BY audit_run_id LIMIT 50")
def q10_runs(spark, sf):
    return run_store(spark, sf).page(50).select(RUN_COLUMNS)


@query("q10_latest_run", "SELECT * FROM runrow ORDER BY generated_at DESC, audit_run_id LIMIT 1")
def q10_latest(spark, sf):
    return run_store(spark, sf).latest_run().select(RUN_COLUMNS)


@query("q11_run_defects", "SELECT audit_run_id, station_id, parameter, timestamp_utc, reason_code, severity FROM rundef WHERE audit_run_id = (SELECT audit_run_id FROM runrow ORDER BY generated_at DESC LIMIT 1)")
def q11_defects(spark, sf):
    """Every defect of the latest run."""
    rs = run_store(spark, sf)
    return rs.run_defects(rs.latest_run().first()["audit_run_id"]).select("audit_run_id", *CELL, "reason_code", "severity")


@query("o11_recent_runs", "SELECT audit_run_id, generated_at, n_rows FROM runrow ORDER BY generated_at DESC, audit_run_id LIMIT 10")
def o11_runs(spark, sf):
    return run_store(spark, sf).recent(10).select("audit_run_id", "generated_at", "n_rows")


@query("s10_stored_days", "SELECT row_hash, station_id, parameter, timestamp_utc FROM hashed WHERE timestamp_utc >= TIMESTAMP '2024-01-05' AND timestamp_utc < TIMESTAMP '2024-01-08'")
def s10_days(spark, sf):
    """Readings of three days out of the store; no other day's files are read."""
    rows = run_store(spark, sf).table("readings", days=("2024-01-05", "2024-01-07"))
    return rows.select("row_hash", *CELL)


# --- read queries -------------------------------------------------------------------------------
@query("q1_readings_page", "SELECT timestamp_utc, row_hash, station_id, parameter FROM hashed WHERE parameter = 'PM10' AND (timestamp_utc, row_hash) > (TIMESTAMP '2024-01-05 00:00:00', '8') ORDER BY timestamp_utc, row_hash LIMIT 50")
def q1(spark, sf):
    p = reads.readings_page(store(spark, sf).readings, parameter="PM10", after=("2024-01-05 00:00:00", "8"), limit=50)
    return p.select("timestamp_utc", "row_hash", "station_id", "parameter")


@query(
    "q2_annotated_readings",
    "SELECT h.row_hash, h.ingest_seq, coalesce(c.codes, '') AS codes FROM hashed h LEFT JOIN (SELECT station_id, parameter, timestamp_utc, string_agg(DISTINCT reason_code, '|' ORDER BY reason_code) AS codes FROM defect GROUP BY ALL) c USING (station_id, parameter, timestamp_utc)",
)
def q2(spark, sf):
    s = store(spark, sf)
    return reads.annotate(s.readings, s.defects).select("row_hash", "ingest_seq", F.concat_ws("|", "reason_codes").alias("codes"))


@query(
    "q3_defects_page",
    "SELECT station_id, parameter, timestamp_utc, reason_code FROM defect WHERE severity = 'high' AND station_id = 'STA-01' AND timestamp_utc >= TIMESTAMP '2024-01-10 00:00:00' ORDER BY timestamp_utc, station_id, parameter, reason_code LIMIT 40",
)
def q3(spark, sf):
    return reads.defects_page(store(spark, sf).defects, station="STA-01", severity="high", start="2024-01-10 00:00:00", limit=40).select(*CELL, "reason_code")


@query("q4_stations_page", "SELECT station_id, n_parameters, coverage, zone_type FROM (SELECT station_id, count(*) AS n_parameters, string_agg(parameter || '=' || n, '|' ORDER BY parameter) AS coverage, CASE station_id WHEN 'STA-01' THEN 'urban' WHEN 'STA-02' THEN 'industrial' WHEN 'STA-05' THEN 'background' END AS zone_type FROM (SELECT station_id, parameter, count(value) AS n FROM rd GROUP BY ALL) GROUP BY station_id) WHERE station_id > 'STA-02' ORDER BY station_id LIMIT 5")
def q4(spark, sf):
    dim = src.with_zones(sinks.station_dimension(store(spark, sf).readings), ZONES)
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("coverage")), lambda e: F.concat_ws("=", e["key"], e["value"])), "|")
    out = dim.select("station_id", F.size("coverage").cast("bigint").alias("n_parameters"), shown.alias("coverage"), "zone_type")
    return reads.page(out, ["station_id"], ("STA-02",), 5)


@query("q5_last_reading", "SELECT station_id, max(timestamp_utc) AS last_reading_at FROM rd GROUP BY station_id")
def q5(spark, sf):
    return reads.last_reading(store(spark, sf).readings)


@query("q6_latest_trust", "SELECT station_id, timestamp_utc, trust, reason_codes FROM tfinal WHERE k = 0")
def q6(spark, sf):
    t = reads.latest_trust(scores(spark, sf).select("station_id", "timestamp_utc", "trust", "reason_codes"))
    return t.select("station_id", "timestamp_utc", z("trust").alias("trust"), F.concat_ws("|", "reason_codes").alias("reason_codes"))


@query("q7_trust_series", "SELECT timestamp_utc, trust FROM tfinal WHERE station_id = 'STA-02' AND timestamp_utc >= TIMESTAMP '2024-01-10 00:00:00' ORDER BY timestamp_utc LIMIT 15")
def q7(spark, sf):
    return reads.trust_series(scores(spark, sf), "STA-02", "2024-01-10 00:00:00", limit=15).select("timestamp_utc", z("trust").alias("trust"))


@query(
    "q8_quality_summary",
    """SELECT p.station_id, n_parameters, coalesce(f.n, 0) AS flag_count, coalesce(w.n, 0) AS absent_cells, m AS last_reading_at, t.trust, round(t.health, 6) AS health, round(greatest(0, 100 * (1 - coalesce(w.n, 0) / (240.0 * n_parameters))), 6) AS uptime_pct
  FROM (SELECT station_id, count(DISTINCT parameter) AS n_parameters, max(timestamp_utc) AS m FROM rd GROUP BY station_id) p LEFT JOIN (SELECT station_id, count(*) AS n FROM counting GROUP BY ALL) f USING (station_id)
  LEFT JOIN (SELECT station_id, count(*) AS n FROM r01 WHERE timestamp_utc BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00' GROUP BY ALL) w USING (station_id) LEFT JOIN (SELECT * FROM tfinal WHERE k = 0) t USING (station_id)""",
)
def q8(spark, sf):
    s = store(spark, sf)
    st = s.cov.series.groupBy("station_id").agg(F.count(F.lit(1)).alias("n_parameters"))
    out = reads.quality_summary(src.with_zones(st, ZONES), s.defects, s.readings, scores(spark, sf), "2024-01-10 00:00:00", "2024-01-20 00:00:00")
    return out.select(
        "station_id", "n_parameters", "flag_count", "absent_cells", "last_reading_at", z("trust").alias("trust"), z("health").alias("health"), z("uptime_pct").alias("uptime_pct")
    )


@query("q9_residual_series", "SELECT parameter, timestamp_utc, round(residual + 1e-9, 6) AS residual FROM res WHERE station_id = 'STA-03' AND parameter = 'PM10' ORDER BY timestamp_utc")
def q9(spark, sf):
    r = network_residuals(store(spark, sf).readings).where("station_id = 'STA-03' AND parameter = 'PM10'")
    return r.select("parameter", "timestamp_utc", F.round(F.col("residual") + 1e-9, 6).alias("residual"))


@query("q10_station_events", "SELECT event_id, parameter, timestamp_utc, evt.reason_code FROM evt WHERE station_id = 'STA-01' ORDER BY timestamp_utc DESC, event_id DESC LIMIT 25")
def q10(spark, sf):
    e = events(spark, sf).where("station_id = 'STA-01'")
    return ops.recent(e, "timestamp_utc", "event_id", 25).select("event_id", "parameter", "timestamp_utc", "reason_code")


@query("q11_run_coverage_facts", "SELECT station_id, parameter, reason_code, domain, excluded_cells FROM structural")
def q11(spark, sf):
    s = store(spark, sf)
    return coverage.structural_absences(s.readings, s.cov.series, s.cov.n_rows)


@query("q12_export_appendix", "SELECT 'signoff' AS kind, signoff_id, event_id FROM so WHERE event_id IN (SELECT event_id FROM evt) UNION ALL SELECT DISTINCT 'dispatch', signoff_id, event_id FROM chk WHERE reason = 'ok' AND event_id IN (SELECT event_id FROM evt)")
def q12(spark, sf):
    so = signoffs(spark, sf)
    dis = ops.dispatches(ops.check_dispatches(requests(spark, sf), so))
    a, b = reads.appendix(so, dis, events(spark, sf))
    kind = lambda df, k: df.select(F.lit(k).alias("kind"), "signoff_id", "event_id")
    return kind(a, "signoff").unionByName(kind(b, "dispatch"))

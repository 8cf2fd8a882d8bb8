"""Catalogue: canonical table, coverage, runs, detectors and audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationproof import config as C
from stationproof import registry
from stationproof.functions.columns import CELL, SERIES, humanise, secs, steps_for_hours
from stationproof.functions.state import cut
from stationproof.operators import audit, canonical, coverage, detectors, runs
from stationproof.plans import oracle as O
from stationproof.plans import views
from stationproof.plans.catalog import ORACLE, query

RULES = {"unit_rules": views.UNIT_RULES, "floors": views.FLOORS}


def cov(spark, sf):
    return coverage.build(views.readings(spark, sf))


def defects(spark, sf):
    return detectors.run_all(cov(spark, sf), **RULES)


def ev(name: str, typ: str = "string"):
    return F.try_element_at("evidence", F.lit(name)).cast(typ)


def shown(df: DataFrame, **cols) -> DataFrame:
    return df.select(*CELL, *[c.alias(n) for n, c in cols.items()])


# --- canonical ---------------------------------------------------------------------------------
def dirty(spark, sf):
    """Events as text rows with bad numbers, for the coercion checks."""
    e = views.table(spark, sf, "events")
    text = (
        F.when(F.col("event_id") % 31 == 0, "n/a")
        .when(F.col("event_id") % 37 == 0, "NaN")
        .otherwise(F.col("value").cast("string"))
    )
    return e.select("event_id", text.alias("raw"))


O.cte(
    dirty="""SELECT event_id, CASE WHEN event_id % 31 = 0 THEN 'n/a' WHEN event_id % 37 = 0 THEN 'NaN' ELSE CAST(value AS VARCHAR) END AS raw FROM events""",
    hashed="""SELECT *, sha1(station_id || chr(31) || parameter || chr(31) || strftime(timestamp_utc, '%Y-%m-%dT%H:%M:%S') || chr(31) ||
  coalesce(CAST(CAST(value AS DECIMAL(28,6)) AS VARCHAR), 'NaN') || chr(31) || unit || chr(31) || source_file) AS row_hash FROM rd""",
    wordsum="""SELECT count(*) AS n_rows, """
    + ", ".join(
        f"sum(('0x' || substr(row_hash, {1 + 8 * i}, 8))::BIGINT::HUGEINT) AS w{i}" for i in range(5)
    )
    + " FROM hashed",
    digest="""SELECT n_rows, substr(sha256(concat_ws('-', n_rows, w0, w1, w2, w3, w4)), 1, 16) AS checksum FROM wordsum""",
)


@query(
    "f1_coerce_numeric",
    """SELECT event_id, CASE WHEN isnan(TRY_CAST(raw AS DOUBLE)) THEN NULL ELSE TRY_CAST(raw AS DOUBLE) END AS value FROM dirty""",
)
def f1(spark, sf):
    return dirty(spark, sf).select("event_id", canonical.to_number(F.col("raw")).alias("value"))


@query("f2_row_hash", "SELECT station_id, parameter, timestamp_utc, ingest_seq, row_hash FROM hashed")
def f2(spark, sf):
    r = canonical.add_row_hash(views.readings(spark, sf))
    return r.select(*CELL, "ingest_seq", "row_hash")


@query(
    "f3_validate",
    """SELECT 'null_station_id' AS rule, 0::BIGINT AS n_rows UNION ALL SELECT 'null_parameter', 0
  UNION ALL SELECT 'null_timestamp_utc', 0 UNION ALL SELECT 'null_unit', count(*) FROM rd WHERE ingest_seq % 101 = 0
  UNION ALL SELECT 'null_source_file', 0 UNION ALL SELECT 'null_row_hash', 0
  UNION ALL SELECT 'unknown_parameter', count(*) FROM rd WHERE ingest_seq % 103 = 0
  UNION ALL SELECT 'nan_value', count(*) FROM rd WHERE ingest_seq % 107 = 0""",
)
def f3(spark, sf):
    k = F.col("ingest_seq")
    r = canonical.add_row_hash(views.readings(spark, sf))
    broken = r.withColumns(
        {
            "unit": F.when(k % 101 != 0, F.col("unit")),
            "parameter": F.when(k % 103 == 0, "Radon").otherwise(F.col("parameter")),
            "value": F.when(k % 107 == 0, float("nan")).otherwise(F.col("value")),
        }
    )
    return canonical.violations(broken)


@query(
    "f4_profile",
    """SELECT parameter, count(*) AS n_rows, count(value) AS n_values, count(DISTINCT round(value, 6)) AS n_distinct,
  round(min(value), 6) AS v_min, round(max(value), 6) AS v_max, string_agg(DISTINCT unit, '|' ORDER BY unit) AS units FROM rd GROUP BY parameter""",
)
def f4(spark, sf):
    r = views.readings(spark, sf).withColumn("value", F.round("value", 6))
    return canonical.profile(r)


@query(
    "f4_profile_overall",
    """SELECT count(*) AS n_rows, count(DISTINCT station_id) AS n_stations, count(DISTINCT parameter) AS n_parameters,
  count(DISTINCT unit) AS n_units, min(timestamp_utc) AS first_utc, max(timestamp_utc) AS last_utc FROM rd""",
)
def f4b(spark, sf):
    return canonical.profile_overall(views.readings(spark, sf))


@query("f5_checksum", "SELECT n_rows, checksum FROM digest")
def f5(spark, sf):
    return canonical.checksum(canonical.add_row_hash(views.readings(spark, sf)))


O.cte(
    t_sentence=f"""SELECT station_id, parameter, timestamp_utc, 'R02' AS reason_code, 'No readings for ' || {O.humanise('duration_s')} || ' - the station stopped transmitting.' AS sentence FROM r02
  UNION ALL SELECT station_id, parameter, timestamp_utc, 'R12', 'Reading has not changed for ' || {O.humanise('duration_s')} || ' - likely a frozen sensor.' FROM r12
  UNION ALL SELECT station_id, parameter, timestamp_utc, 'R13', 'Variation over full record is far below this sensor''s normal range.' FROM r13
  UNION ALL SELECT station_id, parameter, timestamp_utc, 'R18', CASE reason_code WHEN 'R18' THEN 'This station does not carry a ' || parameter || ' sensor.' END FROM r18 WHERE reason_code = 'R18'
  UNION ALL SELECT station_id, parameter, timestamp_utc, 'R19', 'No {{source}} data exists for this station.' FROM r18 WHERE reason_code = 'R19'
  UNION ALL SELECT station_id, parameter, timestamp_utc, 'R21', 'This sensor has reported nothing usable since ' || strftime(timestamp_utc, '%Y-%m-%dT%H:%M:%S') || '.' FROM r21
  UNION ALL SELECT station_id, parameter, timestamp_utc, 'R01', 'No reading was recorded for this hour.' FROM r01
  UNION ALL SELECT station_id, parameter, timestamp_utc, 'R03', 'Two different readings claim the same timestamp.' FROM r03
  UNION ALL SELECT station_id, parameter, timestamp_utc, 'R04', 'This reading is timestamped earlier than the one before it.' FROM r04
  UNION ALL SELECT station_id, parameter, timestamp_utc, 'R07', 'Value of ' || value || ' ' || unit || ' exceeds the physical maximum for ' || parameter || '.' FROM r07
  UNION ALL SELECT station_id, parameter, timestamp_utc, 'R08', 'Value of ' || value || ' ' || unit || ' is below the physical minimum for ' || parameter || '.' FROM r08
  UNION ALL SELECT station_id, parameter, timestamp_utc, 'R09', 'PM2.5 (' || pm25 || ') exceeds PM10 (' || pm10 || '), which is physically impossible.' FROM r09
  UNION ALL SELECT station_id, parameter, timestamp_utc, 'R10', 'Declared unit (ug/m3) does not match the observed value range, which is consistent with ppm.' FROM r10
  UNION ALL SELECT station_id, parameter, timestamp_utc, 'R11', 'Value is pinned at the instrument''s detection limit (0.7 ug/m3) and is left-censored, not a measurement.' FROM r11
  UNION ALL SELECT station_id, parameter, timestamp_utc, 'R14', 'The series shifted by ' || abs(shift) || ' ' || unit || ' and did not return.' FROM r14""",
)


@query("f6_reason_sentences", "SELECT * FROM t_sentence")
def f6(spark, sf):
    return audit.defect_sentences(defects(spark, sf)).select(*CELL, "reason_code", "sentence")


O.cte(
    regcodes="SELECT * FROM (VALUES "
    + ", ".join(f"('{r[0]}', '{r[2]}', '{r[3]}', {str(r[4]).lower()})" for r in registry.REASON_CODES)
    + ") t(reason_code, category, severity, counts)"
)


@query(
    "f7_registry_selections",
    """SELECT c.reason_code, c.category, c.counts, count(d.reason_code) AS n_flags FROM regcodes c LEFT JOIN defect d USING (reason_code)
  WHERE c.counts OR c.category = 'coverage' GROUP BY ALL""",
)
def f7(spark, sf):
    codes = registry.reason_codes(spark)
    picked = registry.counting_codes(codes).unionByName(registry.coverage_codes(codes))
    n = defects(spark, sf).groupBy("reason_code").agg(F.count(F.lit(1)).alias("n_flags"))
    return (
        picked.join(n, "reason_code", "left")
        .fillna({"n_flags": 0})
        .select("reason_code", "category", "counts", "n_flags")
    )


# --- coverage ----------------------------------------------------------------------------------
@query("v1_cadence", "SELECT station_id, parameter, cadence_s FROM series")
def v1(spark, sf):
    return coverage.cadence(views.readings(spark, sf))


@query(
    "v2_series_grid",
    'SELECT station_id, parameter, "start", "end", cadence_s, n_expected, n_observed, n_rows, n_values FROM series',
)
def v2(spark, sf):
    return cov(spark, sf).series.select(
        *SERIES, "start", "end", "cadence_s", "n_expected", "n_observed", "n_rows", "n_values"
    )


@query("v3_absent_ticks", "SELECT station_id, parameter, timestamp_utc FROM absent")
def v3(spark, sf):
    return coverage.absent_ticks(cov(spark, sf).gap_ranges)


@query(
    "v4_network_cadence",
    "SELECT parameter, cadence_s, (SELECT count(DISTINCT station_id) FROM series x WHERE x.parameter = n.parameter) AS n_carriers FROM netcad n",
)
def v4(spark, sf):
    r = views.readings(spark, sf)
    carriers = r.groupBy("parameter").agg(F.count_distinct("station_id").alias("n_carriers"))
    return coverage.cadence(r, ["parameter"]).join(carriers, "parameter")


@query("v5_standard_parameters", "SELECT parameter, n_carriers FROM standard")
def v5(spark, sf):
    return coverage.standard_parameters(views.readings(spark, sf).select(*SERIES).distinct())


@query("v6_parameter_domain", "SELECT * FROM pdomain")
def v6(spark, sf):
    return coverage.parameter_domain(views.readings(spark, sf))


@query("v7_structural_absence", "SELECT * FROM structural")
def v7(spark, sf):
    c = cov(spark, sf)
    return coverage.structural_absences(c.readings, c.series, c.n_rows)


@query(
    "v8_coverage_matrix",
    "SELECT station_id, "
    + ", ".join(f"count(value) FILTER (parameter = '{p}') AS \"{p}\"" for p in views.PARAMETERS)
    + " FROM rd GROUP BY station_id",
)
def v8(spark, sf):
    return coverage.coverage_matrix(views.readings(spark, sf), views.PARAMETERS)


O.cte(
    totals="""SELECT (SELECT sum(n_observed)::BIGINT FROM series) AS n_observed_cells, (SELECT count(*) FROM absent) AS n_absent_cells,
  (SELECT sum(n_expected)::BIGINT FROM series) AS n_covered_cells, (SELECT coalesce(sum(excluded_cells), 0)::BIGINT FROM structural) AS n_excluded_cells"""
)


@query("v9_cell_totals", "SELECT *, n_covered_cells + n_excluded_cells AS n_expected_cells FROM totals")
def v9(spark, sf):
    c = cov(spark, sf)
    return coverage.totals(c, coverage.structural_absences(c.readings, c.series, c.n_rows))


# --- runs --------------------------------------------------------------------------------------
@query(
    "u1_equal_value_runs",
    """SELECT station_id, parameter, min(timestamp_utc) AS start_utc, max(timestamp_utc) AS end_utc, count(*) AS run_length FROM (
  SELECT *, sum(CASE WHEN value = p THEN 0 ELSE 1 END) OVER (PARTITION BY station_id, parameter ORDER BY timestamp_utc, ingest_seq) AS run FROM (
  SELECT *, lag(value) OVER (PARTITION BY station_id, parameter ORDER BY timestamp_utc, ingest_seq) AS p FROM rd)) GROUP BY station_id, parameter, run""",
)
def u1(spark, sf):
    out = runs.equal_value_runs(views.readings(spark, sf), SERIES, "value")
    return out.select(*SERIES, "start_utc", "end_utc", "run_length")


@query(
    "u2_consecutive_runs",
    """SELECT station_id, parameter, min(timestamp_utc) AS start_utc, max(timestamp_utc) AS end_utc, count(*) AS n_cells FROM (
  SELECT *, sum(CASE WHEN s - p = cadence_s THEN 0 ELSE 1 END) OVER (PARTITION BY station_id, parameter ORDER BY s) AS run FROM (
  SELECT c.*, cadence_s, lag(s) OVER (PARTITION BY c.station_id, c.parameter ORDER BY s) AS p FROM cell c JOIN series USING (station_id, parameter)))
  GROUP BY station_id, parameter, run""",
)
def u2(spark, sf):
    c = cov(spark, sf)
    pts = runs.with_cadence(c.readings.select(*CELL).distinct(), c.series)
    return runs.consecutive_runs(pts, SERIES).drop("_run")


@query("u3_fault_episodes", "SELECT * FROM episode")
def u3(spark, sf):
    c = cov(spark, sf)
    return runs.episodes(cut(detectors.run_all(c, **RULES)), c.series)


@query(
    "u4_steps_and_durations",
    f"""SELECT station_id, parameter, greatest(1, ceil(21600.0 / cadence_s))::BIGINT AS steps, {O.humanise('(s1 - s0)')} AS span FROM series""",
)
def u4(spark, sf):
    return cov(spark, sf).series.select(
        *SERIES,
        steps_for_hours(6, F.col("cadence_s")).alias("steps"),
        humanise(secs("end") - secs("start")).alias("span"),
    )


# --- detectors ---------------------------------------------------------------------------------
@query("d1_row_absent", "SELECT * FROM r01")
def d1(spark, sf):
    return shown(detectors.row_absent(cov(spark, sf)))


@query(
    "d2_communication_gap",
    f"SELECT station_id, parameter, timestamp_utc, missing_ticks, {O.humanise('duration_s')} AS duration, strftime(gap_end, '%Y-%m-%dT%H:%M:%S') AS gap_end FROM r02",
)
def d2(spark, sf):
    return shown(
        detectors.communication_gaps(cov(spark, sf)),
        missing_ticks=ev("missing_ticks", "bigint"),
        duration=ev("duration"),
        gap_end=ev("gap_end"),
    )


@query("d3_duplicate_timestamp", "SELECT * FROM r03")
def d3(spark, sf):
    d = detectors.duplicate_timestamps(views.readings(spark, sf))
    return shown(d, n_readings=ev("n_readings", "bigint"))


@query(
    "d3_duplicate_values",
    "SELECT r.station_id, r.parameter, r.timestamp_utc, round(r.value, 6) AS value, r.ingest_seq, r03.n_readings FROM rd r JOIN r03 USING (station_id, parameter, timestamp_utc)",
)
def d3v(spark, sf):
    return detectors.duplicate_values(views.readings(spark, sf)).withColumn("value", F.round("value", 6))


@query("d4_out_of_order", "SELECT station_id, parameter, timestamp_utc, strftime(previous_max, '%Y-%m-%dT%H:%M:%S') AS previous_max FROM r04")
def d4(spark, sf):
    return shown(detectors.out_of_order(views.readings(spark, sf)), previous_max=ev("previous_max"))


@query("d6_above_max", "SELECT station_id, parameter, timestamp_utc, round(value, 6) AS value, limit_value::DOUBLE AS limit_value, unit FROM r07")
def d6(spark, sf):
    d = detectors.row_flags(cov(spark, sf), ("R07",))
    return shown(d, value=F.round(ev("value", "double"), 6), limit_value=ev("limit", "double"), unit=ev("unit"))


@query("d7_below_min", "SELECT station_id, parameter, timestamp_utc, round(value, 6) AS value, limit_value::DOUBLE AS limit_value, unit FROM r08")
def d7(spark, sf):
    d = detectors.row_flags(cov(spark, sf), ("R08",))
    return shown(d, value=F.round(ev("value", "double"), 6), limit_value=ev("limit", "double"), unit=ev("unit"))


@query("d8_cross_parameter", "SELECT station_id, parameter, timestamp_utc, round(pm25, 6) AS pm25, round(pm10, 6) AS pm10, excess FROM r09")
def d8(spark, sf):
    d = detectors.cross_parameter(views.readings(spark, sf))
    return shown(
        d,
        pm25=F.round(ev("pm25", "double"), 6),
        pm10=F.round(ev("pm10", "double"), 6),
        excess=ev("excess", "double"),
    )


@query("d9_unit_inconsistent", "SELECT * FROM r10")
def d9(spark, sf):
    d = detectors.row_flags(cov(spark, sf), ("R10",), unit_rules=views.UNIT_RULES)
    return shown(d, observed_median=ev("observed_median", "double"))


@query("d10_detection_floor", "SELECT station_id, parameter, timestamp_utc, run_length FROM r11")
def d10(spark, sf):
    return shown(detectors.detection_floor(cov(spark, sf)), run_length=ev("run_length", "bigint"))


@query(
    "d11_zero_variance",
    f"SELECT station_id, parameter, timestamp_utc, frozen_value, n_frozen AS n_readings, {O.humanise('duration_s')} AS duration FROM r12",
)
def d11(spark, sf):
    d = detectors.row_flags(cov(spark, sf), ("R12",))
    return shown(
        d,
        frozen_value=ev("frozen_value", "double"),
        n_readings=ev("n_readings", "bigint"),
        duration=ev("duration"),
    )


@query("d12_low_variance", "SELECT * FROM r13")
def d12(spark, sf):
    d = detectors.row_flags(cov(spark, sf), ("R13",))
    return shown(d, sensor_std=ev("sensor_std", "double"), peer_median_std=ev("peer_median_std", "double"))


@query(
    "d13_step_change",
    "SELECT station_id, parameter, timestamp_utc, shift AS signed_magnitude, abs(shift) AS magnitude, level_before, level_after, unit FROM r14",
)
def d13(spark, sf):
    d = detectors.step_change(cov(spark, sf))
    return shown(
        d,
        **{
            n: ev(n, "double")
            for n in ("signed_magnitude", "magnitude", "level_before", "level_after")
        },
        unit=ev("unit"),
    )


@query("d14_structural", "SELECT station_id, parameter, timestamp_utc, reason_code, domain, excluded_cells FROM r18")
def d14(spark, sf):
    c = cov(spark, sf)
    return shown(
        detectors.structural(c),
        reason_code=F.col("reason_code"),
        domain=ev("domain"),
        excluded_cells=ev("excluded_cells", "bigint"),
    )


@query("d15_sensor_dead", "SELECT station_id, parameter, timestamp_utc, silent_hours FROM r21")
def d15(spark, sf):
    return shown(detectors.dead_sensors(cov(spark, sf).series), silent_hours=ev("silent_hours", "bigint"))


@query("d16_all_detectors", "SELECT station_id, parameter, timestamp_utc, reason_code, severity, round(rank_value, 4) AS rank_value FROM defect")
def d16(spark, sf):
    return defects(spark, sf).select(
        *CELL, "reason_code", "severity", F.round("rank_value", 4).alias("rank_value")
    )


#: Section of the audit -> the query whose twin gives its rows, or a shared expression.
SECTIONS = {
    "series": "series", "defects": "defect", "defect_rate": "a1_defect_rate", "coverage": "a4_coverage_summary", "breakdowns": "a2_a3_breakdowns",
    "structural_absences": "structural", "notable_events": "notable", "network_wide": "a5_network_wide",
}


# --- audit -------------------------------------------------------------------------------------
@query("a1_defect_rate", "SELECT * FROM rate")
def a1(spark, sf):
    c = cov(spark, sf)
    return audit.defect_rate(detectors.run_all(c, **RULES), c.series)


@query(
    "a1_defect_rate_by_station",
    """SELECT station_id, m AS n_covered_cells, coalesce(n, 0) AS n_defective_cells, round(coalesce(n, 0) / m, 6) AS defect_rate
  FROM (SELECT station_id, sum(n_expected)::BIGINT AS m FROM series GROUP BY station_id)
  LEFT JOIN (SELECT station_id, count(*) AS n FROM badcell GROUP BY station_id) USING (station_id)""",
)
def a1s(spark, sf):
    c = cov(spark, sf)
    return audit.defect_rate_by_station(detectors.run_all(c, **RULES), c.series)


@query(
    "a2_a3_breakdowns",
    """SELECT 'code' AS dimension, reason_code AS key, count(*) AS n_flags FROM defect GROUP BY ALL
  UNION ALL SELECT 'station', station_id, count(*) FROM counting GROUP BY ALL
  UNION ALL SELECT 'parameter', parameter, count(*) FROM counting GROUP BY ALL
  UNION ALL SELECT 'day', strftime(timestamp_utc, '%Y-%m-%d'), count(*) FROM counting GROUP BY ALL""",
)
def a2(spark, sf):
    return audit.breakdowns(defects(spark, sf))


@query(
    "a4_coverage_summary",
    """SELECT count(DISTINCT station_id) AS n_stations, count(DISTINCT parameter) AS n_parameters, count(*) AS n_covered_pairs,
  min("start") AS window_start, max("end") AS window_end, any_value(t.n_observed_cells) AS n_observed_cells, any_value(t.n_absent_cells) AS n_absent_cells,
  any_value(t.n_covered_cells) AS n_covered_cells, any_value(t.n_excluded_cells) AS n_excluded_cells,
  any_value(t.n_covered_cells + t.n_excluded_cells) AS n_expected_cells,
  round(100.0 * sum(n_values) / sum(n_rows), 4) AS conventional_completeness_pct,
  round(100.0 * any_value(t.n_observed_cells) / any_value(t.n_covered_cells), 4) AS grid_completeness_pct FROM series, totals t""",
)
def a4(spark, sf):
    c = cov(spark, sf)
    return audit.coverage_summary(c, coverage.structural_absences(c.readings, c.series, c.n_rows))


@query(
    "a5_network_wide",
    """SELECT reason_code, parameter, station_count, flagged_readings, total_readings, round(flagged_readings / total_readings, 6) AS fraction FROM (
  SELECT reason_code, f.parameter, count(*) AS flagged_readings, count(DISTINCT f.station_id) AS station_count, count(*) FILTER (p.s IS NULL) AS gone
  FROM (SELECT DISTINCT reason_code, station_id, parameter, timestamp_utc FROM counting) f
  LEFT JOIN (SELECT * FROM cell WHERE n_values > 0) p ON p.station_id = f.station_id AND p.parameter = f.parameter AND p.timestamp_utc = f.timestamp_utc GROUP BY ALL)
  JOIN (SELECT parameter, count(*) AS carriers, sum(n_values)::BIGINT AS total_readings FROM series GROUP BY parameter) USING (parameter)
  WHERE gone = 0 AND station_count = carriers AND flagged_readings / total_readings >= 0.1""",
)
def a5(spark, sf):
    # the planted faults are local, so the report threshold is lowered to get rows
    c = cov(spark, sf)
    return audit.network_wide(detectors.run_all(c, **RULES), c, 0.1)


@query(
    "a6_notable_events",
    "SELECT rank, category, reason_code, station_id, parameter, timestamp_utc, severity, round(rank_value, 4) AS rank_value FROM notable",
)
def a6(spark, sf):
    return audit.notable_events(defects(spark, sf)).select(
        "rank", "category", "reason_code", *CELL, "severity", F.round("rank_value", 4).alias("rank_value")
    )


@query(
    "a7_defect_records",
    "SELECT station_id, parameter, strftime(timestamp_utc, '%Y-%m-%dT%H:%M:%S') AS timestamp_utc, reason_code, severity FROM defect",
)
def a7(spark, sf):
    return audit.defect_records(defects(spark, sf)).drop("evidence")


@query("a8_full_audit")
def a8(spark, sf):
    out = audit.run_audit(views.readings(spark, sf), **RULES)
    n = lambda name: out[name].agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("section"), "n_rows")
    return detectors.union_all([n(k) for k in out])


# the query of network-wide faults asks for a tenth of the readings, the audit for the default share
_SECTION_SQL = {k: (ORACLE.get(q) or O.sql(f"SELECT * FROM {q}")).replace(">= 0.1", f">= {C.NETWORK_WIDE_FRACTION}") for k, q in SECTIONS.items()}
ORACLE["a8_full_audit"] = " UNION ALL ".join(f"SELECT '{k}' AS section, count(*) AS n_rows FROM ({text})" for k, text in _SECTION_SQL.items())


@query(
    "a9_run_meta",
    "SELECT '0.1.0' AS code_version, 'cfg00000' AS config_hash, checksum AS data_checksum, n_rows, 'ar_' || checksum || '_cfg00000' AS audit_run_id FROM digest",
)
def a9(spark, sf):
    return audit.run_meta(canonical.add_row_hash(views.readings(spark, sf)), "cfg00000")

"""The same views and operators in DuckDB SQL, as named common table expressions.

`sql(query)` prepends the expressions a query refers to, directly or through others.
"""

from __future__ import annotations

import re

CTE: dict[str, str] = {}


def cte(**items: str) -> None:
    CTE.update(items)


def sql(query: str) -> str:
    done: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in re.findall(r"(?:FROM|JOIN|,)\s*\(?\s*([a-z_][a-z0-9_]*)\b", text):
            if name in CTE and name not in seen:
                seen.add(name)
                visit(CTE[name])
                done.append(name)

    visit(query)
    if not done:
        return query
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n]})" for n in done) + "\n" + query


def case(expr: str, mapping: dict, default: str = "NULL") -> str:
    q = lambda v: f"'{v}'" if isinstance(v, str) else repr(v)
    arms = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in mapping.items())
    return f"(CASE {expr} {arms} ELSE {default} END)"


cte(
    v_base="""SELECT event_id, i, e, v, t, CASE WHEN i = 2 AND e = 'purchase' THEN 1 WHEN i = 3 AND e IN ('signup', 'error') THEN 1
  WHEN i = 4 AND e = 'error' AND t >= TIMESTAMP '2024-01-20 00:00:00' THEN 0 ELSE g0 END AS g
  FROM (SELECT event_id, user_id % 10 AS i, floor(user_id / 10) % 2 AS g0, event_type AS e, value AS v,
  time_bucket(INTERVAL '6 hours', CASE WHEN event_id % 97 = 0 THEN ts - INTERVAL '12 hours' ELSE ts END) AS t FROM events)""",
    v_named="""SELECT *, CASE WHEN e = 'view' AND g = 0 THEN 'PM10' WHEN e = 'view' THEN 'CO2'
  WHEN e = 'click' AND g = 0 THEN 'PM2.5' WHEN e = 'click' THEN 'O3'
  WHEN e = 'purchase' AND g = 0 THEN 'NO' WHEN e = 'purchase' THEN 'NO2'
  WHEN e = 'signup' AND g = 0 THEN 'Wind_Direction' WHEN e = 'signup' THEN 'Humidity'
  WHEN g = 0 THEN 'Wind_Speed' ELSE 'Pressure' END AS parameter FROM v_base""",
    rd="""SELECT 'STA-' || lpad(CAST(i + 1 AS VARCHAR), 2, '0') AS station_id, parameter, t AS timestamp_utc,
  CASE parameter
    WHEN 'PM10' THEN CASE WHEN i = 3 THEN 30 + v * 0.001 ELSE v * 10 END
    WHEN 'CO2' THEN 400 + v * 5
    WHEN 'PM2.5' THEN CASE WHEN event_id % 53 = 0 THEN -1.0 ELSE v * 2 END
    WHEN 'O3' THEN CASE WHEN i = 1 AND t >= TIMESTAMP '2024-01-16 00:00:00' THEN v + 150 ELSE v END
    WHEN 'NO' THEN CASE WHEN v < 10 THEN 0.7 ELSE v / 5 END
    WHEN 'NO2' THEN CASE WHEN i = 0 THEN 5.0 ELSE v END
    WHEN 'Wind_Direction' THEN (v * 7) % 360
    WHEN 'Wind_Speed' THEN v / 10
    WHEN 'Humidity' THEN CASE WHEN event_id % 41 = 0 THEN NULL ELSE v / 3 END
    ELSE 1000 + v / 10 END::DOUBLE AS value,
  CASE parameter WHEN 'CO2' THEN CASE WHEN i = 1 THEN 'ug/m3' ELSE 'ppm' END WHEN 'Wind_Direction' THEN 'degrees'
    WHEN 'Wind_Speed' THEN 'm/s' WHEN 'Humidity' THEN 'percent' WHEN 'Pressure' THEN 'mbar' ELSE 'ug/m3' END AS unit,
  CAST(NULL AS VARCHAR) AS instrument_id,
  'STA-' || lpad(CAST(i + 1 AS VARCHAR), 2, '0') ||
    CASE WHEN parameter IN ('Wind_Direction','Wind_Speed') THEN '_soil.csv' ELSE '_air.csv' END AS source_file,
  event_id AS ingest_seq, epoch_us(t) // 1000000 AS s
FROM v_named""",
    cell="""SELECT station_id, parameter, timestamp_utc, s, count(*) AS n_readings, count(value) AS n_values
  FROM rd GROUP BY ALL""",
    gp="""SELECT * FROM (SELECT station_id, parameter, s, lag(s) OVER (PARTITION BY station_id, parameter ORDER BY s) AS p FROM cell) WHERE p IS NOT NULL""",
    cad0="""SELECT station_id, parameter, gap FROM (SELECT station_id, parameter, s - p AS gap,
  row_number() OVER (PARTITION BY station_id, parameter ORDER BY count(*) DESC, s - p) AS rn FROM gp GROUP BY station_id, parameter, s - p) WHERE rn = 1""",
    series="""SELECT r.station_id, r.parameter, min(timestamp_utc) AS "start", max(timestamp_utc) AS "end", min(s) AS s0, max(s) AS s1,
  count(*) AS n_rows, count(value) AS n_values, min(value) AS v_min, max(value) AS v_max,
  CASE WHEN count(value) < 2 OR min(value) = max(value) THEN 0 ELSE stddev_pop(value) END AS v_std,
  arg_min(unit, ingest_seq + s * 1000000000) AS unit, count(DISTINCT s) AS n_observed,
  coalesce(any_value(c.gap), 3600) AS cadence_s,
  (max(s) - min(s)) // coalesce(any_value(c.gap), 3600) + 1 AS n_expected
  FROM rd r LEFT JOIN cad0 c USING (station_id, parameter) GROUP BY r.station_id, r.parameter""",
    grid="""SELECT station_id, parameter, cadence_s, s0 + k * cadence_s AS s FROM series, range(n_expected) AS t(k)""",
    absent="""SELECT g.station_id, g.parameter, g.cadence_s, g.s, make_timestamp(g.s * 1000000) AS timestamp_utc
  FROM grid g ANTI JOIN cell USING (station_id, parameter, s)""",
    netcad="""SELECT parameter, gap AS cadence_s FROM (SELECT parameter, s - p AS gap,
  row_number() OVER (PARTITION BY parameter ORDER BY count(*) DESC, s - p) AS rn
  FROM (SELECT parameter, s, lag(s) OVER (PARTITION BY parameter ORDER BY s) AS p FROM (SELECT DISTINCT parameter, s FROM cell))
  WHERE p IS NOT NULL GROUP BY parameter, s - p) WHERE rn = 1""",
    standard="""SELECT parameter, count(DISTINCT station_id) AS n_carriers FROM series GROUP BY parameter
  HAVING count(DISTINCT station_id) >= (SELECT ceil(0.5 * count(DISTINCT station_id)) FROM series)""",
    pdomain="""SELECT parameter, CASE WHEN f LIKE '%Levego%' THEN 'air' WHEN f LIKE '%Felszin_alatti_viz%' THEN 'groundwater' WHEN f LIKE '%Zaj%' THEN 'noise'
  WHEN f LIKE '%groundwater%' THEN 'groundwater' WHEN f LIKE '%water%' THEN 'water' WHEN f LIKE '%air%' THEN 'air' WHEN f LIKE '%noise%' THEN 'noise'
  WHEN f LIKE '%soil%' THEN 'soil' ELSE 'unknown' END AS domain
  FROM (SELECT parameter, first(source_file ORDER BY station_id, timestamp_utc, ingest_seq) AS f FROM rd GROUP BY parameter)""",
    missing="""SELECT st.station_id, p.parameter, d.domain,
    ((SELECT max(s1) FROM series) - (SELECT min(s0) FROM series)) // n.cadence_s + 1 AS excluded_cells
  FROM (SELECT DISTINCT station_id FROM series) st CROSS JOIN standard p JOIN pdomain d USING (parameter) JOIN netcad n USING (parameter)
  ANTI JOIN series x ON x.station_id = st.station_id AND x.parameter = p.parameter""",
    structural="""SELECT m.station_id, m.parameter, m.domain, CASE WHEN l.n = z.n AND z.n > 1 THEN 'R19' ELSE 'R18' END AS reason_code, m.excluded_cells
  FROM missing m JOIN (SELECT station_id, domain, count(*) AS n FROM missing GROUP BY ALL) l USING (station_id, domain)
  JOIN (SELECT domain, count(*) AS n FROM standard JOIN pdomain USING (parameter) GROUP BY domain) z USING (domain)""",
    gaprun="""SELECT station_id, parameter, cadence_s, min(s) AS a, max(s) AS b, count(*) AS n FROM (
  SELECT *, sum(CASE WHEN s - p = cadence_s THEN 0 ELSE 1 END) OVER (PARTITION BY station_id, parameter ORDER BY s) AS run
  FROM (SELECT *, lag(s) OVER (PARTITION BY station_id, parameter ORDER BY s) AS p FROM absent)) GROUP BY station_id, parameter, cadence_s, run""",
    bnd="""SELECT * FROM (VALUES ('PM10',0,2000),('PM2.5',0,1000),('CO',0,100000),('NO2',0,1000),('NO',0,1000),('NOx',0,2000),('O3',0,1000),
  ('TVOC',0,20000),('CO2',300,10000),('Humidity',0,100),('Pressure',870,1085),('Wind_Speed',0,200),('Wind_Direction',0,360)) t(parameter, lo, hi)""",
    r01="SELECT station_id, parameter, timestamp_utc FROM absent",
    r02="""SELECT station_id, parameter, make_timestamp(a * 1000000) AS timestamp_utc, n AS missing_ticks, n * cadence_s AS duration_s,
  make_timestamp(b * 1000000) AS gap_end FROM gaprun WHERE n >= greatest(1, ceil(21600.0 / cadence_s))""",
    r03="SELECT station_id, parameter, timestamp_utc, n_readings FROM cell WHERE n_readings > 1",
    r04="""SELECT station_id, parameter, timestamp_utc, m AS previous_max FROM (SELECT *, max(timestamp_utc) OVER (PARTITION BY station_id, parameter
  ORDER BY ingest_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM rd) WHERE timestamp_utc < m""",
    r07="SELECT station_id, parameter, timestamp_utc, value, hi AS limit_value, unit FROM rd JOIN bnd USING (parameter) WHERE value > hi",
    r08="SELECT station_id, parameter, timestamp_utc, value, lo AS limit_value, unit FROM rd JOIN bnd USING (parameter) WHERE value < lo",
    r09="""SELECT station_id, 'PM2.5' AS parameter, timestamp_utc, f AS pm25, c AS pm10, round(f - c, 4) AS excess FROM (
  SELECT station_id, timestamp_utc, arg_min(value, ingest_seq) FILTER (parameter = 'PM2.5' AND value IS NOT NULL) AS f,
  arg_min(value, ingest_seq) FILTER (parameter = 'PM10' AND value IS NOT NULL) AS c FROM rd GROUP BY ALL) WHERE f > c""",
    badunit="""SELECT station_id, parameter, round(median(value), 3) AS observed_median FROM rd WHERE parameter = 'CO2' GROUP BY ALL
  HAVING bool_or(unit = 'ug/m3') AND median(value) BETWEEN 300 AND 10000""",
    r10="SELECT station_id, parameter, timestamp_utc, observed_median FROM rd JOIN badunit USING (station_id, parameter)",
    floorrun="""SELECT station_id, parameter, timestamp_utc, f, sum(CASE WHEN f = pf THEN 0 ELSE 1 END) OVER (PARTITION BY station_id ORDER BY timestamp_utc, ingest_seq) AS run
  FROM (SELECT *, lag(f) OVER (PARTITION BY station_id ORDER BY timestamp_utc, ingest_seq) AS pf
  FROM (SELECT *, coalesce(abs(value - 0.7) <= 1e-9 + 1e-5 * 0.7, false) AS f FROM rd WHERE parameter = 'NO'))""",
    r11="""SELECT station_id, parameter, timestamp_utc, run_length FROM (SELECT *, count(*) OVER (PARTITION BY station_id, run) AS run_length FROM floorrun)
  JOIN series USING (station_id, parameter) WHERE f AND run_length >= greatest(1, ceil(21600.0 / cadence_s))""",
    r12="""SELECT station_id, parameter, timestamp_utc, v_min AS frozen_value, n_values AS n_frozen, s1 - s0 + cadence_s AS duration_s
  FROM rd JOIN series USING (station_id, parameter) WHERE series.n_values >= 2 AND v_min = v_max""",
    lowvar="""SELECT station_id, parameter, v_std, m FROM series JOIN (SELECT parameter, median(v_std) AS m FROM series WHERE v_std > 0 GROUP BY parameter HAVING count(*) >= 3)
  USING (parameter) WHERE v_std > 0 AND v_std < 0.1 * m""",
    r13="""SELECT station_id, parameter, timestamp_utc, round(v_std, 5) AS sensor_std, round(m, 5) AS peer_median_std FROM rd JOIN lowvar USING (station_id, parameter)""",
    scope="""SELECT station_id, parameter, timestamp_utc, ingest_seq, value FROM rd JOIN bnd USING (parameter)
  WHERE value IS NOT NULL AND value >= lo AND value <= hi AND NOT (parameter = 'NO' AND abs(value - 0.7) <= 1e-9 + 1e-5 * 0.7)""",
    zed="""SELECT *, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS z, count(*) OVER w AS n, sum(value) OVER w AS tot, avg(value) OVER w AS mu,
  row_number() OVER (PARTITION BY station_id, parameter ORDER BY timestamp_utc, ingest_seq) AS i FROM scope
  JOIN (SELECT station_id, parameter FROM scope GROUP BY ALL HAVING count(*) >= 24 AND min(value) < max(value)) USING (station_id, parameter)
  WINDOW w AS (PARTITION BY station_id, parameter)""",
    prefix="""SELECT *, sum(z - 0.5) OVER w AS up, sum(-z - 0.5) OVER w AS dn, sum(value) OVER w - value AS ph FROM zed
  WINDOW w AS (PARTITION BY station_id, parameter ORDER BY i ROWS UNBOUNDED PRECEDING)""",
    cus="""SELECT *, greatest(up - least(0, min(up) OVER w), dn - least(0, min(dn) OVER w)) AS c,
  ph / nullif(i - 1, 0) AS bef, (tot - ph) / (n - i + 1) AS aft FROM prefix
  WINDOW w AS (PARTITION BY station_id, parameter ORDER BY i ROWS UNBOUNDED PRECEDING)""",
    r14="""SELECT station_id, parameter, timestamp_utc, round(aft - bef, 4) AS shift, round(bef, 4) AS level_before, round(aft, 4) AS level_after, unit FROM (
  SELECT *, row_number() OVER (PARTITION BY station_id, parameter ORDER BY round(abs(aft - bef), 9) DESC, i) AS rk FROM cus WHERE i > 1)
  JOIN series USING (station_id, parameter) WHERE rk = 1
  AND (station_id, parameter) IN (SELECT (station_id, parameter) FROM cus GROUP BY ALL HAVING max(c) > 5)""",
    r18="SELECT station_id, parameter, (SELECT min(timestamp_utc) FROM rd) AS timestamp_utc, reason_code, domain, excluded_cells FROM structural",
    r21="""SELECT station_id, parameter, "end" AS timestamp_utc, (m - s1) // 3600 AS silent_hours FROM series, (SELECT max(s1) AS m FROM series) WHERE m - s1 >= 72 * 3600""",
    defect="""SELECT station_id, parameter, timestamp_utc, 'R01' AS reason_code, 'low' AS severity, NULL::DOUBLE AS rank_value FROM r01
  UNION ALL SELECT station_id, parameter, timestamp_utc, 'R02', 'high', missing_ticks FROM r02
  UNION ALL SELECT station_id, parameter, timestamp_utc, 'R03', 'medium', NULL FROM r03
  UNION ALL SELECT station_id, parameter, timestamp_utc, 'R04', 'medium', NULL FROM r04
  UNION ALL SELECT station_id, parameter, timestamp_utc, 'R07', 'critical', value FROM r07
  UNION ALL SELECT station_id, parameter, timestamp_utc, 'R08', 'high', NULL FROM r08
  UNION ALL SELECT station_id, parameter, timestamp_utc, 'R09', 'critical', excess FROM r09
  UNION ALL SELECT station_id, parameter, timestamp_utc, 'R10', 'high', NULL FROM r10
  UNION ALL SELECT station_id, parameter, timestamp_utc, 'R11', 'medium', NULL FROM r11
  UNION ALL SELECT station_id, parameter, timestamp_utc, 'R12', 'high', n_frozen FROM r12
  UNION ALL SELECT station_id, parameter, timestamp_utc, 'R13', 'medium', NULL FROM r13
  UNION ALL SELECT station_id, parameter, timestamp_utc, 'R14', 'medium', abs(shift) FROM r14
  UNION ALL SELECT station_id, parameter, timestamp_utc, reason_code, 'info', NULL FROM r18
  UNION ALL SELECT station_id, parameter, timestamp_utc, 'R21', 'critical', silent_hours FROM r21""",
    counting="SELECT * FROM defect WHERE reason_code NOT IN ('R18', 'R19')",
    badcell="SELECT DISTINCT station_id, parameter, timestamp_utc FROM counting",
    rate="""SELECT n AS n_defective_cells, m AS n_covered_cells, round(n / m, 6) AS defect_rate
  FROM (SELECT count(*) AS n FROM badcell), (SELECT sum(n_expected)::BIGINT AS m FROM series)""",
    episode="""SELECT station_id, parameter, reason_code, severity, min(timestamp_utc) AS start_utc, max(timestamp_utc) AS end_utc, count(*) AS n_cells FROM (
  SELECT *, sum(CASE WHEN s - p = cadence_s THEN 0 ELSE 1 END) OVER (PARTITION BY station_id, parameter, reason_code ORDER BY s) AS run FROM (
  SELECT d.*, epoch_us(timestamp_utc) // 1000000 AS s, lag(epoch_us(timestamp_utc) // 1000000) OVER (PARTITION BY station_id, parameter, reason_code ORDER BY timestamp_utc) AS p,
  coalesce(cadence_s, 3600) AS cadence_s FROM (SELECT DISTINCT station_id, parameter, timestamp_utc, reason_code, severity FROM defect) d LEFT JOIN series USING (station_id, parameter)))
  GROUP BY station_id, parameter, reason_code, severity, run""",
    notable="""SELECT row_number() OVER (ORDER BY prio, rank_value DESC, station_id, parameter, timestamp_utc) AS rank, * FROM (
  SELECT *, row_number() OVER (PARTITION BY reason_code, station_id, parameter, timestamp_utc ORDER BY rn) AS dup FROM (
  SELECT d.*, c.category, c.prio, c.k, row_number() OVER (PARTITION BY reason_code ORDER BY rank_value DESC, station_id, parameter, timestamp_utc) AS rn
  FROM defect d JOIN (VALUES ('R07','physical_exceedance',0,5),('R09','cross_parameter',1,5),('R02','communication_outage',2,5),('R12','frozen_sensor',3,5),
  ('R14','step_change',4,5),('R21','dead_sensor',5,3)) c(reason_code, category, prio, k) USING (reason_code)) WHERE rn <= k) WHERE dup = 1""",
)

HUMAN = """CASE WHEN {x} // 3600 < 24 THEN CAST({x} // 3600 AS VARCHAR) || 'h'
  WHEN ({x} // 3600) % 24 = 0 THEN CAST({x} // 86400 AS VARCHAR) || 'd'
  ELSE CAST({x} // 86400 AS VARCHAR) || 'd ' || CAST(({x} // 3600) % 24 AS VARCHAR) || 'h' END"""


def humanise(x: str) -> str:
    return HUMAN.format(x=x)

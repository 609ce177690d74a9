"""DuckDB SQL for the telemetry queries, written on its own from the definitions, with whole-station windows.

Nothing is imported from the engine: every threshold, name and text is written out here again, so that a
wrong constant there shows.
"""

from __future__ import annotations

CHANNELS = ("temperature", "pressure", "humidity", "wind_speed")
BOUNDS = {"temperature": (-50.0, 60.0), "pressure": (800.0, 1100.0), "humidity": (0.0, 100.0), "wind_speed": (0.0, None)}
BANDED = ("humidity", "wind_speed")
PHYSICS_COUNTS = {
    "T-P-RH Thermodynamic Violations": "flag_t_p_rh_physics_violation", "Dew Point > Dry Bulb Temperature": "flag_dew_point_exceeds_temp", "Relative Humidity Out of Bounds": "flag_rh_out_of_bounds",
    "Vapor Pressure > Atmospheric": "flag_vapor_exceeds_pressure", "Negative Wind Speed": "flag_wind_negative", "Wind Speed Exceeds Typical Range": "flag_wind_exceeds_typical",
    "Temperature Climatological Breach": "flag_temp_out_of_bounds", "Pressure Climatological Breach": "flag_pressure_out_of_bounds",
}
STATISTICAL_COUNTS = {"Rate-of-Change Spikes": "spike", "Rolling Z-Score Outliers": "zscore_outlier", "IQR Boxplot Outliers": "iqr_outlier", "Stuck / Frozen Sensor Readings": "stuck", "Missing / Sentinel Readings": "missing"}
STEP = {"temperature": 5, "pressure": 4, "humidity": 25, "wind_speed": 15}
FLAGS = ("flag_rh_out_of_bounds", "flag_dew_point_exceeds_temp", "flag_vapor_exceeds_pressure", "flag_ah_unphysical", "flag_temp_out_of_bounds", "flag_pressure_out_of_bounds",
    "flag_t_p_rh_physics_violation", "flag_wind_negative", "flag_wind_exceeds_typical", "flag_wind_exceeds_extreme", "flag_wind_physics_violation")
KINDS = ("missing", "iqr_outlier", "zscore_outlier", "spike", "stuck", "stat_anomaly")
ALL = ", ".join(CHANNELS)


def near(x: str, digits: int = 2) -> str:
    """x rounded, ties to even."""
    return f"(round_even(({x}) * {10**digits}::DOUBLE, 0) / {10**digits}::DOUBLE + 0.0::DOUBLE)"


def digits(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN printf('%.9e', {x})::DOUBLE END"


def each(template: str, sep: str = ", ", items=CHANNELS) -> str:  # noqa: ANN001
    return sep.join(template.replace("{c}", c).replace("{step}", str(STEP.get(c, ""))) for c in items)


R = """
e AS (SELECT event_id, ts, CAST(user_id % 4 AS INT) AS station_id, event_type, CAST(json_extract(props, '$.k') AS INT) AS k,
  (hour(ts) + minute(ts) / 60.0)::DOUBLE AS h, day(ts) AS d FROM events),
c AS (SELECT *, round(22.0 + 8.0 * cos((h - 14.0) * 2.0 * pi() / 24.0) + (k - 50) * 0.02::DOUBLE, 4) AS t0,
  round(1013.25 + 1.2 * sin(4.0 * pi() * (h - 9.0) / 24.0) + ((k * 7) % 100 - 50) * 0.01::DOUBLE, 4) AS p0,
  round(55.0 - 20.0 * cos((h - 14.0) * 2.0 * pi() / 24.0) + ((k * 13) % 100 - 50) * 0.04::DOUBLE, 4) AS r0,
  round(4.0 + 2.0 * greatest(0.0, sin((h - 8.0) * pi() / 12.0)) + ((k * 17) % 100) * 0.03::DOUBLE, 4) AS w0 FROM e),
r AS (SELECT station_id, event_id AS row_id, ts,
  (CASE WHEN event_type = 'error' AND k = 7 THEN -999.0 WHEN event_type = 'signup' AND k = 3 THEN NULL WHEN event_type = 'error' AND k = 11 THEN 78.5
    WHEN event_type = 'click' AND k = 13 THEN t0 + 14.0 WHEN d = 20 AND h < 6 THEN 18.0 ELSE t0 END)::DOUBLE AS temperature,
  (CASE WHEN event_type = 'view' AND k = 5 THEN NULL WHEN event_type = 'error' AND k = 17 THEN 720.0 WHEN event_type = 'click' AND k = 19 THEN p0 + 9.5 ELSE p0 END)::DOUBLE AS pressure,
  (CASE WHEN event_type = 'error' AND k = 23 THEN 118.5 WHEN event_type = 'error' AND k = 29 THEN -12.0 ELSE r0 END)::DOUBLE AS humidity,
  (CASE WHEN event_type = 'error' AND k = 31 THEN -4.5 WHEN event_type = 'error' AND k = 37 THEN 108.0 ELSE w0 END)::DOUBLE AS wind_speed FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY ts, row_id) AS rn FROM r)"""
O = "PARTITION BY station_id ORDER BY rn"  # noqa: E741

P = R + """,
p1 AS (SELECT *, 6.112 * exp(17.67 * temperature / (temperature + 243.5)) AS es,
  17.67 * temperature / (243.5 + temperature) + CASE WHEN humidity IS NOT NULL THEN ln(least(greatest(humidity / 100.0, 0.0001), 1.5)) END AS gamma FROM n),
p2 AS (SELECT *, CASE WHEN humidity IS NOT NULL THEN es * greatest(humidity, 0.0) / 100.0 END AS e, 243.5 * gamma / (17.67 - gamma) AS td FROM p1),
p3 AS (SELECT *, 216.7 * e / (temperature + 273.15) AS ah FROM p2),
p4 AS (SELECT *, coalesce(humidity < 0 OR humidity > 102, FALSE) AS flag_rh_out_of_bounds, coalesce(td > temperature + 0.5, FALSE) AS flag_dew_point_exceeds_temp,
  coalesce(e >= pressure, FALSE) AS flag_vapor_exceeds_pressure, coalesce(ah < 0 OR ah > 60, FALSE) AS flag_ah_unphysical,
  coalesce(temperature < -50 OR temperature > 60, FALSE) AS flag_temp_out_of_bounds, coalesce(pressure < 800 OR pressure > 1090, FALSE) AS flag_pressure_out_of_bounds,
  coalesce(wind_speed < 0, FALSE) AS flag_wind_negative, coalesce(wind_speed > 50, FALSE) AS flag_wind_exceeds_typical, coalesce(wind_speed > 90, FALSE) AS flag_wind_exceeds_extreme FROM p3),
p AS (SELECT *, flag_rh_out_of_bounds OR flag_dew_point_exceeds_temp OR flag_vapor_exceeds_pressure OR flag_ah_unphysical OR flag_temp_out_of_bounds OR flag_pressure_out_of_bounds AS flag_t_p_rh_physics_violation,
  flag_wind_negative OR flag_wind_exceeds_extreme AS flag_wind_physics_violation FROM p4)"""

CENTRE = f"({O} ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING)"


def stat(base: str, robust: bool = True) -> str:
    """CTEs that end in s: all rows of p (or n) with the statistical flags."""
    last = {c: (23, 24) if c == "wind_speed" else (11, 12) for c in CHANNELS}
    middle = lambda x: f"CASE WHEN count({x}) OVER {CENTRE} >= 6 THEN median({x}) OVER {CENTRE} END"
    mean = lambda x: f"CASE WHEN count({x}) OVER {CENTRE} >= 6 THEN avg({x}) OVER {CENTRE} END"
    spread = lambda x: f"CASE WHEN count({x}) OVER {CENTRE} >= 6 THEN stddev_samp({x}) OVER {CENTRE} END"
    held = lambda c: f"CASE WHEN x_{c} > 0.1 THEN x_{c} END" if c == "wind_speed" else f"x_{c}"
    still = lambda c: f"({O} ROWS BETWEEN {last[c][0]} PRECEDING AND CURRENT ROW)"
    return f""",
s1 AS (SELECT *, {each("CASE WHEN {c} IS NULL OR isinf({c}) OR {c} IN (-999, -9999, 999, 9999, -99) THEN NULL ELSE {c} END AS x_{c}")} FROM {base}),
q AS (SELECT station_id AS qs, {each("quantile_cont(x_{c}, 0.25) AS q1_{c}, quantile_cont(x_{c}, 0.75) AS q3_{c}")} FROM s1 GROUP BY station_id),
s2 AS (SELECT s1.*, q.*, {", ".join(f"abs(x_{c} - ({middle(f'x_{c}') if robust else mean(f'x_{c}')})) AS dev_{c}" for c in CHANNELS)},
  {", ".join(f"abs(x_{c} - lag(x_{c}) OVER ({O})) AS back_{c}, abs(x_{c} - lead(x_{c}) OVER ({O})) AS forth_{c}" for c in CHANNELS)},
  {", ".join(f"coalesce(count({held(c)}) OVER {still(c)} = {last[c][1]} AND var_samp({held(c)}) OVER {still(c)} <= 1e-6, FALSE) AS still_{c}" for c in CHANNELS)}
  FROM s1 JOIN q ON station_id = qs),
s3 AS (SELECT *, {", ".join(f"{'1.4826 * (' + middle(f'dev_{c}') + ')' if robust else spread(f'x_{c}')} AS scale_{c}" for c in CHANNELS)} FROM s2),
s4 AS (SELECT *, {each("x_{c} IS NULL AS flag_{c}_missing, coalesce(x_{c} < q1_{c} - 2.0 * (q3_{c} - q1_{c}) OR x_{c} > q3_{c} + 2.0 * (q3_{c} - q1_{c}), FALSE) AS flag_{c}_iqr_outlier, coalesce(scale_{c} > 0 AND dev_{c} / nullif(scale_{c}, 0) > 3.5, FALSE) AS flag_{c}_zscore_outlier, coalesce((back_{c} > {step} AND forth_{c} > {step}) OR back_{c} > 1.75 * {step}, FALSE) AS flag_{c}_spike")},
  {", ".join(f"bool_or(still_{c}) OVER ({O} ROWS BETWEEN CURRENT ROW AND {last[c][0]} FOLLOWING) AS flag_{c}_stuck" for c in CHANNELS)} FROM s3),
s AS (SELECT *, {each("(flag_{c}_iqr_outlier OR flag_{c}_zscore_outlier OR flag_{c}_spike OR flag_{c}_stuck) AND NOT flag_{c}_missing AS flag_{c}_stat_anomaly")} FROM s4)"""


S = P + stat("p")
V = S + """,
v AS (SELECT *, NOT (flag_temperature_missing OR flag_temp_out_of_bounds OR flag_temperature_stat_anomaly) AS is_valid_temperature,
  NOT (flag_pressure_missing OR flag_pressure_out_of_bounds OR flag_pressure_stat_anomaly) AS is_valid_pressure,
  NOT (flag_humidity_missing OR flag_rh_out_of_bounds OR flag_dew_point_exceeds_temp OR flag_vapor_exceeds_pressure OR flag_humidity_stat_anomaly) AS is_valid_humidity,
  NOT (flag_wind_speed_missing OR flag_wind_physics_violation OR flag_wind_speed_stat_anomaly) AS is_valid_wind_speed FROM s)"""


def fill(base: str, how: str) -> str:
    """CTEs that end in f: f_{channel}, of the valid values of v, filled."""
    between = "coalesce(v_{c} + (w_{c} - v_{c}) * ((rn - a_{c})::DOUBLE / nullif(b_{c} - a_{c}, 0)), v_{c}, w_{c})"
    rule = {"interpolate": f"CASE WHEN rn - a_{{c}} <= 6 OR b_{{c}} - rn <= 6 THEN {between} END", "ffill": "CASE WHEN rn - a_{c} <= 6 THEN v_{c} END", "bfill": "CASE WHEN b_{c} - rn <= 6 THEN w_{c} END",
        "forward": f"CASE WHEN rn - a_{{c}} <= 6 THEN {between} END"}[how]
    back, on = f"({O} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", f"({O} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return f""",
f1 AS (SELECT *, {each("CASE WHEN is_valid_{c} THEN {c} END AS g_{c}")} FROM {base}),
f2 AS (SELECT *, {each("last_value(g_{c} IGNORE NULLS) OVER " + back + " AS v_{c}, last_value(CASE WHEN g_{c} IS NOT NULL THEN rn END IGNORE NULLS) OVER " + back + " AS a_{c}, first_value(g_{c} IGNORE NULLS) OVER " + on + " AS w_{c}, first_value(CASE WHEN g_{c} IS NOT NULL THEN rn END IGNORE NULLS) OVER " + on + " AS b_{c}")} FROM f1),
f AS (SELECT *, {each("coalesce(g_{c}, " + rule + ") AS f_{c}")} FROM f2)"""


CLEANED = ", ".join(f"{near('CASE WHEN f_' + c + ' IS NOT NULL THEN greatest(f_' + c + ', 0.0) END' if c == 'wind_speed' else 'f_' + c)} AS {c}_cleaned" for c in CHANNELS)

#: The rules: order, severity, level, confidence, sensors and condition over p or s.
RULES = [
    ("THERMO_TD_EXCEEDS_T", "HIGH", "CRITICAL", 0.98, "temperature, humidity", "td > temperature + 0.5", "Emergency calibration required: Inspect hygrometer sensing element and aspirator fan",
        "Dew Point Exceeds Temperature", "printf('Thermodynamic violation: Calculated Dew Point (%.1f°C) exceeds Dry Bulb Temp (%.1f°C)', td, temperature)"),
    ("THERMO_VAPOR_EXCEEDS_PRESSURE", "HIGH", "CRITICAL", 0.99, "pressure, humidity", "e >= pressure", "Isolate barometer and RH sensor channels; check for sensor chamber flooding",
        "Vapor Pressure Exceeds Ambient Pressure", "printf('Thermodynamic violation: Water vapor pressure (%.1f hPa) exceeds ambient barometric pressure (%.1f hPa)', e, pressure)"),
    ("THERMO_RH_OUT_OF_BOUNDS", "HIGH", "CRITICAL", 0.97, "humidity", "temperature IS NOT NULL AND (humidity < 0 OR humidity > 105)", "Recalibrate or replace capacitive humidity sensor element; inspect for condensation or saline coating",
        "Unphysical Relative Humidity", "printf('Relative Humidity (%.1f%%) is outside physical limits [0%%, 105%%]', humidity)"),
    ("SPEC_WIND_NEGATIVE", "MEDIUM", "WARNING", 0.95, "wind_speed", "wind_speed < 0", "Inspect anemometer wiring, zero-offset calibration, and ADC voltage reference",
        "Negative Wind Speed", "printf('Negative wind speed measured (%.2f m/s)', wind_speed)"),
    ("SPEC_WIND_EXCEEDS_RANGE", "MEDIUM", "WARNING", 0.88, "wind_speed", "wind_speed > 50", "Verify severe weather event / gust recording; inspect anemometer bearing for mechanical damage",
        "Wind Speed Exceeds Typical Specification", "printf('Wind speed (%.1f m/s) exceeds typical 50 m/s sensor specification', wind_speed)"),
    ("SPEC_TEMP_EXCEEDS_RANGE", "MEDIUM", "WARNING", 0.92, "temperature", "temperature < -45 OR temperature > 55", "Inspect radiation shield ventilation and RTD/thermistor wiring integrity",
        "Temperature Outside Operating Limits", "printf('Temperature (%.1f°C) exceeds operating specifications [-45.0°C, 55.0°C]', temperature)"),
    ("SPEC_PRESSURE_EXCEEDS_RANGE", "MEDIUM", "WARNING", 0.92, "pressure", "pressure < 850 OR pressure > 1080", "Inspect barometric pressure port for insect blockage or static port leakage",
        "Pressure Outside Operating Limits", "printf('Pressure (%.1f hPa) exceeds station operating specifications [850.0 hPa, 1080.0 hPa]', pressure)"),
    *((f"{prefix}FLAG_{c.upper()}_{kind.upper()}", "LOW", level, conf, f"{c}{extra}", f"flag_{c}_{kind}", action, name, f"'{text} flag_{c}_{kind}'" if kind == "spike" else f"'{text}'")
        for c in CHANNELS for kind, prefix, level, conf, extra, action, name, text in (
        ("iqr_outlier", "STAT_OUTLIER_", "INFO", 0.68, "_iqr", "Flag for automated quality control review; cross-check with nearby weather stations", "Statistical Distribution Outlier", "Reading is an excursion beyond normal statistical distribution"),
        ("zscore_outlier", "STAT_OUTLIER_", "INFO", 0.68, "_zscore", "Flag for automated quality control review; cross-check with nearby weather stations", "Statistical Distribution Outlier", "Reading is an excursion beyond normal statistical distribution"),
        ("spike", "STAT_SPIKE_", "INFO", 0.75, "", "Apply median smoothing filter; monitor channel for recurring transient spikes", "Transient Rate-of-Change Spike", "Rapid rate-of-change spike detected in"),
        ("stuck", "STAT_FLATLINE_", "WARNING", 0.82, "", "Check sensor power line and communication bus (SDI-12 / Modbus / RS-485)", "Sensor Output Flatline", "Frozen sensor: reading remained constant with zero variance"))),
]


def violated(rules: list) -> str:
    """x: a row for each violation of the rules in s."""
    return """,
x AS (""" + "\n  UNION ALL ".join(f"SELECT station_id, row_id, ts, rn, {i} AS ord, '{r[0]}' AS rule_id, '{r[1]}' AS severity, '{r[2]}' AS alert_level, {r[3]}::DOUBLE AS confidence, '{r[4]}' AS sensors, '{r[6]}' AS action, '{r[7]}' AS rule_name, {r[8]} AS description FROM s WHERE {r[5]}" for i, r in enumerate(rules)) + ")"


def fused(detectors: str = "FALSE AS i, 0.0::DOUBLE AS ic, FALSE AS l, 0.0::DOUBLE AS lc, 'temperature' AS worst") -> str:
    """b: the first violation of each reading; u: its event; a: the anomalous ones, numbered."""
    kind = lambda *values: "CASE " + " ".join(f"WHEN {w} THEN {v}" for w, v in zip(("sev = 'HIGH'", "sev = 'MEDIUM'", "i AND l", "l AND lc >= 0.70", "i AND ic >= 0.70", "sev = 'LOW'"), values)) + f" ELSE {values[6]} END"  # noqa: E731, B905
    rule = lambda label: f"'{label} (' || rule_id || ')'"
    warn = "'WARNING'"
    every = "'temperature, pressure, humidity, wind_speed'"
    return f""",
b AS (SELECT station_id, row_id, arg_min(rule_id, ord) AS rule_id, arg_min(severity, ord) AS sev, arg_min(confidence, ord) AS conf, arg_min(sensors, ord) AS sensors, arg_min(action, ord) AS action, arg_min(description, ord) AS description FROM x GROUP BY station_id, row_id),
v AS (SELECT n.station_id, n.row_id, n.ts, n.rn, {detectors}, rule_id, sev, conf, sensors, action, description FROM n LEFT JOIN b USING (station_id, row_id)),
u AS (SELECT station_id, row_id, ts, rn, {kind(*(['TRUE'] * 6), 'FALSE')} AS is_anomaly,
  {kind(rule('THERMODYNAMIC_VIOLATION'), rule('SENSOR_SPEC_BREACH'), "'TEMPORAL_MULTIVARIATE_ANOMALY'", "'TEMPORAL_SEQUENCE_DISTORTION'", "'MULTIVARIATE_OUTLIER'", rule('STATISTICAL_OUTLIER'), "'NORMAL'")} AS anomaly_type,
  {kind("'CRITICAL'", warn, warn, warn, warn, "'INFO'", "'NORMAL'")} AS severity,
  {near(kind('greatest(conf, 0.95)', 'greatest(conf, 0.88)', '(ic + lc) / 2', 'lc', 'ic', 'conf', '1.0 - greatest(ic, lc)'), 3)} AS confidence,
  {kind('sensors', 'sensors', 'worst', 'worst', every, 'sensors', "'None'")} AS affected_sensors,
  {kind('action', 'action', "'Deep inspection required: Temporal pattern and multi-sensor correlation deviation in ' || worst", "'Inspect time-series trajectory of ' || worst || '; check for sudden rate-of-change distortion or sensor drift'",
    "'Inspect multi-sensor correlation matrix; check for abnormal atmospheric coupling'", 'action', "'Normal operational routine'")} AS recommended_action,
  {kind('description', 'description', "'Dual ML model consensus: Temporal sequence reconstruction error (LSTM) and multi-variate feature isolation (IForest) flagged anomalous pattern'", "'LSTM Autoencoder reconstruction error exceeded 3-sigma baseline'",
    "'Isolation Forest identified rare multi-dimensional feature combination'", 'description', "'Nominal sensor operation within physical and statistical bounds'")} AS description, ic, lc FROM v),
a AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY ts, row_id) AS alert_seq FROM u WHERE is_anomaly)"""


VIOLATIONS = S + violated(RULES)
FUSED = VIOLATIONS + fused()
_SHARES = [f"((row_id * {m}) % 11) / 11.0::DOUBLE" for m in (1, 3, 7, 9)]
_WORST = "CASE " + " ".join(f"WHEN {x} >= greatest({', '.join(_SHARES)}) THEN '{c}'" for c, x in zip(CHANNELS, _SHARES)) + " END"  # noqa: B905
DETECTED = VIOLATIONS + fused(f"n.row_id % 7 = 0 AS i, (n.row_id % 100) / 100.0::DOUBLE AS ic, n.row_id % 5 = 0 AS l, ((n.row_id * 37) % 100) / 100.0::DOUBLE AS lc, {_WORST.replace('row_id', 'n.row_id')} AS worst")


def recurring(fused: str) -> str:
    return fused + """,
rec AS (SELECT a.station_id, a.row_id, a.ts, a.alert_seq, a.severity, a.anomaly_type, a.affected_sensors, a.recommended_action, a.confidence, count(o.alert_seq) AS earlier, max_by(o.ts, o.alert_seq) AS last_ts
  FROM a LEFT JOIN a o ON o.station_id = a.station_id AND o.alert_seq < a.alert_seq AND o.ts >= a.ts - INTERVAL 72 HOUR
    AND (o.anomaly_type = a.anomaly_type OR list_has_any(string_split(o.affected_sensors, ', '), string_split(a.affected_sensors, ', ')))
  GROUP BY ALL),
rc AS (SELECT *, CASE WHEN earlier = 0 THEN 'First occurrence in observation window (Isolated incident)'
  WHEN earlier = 1 THEN 'Similar event previously recorded at ' || strftime(last_ts, '%m-%d %H:%M') || ' (2nd occurrence)'
  ELSE 'Recurring pattern: Detected ' || (earlier + 1) || ' times in past 72h (Investigate persistent fault)' END AS historical_context FROM rec)"""


RECURRENCE = recurring(FUSED)
ALERT_ID = "'ALT-' || lpad(alert_seq::VARCHAR, greatest(4, length(alert_seq::VARCHAR))::INT, '0')"

PROFILE_ROWS = """(0, 'temperature', 'Pt100 4-Wire RTD Class 1/10 DIN', '°C', DATE '2026-03-01', 365, 0.6::DOUBLE, 0.35::DOUBLE, 95.0::DOUBLE, 60.0::DOUBLE),
  (1, 'pressure', 'Vaisala PTB330 Digital Barometer', 'hPa', DATE '2026-01-15', 365, 1.2, 0.25, 95.0, 60.0), (2, 'humidity', 'Rotronic HygroMet4 Thin-Film Capacitive', '%', DATE '2026-04-10', 180, 3.5, 1.8, 95.0, 60.0),
  (3, 'wind_speed', 'Gill WindObserver II Ultrasonic Anemometer', 'm/s', DATE '2025-11-01', 365, 0.8, 0.6, 95.0, 60.0)"""
INCIDENT = {"pressure": " OR flag_pressure_out_of_bounds OR flag_vapor_exceeds_pressure"}
#: From h4 (measures by station and sensor, with the profile) to h (scores and status).
SCORED = """,
h5 AS (SELECT *, CASE WHEN days > lim THEN 'EXPIRED' WHEN days > 0.85 * lim THEN 'DUE_SOON' WHEN abs(bias) > maxb THEN 'OUT_OF_SPEC' ELSE 'OPTIMAL' END AS calibration_status,
  CASE WHEN comp >= least_c THEN 90.0 + 10.0 * ((comp - least_c) / (100.0 - least_c + 1e-6)) ELSE comp / least_c * 90.0 END AS s1,
  greatest(0.0, 100.0 * (1.0 - least(2.0, abs(bias) / (maxb + 1e-6)) / 1.5)) AS s2,
  greatest(0.0, 100.0 * (1.0 - least(2.0, noise / (maxn + 1e-6)) / 1.6)) AS s3,
  CASE WHEN days / (lim + 1e-6) <= 1.0 THEN 100.0 * (1.0 - 0.4 * (days / (lim + 1e-6))) ELSE greatest(0.0, 60.0 - 40.0 * (days / (lim + 1e-6) - 1.0)) END AS s4 FROM h4),
h6 AS (SELECT *, least(100.0, greatest(0.0, 0.25 * s1 + 0.35 * s2 + 0.25 * s3 + 0.15 * s4 - least(20.0, 1.5 * anomaly_incidents)))::DOUBLE AS score,
  least(CASE WHEN abs(drift) > 1e-4 THEN greatest(0.0, maxb - abs(bias)) / abs(drift) ELSE 365.0 END, greatest(0.0, lim - days))::DOUBLE AS life FROM h5),
h AS (SELECT *, CASE WHEN score < 40 OR abs(bias) >= maxb OR life <= 7 THEN 'URGENT_ACTION_REQUIRED' WHEN score < deg OR life <= 30 OR calibration_status = 'EXPIRED' THEN 'MAINTENANCE_DUE'
  WHEN calibration_status = 'DUE_SOON' OR score < 75 THEN 'CALIBRATION_RECOMMENDED' ELSE 'NORMAL' END AS maintenance_status,
  CASE WHEN score >= 90 THEN 'EXCELLENT' WHEN score >= 75 THEN 'GOOD' WHEN score >= 60 THEN 'FAIR' WHEN score >= 40 THEN 'DEGRADED' ELSE 'CRITICAL' END AS health_grade FROM h6)"""
PROFILED = f"prof AS (SELECT * FROM (VALUES {PROFILE_ROWS}) AS t(ordinal, sensor, model, unit, cal, lim, maxb, maxn, least_c, deg))"
_H4 = "h4 AS (SELECT h3.*, prof.* EXCLUDE (sensor), 100.0::DOUBLE * total_received / total_expected AS comp, greatest(0, date_diff('day', cal, DATE '2026-09-24'))::DOUBLE AS days FROM h3 JOIN prof USING (sensor))"
HEALTH = S + f""",
{PROFILED},
""" + "h0 AS (" + " UNION ALL ".join(f"SELECT station_id, rn, '{c}' AS sensor, {c} AS y, coalesce({c} > -900 AND {c} < 9000, FALSE) AS ok, ({' OR '.join(f'flag_{c}_{k}' for k in KINDS)}{INCIDENT.get(c, '')}) AS bad FROM s" for c in CHANNELS) + f"""),
h1 AS (SELECT *, y - lag(y) OVER (PARTITION BY station_id, sensor ORDER BY rn) AS d FROM h0 WHERE ok),
h2 AS (SELECT station_id, sensor, stddev_samp(d) / sqrt(2.0) AS dev FROM h1 GROUP BY 1, 2),
h3 AS (SELECT h0.station_id, sensor, count(*) AS total_expected, count(*) FILTER (WHERE ok) AS total_received, count(*) FILTER (WHERE bad) AS anomaly_incidents, 0.0::DOUBLE AS bias, 0.0::DOUBLE AS drift,
  coalesce(any_value(dev), 0.0) AS noise, coalesce(any_value(dev), 0.0) ** 2 AS variance FROM h0 LEFT JOIN h2 USING (station_id, sensor) GROUP BY 1, 2),
{_H4}""" + SCORED
_ACTION = """CASE maintenance_status WHEN 'URGENT_ACTION_REQUIRED' THEN 'URGENT: Immediate field inspection & sensor replacement / full recalibration required for ' || sensor || '.'
  WHEN 'MAINTENANCE_DUE' THEN 'Schedule maintenance within ' || floor(life)::BIGINT || ' days: Recalibrate zero/span and clean sensor aperture.'
  WHEN 'CALIBRATION_RECOMMENDED' THEN printf('Calibration inspection recommended: Monitor drift trend (%+.3f %s/day).', drift, unit) ELSE 'Sensor operating within optimal specifications. Continue routine monitoring.' END"""
METRICS = f"""SELECT station_id, sensor, model AS instrument_model, total_expected, total_received, {near('comp')} AS completeness_pct, {near('bias', 3)} AS current_bias, {near('drift', 4)} AS drift_rate_per_day, {near('noise', 3)} AS noise_std,
  {near('variance', 4)} AS noise_variance, {near('days', 1)} AS days_since_calibration, calibration_status, anomaly_incidents, {near('s1', 1)} AS completeness_subscore, {near('s2', 1)} AS drift_subscore, {near('s3', 1)} AS noise_subscore, {near('s4', 1)} AS calibration_subscore,
  {near('score', 1)} AS health_score, health_grade, score < deg AS is_degraded, {near('life', 1)} AS predicted_rul_days, maintenance_status, {_ACTION} AS recommended_action FROM h"""
MAINTENANCE = f"""SELECT station_id, sensor, model AS instrument_model, CASE maintenance_status WHEN 'URGENT_ACTION_REQUIRED' THEN 'URGENT' WHEN 'MAINTENANCE_DUE' THEN 'HIGH' ELSE 'MEDIUM' END AS urgency,
  CASE maintenance_status WHEN 'URGENT_ACTION_REQUIRED' THEN 1 WHEN 'MAINTENANCE_DUE' THEN 2 ELSE 3 END::INT AS urgency_rank,
  CASE maintenance_status WHEN 'URGENT_ACTION_REQUIRED' THEN 'Health Score Critical (' || {near('score', 1)} || '%) | Bias (' || printf('%+.2f', {near('bias', 3)}) || ') exceeds limits | RUL: ' || {near('life', 1)} || ' days'
    WHEN 'MAINTENANCE_DUE' THEN 'Sensor Degraded (' || {near('score', 1)} || '%) | RUL: ' || {near('life', 1)} || ' days | Drift: ' || printf('%+.3f', {near('drift', 4)}) || '/day'
    ELSE 'Calibration interval expiring (' || {near('days', 1)} || ' days elapsed) | Status: ' || calibration_status END AS trigger_reason,
  {near('score', 1)} AS current_health_score, {near('life', 1)} AS predicted_rul_days, {_ACTION} AS action_instructions FROM h WHERE maintenance_status <> 'NORMAL'"""

NOISE = {"temperature": (0.05, 0.002, 0.3, 5.0), "pressure": (0.03, 0.001, 0.2, 10.0), "humidity": (0.15, 0.005, 1.5, 15.0), "wind_speed": (0.20, 0.003, 0.5, 5.0)}
DT = R + f""",
t AS (SELECT *, CASE WHEN sec > 0 THEN greatest(0.1, sec / 60.0) ELSE 5.0 END::DOUBLE AS dt FROM (SELECT *, epoch_us(ts - lag(ts) OVER ({O})) / 1e6 AS sec FROM n))"""


def kalman(timed: str, references: bool = False) -> str:
    """CTEs from t (readings with rn, dt and, with references, ref_{channel}) to ks: the filter's states, row by row."""
    sensors = " UNION ALL ".join(f"SELECT station_id, '{c}' AS sensor, rn, dt, CASE WHEN isinf({c}) THEN NULL ELSE {c} END AS z, {f'ref_{c}' if references else 'NULL::DOUBLE'} AS w, {q * q:.17g}::DOUBLE AS q, {b * b:.17g}::DOUBLE AS qb, {m * m:.17g}::DOUBLE AS m, {i * i:.17g}::DOUBLE AS p0 FROM t" for c, (q, b, m, i) in NOISE.items())
    return "WITH RECURSIVE " + timed.lstrip() + f""",
o AS ({sensors}),
k(station_id, sensor, rn, v, r, b, vv, vr, vb, rr, rb, bb, y, fit, nis) AS (
  SELECT station_id, sensor, 0::BIGINT, coalesce(z, 0.0)::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, p0, 0.0::DOUBLE, 0.0::DOUBLE, (0.1 * 0.1)::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE FROM o WHERE rn = 1
  UNION ALL
  SELECT station_id, sensor, rn, v + coalesce(j0 * x, 0), r + coalesce(j1 * x, 0), b + coalesce(j2 * x, 0),
    vv - coalesce(j0 * vv, 0), vr - coalesce(j0 * vr, 0), vb - coalesce(j0 * vb, 0), rr - coalesce(j1 * vr, 0), rb - coalesce(j1 * vb, 0), bb - coalesce(j2 * vb, 0),
    y, z - (v + coalesce(j0 * x, 0)) - (b + coalesce(j2 * x, 0)), CASE WHEN w IS NULL THEN n1 ELSE coalesce(n1, 0) + x * x / (vv + 0.05::DOUBLE * 0.05::DOUBLE) END
  FROM (SELECT *, CASE WHEN w IS NOT NULL THEN vv / (vv + 0.05::DOUBLE * 0.05::DOUBLE) END AS j0, CASE WHEN w IS NOT NULL THEN vr / (vv + 0.05::DOUBLE * 0.05::DOUBLE) END AS j1, CASE WHEN w IS NOT NULL THEN vb / (vv + 0.05::DOUBLE * 0.05::DOUBLE) END AS j2, w - v AS x FROM (
  SELECT station_id, sensor, rn, z, w, v + coalesce(k0 * y, 0) AS v, r + coalesce(k1 * y, 0) AS r, b + coalesce(k2 * y, 0) AS b,
    vv - coalesce(k0 * g0, 0) AS vv, vr - coalesce(k0 * g1, 0) AS vr, vb - coalesce(k0 * g2, 0) AS vb, rr - coalesce(k1 * g1, 0) AS rr, rb - coalesce(k1 * g2, 0) AS rb, bb - coalesce(k2 * g2, 0) AS bb,
    y, y * y / s AS n1
  FROM (SELECT *, g0 / s AS k0, g1 / s AS k1, g2 / s AS k2, z - v - b AS y FROM (
    SELECT *, CASE WHEN z IS NOT NULL THEN vv + vb END AS g0, CASE WHEN z IS NOT NULL THEN vr + rb END AS g1, CASE WHEN z IS NOT NULL THEN vb + bb END AS g2, vv + 2 * vb + bb + m AS s FROM (
      SELECT o.station_id, o.sensor, o.rn, o.z, o.w, o.m, k.v + k.r * dt AS v, k.r, k.b, k.vv + 2 * dt * k.vr + dt * dt * k.rr + q * dt * dt * dt / 3 AS vv, k.vr + dt * k.rr + q * dt * dt / 2 AS vr,
        k.vb + dt * k.rb AS vb, k.rr + q * dt AS rr, k.rb, k.bb + qb * dt AS bb FROM k JOIN o ON o.station_id = k.station_id AND o.sensor = k.sensor AND o.rn = k.rn + 1)))))),
ks AS (SELECT * FROM k WHERE rn > 0)"""


KALMAN = kalman(DT)
CHECKED = kalman(DT.replace("t AS (SELECT *, CASE WHEN sec", "t AS (SELECT *, " + each("CASE WHEN row_id % 50 = 0 THEN {c} - 0.3::DOUBLE END AS ref_{c}") + ", CASE WHEN sec"), True)


def bounded(c: str, x: str) -> str:
    low, high = BOUNDS[c]
    x = f"greatest({x}, {low})"
    return x if high is None else f"least({x}, {high})"


def bands(c: str, raw: str, bias: str, sigma: str) -> str:
    value = f"CASE WHEN {raw} IS NOT NULL THEN {bounded(c, f'{raw} - {bias}')} END"
    out = [f"{near(value)} AS {c}_corrected", f"{near(bias, 3)} AS {c}_bias_est", f"{near(sigma, 3)} AS {c}_uncertainty_std"]
    for name, z in (("ci95", "1.960::DOUBLE"), ("ci99", "2.576::DOUBLE")):
        for side, sign in (("lower", "-"), ("upper", "+")):
            y = f"({value}) {sign} {z} * {sigma}"
            out.append(f"{near(f'CASE WHEN {raw} IS NOT NULL THEN {bounded(c, y) if c in BANDED else y} END')} AS {c}_{name}_{side}")
    return ", ".join(out)


#: The whole correction plan without detectors: w has each reading with its states, corrected columns and event.
_WIDE = ", ".join(f"max(CASE WHEN sensor = '{c}' THEN b END) AS b_{c}, max(CASE WHEN sensor = '{c}' THEN sqrt(greatest(vv, 0) + greatest(bb, 0)) END) AS g_{c}" for c in CHANNELS)
PLAN = KALMAN + """,
""" + (P + violated(RULES[:7]).replace("FROM s WHERE", "FROM p WHERE") + fused()).removeprefix(R).lstrip(",\n") + f""",
kw AS (SELECT station_id, rn, {_WIDE} FROM ks GROUP BY ALL),
w AS (SELECT n.*, {each("n.{c} AS {c}_raw")}, {", ".join(bands(c, f"n.{c}", f"b_{c}", f"g_{c}") for c in CHANNELS)}, u.is_anomaly, u.severity, u.anomaly_type, u.confidence FROM n JOIN kw USING (station_id, rn) JOIN u ON u.station_id = n.station_id AND u.row_id = n.row_id)"""
HEALTH_PLAN = f""",
{PROFILED},
h1 AS (SELECT k.station_id, k.sensor, k.rn, k.b, k.fit, CASE k.sensor {" ".join(f"WHEN '{c}' THEN n.{c}" for c in CHANNELS)} END AS y FROM ks k JOIN n USING (station_id, rn)),
h3 AS (SELECT station_id, sensor, count(*) AS total_expected, count(*) FILTER (WHERE y > -900 AND y < 9000) AS total_received, 0::BIGINT AS anomaly_incidents, arg_max(b, rn) AS bias,
  CASE WHEN count(*) > 10 THEN regr_slope(b, rn) / ((count(*) * 5.0 / 1440.0) / (count(*) - 1)) ELSE 0 END AS drift, stddev_samp(fit) AS noise, var_samp(fit) AS variance FROM h1 GROUP BY ALL),
{_H4}""" + SCORED
_COLUMNS = ", ".join(f"{c}_{k}" for c in CHANNELS for k in ("raw", "corrected", "bias_est", "uncertainty_std", "ci95_lower", "ci95_upper", "ci99_lower", "ci99_upper"))
_SHOWN = lambda suffix: "coalesce(nullif(array_to_string(list_transform(string_split(affected_sensors, ', '), lambda s: s || '=' || coalesce(CASE s " + " ".join(f"WHEN '{c}' THEN printf('%.2f', w.{c}_{suffix})" for c in CHANNELS) + " END, 'nan')), ', '), ''), 'N/A')"

POINT = R + f""",
d1 AS (SELECT *, {each("coalesce({c} - lag({c}) OVER (" + O + "), 0.0) AS {c}_diff1")} FROM n),
d2 AS (SELECT *, {each("coalesce({c}_diff1 - lag({c}_diff1) OVER (" + O + "), 0.0) AS {c}_diff2", items=("temperature", "pressure"))},
  6.112 * exp(17.67 * temperature / (temperature + 243.5)) * CASE WHEN humidity IS NOT NULL THEN greatest(humidity, 0.0) END / 100.0 AS e,
  17.67 * temperature / (243.5 + temperature) + CASE WHEN humidity IS NOT NULL THEN ln(least(greatest(humidity / 100.0, 0.0001), 1.5)) END AS gamma FROM d1),
d3 AS (SELECT *, temperature - 243.5 * gamma / (17.67 - gamma) AS dew_point_depression, e AS actual_vapor_pressure, 216.7 * e / (temperature + 273.15) AS absolute_humidity FROM d2)"""
GAPS = (*CHANNELS, "dew_point_depression", "actual_vapor_pressure", "absolute_humidity")
FILLED = lambda c: f"coalesce(last_value({c} IGNORE NULLS) OVER ({O} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value({c} IGNORE NULLS) OVER ({O} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0.0)"

NUM = lambda c: f"coalesce({c}::VARCHAR, 'nan')"
_LOG = [(f"flag_{c}_missing", c, "'MISSING'", f"{c}_missing_or_sentinel", NUM(c), f"'Missing reading or sentinel value detected in {c}'") for c in CHANNELS] + [
    ("flag_dew_point_exceeds_temp", "temperature+humidity", "'PHYSICS_VIOLATION'", "dew_point_le_temp", f"'T=' || {NUM('temperature')} || '°C, RH=' || {NUM('humidity')} || '%'",
        f"'Thermodynamic violation: Dew Point (' || printf('%.2f', td) || '°C) exceeds Dry Bulb Temperature (' || {NUM('temperature')} || '°C)'"),
    ("flag_vapor_exceeds_pressure", "pressure+humidity", "'PHYSICS_VIOLATION'", "vapor_pressure_le_ambient", NUM("pressure"), "'Water vapor pressure exceeds total atmospheric ambient pressure'"),
    ("flag_rh_out_of_bounds", "humidity", "'PHYSICS_VIOLATION'", "rh_physical_bounds", NUM("humidity"), f"'Relative Humidity (' || {NUM('humidity')} || '%) out of physical bounds [0%, 102%]'"),
    ("flag_wind_negative", "wind_speed", "'PHYSICS_VIOLATION'", "wind_speed_non_negative", NUM("wind_speed"), f"'Physically impossible negative wind speed (' || {NUM('wind_speed')} || ' m/s)'"),
    ("flag_wind_exceeds_typical", "wind_speed", "CASE WHEN wind_speed <= 90 THEN 'PHYSICS_WARNING' ELSE 'PHYSICS_VIOLATION' END", "wind_speed_max_bounds", NUM("wind_speed"), f"'Wind speed (' || {NUM('wind_speed')} || ' m/s) exceeds typical 50 m/s bound'")]
for _c in CHANNELS:
    _LOG += [(f"flag_{_c}_spike", _c, "'SPIKE'", f"{_c}_rate_of_change_spike", NUM(_c), f"'Unphysical abrupt step change / transient spike in {_c} (' || {NUM(_c)} || ')'"),
        (f"flag_{_c}_stuck", _c, "'STUCK'", f"{_c}_sensor_flatline", NUM(_c), f"'Frozen / stuck sensor: zero variance in {_c} over time window (' || {NUM(_c)} || ')'")]
LOG = S + """,
l AS (""" + " UNION ALL ".join(f"SELECT station_id, row_id, ts, {i} AS seq, '{sensor}' AS sensor, {observed} AS observed, {cat} AS category, '{rule}' AS rule, {text} AS description FROM s WHERE {f}" for i, (f, sensor, cat, rule, observed, text) in enumerate(_LOG)) + ")"

#: Readings with their place in the station, from 0, and the station's number of rows.
X = R + """,
x AS (SELECT *, rn - 1 AS place, count(*) OVER (PARTITION BY station_id) AS steps FROM n)"""
#: The generator without noise at the times of readings: cycles, then faults. d is days since the first of the year.
CALM = X + """,
g0 AS (SELECT station_id, row_id, ts, place, steps, epoch_us(ts - TIMESTAMP '2026-01-01') / 86400e6 AS d, (hour(ts) + minute(ts) / 60.0)::DOUBLE AS h FROM x),
g1 AS (SELECT *, 22.0 + 8.0 * cos((h - 14.0) * 2.0 * pi() / 24.0) + 3.0 * sin(2.0 * pi() * d / 3.5) AS t, 1013.25 + 12.0 * cos(2.0 * pi() * d / 4.0) + 1.2 * sin(4.0 * pi() * (h - 9.0) / 24.0) AS p FROM g0),
g2 AS (SELECT *, least(14.0 + 2.0 * sin(2.0 * pi() * d / 2.0), t - 1.5) AS td FROM g1),
g AS (SELECT station_id, row_id, ts, place, steps, t AS temperature, p AS pressure, least(98.0, greatest(10.0, 100.0 * (6.112 * exp(17.67 * td / (td + 243.5))) / (6.112 * exp(17.67 * t / (t + 243.5))))) AS humidity,
  least(35.0, greatest(0.0, 5.5 * pow(-ln(0.5::DOUBLE), 0.5) * (1.0 + 0.4 * greatest(0.0, sin((h - 8.0) * pi() / 12.0))))) AS wind_speed FROM g2)"""
#: Each injected fault as (place, rows, sensor, type, description).
_FAULTS = {"t_gap": (0.08, 3, "temperature", "MISSING", "Sentinel -999.0"), "p_gap": (0.25, 5, "pressure", "MISSING", "Sensor dropout NaN gap"), "rh_high": (0.15, 1, "humidity", "PHYSICS_VIOLATION", "RH exceeds 100% (118.5%)"),
    "rh_low": (0.45, 1, "humidity", "PHYSICS_VIOLATION", "Negative RH (-12%)"), "w_low": (0.35, 1, "wind_speed", "PHYSICS_VIOLATION", "Negative wind speed (-4.5 m/s)"), "w_high": (0.65, 1, "wind_speed", "PHYSICS_VIOLATION", "Extreme unphysical wind speed (108 m/s)"),
    "t_high": (0.72, 1, "temperature", "PHYSICS_VIOLATION", "Climatological high temperature (78.5°C)"), "p_low": (0.88, 1, "pressure", "PHYSICS_VIOLATION", "Pressure below physical surface limits (720 hPa)"),
    "t_spike": (0.52, 1, "temperature", "SPIKE", "Transient +14°C spike"), "p_spike": (0.60, 1, "pressure", "SPIKE", "Step spike in pressure (+9.5 hPa)"), "held": (0.80, 17, "temperature", "STUCK", "Frozen temperature sensor for 16 intervals")}
_AT = lambda k: f"floor(steps * {_FAULTS[k][0]}::DOUBLE)"
_IN = {k: f"(steps > 200 AND place BETWEEN {_AT(k)} AND {_AT(k)} + {f[1] - 1})" for k, f in _FAULTS.items()}
FAULTY = "WITH " + CALM.lstrip() + f""", held AS (SELECT station_id, temperature AS held FROM g WHERE place = {_AT('held')}) SELECT station_id, row_id, epoch_us(ts) AS ts,
  round(CASE WHEN {_IN['held']} THEN held WHEN {_IN['t_gap']} THEN -999.0 WHEN {_IN['t_high']} THEN 78.5 WHEN {_IN['t_spike']} THEN temperature + 14.0 ELSE temperature END, 6) AS temperature,
  round(CASE WHEN {_IN['p_gap']} THEN NULL WHEN {_IN['p_low']} THEN 720.0 WHEN {_IN['p_spike']} THEN pressure + 9.5 ELSE pressure END, 6) AS pressure,
  round(CASE WHEN {_IN['rh_high']} THEN 118.5 WHEN {_IN['rh_low']} THEN -12.0 ELSE humidity END, 6) AS humidity,
  round(CASE WHEN {_IN['w_low']} THEN -4.5 WHEN {_IN['w_high']} THEN 108.0 ELSE wind_speed END, 6) AS wind_speed FROM g JOIN held USING (station_id)"""
FAULT_ROWS = f"WITH {X.lstrip()} " + " UNION ALL ".join(f"SELECT DISTINCT station_id, {_AT(k)}::INT AS idx, '{f[2]}' AS sensor, '{f[3]}' AS type, '{f[4]}' AS \"desc\" FROM x WHERE steps > 200" for k, f in _FAULTS.items())
_DAYS = "(place * (5.0::DOUBLE / greatest(1, steps - 1)))"
_LATER = lambda share: f"place >= floor(steps * {share}::DOUBLE)"
_RAMP = {c: f"{k}::DOUBLE * {_DAYS}" for c, k in {"temperature": 0.25, "pressure": -0.40, "humidity": 0.80, "wind_speed": 0.15}.items()}
_MULTI = {"temperature": f"0.3::DOUBLE * {_DAYS}", "pressure": f"CASE WHEN {_LATER(0.5)} THEN -2.5 ELSE 0.0 END::DOUBLE", "humidity": "0.0::DOUBLE", "wind_speed": "0.0::DOUBLE"}
_STEP = {c: f"CASE WHEN {_LATER(0.42)} THEN {k} ELSE 0.0 END::DOUBLE" for c, k in {"temperature": 2.2, "pressure": -3.0, "humidity": 6.5, "wind_speed": 0.0}.items()}


def biased(bias: dict[str, str]) -> str:
    return f"WITH {X.lstrip()} SELECT station_id, row_id, " + ", ".join(f"round({x}, 6) AS {c}_true_bias" for c, x in bias.items()) + " FROM x"


def seen(bias: dict[str, str]) -> str:
    """Each channel with its bias, where the instrument can show it."""
    shown = {c: f"{c} + {bias[c]}" for c in CHANNELS}
    shown |= {"humidity": f"least(100.0, greatest(0.0, {shown['humidity']}))", "wind_speed": f"CASE WHEN wind_speed IS NOT NULL THEN greatest(0.0, {shown['wind_speed']}) END"}
    return ", ".join(f"{x} AS z_{c}, {bias[c]} AS tb_{c}, CASE WHEN hour(ts) = 12 THEN {c} END AS ref_{c}" for c, x in shown.items())


CALM_DRIFT = "WITH " + X.lstrip() + f""" SELECT station_id, row_id, {each("round(z_{c}, 6) AS {c}, round(tb_{c}, 6) AS {c}_true_bias, round(ref_{c}, 6) AS {c}_reference")} FROM (SELECT *, {seen(_MULTI)} FROM x)"""
EVALUATED = kalman(X + f""",
t AS (SELECT station_id, row_id, ts, rn, CASE WHEN sec > 0 THEN greatest(0.1, sec / 60.0) ELSE 5.0 END::DOUBLE AS dt, {each("{c} AS truth_{c}, z_{c} AS {c}, tb_{c}, ref_{c}")} FROM (SELECT *, epoch_us(ts - lag(ts) OVER ({O})) / 1e6 AS sec, {seen(_STEP)} FROM x))""", True) + ",\n" + "ev AS (" + " UNION ALL ".join(
    f"SELECT ks.station_id, sensor, ks.rn, {c} AS z, v AS x, truth_{c} AS t, b, tb_{c} AS tb FROM ks JOIN t USING (station_id, rn) WHERE sensor = '{c}'" for c in CHANNELS) + """)
SELECT station_id, sensor, round(raw_rmse, 4) AS raw_rmse, round(filtered_rmse, 4) AS filtered_rmse, round(bias_rmse, 4) AS bias_rmse, round(true_final_bias, 4) AS true_final_bias, round(estimated_final_bias, 4) AS estimated_final_bias,
  round(100.0 * (raw_rmse - filtered_rmse) / nullif(raw_rmse, 0), 4) AS reduction_percent
FROM (SELECT station_id, sensor, sqrt(avg((z - t) ** 2)) AS raw_rmse, sqrt(avg((x - t) ** 2)) AS filtered_rmse, sqrt(avg((b - tb) ** 2)) AS bias_rmse, arg_max(tb, rn) AS true_final_bias, arg_max(b, rn) AS estimated_final_bias FROM ev GROUP BY ALL)"""

_COUNTED = {"temperature": "flag_temp_out_of_bounds", "pressure": "flag_pressure_out_of_bounds", "humidity": "flag_rh_out_of_bounds OR flag_dew_point_exceeds_temp", "wind_speed": "flag_wind_negative OR flag_wind_exceeds_extreme"}
SUMMARY = " UNION ALL ".join(f"""SELECT station_id, '{c}' AS sensor, round(100.0::DOUBLE * avg((NOT (flag_{c}_missing OR flag_{c}_stat_anomaly OR {_COUNTED[c]}))::INT), 4) AS valid_percent, count(*) FILTER (WHERE flag_{c}_missing) AS missing,
  count(*) FILTER (WHERE {_COUNTED[c]}) AS physics_violations, count(*) FILTER (WHERE flag_{c}_iqr_outlier) AS iqr_outliers, count(*) FILTER (WHERE flag_{c}_zscore_outlier) AS zscore_outliers,
  count(*) FILTER (WHERE flag_{c}_spike) AS spikes, count(*) FILTER (WHERE flag_{c}_stuck) AS stuck FROM s GROUP BY station_id""" for c in CHANNELS)
_GAPS = " OR ".join(f"flag_{c}_missing" for c in CHANNELS)
_ODD = " OR ".join([*FLAGS, *(f"flag_{c}_{k}" for c in CHANNELS for k in KINDS[1:])])

CELLS = lambda kind: each("flag_{c}_" + kind)
KEYS = "station_id, row_id"

ORACLES: dict[str, str] = {
    "readings": f"WITH {R} SELECT station_id, row_id, {ALL} FROM r",
    "thermo_derived": f"WITH {P} SELECT {KEYS}, {digits('es')} AS es, {digits('e')} AS e, {digits('td')} AS td, {digits('ah')} AS ah, round(temperature - td, 6) AS depression FROM p",
    "physics_flags": f"WITH {P} SELECT {KEYS}, {', '.join(FLAGS)} FROM p",
    "physics_counts_by_station": f"WITH {P} " + " UNION ALL ".join(f"SELECT station_id, '{n}' AS name, count(*) FILTER (WHERE {c}) AS n FROM p GROUP BY station_id" for n, c in PHYSICS_COUNTS.items()),
    "missing_sentinel_flags": f"WITH {S} SELECT {KEYS}, {CELLS('missing')} FROM s",
    "iqr_bounds": f"WITH {S} SELECT DISTINCT station_id, {each('round(q1_{c}, 6) AS {c}_q1, round(q3_{c}, 6) AS {c}_q3, round(q1_{c} - 2.0 * (q3_{c} - q1_{c}), 6) AS {c}_lower, round(q3_{c} + 2.0 * (q3_{c} - q1_{c}), 6) AS {c}_upper')} FROM s",
    "iqr_outliers": f"WITH {S} SELECT {KEYS}, {CELLS('iqr_outlier')} FROM s",
    "rolling_mad_zscore": f"WITH {S} SELECT {KEYS}, {CELLS('zscore_outlier')} FROM s",
    "rolling_mean_zscore": f"WITH {R}{stat('n', False)} SELECT {KEYS}, {CELLS('zscore_outlier')} FROM s",
    "step_spikes": f"WITH {S} SELECT {KEYS}, {CELLS('spike')} FROM s",
    "stuck_sensors": f"WITH {S} SELECT {KEYS}, {CELLS('stuck')} FROM s",
    "sensor_validity": f"WITH {V} SELECT {KEYS}, {each('is_valid_{c}')}, {each('is_valid_{c}', ' AND ')} AS is_all_valid FROM v",
    "channel_summary": f"WITH {S} {SUMMARY}",
    "statistical_counts": f"WITH {S} " + " UNION ALL ".join(f"SELECT station_id, '{n}' AS name, ({' + '.join(f'count(*) FILTER (WHERE flag_{c}_{k})' for c in CHANNELS)})::BIGINT AS n FROM s GROUP BY station_id" for n, k in STATISTICAL_COUNTS.items()),
    "overall_quality": f"WITH {S} SELECT station_id, count(*) AS total_records, round(100.0::DOUBLE * avg((NOT ({_GAPS}) AND NOT ({_ODD}))::INT), 4) AS valid_percent, round(100.0::DOUBLE * avg(({_GAPS})::INT), 4) AS missing_percent, round(100.0::DOUBLE * avg(({_ODD})::INT), 4) AS anomaly_percent, arg_min(row_id, rn) AS first_row, arg_max(row_id, rn) AS last_row FROM s GROUP BY station_id",
    "incident_log": f"WITH {LOG} SELECT station_id, row_id, seq, sensor, observed, category, rule, description FROM l",
    "incident_topk": f"WITH {LOG} SELECT station_id, row_id, seq, sensor, observed, category, rule, description FROM l ORDER BY ts, row_id, seq LIMIT 25",
    "rule_violations": f"WITH {VIOLATIONS} SELECT station_id, row_id, row_number() OVER (PARTITION BY station_id, row_id ORDER BY ord) - 1 AS seq, rule_id, rule_name, severity, alert_level, confidence, sensors, description, action AS recommended_action FROM x",
    "fusion_rules_only": f"WITH {FUSED} SELECT {KEYS}, is_anomaly, anomaly_type, severity, confidence, affected_sensors, recommended_action, description FROM u",
    "alert_min_severity": f"WITH {FUSED} SELECT {KEYS}, anomaly_type, severity FROM u WHERE severity IN ('WARNING', 'CRITICAL')",
    "alert_numbering": f"WITH {FUSED} SELECT {KEYS}, alert_seq, {ALERT_ID} AS alert_id FROM a",
    "alert_severity_counts": f"WITH {FUSED} SELECT station_id, severity, count(*) AS n FROM a GROUP BY ALL",
    "alert_recurrence_72h": f"WITH {RECURRENCE} SELECT {KEYS}, alert_seq, earlier, historical_context FROM rc",
    "alert_search": f"WITH {RECURRENCE} SELECT {KEYS}, alert_seq, severity FROM rc WHERE severity = 'WARNING' AND contains(lower(anomaly_type || ' ' || recommended_action || ' ' || historical_context || ' ' || affected_sensors), 'anemometer')",
    "kalman_dt": f"WITH {DT} SELECT {KEYS}, rn, round(dt, 8) AS dt FROM t",
    "kalman_states": KALMAN + " SELECT station_id, sensor, rn, round(v, 5) AS true_value, round(r, 6) AS rate, round(b, 5) AS bias, round(sqrt(greatest(vv, 0)), 5) AS true_std, round(sqrt(greatest(bb, 0)), 5) AS bias_std, round(y, 5) AS innovation, round(fit, 5) AS post_fit FROM ks",
    "kalman_nis": KALMAN + " SELECT station_id, rn, round(sum(nis), 3) AS nis FROM ks GROUP BY ALL",
    "kalman_summary": KALMAN + " SELECT station_id, sensor, round(coalesce(avg(fit), 0), 5) AS residual_mean, round(coalesce(stddev_samp(fit), 0), 5) AS residual_std, round(coalesce(sqrt(avg(fit * fit)), 0), 5) AS residual_rmse, round(arg_max(b, rn), 5) AS final_bias FROM ks GROUP BY ALL",
    "auto_correction_ci": f"WITH {R} SELECT {KEYS}, {', '.join(bands(c, c, '0.25::DOUBLE', '0.2::DOUBLE') for c in CHANNELS)} FROM r",
    "health_metrics": f"WITH {HEALTH} {METRICS}",
    "maintenance_alerts": f"WITH {HEALTH} {MAINTENANCE}",
    "health_noise_fallback": f"WITH {HEALTH} SELECT station_id, sensor, round(noise, 6) AS noise FROM h",
    "station_average_health": f"WITH {HEALTH} SELECT station_id, {near('avg(' + near('score', 1) + ')', 1)} AS average_health FROM h GROUP BY station_id",
    "iforest_features": f"WITH {POINT} SELECT {KEYS}, {', '.join(f'round({FILLED(c)}, 4) AS {c}' for c in GAPS)}, {each('round({c}_diff1, 4) AS {c}_diff1')}, round(temperature_diff2, 4) AS temperature_diff2, round(pressure_diff2, 4) AS pressure_diff2 FROM d3",
    "sequence_windows": f"WITH {R}, w1 AS (SELECT station_id, row_id, rn, {each('coalesce(last_value({c} IGNORE NULLS) OVER (' + O + ' ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value({c} IGNORE NULLS) OVER (' + O + ' ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}')} FROM n) SELECT station_id, row_id, CASE WHEN rn >= 12 THEN string_agg(printf('%.4f,%.4f,%.4f,%.4f', {ALL}), ',') OVER ({O} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) END AS \"window\" FROM w1",
    "drift_slope": f"WITH {R} SELECT station_id, round(regr_slope(temperature, k) / ((count(temperature) * 5.0 / 1440.0) / (count(temperature) - 1)), 5) AS drift FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY rn) AS k FROM n WHERE temperature IS NOT NULL) GROUP BY station_id",
    "live_buffer": f"WITH {R}, st AS (SELECT * FROM (VALUES (0, 100), (1, 150), (2, 80), (3, 120)) AS t(station_id, step)) SELECT station_id, row_id, rn, {ALL} FROM n JOIN st USING (station_id) WHERE rn BETWEEN step + 1 - 60 AND step + 1",
    "history_head": f"WITH {R} SELECT station_id, row_id, rn, {ALL} FROM n WHERE rn <= 300",
    "station_overview": f"WITH {FUSED}{HEALTH.removeprefix(S)}, c1 AS (SELECT * FROM (VALUES (0, 'AWS-01-ISRIKA1-Bheemili', 'OPERATIONAL'), (1, 'AWS-02-Pataparadesipalem Station', 'DEGRADED_SENSORS'), (2, 'AWS-03-Visakhapatnam', 'OPERATIONAL'), (3, 'AWS-04-IVISAK16', 'CALIBRATION_DUE')) AS t(station_id, code, status)) SELECT station_id, code, status, (SELECT count(*) FROM n WHERE n.station_id = c1.station_id) AS readings, n.row_id, {each('n.{c}')}, (SELECT {near('avg(' + near('score', 1) + ')', 1)} FROM h WHERE h.station_id = c1.station_id) AS average_health, (SELECT count(*) FROM a WHERE a.station_id = c1.station_id AND severity IN ('CRITICAL', 'WARNING')) AS active_alerts FROM c1 JOIN n USING (station_id) WHERE n.rn = (SELECT max(rn) FROM n m WHERE m.station_id = c1.station_id)",
    "station_agreement": f"WITH {P}, z AS (SELECT date_trunc('hour', ts) AS w, station_id, max(flag_wind_physics_violation::INT) AS hit FROM p GROUP BY ALL) SELECT epoch(w)::BIGINT AS window_start, count(*) AS stations, round(avg(hit), 4) AS agreement FROM z GROUP BY w",
    "inject_temp_spike": f"WITH {R} SELECT {KEYS}, CASE WHEN rn = 50 THEN temperature + 15 ELSE temperature END AS temperature_raw, CASE WHEN rn = 50 THEN temperature + 15 ELSE temperature END AS temperature_corrected, rn = 50 AS is_anomaly, CASE WHEN rn = 50 THEN 'WARNING' ELSE 'NORMAL' END AS anomaly_severity FROM n",
    "inject_rh_violation": f"WITH {R} SELECT {KEYS}, CASE WHEN rn = 50 THEN 122.0 ELSE humidity END AS humidity_raw, CASE WHEN rn = 50 THEN 122.0 ELSE humidity END AS humidity_corrected, rn = 50 AS is_anomaly, CASE WHEN rn = 50 THEN 'CRITICAL' ELSE 'NORMAL' END AS anomaly_severity FROM n",
    "inject_wind_negative": f"WITH {R} SELECT {KEYS}, CASE WHEN rn = 50 THEN -6.5 ELSE wind_speed END AS wind_speed_raw, CASE WHEN rn = 50 THEN -6.5 ELSE wind_speed END AS wind_speed_corrected, rn = 50 AS is_anomaly, CASE WHEN rn = 50 THEN 'WARNING' ELSE 'NORMAL' END AS anomaly_severity FROM n",
    "inject_bias_jump": f"WITH {R} SELECT {KEYS}, CASE WHEN rn BETWEEN 50 AND 70 THEN pressure + 8 ELSE pressure END AS pressure_raw, pressure AS pressure_corrected, rn BETWEEN 50 AND 70 AS is_anomaly, CASE WHEN rn BETWEEN 50 AND 70 THEN 'CRITICAL' ELSE 'NORMAL' END AS anomaly_severity FROM n",
    "drift_ramp": biased(_RAMP),
    "drift_step": biased(_STEP),
    "drift_multi_fault_without_noise": biased(_MULTI),
    "stream_hourly_counts": f"WITH {P} SELECT epoch(date_trunc('hour', ts))::BIGINT AS window_start, station_id, count(*) AS readings, count(*) FILTER (WHERE flag_t_p_rh_physics_violation) AS thermo_violations, count(*) FILTER (WHERE flag_wind_physics_violation) AS wind_violations FROM p GROUP BY ALL",
    "fusion_with_detectors": f"WITH {DETECTED} SELECT {KEYS}, is_anomaly, anomaly_type, severity, confidence, affected_sensors, recommended_action, description, {near('ic', 3)} AS iforest_conf, {near('lc', 3)} AS lstm_conf FROM u",
    "alert_recurrence_over_log": f"WITH {RECURRENCE} SELECT {KEYS}, alert_seq, {ALERT_ID} AS alert_id, earlier, historical_context FROM rc WHERE day(ts) >= 16",
    "kalman_with_references": CHECKED + " SELECT station_id, sensor, rn, round(v, 5) AS true_value, round(r, 6) AS rate, round(b, 5) AS bias, round(sqrt(greatest(vv, 0)), 5) AS true_std, round(sqrt(greatest(bb, 0)), 5) AS bias_std, round(y, 5) AS innovation, round(sum(nis) OVER (PARTITION BY station_id, rn), 3) AS nis FROM ks",
    "kalman_intervals": KALMAN + " SELECT station_id, sensor, rn, round(v - 1.96 * sqrt(greatest(vv, 0)), 5) AS true_ci95_lower, round(v + 1.96 * sqrt(greatest(vv, 0)), 5) AS true_ci95_upper, round(b - 1.96 * sqrt(greatest(bb, 0)), 5) AS bias_ci95_lower, round(b + 1.96 * sqrt(greatest(bb, 0)), 5) AS bias_ci95_upper FROM ks",
    "health_from_kalman": f"{KALMAN}{HEALTH_PLAN} {METRICS}",
    "corrected_by_rules": f"{PLAN} SELECT station_id, row_id, epoch_us(ts) AS ts, {_COLUMNS}, is_anomaly, severity AS anomaly_severity, anomaly_type, confidence AS anomaly_confidence FROM w",
    "alerts_by_rules": f"{recurring(PLAN)}{HEALTH_PLAN} SELECT rc.station_id, rc.row_id, alert_seq, {ALERT_ID} AS alert_id, epoch_us(rc.ts) AS ts, rc.anomaly_type, rc.severity, affected_sensors AS affected_parameters, {_SHOWN('raw')} AS raw_reading, {_SHOWN('corrected')} AS corrected_estimate, rc.confidence AS confidence_score, recommended_action, historical_context, health_grade AS sensor_health_grade FROM rc JOIN w ON w.station_id = rc.station_id AND w.row_id = rc.row_id JOIN h ON h.station_id = rc.station_id AND h.sensor = string_split(affected_sensors, ', ')[1]",
    "synthetic_without_noise": FAULTY,
    "synthetic_faults": FAULT_ROWS,
    "drift_observed_without_noise": CALM_DRIFT,
    "drift_evaluation_without_noise": EVALUATED,
    "stream_kalman": KALMAN + " SELECT station_id, sensor, rn, round(v, 4) AS true_value, round(b, 4) AS bias FROM ks",
}
for _how, _name in (("interpolate", "impute_linear"), ("ffill", "impute_ffill"), ("bfill", "impute_bfill"), ("forward", "impute_forward")):
    ORACLES[_name] = f"WITH {V}{fill('v', _how)} SELECT {KEYS}, {each('round(f_{c}, 6) AS {c}')} FROM f"
ORACLES["cleaned_dataset"] = f"WITH {V}{fill('v', 'interpolate')} SELECT {KEYS}, {CLEANED} FROM f"
_UNIFIED = ", ".join([*CHANNELS, *(f"{c}_cleaned" for c in CHANNELS), *FLAGS, *(f"flag_{c}_{k}" for c in CHANNELS for k in KINDS), *(f"is_valid_{c}" for c in CHANNELS)])
ORACLES["unified_dataset"] = f"WITH {V}{fill('v', 'interpolate')} SELECT {KEYS}, epoch_us(ts) AS ts, {_UNIFIED}, {digits('es')} AS saturation_vapor_pressure_hpa, {digits('e')} AS actual_vapor_pressure_hpa, {digits('td')} AS dew_point_c, {digits('ah')} AS absolute_humidity_gm3, {each('is_valid_{c}', ' AND ')} AS is_all_valid FROM (SELECT *, {CLEANED} FROM f)"
ORACLES["service_metrics"] = f"WITH {R} SELECT 10.0::DOUBLE AS uptime_seconds, count(*) AS total_inferences, {near('count(*) / 10.0::DOUBLE', 1)} AS throughput_rps, {near('10000.0::DOUBLE / count(*)', 3)} AS avg_latency_ms, 'CONVERGED' AS kalman_filter_state, 'NOT_TRAINED' AS lstm_model_status, 'NOT_TRAINED' AS iforest_model_status, count(DISTINCT station_id) AS active_stations FROM r"
ORACLES["health_shades"] = f"WITH {HEALTH} SELECT station_id, sensor, {near('score', 1)} AS health_score, {near('bias', 3)} AS current_bias, CASE WHEN {near('score', 1)} >= 85 THEN 'good' WHEN {near('score', 1)} >= 60 THEN 'fair' ELSE 'poor' END AS shade, abs({near('bias', 3)}) > 0.5 AS bias_highlighted FROM h"
_SIDE = {"true_ground_truth": "truth", "observed_drifted": "z", "true_estimated": "v", "bias_ground_truth": "tb", "bias_estimated": "b", "true_ci95_lower": "v - 1.96 * sqrt(greatest(vv, 0))", "true_ci95_upper": "v + 1.96 * sqrt(greatest(vv, 0))",
    "bias_ci95_lower": "b - 1.96 * sqrt(greatest(bb, 0))", "bias_ci95_upper": "b + 1.96 * sqrt(greatest(bb, 0))", "innovation": "y", "post_fit_residual": "fit"}
_FEW = ("true_ground_truth", "observed_drifted", "true_estimated", "bias_ground_truth", "bias_estimated", "post_fit_residual")
_ROWS = " UNION ALL ".join(f"SELECT ks.*, t.row_id, t.ts, {c} AS z, truth_{c} AS truth, tb_{c} AS tb FROM ks JOIN t USING (station_id, rn) WHERE sensor = '{c}'" for c in CHANNELS)
ORACLES["tracking_export"] = EVALUATED[: EVALUATED.index("ev AS (")] + f"ex AS ({_ROWS}) SELECT station_id, any_value(row_id) AS row_id, any_value(epoch_us(ts)) AS timestamp, " + ", ".join(
    f"max(CASE WHEN sensor = '{c}' THEN round({x}, 5) END) AS {short}_{k}" for c, short in (("temperature", "temp"), ("pressure", "pres"), ("humidity", "rh"), ("wind_speed", "wind")) for k, x in _SIDE.items() if c == "temperature" or k in _FEW) + ", round(sum(nis), 3) AS nis FROM ex GROUP BY station_id, rn"
ORACLES["stream_kalman_late"], ORACLES["stream_kalman_references"], ORACLES["stream_cleaned"] = ORACLES["kalman_states"], ORACLES["kalman_with_references"], ORACLES["cleaned_dataset"]
ORACLES["stream_alert_recurrence"] = f"WITH {RECURRENCE} SELECT {KEYS}, earlier, historical_context FROM rc"
ORACLES["stream_flags"] = f"WITH {V} SELECT {KEYS}, {', '.join(CELLS(k) for k in ('missing', 'zscore_outlier', 'spike', 'stuck', 'iqr_outlier'))}, {each('is_valid_{c}')}, {each('is_valid_{c}', ' AND ')} AS is_all_valid FROM v"
ORACLES["readings_json"] = f"WITH {R} SELECT station_id, row_id, {ALL}, TRUE AS marked FROM r"
ORACLES["quality_roll_up"] = f"WITH {S}, cells AS (" + " UNION ALL ".join(f"SELECT station_id, '{c}' AS sensor, flag_{c}_missing AS m, ({_COUNTED[c]}) AS ph, flag_{c}_stat_anomaly AS st FROM s" for c in CHANNELS) + ") SELECT station_id, sensor, grouping_id(station_id, sensor)::BIGINT AS level, count(*) AS readings, count(*) FILTER (WHERE m) AS missing, count(*) FILTER (WHERE ph) AS physics, count(*) FILTER (WHERE st) AS statistical FROM cells GROUP BY ROLLUP (station_id, sensor)"
ORACLES |= {f"{k}_by_days": ORACLES[k] for k in ("channel_summary", "health_metrics", "drift_slope")} | {"health_noise_by_days": ORACLES["health_noise_fallback"]}
ORACLES["stream_alert_log"] = f"WITH {RECURRENCE} SELECT {KEYS}, alert_seq, {ALERT_ID} AS alert_id, earlier, historical_context FROM rc"
ORACLES["stream_live_buffer"] = f"WITH {R}, m AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY rn DESC) AS back, count(*) OVER (PARTITION BY station_id) AS total FROM n) SELECT station_id, row_id, (least(total, 60) - back)::INT AS place, {ALL} FROM m WHERE back <= 60"

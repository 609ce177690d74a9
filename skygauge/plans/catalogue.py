"""Registered telemetry queries, over readings derived from the event table."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skygauge.functions.config import CHANNELS, CleaningConfig, StatisticalThresholds
from skygauge.operators import clean, correction, features, health, iforest, incremental, injection, kalman, physics, report, rules, sequence, serving, statistical
from skygauge.plans import chunks, telemetry
from skygauge.plans.oracles import ORACLES
from skygauge.plans.scratch import folder, stored
from skygauge.sources import readings, sinks, synthetic
from skygauge.streaming import alertlog, live, lookahead

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
KEYS = ("station_id", "row_id")
LIMITS = StatisticalThresholds()

__all__ = ["ORACLES", "QUERIES"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _physics(spark: SparkSession, d: str) -> DataFrame:
    return physics.check(readings.from_events(spark, d))


def _flagged(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.checked(readings.from_events(spark, d))


def _flags(kind: str) -> list[str]:
    return [statistical.flag(c, kind) for c in CHANNELS]


def _rounded(n: int, *names: str) -> list[Column]:
    return [F.round(x, n).alias(x) for x in names]


@query
def readings_(spark: SparkSession, d: str) -> DataFrame:
    return readings.from_events(spark, d).select(*KEYS, *CHANNELS)


QUERIES["readings"] = QUERIES.pop("readings_")


def _digits(x: str | Column) -> Column:
    """x to ten digits, whatever its size."""
    return F.format_string("%.9e", x).cast("double")


@query
def thermo_derived(spark: SparkSession, d: str) -> DataFrame:
    """Of every reading; where a sentinel stands for the temperature the quantities are very large."""
    df = physics.derived(readings.from_events(spark, d))
    es, e, td, ah = (F.when(F.col(x).isNotNull(), _digits(x)) for x in physics.DERIVED)
    depression = F.col("temperature") - F.col(physics.DERIVED[2])
    return df.select(*KEYS, es.alias("es"), e.alias("e"), td.alias("td"), ah.alias("ah"), F.round(depression, 6).alias("depression"))


@query
def physics_flags(spark: SparkSession, d: str) -> DataFrame:
    return _physics(spark, d).select(*KEYS, *physics.FLAGS)


@query
def physics_counts_by_station(spark: SparkSession, d: str) -> DataFrame:
    return report.physics_counts(_physics(spark, d))


@query
def missing_sentinel_flags(spark: SparkSession, d: str) -> DataFrame:
    df = readings.from_events(spark, d)
    return df.select(*KEYS, *(statistical.missing(F.col(c), LIMITS.sentinels).alias(statistical.flag(c, "missing")) for c in CHANNELS))


@query
def iqr_bounds(spark: SparkSession, d: str) -> DataFrame:
    found = statistical.fences(readings.from_events(spark, d), LIMITS)
    return found.select("station_id", *_rounded(6, *(f"{c}_{x}" for c in CHANNELS for x in ("q1", "q3", "lower", "upper"))))


@query
def iqr_outliers(spark: SparkSession, d: str) -> DataFrame:
    return statistical.iqr_flags(readings.from_events(spark, d), LIMITS).select(*KEYS, *_flags("iqr_outlier"))


def _rows(spark: SparkSession, d: str, limits: StatisticalThresholds = LIMITS) -> DataFrame:
    reach = statistical.halo(limits)
    return chunks.cores(statistical.row_flags(chunks.chunked(chunks.numbered(readings.from_events(spark, d)), reach), limits))


@query
def rolling_mad_zscore(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).select(*KEYS, *_flags("zscore_outlier"))


@query
def rolling_mean_zscore(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d, StatisticalThresholds(robust=False)).select(*KEYS, *_flags("zscore_outlier"))


@query
def step_spikes(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).select(*KEYS, *_flags("spike"))


@query
def stuck_sensors(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).select(*KEYS, *_flags("stuck"))


@query
def sensor_validity(spark: SparkSession, d: str) -> DataFrame:
    return clean.validity(_flagged(spark, d)).select(*KEYS, *clean.VALID, "is_all_valid")


def _imputed(strategy: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = stored(clean.validity(_flagged(spark, d)).select(*KEYS, *CHANNELS, *clean.VALID, "rn", "chunk"))
        df = clean.imputed({c: F.when(F.col(f"is_valid_{c}"), F.col(c)) for c in CHANNELS}, df, CleaningConfig(strategy))
        return df.select(*KEYS, *(F.round(f"{c}_filled", 6).alias(c) for c in CHANNELS))

    return run


QUERIES |= {"impute_linear": _imputed("interpolate"), "impute_ffill": _imputed("ffill"), "impute_bfill": _imputed("bfill"), "impute_forward": _imputed("forward")}


@query
def cleaned_dataset(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.quality_control(readings.from_events(spark, d)).select(*KEYS, *(f"{c}_cleaned" for c in CHANNELS))


@query
def unified_dataset(spark: SparkSession, d: str) -> DataFrame:
    found = clean.unified(telemetry.quality_control(readings.from_events(spark, d)))
    return found.withColumns({x: F.when(F.col(x).isNotNull(), _digits(x)) for x in physics.DERIVED} | {"ts": F.unix_micros("ts")})


@query
def channel_summary(spark: SparkSession, d: str) -> DataFrame:
    return report.channel_summary(_flagged(spark, d))


@query
def statistical_counts(spark: SparkSession, d: str) -> DataFrame:
    return report.statistical_counts(_flagged(spark, d))


@query
def quality_roll_up(spark: SparkSession, d: str) -> DataFrame:
    return report.roll_up(_flagged(spark, d))


@query
def readings_json(spark: SparkSession, d: str) -> DataFrame:
    """The lines of one JSON array of all readings, read back, and whether each has its bracket or comma."""
    lines = sinks.json_parts(readings.from_events(spark, d).select(*KEYS, *CHANNELS))
    record = F.regexp_replace("line", r"^[\[,]|\]$", "")
    return lines.select(*(F.get_json_object(record, f"$.{c}").cast(kind).alias(c) for c, kind in (("station_id", "int"), ("row_id", "long"), *((c, "double") for c in CHANNELS))), F.substring("line", 1, 1).isin("[", ",").alias("marked"))


@query
def overall_quality(spark: SparkSession, d: str) -> DataFrame:
    df = _flagged(spark, d)
    ends = df.groupBy(F.col("station_id").alias("s")).agg(F.min_by("row_id", F.struct("ts", "row_id")).alias("first_row"), F.max_by("row_id", F.struct("ts", "row_id")).alias("last_row"))
    return report.overall(df).join(ends, F.col("station_id") == F.col("s")).drop("s", "time_start", "time_end")


@query
def incident_log(spark: SparkSession, d: str) -> DataFrame:
    return report.incidents(_flagged(spark, d)).select(*KEYS, "seq", "sensor", "observed", "category", "rule", "description")


@query
def incident_topk(spark: SparkSession, d: str) -> DataFrame:
    return report.top_incidents(report.incidents(_flagged(spark, d))).select(*KEYS, "seq", "sensor", "observed", "category", "rule", "description")


@query
def rule_violations(spark: SparkSession, d: str) -> DataFrame:
    found = rules.exploded(rules.violations(_flagged(spark, d)))
    return found.select(*KEYS, F.col("seq").cast("long").alias("seq"), "rule_id", "rule_name", "severity", "alert_level", "confidence", F.array_join("affected_sensors", ", ").alias("sensors"), "description", "recommended_action")


def _fused(spark: SparkSession, d: str, flagged: DataFrame | None = None) -> DataFrame:
    return rules.fuse(rules.violations(_flagged(spark, d) if flagged is None else flagged))


@query
def fusion_rules_only(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).select(*KEYS, "is_anomaly", "anomaly_type", "severity", "confidence", "affected_sensors", "recommended_action", "description")


@query
def fusion_with_detectors(spark: SparkSession, d: str) -> DataFrame:
    """All priorities, with verdicts of both detectors made up from the row's number."""
    n, share = F.col("row_id"), lambda x, m: F.pmod(F.col("row_id") * x, F.lit(m)) / float(m)
    marks = {"iforest_flag": n % 7 == 0, "iforest_conf": share(1, 100), "lstm_flag": n % 5 == 0, "lstm_conf": share(37, 100), "lstm_errors": F.array(*(share(x, 11) for x in (1, 3, 7, 9)))}
    found = rules.fuse(rules.violations(_flagged(spark, d)).withColumns(marks))
    return found.select(*KEYS, "is_anomaly", "anomaly_type", "severity", "confidence", "affected_sensors", "recommended_action", "description", "iforest_conf", "lstm_conf")


@query
def alert_min_severity(spark: SparkSession, d: str) -> DataFrame:
    return rules.alerts(_fused(spark, d), "WARNING").select(*KEYS, "anomaly_type", "severity")


def _alerts(spark: SparkSession, d: str) -> DataFrame:
    return stored(_fused(spark, d).where("is_anomaly").select(*KEYS, "ts", "anomaly_type", "severity", "sensors", "recommended_action"))


@query
def alert_numbering(spark: SparkSession, d: str) -> DataFrame:
    return correction.number_alerts(_alerts(spark, d)).select(*KEYS, F.col("alert_seq").cast("long").alias("alert_seq"), "alert_id")


@query
def alert_severity_counts(spark: SparkSession, d: str) -> DataFrame:
    return correction.severity_counts(_alerts(spark, d))


@query
def alert_recurrence_72h(spark: SparkSession, d: str) -> DataFrame:
    return correction.recurrence(correction.number_alerts(_alerts(spark, d))).select(*KEYS, F.col("alert_seq").cast("long").alias("alert_seq"), "earlier", "historical_context")


@query
def alert_search(spark: SparkSession, d: str) -> DataFrame:
    log = correction.recurrence(correction.number_alerts(_alerts(spark, d))).withColumn("affected_parameters", F.col("sensors"))
    return correction.search(log, "warning", "Anemometer").select(*KEYS, F.col("alert_seq").cast("long").alias("alert_seq"), "severity")


@query
def kalman_dt(spark: SparkSession, d: str) -> DataFrame:
    return kalman.minutes_since(readings.from_events(spark, d)).select(*KEYS, F.col("rn").cast("long").alias("rn"), F.round("dt", 8).alias("dt"))


def _states(tracked: DataFrame) -> DataFrame:
    return tracked.select("station_id", "rn", F.inline(F.array(*(F.struct(F.lit(c).alias("sensor"), *(F.col(f"{c}_{k}").alias(k) for k in kalman.ESTIMATES)) for c in CHANNELS))))


def _states_and_nis(tracked: DataFrame) -> DataFrame:
    return tracked.select("station_id", "rn", "nis", F.inline(F.array(*(F.struct(F.lit(c).alias("sensor"), *(F.col(f"{c}_{k}").alias(k) for k in kalman.ESTIMATES)) for c in CHANNELS))))


@query
def kalman_states(spark: SparkSession, d: str) -> DataFrame:
    rows = _states(kalman.track(readings.from_events(spark, d)))
    return rows.select("station_id", "sensor", "rn", F.round("true", 5).alias("true_value"), F.round("rate", 6).alias("rate"), F.round("bias", 5).alias("bias"), *_rounded(5, "true_std", "bias_std", "innovation"), F.round("post_fit_residual", 5).alias("post_fit"))


@query
def kalman_with_references(spark: SparkSession, d: str) -> DataFrame:
    """Every fiftieth reading is checked against a reference that is 0.3 lower."""
    df = readings.from_events(spark, d)
    references = df.where("row_id % 50 = 0").select(*KEYS, *((F.col(c) - 0.3).alias(c) for c in CHANNELS))
    rows = _states_and_nis(kalman.track(df, references))
    return rows.select("station_id", "sensor", "rn", F.round("true", 5).alias("true_value"), F.round("rate", 6).alias("rate"), *_rounded(5, "bias", "true_std", "bias_std", "innovation"), F.round("nis", 3).alias("nis"))


@query
def kalman_intervals(spark: SparkSession, d: str) -> DataFrame:
    rows = kalman.intervals(kalman.track(readings.from_events(spark, d)))
    ends = [f"{x}_ci95_{side}" for x in ("true", "bias") for side in ("lower", "upper")]
    return rows.select("station_id", "rn", F.inline(F.array(*(F.struct(F.lit(c).alias("sensor"), *(F.round(f"{c}_{x}", 5).alias(x) for x in ends)) for c in CHANNELS))))


@query
def kalman_nis(spark: SparkSession, d: str) -> DataFrame:
    return kalman.track(readings.from_events(spark, d)).select("station_id", "rn", F.round("nis", 3).alias("nis"))


@query
def kalman_summary(spark: SparkSession, d: str) -> DataFrame:
    found = kalman.summary(kalman.track(readings.from_events(spark, d)))
    return found.select("station_id", "sensor", *_rounded(5, "residual_mean", "residual_std", "residual_rmse", "final_bias"))


@query
def auto_correction_ci(spark: SparkSession, d: str) -> DataFrame:
    """With a bias of 0.25 and a deviation of 0.2 in every channel."""
    df, out = readings.from_events(spark, d), {}
    for c in CHANNELS:
        out |= correction.corrected_columns(c, F.col(c), F.lit(0.25), F.lit(0.2))
    return df.select(*KEYS, *(v.alias(k) for k, v in out.items()))


def _health(spark: SparkSession, d: str, flagged: DataFrame | None = None) -> DataFrame:
    """The flags have numbered the readings; their numbers are kept."""
    return health.score(health.measures(stored(_flagged(spark, d)) if flagged is None else flagged), readings.profiles(spark))


@query
def health_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _health(spark, d).drop("ordinal")


def _by_days(spark: SparkSession, df: DataFrame, parts: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Parts of a history that comes in three spans of days: each adds its own to the table, the others aren't read again."""
    at = f"{folder(spark)}/parts-{uuid.uuid4().hex}"
    for days in ("dayofmonth(ts) < 9", "dayofmonth(ts) BETWEEN 9 AND 18", "dayofmonth(ts) > 18"):
        parts(df.where(days)).write.mode("append").parquet(at)
    return spark.read.parquet(at)


@query
def channel_summary_by_days(spark: SparkSession, d: str) -> DataFrame:
    return incremental.channel_summary(_by_days(spark, stored(_flagged(spark, d)), incremental.channel_parts))


@query
def health_metrics_by_days(spark: SparkSession, d: str) -> DataFrame:
    parts = _by_days(spark, stored(_flagged(spark, d).drop("rn", "chunk")), incremental.health_parts)
    return health.score(incremental.health_measures(parts), readings.profiles(spark)).drop("ordinal")


@query
def health_noise_by_days(spark: SparkSession, d: str) -> DataFrame:
    """Noise from successive readings, the steps between days among them."""
    return incremental.health_measures(_by_days(spark, readings.from_events(spark, d), incremental.health_parts)).select("station_id", "sensor", F.round("noise", 6).alias("noise"))


@query
def drift_slope_by_days(spark: SparkSession, d: str) -> DataFrame:
    df = readings.from_events(spark, d).withColumn("temperature_bias", F.col("temperature"))
    found = incremental.health_measures(_by_days(spark, df, incremental.health_parts))
    return found.where("sensor = 'temperature'").select("station_id", F.round("drift", 5).alias("drift"))


@query
def maintenance_alerts(spark: SparkSession, d: str) -> DataFrame:
    return health.maintenance_alerts(_health(spark, d)).drop("ordinal")


@query
def health_noise_fallback(spark: SparkSession, d: str) -> DataFrame:
    return health.measures(readings.from_events(spark, d)).select("station_id", "sensor", F.round("noise", 6).alias("noise"))


@query
def station_average_health(spark: SparkSession, d: str) -> DataFrame:
    return health.station_average(_health(spark, d))


@query
def drift_slope(spark: SparkSession, d: str) -> DataFrame:
    """The drift of a bias series; here the temperature stands for one."""
    df = readings.from_events(spark, d).withColumn("temperature_bias", F.col("temperature"))
    return health.measures(df).where("sensor = 'temperature'").select("station_id", F.round("drift", 5).alias("drift"))


@query
def iforest_features(spark: SparkSession, d: str) -> DataFrame:
    return features.point_features(readings.from_events(spark, d)).select(*KEYS, *_rounded(4, *features.FEATURES))


@query
def sequence_windows(spark: SparkSession, d: str) -> DataFrame:
    found = features.sequences(readings.from_events(spark, d))
    return found.select(*KEYS, F.array_join(F.transform("window", lambda x: F.format_string("%.4f", x)), ",").alias("window"))


@query
def iforest_scores(spark: SparkSession, d: str) -> DataFrame:
    points = stored(features.point_features(readings.from_events(spark, d)))
    return iforest.fit_and_score(points)[1].select(*KEYS, "iforest_score", "iforest_flag", "iforest_conf")


@query
def seq_recon_error(spark: SparkSession, d: str) -> DataFrame:
    return sequence.fit_and_score(stored(chunks.numbered(readings.from_events(spark, d))))[1]


@query
def hybrid_full(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.detect(readings.from_events(spark, d), telemetry.QualityConfig()).select(*KEYS, "is_anomaly", "anomaly_type", "severity", "confidence", "affected_sensors", "recommended_action", "description", "iforest_flag", "iforest_conf", "lstm_flag", "lstm_conf")


@query
def corrected_dataset(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.correct_and_alert(readings.from_events(spark, d))["corrected"]


@query
def actionable_alerts(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.correct_and_alert(readings.from_events(spark, d))["alerts"]


@query
def health_from_kalman(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.correct_and_alert(readings.from_events(spark, d), detectors=False)["health"].drop("ordinal")


@query
def corrected_by_rules(spark: SparkSession, d: str) -> DataFrame:
    """The whole correction plan without the learned detectors."""
    return telemetry.correct_and_alert(readings.from_events(spark, d), detectors=False)["corrected"].withColumn("ts", F.unix_micros("ts"))


@query
def alerts_by_rules(spark: SparkSession, d: str) -> DataFrame:
    """The alert log of the whole correction plan without the learned detectors."""
    found = telemetry.correct_and_alert(readings.from_events(spark, d), detectors=False)["alerts"]
    return found.withColumns({"ts": F.unix_micros("ts"), "affected_parameters": F.array_join("affected_parameters", ", "), "alert_seq": F.col("alert_seq").cast("long")})


@query
def alert_recurrence_over_log(spark: SparkSession, d: str) -> DataFrame:
    """Alerts from the 16th of the month on, numbered and looked at after a stored log of those before."""
    found = _alerts(spark, d)
    log = stored(correction.number_alerts(found.where(F.dayofmonth("ts") < 16)))
    later = stored(correction.number_alerts(found.where(F.dayofmonth("ts") >= 16), log))
    return correction.recurrence(later, log=log).select(*KEYS, F.col("alert_seq").cast("long").alias("alert_seq"), "alert_id", "earlier", "historical_context")


@query
def live_buffer(spark: SparkSession, d: str) -> DataFrame:
    """Every station's buffer at its registered step; the station table has one row a station."""
    df = chunks.numbered(readings.from_events(spark, d)).join(readings.stations(spark).select("station_id", "step_index"), "station_id")
    return serving.live_buffer(df, F.col("step_index")).select(*KEYS, F.col("rn").cast("long").alias("rn"), *CHANNELS)


@query
def history_head(spark: SparkSession, d: str) -> DataFrame:
    return serving.history(chunks.numbered(readings.from_events(spark, d))).select(*KEYS, F.col("rn").cast("long").alias("rn"), *CHANNELS)


@query
def station_overview(spark: SparkSession, d: str) -> DataFrame:
    flagged = stored(_flagged(spark, d))
    found = serving.overview(readings.stations(spark), flagged, _health(spark, d, flagged), rules.alerts(_fused(spark, d, flagged)))
    return found.select("station_id", "code", "status", "readings", "row_id", *CHANNELS, "average_health", "active_alerts")


@query
def station_agreement(spark: SparkSession, d: str) -> DataFrame:
    found = serving.agreement(_physics(spark, d), "flag_wind_physics_violation")
    return found.select(F.unix_timestamp("window_start").alias("window_start"), "stations", "agreement")


@query
def service_metrics(spark: SparkSession, d: str) -> DataFrame:
    """As if the readings had been processed in ten seconds, without the learned detectors."""
    return serving.metrics(readings.from_events(spark, d), 10.0)


@query
def health_shades(spark: SparkSession, d: str) -> DataFrame:
    return serving.shaded(_health(spark, d)).select("station_id", "sensor", "health_score", "current_bias", "shade", "bias_highlighted")


def _injected(kind: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        c = injection.known(kind).channel
        df = chunks.numbered(readings.from_events(spark, d)).withColumns({f"{c}_raw": F.col(c), f"{c}_corrected": F.col(c), "is_anomaly": F.lit(False), "anomaly_severity": F.lit("NORMAL"), "anomaly_type": F.lit("NORMAL")})
        return injection.inject(df, kind, 50).select(*KEYS, f"{c}_raw", f"{c}_corrected", "is_anomaly", "anomaly_severity")

    return run


QUERIES |= {f"inject_{k}": _injected(k) for k in injection.INJECTIONS}


#: Experiments whose truth is the readings themselves: their drift without noise, and with it. All take five days, however long the history is.
CALM = synthetic.WeatherConfig(days=5.0, inject=False, noise=0.0, noon_minutes=60)
NOISY = synthetic.WeatherConfig(days=5.0, inject=False, noon_minutes=60)


def _axis(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The axis of the readings, with the given columns alone if they are given."""
    return synthetic.axis_of(readings.from_events(spark, d).select(*(columns or ("*",))))


def _experiment(spark: SparkSession, d: str, scenario: str, config: synthetic.WeatherConfig = CALM) -> dict[str, DataFrame]:
    return synthetic.experiment(stored(_axis(spark, d)), scenario, config)


def _drift(scenario: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return synthetic.biases(_axis(spark, d), scenario, NOISY).select(*KEYS, *_rounded(6, *(f"{c}_true_bias" for c in CHANNELS)))

    return run


QUERIES |= {"drift_ramp": _drift("linear_ramp"), "drift_step": _drift("step_jump"), "drift_brownian": _drift("brownian_drift"), "drift_multi_fault": _drift("multi_fault")}


@query
def drift_multi_fault_without_noise(spark: SparkSession, d: str) -> DataFrame:
    return synthetic.biases(_axis(spark, d), "multi_fault", CALM).select(*KEYS, *_rounded(6, *(f"{c}_true_bias" for c in CHANNELS)))


@query
def synthetic_readings(spark: SparkSession, d: str) -> DataFrame:
    """The generator's weather, with noise and faults, at the stations and times of the readings."""
    return synthetic.weather(spark, on=stored(_axis(spark, d, *KEYS, "ts")))


@query
def synthetic_without_noise(spark: SparkSession, d: str) -> DataFrame:
    """The generator's cycles and injected faults at the stations and times of the readings, with its noise switched off."""
    made = synthetic.weather(spark, synthetic.WeatherConfig(noise=0.0), stored(_axis(spark, d, *KEYS, "ts")))
    return made.select(*KEYS, F.unix_micros("ts").alias("ts"), *_rounded(6, *CHANNELS))


@query
def drift_observed_without_noise(spark: SparkSession, d: str) -> DataFrame:
    """Two faults at once, without noise: truth with bias, the bias, and the references at noon."""
    made = _experiment(spark, d, "multi_fault")
    noon = made["references"].select(*KEYS, *(F.round(c, 6).alias(f"{c}_reference") for c in CHANNELS))
    bias = made["biases"].select(*KEYS, *_rounded(6, *(f"{c}_true_bias" for c in CHANNELS)))
    return made["observed"].select(*KEYS, *_rounded(6, *CHANNELS)).join(bias, list(KEYS)).join(noon, list(KEYS))


@query
def drift_evaluation_without_noise(spark: SparkSession, d: str) -> DataFrame:
    made = _experiment(spark, d, "step_jump")
    found = kalman.evaluation(kalman.track(made["observed"], made["references"]), made["true"], made["biases"])
    return found.select(*KEYS[:1], "sensor", *_rounded(4, *(x for x in found.columns if x not in ("station_id", "sensor"))))


@query
def tracking_export(spark: SparkSession, d: str) -> DataFrame:
    """The tracking table of a step without noise."""
    made = _experiment(spark, d, "step_jump")
    found = sinks.tracking_table(kalman.track(made["observed"], made["references"]), made)
    return found.select(*KEYS, F.unix_micros("timestamp").alias("timestamp"), *_rounded(5, *(c for c in found.columns if c not in (*KEYS, "timestamp", "nis"))), F.round("nis", 3).alias("nis"))


@query
def synthetic_faults(spark: SparkSession, d: str) -> DataFrame:
    """Where the generator puts its faults in each station's readings."""
    return synthetic.faults_on(_axis(spark, d))


@query
def drift_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Errors of tracking in the three published scenarios, raw and filtered."""
    parts = []
    for scenario in synthetic.SCENARIOS[:3]:
        made = _experiment(spark, d, scenario, NOISY)
        parts.append(kalman.evaluation(kalman.track(made["observed"], made["references"]), made["true"], made["biases"]).withColumn("scenario", F.lit(scenario)))
    return reduce(DataFrame.unionByName, parts)


#: Rows of a part of a stream's input, at most: what comes at once has to fit a batch, however long the whole is.
PART_ROWS = 3_000_000


def _parts(df: DataFrame, n: int = 3, arrival: Column | None = None, shortest: int = 1) -> list[DataFrame]:
    """df in n parts by time of arrival (by itself that of the reading), each as long as the others; in more where they would be
    of over PART_ROWS rows, as long as a part has `shortest` microseconds."""
    at = F.unix_micros("ts") if arrival is None else arrival
    low, high, rows = df.agg(F.min(at), F.max(at), F.count(at)).first()
    if low is None:
        return [df]
    n = max(n, min(-(-rows // PART_ROWS), (high - low) // shortest))
    part = F.least(F.floor((at - low) * n / max(1, high - low)), F.lit(n - 1))
    return [df.where(part == k) for k in range(n)]


#: A station that doesn't exist: its reading, long after all others, tells a stream how far time has come.
CLOCK = -1


def _later(df: DataFrame) -> DataFrame:
    return df.limit(1).withColumns({"station_id": F.lit(CLOCK), "ts": F.lit(df.agg(F.max("ts")).first()[0]) + F.expr("INTERVAL 90 DAYS")} | {c: F.lit(None).cast("double") for c in CHANNELS})


def _streamed(spark: SparkSession, inputs: dict[str, list[DataFrame]], plan: Callable[..., DataFrame], each: Callable[[DataFrame, int], None] | None = None, complete: bool = False) -> tuple[DataFrame | None, str]:
    """The result of a stream that gets the parts of its inputs one after another, kept as a table in the shared folder. For each part the query is started anew from its
    checkpoint, so its state outlives it; each: what to do with a batch instead. State is by station: more partitions than stations would be empty stores."""
    root, key = f"{folder(spark)}/stream-{uuid.uuid4().hex}", "spark.sql.shuffle.partitions"
    usual, stations = spark.conf.get(key), sum(parts[0].select("station_id").distinct().count() for parts in list(inputs.values())[:1])
    if not complete:
        spark.conf.set(key, max(1, min(int(usual), stations)))
    try:
        return _run_parts(spark, root, inputs, plan, each, complete)
    finally:
        spark.conf.set(key, usual)


def _run_parts(spark: SparkSession, root: str, inputs: dict[str, list[DataFrame]], plan: Callable[..., DataFrame], each: Callable[[DataFrame, int], None] | None, complete: bool) -> tuple[DataFrame | None, str]:
    for k in range(max(map(len, inputs.values()))):
        for name, parts in inputs.items():
            if k < len(parts):
                parts[k].write.mode("append").parquet(f"{root}/in/{name}")
        out = plan(*(spark.readStream.schema(parts[0].schema).parquet(f"{root}/in/{name}") for name, parts in inputs.items()))
        writer = out.writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
        if complete:
            writer = writer.outputMode("complete").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{root}/out"))
        elif each is not None:
            writer = writer.outputMode("append").foreachBatch(each)
        else:
            writer = writer.outputMode("append").format("parquet").option("path", f"{root}/out")
        writer.start().awaitTermination()
    return (None if each else spark.read.schema(out.schema).parquet(f"{root}/out")), root


@query
def stream_hourly_counts(spark: SparkSession, d: str) -> DataFrame:
    found, _ = _streamed(spark, {"readings": _parts(readings.from_events(spark, d))}, live.windowed_counts, complete=True)
    return found.select(F.unix_timestamp("window_start").alias("window_start"), "station_id", "readings", "thermo_violations", "wind_violations")


@query
def stream_kalman(spark: SparkSession, d: str) -> DataFrame:
    """Tracked in three batches, in order of time."""
    rows = _states(_streamed(spark, {"readings": _parts(readings.from_events(spark, d))}, live.track_stream)[0])
    return rows.select("station_id", "sensor", "rn", F.round("true", 4).alias("true_value"), F.round("bias", 4).alias("bias"))


#: Readings arrive up to so many hours after they were taken: by a number made of their id.
LATE_HOURS = 60


@query
def stream_kalman_late(spark: SparkSession, d: str) -> DataFrame:
    """Tracked in three batches of readings in disorder; the last revision of each."""
    df = readings.from_events(spark, d)
    arrival = F.unix_micros("ts") + F.pmod(F.xxhash64("row_id"), F.lit(LATE_HOURS)) * 3_600_000_000
    found, _ = _streamed(spark, {"readings": _parts(df, arrival=arrival, shortest=LATE_HOURS * 3_600_000_000)}, lambda s: live.track_stream(s, delay=f"{LATE_HOURS} hours"))
    rows = _states(live.latest(found))
    return rows.select("station_id", "sensor", "rn", F.round("true", 5).alias("true_value"), F.round("rate", 6).alias("rate"), F.round("bias", 5).alias("bias"), *_rounded(5, "true_std", "bias_std", "innovation"), F.round("post_fit_residual", 5).alias("post_fit"))


@query
def stream_kalman_references(spark: SparkSession, d: str) -> DataFrame:
    """As kalman_with_references, with readings and checks as two streams; a check comes half an hour after its reading."""
    df = readings.from_events(spark, d)
    checks = df.where("row_id % 50 = 0").select(*KEYS, (F.col("ts") + F.expr("INTERVAL 30 MINUTES")).alias("ts"), *((F.col(c) - 0.3).alias(c) for c in CHANNELS))
    plan = lambda stream, references: live.track_stream(live.with_references(stream, references, "2 hours"), watermarked=True)
    found, _ = _streamed(spark, {"readings": [*_parts(df), _later(df)], "references": [*_parts(checks), _later(checks)]}, plan)
    rows = _states_and_nis(live.latest(found.where(F.col("station_id") != CLOCK)))
    return rows.select("station_id", "sensor", "rn", F.round("true", 5).alias("true_value"), F.round("rate", 6).alias("rate"), *_rounded(5, "bias", "true_std", "bias_std", "innovation"), F.round("nis", 3).alias("nis"))


@query
def stream_live_buffer(spark: SparkSession, d: str) -> DataFrame:
    """Each station's last 60 readings, after three batches in disorder of some hours."""
    df = readings.from_events(spark, d)
    arrival = F.unix_micros("ts") + F.pmod(F.xxhash64("row_id"), F.lit(5)) * 3_600_000_000
    found, _ = _streamed(spark, {"readings": _parts(df, arrival=arrival)}, live.buffer_stream)
    return live.shown(found).select(*KEYS, "place", *CHANNELS)


@query
def stream_alert_recurrence(spark: SparkSession, d: str) -> DataFrame:
    """As alert_recurrence_72h, with the alerts in three batches."""
    found, _ = _streamed(spark, {"alerts": _parts(_alerts(spark, d).select(*KEYS, "ts", "anomaly_type", "sensors"))}, live.recurrence_stream)
    return found.select(*KEYS, "earlier", "historical_context")


@query
def stream_alert_log(spark: SparkSession, d: str) -> DataFrame:
    """Alerts in three batches into a log, which is compacted in between; the last batch is put in once more."""
    parts, at = _parts(_alerts(spark, d).select(*KEYS, "ts", "anomaly_type", "sensors")), f"{folder(spark)}/log-{uuid.uuid4().hex}"
    put = alertlog.append_alerts(at)
    for n, part in enumerate(parts):
        put(part, n)
        if n == 1:
            alertlog.compacted(spark, at, 1)
    put(parts[-1], len(parts) - 1)
    return alertlog.read_log(spark, at).select(*KEYS, F.col("alert_seq").cast("long").alias("alert_seq"), "alert_id", "earlier", "historical_context")


def _flagged_stream(spark: SparkSession, d: str) -> DataFrame:
    """The flagged readings of three batches, let go by the flags' stream, one table a batch."""
    df = readings.from_events(spark, d)
    fences, at = stored(statistical.fences(df, LIMITS)), f"{folder(spark)}/flags-{uuid.uuid4().hex}"
    # A batch that is run again writes its own folder again.
    keep = lambda out, n: out.write.mode("overwrite").parquet(f"{at}/batch={n}")
    _streamed(spark, {"readings": [*_parts(df), _later(df)]}, lambda s: lookahead.released(s, close_after="30 days"), each=lookahead.flag_batches(keep, lambda: fences))
    return spark.read.parquet(at).where(F.col("station_id") != CLOCK)


@query
def stream_flags(spark: SparkSession, d: str) -> DataFrame:
    return _flagged_stream(spark, d).select(*KEYS, *(x for k in ("missing", "zscore_outlier", "spike", "stuck", "iqr_outlier") for x in _flags(k)), *clean.VALID, "is_all_valid")


@query
def stream_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Gaps filled by a second stream, over what the flags' stream has let go, in three batches of its own."""
    flagged = stored(_flagged_stream(spark, d).select(*KEYS, "ts", *CHANNELS, *clean.VALID, "rn"))
    found, _ = _streamed(spark, {"flagged": [*_parts(flagged), _later(flagged)]}, lambda s: lookahead.filled(s, close_after="30 days"))
    return found.where(F.col("station_id") != CLOCK).select(*KEYS, *(f"{c}_cleaned" for c in CHANNELS))

"""The two whole plans: quality control, and correction with alerting."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygauge.functions.config import CHANNELS, CleaningConfig, KalmanConfig, PhysicsThresholds, StatisticalThresholds
from skygauge.operators import clean, correction, features, health, iforest, kalman, physics, rules, sequence, statistical
from skygauge.plans import chunks
from skygauge.plans.scratch import stored
from skygauge.sources import readings


@dataclass(frozen=True)
class QualityConfig:
    physics: PhysicsThresholds = field(default_factory=PhysicsThresholds)
    statistical: StatisticalThresholds = field(default_factory=StatisticalThresholds)
    cleaning: CleaningConfig = field(default_factory=CleaningConfig)


def checked(df: DataFrame, config: QualityConfig | None = None, fences: DataFrame | None = None) -> DataFrame:
    """Readings with derived quantities and all flags. What a row alone decides is added last, so that shuffles and sorts carry the readings only."""
    config = config or QualityConfig()
    rows = statistical.check(df, config.statistical, known=fences)
    found = physics.check(rows, config.physics)
    first = [*df.columns, *(c for c in found.columns if c not in rows.columns)]
    return found.select(*first, *(c for c in found.columns if c not in first))


def flagged(df: DataFrame, config: QualityConfig | None = None, fences: DataFrame | None = None) -> DataFrame:
    """Readings with derived quantities, all flags and validity. fences: those of a longer history, if df is a part of one."""
    return clean.validity(checked(df, config, fences))


def quality_control(df: DataFrame, config: QualityConfig | None = None, fences: DataFrame | None = None) -> DataFrame:
    """flagged() with the cleaned, imputed channels. The flags are stored, as gaps are looked up by chunk and then by row."""
    config = config or QualityConfig()
    return clean.clean(stored(flagged(df, config, fences)), config.cleaning)


def keyed(df: DataFrame) -> DataFrame:
    """Readings, stored, whose row_id is the row's number in its station, so that it is never null or repeated; their own is kept as _row_id."""
    return stored(chunks.numbered(df.select("station_id", "row_id", "ts", *CHANNELS)).withColumn("_row_id", F.col("row_id")).withColumn("row_id", F.col("rn").cast("long")))


def by_reading(left: DataFrame, right: DataFrame) -> DataFrame:
    """left, all of whose rows stay, with right's other columns; both keyed() readings."""
    named = right.withColumnsRenamed({"station_id": "_s", "row_id": "_r"})
    return left.join(named, F.col("station_id").eqNullSafe(F.col("_s")) & (F.col("row_id") == F.col("_r")), "left").drop("_s", "_r")


def _events(base: DataFrame, config: QualityConfig | None, detectors: bool, forest: iforest.ForestConfig | None, network: sequence.SequenceConfig | None) -> DataFrame:
    known = base if config is None else checked(base, config)
    judged = rules.violations(known, statistical=config is not None).select("station_id", "row_id", "_row_id", "ts", *CHANNELS, "violations")
    if not detectors:
        return rules.fuse(judged)
    isolated = iforest.fit_and_score(stored(features.point_features(base)), forest)[1].select("station_id", "row_id", "iforest_flag", "iforest_conf")
    rebuilt = sequence.fit_and_score(base, network or sequence.SequenceConfig(epochs=25))[1]
    return rules.fuse(by_reading(by_reading(judged, isolated), rebuilt))


def _own_ids(df: DataFrame) -> DataFrame:
    return df.withColumn("row_id", F.col("_row_id")).drop("_row_id")


def detect(df: DataFrame, config: QualityConfig | None = None, forest: iforest.ForestConfig | None = None, network: sequence.SequenceConfig | None = None, detectors: bool = True) -> DataFrame:
    """One fused event a reading, from rules and, unless they are left out, both detectors, which learn from df itself.

    config: thresholds of the flags, if statistical rules are to count too. Keys of readings may be null or repeated.
    """
    return _own_ids(_events(keyed(df), config, detectors, forest, network))


def correct_and_alert(df: DataFrame, references: DataFrame | None = None, config: KalmanConfig | None = None, detectors: bool = True, profiles: DataFrame | None = None, log: DataFrame | None = None) -> dict[str, DataFrame]:
    """corrected (readings with bands and their event), alerts, health and tracked.

    Neither flags nor a date go into the health scores here, and the rules see no statistical
    flags. log: the stored alerts of earlier calls, from which numbers and recurrence go on. What more than one
    of the results needs is stored.
    """
    base = keyed(df)
    if references is not None:
        named = references.select(F.col("station_id").alias("_s"), F.col("row_id").alias("_r"), *(F.col(c).alias(f"_{c}") for c in CHANNELS))
        references = base.select("station_id", "row_id", "_row_id").join(named, F.col("station_id").eqNullSafe(F.col("_s")) & F.col("_row_id").eqNullSafe(F.col("_r"))).select("station_id", "row_id", *(F.col(f"_{c}").alias(c) for c in CHANNELS))
    tracked = stored(kalman.track(base, references, config))
    # What was observed is a column of the estimates, so they needn't be joined to the readings.
    seen = tracked.select("station_id", "row_id", "ts", "rn", *(F.col(f"{c}_observed").alias(c) for c in CHANNELS), *(f"{c}_{k}" for c in CHANNELS for k in ("bias", "true_std", "bias_std", "post_fit_residual")))
    metrics = stored(health.score(health.measures(seen), profiles if profiles is not None else readings.profiles(df.sparkSession)))
    event = _events(base, None, detectors, None, None).select("station_id", "row_id", "_row_id", "is_anomaly", "severity", "anomaly_type", "confidence", "sensors", "recommended_action")
    whole = stored(_own_ids(by_reading(correction.correct(seen), event)).drop("rn"))
    columns = [f"{c}_{k}" for c in CHANNELS for k in ("raw", "corrected", "bias_est", "uncertainty_std", "ci95_lower", "ci95_upper", "ci99_lower", "ci99_upper")]
    corrected = whole.select("station_id", "row_id", "ts", *columns, "is_anomaly", F.col("severity").alias("anomaly_severity"), "anomaly_type", F.col("confidence").alias("anomaly_confidence"))
    return {"corrected": corrected, "alerts": correction.actionable(whole, metrics, log=log), "health": metrics, "tracked": _own_ids(by_reading(tracked, base.select("station_id", "row_id", "_row_id")))}

"""Export of results: CSV, JSON and Parquet, by parallel writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygauge.plans.scratch import stored


def flat(df: DataFrame, separator: str = ", ") -> DataFrame:
    """df as CSV can hold it: arrays of values joined, structs and arrays of structs as JSON."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        if kind.startswith(("struct", "map", "array<struct")):
            c = F.to_json(c)
        elif kind.startswith("array"):
            c = F.array_join(F.transform(c, lambda x: x.cast("string")), separator)
        out.append(c.alias(f.name))
    return df.select(*out)


def to_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    flat(df).write.mode(mode).option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSS").csv(path)


def to_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines with ISO dates, one record each."""
    df.write.mode(mode).option("ignoreNullFields", False).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSS").json(path)


def json_parts(df: DataFrame) -> DataFrame:
    """One JSON array of the records as lines of text (part, place, line), whose order makes it valid: `[` before the first record, a comma before
    each other, `]` after the last. Records are dealt and ordered by nothing but where they are."""
    records = df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS"}).alias("record"))
    placed = stored(records.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}))
    ends = placed.agg(F.min("place").alias("first"), F.max("place").alias("last")).first()
    if ends["first"] is None:
        return df.sparkSession.range(1).select(F.lit(0).alias("part"), F.col("id").alias("place"), F.lit("[]").alias("line"))
    line = F.concat(F.when(F.col("place") == ends["first"], "[").otherwise(","), "record", F.when(F.col("place") == ends["last"], "]").otherwise(""))
    return placed.select("part", "place", line.alias("line"))


def to_json_array(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON array in a folder of text files: put end to end in order of their names they are valid JSON. Each task writes its own part."""
    parts = json_parts(df)
    n = parts.agg(F.max("part")).first()[0] + 1
    parts.repartitionByRange(n, "part", "place").sortWithinPartitions("place").select("line").write.mode(mode).text(path)


def json_array(df: DataFrame, most: int = 10_000) -> str:
    """One JSON array of up to `most` records, for reports; more are an error: to_json_array() writes any number."""
    import json

    rows = df.limit(most + 1).toJSON().collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} records; write them with to_json_array()")
    return json.dumps([json.loads(r) for r in rows], ensure_ascii=False, indent=2)


def to_parquet(df: DataFrame, path: str, mode: str = "overwrite", by: tuple[str, ...] = ()) -> None:
    """Parquet, in folders by the given columns: rows are dealt by them first, so that a folder has few files."""
    (df.repartition(*by).write.partitionBy(*by) if by else df.write).mode(mode).parquet(path)


#: Short names of the channels in the tracking table, and what it has of each; the first channel has more.
SHORT = {"temperature": "temp", "pressure": "pres", "humidity": "rh", "wind_speed": "wind"}
TRACKED = ("true_ground_truth", "observed_drifted", "true_estimated", "bias_ground_truth", "bias_estimated", "post_fit_residual")
TRACKED_MORE = ("true_ground_truth", "observed_drifted", "true_estimated", "true_ci95_lower", "true_ci95_upper", "bias_ground_truth", "bias_estimated", "bias_ci95_lower", "bias_ci95_upper", "innovation", "post_fit_residual")


def tracking_table(tracked: DataFrame, experiment: dict[str, DataFrame]) -> DataFrame:
    """Truth, observation and estimate of a drift experiment side by side, one row a reading, with station and row."""
    from skygauge.operators.kalman import intervals

    keys = ["station_id", "row_id"]
    joined = intervals(tracked).join(experiment["true"].select(*keys, *(F.col(c).alias(f"{c}_truth") for c in SHORT)), keys).join(experiment["biases"].drop("ts"), keys)
    columns = {"true_ground_truth": "truth", "observed_drifted": "observed", "true_estimated": "true", "bias_ground_truth": "true_bias", "bias_estimated": "bias"}
    picked = [F.col(f"{c}_{columns.get(k, k)}").alias(f"{short}_{k}") for c, short in SHORT.items() for k in (TRACKED_MORE if c == "temperature" else TRACKED)]
    return joined.select(*keys, F.col("ts").alias("timestamp"), *picked, "nis")


def exports(frames: dict[str, DataFrame], folder: str, kind: str = "csv") -> list[str]:
    """Each frame under its name in a folder, as csv, json or parquet; their paths."""
    write = {"csv": to_csv, "json": to_json, "parquet": to_parquet}[kind]
    for name, df in frames.items():
        write(df, f"{folder}/{name}")
    return [f"{folder}/{name}" for name in frames]


def quality_exports(controlled: DataFrame) -> dict[str, DataFrame]:
    """What quality control exports: raw and cleaned readings, flags, all of it, and the incident log."""
    from skygauge.operators import clean, report

    keys = ("station_id", "row_id", "ts")
    whole = clean.unified(controlled)
    channels = tuple(SHORT)
    return {"raw": whole.select(*keys, *channels), "cleaned": whole.select(*keys, *(F.col(f"{c}_cleaned").alias(c) for c in channels)), "flags": whole.select(*keys, *(c for c in whole.columns if c.startswith(("flag_", "is_")))),
        "full": whole, "incident_log": report.incidents(controlled)}


def detection_exports(events: DataFrame) -> dict[str, DataFrame]:
    """All fused events, and those that are anomalous."""
    kept = events.drop("violations", "sensors", "lstm_errors")
    return {"hybrid_results": kept, "hybrid_alerts": kept.where("is_anomaly")}


def health_exports(metrics: DataFrame) -> dict[str, DataFrame]:
    """Health metrics, and what needs doing."""
    from skygauge.operators import health

    return {"health_metrics": metrics, "maintenance_alerts": health.maintenance_alerts(metrics)}

"""Streams give what the batch plans give."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from skygauge.functions.config import CHANNELS, StatisticalThresholds
from skygauge.operators import clean, correction, kalman, statistical
from skygauge.plans import telemetry
from skygauge.sources import synthetic
from skygauge.streaming import live, lookahead


@pytest.fixture
def stored(spark, tmp_path):
    df = synthetic.weather(spark, synthetic.WeatherConfig(days=1, minutes=10, stations=2, inject=False))
    for i in range(2):  # two files, in order, so two batches
        df.where((F.col("row_id") >= 72 * i) & (F.col("row_id") < 72 * (i + 1))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in"), df


def finish(stream, path, mode="append"):
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()


def test_kalman_state_goes_on_between_batches(spark, stored, tmp_path):
    path, df = stored
    finish(live.track_stream(live.read_stream(spark, path, files_per_trigger=1)), tmp_path)
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("station_id", "rn").toPandas()
    expected = kalman.track(df).orderBy("station_id", "rn").toPandas()
    assert len(got) == len(expected) == 288
    for c in ("temperature_true", "pressure_bias", "wind_speed_true_std"):
        assert (got[c] - expected[c]).abs().max() < 1e-9


def test_recurrence_state(spark, tmp_path):
    import datetime

    day = datetime.datetime(2026, 3, 1)
    rows = [(0, i, day + timedelta(hours=h), k, s) for i, (h, k, s) in enumerate([(10, "A", ["temperature"]), (12, "A", ["humidity"]), (15, "B", ["humidity"]), (120, "A", ["temperature"])])]
    alerts = spark.createDataFrame(rows, "station_id int, row_id long, ts timestamp, anomaly_type string, sensors array<string>")
    alerts.coalesce(1).write.parquet(f"{tmp_path}/in")
    finish(live.recurrence_stream(spark.readStream.schema(alerts.schema).parquet(f"{tmp_path}/in")), tmp_path)
    got = [r.historical_context for r in spark.read.parquet(f"{tmp_path}/out").orderBy("row_id").collect()]
    assert got == [r.historical_context for r in correction.recurrence(correction.number_alerts(alerts)).orderBy("row_id").collect()]


def test_windows_and_sessions(spark, stored):
    _, df = stored
    counts = {(r.station_id, r.window_start): r.readings for r in live.windowed_counts(df, "2 hours").collect()}
    assert len(counts) == 24 and set(counts.values()) == {12}
    gap = df.where("row_id < 30 OR row_id >= 40")  # 100 minutes without a reading
    spans = sorted((r.station_id, r.session_start, r.readings) for r in live.sessions(gap, "30 minutes").collect())
    start = df.agg(F.min("ts")).first()[0]
    assert spans == [(s, start + timedelta(minutes=m), n) for s in (0, 1) for m, n in ((0, 30), (400, 104))]


def test_copies_within_the_delay_are_dropped(spark, tmp_path, stored):
    _, df = stored
    twice = df.withColumn("row_id", F.col("row_id") + 1000).where("row_id % 3 = 0")
    df.union(twice).repartition(3).write.parquet(str(tmp_path / "twice"))
    finish(live.without_duplicates(live.read_stream(spark, str(tmp_path / "twice"))).select("station_id", "ts"), tmp_path)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert twice.count() > 50 and out.count() == out.distinct().count() == 288


def test_a_stream_of_chunks_is_flagged_and_filled_as_the_whole_history(spark, tmp_path, stored):
    """A spike at the border of two batches; nothing is given twice when a batch is run again."""
    path, df = stored
    odd = df.withColumn("temperature", F.when(F.col("row_id").isin(71, 72, 100), F.col("temperature") + 40).otherwise(F.col("temperature")))
    clock = df.limit(1).withColumns({"station_id": F.lit(-1), "ts": F.col("ts") + F.expr("INTERVAL 90 DAYS")})
    for i, part in enumerate((odd.where("row_id < 72"), odd.where("row_id >= 72"), clock)):
        part.select(*live.READINGS.names).coalesce(1).write.mode("append").parquet(f"{tmp_path}/readings")
    whole = telemetry.quality_control(odd)
    flags = [c for c in whole.columns if c.startswith(("flag_", "is_"))]
    fences = statistical.fences(odd, StatisticalThresholds())

    def keep(out, n):
        for _ in range(2):
            out.write.mode("overwrite").parquet(f"{tmp_path}/flagged/batch={n}")

    chunks = lookahead.released(live.read_stream(spark, f"{tmp_path}/readings", files_per_trigger=1), close_after="1 day")
    chunks.writeStream.foreachBatch(lookahead.flag_batches(keep, lambda: fences)).option("checkpointLocation", f"{tmp_path}/s1").trigger(availableNow=True).start().awaitTermination()
    flagged = spark.read.parquet(f"{tmp_path}/flagged").where("station_id >= 0")
    key = lambda d, *c: sorted(map(tuple, d.select("station_id", "row_id", *c).collect()))
    assert key(flagged, *flags) == key(whole, *flags) and flagged.where("flag_temperature_spike").count() >= 2
    for i in range(2):
        flagged.where(F.col("rn") > 100 if i else F.col("rn") <= 100).select("station_id", "row_id", "ts", *CHANNELS, *clean.VALID, "rn").coalesce(1).write.mode("append").parquet(f"{tmp_path}/f")
    schema = spark.read.parquet(f"{tmp_path}/f").schema
    clock.withColumns({c: F.lit(True) for c in clean.VALID} | {"rn": F.lit(1).cast("long")}).select(*schema.names).coalesce(1).write.mode("append").parquet(f"{tmp_path}/f")
    finish(lookahead.filled(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/f"), close_after="1 day"), tmp_path)
    cleaned = [f"{c}_cleaned" for c in CHANNELS]
    assert key(spark.read.parquet(f"{tmp_path}/out").where("station_id >= 0"), *cleaned) == key(whole, *cleaned)


def test_checks_come_by_a_stream_of_their_own(spark, tmp_path, stored):
    path, df = stored
    checks = df.where("row_id % 20 = 0").select("station_id", "row_id", (F.col("ts") + F.expr("INTERVAL 10 MINUTES")).alias("ts"), *((F.col(c) - 0.5).alias(c) for c in CHANNELS))
    end = lambda d: d.limit(1).withColumns({"station_id": F.lit(-1), "ts": F.col("ts") + F.expr("INTERVAL 9 DAYS")})
    for part in (df, end(df)):
        part.select(*live.READINGS.names).coalesce(1).write.mode("append").parquet(f"{tmp_path}/r")
    for part in (checks, end(checks)):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/c")
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")
    finish(live.track_stream(live.with_references(read("r", live.READINGS), read("c", checks.schema)), watermarked=True), tmp_path)
    got = live.latest(spark.read.parquet(f"{tmp_path}/out").where("station_id >= 0")).orderBy("station_id", "rn").toPandas()
    expected = kalman.track(df, checks).orderBy("station_id", "rn").toPandas()
    assert len(got) == len(expected) == 288 and all((got[c] - expected[c]).abs().max() < 1e-8 for c in ("temperature_bias", "pressure_true", "nis"))

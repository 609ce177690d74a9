"""What keeps plans from growing faster than their input."""

import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skygauge.functions.config import CHANNELS, StatisticalThresholds
from skygauge.operators import correction, rules, statistical
from skygauge.plans import chunks
from skygauge.plans.scratch import stored
from skygauge.sources import synthetic


def longest_method(df):
    """Bytes of the longest method that Spark generates for df; HotSpot compiles none of over 8000."""
    spark, key = df.sparkSession, "spark.sql.adaptive.enabled"
    usual = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        text = spark._jvm.PythonSQLUtils.explainString(df.select("*")._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.set(key, usual)
    return max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", text)))


def test_faults_make_no_method_that_stays_uncompiled(spark):
    config = synthetic.WeatherConfig(days=2, stations=2)
    df = synthetic.weather(spark, config)
    assert longest_method(df) < 8000
    clean = synthetic.weather(spark, synthetic.WeatherConfig(days=2, stations=2, inject=False))
    n, changed = config.steps, {}
    for part, rows, channel, value, added, *_ in synthetic.FAULTS:
        for place in range(int(n * part), int(n * part) + rows):
            changed[place, channel] = (int(n * part), value, added)
    before = {(r["station_id"], r["row_id"]): r for r in clean.collect()}
    for r in df.collect():
        for c in ("temperature", "pressure", "humidity", "wind_speed"):
            first, value, added = changed.get((r["row_id"], c), (None, 0.0, True))
            own = before[r["station_id"], r["row_id"]][c]
            assert r[c] == (before[r["station_id"], first][c] if value == "held" else own + value if added else value), (r, c)


def test_totals_come_with_numbers_and_without_a_shuffle_by_station(spark):
    rows = spark.range(3000).select((F.col("id") % 3).cast("int").alias("station_id"), F.when(F.col("id") < 2999, F.timestamp_seconds(F.col("id") * 600)).alias("ts"), F.col("id").alias("row_id")).where("station_id > 0 OR id < 30")
    got = chunks.numbered(rows, total="steps")
    found = {s: (n, low, high, distinct) for s, n, low, high, distinct in got.groupBy("station_id").agg(F.max("steps"), F.min("rn"), F.max("rn"), F.count_distinct("rn")).collect()}
    assert found == {0: (10, 1, 10, 10), 1: (1000, 1, 1000, 1000), 2: (1000, 1, 1000, 1000)}
    plan = spark._jvm.PythonSQLUtils.explainString(synthetic.axis_of(rows)._jdf.queryExecution(), "simple")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1


def plan_of(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


@pytest.mark.parametrize("robust", [True, False])
def test_flags_of_frames_are_those_of_windows_without_windows(spark, robust):
    limits = StatisticalThresholds(robust=robust, zscore=2.0)
    df = synthetic.weather(spark, synthetic.WeatherConfig(days=2, stations=2))
    df = chunks.in_chunks(df.withColumns({c: F.when(F.col("row_id") % 40 != 0, F.round(c, 1)) for c in CHANNELS})).withColumn("core", F.lit(True))
    got = statistical.row_flags(df, limits)
    assert "Window" not in plan_of(got.drop("rn")).split("FlatMapGroupsInArrow")[0]
    w = Window.partitionBy("station_id", "chunk").orderBy("rn")
    centred, held = w.rowsBetween(-12, 11), w.rowsBetween(-11, 0)
    x = statistical.present("temperature", limits)
    middle = lambda v: F.when(F.count(v).over(centred) >= 6, F.percentile(v, F.lit(0.5)).over(centred))
    mean = F.when(F.count("x").over(centred) >= 6, F.avg("x").over(centred))
    want = df.withColumn("x", x).withColumn("dev", F.abs(F.col("x") - (middle(F.col("x")) if robust else mean)))
    scale = 1.4826 * middle(F.col("dev")) if robust else F.when(F.count("x").over(centred) >= 6, F.stddev_samp("x").over(centred))
    want = want.withColumn("scale", scale).withColumn("z", F.coalesce((F.col("scale") > 0) & (F.try_divide("dev", "scale") > 2.0), F.lit(False)))
    want = want.withColumn("still", F.coalesce((F.count("x").over(held) == 12) & (F.var_samp("x").over(held) <= 1e-6), F.lit(False))).withColumn("s", F.max("still").over(w.rowsBetween(0, 11)))
    keys = ("station_id", "row_id")
    a = {(r[0], r[1]): (r[2], r[3], r[4]) for r in got.select(*keys, *(statistical.flag("temperature", k) for k in ("missing", "zscore_outlier", "stuck"))).collect()}
    b = {(r[0], r[1]): (r[2], r[3], r[4]) for r in want.select(*keys, F.col("x").isNull(), "z", "s").collect()}
    assert a == b and any(v[1] for v in a.values()) and any(v[2] for v in a.values())


def test_fences_shuffle_no_rows_by_station_and_tasks_are_bounded(spark):
    df = synthetic.weather(spark, synthetic.WeatherConfig(days=2, stations=2))
    plan = plan_of(statistical.iqr_flags(df, StatisticalThresholds()))
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
    rows = spark.range(0, 100_000, 10).select((F.col("id") % 2).alias("station_id"), F.col("id").alias("chunk"), F.col("id").alias("rn"), F.when(F.col("id") % 70 == 0, F.col("id")).alias("x"))
    found = chunks.with_neighbours(rows, {"v": F.col("x")})
    assert found.rdd.getNumPartitions() == 10_000 // chunks.TASK_CHUNKS
    assert found.where(F.col("v_prev")["x"] != F.col("rn") - F.col("rn") % 70).isEmpty()


@pytest.mark.parametrize("options", [{}, {"chunk_rows": 7}])
def test_recurrence_by_chunks_and_without_a_row_for_each_alike_kind(spark, options):
    """All of 40 kinds are alike, at times that repeat; log and alerts, and a station without an id."""
    rows = spark.range(800).select(F.when(F.col("id") % 4 > 0, F.lit(1)).alias("station_id"), F.col("id").alias("row_id"), F.timestamp_seconds(F.floor(F.col("id") / 12) * 7200).alias("ts"),
        F.concat(F.lit('é"'), F.col("id") % 40).alias("anomaly_type"), F.array(F.lit("humidity"), F.lit(None)).alias("sensors"))
    log = stored(correction.number_alerts(rows.where("row_id < 200")))
    later = stored(correction.number_alerts(rows.where("row_id >= 200"), log))
    out = correction.recurrence(later, 24, log, **options)
    plan = plan_of(out)
    assert plan.count("Join") == 1 and "REPARTITION_BY_NUM" in plan
    steps = {r: (s, r // 12) for s, r in rows.select("station_id", "row_id").collect()}
    want = {r: sum(s == at[0] and at[1] - 12 <= t and (t, q) < (at[1], r) for q, (s, t) in steps.items()) for r, at in steps.items() if r >= 200}
    assert {r: n for r, n in out.select("row_id", "earlier").collect()} == want and max(want.values()) > 100


def test_kinds_are_alike_by_type_or_sensor_and_null_by_neither():
    made = [correction.json.dumps({"anomaly_type": t, "sensors": s}) for t, s in ((None, None), ("a", ["x", None]), ("a", []), (None, ["x"]), ("b", [None]), (None, []))]
    assert correction._alike(made).astype(int).tolist() == [[0] * 6, [0, 1, 1, 1, 0, 0], [0, 1, 1, 0, 0, 0], [0, 1, 0, 1, 0, 0], [0, 0, 0, 0, 1, 0], [0] * 6]


def test_anomalies_are_chosen_by_one_copy_of_the_rules(spark):
    df = synthetic.weather(spark, synthetic.WeatherConfig(days=2, stations=2))
    share = lambda n: F.when(F.col("row_id") % n > 0, F.col("row_id") % n / n)
    marks = {"iforest_flag": share(3) > 0.5, "iforest_conf": share(7), "lstm_flag": share(5) > 0.5, "lstm_conf": share(11)}
    for found in (rules.fuse(rules.violations(df)), rules.fuse(rules.violations(df).withColumns(marks))):
        plan = found.where("is_anomaly")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Negative wind speed measured") == 2  # one chooses rows, one shows them
        assert found.where("is_anomaly <> (severity <> 'NORMAL') OR is_anomaly IS NULL").isEmpty()
        assert 0 < found.where("is_anomaly").count() < found.count()


@pytest.mark.parametrize("name", ["station_overview", "health_metrics"])
def test_readings_are_flagged_and_numbered_once(spark, monkeypatch, name):
    from skygauge.plans import catalogue

    found, check, numbered = [], statistical.check, chunks.numbered
    monkeypatch.setattr(statistical, "check", lambda *a, **k: found.append("flagged") or check(*a, **k))
    monkeypatch.setattr(chunks, "numbered", lambda df, *a, **k: found.extend(["numbered"] * ("rn" not in df.columns)) or numbered(df, *a, **k))
    assert catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").count() == (4 if name == "station_overview" else 16)
    assert sorted(found) == ["flagged", "numbered"]


def test_a_row_of_each_level_is_looked_for_once(spark):
    df = synthetic.weather(spark, synthetic.WeatherConfig(days=2, stations=2))
    plan = rules.fuse(rules.violations(df))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("= HIGH)") == 1

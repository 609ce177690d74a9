"""Exact quantiles, the forest's samples, the roll-up and JSON written in parts."""

import glob
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skygauge.operators import features, iforest, quantiles, report
from skygauge.plans import telemetry
from skygauge.sources import sinks, synthetic


@pytest.mark.parametrize(("cell", "bins"), [(1 << 15, 1024), (3, 4), (1, 2)])
def test_quantiles_of_groups_against_numpy(spark, cell, bins):
    rng = np.random.default_rng(cell)
    rows = [(g, float(x), None if i % 3 else float(rng.integers(4)), float(np.exp(5 * rng.standard_normal()))) for g, n in ((1, 500), (2, 7), (None, 90), (4, 1)) for i, x in enumerate(rng.standard_normal(n))]
    rows += [(5, None, None, None)] * 3 + [(6, 2.5, 2.5, 1e300), (6, 2.5, 2.5, -1e300)] * 20
    df = spark.createDataFrame(rows, "g int, a double, b double, c double")
    shares = (0.0, 0.25, 0.5, 0.75, 0.999)
    out = {r.g: r for r in quantiles.exact(df, ["g"], {x: F.col(x) for x in "abc"}, shares, cell, bins).collect()}
    frame = pd.DataFrame(rows, columns=["g", *"abc"])
    assert set(out) == {1, 2, None, 4, 5, 6}
    for g, r in out.items():
        own = frame[frame["g"].isna() if g is None else frame["g"] == g]
        for x in "abc":
            values = own[x].dropna().to_numpy()
            assert r[x] is None if not len(values) else np.allclose(r[x], np.quantile(values, shares), rtol=1e-12, atol=0)


def test_a_million_distinct_values(spark):
    df = spark.range(1_000_000).select(F.lit(0).alias("g"), (F.xxhash64("id") / float(1 << 40)).alias("x"))
    want = df.agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.75)))).first()[0]
    assert quantiles.exact(df, ["g"], {"x": F.col("x")}, (0.25, 0.75), cell=2000).first().x == want
    empty = quantiles.exact(df.where("false"), ["g"], {"x": F.col("x")}, (0.25,))
    assert empty.count() == 0 and empty.columns == ["g", "x"]


def test_a_forest_has_its_rows_from_the_whole_table_whatever_the_split(spark):
    points = features.point_features(synthetic.weather(spark, synthetic.WeatherConfig(days=3, minutes=5))).select("station_id", "row_id", *features.FEATURES)
    points = spark.createDataFrame(points.toPandas())
    config = iforest.ForestConfig(trees=20, max_samples=64)
    one, many = (iforest.fit(points.repartition(n), config) for n in (1, 9))
    assert one.samples == many.samples == 64 and len(one.trees) == 20
    assert all(len(a) == len(b) and np.allclose(a, b, rtol=1e-9) for x, y in zip(one.trees, many.trees, strict=True) for a, b in zip(x, y, strict=True))  # means differ by rounding
    # A tree's rows: those with the least hashes, so all rows have their chance and trees differ.
    rows = points.select(F.xxhash64(F.lit(config.seed), "station_id", "row_id", *features.FEATURES).alias("row"), *features.FEATURES)
    found = rows.mapInPandas(lambda it: iforest._least(it, config), iforest.SAMPLES).toPandas()
    merged = [iforest._merged(g, 64) for _, g in found.groupby("tree")]
    assert len({h.tobytes() for h, _ in merged}) == 20 and all((np.diff(h.astype(float)) >= 0).all() and len(h) == 64 for h, _ in merged)
    seen = {r.tobytes() for _, x in merged for r in x}
    assert len(seen) > 0.6 * points.count()  # 20 trees of 64 of 864 rows: 78 % expected
    assert iforest.fit(points.where("false"), config) is None and iforest.fit(points.limit(1), config).samples == 1


def test_roll_up_adds_up(spark):
    df = telemetry.flagged(synthetic.weather(spark, synthetic.WeatherConfig(days=2, stations=3)))
    out = {(r.level, r.station_id, r.sensor): r for r in report.roll_up(df).collect()}
    assert len(out) == 12 + 3 + 1 and out[3, None, None].readings == 4 * df.count()
    for k in ("readings", "missing", "physics", "statistical"):
        assert out[3, None, None][k] == sum(r[k] for (level, *_), r in out.items() if level == 1) == sum(r[k] for (level, *_), r in out.items() if level == 0)


@pytest.mark.parametrize("parts", [1, 5])
def test_a_json_array_is_written_by_its_tasks(spark, tmp_path, parts):
    rows = [(i, 'a "quoted"\n], [' if i % 2 else None, [1.5, None], {"k": i}) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, `a.b` string, x array<double>, m map<string,long>").repartition(parts)
    sinks.to_json_array(df, str(tmp_path / "j"))
    text = "".join(open(f).read() for f in sorted(glob.glob(f"{tmp_path}/j/part-*")))
    assert sorted(json.loads(text), key=lambda r: r["id"]) == [{"id": i, "a.b": b, "x": x, "m": m} for i, b, x, m in rows]
    sinks.to_json_array(df.where("false"), str(tmp_path / "none"))
    assert json.loads("".join(open(f).read() for f in glob.glob(f"{tmp_path}/none/part-*"))) == []
    with pytest.raises(ValueError):
        sinks.json_array(df, most=10)

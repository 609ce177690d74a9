"""Columns of any name and type through the stages that keep them."""

import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from skygauge.llm import mixing, quality, simhash, suffixdedup
from skygauge.llm.carry import packed, unpacked

SCHEMA = """`doc_id` long, `text` string, `lang` string, `source` string, `n_chars` long, `a.b` string, `m` map<int,string>, `Kept` binary, `row` struct<x:map<date,array<double>>,`y.z`:timestamp>,
    `size` decimal(20,3), `id` array<map<string,int>>, `copies` date, `take` float, `x` boolean"""


def rows(texts):
    day, at = datetime.date(2024, 2, 29), datetime.datetime(2024, 1, 2, 3, 4, 5, 678901)
    full = lambda i, t: (i, t, "en", "s", 1, "d.t", {1: "a", 2: None}, b"\x00\xff", ({day: [1.5, None]}, at), Decimal("1.125"), [{"k": 1}, {}], day, 0.1, True)
    return [full(i, t) if i % 2 == 0 else (i, t, *[None] * 12) for i, t in enumerate(texts)]


def test_packed_columns_come_back(spark):
    df = spark.createDataFrame(rows(["one", "two"]), SCHEMA)
    again = df.select(packed(df, df.columns).alias("p")).select(*(v.alias(k) for k, v in unpacked("p", df, df.columns).items()))
    assert again.collect() == df.collect() and [f.dataType for f in again.schema] == [f.dataType for f in df.schema]


def test_stages_keep_columns_of_any_name_and_type(spark, stored):
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(6)] + [None, ""]
    df = stored(spark.createDataFrame(rows(texts), SCHEMA))
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    key = lambda d: sorted((repr(r) for r in d.collect()))
    assert quality.quality_filter(df, labels).columns == df.columns
    assert key(simhash.keep_first(df.where("text <> ''"), similarity=0.8)) == key(df.where("text <> ''"))
    assert key(suffixdedup.without_repeats(df)) == key(df.withColumn("text", F.coalesce("text", F.lit(""))))
    mixed = mixing.repeat_rows(df, mixing.mix(df))
    assert mixed.columns == df.columns and set(key(mixed)) <= set(key(df))

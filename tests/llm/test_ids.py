"""Ids beyond 2^53 stay exact next to a null one, and names of other columns don't matter."""

import numpy as np
from pyspark.sql import functions as F

from skygauge.llm import bpe, mixing, packing, simhash, suffixdedup
from skygauge.llm.queries import tokenizer_path

LARGE = [(1 << 60) + 1, (1 << 60) + 3, -(1 << 55) - 1]
ROWS = [(i, f"some words for number {k} of these") for k, i in enumerate([*LARGE, None])]


def ids_of(rows):
    return sorted((r.doc_id for r in rows), key=lambda x: (x is None, x))


def test_large_ids_beside_a_null(spark, docs, stored):
    df, expected = stored(docs(ROWS).coalesce(1)), [*sorted(LARGE), None]
    assert ids_of(bpe.encode_and_decode(df, tokenizer_path()).collect()) == expected
    assert ids_of(mixing.mix(df).collect()) == expected
    assert ids_of(suffixdedup.remove_repeats(df).collect()) == expected
    packed = packing.pack(df, tokenizer_path("byte_bpe_50k.tiktoken")).collect()
    assert sorted((x for r in packed for x in r.doc_ids), key=lambda x: (x is None, x)) == expected
    assert sum(len(np.frombuffer(r.input_ids, "<u4")) for r in packed) == 2048 * len(packed)


def test_clashing_names(spark, docs):
    df = docs([(1, "a b c d"), (2, "a b c d"), (3, "another text of words")])
    names = ("kept_id", "_copies", "_same", "_id", "component_id", "id", "no_id")
    df = df.select("*", *(F.lit("x").alias(n) for n in names))
    kept = simhash.keep_first(df)
    assert ids_of(kept.collect()) == [1, 3] and kept.columns == df.columns
    made = mixing.repeat_rows(df, mixing.mix(df))
    assert made.columns == df.columns and {r._copies for r in made.collect()} == {"x"}

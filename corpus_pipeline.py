"""The corpus pipeline: each stage works on what its predecessor kept, written as Parquet between.

Quality rules reject documents; of near duplicates the one with the smallest id stays;
substrings that an earlier document has are cut out, and a document goes if nothing is left
of it; each remaining document is repeated or dropped as the mix of sources asks; and all
are encoded, decoded and digested. All but the last stage return the columns of documents.

Nulls: a null text has no words, so the quality rules reject it; a null id ranks after all
others; a null source is a source of its own, the last by name; other columns may hold nulls
and are passed on. Empty texts go the way of null ones. Very long texts are worked on whole,
by each stage in pieces or blocks of its own. Ties: of near copies the smallest id stays, of
those that share it the text with the least hash, of equal rows one. Repeated rows are copies
of each other, so one stays. An empty table gives an empty result. Extra columns of any type
and name, also of names that the operators use inside, come out of all stages but the last as
they were (n_chars is counted anew in the stage that cuts texts).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skygauge.llm import bpe, mixing, quality, simhash, suffixdedup
from skygauge.llm.common import materialize, table
from skygauge.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_filter(docs, table(spark, sf_dir, "labels"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs, similarity=0.8)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts may part a character; its remaining bytes go too. n_chars is counted anew. Each stage reads stored files, so docs is stable."""
    return suffixdedup.without_repeats(docs, count_col="n_chars", stable=True)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_rows(docs, mixing.mix(docs))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = bpe.encode_and_decode(docs, tokenizer_path(), stable=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("SimHash near-dedup", simhash_stage),
    ("suffix-array dedup", suffix_stage),
    ("mixing sources to target weights", mixing_stage),
    ("BPE encoding and decoding", bpe_stage),
]

#: Binomial cutoffs, induced suffix order and Newton steps have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs

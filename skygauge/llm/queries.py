"""The registered query of each corpus operator: thin, over whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skygauge.llm import bpe, chat, embdedup, langid, linededup, mixing, packing, quality, runs, simhash, suffixdedup, toxicity, whitening
from skygauge.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = linededup.remove_repeated_units(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.zip_with("starts", "ends", lambda a, b: F.concat(a.cast("string"), F.lit(":"), b.cast("string"))), ",")
    return cut.select("doc_id", "n_kept", "n_removed", "n_units", F.size("starts").cast("long").alias("n_spans"), spans.alias("spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the environment keeps the byte-level vocabulary; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_and_decode(table(spark, sf_dir, "documents"), tokenizer_path(), stable=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "rate")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixdedup.remove_repeats(table(spark, sf_dir, "documents"), stable=True)
    removed = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chat.replies(table(spark, sf_dir, "conversations"))
    digests = [F.sha2(x, 256).alias(f"{x}_sha256") for x in ("prompt", "chosen", "rejected")]
    return made.select("pair_id", "chosen_id", "rejected_id", "n_prompt_turns", *digests, "chosen_mask", "rejected_mask")


def op10_pack_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))
    return packed.select("block", "row", "n_tokens", "doc_ids", "piece_starts", "cu_seqlens", F.sha2("input_ids", 256).alias("ids_sha256"), F.sha2("position_ids", 256).alias("positions_sha256"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(table(spark, sf_dir, "documents"), rearranged=runs.planted_tail)
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    longest = runs.longest("runs")
    exponent = F.floor(1000 * longest["length"] / longest["period"]).cast("long")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *(longest[x].alias(x) for x in ("start", "length", "period")), exponent.alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_simhash": op2_simhash,
    "op3_line_dedup": op3_line_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_bpe_round_trip": op5_bpe_round_trip,
    "op6_mix_sources": op6_mix_sources,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_preference_format": op9_preference_format,
    "op10_pack_tokens": op10_pack_tokens,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_toxicity": op12_toxicity,
    "op13_embedding_whitening": op13_embedding_whitening,
}

ORACLES: dict[str, str] = {
    "op3_line_dedup": linededup.SQL,
    "op9_preference_format": chat.SQL,
}

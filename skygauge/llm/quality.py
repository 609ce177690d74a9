"""Quality rules whose cutoffs carry a guarantee on false rejection.

Each rule scores a document with a ratio, higher being worse, and rejects it above a cutoff. Cutoffs are
set for each stratum on labelled documents that pass the base rule, in two steps:

1. A third of them (by a hash of the id) shapes the walk: a rule's unit is the score that all but
   a small share of their good documents stay under. At level t every rule rejects above t units,
   so one number says how strict all rules together are, and a rule that good documents
   score high on is wide.
2. The others, the holdout, test levels from the mildest to the strictest. At each the
   hypothesis "all rules together reject more than alpha of the good documents" must be
   refuted by the exact binomial tail; the walk stops at the first level that isn't (fixed-sequence
   testing). The error level is delta over the number of walks (Bonferroni). So with
   probability 1 - delta no stratum loses more than alpha of its good documents, whichever of the
   tested levels is taken: it is the one that catches most bad ones, rejected good ones counting ten times.

No stratum is left out by a fixed size: the exact bound decides. Strata whose holdout could not
refute the hypothesis even with no rejection share one pooled stratum, whose guarantee is for
their good documents together. Strata without a labelled good document, and any whose walk passes no level
or catches nothing, keep what passes the base rule.

Nulls and corners: a null text counts as empty (no words, so base_failed); a null stratum is
a stratum of its own; null labels are ignored; of several labels for one document the lowest
counts; documents with the same id share its labels; repeated rows are rows of their own. A very long text is held whole by one
task, its words by number. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skygauge.llm.common import materialize, schema, text_batches, utf8

#: The characters counted as symbols, and the words of a repeated window.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Bytes of a text whose words are numbered at a time.
PIECE = 1 << 22

METRICS = schema("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long")


@dataclass(frozen=True)
class QualityConfig:
    """alpha: the most of a stratum's good documents that all rules together may reject. delta: the chance that any stratum loses more.

    levels: what is tested, in units, from the mildest on. least_unit: a rule's unit at least.
    """

    alpha: float = 0.05
    delta: float = 0.05
    min_words: int = 10
    max_repeat_percent: int = 20
    levels: tuple[float, ...] = field(default_factory=lambda: tuple(2.0 ** (k / 4) for k in range(12, -13, -1)))
    least_unit: float = 0.02


def repeated_words(ids: np.ndarray) -> int:
    """How many positions lie in a five-word window that occurs twice or more in the text."""
    n = len(ids)
    if n <= WINDOW:
        return 0

    def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)[1]

    two = joined(ids[:-1], ids[1:])
    four = joined(two[:-2], two[2:])
    five = joined(four[:-1], ids[4:])
    starts = np.flatnonzero(np.bincount(five)[five] > 1)
    if not len(starts):
        return 0
    edge = np.zeros(n + 1, dtype=np.int64)
    edge[starts] += 1
    edge[starts + WINDOW] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


def word_numbers(data: bytes) -> np.ndarray:
    """A number for each word, equal for equal words. Words are taken from pieces, so that few are held as objects."""
    names: dict[bytes, int] = {}
    out, at = [], 0
    while at < len(data):
        end = at + PIECE
        while end < len(data) and data[end : end + 1].strip():
            end += 1
        words = data[at:end].split()  # bytes split at the six ASCII white-space characters only
        out.append(np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words)))
        at = end
    return np.concatenate([*out, np.zeros(0, np.int64)])


def measure(text: str | None) -> tuple[int, ...]:
    """METRICS of one text, all of it."""
    data = utf8(text)
    ids = word_numbers(data)
    if not len(ids):
        return (0,) * 7
    text = text or ""
    chars = len(text) - sum(map(text.count, " \t\n\r\x0b\x0c"))
    lines = [x for x in data.split(b"\n") if x.strip()]
    upper = len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return len(ids), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(ids), len(lines), upper


@F.pandas_udf(METRICS)
def text_metrics(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(x) for x in texts], columns=METRICS.names, dtype="int64")


def base_failed(m: str, config: QualityConfig) -> Column:
    words = F.col(f"{m}.n_words")
    return (words < config.min_words) | (100 * F.col(f"{m}.n_repeat_words") > config.max_repeat_percent * words)


def rule_scores(m: str) -> dict[str, Column]:
    """What each rule measures, from 0 up; higher is worse."""
    chars, words, lines = (F.greatest(F.col(f"{m}.{x}"), F.lit(1)).cast("double") for x in ("word_chars", "n_words", "n_lines"))
    return {
        "symbols": F.col(f"{m}.n_symbols") / chars,
        "capitals": F.col(f"{m}.n_upper") / chars,
        "dup_lines": F.col(f"{m}.n_dup_lines") / lines,
        "repeats": F.col(f"{m}.n_repeat_words") / words,
    }


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial, summed exactly in logarithms."""
    if k >= n:
        return 1.0
    if not 0 < p < 1:
        return float(p <= 0)
    i = np.arange(k + 1)
    logs = np.concatenate([[0.0], np.cumsum(np.log(n - i[:-1]) - np.log(i[:-1] + 1.0))]) + i * math.log(p) + (n - i) * math.log1p(-p)
    top = logs.max()
    return min(1.0, float(np.exp(logs - top).sum() * math.exp(top)) if top > -700 else 0.0)


def upper_bound(k: int, n: int, delta: float) -> float:
    """The exact one-sided upper confidence limit of a proportion, k of n seen."""
    if n == 0 or k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if binomial_tail(k, n, middle) > delta else (low, middle)
    return high


def least_holdout(walks: int, config: QualityConfig) -> int:
    """How many good documents a holdout needs so that no rejection among them refutes the hypothesis."""
    return math.ceil(math.log(config.delta / max(1, walks)) / math.log1p(-config.alpha))


def walk(good: np.ndarray, bad: np.ndarray, walks: int, config: QualityConfig) -> dict | None:
    """The level to take, with its figures. good and bad: documents by how many of the levels they exceed, 0 to all.

    None if no level passes or none that does catches a bad document.
    """
    n, best = int(good.sum()), None
    over_good, over_bad = (np.cumsum(x[::-1])[::-1][1:] for x in (good, bad))  # at place i: documents that exceed i + 1 levels or more
    for i in range(len(config.levels)):
        # Levels fall, so what exceeds level i exceeds all stricter ones: at least len - i of them.
        k, caught = int(over_good[len(config.levels) - 1 - i]), int(over_bad[len(config.levels) - 1 - i])
        if not n or binomial_tail(k, n, config.alpha) > config.delta / walks:
            break
        gain = caught / max(1, int(bad.sum())) - 10 * k / n
        if caught and (best is None or gain > best[0]):
            best = (gain, {"level": config.levels[i], "n_good": n, "n_rejected": k, "bound": upper_bound(k, n, config.delta / walks), "n_bad": int(bad.sum()), "n_bad_caught": caught})
    return best and best[1]


def calibrate(scored: DataFrame, labels: DataFrame, config: QualityConfig) -> DataFrame:
    """For each stratum with labelled good documents that has cutoffs: stratum, pooled, the cutoff of each rule, and figures of its walk.

    scored: doc_id, stratum, base_ok, and a column for each rule. Everything is grouped by
    stratum in Spark; one number, how many walks there are, comes to the driver.
    """
    rules = [c for c in scored.columns if c not in ("doc_id", "stratum", "base_ok")]
    judged = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("d")).agg(F.min("quality").alias("good"))
    shapes = F.pmod(F.xxhash64(F.lit("shape"), "doc_id"), F.lit(3)) == 0
    held = materialize(scored.where("base_ok").join(judged, F.col("doc_id") == F.col("d")).select("stratum", F.col("good") == 1, shapes.alias("shapes"), *rules).toDF("stratum", "good", "shapes", *rules))
    strata = materialize(held.where("good").groupBy(F.col("stratum").alias("s")).agg(F.count_if(~F.col("shapes")).alias("n")))
    walks = strata.where(F.col("n") >= least_holdout(1, config)).count() + 1
    alone = F.col("n") >= least_holdout(walks, config)
    # Of a stratum on its own, and of the pool, the key is (pooled, stratum or null).
    own = strata.select("s", (~alone).alias("pooled"), F.when(alone, F.col("s")).alias("part"))
    placed = held.join(own, F.col("stratum").eqNullSafe(F.col("s")))
    share = 1 - config.alpha / (2 * len(rules))
    units = placed.where("good AND shapes").groupBy(F.col("pooled").alias("p"), F.col("part").alias("q")).agg(
        *(F.greatest(F.lit(config.least_unit), F.percentile(F.round(r, 4), F.lit(share))).alias(f"unit_{i}") for i, r in enumerate(rules)))
    joined = placed.where("NOT shapes").join(units, (F.col("pooled") == F.col("p")) & F.col("part").eqNullSafe(F.col("q")))
    score = F.greatest(*(F.col(r) / F.col(f"unit_{i}") for i, r in enumerate(rules)), F.lit(0.0))
    over = sum((F.when(score > x, 1).otherwise(0) for x in config.levels), F.lit(0))
    counts = joined.groupBy("pooled", "part", over.alias("over"), *(f"unit_{i}" for i in range(len(rules)))).agg(F.count_if("good").alias("n_good"), F.count_if(~F.col("good")).alias("n_bad"))
    size = len(config.levels) + 1

    def decide(group: pd.DataFrame) -> pd.DataFrame:
        """Of a stratum's counts, at most one row for each number of levels."""
        good, bad = np.zeros(size, np.int64), np.zeros(size, np.int64)
        good[group["over"]], bad[group["over"]] = group["n_good"], group["n_bad"]
        found = walk(good, bad, walks, config)
        if found is None:
            return pd.DataFrame(columns=names)
        cutoffs = [found["level"] * group[f"unit_{i}"].iloc[0] for i in range(len(rules))]
        return pd.DataFrame([(group["pooled"].iloc[0], group["part"].iloc[0], *cutoffs, *(found[k] for k in names[2 + len(rules) :]))], columns=names)

    names = ["pooled", "part", *rules, "level", "n_good", "n_rejected", "bound", "n_bad", "n_bad_caught"]
    kinds = ["boolean", "string", *("double" for _ in rules), "double", "long", "long", "double", "long", "long"]
    chosen = counts.withColumn("part", F.col("part").cast("string")).groupBy("pooled", "part").applyInPandas(decide, schema(", ".join(map(" ".join, zip(names, kinds, strict=True)))))
    found = chosen.select(F.col("pooled").alias("p"), F.col("part").alias("q"), *names[2:])
    return materialize(own.join(found, (F.col("pooled") == F.col("p")) & F.col("part").cast("string").eqNullSafe(F.col("q"))).select(F.col("s").alias("stratum"), "pooled", *names[2:]))


def _judged(measured: DataFrame, metrics: str, id_col: str, stratum_col: str, labels: DataFrame, config: QualityConfig) -> DataFrame:
    """measured with two columns more, _base_failed and _kept. The cutoffs have a row for each labelled stratum and join by size."""
    scores, failed = rule_scores(metrics), base_failed(metrics, config)
    cutoffs = calibrate(measured.select(F.col(id_col).alias("doc_id"), F.col(stratum_col).alias("stratum"), (~failed).alias("base_ok"), *(v.alias(k) for k, v in scores.items())), labels, config)
    cutoffs = cutoffs.select(F.col("stratum").alias("_stratum"), *(F.col(r).alias(f"_cut_{r}") for r in scores))
    joined = measured.join(cutoffs, F.col(stratum_col).eqNullSafe(F.col("_stratum")), "left")
    bad = F.lit(False)
    for rule, value in scores.items():
        bad = bad | F.coalesce(value > F.col(f"_cut_{rule}"), F.lit(False))
    return joined.withColumns({"_base_failed": failed, "_kept": ~failed & ~bad})


def quality_verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", config: QualityConfig | None = None) -> DataFrame:
    """One row for each document: its metrics, base_failed and kept."""
    text_batches(docs.sparkSession)
    measured = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(stratum_col).alias("stratum"), text_metrics(F.col(text_col)).alias("m")))
    found = _judged(measured, "m", "doc_id", "stratum", labels, config or QualityConfig())
    return found.select("doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", config: QualityConfig | None = None) -> DataFrame:
    """The documents that quality_verdicts keeps, with all their columns.

    Texts are measured once and stored with their metrics; none is shuffled.
    """
    text_batches(docs.sparkSession)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    measured = materialize(docs.select(row, text_metrics(F.col(text_col)).alias("m")))
    return _judged(measured, "m", f"row.{id_col}", f"row.{stratum_col}", labels, config or QualityConfig()).where("_kept").select("row.*")

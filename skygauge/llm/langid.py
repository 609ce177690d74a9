"""Language identification with averaged hashed subword embeddings.

A text's subwords are the character n-grams of its lower-cased letter runs, with word ends
marked; each hashes to one of BUCKETS embeddings, a text is the mean of its subwords'
embeddings, and a linear softmax on that mean gives the language. Embeddings and softmax are
trained together by stochastic gradient descent in numpy on a bounded sample of labelled
rows (max_docs of them, divided evenly among the languages, chosen by a hash). A quarter of the sample isn't
trained on: it sets the softmax temperature, so that scores are probabilities, and the
score under which a prediction is marked as rejected.

As the model is linear in the mean, embeddings times softmax weights are one table of
BUCKETS x languages, of fixed size for given languages, which goes to the workers.

A null text, or one without letters, gets `und` with score 0. With no labelled rows every
text does. With one language every text with letters gets it. A null id belongs to the rows
that may be learned from. Repeated rows each give a row. Only named columns are read; of
them only the text enters a prediction. A very long text is read whole, in pieces of PIECE
characters: a word that a piece's end parts counts as two. An empty table gives no rows. Ties between languages go to
the first by name.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skygauge.llm.common import schema, text_batches

BITS = 15
BUCKETS = 1 << BITS
GRAMS = (1, 2, 3, 4)
PIECE = 1 << 20
UNKNOWN = "und"


@dataclass(frozen=True)
class LangIdConfig:
    max_docs: int = 1600
    dimension: int = 16
    epochs: int = 12
    min_steps: int = 400
    batch: int = 16
    rate: float = 4.0
    accepted_accuracy: float = 0.99
    seed: int = 7


@dataclass
class LangIdModel:
    """table: for each bucket its embedding times the softmax weights."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    cutoff: float = 0.0

    def logits(self, text: str) -> np.ndarray | None:
        total, n = np.zeros(len(self.languages)), 0
        for buckets in subwords(text):
            total += np.take(self.table, buckets, axis=0).sum(axis=0, dtype=np.float64)
            n += len(buckets)
        return total / n + self.bias if n else None

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        x = self.logits(text) if isinstance(text, str) and self.languages else None
        if x is None:
            return UNKNOWN, 0.0, True
        p = softmax(x[None, :] / self.temperature)[0]
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] < self.cutoff)


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def subwords(text: str) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of all letter runs, in pieces of bounded size."""
    letters = _letters()
    for at in range(0, len(text), PIECE):  # a piece's ends count as word ends
        codes = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), "<u4")
        codes = np.concatenate([[0], np.where(letters[codes], codes, 0), [0]]).astype(np.uint64)
        codes = codes[np.concatenate([[True], (codes[1:] | codes[:-1]) != 0])]
        inside, out, value = codes != 0, [], np.zeros(len(codes), np.uint64)
        for n in range(1, max(GRAMS) + 1):
            m = len(codes) - n + 1
            if m <= 0:
                break
            value = value[:m] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(1)
            whole = inside if n == 1 else np.ones(m, bool)
            for k in range(1, n - 1):
                whole = whole & inside[k : k + m]
            if n in GRAMS:
                out.append(((value[whole] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32))
        found = np.concatenate([*out, np.zeros(0, np.int32)])
        if inside.any():
            yield found


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def bag(text: str | None) -> tuple[bytes, bytes] | None:
    """A text's distinct buckets and their shares: at most BUCKETS of each, however long it is."""
    counts = np.zeros(BUCKETS)
    for buckets in subwords(text) if isinstance(text, str) else ():
        counts += np.bincount(buckets, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return (at.astype("<u2").tobytes(), (counts[at] / counts.sum()).astype("<f4").tobytes()) if len(at) else None


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n: int, config: LangIdConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, softmax weights and bias after the given epochs of SGD, or more for min_steps."""
    rng = np.random.default_rng(config.seed)
    embed = rng.uniform(-1, 1, (BUCKETS, config.dimension)).astype(np.float32) / config.dimension
    weight, bias = np.zeros((config.dimension, n), np.float32), np.zeros(n, np.float32)
    batches = max(1, -(-len(bags) // config.batch))
    epochs = max(config.epochs, -(-config.min_steps // batches))
    steps, step = epochs * batches, 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), config.batch):
            rows = order[i : i + config.batch]
            used, inverse = np.unique(np.concatenate([bags[r][0] for r in rows]), return_inverse=True)
            x = np.zeros((len(rows), len(used)), np.float32)
            x[np.repeat(np.arange(len(rows)), [len(bags[r][0]) for r in rows]), inverse] = np.concatenate([bags[r][1] for r in rows])
            mean = x @ embed[used]
            error = softmax(mean @ weight + bias)
            error[np.arange(len(rows)), labels[rows]] -= 1
            error *= config.rate * (1 - step / steps) / len(rows)
            back = error @ weight.T
            weight -= mean.T @ error
            bias -= 0.1 * error.sum(axis=0)
            embed[used] -= x.T @ back * len(rows)  # a mean over thousands of subwords has small gradients
            step += 1
    return embed, weight, bias


def calibrate(logits: np.ndarray, labels: np.ndarray, accuracy: float) -> tuple[float, float]:
    """The temperature with the least log loss; the lowest score from which that accuracy holds."""
    if not len(labels):
        return 1.0, 0.0
    loss = lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean()
    temperature = min(np.geomspace(0.25, 20, 45), key=loss)
    p = softmax(logits / temperature)
    order = np.argsort(-p.max(axis=1), kind="stable")
    right = (p.argmax(axis=1) == labels)[order]
    good = np.flatnonzero(np.cumsum(right) >= accuracy * np.arange(1, len(right) + 1))
    return float(temperature), float(p.max(axis=1)[order][good[-1]]) if len(good) else 1.0


def fit(rows: DataFrame, config: LangIdConfig | None = None) -> LangIdModel:
    """A model learned from rows: doc_id, text, lang. No more than 2 * max_docs bags reach the driver."""
    config = config or LangIdConfig()
    counts = {r["lang"]: r["count"] for r in rows.where("lang is not null and text is not null").groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return LangIdModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    place = F.xxhash64(F.lit(config.seed), "doc_id", "text")
    share = F.element_at(F.create_map(*(F.lit(x) for k in languages for x in (k, min(1.0, config.max_docs / len(languages) / counts[k])))), F.col("lang"))
    spread = (place.bitwiseAND(F.lit((1 << 31) - 1)) / float(1 << 31)) < share
    make = F.pandas_udf(lambda s: pd.DataFrame([bag(x) or (b"", b"") for x in s], columns=["at", "share"]), schema("at binary, share binary"))
    sample = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & spread).select("lang", "doc_id", place.alias("place"), "text")
    found = sample.select("lang", "place", make("text").alias("bag")).orderBy("place", "lang").limit(2 * config.max_docs).collect()
    found = [r for r in found if r["bag"]["at"]]
    bags = [(np.frombuffer(r["bag"]["at"], "<u2").astype(np.int64), np.frombuffer(r["bag"]["share"], "<f4")) for r in found]
    labels = np.array([languages.index(r["lang"]) for r in found], dtype=int)
    held = np.arange(len(bags)) % 4 == 3
    own = np.flatnonzero(~held)
    embed, weight, bias = train([bags[i] for i in own], labels[own], len(languages), config)
    model = LangIdModel(languages, embed @ weight, bias.astype(np.float64))
    logits = np.array([model.table[bags[i][0]].T @ bags[i][1] + bias for i in np.flatnonzero(held)]).reshape(-1, len(languages))
    model.temperature, model.cutoff = calibrate(logits, labels[held], config.accepted_accuracy)
    return model


def predict(docs: DataFrame, model: LangIdModel, text_col: str = "text") -> Column:
    """A column of lang_pred, score and rejected."""
    text_batches(docs.sparkSession)

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(x) for x in texts], columns=["lang_pred", "score", "rejected"])

    return F.pandas_udf(run, schema("lang_pred string, score double, rejected boolean"))(F.col(text_col))


def is_held_out(id_col: str = "doc_id") -> Column:
    """Documents that are never learned from: a quarter, by the CRC-32 of their id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", config: LangIdConfig | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected for each document, learned from those not held out."""
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = fit(rows.where(~is_held_out()), config)
    return rows.select("doc_id", is_held_out().alias("held_out"), predict(rows, model).alias("p")).select("doc_id", "held_out", "p.*")

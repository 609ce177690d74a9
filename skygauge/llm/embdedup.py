"""Near-duplicate embeddings by binary codes of random rotations.

A unit vector is turned by a random orthogonal matrix; the signs of the turned vector are its
binary code. Stored once with each code are the correction factor f, the inner product of the turned vector and
its code scaled to length one, and the turned vector itself in 4-bit steps with fixed random dither. For a code c of
vector o and a dithered vector q, <c, q> / f is an unbiased estimate of <o, q>, with standard error
sqrt((1 - f^2) / f^2 * (1 - <o, q>^2) / (D - 1)) for the code and step / (2 f) at most for the dither.

Candidates: runs of code bits, over as many rotations as needed, are bucket keys. Two vectors at the
threshold's angle agree in one bit with a known probability, so with b bits a key, as many bands are used as
give the wanted recall at the threshold (closer pairs are found more surely). b grows with the
logarithm of the number of vectors, which keeps unrelated vectors to about two dozen a bucket.

Buckets hold codes alone, under 60 bytes for 64 dimensions. A pair whose estimate plus `sigmas` standard
errors at the threshold stays under the threshold is cut there; vectors left with no partner in a bucket go no
further. The others' vectors are fetched, and the pairs that were left are recomputed exactly, in double
precision. Only the exact cosine makes a link.

A pair counts in the first band where its keys agree, and there only. So buckets need not
list their pairs: each returns how many links each vector has got, and a spanning forest of its
links. Buckets over `bucket_rows` are cut into groups by hash and compared by pairs of groups in
separate tasks. Equal vectors are one class; copies count towards links without being
paired. Classes are told apart by 128 bits of hash.

Null vectors, empty ones, those with null, NaN or infinite components and zero vectors link
with nothing. Vectors of different lengths never link; under 16 dimensions the bounds don't hold and no pair is cut. Repeated rows and ids are vectors
of their own, equal ones linked with each other. A null id is a row like others (its
component is the smallest id that isn't null). Only the named columns are read. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygauge.llm.common import materialize, schema
from skygauge.llm.components import components


@dataclass(frozen=True)
class EmbeddingConfig:
    threshold: float = 0.95
    recall: float = 0.97
    min_bits: int = 8
    bucket_bits: int = 5
    sigmas: float = 4.0
    bucket_rows: int = 2048
    seed: int = 20


@functools.lru_cache(maxsize=8)
def rotations(dimension: int, count: int, seed: int) -> np.ndarray:
    """count random orthogonal matrices, side by side."""
    out = []
    for i in range(count):
        q, r = np.linalg.qr(np.random.default_rng([seed, dimension, i]).standard_normal((dimension, dimension)))
        out.append(q * np.sign(np.diag(r)))
    return np.concatenate(out, axis=1)


def bands_for(n: int, config: EmbeddingConfig) -> tuple[int, int]:
    """Bits a key and number of bands for n vectors."""
    bits = min(40, max(config.min_bits, math.ceil(math.log2(max(2, n))) - config.bucket_bits))
    agree = 1 - math.acos(config.threshold) / math.pi
    return bits, math.ceil(math.log(1 - config.recall) / math.log1p(-(agree**bits)))


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def codes_of(units: np.ndarray, n_bits: int, config: EmbeddingConfig) -> np.ndarray:
    """The first n_bits sign bits over all rotations, as booleans."""
    count = -(-n_bits // units.shape[1])
    return (units @ rotations(units.shape[1], count, config.seed) >= 0)[:, :n_bits]


def keys_of(codes: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """One integer a band: the band's number above its bits."""
    powers = 1 << np.arange(bits, dtype=np.int64)
    return codes.reshape(len(codes), bands, bits) @ powers + (np.arange(bands, dtype=np.int64) << 41)


#: Levels of the dithered numbers above the least one.
LEVELS = 15


def pack_codes(units: np.ndarray, config: EmbeddingConfig) -> list[bytes]:
    """For each vector: f, least number and step (4-byte floats), sign bits, and two levels a byte."""
    dimension = units.shape[1]
    turned = units @ rotations(dimension, 1, config.seed)
    f = np.abs(turned).sum(axis=1) / math.sqrt(dimension)
    low = turned.min(axis=1)
    step = np.maximum((turned.max(axis=1) - low) / LEVELS, 1e-12)
    dither = np.random.default_rng([config.seed, dimension]).random(dimension)
    levels = np.clip(np.floor((turned - low[:, None]) / step[:, None] + dither), 0, LEVELS).astype(np.uint8)
    levels = np.pad(levels, ((0, 0), (0, dimension % 2)))
    parts = (np.stack([f, low, step], axis=1).astype("<f4").view(np.uint8), np.packbits(turned >= 0, axis=1), levels[:, ::2] << 4 | levels[:, 1::2])
    return [row.tobytes() for row in np.concatenate(parts, axis=1)]


@dataclass
class Codes:
    """Codes of some vectors of one length: scaled signs, dithered vectors, f and the dither's step."""

    signs: np.ndarray
    dithered: np.ndarray
    f: np.ndarray
    step: np.ndarray

    @classmethod
    def unpack(cls, packed: list[bytes], dimension: int) -> Codes:
        raw = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1)
        f, low, step = raw[:, :12].copy().view("<f4").T
        signs = np.unpackbits(raw[:, 12 : 12 + -(-dimension // 8)], axis=1, count=dimension).astype(np.float32) * 2 - 1
        levels = raw[:, 12 + -(-dimension // 8) :]
        levels = np.stack([levels >> 4, levels & LEVELS], axis=2).reshape(len(packed), -1)[:, :dimension]
        return cls(signs / np.float32(math.sqrt(dimension)), low[:, None] + step[:, None] * levels.astype(np.float32), f, step)

    def estimates(self, left: slice | np.ndarray, right: slice | np.ndarray) -> np.ndarray:
        """Unbiased estimates of the inner products of left (by code) and right (dithered)."""
        return self.signs[left] @ self.dithered[right].T / self.f[left, None]

    def uncut(self, left: slice | np.ndarray, right: slice | np.ndarray, config: EmbeddingConfig) -> np.ndarray:
        """Of which pairs the estimate and its bound reach the threshold."""
        dimension = self.signs.shape[1]
        if dimension < 16:
            return np.ones((len(self.f[left]), len(self.f[right])), bool)
        square = self.f[left].astype(float) ** 2
        code = np.maximum(1 / square - 1, 0) * (1 - config.threshold**2) / (dimension - 1)
        error = np.sqrt(code[:, None] + self.step[right].astype(float) ** 2 / (4 * square[:, None]))
        return self.estimates(left, right) + config.sigmas * error >= config.threshold


def _sides(low: int, high: int, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of both groups of a tile; the same rows twice where it is one group with itself."""
    left = np.flatnonzero(part == low)
    return left, left if low == high else np.flatnonzero(part == high)


def uncut_rows(size: int, low: int, high: int, part: np.ndarray, codes: list[bytes], config: EmbeddingConfig) -> np.ndarray:
    """Which rows of a tile are in a pair that isn't cut."""
    left, right = _sides(low, high, part)
    keep = np.zeros(len(part), bool)
    if len(left) and len(right):
        pairs = Codes.unpack(codes, size).uncut(left, right, config)
        if low == high:
            pairs = np.triu(pairs, 1)
        keep[left] |= pairs.any(axis=1)
        keep[right] |= pairs.any(axis=0)
    return keep


def compare(tile: pd.DataFrame, bits: int, bands: int, config: EmbeddingConfig) -> list[tuple]:
    """Links of one bucket, or of two groups of a large one: (id, links, smallest linked id here)."""
    ids, copies = tile["rep"].to_numpy(), tile["copies"].to_numpy()
    units = unit(np.frombuffer(b"".join(tile["vector"]), "<f8").reshape(len(tile), -1))
    band, low, high = int(tile["key"].iloc[0]) >> 41, int(tile["low"].iloc[0]), int(tile["high"].iloc[0])
    left, right = _sides(low, high, tile["part"].to_numpy())
    if not len(left) or not len(right):
        return []
    pairs = Codes.unpack(list(tile["code"]), units.shape[1]).uncut(left, right, config)
    i, j = np.nonzero(np.triu(pairs, 1) if low == high else pairs)
    i, j = left[i], right[j]
    exact = np.concatenate([np.einsum("ij,ij->i", units[i[k : k + 65536]], units[j[k : k + 65536]]) for k in range(0, len(i), 65536)] + [np.zeros(0)])
    i, j = i[exact >= config.threshold], j[exact >= config.threshold]
    if not len(i):
        return []
    keys = keys_of(codes_of(units, bits * bands, config), bits, bands)
    first = np.concatenate([(keys[i[k : k + 65536]] == keys[j[k : k + 65536]]).argmax(axis=1) for k in range(0, len(i), 65536)])
    i, j = i[first == band], j[first == band]
    links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
    label = np.arange(len(ids))
    while True:
        now = label.copy()
        np.minimum.at(now, i, label[j])
        np.minimum.at(now, j, label[i])
        now = now[now]
        if (now == label).all():
            break
        label = now
    return [(int(ids[k]), int(links[k]), int(ids[label[k]])) for k in np.flatnonzero(links)]


TILE = ["key", "size", "low", "high"]


def _tiles(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Frames of whole tiles from a partition that is sorted by tile, each with where its tiles begin and its length."""
    held: list[pd.DataFrame] = []

    def cut() -> tuple[pd.DataFrame, np.ndarray]:
        frame = pd.concat(held, ignore_index=True)
        values = frame[TILE].to_numpy(np.int64)
        opens = np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1
        return frame, np.concatenate([[0], opens, [len(frame)]])

    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        frame, bounds = cut()
        if len(bounds) > 2:
            yield frame.iloc[: bounds[-2]], bounds[:-1]
        held = [frame.iloc[bounds[-2] :]]
    if held:
        yield cut()


def _cut_tiles(batches: Iterator[pd.DataFrame], config: EmbeddingConfig) -> Iterator[pd.DataFrame]:
    """The rows of each tile that are in a pair that isn't cut."""
    for frame, bounds in _tiles(batches):
        keep = np.zeros(len(frame), bool)
        part, codes = frame["part"].to_numpy(), frame["code"].tolist()
        sizes, lows, highs = (frame[c].to_numpy() for c in ("size", "low", "high"))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a > 1:
                keep[a:b] = uncut_rows(int(sizes[a]), int(lows[a]), int(highs[a]), part[a:b], codes[a:b], config)
        yield frame.loc[keep, [*TILE, "part", "rep"]]


def _link_tiles(batches: Iterator[pd.DataFrame], bits: int, bands: int, config: EmbeddingConfig) -> Iterator[pd.DataFrame]:
    """compare() on each tile of a partition that is sorted by tile."""
    for frame, bounds in _tiles(batches):
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            out += compare(frame.iloc[a:b], bits, bands, config)
        yield pd.DataFrame(out, columns=["rep", "links", "near"])


def links_and_edges(classes: DataFrame, config: EmbeddingConfig) -> DataFrame:
    """(rep, links, near) from stored classes (rep, copies, size, vector): see compare(); several rows for a rep."""
    bits, bands = bands_for(classes.count(), config)

    def coded(sizes: pd.Series, vectors: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"keys": None, "code": None}, index=sizes.index, dtype=object)
        for _, own in vectors.groupby(sizes):
            units = unit(np.frombuffer(b"".join(own), "<f8").reshape(len(own), -1))
            for at, keys, code in zip(own.index, keys_of(codes_of(units, bits * bands, config), bits, bands), pack_codes(units, config), strict=True):
                out.at[at, "keys"], out.at[at, "code"] = keys, code
        return out

    codes = materialize(classes.select("rep", "size", F.pandas_udf(coded, schema("keys long[], code binary"))("size", "vector").alias("c")).select("rep", "size", "c.*"))
    keyed = codes.select("rep", "size", "code", F.explode("keys").alias("key"))
    crowded = materialize(keyed.groupBy("key", "size").agg(F.count("*").alias("n")).where(F.col("n") > config.bucket_rows))
    found = keyed.join(crowded.toDF("k", "s", "n"), (F.col("key") == F.col("k")) & (F.col("size") == F.col("s")), "left")
    groups = F.coalesce(F.ceil(2 * F.col("n") / config.bucket_rows), F.lit(1)).cast("int")
    parted = found.withColumn("groups", groups).withColumn("part", F.pmod(F.xxhash64("rep", "key"), F.col("groups")).cast("int"))
    tiled = parted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    tiled = tiled.select("rep", "code", "size", "key", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    dealt = tiled.repartition(*TILE).sortWithinPartitions(*TILE)
    needed = dealt.mapInPandas(lambda it: _cut_tiles(it, config), schema("key long, size int, low int, high int, part int, rep long"))
    whole = classes.select(F.col("rep").alias("r"), "copies", "vector").join(codes.select("rep", "code"), F.col("r") == F.col("rep")).drop("rep")
    fetched = materialize(needed).join(whole, F.col("rep") == F.col("r")).drop("r")
    return fetched.repartition(*TILE).sortWithinPartitions(*TILE).mapInPandas(lambda it: _link_tiles(it, bits, bands, config), schema("rep long, links long, near long"))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", config: EmbeddingConfig | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept of each vector."""
    config = config or EmbeddingConfig()
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    usable = F.coalesce(F.col("v").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("usable", usable).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v"))
    to_bytes = F.pandas_udf(lambda s: s.map(lambda x: np.asarray(x, "<f8").tobytes()), "binary")
    classes = rows.where("usable").groupBy("h1", "h2").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("v").alias("v"))
    classes = classes.select("h1", "h2", "first", "copies", F.size("v").alias("size"), to_bytes("v").alias("vector"))
    # Written out at once: the numbers that name the classes stay as they are.
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()))
    found = materialize(links_and_edges(classes.select("rep", "copies", "size", "vector"), config))
    links = found.groupBy(F.col("rep").alias("r")).agg(F.sum("links").alias("links"))
    member = components(found, "rep", "near")
    known = classes.select("h1", "h2", "rep", "first", "copies").join(links, F.col("rep") == F.col("r"), "left").join(member, F.col("rep") == F.col("node"), "left")
    known = materialize(known.select("h1", "h2", "first", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component")))
    least = materialize(known.groupBy(F.col("component").alias("c")).agg(F.min("first").alias("component_id")))
    known = materialize(known.join(least, F.col("component") == F.col("c")).select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "n_links", "component_id"))
    same = F.col("usable") & (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))
    out = rows.select("vec_id", "usable", "h1", "h2").join(known, same, "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

"""SimHash near-duplicates through Golay-code fuzzy hashing.

The 64 fingerprint bits are three segments of 22, 21 and 21. Two fingerprints that differ in
at most two bits agree on a whole segment i, and differ in at most one bit of the segment
after it (cyclically, for a suitable i: one error in that segment leaves at most one
elsewhere). So a fingerprint has, for each i, keys made of segment i and of the indices of
the codewords of the perfect (23, 12) Golay code near segment i + 1. Those are the one
codeword within distance 3 and, where that distance is 3, the five at distance 4: with them,
any two words at distance 2 or less have an index in common. Fingerprints that
share a key are compared exactly; nothing else is.

Only distinct fingerprints are joined, so copies cost nothing and each near pair of
fingerprints is compared as one. Components are those of the graph of fingerprints.

Where a similarity is asked for, texts whose sets of five-word shingles have that Jaccard
similarity are linked too. At 0.8 their fingerprints differ in about ten bits, which no such
keys reach, so candidates are texts with a band of MinHash values in common: a pair at 0.8
shares one of 20 bands of 6 with probability 0.998. Texts with the same set of shingles (copies but for white space and case, say)
are linked by its digest, and one of them stands for all. Only texts of different components are compared. In a bucket of up to BUCKET texts all such pairs are
candidates. In a larger one each text is first compared with LEADERS of them, which puts most of a group of
near copies into one component. The texts of buckets that still hold several components then meet by their
rarest shingles (of which one task sorts those of one text): two sets of that similarity must share one of the first |x| - similarity * |x| + 1 shingles in order
of frequency, so a passage of very many texts brings none of them together, and only pairs of different components
are candidates. So no link between components is lost. Candidates are compared
exactly, by the hashes of their shingles.

A text without words (empty or null) has fingerprint zero and links like any other. A null
id is a row like others, but can't be the smallest id of a component unless all are null.
Repeated rows stay rows. A very long text is hashed in pieces. Only the named columns are read; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from skygauge.llm.common import discard, materialize, text_batches, utf8
from skygauge.llm.components import components

SHINGLE = 3
DISTANCE = 2
SEED = 42
PIECE = 1 << 22
#: For similar texts: words of a shingle, bands of MinHash values and values of each.
WORDS, BANDS, ROWS = 5, 20, 6
BUCKET, LEADERS = 16, 2
#: Fingerprints of a key from which on it is compared by pairs of groups, in separate tasks.
CROWD = 4096
#: Segments as (lowest bit, width), from the top of the fingerprint.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: Fixed value: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, which generates the Golay code.
GENERATOR = 0b110001110101


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> list[np.ndarray]:
    """XXH64 of every shingle of a text, in pieces of bounded size."""
    data, at, carried, out = utf8(text).lower(), 0, [], []  # bytes.lower() changes A-Z alone
    while at < len(data):
        end = at + PIECE
        while end < len(data) and data[end : end + 1].strip():
            end += 1
        words = carried + data[at:end].split()
        at = end
        if len(words) >= shingle:
            joined, sizes = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(sizes + 1) - 1
            spans = zip((ends - sizes)[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)
            out.append(np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - shingle + 1))
        carried = words[-(shingle - 1) :]
    if not out and carried:
        out.append(np.array([xxhash.xxh64_intdigest(b" ".join(carried), SEED)], np.uint64))
    return out


def fingerprint(text: str | None) -> int:
    """The SimHash of a text as a signed 64-bit integer."""
    hashes = shingle_hashes(text)
    if not hashes:
        return 0
    ones = sum(np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64) for h in hashes)
    return int(np.packbits(2 * ones > sum(map(len, hashes))).view(">i8")[0])


@F.pandas_udf(T.LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(x) for x in texts], dtype="int64")


def shingle_set(text: str | None) -> np.ndarray:
    """The hashes of a text's distinct shingles of WORDS words, sorted."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, WORDS)]))


def sketch(text: str | None) -> np.ndarray | None:
    """The number of distinct shingles, the key of each band and a digest of the whole set; None for a text without words."""
    hashes = shingle_set(text)
    if not len(hashes):
        return None
    factors, shifts = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS), dtype=np.uint64)
    least = np.min([(hashes[at : at + 2048, None] * (factors | np.uint64(1)) + shifts).min(axis=0) for at in range(0, len(hashes), 2048)], axis=0)
    keys = [xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(least.reshape(BANDS, ROWS))]
    return np.array([len(hashes), *keys, xxhash.xxh64_intdigest(hashes.tobytes(), SEED)], np.uint64).astype(np.int64)


@F.pandas_udf(T.ArrayType(T.LongType()))
def sketches(texts: pd.Series) -> pd.Series:
    return pd.Series(list(map(sketch, texts)), index=texts.index, dtype=object)


@F.pandas_udf(T.ArrayType(T.LongType()))
def shingle_sets(texts: pd.Series) -> pd.Series:
    return pd.Series([shingle_set(x).astype(np.int64) for x in texts], index=texts.index, dtype=object)


def syndrome(words: np.ndarray) -> np.ndarray:
    """The remainder of 23-bit words, as polynomials over GF(2), by the generator."""
    left = words.astype(np.int64)
    for bit in range(22, 10, -1):
        left = np.where(left >> bit & 1, left ^ (GENERATOR << bit - 11), left)
    return left


@functools.cache
def leaders() -> np.ndarray:
    """For each syndrome the error patterns to the nearby codewords: one repeated six times, or six."""
    table = np.full((2048, 6), -1, dtype=np.int64)
    filled = np.zeros(2048, dtype=int)
    for weight in range(5):
        errors = np.array([sum(1 << b for b in bits) for bits in itertools.combinations(range(23), weight)])
        for s, e in zip(syndrome(errors).tolist(), errors.tolist(), strict=True):
            if weight < 4 or table[s, 0].bit_count() == 3:
                table[s, filled[s]] = e
                filled[s] += 1
    return np.where(table < 0, table[:, :1], table)


def golay_indices(words: np.ndarray) -> np.ndarray:
    """Six 12-bit indices of codewords near each 23-bit word, nearest first, some repeated."""
    return (words[:, None] ^ leaders()[syndrome(words)]) >> 11


def segment(values: np.ndarray, i: int) -> np.ndarray:
    low, width = SEGMENTS[i % 3]
    return (values >> low) & ((1 << width) - 1)


def fuzzy_keys(values: np.ndarray) -> np.ndarray:
    """The keys of each fingerprint, 18 with repeats: segment number, segment, index of the next one."""
    keys = [((i << 34) | (segment(values, i) << 12))[:, None] | golay_indices(segment(values, i + 1)) for i in range(3)]
    return np.concatenate(keys, axis=1)


@F.pandas_udf(T.ArrayType(T.LongType()))
def key_arrays(values: pd.Series) -> pd.Series:
    return pd.Series(list(map(np.unique, fuzzy_keys(values.to_numpy(np.int64)))), index=values.index, dtype=object)


def near_pairs(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b) of all pairs of the distinct column fp that differ in DISTANCE bits or fewer."""
    keyed = materialize(distinct.select("fp", F.explode(key_arrays("fp")).alias("key")))
    crowded = keyed.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("n")).where(F.col("n") > crowd)
    groups = F.coalesce(F.ceil(F.col("n") / crowd), F.lit(1)).cast("int")
    split = keyed.join(materialize(crowded), F.col("key") == F.col("k"), "left").select("fp", "key", groups.alias("groups"))
    left = split.select("key", F.pmod(F.xxhash64("fp"), F.col("groups")).cast("int").alias("group"), F.col("fp").alias("a"))
    right = split.select("key", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), F.col("fp").alias("b"))
    return left.join(right, ["key", "group"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)).select("a", "b").distinct()


def sets_of(docs: DataFrame, text_col: str, needed: DataFrame) -> DataFrame:
    """(u, set): the hashes of the shingles of the texts whose hash is in needed."""
    wanted = docs.select(F.xxhash64(text_col).alias("u"), F.col(text_col).alias("text")).join(needed, "u", "left_semi").dropDuplicates(["u"])
    return materialize(wanted.select("u", shingle_sets("text").alias("set")))


def similar(candidates: DataFrame, docs: DataFrame, text_col: str, similarity: float, sets: DataFrame | None = None) -> DataFrame:
    """(a, b): fingerprints of the candidates (x, y: structs of u, fp and number of shingles) with that Jaccard similarity or more."""
    low, high = F.when(F.col("x.u") < F.col("y.u"), F.col("x")).otherwise(F.col("y")), F.when(F.col("x.u") < F.col("y.u"), F.col("y")).otherwise(F.col("x"))
    near = F.least("x.n", "y.n") >= similarity * F.greatest("x.n", "y.n")
    pairs = materialize(candidates.where(near).select(low["u"].alias("ua"), high["u"].alias("ub"), low["fp"].alias("a"), high["fp"].alias("b")).distinct())
    own = sets is None
    if own:
        sets = sets_of(docs, text_col, pairs.select(F.col("ua").alias("u")).union(pairs.select("ub")).distinct())
    met = pairs.join(sets.select(F.col("u").alias("ua"), F.col("set").alias("sa")), "ua").join(sets.select(F.col("u").alias("ub"), F.col("set").alias("sb")), "ub")
    common = F.size(F.array_intersect("sa", "sb"))
    found = materialize(met.where(common >= similarity * (F.size("sa") + F.size("sb") - common)).select("a", "b"))
    discard(pairs, *[sets] * own)
    return found


def by_rare_shingles(texts: DataFrame, sets: DataFrame, similarity: float) -> tuple[DataFrame, list[DataFrame]]:
    """(x, y), and the stored tables that are read for it: pairs of texts (x, part) of different parts that share one of their rarest shingles, early enough in both that the rest
    could still make up that similarity, as any pair that has it does at the first shingle it shares.

    The largest part of a shingle isn't paired with itself, nor are shingles of one part.
    """
    tokens = materialize(texts.join(sets, F.col("x.u") == F.col("u")).select("x", "part", F.explode("set").alias("token")))
    counts = tokens.groupBy(F.col("token").alias("t")).agg(F.count("*").alias("frequency"))
    ranked = tokens.join(counts, F.col("token") == F.col("t")).withColumn("place", F.row_number().over(Window.partitionBy("x.u").orderBy("frequency", "token")))
    first = ranked.where((F.col("place") <= F.col("x.n") - F.ceil(similarity * F.col("x.n") - 1e-9) + 1) & (F.col("frequency") > 1))
    rows = materialize(first.select("x", "part", "token", (F.col("x.n") - F.col("place") + 1).alias("rest")))
    discard(tokens)
    sizes = rows.groupBy("token", "part").agg(F.count("*").alias("n")).groupBy(F.col("token").alias("k")).agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.count("*").alias("parts"))
    open_ = materialize(rows.join(sizes.where("parts > 1"), F.col("token") == F.col("k")).select("token", "x", "part", "rest", (F.col("part") == F.col("main")).alias("is_main")))
    others = open_.where("NOT is_main").select("token", "x", "part", "rest")
    all_ = open_.select("token", F.col("x").alias("y"), F.col("part").alias("other"), F.col("rest").alias("rest_of_y"), "is_main")
    needed = F.ceil(similarity / (1 + similarity) * (F.col("x.n") + F.col("y.n")) - 1e-9)
    once = F.col("is_main") | (F.col("x.u") < F.col("y.u"))  # two that aren't of the largest part meet from both sides
    return others.join(all_, "token").where((F.col("part") != F.col("other")) & once & (F.least("rest", "rest_of_y") >= needed)).select("x", "y"), [rows, open_]


def placed(texts: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts (x: a struct with fp) with their part, the component of their fingerprint by these edges; and the edges, as stars."""
    stars = materialize(components(edges))
    parts = texts.join(stars, F.col("x.fp") == F.col("node"), "left").withColumn("part", F.coalesce("component", "x.fp")).drop("node", "component")
    return materialize(parts), stars.select(F.col("node").alias("a"), F.col("component").alias("b"))


def open_buckets(texts: DataFrame) -> DataFrame:
    """(key, size, leaders) of the buckets whose texts (x, part, bands) are of several parts."""
    members = texts.select("x", "part", F.explode("bands").alias("key"))
    leaders = F.array(*(F.min(F.struct(F.xxhash64("x.u", F.lit(j)).alias("h"), F.col("x").alias("y"), F.col("part").alias("other"))) for j in range(LEADERS)))
    return materialize(members.groupBy("key").agg(F.count("*").alias("size"), leaders.alias("leaders"), F.min("part").alias("least"), F.max("part").alias("most")).where("least <> most").select("key", "size", "leaders"))


def similar_pairs(docs: DataFrame, prints: DataFrame, text_col: str, similarity: float, bucket: int = BUCKET, linked: DataFrame | None = None) -> DataFrame:
    """(a, b): each fingerprint that texts with that Jaccard similarity or more link, and the smallest of its component; prints has fp, sketch and u (a text's hash).

    Of the texts with one set of shingles, however many and of whatever spacing and case, one is compared. linked: (a, b) of
    fingerprints that are linked otherwise, which count too. Late texts of one component aren't compared.
    """
    shown = materialize(prints.where("sketch IS NOT NULL").select("fp", "u", F.element_at("sketch", -1).alias("same"), F.element_at("sketch", 1).alias("n"), F.slice("sketch", 2, BANDS).alias("bands")))
    one = materialize(shown.groupBy("same").agg(F.min_by(F.struct("u", "fp", "n"), "u").alias("x"), F.any_value("bands").alias("bands")))
    edges = shown.select("fp", "same").distinct().join(one, "same").where("fp <> x.fp").select(F.col("fp").alias("a"), F.col("x.fp").alias("b"))
    texts = one.drop("same").withColumn("part", F.col("x.fp"))
    shared = materialize(texts.select("x", "part", F.explode("bands").alias("key")).join(open_buckets(texts), "key"))
    small, large = shared.where(F.col("size") <= bucket).select("key", "x", "part"), shared.where(F.col("size") > bucket)
    among = small.join(small.select("key", F.col("x").alias("y"), F.col("part").alias("other")), "key").where("x.u < y.u AND part <> other").select("x", "y")
    led = large.select("x", "part", F.inline("leaders")).where("part <> other").select("x", "y")
    found = edges.union(similar(among.union(led), docs, text_col, similarity))
    texts, stars = placed(texts.drop("part"), found if linked is None else found.union(linked))
    discard(shared, shown, one)
    crowded = open_buckets(texts).where(F.col("size") > bucket).select("key")
    late = materialize(texts.select("x", "part", F.explode("bands").alias("key")).join(crowded, "key", "left_semi").select("x", "part").distinct())
    if late.isEmpty():
        return stars
    sets = sets_of(docs, text_col, late.select("x.u"))
    candidates, read = by_rare_shingles(late, sets, similarity)
    found = similar(candidates, docs, text_col, similarity, sets)
    discard(late, sets, texts, *read)
    return components(stars.union(found)).toDF("a", "b")


def _classes(docs: DataFrame, id_col: str, text_col: str, similarity: float | None) -> DataFrame:
    """doc_id, fp, u (hash of the text), component (its smallest fingerprint) and component_id of each document."""
    text_batches(docs.sparkSession)
    more = [] if similarity is None else [sketches(F.col(text_col)).alias("sketch")]
    prints = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("u"), fingerprints(F.col(text_col)).alias("fp"), *more))
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    pairs = near_pairs(nodes)
    members = components(pairs) if similarity is None else similar_pairs(docs, prints, text_col, similarity, linked=materialize(pairs))
    members = members.toDF("fp", "component")
    grouped = nodes.join(members, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    grouped = materialize(grouped)
    least = grouped.groupBy(F.col("component").alias("c")).agg(F.min("first").alias("component_id"))
    classes = grouped.join(materialize(least), F.col("component") == F.col("c")).select(F.col("fp").alias("own"), "component", "component_id")
    return prints.join(materialize(classes), F.col("fp") == F.col("own")).select("doc_id", "u", "fp", "component", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """doc_id, fp, fingerprint (hexadecimal) and component_id of each document."""
    return _classes(docs, id_col, text_col, similarity).select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """One document of each component: the one with the smallest id, null ids last; of texts of the component that share that id the one with the least hash, and one of equal rows.

    Documents that share an id but not a component are judged on their own.
    """
    found = _classes(docs, id_col, text_col, similarity)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "u")
    kept = found.groupBy("component").agg(F.min(place).alias("p")).select(F.col("p.doc_id").alias("kept_id"), F.col("p.u").alias("kept_u"))
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    keys = own.select("row", F.col(f"row.`{id_col}`").cast("long").alias("id"), F.xxhash64(f"row.`{text_col}`").alias("u"))
    return keys.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("u") == F.col("kept_u")), "left_semi").dropDuplicates(["id", "u"]).select("row.*")

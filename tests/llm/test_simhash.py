import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from skygauge.llm import simhash
from skygauge.llm.components import components


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    prints, parent = [brute_fingerprint(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((-1 if doc is None else doc, f"{prints[i]:016x}", least.get(find(i))) for i, (doc, _) in enumerate(rows)), key=str)


def test_close_words_share_a_golay_index():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 3000)
    own = simhash.golay_indices(words)
    for flips in (1, 2):
        for _ in range(20):
            other = words.copy()
            for bit in rng.choice(23, flips, replace=False):
                other ^= 1 << bit
            near = simhash.golay_indices(other)
            assert (own[:, :, None] == near[:, None, :]).any(axis=(1, 2)).all()
    assert (np.bincount([len(set(r)) for r in simhash.leaders().tolist()], minlength=7)[[1, 6]] == [277, 1771]).all()


def test_any_two_flips_leave_a_common_key():
    rng = np.random.default_rng(1)
    values = rng.integers(-(1 << 63), (1 << 63) - 1, 4)
    for i in range(64):
        for j in range(i + 1):
            mask = np.int64(np.uint64((1 << i) | (1 << j)).astype(np.int64))
            a, b = simhash.fuzzy_keys(values), simhash.fuzzy_keys(values ^ mask)
            assert (a[:, :, None] == b[:, None, :]).any(axis=(1, 2)).all()


def test_against_brute_force(spark, docs):
    rng = random.Random(2)
    base = [" ".join(rng.choice("abcdefghij") for _ in range(200)) for _ in range(5)]
    rows = [(i, re.sub(r"\b\w\b", lambda m: m[0] if rng.random() > 0.004 else "zz", base[i % 5])) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " \n"), (503, "One"), (504, "one"), (505, "a b"), (503, "One"), (None, "solo words here now"), (None, base[0]), (506, base[0].upper()), (507, "Ä ä é b")]
    rng.shuffle(rows)
    got = sorted(((-1 if r.doc_id is None else r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs(rows)).collect()), key=str)
    assert got == brute_components(rows)


def test_long_texts_are_read_whole(monkeypatch):
    text = "some words that go On and on " * 40
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "PIECE", 17)
    assert simhash.fingerprint(text) == whole


def test_crowded_keys_are_split(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(64) - (1 << 63) for _ in range(20)]
    values = sorted({x ^ (1 << rng.randrange(63)) ^ (rng.random() < 0.5 and 1 << rng.randrange(63)) for x in base for _ in range(30)})
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    expected = {(a, b) for a in values for b in values if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    for crowd in (4096, 3):
        assert {(r.a, r.b) for r in simhash.near_pairs(frame, crowd).collect()} == expected


def test_keep_first_and_empty(spark, docs):
    rows = [(5, "a b c d"), (3, "a b c d"), (3, "a b c d"), (9, "quite another text of words"), (None, "a b c d"), (None, "x"), (None, "x"), (1, "one text of its own"), (1, "and another with the same id"), (2, "a third one, alone")]
    kept = simhash.keep_first(docs(rows))
    expected = {(3, "a b c d"), (9, "quite another text of words"), (None, "x"), (1, "one text of its own"), (1, "and another with the same id"), (2, "a third one, alone")}
    out = [(r.doc_id, r.text) for r in kept.collect()]
    assert set(out) == expected and len(out) == len(expected) and kept.columns == docs(rows).columns
    assert simhash.near_duplicates(docs([])).count() == 0 and simhash.keep_first(docs([])).count() == 0


def brute_jaccard_pairs(texts, similarity=0.8):
    sets = []
    for t in texts:
        words = t.lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)})
    return {(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])}


def test_groups_in_large_buckets_lose_no_link(spark, docs):
    """Chains of texts, each like the next and less like the others, that share many bands: components are those of all pairs."""
    rng = random.Random(11)
    texts = []
    for _ in range(3):
        words = [f"w{rng.randrange(9000)}" for _ in range(260)]
        for step in range(40):
            texts.append(" ".join(words))
            for _ in range(2 if step % 9 else 9):
                words[rng.randrange(260)] = f"n{rng.randrange(9000)}"
    def classes(pairs):
        top = list(range(len(texts)))

        def find(i):
            while top[i] != i:
                i = top[i]
            return i

        for a, b in pairs:
            top[find(a)] = find(b)
        return [min(j for j in range(len(texts)) if find(j) == find(i)) for i in range(len(texts))]

    df = docs(list(enumerate(texts)))
    prints = df.select(F.xxhash64("text").alias("u"), simhash.fingerprints("text").alias("fp"), simhash.sketches("text").alias("sketch"))
    own = [r.fp for r in df.select("doc_id", simhash.fingerprints("text").alias("fp")).orderBy("doc_id").collect()]
    same = [(i, own.index(x)) for i, x in enumerate(own)]  # texts of one fingerprint are one node
    expected = classes([*brute_jaccard_pairs(texts), *same])
    assert len(set(expected)) > 3
    for bucket in (16, 1):
        linked = simhash.similar_pairs(df, prints, "text", 0.8, bucket).collect()
        assert classes([*((own.index(r.a), own.index(r.b)) for r in linked), *same]) == expected


def test_similar_texts_are_linked_at_jaccard_0_8(spark, docs):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(5000)}" for _ in range(300)] for _ in range(6)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i, w in enumerate(base):  # n changed words far apart: (296 - 5n) common shingles of 296 + 5n
        for n in (1, 6, 7):
            rows.append((100 * n + i, " ".join("new%d" % n if k % 40 == 20 and k // 40 < n else x for k, x in enumerate(w))))
    kept = {r.doc_id for r in simhash.keep_first(docs(rows), similarity=0.8).collect()}
    assert kept == set(range(6)) | {700 + i for i in range(6)}


def test_a_large_group_of_similar_texts_is_one_component(spark, docs):
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = [(i, " ".join([*base[:i], f"own{i}", *base[i + 1 :]])) for i in range(60)] + [(500, "quite another text of a few words")]
    assert {r.doc_id for r in simhash.keep_first(docs(rows), similarity=0.8).collect()} == {0, 500}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200), (None, 5)]
    out = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {out[i] for i in range(41)} == {0} and {out[i] for i in range(100, 160)} == {100} and out[201] == 200 and len(out) == 41 + 60 + 2


def test_variants_of_one_text_are_compared_once(spark, docs, monkeypatch):
    """Texts that differ in white space or case alone have one set of shingles: candidates don't grow with them."""
    rng, made = random.Random(5), []
    words = [f"w{rng.randrange(5000)}" for _ in range(120)]
    other = [*words[:60], "other", *words[61:]]
    rows = [(i, (" " * (1 + i)).join(words if i % 2 else [w.upper() for w in words])) for i in range(2000)] + [(5000 + i, (" " * (1 + i)).join(other)) for i in range(50)]
    compare = simhash.similar

    def counted(candidates, *rest):
        made.append(candidates.count())
        return compare(candidates, *rest)

    monkeypatch.setattr(simhash, "similar", counted)
    assert {r.doc_id for r in simhash.keep_first(docs(rows), similarity=0.8).collect()} == {0} and sum(made) < 100

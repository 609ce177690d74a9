"""Periodic runs against all periods of all stretches."""

import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from skygauge.llm import runs
from skygauge.llm.queries import QUERIES


def brute_runs(words, min_length=12):
    found = []
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_length, 2 * q):
                whole = words[i : j + q]
                if all(any(a != b for a, b in zip(whole, whole[r:], strict=False)) for r in range(1, q)):
                    found.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(0, 40), st.integers(1, 20), st.sampled_from([1, 2, 3, 5, 12, 20]))
def test_runs_are_those_of_all_periods(ids, at, period, min_length):
    for k in range(at + period, len(ids)):
        ids[k] = ids[k - period]
    assert [tuple(r) for r in runs.runs_of_words(np.array(ids, np.int64), min_length).tolist()] == brute_runs(ids, min_length)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=50))
def test_extensions_are_common_prefixes(ids):
    text = [x + 1 for x in ids] + [0]
    common, a, b = runs.Extensions(text), *np.triu_indices(len(text), 1)
    expected = [next(k for k in range(len(text)) if text[x + k] != text[y + k]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert common(a, b).tolist() == expected


def test_stretches_lose_no_run():
    rng = random.Random(2)
    for _ in range(200):
        ids = [rng.randrange(400) for _ in range(200)]
        for _ in range(3):
            a, p = rng.randrange(150), rng.randrange(1, 25)
            for k in range(a + p, min(200, a + rng.randrange(2, 5) * p)):
                ids[k] = ids[k - p]
        inside = {i for a, b in runs.repeating_stretches(np.array(ids)) for i in range(a, b)}
        assert all(set(range(s, s + n)) <= inside for s, n, _ in brute_runs(ids))


def expected_row(doc_id, text):
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + (h // 10) % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = brute_runs(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if found else None
    return (doc_id, len(found), *best, milli, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_query_against_brute_force(spark, tmp_path):
    rng, rows = random.Random(3), [(-5, None), (None, ""), (None, " a " * 30), (7, "x y " * 10), (7, "x y " * 10), (8, "one"), (2**62, "é b c\x0b" * 9)]
    for i in range(120):
        words = [rng.choice(["aa", "b", "cé", "d d"] if i % 2 else [f"w{k}" for k in range(60)]) for _ in range(rng.randrange(1, 90))]
        rows.append((i * 37, rng.choice([" ", "\n", "\t "]).join(words + words[: rng.randrange(40)] * rng.randrange(3))))
    spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, runs string, id string").write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op11_periodic_runs"](spark, str(tmp_path))
    key = lambda rows: sorted(rows, key=repr)
    assert key(map(tuple, out.collect())) == key(expected_row(*r) for r in rows)
    assert sum(zlib.crc32(str(i * 37).encode()) % 10 == 0 for i in range(120)) > 5
    empty = runs.find_runs(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_words", "runs", "collapsed"]


def test_long_texts():
    n = 60_000
    assert runs.runs_of_words(np.zeros(n, np.int64)).tolist() == [[0, n, 1]]
    assert runs.runs_of_words(np.arange(n) % 7001).tolist() == [[0, n, 7001]]
    assert runs.runs_of_words(np.arange(n)).tolist() == []

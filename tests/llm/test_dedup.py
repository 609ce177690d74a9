"""Line dedup, substring dedup and embeddings against brute force."""

import random
import re

import numpy as np
import pytest

from skygauge.llm import embdedup, linededup, suffixdedup


def brute_substrings(rows, length=50):
    data = [(doc, (t or "").encode()) for doc, t in rows]
    first = {}
    for doc, b in data:
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            first[w] = min(first.get(w, float("inf")), float("inf") if doc is None else doc)
    out = []
    for doc, b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < (float("inf") if doc is None else doc):
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((-1 if doc is None else doc, len(b), int(gone.sum()), spans, kept))
    return sorted(out)


def substring_rows():
    rng = random.Random(5)
    words = ["lorem", "ipsum", "dolor", "é", "amet", "x", "漢字", "aaaa", "\0", "b"]
    passages = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(6)]
    rows = []
    for i in range(80):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(3)]
        rows.append((i * 3 % 241, rng.choice(passages).join(parts[:2]) + rng.choice(passages)[rng.randint(0, 60) :] + parts[2]))
    rows += [(900, rows[0][1]), (901, rows[0][1]), (2000, "a" * 400), (2001, "a" * 60 + "b" + "a" * 49), (2002, "ab" * 100), (2003, "ba" * 100), (1, None), (2, ""), (4, "short")]
    rows += [(3000, passages[0]), (3000, passages[0]), (3000, passages[1]), (None, passages[2]), (None, passages[2] + "z")]
    return rows


TINY = suffixdedup.SuffixLimits(crowd=2, fan=2, block_bytes=3000, piece=90, sort_bytes=500, part_bytes=5000, task_bytes=20_000)


@pytest.mark.parametrize("limits,stable", [(suffixdedup.SuffixLimits(), True), (TINY, False), (suffixdedup.SuffixLimits(crowd=2, block_bytes=3000, part_bytes=1 << 20), False)])
def test_substrings(spark, docs, stored, limits, stable):
    rows = substring_rows() + [((1 << 63) - 1, substring_rows()[0][1] + "the largest id")]
    random.Random(1).shuffle(rows)
    df = stored(docs(rows)) if stable else docs(rows)
    out = suffixdedup.remove_repeats(df, stable=stable, limits=limits).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, sum(b - a for a, b in zip(r.starts, r.ends)), len(r.starts), bytes(r.kept)) for r in out)
    assert got == brute_substrings(rows)


def test_what_a_sort_leaves():
    """Of strings that meet by key, removed windows and those left are all windows, once each."""
    rng = random.Random(2)
    for _ in range(60):
        base = ["".join(rng.choice("ab") for _ in range(70)) for _ in range(3)]
        strings = [(rng.choice(base)[: rng.randint(50, 70)]).encode() for _ in range(rng.randint(1, 12))]
        keys, ids = np.array([rng.randint(0, 2) for _ in strings], np.uint64), np.array([rng.randint(0, 5) for _ in strings])
        found, left = suffixdedup.settled(keys, strings, ids, rng.choice([1, 100, 1 << 20]))
        gone = sorted((i, k) for i, a, b in found for k in range(a, b - 49))
        assert sorted(gone + [(i, k) for i, a, b in left for k in range(a, b - 49)]) == [(i, k) for i, x in enumerate(strings) for k in range(len(x) - 49)]
        for i, k in [(i, k) for i, x in enumerate(strings) for k in range(len(x) - 49)]:
            window = strings[i][k : k + 50]
            earlier = any(keys[j] == keys[i] and ids[j] < ids[i] and window in strings[j] for j in range(len(strings)))
            assert ((i, k) in gone) >= earlier and (((i, k) in gone) <= any(ids[j] < ids[i] and window in strings[j] for j in range(len(strings))))


def test_two_stage_order_and_prefixes():
    rng = random.Random(3)
    for _ in range(150):
        alphabet = rng.choice([b"ab", b"a", b"abc", b"\x00\x01\xff"])
        strings = [bytes(rng.choice(alphabet) for _ in range(rng.randint(4, 30))) for _ in range(rng.randint(1, 5))]
        sizes = np.array([len(s) for s in strings])
        ends, text = np.cumsum(sizes), np.frombuffer(b"".join(strings), np.uint8)
        wanted = np.arange(len(text)) <= (ends - 4)[np.repeat(np.arange(len(strings)), sizes)]
        order = suffixdedup.two_stage_order(text, ends - sizes, ends, wanted, 4)
        keys = [bytes(text[i : i + 4]) for i in order]
        assert sorted(order) == np.flatnonzero(wanted).tolist() and keys == sorted(keys)
        prefixes = suffixdedup.adjacent_prefixes(text, order, 4)
        for a, b, n in zip(keys, keys[1:], prefixes[1:]):
            assert n == next((k for k in range(4) if a[k] != b[k]), 4)


def test_carried_columns_stay_exact(spark):
    rows = [(1, "x" * 60, "2024-01-02 03:04:05.123456", "1.10", [1, None], 0.1, b"\x00\xff"), (2, "y" * 60, None, None, None, None, None), (None, "z", "1969-12-31 23:59:59.000001", "-99999999.99", [], float("inf"), b"")]
    df = spark.createDataFrame(rows, "doc_id long, text string, t string, d string, a array<long>, f double, b binary").selectExpr("doc_id", "text", "cast(t as timestamp) as t", "cast(t as timestamp_ntz) as n", "cast(d as decimal(20,2)) as d", "a", "f", "b", "cast(cast(t as timestamp) as date) as `x.y`")
    out = suffixdedup.without_repeats(df)
    assert out.dtypes == df.dtypes and sorted(map(str, out.collect())) == sorted(map(str, df.collect()))


def test_without_repeats_keeps_columns(spark, docs, stored):
    text = "é" * 40 + " a tail of its own"
    rows = [(1, text, "fr", None), (2, "x" + text, None, "s2"), (3, text), (4, None), (5, "")]
    out = suffixdedup.without_repeats(stored(docs(rows)), count_col="n_chars")
    by = {r.doc_id: r for r in out.collect()}
    assert out.columns == docs(rows).columns and out.dtypes == docs(rows).dtypes
    assert set(by) == {1, 2, 4, 5} and by[1].text == text and by[2].text == "x" and by[2].n_chars == 1 and by[2].lang is None and by[1].source is None and by[4].text == ""
    assert suffixdedup.remove_repeats(stored(docs([]))).count() == 0


def brute_units(text, unit):
    """Units of a text by the docstring, character by character."""
    if unit == "lines":
        return re.findall(r"[^\n]*\n|[^\n]+", text)
    if unit == "paragraphs":
        out = [""]
        for line in re.findall(r"[^\n]*\n|[^\n]+", text):
            if out[-1] and re.search(r"\n[ \t\x0b-\r]*\n\Z", out[-1]) and line.strip(" \t\x0b\x0c\r\n"):
                out.append("")
            out[-1] += line
        return [x for x in out if x]
    out = []
    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        sentences = [""]
        for i, c in enumerate(line):
            if i and c not in " \t\x0b\x0c\r\n" and re.search(r"[.!?][ \t\x0b\x0c\r]+\Z", sentences[-1]):
                sentences.append("")
            elif i and c == "\n" and re.search(r"[.!?][ \t\x0b\x0c\r]+\Z", sentences[-1]):
                sentences.append("")
            sentences[-1] += c
        long_ = [i for i, x in enumerate(sentences) if len(re.findall(r"[^\x20\x09-\x0D]+", x)) >= 5]
        cuts = [0, *(i + 1 for i in long_[:-1]), len(sentences)]
        out += ["".join(sentences[a:b]) for a, b in zip(cuts, cuts[1:])]
    return out


def brute_repeats(rows, unit="sentences"):
    """rows in their order: (id, units, removed bytes, spans, kept)."""
    seen, out = set(), []
    for doc, text in rows:
        at, spans, kept, size = 0, [], "", 0
        units = brute_units(text or "", unit)
        for u in units:
            norm = re.sub(r"[\x20\x09-\x0D]+", " ", "".join(c.lower() if "A" <= c <= "Z" else c for c in u)).strip(" ")
            if norm and norm in seen:
                spans.append((at, at + len(u)))
                size += len(u.encode())
            else:
                kept += u
                seen.add(norm)
            at += len(u)
        out.append((doc, len(units), size, spans, kept))
    return out


@pytest.mark.parametrize("unit", ["sentences", "lines", "paragraphs"])
def test_units(spark, docs, unit):
    rng = random.Random(8)
    words = ["One", "two", "THREE", "four", "é", "漢字", "x.", "y!", "z?", "3.14", "\t"]
    parts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) + rng.choice([". ", ".\n", "\n", "\n\n", "! ", ".\r\n", " \n \n", ""]) for _ in range(60)]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))) for i in range(70)]
    rows += [(100, "A b C d e. f g.\n"), (101, "a  B c\td E. f g.\nshort\n\nshort"), (102, None), (103, ""), (104, " \n\t"), (105, "".join(parts) * 400), (105, "".join(parts) * 400), (None, "short"), (None, "short")]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    order = lambda x: (x[0] is None, x[0] or 0, -len(x[4]), x[4])
    out = sorted(((r.doc_id, r.n_units, r.n_removed, list(zip(r.starts, r.ends)), r.kept) for r in linededup.remove_repeated_units(docs(shuffled), unit=unit).collect()), key=order)
    expected = sorted(brute_repeats(rows, unit), key=order)
    assert [x[0] for x in out] == [x[0] for x in expected]
    for a, b in zip(out, expected):
        assert a == b
    assert linededup.remove_repeated_units(docs([]), unit=unit).count() == 0


def test_units_of_rows_that_share_an_id(spark, docs):
    """Of different texts with one id either may come first, always the same one; what is kept differs by one copy."""
    rows = [(6, "a b c d e"), (6, "a b c d e"), (6, "a b c d e\nq r s t u"), (7, "a b c d e")]
    out = [[(r.doc_id, r.kept) for r in linededup.remove_repeated_units(docs(x)).orderBy("doc_id", "n_bytes", "kept").collect()] for x in (rows, rows[::-1])]
    assert out[0] == out[1] and sum("a b c d e" in k for _, k in out[0]) == 1 and sum("q r s t u" in k for _, k in out[0]) == 1


def vectors(n=400, d=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, d))
    x = np.concatenate([centres[rng.integers(0, 40, n)] + rng.normal(size=(n, d)) * rng.choice([0.05, 0.3], (n, 1)), rng.normal(size=(n // 4, d))])
    x[5] = x[6] = x[7]
    return x.astype(np.float32)


@pytest.mark.parametrize("bucket", [2048, 8])
def test_embeddings(spark, bucket):
    x = vectors()
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    odd = [(9001, None, 0), (9002, [], 0), (9003, [0.0] * 16, 0), (9004, [float("nan")] * 16, 0), (9005, [None] + [1.0] * 15, 0), (9006, [float("inf")] + [1.0] * 15, 0), (9007, [1.0, 2.0], 0), (9008, [2.0, 4.0], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, key int")
    out = {r.vec_id: r for r in embdedup.near_duplicates(df, config=embdedup.EmbeddingConfig(bucket_rows=bucket)).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = u @ u.T >= 0.95
    np.fill_diagonal(links, False)
    found = np.array([out[i].n_links for i in range(len(x))])
    assert (found <= links.sum(axis=1)).all() and found.sum() >= 0.95 * links.sum() and found.sum() > 0
    assert all(out[i].n_links == 0 and out[i].component_id == i and out[i].kept for i in range(9001, 9007)) and out[9008].component_id == 9007 and out[9007].n_links == 1
    assert out[6].n_links >= 2 and out[7].component_id == out[5].component_id <= 5
    reach = {i: {i} for i in range(len(x))}
    for i, j in zip(*np.nonzero(links)):
        if reach[i] is not reach[j]:
            reach[i] |= reach[j]
            for k in reach[j]:
                reach[k] = reach[i]
    assert all(out[i].component_id in reach[i] and out[i].kept == (out[i].component_id == i) for i in range(len(x)))
    assert embdedup.near_duplicates(df.where("false")).count() == 0


def test_estimates_are_unbiased():
    rng = np.random.default_rng(3)
    a, b = embdedup.unit(rng.normal(size=(1, 64))), embdedup.unit(rng.normal(size=(1, 64)))
    b = embdedup.unit(a + 0.5 * b)
    found, both = [], np.concatenate([a, b])
    for seed in range(300):
        codes = embdedup.Codes.unpack(embdedup.pack_codes(both, embdedup.EmbeddingConfig(seed=seed)), 64)
        found.append(codes.estimates(slice(0, 1), slice(1, 2))[0, 0])
    assert np.mean(found) == pytest.approx(float((a @ b.T)[0, 0]), abs=4 * np.std(found) / np.sqrt(300))


@pytest.mark.parametrize("dimension", [16, 33, 64, 300])
def test_bounds_cut_few_links_and_most_others(dimension):
    rng, config = np.random.default_rng(9), embdedup.EmbeddingConfig()
    base = embdedup.unit(rng.normal(size=(400, dimension)))
    noise = embdedup.unit(rng.normal(size=(400, dimension)))
    near = embdedup.unit(base + rng.uniform(0.1, 0.33, (400, 1)) * noise)
    both = np.concatenate([base, near])
    codes = embdedup.Codes.unpack(embdedup.pack_codes(both, config), dimension)
    assert len(embdedup.pack_codes(both, config)[0]) <= 12 + dimension // 8 + 1 + dimension // 2 + 1
    left = codes.uncut(np.arange(800), np.arange(800), config)
    exact = both @ both.T >= config.threshold
    assert (left & exact).sum() >= 0.999 * exact.sum() and (dimension < 33 or (left & ~exact).mean() < 0.05)

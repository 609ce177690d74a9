import re
from collections import Counter
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from skygauge.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit)


@pytest.mark.parametrize("text", [None, "", " \n\t", "a", "a a a a a a", "x y z w v x y z w v u", "l\nl\n\nl \n é#|ü *", "a b " * 300, " wide space stays", "one two three four five six\r\none two three four five\r\n"])
def test_metrics(text):
    assert quality.measure(text)[:5] == brute(text)


def test_metrics_of_random_texts():
    rng = np.random.default_rng(0)
    for n in range(1, 60):
        text = "".join(rng.choice(list("ab \n|"), n * 3))
        assert quality.measure(text)[:5] == brute(text)


def test_binomial():
    for k, n, p in [(0, 10, 0.1), (3, 40, 0.05), (40, 40, 0.3), (7, 500, 0.01)]:
        assert quality.binomial_tail(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))
    assert quality.binomial_tail(2, 300, quality.upper_bound(2, 300, 0.01)) == pytest.approx(0.01, rel=1e-6)
    assert quality.upper_bound(0, 0, 0.1) == 1.0


def labelled(n_good=1500, n_bad=200, lang="en", start=0):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu".split()
    good = [(start + i, " ".join(words[(i + k * (1 + i % 5)) % 12] + str(k) for k in range(20)), lang) for i in range(n_good)]
    bad = [(start + n_good + i, " ".join(f"{w}***{i}" for w in words), lang) for i in range(n_bad)]
    return good, bad


def brute_cutoffs(rows, marks, shaping, config):
    """The cutoffs of each stratum in plain Python. shaping: ids whose labels shape the walk."""
    scores, strata = {}, {}
    for i, text, lang in rows:
        words, chars, symbols, dups, repeats, lines, upper = quality.measure(text)
        if words >= 10 and 100 * repeats <= 20 * words and i in marks:
            scores[i] = (symbols / max(chars, 1), upper / max(chars, 1), dups / max(lines, 1), repeats / max(words, 1))
            strata[i] = lang
    held = Counter(strata[i] for i in scores if marks[i] == 1 and i not in shaping)
    good_strata = {strata[i] for i in scores if marks[i] == 1}
    need = lambda m: next(n for n in range(1, 10**6) if (1 - config.alpha) ** n <= config.delta / m)
    walks = 1 + sum(held[x] >= need(1) for x in good_strata)
    part = {x: x if held[x] >= need(walks) else "pool" for x in good_strata}
    out = {}
    for group in set(part.values()):
        ids = [i for i in scores if part.get(strata[i]) == group]
        shape = [scores[i] for i in ids if marks[i] == 1 and i in shaping]
        if not shape:
            continue
        units = [max(config.least_unit, np.percentile([round(x[k], 4) for x in shape], 100 * (1 - config.alpha / 8))) for k in range(4)]
        best = None
        for level in config.levels:
            over = lambda i: any(x / u > level for x, u in zip(scores[i], units))  # noqa: B023, E731
            good = [over(i) for i in ids if marks[i] == 1 and i not in shaping]
            bad = [over(i) for i in ids if marks[i] == 0 and i not in shaping]
            n, k = len(good), sum(good)
            if not n or sum(comb(n, j) * config.alpha**j * (1 - config.alpha) ** (n - j) for j in range(k + 1)) > config.delta / walks:
                break
            gain = sum(bad) / max(1, len(bad)) - 10 * k / n
            if sum(bad) and (best is None or gain > best[0]):
                best = (gain, [level * u for u in units])
        if best:
            out |= {x: best[1] for x in part if part[x] == group}
    return out


def corpus():
    good, bad = labelled(400, 90)
    more = [labelled(n, 30, lang, start) for n, lang, start in ((300, "de", 10_000), (75, "fr", 20_000), (70, None, 30_000))]
    rows = good + bad + [x for pair in more for kind in pair for x in kind]
    marks = {i: 1 for i, *_ in good} | {i: 0 for i, *_ in bad}
    for g, b in more:
        marks |= {i: 1 for i, *_ in g} | {i: 0 for i, *_ in b}
    # Some good ones that a rule hits, bad ones that none does, a stratum without labels.
    rng = np.random.default_rng(4)
    rows += [(40_000 + i, " ".join(f"W{k}{i}" if rng.random() < 0.02 * i else f"w{k}{i}" for k in range(30)), "de") for i in range(40)]
    rows += [(50_000 + i, " ".join(f"word{k}x{i}" for k in range(20)), "en") for i in range(20)] + [(60_000 + i, "*" * 30 + " a b c d e f g h i j k l", "xx") for i in range(3)]
    marks |= {40_000 + i: 1 for i in range(40)} | {50_000 + i: 0 for i in range(20)}
    return rows, marks


def test_cutoffs_and_verdicts_against_brute_force(spark, docs):
    rows, marks = corpus()
    df, config = docs(rows), quality.QualityConfig()
    labels = spark.createDataFrame([(i, q, 0) for i, q in marks.items()] + [(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    shaping = {r.doc_id for r in df.where(F.pmod(F.xxhash64(F.lit("shape"), "doc_id"), F.lit(3)) == 0).collect()}
    expected = brute_cutoffs(rows, marks, shaping, config)
    assert {"en", "de", "fr", None} == set(expected)
    out = {r.doc_id: r for r in quality.quality_verdicts(df, labels).collect()}
    for i, text, lang in rows:
        words, chars, symbols, dups, repeats, lines, upper = quality.measure(text)
        ok = words >= 10 and 100 * repeats <= 20 * words
        x = (symbols / max(chars, 1), upper / max(chars, 1), dups / max(lines, 1), repeats / max(words, 1))
        assert out[i].base_failed == (not ok)
        assert out[i].kept == (ok and not (lang in expected and any(a > b for a, b in zip(x, expected[lang])))), (i, lang, x)
    assert all(out[i].kept for i in range(60_000, 60_003))  # no labels: no cutoff
    kept = quality.quality_filter(df, labels)
    assert {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if r.kept} and kept.columns == df.columns and kept.dtypes == df.dtypes


def test_false_rejection_stays_under_alpha(spark, docs):
    """Of strata of good documents with a share of shouted ones, drawn many times, hardly any loses more than alpha."""
    config = quality.QualityConfig()
    rng, lost, certified = np.random.default_rng(1), 0, 0
    for _ in range(400):
        truth = 1.5 * config.alpha  # levels that reject this share of good ones must not pass
        good = rng.binomial(300, truth)
        found = quality.walk(np.array([300 - good, good] + [0] * (len(config.levels) - 1)), np.array([0, 50] + [0] * (len(config.levels) - 1)), 1, config)
        certified += found is not None
        lost += found is not None and found["level"] == config.levels[-1]
    assert certified == lost <= 0.05 * 400


def test_a_rule_that_hits_good_documents_is_wide(spark, docs):
    _, bad = labelled(0, 1500)
    labels = spark.createDataFrame([(i, 1, 0) for i, *_ in bad], "doc_id long, quality int, toxic int")
    assert all(r.kept for r in quality.quality_verdicts(docs(bad), labels).collect())


def test_words_in_pieces(monkeypatch):
    text = " ".join(f"w{k % 7} x{k % 5}\n" for k in range(400))
    whole = quality.measure(text)
    monkeypatch.setattr(quality, "PIECE", 13)
    assert quality.measure(text) == whole == quality.measure(text)


def test_corner_cases(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = [(1, None, None), (2, "", "en"), (None, "a b c d e f g h i j k", None), (3, "w " * 50), (3, "w " * 50), (4, " ".join(map(str, range(200_000))))]
    out = quality.quality_verdicts(docs(rows), none).collect()
    assert len(out) == 6 and {(r.doc_id, r.base_failed) for r in out} == {(1, True), (2, True), (None, False), (3, True), (4, False)}
    assert quality.quality_verdicts(docs([]), none).count() == 0

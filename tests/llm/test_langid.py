import numpy as np
import pytest

from skygauge.llm import langid

VOICES = {"aa": "the and of which that them".split(), "bb": "ueber nicht schon wieder auch ganz".split(), "cc": "été cœur où déjà voilà ça".split()}


def corpus(n=240, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, " ".join(rng.choice(VOICES[k], rng.integers(5, 60))), k) for i in range(n) for k in [list(VOICES)[i % 3]]]


def test_held_out_accuracy_and_rule(spark, docs):
    import zlib

    rows = corpus()
    out = {r.doc_id: r for r in langid.identify(docs(rows), config=langid.LangIdConfig(epochs=5)).collect()}
    assert len(out) == len(rows)
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows)
    held = [(out[i].lang_pred, k) for i, _, k in rows if out[i].held_out]
    assert len(held) > 30 and np.mean([a == b for a, b in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in out.values())


def test_corner_cases(spark, docs):
    rows = corpus(90) + [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 34 !!", "bb"), (1003, "nicht wieder", None), (None, "the and of", "aa"), (None, "the and of", "aa"), (1004, "été où " * 200_000, "cc")]
    out = langid.identify(docs(rows), config=langid.LangIdConfig(epochs=4)).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(rows) and [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1000].score == 0.0
    assert by[1003].lang_pred == "bb" and by[1004].lang_pred == "cc" and by[None].held_out is False
    assert langid.identify(docs([])).count() == 0
    assert {r.lang_pred for r in langid.identify(docs([(1, "abc", None)])).collect()} == {"und"}


def test_labels_of_held_out_rows_do_not_matter(spark, docs):
    import zlib

    rows = corpus(60)
    wrong = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else k) for i, t, k in rows]
    config = langid.LangIdConfig(epochs=3)
    assert sorted(map(tuple, langid.identify(docs(rows), config=config).collect())) == sorted(map(tuple, langid.identify(docs(wrong), config=config).collect()))


def test_calibration_orders_by_confidence():
    logits = np.array([[5.0, 0], [4.0, 0], [0.2, 0.0], [0.0, 0.1]])
    temperature, cutoff = langid.calibrate(logits, np.array([0, 0, 1, 0]), 0.99)
    p = langid.softmax(logits / temperature).max(axis=1)
    assert p[1] >= cutoff > p[2] and temperature > 0
    assert langid.calibrate(np.zeros((0, 2)), np.zeros(0, int), 0.9) == (1.0, 0.0)


@pytest.mark.parametrize("text", ["", "x", "ab cd", "É" * 10])
def test_subwords_depend_on_letters_only(text):
    a = np.concatenate([*langid.subwords(text), np.zeros(0, int)])
    b = np.concatenate([*langid.subwords(f" {text.upper()}!!1 "), np.zeros(0, int)])
    assert sorted(a) == sorted(b)


def brute_buckets(text):
    """Buckets of a text by the docstring: letter runs, ends marked, grams of one to four."""
    out, runs, run = [], [], ""
    for c in text.lower() + " ":
        if c.isalpha():
            run += c
        elif run:
            runs.append(run)
            run = ""
    for run in runs:
        marked = [0, *map(ord, run), 0]
        grams = [[c] for c in marked[1:-1]] + [marked[i : i + n] for n in (2, 3, 4) for i in range(len(marked) - n + 1)]
        for gram in grams:
            value = 0
            for c in gram:
                value = (value * 0x100000001B3 + c + 1) % (1 << 64)
            out.append((value * 0x9E3779B97F4A7C15) % (1 << 64) >> 49)
    return sorted(out)


@pytest.mark.parametrize("text", ["", "a", "ab", "Abc d, efghij 12k!", "été\nnicht ß 漢字 x_y", "one " * 50])
def test_subwords_against_brute_force(text):
    assert sorted(np.concatenate([*langid.subwords(text), np.zeros(0, int)]).tolist()) == brute_buckets(text)
    made = langid.bag(text)
    if brute_buckets(text):
        at, share = np.frombuffer(made[0], "<u2"), np.frombuffer(made[1], "<f4")
        expected = {b: brute_buckets(text).count(b) / len(brute_buckets(text)) for b in set(brute_buckets(text))}
        assert dict(zip(at.tolist(), share.tolist())) == pytest.approx(expected, rel=1e-5)
    else:
        assert made is None


def test_one_step_follows_the_gradient():
    """A step on one batch against finite differences of the mean log loss."""
    config = langid.LangIdConfig(dimension=3, epochs=1, min_steps=1, batch=8, rate=0.5)
    texts, labels = ["abc", "abd", "xyz", "xy abd"], np.array([0, 0, 1, 2])
    bags = [(np.frombuffer(a, "<u2").astype(np.int64), np.frombuffer(b, "<f4")) for a, b in map(langid.bag, texts)]
    rng = np.random.default_rng(config.seed)
    embed = (rng.uniform(-1, 1, (langid.BUCKETS, 3)).astype(np.float32) / 3).astype(float)
    after, weight, bias = langid.train(bags, labels, 3, config)

    def loss(e, w, b):
        z = np.array([share @ e[at] for at, share in bags]) @ w + b
        return -np.log(langid.softmax(z)[np.arange(4), labels]).mean()

    zero, none, step = np.zeros((3, 3)), np.zeros(3), 1e-6
    for i in range(3):
        for j in range(3):
            moved = zero.copy()
            moved[i, j] = step
            slope = (loss(embed, moved, none) - loss(embed, -moved, none)) / (2 * step)
            assert weight[i, j] == pytest.approx(-config.rate * slope, abs=1e-5)
        moved = none.copy()
        moved[i] = step
        assert bias[i] == pytest.approx(-0.1 * config.rate * (loss(embed, zero, moved) - loss(embed, zero, -moved)) / (2 * step), abs=1e-5)
    assert np.allclose(after, embed, atol=1e-6)  # the first step's softmax weights are zero, so embeddings get no gradient


def test_predictions_against_brute_force(spark, docs):
    rows = corpus(80)
    config = langid.LangIdConfig(epochs=3)
    model = langid.fit(docs(rows).where(~langid.is_held_out()), config)
    out = {r.doc_id: r.p for r in docs(rows).select("doc_id", langid.predict(docs(rows), model).alias("p")).collect()}
    for i, text, _ in rows:
        z = np.mean([model.table[b] for b in brute_buckets(text)], axis=0) + model.bias
        p = np.exp(z / model.temperature) / np.exp(z / model.temperature).sum()
        assert out[i].lang_pred == model.languages[int(p.argmax())] and out[i].score == pytest.approx(p.max(), rel=1e-4) and out[i].rejected == (out[i].score < model.cutoff)


def test_a_very_long_text_is_read_whole(spark, docs, monkeypatch):
    """In pieces: what a piece's end parts counts as two words, all else as in one piece. An empty table gives no rows."""
    text = "aé bc " * 60
    whole = np.sort(np.concatenate(list(langid.subwords(text))))
    monkeypatch.setattr(langid, "PIECE", 30)  # ends between words
    assert np.array_equal(np.sort(np.concatenate(list(langid.subwords(text)))), whole)
    monkeypatch.setattr(langid, "PIECE", 31)
    parted = "".join(text[i : i + 31] + " " for i in range(0, len(text), 31))
    pieces = np.sort(np.concatenate(list(langid.subwords(text))))
    monkeypatch.setattr(langid, "PIECE", 1 << 20)
    assert np.array_equal(np.sort(np.concatenate(list(langid.subwords(parted)))), pieces)
    long_ = "the cat and the hat " * 100_000  # two million characters: two pieces
    rows = [(i, "the cat and the hat" if i % 2 else "le chat et le chapeau", "en" if i % 2 else "fr") for i in range(60)]
    out = {r.doc_id: r.lang_pred for r in langid.identify(docs([*rows, (1000, long_)])).collect()}
    assert out[1000] == "en" and langid.identify(docs([])).count() == 0

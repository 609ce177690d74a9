import numpy as np
import pytest

from skygauge.llm import chat, mixing


def brute_targets(sizes, weights=(5.0, 2.0, 1.0), most=3.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, full = {}, set()
    while True:
        left = sum(sizes.values()) - sum(target[s] for s in full)
        free = [s for s in names if s not in full]
        share = {s: left * w[s] / sum(w[k] for k in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s] + 1e-9]
        if not over:
            return target | share
        for s in over:
            target[s] = most * sizes[s]
            full.add(s)


def rows(seed=0, n=3000):
    rng = np.random.default_rng(seed)
    names = ["a", "b", "Z", "é", None, "tiny", "z" * 3]
    share = np.array([0.4, 0.2, 0.1, 0.1, 0.1, 0.01, 0.09])
    return [(i, " ".join(["w"] * int(rng.integers(0, 80))), "en", names[rng.choice(7, p=share)]) for i in range(n)]


def test_targets_rates_and_copies(spark, docs):
    data = rows()
    out = mixing.mix(docs(data), config=mixing.MixConfig(group_rows=100)).collect()
    assert len(out) == len(data)
    sizes, taken = {}, {}
    for r in out:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size and abs(r.copies - r.rate) < 1
    target = brute_targets(sizes)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
    for s in sizes:
        assert taken[s] == pytest.approx(target[s], rel=0.02), s
        exact = sum(r.rate * r.size for r in out if r.source == s)
        assert exact == pytest.approx(target[s], rel=1e-6)
    for s in ("a", "b"):  # rates are an exponential tilt of the size
        own = sorted({(r.size, r.rate) for r in out if r.source == s and 0 < r.rate < 2.99 and r.size})
        slope = [np.log(rate) / size for size, rate in own]
        assert np.allclose(slope, slope[0], rtol=1e-6)
    again = mixing.mix(docs(data[::-1]), config=mixing.MixConfig(group_rows=100)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in out)


def test_corner_cases(spark, docs):
    assert mixing.mix(docs([])).count() == 0
    out = mixing.mix(docs([(1, None), (2, ""), (None, "a b c"), (None, "a b c"), (3, "x", "en", None), (4, None, "en", "empty")])).collect()
    assert len(out) == 6 and all(r.taken <= 3 * r.size for r in out) and {r.target for r in out if r.source == "empty"} == {0.0}
    assert all(r.target == 0 and r.taken == 0 for r in mixing.mix(docs([(1, None), (2, "")])).collect())


def test_documents_of_one_kind_spread_over_groups(spark, docs):
    rng = np.random.default_rng(3)
    rows = [(None, "w w w", "en", "a")] * 5000 + [(7, "w " * 5, "en", "a")] * 2500 + [(i, "w " * int(rng.integers(1, 9)), "en", "bc"[i % 2]) for i in range(3000)]
    df = docs(rows)
    out = mixing.mix(df, config=mixing.MixConfig(group_rows=500)).collect()
    assert len(out) == len(rows)
    for s in "abc":
        taken, target = sum(r.taken for r in out if r.source == s), next(r.target for r in out if r.source == s)
        assert taken == pytest.approx(target, rel=0.01)
    assert all(abs(r.copies - r.rate) < 1 for r in out)
    again = mixing.mix(df.repartition(7), config=mixing.MixConfig(group_rows=500)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.copies)
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_many_sources_in_order(spark):
    names = [f"s{i:03d}" for i in range(300)] + ["Z", "é", None]
    df = spark.createDataFrame([(n, 10 + i % 7 * 30, 1, 1.0) for i, n in enumerate(names)], "source string, total long, n long, z double").repartition(5)
    out = {r.source: r for r in mixing.capped_targets(df, mixing.MixConfig()).collect()}
    expected = brute_targets({n: 10 + i % 7 * 30 for i, n in enumerate(names)})
    assert {k: r.target for k, r in out.items()} == pytest.approx(expected) and out["Z"].weight == 5.0


def test_unsolved_rates_are_an_error(spark, docs):
    with pytest.raises(RuntimeError):
        mixing.mix(docs(rows(2, 500)), config=mixing.MixConfig(max_steps=1)).count()


def test_repeat_rows(spark, docs):
    df = docs(rows(1, 300))
    mixed = mixing.mix(df)
    made = mixing.repeat_rows(df, mixed)
    expected = {r.doc_id: r.copies for r in mixed.collect() if r.copies}
    assert {r.doc_id: r["count"] for r in made.groupBy("doc_id").count().collect()} == expected and made.columns == df.columns


def test_preferences(spark):
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (0, 2, "user", "more"), (0, 3, "assistant", "good"), (1, 1, "assistant", "yes"), (1, 0, "user", "hi"), (1, 2, "user", "less"), (1, 3, "assistant", "bad"),
        (2, 0, "user", "same"), (3, 0, "user", "same"), (4, 0, None, None), (4, 1, "assistant", "é"), (5, 0, "system", "s"), (6, 0, "user", "alone"), (None, 0, "user", "nobody")]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, turns string")
    out = {r.pair_id: r for r in chat.preferences(df, chat.neighbours(df)).collect()}
    assert len(out) == 4
    first = out[0]
    assert first.n_prompt_turns == 2 and first.prompt == "<|user|>\nhi<|end|>\n<|assistant|>\nyes<|end|>\n"
    assert first.chosen == "<|user|>\nmore<|end|>\n<|assistant|>\ngood<|end|>\n" and first.rejected == "<|user|>\nless<|end|>\n<|assistant|>\nbad<|end|>\n"
    a, b = map(int, first.chosen_mask.split(":"))
    assert first.chosen[a:b] == "good<|end|>"
    assert out[1].n_prompt_turns == 1 and out[1].chosen == out[1].rejected == "" and out[1].chosen_mask == ""
    assert out[2].prompt == "" and out[2].chosen.startswith("<|user|>\n<|end|>") and out[3].rejected_id is None and out[3].rejected == "" and out[3].n_prompt_turns == 0
    empty = df.where("false")
    assert chat.preferences(empty, chat.neighbours(empty)).count() == 0


def brute_replies(turns):
    talks = {}
    for conv, turn, role, text, *_ in turns:
        if conv is not None:
            talks.setdefault(conv, []).append((turn, role or "user", text or ""))
    talks = {k: [t[1:] for t in sorted(v)] for k, v in talks.items()}
    last = {k: max(i for i, t in enumerate(v) if t[0] == "assistant") for k, v in talks.items() if any(t[0] == "assistant" for t in v)}
    out, show = {}, lambda ts: "".join(f"<|{r}|>\n{x}<|end|>\n" for r, x in ts)
    for k, i in last.items():
        other = k ^ 1 if k ^ 1 in last else None
        rejected = talks[k][:i] + ([talks[other][last[other]]] if other is not None else [])
        n = 0
        while n < min(len(talks[k]), len(rejected)) and talks[k][n] == rejected[n]:
            n += 1
        out[k] = (other, n, show(talks[k][:n]), show(talks[k][n:]), show(rejected[n:]))
    return out


def test_replies_against_brute_force(spark):
    rng = np.random.default_rng(6)
    turns = [(int(c), int(t), [None, "user", "assistant", "assistant", "system"][rng.integers(5)], [None, "", "a", "b é", "c\n"][rng.integers(5)], "x") for c in range(40) if c % 7 for t in range(rng.integers(0, 6))]
    turns += turns[:5]  # repeated rows
    turns += [(100, t, "user" if t % 2 == 0 else "assistant", f"turn {t} " * 50, "x") for t in range(2000)] + [(101, 0, "assistant", None, "x"), (None, 0, "assistant", "nobody", "x")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, turns string")
    out = {r.pair_id: r for r in chat.replies(df).collect()}
    expected = brute_replies(turns)
    assert {k: (r.rejected_id, r.n_prompt_turns, r.prompt, r.chosen, r.rejected) for k, r in out.items()} == expected
    assert out[100].n_prompt_turns == 1999 and out[100].rejected == "<|assistant|>\n<|end|>\n" and out[100].rejected_mask == "14:21"
    for r in out.values():
        for text, mask in ((r.chosen, r.chosen_mask), (r.rejected, r.rejected_mask)):
            spans = [tuple(map(int, x.split(":"))) for x in mask.split(",") if x]
            assert "".join(text[a:b] for a, b in spans).count("<|end|>") == text.count("<|assistant|>") == len(spans)
    assert chat.replies(df.where("false")).count() == 0


def test_very_long_texts_and_conversations(spark, docs):
    words = 200_000
    mixed = {r.doc_id: r for r in mixing.mix(docs([(i, "w " * (words if i == 0 else 50), "en", "s") for i in range(200)])).collect()}
    assert mixed[0].size == words and all(r.copies <= 3 for r in mixed.values())
    turns = [(0, i, "user" if i % 2 == 0 else "assistant", "x" * 2000) for i in range(1000)] + [(1, i, "user" if i % 2 == 0 else "assistant", "x" * 2000 if i < 999 else "other") for i in range(1000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = {r.pair_id: r for r in chat.preferences(df, chat.neighbours(df)).collect()}
    assert out[0].n_prompt_turns == 999 and len(out[0].prompt) > 2_000_000 and out[0].rejected.endswith("other<|end|>\n")
    twice = spark.createDataFrame([*turns[:2], *turns[:2]], df.schema)
    assert chat.conversations(twice).first().turns == [("user", "x" * 2000)] * 2 + [("assistant", "x" * 2000)] * 2

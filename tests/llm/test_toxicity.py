"""The clause grammar against a plain reading of its rules, and toxicity on held-out labels."""

import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from skygauge.llm import toxicity as t
from skygauge.llm.queries import QUERIES


def brute_patterns(kinds):
    """The pattern of each match of a sequence of classes, read off the rules one by one."""
    out, quoted = [], False
    for i, kind in enumerate(kinds):
        start = max((j + 1 for j in range(i) if kinds[j] in t.ENDS), default=0)
        clause = kinds[start:i]
        near = clause[-t.REACH :]
        match = kind == t.INSULT or kind == t.HARM and t.INTENT in near
        quoted = False if kinds[i - 1 : i] == [t.BREAK] else quoted
        if match:
            verb = [j for j in range(start, i) if kinds[j] == t.REPORT and not quoted_at(kinds, j)]
            last_quote = max((j for j in range(start, i) if kinds[j] == t.QUOTE), default=-1)
            reported = quoted_at(kinds, i) or any(j > last_quote for j in verb)
            out.append((i, 3 if reported else 2 if t.NEGATION in near else 4 if kind == t.HARM else 1 if t.TARGET in clause else 0))
    return out


def quoted_at(kinds, i):
    since = max((j + 1 for j in range(i) if kinds[j] == t.BREAK), default=0)
    return kinds[since:i].count(t.QUOTE) % 2 == 1


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(range(t.CLASSES)), max_size=25))
def test_composed_transducer_follows_the_rules(kinds):
    state, found = 0, []
    for i, kind in enumerate(kinds):
        marks, state = t.GRAMMAR.marks[state][kind], t.GRAMMAR.step[state][kind]
        if marks & t.MATCH:
            found.append((i, t.pattern(marks)))
    assert found == brute_patterns(kinds)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["plain", "idiot", "kill", "you", "not", "said", "will", '"', ".", "\n", "stem-x", "stemy"]), max_size=40))
def test_features_skip_other_words_without_losing_state(words):
    lexicon = t.Lexicon({"idiot": 2.0, "stem*": 1.5})
    text = " ".join(words).replace("stem-x", "stemlike")
    tokens = t.TOKEN.findall(text.lower())
    codes = [lexicon[x] for x in tokens]
    expected = np.zeros(len(t.PATTERNS))
    for i, p in brute_patterns([min(c, t.INSULT) for c in codes]):
        expected[p] += lexicon.weights[codes[i]]
    found = t.features(text, lexicon)
    assert np.allclose(found[: len(t.PATTERNS)], expected) and found[-1] == sum(x[0].isalpha() for x in tokens)


def test_clauses_say_what_is_meant():
    model = t.ToxicityModel(t.seeds())
    lexicon = t.Lexicon(model.terms)
    score = lambda x: float(model.scores(t.features(x, lexicon)[None])[0])
    assert score("You are such an idiot, you moron!") > score("an idiot and a moron") > score("He is not an idiot. She is no moron.")
    assert score('They said "you idiot" and left.') < score("they left, you idiot")
    assert score("I will kill you") > 0.5 > score("They kill time") and score("The weather is fine.") < 0.2
    assert score(None) == score("") == score("12 %%") < 0.5


def test_long_texts_are_read_whole(monkeypatch):
    lexicon, text = t.Lexicon(t.seeds()), "some words here, idiot. You will not be moron " * 40
    whole = t.features(text, lexicon)
    monkeypatch.setattr(t, "PIECE", 60)
    assert np.allclose(t.features(text, lexicon), whole) and "".join(t.pieces(text)) == text.lower()
    assert "".join(t.pieces("A" * 500)) == "a" * 500


def made(n):
    rng = random.Random(1)
    plain = [f"{a}{b}" for a in ("lor", "ips", "dol", "ame", "con", "sec") for b in ("um", "or", "et", "is", "an", "ent", "it")]
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 120))]
        for _ in range(max(2, len(words) // 20) if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(["zorg", "blargh", *(f"quax{e}" for e in ("i", "o", "um", "ent", "ar"))])
        rows.append((i, " ".join(words) + ".", int(toxic)))
    return rows


def test_query_learns_words_and_stems(spark, tmp_path):
    rows = made(900)
    copies = [(5000 + i, "insidious repeated page with these very words in it " * 3 + f"n{i}", 1) for i in range(40)]
    more = [(None, "zorg blargh zorg", None), (9000, None, 0), (9001, "", 1), (9002, "zorg, quaxling! you quaxter " * 3, None)]
    both = rows + copies + more
    docs = spark.createDataFrame([(i, x, "x", 1) for i, x, _ in both], "doc_id long, text string, score string, toxic int")
    labels = spark.createDataFrame([(i, y) for i, _, y in both if i is not None and y is not None] + [(9002, None)], "doc_id long, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = {r.doc_id: r for r in QUERIES["op12_toxicity"](spark, str(tmp_path)).collect()}
    assert len(out) == len(both) and set(next(iter(out.values())).__fields__) >= {"doc_id", "held_out", "score", "predicted"}
    assert all(r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in out.items())
    held = [(out[i].predicted, y) for i, _, y in rows if out[i].held_out]
    assert len(held) > 100 and sum(p == y for p, y in held) >= 0.97 * len(held)
    assert out[9002].predicted == 1 and out[9000].predicted == out[9001].predicted == 0


def test_terms_are_stems_that_branch_and_copies_count_once(spark):
    rows = made(900)
    copies = [(5000 + i, "insidious repeated page with these very words in it " * 3 + f"n{i}", 1) for i in range(40)]
    df = spark.createDataFrame([(y, x) for _, x, y in rows + copies], "toxic int, text string")
    terms = t.fit(df).terms
    assert "zorg" in terms and "quax*" in terms and not {"zor*", "qua*", "blar*", "insidious", "repeated"} & set(terms)


def test_without_rows_or_labels(spark):
    docs = spark.createDataFrame([(1, "you idiot, you moron"), (2, "fine words")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.doc_id: r.predicted for r in t.judge(docs, none).collect()} == {1: 1, 2: 0}
    assert t.judge(docs.where("false"), none).count() == 0

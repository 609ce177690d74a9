"""The registered queries, and the pipeline against its stages in plain Python."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import tokenizers

import corpus_pipeline
from skygauge.llm.queries import ORACLES, QUERIES, tokenizer_path
from tests.llm.test_dedup import brute_substrings
from tests.llm.test_mixing_and_chat import brute_targets
from tests.llm.test_simhash import brute_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, tmp_path, name):
    QUERIES[name](spark, SF).write.parquet(f"{tmp_path}/out")
    db = duckdb.connect()
    for t in ("documents", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    db.execute(f"CREATE TABLE o AS {ORACLES[name]}")
    db.execute(f"CREATE TABLE s AS SELECT * FROM '{tmp_path}/out/*.parquet'")
    names = ", ".join(sorted(r[0] for r in db.execute("DESCRIBE o").fetchall()))
    assert names == ", ".join(sorted(r[0] for r in db.execute("DESCRIBE s").fetchall()))
    assert db.execute("SELECT count(*) FROM o").fetchall() == db.execute("SELECT count(*) FROM s").fetchall()
    assert db.execute(f"SELECT count(*) FROM (SELECT {names} FROM o EXCEPT ALL SELECT {names} FROM s)").fetchall()[0][0] == 0


@pytest.mark.parametrize("name,columns", [
    ("op1_language_id", {"doc_id", "held_out", "lang_pred", "score"}), ("op2_simhash", {"doc_id", "fingerprint", "component_id"}),
    ("op4_quality_rules", {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"}), ("op5_bpe_round_trip", {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}),
    ("op6_mix_sources", {"doc_id", "size", "source_size", "target", "taken"}), ("op7_embedding_dedup", {"vec_id", "n_links", "component_id", "kept"}),
    ("op8_suffix_dedup", {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"})])
def test_query_returns_its_contract(spark, name, columns):
    out = QUERIES[name](spark, SF)
    rows = spark.read.parquet(f"{SF}/{'embeddings' if name.startswith('op7') else 'documents'}.parquet").count()
    assert columns <= set(out.columns) and out.count() == rows


def first_of_groups(rows):
    """The smallest id of each group of (id, text) linked by fingerprints of two bits or fewer, or by five-word shingles."""
    prints, sets = [brute_fingerprint(t) for _, t in rows], []
    for _, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set()))
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            alike = sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
            if alike or (prints[i] ^ prints[j]).bit_count() <= 2:
                top[find(i)] = find(j)
    return {min(rows[j][0] for j in range(len(rows)) if find(j) == find(i)) for i in range(len(rows))}


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert docs.columns == columns
        seen.append([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
        if i == 2:
            sources = {r.doc_id: r.source for r in docs.collect()}
    good, distinct, cut, mixed = seen
    kept = {r.doc_id for r in QUERIES["op4_quality_rules"](spark, SF).where("kept").collect()}
    assert {d for d, _ in good} == kept
    assert {d for d, _ in distinct} == first_of_groups(good)
    expected = {d: k.decode("utf-8", "ignore") for d, n, gone, _, k in brute_substrings(distinct) if k or not gone}
    assert dict(cut) == expected
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = Counter(), Counter()
    for d, t in cut:
        sizes[sources[d]] += words(t)
    for d, t in mixed:
        assert expected[d] == t
        taken[sources[d]] += words(t)
    target = brute_targets(sizes)
    assert set(taken) == set(sizes) and max(Counter(d for d, _ in mixed).values()) <= 3
    for source in sizes:  # in a few dozen documents the longest ones don't divide evenly
        assert taken[source] == pytest.approx(target[source], abs=0.02 * target[source] + max(words(t) for d, t in cut if sources[d] == source) / 2)
    library = tokenizers.Tokenizer.from_file(tokenizer_path())
    coded = []
    for d, t in mixed:
        ids = library.encode(t or "", add_special_tokens=False).ids
        coded.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == sorted(coded)


def test_line_dedup_query_removes_short_lines_too(spark, tmp_path):
    rows = [(1, "short one\n\nx"), (2, "Short  one\n\nx\ny"), (3, "y\n \nsome words that are only here")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: (r.n_kept, r.n_removed, r.spans, r.kept_sha256) for r in QUERIES["op3_line_dedup"](spark, str(tmp_path)).collect()}
    sha, left = lambda x: hashlib.sha256(x.encode()).hexdigest(), rows[2][1].removeprefix("y\n")
    assert out == {1: (12, 0, "", sha("short one\n\nx")), 2: (2, 13, "0:11,12:14", sha("\ny")), 3: (len(left), 2, "0:2", sha(left))}

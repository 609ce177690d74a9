import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skygauge.llm import bpe, packing
from skygauge.llm.queries import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")


def texts():
    rng = random.Random(4)
    alphabet = [*"abcXYZ 019.,'\n\t", "é", "ß", "漢字", "😀", " ", "<|endoftext|>", "'ll", "  ", "²", "\u0085", "\u001f", "\u0000"]
    out = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(150)]
    return [*out, "", None, " ", "<|endoftext|>", "word " * 3000, "x" * 5000, "tail   <|endoftext|>  head"]


@pytest.mark.parametrize("limits,stable", [(bpe.BpeLimits(), True), (bpe.BpeLimits(50, 400, 500, 4000), False)])
def test_ids_and_round_trip(spark, docs, stored, limits, stable):
    rows = list(enumerate(texts())) + [(3, "again"), (3, "again"), (None, "no id")]
    library = tokenizers.Tokenizer.from_file(tokenizer_path())
    df = stored(docs(rows)) if stable else docs(rows)
    got = sorted(((-1 if r.doc_id is None else r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in bpe.encode_and_decode(df, tokenizer_path(), stable=stable, limits=limits).collect()))
    expected = []
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        expected.append((-1 if doc is None else doc, len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(expected)


def test_a_frame_that_differs_when_read_again(spark, docs):
    """Is stored first: its rows agree with each other."""
    df = docs([(i, "text") for i in range(50)]).withColumn("text", F.concat(F.lit("w"), (F.rand() * 1e6).cast("int").cast("string")))
    out = bpe.encode_and_decode(df, tokenizer_path()).collect()
    assert len(out) == 50 and all(r.decoded.startswith("w") for r in out)


def test_pieces_of_a_text_split_alike(monkeypatch):
    vocab, text = bpe.vocabulary(tokenizer_path()), "some words, <|endoftext|> and more é words of a text " * 9
    whole = [w for ws in vocab.split(text) for w in ws]
    monkeypatch.setattr(bpe, "PIECE", 64)
    assert [w for ws in vocab.split(text) for w in ws] == whole


def test_split_of_every_latin_character():
    vocab, library = bpe.vocabulary(tokenizer_path()), tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False)
    for i in range(0x250):
        for text in (f"a{chr(i)}b", f"  {chr(i)}{chr(i)} c"):
            expected = [text[a:b] for _, (a, b) in library.pre_tokenize_str(text)]
            assert [w for ws in vocab.split(text) for w in ws] == expected


def test_empty_and_arrays(spark, docs, stored):
    assert bpe.encode_and_decode(stored(docs([])), tokenizer_path()).count() == 0
    out = bpe.ids_array(bpe.encode_and_decode(stored(docs([(1, "hello")])), tokenizer_path())).first()
    assert out.ids == tokenizers.Tokenizer.from_file(tokenizer_path()).encode("hello").ids


def brute_best_fit(sizes, capacity):
    rows = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [r for r in rows if sum(sizes[k] for k in r) + sizes[i] <= capacity]
        if fits:
            max(fits, key=lambda r: sum(sizes[k] for k in r)).append(i)
        else:
            rows.append([i])
    return rows


def test_best_fit_decreasing_is_as_tight_as_brute_force():
    rng = np.random.default_rng(0)
    for capacity in (1, 7, 64, 100):
        sizes = rng.integers(1, capacity + 1, 80)
        rows = packing.best_fit_decreasing(sizes, capacity)
        assert sorted(i for r in rows for i in r) == list(range(80)) and all(sizes[r].sum() <= capacity for r in rows)
        fill = lambda rows: sorted(int(sizes[r].sum()) for r in rows)
        assert fill(rows) == fill(brute_best_fit(sizes.tolist(), capacity))


def test_packed_rows_give_the_documents_back(spark, docs, tmp_path):
    rows = list(enumerate(texts())) + [(None, "no id"), (3, "twice"), (3, "twice")]
    path, config = tokenizer_path("byte_bpe_50k.tiktoken"), packing.PackConfig(row_tokens=64)
    packing.write_packed(packing.pack(docs(rows), path, config=config), str(tmp_path / "packed"))
    pieces, used = {}, 0
    for r in spark.read.parquet(str(tmp_path / "packed")).collect():
        ids, positions = np.frombuffer(r.input_ids, "<u4"), np.frombuffer(r.position_ids, "<u4")
        assert len(ids) == 64 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and (ids[r.n_tokens :] == config.pad_id).all()
        for doc, start, a, b in zip(r.doc_ids, r.piece_starts, r.cu_seqlens, r.cu_seqlens[1:]):
            pieces.setdefault(doc, []).append((start, ids[a:b].tolist()))
            assert positions[a:b].tolist() == list(range(b - a))
        used += r.n_tokens
    encode = packing.encoder(path).encode_ordinary
    expected = {}
    for doc, text in rows:
        expected.setdefault(doc, []).append([*encode(text or ""), config.end_id])
    for doc, own in expected.items():
        if len(own) == 1:
            assert [x for _, p in sorted(pieces[doc]) for x in p] == own[0]
    assert used == sum(len(x) for own in expected.values() for x in own)
    assert packing.pack(docs([]), path).count() == 0


def test_digest_is_of_little_endian_words():
    assert hashlib.sha256(np.array([1, 50256], "<u4").tobytes()).hexdigest() == hashlib.sha256(b"\x01\0\0\0\x50\xc4\0\0").hexdigest()


def test_many_small_partitions_fill_their_rows(spark, docs):
    rows = [(i, "some words of a text " * (1 + i % 40)) for i in range(600)]
    out = packing.pack(docs(rows).repartition(60), tokenizer_path("byte_bpe_50k.tiktoken")).collect()
    assert len({r.block for r in out}) == 1 and sum(r.n_tokens for r in out) / (2048 * len(out)) > 0.95
    assert sorted(x for r in out for x in r.doc_ids) == list(range(600))

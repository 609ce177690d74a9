"""Byte-level BPE through a table of distinct words.

Texts are split into the tokenizer's words in Spark, by blocks of bounded size; a block
numbers its distinct words and keeps each text as a sequence of those numbers. The distinct
words of all blocks meet by hash, each is encoded once, and its ids go back to the blocks
that asked for it, where they are joined in by position. Decoding joins ids to the pieces
of the vocabulary, a table of fixed size, and concatenates their bytes.

Blocks are bounded by their distinct words and by their words in all (a single longer text makes a
block of its own). Words are dealt to parts by hash, a part for so many bytes of text (see BpeLimits), and tasks
likewise, so both keep their size as the table grows; a word of all blocks is one entry a block.
Blocks are made twice, once for their words and once for their sequences, which costs less disk
than storing them; so the input is stored first, unless the caller says that it is a stable table that
gives the same rows whenever it is read. A check value shows if the two should ever differ.

A null text counts as empty and has no ids; repeated rows and ids (null ones too) each give
a row of their own; only the named columns are read; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skygauge.llm.common import exact_id, give_back, materialize, parts_and_tasks, schema, text_batches


@dataclass(frozen=True)
class BpeLimits:
    """The most distinct words and words of a block, and the bytes of text for each part and each task."""

    block_words: int = 200_000
    block_tokens: int = 2_500_000
    part_bytes: int = 4 << 20
    task_bytes: int = 16 << 20


#: Words given to the library at a time.
ENCODE_WORDS = 8192
#: Characters of a text that are split at a time.
PIECE = 1 << 20

# The word pattern of byte-level BPE, and its three classes below U+0250.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBERS = "0-9²³¹¼-¾"
SPACES = "\t-\r \u0085 "

_LATIN = re.compile(rf"{CONTRACTIONS}| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
_BEYOND = re.compile("[^\u0000-ɏ]")
_CUT = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """A tokenizer file for the tokenizers library: splits texts, encodes words, names pieces."""

    def __init__(self, path: str) -> None:
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words_of = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added):
            raise ValueError("only added tokens that match plainly are supported")
        self.special = re.compile("(" + "|".join(re.escape(t.content) for t in sorted(added, key=lambda t: -len(t.content))) + ")") if added else None

    def split(self, text: str) -> Iterator[list[str]]:
        """The words of a text, in order, in lists of bounded size."""
        for i, part in enumerate(self.special.split(text) if self.special and self.special.search(text) else [text]):
            if i % 2:
                yield [part]
                continue
            at = 0
            while at < len(part):
                cut = _CUT.search(part, at + PIECE) if len(part) - at > PIECE else None  # words never span this
                end = cut.start() if cut else len(part)
                piece = part[at:end]
                if _BEYOND.search(piece):
                    yield [piece[a:b] for _, (a, b) in self.words_of.pre_tokenize_str(piece)]
                else:
                    yield _LATIN.findall(piece)
                at = end

    def encode_words(self, words: list[str]) -> list[list[int]]:
        out = []
        for at in range(0, len(words), ENCODE_WORDS):  # the library's results are large; keep few of them at a time
            out += [e.ids for e in self.tokenizer.encode_batch(words[at : at + ENCODE_WORDS], add_special_tokens=False)]
        return out

    @functools.cached_property
    def pieces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and length of each id's bytes, and all bytes."""
        byte = byte_of_char()
        found = []
        for i in range(self.tokenizer.get_vocab_size()):
            piece = self.tokenizer.id_to_token(i) or ""
            found.append(bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode())
        lengths = np.array([len(x) for x in found], dtype=np.int64)
        return np.cumsum(lengths) - lengths, lengths, np.frombuffer(b"".join(found), np.uint8)

    def decode(self, ids: np.ndarray) -> str:
        starts, lengths, data = self.pieces
        return data[ragged(starts[ids], lengths[ids])].tobytes().decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """Loaded once in each process."""
    return Vocabulary(path)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the runs that begin at starts, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def packed(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays in one compressed value; numbers by byte plane, which compresses best."""
    out = []
    for a in arrays:
        data = a if isinstance(a, bytes) else np.ascontiguousarray(a, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
        out += [struct.pack("<q", len(data)), data]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def unpacked(data: bytes) -> list[bytes]:
    raw, out, at = memoryview(zstandard.ZstdDecompressor().decompress(data)), [], 0
    while at < len(raw):
        n = struct.unpack_from("<q", raw, at)[0]
        out.append(bytes(raw[at + 8 : at + 8 + n]))
        at += 8 + n
    return out


def numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _blocks(batches: Iterator[pd.DataFrame], path: str, parts: int, sequences: bool, limits: BpeLimits) -> Iterator[pd.DataFrame]:
    vocab, task = vocabulary(path), TaskContext.get().partitionId()
    ordinal = itertools.count()
    local: dict[str, int]
    local, ids, nulls, texts, total = defaultdict(itertools.count().__next__), [], [], [], 0

    def flush() -> pd.DataFrame:
        block, words = (task << 32) + next(ordinal), list(local)
        coded = [w.encode("utf-8", "surrogatepass") for w in words]
        hashes = np.fromiter(map(zlib.crc32, coded), np.uint32, len(coded))
        check = int(np.bitwise_xor.reduce(hashes * np.arange(1, len(coded) + 1, dtype=np.uint32))) if coded else 0
        if sequences:
            lengths = np.array([len(x) for x in texts], "<u4")
            return pd.DataFrame({"block": [block], "check": [check], "ids": [ids], "nulls": [nulls], "payload": [packed(lengths, np.concatenate([*texts, np.zeros(0, "<u4")]))]})
        rows, part = [], hashes % parts
        order = np.argsort(part, kind="stable")
        for chosen in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else []:
            own = [coded[i] for i in chosen]
            rows.append((block, check, int(part[chosen[0]]), packed(np.diff(chosen, prepend=0), np.array([len(x) for x in own]), b"".join(own))))
        return pd.DataFrame(rows, columns=["block", "check", "part", "payload"])

    for batch in batches:
        for doc, null, text in zip(batch["id"].tolist(), batch["no_id"].tolist(), batch["text"], strict=True):
            seq = [np.fromiter(map(local.__getitem__, words), "<u4", len(words)) for words in vocab.split(text or "")]
            texts.append(np.concatenate(seq) if seq else np.zeros(0, "<u4"))
            ids.append(doc)
            nulls.append(null)
            total += len(texts[-1])
            if len(local) >= limits.block_words or total >= limits.block_tokens:
                yield flush()
                local, ids, nulls, texts, total = defaultdict(itertools.count().__next__), [], [], [], 0
    if ids:
        yield flush()
    del local, ids, nulls, texts
    give_back()


def _encode_part(group: pd.DataFrame, path: str) -> pd.DataFrame:
    """The ids of the words that hash to one part, for each block that has them."""
    asked, table = [], {}
    for payload in group["payload"]:
        at, lengths, data = unpacked(payload)
        ends = np.cumsum(numbers(lengths)).tolist()
        words = [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        asked.append((at, np.fromiter((table.setdefault(w, len(table)) for w in words), np.int64, len(words))))
    found = vocabulary(path).encode_words([w.decode("utf-8", "surrogatepass") for w in table])
    lengths = np.array([len(x) for x in found], dtype=np.int64)
    flat = np.fromiter(itertools.chain.from_iterable(found), np.int64, int(lengths.sum()))
    starts = np.cumsum(lengths) - lengths
    return pd.DataFrame({"block": group["block"], "check": group["check"], "payload": [packed(numbers(at), lengths[k], flat[ragged(starts[k], lengths[k])]) for at, k in asked]})


def _join_block(docs: pd.DataFrame, words: pd.DataFrame, path: str) -> pd.DataFrame:
    """A block's texts as ids, joined in by position, and decoded again."""
    vocab = vocabulary(path)
    if len(docs) != 1 or (words["check"] != docs["check"].iloc[0]).any():
        raise RuntimeError("documents changed between two reads; store them first")
    parts = [[numbers(x) for x in unpacked(p)] for p in words["payload"]]
    at = np.concatenate([np.cumsum(p[0], dtype=np.int64) for p in parts] + [np.zeros(0, np.int64)])
    lengths, starts = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    size = np.concatenate([p[1] for p in parts] + [np.zeros(0, "<u4")]).astype(np.int64)
    flat = np.concatenate([p[2] for p in parts] + [np.zeros(0, "<u4")])
    lengths[at], starts[at] = size, np.cumsum(size) - size
    sizes, seq = map(numbers, unpacked(docs["payload"].iloc[0]))
    out, end = [], 0
    for doc, null, n in zip(docs["ids"].iloc[0], docs["nulls"].iloc[0], sizes.tolist(), strict=True):
        own = seq[end : end + n]
        end += n
        ids = flat[ragged(starts[own], lengths[own])]
        out.append((None if null else int(doc), len(ids), ids.astype("<u4").tobytes(), vocab.decode(ids)))
    del seq, flat
    give_back()
    return pd.DataFrame(out, columns=["id", "n_tokens", "ids", "decoded"], dtype=object)


def encode_and_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", stable: bool = False, limits: BpeLimits | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit numbers, binary) and decoded text of each document.

    The id column must hold integers. stable: docs gives the same rows in the same order whenever it is read, as a scan of files does.
    """
    limits = limits or BpeLimits()
    text_batches(docs.sparkSession)
    rows = docs.select(*exact_id(id_col), F.col(text_col).alias("text"))
    rows = rows if stable else materialize(rows)
    parts, tasks = parts_and_tasks(rows, "text", limits.part_bytes, limits.task_bytes)
    seqs = rows.mapInPandas(lambda it: _blocks(it, path, parts, True, limits), schema("block long, check long, ids long[], nulls boolean[], payload binary"))
    words = rows.mapInPandas(lambda it: _blocks(it, path, parts, False, limits), schema("block long, check long, part long, payload binary"))
    coded = words.repartition(tasks, "part").groupBy("part").applyInPandas(lambda g: _encode_part(g, path), schema("block long, check long, payload binary"))
    both = seqs.repartition(tasks, "block").groupBy("block").cogroup(coded.repartition(tasks, "block").groupBy("block"))
    joined = both.applyInPandas(lambda a, b: _join_block(a, b, path), schema("id long, n_tokens long, ids binary, decoded string"))
    return joined.withColumnRenamed("id", "doc_id")


def ids_array(encoded: DataFrame, ids_col: str = "ids") -> DataFrame:
    """encoded with its binary ids as array<int>."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def unpack(values: pd.Series) -> pd.Series:
        return values.map(lambda x: np.frombuffer(x, "<u4").astype(np.int32))

    return encoded.withColumn(ids_col, unpack(F.col(ids_col)))

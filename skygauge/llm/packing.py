"""Packing documents' token ids into rows of equal length.

Every document becomes its byte-level BPE ids (by tiktoken; the names of special tokens are
ordinary text in it) and one end token, so even an empty one has a place. Documents over the row length are cut into whole rows and a rest; nothing is lost, and
each piece remembers where in its document it began. Pieces are packed best fit decreasing:
from the longest on, each goes into the fullest row that has room, which a segment tree over
the rooms finds in a logarithmic number of steps.

Packing is done in blocks of about BLOCK_TOKENS ids, inside the partitions of the input, so
nothing is shuffled and memory is bounded by a block (or by one longer document). Partitions of under BLOCK_BYTES of
text are put together first, so that even a table of many small ones fills its blocks. A block's
last rows may stay partly empty: under one in some hundreds of rows. Which documents share a block, and its number,
follow the partitions: a table that is split otherwise gives other rows of the same documents.

Null and empty texts have the end token alone. Ids may be null or repeated. Only the named
columns are read. Equal lengths keep the order in which they came. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skygauge.llm.bpe import ragged
from skygauge.llm.common import exact_id, give_back, parts_and_tasks, schema, text_batches

BLOCK_TOKENS = 2_000_000
BLOCK_BYTES = 8 << 20


@dataclass(frozen=True)
class PackConfig:
    row_tokens: int = 2048
    end_id: int = 50256
    pad_id: int = 50256


#: Fixed value: the word pattern of byte-level BPE.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(maxsize=2)
def encoder(path: str):  # noqa: ANN201
    """The encoding of a file of base64 tokens and ranks, loaded once in each process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


class RoomTree:
    """Rows by the room they have left; a segment tree over rooms 0..most that hold any row."""

    def __init__(self, most: int) -> None:
        self.leaves = 1 << most.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        node = room + self.leaves
        while node and not self.any[node]:
            self.any[node] = 1
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """A row with the least room of at least size, and that room; it leaves the tree."""
        node = size + self.leaves
        while not self.any[node]:  # climb until a right sibling's subtree holds something
            while node & 1:
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node if self.any[2 * node] else 2 * node + 1
        room = node - self.leaves
        row = self.rows[room].pop()
        while node and not (self.rows[node - self.leaves] if node >= self.leaves else self.any[2 * node] | self.any[2 * node + 1]):
            self.any[node] = 0
            node >>= 1
        return row, room


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Indices of the pieces of each row; no size is over capacity."""
    tree, rows = RoomTree(capacity), []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        found = tree.take(size)
        if found is None:
            rows.append([i])
            tree.put(capacity - size, len(rows) - 1)
        else:
            rows[found[0]].append(i)
            tree.put(found[1] - size, found[0])
    return rows


OUT = schema("block long, row long, doc_ids long[], piece_starts long[], n_tokens long, input_ids binary, cu_seqlens int[], position_ids binary")


def pack_block(block: int, docs: list[tuple[int | None, np.ndarray]], config: PackConfig) -> pd.DataFrame:
    """Packed rows of some documents' ids."""
    limit, pieces = config.row_tokens, []
    for doc, ids in docs:
        pieces += [(doc, at, ids[at : at + limit]) for at in range(0, len(ids), limit)]
    out = []
    for row, held in enumerate(best_fit_decreasing(np.array([len(p[2]) for p in pieces], np.int64), limit)):
        sizes = np.array([len(pieces[i][2]) for i in held])
        ids = np.full(limit, config.pad_id, "<u4")
        ids[: sizes.sum()] = np.concatenate([pieces[i][2] for i in held])
        positions = np.zeros(limit, "<u4")
        positions[: sizes.sum()] = ragged(np.zeros(len(sizes), np.int64), sizes)
        out.append((block, row, [pieces[i][0] for i in held], [pieces[i][1] for i in held], int(sizes.sum()), ids.tobytes(), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), positions.tobytes()))
    return pd.DataFrame(out, columns=OUT.names)


def _pack(batches: Iterator[pd.DataFrame], path: str, config: PackConfig) -> Iterator[pd.DataFrame]:
    encode, task = encoder(path).encode_ordinary, TaskContext.get().partitionId()
    ordinal, held, total = itertools.count(), [], 0
    for batch in batches:
        for doc, null, text in zip(batch["id"].tolist(), batch["no_id"].tolist(), batch["text"], strict=True):
            tokens = encode(text or "")
            tokens.append(config.end_id)
            held.append((None if null else doc, np.array(tokens, "<u4")))
            total += len(tokens)
            if total >= BLOCK_TOKENS:
                yield pack_block((task << 32) + next(ordinal), held, config)
                held, total = [], 0
    if held:
        yield pack_block((task << 32) + next(ordinal), held, config)
    give_back()


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", config: PackConfig | None = None) -> DataFrame:
    """Packed rows: block and row number, ids (row_tokens little-endian unsigned 32-bit numbers), cumulative
    segment lengths, position ids that restart with each segment, and each segment's document and offset in it."""
    config = config or PackConfig()
    text_batches(docs.sparkSession)
    rows = docs.select(*exact_id(id_col), F.col(text_col).alias("text"))
    rows = rows.coalesce(parts_and_tasks(rows, "text", BLOCK_BYTES, BLOCK_BYTES)[0])  # does nothing where there are fewer
    return rows.mapInPandas(lambda it: _pack(it, path, config), OUT)


def write_packed(packed: DataFrame, path: str, rows_per_file: int = 65536) -> None:
    """Packed rows as Parquet: one fixed-length binary row of the id matrix in each record."""
    packed.write.option("maxRecordsPerFile", rows_per_file).option("compression", "zstd").parquet(path)


def joined(numbers: str) -> Column:
    return F.array_join(F.transform(F.col(numbers), lambda x: F.coalesce(x.cast("string"), F.lit(""))), ",")

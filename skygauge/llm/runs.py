"""Periodic runs of words, from suffix trees of a text and of its reversal.

A run is a stretch of words with smallest period q, at least twice q long, that no neighbouring
word extends. Every run has a Lyndon root, which is the longest Lyndon word that starts at some
position under one of two opposite orders of the words; it ends before the next smaller suffix.
So each position gives one candidate for each order, and a candidate is extended to the right by
the longest common extension of its two ends, to the left by that of the reversal: the string
depth of a lowest common ancestor in a suffix tree. Ukkonen's algorithm builds the trees; a tour
of the leaves keeps the depth between neighbours, and the least depth of a range is looked up in
a sparse table, in constant time. Both orders share one tree; its tour with the children in
opposite order ranks the suffixes for the second.

Before trees are built, stretches that can't be part of any run of min_length are left out: with
k = min_length // 2, every word of such a run lies in k words that occur again within it, so only
stretches covered by k-word sequences that repeat inside the same stretch remain. Nothing that belongs to a run is lost,
and a text without repetition costs a sort of its hashes. Stretches are set apart by words of their own.

Each text is one row's work, whatever else the table holds: nothing is shuffled. A tree takes some 300 bytes a word of the
stretches that remain, so a very long text needs that much memory in its task. A null or empty text has no words and no runs; repeated
rows and null ids are rows like others; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skygauge.llm.common import exact_id, give_back, text_batches

MIN_LENGTH = 12


@dataclass(frozen=True)
class SuffixTree:
    """Nodes other than the root by number: parent, first symbol of the edge, string depth, and the suffix of a leaf or -1."""

    parent: np.ndarray
    symbol: np.ndarray
    depth: np.ndarray
    suffix: np.ndarray


def ukkonen(text: list[int]) -> SuffixTree:
    """The suffix tree of a sequence of small integers whose last symbol occurs once."""
    n, base = len(text), max(text) + 1
    first, last, depth, link, suffix = [0], [0], [0], [0], [-1]  # the root
    edges: dict[int, int] = {}  # parent * base + first symbol: child
    node = edge = length = waiting = leaves = 0
    for i, symbol in enumerate(text):
        waiting += 1
        made = 0  # the inner node that still needs its suffix link
        while waiting:
            if not length:
                edge = i
            key = node * base + text[edge]
            child = edges.get(key)
            if child is not None:
                span = min(last[child], i + 1) - first[child]
                if length >= span:
                    edge += span
                    length -= span
                    node = child
                    continue
                if text[first[child] + length] == symbol:
                    if made:
                        link[made] = node
                    length += 1
                    break
                above = len(first)  # a node in the middle of the edge
                first.append(first[child])
                last.append(first[child] + length)
                depth.append(waiting - 1)
                link.append(0)
                suffix.append(-1)
                edges[key] = above
                first[child] += length
                edges[above * base + text[first[child]]] = child
                key = above * base + symbol
            else:
                above = node
            edges[key] = len(first)
            first.append(i)
            last.append(n)
            depth.append(n - leaves)
            link.append(0)
            suffix.append(leaves)
            leaves += 1
            if made:
                link[made] = above
            made = above if child is not None else 0
            waiting -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - waiting + 1
    keys, children = np.fromiter(edges.keys(), np.int64, len(edges)), np.fromiter(edges.values(), np.int64, len(edges))
    parent, symbols = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    parent[children], symbols[children] = keys // base, keys % base
    return SuffixTree(parent, symbols, np.array(depth), np.array(suffix))


def leaf_tour(tree: SuffixTree, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of a tour that takes children by order[first symbol]; the depth of the lowest common ancestor of each and the one before."""
    nodes = len(tree.parent)
    by = np.lexsort((order[tree.symbol[1:]], tree.parent[1:])) + 1
    parents = tree.parent[by]
    ends = np.searchsorted(parents, np.arange(nodes), "right")
    starts = np.concatenate([[0], ends[:-1]])
    backwards = by[::-1].tolist()  # so that a stack gives them in order
    low, high = (len(by) - ends).tolist(), (len(by) - starts).tolist()
    between = np.full(nodes, -1)  # the depth that a tour comes back to before it enters this node
    later = np.ones(len(by), bool)
    later[starts[parents]] = False
    between[by[later]] = tree.depth[parents[later]]
    suffix, back, stack, leaves, depths, now = tree.suffix.tolist(), between.tolist(), [0], [], [], 0
    while stack:
        node = stack.pop()
        if back[node] >= 0:
            now = back[node]
        if suffix[node] >= 0:
            leaves.append(suffix[node])
            depths.append(now)
        else:
            stack.extend(backwards[low[node] : high[node]])
    return np.array(leaves), np.array(depths)


class Extensions:
    """Longest common extensions of pairs of suffixes of one sequence."""

    def __init__(self, text: list[int]) -> None:
        self.tree, symbols = ukkonen(text), max(text) + 1
        leaves, depths = leaf_tour(self.tree, np.arange(symbols))
        self.rank = np.empty(len(leaves), np.int64)
        self.rank[leaves] = np.arange(len(leaves))
        self.least = [depths.astype(np.int32)]
        while 2 << len(self.least) - 1 <= len(depths):
            half = 1 << len(self.least) - 1
            self.least.append(np.minimum(self.least[-1][:-half], self.least[-1][half:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at a and b (a differs from b) have in common."""
        x, y = self.rank[a], self.rank[b]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.zeros(len(a), np.int64)
        for k in np.unique(level).tolist():
            own = level == k
            out[own] = np.minimum(self.least[k][low[own]], self.least[k][high[own] - (1 << k) + 1])
        return out


def next_smaller(ranks: np.ndarray) -> np.ndarray:
    """For each position the next one with a smaller rank; the length where there is none."""
    values, n = ranks.tolist(), len(ranks)
    found = [n] * n
    for i in range(n - 2, -1, -1):
        j = i + 1
        while j < n and values[j] > values[i]:
            j = found[j]
        found[i] = j
    return np.array(found)


def runs_of_symbols(text: list[int], marks: int) -> np.ndarray:
    """Rows start, end, period of all runs of a sequence; symbols under `marks` occur once each, and the last symbol is one of them."""
    n, symbols = len(text), max(text) + 1
    ahead = Extensions(text)
    opposite = np.arange(symbols)
    opposite[marks:] = opposite[marks:][::-1]  # marks stay least: what ends is smaller than what goes on
    leaves, _ = leaf_tour(ahead.tree, opposite)
    rank = np.empty(n, np.int64)
    rank[leaves] = np.arange(n)
    at = np.tile(np.flatnonzero(np.array(text) >= marks), 2)
    ends = np.stack([next_smaller(ahead.rank), next_smaller(rank)])[np.repeat([0, 1], len(at) // 2), at]
    right = ahead(at, ends)
    ahead = None
    behind = Extensions([*text[-2::-1], text[-1]])
    left = behind(n - 1 - at, n - 1 - ends)  # from the words before both on; n - 1 is the last mark
    found = np.stack([at - left, ends + right, ends - at], axis=1)
    return np.unique(found[found[:, 1] - found[:, 0] >= 2 * found[:, 2]], axis=0)


def repeating_stretches(ids: np.ndarray, min_length: int = MIN_LENGTH) -> list[tuple[int, int]]:
    """Stretches outside of which no word is part of a run of min_length words or more."""
    k, n = max(1, min_length // 2), len(ids)
    if n < max(min_length, 2):
        return []
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    grams = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        grams = grams * np.uint64(0xBF58476D1CE4E5B9) + mixed[j : n - k + 1 + j]
    stretch = np.zeros(n, np.int64)  # its number, from 0; -1 outside
    while True:
        inside = np.flatnonzero((stretch[: n - k + 1] >= 0) & (stretch[: n - k + 1] == stretch[k - 1 :]))
        keys = grams[inside] + stretch[inside].astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        again = inside[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]] if len(inside) else inside
        cover = np.zeros(n + 1, np.int64)
        np.add.at(cover, again, 1)
        np.add.at(cover, again + k, -1)
        # A stretch ends where the cover does, and where the one before ended.
        covered = np.cumsum(cover[:n]) > 0
        border = np.concatenate([[True], (covered[1:] != covered[:-1]) | (stretch[1:] != stretch[:-1])])
        starts = np.flatnonzero(border)
        ends = np.concatenate([starts[1:], [n]])
        good = covered[starts] & (ends - starts >= max(min_length, 2))
        before = stretch >= 0
        stretch = np.repeat(np.where(good, np.cumsum(good) - 1, -1), ends - starts)
        if not good.any() or (before == (stretch >= 0)).all():
            return list(zip(starts[good].tolist(), ends[good].tolist(), strict=True))


def runs_of_words(ids: np.ndarray, min_length: int = MIN_LENGTH) -> np.ndarray:
    """Rows start, length, period of the runs of min_length words or more, by start, then period; ids number the words."""
    parts = repeating_stretches(ids, min_length)
    if not parts:
        return np.zeros((0, 3), np.int64)
    marks, pieces, places = len(parts), [], []
    _, names = np.unique(np.concatenate([ids[a:b] for a, b in parts]), return_inverse=True)
    done = 0
    for i, (a, b) in enumerate(parts):
        pieces += [names[done : done + b - a] + marks, [i]]
        places += [np.arange(a, b), [-1]]
        done += b - a
    found, place = runs_of_symbols(np.concatenate(pieces).tolist(), marks), np.concatenate(places)
    found = np.stack([place[found[:, 0]], found[:, 1] - found[:, 0], found[:, 2]], axis=1)
    found = found[found[:, 1] >= min_length]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def collapsed(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words are left when of each run only the first period stays."""
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
    np.add.at(cover, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(cover[:n]) == 0


def planted_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """For op11: word numbers of a text whose words from a place on are replaced by repeats of some of them, for a tenth of all ids."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % p])


RUN = T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")])
OUT = T.StructType([T.StructField("id", T.LongType()), T.StructField("no_id", T.BooleanType()), T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.BinaryType())])


def _texts(batches: Iterator[pd.DataFrame], min_length: int, rearranged: Callable[[int | None, int], np.ndarray | None] | None) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc, null, text in zip(batch["id"].tolist(), batch["no_id"].tolist(), batch["text"], strict=True):
            words = bytes(text).split() if text is not None else []  # at the six ASCII white-space bytes
            if rearranged and (at := rearranged(None if null else doc, len(words))) is not None:
                words = [words[i] for i in at.tolist()]
            seen: dict[bytes, int] = {}
            ids = np.fromiter(map(seen.setdefault, words, range(len(words))), np.int64, len(words))
            runs = runs_of_words(ids, min_length)
            kept = words if not len(runs) else [words[i] for i in np.flatnonzero(collapsed(len(words), runs)).tolist()]
            rows.append((doc, null, len(words), [dict(zip(RUN.names, r, strict=True)) for r in runs.tolist()], b" ".join(kept)))
        yield pd.DataFrame(rows, columns=OUT.names)
    give_back()


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, rearranged: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words, by start, then period) and collapsed, the text's UTF-8 with
    the words of each run after its first period left out and one space between words.

    rearranged, if given, gets a document's id and number of words and may give the numbers of the words to use instead.
    """
    text_batches(docs.sparkSession)
    rows = docs.select(*exact_id(id_col), F.col(text_col).cast("binary").alias("text"))
    found = rows.mapInPandas(lambda it: _texts(it, min_length, rearranged), OUT)
    return found.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "n_words", "runs", "collapsed")


def longest(runs: str) -> Column:
    """The longest of a row's runs, of several the first to start, then of the least period; null without runs."""
    place = lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))
    least = F.array_min(F.transform(F.col(runs), place))
    return F.when(F.size(runs) > 0, F.struct(least["s"].alias("start"), (-least["l"]).alias("length"), least["p"].alias("period")))

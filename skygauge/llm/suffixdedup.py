"""Removal of substrings that an earlier document has, by two-stage suffix sorting.

A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller id.

1. Documents meet in blocks of bounded size. Of exact copies only the one with the smallest
   id goes on; the others lose all their bytes (if they have `length`).
2. Every window of `length` bytes has an anchor, the GRAM bytes in it with the least hash.
   Equal windows have equal anchors. Anchors of all documents meet by hash, packed; an
   anchor that only one document has can hold no shared window and is dropped there.
   A block sends each of its anchors once, with the number of its documents that have it.
3. For the others, the runs of windows with the same anchor meet, as snippets. Anchors in a crowd of
   documents meet by a tree: a block sorts its own crowded snippets first, and only the windows that no smaller id
   has there go on; `fan` blocks meet at a time, and their survivors again, up to one group. So a
   passage of very many documents is never gathered whole in one task.
4. Snippets that met, in a block, a branch of the tree or a part, are suffix-sorted: only suffixes smaller than their successors
   are sorted directly; the others are induced from them by scanning buckets of equal first bytes
   in order. Adjacent common prefixes of `length` bytes make groups of equal windows; the
   least id of a group stays and windows of larger ids are removed.
5. Spans go back to their blocks, where they are merged and cut out.

All decisions are on the input. Hashes only route: windows are compared byte by byte (step
4), except whole copies, which are told by 128 bits of hash. Parts and tasks are made for so many bytes of
text each (see SuffixLimits), so they keep their size as the table grows.

Null texts are empty. Ids are integers; a null id ranks with the largest possible one, after all others. Rows
with the same id never remove each other's bytes. A very long text makes a block of its own. Columns that aren't named are ignored
unless carried. Documents are read more than once, so the input is stored first, unless the caller
says that it is a stable table that gives the same rows whenever it is read; a
check value shows if not. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygauge.llm.carry import packed, unpacked
from skygauge.llm.common import exact_id, give_back, materialize, parts_and_tasks, schema, text_batches, utf8

LENGTH = 50
GRAM = 24
LAST = np.iinfo(np.int64).max


@dataclass(frozen=True)
class SuffixLimits:
    """crowd: documents with an anchor from which on it meets by a tree; fan: blocks that meet there at a time. block_bytes, block_docs: a block's most.

    piece: bytes of a document whose anchors are found at a time; sort_bytes: of snippets that are sorted at a time.
    part_bytes, task_bytes: bytes of text for each part and each task.
    """

    crowd: int = 200
    fan: int = 256
    block_bytes: int = 8 << 20
    block_docs: int = 60_000
    piece: int = 1 << 20
    sort_bytes: int = 1 << 20
    part_bytes: int = 4 << 20
    task_bytes: int = 16 << 20


# ---- suffix sorting ---------------------------------------------------------------------


def suffix_types(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than their successors; text is strings ending before ends."""
    following = np.empty(len(text), np.int16)
    following[:-1] = text[1:]
    following[ends - 1] = -1  # the end is smaller than any byte
    differs = np.where(text != following, np.arange(len(text)), len(text))
    at = np.minimum.accumulate(differs[::-1])[::-1]  # where each suffix first differs from its successor
    return text[at] < following[at]


def two_stage_order(text: np.ndarray, begins: np.ndarray, ends: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The wanted suffixes of some strings in lexicographic order of their first depth bytes or more.

    Of every string the wanted positions must be its first ones, each with depth bytes to go.
    Order among suffixes with equal prefixes of that depth is not defined.
    """
    n = len(text)
    small = suffix_types(text, ends)
    # A wanted suffix that is induced needs its successors up to one that is sorted directly.
    next_small = np.minimum.accumulate(np.where(small, np.arange(n), n)[::-1])[::-1]
    active = wanted.copy()
    last = begins + np.add.reduceat(wanted.astype(np.int64), begins) - 1
    has = last >= begins
    reach = np.minimum(next_small[last[has]], ends[has] - 1)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, last[has], 1)
    np.add.at(edge, reach + 1, -1)
    active |= np.cumsum(edge[:-1]) > 0
    starts_string = np.zeros(n, bool)
    starts_string[begins] = True

    direct = np.flatnonzero(active & small)
    padded = np.concatenate([text, np.zeros(depth, np.uint8)])
    direct = direct[np.argsort(np.lib.stride_tricks.sliding_window_view(padded, depth)[direct].view(f"S{depth}").ravel(), kind="stable")]
    bounds = np.searchsorted(text[direct], np.arange(257))

    induced: list[list[np.ndarray]] = [[] for _ in range(256)]

    def hand_on(found: np.ndarray) -> None:
        """Put the predecessors of a finished bucket, in order, where their first byte is larger."""
        before = found[~starts_string[found]] - 1
        before = before[active[before] & ~small[before]]
        before = before[text[before] > text[before + 1]]
        split(before)

    def split(positions: np.ndarray) -> None:
        if len(positions):
            positions = positions[np.argsort(text[positions], kind="stable")]
            first = text[positions]
            cuts = np.flatnonzero(np.diff(first)) + 1
            for part in np.split(positions, cuts):
                induced[text[part[0]]].append(part)

    split((ends - 1)[active[ends - 1] & ~small[ends - 1]])  # followed by the end of their string
    out = []
    for byte in range(256):
        bucket = [np.concatenate(induced[byte])] if induced[byte] else []
        while bucket and len(bucket[-1]):  # runs of one byte: predecessors in the same bucket
            before = bucket[-1][~starts_string[bucket[-1]]] - 1
            before = before[active[before] & ~small[before]]
            bucket.append(before[text[before] == byte])
        bucket.append(direct[bounds[byte] : bounds[byte + 1]])
        whole = np.concatenate(bucket)
        if len(whole):
            out.append(whole)
            hand_on(whole)
    order = np.concatenate([*out, np.zeros(0, np.int64)]).astype(np.int64)
    return order[wanted[order]]


def adjacent_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in order, up to depth; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    padded = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(depth, np.uint8)]), depth)
    for k in range(1, len(order), 1 << 16):
        differs = padded[order[k : k + (1 << 16)]] != padded[order[k - 1 : k - 1 + (1 << 16)][: len(order[k : k + (1 << 16)])]]
        out[k : k + (1 << 16)] = np.where(differs.any(axis=1), differs.argmax(axis=1), depth)
    return out


def repeated_windows(strings: list[bytes], ids: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(string, start, end) of bytes whose windows a string with a smaller id has too. Each has length bytes or more."""
    sizes = np.array([len(s) for s in strings], np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    text = np.frombuffer(b"".join(strings), np.uint8)
    owner = np.repeat(np.arange(len(strings)), sizes)
    wanted = np.arange(len(text)) <= (ends - length)[owner]
    order = two_stage_order(text, begins, ends, wanted, length)
    opens = np.flatnonzero(adjacent_prefixes(text, order, length) < length)
    own = ids[owner[order]]
    least = np.repeat(np.minimum.reduceat(own, opens), np.diff(np.append(opens, len(order))))
    gone = np.sort(order[own > least])
    if not len(gone):
        return []
    breaks = np.flatnonzero((np.diff(gone) != 1) | (np.diff(owner[gone]) != 0)) + 1
    first, final = gone[np.concatenate([[0], breaks])], gone[np.append(breaks - 1, len(gone) - 1)]
    which = owner[first]
    return list(zip(which.tolist(), (first - begins[which]).tolist(), (final - begins[which] + length).tolist(), strict=True))


def settled(keys: np.ndarray, strings: list[bytes], ids: np.ndarray, sort_bytes: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Of strings that meet by key: (string, start, end) of bytes that a smaller id's windows cover, and of the strings that the other windows make up."""
    order = np.argsort(keys, kind="stable")
    opens = np.concatenate([[0], np.flatnonzero(np.diff(keys[order])) + 1, [len(order)]])
    size = np.concatenate([[0], np.cumsum([len(strings[i]) for i in order])])
    found, at = [], 0
    while at < len(opens) - 1:  # whole keys, about sort_bytes of them
        to = max(at + 1, int(np.searchsorted(size[opens], size[opens[at]] + sort_bytes, "right")) - 1)
        own = order[opens[at] : opens[to]]
        found += [(int(own[i]), a, b) for i, a, b in repeated_windows([strings[i] for i in own], ids[own])]
        at = to
    free = np.zeros(len(strings), np.int64)  # up to where a string's windows are looked through
    left = []
    for i, a, b in sorted(found):
        if a > free[i]:
            left.append((i, int(free[i]), a + LENGTH - 1))
        free[i] = b - LENGTH + 1
    left += [(i, int(free[i]), len(x)) for i, x in enumerate(strings) if len(x) - free[i] >= LENGTH]
    return found, left


# ---- anchors ----------------------------------------------------------------------------


def _spread(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(29))


def _folded(values: np.ndarray, width: int, join) -> np.ndarray:  # noqa: ANN001
    """join of each width neighbours, by doubling. join(left, right, number of items on the right)."""
    result, held, power, size = None, 0, values, 1
    while width:
        if width & 1:
            if result is None:
                result, held = power, size
            else:
                m = min(len(result), len(power) - held)
                result, held = join(result[:m], power[held : held + m], size), held + size
        width >>= 1
        if width:
            power, size = join(power[:-size], power[size:], size), size * 2
    return result


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first window) of each run of windows that have the same anchor, for at least LENGTH bytes."""
    base = 0x9E3779B97F4A7C15
    grams = _folded(data.astype(np.uint64) + np.uint64(1), GRAM, lambda a, b, n: a * np.uint64(pow(base, n, 1 << 64)) + b)
    least = _folded(_spread(grams), LENGTH - GRAM + 1, lambda a, b, n: np.minimum(a, b))
    starts = np.concatenate([[0], np.flatnonzero(np.diff(least)) + 1])
    return least[starts], starts


def document_anchors(data: bytes, piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, number of windows) of all runs of a document, in pieces of bounded size."""
    hashes, starts, counts = [], [], []
    text = np.frombuffer(data, np.uint8)
    for at in range(0, len(text) - LENGTH + 1, piece):
        own = text[at : at + piece + LENGTH - 1]
        h, s = anchors(own)
        hashes.append(h)
        starts.append(s + at)
        counts.append(np.diff(np.append(s, len(own) - LENGTH + 1)))
    none = np.zeros(0, np.int64)
    return np.concatenate([*hashes, none.astype(np.uint64)]), np.concatenate([*starts, none]), np.concatenate([*counts, none])


# ---- packed values ----------------------------------------------------------------------


def _packed(*arrays: np.ndarray | bytes) -> bytes:
    """Numbers by byte plane, and bytes, in one compressed value."""
    out = []
    for a in arrays:
        kind, data = (0, a) if isinstance(a, bytes) else (a.itemsize, np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes())
        out += [struct.pack("<qq", kind, len(data)), data]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def _unpacked(data: bytes) -> list:
    raw, out, at = zstandard.ZstdDecompressor().decompress(data), [], 0
    while at < len(raw):
        kind, n = struct.unpack_from("<qq", raw, at)
        part = raw[at + 16 : at + 16 + n]
        out.append(np.ascontiguousarray(np.frombuffer(part, np.uint8).reshape(kind, -1).T).view(f"<u{kind}").ravel() if kind else part)
        at += 16 + n
    return out


def _by_part(parts: np.ndarray, count: int) -> list[np.ndarray]:
    """Indices of each part that has any, in order."""
    order = np.argsort(parts % count, kind="stable")
    return np.split(order, np.flatnonzero(np.diff((parts % count)[order])) + 1) if len(order) else []


# ---- steps ------------------------------------------------------------------------------

TEXTS = schema("block long, ids long[], nulls boolean[], extras string[], payload binary")
COPIES = schema("block long, place int, id long, n long, digest binary")
#: Rows of the steps between. Parts below 0 hold what a block has settled; those from the number of parts on hold crowds.
PACKED = schema("block long, part long, payload binary")


def _texts(batches: Iterator[pd.DataFrame], copies_only: bool, limits: SuffixLimits) -> Iterator[pd.DataFrame]:
    """Documents as blocks: their bytes together, or a row for each with its digest."""
    task, ordinal = TaskContext.get().partitionId(), itertools.count()
    ids, nulls, extras, texts, total = [], [], [], [], 0

    def flush() -> pd.DataFrame:
        block = (task << 32) + next(ordinal)
        if copies_only:
            return pd.DataFrame({"block": block, "place": np.arange(len(ids), dtype=np.int32), "id": np.array(ids, np.int64), "n": [len(x) for x in texts], "digest": [xxhash.xxh3_128_digest(x) for x in texts]})
        return pd.DataFrame({"block": [block], "ids": [np.array(ids, np.int64)], "nulls": [nulls], "extras": [extras], "payload": [_packed(np.array([len(x) for x in texts], "<u8"), b"".join(texts))]})

    for batch in batches:
        for doc, null, extra, text in zip(batch["id"].tolist(), batch["no_id"].tolist(), batch["extra"], batch["text"], strict=True):
            ids.append(LAST if null else doc)
            nulls.append(null)
            extras.append(extra)
            texts.append(utf8(text))
            total += len(texts[-1])
            if total >= limits.block_bytes or len(ids) >= limits.block_docs:
                yield flush()
                ids, nulls, extras, texts, total = [], [], [], [], 0
    if ids:
        yield flush()
    del ids, nulls, extras, texts
    give_back()


def _documents(texts: pd.DataFrame) -> tuple[int, np.ndarray, list[bytes]]:
    sizes, data = _unpacked(texts["payload"].iloc[0])
    ends = np.cumsum(sizes).astype(np.int64).tolist()
    return int(texts["block"].iloc[0]), np.asarray(texts["ids"].iloc[0], np.int64), [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _firsts(info: pd.DataFrame, docs: list[bytes]) -> np.ndarray:
    """Whether each document of a block is no later copy; also checks that the block is what it was."""
    row = info.loc[info["part"] == -1, "payload"]
    firsts, sizes = _unpacked(row.iloc[0]) if len(row) == 1 else (None, None)
    if firsts is None or len(firsts) != len(docs) or (sizes != np.array([len(x) for x in docs])).any():
        raise RuntimeError("documents changed between two reads; store them first")
    return firsts.astype(bool)


def _pack_firsts(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("place")
    return pd.DataFrame({"block": group["block"].iloc[:1], "part": [-1], "payload": [_packed(group["first"].to_numpy(np.uint8), group["n"].to_numpy("<u8"))]})


def _block_anchors(texts: pd.DataFrame, info: pd.DataFrame, parts: int, limits: SuffixLimits) -> pd.DataFrame:
    """A block's distinct anchors by part: hashes, sorted, and in how many of its documents they are."""
    if not len(texts):
        return pd.DataFrame(columns=PACKED.names)
    block, _, docs = _documents(texts)
    firsts = _firsts(info, docs)
    found = [np.unique(document_anchors(d, limits.piece)[0]) for i, d in enumerate(docs) if firsts[i] and len(d) >= LENGTH]
    hashes, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
    rows = [(block, int(hashes[at[0]] % np.uint64(parts)), _packed(hashes[at], counts[at].astype("<u4"))) for at in _by_part(hashes, np.uint64(parts))]
    return pd.DataFrame(rows, columns=PACKED.names)


def _shared_anchors(group: pd.DataFrame, limits: SuffixLimits) -> pd.DataFrame:
    """Of one part: for each block the anchors that other documents have too, and which are in a crowd. An anchor is one entry a block, however many documents have it."""
    found, weights = zip(*map(_unpacked, group["payload"]), strict=True)
    _, inverse = np.unique(np.concatenate(found), return_inverse=True)
    counts = np.bincount(inverse, np.concatenate(weights).astype(float))[inverse]
    rows, at = [], 0
    for block, part, own in zip(group["block"], group["part"], found, strict=True):
        n = counts[at : at + len(own)]
        at += len(own)
        if (shared := n > 1).any():
            rows.append((block, part, _packed(own[shared], own[n > limits.crowd])))
    return pd.DataFrame(rows, columns=PACKED.names)


def _among(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _snippet_rows(block: int, part: np.ndarray, keys: np.ndarray, places: np.ndarray, begins: np.ndarray, ids: np.ndarray, strings: list[bytes]) -> list[tuple]:
    """A row for each part that has snippets of a block."""
    rows = []
    for at in _by_block(part) if len(part) else []:
        own = [strings[i] for i in at]
        rows.append((block, int(part[at[0]]), _packed(keys[at].astype("<u8"), places[at].astype("<u4"), begins[at].astype("<u8"), ids[at], np.array([len(x) for x in own], "<u4"), b"".join(own))))
    return rows


def _block_snippets(texts: pd.DataFrame, info: pd.DataFrame, parts: int, limits: SuffixLimits) -> pd.DataFrame:
    """A block's snippets around shared anchors, by part: those of crowds as far as the block doesn't settle them; and the spans that are settled here."""
    if not len(texts):
        return pd.DataFrame(columns=PACKED.names)
    block, ids, docs = _documents(texts)
    firsts = _firsts(info, docs)
    flags = [_unpacked(x) for x in info.loc[info["part"] >= 0, "payload"]]
    none = np.zeros(0, np.uint64)
    shared, crowd = (np.unique(np.concatenate([none, *(f[k] for f in flags)])) for k in (0, 1))
    keys, places, begins, strings = [], [], [], []
    for place, data in enumerate(docs):
        if not firsts[place] or len(data) < LENGTH:
            continue
        hashes, starts, counts = document_anchors(data, limits.piece)
        chosen = _among(shared, hashes)
        for h, s, n in zip(hashes[chosen].tolist(), starts[chosen].tolist(), counts[chosen].tolist(), strict=True):
            keys.append(h)
            places.append(place)
            begins.append(s)
            strings.append(data[s : s + n + LENGTH - 1])
    keys, places, begins = np.array(keys, "<u8"), np.array(places, np.int64), np.array(begins, np.int64)
    part, hot, rows = ((keys >> np.uint64(20)) % np.uint64(parts)).astype(np.int64), _among(crowd, keys), []
    cold = np.flatnonzero(~hot)
    rows += _snippet_rows(block, part[cold], keys[cold], places[cold], begins[cold], ids[places[cold]], [strings[i] for i in cold])
    if hot.any():
        own = np.flatnonzero(hot)
        held = [strings[i] for i in own]
        found, left = settled(keys[own], held, ids[places[own]], limits.sort_bytes)
        if found:
            which, a, b = (np.array(x, np.int64) for x in zip(*found, strict=True))
            rows.append((block, -1 - block % parts, _packed(*(x.astype("<u8") for x in (places[own[which]], begins[own[which]] + a, begins[own[which]] + b)))))
        if left:
            which, a, b = (np.array(x, np.int64) for x in zip(*left, strict=True))
            at = own[which]
            rows += _snippet_rows(block, parts + part[at], keys[at], places[at], begins[at] + a, ids[places[at]], [held[i][x:y] for i, x, y in left])
    return pd.DataFrame(rows, columns=PACKED.names)


def _sorted_part(group: pd.DataFrame, parts: int, limits: SuffixLimits) -> pd.DataFrame:
    """The spans that suffix sorting finds among the snippets of one part, by block; of a crowd also what is left of the snippets."""
    own_part = int(group["part"].iloc[0])
    if own_part < 0:
        return group.assign(part=0)[PACKED.names]  # settled already
    blocks, columns, strings = [], [], []
    for block, payload in zip(group["block"], group["payload"], strict=True):
        keys, places, begins, ids, sizes, data = _unpacked(payload)
        ends = np.cumsum(sizes, dtype=np.int64).tolist()
        strings += [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        columns.append((keys, places.astype(np.int64), begins.astype(np.int64), ids.view(np.int64)))
        blocks.append(np.full(len(keys), block, np.int64))
    keys, places, begins, ids = (np.concatenate(x) for x in zip(*columns, strict=True))
    blocks = np.concatenate(blocks)
    found, left = settled(keys, strings, ids, limits.sort_bytes)
    rows = []
    if found:
        which, a, b = (np.array(x, np.int64) for x in zip(*found, strict=True))
        spans = np.stack([places[which], begins[which] + a, begins[which] + b]).astype("<u8")
        rows += [(int(blocks[which[at[0]]]), 0, _packed(*np.ascontiguousarray(spans[:, at]))) for at in _by_block(blocks[which])]
    if own_part >= parts and left:
        which, a, _ = (np.array(x, np.int64) for x in zip(*left, strict=True))
        kept = [strings[i][x:y] for i, x, y in left]
        for at in _by_block(blocks[which]):
            i = which[at]
            rows += _snippet_rows(int(blocks[i[0]]), np.full(len(at), own_part), keys[i], places[i], begins[i] + a[at], ids[i], [kept[k] for k in at])
    return pd.DataFrame(rows, columns=PACKED.names)


def _by_block(blocks: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(blocks, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(blocks[order])) + 1)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans in order, those that touch or overlap as one."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    opens = np.concatenate([[True], starts[1:] > ends[:-1]]) if len(starts) else np.zeros(0, bool)
    return starts[opens], ends[np.append(np.flatnonzero(opens)[1:] - 1, len(ends) - 1)] if len(starts) else ends


OUT = schema("doc_id long, extra string, n_bytes long, starts long[], ends long[], kept binary")
OUT_TEXT = schema("doc_id long, extra string, n_bytes long, starts long[], ends long[], kept string")


def _cut_block(texts: pd.DataFrame, info: pd.DataFrame, as_text: bool) -> pd.DataFrame:
    """Every document of a block with its spans cut out."""
    if not len(texts):
        return pd.DataFrame(columns=OUT.names)
    _, ids, docs = _documents(texts)
    nulls, extras = texts["nulls"].iloc[0], texts["extras"].iloc[0]
    firsts = _firsts(info, docs)
    found = [_unpacked(x) for x in info.loc[info["part"] >= 0, "payload"]]
    places, starts, ends = (np.concatenate([np.zeros(0, np.uint64), *(f[k] for f in found)]).astype(np.int64) for k in range(3))
    order = np.argsort(places, kind="stable")
    bounds = np.searchsorted(places[order], np.arange(len(docs) + 1))
    rows = []
    for i, data in enumerate(docs):
        own = order[bounds[i] : bounds[i + 1]]
        a, b = merged(starts[own], ends[own])
        if not firsts[i] and len(data) >= LENGTH:
            a, b = np.array([0]), np.array([len(data)])
        kept = b"".join(data[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(data)], strict=True))
        rows.append((None if nulls[i] else int(ids[i]), extras[i], len(data), a, b, kept.decode("utf-8", "ignore") if as_text else kept))
    return pd.DataFrame(rows, columns=OUT.names, dtype=object)


def _pair(run):  # noqa: ANN001, ANN202
    """run on both sides of a block, with memory given back afterwards."""

    def wrapped(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = run(a, b)
        give_back()
        return out

    return wrapped


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), as_text: bool = False, stable: bool = False, limits: SuffixLimits | None = None) -> DataFrame:
    """doc_id, extra, n_bytes, starts and ends of removed spans, and kept bytes of each document.

    extra holds the columns named in carry as one text (see carry.packed), or null. as_text: what is kept
    as a text, without characters that a cut has parted. stable: docs gives the same rows in the same
    order whenever it is read, as a scan of files does.
    """
    limits = limits or SuffixLimits()
    text_batches(docs.sparkSession)
    extra = packed(docs, list(carry)) if carry else F.lit(None).cast("string")
    rows = docs.select(*exact_id(id_col), extra.alias("extra"), F.col(text_col).alias("text"))
    rows = rows if stable else materialize(rows)
    parts, tasks = parts_and_tasks(rows, "text", limits.part_bytes, limits.task_bytes)
    # Copies: the least id of each digest. Both sides are a row of numbers for each document.
    each = materialize(rows.mapInPandas(lambda it: _texts(it, True, limits), COPIES))
    least = materialize(each.groupBy("digest", "n").agg(F.min("id").alias("least")))
    marked = each.join(least.toDF("d", "m", "least"), (F.col("digest") == F.col("d")) & (F.col("n") == F.col("m")))
    firsts = marked.select("block", "place", "n", (F.col("id") == F.col("least")).alias("first"))
    info = materialize(firsts.groupBy("block").applyInPandas(_pack_firsts, PACKED))
    by_block = lambda df: df.repartition(tasks, "block").groupBy("block")
    by_part = lambda df, *slot: df.repartition(tasks, "part", *slot).groupBy("part", *slot)
    blocks = by_block(rows.mapInPandas(lambda it: _texts(it, False, limits), TEXTS))
    met = blocks.cogroup(by_block(info)).applyInPandas(_pair(lambda a, b: _block_anchors(a, b, parts, limits)), PACKED)
    flags = by_part(met).applyInPandas(lambda g: _shared_anchors(g, limits), PACKED)
    snippets = blocks.cogroup(by_block(info.union(flags))).applyInPandas(_pair(lambda a, b: _block_snippets(a, b, parts, limits)), PACKED)
    # Crowds meet in groups of about `fan` blocks, then their survivors again, until one group is left.
    groups, crowd, spans = -(-info.count() // limits.fan), snippets, []
    while True:
        slot = F.when(F.col("part") >= parts, F.pmod(F.xxhash64("block", F.lit(groups)), F.lit(max(1, groups)))).otherwise(0)
        found = by_part(crowd.withColumn("slot", slot), "slot").applyInPandas(lambda g: _sorted_part(g, parts, limits), PACKED)
        if groups <= 1:
            spans.append(found.where(F.col("part") < parts))
            break
        found = materialize(found)
        spans.append(found.where(F.col("part") < parts))
        crowd, groups = found.where(F.col("part") >= parts), -(-groups // limits.fan)
    info = functools.reduce(DataFrame.union, spans, info)
    return blocks.cogroup(by_block(info)).applyInPandas(_pair(lambda a, b: _cut_block(a, b, as_text)), OUT_TEXT if as_text else OUT)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None, stable: bool = False, limits: SuffixLimits | None = None) -> DataFrame:
    """docs with repeated substrings cut from the text, all columns kept; documents of which nothing is left go.

    A character that a cut parts goes as a whole. count_col, if given, is set to the new
    number of code points. Texts that were null or empty from the start stay as empty ones.
    """
    others = [c for c in docs.columns if c != text_col]
    cut = remove_repeats(docs, id_col, text_col, tuple(others), True, stable, limits)
    kept = cut.where((F.size("starts") == 0) | (F.length("kept") > 0))
    columns = unpacked("extra", docs, others) | {text_col: F.col("kept")}
    if count_col:
        columns[count_col] = F.length("kept").cast(docs.schema[count_col].dataType)
    return kept.select(*(columns[c].alias(c) for c in docs.columns))

"""Exact substring deduplication: bytes of strings that also start in a document with a smaller doc_id.

1. Anchors. Every string of ``least`` bytes holds one minimiser, the position of the least hash of its
   20-byte strings, and equal strings hold the same one. An anchor's context is the span of the strings that
   hold it. A packed index of (anchor, fingerprint of its context) brings equal anchors together; what only
   one document has ends there.
2. Equal contexts. In a task, and again in a block of the index, the least document of equal contexts (by
   over 90 bits of hash) stands for them: all the others are repeats from end to end. Of what is left, anchors
   with different contexts go on, as bytes.
3. Intervals. The distinct contexts of a block make a text with a Burrows-Wheeler transform. Its interval
   of all suffixes is extended backwards, breadth first: at each step the intervals that ended at the step
   before are extended by every symbol before them, which sets the common prefixes of the next length. After
   ``least`` steps, what is not divided shares at least that many bytes, and the least document of each
   such interval keeps its string.
4. Removal. The spans of each document are merged and cut out of its bytes.

An anchor of very many different contexts is dealt to blocks by document, already by the index; what such a block can't decide by itself
goes on as fingerprints of its strings, of which the least document is found by an aggregate.

Matches never cross documents, and strings are judged on the input.

Defined cases: null and empty texts have nothing to remove; texts shorter than ``least`` bytes keep all;
repeated rows of one doc_id are one document, so they don't remove each other; a null doc_id is neither
smaller nor larger than another, and such rows keep all; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweft.llm import packed_index
from chronoweft.llm.common import BATCH_BYTES, BLOCK_BYTES, BYTE_VALUES, U64, arrow_slices, cut, expand, maybe_in, mix, powers, release, row_blocks, scratch, signed, text_view, texts, tidy

LEAST = 50
ANCHOR = 20
SHARD_BYTES = 1 << 20
SLICE_ROWS = 1 << 15
LOCAL_VARIANTS = 256
HOT_VARIANTS = 5000
AT_ONCE = 1024
LEAST_BLOCKS = 48
MOST_CLASHES = 10_000
BLOCK_ANCHORS = 1 << 20
KEPT_BITS, CONTEXT_BITS = 40, 48
BLOCK_CONTEXTS = 100_000
POSITION_BITS = 22


class Anchors:
    """The minimisers of rows of text: ``row``, hash ``h``, 48-bit fingerprint ``c`` of the context, and the
    context's ``start`` in its row and ``size``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, least: int):
        out = []
        span = least - ANCHOR + 1
        for i, j in row_blocks(offsets):
            a, b = int(offsets[i]), int(offsets[j])
            step = 2 * BLOCK_BYTES
            for start in range(a, max(b - least + 1, a), step):  # a long row goes through in overlapping parts
                part = data[start : min(start + step + least - 1, b)]
                if len(part) >= least and (got := _anchors(part, offsets[i : j + 1] - start, least, span)):
                    h, c, first, last = got
                    out.append((h, c, first + start, last + start))
        if out:
            self.h, self.c, self.first, last = (np.concatenate(x) for x in zip(*out, strict=True))
        else:
            self.h = self.c = np.zeros(0, np.uint64)
            self.first = last = np.zeros(0, np.int64)
        self.row = np.searchsorted(offsets, self.first, side="right") - 1
        self.start = self.first - offsets[self.row]
        self.size = last - self.first + least

    def keys(self, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Block, kept part of the anchor's hash, and the key by which the index names anchor and context."""
        block, rest = self.h % U64(blocks), (self.h // U64(blocks)) & U64((1 << KEPT_BITS) - 1)
        return block, rest, key_of(block, rest, self.c, blocks)


def key_of(block: np.ndarray, rest: np.ndarray, c: np.ndarray, blocks: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(rest * U64(blocks) + block ^ mix(c))


def _anchors(data: np.ndarray, offsets: np.ndarray, least: int, span: int) -> tuple[np.ndarray, ...] | None:
    n = len(data)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE_VALUES[data] * up[:n], dtype=np.uint64, out=sums[1:])
        hashes = mix((sums[ANCHOR:] - sums[:-ANCHOR]) * down[: n - ANCHOR + 1])
    m = len(hashes)
    keyed = (hashes & ~U64((1 << POSITION_BITS) - 1)) | np.arange(m, dtype=np.uint64)
    # least of every `span` values, by running minima from both ends of fixed pieces
    rows = -(-m // span)
    full = np.full(rows * span, np.uint64(0xFFFFFFFFFFFFFFFF))
    full[:m] = keyed
    pieces = full.reshape(rows, span)
    ahead = np.minimum.accumulate(pieces, axis=1).ravel()
    behind = np.minimum.accumulate(pieces[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - least + 1
    place = (np.minimum(behind[:windows], ahead[span - 1 : span - 1 + windows]) & U64((1 << POSITION_BITS) - 1)).astype(np.int32)
    # strings that cross the end of a row don't count
    inside = np.ones(windows, bool)
    for end in offsets[(offsets > 0) & (offsets < n)].tolist():
        inside[max(end - least + 1, 0) : end] = False
    new = np.ones(windows, bool)
    new[1:] = (place[1:] != place[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    if not len(first):
        return None
    stop = np.flatnonzero(np.append(inside[:-1] & (new[1:] | ~inside[1:]), inside[-1]))
    own = place[first].astype(np.int64)
    ends = stop + least
    with np.errstate(over="ignore"):
        c = mix(mix((sums[ends] - sums[first]) * down[first]) + (ends - first).astype(np.uint64) * U64(1 << 20) + (own - first).astype(np.uint64))
    return hashes[own], c & U64((1 << CONTEXT_BITS) - 1), first, stop


INDEX = "p int, kind int, entries binary, who binary, docs binary"
_INDEX_KINDS = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]


def _index_batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 64], strict=True), _INDEX_KINDS, strict=True)], [x.split()[0] for x in INDEX.split(", ")])


ENTRY = np.dtype([("rest", "<u4"), ("rest_high", "u1"), ("c", "<u4"), ("c_high", "<u2")])
HOME, AWAY, LOCAL = 0, 1, 2
FOUND = "doc long, key long, status int, rid long, start int, stop int"
REPEAT, VARIANT, HOT = 0, 1, 2


def index_anchors(rows: DataFrame, blocks: int, least: int, local_variants: int = LOCAL_VARIANTS) -> DataFrame:
    """The index of the anchors of ``rows`` (rid, doc, text) in packed blocks.

    HOME entries go to their anchor's block; AWAY entries, the further contexts of an anchor that has very
    many in one slice, to any; LOCAL rows are spans that a slice decides by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in arrow_slices(batches, "text", BATCH_BYTES):
            for start in range(0, batch.num_rows, SLICE_ROWS):
                turn += 1
                yield from _index_batches(_index_slice(batch.slice(start, SLICE_ROWS), blocks, turn, least, local_variants))
                release()

    return rows.mapInArrow(tidy(run), INDEX)


def _index_slice(batch: pa.RecordBatch, blocks: int, turn: int, least: int, local_variants: int) -> list[tuple]:
    rids, docs = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    found = Anchors(*text_view(batch.column(2)), least)
    if not len(found.h):
        return []
    block, rest, _ = found.keys(blocks)
    doc = docs[found.row]
    order = np.lexsort((doc, found.c, rest, block))
    block, rest, c, doc, row = block[order], rest[order], found.c[order], doc[order], found.row[order]
    new_anchor = np.ones(len(order), bool)
    new_anchor[1:] = (rest[1:] != rest[:-1]) | (block[1:] != block[:-1])
    new = new_anchor.copy()
    new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    lowest = np.repeat(doc[first], np.diff(np.append(first, len(order))))
    gone = order[doc > lowest]
    out = []
    if len(gone):
        spans = merge_arrays(rids[found.row[gone]], found.start[gone], found.start[gone] + found.size[gone])
        out.append((turn % blocks, LOCAL, spans[0].tobytes(), spans[1].astype(np.int32).tobytes(), spans[2].astype(np.int32).tobytes()))
    # the contexts of each anchor, and anchors that have very many
    number = np.cumsum(new_anchor[first]) - 1
    head = np.flatnonzero(new_anchor[first])
    many = np.diff(np.append(head, len(first)))
    hot = many[number] > local_variants
    away = hot.copy()
    away[head] = False
    edges = np.searchsorted(block[first], np.arange(blocks + 1, dtype=np.uint64))
    for p in range(blocks):
        a, b = int(edges[p]), int(edges[p + 1])
        for kind, chosen in ((HOME, np.flatnonzero(~away[a:b]) + a), (AWAY, np.flatnonzero(away[a:b]) + a)):
            if not len(chosen):
                continue
            at = first[chosen]
            entries = np.empty(len(at), ENTRY)
            entries["rest"], entries["rest_high"] = rest[at].astype(np.uint32), rest[at] >> U64(32)
            entries["c"], entries["c_high"] = c[at].astype(np.uint32), c[at] >> U64(32)
            used, index = np.unique(row[at], return_inverse=True)
            who = index.astype(np.uint16) | (hot[chosen].astype(np.uint16) << np.uint16(15))
            body = np.concatenate([np.array([p], "<u4").view(np.uint8), entries.view(np.uint8)]).tobytes()
            out.append((p if kind == HOME else (p + turn) % blocks, kind, body, who.tobytes(), docs[used].tobytes()))
    return out


def _divide(rows: list[dict], coarse: int, fine: int) -> Iterator[tuple]:
    """Rows of one coarse part of the index, by block. What may be decided anywhere is dealt in turn."""
    part = rows[0]["p"]
    for i, r in enumerate(rows):
        if r["kind"] != HOME:
            yield tuple({**r, "p": part + coarse * (i % fine)}.values())
    rows = [r for r in rows if r["kind"] == HOME]
    if not rows:
        return
    entries = np.concatenate([np.frombuffer(r["entries"], ENTRY, offset=4) for r in rows])
    own = [np.frombuffer(r["who"], np.uint16) for r in rows]
    doc = np.concatenate([np.frombuffer(r["docs"], np.int64)[w & 0x7FFF] for r, w in zip(rows, own, strict=True)])
    hot = np.concatenate(own) & 0x8000
    rest = entries["rest"].astype(np.uint64) | (entries["rest_high"].astype(np.uint64) << U64(32))
    sub, rest = (rest % U64(fine)).astype(np.int64), rest // U64(fine)
    entries["rest"], entries["rest_high"] = rest.astype(np.uint32), rest >> U64(32)
    order = np.argsort(sub, kind="stable")
    edges = np.searchsorted(sub[order], np.arange(fine + 1))
    head = np.array([part], "<u4").tobytes()
    for k in range(fine):
        for a in range(int(edges[k]), int(edges[k + 1]), packed_index.ROW_ENTRIES):
            at = order[a : min(a + packed_index.ROW_ENTRIES, int(edges[k + 1]))]
            used, index = np.unique(doc[at], return_inverse=True)
            yield part + coarse * k, HOME, head + entries[at].tobytes(), (index.astype(np.uint16) | hot[at]).tobytes(), used.tobytes()


def resolve_index(pdf: pd.DataFrame, coarse: int, fine: int = 1, hot_variants: int = HOT_VARIANTS) -> pd.DataFrame:
    """What each document has to know: which of its contexts are REPEATs, and which are VARIANTs of anchors
    with several contexts, HOT where those are very many."""
    parts: list[tuple[np.ndarray, ...]] = []
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    spans = []
    within = int(pdf["p"].iloc[0]) // coarse
    for kind, entries, who, docs in zip(pdf["kind"], pdf["entries"], pdf["who"], pdf["docs"], strict=True):
        if kind == LOCAL:
            spans.append((np.frombuffer(entries, np.int64), np.frombuffer(who, np.int32), np.frombuffer(docs, np.int32)))
            continue
        p = np.frombuffer(entries, "<u4", 1)[0]
        e = np.frombuffer(entries, ENTRY, offset=4)
        rest = e["rest"].astype(np.uint64) | (e["rest_high"].astype(np.uint64) << U64(32))
        c = e["c"].astype(np.uint64) | (e["c_high"].astype(np.uint64) << U64(32))
        own = np.frombuffer(who, np.uint16)
        doc = np.frombuffer(docs, np.int64)[own & 0x7FFF]
        block = np.full(len(rest), p, np.uint64)
        if kind == AWAY:
            done.append((doc, key_of(block, rest, c, coarse), np.full(len(doc), HOT)))
        else:
            parts.append((block, rest * U64(fine) + U64(within), c, doc, own >> 15))
    if parts:
        block, rest, c, doc, hot = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((doc, c, rest))
        block, rest, c, doc, hot = block[order], rest[order], c[order], doc[order], hot[order]
        new_anchor = np.ones(len(rest), bool)
        new_anchor[1:] = rest[1:] != rest[:-1]
        new = new_anchor.copy()
        new[1:] |= c[1:] != c[:-1]
        first, head = np.flatnonzero(new), np.flatnonzero(new_anchor)
        lowest = np.repeat(doc[first], np.diff(np.append(first, len(doc))))
        of_anchor = np.cumsum(new_anchor) - 1
        variants = np.add.reduceat(new.astype(np.int64), head)[of_anchor]
        is_hot = (np.maximum.reduceat(hot, head)[of_anchor] > 0) | (variants > hot_variants)
        status = np.where(doc > lowest, REPEAT, np.where(is_hot, HOT, VARIANT))
        keep = (doc > lowest) | (new & ((variants > 1) | is_hot))
        done.append((doc[keep], key_of(block[keep], rest[keep], c[keep], coarse), status[keep]))
    doc, key, status = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    rid, start, stop = (np.concatenate(x) for x in zip(*spans, strict=True)) if spans else (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32))
    none = lambda n: pd.array([None] * n, dtype="Int64")
    a = pd.DataFrame({"doc": pd.array(doc, dtype="Int64"), "key": pd.array(signed(key), dtype="Int64"), "status": pd.array(status, dtype="Int64"), "rid": none(len(doc)), "start": none(len(doc)), "stop": none(len(doc))})
    b = pd.DataFrame({"doc": none(len(rid)), "key": none(len(rid)), "status": none(len(rid)), "rid": pd.array(rid, dtype="Int64"), "start": pd.array(start, dtype="Int64"), "stop": pd.array(stop, dtype="Int64")})
    return pd.concat([x for x in (a, b) if len(x)] or [a])


def merge_arrays(rid: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and touching spans of each row together."""
    order = np.lexsort((start, rid))
    rid, start, stop = rid[order], start[order], stop[order]
    row = np.ones(len(rid), bool)
    row[1:] = rid[1:] != rid[:-1]
    number = np.cumsum(row)
    reach = np.maximum.accumulate(stop + number * (1 << 40)) - number * (1 << 40)  # the furthest stop so far in the row
    new = row.copy()
    new[1:] |= start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return rid[first], start[first], reach[np.append(first[1:], len(rid)) - 1]


SPANS = "rid long, start int, stop int, print1 long, print2 long, doc long"
BLOB = "p int, kind int, hashes binary, docs binary, rids binary, starts binary, sizes binary, hot binary, bytes binary"
_BLOB_KINDS = [pa.int32(), pa.int32(), *[pa.binary()] * 7]
CONTEXTS, DECIDED = 0, 1


def pack_contexts(asked: DataFrame, index_blocks: int, blocks: int, least: int) -> DataFrame:
    """Blocks of the variants' contexts by anchor, and the repeats' spans, from (rid, doc, text, keys,
    statuses), the texts squeezed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            for start in range(0, batch.num_rows, AT_ONCE):
                turn += 1
                rows = _pack_contexts(batch.slice(start, AT_ONCE), index_blocks, blocks, turn, least)
                for i in range(0, len(rows), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 64], strict=True), _BLOB_KINDS, strict=True)], [x.split()[0] for x in BLOB.split(", ")])
                release()

    return asked.mapInArrow(tidy(run), BLOB)


def _pack_contexts(batch: pa.RecordBatch, index_blocks: int, blocks: int, turn: int, least: int) -> list[tuple]:
    rids, docs = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    data, offsets = text_view(expand(batch.column(2)))
    found = Anchors(data, offsets, least)
    block, rest, key = found.keys(index_blocks)
    # which of them are asked for: (row, key) pairs, through one sorted list
    lists = batch.column(3)
    wanted = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    status = batch.column(4).flatten().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
    asked = mix(wanted ^ mix(owner.astype(np.uint64)))
    order = np.argsort(asked)
    asked, status = asked[order], status[order]
    mine = mix(key ^ mix(found.row.astype(np.uint64)))
    at = np.minimum(np.searchsorted(asked, mine), max(len(asked) - 1, 0))
    hit = asked[at] == mine if len(asked) else np.zeros(len(mine), bool)
    gone = np.flatnonzero(hit & (status[at] == REPEAT))
    rows = []
    if len(gone):
        spans = merge_arrays(rids[found.row[gone]], found.start[gone], found.start[gone] + found.size[gone])
        rows.append((turn % blocks, DECIDED, b"", b"", spans[0].tobytes(), spans[1].astype(np.int32).tobytes(), spans[2].astype(np.int32).tobytes(), b"", b""))
    chosen = np.flatnonzero(hit & (status[at] != REPEAT))
    is_hot = status[at[chosen]] == HOT
    anchor = rest[chosen] * U64(index_blocks) + block[chosen]
    target = (mix(anchor) % U64(blocks)).astype(np.int64)
    target = np.where(is_hot, (target + docs[found.row[chosen]]) % blocks, target)
    order = np.argsort(target, kind="stable")
    chosen, is_hot, target, anchor = chosen[order], is_hot[order], target[order], anchor[order]
    cuts = np.searchsorted(target, np.arange(blocks + 1))
    raw = data.tobytes()
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        a, b = int(cuts[p]), int(cuts[p + 1])
        own = chosen[a:b]
        body = b"".join(raw[s : s + n] for s, n in zip(found.first[own].tolist(), found.size[own].tolist(), strict=True))
        rows.append((p, CONTEXTS, anchor[a:b].tobytes(), docs[found.row[own]].tobytes(), rids[found.row[own]].tobytes(), found.start[own].astype(np.int32).tobytes(), found.size[own].astype(np.int32).tobytes(), is_hot[a:b].astype(np.uint8).tobytes(), body))
    return rows


def merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Overlapping and touching spans of each row together."""
    out: list[list[int]] = []
    for rid, a, b in sorted(spans):
        if out and out[-1][0] == rid and a <= out[-1][2]:
            out[-1][2] = max(out[-1][2], b)
        else:
            out.append([rid, a, b])
    return [tuple(x) for x in out]


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` bytes at least, by doubling from eight bytes."""
    n = len(text)
    wide = np.zeros(n + 8, np.uint64)
    wide[:n] = text
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key |= wide[k : k + n] << U64(56 - 8 * k)
    have = 8
    while True:
        order = np.argsort(key)
        if have >= depth:
            return order
        new = np.ones(n, np.int64)
        new[0] = 0
        in_order = key[order]
        new[1:] = in_order[1:] != in_order[:-1]
        rank = np.empty(n + have, np.uint64)
        rank[order] = np.cumsum(new) + 1
        rank[n:] = 0
        key = (rank[:n] << U64(32)) | rank[have : have + n]
        have *= 2


def repeated_intervals(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order, and for each place in it whether it begins a new interval: whether it has less than
    ``depth`` symbols in common with the place before.

    ``last`` maps each place of the suffix order to the place of the suffix one symbol shorter, by the
    Burrows-Wheeler transform alone: its symbols in stable order. Two neighbours in the block of a symbol
    come from two places with that symbol before them; they are divided one step after some interval
    first ends between those places.
    """
    n = len(text)
    order = suffix_order(text, depth)
    transform = text[order - 1]  # the symbol before each suffix; the text ends in a separator
    last = np.argsort(transform, kind="stable")
    symbol = transform[last]
    divided = np.ones(n, bool)
    divided[1:] = symbol[1:] != symbol[:-1]  # the intervals of one symbol
    open_ = np.flatnonzero(~divided)
    low, high = last[open_ - 1], last[open_]
    fresh = np.flatnonzero(divided)  # what the step before divided: earlier divisions have had their effect
    for _ in range(depth - 1):
        if not len(open_) or not len(fresh):
            break
        if len(open_) > n // 16:
            ends = np.zeros(n, np.int32)
            ends[fresh] = 1
            np.cumsum(ends, out=ends)
            now = ends[low] != ends[high]  # an interval ends between the two places
        else:
            now = np.searchsorted(fresh, low, side="right") != np.searchsorted(fresh, high, side="right")
        fresh = open_[now]
        divided[fresh] = True
        left = ~now
        open_, low, high = open_[left], low[left], high[left]
    return order, divided


def least_documents(contexts: list[bytes], docs: list[int], least: int) -> list[np.ndarray]:
    """For each string of each context, the least document of all that have it here."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    flat = np.frombuffer(b"\xff".join([*contexts, b""]), np.uint8)
    text = flat + np.uint8(1)  # UTF-8 has no 255, so separators become 0
    order, divided = repeated_intervals(text, least)
    doc = np.repeat(np.array(docs, np.int64), sizes + 1)
    place = np.arange(len(text)) - np.repeat(starts[:-1], sizes + 1)
    valid = place + least <= np.repeat(sizes, sizes + 1)
    value = np.where(valid, doc, np.iinfo(np.int64).max)[order]
    first = np.flatnonzero(divided)
    lowest = np.minimum.reduceat(value, first)
    by_place = np.empty(len(text), np.int64)
    by_place[order] = np.repeat(lowest, np.diff(np.append(first, len(text))))
    return [by_place[s : s + n - least + 1] for s, n in zip(starts.tolist(), sizes.tolist(), strict=False)]


def resolve(pdf: pd.DataFrame, least: int) -> pd.DataFrame:
    """Spans to remove, and fingerprints of the strings of hot anchors that this block can't decide."""
    spans: list[tuple[int, int, int]] = []
    best: dict[tuple[int, bytes], int] = {}
    stays: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
    hot_ones: set[tuple[int, bytes]] = set()
    for row in pdf.itertuples(index=False):
        rids, starts, third = np.frombuffer(row.rids, np.int64).tolist(), np.frombuffer(row.starts, np.int32).tolist(), np.frombuffer(row.sizes, np.int32).tolist()
        if row.kind == DECIDED:
            spans += zip(rids, starts, third, strict=True)
            continue
        at, raw = 0, row.bytes
        for h, doc, rid, start, size, hot in zip(np.frombuffer(row.hashes, np.uint64).tolist(), np.frombuffer(row.docs, np.int64).tolist(), rids, starts, third, row.hot, strict=True):
            own = (h, raw[at : at + size])
            at += size
            if hot:
                hot_ones.add(own)
            had = best.get(own)
            if had is None or doc < had:
                if had is not None:
                    spans += [(r, s, s + size) for r, s in stays[own]]
                best[own], stays[own] = doc, [(rid, start)]
            elif doc == had:
                stays[own].append((rid, start))
            else:
                spans.append((rid, start, start + size))
    open_: list[tuple[int, int, int, int, int, int]] = []
    keys = sorted(best)
    i = 0
    while i < len(keys):
        j, size = i, 0
        while j < len(keys) and (size < SHARD_BYTES or keys[j][0] == keys[j - 1][0]):
            size += len(keys[j][1]) + 1
            j += 1
        shard = keys[i:j]
        docs = [best[k] for k in shard]
        for own, doc, lowest in zip(shard, docs, least_documents([k[1] for k in shard], docs, least), strict=True):
            gone = np.flatnonzero(lowest < doc)
            if len(gone):
                edge = np.flatnonzero(np.diff(gone) > 1)
                for a, b in zip(gone[np.append(0, edge + 1)].tolist(), gone[np.append(edge, len(gone) - 1)].tolist(), strict=True):
                    spans += [(r, s + a, s + b + least) for r, s in stays[own]]
            if own in hot_ones:
                for k in np.flatnonzero(lowest >= doc).tolist():
                    digest = hashlib.blake2b(own[1][k : k + least], digest_size=16).digest()
                    one, two = int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)
                    open_ += [(r, s + k, s + k + least, one, two, doc) for r, s in stays[own]]
        i = j
        release()
    rows = [(*x, None, None, None) for x in merged(spans)] + open_
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pd.DataFrame({name.split()[0]: pd.array(list(c), dtype="Int64") for name, c in zip(SPANS.split(", "), columns, strict=True)})


def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, n_removed, n_spans, kept_sha256) from (rid, text, spans), the texts squeezed."""
    for whole in batches:
        for at in range(0, whole.num_rows, AT_ONCE):
            batch = whole.slice(at, AT_ONCE)
            out = []
            for text, spans in zip(expand(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                raw = text.as_py()
                own = merged([(0, s["start"], s["stop"]) for s in spans])
                kept, done, removed = hashlib.sha256(), 0, 0
                for _, a, b in own:
                    kept.update(raw[done:a])
                    done = b
                    removed += b - a
                kept.update(raw[done:])
                out.append((removed, len(own), kept.hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], ["rid", "n_removed", "n_spans", "kept_sha256"])


def with_ids(docs: DataFrame) -> DataFrame:
    """doc_id, text and rid of each row, a name for doc_id and text of 64 bits. Where different rows have the
    same, by 64 other bits, they are named by those."""
    rows = texts(docs)
    name, other = F.xxhash64("doc_id", "text"), F.xxhash64("text", F.lit(1), "doc_id")
    by_name = rows.select(name.alias("rid"), other.alias("other")).groupBy("rid").agg(F.min("other").alias("a"), F.max("other").alias("b"))
    clashes = [r["rid"] for r in by_name.where("a <> b").limit(MOST_CLASHES + 1).collect()]
    if len(clashes) > MOST_CLASHES:
        raise RuntimeError("far more equal hashes than chance gives")
    return rows.withColumn("rid", F.when(name.isin(*clashes), other).otherwise(name) if clashes else name)


def removal_spans(rows: DataFrame, least: int = LEAST, most_coarse: int = packed_index.MOST_COARSE, local_variants: int = LOCAL_VARIANTS, hot_variants: int = HOT_VARIANTS) -> DataFrame:
    """(rid, start, stop): spans of bytes to remove from the rows of :func:`with_ids`; they may overlap."""
    keyed = rows.where(F.col("doc_id").isNotNull()).select("rid", F.col("doc_id").cast("long").alias("doc"), "text").where(F.octet_length("text") >= least)
    total = keyed.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    coarse, fine = packed_index.layout(max(LEAST_BLOCKS, total // (10 * BLOCK_ANCHORS)), most_coarse)
    index = index_anchors(keyed, coarse, least, local_variants)
    if fine > 1:
        index = packed_index.spread(index, lambda part: _divide(part, coarse, fine), _index_batches)
    found = cut(index.groupBy("p").applyInPandas(lambda pdf: resolve_index(pdf, coarse, fine, hot_variants), FOUND), "anchors")
    asked_for = found.where("key IS NOT NULL")
    blocks = max(LEAST_BLOCKS, asked_for.where(F.col("status") != REPEAT).count() // BLOCK_CONTEXTS)
    by_doc = asked_for.groupBy("doc").agg(F.collect_list(F.struct("key", "status")).alias("own")).select("doc", F.col("own.key").alias("keys"), F.col("own.status").alias("statuses"))
    some = maybe_in(keyed.withColumn("key", F.xxhash64("doc")), asked_for.select("doc").distinct().select(F.xxhash64("doc").alias("key"))).drop("key").dropDuplicates(["rid"])
    asked = some.join(by_doc, "doc").select("rid", "doc", "text", "keys", "statuses")
    resolved = cut(pack_contexts(asked, coarse, blocks, least).groupBy("p").applyInPandas(lambda pdf: resolve(pdf, least), SPANS), "spans")
    decided = resolved.where("doc IS NULL").select("rid", "start", "stop")
    local = found.where("key IS NULL").select("rid", "start", "stop")
    undecided = resolved.where("doc IS NOT NULL")
    lowest = undecided.groupBy("print1", "print2").agg(F.min("doc").alias("lowest"), F.max("doc").alias("highest")).where("lowest < highest")
    late = undecided.join(lowest, ["print1", "print2"]).where("lowest < doc").select("rid", "start", "stop")
    return decided.unionByName(local).unionByName(late)


def _changed(rows: DataFrame, least: int, **how) -> DataFrame:
    """What is left of the rows of which something is removed, by rid."""
    spans = removal_spans(rows, least, **how).groupBy("rid").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    spans = cut(spans, "spans-by-document")
    some = maybe_in(rows.where(F.col("doc_id").isNotNull()).select(F.col("rid").alias("key"), "text"), spans.select(F.col("rid").alias("key"))).withColumnRenamed("key", "rid")
    return cut(some.join(spans, "rid").select("rid", "text", "spans").mapInArrow(tidy(remove), "rid long, n_removed long, n_spans long, kept_sha256 string").dropDuplicates(["rid"]), "changed")


def deduplicate(docs: DataFrame, least: int = LEAST, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each document."""
    rows = with_ids(docs)
    with scratch(keep=("changed",)):
        changed = _changed(rows, least, **how)
    raw = F.col("text").cast("binary")
    whole = rows.select("doc_id", "rid", F.octet_length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("sha"), F.col("doc_id").isNull().alias("alone"))
    joined = whole.join(changed, "rid", "left")
    pick = lambda c, other: F.when(F.col("alone"), other).otherwise(F.coalesce(c, other))
    return joined.select("doc_id", "n_bytes", pick("n_removed", F.lit(0).cast("long")).alias("n_removed"), pick("n_spans", F.lit(0).cast("long")).alias("n_spans"), pick("kept_sha256", F.col("sha")).alias("kept_sha256"))


ORACLE_SQL = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, sha256(encode(coalesce(text, ''))) AS whole FROM documents),
w AS (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS p FROM b),
k AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM w),
firsts AS (SELECT s, min(doc_id) AS least FROM k GROUP BY s),
gone AS (SELECT k.doc_id, k.p FROM k JOIN firsts USING (s) WHERE least < k.doc_id),
marked AS (SELECT doc_id, p, coalesce((p > lag(p) OVER o + 50)::INT, 1) AS fresh FROM gone WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
runs AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marked),
spans AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS z FROM runs GROUP BY doc_id, run),
parts AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM spans),
sums AS (
  SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS kept
  FROM parts JOIN b USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  CASE WHEN kept IS NULL THEN whole ELSE sha256(unhex(kept)) END AS kept_sha256
FROM b LEFT JOIN sums USING (doc_id)
"""

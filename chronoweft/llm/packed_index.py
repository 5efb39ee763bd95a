"""A packed inverted index: hashes and the nodes that have them, in blocks by hash range.

A task packs a slice of its nodes at a time. Of the nodes of a slice with the same hash, the least is its
delegate: only that one goes to the hash's block (kind 0, with the number of nodes it stands for); the
others go, with their delegate, to any block (kind 1). So a hash that a third of all nodes have costs its
block one entry a slice. Kind 2 carries two numbers of each node. A block's entries are then sorted in numpy: 10 bytes a hash, and no row a hash.

Slices and blocks both grow with the corpus, so a slice doesn't send a row to every block: beyond MOST_COARSE
blocks, it sends to about the square root of their number of coarse parts, and a second pass over these
gathers many slices' entries before it divides them into the blocks (``spread``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from chronoweft.llm.common import U64, release, signed, tidy

SLICE_NODES = 1 << 14
KEPT_BITS = 48
MOST_COARSE = 1024
SPREAD_BYTES = 16 << 20
ROW_ENTRIES = 1 << 14
COLUMNS = ["p", "kind", "high", "low", "who", "nodes", "many"]
SCHEMA = "p int, kind int, high binary, low binary, who binary, nodes binary, many binary"
MEMBERS = "hash long, node long, hub long, flag int, df long"
_KINDS = [pa.int32(), pa.int32(), *[pa.binary()] * 5]


def layout(blocks: int, most_coarse: int = MOST_COARSE) -> tuple[int, int]:
    """Coarse parts, and blocks in each, for at least so many blocks; block b is in part b % coarse."""
    if blocks <= most_coarse:
        return blocks, 1
    coarse = max(most_coarse, math.isqrt(blocks))
    return coarse, -(-blocks // coarse)


def spread(packed: DataFrame, regroup: Callable[[Iterator[dict]], Iterator[tuple]], make: Callable[[list[tuple]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """The rows of coarse parts (``p``) divided into blocks: ``regroup`` gets the rows of one part, many slices'
    at a time, and gives rows of the same schema."""
    names, schema = packed.columns, packed.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = dict(zip(names, row, strict=True))
                if held and (row["p"] != held[0]["p"] or size > SPREAD_BYTES):
                    yield from make(list(regroup(held)))
                    held, size = [], 0
                    release()
                held.append(row)
                size += sum(len(x) for x in row.values() if isinstance(x, bytes))
        if held:
            yield from make(list(regroup(held)))

    return packed.repartition("p").sortWithinPartitions("p").mapInArrow(tidy(run), schema)


def members(packed: DataFrame, coarse: int, fine: int) -> DataFrame:
    """The members of all hashes that more than one node has, from the rows of :func:`pack`."""
    if fine > 1:
        packed = spread(packed, lambda rows: _divide(rows, coarse, fine), batches_of)
    return packed.groupBy("p").applyInPandas(lambda pdf: unpack(pdf, coarse, fine), MEMBERS)


def _divide(rows: list[dict], coarse: int, fine: int) -> Iterator[tuple]:
    """Rows of one coarse part, by block. What may travel to any block is dealt in turn."""
    part = rows[0]["p"]
    for i, r in enumerate(rows):
        if r["kind"]:
            yield tuple({**r, "p": part + coarse * (i % fine)}.values())
    rows = [r for r in rows if not r["kind"]]
    if not rows:
        return
    own = [np.frombuffer(r["who"], np.uint16).astype(np.int64) for r in rows]
    rest = np.concatenate([_rest_of(r["high"], r["low"]) for r in rows])
    node = np.concatenate([np.frombuffer(r["nodes"], np.uint64)[w & 0x3FFF] for r, w in zip(rows, own, strict=True)])
    flag = np.concatenate(own) & 0xC000
    many = np.concatenate([np.frombuffer(r["many"], np.uint16) for r in rows])
    sub = (rest % U64(fine)).astype(np.int64)
    order = np.argsort(sub, kind="stable")
    edges = np.searchsorted(sub[order], np.arange(fine + 1))
    for k in range(fine):
        for a in range(int(edges[k]), int(edges[k + 1]), ROW_ENTRIES):
            at = order[a : min(a + ROW_ENTRIES, int(edges[k + 1]))]
            used, index = np.unique(node[at], return_inverse=True)
            yield (part + coarse * k, 0, *_parts(rest[at] // U64(fine)), (index | flag[at]).astype(np.uint16).tobytes(), used.tobytes(), many[at].tobytes())


def _parts(x: np.ndarray) -> tuple[bytes, bytes]:
    return (x >> U64(32)).astype(np.uint16).tobytes(), x.astype(np.uint32).tobytes()


def _rest_of(high: bytes, low: bytes) -> np.ndarray:
    return (np.frombuffer(high, np.uint16).astype(np.uint64) << U64(32)) | np.frombuffer(low, np.uint32)


def batches_of(rows: list[tuple], at_once: int = 64):
    for i in range(0, len(rows), at_once):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + at_once], strict=True), _KINDS, strict=True)], COLUMNS)


def pack(flat: np.ndarray, flags: np.ndarray, table: np.ndarray, blocks: int, turn: int) -> list[tuple]:
    """Rows of SCHEMA for one slice: hash i belongs to node table[flags[i] & 0x3FFF] and has the flag
    flags[i] >> 14. A node has a hash once."""
    if not len(flat):
        return []
    block = flat % U64(blocks)
    rest = (flat // U64(blocks)) & U64((1 << KEPT_BITS) - 1)
    order = np.lexsort((table[flags & 0x3FFF], rest, block))
    block, rest, flags = block[order], rest[order], flags[order]
    new = np.ones(len(rest), bool)
    new[1:] = (rest[1:] != rest[:-1]) | (block[1:] != block[:-1])
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(rest)))
    out = []
    edges = np.searchsorted(block[first], np.arange(blocks + 1, dtype=np.uint64))

    def add(p: int, kind: int, at: np.ndarray, extra: bytes) -> None:
        own = flags[at]
        used, index = np.unique(own & 0x3FFF, return_inverse=True)
        out.append((p, kind, *_parts(rest[at]), (index.astype(np.uint16) | (own & 0xC000)).tobytes(), table[used].tobytes(), extra))

    for p in range(blocks):
        a, b = int(edges[p]), int(edges[p + 1])
        if a == b:
            continue
        add(p, 0, first[a:b], np.minimum(many[a:b], 65535).astype(np.uint16).tobytes())
        shared = np.flatnonzero(many[a:b] > 1) + a
        if len(shared):
            n = many[shared] - 1
            at = np.repeat(first[shared] + 1, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            delegate = table[flags[np.repeat(first[shared], n)] & 0x3FFF]
            # kind 1 keeps its own block number in the first entry of `many`, so it may travel to any block
            extra = np.array([p], np.uint64).tobytes() + delegate.tobytes() + np.repeat(many[shared], n).astype(np.uint32).tobytes()
            add((p + turn) % blocks, 1, at, extra)
    return out


def notes(table: np.ndarray, one: np.ndarray, two: np.ndarray, p: int) -> tuple:
    """A row of SCHEMA with two numbers of each node; they come back as ``hub`` and ``df`` with flag -1."""
    return (p, 2, b"", b"", one.astype(np.int32).tobytes(), table.tobytes(), two.astype(np.int32).tobytes())


def unpack(pdf: pd.DataFrame, coarse: int, fine: int = 1) -> pd.DataFrame:
    """The members of the hashes of one block that more than one node has."""
    out = []
    sigs, nodes, flags, many = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int8)], [np.zeros(0, np.int32)]
    block, p = divmod(int(pdf["p"].iloc[0]), coarse)
    for kind, high, low, who, table, extra in zip(*(pdf[c] for c in ("kind", "high", "low", "who", "nodes", "many")), strict=True):
        if kind == 2:
            one, two = (np.frombuffer(x, np.int32).astype(np.int64) for x in (who, extra))
            out.append((np.zeros(len(one), np.uint64), np.frombuffer(table, np.uint64), one.view(np.uint64), np.full(len(one), -1, np.int8), two))
            continue
        rest = _rest_of(high, low)
        own = np.frombuffer(who, np.uint16).astype(np.int64)
        node = np.frombuffer(table, np.uint64)[own & 0x3FFF]
        if kind == 0:
            sigs.append(rest)
            nodes.append(node)
            flags.append((own >> 14).astype(np.int8))
            many.append(np.frombuffer(extra, np.uint16).astype(np.int32))
        else:
            n = len(rest)
            home = np.frombuffer(extra, np.uint64, 1)[0]
            out.append((rest * U64(coarse) + home, node, np.frombuffer(extra, np.uint64, n, 8), (own >> 14).astype(np.int8), np.frombuffer(extra, np.uint32, n, 8 + 8 * n).astype(np.int64)))
    sig, node, flag, times = np.concatenate(sigs), np.concatenate(nodes), np.concatenate(flags), np.concatenate(many)
    del sigs, nodes, flags, many
    if len(sig):
        order = np.lexsort((node, sig))
        sig, node, flag, times = sig[order], node[order], flag[order], times[order]
        new = np.ones(len(sig), bool)
        new[1:] = sig[1:] != sig[:-1]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(sig)))
        again = np.zeros(len(sig), bool)
        again[1:] = ~new[1:] & (node[1:] == node[:-1])
        distinct = np.add.reduceat((~again).astype(np.int64), first)
        df = np.add.reduceat(times, first, dtype=np.int64)
        more = np.maximum.reduceat(times, first)
        keep = np.repeat((distinct > 1) | (more > 1), size) & ~again
        out.append(((sig[keep] * U64(fine) + U64(block)) * U64(coarse) + U64(p), node[keep], np.repeat(node[first], size)[keep], flag[keep], np.repeat(df, size)[keep]))
    if not out:
        return pd.DataFrame({"hash": [], "node": [], "hub": [], "flag": [], "df": []}).astype({"flag": "int32"})
    columns = [np.concatenate(c) for c in zip(*out, strict=True)]
    release()
    return pd.DataFrame({"hash": signed(columns[0]), "node": signed(columns[1]), "hub": signed(columns[2]), "flag": columns[3].astype(np.int32), "df": columns[4]})

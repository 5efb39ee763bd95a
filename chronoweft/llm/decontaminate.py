"""Benchmark decontamination by greedy string tiling.

Test items are few and fixed next to a corpus: up to ``max_item_bytes`` of them travel with the tasks, and
beyond that bound they travel in blocks of that size, each block against all documents. Inside a task,
hashes of ``min_match`` consecutive words of a block of texts are looked up among the items' (the shared
seeds); a document and an item that share one are tiled: the longest common run of unmarked words is
marked on both sides, again and again, down to ``min_match`` words. An item that is covered to at least
``threshold`` by its tiles, in whatever order they stand in the document, contaminates it.

Words are runs of bytes other than blanks and ASCII punctuation, A-Z lower-cased, compared by 64-bit hash.
No rows are shuffled, so neither a passage that many documents share nor one source makes a task hot. The time
of a document follows the number of seeds that it shares with items: a text that repeats an item's words over
and over has some for each repetition and place, about 0.2 ms a word.

The lengths of common runs come from chains of neighbouring seeds on a diagonal (Karp-Rabin hashes of
``min_match`` words, their words compared), so no run is searched for at every length again.

Defined cases: null and empty texts match nothing; items of fewer than ``min_match`` words are too short to
recognise and match nothing; of equally long matches the first in the document, then in the item, is
marked; repeated rows each give their rows; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweft.llm.common import U64, bounded_batches, hash_runs, hash_words, text_view, texts, tidy, word_table

WORDS = word_table(bytes(c for c in range(33, 127) if not chr(c).isalnum()))
FILTER_BITS = 20
PAIRS_AT_ONCE = 1 << 21


class Items:
    """Test items as word hashes, and their seeds in hash order."""

    def __init__(self, rows: list[tuple], min_match: int):
        self.ids = [r[0] for r in rows]
        self.min_match = min_match
        data, offsets = text_view(pa.array([r[1] or "" for r in rows], pa.large_string()))
        flat, counts = hash_words(data, offsets, WORDS)
        at = np.concatenate([[0], np.cumsum(counts)])
        self.words = [flat[at[i] : at[i + 1]] for i in range(len(rows))]
        self.flat, self.starts = flat, at[:-1]
        runs = [hash_runs(w, min_match) for w in self.words]
        seeds = np.concatenate([*runs, np.zeros(0, np.uint64)])
        order = np.argsort(seeds, kind="stable")
        self.seeds = seeds[order]
        self.item = np.repeat(np.arange(len(rows)), [len(r) for r in runs])[order]
        self.place = np.concatenate([*(np.arange(len(r)) for r in runs), np.zeros(0, np.int64)]).astype(np.int64)[order]
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[(self.seeds >> U64(64 - FILTER_BITS)).astype(np.int64)] = True

    def hits(self, words: np.ndarray) -> np.ndarray:
        """Where in ``words`` a seed begins that some item has."""
        runs = hash_runs(words, self.min_match)
        at = np.flatnonzero(self.maybe[(runs >> U64(64 - FILTER_BITS)).astype(np.int64)])
        if len(at) and len(self.seeds):
            found = np.searchsorted(self.seeds, runs[at])
            at = at[self.seeds[np.minimum(found, len(self.seeds) - 1)] == runs[at]]
        return at if len(self.seeds) else at[:0]

    def pairs(self, words: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(item, place in the item, place in the text) of the seeds at ``at``, in runs of the text; that their
        hashes are equal is not enough, their words must be."""
        runs = hash_runs(words, self.min_match)[at]
        low = np.searchsorted(self.seeds, runs)
        many = np.searchsorted(self.seeds, runs, side="right") - low
        ends = np.cumsum(many)
        i = 0
        while i < len(at):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS_AT_ONCE)))
            n = many[i:j]
            index = np.repeat(low[i:j] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            item, place, where = self.item[index], self.place[index], np.repeat(at[i:j], n)
            same = np.ones(len(item), bool)
            for k in range(self.min_match):
                same &= self.flat[self.starts[item] + place + k] == words[where + k]
            yield item[same], place[same], where[same]
            i = j


def maximal_matches(items: Items, words: np.ndarray, at: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """By item: (length, place in the text, place in the item) of the maximal common runs."""
    open_runs: dict[tuple[int, int], list[int]] = {}
    out: dict[int, list[tuple[int, int, int]]] = {}
    m = items.min_match

    def close(item: int, diagonal: int, first: int, last: int) -> None:
        out.setdefault(item, []).append((last - first + m, first, first - diagonal))

    for item, place, where in items.pairs(words, at):
        if not len(item):
            continue
        diagonal = where - place
        order = np.lexsort((where, diagonal, item))
        item, diagonal, where = item[order], diagonal[order], where[order]
        new = np.ones(len(item), bool)
        new[1:] = (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (where[1:] != where[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(item)) - 1
        for i, d, a, b in zip(item[first].tolist(), diagonal[first].tolist(), where[first].tolist(), where[last].tolist(), strict=True):
            run = open_runs.get((i, d))
            if run and run[1] + 1 == a:
                run[1] = b
                continue
            if run:
                close(i, d, *run)
            open_runs[i, d] = [a, b]
    for (i, d), run in open_runs.items():
        close(i, d, *run)
    return out


def tile(matches: list[tuple[int, int, int]], n_text: int, n_item: int, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (length, place in the text, place in the item): longest first, none overlapping."""
    in_text, in_item = bytearray(n_text), bytearray(n_item)
    heap = [(-n, t, i) for n, t, i in matches]
    heapq.heapify(heap)
    tiles = []
    while heap:
        n, t, i = heapq.heappop(heap)
        n = -n
        taken = bytes(a | b for a, b in zip(in_text[t : t + n], in_item[i : i + n], strict=True))
        if 1 not in taken:
            in_text[t : t + n] = in_item[i : i + n] = b"\1" * n
            tiles.append((n, t, i))
            continue
        for free in _free_runs(taken):
            if free[1] - free[0] >= min_match:
                heapq.heappush(heap, (free[0] - free[1], t + free[0], i + free[0]))
    return tiles


def _free_runs(taken: bytes) -> Iterator[tuple[int, int]]:
    start = 0
    while start < len(taken):
        if taken[start]:
            start += 1
            continue
        end = taken.find(1, start)
        end = len(taken) if end < 0 else end
        yield start, end
        start = end


def judge(items: Items, words: np.ndarray, at: np.ndarray, threshold: float) -> list[tuple]:
    """(item_id, coverage, n_tiles, longest, covered) of the items that contaminate a text."""
    out = []
    for item, matches in sorted(maximal_matches(items, words, at).items()):
        size = len(items.words[item])
        tiles = tile(matches, len(words), size, items.min_match)
        covered = sum(x[0] for x in tiles)
        if covered >= threshold * size:
            out.append((items.ids[item], covered / size, len(tiles), max(x[0] for x in tiles), covered))
    return out


def judge_rows(items: Items, column: pa.Array, threshold: float) -> Iterator[tuple[int, list[tuple]]]:
    """(row, its contaminating items) of the rows of a text column that have one."""
    data, offsets = text_view(column)
    words, counts = hash_words(data, offsets, WORDS)
    ends = np.cumsum(counts)
    at = items.hits(words)
    row = np.searchsorted(ends, at, side="right")
    keep = at + items.min_match <= ends[row] if len(at) else at.astype(bool)
    at, row = at[keep], row[keep]
    if not len(at):
        return
    cuts = np.flatnonzero(np.diff(row)) + 1
    for own, where in zip(np.split(row, cuts), np.split(at, cuts), strict=True):
        i = int(own[0])
        start = int(ends[i] - counts[i])
        if found := judge(items, words[start : int(ends[i])], where - start, threshold):
            yield i, found


def item_blocks(benchmark: DataFrame, min_match: int, max_item_bytes: int) -> Iterator[Items]:
    rows = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = -(-total // max_item_bytes) or 1
    for k in range(blocks):
        own = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield Items([tuple(r) for r in own.collect()], min_match)


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, threshold: float = 0.5, max_item_bytes: int = 1 << 25) -> DataFrame:
    """One row per document and test item that contaminates it: doc_id, item_id, coverage (of the item's
    words), n_tiles, longest (words of the longest tile) and covered (words). Clean documents have no row."""
    rows = texts(docs)
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, item_id {dict(benchmark.dtypes)['item_id']}, coverage double, n_tiles int, longest int, covered int"
    names = [x.split()[0] for x in schema.split(", ")]
    out = None
    for items in item_blocks(benchmark, min_match, max_item_bytes):
        shipped = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0)
                found = [(ids[i].as_py(), *x) for i, more in judge_rows(shipped.value, batch.column(1), threshold) for x in more]
                if found:
                    kinds = [ids.type, pa.infer_type([x[1] for x in found]), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)

        part = rows.mapInArrow(tidy(run), schema)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, threshold: float = 0.5, max_item_bytes: int = 1 << 25) -> DataFrame:
    """The rows and columns of ``docs`` that no test item contaminates, decided in one pass over them."""
    at = docs.columns.index("text")
    for items in item_blocks(benchmark, min_match, max_item_bytes):
        shipped = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[i for i, _ in judge_rows(shipped.value, batch.column(at), threshold)]] = False
                yield batch.filter(pa.array(keep))

        docs = bounded_batches(docs).mapInArrow(tidy(run), docs.schema)
    return docs

"""Best-fit packing of tokenised documents into sequences, after Martello-Toth dominance reduction.

Only the histogram of piece lengths decides how many sequences are needed, and it has at most ``capacity``
entries whatever the corpus. So the driver gets that histogram and nothing else, and plans on counts:
reduction fixes sets that provably dominate every alternative (a piece that fits with nothing; two pieces
that fill a sequence exactly; a piece with its largest partner where no two pieces together fill it
better), until none is left; the remainder goes best-fit decreasing, whole classes of equal sequences at a
time. The plan is a table of (length, first rank, pieces a sequence, first sequence, offset); the pieces
get ranks within their length by bucketed windows and look themselves up.

Each length has as many buckets as its number of pieces asks for, so a length that a third of the pieces
share is as many tasks' work as any other, and the counts by bucket are few next to the pieces.

Defined cases: null and empty texts are one piece of length 1 (the end token); repeated rows are packed as
rows of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweft.llm.common import arrow_slices, cut, texts, tidy

CAPACITY = 4096
END_ID = 1
BUCKET_PIECES = 256
CACHE_WORDS = 200_000

#: Characters for which the pre-tokeniser's classes are plain: ASCII, and Latin-1's letters.
PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")
#: The pre-tokeniser's pattern, over those characters in lower case.
WORD = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'(?:[stmd]|re|ve|ll)|[^\sa-z0-9ß-öø-ÿ]+")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Numbers(dict):
    """Words by number; a word asked for the first time gets the next one."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Encoder:
    """Token ids of texts. Words of plain texts are encoded once and kept; all other texts, and those with
    what may be a special token, go through the tokeniser whole. Both give the tokeniser's own ids."""

    _own: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary_ = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocabulary_.values()) + 1, bool)
        self.is_end[[i for t, i in vocabulary_.items() if t.endswith("</w>")]] = True
        self.clear()

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def clear(self) -> None:
        self.number = _Numbers()
        self.flat = np.zeros(0, np.uint32)
        self.at = np.zeros(1, np.int64)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self) -> None:
        """Encode the words numbered since the last time, as one text: a word's last token says so."""
        new, self.number.new = self.number.new, []
        if not new:
            return
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.is_end[ids]) + 1
        if len(ends) != len(new):
            apart = [self.whole(w) for w in new]
            ids, ends = np.concatenate(apart), np.cumsum([len(x) for x in apart])
        self.at = np.concatenate([self.at, self.at[-1] + ends])
        self.flat = np.concatenate([self.flat, ids])

    def encode(self, texts_: list[str]) -> list[np.ndarray]:
        """Ids of each text, the end token not included."""
        if len(self.number) > CACHE_WORDS:
            self.clear()
        get, find = self.number.__getitem__, WORD.findall
        index: list[np.ndarray | None] = []
        for t in texts_:
            if "<|" in t or not PLAIN.fullmatch(t):
                index.append(None)
                continue
            words = find(t.lower())
            index.append(np.fromiter(map(get, words), np.int64, len(words)))
        self._learn()
        out = []
        for t, own in zip(texts_, index, strict=True):
            if own is None:
                out.append(self.whole(t))
                continue
            first = self.at[own]
            n = self.at[own + 1] - first
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            out.append(self.flat[np.repeat(first - ends + n, n) + np.arange(total)])
        return out


def to_pieces(docs: DataFrame, vocabulary_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each document's pieces."""
    rows = texts(docs)
    path = vocabulary_path or vocabulary()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        try:
            for batch in arrow_slices(batches):
                index, out = [], []
                for i, ids in enumerate(encoder.encode(batch.column(1).to_pylist())):
                    ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        own = ids[start : start + capacity]
                        index.append(i)
                        out.append((k, start, len(own), zlib.crc32(own.tobytes())))
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index, pa.int64())), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names)
        finally:
            encoder.clear()  # the worker may go on to other tasks

    return rows.mapInArrow(tidy(run), f"doc_id {dict(rows.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long")


Bin = tuple[tuple[int, int], ...]
"""(length, pieces of that length) of one sequence, in their order."""


class Sizes:
    """The sizes of which pieces are left, as bits of one number and of its mirror image: a shift and an AND
    tell whether any two of them sum to a value."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.counts, self.capacity = counts, capacity
        self.bits = self.mirror = 0
        for s, n in counts.items():
            if n:
                self.bits |= 1 << s
                self.mirror |= 1 << (capacity - s)

    def take(self, size: int, n: int) -> None:
        self.counts[size] -= n
        if not self.counts[size]:
            self.bits ^= 1 << size
            self.mirror ^= 1 << (self.capacity - size)


def reduce(counts: dict[int, int], capacity: int) -> list[tuple[Bin, int]]:
    """Take from ``counts`` the sets that dominate all alternatives; (set, how many of it)."""
    fixed: list[tuple[Bin, int]] = []
    sizes = Sizes(counts, capacity)
    changed = True
    while changed:
        changed = False
        for size in sorted((s for s, n in counts.items() if n), reverse=True):
            while counts.get(size, 0):
                took = _dominant(size, sizes)
                if took is None:
                    break
                fixed.append(took)
                for own, k in took[0]:
                    sizes.take(own, k * took[1])
                changed = True
    return fixed


def _dominant(size: int, sizes: Sizes) -> tuple[Bin, int] | None:
    """The dominating set that holds a piece of ``size``, if one is known to be, and how often: what makes it
    dominate, that no others fill its room better, stays true while pieces of its sizes are left."""
    counts, rest = sizes.counts, sizes.capacity - size
    have = counts[size]
    if rest == 0:
        return ((size, 1),), have
    if counts.get(rest, 0) and (rest != size or have > 1):
        return (((size, 2),), have // 2) if rest == size else (((size, 1), (rest, 1)), min(have, counts[rest]))
    others = sizes.bits if have > 1 else sizes.bits & ~(1 << size)
    fitting = others & ((1 << (rest + 1)) - 1)
    if not fitting:
        return ((size, 1),), 1 if size <= rest else have
    best = fitting.bit_length() - 1
    if _filled_better(size, sizes, fitting, best, rest):
        return None
    return (((size, 2),), have // 2) if best == size else (((size, 1), (best, 1)), min(have, counts[best]))


def _filled_better(size: int, sizes: Sizes, fitting: int, best: int, rest: int) -> bool:
    """Whether two or more pieces beside one of ``size`` have a sum above ``best`` and at most ``rest``."""
    others = lambda s: sizes.counts[s] - (s == size)
    mirror = sizes.mirror if others(size) else sizes.mirror & ~(1 << (sizes.capacity - size))
    for total in range(best + 1, min(rest, 2 * best) + 1):  # two pieces: nearly always enough where sizes are many
        two = fitting & (mirror >> (sizes.capacity - total))
        if total % 2 == 0 and sizes.counts.get(total // 2) and others(total // 2) < 2:
            two &= ~(1 << (total // 2))
        if two:
            return True
    mask = (1 << (rest + 1)) - 1
    one = many = 0  # bit s: some single piece, some set of two or more, sums to s
    while fitting:
        s = (fitting & -fitting).bit_length() - 1
        fitting &= fitting - 1
        for _ in range(min(others(s), rest // s)):
            many |= ((many | one) << s) & mask
            one |= 1 << s
            if many >> (best + 1):
                return True
    return False


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Bin, int]]:
    """Best-fit decreasing on counts: classes of equal sequences are filled together."""
    classes: dict[int, list[tuple[Bin, int]]] = defaultdict(list)  # by room left
    rooms: list[int] = []

    def put(room: int, own: Bin, times: int) -> None:
        if room not in classes or not classes[room]:
            bisect.insort(rooms, room)
        classes[room].append((own, times))

    for size in sorted((s for s, n in counts.items() if n), reverse=True):
        left = counts[size]
        while left:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):
                room, own, times = capacity, (), left
            else:
                room = rooms[at]
                own, times = classes[room].pop()
                if not classes[room]:
                    rooms.pop(at)
            each = min(room // size, left)
            full = min(times, left // each)
            put(room - each * size, (*own, (size, each)), full)
            if own and times > full:
                put(room, own, times - full)
            left -= full * each
    return [x for room in rooms for x in classes[room]]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[str, np.ndarray], int]:
    """The look-up table by length and rank, and the number of sequences."""
    counts = dict(histogram)
    bins = reduce(counts, capacity)
    bins += best_fit(counts, capacity)
    ranks: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for own, times in bins:
        offset = 0
        for size, each in own:
            rows.append((size, ranks[size], each, sequence, offset))
            ranks[size] += each * times
            offset += each * size
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "each", "sequence", "offset"), table.T.copy(), strict=True)), sequence


RANK_BITS = 48


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a table that can be read more than once) with sequence_id and offset."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if histogram and not 0 < min(histogram) <= max(histogram) <= capacity:
        raise ValueError("a piece is empty or longer than a sequence")
    spark = pieces.sparkSession
    shipped = spark.sparkContext.broadcast(plan(histogram, capacity)[0])
    # buckets of BUCKET_PIECES pieces within each length; this table has at most ``capacity`` rows
    many = spark.createDataFrame([(s, -(-n // BUCKET_PIECES)) for s, n in histogram.items()], "length long, buckets long")
    keyed = pieces.join(F.broadcast(many), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("buckets")))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = keyed.withColumn("rank", F.row_number().over(inside) - 1).join(starts, ["length", "bucket"]).withColumn("rank", (F.col("rank") + F.col("first")).cast("long"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shipped.value
        keys = (t["length"] << RANK_BITS) | t["rank"]
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (3, 5))
            at = np.searchsorted(keys, (length << RANK_BITS) | rank, side="right") - 1
            nth = rank - t["rank"][at]
            sequence = t["sequence"][at] + nth // t["each"][at]
            offset = t["offset"][at] + nth % t["each"][at] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranked.select(*names, "rank").mapInArrow(tidy(run), f"doc_id {dict(pieces.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, vocabulary_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Each document's pieces with the sequence and place that they get."""
    return pack_pieces(cut(to_pieces(docs, vocabulary_path, capacity), "pieces"), capacity)

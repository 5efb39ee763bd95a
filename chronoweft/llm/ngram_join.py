"""N-gram Jaccard join: universe-partition pigeonhole over word shingles.

Sets that differ in at most H elements, with the universe of elements dealt by hash into m segments, are
equal in at least m - H of them. Sizes fall into bands; a band fixes m, and a pair is compared in the band
of its larger set, so a set is dealt for its own band and, where a partner may be in the next, for that.

* Segments and allocation. A band's number of segments, and how many of them also index their one-deletion
  neighbourhoods (which bear two differences instead of one), minimise the rows to write plus the matches
  by chance that short segments would give. Each document knows how many segments it may ignore.
* Index. A task hashes its documents' segments, keeps one delegate for each hash that several of its own
  documents have, and sends hashes on as packed blocks by hash range. A hash that a third of all documents
  have thus meets in at most one entry a block; the other members stay with their delegate.
* Verification. Members of a hash are verified against its hub (its least node), as shingle sets of whole
  texts. Links join components. Where a hash still spans components, the documents ignore the most
  frequent of such hashes as far as their allowance goes. The sets that this leaves, families of texts that
  are nearly similar enough, meet once more by their rarest shingles and are verified pair by pair, so that
  no link between different texts is lost.

Equal sets are one node from the start and are never paired. Shingles are 64-bit hashes; sets are equal by 128
bits, and nodes are named by 64 of these, and by the other 64 where two sets' names clash.

Defined cases: null and empty texts have no set and are linked with nothing (their component is their own
doc_id); of fewer than five words the whole sequence is the one shingle; repeated rows are copies of one
another; rows of one doc_id with different texts are judged each by its own text; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from chronoweft.llm import packed_index
from chronoweft.llm.common import U64, arrow_slices, bounded_batches, cut, expand, hash_runs, hash_words, hot_join, maybe_in, mix, release, row_blocks, scratch, signed, text_view, texts, tidy
from chronoweft.llm.components import components

SHINGLE = 5
SLICE_BYTES = 4 << 20
BLOCK_HASHES = 1 << 20
LEAST_BLOCKS = 128
CHANCE_COST = 20.0
SLACK = 0.1
AT_ONCE = 256
"""Squeezed texts opened at a time."""
CELLS, CELL_SLICES = 1 << 20, 64
PAIRED_MEMBERS = 96
CHUNK_SETS, CHUNK_SHINGLES, PRODUCT_COLUMNS = 512, 150_000, 4096
LIKELY_SHARED = 2
MOST_CLASHES = 10_000
SMALL_SET = 40
MANY_PAIRS = 200
SMALL_SIDE = 200_000
"""A side of at most so many rows, counted first, may be broadcast."""

OWN, NEXT, FIXED = 0, 1, 2
"""Flags of a hash: of the set's own band or the next; FIXED where it can't be ignored."""


def bounds(k: int) -> tuple[int, int]:
    """Least and largest set size of a band."""
    low, high = 1, 4
    for _ in range(k):
        low, high = high + 1, (high + 1) * 3 // 2
    return low, high


@cache
def _band_starts() -> np.ndarray:
    return np.array([bounds(k)[0] for k in range(48)], np.int64)


def band_of(size: int) -> int:
    return int(np.searchsorted(_band_starts(), size, side="right")) - 1


@cache
def allocation(k: int) -> tuple[int, int, int]:
    """Segments, how many of them index one-deletion neighbourhoods, and the most differences in a band."""
    largest = bounds(k)[1]
    most = 2 * largest // 9
    need = most + 1
    best = None
    for m in range((need + 1) // 2, need + 1):
        near = need - m
        tokens = largest / m
        rows = m - near + near * (1 + tokens)
        chance = (m - near) * math.exp(-tokens) + near * math.exp(1 - tokens)
        cost = rows + CHANCE_COST * chance
        if best is None or cost < best[0]:
            best = (cost, m, near)
    _, m, near = best
    return (m + math.ceil(SLACK * need) if near == 0 and most else m), near, most


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each row, in order."""
    for i, j in row_blocks(offsets):
        words, counts = hash_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        runs = hash_runs(words, SHINGLE)
        at = 0
        for n in counts.tolist():
            if n >= SHINGLE:
                yield np.unique(runs[at : at + n - SHINGLE + 1])
            elif n:
                yield hash_runs(words[at : at + n], n) ^ U64(n)
            else:
                yield words[:0]
            at += n


class Nodes:
    """Names sets by 64-bit hashes. ``clashes`` are names that different sets have, by another hash of 64 bits;
    these sets are named by that one instead. ``bits``: fewer than 64 in tests, to have clashes."""

    def __init__(self, bits: int = 64, clashes: frozenset[int] = frozenset()):
        self.mask, self.clashes = U64((1 << bits) - 1), clashes

    def of(self, own: np.ndarray) -> np.uint64:
        with np.errstate(over="ignore"):
            name = mix(np.add.reduce(mix(own), dtype=np.uint64, keepdims=True) + U64(len(own)))[0] & self.mask
        return self.check(own) if self.clashes and int(signed(name[None])[0]) in self.clashes else name

    @staticmethod
    def check(own: np.ndarray) -> np.uint64:
        with np.errstate(over="ignore"):
            return mix(np.add.reduce(mix(own * U64(0xD6E8FEB86659FD93)), dtype=np.uint64, keepdims=True) ^ U64(len(own)))[0]

    def signed_of(self, sets: Iterator[np.ndarray]) -> list[int | None]:
        return [int(signed(self.of(own)[None])[0]) if len(own) else None for own in sets]


def bands_of(size: int) -> list[tuple[int, int]]:
    """(flag, band) in which a set of this size is dealt; bands that bear no difference need none."""
    own = band_of(size)
    out = [(OWN, own)] if allocation(own)[2] else []
    if size * 5 // 4 >= bounds(own + 1)[0]:
        out.append((NEXT, own + 1))
    return out


def deal(own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of a set's segments in band k, which of them are FIXED, and how many others it may ignore."""
    m, near, most = allocation(k)
    with np.errstate(over="ignore"):
        segment = (mix(own ^ U64(k + 1)) % U64(m)).astype(np.int64)
        value = mix(own + U64(0xA0761D6478BD642F))
        sums = np.zeros(m, np.uint64)
        np.add.at(sums, segment, value)
        count = np.bincount(segment, minlength=m)
        key = mix(np.arange(m, dtype=np.uint64) + (U64(k) << U64(32)))
        hashes = mix(sums + key)
        allowance = int((count > 0).sum() + (count[:near] > 1).sum()) - min(most, len(own) // 4) - 1
        whole = allowance < 0  # too many segments are empty to leave them out
        if near == 0:
            kept = hashes if whole else hashes[count > 0]
            return kept, np.full(len(kept), whole), max(allowance, 0)
        inside = segment < near
        lone = count[segment[inside]] == 1
        gone = mix(sums[segment[inside]] - value[inside] + key[segment[inside]])
        gone = gone if whole else gone[~lone]
        fixed = np.arange(m) < near
        if not whole:
            hashes, fixed = hashes[count > 0], fixed[count > 0]
        out = np.concatenate([hashes, gone])
        return out, np.concatenate([fixed | whole, np.ones(len(gone), bool)]), max(allowance, 0)


def measure(docs: DataFrame, nodes: Nodes) -> DataFrame:
    """doc_id, n_shingles, node (null without a set) and check of each document."""
    rows = texts(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_slices(batches):
            sets = list(shingle_sets(*text_view(batch.column(1))))
            check = [int(signed(nodes.check(own)[None])[0]) for own in sets]
            columns = [pa.array(map(len, sets), pa.int64()), pa.array(nodes.signed_of(sets), pa.int64()), pa.array(check, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_shingles", "node", "check"])

    return rows.mapInArrow(tidy(run), f"doc_id {dict(rows.dtypes)['doc_id']}, n_shingles long, node long, check long")


def named_sets(docs: DataFrame, bits: int) -> tuple[DataFrame, DataFrame, Nodes]:
    """(doc_id, n_shingles, node) of every document; of every node, its least doc_id and its size n; and how
    nodes are named, so that different sets are different nodes by 128 bits."""
    nodes = Nodes(bits)
    measured = cut(measure(docs, nodes), "sets")
    by_node = lambda: measured.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.min("check").alias("one"), F.max("check").alias("two"))
    classes = cut(by_node(), "classes")
    found = classes.where("one <> two").select("node").limit(MOST_CLASHES + 1).collect()
    if len(found) > MOST_CLASHES:
        raise RuntimeError("far more equal hashes than chance gives")
    if found:
        nodes = Nodes(bits, frozenset(r["node"] for r in found))
        measured = measured.withColumn("node", F.when(F.col("node").isin(*nodes.clashes), F.col("check")).otherwise(F.col("node")))
        classes = cut(by_node(), "classes")
    return measured.select("doc_id", "n_shingles", "node"), classes.select("node", "doc_id", "n"), nodes


def pack_hashes(docs: DataFrame, coarse: int, names: Nodes) -> DataFrame:
    """The packed index of all documents' segment hashes, and each node's allowances."""
    rows = texts(docs).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in arrow_slices(batches, "text", SLICE_BYTES):
            for start in range(0, batch.num_rows, packed_index.SLICE_NODES):
                turn += 1
                yield from packed_index.batches_of(_pack_slice(batch.slice(start, packed_index.SLICE_NODES), coarse, turn, names))
                release()

    return rows.mapInArrow(tidy(run), packed_index.SCHEMA)


def _pack_slice(batch: pa.RecordBatch, coarse: int, turn: int, names: Nodes) -> list[tuple]:
    data, offsets = text_view(batch.column(0))
    nodes: dict[int, int] = {}
    hashes, who = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint16)]
    spare: list[tuple[int, int]] = []
    for own in shingle_sets(data, offsets):
        if not len(own) or not (bands := bands_of(len(own))):
            continue
        node = int(names.of(own))
        if node in nodes:
            continue
        nodes[node] = len(nodes)
        allowed = [0, 0]
        for flag, k in bands:
            found, fixed, allowed[flag] = deal(own, k)
            hashes.append(found)
            who.append((nodes[node] | (flag << 14) | (fixed.astype(np.int64) << 15)).astype(np.uint16))
        spare.append(tuple(allowed))
    if not nodes:
        return []
    table = np.fromiter(nodes, np.uint64, len(nodes))
    own, after = np.array(spare).T
    return [*packed_index.pack(np.concatenate(hashes), np.concatenate(who), table, coarse, turn), packed_index.notes(table, own, after, turn % coarse)]


def _sized(df: DataFrame) -> DataFrame:
    """``df``, a cut table, marked for broadcast where it is small enough; Spark shuffles it otherwise."""
    return F.broadcast(df) if df.count() <= SMALL_SIDE else df


class Verifier:
    """Verifies pairs of nodes on the shingle sets of their whole texts."""

    def __init__(self, docs: DataFrame, classes: DataFrame, percent: int, names: Nodes):
        self.docs, self.classes, self.percent, self.names = docs, classes, percent, names

    def texts_of(self, pairs: DataFrame) -> DataFrame:
        """(node, text) of the nodes in ``pairs``; the texts are squeezed."""
        asked = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
        wanted = cut(asked.join(self.classes, "node").select("node", "doc_id"), "wanted")
        rows = texts(self.docs).where(F.col("doc_id").isNotNull())
        names = self.names

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:  # doc_id, text, key
                nodes = names.signed_of(own for i in range(0, batch.num_rows, AT_ONCE) for own in shingle_sets(*text_view(expand(batch.column(1).slice(i, AT_ONCE)))))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), batch.column(1)], ["doc_id", "node", "text"])

        then = run, f"doc_id {dict(rows.dtypes)['doc_id']}, node long, text binary"
        found = maybe_in(rows.withColumn("key", F.xxhash64("doc_id")), wanted.select(F.xxhash64("doc_id").alias("key")), then)
        return found.join(wanted, ["doc_id", "node"]).dropDuplicates(["doc_id", "node"]).select("node", "text")

    def links(self, pairs: DataFrame, known: DataFrame | None = None) -> DataFrame:
        """The pairs (u, v) whose sets are similar enough; ``known``: (node, text) of their nodes, squeezed."""
        percent = self.percent
        if known is None:
            known = cut(self.texts_of(pairs), "node-texts")
        of = lambda name: known.select(F.col("node").alias(name), F.col("text").alias(f"text_{name}"))
        joined = pairs.select("u", "v").join(of("v"), "v").join(of("u"), "u").select("u", "v", "text_u", "text_v")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, hub = None, None
            for batch in batches:
                for start in range(0, batch.num_rows, AT_ONCE):
                    part = batch.slice(start, AT_ONCE)
                    keep = []
                    for i, (u, own) in enumerate(zip(part.column(0).to_pylist(), shingle_sets(*text_view(expand(part.column(3)))), strict=True)):
                        if u != last:
                            hub = next(shingle_sets(*text_view(expand(part.column(2).slice(i, 1)))))
                            last = u
                        a, b = len(hub), len(own)
                        if 100 * min(a, b) < percent * max(a, b):
                            continue
                        both = len(np.intersect1d(hub, own, assume_unique=True))
                        if 100 * both >= percent * (a + b - both):
                            keep.append(i)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep, pa.int64())), part.column(1).take(pa.array(keep, pa.int64()))], ["u", "v"])
                release()

        return cut(joined.mapInArrow(tidy(run), "u long, v long"), "links")


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Nodes and shingle sets of (node, squeezed text), some at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(start, AT_ONCE)
            yield part.column(0).to_numpy(zero_copy_only=False).view(np.uint64), list(shingle_sets(*text_view(expand(part.column(1)))))
            release()


def shingle_counts(known: DataFrame) -> np.ndarray:
    """How many of the sets of ``known`` have each shingle, summed over shingles of the same cell: a table of
    fixed size, whatever the corpus. It only orders shingles, from rare to frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(CELLS, np.int64)
        for _, sets in _sets_of(batches):
            sums += np.bincount((np.concatenate(sets) & U64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        parts = sums.reshape(CELL_SLICES, -1)
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([zlib.compress(parts[i].tobytes(), 1) for i in used], pa.binary())], ["slice", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in pdf["counts"])
        return pd.DataFrame({"slice": pdf["slice"][:1], "counts": [zlib.compress(np.minimum(total, 2**31 - 1).astype(np.int32).tobytes(), 1)]})

    counted = known.select("node", "text").mapInArrow(tidy(run), "slice int, counts binary").groupBy("slice").applyInPandas(add, "slice int, counts binary")
    out = np.zeros((CELL_SLICES, CELLS // CELL_SLICES), np.int32)
    for r in counted.collect():
        out[r["slice"]] = np.frombuffer(zlib.decompress(r["counts"]), np.int32)
    return out.ravel()


def rare_shingles(known: DataFrame, blocks: int, percent: int) -> DataFrame:
    """Members (hash, node, ...) of the rarest shingles of each set that some other set also has among its
    own: so many that two similar sets have one of them in common, since a link leaves a set at most
    100 - percent of its shingles that the other doesn't have."""
    counts = known.sparkSession.sparkContext.broadcast(shingle_counts(known))
    coarse, fine = packed_index.layout(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for nodes, sets in _sets_of(batches):
            turn += 1
            rare = []
            for own in sets:
                order = np.lexsort((own, counts.value[(own & U64(CELLS - 1)).astype(np.int64)]))
                rare.append(own[order[: len(own) - -(-len(own) * percent // 100) + 1]])
            who = np.repeat(np.arange(len(rare)), [len(x) for x in rare]).astype(np.uint16)
            yield from packed_index.batches_of(packed_index.pack(np.concatenate([*rare, np.zeros(0, np.uint64)]), who, nodes, coarse, turn))

    return packed_index.members(known.select("node", "text").mapInArrow(tidy(run), packed_index.SCHEMA), coarse, fine)


def _rooted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """``pairs`` with root_u and root_v; a node without links is its own root."""
    of = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"root_{name}"))
    return pairs.join(of("u"), "u", "left").join(of("v"), "v", "left").withColumns({f"root_{x}": F.coalesce(f"root_{x}", x) for x in "uv"})


def _crossing(rows: DataFrame, roots: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` of (hash, node, ...) with ``root`` and ``main``, the root that most of a hash's members have,
    where a hash spans roots; and how many pairs of different roots they could make."""
    known = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    by_root = known.groupBy("hash", "root").agg(F.count("*").alias("k"))
    mains = by_root.groupBy("hash").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.sum("k").alias("members"), F.max("k").alias("most_k")).where("most_k < members")
    mains = cut(mains, "mains")  # of its own, so that Spark can split the join of a hash with very many members
    crossing = cut(known.join(_sized(mains), "hash"), "crossing")
    pairs = crossing.agg(F.sum(F.when(F.col("root") != F.col("main"), F.col("members"))).alias("n")).first()["n"] or 0
    return crossing, pairs


def similar_classes(docs: DataFrame, percent: int = 80, bits: int = 64, most_coarse: int = packed_index.MOST_COARSE) -> tuple[DataFrame, DataFrame, Nodes]:
    """(doc_id, n_shingles, node) of every document, (node, root) of the nodes that have links, and how nodes
    are named."""
    if percent != 80:
        raise ValueError("bands and allocations are made for a similarity of 0.8")
    with scratch(keep=("sets", "roots")):
        return _similar_classes(docs, percent, bits, most_coarse)


def _similar_classes(docs: DataFrame, percent: int, bits: int, most_coarse: int) -> tuple[DataFrame, DataFrame, Nodes]:
    measured, classes, names = named_sets(docs, bits)
    total = classes.agg(F.sum("n").alias("n")).first()["n"] or 0
    coarse, fine = packed_index.layout(max(LEAST_BLOCKS, total // BLOCK_HASHES), most_coarse)
    both = cut(packed_index.members(pack_hashes(docs, coarse, names), coarse, fine), "members")
    members = both.where("flag >= 0")
    verifier = Verifier(docs, classes, percent, names)

    # First against each hash's hub, where two sets of like size share enough to make a link likely
    size = lambda name: classes.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"))
    hubs = members.where("hub <> node").groupBy(F.col("hub").alias("u"), F.col("node").alias("v")).agg(F.count("*").alias("shared"))
    hubs = cut(hubs.join(size("u"), "u").join(size("v"), "v"), "hubs")
    like = f"100 * least(n_u, n_v) >= {percent} * greatest(n_u, n_v)"
    tried = cut(hubs.where(like).where(f"shared >= {LIKELY_SHARED} OR least(n_u, n_v) < {SMALL_SET}").select("u", "v"), "pairs")
    links = verifier.links(tried)
    roots = cut(components(links), "roots")

    # The hashes that still span components
    broken = cut(_rooted(hubs, roots).where("root_u <> root_v").select(F.col("u").alias("hub"), F.col("v").alias("node")), "broken")
    if broken.isEmpty():
        return measured, roots, names
    hashes = cut(members.join(_sized(broken), ["hub", "node"]).select("hash").distinct(), "hashes")
    open_members = cut(members.join(_sized(hashes), "hash").groupBy("hash", "node").agg(F.max("flag").alias("flag"), F.max("df").alias("df")), "open")

    # What a set may ignore goes to its most frequent hashes; a hash that all its members ignore is done
    allowed = both.where("flag = -1").groupBy("node").agg(F.first("hub").alias("spare_own"), F.first("df").alias("spare_next"))
    per_hash = open_members.groupBy("hash").agg(F.max("df").alias("most"))
    order = Window.partitionBy("node", "flag").orderBy(F.desc("most"), "hash")
    spared = (
        open_members.join(per_hash, "hash")
        .withColumn("nth", F.row_number().over(order))
        .join(allowed, "node")
        .withColumn("spare", F.when(F.col("flag") >= FIXED, 0).when(F.col("flag") == OWN, F.col("spare_own")).otherwise(F.col("spare_next")).cast("int"))
        .select("hash", "node", (F.col("nth") > F.col("spare")).alias("active"))
    )
    spared = cut(spared, "spared")
    live = cut(spared.groupBy("hash").agg(F.max("active").alias("any"), F.count("*").alias("members")).where("any AND members > 1").select("hash"), "live")
    if live.isEmpty():
        return measured, roots, names
    # The sets that are left meet by their rarest shingles, which families of texts don't share
    left = cut(spared.join(_sized(live), "hash").select("node").distinct(), "left")
    known = cut(verifier.texts_of(left.select(F.col("node").alias("u"), F.col("node").alias("v"))), "node-texts")
    held = left.join(classes.select("node", "n"), "node").agg(F.sum("n").alias("n")).first()["n"] or 0
    rare = rare_shingles(known, max(LEAST_BLOCKS, held // (5 * BLOCK_HASHES)), percent)
    active = cut(rare.select("hash", "node").distinct().join(classes.select("node", "n"), "node"), "rare")
    crossing, pairs = _crossing(active, roots)
    if pairs > MANY_PAIRS * max(left.count(), 1):  # other hubs join most of what the first didn't
        hub = crossing.groupBy("hash").agg(F.min_by("node", F.xxhash64("node")).alias("u"))
        more = crossing.join(hub, "hash").select("u", F.col("node").alias("v")).where("u <> v").distinct()
        more = cut(_rooted(more, roots).where("root_u <> root_v").select("u", "v").join(tried, ["u", "v"], "left_anti"), "pairs")
        tried = cut(tried.unionByName(more), "tried")
        links = cut(links.unionByName(verifier.links(more, known)), "links")
        roots = cut(components(links), "roots")
        crossing, pairs = _crossing(active, roots)

    # What is left: members of different components, pair by pair, and in blocks where a hash has many
    few, many = crossing.where(F.col("members") <= PAIRED_MEMBERS), crossing.where(F.col("members") > PAIRED_MEMBERS)
    side = lambda x: few.select("hash", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "root")), *(["main"] if x == "u" else []))
    met = side("u").where("root_u <> main").join(side("v"), "hash").where(f"root_u <> root_v AND (root_v = main OR node_u < node_v) AND {like}")
    rest = met.select(F.least("node_u", "node_v").alias("u"), F.greatest("node_u", "node_v").alias("v")).distinct()
    rest = cut(rest.join(tried.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")), ["u", "v"], "left_anti"), "pairs")
    found = [] if rest.isEmpty() else [verifier.links(rest, known)]
    if not many.isEmpty():
        found.append(cut(block_links(many, known, percent), "links"))
    if found:
        for x in found:
            links = links.unionByName(x)
        roots = cut(components(links), "roots")
    return measured, roots, names


def spanning_forest(linked: np.ndarray, group: np.ndarray) -> list[tuple[int, int]]:
    """Of a symmetric matrix of links between members of different groups, links that join all groups which
    these join, directly or not."""
    order = np.argsort(group, kind="stable")
    starts = np.searchsorted(group[order], np.arange(int(group.max()) + 2))
    members = [order[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
    seen = np.zeros(len(members), bool)
    out = []
    for first in range(len(members)):
        if seen[first]:
            continue
        seen[first] = True
        todo = [first]
        while todo:
            own = members[todo.pop()]
            reached = np.flatnonzero(linked[own].any(axis=0))
            for k, i in zip(*(x.tolist() for x in np.unique(group[reached], return_index=True)), strict=True):
                if not seen[k]:
                    seen[k] = True
                    todo.append(k)
                    v = int(reached[i])
                    out.append((int(own[np.argmax(linked[own, v])]), v))
    return out


def block_links(crossing: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The links (u, v) between different components among the members of each hash of ``crossing`` (hash,
    node, n, root): members are dealt into chunks of bounded size, and each two chunks are compared at once,
    by a product of their incidence matrices. What comes out joins the roots that links join: a spanning forest,
    at most one link fewer than there are roots in the two chunks."""
    sizes = cut(crossing.groupBy("hash").agg(F.greatest(F.ceil(F.count("*") / CHUNK_SETS), F.ceil(F.sum("n") / CHUNK_SHINGLES)).cast("int").alias("chunks")), "chunks")
    dealt = crossing.select("hash", "node", "root").join(_sized(sizes), "hash").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    spread = dealt.select("hash", "node", "root", "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    keyed = spread.select("hash", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "node", "root", "chunk")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [own for t in pdf["text"] for own in shingle_sets(*text_view(expand(pa.array([t], pa.binary()))))]
        size = np.array([len(x) for x in sets])
        who = np.repeat(np.arange(len(sets)), size)
        _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = times[token] > 1
        order = np.cumsum(times > 1) - 1
        token, who = order[token[shared]], who[shared]
        both = np.zeros((len(sets), len(sets)), np.float32)
        by = np.argsort(token, kind="stable")
        token, who = token[by], who[by]
        for start in range(0, int((times > 1).sum()), PRODUCT_COLUMNS):
            a, b = np.searchsorted(token, [start, start + PRODUCT_COLUMNS])
            part = np.zeros((len(sets), PRODUCT_COLUMNS), np.float32)
            part[who[a:b], token[a:b] - start] = 1
            both += part @ part.T
        root, chunk = pdf["root"].to_numpy(), pdf["chunk"].to_numpy()
        linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
        linked &= root[:, None] != root[None, :]
        if pdf["i"].iloc[0] != pdf["j"].iloc[0]:
            linked &= chunk[:, None] != chunk[None, :]
        node = pdf["node"].to_numpy()
        forest = spanning_forest(linked, np.unique(root, return_inverse=True)[1])
        release()
        return pd.DataFrame([(node[u], node[v]) for u, v in forest], columns=["u", "v"], dtype=np.int64)

    return keyed.join(known, "node").groupBy("hash", "i", "j").applyInPandas(compare, "u long, v long").distinct()


def join_documents(docs: DataFrame, percent: int = 80, **how) -> DataFrame:
    """doc_id, n_shingles and component_id of every document: the smallest doc_id reachable by links."""
    measured, roots, _ = similar_classes(docs, percent, **how)
    nodes = measured.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    own = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = own.groupBy("root").agg(F.min("least").alias("component_id"))
    n = measured.count()
    named = cut(hot_join(own, least, "root", n).select("node", "component_id"), "components")
    with_set = hot_join(measured.where("node IS NOT NULL"), named, "node", n).select("doc_id", "n_shingles", "component_id")
    return with_set.unionByName(measured.where("node IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_one_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows and columns of ``docs`` of which one stays of each component: a row with its smallest doc_id
    and, where several rows have that doc_id, the least by node, text and the other columns. Rows of one doc_id
    are judged each by its own text. Rows without a set, or without a doc_id, all stay."""
    names = docs.columns
    measured, roots, nodes = similar_classes(docs, percent)
    own = measured.where("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id", "node").agg(F.count("*").alias("rows"))
    own = own.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = own.groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("first"))
    judged = hot_join(own, least, "root", measured.count()).withColumn("leads", F.struct("doc_id", "node") == F.col("first"))
    by_id = judged.groupBy("doc_id").agg(F.max("leads").alias("leads"), F.sum("rows").alias("rows"))
    # doc_ids whose only row leads need nothing; those without a leading row go; the others are judged by row
    judged = cut(by_id.where("NOT leads OR rows > 1").select(F.col("doc_id").alias("__judged"), "leads"), "judged")
    plain = docs.join(judged.select("__judged"), docs["doc_id"] == F.col("__judged"), "left_anti").select(*names)
    mixed = cut(judged.where("leads").select("__judged"), "mixed")
    if mixed.isEmpty():
        return plain
    leaders = least.select(F.col("first.doc_id").alias("__id"), F.col("first.node").alias("__node"))
    rows = _with_node(nodes, docs.join(mixed, docs["doc_id"] == F.col("__judged"), "left_semi"))
    led = rows.join(leaders, (F.col("doc_id") == F.col("__id")) & (rows["__node"] == leaders["__node"]), "left_semi")
    order = Window.partitionBy("doc_id", "__node").orderBy("text", F.to_json(F.struct(*(F.col(f"`{n}`") for n in names))))
    one = led.withColumn("__nth", F.row_number().over(order)).where("__nth = 1").select(*names)
    return plain.unionByName(rows.where("__node IS NULL").select(*names)).unionByName(one)


def _with_node(nodes: Nodes, docs: DataFrame) -> DataFrame:
    """``docs`` with the node of each text as ``__node``, null without a set."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_slices(batches):
            node = nodes.signed_of(shingle_sets(*text_view(batch.column(at))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node, pa.int64())], [*batch.schema.names, "__node"])

    return bounded_batches(docs).mapInArrow(tidy(run), StructType([*docs.schema.fields, StructField("__node", LongType())]))


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM words),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) + any_value(b.n) AS n, count(*) AS k FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM pairs WHERE 100 * k >= 80 * (n - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS root FROM sets UNION SELECT e.b, r.root FROM reach r JOIN edges e ON r.node = e.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, (SELECT min(root) FROM reach WHERE node = doc_id) AS component_id FROM sets
"""

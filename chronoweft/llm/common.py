"""Shared parts of the operators: Arrow text views, word hashing, tables in the shared folder."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from chronoweft.session import shared_dir

BLOCK_BYTES = 1 << 19
"""Texts go through the numpy kernels in blocks of about this many bytes."""

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    with np.errstate(over="ignore"):
        x = x + U64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, kept between calls."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK_BYTES + (1 << 16))
        both = []
        for factor in (_BASE, _INVERSE):
            row = np.full(size, factor, dtype=np.uint64)
            row[0] = 1
            both.append(np.cumprod(row, dtype=np.uint64))
        have = (both[0], both[1])
        if size <= 4 * BLOCK_BYTES:
            _powers[0] = have
    return have


def text_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


def row_blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_table(extra: bytes = b"") -> np.ndarray:
    """True for bytes that separate words: blank and the control blanks, and ``extra``."""
    out = np.zeros(256, bool)
    out[[0x20, *range(0x09, 0x0E)]] = True
    out[list(extra)] = True
    return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANKS = word_table()


def hash_words(data: np.ndarray, offsets: np.ndarray, blanks: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of each row, and the number of words per row.

    ``data`` holds the rows' bytes one after another, ``offsets`` where each starts. Rows longer than
    the block are cut between words, so the working memory doesn't grow with a text's length.
    """
    hashes, counts = [], np.zeros(len(offsets) - 1, np.int64)
    for i, j in row_blocks(offsets):
        start, stop = int(offsets[i]), int(offsets[j])
        if stop - start <= 4 * BLOCK_BYTES:
            got, rows = _hash_block(data[start:stop], offsets[i : j + 1] - start, blanks)
            hashes.append(got)
            counts[i:j] = rows
            continue
        while start < stop:
            end = min(start + BLOCK_BYTES, stop)
            while end < stop and not blanks[data[end]]:
                step = np.flatnonzero(blanks[data[end : end + BLOCK_BYTES]])
                end = end + int(step[0]) if len(step) else min(end + BLOCK_BYTES, stop)
            got, rows = _hash_block(data[start:end], np.array([0, end - start]), blanks)
            hashes.append(got)
            counts[i] += rows[0]
            start = end
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def _hash_block(data: np.ndarray, offsets: np.ndarray, blanks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    rows = len(offsets) - 1
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    word = ~blanks[data]
    edge = np.zeros(n + 1, bool)
    edge[1:n] = word[1:] != word[:-1]
    edge[0] = edge[n] = True
    edge[offsets] = True
    at = np.flatnonzero(edge)
    inside = word[at[:-1]]
    starts, ends = at[:-1][inside], at[1:][inside]
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE_VALUES[LOWER[data]] * up[:n], dtype=np.uint64, out=sums[1:])
        values = (sums[ends] - sums[starts]) * down[starts]
        values = mix(values + (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, offsets)
    return values, np.diff(first)


SHINGLE_FACTORS = mix(np.arange(1001, 1065, dtype=np.uint64)) | U64(1)


def hash_runs(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive word hashes; entry i begins at word i."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = words[:n] * SHINGLE_FACTORS[0]
        for k in range(1, size):
            out += words[k : k + n] * SHINGLE_FACTORS[k]
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark's signed long."""
    return np.ascontiguousarray(x).view(np.int64)


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/chronoweft/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: the lineage ends there, and
    a lost executor costs no more than the tasks that it ran."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    writer = df.write.option("compression", "zstd").mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._chronoweft_path = path
    for made in _scratch:
        made.append((name, out))
    return out


_scratch: list[list[tuple[str, DataFrame]]] = []


@contextmanager
def scratch(keep: tuple[str, ...] = ()) -> Iterator[None]:
    """Tables that :func:`cut` writes in this block are deleted when it ends well, but for those named in ``keep``:
    what the block returns may be read from these alone."""
    made: list[tuple[str, DataFrame]] = []
    _scratch.append(made)
    try:
        yield
        for name, table in made:
            if name not in keep:
                drop_cut(table)
    finally:
        _scratch.remove(made)


def drop_cut(df: DataFrame) -> None:
    """Delete a table written by :func:`cut` that nothing reads any more."""
    path = getattr(df, "_chronoweft_path", None)
    if path:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task function that gives its freed memory back when it ends."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def release() -> None:
    """Give freed memory back to the system: workers are kept between tasks, and so would be their heaps."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim
except (OSError, AttributeError):  # not glibc
    _libc = None


BATCH_BYTES = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, its session set to send Python at most BATCH_BYTES at a time: by rows alone, batches of long
    texts would be as large as an executor."""
    conf = df.sparkSession.conf
    now = str(conf.get(_BATCH_SETTING, str(1 << 30))).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return df


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and the columns named, null texts as empty ones; other columns don't matter."""
    from pyspark.sql import functions as F

    return bounded_batches(docs).select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def arrow_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 4 * BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = text_view(batch.column(batch.schema.get_field_index(column)))
        for i, j in row_blocks(offsets, limit):
            yield batch.slice(i, j - i)


HOT_SHARE = 50_000
"""A key with more than this part of all rows, and more than LEAST_HOT, is hot: there are at most so many such keys."""
LEAST_HOT = 100_000


def hot_join(rows: DataFrame, table: DataFrame, key: str, n: int) -> DataFrame:
    """``rows`` (about n of them) joined with ``table``, which has one row a key. The rows of hot keys, such as the
    copies of one text, don't go through the shuffle: those keys' rows of the table are broadcast."""
    from pyspark.sql import functions as F

    limit = max(LEAST_HOT, n // HOT_SHARE)
    if n <= limit:
        return rows.join(table, key)
    others = [c for c in table.columns if c != key]
    many = rows.groupBy(F.col(key).alias("__hot")).agg(F.count("*").alias("__n")).where(F.col("__n") > limit).select("__hot")
    known = many.join(table, many["__hot"] == table[key]).select("__hot", *(F.col(c).alias(f"__{c}") for c in others))
    split = rows.join(F.broadcast(known), rows[key] == F.col("__hot"), "left")
    cold = split.where("__hot IS NULL").select(*rows.columns).join(table, key)
    return cold.unionByName(split.where("__hot IS NOT NULL").select(*rows.columns, *(F.col(f"__{c}").alias(c) for c in others)))


FILTER_BITS_A_ROW, LEAST_FILTER_BITS, MOST_FILTER_BITS = 8, 1 << 20, 1 << 29


Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def maybe_in(df: DataFrame, wanted: DataFrame, then: tuple[Step, str] | None = None, most_bits: int = MOST_FILTER_BITS) -> DataFrame:
    """The rows of ``df`` whose long column ``key`` may be among those of ``wanted`` (a table that can be read
    again): all that are, and a few others. It keeps rows out of a shuffle; a join must follow. Their ``text``
    comes back squeezed. ``then``: what the rows go through in the same Python workers, and its schema; as a step
    of its own it would have workers of its own beside these.

    The filter is a bitmap of some bits for each wanted row. Where that is more than ``most_bits`` (64 MB), no
    bitmap that may be broadcast would hold back much, and all rows go on to the join."""
    from pyspark.sql import functions as F

    bits = LEAST_FILTER_BITS
    rows = wanted.count()
    while bits < FILTER_BITS_A_ROW * rows:
        bits *= 2
    at, text = df.columns.index("key"), df.columns.index("text")
    schema = then[1] if then else ", ".join(f"{n} {'binary' if n == 'text' else k}" for n, k in df.dtypes)
    finish: Step = then[0] if then else lambda batches: batches

    def squeezed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in arrow_slices(iter([batch])):
            arrays = list(part.columns)
            arrays[text] = squeeze(arrays[text])
            yield pa.RecordBatch.from_arrays(arrays, batch.schema.names)

    if bits > most_bits:
        return df.mapInArrow(tidy(lambda batches: finish(x for batch in batches for x in squeezed(batch))), schema)
    slot = F.pmod(F.col("key"), F.lit(bits))
    got = wanted.select(slot.alias("h")).groupBy(F.bitmap_bucket_number("h").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits")).collect()
    size = 32768 // 8  # bytes of one of Spark's bitmaps; positions above zero start in bucket 1
    bitmap = np.zeros(bits // 8 + 2 * size, np.uint8)
    for r in got:
        bitmap[r["b"] * size : (r["b"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    shipped = df.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(at).to_numpy(zero_copy_only=False) % bits
            bucket = np.where(h > 0, 1 + (h - 1) // 32768, 0)
            place = np.where(h > 0, (h - 1) % 32768, 0)
            hit = np.flatnonzero((shipped.value[bucket * size + (place >> 3)] >> (place & 7).astype(np.uint8)) & 1)
            if len(hit):
                yield from squeezed(batch.take(pa.array(hit)))

    return df.mapInArrow(tidy(lambda batches: finish(run(batches))), schema)


def squeeze(column: pa.Array) -> pa.Array:
    """Texts as zstd frames, for a shuffle."""
    import zstandard

    data, offsets = text_view(column)
    raw, pack = memoryview(data.tobytes()), zstandard.ZstdCompressor(level=1, write_content_size=True).compress
    return pa.array([pack(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.binary())


def expand(column: pa.Array) -> pa.Array:
    """The UTF-8 bytes of texts that :func:`squeeze` packed."""
    import zstandard

    open_ = zstandard.ZstdDecompressor().decompress
    return pa.array([open_(x.as_buffer()) for x in column], pa.large_binary())


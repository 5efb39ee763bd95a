"""TIFF media columns: texts as 8-bit images, and a reader that walks image directories.

The reader takes any baseline little- or big-endian TIFF with 8-bit samples: strips or tiles; no
compression, PackBits, LZW or deflate; no predictor or horizontal differencing; it emits one row per page.
The writer uses all of these: which ones a page gets follows from its bytes alone, so equal texts give
equal files.

Everything happens row by row inside the tasks, with no shuffle; memory follows the largest single text.

Defined cases: null and empty texts give one 576-byte block of padding; repeated rows each give a row; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chronoweft.llm.common import arrow_slices, text_view, texts, tidy

WIDTH = 576
PAGE_ROWS = 1024
STRIP_ROWS = 64
TILE_WIDTH, TILE_ROWS = 64, 16
PAD = b"\xff"

# Fixed values of the TIFF 6.0 specification.
NONE, LZW, DEFLATE, PACKBITS = 1, 5, 8, 32773
TAGS = {
    "width": 256, "height": 257, "bits": 258, "compression": 259, "photometric": 262, "strip_offsets": 273,
    "samples": 277, "rows_per_strip": 278, "strip_bytes": 279, "predictor": 317, "tile_width": 322,
    "tile_rows": 323, "tile_offsets": 324, "tile_bytes": 325,
}
NAMES = {v: k for k, v in TAGS.items()}
SHORT, LONG = 3, 4
RUN = re.compile(rb"(?s)(.)\1{2,127}")


def packbits(row: bytes) -> bytes:
    """One row in PackBits packets."""
    out, done = bytearray(), 0

    def literal(part: bytes) -> None:
        for i in range(0, len(part), 128):
            own = part[i : i + 128]
            out.append(len(own) - 1)
            out.extend(own)

    for m in RUN.finditer(row):
        literal(row[done : m.start()])
        out.append(257 - (m.end() - m.start()))
        out.append(row[m.start()])
        done = m.end()
    literal(row[done:])
    return bytes(out)


def unpackbits(data: bytes) -> bytes:
    out, i, n = [], 0, len(data)
    while i < n:
        k = data[i]
        if k < 128:
            out.append(data[i + 1 : i + 2 + k])
            i += k + 2
        elif k > 128:
            out.append(data[i + 1 : i + 2] * (257 - k))
            i += 2
        else:
            i += 1
    return b"".join(out)


CLEAR, END, FIRST = 256, 257, 258


def lzw(data: bytes) -> bytes:
    """TIFF's LZW: most significant bit first, codes of 9 to 12 bits that widen one code early."""
    acc = used = 0
    out = bytearray()

    def put(code: int, width: int) -> None:
        nonlocal acc, used
        acc, used = (acc << width) | code, used + width
        while used >= 8:
            used -= 8
            out.append((acc >> used) & 255)
        acc &= (1 << used) - 1

    table: dict[tuple[int, int], int] = {}
    following, width = FIRST, 9
    put(CLEAR, width)
    prefix = -1
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        code = table.get((prefix, byte))
        if code is not None:
            prefix = code
            continue
        put(prefix, width)
        table[prefix, byte] = following
        following += 1
        if following > (1 << width) - 1:
            width += 1
        if following == 4094:
            put(CLEAR, min(width, 12))
            table.clear()
            following, width = FIRST, 9
        prefix = byte
    if prefix >= 0:
        put(prefix, width)
        following += 1
        if following > (1 << width) - 1 and width < 12:
            width += 1
    put(END, width)
    if used:
        out.append((acc << (8 - used)) & 255)
    return bytes(out)


def unlzw(data: bytes) -> bytes:
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, out = list(base), 9, []
    last = b""
    acc = used = 0
    for byte in data:
        acc, used = (acc << 8) | byte, used + 8
        if used < width:
            continue
        used -= width
        code = acc >> used
        acc &= (1 << used) - 1
        if code == END:
            break
        if code == CLEAR:
            table, width, last = list(base), 9, b""
            continue
        if not last:
            own = table[code]
        else:
            own = table[code] if code < len(table) else last + last[:1]
            table.append(last + own[:1])
        out.append(own)
        last = own
        if len(table) + 1 > (1 << width) - 1 and width < 12:
            width += 1
    return b"".join(out)


def compress(block: np.ndarray, compression: int, predictor: int) -> bytes:
    """One strip or tile."""
    if predictor == 2:
        step = block.copy()
        step[:, 1:] -= block[:, :-1]
        block = step
    if compression == PACKBITS:
        return b"".join(packbits(r.tobytes()) for r in block)
    raw = block.tobytes()
    return zlib.compress(raw, 1) if compression == DEFLATE else lzw(raw) if compression == LZW else raw


def decompress(data: bytes, compression: int, predictor: int, rows: int, width: int) -> np.ndarray:
    if compression == PACKBITS:
        data = unpackbits(data)
    elif compression in (DEFLATE, 32946):
        data = zlib.decompress(data)
    elif compression == LZW:
        data = unlzw(data)
    elif compression != NONE:
        raise ValueError(f"compression {compression} isn't supported")
    block = np.frombuffer(data, np.uint8, rows * width).reshape(rows, width)
    if predictor == 2:
        return np.cumsum(block, axis=1, dtype=np.uint8)
    if predictor != 1:
        raise ValueError(f"predictor {predictor} isn't supported")
    return block


def page_form(samples: bytes) -> tuple[int, int, bool]:
    """Compression, predictor and whether the page is tiled, from its bytes alone."""
    k = zlib.crc32(samples) % 4
    if k == 0:
        return DEFLATE, 2, False
    if k == 1:
        return PACKBITS, 1, False
    if k == 2:
        return DEFLATE, 1, True
    return LZW, 2, False


def encode(payload: bytes) -> bytes:
    """A little-endian TIFF whose pages hold the payload, a positive multiple of WIDTH bytes, row by row."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    size = WIDTH * PAGE_ROWS
    for start in range(0, len(payload), size):
        samples = payload[start : start + size]
        image = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
        rows = len(image)
        compression, predictor, tiled = page_form(samples)
        if tiled:
            full = np.full((-(-rows // TILE_ROWS) * TILE_ROWS, WIDTH), 255, np.uint8)
            full[:rows] = image
            blocks = [compress(full[y : y + TILE_ROWS, x : x + TILE_WIDTH], compression, predictor) for y in range(0, rows, TILE_ROWS) for x in range(0, WIDTH, TILE_WIDTH)]
        else:
            blocks = [compress(image[y : y + STRIP_ROWS], compression, predictor) for y in range(0, rows, STRIP_ROWS)]
        offsets = []
        for b in blocks:
            offsets.append(len(out))
            out += b
        entries = [("width", LONG, [WIDTH]), ("height", LONG, [rows]), ("bits", SHORT, [8]), ("compression", SHORT, [compression]), ("photometric", SHORT, [1]), ("samples", SHORT, [1]), ("predictor", SHORT, [predictor])]
        lengths = [len(b) for b in blocks]
        if tiled:
            entries += [("tile_width", SHORT, [TILE_WIDTH]), ("tile_rows", SHORT, [TILE_ROWS]), ("tile_offsets", LONG, offsets), ("tile_bytes", LONG, lengths)]
        else:
            entries += [("strip_offsets", LONG, offsets), ("rows_per_strip", LONG, [STRIP_ROWS]), ("strip_bytes", LONG, lengths)]
        entries.sort(key=lambda e: TAGS[e[0]])
        out += b"\0" * (len(out) % 2)
        far = []
        for name, kind, values in entries:
            raw = struct.pack(f"<{len(values)}{'H' if kind == SHORT else 'I'}", *values)
            if len(raw) > 4:
                far.append(len(out))
                out += raw + b"\0" * (len(raw) % 2)
            else:
                far.append(raw.ljust(4, b"\0"))
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries))
        for (name, kind, values), where in zip(entries, far, strict=True):
            out += struct.pack("<HHI", TAGS[name], kind, len(values)) + (where if isinstance(where, bytes) else struct.pack("<I", where))
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


class Page:
    """One image of a file: its tags, and its samples when asked for."""

    def __init__(self, data: bytes, tags: dict[str, list[int]]):
        self.data, self.tags = data, tags
        self.width, self.height = tags["width"][0], tags["height"][0]
        self.compression = tags.get("compression", [NONE])[0]
        self.predictor = tags.get("predictor", [1])[0]
        self.tiled = "tile_offsets" in tags
        if tags.get("bits", [1])[0] != 8 or tags.get("samples", [1])[0] != 1:
            raise ValueError("only one 8-bit sample a pixel is supported")

    def image(self) -> np.ndarray:
        t = self.tags
        if self.tiled:
            w, h = t["tile_width"][0], t["tile_rows"][0]
            across = -(-self.width // w)
            out = np.empty((-(-self.height // h) * h, across * w), np.uint8)
            for i, (at, n) in enumerate(zip(t["tile_offsets"], t["tile_bytes"], strict=True)):
                y, x = divmod(i, across)
                out[y * h : y * h + h, x * w : x * w + w] = decompress(self.data[at : at + n], self.compression, self.predictor, h, w)
            return out[: self.height, : self.width]
        rows = min(t.get("rows_per_strip", [self.height])[0], self.height)
        parts = []
        for i, (at, n) in enumerate(zip(t["strip_offsets"], t["strip_bytes"], strict=True)):
            parts.append(decompress(self.data[at : at + n], self.compression, self.predictor, min(rows, self.height - i * rows), self.width))
        return np.concatenate(parts)


def walk(data: bytes) -> Iterator[Page]:
    """The pages of a TIFF, along the chain of its image directories."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack(order + "I", data[4:8])[0]
    seen = set()
    while at:
        if at in seen:
            raise ValueError("the image directories form a circle")
        seen.add(at)
        n = struct.unpack(order + "H", data[at : at + 2])[0]
        tags: dict[str, list[int]] = {}
        for k in range(at + 2, at + 2 + 12 * n, 12):
            tag, kind, count = struct.unpack(order + "HHI", data[k : k + 8])
            if tag not in NAMES or kind not in (SHORT, LONG):
                continue
            size = count * (2 if kind == SHORT else 4)
            where = k + 8 if size <= 4 else struct.unpack(order + "I", data[k + 8 : k + 12])[0]
            tags[NAMES[tag]] = list(struct.unpack(f"{order}{count}{'H' if kind == SHORT else 'I'}", data[where : where + size]))
        yield Page(data, tags)
        at = struct.unpack(order + "I", data[at + 2 + 12 * n : at + 6 + 12 * n])[0]


def padded(text: bytes) -> bytes:
    return text + PAD * (-len(text) % WIDTH or (WIDTH if not text else 0))


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (the TIFF file) of each text."""
    rows = texts(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_slices(batches):
            data, offsets = text_view(batch.column(1))
            raw = data.tobytes()
            media = [encode(padded(raw[a:b])) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return rows.mapInArrow(tidy(run), f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, media binary")


def page_batches(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.RecordBatch]:
    """One row per page of each row's media: the key columns, page, pages, width, height, form, samples."""
    for batch in arrow_slices(batches, "media"):
        at = batch.schema.get_field_index("media")
        index, rows = [], []
        for i, media in enumerate(batch.column(at)):
            pages = list(walk(media.as_py()))
            for k, p in enumerate(pages):
                index.append(i)
                rows.append((k, len(pages), p.width, p.height, f"{p.compression}/{p.predictor}/{'tiles' if p.tiled else 'strips'}", p.image().tobytes()))
        kinds = [pa.int32()] * 4 + [pa.string(), pa.binary()]
        took = [batch.column(batch.schema.get_field_index(k)).take(pa.array(index, pa.int64())) for k in key]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([*took, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [*key, "page", "pages", "width", "height", "form", "samples"])


def read_pages(media: DataFrame) -> DataFrame:
    """One row per page: doc_id, page, pages, width, height, form and samples."""
    rows = media.select("doc_id", "media")
    return rows.mapInArrow(lambda batches: page_batches(batches, ["doc_id"]), f"doc_id {dict(rows.dtypes)['doc_id']}, page int, pages int, width int, height int, form string, samples binary")


def features(samples: np.ndarray, forms: list[str]) -> str:
    """Number of pages and their forms, mean and deviation, and shares of eight bands of brightness."""
    bands = np.bincount(samples >> 5, minlength=8)
    shares = ",".join(f"{x / len(samples):.4f}" for x in bands)
    return f"pages={len(forms)};forms={'+'.join(forms)};mean={samples.mean():.4f};std={samples.std():.4f};bands={shares}"


def media_digest(docs: DataFrame) -> DataFrame:
    """Each text stored as media, read back page by page, and described: one row per document."""
    media = to_media(docs)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_slices(batches, "media"):
            stored = batch.column(2)
            keyed = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), stored], ["row", "media"])
            parts: list[list[bytes]] = [[] for _ in range(batch.num_rows)]
            forms: list[list[str]] = [[] for _ in range(batch.num_rows)]
            for pages in page_batches(iter([keyed]), ["row"]):
                for i, form, samples in zip(pages.column(0).to_pylist(), pages.column(5).to_pylist(), pages.column(6).to_pylist(), strict=True):
                    parts[i].append(samples)
                    forms[i].append(form)
            out = []
            for i, own in enumerate(parts):
                payload = b"".join(own)
                file = stored[i].as_py()
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(file), hashlib.sha256(file).hexdigest(), features(np.frombuffer(payload, np.uint8), forms[i])))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names)

    return media.mapInArrow(tidy(run), f"doc_id {dict(media.dtypes)['doc_id']}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")

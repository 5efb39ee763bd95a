import hashlib
import struct
import zlib

import numpy as np
import pytest

from chronoweft.llm import tiff_media as T
from tests.llm.helpers import ODD_TEXTS, docs_of, with_clashes


def corpus():
    return [*ODD_TEXTS, "a" * 575, "a" * 576, "a" * 577, "é" * 400, "line of text\n" * 9000, "same", "same", *(f"text number {i} " * (i * 7 % 40) for i in range(40)), "z" * (576 * 1024 + 5)]


def test_digests(spark):
    texts = corpus()
    got = {r.doc_id: r for r in T.media_digest(with_clashes(docs_of(spark, texts))).collect()}
    media = {r.doc_id: bytes(r.media) for r in T.to_media(docs_of(spark, texts)).collect()}
    assert len(got) == len(texts)
    by_text = {}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(media[i]), hashlib.sha256(media[i]).hexdigest())
        assert by_text.setdefault(raw, tuple(r)[3:]) == tuple(r)[3:]
    forms = " ".join(r.feature for r in got.values())
    assert all(x in forms for x in ("5/2/strips", "8/2/strips", "8/1/tiles", "32773/1/strips"))


def test_one_row_a_page(spark):
    pages = T.read_pages(T.to_media(docs_of(spark, ["z" * (576 * 1024 + 5), "b"]))).orderBy("doc_id", "page").collect()
    assert [(p.doc_id, p.page, p.pages, p.width, p.height) for p in pages] == [(0, 0, 2, 576, 1024), (0, 1, 2, 576, 1), (1, 0, 1, 576, 1)]


def test_every_form_at_every_size():
    """Pages from one row to full ones come in all four forms and give their payload back."""
    rng = np.random.default_rng(3)
    for rows in (1, 4, 5, 64, 65, 1024):
        seen = set()
        for k in range(40):
            payload = rng.integers(97, 100 + k % 20, 576 * rows).astype(np.uint8).tobytes() if rows < 1024 or k < 12 else b""
            form = T.page_form(payload)
            if payload and form not in seen:
                seen.add(form)
                assert b"".join(p.image().tobytes() for p in T.walk(T.encode(payload))) == payload
        assert seen == {(T.DEFLATE, 2, False), (T.PACKBITS, 1, False), (T.DEFLATE, 1, True), (T.LZW, 2, False)}


def test_empty_table(spark):
    assert T.media_digest(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_codecs_round_trip(seed):
    rng = np.random.default_rng(seed)
    for n in (0, 1, 2, 3, 127, 128, 129, 300, 5000, 60_000):
        for alphabet in (2, 256):
            data = np.repeat(rng.integers(0, alphabet, n), rng.integers(1, 4, n))[:n].astype(np.uint8).tobytes()
            assert T.unpackbits(T.packbits(data)) == data
            assert T.unlzw(T.lzw(data)) == data


def test_packbits_of_the_specification():
    data = bytes.fromhex("FE AA 02 80 00 2A FD AA 03 80 00 2A 22 F7 AA".replace(" ", ""))
    assert T.unpackbits(data) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22" + "AA" * 10)


def test_big_endian_and_no_compression():
    image = np.arange(12, dtype=np.uint8).reshape(3, 4)
    tags = [(256, 4, 4), (257, 4, 3), (258, 3, 8 << 16), (259, 3, 1 << 16), (273, 4, 8), (277, 3, 1 << 16), (278, 4, 3), (279, 4, 12)]
    data = b"MM\0*" + struct.pack(">I", 20) + image.tobytes() + struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHII", t, k, 1, v) for t, k, v in tags) + b"\0\0\0\0"
    (page,) = T.walk(data)
    assert (page.image() == image).all()


def test_bad_files():
    with pytest.raises(ValueError):
        list(T.walk(b"GIF89a.."))

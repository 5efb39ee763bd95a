import gzip
import io
import os

import pytest

from chronoweft.llm import warc as W
from tests.llm.helpers import with_clashes

PAGES = "page_id long, url string, html string, doc string"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], PAGES)


def rows_of():
    out = [(i, f"http://a.example/{i}?q=é ü", f"<html>{i % 7} é</html>" * (i % 5)) for i in range(60)]
    return out + [(100, None, None), (101, "http://x", None), (102, "no scheme", ""), (103, "http://long", "x" * 300_000)]


def want(rows, least=0):
    best = {}
    for i, _, h in rows:
        best[h or ""] = max(i, best.get(h or "", i))
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        to = best[h or ""] if len(raw) >= least and best[h or ""] != i else None
        out.append((i, len(raw), W.base32_sha1(raw), "response" if to is None else "revisit", to))
    return sorted(out)


@pytest.mark.parametrize("least", [0, 10])
def test_round_trip(spark, least):
    got = sorted(map(tuple, W.archive_round_trip(pages_of(spark, rows_of()), least_revisit=least).collect()))
    assert got == want(rows_of(), least)


def test_files_roll_and_are_the_same_again(spark, tmp_path):
    pages = pages_of(spark, rows_of())
    names = []
    for k in (1, 2):
        folder = f"file://{tmp_path}/{k}"
        files = W.write_archives(pages, folder, roll_bytes=2_000, shards=2).collect()
        names.append({(f.file, f.bytes, f.records, f.sha256) for f in files})
        on_disk = {x for x in os.listdir(tmp_path / str(k)) if x.endswith(".gz")}
        assert on_disk == {f.file for f in files} and not [x for x in os.listdir(tmp_path / str(k)) if x.endswith(".tmp")]
        for f in files:
            raw = gzip.open(tmp_path / str(k) / f.file).read()
            assert raw.count(b"WARC/1.1\r\n") == f.records + 1
    assert names[0] == names[1] and len(names[0]) > 4 and sum(n[2] for n in names[0]) == 64


def test_repeated_rows(spark):
    rows = [(1, "http://a", "same"), (1, "http://a", "same"), (2, "http://b", "other"), (0, "http://c", "same")]
    got = sorted(map(tuple, W.archive_round_trip(pages_of(spark, rows)).collect()), key=str)
    assert [(g[0], g[3], g[4]) for g in got] == [(0, "revisit", 1), (1, "response", None), (1, "revisit", 1), (2, "response", None)]


def test_empty_table(spark):
    assert W.archive_round_trip(pages_of(spark, [])).count() == 0


def test_a_file_without_its_last_records_is_noticed(spark, tmp_path):
    """Whole members are missing, so nothing but the manifest tells."""
    folder = f"file://{tmp_path}/x"
    manifest = W.write_archives(pages_of(spark, rows_of()), folder, shards=1)
    path = tmp_path / "x" / manifest.first().file
    whole = path.read_bytes()
    path.write_bytes(b"".join(W.member(m) for m in list(W.members(io.BytesIO(whole)))[:-2]))
    with pytest.raises(Exception, match="manifest"):
        W.read_archives(manifest, folder).collect()
    path.write_bytes(whole)
    assert W.read_archives(manifest, folder).count() == 64
    W.delete_archives(folder)
    assert not path.exists()


def test_clashing_columns(spark):
    pages = with_clashes(pages_of(spark, rows_of()))
    for name in ("digest", "size", "target", "n", "file", "bytes", "records", "sha256"):
        pages = pages.withColumn(name, pages["doc"])
    assert sorted(map(tuple, W.archive_round_trip(pages).collect())) == want(rows_of())


def test_damage_is_noticed(spark, tmp_path):
    folder = f"file://{tmp_path}/x"
    manifest = W.write_archives(pages_of(spark, rows_of()), folder, shards=1)
    name = manifest.first().file
    raw = gzip.decompress((tmp_path / "x" / name).read_bytes()).replace(b"<html>3", b"<html>4", 1)
    parts = raw.split(b"\r\n\r\nWARC/1.1")
    (tmp_path / "x" / name).write_bytes(b"".join(W.member((b"WARC/1.1" if i else b"") + p + (b"\r\n\r\n" if i < len(parts) - 1 else b"")) for i, p in enumerate(parts)))
    with pytest.raises(Exception, match="digest"):
        W.read_archives(manifest, folder).collect()

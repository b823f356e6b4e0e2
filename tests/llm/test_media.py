import hashlib
import math
import zipfile
import zlib
from collections import Counter

import pytest

from siltstone.llm import media
from siltstone.llm.common import Scratch


def brute(text):
    raw = (text or "").encode()
    payload = raw + b"\0" * ((64 - len(raw) % 64) % 64 if raw else 64)
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])


def test_all_documents(spark, sf):
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = media.op2_media(spark, sf).collect()
    assert {r[0]: tuple(r[1:5]) for r in got} == {d: brute(t) for d, t in docs.items()} and len(got) == len(docs)
    same = {}
    for r in got:
        assert same.setdefault(docs[r[0]], tuple(r[5:])) == tuple(r[5:])


def test_odd_rows_and_ranges(spark):
    rows = [(1, None), (2, ""), (3, "x" * 64), (3, "x" * 64), (None, "y\0"), (4, "ü" * 100_000), (5, "\0" * 65)]
    scratch = Scratch(spark, "media-test")
    folder = scratch.path("a")
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, member string").repartition(2)
    told = media.write_media(docs, folder, archive_bytes=300).collect()
    assert sum(r[1] for r in told) == len(rows)
    back = media.read_media(spark, folder, rangeBytes=200, batchBytes=64)
    assert back.select("archive", "offset").distinct().count() == len(rows)
    got = media.described(back).collect()
    assert sorted((r[0] or 0, r[1], bytes(r[2])) for r in got) == sorted((d or 0, len((t or "").encode()), media.padded((t or "").encode())) for d, t in rows)


def test_empty_table(spark):
    folder = Scratch(spark, "media-test").path("none")
    assert media.write_media(spark.createDataFrame([], "doc_id long, text string"), folder).collect() == []
    assert media.read_media(spark, folder).count() == 0


def test_media_and_features_by_other_means(spark, sf):
    """The stored form as zlib and struct give it, read as another PNG reader would, and features by plain counting."""
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for r in media.op2_media(spark, sf).collect():
        payload = media.padded((docs[r["doc_id"]] or "").encode())
        lines = b"".join(b"\0" + payload[k : k + 64] for k in range(0, len(payload), 64))
        chunk = lambda kind, data: len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")
        head = (64).to_bytes(4, "big") + (len(payload) // 64).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
        png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"tEXt", f"Bytes\0{r['n_bytes']}".encode("latin-1")) + chunk(b"IDAT", zlib.compress(lines, 6)) + chunk(b"IEND", b"")
        assert (r["media_bytes"], r["media_sha256"]) == (len(png), hashlib.sha256(png).hexdigest())
        n, mean = len(payload), sum(payload) / len(payload)
        deviation = math.sqrt(sum((b - mean) ** 2 for b in payload) / n)
        entropy = -sum(c / n * math.log2(c / n) for c in Counter(payload).values())
        got = r["feature"].split(";")
        assert all(abs(float(x) - y) < 1e-4 for x, y in zip(got, (mean, deviation, entropy)))
        assert all(abs(int(x) - 255 * sum(b // 32 == k for b in payload) / n) <= 0.5 + 1e-9 for k, x in enumerate(got[3].split(",")))


def test_archives_of_an_earlier_run_are_not_read(spark):
    folder = Scratch(spark, "media-test").path("twice")
    many = spark.createDataFrame([(k, f"t{k}") for k in range(40)], "doc_id long, text string").repartition(4)
    for docs in (many, many.where("doc_id < 3").coalesce(1)):
        media.write_media(docs, folder, archive_bytes=500)
    assert sorted(r[0] for r in media.described(media.read_media(spark, folder)).collect()) == [0, 1, 2]


def archive(tmp_path):
    with zipfile.ZipFile(tmp_path / "media-0.zip", "w") as z:
        for k in range(5):
            z.writestr(f"{k}/{k}.png", media.to_png(media.padded(b"%d" % k), 1))
    reader = media.MediaReader({"path": str(tmp_path), "rangebytes": "150"})
    return reader, reader.partitions()


def test_members_belong_to_one_range_each(tmp_path):
    reader, ranges = archive(tmp_path)
    found = [m for r in ranges for b in reader.read(r) for m in b.column(1).to_pylist()]
    assert len(ranges) > 3 and sorted(found) == [f"{k}/{k}.png" for k in range(5)]


def test_a_member_is_tried_again_on_its_own(tmp_path, monkeypatch):
    reader, ranges = archive(tmp_path)
    calls, real = [], media.member_at

    def shaky(handle, member):
        calls.append(member.header_offset)
        if calls.count(member.header_offset) == 1 and member.filename.startswith("2"):
            raise OSError("gone")
        return real(handle, member)

    monkeypatch.setattr(media, "member_at", shaky)
    assert sum(b.num_rows for r in ranges for b in reader.read(r)) == 5
    assert len(calls) == 6 and max(map(calls.count, calls)) == 2


def test_a_damaged_member_is_an_error(tmp_path):
    reader, ranges = archive(tmp_path)
    raw = bytearray((tmp_path / "media-0.zip").read_bytes())
    raw[raw.index(b"IDAT") + 6] ^= 1
    (tmp_path / "media-0.zip").write_bytes(raw)
    reader.retries = 1
    with pytest.raises(OSError, match="can't be read"):
        [b for r in ranges for b in reader.read(r)]
    with pytest.raises(ValueError):
        media.from_png(b"\x89PNG\r\n\x1a\n")

import base64
import gzip
import hashlib
import io

import pytest
from pyarrow import fs

from siltstone.llm import warc
from siltstone.llm.common import Scratch
from siltstone.llm.stores import open_store


def brute(rows):
    payload = [(p, (h or "").encode()) for p, _, h in rows]
    last = {}
    for p, h in payload:
        if p is not None:
            last[h] = max(p, last.get(h, p))
    out = []
    for p, h in payload:
        other = p is not None and last[h] != p
        out.append((p, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "revisit" if other else "response", last[h] if other else None))
    return sorted(out, key=str)


def write(spark, rows, **k):
    scratch = Scratch(spark, "warc-test")
    folder = scratch.path("archives")
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    return folder, warc.write_warc(pages, folder, scratch, **k)


def test_all_pages(spark, sf):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, warc.op5_warc(spark, sf).collect()), key=str) == brute(pages)


ROWS = [(1, "http://a/", "same"), (2, "http://b/", "same"), (9, "http://c/x y", "same"), (3, None, None), (4, "u", ""), (5, "http://d/é", "ünï\r\n\r\nx"), (None, "n", "same"), (9, "http://c/x y", "same"), (6, "big", "z" * 300_000), (7, "v", "\r\n")]


def test_odd_rows(spark):
    folder, manifest = write(spark, ROWS, shard_bytes=2000, roll_bytes=500)
    back = warc.read_warc(spark, folder)
    assert sorted(map(tuple, back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == brute(ROWS)
    assert {r[0] for r in back.where("record_type = 'response' and page_id = 5").select("payload").collect()} == {"ünï\r\n\r\nx".encode()}
    assert manifest.count() > 3 and back.where("url = 'http://c/x%20y'").count() == 2


def test_a_second_run_writes_the_same_files(spark):
    found = []
    for _ in range(2):
        folder, manifest = write(spark, ROWS, shard_bytes=2000, roll_bytes=500)
        store, path = open_store(folder)
        files = {f.base_name: f.path for f in store.get_file_info(fs.FileSelector(path))}
        assert not any(n.startswith("_temporary") for n in files)
        found.append({n: store.open_input_stream(p, compression=None).read() for n, p in files.items()})
        assert sorted(r["file"] for r in manifest.collect()) == sorted(n for n in files if n.endswith(".gz"))
        assert all(hashlib.sha256(found[-1][r["file"]]).hexdigest() == r["sha256"] for r in manifest.collect())
    assert found[0] == found[1]


def test_files_are_plain_gzip_in_order(spark):
    folder, manifest = write(spark, ROWS)
    store, path = open_store(folder)
    name = manifest.first()["file"]
    text = gzip.decompress(store.open_input_stream(f"{path}/{name}", compression=None).read())
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and text.count(b"WARC/1.1\r\n") == len(ROWS) + 1
    ids = [int(x.split(b"\r\n")[0]) for x in text.split(b"\r\nX-Page-Id: ")[1:]]
    assert ids == sorted(ids)


def test_no_pages(spark):
    folder, manifest = write(spark, [])
    assert manifest.count() == 0 and warc.read_warc(spark, folder).count() == 0


def test_damage_is_an_error(spark):
    with pytest.raises(ValueError):
        warc.parse(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n")
    folder, manifest = write(spark, ROWS)
    store, path = open_store(folder)
    name = f"{path}/{manifest.first()['file']}"
    raw = store.open_input_stream(name, compression=None).read()
    with store.open_output_stream(name, compression=None) as f:
        f.write(raw[:-40])
    with pytest.raises(Exception, match="ends within|not the file"):
        warc.read_warc(spark, folder).count()


def payload(n, kind="x"):
    return "".join(f"{kind}{k * 7919 % 9973}" for k in range(n // 5))


def test_rows_without_an_id_and_repeated_ids_are_spread(spark):
    """Ids that hold most rows fill several shards, and each record is still written once."""
    rows = [(None, f"http://n{k}/", payload(400, f"n{k % 30}")) for k in range(150)] + [(7, f"http://seven/{k}", payload(400, "s")) for k in range(150)] + [(k, "u", payload(300, f"k{k}")) for k in range(10, 60)]
    folder, manifest = write(spark, rows, shard_bytes=20_000, roll_bytes=1 << 30)
    back = warc.read_warc(spark, folder)
    assert sorted(map(tuple, back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == brute(rows)
    per = [r["records"] for r in manifest.collect()]
    assert len(per) > 8 and max(per) < 60
    assert back.where("page_id = 7").select("file").distinct().count() > 3 and back.where("page_id is null").select("file").distinct().count() > 3


def test_large_ids_beside_nulls(spark):
    rows = [(2**62 + k, "u", payload(300, f"z{k}")) for k in range(60)] + [(None, "u", "x")]
    folder, _ = write(spark, rows, shard_bytes=3000)
    assert sorted((r[0] for r in warc.read_warc(spark, folder).select("page_id").collect()), key=str) == sorted((r[0] for r in rows), key=str)


def test_blanks_in_urls(spark):
    assert b"WARC-Target-URI: a%20b%E2%80%A8c%0Ad\r\n" in warc.page_record(1, "a b\u2028c\nd", b"", None, "d")


def test_many_small_members_are_read_in_linear_time():
    raw = b"".join(gzip.compress(b"%d" % k, mtime=0) for k in range(60_000))
    for step in (1 << 20, 1 << 24):
        assert [int(x) for x in warc.members(io.BytesIO(raw), step)] == list(range(60_000))
    held = []
    assert len(list(warc.members(io.BytesIO(raw), 1000, held.append))) == 60_000 and b"".join(held) == raw


def test_a_file_that_is_not_the_committed_one(spark):
    folder, manifest = write(spark, ROWS)
    store, path = open_store(folder)
    name = f"{path}/{manifest.first()['file']}"
    raw = store.open_input_stream(name, compression=None).read()
    with store.open_output_stream(name, compression=None) as f:  # whole members, but others
        f.write(b"".join(gzip.compress(gzip.decompress(raw), 1, mtime=0) for _ in range(1)))
    with pytest.raises(Exception, match="not the file|not a whole record"):
        warc.read_warc(spark, folder).count()


def test_a_second_run_into_a_folder_takes_its_place(spark):
    scratch = Scratch(spark, "warc-twice")
    folder = scratch.path("archives")
    for rows in (ROWS, ROWS[:3]):
        warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), folder, scratch, shard_bytes=2000)
    assert warc.read_warc(spark, folder).count() == 3
    with open_store(folder)[0].open_output_stream(f"{open_store(folder)[1]}/_temporary-x", compression=None) as f:
        f.write(b"left by a writer that died")
    assert warc.read_warc(spark, folder).count() == 3

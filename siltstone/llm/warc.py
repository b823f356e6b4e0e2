"""A deterministic, sharded WARC writer and its reader.

Decisions first: payload digests alone (no payload) are grouped; of equal
payloads the record with the largest id is the response and the others become
revisit records that refer to it.

Then payloads and decisions are range-sorted together by id and digest, in one
shuffle of the payloads.  The ranges are cut from the distinct (id, digest) with
the least hashes, weighted by their bytes: a sample of bounded size that does not
depend on how the input is split, so that a second run writes the same files.
Rows without an id are spread by their digests, and an (id, digest) that fills
several shards by itself is dealt over these.  Each shard is written as gzip
members, with headers and digests made anew, and rolled to a new file once the
compressed size passes ``roll_bytes``.  Files are written under temporary names
and renamed; a shard's manifest, renamed last, commits it.

A task streams its shard, so that its memory does not depend on the shard's size.
There are at most MOST_SHARDS shards of a run, as each is a task of one shuffle:
beyond MOST_SHARDS * shard_bytes (1.6 TB) shards grow in proportion.

A task that is run again writes the same bytes to the same names.  A run begins by
taking away the manifests that the folder holds, so that files of an earlier run
are not read.  ``read_warc`` needs the folder alone: it reads the manifests that
were committed, and checks each file's SHA-256 and each record's digests.

Defined cases: a null payload is empty; a null URL is ``urn:x-none``, and blanks of
any kind in one are percent-encoded; empty payloads count as equal to one another;
records that repeat id and payload of a response are responses too; a null id is a
response that no revisit refers to; an empty table writes no files and gives no
rows; a very long payload is one record, held in memory by one task.  Other columns
are not read, whatever their names.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from .common import Scratch, prepare, small, table
from .stores import committed, open_store

# Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "urn:x-siltstone:warc")


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id}:{digest}')}>"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in [*headers, ("Content-Length", str(len(block)))])]
    return b"\r\n".join([*lines, b"", block, b"", b""])


def page_record(page_id: int | None, url: str | None, payload: bytes, keeper: int | None, date: str) -> bytes:
    """The record of a page: a response, or a revisit of ``keeper`` (whose payload is equal)."""
    digest = digest32(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if keeper is not None else http + payload
    headers = [
        ("WARC-Type", "response" if keeper is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", re.sub(r"\s", lambda m: quote(m[0], safe=""), url) if url else "urn:x-none"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{digest32(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    if keeper is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(keeper, digest)), ("X-Refers-To-Page-Id", str(keeper))]
    return _record(headers, block)


def file_head(name: str, date: str) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    return _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_NAMES, name)}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], block)


def decide(meta: DataFrame, scratch: Scratch, min_bytes: int = 0) -> DataFrame:
    """page_id, digest, keeper: null for a response, else the response's id; ``meta`` has page_id, digest, size."""
    keepers = scratch.save(meta.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("last")), "keepers")
    # Both sides come from files, so that a digest with very many rows is split at run time.
    return meta.join(keepers, "digest", "left").select("page_id", "digest", F.when(F.col("page_id") < F.col("last"), F.col("last")).alias("keeper"))


#: Most shards of one run, and how many sampled keys set a cut.
MOST_SHARDS, SAMPLE = 100_000, 20
#: What stands for a null id in the order of records.
NO_ID = -(2**63)


def cuts(meta: DataFrame, shard_bytes: int) -> tuple[np.ndarray, list[str]]:
    """Ids and digests at which shards begin, but for the first; the same for the same rows.

    A key that fills several shards stands there as often as shards begin in it.
    """
    keys = meta.groupBy(F.coalesce("page_id", F.lit(NO_ID)).alias("id"), "digest").agg((F.sum("size") + F.count("*") * 600).alias("size"))
    total, n_keys = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    n = min(MOST_SHARDS, max(1, -(-int(total) // shard_bytes)))
    if n == 1:
        return np.zeros(0, np.int64), []
    # Hashes are even over 64 bits: about n * SAMPLE keys are below this one.  Keys that fill a fifth of a shard are
    # all taken as they are, at most 5 n of them; a sampled key stands for those that were not.
    share = min(1.0, n * SAMPLE / n_keys)
    below = min(2**63 - 1, int(-(2**63) + 2**64 * share))
    large = F.col("size") * 5 >= F.lit(total / n)
    picked = keys.where(large | (F.xxhash64("id", "digest") <= below)).select("id", "digest", F.when(large, F.col("size").cast("double")).otherwise(F.col("size") / F.lit(share)).alias("size")).toPandas()
    picked = picked.sort_values(["id", "digest"])
    reach = np.cumsum(picked["size"].to_numpy())
    at = np.searchsorted(reach, reach[-1] * np.arange(1, n) / n)
    return picked["id"].to_numpy(np.int64)[at], picked["digest"].iloc[at].tolist()


def _shards(ids: np.ndarray, digests: list[str], begins: tuple[np.ndarray, list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last shard of each (id, digest); they differ for keys that several shards begin in."""
    cut_ids, cut_digests = begins
    low, high = np.searchsorted(cut_ids, ids, "left"), np.searchsorted(cut_ids, ids, "right")
    first, last = high.copy(), high.copy()
    for k in np.flatnonzero(low < high).tolist():  # the id is that of a cut
        a = bisect.bisect_left(cut_digests, digests[k], int(low[k]), int(high[k]))
        b = bisect.bisect_right(cut_digests, digests[k], int(low[k]), int(high[k]))
        first[k], last[k] = min(a + 1, b), b
    return first.astype(np.int32), last.astype(np.int32)


def write_warc(pages: DataFrame, folder: str, scratch: Scratch, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", shard_bytes: int = 16 << 20, roll_bytes: int = 64 << 20, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes all pages to ``folder``; the manifest has a row for each file: shard, file, bytes, records, sha256."""
    payload = F.coalesce(F.col(payload_col).cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    meta = scratch.save(rows.select("page_id", "digest", F.length("payload").cast("long").alias("size")), "meta")
    begins = cuts(meta, shard_bytes)
    _begin(pages.sparkSession, folder)

    @F.pandas_udf("first int, last int")
    def shards_of(ids: pd.Series, digests: pd.Series) -> pd.DataFrame:
        first, last = _shards(ids.to_numpy(np.int64), digests.tolist(), begins)
        return pd.DataFrame({"first": first, "last": last})

    at = shards_of(F.coalesce("page_id", F.lit(NO_ID)), "digest")  # ids without nulls, which pandas would make floats
    said = decide(meta, scratch, min_bytes).distinct().withColumn("at", at)
    said = said.select("page_id", "digest", F.lit(0).alias("kind"), "keeper", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), F.explode(F.sequence("at.first", "at.last")).alias("shard"))
    # Rows of one key that fill several shards go by URL and by their place in the table.
    spread = F.col("at.first") + F.pmod(F.xxhash64("url", F.monotonically_increasing_id()), F.col("at.last") - F.col("at.first") + 1).cast("int")
    carried = rows.withColumn("at", at).select("page_id", "digest", F.lit(1), F.lit(None).cast("long"), "url", "payload", spread)
    both = said.union(carried)
    ranged = both.repartitionById(len(begins[1]) + 1, "shard").sortWithinPartitions("page_id", "digest", "kind", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        store.create_dir(path, recursive=True)
        # Decisions sort just before the payloads that they are about.
        keeper, about = None, None

        def records() -> Iterator[tuple[int, bytes]]:
            nonlocal keeper, about
            for batch in small(batches):
                cols = [batch.column(n).to_pylist() for n in ("page_id", "digest", "kind", "keeper", "url", "shard")]
                payloads = batch.column("payload")
                for k, (page, digest, kind, told, url, shard) in enumerate(zip(*cols)):
                    if kind == 0:
                        keeper, about = told, (page, digest)
                        continue
                    if about != (page, digest):
                        raise ValueError(f"no decision for page {page}")
                    yield shard, page_record(page, url, payloads[k].as_py(), keeper, date)

        files: list[tuple] = []
        source = records()
        row = next(source, None)
        while row is not None:
            shard, n = row[0], 0
            own = []
            while row is not None and row[0] == shard:
                name = f"shard-{shard:06d}-{n:05d}.warc.gz"
                with committed(store, path, name) as out:
                    size, count, check = 0, 0, hashlib.sha256()
                    data = gzip.compress(file_head(name, date), 6, mtime=0)
                    while True:
                        out.write(data)
                        check.update(data)
                        size += len(data)
                        if row is None or row[0] != shard or size >= roll_bytes:
                            break
                        data = gzip.compress(row[1], 6, mtime=0)
                        count += 1
                        row = next(source, None)
                own.append((shard, name, size, count, check.hexdigest()))
                n += 1
            with committed(store, path, f"shard-{shard:06d}{MANIFEST}") as out:
                out.write("".join(json.dumps(dict(zip(_FILE, f))) + "\n" for f in own).encode())
            files += own
        if files:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*files), (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()))], names=list(_FILE))

    return scratch.save(ranged.mapInArrow(run, "shard int, file string, bytes long, records long, sha256 string"), "manifest")


_FILE = ("shard", "file", "bytes", "records", "sha256")
MANIFEST = ".manifest.json"


def _begin(spark: SparkSession, folder: str) -> None:
    """Makes the folder, and takes away what an earlier run committed there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    for f in files.listStatus(path):
        if f.getPath().getName().endswith(MANIFEST):
            files.delete(f.getPath(), False)


def committed_files(spark: SparkSession, folder: str) -> DataFrame:
    """shard, file, bytes, records, sha256 of the files that the manifests in ``folder`` name."""
    prepare(spark)
    return spark.read.schema("shard int, file string, bytes long, records long, sha256 string").option("pathGlobFilter", f"*{MANIFEST}").json(folder)


#: Compressed bytes that are unpacked at once; what follows a member in them is copied.
SLICE = 1 << 14


def members(stream, step: int = 1 << 20, seen: Callable[[bytes], None] = lambda _: None) -> Iterator[bytes]:
    """The gzip members of a file, unpacked one after the other, in time that is linear in its bytes; ``seen`` gets all that is read."""
    held, at = memoryview(b""), 0

    def more() -> bool:
        nonlocal held, at
        if at == len(held):
            block = stream.read(step)
            seen(block)
            held, at = memoryview(block), 0
        return at < len(held)

    while more():
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if not more():
                raise ValueError("the file ends within a member")
            part = held[at : at + SLICE]
            parts.append(unpack.decompress(part))
            at += len(part) - len(unpack.unused_data)
        yield b"".join(parts)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block; a record of another size than it says is an error."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(headers["content-length"])
    if lines[0] != VERSION.decode() or len(rest) != n + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("not a whole record")
    return headers, rest[:n]


def read_warc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The pages' records in the files that the folder's manifests name, all digests verified.

    page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload (null for revisits), file.
    """
    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("file", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        for batch in small(batches):
            for name, expected, sha256 in zip(*(batch.column(k).to_pylist() for k in range(3))):
                rows, held, n, check = [], 0, 0, hashlib.sha256()
                with store.open_input_stream(f"{path}/{name}", compression=None) as f:
                    for raw in members(f, seen=check.update):
                        headers, block = parse(raw)
                        if headers["warc-type"] == "warcinfo":
                            continue
                        rows.append(one(headers, block, name))
                        n += 1
                        held += len(raw)
                        if held > 4 << 20 or len(rows) >= 5000:
                            yield out(rows)
                            rows, held = [], 0
                if n != expected or check.hexdigest() != sha256:
                    raise ValueError(f"{name} is not the file that its manifest names: {n} records of {expected}")
                if rows:
                    yield out(rows)

    def one(headers: dict[str, str], block: bytes, name: str) -> tuple:
        http, _, payload = block.partition(b"\r\n\r\n")
        said = headers["warc-payload-digest"].removeprefix("sha1:")
        size = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
        response = headers["warc-type"] == "response"
        if "sha1:" + digest32(block) != headers["warc-block-digest"] or response and (digest32(payload) != said or len(payload) != size):
            raise ValueError(f"{headers['warc-record-id']} is damaged")
        number = lambda k: int(headers[k]) if k in headers else None
        return number("x-page-id"), headers["warc-target-uri"], headers["warc-type"], size, said, number("x-refers-to-page-id"), payload if response and payloads else None, name

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), kinds)], schema=kinds)

    # One row for each file; files are dealt out evenly.
    files = committed_files(spark, folder).select("file", "records", "sha256").repartition(max(1, spark.sparkContext.defaultParallelism * 2))
    return files.mapInArrow(run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, file string")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives and read back."""
    scratch = Scratch(spark, "warc")
    folder = scratch.path("archives")
    write_warc(table(spark, sf_dir, "pages"), folder, scratch)
    return read_warc(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

"""Media columns: payloads as losslessly compressed images in archives, and a
Spark data source that reads such archives back.

Writing.  A payload of bytes, padded by zeros to a positive multiple of 64, is
stored as the samples of an 8-bit grey PNG of width 64.  Each scan partition
writes ZIP archives (members are stored as they are) of a bounded size, under a
temporary name that is replaced at the end; nothing is shuffled.  The table of the
archives, with their members, is written last into the folder (``manifest``): what
an earlier run left there is not read, and an archive that does not hold as many
members as it says is an error.

Reading.  The data source ``media_archive`` lists a folder's archives and plans
byte-range partitions over them; a member belongs to the range that holds its
header's offset.  A task looks its members up in the archive's directory, reads
each at its offset, and streams them as Arrow batches of a bounded number of
bytes.  A member that can't be read, or whose checksum differs, is tried again
on a new handle at its own offset, without the others; after ``retries`` times
the task fails, so that no member is silently lost.

Defined cases: a null text is empty, and an empty one becomes 64 zeros; equal
texts are stored as equal bytes; repeated rows become members of their own; a
null id stays null; a very long text is one member, held in memory by one task; an
empty table gives no archives and no rows.  Other
columns are not read, whatever their names.
"""

from __future__ import annotations

import io
import struct
import time
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyarrow import fs, parquet
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import Scratch, encoded, prepare, small, table
from .stores import committed, open_store

WIDTH = 64
# Fixed values of the PNG format.
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(payload: bytes) -> bytes:
    """With zeros up to a positive multiple of the image's width."""
    return payload.ljust(max(1, -(-len(payload) // WIDTH)) * WIDTH, b"\0")


def to_png(payload: bytes, n_bytes: int, level: int = 6) -> bytes:
    """``payload`` as 8-bit grey samples; a text chunk keeps the unpadded size."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    height = len(payload) // WIDTH
    rows = np.zeros((height, WIDTH + 1), np.uint8)  # each row begins with filter type 0
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)
    return b"".join([_SIGNATURE, chunk(b"IHDR", head), chunk(b"tEXt", b"Bytes\0%d" % n_bytes), chunk(b"IDAT", zlib.compress(rows.tobytes(), level)), chunk(b"IEND", b"")])


def from_png(media: bytes) -> tuple[bytes, int]:
    """The samples of such an image and the unpadded size; a damaged one is an error."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not an image")
    at, data, size, shape = 8, [], None, None
    while at < len(media):
        (n,) = struct.unpack(">I", media[at : at + 4])
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.pack(">I", zlib.crc32(kind + body)) != media[at + 8 + n : at + 12 + n]:
            raise ValueError("a damaged chunk")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", body)
        elif kind == b"tEXt" and body.startswith(b"Bytes\0"):
            size = int(body[6:])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if shape is None or shape[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit grey image")
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[1], shape[0] + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    samples = rows[:, 1:].tobytes()
    return samples, len(samples) if size is None else size


def write_media(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", archive_bytes: int = 64 << 20) -> DataFrame:
    """Writes archives and their manifest to ``folder``; the manifest has a row for each: archive, members, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        store.create_dir(path, recursive=True)
        rows = ((i, t) for b in small(batches) for i, t in zip(b.column(0).to_pylist(), encoded(b.column(1))))
        part, told, row = TaskContext.get().partitionId(), [], next(rows, None)
        while row is not None:
            name, held = f"media-{part:06d}-{len(told):06d}.zip", 0
            with committed(store, path, name) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
                members = 0
                while row is not None and held < archive_bytes:
                    doc, text = row
                    media = to_png(padded(text), len(text))
                    archive.writestr(zipfile.ZipInfo(f"{members:09d}/{'' if doc is None else doc}.png"), media)
                    held, members = held + len(media), members + 1
                    row = next(rows, None)
            told.append((name, members, held))
        if told:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*told)], names=["archive", "members", "bytes"])

    prepare(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    kinds = "archive string, members long, bytes long"
    narrow.mapInArrow(run, kinds).write.mode("overwrite").parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(kinds).parquet(f"{folder}/manifest")


class ByteRange(InputPartition):
    def __init__(self, archive: str, first: int, past: int, members: int | None = None):
        self.archive, self.first, self.past, self.members = archive, first, past, members


class MediaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangebytes", 32 << 20))
        self.batch_bytes = int(options.get("batchbytes", 4 << 20))
        self.retries = int(options.get("retries", 3))

    def partitions(self) -> list[ByteRange]:
        store, path = open_store(self.folder)
        files = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
        told = self._manifest(store, path)
        found = sorted((f.path, f.size, f.base_name) for f in files if f.base_name.endswith(".zip") and not f.base_name.startswith("_"))
        if told is not None:
            if gone := sorted(set(told) - {name for *_, name in found}):
                raise OSError(f"{self.folder} has no {gone[0]}, which its manifest names")
            found = [f for f in found if f[2] in told]
        # Without archives one empty range: Spark asks for a partition at least.
        return [ByteRange(p, a, min(a + self.range_bytes, n), told and told[name]) for p, n, name in found for a in range(0, n, self.range_bytes)] or [ByteRange("", 0, 0)]

    @staticmethod
    def _manifest(store: fs.FileSystem, path: str) -> dict[str, int] | None:
        """Members of each archive; None for a folder of archives without a manifest."""
        at = f"{path}/manifest"
        if store.get_file_info(at).type != fs.FileType.Directory:
            return None
        parts = [f.path for f in store.get_file_info(fs.FileSelector(at)) if f.base_name.endswith(".parquet")]
        tables = [parquet.read_table(p, filesystem=store) for p in parts]
        return {name: n for t in tables for name, n in zip(t["archive"].to_pylist(), t["members"].to_pylist())}

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        store, _ = open_store(self.folder)
        with store.open_input_file(partition.archive) as f, zipfile.ZipFile(f) as archive:
            if partition.members not in (None, len(archive.infolist())):
                raise ValueError(f"{partition.archive} has {len(archive.infolist())} members, its manifest {partition.members}")
            own = [x for x in archive.infolist() if partition.first <= x.header_offset < partition.past]
            rows, held = [], 0
            for member in own:
                data = self._member(store, partition.archive, f, member)
                rows.append((partition.archive.rpartition("/")[2], member.filename, member.header_offset, data))
                held += len(data)
                if held >= self.batch_bytes:
                    yield self._batch(rows)
                    rows, held = [], 0
            if rows:
                yield self._batch(rows)

    def _member(self, store: fs.FileSystem, archive: str, handle, member: zipfile.ZipInfo) -> bytes:
        for attempt in range(self.retries + 1):
            try:
                if attempt:
                    time.sleep(0.1 * 2**attempt)
                    with store.open_input_file(archive) as again:
                        return member_at(again, member)
                return member_at(handle, member)
            except (OSError, ValueError) as failed:
                last = failed
        raise OSError(f"{archive}: the member at {member.header_offset} can't be read") from last

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["archive", "member", "offset", "media"])


def member_at(handle: io.IOBase, member: zipfile.ZipInfo) -> bytes:
    """A stored member's bytes, from its header's offset on."""
    handle.seek(member.header_offset)
    head = handle.read(30)
    if len(head) < 30 or head[:4] != b"PK\x03\x04":
        raise ValueError("no member begins there")
    skip = sum(struct.unpack("<HH", head[26:30]))
    handle.seek(member.header_offset + 30 + skip)
    data = handle.read(member.file_size)
    if len(data) != member.file_size or zlib.crc32(data) != member.CRC:
        raise ValueError("the member is damaged")
    return data


class MediaArchive(DataSource):
    """``spark.read.format("media_archive").load(folder)``: archive, member, offset, media.

    Options: rangeBytes (32 MB), batchBytes (4 MB), retries (3).
    """

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "archive string, member string, offset long, media binary"

    def reader(self, schema) -> MediaReader:
        return MediaReader({k.lower(): v for k, v in dict(self.options).items()})


def read_media(spark: SparkSession, folder: str, **options) -> DataFrame:
    prepare(spark)
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(**options).load(folder)


def described(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload and a feature string of each image that ``read_media`` gave, with its media."""
    kinds = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload", pa.binary()), ("feature", pa.string()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = []
            for name, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                payload, size = from_png(media)
                doc = name.rpartition("/")[2].removesuffix(".png")
                rows.append((int(doc) if doc else None, size, payload, feature(payload), media))
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k.type) for k in kinds], schema=kinds)

    return media.select("member", "media").mapInArrow(run, "doc_id long, n_bytes long, payload binary, feature string, media binary")


def feature(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and the shares of 8 ranges in 255ths."""
    count = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    share = count / count.sum()
    mean = float(share @ np.arange(256))
    deviation = float(np.sqrt(max(0.0, share @ (np.arange(256) - mean) ** 2)))
    some = share[share > 0]
    bands = (share.reshape(8, 32).sum(1) * 255).round().astype(int)
    return f"{mean:.4f};{deviation:.4f};{abs(float(some @ np.log2(some))):.4f};{','.join(map(str, bands))}"


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as images and read back through the data source."""
    scratch = Scratch(spark, "media")
    folder = scratch.path("archives")
    write_media(table(spark, sf_dir, "documents"), folder)
    out = described(read_media(spark, folder))
    tail = F.substring("payload", -WIDTH, WIDTH)
    return out.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )

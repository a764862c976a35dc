"""Deterministic sharded WARC writer and reader.

Rows are dealt to shards by ranges of their id, cut at multiples of a number of
bytes in the sorted order of all rows, and sorted; a task writes its shards one after another, rolling
to the next file by compressed size. Headers and digests are regenerated from
the payload. Files are written under temporary names that are unique to the
attempt; the manifest names those of the attempts that succeeded, and a second
job moves them to their final names, so that a lost executor or a repeated
task leaves no trace. The same rows give the same bytes in the same files.

Of records with equal payloads of at least ``min_revisit`` bytes, that with
the largest id is a response record, the others are revisit records that refer
to it. Defined results: a null payload is empty; repeated rows are a record
each, and all of those that share the largest id are responses; a null id is a
response that nothing refers to; a null url is ``urn:none``; an empty table
gives an empty manifest and no file. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.runtime import drop, drop_path, materialize, parallelism

#: Payload bytes of one id range, and compressed bytes at which a file is closed.
RANGE_BYTES, ROLL_BYTES = 64 << 20, 16 << 20
#: Tasks that write at most; each has whole shards.
TASKS = 100_000
CAPTURED = "2000-01-01T00:00:00Z"
MANIFEST = "shard int, seq int, name string, temporary string, records long, bytes long, sha256 string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI; any that Arrow knows (file, hdfs, s3, gs)."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:/") else "file://" + uri[5:])


def _b32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def _record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def _header(fields: list[tuple[str, object]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def _clean(url: str | None) -> str:
    return "".join(c if c > " " else "%20" for c in url) if url else "urn:none"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None) -> bytes:
    """One uncompressed record."""
    digest = hashlib.sha1(payload).digest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields: list[tuple[str, object]] = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _record_id("page", page_id, _clean(url), digest.hex())),
        ("WARC-Date", CAPTURED),
        ("WARC-Target-URI", _clean(url)),
        ("WARC-Payload-Digest", _b32(digest)),
        ("WARC-Block-Digest", _b32(hashlib.sha1(block).digest())),
        ("X-Page-Id", "" if page_id is None else page_id),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is not None:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", _record_id("page", refers_to, _clean(refers_url), digest.hex())),
            ("WARC-Refers-To-Target-URI", _clean(refers_url)),
            ("WARC-Refers-To-Date", CAPTURED),
            ("X-Refers-To-Page-Id", refers_to),
        ]
    return _header([*fields, ("Content-Length", len(block))]) + block + b"\r\n\r\n"


def _member(raw: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


class _Shard:
    """The files of one id range."""

    def __init__(self, fs: pafs.FileSystem, folder: str, shard: int, attempt: str, roll: int):
        self.fs, self.folder, self.shard, self.attempt, self.roll = fs, folder, shard, attempt, roll
        self.seq, self.out, self.done = 0, None, []

    def _open(self) -> None:
        self.name = f"part-{self.shard:06d}-{self.seq:05d}.warc.gz"
        self.temporary = f"{self.name}.{self.attempt}"
        self.out = self.fs.open_output_stream(posixpath.join(self.folder, "_temporary", self.temporary), compression=None)
        self.size, self.records, self.sha = 0, 0, hashlib.sha256()
        info = b"software: lodestone\r\nformat: WARC File Format 1.1\r\n"
        self._write(_header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id("info", self.name)), ("WARC-Date", CAPTURED), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields"), ("Content-Length", len(info))]) + info + b"\r\n\r\n")

    def _write(self, raw: bytes) -> None:
        z = _member(raw)
        self.out.write(z)
        self.sha.update(z)
        self.size += len(z)

    def add(self, raw: bytes) -> None:
        if self.out is None:
            self._open()
        self._write(raw)
        self.records += 1
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.shard, self.seq, self.name, self.temporary, self.records, self.size, self.sha.hexdigest()))
            self.seq, self.out = self.seq + 1, None


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_MANIFEST_ARROW = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("name", pa.string()), ("temporary", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])
_RECORD_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _writer(root: str, roll: int):
    """Rows come sorted by shard, id, kind: what an id refers to (kind 0) comes before its page (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = open_fs(root)
        fs.create_dir(posixpath.join(folder, "_temporary"), recursive=True)
        attempt, shard, done = uuid.uuid4().hex, None, []
        of, targets = None, {}
        for batch in batches:
            for s, page_id, kind, url, payload, digest, to, to_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard is None or shard.shard != s:
                    if shard:
                        shard.close()
                        done += shard.done
                    shard, of, targets = _Shard(fs, folder, s, attempt, roll), None, {}
                if page_id != of:
                    of, targets = page_id, {}
                if kind == 0:
                    targets[digest] = (to, to_url)
                else:
                    shard.add(record(page_id, url, payload or b"", *targets.get(digest, (None, None))))
        if shard:
            shard.close()
            done += shard.done
        if done:
            yield _columns(done, _MANIFEST_ARROW)

    return run


def _mover(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = open_fs(root)
        for batch in batches:
            for name, temporary, size in zip(*(batch.column(c).to_pylist() for c in ("name", "temporary", "bytes")), strict=True):
                final, temp = posixpath.join(folder, name), posixpath.join(folder, "_temporary", temporary)
                if fs.get_file_info(temp).type == pafs.FileType.File:
                    fs.move(temp, final)
                if (info := fs.get_file_info(final)).size != size:  # a repeated task finds the file moved
                    raise OSError(f"{final}: {info.size} bytes instead of {size}")
            yield batch

    return run


def _place(page_id: Column, digest: Column) -> tuple[Column, Column]:
    """The order that shards are ranges of: ids (a null one first), then, for repeated ids, digests."""
    return F.coalesce(page_id, F.lit(-(1 << 63))), F.xxhash64(digest)


def _bounds(slim: DataFrame, range_bytes: int) -> list[tuple[int, int]]:
    """Where each shard begins: the places at which the sum of all bytes before passes a multiple of ``range_bytes``.

    The places are sorted by ranges and summed up within each, offset by the sums of those before it; a
    row for each ``range_bytes`` of payload reaches the driver.
    """
    p, h = _place(F.col("page_id"), F.col("digest"))
    sized = slim.groupBy(p.alias("p"), h.alias("h")).agg(F.sum(F.col("n") + 512).alias("n"))
    sized = materialize(sized.orderBy("p", "h").withColumn("part", F.shiftright(F.monotonically_increasing_id(), 33)), "sizes")
    before = F.coalesce(F.sum("held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sized.groupBy("part").agg(F.sum("n").alias("held")).select("part", before.alias("before"))
    running = F.sum("n").over(Window.partitionBy("part").orderBy("p", "h")) - F.col("n")
    shard = F.call_function("div", running + F.col("before"), F.lit(range_bytes))
    first = sized.join(F.broadcast(parts), "part").select("p", "h", shard.alias("shard")).groupBy("shard").agg(F.min(F.struct("p", "h")).alias("m"))
    out = [(r.p, r.h) for r in first.select("m.p", "m.h").orderBy("p", "h").collect()]
    drop(sized)
    return out


def _shard_of(begins: list[tuple[int, int]]):
    p, h = (np.array([b[k] for b in begins], np.int64) for k in (0, 1))

    @F.pandas_udf("int")
    def shard(page: pd.Series, digest: pd.Series) -> pd.Series:
        page, digest = page.to_numpy(), digest.to_numpy()
        low, high = (np.searchsorted(p, page, side) for side in ("left", "right"))
        # shards that begin within an id go on by digest
        for i in np.unique(low[high > low]):
            rows = np.flatnonzero((low == i) & (high > i))
            low[rows] += np.searchsorted(h[i : high[rows[0]]], digest[rows], "right")
        return pd.Series(low - 1)

    return shard


def write(pages: DataFrame, root: str, min_revisit: int = 1000, range_bytes: int = RANGE_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write (page_id, url, html) below ``root``; the manifest, which is also there as Parquet."""
    spark = pages.sparkSession
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    slim = rows.select("page_id", "url", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("n"))
    first = (
        slim.where((F.col("n") >= min_revisit) & F.col("page_id").isNotNull())
        .groupBy("digest")
        .agg(F.max("page_id").alias("to"), F.max_by(F.coalesce("url", F.lit("")), F.struct("page_id", F.coalesce("url", F.lit("")))).alias("to_url"), F.min("page_id").alias("least"))
        .where("least < to")
        .drop("least")
    )
    refers = slim.where(F.col("n") >= min_revisit).join(first, "digest").where("page_id < to").select("page_id", "digest", "to", "to_url").distinct()

    begins = _bounds(slim, range_bytes)
    shard = _shard_of(begins)(*_place(F.col("page_id"), F.col("digest"))).alias("shard")
    none = F.lit(None)
    both = rows.select("page_id", F.lit(1).alias("kind"), "url", "payload", F.sha1("payload").alias("digest"), none.cast("long").alias("to"), none.cast("string").alias("to_url")).unionAll(
        refers.select("page_id", F.lit(0), none.cast("string"), none.cast("binary"), "digest", "to", "to_url")
    )
    both = both.select(shard, "*")
    tasks = max(1, min(len(begins), TASKS))
    placed = both.repartitionById(tasks, F.col("shard") % tasks).sortWithinPartitions("shard", "page_id", "kind", F.xxhash64("digest"), "url", "digest")
    placed.mapInArrow(_writer(root, roll_bytes), MANIFEST).write.parquet(f"{root}/_written")
    written = spark.read.schema(MANIFEST).parquet(f"{root}/_written")
    written.mapInArrow(_mover(root), MANIFEST).drop("temporary").write.parquet(f"{root}/manifest")
    for name in ("_temporary", "_written"):
        drop_path(spark, f"{root}/{name}")
    return spark.read.parquet(f"{root}/manifest")


def members(source) -> Iterator[bytes]:
    """The records of a file of gzip members, one at a time."""
    z, parts = zlib.decompressobj(31), []
    data = source.read(1 << 20)
    while data:
        parts.append(z.decompress(data))
        data = z.unused_data
        if z.eof:
            yield b"".join(parts)
            z, parts = zlib.decompressobj(31), []
        data = data or source.read(1 << 20)
    if parts and not z.eof and any(parts):
        raise OSError("the last member is cut off")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    n = int(fields["Content-Length"])
    if len(rest) != n + 4:
        raise ValueError("the record's length differs from its Content-Length")
    return fields, rest[:n]


def _reader(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = open_fs(root)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows = []
                with fs.open_input_stream(posixpath.join(folder, name), compression=None) as source:
                    for raw in members(source):
                        fields, block = parse(raw)
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        if _b32(hashlib.sha1(block).digest()) != fields["WARC-Block-Digest"]:
                            raise ValueError(f"{name}: a block's digest differs")
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
                        size = int(http.decode().rsplit("Content-Length: ", 1)[1])
                        if fields["WARC-Type"] == "response":
                            if hashlib.sha1(payload).digest() != digest or len(payload) != size:
                                raise ValueError(f"{name}: a payload's digest differs")
                        page, to = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
                        rows.append((int(page) if page else None, fields["WARC-Target-URI"], size, digest.hex(), fields["WARC-Type"], int(to) if to else None))
                        if len(rows) >= 4096:
                            yield _columns(rows, _RECORD_ARROW)
                            rows = []
                if rows:
                    yield _columns(rows, _RECORD_ARROW)

    return run


def read(spark: SparkSession, root: str) -> DataFrame:
    """A row per response and revisit record of the files that the manifest names; every digest is verified."""
    manifest = spark.read.parquet(f"{root}/manifest").select("name")
    return manifest.repartition(parallelism(spark), "name").mapInArrow(_reader(root), RECORD)

"""WARC archives: a deterministic sharded writer and a reader.

Shards are ranges of page_id of about SHARD_BYTES cut from a histogram of payload bytes, so the same pages give the
same shards whatever their partitions and the session's settings. Inside a shard records are sorted by page_id, headers and digests are made anew, each record is a
gzip member without a time stamp, and a file is rolled when its compressed size passes `roll_bytes`. Tasks write
under temporary names and report files as rows; after the job the driver renames exactly the reported files and
writes the manifest last. The reader takes the manifest's files only: a folder without a manifest is no archive,
files beside it are not read, and a file that is missing, or whose bytes, SHA-256 or records differ, is an error.

Of records with equal payloads of at least REVISIT_BYTES the largest page_id is the response. Those decisions are
made on digests, and reach the writer as extra rows of the same shuffle: page bodies move once.

Defined results: a null html is an empty payload; a null url is written as the record's own id; a null page_id sorts
first, and is a response if no page with an id has its payload; repeated rows give repeated records of one type; an
empty table gives a manifest without files, which reads as no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import new_path, table

REVISIT_BYTES = 1000
ROLL_BYTES = 8 << 20
SHARD_BYTES = 16 << 20
BINS = 1024
DATE = "2000-01-01T00:00:00Z"
FILES = "name string, temporary string, records long, bytes long, sha256 string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, html string"


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if re.match("file:/(?!/)", uri) else uri)


def sharder(pages: DataFrame, shard_bytes: int = SHARD_BYTES):
    """A function that adds `shard` to rows with a page_id, ranges of about equal bytes of pages, and how many there are.

    A bin too heavy for a shard is split by hash.
    """
    spark = pages.sparkSession
    facts = pages.agg(F.min("page_id"), F.max("page_id")).first()
    low, high = facts[0] or 0, facts[1] or 0
    width = (high - low) // BINS + 1
    target = max(1, shard_bytes)
    bin_of = F.coalesce(F.expr(f"(page_id - {low}L) div {width}L"), F.lit(-1)).cast("int")
    weights = pages.groupBy(bin_of.alias("bin")).agg(F.sum("bytes").alias("w")).orderBy("bin").collect()  # BINS + 2 rows at most
    rows, shard, held = [], 0, 0
    for b in weights:
        if held and held + b["w"] > target:
            shard, held = shard + 1, 0
        split = max(1, b["w"] // (2 * target))
        rows.append((b["bin"], shard, split))
        held += b["w"]
        if split > 1:
            shard, held = shard + split, 0
    cut = spark.createDataFrame(rows, "__bin int, __first int, __split long")

    def add(df: DataFrame) -> DataFrame:
        shard_of = (F.col("__first") + F.pmod(F.xxhash64("page_id"), F.col("__split"))).cast("int")
        return df.withColumn("__bin", bin_of).join(F.broadcast(cut), "__bin").withColumn("shard", shard_of).drop("__bin", "__first", "__split")

    return add, shard + 1


def decided(pages: DataFrame) -> DataFrame:
    """page_id, digest, refers_to of the pages that become revisits."""
    slim = pages.select("page_id", "digest", "bytes").filter(F.col("bytes") >= REVISIT_BYTES)
    groups = slim.groupBy("digest", "bytes").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).filter("n > 1")
    return (
        slim.join(groups.select("digest", "bytes", "keep"), ["digest", "bytes"])
        .filter(F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep")))
        .select("page_id", "digest", F.col("keep").alias("refers_to"))
    )


def record_id(page_id: int | None) -> str:
    return f"<urn:ridgeline:page:{'null' if page_id is None else page_id}>"


def make_record(page_id: int | None, url: str | None, html: str | None, refers_to: int | None) -> bytes:
    payload = (html or "").encode("utf-8", "surrogatepass")
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    target = quote(url, safe=":/?#[]@!$&'()*+,;=%~-._") if url else record_id(page_id)[1:-1]
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [
            f"WARC-Refers-To: {record_id(refers_to)}",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Roller:
    """Writes the files of one shard after another; finished files wait in `done`."""

    def __init__(self, out: str, roll_bytes: int):
        self.fs, self.root = _filesystem(out)
        self.roll, self.done, self.stream = roll_bytes, [], None
        self.shard, self.sequence = None, 0

    def add(self, shard: int, record: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.sequence = shard, 0
        if self.stream is None:
            self.name = f"{shard:06d}-{self.sequence:04d}.warc.gz"
            self.temporary = f"_{uuid.uuid4().hex}-{self.name}"
            self.stream = self.fs.open_output_stream(f"{self.root}/{self.temporary}", compression=None)
            self.bytes, self.records, self.sha = 0, 0, hashlib.sha256()
            self.sequence += 1
            info = f"software: ridgeline\r\nformat: WARC File Format 1.1\r\nfilename: {self.name}\r\n".encode()
            self._put(
                f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:ridgeline:file:{self.name}>\r\nWARC-Date: {DATE}\r\n"
                f"Content-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n"
            )
            self.records = 0
        self._put(record)
        if self.bytes >= self.roll:
            self.close()

    def _put(self, record: bytes) -> None:
        member = gzip.compress(record, 6, mtime=0)
        self.stream.write(member)
        self.sha.update(member)
        self.bytes += len(member)
        self.records += 1

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.done.append((self.name, self.temporary, self.records, self.bytes, self.sha.hexdigest()))
            self.stream = None


def write_warc(pages: DataFrame, out: str, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES) -> list[dict]:
    """Writes pages (page_id, url, html) to the new folder `out`, and returns the manifest's files."""
    spark = pages.sparkSession
    p = pages.select("page_id", "url", "html").withColumns({
        "digest": F.sha1(F.coalesce("html", F.lit(""))), "bytes": F.octet_length(F.coalesce("html", F.lit("")))
    })
    add_shard, shards = sharder(p.select("page_id", "bytes"), shard_bytes)
    sharded = add_shard(p.drop("bytes"))
    none = F.lit(None).cast("string")
    marks = add_shard(decided(p)).withColumns({"url": none, "html": none, "kind": F.lit(0)})
    rows = sharded.withColumns({"refers_to": F.lit(None).cast("long"), "kind": F.lit(1)}).unionByName(marks)
    dealt = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "page_id", "digest", "kind", "url")
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(out)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    out = str(fs.makeQualified(folder))  # tasks write where the driver renames

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, mark = _Roller(out, roll_bytes), None
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                for r in b.slice(lo, 500).to_pylist():
                    key = (r["page_id"], r["digest"])
                    if r["kind"] == 0:
                        mark = (key, r["refers_to"])
                        continue
                    refers_to = mark[1] if mark and mark[0] == key else None
                    roller.add(r["shard"], make_record(r["page_id"], r["url"], r["html"], refers_to))
        roller.close()
        names = ["name", "temporary", "records", "bytes", "sha256"]
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in roller.done], k) for i, k in enumerate(kinds)], names=names)

    files = sorted(dealt.select("shard", "page_id", "digest", "kind", "refers_to", "url", "html").mapInArrow(write, FILES).collect(), key=lambda f: f["name"])
    for f in files:
        if not fs.rename(hadoop.Path(folder, f["temporary"]), hadoop.Path(folder, f["name"])):
            raise OSError(f"could not commit {f['name']}")
    for status in fs.globStatus(hadoop.Path(folder, "_*-*.warc.gz")):  # of attempts that failed
        fs.delete(status.getPath(), False)
    manifest = [{k: f[k] for k in ("name", "records", "bytes", "sha256")} for f in files]
    stream = fs.create(hadoop.Path(folder, "_MANIFEST.tmp"), True)
    stream.write(bytearray(json.dumps({"files": manifest}, indent=1).encode()))
    stream.close()
    fs.rename(hadoop.Path(folder, "_MANIFEST.tmp"), hadoop.Path(folder, "_MANIFEST.json"))
    return manifest


def parse_members(content: bytes) -> Iterator[bytes]:
    """The records of a file of gzip members."""
    view, at = memoryview(content), 0
    while at < len(view):
        d, parts = zlib.decompressobj(31), []
        while not d.eof:
            if at >= len(view):
                raise ValueError("truncated archive")
            chunk = view[at : at + 65536]
            parts.append(d.decompress(chunk))
            at += len(chunk) - len(d.unused_data)
        yield b"".join(parts)


def parse_record(record: bytes) -> dict | None:
    """A page's record, its digests verified; None for a warcinfo record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    kind = fields["WARC-Type"]
    if kind == "warcinfo":
        return None
    block = rest[: int(fields["Content-Length"])]
    digest = base64.b32decode(fields["WARC-Payload-Digest"][5:])
    if base64.b32encode(hashlib.sha1(block).digest()).decode() != fields["WARC-Block-Digest"][5:]:
        raise ValueError(f"damaged block in {fields['WARC-Record-ID']}")
    payload = block.partition(b"\r\n\r\n")[2]
    if kind == "response" and (hashlib.sha1(payload).digest() != digest or len(payload) != int(fields["WARC-Payload-Length"])):
        raise ValueError(f"damaged payload in {fields['WARC-Record-ID']}")
    number = lambda urn: None if urn is None or urn.endswith(":null>") else int(urn[:-1].rpartition(":")[2])
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "payload_bytes": int(fields["WARC-Payload-Length"]),
        "payload_digest": digest.hex(),
        "record_type": kind,
        "refers_to": number(fields.get("WARC-Refers-To")),
        "url": fields["WARC-Target-URI"],
        "html": payload.decode("utf-8", "surrogatepass") if kind == "response" else None,
    }


def read_manifest(spark: SparkSession, folder: str) -> list[dict]:
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(folder, "_MANIFEST.json")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        raise ValueError(f"no manifest in {folder}: the archive was not committed")
    stream = fs.open(path)
    try:
        return json.loads(bytes(stream.readAllBytes()))["files"]
    finally:
        stream.close()


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """One row per page record of the archives that the folder's manifest names; raises if they are not as it says."""
    fields = pa.schema([
        ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("html", pa.string()),
    ])
    manifest = read_manifest(spark, folder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, content in enumerate(b.column(0)):
                name, records, size, sha = (b.column(k)[at].as_py() for k in range(1, 5))
                content, rows, count = content.as_py(), [], 0
                if len(content) != size or hashlib.sha256(content).hexdigest() != sha:
                    raise ValueError(f"{name} is not what the manifest says")
                for record in parse_members(content):
                    if (r := parse_record(record)) is not None:
                        rows.append(r)
                        count += 1
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_pylist(rows, schema=fields)
                        rows = []
                if count != records:
                    raise ValueError(f"{name} holds {count} records, the manifest says {records}")
                yield pa.RecordBatch.from_pylist(rows, schema=fields)

    if not manifest:
        return spark.createDataFrame([], RECORDS)
    # a missing file fails as the paths are listed
    files = spark.read.format("binaryFile").load([f"{folder.rstrip('/')}/{f['name']}" for f in manifest])
    said = spark.createDataFrame([(f["name"], f["records"], f["bytes"], f["sha256"]) for f in manifest], "__name string, records long, bytes long, sha256 string")
    files = files.select("content", F.element_at(F.split("path", "/"), -1).alias("__file")).join(F.broadcast(said), F.col("__file") == F.col("__name"))
    return files.select("content", "__name", "records", "bytes", "sha256").mapInArrow(read, RECORDS)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), out)
    return read_warc(spark, out).drop("url", "html")


OP4_SQL = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), r AS (
  SELECT *, CASE WHEN payload_bytes >= {REVISIT_BYTES} THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS top FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM r
"""

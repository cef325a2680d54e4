"""A deterministic sharded WARC writer, and a reader of what it wrote.

Records are range-sorted by (page_id, digest, url) and each range is written as gzip
members, one a record, rolling to a new file once `roll_bytes` compressed bytes
are reached. The ranges come from the data alone, so every run writes the same
files, however the input is split: a page_id whose hash is 0 modulo the number of
pages due in a range begins a range, which is of about RANGE_ROLLS x roll_bytes of
payload; rows of a page_id (or of none) that exceed such a range are cut further,
by digest. Headers, lengths and digests are made anew from the payload. Of pages
with equal payloads (SHA-1 and length) the one with the largest page_id is a
response with the payload; the others are revisits that name it and carry its
digest and length.

Files get temporary names in a folder of this run; each task reports what it wrote,
the reports of the attempts that count are stored, and tasks give those files their
names, which follow from range and place in it. A file that has its name already, from
a run that was lost, stays if its bytes are the same, else it is replaced. One small
file, put in place only if there is none, then names the run's manifest and a
fingerprint of its pages; that publishes it. So a run that died at any step can be
started again: it writes the same files, and clears the folders of runs before it. A
folder that is published is not written again: the same pages give its manifest, others
are refused (FileExistsError). Two runs at once into one folder are not supported.

Storage: any file system that Hadoop names and pyarrow opens by URI, shared by driver
and executors; a path without scheme is of the default file system.

Nulls and edge cases: null html is an empty payload; empty payloads are equal to
each other; a null url leaves out the target header; a null page_id leaves out the
page header, comes first in the sort, and such a page is a response (named by no
revisit) unless an equal payload has an id; rows that repeat both the largest page_id and the
payload are all responses; rows that repeat page_id, payload and url are in one
range; extra columns are ignored; an empty table writes an empty manifest and reads
back no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popspark.sources.files import file_system, put_if_absent, read_text

from .common import materialise, scratch

ROLL_BYTES = 64 << 20
DATE = "1970-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace of RFC 4122
READ_BYTES = 1 << 20
#: The file that publishes a folder, and the columns of the manifest it names.
MANIFEST, MANIFEST_SCHEMA = "manifest.json", "file string, first_page long, records long, bytes long, sha256 string"
#: Payload bytes of a range, in files' sizes; ranges at most, about (their first page_ids go to all tasks, 8 bytes each).
RANGE_ROLLS, MOST_RANGES = 4, 1 << 20


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{page_id}:{digest}')}>"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, length: int, refers_to: int | None, date: str = DATE) -> bytes:
    """One record: a response with its payload, or a revisit if payload is null."""
    head = ["WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c for c in url if c not in "\r\n"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if payload is None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
        block, kind = f"HTTP/1.1 200 OK\r\nContent-Length: {length}\r\n\r\n".encode(), "application/http; msgtype=response"
    else:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode() + payload
        kind = "application/http; msgtype=response"
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    head += [f"X-Payload-Length: {length}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Type: {kind}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def qualified(spark: SparkSession, folder: str) -> str:
    """folder as a URI with scheme and authority, by Hadoop's rules."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    scheme, _, rest = uri.partition(":")
    return uri if rest.startswith("//") else f"{scheme}://{rest}"


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a qualified URI."""
    return pafs.FileSystem.from_uri(uri)


class RollingWriter:
    """Writes gzip members into temporary files of about roll_bytes and reports them."""

    def __init__(self, folder: str, roll_bytes: int):
        self.fs, self.path = open_folder(folder)
        self.roll_bytes, self.attempt, self.out, self.done = roll_bytes, uuid.uuid4().hex, None, []
        self.part, self.place = None, 0

    def write(self, part: tuple[int, int], first: int | None, record: bytes) -> None:
        if part != self.part:
            self.close()
            self.part, self.place = part, 0
        if self.out is None:
            self.name, self.hash, self.size, self.records, self.first = f"tmp-{self.attempt}-{len(self.done)}", hashlib.sha256(), 0, 0, first
            self.out = self.fs.open_output_stream(f"{self.path}/{self.name}")
        member = zlib.compressobj(6, zlib.DEFLATED, 31)
        packed = member.compress(record) + member.flush()
        self.out.write(packed)
        self.hash.update(packed)
        self.size, self.records = self.size + len(packed), self.records + 1
        if self.size >= self.roll_bytes:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            file = f"part-{self.part[0]:07d}-{self.part[1]:05d}-{self.place:04d}.warc.gz"
            self.done.append((self.name, file, self.first, self.records, self.size, self.hash.hexdigest()))
            self.out, self.place = None, self.place + 1


def _prepared(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (null for revisits), digest (hex), length, refers_to."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("length", F.octet_length("payload").cast("long"))
    # Only payloads that repeat need a lookup; written down, so that a small table is seen to be small.
    again = rows.groupBy("digest", "length").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1")
    again = materialise(again.select(F.col("digest").alias("d"), F.col("length").alias("l"), "keeper"), "warc-repeats")
    joined = rows.join(again, (rows["digest"] == again["d"]) & (rows["length"] == again["l"]), "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return joined.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "digest", "length", F.when(revisit, F.col("keeper")).alias("refers_to"))


def _ranged(rows: DataFrame, sizes: DataFrame, range_bytes: int) -> DataFrame:
    """rows (of which sizes has page_id and length) with part and cut, which name a row's range: numbers in the order of (page_id, digest)."""
    spark = rows.sparkSession
    pages = materialise(sizes.groupBy("page_id").agg(F.sum("length").alias("bytes")), "warc-pages")
    total = pages.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).first()
    ranges = min(MOST_RANGES, -(-(total.bytes or 0) // range_bytes) or 1)
    every = max(1, total.n // ranges)
    starts = pages.where(F.col("page_id").isNotNull() & (F.pmod(F.xxhash64(F.lit("range"), "page_id"), F.lit(every)) == 0)).select("page_id").toArrow()
    shared = spark.sparkContext.broadcast(np.sort(starts.column("page_id").to_numpy()))

    @F.pandas_udf("int")
    def part_of(page_id: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, page_id.to_numpy(np.int64), side="right").astype(np.int32) + 1)

    # Pages that alone exceed a range: at most as many as there are ranges.
    hot = materialise(pages.where(F.col("bytes") > range_bytes).select(F.col("page_id").alias("hot_id"), F.ceil(F.col("bytes") / range_bytes).alias("cuts")), "warc-large")
    marked = rows.withColumn("part", F.when(F.col("page_id").isNull(), F.lit(0)).otherwise(part_of(F.coalesce("page_id", F.lit(0)))))
    marked = marked.join(hot, marked["page_id"].eqNullSafe(hot["hot_id"]), "left")
    cut = F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") * F.col("cuts") / (1 << 32)).cast("int")
    # A large page_id has ranges of its own between those before and after it.
    return marked.withColumn("cut", F.coalesce(cut + 1, F.lit(0))).drop("hot_id", "cuts")


def write(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) as WARC files under folder; returns the manifest. To be run again after a crash."""
    spark = pages.sparkSession
    folder = qualified(spark, folder)
    source = fingerprint(pages, roll_bytes)
    published = read_text(spark, f"{folder}/{MANIFEST}")
    if published is not None:
        found = json.loads(published)
        if found["source"] != source:
            raise FileExistsError(f"{folder} holds other pages")
        clear_lost_runs(spark, folder, found["manifest"])
        return manifest_of(spark, folder)
    run_folder = f"_temporary-{uuid.uuid4().hex}"
    staging = f"{folder}/{run_folder}"
    fs, path = open_folder(staging)
    fs.create_dir(path, recursive=True)
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    fields = ["temporary", "file", "first_page", "records", "bytes", "sha256"]
    schema = "temporary string, file string, first_page long, records long, bytes long, sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = RollingWriter(staging, roll_bytes)
        for batch in batches:
            for part, cut, page_id, url, payload, digest, length, refers_to in zip(*(batch.column(i) for i in range(8)), strict=True):
                name = base64.b32encode(bytes.fromhex(digest.as_py())).decode()
                record = make_record(page_id.as_py(), url.as_py(), payload.as_py(), name, length.as_py(), refers_to.as_py())
                writer.write((part.as_py(), cut.as_py()), page_id.as_py(), record)
        writer.close()
        columns = list(zip(*writer.done, strict=True)) or [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=fields)

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, base = open_folder(folder)
        for batch in batches:
            for temporary, file, sha256 in zip(*(batch.column(c).to_pylist() for c in ("temporary", "file", "sha256")), strict=True):
                if out.get_file_info(f"{base}/{file}").type != pafs.FileType.NotFound:
                    if file_sha256(out, f"{base}/{file}") == sha256:
                        continue
                    out.delete_file(f"{base}/{file}")
                out.move(f"{base}/{run_folder}/{temporary}", f"{base}/{file}")
            yield batch.drop_columns(["temporary"])

    sizes = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.octet_length(F.col("html").cast("string")), F.lit(0)).cast("long").alias("length"))
    ranged = _ranged(_prepared(pages), sizes, RANGE_ROLLS * roll_bytes).select("part", "cut", "page_id", "url", "payload", "digest", "length", "refers_to")
    ordered = ranged.repartition("part", "cut").sortWithinPartitions("part", "cut", "page_id", "digest", "url")
    ordered.mapInArrow(run, schema).write.parquet(f"{staging}/reported")
    reported = spark.read.schema(schema).parquet(f"{staging}/reported")
    name = f"_manifest-{uuid.uuid4().hex}"
    reported.mapInArrow(rename, MANIFEST_SCHEMA).write.parquet(f"{folder}/{name}")
    if not put_if_absent(spark, f"{folder}/{MANIFEST}", json.dumps({"manifest": name, "source": source})):
        raise FileExistsError(f"{folder} was published by another run")
    clear_lost_runs(spark, folder, name)
    return manifest_of(spark, folder)


def fingerprint(pages: DataFrame, roll_bytes: int) -> str:
    """Rows, and sums of two hashes of each, whatever their order."""
    row = [F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit(""))]
    sums = [F.coalesce(F.sum(F.xxhash64(F.lit(k), *row).cast("decimal(38,0)")), F.lit(0)).cast("string") for k in (1, 2)]
    return ":".join(map(str, pages.agg(F.count("*"), *sums).first())) + f":{roll_bytes}"


def manifest_of(spark: SparkSession, folder: str) -> DataFrame:
    """file, first_page, records, bytes and sha256 of a published folder's files, in order."""
    published = read_text(spark, f"{folder}/{MANIFEST}")
    if published is None:
        raise FileNotFoundError(f"{folder} is not published")
    return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{folder}/{json.loads(published)['manifest']}").orderBy("file")


def clear_lost_runs(spark: SparkSession, folder: str, manifest: str) -> None:
    """Delete this run's and all lost runs' temporary folders and manifests but the one that counts."""
    fs, path = file_system(spark, folder)
    for f in fs.listStatus(path):
        name = f.getPath().getName()
        if f.isDirectory() and name != manifest and name.startswith(("_temporary-", "_manifest-")):
            fs.delete(f.getPath(), True)


def file_sha256(fs: pafs.FileSystem, path: str) -> str:
    found = hashlib.sha256()
    with fs.open_input_stream(path, compression=None) as stream:
        while block := stream.read(READ_BYTES):
            found.update(block)
    return found.hexdigest()


def read_records(stream: io.RawIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a WARC file, one at a time."""
    with gzip.GzipFile(fileobj=io.BufferedReader(stream, READ_BYTES)) as f:
        while True:
            line = f.readline()
            if not line:
                return
            if line == b"\r\n":
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"not a WARC record: {line[:40]!r}")
            headers = {}
            while (line := f.readline()) not in (b"\r\n", b""):
                key, _, value = line.decode("utf-8").rstrip("\r\n").partition(": ")
                headers[key.lower()] = value
            block = f.read(int(headers["content-length"]))
            yield headers, block


def read(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload from the files of the manifest."""
    folder = qualified(spark, folder)
    manifest = manifest_of(spark, folder)
    files = manifest.count()
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_folder(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for headers, block in read_records(stream):
                        rows.append(_row(headers, block))
                        held += len(block)
                        if held > 8 << 20 or len(rows) >= 2000:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    names = manifest.select("file")
    return (names.repartition(files, "file") if files > 1 else names).mapInArrow(run, schema)


def _row(headers: dict[str, str], block: bytes) -> tuple:
    if headers["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError(f"block digest differs in {headers['warc-record-id']}")
    page = int(headers["x-page-id"]) if "x-page-id" in headers else None
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    kind = headers["warc-type"]
    if kind == "revisit":
        return page, headers.get("warc-target-uri"), int(headers["x-payload-length"]), digest, kind, int(headers["x-refers-to-page"]), None
    payload = block.partition(b"\r\n\r\n")[2]
    if base32_sha1(payload) != digest:
        raise ValueError(f"payload digest differs in {headers['warc-record-id']}")
    return page, headers.get("warc-target-uri"), len(payload), digest, kind, None, payload


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


def digest(pages: DataFrame, roll_bytes: int = 8 << 20) -> DataFrame:
    """What query op9 returns: pages written to the shared folder and read back."""
    folder = scratch(pages.sparkSession, "warc")
    write(pages, folder, roll_bytes)
    return read(pages.sparkSession, folder).drop("url", "payload")

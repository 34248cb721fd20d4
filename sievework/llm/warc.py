"""A deterministic sharded WARC writer, and its reader.

Shards are ranges of the key of about equal bytes, one task each. Their bounds come from an exact running sum of bytes over
the sorted keys, so they depend on the rows alone, not on sampling, on the cluster or on how the keys are spread. In a
shard records come sorted by key and payload digest, each a gzip member of its own, without times of day; a file is closed
before the record that would take it over `roll_bytes` compressed. Headers and digests are made anew from the payload.

Each write has a folder of its own. Files are written there under a name of the attempt and moved to their final name once
complete; a second attempt at a task writes the same bytes. The manifest that Spark commits names them; the write counts
once the file CURRENT names its folder, which is replaced in one move, last. So readers see the whole old archive or the
whole new one; what an earlier write left is deleted after that. A writer holds one record at a time, so a shard may be of
any size; one key value is never split over shards.

Records with equal payloads of at least `least` bytes: that with the largest key is the response, the others revisit it.
Rows that repeat that key with that payload are responses too. Null payloads are empty. A null key sorts first and never
refers to itself; if all keys of a group are null, all its records are responses. A null URL is left out of the header.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.llm.common import bounded_batches, cut

SHARD_BYTES, ROLL_BYTES = 32 << 20, 4 << 20
LEAST = 0
#: Fixed values of the format.
CURRENT, VERSION, END = "CURRENT", "WARC/1.1", b"\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member that depends on nothing but the record."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(f"{VERSION}\r\n{head}\r\n".encode() + block + END) + packer.flush()


def urn(key: int | None, digest: str) -> str:
    return f"<urn:page:{'' if key is None else key}:{digest}>"


def safe(url: str) -> str:
    """A URL for a header line: per cent signs and line ends escaped."""
    return url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def record(key: int | None, url: str | None, payload: bytes, refers: int | None) -> bytes:
    digest = base32_sha1(payload)
    kind = "response" if refers is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers is None else http
    headers = [("WARC-Type", kind), ("WARC-Record-ID", urn(key, digest)), ("WARC-Date", DATE)]
    if url is not None:
        headers.append(("WARC-Target-URI", safe(url)))
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("X-Payload-Bytes", str(len(payload)))]
    if refers is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", urn(refers, digest))]
    return member([*headers, ("Content-Type", "application/http; msgtype=response")], block)


class Roller:
    """Files of one shard: temporary names until complete, then the final ones; tells of each for the manifest.

    A task that is repeated makes the same bytes. So where a final name is there already, put by an attempt that was lost
    later or by one that runs beside this one, that file stays and the own one goes: nothing is ever overwritten.
    """

    def __init__(self, folder: str, shard: int, roll_bytes: int) -> None:
        self.store, self.folder = fs.FileSystem.from_uri(folder)
        self.shard, self.most, self.number = shard, roll_bytes, 0
        self.attempt = f"{self.folder}/_temporary/{uuid.uuid4().hex}"
        self.sink, self.done = None, []

    def write(self, key: int | None, data: bytes) -> None:
        if self.sink and self.size + len(data) > self.most:
            self.close()
        if not self.sink:
            self.name = f"part-{self.shard:06d}-{self.number:05d}.warc.gz"
            self.store.create_dir(self.attempt, recursive=True)
            self.sink = self.store.open_output_stream(f"{self.attempt}/{self.name}", compression=None)
            self.size, self.records, self.hash, self.first = 0, 0, hashlib.sha256(), key
            info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:file:{self.name}>"), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")]
            self._put(member(info, b"format: WARC File Format 1.1\r\n"))
        self._put(data)
        self.records += 1
        self.last = key

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.hash.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.sink:
            self.sink.close()
            self._place(f"{self.attempt}/{self.name}", f"{self.folder}/{self.name}")
            self.done.append((self.name, self.shard, self.records, self.size, self.hash.hexdigest(), self.first, self.last))
            self.sink, self.number = None, self.number + 1

    def _place(self, made: str, final: str) -> None:
        there = lambda: self.store.get_file_info(final).type != fs.FileType.NotFound
        if not there():
            try:
                self.store.move(made, final)
                return
            except OSError:
                if not there():
                    raise
        self.store.delete_file(made)

    def end(self) -> list[tuple]:
        self.close()
        if self.done:
            self.store.delete_dir(self.attempt)
        return self.done


MANIFEST = "file string, shard int, records long, bytes long, sha256 string, first_key long, last_key long"


def shards_of(sizes: DataFrame, shard_bytes: int) -> np.ndarray:
    """The least key of each shard but the first, in order: as many as shards, so they may be broadcast.

    Keys are summed up, sorted in ranges that Spark chooses, and numbered by the bytes before them: those of the ranges
    before and those within. Where Spark cut the ranges does not show in the result. Null keys go to the first shard.
    """
    keys = sizes.where("page_id IS NOT NULL").groupBy("page_id").agg(F.sum("payload_bytes").alias("size"))
    ranges = keys.repartitionByRange("page_id").withColumn("part", F.spark_partition_id())
    ranges = cut(ranges, "key-sizes")
    sums = ranges.groupBy("part").agg(F.sum("size").alias("sum"))
    before = F.coalesce(F.sum("sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum("size").over(Window.partitionBy("part").orderBy("page_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = ranges.join(F.broadcast(sums.select("part", before.alias("before"))), "part").withColumn("shard", F.floor((F.col("before") + within) / shard_bytes))
    bounds = numbered.groupBy("shard").agg(F.min("page_id").alias("least")).collect()
    return np.array(sorted(r.least for r in bounds)[1:], np.int64)


def shard_column(df: DataFrame, bounds: np.ndarray) -> Column:
    """The number of a key's shard: how many bounds are not above it."""
    shared = df.sparkSession.sparkContext.broadcast(bounds)

    @F.pandas_udf("int")
    def shard(keys: pd.Series, missing: pd.Series) -> pd.Series:
        found = np.searchsorted(shared.value, keys.to_numpy(np.int64), "right").astype(np.int32)
        return pd.Series(np.where(missing.to_numpy(bool), 0, found))

    return shard(F.coalesce("page_id", F.lit(0).cast("long")), F.col("page_id").isNull())


def write_warc(df: DataFrame, path: str, payload: str = "html", least: int = LEAST, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, keep_writes: int = 0) -> DataFrame:
    """Writes the rows (page_id, url, payload) as WARC files into a folder that all executors see; gives the manifest.

    The former write goes with the commit; keep_writes lets so many of the latest stay, for readers that have opened one.
    """
    spark = df.sparkSession
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = df.select("page_id", "url", body.alias("payload"))
    narrow = rows.select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    bounds = shards_of(narrow, shard_bytes)
    n_shards = len(bounds) + 1
    write = f"write-{uuid.uuid4().hex}"
    folder = f"{path.rstrip('/')}/{write}"

    def dealt(df: DataFrame) -> DataFrame:
        return df.withColumn("shard", shard_column(df, bounds))

    groups = narrow.where(F.col("payload_bytes") >= least).groupBy("digest", "payload_bytes").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1 AND keeper IS NOT NULL")
    # Written, so that the join can split a payload that very many records have.
    revisits = narrow.join(cut(groups, "payloads"), ["digest", "payload_bytes"]).where("NOT (page_id <=> keeper)").select("page_id", "digest", "keeper").distinct()
    # A note on a revisit sorts just before its record and reaches the same task; payloads are shuffled once.
    notes = dealt(revisits).select("shard", "page_id", "digest", F.lit(0).alias("kind"), "keeper", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"))
    pages = dealt(rows).select("shard", "page_id", F.sha1("payload").alias("digest"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("keeper"), "url", "payload")
    spread = notes.unionByName(pages).repartitionById(n_shards, F.col("shard"))
    ordered = spread.sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "digest", "kind", F.col("url").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, note, done = None, None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                number, key, digest, kind, keeper, url, data = row
                if roller is None or roller.shard != number:
                    done += roller.end() if roller else []
                    roller, note = Roller(folder, number, roll_bytes), None
                if kind == 0:
                    note = (key, digest, keeper)
                else:
                    refers = note[2] if note and note[:2] == (key, digest) else None
                    roller.write(key, record(key, url, data, refers))
        done += roller.end() if roller else []
        types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        names = [x.split()[0] for x in MANIFEST.split(", ")]
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), types)], names)

    bounded_batches(spark, 128)
    ordered.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/_manifest")
    commit(spark, path, write, keep_writes)
    return manifest_of(spark, path)


def hadoop(spark: SparkSession, path: str):
    """The driver's file system of a path, and a function that makes its paths."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def commit(spark: SparkSession, path: str, write: str, keep_writes: int = 0) -> None:
    """From now on the archive is this write; then what lost attempts left goes, and earlier writes but the latest keep_writes. CURRENT is put in place by one replacing rename."""
    base = path.rstrip("/")
    files, make = hadoop(spark, base)
    new, old = make(f"{base}/_{write}"), make(f"{base}/{CURRENT}")
    stream = files.create(new, True)
    stream.write(bytearray(write.encode()))
    stream.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
    options[0] = getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
    context.rename(new, old, options)
    files.delete(make(f"{base}/{write}/_temporary"), True)
    earlier = [s for s in files.listStatus(make(base)) if (name := s.getPath().getName()).startswith("write-") and name != write]
    for status in sorted(earlier, key=lambda s: -s.getModificationTime())[keep_writes:]:
        files.delete(status.getPath(), True)


def current(spark: SparkSession, path: str) -> str:
    """The folder of the write that counts."""
    base = path.rstrip("/")
    files, make = hadoop(spark, base)
    stream = files.open(make(f"{base}/{CURRENT}"))
    try:
        return f"{base}/{spark._jvm.org.apache.commons.io.IOUtils.toString(stream, 'UTF-8')}"
    finally:
        stream.close()


def manifest_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{current(spark, path)}/_manifest")


def members(stream, hashed) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    unpack, out, data = zlib.decompressobj(31), [], stream.read(1 << 20)
    while data:
        hashed.update(data)
        while data:
            out.append(unpack.decompress(data))
            data = unpack.unused_data
            if unpack.eof:
                yield b"".join(out)
                unpack, out = zlib.decompressobj(31), []
        data = stream.read(1 << 20)
    if out and any(out):
        raise ValueError("the file ends within a record")


def parse(data: bytes) -> tuple | None:
    """The columns of RECORD; None for other kinds of record. Digests are checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if lines[0] != VERSION or rest[len(block) :] != END:
        raise ValueError("not a whole WARC record")
    if fields["WARC-Type"] not in ("response", "revisit"):
        return None
    if fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError(f"block digest of {fields['WARC-Record-ID']}")
    number = lambda name: int(x) if (x := fields[name].split(":")[2]) else None
    payload, digest = None, fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if base32_sha1(payload) != digest:
            raise ValueError(f"payload digest of {fields['WARC-Record-ID']}")
    url = fields.get("WARC-Target-URI")
    refers = number("WARC-Refers-To") if payload is None else None
    return number("WARC-Record-ID"), None if url is None else unquote(url), payload, int(fields["X-Payload-Bytes"]), digest, fields["WARC-Type"], refers


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of the files that the manifest names, one task a file; sizes, checksums and digests are checked."""
    path = current(spark, path)
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/_manifest")
    names = [x.split()[0] for x in RECORD.split(", ")]
    types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hashed, rows, held = hashlib.sha256(), [], 0
                with store.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                    for data in members(stream, hashed):
                        if (row := parse(data)) is not None:
                            rows.append(row if payloads else (*row[:2], None, *row[3:]))
                            held += len(data) if payloads else 0
                        if len(rows) >= 512 or held > 1 << 24:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)
                            rows, held = [], 0
                if hashed.hexdigest() != expected:
                    raise ValueError(f"checksum of {name}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

    files = max(1, manifest.count())
    return manifest.select("file", "sha256").repartition(files, "file").mapInArrow(run, RECORD)


def digest(records: DataFrame) -> DataFrame:
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

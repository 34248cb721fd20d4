"""Packing by power-of-two decomposition.

A document of n ids is cut into pieces of the longest length, then of the powers of two in the rest, largest first. Each
piece is a sequence of its own: no sequence crosses documents, none is padded, and sequences of equal length share a
bucket, from which batches of one length are drawn. The longest length must be a power of two.

sequence_id tells task, running number within bucket and task, and bucket; it needs no shuffle and no count of the corpus.
A document without words still has its end id; a null text counts as empty; repeated rows are packed once each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.bpe import CACHE, encoder_of, packed, read_spec
from sievework.llm.common import bounded_batches

LONGEST = 4096
END = 2


def cuts(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    whole = n // longest * longest
    out = [(k, longest) for k in range(0, whole, longest)]
    at = whole
    for k in range(longest.bit_length() - 2, -1, -1):
        if (n - whole) >> k & 1:
            out.append((at, 1 << k))
            at += 1 << k
    return out


SCHEMA = "doc_id long, start long, length long, doc_tokens long, bucket int, sequence_id long, offset long, ids binary"
COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]
TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]


class Packer:
    """Numbers the sequences of one task."""

    def __init__(self, longest: int) -> None:
        self.task, self.longest = TaskContext.get().partitionId(), longest
        self.numbers = [0] * longest.bit_length()

    def batch(self, docs: list[int | None], encoded: Iterable[bytes]) -> Iterator[pa.RecordBatch]:
        rows = []
        for doc, data in zip(docs, encoded):
            n = len(data) // 4
            for start, length in cuts(n, self.longest):
                bucket = length.bit_length() - 1
                sequence = ((self.task << 34 | self.numbers[bucket]) << 5) | bucket
                self.numbers[bucket] += 1
                rows.append((doc, start, length, n, bucket, sequence, 0, data[4 * start : 4 * (start + length)]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), TYPES)], COLUMNS)


def checked(longest: int) -> int:
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    return longest


def pack(encoded: DataFrame, ids: str = "ids", longest: int = LONGEST) -> DataFrame:
    """One row for each piece: doc_id, start, length, doc_tokens, bucket (log2 of length), sequence_id, offset and the piece's ids."""
    checked(longest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(longest)
        for batch in batches:
            yield from packer.batch(batch.column(0).to_pylist(), (x or b"" for x in batch.column(1).to_pylist()))

    return encoded.select("doc_id", ids).mapInArrow(run, SCHEMA)


def pack_texts(df: DataFrame, text: str = "text", longest: int = LONGEST, end: int = END, spec: str | None = None, memo: int = CACHE) -> DataFrame:
    """Texts to packed pieces, in one pass; each document's ids are followed by the end id. memo: stretches of text that a
    worker remembers, some 200 bytes each and twice as many at most; results do not depend on it."""
    checked(longest)
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(read_spec(spec))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer, last = encoder_of(shared.value, memo), Packer(longest), packed([end])
        for batch in batches:
            yield from packer.batch(batch.column(0).to_pylist(), (coder.encode(x or "") + last for x in batch.column(1).to_pylist()))

    return df.select("doc_id", text).mapInArrow(run, SCHEMA)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Writes packed pieces as Parquet, one folder for each length; training draws a batch from one folder."""
    pieces.write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_bucket(spark: SparkSession, path: str, length: int) -> DataFrame:
    """The sequences of one length, a power of two."""
    return spark.read.schema(SCHEMA).parquet(path).where(F.col("bucket") == checked(length).bit_length() - 1)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

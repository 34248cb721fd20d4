"""BPE encoding and decoding of a text column, with the transducer and the state machine of bpe.py.

A null text counts as empty: no ids, empty decoded text. Rows are coded on their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sievework.llm.bpe import Decoder, blocks_of, encoder_of, packed, read_spec, unpacked
from sievework.llm.common import bounded_batches


def encode(df: DataFrame, text: str = "text", into: str = "ids", spec: str | None = None, ending: tuple[int, ...] = ()) -> DataFrame:
    """df with the ids of each text as unsigned 32-bit little-endian bytes, followed by `ending`; the text column is dropped.

    spec: the path of the tokenizer file; its content is read on the driver.
    """
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(read_spec(spec))
    schema = df.drop(text, into).schema.add(into, "binary")
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, last = encoder_of(shared.value), packed(ending)
        for batch in batches:
            data = [coder.encode(x or "") + last for x in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary()) if n == into else batch.column(n) for n in names], names)

    return df.drop(into).mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", into: str = "text", spec: str | None = None, by_bytes: bool = False) -> DataFrame:
    """The way back: df with the decoded text instead of the id bytes; `by_bytes` gives readable text instead of joined tokens."""
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(read_spec(spec))
    schema = df.drop(ids, into).schema.add(into, "string")
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = encoder_of(shared.value).merges
        for batch in batches:
            texts = []
            for data in batch.column(ids).to_pylist():
                values = unpacked(data or b"")
                machine = Decoder(merges, by_bytes)
                texts.append("".join([*(machine.feed(values[k : k + 4096]) for k in range(0, len(values), 4096)), machine.close()]))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == into else batch.column(n) for n in names], names)

    return df.drop(into).mapInArrow(run, schema)


def coding_digest(df: DataFrame, text: str = "text", spec: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ids and decoded text pass through the hashes as they are made and are never held whole."""
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(read_spec(spec))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder_of(shared.value)
        numbers = np.array([f" {i}".encode() for i in range(max(coder.merges.names) + 1)])
        for batch in batches:
            rows = []
            for value in batch.column(text).to_pylist():
                n, of_ids, of_text, machine = 0, hashlib.sha256(), hashlib.sha256(), Decoder(coder.merges)
                for data in coder.stream(blocks_of(value or "")):
                    if data:
                        ids = unpacked(data)
                        digits = numbers[np.frombuffer(data, np.uint32)].tobytes().translate(None, b"\0")
                        of_ids.update(digits if n else digits[1:])
                        of_text.update(machine.feed(ids).encode())
                        n += len(ids)
                of_text.update(machine.close().encode())
                rows.append((n, of_ids.hexdigest(), of_text.hexdigest()))
            n, of_ids, of_text = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select("doc_id", text).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

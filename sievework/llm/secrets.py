"""Secret scans: Aho-Corasick keyword prefilter, anchored patterns at hits only, then embedded checksums.

The automaton runs over the text with A-Z lower-cased (same code points, same places). Every match of a pattern starts
with one of its keywords, so trying the pattern exactly where a keyword starts finds what a search of the whole text
would. Long hexadecimal runs have no fixed word; their keywords are all strings of four hexadecimal digits, by rule.

Kinds: assign, access, hex (the base), and github, npm: tokens whose last six characters are the CRC-32 of the body in
base 62; a token whose checksum does not hold is not reported.

A null text counts as empty. Rows are scanned on their own: repeated rows give repeated results, other columns pass through.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.llm.common import bounded_batches

#: Kinds in order, their patterns, the least length of the whole match or of its last group.
KINDS = ("assign", "access", "hex", "github", "npm")
BASE = KINDS[:3]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
ASSIGN_CHARS, ACCESS_CHARS = 6, 20
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
WORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
}
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def crc_base62(body: str) -> str:
    """Six base-62 digits of a token body's CRC-32."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, k = divmod(n, 62)
        out = BASE62[k] + out
    return out


@lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in WORDS.items():
        for word in words:
            found.add_word(word, (kind, len(word)))
    for four in product("0123456789abcdef", repeat=4):
        found.add_word("".join(four), ("hex", 4))
    found.make_automaton()
    return found


def scan(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in code points, by start, then kind as listed; leftmost and not overlapping for each kind."""
    low = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    out, done = [], dict.fromkeys(KINDS, 0)
    for last, (kind, length) in automaton().iter(low):
        start = last + 1 - length
        if start < done[kind]:
            continue
        if kind == "hex":
            m = HEX.match(text, start)
            good = True
        elif kind == "assign":
            m = ASSIGN.match(text, start)
            good = m and len(m[2]) >= ASSIGN_CHARS
        elif kind == "access":
            m = ACCESS.match(text, start)
            good = m and m.end() - start >= ACCESS_CHARS
        else:
            m = (GITHUB if kind == "github" else NPM).match(text, start)
            good = m and crc_base62(m[1]) == m[2]
        if m:
            done[kind] = m.end()
            if good:
                out.append((kind, start, m.end()))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(out, key=lambda x: (x[1], order[x[0]]))


def find_secrets(df: DataFrame, text: str = "text", into: str = "secrets") -> DataFrame:
    """df with an array column of the spans found in each whole text. No shuffle; memory is one Arrow batch."""
    bounded_batches(df.sparkSession)
    schema = df.drop(into).schema.add(into, SPANS)
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(x or "")] for x in batch.column(text).to_pylist()]
            columns = [pa.array(spans, kind) if n == into else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    return df.drop(into).mapInArrow(run, schema)


def redact_secrets(df: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """The same rows and columns; in each text every span found is replaced by the mark (overlapping spans by one)."""
    bounded_batches(df.sparkSession)
    names = df.columns

    def clean(value: str | None) -> str | None:
        if not value:
            return value
        out, at = [], 0
        for _, start, end in scan(value):
            if start >= at:
                out += [value[at:start], mark]
            at = max(at, end)
        return "".join([*out, value[at:]]) if at else value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [pa.array([clean(x) for x in batch.column(n).to_pylist()], pa.string()) if n == text else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    return df.mapInArrow(run, df.schema)


def joined(spans, kinds: tuple[str, ...]):
    """kind:start:end of the spans of these kinds, joined by commas."""
    kept = F.filter(spans, lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and the number of spans whose checksum holds."""
    spans = F.col("secrets")
    count = lambda *kinds: F.size(F.filter(spans, lambda x: x["kind"].isin(*kinds))).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in BASE),
        F.sha2(joined(spans, BASE).cast("binary"), 256).alias("base_sha256"),
        joined(spans, KINDS).alias("spans"),
        count("github", "npm").alias("n_checksum"),
    )

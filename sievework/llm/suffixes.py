"""Removal of repeated byte strings by a distributed merge sort of suffixes that knows common prefixes.

Every byte goes that a string of LENGTH bytes covers which also starts anywhere else, in this document or another. All
strings are judged on the input, matches never cross documents.

1. Anchors. Of the KEY-byte strings within each LENGTH-byte window the one of least hash is an anchor. Equal windows choose
   equal anchors, so only anchors whose KEY bytes occur twice can lie in a repeated window; their hashes are counted, and
   most of the corpus leaves here, having sent eight bytes for every fifty or so.
2. Runs. The suffixes that start at the anchors left (LENGTH bytes), with the bytes before them (LENGTH - KEY, backwards),
   are sorted in memory-bounded runs, equal ones collapsed to one with a count, and front-coded: each suffix is sent as the
   length of its common prefix with the one before and the rest. Equal KEY strings go to one task.
3. Merge. A loser tree combines the runs. Each head carries the length of its common prefix with the winner that beat it;
   heads with different lengths are ordered without looking at a byte, others are compared behind the known prefix. The
   merged order comes with its common prefixes, which are the classes of equal right sides at every depth.
4. Windows. The left sides are sorted likewise. For each distance from window start to anchor, a window is repeated if
   another anchor has the same class on both sides. All repeated windows of an anchor overlap, so they cover one interval.
   A key that more than HOT_PLACES places share is split: the distances are cut into SLOTS ranges, and each goes to a task
   by the bytes that all its windows share, which are nearly the whole window. So what meets in one task is what a window
   but for a few bytes has in common, and the union of the ranges is the whole.
5. Intervals go back to the documents by a hash of the context, are united for each document, and the rest is joined.

Null and empty texts have no bytes and lose none. Repeated rows are documents of their own, so they repeat each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.llm.common import bounded_batches, cut, discard, row_key, text_of, whole_rows

LENGTH, KEY = 200, 100
GROUP, ANCHORS, RUN, CONTEXTS_A_TASK = 1 << 20, 500_000, 60_000, 60_000
PLACE = [("doc", np.int64), ("place", np.int32)]
PLACE_BYTES = 12
#: A key in more places than this is split into so many slots.
HOT_PLACES, SLOTS = 20_000, 8
#: Odd constants of the rolling hash and of its final mixing; any would do.
BASE, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_POWERS: list[np.ndarray] = []


def powers() -> list[np.ndarray]:
    if not _POWERS:
        n = GROUP + LENGTH
        for factor in (BASE, pow(BASE, -1, 1 << 64)):
            made = np.full(n, factor, np.uint64)
            made[0] = 1
            _POWERS.append(np.multiply.accumulate(made))
    return _POWERS


def sliding(values: np.ndarray, width: int, pick: np.ufunc, filler: int) -> np.ndarray:
    """pick over each `width` neighbours, by running results from both ends of blocks of that width."""
    n = len(values)
    padded = np.full(-(-n // width) * width, filler, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    forward = pick.accumulate(blocks, axis=1).ravel()
    backward = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(backward[: n - width + 1], forward[width - 1 : n])


def anchors(data: np.ndarray, ends: np.ndarray, length: int, key: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of texts that stand one behind the other in data and end at `ends`."""
    n = len(data)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = (p[: n + 1] if len(p) > n else p for p in powers())
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(data * up[:n], out=sums[1:])
    hashes = (sums[key:] - sums[:-key]) * down[: n - key + 1]
    hashes ^= hashes >> np.uint64(32)
    hashes *= np.uint64(MIX)
    hashes ^= hashes >> np.uint64(29)
    for end in ends[:-1]:
        hashes[max(0, end - key + 1) : end] = NONE
    width = length - key + 1
    least = sliding(hashes, width, np.minimum, int(NONE))
    for end in ends[:-1]:
        least[max(0, end - length + 1) : end] = 0
    # A place is an anchor if its hash is the least of some window: the greatest of those leasts, over the windows it is in.
    wide = np.zeros(len(hashes) + width - 1, np.uint64)
    wide[width - 1 : width - 1 + len(least)] = least
    best = sliding(wide, width, np.maximum, 0)
    at = np.flatnonzero((best == hashes) & (hashes != NONE))
    return at, hashes[at]


def grouped(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(index, offset, bytes) in groups of about GROUP bytes; longer texts come in parts that overlap by a window."""
    group, size = [], 0
    for k, text in enumerate(texts):
        if len(text) < length:
            continue
        for start in range(0, max(1, len(text) - length + 1), GROUP - length + 1):
            part = text[start : start + GROUP] if len(text) > GROUP else text
            if group and size + len(part) > GROUP:
                yield group
                group, size = [], 0
            group.append((k, start, part))
            size += len(part)
    if group:
        yield group


def anchor_rows(df: DataFrame, length: int = LENGTH, key: int = KEY) -> DataFrame:
    """(key_hash, doc, place, more): the anchors of the column `text`. Equal keys of one task are one row, `more` the other
    places (doc and place, packed), so a key that every document has comes as few rows. doc is the column `doc`."""

    def flushed(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        hashes, docs, places = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(hashes, kind="stable")
        hashes, rest = hashes[order], np.rec.fromarrays([docs[order], places[order]], dtype=PLACE)
        new = np.ones(len(hashes), bool)
        new[1:] = hashes[1:] != hashes[:-1]
        heads = np.flatnonzero(new)
        ends = np.append(heads[1:], len(hashes))
        more = [None] * len(heads)
        for k in np.flatnonzero(ends - heads > 1):
            more[k] = rest[heads[k] + 1 : ends[k]].tobytes()
        first = rest[heads]
        columns = [pa.array(hashes[heads].view(np.int64)), pa.array(np.ascontiguousarray(first.doc)), pa.array(np.ascontiguousarray(first.place)), pa.array(more, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["key_hash", "doc", "place", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for batch in batches:
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            texts = [x.encode("utf-8", "surrogatepass") for x in batch.column(1).to_pylist()]
            for group in grouped(texts, length):
                data = np.frombuffer(b"".join(part for _, _, part in group), np.uint8)
                sizes = np.array([len(part) for _, _, part in group])
                ends = np.cumsum(sizes)
                at, hashes = anchors(data, ends, length, key)
                which = np.searchsorted(ends, at, side="right")
                index = np.array([k for k, _, _ in group])[which]
                place = at - (ends - sizes)[which] + np.array([offset for _, offset, _ in group])[which]
                found.append((hashes, docs[index], place.astype(np.int32)))
                size += len(at)
            if size >= ANCHORS:
                yield flushed(found)
                found, size = [], 0
        if found:
            yield flushed(found)

    return df.select("doc", "text").mapInArrow(run, "key_hash long, doc long, place int, more binary")


def unpacked(twice: DataFrame) -> DataFrame:
    """(doc, place, hot) of the rows of anchor_rows, with `hot`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = [np.frombuffer(x or b"", PLACE) for x in batch.column(2).to_pylist()]
            rest = np.concatenate(more) if more else np.zeros(0, PLACE)
            hot = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            docs = np.concatenate([batch.column(0).to_numpy(zero_copy_only=False), rest["doc"]])
            places = np.concatenate([batch.column(1).to_numpy(zero_copy_only=False), rest["place"]])
            hots = np.concatenate([hot, np.repeat(hot, [len(x) for x in more])])
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(places, pa.int32()), pa.array(hots)], ["doc", "place", "hot"])

    return twice.select("doc", "place", "more", "hot").mapInArrow(run, "doc long, place int, hot boolean")


def slots(length: int, key: int, n: int) -> list[tuple[int, int]]:
    """Ranges of the distance from window start to anchor, 0 to length - key: the whole first, then n that make it up."""
    cuts = np.linspace(0, length - key + 1, min(n, length - key + 1) + 1).astype(int).tolist()
    return [(0, length - key), *((a, b - 1) for a, b in zip(cuts, cuts[1:]))]


def common_prefixes(items: list[bytes]) -> np.ndarray:
    """Length of the common prefix of each item with the one before; 0 for the first."""
    out = np.zeros(len(items), np.int64)
    for k in range(0, len(items) - 1, 8192):
        part = items[k : k + 8193]
        sizes = np.fromiter(map(len, part), np.int64, len(part))
        width = int(sizes.max()) + 1
        table = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in part), np.uint8).reshape(-1, width)
        differs = table[1:] != table[:-1]
        found = np.where(differs.any(1), differs.argmax(1), width)
        out[k + 1 : k + len(part)] = np.minimum(found, np.minimum(sizes[1:], sizes[:-1]))
    return out


def first_difference(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which `known` bytes are known."""
    low, high = known, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while low < high:
        middle = (low + high) // 2
        if a[low : middle + 1] == b[low : middle + 1]:
            low = middle + 1
        else:
            high = middle
    return low


class LoserTree:
    """Merges sorted runs of (value, common prefix with the one before, payload)."""

    def __init__(self, runs: list[Iterator[tuple[bytes, int, int]]]) -> None:
        self.runs = runs
        self.n = len(runs)
        self.heads = [next(r, None) for r in runs]
        self.known = [0] * self.n  # bytes that each head shares with the last winner it met
        self.losers = [-1] * self.n
        for k in range(self.n):
            self._enter(k)

    def _beats(self, a: int, b: int) -> bool:
        """Whether run a's head goes before b's; the loser learns what it shares with the winner."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        known = self.known
        if known[a] != known[b]:
            return known[a] > known[b]
        shared = first_difference(x[0], y[0], known[a])
        p, q = x[0], y[0]
        wins = a < b if len(p) == len(q) == shared else len(p) == shared or (len(q) > shared and p[shared] < q[shared])
        known[b if wins else a] = shared
        return wins

    def _enter(self, k: int) -> None:
        """At the start: up the tree until a free place is found."""
        node, winner = (k + self.n) // 2, k
        while node > 0:
            if self.losers[node] < 0:
                self.losers[node] = winner
                return
            if not self._beats(winner, self.losers[node]):
                winner, self.losers[node] = self.losers[node], winner
            node //= 2
        self.winner = winner

    def __iter__(self) -> Iterator[tuple[bytes, int, int]]:
        """(value, common prefix with the value given before, payload), in order."""
        if not self.n:
            return
        heads, known, losers = self.heads, self.known, self.losers
        winner = self.winner
        while (head := heads[winner]) is not None:
            yield head[0], known[winner], head[2]
            heads[winner] = after = next(self.runs[winner], None)
            known[winner] = after[1] if after else 0
            node = (winner + self.n) // 2
            while node > 0:
                if not self._beats(winner, losers[node]):
                    winner, losers[node] = losers[node], winner
                node //= 2


RUN_ROWS = "part int, slot int, prefixes binary, rests binary, rest_sizes binary, lefts binary, left_sizes binary, contexts binary, many binary"


def context_of(right: bytes, left: bytes) -> bytes:
    return hashlib.blake2b(len(right).to_bytes(4, "little") + right + left, digest_size=16).digest()


def contexts(data: bytes, places: list[int], length: int, key: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(place, bytes from there, bytes before backwards) of the anchors of one text."""
    for place in sorted(set(places)):
        if place + key <= len(data):
            yield place, data[place : place + length], data[max(0, place - length + key) : place][::-1]


def front_coded(items: dict[tuple[bytes, bytes, bool], int], parts: int, length: int, key: int, ranges: list[tuple[int, int]]) -> pa.RecordBatch:
    """One row for each part and slot: a sorted run, each suffix as what it shares with the one before and the rest."""
    by_part: dict[tuple[int, int], list[tuple[bytes, bytes, bool]]] = {}
    for item in sorted(items):
        right, left, hot = item
        for slot in range(1, len(ranges)) if hot else (0,):
            least, most = ranges[slot]
            if len(left) >= least and len(right) >= length - most:
                shared = right[:key] if slot == 0 else b"%d:%b%b" % (slot, right[: length - most], left[:least])
                part = int.from_bytes(hashlib.blake2b(shared, digest_size=4).digest(), "little") % parts
                by_part.setdefault((part, slot), []).append(item)
    rows = []
    for (part, slot), run in by_part.items():
        shared = common_prefixes([right for right, *_ in run])
        rest = [right[k:] for (right, *_), k in zip(run, shared.tolist())]
        rows.append(
            (
                part,
                slot,
                shared.astype(np.uint16).tobytes(),
                b"".join(rest),
                np.array([len(x) for x in rest], np.uint16).tobytes(),
                b"".join(left for _, left, _ in run),
                np.array([len(left) for _, left, _ in run], np.uint16).tobytes(),
                b"".join(context_of(right, left) for right, left, _ in run),
                bytes(min(items[item], 2) for item in run),
            )
        )
    names = [x.split()[0] for x in RUN_ROWS.split(", ")]
    types = [pa.int32()] * 2 + [pa.binary()] * 7
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)


def sliced(data: bytes, sizes: np.ndarray) -> list[bytes]:
    ends = np.cumsum(sizes, dtype=np.int64).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def repeated_windows(rights_shared: np.ndarray, right_sizes: np.ndarray, lefts: list[bytes], many: np.ndarray, length: int, distances: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """For items in merged order the least and greatest distance, in a range, from start to anchor of their repeated windows; -1 if none."""
    n = len(lefts)
    order = np.array(sorted(range(n), key=lefts.__getitem__), np.int64)
    left_shared = common_prefixes([lefts[k] for k in order])
    left_sizes = np.fromiter(map(len, lefts), np.int64, n)
    least, most = np.full(n, -1), np.full(n, -1)
    left_class = np.zeros(n, np.int64)
    for back in range(distances[0], distances[1] + 1):
        fits = np.flatnonzero((left_sizes >= back) & (right_sizes >= length - back))
        if not len(fits):
            continue
        right_class = np.cumsum(rights_shared < length - back)
        left_class[order] = np.cumsum(left_shared < back)
        pair = right_class[fits] * (n + 1) + left_class[fits]
        by = np.argsort(pair, kind="stable")
        same = pair[by][1:] == pair[by][:-1]
        twice = many[fits] > 1
        twice[by[1:][same]] = True
        twice[by[:-1][same]] = True
        found = fits[twice]
        most[found] = back
        least[found] = np.where(least[found] < 0, back, least[found])
    return least, most


def merge_runs(table: pa.Table, length: int, ranges: list[tuple[int, int]]) -> pa.Table:
    """The runs of one part, merged; for each context with a repeated window the interval covered, relative to the anchor."""

    def decoded(rests: list[bytes], shared: list[int], base: int) -> Iterator[tuple[bytes, int, int]]:
        before = b""
        for k, (rest, n) in enumerate(zip(rests, shared)):
            before = before[:n] + rest
            yield before, n, base + k

    runs, lefts, marks, many = [], [], [], []
    for row in zip(*(table.column(x.split()[0]).to_pylist() for x in RUN_ROWS.split(", ")[2:])):
        prefixes, rests, rest_sizes, left, left_sizes, names, more = row
        runs.append(decoded(sliced(rests, np.frombuffer(rest_sizes, np.uint16)), np.frombuffer(prefixes, np.uint16).tolist(), len(lefts)))
        lefts += sliced(left, np.frombuffer(left_sizes, np.uint16))
        marks += [names[k : k + 16] for k in range(0, len(names), 16)]
        many += more
    shared, sizes, items = [], [], []
    for value, known, item in LoserTree(runs):
        shared.append(known)
        sizes.append(len(value))
        items.append(item)
    at = np.array(items, np.int64)
    least, most = repeated_windows(np.array(shared, np.int64), np.array(sizes, np.int64), [lefts[k] for k in items], np.array(many, np.int64)[at], length, ranges[table.column("slot")[0].as_py()])
    # A context that several runs have is several items with one result, and goes on once.
    once = {marks[items[k]]: k for k in np.flatnonzero(most >= 0).tolist()}
    context, found = list(once), np.array(list(once.values()), np.int64)
    return pa.table({"context": pa.array(context, pa.binary()), "first": pa.array((-most[found]).astype(np.int32)), "last": pa.array((length - least[found]).astype(np.int32))})


def anchored(df: DataFrame, text: str, length: int, key: int, hot_places: int) -> DataFrame:
    """row_key, text, places, hot_places: the texts with anchors whose key occurs twice, written to the shared folder."""
    body = text_of(text)
    docs = df.select(row_key("doc_id", body).alias("row_key"), body.alias("text")).where(F.octet_length("text") >= length)
    docs = docs.withColumn("doc", F.xxhash64("row_key"))
    found = cut(anchor_rows(docs, length, key), "anchors")
    times = 1 + F.coalesce(F.octet_length("more"), F.lit(0)) / PLACE_BYTES
    counted = found.groupBy("key_hash").agg(F.sum(times).alias("n")).where("n > 1")
    # Written, so that the join knows its size and a key of very many places can be split.
    counted = cut(counted.select("key_hash", (F.col("n") > hot_places).alias("hot")), "keys")
    places = cut(unpacked(found.join(counted, "key_hash")), "places")
    discard(found, counted)
    hits = places.groupBy("doc").agg(F.collect_set(F.when(~F.col("hot"), F.col("place"))).alias("places"), F.collect_set(F.when(F.col("hot"), F.col("place"))).alias("hot_places"))
    # `doc` is short and only proposes places; a clash of two documents proposes too many. Results go by row_key.
    out = cut(docs.join(hits.hint("shuffle_hash"), "doc").select("row_key", "text", "places", "hot_places"), "anchored")
    discard(places)
    return out


def repeated_spans(df: DataFrame, text: str = "text", length: int = LENGTH, key: int = KEY, hot_places: int = HOT_PLACES) -> DataFrame:
    """row_key, text and spans (array of start, end in bytes, apart and in order) of the texts that repeat something."""
    spark = df.sparkSession
    bounded_batches(spark)
    chosen = anchored(df, text, length, key, hot_places)
    ranges = slots(length, key, SLOTS)
    places = chosen.agg(F.sum(F.size("places") + SLOTS * F.size("hot_places"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-places // CONTEXTS_A_TASK))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: dict[tuple[bytes, bytes, bool], int] = {}
        for batch in batches:
            for value, *both in zip(*(batch.column(c).to_pylist() for c in ("text", "places", "hot_places"))):
                data = value.encode("utf-8", "surrogatepass")
                for hot, at in enumerate(both):
                    for _, right, left in contexts(data, at, length, key):
                        items[right, left, bool(hot)] = items.get((right, left, bool(hot)), 0) + 1
                if len(items) >= RUN:
                    yield front_coded(items, parts, length, key, ranges)
                    items = {}
        if items:
            yield front_coded(items, parts, length, key, ranges)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.binary(), pa.int32(), pa.binary()))], ["row_key", "place", "context"])

        rows = []
        for batch in batches:
            for name, value, cool, hot in zip(*(batch.column(c).to_pylist() for c in ("row_key", "text", "places", "hot_places"))):
                for place, right, left in contexts(value.encode("utf-8", "surrogatepass"), cool + hot, length, key):
                    rows.append((name, place, context_of(right, left)))
                    if len(rows) >= RUN:
                        yield batch_of(rows)
                        rows = []
        if rows:
            yield batch_of(rows)

    # One arrow batch holds whole runs here, so few rows of it.
    covered = chosen.mapInArrow(runs, RUN_ROWS).groupBy("part", "slot").applyInArrow(lambda t: merge_runs(t, length, ranges), "context binary, first int, last int")
    marks = chosen.mapInArrow(named, "row_key binary, place int, context binary")
    reach = F.struct((F.col("place") + F.col("first")).alias("start"), (F.col("place") + F.col("last")).alias("end"))
    united = marks.join(covered, "context").groupBy("row_key").agg(F.collect_set(reach).alias("spans"))
    return chosen.select("row_key", "text").join(united, "row_key")


def cut_out(found: DataFrame) -> DataFrame:
    """row_key, kept (bytes) and spans, united where they touch: the result for each distinct row that loses something."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, spans = [], []
            for value, raw in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                data, joint = value.encode("utf-8", "surrogatepass"), []
                for start, end in sorted((x["start"], x["end"]) for x in raw):
                    if joint and start <= joint[-1][1]:
                        joint[-1][1] = max(end, joint[-1][1])
                    else:
                        joint.append([start, end])
                bounds = [0, *(x for span in joint for x in span), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(bounds[::2], bounds[1::2])))
                spans.append([{"start": a, "end": b} for a, b in joint])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("row_key"), pa.array(kept, pa.binary()), pa.array(spans, kind)], ["row_key", "kept", "spans"])

    spans = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([found.schema["row_key"], T.StructField("kept", T.BinaryType()), T.StructField("spans", spans)])
    return found.mapInArrow(run, schema)


def remove_repeats(df: DataFrame, text: str = "text", length: int = LENGTH, key: int = KEY, hot_places: int = HOT_PLACES) -> DataFrame:
    """df with kept (the remaining bytes) and spans (what went) for every row, which replace columns of these names."""
    changed = cut_out(repeated_spans(df, text, length, key, hot_places)).dropDuplicates(["row_key"])
    body = text_of(text)
    rows = df.select(whole_rows(df).alias("row"), row_key("doc_id", body).alias("row_key"))
    whole = F.coalesce(F.col("row").getField(text), F.lit("")).cast("binary")
    columns = [F.col("row").getField(c).alias(c) for c in df.columns if c not in ("kept", "spans")]
    return rows.join(changed, "row_key", "left").select(*columns, F.coalesce("kept", whole).alias("kept"), F.coalesce("spans", F.array()).alias("spans"))


def digest(df: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; only keys and digests are joined, not texts."""
    body = text_of(text)
    changed = cut_out(repeated_spans(df, text))
    lost = changed.select(
        "row_key",
        F.aggregate("spans", F.lit(0), lambda s, x: s + x["end"] - x["start"]).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    ).distinct()
    whole = df.select("doc_id", row_key("doc_id", body).alias("row_key"), F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body.cast("binary"), 256).alias("whole_sha256"))
    joined = whole.join(lost, "row_key", "left")
    zero = F.lit(0).cast("long")
    return joined.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"))

"""Ranked lexical search over a clustered index: recursive graph bisection reorders the documents, and each query visits the
clusters of that order by the bound of their scores until no bound can reach its results.

- Queries are taken in blocks of bounded text; only their terms are indexed, so a document's row is its length and the
  numbers and frequencies of those terms. No text is shuffled.
- Bisection halves all clusters of a level at once. A pass counts the documents with each term on both sides of each cluster,
  the driver turns these counts (at most 2^levels times FEATURES) into what a move of a term saves, the next pass sums the
  savings of each document in its row and counts documents by saving; both sides then swap as many of their best as still
  gain. Documents stay where they are; every document takes part. A level's end is written.
- The index holds the documents by cluster. A cluster's bound for a query is the sum of its terms' greatest impacts there. A
  query visits its next clusters, twice as many in each round, if their bound is not below its last result's score (a tie may
  be won by a smaller doc_id), so results are exact whatever the order is worth.
- A task keeps of each batch the best of each query, ties by doc_id, before the few rows that are left are ranked together.

What the driver holds of a block is bounded by it: terms, weights, bounds, last scores. Items that repeat, or repeat an id, are
ranked each on their own; a null or empty text has no terms. Rows of documents that repeat are ranked each; a null doc_id comes
last among ties. Other columns are not read. Sums are 64-bit integers.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.llm.common import bounded_batches, cut, discard, own_dir, text_of

TOP = 10
#: Clusters are at most 2^LEVELS and hold LEAST_DOCUMENTS documents or more on average.
LEVELS = 6
LEAST_DOCUMENTS = 512
#: Swaps in each level.
ROUNDS = 3
#: The most frequent terms that are in at most half of the documents guide the bisection.
FEATURES = 4096
#: Bytes of item text in a block of queries.
BLOCK = 256 << 10
#: Cells of the score table that a task fills at once.
CELLS = 2_000_000
#: Savings are counted in bins, 8 for each doubling.
BINS, BIN_STEP = 256, 8

TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
NO_TERM = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
SLICE = 1 << 20


def count_terms(text: bytes) -> Counter:
    """Terms of the UTF-8 bytes of a text with their frequencies, A-Z lower-cased (bytes.lower leaves all others)."""
    found: Counter = Counter()
    start, text = 0, text.lower()
    while start < len(text):
        stop = NO_TERM.search(text, min(start + SLICE, len(text)))
        end = stop.start() if stop else len(text)
        found.update(TERM.findall(text, start, end))
        start = end
    return found


def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))


def flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of all rows, and the row of each."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), sizes)


def forward_rows(docs: DataFrame, vocabulary: dict[bytes, int], text: str, doc_id: str) -> DataFrame:
    """doc_id, n (terms with repeats), numbers and frequencies of the vocabulary's terms; documents without a term are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            n, sizes, terms, tfs = [], [], [], []
            for value in batch.column(1).cast(pa.binary()):
                counts = count_terms(value.as_py())
                hits = [(known[t], c) for t, c in counts.items() if t in known]
                n.append(counts.total())
                sizes.append(len(hits))
                terms.extend(t for t, _ in hits)
                tfs.extend(c for _, c in hits)
            out = pa.record_batch([batch.column(0), pa.array(n, pa.int64()), lists(np.array(terms, np.int32), np.array(sizes, np.int64), pa.int32()), lists(np.array(tfs, np.int64), np.array(sizes, np.int64), pa.int64())], names=["doc_id", "n", "terms", "tfs"])
            yield out.filter(pc.greater(out.column("n"), 0))

    plain = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    found = plain.mapInArrow(rows, f"doc_id {kind}, n long, terms array<int>, tfs array<long>")
    return found.withColumn("salt", F.xxhash64("doc_id", "n")).withColumn("cluster", F.lit(0))


class Swaps:
    """What the swaps of one level have decided so far; a document's side follows from its row alone."""

    def __init__(self, level: int, features: np.ndarray):
        self.level, self.features, self.steps = level, features, []

    def sides(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Clusters after the swaps, and the features with their rows. Equal term lists start on one side."""
        terms, row = flat(batch.column("terms"))
        feature = self.features[terms] if len(terms) else terms
        feature, row = feature[feature >= 0], row[feature >= 0]
        salt = batch.column("salt").to_numpy(zero_copy_only=False)
        mixed = np.bincount(row, (feature * 40503 + 1) % 65521, len(salt)).astype(np.int64)
        now = 2 * batch.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64) + ((mixed * 2654435761 >> (16 + self.level)) & 1)
        for saving, moved in self.steps:
            bins = self.bins(saving, now, feature, row)
            share = (salt & 0xFFFFF) / float(1 << 20)
            now = now ^ (share < moved[now, bins])
        return now, feature, row

    @staticmethod
    def bins(saving: np.ndarray, now: np.ndarray, feature: np.ndarray, row: np.ndarray) -> np.ndarray:
        gain = np.bincount(row, saving[now[row], feature], len(now))
        size = np.floor(BIN_STEP * np.log2(1 + np.abs(gain))).astype(np.int64)
        return np.clip(np.where(gain < 0, -size - 1, size), -BINS, BINS - 1) + BINS


def counted(state: DataFrame, keys: Callable[[pa.RecordBatch], np.ndarray]) -> dict[int, int]:
    """How often each number occurs: counted in the tasks first, summed next; the caller's numbers are bounded."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            key, n = np.unique(keys(batch), return_counts=True)
            total.update(dict(zip(key.tolist(), n.tolist(), strict=True)))
        yield pa.record_batch({"key": pa.array(total.keys(), pa.int64()), "n": pa.array(total.values(), pa.int64())})

    found = state.select("cluster", "salt", "terms").mapInArrow(rows, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return {r["key"]: r["n"] for r in found.collect()}


def savings(degrees: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of moving a document with a term to the other side: bits of the gaps between the term's documents, before less after."""

    def cost(n: np.ndarray, d: np.ndarray) -> np.ndarray:
        return np.where(d > 0, d * np.log2(np.maximum(n, 1) / (np.maximum(d, 0) + 1)), 0.0)

    other, n, m = degrees[np.arange(len(degrees)) ^ 1], sizes[:, None], sizes[np.arange(len(sizes)) ^ 1][:, None]
    return cost(n, degrees) + cost(m, other) - cost(n, degrees - 1) - cost(m, other + 1)


def swap_shares(histogram: np.ndarray) -> np.ndarray:
    """For each side and bin of savings the share of documents to move: both sides give equally many, best first, while two
    that are swapped save together."""
    moved = np.zeros(histogram.shape)
    steps = np.arange(2 * BINS) - BINS
    middle = np.where(steps >= 0, 2 ** ((steps + 0.5) / BIN_STEP) - 1, 1 - 2 ** ((-steps - 0.5) / BIN_STEP))
    for left in range(0, len(histogram), 2):
        at, rest = [2 * BINS - 1] * 2, [float(histogram[left + s, -1]) for s in (0, 1)]
        while True:
            for s in (0, 1):
                while rest[s] <= 0 and at[s] > 0:
                    at[s] -= 1
                    rest[s] = float(histogram[left + s, at[s]])
            n = min(rest)
            if n <= 0 or middle[at[0]] + middle[at[1]] <= 0:
                break
            for s in (0, 1):
                moved[left + s, at[s]] += n / histogram[left + s, at[s]]
                rest[s] -= n
    return moved


def bisect(state: DataFrame, df: np.ndarray, documents: int, levels: int, rounds: int) -> DataFrame:
    """state with clusters 0 to 2^levels - 1 in their order."""
    useful = np.flatnonzero((df > 1) & (2 * df <= documents))
    useful = useful[np.argsort(-df[useful], kind="stable")][:FEATURES]
    features = np.full(len(df), -1)
    features[useful] = np.arange(len(useful))
    width = max(1, len(useful))
    for level in range(levels):
        swaps, sides = Swaps(level, features), 2 << level

        def degree_keys(batch: pa.RecordBatch, swaps: Swaps = swaps, width: int = width) -> np.ndarray:
            now, feature, row = swaps.sides(batch)
            return np.concatenate([now * (width + 1) + width, now[row] * (width + 1) + feature])

        for _ in range(rounds):
            found = np.zeros((sides, width + 1))
            for key, n in counted(state, degree_keys).items():
                found[divmod(key, width + 1)] = n
            saving = savings(found[:, :width], found[:, width])

            def bin_keys(batch: pa.RecordBatch, swaps: Swaps = swaps, saving: np.ndarray = saving) -> np.ndarray:
                now, feature, row = swaps.sides(batch)
                return now * (2 * BINS) + swaps.bins(saving, now, feature, row)

            histogram = np.zeros((sides, 2 * BINS))
            for key, n in counted(state, bin_keys).items():
                histogram[divmod(key, 2 * BINS)] = n
            moved = swap_shares(histogram)
            swaps.steps = [*swaps.steps, (saving, moved)]

        def settle(batches: Iterator[pa.RecordBatch], swaps: Swaps = swaps) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                where = batch.schema.get_field_index("cluster")
                yield batch.set_column(where, "cluster", pa.array(swaps.sides(batch)[0], pa.int32()))

        before, state = state, cut(state.mapInArrow(settle, state.schema), f"search-level-{level}")
        discard(before)
    return state


class Plan:
    """The queries of a block: items, numbers of their terms, weights times repeats as a sparse table by term."""

    def __init__(self, items: list[Counter]):
        self.vocabulary = {t: i for i, t in enumerate(sorted({t for c in items for t in c}))}
        pairs = sorted((self.vocabulary[t], q, n) for q, c in enumerate(items) for t, n in c.items())
        self.term, self.query, self.times = (np.array(x, np.int64) for x in (zip(*pairs, strict=True) if pairs else ((), (), ())))
        self.items = len(items)

    def weigh(self, df: np.ndarray, documents: int) -> None:
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        self.weight = weight[self.term] * self.times

    def bounds(self, greatest: np.ndarray) -> np.ndarray:
        """Of each query in each cluster; greatest: impacts by cluster and term."""
        out = np.zeros((self.items, len(greatest)), np.int64)
        np.add.at(out, self.query, (greatest[:, self.term] * self.weight).T)
        return out


def impacts(n: np.ndarray, tf: np.ndarray, documents: int, total: int) -> np.ndarray:
    m = np.array([25 + 75 * int(x) * documents // total for x in n], np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def write_index(state: DataFrame, documents: int, total: int, label: str) -> DataFrame:
    """doc_id, terms and impacts, in a folder for each cluster."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tf, row = flat(batch.column("tfs"))
            value = impacts(batch.column("n").to_numpy()[row], tf, documents, total)
            sizes = pc.list_value_length(batch.column("tfs")).to_numpy(zero_copy_only=False)
            yield pa.record_batch([batch.column("cluster"), batch.column("doc_id"), batch.column("terms"), lists(value, sizes, pa.int64())], names=["cluster", "doc_id", "terms", "impacts"])

    kind = state.schema["doc_id"].dataType.simpleString()
    path = f"{own_dir(state.sparkSession)}/search-index-{label}"
    made = state.where(F.size("terms") > 0).mapInArrow(rows, f"cluster int, doc_id {kind}, terms array<int>, impacts array<long>")
    made.hint("rebalance", "cluster").write.partitionBy("cluster").parquet(path)
    found = state.sparkSession.read.schema(made.schema).parquet(path)
    found.cut_path = path
    return found


def greatest_impacts(index: DataFrame, clusters: int, terms: int) -> np.ndarray:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((clusters, terms), np.int64)
        for batch in batches:
            value, row = flat(batch.column("impacts"))
            cluster = batch.column("cluster").to_numpy()[row]
            np.maximum.at(best, (cluster, flat(batch.column("terms"))[0]), value)
        cluster, term = np.nonzero(best)
        yield pa.record_batch({"cluster": cluster.astype(np.int32), "term": term.astype(np.int32), "most": best[cluster, term]})

    found = index.select("cluster", "terms", "impacts").mapInArrow(rows, "cluster int, term int, most long").groupBy("cluster", "term").agg(F.max("most").alias("most"))
    out = np.zeros((clusters, terms), np.int64)
    for r in found.collect():
        out[r["cluster"], r["term"]] = r["most"]
    return out


def visit(index: DataFrame, plan: Plan, wanted: dict[int, list[int]], last: np.ndarray, top: int) -> DataFrame:
    """The best of each query in the clusters that it visits now: query, doc_id, score."""
    shared = index.sparkSession.sparkContext.broadcast((plan, wanted, last))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, wanted, last = shared.value
        tables: dict[int, tuple] = {}
        for batch in batches:
            clusters = batch.column("cluster").to_numpy()
            for cluster in np.unique(clusters).tolist():
                own = batch.filter(pa.array(clusters == cluster))
                if cluster not in tables:
                    place = np.full(plan.items, -1)
                    place[wanted[cluster]] = np.arange(len(wanted[cluster]))
                    used = place[plan.query] >= 0
                    term = plan.term[used]
                    edges = np.searchsorted(term, np.arange(len(plan.vocabulary) + 1))
                    tables[cluster] = place[plan.query[used]], plan.weight[used], edges
                step = max(1, CELLS // len(wanted[cluster]))
                for start in range(0, len(own), step):
                    yield best_of(own.slice(start, step), *tables[cluster], wanted[cluster], last, top)

    kind = index.schema["doc_id"].dataType.simpleString()
    near = index.where(F.col("cluster").isin(list(wanted))).select("cluster", "doc_id", "terms", "impacts")
    found = near.mapInArrow(rows, f"query int, doc_id {kind}, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= top).drop("at")


def best_of(batch: pa.RecordBatch, place: np.ndarray, weight: np.ndarray, edges: np.ndarray, queries: list[int], last: np.ndarray, top: int) -> pa.RecordBatch:
    terms, row = flat(batch.column("terms"))
    impact, _ = flat(batch.column("impacts"))
    first, size = edges[terms], edges[terms + 1] - edges[terms]
    entry = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
    scores = np.zeros((len(queries), len(batch)), np.int64)
    np.add.at(scores, (place[entry], np.repeat(row, size)), np.repeat(impact, size) * weight[entry])
    rank = pc.rank(batch.column("doc_id"), sort_keys="ascending", null_placement="at_end", tiebreaker="first").to_numpy()
    found: list[np.ndarray] = []
    for at, query in enumerate(queries):
        good = np.flatnonzero(scores[at] >= max(1, last[query]))
        found.append(good[np.lexsort((rank[good], -scores[at, good]))][:top])
    sizes = [len(x) for x in found]
    rows = np.concatenate(found) if found else np.zeros(0, np.int64)
    values = scores[np.repeat(np.arange(len(queries)), sizes), rows]
    return pa.record_batch([pa.array(np.repeat(queries, sizes), pa.int32()), batch.column("doc_id").take(pa.array(rows)), pa.array(values, pa.int64())], names=["query", "doc_id", "score"])


def search_block(docs: DataFrame, items: list[Counter], top: int, levels: int, rounds: int, text: str, doc_id: str, seen: Callable[[dict], None] | None) -> DataFrame | None:
    """query (the place in items), doc_id, score, before the last ranking; None if nothing can be found."""
    plan, label = Plan(items), uuid.uuid4().hex
    if not plan.vocabulary:
        return None
    state = cut(forward_rows(docs, plan.vocabulary, text, doc_id), "search-forward")
    documents, total = state.agg(F.count("*"), F.sum("n")).first()
    if not documents:
        return None
    df = np.zeros(len(plan.vocabulary), np.int64)
    for r in state.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[r["term"]] = r["count"]
    plan.weigh(df, documents)
    levels = max(0, min(levels, (documents // LEAST_DOCUMENTS).bit_length() - 1))
    state = bisect(state, df, documents, levels, rounds)
    index = write_index(state, documents, total, label)
    discard(state)
    bounds = plan.bounds(greatest_impacts(index, 1 << levels, len(plan.vocabulary)))
    order = np.argsort(-bounds, axis=1, kind="stable")
    last, at, step, found, visits = np.zeros(plan.items, np.int64), np.zeros(plan.items, np.int64), 1, None, 0
    while True:
        wanted: dict[int, list[int]] = {}
        for q in range(plan.items):
            for c in order[q, at[q] : at[q] + step].tolist():
                if bounds[q, c] >= max(1, last[q]):
                    wanted.setdefault(c, []).append(q)
                    visits += 1
        if not wanted:
            break
        new = cut(visit(index, plan, wanted, last, top), "search-found")
        found = new if found is None else found.unionByName(new)
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
        for r in found.withColumn("at", place).where(F.col("at") == top).collect():
            last[r["query"]] = r["score"]
        at, step = at + step, 2 * step
    if seen:
        seen({"clusters": 1 << levels, "visits": visits, "items": plan.items, "postings": int(df.sum())})
    return found


def rank(docs: DataFrame, items: DataFrame, top: int = TOP, levels: int = LEVELS, rounds: int = ROUNDS, block: int = BLOCK, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", seen: Callable[[dict], None] | None = None) -> DataFrame:
    """The `top` best documents of each item: item_id, rank, doc_id, score. `seen` is told, for each block of queries, how many
    clusters there are and how many were visited."""
    spark = docs.sparkSession
    bounded_batches(spark)
    asked = items.select(F.col(item_id).alias("item_id"), text_of(item_text).alias("text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block)
    kind, doc_kind = asked.schema["item_id"].dataType.simpleString(), docs.schema[doc_id].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id {doc_kind}, score long")
    for b in range(blocks):
        mine = [(r["item_id"], count_terms(r["text"].encode())) for r in asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()]
        found = search_block(docs, [c for _, c in mine], top, levels, rounds, text, doc_id, seen)
        if found is not None:
            order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
            names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(mine)], f"query int, item_id {kind}")
            ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            out = out.unionByName(ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
    return out

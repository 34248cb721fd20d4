"""SimHash near-dedup over vantage-point trees.

Fingerprints: A-Z lower-cased, ASCII white space splits words, XXH64 of each shingle (seed 42), a bit is 1 if set in over
half of the hashes. Equal fingerprints are one node from the start, so copies cost nothing further.

Pairs within `bits` differing bits are found exactly. A vantage-point tree over the Hamming distance, built on a bounded
sample (it only routes, so any sample gives the same links), sends each node to its home shard; the triangle bound
d(x, v) <= radius + bits, or d(x, v) > radius - bits, tells which other shards could hold a partner, and the node visits
those that come after its own. In a shard the same splits go on, on both sides at once, until blocks are small enough to
compare. A shard with many visitors is done in parts, each with all homes and VISITORS_A_PART visitors or so, so a task holds
NODES_A_SHARD and VISITORS_A_PART fingerprints, about, however many there are in all; homes meet each other in the first
part. A part gives a spanning forest of what it found, never all pairs of a group. Components come from alternating
large-star and small-star steps over those edges, each written to the shared folder.

Cost: random 64-bit fingerprints lie near 32 bits from any vantage point, so a split spares only a sixth of the pairs;
the comparisons grow about as nodes to the power 1.75.

Null and empty texts, or texts of white space, have fingerprint zero and are linked like any other. Repeated rows and
repeated or null doc_ids are kept; a component's id is its smallest non-null doc_id (null if there is none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import bounded_batches, cut, row_key, text_of, whole_rows

WORDS, SEED, BITS = 4, 42, 4
SHARDS, NODES_A_SHARD, VISITORS_A_PART, SAMPLE_A_SHARD = 64, 250_000, 500_000, 64
SMALL = 1 << 17
HASHES_AT_ONCE = 1 << 15


def fingerprint(text: str, words: int = WORDS) -> int:
    """The 64-bit SimHash of a whole text, as an unsigned number."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return digest(b" ".join(found), SEED)
    shingles = zip(*(found[k:] for k in range(words)))
    n, ones = len(found) - words + 1, np.zeros(64, np.int64)
    join = b" ".join
    for start in range(0, n, HASHES_AT_ONCE):
        size = min(HASHES_AT_ONCE, n - start)
        hashes = np.fromiter((digest(join(s), SEED) for _, s in zip(range(size), shingles)), np.uint64, size)
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def with_fingerprints(df: DataFrame, text: str = "text", words: int = WORDS) -> DataFrame:
    """The columns but the text, and fingerprint: the 64 bits as a long."""
    bounded_batches(df.sparkSession)
    schema = df.drop(text, "fingerprint").schema.add("fingerprint", "long")
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(x or "", words) for x in batch.column(text).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(prints) if n == "fingerprint" else batch.column(n) for n in names], names)

    return df.drop("fingerprint").mapInArrow(run, schema)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class VantageTree:
    """A complete binary tree over a sample: node k has a vantage point and a radius, children 2k+1 (within) and 2k+2."""

    def __init__(self, sample: np.ndarray, depth: int) -> None:
        self.depth = depth
        self.points = np.zeros((1 << depth) - 1, np.uint64)
        self.radii = np.zeros((1 << depth) - 1, np.int64)
        self._build(0, sample, 0)

    def _build(self, k: int, members: np.ndarray, level: int) -> None:
        if level == self.depth:
            return
        if len(members):
            self.points[k] = members[0]
            far = distance(members, members[0])
            self.radii[k] = int(np.median(far))
            near = far <= self.radii[k]
        else:
            near = np.zeros(0, bool)
        self._build(2 * k + 1, members[near], level + 1)
        self._build(2 * k + 2, members[~near], level + 1)

    def route(self, values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Home shard of each value, and pairs (index, shard) of the later shards that may hold something within `bits`."""
        home = np.zeros(len(values), np.int64)
        who, node = np.arange(len(values)), np.zeros(len(values), np.int64)
        for _ in range(self.depth):
            far = distance(values, self.points[home])
            home = 2 * home + 1 + (far > self.radii[home])
            far = distance(values[who], self.points[node])
            near, out = far <= self.radii[node] + bits, far > self.radii[node] - bits
            who, node = np.concatenate([who[near], who[out]]), np.concatenate([2 * node[near] + 1, 2 * node[out] + 2])
        later = node > home[who]
        first = (1 << self.depth) - 1
        return home - first, np.stack([who[later], node[later] - first])


class Forest:
    """Union-find over indices; links(a, b, mask) joins index arrays wherever the mask of their pairs is set.

    Labels lag behind the joins; equal ones are connected for sure, so a dense group is joined once and then skipped by
    array comparisons, not walked again for each of its pairs.
    """

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))
        self.label, self.seen = np.arange(n), 0
        self.edges: list[tuple[int, int]] = []

    def refresh(self) -> None:
        label = np.array(self.parent, np.int64)
        while not np.array_equal(label, above := label[label]):
            label = above
        self.label, self.seen = label, len(self.edges)

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.edges.append((x, y))

    def links(self, a: np.ndarray, b: np.ndarray, mask: np.ndarray) -> None:
        if len(self.edges) - self.seen >= 256:
            self.refresh()
        mask = mask & (self.label[a][:, None] != self.label[b][None, :])
        while mask.any():
            rows = np.flatnonzero(mask.any(1))
            for i, j in zip(rows, mask[rows].argmax(1)):
                self.join(int(a[i]), int(b[j]))
            columns = np.flatnonzero(mask.any(0))
            for j, i in zip(columns, mask[:, columns].argmax(0)):
                self.join(int(a[i]), int(b[j]))
            of_a = np.array([self.find(int(x)) for x in a[rows]])
            of_b = np.array([self.find(int(x)) for x in b[columns]])
            left = mask[np.ix_(rows, columns)] & (of_a[:, None] != of_b[None, :])
            a, b, mask = a[rows], b[columns], left


class Shard:
    """All pairs within `bits` among the homes, and between visitors and homes, as a spanning forest."""

    def __init__(self, homes: np.ndarray, visitors: np.ndarray, bits: int, among: bool = True) -> None:
        self.values = np.concatenate([homes, visitors])
        self.bits, self.forest = bits, Forest(len(self.values))
        h = np.arange(len(homes))
        if among:
            self.within(h)
        self.across(np.arange(len(homes), len(self.values)), h)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        pairs = np.array(self.forest.edges, np.int64).reshape(-1, 2)
        return self.values[pairs[:, 0]], self.values[pairs[:, 1]]

    def split(self, members: np.ndarray) -> tuple[np.uint64, int]:
        """A vantage point that parts the members, as far as one of a few does, and its median radius."""
        best = None
        for k in np.linspace(0, len(members) - 1, 3).astype(int):
            point = self.values[members[k]]
            far = distance(self.values[members], point)
            radius = int(np.median(far))
            uneven = abs(2 * int((far <= radius).sum()) - len(members))
            if best is None or uneven < best[0]:
                best = (uneven, point, radius)
        return best[1], best[2]

    def within(self, a: np.ndarray) -> None:
        if len(a) * len(a) <= 4 * SMALL:
            return self.compare(a, a)
        point, radius = self.split(a)
        far = distance(self.values[a], point).astype(np.int64)
        near, out = far <= radius, far > radius
        if min(near.sum(), out.sum()) < len(a) // 64:
            return self.compare(a, a)
        self.within(a[near])
        self.within(a[out])
        self.across(a[near & (far > radius - self.bits)], a[out & (far <= radius + self.bits)])

    def across(self, a: np.ndarray, b: np.ndarray) -> None:
        if not len(a) or not len(b):
            return
        if len(a) * len(b) <= 4 * SMALL:
            return self.compare(a, b)
        point, radius = self.split(b if len(b) >= len(a) else a)
        of_a, of_b = distance(self.values[a], point).astype(np.int64), distance(self.values[b], point).astype(np.int64)
        if len(b) >= len(a):
            parts = (a[of_a <= radius + self.bits], b[of_b <= radius]), (a[of_a > radius - self.bits], b[of_b > radius])
        else:
            parts = (a[of_a <= radius], b[of_b <= radius + self.bits]), (a[of_a > radius], b[of_b > radius - self.bits])
        if sum(len(x) * len(y) for x, y in parts) > 0.97 * len(a) * len(b):
            return self.compare(a, b)
        for x, y in parts:
            self.across(x, y)

    def compare(self, a: np.ndarray, b: np.ndarray) -> None:
        step = max(1, SMALL // len(b)) if len(b) else 1
        x, y = self.values[a], self.values[b]
        for k in range(0, len(a), step):
            close = distance(x[k : k + step, None], y[None, :]) <= self.bits
            if len(a) == len(b) and a is b:
                close &= a[k : k + step, None] < b[None, :]
            if close.any():
                self.forest.links(a[k : k + step], b, close)


def links(nodes: DataFrame, bits: int = BITS, shards: int = SHARDS, visitors: int = VISITORS_A_PART) -> DataFrame:
    """Edges (u, v) between distinct fingerprints that differ in at most `bits` bits: enough to connect all that is linked."""
    spark = nodes.sparkSession
    n = nodes.count()
    depth = max(shards - 1, n // NODES_A_SHARD).bit_length()
    # The sample is bounded by the number of shards; it shapes the tree and nothing else.
    sample = nodes.select("fingerprint").orderBy(F.xxhash64("fingerprint"), "fingerprint").limit(SAMPLE_A_SHARD << depth).collect()
    tree = VantageTree(np.array([r[0] for r in sample], np.int64).view(np.uint64), depth)
    shared = spark.sparkContext.broadcast(tree)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            home, (who, where) = shared.value.route(values.view(np.uint64), bits)
            shard = np.concatenate([home, where]).astype(np.int32)
            guest = np.concatenate([np.zeros(len(home), bool), np.ones(len(who), bool)])
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(guest), pa.array(np.concatenate([values, values[who]]))], ["shard", "guest", "fingerprint"])

    def search(group: pa.Table) -> pa.Table:
        values = group.column("fingerprint").to_numpy().astype(np.int64).view(np.uint64)
        guest = group.column("guest").to_numpy(zero_copy_only=False)
        first = group.num_rows > 0 and group.column("part")[0].as_py() == 0
        u, v = Shard(values[~guest], values[guest], bits, first).edges()
        return pa.table({"u": pa.array(u.view(np.int64), pa.int64()), "v": pa.array(v.view(np.int64), pa.int64())})

    routed = cut(nodes.select("fingerprint").mapInArrow(route, "shard int, guest boolean, fingerprint long"), "routed")
    # One row for each shard, and there are at most some 2 n / NODES_A_SHARD of them.
    sizes = routed.groupBy("shard").agg(F.ceil(F.count_if("guest") / visitors).cast("int").alias("parts"))
    dealt = routed.join(F.broadcast(sizes), "shard").withColumn("parts", F.greatest("parts", F.lit(1)))
    guests = dealt.where("guest").withColumn("part", F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int"))
    homes = dealt.where("NOT guest").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    parts = guests.unionByName(homes).select("shard", "part", "guest", "fingerprint")
    return parts.groupBy("shard", "part").applyInArrow(search, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge; root is the smallest node of its component.

    Large-star: a node's larger neighbours move to its smallest neighbour. Small-star: its smaller ones do, and itself.
    At rest every component is a star around its root.
    """

    def stars(both: DataFrame, large: bool) -> DataFrame:
        kept = both if large else both.where("v < u")
        # Written, so that the join has an exchange on both sides and a node with very many neighbours can be split.
        least = cut(kept.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        if large:
            return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = kept.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.unionByName(least.where("m < u").select("u", F.col("m").alias("v")))

    def state(df: DataFrame) -> tuple:
        """The number of edges and a sum of 128 bits of hash of each: equal for different sets of edges with probability 2^-128 or so."""
        parts = (F.sum(F.xxhash64("u", "v", F.lit(k)).cast("decimal(20,0)")) for k in (1, 2))
        return tuple(df.agg(F.count("*"), *parts).first())

    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = state(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stars(both, True).distinct()
        now = cut(stars(large, False).distinct(), "stars")
        before, seen = seen, state(now)
        if seen == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(df: DataFrame, text: str = "text", words: int = WORDS, bits: int = BITS) -> DataFrame:
    """doc_id, row_key, fingerprint (long), component_id and representative (the row key of the row that stands for the component) of every row."""
    rows = df.select("doc_id", row_key("doc_id", text_of(text)).alias("row_key"), text)
    prints = cut(with_fingerprints(rows, text, words), "fingerprints")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("best")
    nodes = cut(prints.groupBy("fingerprint").agg(best), "nodes")
    roots = components(links(nodes, bits))
    named = nodes.join(roots, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "best", F.coalesce("root", "fingerprint").alias("root"))
    named = cut(named, "named")
    least = cut(named.groupBy("root").agg(F.min("best").alias("least")), "least")
    classes = named.join(least, "root")
    classes = classes.select("fingerprint", F.col("least.doc_id").alias("component_id"), F.col("least.row_key").alias("representative"))
    return prints.join(classes, "fingerprint")


def keep_one(df: DataFrame, text: str = "text", words: int = WORDS, bits: int = BITS) -> DataFrame:
    """One row of each component, that of its smallest doc_id (a null one counts as the largest), with the columns of df."""
    keep = cut(near_duplicates(df, text, words, bits).where("row_key = representative").select("row_key").distinct(), "kept")
    rows = df.select(whole_rows(df).alias("row"), row_key("doc_id", text_of(text)).alias("row_key"))
    return rows.join(keep, "row_key", "left_semi").dropDuplicates(["row_key"]).select("row.*")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")

"""Near-dedup by shingle similarity: documents are linked if the Jaccard similarity of their sets of word shingles is at least
`percent` hundredths.

Words and shingle hashes are those of simhash; a text of fewer words is one shingle, one without words has none. Equal sets
are one node from the start. Candidates are the pairs that the vantage-point trees of simhash link by their fingerprints over
the same shingles, and those that share a band of a MinHash signature, as four bits reach few pairs below similarity 0.95 (at
0.8 a pair shares none of the 20 bands of five with probability 0.0004, at 0.85 with 0.00002). Every candidate pair is decided
by its true similarity, or is connected already by pairs that were: first each node of a bucket against the bucket's most
frequent one, then, in buckets that this does not connect, the rest against all others. Of these a pair is left out only if it
cannot be similar: by its sizes, or by its parities, a bitmap that holds for each slot whether an odd number of a set's hashes
fall into it. Slots in which two bitmaps differ are at most as many as the hashes that only one set has, so nothing is lost.
A dense group costs as many comparisons as it has nodes, not pairs, and a link that fails hides none that hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import bounded_batches, cut, row_key, text_of, whole_rows
from sievework.llm import simhash
from sievework.llm.simhash import SEED, components

WORDS, PERCENT = 5, 80
BANDS, ROWS = 20, 5
HASHES_AT_ONCE = 1 << 12

_draw = np.random.default_rng(42)
FACTORS = _draw.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _draw.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The distinct shingle hashes of a text, in order."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(found) <= words:
        return np.array([digest(join(found), SEED)] if found else [], np.uint64)
    n = len(found) - words + 1
    return np.unique(np.fromiter((digest(join(s), SEED) for s in zip(*(found[k:] for k in range(words)))), np.uint64, n))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The MinHash signature; of no length for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), HASHES_AT_ONCE):
        mixed = hashes[k : k + HASHES_AT_ONCE] * FACTORS[:, None] + OFFSETS[:, None]
        least = np.minimum(least, mixed.min(1))
    return least


def parities(hashes: np.ndarray) -> np.ndarray:
    """A bit for each slot, as signed longs: whether an odd number of hashes fall into it. There are as many slots as hashes, or up to twice."""
    slots = max(64, 1 << max(len(hashes) - 1, 0).bit_length())
    odd = np.bincount((hashes & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def least_difference(a: str, b: str) -> Column:
    """Slots in which two parities differ; those of the larger set, twice as many at most for sets that can be similar, are folded."""

    def folded(x: str, other: str) -> Column:
        half = F.size(other)
        fold = F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(x) == 2 * half, fold).otherwise(F.col(x))

    return F.aggregate(F.zip_with(folded(a, b), folded(b, a), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, n: total + n)


def bands(least: np.ndarray) -> list[int]:
    """One key for each band of a signature, as signed longs."""
    data = least.reshape(-1, ROWS)
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), b) for b, x in enumerate(data)], np.uint64).view(np.int64).tolist()


def with_signatures(rows: DataFrame, text: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, row_key, node (a key of the shingle set), n_shingles, bands, parity (see parities) and fingerprint (see simhash) of rows."""
    bounded_batches(rows.sparkSession)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, keys, prints, odd = [], [], [], [], []
            for x in batch.column(text).to_pylist():
                found = shingles(x or "", words)
                nodes.append(xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63))
                sizes.append(len(found))
                least = signature(found)
                keys.append(bands(least))
                odd.append(parities(found))
                prints.append(simhash.fingerprint(x or "", words))
            made = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64())), pa.array(np.array(prints, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), *made], ["doc_id", "row_key", "node", "n_shingles", "bands", "parity", "fingerprint"])

    return rows.mapInArrow(run, f"doc_id {id_type}, row_key binary, node long, n_shingles long, bands array<long>, parity array<long>, fingerprint long")


def with_sets(rows: DataFrame, text: str = "text", words: int = WORDS) -> DataFrame:
    """node and hashes (its shingle set) of rows with node and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x or "", words).view(np.int64) for x in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "hashes"])

    return rows.select("node", text).mapInArrow(run, "node long, hashes array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (u, v) of nodes whose shingle sets are similar enough."""
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("hashes").alias("_a")), "u")
    both = both.join(sets.select(F.col("node").alias("v"), F.col("hashes").alias("_b")), "v")
    both = both.withColumn("_common", F.size(F.array_intersect("_a", "_b")))
    union = F.size("_a") + F.size("_b") - F.col("_common")
    return both.where(100 * F.col("_common") >= percent * union).select("u", "v")


def tree_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (u, v) of nodes whose fingerprints are equal or linked by the vantage-point trees; nodes of no shingle have none."""
    some = nodes.where("n_shingles > 0").select("node", "fingerprint")
    first = cut(some.groupBy("fingerprint").agg(F.min("node").alias("u")), "fingerprints")
    equal = some.join(first, "fingerprint").where("node <> u").select("u", F.col("node").alias("v"))
    near = cut(simhash.links(first.select("fingerprint")), "tree-links")
    near = near.join(first.select(F.col("fingerprint").alias("u"), F.col("u").alias("a")), "u").join(first.select(F.col("fingerprint").alias("v"), F.col("u").alias("b")), "v")
    return equal.unionByName(near.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")))


def links(nodes: DataFrame, rows: DataFrame, text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Edges (u, v) between nodes of similar shingle sets: enough to connect all candidates that are similar."""
    raw = nodes.select("node", "n_shingles", F.explode("bands").alias("band"))
    sizes = raw.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = cut(raw.join(sizes, "band"), "buckets")
    # The centre of a bucket is the node that meets most others in all its buckets: of a text and its edited copies the text.
    known = cut(members.join(members.groupBy("node").agg(F.sum("n").alias("met")), "node"), "popular")
    centres = known.groupBy("band").agg(F.max(F.struct("met", "node"))["node"].alias("centre"))
    members = cut(known.drop("n", "met").join(centres, "band"), "centred")
    stars = members.where("node <> centre").select(F.least("centre", "node").alias("u"), F.greatest("centre", "node").alias("v"))
    stars = cut(stars.distinct(), "star-pairs")
    trees = cut(tree_pairs(nodes).distinct(), "tree-pairs")
    met = members.select("node").unionByName(trees.select(F.explode(F.array("u", "v")).alias("node"))).distinct()
    needed = nodes.join(met, "node", "left_semi").select("node", F.col("best.row_key").alias("row_key"))
    sets = cut(with_sets(rows.join(needed, "row_key").dropDuplicates(["node"]), text, words), "shingles")
    held = cut(verified(stars, sets, percent), "star-links")
    roots = components(held)
    # What the trees link is looked at only where the bands have not connected it already.
    root = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
    apart = trees.join(root("u"), "u", "left").join(root("v"), "v", "left").where(F.coalesce("root_u", "u") != F.coalesce("root_v", "v"))
    held = held.unionByName(cut(verified(cut(apart.select("u", "v"), "apart"), sets, percent), "tree-held"))
    labelled = members.join(roots, "node", "left").select("band", "node", "n_shingles", F.coalesce("root", "node").alias("label"))
    labelled = cut(labelled, "labelled")
    mixed = labelled.groupBy("band").agg(F.min("label").alias("_low"), F.max("label").alias("_high"), F.mode("label").alias("main"))
    labelled = labelled.join(mixed.where("_low <> _high").select("band", "main"), "band")
    labelled = cut(labelled.join(nodes.select("node", "parity", "bands"), "node"), "mixed")
    a = labelled.where("label <> main").select("band", *(F.col(c).alias("a_" + c) for c in ("node", "n_shingles", "label", "parity", "bands")))
    met = a.join(labelled, "band").where("a_label <> label and (label = main or a_node < node)")
    able = (100 + percent) * least_difference("parity", "a_parity") <= (100 - percent) * (F.col("n_shingles") + F.col("a_n_shingles"))
    first = F.get(F.array_intersect("bands", "a_bands"), F.lit(0)) == F.col("band")  # a pair of several buckets counts in one
    near = 100 * F.least("n_shingles", "a_n_shingles") >= percent * F.greatest("n_shingles", "a_n_shingles")
    met = met.where(F.when(near & first, able).otherwise(False))
    rest = met.select(F.least("a_node", "node").alias("u"), F.greatest("a_node", "node").alias("v")).distinct().join(stars, ["u", "v"], "left_anti")
    return held.unionByName(cut(verified(cut(rest, "rest-pairs"), sets, percent), "rest-links"))


def near_copies(df: DataFrame, text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, row_key, group (long) and representative (the row key of the row that stands for the group) of every row."""
    rows = df.select("doc_id", row_key("doc_id", text_of(text)).alias("row_key"), text)
    signed = cut(with_signatures(rows, text, words), "signatures")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("best")
    nodes = cut(signed.groupBy("node").agg(best, F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("parity").alias("parity"), F.first("fingerprint").alias("fingerprint")), "nodes")
    roots = components(links(nodes, rows, text, words, percent))
    named = cut(nodes.join(roots, "node", "left").select("node", "best", F.coalesce("root", "node").alias("group")), "named")
    least = cut(named.groupBy("group").agg(F.min("best").alias("least")), "least")
    classes = named.join(least, "group").select("node", "group", F.col("least.row_key").alias("representative"))
    return signed.join(classes, "node").select("doc_id", "row_key", "group", "representative")


def keep_one(df: DataFrame, text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each group, that of its smallest doc_id (a null one counts as the largest), with the columns of df."""
    keep = cut(near_copies(df, text, words, percent).where("row_key = representative").select("row_key").distinct(), "kept")
    rows = df.select(whole_rows(df).alias("row"), row_key("doc_id", text_of(text)).alias("row_key"))
    return rows.join(keep, "row_key", "left_semi").dropDuplicates(["row_key"]).select("row.*")

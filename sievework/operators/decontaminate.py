"""Decontamination: equal content, Jaccard similarity join by prefix filter, containment, first exclusion in file order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from sievework.functions.jsontext import canonical
from sievework.functions.sets import jaccard, missing
from sievework.functions.text import words
from sievework.operators import few
from sievework.operators.recovery import fields_of, object_of
from sievework.sources.cuts import cut
from sievework.sources.tables import is_small, small


def content_key(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def token_sets(df: DataFrame, key: str, text: Column, *blocks: str) -> DataFrame:
    """key, blocks, and tokens: the sorted distinct words."""
    return df.select(key, *blocks, F.sort_array(F.array_distinct(words(text))).alias("tokens"))


def classes(sets: DataFrame, key: str, *blocks: str) -> DataFrame:
    """One row for each distinct token set in a block: its smallest key as `class_id`, and the number of members."""
    return sets.groupBy(*blocks, "tokens").agg(F.min(key).alias("class_id"), F.count("*").alias("members"))


#: Slots of the hashed token counts, which every task holds; and lanes of 64 parity bits of a set.
SLOTS, LANES = 1 << 18, 4


def members(sets: DataFrame, key: str, *blocks: str) -> DataFrame:
    """key, class_id and members of the key's class (see classes). Digests of the sets are compared, so no tokens move."""
    rows = sets.select(key, *blocks, F.sha2(F.array_join("tokens", " "), 256).alias("_content"))
    found = rows.groupBy(*blocks, "_content").agg(F.min(key).alias("class_id"), F.count("*").alias("members"))
    return rows.join(found, [*blocks, "_content"]).select(key, "class_id", "members")


def prefixes(sets: DataFrame, key: str, threshold: float, *blocks: str) -> DataFrame:
    """key, blocks, size, token, parity: of each set the tokens that two sets above the threshold must share one of, as 64-bit
    hashes: the first n - ceil(threshold n) + 1 by rarity, then hash. Nothing is shuffled but the counts by hashed slot.

    Any one order of all tokens serves; that many tokens share a slot, or two a hash, costs pairs to look at, and loses none.
    """
    hashed = sets.where(F.size("tokens") > 0).select(key, *blocks, F.transform("tokens", lambda t: F.xxhash64(t)).alias("tokens"))
    slots = hashed.select(F.explode("tokens").alias("token")).groupBy(F.pmod("token", F.lit(SLOTS)).alias("slot")).agg(F.count("*").alias("n")).toArrow()
    counts = np.zeros(SLOTS, np.int64)
    counts[slots["slot"].to_numpy()] = slots["n"].to_numpy()

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few.slices(batches, few.ROWS):
            lists, row = few.flat(batch.column("tokens"))
            token = lists.to_numpy()
            size = np.bincount(row, minlength=batch.num_rows)
            begins = np.cumsum(size) - size
            order = np.lexsort((token, counts[token % SLOTS], row))
            kept = size - np.ceil(size * threshold - 1e-9).astype(np.int64) + 1
            first = order[np.arange(len(row)) - begins[row] < kept[row]]
            bit = np.left_shift(np.uint64(1), (token & 63).astype(np.uint64))
            lane = (token >> 6) & (LANES - 1)
            parity = [np.bitwise_xor.reduceat(np.where(lane == k, bit, np.uint64(0)), begins).view(np.int64) for k in range(LANES)] if len(row) else []
            owner = row[first]
            columns = [batch.column(c).take(pa.array(owner)) for c in (key, *blocks)]
            yield pa.record_batch([*columns, *(pa.array(x[owner]) for x in (size, *(parity or [size] * LANES))), pa.array(token[first])], schema.names)

    schema = StructType([*(few.typed(sets, c) for c in (key, *blocks)), *(StructField(c, LongType()) for c in ("size", *(f"p{k}" for k in range(LANES)), "token"))])
    return hashed.mapInArrow(rarest, schema)


def similar_pairs(sets: DataFrame, key: str, threshold: float, *blocks: str) -> DataFrame:
    """(a, b, similarity) with a < b, of sets in one block whose Jaccard similarity reaches the threshold. Exact.

    Give distinct sets (see classes): equal ones would otherwise be paired with one another again and again. Sets differ in no
    fewer tokens than their parities in bits, which rules out most pairs before they leave the join.
    """
    filtered = cut(sets.where(F.size("tokens") > 0).select(key, *blocks, "tokens"), "token-sets")
    left = prefixes(filtered, key, threshold, *blocks)
    right = left.select(F.col(key).alias("b"), *blocks, F.col("size").alias("size_b"), "token", *(F.col(f"p{k}").alias(f"q{k}") for k in range(LANES)))
    apart = sum((F.bit_count(F.col(f"p{k}").bitwiseXOR(F.col(f"q{k}"))) for k in range(1, LANES)), F.bit_count(F.col("p0").bitwiseXOR(F.col("q0"))))
    near = left.withColumnRenamed(key, "a").join(right, [*blocks, "token"]).where(
        (F.col("a") < F.col("b"))
        & (F.least("size", "size_b") >= F.lit(threshold) * F.greatest("size", "size_b") - 1e-9)
        & (apart <= (F.col("size") + F.col("size_b")) * F.lit((1 - threshold) / (1 + threshold)) + 1e-9)
    )
    pairs = cut(near.select("a", "b").distinct(), "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias(key)).distinct()
    tokens = filtered.select(key, "tokens").join(small(ends, pairs), key, "left_semi")
    joined = pairs.join(tokens.select(F.col(key).alias("a"), F.col("tokens").alias("ta")), "a").join(tokens.select(F.col(key).alias("b"), F.col("tokens").alias("tb")), "b")
    return joined.select("a", "b", jaccard(F.col("ta"), F.col("tb")).alias("similarity")).where(F.col("similarity") >= threshold)


#: How many of an item's rare tokens a document must share to be looked at, if so many are needed at all.
SHARED = 4


def holders(docs: DataFrame, items: DataFrame, doc: str, item: str, least: float) -> DataFrame:
    """(doc, item, td, ti): pairs that may share `least` of the item's tokens, with both token sets; none that does is missing.

    Such a document lacks at most n - ceil(least n) of an item's n tokens, so of the n - ceil(least n) + k that are rarest in
    the documents it has k. docs and items are token sets (see token_sets). Documents are dealt by key once, so that all
    further steps but the count of tokens stay where they are as long as the items are few.
    """
    dealt = docs.select(doc, F.col("tokens").alias("td")).repartition(doc)
    own = items.select(item, F.explode_outer("tokens").alias("token"), F.size("tokens").alias("n")).where("token IS NOT NULL")
    tokens = dealt.select(doc, F.explode_outer("td").alias("token")).where("token IS NOT NULL")
    asked = tokens.join(small(own.select("token").distinct(), items), "token", "left_semi")
    frequency = asked.groupBy("token").agg(F.count("*").alias("df"))
    needed = F.ceil(F.col("n") * F.lit(least)).cast("int")
    ranked = own.join(small(frequency, items), "token", "left").groupBy(item, "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token"))).alias("_t"))
    ranked = ranked.withColumn("k", F.least(F.greatest(needed, F.lit(1)), F.lit(SHARED)))
    kept = F.least(F.col("n") - needed + F.col("k"), F.col("n"))
    rare = ranked.select(item, "k", F.explode(F.transform(F.slice("_t", F.lit(1), kept), lambda x: x["token"])).alias("token"))
    near = tokens.join(small(rare, items), "token").groupBy(doc, item).agg(F.count("*").alias("hits"), F.first("k").alias("k")).where("hits >= k")
    return near.select(doc, item).join(dealt, doc).join(small(items.select(item, F.col("tokens").alias("ti"))), item)


def overlaps(docs: DataFrame, items: DataFrame, doc: str, item: str, least: float, lacking: bool = False) -> DataFrame:
    """(doc, item, common, n_doc, n_item): items of whose distinct tokens a document holds at least that share; with lacking
    also `missing`, the item's other tokens in order. With few items each task counts in the documents that it reads.
    """
    if is_small(items):
        return few.overlaps(docs, items, doc, item, least, lacking)
    common = F.size(F.array_intersect("ti", "td"))
    found = holders(docs, items, doc, item, least).where(common / F.size("ti") >= least)
    return found.select(doc, item, common.alias("common"), F.size("td").alias("n_doc"), F.size("ti").alias("n_item"), *([missing(F.col("ti"), F.col("td")).alias("missing")] if lacking else []))


def contained_items(docs: DataFrame, items: DataFrame, doc: str, item: str, least: float) -> DataFrame:
    """(doc, item, containment): items of whose distinct tokens a document holds at least that share."""
    return overlaps(docs, items, doc, item, least).select(doc, item, (F.col("common") / F.col("n_item")).alias("containment"))


def first_exclusion(candidates: DataFrame, doc: str, ordinal: str) -> DataFrame:
    """Of a document's matches the first in file order, whatever its kind."""
    place = F.row_number().over(Window.partitionBy(doc).orderBy(ordinal))
    return candidates.withColumn("_place", place).where("_place = 1").drop("_place")


def exclusion_matches(docs: DataFrame, items: DataFrame, doc: str, item: str, threshold: float, target: str | None = None, workflow: str | None = None) -> DataFrame:
    """(doc, item, reason): equal content, or Jaccard similarity from the threshold on. docs and items have tokens and content.

    With target and workflow (columns of both), only those are near that have the same target or the same workflow, if it is not blank.
    """
    exact = docs.join(small(items.select(item, "content"), items), "content").select(doc, item, F.lit("exact").alias("reason"))
    # So similar a document holds at least that share of the item, as the union is no smaller.
    found = overlaps(docs, items, doc, item, threshold)
    close = found.where(F.col("common") / (F.col("n_doc") + F.col("n_item") - F.col("common")) >= threshold).select(doc, item)
    kin = [c for c in (target, workflow) if c]
    if kin:
        close = close.join(docs.select(doc, *(F.col(c).alias(f"_d{k}") for k, c in enumerate(kin))), doc).join(items.select(item, *(F.col(c).alias(f"_i{k}") for k, c in enumerate(kin))), item)
        same = [F.col(f"_d{k}").eqNullSafe(F.col(f"_i{k}")) & (F.lit(c == target) | (F.coalesce(f"_d{k}", F.lit("")) != "")) for k, c in enumerate(kin)]
        close = close.where(same[0] if len(same) == 1 else same[0] | same[1])
    close = close.select(doc, item, F.lit("near").alias("reason"))
    return exact.unionByName(close).groupBy(doc, item).agg(F.min("reason").alias("reason"))


#: Keys of an intake that do not tell cases apart.
NOT_CLINICAL = ("responder_note", "target_protocol_card_hint")


def clinical(intake: Column) -> Column:
    """An intake in JSON without NOT_CLINICAL, keys in order; null unless it is an object."""
    fields = F.map_filter(fields_of(intake), lambda k, _: ~k.isin(*NOT_CLINICAL))
    return object_of(F.transform(F.array_sort(F.map_keys(fields)), lambda k: F.struct(k.alias("field"), F.try_element_at(fields, k).alias("value"))))


def clinical_hash(intake: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(canonical(clinical(intake)), 256))


def clinical_tokens(intake: Column) -> Column:
    """The distinct words of the intake's JSON, names of fields too, in order."""
    return F.sort_array(F.array_distinct(words(canonical(clinical(intake)))))

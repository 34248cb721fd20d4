"""Lookups and merges of keyed corpora: orphans, last writer wins, duplicates, label diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """df; a job over it fails if a key is missing or occurs twice. The check is part of the plan."""
    n = F.count("*").over(Window.partitionBy(key))
    checked = df.withColumn("_ok", F.assert_true(F.col(key).isNotNull() & (n == 1), F.concat(F.lit(f"duplicate or missing {key}: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))))
    return checked.where(F.col("_ok").isNull()).drop("_ok")


def union_unique(key: str, *frames: DataFrame) -> DataFrame:
    """The union of corpora; a duplicate or missing key is an error, not a row to drop."""
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame, allowMissingColumns=True)
    return require_unique(merged, key)


def duplicates(df: DataFrame, *keys: Column | str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def last_writer(key: str, *frames: DataFrame) -> DataFrame:
    """Of rows with one key the one from the latest frame; `source` is its number from 0."""
    merged = None
    for k, frame in enumerate(frames):
        marked = frame.withColumn("source", F.lit(k))
        merged = marked if merged is None else merged.unionByName(marked, allowMissingColumns=True)
    others = [c for c in merged.columns if c != key]
    newest = merged.groupBy(key).agg(F.max_by(F.struct(*others), "source").alias("_row"))
    return newest.select(key, "_row.*")


def first_source(key: str, *frames: DataFrame) -> DataFrame:
    """The multi-hop lookup: of rows with one key the one from the earliest frame."""
    return last_writer(key, *reversed(frames)).withColumn("source", F.lit(len(frames) - 1) - F.col("source"))


def lookup(rows: DataFrame, specs: DataFrame, key: Column, spec_key: str) -> DataFrame:
    """Left lookup of each row's spec; found tells whether there is one."""
    marked = specs.withColumn("found", F.lit(True))
    joined = rows.withColumn("_key", key).join(marked, F.col("_key") == F.col(spec_key), "left")
    return joined.withColumn("found", F.coalesce("found", F.lit(False))).drop("_key")


def orphans(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """side, key: the keys on one side only; a missing key has no equal. Both sides meet in one grouping."""
    marked = left.select(F.col(left_key).alias("key"), F.lit(1).alias("_on")).unionByName(right.select(F.col(right_key).alias("key"), F.lit(2).alias("_on")))
    found = marked.groupBy("key").agg(F.bit_or("_on").alias("_on")).where("_on < 3 OR key IS NULL")
    sides = F.filter(F.array(F.lit("left"), F.lit("right")), lambda _, i: F.col("_on").bitwiseAND(i + 1) > 0)
    return found.select(F.explode(sides).alias("side"), "key")


def label_diff(before: DataFrame, after: DataFrame, key: str, labels: list[str]) -> DataFrame:
    """key, label, before, after where they differ (null is a value); a key on one side only differs in all labels it has."""
    a = before.select(key, *(F.col(c).cast("string").alias(f"_b_{c}") for c in labels))
    b = after.select(key, *(F.col(c).cast("string").alias(f"_a_{c}") for c in labels))
    joined = a.join(b, key, "full_outer")
    pairs = F.array(*(F.struct(F.lit(c).alias("label"), F.col(f"_b_{c}").alias("before"), F.col(f"_a_{c}").alias("after")) for c in labels))
    return joined.select(key, F.inline(pairs)).where(~F.col("before").eqNullSafe(F.col("after")))


def shard_issues(rows: DataFrame, specs: DataFrame, version: str, shard: str = "shard", key: str = "case_id", row_version: str = "version") -> DataFrame:
    """side, shard, key, issue of whatever keeps shards from being merged: a missing or repeated id, another version (a spec
    without one is of the rows' version), a row without a spec, a spec without a row."""

    def of(df: DataFrame, side: str, found: Column) -> DataFrame:
        named = df.withColumn("_key", F.nullif(F.col(key).cast("string"), F.lit("")))
        lone = F.when(F.col("_key").isNull(), "missing_id")
        own = named.select(F.col(shard).alias("shard"), F.col("_key").alias("key"), F.array_compact(F.array(lone, F.when(~found, "version_mismatch"))).alias("_i"))
        again = duplicates(named.where("_key IS NOT NULL"), "_key").select(F.lit(None).cast(df.schema[shard].dataType).alias("shard"), F.col("_key").alias("key"), F.array(F.lit("duplicate_id")).alias("_i"))
        return own.unionByName(again).select(F.lit(side).alias("side"), "shard", "key", F.explode("_i").alias("issue"))

    same = F.coalesce(F.col(row_version) == version, F.lit(False))
    kept = [d.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "") for d in (rows, specs)]
    alone = orphans(kept[0], key, kept[1], key).select(F.when(F.col("side") == "left", "row").otherwise("spec").alias("side"), F.lit(None).cast(rows.schema[shard].dataType).alias("shard"), F.col("key").cast("string").alias("key"), F.when(F.col("side") == "left", "missing_spec").otherwise("orphan_spec").alias("issue"))
    return of(rows, "row", same).unionByName(of(specs, "spec", F.coalesce(F.nullif(F.col(row_version), F.lit("")) == version, F.lit(True)))).unionByName(alone)


def shard_statistics(rows: DataFrame, specs: DataFrame, manifests: DataFrame | None = None, shard: str = "shard") -> DataFrame:
    """shard, row_count, case_spec_count, attempts (of the shard's manifest; 0 without one); shards that only one side has are there too."""
    counted = lambda df, name: df.groupBy(shard).agg(F.count("*").alias(name))
    found = counted(rows, "row_count").join(counted(specs, "case_spec_count"), shard, "full")
    if manifests is not None:
        found = found.join(manifests.select(shard, F.col("attempts").alias("_attempts")), shard, "full")
    attempts = F.col("_attempts") if manifests is not None else F.lit(None)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return found.select(shard, *(zero(F.col(c)).alias(c) for c in ("row_count", "case_spec_count")), zero(attempts).alias("attempts"))


def merge_shards(rows: DataFrame, specs: DataFrame, version: str, shard: str = "shard", key: str = "case_id", shown: int = 10) -> tuple[DataFrame, DataFrame]:
    """rows and specs without their shard; an error that names the first issues if there are any (see shard_issues)."""
    found = shard_issues(rows, specs, version, shard, key).orderBy("issue", "side", "key").limit(shown).collect()
    if found:
        raise ValueError("shards cannot be merged: " + "; ".join(f"{r['side']} {r['key']}: {r['issue']}" for r in found))
    return rows.drop(shard), specs.drop(shard)

"""Quotas, schedules, splits and shards: selection by rank, without loops."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.functions.hashing import split_key
from sievework.operators.numbering import nth_smallest, number_rows
from sievework.sources.cuts import cut


def take_ranked(df: DataFrame, bucket: str, quota: Column | int, *order: Column) -> DataFrame:
    """The first `quota` rows of each bucket, with their place."""
    place = F.row_number().over(Window.partitionBy(bucket).orderBy(*order))
    return df.withColumn("place", place).where(F.col("place") <= (quota if isinstance(quota, Column) else F.lit(quota)))


def quota_select(df: DataFrame, targets: DataFrame, bucket: str, order: list[Column], fill: bool = False, fill_order: list[Column] | None = None) -> DataFrame:
    """Rows within their bucket's target; with fill, the next rows of all buckets make up the total that is short.

    reason is `quota` or `fill`.
    """
    ranked = df.withColumn("place", F.row_number().over(Window.partitionBy(bucket).orderBy(*order))).join(F.broadcast(targets), bucket, "left")
    ranked = ranked.withColumn("target", F.coalesce("target", F.lit(0)))
    chosen = ranked.where(F.col("place") <= F.col("target")).withColumn("reason", F.lit("quota"))
    if not fill:
        return chosen
    total = targets.agg(F.sum("target").alias("wanted"))
    short = total.crossJoin(chosen.agg(F.count("*").alias("have"))).select(F.greatest(F.col("wanted") - F.col("have"), F.lit(0)).alias("short"))
    rest = ranked.where(F.col("place") > F.col("target"))
    limit = short.first()["short"] or 0  # one number
    extra = rest.orderBy(*(fill_order or order)).limit(int(limit)).withColumn("reason", F.lit("fill"))
    return chosen.unionByName(extra)


def shortages(selected: DataFrame, targets: DataFrame, bucket: str) -> DataFrame:
    """For each bucket its target, what was selected, and what is missing, never below 0."""
    counts = selected.groupBy(bucket).agg(F.count("*").alias("selected"))
    joined = targets.join(counts, bucket, "left").withColumn("selected", F.coalesce("selected", F.lit(0)).cast("long"))
    return joined.withColumn("shortage", F.greatest(F.col("target") - F.col("selected"), F.lit(0)).cast("long"))


def stratified_split(df: DataFrame, key: str, strata: list[str], fraction: float, seed: str, least_group: int = 2) -> DataFrame:
    """split = validation or train. A stratum of n >= least_group rows gives min(max(1, n x fraction, half to even), n - 1) rows to validation: those of least seeded hash."""
    group = Window.partitionBy(*strata)
    n = F.count("*").over(group)
    place = F.row_number().over(group.orderBy(split_key(seed, F.col(key)), key))
    wanted = F.least(F.greatest(F.lit(1), F.bround(n * F.lit(fraction), 0).cast("int")), (n - 1).cast("int"))
    wanted = F.when((n < least_group) | F.lit(fraction <= 0), F.lit(0)).otherwise(wanted)
    marked = df.withColumns({"_n": wanted, "_place": place})
    return marked.withColumn("split", F.when(F.col("_place") <= F.col("_n"), "validation").otherwise("train")).drop("_n", "_place")


def weighted_schedule(targets: DataFrame, name: str, order: str) -> DataFrame:
    """position, name: repeatedly the class with the largest remaining share of its target, the earlier class among equals.

    Each class's heads are (target - k) / target, strictly falling, so the loop is a merge of sorted lists: one sort, numbered by ranges.
    """
    units = targets.where("target > 0").select(name, order, "target", F.explode(F.sequence(F.lit(0), F.col("target") - 1)).alias("k"))
    head = (F.col("target") - F.col("k")) / F.col("target")
    return number_rows(units.withColumn("_head", head), F.desc("_head"), order, "k", into="position").select(F.col("position").cast("int").alias("position"), name)


def apportion(weights: DataFrame, name: str, order: str, total: int) -> DataFrame:
    """Largest remainders: floors of the shares, the leftover to the largest fractions, the earlier class among equals."""
    whole = Window.partitionBy()
    share = F.col("weight") * F.lit(total) / F.sum("weight").over(whole)
    rows = weights.withColumn("_share", share).withColumn("_floor", F.floor("_share").cast("long"))
    rows = rows.withColumn("_left", F.lit(total) - F.sum("_floor").over(whole))
    place = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("_share") - F.col("_floor"), 9)), order))
    rows = rows.withColumn("_place", place)
    return rows.select(name, order, (F.col("_floor") + F.when(F.col("_place") <= F.col("_left"), 1).otherwise(0)).alias("target"))


def slot_class(index: Column, weights: list[tuple[str, int]]) -> Column:
    """The class of an index: its place in the cycle against the cumulative weights."""
    cycle = sum(w for _, w in weights)
    slot, at, out = F.pmod(index, F.lit(cycle)), 0, None
    for name, weight in weights:
        at += weight
        out = F.when(slot < at, F.lit(name)) if out is None else out.when(slot < at, F.lit(name))
    return out


def shard_of(index: Column, shards: int) -> Column:
    return F.pmod(index, F.lit(shards)).cast("int")


def shard_specs(total: int, shards: int) -> list[tuple[int, int, int]]:
    """(shard, start, count) of equal shards by ceiling division; the last ones take the rest."""
    size = -(-total // shards) if shards else 0
    return [(k, k * size, max(0, min(size, total - k * size))) for k in range(shards)]


def best_by(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """The best row of each group; order decides, first is best."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def accepted_first(df: DataFrame, accepted: Column, index: str, count: int) -> DataFrame:
    """What a loop that goes on until `count` are accepted keeps: the first accepted by index."""
    return df.where(accepted).orderBy(index).limit(max(0, count))


@dataclass(frozen=True)
class Attempts:
    """What a loop of attempts made: the accepted rows, how often each reason rejected, how many attempts there were."""

    accepted: DataFrame
    rejections: DataFrame
    made: int
    taken: int


def accept_until(df: DataFrame, key: str, index: str, reason: str, count: int, most: int | None = None, done: DataFrame | None = None) -> Attempts:
    """Attempts in the order of index until `count` rows are accepted or `most` attempts are made (4 times count by default).

    A row is accepted if its reason is null, and passed over without a reason if its key has been accepted by an earlier
    attempt or stands in done (which counts towards count, as a resumed run does). index is a whole number, one a row. The
    loop's end is found from counts by ranges of the index, so nothing is sorted: the attempt that brings the last
    acceptance is the n-th smallest index of the first acceptances. What follows it is neither kept nor tallied.
    """
    had = 0 if done is None else done.select(key).distinct().count()
    most = 4 * count if most is None else most
    wanted = count - had
    empty = df.where(F.lit(False))
    if wanted <= 0 or most <= 0:
        return Attempts(empty, empty.select(F.col(reason).alias("reason"), F.lit(0).cast("long").alias("n")), 0, had)
    last = nth_smallest(df, index, most)
    tried = df if last is None else df.where(F.col(index) <= last)
    if done is not None:
        tried = tried.join(done.select(key).distinct().withColumn("_done", F.lit(True)), key, "left")
    else:
        tried = tried.withColumn("_done", F.lit(None).cast("boolean"))
    good = tried.where(F.col(reason).isNull() & F.col("_done").isNull()).groupBy(key).agg(F.min(index).alias("_first"))
    tried = cut(tried.join(good.withColumnRenamed(key, "_key"), F.col(key) == F.col("_key"), "left").drop("_key"), "attempts")
    takes = tried.where(F.col(index) == F.col("_first"))
    end = nth_smallest(takes, index, wanted)
    if end is not None:
        tried, takes = tried.where(F.col(index) <= end), takes.where(F.col(index) <= end)
    # A key that has been accepted is passed over before it is judged.
    judged = tried.where(F.col(reason).isNotNull() & F.col("_done").isNull() & (F.col("_first").isNull() | (F.col(index) < F.col("_first"))))
    rejections = judged.groupBy(F.col(reason).alias("reason")).agg(F.count("*").alias("n"))
    return Attempts(takes.select(*df.columns), rejections, tried.count(), had + takes.count())

"""Lexical retrieval: substring scorer, BM25 over postings, choice of engine with fallback, forced cards.

Arrays are exploded as outer ones and nulls dropped: of a plain explode the optimizer infers a filter on the array's size,
and with it computes the array twice.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.functions.text import occurrences, query_terms, words
from sievework.operators import few
from sievework.sources.cuts import cut
from sievework.sources.tables import is_small, small

#: Fixed values of the scorers.
TITLE_WEIGHT = 4
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
FORCED_SCORE = 999.0
MOST_RESULTS = 10


def clamp(limit: int) -> int:
    return max(1, min(MOST_RESULTS, limit))


def top(scored: DataFrame, query: str, key: str, limit: int) -> DataFrame:
    """The best `limit` rows of each query: highest score, then smallest key, with their rank from 1."""
    order = Window.partitionBy(query).orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def term_counts(queries: DataFrame, query: str, text: str) -> DataFrame:
    """(query, term, times) of each query's terms."""
    return queries.select(query, F.explode_outer(query_terms(F.col(text))).alias("term")).where("term IS NOT NULL").groupBy(query, "term").agg(F.count("*").alias("times"))


def term_scores(queries: DataFrame, docs: DataFrame, query: str, key: str, query_text: str, body: Column, title: Column | None = None) -> DataFrame:
    """(query, key, score): each query term's substring count in the body, and TITLE_WEIGHT times that in the title; positive scores only.

    A term is letters and digits only, so each place where it stands lies within one word. The substrings of the distinct
    words that have the length of a term meet the terms in an equi-join; no text is searched once for each term. Documents
    are dealt by key once; with few queries all that follows but the vocabulary stays where it is.
    """
    wanted = term_counts(queries, query, query_text)
    dealt = docs.repartition(key)
    sides = [F.transform(words(body), lambda t: F.struct(t.alias("token"), F.lit(1).alias("w")))]
    if title is not None:
        sides.append(F.transform(words(title), lambda t: F.struct(t.alias("token"), F.lit(TITLE_WEIGHT).alias("w"))))
    tokens = dealt.select(key, F.explode_outer(F.concat(*sides)).alias("t")).select(key, "t.token", "t.w").where(F.length("token") > 1)
    counted = tokens.groupBy(key, "token").agg(F.sum("w").alias("w"))
    token, terms = F.col("token"), wanted.select("term").distinct()
    lengths = small(terms.agg(F.array_sort(F.collect_set(F.length("term"))).alias("lengths")))
    fitting = tokens.select("token").distinct().crossJoin(F.broadcast(lengths)).select("token", F.filter("lengths", lambda n: n <= F.length("token")).alias("lengths"))
    cuts = F.transform("lengths", lambda n: F.transform(F.sequence(F.lit(1), F.length("token") - n + 1), lambda i: token.substr(i, n)))
    parts = fitting.select("token", F.explode_outer(F.array_distinct(F.flatten(cuts))).alias("term")).where("term IS NOT NULL")
    hits = parts.join(small(terms, queries), "term").select("token", "term", occurrences(F.col("token"), F.col("term")).alias("n"))
    found = counted.join(hits, "token").select(key, "term", "w", "n").repartition(key).groupBy(key, "term").agg(F.sum(F.col("w") * F.col("n")).alias("n"))
    scored = found.join(small(wanted, queries), "term").groupBy(query, key)
    return scored.agg(F.sum(F.col("n") * F.col("times")).cast("double").alias("score")).where("score > 0")


def best_by_terms(queries: DataFrame, docs: DataFrame, query: str, key: str, query_text: str, body: Column, limit: int, title: Column | None = None) -> DataFrame:
    """The best `limit` rows of term_scores (see top). With few queries each task ranks the documents that it reads, and nothing else moves."""
    if is_small(queries):
        scored = few.best(docs, term_counts(queries, query, query_text), query, key, limit, words(body), title if title is None else words(title), TITLE_WEIGHT)
    else:
        scored = term_scores(queries, docs, query, key, query_text, body, title)
    return top(scored, query, key, limit)


def best_by_bm25(queries: DataFrame, docs: DataFrame, query: str, key: str, query_text: str, body: Column, limit: int) -> DataFrame:
    """The best `limit` rows of bm25_scores, rounded to six digits (see top). With few queries each task ranks the documents that it reads."""
    if not is_small(queries):
        scored = bm25_scores(queries, docs, query, key, query_text, body)
    else:
        wanted = term_counts(queries, query, query_text)
        seen = docs.select(words(body).alias("w"))
        held = seen.select(F.explode_outer(F.array_distinct("w")).alias("term")).join(F.broadcast(wanted.select("term").distinct()), "term", "left_semi")
        corpus = seen.agg(F.count("*").alias("n_docs"), F.avg(F.size("w")).alias("mean_size"))
        frequency = held.groupBy("term").agg(F.count("*").alias("df"))
        weights = cut(wanted.join(frequency, "term").crossJoin(F.broadcast(corpus)).select(query, "term", (F.col("times") * idf_of(F.col("n_docs"), F.col("df"))).alias("weight"), "mean_size"), "weights")
        mean = weights.agg(F.max("mean_size")).first()[0]
        scored = few.best(docs, weights.drop("mean_size"), query, key, limit, words(body), tf_of=(K1, B, mean))
    return top(scored.withColumn("score", F.round("score", 6)), query, key, limit)


def postings(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, term, tf, size): the inverted index; see write_index to keep it."""
    found = docs.select(key, words(text).alias("w"))
    return found.select(key, F.size("w").alias("size"), F.explode_outer("w").alias("term")).where("term IS NOT NULL").groupBy(key, "term", "size").agg(F.count("*").alias("tf"))


def idf_of(n_docs: Column, df: Column) -> Column:
    idf = F.log((n_docs - df + 0.5) / (df + 0.5))
    return F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)


def bm25_of(asked: DataFrame, wanted: DataFrame, corpus: DataFrame, queries: DataFrame, query: str, key: str) -> DataFrame:
    """(query, key, score) from the postings of query terms, the terms of queries, and one row of n_docs and mean_size."""
    frequency = asked.groupBy("term").agg(F.count("*").alias("df"))
    idf = idf_of(F.col("n_docs"), F.col("df"))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean_size")))
    terms = wanted.join(frequency, "term").crossJoin(F.broadcast(corpus)).select(query, "term", "times", idf.alias("idf"), "mean_size")
    rows = asked.join(small(terms, queries), "term")
    return rows.groupBy(query, key).agg(F.sum(F.col("times") * F.col("idf") * weight).alias("score"))


def bm25_scores(queries: DataFrame, docs: DataFrame, query: str, key: str, query_text: str, body: Column) -> DataFrame:
    """(query, key, score): BM25 summed over query terms with their repetition; terms in half of the documents or more keep a tiny weight.

    No text is shuffled: words that no query asks for are dropped where the document is read, the rest counted there first.
    """
    wanted = term_counts(queries, query, query_text)
    found = docs.select(key, words(body).alias("w")).select(key, F.size("w").alias("size"), F.explode_outer("w").alias("term")).where("term IS NOT NULL")
    asked = found.join(small(wanted.select("term").distinct(), queries), "term", "left_semi").groupBy(key, "term", "size").agg(F.count("*").alias("tf"))
    corpus = docs.select(F.size(words(body)).alias("size")).agg(F.count("*").alias("n_docs"), F.avg("size").alias("mean_size"))
    return bm25_of(asked, wanted, corpus, queries, query, key)


#: Buckets of a kept index, by term.
BUCKETS = 64


def write_index(docs: DataFrame, key: str, body: Column, table: str, segment: str, buckets: int = BUCKETS) -> None:
    """Adds documents to a kept index: postings bucketed and sorted by term, and the segment's size.

    A segment (a batch of documents that no other holds) is not there until its line in `<table>_segments` is written, last
    and as one file; what a failed or repeated writer left is told by its attempt's name and never read. So readers see whole
    segments only, and adding documents rebuilds nothing.
    """
    spark = docs.sparkSession
    attempt = f"{segment}-{uuid.uuid4().hex}"
    rows = postings(docs, key, body).withColumn("segment", F.lit(attempt))
    dealt = rows.repartition(buckets, "term").sortWithinPartitions("term")
    dealt.write.bucketBy(buckets, "term").sortBy("term").format("parquet").mode("append").saveAsTable(f"{table}_postings")
    size = docs.agg(F.count("*").alias("n_docs"), F.sum(F.size(words(body))).cast("long").alias("n_terms"))
    size.select(F.lit(segment).alias("segment"), F.lit(attempt).alias("attempt"), "n_docs", "n_terms", F.current_timestamp().alias("written")).coalesce(1).write.format("parquet").mode("append").saveAsTable(f"{table}_segments")
    spark.catalog.refreshTable(f"{table}_postings")


def indexed_scores(queries: DataFrame, table: str, query: str, key: str, query_text: str) -> DataFrame:
    """bm25_scores from a kept index. Its buckets are by term, so a join with many terms moves the terms, not the postings."""
    spark = queries.sparkSession
    # A segment that was written again counts as it was written last.
    live = spark.table(f"{table}_segments").groupBy("segment").agg(F.max_by(F.struct("attempt", "n_docs", "n_terms"), F.struct("written", "attempt")).alias("_s")).select("_s.*")
    corpus = live.agg(F.sum("n_docs").alias("n_docs"), F.try_divide(F.sum("n_terms").cast("double"), F.sum("n_docs")).alias("mean_size"))
    wanted = term_counts(queries, query, query_text)
    asked = spark.table(f"{table}_postings").join(small(wanted.select("term").distinct(), queries), "term", "left_semi")
    asked = asked.join(F.broadcast(live.select(F.col("attempt").alias("segment"))), "segment", "left_semi").drop("segment")
    return bm25_of(asked, wanted, corpus, queries, query, key)


def with_fallback(first: DataFrame, second: DataFrame, queries: DataFrame, query: str, names: tuple[str, str]) -> DataFrame:
    """Rows of the first engine, and of the second for the queries that the first gave nothing; source tells which."""
    rest = queries.select(query).join(first.select(query).distinct(), query, "left_anti")
    filled = second.join(rest, query, "left_semi")
    return first.withColumn("source", F.lit(names[0])).unionByName(filled.withColumn("source", F.lit(names[1])))


def source_summary(rows: DataFrame, queries: DataFrame, query: str) -> DataFrame:
    """For each query its number of results and `primary`: the one source, mixed, or none."""
    found = rows.groupBy(query).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("source")).alias("sources"))
    joined = queries.select(query).join(found, query, "left")
    size = F.coalesce(F.size("sources"), F.lit(0))
    primary = F.when(size <= 0, F.lit("none")).when(size == 1, F.get("sources", F.lit(0))).otherwise(F.lit("mixed"))
    return joined.select(query, F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.when(F.col("sources").isNull(), F.lit("none")).otherwise(primary).alias("primary"))


def forced_first(ranked: DataFrame, required: DataFrame, query: str, key: str, limit: int) -> DataFrame:
    """Required keys first, in their order (`ordinal`), scored FORCED_SCORE if not retrieved; then the others by rank; cut at limit."""
    own = ranked.select(query, key, F.lit(1).alias("_group"), F.col("rank").alias("_place"), "score")
    must = required.select(query, key, F.lit(0).alias("_group"), F.col("ordinal").alias("_place"), F.lit(None).cast("double").alias("score"))
    merged = own.unionByName(must).groupBy(query, key).agg(
        F.min(F.struct("_group", "_place")).alias("_at"), F.coalesce(F.max("score"), F.lit(FORCED_SCORE)).alias("score")
    )
    order = Window.partitionBy(query).orderBy("_at", key)
    return merged.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit).select(query, key, "position", "score")

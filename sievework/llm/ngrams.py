"""Stupid-backoff scores of documents by an n-gram model of the whole corpus, computed relationally.

Words are those of the line rules (ASCII white space, A-Z lower-cased), as 64-bit hashes; before a text stand ORDER - 1
start words. c(v..w) counts the n-gram in all documents and c(v.._) its context followed by any word. The very occurrence
that is scored is left out of both: an n-gram seen more than once scores ln((c(v..w) - 1) / (c(v.._) - 1)), any other
BACKOFF times what the next shorter one scores; a word alone scores c(w) / N. Nothing is pruned. Each score is a
whole number of millionths, so a document's sum does not depend on the order of adding.

The relations, each a DataFrame:

1. tokens: a row number and the array of word hashes of each document, written once, as codes of a dictionary for each file.
2. words: the count of each word, by map-side sums.
3. grams: tokens exploded to (row, contexts of 1 to ORDER - 1 words, word); contexts are 64-bit hashes.
4. grams dealt by their last context word, so that all that a context of any length is followed by is in one partition. There
   windows over context and word give each occurrence both its counts, for one order after another. So an occurrence is
   shuffled once, and no count table is joined back to the text.
5. What is seen more than once at no order gets its word's share: of common words, fewer than COMMON, from a broadcast, of
   others by a join with words. All is summed by row, then joined to the documents' ids.

Context words that make up more than 1 / HOT of all are not dealt to one task: their n-grams are counted by map-side sums, and
the counts joined to the occurrences.

The grams of steps 3 to 5 whose last context word falls into one of PASSES ranges are done together, then the next range:
counts stay whole, and the shuffles on disk at one time are a fraction of all. PASSES is fixed, so the work is proportional
to the corpus.

Null and empty texts have no words and score 0. Repeated rows are documents of their own, as they are to the counts. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.llm.common import cut, discard, latin_lower, text_of

ORDER, BACKOFF = 3, 0.4
PASSES = 4
#: Context words of a larger share than 1 / HOT are counted apart; the scores of words of a larger share than 1 / COMMON, fewer
#: than so many, go to every task, two numbers each.
HOT, COMMON = 32, 1 << 18
MILLION = 1e6
#: The start word's hash; a word's own hash may equal it as it may equal any other's.
START = 1
GAP = r"[\x20\x09-\x0D]+"
#: Parquet keeps a file's words as codes only while its dictionary is no larger than this, by default 1 MB.
CODED = {"parquet.dictionary.page.size": 16 << 20}


def word_hashes(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(latin_lower(text), GAP, -1), ""), lambda w: F.xxhash64(w))


def grams(tokens: DataFrame, order: int) -> DataFrame:
    """row, w and c1 to c(order - 1): the hash of so many words before."""
    n = F.size("words")
    shifted = [F.slice(F.concat(F.array_repeat(F.lit(START).cast("long"), k), "words"), F.lit(1), n).alias(f"b{k}") for k in range(1, order)]
    rows = tokens.where(n > 0).select("row", F.inline(F.arrays_zip(F.col("words").alias("w"), *shifted)))
    contexts = {f"c{k}": F.xxhash64(*(f"b{j}" for j in range(k, 0, -1))) if k > 1 else F.col("b1") for k in range(1, order)}
    return rows.select("row", "w", *(c.alias(name) for name, c in contexts.items()))


def micro(ratio: Column, steps: int, backoff: float) -> Column:
    """A score in millionths after so many backoffs."""
    return F.round(MILLION * F.ln(ratio * F.lit(backoff**steps))).cast("long")


def counted(grams: DataFrame, k: int) -> DataFrame:
    """grams with n, how often the word follows the context of k words, and x, how often any does. The grams of one c1 are all here and in one partition."""
    by = Window.partitionBy(*dict.fromkeys((f"c{k}", "c1"))).orderBy("w")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = by.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return grams.withColumns({"n": F.count("*").over(upto) - F.rank().over(by) + 1, "x": F.count("*").over(whole)})


def counted_apart(grams: DataFrame, own: DataFrame, whole: DataFrame, k: int) -> DataFrame:
    """As counted, by sums and joins: own are the grams to count, those of some words; whole are all grams of their contexts. What is seen once has no n."""
    context = f"c{k}"
    pairs = own.groupBy(context, "w").agg(F.count("*").alias("n")).where("n > 1")
    return grams.join(pairs.join(whole.groupBy(context).agg(F.count("*").alias("x")), context), [context, "w"], "left")


def scored(grams: DataFrame, counts: Callable[[DataFrame, int], DataFrame], order: int, backoff: float) -> DataFrame:
    """(row, w, micro, backed): micro has the score of what is seen more than once at some order, w the word of anything else."""
    found = grams.select("*", F.lit(None).cast("long").alias("micro"), F.lit(None).cast("int").alias("backed"))
    for steps, k in enumerate(range(order - 1, 0, -1)):
        seen = counts(found, k)
        again, ratio = F.coalesce(F.col("n") > 1, F.lit(False)), (F.col("n") - 1) / (F.col("x") - 1)
        micros = F.coalesce("micro", F.when(again, micro(ratio, steps, backoff)))
        backed = F.coalesce("backed", F.when(again, 0).otherwise(1))
        found = seen.select("row", "w", *(f"c{j}" for j in range(1, max(k, 2))), micros.alias("micro"), backed.alias("backed"))
    return found.select("row", F.when(F.col("micro").isNull(), F.col("w")).alias("w"), "micro", "backed")


def frequent(tokens: DataFrame, words: DataFrame, total: int, hot: int) -> list[int]:
    """The context words that make up more than 1 / hot of all: no more than so many, and the start word."""
    most = total // hot
    starts = tokens.where(F.size("words") > 0).count()
    return [r.w for r in words.where(F.col("n") > most).select("w").collect()] + [START] * (starts > most)


def backoff_scores(df: DataFrame, text: str = "text", order: int = ORDER, backoff: float = BACKOFF, passes: int = PASSES, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_backoff (words whose longest n-gram is seen nowhere else) and score_micro (sum of log scores, in millionths) of every row."""
    if order < 2:
        raise ValueError("the order must be 2 or more")
    tokens = cut(df.select(F.monotonically_increasing_id().alias("row"), "doc_id", word_hashes(text_of(text)).alias("words")), "tokens", **CODED)
    words = cut(tokens.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n")), "words")
    total = words.agg(F.sum("n")).first()[0] or 1
    alone = micro(F.col("n") / F.lit(float(total)), order - 1, backoff)
    single, common = words.select("w", alone.alias("micro")), F.broadcast(words.where(F.col("n") > total // COMMON).select("w", alone.alias("common")))
    often = frequent(tokens, words, total, hot)
    apart = grams(tokens, order).where(F.col("c1").isin(often))
    parts = []
    for k in range(passes):
        here = grams(tokens, order).where((F.pmod("c1", F.lit(passes)) == k) & ~F.col("c1").isin(often))
        made = [scored(here.repartition("c1"), counted, order, backoff)]
        if often:
            own = apart.where(F.pmod("w", F.lit(passes)) == k)
            made.append(scored(own, lambda found, j, own=own: counted_apart(found, own, apart, j), order, backoff))
        for found in made:
            known = F.coalesce("micro", "common")
            found = cut(found.join(common, "w", "left").select("row", F.when(known.isNull(), F.col("w")).alias("w"), known.alias("micro"), "backed"), "found")
            ready = found.where("micro IS NOT NULL").select("row", "micro", "backed")
            rest = found.where("micro IS NULL").select("row", "w", "backed").join(single, "w").select("row", "micro", "backed")
            parts.append(cut(ready.unionByName(rest).groupBy("row").agg(F.sum("backed").alias("backed"), F.sum("micro").alias("micro")), "sums"))
            discard(found)
    sums = reduce(DataFrame.unionByName, parts).groupBy("row").agg(F.sum("backed").alias("backed"), F.sum("micro").alias("micro"))
    zero = F.lit(0).cast("long")
    found = tokens.select("row", "doc_id", F.size("words").cast("long").alias("n_words")).join(sums, "row", "left")
    return found.select("doc_id", "n_words", F.coalesce("backed", zero).alias("n_backoff"), F.coalesce("micro", zero).alias("score_micro"))

"""Quality rules with DataFrame functions only: counts within each document, and cross-document line frequency.

Within a document: words, their characters, symbols, lines equal to an earlier one, words in repeated windows of eight.
All is done in the row, with sorted arrays, so no window is ever shuffled.

Across documents, for each host (the source column): normalised lines are hashed and the distinct documents counted that
have them. The limit is LIMIT documents, whatever the host's size. Documents with equal texts count once, and a document
counts only if OWN of its words stand outside the lines that reach the limit at first: so neither a page copied many times
nor a group of near copies, which share most of their lines, condemns itself (that is the business of deduplication),
while a footer below different texts is counted in full. Boilerplate lines are taken out; a document that keeps less than
KEEP of its words is depleted and rejected.

Null texts have no words and fail the base rules. Null hosts are one host. Repeated rows get equal results. Other columns
pass through, whatever their names; of columns named like a result the result stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import WHITE, cut, latin_lower, text_of, whole_rows

#: Fixed values of the rules.
GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
LEAST_WORDS, WINDOW, REPEATED = 20, 8, 30
LIMIT, OWN, KEEP = 10, 0.75, 0.5
NUMBERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
VERDICT = ("n_left_words", "kept")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, GAP, -1), lambda w: w != "")


def with_numbers(rows: DataFrame) -> DataFrame:
    """rows, whose columns are `row` or keys and `body`, with NUMBERS; body goes."""
    before = [c for c in rows.columns if c != "body"]
    body = F.col("body")
    rows = rows.withColumn("_words", words_of(body)).withColumn("_n", F.size("_words"))
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    rows = rows.withColumn("_lines", lines)
    windows = F.when(
        F.col("_n") > WINDOW,
        F.transform(F.sequence(F.lit(0), F.col("_n") - WINDOW), lambda i: F.xxhash64(*(F.get(F.col("_words"), i + k) for k in range(WINDOW)))),
    )
    rows = rows.withColumn("_windows", windows)
    # Only rows with an equal pair of windows go on; equal neighbours in sorted order give the starts of repeated windows.
    placed = F.when(
        F.size(F.array_distinct("_windows")) < F.size("_windows"),
        F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )
    rows = rows.withColumn("_placed", placed)
    same = F.zip_with(F.slice("_placed", 1, F.size("_placed") - 1), F.slice("_placed", 2, F.size("_placed") - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    rows = rows.withColumn("_starts", F.array_sort(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull())))))
    covered = F.zip_with(
        F.col("_starts"),
        F.slice("_starts", 2, F.greatest(F.size("_starts") - 1, F.lit(0))),
        lambda a, b: F.when(b.isNull(), F.lit(WINDOW)).otherwise(F.least(b - a, F.lit(WINDOW))),
    )
    n_repeat = F.coalesce(F.aggregate(covered, F.lit(0), lambda s, x: s + x), F.lit(0))
    rows = rows.withColumn("n_repeat_words", n_repeat.cast("long"))
    rows = rows.withColumns(
        {
            "n_words": F.col("_n").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count(body, F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        }
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    return rows.select(*before, *NUMBERS)


def passed(df: DataFrame, *names: str) -> list[Column]:
    """The columns of df out of `row`, but for those that results replace."""
    return [F.col("row").getField(c).alias(c) for c in df.columns if c not in names]


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed."""
    rows = with_numbers(df.select(whole_rows(df).alias("row"), text_of(text).alias("body")))
    return rows.select(*passed(df, *NUMBERS), *NUMBERS)


def keyed(df: DataFrame, text: str, host: str, *more: Column) -> DataFrame:
    """host (as a struct, so that null is a value), text_key, body and what else is asked for."""
    body = text_of(text)
    return df.select(*more, F.struct(F.col(host).alias("name")).alias("host"), F.unhex(F.md5(body.cast("binary"))).alias("text_key"), body.alias("body"))


def boilerplate(texts: DataFrame, sizes: DataFrame, limit: int = LIMIT, own: float = OWN) -> DataFrame:
    """For each host and text key the number of words in boilerplate lines, and dropped: their positions; texts without any are left out.

    texts: see keyed; sizes: host, text_key and n_words, one row for each.
    """
    raw = F.transform(F.split(F.col("body"), "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)))
    # An outer explode: of a plain one the optimizer infers a filter on the size and splits the text twice.
    lines = texts.select("host", "text_key", F.posexplode_outer(raw).alias("position", "line")).where(F.col("line") != "")
    lines = lines.select(
        "host",
        "text_key",
        "position",
        F.unhex(F.md5(latin_lower(F.col("line")).cast("binary"))).alias("key"),
        F.regexp_count("line", F.lit(r"[^\x20\x09-\x0D]+")).alias("words"),
    )
    # Written, so that the joins know its size: small, it is broadcast; large, both sides are exchanged and AQE splits a hot key.
    counted = lines.groupBy("host", "key").agg(F.countDistinct("text_key").alias("n"))
    likely = cut(counted.where(F.col("n") >= limit).select("host", "key"), "likely")
    hits = cut(lines.join(likely, ["host", "key"], "left_semi").dropDuplicates(["host", "text_key", "position"]), "likely-lines")
    shared = hits.groupBy("host", "text_key").agg(F.sum("words").alias("shared"))
    holders = shared.join(sizes, ["host", "text_key"]).where(F.col("n_words") - F.col("shared") >= own * F.col("n_words")).select("host", "text_key")
    counted = hits.join(cut(holders, "holders"), ["host", "text_key"], "left_semi").groupBy("host", "key").agg(F.countDistinct("text_key").alias("n"))
    frequent = cut(counted.where(F.col("n") >= limit).select("host", "key"), "boilerplate")
    gone = hits.join(frequent, ["host", "key"], "left_semi")
    return gone.groupBy("host", "text_key").agg(F.sum("words").alias("boilerplate_words"), F.collect_set("position").alias("dropped"))


def verdicts(df: DataFrame, text: str = "text", host: str = "source", limit: int = LIMIT, own: float = OWN, keep: float = KEEP) -> DataFrame:
    """One row for each host and different text: NUMBERS, n_left_words, kept (false if base_failed or depleted) and dropped,
    the positions, from 0, of its boilerplate lines. Only counts and keys are shuffled for it, never texts. It is written."""
    texts = keyed(df, text, host)
    numbers = cut(with_numbers(texts).dropDuplicates(["host", "text_key"]), "numbers")
    gone = boilerplate(texts, numbers.select("host", "text_key", "n_words"), limit, own)
    left = F.col("n_words") - F.coalesce("boilerplate_words", F.lit(0))
    joined = numbers.join(gone, ["host", "text_key"], "left")
    judged = joined.withColumns({"n_left_words": left, "kept": ~F.col("base_failed") & (left >= keep * F.col("n_words"))})
    return cut(judged.drop("boilerplate_words"), "verdicts")


def with_verdicts(df: DataFrame, text: str = "text", host: str = "source", limit: int = LIMIT, own: float = OWN, keep: float = KEEP) -> DataFrame:
    """df with NUMBERS, n_left_words and kept."""
    found = verdicts(df, text, host, limit, own, keep).drop("dropped")
    rows = keyed(df, text, host, whole_rows(df).alias("row")).drop("body")
    return rows.join(found, ["host", "text_key"]).select(*passed(df, *NUMBERS, *VERDICT), *NUMBERS, *VERDICT)


def digest(df: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    return with_verdicts(df.select("doc_id", host, text), text, host).select("doc_id", *NUMBERS, "kept", "n_left_words")


def keep_good(df: DataFrame, text: str = "text", host: str = "source", limit: int = LIMIT, own: float = OWN, keep: float = KEEP) -> DataFrame:
    """The rows that pass, with the columns of df, their texts rebuilt by position without boilerplate lines."""
    good = verdicts(df, text, host, limit, own, keep).where("kept").select("host", "text_key", "dropped")
    rows = keyed(df, text, host, whole_rows(df).alias("row")).drop("body").join(good, ["host", "text_key"])
    rows = rows.withColumn("lines", F.split(F.coalesce(F.col("row").getField(text), F.lit("")), "\n", -1))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    rebuilt = F.array_join(F.transform(left, lambda i: F.get(F.col("lines"), i)), "\n")
    new = F.when(F.col("dropped").isNull(), F.col("row").getField(text)).otherwise(rebuilt)
    return rows.select(*(new.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in df.columns))

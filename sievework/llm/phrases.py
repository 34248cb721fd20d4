"""Phrase collocations by suffix sorting: truncated suffixes are shuffled by language and first word, sorted in reverse
lexicographic order, and all their prefixes counted with one stack; the counts of a phrase's parts are joined afterwards.

Three passes read the texts, each with NumPy over whole blocks of bytes. The first counts words. The second counts pairs of
frequent words in hashed slots; a slot's count is at least that of each pair in it, so a pair in a slot below the limit is in
no phrase, and suffixes end before it. That loses nothing, whatever the number of slots; fewer slots only leave longer
suffixes. The third emits, for each place, the suffix of up to max_words words that is left, equal ones of a block as one row.

No word or pair makes a group of its own that one task must hold: the rows of a first word that has more than 1/SHARES of all
words are dealt by the second word too, and those of a pair that has as much by all words of the suffix. Only the prefixes of
such pairs are counted in parts, and the parts summed. The tables of these words and pairs have at most SHARES rows each, the
two bitmaps SLOTS bits: nothing that is sent to the tasks grows with the input.

Texts: A-Z are lower-cased, pieces end at [.,;:!?] and line ends, words at space and tab; a phrase lies within one piece. A
null text is empty, a null language `und`. Rows that repeat count as often as they occur. Columns besides text and lang are
not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sievework.llm.common import bounded_batches, cut, discard, text_of

MAX_WORDS = 4
LEAST = 30
#: Of a longer candidate's count to a phrase's, in percent: from here on the phrase is only a part of it.
WITHIN = 80
TOP = 2000
#: Bits of the bitmaps of frequent words and pairs.
SLOTS = 1 << 24
#: A word or pair with more than this part of all words is hot.
SHARES = 4096
#: Bytes of text in one block.
BLOCK = 4 << 20
#: Bits of one row that bitmap_construct_agg makes.
BITMAP_BITS = 32768

SPACE, PIECE = 1, 2
CLASSES = np.zeros(256, np.uint8)
CLASSES[[0x20, 0x09]] = SPACE
CLASSES[[*b".,;:!?", *range(0x0A, 0x0E)]] = PIECE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
MIX = np.uint64(0x9E3779B97F4A7C15)


class Block:
    """The words of one stretch of text of one language: ids into `names`, a number for each piece, and how many of them
    start here (the rest are only context for the suffixes of the last ones)."""

    def __init__(self, lang: str, text: np.ndarray, limit: int):
        kinds = CLASSES[text]
        inside = kinds == 0
        edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(text[inside])])
        coded = words.dictionary_encode()
        self.lang, self.names = lang, coded.dictionary.cast(pa.string())
        self.ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.piece = np.cumsum(kinds == PIECE)[starts] if len(starts) else starts
        self.own = int(np.searchsorted(starts, limit))
        seed = xxhash.xxh32_intdigest(lang.encode())
        digests = (xxhash.xxh64_intdigest(x, seed) for x in coded.dictionary.to_pylist())
        self.hashes = np.fromiter(digests, np.uint64, len(self.names))

    def pair_hashes(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Of pairs of word ids."""
        mixed = self.hashes[first] * MIX + (self.hashes[second] ^ (self.hashes[second] >> np.uint64(29)))
        return mixed ^ (mixed >> np.uint64(32))

    def joined(self) -> np.ndarray:
        """For each word whether the next one is in the same piece."""
        same = np.zeros(len(self.ids), bool)
        if len(self.ids) > 1:
            same[:-1] = self.piece[1:] == self.piece[:-1]
        return same


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Block]:
    """Texts of one language are put together up to the size of a block; a longer one is cut between words, and the next
    MAX_WORDS - 1 words repeated as context. Batches hold lang and text."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            held.setdefault(lang, []).append(text)
            sizes[lang] = sizes.get(lang, 0) + len(text) + 1
            if sizes[lang] >= size:
                del sizes[lang]
                yield from pieces_of(lang, b"\n".join(held.pop(lang)), size)
        if sum(sizes.values()) >= 2 * size:
            for lang in list(held):
                yield from pieces_of(lang, b"\n".join(held.pop(lang)), size)
            sizes = {}
    for lang, texts in held.items():
        yield from pieces_of(lang, b"\n".join(texts), size)


def pieces_of(lang: str, text: bytes, size: int) -> Iterator[Block]:
    whole = LOWER[np.frombuffer(text, np.uint8)]
    start = 0
    while start < len(whole):
        end = start + size
        if end >= len(whole):
            yield Block(lang, whole[start:], len(whole) - start)
            return
        end += first_after(whole, end, 1)
        after = end + first_after(whole, end, MAX_WORDS)
        yield Block(lang, whole[start:after], end - start)
        start = end


def first_after(text: np.ndarray, start: int, words: int) -> int:
    """Bytes from start to a place behind which so many words have ended, or the end of the text."""
    step = 256
    while True:
        part = CLASSES[text[start : start + step]] == 0
        stops = np.flatnonzero(part[:-1] & ~part[1:]) + 1
        if len(stops) >= words:
            return int(stops[words - 1])
        if start + step >= len(text):
            return len(text) - start
        step *= 4


def bits_of(bitmap: np.ndarray, hashes: np.ndarray, slots: int) -> np.ndarray:
    slot = hashes % np.uint64(slots)
    return (bitmap[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0


def count_words(df: DataFrame, slots: int, size: int) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, size):
            n = np.bincount(b.ids[: b.own], minlength=len(b.names))
            seen = np.flatnonzero(n)
            slot = (b.hashes % np.uint64(slots)).astype(np.int64)
            yield pa.record_batch({"lang": pa.array([b.lang] * len(seen), pa.string()), "phrase": b.names.take(pa.array(seen)), "slot": slot[seen], "n": n[seen].astype(np.int64)})

    return df.mapInArrow(count, "lang string, phrase string, slot long, n long").groupBy("lang", "phrase", "slot").agg(F.sum("n").alias("n"))


def count_pairs(df: DataFrame, frequent: object, slots: int, size: int) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, size):
            good = bits_of(frequent.value, b.hashes, slots)[b.ids]
            at = np.flatnonzero(b.joined()[: b.own] & good[: b.own])
            at = at[good[at + 1]] if len(at) else at
            slot, n = np.unique(b.pair_hashes(b.ids[at], b.ids[at + 1]) % np.uint64(slots), return_counts=True)
            yield pa.record_batch({"slot": slot.astype(np.int64), "n": n.astype(np.int64)})

    return df.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))


def bitmap(slots_seen: DataFrame, slots: int) -> np.ndarray:
    """The slots of the table as bits: a fixed number of bytes, whatever the table holds."""
    rows = slots_seen.groupBy(F.floor(F.col("slot") / BITMAP_BITS).alias("at")).agg(F.bitmap_construct_agg(F.col("slot") % BITMAP_BITS).alias("bits"))
    out = np.zeros(-(-slots // BITMAP_BITS) * BITMAP_BITS // 8, np.uint8)
    for row in rows.toLocalIterator():
        out[row["at"] * BITMAP_BITS // 8 :][: BITMAP_BITS // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def suffixes(df: DataFrame, seen: object, hot: object, slots: int, size: int) -> DataFrame:
    """Suffixes of two words and more, each word followed by a space, with the part of their first word's rows they go to,
    and whether their pair is dealt over several parts."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_seen, pairs_seen = seen.value
        hot_words, hot_pairs = hot.value
        for b in blocks(batches, size):
            count, n = len(b.ids), b.own
            good = bits_of(words_seen, b.hashes, slots)[b.ids]
            link = b.joined()
            at = np.flatnonzero(link)
            if len(at):
                link[at] = good[at] & good[at + 1] & bits_of(pairs_seen, b.pair_hashes(b.ids[at], b.ids[at + 1]), slots)
            at = np.flatnonzero(link[:n])
            if not len(at):
                continue
            keys = np.zeros((MAX_WORDS, len(at)), np.int64)
            keys[0] = b.ids[at] + 1
            alive = np.ones(len(at), bool)
            for k in range(1, MAX_WORDS):
                alive &= link[np.minimum(at + k - 1, count - 1)] & (at + k < count)
                keys[k] = np.where(alive, b.ids[np.minimum(at + k, count - 1)] + 1, 0)
            order = np.lexsort(keys[::-1])
            keys = keys[:, order]
            new = np.ones(len(order), bool)
            new[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(order)))
            keys = keys[:, first]
            words = [b.names.take(pa.array(np.where(k > 0, k - 1, 0), mask=k == 0)) for k in keys]
            texts = pc.binary_join_element_wise(*words, pa.array([""] * len(first)), " ", null_handling="skip")
            ids, nexts = keys[0] - 1, keys[1] - 1
            salted = np.array([hot_words.get((b.lang, w), 1) for w in b.names.to_pylist()], np.uint64)[ids]
            part = b.hashes[nexts] % salted
            pair_slot = (b.pair_hashes(ids, nexts) % np.uint64(slots)).astype(np.int64)
            shared = np.isin(pair_slot, np.fromiter(hot_pairs, np.int64, len(hot_pairs)))
            if shared.any():
                rest = b.hashes[nexts[shared]] * np.uint64(31)
                for k in keys[2:, shared]:
                    rest = (rest ^ np.where(k > 0, b.hashes[k - 1], np.uint64(0))) * MIX
                parts = np.array([hot_pairs[s] for s in pair_slot[shared].tolist()], np.uint64)
                part[shared] = (rest >> np.uint64(32)) % parts
            yield pa.record_batch({"lang": pa.array([b.lang] * len(first), pa.string()), "first": words[0], "part": part.astype(np.int32), "shared": shared, "suffix": texts, "n": times.astype(np.int64)})

    return df.mapInArrow(emit, "lang string, first string, part int, shared boolean, suffix string, n long")


def count_prefixes(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Over rows sorted in reverse lexicographic order: the stack holds the prefixes of the suffix at hand, by their number of
    words, with their counts; a prefix from which a suffix departs can get no more, and is given out.

    Within a batch departures are found for all rows at once; between batches the stack is what is carried.
    """
    stack: dict[int, list] = {}  # words to [language, shared, prefix, count]
    before: list[str | None] = []

    def close(size: int, out: list[tuple]) -> None:
        lang, shared, prefix, n = stack.pop(size)
        if n >= least or shared:
            out.append((lang, prefix, size, n))

    for batch in batches:
        if not len(batch):
            continue
        out: list[tuple] = []
        langs, shared, texts, counts = batch.columns
        parts = pc.split_pattern(texts, " ")
        size = pc.list_value_length(parts).to_numpy(zero_copy_only=False) - 1  # nothing follows the last space
        at = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        words = parts.flatten()
        ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        n = counts.to_numpy(zero_copy_only=False)
        first = [langs[0].as_py(), shared[0].as_py(), *(words[int(at[0] + k)].as_py() if k < size[0] else None for k in range(MAX_WORDS))]
        departs = np.zeros(len(n), bool)
        for column in (langs.dictionary_encode().indices, shared.cast(pa.int8())):
            values = column.to_numpy(zero_copy_only=False)
            departs[1:] |= values[1:] != values[:-1]
        departs[0] = first[:2] != before[:2]
        for k in range(MAX_WORDS):
            here = np.where(size > k, ids[np.minimum(at + k, len(ids) - 1)], -1)
            departs[1:] |= here[1:] != here[:-1]
            departs[0] |= len(before) > 0 and first[k + 2] != before[k + 2]
            if not k:
                continue
            long = size > k
            starts = np.flatnonzero(departs & long)
            ends = np.append(starts[1:], len(n))
            # Rows before the first start go on with the prefix that is open; behind a run's rows stand only shorter ones.
            sums = np.concatenate([[0], np.cumsum(np.where(long, n, 0))])
            if k + 1 in stack:
                stack[k + 1][3] += int(sums[starts[0] if len(starts) else len(n)])
                if departs.any():
                    close(k + 1, out)
            totals = sums[ends] - sums[starts]
            wanted = totals >= least
            wanted |= shared.to_numpy(zero_copy_only=False)[starts]
            # The last run may go on in the next batch, unless a row departs from it here.
            open_run = len(starts) > 0 and not departs[starts[-1] + 1 :].any()
            for run in np.flatnonzero(wanted[:-1] if open_run else wanted).tolist():
                row = int(starts[run])
                out.append((langs[row].as_py(), " ".join(words.slice(int(at[row]), k + 1).to_pylist()), k + 1, int(totals[run])))
            if open_run:
                row = int(starts[-1])
                stack[k + 1] = [langs[row].as_py(), shared[row].as_py(), " ".join(words.slice(int(at[row]), k + 1).to_pylist()), int(totals[-1])]
        last = len(n) - 1
        before = [langs[last].as_py(), shared[last].as_py(), *(words[int(at[last] + k)].as_py() if k < size[last] else None for k in range(MAX_WORDS))]
        yield as_rows(out)
    out = []
    for size in list(stack):
        close(size, out)
    yield as_rows(out)


def as_rows(out: list[tuple]) -> pa.RecordBatch:
    lang, phrase, size, n = zip(*out, strict=True) if out else ((), (), (), ())
    return pa.record_batch([pa.array(lang, pa.string()), pa.array(phrase, pa.string()), pa.array(size, pa.int32()), pa.array(n, pa.int64())], names=["lang", "phrase", "size", "n"])


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, slots: int = SLOTS, size: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent words (lang, phrase, n), frequent phrases (lang, phrase, size, n), and all words of each language (lang, n)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), text_of(text).alias("text"))
    every = cut(count_words(texts, slots, size), "phrase-all-words")
    totals = cut(every.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
    words = cut(every.where(F.col("n") >= least), "phrase-words")
    total = totals.agg(F.sum("n")).first()[0] or 0
    share = max(1, total // SHARES)
    hot_words = {(r["lang"], r["phrase"]): -(-r["n"] // share) for r in words.where(F.col("n") > share).toLocalIterator()}
    words_seen = bitmap(words.select("slot"), slots)
    pairs = cut(count_pairs(texts, spark.sparkContext.broadcast(words_seen), slots, size).where(F.col("n") >= least), "phrase-pairs")
    hot_pairs = {r["slot"]: -(-r["n"] // share) for r in pairs.where(F.col("n") > share).toLocalIterator()}
    seen = spark.sparkContext.broadcast((words_seen, bitmap(pairs.select("slot"), slots)))
    dealt = suffixes(texts, seen, spark.sparkContext.broadcast((hot_words, hot_pairs)), slots, size)
    dealt = dealt.repartition("lang", "first", "part").sortWithinPartitions(F.col("lang").desc(), F.col("shared").desc(), F.col("suffix").desc())
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("phrase", T.StringType()), T.StructField("size", T.IntegerType()), T.StructField("n", T.LongType())])
    counted = dealt.select("lang", "shared", "suffix", "n").mapInArrow(lambda batches: count_prefixes(batches, least), schema)
    found = cut(counted.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "phrases")
    discard(every, pairs)
    return words.select("lang", "phrase", "n"), found, totals


def exact(column: str) -> Column:
    return F.col(column).cast("decimal(20,0)")


def parts_of(phrase: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), start, size), " ")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, within: int = WITHIN, top: int = TOP, slots: int = SLOTS, size: int = BLOCK) -> DataFrame:
    """The first `top` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    words, found, totals = phrase_counts(docs, text, lang, least, slots, size)
    # Each part of a frequent phrase is frequent itself, so it is found.
    counts = words.select("lang", F.col("phrase").alias("part"), F.col("n").alias("part_n")).unionByName(found.select("lang", F.col("phrase").alias("part"), F.col("n").alias("part_n")))
    splits = found.select("lang", "phrase", "size", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    sides = splits.select("lang", "phrase", "a", "k", F.inline(F.array(
        F.struct(F.lit("l").alias("side"), parts_of(F.col("phrase"), F.lit(1), F.col("k")).alias("part")),
        F.struct(F.lit("r").alias("side"), parts_of(F.col("phrase"), F.col("k") + 1, F.col("size")).alias("part")),
    )))
    both = sides.join(counts, ["lang", "part"]).groupBy("lang", "phrase", "a", "k").agg(*(F.max(F.when(F.col("side") == s, F.col("part_n"))).alias(s) for s in "lr"))
    score = F.expr("cast(2000000 as decimal(10,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    scored = both.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("size") - k + 1), lambda i: parts_of(F.col("phrase"), i, k))))
    longer = found.where(F.col("size") > 2).select("lang", F.col("n").alias("longer"), F.explode(F.array_distinct(inner)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    free = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.lit(100).cast("decimal(5,0)") * exact("longer") < F.lit(within).cast("decimal(5,0)") * exact("a")))
    order = Window.partitionBy("lang").orderBy(F.desc(F.col("cut.score")), F.desc("a"), "phrase")
    ranked = free.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").cast("long").alias("score"))

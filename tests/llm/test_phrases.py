"""op12 against brute force: hot words and pairs, small blocks, few slots, ties, nulls, long texts."""

import random
import re
from collections import Counter, defaultdict

import pytest

pytest.importorskip("sievework.llm")

from pyspark.sql import functions as F  # noqa: E402

from sievework.llm import phrases  # noqa: E402

SCHEMA = "text string, lang string"


def brute(rows, least, top=2000):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^ \t]+", piece)
            total[lang] += len(words)
            counts[lang].update(tuple(words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    out = []
    for lang, c in counts.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        scored = []
        for p, a in found.items():
            if not longer[p] or 100 * longer[p] < 80 * a:
                score, _, left, right = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, rank, p.decode(), -a, left, right, total[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def corpus():
    rng = random.Random(3)
    word = lambda: rng.choice(("The", "of", "a", "x\x01", "été", "ÉTÉ", "日本", "-", "of a", "b"))
    text = lambda n: "".join(word() + rng.choice((" ", " ", " ", "\t", "  ", ", ", ". ", "\n", "\r\n", "\v", " ; ")) for _ in range(n))
    rows = [(text(rng.randint(0, 60)), rng.choice(("en", "fr", None, ""))) for _ in range(60)]
    rows += [("the of " * 2000, "en"), ("hot pair here " * 1500, "fr"), ("y" * 3000 + " z" * 500, "en"), (None, "en"), ("", "de"), (" \t\n", "es"), (None, None)]
    return rows + rows[:5] * 3


@pytest.fixture(scope="module")
def rows():
    return corpus()


def found(df, **settings):
    return sorted(tuple(r) for r in phrases.collocations(df, **settings).collect())


@pytest.mark.parametrize("least,size,slots", [(5, 4 << 20, 1 << 20), (5, 700, 1 << 20), (3, 40_000, 32)])
def test_like_brute_force(spark, rows, least, size, slots):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute(rows, least)
    assert len(want) > 50
    assert found(df, least=least, size=size, slots=slots) == want


def test_hot_words_and_pairs_are_dealt_over_parts(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for shares in (2, 64):
        monkeypatch.setattr(phrases, "SHARES", shares)
        assert found(df, least=4) == brute(rows, 4)


def test_first_ranks_only(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df, least=4, top=3) == brute(rows, 4, top=3)


def test_more_columns_and_empty_tables(spark, rows):
    df = spark.createDataFrame(rows[:40], SCHEMA)
    odd = df.withColumns({c: F.lit("mine") for c in ("phrase", "n", "slot", "first", "part", "rank", "size")})
    assert found(odd, least=3) == brute(rows[:40], 3)
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert found(spark.createDataFrame([(None, None), ("one", "en")], SCHEMA)) == []


def test_products_beyond_64_bits(spark):
    big = 1 << 44
    made = spark.createDataFrame([(big,)], "a long").select(F.expr("cast(2000000 as decimal(10,0)) * cast(a as decimal(20,0)) div (cast(a as decimal(20,0)) + cast(a as decimal(20,0)))").alias("s"))
    assert made.first()[0] == 1_000_000

"""The whole pipeline against a plain version of it, and the contract of its stages."""

import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest

pytest.importorskip("sievework.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from sievework.llm import quality, secrets  # noqa: E402

GAP = re.compile("[ \t-\r]+")
WHITE = " \t\n\x0b\x0c\r"


def key_of(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(WHITE))


def words(rng, n):
    return " ".join(rng.choice(("alpha", "beta", "gamma", "delta", "Eps", "zeta", "éta", "theta")) + str(rng.randint(0, 40)) for _ in range(n))


FOOTERS = [f"footer {c} of this own site number {c}" for c in "abcdef"]


def edited(rng, text, n):
    own = text.split(" ")
    for k in rng.sample(range(10, len(own) - 10), n):
        own[k] = f"new{rng.randint(0, 10**6)}"
    return " ".join(own)


def corpus():
    """Copies, near copies on both sides of 0.8, footers of one host and lines of all hosts, texts of footers only, junk, secrets."""
    rng = random.Random(11)
    rows = [(k, "\n".join(words(rng, rng.randint(8, 30)) for _ in range(rng.randint(1, 5)))) for k in range(60)]
    rows += [(100 + k, rows[k][1]) for k in range(5)] + [(120 + k, rows[7][1]) for k in range(12)]
    rows += [(200 + k, words(rng, 60) + "\nShared footer line of this site\n" + ("Shared footer line of this site\n" * (12 if k % 4 == 0 else 0))) for k in range(16)]
    rows += [(300, None), (301, ""), (302, "too short"), (303, (words(rng, 9) + "\n") * 9), (304, words(rng, 40) + ' token: "abcdef123456" ' + words(rng, 5))]
    long = [words(rng, 150) for _ in range(8)]
    rows += [(400 + k, t) for k, t in enumerate(long)] + [(420 + k, edited(rng, t, k // 2 + 1)) for k, t in enumerate(long)] + [(440 + k, edited(rng, t, 9)) for k, t in enumerate(long)]
    rows += [(2 * (300 + k), words(rng, 200) + "\n" + "\n".join(FOOTERS)) for k in range(14)]
    rows += [(700, "\n".join(FOOTERS) + "\nfive words of its own"), (702, "\n".join(FOOTERS)), (701, "\n".join(FOOTERS) + "\nof the other host")]
    return [(i, t, "en", "s%d" % (i % 2), None if t is None else len(t)) for i, t in rows]


def count(text):
    return len([w for w in GAP.split(text) if w])


def good(rows):
    texts = {(host, text or "") for _, text, _, host, _ in rows}
    holders = defaultdict(set)
    for host, text in texts:
        for line in text.split("\n"):
            if key_of(line):
                holders[host, key_of(line)].add(text)
    likely = {k: v for k, v in holders.items() if len(v) >= quality.LIMIT}
    of = lambda host, text, keys: sum(count(x) for x in text.split("\n") if (host, key_of(x)) in keys)
    own = lambda host, text: count(text) - of(host, text, likely) >= quality.OWN * count(text)
    common = {k for k, v in likely.items() if sum(own(k[0], t) for t in v) >= quality.LIMIT}
    for i, text, lang, host, n in rows:
        body = text or ""
        found = [w for w in GAP.split(body) if w]
        windows = [tuple(found[k : k + 8]) for k in range(len(found) - 7)]
        often = Counter(windows)
        covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(8)}
        left = len(found) - of(host, body, common)
        if len(found) >= 20 and 100 * len(covered) <= 30 * len(found) and left >= quality.KEEP * len(found):
            yield i, "\n".join(x for x in body.split("\n") if (host, key_of(x)) not in common), lang, host, n


def deduped_lines(rows):
    holders = defaultdict(set)
    for _, text, *_ in rows:
        for line in (text or "").split("\n"):
            holders[key_of(line)].add(text or "")
    for i, text, *rest in rows:
        kept = [x for x in (text or "").split("\n") if not key_of(x) or len(holders[key_of(x)]) < 10]
        yield (i, "\n".join(kept), *rest)


def shingles(text):
    own = text.encode().lower().split()
    return {tuple(own[k : k + 5]) for k in range(max(1, len(own) - 4))} if own else set()


def one_of_each(rows):
    sets = [shingles(r[1] or "") for r in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {}
    for g, row in zip(group, rows):
        least[g] = min(least.get(g, row), row, key=lambda r: r[0])
    return list(least.values())


def without_secrets(text):
    out, at = [], 0
    for _, start, end in secrets.scan(text):
        if start >= at:
            out += [text[at:start], "[secret]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def test_like_a_plain_version(spark, tmp_path):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    library = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    passed = list(good(rows))
    lines = list(deduped_lines(passed))
    kept = one_of_each(lines)
    ids = lambda found: {r[0] for r in found}
    # Each stage has work of its own: footers go and texts of them, lines of all hosts, copies and near copies but not farther ones, secrets.
    assert {300, 301, 302, 303, 700, 702}.isdisjoint(ids(passed)) and 701 in ids(passed) and not any("footer a" in r[1] for r in passed if r[3] == "s0")
    assert any("Shared footer" in r[1] for r in passed) and not any("Shared footer" in r[1] for r in lines)
    assert not ids(kept) & {100, 104, *range(120, 132), *range(420, 424)} and ids(kept) >= {0, 7, *range(400, 408), *range(440, 448)}
    assert any(without_secrets(r[1]) != r[1] for r in kept)
    expected = Counter()
    for i, text, *_ in kept:
        ids = [*library.encode(without_secrets(text), add_special_tokens=False).ids, 2]
        at = 0
        for n in [4096] * (len(ids) // 4096) + [1 << k for k in range(11, -1, -1) if len(ids) % 4096 >> k & 1]:
            expected[i, at, n, zlib.crc32(struct.pack(f"<{n}I", *ids[at : at + n])), len(ids)] += 1
            at += n
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found) == expected
    assert len({r.sequence_id for r in found}) == len(found)


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], corpus()[:30]):
        docs = spark.createDataFrame(rows, schema)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            made = stage(spark, docs, str(tmp_path))
            assert k == len(corpus_pipeline.STAGES) - 1 or made.columns == docs.columns
            made.write.parquet(path := f"{tmp_path}/{len(rows)}-{k}")
            docs = spark.read.schema(made.schema).parquet(path)
    assert docs.count() > 0

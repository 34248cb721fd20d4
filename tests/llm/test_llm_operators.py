"""Operators against brute force, on small rows with nulls, empty and long texts, ties, repeats, clashing names."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest

pytest.importorskip("sievework.llm")

from pyspark.sql import functions as F  # noqa: E402

from sievework.llm import ann, coding, common, lines, ngrams, packing, quality, secrets, simhash, suffixes, warc  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use themselves.
CLASH = (
    "row_key", "fingerprint", "n_words", "spans", "kept", "_words", "key", "shard", "row", "body", "host", "text_key", "lines", "dropped", "_lines", "_row_key", "_key",
    "position", "line", "words", "boilerplate_words", "shared", "_n", "_windows", "n_left_words", "doc", "place", "places", "context", "unit", "node", "group", "page", "ids", "a1", "h1", "seen",
)


def words(rng, n):
    return " ".join(rng.choice(("alpha", "beta", "gamma", "delta", "Eps", "zeta", "éta", "theta", "iota", "kappa")) + str(rng.randint(0, 30)) for _ in range(n))


def corpus():
    rng = random.Random(7)
    passage = words(rng, 60)
    rows = [(k, "\n".join(words(rng, rng.randint(5, 40)) for _ in range(rng.randint(1, 6)))) for k in range(40)]
    rows += [(100 + k, rows[k][1]) for k in range(6)]
    rows += [(200 + k, rows[3][1] + " " + words(rng, 1)) for k in range(12)]
    rows += [(300 + k, words(rng, 20) + "\n" + passage + "\n  Common LINE here\t\n" + words(rng, 10)) for k in range(12)]
    rows += [(400, None), (401, ""), (402, " \n\t "), (403, "one"), (404, "x" * 5000), (405, "ab " * 4000), (406, words(rng, 30)), (406, words(rng, 30)), (None, words(rng, 25)), (None, words(rng, 25))]
    rows += [(407, 'password = "hunter2hunter" AKIA' + "A1" * 9 + " " + "0a" * 14), (408, "日本語 " * 100), (409, "one"), (409, "one")]
    return [(i, t, "en", rng.choice(("s1", "s2", None)), None if t is None else len(t)) for i, t in rows]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def clash(df):
    return df.withColumns({c: F.lit("mine") for c in CLASH})


def empty(spark):
    return spark.createDataFrame([], DOCS)


def base_spans(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
    out = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, s, e) for s, _, k, e in sorted(out)]


def test_secret_scan_finds_what_a_plain_search_does():
    rng = random.Random(2)
    parts = ["password", "PassWd", "token", "api_key", "APIKEY", " ", "=", ":", '"', "AKIA", "ABCDEF012345", "deadbeef", "0123456789abcdef", "ABCDEF", "é", "ſecret", "toKen", "İ", "\n", "ghp_"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert [s for s in secrets.scan(text) if s[0] in secrets.BASE] == base_spans(text)


def test_checksums_decide(spark):
    body = "a1B2" * 7 + "zz"
    good, bad = f"x ghp_{body}{secrets.crc_base62(body)} y", f"x ghp_{body}000000 y"
    assert [s[0] for s in secrets.scan(good)] == ["github"] and secrets.scan(bad) == []
    found = secrets.redact_secrets(spark.createDataFrame([(1, good), (2, None), (3, "")], "doc_id long, text string"))
    assert {r.doc_id: r.text for r in found.collect()} == {1: "x [secret] y", 2: None, 3: ""}


def test_secret_digest(spark, docs, rows):
    found = Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.digest(secrets.find_secrets(clash(docs))).collect())
    expected = Counter()
    for i, text, *_ in rows:
        spans = base_spans(text or "")
        n = Counter(k for k, _, _ in spans)
        expected[i, n["assign"], n["access"], n["hex"], hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()] += 1
    assert found == expected
    assert secrets.digest(secrets.find_secrets(empty(spark))).count() == 0


def test_packing_covers_every_id_once(spark, docs, rows):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    library = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    ids = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 2]
    pieces = packing.digest(packing.pack_texts(clash(docs), longest=64)).collect()
    assert len({p.sequence_id for p in pieces}) == len(pieces)
    assert {p.offset for p in pieces} == {0} and all(p.length & (p.length - 1) == 0 for p in pieces)  # so every sequence is full
    found = Counter((p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces)
    expected = Counter()
    for i, text, *_ in rows:
        own = ids(text)
        at, sizes = 0, [64] * (len(own) // 64) + [1 << k for k in range(5, -1, -1) if len(own) % 64 >> k & 1]
        for n in sizes:
            expected[i, at, n, zlib.crc32(struct.pack(f"<{n}I", *own[at : at + n])), len(own)] += 1
            at += n
    assert found == expected
    coded = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in coding.coding_digest(docs).collect()}
    assert coded == {(i, len(ids(t)) - 1, hashlib.sha256(" ".join(map(str, ids(t)[:-1])).encode()).hexdigest(), hashlib.sha256(library.decode(ids(t)[:-1], skip_special_tokens=False).encode()).hexdigest()) for i, t, *_ in rows}
    back = coding.decode(coding.encode(docs.select("doc_id", "text")), by_bytes=True)
    assert back.count() == len(rows)
    assert packing.pack_texts(empty(spark)).count() == 0 and coding.coding_digest(empty(spark)).count() == 0


def test_buckets_hold_one_length_each(spark, docs, tmp_path):
    pytest.importorskip("public_tokenizers")
    pieces = packing.pack_texts(docs, longest=64)
    packing.write_buckets(pieces, f"file://{tmp_path}/b")
    sizes = Counter(r.length for r in pieces.select("length").collect())
    for length, n in sizes.items():
        found = packing.read_bucket(spark, f"file://{tmp_path}/b", length).collect()
        assert len(found) == n and {(r.length, len(r.ids)) for r in found} == {(length, 4 * length)}


WHITE = " \t\n\x0b\x0c\r"
GAP = re.compile("[ \t-\r]+")


def key_of(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(WHITE))


def test_line_dedup(spark, docs, rows):
    holders = defaultdict(set)
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            holders[key_of(line)].add(i)
    gone = {k for k, v in holders.items() if k and len(v) >= 10}
    expected = Counter()
    for i, text, *_ in rows:
        all_lines = (text or "").split("\n")
        left = [x for x in all_lines if key_of(x) not in gone]
        expected[i, len(all_lines), len(all_lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()] += 1
    assert gone
    assert_mine(lines.drop_frequent_lines(clash(docs)), clash(docs))
    found = lines.digest(lines.drop_frequent_lines(clash(docs)))
    assert Counter(map(tuple, found.collect())) == expected
    assert "Python" not in found._jdf.queryExecution().toString() and "Arrow" not in found._jdf.queryExecution().toString()
    assert lines.digest(lines.drop_frequent_lines(empty(spark))).count() == 0


def test_least_length_counts_code_points(spark):
    rows = [(k, f"éé\nééé\n{k}") for k in range(4)]
    kept = lines.drop_frequent_lines(spark.createDataFrame(rows, "doc_id long, text string"), documents=3, least_chars=3)
    assert {r.text for r in kept.collect()} == {f"éé\n{k}" for k in range(4)}


def quality_numbers(text):
    own = [w for w in GAP.split(text or "") if w]
    windows = [tuple(own[k : k + 8]) for k in range(len(own) - 7)]
    often = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(8)}
    full = [x for x in (text or "").split("\n") if x.strip(WHITE)]
    return len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text or ""), len(full) - len(set(full)), len(covered)


def test_quality_rules(spark, docs, rows):
    texts, holders = defaultdict(set), defaultdict(set)
    for _, text, _, host, _ in rows:
        texts[host].add(text or "")
        for line in (text or "").split("\n"):
            if key_of(line):
                holders[host, key_of(line)].add(text)
    likely = {k for k, v in holders.items() if len(v) >= 4}
    count = lambda text, keys, host: sum(len([w for w in GAP.split(x) if w]) for x in (text or "").split("\n") if (host, key_of(x)) in keys)
    own = {(host, t) for host, ts in texts.items() for t in ts if quality_numbers(t)[0] - count(t, likely, host) >= 0.3 * quality_numbers(t)[0]}
    gone = {k for k in likely if sum((k[0], t) in own for t in holders[k]) >= 4}
    assert gone
    expected = Counter()
    for i, text, _, host, _ in rows:
        n, chars, symbols, repeats, repeated = quality_numbers(text)
        failed = n < 20 or 100 * repeated > 30 * n
        left = n - sum(len([w for w in GAP.split(x) if w]) for x in (text or "").split("\n") if (host, key_of(x)) in gone)
        expected[i, n, chars, symbols, repeats, repeated, failed, not failed and left >= 0.5 * n] += 1
    found = quality.with_verdicts(clash(docs), limit=4, own=0.3).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert Counter(map(tuple, found.collect())) == expected
    assert quality.digest(empty(spark)).count() == 0
    texts_kept = Counter()
    for i, text, _, host, _ in rows:
        n, *_, repeated = quality_numbers(text)
        if n >= 20 and 100 * repeated <= 30 * n and n - count(text, gone, host) >= 0.5 * n:
            texts_kept[i, "\n".join(x for x in text.split("\n") if (host, key_of(x)) not in gone)] += 1
    good = quality.keep_good(clash(docs), limit=4, own=0.3)
    assert_mine(good, clash(docs))
    assert Counter((r.doc_id, r.text) for r in good.collect()) == texts_kept


def assert_mine(found, given, *replaced):
    """All columns of the given rows are there, with their values."""
    assert set(given.columns) <= set(found.columns)
    for r in found.select(*(c for c in CLASH if c not in replaced)).distinct().collect():
        assert set(r) == {"mine"}


def test_depleted_documents_are_rejected_whatever_the_size_of_the_host(spark):
    rng = random.Random(11)
    menu = [words(rng, 12) for _ in range(3)]
    # 2,000 documents of a host, 12 of which share a menu: a tenth of the host would be 200.
    rows = [(k, words(rng, 40), "en", "h", 1) for k in range(2000)]
    rows += [(3000 + k, words(rng, 150) + "\n" + "\n".join(menu), "en", "h", 1) for k in range(12)]
    rows += [(4000 + k, words(rng, 10) + "\n" + "\n".join(menu), "en", "h", 1) for k in range(5)]
    whole = [words(rng, 15) for _ in range(8)]  # near copies: one line in eight differs
    rows += [(5000 + k, "\n".join(words(rng, 15) if j == k % 8 else x for j, x in enumerate(whole)), "en", "h", 1) for k in range(40)]
    found = {r.doc_id: r.kept for r in quality.digest(spark.createDataFrame(rows, DOCS)).collect()}
    assert {i for i, kept in found.items() if not kept} == set(range(4000, 4005))


def test_simhash_components(spark, docs, rows):
    found = simhash.digest(simhash.near_duplicates(clash(docs))).collect()
    prints = [simhash.fingerprint(t or "") for _, t, *_ in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= simhash.BITS and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = defaultdict(lambda: None)
    for g, (i, *_) in zip(group, rows):
        if i is not None:
            least[g] = i if least[g] is None else min(least[g], i)
    assert Counter(map(tuple, found)) == Counter((r[0], f"{p:016x}", least[g]) for r, p, g in zip(rows, prints, group))
    kept = simhash.keep_one(clash(docs))
    assert_mine(kept, clash(docs))
    assert kept.columns == clash(docs).columns and kept.count() == len(set(group))
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_links_in_parts_join_the_same_fingerprints(spark):
    rng = random.Random(8)
    values = [rng.getrandbits(64) for _ in range(300)]
    values += [v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for v in values for _ in range(3)]
    nodes = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in set(values)], "fingerprint long")
    roots = [{(r.node, r.root) for r in simhash.components(simhash.links(nodes, visitors=n)).collect()} for n in (7, 1 << 20)]
    assert roots[0] == roots[1] and len(roots[0]) > 800


def test_fingerprint_by_definition():
    import xxhash

    for text in ("", " \n", "One", "a b c", "A b C d e f g", "é è\x0bà ü ß " * 50):
        own = text.encode().lower().split()
        shingles = [b" ".join(own[k : k + 4]) for k in range(max(1, len(own) - 3))] if own else []
        hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
        assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 300)], "u long, v long").repartition(5)
    assert Counter(r.root for r in simhash.components(edges).collect()) == {0: 200, 1000: 299}


def test_repeated_bytes(spark, docs, rows):
    data, seen = [(t or "").encode() for _, t, *_ in rows], Counter()
    for x in data:
        seen.update(x[k : k + 200] for k in range(len(x) - 199))
    expected = Counter()
    for (i, *_), x in zip(rows, data):
        gone = [False] * len(x)
        for k in range(len(x) - 199):
            if seen[x[k : k + 200]] > 1:
                gone[k : k + 200] = [True] * 200
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        expected[i, len(x), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(x, gone) if not g)).hexdigest()] += 1
    assert Counter(map(tuple, suffixes.digest(clash(docs)).collect())) == expected
    kept = Counter((r[0], r[-1]) for r in expected.elements())
    for hot_places in (suffixes.HOT_PLACES, 2):  # with 2 nearly every key is split
        whole = suffixes.remove_repeats(clash(docs), hot_places=hot_places)
        assert_mine(whole, clash(docs), "spans", "kept")
        assert Counter((r.doc_id, hashlib.sha256(r.kept).hexdigest()) for r in whole.select("doc_id", "kept").collect()) == kept
    assert suffixes.digest(empty(spark)).count() == 0


def test_one_key_in_many_surroundings(spark):
    rng = random.Random(6)
    middle = "".join(rng.choice("abcdefgh") for _ in range(100))
    noise = lambda n: "".join(rng.choice("ijklmnop") for _ in range(n))
    sides = [(noise(100), noise(100)) for _ in range(5)]
    rows = []
    for k in range(1500):  # most share the middle only, too short; some share 60 bytes before and 60 after, or 100 after
        a, b = sides[k % 5]
        left, right = (a[-60:], b[:60]) if k % 7 == 0 else ("", b) if k % 7 == 1 else (a[-40:], b[:30])
        rows.append((k, noise(50) + left + middle + right + noise(50)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    seen = Counter(t[k : k + 200] for _, t in rows for k in range(len(t) - 199))
    for hot_places in (100, 1 << 40):
        found = {r.doc_id: [tuple(s) for s in r.spans] for r in suffixes.remove_repeats(df, hot_places=hot_places).select("doc_id", "spans").collect()}
        for i, t in rows:
            starts = [k for k in range(len(t) - 199) if seen[t[k : k + 200]] > 1]
            assert found[i] == ([(starts[0], starts[-1] + 200)] if starts else [])
    assert any(found.values())


def test_anchors_of_texts_longer_than_a_group(spark, monkeypatch):
    rng = random.Random(3)
    part = "".join(rng.choice("abcd") for _ in range(600))
    text = "".join(rng.choice("abcd") for _ in range(9000)) + part
    monkeypatch.setattr(suffixes, "GROUP", 1 << 11)
    whole = [x.encode() for x in (text, part)]
    places = {k: set() for k in range(2)}
    import numpy as np

    for group in suffixes.grouped(whole, 200):
        data = np.frombuffer(b"".join(p for _, _, p in group), np.uint8)
        ends = np.cumsum([len(p) for _, _, p in group])
        at, _ = suffixes.anchors(data, ends, 200, 100)
        for x in at:
            k = int(np.searchsorted(ends, x, side="right"))
            places[group[k][0]].add(int(x) - int(ends[k]) + len(group[k][2]) + group[k][1])
    assert {p + 9000 for p in places[1]} <= places[0]


def plain_scores(texts, order, backoff=0.4):
    """(words, backed, millionths) of each text, by the definition."""
    import math

    texts = [[re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in GAP.split(t or "") if w] for t in texts]
    before = lambda t, k, n: tuple(([None] * n + t)[k : k + n])  # noqa: E731  the n words before t[k]
    seen, contexts = Counter(), Counter()
    for t in texts:
        for k, w in enumerate(t):
            for n in range(order):
                seen[(*before(t, k, n), w)] += 1
                contexts[before(t, k, n), n] += 1
    out = []
    for t in texts:
        total = back = 0
        for k, w in enumerate(t):
            for n in range(order - 1, -1, -1):
                c, x = seen[(*before(t, k, n), w)], contexts[before(t, k, n), n]
                if c > 1 or n == 0:
                    ratio = c / x if n == 0 else (c - 1) / (x - 1)
                    total += round(1e6 * math.log(ratio * backoff ** (order - 1 - n)))
                    back += n < order - 1
                    break
        out.append((len(t), back, total))
    return out


@pytest.mark.parametrize("order", [2, 3, 5])
def test_backoff_scores(spark, docs, rows, order):
    expected = Counter((i, *x) for (i, *_), x in zip(rows, plain_scores([t for _, t, *_ in rows], order)))
    found = ngrams.backoff_scores(clash(docs), order=order, passes=2)
    assert Counter(map(tuple, found.collect())) == expected
    assert any(0 < r.n_backoff < r.n_words for r in found.collect())
    assert "Python" not in found._jdf.queryExecution().toString()
    assert ngrams.backoff_scores(empty(spark), order=order).count() == 0


@pytest.mark.parametrize("order", [2, 4])
def test_backoff_scores_with_hot_words(spark, order):
    """Contexts that are counted apart, the start of short texts among them, give what the definition gives."""
    texts = ["x x x x y x x", "x y", "x", "y", "x z", "", None, "a x b x a x b", "x y z x y z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = Counter((k, *x) for k, x in enumerate(plain_scores(texts, order)))
    for hot in (4, 100):
        assert Counter(map(tuple, ngrams.backoff_scores(docs, order=order, passes=2, hot=hot).collect())) == expected


def test_backoff_occurrences_are_shuffled_once(spark):
    docs = spark.createDataFrame([(0, [1, 2, 3])], "row long, words array<long>")
    found = ngrams.scored(ngrams.grams(docs, 4).repartition("c1"), ngrams.counted, 4, 0.4)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_backoff_words_are_written_as_codes(spark, monkeypatch):
    """200,000 distinct words, five times each, in one file: about four bytes a word with its dictionary, eight without."""
    written = {}

    def kept(df, label, **options):
        found = common.cut(df.coalesce(1) if label == "tokens" else df, label, **options)
        written[label] = sum(p.stat().st_size for p in Path(found.cut_path.removeprefix("file://")).glob("*.parquet"))
        return found

    monkeypatch.setattr(ngrams, "cut", kept)
    text = " ".join(f"w{k}" for k in range(200_000))
    docs = spark.createDataFrame([(k, text) for k in range(5)], "doc_id long, text string")
    assert ngrams.backoff_scores(docs, passes=1).count() == 5
    assert written["tokens"] < 5 * 1_000_000


PAGES = "page_id long, url string, html string"


def test_warc_round_trip(spark, tmp_path):
    rows = [(k, f"https://a.example/{k}?q=1%20x", f"<p>{k % 7}</p>") for k in range(60)]
    rows += [(60, None, None), (61, "u", ""), (62, "bad\r\nurl", "é" * 3000), (63, "u", "z" * 200_000), (None, "n", "<p>1</p>"), (5, "again", "<p>5</p>")]
    df = spark.createDataFrame(rows, PAGES).withColumns({c: F.lit(1) for c in ("shard", "digest", "payload")})
    folders = [f"file://{tmp_path}/{n}" for n in "ab"]
    for folder, n in zip(folders, (2, 7)):
        warc.write_warc(df.drop("payload").repartition(n), folder, shard_bytes=40_000, roll_bytes=1500)
    a, b = (next((tmp_path / n).glob("write-*")) for n in "ab")
    names = sorted(p.name for p in a.glob("*.warc.gz"))
    assert len(names) > 3 and sorted(p.name for p in b.glob("*.warc.gz")) == names and all((a / n).read_bytes() == (b / n).read_bytes() for n in names)
    assert not list((a / "_temporary").glob("*")) if (a / "_temporary").exists() else True
    found = warc.read_warc(spark, folders[0]).collect()
    best = {}
    for i, _, html in rows:
        if i is not None:
            best[html or ""] = max(best.get(html or "", i), i)
    expected = Counter()
    for i, url, html in rows:
        body = (html or "").encode()
        first = best[html or ""]
        expected[i, url, body if i == first else None, len(body), warc.base32_sha1(body), "response" if i == first else "revisit", None if i == first else first] += 1
    assert Counter((r.page_id, r.url, None if r.payload is None else bytes(r.payload), *r[3:]) for r in found) == expected
    warc.write_warc(spark.createDataFrame([], PAGES), f"file://{tmp_path}/c")
    assert warc.read_warc(spark, f"file://{tmp_path}/c").count() == 0


def test_one_far_key_leaves_the_shards_even(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k, "u", words(rng, 60)) for k in range(3000)] + [(1 << 60, "u", "far"), (-(1 << 63), "u", "least"), ((1 << 63) - 1, "u", "most")]
    manifest = warc.write_warc(spark.createDataFrame(rows, PAGES), f"file://{tmp_path}/w", shard_bytes=20_000)
    assert manifest.select("shard").distinct().count() == -(-sum(len(r[2].encode()) for r in rows) // 20_000)
    assert warc.read_warc(spark, f"file://{tmp_path}/w").count() == len(rows)


def test_a_second_write_replaces_the_first_at_once(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    warc.write_warc(spark.createDataFrame([(k, "u", f"old {k}") for k in range(30)], PAGES), folder)
    before = next((tmp_path / "w").glob("write-*"))
    broken = spark.createDataFrame([(1, "u", "new")], PAGES).withColumn("html", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception):
        warc.write_warc(broken, folder)
    assert warc.read_warc(spark, folder).count() == 30
    warc.write_warc(spark.createDataFrame([(1, "u", "new")], PAGES), folder)
    assert [r.payload for r in warc.read_warc(spark, folder).collect()] == [b"new"] and not before.exists()


def test_least_payload_of_revisits(spark, tmp_path):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")]
    warc.write_warc(spark.createDataFrame(rows, PAGES), f"file://{tmp_path}/w", least=3)
    found = {r.page_id: (r.record_type, r.refers_to) for r in warc.read_warc(spark, f"file://{tmp_path}/w").collect()}
    assert found == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}


def test_damaged_archive_is_noticed(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    warc.write_warc(spark.createDataFrame([(1, "u", "x" * 500)], PAGES), folder)
    path = next((tmp_path / "w").glob("*/*.warc.gz"))
    data = bytearray(path.read_bytes())
    data[-20] ^= 255
    path.write_bytes(bytes(data))
    with pytest.raises(Exception):
        warc.read_warc(spark, folder).count()


def test_permutation_index_recall_and_order(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 32))
    x = (centres[rng.integers(0, 8, 6000)] * 0.4 + rng.normal(size=(6000, 32))).astype(np.float32)
    x[3000:3050] = x[2900]
    rows = [(k, [float(v) for v in row]) for k, row in enumerate(x)]
    rows += [(7000, None), (7100, [0.0] * 32), (7200, [float("nan")] * 32), (7300, [1.0] * 5), (None, [1.0] * 32), (100, rows[100][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("vector", F.lit(0))
    found = defaultdict(list)
    for r in ann.search(df, block=1500).collect():
        found[r.query_id].append((r.rank, r.score, r.vec_id))
        assert r.candidates < 0.15 * 6000
    assert set(found) == set(range(0, 6000, 100))
    hits = 0
    full = x.astype(np.float64)
    for q, got in found.items():
        far = np.sqrt(((full - full[q]) ** 2).sum(1))
        order = [int(k) for k in np.lexsort((np.arange(6000), far)) if k != q][:10]
        got.sort()
        assert [g[0] for g in got] == list(range(1, 11))
        assert all(abs(far[v] - s) < 1e-9 for _, s, v in got)
        assert [(s, v) for _, s, v in got] == sorted((s, v) for _, s, v in got)
        hits += len({v for *_, v in got} & set(order))
    assert hits >= 0.9 * 10 * len(found)
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_few_vectors_give_all_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.rank, r.vec_id) for r in ann.search(df).orderBy("rank").collect()] == [(1, 2), (2, 1)]


class Refusing:
    """A store as HDFS is: a file is not moved onto another."""

    def __init__(self, store):
        self.store = store

    def __getattr__(self, name):
        return getattr(self.store, name)

    def move(self, made, final):
        if self.get_file_info(final).type.name != "NotFound":
            raise OSError("it is there")
        self.store.move(made, final)


@pytest.mark.parametrize("race", [False, True])
def test_a_warc_task_may_run_twice(tmp_path, race):
    def task():
        roller = warc.Roller(f"file://{tmp_path}", 3, 400)
        roller.store = Refusing(roller.store)
        for k in range(6):
            roller.write(k, warc.record(k, "u", bytes(range(40)) * k, None))
        return roller

    if race:
        one, two = task(), task()
        done = [two.end(), one.end()]
    else:
        lost = task()  # it has placed some files, and is never ended
        assert any(tmp_path.glob("*.warc.gz")) and lost.sink
        done = [task().end(), task().end()]
    assert done[0] == done[1] and len(done[0]) > 2
    for name, _, _, size, checksum, *_ in done[0]:
        data = (tmp_path / name).read_bytes()
        assert len(data) == size and hashlib.sha256(data).hexdigest() == checksum


def test_former_writes_stay_as_long_as_asked(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    for k in range(4):
        warc.write_warc(spark.createDataFrame([(k, "u", "x")], "page_id long, url string, html string"), folder, keep_writes=2)
    assert len(list((tmp_path / "w").glob("write-*"))) == 3
    assert [r.page_id for r in warc.read_warc(spark, folder).collect()] == [3]


def test_search_of_large_and_small_vectors(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e200, -1e200]), (2, [1.2e200, 1e200]), (3, [1.0, 2.0]), (100, [1e-200, 0.0]), (101, [3e-200, 0.0]), (102, [-1e308, 1e308])]
    found = defaultdict(dict)
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        found[r.query_id][r.vec_id] = r.score
    assert found[0][1] == 2e200 and found[0][2] == pytest.approx(0.2e200, rel=1e-12) and found[0][3] == pytest.approx(2**0.5 * 1e200, rel=1e-12)
    assert found[100][101] == pytest.approx(2e-200, rel=1e-12) and found[100][102] == pytest.approx(2**0.5 * 1e308, rel=1e-12)

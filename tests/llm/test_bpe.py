import random

import pytest

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from sievework.llm.bpe import Decoder, Encoder, Merges, read_spec, unpacked  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def merges():
    return Merges(read_spec(PATH))


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


ALPHABETS = [
    "aaabbeethstionrein'sLEÉéΣİßñ!!??##12 ́ \x1c日本한글ﬁ", "abcdefghijklmnopqrstuvwxyz", "ei", "the", "éèñabc", "!?#",
    "ab́c", "th in", "😀😁", "́̂", "ᄀ각각", "a😀é1", "it'sreve'll", "J̌a", "x're", "İIΣ",
]


def same(text, merges, library, size):
    expected = library.encode(text, add_special_tokens=False).ids
    encoder = Encoder(merges, cache=50)
    assert list(unpacked(encoder.encode(text))) == expected
    streamed = [x for ids in encoder.stream(text[k : k + size] for k in range(0, len(text), size)) for x in unpacked(ids)]
    assert streamed == expected
    machine = Decoder(merges)
    shown = "".join(machine.feed(streamed[k : k + 3]) for k in range(0, len(streamed), 3)) + machine.close()
    assert shown == library.decode(expected, skip_special_tokens=False)


@pytest.mark.parametrize("seed", range(40))
def test_like_the_library_in_any_blocks(seed, merges, library):
    rng = random.Random(seed)
    for _ in range(8):
        alphabet = rng.choice(ALPHABETS)
        text = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 7, 60, 900, 4000])))
        if rng.random() < 0.2:
            text = text[: len(text) // 2] + "<|endoftext|>" + text[len(text) // 2 :]
        same(text, merges, library, rng.choice([5, 100, 5000]))


def test_long_runs_without_white_space(merges, library):
    for alphabet in ("the", "!?#", "éa", "12a"):
        rng = random.Random(alphabet)
        same("".join(rng.choice(alphabet) for _ in range(70_000)), merges, library, 1 << 15)


def test_state_stays_small(merges):
    encoder, most = Encoder(merges, cache=100), 0
    for _ in encoder.stream("the" * 1000 for _ in range(300)):
        most = max(most, len(encoder) + len(encoder.older))
    assert most <= 300


def test_lookahead_is_sufficient(merges):
    rng = random.Random(1)
    for _ in range(200):
        data = "".join(rng.choice("abcdeinthrso") for _ in range(3 * merges.lookahead)).encode()
        whole = merges.merge([merges.inner[b] for b in data])
        short = merges.merge([merges.inner[b] for b in data[: 2 * merges.lookahead]])
        ends = 0
        for a, b in zip(whole, short):
            ends += len(merges.names[b])
            if ends > merges.lookahead:
                break
            assert a == b


def test_bytes_decoder_gives_text_across_pieces(merges, library):
    text = "olé 日本 tion the"
    ids = library.encode(text, add_special_tokens=False).ids
    machine = Decoder(merges, by_bytes=True)
    assert "".join([*(machine.feed([i]) for i in ids), machine.close()]).strip() == text


def test_every_token_comes_from_the_transducer(merges, monkeypatch):
    import pyarrow.parquet as pq

    from sievework.llm import bpe

    given = 0

    class Counted(bpe.Run):
        def feed(self, data):
            nonlocal given
            given += len(out := super().feed(data))
            return out

        def close(self):
            nonlocal given
            given += len(out := super().close())
            return out

    monkeypatch.setattr(bpe, "Run", Counted)
    encoder = Encoder(merges, cache=0)
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()
    total = sum(len(encoder.encode(t or "")) // 4 for t in texts)
    assert total > 300_000 and given == total


def test_memo_gives_what_the_transducer_does(merges):
    rng = random.Random(3)
    for _ in range(50):
        text = "".join(rng.choice("abein's th?1é") for _ in range(400))
        assert Encoder(merges, cache=20).encode(text) == Encoder(merges, cache=0).encode(text)


def test_tokens_leave_before_a_long_piece_ends(merges, library):
    from sievework.llm.bpe import Run

    rng = random.Random(5)
    text = "".join(rng.choice("etaoinshr") for _ in range(2_000_000))
    run, out, most = Run(merges), [], 0
    for k in range(0, len(text), 1000):
        out += run.feed(text[k : k + 1000].encode())
        most = max(most, len(run.held))
        if k == 10_000:
            assert len(out) > 1000
    assert most <= 2 * merges.lookahead
    out += run.close()
    assert out == library.encode(text, add_special_tokens=False).ids
    assert list(unpacked(Encoder(merges).encode(text))) == out

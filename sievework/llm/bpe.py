"""BPE encoding and decoding as streams.

Encoding is a transducer with bounded lookahead. A merge can change what stands to its left only through a chain of
merges of ever higher priority, each taking away the symbol that the one before needs. `Merges.lookahead` is the longest
such chain, in symbols, found by dynamic programming over the merge list. `Run` is the transducer: a piece's bytes go in, a
token comes out once it ends that many symbols before the end of what was read, since nothing further right can change it,
or once the piece has ended, as no merge crosses that. Every piece of every text goes through it, of whatever length; what
it gave for a piece is remembered in a memo of fixed size. Text is read in blocks. The state is one block, one open piece
of two lookaheads and the memo, however long the text is.

Decoding is a state machine over bytes: tokens give bytes, complete characters leave, an incomplete one waits.
"""

from __future__ import annotations

import codecs
import heapq
import json
import os
import unicodedata
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from pathlib import Path

import regex

#: Fixed values of the tokenizer file's pre-tokenizer: contractions, letters, single digits, other runs.
SPACE = r"\t-\r \x85\xa0  -     　"
PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
OPEN = {"letters": regex.compile(r"\p{L}+"), "others": regex.compile(rf"[^{SPACE}\p{{L}}\p{{N}}]+")}
GAPS = regex.compile(rf"[{SPACE}]+")
#: str.split() takes these for white space, the tokenizer does not.
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Characters read at a time; memory, not results, depends on it. So does a memo entry's greatest length.
BLOCK, MEMO_CHARS = 1 << 15, 512
#: Normalization looks no further back than this for a place to cut.
CUT_WITHIN = 2048
NEVER = 1 << 60
POINTS = frozenset(".,;:!?")
CACHE = 600_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    table = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


class Merges:
    """Vocabulary and merge list of a word-level BPE file; `suffix` marks a word's last symbol."""

    def __init__(self, source: str) -> None:
        spec = json.loads(source)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names = {i: t for t, i in (self.vocab | self.special).items()}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(x.split(" ") if isinstance(x, str) else x for x in model["merges"]):
            made = self.vocab[a + b]
            self.pairs.setdefault((self.vocab[a], self.vocab[b]), (rank, made))
            self.parts.setdefault(made, (rank, self.vocab[a], self.vocab[b]))
        #: The same for short words: both operands as one number to rank and result as one number.
        self.coded = {a << 20 | b: rank << 20 | made for (a, b), (rank, made) in self.pairs.items()}
        letters = byte_alphabet()
        self.inner = [self.vocab[c] for c in letters]
        self.last = [self.vocab[c + self.suffix] for c in letters]
        self.size: dict[int, int] = {}
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        """Symbols to the right that can matter to a token, by the longest chain of merges that block one another."""
        size = self.size
        for token in (*self.inner, *self.last):
            size[token] = 1
        starts: dict[int, tuple[list[int], list[int]]] = {}  # by left operand: ranks, longest reach up to there
        most = 0
        for (left, right), (rank, made) in self.pairs.items():
            size.setdefault(made, size[left] + size[right])
            reach, token, taken_at = 0, right, rank
            while True:  # along the right edge of the right operand: what could be taken before it is used
                if token in starts:
                    ranks, best = starts[token]
                    if k := bisect_left(ranks, taken_at):
                        reach = max(reach, best[k - 1])
                if token not in self.parts:
                    break
                taken_at, _, token = self.parts[token]
            ranks, best = starts.setdefault(left, ([], []))
            ranks.append(rank)
            best.append(max(size[right] + reach, best[-1] if best else 0))
            most = max(most, best[-1])
        return most + max(size.values())

    def merge(self, ids: list[int]) -> list[int]:
        """The tokens of a whole run of symbols: lowest rank first, leftmost among equals."""
        return self._few(ids) if len(ids) <= 24 else self._many(ids)

    def _few(self, ids: list[int]) -> list[int]:
        find = self.coded.get
        waiting = [find(x << 20 | y, NEVER) for x, y in zip(ids, ids[1:])]
        while waiting:
            best = min(waiting)
            if best == NEVER:
                break
            k = waiting.index(best)
            made = ids[k] = best & 0xFFFFF
            del waiting[k], ids[k + 1]
            if k:
                waiting[k - 1] = find(ids[k - 1] << 20 | made, NEVER)
            if k < len(waiting):
                waiting[k] = find(made << 20 | ids[k + 1], NEVER)
        return ids

    def _many(self, ids: list[int]) -> list[int]:
        pairs, n = self.pairs, len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(pairs[p][0], k, p) for k, p in enumerate(zip(ids, ids[1:])) if p in pairs]
        heapq.heapify(heap)
        while heap:
            _, k, pair = heapq.heappop(heap)
            j = after[k]
            if j < 0 or ids[k] != pair[0] or ids[j] != pair[1]:
                continue
            ids[k], ids[j] = pairs[pair][1], -1
            after[k] = after[j]
            if after[j] >= 0:
                before[after[j]] = k
            after[j] = -1
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y >= 0 and (p := (ids[x], ids[y])) in pairs:
                    heapq.heappush(heap, (pairs[p][0], x, p))
        return [x for x in ids if x >= 0]


class Run:
    """The transducer for one piece: bytes come in, tokens leave once nothing further right can change them. It holds no
    more than two lookaheads beyond what it was last fed."""

    def __init__(self, merges: Merges) -> None:
        self.merges, self.held = merges, b""

    def feed(self, data: bytes) -> list[int]:
        self.held += data
        out: list[int] = []
        ahead = self.merges.lookahead
        while len(self.held) > 2 * ahead:
            window = self.held[: 2 * ahead]
            ends = taken = 0
            for token in self.merges.merge([*map(self.merges.inner.__getitem__, window)]):
                ends += self.merges.size[token]
                if ends > len(window) - ahead:
                    break
                out.append(token)
                taken = ends
            self.held = self.held[taken:]
        return out

    def close(self) -> list[int]:
        """The piece has ended, so nothing can change what is left; its last symbol is marked."""
        if not self.held:
            return []
        symbols = [*map(self.merges.inner.__getitem__, self.held)]
        symbols[-1] = self.merges.last[self.held[-1]]
        self.held = b""
        return self.merges.merge(symbols)


class Encoder(dict):
    """Texts to ids, as unsigned 32-bit little-endian bytes. As a dict it is the memo: a stretch without white space and
    the ids that the transducer gave for its pieces; when full it becomes the older half. Over-long stretches are not kept,
    with room for none nothing is."""

    def __init__(self, merges: Merges, cache: int = CACHE) -> None:
        super().__init__()
        self.merges, self.room, self.older = merges, cache, {}
        self.cuts = regex.compile("(" + "|".join(regex.escape(x) for x in merges.special) + ")") if merges.special else None
        #: What all special tokens begin with: text without it holds none.
        self.mark = os.path.commonprefix([*merges.special])

    def __missing__(self, stretch: str) -> bytes:
        ids = self.older.get(stretch)
        if ids is None:
            if stretch.isalpha():
                ids = self._word(stretch)
            elif stretch[-1] in POINTS and stretch[:-1].isalpha():
                ids = self[stretch[:-1]] + self[stretch[-1]]
            else:
                ids = self._pieces(stretch)
            if len(stretch) > MEMO_CHARS or not self.room:
                return ids
        if len(self) >= self.room:
            self.older = dict(self)
            self.clear()
        self[stretch] = ids
        return ids

    def _pieces(self, text: str) -> bytes:
        """Piece by piece; a piece alone is parsed as it is here, so it is looked up like a stretch of its own."""
        pieces = PIECE.findall(text)
        return self._word(text) if len(pieces) == 1 else b"".join(map(self.__getitem__, pieces))

    def _word(self, piece: str) -> bytes:
        run = Run(self.merges)
        data = piece.encode()
        out: list[int] = []
        for k in range(0, len(data), BLOCK):
            out += run.feed(data[k : k + BLOCK])
        return packed(out + run.close())

    def stream(self, blocks: Iterable[str]) -> Iterator[bytes]:
        """Ids, one for each block read or so. Special tokens within the text become their ids."""
        for part in self._parts(blocks):
            if isinstance(part, int):
                yield packed([part])
            else:
                yield from self._plain(part)

    def _parts(self, blocks: Iterable[str]) -> Iterator[int | Iterator[str]]:
        """Special ids, and between them streams of plain text, each to be used up before the next is asked for."""
        widest = max(map(len, self.merges.special), default=0)
        source, held, closed = iter(blocks), "", False

        def plain() -> Iterator[str]:
            nonlocal held, closed, found
            while True:
                found = self.cuts.search(held) if self.cuts and self.mark in held else None
                if found:
                    yield held[: found.start()]
                    held = held[found.end() :]
                    return
                keep = 0 if closed or not widest else widest - 1
                if len(held) > keep:
                    give, held = (held[:-keep], held[-keep:]) if keep else (held, "")
                    yield give
                if closed:
                    return
                if (more := next(source, None)) is None:
                    closed = True
                else:
                    held += more

        found = None
        while True:
            yield plain()
            if found is None:
                return
            yield self.merges.special[found[0]]

    def _plain(self, blocks: Iterator[str]) -> Iterator[bytes]:
        """Text between special tokens. Up to the last white space it is words; a stretch without any that grows long is
        normalised up to a safe place and given out piece by piece, its last piece as an open run."""
        held, ready, run, kind = "", "", None, ""
        for block in blocks:
            held += block
            out = b""
            if (run or ready) and (gap := GAPS.search(held)):
                out += self._rest(run, kind, ready + normal(held[: gap.start()]))
                held, ready, run = held[gap.end() :], "", None
            if not (run or ready):
                gap = last_gap(held)
                if gap:
                    out += self._words(held[: gap[0]])
                    held = held[gap[1] :]
            if run or ready or len(held) > self.merges.lookahead:
                cut = safe_cut(held)
                ready, held = ready + normal(held[:cut]), held[cut:]
                if run:
                    n = m.end() if (m := OPEN[kind].match(ready)) else 0
                    out += packed(run.feed(ready[:n].encode()))
                    ready = ready[n:]
                    if ready:
                        out, run = out + packed(run.close()), None
                if ready:
                    run, kind, ready, ids = self._open(ready)
                    out += ids
            yield out
        if run or ready:
            yield self._rest(run, kind, ready + normal(held))
        else:
            yield self._words(held)

    def _rest(self, run: Run | None, kind: str, ready: str) -> bytes:
        """The end of a long stretch."""
        out = b""
        if run:
            n = m.end() if (m := OPEN[kind].match(ready)) else 0
            out, ready = packed(run.feed(ready[:n].encode()) + run.close()), ready[n:]
        return out + self._pieces(ready)

    def _open(self, ready: str) -> tuple[Run | None, str, str, bytes]:
        """Of a long stretch, normalised so far: whole pieces as ids; the last, that may go on, as a run. What may become a contraction waits."""
        pieces = [m[0] for m in PIECE.finditer(ready)]
        tail = pieces.pop()
        if tail[0] == "'" and len(tail) <= 3:
            return None, "", tail, b"".join(map(self.__getitem__, pieces))
        if pieces and pieces[-1] == "'" and len(tail) == 1:
            return None, "", pieces.pop() + tail, b"".join(map(self.__getitem__, pieces))
        kind = next((k for k, p in OPEN.items() if p.match(tail)), "")
        if not kind:
            return None, "", "", b"".join(map(self.__getitem__, [*pieces, tail]))
        run = Run(self.merges)
        return run, kind, "", b"".join(map(self.__getitem__, pieces)) + packed(run.feed(tail.encode()))

    def _words(self, text: str) -> bytes:
        text = normal(text)
        odd = any(c in text for c in SEPARATORS)
        return b"".join(map(self.__getitem__, filter(None, GAPS.split(text)) if odd else text.split()))

    def encode(self, text: str) -> bytes:
        return b"".join(self.stream(blocks_of(text)))


def packed(ids: Iterable[int]) -> bytes:
    return array("I", ids).tobytes()


def unpacked(ids: bytes) -> array:
    return array("I", ids)


def blocks_of(text: str) -> Iterator[str]:
    return (text[k : k + BLOCK] for k in range(0, max(1, len(text)), BLOCK))


def last_gap(text: str) -> tuple[int, int] | None:
    """Start and end of the last white space of a text."""
    for k in range(len(text) - 1, -1, -1):
        if text[k].isspace() and text[k] not in SEPARATORS:
            end = k + 1
            while k and text[k - 1].isspace() and text[k - 1] not in SEPARATORS:
                k -= 1
            return k, end
    return None


def normal(text: str) -> str:
    """NFC, then lower case character by character (a final sigma gets no form of its own)."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def safe_cut(text: str) -> int:
    """The last place before which text can be normalised alone: in front of a character that nothing before it can change or join; 0 if there is none near the end."""
    for k in range(len(text) - 1, max(0, len(text) - CUT_WITHIN), -1):
        c = text[k]
        if c.isascii() or (unicodedata.category(c)[0] != "M" and not 0x1100 <= ord(c) <= 0x11FF and unicodedata.is_normalized("NFC", c)):
            return k
    return 0


class Decoder:
    """Ids to text, piece by piece. Without a decoder in the file, tokens are joined by a space, as the library does;
    with `by_bytes`, byte symbols become their bytes and a word's end a space."""

    def __init__(self, merges: Merges, by_bytes: bool = False) -> None:
        self.by_bytes, self.started = by_bytes, False
        self.state = codecs.getincrementaldecoder("utf-8")("replace")
        name = "bytes_of" if by_bytes else "names_of"
        if name not in merges.__dict__:
            back = {c: bytes([b]) for b, c in enumerate(byte_alphabet())}
            merges.__dict__[name] = [b""] * (max(merges.names) + 1)
            for i, token in merges.names.items():
                if by_bytes and i not in merges.special.values():
                    ends = bool(merges.suffix) and token.endswith(merges.suffix)
                    body = token[: -len(merges.suffix)] if ends else token
                    made = b"".join(back[c] for c in body) + b" " * ends
                else:
                    made = token.encode()
                merges.__dict__[name][i] = made
        self.data: list[bytes] = merges.__dict__[name]

    def feed(self, ids: Iterable[int]) -> str:
        joint = b"" if self.by_bytes else b" "
        data = joint.join(map(self.data.__getitem__, ids))
        if data and joint and self.started:
            data = joint + data
        self.started |= bool(data)
        return self.state.decode(data)

    def close(self) -> str:
        return self.state.decode(b"", True)


_ENCODERS: dict[tuple[int, int], Encoder] = {}


def encoder_of(source: str, memo: int = CACHE) -> Encoder:
    """One encoder for each Python worker, file and size of the memo, so that tasks share it."""
    if (k := (hash(source), memo)) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[k] = Encoder(Merges(source), memo)
    return _ENCODERS[k]


def read_spec(path: str | None = None) -> str:
    """The tokenizer file's content, read on the driver; its size is fixed by the vocabulary (a few MB), so it is broadcast."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return Path(path).read_text(encoding="utf-8")

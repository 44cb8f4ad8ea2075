"""Byte-pair encoding as a streaming transducer with bounded lookahead, and its inverse.

Text is cut into pieces by the pre-tokenizer's pattern; a piece is a string of bytes whose pairs are
merged by rank. A piece may be as long as its text, so it is read in windows: how far a change at the
right end of the bytes read so far can move token borders to the left is bounded, and that bound, the
*sufficient lookahead*, follows from the merge list alone (`Merges.lookahead`). Tokens that end at
least so far before the end of the window are final and are emitted; the rest is kept and extended.
Memory is one window, whatever the length of the piece.

Why a bound exists: two runs that differ only to the right of some byte differ, at the border to the
left of a symbol ``u``, first in a merge ``(u, v)`` that happens in one run alone. So the symbol to
the right of ``u`` differed before, by a merge of smaller rank whose left operand is ``v`` or a left
part of it. Ranks along such a chain fall strictly, so chains are finite, and one pass over the merges
in rank order gives the longest one in bytes.

Decoding is a state machine over bytes: it keeps the at most three bytes of an unfinished character.

Edge cases: NULL texts are empty; an empty text has no tokens; rows with equal ids are encoded one by
one; an empty table gives an empty result; further columns are ignored. Special tokens inside a text
are recognised, as the tokenizers library does by default.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import regex
from pyspark.sql import DataFrame

from netloom.llm.common import map_rows

# Fixed value: the pattern of byte-level vocabularies; \s is written as the Unicode property.
PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: The same pieces for texts of ASCII and Latin-1 letters alone, which the plainer engine finds faster.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
LATIN_PIECES = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\t-\r 0-9{_LETTERS}]+"
    r"|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
NOT_LATIN = re.compile(rf"[^\x00-\x7f{_LETTERS}]")
#: A place where a piece surely ends: before white space that follows other text.
BREAK = regex.compile(r"(?<=\P{White_Space})(?=\p{White_Space})")
CHUNK = 1 << 17
#: Pieces of so many characters at most are kept, so many of them.
KEPT_BYTES, KEPT_PIECES = 64, 400_000


def byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in vocabulary files: printable Latin-1 is itself."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """A vocabulary file's tokens, merges and special tokens."""

    def __init__(self, text: str):
        given = json.loads(text)
        letters = byte_letters()
        vocab = given["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in given.get("added_tokens", ())}
        self.bytes_of: dict[int, bytes] = {
            i: t.encode() if t in self.special else bytes(letters[c] for c in t) for t, i in vocab.items()}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.of_byte = [vocab.get(c) for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.pairs: dict[int, int] = {}                # (left << 32 | right) -> rank
        self.made: list[int] = []                      # rank -> token
        for rank, pair in enumerate(given["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[vocab[a] << 32 | vocab[b]] = rank
            self.made.append(vocab[a + b])
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        size = {i: len(b) for i, b in self.bytes_of.items()}
        left: dict[int, int] = {}                      # token -> left operand of the merge that makes it
        reach: dict[int, int] = {}                     # left operand -> longest chain of its merges so far
        for pair, made in zip(self.pairs, self.made):  # in rank order
            u, v = pair >> 32, pair & 0xFFFFFFFF
            longest, x = size[v], v
            while x is not None:
                longest = max(longest, reach.get(x, 0))
                x = left.get(x)
            reach[u] = max(reach.get(u, 0), size[u] + longest)
            left.setdefault(made, u)
        return max(reach.values(), default=0) + max(size.values(), default=0)

    def merge(self, data: bytes) -> list[int]:
        """All tokens of a string of bytes: the pair of smallest rank first, of equal ones the leftmost."""
        tokens = [self.of_byte[b] for b in data]
        return self._merge_long(tokens) if len(tokens) > 32 else self._merge_short(tokens)

    def _merge_short(self, tokens: list[int]) -> list[int]:
        get, made = self.pairs.get, self.made
        while len(tokens) > 1:
            best, left = None, tokens[0]
            for i in range(1, len(tokens)):
                right = tokens[i]
                rank = get(left << 32 | right)
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
                left = right
            if best is None:
                break
            tokens[at - 1:at + 1] = [made[best]]
        return tokens

    def _merge_long(self, tokens: list[int | None]) -> list[int]:
        n, get, made = len(tokens), self.pairs.get, self.made
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(rank, i, tokens[i], tokens[i + 1]) for i in range(n - 1)
                 if (rank := get(tokens[i] << 32 | tokens[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            rank, i, a, b = heapq.heappop(queue)
            j = after[i]
            if tokens[i] != a or j >= n or tokens[j] != b:
                continue
            new = tokens[i] = made[rank]
            tokens[j], after[i] = None, after[j]
            if (k := after[i]) < n:
                before[k] = i
                if (rank := get(new << 32 | tokens[k])) is not None:
                    heapq.heappush(queue, (rank, i, new, tokens[k]))
            if (h := before[i]) >= 0 and (rank := get(tokens[h] << 32 | new)) is not None:
                heapq.heappush(queue, (rank, h, tokens[h], new))
        return [t for t in tokens if t is not None]

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """The tokens of one piece that arrives in chunks; emits what more bytes can't change."""
        held, window = b"", 4 * self.lookahead
        for chunk in chunks:
            held += chunk
            while len(held) > window:
                part, done = held[:window], 0
                for token in self.merge(part):
                    if done + len(self.bytes_of[token]) > window - self.lookahead:
                        break
                    done += len(self.bytes_of[token])
                    yield token
                held = held[done:]
        yield from self.merge(held)


class Encoder(dict):
    """Tokens by piece; short pieces are kept, and forgotten together when there are many."""

    def __init__(self, merges: Merges):
        super().__init__({name: (token,) for name, token in merges.special.items()})
        self.merges = merges
        names = sorted(map(re.escape, merges.special), key=len, reverse=True)
        self.special = re.compile("|".join(names)) if names else None
        self.digits = Digits(self)

    def __missing__(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        if len(data) > KEPT_BYTES:
            window = 4 * self.merges.lookahead
            return tuple(self.merges.stream(data[i:i + window] for i in range(0, len(data), window)))
        tokens = self[piece] = tuple(self.merges.merge(data))
        return tokens

    def forget(self) -> None:
        if len(self) > KEPT_PIECES:
            self.clear()
            self.digits.clear()
            self.update((name, (token,)) for name, token in self.merges.special.items())

    def pieces(self, text: str) -> Iterator[list[str]]:
        """Lists of pieces, a chunk of text at a time; a special token is a piece."""
        at = 0
        for found in self.special.finditer(text) if self.special else ():
            yield from self._plain(text[at:found.start()])
            yield [found.group()]
            at = found.end()
        yield from self._plain(text[at:] if at else text)

    def _plain(self, text: str) -> Iterator[list[str]]:
        find = (PIECES if NOT_LATIN.search(text) else LATIN_PIECES).findall
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > CHUNK and (cut := BREAK.search(text, at + CHUNK)):
                end = cut.start()
            self.forget()
            yield find(text, at, end)
            at = end

    def tokens(self, pieces: list[str]) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, pieces)))

    def encode(self, text: str) -> list[int]:
        return [i for part in self.pieces(text) for i in self.tokens(part)]


class Digits(dict):
    """The tokens of a piece in decimal, joined by commas."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> str:
        text = ",".join(map(str, self.encoder[piece]))
        if len(piece) <= KEPT_BYTES:
            self[piece] = text
        return text


class Decoder:
    """Tokens to text; characters are given out once their bytes are complete."""

    def __init__(self, merges: Merges):
        self.bytes_of = merges.bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, tokens: list[int]) -> str:
        return self.state.decode(b"".join(map(self.bytes_of.__getitem__, tokens)))

    def finish(self) -> str:
        return self.state.decode(b"", final=True)


_LOADED: dict[str, Encoder] = {}


def _encoder(text: str) -> Encoder:
    """One encoder for each vocabulary and worker process, so that its pieces outlive a task."""
    name = hashlib.md5(text.encode()).hexdigest()
    if name not in _LOADED:
        _LOADED[name] = Encoder(Merges(text))
    return _LOADED[name]


def vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array) and text (what the ids decode to) of each row of ``docs``."""
    given = docs.sparkSession.sparkContext.broadcast(vocabulary(path))  # one vocabulary: a few MB

    def start():
        encoder = _encoder(given.value)

        def row(doc_id, text):
            ids, decoder, out = [], Decoder(encoder.merges), []
            for pieces in encoder.pieces(text or ""):
                part = encoder.tokens(pieces)
                ids += part
                out.append(decoder.feed(part))
            yield doc_id, ids, "".join(out) + decoder.finish()
        return row
    return map_rows(docs.select("doc_id", "text"), "doc_id bigint, ids array<int>, text string", start)


def encode_digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the text decoded from them."""
    given = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def start():
        encoder = _encoder(given.value)
        digits = encoder.digits.__getitem__

        def row(doc_id, text):
            n, of_ids, of_text, decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(encoder.merges)
            for pieces in encoder.pieces(text or ""):
                if pieces:
                    part = encoder.tokens(pieces)
                    of_ids.update((("," if n else "") + ",".join(map(digits, pieces))).encode())
                    n += len(part)
                    of_text.update(decoder.feed(part).encode())
            of_text.update(decoder.finish().encode())
            yield doc_id, n, of_ids.hexdigest(), of_text.hexdigest()
        return row
    return map_rows(docs.select("doc_id", "text"),
                    "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", start)

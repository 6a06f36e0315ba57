"""Streaming byte-pair encoding with a bounded lookahead, and its inverse.

A sequence of tokens is the encoding of its bytes exactly when each two neighbours are the encoding of theirs. So every
prefix of a text has one last token, found from the left: the token that ends there and fits the last token of the prefix
before it. Any later token reaches back at most as far as the longest token is long; the tokens on which all prefixes
within that distance agree can never change, and are emitted. That distance is the lookahead, computed from the ranks.
"""

from __future__ import annotations

import base64
import codecs
import os
from functools import lru_cache

import regex

#: The pattern that splits text before the merges of the public byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where the vocabulary files lie unless a parameter says otherwise.
TOKENIZERS = "/opt/tokenizers"
#: Characters that are buffered before a piece that is still growing is passed on in parts.
WINDOW = 65_536
#: Pieces whose tokens are remembered; the memory is emptied when it is full.
REMEMBERED = 200_000
#: Longer pieces are not remembered.
LONG = 200
_RUNS = {"L": regex.compile(r"\p{L}*"), "N": regex.compile(r"\p{N}*"), "S": regex.compile(r"\s*"), "O": regex.compile(r"[^\s\p{L}\p{N}]*")}
_CLASSES = [("L", regex.compile(r"\p{L}")), ("N", regex.compile(r"\p{N}")), ("S", regex.compile(r"\s")), ("O", regex.compile(r"."))]


class Vocabulary:
    """Ranks of a byte-level vocabulary and what follows from them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        #: No token is longer, so no later token can reach further back: the sufficient lookahead in bytes.
        self.lookahead = max(map(len, ranks))
        self.endings = {b[i:] for b in ranks for i in range(len(b))}
        self._fits: dict[tuple[int, int], bool] = {}
        self._reachable: dict[int, bool] = {}
        self._pieces: dict[str, tuple[int, ...]] = {}

    @classmethod
    def of(cls, data: bytes) -> Vocabulary:
        """From the content of a file of ranks."""
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())})

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls.of(f.read())

    def merged(self, data: bytes) -> list[bytes]:
        """The encoding by its definition: again and again join the neighbours of lowest rank, the leftmost first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens are the encoding of their bytes."""
        known = self._fits.get((left, right))
        if known is None:
            a, b = self.tokens[left], self.tokens[right]
            known = self.merged(a + b) == [a, b]
            if len(self._fits) >= 4 * REMEMBERED:
                self._fits.clear()
            self._fits[left, right] = known
        return known

    def reachable(self, token: int) -> bool:
        """Whether the token is the encoding of its own bytes; a vocabulary may hold some that no merge leads to."""
        known = self._reachable.get(token)
        if known is None:
            known = self._reachable[token] = self.merged(self.tokens[token]) == [self.tokens[token]]
        return known

    def piece(self, text: str) -> tuple[int, ...]:
        """Tokens of one piece of the pattern."""
        ids = self._pieces.get(text)
        if ids is None:
            machine = Transducer(self)
            ids = (*machine.feed(text.encode()), *machine.finish())
            if len(text) <= LONG:
                if len(self._pieces) >= REMEMBERED:
                    self._pieces.clear()
                self._pieces[text] = ids
        return ids


class Transducer:
    """Bytes of one piece in, tokens out as soon as they are stable."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self._bytes = bytearray()
        #: Last token of each prefix of what is held; its length says where the prefix before it ends.
        self._last: list[int] = [-1]
        #: The last token emitted, which the first held one must fit.
        self._before = -1

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        step = 8 * self.v.lookahead
        for at in range(0, len(data), step):
            self._extend(data[at : at + step])
            if len(self._bytes) > step:
                out += self._emit(self._settled())
        return out

    def finish(self) -> list[int]:
        return self._emit(len(self._bytes)) if self._bytes else []

    def _extend(self, data: bytes) -> None:
        v, held, last = self.v, self._bytes, self._last
        for byte in data:
            held.append(byte)
            end = len(held)
            found = -1
            for start in range(end - 1, max(-1, end - 1 - v.lookahead), -1):
                part = bytes(held[start:end])
                if part not in v.endings:
                    break
                token = v.ranks.get(part, -1)
                if token >= 0:
                    left = last[start] if start else self._before
                    # only the first token of a piece has none before it; it must be the encoding of its own bytes
                    if v.fits(left, token) if left >= 0 else not start and v.reachable(token):
                        found = token
            last.append(found)

    def _settled(self) -> int:
        """Longest prefix that every prefix within the lookahead, hence every continuation, goes through."""
        ends = set(range(len(self._bytes) - self.v.lookahead + 1, len(self._bytes) + 1))
        while len(ends) > 1:
            top = max(ends)
            ends.remove(top)
            ends.add(top - len(self.v.tokens[self._last[top]]))
        return ends.pop()

    def _emit(self, end: int) -> list[int]:
        out, at = [], end
        while at:
            out.append(self._last[at])
            at -= len(self.v.tokens[self._last[at]])
        if end:
            self._before = self._last[end]
            del self._bytes[:end]
            del self._last[1 : end + 1]
        return out[::-1]


class StreamEncoder:
    """Text in parts of any size in, token ids out; memory does not grow with the text."""

    def __init__(self, vocabulary: Vocabulary, pattern: str = PATTERN, window: int = WINDOW):
        self.v, self._pattern, self._window = vocabulary, _compiled(pattern), window
        self._text, self._open, self._kind = "", None, ""

    def feed(self, text: str) -> list[int]:
        self._text += text
        return self._take(False) if len(self._text) > self._window else []

    def finish(self) -> list[int]:
        out = self._take(True)
        self._text, self._open = "", None
        return out

    def _take(self, final: bool) -> list[int]:
        out: list[int] = []
        if self._open:
            out += self._continue(final)
            if self._open:
                return out
        text = self._text
        if final:
            for piece in self._pattern.findall(text):
                out += self.v.piece(piece)
            self._text = ""
            return out
        # what more text can change: a run at the end, and up to three characters that may become a contraction
        cut = 0
        for m in self._pattern.finditer(text):
            cut = m.start()
            if m.end() > len(text) - 3:
                break
            out += self.v.piece(m[0])
        self._text = text[cut:]
        if len(self._text) > self._window // 2:
            m = self._pattern.match(self._text)
            self._kind = next(k for k, c in _CLASSES if c.match(m[0][-1]) or k == "O")
            self._open = Transducer(self.v)
            sure = m.end() - (self._kind == "S")
            out += self._open.feed(self._text[:sure].encode())
            self._text = self._text[sure:]
        return out

    def _continue(self, final: bool) -> list[int]:
        """Go on with a piece that is longer than the window."""
        text, end = self._text, _RUNS[self._kind].match(self._text).end()
        over = final or end < len(text)
        if self._kind == "S" and not (final and end == len(text)):
            end = max(0, end - 1)  # the last space may belong to the next piece
        out = self._open.feed(text[:end].encode())
        self._text = text[end:]
        if over:
            out += self._open.finish()
            self._open = None
        return out


class StreamDecoder:
    """Token ids in, text out as soon as its bytes are complete; bytes that are not UTF-8 become U+FFFD."""

    def __init__(self, vocabulary: Vocabulary):
        self._tokens = vocabulary.tokens
        self._state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        return self._state.decode(b"".join(self._tokens[i] for i in ids))

    def finish(self) -> str:
        return self._state.decode(b"", True)


@lru_cache(8)
def _compiled(pattern: str):
    return regex.compile(pattern)


#: The greatest vocabulary file, in bytes, that is sent to the workers.
MOST_BYTES = 64 << 20


def vocabulary_file(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> bytes:
    """The content of a vocabulary file of this machine; one beyond MOST_BYTES is refused."""
    path = os.path.join(folder, f"{name}.tiktoken")
    if os.path.getsize(path) > MOST_BYTES:
        raise ValueError(f"{path} is too large for a vocabulary")
    with open(path, "rb") as f:
        return f.read()


@lru_cache(4)
def vocabulary(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Vocabulary:
    """A vocabulary file, loaded once per process."""
    return Vocabulary.of(vocabulary_file(name, folder))


@lru_cache(4)
def vocabulary_of(data: bytes) -> Vocabulary:
    """A vocabulary from the content of its file, made once per process."""
    return Vocabulary.of(data)


def encode(text: str | None, v: Vocabulary) -> list[int]:
    """Token ids of a text; an empty or null text has none."""
    if not text:
        return []
    encoder, out = StreamEncoder(v), []
    for at in range(0, len(text), WINDOW):
        out += encoder.feed(text[at : at + WINDOW])
    return out + encoder.finish()


def decode(ids: list[int], v: Vocabulary) -> str:
    decoder = StreamDecoder(v)
    return decoder.feed(ids) + decoder.finish()

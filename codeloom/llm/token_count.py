"""Token counts by a finite-state transducer compiled from a byte-pair vocabulary.

Byte-pair encoding within a pretoken is finite-state: the encoding of a prefix
ends in the one token that is compatible with the last token of the prefix
before it, so what follows depends only on the suffixes that may still grow
into a token, and on the last token and the relative count where each begins.
Deterministic states of that kind are built as texts first need them, each
transition is annotated with the number of tokens that it emits (it may be
negative where a longer token swallows shorter ones).  The pretoken pattern, a
finite-state machine itself, runs before it and resets it.

A text is cut into chunks.  Each chunk's state map is (head, settled, tail):
the characters before its first certain pretoken start, the tokens between its
first and last certain starts, and the characters after them.  Maps compose
associatively, and a prefix scan in a logarithmic number of rounds gives the
text's count.
"""

from __future__ import annotations

import base64
import gc
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK = 1 << 16
STATES = 250_000
STRETCHES = 400_000
TOGETHER = 1 << 20
_FEW = 24
_EMIT = 1 << 11
_SPACE = frozenset(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

_TWO = re.compile(r"\s[ \n]")
_STRETCH = re.compile("[{0}]*[^{0}]+|[{0}]+".format("".join(f"\\u{ord(c):04x}" for c in sorted(_SPACE))))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})


class _Piece(dict):
    """State within one pretoken: byte -> (state, tokens emitted)."""

    __slots__ = ("suffix", "live", "own", "number")

    def __init__(self, own: "Transducer", suffix: bytes, live: tuple):
        self.own, self.suffix, self.live, self.number = own, suffix, live, len(own.pieces)

    def __missing__(self, b: int):
        own = self.own
        grown, get, prefixes = self.suffix + bytes((b,)), own.ranks.get, own.prefixes
        size, emitted, kept = len(grown), None, []
        for n, last, rel in self.live:
            part = grown[size - n - 1 :]
            if emitted is None:
                token = get(part)
                if token is not None and (last < 0 or own.fits(last, token)):
                    emitted = rel + 1
            if part in prefixes:
                kept.append((n + 1, last, rel))
        if emitted is None:
            raise ValueError(f"no token ends with byte {b}: the vocabulary lacks single bytes")
        live = (*[(n, last, r - emitted) for n, last, r in kept], (0, token, 0))
        out = self[b] = own.piece(grown[size - live[0][0] :] if kept else b"", live), emitted
        return out


class Transducer:
    """Counts the tokens of texts; compiled as far as the texts seen so far need it."""

    def __init__(self, path: str = VOCABULARY):
        self.encoding = encoding(path)
        self.ranks = load_ranks(path)
        self.bytes = {v: k for k, v in self.ranks.items()}
        self.split = regex.compile(PATTERN).findall
        self.prefixes = {t[:k] for t in self.ranks for k in range(1, len(t))}
        self.pairs: dict = {}
        self.pieces: dict = {}
        self.known: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        """Forgets the compiled states, when they are too many to keep."""
        for p in self.pieces.values():
            p.clear()
        self.pairs, self.pieces, self.states = {}, {}, []
        #: Column of each byte in the table, -1 for bytes not seen yet; next state times 4096 plus emission plus 2048, or -1.
        self.column = np.full(256, -1, np.int16)
        self.table = np.full((1024, 32), -1, np.int32)
        self.root = self.piece(b"", ((0, -1, 0),))

    def fits(self, a: int, b: int) -> bool:
        got = self.pairs.get((a, b))
        if got is None:
            got = self.pairs[a, b] = self.encoding._core_bpe.encode_single_piece(self.bytes[a] + self.bytes[b]) == [a, b]
        return got

    def piece(self, suffix: bytes, live: tuple) -> _Piece:
        got = self.pieces.get((suffix, live))
        if got is None:
            got = _Piece(self, suffix, live)
            self.pieces[suffix, live] = got
            self.states.append(got)
            if len(self.states) > len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
        return got

    def run(self, text: str) -> int:
        """Tokens of a text from a certain pretoken start on."""
        n = 0
        for pretoken in self.split(text):
            s = self.root
            for b in pretoken.encode("utf-8", "replace"):
                s, d = s[b]
                n += d
        return n

    def _columns(self, b: np.ndarray) -> np.ndarray:
        """The table columns of bytes; a new byte gets the next one."""
        new = np.unique(b[self.column[b] < 0])
        if len(new):
            used = int(self.column.max()) + 1
            self.column[new] = np.arange(used, used + len(new))
            while used + len(new) > self.table.shape[1]:
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)], 1)
        return self.column[b]

    def _compile(self, state: np.ndarray, byte: np.ndarray) -> None:
        for k in np.unique(state.astype(np.int64) << 8 | byte).tolist():
            at, emitted = self.states[k >> 8][k & 255]
            if not -_EMIT <= emitted < _EMIT:
                raise ValueError("a token of over 2048 bytes")
            self.table[k >> 8, self.column[k & 255]] = at.number << 12 | emitted + _EMIT

    def walk(self, pretokens: list[bytes]) -> np.ndarray:
        """Tokens of each pretoken.  All go through the table in step, a byte each."""
        size = np.fromiter(map(len, pretokens), np.int64, len(pretokens))
        order = np.argsort(-size, kind="stable")
        start = (np.cumsum(size) - size)[order]
        size = size[order]
        every = np.frombuffer(b"".join(pretokens), np.uint8)
        state, n = np.zeros(len(size), np.int32), np.zeros(len(size), np.int64)
        column = self._columns(every)
        k = 0
        active = len(size)
        while active:
            active = int(np.searchsorted(-size, -k, "left"))  # those longer than k bytes
            if active <= _FEW:
                break
            at = start[:active] + k
            c = column[at]
            got = self.table[state[:active], c]
            missing = np.flatnonzero(got < 0)
            if len(missing):
                self._compile(state[missing], every[at[missing]])
                got[missing] = self.table[state[missing], c[missing]]
            state[:active] = got >> 12
            n[:active] += (got & 4095) - _EMIT
            k += 1
        for j in range(active):
            s = self.states[state[j]]
            for b in every[start[j] + k : start[j] + size[j]].tolist():
                s, d = s[b]
                n[j] += d
        out = np.empty(len(n), np.int64)
        out[order] = n
        return out

    def settled(self, texts: list[str]) -> list[int]:
        """Tokens of texts that each begin and end at certain pretoken starts (or a text's ends).

        Between certain starts a count doesn't depend on the state before, so
        what a stretch emits is kept and taken again where it recurs.
        """
        out, i = [0] * len(texts), 0
        while i < len(texts):
            j, n, found, cuts = i, 0, [], [0]
            while j < len(texts) and (j == i or n + len(texts[j]) <= TOGETHER):
                n += len(texts[j])
                found += _stretches(texts[j])
                cuts.append(len(found))
                j += 1
            counts = list(map(self.known.get, found))
            if None in counts:
                new = list({x for x, n in zip(found, counts) if n is None})
                pieces = list(map(self.split, new))
                pretokens = [p.encode("utf-8", "replace") for x in pieces for p in x]
                ends = np.cumsum([0, *map(len, pieces)])
                got = dict(zip(new, np.diff(np.append(0, np.cumsum(self.walk(pretokens)))[ends]).tolist()))
                counts = [got[x] if n is None else n for x, n in zip(found, counts)]
                if len(self.known) > STRETCHES:
                    self.known = {}
                self.known.update((x, n) for x, n in got.items() if len(x) <= 40)
            total = np.append(0, np.cumsum(np.array(counts, np.int64)))[cuts]
            out[i:j] = np.diff(total).tolist()
            if len(self.states) > STATES:
                self.reset()
            i = j
        return out

    def chunk_maps(self, chunks: list[str]) -> list[tuple[str, int, str | None]]:
        """(head, settled, tail) of each; a tail of None: no pretoken starts for certain in the chunk."""
        ends = [(_first_start(c), _last_start(c)) for c in chunks]
        inner = self.settled([c[a:b] if a >= 0 else "" for c, (a, b) in zip(chunks, ends)])
        return [(c[:a], n, c[b:]) if a >= 0 else (c, 0, None) for c, (a, b), n in zip(chunks, ends, inner)]

    def compose(self, a: tuple, b: tuple) -> tuple:
        if a[2] is None:
            return (a[0] + b[0], *b[1:]) if b[2] is not None else (a[0] + b[0], 0, None)
        if b[2] is None:
            return a[0], a[1], a[2] + b[0]
        return a[0], a[1] + self.run(a[2] + b[0]) + b[1], b[2]

    def counts(self, texts: list[str | None], chunk: int = CHUNK) -> list[int | None]:
        """Tokens of each text, None for None."""
        short = [k for k, t in enumerate(texts) if t is not None and len(t) <= chunk]
        out: list[int | None] = [None] * len(texts)
        for k, n in zip(short, self.settled([texts[k] for k in short])):
            out[k] = n
        for k, t in enumerate(texts):
            if t is not None and len(t) > chunk:
                head, n, tail = scan(self.chunk_maps(cut(t, chunk)), self.compose)
                out[k] = self.run(head) + n + self.run(tail or "")
        return out

    def count(self, text: str, chunk: int = CHUNK) -> int:
        return self.counts([text], chunk)[0]


def _stretches(text: str) -> list[str]:
    """The text, cut at certain pretoken starts."""
    if "\0" in text or _TWO.search(text):
        return _STRETCH.findall(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")


def _first_start(chunk: str) -> int:
    return next((k for k in range(1, len(chunk)) if chunk[k] in _SPACE and chunk[k - 1] not in _SPACE), -1)


def _last_start(chunk: str) -> int:
    return next((k for k in range(len(chunk) - 1, 0, -1) if chunk[k] in _SPACE and chunk[k - 1] not in _SPACE), -1)


def cut(text: str, chunk: int) -> list[str]:
    return [text[i : i + chunk] for i in range(0, len(text), chunk)]


def scan(maps: list[tuple], compose) -> tuple:
    """Composition of all chunks' maps, by pairs: each round halves their number."""
    while len(maps) > 1:
        maps = [compose(maps[i], maps[i + 1]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


@lru_cache(maxsize=1)
def _transducer(path: str) -> Transducer:
    return Transducer(path)


def counter(path: str = VOCABULARY):
    """Column function: text -> number of tokens under the vocabulary at ``path``."""

    @F.arrow_udf("long")
    def tokens(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = _transducer(path)
        gc.freeze()
        gc.disable()  # the states are many small objects, live until reset() drops them all
        for p in parts:
            yield pa.array(machine.counts(p.to_pylist()), pa.int64())

    return tokens


def token_counts(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) for each row of ``docs``, without a shuffle.

    An empty text has 0 tokens, a null text a null count.  Repeated rows and
    null ids come out as they went in; other columns aren't looked at.
    """
    return docs.select("doc_id", counter(path)("text").alias("n_tokens"))

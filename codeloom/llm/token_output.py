"""Token-ID output as patched frame-of-reference blocks.

A document's token ids are cut into blocks of 128.  Each block stores its
minimum, the differences packed at the width that a percentile of them needs,
and an exception list with the high bits of the outliers.  An index of block
starts allows any block to be read alone.

Layout, little-endian: u32 tokens, u32 blocks, u32 start of each block, then per
block u32 minimum, u8 width, u8 exceptions, 16 x width bytes of packed values,
u8 places and u32 high parts of the exceptions.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import token_count as tc

BLOCK = 128
PERCENTILE = 0.9
SLICE = 1 << 18


class Encoder:
    """Text to token ids; a long text goes in slices that end at certain pretoken starts."""

    def __init__(self, path: str):
        self.encode = tc.encoding(path).encode_ordinary

    def ids(self, text: str) -> np.ndarray:
        """Token ids as uint32.  Unpaired surrogates, which UTF-8 can't hold, count as '?'."""
        text = text.encode("utf-8", "replace").decode()
        if len(text) <= SLICE:
            return np.array(self.encode(text), np.uint32)
        return np.concatenate([np.array(self.encode(x), np.uint32) for x in slices(text)])


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """A text cut only where a pretoken starts for certain, so the slices' tokens are the text's."""
    at = 0
    while at < len(text):
        to = at + size
        while to < len(text) and not (text[to] in tc._SPACE and text[to - 1] not in tc._SPACE):
            to += 1
        yield text[at:to]
        at = to


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _width(x: np.ndarray) -> np.ndarray:
    """Bits that each uint32 needs."""
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def pack_many(docs: list[np.ndarray], percentile: float = PERCENTILE) -> list[bytes]:
    """Each array of ids in the layout above; empty arrays give a header alone."""
    sizes = np.array([len(d) for d in docs], np.int64)
    n_blocks = -(-sizes // BLOCK)
    total = int(n_blocks.sum())
    first = np.cumsum(n_blocks) - n_blocks
    v = np.zeros((total, BLOCK), np.uint32)
    inside = np.zeros((total, BLOCK), bool)
    flat, flat_in = v.reshape(-1), inside.reshape(-1)
    for d, k in zip(docs, first):
        flat[k * BLOCK : k * BLOCK + len(d)] = d
        flat_in[k * BLOCK : k * BLOCK + len(d)] = True
    low = np.where(inside, v, np.uint32(0xFFFFFFFF)).min(1) if total else np.zeros(0, np.uint32)
    delta = np.where(inside, v - low[:, None], np.uint32(0))
    bits = _width(delta)
    held = inside.sum(1)
    order = np.sort(np.where(inside, bits, np.uint8(255)), axis=1)
    width = order[np.arange(total), np.maximum(0, np.ceil(percentile * held).astype(np.int64) - 1)].astype(np.int64) if total else np.zeros(0, np.int64)
    out_of = bits > width[:, None]
    n_exc = out_of.sum(1)
    size = 6 + 16 * width + 5 * n_exc
    head = 8 + 4 * n_blocks
    ends = np.cumsum(size)
    before = ends - size
    doc_of = np.repeat(np.arange(len(docs)), n_blocks)
    body = np.add.reduceat(np.append(size, 0), np.minimum(first, total)) * (n_blocks > 0) if len(docs) else np.zeros(0, np.int64)
    doc_at = np.cumsum(head + body) - head - body
    start = head[doc_of] + before - before[np.minimum(first, max(0, total - 1))][doc_of] if total else np.zeros(0, np.int64)
    where = doc_at[doc_of] + start
    buf = np.zeros(int((head + body).sum()), np.uint8)
    for d in range(len(docs)):
        a, n = doc_at[d], n_blocks[d]
        buf[a : a + 8] = np.array([sizes[d], n], np.uint32).view(np.uint8)
        buf[a + 8 : a + 8 + 4 * n] = start[first[d] : first[d] + n].astype(np.uint32).view(np.uint8)
    fixed = np.zeros((total, 6), np.uint8)
    fixed[:, :4] = low.reshape(-1, 1).view(np.uint8) if total else 0
    fixed[:, 4], fixed[:, 5] = width, n_exc
    buf[where[:, None] + np.arange(6)] = fixed
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        for lo in range(0, len(at) if w else 0, 2048):
            own = at[lo : lo + 2048]
            rows = np.ascontiguousarray(delta[own].astype("<u4")).view(np.uint8).reshape(len(own), BLOCK, 4)
            packed = np.packbits(np.unpackbits(rows, axis=2, bitorder="little")[:, :, :w].reshape(len(own), -1), axis=1, bitorder="little")
            buf[where[own][:, None] + 6 + np.arange(16 * w)] = packed
    row, col = np.nonzero(out_of)
    if len(row):
        nth = np.arange(len(row)) - (np.cumsum(n_exc) - n_exc)[row]
        at = where[row] + 6 + 16 * width[row]
        buf[at + nth] = col
        high = (delta[row, col] >> width[row].astype(np.uint32)).astype("<u4")
        buf[(at + n_exc[row] + 4 * nth)[:, None] + np.arange(4)] = high.reshape(-1, 1).view(np.uint8)
    return [buf[a : a + n].tobytes() for a, n in zip(doc_at.tolist(), (head + body).tolist())]


def unpack_block(payload: bytes, k: int) -> np.ndarray:
    """The token ids of block ``k`` alone, found through the index."""
    n, blocks = np.frombuffer(payload, "<u4", 2)
    at = int(np.frombuffer(payload, "<u4", 1, 8 + 4 * k)[0])
    low = int(np.frombuffer(payload, "<u4", 1, at)[0])
    w, n_exc = payload[at + 4], payload[at + 5]
    held = BLOCK if k + 1 < blocks else int(n) - BLOCK * k
    v = np.zeros(BLOCK, np.int64)
    if w:
        bits = np.unpackbits(np.frombuffer(payload, np.uint8, 16 * w, at + 6), bitorder="little").reshape(BLOCK, w)
        v += (bits.astype(np.int64) << np.arange(w)).sum(1)
    at += 6 + 16 * w
    place = np.frombuffer(payload, np.uint8, n_exc, at)
    v[place] += np.frombuffer(payload, "<u4", n_exc, at + n_exc).astype(np.int64) << w
    return v[:held] + low


def unpack(payload: bytes) -> np.ndarray:
    blocks = int(np.frombuffer(payload, "<u4", 2)[1])
    return np.concatenate([unpack_block(payload, k) for k in range(blocks)]) if blocks else np.zeros(0, np.int64)


def encode(docs: DataFrame, path: str = tc.VOCABULARY, percentile: float = PERCENTILE) -> DataFrame:
    """(doc_id, n_tokens, n_blocks, payload) of each row, without a shuffle.

    A null text gives null in all but doc_id, an empty one a header that says
    0 tokens.  Rows are encoded one by one: repeated rows repeat, a null id
    stays null, an empty table gives none, other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for whole in batches:
            texts = whole.column(1)
            at = 0
            while at < len(texts):
                own, n, to = [], 0, at
                while to < len(texts) and n < 1 << 20:
                    t = texts[to].as_py()
                    own.append(None if t is None else encoder.ids(t))
                    n += 0 if t is None else len(t)
                    to += 1
                packed = iter(pack_many([x for x in own if x is not None], percentile))
                yield pa.RecordBatch.from_arrays(
                    [
                        whole.column(0).slice(at, to - at),
                        pa.array([None if x is None else len(x) for x in own], pa.int64()),
                        pa.array([None if x is None else -(-len(x) // BLOCK) for x in own], pa.int64()),
                        pa.array([None if x is None else next(packed) for x in own], pa.binary()),
                    ],
                    names=["doc_id", "n_tokens", "n_blocks", "payload"],
                )
                at = to

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_tokens long, n_blocks long, payload binary")

"""Toxicity: a character n-gram linear classifier over naive Bayes log-count ratios.

A text's features are which hashed character n-grams it holds.  Each is scaled
by the log ratio of its document counts among toxic and clean labelled texts
(Wang and Manning, 2012), and a logistic regression is fitted on the scaled
features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import _store, _text

BITS = 20
ORDERS = (3, 4, 5, 6)
SLICE = 1 << 17
_EDGE = 0
_PART = 1 << 19
_TOGETHER = 1 << 20
_BUCKETS = 1 << 16


@dataclass
class Model:
    """``weight[b]``: what n-gram bucket b adds to the logit when it occurs."""

    weight: np.ndarray
    bias: float
    threshold: float = 0.5


def _hits(cp: np.ndarray, useful: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each useful n-gram in texts on end.

    In ``cp`` a code point of `_EDGE` stands before, between and after the
    texts and counts as a blank, as does each run of other characters than
    letters and digits.  No n-gram reaches over an edge.
    """
    edge = cp == _EDGE
    v = _text._letters()[np.where(edge, np.uint32(32), cp)]
    keep = (v != 0) | edge
    keep[1:] |= v[:-1] != 0
    edges = np.flatnonzero(edge[keep])
    v = (v[keep] >> np.uint64(20)).astype(np.uint32)
    rows, buckets = [], []
    for n, h in _orders(v):
        at = np.flatnonzero(useful[h])
        after = np.searchsorted(edges, at, "right")
        within = (after > 0) & (after < len(edges))
        at, after = at[within], after[within]
        own = edges[after] >= at + n - 1
        rows.append(after[own] - 1)
        buckets.append(h[at[own]])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    return np.concatenate(rows), np.concatenate(buckets)


def _orders(v: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each order n, the buckets of the n-grams that begin at each place."""
    g = np.zeros(len(v), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        m = len(v) - n + 1
        if m <= 0:
            return
        g = g[:m]
        g *= np.uint32(0x9E3779B1)
        g += v[n - 1 :]
        if n in ORDERS:
            h = g ^ (g >> np.uint32(15))
            h *= np.uint32(0x2C1B3C6D + 2 * n)
            h >>= np.uint32(32 - BITS)
            yield n, h


def _long_hits(text: str, useful: np.ndarray) -> np.ndarray:
    """Distinct useful buckets of one text, slice by slice.

    What n-grams need of the slice before is carried over, so they are those of
    the whole text wherever it is cut, within words too.
    """
    flag = np.zeros(1 << BITS, bool)
    carry, before = np.zeros(1, np.uint32), False
    for at in range(0, len(text), SLICE):
        v = _text._letters()[_text.codepoints(text[at : at + SLICE])]
        inside = v != 0
        keep = inside.copy()
        keep[1:] |= inside[:-1]
        keep[0] |= before
        before = bool(inside[-1])
        own = np.concatenate([carry, (v[keep] >> np.uint64(20)).astype(np.uint32), np.zeros(int(at + SLICE >= len(text)), np.uint32)])
        for _, h in _orders(own):
            flag[h] = True
        carry = own[-(max(ORDERS) - 1) :]
    return np.flatnonzero(flag & useful).astype(np.uint32)


def present(texts: list, useful: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, bucket) of the n-grams that ``useful`` marks, by text number.

    A text longer than a slice is worked off in slices (see `_long_hits`), so that no n-gram
    is lost or added.
    """
    rows, buckets = [], []
    for i, j in _text.groups(texts, SLICE):
        one = texts[i] or ""
        if len(one) <= SLICE:
            cp = _text.codepoints("\x00" + "\x00".join((t or "").replace("\x00", " ") for t in texts[i:j]) + "\x00")
            r, h = _hits(cp, useful)
            rows.append(r + i)
            buckets.append(h)
            continue
        h = _long_hits(one, useful)
        buckets.append(h)
        rows.append(np.full(len(h), i))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    row, bucket = np.concatenate(rows), np.concatenate(buckets)
    packed = np.unique((row.astype(np.uint64) << np.uint64(BITS)) | bucket)
    return (packed >> np.uint64(BITS)).astype(np.int64), (packed & np.uint64((1 << BITS) - 1)).astype(np.uint32)


def sample_labelled(docs: DataFrame, labels: DataFrame, most: int, seed: int) -> DataFrame:
    """(text, y) of at most ``most`` labelled documents, the same ones on every run.

    Labels without id or verdict are left out; of contradictory labels of one
    document the toxic one counts; of rows that share an id the smallest text counts.
    """
    own = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("y"))
        .orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id")
        .limit(most)
    )
    texts = docs.where("text is not null").select("doc_id", "text")
    return texts.join(F.broadcast(own), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("text", "y")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, 1 << BITS), np.int32)
    rows = np.zeros(2, np.int64)
    all_of, flag = np.ones(1 << BITS, bool), np.zeros(1 << BITS, bool)
    for b in batches:
        for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            k = int(y > 0)
            flag[present([t], all_of)[1]] = True
            at = np.flatnonzero(flag)
            total[k, at] += 1
            flag[at] = False
            rows[k] += 1
    for k in (0, 1):
        for part in range(0, 1 << BITS, _BUCKETS):
            own = total[k, part : part + _BUCKETS]
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([int(rows[k])]), pa.array([part]), pa.array([own.tobytes()], pa.binary())], names=["y", "n", "part", "c"])


def _add(parts: pa.Table) -> pa.Table:
    """The sum of all tasks' counts of one part of the buckets."""
    total = np.zeros(_BUCKETS, np.int64)
    for c in parts.column("c"):
        total += np.frombuffer(c.as_py(), np.int32)
    return pa.table({"y": parts.column("y")[:1], "n": pa.array([sum(parts.column("n").to_pylist())]), "part": parts.column("part")[:1], "c": pa.array([total.astype(np.int32).tobytes()], pa.binary())})


def train(
    docs: DataFrame,
    labels: DataFrame,
    most: int = 20_000,
    alpha: float = 0.5,
    least_z: float = 3.0,
    l2: float = 1e-3,
    steps: int = 150,
    threshold: float = 0.4,
    seed: int = 7,
) -> Model:
    """Fits the classifier on a bounded sample of the labelled documents.

    most: bound on labelled documents used; alpha: smoothing of the counts;
    least_z: n-grams whose log ratio is nearer to 0 than this many standard
    errors are left out, as their scaled features carry noise only.
    Without labels of both kinds, or without n-grams that tell them apart, no text is ever toxic.
    """
    sample = _store.materialize(sample_labelled(docs, labels, most, seed), "toxicity-sample")
    total, rows = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
    counts = "y long, n long, part long, c binary"
    for r in sample.coalesce(12).mapInArrow(_count, counts).groupBy("y", "part").applyInArrow(_add, counts).collect():
        total[r.y, r.part : r.part + _BUCKETS] = np.frombuffer(r.c, np.int32)
        rows[r.y] = r.n
    weight = np.zeros(1 << BITS, np.float32)
    if not rows.all():
        _store.discard(sample)
        return Model(weight, -20.0, threshold)
    p, q = (total[1] + alpha) / (rows[1] + 2 * alpha), (total[0] + alpha) / (rows[0] + 2 * alpha)
    ratio = np.log(p / q)
    useful = np.abs(ratio) >= least_z * np.sqrt(1 / (total[1] + alpha) + 1 / (total[0] + alpha))
    if not useful.any():
        _store.discard(sample)
        return Model(weight, -20.0, threshold)
    flags = np.packbits(useful).tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.unpackbits(np.frombuffer(flags, np.uint8)).astype(bool)
        for b in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            row, bucket = present(b.column(0).to_pylist(), on)
            cuts = np.searchsorted(row, np.arange(1, b.num_rows))
            got = [x.astype(np.int32).tobytes() for x in np.split(bucket, cuts)]
            yield pa.RecordBatch.from_arrays([b.column(1).cast(pa.int64()), pa.array(got, pa.binary())], names=["y", "at"])

    coded = _store.materialize(sample.coalesce(12).mapInArrow(encode, "y long, at binary"), "toxicity-features")
    _store.discard(sample)
    feats, y = [], []
    for r in coded.toLocalIterator():  # one file's rows at a time
        feats.append(np.frombuffer(r.at, np.int32))
        y.append(r.y)
    _store.discard(coded)
    y = np.array(y, np.float64)
    w, bias = _fit(feats, y, ratio, l2, steps)
    weight[:] = w
    return Model(weight, bias, threshold)


def _fit(feats: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, l2: float, steps: int) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent on the logistic loss; returns weight times ratio.

    The features stand in row order only, as 32-bit numbers, and a step works them
    off by about `_PART` at a time, so it makes no array as long as they are.
    """
    out = np.zeros(len(ratio), np.float32)
    size = np.array([len(f) for f in feats])
    n = len(y)
    bias = float(np.log(y.mean() / (1 - y.mean())))
    if not size.sum():
        return out, bias
    used = np.unique(np.concatenate([np.unique(np.concatenate(feats[i : i + 500])) for i in range(0, n, 500)]))
    starts = np.append(0, np.cumsum(size))
    cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, starts[-1], _PART)), n))
    parts = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        parts.append((a, b, np.searchsorted(used, np.concatenate(feats[a:b])).astype(np.int32)))
        feats[a:b] = [None] * (b - a)  # a row's features stand in one place only
    feats.clear()

    def by_row(x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(np.repeat(np.arange(b - a), size[a:b]), x[col], b - a) for a, b, col in parts])

    def by_column(x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(used))
        for a, b, col in parts:
            out += np.bincount(col, np.repeat(x[a:b], size[a:b]), len(used))
        return out

    scale = ratio[used].astype(np.float32)
    norm = by_row(scale * scale)
    step = n**0.5 / (0.25 * float(norm.max()) + 0.25 + l2)
    w = v = np.zeros(len(used), np.float32)
    vb = bias
    for k in range(steps):
        z = vb + by_row(scale * v)
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        gw = scale * by_column(g).astype(np.float32) + l2 * v / n
        nw, nb = v - np.float32(step) * gw, vb - step * g.sum()
        mu = k / (k + 3)
        v, vb = nw + np.float32(mu) * (nw - w), nb + mu * (nb - bias)
        w, bias = nw, nb
    out[used] = w * scale
    return out, float(bias)


def logits(texts: list, model: Model) -> np.ndarray:
    """Of each text; about `_TOGETHER` characters are looked at together, whatever the number of texts."""
    out, useful = np.full(len(texts), model.bias), model.weight != 0
    for i, j in _text.groups(texts, _TOGETHER):
        row, bucket = present(texts[i:j], useful)
        out[i:j] += np.bincount(row, model.weight[bucket].astype(np.float64), j - i)
    return out


def scorer(model: Model):
    """Column function: text -> probability of being toxic (0 for null or empty text)."""
    at = np.flatnonzero(model.weight).astype(np.int32)
    packed, bias, threshold = (at.tobytes(), model.weight[at].tobytes()), model.bias, model.threshold

    @F.arrow_udf("double")
    def probability(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weight = np.zeros(1 << BITS, np.float32)
        weight[np.frombuffer(packed[0], np.int32)] = np.frombuffer(packed[1], np.float32)
        own = Model(weight, bias, threshold)
        for p in parts:
            texts = p.to_pylist()
            z = np.clip(logits(texts, own), -30, 30)
            yield pa.array(np.where([not t for t in texts], 0.0, 1 / (1 + np.exp(-z))))

    return probability


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, toxicity, toxic) for each row of ``docs``.

    Null and empty texts score 0 and are not toxic.  Rows are judged one by one,
    so repeated rows repeat, a null id stays null, an empty table gives none, and
    other columns are not looked at.
    """
    p = docs.select("doc_id", scorer(model)("text").alias("toxicity"))
    return p.select("doc_id", "toxicity", (F.col("toxicity") >= model.threshold).alias("toxic"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that aren't toxic, with all their columns, whatever their names."""
    (p,) = _store.fresh(docs.columns, "toxicity")
    return docs.withColumn(p, scorer(model)("text")).where(F.col(p) < model.threshold).drop(p)

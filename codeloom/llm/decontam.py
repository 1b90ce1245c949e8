"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

One scan of the corpus keeps, of each text, only the passages around n-grams
that a benchmark item may hold; how wide, follows from the length of the items
that hold the n-gram.  The n-grams found are counted over the whole corpus, an
item's rare ones join passages to it, and a local alignment of words scores each
pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import _store, _text

GRAM = 4
#: An n-gram of an item is a seed if the corpus holds it at most so many times, or in at most this share
#: of its words, or at most `TIMES` as often as the item's rarest one (an item that has leaked
#: to many texts has no n-gram that occurs once).
SEED, RARE, TIMES = 16, 1e-10, 4
#: An item is found at this score, or at a lower one that chance doesn't reach: at
#: `LEAST_WORDS` matching words net of edits and `LONG_SCORE`.
LEAST_SCORE, LONG_SCORE = 0.5, 0.3
LEAST_WORDS = 8
MATCH, MISMATCH, GAP = 1, -1, -1
#: Bits of a bitmap that is sent to every task, at most (32 MiB).
_MOST_BITS = 28
#: Bytes of benchmark items that are sent to every task, at most.
_MOST_BYTES = 64 << 20
_SALT = np.uint64(0x9E6C63D0876A9A47)


def _maybe(bitmap: np.ndarray, bits: int, values: np.ndarray) -> np.ndarray:
    """Places of the values that may be in the bitmap (no false negatives)."""
    at = np.arange(len(values))
    for shift in (0, 32):
        v = (values[at] >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
        at = at[(bitmap[(v >> np.uint64(3)).astype(np.int64)] >> (v & np.uint64(7)).astype(np.uint8)) & 1 > 0]
    return at


def items(benchmark: DataFrame) -> DataFrame:
    """(item_id, words binary, n, cls) of the items with at least `GRAM` words; equal rows count once.

    cls: the item has at most 2^cls words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, off = _text.words(b.column(1).to_pylist())
            n = np.diff(off)
            at = np.flatnonzero(n >= GRAM)
            own = [h[off[k] : off[k + 1]].tobytes() for k in at]
            cls = np.array([int(x - 1).bit_length() for x in n[at]], np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(own, pa.binary()), pa.array(n[at]), pa.array(cls)], names=["item_id", "words", "n", "cls"])

    own = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    return own.mapInArrow(run, "item_id long, words binary, n long, cls int")


def _of_class(grams: np.ndarray, cls: int) -> np.ndarray:
    """The n-grams' hashes, as items of the class hold them."""
    return _text.mix(grams + np.uint64(int(_SALT) * (cls + 1) & (1 << 64) - 1))


def seeds(table: DataFrame) -> DataFrame:
    """(item_id, cls, gram, own) of each distinct n-gram of each item; own: its hash in the class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, w, c in zip(*(b.column(k).to_pylist() for k in range(3))):
                h = np.frombuffer(w, np.uint64)
                g = np.unique(_text.shingles(h, np.array([0, len(h)]), GRAM)[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(g), i)), pa.array(np.full(len(g), c, np.int32)), pa.array(g.view(np.int64)), pa.array(_of_class(g, c).view(np.int64))], names=["item_id", "cls", "gram", "own"]
                )

    return table.select("item_id", "words", "cls").mapInArrow(run, "item_id long, cls int, gram long, own long")


def _filters(grams: DataFrame) -> tuple[np.ndarray, np.ndarray, int, list[int]]:
    """Bitmaps of the items' n-grams and of their hashes by class, the bits of each, and the classes.

    Up to a density of 1/32 the bitmaps grow with the benchmark; beyond `_MOST_BITS`
    they let more through, which the joins then sort out.  They are put together
    by all tasks, a word of 64 bits at a time.
    """
    r = grams.agg(F.count("*").alias("n"), F.collect_set("cls").alias("c")).first()
    bits = min(_MOST_BITS, max(16, int(np.ceil(np.log2(32 * max(r.n, 1))))))
    maps = []
    for column in ("gram", "own"):
        places = F.explode(F.array(*(F.shiftrightunsigned(column, k).bitwiseAND(F.lit((1 << bits) - 1)) for k in (0, 32))))
        words = grams.select(places.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("v")).toArrow()
        full = np.zeros((1 << bits) // 64, np.int64)
        full[words.column("w").to_numpy()] = words.column("v").to_numpy()
        maps.append(full.view(np.uint8))
    return maps[0], maps[1], bits, sorted(r.c)


def passages(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """One scan over whole texts.

    Rows with kind 0: (doc_id, k1, k2, cls, p: passage number, words, gs: n-grams
    that items of the class may hold).  A passage reaches as far from its n-grams
    as twice the longest item of its class.  Rows with kind 2: (n: all words).
    """
    by_gram, by_class, bits, classes = _filters(grams)
    sent = docs.sparkSession.sparkContext.broadcast((by_gram, by_class))
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
    names = ["kind", "doc_id", "k1", "k2", "cls", "p", "n", "words", "gs"]
    schema = "kind int, doc_id long, k1 long, k2 int, cls int, p long, n long, words binary, gs array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gmap, cmap = sent.value
        total = 0
        for b in batches:
            texts = b.column(3).to_pylist()
            ids, k1, k2 = (b.column(k).to_pylist() for k in range(3))
            for i, j in _text.groups(texts):
                h, off = _text.words(texts[i:j])
                total += len(h)
                g, at = _text.shingles(h, off, GRAM)
                hit = _maybe(gmap, bits, g)
                g, at = g[hit], at[hit]
                out: list[list] = [[] for _ in names]
                for c in classes if len(g) else ():
                    own = _maybe(cmap, bits, _of_class(g, c))
                    if not len(own):
                        continue
                    reach, v, place = 2 << c, g[own].view(np.int64), at[own]
                    doc = np.searchsorted(off, place, "right") - 1
                    cut = np.flatnonzero(np.append(True, (np.diff(place) > 2 * reach) | (np.diff(doc) != 0)))
                    for lo, hi in zip(cut.tolist(), np.append(cut[1:], len(place)).tolist()):
                        d = doc[lo]
                        first, last = max(off[d], place[lo] - reach), min(off[d + 1], place[hi - 1] + reach + GRAM)
                        row = (0, ids[i + d], k1[i + d], k2[i + d], c, int(first - off[d]), None, h[first:last].tobytes(), np.unique(v[lo:hi]) if hi - lo > 1 else v[lo:hi])
                        for o, x in zip(out, row):
                            o.append(x)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, kinds)], names=names)
        yield pa.RecordBatch.from_arrays([pa.array([2 if n == "kind" else total if n == "n" else None], t) for n, t in zip(names, kinds)], names=names)

    own = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), *_store.row_key(), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, schema)


def align(a: np.ndarray, b: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score of the words ``a`` with each of ``b`` (Smith-Waterman, linear gaps)."""
    width = max(len(x) for x in b)
    m = np.zeros((len(b), width), np.uint64)
    inside = np.zeros((len(b), width), bool)
    for k, x in enumerate(b):
        m[k, : len(x)] = x
        inside[k, : len(x)] = True
    ramp = (np.arange(width) * -GAP).astype(np.int32)
    row, best = np.zeros((len(b), width), np.int32), np.zeros(len(b), np.int32)
    for w in a:
        hit = np.where((m == w) & inside, MATCH, MISMATCH).astype(np.int32)
        now = hit.copy()
        now[:, 1:] += row[:, :-1]
        np.maximum(now, row + GAP, out=now)
        np.maximum(now, 0, out=now)
        now = np.maximum.accumulate(now + ramp, axis=1) - ramp
        row = now
        np.maximum(best, now.max(1), out=best)
    return best


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        item, passage = b.column(4).to_pylist(), b.column(5).to_pylist()
        by: dict[bytes, list[int]] = {}
        for k, x in enumerate(item):
            by.setdefault(x, []).append(k)
        got = np.zeros(len(item))
        for x, rows in by.items():
            a = np.frombuffer(x, np.uint64)
            rows.sort(key=lambda k: len(passage[k]))
            at = 0
            while at < len(rows):
                to = at + 1
                while to < len(rows) and (to - at + 1) * len(passage[rows[to]]) < 1 << 21:
                    to += 1
                own = rows[at:to]
                got[own] = align(a, [np.frombuffer(passage[k], np.uint64) for k in own]) / (MATCH * len(a))
                at = to
        yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.array(got), b.column(6)], names=["doc_id", "k1", "k2", "item_id", "score", "enough"])


def matches(docs: DataFrame, benchmark: DataFrame, rare: float = RARE, least_score: float = LEAST_SCORE) -> DataFrame:
    """(doc_id, k1, k2, item_id, score) of each row of ``docs`` and item aligned well enough."""
    table = _store.materialize(items(benchmark), "benchmark-items")
    grams = _store.materialize(seeds(table), "benchmark-grams")
    scan = _store.materialize(passages(docs, grams), "benchmark-passages")
    found = scan.where("kind = 0")
    key = ["k1", "k2", "cls", "p"]
    hits = found.select("doc_id", *key, F.explode("gs").alias("gram"))
    # how many passages of the whole corpus hold each n-gram; every task adds up its own first
    counts = hits.groupBy("cls", "gram").agg(F.count("*").alias("c"))
    total = scan.where("kind = 2").agg(F.sum("n").alias("total"))
    near = grams.join(counts, ["cls", "gram"]).select("item_id", "cls", "gram", "c")
    least = near.groupBy("item_id").agg(F.min("c").alias("least"))
    bound = F.greatest(F.lit(SEED), F.col("total") * rare, F.col("least") * TIMES)
    chosen = near.join(least, "item_id").crossJoin(F.broadcast(total)).where(F.col("c") <= bound).select("item_id", "cls", "gram")
    chosen = _store.materialize(chosen, "benchmark-seeds")
    pairs = hits.join(chosen, ["cls", "gram"]).select("doc_id", *key, "item_id").distinct()
    text = found.select(*key, F.col("words").alias("passage")).dropDuplicates(key)
    size = table.agg(F.count("*").alias("rows"), F.sum("n").alias("n")).first()
    own = table.select("item_id", F.col("words").alias("item"), "n")
    if 64 * size.rows + 8 * (size.n or 0) <= _MOST_BYTES:
        own = F.broadcast(own)  # else a join by shuffle, which adaptive execution splits where an item is hot
    both = pairs.join(text, key).join(own, "item_id")
    enough = F.least(F.lit(least_score), F.greatest(F.lit(LEAST_WORDS) / F.col("n"), F.lit(LONG_SCORE)))
    scored = both.select("doc_id", "k1", "k2", "item_id", "item", "passage", enough.alias("enough")).mapInArrow(_score, "doc_id long, k1 long, k2 int, item_id long, score double, enough double")
    return scored.where(F.col("score") >= F.col("enough")).groupBy("doc_id", "k1", "k2", "item_id").agg(F.max("score").alias("score"))


def leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, score) of each document that holds at least a part of a benchmark item.

    The score is the best local alignment of words over the item's number of
    words, so 1 is a whole copy.  A score of ``least_score`` is enough, and for
    items of over 16 words one of `LONG_SCORE` that stands for `LEAST_WORDS`
    words, so that edited copies are found.  Every item and document with a rare n-gram of
    `GRAM` words in common is aligned: one that at most `SEED` passages of the
    corpus hold, or a share of ``rare`` of its words, or at most `TIMES` as many as hold
    the item's rarest, so that no item is without.  Items or texts of fewer than `GRAM` words, null and empty texts
    and null item ids match nothing.  A null doc_id stays null, repeated rows
    give one result, an empty table on either side gives none; only doc_id,
    item_id and text are looked at.
    """
    m = matches(docs, benchmark, **options)
    return m.groupBy("doc_id", "item_id").agg(F.round(F.max("score"), 6).alias("score"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item, with all their columns."""
    a, b, x, y = _store.fresh(docs.columns, "k1", "k2", "b1", "b2")
    bad = matches(docs, benchmark, **options).select(F.col("k1").alias(x), F.col("k2").alias(y)).distinct()
    k1, k2 = _store.row_key()
    keyed = docs.withColumns({a: k1, b: k2})
    return keyed.join(bad, (F.col(a) == F.col(x)) & (F.col(b) == F.col(y)), "left_anti").drop(a, b)

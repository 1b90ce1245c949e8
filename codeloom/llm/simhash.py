"""SimHash near-duplicates, found by random bit sampling.

Each text's word pairs vote for a 128-bit signature.  Several tables permute the
bits; rows that agree on a prefix of the permuted bits share a bucket, and a
bucket over the size limit is divided by additional bits until its parts are
within the limit.  The number of tables follows from the length of the prefix, and
a bucket that takes additional bits is divided again by other bits, so that the
chance to find a pair doesn't fall as the table grows.  Every pair within a part
is verified by Hamming distance, and the connected components of the verified
pairs are the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm import _store, _text

BITS = 128
SHINGLE = 2
DISTANCE = 28
#: Tables at least; more where the prefix is long, see `tables_for`.
TABLES = 24
BUCKET = 1024
#: Least chance to find a pair `DISTANCE` bits apart, in all tables; in a bucket that both its rows are in.
RECALL, WITHIN = 0.9, 0.95
#: A bucket of which no number of divisions can be expected to reach `WITHIN` (near
#: copies by the thousand) has `TABLES` of them and then as many as connect something
#: new, until so many on end didn't.
IDLE = 8
_SALT = np.uint64(0xD1B54A32D192ED03)
#: Rows that one call of the bucket kernel looks at together, at least.
_ROWS = 1 << 17


def signatures_of(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(signatures as n x 2 uint64, whether the text has any word).

    A text of a single word votes with that word alone.
    """
    out, has = np.zeros((len(texts), 2), np.uint64), np.zeros(len(texts), bool)
    for i, j in _text.groups(texts):
        h, off = _text.words(texts[i:j])
        g, at = _text.shingles(h, off, SHINGLE)
        doc = np.searchsorted(off, at, "right") - 1
        lone = np.flatnonzero(np.diff(off) == 1)
        if len(lone):
            g, doc = np.append(g, _text.mix(h[off[lone]])), np.append(doc, lone)
            order = np.argsort(doc, kind="stable")
            g, doc = g[order], doc[order]
        for a in range(0, j - i, 4096):
            lo, hi = np.searchsorted(doc, (a, a + 4096))
            _vote(g[lo:hi], doc[lo:hi] + i, out, has)
    return out, has


def _vote(g: np.ndarray, doc: np.ndarray, out: np.ndarray, has: np.ndarray) -> None:
    """Adds up bit votes, eight counters to a machine word, in runs of at most 255 features."""
    if not len(g):
        return
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    rank = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
    cut = np.flatnonzero(rank % 255 == 0)
    sums = np.zeros((len(cut), BITS), np.uint8)
    step = 1 << 16
    at = 0
    while at < len(cut):
        to = max(at + 1, int(np.searchsorted(cut, cut[at] + step)))
        lo, hi = cut[at], cut[to] if to < len(cut) else len(g)
        part = np.stack([g[lo:hi], _text.mix(g[lo:hi] ^ _SALT)], 1)
        bits = np.unpackbits(part.view(np.uint8), axis=1).view(np.uint64)
        sums[at:to] = np.add.reduceat(bits, cut[at:to] - lo, axis=0).view(np.uint8)
        at = to
    own = np.searchsorted(cut, first)
    votes = np.add.reduceat(sums.astype(np.int32), own, axis=0)
    n = np.diff(np.append(first, len(g)))
    out[doc[first]] = np.packbits(2 * votes > n[:, None], axis=1).view(np.uint64)
    has[doc[first]] = True


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, s0, s1) for each row whose text has a word; k1, k2: the row's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, has = signatures_of(b.column(3).to_pylist())
            at = pa.array(np.flatnonzero(has))
            s = s.view(np.int64)[has]
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in range(3)), pa.array(s[:, 0]), pa.array(s[:, 1])], names=["doc_id", "k1", "k2", "s0", "s1"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_store.row_key("doc_id", "text"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, k1 long, k2 int, s0 long, s1 long")


def permutations(tables: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.stack([rng.permutation(BITS) for _ in range(tables)])


def permute(s: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Signatures (n x 2 uint64) with their bits in another order, as n x 2 big-endian words."""
    bits = np.unpackbits(np.ascontiguousarray(s).view(np.uint8), axis=1)[:, order]
    return np.ascontiguousarray(np.packbits(bits, axis=1)).view(">u8").astype(np.uint64)


def agreement(distance: int, after: int = 0) -> np.ndarray:
    """For k = 0, 1, ...: the chance that two signatures ``distance`` apart, which agree on
    ``after`` bits of a random order, agree on the next k as well."""
    left = BITS - after - np.arange(BITS - after)
    return np.append(1.0, np.cumprod(np.maximum(left - distance, 0) / left))


def tables_for(least: int, distance: int = DISTANCE) -> int:
    """Tables that find a pair ``distance`` apart by a prefix of ``least`` bits with a chance of `RECALL`."""
    each = WITHIN * agreement(distance)[least]
    if not each:
        raise ValueError(f"no two signatures {distance} bits apart agree on {least} bits")
    return max(TABLES, int(np.ceil(np.log(1 - RECALL) / np.log(1 - each))))


def _leading(x: np.ndarray) -> np.ndarray:
    """Leading zero bits of uint64."""
    x = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        x |= x >> np.uint64(k)
    return 64 - np.bitwise_count(x).astype(np.int64)


def bucket_ends(p: np.ndarray, least: int, most: int) -> np.ndarray:
    """For each of the rows, sorted by their permuted bits ``p``, where its bucket ends.

    Buckets are runs that agree on ``least`` bits; a run of over ``most`` rows
    is divided by the next bits until each part is within ``most`` (rows are
    distinct, so this ends).
    """
    return _divide(p, least, most)[0]


def _divide(p: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row, where its bucket ends (see `bucket_ends`) and on how many bits the bucket agrees."""
    n = len(p)
    same = np.zeros(n, np.int64)
    d = p[1:] ^ p[:-1]
    same[1:] = np.where(d[:, 0] != 0, _leading(d[:, 0]), 64 + _leading(d[:, 1]))
    start = same < least
    start[0] = True
    bits = least
    depth = np.full(n, least)
    while True:
        first = np.flatnonzero(start)
        size = np.diff(np.append(first, n))
        if size.max() <= most or bits >= BITS:
            return np.repeat(first + size, size), depth
        bits += 1
        over = np.repeat(size > most, size)
        depth[over] = bits
        start |= over & (same < bits)


def near(p: np.ndarray, end: np.ndarray, distance: int, step: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs of rows that share a bucket; about ``step`` pairs are looked at together."""
    count = end - np.arange(len(p)) - 1
    total = np.append(0, np.cumsum(count))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at = 0
    while at < len(p):
        to = max(at + 1, int(np.searchsorted(total, total[at] + step, "right")) - 1)
        c = count[at:to]
        x = np.repeat(np.arange(at, to), c)
        y = x + 1 + np.arange(len(x)) - np.repeat(total[at:to] - total[at], c)
        ok = np.bitwise_count(p[x, 0] ^ p[y, 0]) + np.bitwise_count(p[x, 1] ^ p[y, 1]) <= distance
        a.append(x[ok])
        b.append(y[ok])
        at = to
    return np.concatenate(a), np.concatenate(b)


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest row of its component over the pairs (i, j)."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(root, hi, lo)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        keep = root[i] != root[j]
        i, j = i[keep], j[keep]
    return root


def connect(p: np.ndarray, least: int, most: int, distance: int) -> np.ndarray:
    """For each row of one bucket, sorted by permuted bits, the smallest row that verified pairs connect it with.

    A bucket over ``most`` rows is divided again and again, each time by the bits
    after ``least`` in another order, until a pair ``distance`` apart shared a part
    with a chance of `WITHIN`, whichever row it belongs to.
    """
    end, depth = _divide(p, least, most)
    root = _forest(len(p), *near(p, end, distance))
    if len(p) <= most:
        return root
    chance = agreement(distance, least)
    missed = 1 - chance[depth - least]
    rng = np.random.default_rng(len(p))
    own, done, idle = np.arange(len(p)), 1, 0
    while missed.max() > 1 - WITHIN and (done < TABLES or idle < IDLE):
        q = _reorder(p, np.append(np.arange(least), least + rng.permutation(BITS - least)))
        at = np.lexsort((q[:, 1], q[:, 0]))
        q = q[at]
        end, depth = _divide(q, least, most)
        i, j = near(q, end, distance)
        i, j = at[i], at[j]
        new = root[i] != root[j]
        if new.any():
            root = _forest(len(p), np.append(own, i[new]), np.append(root, j[new]))
        missed[at] *= 1 - chance[depth - least]
        done, idle = done + 1, 0 if new.any() else idle + 1
    return root


def _reorder(p: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Permuted bits (n x 2 words) in yet another order."""
    parts = [np.packbits(np.unpackbits(np.ascontiguousarray(p[k : k + (1 << 16)].astype(">u8")).view(np.uint8), axis=1)[:, order], axis=1) for k in range(0, len(p), 1 << 16)]
    return np.ascontiguousarray(np.concatenate(parts)).view(">u8").astype(np.uint64)


def edges(sigs: DataFrame, distance: int = DISTANCE, tables: int | None = None, bucket: int = BUCKET, seed: int = 11) -> DataFrame:
    """(u, v) of signature hashes: a forest that spans what each bucket's verified pairs connect.

    tables: as many as the recall takes (`tables_for`) if not given.
    """
    spark = sigs.sparkSession
    distinct = _store.materialize(sigs.select("s0", "s1").distinct(), "simhash-distinct")
    n = distinct.count()
    least = max(0, int(np.ceil(np.log2(max(n, 1) / bucket))))
    tables = tables or tables_for(least, distance)
    order = permutations(tables, seed)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            s = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1).view(np.uint64)
            for t in range(tables):
                p = permute(s, order[t])
                key = (p[:, 0] >> np.uint64(64 - least)).astype(np.int64) if least else np.zeros(len(s), np.int64)
                # the sign bit is flipped: signed order is then the order of the bits
                q = (p ^ np.uint64(1 << 63)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key * tables + t), pa.array(q[:, 0]), pa.array(q[:, 1])], names=["b", "p0", "p1"])

    back = np.argsort(order, axis=1)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(x: np.ndarray) -> pa.RecordBatch:
            found_u, found_v = [], []
            p = x[:, 1:].view(np.uint64) ^ np.uint64(1 << 63)
            table = x[:, 0] % tables
            for lo, hi in _runs(x[:, 0]):
                if hi - lo < 2:
                    continue
                root = connect(p[lo:hi], least, bucket, distance)  # distances don't depend on the order of bits
                at = np.flatnonzero(root != np.arange(hi - lo))
                if not len(at):
                    continue
                s = _restore(p[lo:hi], back[table[lo]])
                found_u.append(s[at])
                found_v.append(s[root[at]])
            u = np.concatenate(found_u) if found_u else np.zeros((0, 2), np.int64)
            v = np.concatenate(found_v) if found_v else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (u[:, 0], u[:, 1], v[:, 0], v[:, 1])], names=["u0", "u1", "v0", "v1"])

        parts: list[np.ndarray] = []
        rows = 0
        for b in batches:
            parts.append(np.stack([c.to_numpy() for c in b.columns], 1))
            rows += b.num_rows
            if rows >= _ROWS:
                x = np.concatenate(parts)
                cut = int(np.searchsorted(x[:, 0], x[-1, 0]))  # the last bucket may go on
                if cut:
                    yield work(x[:cut])
                parts, rows = [x[cut:]], len(x) - cut
        if rows:
            yield work(np.concatenate(parts))

    spread_ = distinct.mapInArrow(spread, "b long, p0 long, p1 long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = spread_.repartition(parts, "b").sortWithinPartitions("b", "p0", "p1")
    found = placed.mapInArrow(join, "u0 long, u1 long, v0 long, v1 long")
    return found.select(F.xxhash64("u0", "u1").alias("u"), F.xxhash64("v0", "v1").alias("v"))


def _runs(b: np.ndarray) -> Iterator[tuple[int, int]]:
    cut = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
    return zip(cut.tolist(), np.append(cut[1:], len(b)).tolist())


def _restore(p: np.ndarray, back: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(np.ascontiguousarray(p.astype(">u8")).view(np.uint8), axis=1)[:, back]
    return np.ascontiguousarray(np.packbits(bits, axis=1)).view(np.int64)


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) of the connected components of (u, v), by alternating large and small stars.

    Each round is written to the shared folder, so lineage stays short; the
    number of rounds grows with the logarithm of the longest path.
    """
    least, most = F.least("u", "v"), F.greatest("u", "v")
    now = _store.materialize(pairs.where("u <> v").select(most.alias("u"), least.alias("v")).distinct(), "stars")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        mid = _store.materialize(large.unionByName(low.where("u <> m").select("u", F.col("m").alias("v"))).distinct(), "stars")
        low = mid.groupBy("u").agg(F.min("v").alias("m"))
        small = mid.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = _store.materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        r = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        _store.discard(now)
        _store.discard(mid)
        now = new
        if (r.n, r.s) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = (r.n, r.s)


def members(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, k1, k2, g, n, r1, r2) of each row in a group of at least two rows.

    g identifies the group, n is its size and (r1, r2) the key of the row that
    stays: the one with the smallest id (null ids last), then the smallest key.
    """
    sigs = _store.materialize(signatures(docs), "simhash-signatures")
    roots = components(edges(sigs, **options))
    own = sigs.select("doc_id", "k1", "k2", F.xxhash64("s0", "s1").alias("node")).join(roots, "node", "left")
    own = _store.materialize(own.select("doc_id", "k1", "k2", F.coalesce("root", "node").alias("g")), "simhash-groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "k1", "k2")).alias("f")
    size = own.groupBy("g").agg(F.count("*").alias("n"), first).where("n > 1")
    return own.join(size, "g").select("doc_id", "k1", "k2", "g", "n", F.col("f.doc_id").alias("keep_id"), F.col("f.k1").alias("r1"), F.col("f.k2").alias("r2"))


def groups(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, keep_id, n_docs) for each row in a group of near copies of at least two rows.

    Rows outside any group don't appear.  Null texts and texts without a word
    belong to no group; a null id counts after all others when the row that
    stays is chosen; repeated rows are copies of each other; an empty table
    gives none, and columns other than doc_id and text aren't looked at.
    Signatures at most `DISTANCE` of 128 bits apart are near; the search is
    approximate for pairs (a pair `DISTANCE` apart is found with a chance of
    `RECALL`, whatever the size of the table) and exact for equal signatures.
    """
    m = members(docs, **options)
    return m.select("doc_id", "keep_id", F.col("n").alias("n_docs"))


def dedup(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group of near copies, and all rows outside groups.

    Of rows that repeat the same id and text one stays, chosen by the other
    columns.  Rows without a word in their text all stay.
    """
    a, b, rank, x, y = _store.fresh(docs.columns, "k1", "k2", "rank", "g1", "g2")
    gone = members(docs, **options).where("k1 <> r1 or k2 <> r2").select(F.col("k1").alias(x), F.col("k2").alias(y)).distinct()
    k1, k2 = _store.row_key("doc_id", "text")
    rest = F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))
    keyed = docs.withColumns({a: k1, b: k2})
    ranked = keyed.withColumn(rank, F.row_number().over(Window.partitionBy(a, b).orderBy(rest)))
    ranked = ranked.where((F.col(rank) == 1) | ~F.coalesce(F.col("text").rlike(r"[\p{L}\p{N}]"), F.lit(False)))
    return ranked.join(gone, (F.col(a) == F.col(x)) & (F.col(b) == F.col(y)), "left_anti").drop(a, b, rank)

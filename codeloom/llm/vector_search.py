"""Exact nearest neighbours by a vector-approximation file.

Each dimension is cut into 256 cells; a vector's cell numbers are its
approximation (Weber et al., 1998).  A scan of the approximations bounds each
distance from below and above by the cells of its own dimensions.  Exact vectors
are then read in the order of their lower bounds, until no open lower bound is
within the kth exact distance.

Queries are worked off in passes of bounded size: a pass is sent to all tasks,
and one scan of the cell numbers serves all its queries.  What flows between
tasks are ids and bounds, never vectors of candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.llm import _store

K = 10
CELLS = 256
BLOCK = 2048
#: Bytes of query vectors that one pass sends to every task.
PASS_BYTES = 32 << 20
#: Rows of (query, candidate) that a round of exact reads sends to every task, at most.
ROUND_ROWS = 1 << 21
#: Queries that meet a block of cells together.
_TOGETHER = 512
#: Blocks that the first bounds come from.
_FIRST = 16
_FOUND = "q long, x long, near double, far double"


def usable(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, v) with one row an id, and the dimension: the commonest length, the smaller one of a tie."""
    own = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("v"))
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    own = own.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & fine)
    r = own.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = r.d if r else 0
    own = own.where(F.size("v") == d)
    # only ids are counted; vectors move where an id repeats
    twice = own.groupBy("vec_id").count().where("count > 1").select("vec_id")
    once = own.join(twice, "vec_id", "left_anti")
    return once.unionByName(own.join(twice, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("v").alias("v"))), d


def within_reach(vectors: DataFrame, k: int) -> DataFrame:
    """The vectors without those that k + 1 equal ones of smaller id stand before.

    Equal distances rank by id, so the others are no one's neighbours; without
    this a group of copies would be as many candidates for each of its queries.
    """
    keyed = vectors.withColumn("_h", F.xxhash64("v"))
    many = keyed.groupBy("_h").count().where(F.col("count") > k + 1).select("_h")
    first = Window.partitionBy("v").orderBy("vec_id")
    own = keyed.join(many, "_h", "left_semi").withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k + 1)
    return keyed.join(many, "_h", "left_anti").select("vec_id", "v").unionByName(own.select("vec_id", "v"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, d)


def limits(vectors: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest value of each dimension over all vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi = np.full(d, np.inf, np.float32), np.full(d, -np.inf, np.float32)
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column(0), d)
                lo, hi = np.minimum(lo, m.min(0)), np.maximum(hi, m.max(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(lo), pa.array(hi)], names=["k", "lo", "hi"])

    got = vectors.select("v").mapInArrow(run, "k long, lo float, hi float").groupBy("k").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("k").collect()
    return np.array([r.lo for r in got], np.float64), np.array([r.hi for r in got], np.float64)


def blocks(vectors: DataFrame, d: int, lo: np.ndarray, width: np.ndarray) -> DataFrame:
    """(ids, codes, vecs): `BLOCK` vectors a row, their cell numbers, and the exact values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ids: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
            codes = np.clip((m - lo) / np.where(width > 0, width, 1), 0, CELLS - 1).astype(np.uint8)
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (ids, codes, m)], names=["ids", "codes", "vecs"])

        ids, m = np.zeros(0, np.int64), np.zeros((0, d), np.float32)
        for b in batches:
            ids, m = np.append(ids, b.column(0).to_numpy()), np.vstack([m, _matrix(b.column(1), d)])
            while len(ids) >= BLOCK:
                yield out(ids[:BLOCK], m[:BLOCK])
                ids, m = ids[BLOCK:], m[BLOCK:]
        if len(ids):
            yield out(ids, m)

    return vectors.select("vec_id", "v").mapInArrow(run, "ids binary, codes binary, vecs binary")


class Cells:
    """Bounds of distances between queries and vectors of which the cell numbers are known.

    An edge of a cell is moved out by a little, so that rounding, here or when the
    cells were numbered, never puts a vector outside.
    """

    def __init__(self, lo: np.ndarray, width: np.ndarray):
        self.slack = 1e-6 * (np.abs(lo) + CELLS * width) + 1e-30
        self.lo, self.width, self.half = lo, width, 0.5 * width + self.slack
        self.diagonal = float(np.sqrt((self.half**2).sum()))

    def centres(self, codes: np.ndarray) -> np.ndarray:
        return self.lo + (codes + 0.5) * self.width

    def bounds(self, q: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) for each pair of rows: the cell of each dimension gives its part."""
        off = np.abs(q - self.centres(codes))
        return np.sqrt((np.maximum(0, off - self.half) ** 2).sum(1)) * (1 - 1e-12), np.sqrt(((off + self.half) ** 2).sum(1)) * (1 + 1e-12)


def scan(q_ids: np.ndarray, q: np.ndarray, reach: np.ndarray, k: int, cells: Cells, blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, ...]]:
    """(query number, id, lower, upper) of the vectors that may be among a query's k nearest, given that the kth is within ``reach``.

    Centre and half diagonal sort out most pairs by a product of matrices; those
    left are bounded by their own cells.  ``reach`` shrinks as vectors are met.
    """
    top = np.repeat(reach[:, None], k, axis=1)
    q64 = q.astype(np.float64)
    norm = (q64**2).sum(1)
    for ids, codes in blocks:
        centre = cells.centres(codes)
        size = (centre**2).sum(1)
        for a in range(0, len(q), _TOGETHER):
            b = min(a + _TOGETHER, len(q))
            square = norm[a:b, None] + size - 2 * (q64[a:b] @ centre.T)
            most = (top[a:b, -1:] + cells.diagonal) ** 2
            row, col = np.nonzero((square <= most + 1e-9 * (norm[a:b, None] + size)) & (q_ids[a:b, None] != ids))
            for at in range(0, len(row), 1 << 16):
                r, c = row[at : at + (1 << 16)] + a, col[at : at + (1 << 16)]
                near, far = cells.bounds(q64[r], codes[c])
                ok = near <= top[r, -1]
                r, c, near, far = r[ok], c[ok], near[ok], far[ok]
                for one, lo, hi in _by(r):
                    top[one] = np.partition(np.append(top[one], far[lo:hi]), k - 1)[:k]
                    top[one].sort()
                ok = near <= top[r, -1]
                yield r[ok], ids[c[ok]], near[ok], far[ok]


def _by(r: np.ndarray) -> Iterator[tuple[int, int, int]]:
    cut = np.flatnonzero(np.append(True, r[1:] != r[:-1])) if len(r) else np.zeros(0, int)
    return zip(r[cut].tolist(), cut.tolist(), np.append(cut[1:], len(r)).tolist())


def _read_blocks(batches: Iterator[pa.RecordBatch], kind, d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        for i in range(b.num_rows):
            yield np.frombuffer(b.column(0)[i].as_py(), np.int64), np.frombuffer(b.column(1)[i].as_py(), kind).reshape(-1, d)


def _candidates(packed: DataFrame, q_ids: np.ndarray, q: np.ndarray, reach: np.ndarray, k: int, cells: Cells) -> DataFrame:
    """(q, x, near, far) over all blocks; the queries are sent to every task."""
    sent = packed.sparkSession.sparkContext.broadcast((q_ids, q, reach))
    d = q.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, own, far = sent.value
        for r, x, near, upper in scan(ids, own, far, k, cells, _read_blocks(batches, np.uint8, d)):
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in (ids[r], x, near, upper)], names=["q", "x", "near", "far"])

    return packed.select("ids", "codes").mapInArrow(run, _FOUND)


def _exact(packed: DataFrame, q_ids: np.ndarray, q: np.ndarray, row: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, distance) of the wanted pairs, computed where the vectors are."""
    order = np.argsort(x, kind="stable")
    used, at = np.unique(row, return_inverse=True)
    sent = packed.sparkSession.sparkContext.broadcast((x[order], at[order].astype(np.int32), q[used]))
    d = q.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, who, queries = sent.value
        for ids, vecs in _read_blocks(batches, np.float32, d):
            lo, hi = np.searchsorted(wanted, ids, "left"), np.searchsorted(wanted, ids, "right")
            n = hi - lo
            col = np.repeat(np.arange(len(ids)), n)
            if not len(col):
                continue
            pair = np.arange(len(col)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            dist = np.concatenate([np.sqrt(((vecs[col[a : a + 65536]].astype(np.float64) - queries[who[pair[a : a + 65536]]]) ** 2).sum(1)) for a in range(0, len(col), 65536)])
            yield pa.RecordBatch.from_arrays([pa.array(who[pair].astype(np.int64)), pa.array(ids[col]), pa.array(dist)], names=["r", "x", "dist"])

    got = packed.select("ids", "vecs").mapInArrow(run, "r long, x long, dist double").toArrow()
    sent.destroy()
    return used[got.column(0).to_numpy()], got.column(1).to_numpy(), got.column(2).to_numpy()


def _nearest(packed: DataFrame, q_ids: np.ndarray, q: np.ndarray, k: int, cells: Cells) -> tuple[np.ndarray, ...]:
    """(query number, rank, id, distance) of one pass."""
    n = len(q_ids)
    # any k vectors bound the kth distance: the first blocks give a reach that spares most candidates
    reach = np.full(n, np.inf)
    few = packed.select("ids", "codes").limit(_FIRST).toArrow()
    top = np.full((n, k), np.inf)
    for ids, codes in _read_blocks(few.to_batches(), np.uint8, q.shape[1]):
        for a in range(0, n, 64):
            b = min(a + 64, n)
            centre = cells.centres(codes)
            far = np.sqrt(np.maximum(0, (q[a:b].astype(np.float64) ** 2).sum(1)[:, None] + (centre**2).sum(1) - 2 * (q[a:b].astype(np.float64) @ centre.T))) * (1 + 1e-9) + cells.diagonal + 1e-9
            far[q_ids[a:b, None] == ids] = np.inf
            top[a:b] = np.sort(np.partition(np.hstack([top[a:b], far]), k - 1, axis=1)[:, :k], axis=1)
    reach = np.minimum(reach, top[:, -1])
    found = _store.materialize(_candidates(packed, q_ids, q, reach, k, cells), "va-candidates")
    # the kth smallest upper bound over all tasks; what lies beyond it is no candidate
    upper = found.select("q", "far").withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("far"))).where(F.col("n") <= k)
    upper = upper.groupBy("q").agg(F.max("far").alias("far"), F.count("*").alias("n")).toArrow()
    kth = np.full(n, np.inf)
    by_id = np.argsort(q_ids)
    place = by_id[np.searchsorted(q_ids, upper.column("q").to_numpy(), sorter=by_id)]
    full = upper.column("n").to_numpy() == k
    kth[place[full]] = upper.column("far").to_numpy()[full]
    best_d, best_x = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)
    spark = packed.sparkSession
    bound = spark.createDataFrame(pa.table({"q": q_ids, "kth": kth}))
    # a read of a range of lower bounds: (q, i, x, near), i counts a query's candidates in their order
    ranked = found.join(bound, "q").where("near <= kth").select("q", "x", "near", (F.row_number().over(Window.partitionBy("q").orderBy("near", "x")) - 1).alias("i"))
    ranked = _store.materialize(ranked, "va-ranked")
    _store.discard(found)
    at, step, open_ = 0, 2 * k, np.arange(n)
    while len(open_):
        step = max(1, min(step, ROUND_ROWS // len(open_)))
        limit = spark.createDataFrame(pa.table({"q": q_ids[open_], "now": kth[open_]}))
        got = ranked.where((F.col("i") >= at) & (F.col("i") < at + step)).join(limit, "q").where("near <= now").select("q", "x").toArrow()
        if not got.num_rows:
            break  # no open query has a vector left that can be nearer
        row = by_id[np.searchsorted(q_ids, got.column(0).to_numpy(), sorter=by_id)]
        row, x, dist = _exact(packed, q_ids, q, row, got.column(1).to_numpy())
        order = np.argsort(row, kind="stable")
        row, x, dist = row[order], x[order], dist[order]
        for one, lo, hi in _by(row):
            both_d, both_x = np.append(best_d[one], dist[lo:hi]), np.append(best_x[one], x[lo:hi])
            first = np.lexsort((both_x, both_d))[:k]
            best_d[one], best_x[one] = both_d[first], both_x[first]
        kth = np.minimum(kth, best_d[:, -1])
        open_ = np.unique(row)  # a query that read nothing this round has nothing within its kth distance any more
        at, step = at + step, 2 * step
    _store.discard(ranked)
    row, rank = np.nonzero(np.isfinite(best_d))
    return row, rank + 1, best_x[row, rank], best_d[row, rank]


def neighbours(embeddings: DataFrame, k: int = K, queries: Column | None = None, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(vec_id, rank, neighbour_id, distance): the k nearest others of each query, by Euclidean distance.

    queries: a condition on vec_id that says which rows are queries; all rows
    are if it is not given.  Every row can be a neighbour.  Exact; equal distances rank by
    id.  Null ids, null or empty vectors, vectors with null, NaN or infinite
    values, or of another length than the commonest, are neither queries nor
    neighbours.  Of rows with one id the smallest vector counts.  With k others
    or fewer, all of them are listed; an empty table gives none.  Distances are
    rounded to 6 digits; other columns aren't looked at.  The work is queries
    times rows: for all rows it is quadratic by nature.
    """
    spark: SparkSession = embeddings.sparkSession
    out = "vec_id long, rank int, neighbour_id long, distance double"
    vectors, d = usable(embeddings)
    if not d:
        return spark.createDataFrame([], out)
    vectors = _store.materialize(vectors, "va-vectors")
    lo, hi = limits(vectors, d)
    cells = Cells(lo, (hi - lo) / CELLS)
    packed = _store.materialize(blocks(within_reach(vectors, k), d, lo, cells.width), "va-blocks")
    own = vectors if queries is None else vectors.where(F.coalesce(queries, F.lit(False)))
    per_pass = max(1, pass_bytes // (4 * d))
    # passes by hash: equal in size but for chance, and none is over twice the bound
    n = own.count()
    passes = -(-n // per_pass)
    own = own.withColumn("_p", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, passes))))
    done: list[DataFrame] = []
    for p in range(passes):
        got = own.where(F.col("_p") == p).select("vec_id", "v").toArrow().combine_chunks()
        if not got.num_rows:
            continue
        ids = got.column(0).to_numpy()
        row, rank, x, dist = _nearest(packed, ids, _matrix(got.column(1).combine_chunks(), d), k, cells)
        part = spark.createDataFrame(pa.table({"vec_id": ids[row], "rank": rank.astype(np.int32), "neighbour_id": x, "distance": dist}))
        done.append(_store.materialize(part.select("vec_id", "rank", "neighbour_id", F.round("distance", 6).alias("distance")), "va-result") if passes > 1 else part.withColumn("distance", F.round("distance", 6)))
    if not done:
        return spark.createDataFrame([], out)
    every = done[0]
    for x in done[1:]:
        every = every.unionByName(x)
    return every.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in out.split(", ")))

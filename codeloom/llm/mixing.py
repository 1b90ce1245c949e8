"""Mixing sources to target weights by a low-discrepancy schedule over blocks of equal token counts.

Each source's documents, shuffled by a hash, are cut into blocks of `TOKENS`
tokens.  Slot t of the schedule maps the van der Corput point of t, its bits in
reverse, through the cumulative weights to a source; a source's slots are
ranked, and its j-th slot plays block j, starting over when the source runs out.
The schedule ends when every source has played all of its blocks.

The first 2^m points of the sequence are all multiples of 2^-m, so the number of
a source's slots among them is known exactly, and a source's slots are listed
from its own span of weights: no slot is compared with any other source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm import _store
from codeloom.llm import token_count as tc
from codeloom.llm import token_output

TOKENS = 2048
POWER = 0.7
#: The schedule has at most about so many slots for each block: a source with a lower target gets the least share that plays it within that.
LONGEST = 16
#: Tokens of a source that one task puts into blocks together.
PART = 1 << 20
_BITS = 48
_CIRCLE = 1 << _BITS
_CHUNK = 1 << 16
#: Sources, or parts of them, that are sent to every task at most; beyond, tables are joined by shuffle.
_SMALL = 1 << 20
_CODED = "source string, doc_id long, k1 long, k2 int, uid long, n long, ids binary"


def coded(docs: DataFrame, path: str = tc.VOCABULARY, ids: bool = True) -> DataFrame:
    """(source, doc_id, k1, k2, uid, n, ids) of each row: its number of tokens, and the tokens as words of `word` if wanted."""
    kind = word(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = token_output._encoder(path)
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                got, size, to = [], 0, at
                while to < whole.num_rows and size < 1 << 20:
                    t = whole.column(5)[to].as_py()
                    got.append(encoder.ids(t or ""))
                    size += len(t or "")
                    to += 1
                n = pa.array([len(x) for x in got], pa.int64())
                kept = pa.array([x.astype(kind).tobytes() for x in got], pa.binary()) if ids else pa.nulls(len(got), pa.binary())
                yield pa.RecordBatch.from_arrays([*(whole.column(k).slice(at, to - at) for k in range(5)), n, kept], names=["source", "doc_id", "k1", "k2", "uid", "n", "ids"])
                at = to

    own = docs.select(
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("doc_id").cast("long").alias("doc_id"), *_store.row_key(),
        F.monotonically_increasing_id().alias("uid"), F.col("text").cast("string").alias("text"),
    )
    return own.mapInArrow(run, _CODED)


def word(path: str = tc.VOCABULARY) -> str:
    """The number type of a token id: 16 bits, little-endian, where the vocabulary allows it, else 32."""
    return "<u2" if tc.encoding(path).n_vocab <= 1 << 16 else "<u4"


def order_key(seed: int) -> Column:
    """A row's place in its source's shuffle, 0 to 2^48."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "k1", "k2"), 64 - _BITS)


def _few(table: DataFrame) -> DataFrame:
    """The table with a hint to send it to all tasks, if it is within `_SMALL` rows."""
    return F.broadcast(table) if table.limit(_SMALL + 1).count() <= _SMALL else table


def parted(rows: DataFrame, block: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(rows with tokens and their part and sub, (source, part, sub, first_block, blocks)).

    A source is divided into parts of about `PART` tokens by its rows' places in
    the shuffle; a part that is much larger all the same, by rows of equal id
    and text, is divided once more by the rows' numbers.
    """
    rows = rows.where("n > 0").withColumn("h", order_key(seed))
    totals = rows.groupBy("source").agg(F.sum("n").alias("total"))
    size = _few(_store.materialize(totals.select("source", F.ceil(F.col("total") / PART).cast("long").alias("parts")), "mix-sources"))
    split = rows.join(size, "source").withColumn("part", F.floor(F.col("h") / F.lit(_CIRCLE) * F.col("parts"))).drop("parts")
    large = split.groupBy("source", "part").agg(F.sum("n").alias("s"), F.count("*").alias("c")).where(F.col("s") > 4 * PART).where("c > 1")
    large = _few(_store.materialize(large.select("source", "part", F.ceil(F.col("s") / PART).cast("long").alias("subs")), "mix-large"))
    split = split.join(large, ["source", "part"], "left").withColumn("sub", F.coalesce(F.pmod(F.xxhash64("uid"), "subs"), F.lit(0))).drop("subs")
    sizes = split.groupBy("source", "part", "sub").agg(F.ceil(F.sum("n") / block).cast("long").alias("blocks"))
    before = F.sum("blocks").over(Window.partitionBy("source").orderBy("part", "sub")) - F.col("blocks")
    return split, _store.materialize(sizes.select("source", "part", "sub", before.alias("first_block"), "blocks"), "mix-parts")


def shares(parts: DataFrame, rows: DataFrame, weights: dict[str, float] | None, power: float) -> DataFrame:
    """(source, blocks, lo, hi): blocks of each source, and its span of [0, 2^48)."""
    size = parts.groupBy("source").agg(F.sum("blocks").cast("long").alias("blocks"))
    size = size.join(rows.groupBy("source").agg(F.sum("n").alias("total")), "source")
    if weights is None:
        size = size.withColumn("w", F.pow("total", F.lit(power)))
    else:
        given = [(k, float(v)) for k, v in weights.items() if 0 < float(v) < float("inf")]
        size = size.join(rows.sparkSession.createDataFrame(given, "source string, w double"), "source")
    whole = Window.partitionBy()
    own = size.withColumn("s", F.greatest(F.col("w") / F.sum("w").over(whole), F.col("blocks") / (LONGEST * F.sum("blocks").over(whole))))
    upto = F.sum("s").over(whole.orderBy("source").rowsBetween(Window.unboundedPreceding, 0))
    hi = F.round(upto / F.sum("s").over(whole) * _CIRCLE).cast("long")
    out = own.select("source", "blocks", hi.alias("hi"))
    return out.select("source", "blocks", F.coalesce(F.lag("hi").over(whole.orderBy("source")), F.lit(0)).alias("lo"), "hi")


def reversed_bits(x: Column) -> Column:
    """The lowest 48 bits in reverse order."""
    x = x.cast("long")
    for k, mask in ((1, 0x5555_5555_5555), (2, 0x3333_3333_3333), (4, 0x0F0F_0F0F_0F0F), (8, 0x00FF_00FF_00FF)):
        x = F.shiftleft(x.bitwiseAND(F.lit(mask)), k).bitwiseOR(F.shiftright(x, k).bitwiseAND(F.lit(mask)))
    low, mid, high = (F.shiftright(x, k).bitwiseAND(F.lit(0xFFFF)) for k in (0, 16, 32))
    return F.shiftleft(low, 32).bitwiseOR(F.shiftleft(mid, 16)).bitwiseOR(high)


def schedule(spans: DataFrame) -> DataFrame:
    """(slot, source, block) until each source has played all of its blocks once."""
    n = F.col("hi") - F.col("lo")
    m = F.ceil(F.log2((F.col("blocks") + 1) * F.lit(float(_CIRCLE)) / n))
    # 2^m points, m a column of one row's value: enough of them lie in each span
    all_ = spans.crossJoin(F.broadcast(spans.agg(F.least(F.lit(_BITS), F.max(m)).cast("int").alias("m"))))
    step = F.expr(f"shiftleft(1L, {_BITS} - m)")
    ends = all_.select("source", "blocks", "m", F.ceil(F.col("lo") / step).alias("j"), F.ceil(F.col("hi") / step).alias("to")).where("j < to")
    chunks = ends.select("source", "blocks", "m", "to", F.explode(F.sequence("j", F.col("to") - 1, F.lit(_CHUNK))).alias("j")).repartition("source", "j")
    drawn = chunks.select("source", "blocks", "m", F.explode(F.sequence("j", F.least(F.col("j") + _CHUNK, F.col("to")) - 1)).alias("j"))
    slot = F.expr(f"shiftright(rev, {_BITS} - m)")
    drawn = drawn.withColumn("rev", reversed_bits(F.col("j"))).select("source", "blocks", slot.alias("slot")).withColumn("chunk", F.floor(F.col("slot") / _CHUNK))
    counts = drawn.groupBy("source", "chunk").agg(F.count("*").alias("c"))
    before = counts.select("source", "chunk", (F.sum("c").over(Window.partitionBy("source").orderBy("chunk")) - F.col("c")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1
    ranked = drawn.withColumn("nth", nth).join(before.hint("merge"), ["source", "chunk"]).select("slot", "source", "blocks", (F.col("nth") + F.col("before")).alias("rank"))
    ranked = _store.materialize(ranked, "mix-slots")
    last = ranked.where("rank = blocks - 1").agg(F.max("slot").alias("last"))
    return ranked.join(F.broadcast(last), F.col("slot") <= F.col("last")).select("slot", "source", (F.col("rank") % F.col("blocks")).alias("block"))


def _placed(slots: DataFrame, parts: DataFrame) -> DataFrame:
    """(slot, source, part, sub, block, i): i is the block's number within its part."""
    each = parts.select("source", "part", "sub", F.posexplode(F.sequence(F.col("first_block"), F.col("first_block") + F.col("blocks") - 1)).alias("i", "block"))
    return slots.join(each.hint("merge"), ["source", "block"])  # exploded, and larger than the planner takes it for


def blocks(docs: DataFrame, weights: dict[str, float] | None = None, power: float = POWER, block: int = TOKENS, seed: int = 3) -> DataFrame:
    """(slot, source, block, n_tokens, doc_ids, tokens): what each slot of the schedule plays, joined from the documents.

    tokens: ``block`` token ids as words of `word`, of the documents doc_ids in
    this order; a document goes on from one block to the next.  A
    source is put into blocks in parts of about `PART` tokens, and only the last
    block of a part holds fewer.
    weights: target share of tokens by source; sources without one, and with one
    of 0 or less, are left out.  By default a source's weight is its number of
    tokens to ``power``, which lifts small sources.  A source of which all blocks would
    take over `LONGEST` times as many slots as there are blocks gets the least
    share that plays it within that, however small its weight.
    A null source is the source ''.  Null and empty texts hold no tokens and
    appear nowhere.  Repeated rows, and rows of equal or null id, are documents
    of their own.  An empty table gives an empty schedule; only doc_id, source
    and text are looked at.
    """
    rows = _store.materialize(coded(docs), "mix-coded")
    split, parts = parted(rows, block, seed)
    size = np.dtype(word()).itemsize
    slots = _placed(schedule(_store.materialize(shares(parts, rows, weights, power), "mix-shares")), parts)

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["slot", "source", "block", "n_tokens", "doc_ids", "tokens"]
        left = left.sort_by([("h", "ascending"), ("doc_id", "ascending"), ("k1", "ascending"), ("k2", "ascending"), ("uid", "ascending")])
        data = b"".join(left.column("ids").to_pylist())
        ends = np.cumsum(left.column("n").to_numpy())
        ids = left.column("doc_id").to_pylist()
        at = right.column("i").to_numpy() * block
        to = np.minimum(at + block, ends[-1] if len(ends) else 0)
        first, last = np.searchsorted(ends, at, "right"), np.searchsorted(ends, to, "left")
        out = [[ids[a : b + 1] for a, b in zip(first.tolist(), last.tolist())], [data[size * a : size * b] for a, b in zip(at.tolist(), to.tolist())]]
        return pa.Table.from_arrays([right.column(c) for c in names[:3]] + [pa.array((to - at).astype(np.int32)), pa.array(out[0], pa.list_(pa.int64())), pa.array(out[1], pa.binary())], names=names)

    key = ["source", "part", "sub"]
    both = split.groupBy(*key).cogroup(slots.groupBy(*key))
    return both.applyInArrow(join, "slot long, source string, block long, n_tokens int, doc_ids array<long>, tokens binary")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, power: float = POWER, block: int = TOKENS, seed: int = 3) -> DataFrame:
    """``docs`` in the order of the schedule, with all their columns.

    A document stands whole at each slot that plays the block it starts in (see
    `blocks`, which cuts them), so documents of sources below their target
    repeat, and none of a source with a weight is left out.  Rows without
    tokens stand at the front, once.  Rows that repeat the same id and text are
    played one for one.
    """
    rows = _store.materialize(coded(docs, ids=False), "mix-coded")
    split, parts = parted(rows, block, seed)
    slots = schedule(_store.materialize(shares(parts, rows, weights, power), "mix-shares"))
    w = Window.partitionBy("source", "part", "sub").orderBy("h", "doc_id", "k1", "k2", "uid")
    at = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    starts = split.withColumn("at", at).join(parts, ["source", "part", "sub"]).select("source", (F.col("first_block") + F.floor(F.col("at") / block)).alias("block"), "k1", "k2")
    a, b, n, x, y, slot, nth = _store.fresh(docs.columns, "k1", "k2", "n", "x1", "x2", "slot", "nth")
    # rows of equal key are equal in text: their plays are shared out below
    plays = slots.join(starts.hint("merge"), ["source", "block"]).select(F.col("k1").alias(x), F.col("k2").alias(y), F.col("slot").alias(slot))
    plays = plays.groupBy(x, y).agg(F.sort_array(F.collect_list(slot)).alias(slot))
    k1, k2 = _store.row_key()
    keyed = docs.withColumns({a: k1, b: k2})
    twice = rows.groupBy(F.col("k1").alias(x), F.col("k2").alias(y)).agg(F.count("*").alias(n))
    plan = plays.join(twice, [x, y])
    blank = F.coalesce(F.col("text").cast("string"), F.lit("")) == ""
    silent = docs.where(blank).withColumn(slot, F.lit(-1).cast("long"))
    same = Window.partitionBy(a, b).orderBy(F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))
    joined = keyed.where(~blank).withColumn(nth, F.row_number().over(same) - 1).join(plan, (F.col(a) == F.col(x)) & (F.col(b) == F.col(y)))
    own = F.filter(F.col(slot), lambda s, k: k % F.col(n) == F.col(nth))
    played = joined.withColumn(slot, F.explode(own)).select(*(F.col(f"`{c}`") for c in docs.columns), slot)
    parts_ = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = F.lit(max(1, (slots.agg(F.max("slot")).first()[0] or 0) + 1))
    out = silent.unionByName(played)
    placed = out.repartitionById(parts_, F.greatest(F.lit(0), F.floor(F.col(slot) * parts_ / most)).cast("int"))
    return placed.sortWithinPartitions(slot).drop(slot)

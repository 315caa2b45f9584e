"""Hard-negative mining with a distributed radix selection.

A window is an anchor with a range of scores and a number k: its result is the k best rows in the range, by score and
then by id. All rows stay in the blocks that they were packed into once; blocks of anchors with their windows meet all of
them. A round counts, for every open window, the rows of each digit of the score below its range's top; summed over all
blocks, the counts tell the bucket that holds the k-th row, and this bucket is the next round's range. Equal scores are told
apart by the digits of their ids in the same way. A window is closed once at most `slack * k` rows are left, and only these
are then gathered and ranked. So no step sorts, collects or shuffles the rows of a window, however many have one score.

Positives are selected in a window over all scores of rows of the anchor's label; each gives a window of its negatives.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantlens.llm.common import shared_folder, stage_table

BLOCKS = "block binary"
WINDOWS = "slot int, same boolean, low long, high long, id_low long, id_high long, by_id boolean, need long"
#: Components are taken as 32-bit integers.
LIMIT = (1 << 31) - 1
_EXACT = "decimal(20,0)"


@dataclass(frozen=True)
class MiningSettings:
    """low and high: a negative's score in hundredths of its positive's. block: rows of a block. slack: see above."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    block: int = 4096
    digit_bits: int = 8
    slack: int = 8


def quantised(vector: Column, steps: int = 256) -> Column:
    """floor(steps * x) of every component, as double precision has it, within 32 bits."""
    return F.transform(vector, lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(x.cast("double") * steps))).cast("int"))


def usable(vector: Column) -> Column:
    """False for a null vector or one with a component that is null, infinite or not a number."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros, which change no score."""
    lengths = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    out = np.zeros((len(column), int(lengths.max(initial=0))), np.int32)
    out[np.arange(out.shape[1]) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _pack(rows: DataFrame, size: int) -> DataFrame:
    """Rows of each partition in blocks of at most `size`: a dictionary of arrays, pickled."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                held = {}
                for name, column in zip(names, part.columns):
                    held[name] = _matrix(column) if name == "vector" else column.to_pylist() if name == "windows" else column.to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(held)], pa.binary())], ["block"])

    return rows.mapInArrow(run, BLOCKS)


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products: in double precision where no sum can pass 2^53, otherwise in 64-bit integers."""
    both = min(anchors.shape[1], rows.shape[1])
    a, b = anchors[:, :both], rows[:, :both]
    bound = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * both
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound >= 1 << 62:
        raise OverflowError("scores of these vectors don't fit in 62 bits")
    return a.astype(np.int64) @ b.astype(np.int64).T


def _inside(window: dict, scores: np.ndarray, same: np.ndarray, ids: np.ndarray, anchor: int) -> np.ndarray:
    """Places of the rows that a window's range has; an anchor is no row of its own."""
    found = np.nonzero((scores >= window["low"]) & (scores <= window["high"]) & (same == window["same"]) & (ids != anchor))[0]
    if window["by_id"]:
        found = found[(ids[found] >= window["id_low"]) & (ids[found] <= window["id_high"])]
    return found


def _shift(low: int, high: int, bits: int) -> int:
    return max(0, (high - low).bit_length() - bits)


def _meet(windows: DataFrame, rows: DataFrame, visit: Callable, finish: Callable, schema: str) -> DataFrame:
    """Blocks of windows with all blocks of rows: visit(state, windows, rows, scores) for each pair, where state is kept
    while a block of windows goes on; finish(state) gives the columns of the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, asked = None, None, None
        for batch in batches:
            for number, left, right in zip(*(batch.column(k) for k in range(3))):
                if number.as_py() != key:
                    if state:
                        yield finish(state)
                    key, state, asked = number.as_py(), {}, pickle.loads(left.as_py())
                held = pickle.loads(right.as_py())
                for at in range(0, len(asked["anchor"]), 256):
                    visit(state, asked, at, held, _scores(asked["vector"][at : at + 256], held["vector"]))
        if state:
            yield finish(state)

    pairs = windows.select(F.xxhash64("block").alias("number"), F.col("block").alias("asked")).crossJoin(rows.hint("shuffle_replicate_nl"))
    return pairs.mapInArrow(run, schema)


def _tally(windows: DataFrame, rows: DataFrame, bits: int) -> DataFrame:
    """(anchor, slot, bucket, n): counts of digits, up to the bucket in which a block of windows has found enough."""

    def visit(state, asked, at, held, scores):
        for i, row in enumerate(scores):
            anchor = int(asked["anchor"][at + i])
            same = held["label"] == asked["label"][at + i]
            for w in asked["windows"][at + i]:
                found = _inside(w, row, same, held["id"], anchor)
                if len(found):
                    if w["by_id"]:
                        steps = held["id"][found].astype(np.uint64) - np.int64(w["id_low"]).astype(np.uint64)
                        steps >>= np.uint64(_shift(w["id_low"], w["id_high"], bits))
                    else:
                        steps = (w["high"] - row[found]) >> _shift(w["low"], w["high"], bits)
                    counts = state.setdefault((anchor, w["slot"]), [w["need"], np.zeros(1 << bits, np.int64)])
                    counts[1] += np.bincount(steps.astype(np.int64), minlength=1 << bits)

    def finish(state):
        out = []
        for (anchor, slot), (need, counts) in state.items():
            enough = int(np.searchsorted(np.cumsum(counts), need))  # no bucket after this one can be the one looked for
            out += [(anchor, slot, int(b), int(counts[b])) for b in np.nonzero(counts[: enough + 1])[0]]
        columns = list(zip(*out)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int64()))], ["anchor", "slot", "bucket", "n"])

    return _meet(windows, rows, visit, finish, "anchor long, slot int, bucket int, n long")


def _gather(windows: DataFrame, rows: DataFrame) -> DataFrame:
    """(anchor, slot, id, score) of the rows that closed windows leave."""

    def visit(state, asked, at, held, scores):
        out = state.setdefault("rows", [])
        for i, row in enumerate(scores):
            anchor = int(asked["anchor"][at + i])
            same = held["label"] == asked["label"][at + i]
            for w in asked["windows"][at + i]:
                found = _inside(w | {"by_id": False}, row, same, held["id"], anchor)
                if w["by_id"]:
                    found = found[(row[found] > w["low"]) | (held["id"][found] <= w["id_high"])]
                out += [(anchor, w["slot"], int(held["id"][f]), int(row[f])) for f in found]

    def finish(state):
        columns = list(zip(*state["rows"])) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["anchor", "slot", "id", "score"])

    return _meet(windows, rows, visit, finish, "anchor long, slot int, id long, score long")


def _with_vectors(windows: DataFrame, anchors: DataFrame, many: int, size: int) -> DataFrame:
    """Windows of each of `many` anchors, a few in number, beside its vector, in staged blocks."""
    held = windows.groupBy("anchor").agg(F.collect_list(F.struct(*[c.split()[0] for c in WINDOWS.split(", ")])).alias("windows"))
    joined = anchors.join(held, "anchor").select("anchor", "label", "vector", "windows")
    return stage_table(_pack(joined.repartition(max(1, -(-many // size))), size), "window-blocks")


def _next_range(bits: int, keep: int) -> dict[str, Column]:
    """Columns of a window after a round, from its own, the bucket of its need-th row (null if it has fewer), the rows n in
    it and cum up to it. `closed` windows keep all that they have down to low, or, by id, up to id_high."""
    c = F.col
    exact = lambda x: x.cast(_EXACT)
    span = lambda low, high: F.length(F.regexp_replace(F.conv(exact(c(high)) - exact(c(low)), 10, 2), "^0+", ""))
    step = lambda low, high: F.pow(F.lit(2.0), F.greatest(F.lit(0), span(low, high) - bits)).cast(_EXACT)
    wide, long_ = step("low", "high"), step("id_low", "id_high")
    high = F.when(~c("by_id"), (exact(c("high")) - exact(c("bucket")) * wide).cast("long")).otherwise(c("high"))
    low = F.when(~c("by_id"), F.greatest(exact(c("low")), exact(c("high")) - (exact(c("bucket")) + 1) * wide + 1).cast("long")).otherwise(c("low"))
    id_low = F.when(c("by_id"), (exact(c("id_low")) + exact(c("bucket")) * long_).cast("long")).otherwise(c("id_low"))
    id_high = F.when(c("by_id"), F.least(exact(c("id_high")), exact(c("id_low")) + (exact(c("bucket")) + 1) * long_ - 1).cast("long")).otherwise(c("id_high"))
    none = c("bucket").isNull()
    few = c("taken") + c("cum") <= keep
    single = F.when(c("by_id"), id_low == id_high).otherwise(F.lit(False))
    return {
        "low": F.when(none, c("low")).otherwise(low),
        "high": F.when(none, c("high")).otherwise(high),
        "id_low": F.when(none, c("id_low")).otherwise(id_low),
        "id_high": F.when(none, c("id_high")).otherwise(id_high),
        "closed": none | few | single,
        "by_id": F.when(none | few, c("by_id")).otherwise(c("by_id") | (low == high)),
        "taken": F.when(none | few | single, c("taken")).otherwise(c("taken") + c("cum") - c("n")),
        "need": F.when(none | few | single, c("need")).otherwise(c("need") - c("cum") + c("n")),
    }


def select_top(rows: DataFrame, anchors: DataFrame, windows: DataFrame, k: int, ids: tuple[int, int], settings: MiningSettings) -> DataFrame:
    """windows (anchor, slot, same, low, high) to (anchor, slot, id, score, rank): the k best rows of each, ties to smaller ids.

    rows: blocks of (id, label, vector). anchors (anchor, label, vector). same: whether rows have the anchor's label or
    another one. A window with low over high, or without rows, gives none.
    """
    spare = settings.slack * k
    fixed = {"top": F.col("high"), "id_low": F.lit(ids[0]), "id_high": F.lit(ids[1]), "by_id": F.col("low") == F.col("high"), "need": F.lit(k).cast("long"), "taken": F.lit(0).cast("long")}
    open_ = stage_table(windows.where("low <= high").withColumns(fixed), "open-windows")
    closed, many = None, anchors.count()
    while open_.limit(1).count():
        blocks = _with_vectors(open_, anchors, many, settings.block)
        counts = _tally(blocks, rows, settings.digit_bits).groupBy("anchor", "slot", "bucket").agg(F.sum("n").alias("n"))
        upto = Window.partitionBy("anchor", "slot").orderBy("bucket")
        sums = counts.withColumn("cum", F.sum("n").over(upto)).join(open_.select("anchor", "slot", "need"), ["anchor", "slot"])
        found = sums.where("cum >= need").groupBy("anchor", "slot").agg(F.min(F.struct("bucket", "n", "cum")).alias("f")).select("anchor", "slot", "f.*")
        after = _next_range(settings.digit_bits, spare)
        turned = stage_table(open_.join(found, ["anchor", "slot"], "left").select("anchor", "slot", "same", "top", *[e.alias(n) for n, e in after.items()]), "windows-after")
        over = turned.where("closed").drop("closed")
        closed = over if closed is None else closed.union(over)
        open_ = turned.where("not closed").drop("closed")
    if closed is None:
        return open_.select("anchor", "slot", F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("score"), F.lit(0).alias("rank"))
    # what was above a window's last range belongs to it as well
    left = _gather(_with_vectors(closed.withColumn("high", F.col("top")), anchors, many, settings.block), rows)
    best = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return left.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, settings: MiningSettings = MiningSettings()) -> DataFrame:
    """rows (id, label, vector of integers) to the hard negatives of the rows for which is_anchor holds.

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score. A score is the inner product of two
    vectors; where their lengths differ, components that one of them lacks count as 0. An anchor's positives are the best
    other rows of its label; a positive's negatives are the best rows of other labels whose score is within low and high
    hundredths of the positive's. Ties go to smaller ids. Rows with a null id, label or vector take no part; ids are keys: of
    rows that share one, the least by label and vector takes part, so that repeated rows count once. An anchor without
    positives, or a positive without negatives, gives no row; an empty table gives none. Other columns of rows aren't read,
    so they may have any name. Components are at most 32 bits wide; scores that could pass 62 bits raise an OverflowError.
    """
    spark = rows.sparkSession
    shared_folder(spark)
    many = int(spark.conf.get("spark.sql.shuffle.partitions"))
    flagged = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<int>").alias("vector"), is_anchor.alias("asks"))
    whole = flagged.where("id is not null and label is not null and vector is not null").repartition(many, "id")
    unique = stage_table(whole.groupBy("id").agg(F.min(F.struct("label", "vector", "asks")).alias("r")).select("id", "r.*"), "mining-rows")
    squares = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    first, last, longest = unique.agg(F.min("id"), F.max("id"), F.max(squares)).first()
    anchors = stage_table(unique.where("asks").select(F.col("id").alias("anchor"), "label", "vector", (F.sqrt(squares * float(longest or 0)).cast("long") + 1).alias("reach")), "anchors")
    blocks = stage_table(_pack(unique.select("id", "label", "vector"), settings.block), "mining-blocks")
    everything = anchors.select("anchor", F.lit(0).alias("slot"), F.lit(True).alias("same"), (-F.col("reach")).alias("low"), F.col("reach").alias("high"))
    anchors, ids = anchors.drop("reach"), (first or 0, last or 0)
    positives = stage_table(select_top(blocks, anchors, everything, settings.positives, ids, settings).select("anchor", F.col("rank").alias("slot"), F.col("id").alias("positive"), F.col("score").alias("near")), "positives")
    within = positives.select(
        "anchor", "slot", F.lit(False).alias("same"),
        F.ceil(F.col("near").cast(_EXACT) * settings.low / F.lit(100).cast(_EXACT)).cast("long").alias("low"),
        F.floor(F.col("near").cast(_EXACT) * settings.high / F.lit(100).cast(_EXACT)).cast("long").alias("high"),
    )
    negatives = select_top(blocks, anchors, within, settings.negatives, ids, settings)
    return negatives.join(positives, ["anchor", "slot"]).select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank",
        F.col("id").alias("negative_id"), F.col("near").alias("positive_score"), F.col("score").alias("negative_score"),
    )

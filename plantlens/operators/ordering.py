"""Operators over ordered rows: first-seen rules, carried headers, runs, gaps, ordinals and tie-rejecting maxima.

Order always comes from columns, never from how rows happen to be stored, and ties are broken by further columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Columns = list[str | Column]


def dedupe_first(df: DataFrame, keys: Columns, order: Columns) -> DataFrame:
    """The first row of each key. Spark limits each partition's groups to one row before the shuffle."""
    rank = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__row", F.row_number().over(rank)).where("__row = 1").drop("__row")


def carry_forward(df: DataFrame, value: Column, name: str, keys: Columns, order: Columns) -> DataFrame:
    """The last value that isn't null up to each row, e.g. the header that a line stands under."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def number_runs(df: DataFrame, starts: Column, name: str, keys: Columns, order: Columns) -> DataFrame:
    """Running number of the run that each row belongs to; a run begins where starts is true."""
    return df.withColumn(name, F.sum(F.coalesce(starts, F.lit(False)).cast("long")).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def merge_runs(df: DataFrame, value: str, at: str, keys: Columns, order: Columns) -> DataFrame:
    """Runs of equal neighbouring values: keys, value, first_at, last_at and n."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1
    marked = df.withColumn("__new", first | ~before.eqNullSafe(F.col(value)))
    runs = number_runs(marked, F.col("__new"), "__run", keys, order)
    return runs.groupBy(*keys, "__run", value).agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("n")).drop("__run")


def gap_groups(df: DataFrame, at: Column, gap: Column | float, name: str, keys: Columns, order: Columns) -> DataFrame:
    """Groups of rows whose distance from the row before is at most gap."""
    before = F.lag(at).over(Window.partitionBy(*keys).orderBy(*order))
    marked = df.withColumn("__far", before.isNull() | (at - before > gap))
    return number_runs(marked, F.col("__far"), name, keys, order).drop("__far")


def unique_best(df: DataFrame, keys: Columns, score: str, tie_break: list[str] = ()) -> DataFrame:
    """The row of the highest score, ties by ascending tie_break; no row where the best one isn't unique."""
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), *tie_break)
    ranked = df.withColumn("__rank", F.rank().over(order)).where("__rank = 1")
    return ranked.withColumn("__same", F.count("*").over(Window.partitionBy(*keys))).where("__same = 1").drop("__rank", "__same")


def tile_check(df: DataFrame, start: str, end: str, keys: Columns, order: Columns) -> DataFrame:
    """Adds gap and overlap between each range and the one before it."""
    before = F.lag(end).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumns({"gap": F.greatest(F.col(start) - before, F.lit(0)), "overlap": F.greatest(before - F.col(start), F.lit(0))})


def allocation_jumps(df: DataFrame, value: str, keys: Columns, order: Columns) -> DataFrame:
    """Rows whose value is a new maximum that doesn't follow the last maximum by one, with that one as `expected`."""
    before = F.max(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("expected", before + 1).where(F.col(value) > F.col("expected"))


def pair_neighbours(rows: DataFrame, keys: list[str], at: str, likeness: str, least: float, chunk: int = 4096) -> DataFrame:
    """Adds `pair`: where a row begins a pair with the next one, greedily in the order of `at`; else null.

    likeness is that of a row with the next one, `at` counts 0, 1, 2, ... within a key. A row is a candidate if its likeness
    is above `least` and above the next row's, and begins a pair if it is a candidate and isn't the second of one itself. After
    a row that is none the choice starts anew, so a row's state is its distance from the last such row, counted from both
    sides of the borders of chunks: first within chunks, then over chunks. So a long key is many tasks. A chunk also gets the
    first row of the next one, so that rows are moved and sorted once and only chunks meet them.
    """
    part = Window.partitionBy(*keys, "__chunk").orderBy(at)
    home = F.floor(F.col(at) / chunk)
    chunked = rows.withColumn("__chunk", F.explode(F.when(F.col(at) % chunk == 0, F.array(home, home - 1)).otherwise(F.array(home))))
    own = F.coalesce(F.col(likeness), F.lit(-1.0))  # a row without a likeness is less like the next one than any other
    after = F.coalesce(F.lead(own).over(part), F.lit(-1.0))
    marked = chunked.withColumn("__next", after)
    marked = marked.withColumn("__can", F.coalesce((F.col(likeness) > least) & (F.col(likeness) > F.col("__next")), F.lit(False)))
    free = F.max(F.when(~F.col("__can"), F.col(at))).over(part.rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("__free", free).where(F.col("__chunk") == home)
    last = marked.groupBy(*keys, "__chunk").agg(F.max("__free").alias("__last"))
    before = F.max("__last").over(Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1))
    carried = marked.join(last.withColumn("__before", before).drop("__last"), [*keys, "__chunk"])
    state = F.col(at) - F.coalesce("__free", "__before", F.lit(-1))
    return carried.withColumn("pair", F.when(F.col("__can") & (state % 2 == 1), F.col(at) + 1)).drop("__chunk", "__next", "__can", "__free", "__before")


def zip_ordinals(left: DataFrame, right: DataFrame, keys: list[str], left_order: Columns, right_order: Columns) -> DataFrame:
    """Joins the n-th row of each side within a key, only for keys that have as many rows on both sides."""

    def numbered(df: DataFrame, order: Columns) -> DataFrame:
        whole = Window.partitionBy(*keys)
        return df.withColumns({"__n": F.row_number().over(whole.orderBy(*order)), "__all": F.count("*").over(whole)})

    return numbered(left, left_order).join(numbered(right, right_order), [*keys, "__n", "__all"]).drop("__n", "__all")

"""Packing documents into padded batches: optimal length buckets from the global histogram, then token-budget batches.

The histogram has a row for each length that occurs, so at most the root of twice the number of tokens; dynamic
programming over it is exact and takes time in proportion to its rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

@dataclass(frozen=True)
class PackSettings:
    """A batch has at most budget tokens, padding counted, or one document; batches form in slices of a bucket."""

    buckets: int = 16
    budget: int = 65_536
    slice_docs: int = 4096
    seed: int = 29


def length_histogram(lengths: DataFrame) -> DataFrame:
    """(length) to one row for each length: documents n."""
    return lengths.groupBy("length").agg(F.count("*").alias("n"))


def optimal_boundaries(lengths: np.ndarray, n: np.ndarray, buckets: int) -> list[int]:
    """Upper lengths of at most `buckets` buckets that minimise padded tokens; lengths come in ascending order.

    A bucket from length i to length j costs x[j] * (D[j] - D[i]), D being the documents below. For each number of buckets,
    the least cost up to j is x[j] * D[j] plus the lower envelope at x[j] of lines with slopes -D[i]. Slopes fall and
    places rise, so that each line enters and leaves the envelope once.
    """
    if not len(lengths):
        return [0]
    x, docs = lengths.astype(np.float64).tolist(), np.concatenate([[0], np.cumsum(n)]).astype(np.float64).tolist()
    many = len(x)
    best, cuts = [x[j] * docs[j + 1] for j in range(many)], []
    for _ in range(min(buckets, many) - 1):
        before, now, cut = [0.0, *best[:-1]], [0.0] * many, [0] * many
        line: list[int] = []
        top = 0
        for j in range(many):
            while len(line) - top >= 2:
                a, b = line[-2], line[-1]  # b is never lowest if line j passes the crossing of a and b from below
                if (before[j] - before[a]) * (docs[b] - docs[a]) > (before[b] - before[a]) * (docs[j] - docs[a]):
                    break
                line.pop()
            line.append(j)
            while len(line) - top >= 2 and before[line[top + 1]] - x[j] * docs[line[top + 1]] <= before[line[top]] - x[j] * docs[line[top]]:
                top += 1
            cut[j] = line[top]
            now[j] = before[cut[j]] + x[j] * (docs[j + 1] - docs[cut[j]])
        cuts.append(cut)
        best = now
    end, out = many - 1, []
    for cut in reversed(cuts):
        out.append(int(x[end]))
        if cut[end] == 0:
            return sorted(out)
        end = cut[end] - 1
    return sorted([*out, int(x[end])])


def pack(docs: DataFrame, length: Column, settings: PackSettings = PackSettings()) -> DataFrame:
    """Each row of docs (doc_id) with its length, bucket, boundary, slice, batch, slot and padding.

    A batch is (bucket, slice, batch); its rows are padded to the boundary. A null length counts as 0. Repeated rows get
    slots of their own, rows of equal order are interchangeable, and no rows give no rows. Columns other than doc_id and
    those of the length aren't read, so they may have any name. Slices keep a bucket that holds most rows spread over many tasks; each ends with at most one
    batch that isn't full.
    """
    rows = docs.select("doc_id", F.coalesce(length, F.lit(0)).cast("long").alias("length"))
    cells = length_histogram(rows).toArrow().sort_by("length")  # bounded: see above
    lengths, n = cells.column("length").to_numpy(), cells.column("n").to_numpy()
    bounds = optimal_boundaries(lengths, n, settings.buckets)
    held = np.bincount(np.searchsorted(bounds, lengths), weights=n, minlength=len(bounds)).astype(int).tolist()
    of_bucket = lambda values: F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), F.col("bucket") + 1)
    hashed = F.xxhash64(F.lit(settings.seed), "doc_id")
    order = Window.partitionBy("bucket", "slice").orderBy("order", "doc_id", "length")
    return (
        rows.withColumn("bucket", sum([(F.col("length") > b).cast("int") for b in bounds[:-1]], F.lit(0)))
        .withColumn("boundary", of_bucket(bounds))
        .withColumn("slice", F.pmod(hashed, of_bucket([max(1, -(-n // settings.slice_docs)) for n in held])))
        .withColumn("order", F.xxhash64(F.lit(settings.seed + 1), "doc_id"))
        .withColumn("row", F.row_number().over(order) - 1)
        .withColumn("per_batch", F.greatest(F.lit(1), F.floor(F.lit(settings.budget) / F.greatest("boundary", F.lit(1)))))
        .select(
            "doc_id", "length", "bucket", "boundary", "slice", F.floor(F.col("row") / F.col("per_batch")).alias("batch"),
            (F.col("row") % F.col("per_batch")).alias("slot"), (F.col("boundary") - F.col("length")).alias("padding"),
        )
    )

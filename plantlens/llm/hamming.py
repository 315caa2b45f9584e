"""Exact top-k search over binary codes with incremental multi-index hashing.

Codes are cut into segments of about log2(n) bits, each an index of its own. A search probes, in every segment, all keys
within a radius of the query's, and the radius grows by one each round: after radius r in m segments every code within
Hamming distance m * (r + 1) - 1 has been seen, because a code further off in each segment is further off than that. A
query is done when its k-th verified distance is covered so. Equal codes are one entry, for the index and for queries. A
pair of codes is kept only where it is met first, in the order of radii and then of segments, so it comes once.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantlens.llm.common import shared_folder

BITS = 64
#: Up to this many keys around a query's are enumerated; at larger radii the keys that occur are compared instead.
FLIPS = 1 << 15
#: Parts of a segment's keys, each compared with all queries in a task of its own.
PARTS = 64


def sign_code(vector: Column) -> Column:
    """The signs of the first 64 components as bits, the first component highest; null for null."""
    bit = lambda x: F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")
    return F.aggregate(F.slice(vector, 1, BITS), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(bit(x)))


def _segments(n: int) -> list[tuple[int, int]]:
    """(shift, width) of segments of about log2(n) bits."""
    many = max(2, min(16, round(BITS / max(4.0, np.log2(max(2, n))))))
    ends = np.linspace(0, BITS, many + 1).astype(int).tolist()
    return list(zip(ends, np.diff(ends).tolist()))


def top_k(index: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """index, queries (id, code) to (query, rank, id, distance): for each query the k nearest other rows, exactly.

    Ties go to the smaller id. Rows without a code are left out on both sides; a query gets fewer than k rows only if
    the index has fewer. A query's own id is no neighbour; repeated ids of the index count once. Columns other than id and
    code aren't read, so they may have any name.
    """
    spark = index.sparkSession
    shared_folder(spark)
    index = index.where("code is not null and id is not null").select("id", "code")
    first = Window.partitionBy("code").orderBy("id")
    entries = index.dropDuplicates(["id", "code"]).withColumn("row", F.row_number().over(first)).where(F.col("row") <= k + 1).drop("row").checkpoint()
    codes = entries.groupBy("code").agg(F.count("*").alias("n")).checkpoint()  # k + 1 at most of equal ones
    n = codes.count()
    segments = _segments(n)
    m, widest = len(segments), max(w for _, w in segments)
    key = lambda code, shift, width: F.shiftrightunsigned(code, shift).bitwiseAND(F.lit((1 << width) - 1))
    keys = lambda code: F.array(*[F.struct(F.lit(s).alias("segment"), key(code, *seg).alias("key")) for s, seg in enumerate(segments)])
    table = codes.select(F.explode(keys(F.col("code"))).alias("s"), "code", "n").select("s.segment", "s.key", "code", "n").checkpoint()
    asked = queries.where("code is not null and id is not null").select(F.col("id").alias("query"), F.col("code").alias("asked"))
    open_ = asked.select("asked").distinct().checkpoint()
    own = lambda s: F.bit_count(key(F.col("asked").bitwiseXOR(F.col("code")), *segments[s]))
    part = F.pmod(F.xxhash64("key"), F.lit(PARTS))
    found = done = None
    for radius in range(widest + 1):
        probes = open_.select("asked", F.explode(keys(F.col("asked"))).alias("s")).select("asked", "s.segment", "s.key")
        if comb(widest, radius) <= FLIPS:
            flips = [[sum(1 << b for b in c) for c in combinations(range(width), radius)] for _, width in segments]
            masks = spark.createDataFrame([(s, f) for s, f in enumerate(flips)], "segment int, flips array<long>")  # at most FLIPS for each segment
            near = probes.join(F.broadcast(masks), "segment").select("asked", "segment", F.explode("flips").alias("flip"), "key").select("asked", "segment", F.col("key").bitwiseXOR(F.col("flip")).alias("key"))
        else:
            held = table.select("segment", "key").distinct().withColumn("part", part)
            spread = probes.withColumnRenamed("key", "own").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).cast("long"))
            near = spread.join(held, ["segment", "part"]).where(F.bit_count(F.col("own").bitwiseXOR(F.col("key"))) == radius).select("asked", "segment", "key")
        # not met by a segment before this one at this radius, nor by a later one at a smaller radius
        first_met = [(F.col("segment") == s) | (own(s) > F.when(F.col("segment") > s, radius).otherwise(radius - 1)) for s in range(m)]
        hits = near.join(table, ["segment", "key"])
        for met in first_met:
            hits = hits.where(met)
        hits = hits.select("asked", "code", "n", F.bit_count(F.col("asked").bitwiseXOR(F.col("code"))).cast("int").alias("distance"))
        found = (hits if found is None else found.union(hits)).checkpoint()
        # the distance within which k + 1 rows are; what is beyond can be dropped
        within = Window.partitionBy("asked").orderBy("distance")
        counts = found.groupBy("asked", "distance").agg(F.sum("n").alias("n")).withColumn("seen", F.sum("n").over(within))
        reach = counts.groupBy("asked").agg(F.min(F.when(F.col("seen") >= k + 1, F.col("distance"))).alias("reach"))
        reach = open_.join(reach, "asked", "left").withColumn("closed", (F.coalesce("reach", F.lit(BITS + 1)) <= m * (radius + 1) - 1) | F.lit(radius == widest)).checkpoint()
        found = found.join(reach, "asked").where(F.col("distance") <= F.coalesce("reach", F.lit(BITS)))
        ready = found.where("closed").select("asked", "code", "distance")
        done = ready if done is None else done.union(ready)
        found = found.where("not closed").select("asked", "code", "n", "distance")
        open_ = reach.where("not closed").select("asked").checkpoint()
        if not open_.limit(1).count():
            break
    best = Window.partitionBy("query").orderBy("distance", "id")
    near = asked.join(done, "asked").join(entries, "code").where("id <> query")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query", "rank", "id", "distance")

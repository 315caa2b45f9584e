"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's documents are dealt by a hash into blocks, whose index is then a random permutation of the source. A
source with target T and size S is taken floor(T / S) times whole, and the rest from its first blocks, the last of them
in part. The block draws of all sources are dealt out among output shards by a tree: each node halves its shards, and
the number of draws of each source that go left is drawn from the multivariate hypergeometric distribution, so that the
quotas of every level add up exactly. A bijection of each source's draws then gives each shard its own disjoint blocks,
and documents are shuffled inside their shard only.

Only DataFrame functions are used. A hot source is never one task: sums over blocks are taken in two levels.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantlens.llm.common import fresh, row_key, shared_folder, word_count

#: Up to this many sources the table of sources is broadcast, otherwise it is joined by a shuffle.
BROADCAST_SOURCES = 10_000
#: Blocks whose sizes are summed together in the first of the two levels.
SUPERBLOCK = 1024
#: The draws of a source are permuted by multiplication with this prime modulo their number.
PRIME = 2_147_483_647


@dataclass(frozen=True)
class MixSettings:
    """Weights repeat over the sources in code point order, null last; no source is taken more than `cap` times."""

    weights: tuple[float, ...] = (5, 2, 1)
    cap: int = 3
    block_words: int = 4096
    shard_words: int = 1 << 20
    seed: int = 17


def source_targets(sized: DataFrame, settings: MixSettings = MixSettings()) -> DataFrame:
    """One row for each source: source_index, source, source_size, target. The targets add up to the size of all.

    min(cap * size, weight * level) for the highest level that doesn't exceed the total; a source of size 0 gets 0.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything, by_source = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    limit = F.col("source_size") * float(settings.cap)
    by_level = Window.orderBy(F.col("limit") / F.col("weight"), "source_index")
    return (
        sources.withColumn("source_index", F.row_number().over(by_source) - 1)
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in settings.weights]), F.col("source_index") % len(settings.weights) + 1))
        .withColumn("limit", limit)
        .withColumn("below", F.coalesce(F.sum("limit").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("above", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", F.max((F.sum("source_size").over(everything) - F.col("below")) / F.col("above")).over(everything))
        .select("source_index", "source", "source_size", F.least("limit", F.col("weight") * F.col("level")).alias("target"))
    )


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _uniform(*keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys only."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) * F.lit(2.0**-53)


def _hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """Number of good ones among `drawn` of `total`, by inversion of the distribution from its mode outwards.

    Terms further than 12 standard deviations from the mode are under the precision of a double and left out.
    """

    def term_ratio(p, k):  # P(k) / P(k - 1)
        return (p.good - k + 1.0) * (p.drawn - k + 1.0) / (k * (p.total - p.good - p.drawn + k))

    def walk(ks, p, start, left, up):
        """The first k whose cumulated terms exceed `left`, and the sum of all terms."""

        def step(acc, k):
            term = acc.term * (term_ratio(p, k) if up else 1.0 / term_ratio(p, k + 1))
            return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"), F.when(acc["sum"] <= left, k).otherwise(acc.k).alias("k"))

        return F.aggregate(ks, F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"), start.alias("k")), step)

    empty = F.array().cast("array<bigint>")
    p = F.struct(total.cast("double").alias("total"), good.cast("double").alias("good"), drawn.cast("double").alias("drawn"))

    def from_mode(p):
        mode = F.floor((p.drawn + 1) * (p.good + 1) / (p.total + 2))
        share = p.good / F.greatest(p.total, F.lit(1.0))
        reach = F.ceil(12 * F.sqrt(p.drawn * share * (1 - share))) + 12
        low = F.greatest(F.lit(0.0), p.drawn - (p.total - p.good)).cast("long")
        high = F.least(p.good, p.drawn).cast("long")
        return _let(
            F.struct(F.least(F.greatest(mode, low), high).alias("mode"), low.alias("low"), high.alias("high"), reach.alias("reach")),
            lambda m: _let(
                F.struct(
                    F.when(m.high > m.mode, F.sequence(m.mode + 1, F.least(m.high, m.mode + m.reach))).otherwise(empty).alias("up"),
                    F.when(m.mode > m.low, F.sequence(m.mode - 1, F.greatest(m.low, m.mode - m.reach))).otherwise(empty).alias("down"),
                ),
                lambda ks: _let(
                    F.struct(walk(ks.up, p, m.mode, F.lit(0.0), True)["sum"].alias("up"), walk(ks.down, p, m.mode, F.lit(0.0), False)["sum"].alias("down")),
                    lambda s: _let(
                        u * (1 + s.up + s.down),
                        lambda x: F.when(x < 1, m.mode).when(x < 1 + s.up, walk(ks.up, p, m.mode, x - 1, True).k).otherwise(walk(ks.down, p, m.mode, x - 1 - s.up, False).k),
                    ),
                ),
            ),
        )

    return _let(p, from_mode)


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source_index, draws) to (shard, source_index, draws): exact quotas, dealt out by the splitting tree."""
    root = quotas.where("draws > 0").agg(F.array_sort(F.collect_list(F.struct("source_index", "draws"))).alias("quota"), F.sum("draws").alias("all"))
    nodes = root.select(F.lit(1).cast("long").alias("node"), F.lit(0).cast("long").alias("low"), F.lit(shards).cast("long").alias("high"), "quota", "all")
    slots = lambda shard: F.floor(shard * F.col("all") / F.lit(shards))
    for _ in range(max(0, shards - 1).bit_length()):
        middle = F.floor((F.col("low") + F.col("high")) / 2)

        def deal(acc, x):
            u = _uniform(F.lit(seed), F.col("node"), x.source_index)
            return _let(
                _hypergeometric(acc.total, x.draws, acc.open, u),
                lambda k: F.struct((acc.total - x.draws).alias("total"), (acc.open - k).alias("open"), F.concat(acc.dealt, F.array(F.struct(x.source_index.alias("source_index"), k.alias("draws")))).alias("dealt")),
            )

        start = F.struct((slots(F.col("high")) - slots(F.col("low"))).alias("total"), (slots(F.col("middle")) - slots(F.col("low"))).alias("open"), F.array().cast("array<struct<source_index:int,draws:bigint>>").alias("dealt"))
        halves = nodes.withColumn("middle", middle).withColumn("left", F.aggregate("quota", start, deal).dealt)
        rest = F.zip_with("quota", "left", lambda q, k: F.struct(q.source_index.alias("source_index"), (q.draws - k.draws).alias("draws")))
        child = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("low"), F.col("middle").alias("high"), F.col("left").alias("quota")),
            F.struct((F.col("node") * 2 + 1).alias("node"), F.col("middle").alias("low"), F.col("high"), rest.alias("quota")),
        )
        nodes = halves.select(F.explode(child).alias("c"), "all").where("c.high > c.low").select("c.node", "c.low", "c.high", F.filter("c.quota", lambda q: q.draws > 0).alias("quota"), "all")
    return nodes.select(F.col("low").alias("shard"), F.explode("quota").alias("q")).select("shard", "q.source_index", "q.draws")


def _permuted(place: Column, draws: Column, seed: int) -> Column:
    """A bijection of 0..draws - 1. Products go beyond a long from about 4e9 draws on, so they are decimals."""
    factor = F.when(draws % PRIME == 0, 1).otherwise(PRIME).cast("decimal(10,0)")
    return ((place.cast("decimal(19,0)") * factor + seed) % draws.cast("decimal(19,0)")).cast("long")


def plan_mix(sized: DataFrame, settings: MixSettings = MixSettings()) -> DataFrame:
    """Says of each row of sized (doc_id, source, size) how the mix takes it.

    Returns doc_id, size, source_size, target, taken (words, repeats counted), whole (times the mix takes all of it),
    part (words of the last, partial take) and shards (one output shard for each take). Null sources form a source of
    their own, after all others; rows of size 0 are taken with 0 words; repeated rows are rows of their own, and equal
    ones are interchangeable. An empty table gives an empty plan.
    """
    shared_folder(sized.sparkSession)
    sized = sized.select("doc_id", "source", F.coalesce("size", F.lit(0)).cast("long").alias("size")).checkpoint()
    targets = source_targets(sized, settings).checkpoint()
    n_sources, words = targets.agg(F.count("*"), F.coalesce(F.sum("target"), F.lit(0.0))).first()
    size, whole_words = F.col("source_size"), F.round("target").cast("long")
    sources = targets.select(
        "source_index", F.col("source").alias("of"), "source_size", "target",
        F.greatest(F.lit(1), F.ceil(size / settings.block_words)).alias("blocks"),
        F.when(size > 0, F.floor(whole_words / size)).otherwise(0).alias("epochs"),
        F.when(size > 0, whole_words % size).otherwise(0).alias("rest"),
    )
    few = F.broadcast(sources) if n_sources <= BROADCAST_SOURCES else sources
    order = F.xxhash64(F.lit(settings.seed), "doc_id")
    docs = (
        sized.join(few, sized["source"].eqNullSafe(few["of"])).drop("source", "of")
        .withColumn("order", order)
        .withColumn("block", F.pmod(F.xxhash64(F.lit(settings.seed + 1), "doc_id"), "blocks"))
    )

    key = ["source_index", "block"]
    blocks = docs.groupBy(*key).agg(F.sum("size").alias("words"), *[F.first(c).alias(c) for c in ("blocks", "epochs", "rest")])
    blocks = blocks.withColumn("super", F.floor(F.col("block") / SUPERBLOCK)).checkpoint()
    supers = blocks.groupBy("source_index", "super").agg(F.sum("words").alias("words"))
    supers = supers.select("source_index", "super", (F.sum("words").over(Window.partitionBy("source_index").orderBy("super")) - F.col("words")).alias("super_start"))
    inside = Window.partitionBy("source_index", "super").orderBy("block")
    blocks = blocks.join(supers, ["source_index", "super"]).withColumn("start", F.col("super_start") + F.sum("words").over(inside) - F.col("words"))
    blocks = blocks.withColumn("in_rest", F.col("start") < F.col("rest"))

    last = F.when(F.max(F.when(F.col("in_rest"), F.col("block"))).isNotNull(), F.max(F.when(F.col("in_rest"), F.col("block"))) + 1).otherwise(0)
    quotas = blocks.groupBy("source_index").agg((F.first("epochs") * F.first("blocks") + last).cast("long").alias("draws")).checkpoint()
    shards = max(1, -(-int(words) // settings.shard_words))
    leaves = split_quotas(quotas, shards, settings.seed)
    ranges = leaves.withColumn("end", F.sum("draws").over(Window.partitionBy("source_index").orderBy("shard")))
    dealt = ranges.select("source_index", "shard", F.explode(F.sequence(F.col("end") - F.col("draws"), F.col("end") - 1)).alias("position"))
    takes = (
        blocks.join(quotas, "source_index")
        .select(*key, "draws", F.explode(F.sequence(F.lit(0), F.col("epochs").cast("int"))).alias("epoch"), "epochs", "blocks", "in_rest")
        .where("epoch < epochs or in_rest")
        .withColumn("position", _permuted(F.col("epoch") * F.col("blocks") + F.col("block"), F.col("draws"), settings.seed))
    )
    shards_of = takes.join(dealt, ["source_index", "position"]).groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("epoch", "shard"))), lambda x: x["shard"]).alias("shards"))
    placed = blocks.select(*key, "start", "in_rest").join(shards_of, key, "left")

    # the last block is taken in part: its documents in their order, until the words are used up
    in_block = Window.partitionBy(*key).orderBy("order", "doc_id", "size")
    at = F.col("start") + F.sum("size").over(in_block.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return (
        docs.join(placed, key)
        .withColumn("part", F.greatest(F.lit(0), F.least("size", F.col("rest") - at)).cast("long"))
        .select(
            "doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"),
            F.col("epochs").cast("int").alias("whole"), "part", F.coalesce("shards", F.array().cast("array<bigint>")).alias("shards"), "order",
        )
    )


def mix_documents(docs: DataFrame, settings: MixSettings = MixSettings()) -> DataFrame:
    """The mix itself: rows of docs as often as they are taken, in shards, each shard in a random order of its own.

    A row that is taken in part comes whole, as documents aren't cut here. Repeated rows are planned one by one; as they are
    equal, the takes of all of them are takes of one; maps are compared by their entries. All columns stay as they are, whatever
    their names; maps inside of other columns have no hash and are an error. An empty table gives none; a null text has no words.
    """
    columns = docs.columns
    uid, vid, shard, copy = (fresh(name, columns) for name in ("mix_uid", "mix_vid", "mix_shard", "mix_copy"))
    hashed = [F.array_sort(F.map_entries(f.name)) if isinstance(f.dataType, T.MapType) else F.col(f.name) for f in docs.schema]
    keyed = docs.withColumns(dict(zip((uid, vid), row_key(*hashed))))
    sized = keyed.select(F.struct("doc_id", uid, vid).alias("doc_id"), "source", word_count(F.col("text")).alias("size"))
    plan = plan_mix(sized, settings).where("taken > 0 or size = 0")
    times = F.greatest(F.col("whole") + F.when(F.col("part") > 0, 1).otherwise(0), F.lit(1))
    takes = plan.select(f"doc_id.{uid}", f"doc_id.{vid}", F.posexplode(F.slice("shards", F.lit(1), times)).alias(copy, shard))
    twice = keyed.groupBy(uid, vid).agg(F.count("*").alias("n")).where("n > 1").select(uid, vid).checkpoint()
    if twice.limit(1).count():
        keyed = keyed.join(twice, [uid, vid], "left_anti").union(keyed.join(twice, [uid, vid], "left_semi").dropDuplicates([uid, vid]))
    mixed = keyed.join(takes, [uid, vid])
    return mixed.repartition(shard).sortWithinPartitions(shard, F.xxhash64(F.lit(settings.seed), uid, vid, copy)).select(*columns)

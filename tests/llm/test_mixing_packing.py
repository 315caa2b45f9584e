from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import functions as F

from plantlens.llm import mixing, packing
from plantlens.llm.common import word_count


def sized(docs):
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))


def wanted(sizes):
    """Targets by resharing in rounds."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {s: 0.0 for s in names if not sizes[s]}
    while True:
        rest, w = total - sum(capped.values()), sum(weight[s] for s in names if s not in capped)
        over = {s: 3.0 * sizes[s] for s in names if s not in capped and rest * weight[s] / w > 3 * sizes[s] + 1e-9}
        if not over:
            return {s: capped.get(s, rest * weight[s] / w if w else 0.0) for s in names}
        capped |= over


def test_targets_and_taken_words(docs):
    rows = sized(docs)
    sizes = {r.source: r.n for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    target = wanted(sizes)
    settings = mixing.MixSettings(block_words=50, shard_words=400)
    out = mixing.plan_mix(rows, settings)
    got = out.collect()
    assert len(got) == rows.count()
    assert all(r.taken <= 3 * r.size and r.taken == r.whole * r.size + r.part for r in got)
    assert all(len(r.shards) >= r.whole + (r.part > 0) for r in got)
    by = {}
    for r in got:
        by.setdefault(round(r.target, 6), [0, 0])
    for s, t in target.items():
        assert any(abs(t - k) < 1e-3 for k in by)
    taken = sum(r.taken for r in got)
    assert abs(taken - sum(sizes.values())) <= len(sizes)
    again = {(r.doc_id, r.size, r.taken, tuple(r.shards)) for r in mixing.plan_mix(rows.repartition(3), settings).collect()}
    assert again == {(r.doc_id, r.size, r.taken, tuple(r.shards)) for r in got}


def test_quotas_add_up(spark):
    q = spark.createDataFrame([(0, 5), (1, 1000), (2, 77), (3, 0)], "source_index int, draws long")
    leaves = mixing.split_quotas(q, 13, 5).toPandas()
    assert leaves.groupby("source_index").draws.sum().to_dict() == {0: 5, 1: 1000, 2: 77}
    per_shard = leaves.groupby("shard").draws.sum()
    assert len(per_shard) == 13 and per_shard.max() - per_shard.min() <= 1


def test_hypergeometric_shares(spark):
    n = 6000
    draw = mixing._hypergeometric(F.lit(20.0), F.lit(8.0), F.lit(9.0), mixing._uniform(F.col("id")))
    got = {r.k: r["count"] / n for r in spark.range(n).select(draw.alias("k")).groupBy("k").count().collect()}
    for k in range(9):
        assert abs(got.get(k, 0) - comb(8, k) * comb(12, 9 - k) / comb(20, 9)) < 0.02


def test_mixed_rows_keep_columns(docs, no_docs):
    settings = mixing.MixSettings(block_words=50, shard_words=400)
    mixed = mixing.mix_documents(docs, settings)
    assert mixed.columns == docs.columns and mixed.count() > 0
    assert mixing.mix_documents(no_docs).count() == 0 and mixing.plan_mix(sized(no_docs)).count() == 0


def test_repeated_rows_are_taken_as_planned(spark):
    """30 equal rows of a source whose target is less than all of them, and others of a source with room."""
    rows = [(7, "one two three four", "a", {"k": 1})] * 30 + [(i, "w " * (i % 5 + 1), "b", None) for i in range(100, 160)] + [(i, "x y", "c", None) for i in range(200, 240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_uid map<string,int>")
    settings = mixing.MixSettings(weights=(1, 5, 1), block_words=8, shard_words=50)
    plan = mixing.plan_mix(sized(docs), settings).collect()
    want, seen = sum(len(r.shards[: r.whole + (r.part > 0)]) for r in plan if r.doc_id == 7), set()
    assert 0 < want < 30
    for n in (1, 3, 7):
        mixed = [(r.doc_id, r.text) for r in mixing.mix_documents(docs.repartition(n), settings).collect()]
        assert abs(sum(i == 7 for i, _ in mixed) - want) <= 1
        taken, target = sum(len(t.split()) for i, t in mixed if i >= 200), next(r.target for r in plan if r.doc_id >= 200)
        assert abs(taken - target) <= 2
        seen.add(tuple(sorted(mixed)))
    assert len(seen) == 1


def test_taken_words_of_each_source(docs):
    rows = sized(docs)
    sizes = {r.source: r.n for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    target = wanted(sizes)
    source = {r.doc_id: r.source for r in rows.collect()}
    taken, targets = dict.fromkeys(target, 0), {}
    for r in mixing.plan_mix(rows, mixing.MixSettings(block_words=50, shard_words=400)).collect():
        taken[source[r.doc_id]] += r.taken
        targets[source[r.doc_id]] = r.target
    for s, t in target.items():
        assert abs(taken[s] - t) <= 1 and (s not in targets or abs(targets[s] - t) < 1e-6), s


def test_many_lengths_are_optimal():
    """Against programming over all pairs, with more lengths than 1,024 and long ones."""
    rng = np.random.default_rng(3)
    lengths = np.unique(np.concatenate([rng.integers(1, 3000, 1500), rng.integers(3000, 2_000_000, 300)]))
    n = rng.integers(1, 1000, len(lengths))
    docs = np.concatenate([[0], np.cumsum(n)]).astype(float)
    best = lengths * docs[1:]
    for _ in range(4):
        before = np.concatenate([[0.0], best[:-1]])
        best = np.array([min(before[: j + 1] + lengths[j] * (docs[j + 1] - docs[: j + 1])) for j in range(len(lengths))])
    bounds = np.array(packing.optimal_boundaries(lengths, n, 5))
    assert len(bounds) == 5 and bounds[-1] == lengths[-1] and (bounds[np.searchsorted(bounds, lengths)] * n).sum() == best[-1]


def test_boundaries_are_optimal():
    rng = np.random.default_rng(1)
    for _ in range(20):
        lengths = np.unique(rng.integers(1, 60, 9))
        n = rng.integers(1, 30, len(lengths))
        cost = lambda cuts: sum(m * min(c for c in cuts if c >= x) for x, m in zip(lengths, n))
        best = min(cost([*c, lengths[-1]]) for k in range(3) for c in combinations(lengths[:-1], k))
        assert cost(packing.optimal_boundaries(lengths, n, 3)) == best


def test_batches(docs, no_docs):
    settings = packing.PackSettings(buckets=4, budget=500, slice_docs=20)
    rows = packing.pack(docs, word_count(F.col("text")), settings).collect()
    assert len(rows) == docs.count()
    batches = {}
    for r in rows:
        assert 0 <= r.padding == r.boundary - r.length
        batches.setdefault((r.bucket, r.slice, r.batch), []).append(r)
    for b in batches.values():
        assert len(b) * b[0].boundary <= 500 or len(b) == 1 or b[0].boundary == 0
        assert sorted(r.slot for r in b) == list(range(len(b)))
    assert packing.pack(no_docs, word_count(F.col("text"))).count() == 0


def test_billions_of_block_draws_are_permuted(spark):
    draws = 5_000_000_021
    near = spark.range(draws - 2000, draws).union(spark.range(2000)).select(mixing._permuted(F.col("id"), F.lit(draws), 17).alias("p"), "id").collect()
    assert {r.p for r in near} == {(r.id * mixing.PRIME + 17) % draws for r in near} and len({r.p for r in near}) == 4000
    multiple = spark.range(30).select(mixing._permuted(F.col("id"), F.lit(mixing.PRIME * 4), 17).alias("p")).collect()
    assert [r.p for r in multiple] == list(range(17, 47))


def test_rows_that_differ_in_a_map_only_are_rows_of_their_own(spark):
    rows = [(1, "a b", "s", {"k": 1}), (1, "a b", "s", {"k": 2}), (2, "c d", "s", {"k": 3, "j": 4})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra map<string,int>")
    got = mixing.mix_documents(docs).collect()
    assert sorted((r.doc_id, tuple(sorted(r.extra.items()))) for r in got) == [(1, (("k", 1),)), (1, (("k", 2),)), (2, (("j", 4), ("k", 3)))]

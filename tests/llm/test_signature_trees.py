import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plantlens.llm import sigtree
from plantlens.llm.components import components
from plantlens.llm.shingles import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows))


def near_copies(rng, n, changes):
    out = []
    for g in range(n):
        base = ["".join(rng.choice("abcdefghijklm") for _ in range(4)) for _ in range(rng.choice((7, 30, 90)))]
        for _ in range(rng.choice((1, 3, 12))):
            w = list(base)
            for _ in range(rng.randint(0, changes)):
                w[rng.randrange(len(w))] = rng.choice("xyz") * 5
            out.append(" ".join(w))
    return out


@pytest.mark.parametrize("node", [1024, 6])
def test_components_match_brute_force(spark, corpus, monkeypatch, node):
    monkeypatch.setattr(sigtree, "NODE", node)
    rng = random.Random(node)
    rows = [(r[0], r[1]) for r in corpus] + [(1000 + i, t) for i, t in enumerate(near_copies(rng, 30, 3))] + [(5000 + i, "released under the license of") for i in range(9)]
    rows += [(6000 + i, " ".join(f"common{k}" for k in range(12)) + f" own{i} tail{i}") for i in range(25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in sigtree.duplicate_classes(docs).collect())
    assert got == brute(rows)


def test_keep_one(docs, corpus, no_docs):
    kept = sigtree.keep_one(docs)
    assert kept.columns == docs.columns
    want = brute([(r[0], r[1]) for r in corpus])
    alone = sum(n for (d, size, c), n in want.items() if not size)
    groups = {c for (d, size, c), n in want.items() if size and c is not None}
    unknown = sum(n for (d, size, c), n in want.items() if size and c is None)
    assert kept.count() == alone + len(groups) + unknown
    assert sigtree.keep_one(no_docs).count() == 0 and sigtree.duplicate_classes(no_docs).count() == 0


def test_bounds_never_lose_a_link():
    rng = np.random.default_rng(5)
    base = np.sort(rng.integers(0, 1 << 60, 120).astype(np.uint64)).view(np.int64)
    sets = [np.unique(np.concatenate([rng.choice(base, 110, replace=False), rng.integers(0, 1 << 60, rng.integers(0, 12))])) for _ in range(90)]
    pairs = {(min(i, j), max(i, j)) for a, b in sigtree.SignatureTree(sets).pairs(85) for i, j in zip(a.tolist(), b.tolist())}
    links = {(i, j) for i in range(90) for j in range(i + 1, 90) if sigtree.linked(sets[i], sets[j], 85)}
    assert links <= pairs and links


def test_shingle_sets_of_odd_texts():
    offsets, hashed = shingle_sets(pa.array([None, "", " \n", "One two", "one TWO", "a b c d e", "a b c d a b c d"]), 4)
    n = np.diff(offsets).tolist()
    assert n == [0, 0, 0, 1, 1, 2, 4] and hashed[offsets[3]] == hashed[offsets[4]]


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(500 + i, 501 + i) for i in range(60)] + [(7, 7)]
    root = {}

    def find(a):
        root.setdefault(a, a)
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {a: find(a) for a, b in edges for a in (a, b) if any(x != y and a in (x, y) for x, y in edges)}


def test_shingles_frequent_in_one_slice_only_stay_out(spark, monkeypatch):
    sent, frequent = [], sigtree._frequent
    monkeypatch.setattr(sigtree, "_frequent", lambda found: sent.append([frequent(found).count(), found.where("uid is null").select("cid").distinct().count()]) or frequent(found))
    # 200 groups of 8 copies side by side, one slice for each 100 groups; each text has the same first words
    rows = [(8 * g + i, "one two three four " + " ".join(f"w{g}x{k}" for k in range(6))) for g in range(200) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    got = {r.doc_id: r.component_id for r in sigtree.duplicate_classes(docs).collect()}
    assert got == {d: d // 8 * 8 for d, _ in rows}
    assert sent[0][0] == 1 < 200 < sent[0][1]


def test_near_copies_fill_no_task(spark, monkeypatch):
    """Near copies share their least shingle; still no task holds more than two nodes."""
    monkeypatch.setattr(sigtree, "NODE", 20)
    tasks, join = [], sigtree._join_tasks
    monkeypatch.setattr(sigtree, "_join_tasks", lambda rows, percent: tasks.append(rows.groupBy("task").count().agg(F.coalesce(F.max("count"), F.lit(0)), F.count("*")).first()) or join(rows, percent))
    base = [f"word{k}" for k in range(200)]
    rows = [(i, " ".join([*base[:k], f"new{i}", *base[k + 1 :]])) for i in range(700) for k in [i % 190 + 5]] + [(9000, "long " + " ".join(f"l{k}" for k in range(100_000)))]
    got = {r.doc_id: r.component_id for r in sigtree.duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 0 if i < 9000 else 9000 for i, _ in rows}
    most, many = max(t[0] for t in tasks), sum(t[1] for t in tasks)
    assert most <= 80 and many < 400  # nodes are cut by a hash, so some are a little larger; pairs of nodes are few

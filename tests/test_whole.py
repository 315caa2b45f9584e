"""Queries over all rows, against brute force on small tables."""

import random
from collections import Counter

import pandas as pd
import pytest

from plantlens import catalog
from plantlens.operators import graph
from plantlens.plans import displays


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    folder, rng = tmp_path_factory.mktemp("whole"), random.Random(5)
    tables = {
        "customer": pd.DataFrame({"c_custkey": range(30)}),
        "orders": pd.DataFrame([(k, rng.randrange(25)) for k in range(60)], columns=["o_orderkey", "o_custkey"]),
        "lineitem": pd.DataFrame([(rng.randrange(40), rng.randrange(25), rng.choice([1.0, 50.0]), rng.choice([0.0, 0.05]), n, rng.randrange(9)) for n in range(45)], columns=["l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_orderkey", "l_linenumber"]),
        "benchmark": pd.DataFrame({"text": ["X 1ab x", "1"]}),
        "part": pd.DataFrame(
            [(k, rng.choice(["blue ring", "ring", "hot"]), rng.choice("AB"), rng.choice(["BIG", "TINY"]), rng.randrange(20, 31), 900.0 + 7 * k) for k in range(28)],
            columns=["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
        ),
        "documents": pd.DataFrame({"lang": ["de", "en", "en", "fr", "es"], "text": ["ab 1" * 40, "é9\t" * 30 + "🙂z", "", None, "x"]}),
    }
    for name, rows in tables.items():
        rows.to_parquet(folder / f"{name}.parquet")
    return str(folder), tables


def run(spark, name, data):
    return catalog.QUERIES[name](spark, data[0]).collect()


def reached(edges, roots):
    """Least number of steps from the roots to each node."""
    hops, front, n = dict.fromkeys(roots, 0), set(roots), 0
    while front:
        n += 1
        front = {b for a, b in edges if a in front and b not in hops}
        hops |= dict.fromkeys(front, n)
    return hops


def test_supply_graph(spark, data):
    lines = data[1]["lineitem"]
    edges = {(p, -1 - s) for p, s in zip(lines.l_partkey, lines.l_suppkey)}
    both = edges | {(b, a) for a, b in edges}
    nodes = {a for a, _ in both}
    got = run(spark, "components", data)
    assert len(got) == len(nodes) and {r.node: r.component for r in got} == {n: min(reached(both, [n])) for n in nodes}
    got = run(spark, "bfs_hops", data)
    want = reached(both, [b for _, b in edges if b > -4])
    assert len(got) == len(want) and {r.node: r.hops for r in got} == want


def test_orphans_dups(spark, data):
    nodes, parents = set(data[1]["customer"].c_custkey), data[1]["orders"].groupby("o_custkey").size()
    want = {("ORPHAN", n) for n in nodes - set(parents.index)} | {("SHARED", n) for n in parents.index if parents[n] > 1}
    assert {(r.issue, r.node) for r in run(spark, "orphans_dups", data)} == want


def test_cycle_nodes(spark, data):
    edges = set(zip(data[1]["orders"].o_custkey, data[1]["orders"].o_orderkey))
    nodes = {n for e in edges for n in e}
    after = {n: set(reached(edges, [b for a, b in edges if a == n])) for n in nodes}
    on = {n for n in nodes if n in after[n]}
    want = on | {n for c in on for n in after[c] if after[n] & on}
    assert want and {r.node for r in run(spark, "cycle_nodes", data)} == want


def test_iterations_end_where_nothing_changes(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(12)], "a long, b long")
    root = spark.createDataFrame([(0,)], "node long")
    assert {r.node: r.depth for r in graph.reachable(chain, root).collect()} == {i: i for i in range(13)}
    assert {r.node: r.hops for r in graph.bfs_hops(chain, root).collect()} == {i: i for i in range(13)}
    assert {r.node: r.depth for r in graph.reachable(chain, root, 3).collect()} == {i: i for i in range(4)}
    assert {r.node: r.layer for r in graph.longest_path_layers(chain).collect()} == {i: i for i in range(13)}
    assert graph.cycle_nodes(chain).count() == 0
    with pytest.raises(RuntimeError):
        graph.cycle_nodes(chain, max_rounds=3)
    with pytest.raises(RuntimeError):
        graph.longest_path_layers(chain, cap=5)
    with pytest.raises(RuntimeError):
        graph.longest_path_layers(chain.union(spark.createDataFrame([(12, 4)], "a long, b long")))


def test_flatten_has_no_depth_limit(spark):
    m = "struct<a:double,b:double,c:double,d:double,e:double,f:double>"
    one = (1.0, 0.0, 0.0, 1.0, 1.0, 0.0)
    roots = spark.createDataFrame([("f", 0, one)], f"path string, id int, m {m}")
    children = spark.createDataFrame([("f", i, i + 1, one) for i in range(11)], f"path string, id int, child int, cm {m}")
    assert {r.id: r.depth for r in displays.flatten(roots, children).collect()} == {i: i for i in range(12)}
    assert displays.flatten(roots, children, 8).count() == 9


def test_column_profile(spark, data):
    kind = lambda c: "letter" if c.isascii() and c.isalpha() else "digit" if c in "0123456789" else "space" if c in " \t\n" else "other"
    want = Counter((i, kind(c)) for t in data[1]["documents"].text if t for i, c in enumerate(t, 1))
    assert {(r.place, r["class"]): r.n for r in run(spark, "column_profile", data)} == want


def test_text_diff(spark, data):
    bag = lambda name: Counter(w for t in data[1][name].text if t is not None for w in t.lower().split(" "))
    want = bag("documents") & bag("benchmark")
    assert "1ab" in want and {r.token: r.n for r in run(spark, "text_diff", data)} == want


def test_address_resolve(spark, data):
    owners, lines = set(data[1]["part"].p_partkey), data[1]["lineitem"]

    def status(address):
        low = max((o for o in owners if o < address), default=-9)
        if address in owners:
            return "EXPLICIT", str(address)
        return ("DERIVED", f"{low}+{address - low}") if address - low <= 3 else ("INFERRED", f"fixed {address}") if address <= 29 else ("UNRESOLVED", None)

    want = {o: status(p + n) for o, p, n in zip(lines.l_orderkey, lines.l_partkey, lines.l_linenumber)}
    got = run(spark, "address_resolve", data)
    assert len(got) == len(lines) and {r.l_orderkey: (r.status, r.target) for r in got} == want


def test_nearest_label(spark, data):
    parts, want = list(data[1]["part"].itertuples()), {}
    for p in parts:
        near = [(round(abs(p.p_retailprice - q.p_retailprice) + 0.1 * abs(p.p_size - q.p_size), 6), q.p_partkey) for q in parts if q.p_partkey != p.p_partkey and q.p_type == p.p_type and abs(p.p_size - q.p_size) <= 5 and abs(p.p_retailprice - q.p_retailprice) <= 40]
        if near:
            want[p.p_partkey] = min(near)
    assert want and {r.p_partkey: (r.score, r.label) for r in run(spark, "nearest_label", data)} == want


def test_fuzzy_recovery(spark, data):
    parts = list(data[1]["part"].itertuples())
    others = [(q.p_brand, t) for q in parts if q.p_size > 25 for t in (f"{q.p_type.lower()} {q.p_name}", q.p_name)]
    text = {p.p_partkey: f"{p.p_name} {p.p_type}" for p in parts if p.p_size <= 25}
    brand = {p.p_partkey: p.p_brand for p in parts}
    want = {k: (t, any(b == brand[k] and (t in o or o in t) for b, o in others)) for k, t in text.items()}
    assert {r.p_partkey: (r.text, r.recovered) for r in run(spark, "fuzzy_recovery", data)} == want


def test_unique_anchor(spark, data):
    rows, want = {}, {}
    for k, c in zip(data[1]["orders"].o_orderkey, data[1]["orders"].o_custkey):
        rows.setdefault(c, []).append(k % 7 * 10 + 100)
    for c, ys in rows.items():
        fit = [a for a in {y + 20 * i for y in ys for i in range(4)} if all((a - y) % 20 == 0 and 0 <= a - y <= 60 for y in ys) and a - 60 >= 58 and a <= 162]
        if len(fit) == 1:
            want[c] = float(fit[0])
    assert want and {r.o_custkey: r.anchor for r in run(spark, "unique_anchor", data)} == want

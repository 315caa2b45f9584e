"""Findings of the fourth round: places meet by their order, not in pairs, and rows are moved once."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from plantlens.plans import loops, relational, topology

PART = "p_partkey long, p_type string, p_size int, p_retailprice double"


def joined(df):
    """The rows of df, and the largest number of rows that a join of its plan gives."""
    rows, found = df.collect(), [0]

    def visit(node):
        kind = node.getClass().getSimpleName()
        if "Join" in kind:
            found.append(node.metrics().get("numOutputRows").get().value())
        inner = node.executedPlan() if kind == "AdaptiveSparkPlanExec" else node.plan() if kind.endswith("QueryStageExec") else None
        below = node.children()
        for child in [inner] if inner else [below.apply(k) for k in range(below.size())]:
            visit(child)

    visit(df._jdf.queryExecution().executedPlan())
    return rows, max(found)


def test_blocks_of_a_column_meet_no_pairs(spark):
    """600 labels and 600 blocks in one window gave 244,956 pairs."""
    n = 600
    labels = spark.range(n).select(F.lit("s").alias("sheet"), F.col("id").alias("label_id"), (F.col("id") % 3 * 8.0 + 5).alias("x"), (F.col("id") * 0.1 + 12).alias("y"))
    blocks = spark.range(n).select(F.lit("s").alias("sheet"), F.col("id").alias("block"), (F.col("id") % 3 * 8.0).alias("bx"), (F.col("id") * 0.1).alias("by"), F.lit(10).alias("height"), F.col("id").alias("ord"))
    rows, most = joined(loops.label_blocks(labels, blocks))
    assert len(rows) == n and most <= 12 * n


def test_labels_take_their_blocks_as_by_brute_force(spark):
    """limits of the window that rounding sets off, blocks in one place, several heights, places that are nearly equal, nulls."""
    rng = random.Random(3)
    blocks = [(rng.choice("ab"), k, rng.choice([0.0, 8.0, 120.0, 336.0, -64.0]), rng.choice([900, 913, 940, 957, 1001, 1035]) * 0.3 + rng.choice([0, 0, 1e-13]), rng.choice([10, 12]), rng.randrange(9)) for k in range(60)]
    labels = [(rng.choice("ab"), k, rng.choice([5.0, 13.0, 125.0, 320.0, 328.0]), rng.choice([900, 913, 940, 957, 1035]) * 0.3 + rng.choice([0, 12, 45])) for k in range(60)]
    want = {}
    for sheet, label, x, y in labels:
        inside = [(y - by - h + 0.1 * (x - bx), o, b) for s, b, bx, by, h, o in blocks if s == sheet and -20 <= x - bx <= 320 and -10 <= y - by - h <= 70]
        if inside:
            want[sheet, label] = min(inside)[2]
    asked = spark.createDataFrame([*labels, ("a", 99, 5.0, None)], "sheet string, label_id long, x double, y double")
    got = loops.label_blocks(asked, spark.createDataFrame([*blocks, ("a", 99, 0.0, None, 10, 0)], "sheet string, block long, bx double, by double, height int, ord int"))
    assert want and {(r.sheet, r.label_id): r.block for r in got.collect()} == want


def test_nearest_labels_meet_no_pairs(spark):
    """600 parts of one type in one window gave 360,000 pairs."""
    n = 600
    parts = spark.range(n).select(F.col("id").alias("p_partkey"), F.lit("T").alias("p_type"), (F.col("id") % 3).cast("int").alias("p_size"), (900 + F.col("id") * 0.05).alias("p_retailprice"))
    rows, most = joined(relational._nearest(parts, parts))
    assert len(rows) == n and most <= 12 * n


def test_nearest_labels_of_repeated_numbers(spark):
    """a number in several places hid the others behind it; ties within six digits go by the label, whatever their places."""
    rng = random.Random(4)
    parts = [(rng.randrange(25), rng.choice("TU"), rng.choice([1, 2, 5, 7, 20]), rng.choice([900.0, 900.1, 901.3, 935.0, 940.1]) + rng.choice([0, 0, 1e-13, 4e-7])) for _ in range(70)]
    parts += [(30, "V", 1, 10.0), (30, "V", 2, 10.0), (30, "V", 1, 10.5), (31, "V", 3, 12.0), (32, "W", 1, 1.0), (32, "W", 2, 1.0), (None, "V", 1, 10.0), (33, "V", 1, float("nan")), (34, "V", None, 10.0)]
    want = {}
    for p, t, x, y in parts:
        if p is None or x is None:
            continue
        near = [(round(abs(y - ly) + 0.1 * abs(x - lx), 6), q) for q, u, lx, ly in parts if q is not None and lx is not None and q != p and u == t and abs(x - lx) <= 5 and abs(y - ly) <= 40]
        if near:
            want[p] = min([*near, *([want[p]] if p in want else [])])
    rows = spark.createDataFrame(parts, PART)
    assert want[30] == (1.7, 31) and {r.p_partkey: (r.score, r.label) for r in relational._nearest(rows, rows).collect()} == want


BOX = "x1 long, y1 long, x2 long, y2 long"


def drawing(spark, seed=6, sheets=3, n=40):
    """Rows and tables of wires, junctions, connectors and blocks over several cells, names that repeat and missing values among them."""
    rng = random.Random(seed)
    at = lambda: rng.choice([-70, -20, 0, 60, 64, 130, 300]) + rng.randrange(12)
    box = lambda: (lambda x, y: (x, y, x + rng.randrange(2, 90), y + rng.randrange(2, 20)))(at(), at())
    sheet = lambda: rng.choice([*range(sheets), None])
    wires = [(sheet(), rng.choice([k, k, 7]), [(at(), at()) for _ in range(rng.randrange(1, 4))]) for k in range(n)] + [(0, None, [(0, 0), (60, 0)]), (0, 99, [(None, 5), (8, 5)])]
    junctions = [(sheet(), f"j{k}", at(), at()) for k in range(n)]
    connectors = [(sheet(), f"c{k}", *rng.choice([(None, None), (at(), at())]), *box()) for k in range(n)]
    blocks = [(sheet(), f"b{k}", *box()) for k in range(n)]
    schemas = ("sheet long, wire long, points array<struct<x: long, y: long>>", "sheet long, ref string, x long, y long", f"sheet long, ref string, px long, py long, {BOX}", f"sheet long, ref string, {BOX}")
    rows = (wires, junctions, connectors, blocks)
    return rows, [spark.createDataFrame(r, s) for r, s in zip(rows, schemas)]


def test_wire_ends_as_by_brute_force(spark):
    """every tier, ends in several places and cells, missing keys and places; other columns of the ends stay."""
    (wires, junctions, connectors, blocks), tables = drawing(spark)
    w, j, c, b = tables
    ends = topology.wire_ends(w).withColumn("more", F.concat_ws(":", "wire", "x"))
    found = topology.classify_ends(ends, j, c, b, w)
    length = lambda dx, dy: math.sqrt(dx * dx + dy * dy)
    to_box = lambda x, y, x1, y1, x2, y2: length(max(x1 - x, 0, x - x2), max(y1 - y, 0, y - y2))
    whole = lambda p: None not in p
    parts = [(s, n, *p, *q) for s, n, points in wires for p, q in zip(points, points[1:]) if n is not None and whole(p + q)]

    def segment(x, y, x1, y1, x2, y2):
        dx, dy = x2 - x1, y2 - y1
        square = dx * dx + dy * dy
        t = min(max(((x - x1) * dx + (y - y1) * dy) / square, 0.0), 1.0) if square else 0.0
        near_x = x1 if dx == 0 else max(min(x, max(x1, x2)), min(x1, x2)) if dy == 0 else x1 + t * dx
        near_y = y1 if dy == 0 else max(min(y, max(y1, y2)), min(y1, y2)) if dx == 0 else y1 + t * dy
        return length(x - near_x, y - near_y)

    def offers(s, n, x, y):
        yield from [(1, d, 0.0, r, "junction", "EXPLICIT") for t, r, px, py in junctions if t == s and (d := length(x - px, y - py)) <= 3]
        yield from [(2, d, 0.0, r, "connector", "EXPLICIT") for t, r, px, py, *_ in connectors if t == s and px is not None and (d := length(x - px, y - py)) <= 3]
        yield from [(3, 0.0, float((p[2] - p[0]) * (p[3] - p[1])), r, "pin", "EXPLICIT") for t, r, *p in blocks if t == s and to_box(x, y, *p) == 0]
        yield from [(4, 0.0, 0.0, r, "connector", "DERIVED") for t, r, _, _, *p in connectors if t == s and to_box(x, y, *p) == 0]
        yield from [(5, d, 0.0, str(m), "wire", "DERIVED") for t, m, *p in parts if t == s and m != n and (d := segment(x, y, *p)) <= 1]
        yield from [(6, d, 0.0, r, "pin", "DERIVED") for t, r, *p in blocks if t == s and (d := to_box(x, y, *p)) <= 15]

    asked = [(s, n, end, *p) for s, n, points in wires if len(points) >= 2 for end, p in (("from", points[0]), ("to", points[-1]))]
    best = {}
    for s, n, end, x, y in asked:
        if s is not None and n is not None and x is not None:
            best[s, n, end] = min([*offers(s, n, x, y), *([best[s, n, end]] if (s, n, end) in best else [])], default=None) or best.get((s, n, end))
    best = {k: v for k, v in best.items() if v}
    want = Counter((s, n, end, x, y, *((b[4], b[3], b[5], b[1]) if (b := best.get((s, n, end))) else ("dangling", None, "UNRESOLVED", 0.0))) for s, n, end, x, y in asked)
    assert found.columns == ["sheet", "wire", "end", "x", "y", "more", "kind", "ref", "status", "distance"] and found.schema["wire"].dataType == w.schema["wire"].dataType
    got = found.collect()
    assert {r.kind for r in got} == {"junction", "connector", "pin", "wire", "dangling"} and all(r.more == ":".join(str(v) for v in (r.wire, r.x) if v is not None) for r in got)
    assert Counter((r.sheet, r.wire, r.end, r.x, r.y, r.kind, r.ref, r.status, r.distance) for r in got) == want


def test_wire_ends_are_moved_once(spark, monkeypatch):
    """ends and what they may stand on were moved for every tier; sizes of tasks don't change the result."""
    _, (w, j, c, b) = drawing(spark)
    found = lambda: topology.classify_ends(topology.wire_ends(w), j, c, b, w)
    one = found()
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and "Join" not in plan
    monkeypatch.setattr(topology, "TASK_ROWS", 16)
    assert Counter(found().collect()) == Counter(one.collect())

"""Graphs with cycles, depths, pairs, scenes, positions, constraints, symbols and the engineering model."""

import random
import re
import struct

import pytest
from pyspark.sql import functions as F

from plantlens.functions import symbols
from plantlens.operators import graph, ordering
from plantlens.plans import adapter, constraints, displays, positions, scene


def edges_of(spark, pairs):
    return spark.createDataFrame(sorted(pairs), "a int, b int")


def reaches(pairs):
    out = {}
    for start in {x for p in pairs for x in p}:
        seen, front = set(), [start]
        while front:
            for a, b in pairs:
                if a == front[-1] and b not in seen and (seen.add(b) or True):
                    front.insert(0, b)
            front.pop()
        out[start] = seen
    return out


def test_nodes_between_cycles_are_on_none(spark):
    pairs = {(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 6), (6, 5), (7, 7), (0, 1), (6, 9)}
    got = {r.node: r.component for r in graph.strong_components(edges_of(spark, pairs)).collect()}
    assert got == {1: 1, 2: 1, 5: 5, 6: 5, 7: 7}
    assert {r.node for r in graph.cycle_nodes(edges_of(spark, pairs)).collect()} == set(got)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_and_feedback_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    pairs = {(rng.randrange(30), rng.randrange(30)) for _ in range(45)}
    far = reaches(pairs)
    want = {n: min(m for m in far[n] if n in far[m]) for n in far if n in far[n]}
    assert {r.node: r.component for r in graph.strong_components(edges_of(spark, pairs)).collect()} == want
    layers, against = graph.layers_with_feedback(edges_of(spark, pairs))
    against = {(r.a, r.b) for r in against.collect()}
    layer = {r.node: r.layer for r in layers.collect()}
    assert all(a in want and want[a] == want.get(b) for a, b in against) and set(layer) == {x for p in pairs for x in p}
    for a, b in pairs - against:
        assert layer[b] >= layer[a] + 1  # so nothing else goes back
    assert all(layer[b] == max((layer[a] + 1 for a, x in pairs - against if x == b), default=0) for b in layer)


def test_depths_by_doubling(spark):
    chain = spark.range(100_000).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    deepest = graph.depths(chain).agg(F.max("depth"), F.min("depth"), F.count_if(F.col("root") == 0), F.count_if(F.col("node") == F.col("depth"))).first()
    assert tuple(deepest) == (99_999, 0, 100_000, 100_000)
    odd = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (4, None), (5, 4), (6, 99)], "node int, parent int")
    assert {r.node: (r.depth, r.root) for r in graph.depths(odd).collect()} == {1: (None, None), 2: (None, None), 3: (None, None), 4: (0, 4), 5: (1, 4), 6: (0, 6)}


@pytest.mark.parametrize("chunk", [3, 64])
def test_pairs_follow_the_sequential_rule(spark, chunk):
    rng, rows, want = random.Random(3), [], {}
    for book in range(6):
        like = [rng.choice([None, 0.1, 0.3, 0.5, 0.7, 0.9]) for _ in range(rng.randrange(1, 60))]
        rows += [(book, k, x) for k, x in enumerate(like)]
        k = 0
        while k < len(like):
            after = like[k + 1] if k + 1 < len(like) and like[k + 1] is not None else -1
            pair = like[k] is not None and like[k] > 0.2 and like[k] > after
            if pair:
                want[book, k] = k + 1
            k += 1 + pair
    got = ordering.pair_neighbours(spark.createDataFrame(rows, "book int, page long, likeness double"), ["book"], "page", "likeness", 0.2, chunk).collect()
    assert len(got) == len(rows) and {(r.book, r.page): r.pair for r in got if r.pair is not None} == want


def relations(spark, blocks=40):
    t = lambda schema, rows: spark.createDataFrame(rows, schema)
    b = [(("hot" if k % 4 else f"s{k}"), k) for k in range(blocks)]
    return {
        "blocks": t("file string, block long, name string, fc long, x int, y int", [(f, k, "PID", 18, 0, 0) for f, k in b]), "records": t("file string, block long, fc long", [(f, k, 19) for f, k in b if k % 2]),
        "terminals": t("file string, block long, side string, label string, pin string, association string, reason string, x int, y int", [(f, k, s, n, None, a, None, 0, 0) for f, k in b for s, n, a in (("input", "S1", "EXPLICIT"), ("output", "N", "CONFLICT"))]),
        "specs": t("file string, block long, number int, label string, value long, status string, target_status string", [(f, k, n, f"S{n}", 7, "EXTRACTED" if n == 1 else "UNRESOLVED_LAYOUT", None) for f, k in b for n in (1, 2)]),
        "outputs": t("file string, block long, offset int, label string", [(f, k, n, "N" if n == 0 else f"N+{n}") for f, k in b for n in (0, 1)]), "wires": t("file string, id string", [("hot", f"w{k}") for k in range(50)]),
        "connections": t("file string, id string, wire string, from_block long, to_block long, status string", [("hot", "c1", "w1", 1, None, "UNRESOLVED")]), "references": t("file string, id string, target string, status string", [("lone", "r1", "x", "AMBIGUOUS")]),
        "channels": t("file string, id string, text string", []), "unknown": t("file string, id string, kind string", [("hot", "u1", "K")]),
    }


@pytest.mark.parametrize("part_rows", [1 << 16, 60])
def test_scenes_keep_all_rows_and_links(spark, part_rows):
    r = relations(spark)
    scenes = scene.assemble(r, part_rows)
    rows = scenes.collect()
    parts = {f: [x for x in rows if x.file == f] for f in {x.file for x in rows}}
    assert (len(parts["hot"]) == 1) == (part_rows > 1000)
    assert sum(sum(x.counts.asDict().values()) for x in rows) == sum(df.count() for df in r.values())
    for x in rows:
        for b in x.blocks:
            assert b.type == ("function_block" if b.address % 2 else "symbol") and b.fc == (19 if b.address % 2 else 18) and len(b.terminals) == len(b.specs) == len(b.sub_blocks) == 2
            assert [s.terminal is not None for s in b.specs] == [True, False] and [(s.address, s.terminal is not None) for s in b.sub_blocks] == [(b.address, True), (b.address + 1, False)]
    issues = [(u.kind, u.id) for x in rows for u in x.unresolved]
    assert len(issues) == 40 + 40 + 3 and {("connection", "hot:c1"), ("reference", "lone:r1"), ("unknown_record", "hot:u1")} <= set(issues)


def test_scenes_are_partitioned_once(spark):
    scenes = scene.assemble(relations(spark, 8))
    plan = scenes._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 1
    below = plan[: plan.index("REPARTITION_BY_COL")]
    assert "ENSURE_REQUIREMENTS" not in below  # both folds use that one exchange


def test_positions(spark):
    at = lambda x, y: (2 * x - y + 3, x + y - 4)
    spots = [(0, 0), (100, 0), (0, 50), (70, 30)]
    texts = [("s", f"t{k}", float(x), float(y)) for k, (x, y) in enumerate(spots)] + [("bad", f"t{k}", float(x), float(y)) for k, (x, y) in enumerate(spots)] + [("few", "t0", 0.0, 0.0), ("line", "a", 0.0, 0.0), ("line", "b", 1.0, 1.0), ("line", "c", 2.0, 2.0), ("s", "twice", 1.0, 1.0), ("s", "twice", 2.0, 2.0)]
    runs = [(s, f" {t} ", float(at(x, y)[0] + 30 * (s == "bad" and t == "t3")), float(at(x, y)[1])) for s, t, x, y in texts]
    frame = lambda rows: spark.createDataFrame(rows, "sheet string, text string, x double, y double")
    fits = positions.sheet_fits(frame(texts), frame(runs))
    got = {r.sheet: r for r in fits.collect()}
    assert {s: (r.anchors, r.usable) for s, r in got.items()} == {"s": (4, True), "bad": (4, False), "few": (1, False), "line": (3, False)}
    assert [round(got["s"][k], 9) for k in ("ax", "bx", "cx", "ay", "by", "cy")] == [2, -1, 3, 1, 1, -4]

    def token(text, x, y, off=0.0):
        X, Y = at(x, y)
        return "s", text, float(X - 10 + off), float(Y), float(X + off), float(Y)

    tokens = [token("S1", 10, 10), token("S9", 20, 20), token("S3", 30, 30, 50.0), token("word9", 40, 40), token("7", 50, 50, 10.0)]
    notes = [("s", 1, "s_label", "S1", 10.0, 10.0), ("s", 2, "s_label", "S2", 20.0, 20.0), ("s", 3, "s_label", "S3", 30.0, 30.0), ("s", 4, "s_label", "S4", 40.0, 40.0), ("s", 5, "sub_block_number", "7", 50.0, 50.0), ("bad", 6, "s_label", "S1", 0.0, 0.0)]
    verdicts = positions.position_verdicts(spark.createDataFrame(notes, "sheet string, id int, kind string, text string, x double, y double"), spark.createDataFrame(tokens, "sheet string, text string, x1 double, y1 double, x2 double, y2 double"), fits)
    assert {r.id: (r.verdict, r.found) for r in verdicts.collect()} == {1: ("CONFIRMED", None), 2: ("WRONG_TEXT", "S9"), 3: ("MISPLACED", None), 4: ("NOT_IN_PLOT", None), 5: ("CONFIRMED", None)}


def test_values_are_decoded_from_their_own_bytes(spark):
    numbers = [0.0, -0.0, 1.5, -2.75, 3.4e38, 1e-45, 1.17549435e-38, float("inf"), 0.1]
    rows = [(k, struct.pack("<f", x)) for k, x in enumerate(numbers)]
    got = {r.k: r.v for r in spark.createDataFrame(rows, "k int, b binary").select("k", constraints.real(F.col("b")).alias("v")).collect()}
    assert [got[k] for k in range(len(numbers))] == [struct.unpack("<f", b)[0] for _, b in rows]
    manual = spark.createDataFrame([(5, 1, "I"), (5, 2, "R"), (5, 3, "B")], "fc int, number int, type string")
    payload = struct.pack("<HfH", 700, 1.25, 3)
    blocks = lambda p: spark.createDataFrame([("s", 1, 5, p), ("s", 2, 6, b""), ("s", 3, 5, b"short")], "sheet string, block int, fc int, payload binary")
    true = [("s", 1, 1, "700", "bc02", 700.0, "EXTRACTED"), ("s", 1, 2, "1.25", struct.pack("<f", 1.25).hex(), 1.25, "EXTRACTED"), ("s", 1, 3, "3", "0300", 3.0, "EXTRACTED")]
    schema = "sheet string, block int, number int, raw_text string, raw_hex string, value double, status string"
    invented = lambda rows, p=payload: {(r.ref, r.reason) for r in constraints.invented_values(spark.createDataFrame(rows, schema), blocks(p), manual).collect()}
    assert invented(true) == set()
    assert invented(true, bytes([payload[0] ^ 1]) + payload[1:]) == {("s:1:1", "DIFFERS_FROM_PAYLOAD")}  # one altered byte
    faults = [("s", 1, 1, None, None, 4.0, "UNRESOLVED_LAYOUT"), ("s", 1, 2, None, None, None, "EXTRACTED"), ("s", 1, 9, "1", "01", 1.0, "EXTRACTED"), ("s", 2, 1, "1", "01", 1.0, "EXTRACTED"), ("s", 3, 1, "1", "0100", 1.0, "EXTRACTED"), ("s", 1, 3, None, None, None, "UNRESOLVED_LAYOUT")]
    assert invented(faults) == {("s:1:1", "VALUE_WITHOUT_TEXT"), ("s:1:2", "EXTRACTED_WITHOUT_VALUE"), ("s:1:9", "NOT_IN_PAYLOAD"), ("s:2:1", "NO_SCHEMA"), ("s:3:1", "NOT_IN_PAYLOAD")}


def test_every_constraint_finds_its_failure(spark):
    t = lambda schema, rows: spark.createDataFrame(rows, schema)
    fields = ["S1", "I", "0", "r", "t", "d"]
    spec = lambda block, number=1, label="S1", at=0, target=None, fc=None, status=None: ("s", block, number, label, *fields[1:], "1", "0100", 1.0, "EXTRACTED", at, target, fc, status)
    tables = {
        "trailers": t("sheet string, entries long", [("s", 9), ("other", 0)]), "runs": t("run int, digest string", [(1, "a"), (2, "b")]), "reported": t("fc int", [(78,)]),
        "blocks": t("sheet string, block int, fc int, payload binary, layout_status string, drawn boolean, sources int", [("s", 1, 5, b"\1\0", "DECODED", True, 1), ("s", 2, 5, b"\1", "OPEN", True, 0), ("s", 3, 77, b"", None, False, 0), ("s", 4, 78, b"", None, False, 0), ("s", 5, 5, b"\1\0", "DECODED", True, 1), ("s", 5, 5, b"\1\0", "DECODED", True, 1)]),
        "manual": t("fc int, number int, label string, type string, default string, range string, tune string, description string", [(5, 1, *fields)]),
        "specs": t("sheet string, block int, number int, label string, type string, default string, range string, tune string, description string, raw_text string, raw_hex string, value double, status string, byte_offset int, target_block int, target_fc int, target_status string", [
            spec(1, target=2, fc=6, status="RESOLVED_BLOCK"), spec(1, 2, at=None, target=5, status="WIRED_INPUT"), spec(2, label="X"), spec(2, label="X")]),
        "connections": t("id int, status string, source_block int, target_block int, sources int", [(1, "EXPLICIT", 1, None, 1), (2, "UNRESOLVED", None, None, 1), (3, "EXPLICIT", 1, 2, 0)]),
    }
    got = {}
    for r in constraints.failures(tables).collect():
        got.setdefault(r.rule, set()).add(r.ref)
    assert got == {
        "trailer_coverage": {"s"}, "unique_blocks": {"s:5"}, "sources_named": {"s:2"}, "unique_specs": {"s:2:1"}, "offsets_named": {"s:1:2"}, "layout_closure": {"s:2"}, "unknown_codes_reported": {"s:3"},
        "no_invented_values": {"s:1:2", "s:2:1"}, "manual_match": {"s:1:2", "s:2:1"}, "spec_count": {"s:1", "s:2", "s:5"}, "address_targets": {"s:1:1", "s:1:2"}, "connections_traceable": {"1", "3"}, "determinism": {"digests differ"},
    }


def test_symbols(spark):
    names = [" iref ", "F(x)", None, "", "and2", "RDI1A", "TITLE", "BOX1", "SEQXYZ", "AI7FLD", "H/L", "T-AN", "P=0", "nothing"]
    n = F.col("n")
    got = {r.n: tuple(r)[1:] for r in spark.createDataFrame([(x,) for x in names], "n string").select("n", symbols.symbol_role(n), symbols.function_code(n), symbols.symbol_family(n), symbols.block_type(n)).collect()}
    assert got == {
        " iref ": ("input-ref", None, "connector-in", "LogicBlock"), "F(x)": ("generic", None, "generic", "LogicBlock"), None: ("generic", None, "generic", "LogicBlock"), "": ("generic", None, "generic", "LogicBlock"),
        "and2": ("logic", 37, "gate-and", "LogicBlock"), "RDI1A": ("io-module", None, "hardware", "LogicBlock"), "TITLE": ("border", None, "frame", "LogicBlock"), "BOX1": ("frame", None, "frame", "LogicBlock"),
        "SEQXYZ": ("generic", None, "sequence", "SequenceBlock"), "AI7FLD": ("io-module", None, "hardware", "IOMarker"), "H/L": ("logic", 12, "alarm-compare", "LogicBlock"), "T-AN": ("logic", 9, "transfer", "TimingBlock"),
        "P=0": ("logic", None, "generic", "TimingBlock"), "nothing": ("generic", None, "generic", "LogicBlock"),
    }


def test_engineering_blocks(spark):
    t = lambda schema, rows: spark.createDataFrame(rows, schema)
    got = adapter.model_blocks(
        t("sheet string, id int, name string, fc int, number int, x1 int, y1 int, x2 int, y2 int, library boolean", [("s", 1, "PID", 18, 100, 5, 6, 5, 20, True), ("s", 2, "SEQ", None, None, 0, 0, 3, 3, False)]),
        t("sheet string, block int, pin string, direction string", [("s", 1, "R1", "output"), ("s", 1, "L2", "input"), ("s", 1, "L1", "input"), ("s", 1, "X", None)]),
        t("sheet string, block int, key string, value string", [("s", 1, "TO", "5"), ("s", 1, "TO", "7"), ("s", 1, "A", "1")]), t("sheet string, id string, kind string, x int, y int", [("s", "j1", "connected", 10, 10), ("s", "j2", "crossing", 1, 1)]),
    ).collect()
    got = {r.id: r for r in got}
    assert set(got) == {"1", "2", "j1"} and got["j1"].type == "Junction" and (got["j1"].x, got["j1"].width) == (6, 8)
    assert (got["1"].inputs, got["1"].outputs, got["1"].ports, got["1"].parameters, got["1"].width, got["1"].glyph) == (["L1", "L2"], ["R1"], 4, {"A": "1", "TO": "7"}, 1, "AUTHENTIC")
    assert (got["2"].type, got["2"].parameters, got["2"].inputs, got["2"].glyph) == ("SequenceBlock", {}, [], "FALLBACK")


def test_audit_times_and_discrepancies(spark):
    row = displays.audited(spark.range(2)).collect()
    assert row[0].created_at == row[1].created_at and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}Z", row[0].created_at)
    templates = spark.createDataFrame([("a", "PUMP", "EXTERNAL_UNRESOLVED", 3), ("a", "FAN", "EXTERNAL_UNRESOLVED", 1), ("a", "BOX", "EMBEDDED", 9)], "path string, name string, status string, instances int")
    objects = spark.createDataFrame([("a", k, 0.01 * k, k) for k in range(60)] + [("b", 1, 0.9, 5)], "path string, id int, recall double, pixels int")
    got = displays.discrepancies(templates, spark.createDataFrame([("a", "FAN")], "path string, name string"), objects).collect()
    assert {(r.subject, r.instances, r.resolved) for r in got if r.kind == "TEMPLATE_OUTSIDE"} == {("PUMP", 3, False), ("FAN", 1, True)}
    assert [(r.subject, r.percent) for r in sorted((r for r in got if r.kind == "LOW_RECALL"), key=lambda r: r.percent)] == [(str(k), k) for k in range(15)]


def test_long_rings_settle_in_few_rounds(spark):
    """A ring of 90 nodes with a tail, and one hung behind it: rounds follow the digits of the length."""
    mixed = lambda i: i * 37 % 90
    ring = [(mixed(i), mixed((i + 1) % 90)) for i in range(90)] + [(5, 200), (200, 201), (201, 300), (300, 301), (301, 300)]
    got = {r.node: r.component for r in graph.strong_components(edges_of(spark, ring), max_rounds=16).collect()}
    assert got == {i: 0 for i in range(90)} | {300: 300, 301: 300}

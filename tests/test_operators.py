import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from plantlens.functions import evidence, numbers, tags
from plantlens.operators import aggregates, graph, joins, ordering
from plantlens.plans import loops, specs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "raw, want",
    [("DI1-1A/322AUX", ("DI", "1", "1A", "322AUX")), ("ai12", ("AI", "12", None, None)), ("XX1", (None, None, None, None)), ("AO/x/y", ("AO", None, None, "x/y"))],
)
def test_io_tags(spark, raw, want):
    r = one(spark, tags.parse_io_tag(F.lit(raw)))
    assert (r.io_type, r.channel, r.slave, r.device_tag) == want


def test_names_and_addresses(spark):
    assert one(spark, tags.base_name(F.lit("D:\\a\\b\\3070500A.cad"))) == "3070500A"
    assert one(spark, tags.canonical_loop_tag(F.lit("310tic-a0012_PV"))) == "310TIC-A012"
    assert one(spark, tags.canonical_loop_tag(F.lit("310TIC-00123.1"))) is None and one(spark, tags.canonical_loop_tag(F.lit("310TIC-0123"))) == "310TIC-123"
    assert one(spark, tags.canonical_device(F.lit(" 131XS-M0102Brf "))) == "131XS-M102B"
    assert one(spark, tags.device_parts(F.lit("131XS-M0102Brf"))).asDict() == {"area": "131", "letters": "XS", "number": "M102B", "base": "M102"} and one(spark, tags.canonical_device(F.lit("131xs-1"))) is None
    assert one(spark, tags.parse_reference(F.lit("BA00-14.26"))).asDict() == {"prefix": "BA", "sheet": "00", "row": "14", "column": "26"}
    assert one(spark, tags.parse_reference(F.lit("nope"))).prefix is None
    assert one(spark, tags.is_local_block_address(F.lit("Block address of input"))) is True and one(spark, tags.is_local_block_address(F.lit("Block address of module input"))) is False
    assert one(spark, tags.output_address(F.lit("120+3"))) == 123 and one(spark, tags.output_address(F.lit("x"))) is None
    assert one(spark, tags.expand_keys(F.lit("A$N$B"), F.create_map(F.lit("N"), F.lit("7")))) == "A7B" and one(spark, tags.expand_keys(F.lit("A$M$B"), F.create_map(F.lit("N"), F.lit("7")))) is None
    assert one(spark, tags.instance_parameters(F.lit('A "1" B "2" A "3"'))) == {"A": "3", "B": "2"}
    assert one(spark, tags.differs_from_default(F.lit("1.0"), F.lit("1"))) is False and one(spark, tags.differs_from_default(F.lit("On"), F.lit("OFF"))) is True
    assert one(spark, tags.wrap_text(F.lit("one two three"), 8)) == ["one two", "three"]
    assert one(spark, tags.io_bucket(F.lit("zzz"), F.lit("ao5"))) == "AO"


def test_evidence(spark):
    assert one(spark, evidence.weakest(F.lit("EXPLICIT"), F.lit("INFERRED"))) == "INFERRED"
    assert [one(spark, evidence.status_of(F.lit(n))) for n in (0, 1, 5)] == ["UNRESOLVED", "RESOLVED", "AMBIGUOUS"]


def test_numbers(spark):
    rows = [("0.1", "0.25"), ("1e3", "2"), ("x", "1"), (None, "1"), ("99999999999999999999999999999.1", "0.01")]
    got = [r.s for r in spark.createDataFrame(rows, "a string, b string").select(numbers.add_decimal_text("a", "b").alias("s")).collect()]
    assert got == ["0.35", "1002", None, None, str(Decimal("99999999999999999999999999999.11"))]
    assert [numbers.c_format(v) for v in (1.5, 1e-7, 1e20, float("nan"), float("-inf"), -0.0, 100000.0, 1234567.0)] == ["1.5", "1e-007", "1e+020", "nan", "-inf", "-0", "100000", "1.23457e+006"]
    assert numbers.decode_payload(["I", "R"], b"\1\0\0\0\0\0") == [1, 0.0] and numbers.decode_payload(["I"], b"\1") is None
    d = one(spark, numbers.segment_distance(*[F.lit(float(v)) for v in (1, 1, 0, 0, 2, 0)]))
    assert (d.distance, d.interior) == (1.0, True)
    assert one(spark, numbers.upper_median(F.array(*[F.lit(v) for v in (4.0, 1.0, 3.0, 2.0)]), 0.6)) == 3.0 and one(spark, numbers.upper_median(F.array().cast("array<double>"), 0.6)) == 0.6
    assert one(spark, F.size(numbers.pairs_of(F.array(F.lit(1), F.lit(2), F.lit(3))))) == 2


def test_ordering(spark):
    rows = [(1, 10, "a"), (1, 11, "a"), (1, 20, "b"), (1, 21, "a"), (2, 5, None)]
    df = spark.createDataFrame(rows, "k int, at int, v string").repartition(3)
    assert {(r.v, r.first_at, r.last_at, r.n) for r in ordering.merge_runs(df, "v", "at", ["k"], ["at"]).collect()} == {("a", 10, 11, 2), ("b", 20, 20, 1), ("a", 21, 21, 1), (None, 5, 5, 1)}
    assert sorted(r.g for r in ordering.gap_groups(df, F.col("at"), F.lit(5), "g", ["k"], ["at"]).collect()) == [1, 1, 1, 2, 2]
    assert {r.at for r in ordering.dedupe_first(df, ["k"], ["at"]).collect()} == {10, 5}
    tie = spark.createDataFrame([(1, 5, 0), (1, 5, 1), (2, 7, 0), (2, 7, 0)], "k int, s int, t int")
    assert [(r.k, r.t) for r in ordering.unique_best(tie, ["k"], "s", ["t"]).collect()] == [(1, 0)]
    assert ordering.unique_best(tie, ["k"], "s").count() == 0


def test_asof_and_ranges(spark):
    rng = random.Random(1)
    left = [(i, rng.randrange(3), rng.randrange(50)) for i in range(60)]
    right = [(rng.randrange(3), rng.randrange(50), i) for i in range(25)]
    L, R = spark.createDataFrame(left, "id int, k int, t int"), spark.createDataFrame(right, "k int, t int, v int")
    for strict in (False, True):
        got = {r.id: r.v for r in joins.asof_backward(L, R, ["k"], "t", ["v"], strict).collect()}
        for i, k, t in left:
            want = max(((rt, v) for rk, rt, v in right if rk == k and (rt < t or not strict and rt == t)), default=(None, None))
            assert got[i] == want[1]
    A = spark.createDataFrame([(i, 0, a, a + rng.randrange(1, 30)) for i, a in enumerate(rng.sample(range(200), 40))], "id int, k int, a int, b int")
    B = A.select("k", *[F.col(c).alias(f"right_{c}") for c in ("id", "a", "b")])
    got = {(r.id, r.right_id) for r in joins.overlaps(A, B, ["k"], ("a", "b"), 10.0).collect()}
    rows = A.collect()
    assert got == {(x.id, y.id) for x in rows for y in rows if max(x.a, y.a) < min(x.b, y.b)}
    near = joins.near(A, A.select("k", F.col("id").alias("right_id"), F.col("a").alias("right_a")), ["k"], "a", 7.0).collect()
    assert len(near) == len({(r.id, r.right_id) for r in near}) == sum(abs(x.a - y.a) <= 7 for x in rows for y in rows)


def test_graphs(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (7, 8)], "a long, b long")
    assert {r.node: r.component for r in graph.components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7}
    assert {r.node for r in graph.cycle_nodes(e).collect()} == {1, 2, 3}
    assert {r.node: r.hops for r in graph.bfs_hops(e, spark.createDataFrame([(5,)], "node long"), 2).collect()} == {5: 0, 4: 1, 3: 2}
    dag = spark.createDataFrame([(1, 2), (2, 3), (1, 3)], "a long, b long")
    assert {r.node: r.layer for r in graph.longest_path_layers(dag).collect()} == {1: 0, 2: 1, 3: 2}


def test_digest_ignores_order_and_sees_changes(spark):
    df = spark.range(100).select("id", (F.col("id") % 7).alias("v"))
    value = lambda d: aggregates.digest(d, [F.col("id"), F.col("v")]).first().digest
    assert value(df) == value(df.orderBy(F.desc("id")).repartition(5)) != value(df.withColumn("v", F.when(F.col("id") == 5, 99).otherwise(F.col("v"))))


def test_loop_tags(spark):
    devices = spark.createDataFrame([("310TT-012", "AI", ["S1"]), ("310PSH-007", "DI", ["S2"]), ("999X", "DI", ["S9"])], "device string, io_type string, sheets array<string>")
    labels = spark.createDataFrame([("310TIC-012", 2, "S1"), ("310PI-007", 9, "S2"), ("310PSH-007", 9, "S2")], "label string, node int, sheet string")
    nodes, edges = spark.createDataFrame([("310TT-012", 1)], "device string, node int"), spark.createDataFrame([(1, 2)], "a int, b int")
    c = loops.loop_candidates(devices, edges, nodes, labels)
    assert {(r.device, r.label, r.via, r.hops) for r in c.collect()} == {("310TT-012", "310TIC-012", 0, 1), ("310PSH-007", "310PI-007", 1, 6), ("310PSH-007", "310PSH-007", 1, 6)}
    got = {r.device: (r.loop_tag, r.via) for r in loops.choose_loop_tags(c, devices, labels).collect()}
    assert got == {"310TT-012": ("310TIC-012", "wiring"), "310PSH-007": ("310PSH-007", "same-sheet")}


def test_loop_list_is_independent_of_order(spark):
    rows = [("A", "AI", "t1", "L1", "d"), ("B", "AO", "v1", "L1", "d"), ("C", "DI", "s1", "L2", None), ("D", "DI", "s2", "L2", "e"), ("E", "DO", "y", None, None)]
    schema = "point string, io_type string, device_tag string, loop_tag string, description string"
    one_ = {r["loop"]: (r.status, r.input, r.output) for r in loops.loop_list(spark.createDataFrame(rows, schema)).collect()}
    two = {r["loop"]: (r.status, r.input, r.output) for r in loops.loop_list(spark.createDataFrame(rows[::-1], schema).repartition(3)).collect()}
    assert one_ == two == {"loop:L1": ("MAPPED", "t1", "v1"), "loop:L2": ("AMBIGUOUS", None, None), "io:E": ("UNRESOLVED", None, "y")}


def test_ranges_and_addresses(spark):
    rows = [("p", "AI", "M", "02", "7"), ("q", "AO", "M", "2", "1"), ("r", "AI", "M", "03", "1"), ("w", "AI", "M", "02", "6"), ("x", "AI", "M", "02", "1"), ("y", "AI", "M", "02", None), ("z", "AI", "M", "02", "7")]
    points = spark.createDataFrame(rows, "point string, io_type string, module string, slave string, channel string")
    blocks = spark.createDataFrame([("M", "2", 132, 500), ("M", "2", 132, 400), ("M", "2", 149, 600), ("M", "2", 132, 450), ("M", "9", 132, 450)], "module string, slave string, fc int, block int")
    spec = [("M", 500, 8, "0.5"), ("M", 500, 9, "100"), ("M", 600, 18, "1"), ("M", 600, 19, "9"), ("M", 500, 5, "-1"), ("M", 500, 6, "2.25"), ("M", 400, 5, "7"), ("M", 400, 6, "x")]
    wires = spark.createDataFrame([("w", "M", 500, "R1"), ("x", "M", 500, "R1"), ("y", "M", 400, "R1"), ("z", "M", 500, "R1")], "point string, module string, block int, pin string")
    got = {r.point: (r.block, r.position, r.low, r.low_status, r.high, r.high_status) for r in loops.analog_ranges(points, blocks, spark.createDataFrame(spec, "module string, block int, number int, value string"), wires).collect()}
    assert got == {
        "p": (500, 2, "0.5", "DERIVED", "100.5", "DERIVED"), "q": (600, 1, "1", "DERIVED", "10", "DERIVED"), "r": (None, None, None, "UNRESOLVED", None, "UNRESOLVED"),
        "w": (500, 1, "-1", "EXTRACTED", "1.25", "DERIVED"), "x": (500, None, None, "UNRESOLVED", None, "UNRESOLVED"), "y": (400, 1, "7", "DERIVED", None, "UNRESOLVED"), "z": (500, None, None, "UNRESOLVED", None, "UNRESOLVED"),
    }
    owners = spark.createDataFrame([("M", 100, [0, 1, 2]), ("M", 102, [0]), ("M", 200, [0]), ("M", 200, [0])], "module string, address int, offsets array<int>")
    values = spark.createDataFrame([("M", a) for a in (100, 101, 102, 103, 200, 15)], "module string, address int")
    assert {r.address: (r.status, r.target) for r in specs.resolve_addresses(values, owners, ["module"]).collect()} == {
        100: ("EXPLICIT", "100"), 101: ("DERIVED", "100+1"), 102: ("EXPLICIT", "102"), 103: ("UNRESOLVED", None), 200: ("UNRESOLVED", None), 15: ("INFERRED", "fixed 15"),
    }


def test_references_and_wiring(spark):
    c = [(1, "30705Z2A", "IREF", "T A", "BAZ3-08.07", "01.01"), (2, "30705Z3A", "OREF", "t  a", None, "08.07"), (3, "30705Z2A", "IREF", "B", "BAZ3-01.01", "01.02"), (4, "30705Z2A", "IREF", "C", "QQ00-01.01", "01.03"), (5, "30705Z2A", "IREF", "D", "bad", "01.04")]
    c += [(6, "30705Z2A", "IREF", "T A", "BAZ3-09.09", "01.05"), (7, "30705Z2A", "IREF", "E", "BAZ3-08.07", "01.06"), (8, "30705Z2A", "IREF", "REG", "", "01.07"), (9, "30705Z2A", "IREF", "F", "BAZ9-01.01", "01.08"), (10, "30705Z2A", "IREF", "C2", "QQ00-01.01", "01.09")]
    connectors = spark.createDataFrame(c, "id int, sheet string, kind string, tag string, address string, zone string")
    prefixes, sheets = spark.createDataFrame([("BA", "30705")], "prefix string, sheet_prefix string"), spark.createDataFrame([("30705Z2A",), ("30705Z3A",)], "sheet string")
    got = specs.resolve_references(connectors, prefixes, sheets, spark.createDataFrame([("reg",)], "tag string"), spark.createDataFrame([(10,)], "id int"))
    assert {r.id: (r.status, r.relation, r.partner) for r in got.collect()} == {
        1: ("RESOLVED_CROSS_SHEET", "EXPLICIT", 2), 2: ("UNRESOLVED", "UNRESOLVED", None), 3: ("UNRESOLVED", "UNRESOLVED", None), 4: ("RESOLVED_EXTERNAL", "DERIVED", None), 5: ("UNRESOLVED", "UNRESOLVED", None),
        6: ("RESOLVED_CROSS_SHEET", "DERIVED", 2), 7: ("AMBIGUOUS", "UNRESOLVED", None), 8: ("BOUNDARY_SIGNAL", "DERIVED", None), 9: ("UNRESOLVED", "UNRESOLVED", None), 10: ("RESOLVED_EXTERNAL", "EXPLICIT", None),
    }
    assert {r.id: r.candidates for r in got.collect()}[7] == [2]
    stored = spark.createDataFrame([(1, "10"), (2, "20"), (3, "30"), (4, "40")], "spec int, value string")
    wires = spark.createDataFrame([(1, "10", "INFERRED"), (2, "21", "DERIVED"), (3, "31", "EXPLICIT"), (3, "32", "EXPLICIT")], "spec int, address string, status string")
    assert {r.spec: (r.effective, r.status) for r in specs.apply_wiring(stored, wires).collect()} == {1: ("10", "EXPLICIT"), 2: ("21", "DERIVED"), 3: (None, "UNRESOLVED"), 4: ("40", "STORED")}
    members = spark.createDataFrame([(1, "driver", "a", "EXPLICIT"), (1, "sink", "b", "EXPLICIT"), (1, "sink", "c", "UNRESOLVED"), (2, "sink", "d", "EXPLICIT")], "net int, role string, ref string, status string")
    assert {(r.driver, r.sink, r.status) for r in specs.net_connections(members).collect()} == {("a", "b", "INFERRED"), ("a", "c", "UNRESOLVED")}


@pytest.mark.parametrize("rule, change", [("DUPLICATE_BLOCK", "blocks"), ("SPEC_WITHOUT_BLOCK", "specs"), ("SELF_CONNECTION", "connections"), ("UNKNOWN_STATUS", "status")])
def test_each_seeded_fault_is_found(spark, rule, change):
    blocks, sp, con = [("s", 1, 33)], [("s", 1, 1)], [(1, "a", "b", "EXPLICIT")]
    blocks += [("s", 1, 33)] * (change == "blocks")
    sp += [("s", 9, 1)] * (change == "specs")
    con += [(2, "a", "a", "EXPLICIT")] * (change == "connections") + [(3, "a", "b", "MAYBE")] * (change == "status")
    frames = spark.createDataFrame(sp, "sheet string, block int, number int"), spark.createDataFrame(blocks, "sheet string, block int, fc int"), spark.createDataFrame(con, "net int, driver string, sink string, status string")
    assert {r.rule for r in specs.validate_specs(*frames).collect()} == {rule}
    assert specs.search_blocks(frames[1], "fc 33", ["sheet"]).count() >= 1


def test_pairing_loses_nothing(spark):
    entries = spark.createDataFrame([("a", 1, 33), ("a", 2, 35), ("b", 5, 1)], "sheet string, block int, fc int")
    symbols = spark.createDataFrame([("a", 1, "AND"), ("a", 7, "OR"), ("b", 5, "X"), ("b", 5, "Y")], "sheet string, block int, symbol string")
    got = {(r.sheet, r.block, r.pairing) for r in specs.pair_entries(entries, symbols).collect()}
    assert got == {("a", 1, "BLOCK_NUMBER"), ("a", 2, "ONLY_ONES_LEFT"), ("a", 7, "ONLY_ONES_LEFT"), ("b", 5, "NO_SYMBOL")}

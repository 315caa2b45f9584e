import struct

from pyspark.sql import functions as F

from plantlens.plans import displays, topology
from plantlens.sources import binary

POINTS = "sheet string, wire string, points array<struct<x:int,y:int>>"


def sheet(spark):
    wires = spark.createDataFrame(
        [("s", "w1", [(30, 10), (60, 10)]), ("s", "w2", [(60, 10), (100, 10)]), ("s", "w3", [(60, 10), (60, 50)]), ("s", "w4", [(20, 30), (85, 30)]), ("s", "w5", [(75, 30), (75, 80)]), ("s", "w6", [(500, 500), (600, 500)])], POINTS
    )
    junctions = spark.createDataFrame([("s", "j1", "connected", 61, 11)], "sheet string, ref string, kind string, x int, y int")
    connectors = spark.createDataFrame([("s", "c1", "IREF", 20, 30, 0, 25, 20, 35), ("s", "c2", "OREF", None, None, 70, 80, 80, 90)], "sheet string, ref string, kind string, px int, py int, x1 int, y1 int, x2 int, y2 int")
    blocks = spark.createDataFrame([("s", "b1", 0, 0, 30, 20), ("s", "b2", 100, 0, 130, 20), ("s", "big", -50, -50, 30, 25), ("s", "b3", 55, 60, 70, 70)], "sheet string, ref string, x1 int, y1 int, x2 int, y2 int")
    return wires, junctions, connectors, blocks


def test_ends_nets_and_drivers(spark):
    wires, junctions, connectors, blocks = sheet(spark)
    ends = topology.classify_ends(topology.wire_ends(wires), junctions, connectors, blocks, wires)
    got = {(r.wire, r.end): (r.kind, r.ref, r.status) for r in ends.collect()}
    assert got == {
        ("w1", "from"): ("pin", "b1", "EXPLICIT"), ("w1", "to"): ("junction", "j1", "EXPLICIT"), ("w2", "from"): ("junction", "j1", "EXPLICIT"), ("w2", "to"): ("pin", "b2", "EXPLICIT"),
        ("w3", "from"): ("junction", "j1", "EXPLICIT"), ("w3", "to"): ("pin", "b3", "DERIVED"), ("w4", "from"): ("connector", "c1", "EXPLICIT"), ("w4", "to"): ("dangling", None, "UNRESOLVED"),
        ("w5", "from"): ("wire", "w4", "DERIVED"), ("w5", "to"): ("connector", "c2", "DERIVED"), ("w6", "from"): ("dangling", None, "UNRESOLVED"), ("w6", "to"): ("dangling", None, "UNRESOLVED"),
    }
    net = {r.wire: r.net for r in topology.nets(ends, junctions).collect()}
    assert net["w1"] == net["w2"] == net["w3"] != net["w4"] == net["w5"] and net["w6"] not in (net["w1"], net["w4"])
    pins = spark.createDataFrame([("s", "b1", "output"), ("s", "b2", "input"), ("s", "b3", "input")], "sheet string, ref string, direction string")
    members = {(r.ref, r.role, r.flipped) for r in topology.net_members(ends, topology.nets(ends, junctions), pins, connectors).collect()}
    assert members == {("b1", "driver", False), ("b2", "sink", False), ("b3", "sink", False), ("c1", "driver", False), ("c2", "sink", False)}


def test_an_exported_net_is_driven_by_its_only_pin(spark):
    ends = spark.createDataFrame([("s", "w", "from", "pin", "p"), ("s", "w", "to", "connector", "c")], "sheet string, wire string, end string, kind string, ref string")
    of_net = spark.createDataFrame([("s", "w", "n")], "sheet string, wire string, net string")
    pins, refs = spark.createDataFrame([("s", "p", "input")], "sheet string, ref string, direction string"), spark.createDataFrame([("s", "c", "OREF")], "sheet string, ref string, kind string")
    assert {(r.ref, r.role, r.flipped) for r in topology.net_members(ends, of_net, pins, refs).collect()} == {("p", "driver", True), ("c", "sink", False)}


def test_crossings_pins_and_captions(spark):
    wires, junctions, _, blocks = sheet(spark)
    assert {(r.wire, r.other, r.x, r.y) for r in topology.crossing_points(wires, junctions).collect()} == {("w4", "w3", 60, 30)}
    pins = spark.createDataFrame([("s", "b", x, y, 0, 0, 100, 100) for x, y in ((0, 20), (0, 80), (100, 50), (50, 100), (50, 50))], "sheet string, block string, x int, y int, x1 int, y1 int, x2 int, y2 int")
    assert {(r.x, r.y): r["name"] for r in topology.name_pins(pins).collect()} == {(0, 80): "L1", (0, 20): "L2", (100, 50): "R1", (50, 100): "T1", (50, 50): "I1"}
    symbols = blocks.where("ref <> 'big'").withColumns({"symbol": F.lit("AND"), "ins_x": F.col("x1"), "ins_y": F.col("y1")})
    learned = {(r.width, r.rel_x, r.rel_y): (r.witnesses, r.instances) for r in topology.learn_pins(topology.wire_ends(wires), symbols, junctions).collect()}
    assert learned == {(30, 30, 10): (1, 2), (30, 0, 10): (1, 2)}
    texts = spark.createDataFrame([("s", 1, 50, 100)], "sheet string, text_id int, x int, y int")
    captions = spark.createDataFrame([("s", "near", 52, 110), ("s", "far", 50, 160), ("s", "below", 50, 90)], "sheet string, caption string, x int, y int")
    assert topology.caption_fields(texts, captions).first().caption == "near"


def test_object_graph(spark):
    body = lambda a, b, c, name: struct.pack("<IIIH", a, b, c, 0x10) + name + b"\0\0" + struct.pack("<I", 9)
    data = binary.DISPLAY_MAGIC + b"\0" * 12 + b"".join(struct.pack("<I", 1) + k + b"+\0" + b for k, b in ((b"G_Group", body(0, 2, 0, b"top")), (b"G_Trans", body(0, 0, 0, b"")), (b"G_Text", body(9, 2, 0, b"t"))))
    files = spark.createDataFrame([("f", bytearray(data))], "path string, content binary")
    records = binary.decode_displays(files)
    headers = displays.object_headers(records)
    assert [(r["class"], r.name, r.flags) for r in headers.orderBy("id").collect()] == [("G_Group", "top", 16), ("G_Trans", "", 16), ("G_Text", "t", 16)]
    refs = displays.header_references(headers)
    assert {(r.id, r.role, r.target) for r in refs.collect()} == {(1, "transform", 2), (3, "dynamic", 9), (3, "transform", 2)}
    assert [(r.id, r.target) for r in displays.missing_references(headers, refs).collect()] == [(3, 9)]
    assert {(r["class"], r.role): r.targets for r in displays.role_evidence(headers, refs).collect()} == {("G_Group", "transform"): "G_Trans 1", ("G_Text", "transform"): "G_Trans 1", ("G_Text", "dynamic"): "(missing) 1"}
    faults = displays.allocation_faults(headers, refs.withColumn("n", F.lit(0)))
    assert {(r.id, r.target, r.expected) for r in faults.collect()} == {(3, 3, 3), (3, 9, 4)}
    cover = displays.coverage(records, spark.createDataFrame([("f", len(data))], "path string, length int")).first()
    assert (cover.n_records, cover.gap_bytes, cover.overlap_bytes) == (3, 0, 0) and cover.record_bytes == len(data) - 20


def test_bindings(spark):
    rows = [("A$N$", "A7", None), ("A$M$", "x", None), ("A$N$", "B#dPV", None), ("link", "graphic:12", None), ("tagname", "FT1.PV", None), ("fillColor", None, 3.0), ("size", None, 3.0), ("note", "hello", None)]
    df = spark.createDataFrame(rows, "key string, value string, number double").withColumn("p", F.create_map(F.lit("N"), F.lit("7")))
    got = [tuple(r.b) for r in df.select(displays.classify_binding(F.col("key"), F.col("value"), F.col("number"), F.col("p")).alias("b")).collect()]
    assert got == [
        ("tag", "RESOLVED", "A7", None, "A7"), ("tag", "UNRESOLVED", "x", None, None), ("tag-atom", "INCONSISTENT", "B", "PV", "A7"), ("navigation", "LITERAL", None, None, None),
        ("tag-dot-atom", "RESOLVED", "FT1", "PV", None), ("color", "LITERAL", None, None, None), ("number", "LITERAL", None, None, None), ("text", "LITERAL", None, None, None),
    ]
    index = displays.tag_index(spark.createDataFrame([("T", "b", 2, "x"), ("T", "a", 1, "x"), ("T", None, 1, "y"), (None, "q", 1, "z")], "tag string, atom string, instance int, template string")).first()
    assert (index.atoms, index.instances, index.templates) == (["a", "b"], [1, 2], ["x", "y"])


def test_flatten_composes_transforms(spark):
    m = "struct<a:double,b:double,c:double,d:double,e:double,f:double>"
    move = lambda x, y: (1.0, 0.0, 0.0, 1.0, float(x), float(y))
    roots = spark.createDataFrame([("f", 1, (2.0, 0.0, 0.0, 2.0, 0.0, 0.0))], f"path string, id int, m {m}")
    children = spark.createDataFrame([("f", 1, 2, move(3, 4)), ("f", 1, 3, move(0, 0)), ("f", 2, 3, move(1, 1)), ("f", 3, 1, move(9, 9))], f"path string, id int, child int, cm {m}")
    got = {(tuple(r.trail), r.m.e, r.m.f) for r in displays.flatten(roots, children).collect()}
    assert got == {((1,), 0.0, 0.0), ((1, 2), 6.0, 8.0), ((1, 3), 0.0, 0.0), ((1, 2, 3), 8.0, 10.0)}

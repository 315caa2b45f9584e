import pytest
from pyspark.sql import functions as F

from plantlens.plans import reports


def test_loop_cells_and_titles(spark):
    dev = "struct<description:string,io_type:string,device_tag:string>"
    rows = spark.createDataFrame([("L1", ("flow", "AI", "FT1"), None), (None, ("x", "AI", "y"), None)], f"loop_tag string, input {dev}, output {dev}")
    got = reports.loop_cells(rows).collect()
    assert [list(r) for r in got] == [[""] * 5 + ["flow", "L1", "AI", "FT1"] + [""] * 8] and len(reports.LOOP_COLUMNS) == 17
    fields = [("s", "Description", "AREA", 5, 95, 100), ("s", "DESCRIPTION", "b", 9, 50, 100), ("s", "DESCRIPTION", "a", 1, 50, 100), ("s", "DESCRIPTION", "c", 0, 40, 100), ("s", "REV", "9", 0, 99, 100)]
    t = reports.title_descriptions(spark.createDataFrame(fields, "sheet string, label string, value string, x int, y int, label_y int")).first()
    assert (t.area, t.page) == ("AREA", "a b c")


def test_enrichment_and_logic(spark):
    points = spark.createDataFrame([("p", "C:\\S1.CAD", "FT1"), ("q", "S1.CAD", "none"), ("r", "S9.CAD", "z")], "point string, sheet string, device_tag string")
    sheets = spark.createDataFrame([("S1.CAD", "boiler", "L1"), ("S2.CAD", "pump", None), ("S3.CAD", None, None)], "sheet string, description string, loop_tag string")
    blocks = spark.createDataFrame([("S1.CAD", 1, 10, None, ["a"]), ("S1.CAD", 2, 20, None, ["xx FT1"])], "sheet string, ord int, block int, device_tag string, refs array<string>")
    got = {r.point: (r.block, r.matched, r.description) for r in reports.enrich_points(points, sheets, blocks).collect()}
    assert got == {"p": (20, True, "boiler"), "q": (10, False, "boiler"), "r": (None, False, None)}
    b = spark.createDataFrame([("S1.CAD", 10, 33, {"S1": "5"})], "sheet string, block int, fc int, specs map<string,string>")
    io = spark.createDataFrame([("S2.CAD", "AI", "AI1"), ("S2.CAD", "DO", "DO1")], "sheet string, io_type string, raw string")
    rows = {r.sheet: r for r in reports.logic_records(sheets, b, io).collect()}
    assert set(rows) == {"S1.CAD", "S2.CAD"} and rows["S1.CAD"].s1 == "5" and rows["S2.CAD"].input_refs == ["AI1"] and rows["S2.CAD"].block is None


def test_usage_and_counts(spark):
    blocks = spark.createDataFrame([(33, "a", 2, "Not", 1, "NOT"), (33, "b", 1, "", 2, "NOT"), (99, "a", 3, None, 3, "NOT")], "fc int, sheet string, ord int, name string, block int, symbol string")
    specs = spark.createDataFrame([(33, "1.0", "1"), (33, "2", "1")], "fc int, value string, default string")
    use = {r.fc: (r["name"], r.n_blocks, r.n_sheets, r.n_changed) for r in reports.code_usage(blocks, specs).collect()}
    assert use == {33: ("Not", 2, 2, 1), 99: (None, 1, 1, 0)}
    assert [(r.fc, r.blocks, r.files) for r in reports.unknown_codes(blocks, blocks.where("fc = 33")).collect()] == [(99, [3], ["a"])]
    assert reports.name_conflicts(blocks).first().n_codes == 2
    assert {r.sheet: r.counts for r in reports.count_text(blocks, ["sheet"], "fc").collect()} == {"a": "33 1, 99 1", "b": "33 1"}
    rows = spark.createDataFrame([("k", y) for y in (0.0, 10.0, 20.1, 30.0, 70.0)], "k string, y double")
    assert reports.standard_spacing(rows, ["k"], "y").first().spacing == 10.0
    assert spark.range(1).select(reports.common_pitch(F.array(F.lit(36), F.lit(-60), F.lit(84))).alias("g")).first().g == 12


def test_connections(spark):
    m = [("n1", "A", "p1", "pin", "driver", "EXPLICIT"), ("n1", "A", "c1", "connector", "sink", "EXPLICIT"), ("n2", "B", "c2", "connector", "driver", "EXPLICIT"), ("n2", "B", "p2", "pin", "sink", "DERIVED"), ("n3", "B", "p3", "pin", "sink", "EXPLICIT"), ("n4", "B", "p4", "pin", "driver", "EXPLICIT"), ("n4", "B", "p5", "pin", "driver", "EXPLICIT"), ("n1", "A", "c9", "connector", "sink", "EXPLICIT")]
    members = spark.createDataFrame(m, "net string, sheet string, ref string, kind string, role string, status string")
    refs = spark.createDataFrame([("c1", "c2", "EXPLICIT"), ("c9", None, "UNRESOLVED")], "connector string, partner string, status string")
    got = {(r.connector, r.from_ref, r.to_ref, r.status) for r in reports.cross_sheet_connections(members, refs).collect()}
    assert got == {("c1", "p1", "p2", "DERIVED"), ("c9", "p1", None, "UNRESOLVED")}
    assert {(r.net, r.code) for r in reports.broken_nets(members).collect()} == {("n3", "NO_DRIVER"), ("n4", "SEVERAL_OUTPUTS")}


def test_strings_and_export(spark):
    runs = spark.createDataFrame([("f", 0, "toba_valve"), ("f", 1, 'TAG "FT1"'), ("f", 2, "G_Rect"), ("f", 3, "Pump  house"), ("f", 4, "m1gms4u"), ("f", 5, "x")], "path string, ord int, text string")
    assert [(r.role, r.value, r.object) for r in reports.display_strings(runs).orderBy("ord").collect()] == [("object", "toba_valve", None), ("tag", "FT1", "toba_valve"), ("object", "G_Rect", None), ("text", "Pump  house", None)]
    codes = spark.createDataFrame([(1, "Pump House"), (2, "house"), (3, "Pum")], "fc int, name string")
    assert {(r.fc, r.first_at) for r in reports.detect_codes(runs, codes).collect()} == {(1, 3), (2, 3)}
    files, members = spark.createDataFrame([("a",), ("b",)], "file string"), spark.createDataFrame([("b", "c1"), ("zz", "c1"), ("b", "c2")], "file string, category string")
    cats = spark.createDataFrame([("c1", 1), ("c2", 2)], "category string, place int")
    assert [(r.file, r.category) for r in reports.grouped_export(files, members, cats).collect()] == [("b", "c1"), ("b", "c2"), ("a", "uncategorized")]
    assert {(r.rule, r.ref) for r in reports.category_faults(files, members).collect()} == {("UNKNOWN_FILE", "zz"), ("SEVERAL_CATEGORIES", "b")}


def test_plot_agreement(spark):
    labels = spark.createDataFrame([("s", "1", 0, 50), ("s", "2", 0, 40), ("s", "9", 200, 0)], "sheet string, text string, x int, y int")
    blocks = spark.createDataFrame([("s", 7, 0, 45, ["1", "2"]), ("s", 8, 200, 5, ["8"])], "sheet string, block int, x int, y int, specs array<string>")
    assert {r.block: (r.same_set, r.same_order) for r in reports.plot_agreement(labels, blocks).collect()} == {7: (True, True), 8: (False, False)}


@pytest.mark.parametrize("defect, rows", [(None, [(1, "a"), (2, "b")]), ("MISSING", [(1, "a")]), ("INVENTED", [(1, "a"), (2, "b"), (3, "c")]), ("ALTERED", [(1, "a"), (2, "x")]), ("REPEATED", [(1, "a"), (1, "a"), (2, "b")])])
def test_each_seeded_defect_is_found(spark, defect, rows):
    scene = {"specs": spark.createDataFrame([(1, "a"), (2, "b")], "ref int, text string")}
    found = {r.defect for r in reports.document_defects(scene, {"specs": spark.createDataFrame(rows, "ref int, text string")}).collect()}
    assert found == ({defect} if defect else set())


def test_digits_of_a_tag_are_no_target(spark):
    from plantlens.plans import details

    df = spark.createDataFrame([("OREF DI7-1A/1200000 BA02-07.07 30000L6A",), ("OREF DI7-1A/12 BA02-07.07",)], "raw string")
    got = [tuple(r.r) for r in df.select(details.output_reference(F.col("raw")).alias("r")).collect()]
    assert got == [("DI7-1A/1200000", "BA02-07.07", "30000L6A"), ("DI7-1A/12", "BA02-07.07", None)]


def test_places_meet_once(spark):
    """Copies in one place don't meet one by one: 3,000 labels and blocks in two places settle at once, the least block wins."""
    from plantlens.plans import loops, relational

    labels = spark.range(3000).select(F.lit("s").alias("sheet"), F.col("id").alias("label_id"), (F.col("id") % 2 * 8.0 + 5).alias("x"), F.lit(12.0).alias("y"))
    blocks = spark.range(3000).select(F.lit("s").alias("sheet"), F.col("id").alias("block"), (F.col("id") % 2 * 8.0).alias("bx"), F.lit(0.0).alias("by"), F.lit(10).alias("height"), F.col("id").alias("ord"))
    got = loops.label_blocks(labels, blocks)
    assert got.count() == 3000 and {r.block for r in got.select("block").distinct().collect()} == {1}
    parts = spark.createDataFrame([(k, "T", 5, 9.0) for k in range(4)] + [(9, "T", 6, 9.0)], "p_partkey long, p_type string, p_size int, p_retailprice double")
    assert {r.p_partkey: (r.label, r.score) for r in relational._nearest(parts, parts).collect()} == {0: (1, 0.0), 1: (0, 0.0), 2: (0, 0.0), 3: (0, 0.0), 9: (0, 0.1)}


def test_ranges_are_never_broadcast(spark):
    from plantlens.plans import direct

    plan = direct.range_lookup(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan

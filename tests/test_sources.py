import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from plantlens.plans import loops
from plantlens.sources import binary, files, listings

LISTING = r"""
C:\WORK\M9\4010100A.CAD Outputs
------------------------------
     Description                Source               Destination(s)
START0101                       CA00-14.26      CAZ2-08.07 40101Z2A  CAK7-12.07 40101K7A

DI1-01/310PSH-M07               CA01-05.14      CAL6-08.07 40101L6A
                                                CA69-09.07 4010169A

C:\WORK\M9\4010100A.CAD Inputs
------------------------------
DI1-01/310PSH-M07               CA01-05.14      CAL6-08.07 40101L6A
AI3-02/310TT-1200               CA02-05.14
"""
ERRORS = "Unrslvd Out:        D310AL015-1 CAA4-13.26 In: C:\\WORK\\M9\\40101A4A.CAD\nsomething else\nUnrslvd Inp:   NO ADDRESS HERE In: C:\\WORK\\M9\\40101B4A.CAD\n"
LOG = "No. of CAD Sheets to Process = 2\nReading: C:\\WORK\\M9\\40101Z2A.CAD: (   1 of  2)\nBlank description in file C:\\WORK\\M9\\40101Z2A.CAD \nBlank description in file C:\\WORK\\M9\\40101Z2A.CAD \nNo. of CAD Sheets to Process = 3\nReading: C:\\WORK\\M9\\40101Z1A.CAD: (   2 of  2)\n"


def lines(spark, text):
    return listings.lines_of(spark.createDataFrame([("f", text)], "file string, text string"), "file", "text")


def raw(spark, *contents):
    return spark.createDataFrame([(f"/x/{i}.bin", bytearray(c)) for i, c in enumerate(contents)], "path string, content binary")


def test_cross_reference(spark):
    rows = listings.parse_cross_reference(lines(spark, LISTING)).orderBy("n").collect()
    assert [(r.sheet, r.direction, r.description, r.source) for r in rows] == [
        ("4010100A", "Outputs", "START0101", "CA00-14.26"), ("4010100A", "Outputs", "DI1-01/310PSH-M07", "CA01-05.14"),
        ("4010100A", "Inputs", "DI1-01/310PSH-M07", "CA01-05.14"), ("4010100A", "Inputs", "AI3-02/310TT-1200", "CA02-05.14"),
    ]
    assert [(d.reference, d.sheet) for d in rows[1].destinations] == [("CAL6-08.07", "40101L6A"), ("CA69-09.07", "4010169A")]
    assert rows[3].destinations == []


def test_points(spark):
    records = loops.io_records(listings.parse_cross_reference(lines(spark, LISTING)))
    points = {r.point: r for r in loops.one_per_point(records, ["n"]).collect()}
    assert set(points) == {"DI1-01/310PSH-M07", "AI3-02/310TT-1200"} and points["DI1-01/310PSH-M07"].n_rows == 2
    assert points["DI1-01/310PSH-M07"].destination_sheets == ["4010169A", "40101L6A"]
    assert loops.counts_by_type(records).first().asDict() == {"AI": 1, "AO": 0, "DI": 2, "DO": 0, "total": 3}
    assert loops.io_sheet(records).count() == 3


def test_errors_and_log(spark):
    rows = listings.parse_errors(lines(spark, ERRORS)).orderBy("n").collect()
    assert [(r.direction, r.description, r.reference, r.sheet) for r in rows] == [("Output", "D310AL015-1", "CAA4-13.26", "40101A4A"), ("Input", "NO ADDRESS HERE", None, "40101B4A")]
    log = listings.parse_log(lines(spark, LOG)).first()
    assert (log.sheets_to_process, log.n_sheets, log.n_blank) == (3, 2, 2)
    assert listings.blank_descriptions(lines(spark, LOG)).first().n == 2


def test_reports(spark):
    vfy = "Drawing File : C:\\A\\40101Z2A.CAD\nBlock Number  120  FC: 33\n S1 input\n  SRC: 100\n  REF: 101\n S2 other\n  SRC: 7 REF: 8\n"
    rows = listings.parse_verify_report(lines(spark, vfy)).orderBy("spec").collect()
    assert [(r.sheet, r.block, r.fc, r.spec, r.src, r.ref) for r in rows] == [("40101Z2A", 120, 33, 1, "100", "101"), ("40101Z2A", 120, 33, 2, "7", "8")]
    specs = listings.parse_spec_report(lines(spark, "Block 5: FC 33\n S1 I 100\n S2 R 1.5\nBlock 6: FC 35\n S1 B 0\n")).collect()
    assert [(r.block, r.fc, r.number, r.type, r.value) for r in specs] == [(5, 33, 1, "I", "100"), (5, 33, 2, "R", "1.5"), (6, 35, 1, "B", "0")]
    trace = listings.parse_block_trace(lines(spark, " 100-103 ( 4) FC 82 SH:Z2\n 200 FC 33 SH:Z3\n")).collect()
    assert [(r.block, r.span, r.fc, r.sheet) for r in trace] == [(100, 4, 82, "Z2"), (200, 1, 33, "Z3")]


def word_record(kind, *words, tail=b""):
    tail += b"\0" * (len(tail) % 2)
    body = struct.pack(f"<{len(words)}H", *words) + tail
    return struct.pack("<HH", kind, 2 + len(body) // 2) + body


def sheet(records, trailer=b""):
    return b"\0" * 256 + b"".join(records) + trailer


def test_sheet_records(spark):
    symbol = struct.pack("<5H", 3, 10, 20, 30, 40) + b"AND     " + struct.pack("<4H", 11, 21, 90, 0)
    records = [
        word_record(1, 2, 0, 5, 6, 7, 8, 9, 10), word_record(5, 1, 1, 2, 3, 4, 0x8000 | 12, 90, tail=b"HELLO  "), b"\0\0\0\0",
        struct.pack("<HH", 6, (4 + len(symbol) + 2) // 2) + symbol + struct.pack("<H", 120),
        struct.pack("<HH", 8, (4 + len(symbol) + 40) // 2) + symbol + b"TAG ONE".ljust(30) + b"CA00-14.26",
        struct.pack("<HH", 7, (4 + len(symbol) + 2 + 80) // 2) + symbol + b"\0\0" + b"CA01-01.01" + b"FIRST".ljust(30) + b" " * 40,
    ]
    files_ = raw(spark, sheet(records, b"BCCo\xc5SPC"), sheet(records[:1] + [struct.pack("<HH", 1, 9999)]))
    rows = binary.decode_sheets(files_).orderBy("path", "offset").collect()
    assert [r.kind for r in rows] == ["polyline", "text", "symbol", "symbol", "symbol", "polyline"]
    assert [(p.x, p.y) for p in rows[0].points] == [(5, 6), (7, 8), (9, 10)] and (rows[1].text, rows[1].text_height) == ("HELLO", 12)
    assert (rows[2].symbol, rows[2].block, rows[2].ins_x) == ("AND", 120, 11) and (rows[3].tag, rows[3].reference) == ("TAG ONE", "CA00-14.26")
    assert [(r.slot, r.reference, r.tag) for r in binary.block_entries(binary.decode_sheets(files_)).collect()] == [(0, "CA01-01.01", "FIRST")]
    cover = {r.path: r for r in binary.record_coverage(files_, binary.decode_sheets(files_)).collect()}
    assert cover["/x/0.bin"].stream_bytes == cover["/x/0.bin"].record_bytes + 4 and cover["/x/0.bin"].largest_gap == 4
    assert cover["/x/1.bin"].record_bytes < cover["/x/1.bin"].stream_bytes


def entry(block, code, payload):
    payload += b"\0" * (len(payload) % 2)
    return struct.pack("<HHH", 3 + len(payload) // 2, block, code) + payload


def test_trailer_and_specs(spark):
    entries = entry(100, 33, struct.pack("<HHf", 5, 1, 2.5)) + entry(101, 35, struct.pack("<H", 9)) + entry(102, 33, b"\1\0")
    data = sheet([], binary.SPECS + b"\0" * 15 + entries + binary.ATTRIBUTES)
    rows = binary.decode_trailers(raw(spark, data, b"nothing")).orderBy("offset").collect()
    assert [(r.block, r.fc, r.header) for r in rows] == [(100, 33, 15), (101, 35, 15), (102, 33, 15)]
    schema = spark.createDataFrame([(33, ["I", "B", "R"]), (35, ["I"])], "fc int, types array<string>")
    values = binary.spec_values(binary.decode_trailers(raw(spark, data)), schema).orderBy("block", "number").collect()
    assert [(r.block, r.number, r.value) for r in values if r.closed] == [(100, 1, 5.0), (100, 2, 1.0), (100, 3, 2.5), (101, 1, 9.0)]
    assert [r.block for r in values if not r.closed] == [102]
    config = raw(spark, b"\0" * 512 + entries)
    anchors = spark.createDataFrame([(100, 33), (101, 99), (555, 1)], "block int, fc int")
    assert {r.block: r.status for r in binary.locate_configuration(config, anchors).collect()} == {100: "FOUND", 101: "MISMATCH", 555: "NOT_FOUND"}


def test_library_and_display(spark):
    body = word_record(2, 1, 1, 2, 3, 4)
    head = struct.pack("<4H", 9, 6, 17, len(body) // 2) + struct.pack("<4H", 0, 0, 50, 60) + b"VALVE   " + struct.pack("<2H", 5, 6) + b"\0" * 6
    library = b"\0" * 512 + b"\0" * 12 + struct.pack("<2H", 1, 1) + b"VALVE   " + struct.pack("<4H", 3, 1, 6, 17 + len(body) // 2)
    library = library.ljust(1024, b"\0") + head + body
    row = binary.decode_libraries(raw(spark, library)).first()
    assert (row["name"], row.x2, row.ins_y, row.sound, row.record_bytes) == ("VALVE", 50, 6, True, len(body))
    display = binary.DISPLAY_MAGIC + b"\0" * 12 + struct.pack("<I", 7) + b"G_Rect+\0abc" + struct.pack("<I", 8) + b"G_Text+\0xyz"
    rows = binary.decode_displays(raw(spark, display)).orderBy("id").collect()
    assert [(r["class"], r.preamble, bytes(r.body)) for r in rows] == [("G_Rect", 7, b"abc"), ("G_Text", 8, b"xyz")]
    with pytest.raises(Exception, match="not a display"):
        binary.decode_displays(raw(spark, b"junk")).collect()


def test_archives(spark):
    def pack(*names):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n in names:
                z.writestr(n, n.encode() * 3)
        return out.getvalue()

    rows = binary.read_archives(raw(spark, pack("M9/L3/P2/a.cad", "b.OUT"))).orderBy("path").collect()
    assert [(r.path, r.length) for r in rows] == [("M9/L3/P2/a.cad", 42), ("b.OUT", 15)]
    for bad in ("../x", "/x", "C:/x"):
        with pytest.raises(Exception, match="unsafe"):
            binary.read_archives(raw(spark, pack(bad))).collect()
    kinds = files.inventory(binary.read_archives(raw(spark, pack("M9/L3/P2/a.cad", "b.OUT", "c"))))
    assert {r.kind: r.n_files for r in files.by_kind(kinds).collect()} == {"CAD": 1, "OUT": 1, "OTHER": 1}
    assert kinds.where("kind = 'CAD'").first().module == "M9" and kinds.where("kind = 'CAD'").first()["loop"] == "L3"


def test_runs_and_dumps(spark):
    f = raw(spark, b"\0AB-123\0\1AB-123\0XY   LONG TEXT HERE\xff", bytes(range(40)))
    runs = listings.printable_runs(f, 4).where("path = '/x/0.bin'").orderBy("ord").collect()
    assert [r.text for r in runs] == ["AB-123", "XY   LONG TEXT HERE"]
    assert {r.text for r in listings.descriptors(f).where("path = '/x/0.bin'").collect()} == {"AB-123", "XY", "LONG TEXT HERE"}
    dump = binary.hexdump(f).where("path = '/x/1.bin'").orderBy("offset").collect()
    assert [r.offset for r in dump] == ["00000000", "00000010", "00000020"] and dump[0].hex.startswith("00 01 02") and dump[2].ascii == " !\"#$%&'"


def test_spreadsheet(spark):
    rows = [("310T-1", "a", None, "1-2-3", "x", None, None, None, "d", 1), ("310T-1", "a", None, "1-2-3", "x", None, None, None, "later", 2), ("z", "b", None, "bad", "x", None, None, None, "d", 3)]
    got = binary.read_spreadsheet_rows(spark.createDataFrame(rows, "loop_tag string, device_tag string, alias string, address string, AI string, AO string, DI string, DO string, description string, ord int")).collect()
    assert [(r.loop_tag, r.io_type, r.description) for r in got] == [("310T-1", "AI", "d")]


def test_knowledge_base_and_sinks(spark, tmp_path):
    (tmp_path / "kb").mkdir()
    (tmp_path / "kb" / "033.json").write_text('{"function_code": 33, "name": "Not", "outputs": [{"blk": "N", "type": "B"}, {"blk": "N+2", "type": "R"}], "specifications": [{"number": 2, "type": "R"}, {"number": 1, "type": "I", "enumerations": [{"value": "0", "meaning": "off"}]}]}')
    kb = files.read_function_codes(spark, str(tmp_path / "kb"))
    assert kb["types"].first().types == ["I", "R"] and kb["offsets"].first().offsets == [0, 2] and kb["enumerations"].first().meaning == "off"
    df = spark.createDataFrame([('say "hi"', ["a", "b"], 1)], "t string, l array<string>, n int")
    files.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", "true").option("escape", '"').csv(str(tmp_path / "csv")).first().asDict() == {"t": 'say "hi"', "l": "a; b", "n": "1"}
    files.write_tables({"x": df}, str(tmp_path / "out"), by=["n"])
    assert spark.read.parquet(str(tmp_path / "out/x")).where(F.col("n") == 1).count() == 1
    specs = spark.createDataFrame([("s", 2, 33, 1, "I", "5"), ("s", 1, 35, 1, "R", "1.5")], "sheet string, block int, fc int, number int, type string, value string")
    assert files.spec_tree(specs).first().tree.startswith('[{"block":1,"fc":35')

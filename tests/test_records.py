import random
import struct

import pytest
from pyspark.sql import functions as F

from plantlens.functions import numbers
from plantlens.sources import binary, files, records

HEADER = b"m1gms4u\n" + bytes(12)


def record(name, body=b"", preamble=0):
    return struct.pack("<I", preamble) + name.encode() + b"+\0" + body


def head(*refs, name=b"", name2=b""):
    return struct.pack("<IIIH", *refs, 0x10) + name + b"\0" + name2 + b"\0" + struct.pack("<I", 9)


def listed(*refs):
    return struct.pack(f"<{len(refs) + 1}I", len(refs), *refs)


def decoded(spark, data, path="a.m1"):
    rows = records.decode_records(spark.createDataFrame([(path, data)], "path string, content binary"))
    return rows, rows.orderBy("id", "n").collect()


def test_typed_fields_cover_the_file(spark):
    data = HEADER + record("Model", head(0, 0, 0, name=b"v1") + listed(2, 3) + struct.pack("<I", 1) + struct.pack("<I", 7) + b"PUMP\0" + bytes(4))
    data += record("ModInst", head(0, 4, 0) + b"PUMP\0" + struct.pack("<I", 1) + struct.pack("<I", 5) + b"TAG\0")
    data += record("G_Line_30", head(0, 0, 0) + listed(6) + struct.pack("<IHfIHIHH", 1, 2, 1.5, 3, 4, 5, 10000, 1) + struct.pack("<H", 8))
    data += record("Mat2x3", struct.pack("<6d", 1, 0, 65536, 0, 1, 0)) + record("G_StrConst_30", b"text\0") + record("PtArray", struct.pack("<H4i", 2, 65536, -32768, 0, 1), preamble=4)
    fields, rows = decoded(spark, data)
    got = {(r["class"], r.field): (r.value, r.target, r.role) for r in rows}
    assert got["Model", "children.ref[1]"] == ("3", 3, "child") and got["Model", "templates[0].name"][0] == "PUMP"
    assert got["ModInst", "hdr.transformRef"] == ("4", 4, "transform") and got["ModInst", "props[0].valueRef"][1:] == (5, "property") and got["ModInst", "hdr.dynPropRef"][1:] == (None, None)
    assert got["G_Line_30", "style.lineWidth"][0] == "1.5" and got["Mat2x3", "tx"][0] == "65536.0" and got["PtArray", "p[0].y"][0] == "-0.5"
    for a, b in zip(rows, rows[1:]):
        assert b.at == a.at + a.bytes
    assert rows[0].at == 20 and rows[-1].at + rows[-1].bytes == len(data) and all(r.error is None for r in rows)
    cover = records.field_coverage(fields, spark.createDataFrame([("a.m1", len(data)), ("empty.m1", 20)], "path string, length long")).collect()
    assert {r.path: (r.records, r.unresolved_bytes, r.missing_bytes, r.errors) for r in cover} == {"a.m1": (6, 0, 0, 0), "empty.m1": (0, 0, 0, 0)}
    assert {(r.field, r.target) for r in records.record_references(fields).where("class = 'Model'").collect()} == {("children.ref[0]", 2), ("children.ref[1]", 3)} if "class" in records.record_references(fields).columns else True


def test_candidates_inside_fields_are_rejected_and_those_in_unexplained_bytes_taken(spark):
    data = HEADER + record("G_VarRef_30", b"see Ghost+\0") + record("Point", struct.pack("<2i", 0, 0)) + record("Strange", b"abc") + record("Z2", b"\1\2")
    _, rows = decoded(spark, data)
    assert [r["class"] for r in rows if r.field == "preamble"] == ["G_VarRef_30", "Point", "Strange", "Z2"]
    assert {(r["class"], r.field, r.value) for r in rows if r.type == "bytes"} == {("Strange", "unknown_body", "616263"), ("Z2", "unknown_body", "0102")}


def test_bodies_that_do_not_fit_stay_bytes(spark):
    data = HEADER + record("G_IntConst_30", b"\7") + record("PtArray", struct.pack("<H", 3), preamble=4) + record("Point", struct.pack("<2i", 0, 0) + b"tail")
    _, rows = decoded(spark, data)
    assert [(r["class"], r.field, r.error is not None) for r in rows if r.type == "bytes"] == [("G_IntConst_30", "undecoded_body", True), ("PtArray", "undecoded_body", True), ("Point", "unresolved_tail", False)]
    with pytest.raises(ValueError):
        records.display_fields("x", b"no display")


def test_any_bytes_are_covered_once():
    rng = random.Random(7)
    for _ in range(200):
        data = HEADER + b"".join(record(rng.choice([*records.KNOWN, "Other", "A"]), bytes(rng.choice(b"\0\1Ab+_\xff") for _ in range(rng.randrange(40)))) for _ in range(rng.randrange(1, 9)))
        rows = records.display_fields("x", data)
        at = 20
        for r in rows:
            assert r[9] == at
            at += r[10]
        assert at == len(data)


def test_template_library_reads_three_headers_and_the_first_root(spark):
    body = lambda width: b"".join(bytes(width) + name + b"+\0" + rest for name, rest in ((b"Model", head(0, 0, 0) + listed(2)), (b"Point", struct.pack("<2i", 65536, 0))))
    old, new = b"!!<gms>\n" + struct.pack("<I", 8) + b"pad", b"!!<gms>\n" + struct.pack("<I", 12) + bytes(37)
    graphic = HEADER + body(4)
    tail = [r[7:] for r in records.display_fields("x", graphic)]
    for data in (graphic, old + body(2), new + body(4)):
        assert [r[7:] for r in records.display_fields("x", records.normalised("x", data))] == tail
    for bad in (b"", b"no", b"!!<gms>\n", new + b"nothing"):
        with pytest.raises(ValueError):
            records.normalised("x", bad)
    files = [(1, "/b/Pump.m1", new + body(4)), (0, "/a/PUMP.M1", old + body(2)), (0, "/z/pump.m1", b"unread"), (0, "/a/bad.m1", b"junk"), (1, "/b/bad.m1", graphic), (0, "/a/readme.txt", graphic)]
    got = records.template_library(spark.createDataFrame(files, "root int, path string, content binary"))
    assert {(r.template, r["class"]) for r in got.collect()} == {("pump", "Model"), ("pump", "Point")}  # a name's first file counts, even if it can't be read
    assert got.where("class = 'Model' and field = 'children.ref[0]'").first().target == 2


def test_files_of_a_folder_by_pattern(spark, tmp_path):
    for name, data in (("a/x.m1", b"one"), ("b/y.M1", b"two"), ("z.m1", b"3"), ("empty.m1", b"")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = binary.read_files(spark, str(tmp_path), "*.m1").collect()
    assert {(r.path.rsplit("/", 1)[1], bytes(r.content), r.length) for r in got} == {("x.m1", b"one", 3), ("z.m1", b"3", 1)}  # Spark leaves out empty files
    parts = spark.createDataFrame([([(2, "c"), (0, "a"), (1, "b")],), ([],)], "p array<struct<place:int,text:string>>")
    assert [r[0] for r in parts.select(files.ordered_text(F.col("p"))).collect()] == ["a b c", ""]
    numbers_ = spark.createDataFrame([(x,) for x in (0.0, 1e-7, 1.5, 123456789.0, float("nan"), None)], "v double")
    assert [r[0] for r in numbers_.select(numbers.format_g(F.col("v"))).collect()][:5] == ["0", "1e-007", "1.5", "1.23457e+008", "nan"]

"""Bodies of display records: a cursor that a table of layouts drives, and the choice of boundaries that covers a file.

A display is a stream of records, each a number of four bytes, a class name ending in `+` and a zero byte, and a body. What looks
like such a beginning may also stand inside a text, so boundaries are chosen in two passes: first the known classes divide
the file, and their bodies are decoded; a candidate of another class is a boundary only where no decoded field explains its
bytes, and where it doesn't reach into the head of the record before it. Every byte after the file's header then belongs to
exactly one field of one record: typed, or of type `bytes` where no layout explains it.
"""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.sources.binary import DISPLAY_HEADER, DISPLAY_MAGIC, MARKER

#: Layouts by class, as `name type status`, in the order of the bytes. Types: u16, u32, i32, f32, f64 and fx (16.16
#: fixed point), all little-endian, cstr (up to a zero byte), lstr (after its length in four bytes), ref (a record's number, 0 for
#: none), `list:count` (a u32 and as many refs), `?` before a type: only if four bytes are left. Status K is known, C a candidate, U unresolved.
#: A ref's role stands in place of its status.
HEAD = "hdr.dynPropRef ref dynamic, hdr.transformRef ref transform, hdr.slot2Ref ref secondary, hdr.flags u16 C, hdr.name cstr K, hdr.name2 cstr K, hdr.slot3 u32 U"
STYLE = "style.lineColor u32 C, style.lineStyle u16 C, style.lineWidth f32 C, style.fillColor u32 C, style.fillStyle u16 C, style.fillPattern u32 C, style.k10000 u16 U, style.filled u16 C"
CHILDREN = "children.ref list:children.count child"
FIGURE = f"{HEAD}, geom.ref list:geom.count geometry, {STYLE}"
LAYOUTS = {
    "Model": f"{HEAD}, {CHILDREN}, templates templates K",
    "Group": f"{HEAD}, {CHILDREN}, tail ?u32 U",
    "FillGroup": f"{HEAD}, {CHILDREN}, fill.lineColor u32 C, fill.fillColor u32 C, fill.fillStyle u16 C, fill.fillPattern u32 C, fill.k10000 u16 U, fill.filled u16 C, fill.extra0 u32 U, fill.extra1 u32 U",
    "Marker": f"{HEAD}, geom.ref list:geom.count geometry, marker.color u16 C, marker.style u16 U, marker.size f32 C, marker.extra u32 U",
    "ModInst": f"{HEAD}, template cstr K, props props K",
    "Text": f"{HEAD}, anchor.ref list:anchor.count anchor, text.pre u32 U, text lstr K, text.a u16 U, text.font u32 C, text.hAlign u16 C, text.vAlign u16 C, text.height f32 C, text.b u32 U, text.c u32 U, text.color u32 C",
    "G_TRect_30": f"{FIGURE}, text.pre u32 U, text lstr K, text.height f32 C, text.d i32 U, text.a u16 U, text.font u32 C, text.hAlign u16 C, text.vAlign u16 C, text.b u32 U, text.color u32 C, text.e ?u32 U",
    "G_Rect_30": FIGURE,
    "G_Line_30": f"{FIGURE}, line.endStyle u16 U",
    "G_Circ_30": f"{FIGURE}, circ.extra u32 U",
    "G_Sect_30": f"{FIGURE}, sect.extra u32 U, sect.startAngle f64 C, sect.sweepAngle f64 C, sect.tail u16 U",
    "G_Spline_30": f"{FIGURE}, spline.closed u16 C, spline.kind u16 U, spline.ref list:spline.count spline-part",
    "Point": "x fx C, y fx C",
    "PtArray": "points points C",
    "Scal2d": "tx f64 C, ty f64 C, sx f64 C, sy f64 C",
    "Mat2x3": "a f64 C, b f64 C, tx f64 C, c f64 C, d f64 C, ty f64 C",
    "LinkRef": "first ref link-first, second ref link-second",
    "G_StrConst_30": "value cstr K",
    "G_IntConst_30": "value i32 K",
    "G_VarRef_30": "name cstr K",
    "G_DynProp_30": "dyn.a u32 U, dyn.ref list:dyn.count dynprop-target, dyn.b ?u32 U",
    "G_EVap_30": "evap.head ref evap-head, evap.ref list:evap.count evap-item",
    "G_Svap_30": "svap.op u32 U, svap.target ref svap-target, svap.value ref svap-value",
    "G_Cvap_30": "cvap.op u32 U, cvap.target ref cvap-target, cvap.value ref cvap-value, cvap.code u16 U",
    "G_Action_30X": "action.code u32 U, action.ref list:action.count action-arg",
    "G_FctnCall_30": "function cstr K, args.ref list:args.count function-arg",
    "G_UnExpr_30": "operand ref expr-operand, op u16 U",
    "G_RelExpr_30": "left ref expr-operand, right ref expr-operand, op u16 U",
}
KNOWN = (*LAYOUTS, "Z2")
NUMBERS = {"u16": "<H", "u32": "<I", "i32": "<i", "f32": "<f", "f64": "<d", "fx": "<i", "ref": "<I"}
STATUS = {"K": "KNOWN", "C": "CANDIDATE", "U": "UNRESOLVED"}
FIELDS = "path string, id int, class string, `offset` int, `end` int, error string, n int, field string, type string, at int, bytes int, value string, status string, target long, role string"


@dataclass
class Cursor:
    """Reads fields between two places of a file, each where the last one ended."""

    data: bytes
    at: int
    end: int
    fields: list[tuple] = field(default_factory=list)  # name, type, at, bytes, value, status, target, role

    def take(self, name: str, kind: str, size: int, value: str | None, status: str, target: int | None = None, role: str | None = None) -> None:
        if self.at + size > self.end:
            raise ValueError(f"{name} needs {size} bytes, {self.end - self.at} are left")
        self.fields.append((name, kind, self.at, size, value, status, target, role))
        self.at += size

    def number(self, name: str, kind: str, status: str) -> int | float:
        form = NUMBERS[kind]
        size = struct.calcsize(form)
        if self.at + size > self.end:
            raise ValueError(f"{name} needs {size} bytes, {self.end - self.at} are left")
        value = struct.unpack_from(form, self.data, self.at)[0]
        if kind == "ref":
            self.take(name, kind, size, str(value), "KNOWN", value or None, status if value else None)
        else:
            self.take(name, kind, size, repr(value / 65536 if kind == "fx" else value), STATUS[status])
        return value

    def text(self, name: str, status: str = "K") -> None:
        stop = self.data.find(b"\0", self.at, self.end)
        if stop < 0:
            raise ValueError(f"{name} doesn't end")
        self.take(name, "cstr", stop + 1 - self.at, self.data[self.at : stop].decode("latin1"), STATUS[status])

    def step(self, name: str, kind: str, status: str, preamble: int) -> None:
        """One entry of a layout."""
        if kind.startswith("?"):
            if self.end - self.at < 4:
                return
            kind = kind[1:]
        if kind in NUMBERS:
            self.number(name, kind, status)
        elif kind == "cstr":
            self.text(name, status)
        elif kind == "lstr":
            size = self.number(f"{name}.length", "u32", "K")
            self.take(name, "lstr", size, self.data[self.at : self.at + size].decode("latin1"), STATUS[status])
        elif kind.startswith("list:"):
            for k in range(self.number(kind[5:], "u32", "K")):
                if self.end - self.at < 4:
                    break
                self.number(f"{name}[{k}]", "ref", status)
        elif kind == "points":
            many = self.number("count", "u16", "K")
            if preamble != 2 * many:
                raise ValueError(f"{many} points after a preamble of {preamble}")
            for k in range(many):
                self.number(f"p[{k}].x", "fx", status)
                self.number(f"p[{k}].y", "fx", status)
        elif kind == "templates" and self.end - self.at >= 4:
            for k in range(self.number("templates.count", "u32", "K")):
                self.number(f"templates[{k}].slot", "u32", "U")
                self.text(f"templates[{k}].name")
            self.number("tail", "u32", "U")
        elif kind == "props":
            for k in range(self.number("props.count", "u32", "K")):
                self.number(f"props[{k}].valueRef", "ref", "property")
                self.text(f"props[{k}].key")

    def rest(self, name: str) -> None:
        if self.at < self.end:
            self.take(name, "bytes", self.end - self.at, self.data[self.at : self.end].hex(), "UNRESOLVED")


def _compiled(layout: str) -> tuple[struct.Struct, list[tuple], list[tuple[str, str, str]]]:
    """A layout's numbers up to its first entry of another kind, read at once: their form, (name, kind, offset, size, status or role), and the entries left."""
    entries = [tuple(entry.split(" ")) for entry in layout.split(", ")]
    many = next((k for k, e in enumerate(entries) if e[1] not in NUMBERS), len(entries))
    held, at = [], 0
    for name, kind, status in entries[:many]:
        size = struct.calcsize(NUMBERS[kind])
        held.append((name, kind, at, size, status if kind == "ref" else STATUS[status]))
        at += size
    return struct.Struct("<" + "".join(NUMBERS[e[1]][1:] for e in entries[:many])), held, entries[many:]


PLANS = {name: _compiled(layout) for name, layout in LAYOUTS.items()}
PREAMBLE, CLASSES = struct.Struct("<I"), frozenset(KNOWN)
DIGITS, WORD = b"0123456789", b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"


def _decoded(data: bytes, start: int, end: int, name: str) -> tuple[list[tuple], str | None]:
    """Fields of one record, which tile it, and why its layout doesn't fit, if so."""
    at = start + 6 + len(name)
    if at > end:
        raise ValueError(f"{name} at {start} ends within its head, at {end}")
    preamble = PREAMBLE.unpack_from(data, start)[0]
    head = [("preamble", "u32", start, 4, str(preamble), "KNOWN" if name == "PtArray" else "CANDIDATE", None, None), ("className", "cstr", start + 4, at - start - 4, name + "+", "KNOWN", None, None)]
    plan = PLANS.get(name)
    if plan is None:
        if at < end:
            head.append(("unknown_body", "bytes", at, end - at, data[at:end].hex(), "UNRESOLVED", None, None))
        return head, None
    form, numbers, entries = plan
    fields = head[:]
    try:
        if not numbers and entries[0][1] == "cstr":  # a text alone, or first
            cursor = Cursor(data, at, end, fields)
        elif at + form.size <= end:
            for (field_, kind, offset, size, status), value in zip(numbers, form.unpack_from(data, at)):
                if kind == "ref":
                    fields.append((field_, kind, at + offset, size, str(value), "KNOWN", value or None, status if value else None))
                else:
                    fields.append((field_, kind, at + offset, size, repr(value / 65536 if kind == "fx" else value), status, None, None))
            if not entries and at + form.size == end:
                return fields, None
            cursor = Cursor(data, at + form.size, end, fields)
        else:  # the number that doesn't fit is named in the error
            cursor = Cursor(data, at, end, fields)
            entries = [(n, k, s if k == "ref" else s[0]) for n, k, _, _, s in numbers]
        for entry in entries:
            cursor.step(*entry, preamble)
        cursor.rest("unresolved_tail")
        return fields, None
    except ValueError as reason:
        if at < end:
            head.append(("undecoded_body", "bytes", at, end - at, data[at:end].hex(), "UNRESOLVED", None, None))
        return head, str(reason)


def _marks(data: bytes) -> tuple[list[tuple[int, str]], list[tuple[int, str]]]:
    """(start, class) of what looks like a record by MARKER, known classes and others: cut at the ends of names, which is less to search."""
    known, others, at = [], [], 0
    for piece in data.split(b"+\0")[:-1]:
        at += len(piece)
        name = piece[len(piece.rstrip(WORD)) :]
        start = at - len(name) - 4
        if 0 < len(name) <= 64 and name[0] not in DIGITS and start >= DISPLAY_HEADER:
            text = name.decode("latin1")
            (known if text in CLASSES else others).append((start, text))
        at += 2
    return known, others


def _tiled(data: bytes) -> list[tuple[int, int, str, list[tuple], str | None]]:
    """(start, end, class, fields, error) of the records of a display. A body is decoded once for each end that it is given."""
    known, others = _marks(data)
    starts, seen, extra = [start for start, _ in known], {}, []
    for start, name in others:
        # only the known record that a candidate stands in can explain it
        k, at = bisect_right(starts, start + 4) - 1, start + 4
        if k >= 0:
            begin, end = starts[k], starts[k + 1] if k + 1 < len(starts) else len(data)
            if begin not in seen:
                seen[begin] = (end, *_decoded(data, begin, end, known[k][1]))
            typed = False
            for f in seen[begin][1]:
                if f[2] <= at < f[2] + f[3]:
                    typed = f[1] != "bytes"
                    break
            if typed:
                continue
        extra.append((start, name))
    chosen: list[tuple[int, str]] = []
    for start, name in sorted(known + extra) if extra else known:
        if chosen and start < chosen[-1][0] + 4 + len(chosen[-1][1]) + 2 and not (name in KNOWN and chosen[-1][1] in KNOWN):
            if name not in KNOWN:
                continue
            chosen.pop()
        chosen.append((start, name))
    out, last = [], len(data)
    for k, (start, name) in enumerate(chosen, 1):
        end = chosen[k][0] if k < len(chosen) else last
        held = seen.get(start)
        fields, error = held[1:] if held and held[0] == end else _decoded(data, start, end, name)
        out.append((start, end, name, fields, error))
    return out


def boundaries(data: bytes) -> list[tuple[int, str]]:
    """(start, class) of the records of a display, by the two passes."""
    return [(start, name) for start, _, name, _, _ in _tiled(data)]


def display_fields(path: str, data: bytes, names: frozenset[str] | None = None) -> list[tuple]:
    """Rows of FIELDS of a display; only those of fields in names, if given."""
    if not data.startswith(DISPLAY_MAGIC):
        raise ValueError(f"{path}: not a display")
    out, k = [], 0
    for start, end, name, fields, error in _tiled(data):
        k += 1
        for n, f in enumerate(fields):
            if names is None or f[0] in names:
                out.append((path, k, name, start, end, error, n, *f))
    return out


ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
TYPES = {name.strip("`"): kind for name, kind in (f.split(" ") for f in FIELDS.split(", "))}


def _fields_of(files: DataFrame, decode: Callable[..., list[tuple]], columns: tuple[str, ...] | None, names: tuple[str, ...] | None, rows: int = 10_000) -> DataFrame:
    """Rows that decode makes of each file, of which only the columns and the fields asked for leave Python."""
    held = [(k, name) for k, name in enumerate(TYPES) if columns is None or name in columns]
    schema = pa.schema([(name, ARROW[TYPES[name]]) for _, name in held])
    only = None if names is None else frozenset(names)

    def batch(found: list[tuple]) -> pa.RecordBatch:
        parts = list(zip(*found))
        return pa.RecordBatch.from_arrays([pa.array(parts[k], schema.field(name).type) for k, name in held], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []  # of many small files together
        for some in batches:
            for path, content in zip(some.column("path").to_pylist(), some.column("content").to_pylist()):
                found += decode(path, content, only)
                if len(found) >= rows:
                    yield from (batch(found[k : k + rows]) for k in range(0, len(found), rows))
                    found = []
        if found:
            yield batch(found)

    return files.select("path", "content").mapInArrow(run, ", ".join(f"`{name}` {TYPES[name]}" for _, name in held))


def decode_records(files: DataFrame, columns: tuple[str, ...] | None = None, names: tuple[str, ...] | None = None) -> DataFrame:
    """Every field of every record of displays (path, content), by FIELDS: typed values as text, refs with target and role.

    columns are those of FIELDS that are read further on, names the fields; all, if not given.
    """
    return _fields_of(files, display_fields, columns, names)


def field_coverage(fields: DataFrame, sizes: DataFrame, header: int = DISPLAY_HEADER) -> DataFrame:
    """(path, records, typed_bytes, unresolved_bytes, missing_bytes, errors): how fields tile files (path, length) after their headers.

    missing_bytes is 0 if every byte is in one field; less, if fields overlap.
    """
    raw, head = F.col("type") == "bytes", F.col("n") == 0  # every record has a first field
    sums = fields.groupBy("path").agg(
        F.count_if(head).alias("records"), F.sum(F.when(~raw, F.col("bytes")).otherwise(0)).alias("typed_bytes"), F.sum(F.when(raw, F.col("bytes")).otherwise(0)).alias("unresolved_bytes"),
        F.count_if(head & F.col("error").isNotNull()).alias("errors"),
    )
    joined = sizes.join(sums, "path", "left").na.fill(0, ["records", "typed_bytes", "unresolved_bytes", "errors"])
    return joined.select("path", "records", "typed_bytes", "unresolved_bytes", (F.greatest(F.col("length") - header, F.lit(0)) - F.col("typed_bytes") - F.col("unresolved_bytes")).alias("missing_bytes"), "errors")


def record_references(fields: DataFrame) -> DataFrame:
    """(path, id, n, field, role, target) of the references that are set, as the graph of displays takes them."""
    return fields.where("target is not null").select("path", "id", "n", "field", "role", "target")


#: Beginnings of submodel files, and the newest version whose records begin with a number of two bytes.
SUBMODEL_MAGIC, SHORT_VERSION = b"!!<gms>\n", 8


def normalised(path: str, data: bytes) -> bytes:
    """A graphic or submodel as a graphic: a submodel's records follow a header of any length, from its model on, and those of old
    versions begin with a number of two bytes instead of four. Bodies stay as they are."""
    if data.startswith(DISPLAY_MAGIC):
        return data
    if not data.startswith(SUBMODEL_MAGIC) or len(data) < 12:
        raise ValueError(f"{path}: neither a graphic nor a submodel")
    marks = [m for m in MARKER.finditer(data, 12) if m[0][:-2].decode("latin1") in KNOWN]
    first = next((k for k, m in enumerate(marks) if m[0] == b"Model+\0"), None)
    if first is None:
        raise ValueError(f"{path}: a submodel without a model")
    starts, head = [m.start() for m in marks[first:]], DISPLAY_MAGIC + struct.pack("<III", 0x10, 1, 0)
    if struct.unpack_from("<I", data, 8)[0] > SHORT_VERSION:
        return head + data[starts[0] - 4 :]
    ends = [s - 2 for s in starts[1:]] + [len(data)]
    return head + b"".join(data[s - 2 : s] + b"\0\0" + data[s:e] for s, e in zip(starts, ends))


def _submodel(path: str, data: bytes, names: frozenset[str] | None = None) -> list[tuple]:
    try:
        return display_fields(path, normalised(path, data), names)
    except ValueError:
        return []  # a library leaves out files that it can't read


def template_library(files: DataFrame, columns: tuple[str, ...] | None = None, names: tuple[str, ...] | None = None) -> DataFrame:
    """files (root, path, content), root by rank, to the fields of every template: FIELDS with the template's name in place of the path.

    Files are `name.m1`, whatever the case; of several of one name the first root's first path counts, whether it can be read or not.
    Each is decoded once, where its bytes are; columns and names as in decode_records.
    """
    name = F.lower(F.regexp_extract("path", r"([^/\\]*)\.[mM]1$", 1))
    first = files.withColumn("name", name).where("name <> ''").groupBy("name").agg(F.min_by("content", F.struct("root", "path")).alias("content"))
    return _fields_of(first.select(F.col("name").alias("path"), "content"), _submodel, columns, names).withColumnRenamed("path", "template")

"""Fixed-layout binary inputs as rows: archives, sheets, spec trailers, symbol libraries, configurations and displays.

Spark lists and reads the files (`binaryFile`, one row each) and spreads them over tasks; a small decoder turns the bytes
of one file into rows. What follows, from joining to checking coverage, is done on the rows. Layouts are little-endian.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plantlens.functions.numbers import decode_payload

#: Tokens and sizes of the formats.
HEADER, TRAILER, SPECS, ATTRIBUTES = 256, b"BCCo\xc5", b"BCCo\xc5SPC\xc5LIST", b"BCCo\xc5ATR\xc5LIST"
LIBRARY_BLOCK, DISPLAY_MAGIC, DISPLAY_HEADER = 512, b"m1gms4u\n", 20
MARKER = re.compile(rb"(?<![0-9A-Za-z_])[A-Za-z_][A-Za-z0-9_]{0,63}\+\0")
#: Limits of an archive and of one of its entries.
ENTRY_BYTES, ARCHIVE_BYTES = 200 << 20, 800 << 20
RECORD = (
    "path string, offset int, type int, length int, layer int, kind string, points array<struct<x:int,y:int>>, x1 int, y1 int, x2 int, y2 int, symbol string, ins_x int, ins_y int,"
    " rotation int, block int, tag string, reference string, text string, text_height int, style int, words array<int>"
)
_FIELDS = [f.split()[0] for f in re.sub(r"<[^>]*>+", "", RECORD).split(",")]


def read_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, modificationTime, length, content) of the files under a folder whose names fit the pattern; empty files have no row."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)


def decode_each(files: DataFrame, decode: Callable[[str, bytes], list[tuple]], schema: str) -> DataFrame:
    """Rows that decode makes of each file's path and content."""
    names = [f.name for f in SparkSession.active().createDataFrame([], schema).schema]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []  # of many small files together
            for path, content in zip(batch["path"], batch["content"]):
                rows += decode(path, bytes(content))
                if len(rows) >= 10_000:
                    yield pd.DataFrame(rows, columns=names).astype(object)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names).astype(object)

    return files.select("path", "content").mapInPandas(run, schema)


def _text(raw: bytes) -> str | None:
    """Printable characters of a padded field, trimmed; null if none is left."""
    return "".join(chr(c) if 32 <= c < 127 else " " for c in raw).strip() or None


def archive_entries(path: str, content: bytes) -> list[tuple]:
    """Entries of a ZIP; raises ValueError for paths that leave the archive and for sizes beyond the limits."""
    rows, total = [], 0
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for e in z.infolist():
            name = e.filename.replace("\\", "/")
            if name.startswith("/") or re.match("[A-Za-z]:", name) or ".." in name.split("/"):
                raise ValueError(f"{path}: unsafe entry {e.filename!r}")
            total += e.file_size
            if e.file_size > ENTRY_BYTES or total > ARCHIVE_BYTES:
                raise ValueError(f"{path}: entry {e.filename!r} goes beyond the limits")
            if not e.is_dir():
                rows.append((path, name, pd.Timestamp(*e.date_time), e.file_size, z.read(e)))
    return rows


def read_archives(archives: DataFrame) -> DataFrame:
    """(path, content) of ZIP files to (archive, path, modified, length, content) of their entries."""
    return decode_each(archives, archive_entries, "archive string, path string, modified timestamp, length long, content binary")


def _chain(data: bytes, start: int, end: int, least: int) -> Iterator[tuple[int, int]]:
    """(offset, bytes) along a chain of lengths in words; zero words between records are padding.

    Ends early, with (offset, -1), where a length can't be one.
    """
    at = start
    while at + 4 <= end:
        if data[at : at + 2] == b"\0\0":
            at += 2
            continue
        size = 2 * int.from_bytes(data[at + 2 : at + 4], "little")
        if size < 2 * least or at + size > end:
            yield at, -1
            return
        yield at, size
        at += size


def _record(path: str, data: bytes, at: int, size: int) -> tuple:
    body = data[at : at + size]
    w = struct.unpack(f"<{size // 2}H", body)
    r = dict.fromkeys(_FIELDS) | {"path": path, "offset": at, "type": w[0], "length": size, "layer": w[2], "kind": "unknown", "points": [], "words": list(w)}
    point = lambda i: {"x": w[i], "y": w[i + 1]}
    if w[0] == 1:
        r |= {"kind": "polyline", "style": w[3], "points": [point(i) for i in range(4, len(w) - 1, 2)]}
    elif w[0] in (2, 3) and len(w) >= 7:
        r |= {"kind": "primitive2", "points": [point(3), point(5)]}
    elif w[0] == 4 and len(w) >= 9:
        r |= {"kind": "primitive3", "points": [point(3), point(5), point(7)]}
    elif w[0] == 5 and len(w) >= 9:
        r |= dict(zip(("x1", "y1", "x2", "y2"), w[3:7])) | {"kind": "text", "text_height": w[7] & 0x7FFF, "rotation": w[8], "text": _text(body[18:])}
    elif 6 <= w[0] <= 12 and len(w) >= 15:
        r |= dict(zip(("x1", "y1", "x2", "y2"), w[3:7])) | {"kind": "symbol", "symbol": _text(body[14:22]), "ins_x": w[11], "ins_y": w[12], "rotation": w[13], "style": w[14]}
        if w[0] == 6 and len(w) > 15:
            r["block"] = w[15]
        elif w[0] == 8:
            r |= {"tag": _text(body[30:60]), "reference": _text(body[60:70])}
    else:
        r["text"] = _text(body[6:])
    return tuple(r[f] for f in _FIELDS)


def sheet_records(path: str, data: bytes) -> list[tuple]:
    end = data.find(TRAILER, HEADER)
    chain = _chain(data, HEADER, end if end >= 0 else len(data), 4)
    return [_record(path, data, at, size) for at, size in chain if size > 0]


def decode_sheets(files: DataFrame) -> DataFrame:
    """Records of sheets: one row for each record of the length chain, which ends where it breaks."""
    return decode_each(files, sheet_records, RECORD)


def record_coverage(files: DataFrame, records: DataFrame) -> DataFrame:
    """(path, stream_bytes, record_bytes, n_records, largest_gap) by a window over the records of each file."""
    before = F.lag(F.col("offset") + F.col("length"), 1, HEADER).over(Window.partitionBy("path").orderBy("offset"))
    gaps = records.withColumn("gap", F.col("offset") - before).groupBy("path").agg(F.sum("length").alias("record_bytes"), F.count("*").alias("n_records"), F.max("gap").alias("largest_gap"))
    place = F.locate("BCCoÅ", F.decode("content", "ISO-8859-1"), HEADER + 1)
    stream = F.when(place > 0, place - 1).otherwise(F.octet_length("content")) - HEADER
    return files.select("path", stream.alias("stream_bytes")).join(gaps, "path", "left")


def block_entries(records: DataFrame) -> DataFrame:
    """Table entries of type 7 records, 40 bytes each: path, offset, slot, reference, tag. Read from the words in SQL."""
    byte = F.flatten(F.transform("words", lambda w: F.array(w % 256, F.floor(w / 256).cast("int"))))
    text = lambda at, n: F.nullif(F.trim(F.array_join(F.transform(F.slice("b", at + 1, F.lit(n)), lambda c: F.when((c >= 32) & (c < 127), F.char(c)).otherwise(" ")), "")), F.lit(""))
    slots = F.sequence(F.lit(0), F.floor((F.col("length") - 32) / 40).cast("int") - 1)
    rows = records.where("type = 7 and length >= 72").withColumn("b", byte).select("path", "offset", "b", F.explode(slots).alias("slot"))
    at = 32 + 40 * F.col("slot")
    return rows.select("path", "offset", "slot", text(at, 10).alias("reference"), text(at + 10, 30).alias("tag")).where("reference is not null or tag is not null")


def trailer_entries(path: str, data: bytes) -> list[tuple]:
    """Entries of the spec list. Its header's size is found: only a chain that ends on the next token is one.

    Of several such sizes, the one with most sound entries, then most entries, then the smallest header.
    """
    start, end = data.find(SPECS), data.find(ATTRIBUTES)
    if start < 0 or end < start:
        return []
    best: tuple = ()
    for gap in range(97):
        at, found = start + len(SPECS) + gap, []
        while at + 6 <= end:
            words, block, code = struct.unpack_from("<HHH", data, at)
            if words < 3 or at + 2 * words > end:
                break
            found.append((path, at, 2 * words, block, code, data[at + 6 : at + 2 * words], gap))
            at += 2 * words
        if at == end and found:
            sound = sum(1 <= f[3] <= 9999 and 1 <= f[4] <= 255 for f in found)
            if not best or (sound, len(found)) > best[:2]:
                best = (sound, len(found), found)
    return best[2] if best else []


def decode_trailers(files: DataFrame) -> DataFrame:
    return decode_each(files, trailer_entries, "path string, offset int, length int, block int, fc int, payload binary, header int")


def spec_values(entries: DataFrame, schema: DataFrame) -> DataFrame:
    """Entries with the types of their code (fc, types array) to one row for each spec: number, type, value.

    A payload whose size isn't that of the types has no values, and `closed` false.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = [decode_payload(list(t), bytes(p)) if t is not None else None for t, p in zip(batch["types"], batch["payload"])]
            yield batch.drop(columns=["payload"]).assign(vals=[None if v is None else [float(x) for x in v] for v in values])

    joined = entries.join(schema.select("fc", "types"), "fc", "left").select("path", "block", "fc", "payload", "types")
    decoded = joined.mapInPandas(run, "path string, block int, fc int, types array<string>, vals array<double>")
    rows = decoded.withColumn("closed", F.col("vals").isNotNull()).select("path", "block", "fc", "closed", F.posexplode_outer(F.arrays_zip("types", "vals")).alias("p", "s"))
    return rows.select("path", "block", "fc", "closed", (F.col("p") + 1).alias("number"), F.col("s.types").alias("type"), F.col("s.vals").alias("value"))


def slot_kind(real, low, high):
    """Column: how four bytes read, given as float, low and high word: zero, float, integer or ambiguous."""
    as_float = (~F.isnan(real)) & (F.abs(real) >= 1e-4) & (F.abs(real) < 1e9)
    as_int = (high == 0) & (low > 0) & (low <= 30000)
    return F.when((low == 0) & (high == 0), "zero").when(as_float & as_int, "ambiguous").when(as_float, "float").when(as_int, "integer").otherwise("ambiguous")


def library_symbols(path: str, data: bytes) -> list[tuple]:
    """Directory entries of a symbol library with the records of their bodies."""
    rows = []
    for base in range(LIBRARY_BLOCK, len(data) - 15, LIBRARY_BLOCK):
        mark, count = struct.unpack_from("<HH", data, base + 12)
        if mark != 1 or not 1 <= count <= 31 or base + 16 + 16 * count > len(data):
            continue
        held = []
        for at in range(base + 16, base + 16 + 16 * count, 16):
            name, (block, word, six, words) = _text(data[at : at + 8]), struct.unpack_from("<HHHH", data, at + 8)
            start = (block - 1) * LIBRARY_BLOCK + (word - 1) * 2
            if not name or six != 6 or block < 1 or word < 1 or start + 2 * words > len(data):
                break
            held.append((path, name, start, 2 * words))
        else:
            rows += held
    out = []
    for path, name, start, size in rows:
        nine, six, head, stream, *box = struct.unpack_from("<8H", data, start)
        body = [(at, n) for at, n in _chain(data, start + 2 * head, start + size, 4) if n > 0]
        ins = struct.unpack_from("<HH", data, start + 24)
        out.append((path, name, start, size, *box, *ins, (nine, six) == (9, 6) and head + stream == size // 2, [at for at, _ in body], sum(n for _, n in body)))
    return out


def decode_libraries(files: DataFrame) -> DataFrame:
    return decode_each(files, library_symbols, "library string, name string, offset int, length int, x1 int, y1 int, x2 int, y2 int, ins_x int, ins_y int, sound boolean, records array<int>, record_bytes int")


def configuration_candidates(path: str, data: bytes) -> list[tuple]:
    """All even places from byte 512 on where (length, block, code) could stand."""
    words = np.frombuffer(data[: len(data) // 2 * 2], "<u2").astype(np.int64)
    if len(words) < 259:
        return []
    at = np.arange(256, len(words) - 2)
    n, block, code = words[at], words[at + 1], words[at + 2]
    ok = (n >= 3) & (n <= 400) & (at + n <= len(words)) & (block >= 1) & (block <= 9999) & (code >= 1) & (code <= 250)
    return [(path, int(2 * a), int(x), int(b), int(c)) for a, x, b, c in zip(at[ok], n[ok], block[ok], code[ok])]


def locate_configuration(files: DataFrame, anchors: DataFrame) -> DataFrame:
    """anchors (block, fc) with status FOUND, MISMATCH (a single candidate of another code) or NOT_FOUND, and the place."""
    found = decode_each(files, configuration_candidates, "path string, offset int, words int, block int, code int")
    joined = anchors.join(found, "block", "left").groupBy("block", "fc").agg(
        F.min(F.when(F.col("code") == F.col("fc"), F.struct("path", "offset"))).alias("hit"), F.count("code").alias("n"), F.min(F.struct("path", "offset", "code")).alias("other")
    )
    status = F.when(F.col("hit").isNotNull(), "FOUND").when(F.col("n") == 1, "MISMATCH").otherwise("NOT_FOUND")
    return joined.select("block", "fc", status.alias("status"), F.when(status == "FOUND", F.col("hit.offset")).when(status == "MISMATCH", F.col("other.offset")).alias("offset"), F.when(status == "MISMATCH", F.col("other.code")).alias("code"))


def display_markers(path: str, data: bytes) -> list[tuple]:
    """Record starts of a display: class names that end in `+` and a zero byte, each after a number of four bytes."""
    if not data.startswith(DISPLAY_MAGIC):
        raise ValueError(f"{path}: not a display")
    marks = [m for m in MARKER.finditer(data, DISPLAY_HEADER) if m.start() >= DISPLAY_HEADER + 4]
    ends = [m.start() - 4 for m in marks[1:]] + [len(data)]
    return [(path, k, m.start() - 4, end, m[0][:-2].decode("latin1"), int.from_bytes(data[m.start() - 4 : m.start()], "little"), data[m.end() : end]) for k, (m, end) in enumerate(zip(marks, ends), 1)]


def decode_displays(files: DataFrame) -> DataFrame:
    """(path, id, offset, end, class, preamble, body); bytes between the header and the first record are a coverage gap."""
    return decode_each(files, display_markers, "path string, id int, offset int, `end` int, class string, preamble long, body binary")


def hexdump(files: DataFrame) -> DataFrame:
    """(path, offset, hex, ascii) lines of 16 bytes, in SQL."""
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.octet_length("content") - 1, F.lit(0)), F.lit(16))).alias("offset")
    rows = files.select("path", "content", at).withColumn("bytes", F.substring("content", F.col("offset") + 1, F.lit(16)))
    hexed = F.rtrim(F.regexp_replace(F.hex("bytes"), "(..)", "$1 "))
    return rows.select("path", F.lower(F.lpad(F.hex("offset"), 8, "0")).alias("offset"), F.lower(hexed).alias("hex"), F.regexp_replace(F.decode("bytes", "ISO-8859-1"), "[^ -~]", ".").alias("ascii"))


def read_spreadsheet_rows(rows: DataFrame) -> DataFrame:
    """Rows of an I/O spreadsheet (loop_tag, device_tag, alias, address, AI, AO, DI, DO flags, description, ord) as points.

    The type is the one flagged column; the first row of each (loop tag, device tag, address, type) counts.
    """
    flagged = [F.when(F.coalesce(F.trim(F.col(t)), F.lit("")) != "", F.lit(t)) for t in ("AI", "AO", "DI", "DO")]
    kind = F.array_compact(F.array(*flagged))
    parts = F.regexp_extract("address", r"(\d+)\D+(\d+)\D+(\d+)", 0)
    keys = ["loop_tag", "device_tag", "address", "io_type"]
    typed = rows.withColumn("io_type", F.when(F.size(kind) == 1, kind[0])).where(parts != "")
    return typed.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))).where("__r = 1").select(*keys, "alias", "description")

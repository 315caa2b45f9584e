"""Smaller rules of loops, sheets, codes and reports, as columns and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Codes whose loop blocks carry an engineering-unit identifier, with the specification that holds it.
UNIT_SPECS = {30: 2, 80: 12}
#: Minutes after which a running job counts as interrupted, and the longest list and texts of a report.
STALE_MINUTES, LIST_CAP, TEXT_CAP = 3, 25, 500
#: Grammars of texts on sheets. Parameters by name and by number, the head of an output reference's text, its I/O
#: tag, its point, a device on its own and the target sheet, dates, names of sheets, and outputs of a block.
NAMED_PARAMETER = r"(?i)^\s*([A-Z][A-Z0-9._/-]{0,14})\s*=\s*(.+?)\s*$"
NUMBERED_PARAMETER = r"(?i)^\s*S(\d{1,2})(?:\s*[:=]\s*|\s+)(.+?)\s*$"
REFERENCE_HEAD = r"(?i)^OREF\s*"
REFERENCE_TAG = r"(?i)((?:AI|AO|DI|DO)\d[^/\s]*\/[A-Za-z0-9\-_]+)"
REFERENCE_POINT = r"([A-Z]{2}\d{2}-\d{2}\.\d{2})"
REFERENCE_DEVICE = r"(?i)\b(D?\d{2,}[A-Z][A-Z0-9\-_\/]*)"
REFERENCE_TARGET = r"\b(\d{5}[A-Z0-9]{2,})\b"
DATE = r"^\d{1,2}[-/]\d{1,2}[-/]\d{2}(\d{2})?$"
SHEET_NAME = r"(?i)([0-9A-Z]{8})\.CAD"
OUTPUT = r"^N(?:\s*\+\s*\d+)?$"


def loop_kinds(devices: DataFrame) -> DataFrame:
    """devices (loop, role) to (loop, kind): control with inputs and outputs, output with these only, else input."""
    has = devices.groupBy("loop").agg(*[F.coalesce(F.bool_or(F.col("role") == r), F.lit(False)).alias(r) for r in ("input", "output")])
    return has.select("loop", F.when(F.col("input") & F.col("output"), "control").when(F.col("output"), "output").otherwise("input").alias("kind"))


def on_sheet(sheet: Column, destinations: Column, wanted: Column) -> Column:
    """Whether a point stands on the wanted sheet, or one of its destinations has that sheet's stem."""
    stem = F.regexp_replace(F.upper(wanted), r"\.CAD\z", "")
    return (F.upper(F.coalesce(sheet, F.lit(""))) == F.upper(wanted)) | F.exists(destinations, lambda d: F.coalesce(F.upper(d).contains(stem), F.lit(False)))


def routable(edges: DataFrame) -> DataFrame:
    """Edges (source, target) that have an end at least."""
    return edges.where("source is not null or target is not null")


def reference_only(references: DataFrame, points: DataFrame) -> DataFrame:
    """Tags of references (raw) that no point has, without regard to case."""
    known = points.select(F.upper("raw").alias("__raw")).distinct()
    return references.join(known, F.upper("raw") == F.col("__raw"), "left_anti")


def unit_of_loop(loops: DataFrame, spec_values: DataFrame) -> DataFrame:
    """loops (loop, block, fc) with unit and status from spec_values (block, number, value)."""
    number = F.coalesce(*[F.when(F.col("fc") == fc, n) for fc, n in UNIT_SPECS.items()])
    held = spec_values.where(F.col("number").isin(*UNIT_SPECS.values()))
    found = loops.withColumn("number", number).join(held, ["block", "number"], "left")
    return found.select("loop", "block", "fc", F.concat(F.lit("EU id "), F.col("value").cast("string")).alias("unit"), F.when(F.col("value").isNull(), "UNRESOLVED").otherwise("EXTRACTED").alias("status"))


def module_stems(members: DataFrame) -> DataFrame:
    """members (loop, sheet) to (loop, module, status): the stem of the sheets where all that have one agree."""
    stem = F.concat_ws("-", *[F.nullif(F.regexp_extract("sheet", r"^(\d)(\d{2})(\d{2})", k), F.lit("")) for k in (1, 2, 3)])
    seen = members.groupBy("loop").agg(F.count_distinct(F.nullif(stem, F.lit(""))).alias("n"), F.min(F.nullif(stem, F.lit(""))).alias("stem"))
    return seen.select("loop", F.when(F.col("n") == 1, F.col("stem")).otherwise("").alias("module"), F.when(F.col("n") == 1, "DERIVED").otherwise("UNRESOLVED").alias("status"))


def field_status(fields: DataFrame) -> DataFrame:
    """fields (status, length) to the fields and bytes of each status, zeros included."""
    return fields.agg(*[x.alias(f"{n}_{s.lower()}") for s in ("KNOWN", "CANDIDATE", "UNRESOLVED") for n, x in (("fields", F.count_if(F.col("status") == s)), ("bytes", F.coalesce(F.sum(F.when(F.col("status") == s, F.col("length"))), F.lit(0))))])


def code_ordinals(blocks: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """blocks (keys, fc) with ordinal `fc_n`, n counting the blocks of a code in their order."""
    n = F.row_number().over(Window.partitionBy(*keys, "fc").orderBy(*order))
    return blocks.withColumn("ordinal", F.concat_ws("_", F.col("fc").cast("string"), n.cast("string")))


def capped(items: Column, most: int = LIST_CAP) -> Column:
    """The first items of a list for a report, and how many more there are."""
    more = F.array(F.concat(F.lit("... "), (F.size(items) - most).cast("string"), F.lit(" more")))
    return F.when(F.size(items) > most, F.concat(F.slice(items, 1, most), more)).otherwise(items)


def clipped(text: Column, most: int = TEXT_CAP) -> Column:
    """A message as a report shows it."""
    return F.substring(text, 1, most)


def every_nth(points: DataFrame, keys: list[str], order: list[str], budget: int) -> DataFrame:
    """Every n-th point of a key, n being as large as leaves `budget` of them or little more."""
    at, all_ = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1, F.count("*").over(Window.partitionBy(*keys))
    step = F.greatest(F.lit(1), F.floor(all_ / budget))
    return points.withColumns({"__at": at, "__step": step}).where("__at % __step = 0").drop("__at", "__step")


def parameters(strings: Column) -> Column:
    """Array of texts to an array of (key, value): `KEY = value`, else `Sn value`; the last of a key counts where it is first."""
    pair = lambda s, form, key: F.when(s.rlike(form), F.struct(key(F.regexp_extract(s, form, 1)).alias("key"), F.regexp_extract(s, form, 2).alias("value")))
    one = lambda s: F.coalesce(pair(s, NAMED_PARAMETER, F.upper), pair(s, NUMBERED_PARAMETER, lambda n: F.concat(F.lit("S"), n)))
    found = F.array_compact(F.transform(strings, one))
    last = lambda key: F.element_at(F.filter(found, lambda p: p["key"] == key), -1)
    return F.transform(F.array_distinct(F.transform(found, lambda p: p["key"])), last)


def output_offsets(texts: Column) -> Column:
    """Sorted distinct offsets k of outputs `N` or `N+k`."""
    kept = F.filter(texts, lambda t: t.rlike(OUTPUT))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda t: F.coalesce(F.nullif(F.regexp_extract(t, r"(\d+)\z", 1), F.lit("")).cast("int"), F.lit(0)))))


def boxes_intersect(a: Column, b: Column, pad: float = 0.0) -> Column:
    """Boxes (x1, y1, x2, y2) with a common inner point, b widened by pad."""
    return (a["x1"] < b["x2"] + pad) & (b["x1"] < a["x2"] + pad) & (a["y1"] < b["y2"] + pad) & (b["y1"] < a["y2"] + pad)


def segment_hits_box(s: Column, box: Column) -> Column:
    """Whether a segment (x1, y1, x2, y2) has a point in a box: its parts between the vertical and the horizontal sides meet."""

    def part(p, q, low, high):  # the least and the largest place, from 0 to 1, between two sides
        d = q - p
        ends = [(low - p) / F.nullif(d, F.lit(0.0)), (high - p) / F.nullif(d, F.lit(0.0))]
        inside = p.between(low, high)
        return F.when(d != 0, F.greatest(F.least(*ends), F.lit(0.0))).when(inside, 0.0), F.when(d != 0, F.least(F.greatest(*ends), F.lit(1.0))).when(inside, 1.0)

    (x0, x1), (y0, y1) = part(s["x1"], s["x2"], box["x1"], box["x2"]), part(s["y1"], s["y2"], box["y1"], box["y2"])
    return F.coalesce((F.greatest(x0, y0) <= F.least(x1, y1)) & x0.isNotNull() & y0.isNotNull(), F.lit(False))


def is_date_like(label: Column) -> Column:
    """Labels that are dates, not loop tags."""
    return F.coalesce(F.trim(label).rlike(DATE), F.lit(False))


def job_state(state: Column, updated: Column, now: Column) -> Column:
    """A running job that hasn't been updated for STALE_MINUTES has failed."""
    return F.when((state == "running") & (now - updated > F.expr(f"INTERVAL {STALE_MINUTES} MINUTES")), "failed").otherwise(state)


def listed_sheets(text: Column) -> Column:
    """Names of the sheets that a text lists, upper case, in their order."""
    return F.transform(F.regexp_extract_all(text, F.lit(SHEET_NAME), F.lit(1)), F.upper)


def output_reference(raw: Column) -> Column:
    """Struct of tag, point and target_cad of an output reference's text; null where nothing is left of it.

    Digits of the tag are no target, however many they are.
    """
    text = F.trim(F.regexp_replace(raw, REFERENCE_HEAD, ""))
    first = lambda form: F.nullif(F.regexp_extract(text, form, 1), F.lit(""))
    rest = F.regexp_replace(text, REFERENCE_TAG, " ")
    target = F.nullif(F.regexp_extract(rest, REFERENCE_TARGET, 1), F.lit(""))
    found = F.struct(F.coalesce(first(REFERENCE_TAG), first(REFERENCE_DEVICE)).alias("tag"), first(REFERENCE_POINT).alias("point"), target.alias("target_cad"))
    return F.when(text != "", found)

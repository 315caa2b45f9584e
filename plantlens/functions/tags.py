"""Column functions for tags, addresses, sheet names and paths. All are null for null and stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Grammars of tags and addresses.
IO_TAG = r"(?i)^(AI|AO|DI|DO)(\d+)?(?:-([A-Za-z0-9]+))?(?:/(.+))?\z"
LOOP_LABEL = r"(?i)^(\d{3})([A-Z]{1,6})-([A-Z]?)(\d{1,4}[A-Z]?)(?:\.\d+)?(?:_[A-Z]+)?\z"
DEVICE = r"^(\d{3})([A-Z]+)-?([A-Z]?)(\d{1,4}[A-Z]?)"
REFERENCE = r"(?i)^([A-Z0-9 ]{2})([A-Z0-9 ]{2})-([0-9 ]{2})\.([0-9 ]{2})\z"
LOCAL_ADDRESS, REMOTE = r"(?i)^block address of", r"(?i)\b(module|node|loop|pcu|remote)\b"
#: Extensions that are kinds of their own; all others are OTHER.
FILE_KINDS = ("CAD", "M1", "OUT", "REF", "XRF", "ERR", "CFG", "VFY", "LST", "LOG", "MHD", "MDC", "BND", "GES", "BAT")


def part(text: Column, pattern: str, group: int) -> Column:
    """A group of the first match; null where nothing matches or the group is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def parse_io_tag(raw: Column) -> Column:
    """Struct of raw, io_type, channel, slave, device_tag; parts that are missing are null."""
    return F.struct(raw.alias("raw"), F.upper(part(raw, IO_TAG, 1)).alias("io_type"), part(raw, IO_TAG, 2).alias("channel"), part(raw, IO_TAG, 3).alias("slave"), part(raw, IO_TAG, 4).alias("device_tag"))


def is_physical_io(raw: Column) -> Column:
    return F.coalesce(F.trim(raw).rlike(r"(?i)^(AI|AO|DI|DO)\d"), F.lit(False))


def io_bucket(*candidates: Column) -> Column:
    """The type that the first candidate with one begins with."""
    return F.coalesce(*[F.upper(part(c, r"(?i)^(AI|AO|DI|DO)", 1)) for c in candidates])


def base_name(path: Column) -> Column:
    """Upper-case file name without folders and the extension of sheets."""
    return F.upper(F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)\z", 1), r"(?i)\.CAD\z", ""))


def extension(path: Column) -> Column:
    return F.lower(part(path, r"\.([A-Za-z0-9]+)\z", 1))


def file_kind(ext: Column) -> Column:
    up = F.upper(ext)
    return F.when(up.isin(*FILE_KINDS), up).otherwise("OTHER")


def provenance(path: Column) -> Column:
    """Struct of loop, cpu and module from folders like L3, P7 and M5."""
    up = F.upper(path)
    return F.struct(*[part(up, rf"(?:^|[/\\])({letter}\d+)(?:[/\\]|\z)", 1).alias(name) for letter, name in (("L", "loop"), ("P", "cpu"), ("M", "module"))])


def _parts(tag: Column, pattern: str) -> Column:
    unit, number = F.coalesce(F.upper(part(tag, pattern, 3)), F.lit("")), F.regexp_replace(F.upper(part(tag, pattern, 4)), r"^0+(?=\d{3})", "")
    whole = F.concat(unit, number)
    return F.struct(part(tag, pattern, 1).alias("area"), F.upper(part(tag, pattern, 2)).alias("letters"), whole.alias("number"), F.regexp_replace(whole, r"(?<=\d)[A-Z]\z", "").alias("base"))


def loop_parts(tag: Column) -> Column:
    """Struct of area, letters, number and base (number without its last letter) of a loop label.

    Zeros in front are trimmed to three digits or more; all is null where the label doesn't parse.
    """
    return _parts(F.trim(tag), LOOP_LABEL)


def device_parts(tag: Column) -> Column:
    """The same of a device tag: upper case counts, the dash may be missing, and a signal suffix may follow."""
    return _parts(F.trim(tag), DEVICE)


def _canonical(p: Column) -> Column:
    return F.when(p["number"].isNotNull(), F.concat(p["area"], p["letters"], F.lit("-"), p["number"]))


def canonical_loop_tag(tag: Column) -> Column:
    return _canonical(loop_parts(tag))


def canonical_device(tag: Column) -> Column:
    return _canonical(device_parts(tag))


def compact(text: Column) -> Column:
    """Upper case without anything but letters and digits."""
    return F.regexp_replace(F.upper(text), "[^A-Z0-9]", "")


def squeeze(text: Column) -> Column:
    """Upper case, white space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(F.upper(text), r"\s+", " "))


def parse_reference(raw: Column) -> Column:
    """Struct of prefix, sheet, row and column of a 10-character address `PPSS-RR.CC`, null where it doesn't parse."""
    padded = F.rpad(raw, 10, " ")
    return F.struct(*[F.trim(part(padded, REFERENCE, k)).alias(n) for k, n in enumerate(("prefix", "sheet", "row", "column"), 1)])


def sheet_parts(name: Column) -> Column:
    """Struct of prefix (5), code (2) and suffix of a sheet's base name."""
    return F.struct(F.substring(name, 1, 5).alias("prefix"), F.substring(name, 6, 2).alias("code"), F.substring(name, 8, 1).alias("suffix"))


def output_address(text: Column) -> Column:
    """Address of an output text `N` or `N+k`, as N + k."""
    base, offset = F.regexp_extract(text, r"^(\d+)(?:\+(\d+))?\z", 1), F.regexp_extract(text, r"^(\d+)(?:\+(\d+))?\z", 2)
    return F.when(base != "", base.cast("long") + F.coalesce(F.try_to_number(F.nullif(offset, F.lit("")), F.lit("999999999")).cast("long"), F.lit(0)))


def differs_from_default(value: Column, default: Column) -> Column:
    """Numbers are compared as numbers, anything else as text without regard to case."""
    a, b = value.try_cast("double"), default.try_cast("double")
    return F.when(a.isNotNull() & b.isNotNull(), a != b).otherwise(~F.upper(F.trim(value)).eqNullSafe(F.upper(F.trim(default))))


def is_local_block_address(description: Column) -> Column:
    """Descriptions of block addresses in the module itself, not of remote ones."""
    return F.coalesce(description.rlike(LOCAL_ADDRESS) & ~description.rlike(REMOTE), F.lit(False))


def expand_keys(template: Column, values: Column) -> Column:
    """`$NAME$` replaced by the map's value; null if any name is missing. Parts between dollar signs alternate."""
    pieces = F.split(template, r"\$")
    filled = F.transform(pieces, lambda p, i: F.when(i % 2 == 1, F.try_element_at(values, p)).otherwise(p))
    return F.when(~F.exists(filled, lambda p: p.isNull()), F.array_join(filled, ""))


def instance_parameters(expression: Column) -> Column:
    """Map of `NAME "value"` pairs; of repeated names the last value counts."""
    names, values = (F.regexp_extract_all(expression, F.lit(r'(\w+)\s+"([^"]*)"'), F.lit(k)) for k in (1, 2))
    pairs = F.arrays_zip(names.alias("name"), values.alias("value"))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(names, i + 2, F.size(names)), lambda n: n == p["name"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["name"], p["value"])))


def wrap_text(text: Column, width: int) -> Column:
    """Lines of at most width characters, cut at white space where possible."""
    return F.transform(F.regexp_extract_all(text, F.lit(rf"(\S.{{0,{width - 2}}}\S(?=\s|\z)|\S{{1,{width}}})"), F.lit(1)), F.trim)

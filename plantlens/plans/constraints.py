"""Constraints over an extraction, each a query of its failures; nothing found means that the rule holds.

Tables: trailers (sheet, entries); blocks (sheet, block, fc, payload binary, layout_status, drawn, sources): fc is null without a trailer
entry, sources counts the entities that a block comes from; specs (sheet, block, number, label, type, default, range, tune,
description, raw_text, raw_hex, value double, status, byte_offset, target_block, target_fc, target_status); manual (fc, number, label,
type, default, range, tune, description); connections (id, status, source_block, target_block, sources); reported (fc): unknown codes
that were reported; runs (run, digest).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a value by its type; all others have two.
WIDTH = {"R": 4}
MANUAL_FIELDS = ("label", "type", "default", "range", "tune", "description")


def _ref(*columns: str) -> Column:
    return F.concat_ws(":", *[F.col(c).cast("string") for c in columns]).alias("ref")


def unsigned(data: Column) -> Column:
    """A little-endian whole number of up to seven bytes."""
    digits = F.hex(data)
    turned = F.array_join(F.transform(F.reverse(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(digits)), F.lit(2))), lambda k: F.substring(digits, k, F.lit(2))), "")
    return F.conv(turned, 16, 10).cast("long")


def real(data: Column) -> Column:
    """A little-endian number of single precision: sign, power and fraction taken apart."""
    bits = unsigned(data)
    sign, power, fraction = F.shiftright(bits, 31), F.shiftright(bits, 23).bitwiseAND(F.lit(255)), bits.bitwiseAND(F.lit((1 << 23) - 1))
    size = F.when(power == 0, fraction * F.lit(2.0**-149)).when(power == 255, F.when(fraction == 0, float("inf")).otherwise(float("nan"))).otherwise((1 + fraction * F.lit(2.0**-23)) * F.pow(F.lit(2.0), power - 127))
    return F.when(sign == 1, -size).otherwise(size)


def manual_layout(manual: DataFrame) -> DataFrame:
    """manual with each value's byte range (at, width), and the bytes of all values of its code (whole)."""
    width = F.lit(2)
    for kind, bytes_ in WIDTH.items():
        width = F.when(F.col("type") == kind, bytes_).otherwise(width)
    whole = Window.partitionBy("fc")
    before = whole.orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    sized = manual.withColumn("width", width)
    return sized.withColumns({"at": F.sum("width").over(before) - F.col("width"), "whole": F.sum("width").over(whole)})


def _matched(specs: DataFrame, blocks: DataFrame, manual: DataFrame) -> DataFrame:
    """specs of blocks with a code, each with `again_hex` and `again` from its block's bytes where the code's layout closes on them, `reason`
    (why its value doesn't come from them) and `differs` (from the manual). A row meets its block once, and the manual's row for its
    code and number; both rules read that.
    """
    c, empty = F.col, F.col("raw_text").isNull()
    layout = manual_layout(manual).select("fc", "number", *[c(f).alias(f"manual_{f}") for f in MANUAL_FIELDS if f in manual.columns], c("type").alias("held_type"), "at", "width", "whole", F.lit(True).alias("known"))
    codes = manual.select("fc").distinct().withColumn("in_manual", F.lit(True))
    found = specs.join(blocks.where("fc is not null").select("sheet", "block", "fc", "payload"), ["sheet", "block"]).join(codes, "fc", "left").join(layout, ["fc", "number"], "left")
    data = F.when(F.octet_length("payload") == c("whole"), F.substring("payload", (c("at") + 1).cast("int"), c("width").cast("int")))
    found = found.withColumn("data", data).withColumns({"again_hex": F.lower(F.hex("data")), "again": F.when(c("data").isNotNull(), F.when(c("held_type") == "R", real(c("data"))).otherwise(unsigned(c("data"))).cast("double"))})
    reason = (
        F.when(c("in_manual").isNull(), "NO_SCHEMA")
        .when(empty & (c("value").isNotNull() | c("raw_hex").isNotNull()), "VALUE_WITHOUT_TEXT")
        .when(empty & (c("status") == "EXTRACTED"), "EXTRACTED_WITHOUT_VALUE")
        .when(~empty & c("again_hex").isNull(), "NOT_IN_PAYLOAD")
        .when(~empty & (~F.lower("raw_hex").eqNullSafe(c("again_hex")) | ~c("value").eqNullSafe(c("again"))), "DIFFERS_FROM_PAYLOAD")
    )
    fields = [f for f in MANUAL_FIELDS if f in specs.columns and f in manual.columns]
    differs = reduce(lambda a, b: a | b, [~c(f).eqNullSafe(c(f"manual_{f}")) for f in fields], c("known").isNull())
    return found.withColumns({"reason": reason, "differs": differs})


def invented_values(specs: DataFrame, blocks: DataFrame, manual: DataFrame) -> DataFrame:
    """(ref, reason) of values that don't come from their block's bytes: joined by address and number with what decodes again there."""
    return _matched(specs, blocks, manual).where("reason is not null").select(_ref("sheet", "block", "number"), "reason")


def failures(tables: dict[str, DataFrame]) -> DataFrame:
    """(rule, ref) of all rules whose tables are given."""
    c, out, both = F.col, {}, None
    has = lambda *names: all(n in tables for n in names)
    t = tables
    if has("blocks", "trailers"):
        n = t["blocks"].where("fc is not null").groupBy("sheet").agg(F.count("*").alias("found"))
        out["trailer_coverage"] = t["trailers"].join(n, "sheet", "full_outer").where("coalesce(entries, 0) <> coalesce(found, 0)").select(_ref("sheet"))
    if has("blocks"):
        out["unique_blocks"] = t["blocks"].groupBy("sheet", "block").count().where("count > 1").select(_ref("sheet", "block"))
        out["sources_named"] = t["blocks"].where("drawn and sources = 0").select(_ref("sheet", "block"))
    if has("specs"):
        out["unique_specs"] = t["specs"].groupBy("sheet", "block", "number").count().where("count > 1").select(_ref("sheet", "block", "number"))
        out["offsets_named"] = t["specs"].where("status = 'EXTRACTED' and byte_offset is null").select(_ref("sheet", "block", "number"))
    if has("blocks", "manual"):
        known = t["manual"].select("fc").distinct()
        coded = t["blocks"].where("fc is not null")
        out["layout_closure"] = coded.join(known, "fc", "left_semi").where("layout_status is null or layout_status <> 'DECODED'").select(_ref("sheet", "block"))
        if has("reported"):
            out["unknown_codes_reported"] = coded.join(known, "fc", "left_anti").join(t["reported"], "fc", "left_anti").select(_ref("sheet", "block"))
    if has("specs", "blocks", "manual"):
        of_block = t["blocks"].where("fc is not null").select("sheet", "block", "fc")
        rules = F.filter(F.array(F.when(c("reason").isNotNull(), "no_invented_values"), F.when(c("differs"), "manual_match")), lambda x: x.isNotNull())
        both = _matched(t["specs"], t["blocks"], t["manual"]).where("reason is not null or differs").select(F.explode(rules).alias("rule"), _ref("sheet", "block", "number"))
        counts = t["specs"].groupBy("sheet", "block").agg(F.count("*").alias("n"))
        wanted = t["manual"].groupBy("fc").agg(F.count("*").alias("wanted"))
        out["spec_count"] = of_block.join(wanted, "fc").join(counts, ["sheet", "block"], "left").where("coalesce(n, 0) <> wanted").select(_ref("sheet", "block"))
    if has("specs", "blocks"):
        at = t["blocks"].groupBy(c("block").alias("target_block")).agg(F.count("*").alias("n"), F.min("fc").alias("its_fc"))
        aimed = t["specs"].where("target_status in ('RESOLVED_BLOCK', 'WIRED_INPUT') and target_block is not null").join(at, "target_block", "left")
        out["address_targets"] = aimed.where("n is null or n <> 1 or (target_fc is not null and not (its_fc <=> target_fc))").select(_ref("sheet", "block", "number"))
    if has("connections"):
        out["connections_traceable"] = t["connections"].where("sources = 0 or (status <> 'UNRESOLVED' and (source_block is null or target_block is null))").select(_ref("id"))
    if has("runs"):
        out["determinism"] = t["runs"].agg(F.count_distinct("digest").alias("n")).where("n > 1").select(F.lit("digests differ").alias("ref"))
    found = [df.select(F.lit(rule).alias("rule"), "ref") for rule, df in out.items()]
    return reduce(DataFrame.union, found if both is None else [*found, both])

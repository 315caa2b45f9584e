"""Drawings as an engineering model: flat tables of blocks, connections and references, and a summary of each sheet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.functions import symbols

#: What a reference's status means in the model.
EXTERNAL, OPEN = ("RESOLVED_EXTERNAL", "BOUNDARY_SIGNAL"), ("UNRESOLVED", "AMBIGUOUS")
JUNCTION_REACH = 4


def model_blocks(blocks: DataFrame, pins: DataFrame, parameters: DataFrame, junctions: DataFrame) -> DataFrame:
    """blocks (sheet, id, name, fc, number, x1..y2, library), pins (sheet, block, pin, direction), parameters (sheet, block, key, value) and
    junctions (sheet, id, kind, x, y) to (sheet, id, type, name, fc, number, x, y, width, height, inputs, outputs, ports, parameters, glyph).

    Boxes are one unit wide and high at least. Of several values of a parameter the largest stays. Connected junctions are
    blocks of their own.
    """
    c = F.col
    named = lambda direction: F.array_sort(F.collect_list(F.when(c("direction") == direction, c("pin"))))
    ports = pins.groupBy("sheet", c("block").alias("id")).agg(named("input").alias("inputs"), named("output").alias("outputs"), F.count("*").alias("ports"))
    values = parameters.groupBy("sheet", "block", "key").agg(F.max("value").alias("value")).groupBy("sheet", c("block").alias("id")).agg(F.array_sort(F.collect_list(F.struct("key", "value"))).alias("p"))
    none = F.array().cast("array<string>")
    drawn = blocks.join(ports, ["sheet", "id"], "left").join(values, ["sheet", "id"], "left").select(
        "sheet", c("id").cast("string").alias("id"), symbols.block_type(c("name")).alias("type"), "name", c("fc").cast("long").alias("fc"), c("number").cast("string").alias("number"), c("x1").cast("double").alias("x"), c("y1").cast("double").alias("y"),
        F.greatest(F.lit(1), c("x2") - c("x1")).cast("double").alias("width"), F.greatest(F.lit(1), c("y2") - c("y1")).cast("double").alias("height"), F.coalesce("inputs", none).alias("inputs"), F.coalesce("outputs", none).alias("outputs"),
        F.coalesce("ports", F.lit(0)).alias("ports"), F.map_from_entries(F.coalesce("p", F.array().cast("array<struct<key:string,value:string>>"))).alias("parameters"), F.when(c("library"), "AUTHENTIC").otherwise("FALLBACK").alias("glyph"),
    )
    joint = junctions.where("kind = 'connected'").select(
        "sheet", c("id").cast("string").alias("id"), F.lit("Junction").alias("type"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("long").alias("fc"), F.lit(None).cast("string").alias("number"),
        (c("x") - JUNCTION_REACH).cast("double").alias("x"), (c("y") - JUNCTION_REACH).cast("double").alias("y"), F.lit(2.0 * JUNCTION_REACH).alias("width"), F.lit(2.0 * JUNCTION_REACH).alias("height"), none.alias("inputs"), none.alias("outputs"),
        F.lit(0).cast("long").alias("ports"), F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>")).alias("parameters"), F.lit(None).cast("string").alias("glyph"),
    )
    return drawn.unionByName(joint)


def model_connections(connections: DataFrame, pins: DataFrame) -> DataFrame:
    """connections (sheet, id, type, from_kind, from_ref, to_kind, to_ref, relation) of type signal to (sheet, id, source_block, source_port, target_block,
    target_port, resolved, relation): ends at pins (sheet, id, block) are at their blocks, those at connectors at the connector."""
    c = F.col
    port = lambda end: pins.select("sheet", c("id").cast("string").alias(f"{end}_ref"), F.lit("pin").alias(f"{end}_kind"), c("block").cast("string").alias(f"{end}_block"))
    signal = connections.where("type = 'signal'").withColumns({f"{e}_ref": c(f"{e}_ref").cast("string") for e in ("from", "to")})
    found = signal.join(port("from"), ["sheet", "from_ref", "from_kind"], "left").join(port("to"), ["sheet", "to_ref", "to_kind"], "left")
    block = lambda e: F.coalesce(f"{e}_block", F.when(c(f"{e}_kind").isin("pin", "connector"), c(f"{e}_ref")))
    on_pin = lambda e: F.when(c(f"{e}_block").isNotNull(), c(f"{e}_ref"))
    return found.select(
        "sheet", c("id").cast("string").alias("id"), block("from").alias("source_block"), on_pin("from").alias("source_port"), block("to").alias("target_block"), on_pin("to").alias("target_port"),
        ((c("from_kind") != "dangling") & (c("to_kind") != "dangling")).alias("resolved"), F.when(c("relation") == "INFERRED", "INFERRED").otherwise("EXPLICIT").alias("relation"),
    )


def model_references(references: DataFrame) -> DataFrame:
    """references (sheet, id, connector, reference, tag, status) to (sheet, id, element, identifier, kind, resolved)."""
    status = F.col("status")
    kind = F.when(status == "RESOLVED_CROSS_SHEET", "cross_sheet").when(status.isin(*EXTERNAL), "external_io").when(status.isin(*OPEN), "unresolved").otherwise("local")
    return references.select(
        "sheet", F.col("id").cast("string").alias("id"), F.col("connector").cast("string").alias("element"), F.coalesce("reference", "tag", F.lit("")).alias("identifier"), kind.alias("kind"),
        (status.startswith("RESOLVED") | (status == "BOUNDARY_SIGNAL")).alias("resolved"),
    )


def model_summary(blocks: DataFrame, connections: DataFrame, references: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """(sheet, blocks, connections, references, unresolved, status) over all sheets of the tables; diagnostics: (sheet).

    Counts of the four tables are stacked and added up, so that rows are never multiplied.
    """
    def part(df: DataFrame, **counts) -> DataFrame:
        names = ("blocks", "connections", "references", "unresolved", "remarks")
        return df.groupBy("sheet").agg(*[(F.count_if(counts[n]) if n in counts else F.lit(0).cast("long")).alias(n) for n in names])

    every, open_ = F.lit(True), ~F.col("resolved")
    stacked = part(blocks, blocks=F.col("type") != "Junction").union(part(connections, connections=every, unresolved=open_)).union(part(references, references=every, unresolved=open_)).union(part(diagnostics, remarks=every))
    total = stacked.groupBy("sheet").agg(*[F.sum(n).alias(n) for n in ("blocks", "connections", "references", "unresolved", "remarks")])
    warned = (F.col("unresolved") > 0) | (F.col("remarks") > 0)
    return total.withColumn("status", F.when(warned, "COMPLETED_WITH_WARNINGS").otherwise("COMPLETED")).drop("remarks")

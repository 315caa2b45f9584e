"""Scenes: one nested row for each sheet, with the blocks, terminals, specifications and wires that belong together.

Ten relations are laid over one another as rows of one table and partitioned once, by sheet. Below that one exchange, two
folds need no further one: by block (a block's record, terminals, specs and outputs, a few each, are linked inside its row),
then by sheet. A sheet of more than `part_rows` rows is cut into parts by block, so that no task holds a sheet of any size;
links lie inside blocks, so none is cut.

Relations, all with `file`: blocks (block, name, fc, x, y); records (block, fc): trailer entries; terminals (block, side, label,
pin, association, reason, x, y); specs (block, number, label, value, status, target_status); outputs (block, offset, label); wires
(id); connections (id, wire, from_block, to_block, status); references (id, target, status); channels (id, text); unknown (id,
kind). block is a block's address, ids are strings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantlens.operators import graph

#: Sheets over part_rows rows up to which their table is broadcast; rows of a task, which folds them twice and shouldn't spill them.
BROADCAST_SHEETS, TASK_ROWS = 1 << 16, 1 << 19
BLOCK_RELATIONS = ("blocks", "records", "terminals", "specs", "outputs")
SHEET_RELATIONS = ("wires", "connections", "references", "channels", "unknown")


def _stacked(relations: dict[str, DataFrame], part_rows: int) -> DataFrame:
    """All rows as (file, part, block, one struct column for each relation), partitioned by (file, part)."""
    kinds = [*BLOCK_RELATIONS, *SHEET_RELATIONS]
    rows = []
    for kind in kinds:
        df = relations[kind]
        own = F.col("block") if kind in BLOCK_RELATIONS else F.lit(None).cast("long")
        held = F.struct(*[F.col(c) for c in df.columns if c not in ("file", "block")])
        place = F.xxhash64(own) if kind in BLOCK_RELATIONS else F.xxhash64("id")
        rows.append(df.select("file", own.cast("long").alias("block"), place.alias("place"), held.alias(kind)))
    counts = graph.stored(reduce(DataFrame.union, [r.select("file") for r in rows]).groupBy("file").agg(F.count("*").alias("n")))
    total, found = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > part_rows)).first()
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    part = F.lit(0)
    if found:  # a join whose size Spark doesn't know would move all rows once more
        large = counts.where(F.col("n") > part_rows).select("file", F.ceil(F.col("n") / part_rows).alias("parts"))
        stacked = stacked.join(F.broadcast(large) if found <= BROADCAST_SHEETS else large, "file", "left")
        part = F.coalesce(F.pmod("place", "parts"), F.lit(0)).cast("int")
    tasks = -(-total // TASK_ROWS)
    return stacked.withColumn("part", part).drop("place", "parts").repartition(*([tasks] if tasks > 1 else []), "file", "part")


def _sorted(kind: str) -> Column:
    return F.array_sort(F.collect_list(kind))


def _first_match(items: Column, test) -> Column:
    return F.get(F.filter(items, test), F.lit(0))


def assemble(relations: dict[str, DataFrame], part_rows: int = 1 << 16) -> DataFrame:
    """(file, part, blocks, wires, connections, references, channels, unknown, unresolved, counts).

    blocks are structs: address, type (function_block if there is a record, else symbol), name, fc (the record's, else the
    drawing's), drawn, terminals, specs (each with the label's input terminal), sub_blocks (an address for each output, with
    its terminal) and wires (those of connections go by their own ids). unresolved: (kind, id, status, reason) of terminals
    without a place, specs without a value, addresses without a target, unknown records, references and connections without
    ends. counts: rows of each relation, none is lost; rows of a block that isn't drawn make one that isn't `drawn`.
    """
    c = F.col
    stacked = _stacked(relations, part_rows)
    whole = ["file", "part"]
    name = F.concat_ws(":", "file", c("block").cast("string"))
    by_block = stacked.groupBy(*whole, "block").agg(
        F.min("blocks").alias("drawn"), F.count("blocks").alias("n_blocks"), F.min("records").alias("record"), F.count("records").alias("n_records"),
        *[_sorted(k).alias(k) for k in ("terminals", "specs", "outputs", *SHEET_RELATIONS)],
    )
    terminal = lambda side, label: _first_match(c("terminals"), lambda t: (t["side"] == side) & (t["label"] == label))
    specs = F.transform("specs", lambda s: F.struct(*[s[k].alias(k) for k in ("number", "label", "value", "status", "target_status")], terminal("input", s["label"]).alias("terminal")))
    outputs = F.transform("outputs", lambda o: F.struct((c("block") + o["offset"]).alias("address"), o["label"].alias("label"), terminal("output", o["label"]).alias("terminal")))
    node = F.when(
        c("block").isNotNull(),
        F.struct(
            c("block").alias("address"), F.when(c("record").isNotNull(), "function_block").otherwise("symbol").alias("type"), c("drawn.name").alias("name"), F.coalesce("record.fc", "drawn.fc").alias("fc"),
            c("drawn").isNotNull().alias("drawn"), c("terminals").alias("terminals"), specs.alias("specs"), outputs.alias("sub_blocks"),
        ),
    )
    issue = lambda kind, id_, status, reason: F.struct(F.lit(kind).alias("kind"), id_.alias("id"), status.cast("string").alias("status"), reason.cast("string").alias("reason"))
    lost = lambda t: t["association"].isin("UNRESOLVED", "CONFLICT")
    at = lambda x: F.concat_ws(".", name, x.cast("string"))
    of_file = lambda x: F.concat_ws(":", "file", x)
    found = F.concat(
        F.transform(F.filter("terminals", lost), lambda t: issue("terminal", at(F.coalesce(t["label"], t["pin"])), t["association"], t["reason"])),
        F.transform(F.filter("specs", lambda s: s["status"] != "EXTRACTED"), lambda s: issue("specification_value", at(s["label"]), s["status"], F.lit(None))),
        F.transform(F.filter("specs", lambda s: s["target_status"] == "UNRESOLVED"), lambda s: issue("block_address_target", at(s["label"]), s["target_status"], s["value"])),
        F.transform("unknown", lambda u: issue("unknown_record", of_file(u["id"]), F.lit("RAW_ONLY"), u["kind"])),
        F.transform(F.filter("references", lambda r: r["status"].isin("UNRESOLVED", "AMBIGUOUS")), lambda r: issue("reference", of_file(r["id"]), r["status"], r["target"])),
        F.transform(F.filter("connections", lambda k: k["from_block"].isNull() | k["to_block"].isNull()), lambda k: issue("connection", of_file(k["id"]), k["status"], F.lit(None))),
    )
    linked = by_block.select(*whole, "n_blocks", "n_records", node.alias("node"), found.alias("found"), "terminals", "specs", "outputs", *SHEET_RELATIONS)
    count = lambda k: F.sum(F.size(k)).alias(f"n_{k}")
    sheet = linked.groupBy(*whole).agg(
        F.array_sort(F.collect_list("node")).alias("blocks"), *[F.array_sort(F.flatten(F.collect_list(k))).alias(k) for k in SHEET_RELATIONS], F.array_sort(F.flatten(F.collect_list("found"))).alias("unresolved"),
        F.sum("n_blocks").alias("n_blocks"), F.sum("n_records").alias("n_records"), *[count(k) for k in ("terminals", "specs", "outputs", *SHEET_RELATIONS)],
    )
    kinds = [*BLOCK_RELATIONS, *SHEET_RELATIONS]
    return sheet.select(*whole, "blocks", *SHEET_RELATIONS, "unresolved", F.struct(*[c(f"n_{k}").alias(k) for k in kinds]).alias("counts"))


def scene_digest(scenes: DataFrame) -> DataFrame:
    """One row for each (file, part): the counts of all relations, what is linked, and a hash of all unresolved items."""
    every = lambda field, test: F.aggregate("blocks", F.lit(0), lambda n, b: n + F.size(F.filter(b[field], test)))
    has = lambda x: x["terminal"].isNotNull()
    issues = F.array_join(F.transform("unresolved", lambda u: F.concat_ws("|", u["kind"], u["id"], u["status"], F.coalesce(u["reason"], F.lit("")))), "\n")
    return scenes.select(
        "file", "part", "counts.*", F.size(F.filter("blocks", lambda b: b["type"] == "function_block")).alias("function_blocks"), every("specs", has).alias("specs_at_terminals"),
        every("sub_blocks", has).alias("sub_blocks_at_terminals"), F.size("unresolved").alias("n_unresolved"), F.sha2(issues, 256).alias("unresolved_sha256"),
    )

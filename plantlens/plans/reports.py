"""Reviewable tables: logic records, loop list cells, title texts, code usage, module-wide connections and defects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantlens.functions import evidence, tags
from plantlens.functions.tags import part
from plantlens.operators import aggregates, ordering

#: The columns of the Loop List, in order.
LOOP_COLUMNS = (
    "$(PACKAGE)", "Process Area ID", "$(EXE)", "$(CTRLROOM)", "$(ALGROUP)", "$(NAME40_1)", "$(TAG)", "$(CARDTYPE1)", "$(DEVICETAG1)", "$(DEVICETAG1:MIN)", "$(DEVICETAG1:MAX)", "$(DEVICETAG1:UNIT)",
    "$(CARDTYPE2)", "$(DEVICETAG2)", "$(DEVICETAG2:MIN)", "$(DEVICETAG2:MAX)", "$(DEVICETAG2:UNIT)",
)

#: Names of objects in display strings, and those that later tags belong to.
OBJECT_NAME, OBJECT_START = r"^(toba_|TOBA_|dupont_|G_|_FP|Marker|ModInst|Model)|_MSDD|_FB|_LR", "^(toba_|TOBA_|dupont_)"
#: Fixed value: how a tag stands in a display string.
DISPLAY_TAG = r'(?i)TAG\s+"([^"]+)"'
#: Fixed value: the note of records of sheets without blocks.
SHEET_NOTE = "Sheet-level extraction (no explicit function block records)"


def loop_cells(rows: DataFrame) -> DataFrame:
    """Rows (loop_tag, input, output as struct of description, io_type, device_tag) as the text cells of the Loop List.

    Only name, tag, card types and device tags are filled; all other columns stay blank.
    """
    filled = {"$(NAME40_1)": "input.description", "$(TAG)": "loop_tag", "$(CARDTYPE1)": "input.io_type", "$(DEVICETAG1)": "input.device_tag", "$(CARDTYPE2)": "output.io_type", "$(DEVICETAG2)": "output.device_tag"}
    return rows.where("loop_tag is not null").select(*[F.coalesce(F.col(filled[c]), F.lit("")).alias(c) if c in filled else F.lit("").alias(c) for c in LOOP_COLUMNS])


def enrich_points(points: DataFrame, sheets: DataFrame, blocks: DataFrame) -> DataFrame:
    """points (point, sheet, device_tag) with the description of their sheet and the block that belongs to the device.

    sheets: sheet, description; blocks: sheet, ord, block, device_tag, refs. A block belongs if it has the device's tag or
    names it in a reference; where none does, the sheet's first block is taken, and `matched` is false.
    """
    name = lambda c: tags.base_name(F.col(c))
    on = points.withColumn("__s", name("sheet")).join(blocks.select(name("sheet").alias("__s"), "ord", "block", F.col("device_tag").alias("__tag"), "refs"), "__s", "left")
    own = F.coalesce((F.upper("__tag") == F.upper("device_tag")) | F.exists("refs", lambda r: r.contains(F.col("device_tag"))), F.lit(False))
    best = on.groupBy("point", "sheet", "device_tag", "__s").agg(F.min(F.struct((~own).alias("other"), "ord", "block")).alias("b"))
    described = sheets.groupBy(name("sheet").alias("__s")).agg(F.min("description").alias("description"))
    return best.join(described, "__s", "left").select("point", "sheet", "device_tag", "description", "b.block", (F.col("b.block").isNotNull() & ~F.col("b.other")).alias("matched"))


def logic_records(sheets: DataFrame, blocks: DataFrame, io: DataFrame) -> DataFrame:
    """One row for each block with its specs S0..S9 as columns, and one for each sheet without blocks that has anything else.

    sheets: sheet, description, loop_tag; blocks: sheet, block, fc, specs (map of name to text); io: sheet, io_type, raw.
    """
    named = blocks.join(sheets, "sheet", "left").select("sheet", "loop_tag", "description", "block", "fc", *[F.try_element_at("specs", F.lit(f"S{k}")).alias(f"s{k}") for k in range(10)], F.lit(None).cast("string").alias("notes"))
    side = lambda *kinds: F.array_sort(F.collect_set(F.when(F.col("io_type").isin(*kinds), F.col("raw"))))
    refs = io.groupBy("sheet").agg(side("AI", "DI").alias("input_refs"), side("AO", "DO").alias("output_refs"))
    bare = sheets.join(blocks.select("sheet").distinct(), "sheet", "left_anti").join(refs, "sheet", "left").where("input_refs is not null or description is not null")
    return named.unionByName(bare.withColumn("notes", F.lit(SHEET_NOTE)), allowMissingColumns=True)


def title_descriptions(fields: DataFrame) -> DataFrame:
    """fields (sheet, label, value, x, y, label_y) to (sheet, area, page): the line right under the caption, and those below.

    Lines of the page run from top to bottom, then from left to right.
    """
    lines = fields.where(F.col("label").rlike(r"(?i)^DESCRIPTION\z")).withColumn("near", F.col("label_y") - F.col("y") < 30)
    text = lambda near: F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("near") == near, F.struct((-F.col("y")).alias("a"), "x", "value")))), lambda s: s["value"]), " "), F.lit(""))
    return lines.groupBy("sheet").agg(text(True).alias("area"), text(False).alias("page"))


def code_usage(blocks: DataFrame, specs: DataFrame) -> DataFrame:
    """(fc, name, n_blocks, n_sheets, n_changed): use of each code, and how many of its specs differ from their default.

    blocks: fc, sheet, ord, name; specs: fc, value, default.
    """
    use = blocks.groupBy("fc").agg(F.min_by("name", F.when(F.coalesce(F.col("name"), F.lit("")) != "", F.col("ord"))).alias("name"), F.count("*").alias("n_blocks"), F.count_distinct("sheet").alias("n_sheets"))
    changed = specs.groupBy("fc").agg(F.count_if(tags.differs_from_default(F.col("value"), F.col("default"))).alias("n_changed"))
    return use.join(changed, "fc", "left").withColumn("n_changed", F.coalesce("n_changed", F.lit(0)))


def unknown_codes(blocks: DataFrame, known: DataFrame) -> DataFrame:
    """(fc, blocks, files) of codes without a schema, as sorted sets."""
    return blocks.join(known.select("fc").distinct(), "fc", "left_anti").where("fc is not null").groupBy("fc").agg(F.array_sort(F.collect_set("block")).alias("blocks"), F.array_sort(F.collect_set("sheet")).alias("files"))


def name_conflicts(blocks: DataFrame) -> DataFrame:
    """Symbol names that stand for several codes."""
    return blocks.groupBy("symbol").agg(F.count_distinct("fc").alias("n_codes"), F.count("*").alias("n")).where("n_codes > 1")


def count_text(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and counts as `A 3, B 1`, by value."""
    n = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(value).alias("v"), "n"))), lambda x: F.concat_ws(" ", x["v"].cast("string"), x["n"].cast("string"))), ", ").alias("counts"))


def bounding_boxes(boxes: DataFrame, keys: list[str]) -> DataFrame:
    return boxes.groupBy(*keys).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def standard_spacing(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """(keys, spacing, n): the most frequent distance between neighbours, in halves; the smallest on ties."""
    step = F.col(at) - F.lag(at).over(Window.partitionBy(*keys).orderBy(at))
    steps = rows.withColumn("spacing", F.round(step * 2) / 2).where("spacing > 0").groupBy(*keys, "spacing").agg(F.count("*").alias("n"))
    return ordering.dedupe_first(steps, keys, [F.desc("n"), "spacing"])


def common_pitch(values: Column) -> Column:
    """Greatest common divisor of an array of whole numbers, 0 for none; Euclid's steps are counted out, 96 are enough for 64 bits."""
    def gcd(a: Column, b: Column) -> Column:
        pair = F.aggregate(F.sequence(F.lit(1), F.lit(96)), F.struct(a.alias("a"), b.alias("b")), lambda p, _: F.when(p.b == 0, p).otherwise(F.struct(p.b.alias("a"), F.try_mod(p.a, p.b).alias("b"))))
        return pair.a

    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, v: gcd(acc, F.abs(v.cast("long"))))


def cross_sheet_connections(members: DataFrame, references: DataFrame) -> DataFrame:
    """Connections over references: (from_ref, to_ref, from_sheet, to_sheet, status).

    members: net, sheet, ref, kind, role, status; references: connector, partner, status. The driver of the net that has
    the connector drives the pins of the partner's net. A reference without a partner keeps a row without a sink.
    """
    side = lambda role, name: members.where((F.col("kind") == "pin") & (F.col("role") == role)).select("net", F.col("ref").alias(f"{name}_ref"), F.col("sheet").alias(f"{name}_sheet"), F.col("status").alias(f"{name}_status"))
    of = members.where("kind = 'connector'").select("net", F.col("ref").alias("connector"))
    start = references.withColumnRenamed("status", "ref_status").join(of, "connector").join(side("driver", "from"), "net", "left").drop("net")
    end = start.join(of.select(F.col("connector").alias("partner"), "net"), "partner", "left").join(side("sink", "to"), "net", "left")
    status = evidence.weakest(F.col("ref_status"), F.coalesce("from_status", F.lit("UNRESOLVED")), F.coalesce("to_status", F.lit("UNRESOLVED")))
    return end.select("connector", "partner", "from_ref", "to_ref", "from_sheet", "to_sheet", status.alias("status"))


def broken_nets(members: DataFrame) -> DataFrame:
    """(net, code): nets with several output pins, and nets that drive pins without any driver."""
    pins = members.groupBy("net").agg(F.count_if((F.col("kind") == "pin") & (F.col("role") == "driver")).alias("outputs"), F.count_if(F.col("role") == "driver").alias("drivers"), F.count_if((F.col("kind") == "pin") & (F.col("role") == "sink")).alias("sinks"))
    code = F.when(F.col("outputs") > 1, "SEVERAL_OUTPUTS").when((F.col("drivers") == 0) & (F.col("sinks") > 0), "NO_DRIVER")
    return pins.withColumn("code", code).where("code is not null").select("net", "code")


def detect_codes(strings: DataFrame, codes: DataFrame) -> DataFrame:
    """(path, fc, first_at): codes whose name stands in a string as whole words.

    Strings and names meet by their first word, in upper case, so that strings don't meet all codes.
    """
    words = strings.select("path", "ord", F.upper("text").alias("t")).withColumn("w", F.explode(F.array_distinct(F.split("t", r"[^A-Z0-9_]+"))))
    named = codes.select("fc", F.upper("name").alias("name")).withColumn("w", F.regexp_extract("name", r"^([A-Z0-9_]+)", 1))
    hits = words.join(F.broadcast(named), "w").where(F.expr(r"concat(' ', regexp_replace(t, '[^A-Z0-9_]+', ' '), ' ') like concat('% ', regexp_replace(name, '[^A-Z0-9_]+', ' '), ' %')"))  # as many codes as the manual has
    return hits.groupBy("path", "fc").agg(F.min("ord").alias("first_at"))


def display_strings(runs: DataFrame) -> DataFrame:
    """Runs (path, ord, text) of displays by role: tag (with the object named last before it), object or text."""
    tag = part(F.col("text"), DISPLAY_TAG, 1)
    is_object = F.col("text").rlike(OBJECT_NAME)
    role = F.when(tag.isNotNull(), "tag").when(is_object, "object").when(F.length("text").between(3, 79) & ~F.col("text").rlike("(?i)m1gms"), "text")
    carried = ordering.carry_forward(runs, F.when(F.col("text").rlike(OBJECT_START), F.col("text")), "object", ["path"], ["ord"])
    return carried.select("path", "ord", role.alias("role"), F.coalesce(tag, F.trim("text")).alias("value"), F.when(tag.isNotNull(), F.col("object")).alias("object")).where("role is not null")


def grouped_export(files: DataFrame, members: DataFrame, categories: DataFrame) -> DataFrame:
    """files (file) by category, in the categories' order; files in none are `uncategorized`, after all others."""
    placed = files.join(members, "file", "left").join(categories, "category", "left")
    return placed.select("file", F.coalesce("category", F.lit("uncategorized")).alias("category"), F.coalesce("place", F.lit(2**31 - 1)).alias("place")).orderBy("place", "file")


def category_faults(files: DataFrame, members: DataFrame) -> DataFrame:
    """Members that are no files, and files in several categories."""
    return aggregates.issues({
        "UNKNOWN_FILE": ("error", members.join(files.select("file"), "file", "left_anti").select(F.col("file").alias("ref"))),
        "SEVERAL_CATEGORIES": ("error", members.groupBy("file").agg(F.count_distinct("category").alias("n")).where("n > 1").select(F.col("file").alias("ref"))),
    })


def plot_agreement(labels: DataFrame, blocks: DataFrame, reach: float = 80.0) -> DataFrame:
    """(sheet, block, same_set, same_order): whether the texts plotted at a block are its specs.

    labels: sheet, text, x, y; blocks: sheet, block, x, y, specs (in order). A label counts for its nearest block.
    """
    from plantlens.operators.joins import near

    right = blocks.select("sheet", "block", F.col("x").alias("right_x"), F.col("y").alias("by"))
    pairs = near(labels, right, ["sheet"], "x", reach).withColumn("d", F.hypot(F.col("x") - F.col("right_x"), F.col("y") - F.col("by"))).where(F.col("d") < reach)
    nearest = pairs.groupBy("sheet", "text", "x", "y").agg(F.min_by("block", F.struct("d", "block")).alias("block"))
    plotted = nearest.groupBy("sheet", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("k"), "x", "text"))), lambda t: t["text"]).alias("plotted"))
    joined = blocks.join(plotted, ["sheet", "block"])
    return joined.select("sheet", "block", (F.array_sort("specs") == F.array_sort("plotted")).alias("same_set"), (F.col("specs") == F.col("plotted")).alias("same_order"))


def document_defects(scene: dict[str, DataFrame], document: dict[str, DataFrame]) -> DataFrame:
    """(relation, defect, ref): for each relation, rows (ref, text) of the scene that the document lacks, has besides, or has otherwise."""
    out = []
    for name in scene:
        s, d = scene[name].select("ref", F.col("text").alias("a")), document[name].select("ref", F.col("text").alias("b"))
        both = s.withColumn("__s", F.lit(1)).join(d.withColumn("__d", F.lit(1)), "ref", "full_outer")
        defect = F.when(F.col("__d").isNull(), "MISSING").when(F.col("__s").isNull(), "INVENTED").when(~F.col("a").eqNullSafe(F.col("b")), "ALTERED")
        twice = document[name].groupBy("ref").count().where("count > 1").select(F.lit(name).alias("relation"), F.lit("REPEATED").alias("defect"), "ref")
        out += [both.select(F.lit(name).alias("relation"), defect.alias("defect"), "ref").where("defect is not null"), twice]
    return reduce(DataFrame.unionByName, out)

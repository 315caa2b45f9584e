"""Terminals of blocks: which drawn pin carries which label of the manual, and where a label's terminal lies.

Glyphs have no labels, so each label is claimed by the first of five kinds of evidence that has an answer; a label that one
kind has taken is closed to all later ones. Every kind is a join of its own that brings one row for a label at most:

* WIRE_SPEC_MATCH (EXPLICIT): a wire from a driving block meets exactly one address spec that names the driver's output;
* TEMPLATE_FROM_EXPLICIT (DERIVED): the label is proven at one single place on instances of the same symbol and size. If
  instances prove several places, the label is in CONFLICT, and no weaker evidence is asked;
* EXACT_PIN_COUNT (DERIVED): a side has as many drawn pins as labels, taken from top to bottom;
* PITCH_SLOT (INFERRED): labels lie on a grid that all rows witnessed on instances of the symbol fit;
* GLYPH_PITCH (INFERRED): nothing is wired; rows at the module's pitch from the top of the symbol.

Joins are merged, none is broadcast: tables of blocks and labels compress so well that they look small enough to be collected.

Places are relative to a block's insertion point, y upwards. Sides are `input` (left) and `output` (right).

blocks (block, name, key, address, left, right, low, high, rotated, multiple): key is name and size; the box is relative;
multiple is the manual's input spacing in standard pitches, or null. pins (block, x, y, pin, wired): drawn pins have a name,
those known from other instances none; (block, x, y) is unique. labels (block, side, n, label): n counts from the top.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantlens.operators import graph, ordering
from plantlens.plans.reports import common_pitch

#: Parts of a box's width that are its sides, the least pitch, the slack of a box, and the distance of the top row
#: from the top of a symbol without wires.
LEFT, RIGHT = 0.3, 0.7
LEAST_PITCH, SLACK, TOP_INSET = 10, 2, 25
#: Why a side has no grid.
REFUSALS = ("NO_LABELS", "NO_PIN", "GLYPH_OUTSIDE_BOX", "NO_PITCH", "AMBIGUOUS_PITCH", "NO_PITCH_FITS", "FIRST_ROW_ABOVE_INSERTION", "TOP_ROW_BELOW_INSERTION", "ROW_OFF_GRID")


def sided_pins(pins: DataFrame, blocks: DataFrame) -> DataFrame:
    """pins with key, name and side of their block; pins in its middle have no side and are left out."""
    part = (F.col("x") - F.col("left")) / F.greatest(F.lit(1), F.col("right") - F.col("left"))
    side = F.when(part <= LEFT, "input").when(part >= RIGHT, "output")
    return pins.join(blocks.select("block", "name", "key", "left", "right").hint("merge"), "block").withColumn("side", side).drop("left", "right").where("side is not null")


def wired_claims(links: DataFrame, specs: DataFrame, offsets: DataFrame, blocks: DataFrame, labels: DataFrame) -> DataFrame:
    """(block, side, label, x, y, ord): labels that wires prove.

    links (ord, block, x, y, driver, driver_x, driver_y): a wired sink pin and its driver; specs (block, label, value): address
    specs; offsets (block, offset): outputs that a block has. A link counts if exactly one spec of its block holds the
    address of an output of its driver; it proves the spec's label at the sink, and the output's at the driver. Rotated blocks
    prove nothing, and labels that the manual doesn't print on that side aren't proven.
    """
    upright = blocks.where(~F.col("rotated"))
    printed = labels.select("block", "side", "label").distinct()
    inputs = printed.where("side = 'input'").drop("side")
    asked = links.join(upright.select("block").hint("merge"), "block", "left_semi").join(blocks.select(F.col("block").alias("driver"), "address", F.col("rotated").alias("driver_rotated")).hint("merge"), "driver")
    outputs = offsets.select(F.col("block").alias("driver"), "offset").distinct()
    hits = asked.join(specs.join(inputs.hint("merge"), ["block", "label"], "left_semi").hint("merge"), "block").withColumn("offset", F.col("value") - F.col("address")).join(outputs.hint("merge"), ["driver", "offset"], "left_semi")
    link = ["ord", "block", "x", "y", "driver", "driver_x", "driver_y"]
    single = hits.groupBy(*link).agg(F.count("*").alias("hits"), *[F.first(c).alias(c) for c in ("label", "offset", "driver_rotated")]).where("hits = 1")
    sinks = single.select("block", F.lit("input").alias("side"), "label", "x", "y", "ord")
    named = F.when(F.col("offset") == 0, "N").otherwise(F.concat(F.lit("N+"), F.col("offset").cast("string")))
    drivers = single.where(~F.col("driver_rotated")).select(F.col("driver").alias("block"), F.lit("output").alias("side"), named.alias("label"), F.col("driver_x").alias("x"), F.col("driver_y").alias("y"), "ord")
    return sinks.union(drivers.join(printed.hint("merge"), ["block", "side", "label"], "left_semi"))


def proven_places(claims: DataFrame, blocks: DataFrame) -> DataFrame:
    """(key, label, places, place_x, place_y): at how many places instances of a symbol prove a label; the least one."""
    spots = claims.join(blocks.select("block", "key").hint("merge"), "block").select("key", "label", "x", "y").distinct()
    return spots.groupBy("key", "label").agg(F.count("*").alias("places"), F.min(F.struct("x", "y")).alias("p")).select("key", "label", "places", F.col("p.x").alias("place_x"), F.col("p.y").alias("place_y"))


def _steps(rows: Column) -> Column:
    """The common pitch of rows (an array, highest first)."""
    return common_pitch(F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda y, i: F.round(F.get(rows, i) - y).cast("long")))


def module_pitches(sided: DataFrame) -> DataFrame:
    """(side, module_pitch): the most frequent pitch of the outermost pins of symbols; the least on ties."""
    spots = sided.select("key", "side", "x", "y").distinct()
    edge = Window.partitionBy("key", "side")
    outer = spots.withColumn("edge", F.when(F.col("side") == "input", F.min("x").over(edge)).otherwise(F.max("x").over(edge))).where("x = edge")
    rows = outer.groupBy("key", "side").agg(F.reverse(F.array_sort(F.collect_set("y"))).alias("rows"))
    counts = rows.where("size(rows) > 1").withColumn("module_pitch", _steps(F.col("rows"))).where(F.col("module_pitch") >= LEAST_PITCH).groupBy("side", "module_pitch").agg(F.count("*").alias("n"))
    return ordering.dedupe_first(counts, ["side"], [F.desc("n"), "module_pitch"]).drop("n")


def slot_plans(blocks: DataFrame, sided: DataFrame, labels: DataFrame, proven: DataFrame) -> DataFrame:
    """(block, side, method, slot_x, anchor, pitch, lowest, highest, refusal) for each side of each upright block.

    Label n lies at anchor - n * pitch. Rows and labels of a symbol are few, so they are arrays; the refusals of REFUSALS are
    tried in that order, and a side has either a refusal or a grid.
    """
    c, rows_of = F.col, lambda y: F.reverse(F.array_sort(F.collect_set(y)))
    sides = blocks.where(~c("rotated")).withColumn("side", F.explode(F.array(F.lit("input"), F.lit("output"))))
    counts = labels.groupBy("block", "side").agg(F.count("*").alias("n"))
    edges = sided.groupBy("block", "side").agg(F.when(c("side") == "input", F.min("x")).otherwise(F.max("x")).alias("edge"))
    own = sided.join(edges.hint("merge"), ["block", "side"]).where("x = edge").groupBy("block", "side", "edge").agg(rows_of("y").alias("rows"))
    symbol = sided.groupBy("name", "side", c("x").alias("edge")).agg(rows_of("y").alias("all_rows"))
    first = proven.where("places = 1").join(blocks.select("block", "key").hint("merge"), "key").join(labels.hint("merge"), ["block", "label"])
    first = first.groupBy("block", "side").agg(F.min(F.struct("n", c("place_y").alias("y"))).alias("known"))
    df = sides.join(counts.hint("merge"), ["block", "side"], "left").join(own.hint("merge"), ["block", "side"], "left").join(symbol.hint("merge"), ["name", "side", "edge"], "left").join(first.hint("merge"), ["block", "side"], "left")
    df = df.join(F.broadcast(module_pitches(sided)), "side", "left")  # two rows at most

    is_input, module, more = c("side") == "input", c("module_pitch"), F.coalesce("n", F.lit(0)) - 1
    rows, all_rows = c("rows"), c("all_rows")
    base = F.when(is_input, all_rows).otherwise(rows)
    seen = F.when(F.size(base) > 1, _steps(base)).otherwise(0)
    df = df.withColumn("seen", F.when(seen >= LEAST_PITCH, seen).otherwise(F.coalesce(module, F.lit(0))))
    # inputs: a witnessed spacing of several module pitches may have rows without wires in between
    doubtful = is_input & (module > 0) & (c("seen") > module) & (F.try_mod(c("seen"), module) == 0)
    inside = lambda pitch: F.coalesce(rows[0] - more * pitch >= c("low"), F.lit(True))
    wide, narrow, manual = inside(c("seen")), inside(module), c("multiple") * module
    decided = F.when((manual == c("seen")) & wide, c("seen")).when((manual == module) & narrow, module).when(wide & ~narrow, c("seen")).when(narrow & ~wide, module)
    df = df.withColumn("pitch", F.when(doubtful, decided).otherwise(c("seen"))).withColumn("both", doubtful & wide & narrow)
    pitch = c("pitch")
    # outputs: the only grid that has all rows of this block and keeps all labels inside the box
    even = F.forall(rows, lambda y: F.abs((rows[0] - y) / pitch - F.round((rows[0] - y) / pitch)) * pitch < 0.01)
    fewest = F.greatest(F.lit(0), F.coalesce(F.ceil((c("low") - SLACK - rows[0]) / pitch) + more, F.lit(0)))
    most = F.least(more - F.round((rows[0] - F.element_at(rows, -1)) / pitch), F.coalesce(F.floor((c("high") + SLACK - rows[0]) / pitch), more))
    only = ~is_input & (pitch >= LEAST_PITCH) & even & (fewest == most)
    top, bottom = all_rows[0], F.element_at(all_rows, -1)
    above = is_input & (top > 0) & ((top - bottom) / pitch + 1 != c("n"))
    anchor = F.when(is_input, F.when(top > 0, top).otherwise(0)).when(only, rows[0] + fewest * pitch).otherwise(F.coalesce(c("known.y") + c("known.n") * pitch, top))
    df = df.withColumns({"only": F.coalesce(only, F.lit(False)), "anchor": F.when(pitch > 0, anchor).cast("double")})
    slot = lambda y: (c("anchor") - y) / pitch
    off = ~c("only") & ~F.forall(all_rows, lambda y: (slot(y) == F.floor(slot(y))) & (slot(y) >= 0) & (slot(y) < c("n")))
    glyph = rows.isNull() & ~is_input & (module > 0) & c("low").isNotNull() & c("high").isNotNull() & c("right").isNotNull()
    glyph_top = c("high") - TOP_INSET
    refusal = (
        F.when(c("n").isNull(), "NO_LABELS")
        .when(rows.isNull() & ~F.coalesce(glyph, F.lit(False)), "NO_PIN")
        .when(glyph, F.when(glyph_top - more * module < c("low") - SLACK, "GLYPH_OUTSIDE_BOX"))
        .when(c("seen") == 0, "NO_PITCH")
        .when(pitch.isNull(), F.when(c("both"), "AMBIGUOUS_PITCH").otherwise("NO_PITCH_FITS"))
        .when(above, "FIRST_ROW_ABOVE_INSERTION")
        .when(~is_input & ~c("only") & c("known").isNull() & (c("anchor") < 0), "TOP_ROW_BELOW_INSERTION")
        .when(off, "ROW_OFF_GRID")
    )
    spanned = ~is_input & ~c("only") & rows.isNotNull()  # outputs needn't be evenly spaced beyond what is witnessed
    good = c("refusal").isNull()
    return df.withColumns({"refusal": refusal, "glyph": F.coalesce(glyph, F.lit(False))}).select(
        "block", "side", F.when(good, F.when(c("glyph"), "GLYPH_PITCH").otherwise("PITCH_SLOT")).alias("method"),
        F.when(good, F.when(c("glyph"), c("right")).otherwise(c("edge"))).cast("double").alias("slot_x"),
        F.when(good, F.when(c("glyph"), glyph_top).otherwise(c("anchor"))).cast("double").alias("anchor"),
        F.when(good, F.when(c("glyph"), module).otherwise(pitch)).cast("double").alias("pitch"),
        F.when(good & spanned, bottom).cast("double").alias("lowest"), F.when(good & spanned, top).cast("double").alias("highest"), "refusal",
    )


def label_terminals(blocks: DataFrame, pins: DataFrame, labels: DataFrame, links: DataFrame, specs: DataFrame, offsets: DataFrame) -> DataFrame:
    """(block, side, n, label, pin, x, y, wired, association, method, position_status, reason): every label, then drawn pins without one.

    association: EXPLICIT, DERIVED, INFERRED, CONFLICT or UNRESOLVED. position_status: EXPLICIT for a wired pin, DERIVED for
    another one, INFERRED for a place without a pin. reason: the refusal of the grid where nothing answers, ROTATED for the
    pins of rotated blocks, UNCLAIMED for drawn pins that no label took. Of several claims of one label by wires the one of the
    largest ord counts.
    """
    c = F.col
    # steps that later ones read several times are stored, which keeps the plan, and the driver with it, small
    sided = graph.stored(sided_pins(pins, blocks))
    claims = graph.stored(wired_claims(links, specs, offsets, blocks, labels))
    proven = graph.stored(proven_places(claims, blocks))
    explicit = claims.groupBy("block", "side", "label").agg(F.max(F.struct("ord", "x", "y")).alias("e"))
    drawn = sided.where("pin is not null").withColumn("n", F.row_number().over(Window.partitionBy("block", "side").orderBy(F.desc("y"), "x")) - 1)
    counts = drawn.groupBy("block", "side").agg(F.count("*").alias("drawn")).join(labels.groupBy("block", "side").agg(F.count("*").alias("printed")).hint("merge"), ["block", "side"]).where("drawn = printed")
    exact = drawn.join(counts.hint("merge"), ["block", "side"], "left_semi").select("block", "side", "n", F.struct("x", "y").alias("d"))
    plans = graph.stored(slot_plans(blocks, sided, labels, proven))
    upright = blocks.where(~c("rotated")).select("block", "key")

    asked = labels.join(upright.hint("merge"), "block").join(explicit.hint("merge"), ["block", "side", "label"], "left").join(proven.hint("merge"), ["key", "label"], "left").join(exact.hint("merge"), ["block", "side", "n"], "left").join(plans.hint("merge"), ["block", "side"], "left")
    row = c("anchor") - c("n") * c("pitch")
    on_grid = c("anchor").isNotNull() & (c("lowest").isNull() | row.between(c("lowest"), c("highest")))
    kinds = [
        (c("e").isNotNull(), "WIRE_SPEC_MATCH", "EXPLICIT", c("e.x"), c("e.y")),
        (c("places") == 1, "TEMPLATE_FROM_EXPLICIT", "DERIVED", c("place_x"), c("place_y")),
        (c("places") > 1, "NONE", "CONFLICT", F.lit(None), F.lit(None)),
        (c("d").isNotNull(), "EXACT_PIN_COUNT", "DERIVED", c("d.x"), c("d.y")),
        (on_grid, "", "INFERRED", c("slot_x"), row),
    ]

    def pick(values: list[Column], rest: Column) -> Column:
        for (test, *_), value in reversed(list(zip(kinds, values))):
            rest = F.when(F.coalesce(test, F.lit(False)), value).otherwise(rest)
        return rest

    named = [c("method") if k[2] == "INFERRED" else F.lit(k[1]) for k in kinds]
    answered = asked.select(
        "block", "side", "n", "label", pick([k[3].cast("double") for k in kinds], F.lit(None)).alias("x"), pick([k[4].cast("double") for k in kinds], F.lit(None)).alias("y"),
        pick([F.lit(k[2]) for k in kinds], F.lit("UNRESOLVED")).alias("association"), pick(named, F.lit("NONE")).alias("how"),
        pick([F.lit(None)] * 2 + [F.lit("SEVERAL_PLACES")] + [F.lit(None)] * 2, F.coalesce("refusal", F.lit("BEYOND_WITNESSED_ROWS"))).alias("reason"),
    )
    spots = sided.select("block", "side", c("x").cast("double").alias("x"), c("y").cast("double").alias("y"), "pin", "wired", F.lit(True).alias("held"))
    answered = graph.stored(answered)
    placed = answered.join(spots.hint("merge"), ["block", "side", "x", "y"], "left")
    position = F.when(c("x").isNull(), "UNRESOLVED").when(c("held").isNull(), "INFERRED").when(c("wired"), "EXPLICIT").otherwise("DERIVED")
    out = ["block", "side", "n", "label", "pin", "x", "y", "wired", "association", "method", "position_status", "reason"]
    found = placed.withColumns({"method": c("how"), "position_status": position, "wired": F.coalesce("wired", F.lit(False))}).select(*out)
    free = spots.where("pin is not null").join(answered.where("x is not null").select("block", "side", "x", "y").distinct().hint("merge"), ["block", "side", "x", "y"], "left_anti")
    free = free.join(blocks.select("block", "rotated").hint("merge"), "block")
    return found.unionByName(free.select(
        "block", "side", F.lit(None).cast("int").alias("n"), F.lit(None).cast("string").alias("label"), "pin", "x", "y", "wired", F.lit("UNRESOLVED").alias("association"), F.lit("NONE").alias("method"),
        F.when(c("wired"), "EXPLICIT").otherwise("DERIVED").alias("position_status"), F.when(c("rotated"), "ROTATED").otherwise("UNCLAIMED").alias("reason"),
    ))


def grid_agreement(terminals: DataFrame, blocks: DataFrame, pins: DataFrame, labels: DataFrame, proven: DataFrame) -> DataFrame:
    """(block, side, label, x, y, slot_x, slot_y, agrees): the grid's place of labels that wires prove."""
    plans = slot_plans(blocks, sided_pins(pins, blocks), labels, proven).where("refusal is null")
    both = terminals.where("method = 'WIRE_SPEC_MATCH'").join(plans.drop("method", "refusal"), ["block", "side"]).withColumn("slot_y", F.col("anchor") - F.col("n") * F.col("pitch"))
    inside = F.col("lowest").isNull() | F.col("slot_y").between(F.col("lowest"), F.col("highest"))
    return both.where(inside).select("block", "side", "label", "x", "y", "slot_x", "slot_y", ((F.col("x") == F.col("slot_x")) & (F.col("y") == F.col("slot_y"))).alias("agrees"))


def symbol_captions(items: DataFrame, outputs: DataFrame, titles: DataFrame) -> DataFrame:
    """(fc, item, text, row_label, side): captions that the manual's symbols print beside pins, at the nearest pin row.

    items (fc, item, x, y, text): texts of a symbol; outputs (fc, blk, description): its outputs, numbered N+k or absolutely;
    titles (fc, title). Rows are S1.., N, N+k and absolute outputs. A row is near if it is within half the least pitch, and
    2.5 at least. Left of the middle between inputs and outputs it is an input's caption, otherwise an output's; a row of that
    side wins over others, then the nearer, then the one further out.
    """
    c, squeezed = F.col, lambda name: F.regexp_replace(F.col(name), r"\s+", "")
    blank = r"^(\S )+\S$"
    words = F.split(F.trim("text"), r"\s+")
    spaced = (F.size(words) > 1) & (F.size(F.filter(words, lambda w: F.length(w) == 1)) >= F.size(words) - 1)
    text = F.when(spaced | F.trim("text").rlike(blank), F.array_join(words, "")).otherwise(F.trim("text"))
    absolute = outputs.where(F.trim("blk").rlike(r"^\d+$")).select("fc", F.trim("blk").alias("q"), F.lit(True).alias("absolute")).distinct()
    known = items.withColumn("q", squeezed("text")).join(absolute, ["fc", "q"], "left")
    is_in, is_out = c("q").rlike(r"^S\d+$"), c("q").rlike(r"^N(\+\d+)?$") | c("absolute").isNotNull()
    known = known.withColumn("kind", F.when(is_in, "input").when(is_out, "output"))
    rows = known.where("kind is not null").select("fc", c("q").alias("row_label"), c("x").alias("row_x"), c("y").alias("row_y"), c("kind").alias("row_side"))
    gap = F.col("row_y") - F.lag("row_y").over(Window.partitionBy("fc").orderBy("row_y"))
    pitch = rows.withColumn("gap", gap).groupBy("fc").agg(
        F.when(F.count("*") > 1, F.min(F.when(c("gap") > 1, c("gap")))).otherwise(9.0).alias("pitch"),
        ((F.max(F.when(c("row_side") == "input", c("row_x"))) + F.min(F.when(c("row_side") == "output", c("row_x")))) / 2).alias("middle"),
    )
    captions = known.where("kind is null").where(~c("q").rlike(r"^\(\d+\)$")).join(titles.select("fc", squeezed("title").alias("title")), "fc", "left").where("title is null or q <> title")
    captions = captions.select("fc", "item", "x", "y", text.alias("text")).join(pitch, "fc", "left")
    left = c("x") < c("middle")
    side = F.when(c("middle").isNotNull(), F.when(left, "input").otherwise("output"))
    out_rank = F.when(c("middle").isNull(), 0).when(left, c("row_x")).otherwise(-c("row_x"))
    reach = F.greatest(F.lit(2.5), F.coalesce(c("pitch"), F.lit(9.0)) * 0.5)  # a symbol's texts are few, so all of its rows are looked at
    distance = F.abs(c("row_y") - c("y"))
    near = captions.join(rows, "fc").where(distance <= reach)
    order = F.struct(F.when(side.isNull() | (c("row_side") == side), 0).otherwise(1), distance, out_rank, "row_label")
    best = near.groupBy("fc", "item").agg(F.min_by(F.struct("row_label", "row_side"), order).alias("row"))
    named = outputs.select("fc", squeezed("blk").alias("row_label"), "description").groupBy("fc", "row_label").agg(F.min("description").alias("description"))
    found = captions.join(best, ["fc", "item"], "left").withColumn("row_label", c("row.row_label")).join(named, ["fc", "row_label"], "left")
    # the manual's text layer prints the overrun caption as D R
    fixed = F.when((c("text") == "DR") & F.coalesce(c("description").rlike("(?i)overrun"), F.lit(False)), "OR").otherwise(c("text"))
    return found.select("fc", "item", fixed.alias("text"), "row_label", F.when(c("row").isNull(), "body").otherwise(F.coalesce(side, c("row.row_side"))).alias("side"))

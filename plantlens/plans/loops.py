"""I/O list and Loop List: one row per physical point, loop tags by scored evidence, endpoints and ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantlens.functions import tags
from plantlens.functions.evidence import status_of
from plantlens.functions.numbers import add_decimal_text
from plantlens.operators import joins
from plantlens.operators.graph import bfs_hops
from plantlens.operators.ordering import unique_best

#: The weights of loop-tag choice, times ten, so that ties are exact.
WEIGHTS = {"number": 40, "base": 20, "digits": 15, "same_sheet": 30, "first_letter": 20, "end_letter": 10, "record": -10, "digital_i": -20, "digital_s": 5, "analog_s": -20, "analog_ic": 5, "analog_c": 2, "area": 10, "own_device": -30, "suffix": -30, "letters": -3, "hop": -3}
#: For analog types the code of their blocks, its channels, and the zero's spec number as first + step * position.
RANGES = {"AI": (132, 5, 2, 3), "AO": (149, 7, 16, 2)}
VIAS = ("wiring", "same-sheet", "loop-number")


def io_records(entries: DataFrame) -> DataFrame:
    """Entries of a cross-reference listing whose description is an I/O tag, with the tag's parts."""
    parsed = entries.withColumn("tag", tags.parse_io_tag(F.col("description"))).where(tags.is_physical_io(F.col("description")))
    return parsed.select(*entries.columns, F.col("tag.raw").alias("raw"), "tag.io_type", "tag.channel", "tag.slave", "tag.device_tag")


def one_per_point(records: DataFrame, order: list[str]) -> DataFrame:
    """One row per upper-case raw tag: the row on the slave's own sheet, else the first; other sheets are destinations."""
    code = F.regexp_extract("sheet", r"^\d{5}([0-9A-Z]{2})C", 1)
    main = (code != "") & (code == F.lpad("slave", 2, "0"))
    kept = F.struct(F.coalesce(~main, F.lit(True)), *[F.col(c) for c in order])
    points = records.groupBy(F.upper("raw").alias("point")).agg(
        F.min_by(F.struct(*records.columns), kept).alias("r"), F.array_distinct(F.flatten(F.collect_list(F.concat(F.array("sheet"), F.transform("destinations", lambda d: d["sheet"]))))).alias("sheets"), F.count("*").alias("n_rows")
    )
    others = F.array_sort(F.array_except(F.array_compact("sheets"), F.array("r.sheet")))
    return points.select("point", "r.*", "n_rows").drop("destinations").join(points.select("point", others.alias("destination_sheets")), "point")


def counts_by_type(points: DataFrame) -> DataFrame:
    """One row with the number of points of each type, zeros included."""
    return points.agg(*[F.count_if(F.col("io_type") == t).alias(t) for t in ("AI", "AO", "DI", "DO")], F.count("*").alias("total"))


def label_blocks(labels: DataFrame, blocks: DataFrame) -> DataFrame:
    """The block that each label (sheet, label_id, x, y) stands over: nearest in a window, by dy + dx / 10, first on ties.

    blocks: sheet, block, bx, by, height, ord. Places count once: of the blocks in one place only the first can be nearest, and
    labels in one place have the same block. Blocks of one bx and height are a column, in which the highest one that a label may
    have is found by the order of heights, once for all labels of a y whose x share a cell.
    """
    c, size = F.col, 320
    cell = F.floor(c("x") / size).cast("long")
    spots = blocks.groupBy("sheet", c("bx").alias("right_x"), "by", "height").agg(F.min("ord").alias("ord"), F.min_by("block", F.struct("ord", "block")).alias("block"))
    spots = spots.select("sheet", "right_x", "height", c("by").cast("double").alias("at"), F.struct("by", "ord", "block").alias("spot"))
    places = labels.select("sheet", "x", "y", cell.alias("cell")).distinct()
    columns = spots.select("sheet", "right_x", "height").distinct().withColumn("cell", F.explode(joins.cells(c("right_x") - 20, c("right_x") + 320, size)))
    met = places.select("sheet", "cell", "y").distinct().join(columns, ["sheet", "cell"]).withColumn("at", (c("y") - c("height") + 10).cast("double"))
    # the limits of the window are taken from dy itself, which rounding may set off a little from the order of heights
    beside = joins.neighbours(met, spots, ["sheet", "right_x", "height"], "at", "spot", lambda a, b: F.abs(a["by"] - b["by"]) > joins.SLACK)
    offer = lambda s: F.struct("right_x", (c("y") - s["by"] - c("height")).alias("dy"), s["ord"].alias("ord"), s["block"].alias("block"))
    close = F.filter(F.transform(F.concat(F.coalesce("low", F.array()), F.coalesce("high", F.array())), offer), lambda o: o["dy"].between(-10, 70))
    offers = beside.select("sheet", "cell", "y", F.explode(F.array_distinct(close)).alias("o")).groupBy("sheet", "cell", "y").agg(F.collect_list("o").alias("offers"))
    within = F.filter("offers", lambda o: (c("x") - o["right_x"]).between(-20, 320))
    scored = F.transform(within, lambda o: F.struct((o["dy"] + 0.1 * (c("x") - o["right_x"])).alias("score"), o["ord"].alias("ord"), o["block"].alias("block")))
    best = places.join(offers, ["sheet", "cell", "y"]).select("sheet", "x", "y", F.array_min(scored).alias("b")).where("b is not null")
    return labels.join(best, ["sheet", "x", "y"]).groupBy("sheet", "label_id").agg(F.min_by("b.block", "b").alias("block"))


def loop_candidates(devices: DataFrame, edges: DataFrame, nodes: DataFrame, labels: DataFrame, max_hops: int = 5) -> DataFrame:
    """(device, label, via, hops) by wiring, by a common sheet and by loop number; for a pair the first kind counts.

    devices: device, sheets; nodes: device, node; edges: a, b; labels: label, node, sheet. Wiring is followed from each
    device on its own, by the pair (device, node).
    """
    from plantlens.operators.graph import both_ways, ensure_checkpoints

    ensure_checkpoints(devices.sparkSession)
    step = both_ways(edges).checkpoint()
    seen = nodes.select("device", "node").distinct().withColumn("hops", F.lit(0))
    front = seen
    for hop in range(1, max_hops + 1):
        front = front.join(step, F.col("node") == F.col("a")).select("device", F.col("b").alias("node")).distinct().join(seen, ["device", "node"], "left_anti").withColumn("hops", F.lit(hop)).checkpoint()
        seen = seen.union(front)
    wired = seen.join(labels, "node").groupBy("device", "label").agg(F.min("hops").alias("hops")).withColumn("via", F.lit(0))
    far = F.lit(max_hops + 1).alias("hops")
    shared = devices.select("device", F.explode("sheets").alias("sheet")).join(labels.select("label", "sheet").distinct(), "sheet").select("device", "label", far, F.lit(1).alias("via")).distinct()
    own, part = tags.device_parts(F.col("device")), tags.loop_parts(F.col("label"))
    by_number = devices.select("device", own["area"].alias("area"), own["number"].alias("number")).join(labels.select("label", part["area"].alias("area"), part["number"].alias("number")).distinct(), ["area", "number"])
    numbered = by_number.select("device", "label", far, F.lit(2).alias("via"))
    first = wired.select("device", "label", "hops", "via").union(shared).union(numbered).groupBy("device", "label").agg(F.min(F.struct("via", "hops")).alias("k"))
    return first.select("device", "label", "k.via", "k.hops")


def choose_loop_tags(candidates: DataFrame, devices: DataFrame, labels: DataFrame) -> DataFrame:
    """(device, label, via, score): the candidate of the highest score, ties by kind; none where that isn't unique.

    devices: device, io_type, sheets. Scores are in tenths.
    """
    own = devices.select(F.col("device").alias("other"), "io_type").withColumn("other_tag", tags.canonical_device(F.col("other")))
    own_tags = own.groupBy("other_tag").agg(F.collect_set("io_type").alias("types"))
    on = labels.groupBy("label").agg(F.collect_set("sheet").alias("label_sheets"))
    rows = candidates.join(devices, "device").join(on, "label").withColumn("tag", tags.canonical_loop_tag(F.col("label"))).join(own_tags, F.col("tag") == F.col("other_tag"), "left")
    d, p = tags.device_parts(F.col("device")), tags.loop_parts(F.col("label"))
    digital, digits = F.col("io_type").isin("DI", "DO"), lambda c: F.regexp_replace(c, r"^\D", "")
    last, first = (lambda c: F.substring(c, -1, 1)), (lambda c: F.substring(c, 1, 1))
    when = lambda test, name: F.when(F.coalesce(test, F.lit(False)), WEIGHTS[name]).otherwise(0)
    number = F.when(d["number"] == p["number"], WEIGHTS["number"]).when(d["base"] == p["base"], WEIGHTS["base"]).when(digits(d["base"]) == digits(p["base"]), WEIGHTS["digits"]).otherwise(0)
    own_tag = tags.canonical_device(F.col("device"))
    score = (
        number + when(F.arrays_overlap("sheets", "label_sheets"), "same_sheet") + when((first(d["letters"]) == first(p["letters"])) & (first(d["letters"]) != "X"), "first_letter")
        + when(last(d["letters"]).isin("H", "L") & (last(d["letters"]) == last(p["letters"])), "end_letter") + when(last(p["letters"]) == "R", "record")
        + when(digital & (last(p["letters"]) == "I"), "digital_i") + when(digital & (last(p["letters"]) == "S"), "digital_s") + when(~digital & (last(p["letters"]) == "S"), "analog_s")
        + when(~digital & last(p["letters"]).isin("I", "C"), "analog_ic") + when(~digital & (last(p["letters"]) == "C"), "analog_c") + when(d["area"] == p["area"], "area")
        + when(F.col("types").isNotNull() & (F.col("tag") != own_tag) & (digital | F.array_contains("types", F.col("io_type"))), "own_device")
        + when((F.col("tag") == own_tag) & F.col("device").rlike("[a-z]$"), "suffix") + WEIGHTS["letters"] * (F.length(p["letters"]) - 2) + WEIGHTS["hop"] * F.col("hops")
    )
    scored = rows.withColumn("score", F.when(d["number"].isNotNull() & p["number"].isNotNull(), score).otherwise(-10 * F.col("hops")))
    best = scored.withColumn("rank", F.rank().over(Window.partitionBy("device").orderBy(F.col("score").desc(), "via"))).where("rank = 1")
    single = best.withColumn("same", F.count("*").over(Window.partitionBy("device"))).where("same = 1")
    via = F.element_at(F.array(*[F.lit(v) for v in VIAS]), F.col("via") + 1)
    return single.select("device", F.col("tag").alias("loop_tag"), "label", via.alias("via"), "score")


def loop_list(points: DataFrame) -> DataFrame:
    """Loops of points (point, io_type, device_tag, loop_tag, description): one for each tag, points without one alone.

    Each side has a status, and a value only if it has one device; the loop is MAPPED if both sides are RESOLVED.
    """
    side = F.when(F.col("io_type").isin("AI", "DI"), "input").when(F.col("io_type").isin("AO", "DO"), "output")
    rows = points.withColumns({"loop": F.coalesce(F.concat(F.lit("loop:"), "loop_tag"), F.concat(F.lit("io:"), "point")), "side": side})
    ends = []
    for name in ("input", "output"):
        device = F.when(F.col("side") == name, F.struct("io_type", "device_tag"))
        ends += [F.count_distinct(device).alias(f"n_{name}"), F.min(device).alias(name), F.array_sort(F.collect_set(F.when(F.col("side") == name, F.col("device_tag")))).alias(f"{name}_devices")]
    text = F.when(F.count_distinct("description") == 1, F.min("description"))
    loops = rows.groupBy("loop").agg(F.max("loop_tag").alias("loop_tag"), *ends, text.alias("description"), F.count("*").alias("n_points"))
    for name in ("input", "output"):
        loops = loops.withColumns({f"{name}_status": status_of(F.col(f"n_{name}")), name: F.when(F.col(f"n_{name}") == 1, F.col(f"{name}.device_tag"))})
    both = lambda s: (F.col("input_status") == s) & (F.col("output_status") == s)
    any_ = (F.col("input_status") == "AMBIGUOUS") | (F.col("output_status") == "AMBIGUOUS")
    return loops.withColumn("status", F.when(both("RESOLVED"), "MAPPED").when(any_, "AMBIGUOUS").otherwise("UNRESOLVED"))


def stack_sides(devices: DataFrame, keys: list[str], side: str, device: str, a: str, b: str, names: tuple[str, str]) -> DataFrame:
    """Rows of each key: sides beside each other if one has at most one device, else all of a, then all of b.

    Never a product of two long sides.
    """
    n = devices.groupBy(*keys).agg(F.count_if(F.col(side) == a).alias("n_a"), F.count_if(F.col(side) == b).alias("n_b"))
    rows = devices.join(n, keys)
    one = lambda s, name, other: rows.where(F.col(side) == s).select(*keys, "n_a", "n_b", F.col(device).alias(name))
    left, right = one(a, names[0], b), one(b, names[1], a)
    few = "n_a <= 1 or n_b <= 1"
    beside = left.where(few).drop("n_a", "n_b").join(right.where(few).drop("n_a", "n_b"), keys, "full_outer")
    above, below = left.where(f"not ({few})").select(*keys, names[0], F.lit(None).alias(names[1])), right.where(f"not ({few})").select(*keys, F.lit(None).alias(names[0]), names[1])
    return beside.select(*keys, *names).union(above).union(below)


def analog_ranges(points: DataFrame, blocks: DataFrame, specs: DataFrame, wires: DataFrame) -> DataFrame:
    """Range of analog points: low is the zero, high the zero plus the span, exactly.

    points: point, io_type, module, slave, channel; blocks: module, slave, fc, block; specs: module, block, number, value
    (decimal text); wires: point, module, block, pin. A block's rank is its place in address order among those of its code
    and slave. A point that is wired to one block takes that one, and its channel has to belong to that rank and, for
    inputs, to the pin `Rn`; a point that isn't wired takes the block of its channel's rank. Blocks whose address comes
    twice don't count. The zero is EXTRACTED if wire and channel agree, else DERIVED; the sum is DERIVED.
    """
    number = lambda c: F.regexp_replace(F.regexp_extract(c, r"\d+", 0), r"^0+(?=\d)", "")
    kind = lambda k: F.coalesce(*[F.when(F.col("io_type") == t, F.lit(v[k])) for t, v in RANGES.items()])
    once = blocks.withColumn("__n", F.count("*").over(Window.partitionBy("module", "block"))).where("__n = 1").drop("__n")
    ranked = once.withColumn("slave", number("slave")).withColumn("rank", (F.row_number().over(Window.partitionBy("module", "slave", "fc").orderBy("block")) - 1).cast("int"))
    rows = points.where(F.col("io_type").isin(*RANGES)).withColumns({"fc": kind(0), "per": kind(1), "slave": number("slave"), "channel": F.expr("try_cast(channel AS int)")})
    rows = rows.withColumn("chan_rank", F.floor((F.col("channel") - 1) / F.col("per")).cast("int"))

    # sizes are estimated from compressed columns; nothing that grows with the blocks may be gathered for a broadcast
    ranked = ranked.hint("merge")
    drawn = wires.groupBy("point").agg(F.count("*").alias("n_wires"), F.min(F.struct("block", "pin")).alias("w")).hint("merge")
    by_wire = rows.join(drawn, "point").join(ranked.select("module", F.col("fc").alias("wired_fc"), F.col("block").alias("at"), "rank").hint("merge"), (rows["module"] == ranked["module"]) & (F.col("w.block") == F.col("at")), "left").drop(ranked["module"])
    pin = F.when(F.col("io_type") == "AI", F.expr("try_cast(nullif(regexp_extract(w.pin, '^R([0-9]+)$', 1), '') AS int)"))
    pin = F.when(pin.between(1, F.col("per")), pin)
    placed = F.col("channel") - F.col("rank") * F.col("per")
    both = F.col("channel").isNotNull() & F.col("rank").isNotNull()
    agree = (F.col("chan_rank") == F.col("rank")) & F.coalesce(pin == placed, F.lit(True))
    position = F.when(F.col("n_wires") > 1, None).when(both, F.when(agree, placed)).otherwise(pin)
    wired = by_wire.select("point", "module", "fc", "io_type", F.col("at").alias("block"), position.alias("position"), F.when(both, "EXTRACTED").otherwise("DERIVED").alias("zero_status"))
    loose = rows.join(drawn.select("point").hint("merge"), "point", "left_anti")
    by_rank = loose.join(ranked.withColumnRenamed("rank", "chan_rank"), ["module", "slave", "fc", "chan_rank"], "left")
    unwired = by_rank.select("point", "module", "fc", "io_type", "block", F.when(F.col("block").isNotNull(), F.col("channel") - F.col("chan_rank") * F.col("per")).alias("position"), F.lit("DERIVED").alias("zero_status"))

    place = wired.union(unwired).withColumn("zero_spec", kind(2) + kind(3) * F.col("position")).withColumn("span_spec", F.col("zero_spec") + 1)
    value = specs.groupBy("module", "block", "number").agg(F.when(F.count_distinct("value") == 1, F.min("value")).alias("value"))
    for name in ("zero", "span"):
        of_name = value.select("module", "block", F.col("number").alias(f"{name}_spec"), F.col("value").alias(name)).hint("merge")
        place = place.join(of_name, ["module", "block", f"{name}_spec"], "left")
    known = F.col("zero").isNotNull() & F.col("span").isNotNull()
    high = F.when(known, add_decimal_text("zero", "span"))
    return place.select("point", "block", "position", F.when(known, F.col("zero")).alias("low"), F.when(known, F.col("zero_status")).otherwise("UNRESOLVED").alias("low_status"), high.alias("high")).withColumn("high_status", F.when(F.col("high").isNotNull(), "DERIVED").otherwise("UNRESOLVED"))


def io_sheet(points: DataFrame) -> DataFrame:
    """The I/O list as it is printed: by sheet and tag, with a dash where a value is missing."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("—")).alias(c)
    return points.orderBy(F.upper("sheet"), "raw").select(*[text(c) for c in ("sheet", "raw", "io_type", "channel", "slave", "device_tag", "source")])


def hop_labels(edges: DataFrame, sources: DataFrame) -> DataFrame:
    return bfs_hops(edges, sources, 6)


def best_block(candidates: DataFrame) -> DataFrame:
    """The block of each loop with the best kind of evidence and the fewest hops; none if it isn't unique."""
    return unique_best(candidates.withColumn("score", -(F.col("via") * 100 + F.col("hops"))), ["loop"], "score")


def matches_query(columns: list[str | Column], query: str) -> Column:
    """Whether any of the columns holds the text, without regard to case."""
    return F.exists(F.array(*columns), lambda c: F.coalesce(F.lower(c.cast("string")).contains(query.lower()), F.lit(False)))

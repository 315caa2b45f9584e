"""Wiring of sheets: wire ends by tiers of evidence, nets as components, drivers and sinks, learned pins, placed texts.

Relations are keyed by sheet. Spatial conditions meet by cells of the x axis within the sheet, so that no two
relations of a sheet meet row by row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantlens.functions import numbers
from plantlens.operators import graph, joins

#: Tolerances in drawing units.
EXACT, TEE, NEAR = 3, 1, 15
#: Roles of the rows that classify_ends lays over one another, in the order of their tiers; a block that is only near is the last tier.
END, JUNCTION, POINT, BLOCK, CONNECTOR, WIRE, NEAR_BLOCK = range(7)
TIERS = (("junction", "EXPLICIT"), ("connector", "EXPLICIT"), ("pin", "EXPLICIT"), ("connector", "DERIVED"), ("wire", "DERIVED"), ("pin", "DERIVED"))
#: Rows of a task, which sorts them and shouldn't spill them.
TASK_ROWS = 1 << 19
#: Junction kinds that connect; crossings never do.
CONNECTING = ("connected", "branch", "wire-join")


def wire_ends(wires: DataFrame) -> DataFrame:
    """wires (sheet, wire, points) to (sheet, wire, end, x, y): first and last point of each polyline."""
    ends = F.array(F.struct(F.lit("from").alias("end"), F.col("points")[0].alias("p")), F.struct(F.lit("to").alias("end"), F.element_at("points", -1).alias("p")))
    return wires.where(F.size("points") >= 2).select("sheet", "wire", F.explode(ends).alias("e")).select("sheet", "wire", "e.end", F.col("e.p.x").alias("x"), F.col("e.p.y").alias("y"))


def segments(wires: DataFrame) -> DataFrame:
    """(sheet, wire, n, x1, y1, x2, y2): the segments between neighbouring points."""
    rows = wires.select("sheet", "wire", F.posexplode(numbers.pairs_of(F.col("points"))).alias("n", "s"))
    return rows.select("sheet", "wire", "n", *[F.col(f"s.{a}.{c}").alias(f"{c}{k}") for k, a in ((1, "from"), (2, "to")) for c in ("x", "y")])


def _beside(points: DataFrame, boxes: DataFrame, reach: float, size: float = 64.0) -> DataFrame:
    """Points with the boxes (sheet, x1, x2, ...) whose x range, widened by reach, holds theirs."""
    low = points.withColumn("__cell", F.floor(F.col("x") / size))
    high = boxes.withColumn("__cell", F.explode(joins.cells(F.least("x1", "x2") - reach, F.greatest("x1", "x2") + reach, size)))
    return low.join(high, ["sheet", "__cell"]).where((F.col("x") >= F.least("x1", "x2") - reach) & (F.col("x") <= F.greatest("x1", "x2") + reach)).drop("__cell")


def classify_ends(ends: DataFrame, junctions: DataFrame, connectors: DataFrame, blocks: DataFrame, wires: DataFrame) -> DataFrame:
    """What each wire end (sheet, wire, end, x, y) stands on, by the first tier that has anything.

    junctions: sheet, ref, x, y; connectors: sheet, ref, px, py (null if it has no connection point), x1..y2; blocks:
    sheet, ref, x1..y2. Tiers: junction within 3, connection point within 3, smallest box around, connector's box,
    another wire within 1, nearest box within 15, else dangling. Smaller distance, area, then reference win.

    All relations are rows of one table that is moved once, by sheet. A sheet passes through one task, and each of its cells gives
    the list of things that its ends are compared with.
    """
    c = F.col
    rest = [k for k in ends.columns if k not in ("sheet", "wire", "end", "x", "y")]
    placed = lambda df, role, ref, x1, y1, x2, y2: df.select("sheet", F.lit(role).alias("role"), c(ref).cast("string").alias("name"), *[v.alias(k) for k, v in zip(("x1", "y1", "x2", "y2"), (x1, y1, x2, y2))])
    spots = lambda df, role, x, y: placed(df, role, "ref", c(x), c(y), c(x), c(y))
    boxes = lambda df, role, ref: placed(df, role, ref, *[c(k) for k in ("x1", "y1", "x2", "y2")])
    things = [spots(junctions, JUNCTION, "x", "y"), spots(connectors, POINT, "px", "py"), boxes(blocks, BLOCK, "ref"), boxes(connectors, CONNECTOR, "ref"), boxes(segments(wires), WIRE, "wire")]
    asked = ends.select("sheet", F.lit(END).alias("role"), c("wire").cast("string").alias("name"), c("x").alias("x1"), c("y").alias("y1"), "end", *([F.struct(*rest).alias("rest")] if rest else []))
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [*[t.where("sheet is not null and x1 is not null and x2 is not null") for t in things], asked])
    tasks = -(-stacked.count() // TASK_ROWS)
    stacked = stacked.repartition(*([tasks] if tasks > 1 else []), "sheet")

    reach = lambda role: F.when(role <= POINT, EXACT).when(role == BLOCK, NEAR).when(role == WIRE, TEE).otherwise(0)
    size, is_end = 64.0, c("role") == END
    # the ranges that hold the ends which may stand on a thing are worked out once for each thing
    ranges = {f"{n}_{k}": of(f"{k}1", f"{k}2") + sign * reach(c("role")) for k in ("x", "y") for n, of, sign in (("low", F.least, -1), ("high", F.greatest, 1))}
    own_cell = F.array(F.floor(c("x1") / size).cast("long"))
    celled = stacked.withColumns(ranges).withColumn("cell", F.explode(F.when(is_end, own_cell).otherwise(joins.cells(c("low_x"), c("high_x"), size))))
    thing = F.when(~is_end, F.struct("role", "name", "x1", "y1", "x2", "y2", *ranges))
    met = celled.withColumn("things", F.collect_list(thing).over(Window.partitionBy("sheet", "cell"))).where(is_end)
    beside = F.filter("things", lambda t: (c("x1") >= t["low_x"]) & (c("x1") <= t["high_x"]) & (c("y1") >= t["low_y"]) & (c("y1") <= t["high_y"]) & ((t["role"] != WIRE) | (t["name"] != c("name"))))

    def offer(t: Column) -> Column:
        at = [c("x1"), c("y1"), *[t[k] for k in ("x1", "y1", "x2", "y2")]]
        to_spot = numbers.length_of(c("x1") - t["x1"], c("y1") - t["y1"])
        distance = F.when(t["role"] <= POINT, to_spot).when(t["role"] == WIRE, numbers.segment_distance(*at)["distance"]).otherwise(numbers.box_distance(*at))
        return F.struct(t["role"].alias("role"), distance.alias("distance"), ((t["x2"] - t["x1"]) * (t["y2"] - t["y1"])).cast("double").alias("area"), t["name"].alias("ref"))

    def candidate(o: Column) -> Column:
        around = (o["role"] == BLOCK) & (o["distance"] == 0)
        return F.struct(F.when((o["role"] == BLOCK) & ~around, NEAR_BLOCK).otherwise(o["role"]).alias("tier"), o["distance"].alias("distance"), F.when(around, o["area"]).otherwise(0.0).alias("area"), o["ref"].alias("ref"))

    offers = F.filter(F.transform(beside, offer), lambda o: o["distance"] <= reach(o["role"]))
    best = met.withColumn("c", F.array_min(F.transform(offers, candidate))).drop("things")
    # an end in several places has the best of all of them
    best = best.withColumn("c", F.min("c").over(Window.partitionBy("sheet", "name", "end")))
    known = c("sheet").isNotNull() & c("name").isNotNull() & c("end").isNotNull() & c("c").isNotNull()
    tier = F.when(known, c("c.tier"))
    kind, status = (F.coalesce(F.get(F.array(*[F.lit(t[k]) for t in TIERS]), tier - 1), F.lit(none)) for k, none in ((0, "dangling"), (1, "UNRESOLVED")))
    types = dict(ends.dtypes)
    own = {"sheet": c("sheet"), "wire": c("name").cast(types["wire"]), "end": c("end"), "x": c("x1").cast(types["x"]), "y": c("y1").cast(types["y"])}
    return best.select(*[own.get(k, c(f"rest.{k}") if k in rest else None).alias(k) for k in ends.columns], kind.alias("kind"), F.when(known, c("c.ref")).alias("ref"), status.alias("status"), F.when(known, c("c.distance")).otherwise(0.0).alias("distance"))


def nets(ends: DataFrame, junctions: DataFrame) -> DataFrame:
    """(sheet, wire, net): wires that meet at a connecting junction or on each other; net is the least of their names.

    junctions: sheet, ref, kind. Wires hang on their junction, so that the edges of a junction are as many as its wires.
    """
    name = lambda c: F.concat_ws("|", "sheet", F.lit("w"), F.col(c).cast("string"))
    joint = F.concat_ws("|", "sheet", F.lit("~"), F.col("ref"))
    meeting = junctions.where(F.col("kind").isin(*CONNECTING)).select("sheet", F.col("ref").cast("string").alias("ref")).distinct()
    at_joint = ends.where("kind = 'junction'").join(meeting, ["sheet", "ref"], "left_semi").select(name("wire").alias("a"), joint.alias("b"))
    on_wire = ends.where("kind = 'wire'").select(name("wire").alias("a"), name("ref").alias("b"))
    labels = graph.components(at_joint.union(on_wire))
    own = ends.select("sheet", "wire", name("wire").alias("node")).distinct()
    first = own.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = first.groupBy("component").agg(F.min("node").alias("net"))
    return first.join(least, "component").select("sheet", "wire", "net")


def net_members(ends: DataFrame, of_net: DataFrame, pins: DataFrame, connectors: DataFrame) -> DataFrame:
    """(net, ref, kind, role, flipped): drivers and sinks of each net.

    pins: sheet, ref, direction; connectors: sheet, ref, kind (IREF or OREF). Output pins and input references drive. A
    net that is exported and has no driver is driven by its pin, if it has only one.
    """
    on = ends.where("kind in ('pin', 'connector')").join(of_net, ["sheet", "wire"]).select("sheet", "net", "kind", "ref").distinct()
    known = pins.select("sheet", F.col("ref").cast("string").alias("ref"), F.lit("pin").alias("kind"), F.when(F.col("direction") == "output", "driver").when(F.col("direction") == "input", "sink").alias("role"), F.lit(False).alias("export"))
    refs = connectors.select("sheet", F.col("ref").cast("string").alias("ref"), F.lit("connector").alias("kind"), F.when(F.col("kind") == "IREF", "driver").otherwise("sink").alias("role"), (F.col("kind") == "OREF").alias("export"))
    members = on.join(known.union(refs), ["sheet", "kind", "ref"]).where("role is not null")
    whole = Window.partitionBy("net")
    pin_sink = (F.col("kind") == "pin") & (F.col("role") == "sink")
    flip = (F.count_if(F.col("role") == "driver").over(whole) == 0) & (F.count_if("export").over(whole) > 0) & (F.count_if(pin_sink).over(whole) == 1) & pin_sink
    return members.withColumn("flipped", flip).select("net", "ref", "kind", F.when(flip, "driver").otherwise(F.col("role")).alias("role"), "flipped")


def crossing_points(wires: DataFrame, junctions: DataFrame) -> DataFrame:
    """(sheet, wire, other, x, y): inner crossings of horizontal and vertical segments of different wires, off all junctions."""
    parts = segments(wires)
    flat = parts.where("y1 = y2 and x1 <> x2").select("sheet", "wire", F.least("x1", "x2").alias("x1"), F.greatest("x1", "x2").alias("x2"), F.col("y1").alias("y"))
    up = parts.where("x1 = x2 and y1 <> y2").select("sheet", F.col("wire").alias("other"), F.col("x1").alias("x"), F.least("y1", "y2").alias("low"), F.greatest("y1", "y2").alias("high"))
    met = _beside(up, flat, 0).where("wire <> other and x > x1 and x < x2 and y > low and y < high").select("sheet", "wire", "other", "x", "y").distinct()
    spots = junctions.select("sheet", F.col("x").alias("jx"), F.col("y").alias("jy"))
    return met.join(spots, (met["sheet"] == spots["sheet"]) & (F.abs(met["x"] - F.col("jx")) <= EXACT) & (F.abs(met["y"] - F.col("jy")) <= EXACT), "left_anti")


def name_pins(pins: DataFrame) -> DataFrame:
    """pins (sheet, block, x, y, x1..y2) with side, and a name by side in reading order."""
    wide, high = F.greatest(F.lit(1), F.col("x2") - F.col("x1")), F.greatest(F.lit(1), F.col("y2") - F.col("y1"))
    side = F.coalesce(numbers.side_of((F.col("x") - F.col("x1")) / wide, (F.col("y") - F.col("y1")) / high), F.lit("interior"))
    across = F.col("side").isin("top", "bottom")
    order = Window.partitionBy("sheet", "block", "side").orderBy(F.when(across, F.col("x")).otherwise(-F.col("y")), "x", "y")
    named = pins.withColumn("side", side).withColumn("__n", F.row_number().over(order))
    return named.withColumn("name", F.concat(F.upper(F.substring("side", 1, 1)), F.col("__n").cast("string"))).drop("__n")


def learn_pins(ends: DataFrame, symbols: DataFrame, junctions: DataFrame) -> DataFrame:
    """(symbol, width, height, rel_x, rel_y, witnesses, instances): where wires end in the instances of a symbol.

    symbols: sheet, ref, symbol, ins_x, ins_y, x1..y2. Ends on a junction, or in several symbols, are no evidence.
    """
    spots = junctions.select("sheet", F.col("x").alias("jx"), F.col("y").alias("jy"))
    free = ends.join(spots, (ends["sheet"] == spots["sheet"]) & (F.abs(ends["x"] - F.col("jx")) <= EXACT) & (F.abs(ends["y"] - F.col("jy")) <= EXACT), "left_anti")
    box = [F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2")]
    inside = _beside(free, symbols, 0).where(numbers.in_box(*box)).withColumn("__n", F.count("*").over(Window.partitionBy("sheet", "wire", "end"))).where("__n = 1")
    size = lambda df: df.withColumns({"width": F.col("x2") - F.col("x1"), "height": F.col("y2") - F.col("y1")})
    seen = size(inside).groupBy("symbol", "width", "height", (F.col("x") - F.col("ins_x")).alias("rel_x"), (F.col("y") - F.col("ins_y")).alias("rel_y")).agg(F.count_distinct("sheet", "ref").alias("witnesses"))
    return seen.join(size(symbols).groupBy("symbol", "width", "height").agg(F.count("*").alias("instances")), ["symbol", "width", "height"])


def caption_fields(texts: DataFrame, captions: DataFrame, reach: float = 200.0) -> DataFrame:
    """(sheet, text_id, caption): the nearest caption above each text, by dy + 0.3 |dx|."""
    above = captions.select("sheet", "caption", F.col("x").alias("right_x"), F.col("y").alias("cy"))
    pairs = joins.near(texts, above, ["sheet"], "x", reach).where("cy >= y")
    score = F.col("cy") - F.col("y") + 0.3 * F.abs(F.col("x") - F.col("right_x"))
    return pairs.groupBy("sheet", "text_id").agg(F.min_by("caption", F.struct(score, "caption")).alias("caption"))


def zone_grid(samples: DataFrame, spark_grid: DataFrame, pitch: int) -> DataFrame:
    """The origin of the zone grid that most samples (row, column, x, y, weight) agree with; the first on ties."""
    at = lambda v, o: F.floor((F.col(v) - F.col(o)) / pitch)
    scored = samples.join(F.broadcast(spark_grid)).groupBy("ox", "oy").agg(F.sum(F.when((at("x", "ox") == F.col("column")) & (at("y", "oy") == F.col("row")), F.col("weight")).otherwise(0)).alias("agreeing"))
    return scored.orderBy(F.desc("agreeing"), "ox", "oy").limit(1)

"""Where annotations are drawn on a plot: each sheet's own fit from texts that it shares with its plot, then a verdict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.operators import graph, joins

#: Tolerance in points, anchors that a fit needs, the largest residual that it may leave, and the form of text
#: that may stand in for another of the same kind.
TOLERANCE, ANCHORS, RESIDUAL = 3.0, 3, 2.0
FORMS = {"s_label": r"^S\d+$", "sub_block_number": r"^\d{1,5}$"}
OTHER_FORM = r"^[A-Z/]{1,4}$"


def sheet_fits(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """(sheet, anchors, ax, bx, cx, ay, by, cy, residual, usable): X = ax x + bx y + cx, Y = ay x + by y + cy, by least squares.

    texts (sheet, text, x, y), runs (sheet, text, x, y). Anchors are texts that stand once on the sheet and once on its plot. One
    row of moments about the means for each sheet, from which the normal equations are solved in the row. Fewer than three anchors,
    anchors on one line or a residual above 2 make a fit unusable. Anchors without a place count, but don't take part in it. Texts
    and runs are counted together by text, so that they meet without a join.
    """
    c = F.col
    side = lambda df, n: df.select("sheet", F.trim("text").alias("text"), F.lit(n).alias("run"), c("x").cast("double").alias("x"), c("y").cast("double").alias("y"))
    both = side(texts, 0).unionByName(side(runs, 1)).dropna(subset=["sheet", "text"])
    of = lambda n, k: F.min(F.when(c("run") == n, c(k)))
    met = both.groupBy("sheet", "text").agg(F.count_if(c("run") == 0).alias("n"), F.count_if(c("run") == 1).alias("m"), of(0, "x").alias("x"), of(0, "y").alias("y"), of(1, "x").alias("px"), of(1, "y").alias("py")).where("n = 1 and m = 1")
    places = ("x", "y", "px", "py")
    placed = reduce(lambda a, b: a & b, [c(k).isNotNull() for k in places])
    pairs = met.select("sheet", *[F.when(placed, c(k)).alias(k) for k in places])
    spread = {"uu": F.var_pop("x"), "uv": F.covar_pop("x", "y"), "vv": F.var_pop("y")} | {f"{p}{k}": F.covar_pop(f"p{p}", v) for p in ("x", "y") for k, v in (("u", "x"), ("v", "y"))}
    sums = pairs.groupBy("sheet").agg(F.count("*").alias("anchors"), F.count("x").cast("double").alias("n"), *[F.avg(k).alias(f"m_{k}") for k in places], *[e.alias(k) for k, e in spread.items()])
    sums = sums.withColumns({k: c(k) * c("n") for k in spread})
    # places are taken from the means, so the sums of both coordinates are 0 and two equations are left
    det = c("uu") * c("vv") - c("uv") * c("uv")
    solid = (c("n") >= ANCHORS) & (F.abs(c("n") * det) > 1e-9)
    fits = sums.withColumns({f"{k}{p}": F.when(solid, e / det) for p in ("x", "y") for k, e in (("a", c(f"{p}u") * c("vv") - c(f"{p}v") * c("uv")), ("b", c(f"{p}v") * c("uu") - c(f"{p}u") * c("uv")))})
    fits = fits.withColumns({f"c{p}": c(f"m_p{p}") - c(f"a{p}") * c("m_x") - c(f"b{p}") * c("m_y") for p in ("x", "y")})
    fits = fits.select("sheet", "anchors", *[f"{k}{p}" for p in ("x", "y") for k in "abc"])
    off = F.hypot(*[c(f"a{p}") * c("x") + c(f"b{p}") * c("y") + c(f"c{p}") - c(f"p{p}") for p in ("x", "y")])
    residual = pairs.join(fits.where("ax is not null"), "sheet").groupBy("sheet").agg(F.max(off).alias("residual"))
    return fits.join(residual, "sheet", "left").withColumn("usable", F.coalesce(c("residual") <= RESIDUAL, F.lit(False)))


def position_verdicts(annotations: DataFrame, tokens: DataFrame, fits: DataFrame, tolerance: float = TOLERANCE, distances: bool = True) -> DataFrame:
    """(sheet, id, verdict, found, distance) of annotations (sheet, id, kind, text, x, y) on sheets whose fit is usable.

    tokens (sheet, text, x1, y1, x2, y2): words of a plot, from start to end. s_labels end at their place, captions may start or
    end there, others start there. CONFIRMED: the same text is within the tolerance; WRONG_TEXT: another text of the same form
    is, and is given as found; MISPLACED: the same text stands elsewhere; NOT_IN_PLOT: nowhere. distance: to the nearest same
    text, left out without `distances`. Places meet by cells. That a text stands elsewhere is known from a table of texts; only
    the distance of such a one takes all places of its text.
    """
    c = F.col
    usable = graph.stored(fits.where("usable").select("sheet", *[f"{k}{p}" for k in "abc" for p in "xy"]))
    at = lambda p: c(f"a{p}") * c("x") + c(f"b{p}") * c("y") + c(f"c{p}")
    placed = annotations.join(usable, "sheet").select("sheet", "id", "kind", "text", at("x").alias("X"), at("y").alias("Y"))
    ends = F.array(F.struct(F.lit("start").alias("end"), c("x1").alias("right_X"), c("y1").alias("ty")), F.struct(F.lit("end").alias("end"), c("x2").alias("right_X"), c("y2").alias("ty")))
    spots = tokens.select("sheet", c("text").alias("token"), F.explode(ends).alias("e")).select("sheet", "token", "e.*")
    by_kind = lambda label, caption, other: F.when(c("kind") == "s_label", label).when(c("kind") == "caption", caption).otherwise(other)
    start, end = F.lit("start"), F.lit("end")
    wanted = placed.withColumn("end", F.explode(by_kind(F.array(end), F.array(start, end), F.array(start))))
    distance = F.hypot(c("X") - c("right_X"), c("Y") - c("ty"))
    form = F.lit(OTHER_FORM)
    for kind, f in FORMS.items():
        form = F.when(c("kind") == kind, f).otherwise(form)
    known = tokens.groupBy("sheet", "text").agg(*[F.bool_or(c(x).isNotNull() & c(y).isNotNull()).alias(n) for n, x, y in (("starts", "x1", "y1"), ("ends", "x2", "y2"))])
    there = F.coalesce(c("id").isNotNull() & c("X").isNotNull() & c("Y").isNotNull() & by_kind(c("ends"), c("starts") | c("ends"), c("starts")), F.lit(False))
    own = placed.join(known, ["sheet", "text"], "left").select("sheet", "id", F.lit(1).alias("row"), there.alias("there"))
    close = joins.near(wanted, spots, ["sheet", "end"], "X", tolerance, wide=4).where((distance <= tolerance) & c("id").isNotNull())
    close = close.select("sheet", "id", F.when(c("text") == c("token"), distance).alias("same"), F.regexp_like("token", form).alias("formed"), distance.alias("d"), "token")
    met = own.unionByName(close, allowMissingColumns=True).groupBy("sheet", "id").agg(
        F.sum("row").alias("rows"), F.bool_or("there").alias("there"), F.min("same").alias("distance"), F.coalesce(F.bool_or("formed"), F.lit(False)).alias("formed"),
        F.min_by(F.when(c("formed"), c("token")), F.when(c("formed"), F.struct("d", "token"))).alias("other"),
    )
    verdict = F.when(c("distance").isNotNull(), "CONFIRMED").when(c("formed"), "WRONG_TEXT").when(c("there"), "MISPLACED").otherwise("NOT_IN_PLOT")
    found = met.withColumn("verdict", verdict).withColumn("row", F.explode(F.sequence(F.lit(1), c("rows").cast("int"))))
    found = found.select("sheet", "id", "verdict", F.when(c("verdict") == "WRONG_TEXT", c("other")).alias("found"), "distance", "there")
    if not distances:
        return found.drop("distance", "there")
    away = wanted.join(met.where("distance is null and there").select("sheet", "id"), ["sheet", "id"], "left_semi")
    far = away.join(spots.withColumnRenamed("token", "text"), ["sheet", "text", "end"]).groupBy("sheet", "id").agg(F.min(distance).alias("far"))
    return found.join(far, ["sheet", "id"], "left").select("sheet", "id", "verdict", "found", F.coalesce("distance", "far").alias("distance"))

"""Comparison of a result with a reference drawing: texts by place, ink by cells, assignments, colours and recoveries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantlens.functions import numbers
from plantlens.operators.joins import near
from plantlens.operators.graph import ensure_checkpoints


def matched_texts(expected: DataFrame, found: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """One-to-one pairs of equal texts within tolerance in both x and y: keys, id, right_id.

    expected: keys (the text among them), id, x, y; found: the same columns. In each round, every expected row that is
    still open asks for the nearest open found row, and a found row takes the nearest that asks; distance, then id.
    """
    ensure_checkpoints(expected.sparkSession)
    right = found.select(*keys, F.col("id").alias("right_id"), F.col("x").alias("right_x"), F.col("y").alias("right_y"))
    pairs = near(expected, right, keys, "x", tolerance).where(F.abs(F.col("y") - F.col("right_y")) <= tolerance)
    distance = F.hypot(F.col("x") - F.col("right_x"), F.col("y") - F.col("right_y"))
    open_, done = pairs.select(*keys, "id", "right_id", distance.alias("d")).checkpoint(), None
    while True:
        asks = open_.groupBy("id").agg(F.min(F.struct("d", "right_id")).alias("c")).select("id", "c.d", "c.right_id")
        taken = asks.groupBy("right_id").agg(F.min(F.struct("d", "id")).alias("c")).select("right_id", "c.id").checkpoint()
        if not taken.limit(1).count():
            break
        pairs_now = open_.join(taken, ["id", "right_id"]).select(*keys, "id", "right_id")
        done = pairs_now if done is None else done.union(pairs_now)
        open_ = open_.join(taken.select("id"), "id", "left_anti").join(taken.select("right_id"), "right_id", "left_anti").checkpoint()
    return done if done is not None else open_.select(*keys, "id", "right_id")


def ink_coverage(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float = 0.8, step: float = 1.0, cell: float = 4.0) -> DataFrame:
    """Per key the length of left's segments (x1, y1, x2, y2), and how much of it lies within tolerance of right's.

    Points along the left segments meet the right segments that touch their cell. Long segments are cut into pieces
    before they are put into cells, so that a segment lists the cells along it, not those of its bounding box.
    """
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    n = F.greatest(F.lit(1), F.ceil(length / step)).cast("int")
    ids = left.withColumn("__id", F.xxhash64(*keys, "x1", "y1", "x2", "y2")).withColumns({"__n": n, "__w": length / (n + 1)})
    points = ids.select(*keys, "__id", "__w", "__n", "x1", "y1", "x2", "y2", F.explode(F.sequence(F.lit(0), F.col("__n"))).alias("__k"))
    t = F.col("__k") / F.col("__n")
    points = points.select(*keys, "__id", "__k", "__w", (F.col("x1") + t * (F.col("x2") - F.col("x1"))).alias("px"), (F.col("y1") + t * (F.col("y2") - F.col("y1"))).alias("py"))
    parts = F.greatest(F.lit(1), F.ceil(length / (4 * cell))).cast("int")
    cut = right.withColumn("__p", parts).select(*keys, "x1", "y1", "x2", "y2", "__p", F.explode(F.sequence(F.lit(0), F.col("__p") - 1)).alias("__i"))
    at = lambda a, b, i: F.col(a) + (F.col("__i") + i) / F.col("__p") * (F.col(b) - F.col(a))
    cut = cut.select(*keys, at("x1", "x2", 0).alias("qx1"), at("y1", "y2", 0).alias("qy1"), at("x1", "x2", 1).alias("qx2"), at("y1", "y2", 1).alias("qy2"))
    span = lambda a, b: F.sequence(F.floor((F.least(a, b) - tolerance) / cell), F.floor((F.greatest(a, b) + tolerance) / cell))
    placed = cut.withColumn("cx", F.explode(span("qx1", "qx2"))).withColumn("cy", F.explode(span("qy1", "qy2")))
    cells = points.withColumns({"cx": F.floor(F.col("px") / cell), "cy": F.floor(F.col("py") / cell)})
    close = numbers.segment_distance(*[F.col(c) for c in ("px", "py", "qx1", "qy1", "qx2", "qy2")])["distance"] <= tolerance
    hits = cells.join(placed, [*keys, "cx", "cy"]).where(close).select(*keys, "__id", "__k", "__w").distinct()
    covered = hits.groupBy(*keys).agg(F.sum("__w").alias("covered"))
    return ids.dropDuplicates([*keys, "__id"]).groupBy(*keys).agg(F.sum(length).alias("length")).join(covered, keys, "left").withColumn("covered", F.coalesce("covered", F.lit(0.0)))


def greedy_assignment(scores: DataFrame, keys: list[str], least: float = 0.05) -> DataFrame:
    """(keys, a, b, score): the best pair first, then the best of what is left, and so on, down to `least`; a, b break ties.

    Sequential within a key by nature; keys are documents, so a task holds the scores of one document at a time.
    """
    types = {f.name: f.dataType.simpleString() for f in scores.schema}
    schema = ", ".join(f"{c} {types[c]}" for c in [*keys, "a", "b", "score"])

    def assign(rows: pd.DataFrame) -> pd.DataFrame:
        taken_a, taken_b, kept = set(), set(), []
        for i, (a, b, score) in enumerate(zip(rows["a"], rows["b"], rows["score"])):
            if score >= least and a not in taken_a and b not in taken_b:
                taken_a.add(a)
                taken_b.add(b)
                kept.append(i)
        return rows.iloc[kept]

    return scores.select(*keys, "a", "b", "score").groupBy(*keys).applyInPandas(lambda g: assign(g.sort_values(["score", "a", "b"], ascending=[False, True, True])), schema)


def recovered_texts(plotted: DataFrame, found: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """plotted (keys, text) with `recovered`: equal to a found text, or one of the two contains the other.

    Found texts count from `least` characters. Containment is looked for by a common piece of `least` characters, so that
    texts meet by a key instead of all with all.
    """
    pieces = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - least + 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(least))))
    a = plotted.select(*keys, "text").distinct()
    b = found.where(F.length("text") >= least).select(*keys, F.col("text").alias("other")).distinct()
    whole = a.join(b, [*[a[k] == b[k] for k in keys], a["text"] == b["other"]], "left_semi")
    # the first piece of the shorter text is somewhere in the longer one
    head_a, head_b = a.where(F.length("text") >= least).withColumn("piece", F.substring("text", 1, least)), b.withColumn("piece", F.substring("other", 1, least))
    inside = head_a.join(b.withColumn("piece", F.explode(pieces(F.col("other")))), [*keys, "piece"]).where(F.expr("contains(other, text)")).select(*keys, "text")
    around = a.withColumn("piece", F.explode(pieces(F.col("text")))).join(head_b, [*keys, "piece"]).where(F.expr("contains(text, other)")).select(*keys, "text")
    hits = whole.select(*keys, "text").union(inside).union(around).distinct().withColumn("recovered", F.lit(True))
    return plotted.join(hits, [*keys, "text"], "left").withColumn("recovered", F.coalesce("recovered", F.lit(False)))


def topmost_owner(layers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, owner): of the objects drawn over a place (keys, draw_order, owner) the one drawn last."""
    return layers.groupBy(*keys).agg(F.max_by("owner", F.struct("draw_order", "owner")).alias("owner"))


def dominant_colour(samples: DataFrame, keys: list[str], runner_up: float = 0.8) -> DataFrame:
    """Most frequent colour by key, and whether the second comes so near that the area is dithered."""
    counts = samples.groupBy(*keys, "colour").agg(F.count("*").alias("n"))
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "colour")
    ranked = counts.withColumns({"__r": F.row_number().over(order), "second": F.lead("n").over(order), "all": F.sum("n").over(Window.partitionBy(*keys))}).where("__r = 1")
    return ranked.select(*keys, "colour", (F.col("n") / F.col("all")).alias("share"), F.coalesce(F.col("second") >= runner_up * F.col("n"), F.lit(False)).alias("dithered"))


def unique_anchor(witnesses: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, anchor): the one place of the first slot for which all witnessed rows fall on slots within the box.

    witnesses: keys, y, slots, pitch, low, high. Keys with no such place, or with several, have no row.
    """
    sound = witnesses.where("slots > 0 and pitch >= 10")
    candidates = sound.select(*keys, "slots", "pitch", "low", "high", F.explode(F.transform(F.sequence(F.lit(0), F.col("slots") - 1), lambda i: F.col("y") + i * F.col("pitch"))).alias("anchor")).distinct()
    slot = F.round((F.col("anchor") - F.col("y")) / F.col("pitch"))
    on = (F.abs(F.col("anchor") - slot * F.col("pitch") - F.col("y")) < 0.01) & (slot >= 0) & (slot < F.col("slots"))
    tested = candidates.join(sound.select(*keys, "y"), keys).groupBy(*keys, "slots", "pitch", "low", "high", "anchor").agg(F.bool_and(on).alias("on"))
    last = F.col("anchor") - (F.col("slots") - 1) * F.col("pitch")
    fits = tested.where(F.col("on") & (F.col("low").isNull() | ((last >= F.col("low") - 2) & (F.col("anchor") <= F.col("high") + 2))))
    return fits.groupBy(*keys).agg(F.count("*").alias("n"), F.min("anchor").alias("anchor")).where("n = 1").drop("n")


def rows_around(rows: DataFrame, key: str, at: str, hit, before: int = 12, after: int = 23) -> DataFrame:
    """Rows from `before` ahead of the first hit of each key to `after` behind it. No hit: the rows as if it stood at -1."""
    first = rows.groupBy(key).agg(F.coalesce(F.min(F.when(hit, F.col(at))), F.lit(-1)).alias("__first"))
    return rows.join(first, key).where(F.col(at).between(F.greatest(F.col("__first") - before, F.lit(0)), F.col("__first") + after)).drop("__first")


def prefer(df: DataFrame, keys: list[str], better, order: list[str]) -> DataFrame:
    """One row for each key: the first for which `better` holds, else the first."""
    rank = Window.partitionBy(*keys).orderBy(F.when(better, 0).otherwise(1), *order)
    return df.withColumn("__r", F.row_number().over(rank)).where("__r = 1").drop("__r")


def image_histograms(images: DataFrame, bins: int = 16) -> DataFrame:
    """(id, width, height, rgb) to (id, histogram, edges): colour histogram of bins^3 and number of edge pixels.

    One image is one row; its pixels never become rows.
    """
    import numpy as np

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, w, h, rgb in zip(batch["id"], batch["width"], batch["height"], batch["rgb"]):
                px = np.frombuffer(bytes(rgb), np.uint8).reshape(h, w, 3).astype(np.int32)
                code = (px * bins // 256) @ np.array([bins * bins, bins, 1])
                grey = px @ np.array([299, 587, 114]) // 1000
                edge = np.zeros((h, w), bool)
                edge[:, 1:] |= abs(np.diff(grey, axis=1)) > 32
                edge[1:] |= abs(np.diff(grey, axis=0)) > 32
                out.append((i, (np.bincount(code.ravel(), minlength=bins**3) / max(1, w * h)).tolist(), int(edge.sum())))
            yield pd.DataFrame(out, columns=["id", "histogram", "edges"])

    return images.select("id", "width", "height", "rgb").mapInPandas(run, "id long, histogram array<double>, edges long")


def histogram_intersection(a, b):
    """Column: common mass of two histograms."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0.0), lambda s, v: s + v)

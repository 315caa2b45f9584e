import math
import random

from pyspark.sql import functions as F

from plantlens.operators import comparison


def test_texts_match_one_to_one(spark):
    e = spark.createDataFrame([(1, "a", 0.0, 0.0), (2, "a", 1.0, 0.0), (3, "b", 0.0, 0.0)], "id int, text string, x double, y double")
    f = spark.createDataFrame([(7, "a", 0.9, 0.0), (8, "a", 2.0, 0.5), (9, "a", 50.0, 0.0)], "id int, text string, x double, y double")
    assert {(r.id, r.right_id) for r in comparison.matched_texts(e, f, ["text"], 2.5).collect()} == {(2, 7), (1, 8)}
    assert comparison.matched_texts(e, f.where("id = 9"), ["text"], 2.5).count() == 0


def test_ink_coverage(spark):
    rng = random.Random(3)
    seg = lambda n: [("p", *[rng.uniform(0, 60) for _ in range(4)]) for _ in range(n)]
    a, b = seg(6), seg(9)
    schema = "page string, x1 double, y1 double, x2 double, y2 double"
    got = comparison.ink_coverage(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["page"], tolerance=2.0).first()

    def dist(px, py, s):
        _, x1, y1, x2, y2 = s
        vx, vy = x2 - x1, y2 - y1
        t = max(0, min(1, ((px - x1) * vx + (py - y1) * vy) / (vx * vx + vy * vy)))
        return math.hypot(px - x1 - t * vx, py - y1 - t * vy)

    length = covered = 0.0
    for _, x1, y1, x2, y2 in a:
        size = math.hypot(x2 - x1, y2 - y1)
        n = max(1, math.ceil(size))
        length += size
        covered += sum(size / (n + 1) for i in range(n + 1) if min(dist(x1 + i / n * (x2 - x1), y1 + i / n * (y2 - y1), s) for s in b) <= 2.0)
    assert abs(got.length - length) < 1e-6 and abs(got.covered - covered) < 1e-6


def test_assignment_is_greedy(spark):
    s = spark.createDataFrame([("d", 1, 1, 0.9), ("d", 1, 2, 0.8), ("d", 2, 1, 0.85), ("d", 2, 2, 0.01), ("e", 5, 5, 0.5)], "doc string, a int, b int, score double")
    assert {(r.doc, r.a, r.b) for r in comparison.greedy_assignment(s, ["doc"]).collect()} == {("d", 1, 1), ("e", 5, 5)}


def test_images(spark):
    black, half = bytes(3 * 4 * 2), bytes([0] * 12 + [255] * 12)
    rows = comparison.image_histograms(spark.createDataFrame([(1, 4, 2, bytearray(black)), (2, 4, 2, bytearray(half))], "id long, width int, height int, rgb binary"))
    h = {r.id: r for r in rows.collect()}
    assert h[1].edges == 0 and h[2].edges == 4
    pair = rows.where("id = 1").select(F.col("histogram").alias("a")).crossJoin(rows.where("id = 2").select(F.col("histogram").alias("b")))
    assert pair.select(comparison.histogram_intersection("a", "b").alias("x")).first().x == 0.5

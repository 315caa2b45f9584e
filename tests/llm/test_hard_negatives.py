import random

import pytest
from pyspark.sql import functions as F

from plantlens.llm import hard_negatives

SCHEMA = "id long, label int, vector array<int>, rank string, score double, anchor long"


def brute(rows, s):
    """rows: {id: (label, vector)}; anchors are multiples of ten."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = set()
    for a in (i for i in rows if i % 10 == 0):
        scored = sorted((-dot(rows[a][1], rows[i][1]), i) for i in rows if i != a)
        for p, i in [x for x in scored if rows[x[1]][0] == rows[a][0]][: s.positives]:
            negatives = [x for x in scored if rows[x[1]][0] != rows[a][0] and s.low * -p <= 100 * -x[0] <= s.high * -p]
            out |= {(a, i, r, n, -p, -q) for r, (q, n) in enumerate(negatives[: s.negatives], 1)}
    return out


def mined(spark, rows, settings):
    got = hard_negatives.mine(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("id") % 10 == 0, settings)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("settings", [hard_negatives.MiningSettings(), hard_negatives.MiningSettings(positives=2, negatives=3, digit_bits=5, slack=1, block=40)])
def test_selection_equals_brute_force(spark, settings):
    rng = random.Random(4)
    rows = {i: (rng.randrange(3), [rng.randint(-9, 30) for _ in range(6)]) for i in range(-60, 120)}
    for i in range(40, 90):  # one vector many times: equal scores are told apart by ids
        rows[i] = (i % 2, [20] * 6)
    if settings.digit_bits == 8:
        rows[-(1 << 62)], rows[1 << 62] = (1, [20] * 6), (2, [19, 20])
    rows[7] = (1, [])
    table = [(i, c, v, "x", 1.0, 1) for i, (c, v) in rows.items()]
    table += [(None, 1, [50] * 6, "", None, None), (500, None, [50] * 6, "", None, None), (501, 1, None, "", None, None)] + table[20:30]
    assert mined(spark, table, settings) == brute(rows, settings)


def test_wide_scores_and_empty_tables(spark):
    big = (1 << 30) - 1
    rows = {i: (i % 2, [big, i, -big]) for i in range(30)}
    settings = hard_negatives.MiningSettings(high=100)
    assert mined(spark, [(i, c, v, "", None, None) for i, (c, v) in rows.items()], settings) == brute(rows, settings)
    assert mined(spark, [], settings) == set()
    assert mined(spark, [(10, 1, [1], "", None, None)], settings) == set()


def test_quantised_and_usable(spark):
    rows = [([0.5, -0.001, 1e30, -1e30],), ([1.0, float("nan")],), ([float("inf")],), ([None],), (None,), ([],)]
    got = spark.createDataFrame(rows, "v array<float>").select(hard_negatives.usable(F.col("v")), hard_negatives.quantised(F.col("v"))).collect()
    assert [r[0] for r in got] == [True, False, False, False, False, True]
    assert got[0][1] == [128, -1, (1 << 31) - 1, -(1 << 31) + 1]

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from stagetrace.llm.hard_negatives import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, id string, score string, slot int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", "y", 7) for r in rows], SCHEMA).repartition(parts)


def mined(df, scale=256, positives=5, negatives=5):
    out = hard_negatives(df, F.col("vec_id") % 10 == 0, scale=scale, positives=positives, negatives=negatives)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def brute(rows, scale=256, positives=5, negatives=5):
    usable = [
        (math.inf if i is None else i, [math.floor(scale * x) for x in v], y)
        for i, v, y in rows
        if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for a, v, y in usable:
        if a == math.inf or a % 10:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w)), i, z) for i, w, z in usable)
        for s, i, _ in [x for x in scored if x[2] == y and x[1] != a][:positives]:
            fits = [(t, j) for t, j, z in scored if z != y and 80 * -s <= 100 * -t <= 100 * -s]
            for rank, (t, j) in enumerate(fits[:negatives], 1):
                out.append((a, None if i == math.inf else i, rank, None if j == math.inf else j, -s, -t))
    return sorted(out, key=repr)


def vectors(n, dims, seed, spread=1.0, labels=3):
    """Vectors on a coarse grid around a common one, so that scores tie often."""
    rng = random.Random(seed)
    middle = [rng.uniform(0, spread) for _ in range(dims)]
    return [(i, [round(8 * (m + rng.gauss(0, spread / 4))) / 8 for m in middle], rng.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("dims, scale", [(4, 256), (64, 256), (3, 1 << 20), (2, 1 << 25)])
def test_equals_brute_force(spark, dims, scale):
    rows = vectors(400, dims, dims)
    got = mined(frame(spark, rows), scale)
    assert got == brute(rows, scale) and len(got) > 300
    assert mined(frame(spark, rows, parts=7), scale) == got


def test_odd_rows(spark):
    rows = vectors(120, 3, 5)
    rows += [(200, None, 1), (210, [1.0, float("nan"), 0.5], 1), (220, [1.0, None, 0.5], 1), (230, [1.0, 1.0, 1.0], None)]
    rows += [(240, [float("inf"), 1.0, 1.0], 2), (250, [], 1), (260, [1.0], 1), (None, [1.0, 1.0, 1.0], 1), (None, [1.0, 1.0, 1.0], 2)]
    rows += [(270, [0.0, 0.0, 0.0], 0), (280, [-1.0, -2.0, -0.5], 1)]
    rows += [rows[5]] * 3 + [rows[10]] * 2  # repeated rows, an anchor among them
    got = mined(frame(spark, rows))
    assert got == brute(rows)
    assert any(r[3] is None for r in got) and any(r[1] is None for r in got)


def test_common_vector_and_several_blocks(spark, monkeypatch):
    """Half of all rows are one vector under two labels; anchors come in blocks."""
    monkeypatch.setattr("stagetrace.llm.hard_negatives.ANCHORS", 7)
    monkeypatch.setattr("stagetrace.llm.hard_negatives.CANDIDATES", 50)
    rows = vectors(200, 4, 9) + [(i, [1.0, 0.5, 0.25, 1.0], i % 2) for i in range(200, 400)]
    assert mined(frame(spark, rows)) == brute(rows)
    assert mined(frame(spark, rows), 256, 2, 9) == brute(rows, 256, 2, 9)


def test_nothing_to_mine(spark):
    assert mined(frame(spark, [])) == []
    assert mined(frame(spark, [(1, [1.0], 1)])) == []  # no anchor
    assert mined(frame(spark, [(0, [1.0], 1)])) == []  # no other row
    assert mined(frame(spark, [(0, [1.0], 1), (1, [2.0], 1), (2, [1.9], 2)])) == [(0, 1, 1, 2, 131072, 124416)]


def test_products_too_large_for_a_double(spark):
    rows = [(i, [float(1 << 14) + i % 7, float(i % 5)], i % 3) for i in range(60)]
    assert mined(frame(spark, rows), 1 << 12) == brute(rows, 1 << 12)
    with pytest.raises(Exception, match="doesn't fit"):
        mined(frame(spark, [(0, [1e20], 1), (1, [1e20], 1)]))

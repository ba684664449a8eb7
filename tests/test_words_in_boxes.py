"""Words in boxes against brute force, and how often a box is moved."""

import math
import random

import pytest

from caseflow.operators import match as M
from caseflow.plans import load_queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("crowded", [1000, 12, 0])
def test_words_equal_brute_force(spark, monkeypatch, crowded):
    """Pages with and without a crowd of boxes, equal distances, edges of the pad, places below zero, unknown places, repeated words."""
    monkeypatch.setattr(M, "CROWDED", crowded)
    rng, pad = random.Random(crowded), 0.25
    place = lambda: rng.randrange(-8, 25) / 8
    words = [(p, w, f"w{w}", place(), place()) for p in (1, 2, 3) for w in range(40)] + [(1, 5, "w5", place(), place()), (2, 90, "x", None, 0.0), (None, 1, "x", 0.0, 0.0)]
    boxes = []
    for p, n in ((1, 5), (2, 30), (4, 3)):
        for b in range(n):
            x, y = place(), place()
            boxes.append((p, f"b{b}", x, y, x + rng.randrange(1, 4) / 8, y + rng.randrange(1, 4) / 8))
    boxes += [(1, "wide", None, 0.0, 1.0, 1.0), (None, "b", 0.0, 0.0, 1.0, 1.0)]
    got = M.assign_words(spark.createDataFrame(words, "page int, word_no int, word string, cx double, cy double"),
                         spark.createDataFrame(boxes, "page int, box string, x0 double, y0 double, x1 double, y1 double"), pad)
    want = {}
    for p, w, word, cx, cy in words:
        for q, b, x0, y0, x1, y1 in boxes:
            if p is None or p != q or None in (cx, x0):
                continue
            d = math.hypot(max(x0 - cx, 0, cx - x1), max(y0 - cy, 0, cy - y1))
            if d <= pad:
                one = (math.floor(d * 1e9 + 0.5), math.floor((x1 - x0) * (y1 - y0) * 1e9 + 0.5), b)
                want[p, w] = min(want.get((p, w), one), one)
    assert {(r.page, r.word_no): r.box for r in got.collect()} == {k: v[2] for k, v in want.items()} and len(want) > 20


def test_a_box_is_moved_once(spark):
    """Words and boxes each cross the network once, one row each, and a word's nearest box is found where they meet."""
    plan = load_queries()["word_boxes"].run(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Generate" not in plan

"""Bands against a plain loop, on random profiles in which gaps close and narrow runs go."""

import math
import random

from gridloom.operators import layout


def plain(ink):
    w, v = len(ink), sorted(ink)
    level = v[min(w - 1, math.floor(w * 0.95))] or v[-1] or 1.0
    runs, at = [], None
    for x, value in enumerate(ink):
        if min(1.0, value / level) > 0.08:
            empty = x - at - 1 if at is not None else None
            if empty is None or (empty > 0 and empty >= max(1, math.floor(w * 0.012))):
                runs.append([x, x + 1])
            runs[-1][1] = x + 1
            at = x
    runs = [tuple(r) for r in runs if r[1] - r[0] >= max(1, math.floor(w * 0.04))]
    return runs if w >= 10 and 3 <= len(runs) <= 9 else []


def test_bands(spark):
    draw = random.Random(4)
    profiles = {}
    for d in range(60):
        w, ink = draw.choice([8, 12, 90, 300]), []
        while len(ink) < w:
            ink += [draw.choice([0.0, 0.0, 0.01])] * draw.choice([1, 2, 3, 5, 9]) + [draw.random() * 9 + 0.5] * draw.choice([1, 2, 4, 12, 30])
        profiles[d] = ink[:w]
    rows = spark.createDataFrame([(d, x, v) for d, ink in profiles.items() for x, v in enumerate(ink)], "doc_id int, x int, ink double").repartition(5)
    want = [(d, *r) for d, ink in profiles.items() for r in plain(ink)]
    assert sorted(map(tuple, layout.bands(rows).collect())) == want and len({d for d, _, _ in want}) > 10

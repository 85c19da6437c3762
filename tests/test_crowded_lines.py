"""Crowded lines are not all compared with each other."""

from __future__ import annotations

import math
import random

from siterank.operators import clusters


def _thicket(spark):
    """Crossing lines of one status and of none, and lines that touch nothing or one line only."""
    draw, rows = random.Random(5), []
    for i in range(600):
        x, y = draw.uniform(0, 400), draw.uniform(0, 400)
        turn = draw.uniform(0, 2 * math.pi)
        dx, dy = 180 * math.cos(turn), 180 * math.sin(turn)
        rows.append((i, 0, ("a", None)[i % 2], x, y, x + dx, y + dy))
        if i % 4 == 0:
            rows.append((i, 1, ("a", None)[i % 2], x + dx, y + dy, x + dx + 4.0, y + dy + 3.0))
    rows += [(1000 + i, 0, "a", 100.0 + i, 100.0, 100.4 + i, 100.0) for i in range(20)]  # short ones among the others
    rows += [(2000, 0, "a", 9000.0, 0.0, 9100.0, 0.0), (2001, 0, "a", 9050.0, -5.0, 9050.0, 5.0), (2002, 0, "b", 9050.0, -5.0, 9050.0, 5.0)]
    return spark.createDataFrame(rows, "line_id long, seg_no int, status string, x1 double, y1 double, x2 double, y2 double")


def _clusters(df):
    return {r["line_id"]: r["cluster_id"] for r in clusters.cluster_lines(df).collect()}


def test_crowded_lines_form_the_same_clusters(spark, monkeypatch):
    """One round compares every pair; two compare fewer and find the same."""
    segs = _thicket(spark)
    tested, touch = [], clusters.only_touching
    monkeypatch.setattr(clusters, "only_touching", lambda df, a, b: (tested.append(df.count()), touch(df, a, b))[1])
    plain = _clusters(segs)
    every = tested.pop()
    monkeypatch.setattr(clusters, "is_small", lambda df: False)
    monkeypatch.setattr(clusters, "KNOT", 8)
    assert _clusters(segs) == plain
    assert len(tested) == 2 and 3 * sum(tested) < 2 * every
    assert plain[2000] == plain[2001] == 2000 and plain[2002] == 2002 and plain[1000] != plain[1002]

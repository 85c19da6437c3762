"""Areas as cells and edges beside plain ring walks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from siterank.functions.geometry import ring_edges
from siterank.operators import within
from siterank.operators.covers import cover, full_pairs, near_pairs, numbered

RING = "array<array<struct<x:double,y:double>>>"


def holed(cx, cy, r, corners, rng, low=0.6):
    """A star of many corners on whole metres, with a square hole."""
    out = []
    for i in range(corners):
        a, far = 2 * math.pi * i / corners, r * (1 if i % 2 else rng.uniform(low, 0.99))
        out.append((float(round(cx + far * math.cos(a))), float(round(cy + far * math.sin(a)))))
    h = r // 4
    return [out, [(cx - h, cy - h), (cx + h, cy - h), (cx + h, cy + h), (cx - h, cy + h)]]


def edges_of(rings):
    return [(*ring[i], *ring[(i + 1) % len(ring)]) for ring in rings for i in range(len(ring))]


def plain_d2(x, y, rings):
    """Squared distance to the area, and whether the exact test for a reach holds."""
    best, odd = math.inf, False
    for x1, y1, x2, y2 in edges_of(rings):
        dx, dy = x2 - x1, y2 - y1
        dot, long = (x - x1) * dx + (y - y1) * dy, dx * dx + dy * dy
        turn = (x - x1) * dy - (y - y1) * dx
        d = (x - x1) ** 2 + (y - y1) ** 2 if dot <= 0 else (x - x2) ** 2 + (y - y2) ** 2 if dot >= long else turn * turn / long
        best = min(best, d)
        if (y1 > y) != (y2 > y) and (turn < 0) == (y2 > y1):
            odd = not odd
    return 0.0 if odd else best


@pytest.fixture(scope="module")
def shapes(spark):
    rng = random.Random(11)
    rings = {i: holed(float(rng.randint(0, 3000)), float(rng.randint(0, 3000)), rng.choice([3.0, 40.0, 300.0, 900.0]), rng.choice([6, 60, 900]), rng) for i in range(9)}
    rings[20] = [[(0.0, 0.0), (1000.0, 0.0), (1000.0, 1000.0), (0.0, 1000.0)]]  # sides along cells and rows
    rings[21] = [[(100.0, 100.0), (2900.0, 130.0), (120.0, 140.0)]]  # long and thin
    rings[22] = [[(5.0, 5.0), (5.0, 5.0), (5.0, 5.0)]]  # a point
    rings[24] = holed(1500.0, 1500.0, 900.0, 900, rng, 0.98)
    rings[23] = [[(-700.0, -700.0), (-100.0, -700.0), (-100.0, -100.0), (-700.0, -100.0)]]  # below zero
    rows = [(k, [[{"x": x, "y": y} for x, y in ring] for ring in v]) for k, v in rings.items()]
    bad = [(90, None), (91, []), (92, [[{"x": 0.0, "y": float("nan")}, {"x": 9.0, "y": 9.0}, {"x": 0.0, "y": 9.0}]])]
    df = spark.createDataFrame(rows + bad, f"id long, rings {RING}").withColumn("edges", ring_edges(F.col("rings"))).drop("rings")
    spots = [(float(rng.randint(-800, 3500)), float(rng.randint(-800, 3500))) for _ in range(300)]
    spots += [p for v in rings.values() for p in v[0][:4]]  # corners
    spots += [((a + c) / 2, (b + d) / 2) for v in rings.values() for a, b, c, d in edges_of(v)[:3]]  # beside or on edges
    spots += [(50.292 * i, 50.292 * j) for i in range(4) for j in range(4)]  # corners of cells
    sites = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(spots)] + [(999, None, 1.0), (998, float("nan"), 1.0)], "site_id long, x double, y double")
    return rings, spots, df, sites


@pytest.mark.parametrize("reach", [0.0, 30.0, 700.0])
def test_near_areas_match_ring_walks(shapes, reach):
    rings, spots, df, sites = shapes
    areas = numbered(df.withColumn("reach", F.lit(reach)))
    found = near_pairs(sites, cover(areas)).join(areas, "_area").select("site_id", "id").collect()
    want = {(i, k): plain_d2(x, y, v) for i, (x, y) in enumerate(spots) for k, v in rings.items()}
    edge = {p for p, d in want.items() if 0 < abs(d - reach * reach) < 1e-6 * max(1.0, reach)}  # within rounding of the reach
    got = [(r.site_id, r.id) for r in found]
    assert len(got) == len(set(got))
    assert set(got) - edge == {p for p, d in want.items() if d <= reach * reach} - edge


def test_cells_without_edges_answer_most(shapes):
    """The inner cells of a star of 900 corners are few, and hold most of its points."""
    rings, _, df, sites = shapes
    star = numbered(df.filter("id = 24").withColumn("reach", F.lit(0.0)))
    cells = cover(star)
    assert cells.full.count() < 2 * 904
    grid = sites.sparkSession.range(2500).selectExpr("id AS site_id", "double(id % 50 * 36 + 600) AS x", "double(id div 50 * 36 + 600) AS y")
    held = near_pairs(grid, cells).count()
    assert held == sum(plain_d2(600.0 + 36 * (i % 50), 600.0 + 36 * (i // 50), rings[24]) == 0 for i in range(2500))
    assert full_pairs(grid, cells).count() > held / 2


def test_operators_agree_for_rings_of_any_size(shapes, monkeypatch):
    rings, spots, df, sites = shapes
    layer = lambda: within.Layer(df.withColumn("one", F.lit(1)), 120.0, {"n": F.col("one").cast("long"), "ids": F.col("id")}, "area")
    few = sites.filter("site_id < 380")

    def answers():
        return (
            sorted(map(tuple, within.tally(few, [layer()]).collect())),
            sorted((r.site_id, r.id, round(r.dist, 6)) for r in within.pairs_within(few, df, 120.0, "area", ["id"]).collect()),
        )

    usual = answers()
    monkeypatch.setattr(within, "FEW", -1)
    assert answers() == usual
    want = {i: sum(plain_d2(x, y, v) <= 120.0**2 for v in rings.values()) for i, (x, y) in enumerate(spots) if i < 380}
    assert {r[0]: r[1] for r in usual[0] if r[0] < 380} == want

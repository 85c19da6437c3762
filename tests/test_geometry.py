"""Hand cases of distances, areas and intervals."""

import math
import random

import pytest
from pyspark.sql import functions as F

from siterank.functions.geometry import area_holds, ring_edges
from siterank.operators import lines, lookup, within


def points(spark, rows, names="site_id long, x double, y double"):
    return spark.createDataFrame([tuple(float(v) if i else v for i, v in enumerate(r)) for r in rows], names)


def segs(spark, rows):
    return spark.createDataFrame(
        [(a, b, *[float(v) for v in r]) for a, b, *r in rows],
        "line_id long, seg_no int, x1 double, y1 double, x2 double, y2 double",
    )


def area(spark, *rings, id=1):
    data = [(id, [[(float(x), float(y)) for x, y in ring] for ring in rings])]
    df = spark.createDataFrame(data, "id long, rings array<array<struct<x:double,y:double>>>")
    return df.select("id", ring_edges(F.col("rings")).alias("edges"))


def as_dict(df, value):
    return {r["site_id"]: r[value] for r in df.collect()}


def test_radius_is_inclusive(spark):
    sites = points(spark, [(1, 0, 0), (2, 0, 0.001)])
    near = points(spark, [(9, 300, -400)], "id long, x double, y double")
    assert as_dict(within.count_within(sites, near, 500.0, {"n": F.lit(True)}), "n") == {1: 1, 2: 0}


def test_area_edge_corner_and_hole(spark):
    shape = area(spark, [(0, 0), (90, 0), (90, 90), (0, 90)], [(30, 30), (60, 30), (60, 60), (30, 60)])
    sites = points(spark, [(1, 10, 10), (2, 45, 45), (3, 30, 45), (4, 90, 90), (5, 91, 90), (6, 0, 33)])
    inside = {r["site_id"] for r in within.points_in_areas(sites, shape).collect()}
    assert inside == {1, 3, 4, 6}
    assert as_dict(within.flag_within(sites, shape, 15.0, "n", "area"), "n") == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1}
    assert as_dict(within.flag_within(sites, shape, 14.5, "n", "area"), "n")[2] == 0


def test_parity_on_random_triangles(spark):
    random.seed(3)
    rows = []
    for i in range(200):
        t = [(random.randint(0, 20), random.randint(0, 20)) for _ in range(3)]
        rows.append((i, [[(float(a), float(b)) for a, b in t]], random.randint(0, 20) + 0.5, random.randint(0, 20) + 0.25))
    df = spark.createDataFrame(rows, "id long, rings array<array<struct<x:double,y:double>>>, x double, y double")
    got = df.select("id", area_holds(F.col("x"), F.col("y"), ring_edges(F.col("rings"))).alias("in_it")).collect()

    def turn(a, b, p):
        return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])

    for (i, rings, x, y), row in zip(rows, sorted(got)):
        a, b, c = rings[0]
        turns = [turn(a, b, (x, y)), turn(b, c, (x, y)), turn(c, a, (x, y))]
        assert row["in_it"] == (all(t > 0 for t in turns) or all(t < 0 for t in turns)), (i, rings, x, y)


def test_zero_length_segment_is_a_point(spark):
    sites = points(spark, [(1, 0, 0), (2, 10, 0)])
    dot = segs(spark, [(7, 0, 3, 4, 3, 4)])
    assert as_dict(within.flag_within(sites, dot, 5.0, "n", "segment"), "n") == {1: 1, 2: 0}
    assert lines.clip_to_radius(sites, dot, 50.0).count() == 0


def test_equal_distance_takes_smallest_id(spark):
    sites = points(spark, [(1, 0, 0)])
    near = points(spark, [(5, 10, 0), (3, 0, 10), (4, -10, 0)], "id long, x double, y double")
    look = lookup.Lookup(near, 50.0, "id", {"id": "id"})
    assert as_dict(lookup.lookup_within(sites, [look], "point"), "id") == {1: 3}
    assert as_dict(lookup.nearest(sites, near, "point", "id", {"id": "id"}), "id") == {1: 3}


def test_nearest_far_away_and_empty(spark):
    sites = points(spark, [(1, 0, 0), (2, 5_000_000, 0)])
    near = points(spark, [(5, 10, 0), (6, 20, 0)], "id long, x double, y double")
    got = lookup.nearest(sites, near, "point", "id", {"id": "id"}, "dist").collect()
    assert {r["site_id"]: (r["id"], r["dist"]) for r in got} == {1: (5, 10.0), 2: (6, 4_999_980.0)}
    nothing = lookup.nearest(sites, near.limit(0), "point", "id", {"id": "id"}, "dist").collect()
    assert {(r["id"], r["dist"]) for r in nothing} == {(None, None)}


def test_nearest_with_a_crowd(spark):
    """Blocks of many features on the shuffled path."""
    sites = points(spark, [(i, (i * 7919) % 5000, (i * 104729) % 5000) for i in range(300)])
    feats = spark.range(30_000).select(
        "id", (F.col("id") % 300 / 10).alias("x"), (F.floor(F.col("id") / 300) / 10).alias("y")
    )
    got = as_dict(lookup.nearest(sites, feats, "point", "id", {"id": "id"}, "dist"), "dist")
    for s in sites.collect():
        cx, cy = min(max(s.x, 0), 29.9), min(max(s.y, 0), 9.9)
        assert got[s.site_id] == pytest.approx(math.hypot(s.x - cx, s.y - cy), abs=0.08)


def test_clip_lengths(spark):
    sites = points(spark, [(1, 0, 0)])
    line = segs(spark, [(1, 0, -100, 0, 100, 0), (2, 0, -100, 6, 100, 6), (3, 0, 1, 1, 2, 1), (4, 0, 0, 50, 9, 50)])
    got = {r["line_id"]: r["len_m"] for r in lines.clip_to_radius(sites, line, 10.0).collect()}
    assert got == {1: pytest.approx(20), 2: pytest.approx(16), 3: pytest.approx(1)}


def test_copies_of_a_line_count_each_time_when_clipped(spark):
    sites = points(spark, [(1, 0, 0)])
    line = segs(spark, [(i, 0, -100, 0, 100, 0) for i in range(50)])
    got = lines.clip_miles(sites, line, 10.0, {"m": F.lit(True)}).first()["m"]
    assert got == pytest.approx(50 * 20 / 1609.34)


def length(df):
    return df.select(F.sum(F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2)))).first()[0]


def test_erase_matches_sampling(spark):
    random.seed(5)

    def some(n, base):
        return [(base + i, 0, *[random.randint(0, 400) for _ in range(4)]) for i in range(n)]

    left, eraser, r = some(12, 0), some(4, 100), 30.0
    kept = length(lines.erase_near(segs(spark, left), segs(spark, eraser), r)) or 0.0

    def dist(px, py, ax, ay, bx, by):
        dd = (bx - ax) ** 2 + (by - ay) ** 2
        u = max(0.0, min(1.0, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / dd)) if dd else 0.0
        return math.hypot(px - ax - u * (bx - ax), py - ay - u * (by - ay))

    total, n = 0.0, 4000
    for _, _, x1, y1, x2, y2 in left:
        free = sum(
            all(dist(x1 + (x2 - x1) * t, y1 + (y2 - y1) * t, *e[2:]) > r for e in eraser)
            for t in ((k + 0.5) / n for k in range(n))
        )
        total += math.hypot(x2 - x1, y2 - y1) * free / n
    assert kept == pytest.approx(total, abs=1.0)


def test_erase_without_eraser_keeps_everything(spark):
    line = segs(spark, [(1, 0, 0, 0, 1000, 0), (2, 0, 0, 0, 0, 10)])
    assert length(lines.erase_near(line, line.limit(0), 30.0)) == pytest.approx(1010)
    assert lines.erase_near(line, line, 30.0).count() == 0


def test_dissolve_counts_overlaps_once(spark):
    rows = [(i, 0, 0, 0, 300, 0) for i in range(40)]  # copies
    rows += [(50, 0, 500, 0, 200, 0), (51, 0, 499, 0, 501, 0)]  # reversed and partly overlapping
    rows += [(52, 0, 700, 0, 800, 0)]  # apart on the same line
    rows += [(53, 0, 0, 1, 300, 1)]  # parallel
    rows += [(54, 0, 0, 0, 3000, 3000), (55, 0, 1000, 1000, 5000, 5000)]  # diagonal over several chunks
    df = segs(spark, rows).withColumn("regstat", F.lit(1))
    assert length(lines.dissolve_pieces(df, ["regstat"])) == pytest.approx(501 + 100 + 300 + 5000 * math.sqrt(2))


def test_erase_then_dissolve_commutes_with_clip(spark):
    sites = points(spark, [(1, 50, 0)])
    line = segs(spark, [(1, 0, 0, 0, 100, 0), (2, 0, 20, 0, 60, 0)]).withColumn("regstat", F.lit(1))
    once = lines.dissolve_pieces(line, ["regstat"])
    local = lines.erase_near(once, segs(spark, [(9, 0, 0, 10, 30, 10)]), 10.0, ["regstat", "line_id", "seg_no"])
    got = lines.clip_miles(sites, local, 40.0, {"m": F.lit(True)}).first()["m"]
    assert got == pytest.approx((90 - 30) / 1609.34)  # what touches the eraser's rim in one point stays or goes as 0

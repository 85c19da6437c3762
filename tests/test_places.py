"""Sites and features at one place are one piece of work, whatever their number."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siterank.functions.geometry import ring_edges
from siterank.operators import covers, lines, lookup, pyramid, within


def _sites(spark, copies=40):
    """Two places with many sites each, one site of two places and one without a place."""
    rows = [(i, 10.0 * (i % 2), 0.0) for i in range(2 * copies)] + [(1, 0.0, 0.0), (-1, None, 0.0)]
    return spark.createDataFrame(rows, "site_id long, x double, y double")


def _spots(spark, many=3):
    rows = [(i, float(i % 50), 0.0) for i in range(50 * many)]
    return spark.createDataFrame(rows, "id long, x double, y double")


def _probed(monkeypatch, module):
    seen, plain = [], module.candidates

    def counted(probes, *args, **kwargs):
        seen.append(probes.count())
        return plain(probes, *args, **kwargs)

    monkeypatch.setattr(module, "candidates", counted)
    return seen


def test_tally_looks_at_places(spark, monkeypatch):
    seen = _probed(monkeypatch, within)
    got = {r["site_id"]: r["n"] for r in within.tally(_sites(spark), [within.Layer(_spots(spark), 2.0, {"n": F.lit(1).cast("bigint")})]).collect()}
    assert seen == [2]
    # (0, 0) has the spots 0, 1, 2; (10, 0) has 8 to 12; site 1 is at both
    assert (got[0], got[3], got[1], got[-1]) == (9, 15, 24, 0)


def test_lowest_and_miles_look_at_places(spark, monkeypatch):
    segs = spark.createDataFrame([(1, 0, -5.0, 1.0, 5.0, 1.0, 2), (2, 0, 4.0, 0.0, 20.0, 0.0, 1)], "line_id long, seg_no int, x1 double, y1 double, x2 double, y2 double, tier int")
    low, cut = _probed(monkeypatch, within), _probed(monkeypatch, lines)
    tiers = {r["site_id"]: r["t"] for r in within.lowest_within(_sites(spark), segs, 2.0, "tier", "t").collect()}
    miles = {r["site_id"]: r["m"] for r in lines.clip_miles(_sites(spark), segs, 2.0, {"m": F.lit(True)}, 1.0).collect()}
    assert (low, cut) == ([2], [2])
    assert (tiers[0], tiers[3], tiers[1], tiers[-1]) == (2, 1, 1, None)
    assert miles[0] == pytest.approx(2 * 3**0.5) and miles[3] == pytest.approx(4.0) and miles[1] == pytest.approx(4 + 2 * 3**0.5)


def test_crowds_are_of_places(spark, monkeypatch):
    monkeypatch.setattr(pyramid, "CROWD", 100)
    monkeypatch.setattr(within, "CROWD", 100)
    monkeypatch.setattr(within, "is_small", lambda df: False)
    layer = within.Layer(_spots(spark, 20), 2.0, {"n": F.lit(1).cast("bigint")})
    assert within.crowded([layer], within._stack([layer])) == ([], [layer])  # 4 spots in a cell, not 80 points


def test_circles_of_places(spark):
    cells = pyramid.circle_cells(_sites(spark), 2.0, 0, 0)
    assert cells.select("x", "y").distinct().count() == 2 and cells.count() <= 8


def test_nearest_is_bounded_by_points_of_features(spark, monkeypatch):
    """Long features: their boxes reach far, their ends are near."""
    segs = spark.createDataFrame([(i, 100.0 * i, 0.0, 100.0 * i + 5000.0, 900.0) for i in range(30)], "line_id long, x1 double, y1 double, x2 double, y2 double")
    sites = spark.createDataFrame([(i, 100.0 * i, -1.0) for i in range(30)], "site_id long, x double, y double")
    rounds = _probed(monkeypatch, lookup)
    got = lookup.nearest(sites, segs, "segment", "line_id", {"line_id": "line_id"}, "dist").collect()
    assert all(r["line_id"] == r["site_id"] and r["dist"] == pytest.approx(1.0) for r in got)
    assert len(rounds) == 1


def test_equal_rings_are_covered_once(spark, monkeypatch):
    seen, plain = [], covers.cover

    def counted(areas):
        seen.append(areas.count())
        return plain(areas)

    monkeypatch.setattr(within, "cover", counted)
    ring = [(float(i), 0.0) for i in range(20)] + [(19.0, 20.0), (0.0, 20.0)]
    rings = spark.createDataFrame([(i, [ring]) for i in range(5)], "v long, rings array<array<struct<x:double,y:double>>>")
    areas = rings.select("v", ring_edges(F.col("rings")).alias("edges"))
    sites = spark.createDataFrame([(1, 5.0, 5.0), (2, 5.0, -3.0), (3, 50.0, 50.0)], "site_id long, x double, y double")
    got = within.tally(sites, [within.Layer(areas, 2.0, {"s": F.col("v")}, "area")]).collect()
    flags = within.flag_within(sites, areas, 2.0, "f", "area").collect()
    assert seen == [1, 1]
    assert {r["site_id"]: r["s"] for r in got} == {1: 10, 2: 0, 3: 0}
    assert {r["site_id"]: r["f"] for r in flags} == {1: 1, 2: 0, 3: 0}


def test_hidden_parts_meet_no_eraser(spark, monkeypatch):
    """Erasers 10 m apart hide a field: only parts on its rim are compared with them."""
    eraser = spark.createDataFrame([(0.0, 10.0 * i, 1000.0, 10.0 * i) for i in range(101)], "x1 double, y1 double, x2 double, y2 double")
    rows = [(i, 0, 300.0, 200.0 + 5 * i, 700.0, 200.0 + 5 * i) for i in range(100)] + [(200, 0, 900.0, 500.0, 1300.0, 500.0), (201, 0, 5000.0, 0.0, 5100.0, 0.0)]
    segs = spark.createDataFrame(rows, "line_id long, seg_no int, x1 double, y1 double, x2 double, y2 double")
    seen = _probed(monkeypatch, lines)
    kept = {r["line_id"]: (r["x1"], r["x2"]) for r in lines.erase_near(segs, eraser, 60.96).collect()}
    assert set(kept) == {200, 201} and kept[201] == (5000.0, 5100.0)
    assert kept[200] == (pytest.approx(1060.96), 1300.0) or kept[200][1] == 1300.0
    assert seen[0] <= 4


def _rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_pairs_and_pieces_look_at_places(spark, monkeypatch):
    """81 sites of two places are 2 circles of ids; site 1 is at both places, site 0 is given twice."""
    sites = _sites(spark).unionByName(spark.createDataFrame([(0, 0.0, 0.0)], "site_id long, x double, y double"))
    segs = spark.createDataFrame([(1, 0, -5.0, 1.0, 5.0, 1.0), (1, 1, 5.0, 1.0, 5.0, 9.0), (2, 0, 0.0, 1.5, 20.0, 1.5)], "line_id long, seg_no int, x1 double, y1 double, x2 double, y2 double")
    seen, cut = _probed(monkeypatch, within), _probed(monkeypatch, lines)
    pairs = within.pairs_within(sites, segs, 2.0, "segment", ["line_id"])
    assert _rows(pairs.filter("site_id < 2"), "site_id", "line_id", "dist") == [(0, 1, 1.0), (0, 1, 1.0), (0, 2, 1.5), (0, 2, 1.5), (1, 1, 1.0), (1, 2, 1.5), (1, 2, 1.5)]
    near = within.pairs_within(sites, segs, 2.0, "segment", ["line_id"], per_place=True)
    nearest = [F.min("dist").alias("dist")]
    once = within.to_sites(sites, near.groupBy("x", "y", "line_id").agg(*nearest), ["line_id"], nearest)
    assert _rows(once.filter("site_id < 4"), "site_id", "line_id", "dist") == [(0, 1, 1.0), (0, 2, 1.5), (1, 1, 1.0), (1, 2, 1.5), (2, 1, 1.0), (2, 2, 1.5), (3, 2, 1.5)]
    pieces = lines.clip_to_radius(sites, segs, 2.0, light=False)
    assert _rows(pieces.filter("site_id = 0 and line_id = 1"), "site_id", "line_id", "seg_no") == [(0, 1, 0), (0, 1, 0)]
    of_places = lines.clip_to_radius(sites, segs, 2.0, light=False, per_place=True)
    sums = [{r["site_id"]: r["m"] for r in lines.sum_pieces(sites, p, {"m": F.col("line_id") == 1}, 1.0).collect()} for p in (pieces, of_places)]
    assert sums[0].keys() == sums[1].keys() and all(sums[0][k] == pytest.approx(sums[1][k]) for k in sums[0])
    assert sums[1][0] == pytest.approx(4 * 3**0.5) and sums[1][2] == pytest.approx(2 * 3**0.5) and sums[1][-1] == 0
    # crews of 64 ids: (0, 0) has 42 rows, (10, 0) 40
    assert seen == [2, 2] and set(cut) == {2}


def test_crews_hold_a_bounded_number_of_ids(spark):
    rows = spark.range(1000).selectExpr("id % 700 as site_id", "0.0D as x", "0.0D as y")
    rows = rows.unionByName(spark.range(500).selectExpr("cast(null as bigint) as site_id", "0.0D as x", "0.0D as y"))
    from siterank.operators import grid

    found = grid.crews(rows)
    assert found.count() > 10 and found.agg(F.max(F.size("crew"))).first()[0] <= 4 * grid.CREW
    back = grid.each_of_crew(found).groupBy("site_id").count().collect()
    assert {r["site_id"]: r["count"] for r in back} == {i: 1 + (i < 300) for i in range(700)} | {None: 500}


def test_clusters_look_at_places(spark, monkeypatch):
    segs = spark.createDataFrame([(7, -5.0, 1.0, 5.0, 1.0), (7, 0.0, 1.5, 5.0, 1.5), (8, 9.0, 1.0, 20.0, 1.0)], "cluster_id long, x1 double, y1 double, x2 double, y2 double")
    seen = _probed(monkeypatch, within)
    got = {r["site_id"]: r["n"] for r in within.clusters_within(_sites(spark), {"n": segs}, 2.0).collect()}
    assert seen == [2] and (got[0], got[3], got[1], got[-1]) == (1, 1, 2, 0)


def test_points_in_equal_rings(spark, monkeypatch):
    seen, plain = [], covers.cover

    def counted(areas):
        seen.append(areas.count())
        return plain(areas)

    monkeypatch.setattr(within, "cover", counted)
    ring = [(float(i), 0.0) for i in range(20)] + [(19.0, 20.0), (0.0, 20.0)]
    box = [(0.0, 0.0), (6.0, 0.0), (6.0, 6.0), (0.0, 6.0)]
    rings = spark.createDataFrame([(i, [ring]) for i in range(5)] + [(9, [box])], "id long, rings array<array<struct<x:double,y:double>>>")
    areas = rings.select("id", ring_edges(F.col("rings")).alias("edges"))
    # a site given twice is on a rim once
    sites = spark.createDataFrame([(1, 5.0, 5.0), (2, 5.0, -3.0), (3, 18.7, 0.0), (3, 18.7, 0.0), (4, None, 5.0)], "site_id long, x double, y double")
    got = _rows(within.points_in_areas(sites, areas), "site_id", "id")
    assert seen == [1]
    assert got == sorted([(1, i) for i in (0, 1, 2, 3, 4, 9)] + [(3, i) for i in range(5)])


def test_divisor_of_many_steps(spark):
    """Neighbouring Fibonacci numbers take the most steps, more than are compiled."""
    import math

    fib = [1, 1]
    while len(fib) < 60:
        fib.append(fib[-1] + fib[-2])
    rows = [(fib[i + 1], fib[i]) for i in range(60 - 1)] + [(0, 5), (5, 0), (12, 18), (10**12, 10**6), (7, 7), (9_999_991, 3_000_000)]
    df = spark.createDataFrame(rows, "a long, b long")
    assert all(r["g"] == math.gcd(r["a"], r["b"]) for r in lines._with_divisor(df, "g", F.col("a"), F.col("b")).collect())


def test_circle_cells_are_dealt_out_and_few(spark, monkeypatch):
    """A few sites make many cells, in many tasks; where points crowd, cells hold dozens of them."""
    sites = spark.range(60).select(F.col("id").alias("site_id"), (F.col("id") * 37 % 1000 + 0.5).alias("x"), (F.col("id") * 71 % 1000 + 0.25).alias("y"))
    points = spark.range(20000).select((F.col("id") * 7919 % 2003).cast("double").alias("px"), (F.col("id") * 104729 % 1999).cast("double").alias("py"), F.lit(1).alias("n"))
    assert pyramid.circle_cells(sites, 800.0, 4, 2).select(F.spark_partition_id()).distinct().count() > 1
    rows, plain = [], pyramid.stage
    monkeypatch.setattr(pyramid, "stage", lambda df, name: rows.append((name, df.count())) or plain(df, name))
    got = {r["site_id"]: r["n"] for r in pyramid.circle_sums(sites, points, 800.0, ["n"]).collect()}
    assert dict(rows)["circle-cells"] < 60 * 200
    near = sites.crossJoin(points).filter("(x - px) * (x - px) + (y - py) * (y - py) <= 640000").groupBy("site_id").count()
    assert got == {r["site_id"]: r["count"] for r in near.collect()}


def test_nearest_sees_few_blocks(spark, monkeypatch):
    """Spread points: a place sees the blocks nearby, and what is worth opening is worked out once."""
    sites = spark.range(100).select(F.col("id").alias("site_id"), (F.col("id") * 331 % 10007).cast("double").alias("x"), (F.col("id") * 877 % 10009).cast("double").alias("y"))
    points = spark.range(4000).select("id", (F.col("id") * 7919 % 10007).cast("double").alias("x"), (F.col("id") * F.col("id") * 31 % 10009).cast("double").alias("y"))
    seen, plain = [], lookup.candidates

    def counted(*args, **kwargs):
        pairs = plain(*args, **kwargs)
        seen.append(pairs.count())
        return pairs

    monkeypatch.setattr(lookup, "candidates", counted)
    got = {r["site_id"]: r["dist"] for r in lookup.nearest(sites, points, "point", "id", {"id": "id"}, "dist").collect()}
    assert seen[0] < 100 * 10
    pairs = sites.crossJoin(points.select(F.col("x").alias("px"), F.col("y").alias("py")))
    best = pairs.groupBy("site_id").agg(F.min(F.expr("(x - px) * (x - px) + (y - py) * (y - py)")).alias("d")).collect()
    assert got == {r["site_id"]: pytest.approx(r["d"] ** 0.5) for r in best}

"""Exact line keys, rows without coordinates, ids of places, crowds, size checks, sinks."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from siterank.functions.geometry import ring_edges
from siterank.operators import clusters, grid, lines, lookup, roster, skew, within
from siterank.sources import staging, write_sites


def test_diagonal_overlaps_on_utm_coordinates_are_exact(spark):
    """20,000 pairs on one line each, overlapping by a known number of steps, many of them reversed."""
    random.seed(3)
    rows, want = [], 0.0
    for i in range(20_000):
        dx, dy = random.randint(-40, 40), random.randint(-40, 40)
        if dx == 0 and dy == 0:
            dx = 1
        x, y = random.randint(300_000, 700_000) / 8, random.randint(38_000_000, 40_000_000) / 8
        n, shift, m = random.randint(1, 9), random.randint(0, 12), random.randint(1, 9)
        cover = n + m if shift > n else max(n, shift + m)
        want += math.hypot(dx, dy) / 8 * cover
        for a, b in ((0, n), (shift, shift + m)):
            a, b = (a, b) if random.random() < 0.5 else (b, a)
            rows.append((i, x + dx / 8 * a, y + dy / 8 * a, x + dx / 8 * b, y + dy / 8 * b))
    segs = spark.createDataFrame(rows, "k int, x1 double, y1 double, x2 double, y2 double")
    once = lines.dissolve_pieces(segs, ["k"])
    length = F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2))
    assert math.isclose(once.agg(F.sum(length)).first()[0], want, rel_tol=1e-9)


def test_dissolve_cuts_long_lines_and_keeps_gaps(spark):
    rows = [("a", 0.0, 0.0, 6000.0, 8000.0), ("a", 3000.0, 4000.0, 0.0, 0.0), ("a", 6600.0, 8800.0, 7200.0, 9600.0), ("b", 0.0, 0.0, 0.0, -5.0),
            ("b", 0.0, -2.5, 0.0, -7.25), ("b", 1.0, 1.0, 1.0, 1.0), ("b", float("nan"), 0.0, 1.0, 1.0), ("b", None, 0.0, 1.0, 1.0)]
    segs = spark.createDataFrame(rows, "k string, x1 double, y1 double, x2 double, y2 double")
    out = lines.dissolve_pieces(segs, ["k"], 1000.0).collect()
    total = {k: sum(math.hypot(r.x2 - r.x1, r.y2 - r.y1) for r in out if r.k == k) for k in "ab"}
    assert math.isclose(total["a"], 11_000) and math.isclose(total["b"], 7.25) and len([r for r in out if r.k == "a"]) > 10


BAD = [None, float("nan"), float("inf"), float("-inf")]


def test_rows_without_finite_coordinates_are_near_nothing(spark):
    good = [(i, 100.0 * i, 0.0) for i in range(5)]
    rows = good + [(10 + i, b, 1.0) for i, b in enumerate(BAD)] + [(20 + i, 1.0, b) for i, b in enumerate(BAD)]
    sites = spark.createDataFrame(rows, "site_id long, x double, y double")
    feats = sites.withColumnRenamed("site_id", "id")
    bad = {r[0] for r in rows} - {r[0] for r in good}
    near = {r.site_id: (r.n, r.d) for r in lookup.nearest(sites, feats, "point", "id", {"n": "id"}, "d").collect()}
    assert all(near[i] == (i, 0.0) for i in range(5)) and all(near[i] == (None, None) for i in bad)
    counts = {r.site_id: r.n for r in within.count_within(sites, feats, 150.0, {"n": F.lit(True)}).collect()}
    assert [counts[i] for i in range(5)] == [2, 3, 3, 3, 2] and all(counts[i] == 0 for i in bad)
    assert {r.site_id for r in within.exclude_within(sites, feats, 1.0).collect()} == bad
    assert {r.site_id for r in within.keep_within(sites, feats, 1.0).collect()} == set(range(5))
    flags = {r.site_id: r.f for r in within.flag_within(sites, feats, 1.0, "f").collect()}
    assert all(flags[i] == (0 if i in bad else 1) for i in flags)
    none = lookup.nearest(sites, feats.filter(F.col("id").isin(*bad)), "point", "id", {"n": "id"}, "d").collect()
    assert len(none) == len(rows) and all(r.n is None and r.d is None for r in none)


@pytest.mark.parametrize("kind", ["town", "outlier", "copies"])
def test_nearest_with_crowded_features(spark, kind):
    random.seed(5)
    feats = [(i, random.random() * 1e4, random.random() * 1e4) for i in range(50)]
    feats += [(100 + i, 5000 + random.random(), 5000 + random.random()) for i in range(600 if kind == "town" else 100)]
    if kind == "outlier":
        feats.append((9999, 1e9, -1e9))
    if kind == "copies":
        feats += [(5000 + i, 77.0, 88.0) for i in range(500)]
    sites = [(i, random.random() * 1e4, random.random() * 1e4) for i in range(60)] + [(100, 5000.5, 5000.5), (101, 1e9, 0.0)]
    got = lookup.nearest(
        spark.createDataFrame(sites, "site_id long, x double, y double"), spark.createDataFrame(feats, "id long, x double, y double"),
        "point", "id", {"n": "id"}, "d",
    ).collect()
    for r in got:
        _, x, y = next(s for s in sites if s[0] == r.site_id)
        best = min(((f[1] - x) ** 2 + (f[2] - y) ** 2, f[0]) for f in feats)
        assert r.n == best[1] and math.isclose(r.d, math.sqrt(best[0]), abs_tol=1e-9)


def test_blocks_are_small(spark):
    feats = spark.range(3000).select(
        F.col("id"), (F.when(F.col("id") < 2000, F.col("id") / 1000.0).otherwise(F.col("id") * 50.0)).alias("px"), F.lit(0.0).alias("py")
    )
    boxed = grid.with_box(feats, "point", 0.0)
    cut, side = lookup._blocks(boxed, 10_000.0)
    assert cut.groupBy("_side", "_bx", "_by").count().agg(F.max("count")).first()[0] <= lookup.BLOCK
    assert cut.count() == 3000 and 0 < side <= 10_000


def test_two_places_under_one_id_are_told_apart(spark):
    points = spark.createDataFrame([("same", 0.0, 0.0), ("same", 700.0, 0.0)], "site_id string, x double, y double")
    eraser = spark.createDataFrame([(700.0, 0.0)], "x double, y double")
    assert [(r.x, r.y) for r in within.exclude_within(points, eraser, 2.0).collect()] == [(0.0, 0.0)]
    assert [(r.x, r.y) for r in within.keep_within(points, eraser, 2.0).collect()] == [(700.0, 0.0)]
    assert within.exclude_within(points, eraser.filter("x < 0"), 2.0).count() == 2
    with pytest.raises(ValueError, match="2 places share the id same"):
        roster.unique_ids(points)
    keys = spark.range(1000).select((F.col("id") * 1.0).alias("x"), F.lit(0.5).alias("y")).select(roster.site_key().alias("k")).distinct().collect()
    assert len(keys) == 1000 and all(len(r.k) == 32 for r in keys)


def test_no_part_of_a_split_join_gets_more_than_its_share(spark):
    left = spark.range(400).select(F.lit(1).alias("k"), F.col("id").alias("a"))
    right = spark.range(300).select(F.lit(1).alias("k"), F.col("id").alias("b"))
    out = skew.split_join(left, right, ["k"], ["a"], ["b"], floor=20)
    assert out.count() == out.distinct().count() == 400 * 300


def test_size_check_weighs_nested_texts(spark):
    flat = spark.range(100).select(F.repeat(F.lit("x"), 100_000).alias("t"))
    assert not grid.is_small(flat) and grid.is_small(spark.range(100)) and grid.is_small(spark.range(0))
    assert not grid.is_small(flat.select(F.struct(F.array(F.struct("t"))).alias("s"))) and not grid.is_small(spark.range(60_000))


def test_lines_of_different_status_never_meet(spark):
    rows = [("p", 1, -1.0, 0.0, 1.0, 0.0), ("q", 2, 0.0, -1.0, 0.0, 1.0), ("p", 3, -1.0, -1.0, 1.0, 1.0), (None, 4, 0.0, -2.0, 0.1, 2.0), (None, 5, -2.0, 0.1, 2.0, 0.2)]
    segs = spark.createDataFrame([(s, i, 0, *e) for s, i, *e in rows], "status string, line_id long, seg_no int, x1 double, y1 double, x2 double, y2 double")
    assert {(r.u, r.v) for r in clusters.touching_edges(segs, "status").collect()} == {(3, 1), (5, 4)}


def test_sink_splits_large_regions(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").alias("site_id"), F.when(F.col("id") < 900, "big").when(F.col("id") < 990, "small").alias("county"))
    write_sites(df, str(tmp_path / "out"), rows=100)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 1000 and back.filter("county is null").count() == 10
    assert len(list((tmp_path / "out" / "county=big").glob("*.parquet"))) > 1


def test_staged_tables_go_when_told(spark):
    kept = staging.stage(spark.range(5).toDF("id"), "gone")
    assert kept.count() == 5
    path = kept.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    staging.drop_stages(spark)
    assert not os.path.exists(path)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_right_side_of_unknown_size_is_not_broadcast(spark):
    left = spark.range(100).select((F.col("id") % 7).alias("k"), "id")
    right = spark.range(7).select(F.col("id").alias("k"), F.lit("a").alias("v"))
    joined = skew.spread_join(left, right, ["k"], "left", "id")
    assert _plan(joined).count("SortMergeJoin") == 1 and joined.filter("v = 'a'").count() == 100


def test_cells_are_broadcast_only_when_told(spark):
    ring = F.array(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0))]))
    areas = spark.range(50).select("id", ring_edges(ring).alias("edges"))
    sites = spark.range(20).select(F.col("id").alias("site_id"), F.col("id").cast("double").alias("x"), F.lit(5.0).alias("y"))
    hit = grid.touched(sites, grid.with_box(areas, "area", 0.0), within.is_near("area"))
    assert "Broadcast" not in _plan(hit) and sorted(r.x for r in hit.collect()) == [float(i) for i in range(10)]


def test_lookup_in_a_dense_layer_compares_few_pairs(spark, monkeypatch):
    sites = spark.range(400).select(F.col("id").alias("site_id"), (F.col("id") % 20 * 50.0).alias("x"), (F.floor(F.col("id") / 20) * 50.0).alias("y"))
    sites = sites.unionByName(spark.createDataFrame([(900, 4000.0, 0.0), (901, 9e6, 0.0), (None, 0.0, 0.0)], "site_id long, x double, y double"))
    segs = sites.filter("site_id < 400").select(F.col("site_id").alias("line_id"), (F.col("x") + 7).alias("x1"), F.col("y").alias("y1"), (F.col("x") + 19).alias("x2"), F.col("y").alias("y2"))
    pairs, plain = [], lookup.near_features

    def counted(*args):
        near = plain(*args)
        pairs.append(near.count())
        return near

    monkeypatch.setattr(lookup, "near_features", counted)
    out = lookup.lookup_within(sites, [lookup.Lookup(segs, 5000.0, "line_id", {"line": "line_id"}, "dist")], "segment")
    got = {r.site_id: (r.line, r.dist) for r in out.collect()}
    assert all(got[i] == (i, 7.0) for i in range(400)) and got[900] == (19, 4000.0 - 969.0) and got[901] == got[None] == (None, None)
    assert sum(pairs) < 20_000


def test_areas_that_hold_a_site_come_before_those_near_it(spark):
    def corner(i):
        t = 2 * math.pi * i / 24
        return {"x": 500.0 * math.cos(t), "y": 500.0 * math.sin(t)}

    rows = [(1, "b", [[corner(i) for i in range(24)]]), (2, None, [[{"x": 2000.0 + x, "y": y} for x, y in ((0.0, 0.0), (10.0, 0.0), (10.0, 10.0))]]), (0, "c", [[corner(i) for i in range(24)]])]
    areas = spark.createDataFrame(rows, "id int, name string, rings array<array<struct<x:double,y:double>>>").select("id", "name", ring_edges(F.col("rings")).alias("edges"))
    sites = spark.createDataFrame([(1, 0.0, 0.0), (2, 2008.0, 2.0), (3, 600.0, 0.0), (4, 1900.0, 0.0), (5, 9000.0, 0.0), (None, 0.0, 0.0)], "site_id int, x double, y double")
    got = {r.site_id: (r.n, r.d) for r in lookup.lookup_within(sites, [lookup.Lookup(areas, 800.0, "id", {"n": "name"}, "d")], "area").collect()}
    assert got == {1: ("c", 0.0), 2: (None, 0.0), 3: ("c", 100.0), 4: (None, 100.0), 5: (None, None), None: (None, None)}

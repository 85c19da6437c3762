"""Rings are worked out once and equal ones are one."""

from __future__ import annotations

from pyspark.sql import functions as F

from siterank.functions.geometry import ring_edges
from siterank.operators import covers, lookup, within


def _combs(spark, copies=3):
    """Two different toothed squares of 26 edges and more, each given `copies` times, larger ids first."""
    rows = []
    for x0 in (0.0, 100.0):
        rim = [(x0 + 2.0 * i, 3.0 * (i % 2)) for i in range(21)] + [(x0 + 40.0, 40.0), (x0, 40.0)]
        rows += [(int(x0) + copies - i, f"{x0:.0f}-{copies - i}", rim) for i in range(copies)]
    rings = spark.createDataFrame(rows, "id long, name string, rim array<struct<x:double,y:double>>")
    return rings.select("id", "name", ring_edges(F.array("rim")).alias("edges"))


def test_lookup_covers_equal_rings_once(spark, monkeypatch):
    seen, plain = [], covers.cover
    monkeypatch.setattr(within, "cover", lambda areas: (seen.append(areas.count()), plain(areas))[1])
    sites = spark.createDataFrame(
        [(1, 20.0, 20.0), (2, 45.0, 20.0), (3, 95.0, 20.0), (4, 120.0, 40.0), (5, 500.0, 0.0), (6, None, 0.0), (2, 45.0, 20.0)],
        "site_id long, x double, y double",
    )
    got = sorted(tuple(r) for r in lookup.assign_region(sites, _combs(spark), "name", "zone", 60.0).collect())
    assert got == [(1, "0-1"), (2, "0-1"), (2, "0-1"), (3, "100-1"), (4, "100-1"), (5, None), (6, None)]
    assert seen == [2]  # two rings, looked at for the sites inside; the sites left over are outside of all


def test_rings_are_written_before_they_are_looked_at(spark):
    few, many = within.split_areas(_combs(spark))
    assert few.isEmpty() and many.count() == 6
    assert many.inputFiles() and all("/siterank/" in f for f in many.inputFiles())


def test_equal_rings_add_up(spark):
    sites = spark.createDataFrame([(1, 20.0, 20.0), (2, 60.0, 20.0)], "site_id long, x double, y double")
    layer = within.Layer(_combs(spark), 25.0, {"n": F.lit(1).cast("bigint"), "s": F.col("id")}, "area")
    assert sorted(tuple(r) for r in within.tally(sites, [layer]).collect()) == [(1, 3, 6), (2, 3, 6)]

"""Sums over the points of a circle where points crowd: cells that lie wholly within it add a sum made beforehand, and
only the cells on its rim compare points. Pairs grow with the rim and not with what is inside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siterank.functions.geometry import box_dist2, box_far_dist2, finite, point_dist2, settle
from siterank.operators.grid import BASE_CELL, SLACK, per_site, places, point_level, tasks
from siterank.operators.skew import split_join
from siterank.sources.staging import stage

CROWD = 1024  # points around a point, within a cell as wide as the radius, from which on sums are made beforehand
RIM_POINTS = 128  # points of the finest cells at most, about: a cell of a circle costs as much as dozens of points
DEEPEST = 10  # halvings of the radius

KEY = ["_level", "_cx", "_cy"]


def _side(level: Column | int) -> Column:
    return F.lit(BASE_CELL) * F.pow(F.lit(2.0), F.lit(level) if isinstance(level, int) else level)


def crowding(points: DataFrame, radii: list[float]) -> dict[float, float]:
    """By reach, how many points share a cell about as wide as the reach with a point, on average over the points
    (px, py, reach)."""
    side = F.lit(1.0)
    for r in radii:
        side = F.when(F.col("reach") == r, _side(point_level(r) - 1)).otherwise(side)
    here = points.filter(finite("px", "py") & F.col("reach").isin(*radii))
    cells = here.groupBy("reach", F.floor(F.col("px") / side).alias("cx"), F.floor(F.col("py") / side).alias("cy")).agg(F.count(F.lit(1)).alias("n"))
    by_reach = cells.groupBy("reach").agg((F.sum(F.col("n").cast("double") * F.col("n")) / F.sum("n")).alias("n"))
    return {r["reach"]: r["n"] for r in by_reach.collect()}  # one row for each of the radii


def _measured(cells: DataFrame) -> DataFrame:
    """cells with _from and _to, the squared distances of the site to the nearest and farthest point of the cell."""
    cells = settle(cells.drop("_from", "_to"), _s=_side(F.col("_level")))
    cells = settle(cells, _w=F.col("_cx") * F.col("_s"), _b=F.col("_cy") * F.col("_s"))
    cells = settle(cells, _e=F.col("_w") + F.col("_s"), _t=F.col("_b") + F.col("_s"))
    box = [F.col(c) for c in ("_w", "_b", "_e", "_t")]
    measured = settle(cells, _from=box_dist2(F.col("x"), F.col("y"), *box), _to=box_far_dist2(F.col("x"), F.col("y"), *box))
    return measured.drop("_s", "_w", "_b", "_e", "_t")


def circle_cells(sites: DataFrame, radius: float, top: int, finest: int) -> DataFrame:
    """(x, y, _level, _cx, _cy, whole): the cells of the circle of every site's place, the largest that lie wholly within
    it, and of the finest level those on its rim. A cell that does neither is cut in four."""
    side = _side(top)
    reach, inner = F.lit(float(radius) + SLACK), float(radius) - SLACK

    def run(c: str) -> Column:
        return F.explode(F.sequence(F.floor((F.col(c) - reach) / side), F.floor((F.col(c) + reach) / side)))

    # dealt out by a hash of its own: the same columns as in `places` would be no second shuffle
    spots = places(sites).repartition(tasks(sites.sparkSession), F.xxhash64("x", "y"))
    cells = spots.withColumn("_level", F.lit(top))
    cells = _measured(cells.withColumn("_cx", run("x")).withColumn("_cy", run("y")))
    touched = F.col("_from") <= reach * reach
    whole = F.col("_to") <= F.lit(inner * inner if inner > 0 else -1.0)
    cells = cells.filter(touched)
    for level in range(top, finest, -1):
        cut = (F.col("_level") == level) & ~whole
        quarters = F.array(*[
            F.struct((F.col("_level") - 1).alias("l"), (F.col("_cx") * 2 + i).alias("x"), (F.col("_cy") * 2 + j).alias("y")) for i in (0, 1) for j in (0, 1)
        ])
        same = F.array(F.struct(F.col("_level").alias("l"), F.col("_cx").alias("x"), F.col("_cy").alias("y")))
        cells = cells.withColumn("_c", F.explode(F.when(cut, quarters).otherwise(same))).select(
            "x", "y", F.col("_c.l").alias("_level"), F.col("_c.x").alias("_cx"), F.col("_c.y").alias("_cy")
        )
        cells = _measured(cells).filter(touched)
    return cells.select("x", "y", *KEY, whole.alias("whole"))


def circle_sums(sites: DataFrame, points: DataFrame, radius: float, names: list[str], finest: int | None = None) -> DataFrame:
    """(site_id, names): sums of the points (px, py, names) within the radius of each site that may have any. Points
    and sites at one place are one. The finest cells are chosen from how places of points crowd, unless given; the
    result is the same for any."""
    sums = [F.sum(n).alias(n) for n in names]
    merged = stage(points.filter(finite("px", "py")).groupBy("px", "py").agg(*sums), "places")
    top = point_level(radius) - 1
    if finest is None:
        finest, crowd = top, crowding(merged.withColumn("reach", F.lit(float(radius))), [float(radius)]).get(float(radius), 0.0)
        while crowd > RIM_POINTS and top - finest < DEEPEST:
            finest, crowd = finest - 1, crowd / 4
    side = _side(finest)
    own = merged.withColumns({"_cx": F.floor(F.col("px") / side), "_cy": F.floor(F.col("py") / side)})
    small = own.groupBy("_cx", "_cy").agg(*sums).withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(top - finest))))
    tiers = small.select(
        (F.col("_d") + finest).alias("_level"), F.expr("shiftright(_cx, _d)").alias("_cx"), F.expr("shiftright(_cy, _d)").alias("_cy"), *names
    ).groupBy(*KEY).agg(*sums)
    cells = stage(circle_cells(sites, radius, top, finest), "circle-cells")
    inside = cells.filter("whole").join(tiers, KEY).select("x", "y", *names)
    rim = split_join(cells.filter("not whole").drop("_level", "whole"), own, ["_cx", "_cy"], ["x", "y"], ["px", "py"])
    near = point_dist2(F.col("x"), F.col("y"), F.col("px"), F.col("py")) <= float(radius) * float(radius)
    found = inside.unionByName(rim.filter(near).select("x", "y", *names)).groupBy("x", "y").agg(*sums)
    return per_site(sites, found, sums)

"""Areas as cells and edges: what answers whether a point is in an area, or within a reach of it.

Every area gets a grid level that suits its edges and its reach. A cell there is
  full     if every point of it is near: some edge is within reach of all its corners, or no edge is within reach and
           the cell is inside; inner cells are put together to the largest cells without an edge,
  a rim    if only some of its points may be near: it holds the edges within reach, and whether its middle on the west
           side is inside, so a point in it is decided by these few edges,
  nothing  otherwise.
A point is in one cell of a level, so it meets an area at most once: in a full cell without any edge, or in a rim cell
with the edges there. No ring is ever walked, grouped or sorted as a whole.

Inside is decided by parity. Along the middle line of a row of cells each edge that crosses it changes sides in one
cell, so a running count along the row says which cells between the rims are inside. From a rim's west side the way
to a point goes along that side and then along the point's own line; what crosses it is among the rim's edges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siterank.functions.geometry import finite, settle, with_edge_near, with_segment_dist2
from siterank.operators.grid import BASE_CELL, CELL, SLACK, _probe_cells, _side, is_small, light_side, per_site, places
from siterank.operators.skew import split_join
from siterank.sources.staging import stage

ENDS = ["x1", "y1", "x2", "y2"]
LOWEST = -6  # the finest level, cells of 0.8 m
SPARE = 8  # an area's cells are no narrower than its perimeter by its number of edges and so many more
FINE = 2  # and no narrower than its reach by this number
PART = 4  # longer edges are looked at in parts of so many cells' width
CHUNK = 32  # edges of an area that are dealt out together


@dataclass(frozen=True)
class Cover:
    """full: (_level, _cx, _cy, _area); rims: the same and odd, reach and one edge (x1 to y2) a row, of those that may be
    the nearest to a point there; odd is NULL in areas so thin that their inside is near their edges anyway."""

    full: DataFrame
    rims: DataFrame


def _ahead(x: Column, y: Column) -> Column:
    """Which side of the edge's line a point lies on; one on the line counts as if it were a little to the east,
    and much less to the north."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    cross = (x - F.col("x1")) * dy - (y - F.col("y1")) * dx
    return (cross > 0) | ((cross == 0) & ((dy > 0) | ((dy == 0) & (dx < 0))))


def _between(a: str, b: str, line: Column) -> Column:
    """Are the edge's ends on different sides of a line along an axis?"""
    return (F.col(a) > line) != (F.col(b) > line)


def _west() -> Column:
    return F.col("_cx") * _side(F.col("_level"))


def _middle() -> Column:
    return (F.col("_cy") + F.lit(0.5)) * _side(F.col("_level"))


def _edges(areas: DataFrame) -> DataFrame:
    """(_area, _chunk, reach, x1..y2, deep, thin, _level): the edges of areas whose coordinates are all finite, dealt
    out by chunks of edges that follow each other."""
    edges = areas.select("_area", "reach", F.posexplode("edges").alias("_at", "e")).select(
        "_area", F.floor(F.col("_at") / CHUNK).cast("int").alias("_chunk"), "reach", *[F.col(f"e.{c}").alias(c) for c in ENDS]
    )
    per_area = edges.groupBy("_area").agg(
        F.sum(_length()).alias("around"), F.count(F.lit(1)).alias("n"), F.min(finite(*ENDS)).alias("whole"),
        (F.max(F.greatest("x1", "x2")) - F.min(F.least("x1", "x2"))).alias("wide"),
        (F.max(F.greatest("y1", "y2")) - F.min(F.least("y1", "y2"))).alias("high"), F.max("reach").alias("_reach"),
    ).filter("whole")
    least = F.greatest(F.col("around") / (F.col("n") + SPARE), F.col("_reach") / FINE, F.lit(1e-9))
    level = F.greatest(F.ceil(F.log2(least / BASE_CELL) - 1e-9), F.lit(LOWEST)).cast("int")
    span = (F.greatest("wide", "high") + 2 * F.col("_reach")) / _side(F.col("_level")) + 2
    # what is inside such an area is within reach of its rim, so only the rim counts
    thin = F.least("wide", "high") < 2 * (F.col("_reach") - SLACK)
    per_area = per_area.withColumn("_level", level).select("_area", "_level", F.ceil(F.log2(span)).cast("int").alias("deep"), thin.alias("thin"))
    # an edge makes many cells, so few bytes of edges are much work: they are dealt out evenly
    spark = areas.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return edges.join(stage(per_area, "extents"), "_area").repartition(tasks, "_area", "_chunk")


def _length() -> Column:
    return F.sqrt((F.col("x2") - F.col("x1")) * (F.col("x2") - F.col("x1")) + (F.col("y2") - F.col("y1")) * (F.col("y2") - F.col("y1")))


def _half_diagonal() -> Column:
    return _side(F.col("_level")) * F.lit(0.70711) + SLACK


def _listed(rows: DataFrame) -> DataFrame:
    """(_area, reach, _chunk, deep, thin, _level, _cx, _cy, within, cross, off): every edge in every cell it may be near to.
    within: all of the cell is within reach of it; cross: it changes sides along the middle line in this cell; off: its
    squared distance from the cell's middle."""
    side = _side(F.col("_level"))
    parts = F.greatest(F.ceil(_length() / (side * PART)), F.lit(1)).cast("int")
    rows = rows.withColumn("_n", parts).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))

    def end(a: str, b: str, i: Column) -> Column:
        return F.when(i <= 0, F.col(a)).when(i >= F.col("_n"), F.col(b)).otherwise(F.col(a) + (F.col(b) - F.col(a)) * (i / F.col("_n")))

    part, at = F.col("_part"), {}
    for i, (u, v) in {-1: ("zx", "zy"), 0: ("ax", "ay"), 1: ("bx", "by")}.items():
        at |= {f"_{u}": end("x1", "x2", part + i), f"_{v}": end("y1", "y2", part + i)}
    rows = settle(rows, _side=side, _pad=F.col("reach") + SLACK, **at)
    side, pad = F.col("_side"), F.col("_pad")

    def ends(a: str, b: str) -> tuple[Column, Column]:
        return F.floor((F.least(a, b) - pad) / side), F.floor((F.greatest(a, b) + pad) / side)

    cells = rows.withColumn("_cx", F.explode(F.sequence(*ends("_ax", "_bx")))).withColumn("_cy", F.explode(F.sequence(*ends("_ay", "_by"))))
    cells = settle(cells, _w=F.col("_cx") * side, _e=(F.col("_cx") + 1) * side, _s=F.col("_cy") * side, _m=_middle())
    middle = ((F.col("_cx") + F.lit(0.5)) * side, F.col("_m"))
    bound = pad + _half_diagonal()
    # the parts that have a cell follow each other, the first of them lists it
    before = (part > 0) & F.col("_cx").between(*ends("_zx", "_ax")) & F.col("_cy").between(*ends("_zy", "_ay"))
    part_of = lambda *names: tuple(F.col(n) for n in names)
    cells = with_segment_dist2(cells, part_of("_ax", "_ay", "_bx", "_by"), {"_near": middle}).filter(F.col("_near") <= bound * bound)
    cells = with_segment_dist2(cells, part_of("_zx", "_zy", "_ax", "_ay"), {"_had": middle})
    cells = cells.filter(~(before & (F.col("_had") <= bound * bound)))
    inner = F.col("reach") - SLACK
    spots = [(u, v) for u in (F.col("_w"), F.col("_e")) for v in (F.col("_s"), F.col("_s") + side)]
    corners = {f"_f{i}": spot for i, spot in enumerate(spots)}
    cells = with_segment_dist2(cells, part_of(*ENDS), corners | {"off": middle})
    cells = settle(cells, _a0=_ahead(F.col("_w"), F.col("_m")), _a1=_ahead(F.col("_e"), F.col("_m")))
    return cells.select(
        "_area", "reach", "_chunk", "deep", "thin", *CELL, "off",
        ((inner > 0) & (F.greatest(*corners) <= inner * inner)).alias("within"),
        (_between("y1", "y2", F.col("_m")) & (F.col("_a0") != F.col("_a1"))).cast("int").alias("cross"),
    )


def _rims(edges: DataFrame, chunks: DataFrame, cells: DataFrame) -> DataFrame:
    """(_level, _cx, _cy, _area, odd, reach, x1..y2): the edges of cells (with reach, odd and off) that may be the nearest to a
    point there: those no farther from the middle than the nearest and twice half the diagonal. Chunks of edges meet
    the cells they are in, so edges are not shuffled once for each of their cells."""
    limit = F.sqrt("best") + 2 * _half_diagonal()
    near = chunks.select("_area", "_chunk", *CELL, "off").join(cells.withColumnRenamed("off", "best"), ["_area", *CELL])
    near = settle(near, _limit=F.least(limit, F.col("reach") + SLACK + _half_diagonal()), _mx=(F.col("_cx") + F.lit(0.5)) * _side(F.col("_level")), _my=_middle())
    near = near.filter(F.col("off") <= F.col("_limit") * F.col("_limit")).select("_area", "_chunk", *CELL, "odd", "reach", "_limit", "_mx", "_my")
    pairs = edges.select("_area", "_chunk", *ENDS).alias("e").join(near.alias("c").hint("merge"), ["_area", "_chunk"])
    for lo, hi, m in (("x1", "x2", "_mx"), ("y1", "y2", "_my")):
        pairs = pairs.filter(F.col(m).between(F.least(lo, hi) - F.col("_limit"), F.greatest(lo, hi) + F.col("_limit")))
    pairs = with_segment_dist2(pairs, tuple(F.col(c) for c in ENDS), {"_off": (F.col("_mx"), F.col("_my"))})
    return pairs.filter(F.col("_off") <= F.col("_limit") * F.col("_limit")).select(*CELL, "_area", "odd", "reach", *ENDS)


def cover(areas: DataFrame) -> Cover:
    """The cells of areas (_area, reach, edges). Areas without edges, or with a coordinate that is not finite, have none."""
    edges = _edges(areas)
    seen = [F.max("within").alias("within"), F.sum("cross").alias("cross"), F.min("off").alias("off")]
    chunks = stage(_listed(edges).groupBy("_area", "_chunk", "reach", "deep", "thin", *CELL).agg(*seen), "chunks-in-cells")
    listed = stage(chunks.groupBy("_area", "reach", "deep", "thin", *CELL).agg(*seen).withColumnRenamed("within", "whole"), "cells")
    rims = listed.filter("not thin").select("_area", *CELL, "cross", "whole", "deep")
    # cells without an edge, as large as they come: those whose parent has one. d counts levels above the area's own
    up = rims.withColumn("d", F.explode(F.sequence(F.lit(0), F.col("deep"))))
    shift = lambda c, by: F.expr(f"shiftright({c}, {by})")
    taken = up.select("_area", "_level", "d", shift("_cx", "d").alias("x"), shift("_cy", "d").alias("y"), F.lit(1).alias("taken"))
    child = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    parents = up.select("_area", "_level", "d", (shift("_cx", "d + 1") * 2).alias("x"), (shift("_cy", "d + 1") * 2).alias("y")).distinct()
    children = parents.withColumn("c", child).select(
        "_area", "_level", "d", (F.col("x") + F.col("c.i")).alias("x"), (F.col("y") + F.col("c.j")).alias("y"), F.lit(0).alias("taken")
    )
    free = taken.unionByName(children).groupBy("_area", "_level", "d", "x", "y").agg(F.max("taken").alias("taken")).filter("taken = 0")
    # a free cell is inside if its first small cell is: count the crossings before it in its row
    left = lambda c: F.expr(f"shiftleft({c}, d)")
    none = lambda kind: F.lit(None).cast(kind)
    rows = rims.select("_area", "_level", F.col("_cx").alias("col"), F.col("_cy").alias("row"), "cross", "whole", none("int").alias("d")).unionByName(
        free.select("_area", "_level", left("x").alias("col"), left("y").alias("row"), F.lit(0).cast("long").alias("cross"), none("boolean").alias("whole"), "d")
    )
    west = Window.partitionBy("_area", "row").orderBy("col", F.col("d").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    odd = F.pmod(F.coalesce(F.sum("cross").over(west), F.lit(0)), F.lit(2)) == 1
    known = rows.withColumn("odd", odd).filter(F.col("d").isNull() | F.col("odd"))
    d = F.coalesce("d", F.lit(0))
    known = stage(
        known.select(
            "_area", (F.col("_level") + d).alias("_level"), F.expr("shiftright(col, coalesce(d, 0))").alias("_cx"),
            F.expr("shiftright(row, coalesce(d, 0))").alias("_cy"), "odd", (F.col("d").isNotNull() | F.col("whole")).alias("whole"),
        ),
        "cover",
    )
    near = listed.filter("thin and whole").select(*CELL, "_area")
    own = known.filter("not whole").select("_area", *CELL, "odd")
    # of thin areas only the rim counts, so odd is not known
    open_cells = listed.filter("not whole").select("_area", "reach", *CELL, "off").join(own, ["_area", *CELL], "left")
    return Cover(
        near.unionByName(known.filter("whole").select(*CELL, "_area")),
        stage(_rims(edges, chunks, open_cells), "rims"),
    )


def probe(sites: DataFrame, cells: DataFrame) -> DataFrame:
    """sites (x, y, ...) once for each level that occurs in cells, with the cell they are in."""
    return _probe_cells(sites.filter(finite("x", "y")), cells.agg(F.collect_set("_level")).scalar())


def rim_pairs(sites: DataFrame, cells: Cover) -> DataFrame:
    """(site_id, _area): sites in rim cells that are near, each pair once. The edges of a site and an area are all in
    one cell, so they are put together where the join made them, without another shuffle."""
    probes = probe(sites.select("site_id", "x", "y"), cells.rims)
    rims = cells.rims.select(*CELL, "_area", "odd", "reach", *ENDS)
    if is_small(rims):
        same = [F.col(f"p.{c}") == F.col(f"r.{c}") for c in CELL]
        pairs = probes.alias("p").join(F.broadcast(rims).alias("r"), same).select("p.*", "r._area", "r.odd", "r.reach", *[f"r.{c}" for c in ENDS])
        block = list(CELL)
    else:
        pairs = split_join(probes, rims, list(CELL), ["site_id"], ["_area"], parts=True)
        block = [*CELL, "_pl", "_pr"]
    x, y = F.col("x"), F.col("y")
    edge = {c: F.col(c) for c in ENDS}
    pairs = settle(pairs, _w=_west(), _m=_middle())
    west = F.col("_w")
    pairs = settle(pairs, _corner=_ahead(west, y), _start=_ahead(west, F.col("_m")), _here=_ahead(x, y))
    crossed = (_between("x1", "x2", west) & (F.col("_corner") != F.col("_start"))).cast("int") + (
        _between("y1", "y2", y) & (F.col("_corner") != F.col("_here"))
    ).cast("int")
    pairs = with_edge_near(settle(pairs, _crossed=crossed), "_near", x, y, edge, F.col("reach") * F.col("reach"))
    found = pairs.groupBy(*block, "site_id", "_area").agg(F.max("_near").alias("near"), F.sum("_crossed").alias("crossed"), F.first("odd").alias("odd"))
    # odd is NULL where only the rim counts
    inside = F.coalesce((F.pmod("crossed", F.lit(2)) == 1) != F.col("odd"), F.lit(False))
    return found.filter(F.col("near") | inside).select("site_id", "_area")


def full_pairs(sites: DataFrame, cells: Cover) -> DataFrame:
    """(site_id, _area): sites in full cells."""
    probes = probe(sites.select("site_id", "x", "y"), cells.full)
    if is_small(cells.full):
        return probes.join(F.broadcast(cells.full), list(CELL)).select("site_id", "_area")
    return split_join(probes, cells.full, list(CELL), ["site_id"], ["_area"]).select("site_id", "_area")


def near_pairs(sites: DataFrame, cells: Cover) -> DataFrame:
    """(site_id, _area): every site within reach of every area, each pair once."""
    return full_pairs(sites, cells).unionByName(rim_pairs(sites, cells))


def covered_sums(sites: DataFrame, cells: Cover, values: DataFrame, names: list[str]) -> DataFrame:
    """(site_id, names): sums of values (_area, names) over the areas near each site that has any. Full cells are added
    up before they meet a site, so only rim cells make pairs."""
    sums = [F.sum(n).alias(n) for n in names]
    by_cell = stage(cells.full.join(values, "_area").groupBy(*CELL).agg(*sums), "cell-sums")
    spots = places(sites)
    inside = probe(spots, by_cell).join(by_cell, list(CELL)).select("x", "y", *names)
    rim = rim_pairs(spots.withColumn("site_id", F.struct("x", "y")), cells).join(values, "_area").select("site_id.x", "site_id.y", *names)
    inside, rim = (df.groupBy("x", "y").agg(*sums) for df in (inside, rim))
    # a site given twice has its full cells twice, its rim cells once
    once = sites.select("site_id", "x", "y").distinct()
    return per_site(sites, inside, sums).unionByName(per_site(once, rim, sums)).groupBy("site_id").agg(*sums)


def numbered(areas: DataFrame) -> DataFrame:
    """areas with _area, written so that the numbers stay."""
    return stage(areas.withColumn("_area", F.monotonically_increasing_id()), "areas")


def equal_rings(areas: DataFrame, aggs: list[Column]) -> DataFrame:
    """(_area, reach, edges, aggs): areas with equal rings and the same reach as one, put together by `aggs`. Rings are
    told apart by 128 bits and their number of edges, so they are not shuffled; the first row of each has the ring."""
    n = F.size("edges")
    rows = numbered(areas.withColumns({"_n": n} | {f"_h{i}": F.xxhash64(F.lit(i), n, "edges") for i in (0, 1)}))
    once = rows.groupBy("reach", "_n", "_h0", "_h1").agg(F.min("_area").alias("_area"), *aggs).drop("reach", "_n", "_h0", "_h1")
    once = light_side(once, "rings-once")
    return stage(rows.select("_area", "reach", "edges").join(once, "_area"), "rings-once")

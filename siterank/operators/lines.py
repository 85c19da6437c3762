"""Line work on segment tables: clip to circles, erase corridors, count overlaps once.

A segment table has line_id, seg_no, x1, y1, x2, y2 and any attributes. Parts of a segment are handled as
intervals, so every job here is a join, a grouping and a running maximum over sorted intervals.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siterank.functions.geometry import finite, settle, with_capsule_interval, with_circle_interval, with_segment_dist2
from siterank.operators.grid import BASE_CELL, BOX, SLACK, candidates, crews, each_of_crew, is_small, per_site, places, with_box
from siterank.operators.within import GEOMETRY
from siterank.sources.staging import stage

METRES_PER_MILE = 1609.34  # of regional trails (fixed value)
LOCAL_METRES_PER_MILE = 1609.344  # of dissolved local lines (fixed value)
ENDS = GEOMETRY["segment"]
RIM = 1e-5  # metres: what is left of a segment between two erased parts counts from this length on


def clip_to_radius(
    sites: DataFrame, segs: DataFrame, radius: float, keep: list[str] | None = None, light: bool | None = None, per_place: bool = False
) -> DataFrame:
    """(site_id, line_id, seg_no, keep..., t_lo, t_hi, len_m): the part of each segment within each circle.

    Parts of no length are left out. Several segment rows may share line_id and seg_no. Circles of one place are cut
    once; `per_place` leaves the parts at their places, with x, y in place of site_id."""
    keep = keep or []
    light = is_small(segs) if light is None else light
    feats = with_box(segs.select("line_id", "seg_no", *keep, *ENDS), "segment", radius)
    probes, key = (places(sites), ["x", "y"]) if per_place else (crews(sites), ["crew"])
    near = candidates(probes, feats, probes.columns, ENDS, broadcast=light)
    parts = with_circle_interval(near, "x", "y", radius, ENDS, "t_lo", "t_hi")
    length = F.sqrt(_square("x2", "x1") + _square("y2", "y1")) * (F.col("t_hi") - F.col("t_lo"))
    parts = parts.select(*key, "line_id", "seg_no", *keep, "t_lo", "t_hi", length.alias("len_m"))
    return parts if per_place else each_of_crew(parts)


def _square(a: str, b: str) -> Column:
    return (F.col(a) - F.col(b)) * (F.col(a) - F.col(b))


def sum_pieces(
    sites: DataFrame, pieces: DataFrame, filters: dict[str, Column], metres_per_mile: float = METRES_PER_MILE
) -> DataFrame:
    """(site_id, miles per name): the clipped length for which each condition holds, 0 where there is none. Pieces of
    places (x, y) are added up there before they go to the sites."""
    metres = [F.sum(F.when(cond, F.col("len_m"))).alias(name) for name, cond in filters.items()]
    if "site_id" in pieces.columns:
        found = pieces.groupBy("site_id").agg(*metres)
    else:
        found = per_site(sites, pieces.groupBy("x", "y").agg(*metres), [F.sum(name).alias(name) for name in filters])
    miles = found.select("site_id", *[(F.col(name) / metres_per_mile).alias(name) for name in filters])
    return sites.select("site_id").join(miles, "site_id", "left").fillna(0.0, list(filters))


def clip_miles(
    sites: DataFrame, segs: DataFrame, radius: float, filters: dict[str, Column], metres_per_mile: float = METRES_PER_MILE
) -> DataFrame:
    """Clipped miles per site without keeping the pieces; filters are conditions on the segments.

    Segments that coincide are measured once and their lengths multiplied, so copies cost one row; circles of one place
    are cut once."""
    weights = {f"_w{i}": F.sum(F.when(cond, 1.0).otherwise(0.0)) for i, cond in enumerate(filters.values())}
    merged = segs.groupBy(*ENDS).agg(*[w.alias(n) for n, w in weights.items()])
    merged = merged.withColumns({"line_id": F.lit(0), "seg_no": F.lit(0)})
    pieces = clip_to_radius(sites, merged, radius, list(weights), is_small(segs), per_place=True)
    metres = pieces.groupBy("x", "y").agg(*[F.sum(F.col("len_m") * F.col(w)).alias(w) for w in weights])
    miles = per_site(sites, metres, [(F.sum(w) / metres_per_mile).alias(n) for w, n in zip(weights, filters)])
    return sites.select("site_id").join(miles, "site_id", "left").fillna(0.0, list(filters))


def merge_overlaps(intervals: DataFrame, keys: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """First pass of an interval union over (keys, lo, hi), as a plain min and max with map-side combine.

    Intervals that share a point form one interval, so all intervals that hold the same anchor can be
    joined (`carry` columns keep their smallest value). The anchor is the first multiple of a power of two, chosen no wider than half the interval:
    at least one multiple always lies inside. Copies and heavy overlaps collapse before any sort.
    """
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.col("hi") - F.col("lo"))) - 1)
    stepped = settle(intervals.filter(F.col("hi") > F.col("lo")), _step=step)
    return (
        stepped.withColumn("_anchor", F.ceil(F.col("lo") / F.col("_step")))
        .groupBy(*keys, "_step", "_anchor")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), *[F.min(c).alias(c) for c in carry])
        .drop("_step", "_anchor")
    )


def _running(keys: list[str]) -> Column:
    """Largest end of all earlier intervals of the key, by start."""
    w = Window.partitionBy(*keys).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    return F.max("hi").over(w)


def union_intervals(intervals: DataFrame, keys: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """(keys, lo, hi, carry): disjoint parts with the same cover as the given intervals."""
    merged = merge_overlaps(intervals, keys, carry).withColumn("_prev", _running(keys))
    fresh = F.greatest("lo", F.coalesce("_prev", "lo"))
    return merged.withColumn("lo", fresh).filter(F.col("hi") > F.col("lo")).drop("_prev")


def cut_short(segs: DataFrame, length: float) -> DataFrame:
    """Cut segments into equal parts no longer than `length`; part_no numbers them."""
    size = F.sqrt(_square("x2", "x1") + _square("y2", "y1"))
    n = F.greatest(F.ceil(size / F.lit(float(length))), F.lit(1))
    rest = [c for c in segs.columns if c not in ENDS]
    parts = segs.withColumn("_n", n).withColumn("part_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    t0, t1 = F.col("part_no") / F.col("_n"), (F.col("part_no") + 1) / F.col("_n")

    def at(a: str, b: str, t: Column) -> Column:
        return F.when(t == 1, F.col(b)).otherwise(F.col(a) + (F.col(b) - F.col(a)) * t)

    return parts.select(
        *rest, "part_no",
        at("x1", "x2", t0).alias("x1"), at("y1", "y2", t0).alias("y1"),
        at("x1", "x2", t1).alias("x2"), at("y1", "y2", t1).alias("y2"),
    )


def _hidden_cells(eraser: DataFrame, radius: float, side: float) -> DataFrame:
    """(_cx, _cy): the cells that lie wholly within the radius of one segment of the eraser."""
    within = F.lit(radius - side / 2)  # a cell's middle is no farther than this if all of its corners are within reach
    parts = cut_short(eraser.select(*ENDS).filter(finite(*ENDS)), 4.0 * radius)

    def run(a: str, b: str) -> Column:
        return F.explode(
            F.sequence(F.ceil((F.least(a, b) - within) / side - 0.5), F.floor((F.greatest(a, b) + within) / side - 0.5))
        )

    cells = parts.withColumn("_cx", run("x1", "x2")).withColumn("_cy", run("y1", "y2"))
    corners = {
        f"_f{2 * i + j}": ((F.col("_cx") + i) * F.lit(side), (F.col("_cy") + j) * F.lit(side)) for i in (0, 1) for j in (0, 1)
    }
    cells = with_segment_dist2(cells, tuple(F.col(c) for c in ENDS), corners)
    return cells.filter(F.greatest(*corners) <= (radius - SLACK) ** 2).select("_cx", "_cy").distinct()


def _not_hidden(parts: DataFrame, eraser: DataFrame, radius: float) -> DataFrame:
    """The parts without those whose cells are all hidden: nothing is left of them. Every box of cells is looked up
    once for all parts in it, so where erasers crowd no part meets them one by one."""
    side = BASE_CELL * 2.0 ** math.floor(math.log2(radius / BASE_CELL))
    box = ["_c0", "_c1", "_d0", "_d1"]
    ends = [F.least("x1", "x2"), F.greatest("x1", "x2"), F.least("y1", "y2"), F.greatest("y1", "y2")]
    # a part without finite ends has no box and is never dropped
    boxed = parts.withColumns({n: F.when(finite(*ENDS), F.floor(e / side)) for n, e in zip(box, ends)})
    cells = boxed.select(*box).filter(F.col("_c0").isNotNull()).distinct()
    cells = cells.withColumn("_cx", F.explode(F.sequence("_c0", "_c1"))).withColumn("_cy", F.explode(F.sequence("_d0", "_d1")))
    found = cells.join(_hidden_cells(eraser, radius, side).hint("merge"), ["_cx", "_cy"]).groupBy(*box).agg(F.count(F.lit(1)).alias("_n"))
    hidden = found.filter(F.col("_n") == (F.col("_c1") - F.col("_c0") + 1) * (F.col("_d1") - F.col("_d0") + 1)).select(*box)
    return boxed.join(hidden.hint("merge"), box, "left_anti").select(*parts.columns)


def erase_near(segs: DataFrame, eraser: DataFrame, radius: float, key: list[str] | None = None) -> DataFrame:
    """The segment table without the parts within `radius` of any eraser segment.

    `key` names the columns that identify a row of segs. Segments are cut to parts no longer than four
    radii; a part is probed by its middle, with the eraser's reach grown by half that length. Each near
    eraser segment takes one interval out of the part, and what no interval covers is kept, from RIM metres on:
    rims that touch leave slivers of rounding between them. Parts in cells that single eraser segments hide wholly
    are gone before.
    """
    key = key or ["line_id", "seg_no"]
    longest = 4.0 * radius
    part_key = [*key, "part_no"]
    parts = cut_short(segs, longest)
    if radius > 0:
        parts = stage(_not_hidden(parts, eraser, radius), "parts")
    names = {"ax": "x1", "ay": "y1", "bx": "x2", "by": "y2"}
    lines = with_box(eraser.select(*ENDS).distinct(), "segment", radius + longest / 2)
    lines = lines.select(*[F.col(c).alias(n) for n, c in names.items()], *BOX, "reach", "level")
    probes = parts.select(
        *part_key, *ENDS, ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y")
    )
    near = candidates(probes, lines, part_key, list(names), broadcast=is_small(eraser))
    hidden = with_capsule_interval(near, ENDS, radius, list(names), "lo", "hi").select(*part_key, "lo", "hi")
    # Two empty intervals, before and after each part, stand for its ends: the gaps between are what is kept.
    ends = parts.select(*part_key, F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("lo")).withColumn("hi", F.col("lo"))
    cover = merge_overlaps(hidden, part_key).unionByName(ends)
    gaps = (
        cover.withColumn("_prev", _running(part_key))
        .filter(F.col("lo") > F.col("_prev"))
        .select(*part_key, F.col("_prev").alias("_t0"), F.col("lo").alias("_t1"))
    )
    size = F.sqrt(_square("x2", "x1") + _square("y2", "y1"))

    def at(a: str, b: str, t: str) -> Column:
        whole = F.when(F.col(t) == 0, F.col(a)).when(F.col(t) == 1, F.col(b))
        return whole.otherwise(F.col(a) + (F.col(b) - F.col(a)) * F.col(t))

    kept = parts.join(gaps, part_key).filter(size * (F.col("_t1") - F.col("_t0")) >= RIM)
    return kept.select(
        *[c for c in parts.columns if c not in ENDS],
        at("x1", "x2", "_t0").alias("x1"), at("y1", "y2", "_t0").alias("y1"),
        at("x1", "x2", "_t1").alias("x2"), at("y1", "y2", "_t1").alias("y2"),
    )


GRID = 1000.0  # steps per metre: ends are put on whole millimetres before lines are compared


STEPS = 6  # pairs of Euclid's steps that are compiled


def _with_divisor(df: DataFrame, name: str, a: Column, b: Column) -> DataFrame:
    """Add the greatest common divisor of two whole numbers that are not both 0. Most pairs end within the first,
    compiled steps; the others take as many more as their size allows, in an array function, which is interpreted."""
    keep = df.columns
    df = settle(df, _ga=a, _gb=b)
    for _ in range(STEPS):
        a, b = F.col("_ga"), F.col("_gb")
        df = settle(df, _gr=a % F.when(b != 0, b))
        r = F.col("_gr")
        df = settle(
            df,
            _na=F.when(b == 0, a).when(r == 0, b).otherwise(r),
            _nb=F.when((b == 0) | (r == 0), F.lit(0).cast("long")).otherwise(b % F.when(r != 0, r)),
        ).select(*keep, F.col("_na").alias("_ga"), F.col("_nb").alias("_gb"))
    a, b = F.col("_ga"), F.col("_gb")
    # no pair takes more steps than Fibonacci numbers fit below the smaller one
    many = F.ceil(F.log2(F.greatest(F.least(a, b), F.lit(1)).cast("double")) * 1.4405) + 3
    ended = F.aggregate(
        F.sequence(F.lit(1).cast("long"), many),
        F.struct(a.alias("a"), b.alias("b")),
        lambda s, _: F.struct(
            F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"),
            F.when(s["b"] == 0, F.lit(0).cast("long")).otherwise(s["a"] % F.when(s["b"] != 0, s["b"])).alias("b"),
        ),
    )
    return df.select(*keep, F.when(b == 0, a).otherwise(ended["a"]).alias(name))


def dissolve_pieces(segs: DataFrame, keys: list[str], chunk: float = 1000.0) -> DataFrame:
    """(keys, line_id, seg_no, x1, y1, x2, y2): segments with the same cover in which nothing of the same
    keys overlaps, so lengths count once.

    Ends are put on whole millimetres, and everything after is whole numbers, so segments are on one line
    exactly when their rounded ends are. A line is its direction without common divisor and its place: along
    its longer axis its whole points are `stride` apart, numbered by division, and the remainders of both
    coordinates are the same for all of them. A segment is an interval of such numbers, cut into chunks of at
    least `chunk` metres so that one long busy line is many small groups, and the intervals of a group are
    united. Segments of no length after rounding, or without finite ends, are left out.
    """
    whole = {f"_{c}": F.round(F.col(c) * GRID).cast("long") for c in ENDS}
    dx, dy = F.col("_x2") - F.col("_x1"), F.col("_y2") - F.col("_y1")
    ends = segs.filter(finite(*ENDS)).select(*keys, *[c.alias(n) for n, c in whole.items()]).distinct()
    # a runs along the longer axis and upwards, b along the other
    lines = ends.filter((dx != 0) | (dy != 0)).withColumn("_flat", F.abs(dx) >= F.abs(dy))
    flat = F.col("_flat")
    lines = lines.withColumns(
        {f"_{n}{i}": F.when(flat, F.col(f"_{u}{i}")).otherwise(F.col(f"_{v}{i}")) for i in (1, 2) for n, u, v in (("a", "x", "y"), ("b", "y", "x"))}
    )
    up = F.col("_a2") > F.col("_a1")
    lines = lines.select(
        *keys, "_flat", F.least("_a1", "_a2").alias("_a"), F.when(up, F.col("_b1")).otherwise(F.col("_b2")).alias("_b"),
        F.abs(F.col("_a2") - F.col("_a1")).alias("_da"),
        F.when(up, F.col("_b2") - F.col("_b1")).otherwise(F.col("_b1") - F.col("_b2")).alias("_db"),
    )
    lines = _with_divisor(lines, "_g", F.col("_da"), F.abs("_db"))
    lines = settle(lines, _n=F.col("_g")).drop("_g")
    lines = settle(lines, _stride=F.expr("_da div _n"), _slope=F.expr("_db div _n"))
    lines = lines.withColumn("_ra", F.pmod("_a", "_stride")).withColumn("_k", F.expr("(_a - _ra) div _stride"))
    line = [*keys, "_flat", "_stride", "_slope", "_ra", "_rb"]
    length = F.sqrt(F.col("_stride").cast("double") * F.col("_stride") + F.col("_slope").cast("double") * F.col("_slope"))
    numbers = F.greatest(F.ceil(F.lit(float(chunk) * GRID) / length), F.lit(1))
    lines = settle(lines, _rb=F.col("_b") - F.col("_k") * F.col("_slope"), _many=numbers)
    first, last = F.floor(F.col("_k") / F.col("_many")), F.floor((F.col("_k") + F.col("_n")) / F.col("_many"))
    runs = lines.withColumn("_chunk", F.explode(F.sequence(first, last))).select(
        *line, "_chunk",
        F.greatest(F.col("_k"), F.col("_chunk") * F.col("_many")).cast("double").alias("lo"),
        F.least(F.col("_k") + F.col("_n"), (F.col("_chunk") + 1) * F.col("_many")).cast("double").alias("hi"),
    )
    once = union_intervals(runs, [*line, "_chunk"])

    def at(end: str) -> tuple[Column, Column]:
        k = F.col(end).cast("long")
        a, b = (k * F.col("_stride") + F.col("_ra")) / GRID, (k * F.col("_slope") + F.col("_rb")) / GRID
        return F.when(flat, a).otherwise(b), F.when(flat, b).otherwise(a)

    (x1, y1), (x2, y2) = at("lo"), at("hi")
    return once.select(
        *keys,
        F.xxhash64(*line[len(keys):]).alias("line_id"),
        F.xxhash64("_chunk", "lo").alias("seg_no"),
        x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"),
    )

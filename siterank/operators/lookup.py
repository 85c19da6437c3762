"""Attributes of the nearest feature, within a radius or at any distance."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siterank.functions.geometry import box_dist2, box_far_dist2, finite, point_dist2, with_segment_dist2
from siterank.operators.grid import BASE_CELL, box_level, candidates, is_small, light_side, per_site, places, with_box
from siterank.operators.skew import split_join
from siterank.operators.covers import equal_rings
from siterank.operators.within import GEOMETRY, area_distances, dist2, geometry_columns, near_features, split_areas, with_dist2
from siterank.sources.staging import stage

BLOCK = 64  # features of a block, unless they are at one place
CUTS = 24  # a block's side is cut in four at most so often


@dataclass(frozen=True)
class Lookup:
    """Rows of a layer, the radius, the id that breaks distance ties (smallest wins) and the columns to
    take (output name -> column). `dist` names an output for the distance."""

    rows: DataFrame
    radius: float
    id: str
    take: dict[str, str]
    dist: str | None = None


def lookup_within(sites: DataFrame, lookups: list[Lookup], kind: str) -> DataFrame:
    """(site_id, taken columns) for every site: from the nearest feature within each lookup's radius, NULL
    if there is none. Lookups of few features around a site share one spatial join; each feature keeps its own radius.
    Where features crowd, smaller radii come first and only sites without a feature within one go on to the next."""
    marks = [f"_l{i}" for i in range(len(lookups))]
    if kind == "area":  # rings are worked out once, by all tasks, and not for every look at them
        columns = [sorted({look.id, *look.take.values(), *GEOMETRY[kind]}) for look in lookups]
        lookups = [replace(look, rows=stage(look.rows.select(*c), "rings")) for look, c in zip(lookups, columns)]
    probes = sites.select("site_id", "x", "y")
    steps = [_radii(look, kind) for look in lookups]
    shared = [i for i, radii in enumerate(steps) if len(radii) == 1]
    out = sites.select("site_id")
    if shared:
        out = out.join(_best(probes, [lookups[i] for i in shared], [marks[i] for i in shared], kind), "site_id", "left")
    for look, mark, radii in zip(lookups, marks, steps):
        if len(radii) == 1:
            continue
        rest, best = probes, None
        for radius in radii:
            found = stage(_best(rest, [replace(look, radius=radius)], [mark], kind, radius != radii[0]), "within")
            best = found if best is None else best.unionByName(found)
            if radius != radii[-1]:
                rest = rest.join(found.select("site_id").hint("merge"), "site_id", "left_anti")
                if rest.isEmpty():
                    break
        out = out.join(best, "site_id", "left")
    taken = []
    for m, look in zip(marks, lookups):
        taken += [F.col(f"{m}.{m}.{n}").alias(n) for n in look.take]
        if look.dist:
            taken.append(F.sqrt(F.col(f"{m}._d2")).alias(look.dist))
    return out.select("site_id", *taken)


def _radii(look: Lookup, kind: str) -> list[float]:
    """The radii to look within, one after the other. Areas: those that hold a site first. Otherwise from one within
    which some features are to be expected, if they were spread evenly."""
    if kind == "area":
        return [0.0, look.radius] if look.radius > 0 else [look.radius]
    xs, ys = ("x", "y") if kind == "point" else ("x1", "y1")
    here = look.rows.filter(finite(xs, ys))
    ends = here.agg(F.min(xs), F.min(ys), F.max(xs), F.max(ys), F.count(F.lit(1))).first()
    if not ends[4]:
        return [look.radius]
    spacing = math.sqrt((ends[2] - ends[0]) * (ends[3] - ends[1]) / ends[4])
    radii = [look.radius]
    while radii[0] > max(2 * spacing, 1.0) and len(radii) < CUTS:
        radii.insert(0, radii[0] / 4)
    return radii


def _best(probes: DataFrame, lookups: list[Lookup], marks: list[str], kind: str, left: bool = False) -> DataFrame:
    """(site_id, marks) of the sites near any feature: the squared distance and the taken columns of the nearest. Sites
    that are `left` over from a smaller radius are in no area, and areas whose boxes none of them is near are left out."""
    stacked = None
    for m, look in zip(marks, lookups):
        part = look.rows.select(
            *geometry_columns(kind),
            F.lit(float(look.radius)).alias("reach"),
            F.struct(F.col(look.id).alias("_id"), *[F.col(c).alias(n) for n, c in look.take.items()]).alias(m),
        )
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    radii = [float(look.radius) for look in lookups]
    stacked, many = split_areas(stacked, staged=True) if kind == "area" else (stacked, None)
    spots = places(probes)
    near = near_features(spots, stacked, kind, [F.min(m).alias(m) for m in marks], radii)
    near = with_dist2(near, kind).select("x", "y", "_d2", *marks)
    if many is not None:
        areas = equal_rings(many, [F.min(m).alias(m) for m in marks])
        areas = _boxes_near(spots, areas) if left else areas
        far = area_distances(spots.withColumn("site_id", F.struct("x", "y")), areas, outside=left).join(areas, "_area")
        near = near.unionByName(far.select("site_id.x", "site_id.y", "_d2", *marks))
    best = near.groupBy("x", "y").agg(
        *[F.min(F.when(F.col(m).isNotNull(), F.struct("_d2", F.col(m)))).alias(m) for m in marks]
    )
    return per_site(probes, best, [F.min(m).alias(m) for m in marks])


def _boxes_near(spots: DataFrame, areas: DataFrame) -> DataFrame:
    """The numbered areas (with reach) whose box grown by the reach holds any of the places, staged."""
    boxes = with_box(areas.select("_area", "edges", "reach"), "area", F.col("reach")).drop("edges")
    hit = candidates(spots, boxes, ["x", "y"], ["_area"]).select("_area").distinct()
    return stage(areas.join(light_side(hit, "near-boxes"), "_area", "left_semi"), "near-rings")


def assign_region(sites: DataFrame, areas: DataFrame, column: str, name: str, fallback: float) -> DataFrame:
    """(site_id, name): from the area that holds the site, else the nearest one within `fallback` metres.
    An area that holds the site is at distance 0, so one lookup gives both."""
    return lookup_within(sites, [Lookup(areas, fallback, "id", {name: column})], "area")


def nearest(
    sites: DataFrame,
    rows: DataFrame,
    kind: str,
    id: str,
    take: dict[str, str],
    dist: str | None = None,
) -> DataFrame:
    """(site_id, taken columns) from the nearest feature at any distance; ties go to the smallest id.

    Features are grouped into blocks of at most BLOCK; where they crowd, blocks are smaller. Sites at one place are
    one, and it looks at the blocks within a radius: the farthest corner of any of them, and a point of one of its
    features, bound the distance to the nearest feature, and only blocks that begin within this bound are opened. Sites that find no such bound within the radius go on with four
    times the radius, so each round works on the few sites left over, and a crowd of features far away costs a site
    only its blocks. Features and sites without finite coordinates take no part; such sites get NULL.
    """
    probes = places(sites)
    light = is_small(rows.select(*geometry_columns(kind), *[F.col(c) for c in sorted({id, *take.values()})]))
    feats = with_box(
        rows.groupBy(*geometry_columns(kind)).agg(
            F.min(F.struct(F.col(id).alias("_id"), *[F.col(c).alias(n) for n, c in take.items()])).alias("_f")
        ),
        kind,
        0.0,
    ).drop("reach", "level")
    empty = sites.select("site_id", *[F.lit(None).cast(rows.schema[c].dataType).alias(n) for n, c in take.items()])
    if dist:
        empty = empty.withColumn(dist, F.lit(None).cast("double"))

    ends = feats.agg(
        F.min("minx"), F.min("miny"), F.max("maxx"), F.max("maxy"), F.count(F.lit(1))
    ).first()
    span = probes.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y"), F.count(F.lit(1))).first()
    if not ends[4] or not span[4]:
        return empty
    width = max(ends[2], span[2]) - min(ends[0], span[0])
    height = max(ends[3], span[3]) - min(ends[1], span[1])
    side = max(math.sqrt((ends[2] - ends[0]) * (ends[3] - ends[1]) / ends[4]), BASE_CELL) / 2
    whole = 2 * math.hypot(width, height) + 4 * side

    feats, side = _blocks(feats, side)
    radius = 2 * side
    box = ["minx", "miny", "maxx", "maxy"]
    block = ["_side", "_bx", "_by"]
    blocks = feats.groupBy(*block).agg(
        F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"),
        F.min(_some_point(kind)).alias("_some"),
    )
    opened = feats.select(*block, *GEOMETRY[kind], "_f")
    corner = [F.col(c) for c in box]
    found, pending, open_sites = None, probes, span[4]
    while open_sites and (found is None or radius <= 4 * whole):
        within = blocks.withColumn("reach", F.lit(radius)).withColumn("level", box_level())
        seen = candidates(pending, within, ["x", "y"], block, broadcast=light).select(
            "x", "y", *block,
            box_dist2(F.col("x"), F.col("y"), *corner).alias("_from"),
            F.least(
                box_far_dist2(F.col("x"), F.col("y"), *corner), point_dist2(F.col("x"), F.col("y"), F.col("_some.x"), F.col("_some.y"))
            ).alias("_to"),
        )
        # a block that begins beyond the radius gives no bound within it, and is beyond every bound
        seen = seen.filter(F.col("_from") <= radius * radius)
        bound = F.min("_to").over(Window.partitionBy("x", "y"))
        worth = seen.withColumn("_bound", bound).filter(
            (F.col("_bound") <= radius * radius) & (F.col("_from") <= F.col("_bound"))
        ).select("x", "y", *block)
        if light:
            hits = worth.join(F.broadcast(opened), block)
        else:  # read for its heavy keys and for the join, and far smaller than what was seen
            hits = split_join(stage(worth, "worth"), opened, block, ["x", "y"], GEOMETRY[kind])
        if kind == "segment":
            hits = with_segment_dist2(hits, tuple(F.col(c) for c in GEOMETRY[kind]), {"_d2": (F.col("x"), F.col("y"))})
        else:
            hits = hits.withColumn("_d2", dist2(kind))
        best = hits.groupBy("x", "y").agg(F.min(F.struct("_d2", "_f")).alias("_best"))
        done = stage(best, "nearest")
        found = done if found is None else found.unionByName(done)
        open_sites -= done.count()
        pending = probes.join(found.select("x", "y"), ["x", "y"], "left_anti")
        radius *= 4
    taken = [F.col(f"_best._f.{n}").alias(n) for n in take]
    if dist:
        taken.append(F.sqrt(F.col("_best._d2")).alias(dist))
    best = per_site(sites, found, [F.min("_best").alias("_best")])
    return sites.select("site_id").join(best, "site_id", "left").select("site_id", *taken)


def _some_point(kind: str) -> Column:
    """A point of the feature: no feature nearer than this point is needed to bound the distance to the nearest."""
    if kind == "point":
        return F.struct(F.col("px").alias("x"), F.col("py").alias("y"))
    if kind == "segment":
        return F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))
    return F.struct(F.get("edges", F.lit(0))["x1"].alias("x"), F.get("edges", F.lit(0))["y1"].alias("y"))


def _blocks(feats: DataFrame, side: float) -> tuple[DataFrame, float]:
    """Features with their block (_side, _bx, _by), staged, and the side at which most of them lie: squares of the
    given side, cut in sixteen again and again where more than BLOCK features have their middle in one. Only features
    of overfull blocks are looked at again, so a far outlier or a dense town costs rounds and not wide blocks."""
    middle = [(F.col("minx") + F.col("maxx")) / 2, (F.col("miny") + F.col("maxy")) / 2]
    square = ["_side", "_bx", "_by"]
    done, rest, most = None, stage(feats, "features"), (0, side)
    for _ in range(CUTS):
        cut = rest.withColumns({"_side": F.lit(side), "_bx": F.floor(middle[0] / side), "_by": F.floor(middle[1] / side)})
        full = cut.groupBy(*square).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > BLOCK)
        full = stage(full.select(*square), "overfull")
        if full.isEmpty():
            break
        ready = stage(cut.join(full, square, "left_anti").select(*cut.columns), "blocks")
        done = ready if done is None else done.unionByName(ready)
        most = max(most, (ready.count(), side))
        rest = stage(cut.join(full, square, "left_semi").select(*feats.columns), "features")
        side /= 4
    cut = rest.withColumns({"_side": F.lit(side), "_bx": F.floor(middle[0] / side), "_by": F.floor(middle[1] / side)})
    if done is None:
        return cut, side
    return done.unionByName(cut.select(*done.columns)), max(most, (rest.count(), side))[1]

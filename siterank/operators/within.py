"""What lies within a radius: counts, sums, averages and flags per site."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siterank.functions.geometry import (
    area_dist2,
    area_edge_near,
    area_holds,
    box_dist2,
    box_far_dist2,
    edge_dist2,
    finite,
    point_dist2,
    segment_dist2,
    settle,
    with_segment_dist2,
)
from siterank.operators.covers import cover, covered_sums, equal_rings, full_pairs, near_pairs, numbered, probe, rim_pairs
from siterank.operators.grid import (
    BOX, CELL, candidates, crews, each_of_crew, is_small, one_place, per_site, places, point_level, touched, with_box,
)
from siterank.operators.pyramid import CROWD, circle_sums, crowding
from siterank.sources.staging import stage

FEW = 16  # areas of more edges are looked up by cells and edges, never by their whole ring

GEOMETRY = {"point": ["px", "py"], "segment": ["x1", "y1", "x2", "y2"], "area": ["edges"]}


@dataclass(frozen=True)
class Layer:
    """Rows of one layer, how near they must be, and what to add up over the near ones.

    kind "point" has columns x, y; "segment" x1, y1, x2, y2; "area" edges (see geometry.ring_edges).
    sums maps an output name to a numeric expression on the layer's columns.
    """

    rows: DataFrame
    radius: float
    sums: dict[str, Column] = field(default_factory=dict)
    kind: str = "point"


def geometry_columns(kind: str) -> list[Column]:
    if kind == "point":
        return [F.col("x").alias("px"), F.col("y").alias("py")]
    return [F.col(c) for c in GEOMETRY[kind]]


def dist2(kind: str) -> Column:
    """Squared distance between the probe (x, y) and the feature columns of a kind."""
    x, y = F.col("x"), F.col("y")
    if kind == "point":
        return point_dist2(x, y, F.col("px"), F.col("py"))
    if kind == "segment":
        return segment_dist2(x, y, *[F.col(c) for c in GEOMETRY[kind]])
    return area_dist2(x, y, F.col("edges"))


def is_near(kind: str) -> Column:
    """The exact test. The ring of an area is walked only where its box and its first corner do not already
    decide: arrays are interpreted, the rest is compiled."""
    reach2 = F.col("reach") * F.col("reach")
    if kind != "area":
        return dist2(kind) <= reach2
    x, y, box = F.col("x"), F.col("y"), [F.col(c) for c in BOX]
    corner = F.get("edges", F.lit(0))
    return (
        F.when(box_dist2(x, y, *box) > reach2, F.lit(False))
        .when(box_far_dist2(x, y, *box) <= reach2, F.lit(True))
        .when(point_dist2(x, y, corner["x1"], corner["y1"]) <= reach2, F.lit(True))
        .otherwise(area_edge_near(x, y, F.col("edges"), reach2) | area_holds(x, y, F.col("edges")))
    )


def with_dist2(near: DataFrame, kind: str) -> DataFrame:
    """Keep the pairs within reach and add _d2, worked out once per pair."""
    reach2 = F.col("reach") * F.col("reach")
    if kind == "area":
        near = near.filter(is_near(kind))
    if kind == "segment":
        near = with_segment_dist2(near, tuple(F.col(c) for c in GEOMETRY[kind]), {"_d2": (F.col("x"), F.col("y"))})
    else:
        near = settle(near, _d2=dist2(kind))
    return near.filter(F.col("_d2") <= reach2)


def only_near(near: DataFrame, kind: str) -> DataFrame:
    """The pairs within reach."""
    return with_dist2(near, kind).drop("_d2") if kind == "segment" else near.filter(is_near(kind))


def split_areas(areas: DataFrame, staged: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(areas of few edges, areas of many or None): boxes decide most pairs of the former, and a look at a few edges
    the rest; for the latter no part of the work grows with the ring for each pair. Rings are written first, unless they
    are already: each look at them would work them out again, and the filters in as few tasks as their source has."""
    areas = areas if staged else stage(areas, "rings")
    edges = F.coalesce(F.size("edges"), F.lit(0))
    many = areas.filter(edges > FEW)
    return areas.filter(edges <= FEW), None if many.isEmpty() else many


def area_distances(sites: DataFrame, areas: DataFrame, outside: bool = False) -> DataFrame:
    """(site_id, _area, _d2): the squared distance of every site to every area (numbered, with reach) within its reach,
    0 inside. Sites inside come from the cells of the areas, the others from edges within reach. Cells tell of sites on
    an edge, too, so areas without a reach need no more; sites known to be `outside` of all need no cells."""
    probes = sites.select("site_id", "x", "y")
    inside = None if outside else near_pairs(probes, cover(areas.withColumn("reach", F.lit(0.0)))).withColumn("_d2", F.lit(0.0))
    if not outside:
        areas = areas.filter("reach > 0")
        if areas.isEmpty():
            return inside
    edges = areas.select("_area", F.explode("edges").alias("e"), "reach").select("_area", "e.*", "reach")
    # an area with a coordinate that is not finite is near nothing, its other edges neither
    edges = edges.join(edges.filter(~finite(*GEOMETRY["segment"])).select("_area").distinct(), "_area", "left_anti")
    pairs = candidates(probes, with_box(edges, "segment", F.col("reach")), ["site_id"], ["_area", *GEOMETRY["segment"]])
    pairs = settle(pairs, _d2=edge_dist2(F.col("x"), F.col("y"), {c: F.col(c) for c in GEOMETRY["segment"]}))
    rim = pairs.filter(F.col("_d2") <= F.col("reach") * F.col("reach")).select("site_id", "_area", "_d2")
    found = rim if outside else inside.unionByName(rim)
    return found.groupBy("site_id", "_area").agg(F.min("_d2").alias("_d2"))


def near_features(probes: DataFrame, stacked: DataFrame, kind: str, aggs: list[Column], radii: list[float]) -> DataFrame:
    """Candidate pairs of probes (places x, y) with the places of a stacked layer (geometry, reach and other columns).

    Features at the same place with the same reach are put together first by `aggs`."""
    light = is_small(stacked)
    merged = stacked.groupBy("reach", *GEOMETRY[kind]).agg(*aggs)
    if kind == "point":
        level = {r: point_level(r) for r in radii}
        known = F.lit(0)
        for r, n in level.items():
            known = F.when(F.col("reach") == r, n).otherwise(known)
        feats, levels = with_box(merged, kind, F.col("reach"), known), list(level.values())
    else:
        feats, levels = with_box(merged, kind, F.col("reach")), None
    return candidates(probes, feats, ["x", "y"], GEOMETRY[kind], levels, light)


def _stack(group: list[Layer]) -> DataFrame:
    """The layers of one kind as one table, each with its own reach."""
    stacked = None
    for layer in group:
        part = layer.rows.select(
            *geometry_columns(layer.kind),
            F.lit(float(layer.radius)).alias("reach"),
            *[c.alias(name) for name, c in layer.sums.items()],
        )
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    return stacked


def crowded(group: list[Layer], stacked: DataFrame) -> tuple[list[Layer], list[Layer]]:
    """(crowded layers, the others): point layers with so many places of points near each other that sums made
    beforehand cost less than pairs; points at one place are one. Layers that are light together are not looked at."""
    radii = sorted({float(layer.radius) for layer in group if layer.radius > 0})
    if not radii or is_small(stacked.select("reach", *GEOMETRY["point"])):
        return [], group
    dense = {r for r, n in crowding(stacked.select("reach", *GEOMETRY["point"]).distinct(), radii).items() if n > CROWD}
    return [layer for layer in group if layer.radius in dense], [layer for layer in group if layer.radius not in dense]


def _circle_sums(probes: DataFrame, layer: Layer) -> DataFrame:
    points = layer.rows.select(*geometry_columns("point"), *[c.alias(n) for n, c in layer.sums.items()])
    return circle_sums(probes, points, layer.radius, list(layer.sums))


def tally(sites: DataFrame, layers: list[Layer]) -> DataFrame:
    """(site_id, one column per sum) for every site, 0 where nothing is near.

    All layers of one kind go through one spatial join: they are stacked with their own radius. Features
    at the same place are added up first, so copies of one geometry cost one row, and sites at the same place are
    looked at once.
    """
    probes = sites.select("site_id", "x", "y")
    out = sites.select("site_id")
    for kind in GEOMETRY:
        group = [layer for layer in layers if layer.kind == kind]
        if not group:
            continue
        stacked = _stack(group)
        names = [name for layer in group for name in layer.sums]
        many = None
        if kind == "area":
            stacked, many = split_areas(stacked)
        aggs = [F.sum(n).alias(n) for n in names]
        if kind == "point":
            crowds, group = crowded(group, stacked)
            for layer in crowds:
                out = out.join(_circle_sums(probes, layer), "site_id", "left")
            if not group:
                continue
            names = [name for layer in group for name in layer.sums]
            aggs = [F.sum(n).alias(n) for n in names]
            stacked = _stack(group)
        radii = [float(layer.radius) for layer in group]
        near = only_near(near_features(places(probes), stacked, kind, aggs, radii), kind)
        sums = per_site(probes, near.groupBy("x", "y").agg(*aggs), aggs)
        if many is not None:
            areas = equal_rings(many, aggs)
            more = covered_sums(probes, cover(areas), areas.select("_area", *names), names)
            sums = sums.unionByName(more).groupBy("site_id").agg(*aggs)
        out = out.join(sums, "site_id", "left")
    names = [n for layer in layers for n in layer.sums]
    return out.select("site_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def count_within(sites: DataFrame, points: DataFrame, radius: float, filters: dict[str, Column]) -> DataFrame:
    """One count per name: the points within the radius for which its condition holds."""
    sums = {name: F.when(cond, F.lit(1).cast("bigint")) for name, cond in filters.items()}
    return tally(sites, [Layer(points, radius, sums)])


def sum_within(sites: DataFrame, points: DataFrame, radius: float, column: str, name: str) -> DataFrame:
    return tally(sites, [Layer(points, radius, {name: F.col(column)})])


def averages(cols: dict[str, str]) -> dict[str, Column]:
    """Sums from which `finish_averages` makes the averages of columns (output name -> column)."""
    out = {}
    for name, c in cols.items():
        out[f"{name}__sum"] = F.col(c).cast("double")
        out[f"{name}__n"] = F.when(F.col(c).isNotNull(), F.lit(1).cast("bigint"))
    return out


def finish_averages(df: DataFrame, names: list[str]) -> DataFrame:
    """NULL where no value was near."""
    drop = [f"{n}__{s}" for n in names for s in ("sum", "n")]
    return df.withColumns(
        {n: F.col(f"{n}__sum") / F.when(F.col(f"{n}__n") > 0, F.col(f"{n}__n")) for n in names}
    ).drop(*drop)


def avg_areas_within(sites: DataFrame, areas: DataFrame, radius: float, cols: dict[str, str]) -> DataFrame:
    """Unweighted average of area attributes over the areas within the radius."""
    return finish_averages(tally(sites, [Layer(areas, radius, averages(cols), "area")]), list(cols))


def zonal_mean(sites: DataFrame, cells: DataFrame, radius: float, name: str) -> DataFrame:
    """Average of the raster cells whose centre lies within the radius."""
    return finish_averages(tally(sites, [Layer(cells, radius, averages({name: "value"}))]), [name])


def near_places(sites: DataFrame, layers: list[Layer]) -> DataFrame:
    """The distinct places (x, y) of sites that a feature of any layer is near to, each layer with its own radius.
    Places, not ids, are what is compared, so nothing depends on the ids."""
    hits = None
    for layer in layers:
        rows, many = layer.rows.select(*geometry_columns(layer.kind)), None
        light = is_small(rows)
        if layer.kind == "area":
            rows, many = split_areas(rows)
        level = point_level(layer.radius) if layer.kind == "point" else None
        feats = with_box(
            rows.distinct() if layer.kind != "area" else rows, layer.kind, layer.radius, None if level is None else F.lit(level)
        )
        found = touched(sites, feats, is_near(layer.kind), None if level is None else [level], light)
        if many is not None:
            found = found.unionByName(_near_areas(sites, many.withColumn("reach", F.lit(float(layer.radius))))).distinct()
        hits = found if hits is None else hits.unionByName(found)
    return hits if len(layers) == 1 else hits.distinct()


def _near_areas(sites: DataFrame, areas: DataFrame) -> DataFrame:
    """The distinct places (x, y) of sites near any area: those in a full cell, and those that edges in rim cells show."""
    cells = cover(numbered(areas.select("reach", "edges").distinct()))
    full = cells.full.select(*CELL).distinct()
    places = sites.select("x", "y").distinct()
    inside = probe(places, full).join(full, list(CELL), "left_semi").select("x", "y")
    rim = rim_pairs(places.withColumn("site_id", F.struct("x", "y")), cells).select("site_id.x", "site_id.y")
    return inside.unionByName(rim).distinct()


def flag_within(sites: DataFrame, rows: DataFrame, radius: float, name: str, kind: str = "point", value: int = 1):
    """(site_id, name): `value` where any feature is within the radius, else 0. Radius 0 means touching."""
    hits = near_places(sites, [Layer(rows, radius, kind=kind)]).withColumn(name, F.lit(value)).hint("merge")
    return sites.select("site_id", "x", "y").join(hits, ["x", "y"], "left").select("site_id", F.coalesce(name, F.lit(0)).alias(name))


def exclude_near_any(sites: DataFrame, layers: list[Layer]) -> DataFrame:
    """The sites that no layer comes near to, each layer with its own radius."""
    return sites.join(near_places(sites, layers).hint("merge"), ["x", "y"], "left_anti").select(*sites.columns)


def exclude_within(sites: DataFrame, rows: DataFrame, radius: float, kind: str = "point") -> DataFrame:
    """The sites with no feature within the radius. An empty layer keeps all sites."""
    return exclude_near_any(sites, [Layer(rows, radius, kind=kind)])


def keep_within(sites: DataFrame, rows: DataFrame, radius: float, kind: str = "point") -> DataFrame:
    """The sites with any feature within the radius."""
    return sites.join(near_places(sites, [Layer(rows, radius, kind=kind)]).hint("merge"), ["x", "y"], "left_semi").select(*sites.columns)


def points_in_areas(sites: DataFrame, areas: DataFrame) -> DataFrame:
    """(site_id, id): every area that holds the site, its boundary included. Places are looked at, not sites, and of
    areas of many edges equal rings are one; sites and ids come in when it is known which ring holds which place."""
    few, many = split_areas(areas.select("id", "edges"))
    spots = crews(sites)
    if many is None:
        return _in_few(spots, few)
    # rings are worked out once, and told apart by 128 bits
    rings = settle(areas.select("id", F.col("edges").alias("_ring")), edges=F.col("_ring")).drop("_ring")
    n = F.coalesce(F.size("edges"), F.lit(0))
    hashes = {f"_h{i}": F.xxhash64(F.lit(i), n, "edges") for i in (0, 1)}
    rings = numbered(rings.withColumns({"_n": n, "reach": F.lit(0.0)} | hashes))
    few, many = rings.filter(F.col("_n") <= FEW).select("id", "edges"), rings.filter(F.col("_n") > FEW)
    first = many.groupBy(*hashes).agg(F.min("_area").alias("_first"))
    owners = many.select("_area", "id", *hashes).join(first, list(hashes)).select(F.col("_first").alias("_area"), "id")
    once = many.join(first.select(F.col("_first").alias("_area")).hint("merge"), "_area", "left_semi")
    cells, probes = cover(once.select("_area", "reach", "edges")), places(sites).withColumn("site_id", F.struct("x", "y"))

    def owned(held: DataFrame, there: DataFrame) -> DataFrame:
        held = held.select("site_id.x", "site_id.y", "_area").join(owners.hint("merge"), "_area").select("x", "y", "id")
        return each_of_crew(held.join(there.hint("merge"), ["x", "y"]).select("crew", "id"))

    # a site given twice has its full cells twice, its rim cells once
    given_once = crews(sites.select("site_id", "x", "y").distinct())
    more = owned(full_pairs(probes, cells), spots).unionByName(owned(rim_pairs(probes, cells), given_once))
    return more if few.isEmpty() else _in_few(spots, few).unionByName(more)


def _in_few(spots: DataFrame, areas: DataFrame) -> DataFrame:
    """(site_id, id) of crews in areas of few edges."""
    near = candidates(spots, with_box(areas, "area", 0.0), ["x", "y", "crew"], ["id"]).filter(is_near("area"))
    return each_of_crew(near.select("crew", "id"))


def pairs_within(sites: DataFrame, rows: DataFrame, radius: float, kind: str, carry: list[str], per_place: bool = False) -> DataFrame:
    """(site_id, carry..., dist): every feature within the radius of every site. The result is as big as
    the number of pairs; use the tallies above where only totals are wanted. Points and segments are compared with
    places; `per_place` leaves their pairs at these, with x, y in place of site_id (see to_sites)."""
    rows, many = split_areas(rows) if kind == "area" else (rows, None)
    feats = with_box(rows.select(*carry, *geometry_columns(kind)), kind, radius)
    if kind != "area":
        probes, key = (places(sites), ["x", "y"]) if per_place else (crews(sites), ["crew"])
        near = with_dist2(candidates(probes, feats, probes.columns, GEOMETRY[kind]), kind)
        near = near.select(*key, *carry, F.sqrt("_d2").alias("dist"))
        return near if per_place else each_of_crew(near)
    probes = sites.select("site_id", "x", "y")
    near = with_dist2(candidates(probes, feats, ["site_id"], GEOMETRY[kind]), kind).select("site_id", *carry, "_d2")
    if many is not None:
        areas = numbered(many.select(*carry, "edges", F.lit(float(radius)).alias("reach")))
        near = near.unionByName(area_distances(probes, areas).join(areas, "_area").select("site_id", *carry, "_d2"))
    return near.select("site_id", *carry, F.sqrt("_d2").alias("dist"))


def to_sites(sites: DataFrame, found: DataFrame, keys: list[str], aggs: list[Column]) -> DataFrame:
    """(site_id, keys, aggs): what was found at places (x, y, keys and values, one row for a place and keys), put together
    over each site_id. Only ids at several places are grouped again; the others have what their place has."""
    alone, several = one_place(sites)
    again = not several.isEmpty()
    if again:
        found = stage(found, "found")
    out = each_of_crew(found.join(crews(alone).hint("merge"), ["x", "y"]))
    if not again:
        return out
    more = found.join(several.hint("merge"), ["x", "y"]).groupBy("site_id", *keys).agg(*aggs)
    return out.unionByName(more.select(*out.columns))


def clusters_within(sites: DataFrame, layers: dict[str, DataFrame], radius: float) -> DataFrame:
    """Per name, how many different cluster_id have a segment within the radius."""
    stacked = None
    for name, segs in layers.items():
        part = segs.select("cluster_id", *GEOMETRY["segment"], F.lit(name).alias("layer"))
        stacked = part if stacked is None else stacked.unionByName(part)
    feats = with_box(stacked.distinct(), "segment", radius)
    near = only_near(candidates(places(sites), feats, ["x", "y"], GEOMETRY["segment"]), "segment")
    found = stage(near.select("x", "y", "layer", "cluster_id").distinct(), "clusters-near")
    counted = [F.sum(F.when(F.col("layer") == n, F.lit(1).cast("bigint"))).alias(n) for n in layers]
    alone, several = one_place(sites)
    counts = alone.join(found.groupBy("x", "y").agg(*counted).hint("merge"), ["x", "y"]).select("site_id", *layers)
    more = several.join(found.hint("merge"), ["x", "y"]).select("site_id", "layer", "cluster_id").distinct()
    counts = counts.unionByName(more.groupBy("site_id").agg(*counted))
    return sites.select("site_id").join(counts, "site_id", "left").fillna(0, list(layers))


def lowest_within(
    sites: DataFrame, rows: DataFrame, radius: float, column: str, name: str, kind: str = "segment"
) -> DataFrame:
    """(site_id, name): the smallest value of a column over the features within the radius, else NULL."""
    stacked = rows.select(*geometry_columns(kind), F.lit(float(radius)).alias("reach"), F.col(column).alias("_low"))
    probes = sites.select("site_id", "x", "y")
    lowest = F.min("_low").alias("_low")
    near = only_near(near_features(places(probes), stacked, kind, [lowest], [float(radius)]), kind)
    low = per_site(probes, near.groupBy("x", "y").agg(lowest), [F.min("_low").alias(name)])
    return sites.select("site_id").join(low, "site_id", "left")

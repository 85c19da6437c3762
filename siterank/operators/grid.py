"""The spatial equi-join every operator is built on.

A feature has a box (minx, miny, maxx, maxy) and a reach in metres. It is entered in the grid level whose
cells are at least as wide as its box grown by the reach, so it touches at most four cells there. A probe
point lies in exactly one cell per level. Joining on (level, cell) therefore finds every feature whose
grown box holds the probe, each (probe, feature) pair once, with no pair of rows compared outside a cell.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siterank.functions.geometry import finite, settle
from siterank.operators.skew import FLOOR, split_join
from siterank.sources.staging import stage

BASE_CELL = 50.292  # metres, 1/32 mile: the study's radii fall on whole levels
SLACK = 1e-6  # metres added to the reach in cell and box tests; the exact test comes after
FEW_ROWS = 64  # rows that are weighed first
CREW = 64  # ids of sites at one place that are carried together, about
SMALL = 40_000  # weight up to which a layer is broadcast: rows, and 64 bytes of their text forms each

BOX = ("minx", "miny", "maxx", "maxy")
CELL = ["_level", "_cx", "_cy"]


def point_level(reach: float) -> int:
    """Grid level of a point with this reach."""
    return max(0, math.ceil(math.log2(max(2 * reach, 1e-9) / BASE_CELL) - 1e-9))


def with_box(df: DataFrame, kind: str, reach: Column | float, level: Column | None = None) -> DataFrame:
    """Add box, reach and grid level to a layer of points (px, py), segments (x1..y2) or areas (edges)."""
    if kind == "point":
        box = (F.col("px"), F.col("py"), F.col("px"), F.col("py"))
    elif kind == "segment":
        box = (
            F.least("x1", "x2"), F.least("y1", "y2"), F.greatest("x1", "x2"), F.greatest("y1", "y2"),
        )
    elif kind == "area":
        # the ring is built once and not again for every use of it
        df = settle(df.withColumnRenamed("edges", "_ring"), edges=F.col("_ring")).drop("_ring")
        xs = F.transform("edges", lambda e: e["x1"])
        ys = F.transform("edges", lambda e: e["y1"])
        box = (F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))
    else:
        raise ValueError(kind)
    reach = reach if isinstance(reach, Column) else F.lit(float(reach))
    # features without a finite box are near nothing
    boxed = df.withColumns({"reach": reach})
    boxed = settle(boxed, **dict(zip(BOX, box))) if kind == "area" else boxed.withColumns(dict(zip(BOX, box)))
    boxed = boxed.filter(finite(*BOX))
    return boxed.withColumn("level", box_level() if level is None else level)


def box_level() -> Column:
    """The level whose cells are at least as wide as the box grown by the reach."""
    span = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")) + 2 * F.col("reach")
    level = F.ceil(F.log2(F.greatest(span, F.lit(1e-9)) / BASE_CELL) - 1e-9)
    return F.greatest(level, F.lit(0)).cast("int")


def is_small(df: DataFrame, limit: int = SMALL) -> bool:
    """Is the whole layer light enough to broadcast, one unit for a row and for every 64 bytes of its text form,
    whatever its columns are nested in? Takes at most limit + 1 numbers, from the first partitions that have them; a few
    rows tell if they are heavy ones."""
    weight = 1.0 + F.coalesce(F.octet_length(F.to_json(F.struct("*"))), F.lit(0)) / 64.0
    weights = df.select(weight)
    return all(sum(r[0] for r in weights.take(n)) <= limit for n in (min(FEW_ROWS, limit + 1), limit + 1))


def light_side(df: DataFrame, name: str) -> DataFrame:
    """df staged, as the right side of a join whose left rows are heavy and should stay where they are: broadcast if it
    is small, which is checked."""
    rows = stage(df, name)
    return F.broadcast(rows) if is_small(rows) else rows.hint("merge")


def places(sites: DataFrame) -> DataFrame:
    """(x, y): the distinct places of sites with finite coordinates. What is near a place is worked out once for all
    sites there."""
    return sites.select("x", "y").filter(finite("x", "y")).distinct()


def per_site(sites: DataFrame, found: DataFrame, aggs: list[Column]) -> DataFrame:
    """(site_id, aggs): what was found at places (x, y and values, one row a place), put together over the rows of each
    site_id. Sites are on the left, where adaptive execution deals out a place of very many."""
    rows = sites.select("site_id", "x", "y").join(found.hint("merge"), ["x", "y"])
    return rows.groupBy("site_id").agg(*aggs)


def tasks(spark: SparkSession) -> int:
    """How many tasks get rows that are few bytes but cause much work: adaptive execution would put them in one."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def crews(sites: DataFrame) -> DataFrame:
    """(x, y, crew): the places of sites with finite coordinates, with the ids of about CREW rows there in each crew, so what
    is found near a place goes to all sites there without a join. A site given twice is in crews twice."""
    ids = sites.select("site_id", "x", "y").filter(finite("x", "y")).groupBy("x", "y", "site_id").agg(F.count(F.lit(1)).alias("_n"))
    parts = ids.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {CREW}"))))
    parts = parts.withColumn("_ids", F.array_repeat("site_id", F.least(F.lit(CREW), F.col("_n") - F.col("_i") * CREW).cast("int")))
    rows = parts.join(ids.groupBy("x", "y").agg(F.sum("_n").alias("_all")).hint("merge"), ["x", "y"])
    crew = F.pmod(F.xxhash64("site_id", "_i"), F.ceil(F.col("_all") / CREW))
    found = rows.groupBy("x", "y", crew.alias("_c")).agg(F.flatten(F.collect_list("_ids")).alias("crew")).drop("_c")
    return stage(found.repartition(tasks(sites.sparkSession), "x", "y"), "crews")


def each_of_crew(found: DataFrame) -> DataFrame:
    """What was found for crews, once for each of their sites: site_id in place of x, y and crew."""
    rest = [c for c in found.columns if c not in ("x", "y", "crew")]
    return found.select(F.explode("crew").alias("site_id"), *rest)


def one_place(sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct (site_id, x, y) with finite coordinates: of the ids at one place, and of those at several."""
    rows = stage(sites.select("site_id", "x", "y").filter(finite("x", "y")).distinct(), "placed")
    several = rows.groupBy("site_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col("site_id").alias("_id"))
    same = F.col("site_id").eqNullSafe(F.col("_id"))
    return rows.join(several.hint("merge"), same, "left_anti"), rows.join(several.hint("merge"), same, "left_semi")


def _side(level: Column) -> Column:
    return F.lit(BASE_CELL) * F.pow(F.lit(2.0), level)


def _in_box() -> Column:
    """Does the feature's box grown by its reach hold the probe?"""
    pad = F.col("reach") + SLACK
    return F.col("x").between(F.col("minx") - pad, F.col("maxx") + pad) & F.col("y").between(F.col("miny") - pad, F.col("maxy") + pad)


def _feature_cells(feats: DataFrame) -> DataFrame:
    pad = F.col("reach") + SLACK
    side = _side(F.col("_level"))

    def run(lo: str, hi: str) -> Column:
        return F.explode(
            F.sequence(F.floor((F.col(lo) - pad) / side), F.floor((F.col(hi) + pad) / side))
        )

    return (
        feats.withColumn("_level", F.col("level"))
        .withColumn("_cx", run("minx", "maxx"))
        .withColumn("_cy", run("miny", "maxy"))
    )


def _probe_cells(probes: DataFrame, levels: Column | list[int]) -> DataFrame:
    side = _side(F.col("_level"))
    if isinstance(levels, list):
        levels = F.array(*[F.lit(n) for n in sorted(set(levels))])
    return (
        probes.withColumn("_level", F.explode(levels))
        .withColumn("_cx", F.floor(F.col("x") / side))
        .withColumn("_cy", F.floor(F.col("y") / side))
    )


def candidates(
    probes: DataFrame,
    feats: DataFrame,
    probe_id: list[str],
    feat_id: list[str],
    levels: list[int] | None = None,
    broadcast: bool | None = None,
    floor: int = FLOOR,
    match: dict[str, str] | None = None,
) -> DataFrame:
    """All (probe, feature) pairs where the probe lies in the feature's box grown by its reach.

    probes: x, y and any columns. feats: box, reach and any columns (see with_box). Column names must
    differ between the two. The caller adds the exact distance test. `levels` are the grid levels that occur
    in feats, where known; otherwise they are looked up. `match` names columns that must be equal besides
    (probe column -> feature column). Rows without finite coordinates make no pairs.

    A light layer (its size is checked) is broadcast. Otherwise both sides are shuffled on the cell, and
    cells that hold more than their share of either side are cut into blocks (see split_join).
    """
    feat_cells = _feature_cells(feats)
    if levels is None:
        levels = feats.agg(F.collect_set("level")).scalar()
    in_box = _in_box()
    probe_cells = _probe_cells(probes.filter(finite("x", "y")), levels)
    cell = list(CELL)
    for i, (mine, theirs) in enumerate((match or {}).items()):
        probe_cells, feat_cells = probe_cells.withColumn(f"_m{i}", F.col(mine)), feat_cells.withColumn(f"_m{i}", F.col(theirs))
        cell.append(f"_m{i}")
    if is_small(feats) if broadcast is None else broadcast:
        same = [F.col(f"p.{c}") == F.col(f"f.{c}") for c in cell]
        pairs = probe_cells.alias("p").join(F.broadcast(feat_cells).alias("f"), [*same, in_box])
    else:
        return split_join(probe_cells, feat_cells, cell, probe_id, feat_id, in_box, floor).select(
            *probes.columns, *feats.columns
        )
    return pairs.select(*[f"p.{c}" for c in probes.columns], *[f"f.{c}" for c in feats.columns])


def touched(probes: DataFrame, feats: DataFrame, near: Column, levels: list[int] | None = None, broadcast: bool = False) -> DataFrame:
    """The distinct places (x, y) of probes that any feature is near to, by a join that stops at a place's first hit.

    probes: x, y; feats: as in `candidates`; near: the exact test on both. Unless told to, nothing is broadcast: Spark
    guesses the size of cells from that of the layer's compressed files."""
    if levels is None:
        levels = feats.agg(F.collect_set("level")).scalar()
    in_box = _in_box()
    places = _probe_cells(probes.select("x", "y").filter(finite("x", "y")).distinct(), levels)
    cells = _feature_cells(feats).withColumnsRenamed({c: f"_f{c}" for c in CELL})
    same = F.lit(True)
    for c in CELL:
        same = same & (F.col(c) == F.col(f"_f{c}"))
    hit = places.join(F.broadcast(cells) if broadcast else cells.hint("merge"), same & in_box & near, "left_semi")
    return hit.select("x", "y").distinct()

"""Clusters of touching lines: edges from shared ends and crossings, then connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siterank.functions.geometry import only_touching
from siterank.operators.grid import CELL, _feature_cells, _in_box, _probe_cells, candidates, is_small, with_box
from siterank.operators.lines import ENDS, cut_short
from siterank.operators.skew import split_join, spread_join
from siterank.sources.staging import drop_stage, stage

PART = 250.0  # metres; long segments are looked up by parts of at most this length
KNOT = 48  # more segments of a status and size than this in the squares of segments, on average, are looked at in two rounds
STEPS = 2**20


def touching_edges(segs: DataFrame, status: str) -> DataFrame:
    """(u, v), u > v: lines of the same status that touch or are connected by such, enough of them to connect what is connected.

    Lines with a common vertex are tied to the smallest line there, one edge per line and not one per
    pair. Crossings are looked for between different geometries only: copies share their ends anyway.
    Where lines crowd, all are compared with a few of their surroundings first, and then only those that
    are not connected by these, so pairs do not grow with the square of the lines.
    """
    ends = segs.select(
        F.col(status).alias("status"), "line_id",
        F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")),
                          F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("_e"),
    ).select("status", "line_id", "_e.x", "_e.y")
    shared = ends.groupBy("status", "x", "y").agg(F.min("line_id").alias("v"), F.max("line_id").alias("_top"))
    shared = shared.filter(F.col("v") < F.col("_top")).drop("_top")
    tied = spread_join(ends, shared, ["status", "x", "y"], "inner", "line_id").filter(F.col("line_id") > F.col("v"))

    forward = (F.col("x1") < F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") <= F.col("y2")))
    places = (
        segs.select(
            F.col(status).alias("status"), "line_id",
            *[F.when(forward, F.col(a)).otherwise(F.col(b)).alias(a)
              for a, b in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))],
        )
        .groupBy("status", *ENDS)
        .agg(F.min("line_id").alias("line_id"))
    )
    light = is_small(segs)
    places = places if light else stage(places, "lines")
    whole = {c: f"a_{c}" for c in ENDS}
    parts = cut_short(places.withColumns({n: F.col(c) for c, n in whole.items()}), PART)
    probes = parts.select(
        F.col("status").alias("a_status"), F.col("line_id").alias("u"), *whole.values(), "part_no",
        ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"),
    )
    feats = with_box(places.select("status", F.col("line_id").alias("v"), *ENDS), "segment", PART / 2)
    # in the key, so that lines of different status never meet; NULL is a status of its own
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    probes, feats = probes.withColumn("a_kind", named("a_status")), feats.withColumn("b_kind", named("status"))
    tied = tied.select(F.col("line_id").alias("u"), "v")
    few = None if light else _pivots(feats)
    if few is None:
        crossing = candidates(probes, feats, ["u", "part_no"], ["v", *ENDS], broadcast=light, match={"a_kind": "b_kind"})
        return tied.unionByName(_crossing(crossing.filter(F.col("u") > F.col("v")))).distinct()
    first = candidates(probes, few, ["u", "part_no"], ["v", *ENDS], broadcast=False, match={"a_kind": "b_kind"})
    # a line that is not among the few meets them as a probe only, so its id may be the smaller or the larger one
    first = _crossing(first.filter(F.col("u") != F.col("v")))
    roots = stage(components(tied.unionByName(first)), "roots")
    known = roots.filter(F.col("node") != F.col("root")).select(F.col("node").alias("u"), F.col("root").alias("v"))
    return known.unionByName(_crossing(_apart(probes, feats, roots)).distinct())


def _crossing(near: DataFrame) -> DataFrame:
    """(u, v), u > v, of the pairs of segments that share a point."""
    near = only_touching(near, tuple(F.col(f"a_{c}") for c in ENDS), tuple(F.col(c) for c in ENDS))
    return near.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def _pivots(feats: DataFrame) -> DataFrame | None:
    """Some of the segments, chosen by hash: twice the logarithm of the number of segments of their status and size
    with a middle in the same square, squares being as wide as the size. Nearly every segment crosses one of them where
    segments crowd. None where they do not."""
    square = ["b_kind", "_side", "_mx", "_my"]
    span = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"), F.lit(1.0))
    placed = feats.withColumn("_side", F.pow(F.lit(2.0), F.ceil(F.log2(span))))
    middle = {"_mx": F.col("minx") + F.col("maxx"), "_my": F.col("miny") + F.col("maxy")}
    placed = placed.withColumns({n: F.floor(m / (2 * F.col("_side"))) for n, m in middle.items()})
    counts = stage(placed.groupBy(*square).agg(F.count(F.lit(1)).alias("_n")), "squares")
    around = counts.agg(F.sum(F.col("_n").cast("double") * F.col("_n")) / F.sum("_n")).first()[0]
    if around is None or around <= KNOT:
        return None
    drawn = F.pmod(F.xxhash64("v", *ENDS), F.lit(STEPS)) / F.lit(float(STEPS))
    chosen = placed.join(counts.hint("merge"), square).filter(drawn * F.col("_n") < 2 * F.log(F.col("_n") + 1.0))
    return stage(chosen.select(*feats.columns), "pivots")


def _apart(probes: DataFrame, feats: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs of `candidates` whose lines have different roots. In every cell most segments have one root: pairs are
    made of all others there with all, and of those of that root with the others."""

    def rooted(df: DataFrame, line: str, root: str, by: str) -> DataFrame:
        found = spread_join(df.withColumn("node", F.col(line)), roots, ["node"], "left", by)
        return found.withColumn(root, F.coalesce("root", "node")).drop("node", "root")

    levels = feats.agg(F.collect_set("level")).scalar()
    cell = [*CELL, "_kind"]
    feats = stage(_feature_cells(rooted(feats, "v", "b_root", "x1")).withColumn("_kind", F.col("b_kind")), "crossed")
    per_root = feats.groupBy(*cell, "b_root").agg(F.count(F.lit(1)).alias("_n"))
    most = stage(per_root.groupBy(*cell).agg(F.max(F.struct("_n", "b_root")).alias("_m")).select(*cell, F.col("_m.b_root").alias("_most")), "most")
    probes = _probe_cells(rooted(probes, "u", "a_root", "x"), levels).withColumn("_kind", F.col("a_kind"))
    probes = stage(probes.join(most.hint("merge"), cell), "crossing")
    others = stage(feats.join(most.hint("merge"), cell).filter(F.col("b_root") != F.col("_most")).drop("_most"), "others")
    apart = _in_box() & (F.col("u") > F.col("v")) & (F.col("a_root") != F.col("b_root"))
    alone = F.col("a_root") != F.col("_most")
    pairs = [
        split_join(mine.drop("_most"), theirs, cell, ["u", "part_no"], ["v", *ENDS], apart)
        for mine, theirs in ((probes.filter(alone), feats), (probes.filter(~alone), others))
    ]
    return pairs[0].unionByName(pairs[1])


def _large_star(edges: DataFrame) -> DataFrame:
    """Tie all larger neighbours of a node to the smallest node it knows."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return (
        spread_join(both, low, ["u"], "inner", "v")
        .filter(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Tie a node and its smaller neighbours to the smallest of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = spread_join(edges, low, ["u"], "inner", "v").filter(F.col("v") > F.col("m"))
    return (
        moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(low.select("u", F.col("m").alias("v")))
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of an edge table (u, v) and the smallest node it is connected to.

    Alternating star contraction: each round shortens all paths, so the number of rounds grows with the
    logarithm of the longest one. Each round ends in a table in the shared folder, read by the next.
    """
    oriented = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    now = stage(oriented, "edges")
    while not _only_stars(now):
        after = stage(_small_star(_large_star(now)), "edges")
        drop_stage(now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _only_stars(edges: DataFrame) -> bool:
    """Is every node either tied to exactly one root, or a root itself?"""
    roles = edges.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above"))
    )
    seen = roles.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return seen.filter("below > 1 or (below = 1 and above = 1)").isEmpty()


def cluster_lines(segs: DataFrame, status: str = "status") -> DataFrame:
    """The segment table with cluster_id, the smallest line_id of all lines connected by touching within
    the same status. line_id must name one line of one status."""
    roots = components(touching_edges(segs, status)).select(F.col("node").alias("line_id"), "root")
    return (
        spread_join(segs, roots, ["line_id"], "left", "seg_no")
        .withColumn("cluster_id", F.coalesce("root", "line_id"))
        .drop("root")
    )

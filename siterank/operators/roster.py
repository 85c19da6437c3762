"""Row edits on a roster of points: duplicates, conflicts, snapshots, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siterank.operators.lookup import Lookup, lookup_within
from siterank.operators.skew import spread_join
from siterank.operators.within import exclude_within, flag_within

# Distances in metres at which two points count as the same (fixed values).
SAME_PLACE = 2.0
SAME_TYPE = 0.5
SAME_ADDED = 0.01
# Existing crossings rule out points this near (fixed value, 500 ft).
EXISTING_REACH = 152.4


def site_key() -> Column:
    """A stable id of a place, the same in every run and for every row order: two hashes with seeds of their own,
    128 bits as 32 hex digits. See `unique_ids` for the check that goes with it."""
    return F.concat(*[F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed), "x", "y"))), 16, "0") for seed in (1, 2)])


def unique_ids(points: DataFrame) -> DataFrame:
    """The points, one row per place, unchanged; fails if two places have one site_id. Reads the table once more."""
    twice = points.groupBy("site_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").first()
    if twice is not None:
        raise ValueError(f"{twice['n']} places share the id {twice['site_id']}")
    return points


def dedupe_points(points: DataFrame, keep: str = "point_type") -> DataFrame:
    """One row (x, y, keep) per place; the smallest value of `keep` wins."""
    return points.groupBy("x", "y").agg(F.min(keep).alias(keep))


def drop_where(df: DataFrame, condition) -> DataFrame:
    """Delete the rows for which the condition is true; where it is NULL the row stays."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


def conflicting_duplicates(points: DataFrame, status: str, id: str = "id") -> DataFrame:
    """Drop rows of status 0 that share their place with a row of another status."""
    other = points.filter(F.col(status) != 0).select("x", "y").distinct()
    zero = points.filter(F.col(status) == 0)
    rest = drop_where(points, F.col(status) == 0)
    return rest.unionByName(spread_join(zero, other, ["x", "y"], "left_anti", id))


def snapshot_diff(old: DataFrame, new: DataFrame, radius: float = SAME_PLACE) -> tuple[DataFrame, DataFrame]:
    """(points of the old roster with none of the new one near, points of the new one with no old near)."""
    return exclude_within(old, new, radius), exclude_within(new, old, radius)


def recode_within(
    points: DataFrame, layer: DataFrame, radius: float, status: str, old: int, new: int, near: bool = False
) -> DataFrame:
    """Change status `old` to `new` where no feature of the layer is within the radius (where one is, with
    near=True). points need site_id."""
    hit = points.join(flag_within(points, layer, radius, "_hit"), "site_id")
    turn = (F.col(status) == old) & (F.col("_hit") == (1 if near else 0))
    return hit.withColumn(status, F.when(turn, F.lit(new)).otherwise(F.col(status))).select(*points.columns)


def provenance(sites: DataFrame, confirmed: DataFrame, added: DataFrame) -> DataFrame:
    """(site_id, source_check): "new adds" at an added point, else "confirmed v2" near a confirmed one."""
    is_confirmed = flag_within(sites, confirmed, SAME_PLACE, "_confirmed")
    is_added = flag_within(sites, added, SAME_ADDED, "_added")
    label = F.when(F.col("_added") == 1, "new adds").when(F.col("_confirmed") == 1, "confirmed v2")
    return is_confirmed.join(is_added, "site_id").select("site_id", label.alias("source_check"))


def point_type(sites: DataFrame, base: DataFrame, edits: DataFrame, default: str) -> DataFrame:
    """(site_id, point_type): of the base point at the site, else of the edit near it, else the default.

    base: id, x, y, point_type; edits: id, x, y, newpointty."""
    of_base = lookup_within(sites, [Lookup(base, SAME_TYPE, "id", {"_base": "point_type"})], "point")
    of_edit = lookup_within(sites, [Lookup(edits, SAME_PLACE, "id", {"_edit": "newpointty"})], "point")
    return of_base.join(of_edit, "site_id").select(
        "site_id", F.coalesce("_base", "_edit", F.lit(default)).alias("point_type")
    )

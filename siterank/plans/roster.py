"""The roster of candidate points: base points, client edits, exclusions and late changes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siterank.operators.roster import (
    EXISTING_REACH,
    SAME_PLACE,
    conflicting_duplicates,
    dedupe_points,
    site_key,
    unique_ids,
)
from siterank.operators.within import Layer, exclude_near_any, exclude_within, keep_within
from siterank.sources.layers import point_rows
from siterank.sources.staging import stage


@dataclass(frozen=True)
class RosterInputs:
    """Point layers have x, y; existing has a multipoint column `points`; removal_areas has edges."""

    base: DataFrame  # point_type
    coded_removals: DataFrame  # id, ptstat
    edits: DataFrame  # newpointty, assigned_county
    study_additions: DataFrame
    existing: DataFrame  # crossings the client knows, as multipoints
    late_removals: DataFrame
    late_additions: DataFrame
    removal_areas: DataFrame  # edges
    addition_tag: str  # point_type of study additions and of points without a type
    late_tag: str  # point_type of late additions


def all_removals(inputs: RosterInputs) -> DataFrame:
    """Points the client wants removed: coded ones of a status other than 0, and edits that say so."""
    coded = conflicting_duplicates(inputs.coded_removals.filter(F.col("ptstat") != 0), "ptstat")
    return coded.select("x", "y").unionByName(inputs.edits.filter("newpointty = 'Remove'").select("x", "y"))


def edit_additions(inputs: RosterInputs) -> DataFrame:
    fresh = inputs.edits.filter(F.col("assigned_county").isNull() & (F.col("newpointty") != "Remove"))
    return fresh.select("x", "y", F.col("newpointty").alias("point_type"))


def with_site_id(points: DataFrame) -> DataFrame:
    return points.withColumn("site_id", site_key())


def all_additions(inputs: RosterInputs, removals: DataFrame) -> DataFrame:
    """Points to add, without those that are also to be removed."""
    study = inputs.study_additions.select("x", "y", F.lit(inputs.addition_tag).alias("point_type"))
    both = dedupe_points(study.unionByName(edit_additions(inputs)))
    return exclude_within(both, removals, SAME_PLACE)


def extended_crossings(crossings: DataFrame, existing: DataFrame, tag: str) -> DataFrame:
    """The crossing layer (id, x, y, source) plus client crossings that are not near a known one."""
    members = point_rows(existing.select("points")).distinct()
    fresh = exclude_within(members, crossings, EXISTING_REACH)
    added = fresh.select(site_key().alias("id"), "x", "y", F.lit(tag).alias("source"))
    return crossings.select(F.col("id").cast("string").alias("id"), "x", "y", F.lit(None).cast("string").alias("source")).unionByName(added)


def build_roster(inputs: RosterInputs) -> DataFrame:
    """(site_id, x, y, point_type), staged. site_id is a hash of the place; a collision stops the plan.

    Base points and additions each pass one spatial join against all that excludes them. The merged points
    are written once before the last checks, which read them twice.
    """
    removals = stage(all_removals(inputs), "removals")
    existing = point_rows(inputs.existing.select("points"))
    base = dedupe_points(inputs.base)
    kept = exclude_near_any(base, [Layer(removals, SAME_PLACE), Layer(existing, EXISTING_REACH)])
    added = all_additions(inputs, removals)
    points = kept.select("x", "y", "point_type").unionByName(added).unionByName(edit_additions(inputs))
    unique = dedupe_points(points).fillna({"point_type": inputs.addition_tag})
    merged = stage(unique, "merged")
    gone = removals.unionByName(inputs.late_removals.select("x", "y"))
    left = exclude_near_any(merged, [Layer(gone, SAME_PLACE), Layer(inputs.removal_areas, 0.0, kind="area")])
    late = inputs.late_additions.select("x", "y", F.lit(inputs.late_tag).alias("point_type"))
    everything = dedupe_points(left.select("x", "y", "point_type").unionByName(late))
    return unique_ids(stage(with_site_id(everything).select("site_id", "x", "y", "point_type"), "roster"))


def missed_removals(inputs: RosterInputs) -> DataFrame:
    """Audit list: base points inside the removal areas."""
    return keep_within(dedupe_points(inputs.base), inputs.removal_areas, 0.0, "area")

"""Scores and ranks of all sites, and of the sites away from major rivers with maxima of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siterank.operators.ranking import county_id, rank_against, rank_by, rank_sites
from siterank.operators.roster import point_type, provenance
from siterank.operators.scaling import FACTORS, SCALES, score
from siterank.sources.staging import stage

LABELS = [
    "county", "city", "community_designation", "major_river", "barrier_type", "barrier_desc", "location_desc", "point_type",
]
RAW = ["site_id", "x", "y", *SCALES, "acp", "acp50", "nearest_crossing_id", *LABELS]


def _with_ranks(scored: DataFrame) -> DataFrame:
    """Both ranks, each worked out from the few columns it needs of a staged table."""
    overall = rank_sites(scored.select("site_id", "priority_score"))
    county = rank_by(scored.select("site_id", "county", "priority_score"))
    return scored.join(overall.select("site_id", "priority_rank"), "site_id").join(
        county.select("site_id", "county_priority_rank"), "site_id"
    )


def prioritize(features: DataFrame) -> DataFrame:
    """Scale, score and rank. `features` is read several times, so pass a staged table."""
    return _with_ranks(stage(score(features, SCALES, FACTORS), "scored"))


def prioritize_subset(
    features: DataFrame,
    base_edits: DataFrame,
    confirmed: DataFrame,
    added: DataFrame,
    default_type: str,
    ranked_against: tuple[DataFrame, str] | None = None,
) -> DataFrame:
    """Only the raw columns of sites not at a major river, scored and ranked among themselves, with a
    readable id, a point type and the source of each point.

    ranked_against = (all ranked sites, county): take that county's ranks from the full table, gaps
    included, as the study did for one county."""
    away = features.filter(F.col("major_river").isNull()).select(*[c for c in RAW if c in features.columns])
    scored = stage(score(away, SCALES, FACTORS), "scored")
    ids = county_id(scored.select("site_id", "county", "x", "y")).select("site_id", "county_id")
    ranked = _with_ranks(scored).join(ids, "site_id")
    if ranked_against is not None:
        everyone, county = ranked_against
        theirs = everyone.filter(F.col("county") == county).drop("county_priority_rank")
        mine = ranked.filter(F.col("county") == county).drop("county_priority_rank")
        others = ranked.filter(~F.coalesce(F.col("county") == county, F.lit(False)))
        ranked = others.unionByName(rank_against(theirs, mine))
    known = scored.select("site_id", F.col("site_id").alias("id"), "x", "y", "point_type")
    types = point_type(known.drop("id"), known.drop("site_id"), base_edits, default_type)
    sources = provenance(scored.select("site_id", "x", "y"), confirmed, added)
    return ranked.drop("point_type").join(types, "site_id").join(sources, "site_id")

"""The feature matrix: what is near each site."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siterank.operators.labels import any_known
from siterank.operators.lines import LOCAL_METRES_PER_MILE, clip_miles, dissolve_pieces, erase_near
from siterank.operators.lookup import Lookup, lookup_within, nearest
from siterank.operators.within import (
    Layer,
    averages,
    clusters_within,
    finish_averages,
    tally,
)
from siterank.sources.staging import stage

# Radii in metres (fixed values: 200 ft, 400 ft, 500 ft, 1/4 mile, 1/2 mile).
CORRIDOR = 60.96
RAIL = 121.92
CRASH = 152.4
QUARTER = 402.336
HALF = 804.672

# Attribute values of the layers (fixed values).
PROBLEM = "improvement needed"
SUGGESTED = "suggested new crossing"
EXISTING_STATUS = ("Existing",)
PLANNED_STATUS = ("Alternate", "Planned")


@dataclass(frozen=True)
class FeatureLayers:
    crashes: DataFrame  # points
    comments: DataFrame  # points: kml_name, gender and the race columns
    schools: DataFrame  # points: sch_type1
    parks: DataFrame  # points
    stops: DataFrame  # points: on_off
    cells: DataFrame  # raster cells: value (slope)
    rail: DataFrame  # points: id, volume, lvolu
    taz: DataFrame  # areas: popden2014, popden2040, empden2014, empden2040
    demographics: DataFrame  # areas: the five shares named in DEMOGRAPHICS
    poverty: DataFrame  # areas
    poverty50: DataFrame  # areas
    corridors: DataFrame  # areas
    alignments: DataFrame  # segments
    trails: DataFrame  # segments: status
    bikeways: DataFrame  # segments: regstat
    crossings: DataFrame  # points: id
    race_columns: tuple[str, ...]


TAZ = {
    "popden_2014": "popden2014",
    "popden_2040": "popden2040",
    "empden_2014": "empden2014",
    "empden_2040": "empden2040",
}
DEMOGRAPHICS = {
    "bw_modeshr": "bike_walk_modeshare",
    "age_65_plus_pct": "seniors_per",
    "age_under_15_pct": "pop_under_15_per",
    "zero_car_pct": "zero_car_housing_units_per",
    "ppl_of_color_pct": "ppl_of_color_percent",
}


def count_if(condition: Column) -> Column:
    return F.when(condition, F.lit(1).cast("bigint"))


def college(kind: str = "sch_type1") -> Column:
    return F.col(kind).startswith("COLLEGE")


def tallied(sites: DataFrame, layers: FeatureLayers) -> DataFrame:
    """Every count, sum, average and flag: one spatial join for all point layers, one for all areas, one
    for the alignments."""
    one = F.lit(1).cast("bigint")
    sums = tally(
        sites,
        [
            Layer(layers.crashes, CRASH, {"bkpd_crash_500ft": one}),
            Layer(
                layers.comments,
                QUARTER,
                {
                    "wiki_probarea_qtr": count_if(F.col("kml_name") == PROBLEM),
                    "wiki_new_xing_qtr": count_if(F.col("kml_name") == SUGGESTED),
                    "wiki_women_qtr": count_if(F.col("gender") == "Female"),
                    "wiki_pplofcolor_qtr": count_if(any_known(*[F.col(c) for c in layers.race_columns])),
                },
            ),
            Layer(
                layers.schools,
                HALF,
                {"schools_half": count_if(~college()), "colleges_half": count_if(college())},
            ),
            Layer(layers.parks, HALF, {"reg_parks_half": one}),
            Layer(layers.stops, HALF, {"trans_riders_qtr": F.col("on_off").cast("double")}),
            Layer(layers.cells, QUARTER, averages({"avg_slope": "value"})),
            Layer(layers.taz, HALF, averages(TAZ), "area"),
            Layer(layers.demographics, HALF, averages(DEMOGRAPHICS), "area"),
            Layer(layers.poverty, 0.0, {"acp": one}, "area"),
            Layer(layers.poverty50, 0.0, {"acp50": one}, "area"),
            Layer(layers.corridors, 0.0, {"rbtn_corridor": one}, "area"),
            Layer(layers.alignments, QUARTER, {"rbtn_alignment": one}, "segment"),
        ],
    )
    sums = finish_averages(sums, ["avg_slope", *TAZ, *DEMOGRAPHICS])
    flags = ("acp", "acp50", "rbtn_corridor", "rbtn_alignment")
    return sums.withColumns({f: F.when(F.col(f) > 0, F.lit(10)).otherwise(F.lit(0)) for f in flags})


def rail_volume(sites: DataFrame, rail: DataFrame) -> DataFrame:
    """(site_id, rail_volume): volume of the nearest daily count that is not 0 within 400 ft, else 0."""
    daily = rail.filter((F.col("lvolu") == "D") & F.col("volume").isNotNull() & (F.col("volume") != 0))
    found = lookup_within(sites, [Lookup(daily, RAIL, "id", {"rail_volume": "volume"})], "point")
    return found.fillna(0, ["rail_volume"])


def local_lines(layers: FeatureLayers) -> DataFrame:
    """Local bikeways by regstat, overlaps once, without what runs along regional lines.

    Dissolving and erasing do not depend on the site, so they are done once for the layer before it is
    clipped to circles, and not once per circle."""
    once = dissolve_pieces(layers.bikeways.filter(F.col("regstat").isin(1, 2, 3)), ["regstat"])
    regional = layers.trails.select("x1", "y1", "x2", "y2").unionByName(layers.alignments.select("x1", "y1", "x2", "y2"))
    return erase_near(once, regional, CORRIDOR, ["regstat", "line_id", "seg_no"])


def line_miles(sites: DataFrame, layers: FeatureLayers) -> DataFrame:
    local = stage(local_lines(layers), "local")
    status = F.col("regstat")
    near = clip_miles(
        sites, local, QUARTER, {"ex_local_miles_qtr": status == 1, "pl_local_miles_qtr": status.isin(2, 3)}, LOCAL_METRES_PER_MILE
    )
    regional = clip_miles(sites, layers.trails, HALF, {"expl_reg_miles_half": F.lit(True)})
    return near.join(regional, "site_id")


def facility_counts(sites: DataFrame, existing: DataFrame, planned: DataFrame) -> DataFrame:
    """Clusters of touching regional trails near each site; both layers need cluster_id."""
    return clusters_within(sites, {"ex_reg_fac_half": existing, "pl_reg_fac_half": planned}, HALF)


def feature_matrix(sites: DataFrame, layers: FeatureLayers, clustered_trails: DataFrame) -> DataFrame:
    """One row per site with all features. clustered_trails is the trail layer with cluster_id."""
    existing = clustered_trails.filter(F.col("status").isin(*EXISTING_STATUS))
    planned = clustered_trails.filter(F.col("status").isin(*PLANNED_STATUS))
    crossing = nearest(
        sites, layers.crossings, "point", "id", {"nearest_crossing_id": "id"}, "dist2ex_crossing_m"
    )
    parts = [
        tallied(sites, layers),
        rail_volume(sites, layers.rail),
        line_miles(sites, layers),
        facility_counts(sites, existing, planned),
        crossing,
    ]
    out = sites
    for part in parts:
        out = out.join(part, "site_id")
    return out

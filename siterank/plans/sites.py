"""Labels of each site: regions, rivers, barrier, texts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siterank.operators.labels import NAMING_REACH, describe_site, location_text, major_river_flag
from siterank.operators.lookup import Lookup, lookup_within
from siterank.operators.roster import SAME_TYPE, drop_where

# Counties outside the study area (fixed values).
OUTSIDE = ("Chisago", "Wright")


@dataclass(frozen=True)
class LabelLayers:
    """Area layers have id, edges and a name column; line layers are segment tables with line_id."""

    base: DataFrame  # id, x, y, point_type
    counties: DataFrame  # cty_name
    cities: DataFrame  # name
    designations: DataFrame  # designation
    barriers: DataFrame  # source
    streams: DataFrame  # name
    railroads: DataFrame  # name
    expressways: DataFrame  # streetall, f_xstreet, t_xstreet
    roads: DataFrame  # streetall


def label_sites(sites: DataFrame, layers: LabelLayers, outside: tuple[str, ...] = OUTSIDE) -> DataFrame:
    """Sites inside the study area with county, city, designation, river flag, barrier and texts."""
    own_type = lookup_within(sites, [Lookup(layers.base, SAME_TYPE, "id", {"point_type": "point_type"})], "point")
    regions = lookup_within(
        sites,
        [
            Lookup(layers.counties, NAMING_REACH, "id", {"county": "cty_name"}),
            Lookup(layers.cities, NAMING_REACH, "id", {"city": "name"}),
            Lookup(layers.designations, 0.0, "id", {"community_designation": "designation"}),
        ],
        "area",
    )
    river = major_river_flag(sites, layers.streams)
    text = describe_site(
        sites, layers.barriers, layers.streams, layers.railroads, layers.expressways, layers.roads
    )
    out = sites.select("site_id", "x", "y")
    for part in (own_type, regions, river, text):
        out = out.join(part, "site_id")
    out = out.withColumn(
        "location_desc", location_text(F.col("barrier_type"), F.col("barrier_desc"), F.col("city"), F.col("county"))
    )
    return drop_where(out, F.col("county").isin(*outside))

"""Texts that describe a site from what is near it."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siterank.operators.lookup import Lookup, lookup_within, nearest
from siterank.operators.within import flag_within

# Radii in metres and label texts (fixed values).
NAMING_REACH = 1609.34
ROAD_REACH = 800.0
RIVER_REACH = 100.0
MAJOR_RIVERS = ("Mississippi River", "Minnesota River", "St. Croix River")
UNNAMED_STREAM = "Unnamed Stream"
UNNAMED_RAILROAD = "RR"


def joined_text(*parts: Column) -> Column:
    """Concatenation in which NULL counts as empty text."""
    return F.concat_ws("", *parts)


def cross_streets(first: Column, second: Column) -> Column:
    """Both names with "/" between, or the one there is, or NULL."""
    return F.when(first.isNotNull() & second.isNotNull(), F.concat(first, F.lit("/"), second)).otherwise(
        F.coalesce(first, second)
    )


def any_known(*cols: Column) -> Column:
    """Is any of the columns not NULL?"""
    return reduce(or_, [c.isNotNull() for c in cols])


def major_river_flag(sites: DataFrame, streams: DataFrame, names=MAJOR_RIVERS, column: str = "name") -> DataFrame:
    """(site_id, major_river): 1 within 100 m of a named river, else NULL."""
    rivers = streams.filter(F.col(column).isin(*names))
    hit = flag_within(sites, rivers, RIVER_REACH, "_hit", "segment")
    return hit.select("site_id", F.when(F.col("_hit") == 1, F.lit(1)).alias("major_river"))


def describe_site(
    sites: DataFrame,
    barriers: DataFrame,
    streams: DataFrame,
    railroads: DataFrame,
    expressways: DataFrame,
    roads: DataFrame,
) -> DataFrame:
    """(site_id, barrier_type, barrier_desc): the kind of the nearest barrier and its name and road.

    Layers are segment tables with line_id; barriers has source, streams and railroads name, expressways
    streetall, f_xstreet and t_xstreet, roads streetall. A feature with a name wins over nearer ones
    without. An expressway without cross streets is told by the nearest road.
    """
    kind = nearest(sites, barriers, "segment", "line_id", {"barrier_type": "source"})
    railroad = nearest(sites, railroads.filter(F.col("name").isNotNull()), "segment", "line_id", {"_railroad": "name"})
    crossed = expressways.withColumn("_cross", cross_streets(F.col("f_xstreet"), F.col("t_xstreet")))
    around = lookup_within(
        sites,
        [
            Lookup(streams.filter(F.col("name").isNotNull()), NAMING_REACH, "line_id", {"_stream": "name"}),
            Lookup(crossed, NAMING_REACH, "line_id", {"_expressway": "streetall", "_cross": "_cross"}),
            Lookup(roads, NAMING_REACH, "line_id", {"_road": "streetall"}, "_road_dist"),
        ],
        "segment",
    )
    near_road = F.when(F.col("_road_dist") <= ROAD_REACH, F.col("_road"))
    near = F.lit(" near ")
    text = (
        F.when(
            F.col("barrier_type") == "Streams",
            joined_text(F.coalesce("_stream", F.lit(UNNAMED_STREAM)), near, F.col("_road")),
        )
        .when(
            F.col("barrier_type") == "Railroads",
            joined_text(F.coalesce("_railroad", F.lit(UNNAMED_RAILROAD)), near, near_road),
        )
        .when(
            F.col("barrier_type") == "Expressways",
            joined_text(F.col("_expressway"), near, F.coalesce(F.col("_cross"), near_road)),
        )
    )
    return (
        kind.join(railroad, "site_id").join(around, "site_id").select("site_id", "barrier_type", text.alias("barrier_desc"))
    )


def location_text(barrier_type: Column, barrier_desc: Column, city: Column, county: Column) -> Column:
    return joined_text(
        barrier_type, F.lit("   "), barrier_desc, F.lit("  -  "), city, F.lit(" , "), county, F.lit(" County")
    )

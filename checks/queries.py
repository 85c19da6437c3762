"""The registered queries: one per operator and one per plan, over the layers of `layers.py`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import layers as L
from siterank.operators import clusters, labels, lines, lookup, pyramid, ranking, roster, scaling, within
from siterank.plans import build_roster, feature_matrix, label_sites, prioritize, prioritize_subset
from siterank.plans.features import (
    CORRIDOR, CRASH, DEMOGRAPHICS, HALF, PROBLEM, QUARTER, SUGGESTED, TAZ, count_if, facility_counts, line_miles, rail_volume, tallied,
)
from siterank.plans.roster import all_additions, all_removals, extended_crossings, missed_removals
from siterank.sources import point_rows, stage, write_sites
from siterank.sources.staging import stage_root

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places; the sums behind them depend on the order of addition in their last digits."""
    return df.select(
        [F.round(f.name, 6).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema]
    )


# --- layers -------------------------------------------------------------------------------------------


@query
def line_segments(spark, d):
    return L.trails(spark, d).select("line_id", F.col("seg_no").cast("bigint").alias("seg_no"), "x1", "y1", "x2", "y2")


@query
def multipoint_rows(spark, d):
    return point_rows(L.existing(spark, d))


@query
def raster_layer(spark, d):
    return L.cells(spark, d)


@query
def site_sink(spark, d):
    """Write the sites by county and read them back."""
    from uuid import uuid4

    sites = L.sites(spark, d)
    county = lookup.assign_region(sites, L.counties(spark, d), "cty_name", "county", 0.0)
    path = f"{stage_root(spark)}/siterank/sink-{uuid4().hex}"
    write_sites(sites.join(county, "site_id"), path)
    return spark.read.parquet(path).select("site_id", "x", "y", "point_type", F.col("county").cast("string").alias("county"))


# --- what is within a radius ---------------------------------------------------------------------------


@query
def count_within(spark, d):
    return within.count_within(L.sites(spark, d), L.crashes(spark, d), CRASH, {"n": F.lit(True)})


@query
def count_within_filtered(spark, d):
    return within.count_within(
        L.sites(spark, d),
        L.comments(spark, d),
        QUARTER,
        {
            "problems": F.col("kml_name") == PROBLEM,
            "suggested": F.col("kml_name") == SUGGESTED,
            "women": F.col("gender") == "Female",
            "pplofcolor": labels.any_known(F.col("race_black"), F.col("race_asia")),
        },
    )


@query
def schools_within(spark, d):
    college = F.col("sch_type1").startswith("COLLEGE")
    return within.count_within(
        L.sites(spark, d), L.schools(spark, d), HALF, {"schools_half": ~college, "colleges_half": college}
    )


@query
def sum_within(spark, d):
    return within.sum_within(L.sites(spark, d), L.stops(spark, d), HALF, "on_off", "riders")


@query
def point_pairs_within(spark, d):
    return rounded(within.pairs_within(L.sites(spark, d), L.parks(spark, d), HALF, "point", ["id"]))


@query
def lines_within(spark, d):
    sites, nearest = L.sites(spark, d), [F.min("dist").alias("dist")]
    pairs = within.pairs_within(sites, L.trails(spark, d), QUARTER, "segment", ["line_id"], per_place=True)
    return rounded(within.to_sites(sites, pairs.groupBy("x", "y", "line_id").agg(*nearest), ["line_id"], nearest))


@query
def points_in_areas(spark, d):
    return within.points_in_areas(L.sites(spark, d), L.areas(spark, d))


@query
def areas_within(spark, d):
    return within.tally(
        L.sites(spark, d), [within.Layer(L.areas(spark, d), HALF, {"n": F.lit(1).cast("bigint")}, "area")]
    )


@query
def town_stops_within(spark, d):
    """Stops crowd in a town, so sums of cells are made beforehand."""
    points = L.town_stops(spark, d).select(F.col("x").alias("px"), F.col("y").alias("py"), F.lit(1).cast("bigint").alias("n"), F.col("id").alias("ids"))
    near = pyramid.circle_sums(L.sites(spark, d), points, HALF, ["n", "ids"])
    return L.sites(spark, d).select("site_id").join(near, "site_id", "left").select("site_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "ids")])


@query
def avg_areas_within(spark, d):
    return rounded(within.avg_areas_within(L.sites(spark, d), L.areas(spark, d), HALF, TAZ | DEMOGRAPHICS))


@query
def points_in_zones(spark, d):
    return within.points_in_areas(L.sites(spark, d), L.zones(spark, d))


@query
def avg_zones_within(spark, d):
    layer = within.Layer(L.zones(spark, d), HALF, within.averages({"value": "value"}) | {"n": F.lit(1).cast("bigint")}, "area")
    return rounded(within.finish_averages(within.tally(L.sites(spark, d), [layer]), ["value"]))


@query
def flag_in_zones(spark, d):
    return within.flag_within(L.sites(spark, d), L.zones(spark, d), 0.0, "in_zone", "area", 10)


@query
def assign_zone(spark, d):
    return lookup.assign_region(L.sites(spark, d), L.zones(spark, d), "name", "zone", 1609.34)


@query
def exclude_within(spark, d):
    return within.exclude_within(L.sites(spark, d), L.removals(spark, d), 2.0)


@query
def exclude_existing(spark, d):
    return within.exclude_within(L.sites(spark, d), point_rows(L.existing(spark, d)), 152.4)


@query
def keep_within(spark, d):
    return within.keep_within(L.sites(spark, d), L.removal_areas(spark, d), 0.0, "area")


@query
def flag_within(spark, d):
    return within.flag_within(L.sites(spark, d), L.alignments(spark, d), QUARTER, "rbtn_alignment", "segment", 10)


@query
def flag_in_areas(spark, d):
    return within.flag_within(L.sites(spark, d), L.poverty50(spark, d), 0.0, "acp50", "area", 10)


@query
def major_river_flag(spark, d):
    return labels.major_river_flag(L.sites(spark, d), L.of_source(spark, d, "Streams"))


@query
def tallied_features(spark, d):
    return rounded(tallied(L.sites(spark, d), L.feature_layers(spark, d)))


# --- nearest and lookups -------------------------------------------------------------------------------


@query
def lookup_nearest(spark, d):
    return rail_volume(L.sites(spark, d), L.rail(spark, d))


@query
def assign_county(spark, d):
    return lookup.assign_region(L.sites(spark, d), L.counties(spark, d), "cty_name", "county", 1609.34)


@query
def assign_city(spark, d):
    return lookup.assign_region(L.sites(spark, d), L.cities(spark, d), "name", "city", 1609.34)


@query
def nearest_line_within(spark, d):
    look = lookup.Lookup(L.trails(spark, d), 800.0, "line_id", {"line_id": "line_id", "road": "streetall"}, "dist")
    return rounded(lookup.lookup_within(L.sites(spark, d), [look], "segment"))


@query
def nearest_crossing(spark, d):
    return rounded(
        lookup.nearest(
            L.sites(spark, d), L.crossings(spark, d), "point", "id", {"nearest_crossing_id": "id"}, "dist2ex_crossing_m"
        )
    )


@query
def nearest_barrier(spark, d):
    return rounded(
        lookup.nearest(
            L.sites(spark, d), L.barriers(spark, d), "segment", "line_id",
            {"line_id": "line_id", "barrier_type": "source"}, "dist",
        )
    )


@query
def nearest_stop(spark, d):
    """A big layer on the feature side of the unbounded nearest search."""
    return rounded(lookup.nearest(L.sites(spark, d), L.stops(spark, d), "point", "id", {"id": "id"}, "dist"))


@query
def nearest_town_stop(spark, d):
    """Features of which most lie in one town and one very far away."""
    return rounded(lookup.nearest(L.sites(spark, d), L.town_stops(spark, d), "point", "id", {"id": "id"}, "dist"))


def _described(spark, d, sites):
    lay = L.label_layers(spark, d)
    return labels.describe_site(sites, lay.barriers, lay.streams, lay.railroads, lay.expressways, lay.roads)


@query
def describe_site(spark, d):
    return _described(spark, d, L.sites(spark, d))


@query
def label_sites_plan(spark, d):
    return label_sites(L.sites(spark, d), L.label_layers(spark, d))


# --- roster --------------------------------------------------------------------------------------------


@query
def dedupe_points(spark, d):
    edits = L.edits(spark, d).select("x", "y", F.col("newpointty").alias("point_type"))
    return roster.dedupe_points(L.sites(spark, d).select("x", "y", "point_type").unionByName(edits))


@query
def conflicting_duplicates(spark, d):
    return roster.conflicting_duplicates(L.removals(spark, d), "ptstat").select("id", "x", "y", F.col("ptstat"))


@query
def snapshot_diff(spark, d):
    old = L.sites(spark, d).select("site_id", "x", "y")
    new = L.confirmed(spark, d).withColumnRenamed("id", "site_id")
    removed, added = roster.snapshot_diff(old, new)
    return removed.withColumn("change", F.lit("removed")).unionByName(added.withColumn("change", F.lit("added")))


@query
def recode_within(spark, d):
    points = L.removals(spark, d).withColumnRenamed("id", "site_id")
    return roster.recode_within(points, L.sites(spark, d), 2.0, "ptstat", 0, 2)


@query
def recode_near(spark, d):
    points = L.removals(spark, d).withColumnRenamed("id", "site_id")
    return roster.recode_within(points, L.sites(spark, d), 2.0, "ptstat", 0, 2, near=True)


@query
def provenance(spark, d):
    return roster.provenance(L.sites(spark, d), L.confirmed(spark, d), L.late_additions(spark, d))


@query
def point_type(spark, d):
    return roster.point_type(L.sites(spark, d), L.typed_points(spark, d), L.edits(spark, d), L.ADDITION)


@query
def extended_crossing_layer(spark, d):
    out = extended_crossings(L.crossings(spark, d), L.existing(spark, d), L.ADDITION)
    return out.select("x", "y", "source")


@query
def additions(spark, d):
    inputs = L.roster_inputs(spark, d)
    return all_additions(inputs, all_removals(inputs))


@query
def missed_removal_list(spark, d):
    return missed_removals(L.roster_inputs(spark, d)).select("x", "y", "point_type")


@query
def study_roster(spark, d):
    return build_roster(L.roster_inputs(spark, d)).select("x", "y", "point_type")


# --- lines ---------------------------------------------------------------------------------------------


@query
def clip_pieces(spark, d):
    pieces = lines.clip_to_radius(L.sites(spark, d), L.trails(spark, d), HALF)
    return rounded(pieces.select("site_id", "line_id", F.col("seg_no").cast("bigint").alias("seg_no"), "len_m"))


@query
def sum_pieces(spark, d):
    pieces = lines.clip_to_radius(L.sites(spark, d), L.bikeways(spark, d), QUARTER, ["regstat"], per_place=True)
    status = F.col("regstat")
    return rounded(
        lines.sum_pieces(L.sites(spark, d), pieces, {"existing": status == 1, "planned": status.isin(2, 3)})
    )


@query
def clip_miles(spark, d):
    return rounded(
        lines.clip_miles(L.sites(spark, d), L.trails(spark, d), HALF, {"expl_reg_miles_half": F.lit(True)})
    )


def _length(x1="x1", y1="y1", x2="x2", y2="y2"):
    return F.sqrt(F.pow(F.col(x2) - F.col(x1), 2) + F.pow(F.col(y2) - F.col(y1), 2))


@query
def erase_corridors(spark, d):
    regional = L.trails(spark, d).select(*lines.ENDS).unionByName(L.alignments(spark, d).select(*lines.ENDS))
    kept = lines.erase_near(L.bikeways(spark, d), regional, CORRIDOR)
    per_line = kept.groupBy("line_id", "regstat").agg(F.sum(_length()).alias("len_m"))
    every = L.bikeways(spark, d).select("line_id", "regstat").distinct()
    return rounded(every.join(per_line, ["line_id", "regstat"], "left").fillna(0.0, ["len_m"]))


@query
def dissolved_length(spark, d):
    once = lines.dissolve_pieces(L.streets(spark, d), ["regstat"])
    return once.groupBy("regstat").agg(F.round(F.sum(_length()), 3).alias("len_m"))


@query
def dissolved_diagonals(spark, d):
    once = lines.dissolve_pieces(L.diagonals(spark, d), ["regstat"])
    return once.groupBy("regstat").agg(F.round(F.sum(_length()), 3).alias("len_m"))


@query
def dissolved_miles(spark, d):
    once = lines.dissolve_pieces(L.streets(spark, d), ["regstat"])
    kinds = {s: F.col("regstat") == s for s in ("F", "O", "P")}
    return rounded(lines.clip_miles(L.sites(spark, d), once, QUARTER, {f"miles_{s.lower()}": c for s, c in kinds.items()}, lines.LOCAL_METRES_PER_MILE))


@query
def line_miles_plan(spark, d):
    return rounded(line_miles(L.sites(spark, d), L.feature_layers(spark, d)))


# --- clusters ------------------------------------------------------------------------------------------


def _clustered(spark, d):
    return clusters.cluster_lines(L.trails(spark, d))


@query
def line_clusters(spark, d):
    return _clustered(spark, d).select("status", "line_id", "cluster_id").distinct()


@query
def clusters_within(spark, d):
    trails = stage(_clustered(spark, d), "clustered")
    return facility_counts(
        L.sites(spark, d), trails.filter("status = 'Existing'"), trails.filter("status in ('Alternate', 'Planned')")
    )


# --- scaling, scores, ranks ----------------------------------------------------------------------------

SMALL_SCALES = {"crashes": ("s_crashes", "zero"), "problems": ("s_problems", "null"), "riders": ("s_riders", "zero"),
                "flag": ("s_flag", "pass")}
SMALL_FACTORS = (
    scaling.Factor("safety", ("s_crashes", "s_problems"), 2, 6.5),
    scaling.Factor("demand", ("s_riders", "s_flag"), 2, 3.5),
)


def _few_features(spark, d):
    """Sites with county and four features; riders is NULL at sites without any crash."""
    sites = L.sites(spark, d)
    sums = within.tally(
        sites,
        [
            within.Layer(L.crashes(spark, d), CRASH, {"crashes": F.lit(1).cast("bigint")}),
            within.Layer(L.comments(spark, d), QUARTER, {"problems": count_if(F.col("kml_name") == PROBLEM)}),
            within.Layer(L.stops(spark, d), HALF, {"riders": F.col("on_off").cast("bigint")}),
            within.Layer(L.alignments(spark, d), QUARTER, {"flag": F.lit(1).cast("bigint")}, "segment"),
        ],
    )
    county = lookup.assign_region(sites, L.counties(spark, d), "cty_name", "county", 0.0)
    return (
        sites.select("site_id", "x", "y").join(sums, "site_id").join(county, "site_id")
        .withColumn("riders", F.when(F.col("crashes") > 0, F.col("riders")))
        .withColumn("flag", F.when(F.col("flag") > 0, 10).otherwise(0))
    )


def _few_scored(spark, d):
    return scaling.score(stage(_few_features(spark, d), "features"), SMALL_SCALES, SMALL_FACTORS)


@query
def column_maxima(spark, d):
    return scaling.column_maxima(_few_features(spark, d), ["crashes", "problems", "riders"])


@query
def scale_zero_filled(spark, d):
    return rounded(
        scaling.scale(stage(_few_features(spark, d)), {"crashes": ("s_crashes", "zero")}).select("site_id", "s_crashes")
    )


@query
def scale_null(spark, d):
    few = stage(_few_features(spark, d)).withColumn("nothing", F.lit(0))
    scaled = scaling.scale(few, {"riders": ("s_riders", "null"), "nothing": ("s_nothing", "null")})
    return rounded(scaled.select("site_id", "s_riders", "s_nothing"))


@query
def factor_scores(spark, d):
    few = scaling.scale(stage(_few_features(spark, d)), SMALL_SCALES)
    return rounded(
        scaling.factor_scores(few, SMALL_FACTORS)
        .select("site_id", "safety_raw", "safety_score", "demand_raw", "demand_score")
    )


@query
def priority_score(spark, d):
    return rounded(_few_scored(spark, d).select("site_id", "priority_raw", "priority_score"))


def _rankable(spark, d):
    return stage(rounded(_few_scored(spark, d).select("site_id", "x", "y", "county", "priority_score")), "scored")


@query
def regional_rank(spark, d):
    return ranking.rank_sites(_rankable(spark, d))


@query
def county_rank(spark, d):
    return ranking.rank_by(_rankable(spark, d)).select("site_id", "county", "county_priority_rank")


@query
def rank_against(spark, d):
    everyone = _rankable(spark, d)
    river = labels.major_river_flag(L.sites(spark, d), L.of_source(spark, d, "Streams")).filter("major_river is null")
    away = everyone.join(river.select("site_id"), "site_id")
    return ranking.rank_against(everyone, away).select("site_id", "county", "county_priority_rank")


@query
def geographic_rank(spark, d):
    few = L.sites(spark, d).join(
        lookup.assign_region(L.sites(spark, d), L.counties(spark, d), "cty_name", "county", 1609.34), "site_id"
    )
    return ranking.geographic_rank(few, groups=None).select("site_id", "county", "geographic_rank")


@query
def county_id(spark, d):
    few = L.sites(spark, d).join(
        lookup.assign_region(L.sites(spark, d), L.counties(spark, d), "cty_name", "county", 1609.34), "site_id"
    )
    return ranking.county_id(few).select("site_id", "county", "county_id")


@query
def quartile_score(spark, d):
    sites = stage(within.sum_within(L.sites(spark, d), L.stops(spark, d), HALF, "on_off", "riders"))
    return scaling.quartile_score(sites, "riders", "scld_riders")


@query
def zonal_mean(spark, d):
    return rounded(within.zonal_mean(L.sites(spark, d), L.cells(spark, d), QUARTER, "avg_slope"))


@query
def tier_score(spark, d):
    tier = within.lowest_within(L.sites(spark, d), L.trails(spark, d), QUARTER, "tier", "tier")
    return scaling.tier_score(tier, "tier", "scld_rbtn_corridor")


# --- whole study ---------------------------------------------------------------------------------------


def _study_features(spark, d):
    """Roster, labels and features, each written once: later steps read them several times."""
    sites = stage(build_roster(L.roster_inputs(spark, d)), "roster")
    labelled = stage(label_sites(sites, L.label_layers(spark, d)), "labelled")
    lay = L.feature_layers(spark, d)
    trails = stage(clusters.cluster_lines(lay.trails), "clustered")
    return stage(feature_matrix(labelled, lay, trails), "features")


def _presented(df, drop=()):
    return rounded(df.drop("site_id", "tier", *drop))


@query
def study_features(spark, d):
    return _presented(_study_features(spark, d))


@query
def prioritized_sites(spark, d):
    return _presented(prioritize(_study_features(spark, d)))


@query
def prioritized_subset(spark, d):
    out = prioritize_subset(
        _study_features(spark, d), L.edits(spark, d), L.confirmed(spark, d), L.late_additions(spark, d), L.ADDITION
    )
    return _presented(out)


@query
def subset_ranked_against(spark, d):
    """The subset with one county's ranks taken from the full table."""
    features = _study_features(spark, d)
    out = prioritize_subset(
        features, L.edits(spark, d), L.confirmed(spark, d), L.late_additions(spark, d), L.ADDITION,
        ranked_against=(prioritize(features), "Dakota"),
    )
    return _presented(out)

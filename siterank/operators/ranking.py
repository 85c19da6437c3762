"""Ranks and exact quantiles that never bring a whole group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siterank.operators.skew import spread_join
from siterank.sources.staging import stage

# Counties that get ranks and ids of their own (fixed values); the id starts with their first letter.
COUNTIES = ("Anoka", "Carver", "Dakota", "Hennepin", "Ramsey", "Scott", "Washington")


def _positions(df: DataFrame, keys: list[str], order: list[Column], part: list[str]) -> DataFrame:
    """(part..., keys..., _n, _before): every different key, its rows, and the rows ordered before it.

    Rows are first counted per key, so ties cost one row. The keys are cut into ranges over the cluster and
    written with their range number; a range needs only its own running sum plus the total of the ranges
    before it, of which there is one row per range and group.
    """
    counts = df.groupBy(*part, *keys).agg(F.count(F.lit(1)).alias("_n"))
    ranged = stage(
        counts.repartitionByRange(*[F.col(p) for p in part], *order).withColumn("_range", F.spark_partition_id()),
        "ranges",
    )
    group = [F.col(p) for p in part]
    totals = ranged.groupBy(*part, "_range").agg(F.sum("_n").alias("_t"))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *[F.col(p).alias(f"_s_{p}") for p in part],
        F.col("_range").alias("_s_range"),
        F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_start"),
    )
    same = F.col("_range") == F.col("_s_range")
    for p in part:
        same = same & F.col(p).eqNullSafe(F.col(f"_s_{p}"))
    within = Window.partitionBy("_range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(starts, same).select(
        *part, *keys, "_n", (F.col("_start") + F.coalesce(F.sum("_n").over(within), F.lit(0))).alias("_before")
    )


def rank_rows(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    name: str,
    part: list[str] | None = None,
    id: str = "site_id",
    staged: bool = False,
) -> DataFrame:
    """Add the rank (ties share it, gaps follow) of each row by `order` over `keys`, within groups `part`.

    df is read for the counts, for its heavy keys and for the join, so it is staged first, unless it is already."""
    part = part or []
    df = df if staged else stage(df, "ranked")
    places = _positions(df, keys, order, part).select(
        *part, *keys, (F.col("_before") + 1).cast("bigint").alias(name)
    )
    return spread_join(df, places, [*part, *keys], "left", id)


def rank_sites(df: DataFrame, score: str = "priority_score", name: str = "priority_rank") -> DataFrame:
    """Regional rank, highest score first. Sites without a score come first, as in the study."""
    return rank_rows(df, [score], [F.col(score).desc_nulls_first()], name)


def rank_by(
    df: DataFrame,
    part: str = "county",
    score: str = "priority_score",
    name: str = "county_priority_rank",
    groups: tuple[str, ...] | None = COUNTIES,
) -> DataFrame:
    """Rank within each group; NULL for groups not listed (all groups with None)."""
    return _within_groups(df, part, [score], [F.col(score).desc_nulls_first()], name, groups)


def geographic_rank(
    df: DataFrame, part: str = "county", name: str = "geographic_rank", groups: tuple[str, ...] | None = COUNTIES
) -> DataFrame:
    """Rank from north to south, then west to east, within each group."""
    return _within_groups(df, part, ["y", "x"], [F.col("y").desc(), F.col("x").asc()], name, groups)


def _within_groups(df, part, keys, order, name, groups) -> DataFrame:
    df = stage(df, "ranked")
    listed = F.col(part).isin(*groups) if groups is not None else F.lit(True)
    ranked = df.filter(F.coalesce(listed, F.lit(False)))
    rest = df.filter(~F.coalesce(listed, F.lit(False))).withColumn(name, F.lit(None).cast("bigint"))
    return rank_rows(ranked, keys, order, name, [part], staged=True).unionByName(rest)


def rank_against(
    population: DataFrame,
    targets: DataFrame,
    part: str = "county",
    score: str = "priority_score",
    name: str = "county_priority_rank",
) -> DataFrame:
    """Give target rows the rank they hold in another table (joined by site_id), gaps included. Targets
    not in the population get NULL."""
    ranks = rank_rows(
        population.select("site_id", part, score), [score], [F.col(score).desc_nulls_first()], name, [part]
    )
    return targets.join(ranks.select("site_id", name), "site_id", "left")


def county_id(
    df: DataFrame, part: str = "county", name: str = "county_id", groups: tuple[str, ...] | None = COUNTIES
) -> DataFrame:
    """Readable id: first letter of the county and the geographic rank, padded to three digits or more."""
    rank = F.col("_geo").cast("string")
    text = F.concat(F.substring(part, 1, 1), F.lpad(rank, F.greatest(F.length(rank), F.lit(3)), F.lit("0")))
    return geographic_rank(df, part, "_geo", groups).withColumn(name, text).drop("_geo")


def quartiles(df: DataFrame, column: str, probs: tuple[float, ...] = (0.25, 0.5, 0.75, 1.0)) -> list[float]:
    """Exact quantiles of a column's positive values, interpolated between neighbours. Only the values next
    to each wanted position reach the driver."""
    values = df.filter(F.col(column) > 0).select(F.col(column).cast("double").alias("_v"))
    runs = stage(_positions(values, ["_v"], [F.col("_v").asc()], []), "runs")
    total = runs.agg(F.sum("_n")).first()[0]
    if not total:
        return [None] * len(probs)
    spots = [p * (total - 1) for p in probs]
    wanted = sorted({i for s in spots for i in (int(s), min(int(s) + 1, total - 1))})
    holds = F.lit(False)
    for i in wanted:
        holds = holds | ((F.col("_before") <= i) & (F.lit(i) < F.col("_before") + F.col("_n")))
    found = runs.filter(holds).select("_v", "_before", "_n").collect()
    at = {i: r["_v"] for i in wanted for r in found if r["_before"] <= i < r["_before"] + r["_n"]}
    return [at[int(s)] + (s - int(s)) * (at[min(int(s) + 1, total - 1)] - at[int(s)]) for s in spots]

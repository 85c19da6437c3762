"""Scale features to a common range, combine them into factor scores and one priority score."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siterank.operators.ranking import quartiles


@dataclass(frozen=True)
class Factor:
    name: str
    members: tuple[str, ...]
    divisor: int
    weight: float
    zero_if_null: tuple[str, ...] = ()


# How each feature is scaled (fixed values): feature -> (scaled column, mode).
# "zero": 0 stays 0 even where the maximum is 0; "null": a maximum of 0 gives NULL; "pass": already 0 to 10.
SCALES = {
    "bkpd_crash_500ft": ("scld__bkpd_crash_500ft", "zero"),
    "bw_modeshr": ("scld__bw_modeshr", "null"),
    "rail_volume": ("scld__rail_volume", "zero"),
    "avg_slope": ("scld__avg_slope", "zero"),
    "wiki_probarea_qtr": ("scld__wiki_probarea_qtr", "zero"),
    "popden_2014": ("scld__popden_2014", "null"),
    "popden_2040": ("scld__popden_2040", "null"),
    "empden_2014": ("scld__empden_2014", "null"),
    "empden_2040": ("scld__empden_2040", "null"),
    "trans_riders_qtr": ("scld_trans_riders_qtr", "zero"),
    "schools_half": ("scld__schools_half", "zero"),
    "colleges_half": ("scld__colleges_half", "zero"),
    "reg_parks_half": ("scld__regional_parks_half_mile", "zero"),
    "wiki_new_xing_qtr": ("scld__wiki_new_xing_qtr", "zero"),
    "ex_local_miles_qtr": ("scld__ex_local_miles_qtr", "zero"),
    "pl_local_miles_qtr": ("scld__pl_local_miles_qtr", "zero"),
    "ex_reg_fac_half": ("scld__ex_reg_fac_half", "zero"),
    "pl_reg_fac_half": ("scld__pl_reg_fac_half", "zero"),
    "expl_reg_miles_half": ("scld_expl_reg_miles_half", "zero"),
    "rbtn_corridor": ("scld_rbtn_corridor", "pass"),
    "rbtn_alignment": ("scld_rbtn_alignment", "pass"),
    "dist2ex_crossing_m": ("scld__dist2ex_crossing_m", "null"),
    "age_under_15_pct": ("scld__age_under_15_pct", "null"),
    "age_65_plus_pct": ("scld__age_65_plus_pct", "null"),
    "zero_car_pct": ("scld__zero_car_pct", "null"),
    "ppl_of_color_pct": ("scld__ppl_of_color_pct", "null"),
    "wiki_women_qtr": ("scld__wiki_women_qtr", "zero"),
    "wiki_pplofcolor_qtr": ("scld__wiki_pplofcolor_qtr", "zero"),
}

# Members, divisors and weights of the four factors (fixed values).
FACTORS = (
    Factor(
        "connectivity",
        (
            "scld__pl_local_miles_qtr",
            "scld__ex_local_miles_qtr",
            "scld_expl_reg_miles_half",
            "scld_rbtn_corridor",
            "scld_rbtn_alignment",
            "scld__dist2ex_crossing_m",
        ),
        6,
        4.825,
        ("scld__dist2ex_crossing_m",),
    ),
    Factor(
        "demand",
        (
            "scld__popden_2040",
            "scld__empden_2040",
            "scld_trans_riders_qtr",
            "scld__schools_half",
            "scld__colleges_half",
            "scld__regional_parks_half_mile",
            "scld__wiki_new_xing_qtr",
        ),
        7,
        2.425,
    ),
    Factor(
        "safety",
        (
            "scld__bkpd_crash_500ft",
            "scld__bw_modeshr",
            "scld__popden_2014",
            "scld__empden_2014",
            "scld__wiki_probarea_qtr",
        ),
        5,
        1.525,
    ),
    Factor(
        "equity",
        (
            "acp",
            "acp50",
            "scld__age_under_15_pct",
            "scld__age_65_plus_pct",
            "scld__zero_car_pct",
            "scld__ppl_of_color_pct",
            "scld__wiki_women_qtr",
            "scld__wiki_pplofcolor_qtr",
        ),
        8,
        1.225,
    ),
)


def column_maxima(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row with the maximum of each column."""
    return df.agg(*[F.max(c).alias(c) for c in cols])


def scale(df: DataFrame, columns: dict[str, tuple[str, str]], target: float = 10.0) -> DataFrame:
    """Add scaled columns (see SCALES). All maxima come from one aggregate, read as a scalar subquery."""
    stretched = [c for c, (_, mode) in columns.items() if mode != "pass"]
    maxima = column_maxima(df, stretched).select(F.struct(*stretched).alias("m")).scalar() if stretched else None

    def scaled(c: str, mode: str) -> Column:
        value = F.col(c).cast("double")
        if mode == "pass":
            return value
        part = value * F.try_divide(F.lit(float(target)), maxima[c].cast("double"))
        return F.when(value == 0, F.lit(0.0)).otherwise(part) if mode == "zero" else part

    return df.withColumns({out: scaled(c, mode) for c, (out, mode) in columns.items()})


def factor_scores(df: DataFrame, factors: tuple[Factor, ...] = FACTORS) -> DataFrame:
    """Add <factor>_raw, the mean of its members, and <factor>_score, weighted. A NULL member makes both
    NULL unless the factor counts that member as 0."""
    for f in factors:
        members = [
            F.coalesce(F.col(m).cast("double"), F.lit(0.0)) if m in f.zero_if_null else F.col(m).cast("double")
            for m in f.members
        ]
        df = df.withColumn(f"{f.name}_raw", reduce(add, members) / F.lit(f.divisor))
        df = df.withColumn(f"{f.name}_score", F.col(f"{f.name}_raw") * F.lit(f.weight))
    return df


def priority_score(df: DataFrame, factors: tuple[Factor, ...] = FACTORS) -> DataFrame:
    """Add priority_raw, the sum of the factor scores, and priority_score, that stretched to 100."""
    df = df.withColumn("priority_raw", reduce(add, [F.col(f"{f.name}_score") for f in factors]))
    top = df.agg(F.max("priority_raw")).scalar()
    return df.withColumn("priority_score", F.col("priority_raw") * F.try_divide(F.lit(100.0), top))


def score(df: DataFrame, scales=None, factors: tuple[Factor, ...] = FACTORS) -> DataFrame:
    """Scale, factor scores and priority score of the given rows with their own maxima."""
    return priority_score(factor_scores(scale(df, SCALES if scales is None else scales), factors), factors)


def quartile_score(df: DataFrame, column: str, name: str) -> DataFrame:
    """2.5, 5, 7.5 or 10 by quartile of the positive values; 0 for 0, NULL for NULL."""
    q1, q2, q3, _ = quartiles(df, column)
    v = F.col(column)
    graded = F.when(v < q1, 2.5).when(v < q2, 5.0).when(v < q3, 7.5).otherwise(10.0) if q1 is not None else F.lit(None)
    return df.withColumn(name, F.when(v > 0, graded).when(v == 0, F.lit(0.0)).cast("double"))


def tier_score(df: DataFrame, tier: str, name: str) -> DataFrame:
    """Tier 1 gives 10, tier 2 gives 5, no tier gives 0."""
    return df.withColumn(name, F.when(F.col(tier) == 1, 10).when(F.col(tier) == 2, 5).otherwise(0))

"""Joins that stay balanced when one key holds much of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is heavy when it holds more than 1/SHARE of all rows, so there are at most SHARE heavy keys and
# their list can always be broadcast. Below FLOOR rows a key is never heavy. In joins of two big sides the work
# counts instead: FLOOR * FLOOR pairs are as many as one task gets.
SHARE = 8192
FLOOR = 20_000


def heavy_keys(df: DataFrame, on: list[str], floor: int = FLOOR, parts: str = "_parts") -> DataFrame:
    """(on..., parts): the heavy keys of df and into how many parts to split each."""
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    cap = F.greatest(F.lit(floor).cast("double"), total / F.lit(float(SHARE)))
    return counts.filter(F.col("_n") > cap).select(*on, F.ceil(F.col("_n") / cap).cast("int").alias(parts))


def spread_join(
    left: DataFrame, right: DataFrame, on: list[str], how: str, split_by: str, floor: int = FLOOR
) -> DataFrame:
    """Equi join (NULL equals NULL) of a big left side with a right side that holds each key once.

    Rows of a heavy left key are split into parts by a hash of `split_by` (an id of the left rows) and the
    right row of that key is repeated once per part, so no task gets a whole heavy key. The right side is never
    broadcast: Spark guesses its size from that of compressed files, and it may hold a row for every row of the left.
    """
    heavy = F.broadcast(heavy_keys(left, on, floor))
    extra = [c for c in right.columns if c not in on]
    hl, hr = heavy.alias("hl"), heavy.alias("hr")
    lft = left.alias("l").join(hl, _same("l", "hl", on), "left").select(
        "l.*", F.pmod(F.xxhash64(F.col(f"l.{split_by}")), F.coalesce("_parts", F.lit(1))).cast("int").alias("_part")
    )
    rgt = right.alias("r").join(hr, _same("r", "hr", on), "left").select(
        "r.*", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)).alias("_part")
    )
    same = _same("a", "b", on) & (F.col("a._part") == F.col("b._part"))
    joined = lft.alias("a").join(rgt.alias("b").hint("merge"), same, how)
    keep = [F.col(f"a.{c}") for c in left.columns]
    if how in ("left_semi", "left_anti"):
        return joined.select(*left.columns)
    return joined.select(*keep, *[F.col(f"b.{c}") for c in extra])


def _same(a: str, b: str, on: list[str]) -> Column:
    out = F.lit(True)
    for c in on:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def split_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    left_id: list[str],
    right_id: list[str],
    extra: Column | None = None,
    floor: int = FLOOR,
    parts: bool = False,
) -> DataFrame:
    """Inner equi join where keys may be heavy on either side or both. Columns other than `on` must differ. With
    `parts` the result has _pl and _pr as well: rows with the same `on`, _pl and _pr come from one task, so grouping
    by these and more needs no other shuffle.

    A key whose pairs are more than floor * floor is cut into blocks of at most floor rows of either side: left rows
    into _kl parts, right rows into _kr parts, each part repeated against all parts of the other side, so every pair
    still meets exactly once, and no part has more than about floor * floor pairs to look at, however large the
    tables are. The list of such keys is as long as there are crowds; whether it is broadcast is left to its size.
    """
    seen = left.select(*on, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(*on, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    keys = seen.groupBy(*on).agg(F.sum("_l").alias("_nl"), F.sum("_r").alias("_nr"))
    heavy = keys.filter(F.col("_nl").cast("double") * F.col("_nr") > float(floor) * floor).select(
        *on, F.ceil(F.col("_nl") / floor).cast("int").alias("_kl"), F.ceil(F.col("_nr") / floor).cast("int").alias("_kr")
    )

    def own(ident: list[str], count: str) -> Column:
        return F.pmod(F.xxhash64(*ident), F.coalesce(count, F.lit(1))).cast("int")

    def each(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.coalesce(count, F.lit(1)) - 1))

    cut_left = left.join(heavy, on, "left").select(
        *left.columns, own(left_id, "_kl").alias("_pl"), each("_kr").alias("_pr")
    )
    cut_right = right.join(heavy, on, "left").select(
        *right.columns, own(right_id, "_kr").alias("_pr"), each("_kl").alias("_pl")
    )
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in [*on, "_pl", "_pr"]]
    if extra is not None:
        same.append(extra)
    joined = cut_left.alias("l").join(cut_right.alias("r").hint("merge"), same)
    more = ["l._pl", "l._pr"] if parts else []
    return joined.select(*[f"l.{c}" for c in left.columns], *[f"r.{c}" for c in right.columns if c not in on], *more)

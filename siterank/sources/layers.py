"""Readers and writers for point, line, polygon and raster layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_layer(
    spark: SparkSession, path: str, schema: T.StructType | None = None, spread: bool = False
) -> DataFrame:
    """Read a Parquet layer; with a schema, the columns it names must exist with these types.

    spread=True puts a layer of fewer files than the cluster has cores on all of them. It is meant for
    sites, lines and areas, since one row of them can cause much work in a spatial join.
    """
    df = spark.read.parquet(path)
    if schema is not None:
        types = {f.name: f.dataType for f in df.schema}
        wrong = [f.name for f in schema if types.get(f.name) != f.dataType]
        if wrong:
            raise ValueError(f"{path}: columns missing or of another type: {', '.join(wrong)}")
        df = df.select([f.name for f in schema])
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if spread and len(df.inputFiles()) < cores else df


def point_rows(df: DataFrame, points: str = "points") -> DataFrame:
    """One row per member of a multipoint column array<struct<x,y>>."""
    rest = [c for c in df.columns if c != points]
    return df.select(*rest, F.explode(points).alias("_p")).select(*rest, F.col("_p.x"), F.col("_p.y"))


def line_segments(df: DataFrame, line_id: str = "line_id", vertices: str = "vertices") -> DataFrame:
    """One row per segment of a vertex list array<struct<x,y>>; other columns are repeated."""
    rest = [F.col(c) for c in df.columns if c not in (line_id, vertices)]
    v = F.col(vertices)
    pairs = F.zip_with(
        F.slice(v, F.lit(1), F.greatest(F.size(v) - 1, F.lit(0))),
        F.slice(v, F.lit(2), F.greatest(F.size(v) - 1, F.lit(0))),
        lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")),
    )
    return df.select(F.col(line_id).alias("line_id"), *rest, F.posexplode(pairs).alias("seg_no", "_s")).select(
        "line_id", "seg_no", "_s.x1", "_s.y1", "_s.x2", "_s.y2", *[c for c in df.columns if c not in (line_id, vertices)]
    )


def raster_cells(
    df: DataFrame, col: Column, row: Column, value: Column, size: float, x0: float = 0.0, y0: float = 0.0
) -> DataFrame:
    """A raster as cell centres (x, y, value): col and row count from the corner (x0, y0)."""
    return df.select(
        (F.lit(x0) + (col + F.lit(0.5)) * F.lit(float(size))).alias("x"),
        (F.lit(y0) + (row + F.lit(0.5)) * F.lit(float(size))).alias("y"),
        value.cast("double").alias("value"),
    )


def write_sites(df: DataFrame, path: str, by: str = "county", rows: int = 5_000_000) -> None:
    """Write the result layer, one folder per region and at most `rows` rows to a file. A region's rows are counted
    and dealt to as many writers as such files are needed."""
    parts = df.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / F.lit(rows)).alias("_parts"))
    same = F.col(f"d.{by}").eqNullSafe(F.col(f"p.{by}"))
    spread = df.alias("d").join(parts.alias("p"), same).select("d.*", F.pmod(F.xxhash64("d.site_id"), F.col("_parts")).alias("_part"))
    dealt = spread.repartition(by, "_part").drop("_part")
    dealt.write.mode("overwrite").option("maxRecordsPerFile", rows).partitionBy(by).parquet(path)

"""Skew handling, ranks, scales, clusters and row edits on small inputs."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siterank.operators import clusters, grid, ranking, roster, scaling, skew, within
from siterank.sources import read_layer, staging


def crowd(spark, n, seed, prefix):
    """A third of the rows at one place, a third in one small spot, the rest spread."""
    random.seed(seed)
    rows = []
    for i in range(n):
        if i % 3 == 0:
            x, y = 1000.0, 1000.0
        elif i % 3 == 1:
            x, y = 990.0 + random.random() * 20, 990.0 + random.random() * 20
        else:
            x, y = random.random() * 4000, random.random() * 4000
        rows.append((i, x, y))
    return spark.createDataFrame(rows, f"{prefix} long, x double, y double")


@pytest.mark.parametrize("broadcast,floor", [(True, 20_000), (False, 20_000), (False, 7)])
def test_every_pair_meets_once_however_cells_are_split(spark, broadcast, floor):
    sites, feats = crowd(spark, 400, 1, "site_id"), crowd(spark, 300, 2, "id")
    boxed = grid.with_box(feats.select("id", F.col("x").alias("px"), F.col("y").alias("py")), "point", 150.0)
    pairs = grid.candidates(sites, boxed, ["site_id"], ["id"], broadcast=broadcast, floor=floor).filter(within.is_near("point"))
    got = sorted((r.site_id, r.id) for r in pairs.select("site_id", "id").collect())
    a, b = sites.collect(), feats.collect()
    assert got == sorted(
        (s.site_id, p.id) for s in a for p in b if (s.x - p.x) ** 2 + (s.y - p.y) ** 2 <= 150.0 * 150.0
    )


def test_spread_join_splits_heavy_and_null_keys(spark):
    left = spark.createDataFrame([(i, None if i % 3 == 0 else i % 5 if i % 3 == 1 else 1) for i in range(600)], "id long, k int")
    right = spark.createDataFrame([(None, "none"), (0, "a"), (1, "b"), (2, "c")], "k int, v string")
    parts = skew.heavy_keys(left, ["k"], floor=50).collect()
    assert {r["k"]: r["_parts"] for r in parts}[1] > 1
    got = {r.id: r.v for r in skew.spread_join(left, right, ["k"], "left", "id", floor=50).collect()}
    names = {None: "none", 0: "a", 1: "b", 2: "c"}
    assert got == {r.id: names.get(r.k) for r in left.collect()}
    gone = skew.spread_join(left, right, ["k"], "left_anti", "id", floor=50)
    assert {r.k for r in gone.collect()} == {3, 4}


def test_ranks_with_ties_nulls_and_one_big_group(spark):
    random.seed(4)
    rows = []
    for i in range(3000):
        score = None if i % 11 == 0 else 5.0 if i % 3 == 0 else float(random.randint(0, 500))
        rows.append((i, "Anoka" if i % 3 else random.choice(["Scott", "Elsewhere", None]), score))
    df = spark.createDataFrame(rows, "site_id long, county string, priority_score double")
    out = ranking.rank_by(ranking.rank_sites(df)).collect()
    assert len(out) == len(rows)

    def order(s):
        return (0, 0.0) if s is None else (1, -s)

    every = sorted(order(s) for _, _, s in rows)
    first = {}
    for i, o in enumerate(every):
        first.setdefault(o, i + 1)
    by_county = {}
    for c in ("Anoka", "Scott"):
        group = sorted(order(s) for _, k, s in rows if k == c)
        by_county[c] = {}
        for i, o in enumerate(group):
            by_county[c].setdefault(o, i + 1)
    for r in out:
        assert r.priority_rank == first[order(r.priority_score)]
        want = by_county[r.county][order(r.priority_score)] if r.county in by_county else None
        assert r.county_priority_rank == want


def test_county_id_keeps_long_ranks_apart(spark):
    df = spark.range(1200).select(
        F.col("id").alias("site_id"), F.lit("Dakota").alias("county"), F.lit(0.0).alias("x"), (-F.col("id")).cast("double").alias("y")
    )
    ids = {r.site_id: r.county_id for r in ranking.county_id(df).collect()}
    assert ids[0] == "D001" and ids[999] == "D1000" and len(set(ids.values())) == 1200


def test_quartiles_are_exact(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 0, None or 0, 1, 2, 3, 4, 10, 10]], "v double")
    assert ranking.quartiles(df, "v") == [2.25, 3.5, 8.5, 10.0]
    assert ranking.quartiles(df.filter("v < 0"), "v") == [None] * 4


def test_scales_of_an_all_zero_column(spark):
    df = spark.createDataFrame([(1, 0, 2.0), (2, 0, None), (3, None, 4.0)], "site_id long, a int, b double")
    out = scaling.scale(df, {"a": ("za", "zero"), "b": ("nb", "null")}).orderBy("site_id").collect()
    assert [(r.za, r.nb) for r in out] == [(0.0, 5.0), (0.0, None), (None, 10.0)]
    nulls = scaling.scale(df, {"a": ("na", "null")}).orderBy("site_id").collect()
    assert [r.na for r in nulls] == [None, None, None]


def test_null_feature_makes_the_score_null(spark):
    df = spark.createDataFrame([(1, 10.0, None), (2, 4.0, 2.0)], "site_id long, a double, b double")
    factors = (scaling.Factor("f", ("a", "b"), 2, 2.0), scaling.Factor("g", ("b",), 1, 1.0, ("b",)))
    out = {r.site_id: r for r in scaling.priority_score(scaling.factor_scores(df, factors), factors).collect()}
    assert (out[1].f_raw, out[1].g_raw, out[1].priority_score) == (None, 0.0, None)
    assert (out[2].f_score, out[2].priority_score) == (6.0, 100.0)


def test_conflicting_duplicates(spark):
    df = spark.createDataFrame(
        [(1, 0.0, 0.0, 0), (2, 0.0, 0.0, 1), (3, 1.0, 0.0, 0), (4, 1.0, 0.0, 0), (5, 2.0, 0.0, None), (6, 2.0, 0.0, 0)],
        "id long, x double, y double, ptstat int",
    )
    assert {r.id for r in roster.conflicting_duplicates(df, "ptstat").collect()} == {2, 3, 4, 5, 6}


def test_empty_exclusion_layer_keeps_all(spark):
    sites = crowd(spark, 30, 1, "site_id")
    assert within.exclude_within(sites, sites.limit(0), 100.0).count() == 30
    assert within.keep_within(sites, sites.limit(0), 100.0).count() == 0


def lines_of(spark, rows):
    return spark.createDataFrame(
        [(i, 0, s, *[float(v) for v in r]) for i, s, *r in rows],
        "line_id long, seg_no int, status string, x1 double, y1 double, x2 double, y2 double",
    )


def cluster_of(df):
    return {r.line_id: r.cluster_id for r in clusters.cluster_lines(df).collect()}


def test_clusters_chain_star_copies_and_status(spark):
    chain = [(100 + i, "a", i * 10, 0, i * 10 + 10, 0) for i in range(30)]  # end to end
    star = [(200 + i, "a", 500, 500, 500 + i, 400) for i in range(1, 20)]  # one shared vertex
    copies = [(300 + i, "a", 0, 900, 50, 900) for i in range(40)]
    cross = [(401, "a", 700, 0, 800, 100), (402, "a", 700, 100, 800, 0), (403, "a", 750, 50, 750, 300)]
    other = [(501, "b", 700, 0, 800, 100)]
    alone = [(601, "a", 5000, 5000, 6000, 6000)]
    rows = chain + star + copies + cross + other + alone
    want = {r[0]: (r[0] // 100) * 100 + (1 if r[0] // 100 in (2, 4, 5, 6) else 0) for r in rows}
    assert cluster_of(lines_of(spark, rows)) == want
    random.seed(1)
    random.shuffle(rows)
    assert cluster_of(lines_of(spark, rows)) == want


def test_layer_schema_is_checked(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    good = T.StructType([T.StructField("id", T.LongType())])
    assert read_layer(spark, str(tmp_path / "t"), good).count() == 3
    with pytest.raises(ValueError, match="name"):
        read_layer(spark, str(tmp_path / "t"), T.StructType([T.StructField("name", T.StringType())]))


class _Conf:
    def __init__(self, folder):
        self.folder = folder

    def get(self, key, default=None):
        return self.folder or default


class _Session:
    def __init__(self, folder, master):
        self.conf = _Conf(folder)
        self.sparkContext = type("Context", (), {"master": master})


def test_staged_tables_go_to_the_shared_folder():
    assert staging.stage_root(_Session("hdfs://shared/", "yarn")) == "hdfs://shared"
    own = staging.stage_root(_Session(None, "local[2]"))
    assert own == staging.stage_root(_Session(None, "local[2]"))
    with pytest.raises(ValueError):
        staging.stage_root(_Session(None, "yarn"))

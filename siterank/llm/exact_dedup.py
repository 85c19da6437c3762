"""Exact duplicates by an extendible-hash index on shared files, in DataFrame operations only.

A key is the 64-bit hash of the text without white space. Copies are added up before anything is shuffled, and
that grouping is on the text itself, so bytes are compared and not only hashes. One narrow entry per distinct
text goes to the index: Parquet folders `depth=d/bucket=b`, where a bucket holds the keys whose first d bits are
b. A bucket with more than `capacity` entries is split into two of one more bit, in a folder of the doubled
directory; one whose entries all share a key cannot be split and stays a chain. Texts that share a key but not
their bytes are links of one chain, told apart by their SHA-256.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siterank.llm.files import new_folder
from siterank.sources.staging import stage

BLANK = r"[\x20\x09-\x0D]+"
CAPACITY = 1_000_000
KEY_BITS = 64
FIRST_DEPTH = 4


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text", key_bits: int = KEY_BITS) -> DataFrame:
    """(_id, _chars, _bare, _key) of every document; NULL text counts as empty. A row's key fills the upper
    `key_bits` bits of a long, fewer bits than 64 serve to provoke collisions in tests."""
    whole = F.coalesce(F.col(text), F.lit(""))
    out = docs.select(
        F.col(key).alias("_id"), F.char_length(whole).alias("_chars"), F.regexp_replace(whole, BLANK, "").alias("_bare")
    )
    lower = 64 - key_bits
    return out.withColumn("_key", F.shiftleft(F.shiftrightunsigned(F.xxhash64("_bare"), lower), lower))


def _bucket(depth: int):
    return F.shiftrightunsigned(F.col("_key"), 64 - depth).alias("bucket")


def build_index(rows: DataFrame, capacity: int = CAPACITY, first_depth: int | None = None) -> DataFrame:
    """The entries (_key, _sha, _chars, _first, _n, depth, bucket) of keyed rows, read from the index files.

    An entry stands for all rows with one text and one length before white space went; _first is the smallest
    id among them. Buckets are split until each holds at most `capacity` entries or a single key.
    """
    spark = rows.sparkSession
    if first_depth is None:
        first_depth = max(FIRST_DEPTH, ceil(log2(max(1, rows.count()) / capacity)))
    root = new_folder(spark, "hash-index")
    level = (
        rows.groupBy("_key", "_bare", "_chars")
        .agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .select("_key", F.sha2("_bare", 256).alias("_sha"), "_chars", "_first", "_n")
    )
    leaves, depth = [], first_depth
    while True:
        path = f"{root}/depth={depth}"
        level.withColumn("bucket", _bucket(depth)).repartition("bucket").write.partitionBy("bucket").parquet(path)
        schema = f"_key long, _sha string, _chars int, _first {rows.schema['_id'].dataType.simpleString()}, _n long, bucket long"
        level = spark.read.schema(schema).parquet(path)
        full = stage(
            level.groupBy("bucket")
            .agg(F.count(F.lit(1)).alias("n"), F.min("_key").alias("low"), F.max("_key").alias("high"))
            .filter((F.col("n") > capacity) & (F.col("low") < F.col("high")))
            .select("bucket"),
            "overfull",
        )
        whole = full.isEmpty()
        leaf = level if whole else level.join(full, "bucket", "left_anti")
        leaves.append(leaf.withColumn("depth", F.lit(depth)))
        if whole:
            break
        level, depth = level.join(full, "bucket", "left_semi").drop("bucket"), depth + 1
    out = leaves[0]
    for leaf in leaves[1:]:
        out = out.unionByName(leaf)
    return out


def resolve(index: DataFrame) -> DataFrame:
    """(_key, _sha, keep_id, keep_chars, group_size, chain): one row per distinct text. Of the rows with an id the one
    with the most characters stays, then the smallest id; chain counts the different texts under its key."""
    best = F.max(F.struct(F.col("_first").isNotNull(), F.col("_chars"), (-F.col("_first")).alias("_low")))
    groups = index.groupBy("depth", "bucket", "_key", "_sha").agg(best.alias("_best"), F.sum("_n").alias("group_size"))
    chains = groups.groupBy("_key").agg(F.count(F.lit(1)).alias("chain")).filter("chain > 1")
    return groups.join(chains, "_key", "left").select(
        "_key", "_sha", (-F.col("_best._low")).alias("keep_id"), F.col("_best._chars").alias("keep_chars"),
        "group_size", F.coalesce("chain", F.lit(1)).alias("chain"),
    )


def exact_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, key_bits: int = KEY_BITS,
    first_depth: int | None = None,
) -> DataFrame:
    """One row per document: the key column, keep_id, group_size, kept, text_sha256, chars, keep_chars, chain.

    Texts are equal when they are identical without white space; NULL counts as empty, so empty, blank and NULL
    texts are one group. The row with the most code points stays, then the smallest id. Rows repeated with the
    same id all say kept when their id stays (drop_copies leaves one of them). A NULL id stays only in a group
    that has no other. Empty tables give no rows; other columns of docs are not looked at.
    """
    rows = keyed(docs, key, text, key_bits)
    groups = resolve(build_index(rows, capacity, first_depth))
    narrow = rows.select("_id", "_chars", "_key", F.sha2("_bare", 256).alias("_sha"))
    # a key with very many rows lies on the left only: adaptive execution deals its rows to several tasks
    return narrow.join(groups, ["_key", "_sha"]).select(
        F.col("_id").alias(key), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("_sha").alias("text_sha256"), F.col("_chars").alias("chars"), "keep_chars", "chain",
    )


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without the rows that exact_groups drops; all columns and their order stay. Of rows that repeat the
    same id and length in one group, one stays."""
    keep = exact_groups(docs, key, text, **options).filter(F.col("kept") & (F.col("chars") == F.col("keep_chars")))
    whole = keep.groupBy(F.col(key).alias("_id"), F.col("text_sha256").alias("_sha")).agg(
        F.count(F.lit(1)).alias("__rows"), F.max("chars").alias("_chars")
    )
    bare = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), BLANK, "")
    mine = docs.withColumns({
        "__sha": F.sha2(bare, 256), "__chars": F.char_length(F.coalesce(F.col(text), F.lit("")))
    })
    same = (
        F.col(f"d.{key}").eqNullSafe(F.col("k._id")) & (F.col("d.__sha") == F.col("k._sha"))
        & (F.col("d.__chars") == F.col("k._chars"))
    )
    found = mine.alias("d").join(whole.alias("k"), same).select("d.*", "k.__rows")
    once = found.filter("__rows = 1").select(*docs.columns)
    repeated = found.filter("__rows > 1").dropDuplicates([key, "__sha"]).select(*docs.columns)
    return once.unionByName(repeated)

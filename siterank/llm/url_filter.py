"""URL verdicts: host and path rules first, then a Bloom filter cascade over the corpus's own hosts.

A cascade encodes which keys of a complete, known universe are listed. Level 0 is a Bloom filter of the listed
keys; level 1 holds the unlisted keys that pass level 0 by mistake, level 2 the listed keys that pass level 1, and
so on until no mistake is left. Within the universe the answer is exact, and rows are asked in place, without a
join. The universe is cut into shards by hash; a shard's cascade is built in one task and lies in the shared
folder, and a task that asks holds a bounded number of shards.
"""

from __future__ import annotations

from collections import OrderedDict
from math import ceil, log, sqrt

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siterank.llm.files import new_folder, store_of

SHARD_KEYS = 500_000
HELD_BYTES = 64 << 20  # of shards that a Python worker keeps
MOST_LEVELS = 60
LEVELS = "shard long, level int, size long, hashes int, bits binary, said array<string>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z in lower case; path: then up to ? # or the end.
    Both are empty where url is NULL or has no ://."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    whole = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(whole, pattern, 1), UPPER, LOWER), F.regexp_extract(whole, pattern, 2)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, its action) of the longest (host, path, action) that fits, else NULL. A rule fits its host and all
    subdomains if the path starts with the rule's."""
    name = verdict = F.lit(None).cast("string")
    for domain, start, action in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]))):
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(start)
        name, verdict = F.when(fits, domain + start).otherwise(name), F.when(fits, action).otherwise(verdict)
    return name, verdict


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _places(h1: np.ndarray, h2: np.ndarray, level: int, size: int, hashes: int) -> np.ndarray:
    salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)
    a, b = _mix(h1 ^ salt), _mix(h2 + salt) | np.uint64(1)
    return (a[:, None] + np.arange(hashes, dtype=np.uint64) * b[:, None]) % np.uint64(size)


def _passes(h1: np.ndarray, h2: np.ndarray, level: int, size: int, hashes: int, bits: np.ndarray) -> np.ndarray:
    at = _places(h1, h2, level, size, hashes)
    return ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def build_levels(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray, keys: np.ndarray) -> list[tuple]:
    """(level, size, hashes, bits, said) of one cascade. Keys that no number of levels tells apart, which takes two
    equal 128-bit hashes, are spelled out in `said`."""
    out: list[tuple] = []
    inside, outside = np.flatnonzero(listed), np.flatnonzero(~listed)
    while len(inside):
        level = len(out)
        if level >= MOST_LEVELS:
            said = keys[inside if level % 2 == 0 else outside]
            return [*out, (-1, 0, 0, b"", list(said))]
        rate = min(0.5, len(inside) * sqrt(0.5) / max(1, len(outside))) if level == 0 else 0.5
        size = max(64, ceil(len(inside) * -log(rate) / log(2) ** 2))
        hashes = max(1, round(-log(rate) / log(2)))
        bits = np.zeros(-(-size // 8), np.uint8)
        at = _places(h1[inside], h2[inside], level, size, hashes).ravel()
        np.bitwise_or.at(bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        out.append((level, size, hashes, bits.tobytes(), None))
        wrong = outside[_passes(h1[outside], h2[outside], level, size, hashes, bits)]
        inside, outside = wrong, inside
    return out


class Cascade:
    """A cascade over shards in the folder of `path`."""

    def __init__(self, path: str, shards: int):
        self.path, self.shards = path, shards

    def holds(self, key: Column) -> Column:
        """Is a key of the universe listed? Keys outside of the universe get either answer."""
        path = self.path

        @F.pandas_udf("boolean")
        def ask(shard: pd.Series, h1: pd.Series, h2: pd.Series, key: pd.Series) -> pd.Series:
            out = np.zeros(len(shard), bool)
            a, b, of = h1.to_numpy().view(np.uint64), h2.to_numpy().view(np.uint64), shard.to_numpy()
            for s in np.unique(of):
                rows = np.flatnonzero(of == s)
                levels, said = _shard(path, int(s))
                open_, answer = np.arange(len(rows)), np.zeros(len(rows), bool)
                for level, size, hashes, bits in levels:
                    open_ = open_[_passes(a[rows[open_]], b[rows[open_]], level, size, hashes, bits)]
                    answer[open_] = level % 2 == 0
                if said:
                    answer |= key.iloc[rows].isin(said).to_numpy()
                out[rows] = answer
            return pd.Series(out)

        return ask(*_hashes(key, self.shards), key)


_held: OrderedDict[tuple[str, int], tuple] = OrderedDict()


def _shard(path: str, shard: int) -> tuple[list[tuple], set[str]]:
    """The levels of a shard, read from the shared folder; the longest unused ones go when too much is held."""
    if (path, shard) not in _held:
        store, inner = store_of(path)
        rows = pq.read_table(inner, filesystem=store, filters=[("shard", "=", shard)]).to_pylist()
        levels = sorted((r["level"], r["size"], r["hashes"], np.frombuffer(r["bits"], np.uint8)) for r in rows if r["level"] >= 0)
        _held[path, shard] = levels, {k for r in rows if r["level"] < 0 for k in r["said"]}
        while len(_held) > 1 and sum(len(x[3]) for v in _held.values() for x in v[0]) > HELD_BYTES:
            _held.popitem(last=False)
    _held.move_to_end((path, shard))
    return _held[path, shard]


def _hashes(key: Column, shards: int) -> tuple[Column, Column, Column]:
    return F.pmod(F.xxhash64(key, F.lit(2)), F.lit(shards)), F.xxhash64(key), F.xxhash64(key, F.lit(1))


def build_cascade(keys: DataFrame, key: str, listed: Column, shard_keys: int = SHARD_KEYS) -> Cascade:
    """A cascade of all distinct keys of a table; a key is listed if any of its rows is. NULL keys are left out."""
    spark = keys.sparkSession
    universe = (
        keys.select(F.col(key).alias("key"), listed.alias("listed"))
        .filter(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.max(F.coalesce("listed", F.lit(False))).alias("listed"))
    )
    shards = max(1, -(-universe.count() // shard_keys))
    cut = universe.select("key", "listed", *(c.alias(n) for c, n in zip(_hashes(F.col("key"), shards), ("shard", "h1", "h2"))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        levels = build_levels(
            pdf.h1.to_numpy().view(np.uint64), pdf.h2.to_numpy().view(np.uint64), pdf.listed.to_numpy(bool), pdf.key.to_numpy()
        )
        out = pd.DataFrame(levels, columns=["level", "size", "hashes", "bits", "said"])
        out.insert(0, "shard", pdf.shard.iloc[0] if len(pdf) else 0)
        return out

    path = new_folder(spark, "cascade")
    cut.groupBy("shard").applyInPandas(build, LEVELS).write.parquet(path)
    return Cascade(path, shards)


def judge_urls(urls: DataFrame, rules: list[tuple[str, str, str]], listed, url: str = "url") -> DataFrame:
    """urls with host, path, rule and verdict (allow or block). `listed` makes from a host Column whether it is on
    the list; the cascade is built over all hosts of the table. A rule's action wins over the list.

    NULL urls and urls without :// have the empty host, which is judged like any other. Repeated rows are judged
    each; own columns named host, path, rule or verdict are replaced.
    """
    host, path = host_and_path(F.col(url))
    cut = urls.withColumns({"host": host, "path": path})
    cascade = build_cascade(cut.select("host"), "host", listed(F.col("host")))
    rule, action = matching_rule(F.col("host"), F.col("path"), rules)
    block = F.when(cascade.holds(F.col("host")), "block").otherwise("allow")
    return cut.withColumns({"rule": rule, "verdict": F.coalesce(action, block)})

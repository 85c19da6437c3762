"""Language identification by compression.

For every language a raw-content zstandard dictionary is made from training text. A text is compressed with each;
the dictionary that leaves the fewest bytes names the language. Where the best two are nearly alike the answer is
marked as not accepted.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siterank.llm.files import small_batches

DICTIONARY_BYTES = 64 << 10
ROWS_PER_LANGUAGE = 128  # training texts that a dictionary is made of, in the order of their hash
LEVEL = 6
PIECE = 4096  # long texts are compressed in pieces of this many bytes, so that the dictionary counts throughout
MARGIN = 0.01  # of the smallest size, by which the second must be larger
SCALE = 8.0  # bytes by which a size must be larger for its share to fall by e


def letters(text: Column) -> Column:
    """Lower-case letters, with one space for everything between."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")


def train(rows: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> list[tuple[str, bytes]]:
    """(language, dictionary) for every non-NULL language, the one with the most rows first. A dictionary is made of
    ROWS_PER_LANGUAGE different texts with a letter, or all there are, in the order of their hash; each gives a piece
    of the same length, DICTIONARY_BYTES in all, from a place that its hash names. No more than these pieces reach
    the driver, however often a text or an id comes again; ids play no part."""
    known = rows.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(lang).alias("lang"), F.col(text).alias("t"), F.xxhash64(F.col(text)).alias("hash")
    )
    each = known.groupBy("lang", "hash").agg(F.count(F.lit(1)).alias("rows"))
    counts = each.groupBy("lang").agg(F.sum("rows").alias("n"), F.count(F.lit(1)).alias("texts"))
    by_hash = Window.partitionBy("lang").orderBy("hash")
    chosen = each.withColumn("rank", F.row_number().over(by_hash)).filter(F.col("rank") <= ROWS_PER_LANGUAGE)
    share = F.floor(F.lit(DICTIONARY_BYTES) / F.least("texts", F.lit(ROWS_PER_LANGUAGE))).cast("int")
    chosen = chosen.join(counts.select("lang", share.alias("share")), "lang").select("lang", "hash", "share")
    plain = known.join(F.broadcast(chosen), ["lang", "hash"]).withColumn("t", letters(F.col("t")))  # at most so many rows a language
    spare = F.greatest(F.char_length("t") - F.col("share"), F.lit(0)) + 1
    place = (F.pmod(F.xxhash64(F.lit("place"), "hash"), spare) + 1).cast("int")
    pieces = plain.select("lang", "hash", "share", F.substring("t", place, F.col("share")).alias("t")).dropDuplicates(["lang", "hash"]).collect()
    order = sorted(counts.collect(), key=lambda r: (-r["n"], r["lang"]))
    return [
        (name, b" ".join(r["t"].encode()[: r["share"]] for r in sorted(pieces, key=lambda r: r["hash"]) if r["lang"] == name)[:DICTIONARY_BYTES])
        for name in (r["lang"] for r in order)
    ]


def identify(
    docs: DataFrame, dictionaries: list[tuple[str, bytes]], key: str = "doc_id", text: str = "text", margin: float = MARGIN
) -> DataFrame:
    """(key, lang_pred, score, accepted) of every document, from its whole text.

    NULL texts and texts without a letter are `und` with score 0, not accepted, and so is everything if there are
    no dictionaries. Of equal sizes the language with more training rows wins. score is the best one's share of
    exp(-size / SCALE). Repeated rows are answered each; no other column is looked at.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packers = []
        for _, content in dictionaries:
            how = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, source_size=PIECE, dict_size=len(content), write_content_size=False, write_checksum=False, write_dict_id=False
            )
            prepared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            prepared.precompute_compress(compression_params=how)
            packers.append(zstandard.ZstdCompressor(dict_data=prepared, compression_params=how))
        for pdf in batches:
            rows = []
            for t in pdf["t"]:
                if t is None or not packers:
                    rows.append(("und", 0.0, False))
                    continue
                pieces = [t[at : at + PIECE] for at in range(0, len(t), PIECE)]
                sizes = [sum(len(p.compress(x)) for x in pieces) for p in packers]
                best, *others = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
                low = sizes[best]
                share = 1 / sum(exp(min(0.0, (low - s) / SCALE)) for s in sizes)
                rows.append((dictionaries[best][0], share, not others or sizes[others[0]] - low >= margin * low))
            out = pd.DataFrame(rows, columns=["lang_pred", "score", "accepted"])
            out.insert(0, key, pdf["k"].to_numpy())
            yield out

    said = F.when(F.col(text).rlike(r"\p{L}"), letters(F.col(text)).cast("binary"))
    return docs.select(F.col(key).alias("k"), said.alias("t")).mapInPandas(
        tell, f"{key} {kind}, lang_pred string, score double, accepted boolean"
    )

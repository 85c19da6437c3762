"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, repeated until it is used up. A document's virtual finish
time is the number of the source's words up to its end divided by the source's target, so at any virtual time all
sources have had the same share of their targets. One global range sort by that time gives the order of the mix, and
the running total of words in this order is cut at the budget.

A document that would keep its source past its target waits as packets of PACKET words, as a long message does on a
shared line: no source is further from its target than the packets that are under way when the budget ends.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siterank.llm.ranges import running
from siterank.sources.staging import stage

WORD = r"[^\x20\x09-\x0D]++"
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2  # words of the mix, and how often a document may be used, both by the words there are
PACKET = 128


def sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(_id, _source, _size): the number of words of every row; NULL and blank texts have none."""
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(key).alias("_id"), F.col(source).alias("_source"), words.alias("_size"))


@dataclass(frozen=True)
class Targets:
    """rows: (_source, _weight, _rank, _start, _all, _target), one for each source; _start counts the words of earlier
    sources. words: of all sources; open: the targets, added up, of sources that could give more than their target."""

    rows: DataFrame
    words: int
    budget: int
    sources: int
    open: float


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> Targets:
    """What each source gives to a mix of `share` times all words. Sources in order of code points, NULL last, weigh
    `weights` in turn. No target is above `most` times its source's words: the excess goes to the others by weight,
    until none is above. That is one level, target = weight x level, raised while sources drop out; each round is one
    sum over the table of sources, which is never collected."""
    totals = stage(sized.groupBy("_source").agg(F.sum("_size").alias("_all")), "sources")
    ranked = running(totals, [F.col("_source").asc_nulls_last()], "_all", "ranked-sources")
    weigh = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_row") % len(weights)).cast("int"))
    rows = stage(
        ranked.select("_source", F.col("_row").alias("_rank"), F.col("_before").alias("_start"), "_all", weigh.alias("_weight")), "weighed"
    )
    words, count, whole = rows.agg(F.sum("_all"), F.count(F.lit(1)), F.sum("_weight")).first()
    words = words or 0
    budget = min(words * share, float(words * most))
    cap = F.col("_all") * float(most)
    level, out = (budget / whole if whole else 0.0), -1
    while True:
        full = cap < F.col("_weight") * level
        n, used, left = rows.agg(
            F.count(F.when(full, 1)), F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("_weight")))
        ).first()
        if n <= out or not left:
            break
        level, out = (budget - (used or 0.0)) / left, n
    target = F.least(cap, F.col("_weight") * level)
    rows = rows.withColumn("_target", target)
    free = rows.agg(F.sum(F.when(F.col("_target") < cap, F.col("_target")))).first()[0] or 0.0
    return Targets(rows, words, int(budget), count, free)


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 0, packet: int = PACKET,
) -> tuple[DataFrame, DataFrame]:
    """(rows, entries). rows: _row, _id, _source, _size, _all (words of its source), _target (of its source) for every
    row of docs. entries: what the mix takes, _row, _round (0, 1, ...), _from (word of the document), _words, _finish
    (virtual time), _position (words of the mix before it); ordered by _position they are the mix.

    Each row is used at most `most` times, in rounds. Rows of a source are shuffled by the MD5 of seed and id, so
    reruns agree; rows with the same id, source and size are alike, and any of them may be the one that is used once
    more. A row without words is never used. NULL ids and sources are values of their own; an empty table gives empty
    tables; other columns of docs are not looked at. A single document may be cut: where the budget ends, between two
    packets of it or inside one.

    Until virtual time 1 the budget cannot end, so documents that finish by then are one entry each. It ends by
    1 + sources x packet / (targets of sources with words to spare), or all words are used; nothing that starts later
    is queued.
    """
    sized = stage(sizes(docs, key, text, source), "sizes")
    goal = targets(sized, weights, share, most)
    shuffle = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))).cast("binary")), 1, 16)
    dealt = sized.withColumn("_shuffle", shuffle)
    order = [F.col("_source").asc_nulls_last(), F.col("_shuffle"), F.col("_id").asc_nulls_first(), F.col("_size")]
    queued = running(dealt, order, "_size", "shuffled")
    rows = queued.alias("q").join(goal.rows.alias("s"), F.col("q._source").eqNullSafe(F.col("s._source"))).select(
        "q._row", "q._id", "q._source", "q._size", "s._all", "s._target", "s._rank", (F.col("q._before") - F.col("s._start")).alias("_ahead")
    )
    rows = stage(rows, "queues")
    last = 1 + goal.sources * packet / goal.open if goal.open else 1.0
    start = F.col("_round") * F.col("_all") + F.col("_ahead")
    turns = rows.filter("_size > 0").withColumn("_round", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(most - 1).cast("long"))))
    turns = turns.withColumn("_start", start).filter(F.col("_start") <= F.col("_target") * last)
    whole = F.col("_start") + F.col("_size") <= F.col("_target")
    step = F.when(whole, F.col("_size")).otherwise(F.lit(packet).cast("long"))
    packets = turns.withColumn("_step", step).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_size") - 1, F.col("_step"))))
    words = F.least(F.col("_step"), F.col("_size") - F.col("_from"))
    line = packets.select(
        F.col("_row").alias("_doc"), "_round", "_from", words.alias("_words"), "_rank",
        ((F.col("_start") + F.col("_from") + words) / F.col("_target")).alias("_finish"),
    )
    line = stage(line, "line")
    served = running(line, [F.col("_finish"), F.col("_rank"), F.col("_round"), F.col("_doc"), F.col("_from")], "_words", "mix")
    fits = served.withColumnRenamed("_before", "_position").filter(F.col("_position") < goal.budget)
    kept = F.least(F.col("_words"), F.lit(goal.budget).cast("long") - F.col("_position"))
    return rows.drop("_ahead", "_rank"), fits.select(F.col("_doc").alias("_row"), "_round", "_from", kept.alias("_words"), "_finish", "_position")


def shares(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """One row for each row of docs: the key column, size, source_size, target (of its source), taken (words that the
    mix takes of it, repeats counted) and source. See `mix` for the rules."""
    rows, entries = mix(docs, key, **options)
    taken = entries.groupBy("_row").agg(F.sum("_words").alias("_taken"))
    return rows.join(taken, "_row", "left").select(
        F.col("_id").alias(key), F.col("_size").alias("size"), F.col("_all").alias("source_size"), F.col("_target").alias("target"),
        F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"), F.col("_source").alias("source"),
    )

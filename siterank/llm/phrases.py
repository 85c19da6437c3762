"""Phrase collocation mining by vertical partitioning of suffix trees.

The words of a language's pieces form its string; a suffix starts at every word and is cut after LONGEST words. Words,
then pairs and triples of words are counted first, as hashes; a hash's count is never below that of any of them it
stands for, so a suffix may end where no frequent phrase can go on. Equal suffixes are added up: they are the leaves.

Word prefixes are grouped by a budget of leaves, as large as a task holds. A prefix with more leaves than the budget
is replaced by the prefixes one word longer. The prefixes are laid out in one order and each run of them within the
budget is a group; a group's tasks get its leaves only and build their subtrees, sorted leaf by leaf, independently
of each other. The count of a phrase is the total of the leaves below its node. Nodes above a replaced prefix lie in
several groups, whose totals are added.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siterank.llm.bitmap import SLOTS, bitmap, holds
from siterank.llm.files import slices, small_batches
from siterank.llm.ranges import running
from siterank.llm.tokens import _LOWER, bytes_of, mix, word_hashes
from siterank.sources.staging import stage

LONGEST, FREQUENT, TOP = 5, 100, 2000
BUDGET = 200_000  # leaves of a group
CHUNK = 2 << 20
BITS = 40  # of a hash, that tell words, pairs and triples apart when they are counted
HELD = 4 << 20  # hashes that a task counts at a time
BUCKET, LEAST_BITS, MOST_BITS = 1 << 20, 8, 24  # words of a bucket of hashes, about; how many bits may name a bucket

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True
_AGAIN = np.uint64(0x9E3779B97F4A7C15)


class _Words:
    """The words of some texts: where they are, their language, and which of them the next one follows."""

    def __init__(self, texts: pa.Array, langs: list[str]):
        self.data, starts = bytes_of(texts)
        word = ~_GAP[self.data]
        edge = np.zeros(len(self.data) + 1, bool)
        edge[starts] = True
        self.begin = np.flatnonzero(word & (~np.append(False, word[:-1]) | edge[:-1]))
        self.end = np.flatnonzero(word & (~np.append(word[1:], False) | edge[1:])) + 1
        text = np.searchsorted(starts, self.begin, side="right") - 1
        self.names, of = np.unique(np.array(langs, object), return_inverse=True)
        self.lang = of[text] if len(text) else np.zeros(0, np.int64)
        breaks = np.cumsum(_BREAK[self.data], dtype=np.int64)
        self.next = np.zeros(len(self.begin), bool)
        if len(self.begin):
            self.next[:-1] = (text[1:] == text[:-1]) & (breaks[self.begin[1:]] == breaks[self.begin[:-1]])

    @cached_property
    def hash(self) -> np.ndarray:
        """A hash of each word in its language."""
        if not len(self.begin):
            return np.zeros(0, np.uint64)
        own = np.array([int.from_bytes(hashlib.blake2b(n.encode(), digest_size=8).digest(), "little") for n in self.names], np.uint64)
        return mix(word_hashes(self.data, self.begin, self.end) ^ own[self.lang])

    def runs(self, words: int, at: np.ndarray) -> np.ndarray:
        """A hash of so many words from each place on."""
        out = self.hash[at]
        for k in range(1, words):
            out = mix(out * _AGAIN + self.hash[at + k])
        return out

    def strings(self, at: np.ndarray, length: np.ndarray) -> pa.Array:
        """Words at .. at + length - 1 in lower case, joined by single spaces."""
        sizes = self.end - self.begin
        first = np.cumsum(sizes + 1) - sizes - 1
        line = np.full(int((sizes + 1).sum()), 0x20, np.uint8)
        which = np.repeat(np.arange(len(sizes)), sizes)
        within = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        line[first[which] + within] = _LOWER[self.data[self.begin[which] + within]]
        low, high = first[at], first[at + length - 1] + sizes[at + length - 1]
        long = high - low
        ends = np.cumsum(long)
        spots = np.arange(int(long.sum())) + np.repeat(low - (ends - long), long)
        offsets = np.append(0, ends).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(line[spots])).cast(pa.string())


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64) % SLOTS + 1


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[_Words]:
    """The words of batches of (body, lang), of about CHUNK bytes at a time: longer texts are cut where pieces end."""
    for batch in batches:
        for part in slices(iter([batch]), "body", CHUNK):
            bodies, langs = part.column("body"), part.column("lang").to_pylist()
            if part.num_rows > 1 or not part.num_rows or len(bodies[0].as_buffer()) <= CHUNK:
                yield _Words(bodies, langs)
                continue
            whole = np.frombuffer(bodies[0].as_buffer(), np.uint8)
            stops = np.flatnonzero(_BREAK[whole]) + 1
            low = 0
            while low < len(whole):
                next_ = np.searchsorted(stops, low + CHUNK)
                high = int(stops[next_]) if next_ < len(stops) else len(whole)
                yield _Words(pa.array([whole[low:high].tobytes()], pa.binary()), langs)
                low = high


def _rows(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"), F.coalesce(F.col(lang), F.lit("und")).alias("lang")
    )


def _pack(hashes: list[np.ndarray], bits: int) -> pa.RecordBatch:
    """Counted hashes, one row for each bucket (the first bits): the steps between the sorted rest, and the counts."""
    values, n = np.unique(np.concatenate(hashes) >> np.uint64(64 - BITS), return_counts=True)
    bucket = (values >> np.uint64(BITS - bits)).astype(np.int64)
    rest = values & np.uint64((1 << (BITS - bits)) - 1)
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(values) else np.zeros(0, np.int64)
    steps = np.diff(rest, prepend=rest[:1])
    steps[first] = rest[first]
    ends = np.append(first[1:], len(values))
    cut = lambda x: [x[a:b].tobytes() for a, b in zip(first, ends)]
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[first]), pa.array(cut(steps.astype(np.uint32)), pa.binary()), pa.array(cut(n.astype(np.uint32)), pa.binary())],
        names=["bucket", "steps", "counts"],
    )


def frequent_slots(rows: DataFrame, hashes, bits: int, least: int) -> DataFrame:
    """(s): the slots of all hashes that come `least` times. hashes gives those of some texts as an array; bits is how
    many of a hash's bits name its bucket. A task counts what it has before it sends one row for each bucket, and the
    buckets are as many as it takes for one to be small."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for w in _parts(batches):
            held.append(hashes(w))
            n += len(held[-1])
            if n > HELD:
                yield _pack(held, bits)
                held, n = [], 0
        if n:
            yield _pack(held, bits)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, values, counts = None, [], []

        def total() -> pa.RecordBatch:
            rest = np.concatenate(values)
            order = np.argsort(rest, kind="stable")
            rest, n = rest[order], np.concatenate(counts)[order]
            first = np.flatnonzero(np.append(True, rest[1:] != rest[:-1]))
            many = rest[first[np.add.reduceat(n, first) >= least]] | (np.uint64(now) << np.uint64(BITS - bits))
            return pa.RecordBatch.from_arrays([pa.array(many.astype(np.int64) % SLOTS + 1)], names=["s"])

        for batch in batches:
            for bucket, steps, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if now is not None and bucket != now:
                    yield total()
                    values, counts = [], []
                now = bucket
                values.append(np.cumsum(np.frombuffer(steps.as_buffer(), np.uint32), dtype=np.uint64))
                counts.append(np.frombuffer(n.as_buffer(), np.uint32).astype(np.int64))
        if values:
            yield total()

    packed = rows.mapInArrow(count, "bucket long, steps binary, counts binary")
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(add, "s long")


def leaves(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = FREQUENT) -> tuple[DataFrame, DataFrame]:
    """(sizes, leaves): (lang, n), the words of every language, and (lang, suffix, n), the different suffixes of at
    most `longest` words and how often each comes, cut where no phrase that comes `least` times can go on."""
    small_batches(docs.sparkSession)
    rows = _rows(docs, text, lang)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in _parts(batches):
            n = np.bincount(w.lang, minlength=len(w.names))
            yield pa.RecordBatch.from_arrays([pa.array(w.names, pa.string()), pa.array(n)], names=["lang", "n"])

    words = stage(rows.mapInArrow(sizes, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n")), "sizes")
    total = words.agg(F.sum("n")).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, ceil(log2(max(1, total) / BUCKET))))
    one = bitmap(stage(frequent_slots(rows, lambda w: w.hash, bits, least), "words"), "s")

    def known(w: _Words) -> np.ndarray:
        return holds(one.value, _slots(w.hash))

    def paired(w: _Words) -> np.ndarray:
        """Where a word that may be frequent is followed by another."""
        own = known(w)
        return np.flatnonzero(w.next[:-1] & own[:-1] & own[1:])

    two = bitmap(stage(frequent_slots(rows, lambda w: w.runs(2, paired(w)), bits, least), "pairs"), "s")

    def tripled(w: _Words) -> tuple[np.ndarray, np.ndarray]:
        """Where a pair may be frequent, and where such a pair's second word begins another."""
        at = paired(w)
        at = at[holds(two.value, _slots(w.runs(2, at)))]
        return at, at[:-1][at[1:] == at[:-1] + 1]

    three = bitmap(stage(frequent_slots(rows, lambda w: w.runs(3, tripled(w)[1]), bits, least), "triples"), "s")

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in _parts(batches):
            at = np.flatnonzero(known(w))
            if not len(at):
                continue
            pair, triple = np.zeros(len(w.hash), bool), np.zeros(len(w.hash), bool)
            first, second = tripled(w)
            pair[first] = True
            triple[second[holds(three.value, _slots(w.runs(3, second)))]] = True
            length, mark, going = np.ones(len(at), np.int64), w.hash[at].copy(), np.ones(len(at), bool)
            for k in range(1, longest):
                more = pair[at] if k == 1 else triple[np.minimum(at + k - 2, len(triple) - 1)]
                going = going & more
                length[going] += 1
                mark[going] = mix(mark[going] * _AGAIN + w.hash[at[going] + k])
            _, first, n = np.unique(mark, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(w.names[w.lang[at[first]]], pa.string()), w.strings(at[first], length[first]), pa.array(n)],
                names=["lang", "suffix", "n"],
            )

    found = rows.mapInArrow(suffixes, "lang string, suffix string, n long").groupBy("lang", "suffix").agg(F.sum("n").alias("n"))
    return words, stage(found, "leaves")


def _prefix(words: int) -> Column:
    return F.substring_index("suffix", " ", words)


def grouped(leaves: DataFrame, budget: int = BUDGET, longest: int = LONGEST) -> DataFrame:
    """leaves with words (of the prefix they belong to) and group: all leaves of a prefix are in one group, which has
    at most `budget` leaves unless a single one is its prefix."""
    left, units, replaced = leaves.select("lang", "suffix"), None, None
    for words in range(1, longest + 1):
        sizes = stage(
            left.groupBy("lang", _prefix(words).alias("prefix")).agg(
                F.count(F.lit(1)).alias("size"), F.max(F.size(F.split("suffix", " "))).alias("deepest")
            ).withColumn("words", F.lit(words)),
            "prefixes",
        )
        wide = (F.col("size") > budget) & (F.col("deepest") > words)
        done = sizes.filter(~wide)
        units = done if units is None else units.unionByName(done)
        heavy = sizes.filter(wide).select("lang", "prefix", "words")
        if words == longest or heavy.isEmpty():
            break
        replaced = heavy if replaced is None else replaced.unionByName(heavy)
        left = left.withColumn("prefix", _prefix(words)).join(heavy.drop("words"), ["lang", "prefix"], "left_semi").select("lang", "suffix")
    placed = running(units, [F.col("lang"), F.split("prefix", " ")], "size", "units")
    placed = placed.select("lang", "prefix", "words", F.floor(F.col("_before") / budget).alias("group"))
    out = leaves.withColumn("words", F.lit(1)).withColumn("prefix", _prefix(1))
    for n in range(2, words + 1):  # a leaf belongs to its shortest prefix that was not replaced
        out = out.join(replaced.withColumn("more", F.lit(n)), ["lang", "prefix", "words"], "left").withColumn("words", F.coalesce("more", "words"))
        out = out.drop("more").withColumn("prefix", F.expr("substring_index(suffix, ' ', words)"))
    return out.join(placed, ["lang", "prefix", "words"]).drop("prefix")


def nodes(leaves: DataFrame, budget: int = BUDGET, longest: int = LONGEST, least: int = FREQUENT) -> DataFrame:
    """(lang, phrase, words, f): every phrase of at most `longest` words that comes `least` times or more, from the
    subtrees of all groups."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, totals, whole, lang, out = [], [], [], None, []

        def shrink(to: int) -> None:
            """Leave the nodes below depth `to` of the path; a node's total goes up to the one above it."""
            while len(path) > to:
                n, complete = totals.pop(), whole.pop()
                if n >= least or not complete:
                    out.append((lang, " ".join(path), len(path), n))
                path.pop()
                if totals:
                    totals[-1] += n

        for batch in batches:
            for name, suffix, n, words in zip(*(c.to_pylist() for c in batch.columns)):
                mine = suffix.split(" ")
                common = 0
                if name == lang:
                    while common < min(len(path), len(mine)) and path[common] == mine[common]:
                        common += 1
                shrink(common)
                lang = name
                for depth in range(common, len(mine)):
                    path.append(mine[depth])
                    totals.append(0)
                    whole.append(depth + 1 >= words)
                totals[-1] += n
            if len(out) > 5000:
                yield _node_batch(out)
                out.clear()
        shrink(0)
        if out:
            yield _node_batch(out)

    rows = grouped(leaves, budget, longest).withColumn("path", F.split("suffix", " "))
    rows = rows.repartition("group").sortWithinPartitions("group", "lang", "path")
    found = rows.select("lang", "suffix", "n", "words").mapInArrow(scan, "lang string, phrase string, words int, f long")
    return found.groupBy("lang", "phrase").agg(F.first("words").alias("words"), F.sum("f").alias("f")).filter(F.col("f") >= least)


def _node_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.string(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["lang", "phrase", "words", "f"])


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = FREQUENT, covered: int = 100,
    budget: int = BUDGET,
) -> DataFrame:
    """(lang, phrase, a, l, r, n, score, k): the phrases of 2 to `longest` words that come at least `least` times.

    Texts are lower-cased (A-Z), cut at .,;:!? and line ends into pieces and at spaces and tabs into words; a NULL
    language is und, NULL and blank texts have no words. n counts a language's words, a the phrase. Cut after k
    words, l and r count its parts and the score is 1000 a n / (l r), rounded down; the cut of the least score
    counts, of equal ones the first. Phrases within a longer one that comes at least `covered` percent as often are
    left out. Every row counts, repeated ones too; an empty table gives no rows; other columns are not looked at.

    If any longer phrase covers one, then so does one of a single word more, which comes at least as often: only
    these are looked at. Words are told apart by their letters; only within a chunk of about two megabytes are equal
    suffixes found by 64-bit hashes.
    """
    sizes, found = leaves(docs, text, lang, longest, least)
    every = stage(nodes(found, budget, longest, least), "nodes")
    phrases = every.filter("words > 1")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumns(
        {"left": F.expr("substring_index(phrase, ' ', k)"), "right": F.expr("substring_index(phrase, ' ', k - words)")}
    )
    part = lambda name, count: every.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(sizes, "lang")
    wide = "decimal(38,0)"
    share = F.expr(f"cast(1000 as {wide}) * cast(f as {wide}) * cast(n as {wide}) div (cast(l as {wide}) * cast(r as {wide}))")
    scored = cuts.withColumn("score", share)
    best = scored.groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first("f").alias("a"), F.first("words").alias("words"), F.first("n").alias("n")
    )
    shorter = F.expr("array(substring_index(phrase, ' ', words - 1), substring_index(phrase, ' ', 1 - words))")
    cover = phrases.filter("words > 2").select("lang", F.explode(shorter).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("above"))
    kept = best.join(cover, ["lang", "phrase"], "left").filter(F.col("above").isNull() | (100 * F.col("above") < covered * F.col("a")))
    return kept.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score", F.col("cut.k").alias("k"))


def strongest(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first `top` phrases of each language by score, then a, both descending, then phrase, with their rank."""
    w = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).withColumn("rank", F.col("rank").cast("long"))

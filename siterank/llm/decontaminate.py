"""Benchmark decontamination by template canonicalisation.

Numbers, names and units are replaced by typed placeholders, so a question whose parameters were changed has the
same template windows as the benchmark's. Whether a capital makes a name is read in three ways, each with templates
of its own: always, never, and except at the start of a sentence. Neighbouring names are one placeholder. A template
window goes on until it has enough ordinary words; where an item ends before, it goes on to the left, and an item that
has too few as a whole is one window, if it has any. Windows of documents are hash-joined with windows of the items;
along each alignment of a document with an item, the values behind the placeholders must map consistently: what stood
for one value stands for one value throughout. A document is contaminated by an item if it holds enough of its windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siterank.llm.bitmap import SLOTS, bitmap, holds
from siterank.llm.files import slices, small_batches
from siterank.llm.tokens import bytes_of, mix, word_bounds, word_hashes
from siterank.sources.staging import stage

WIDTH, CONTAINED = 5, 0.8  # words of a window; share of an item's windows that a document must hold
CONSISTENT = 0.8  # share of an alignment's slots that must agree with the mapping
LITERALS = 2  # ordinary words of a template window, unless its item has fewer
WORD, NUMBER, NAME, UNIT = 0, 1, 2, 3
MARKS = ["", "<num>", "<name>", "<unit>"]
PLAIN, NAMES, NO_NAMES, INNER_NAMES = 0, 1, 2, 3  # a window as it is, and the three readings of capitals

# fixed values: words that are a unit of measure when they follow a number
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound "
    "pounds oz ounce ounces ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes "
    "h hr hrs hour hours day days week weeks month months year years percent usd eur gbp dollar dollars cent cents euro euros "
    "kb mb gb tb hz khz mhz ghz w kw kwh v a c f k mph kmh meter meters metre metres kilometer kilometers degree degrees"
).split()
NUMBER_UNIT = re.compile(rb"[0-9][0-9.,:/-]*([A-Za-z]+)")

WINDOW = (
    "id {id}, text_hash long, reading int, at int, unit int, whole boolean, hash long, template string, kinds array<int>, "
    "places array<int>, words array<string>"
)


def _table(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_DIGIT = _table(b"0123456789")
_NUMERIC = _table(b"0123456789.,:/-")
_UPPER = _table(bytes(range(65, 91)))
_SMALL = _table(bytes([*range(97, 123), *range(128, 256)]))
_ALNUM = _DIGIT | _UPPER | _SMALL
_STOP = _table(b".!?:;\"()[]*#>|\n\r")


def _hash_of(words: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    data = np.frombuffer(b" ".join(words), np.uint8)
    return word_hashes(data, np.append(0, ends[:-1] + 1), ends)


_UNIT_HASHES = _hash_of([u.encode() for u in UNITS])
_MARK_HASHES = mix(np.arange(1, 5, dtype=np.uint64))
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def canonical(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(begin, end, text, kind, hash, opens a sentence) of every word with a letter or digit, cut to its first and last of them.

    A number starts with a digit and goes on in digits and . , : / -; a number with a unit behind it in one word is
    a number too. A unit is a word of UNITS after a number. A name starts with a capital and has a small letter or
    nothing behind it. All else are words; their hash takes capitals, A-Z and
    those of Latin-1, as small letters.
    """
    begin, end, text = word_bounds(data, starts)
    solid = np.flatnonzero(_ALNUM[data])
    low, high = np.searchsorted(solid, begin), np.searchsorted(solid, end)
    full = low < high
    begin, end, text = solid[low[full]], solid[high[full] - 1] + 1, text[full]
    small_data = data.copy()
    if len(data):
        accented = np.append(False, (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97))
        small_data[accented] += 0x20
    hashes = word_hashes(small_data, begin, end)
    kind = np.zeros(len(begin), np.int8)
    if not len(begin):
        return begin, end, text, kind, hashes, np.zeros(0, bool)
    counted = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    odd, small = counted(~_NUMERIC[data]), counted(_SMALL[data])
    first = data[begin]
    digit = _DIGIT[first]
    kind[digit & (odd[end] == odd[begin])] = NUMBER
    for i in np.flatnonzero(digit & (kind == WORD)):
        found = NUMBER_UNIT.fullmatch(data[begin[i] : end[i]].tobytes())
        if found and found[1].decode().lower() in UNITS:
            kind[i] = NUMBER
    wide = first == 0xC3  # capitals of Latin-1 in UTF-8
    second = data[np.minimum(begin + 1, len(data) - 1)]
    capital = _UPPER[first] | (wide & (second >= 0x80) & (second <= 0x9E) & (second != 0x97))
    rest = begin + 1 + wide
    kind[capital & ((rest >= end) | (small[end] > small[np.minimum(rest, end)]))] = NAME
    after = np.flatnonzero((kind[1:] != NUMBER) & (kind[:-1] == NUMBER) & (text[1:] == text[:-1])) + 1
    kind[after[np.isin(hashes[after], _UNIT_HASHES)]] = UNIT
    stops = counted(_STOP[data])
    opens = np.append(True, (text[1:] != text[:-1]) | (stops[begin[1:]] > stops[end[:-1]]))
    return begin, end, text, kind, hashes, opens


def _read(kind: np.ndarray, opens: np.ndarray, reading: int) -> np.ndarray:
    """The kinds of all words where capitals are read in one of the ways."""
    if reading == NAMES:
        return kind
    word = (kind == NAME) & (opens if reading == INNER_NAMES else True) if reading != PLAIN else np.ones(len(kind), bool)
    return np.where(word, WORD, kind).astype(np.int8)


class _Units:
    """The words of all texts in one reading, runs of names taken as one: first word, text and kind of every unit,
    and where each text's units lie."""

    def __init__(self, text: np.ndarray, kind: np.ndarray, hashes: np.ndarray, texts: int, reading: int):
        run = (kind[1:] == NAME) & (kind[:-1] == NAME) & (text[1:] == text[:-1])
        new = np.append(True, ~run) if len(kind) else np.zeros(0, bool)
        self.reading, self.of_word = reading, np.cumsum(new) - 1
        self.first = np.append(np.flatnonzero(new), len(kind))
        self.kind, self.text = kind[new], text[new]
        self.low, self.high = (np.searchsorted(self.text, np.arange(texts), side=x) for x in ("left", "right"))
        value = np.where(self.kind == WORD, hashes[new], _MARK_HASHES[self.kind])
        power = lambda b: np.cumprod(np.append(np.uint64(1), np.full(len(value), b, np.uint64)))
        self.sums = np.append(np.uint64(0), np.cumsum(value * power(_BASE)[: len(value)]))
        self.back = power(_BACK)
        self.words = np.append(0, np.cumsum(self.kind == WORD))
        self.literal = np.flatnonzero(self.kind == WORD)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        salt = (end - start).astype(np.uint64) * np.uint64(8) + np.uint64(self.reading)
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + salt)

    def marked(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether a window has a placeholder and an ordinary word."""
        words = self.words[end] - self.words[start]
        return (words > 0) & (words < end - start)

    def right(self, start: np.ndarray, width: int) -> np.ndarray:
        """The end of the window from each unit on: the first with enough units and ordinary words, -1 if the text ends
        before. Depends on nothing outside of the window."""
        far = np.append(self.literal, np.full(LITERALS, len(self.kind)))
        end = np.maximum(start + width, far[np.searchsorted(self.literal, start) + LITERALS - 1] + 1)
        return np.where(end <= self.high[self.text[start]], end, -1)

    def left(self, end: np.ndarray, width: int) -> np.ndarray:
        """The same to the left: the start of the window up to each unit, -1 if the text starts after it."""
        far = np.append(np.full(LITERALS, -1), self.literal)
        start = np.minimum(end - width, far[np.searchsorted(self.literal, end)])
        return np.where(start >= self.low[self.text[end - 1]], start, -1)

    def of_width(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        start = np.arange(max(0, len(self.kind) - width + 1))
        start = start[self.text[start] == self.text[start + width - 1]]
        return start, start + width

    def of_docs(self, width: int, whole: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of all windows that an item's may be equal to; `whole`: how many units whole items have."""
        every = np.arange(len(self.kind))
        end = self.right(every, width)
        start = self.left(every + 1, width)
        fits, more = end >= 0, start >= 0
        more[more] = end[start[more]] != every[more] + 1  # others are windows to the right
        parts = [(every[fits], end[fits]), (start[more], every[more] + 1), *map(self.of_width, whole)]
        start, end = (np.concatenate(x) for x in zip(*parts))
        keep = self.marked(start, end)
        return start[keep], end[keep]

    def of_items(self, at: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
        """(start, end, first word counted for, is the whole text) of one window for each word in `at`."""
        unit = self.of_word[at]
        low, high = self.low[self.text[unit]], self.high[self.text[unit]]
        end = self.right(unit, width)
        start = np.where(end >= 0, unit, self.left(high, width))
        whole = start < 0
        start, end = np.where(whole, low, start), np.where(end >= 0, end, high)
        keep = self.marked(start, end)
        return start[keep], end[keep], at[keep], whole[keep]


def template_windows(
    rows: DataFrame, key: str, text: str, width: int = WIDTH, bits=None, plain: list[int] = (),
    whole: dict[int, list[int]] | None = None,
) -> DataFrame:
    """The windows of all texts in all readings: id, text_hash, reading, at (number of the word it counts for), unit
    (number of its first unit), whole (an item that is one template window), hash, template, kinds, places (number of
    the first word) and words of its units. With bits, windows of documents that the bitmap lets through: `plain` are
    the widths of windows as they are, `whole` has those of whole items by reading. Without, windows of items, one
    for each first word and reading; an item of fewer words than a window is one window."""
    small_batches(rows.sparkSession)
    kind_of_id = rows.schema[key].dataType.simpleString()
    whole = whole or {}

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body"):
            data, starts = bytes_of(batch.column("body"))
            begin, end, of, kind, hashes, opens = canonical(data, starts)
            counts = np.bincount(of, minlength=batch.num_rows)
            first = np.cumsum(counts) - counts
            raw = data.tobytes()
            within = np.arange(len(of)) - first[of] if len(of) else np.zeros(0, np.int64)
            # an item without the capitals that a reading is about has the same windows without names
            inner = np.bincount(of[(kind == NAME) & ~opens], minlength=batch.num_rows) > 0
            capitals = np.bincount(of[kind == NAME], minlength=batch.num_rows) > 0
            plenty = np.bincount(of[kind == WORD], minlength=batch.num_rows) > 0
            differs = {PLAIN: np.ones(batch.num_rows, bool), NAMES: capitals, NO_NAMES: np.ones(batch.num_rows, bool), INNER_NAMES: inner}
            counted = np.flatnonzero(within <= np.maximum(0, counts[of] - width))  # words that a window of an item starts with
            columns: list[list] = [[] for _ in range(10)]
            for reading in (PLAIN, NAMES, NO_NAMES, INNER_NAMES) if len(of) else ():
                units = _Units(of, _read(kind, opens, reading), hashes, batch.num_rows, reading)
                if bits is None and reading == PLAIN:
                    low, at, one = counted, counted, np.zeros(len(counted), bool)
                    high = np.minimum(low + width, units.high[of[low]])
                elif bits is None:
                    low, high, at, one = units.of_items(counted[differs[reading][of[counted]]], width)
                    if reading == INNER_NAMES:  # where all words have a capital, the first one alone says too little
                        some = ~one | plenty[units.text[low]]
                        low, high, at, one = low[some], high[some], at[some], one[some]
                elif reading == PLAIN:
                    low, high = (np.concatenate(x) for x in zip(*map(units.of_width, plain)))
                else:
                    low, high = units.of_docs(width, whole.get(reading, []))
                value = units.hash(low, high)
                if bits is not None:
                    seen = holds(bits.value, (value % np.uint64(SLOTS)).astype(np.int64) + 1)
                    low, high, value = low[seen], high[seen], value[seen]
                    at, one = units.first[low], np.zeros(len(low), bool)
                for a, b, c, w, v in zip(low.tolist(), high.tolist(), at.tolist(), one.tolist(), value.view(np.int64).tolist()):
                    cut, t = units.first[a : b + 1].tolist(), units.text[a]
                    own = [
                        " ".join(raw[begin[i] : end[i]].decode(errors="replace").lower() for i in range(x, y))
                        for x, y in zip(cut, cut[1:])
                    ]
                    marks = units.kind[a:b].tolist()
                    row = (
                        t, reading, c - first[t], a - units.low[t], w, v, " ".join(MARKS[m] or x for m, x in zip(marks, own)),
                        marks, [x - first[t] for x in cut[:-1]], own,
                    )
                    for column, x in zip(columns, row):
                        column.append(x)
            take = pa.array(columns[0], pa.int64())
            types = [
                pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.list_(pa.int32()),
                pa.list_(pa.int32()), pa.list_(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(take), batch.column("text_hash").take(take), *map(pa.array, columns[1:], types)],
                names=["id", "text_hash", "reading", "at", "unit", "whole", "hash", "template", "kinds", "places", "words"],
            )

    body = rows.filter(F.col(text).isNotNull()).select(
        F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).cast("binary").alias("body")
    )
    return body.mapInArrow(build, WINDOW.format(id=kind_of_id))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", width: int = WIDTH, contained: float = CONTAINED,
) -> DataFrame:
    """One row per contaminated document and item: the key column, text_hash, the item column, windows (of the item
    that the document holds), item_windows, containment, slots, slots_changed and reparameterised.

    An item of fewer words than a window is one window. An item without any ordinary word is found as it is only. NULL, empty and wordless texts hold no window and, as
    items, contaminate nothing. Repeated rows of a document or an item are one; a document is its id together with
    its text, so NULL ids do no harm. No benchmark or no documents give no rows; other columns are not looked at.
    """
    items = stage(template_windows(benchmark, item, item_text, width).distinct(), "items")
    plain, whole = {width}, {}
    lengths = items.filter((F.col("reading") == PLAIN) | F.col("whole")).select("reading", F.size("words")).distinct()
    for reading, n in lengths.collect():
        plain.add(n) if reading == PLAIN else whole.setdefault(reading, []).append(n)
    # hashes are taken modulo SLOTS as unsigned numbers; SLOTS is a power of two, so its low bits do
    slots_ = items.select((F.col("hash").bitwiseAND(F.lit(SLOTS - 1)) + 1).alias("s")).distinct()
    hits = template_windows(docs, key, text, width, bitmap(slots_, "s"), sorted(plain), whole).drop("at", "whole", "places")
    of_item = items.select(
        F.col("id").alias("item"), F.col("text_hash").alias("item_hash"), F.col("at").alias("item_at"), "hash", "template",
        "reading", F.col("unit").alias("item_unit"), "places", F.col("words").alias("item_words"),
    )
    # a window that very many documents share lies on the left only, where adaptive execution splits it
    met = hits.join(of_item, ["hash", "template", "reading"]).withColumn("shift", F.col("unit") - F.col("item_unit"))
    met = stage(met.drop("hash", "template", "unit", "item_unit"), "met")
    who = ["id", "text_hash", "item", "item_hash"]
    line = [*who, "reading", "shift"]

    # runs of as many names are compared name by name, others as a whole
    was, now = F.split("p.item_words", " "), F.split("p.words", " ")
    values = F.when(
        F.size(was) == F.size(now), F.zip_with(was, now, lambda x, y: F.struct(x.alias("was"), y.alias("now")))
    ).otherwise(F.array(F.struct(F.col("p.item_words").alias("was"), F.col("p.words").alias("now"))))
    slots = (
        met.select(*line, F.explode(F.arrays_zip("kinds", "words", "item_words", "places")).alias("p"))
        .filter(F.col("p.kinds") > 0)
        .select(*line, F.col("p.kinds").alias("kind"), F.col("p.places").alias("place"), F.posexplode(values).alias("k", "v"))
        .select(*line, (F.col("place") + F.col("k")).alias("place"), "kind", "v.was", "v.now")
        .distinct()
    )
    agree = (
        slots.groupBy(*line, "kind", "was", "now").agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*line, "kind", "was").agg(F.max("n").alias("most"), F.sum("n").alias("n"), F.sum(F.when(F.col("was") != F.col("now"), F.col("n")).otherwise(0)).alias("changed"))
        .groupBy(*line).agg(F.sum("most").alias("most"), F.sum("n").alias("slots"), F.sum("changed").alias("changed"))
    )
    same = met.alias("m").join(
        agree.alias("s"), [F.col(f"m.{c}").eqNullSafe(F.col(f"s.{c}")) for c in line], "left"
    ).select("m.*", *[F.coalesce(F.col(f"s.{c}"), F.lit(0)).alias(c) for c in ("most", "slots", "changed")])
    same = same.filter(F.col("most") >= F.col("slots") * CONSISTENT)
    held = (
        same.groupBy(*who, "item_at").agg(F.max("slots").alias("slots"), F.min("changed").alias("changed"))
        .groupBy(*who).agg(F.count(F.lit(1)).alias("windows"), F.max("slots").alias("slots"), F.max("changed").alias("changed"))
    )
    sizes = items.groupBy(F.col("id").alias("item"), F.col("text_hash").alias("item_hash")).agg(
        F.countDistinct("at").alias("item_windows")
    )
    one = F.col("h.item").eqNullSafe(F.col("n.item")) & (F.col("h.item_hash") == F.col("n.item_hash"))
    share = F.col("windows") / F.col("item_windows")
    return held.alias("h").join(sizes.alias("n"), one).filter(share >= contained).select(
        F.col("h.id").alias(key), "h.text_hash", F.col("h.item").alias(item), "windows", "item_windows",
        share.alias("containment"), "slots", F.col("changed").alias("slots_changed"), (F.col("changed") > 0).alias("reparameterised"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without contaminated documents; all columns and repeated rows stay."""
    bad = contaminated(docs, benchmark, key, text, **options)
    bad = bad.select(F.col(key).alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    same = F.col(key).eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(text)) == F.col("__hash"))
    return docs.join(bad, same, "left_anti")

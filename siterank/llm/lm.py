"""Scoring text by a log-bilinear language model trained with noise-contrastive estimation.

Words are counted over all training documents. The model's vocabulary is the END of a text, the most frequent words,
and classes of all other words by their last two bytes; a word of a class has its smoothed share of the class's
count. The model predicts a vocabulary entry from the one before it: (context vector x matrix) . target vector +
bias. Vocabulary and training data grow with the training tokens: GROWTH times the square root of their number are
entries, and the counts of all neighbouring entries of all training documents are a Spark table. A core model of the
END, the 895 most frequent words and the classes is trained first, on the table of its entries with the noise taken in
expectation. Every entry starts from its own or its class's vectors there; then tasks fit each entry's target vector
with the contexts held fast, and each entry's context vector with the targets held fast, to its counts against DRAWN
stated negatives, and sum up each context's probabilities, which normalises them.

Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siterank.llm.files import slices, small_batches
from siterank.llm.tokens import bytes_of, word_bounds, word_hashes
from siterank.sources.staging import stage

ENTRIES, CLASSES = 1024, 128  # entries of the core model, how many of them are classes; entry 0 is the end of a text
GROWTH = 4  # vocabulary entries by the square root of the training tokens, but no fewer than the core model's
DRAWN, FITS, FIT_RATE, HOLD = 1024, 15, 0.1, 30  # negatives of a fit, its steps and rate, tokens that its start counts for
OWNERS, ROWS = 128, 100_000  # entries that a task fits in one go, and their pairs
VECTOR, NOISE, STEPS, RATE = 32, 64, 300, 0.05
PRIOR = 30  # tokens that every context is taken to have been followed by beforehand, distributed as in the whole
SMOOTH = 0.1
KNOWN = 1 << 21  # words that tasks hold with their counts: those above 1/KNOWN of all tokens, which are no more than that
FLUSH = 200_000

COUNTED = "hash long, class int, n long"
SCORED = "id {id}, n_tokens long, n_known long, base double, model double, rare array<long>, times array<int>"


def _class_table() -> np.ndarray:
    """The class of a word by its last two bytes; a word of one byte has 0 before it."""
    pairs = np.arange(1 << 16, dtype=np.uint16)
    return np.array([zlib.crc32(bytes((p >> 8, p & 255))) % CLASSES for p in pairs.tolist()], np.int32)


_CLASS = _class_table()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _classes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    last = _LOWER[data[end - 1]].astype(np.int64)
    before = np.where(end - begin > 1, _LOWER[data[np.maximum(end - 2, 0)]].astype(np.int64), 0)
    return _CLASS[before * 256 + last]


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(hash, class, n) of every word of all texts, A-Z in lower case."""
    small_batches(docs.sparkSession)

    def rows(counts: Counter) -> pa.RecordBatch:
        words = list(counts)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        begin = np.append(0, ends[:-1] + 1)
        data = np.frombuffer(b" ".join(words), np.uint8)
        hashes, classes = word_hashes(data, begin, ends), _classes(data, begin, ends)
        return pa.RecordBatch.from_arrays(
            [pa.array(hashes.view(np.int64)), pa.array(classes), pa.array(list(counts.values()), pa.int64())],
            names=["hash", "class", "n"],
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for body in batch.column("body"):
                counts.update(body.as_py().lower().split())
                if len(counts) > FLUSH:
                    yield rows(counts)
                    counts.clear()
        if counts:
            yield rows(counts)

    body = docs.filter(F.col(text).isNotNull()).select(F.col(text).cast("binary").alias("body"))
    return body.mapInArrow(count, COUNTED).groupBy("hash").agg(F.min("class").alias("class"), F.sum("n").alias("n"))


@dataclass
class Words:
    """What tasks know of the counted words: the frequent ones with their counts, the vocabulary's entries, and the
    smoothed count of each class."""

    tokens: int
    distinct: int
    ends: int
    hashes: np.ndarray  # sorted
    counts: np.ndarray
    heads: np.ndarray  # sorted hashes of the words that are entries of their own
    masses: np.ndarray
    core: np.ndarray  # the core model's entry of every entry
    shares: np.ndarray  # the log of its share in that

    def entries(self, hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """The vocabulary entry of every word."""
        if not len(self.heads):
            return classes + 1
        at = np.minimum(np.searchsorted(self.heads, hashes), len(self.heads) - 1)
        return np.where(self.heads[at] == hashes, at + 1 + CLASSES, classes + 1)


def gather_words(counts: DataFrame, training_texts: int) -> Words:
    """Totals over all counted words, and the bounded part of them that tasks hold."""
    total, distinct = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    total = (total or 0) + training_texts
    least = max(2, -(-total // KNOWN))
    known = counts.filter(F.col("n") >= least).select("hash", "n").toArrow()
    hashes = known.column("hash").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    hashes, n = hashes[order], known.column("n").to_numpy()[order]
    order = np.lexsort((hashes, -n))  # the most frequent, sorted by hash
    top = np.sort(order[: max(ENTRIES, ceil(GROWTH * sqrt(total))) - CLASSES - 1])
    inner = np.isin(top, order[: ENTRIES - CLASSES - 1])
    masses = np.full(CLASSES, SMOOTH)  # in every class, one word that was never seen
    for row in counts.groupBy("class").agg((F.sum("n") + F.count(F.lit(1)) * SMOOTH).alias("mass")).collect():
        masses[row["class"]] += row["mass"]
    classes = {r["hash"]: r["class"] for r in counts.filter(F.col("n") >= max(2, int(n[top].min()) if len(top) else 2)).select("hash", "class").collect()}
    of = np.array([classes[h] for h in hashes[top].view(np.int64).tolist()], np.int64)
    masses -= np.bincount(of, weights=n[top] + SMOOTH, minlength=CLASSES)
    masses = np.maximum(masses, SMOOTH)
    outer = masses + np.bincount(of[~inner], weights=n[top][~inner] + SMOOTH, minlength=CLASSES)  # the core's classes
    core = np.where(inner, CLASSES + np.cumsum(inner), of + 1)
    shares = np.where(inner, 0.0, np.log((n[top] + SMOOTH) / outer[of]))
    return Words(
        total, distinct + (training_texts > 0), training_texts, hashes, n, hashes[top], masses,
        np.concatenate([np.arange(CLASSES + 1), core]), np.concatenate([[0.0], np.log(masses / outer), shares]),
    )


def _entry_rows(batch: pa.RecordBatch, words: Words) -> tuple[np.ndarray, ...]:
    """(entries of a batch's words with END after each text, the entry before each, text, is END, hash, class)."""
    data, starts = bytes_of(batch.column("body"))
    begin, end, text = word_bounds(data, starts)
    hashes, texts = word_hashes(data, begin, end), np.arange(batch.num_rows)
    classes = _classes(data, begin, end) if len(begin) else np.zeros(0, np.int32)
    at = np.searchsorted(text, texts, side="right")  # an END goes behind the last word of its text
    insert = lambda a, v: np.insert(a, at, v)
    entries = insert(words.entries(hashes, classes).astype(np.int64), 0)
    return entries, np.append(0, entries[:-1]), insert(text, texts), insert(np.zeros(len(text), bool), True), insert(hashes, 0), insert(classes, 0)


def neighbour_pairs(docs: DataFrame, words: Broadcast, text: str = "text") -> DataFrame:
    """(before, entry, n): how often each entry follows each other in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, held, keys = len(words.value.core), 0, []

        def rows() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(keys), return_counts=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(key // size, pa.int32()), pa.array(key % size, pa.int32()), pa.array(n, pa.int64())], names=["before", "entry", "n"]
            )

        for batch in slices(batches, "body"):
            entries, before, *_ = _entry_rows(batch, words.value)
            keys.append(before * size + entries)
            held += len(entries)
            if held > FLUSH * 10:
                yield rows()
                held, keys = 0, []
        if keys:
            yield rows()

    body = docs.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    return body.mapInArrow(count, "before int, entry int, n long").groupBy("before", "entry").agg(F.sum("n").alias("n"))


def core_counts(pairs: DataFrame, words: Broadcast) -> np.ndarray:
    """The pairs as those of the core model's entries: ENTRIES x ENTRIES, summed up by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ENTRIES * ENTRIES, np.int64)
        for batch in batches:
            before, entry, n = (batch.column(c).to_numpy() for c in ("before", "entry", "n"))
            core = words.value.core
            np.add.at(total, core[before] * ENTRIES + core[entry], n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["pair", "n"])

    rows = pairs.mapInArrow(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(ENTRIES * ENTRIES)
    out[rows.column("pair").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(ENTRIES, ENTRIES)


def train(counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """The normalised natural log-probabilities of every entry (column) after every other (row)."""
    context, target, bias = fit(counts, steps)
    logits = (context @ target.T + bias).astype(np.float64)
    logits -= logits.max(axis=1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def fit(counts: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors that every entry predicts with, target vectors and biases of the core model.

    Noise-contrastive estimation against the entries' own frequencies: an observed pair must look like data, NOISE
    times as many drawn pairs like noise, and both terms are summed over the whole table.
    """
    n, r = len(counts), np.random.default_rng(3)
    noise = (counts.sum(axis=0) + 0.5) / (counts.sum() + 0.5 * n)
    steps = steps if counts.any() else 0
    counts = counts + PRIOR * noise
    total = counts.sum()
    observed = (counts / total).astype(np.float32)
    drawn = (NOISE * counts.sum(axis=1)[:, None] / total * noise).astype(np.float32)
    offset = np.log(NOISE * noise).astype(np.float32)
    p = {
        "context": (r.standard_normal((n, VECTOR)) * 0.3).astype(np.float32), "matrix": np.eye(VECTOR, dtype=np.float32),
        "target": (r.standard_normal((n, VECTOR)) * 0.1).astype(np.float32), "bias": np.log(noise).astype(np.float32),
    }
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        predicted = p["context"] @ p["matrix"]
        like_data = 1 / (1 + np.exp(-np.clip(predicted @ p["target"].T + p["bias"] - offset, -30, 30)))
        slope = observed * (1 - like_data) - drawn * like_data
        back = slope @ p["target"]
        gradient = {
            "context": back @ p["matrix"].T, "matrix": p["context"].T @ back, "target": slope.T @ predicted, "bias": slope.sum(axis=0),
        }
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in gradient.items():
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.01 * (g * g - v[k])
            p[k] += (rate * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-12)).astype(np.float32)
    return p["context"] @ p["matrix"], p["target"], p["bias"]


def log_sums(context: np.ndarray, target: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """The log of the sum over all targets of every context."""
    out = np.zeros(len(context), np.float32)
    for low in range(0, len(context), 64):
        logits = context[low : low + 64] @ target.T + bias
        top = logits.max(axis=1)
        out[low : low + 64] = top + np.log(np.exp(logits - top[:, None]).sum(axis=1, dtype=np.float64))
    return out


def _fit_owners(own, other, n, start, across, own_shift, other_shift, drawn) -> np.ndarray:
    """start[i], moved to where start[i] . across[j] + own_shift[i] + other_shift[j] is likeliest to tell n[i, j] seen
    pairs from NOISE times as many with j drawn from `drawn`; `own` numbers the rows of start and is sorted."""
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    total = np.add.reduceat(n, first)[:, None].astype(np.float32)
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    seen, negative = across[other], across[drawn]
    shift, negative_shift = own_shift[own] + other_shift[other], own_shift[:, None] + other_shift[drawn]
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, FITS + 1):
        pull = n * (1 - sigmoid(np.einsum("ij,ij->i", x[own], seen) + shift))
        push = sigmoid(x @ negative.T + negative_shift)
        g = np.add.reduceat(pull[:, None] * seen, first, axis=0) - (NOISE / len(drawn)) * total * (push @ negative)
        g = (g - HOLD * (x - start)) / (total + HOLD)
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        rate = FIT_RATE * (1 - (step - 1) / FITS)
        x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-4)
    return x


def refit(pairs: DataFrame, own: str, start: np.ndarray, across: np.ndarray, own_shift, other_shift, drawn, bias=None) -> tuple[np.ndarray, np.ndarray]:
    """start with every row that has pairs fitted, and with a bias each row's log_sums; the side named `own` moves, the
    other stays. The groups of entries are dealt out; an entry's pairs are as many as there are entries at most."""
    spark, size = pairs.sparkSession, len(start)
    sent = spark.sparkContext.broadcast((start, across, own_shift, other_shift, drawn, bias))
    side = "entry" if own == "before" else "before"

    def solve(table: pa.Table) -> pa.Table:
        begin, across, own_shift, other_shift, drawn, bias = sent.value
        a, b, n = table.column("own").to_numpy(), table.column("other").to_numpy(), table.column("n").to_numpy().astype(np.float32)
        order = np.argsort(a, kind="stable")
        a, b, n = a[order], b[order], n[order]
        first = np.append(np.flatnonzero(np.append(True, a[1:] != a[:-1])), len(a))
        parts, low = [], 0
        while low < len(first) - 1:
            high = max(low + 1, int(np.searchsorted(first, first[low] + ROWS, side="right")) - 1)
            cut, ids = slice(first[low], first[high]), a[first[low:high]]
            number = np.repeat(np.arange(high - low), np.diff(first[low : high + 1]))
            parts.append(_fit_owners(number, b[cut], n[cut], begin[ids], across, own_shift[ids], other_shift, drawn))
            low = high
        x = np.concatenate(parts)
        sums = np.zeros(len(x), np.float32) if bias is None else log_sums(x, across, bias)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
        return pa.table([pa.array(a[first[:-1]], pa.int32()), lists, pa.array(sums)], names=["own", "x", "log_sum"])

    rows = pairs.select(F.col(own).alias("own"), F.col(side).alias("other"), "n", F.pmod(own, F.lit(max(1, size // OWNERS))).alias("block"))
    found = rows.groupBy("block").applyInArrow(solve, "own int, x array<float>, log_sum float").toArrow()
    out, sums, at = start.copy(), np.zeros(size, np.float32), found.column("own").to_numpy()
    if len(at):
        out[at] = found.column("x").combine_chunks().flatten().to_numpy().reshape(len(at), -1)
        sums[at] = found.column("log_sum").to_numpy()
    if bias is not None:  # entries that were never a context
        rest = np.setdiff1d(np.arange(size), at)
        sums[rest] = log_sums(out[rest], across, bias)
    return out, sums


def learn_vectors(pairs: DataFrame, words: Broadcast) -> tuple[np.ndarray, ...]:
    """(context, target, bias, log_sum) of all entries: entry e follows c with the natural log-probability
    context[c] . target[e] + bias[e] - log_sum[c]."""
    core, shares = words.value.core, words.value.shares.astype(np.float32)
    context, target, bias = fit(core_counts(pairs, words))
    context, target, bias = context[core], target[core], bias[core] + shares
    seen = pairs.groupBy("entry").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(core))
    counts[seen.column("entry").to_numpy()] = seen.column("n").to_numpy()
    if len(core) <= ENTRIES:  # the core model is the whole
        return context, target, bias, log_sums(context, target, bias)
    noise = (counts + 0.5) / (counts.sum() + 0.5 * len(counts))
    offset, none = np.log(NOISE * noise).astype(np.float32), np.zeros(len(core), np.float32)
    # the negatives: entries at even steps of the cumulated shares
    drawn = np.minimum(np.searchsorted(np.cumsum(noise), (np.arange(DRAWN) + 0.5) / DRAWN), len(core) - 1)
    one = np.ones((len(core), 1), np.float32)
    fitted, _ = refit(pairs, "entry", np.hstack([target, bias[:, None]]), np.hstack([context, one]), -offset, none, drawn)
    target, bias = np.ascontiguousarray(fitted[:, :-1]), fitted[:, -1].copy()
    context, sums = refit(pairs, "before", context, target, none, bias - offset, drawn, bias)
    return context, target, bias, sums


def score(
    docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per document: the key column, n_tokens, n_known, train_tokens, base_score, score.

    The documents where `learn` holds are learned from, all are scored on their whole text. Tokens are words (runs
    without white space, A-Z in lower case) and one END. base_score sums log10((c + 0.1) / (N + 0.1 (V + 1))) over
    the tokens, score the model's log10 probabilities. NULL, empty and blank texts are one END. Repeated rows are
    scored each. With nothing to learn from, every token's base is 0 and all entries are equally likely. Other
    columns of docs are looked at by `learn` alone.
    """
    spark = docs.sparkSession
    small_batches(spark)
    training = docs.filter(learn)
    counts = stage(count_words(training, text), "word-counts")
    words = gather_words(counts, training.count())
    sent = spark.sparkContext.broadcast(words)
    vectors = spark.sparkContext.broadcast(learn_vectors(stage(neighbour_pairs(training, sent, text), "pairs"), sent))
    kind = docs.schema[key].dataType.simpleString()

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (context, target, bias, log_sum) = sent.value, vectors.value

        def log_p(before: np.ndarray, entries: np.ndarray) -> np.ndarray:
            out = np.zeros(len(entries))
            for low in range(0, len(entries), 1 << 15):
                c, e = before[low : low + (1 << 15)], entries[low : low + (1 << 15)]
                out[low : low + len(c)] = np.einsum("ij,ij->i", context[c], target[e]) + bias[e] - log_sum[c]
            return out / np.log(10)

        norm = np.log10(known.tokens + SMOOTH * (known.distinct + 1))
        log_mass = np.log10(known.masses)
        for batch in slices(batches, "body"):
            entries, before, of, ends, hashes, classes = _entry_rows(batch, known)
            at = np.minimum(np.searchsorted(known.hashes, hashes), max(0, len(known.hashes) - 1))
            found = (known.hashes[at] == hashes if len(known.hashes) else np.zeros(len(hashes), bool)) & ~ends
            c = np.where(ends, known.ends, 0).astype(np.float64)
            c[found] = known.counts[at[found]]
            rare = ~found & ~ends
            own = np.where(rare, 0.0, np.log10(c + SMOOTH))
            in_class = (entries >= 1) & (entries <= CLASSES)
            model = log_p(before, entries) + np.where(in_class, own - log_mass[classes], 0.0)
            total = lambda w: np.bincount(of, weights=w, minlength=batch.num_rows)
            # the rare words of each text, each once
            order = np.flatnonzero(rare)
            order = order[np.lexsort((hashes[order], of[order]))]
            h, d = hashes[order], of[order]
            new = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])) if len(h) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(h)))
            cut = np.searchsorted(d[first], np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = lambda v, t: pa.ListArray.from_arrays(pa.array(cut), pa.array(v, t))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), pa.array(total(None).astype(np.int64)), pa.array(total(c > 0).astype(np.int64)),
                    pa.array(total(own - norm)), pa.array(total(model)),
                    lists(h[first].view(np.int64), pa.int64()), lists(times, pa.int32()),
                ],
                names=["id", "n_tokens", "n_known", "base", "model", "rare", "times"],
            )

    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    scored = rows.mapInArrow(rate, SCORED.format(id=kind)).withColumn("row", F.monotonically_increasing_id())
    scored = stage(scored, "scored")
    # words that tasks don't hold, at most 1/KNOWN of all tokens each, are looked up by a join on their hash
    looked_up = (
        scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w"))
        .select("row", F.col("w.rare").alias("hash"), F.col("w.times").alias("times"))
        .join(counts.select("hash", "n"), "hash", "left")
        .groupBy("row")
        .agg(
            F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(SMOOTH))).alias("own"),
            F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("seen"),
        )
    )
    more = lambda c: F.coalesce(c, F.lit(0))
    return scored.drop("rare", "times").join(looked_up, "row", "left").select(
        F.col("id").alias(key), "n_tokens", (F.col("n_known") + more("seen")).alias("n_known"),
        F.lit(words.tokens).cast("long").alias("train_tokens"), (F.col("base") + more("own")).alias("base_score"),
        (F.col("model") + more("own")).alias("score"),
    )

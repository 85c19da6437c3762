"""A quality classifier by attention-based multiple-instance learning.

A document is a bag of passages that cover its whole text. Each passage is encoded from its bytes, a gated
attention (tanh and sigmoid branches) weighs the passages, and the weighted mean is scored. Only documents have
labels; the weights of the passages are learned from them. Trained in numpy on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siterank.llm.files import slices, small_batches
from siterank.llm.tokens import bytes_of

PASSAGE = 1024  # bytes, at least
PASSAGES = 32  # a longer text has longer passages, not more of them and not less text
SAMPLE = 4000  # labelled documents to learn from, in the order of a hash of their id, half of each label where there are enough
HIDDEN, GATE = 32, 16
EPOCHS, BATCH, RATE, DECAY = 40, 64, 0.01, 1e-4
KINDS = 16
EXTRA = 4  # features beside pairs of byte kinds
WIDTH = KINDS * KINDS + EXTRA


def _kinds() -> np.ndarray:
    """What kind of byte each of the 256 is."""
    kind = np.full(256, 15, np.uint8)  # other control characters
    groups = (b" ", b"\n\r", b"\t\x0b\x0c", b"aeiou", b"bcdfghjklmnpqrstvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
              b"0123456789", b".", b",;:", b"!?", b"|", b"'\"`()[]{}<>", b"#$%&*+=@\\^_~-/")
    for i, group in enumerate(groups):
        kind[list(group)] = i
    kind[0x80:0xC0], kind[0xC0:] = 13, 14
    return kind


KIND = _kinds()
MIX = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)
ODD = np.random.default_rng(8).integers(1, 2**63, 32, dtype=np.uint64) | np.uint64(1)


def passages(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, document) of every passage of texts that lie one after the other in `data`; text i is
    data[starts[i]:starts[i + 1]]. An empty text has one empty passage."""
    sizes = np.diff(starts)
    step = np.maximum(PASSAGE, -(-sizes // PASSAGES))
    count = np.maximum(1, -(-sizes // step))
    doc = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    return starts[doc] + nth * step[doc], doc


def encode(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, document) of all passages: the square roots of the shares of byte-kind pairs, and how often a
    word is the one before it or two before it, word length and line length."""
    first, doc = passages(data, starts)
    n, size = len(first), len(data)
    out = np.zeros((n, WIDTH), np.float32)
    if not size:
        return out, doc
    last = np.append(first[1:], starts[-1])
    length = np.maximum(1, last - first)
    mine = np.repeat(np.arange(n), last - first)  # the passage of every byte
    kind = KIND[data]
    pair = mine[:-1] * (KINDS * KINDS) + kind[:-1].astype(np.int64) * KINDS + kind[1:]
    inside = mine[:-1] == mine[1:]
    pairs = np.bincount(pair[inside], minlength=n * KINDS * KINDS).reshape(n, -1)
    out[:, : KINDS * KINDS] = np.sqrt(pairs / length[:, None])
    # words: runs of bytes other than white space, hashed, and held against the two before them in the passage
    blank = kind <= 2
    edge = np.append(True, ~inside)
    begins = np.flatnonzero(~blank & (edge | np.append(True, blank[:-1])))
    if len(begins):
        word = np.cumsum(np.bincount(begins, minlength=size)) - 1
        at = np.arange(size) - begins[np.maximum(word, 0)]
        hashed = np.where(blank | (word < 0), np.uint64(0), MIX[data] * ODD[at & 31] + at.astype(np.uint64))
        hashes = np.add.reduceat(hashed, begins)
        of = mine[begins]
        words = np.maximum(1, np.bincount(of, minlength=n))
        for i, back in enumerate((1, 2)):
            same = (hashes[back:] == hashes[:-back]) & (of[back:] == of[:-back])
            out[:, KINDS * KINDS + i] = np.bincount(of[back:][same], minlength=n) / words
        out[:, KINDS * KINDS + 2] = length / words / 16
        lines = np.bincount(mine[data == 10], minlength=n)
        out[:, KINDS * KINDS + 3] = words / (1 + lines) / 256
    np.clip(out, 0, 4, out=out)
    return out, doc


class Attention:
    """The model: features -> hidden h; weights softmax(w . (tanh(V h) * sigmoid(U h))) over a document's
    passages; sigmoid of the weighted mean's score."""

    names = ("We", "be", "V", "U", "w", "c", "c0")

    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        draw = lambda a, b: (r.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.p = {
            "We": draw(WIDTH, HIDDEN), "be": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE),
            "w": draw(GATE, 1)[:, 0], "c": draw(HIDDEN, 1)[:, 0], "c0": np.zeros(1, np.float32),
        }

    def forward(self, x: np.ndarray, doc: np.ndarray, docs: int) -> dict[str, np.ndarray]:
        """doc is sorted and names every one of `docs` documents."""
        p = self.p
        first = np.searchsorted(doc, np.arange(docs))
        h = np.tanh(x @ p["We"] + p["be"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-np.clip(h @ p["U"], -30, 30)))
        logit = (t * g) @ p["w"]
        e = np.exp(logit - np.maximum.reduceat(logit, first)[doc])
        a = e / np.add.reduceat(e, first)[doc]
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["c0"], -30, 30)))
        return {"first": first, "h": h, "t": t, "g": g, "a": a, "z": z, "y": y}

    def gradient(self, x: np.ndarray, doc: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, doc, len(label))
        d = ((f["y"] - label) * weight / weight.sum()).astype(np.float32)
        dz = d[:, None] * p["c"]
        through = (dz[doc] * f["h"]).sum(axis=1)  # of a passage's weight
        mean = np.add.reduceat(f["a"] * through, f["first"])
        dl = f["a"] * (through - mean[doc])
        dt, dg = dl[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2), dl[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * dz[doc] + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
        return {
            "We": x.T @ dh, "be": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg,
            "w": (f["t"] * f["g"]).T @ dl, "c": f["z"].T @ d, "c0": d.sum(keepdims=True),
        }

    def fit(self, bags: list[np.ndarray], label: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS) -> "Attention":
        """Adam over small batches of documents; bags[i] holds the features of document i's passages."""
        r = np.random.default_rng(2)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        step, epochs = 0, max(epochs, -(-600 * BATCH // max(1, len(bags))))  # at least so many steps of a small sample
        for epoch in range(epochs):
            order = r.permutation(len(bags))
            rate = RATE * (1 - epoch / epochs)
            for at in range(0, len(order), BATCH):
                part = order[at : at + BATCH]
                doc = np.repeat(np.arange(len(part)), [len(bags[i]) for i in part])
                grad = self.gradient(np.concatenate([bags[i] for i in part]), doc, label[part], weight[part])
                step += 1
                for k, g in grad.items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    change = m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
                    self.p[k] -= (rate * (change + DECAY * self.p[k])).astype(np.float32)
        return self


class Constant:
    """What stands in for a model where the labels are all alike or there are none."""

    def __init__(self, value: float):
        self.value = value

    def forward(self, x: np.ndarray, doc: np.ndarray, docs: int) -> dict[str, np.ndarray]:
        return {"y": np.full(docs, self.value)}


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE):
    """A model from labelled documents. Of each label up to sample / 2 ids are taken, and more of the one where the
    other has fewer; weights give both their share among all labels again. Conflicting labels of an id go by their
    mean. Labels that are NULL or whose document is missing teach nothing."""
    small_batches(docs.sparkSession)
    known = (
        labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull())
        .groupBy(F.col(key).alias("__id"))
        .agg((F.avg(F.col(label)) >= 0.5).cast("int").alias("__label"))
    )
    counts = {r["__label"]: r["n"] for r in known.groupBy("__label").agg(F.count(F.lit(1)).alias("n")).collect()}
    few = min(counts.values(), default=0)
    if len(counts) < 2:
        return Constant(float(next(iter(counts), 0.5)))
    chosen = None
    for value, n in sorted(counts.items()):
        most = min(n, sample // 2 if n == few else max(sample // 2, sample - few))
        part = known.filter(F.col("__label") == value).orderBy(F.xxhash64("__id"), "__id").limit(most)
        part = part.withColumn("__weight", F.lit(n / most))
        chosen = part if chosen is None else chosen.unionByName(part)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body"):
            x, doc = encode(*bytes_of(batch.column("body")))
            cut = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            rows = [x[a:b].tobytes() for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.binary()), batch.column("id"), batch.column("label"), batch.column("weight")],
                names=["bag", "id", "label", "weight"],
            )

    # at most `sample` ids; a document is PASSAGES * WIDTH floats at most, whatever its length
    rows = docs.select(F.col(key).alias("__id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body")).join(
        F.broadcast(chosen), "__id"
    )
    found = (
        rows.select("body", F.col("__id").cast("string").alias("id"), F.col("__label").alias("label"), F.col("__weight").alias("weight"))
        .mapInArrow(bags, "bag binary, id string, label int, weight double")
        .dropDuplicates(["id"])
        .collect()
    )
    found.sort(key=lambda r: r["id"])
    if len({r["label"] for r in found}) < 2:
        return Constant(counts.get(1, 0) / sum(counts.values()))
    return Attention().fit(
        [np.frombuffer(r["bag"], np.float32).reshape(-1, WIDTH) for r in found],
        np.array([r["label"] for r in found], np.float32), np.array([r["weight"] for r in found], np.float32),
    )


def score(docs: DataFrame, model, text: str = "text", name: str = "score") -> DataFrame:
    """docs and a column `name`, 0 to 1, from the whole text. NULL counts as empty, and an empty text is scored as
    one empty passage. Repeated rows are scored each; an own column of that name is replaced."""
    small_batches(docs.sparkSession)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__body"):
            x, doc = encode(*bytes_of(batch.column("__body")))
            y = pa.array(model.forward(x, doc, batch.num_rows)["y"].astype(np.float64))
            kept = [c for c in batch.schema.names if c != "__body"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), y], names=[*kept, name])

    kept = [c for c in docs.columns if c != name]
    body = F.coalesce(F.col(text), F.lit("")).cast("binary").alias("__body")
    schema = docs.select(*kept).schema.add(name, "double")
    return docs.select(*kept, body).mapInArrow(rate, schema)

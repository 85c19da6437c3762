"""Packing token sequences by Karmarkar-Karp multiway differencing.

Documents are tokenized and cut: whole windows first, the rest into pieces. The pieces of a batch are spread over
windows by differencing: two partial partitions at a time, those with the largest spread, are merged with their
imbalances opposed, the fullest window of one with the emptiest of the other, until one partition is left. Its windows are nearly
equal; if one exceeds the capacity, the batch is spread anew over more windows.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siterank.llm.files import small_batches
from siterank.sources.staging import stage

CAPACITY = 2048
PIECE = 512  # what is left of a document after its whole windows is cut into pieces of at most this many tokens
BATCH_WINDOWS = 128  # windows' worth of pieces that are spread together
TASK_TOKENS = 8 << 20
END = 1  # the id after every document

PIECES = "doc {id}, start long, length long, ids_crc32 long, doc_tokens long"

# fixed values: the pattern that splits text before byte-level BPE
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# characters on which all regular expression engines agree what is a letter, a number and white space
PLAIN = re.compile(r"[^\t\n\r -~¡-ſ]")


def _byte_names() -> dict[str, int]:
    """The characters that stand for single bytes in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Ids of a byte-level BPE file of the tokenizers library. Texts of plain characters without a special token take
    a faster encoder over the same vocabulary, whose ids are the same; all others the library itself."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        self.special = [t["content"] for t in model.get("added_tokens", [])]
        names, vocabulary = _byte_names(), model["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        ranks = {bytes(names[c] for c in t): i for t, i in vocabulary.items() if t not in self.special}
        if [vocabulary["".join(m)] for m in merges] != list(range(256, 256 + len(merges))):
            ranks = {}
        self.fast = ranks and tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast and not PLAIN.search(text) and not any(t in text for t in self.special):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut(tokens: int, capacity: int = CAPACITY, piece: int = PIECE) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    whole = tokens // capacity * capacity
    starts = [*range(0, whole, capacity), *range(whole, tokens, piece)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], tokens])]


def pieces(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, piece: int = PIECE,
    with_ids: bool = False,
) -> DataFrame:
    """(doc, start, length, ids_crc32, doc_tokens) of all pieces; with_ids adds the ids themselves."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in batches:
            of, rows, ids = [], [], []
            for i, t in enumerate(batch.column("text")):
                all_ids = np.append(encoder.ids(t.as_py()), END).astype("<u4")
                for start, length in cut(len(all_ids), capacity, piece):
                    part = all_ids[start : start + length]
                    of.append(i)
                    rows.append((start, length, zlib.crc32(part.tobytes()), len(all_ids)))
                    if with_ids:
                        ids.append(part.astype(np.int32))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * 4
            columns.insert(0, batch.column("doc").take(pa.array(of, pa.int64())))
            names = ["doc", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(key).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(build, PIECES.format(id=kind) + (", ids array<int>" if with_ids else ""))


def difference(sizes: list[int], windows: int) -> list[int]:
    """The window of every size, after Karmarkar and Karp: sums are kept sorted, the largest first."""
    heap, parents = [], {}
    for i, size in enumerate(sizes):
        sums, slots = np.zeros(windows, np.int64), np.full(windows, -1, np.int64)
        sums[0], slots[0] = size, i
        heap.append((-size if windows > 1 else 0, i, sums, slots))
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        _, serial, sums, slots = heapq.heappop(heap)
        _, _, others, theirs = heapq.heappop(heap)
        others, theirs = others[::-1], theirs[::-1]
        sums, joined = sums + others, np.maximum(slots, theirs)
        for j in np.flatnonzero((slots >= 0) & (theirs >= 0)):
            parents[made] = (int(slots[j]), int(theirs[j]))
            joined[j] = made
            made += 1
        order = np.argsort(-sums, kind="stable")
        sums, joined = sums[order], joined[order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), serial, sums, joined))
    out = [0] * len(sizes)
    for window, slot in enumerate(heap[0][3] if heap else []):
        open_ = [int(slot)] if slot >= 0 else []
        while open_:
            at = open_.pop()
            if at < len(sizes):
                out[at] = window
            else:
                open_.extend(parents[at])
    return out


def spread(sizes: list[int], capacity: int = CAPACITY) -> list[int]:
    """The window of every size (none above capacity), no window above capacity, as few windows as differencing
    gets by with, counted up from the least possible."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        of = difference(sizes, windows)
        most = int(np.bincount(of, weights=sizes).max()) if sizes else 0
        if most <= capacity:
            return of
        windows = min(len(sizes), windows + max(1, windows * (most - capacity) // (4 * capacity)))


def pack(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, piece: int = PIECE,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: the key column, start, length, ids_crc32 (of its little-endian 32-bit ids), doc_tokens,
    sequence_id, offset, padding (of its sequence: up to capacity, none at a power of two); with_ids adds ids.

    `tokenizer` names the tokenizer file, on every executor. A document is its ids and then END, so NULL and empty
    texts are one id; each id lies in exactly one piece and no sequence is longer than capacity. Rows that repeat a
    document are packed each. Empty tables give no rows; other columns of docs are not looked at.
    """
    cuts = stage(pieces(docs, tokenizer, key, text, capacity, piece, with_ids), "pieces")
    total = cuts.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, total // TASK_TOKENS)
    batch_tokens = BATCH_WINDOWS * capacity

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33

        def windows(rows: pa.Table, of: list[int]) -> pa.RecordBatch:
            nonlocal number
            size = np.asarray(rows.column("length"))
            names, window = np.unique(of, return_inverse=True)
            order = np.argsort(window, kind="stable")
            ends = np.cumsum(size[order])
            filled = np.bincount(window, weights=size).astype(np.int64)
            offset = np.empty(len(size), np.int64)
            offset[order] = ends - size[order] - (np.cumsum(filled) - filled)[window[order]]
            padding = np.where(filled & (filled - 1) == 0, 0, capacity - filled)[window]
            sequence, number = number + window, number + len(names)
            out = rows.append_column("sequence_id", pa.array(sequence, pa.int64()))
            out = out.append_column("offset", pa.array(offset)).append_column("padding", pa.array(padding, pa.int64()))
            return out.combine_chunks().to_batches()[0]

        held: list[pa.Table] = []
        tokens = 0
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            whole = pa.compute.equal(rows.column("length"), capacity)
            full = rows.filter(whole)
            if full.num_rows:
                yield windows(full, list(range(full.num_rows)))
            held.append(rows.filter(pa.compute.invert(whole)))
            tokens += pa.compute.sum(held[-1].column("length")).as_py() or 0
            while tokens >= 2 * batch_tokens:  # so the last batch is no small one either
                table = pa.concat_tables(held)
                n = int(np.searchsorted(np.cumsum(np.asarray(table.column("length"))), batch_tokens)) + 1
                part, rest = table.slice(0, n), table.slice(n)
                yield windows(part, spread(part.column("length").to_pylist(), capacity))
                held, tokens = [rest], pa.compute.sum(rest.column("length")).as_py() or 0
        table = pa.concat_tables(held) if held else None
        if table is not None and table.num_rows:
            yield windows(table, spread(table.column("length").to_pylist(), capacity))

    kind = docs.schema[key].dataType.simpleString()
    columns = ["doc", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]
    schema = PIECES.format(id=kind) + (", ids array<int>" if with_ids else "") + ", sequence_id long, offset long, padding long"
    dealt = cuts.select(*columns).repartition(tasks, "doc", "start").sortWithinPartitions("doc", "start", "ids_crc32")
    return dealt.mapInArrow(build, schema).withColumnRenamed("doc", key)

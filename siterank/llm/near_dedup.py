"""Near duplicates by a chosen-path similarity join over word shingles.

Each document is a set of shingles and a sketch of minwise values. Trees of documents are grown from the sketches:
a node's documents go to one child for each chosen minwise value that they share, small nodes are compared pair by
pair, and independent trees are repeated until a pair at the wanted similarity is missed with a chance below
MISS. Pairs whose sketches are alike are candidates; links are candidates confirmed on the full sets. Documents with
one and the same set are one point from the start, so copies are never paired.

Where many documents are all alike a node does not come apart. Its core, the documents like its middle one, is tied
to that one, and branching goes on with those that are not nearly the same as the middle; a link lies in one of the
two. Cores that share documents are a crowd. Once the links found so far are joined to components, every document
of a crowd outside of its largest component is compared with all of other components on the full sets, in blocks of
bounded size, and only links that join components go out. Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siterank.llm.bitmap import bitmap, holds, slot
from siterank.llm.components import connected
from siterank.llm.files import slices, small_batches
from siterank.llm.tokens import bytes_of, mix, shingle_sets
from siterank.sources.staging import stage

WIDTH, SIMILARITY = 5, 80  # words of a shingle; percent of the union that must be common
PLACES = 64  # minwise values of a sketch, 16 bits each
MISS = 1e-6  # chance to miss a pair at the wanted similarity
LEAF = 64  # a node of at most so many documents is compared pair by pair
DENSE = 0.5  # a node whose largest child keeps more than this share may not come apart
CORE, REST = 0.4, 0.85  # its core agrees with the middle from this share on; below that share documents go on
DEEPEST = 12
NODE_ROWS = 100_000  # a larger first-level node is branched by further shuffles before it goes to a task
SPLITS = 4
OUTSIDERS, OTHERS = 512, 4096  # documents of a crowd that one task compares with each other

_draw = np.random.default_rng(64)
_XOR = _draw.integers(0, 2**32, PLACES, dtype=np.uint32)
_TIMES = _draw.integers(0, 2**32, PLACES, dtype=np.uint32) | np.uint32(1)
_ROOT = _draw.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)

SKETCH = "id {id}, size int, k1 long, k2 long, roots array<long>, sketch binary"


def plan(similarity: int) -> tuple[int, int, float]:
    """(children chosen per node, trees, share of a sketch that must agree) for a similarity in percent. How many of
    the sketch's places agree is binomial, and below their roots all trees branch on these places: with a share of p
    agreeing, a path dies out with chance q = (1 - p + p q) ** children. Too few agreeing places, and no tree that
    keeps the pair, summed over the numbers of agreeing places, have at most half of MISS each."""
    s = min(0.999, similarity / 100)
    children = max(2, ceil(1.6 / s))
    chance = [comb(PLACES, j) * s**j * (1 - s) ** (PLACES - j) for j in range(PLACES + 1)]
    least = max([1, *(j for j in range(PLACES + 1) if sum(chance[:j]) <= MISS / 2)])
    missed = []  # by one tree
    for j in range(PLACES + 1):
        p, q = j / PLACES, 0.0
        for _ in range(200):
            q = (1 - p + p * q) ** children
        missed.append((1 - s + s * q) ** children)
    trees, most = 1, len(_ROOT) // children
    while trees < most and sum(c * m**trees for c, m in zip(chance[least:], missed[least:])) > MISS / 2:
        trees += 1
    return children, trees, least / PLACES


def sketches(docs: DataFrame, key: str, text: str, width: int, similarity: int) -> DataFrame:
    """(id, size, k1, k2, roots, sketch) per row of docs: number of distinct shingles, two hashes of the whole set,
    the first-level nodes of all trees and the sketch. Texts without a word have size 0."""
    children, trees, _ = plan(similarity)
    roots = children * trees
    kind = docs.schema[key].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body"):
            tokens, first = shingle_sets(*bytes_of(batch.column("body")), width)
            size = np.diff(first)
            full = np.flatnonzero(size)
            starts = first[:-1][full]
            whole = np.zeros((2, len(size)), np.int64)
            root = np.zeros((len(size), roots), np.int64)
            sketch = np.zeros((len(size), PLACES), np.uint16)
            if len(full):
                mixed = mix(tokens + np.uint64(1))
                whole[0, full] = np.add.reduceat(mixed, starts).view(np.int64)
                whole[1, full] = np.add.reduceat(mix(mixed), starts).view(np.int64)
                short = (mixed >> np.uint64(32)).astype(np.uint32)
                for k in range(PLACES):
                    low = np.minimum.reduceat((short ^ _XOR[k]) * _TIMES[k], starts)
                    sketch[full, k] = (low * np.uint32(0x9E3779B1)) >> np.uint32(16)
                for k in range(roots):
                    low = np.minimum.reduceat(mixed * _ROOT[k], starts)
                    root[full, k] = mix(low + np.uint64(k)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), pa.array(size, pa.int32()), pa.array(whole[0]), pa.array(whole[1]),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(0, (len(size) + 1) * roots, roots, dtype=np.int32)), pa.array(root.ravel())
                    ),
                    pa.array([x.tobytes() for x in sketch], pa.binary()),
                ],
                names=["id", "size", "k1", "k2", "roots", "sketch"],
            )

    body = F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body")
    return docs.select(F.col(key).alias("id"), body).mapInArrow(build, SKETCH.format(id=kind))


def _nodes(points: DataFrame, limit: int) -> DataFrame:
    """(node, id, size, sketch): the first-level nodes of all trees. A node of more than `limit` documents is
    branched on two minwise values, again if need be; one that stays too large is laid out in blocks of two
    parts each, so that any two of its documents share a block."""
    rows = points.select("id", "size", "sketch", F.explode("roots").alias("node"))
    done = None
    for depth in range(SPLITS + 1):
        large = stage(
            rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit), "large-nodes"
        )
        if large.isEmpty():
            break
        small = rows.join(large, "node", "left_anti").select("id", "size", "sketch", "node")
        done = small if done is None else done.unionByName(small)
        rest = rows.join(large, "node")
        if depth < SPLITS:
            one = F.pmod("node", F.lit(PLACES)).cast("int")
            two = F.pmod(one + 1 + F.pmod(F.shiftright("node", 8), F.lit(PLACES - 1)), F.lit(PLACES)).cast("int")
            child = lambda at: F.xxhash64("node", at, F.substring(F.col("sketch"), at * 2 + 1, F.lit(2)))
            rows = rest.select("id", "size", "sketch", F.explode(F.array(child(one), child(two))).alias("node"))
        else:
            parts = F.ceil(F.col("n") * 2 / limit)
            mine = F.pmod(F.xxhash64("id"), parts)
            blocks = F.transform(
                F.sequence(F.lit(0).cast("long"), parts - 1),
                lambda j: F.xxhash64("node", F.least(mine, j), F.greatest(mine, j)),
            )
            rows = rest.select("id", "size", "sketch", F.explode(blocks).alias("node"))
    return rows if done is None else done.unionByName(rows.select("id", "size", "sketch", "node"))


class _Node:
    """The documents of one first-level node, in one task."""

    def __init__(
        self, ids: np.ndarray, sizes: np.ndarray, sketch: np.ndarray, similarity: int, children: int, least: int
    ):
        self.ids, self.sizes, self.sketch, self.similarity = ids, sizes.astype(np.int64), sketch, similarity
        self.children, self.least = children, least
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray, bool]] = []
        self.cores: list[tuple[int, np.ndarray]] = []

    def alike(self, rows: np.ndarray) -> None:
        """Note the pairs of rows whose sketches and sizes are alike."""
        for at in range(0, len(rows), 64):
            a = rows[at : at + 64]
            same = (self.sketch[a][:, None, :] == self.sketch[rows][None, :, :]).sum(axis=2, dtype=np.uint16)
            i, j = np.nonzero(same >= self.least)
            x, y, same = a[i], rows[j], same[i, j]
            low, high = np.minimum(self.sizes[x], self.sizes[y]), np.maximum(self.sizes[x], self.sizes[y])
            keep = (self.ids[x] < self.ids[y]) & (low * 100 >= high * self.similarity)
            self.found.append((self.ids[x[keep]], self.ids[y[keep]], same[keep], False))

    def compare(self, seed: int) -> None:
        """Branch down to small nodes and cores, and note what is alike there."""
        stack = [(np.arange(len(self.ids)), seed, 0, ())]
        while stack:
            rows, seed, depth, used = stack.pop()
            if len(rows) <= LEAF or depth >= DEEPEST:
                self.alike(rows)
                continue
            parts, chosen = [], []
            for k in range(self.children):
                free = [c for c in range(PLACES) if c not in used and c not in chosen]
                seed = int(mix(np.array([seed + k], np.uint64))[0])
                if free:
                    chosen.append(free[seed % len(free)])
            for c in chosen:
                order = rows[np.argsort(self.sketch[rows, c], kind="stable")]
                cut = np.flatnonzero(np.diff(self.sketch[order, c])) + 1
                parts += [(p, c) for p in np.split(order, cut) if len(p) > 1]
            if max((len(p) for p, _ in parts), default=0) > DENSE * len(rows):
                first = self.middle(rows)
                same = (self.sketch[rows] == self.sketch[first]).sum(axis=1)
                core = same >= CORE * PLACES
                if core.sum() >= len(rows) / 4:
                    self.cores.append((first, rows[core]))
                    rest = rows[same < REST * PLACES]
                    if len(rest) > 1:
                        stack.append((rest, int(mix(np.array([seed], np.uint64))[0]), depth, used))
                    continue
            for p, c in parts:
                child = int(mix(np.array([seed ^ (c << 17) ^ int(self.sketch[p[0], c])], np.uint64))[0])
                stack.append((p, child, depth + 1, (*used, c)))

    def tie(self) -> None:
        """Put cores that share documents together and tie each such group to the middle of its largest core, so a
        document has one tie however often its core turned up."""
        group, parent = np.full(len(self.ids), -1), []

        def find(g: int) -> int:
            while parent[g] != g:
                parent[g] = g = parent[parent[g]]
            return g

        for n, (_, rows) in enumerate(self.cores):
            parent.append(n)
            for g in np.unique(group[rows]):
                if g >= 0:
                    parent[find(int(g))] = n
            group[rows] = n
        by_group: dict[int, tuple[int, np.ndarray]] = {}
        for n, (first, rows) in enumerate(self.cores):
            g = find(n)
            if g not in by_group or len(rows) > len(by_group[g][1]):
                by_group[g] = first, rows
        final = np.array([find(int(g)) if g >= 0 else -1 for g in group])
        for g, (first, _) in by_group.items():
            rows = np.flatnonzero((final == g) & (np.arange(len(final)) != first))
            same = (self.sketch[rows] == self.sketch[first]).sum(axis=1)
            self.found.append((np.full(len(rows), self.ids[first]), self.ids[rows], same, True))

    def middle(self, rows: np.ndarray) -> int:
        """The document that has most of the values which are the most frequent of their place."""
        score = np.zeros(len(rows), np.int64)
        for c in range(PLACES):
            _, of, n = np.unique(self.sketch[rows, c], return_inverse=True, return_counts=True)
            score += of == np.argmax(n)
        best = rows[score == score.max()]
        return int(best[np.argmin(self.ids[best])])


def _scan(rows: DataFrame, by: str, visit, schema: str) -> DataFrame:
    """Deal out the rows by a long and call visit with the rows of each value that has two or more."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(by).to_numpy()
            cut = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
            for low, high in zip(cut.tolist(), cut[1:].tolist()):
                if keys[low] != now:
                    if sum(b.num_rows for b in held) > 1:
                        yield from visit(pa.Table.from_batches(held).combine_chunks())
                    now, held = int(keys[low]), []
                held.append(batch.slice(low, high - low))
        if sum(b.num_rows for b in held) > 1:
            yield from visit(pa.Table.from_batches(held).combine_chunks())

    return rows.repartition(by).sortWithinPartitions(by).mapInArrow(scan, schema)


def candidates(nodes: DataFrame, similarity: int) -> DataFrame:
    """(a, b, same, star): pairs whose sketches agree in `same` places, from small nodes; as star, the ties of cores
    to their middle documents, those of too little agreement included."""
    children, _, alike = plan(similarity)  # once, not in every node
    least = ceil(alike * PLACES)

    def visit(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        sketch = bytes_of(rows.column("sketch").combine_chunks())[0].view(np.uint16).reshape(rows.num_rows, PLACES)
        here = _Node(rows.column("id").to_numpy(), rows.column("size").to_numpy(), sketch, similarity, children, least)
        here.compare(rows.column("node")[0].as_py() & (2**64 - 1))
        here.tie()
        if here.found:
            a, b, same = (np.concatenate([f[i] for f in here.found]).astype(np.int64) for i in range(3))
            star = np.concatenate([np.full(len(f[0]), f[3]) for f in here.found])
            cells = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b), same, star]), axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells[0]), pa.array(cells[1]), pa.array(cells[2], pa.int32()), pa.array(cells[3].astype(bool))],
                names=["a", "b", "same", "star"],
            )

    return _scan(nodes.select("node", "id", "size", "sketch"), "node", visit, "a long, b long, same int, star boolean")


CELLS = 1 << 23  # cells of the table of common shingles that a task has at a time


def _joining(
    out_roots: np.ndarray, out_tokens: list[np.ndarray], roots: np.ndarray, tokens: list[np.ndarray], similarity: int
) -> Iterator[tuple[int, int]]:
    """Links (outsider, other) between different components, by the full sets, as far as they join components."""
    names, of = np.unique(np.concatenate([out_roots, roots]), return_inverse=True)
    parent = list(range(len(names)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    words, place = np.unique(np.concatenate(tokens), return_inverse=True)
    lengths = np.array([len(t) for t in tokens])
    first = np.append(0, np.cumsum(lengths))
    step = max(1, min(64, CELLS // max(1, len(words))))
    block = max(1, CELLS // step)  # shingles of others that are looked up at a time
    for low in range(0, len(out_tokens), step):
        mine = out_tokens[low : low + step]
        has = np.zeros((len(words), len(mine)), np.uint8)
        for k, own in enumerate(mine):
            at = np.minimum(np.searchsorted(words, own), len(words) - 1)
            has[at[words[at] == own], k] = 1
        sizes = np.array([len(t) for t in mine])
        start = 0
        while start < len(tokens):
            end = max(start + 1, int(np.searchsorted(first, first[start] + block, side="right")) - 1)
            part = has[place[first[start] : first[end]]]
            common = np.add.reduceat(part, first[start:end] - first[start], axis=0, dtype=np.int32)
            j, k = np.nonzero(100 * common >= similarity * (lengths[start:end, None] + sizes[None, :] - common))
            for x, y in zip((k + low).tolist(), (j + start).tolist()):
                a, b = find(int(of[x])), find(int(of[len(out_tokens) + y]))
                if a != b:
                    parent[a] = b
                    yield x, y
            start = end


def crowd_links(members: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Links (u, v) that join components within crowds. members: (crowd, id, root).

    Outsiders, the documents that are not in the crowd's largest component, meet all others of other components, in
    blocks of at most about OUTSIDERS x OTHERS documents each."""
    sizes = members.groupBy("crowd", "root").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("crowd").agg(
        F.max(F.struct("n", "root"))["root"].alias("main"), F.sum("n").alias("all"), (F.sum("n") - F.max("n")).alias("out")
    ).filter("out > 0")
    rows = members.join(main, "crowd").withColumns(
        {"outs": F.ceil(F.col("out") / OUTSIDERS), "others": F.ceil(F.col("all") / OTHERS), "h": F.xxhash64("id")}
    )
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    outsiders = rows.filter("root <> main").withColumn("o", F.pmod("h", F.col("outs"))).withColumn("a", each("others"))
    others = rows.withColumn("a", F.pmod("h", F.col("others"))).withColumn("o", each("outs"))
    met = outsiders.select("crowd", "o", "a", "id", "root", F.lit(True).alias("outside")).unionByName(
        others.select("crowd", "o", "a", "id", "root", F.lit(False).alias("outside"))
    )
    met = met.join(sets, "id").select(F.xxhash64("crowd", "o", "a").alias("block"), "id", "root", "outside", "tokens")

    def visit(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        outside = rows.column("outside").to_numpy(zero_copy_only=False)
        ids, roots, held = rows.column("id").to_numpy(), rows.column("root").to_numpy(), rows.column("tokens").combine_chunks()
        one, two = np.flatnonzero(outside), np.flatnonzero(~outside)
        if len(one) and len(two):
            sets_of = lambda at: [np.frombuffer(held[int(i)].as_buffer(), np.uint64) for i in at]
            links = list(_joining(roots[one], sets_of(one), roots[two], sets_of(two), similarity))
            if links:
                u, v = (np.array(c) for c in zip(*links))
                yield pa.RecordBatch.from_arrays([pa.array(ids[one[u]]), pa.array(ids[two[v]])], names=["u", "v"])

    return _scan(met, "block", visit, "u long, v long")


def full_sets(docs: DataFrame, ids: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(id, tokens) of the documents named in ids, and of few others that a bitmap lets through."""
    bits = bitmap(ids.select(slot(F.col("id")).alias("s")), "s")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(holds(bits.value, batch.column("s").to_numpy())))
            for part in slices(iter([batch]), "body"):
                tokens, first = shingle_sets(*bytes_of(part.column("body")), width)
                rows = [tokens[x:y].tobytes() for x, y in zip(first, first[1:])]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(rows, pa.binary())], names=["id", "tokens"])

    rows = docs.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).cast("long").alias("id"), slot(F.col(key).cast("long")).alias("s"), F.col(text).cast("binary").alias("body")
    )
    return rows.mapInArrow(build, "id long, tokens binary").dropDuplicates(["id"])


def confirm(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs, as (u, v), whose full sets are similar."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                one, two = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.concatenate([one, two])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= similarity * (len(both) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_())).rename_columns(["u", "v"])

    rows = pairs.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("x")), "a")
    rows = rows.join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("y")), "b")
    return rows.select("a", "b", "x", "y").mapInArrow(check, "u long, v long")


def near_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, similarity: int = SIMILARITY,
    node_rows: int = NODE_ROWS,
) -> DataFrame:
    """One row per document: the key column, n_shingles, component_id (the smallest id reachable by links, its own
    included) and kept (it is that one).

    Words are runs without white space, A-Z in lower case; a document's set are its distinct shingles of `width`
    words, with fewer words all of them as one. Links join documents whose common shingles are at least `similarity`
    percent of all. NULL, empty and blank texts have no shingles and no link. Rows that repeat an id are one
    document. Ids are whole numbers; rows with a NULL id get a NULL component and are not kept. Empty tables give no
    rows, other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    rows = stage(sketches(docs, key, text, width, similarity), "sketches")
    known = rows.filter((F.col("size") > 0) & F.col("id").isNotNull()).withColumn("id", F.col("id").cast("long"))
    points = stage(
        known.groupBy("k1", "k2").agg(
            F.min("id").alias("id"), F.first("size").alias("size"), F.first("roots").alias("roots"), F.first("sketch").alias("sketch")
        ),
        "points",
    )
    nodes = _nodes(points, node_rows)
    found = stage(candidates(nodes, similarity), "candidates")
    pairs = stage(found.groupBy("a", "b").agg(F.max("same").alias("same"), F.max("star").alias("star")), "pairs")
    sets = stage(full_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")), key, text, width), "sets")

    # first every document's most similar candidate, and of the middle documents it is tied to the most similar
    least = ceil(plan(similarity)[2] * PLACES)
    either = pairs.filter(F.col("same") >= least)
    either = either.unionByName(either.select(F.col("b").alias("a"), F.col("a").alias("b"), "same", "star"))
    rank = F.struct("same", (-F.col("b")).alias("low"))
    best = either.groupBy("a").agg(F.max(rank).alias("one"), F.max(F.when(F.col("star"), rank)).alias("two"))
    best = best.select("a", F.explode(F.array("one", "two")).alias("to")).filter("to is not null")
    early = best.select(F.least("a", -F.col("to.low")).alias("a"), F.greatest("a", -F.col("to.low")).alias("b")).distinct()
    early = stage(early, "early")
    links = stage(confirm(early, sets, similarity), "links")
    roots = stage(connected(links), "roots")

    # then all other candidates whose two documents are not connected yet, and the crowds
    open_ = pairs.filter(~F.col("star")).join(early, ["a", "b"], "left_anti").select("a", "b")
    one, two = (roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
    open_ = open_.join(one, "a", "left").join(two, "b", "left")
    open_ = open_.filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
    late = confirm(open_, sets, similarity)
    ties = pairs.filter("star").select(F.col("a").alias("u"), F.col("b").alias("v"))
    if not ties.isEmpty():
        members = connected(ties).select(F.col("root").alias("crowd"), F.col("node").alias("id"))
        members = members.join(roots.select(F.col("node").alias("id"), "root"), "id", "left")
        members = stage(members.withColumn("root", F.coalesce("root", "id")), "members")
        late = late.unionByName(crowd_links(members, sets, similarity))
    roots = connected(links.unionByName(late))

    of_point = points.select("k1", "k2", F.col("id").alias("point")).join(
        roots.select(F.col("node").alias("point"), "root"), "point", "left"
    ).select("k1", "k2", F.coalesce("root", "point").alias("root"))
    own = F.when(F.col("size") > 0, F.col("root")).otherwise(F.col("id").cast("long"))
    component = F.when(F.col("id").isNotNull(), own)
    return rows.join(of_point, ["k1", "k2"], "left").select(
        F.col("id").alias(key), F.col("size").cast("long").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id").cast("long") == component, F.lit(False)).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without the rows that near_groups does not keep; all columns stay. Rows without an id stay."""
    gone = near_groups(docs, key, text, **options).filter(~F.col("kept") & F.col(key).isNotNull()).select(key)
    return docs.join(gone.distinct(), key, "left_anti").select(*docs.columns)

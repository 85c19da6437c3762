"""Exact and near duplicates, and components, against brute force."""

import math
import re
from collections import defaultdict
from itertools import combinations

import pytest

from siterank.llm import near_dedup
from siterank.llm.components import connected
from siterank.llm.exact_dedup import drop_copies, exact_groups
from siterank.llm.near_dedup import drop_near_copies, near_groups

SF = "/root/testdata/sf0.001"


def by_id(rows, *names):
    return {r["doc_id"]: tuple(r[n] for n in names) for r in rows}


def grouped(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    return {i: (min(g)[1], len(g)) for g in groups.values() for _, i in g}


@pytest.mark.parametrize("options", [{}, {"capacity": 20, "key_bits": 6, "first_depth": 1}])
def test_exact_groups(spark, options):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert by_id(exact_groups(docs, **options).collect(), "keep_id", "group_size") == grouped(rows)


def test_exact_odd_rows(odd, none):
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_groups(odd).collect()]
    assert sorted(got, key=str) == sorted(
        [(1, 1, 3, True), (1, 1, 3, True), (None, 1, 3, False), (2, 4, 4, False), (3, 4, 4, False), (4, 4, 4, True),
         (None, 4, 4, False), (5, 5, 1, True), (6, 6, 1, True), (7, 7, 1, True), (8, 8, 1, True), (9, 9, 1, True)], key=str)
    left = drop_copies(odd)
    assert left.columns == odd.columns and sorted(r.doc_id for r in left.collect()) == [1, 4, 5, 6, 7, 8, 9]
    assert exact_groups(none).count() == 0 and drop_copies(none).count() == 0


def components_of(rows, width, similarity=80):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a, b in combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= similarity * (len(sets[a]) + len(sets[b]) - common):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


@pytest.mark.parametrize("width, node_rows", [(2, near_dedup.NODE_ROWS), (5, 6)])
def test_near_groups(spark, width, node_rows):
    """With six rows to a node, first-level nodes are branched by shuffles and laid out in blocks."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = near_groups(docs, width=width, node_rows=node_rows).collect()
    assert by_id(got, "n_shingles", "component_id", "kept") == components_of(rows, width)


def test_a_node_that_does_not_come_apart(spark):
    """300 variants of one text: far more than a leaf, in a chain of components that only full comparison joins."""
    words = [f"t{i}" for i in range(60)]
    rows = []
    for i in range(300):
        own = list(words)
        for k in range(i % 4):
            own[(7 * i + 13 * k) % 60] = f"v{i}x{k}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = by_id(near_groups(docs, width=2).collect(), "n_shingles", "component_id", "kept")
    assert got == components_of(rows, 2)


def test_near_odd_rows(odd, none):
    got = near_groups(odd, width=2).collect()
    assert by_id([r for r in got if r.doc_id is not None], "n_shingles", "component_id", "kept") == {
        1: (5, 1, True), 2: (0, 2, True), 3: (0, 3, True), 4: (0, 4, True), 5: (59_999, 5, True), 6: (60_000, 5, False),
        7: (4, 7, True), 8: (1, 8, True), 9: (2, 9, True)}
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, False)] * 2
    left = drop_near_copies(odd, width=2)
    assert left.columns == odd.columns and left.count() == 11 and near_groups(none).count() == 0


def test_connected(spark):
    chain = [(i, i + 1) for i in range(50, 90)] + [(3, 90), (7, 7), (200, 201), (201, 200), (None, 5)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 3 for i in [3, *range(50, 91)]} | {200: 200, 201: 200}


def test_summed_chance_to_miss_a_pair():
    """Places of the sketch that agree are shared by all trees, so the chances are summed over their number."""
    children, trees, share = near_dedup.plan(80)
    total = 0.0
    for j in range(near_dedup.PLACES + 1):
        chance, p, q = math.comb(near_dedup.PLACES, j) * 0.8**j * 0.2 ** (near_dedup.PLACES - j), j / near_dedup.PLACES, 0.0
        for _ in range(300):
            q = (1 - p + p * q) ** children
        total += chance * (1 if j < share * near_dedup.PLACES else (0.2 + 0.8 * q) ** children) ** trees
    assert total <= near_dedup.MISS

"""Decontamination, packing and the whole pipeline."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from siterank.llm import packing
from siterank.llm.decontaminate import contaminated, drop_contaminated
from siterank.llm.exact_dedup import exact_groups
from siterank.llm.queries import tokenizer
from siterank.llm.tokens import bytes_of, shingle_sets

SF = "/root/testdata/sf0.001"
QUESTION = "Alice has 5 apples and buys 12 km of rope in Paris . Then Alice sells 5 apples and walks 3 km home with Carla."


def leaks(docs, items):
    """Verbatim containment, letter case and outer punctuation apart."""
    words = lambda t: [x for x in (re.sub(r"^[\W_]+|[\W_]+$", "", w) for w in (t or "").lower().split()) if x]
    windows = lambda w, n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    out = set()
    for i, t in docs:
        own = words(t)
        for j, q in items:
            item = words(q)
            n = min(5, len(item))
            places = [tuple(item[k : k + n]) for k in range(len(item) - n + 1)]
            there = windows(own, n)
            if n and sum(p in there for p in places) >= 0.8 * len(places):
                out.add((i, j))
    return out


def test_verbatim_leaks(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, items).collect()}
    want = leaks([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got == want and got


def test_changed_parameters(spark, odd, none):
    rows = [
        (1, "Foo bar. " + QUESTION + " The end", "as it is"), (2, "NOISE " + QUESTION.upper() + "!!", "capitals"),
        (3, "Dave has 7 apples and buys 9 miles of rope in London . Then Dave sells 7 apples and walks 30 miles home with Erik.", "changed"),
        (4, "Dave has 7 apples and buys 9 miles of rope in London . Then Fred sells 8 apples and walks 30 feet home with Erik.", "inconsistent"),
        (5, "Dave has apples , he buys rope in London and walks home .", "clean"), (6, " ".join(["the"] * 50), "clean"), (None, QUESTION, "no id"), (None, "x", "no id"),
        (7, "tiny item", "short"), (7, "tiny item", "short"), (8, None, "none"), (9, QUESTION.replace("apples", "pears", 1), "one word"),
        (12, QUESTION.replace("rope", "twine"), "one word"),
    ]
    docs = spark.createDataFrame(rows, "doc_id int, text string, id string")
    items = spark.createDataFrame([(10, QUESTION), (10, QUESTION), (11, None), (12, ""), (13, "Tiny item!"), (14, "!? ,")], "item_id int, text string")
    got = {(r.doc_id, r.item_id): r.reparameterised for r in contaminated(docs, items).collect()}
    # the fourth word lies in 4 of 20 windows, which leaves 0.8; the tenth in 5, which leaves 0.75
    assert got == {(1, 10): False, (2, 10): False, (3, 10): True, (None, 10): False, (7, 13): False, (9, 10): False}
    left = drop_contaminated(docs, items)
    assert left.columns == docs.columns and sorted((r.doc_id for r in left.collect()), key=str) == [12, 4, 5, 6, 8, None]
    assert contaminated(none, items).count() == 0 and contaminated(docs, items.limit(0)).count() == 0
    assert drop_contaminated(odd, items).count() == 12


def test_few_ordinary_words(spark):
    pairs = [
        ("What is 12 + 30 + 45 + 60?", "What is 13 + 31 + 44 + 62?", "What was 13 + 31 + 44 + 62?"),
        ("Compute 3 + 4", "Compute 5 + 9", "Guess 5 + 9"),
        ("The Sum Of 12 And 30 Is Less Than 50", "The Sum Of 13 And 31 Is Less Than 60", "The Root Of 13 Or 31 Was More Than 60"),
        ("how far is it by train from Paris to Lyon?", "how far is it by train from New York to Salt Lake City?", "how far was it by car from New York to Rome?"),
        ("add up 3 4 5 6 7 8 9 10 11 12 and halve it", "add up 4 5 6 7 8 9 10 11 12 13 and halve it", "add up 4 5 6 7 8 9 10 11 12 13 or cube that"),
        ("please sort 9 8 7 6 5 4 3", "please sort 8 6 4 2 1 3 5", "please add 8 6 4 2 1 3 5"),
        ("Alice owes 30 to Bob", "Carla owes 50 to Jean Luc", "Carla pays 50 for Jean Luc"),
    ]
    items = spark.createDataFrame([(i, p[0]) for i, p in enumerate(pairs)] + [(99, "71 82 93 104 115")], "item_id int, text string")
    docs = [(f"{i} {k}", f"some words before it. {t} And more after.") for i, p in enumerate(pairs) for k, t in enumerate(p)]
    docs.append(("none", "Nothing but 1 2 3 4 5 6 in here."))
    got = {(r.doc_id, r.item_id): r.reparameterised for r in contaminated(spark.createDataFrame(docs, "doc_id string, text string"), items).collect()}
    assert got == {(f"{i} {k}", i): k == 1 for i in range(len(pairs)) for k in (0, 1)}


def test_shingles_are_those_of_the_words():
    texts = [b"", b" \n", b"One", b"one TWO", b"\x0bone\x0ctwo\r", b"a b a b", b"x" * 9000 + b" y", b"a\x1cb c", "é É".encode()]
    tokens, first = shingle_sets(*bytes_of(pa.array(texts, pa.binary())), 2)
    sets = [frozenset(tokens[a:b].tolist()) for a, b in zip(first, first[1:])]
    assert [len(s) for s in sets] == [0, 0, 1, 1, 1, 2, 1, 1, 1]
    assert sets[3] == sets[4] and len(set(sets)) == 7


def packed_right(rows, texts):
    """Every id in one piece, no gaps, no sequence too long."""
    encoder = packing.Encoder(tokenizer())
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for i, text in texts.items():
        ids = np.array([*encoder.slow.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            at += r.length
            assert r.ids_crc32 == zlib.crc32(ids[r.start : at].tobytes())
        assert at == len(ids)
    padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and {r.padding for r in own} == {0 if at & (at - 1) == 0 else 2048 - at}
        padding += own[0].padding
    return padding


def test_packing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = packing.pack(docs, tokenizer()).collect()
    padding = packed_right(rows, {r.doc_id: r.text for r in docs.collect()})
    assert padding < 0.03 * sum(r.length for r in rows)


def test_packing_odd_rows(odd, none):
    own = odd.dropDuplicates(["doc_id"]).filter("doc_id is not null")
    rows = packing.pack(own, tokenizer(), with_ids=True).collect()
    packed_right(rows, {r.doc_id: r.text for r in own.collect()})
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    assert packing.pack(odd, tokenizer()).filter("doc_id is null").count() == 2 and packing.pack(none, tokenizer()).count() == 0


@pytest.mark.parametrize("text", ["<|endoftext|>", "a\u2003b\u00a0c", "\x1c\x85", "it's 12 o'clock…", "日本語 text", "ſ ÿ ¿qué?  \n\n x", "x" * 5000])
def test_both_encoders_give_the_same_ids(text):
    encoder = packing.Encoder(tokenizer())
    assert encoder.fast
    assert encoder.ids(text).tolist() == encoder.slow.encode(text, add_special_tokens=False).ids


def test_differencing():
    assert packing.spread([]) == [] and packing.spread([7]) == [0]
    of = packing.difference([8, 7, 6, 5, 4], 2)  # the textbook case: 16 against 14
    assert sorted(np.bincount(of, weights=[8, 7, 6, 5, 4])) == [14, 16]
    sizes = np.random.default_rng(0).integers(1, 513, 700).tolist()
    filled = np.bincount(packing.spread(sizes), weights=sizes)
    assert filled.max() <= 2048 and filled.sum() == sum(sizes) and len(filled) <= 1.03 * sum(sizes) / 2048 + 1
    assert len(np.unique(packing.spread([1100] * 10))) == 10  # no two fit: the windows rise to the number of pieces


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontaminate", "packing"]
    steps = [docs]
    for _, function in corpus_pipeline.STAGES[:-1]:
        steps.append(function(spark, steps[-1], SF).cache())
        assert steps[-1].columns == docs.columns
    kept = [{r.doc_id: r.text for r in s.select("doc_id", "text").collect()} for s in steps]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    lost = set(kept[0]) - set(kept[1])
    assert sum(labels.get(i) == 1 for i in lost) <= 1 and sum(labels.get(i) == 0 for i in kept[1]) <= 1
    assert set(kept[2]) == {r.doc_id for r in exact_groups(steps[1]).collect() if r.kept}
    from tests.llm.test_exact_and_near import components_of

    assert set(kept[3]) == {i for i, (_, _, own) in components_of(kept[2].items(), 5).items() if own}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(kept[4]) == set(kept[3]) - {i for i, _ in leaks(kept[3].items(), items)}
    packed_right(corpus_pipeline.run(spark, SF).collect(), kept[4])

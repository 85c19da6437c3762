"""Quality, language and language model: held-out accuracy, brute force for the counts, odd rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siterank.llm import language, lm, quality
from siterank.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_quality_of_held_out_documents(spark):
    got = QUERIES["op3_quality"](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = got.join(labels, "doc_id").filter("held_out").collect()
    assert got.count() == 1000 and sum(r.predicted == r.quality for r in rows) >= 0.97 * len(rows)


def test_gradient_is_that_of_the_loss():
    r = np.random.default_rng(0)
    x, doc, y = r.random((9, quality.WIDTH)).astype(np.float32), np.repeat([0, 1, 2], 3), np.array([0, 1, 1], np.float32)
    model, weight = quality.Attention(), np.ones(3, np.float32)

    def loss():
        p = model.forward(x, doc, 3)["y"].astype(float)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grad = model.gradient(x, doc, y, weight)
    for name in model.names:
        at = np.unravel_index(np.argmax(np.abs(grad[name])), grad[name].shape)
        old = model.p[name][at]
        model.p[name][at] = old + 1e-2
        up = loss()
        model.p[name][at] = old - 1e-2
        slope = (up - loss()) / 2e-2
        model.p[name][at] = old
        assert math.isclose(slope, grad[name][at], rel_tol=0.05, abs_tol=1e-4), name


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 1), (7, 0), (8, None), (None, 0), (99, 0)], "doc_id long, quality int")
    scored = quality.score(odd, quality.train(odd, labels))
    assert scored.columns == [c for c in odd.columns if c != "score"] + ["score"]
    rows = scored.collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(none, quality.train(none, labels.limit(0))).count() == 0
    alike = quality.train(odd, labels.filter("quality = 1"))
    assert {r.score for r in quality.score(odd, alike).collect()} == {1.0}


def test_language_of_held_out_documents(spark):
    got = QUERIES["op5_language"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = got.filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    sure = [r for r in rows if r.accepted]
    assert len(sure) >= 0.9 * len(rows) and sum(r.lang == r.lang_pred for r in sure) >= 0.99 * len(sure)


def test_language_odd_rows(odd, none):
    known = language.train(odd)
    assert [n for n, _ in known] == ["en", "de", "fr"] and all(len(d) <= language.DICTIONARY_BYTES for _, d in known)
    rows = language.identify(odd, known).collect()
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert len(rows) == 12 and und == {2, 3, 4, 7, None} and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows if r.doc_id in (5, 6)} == {"en"}
    assert language.identify(none, known).count() == 0
    assert {r.lang_pred for r in language.identify(odd, language.train(none)).collect()} == {"und"}


def test_dictionaries_take_pieces_of_all_chosen_texts(spark):
    """Every one of the chosen texts gives the same number of bytes, from anywhere in it; repeated rows count once."""
    head = "header " * 2000
    rows = [(1, head + " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}q" for _ in range(2000)), "en") for i in range(200)]
    rows += [(7, "wieder und wieder", "de")] * 2001 + [(8, "noch ein text", "de")]
    known = dict(language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    words = known["en"].decode().split()
    assert len(known["en"]) >= 0.99 * language.DICTIONARY_BYTES
    assert len({w for w in words if w.endswith("q") and len(w) == 3}) > 30  # prefixes would all be the header
    assert sorted(known["de"].split()) == sorted(b"wieder und wieder noch ein text".split())


@pytest.mark.parametrize("known", [lm.KNOWN, 50])
def test_language_model_counts(spark, known, monkeypatch):
    """With 50 known words nearly all are looked up by the join."""
    monkeypatch.setattr(lm, "KNOWN", known)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    held_out = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    words = {r.doc_id: (r.text or "").encode().lower().split() + [None] for r in docs.collect()}
    counts = Counter(w for i, own in words.items() if not held_out(i) for w in own)
    n, v = sum(counts.values()), len(counts)
    rows = lm.score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0).collect()
    assert len(rows) == len(words)
    for r in rows:
        own = words[r.doc_id]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
    held = [r for r in rows if held_out(r.doc_id)]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_model_is_normalised_and_learns():
    counts = np.zeros((lm.ENTRIES, lm.ENTRIES))
    counts[0, 5], counts[5, 6], counts[5, 7], counts[6, 0], counts[7, 0] = 2000, 1500, 500, 1500, 500
    table = lm.train(counts)
    assert np.allclose(np.exp(table).sum(axis=1), 1)
    assert abs(np.exp(table[5, 6]) - 0.75) < 0.05 and np.exp(table[0, 5]) > 0.9


def test_words_and_classes_share_out_all_probability(spark):
    """Over known words and, in every class, one unknown word, the probabilities after a context add up to 1."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    counts = lm.count_words(docs)
    words = lm.gather_words(counts, docs.count())
    table, total = np.exp(lm.train(np.ones((lm.ENTRIES, lm.ENTRIES)))[3]), 0.0
    heads = set(words.heads.view(np.int64).tolist())
    used = np.zeros(lm.CLASSES)
    for r in counts.collect():
        if r["hash"] not in heads:
            used[r["class"]] += (r["n"] + lm.SMOOTH) / words.masses[r["class"]]
    used += lm.SMOOTH / words.masses
    total = table[0] + table[1 : 1 + lm.CLASSES] @ used + table[1 + lm.CLASSES :].sum()
    assert abs(total - 1) < 1e-6


def test_language_model_grows_with_its_text(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0
    words = lm.gather_words(lm.count_words(docs), docs.count())
    size = len(words.core)
    assert size == 1 + lm.CLASSES + len(words.heads) == math.ceil(4 * math.sqrt(words.tokens)) > lm.ENTRIES
    sent = spark.sparkContext.broadcast(words)
    pairs = lm.neighbour_pairs(docs, sent).cache()
    top = pairs.agg(F.sum("n"), F.max("before"), F.max("entry")).first()
    assert tuple(top) == (words.tokens, size - 1, size - 1) and lm.core_counts(pairs, sent).sum() == words.tokens
    context, target, bias, sums = lm.learn_vectors(pairs, sent)
    p = np.exp((context[::100] @ target.T + bias - sums[::100, None]).astype(float))
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4)
    held = lambda: lm.score(docs, learn).filter(~learn).agg(F.sum("score")).first()[0]
    grown = held()
    monkeypatch.setattr(lm, "GROWTH", 0)
    assert grown > held()


def test_language_model_odd_rows(odd, none):
    rows = lm.score(odd, F.col("doc_id") != 5).collect()
    assert sorted(r.n_tokens for r in rows if r.doc_id in (2, 3, 4)) == [1, 1, 1] and len(rows) == 12
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert lm.score(none, F.lit(True)).count() == 0
    untrained = lm.score(odd.limit(3), F.lit(False)).collect()
    assert all(r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in untrained)

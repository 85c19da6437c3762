"""Mixing, conversation repair and phrase mining beside plain versions of them."""

import hashlib
import itertools
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from siterank.llm import repair
from siterank.llm.mixing import mix, shares
from siterank.llm.phrases import collocations, grouped, leaves, nodes, strongest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes: dict, weights=(5, 2, 1), share=1.5, most=2) -> dict:
    """Targets by filling up, source by source."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, full = sum(sizes.values()) * share, set()
    while True:
        rest = [s for s in names if s not in full]
        level = (budget - sum(most * sizes[s] for s in full)) / sum(weight[s] for s in rest) if rest else 0
        above = {s for s in rest if most * sizes[s] < weight[s] * level}
        if not above:
            return {s: most * sizes[s] if s in full else weight[s] * level for s in names}
        full |= above


def check_mix(rows, docs, packet=128):
    sizes = Counter()
    for _, text, source in docs:
        sizes[source] += len(WORD.findall(text or ""))
    goal, taken = plain_targets(sizes), Counter()
    assert sorted((r.doc_id is None, r.doc_id, r["size"]) for r in rows) == sorted((d is None, d, len(WORD.findall(t or ""))) for d, t, _ in docs)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert abs(r.target - goal[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert sum(taken.values()) == int(1.5 * sum(sizes.values()))
    for s, t in goal.items():
        assert abs(taken[s] - t) <= packet * (1 + len(goal)), (s, t, taken[s])


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(1)
    docs = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 5, 60, 3000]))), rng.choice([None, "", "a", "é", "z"] + ["hot"] * 4)) for i in range(120)]
    docs += [(7, "x y z", "a")] * 3 + [(None, None, None), (None, "one two", "only")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    first = shares(df).collect()
    check_mix(first, docs)
    assert sorted(map(str, first)) == sorted(map(str, shares(df.repartition(5)).collect()))
    rows, entries = mix(df, packet=16)
    order = entries.orderBy("_position").collect()
    at = 0
    for a, b in zip(order, order[1:] + [None]):  # the mix has no gap and goes on in virtual time
        assert a["_position"] == at and (b is None or a["_finish"] <= b["_finish"])
        at += a["_words"]


def test_mix_of_odd_tables(odd, none):
    rows = shares(odd, source="lang").collect()
    check_mix(rows, [(r.doc_id, r.text, r.lang) for r in odd.select("doc_id", "text", "lang").collect()])
    assert shares(none, source="lang").collect() == []


def test_mix_without_words(odd):
    blank = odd.filter("doc_id in (2, 3, 4)")
    assert {(r["size"], r.target, r.taken) for r in shares(blank, source="lang").collect()} == {(0, 0.0, 0)}


def cheapest(messages):
    """(cost, audit) of the best edits by plain comparison, every gap with no, one or two inserts."""
    due = {0: 2, 1: 2, 2: 3, 3: 2}
    kept = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
    memo = {}

    def best(i, g, inserts):
        key = i, g, inserts
        if key not in memo:
            found = []
            if i == len(messages) and g in (0, 3):
                found.append((0, ""))
            if inserts < 2:
                c, a = best(i, due[g], inserts + 1)
                found.append((c + 5, "I" + a))
            if i < len(messages):
                initial, fault = messages[i]
                cut = 5 if fault == "truncated" else 0
                c, a = best(i + 1, g, 0)
                found.append((c + 2, "D" + a))
                if fault not in ("blank", "duplicate"):
                    c, a = best(i + 1, due[g], 0)
                    found.append((c + cut + 1, "R" + a))
                    if (initial, g) in kept:
                        c, a = best(i + 1, kept[initial, g], 0)
                        found.append((c + cut, "K" + a))
            memo[key] = min(found, default=(10**6, ""))
        return memo[key]

    return best(0, 0, 0)


def plain_repair(rows):
    """What find_repairs and digests give for one conversation: rows of (turn, role, text)."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda m: (m[0] is not None, m[0] or 0, m[1].encode(), hashlib.sha256(m[2].encode()).digest()))
    seen, faults, messages = set(), Counter(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\f\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        faults[fault] += 1
        messages.append((role[:1], fault))
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(messages, messages[1:]))
    cost, audit = cheapest(messages)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    fixed, state, left = [], 0, list(rows)
    for letter in audit:
        if letter == "I":
            state = {0: 2, 1: 2, 2: 3, 3: 2}[state]
            fixed.append(("user" if state == 2 else "assistant") + ":")
            continue
        _, role, text = left.pop(0)
        if letter == "K":
            state = {"s": 1, "u": 2, "a": 3}[role[0]]
            fixed.append(f"{role}:{text}")
        elif letter == "R":
            state = {0: 2, 1: 2, 2: 3, 3: 2}[state]
            fixed.append(("user:" if state == 2 else "assistant:") + text)
    digest = hashlib.sha256("\n".join(fixed).encode()).hexdigest() if fixed else None
    return gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest


def test_no_cheaper_edits_than_all_there_are():
    """Every string of edits of up to three messages, with up to two inserts in each gap."""
    kinds = [(r, f) for r in "suao" for f in (None, "truncated", "blank")]
    weigh = {None: repair.FINE, "truncated": repair.TRUNCATED, "blank": repair.FAULTY}
    for n in range(1, 4):
        for messages in itertools.product(kinds, repeat=n):
            chain = repair._Chain()
            chain.add(repair._block(tuple((r, weigh[f]) for r, f in messages)))
            assert chain.audit() == cheapest(list(messages)), messages


def odd_talks(seed=3):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why", "", " \t", None, "Ok?", "and then", "x" * 50_000 + ".", "é\x1c.", "\x0b."]
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "User"]
    out = [(None, None, None, None), (None, 3, "user", "Hi."), (None, 3, "user", "Hi."), (90, None, "user", "A."), (90, None, "assistant", "B."), (91, 4, "user", "Only.")]
    for conv in range(40):
        turn = 0
        for _ in range(rng.randint(1, 12)):
            out.append((conv, turn if rng.random() < 0.9 else None, rng.choice(roles), rng.choice(texts)))
            turn += rng.choice([0, 1, 1, 1, 2])
    out += [(77, t, "user" if t % 2 == 0 else "assistant", f"{t}." if t % 11 else "cut") for t in range(300)]
    return out


def test_repairs_match_plain_ones(spark):
    talks = odd_talks()
    df = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS cost", "'y' AS audit", "1 AS part", "2 AS place")
    want = {}
    for conv in {t[0] for t in talks}:
        want[conv] = plain_repair([t[1:] for t in talks if t[0] == conv])
    for block in (512, 3):  # whole conversations, and chains of short blocks
        found = repair.find_repairs(df, block=block)
        fixed = repair.repaired(df, found)
        digests = {r.conv_id: r.repaired_sha256 for r in repair.digests(fixed).collect()}
        got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, digests.get(r.conv_id)) for r in found.collect()}
        assert got == want, block
    roles = {}
    for r in fixed.orderBy("place").collect():
        roles.setdefault(r.conv_id, []).append(r.role[0])
    assert all(re.fullmatch("s?(ua)+", "".join(r)) for r in roles.values())


def test_repair_of_an_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    found = repair.find_repairs(df)
    assert found.collect() == [] and repair.digests(repair.repaired(df, found)).collect() == []


def plain_phrases(docs, least, longest=5):
    count, words = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lower):
            ws = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(ws)
            for k in range(1, longest + 1):
                for i in range(len(ws) - k + 1):
                    count[lang, tuple(ws[i : i + k])] += 1
    count = {p: n for p, n in count.items() if n >= least}
    above = Counter()  # the most frequent longer phrase around each
    for (lang, q), n in count.items():
        for k in range(2, len(q)):
            for i in range(len(q) - k + 1):
                above[lang, q[i : i + k]] = max(above[lang, q[i : i + k]], n)
    out = {}
    for (lang, p), a in count.items():
        if len(p) > 1 and above[lang, p] < a:
            score, k = min((1000 * a * words[lang] // (count[lang, p[:k]] * count[lang, p[k:]]), k) for k in range(1, len(p)))
            out[lang, " ".join(p)] = a, count[lang, p[:k]], count[lang, p[k:]], words[lang], score
    return count, out


def phrase_docs():
    rng = random.Random(5)
    vocabulary = ["the", "The", "of", "new", "york", "york-city", "a\x01", "a", "é", "ß", "|", "x" * 5000]
    docs = []
    for _ in range(300):
        ws = rng.choices(vocabulary, [9, 5, 7, 3, 3, 1, 2, 4, 2, 1, 1, 0.02], k=rng.randint(0, 60))
        docs.append(("".join(w + rng.choice([" ", " ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", "\x0b"]) for w in ws), rng.choice(["en", "en", "en", "de", None])))
    return docs + [(None, "en"), ("", None), (" \t ...", "fr"), ("the of the of the of", "")] + [("again and again it goes", "en")] * 30


def test_phrases_match_plain_counting(spark):
    docs = phrase_docs()
    df = spark.createDataFrame(docs, "text string, lang string").selectExpr("*", "1 AS n", "'x' AS phrase", "2 AS words", "'g' AS prefix")
    count, want = plain_phrases(docs, 8)
    sizes, found = leaves(df, least=8)
    for budget in (200_000, 6):  # one group; words and longer prefixes replaced, many groups
        every = {(r.lang, tuple(r.phrase.split(" "))): r.f for r in nodes(found, budget, least=8).collect()}
        assert every == count
    groups = grouped(found, 6).groupBy("group").agg(F.count("*").alias("n"), F.countDistinct("lang", F.expr("substring_index(suffix, ' ', words)")).alias("prefixes"))
    assert groups.count() > 10 and groups.filter("n > 12 and prefixes > 1").isEmpty()
    got = {(r.lang, r.phrase): (r.a, r.l, r.r, r.n, r.score) for r in collocations(df, least=8, budget=6).collect()}
    assert got == want
    top = strongest(collocations(df, least=8), 3).collect()
    for lang in {k[0] for k in want}:
        mine = sorted((-v[4], -v[0], k[1].encode()) for k, v in want.items() if k[0] == lang)[:3]
        assert [r.phrase.encode() for r in sorted(top, key=lambda r: r["rank"]) if r.lang == lang] == [m[2] for m in mine]


def test_phrases_of_odd_tables(spark, odd, none):
    assert collocations(none).collect() == []
    _, want = plain_phrases([(r.text, r.lang) for r in odd.select("text", "lang").collect()], 2)
    assert {(r.lang, r.phrase): (r.a, r.l, r.r, r.n, r.score) for r in collocations(odd, least=2).collect()} == want


def test_scores_beyond_64_bits(spark):
    """1000 a n of a long text passes 2^63 only with counts no test has, so the arithmetic is tested by itself."""
    row = spark.sql(
        "select cast(1000 as decimal(38,0)) * cast(3000000000000 as decimal(38,0)) * cast(20000000000000 as decimal(38,0))"
        " div (cast(3000000000007 as decimal(38,0)) * cast(4000000000001 as decimal(38,0))) as score"
    ).first()
    assert row.score == 1000 * 3000000000000 * 20000000000000 // (3000000000007 * 4000000000001)

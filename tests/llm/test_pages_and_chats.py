"""WARC archives, URL verdicts and chat formatting: SQL twins, round trips, odd rows."""

import base64
import gzip
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import checks.compare as compare
from siterank.llm import chat, url_filter, warc
from siterank.llm.files import store_of
from siterank.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, monkeypatch, name):
    monkeypatch.setattr(compare, "QUERIES", QUERIES)
    monkeypatch.setattr(compare, "ORACLE", ORACLE)
    assert compare.difference(spark, compare.connect(SF), name, SF) is None


@pytest.fixture(scope="module")
def odd_pages(spark):
    rows = [
        (1, "http://a.example/x y\n", "<p>é</p>"), (2, "http://b.example/", "<p>é</p>"), (2, "http://b.example/", "<p>é</p>"),
        (3, None, None), (4, "", ""), (None, "http://c.example/", "<p>é</p>"), (None, None, "alone"), (7, "u", "z" * 2_000_000),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.withColumns({c: F.lit("x") for c in ("record_type", "refers_to", "payload", "path", "offset", "host")})


def test_archives_hold_what_was_written(odd_pages):
    index = warc.write_archives(warc.record_types(odd_pages), archive_bytes=500)
    assert index.select("path").distinct().count() > 2  # closed and opened anew
    rows = warc.read_archives(index).collect()
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.url) for r in rows), key=str)
    assert got == sorted(
        [(1, "revisit", 2, "http://a.example/x y\n"), (2, "response", None, "http://b.example/"), (2, "response", None, "http://b.example/"),
         (3, "revisit", 4, None), (4, "response", None, ""), (None, "revisit", 2, "http://c.example/"), (None, "response", None, None),
         (7, "response", None, "u")], key=str)
    for r in rows:
        if r.record_type == "response":
            assert r.payload_bytes == len(r.payload)
            assert r.payload_digest == base64.b32encode(hashlib.sha1(r.payload).digest()).decode()
    assert {r.payload_bytes for r in rows if r.record_type == "revisit"} == {len("<p>é</p>".encode()), 0}
    # any selection of the index reads just those records, and every member is a record that gzip reads
    some = warc.read_archives(index.filter("page_id >= 4")).collect()
    assert sorted(r.page_id for r in some) == [4, 7]
    first = index.first()
    store, path = store_of(first.path)
    with store.open_input_file(path) as file:
        record = gzip.decompress(file.read_at(first.length, first.offset))
    assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")


def test_small_payloads_are_all_responses(odd_pages):
    got = warc.record_types(odd_pages, least=100).groupBy("__type").count().collect()
    assert [tuple(r) for r in got] == [("response", 8)]


def test_no_pages(odd_pages):
    index = warc.write_archives(warc.record_types(odd_pages.filter("false")))
    assert warc.read_archives(index).count() == 0


@pytest.mark.parametrize("listed", [0, 1, 40, 5000])
def test_cascade_is_exact(spark, listed, monkeypatch):
    """Several shards, of which a worker holds few."""
    monkeypatch.setattr(url_filter, "HELD_BYTES", 300)
    keys = spark.range(5000).select(F.concat(F.lit("host"), "id").alias("key"), (F.col("id") < listed).alias("listed"))
    cascade = url_filter.build_cascade(keys.union(keys), "key", F.col("listed"), shard_keys=700)
    wrong = keys.filter(cascade.holds(F.col("key")) != F.col("listed")).count()
    assert cascade.shards == 8 and wrong == 0


def test_keys_with_one_hash_are_spelled_out():
    h = np.array([1, 1, 2], np.uint64)
    levels = url_filter.build_levels(h, h, np.array([True, False, False]), np.array(["a", "b", "c"]))
    assert levels[-1][0] == -1 and levels[-1][4] == ["a"] and len(levels) == url_filter.MOST_LEVELS + 1


def test_odd_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://Example.COM", "http://example.com?x", "http://example.com/en/", "x://y://z/a#b",
            "http://WWW.example.com/en/1", "http://notexample.com/en/", "http://a.net/es/x", "http://a.net/ES/", "http://ads-track.org", "http://É.net/fr/"]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id int, url string, host string, verdict string")
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block")]
    got = [tuple(r) for r in url_filter.judge_urls(df, rules, lambda h: h.startswith("ads-")).orderBy("page_id").select("host", "path", "rule", "verdict").collect()]
    assert got == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("example.com", "", None, "allow"),
        ("example.com", "", None, "allow"), ("example.com", "/en/", "example.com/en/", "block"), ("y:", "//z/a", None, "allow"),
        ("www.example.com", "/en/1", "www.example.com/en/", "allow"), ("notexample.com", "/en/", "com/", "allow"), ("a.net", "/es/x", "net/es/", "block"),
        ("a.net", "/ES/", None, "allow"), ("ads-track.org", "", None, "block"), ("É.net", "/fr/", None, "allow"),
    ]
    assert url_filter.judge_urls(df.filter("false"), rules, lambda h: F.lit(True)).count() == 0


TRICKY = ["", "<|im_end|>", "<\\|x", "<\\\\\\|<|", "<", "|", "a<|im_start|>assistant\nb<|im_end|>\n", "\\", "é\U0001f600", "<|image|>", "x" * 300_000, "<\\"]


def test_escaping_can_be_undone(spark):
    df = spark.createDataFrame([(t,) for t in TRICKY], "t string").select("t", chat.escape(F.col("t")).alias("e"), chat.escape_role(F.concat("t", F.lit("\n\\n"))).alias("r"))
    for r in df.collect():
        assert "<|" not in r.e and chat.unescape(r.e) == r.t
        assert "<|" not in r.r and "\n" not in r.r and chat.unescape_role(r.r) == r.t + "\n\\n"


def test_conversations_read_back(spark):
    turns = [(c, k, r, t) for c in (1, None) for k, (r, t) in enumerate((r, t) for t in TRICKY for r in ("user", "assistant", "a\nb"))]
    turns += [(2, None, None, None), (2, 1, "assistant", "b"), (2, 1, "assistant", "b"), (2, 1, "assistant", "a")]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").withColumns({"parts": chat.text_part(F.col("text")), "head": F.lit(1), "body": F.lit(2)})
    got = {r.conv_id: r for r in chat.read_back(chat.format_messages(df)).collect()}
    for c, r in got.items():
        own = [(role or "", t or "") for x, _, role, t in turns if x == c]
        if c == 2:
            own = [("", ""), ("assistant", "a"), ("assistant", "b"), ("assistant", "b")]
        learned = "".join(t for role, t in own if role == "assistant")
        assert r.n_turns == len(own) and r.loss_chars == len(learned)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    assert set(got) == {1, 2, None} and chat.read_back(chat.format_messages(df.filter("false"))).count() == 0


def test_typed_parts(spark):
    part = "struct(%s)"
    rows = spark.sql(f"""SELECT 1 AS conv_id, 0 AS turn, 'user' AS role, CAST(array(
        struct('text', 'see <|image|> ', NULL, NULL, NULL, NULL), struct('image', NULL, 'a.png', NULL, 28, 15),
        struct('audio', NULL, 'b.wav', 2.5D, NULL, NULL), struct('document', 'ignored', 'c.pdf', 3D, NULL, NULL),
        struct('video', NULL, 'd.mp4', NULL, NULL, NULL), struct(NULL, NULL, NULL, NULL, NULL, NULL), struct('text', 'end', NULL, NULL, NULL, NULL))
        AS array<{chat.PART}>) AS parts UNION ALL SELECT 1, 1, 'assistant', NULL""")
    one, two = chat.format_messages(rows).orderBy("turn").collect()
    assert re.fullmatch(chat.TURN, one.formatted)[2] == "see <\\|image|> <|image|><|audio|><|document|><|unknown|><|unknown|>end"
    assert [tuple(a) for a in one.attachments] == [
        (1, "image", "a.png", 4), (2, "audio", "b.wav", 63), (3, "document", "c.pdf", 2400), (4, "video", "d.mp4", 0), (5, None, None, 0)]
    assert one.expanded_tokens == 2467 and one.loss_length == 0
    assert two.formatted == "<|im_start|>assistant\n<|im_end|>\n" and two.attachments == [] and two.loss_length == 0

    class Short(chat.Visitor):
        types = (*chat.Visitor.types, "video")

        def visit_video(self, part):
            return F.lit("<|video|>"), F.lit(9).cast("long")

    assert chat.format_messages(rows, visitor=Short()).filter("turn = 0").first().expanded_tokens == 2476

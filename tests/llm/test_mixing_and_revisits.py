from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from tarn.llm import raking, revisits


def test_marginals_reach_their_targets(docs):
    clashing = docs.withColumns({n: F.lit("x") for n in ("_kept", "_lang", "_source", "_topic", "_at_lang", "_gap", "tokens", "weight", "goal_lang", "at", "total")})
    targets = {"source": {"a": 1, "b": 1, "hot": 0.1, "(none)": 1}, "lang": {"en": 2, "de": 1, "fr": 0.0001, "(none)": 1}}
    out = raking.mix(clashing, targets=targets, dimensions=("source", "lang"), tolerance=0.01)
    rows = out.select("_source", "_lang", "_tokens", "_ratio", "_probability", "_gap", "_kept", "tokens", "at", "total").collect()
    assert len(rows) == docs.count() and all(0 <= r._probability <= 1 and r["total"] == r["at"] == r.tokens == "x" for r in rows)
    drawn = sum(r._tokens * r._probability for r in rows)
    assert all(r._gap <= 0.01 for r in rows)
    for level, share in (("a", 1 / 3.1), ("hot", 0.1 / 3.1)):
        assert abs(sum(r._tokens * r._probability for r in rows if r._source == level) / drawn - share) < 0.01


def test_draws_depend_on_the_id_alone_and_keep_the_share(spark):
    df = spark.createDataFrame([(i, "w " * 10, "s", "en") for i in range(4000)], "doc_id long, text string, source string, lang string")
    kept = [r.doc_id for r in raking.mix(df, keep=0.3).filter("_kept").collect()]
    assert abs(len(kept) - 1200) < 120
    assert sorted(kept) == sorted(r.doc_id for r in raking.mix(df.repartition(7), keep=0.3).filter("_kept").collect())


@pytest.mark.filterwarnings("ignore:mixing")
def test_targets_that_no_draw_meets_leave_a_gap(spark):
    df = spark.createDataFrame([(i, "w " * 10, "ab"[i % 2], "xy"[i % 2]) for i in range(100)], "doc_id long, text string, source string, lang string")
    out = raking.mix(df, targets={"source": {"a": 1, "b": 3}, "lang": {"x": 3, "y": 1}}, dimensions=("source", "lang"))
    assert out.first()["_gap"] > 0.1 and out.count() == 100


def test_rows_equal_the_sql(spark, unique_docs):
    con = duckdb.connect()
    frame = unique_docs.toPandas()  # noqa: F841
    wanted = sorted(con.sql(raking.mix_sql("frame")).project("doc_id, topic, tokens, kept").fetchall())
    out = raking.mix(unique_docs)
    assert sorted((r.doc_id, r._topic, r._tokens, r._kept) for r in out.collect()) == wanted


def test_bounded_weights_reach_their_targets_with_few_tokens_of_a_level(spark):
    made = [(f"{'many' if i % 20 else 'few'}", "en" if i % 3 else "es", "!!" if i % 10 == 0 else "x") for i in range(3000)]
    df = spark.createDataFrame([(i, "w " * (5 + i % 7) + t, s, lang) for i, (s, lang, t) in enumerate(made)], "doc_id long, text string, source string, lang string")
    rows = raking.mix(df, keep=0.9, tolerance=0.001).collect()
    total, drawn = sum(r._tokens for r in rows), sum(r._tokens * r._probability for r in rows)
    assert 0.2 < drawn / total <= 0.9 and max(r._probability for r in rows) <= 1
    for d in ("_source", "_lang", "_topic"):
        levels = {r[d] for r in rows}
        natural = {x: sum(r._tokens for r in rows if r[d] == x) for x in levels}
        for x in levels:
            target = natural[x] ** 0.7 / sum(n**0.7 for n in natural.values())
            assert abs(sum(r._tokens * r._probability for r in rows if r[d] == x) / drawn / target - 1) < 0.005


def test_empty_table(no_docs):
    assert raking.mix(no_docs).count() == 0


RECORDS = "record_id long, url string, captured_at long, kind string, status int, etag string, last_modified string, digest string, headers map<string,string>"


@pytest.fixture
def records(spark):
    stored = {"Content-Type": "text/html", "ETag": '"a"', "Content-Length": "9"}
    rows = [
        (1, "http://www.Site.example:80/p/?b=2&a=1&utm_x=9#top", 10, "response", 200, '"a"', "m1", "d1", stored),
        (2, "https://site.example/p?a=1&b=2", 20, "response", 200, '"b"', "m2", "d2", stored),
        (3, "https://site.example/p?a=1&b=2", 20, "response", 500, '"z"', "m9", "d9", stored),
        (10, "https://SITE.example/p?a=1&b=2", 15, "revisit", 304, 'W/"a"', None, None, {"etag": '"a"', "Cache-Control": "x", "content-length": "0"}),
        (11, "https://site.example/p?a=1&b=2", 20, "revisit", 304, None, "m1", None, None),
        (12, "https://site.example/p?a=1&b=2", 21, "revisit", 304, None, None, "d2", {}),
        (13, "https://site.example/p?a=1&b=2", 21, "revisit", 304, '"a"', "m2", "d2", {}),
        (14, "https://site.example/p?a=1&b=2", 10, "revisit", 304, '"a"', None, None, {}),
        (15, None, 30, "revisit", 304, '"a"', None, None, {}),
        (16, "https://other.example/", 30, "revisit", 304, '"a"', None, None, {}),
        (17, "https://site.example/p?a=1&b=2", None, "revisit", 304, '"a"', None, None, {}),
        (18, "https://site.example/p?a=1&b=2", 22, "revisit", 304, None, None, None, {}),
        (18, "https://site.example/p?a=1&b=2", 22, "revisit", 304, None, None, None, {}),
    ]
    return spark.createDataFrame(rows, RECORDS).withColumn("canonical_url", F.lit("x")).withColumn("at", F.lit(5))


@pytest.mark.parametrize("slice_rows", [200_000, 2])
def test_outcomes(records, slice_rows):
    found = {r.record_id: r for r in revisits.resolve_revisits(records, slice_rows).collect()}
    assert {i: (r.refers_to, r.outcome) for i, r in found.items()} == {
        10: (1, "etag"), 11: (1, "last-modified"), 12: (2, "digest"), 13: (None, "mismatch"), 14: (None, "no-response"),
        15: (None, "no-url"), 16: (None, "no-response"), 17: (None, "no-response"), 18: (None, "no-validator"),
    }
    assert found[10].headers == {"content-type": "text/html", "content-length": "9", "etag": '"a"', "cache-control": "x"}
    assert found[11].headers["etag"] == '"a"' and found[13].headers is None


def test_a_popular_response_is_copied_for_its_revisits(spark):
    rows = [(0, "http://a.b/", 1, "response", 200, '"e"', None, None, {"k": "v"})] + [(i, "http://a.b/", 1 + i, "revisit", 304, '"e"', None, None, {}) for i in range(1, 60)]
    rows += [(100 + i, f"http://c{i}.d/", 5, "revisit", 304, '"e"', None, None, {}) for i in range(20)]
    found = revisits.resolve_revisits(spark.createDataFrame(rows, RECORDS), hot_rows=10).collect()
    assert len(found) == 79 and sum(r.refers_to == 0 and r.headers == {"k": "v"} for r in found) == 59
    assert all(r.outcome == "no-response" for r in found if r.record_id >= 100)


def test_repeated_rows_and_empty(records):
    assert revisits.resolve_revisits(records).filter("record_id = 18").count() == 2
    assert revisits.resolve_revisits(records.limit(0)).count() == 0

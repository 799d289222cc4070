import datetime
import json

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import titles
from tidemark.sources import readers
from tidemark.streaming import state

T0 = datetime.datetime(2024, 1, 1)


def run_stream(spark, tmp_path, df, build, mode="append"):
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = build(stream).writeStream.outputMode(mode).format("memory").queryName("got").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table("got").collect()


def test_first_seen(spark, tmp_path):
    df = spark.createDataFrame([("a", T0), ("a", T0), ("b", T0)], "id string, ts timestamp")
    assert sorted(r["id"] for r in run_stream(spark, tmp_path, df, lambda s: state.first_seen(s, ["id"], "ts"))) == ["a", "b"]


def test_ewma_state_equals_the_recursion(spark, tmp_path):
    rows = [("k", i, float(i % 3)) for i in range(6)] + [("j", 0, 5.0), ("j", 1, None)]
    df = spark.createDataFrame(rows, "k string, step long, x double")
    got = run_stream(spark, tmp_path, df, lambda s: state.ewma_state(s, "k", "step", "x", 0.5))
    assert [r["level"] for r in sorted((r for r in got if r["k"] == "k"), key=lambda r: r["step"])] == state.ewma([float(i % 3) for i in range(6)], 0.5)
    assert [r["level"] for r in got if r["k"] == "j"] == [5.0]


def test_json_lines_counts(spark, tmp_path):
    at = tmp_path / "x.jsonl"
    at.write_text("\n".join([json.dumps({"a": 1}), "", "not json", "[1]", json.dumps({"a": None})]))
    rows = readers.json_lines(spark, str(at), "a int")
    c = readers.json_counters(rows).first()
    assert (c["lines"], c["empty_lines"], c["invalid_lines"]) == (5, 1, 2)


def test_merge_releases(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert readers.merge_releases(a, b, ["k"]).count() == 2


def test_text_functions(spark):
    df = spark.createDataFrame([("HTTP://www.Ex.com/a/?b=2&utm_source=q&a=1#f", "<p>a&amp;b</p>\n c", "--1,234.5", "A12")], "u string, h string, n string, e string")
    r = df.select(tx.canonical_url(F.col("u")), tx.clean_html(F.col("h")), tx.vendor_number(F.col("n")), tx.entity_code(F.col("e"))).first()
    assert tuple(r) == ("http://www.ex.com/a?a=1&b=2", "a&b c", -1234.5, "000012")


def test_similar_titles(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rows = [(1, " ".join(words)), (2, " ".join(words[:9] + ["other"])), (3, "Alpha! beta gamma delta epsilon zeta eta theta iota kappa"), (4, "nothing like it")]
    got = {(r["key"], r["other"]) for r in titles.similar_titles(spark.createDataFrame(rows, "id int, t string"), "id", "t", 0.8).collect()}
    assert got == {(1, 3), (1, 2)} or got == {(1, 3)}
    near = titles.similar_titles(spark.createDataFrame(rows, "id int, t string"), "id", "t", 0.7)
    assert {(r["key"], r["other"]) for r in near.collect()} == {(1, 3), (1, 2)}


def test_addresses_and_references(spark):
    urls = {
        "HTTPS://Ex.com/A/?z=1&utm_x=2&source=q&a=b%20c&Ref=1#top": "https://ex.com/A?a=b+c&z=1",
        "http://ex.com": "http://ex.com",
        "http://ex.com/?k": "http://ex.com?k=",
        "/only/path/": "/only/path",
        "": "",
    }
    d = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r[0]: r[1] for r in d.select("u", tx.canonical_url(F.col("u"))).collect()} == urls
    h = spark.createDataFrame([("&lt;b&gt;x&eacute;&nbsp;&#39;y&#39;<i>z</i>",), ("plain  text",), (None,)], "h string")
    assert [r[0] for r in h.select(tx.clean_html(F.col("h"))).collect()] == ["xé 'y' z", "plain text", None]

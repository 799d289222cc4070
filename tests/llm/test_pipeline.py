import os

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.written(stage(spark, docs, SF), name)
        seen[name] = out.count()
        if name != "packing":
            assert out.columns == first.columns
        docs = out
    assert seen["toxicity"] >= 0.8 * first.count() and seen["near_copies"] <= seen["toxicity"]
    assert seen["pii"] == seen["near_copies"] <= seen["mixing"]
    per = docs.groupBy("sequence_id").sum("length").collect()
    assert all(r[1] <= 2048 for r in per)


ODD = "doc_id long, text string, lang string, source string, n_chars long, row int, n int, whole string"


def odd_rows():
    words = "quiet river stone garden window letter paper morning silver bridge".split()
    rows = [(i, " ".join(words[(i * 7 + j * (i + 3)) % 10] + str((i + j) % 5) for j in range(30)), "en", "s" if i % 3 else None, 100, 1, 2, "w") for i in range(40)]
    rows += [(None, "a text without an id, with a@b.example in it", None, None, None, None, None, None), (100, None, "en", "s", 0, 1, 2, "w"), (101, "", "en", "s", 0, 1, 2, "w"), rows[3], rows[3], ((1 << 60) + 1, "a long id", "en", "s", 9, 1, 2, "w")]
    return rows


@pytest.mark.parametrize("empty", [False, True])
def test_stages_take_odd_rows_and_empty_tables(spark, tmp_path, empty):
    docs = spark.createDataFrame([] if empty else odd_rows(), ODD)
    spark.createDataFrame([] if empty else [(i, i % 2, int(i % 8 == 0)) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        rows = out.collect()
        if name == "packing":
            assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns)
            assert empty or {r["doc_id"] for r in rows} >= {None, 100, 101, (1 << 60) + 1}
            continue
        assert out.columns == docs.columns
        if empty:
            assert not rows
        elif name != "toxicity":
            ids = [r["doc_id"] for r in rows]
            # of the null and the empty text, which are equal, the least doc_id stays
            assert {None, 100, (1 << 60) + 1} <= set(ids) and (101 in ids) == (name != "near_copies")
            assert ids.count(3) == (1 if name == "near_copies" else 3) or name == "mixing"
        if name == "pii" and not empty:
            assert "a@b.example" not in next(r["text"] for r in rows if r["doc_id"] is None)

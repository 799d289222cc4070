"""Passages that repeat across documents, by a sparse suffix array.

Suffixes are kept at minimiser places only: two texts that share ``least`` words in a row share
a kept place in them. A kept place is grouped by its first words. Where all of a group have the same words
around, as far as ``least`` words with the first words in them can reach, all of these repeat. In other groups
each stretch of ``least`` words around the place is looked up by the hash of all its words. So every repeated
stretch is found, whatever number of documents share a part of it; overlapping ones of a document are one span.

Rules for odd input: rows without doc_id or text have no spans; rows with one doc_id are one
document; repeats within one document do not count; words are runs of letters and digits in
lower case, so that case, punctuation and spacing do not matter; texts of any length are read whole; of several partners the
least doc_id is named; an empty table gives no rows; columns other than doc_id and text, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, lean, rolling, table, text_chunks, words_of, written
from .seeds import seeds_of, shared, sliding


def windows_at(docs: DataFrame, places: DataFrame, least: int, k: int) -> DataFrame:
    """key, doc and place of every ``least`` words in a row whose minimiser is at one of the places (doc, place)."""
    asks = places.groupBy("doc").agg(F.collect_set("place").alias("places"))
    top = np.iinfo(U64).max

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            texts = pdf["text"].tolist()
            for a, b in text_chunks(texts, texts):
                words = words_of(texts[a:b])
                if len(words.hash) < least:
                    continue
                r = rolling(words.hash, k)
                at = [words.off[i] + np.asarray(x, dtype=np.int64) for i, x in enumerate(pdf["places"].iloc[a:b])]
                at = np.concatenate(at)
                at = at[at < len(r)]
                asked = np.full(len(r), top, dtype=U64)
                asked[at] = r[at]
                wide = least - k + 1
                s = np.flatnonzero(sliding(asked, wide, np.minimum) == sliding(r, wide, np.minimum))
                owner = np.searchsorted(words.off, s, "right") - 1
                inside = s + least <= words.off[owner + 1]
                s, owner = s[inside], owner[inside]
                key = rolling(words.hash, least)[s]
                yield pd.DataFrame({"key": key.view(np.int64), "doc": pdf["doc"].to_numpy()[a:b][owner], "place": (s - words.off[owner]).astype(np.int32)})

    rows = docs.select(F.col("doc_id").alias("doc"), "text").where("text is not null").join(asks, "doc")
    return rows.mapInPandas(lean(run), "key long, doc long, place int")


def repeats(docs: DataFrame, least: int = 50) -> DataFrame:
    """doc_id, start, end (word indices, end exclusive), n_words and other_doc (the least partner)
    of each span of a document that other documents repeat."""
    window = least // 2
    k = least - window + 1
    kept = written(shared(written(seeds_of(docs, k, window, around=window - 1), "suffixes")), "kept")
    mixed = written(kept.groupBy("key").agg(F.min("context").alias("c"), F.max("context").alias("d")).where("c != d").select("key"), "mixed")
    alike = kept.join(mixed, "key", "left_anti")
    rest = kept.join(mixed, "key", "left_semi").select("doc", "place")
    found = shared(written(windows_at(docs, rest, least, k), "windows"))
    spans = alike.select(F.col("doc").alias("doc_id"), "other", "start", "end").union(
        found.select("doc", "other", "place", F.col("place") + least)
    )
    w = Window.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    merged = spans.withColumn("new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int")).withColumn("span", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return merged.groupBy("doc_id", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("other").alias("other_doc")).select(
        "doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), (F.col("end") - F.col("start")).cast("long").alias("n_words"), "other_doc"
    )


def op7_suffix_array_repeats(spark, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))

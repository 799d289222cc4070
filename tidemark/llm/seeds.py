"""Minimiser seeds of texts and what shares them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, lean, mix64, power_tables, rolling, text_chunks, words_of, written, written_at


def sliding(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over every w consecutive entries, by doubling."""
    size = 1
    while size * 2 <= w:
        x = op(x[: len(x) - size], x[size:])
        size *= 2
    if size < w:
        rest = w - size
        x = op(x[: len(x) - rest], x[rest:])
    return x


def minimisers(w: np.ndarray, off: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the k-grams of words that are least in some window of ``window``
    consecutive ones of their text; two texts that share window + k - 1 words in a row share one.
    Texts with fewer words have none."""
    r = rolling(w, k)
    n = len(r)
    if n < window:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U64)
    low = sliding(r, window, np.minimum)
    at = np.arange(len(low))
    # a window lies in one text when its last word does
    last = np.searchsorted(off, at, "right")
    inside = at + window + k - 1 <= off[np.minimum(last, len(off) - 1)]
    low = np.where(inside, low, U64(0))
    pad = np.zeros(window - 1, dtype=U64)
    high = sliding(np.concatenate([pad, low, pad]), window, np.maximum)
    keep = np.flatnonzero((high == r) & (high > 0))
    return keep, r[keep]


def ranks(owner: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many equal keys of the same owner come before each entry, and how many there are; owners ascend."""
    o = np.lexsort((key, owner))
    new = np.append(True, (owner[o][1:] != owner[o][:-1]) | (key[o][1:] != key[o][:-1]))
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(o)))
    before, times = np.empty(len(o), dtype=np.int64), np.empty(len(o), dtype=np.int64)
    before[o] = np.arange(len(o)) - np.repeat(first, n)
    times[o] = np.repeat(n, n)
    return before, times


def ordered_seeds(docs: DataFrame, k: int, window: int) -> DataFrame:
    """key, doc, place (word index), i (number of the seed in its text), again (equal seeds before it there)
    and times (equal seeds there)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            ids, texts = pdf["doc_id"].to_numpy(), pdf["text"].tolist()
            for a, b in text_chunks(texts, texts):
                words = words_of(texts[a:b])
                place, key = minimisers(words.hash, words.off, k, window)
                if not len(place):
                    continue
                owner = np.searchsorted(words.off, place, "right") - 1
                i = np.arange(len(place)) - np.searchsorted(owner, owner, "left")
                again, times = ranks(owner, key)
                out = {"place": place - words.off[owner], "i": i, "again": again, "times": times}
                yield pd.DataFrame({"key": key.view(np.int64), "doc": ids[a:b][owner]} | {c: x.astype(np.int32) for c, x in out.items()})

    return docs.select("doc_id", "text").where("doc_id is not null and text is not null").mapInPandas(lean(run), "key long, doc long, place int, i int, again int, times int")


def seeds_of(docs: DataFrame, k: int, window: int, around: int = 0) -> DataFrame:
    """doc, place (word index), key and, for around > 0, start and end of the stretch with up to so many
    words on both sides of the k-gram, and context: a hash of its words and of the place in it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            ids, texts = pdf["doc_id"].to_numpy(), pdf["text"].tolist()
            for a, b in text_chunks(texts, texts):
                words = words_of(texts[a:b])
                place, key = minimisers(words.hash, words.off, k, window)
                if not len(place):
                    continue
                owner = np.searchsorted(words.off, place, "right") - 1
                first = words.off[owner]
                out = {"key": key.view(np.int64), "doc": ids[a:b][owner], "place": (place - first).astype(np.int32)}
                if around:
                    power, inverse = power_tables(len(words.hash) + 1)
                    cum = np.append(U64(0), np.cumsum(words.hash * power[: len(words.hash)], dtype=U64))
                    start, end = np.maximum(place - around, first), np.minimum(place + k + around, words.off[owner + 1])
                    lengths = ((place - start) << 32 | (end - place)).astype(U64)
                    out["start"], out["end"] = (start - first).astype(np.int32), (end - first).astype(np.int32)
                    out["context"] = mix64((cum[end] - cum[start]) * inverse[start] ^ mix64(lengths)).view(np.int64)
                yield pd.DataFrame(out)

    more = ", start int, end int, context long" if around else ""
    return docs.select("doc_id", "text").where("doc_id is not null and text is not null").mapInPandas(lean(run), f"key long, doc long, place int{more}")


def shared(rows: DataFrame) -> DataFrame:
    """The rows whose key has another document, with other: the least such one. No key's rows
    are gathered: the two least documents of a key are grouped minima."""
    two = written(rows.groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").drop("high"), "shared")
    got = written(rows.join(two, "key"), "rows")
    second = got.where("doc > low").groupBy("key").agg(F.min("doc").alias("second"))
    least = got.where("doc = low").join(second, "key").withColumn("other", F.col("second")).drop("low", "second")
    return least.unionByName(got.where("doc > low").withColumnRenamed("low", "other"))


def _both(x: DataFrame, y: DataFrame, on: list[str], when: str) -> DataFrame:
    """Matches (a, b, a < b, and both places in one number) of the rows of x and y that agree in ``on``."""
    j = x.alias("x").join(y.alias("y"), [F.col(f"x.{c}") == F.col(f"y.{c}") for c in on]).where(f"x.doc != y.doc and ({when})")
    first = F.col("x.doc") < F.col("y.doc")
    at = lambda p, q: F.shiftleft(F.col(p).cast("long"), 32).bitwiseOR(F.col(q).cast("long"))
    return j.select(
        F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b"), F.when(first, at("x.place", "y.place")).otherwise(at("y.place", "x.place")).alias("at")
    )


def _stand_ins(hot: DataFrame, n: int) -> DataFrame:
    """For each key the documents that are least by ``n`` hashes; the same documents stand in for many keys."""
    h = [F.min(F.struct(F.xxhash64("doc", F.lit(j)).alias("h"), "doc", "place")).alias(f"s{j}") for j in range(n)]
    got = hot.groupBy("key").agg(*h).select("key", F.explode(F.array(*[f"s{j}" for j in range(n)])).alias("s"))
    return got.select("key", F.col("s.doc").alias("doc"), F.col("s.place").alias("place")).distinct()


def _all_pairs(seeds: DataFrame, block: int) -> list[DataFrame]:
    """Matches of every two documents of each key (with n, its documents). The documents of a key are dealt to blocks of about ``block``, and
    every pair of blocks is a key of its own, so that no task holds a large group."""
    dealt = seeds.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")))
    spread = dealt.withColumn("met", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = lambda own, met: spread.select("key", "doc", "place", "again", "times", F.col("own").cast("int").alias(own), F.col("met").alias(met))
    x, y, on = side("i", "j"), side("j", "i"), ["key", "i", "j"]
    return [
        _both(x, y.where("times = 1"), on, "x.times > 1 or x.doc < y.doc"),
        _both(x.where("times > 1"), y.where("times > 1"), [*on, "again"], "x.doc < y.doc"),
    ]


def matches(seeds: DataFrame, few: int = 32, stand_ins: int = 2, levels: int = 4, whole: bool = False, block: int = 2048) -> tuple[DataFrame, list[str]]:
    """(a, b, at): matches of ordered_seeds, a < b; at holds the place in a above that in b (32 bits each). Also the paths of the tables behind
    them, to be removed when the matches have been used.

    Of a seed that at most ``few`` documents hold, every two of these meet: each place with the only one
    of the other, or, where both have several, the r-th with the r-th. A seed of more documents says little of two of them.
    Each of its places meets ``stand_ins`` documents, and runs of 2, 4, 8 .. 2**levels such seeds in a row are keys
    in turn: every two documents of a run that at most ``few`` hold meet, and those of a longest run that more
    hold meet its stand-ins, with which they share all its words. No step pairs a large group with itself.

    whole: every two documents of every seed meet, in blocks of ``block``, whatever the group's size; that is a square of its documents."""
    # one shuffle of all seeds; a group of one key is counted in a window that spills
    n = F.sum(F.when(F.col("again") == 0, 1).otherwise(0)).over(Window.partitionBy("key"))
    tables = []

    def held(df: DataFrame, name: str) -> DataFrame:
        df, at = written_at(df, name)
        tables.append(at)
        return df

    dealt = held(seeds.withColumn("n", n).where("n > 1"), "met")
    if whole:
        one, several = _all_pairs(dealt, block)
        return one.union(several), tables
    rare = dealt.where(F.col("n") <= few)
    out = [
        _both(rare, rare.where("times = 1"), ["key"], "x.times > 1 or x.doc < y.doc"),
        _both(rare.where("times > 1"), rare.where("times > 1"), ["key", "again"], "x.doc < y.doc"),
    ]
    hot = dealt.where(F.col("n") > few).select("key", "doc", "place", F.col("place").alias("last"), "i")
    out.append(_both(hot, _stand_ins(hot, stand_ins), ["key"], "true"))
    for level in range(levels):
        x, y = hot.alias("x"), hot.alias("y")
        runs = x.join(y, (F.col("x.doc") == F.col("y.doc")) & (F.col("x.i") + (1 << level) == F.col("y.i")))
        runs = held(runs.select(F.xxhash64("x.key", "y.key").alias("key"), "x.doc", "x.place", "y.last", "x.i"), "runs")
        # a run counts once in a document
        once = runs.groupBy("key", "doc").agg(F.min(F.struct("place", "last")).alias("p")).select("key", "doc", "p.place", "p.last")
        often = held(once.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "often")
        part = once.join(often.where(F.col("n") <= few), "key")
        ends = [part.select("key", "doc", F.col(e).alias("place")) for e in ("place", "last")]
        out += [_both(e, e, ["key"], "x.doc < y.doc") for e in ends]
        hot = runs.join(often.where(F.col("n") > few), "key", "left_semi")
        if level == levels - 1:
            ends = [hot.select("key", "doc", F.col(e).alias("place")) for e in ("place", "last")]
            out += [_both(e, _stand_ins(e, stand_ins), ["key"], "true") for e in ends]
    every = out[0]
    for x in out[1:]:
        every = every.union(x)
    return every, tables


def shared_out(asks: DataFrame, most: int = 512) -> DataFrame:
    """doc, slice and asks: the rows of ``asks`` as lists of about ``most``, so that what is asked of one document is no single row."""
    n = asks.groupBy("doc").agg(F.count("*").alias("n"))
    others = [c for c in asks.columns if c != "doc"]
    dealt = asks.join(n, "doc").withColumn("slice", F.pmod(F.xxhash64(*others), F.ceil(F.col("n") / most)))
    return dealt.groupBy("doc", "slice").agg(F.collect_list(F.struct(*others)).alias("asks"))


def surroundings(docs: DataFrame, places: DataFrame, k: int, reach: int) -> DataFrame:
    """doc, place, left and right: eight bits of each of up to ``reach`` words before (nearest first) and behind a seed."""
    asks = shared_out(places, 4096)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            texts = pdf["text"].tolist()
            for a, b in text_chunks(texts, texts):
                words = words_of(texts[a:b])
                h = (words.hash >> U64(56)).astype(np.uint8)
                rows = []
                for i, asked in enumerate(pdf["asks"].iloc[a:b]):
                    lo, hi, doc = int(words.off[i]), int(words.off[i + 1]), pdf["doc"].iloc[a + i]
                    for x in asked:
                        p = lo + x["place"]
                        rows.append((doc, x["place"], h[max(lo, p - reach) : p][::-1].tobytes(), h[p + k : min(hi, p + k + reach)].tobytes()))
                yield pd.DataFrame(rows, columns=["doc", "place", "left", "right"])

    rows = docs.select(F.col("doc_id").alias("doc"), "text").join(asks, "doc").select("doc", "text", "asks")
    return rows.mapInPandas(lean(run), "doc long, place int, left binary, right binary")


def stretches(docs: DataFrame, wanted: DataFrame, flush: int = 8 << 20) -> DataFrame:
    """Word hashes (32 bits) of stretches: wanted has doc, id, side, from, to (word indices, cut to
    the text). Returns id, side, from, words (binary)."""
    asks = shared_out(wanted)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["id", "side", "from", "words"]
        for pdf in frames:
            texts = pdf["text"].tolist()
            for a, b in text_chunks(texts, texts):
                words = words_of(texts[a:b])
                h = (words.hash >> U64(32)).astype(np.uint32)
                rows, size = [], 0
                for i, asked in enumerate(pdf["asks"].iloc[a:b]):
                    lo, hi = words.off[i], words.off[i + 1]
                    for x in asked:
                        f, t = max(0, x["from"]), min(hi - lo, x["to"])
                        rows.append((x["id"], x["side"], f, h[lo + f : lo + t].tobytes()))
                        size += 4 * int(t - f)
                        if size > flush:
                            yield pd.DataFrame(rows, columns=names)
                            rows, size = [], 0
                yield pd.DataFrame(rows, columns=names)

    id_type = wanted.schema["id"].dataType.simpleString()
    rows = docs.select(F.col("doc_id").alias("doc"), "text").join(asks, "doc").select("text", "asks")
    return rows.mapInPandas(lean(run), f"id {id_type}, side int, `from` int, words binary")

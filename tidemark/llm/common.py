"""Shared helpers of the training-data operators: hashing words in numpy,
written tables in the shared folder, folds, and connected components."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_CHUNK = 1 << 20

WORD_LUT = np.zeros(256, dtype=bool)
WORD_LUT[0x80:] = True
for _a, _b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
    WORD_LUT[_a : _b + 1] = True

SPACE_LUT = np.ones(256, dtype=bool)
SPACE_LUT[[0x20, *range(0x09, 0x0E)]] = False


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a local one is only set where none is configured and no cluster is there."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return at or _own.setdefault(spark.sparkContext.applicationId, f"/tmp/checkpoints/{uuid.uuid4().hex}")


TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written_at(df: DataFrame, name: str, compression: str = "snappy") -> tuple[DataFrame, str]:
    """Cut lineage: write ``df`` as Parquet into the shared folder and read it back; with the path.
    The shuffle files of that job go when it has ended, since nothing else reads them."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(TIDY, "false")
    spark.conf.set(TIDY, "true")
    try:
        df.write.option("compression", compression).parquet(at)
    finally:
        spark.conf.set(TIDY, before)
    return spark.read.schema(df.schema).parquet(at), at


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    return written_at(df, name, compression)[0]


def removed(spark: SparkSession, at: str) -> None:
    """Delete a table of this library that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a function of mapInPandas or mapInArrow, giving free memory back to the system when a task
    ends: Python workers stay for later tasks, and what they hold adds to what the next stage takes."""

    def whole(frames: Iterator) -> Iterator:
        yield from run(frames)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return whole


def apart(df: DataFrame, *names: str) -> DataFrame:
    """df with its own columns of these names renamed, by ``_`` behind them, to make room for a result's."""
    for name in names:
        if name in df.columns:
            free = name + "_"
            while free in df.columns:
                free += "_"
            df = df.withColumnRenamed(name, free)
    return df


def exact_id(name: str = "doc_id") -> tuple[Column, Column]:
    """An id without nulls, and no_id where it was null: pandas would make doubles of ids beside a null."""
    return F.coalesce(F.col(name).cast("long"), F.lit(0)).alias(name), F.col(name).isNull().alias("no_id")


def id_again(name: str = "doc_id") -> Column:
    return F.when(~F.col("no_id"), F.col(name)).alias(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id, n: int):
    """crc32 of the id as text, modulo ``n``."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(n))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_powers = np.ones(1, dtype=U64)
_inverse = np.ones(1, dtype=U64)


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, 1 << 20)
        inv = pow(int(_BASE), -1, 1 << 64)
        p, q = np.full(size, _BASE, dtype=U64), np.full(size, U64(inv), dtype=U64)
        p[0] = q[0] = 1
        _powers, _inverse = np.multiply.accumulate(p), np.multiply.accumulate(q)
    return _powers, _inverse


class Words:
    """Words of several texts: ``hash`` of each word, ``start``/``end`` byte places in
    ``data``, and ``off`` with the first word of each text (one more at the end)."""

    def __init__(self, data: np.ndarray, hash_: np.ndarray, start: np.ndarray, end: np.ndarray, off: np.ndarray, doc_at: np.ndarray):
        self.data, self.hash, self.start, self.end, self.off, self.doc_at = data, hash_, start, end, off, doc_at

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))


def words_of(texts: list[str | None], lut: np.ndarray = WORD_LUT, lower: str = "unicode") -> Words:
    """Hash the words of each text. A word is a longest run of bytes that ``lut`` allows.
    lower: "unicode" lower-cases the text, "ascii" A-Z only. Null texts count as empty."""
    if lower == "unicode":
        raw = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    else:
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
    lens = np.fromiter((len(b) + 1 for b in raw), dtype=np.int64, count=len(raw))
    doc_at = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum(lens, out=doc_at[1:])
    data = np.frombuffer(b"\n".join(raw) + b"\n" if raw else b"", dtype=np.uint8)
    if lower == "ascii":
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    ok = lut[data].astype(np.int8)
    step = np.diff(ok, prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    out = np.empty(len(start), dtype=U64)
    p, q = power_tables(min(len(data), _CHUNK) + 1)
    # chunks that begin and end between words; a single longer word gets a chunk of its own
    i = 0
    while i < len(start):
        j = int(np.searchsorted(end, start[i] + _CHUNK, "right"))
        j = max(j, i + 1)
        lo, hi = start[i], end[j - 1]
        n = int(hi - lo)
        if n + 1 > len(p):
            p, q = power_tables(n + 1)
        cum = np.zeros(n + 1, dtype=U64)
        np.cumsum((data[lo:hi].astype(U64) + U64(1)) * p[:n], out=cum[1:])
        s, e = start[i:j] - lo, end[i:j] - lo
        out[i:j] = (cum[e] - cum[s]) * q[s]
        i = j
    off = np.searchsorted(start, doc_at)
    return Words(data, mix64(out), start, end, off, doc_at)


_MULT = mix64(np.arange(1, 65, dtype=U64)) | U64(1)


def rolling(w: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive entries of ``w`` (places after len(w)-k are left out)."""
    n = len(w) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    s = w[:n] * _MULT[0]
    for j in range(1, k):
        s += w[j : n + j] * _MULT[j % 64] if k <= 64 else (w[j : n + j] ^ U64(j)) * _MULT[j % 64]
    return mix64(s)


def shingles_of(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each word shingle, texts ascending. A text of 1 to k-1 words has
    one shingle of all its words; a text without words has none."""
    w, off = words.hash, words.off
    n = np.diff(off)
    r = rolling(w, k)
    owner = words.owner
    at = np.arange(len(r))
    keep = at + k <= off[owner[: len(r)] + 1] if len(r) else np.zeros(0, dtype=bool)
    h, d = r[keep], owner[: len(r)][keep]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        extra = np.empty(len(short), dtype=U64)
        for i, t in enumerate(short):
            x = w[off[t] : off[t + 1]]
            extra[i] = (int((x * _MULT[: len(x)]).sum(dtype=U64)) + len(x) * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF
        h, d = np.concatenate([h, mix64(extra)]), np.concatenate([d, short])
        o = np.argsort(d, kind="stable")
        h, d = h[o], d[o]
    return h, d


def doc_slices(d: np.ndarray, n: int) -> np.ndarray:
    """Offsets of each of n texts within the ascending owners ``d``."""
    return np.searchsorted(d, np.arange(n + 1))


def text_chunks(ids: Iterable, texts: list, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together have about ``limit`` characters."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= limit:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def grouped_stream(frames, keys: list[str]):
    """Groups of a stream of pandas frames that is sorted by ``keys``; a group may span frames."""
    import pandas as pd

    held: list = []
    last = None
    for pdf in frames:
        if not len(pdf):
            continue
        arrays = [pdf[k].to_numpy() for k in keys]
        change = np.zeros(len(pdf), dtype=bool)
        for a in arrays:
            change[1:] |= a[1:] != a[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), len(pdf)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(x[a] for x in arrays)
            piece = pdf.iloc[a:b]
            if held and key != last:
                yield last, held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
                held = []
            held.append(piece)
            last = key
    if held:
        yield last, held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """(node, component): the least node reachable, for every node in an edge.

    Alternating large-star and small-star steps; every step is a grouped minimum and a
    join, and its result is a written table. Ends when a step changes nothing."""
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null and u != v")
    e, at = written_at(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(most):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        j = large.join(low2, "u")
        e, now_at = written_at(
            j.select(F.col("u"), F.col("m").alias("v")).union(j.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u != v").distinct(),
            "edges",
        )
        removed(e.sparkSession, at)
        at = now_at
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    ).groupBy("node").agg(F.min("component").alias("component"))

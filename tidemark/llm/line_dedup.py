"""Lines that many documents share, by sorted hashes.

Every line that is long enough gives one row: 128 bits of hash of its key, document, position. The rows are
range-partitioned by hash, document (descending) and position, so that a line of very many documents
lies in several tasks, and each task streams its rows once: the first document of a hash keeps its lines, and the others lose theirs
as soon as the fifth document has come. Rows of at most four documents wait for that. Only the first and the last hash of
a task can go on in another; their rows are decided by one summary row each, two a task at most. What comes out is
one compressed bitmap of kept lines a document, without any text.

Rules for odd input: a null text counts as empty, and an empty text is one empty line; rows of one doc_id are
one document when documents are counted, and all of them keep the lines of which it is the greatest; rows without
doc_id are together one document below all others; rows that repeat doc_id and text have one bitmap; an empty table gives
no rows; columns other than doc_id and text, whatever their names, are passed through by ``without_shared_lines`` and not read.
Two keys of equal 128-bit hash count as equal.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, exact_id, lean, table, written
from .scans import ranged

STRIPPED = b" \t\n\v\f\r"
ID = ["doc_id", "no_id", "text_id"]
LINES = "doc_id long, no_id boolean, text_id long, pos int, n_lines int, h1 long, h2 long"
VERDICTS = "kind int, h1 long, h2 long, doc_id long, no_id boolean, text_id long, pos int, part int, n_docs long, last_doc long, last_no boolean"
DROPPED, OPEN, SUMMARY = 0, 1, 2


def line_key(line: bytes, least: int) -> bytes | None:
    """The line stripped of ASCII white space, A-Z lower-cased; null if it has fewer than ``least`` code points."""
    if len(line) < least:
        return None
    key = line.strip(STRIPPED).lower()
    if len(key) < least or (len(key) < 4 * least and not key.isascii() and len(key.decode("utf-8", "replace")) < least):
        return None
    return key


def _text_id():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def line_rows(docs: DataFrame, least: int) -> DataFrame:
    """LINES: one row a line with a key, and one a document with position -1 and its number of lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, pos, count, h1, h2 = [], [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                lines = text.split(b"\n")
                owner.append(i), pos.append(-1), count.append(len(lines)), h1.append(0), h2.append(0)
                for j, line in enumerate(lines):
                    key = line_key(line, least)
                    if key is not None:
                        h = xxhash.xxh3_128_intdigest(key)
                        owner.append(i), pos.append(j), count.append(0), h1.append(h >> 64), h2.append(h & 0xFFFFFFFFFFFFFFFF)
            at = pa.array(owner, type=pa.int64())
            halves = [pa.array(np.array(h, dtype=np.uint64).view(np.int64)) for h in (h1, h2)]
            ids = [b.column(c).take(at) for c in ID]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(pos, type=pa.int32()), pa.array(count, type=pa.int32()), *halves], names=["doc_id", "no_id", "text_id", "pos", "n_lines", "h1", "h2"])

    source = docs.select(*exact_id(), _text_id().alias("text_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return source.mapInArrow(lean(run), LINES)


class Verdicts:
    """Streams sorted rows of one task and gives rows of VERDICTS."""

    def __init__(self, part: int, enough: int):
        self.part, self.enough = part, enough
        self.key = self.doc = self.top = None  # hash, latest document and first document of the group at hand
        self.n = 0  # its documents so far
        self.opening = True  # it is the first of the task and may have begun before
        self.held: list[pa.Table] = []  # its rows of later documents while they are too few

    def rows(self, kind: int, rows: pa.Table) -> pa.RecordBatch:
        n = rows.num_rows
        cols = [pa.array(np.full(n, kind, dtype=np.int32)), *(rows.column(c).combine_chunks() for c in ("h1", "h2", "doc_id", "no_id", "text_id", "pos"))]
        cols += [pa.array(np.full(n, self.part, dtype=np.int32)), *(pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.bool_()))]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else c.chunk(0) for c in cols], names=NAMES)

    def summary(self) -> pa.RecordBatch:
        values = [SUMMARY, *self.key, self.top[0], self.top[1], None, None, self.part, self.n, self.doc[0], self.doc[1]]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(values, kinds, strict=True)], names=NAMES)

    def close(self, end: bool) -> Iterator[pa.RecordBatch]:
        """The group at hand is over in this task."""
        if self.key is None:
            return
        if self.opening or end:
            yield self.summary()
            for rows in self.held if end and not self.opening else []:
                yield self.rows(OPEN, rows)
        self.held, self.opening, self.n = [], False, 0

    def feed(self, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches([b])
        h1, h2, doc, no = (b.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "doc_id", "no_id"))
        n = len(h1)
        group = np.ones(n, dtype=bool)
        group[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        other = group.copy()
        other[1:] |= (doc[1:] != doc[:-1]) | (no[1:] != no[:-1])
        starts = np.append(np.flatnonzero(group), n)
        goes_on = self.key == (int(h1[0]), int(h2[0]))
        if self.key is not None and not goes_on:
            yield from self.close(False)
        before = np.cumsum(other)
        rank = before - np.repeat(before[starts[:-1]] - 1, np.diff(starts))
        if goes_on:
            same = (int(doc[0]), bool(no[0])) == self.doc
            rank[: starts[1]] += self.n - int(same)
        # groups that begin and end within the batch are decided together
        final = np.repeat(rank[starts[1:] - 1], np.diff(starts))
        inner = np.ones(n, dtype=bool)
        inner[starts[-2] :] = False
        if goes_on or self.key is None:
            inner[: starts[1]] = False
        gone = np.flatnonzero(inner & (rank > 1) & (final >= self.enough))
        if len(gone):
            yield self.rows(DROPPED, t.take(pa.array(gone)))
        edges = {0: int(starts[1])} if not inner[0] else {}
        edges[int(starts[-2])] = n
        for a, z in edges.items():
            if a > 0 and self.key is not None and self.key != (int(h1[a]), int(h2[a])):
                yield from self.close(False)
            if a > 0 or not goes_on:
                self.key, self.top = (int(h1[a]), int(h2[a])), (int(doc[a]), bool(no[a]))
            self.n, self.doc = int(rank[z - 1]), (int(doc[z - 1]), bool(no[z - 1]))
            if self.opening:
                yield self.rows(OPEN, t.slice(a, z - a))
                continue
            later = t.take(pa.array(np.flatnonzero(rank[a:z] > 1) + a))
            if later.num_rows:
                self.held.append(later)
            if self.n >= self.enough:
                for rows in self.held:
                    yield self.rows(DROPPED, rows)
                self.held = []
        # a group of one batch between the edges closes the task's first one
        if starts[-2] > 0:
            self.opening = False


NAMES = [x.split(" ")[0] for x in VERDICTS.split(", ")]


def verdicts(rows: DataFrame, enough: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Verdicts(TaskContext.get().partitionId(), enough)
        for b in batches:
            if b.num_rows:
                yield from v.feed(b)
        yield from v.close(True)

    order = [F.col("h1"), F.col("h2"), F.col("no_id"), F.col("doc_id").desc(), F.col("text_id"), F.col("pos")]
    return ranged(rows, *order).mapInArrow(lean(run), VERDICTS)


def resolved(summaries: list, enough: int) -> list[tuple]:
    """(h1, h2, enough documents, greatest document) of hashes at the ends of tasks."""
    groups: dict[tuple, list] = {}
    for r in sorted(summaries, key=lambda r: r["part"]):
        groups.setdefault((r["h1"], r["h2"]), []).append(r)
    out = []
    for (h1, h2), rs in groups.items():
        n = sum(r["n_docs"] for r in rs)
        n -= sum((a["last_doc"], a["last_no"]) == (b["doc_id"], b["no_id"]) for a, b in zip(rs[:-1], rs[1:], strict=True))
        out.append((h1, h2, n >= enough, rs[0]["doc_id"], rs[0]["no_id"]))
    return out


def keep_bitmaps(docs: DataFrame, least: int = 40, enough: int = 5) -> DataFrame:
    """doc_id, no_id, text_id, n_lines, n_dropped, keep: a compressed bitmap of the lines that stay, for each document.

    A line goes if its key has ``least`` code points and ``enough`` documents hold it, except in the greatest doc_id."""
    spark = docs.sparkSession
    rows = written(line_rows(docs, least), "lines")
    found = written(verdicts(rows.where("pos >= 0").drop("n_lines"), enough), "verdicts")
    ends = resolved(found.where(F.col("kind") == SUMMARY).collect(), enough)  # two rows a task at most
    known = F.broadcast(spark.createDataFrame(ends, "h1 long, h2 long, many boolean, top long, top_no boolean"))
    late = found.where(F.col("kind") == OPEN).join(known, ["h1", "h2"]).where("many and not (doc_id = top and no_id = top_no)")
    gone = found.where(F.col("kind") == DROPPED).select(*ID, "pos").union(late.select(*ID, "pos"))
    heads = rows.where("pos < 0").select(*ID, F.lit(None).cast("int").alias("pos"), "n_lines")
    both = heads.unionByName(gone.withColumn("n_lines", F.lit(None).cast("int")))
    got = both.groupBy(*ID).agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("gone"))
    return got.select(*ID, F.col("n_lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"), F.pandas_udf(_packed, "binary")("n_lines", "gone").alias("keep"))


def _packed(n_lines: pd.Series, gone: pd.Series) -> pd.Series:
    return pd.Series([pack_bits(int(n), g) for n, g in zip(n_lines, gone, strict=True)])


def pack_bits(n: int, gone) -> bytes:
    keep = np.ones(n, dtype=bool)
    keep[np.asarray(gone, dtype=np.int64)] = False
    return zlib.compress(np.packbits(keep).tobytes())


def kept_lines(text: str, keep: bytes) -> str:
    """The lines of the text whose bits are set, joined again."""
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), dtype=np.uint8))
    return "\n".join(line for line, bit in zip(text.split("\n"), bits, strict=False) if bit)


def _kept(text: pd.Series, keep: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else kept_lines(t, k) for t, k in zip(text, keep, strict=True)], dtype=object)


def without_shared_lines(docs: DataFrame, least: int = 40, enough: int = 5) -> DataFrame:
    """docs with the kept lines as text, in their order of columns, and n_lines and n_dropped as columns ``lines``.*.

    Texts meet their bitmaps by document; a text that loses nothing does not leave the JVM."""
    docs = apart(docs, "lines")
    maps = keep_bitmaps(docs, least, enough).hint("shuffle_hash")
    left = docs.select(F.struct("*").alias("_row"), *exact_id(), _text_id().alias("text_id"))
    j = left.join(maps, ID, "left")
    apply = F.pandas_udf(_kept, "string")
    text = F.when(F.col("n_dropped") > 0, apply(F.when(F.col("n_dropped") > 0, F.col("_row.text")), F.col("keep"))).otherwise(F.coalesce("_row.text", F.lit("")))
    return j.select(*[text.alias("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns], F.struct("n_lines", "n_dropped").alias("lines"))


def op11_line_dedup(spark, sf_dir: str) -> DataFrame:
    got = without_shared_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", F.col("lines.n_lines").alias("n_lines"), F.col("lines.n_dropped").alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP11_SQL = r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
 k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
 g AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
 d AS (SELECT doc_id, i, line, top IS NOT NULL AND doc_id <> top AS gone FROM k LEFT JOIN g USING (key))
 SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM d GROUP BY doc_id"""

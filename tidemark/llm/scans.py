"""Ordered scans whose keys may span tasks.

A table is range-partitioned by key and order, so that the rows of a frequent key lie in several
neighbouring tasks. Each task scans its own sorted rows; what the next task has to know is one
row a task, and is added afterwards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import U64, lean, parts, written

MASK = (1 << 64) - 1


def ranged(df: DataFrame, *order) -> DataFrame:
    """df dealt to tasks by ranges of ``order`` and sorted in each."""
    return df.repartitionByRange(parts(df), *order).sortWithinPartitions(*order)


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(max(n, 1), U64(base & MASK), dtype=U64)
    p[0] = 1
    return np.multiply.accumulate(p)


def scan_runs(key: np.ndarray, x: np.ndarray, base: int, state: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """Of sorted keys: the place of each row in its run of equal keys, and the sum of
    ``x[j] * base**j`` (modulo 2**64) over the rows of its run before it, and with it.
    state: (key, rows, sum) of the run that may go on, (None, 0, 0) at first; comes back for the next call."""
    n = len(key)
    at = np.arange(n)
    first = np.ones(n, dtype=bool)
    first[1:] = key[1:] != key[:-1]
    start = np.maximum.accumulate(np.where(first, at, 0))
    place = at - start
    term = x.astype(np.int64).view(U64) * _powers(base, n)[place]
    upto = np.cumsum(term, dtype=U64)
    upto -= (upto - term)[start]
    before = upto - term
    last, rows, total = state
    if last is not None and last == key[0]:
        on = start == 0
        factor = U64(pow(base, rows, 1 << 64))
        place[on] += rows
        before[on] = U64(total) + factor * before[on]
        upto[on] = U64(total) + factor * upto[on]
    return place, before, upto, (key[-1].item(), int(place[-1]) + 1, int(upto[-1]))


def prefix_sums(df: DataFrame, key: str, order: list[str], x: str, base: int = 1, name: str = "scan") -> DataFrame:
    """df with ``place`` (from 0, within its key by ``order``) and ``before`` and ``upto``: the sums of
    ``x * base**place`` over the key's rows before it, and with it, modulo 2**64. ``key`` and ``x`` are longs without nulls.

    With base 1 these are running sums, with an odd base polynomial fingerprints of every prefix. A key
    that spans tasks gets its offset from one row a task, which is all that the driver sees."""
    added = [T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType()), T.StructField("before", T.LongType()), T.StructField("upto", T.LongType())]
    whole, names = T.StructType([*df.schema.fields, *added]), df.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, state, held = TaskContext.get().partitionId(), (None, 0, 0), None
        for b in batches:
            if not b.num_rows:
                continue
            place, before, upto, state = scan_runs(b.column(key).to_numpy(zero_copy_only=False), b.column(x).to_numpy(zero_copy_only=False), base, state)
            if held is not None:
                yield _with_last(held, False)
            held = _with(b, part=pa.array(np.full(b.num_rows, part, dtype=np.int32)), place=pa.array(place), before=pa.array(before.view(np.int64)), upto=pa.array(upto.view(np.int64)))
        if held is not None:
            yield _with_last(held, True)

    once = written(df, name)
    local = written(ranged(once, key, *order).mapInArrow(lean(scan), T.StructType([*whole.fields, T.StructField("ends", T.BooleanType())])), name)
    # the last row of each task
    ends = {r["part"]: (r[key], r["place"] + 1, r["upto"] & MASK) for r in local.where("ends").select("part", key, "place", "upto").collect()}
    size = max(ends, default=-1) + 1
    carried = [(np.zeros(size, dtype=np.int64), np.zeros(size, dtype=bool)), np.zeros(size, dtype=np.int64), np.zeros(size, dtype=U64), np.ones(size, dtype=U64)]
    now = None
    for p in sorted(ends):
        if now is not None:
            carried[0][0][p], carried[0][1][p], carried[1][p], carried[2][p], carried[3][p] = now[0], True, now[1], U64(now[2]), U64(pow(base, now[1], 1 << 64))
        k, rows, total = ends[p]
        now = (k, now[1] + rows, (now[2] + pow(base, now[1], 1 << 64) * total) & MASK) if now is not None and now[0] == k else (k, rows, total)

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (keys, some), rows, totals, factors = carried
        for b in batches:
            p, k = b.column("part").to_numpy(), b.column(key).to_numpy(zero_copy_only=False)
            on = some[p] & (keys[p] == k) if size else np.zeros(len(p), dtype=bool)
            place, before, upto = (b.column(c).to_numpy().copy() for c in ("place", "before", "upto"))
            if on.any():
                q = p[on]
                place[on] += rows[q]
                for sums in (before.view(U64), upto.view(U64)):
                    sums[on] = totals[q] + factors[q] * sums[on]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(place), pa.array(before), pa.array(upto)], names=[*names, "place", "before", "upto"])

    return local.drop("ends").mapInArrow(lean(shift), T.StructType([f for f in whole.fields if f.name != "part"]))


def _with(b: pa.RecordBatch, **more: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*b.columns, *more.values()], names=[*b.schema.names, *more])


def _with_last(b: pa.RecordBatch, ends: bool) -> pa.RecordBatch:
    flags = np.zeros(b.num_rows, dtype=bool)
    flags[-1] = ends
    return _with(b, ends=pa.array(flags))


def joined_digests(rows: DataFrame, key: list[str], item: str, sep: str = ",", size: int = 4096) -> DataFrame:
    """key, digest: the SHA-256 (lowercase hex) of the items of each key as decimal text, ascending, joined by ``sep``.

    Items are sorted over all tasks and set into texts of about ``size`` bytes where they lie; the texts of a key then
    run through one hash in their order, a batch at a time. Keys and items hold no nulls."""
    fields = [rows.schema[k] for k in key]

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, last, held, length = TaskContext.get().partitionId(), 0, None, [], 0
        done: list[tuple] = []
        for b in batches:
            keys, items = list(zip(*(b.column(k).to_pylist() for k in key), strict=True)), b.column(item).to_pylist()
            for k, v in zip(keys, items, strict=True):
                if held and (k != last or length >= size):
                    done.append((*last, part, seq, sep.join(held)))
                    seq, held, length = seq + 1, [], 0
                last = k
                held.append(str(v))
                length += len(held[-1]) + 1
            if len(done) >= 1024:
                yield _rows(done, out)
                done = []
        if held:
            done.append((*last, part, seq, sep.join(held)))
        if done:
            yield _rows(done, out)

    out = T.StructType([*fields, T.StructField("part", T.IntegerType()), T.StructField("seq", T.LongType()), T.StructField("piece", T.StringType())])
    pieces = ranged(rows.select(*key, item), *key, item).mapInArrow(texts, out)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        last, h = None, None
        done: list[tuple] = []
        for b in batches:
            keys = list(zip(*(b.column(k).to_pylist() for k in key), strict=True))
            for k, piece in zip(keys, b.column("piece").to_pylist(), strict=True):
                if k != last:
                    if h is not None:
                        done.append((*last, h.hexdigest()))
                    last, h = k, hashlib.sha256()
                else:
                    h.update(sep.encode())
                h.update(piece.encode())
            if len(done) >= 8192:
                yield _rows(done, final)
                done = []
        if h is not None:
            done.append((*last, h.hexdigest()))
        if done:
            yield _rows(done, final)

    final = T.StructType([*fields, T.StructField("digest", T.StringType())])
    return pieces.repartition(parts(rows), *key).sortWithinPartitions(*key, "part", "seq").mapInArrow(lean(hashed), final)


def _rows(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    kinds = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.StringType(): pa.string()}
    cols = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, type=kinds[f.dataType]) for c, f in zip(cols, schema.fields, strict=True)], names=schema.names)


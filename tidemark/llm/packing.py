"""Packing of tokenised documents into sequences by cutting-stock column generation.

A document's ids are cut at every ``capacity`` ids; full pieces are sequences of their own and
the rest pieces are packed. Lengths fall into classes of ``grain`` tokens. A linear program over
patterns (how many pieces of each class share a sequence) is solved by column generation: an
unbounded knapsack, solved by dynamic programming, prices new patterns. Rounded-down patterns
come first; what is left of the histogram is filled by further patterns, each the best fit for
the longest length left. Only the histogram (one count a class) is in the driver. Pieces are
ranked within their class and a rank selects the pattern, the sequence and the place.

Rules for odd input: null text counts as empty and has the end id alone; repeated rows are
packed each; rows with null doc_id are packed, too; long texts are cut, never shortened; pieces of one length go by doc_id, start and
checksum; an empty table gives no rows; columns other than doc_id and text, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import exact_id, id_again, lean, table, written

CAPACITY, GRAIN = 2048, 8

_tokenizer: dict = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _same_ids(path: str):
    """A faster encoder with the tokeniser file's own vocabulary: ids are merge ranks and bytes
    are written as printable characters, the rest of them from code point 256 on."""
    import json

    import public_tokenizers
    import tiktoken

    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    spec = json.loads(open(path, encoding="utf-8").read())
    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """ids of texts as little-endian unsigned 32-bit bytes. The pre-tokeniser always parts a text
    before a lone space or line end, so the stretches between them are encoded one by one, by
    an encoder with the same vocabulary that gives the same ids sooner, and the ids of those seen before come from a table of at most ``most`` entries. Texts with other
    white space, or with several white-space characters in a row, are encoded as a whole."""

    def __init__(self, path: str, most: int = 900_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.known: dict[str, bytes] = {}
        self.fast = _same_ids(path)

    def direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    @staticmethod
    def lone(text: str) -> bool:
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or not text or text[0].isspace() or text[-1].isspace():
            return False
        return len(text.split()) == text.count(" ") + text.count("\n") + 1

    def __call__(self, text: str) -> bytes:
        if not self.lone(text):
            return self.direct(text)
        # a stretch after a line end begins with it; all others but the first follow a space
        first, *rest = text.replace("\n", " \n").split(" ")
        known = self.known
        try:
            return self.direct(first) + b"".join([known[p] for p in rest])
        except KeyError:
            pass
        new = [p for p in dict.fromkeys(rest) if p not in known]
        fresh = {}
        for p in new:
            x = p if p[0] == "\n" else " " + p
            fresh[p] = self.direct(x) if "<|" in p else np.array(self.fast.encode_ordinary(x), dtype="<u4").tobytes()
        if len(known) + len(fresh) <= self.most:
            known.update(fresh)
            return self.direct(first) + b"".join([known[p] for p in rest])
        return self.direct(first) + b"".join([known[p] if p in known else fresh[p] for p in rest])


def encoder(path: str) -> Encoder:
    if path not in _tokenizer:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _tokenizer[path] = Encoder(path)
    return _tokenizer[path]


def pieces_of(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens and row_key, which parts repeated rows."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for pdf in frames:
            rows = []
            for doc, no_id, text in zip(pdf["doc_id"].tolist(), pdf["no_id"].tolist(), pdf["text"].tolist(), strict=True):
                ids = enc(text or "") + end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    part = ids[4 * start : 4 * (start + capacity)]
                    rows.append((doc, no_id, start, len(part) // 4, zlib.crc32(part), n))
            yield pd.DataFrame(rows, columns=["doc_id", "no_id", "start", "length", "ids_crc32", "doc_tokens"])
        enc.known.clear()

    got = docs.select(*exact_id(), "text").mapInPandas(lean(run), "doc_id long, no_id boolean, start long, length long, ids_crc32 long, doc_tokens long")
    return got.select(id_again(), "start", "length", "ids_crc32", "doc_tokens")


def price(values: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack over classes 1..room (weight = class): best value and its pattern."""
    best = np.zeros(room + 1)
    last = np.zeros(room + 1, dtype=np.int64)
    v = np.asarray(values, dtype=float)
    for c in range(1, room + 1):
        got = best[c - 1 :: -1][:c] + v[1 : c + 1]
        k = int(got.argmax())
        best[c], last[c] = (got[k], k + 1) if got[k] > best[c - 1] + 1e-12 else (best[c - 1], 0)
    pattern = np.zeros(room + 1, dtype=np.int64)
    c = room
    while c > 0:
        k = last[c]
        if k:
            pattern[k] += 1
            c -= k
        else:
            c -= 1
    return float(best[room]), pattern


def best_fit(counts: np.ndarray, room: int) -> list[tuple[dict[int, int], int]]:
    """Patterns that hold all of ``counts``: each begins with the longest length left and takes
    the longest that fits again and again; it is used while the histogram allows."""
    counts = counts.copy()
    out = []
    while counts.any():
        left, pat, free = room, {}, counts.copy()
        while left > 0:
            fits = np.flatnonzero(free[: left + 1])
            if not len(fits):
                break
            c = int(fits[-1])
            k = min(left // c, int(free[c]))
            pat[c] = k
            free[c] = 0
            left -= c * k
        n = min(int(counts[c]) // k for c, k in pat.items())
        out.append((pat, n))
        for c, k in pat.items():
            counts[c] -= k * n
    return out


def patterns_for(counts: np.ndarray, room: int, steps: int = 6000, close: float = 1e-3) -> list[tuple[dict[int, int], int]]:
    """Patterns {class: pieces} with the number of sequences of each, which hold all of ``counts``
    (pieces of each class 0..room, 0 unused).

    Columns come from a pool of patterns first and from the knapsack when none of the pool
    improves; the program ends within ``close`` of its least number of sequences. Numbers of
    sequences are rounded down and the rest is filled by best fit."""
    counts = np.asarray(counts, dtype=np.int64).copy()
    used = np.flatnonzero(counts)
    out: list[tuple[dict[int, int], int]] = []
    if len(used):
        m, need = len(used), counts[used].astype(float)
        place = {int(c): i for i, c in enumerate(used)}
        pool = np.zeros((0, m))
        greedy = best_fit(counts, room)
        pool = np.zeros((len(greedy), m))
        for j, (pat, _) in enumerate(greedy):
            for c, k in pat.items():
                pool[j, place[c]] = k
        basis = np.diag((room // used).astype(float))
        inv = np.diag(1 / np.diag(basis))
        x = inv @ need
        for step in range(steps):
            dual = inv.sum(axis=0)
            worth = np.einsum("ij,j->i", pool, dual)  # small: threads would only wait for each other
            j = int(worth.argmax())
            if worth[j] > 1 + close:
                a = pool[j]
            else:
                values = np.zeros(room + 1)
                values[used] = np.maximum(dual, 0)
                best, pattern = price(values, room)
                if best <= 1 + close:
                    break
                a = pattern[used].astype(float)
                pool = np.vstack([pool, a])
            d = np.einsum("ij,j->i", inv, a)
            ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
            r = int(ratio.argmin())
            if not np.isfinite(ratio[r]):
                break
            t = ratio[r]
            x = x - t * d
            x[r] = t
            row = inv[r] / d[r]
            inv -= d[:, None] * row[None, :]
            inv[r] = row
            basis[:, r] = a
            if step % 500 == 499:
                inv = np.linalg.inv(basis)
                x = inv @ need
        for j in range(m):
            pat = {int(used[i]): int(round(basis[i, j])) for i in range(m) if basis[i, j] > 0.5}
            # rounding errors must not take more pieces than there are
            n = min([int(x[j] + 1e-9), *(int(counts[c]) // k for c, k in pat.items())])
            if n > 0:
                out.append((pat, n))
                for c, k in pat.items():
                    counts[c] -= k * n
    return out + best_fit(counts, room)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = written(pieces_of(docs, tokenizer or default_tokenizer(), capacity), "pieces")
    spark = docs.sparkSession
    room = capacity // grain
    salts = 4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # rows that are equal in all columns stay apart by their rank within class and salt
    cls = F.ceil(F.col("length") / grain).cast("int")
    dealt = pieces.select("*", cls.alias("cls"), F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).alias("salt"))
    per = written(dealt.groupBy("cls", "salt").agg(F.count("*").alias("n")), "histogram")
    hist = np.zeros(room + 1, dtype=np.int64)
    for r in per.groupBy("cls").agg(F.sum("n").alias("n")).collect():  # one row a class
        hist[r["cls"]] = r["n"]
    slots, base = [], 0
    taken = np.zeros(room + 1, dtype=np.int64)
    for pat, n in patterns_for(hist, room):
        for c, k in pat.items():
            slots.append((c, int(taken[c]), int(taken[c] + k * n), base, k))
            taken[c] += k * n
        base += n
    places = spark.createDataFrame(slots or [(0, 0, 0, 0, 1)], "cls int, lo long, hi long, base long, k long")
    # ranks: the pieces of lower salts of the class come first; salts are rows of a small table
    ahead = per.withColumn("ahead", F.sum("n").over(Window.partitionBy("cls").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    ahead = ahead.select("cls", "salt", F.coalesce("ahead", F.lit(0)).alias("ahead"))
    ranked = dealt.withColumn(
        "i", F.row_number().over(Window.partitionBy("cls", "salt").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32")) - 1
    ).join(ahead, ["cls", "salt"])
    ranked = ranked.withColumn("rank", F.col("i") + F.col("ahead"))
    # the table of places has a row for each class of each pattern: a bound that the data do not move
    at = ranked.join(F.broadcast(places), "cls").where("rank >= lo and rank < hi")
    put = at.withColumn("sequence_id", F.expr("base + (rank - lo) div k")).withColumn("slot", F.expr("(rank - lo) % k"))
    w = Window.partitionBy("sequence_id").orderBy(F.desc("cls"), "slot").rowsBetween(Window.unboundedPreceding, -1)
    return put.withColumn("offset", F.coalesce(F.sum("length").over(w), F.lit(0))).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("sequence_id").cast("long").alias("sequence_id"), F.col("offset").cast("long").alias("offset")
    )


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))

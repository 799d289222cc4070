"""Language-model scores from n-gram tries in Elias-Fano code.

Texts become batches of word hashes. For each order, a batch sends its distinct n-grams to
shards, as one block of coded keys for each shard, with their counts in the training fold. A
shard adds up the counts of all batches and lays out its n-grams as a trie: a level of contexts,
monotone pointers to their successors, and the successors, coded relative to their context,
with their counts. The levels are a file that is memory-mapped and asked for all n-grams
that batches sent: a context is found by successor search and its word within the context's
range only. Answers return to the batches in key order and the texts are scored.

The probability of a word is smoothed along the orders: with p1 the base (add 0.1),
p2 = (c(v w) + m2 p1) / (c(v) + m2) and p3 = (c(u v w) + m3 p2) / (c(u v) + m3). All counts are exact:
a byte each, and those that a byte does not hold in a list beside them.

An n-gram is known by 64 bits in its shard: 16 of its context and 48 of the context and the word
together. Two n-grams of different contexts are taken for one with probability 2**-64 in a shard, two of
one context with 2**-48.

All counts are over all training rows; what shards hold grows with the corpus and no n-gram is
pruned. A context's successors are spread over ``SLICES`` slices, so that a frequent context does
not gather in one shard.

Batches hold about BATCH_CHARS characters, shards as many n-grams as SHARD_TOKENS tokens have, so that both grow in
number only.

Rules for odd input: null text counts as empty, which is one end token; null doc_id is in the
training fold; repeated rows count each; a text of any length lies in one batch; an empty table gives no rows; a word is a run of bytes other than space and 0x09-0x0D, with
A-Z in lower case; an empty training fold gives N = 0 and the base of an unseen word.
"""

from __future__ import annotations

import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_LUT, U64, exact_id, fold, lean, mix64, table, text_chunks, words_of, written
from .elias_fano import Sequence, decode, encode

END, BEGIN = U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F)
SLICES = 64
BATCH_CHARS, SHARD_TOKENS = 8 << 20, 1_500_000
ORDERS = (1, 2, 3)
WORD_BITS, KEY_BITS = 48, 64
EXACT, OVER = 191, 255


def quantise(c: np.ndarray) -> np.ndarray:
    """Codes of counts: themselves up to EXACT, then 8 steps for each doubling."""
    c = np.asarray(c, dtype=np.float64)
    return np.where(c <= EXACT, c, np.minimum(255, EXACT + np.floor(4 * np.log2(np.maximum(c, 1) / EXACT) + 1e-9))).astype(np.uint8)


def restored(code: np.ndarray, up: bool = False) -> np.ndarray:
    """Counts of codes, rounded down, or up to what the code may stand for."""
    c = code.astype(np.float64)
    big = np.floor(EXACT * 2 ** ((c - EXACT) / 4))
    over = np.ceil(EXACT * 2 ** ((c - EXACT + 1) / 4))
    return np.where(c <= (EXACT - 1 if up else EXACT), c, over if up else big)


class Tokens:
    """Tokens of a batch: hash of each (ends included), first token of each text, text of each."""

    def __init__(self, hash_: np.ndarray, off: np.ndarray):
        self.hash, self.off = hash_, off
        n = len(hash_)
        self.first = np.zeros(n, dtype=bool)
        self.first[off[:-1]] = True
        self.owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
        self.before = np.concatenate([np.array([BEGIN], dtype=U64), hash_[:-1]])[:n]
        self.before[self.first] = BEGIN

    def keys(self, order: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """(shard, key) of the n-gram that ends at each token; order 3 is 0 at first tokens."""
        w = self.hash
        if order == 1:
            return ((w >> U64(40)) % U64(shards)).astype(np.int64), w
        ctx = mix64(self.before ^ U64(0x632BE59BD9B4E019))
        if order == 3:
            two = np.concatenate([np.array([BEGIN], dtype=U64), self.before[:-1]])[: len(w)]
            two[self.first] = BEGIN
            ctx = mix64(ctx + two * U64(0x9FB21C651E98DF25))
        place = (ctx & U64(0xFFFFFF)) + (w & U64(SLICES - 1)) * U64(0x9E3779)
        gram = mix64(ctx ^ (mix64(w ^ U64(0xD6E8FEB86659FD93)) * U64(0xA24BAED4963EE407)))
        key = ((ctx >> U64(WORD_BITS)) << U64(WORD_BITS)) | (gram >> U64(64 - WORD_BITS))
        return (mix64(place) % U64(shards)).astype(np.int64), key

    def distinct(self, order: int, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shard, key) of the distinct n-grams, by shard, then key, and the place of each token's."""
        shard, key = self.keys(order, shards)
        o = np.argsort(key, kind="stable")
        o = o[np.argsort(shard[o], kind="stable")]
        s, k = shard[o], key[o]
        new = np.append(True, (s[1:] != s[:-1]) | (k[1:] != k[:-1]))
        at = np.empty(len(o), dtype=np.int64)
        at[o] = np.cumsum(new) - 1
        return s[new], k[new], at


def tokens_of(texts: list[str | None]) -> Tokens:
    words = words_of(texts, SPACE_LUT, "ascii")
    n = np.diff(words.off) + 1
    off = np.concatenate([[0], np.cumsum(n)])
    out = np.full(off[-1], END, dtype=U64)
    keep = np.ones(off[-1], dtype=bool)
    keep[off[1:] - 1] = False
    out[keep] = words.hash
    return Tokens(out, off)


def packed(c: np.ndarray) -> bytes:
    """Counts as bytes, with those from OVER on in full behind them: all first bytes, all second ones, and so on."""
    over = c[c >= OVER].astype("<i8").view(np.uint8).reshape(-1, 8).T
    return zlib.compress(np.array([len(c)], dtype=np.int64).tobytes() + np.minimum(c, OVER).astype(np.uint8).tobytes() + over.tobytes(), 1)


def unpacked(blob: bytes) -> np.ndarray:
    raw = zlib.decompress(blob)
    n = int(np.frombuffer(raw[:8], dtype=np.int64)[0])
    out = np.frombuffer(raw[8 : 8 + n], dtype=np.uint8).astype(np.int64)
    out[out == OVER] = np.ascontiguousarray(np.frombuffer(raw[8 + n :], dtype=np.uint8).reshape(8, -1).T).view("<i8").ravel()
    return out


class Trie:
    """One shard's n-grams of an order. Levels in one file: contexts, pointers, successors, counts
    up to OVER; greater counts are a list of (place, count)."""

    def __init__(self, file, keys: np.ndarray, counts: np.ndarray):
        ctx = keys >> U64(WORD_BITS)
        first = np.flatnonzero(np.append(True, ctx[1:] != ctx[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
        number = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
        # successors relative to their context: its number above the word, so that the level ascends
        level = (number.astype(U64) << U64(WORD_BITS)) | (keys & U64((1 << WORD_BITS) - 1))
        bits = min(64, WORD_BITS + max(1, int(len(first)).bit_length()))
        parts = [
            encode(ctx[first], KEY_BITS - WORD_BITS),
            encode(np.append(first, len(keys)).astype(U64), max(1, int(len(keys)).bit_length())),
            encode(level, bits),
            np.minimum(counts, OVER).astype(np.uint8).tobytes(),
        ]
        at = np.cumsum([0, *map(len, parts)])
        for p in parts:
            file.write(p)
        file.flush()
        whole = np.memmap(file, dtype=np.uint8, mode="r") if at[-1] else np.zeros(0, dtype=np.uint8)
        level_of = [whole[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        self.contexts, self.pointers, self.words = (Sequence(x) for x in level_of[:3])
        self.codes = level_of[3]
        self.over = np.flatnonzero(counts >= OVER)
        self.over_counts = counts[self.over]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Counts of the n-grams, 0 where the trie has none."""
        out = np.zeros(len(keys), dtype=np.int64)
        if not self.contexts.n or not len(keys):
            return out
        ctx = keys >> U64(WORD_BITS)
        first = np.flatnonzero(np.append(True, ctx[1:] != ctx[:-1]))
        asked = ctx[first]
        c = self.contexts.search(asked)
        known = c < self.contexts.n
        known[known] = self.contexts.get(c[known]) == asked[known]
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
        c, ok = c[of], known[of]
        at = np.flatnonzero(ok)
        c = c[at]
        start, stop = self.pointers.get(c).astype(np.int64), self.pointers.get(c + 1).astype(np.int64)
        target = (c.astype(U64) << U64(WORD_BITS)) | (keys[at] & U64((1 << WORD_BITS) - 1))
        i = self.words.search(target, start, stop)
        hit = i < stop
        hit[hit] = self.words.get(i[hit]) == target[hit]
        out[at[hit]] = self.codes[i[hit]]
        big = np.flatnonzero(hit)[self.codes[i[hit]] == OVER]
        out[at[big]] = self.over_counts[np.searchsorted(self.over, i[big])]
        return out


def _batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part, i = TaskContext.get().partitionId(), 0
    for pdf in frames:
        texts = pdf["text"].tolist()
        for a, b in text_chunks(texts, texts, BATCH_CHARS):
            t = tokens_of(texts[a:b])
            word, local = np.unique(t.hash, return_inverse=True)
            yield pd.DataFrame(
                {
                    "batch": [(part << 32) + i],
                    "n_tokens": [len(t.hash)],
                    "doc_ids": [pdf["doc_id"].iloc[a:b].to_numpy(dtype=np.int64).tobytes()],
                    "no_id": [pdf["no_id"].iloc[a:b].to_numpy(dtype=bool).tobytes()],
                    "held": [pdf["held_out"].iloc[a:b].to_numpy(dtype=bool).tobytes()],
                    "off": [t.off.astype(np.int64).tobytes()],
                    "words": [word.tobytes()],
                    "tokens": [zlib.compress(local.astype("<u4").view(np.uint8).reshape(-1, 4)[:, : _width(len(word))].tobytes(), 1)],
                }
            )
            i += 1


def _width(n: int) -> int:
    """Bytes that numbers below n take."""
    return max(1, -(-int(n).bit_length() // 8))


def _opened(row) -> tuple[Tokens, np.ndarray]:
    words = np.frombuffer(row["words"], dtype=U64)
    narrow = np.frombuffer(zlib.decompress(row["tokens"]), dtype=np.uint8).reshape(-1, _width(len(words)))
    local = np.zeros((len(narrow), 4), dtype=np.uint8)
    local[:, : narrow.shape[1]] = narrow
    return Tokens(words[local.view("<u4").ravel()], np.frombuffer(row["off"], dtype=np.int64)), np.frombuffer(row["held"], dtype=bool)


def score_all(docs: DataFrame, folds: int = 10, m2: float = 10_000.0, m3: float = 10.0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    held = F.coalesce(fold(F.col("doc_id"), folds) == 0, F.lit(False))
    rows = docs.select(*exact_id(), "text", held.alias("held_out"))
    binary = "doc_ids binary, no_id binary, held binary, off binary, words binary, tokens binary"
    batches = written(rows.mapInPandas(lean(_batches), f"batch long, n_tokens long, {binary}"), "batches", "zstd")
    n_tokens = batches.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    shards = max(12, -(-n_tokens // SHARD_TOKENS))

    def send(order: int):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                for _, row in pdf.iterrows():
                    t, held_out = _opened(row)
                    train = ~held_out[t.owner]
                    s, k, at = t.distinct(order, shards)
                    c = np.bincount(at[train], minlength=len(s))
                    met = np.unique(s)
                    cut = np.append(np.searchsorted(s, met), len(s))
                    out = [(x, row["batch"], encode(k[a:b], KEY_BITS), packed(c[a:b])) for x, a, b in zip(met.tolist(), cut[:-1], cut[1:], strict=True)]
                    yield pd.DataFrame(out, columns=["shard", "batch", "keys", "counts"])

        return batches.mapInPandas(lean(run), "shard int, batch long, keys binary, counts binary")

    def count(order: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            shard = int(pdf["shard"].iloc[0])
            keys = [decode(x) for x in pdf["keys"]]
            counts = np.concatenate([unpacked(x) for x in pdf["counts"]])
            every = np.concatenate(keys)
            seen = counts > 0
            key, counts = every[seen], counts[seen]
            o = np.argsort(key, kind="stable")
            key, counts = key[o], counts[o]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
            total = np.add.reduceat(counts, first) if len(key) else np.zeros(0, dtype=np.int64)
            key = key[first]
            out = []
            if order == 1:
                for k, batch in zip(keys, pdf["batch"], strict=True):
                    i = np.minimum(np.searchsorted(key, k), max(len(key) - 1, 0))
                    c = np.where(key[i] == k, total[i], 0) if len(key) else np.zeros(len(k), dtype=np.int64)
                    out.append((batch, order, shard, packed(c), 0, 0))
            else:
                with tempfile.TemporaryFile() as file:
                    trie = Trie(file, key, total)
                    for k, batch in zip(keys, pdf["batch"], strict=True):
                        out.append((batch, order, shard, packed(trie.find(k)), 0, 0))
            out.append((-1, order, shard, b"", int(total.sum()), len(key)))
            return pd.DataFrame(out, columns=["batch", "order", "shard", "answer", "total", "distinct"])

        return run

    # one order after the other, so that the n-grams of one only are on their way
    answers = None
    for order in ORDERS:
        got = send(order).groupBy("shard").applyInPandas(count(order), "batch long, order int, shard int, answer binary, total long, distinct long")
        got = written(got, "answers")
        answers = got if answers is None else answers.union(got)
    n, v = answers.where("batch = -1 and order = 1").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()

    def score(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = left.iloc[0]
        t, held_out = _opened(row)
        got = {}
        for order in ORDERS:
            _, _, at = t.distinct(order, shards)
            part = right[right["order"] == order].sort_values("shard")
            got[order] = np.concatenate([unpacked(x) for x in part["answer"]])[at].astype(np.float64)
        c1 = got[1]
        n_docs = c1[t.off[1:] - 1]  # of the end token: the training texts
        p1 = (c1 + 0.1) / (n + 0.1 * (v + 1))
        c_v = np.concatenate([[0.0], c1[:-1]])
        c_v[t.first] = n_docs
        p2 = (got[2] + m2 * p1) / (c_v + m2)
        c_uv = np.concatenate([[0.0], got[2][:-1]])
        p = np.where(t.first, p2, (got[3] + m3 * p2) / (c_uv + m3))
        start = t.off[:-1]
        ids = pd.Series(np.frombuffer(row["doc_ids"], dtype=np.int64), dtype="Int64").mask(np.frombuffer(row["no_id"], dtype=bool))
        return pd.DataFrame(
            {
                "doc_id": ids,
                "held_out": held_out,
                "n_tokens": np.diff(t.off),
                "n_known": np.add.reduceat((c1 > 0).astype(np.int64), start),
                "train_tokens": n,
                "base_score": np.add.reduceat(np.log10(p1), start),
                "score": np.add.reduceat(np.log10(p), start),
            }
        )

    return (
        batches.groupBy("batch")
        .cogroup(answers.where("batch >= 0").groupBy("batch"))
        .applyInPandas(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    )


def op8_ngram_lm_scores(spark, sf_dir: str) -> DataFrame:
    return score_all(table(spark, sf_dir, "documents"))

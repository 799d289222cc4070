"""Mixing of sources to target weights by a temperature.

Token shares of the sources are raised to an exponent between 0 (equal weights) and 1 (as they
are) and normalised. The entropy of the weights falls and the passes over the smallest source
fall as the exponent rises; bisection finds the greatest exponent whose entropy reaches a
target share of the greatest possible, and then, if a source would be repeated more than the
limit allows, the least exponent that keeps the limit. Weights times the token budget give
each source a budget. It is realised in whole passes and a part of one more: a source's
documents lie in blocks, each pass has its own order of the blocks and of the documents in a
block, and the last pass ends with the document that reaches the budget.

Rules for odd input: null text counts as empty; a document's tokens are its words, and one for
its end, so that empty texts count; null is a source of its own; repeated rows are rows of
their own, and of equal rows all or none are used in the last pass; rows without doc_id are dealt by their text; texts of any
length are whole; an empty table gives no rows. A column of the input named copy, block or block_order is returned with _ behind its name.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import apart, table, written


def weights_at(tokens: list[int], exponent: float) -> list[float]:
    top = max(tokens)
    raised = [(t / top) ** exponent for t in tokens]
    total = math.fsum(raised)
    return [r / total for r in raised]


def entropy(weights: list[float]) -> float:
    return -math.fsum(w * math.log(w) for w in weights if w > 0)


def passes(tokens: list[int], weights: list[float], budget: float | None) -> list[float]:
    """Passes over each source; budget None: so many tokens that every source is passed once at least."""
    if budget is None:
        budget = max(t / w for t, w in zip(tokens, weights, strict=True))
    return [w * budget / t for t, w in zip(tokens, weights, strict=True)]


def _bisect(holds, steps: int = 60) -> float:
    """The greatest exponent in 0..1 that ``holds`` (true for small exponents only)."""
    low, high = 0.0, 1.0
    if holds(high):
        return high
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if holds(mid) else (low, mid)
    return low


def exponent_for(tokens: list[int], entropy_share: float, most_passes: float, budget: float | None) -> float:
    """entropy_share: of the greatest possible entropy; most_passes: limit of repetition."""
    if len(tokens) < 2:
        return 1.0
    target = entropy_share * math.log(len(tokens))
    a = _bisect(lambda x: entropy(weights_at(tokens, x)) >= target)
    within = lambda x: max(passes(tokens, weights_at(tokens, x), budget)) <= most_passes
    if within(a):
        return a
    return 1.0 - _bisect(lambda y: within(1.0 - y)) if within(1.0) else 1.0


def mix(docs: DataFrame, budget: int | None | str = "all", entropy_share: float = 0.95, most_passes: float = 4.0, block_docs: int = 2048, seed: int = 11) -> DataFrame:
    """docs with copy (pass, from 0), block_order and source_order keys, one row for each use of a document.

    budget: tokens; "all": as many as docs has; None: the least with which every source is
    passed once at least."""
    docs = apart(docs, "copy", "block", "block_order")
    n_tokens = (F.regexp_count(F.coalesce("text", F.lit("")), F.lit("\\S+")) + 1).cast("long")
    # the rows as one column: no name of theirs meets one of these
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("no_id"), n_tokens.alias("_n"))
    sized = keyed.select("doc_id", "no_id", "source", "_n")
    totals = sized.groupBy("source").agg(F.sum("_n").alias("tokens"), F.count("*").alias("docs"))
    rows = totals.orderBy(F.col("source").asc_nulls_first()).collect()  # one row a source
    if not rows:
        return docs.select("*", F.lit(0).cast("long").alias("copy"), F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("block_order"))
    tokens = [r["tokens"] for r in rows]
    limit = sum(tokens) if budget == "all" else budget
    exponent = exponent_for(tokens, entropy_share, most_passes, limit)
    turns = passes(tokens, weights_at(tokens, exponent), limit)
    plan = docs.sparkSession.createDataFrame(
        [(r["source"], int(p), int(round((p - int(p)) * r["tokens"])), max(1, r["docs"] // block_docs)) for r, p in zip(rows, turns, strict=True)],
        "source string, whole long, rest long, blocks long",
    )
    plan = F.broadcast(plan)  # one row a source
    block = F.pmod(F.xxhash64("doc_id", "no_id", F.lit(seed)), F.col("blocks"))
    in_source = lambda d: d.join(plan, d["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    sized = in_source(sized).withColumn("block", block)
    order = lambda b: F.xxhash64("source", b, "whole", F.lit(seed + 1))
    # where the last pass ends: in which block, and how many tokens of it are used
    per = written(sized.groupBy("source", "block").agg(F.sum("_n").alias("t"), F.first("whole").alias("whole"), F.first("rest").alias("rest")), "blocks")
    w = Window.partitionBy("source").orderBy(order("block"), "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = per.withColumn("upto", F.sum("t").over(w)).select("source", "block", (F.col("rest") - (F.col("upto") - F.col("t"))).alias("left"), "t")
    full = in_source(keyed).withColumn("block", block).withColumn("_h", F.xxhash64("doc_id", "no_id", F.col("whole"), F.lit(seed + 2)))
    ends = ends.select(F.col("source").alias("_s"), F.col("block").alias("_b"), "left", "t")
    j = full.join(ends, full["source"].eqNullSafe(ends["_s"]) & (full["block"] == ends["_b"]))
    cut = j.select("source", "block", "doc_id", "_n", "_h", "left", "t").where("left > 0 and left < t")
    wb = Window.partitionBy("source", "block").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = cut.withColumn("upto", F.sum("_n").over(wb)).where(F.col("upto") - F.col("_n") < F.col("left"))
    last = last.groupBy("source", "block").agg(F.max(F.struct("_h", "doc_id")).alias("bound"))
    last = last.select(F.col("source").alias("_s2"), F.col("block").alias("_b2"), "bound")
    j = j.join(last, j["source"].eqNullSafe(last["_s2"]) & (j["block"] == last["_b2"]), "left")
    in_last = F.when(F.col("left") <= 0, F.lit(0)).when(F.col("left") >= F.col("t"), F.lit(1)).otherwise(
        F.when(F.struct("_h", F.col("doc_id")) <= F.col("bound"), F.lit(1)).otherwise(F.lit(0))
    )
    uses = (F.col("whole") + in_last).cast("int")
    out = j.where(uses > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), uses - 1)))
    return out.select("row.*", F.col("copy").cast("long").alias("copy"), F.col("block").cast("long").alias("block"), F.xxhash64("source", "block", F.col("copy").cast("long"), F.lit(seed + 1)).alias("block_order"))


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    """Every use of a document: source, copy, block, block_order, doc_order, doc_id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    got = mix(docs)
    return got.select("doc_id", "source", "copy", "block", "block_order", F.xxhash64("doc_id", "copy", F.lit(13)).alias("doc_order"))

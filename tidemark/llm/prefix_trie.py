"""A trie of conversations by fingerprints of their prefixes.

Every turn is a SHA-256 of its role and text; a prefix has the polynomial of its turns' hashes modulo 2**64 as fingerprint, from one
ordered scan (``scans.prefix_sums``), so that a conversation of any length is spread over tasks. Prefixes of equal depth and
fingerprint are candidates for one node. Each candidate group is collapsed to its distinct last turns before it is shuffled, and
each of them is compared with that of the group's representative, the least conversation. One that differs is a collision and
gets a number; the numbers along a conversation's path are part of its nodes' keys from there on. That is exact: prefixes of equal
fingerprint and equal last turn have equal fingerprints one turn before, and so on down to the root.

The rollup to parents needs no steps by level. Of each node the least member is its owner; what a conversation owns is the end of
its path. A subtree's leaves and savings are then those owned by the node's members, less what its owner owns above the node.

Rules for odd input: turns come by number, null first, those of one number by the hash of role and text; null role or text is
empty; rows without conv_id take no part; repeated rows are turns of their own; no conversations, no nodes; columns
other than these four, whatever their names, are not read. Turns of equal SHA-256 count as equal.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, table, written
from .scans import joined_digests, prefix_sums

BASE = 0xD1342543DE82EF95  # odd
NODE = ["depth", "print", "chain"]


def turn_digests(turns: DataFrame) -> DataFrame:
    """conv_id, turn, digest, n_bytes, for every turn; the texts stay where they are read."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    # the role's length ends where the role begins, so that no two pairs are written alike
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.sha2(whole.cast("binary"), 256).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))


def prefixes(turns: DataFrame, bits: int = 64) -> DataFrame:
    """Rows of ``turn_digests`` as prefixes: conv_id, depth, print, above (the print one turn before), digest, n_bytes.

    bits: of the fingerprints; fewer bring collisions about, for tests."""
    rows = prefix_sums(turns.withColumn("x", F.xxhash64("digest")), "conv_id", ["turn", "digest"], "x", BASE, "turns")
    short = (lambda c: F.col(c).bitwiseAND(F.lit((1 << bits) - 1))) if bits < 64 else F.col
    return rows.select("conv_id", (F.col("place") + 1).alias("depth"), short("upto").alias("print"), short("before").alias("above"), "digest", "n_bytes")


def _last_turns(rows: DataFrame) -> DataFrame:
    """Distinct last turns of each candidate group, with their members' least and number, and ``split``: 0 for the representative's own."""
    g = rows.groupBy("depth", "print", "digest").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes"), F.min("above").alias("above"))
    return g.withColumn("split", F.row_number().over(Window.partitionBy("depth", "print").orderBy("conv_id", "digest")) - 1)


def _split(rows: DataFrame, collisions: DataFrame) -> DataFrame:
    """rows with ``chain`` and ``chain_above``: the collisions on the path, with and without the row's own turn."""
    keyed = rows.join(collisions.select("depth", "print", "digest", F.concat_ws(":", "depth", "split").alias("mark")), ["depth", "print", "digest"], "left")
    path = Window.partitionBy("conv_id").orderBy("depth")
    joined = lambda frame: F.concat_ws(",", F.collect_list("mark").over(frame))
    hit = keyed.where("mark is not null").select("conv_id").distinct()
    touched = keyed.join(hit, "conv_id", "left_semi").withColumns({"chain": joined(path.rowsBetween(Window.unboundedPreceding, 0)), "chain_above": joined(path.rowsBetween(Window.unboundedPreceding, -1))})
    rest = keyed.join(hit, "conv_id", "left_anti").withColumns({"chain": F.lit(""), "chain_above": F.lit("")})
    return touched.unionByName(rest).drop("mark")


def prefix_trie(turns: DataFrame, members: DataFrame, bits: int = 64) -> DataFrame:
    """One row a node: conv_id (its least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: rows of ``turn_digests``; members: one conv_id a conversation, those without turns included."""
    members = written(members.select(F.col("conv_id").cast("long").alias("conv_id")).where("conv_id is not null").distinct(), "members")
    rows = written(prefixes(turns, bits), "prefixes")
    groups = written(_last_turns(rows), "last_turns")
    collisions = groups.where("split > 0")
    if collisions.isEmpty():
        rows = rows.withColumns({"chain": F.lit(""), "chain_above": F.lit("")})
        nodes = groups.select("depth", "print", F.lit("").alias("chain"), "conv_id", "n_convs", "n_bytes", "above", F.lit("").alias("chain_above"))
    else:
        rows = written(_split(rows, collisions), "split_prefixes")
        nodes = rows.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes"), F.min("above").alias("above"), F.min("chain_above").alias("chain_above"))
    zero, none = F.lit(0).cast("long"), F.lit("")
    root = members.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(zero.alias("depth"), zero.alias("print"), none.alias("chain"), "conv_id", "n_convs", zero.alias("n_bytes"), F.lit(None).cast("long").alias("above"), F.lit(None).cast("string").alias("chain_above"))
    nodes = nodes.unionByName(root)
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("above").alias("print"), F.col("chain_above").alias("chain")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(kids, NODE, "left").withColumns({"n_children": F.coalesce("n_children", zero), "weight": (F.col("n_convs") - 1) * F.col("n_bytes")})
    nodes = written(prefix_sums(nodes, "conv_id", ["depth"], "weight", 1, "nodes").withColumnRenamed("before", "owned_above").drop("place", "upto"), "nodes")

    # what each conversation owns: the savings of its nodes, and its leaf if that is its own
    owned = nodes.groupBy("conv_id").agg(F.sum("weight").alias("saved"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves")).where("saved > 0 or leaves > 0")
    below = rows.select("conv_id", *NODE).join(owned, "conv_id").groupBy(*NODE).agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    at_root = owned.agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")).select(zero.alias("depth"), zero.alias("print"), none.alias("chain"), "saved", "leaves")
    below = below.unionByName(at_root)

    last = rows.groupBy("conv_id").agg(F.max_by(F.struct(*NODE), "depth").alias("end"))
    ends = members.join(last, "conv_id", "left").select(*[F.coalesce(F.col("end")[c], d).alias(c) for c, d in zip(NODE, (zero, zero, none), strict=True)], "conv_id")
    digests = joined_digests(ends, NODE, "conv_id")

    parents = nodes.select(F.col("depth").alias("d"), F.col("print").alias("p"), F.col("chain").alias("c"), F.col("conv_id").alias("parent_conv_id"))
    up = (F.col("depth") - 1 == F.col("d")) & (F.col("above") == F.col("p")) & (F.col("chain_above") == F.col("c"))
    whole = reduce(lambda a, b: a.join(b, NODE, "left"), [below, digests], nodes).join(parents, up, "left")
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("leaves", zero).alias("n_leaves"),
        (F.coalesce("saved", zero) - F.col("owned_above")).alias("saved_tokens"), F.coalesce("digest", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def rebuilt(turns: DataFrame, base: Column, head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """(turns, members) of conversations whose first ``head`` turns (``most`` at most) are those of the conversation ``base``, followed by their own
    after as many; base and head are columns of conv_id. Few conversations share a base."""
    rows = written(prefix_sums(turns.withColumn("zero", F.lit(0).cast("long")), "conv_id", ["turn", "digest"], "zero", 1, "own_turns").select("conv_id", "place", "digest", "n_bytes"), "placed")
    members = rows.select("conv_id").distinct()
    own = rows.where(F.col("place") >= head).select("conv_id", (F.col("place") + most).alias("turn"), "digest", "n_bytes")
    firsts = rows.where(F.col("place") < most).select(F.col("conv_id").alias("base"), "place", "digest", "n_bytes")
    heads = members.select("conv_id", base.alias("base"), head.alias("head")).join(firsts, "base").where("place < head").select("conv_id", F.col("place").alias("turn"), "digest", "n_bytes")
    return own.unionByName(heads), members


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    turns, members = rebuilt(turn_digests(table(spark, sf_dir, "conversations")), c - c % 5, fold(c, 9), 8)
    return prefix_trie(turns, members)


_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(CAST(c AS VARCHAR)) + 1), lambda i: ascii(substr(CAST(c AS VARCHAR), i, 1))::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"
OP13_SQL = f"""WITH o AS (SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
 h AS (SELECT c, turns, {_CRC} % 9 AS h FROM o),
 b AS (SELECT h.c, list_concat(coalesce(o.turns[1:h.h], []), h.turns[h.h + 1:]) AS turns FROM h LEFT JOIN o ON o.c = h.c - h.c % 5),
 p AS (SELECT c, d, turns[1:d] AS path, d = len(turns) AS ends FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM b)),
 n AS (SELECT d, path, min(c) AS conv_id, count(*) AS n_convs, coalesce(strlen(path[d].t), 0) AS bytes, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends) AS ids FROM p GROUP BY d, path),
 k AS (SELECT d - 1 AS d, path[1:d - 1] AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
 m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON n.d = k.d AND n.path = k.path),
 a AS (SELECT d AS at, path[1:u] AS path, u AS d, n_children, (n_convs - 1) * bytes AS w FROM (SELECT *, unnest(range(0, d + 1)) AS u FROM m)),
 s AS (SELECT d, path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(w)::BIGINT AS saved_tokens FROM a GROUP BY d, path)
 SELECT m.conv_id, m.d AS depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, sha256(coalesce(m.ids, '')) AS ends_sha256
 FROM m JOIN s ON m.d = s.d AND m.path = s.path LEFT JOIN n AS q ON m.d > 0 AND q.d = m.d - 1 AND q.path = m.path[1:m.d - 1]"""

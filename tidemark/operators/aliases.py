"""Names of entities in texts: the best alias that is valid on a text's day, by an index on each alias's rarest run of letters.

An alias is found in one of three ways, by its kind: a short one of Latin letters and digits must stand by itself; a Hangul name of two to eight
syllables may carry a particle; any other is looked for among the letters and digits alone, whatever stands between them. In each case the
compact text (letters and digits only) holds the compact alias, so that both share every run of it. Texts are joined to aliases by the
one run that fewest texts hold, and what meets is checked in full, all candidates of a text in one go: no text meets all aliases."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from ..functions.text import clean_html
from ..sources.shared import written

IDENTITY = ("legal_name", "orthographic_variant", "abbreviation", "former_name")
# particles that may follow a Hangul name: fixed values
PARTICLES = "에게서|으로부터|에서는|에게는|으로는|에서|에게|으로|까지|부터|처럼|보다|에만|에는|이라는|라는|이라|라고|이며|이고|은|는|이|가|을|를|의|과|와|도|만|에|로|측|발"
RUN = 3
WORD = re.compile("[0-9a-z]+")


def lowered(x: Column) -> Column:
    return F.lower(clean_html(F.coalesce(x, F.lit(""))))


def compact(x: Column) -> Column:
    """Letters and digits of a lowered text, nothing between them."""
    return F.regexp_replace(x, "[^0-9a-z가-힣]+", "")


def is_short_latin(x: Column) -> Column:
    """Whether a name is of at most three Latin letters and digits: too likely a word."""
    return compact(lowered(x)).rlike("^[0-9a-z]{1,3}$")


def active(day: Column, valid_from: Column, valid_to: Column) -> Column:
    """Without a day every alias is active; its ends belong to it, and an absent end is open."""
    return day.isNull() | ((valid_from.isNull() | (day >= valid_from)) & (valid_to.isNull() | (day <= valid_to)))


def pattern(raw: Column) -> Column:
    """The regular expression of a lowered alias that must stand by itself or may carry a particle; null where compact forms decide."""
    quoted = F.regexp_replace(F.regexp_replace(raw, r"([.+&-])", r"\\$1"), " ", r"\\s+")
    word = F.concat(F.lit("(^|[^0-9a-z])"), quoted, F.lit("($|[^0-9a-z])"))
    name = F.concat(F.lit("(^|[^0-9a-z가-힣])"), raw, F.lit(f"({PARTICLES})?($|[^0-9a-z가-힣])"))
    return F.when(raw.rlike(r"^[0-9a-z+&. -]+$") & (F.length(compact(raw)) <= 4), word).when(raw.rlike("^[가-힣]{2,8}$"), name)


def contains(text: Column, compact_text: Column, alias: Column) -> Column:
    """Whether a lowered text, given with its compact form, holds a lowered alias."""
    p = pattern(alias)
    return F.when(compact(alias) == "", False).when(p.isNotNull(), F.regexp_like(text, F.coalesce(p, F.lit("")))).otherwise(F.contains(compact_text, compact(alias)))


def form(raw: Column) -> Column:
    """How a lowered alias is looked for, as one text: w: and a word that must stand by itself, ~ and a regular expression, or c: and letters within the compact text."""
    p = pattern(raw)
    return F.when(p.isNotNull() & raw.rlike("^[0-9a-z]+$"), F.concat(F.lit("w:"), raw)).when(p.isNotNull(), F.concat(F.lit("~"), p)).otherwise(F.concat(F.lit("c:"), compact(raw)))


@F.pandas_udf(ArrayType(StringType()))
def _held_forms(text: pd.Series, compact_text: pd.Series, forms: pd.Series) -> pd.Series:
    """Those of the forms that a lowered text, given with its compact form, holds."""
    compiled: dict[str, re.Pattern] = {}
    out = []
    for t, c, fs in zip(text, compact_text, forms, strict=True):
        words = set(WORD.findall(t))  # a run of Latin letters and digits that neither of them adjoins
        hits = []
        for f in fs:
            if f[0] == "w":
                ok = f[2:] in words
            elif f[0] == "c":
                ok = f[2:] in c
            else:
                ok = (compiled.get(f) or compiled.setdefault(f, re.compile(f[1:], re.ASCII))).search(t) is not None
            if ok:
                hits.append(f)
        out.append(hits)
    return pd.Series(out, dtype=object)


def _codes(x: str, all_lengths: bool) -> np.ndarray:
    """Distinct runs of RUN characters as numbers of 63 bits; with all_lengths those of fewer as well, else a shorter text is its own run."""
    c = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    two = c[:-1] | c[1:] << 21 if len(c) > 1 else c[:0]
    three = two[:-1] | c[2:] << 42 if len(c) > 2 else c[:0]
    if all_lengths:
        return np.concatenate([np.unique(x) for x in (c, two, three)])
    return np.unique(three if len(three) else two if len(two) else c)


@F.pandas_udf(ArrayType(LongType()))
def _text_runs(x: pd.Series) -> pd.Series:
    return x.map(lambda s: _codes(s, True))


@F.pandas_udf(ArrayType(LongType()))
def _alias_runs(x: pd.Series) -> pd.Series:
    return x.map(lambda s: _codes(s, False))


def alias_rows(aliases: DataFrame) -> DataFrame:
    """ticker, alias, alias_type, confidence, valid_from and valid_to, with the lowered and compact forms; those without letters go.
    relationship is identity or related_entity by the type."""
    a = aliases.withColumn("raw", lowered(F.col("alias"))).withColumn("compact", compact(F.col("raw"))).where("compact != ''")
    return a.withColumn("relationship", F.when(F.col("alias_type").isin(*IDENTITY), "identity").otherwise("related_entity"))


def rarest(own: DataFrame, frequency: DataFrame) -> DataFrame:
    """Of each form the run that fewest texts hold. own: rows (form, run); frequency: rows (run, _n)."""
    w = Window.partitionBy("form").orderBy(F.coalesce("_n", F.lit(0)), "run")
    return own.join(frequency, "run", "left").withColumn("_i", F.row_number().over(w)).where("_i = 1").select("form", "run")


def alias_matches(texts: DataFrame, aliases: DataFrame, key: str, text: str, day: str) -> DataFrame:
    """(key, ticker, alias, relationship, confidence): of each text and entity the best alias that the text holds and that is valid on its day.

    The best is an identity before a related entity, then of greatest confidence, then the longest compact form, then the last by name.
    aliases: rows of (ticker, alias, alias_type, confidence, valid_from, valid_to); key names a text."""
    a = written(alias_rows(aliases).withColumn("form", form(F.col("raw"))), "alias_rows")
    t = texts.select(F.col(key).alias("_key"), F.col(day).cast("date").alias("_day"), lowered(F.col(text)).alias("_text"))
    t = written(t.withColumn("_compact", compact(F.col("_text"))), "texts")
    # what decides is the form: aliases of one form are looked for once
    own = written(a.select("form", "compact").dropDuplicates(["form"]).select("form", F.explode(_alias_runs("compact")).alias("run")), "alias_runs")
    each = t.select("_key", F.explode(_text_runs("_compact")).alias("run"))
    frequency = each.join(own.select("run").distinct(), "run", "left_semi").groupBy("run").agg(F.count("*").alias("_n"))
    first = written(rarest(own, written(frequency, "run_counts")), "rarest")
    may = each.join(first, "run").groupBy("_key").agg(F.collect_set("form").alias("_forms"))
    held = t.join(may, "_key").select("_key", "_day", F.explode(_held_forms("_text", "_compact", "_forms")).alias("form"))
    hit = held.join(a, "form").where(active(F.col("_day"), F.col("valid_from"), F.col("valid_to")))
    order = F.struct((F.col("relationship") == "identity").cast("int").alias("r"), F.coalesce("confidence", F.lit(0.0)).alias("c"), F.length("compact").alias("n"), F.col("alias").alias("a"))
    best = hit.groupBy("_key", "ticker").agg(F.max_by(F.struct("alias", "relationship", "confidence"), order).alias("b"))
    return best.select(F.col("_key").alias(key), "ticker", "b.*")


def registry_faults(aliases: DataFrame) -> DataFrame:
    """(fault, ticker, alias) of a registry's rows: too short, unknown type, confidence outside 0..1, reversed validity, repeated, or an alias of several entities."""
    kinds = (*IDENTITY, "brand", "subsidiary", "affiliate")
    a = aliases.withColumn("compact", compact(lowered(F.col("alias"))))
    same = Window.partitionBy("ticker", "compact", "alias_type", "valid_from", "valid_to")
    owners = F.size(F.collect_set("ticker").over(Window.partitionBy("compact")))
    checks = [
        ("too short", F.length("compact") < 2), ("alias_type", ~F.coalesce(F.col("alias_type").isin(*kinds), F.lit(False))), ("confidence", ~F.coalesce((F.col("confidence") > 0) & (F.col("confidence") <= 1), F.lit(False))),
        ("validity", F.coalesce(F.col("valid_from") > F.col("valid_to"), F.lit(False))), ("repeated", F.count("*").over(same) > 1), ("ambiguous", owners > 1),
    ]
    faults = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks]), lambda x: x.isNotNull())
    return a.withColumn("_faults", faults).select(F.explode("_faults").alias("fault"), "ticker", "alias")

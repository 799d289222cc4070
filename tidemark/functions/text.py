"""Text functions as column expressions."""

from __future__ import annotations

import html
import html.entities
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def normalised_title(x: Column) -> Column:
    """Lower case, runs of other characters than letters and digits as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " "))


def tokens(x: Column, least: int = 2) -> Column:
    """Distinct words of a normalised title with ``least`` characters at least."""
    return F.array_distinct(F.filter(F.split(normalised_title(x), " "), lambda t: F.length(t) >= least))


def trigrams(x: Column) -> Column:
    """Distinct runs of three characters of the title without spaces."""
    s = F.replace(normalised_title(x), F.lit(" "), F.lit(""))
    return F.when(F.length(s) < 3, F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 2, F.lit(1))), lambda i: F.substring(s, i, F.lit(3))))
    )


def jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)))


CLOSED = re.compile("&(#[0-9]+|#[xX][0-9a-fA-F]+|[0-9A-Za-z]+);")


@F.pandas_udf(StringType())
def _unescaped(x: pd.Series) -> pd.Series:
    return x.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def _closed_unescaped(x: pd.Series) -> pd.Series:
    named = lambda m: html.unescape(m[0]) if m[1][0] == "#" or m[1] + ";" in html.entities.html5 else m[0]
    return x.map(lambda s: CLOSED.sub(named, s), na_action="ignore")


def clean_html(x: Column, closed: bool = False) -> Column:
    """Text of markup: all character references resolved, then tags as spaces, white space as one space.

    closed: only references that end in a semicolon, so that a text cut within one keeps its letters."""
    t = F.when(F.contains(x, F.lit("&")), (_closed_unescaped if closed else _unescaped)(x)).otherwise(x)
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"<[^>]+>", " "), r"(?U)\s+", " "))


# query names that begin so are left out
TRACKING = ("utm_", "fbclid", "gclid", "ref", "source")


def canonical_url(x: Column) -> Column:
    """Scheme and host in lower case, path without last slashes, query sorted and coded anew without tracking names, no fragment."""
    url = F.trim(x)
    part = lambda i: F.regexp_extract(url, r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?", i)
    plain = lambda s: F.coalesce(F.try_url_decode(s), s)
    coded = lambda s: F.replace(F.replace(F.url_encode(s), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    pairs = F.transform(F.filter(F.split(part(4), "&"), lambda p: p != ""), lambda p: F.struct(plain(F.substring_index(p, "=", 1)).alias("k"), plain(F.regexp_extract(p, "=(.*)$", 1)).alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["k"]).rlike("^(" + "|".join(TRACKING) + ")")))
    query = F.array_join(F.transform(kept, lambda p: F.concat(coded(p["k"]), F.lit("="), coded(p["v"]))), "&")
    host = F.when(part(2) != "", F.concat(F.lit("//"), F.lower(part(2)))).otherwise("")
    scheme = F.when(part(1) != "", F.concat(F.lower(part(1)), F.lit(":"))).otherwise("")
    return F.concat(scheme, host, F.regexp_replace(part(3), "/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def fingerprint(*parts: Column) -> Column:
    """sha256 of the parts, joined by a bar; null counts as empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def entity_code(x: Column, width: int = 6) -> Column:
    """Digits of a code, filled with zeros from the left."""
    return F.lpad(F.regexp_replace(x, "[^0-9]", ""), width, "0")


def vendor_number(x: Column) -> Column:
    """Numbers as vendors write them: commas, a plus sign, a doubled minus; null where unreadable."""
    return F.regexp_replace(F.regexp_replace(F.trim(x), "[,+]", ""), "^--", "-").try_cast("double")


def tick_size(price: Column, ladder: tuple[tuple[float, float], ...]) -> Column:
    """The step of the first rung whose bound lies above the price; the last step beyond all."""
    out = None
    for bound, step in ladder[:-1]:
        out = F.when(price < bound, step) if out is None else out.when(price < bound, step)
    return out.otherwise(ladder[-1][1])

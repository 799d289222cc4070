"""Personal data by anchor expansion.

An Aho-Corasick automaton passes once over each text and reports anchors: at-signs, plus
signs, digits, schemes and identifier cues. A small deterministic parser for each kind expands
an anchor to the boundaries of the datum and validates it (labels of a domain, parts of an
address, the Luhn digit, digit counts). Matches of a kind do not overlap; the search for the
next begins where the last match ended, whether it was valid or not.

Kinds: email, ip, card, phone (the base), then url (of a scheme with credentials or a query
that carries an identifier), account (after a cue such as "account" or "IBAN"), address (a number and
street word after an "address" cue).

Rules for odd input: null text counts as empty and has no spans; rows are treated one by one,
so repeated rows and null ids are kept; a text is scanned whole, whatever its length.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import apart, lean, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account", "address")
_RANK = {k: i for i, k in enumerate(KINDS)}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"(?:[^\s/@<>\"]+:[^\s/@<>\"]+@)?[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^\s<>\"]*)?")
_URL_PRIVATE = re.compile(r"^[^\s/@]+:[^\s/@]+@|[?&](?:user|email|mail|phone|token|session|account|id)=", re.I)
_ACCOUNT = re.compile(r"(?:\s?(?:number|no\.?|nr\.?|id))?\s?[:#]?\s?([A-Z]{0,4}[0-9][A-Z0-9]*(?:[ -][A-Z0-9]*[0-9][A-Z0-9]*)*)", re.I)
_ADDRESS = re.compile(r"\s?:\s?([0-9]{1,5}[A-Za-z]?\s(?:[^\W\d_]+\s){0,3}(?:street|st|avenue|ave|road|rd|lane|ln|drive|dr|boulevard|blvd)\b\.?)", re.I)

SCHEMES = ("http://", "https://", "ftp://")
ACCOUNT_CUES = ("account", "acct", "iban", "ssn", "passport")
ADDRESS_CUES = ("address",)

_automaton = None


def _scanner():
    """The automaton of all anchors, built once in a worker."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        for d in "0123456789":
            a.add_word(d, (0, 1))
        a.add_word("@", (1, 1))
        a.add_word("+", (2, 1))
        for words, kind in ((SCHEMES, 3), (ACCOUNT_CUES, 4), (ADDRESS_CUES, 5)):
            for w in words:
                for x in {w, w.capitalize(), w.upper()}:
                    a.add_word(x, (kind, len(x)))
        a.make_automaton()
        _automaton = a
    return _automaton


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans, by start, then kind; code points, end exclusive."""
    text = text or ""
    out: list[tuple[str, int, int]] = []
    after = dict.fromkeys(KINDS, 0)
    ip_from = 0  # digits before this place begin no address, as their run was tried already
    for last, (kind, size) in _scanner().iter(text):
        at = last - size + 1
        if kind == 0:
            if at >= after["card"]:
                m = _CARD.match(text, at)
                if m:
                    after["card"] = m.end()
                    digits = re.sub(r"[ -]", "", m.group())
                    if 14 <= len(digits) <= 19 and _luhn(digits):
                        out.append(("card", at, m.end()))
            if at >= ip_from:
                m = _IP.match(text, at)
                if m:
                    ip_from = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p[-4:] if p.lstrip("0") else "0") <= 255 for p in m.group().split(".")):
                        out.append(("ip", at, m.end()))
                else:
                    ip_from = _DIGITS.match(text, at).end()
        elif kind == 1:
            m = _DOMAIN.match(text, at + 1)
            if m:
                start, low = at, after["email"]
                while start > low and text[start - 1] in _LOCAL:
                    start -= 1
                if start < at:
                    after["email"] = m.end()
                    out.append(("email", start, m.end()))
        elif kind == 2:
            if at >= after["phone"]:
                m = _PHONE.match(text, at)
                if m:
                    after["phone"] = m.end()
                    if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                        out.append(("phone", at, m.end()))
        elif kind == 3:
            if at >= after["url"]:
                m = _URL.match(text, last + 1)
                if m:
                    after["url"] = m.end()
                    if _URL_PRIVATE.search(m.group()):
                        out.append(("url", at, m.end()))
        elif kind == 4:
            if at >= after["account"] and (at == 0 or not text[at - 1].isalnum()):
                m = _ACCOUNT.match(text, last + 1)
                if m and sum(c.isdigit() for c in m.group(1)) >= 6:
                    after["account"] = m.end(1)
                    out.append(("account", m.start(1), m.end(1)))
        elif at >= after["address"]:
            m = _ADDRESS.match(text, last + 1)
            if m:
                after["address"] = m.end(1)
                out.append(("address", m.start(1), m.end(1)))
    out.sort(key=lambda s: (s[1], _RANK[s[0]]))
    return out


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans are one."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_all(docs: DataFrame) -> DataFrame:
    """docs with a column ``spans``: an array of kind, start and end. A column of docs with that name is ``spans_`` in the result."""

    def run(batches):
        for b in batches:
            spans = [[{"kind": k, "start": x, "end": y} for k, x, y in find(t)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(spans, type=_SPANS)], [*b.schema.names, "spans"])

    docs = apart(docs, "spans")
    spans = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, T.StructField("spans", spans)]))


def without_pii(docs: DataFrame) -> DataFrame:
    """docs with each datum replaced by its kind, and n_chars, if there, set anew."""

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            clean = [t if t is None else redacted(t, find(t)) for t in texts]
            columns = dict(zip(b.schema.names, b.columns, strict=True)) | {"text": pa.array(clean, type=b.schema.field("text").type)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    out = docs.mapInArrow(lean(run), docs.schema)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _listed(spans) -> object:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_pii(spark, sf_dir: str) -> DataFrame:
    got = find_all(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return got.select("doc_id", *[count(k) for k in BASE], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))

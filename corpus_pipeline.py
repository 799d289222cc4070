"""A corpus pipeline: toxic documents go, one of each group of near copies stays, personal data
is replaced, sources are mixed, and what is left is packed into sequences.

Rules of all stages for odd input: a null text counts as empty; a null source is a source of its own; rows without doc_id stay apart from
each other and are never near copies; further columns, whatever their names, pass through all stages but the last; an empty table gives an empty one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import mixing, ngram_join, packing, pii, toxicity
from tidemark.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier (operator 2), learnt from these documents and the labels, does not call toxic.
    Empty texts are scored by the bias alone; repeated rows are judged alike."""
    weights, bias, _ = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, weights, bias)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each class of operator 4; rows without doc_id stay.
    Rows that are equal in doc_id and text are one document; rows of one doc_id and different texts stay or go together."""
    kept = ngram_join.similar_texts(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(docs.columns).union(docs.where("doc_id is null"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data (operator 9) replaced by its kind; a null text stays null."""
    return pii.without_pii(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Uses of documents under operator 1: every source is passed once at least, so that no clean
    document goes, and 1.5 times at most."""
    got = mixing.mix(docs, budget=None, entropy_share=0.95, most_passes=1.5)
    return got.select(got.columns[: len(docs.columns)]).toDF(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens (operator 6). An empty document is one piece of its end token."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("pii", mask_pii),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# SQL expresses neither the classifier nor the tokeniser.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

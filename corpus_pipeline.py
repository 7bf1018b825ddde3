"""A training corpus from the documents table: five stages, each of which applies one operator to what is left.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages it is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import drop_path, stash, table
from graphloom.llm.decontamination import without_leaks
from graphloom.llm.near_dedup import without_near_duplicates
from graphloom.llm.packing import pack
from graphloom.llm.repeats import without_repeats
from graphloom.llm.toxicity import score_column, train

TOXIC_AT = 0.3
NEAR_PERCENT = 80  # similarity of five-word shingle sets from which documents are near-duplicates
ORACLE_SQL = None  # trained models, similarity components and a tokenizer are beyond SQL


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose restored text scores below TOXIC_AT. Null and empty texts have the base score and stay; null and
    repeated ids are scored like any other; without labels nothing goes. All texts and labels are learned from: nothing is
    measured on these rows, so none are held out."""
    model = train(docs, table(spark, sf_dir, "labels"), whole=True)
    return docs.filter(score_column(spark, model, F.col("text")) < TOXIC_AT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component. Null and empty texts stay; rows without an id take part; rows that repeat an id go only
    if their texts are near-duplicates."""
    return without_near_duplicates(docs, percent=NEAR_PERCENT)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with repeated strings of 200 bytes cut out of their texts. Null texts stay null, texts that are cut whole
    stay as empty ones; ids play no part."""
    return without_repeats(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item. Null and empty texts stay; each row is judged by its own text; without items
    nothing goes."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows with their place in a sequence. A null or empty text is one piece of the end id; null and
    repeated ids are packed like any other."""
    import public_tokenizers

    return pack(docs, str(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's table is removed when the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_path(spark, before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

"""A training corpus in five stages: toxicity, line dedup, near duplicates, mixing, packing.

Each stage takes the documents that its predecessor kept, and all but the last return the columns of
``documents``. ``run`` writes every stage as Parquet in the shared folder and reads it again.

In every stage a null text is an empty one, rows equal in id and text are treated alike, further columns are kept (also
where their names are those that an operator uses inside), and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.llm import line_dedup, mixing, ngram_join, packing, toxicity
from stockloom.llm.common import shared_dir, table, written

#: Distinct words that a worker of the last stage remembers: fewer than alone, as the executor's heap is full by then.
PACKING_WORDS = 200_000


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below one half; the model is fitted to the labels of the given documents.

    Documents with a null id or without a label are scored like all others. Without labels of both kinds every score is
    the share of toxic labels, so all documents stay where that is below one half.
    """
    model = toxicity.fit(*toxicity.sample(docs, table(spark, sf_dir, "labels")))
    return toxicity.without_toxic(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs; a document goes if no word of its own is left.

    Empty and null texts have nothing removed and stay as they are. Of equal lines the first stays, by id and place.
    """
    found = line_dedup.deduplicated(docs)
    copied = (F.col("n_lines_removed") > 0) & (F.col("words_left") == 0)
    kept = found.filter(~copied)
    n_chars = F.when(F.col("n_lines_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", n_chars).select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class of near copies.

    Texts without words are copies of each other; a document with a null id stays only where its class has no other.
    """
    return ngram_join.one_of_each_class(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that sources, languages and topics have their target shares of words.

    A null source or language belongs to the cell of all others. The draw follows from the id, so it is the same in
    every run, and rows with equal or null ids stay or go together.
    """
    return mixing.mixed(docs).filter("selected").select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 2048 ids; an empty text is its end id alone."""
    return packing.packed(docs, cache_words=PACKING_WORDS)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", one_of_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: A fitted model and token ids are beyond SQL; the tests compare the rows of each stage with SQL or brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    base, docs = shared_dir(spark, "pipeline"), table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{base}/{i}-{name}")
    return docs

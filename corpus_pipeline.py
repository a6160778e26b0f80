"""From raw documents to token ids: toxicity, line dedup, near-duplicate join, mixing, BPE.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depsight.llm import bpe, jaccard, lines, mixing, toxicity
from depsight.llm.queries import read, tokenizer_path
from depsight.llm.shared import table


def measured(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network calls toxic go; it learns from labels outside of the held-out fold.

    Null and empty texts are clean and stay; of very long texts every window counts; a score that ties with the threshold is toxic; repeated rows go or stay
    alike; an empty table stays empty; extra columns, whatever their names, stay.
    """
    return toxicity.clean(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each source go, whatever its size and whatever is left of a page.

    Null texts stay null, a null source is one source, a share that ties with the ratio stays; repeated rows count as pages of their own; an empty table stays
    empty; extra columns, whatever their names, stay. n_chars is counted anew.
    """
    return measured(lines.dedup(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest id: sets of five-word shingles alike by 0.8 or more.

    Null texts, texts without words and null ids are in no group and stay; of rows that repeat an id one stays, of equal text hashes any; very long texts are
    compared whole; an empty table stays empty; extra columns, whatever their names, stay.
    """
    return jaccard.one_of_each(docs, size=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken as often as their source's target asks, twice at most.

    Null texts have no words and go or stay by their source's rate; a null source is the last source; rows with the same id decide alike; an empty table and
    one without words give no rows; extra columns, whatever their names, stay.
    """
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the sums of ids and decoded text of each row.

    Null and empty texts have no ids; very long ones are encoded whole; rows that are there twice are encoded twice; an empty table stays empty.
    """
    return bpe.digests(docs, tokenizer_path(), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The first and last stages have no SQL; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

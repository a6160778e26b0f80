"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depsight.llm import bpe, bytebpe, jaccard, kmeans, language, lines, mixing, quality, simhash, substring, toxicity, warc, whitening
from depsight.llm.shared import held_out, importable

TOKENIZER = "word_bpe_49k.json"
RANKS = "byte_bpe_50k.tiktoken"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return lines.dedup(docs, n_lines="n_lines", n_dropped="n_dropped").drop("source")


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(read(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(read(spark, sf_dir, "pages")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = language.predict(docs, language.train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return simhash.compared(docs, asked=F.col("doc_id") % simhash.EVERY == 0)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(read(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), tokenizer_path())


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(read(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op12_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.cluster(read(spark, sf_dir, "embeddings"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bytebpe.digests(read(spark, sf_dir, "documents"), tokenizer_path(RANKS), public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_substring": op2_substring,
    "op3_warc": op3_warc,
    "op4_toxicity": op4_toxicity,
    "op5_bpe": op5_bpe,
    "op6_quality": op6_quality,
    "op7_mixing": op7_mixing,
    "op8_language": op8_language,
    "op9_simhash": op9_simhash,
    "op10_jaccard": op10_jaccard,
    "op11_whitening": op11_whitening,
    "op12_kmeans": op12_kmeans,
    "op13_byte_bpe": op13_byte_bpe,
}
ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": lines.ORACLE,
    "op3_warc": warc.ORACLE,
    "op7_mixing": mixing.ORACLE,
}

"""Mixing sources to target weights.

The words of each source are summed, every source gets a target, and target over size is its repetition rate: each document goes out
floor(rate) times, and once more where a hash of its id, as a number from 0 to 1, is below the rest of the rate.

Cases: null sources are a source of their own, the last; null and empty texts have size 0, very long ones their whole size; a null id hashes as the empty
text. Repeated rows and other rows with the same id decide alike; a draw that ties with the rest of the rate is no copy. Tables without rows or words give
targets of 0 and no copies. Extra columns, whatever their names, go with their rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depsight.llm.shared import WORD, fresh, numbered, table

WEIGHTS = (5, 2, 1)
#: Words of the mix as a share of all words, and the most times that a source's words are taken.
SHARE, MOST = 1.5, 2.0
SEED = "mix-1"
#: Hexadecimal digits of the hash that become a number from 0 to 1: 52 bits, which a double holds exactly.
DIGITS = 13


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, source_col: str = "source", size_col: str = "size", weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target for each source.

    Weights repeat over the ranked sources. What a source can't take beyond most times its size is shared again by weight until no source
    is above: that is one level for all sources below their limit, found by a few sums over the sources.
    """
    per = sizes.groupBy(F.col(source_col).alias("source")).agg(F.sum(size_col).cast("long").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    per = table(numbered(per, [F.col("source").asc_nulls_last()]).select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(most)).alias("limit")), "weights")
    level, capped = None, -1
    while True:
        above = F.lit(False) if level is None else F.col("weight") * F.lit(level) > F.col("limit")
        row = per.agg(F.sum("source_size").alias("all"), F.sum(F.when(above, F.col("limit")).otherwise(0.0)).alias("full"), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("rest"), F.count(F.when(above, 1)).alias("n")).first()
        if row["n"] == capped or not row["rest"]:
            break
        capped, level = row["n"], (share * row["all"] - row["full"]) / row["rest"]
    level = F.lit(float("inf") if level is None or not row["rest"] else level)
    return table(per.select("source", "source_size", F.least("limit", F.col("weight") * level).alias("target")), "targets")


def copies(doc_id: Column, source_size: Column, target: Column, seed: str = SEED) -> Column:
    """How often the mix takes a document."""
    rate = F.when(source_size > 0, target / source_size).otherwise(0.0)
    key = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    draw = F.conv(F.substring(F.md5(key.cast("binary")), 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))
    return F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")


def taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken for each document. The text is read once, for the sizes."""
    sizes = table(docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"), n_words(docs[text_col]).alias("size")), "sizes")
    goal = targets(sizes).withColumnRenamed("source", "goal_source")
    found = sizes.join(goal, sizes["source"].eqNullSafe(goal["goal_source"]), "left")  # a file of known size: Spark broadcasts it below its threshold, else AQE splits a hot source
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * copies(F.col("doc_id"), F.col("source_size"), F.col("target"), seed)).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """The documents of the mix, with the columns of docs; a document that is taken twice is there twice."""
    source, total, target, times, copy = (fresh(docs, c) for c in ("goal_source", "goal_size", "goal", "copies", "copy"))
    goal = targets(docs.select(docs[source_col].alias("source"), n_words(docs[text_col]).alias("size"))).toDF(source, total, target)
    found = docs.join(goal, docs[source_col].eqNullSafe(goal[source]), "left").withColumn(times, copies(docs[id_col], F.col(total), F.col(target), seed).cast("int"))
    return found.where(F.col(times) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (ARRAY[5.0, 2.0, 1.0])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM d GROUP BY source),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS k FROM c),
l AS (SELECT k, cap / weight AS ratio, (1.5::DOUBLE * (SELECT sum(source_size)::DOUBLE FROM s) - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
t AS (SELECT source, source_size, least(cap, weight * (SELECT level FROM l WHERE level <= ratio ORDER BY k LIMIT 1))::DOUBLE AS target FROM c),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
    ('0x' || substr(md5('{SEED}:' || coalesce(d.doc_id::VARCHAR, '')), 1, {DIGITS}))::BIGINT::DOUBLE / {16**DIGITS}.0::DOUBLE AS draw FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""

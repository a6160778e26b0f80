"""Touches of files from commit logs: text whose records span lines, and so the splits of its files.

A log is what `git log --name-only --pretty=format:%x01%H%x20%ct` prints: a header, led by a character that quoted names can't hold, then the names of a
commit's files, then an empty line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What leads a header.
MARK = "\x01"
SHAPE = "commit string, at timestamp, path string"


def touches(spark: SparkSession, log: str) -> DataFrame:
    """commit, at, path of every name below a header; names are trimmed, and names before a file's first header belong to no commit and go.

    Lines are numbered within their split, and a header is carried forward to the next one: inside a split by a window over it, and from split to split by one over
    the last header of each, one row a split. A log that isn't there has no touches.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(log)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], SHAPE)
    lines = spark.read.text(log).where("trim(value) <> ''").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"), "value")
    lines = lines.withColumn("head", F.when(F.col("value").startswith(MARK), F.substring("value", 2, 1 << 20)))
    ends = lines.where("head IS NOT NULL").groupBy("file", "split").agg(F.max_by("head", "line").alias("end"))
    starts = lines.select("file", "split").distinct().join(ends, ["file", "split"], "left")
    starts = starts.select("file", "split", F.last("end", ignorenulls=True).over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)).alias("start"))
    inside = F.last("head", ignorenulls=True).over(Window.partitionBy("file", "split").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    named = lines.withColumn("inside", inside).where("head IS NULL").join(starts, ["file", "split"])
    parts = F.split(F.coalesce("inside", "start"), " ")
    return named.select(parts[0].alias("commit"), F.timestamp_seconds(parts[1].cast("long")).alias("at"), F.trim("value").alias("path")).where("commit IS NOT NULL")


def churn(found: DataFrame, since: Column | None = None, root: str = "") -> DataFrame:
    """path (below root), commits: how many commits since then, or ever, touched each file."""
    kept = found if since is None else found.where(F.col("at") >= since)
    path = F.concat(F.lit(f"{root.rstrip('/')}/"), "path") if root else F.col("path")
    return kept.groupBy(path.alias("path")).agg(F.count("*").alias("commits"))

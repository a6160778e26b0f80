"""Written tables that end lineage: what Spark calls a reliable checkpoint, as Parquet with known sizes."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

#: For tables as large as a tree: half the bytes of the default's.
TIGHT = "zstd"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which all executors reach; where it is unset, on one machine only, a temporary one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors reach")
        found = "file://" + tempfile.mkdtemp(prefix="depsight-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder; it goes when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def written(df: DataFrame, name: str = "step", codec: str | None = None) -> DataFrame:
    """df, computed once: later reads need neither its lineage nor the executors that made it. codec: how its files are packed, else the session's way."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graph-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, name: str = "step") -> DataFrame:
    """written(), for tables as large as a tree."""
    return written(df, name, TIGHT)


def together(*parts: DataFrame) -> list[DataFrame]:
    """Each table written, their jobs side by side."""
    with ThreadPoolExecutor(len(parts)) as pool:
        return list(pool.map(written, parts))


def dropped(df: DataFrame) -> None:
    """Removes a written table that nothing reads any more."""
    for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        _drop(df.sparkSession, path)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the JVM may have ended before
        pass

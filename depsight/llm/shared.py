"""What the operators of this subpackage share: the shared folder, Arrow batches, words and their hashes."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Characters of text that one step of a batch function works on; a longer single text is one step.
STEP_CHARS = 1_000_000


def importable(spark: SparkSession) -> None:
    """Python workers on this machine find the package wherever the driver was started; a cluster gets it with its job's files."""
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{paths}" if paths else root


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, on one machine only, a temporary one, which is then set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors reach")
        found = "file://" + tempfile.mkdtemp(prefix="depsight-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: lineage ends there, and a lost executor costs no recomputation.

    The files go when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/depsight-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Removes the files of table()s that nothing will read again."""
    for df in tables:
        for path in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            _remove(df.sparkSession, path)


def fresh(df: DataFrame, name: str) -> str:
    """The name with as many underscores before it as make it none of df's columns, whatever their case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


#: Ids that may be broadcast: 16 bytes each in a hashed relation, so 32 MB at most.
FEW_IDS = 2_000_000


def few(ids: DataFrame) -> DataFrame:
    """A table of one long column, to be broadcast where it has no more than FEW_IDS rows, so that texts needn't be shuffled to meet it; beyond that as it is."""
    return F.broadcast(ids) if ids.count() <= FEW_IDS else ids


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the JVM may have ended before
        pass


def numbered(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Adds the place of each row in the given order, from 0, without sorting in one task: sorted ranges are counted, then shifted."""
    placed = table(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ranks")
    part, before, shift = F.shiftright("_at", 33), 0, F.lit(0)
    for row in placed.groupBy(part.alias("part")).count().orderBy("part").collect():  # one row for each partition of the sort
        shift = F.when(part >= row["part"], F.lit(before)).otherwise(shift)
        before += row["count"]
    return placed.withColumn(name, F.col("_at").bitwiseAND((1 << 33) - 1) + shift).drop("_at")


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model may learn from: crc32 of the id as text leaves 2 when divided by 4 (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = STEP_CHARS) -> Iterator[pa.Table]:
    """The batches in slices of about size bytes of text, so that memory doesn't follow Arrow's batch size."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        part = np.cumsum(sizes) // size
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield pa.Table.from_batches([batch.slice(a, b - a)]).combine_chunks()
    pa.default_memory_pool().release_unused()  # workers are kept for later tasks; Arrow's free memory isn't


def text_of(t: pa.Table, column: str = "text") -> pa.Array:
    """The column's texts as one large_string array, null as empty."""
    col = t[column].combine_chunks() if isinstance(t[column], pa.ChunkedArray) else t[column]
    return pc.fill_null(col.cast(pa.large_string()), "")


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words one after another, and the place of each text's first word (one more entry for the end)."""
    split = pc.ascii_split_whitespace(texts)
    offsets = np.asarray(split.offsets).astype(np.int64)
    flat = split.flatten()
    offsets = offsets - offsets[0]
    full = np.asarray(pc.not_equal(flat, ""))
    if not full.all():
        before = np.concatenate([[0], np.cumsum(full)])
        flat, offsets = flat.filter(pa.array(full)), before[offsets]
    return flat, offsets


def word_hashes(flat: pa.Array) -> np.ndarray:
    """A 64-bit hash for each word; the same word has the same hash in every task."""
    coded = flat.dictionary_encode()
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))
    return own[np.asarray(coded.indices)] if len(flat) else np.empty(0, np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """The finishing step of a 64-bit hash: every input bit changes every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive entries, by doubling: entry i covers h[i:i+k]."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    odd, out, have, power = np.uint64(0x9E3779B97F4A7C15), None, 0, mixed(h + np.uint64(0x632BE59BD9B4E019))
    size = 1
    while True:
        if k & size:
            out = power.copy() if out is None else mixed(out[: len(h) - have - size + 1] * odd + power[have : have + len(h) - have - size + 1])
            have += size
        if have == k:
            return out
        power = mixed(power[: len(power) - size] * odd + power[size:])
        size *= 2


def doc_of(offsets: np.ndarray) -> np.ndarray:
    """For each word the number of its text within the step."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def over_steps(df: DataFrame, work: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """work on slices of df; work returns the columns of schema in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in steps(batches):
            out = work(t)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def put(**columns) -> pa.RecordBatch:
    """A record batch of arrays by name."""
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))

"""Tables that are kept between changes: rows with signed counts in a shared folder, by versions.

A table is a list of runs, each written once: rows and a count, positive or negative. What a row counts for is the sum over runs; rows that sum to nothing
aren't there. A change adds a run as small as itself. Runs are merged once those behind them have half their rows, so that a row is written again a
logarithmic number of times and a table has a logarithmic number of runs. Each run is cut into buckets by a hash of the table's key, as many as its rows ask
for; a lookup of some keys reads the buckets that these fall into.

A version is a file that names all runs. It comes to be by one rename that fails where the name is taken: of two writers at once one wins, and the other gets
an error and has changed nothing. A reader sees one whole version.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from depsight.tables import TIGHT

#: Rows of a bucket, and buckets of a run at most.
PER_BUCKET, MOST_BUCKETS = 100_000, 1 << 14
#: Tables that are written side by side, and buckets that one task writes where rows are made distinct.
AT_ONCE, BUCKETS_AT_ONCE = 8, 8
#: Versions that are kept; what only older ones name is removed.
KEPT = 3


#: What a first version holds: rows and key of each table, and about how many rows there are where some may be there twice.
Tables = dict[str, tuple[DataFrame, list[str]] | tuple[DataFrame, list[str], int]]


class Taken(RuntimeError):
    """Another writer has published this version."""


@dataclass
class Run:
    path: str
    rows: int
    buckets: int
    there: list[int]  # the buckets that have rows
    once: bool = False  # whether no row is there twice for sure

    def row(self) -> dict:
        return {"path": self.path, "rows": self.rows, "buckets": self.buckets, "there": self.there, "once": self.once}


@dataclass
class Table:
    key: list[str]
    schema: StructType
    runs: list[Run] = field(default_factory=list)


@dataclass
class Store:
    """One version. all() and of() read it; commit() makes the next."""

    spark: SparkSession
    path: str
    version: int
    tables: dict[str, Table]
    more: dict
    per_bucket: int = PER_BUCKET

    @classmethod
    def create(cls, spark: SparkSession, path: str, tables: Tables, more: dict | None = None, per_bucket: int = PER_BUCKET, then: Callable[[Store], Tables] | None = None) -> Store:
        """The first version: of each table its rows, each counting once (or as its column n says), and its key. A folder that has versions already is an error.

        A third entry says that rows may be there twice, of which one is kept, and about how many there are: they move once and are neither counted nor made
        distinct before. then: more tables, from a store that has the first ones but isn't a version yet.
        """

        def started(tables: Tables) -> tuple[Store, dict[str, DataFrame], dict[str, int]]:
            empty = cls(spark, path.rstrip("/"), -1, {name: Table(key, StructType([x for x in df.schema if x.name != "n"])) for name, (df, key, *_) in tables.items()}, {}, per_bucket)
            rows = {name: df if "n" in df.columns else df.withColumn("n", F.lit(1).cast("long")) for name, (df, *_) in tables.items()}
            return empty, rows, {name: most[0] for name, (_, _, *most) in tables.items() if most}

        empty, rows, most = started(tables)
        return empty.commit(rows, more, most, then and (lambda draft: started(then(draft))))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Store:
        """The latest version."""
        files = Files(spark, path)
        if not (found := files.versions()):
            raise FileNotFoundError(f"no version in {path}")
        spec = json.loads(files.read(f"version-{found[-1]:09}.json"))
        tables = {name: Table(x["key"], StructType.fromJson(x["schema"]), [Run(**r) for r in x["runs"]]) for name, x in spec["tables"].items()}
        return cls(spark, path.rstrip("/"), found[-1], tables, spec["more"], spec["per_bucket"])

    def paths(self, name: str, keys: DataFrame | None = None) -> list[str]:
        """The folders that hold the rows of these keys (all rows without any)."""
        table, out, fallen = self.tables[name], [], {}
        for run in table.runs:
            there = run.there
            if keys is not None and run.buckets > 1:
                if run.buckets not in fallen:  # as many numbers as there are buckets at most
                    fallen[run.buckets] = {r[0] for r in keys.select(bucket(keys.columns, run.buckets).alias("b")).distinct().collect()}
                there = [b for b in there if b in fallen[run.buckets]]
            out += [f"{self.path}/{run.path}/bucket={b}" for b in there]
        return out

    def _summed(self, name: str, paths: list[str], keys: DataFrame | None = None) -> DataFrame:
        schema = StructType([*self.tables[name].schema.fields, StructField("n", LongType())])
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        if keys is not None:
            rows = rows.join(keys.distinct(), keys.columns, "left_semi")
        if [r.once for r in self.tables[name].runs] == [True]:  # nothing to add up
            return rows.select(*schema.names)
        return rows.groupBy(*schema.names[:-1]).agg(F.sum("n").alias("n")).where("n <> 0")

    def all(self, name: str) -> DataFrame:
        """The rows of a table and what they count for (n)."""
        return self._summed(name, self.paths(name))

    def of(self, name: str, keys: DataFrame) -> DataFrame:
        """The rows whose key is among keys (columns named as the table's key, in its order), and n. Null keys match nothing."""
        keys = keys.select(*self.tables[name].key)
        return self._summed(name, self.paths(name, keys), keys)

    def commit(self, changes: dict[str, DataFrame], more: dict | None = None, most: dict[str, int] | None = None, then: Callable | None = None) -> Store:
        """The next version: each table with the signed rows of its change (its columns and n) added. Raises Taken where another writer was first. most, then: create()'s."""
        files, version = Files(self.spark, self.path), self.version + 1
        mark, fresh = f"{version:09}-{uuid.uuid4().hex[:8]}", []
        try:
            tables = self._all_grown(changes, most or {}, mark, fresh, files)
            if then is not None:
                empty, rows, limits = then(Store(self.spark, self.path, version, tables, self.more, self.per_bucket))
                tables |= empty._all_grown(rows, limits, mark, fresh, files)
            spec = {"tables": {name: {"key": t.key, "schema": t.schema.jsonValue(), "runs": [r.row() for r in t.runs]} for name, t in tables.items()}, "more": self.more | (more or {}), "per_bucket": self.per_bucket}
            files.publish(f"version-{version:09}.json", json.dumps(spec))
        except Exception:
            for path in fresh:
                files.remove(path)
            raise
        out = Store(self.spark, self.path, version, tables, spec["more"], self.per_bucket)
        out._clean(files)
        return out

    def _all_grown(self, changes: dict[str, DataFrame], most: dict[str, int], mark: str, fresh: list[str], files: Files) -> dict[str, Table]:
        with ThreadPoolExecutor(AT_ONCE) as pool:  # tables are independent: their small jobs run side by side
            return dict(zip(self.tables, pool.map(lambda name: self._grown(name, changes.get(name), mark, fresh, files, most.get(name)), self.tables), strict=True))

    def _grown(self, name: str, change: DataFrame | None, mark: str, fresh: list[str], files: Files, most: int | None = None) -> Table:
        """The table with the rows of its change as a new run, merged with the runs that it has come up with."""
        table = self.tables[name]
        if change is None:
            return table
        names = table.schema.names
        fresh.append(first := f"{name}-{mark}")
        if most is not None:
            run = self._write_once(change.select(*names, F.col("n").cast("long").alias("n")), first, table.key, most)
            return Table(table.key, table.schema, [run] if run.rows else [])
        about = change.count()
        large = about > self.per_bucket
        if self.version < 0 or large:  # rows that are there twice are summed when they are read
            delta = change.select(*names, F.col("n").cast("long").alias("n")).where("n <> 0")
        else:
            delta = change.groupBy(*names).agg(F.sum("n").cast("long").alias("n")).where("n <> 0").select(*names, "n")
        if self.version < 0 or large:
            run = self._write(delta, first, table.key, about)
        else:  # small: one bucket will do
            delta.withColumn("bucket", F.lit(0)).coalesce(1).write.partitionBy("bucket").parquet(f"{self.path}/{first}", compression=TIGHT)
            run = self._counted(first, delta.schema, 1)
        k, total = len(table.runs), run.rows
        while total and k and 2 * total >= table.runs[k - 1].rows:
            k -= 1
            total += table.runs[k].rows
        if k < len(table.runs):
            fresh.append(last := f"{name}-{mark}-merged")
            rows = self.spark.read.schema(delta.schema).parquet(*[f"{self.path}/{r.path}/bucket={b}" for r in [*table.runs[k:], run] for b in r.there])
            run = self._write(rows.groupBy(*names).agg(F.sum("n").alias("n")).where("n <> 0"), last, table.key, total)
            run.once = True
            files.remove(first)
        if not run.rows:
            files.remove(run.path)
        return Table(table.key, table.schema, [*table.runs[:k], *([run] if run.rows else [])])

    def _write(self, rows: DataFrame, path: str, key: list[str], about: int) -> Run:
        many = max(1, min(MOST_BUCKETS, -(-about // self.per_bucket)))
        placed = rows.withColumn("bucket", bucket(key, many))
        placed = placed.hint("rebalance", "bucket") if many > 1 else placed.coalesce(1)
        placed.write.partitionBy("bucket").parquet(f"{self.path}/{path}", compression=TIGHT)
        return self._counted(path, rows.schema, many)

    def _write_once(self, rows: DataFrame, path: str, key: list[str], most: int) -> Run:
        """Rows by buckets, each once: a row's copies meet in its bucket."""
        many = max(1, min(MOST_BUCKETS, -(-most // self.per_bucket)))
        parts = max(1, -(-many // BUCKETS_AT_ONCE))
        names = [c for c in rows.columns if c != "n"]
        placed = rows.select(*names, bucket(key, many).alias("bucket")).repartition(parts, "bucket")
        placed.groupBy("bucket", *names).agg(F.lit(1).cast("long").alias("n")).select(*names, "n", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{path}", compression=TIGHT)
        run = self._counted(path, rows.schema, many)
        run.once = True
        return run

    def _counted(self, path: str, schema: StructType, many: int) -> Run:
        rows = self.spark.read.schema(StructType([schema["n"], StructField("bucket", IntegerType())])).parquet(f"{self.path}/{path}")
        counts = {r["bucket"]: r["c"] for r in rows.groupBy("bucket").agg(F.count("*").alias("c")).collect()}  # as many rows as buckets
        return Run(path, sum(counts.values()), many, sorted(counts))

    def _clean(self, files: Files) -> None:
        old = [v for v in files.versions() if v <= self.version - KEPT]
        if not old:
            return
        runs = lambda v: {r["path"] for t in json.loads(files.read(f"version-{v:09}.json"))["tables"].values() for r in t["runs"]}
        kept = set().union(*(runs(v) for v in files.versions() if v > self.version - KEPT))
        for v in old:
            for path in runs(v) - kept:
                files.remove(path)
            files.remove(f"version-{v:09}.json")


def bucket(key: list[str], many: int):
    return F.pmod(F.xxhash64(*key), F.lit(many)).cast("int")


class Files:
    """The folder's small files, through Hadoop: any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.at = lambda name="": jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + (f"/{name}" if name else ""))
        self.jvm, self.gateway, self.fs = jvm, spark.sparkContext._gateway, self.at().getFileSystem(conf)
        self.context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.makeQualified(self.at()).toUri(), conf)

    def versions(self) -> list[int]:
        if not self.fs.exists(self.at()):
            return []
        names = [x.getPath().getName() for x in self.fs.listStatus(self.at())]
        return sorted(int(n[8:17]) for n in names if n.startswith("version-") and n.endswith(".json"))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Writes a file beside its place and renames it; an existing one stays and is an error."""
        beside = f"_{name}-{uuid.uuid4().hex}"
        self.fs.mkdirs(self.at())
        stream = self.fs.create(self.at(beside), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        options = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = getattr(self.jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
        try:
            self.context.rename(self.at(beside), self.at(name), options)
        except Exception as e:
            self.remove(beside)
            if "FileAlreadyExists" in str(e):
                raise Taken(f"{name} has been published by another writer") from e
            raise

    def remove(self, name: str) -> None:
        self.fs.delete(self.at(name), True)

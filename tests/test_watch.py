"""Bursts by arrival time, forced flush, and a stream that keeps an index current across restarts."""

import os
import time

from pyspark.sql import functions as F

from depsight.plans.kept import KeptIndex
from depsight.sources import tree
from depsight.streaming import debounce, watch
from tests.test_kept import graph_of
from tests.test_tree import BASE, frame, planted

SCHEMA = "path string, kind string, ts timestamp"


def wait(condition, query, seconds=60):
    end = time.time() + seconds
    while not condition() and time.time() < end:
        assert query.exception() is None, query.exception()
        time.sleep(0.2)
    assert condition()


def put(spark, folder, rows, name):
    """One file of events; it appears at once."""
    df = spark.createDataFrame(rows, "path string, kind string, s double").select("path", "kind", F.timestamp_seconds("s").alias("ts"))
    df.toPandas().to_parquet(f"{folder}/.{name}", index=False, coerce_timestamps="us", allow_truncated_timestamps=True)
    os.rename(f"{folder}/.{name}", f"{folder}/{name}.parquet")


def test_bursts(spark, tmp_path):
    """Five writes in a row come out as one or two, the last without any event after it; what is pending at a stop is flushed, and comes out after a restart."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", watch.ROCKS)
    folder, got = str(tmp_path / "events"), []
    os.makedirs(folder)

    def start(quiet):
        stream = debounce.arrivals(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder), quiet)
        return stream.writeStream.foreachBatch(lambda b, _: got.extend((r["path"], r["kind"], r["events"]) for r in b.collect())).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(processingTime="100 milliseconds").start()

    for k in range(5):
        put(spark, folder, [("a.ts", "removed" if k < 4 else "touched", k * 0.02)], f"w{k}")
    query = start(2000)
    wait(lambda: sum(x[2] for x in got) == 5, query)
    assert 1 <= len(got) <= 2 and got[-1][:2] == ("a.ts", "touched")
    query.stop()
    got.clear()
    put(spark, folder, [("b.ts", "touched", 1.0), ("b.ts", "removed", 2.0), ("c.ts", "touched", 1.0)], "x")
    query = start(3_600_000)
    wait(lambda: any(p["numInputRows"] == 3 for p in query.recentProgress), query)
    query.stop()
    assert not got and {tuple(r) for r in debounce.pending(spark, str(tmp_path / "state")).collect()} == {("b.ts", "removed", 2), ("c.ts", "touched", 1)}
    put(spark, folder, [("c.ts", "removed", 3.0)], "y")  # the burst goes on after the restart
    query = start(500)
    wait(lambda: ("c.ts", "removed", 2) in got, query)
    query.stop()


def test_an_index_follows_a_stream(spark, tmp_path):
    """Batches go into the kept index, ignored files don't; after a stop the rest is flushed and a second query goes on."""
    root, folder, path, seen = planted(tmp_path / "tree", BASE | {".gitignore": "build/\n"}), str(tmp_path / "events"), str(tmp_path / "index"), []
    os.makedirs(folder)
    KeptIndex.create(path, frame(spark, BASE), root_name="top")
    read = lambda asked: tree.contents(asked, root).where("content IS NOT NULL")
    rules = lambda: tree.rules_of(tree.contents(spark.createDataFrame([(".gitignore",)], "path string"), root))
    start = lambda quiet: watch.follow(spark.readStream.schema(SCHEMA).parquet(folder), path, read, str(tmp_path / "state"), lambda g, diff: seen.append({tuple(r) for r in diff.collect()}), quiet, rules)
    planted(tmp_path / "tree", {"p/b/y.ts": "import 'vue'", "late.ts": "import './consumer'", "build/out.ts": "import 'no'", "node_modules/m/i.ts": ""})
    os.remove(tmp_path / "tree" / "p/a/x.ts")
    put(spark, folder, [("p/b/y.ts", "modify_data", 0.0), ("p/b/y.ts", "modify_data", 0.02), ("p/a/x.ts", "create", 0.0), ("p/a/x.ts", "remove_file", 0.03), ("late.ts", "create", 0.05), ("build/out.ts", "create", 0.05), ("node_modules/m/i.ts", "create", 0.05), ("loader.ts", "access", 0.06), ("readme.md", "create", 0.06)], "a")
    query = start(300)
    wait(lambda: seen, query, 120)
    query.stop()
    changed = set().union(*seen)
    assert {("add", "edge", None, "late.ts", "consumer.ts"), ("add", "edge", None, "package:@o/b", "external:vue"), ("remove", "edge", None, "p/a/index.ts", "p/a/x.ts")} <= changed and not any("build" in str(x) or "no" == x[2] for x in changed)
    planted(tmp_path / "tree", {"late.ts": "import './broken'"})
    put(spark, folder, [("late.ts", "modify_data", 9.0)], "b")
    before = len(seen)
    query = start(3_600_000)
    wait(lambda: any(p["numInputRows"] == 1 for p in query.recentProgress), query)
    query.stop()
    g, diff = watch.applied(debounce.pending(spark, str(tmp_path / "state")), path, read, rules)
    assert {tuple(r) for r in diff.collect()} == {("remove", "edge", None, "late.ts", "consumer.ts"), ("add", "edge", None, "late.ts", "broken.ts")} and len(seen) == before
    assert ("late.ts", "broken.ts") in graph_of(KeptIndex.open(spark, path))[1]

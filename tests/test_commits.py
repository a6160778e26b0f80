import datetime
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from depsight.sources import commits


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", 256)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_headers_are_carried_over_splits(spark, tmp_path, small_splits):
    rng, start, plain = random.Random(5), 1_700_000_000, []
    for file in range(2):
        text = ["stray.ts\n"]
        for k in range(60):
            names = [f"src/a b{rng.randrange(12)}.ts" for _ in range(rng.choice([0, 1, 2, 40]))]  # 40 names span several splits
            at = start - rng.randrange(60) * 86_400
            text.append(f"\x01{file:02x}{k:038x} {at}\n" + "".join(f"{n}\n" for n in names) + "\n")
            plain += [(f"{file:02x}{k:038x}", at, n) for n in names]
        (tmp_path / f"{file}.log").write_text("".join(text))
    found = commits.touches(spark, f"file://{tmp_path}")
    assert spark.read.text(f"file://{tmp_path}").rdd.getNumPartitions() > 40
    assert Counter((r["commit"], r["s"], r["path"]) for r in found.select("commit", F.unix_timestamp("at").alias("s"), "path").collect()) == Counter(plain)
    for days in (0, 7, 30):
        since = F.timestamp_seconds(F.lit(start - days * 86_400))
        want = Counter(f"/repo/{n}" for _, at, n in plain if at >= start - days * 86_400)
        assert {r["path"]: r["commits"] for r in commits.churn(found, since, "/repo/").collect()} == want


def test_no_log_and_empty_log(spark, tmp_path):
    assert commits.touches(spark, f"file://{tmp_path}/none").count() == 0
    (tmp_path / "empty.log").write_text("\n\n")
    assert commits.churn(commits.touches(spark, f"file://{tmp_path}/empty.log")).count() == 0
    (tmp_path / "one.log").write_text("\x01ab 86400\nx.ts\n y.ts \n")
    rows = commits.touches(spark, f"file://{tmp_path}/one.log").orderBy("path").collect()
    assert [(r["commit"], r["path"]) for r in rows] == [("ab", "x.ts"), ("ab", "y.ts")]
    assert all(isinstance(r["at"], datetime.datetime) for r in rows)

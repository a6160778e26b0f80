from collections import Counter

from pyspark.sql import functions as F

from depsight.llm import jaccard
from tests.llm import brute


def classes_of(spark, size, percent):
    base = jaccard.base_of(spark.read.parquet(f"{brute.DATA}/sf0.1/documents.parquet"), "doc_id", "text")
    sets = jaccard.table(jaccard.prefixes(base, jaccard.counters(base, size), size, percent), "prefixes").where("n > 0")
    return jaccard.table(sets.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("doc"), F.first("pre").alias("pre")), "classes")


def candidates(rows, percent):
    """Pairs of few that have the matches asked for."""
    size = lambda x: jaccard.place(F.col(x))[:2]
    own = rows.groupBy("doc").agg(F.first("at").alias("at"))
    pairs = jaccard.pairs_of_few(rows, percent).join(own.select(F.col("doc").alias("a"), F.col("at").alias("x")), "a").join(own.select(F.col("doc").alias("b"), F.col("at").alias("y")), "b")
    return pairs.where(F.col("k") >= jaccard.asked(size("x"), size("y"), percent)).count()


def test_documents_choose_lengths_by_cost(spark, monkeypatch):
    """Choices are those of the costs counted in plain Python; some documents lengthen their prefix, and fewer pairs are candidates than with classic ones."""
    monkeypatch.setattr(jaccard, "CROWD", 10**6)  # so that every shared shingle makes pairs
    size, percent = 3, 90
    known = classes_of(spark, size, percent)
    rows = jaccard.table(jaccard.chosen(known, percent), "chosen")
    got = {r["doc"]: r["choice"] for r in rows.select("doc", "choice").distinct().collect()}

    plain = [(r["doc"], r["n"], r["pre"]) for r in known.collect()]
    count = Counter(x for _, _, pre in plain for x in pre)
    want = {}
    for doc, n, pre in plain:
        least = n - (percent * n + 99) // 100 + 1
        cost = [sum(count[x] - 1 for x in pre[: min(n, least + e)]) * (1 + jaccard.CANDIDATE / (1 + e)) for e in jaccard.EXTRA]
        if any(count[x] > 1 for x in pre[:least]):
            want[doc] = cost.index(min(cost))
    assert got == want
    assert len(set(got.values())) == len(jaccard.EXTRA)
    assert sum(1 for c in got.values() if c) > len(plain) / 2

    adaptive = candidates(rows, percent)
    monkeypatch.setattr(jaccard, "EXTRA", (0, 0, 0, 0))
    classic = candidates(jaccard.table(jaccard.chosen(known, percent), "classic"), percent)
    assert adaptive < classic

"""Each stage of the pipeline against plain Python on a small fixture, with odd rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from depsight.llm import bpe, lines, mixing, queries, toxicity  # noqa: E402
from tests.llm import brute  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copies int"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_toxic_documents_go_and_clean_ones_stay(spark):
    d = f"{brute.DATA}/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, d)
    assert kept.schema == docs.schema
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    insults = {"idiot", "moron", "clown", "scum", "worthless", "pathetic", "disgusting"}
    bad = {r["doc_id"] for r in docs.collect() if insults & {w.strip(".,").lower() for w in brute.words(r["text"])}}
    assert len(bad - ids) >= 0.95 * len(bad)
    clean = [i for i, x in labels.items() if x == 0]
    assert sum(i in ids for i in clean) >= 0.97 * len(clean)


def test_toxicity_cases(spark):
    docs = spark.createDataFrame([(i, "you are a scum today " * 3 if i % 2 else "have a nice day today " * 3, None, None, 1, 0) for i in range(80)] + [(100, None, None, None, 0, 1), (101, " ", None, None, 0, 1)], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(3, 1)], "doc_id long, toxic int")
    net = toxicity.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, net).collect()}
    assert got[1] > 0.5 > got[2] and got[100] == got[101] == 0 and len(got) == 82
    assert {r[0] for r in toxicity.clean(docs, net).select("doc_id").collect()} == {i for i in range(80) if i % 2 == 0} | {100, 101}
    assert toxicity.train(docs, labels.where("toxic = 0")) is None and toxicity.clean(docs, None).count() == 82
    long = spark.createDataFrame([(1, "fine words " * 20_000 + "scum " + "fine words " * 5000)], "doc_id long, text string")
    assert toxicity.score(long, net).first()["score"] > 0.3  # a passage anywhere in a long text counts


def lines_brute(rows, ratio):
    pages = Counter(s for _, _, s in rows)
    count = Counter((s, x) for _, t, s in rows for x in set((t or "").split("\n")) if brute.words(x))
    out = []
    for i, t, s in rows:
        kept = [x for x in (t or "").split("\n") if not (count[s, x] > 1 and brute.words(x) and count[s, x] > ratio * pages[s])]
        out.append((i, t if t is None else "\n".join(kept)))
    return sorted(out, key=str)


def test_line_dedup(spark):
    rng = random.Random(1)
    pool = [f"line {i} of the pool" for i in range(30)] + ["", "  ", "\t"]
    rows = [(i, None if i % 37 == 0 else "\n".join(rng.choice(pool) for _ in range(rng.randrange(6))), rng.choice(["a", "a", "b", None, f"s{i}"])) for i in range(300)]
    rows += rows[:5]
    docs = spark.createDataFrame([(i, t, None, s, 0, 3) for i, t, s in rows], SCHEMA)
    got = lines.dedup(docs)
    assert got.schema.names == docs.schema.names
    assert rows_of(got.select("doc_id", "text")) == lines_brute(rows, lines.RATIO)
    assert lines.dedup(docs.limit(0)).count() == 0


def test_near_copies(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    texts = [" ".join([f"e{rng.randrange(10**6)}" if rng.random() < 0.01 else w for w in base]) for _ in range(30)] + ["", None, "short one", "Short  ONE", "alone in here"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 1) for i, t in rows] + [(33, "Short  ONE", "en", "s", 0, 1), (34, "alone in here", "en", "s", 0, 1), (None, "x", "en", "s", 0, 1)], SCHEMA)
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    want = brute.components(rows, 80, 5)
    clash = corpus_pipeline.drop_near_copies(spark, docs.withColumns({c: F.lit(c) for c in ("gone", "again", "key", "row")}), "")
    assert {tuple(r)[-4:] for r in clash.collect()} == {("gone", "again", "key", "row")}
    assert sorted((r["doc_id"] for r in got.collect()), key=str) == sorted([i for i, (_, c) in want.items() if c == i] + [None], key=str)


def test_mixing(spark):
    rows = [(i, "w " * (i % 50), ["a", "b", None, "c"][i % 4 if i % 3 else 0]) for i in range(400)] + [(7, "x y", "z"), (7, "x y", "z"), (None, None, "a")]
    docs = spark.createDataFrame([(i, t, None, s, 0, 9) for i, t, s in rows], SCHEMA)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(brute.words(t))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}
    cap, total, full = {s: 2 * sizes[s] for s in order}, 1.5 * sum(sizes.values()), set()
    while True:
        level = (total - sum(cap[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        above = {s for s in order if s not in full and weight[s] * level > cap[s]}
        if not above:
            break
        full |= above
    goal = {r["source"]: r["target"] for r in mixing.targets(docs.select("source", mixing.n_words(F.col("text")).alias("size"))).collect()}
    assert goal == pytest.approx({s: cap[s] if s in full else weight[s] * level for s in order})
    taken = mixing.taken(docs).collect()
    assert len(taken) == len(rows) and all(r["taken"] <= 2 * r["size"] for r in taken) and abs(sum(r["taken"] for r in taken) / total - 1) < 0.15
    more = ("goal_source", "goal_size", "goal", "Copy")
    mix = mixing.mix(docs.withColumns({c: F.lit(c) for c in more}))
    assert mix.schema.names == [*docs.schema.names, *more]
    assert {tuple(r) for r in mix.select("copies", *more).distinct().collect()} == {(9, *more)}
    assert sum(len(brute.words(r["text"])) for r in mix.collect()) == sum(r["taken"] for r in taken)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.taken(docs.limit(0)).count() == 0
    assert mixing.mix(docs.where("text is null")).count() == 0


def test_run_feeds_each_stage_the_last_ones_rows(spark):
    d = f"{brute.DATA}/sf0.001"
    out = corpus_pipeline.run(spark, d).collect()
    known = {r["doc_id"] for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id").collect()}
    assert out and {r["doc_id"] for r in out} < known
    codec = bpe.codec(queries.tokenizer_path())
    assert all(len(r["ids"]) == r["n_tokens"] for r in out) and codec.decode(out[0]["ids"])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "mixing", "bpe"]

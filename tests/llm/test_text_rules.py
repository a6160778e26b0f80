"""Quality rules and language identification."""

import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from depsight.llm import language, quality, queries
from tests.llm import brute

ODD = [None, "", " \n\t ", "one", "a b c d e f g h " * 40, "x\n\nx\n \nx", "é|ü ##\n" * 3, "word" * 20000, "1 2 3"]


def test_quality_base_matches_brute_force(spark):
    d = f"{brute.DATA}/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(10_000 + i, t, None) for i, t in enumerate(ODD)], docs.schema)
    got = {r["doc_id"]: r for r in quality.measured(docs.unionByName(odd).withColumn("n_words", F.lit("clash")), "doc_id", "text", "lang").collect()}
    for i, t in [(r["doc_id"], r["text"]) for r in docs.collect()] + [(10_000 + i, t) for i, t in enumerate(ODD)]:
        for k, v in brute.quality(t).items():
            assert got[i][k] == v, (i, k)


def test_quality_keeps_what_no_label_speaks_against(spark):
    docs = spark.createDataFrame([(1, "good words here " + " ".join(f"w{i}" for i in range(30)), "en"), (2, None, None), (2, None, None)], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality.judged(docs, none).collect()
    assert sorted((r["doc_id"], r["base_failed"], r["kept"]) for r in rows) == [(1, False, True), (2, True, False), (2, True, False)]
    assert quality.judged(docs.limit(0), none).count() == 0


def test_quality_bounds_are_exact():
    assert abs(quality.at_most(0, 10, 0.1) - 0.9**10) < 1e-12
    assert abs(quality.at_most(2, 5, 0.5) - 0.5) < 1e-12
    assert quality.at_most(5, 5, 0.2) == 1


def test_quality_false_rejections_stay_within_the_risk(spark):
    d = f"{brute.DATA}/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    held = quality.held_out(F.col("doc_id"))
    found = quality.judged(docs, labels).where(held & ~F.col("base_failed")).join(labels, "doc_id").groupBy("quality").agg(F.count("*").alias("n"), F.count(F.when(~F.col("kept"), 1)).alias("out")).collect()
    by = {r["quality"]: r["out"] / r["n"] for r in found}
    assert by[1] <= quality.RISK and by[0] > by[1]


def test_quality_levels_fire_in_every_stratum_with_labels(spark):
    d = f"{brute.DATA}/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    measures = quality.measured(docs, "doc_id", "text", "lang")
    assert all(r["level"] >= 0 for r in quality.levels(measures, labels).collect())


def test_quality_verdict_matches_plain_python(spark):
    """kept by levels, binomial sums and rules written out, on a fixture with two strata."""
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["plain", "words", "here", "#", "and", "so", f"u{rng.randrange(999)}"] if rng.random() < (0.2 if i % 3 else 0.9) else [f"u{rng.randrange(99999)}"]) for _ in range(rng.randrange(15, 60))), ["a", "b", None][i % 7 % 3]) for i in range(900)]
    good = {i: int(i % 3 > 0) for i, _, _ in rows if i % 5}
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, level int, own int")
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.judged(docs, spark.createDataFrame(list(good.items()), "doc_id long, quality int")).collect()}

    def measures(t):
        m, lines = brute.quality(t), [x for x in t.split("\n") if brute.words(x)]
        n = max(m["n_words"], 1)
        return m["n_words"], [m["n_symbols"] / n, m["n_dup_lines"] / max(len(lines), 1), m["n_repeat_words"] / n, m["word_chars"] / n, -m["word_chars"] / n]

    def rejects(v, level):
        return any(x > cs[level] for x, cs in zip(v, quality.RULES.values(), strict=True))

    known = {i: (lang, *measures(t)) for i, t, lang in rows}
    fails = {i: n < 20 or v[2] > 0.3 for i, (_, n, v) in known.items()}
    fold = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 != 2 and good.get(i) == 1 and not fails[i]}
    strata, level = {known[i][0] for i in fold}, {}
    for s in strata:
        mine = [known[i][2] for i in fold if known[i][0] == s]
        for k in range(quality.LEVELS):
            gone = sum(rejects(v, k) for v in mine)
            if sum(math.comb(len(mine), j) * quality.RISK**j * (1 - quality.RISK) ** (len(mine) - j) for j in range(gone + 1)) > quality.ERROR / len(strata):
                break
            level[s] = k
    assert level and got == {i: (fails[i], not fails[i] and not (lang in level and rejects(v, level[lang]))) for i, (lang, _, v) in known.items()}
    assert any(not f and not k for f, k in got.values())


def test_viterbi_matches_a_plain_one():
    rng = np.random.default_rng(8)
    for k in (1, 3, 300):
        sizes = rng.integers(0, 12, 20)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        scores = rng.normal(0, 6, (int(offsets[-1]), k)).astype(np.float32)
        got = language.viterbi(scores, offsets, switch=4.0)
        for a, b in zip(offsets, offsets[1:], strict=False):
            rows = scores[a:b].astype(float)
            worth = lambda path, rows=rows: sum(rows[i, x] for i, x in enumerate(path)) - 4.0 * sum(x != y for x, y in zip(path, path[1:], strict=False))
            best = np.zeros((b - a, k))
            for t in range(b - a):
                best[t] = rows[t] + (np.maximum(best[t - 1], best[t - 1].max() - 4.0) if t else 0)
            assert b == a or abs(worth(got[a:b].tolist()) - best[-1].max()) < 1e-3


def test_marks_are_no_letters_and_languages_may_be_many(spark):
    docs = spark.createDataFrame([(i, f"word{chr(97 + i % 26)}{chr(97 + i // 26)} " * 5, f"l{i:03}") for i in range(300)], "doc_id long, text string, lang string")
    model = language.train(docs)
    assert len(model.languages) > 128
    asked = spark.createDataFrame([(1, "\u0301\u0302"), (2, "a\u0301" * 50_000), (3, docs.first()["text"])], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(asked, model).collect()}
    assert got[1] == ("und", 0.0) and got[2][0] != "und" and got[3][0] in model.languages
    assert language.predict(asked.limit(0), model).count() == 0


def test_language_accuracy_on_the_held_out_fold(spark):
    d = f"{brute.DATA}/sf0.01"
    got = queries.op8_language(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'")
    row = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"), F.count("*").alias("n")).first()
    assert row["n"] > 150 and row["right"] > 0.97


def test_language_cases(spark):
    docs = spark.createDataFrame(
        [(i, t, lang) for i, (t, lang) in enumerate([("the house and the garden", "en"), ("das haus und der garten", "de"), ("дом и сад", "ru"), (None, "en"), ("...", None), ("12 34", "de")] * 20)],
        "doc_id long, text string, lang string",
    )
    model = language.train(docs)
    assert model.languages == ["de", "en", "ru"]
    asked = spark.createDataFrame([(1, "the garden and the house", 1), (2, None, 1), (3, "?! 77", 1), (4, "сад и дом", 1), (5, "the house and the garden " * 5 + "дом и сад " * 4, 1), (None, "", 1)], "doc_id long, text string, score int")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(asked, model).collect()}
    assert got[1][0] == "en" and got[2] == ("und", 0.0) and got[3] == ("und", 0.0) and got[4][0] == "ru" and got[5][0] == "en" and got[None] == ("und", 0.0)
    assert [(r["lang"], r["first_word"], r["n_words"]) for r in language.spans(asked.where("doc_id = 5"), model).collect()] == [("en", 0, 25), ("ru", 25, 12)]
    nothing = language.train(docs.limit(0))
    assert {r["lang_pred"] for r in language.predict(asked, nothing).collect()} == {"und"}

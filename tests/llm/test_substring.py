import hashlib
import random

import numpy as np

from depsight.llm import substring
from tests.llm import brute


def check(spark, rows, size=35, gram=8):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, hash string")
    want = sorted((i or -1, len(brute.words(t)), len(brute.words(t)) - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest()) for (i, t), k in zip(rows, brute.kept_words([t for _, t in rows], size), strict=True))
    got = sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.dedup(docs, size=size, gram=gram).collect())
    assert got == want
    return got


def test_documents(spark):
    docs = spark.read.parquet(f"{brute.DATA}/sf0.01/documents.parquet").select("doc_id", "text").collect()
    assert any(r[2] for r in check(spark, [(r[0], r[1]) for r in docs]))


def test_random_passages_at_all_edges(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    passages = [[word() for _ in range(rng.randrange(5, 60))] for _ in range(12)]
    rows = []
    for i in range(80):
        w = []
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            w += [word() for _ in range(rng.randrange(6))] + p[a : a + rng.randrange(60)]
        rows.append((i, " ".join(w)))
    for size, gram in ((10, 3), (12, 4), (35, 8)):
        check(spark, rows, size, gram)


def test_odd_cases(spark):
    base = " ".join(f"w{i}" for i in range(50))
    same = "a " * 500
    rows = [(1, None), (2, ""), (3, " \n"), (4, base), (5, base), (5, base), (5, "x " + base), (None, base), (6, same), (7, " ".join(f"v{i}" for i in range(34))), (8, " ".join(f"v{i}" for i in range(34))), (9, " ".join(f"u{i}" for i in range(35)) + "\t"), (10, "\v".join(f"u{i}" for i in range(35)))]
    check(spark, rows)
    check(spark, [(1, "a b " * 20_000), (2, " ".join(f"t{i}" for i in range(30_000)))])
    check(spark, [])


def test_factors_follow_the_reference(spark):
    """Each factor's words stand at its place in the reference, and a passage is one factor however many blocks it has."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(900)]
    rows = [(1, [word() for _ in range(50)] + passage + [word()]), (2, passage[100:800] + [word() for _ in range(9)]), (3, [word()] + passage[:300] + passage[500:]), (4, [word() for _ in range(90)])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    texts, found = dict(rows), substring.factors(docs).collect()
    for r in found:
        a, b = texts[r["doc_id"]][r["first_word"] :][: r["n_words"]], texts[r["ref_id"]][r["ref_word"] :][: r["n_words"]]
        assert a == b and len(a) == r["n_words"] >= 35 and (r["doc_id"], r["first_word"]) != (r["ref_id"], r["ref_word"])
    assert max(r["n_words"] for r in found if r["doc_id"] == 2) > 500 and {r["doc_id"] for r in found} == {1, 2, 3}
    assert sum(r["doc_id"] == 2 for r in found) <= 3


def test_greedy_parse():
    """The longest match at each place, then the next one."""
    a, b = ("a", 0), ("b", 0)
    blocks = [(0, 5, [(a, 100), (b, 10)]), (5, 3, [(a, 105), (b, 15)]), (8, 2, [(b, 18)]), (10, 4, [(a, 7)]), (20, 1, [(a, 17)])]
    assert substring.parsed(blocks) == [(0, 10, (b, 10)), (10, 4, (a, 7)), (20, 1, (a, 17))]
    assert substring.parsed([]) == []


def test_least_place():
    h = np.array([5, 3, 3, 9, 1, 1, 7, 2], np.uint64)
    for wide in range(1, 9):
        assert substring.least_place(h, wide).tolist() == [i + int(np.argmin(h[i : i + wide])) for i in range(len(h) - wide + 1)]

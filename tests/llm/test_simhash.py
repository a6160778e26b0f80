import hashlib
import random

from pyspark.sql import functions as F

from depsight.llm import simhash
from tests.llm import brute


def edited(rows):
    """Contract's edited texts by id, for ids that occur once."""
    ids = sorted(rows)
    out = {}
    for k, i in enumerate(ids):
        t, n = rows[i] or "", len(rows[i] or "") // 4
        out[i] = t[: len(t) - n] + (rows[ids[(k + 1) % len(ids)]] or "")[:n]
    return out


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows.items()], "doc_id long, text string, hash string")
    got = {r["doc_id"]: r for r in simhash.compared(docs).collect()}
    want, ids = edited(rows), sorted(rows)
    assert sorted(got) == ids
    for k, i in enumerate(ids):
        r, after = got[i], got[ids[(k + 1) % len(ids)]]
        assert r["n_chars"] == len(rows[i] or "") and r["edited_sha256"] == hashlib.sha256(want[i].encode()).hexdigest()
        bits = lambda a, b: 1 - bin(int(a, 16) ^ int(b, 16)).count("1") / 64
        assert r["near_edited"] == bits(r["fingerprint"], r["edited_fingerprint"]) and r["near_next"] == bits(r["fingerprint"], after["fingerprint"])
    # the fingerprint of an edited text is that of a document with this text
    again = {r["doc_id"]: r for r in simhash.compared(spark.createDataFrame([(i, t) for i, t in want.items()], "doc_id long, text string")).collect()}
    assert all(again[i]["fingerprint"] == got[i]["edited_fingerprint"] for i in ids)
    return got


def test_documents_and_odd_cases(spark):
    docs = spark.read.parquet(f"{brute.DATA}/sf0.001/documents.parquet").where("doc_id < 120").select("doc_id", "text").collect()
    got = check(spark, {r[0]: r[1] for r in docs})
    full = [r for r in got.values() if r["n_chars"] > 400]
    assert sum(r["near_edited"] for r in full) / len(full) > sum(r["near_next"] for r in full) / len(full) + 0.15
    check(spark, {5: None, 2: "", 9: " \n\t", 11: "a", 12: "é 😀 b c", 13: "w " * 40_000, 14: "same words here now ok", 15: "same words here now ok"})
    assert check(spark, {1: "alone in the table with words"})[1]["near_next"] == 1.0


def test_equal_texts_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (1, "other text"), (2, "a b c d e f"), (None, "x"), (3, None)], "doc_id long, text string")
    rows = simhash.compared(docs).collect()
    assert len(rows) == 6
    assert len({r["fingerprint"] for r in rows if r["n_chars"] == 11}) == 1
    assert [r["fingerprint"] for r in rows if r["doc_id"] == 3] == ["0" * 16]
    assert simhash.compared(docs.limit(0)).count() == 0


def test_votes_follow_the_definition(spark):
    text = "a b a b a b a c d e f g a b a b a"
    w = text.split()
    terms = spark.createDataFrame([(" ".join(w[i : i + 5]),) for i in range(len(w) - 4)], "t string").select(F.xxhash64(*[F.split("t", " ")[k] for k in range(5)]).alias("h")).collect()
    want = sum(1 << b for b in range(64) if 2 * sum((r["h"] >> b) & 1 for r in terms) > len(terms))
    got = simhash.fingerprints(spark.createDataFrame([(1, text)], "k int, t string"), ["k"], "t").first()["fingerprint"]
    assert got & (2**64 - 1) == want


def test_near_documents_are_counted(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(w if rng.random() > 0.002 * (i % 5) else "x" for w in base)) for i in range(60)] + [(80, " ".join(base)), (100, None), (101, ""), (120, "lone words of its own here"), (120, "lone words of its own here")]
    docs = spark.createDataFrame([(i, t, 3, 4) for i, t in rows], "doc_id long, text string, asks int, near int")
    got = [(r["doc_id"], int(r["fingerprint"], 16), r["near_docs"]) for r in simhash.compared(docs, asked=F.col("doc_id") % 20 == 0).collect()]
    single = dict((i, f) for i, f, _ in got)
    assert len(got) == len(rows) and any(n and n > 3 for _, _, n in got)
    for i, f, n in got:
        assert n == (None if i % 20 else sum(j != i and bin(f ^ g).count("1") <= simhash.RADIUS for j, g in single.items())), i
    assert "near_docs" not in simhash.compared(docs).columns


def test_block_tables_find_all_pairs(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(60)]
    near = [x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for x in base for _ in range(4)]
    values = sorted({x - (1 << 64) if x >> 63 else x for x in base + near})
    df = spark.createDataFrame([(x,) for x in values + values[:5]] + [(None,)], "fingerprint long")
    for radius, blocks in ((0, 6), (3, 6), (5, 6), (3, 5)):
        got = sorted(tuple(r) for r in simhash.near_pairs(df, radius=radius, blocks=blocks).collect())
        want = sorted((a, b, d) for i, a in enumerate(values) for b in values[i + 1 :] if (d := bin((a ^ b) & (2**64 - 1)).count("1")) <= radius)
        assert got == want

"""The network's forward pass and gradient against plain versions, and the held-out fold."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from depsight.llm import queries, toxicity
from tests.llm import brute

TEXTS = ["one two three four", "five six one " * 15, "seven", "one one two eight nine ten " * 8]


def network(vocabulary):
    rng = np.random.default_rng(1)
    net = toxicity.Network(vocabulary, rng.normal(0, 1, len(vocabulary)).astype(np.float32), rng.normal(0, 0.5, 1 << toxicity.CHAR_BITS).astype(np.float32))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    return net


def plain(net, x, row):
    """The logit of one window, word by word."""
    h, both = toxicity.HIDDEN, {}
    words = [i for i in row if i >= 0]
    sig = lambda v: 1 / (1 + np.exp(-v))
    for way in "fb":
        state, states = np.zeros(h), {}
        for t in range(len(words)) if way == "f" else reversed(range(len(words))):
            g, u = x[words[t]] @ net.p[f"x{way}"] + net.p[f"b{way}"], state @ net.p[f"u{way}"]
            r, z = sig(g[:h] + u[:h]), sig(g[h : 2 * h] + u[h : 2 * h])
            new = np.tanh(g[2 * h :] + r * u[2 * h :])
            state = new + z * (state - new)
            states[t] = state
        both[way] = states
    each = [np.concatenate([both["f"][t], both["b"][t]]) for t in range(len(words))]
    a = np.exp([s @ net.p["ask"] for s in each])
    return sum(w * s for w, s in zip(a / a.sum(), each, strict=True)) @ net.p["out"] + net.p["bias"][0]


def test_forward_pass_matches_a_plain_one():
    c = toxicity.Coded(pa.array(TEXTS, pa.large_string()))
    net = network(["eight", "one", "six"])
    x, rows = net.inputs(c)["x"], c.rows(*c.windows())
    assert np.allclose(net.run(x, rows)[0], [plain(net, x, r) for r in rows], atol=1e-4)


def test_gradient_matches_differences():
    c = toxicity.Coded(pa.array(TEXTS, pa.large_string()))
    net = network(["eight", "one", "six"])
    rows, target = c.rows(*c.windows()), None
    target = np.arange(len(rows)) % 2

    def loss():
        return np.logaddexp(0, np.where(target, -1, 1) * np.array([plain(net, net.inputs(c)["x"], r) for r in rows])).sum()

    got = net.inputs(c)
    logits, kept = net.run(got["x"], rows, keep=True)
    found = net.gradient(c, got, rows, kept, toxicity.sigmoid(logits) - target)
    rng = np.random.default_rng(2)
    for name, g in found.items():
        flat, grad = net.p[name].reshape(-1), np.asarray(g).reshape(-1)
        for i in rng.choice(np.flatnonzero(grad) if grad.any() else np.arange(len(grad)), 3):
            was = flat[i]
            flat[i] = was + 1e-4
            up = loss()
            flat[i] = was - 1e-4
            down = loss()
            flat[i] = was
            assert abs((up - down) / 2e-4 - grad[i]) < 2e-3 * max(1, abs(grad[i])), (name, i)


def test_held_out_fold(spark):
    d = f"{brute.DATA}/sf0.1"
    found = queries.op4_toxicity(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("toxic is not null")
    row = found.agg(*[F.avg(F.when(F.col("toxic") == k, F.col("predicted"))).alias(f"p{k}") for k in (0, 1)]).first()
    assert row["p1"] >= 0.9 and row["p0"] <= 0.04


def test_only_the_sample_is_bounded(spark):
    """Longer texts than the sample takes teach nothing, and are scored whole."""
    docs = spark.createDataFrame([(i, ("you are a scum today " if i % 2 else "have a nice day today ") * 3) for i in range(80)] + [(200, "scum " * 20_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(200, 0)], "doc_id long, toxic int")
    net = toxicity.train(docs, labels)
    assert toxicity.score(docs.where("doc_id = 200"), net).first()["score"] > 0.5
    assert toxicity.score(docs.limit(0), net).count() == 0 and toxicity.clean(docs.limit(0), net).count() == 0

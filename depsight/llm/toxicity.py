"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs, trained in numpy.

A word is its own vector beside a pool of its letter groups' vectors, weighted by attention. The network reads windows of WIDE words, each
starting STEP words after the one before, so that every word of a text of any length is read, most of them twice. Attention pools the states
of a window to its score, and a document's score is that of its highest window.

Learning: of labelled documents outside of the held-out fold, of at most SAMPLE_BYTES bytes, about SAMPLE of each class, those with the lowest hashes,
reach the driver: a bounded sample of labelled rows. A toxic document teaches by its most suspect window only, first by the log odds of its words and letter
groups, later by the network itself.

Cases: null texts and texts without words score 0. Very long texts are read whole; of windows that tie the first one counts. Repeated rows score alike, one
output row for each input row. With no labels of one of the classes all scores are 0 and all documents are clean. Empty tables give empty tables. Extra
columns are not looked at by score() and go along in clean(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depsight.llm.shared import doc_of, held_out, mixed, over_steps, put, steps, text_of, words_of

#: Labelled documents of each class that reach the driver, about, and the bytes of the longest.
SAMPLE, SAMPLE_BYTES = 1200, 40_000
WIDE, STEP = 32, 16
HIDDEN, WORD_DIM, CHAR_DIM, CHAR_BITS, GROUP = 8, 8, 8, 15, 4
#: Words and letter groups in fewer sampled documents than this have no vector of their own.
LEAST_DOCS = 4
EPOCHS, BATCH, RATE, LEAST_UPDATES = 4, 64, 0.01, 240
THRESHOLD = 0.3
TRIMMED = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~«»“”„’‘…–—¿¡"
#: Windows that go through the network at once.
AT_ONCE = 4_096


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Coded:
    """The distinct words of some texts with their letter groups, and each text as a row of their numbers."""

    def __init__(self, texts: pa.Array):
        flat, self.offsets = words_of(pc.utf8_lower(texts))
        coded = flat.dictionary_encode()
        self.code = np.asarray(coded.indices).astype(np.int64)
        self.words = pc.utf8_trim(coded.dictionary, characters=TRIMMED)
        marked = pc.binary_join_element_wise(pa.scalar("^", pa.large_string()), self.words, pa.scalar("$$", pa.large_string()), pa.scalar("", pa.large_string()))
        n = len(marked)
        bounds = np.frombuffer(marked.buffers()[1], np.int64)[marked.offset : marked.offset + n + 1] if n else np.zeros(1, np.int64)
        data = np.frombuffer(marked.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]].astype(np.uint64)
        bounds = bounds - bounds[0]
        sizes = np.maximum(np.diff(bounds) - GROUP + 1, 1)
        self.begin = np.concatenate([[0], np.cumsum(sizes)])
        self.own = np.repeat(np.arange(n), sizes)
        at = bounds[:-1][self.own] + np.arange(len(self.own)) - self.begin[:-1][self.own]
        padded = np.concatenate([data, np.zeros(GROUP, np.uint64)])
        key = sum((padded[at + k] << np.uint64(8 * k) for k in range(GROUP)), np.zeros(len(at), np.uint64))
        self.groups = (mixed(key) >> np.uint64(64 - CHAR_BITS)).astype(np.int64)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """The first word of each window and its text; texts without words have none."""
        n = np.diff(self.offsets)
        count = np.where(n > 0, np.maximum(-(-(n - WIDE) // STEP), 0) + 1, 0)
        text = np.repeat(np.arange(len(n)), count)
        no = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        return self.offsets[:-1][text] + np.minimum(no * STEP, np.maximum(n[text] - WIDE, 0)), text

    def some(self, rows: np.ndarray) -> tuple[Coded, np.ndarray]:
        """Only the distinct words of these windows, and the windows over them."""
        used, at = np.unique(rows[rows >= 0], return_inverse=True)
        part = Coded.__new__(Coded)
        part.words = self.words.take(pa.array(used))
        size = np.diff(self.begin)[used]
        part.begin = np.concatenate([[0], np.cumsum(size)])
        part.own = np.repeat(np.arange(len(used)), size)
        part.groups = self.groups[np.repeat(self.begin[:-1][used] - part.begin[:-1], size) + np.arange(part.begin[-1])]
        mine = np.full(rows.shape, -1)
        mine[rows >= 0] = at
        return part, mine

    def rows(self, start: np.ndarray, text: np.ndarray) -> np.ndarray:
        """The words of each window, -1 beyond the text's end."""
        at = start[:, None] + np.arange(WIDE)
        return np.where(at < self.offsets[1:][text][:, None], self.code[np.minimum(at, len(self.code) - 1)], -1)


class Network:
    def __init__(self, vocabulary: list[str], word_odds: np.ndarray, group_odds: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.vocabulary = pa.array(vocabulary, pa.large_string())
        draw = lambda *shape, scale=0.3: rng.normal(0, scale, shape).astype(np.float32)
        d = WORD_DIM + CHAR_DIM
        self.p = {"words": draw(len(vocabulary) + 1, WORD_DIM, scale=0.05), "groups": draw(1 << CHAR_BITS, CHAR_DIM, scale=0.05), "pick": draw(CHAR_DIM, scale=0.1)}
        self.p["words"][:-1, 0], self.p["groups"][:, 0] = word_odds, group_odds
        self.p["pick"][0] = 3.0
        for way in "fb":
            self.p |= {f"x{way}": draw(d, 3 * HIDDEN), f"b{way}": np.zeros(3 * HIDDEN, np.float32), f"u{way}": draw(HIDDEN, 3 * HIDDEN)}
        self.p |= {"ask": draw(2 * HIDDEN), "out": draw(2 * HIDDEN, scale=0.5), "bias": np.zeros(1, np.float32)}
        self.slope, self.shift = 1.0, 0.0

    def inputs(self, c: Coded) -> dict:
        """The vector of each distinct word."""
        number = np.asarray(pc.fill_null(pc.index_in(c.words, self.vocabulary), len(self.vocabulary))).astype(np.int64)
        e = self.p["groups"][c.groups]
        a = e @ self.p["pick"]
        if len(a):
            a = np.exp(a - np.maximum.reduceat(a, c.begin[:-1])[c.own])
            a /= np.add.reduceat(a, c.begin[:-1])[c.own]
            pool = np.add.reduceat(a[:, None] * e, c.begin[:-1])
        else:
            pool = np.zeros((0, CHAR_DIM), np.float32)
        return {"number": number, "e": e, "a": a, "x": np.concatenate([self.p["words"][number], pool], 1)}

    def run(self, x: np.ndarray, rows: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """The logit of each window; with keep also what its gradient needs."""
        n, mask = len(rows), rows >= 0
        states, trace = np.empty((WIDE, n, 2 * HIDDEN), np.float32), {}
        for k, way in enumerate("fb"):
            gates = np.concatenate([x @ self.p[f"x{way}"] + self.p[f"b{way}"], np.zeros((1, 3 * HIDDEN), np.float32)])
            h, u, steps = np.zeros((n, HIDDEN), np.float32), self.p[f"u{way}"], []
            for t in range(WIDE) if way == "f" else range(WIDE - 1, -1, -1):
                g, uh, m = gates[rows[:, t]], h @ u, mask[:, t, None]
                rz = sigmoid(g[:, : 2 * HIDDEN] + uh[:, : 2 * HIDDEN])
                r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
                new = np.tanh(g[:, 2 * HIDDEN :] + r * uh[:, 2 * HIDDEN :])
                after = np.where(m, new + z * (h - new), h)
                if keep:
                    steps.append((t, h, r, z, new, uh[:, 2 * HIDDEN :]))
                h = after
                states[t, :, k * HIDDEN : (k + 1) * HIDDEN] = h
            trace[way] = steps
        e = np.where(mask.T, states @ self.p["ask"], -30)
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        pooled = (a[:, :, None] * states).sum(0)
        return pooled @ self.p["out"] + self.p["bias"][0], {"states": states, "a": a, "pooled": pooled, "trace": trace, "mask": mask}

    def gradient(self, c: Coded, got: dict, rows: np.ndarray, kept: dict, d: np.ndarray) -> dict:
        """The gradient of all parameters, d being that of the logits."""
        p, g = self.p, {}
        states, a, x = kept["states"], kept["a"], got["x"]
        g["bias"], g["out"] = d.sum(keepdims=True), kept["pooled"].T @ d
        dp = d[:, None] * p["out"]
        da = (states * dp).sum(2)
        de = a * (da - (a * da).sum(0))
        g["ask"] = np.einsum("tn,tnh->h", de, states)
        ds = a[:, :, None] * dp + de[:, :, None] * p["ask"]
        dx = np.zeros_like(x)
        for k, way in enumerate("fb"):
            u, gu, dh = p[f"u{way}"], np.zeros_like(p[f"u{way}"]), np.zeros((len(rows), HIDDEN), np.float32)
            dg = np.zeros((len(x) + 1, 3 * HIDDEN), np.float32)
            for t, h, r, z, new, un in reversed(kept["trace"][way]):
                m = kept["mask"][:, t, None]
                dh = dh + ds[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                dn = dh * (1 - z) * (1 - new * new) * m
                dz = dh * (h - new) * z * (1 - z) * m
                dr = dn * un * r * (1 - r)
                du = np.concatenate([dr, dz, dn * r], 1)
                gu += h.T @ du
                np.add.at(dg, rows[:, t], np.concatenate([dr, dz, dn], 1))
                dh = np.where(m, dh * z, dh) + du @ u.T
            dg = dg[:-1]
            g[f"u{way}"], g[f"x{way}"], g[f"b{way}"] = gu, x.T @ dg, dg.sum(0)
            dx += dg @ p[f"x{way}"].T
        g["words"] = np.zeros_like(p["words"])
        np.add.at(g["words"], got["number"], dx[:, :WORD_DIM])
        dpool, e, w = dx[:, WORD_DIM:][c.own], got["e"], got["a"]
        dw = (dpool * e).sum(1)
        ds = w * (dw - np.add.reduceat(w * dw, c.begin[:-1])[c.own])
        g["pick"], g["groups"] = e.T @ ds, np.zeros_like(p["groups"])
        np.add.at(g["groups"], c.groups, w[:, None] * dpool + ds[:, None] * p["pick"])
        return g

    def best(self, c: Coded) -> tuple[np.ndarray, np.ndarray]:
        """The highest logit of each text's windows (-inf without words) and that window's first word."""
        n = len(c.offsets) - 1
        top, where = np.full(n, -np.inf, np.float32), np.zeros(n, np.int64)
        if not len(c.code):
            return top, where
        start, text = c.windows()
        x = self.inputs(c)["x"]
        logits = np.concatenate([self.run(x, c.rows(start[i : i + AT_ONCE], text[i : i + AT_ONCE]))[0] for i in range(0, len(start), AT_ONCE)])
        order = np.lexsort((start, -logits, text))
        first = order[np.unique(text[order], return_index=True)[1]]
        top[text[first]], where[text[first]] = logits[first], start[first]
        return top, where

    def scores(self, texts: pa.Array) -> np.ndarray:
        """A probability for each text."""
        top, _ = self.best(Coded(texts))
        return np.where(np.isfinite(top), sigmoid(self.slope * top.astype(np.float64) + self.shift), 0.0)


def odds(parts: Iterator[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, size: int) -> np.ndarray:
    """For each item the log odds of toxic documents among those with it, towards 0 for rare ones; half of it, within 2.

    The parts hold items and their documents, no document in two parts.
    """
    p, n = np.zeros(size), np.zeros(size)
    for item, doc in parts:
        pairs = np.unique(item * len(toxic) + doc)
        item, bad = pairs // len(toxic), toxic[pairs % len(toxic)]
        p += np.bincount(item, bad, size)
        n += np.bincount(item, ~bad, size)
    share = max(toxic.mean(), 1e-3)
    lo = np.log((p + 2 * share) / (n + 2 * (1 - share))) - np.log(share / (1 - share))
    return np.where(p + n >= LEAST_DOCS, np.clip(lo, -4, 4) / 2, 0).astype(np.float32)


def groups_of(c: Coded, word: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Letter groups and their documents, some documents at a time; doc ascends."""
    cuts = np.unique(np.searchsorted(doc, doc[:: 1 << 14])).tolist() if len(doc) else []
    for a, b in zip(cuts, [*cuts[1:], len(doc)], strict=True):
        size = np.diff(c.begin)[word[a:b]]
        at = np.repeat(c.begin[:-1][word[a:b]] - np.cumsum(size) + size, size) + np.arange(size.sum())
        yield c.groups[at], np.repeat(doc[a:b], size)


def fit(texts: list[str], toxic: np.ndarray, weights: np.ndarray, seed: int = 7) -> Network | None:
    """Trains on whole texts; weights give the documents that each sampled one stands for."""
    if not toxic.any() or toxic.all():
        return None
    c, n_texts = Coded(pa.array(texts, pa.large_string())), len(texts)
    del texts
    rng, doc = np.random.default_rng(seed), doc_of(c.offsets)
    pairs = np.unique(doc * max(1, len(c.words)) + c.code)
    in_doc, word = pairs // max(1, len(c.words)), pairs % max(1, len(c.words))
    word_odds = odds(iter([(word, in_doc)]), toxic, len(c.words))
    in_docs = np.bincount(word, minlength=len(c.words))
    often = np.flatnonzero(in_docs >= LEAST_DOCS)  # no more than the sample's words over LEAST_DOCS
    names, first = np.unique(np.array(c.words.take(pa.array(often)).to_pylist(), object).astype(str) if len(often) else np.array([], str), return_index=True)
    group_odds = odds(groups_of(c, word, in_doc), toxic, 1 << CHAR_BITS)
    net = Network(names.tolist(), word_odds[often][first] if len(often) else np.empty(0, np.float32), group_odds, seed)

    start, text = c.windows()
    strong = np.maximum(word_odds, np.maximum.reduceat(group_odds[c.groups], c.begin[:-1]))
    rows = c.rows(start, text)
    suspect = np.where(rows >= 0, strong[rows], -9).max(1)
    most = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    epochs = max(EPOCHS, -(-LEAST_UPDATES * BATCH // max(1, 2 * n_texts)))
    updates = 0
    for epoch in range(epochs):
        if epoch and epoch % 2 == 0:
            x = net.inputs(c)["x"]
            suspect = np.concatenate([net.run(x, rows[i : i + AT_ONCE])[0] for i in range(0, len(rows), AT_ONCE)])
        order = np.lexsort((rng.random(len(text)), -suspect, text))
        top = order[np.unique(text[order], return_index=True)[1]]
        other = np.arange(len(text))[~toxic[text]]
        chosen = np.concatenate([top, rng.choice(other, min(len(other), n_texts), replace=False)])
        rng.shuffle(chosen)
        for i in range(0, len(chosen), BATCH):
            some = chosen[i : i + BATCH]
            part, mine = c.some(rows[some])
            got = net.inputs(part)
            logits, kept = net.run(got["x"], mine, keep=True)
            d = ((sigmoid(logits) - toxic[text[some]]) / len(some)).astype(np.float32)
            updates += 1
            for k, g in net.gradient(part, got, mine, kept, d).items():
                m, v = most[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                net.p[k] -= RATE * (m / (1 - 0.9**updates)) / (np.sqrt(v / (1 - 0.99**updates)) + 1e-6) * (0.3 if k in ("words", "groups") else 1)
    top, _ = net.best(c)
    use = np.isfinite(top)
    net.slope, net.shift = calibrated(top[use].astype(np.float64), toxic[use], weights[use])
    return net


def calibrated(logits: np.ndarray, toxic: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve from the highest logit to the label, with the least weighted loss on a grid; a mild prior for 1 and 0."""
    target = np.where(toxic, 0.98, 0.01)

    def loss(slope: float, shift: float) -> float:
        p = sigmoid(slope * logits + shift)
        return float(-(weights * (target * np.log(p + 1e-12) + (1 - target) * np.log(1 - p + 1e-12))).sum()) + (slope - 1) ** 2 + 0.05 * shift**2

    return min(((a, b) for a in np.arange(0.3, 2.01, 0.1) for b in np.arange(-4, 4.1, 0.25)), key=lambda x: loss(*x))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, longest: int = SAMPLE_BYTES) -> Network | None:
    """Learns from labelled documents outside of the held-out fold."""
    known = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).alias("toxic")).where(F.col("toxic").isNotNull() & ~held_out(F.col("label_id"))).groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    hashed = F.xxhash64(F.col("label_id").cast("string")).bitwiseAND((1 << 40) - 1) / float(1 << 40)
    few = F.lit(False)
    for label, n in counts.items():
        few = few | ((F.col("toxic") == label) & (hashed < sample / n))
    chosen = known.where(few)  # about 2 * sample rows: a bound on what is broadcast
    texts = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= longest)
    found = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).orderBy("doc_id").toArrow().to_pydict()
    toxic = np.array(found["toxic"], np.int64) > 0
    each = {label: max(1.0, n / sample) for label, n in counts.items()}
    net = fit(found.pop("text"), toxic, np.array([each[x] for x in found["toxic"]]))
    pa.default_memory_pool().release_unused()
    return net


def score(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text", *kept: str) -> DataFrame:
    """doc_id, score, the kept columns."""
    chosen = docs.select(docs[id_col].alias("doc_id"), *[docs[c].alias(f"k{i}") for i, c in enumerate(kept)], docs[text_col].alias("text"))
    shipped = docs.sparkSession.sparkContext.broadcast(net)  # its size is fixed by the constants above

    def work(t: pa.Table) -> pa.RecordBatch:
        texts = text_of(t)
        scores = shipped.value.scores(texts) if shipped.value is not None else np.zeros(len(texts))
        return put(**{c: t[c].combine_chunks() for c in t.column_names[:-1]}, score=scores)

    fields = [f"{c} {chosen.schema[c].dataType.simpleString()}" for c in chosen.columns[:-1]]
    return over_steps(chosen, work, ", ".join([*fields, "score double"])).withColumnsRenamed({f"k{i}": c for i, c in enumerate(kept)})


def clean(docs: DataFrame, net: Network | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose texts score below the threshold."""
    shipped = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for t in steps(batches, text_col):
            if shipped.value is not None:
                t = t.filter(pa.array(shipped.value.scores(text_of(t, text_col)) < threshold))
            yield from t.combine_chunks().to_batches()

    return docs.mapInArrow(run, docs.schema)

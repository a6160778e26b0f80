"""Quality rules with risk-controlled thresholds.

Each rule rejects documents whose value is above a cutoff. The rules' cutoffs make one list of levels from mild to strict, and each stratum (the lang
column; null is a stratum of its own) gets the strictest level that holds for it: on labelled documents kept aside for this, levels are tested in their
order by an exact binomial test that all rules of the level together reject at most RISK of the good documents, until one test fails. A fixed sequence
needs no correction within a stratum; over the strata the allowed error is split (Bonferroni), so that with probability 1 - ERROR no stratum loses more
than RISK of its good documents. Where labels are too few for that, nothing is rejected: a stratum needs about ln(ERROR / strata) / ln(1 - RISK) good labels.

Cases: null and empty texts have no words and fail the base; very long texts are measured whole; a value that ties with a cutoff is kept. Repeated rows are
judged alike, one output row for each input row; documents with several labels count as good if one label says so. Strata without labels keep all that
pass the base. Empty tables give empty tables. Extra columns of the input are not looked at, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depsight.llm.shared import doc_of, held_out, mixed, over_steps, put, run_hashes, table, text_of, word_hashes, words_of

SYMBOLS = "#*$%&|<>"
#: Words of a window whose repetition counts.
WINDOW = 8
#: Allowed share of good documents that a stratum may lose, and the probability that this is not kept.
RISK, ERROR = 0.05, 0.05
#: The rules' cutoffs, from the mildest level to the strictest.
RULES: dict[str, tuple[float, ...]] = {
    "symbols_per_word": (8.0, 4.0, 2.0, 1.0, 0.5, 0.25, 0.1, 0.05),
    "dup_line_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
    "repeat_share": (0.29, 0.28, 0.27, 0.26, 0.25, 0.22, 0.18, 0.14),
    "mean_word_chars": (40.0, 25.0, 18.0, 15.0, 13.0, 12.0, 11.0, 10.0),
    "short_words": (-1.0, -1.3, -1.6, -1.9, -2.1, -2.3, -2.5, -2.7),
}
LEVELS = len(RULES["short_words"])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *kept: str) -> DataFrame:
    """id, the kept columns, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines of each whole text."""
    chosen = docs.select(docs[id_col].alias("doc_id"), *[docs[c].alias(f"k{i}") for i, c in enumerate(kept)], docs[text_col].alias("text"))
    fields = [f"{c} {chosen.schema[c].dataType.simpleString()}" for c in chosen.columns[:-1]]
    is_symbol = np.zeros(256, bool)
    is_symbol[list(SYMBOLS.encode())] = True

    def work(t: pa.Table) -> pa.RecordBatch:
        texts = text_of(t)
        flat, offsets = words_of(texts)
        doc, n = doc_of(offsets), len(texts)
        chars = np.bincount(doc, np.asarray(pc.utf8_length(flat)), n).astype(np.int64) if len(flat) else np.zeros(n, np.int64)
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        seen = np.concatenate([[0], np.cumsum(is_symbol[data])])
        symbols = seen[bounds[1:] - bounds[0]] - seen[bounds[:-1] - bounds[0]]
        lines, again = [], []
        for x in texts.to_pylist():
            full = [y for y in x.split("\n") if y.strip(" \t\n\v\f\r")]
            lines.append(len(full))
            again.append(len(full) - len(set(full)) if len(full) > 1 else 0)
        repeats = np.zeros(n, np.int64)
        runs = run_hashes(word_hashes(flat), WINDOW)
        inside = np.flatnonzero(doc[: len(runs)] == doc[WINDOW - 1 :]) if len(runs) else np.empty(0, np.int64)
        if len(inside):
            key = mixed(runs[inside] ^ (doc[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            order = np.argsort(key, kind="stable")
            same = key[order][1:] == key[order][:-1]
            twice = np.zeros(len(key), bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            start = inside[twice]
            cover = np.zeros(len(doc) + 1, np.int64)
            np.add.at(cover, start, 1)
            np.add.at(cover, start + WINDOW, -1)
            repeats = np.bincount(doc, np.cumsum(cover)[:-1] > 0, n).astype(np.int64)
        numbers = {"n_words": np.diff(offsets), "word_chars": chars, "n_symbols": symbols, "n_dup_lines": again, "n_repeat_words": repeats, "n_lines": lines}
        return put(**{c: t[c].combine_chunks() for c in t.column_names[:-1]}, **{k: pa.array(v, pa.int64()) for k, v in numbers.items()})

    found = over_steps(chosen, work, ", ".join([*fields, "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"]))
    return found.withColumnsRenamed({f"k{i}": c for i, c in enumerate(kept)})


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def values() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols_per_word": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words,
        "mean_word_chars": F.col("word_chars") / words,
        "short_words": -(F.col("word_chars") / words),
    }


def at_most(k: int, n: int, p: float) -> float:
    """The probability of k or fewer of n, each with probability p: the exact test that an upper Clopper-Pearson bound inverts."""
    if k >= n:
        return 1.0
    term = n * math.log1p(-p)
    total, odds = math.exp(term), math.log(p) - math.log1p(-p)
    for i in range(1, k + 1):
        term += math.log(n - i + 1) - math.log(i) + odds
        total += math.exp(term)
    return min(total, 1.0)


def rejected_from() -> Column:
    """The mildest level at which a rule rejects a document, LEVELS where none does. A stricter level rejects what a milder one does."""
    rules = values()
    each = [F.coalesce(*[F.when(rules[r] > c, F.lit(i)) for i, c in enumerate(cs)], F.lit(LEVELS)) for r, cs in RULES.items()]
    return F.least(*each)


def strictest(counts: list[int], risk: float, error: float) -> int:
    """The last level in order whose rejections are shown to be within the risk, -1 if none is; counts: good documents by the level that first rejects them."""
    n, gone, level = sum(counts), 0, -1
    for i in range(LEVELS):
        gone += counts[i]
        if at_most(gone, n, risk) > error:
            break
        level = i
    return level


def levels(measures: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", stratum_col: str = "lang", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """stratum and level of each stratum with labels, as a table. Only counts meet: LEVELS + 1 numbers a stratum.

    Of the labelled documents those outside of the held-out fold calibrate, so that the fold can test the promise.
    """
    good = labels.groupBy(F.col(id_col).alias("good_id")).agg(F.max(label_col).alias("good")).where("good = 1")
    known = measures.where(~held_out(F.col(id_col)) & ~base_failed()).join(good, F.col(id_col) == F.col("good_id"))
    at = rejected_from()
    counts = known.groupBy(F.col(stratum_col).alias("stratum")).agg(*[F.count(F.when(at == i, 1)).alias(f"n{i}") for i in range(LEVELS + 1)])
    counts = table(counts, "counts")
    strata = max(1, counts.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*[b.column(f"n{i}").to_pylist() for i in range(LEVELS + 1)], strict=True)
            yield put(stratum=b.column("stratum"), level=pa.array([strictest(list(x), risk, error / strata) for x in rows], pa.int32()))

    return table(counts.mapInArrow(run, f"stratum {counts.schema['stratum'].dataType.simpleString()}, level int"), "levels")


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The measures of each document, base_failed and kept."""
    measures = table(measured(docs, id_col, text_col, stratum_col).withColumnRenamed(stratum_col, "stratum"), "measures")
    chosen = levels(measures, labels.withColumnRenamed(id_col, "doc_id"), stratum_col="stratum").withColumnRenamed("stratum", "own")
    found = measures.join(chosen, F.col("stratum").eqNullSafe(F.col("own")), "left").withColumn("base_failed", base_failed())
    return found.withColumn("kept", ~F.col("base_failed") & (rejected_from() > F.coalesce("level", F.lit(-1)))).drop("own")

"""Language identification of mixed-language text.

The script ranges of a word's letters narrow the languages that it can belong to; each of these scores the word by its letter triples, whose
frequencies were learnt for each language; Viterbi's algorithm then labels all words of a text, a change of language costing a penalty. The
language with most letters is the text's.

Cases: texts that are null or empty or have no letter (of Unicode's category L; a combining mark is none) are `und` with score 0. Very long texts are
labelled whole. Repeated rows are labelled alike, one output row for each input row. Ties go to the language that comes first. Without rows to learn from
every text is `und`. An empty table gives an empty table. Extra columns of the input are not looked at, whatever their names.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depsight.llm.shared import held_out, mixed, over_steps, put, text_of, words_of

#: Documents of a language to learn from, about, and the bytes of the longest such document: together the bound of what reaches the driver.
SAMPLE, SAMPLE_BYTES = 500, 40_000
BITS = 15
SWITCH = 8.0
#: Cost of a language whose training text (nearly) lacks the word's script, and the share from which a language has a script.
FOREIGN, LEAST_SHARE = 60.0, 0.001
UNKNOWN = "und"
#: First code points of script ranges in Unicode's order, and the script that holds from each.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"),
    (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "other"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"),
    (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"),
    (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0x20000, "han"),
)
STARTS = np.array([x for x, _ in SCRIPTS])
NAMES = sorted({x for _, x in SCRIPTS})
KINDS = np.array([NAMES.index(x) for _, x in SCRIPTS])


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point 2 if it is a letter, 1 if a mark on one, else 0."""
    return np.fromiter(({"L": 2, "M": 1}.get(unicodedata.category(chr(x))[0], 0) for x in range(0x110000)), np.uint8, 0x110000)


class Words:
    """Of distinct words: letters, script, and the hashed triples of letters and marks with the word of each."""

    def __init__(self, words: pa.Array):
        lowered = pc.utf8_lower(words)
        sizes = np.asarray(pc.utf8_length(lowered)).astype(np.int64)
        points = np.frombuffer("".join(lowered.to_pylist()).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        own = np.repeat(np.arange(len(sizes)), sizes)
        kind, n = letters()[points], len(sizes)
        self.letters = np.bincount(own[kind == 2], minlength=n)
        points, own = points[kind > 0], own[kind > 0]
        script = KINDS[np.searchsorted(STARTS, points, "right") - 1]
        self.scripts = np.bincount(own * len(NAMES) + script, minlength=n * len(NAMES)).reshape(n, len(NAMES))
        before, after = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
        if len(points):
            same = own[1:] == own[:-1]
            before[1:][same], after[:-1][same] = points[:-1][same], points[1:][same]
        key = (before << 42 | points << 21 | after).astype(np.uint64)
        self.own, self.triples = own, (mixed(key) >> np.uint64(64 - BITS)).astype(np.int64)


class Model:
    def __init__(self, languages: list[str], logs: np.ndarray, has: np.ndarray):
        self.languages, self.logs, self.has = languages, logs, has

    def scores(self, words: Words) -> np.ndarray:
        """For each word and language the sum of its triples' logarithms, with the script's languages first."""
        n, k = len(words.letters), len(self.languages)
        out = np.stack([np.bincount(words.own, self.logs[words.triples, j], n).astype(float) for j in range(k)], 1) if n else np.zeros((0, k))
        script = words.scripts.argmax(1)
        can = self.has[:, script].T  # word by language
        can |= ~can.any(1)[:, None]
        out -= np.where(can, 0.0, FOREIGN)
        out[words.letters == 0] = 0
        return out.astype(np.float32)


def fit(texts: list[str], langs: list[str]) -> Model:
    languages = sorted(set(langs))
    counts, scripts = np.ones((1 << BITS, len(languages))), np.zeros((len(languages), len(NAMES)))
    for j, lang in enumerate(languages):
        flat, _ = words_of(pa.array([x for x, y in zip(texts, langs, strict=True) if y == lang], pa.large_string()))
        coded = flat.dictionary_encode()
        words, often = Words(coded.dictionary), np.bincount(np.asarray(coded.indices), minlength=len(coded.dictionary))
        counts[:, j] += np.bincount(words.triples, often[words.own], 1 << BITS)
        scripts[j] = (words.scripts * often[:, None]).sum(0)
    return Model(languages, np.log(counts / counts.sum(0)), scripts >= LEAST_SHARE * np.maximum(scripts.sum(1, keepdims=True), 1))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, longest: int = SAMPLE_BYTES) -> Model:
    """Learns from about sample documents of each language outside of the held-out fold, of at most longest bytes, those with the lowest hashes of their ids."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang")).where(F.col("lang").isNotNull() & (F.octet_length("text") <= longest) & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    hashed = (F.xxhash64(F.col("doc_id").cast("string")).bitwiseAND((1 << 40) - 1)) / float(1 << 40)
    few = F.lit(False)
    for lang, n in counts.items():
        few = few | ((F.col("lang") == lang) & (hashed < sample / n))
    found = rows.where(few).select("text", "lang").toArrow().to_pydict()
    return fit(found["text"], found["lang"])


def viterbi(scores: np.ndarray, offsets: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The label of each word. All texts go on side by side, longest first: step t takes word t of every text that has one."""
    sizes, k = np.diff(offsets), scores.shape[1]
    order = np.argsort(-sizes, kind="stable")
    rank = np.empty(len(sizes), np.int64)
    rank[order] = np.arange(len(sizes))
    n, longest = len(scores), int(sizes.max(initial=0))
    live = len(sizes) - np.searchsorted(np.sort(sizes), np.arange(longest), "right")  # texts with a word t
    begin = np.concatenate([[0], np.cumsum(live)])
    doc = np.repeat(np.arange(len(sizes)), sizes)
    place = begin[np.arange(n) - offsets[:-1][doc]] + rank[doc]
    packed = np.empty_like(scores)
    packed[place] = scores
    small = np.min_scalar_type(max(k - 1, 0))  # as few bytes as the number of languages needs
    back = np.empty((n, k), small)
    own, finals = np.arange(k, dtype=small), np.zeros((len(sizes), k), np.float32)
    total = np.zeros((int(live[0]) if longest else 0, k), np.float32)
    for t in range(longest):
        a, b = begin[t], begin[t + 1]
        if b - a < len(total):
            finals[b - a : len(total)] = total[b - a :]
            total = total[: b - a]
        top = total.argmax(1)
        most = np.take_along_axis(total, top[:, None], 1)
        total = total - most
        stay = total >= -switch
        back[a:b] = np.where(stay, own, top[:, None])
        total = np.maximum(total, -switch) + packed[a:b]
    finals[: len(total)] = total
    labels = np.empty(n, small)
    state = finals.argmax(1).astype(small)
    for t in range(longest - 1, -1, -1):
        a, b = begin[t], begin[t + 1]
        labels[a:b] = state[: b - a]
        state[: b - a] = np.take_along_axis(back[a:b], state[: b - a, None].astype(np.int64), 1)[:, 0]
    return labels[place]


def labelled(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The label and the letters of each word, and the texts' places."""
    flat, offsets = words_of(texts)
    coded = flat.dictionary_encode()
    words, code = Words(coded.dictionary), np.asarray(coded.indices)
    return viterbi(model.scores(words)[code], offsets), words.letters[code], offsets


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (the share of the text's letters in words of that language)."""
    chosen = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS numbers a language

    def work(t: pa.Table) -> pa.RecordBatch:
        own, texts = shipped.value, text_of(t)
        k = len(own.languages)
        sums = np.zeros((len(texts), max(k, 1)))
        if k:
            labels, weight, offsets = labelled(own, texts)
            doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
            sums = np.bincount(doc * k + labels.astype(np.int64), weight, len(texts) * k).reshape(len(texts), k)
        total, top = sums.sum(1), sums.argmax(1)
        names = [own.languages[j] if s else UNKNOWN for j, s in zip(top, total, strict=True)]
        return put(doc_id=t["doc_id"].combine_chunks(), lang_pred=pa.array(names, pa.string()), score=sums.max(1) / np.maximum(total, 1))

    return over_steps(chosen, work, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, first_word, n_words, lang for each run of words in one language."""
    chosen = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def work(t: pa.Table) -> pa.RecordBatch | None:
        own = shipped.value
        if not own.languages:
            return None
        labels, _, offsets = labelled(own, text_of(t))
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        new = np.ones(len(labels), bool)
        new[1:] = (labels[1:] != labels[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        return put(doc_id=t["doc_id"].combine_chunks().take(pa.array(doc[at])), first_word=at - offsets[:-1][doc[at]], n_words=np.diff([*at, len(labels)]), lang=pa.array([own.languages[j] for j in labels[at]], pa.string()))

    return over_steps(chosen, work, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, first_word long, n_words long, lang string")

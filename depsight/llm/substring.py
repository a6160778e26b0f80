"""Substring dedup by relative Lempel-Ziv parsing over content-defined reference blocks.

A word is covered if a window of SIZE words that covers it also starts anywhere else. All documents are the reference. It is cut into blocks by its
content: an anchor is the run of GRAM words with the least hash in some window, so equal windows have equal anchors at equal places, and the windows
with the same anchor are one block: all its words from its first window's beginning to its last one's end. Anchors of more than one place index the blocks,
and an index entry knows two places of its block in the reference, the first and the last.

Each document is then factored from left to right against the indexed blocks. A factor follows one place of the reference from block to block for as long as
the reference goes on like the document; of the places at which it can begin the one with the longest match is taken, and the next factor begins where it
ends. Factors of SIZE words and more are duplicate spans as a whole. Where factors meet or end inside a block, blocks of one anchor differ: there windows are
compared one by one, and a factor's span grows by those that are found elsewhere. So a passage of any length costs a row for each block, a crowd of copies
costs one block, and the result is exact. Windows and blocks are compared among those of one anchor only: two 64-bit hashes agree, not one.

Cases: null and empty texts have no words; texts of fewer words than SIZE keep all. Very long texts are factored whole. Repeated rows are places of their own;
of anchors that tie the first one counts, and of matches that tie the first place. Rows are told apart by id and text, so ids may repeat or be null. Empty
tables give empty tables. Extra columns of the input are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depsight.llm.shared import doc_of, drop, mixed, over_steps, put, run_hashes, table, text_of, word_hashes, words_of

SIZE, GRAM = 35, 8
KEYS = ["doc_id", "hash"]


class Parsed:
    """The words of a step's texts, their windows, and the anchor of each window."""

    def __init__(self, texts: pa.Array, size: int, gram: int):
        self.flat, self.offsets = words_of(texts)
        self.words = word_hashes(self.flat)
        doc = doc_of(self.offsets)
        n = max(0, len(doc) - size + 1)
        self.start = np.flatnonzero(doc[:n] == doc[size - 1 :]) if n else np.empty(0, np.int64)  # windows inside one text
        self.doc = doc[self.start]
        if len(self.start):
            grams = mixed(run_hashes(self.words, gram))
            self.at = least_place(grams, size - gram + 1)[self.start]
            self.anchor = grams[self.at]
        else:
            self.at, self.anchor = np.empty(0, np.int64), np.empty(0, np.uint64)


def least_place(h: np.ndarray, wide: int) -> np.ndarray:
    """For each run of wide entries the place of its least one, the first of equals, by doubling."""
    place, have = np.arange(len(h)), 1
    while have < wide:
        step = min(have, wide - have)
        a, b = place[: len(place) - step], place[step:]
        place = np.where(h[b] < h[a], b, a)
        have += step
    return place


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(docs[id_col].alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text"))


def anchors(base: DataFrame, size: int, gram: int) -> DataFrame:
    """doc_id, hash, anchor, places (2 if more) for each distinct anchor of each document."""

    def work(t: pa.Table) -> pa.RecordBatch:
        p = Parsed(text_of(t), size, gram)
        first = np.ones(len(p.at), bool)
        first[1:] = (p.at[1:] != p.at[:-1]) | (p.doc[1:] != p.doc[:-1])
        doc, anchor = p.doc[first], p.anchor[first]
        order = np.lexsort((anchor, doc))
        doc, anchor = doc[order], anchor[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])
        at = np.flatnonzero(new)
        places = np.minimum(np.diff(np.append(at, len(doc))), 2)
        ids = pa.array(doc[at])
        return put(doc_id=t["doc_id"].combine_chunks().take(ids), hash=t["hash"].combine_chunks().take(ids), anchor=anchor[at].view(np.int64), places=pa.array(places, pa.int32()))

    kind = base.schema["doc_id"].dataType.simpleString()
    return over_steps(base, work, f"doc_id {kind}, hash long, anchor long, places int")


def blocks(marked: DataFrame, size: int, gram: int) -> DataFrame:
    """The factors of documents at shared anchors (column anchors): doc_id, hash, anchor, block, starts (first words), windows (hashes)."""

    def work(t: pa.Table) -> pa.RecordBatch | None:
        p = Parsed(text_of(t), size, gram)
        lists = t["anchors"].combine_chunks()
        counts = np.diff(np.asarray(lists.offsets))
        own = np.repeat(np.arange(len(counts)), counts).astype(np.uint64)
        salt = np.uint64(0x9E3779B97F4A7C15)
        asked = mixed(np.asarray(lists.flatten()).view(np.uint64) ^ mixed(own * salt + np.uint64(1)))
        shared = np.isin(mixed(p.anchor ^ mixed(p.doc.astype(np.uint64) * salt + np.uint64(1))), asked)
        if not shared.any():
            return None
        start, doc, at, anchor = p.start[shared], p.doc[shared], p.at[shared], p.anchor[shared]
        hashes = run_hashes(p.words, size)[start]
        new = np.ones(len(start), bool)
        new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
        begin = np.flatnonzero(new)
        n = np.diff(np.append(begin, len(start)))
        # a block is its windows in a row and where the anchor stands in it
        rank = (np.arange(len(start)) - np.repeat(begin, n)).astype(np.uint64)
        block = np.add.reduceat(mixed(hashes + mixed(rank + np.uint64(7))), begin) ^ mixed((at - start)[begin].astype(np.uint64) * np.uint64(64) + n.astype(np.uint64))
        # equal blocks of one document are one row
        order = np.lexsort((begin, block, doc[begin]))
        d, b = doc[begin][order], block[order]
        first = np.ones(len(order), bool)
        first[1:] = (d[1:] != d[:-1]) | (b[1:] != b[:-1])
        cut = np.append(np.flatnonzero(first), len(order))
        one = order[cut[:-1]]
        ids, m = pa.array(doc[begin][one]), n[one]
        ends = np.concatenate([[0], np.cumsum(m)])
        inner = np.repeat(begin[one] - ends[:-1], m) + np.arange(ends[-1])
        places = (start - p.offsets[:-1][doc])[begin][order]
        return put(
            doc_id=t["doc_id"].combine_chunks().take(ids), hash=t["hash"].combine_chunks().take(ids), anchor=anchor[begin][one].view(np.int64), block=block[one].view(np.int64),
            starts=pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(places, pa.int32())), windows=pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hashes[inner].view(np.int64))),
        )

    kind = marked.schema["doc_id"].dataType.simpleString()
    return over_steps(marked, work, f"doc_id {kind}, hash long, anchor long, block long, starts array<int>, windows array<long>")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """The documents with their keys, and for each key its blocks with duplicate windows, in order: runs (start, nos: its windows found elsewhere one by one, or n windows that are all found, and two places in the reference)."""
    base = keyed(docs, id_col, text_col)
    found = table(anchors(base, size, gram), "anchors")
    shared = found.groupBy("anchor").agg(F.sum("places").alias("n")).where("n > 1").select("anchor")
    marks = found.join(shared, "anchor").groupBy(*KEYS).agg(F.collect_set("anchor").alias("anchors"))  # no more than a document's own anchors
    marks = marks.select(F.col("doc_id").alias("mark_id"), F.col("hash").alias("mark_hash"), "anchors")
    same = F.col("doc_id").eqNullSafe(F.col("mark_id")) & (F.col("hash") == F.col("mark_hash"))
    factors = table(blocks(base.join(marks, same).select(*KEYS, "text", "anchors"), size, gram), "factors")
    drop(found)

    # one row for each distinct block, with the number of its places, the first and the last
    place = lambda of: F.struct(F.col("doc_id").alias("id"), "hash", of.alias("start"))
    ends = [F.min(place(F.array_min("starts"))).alias("first_place"), F.max(place(F.array_max("starts"))).alias("last_place")]
    distinct = table(factors.groupBy("anchor", "block").agg(F.sum(F.size("starts")).alias("places"), *ends, F.first("windows").alias("windows")), "blocks")
    own = table(factors.select(*KEYS, "anchor", "block", "starts"), "places")
    drop(factors)
    kinds = distinct.groupBy("anchor").agg(F.count("*").alias("kinds"), F.count(F.when(F.col("places") == 1, 1)).alias("ones"))
    single = table(kinds.where("kinds > 1 AND ones > 0").select("anchor"), "single")
    # where a block stands alone among others of its anchor, its windows are compared with theirs
    compared = distinct.join(single, "anchor", "left_semi").select("anchor", "block", "places", F.posexplode("windows").alias("no", "window"))
    # both as one key: by two, the rows would stay where the join on the anchor has put them, all of a hot anchor's in one task
    repeated = compared.groupBy(F.struct("anchor", "window").alias("key")).agg(F.sum("places").alias("n")).where("n > 1").select("key.anchor", "key.window")
    edges = compared.where("places = 1").join(repeated, ["anchor", "window"], "left_semi").groupBy("anchor", "block").agg(F.array_sort(F.collect_list("no")).alias("nos"))
    whole = distinct.where("places > 1").select("anchor", "block", F.lit(None).cast("array<int>").alias("nos"), F.size("windows").alias("n"), "first_place", "last_place")
    none = [F.lit(None).cast(whole.schema[c].dataType).alias(c) for c in ("n", "first_place", "last_place")]
    known = own.join(whole.unionByName(edges.select("*", *none)), ["anchor", "block"])
    parts = ["start", "nos", "n", "first_place", "last_place"]
    runs = known.select(*KEYS, F.explode("starts").alias("start"), *parts[1:]).groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct(*parts))).alias("runs"))
    runs = table(runs.select(F.col("doc_id").alias("run_id"), F.col("hash").alias("run_hash"), "runs"), "runs")
    drop(distinct, own, single)
    return base, runs


def parsed(blocks: list[tuple[int, int, list[tuple]]]) -> list[tuple[int, int, tuple | None]]:
    """The factors (first window, number of windows, place) of a document's blocks in order: (start, windows, places of the reference).

    A match at a place goes on into the next block where that begins at the next window and has a place that continues it. Lengths of matches are known
    from right to left, factors are taken from left to right.
    """
    longest: list[dict[tuple, int]] = [{} for _ in blocks]
    for k in range(len(blocks) - 1, -1, -1):
        start, n, places = blocks[k]
        after = longest[k + 1] if k + 1 < len(blocks) and blocks[k + 1][0] == start + n else {}
        longest[k] = {(key, at - start): n + after.get((key, at - start), 0) for key, at in places}
    out, k = [], 0
    while k < len(blocks):
        start, n, _ = blocks[k]
        (key, shift), most = max(longest[k].items(), key=lambda x: x[1])
        end = start + most
        out.append((start, most, (key, start + shift)))
        while k < len(blocks) and blocks[k][0] < end:
            k += 1
    return out


def rows_of(inner: pa.StructArray) -> list[tuple]:
    """(start, nos, n, first place, last place) of each block, read by columns; a place is ((id, hash), start)."""

    def places(name: str) -> list[tuple]:
        p = inner.field(name)
        return [((i, h), s) for i, h, s in zip(*[p.field(c).to_pylist() for c in ("id", "hash", "start")], strict=True)]

    return list(zip(*[inner.field(c).to_pylist() for c in ("start", "nos", "n")], places("first_place"), places("last_place"), strict=True))


def factored(rows: list[tuple], own: tuple) -> tuple[list[tuple[int, int, tuple | None]], list[int]]:
    """The factors of one document (key: own), and the windows beside them that are found elsewhere one by one."""
    whole, beside = [], []
    for start, nos, n, *places in rows:
        if n is None:
            beside += [start + no for no in nos]
            continue
        others = [p for p in places if p != (own, start)]  # a match with itself is none, unless a repeated row is the other place
        whole.append((start, n, list(dict.fromkeys(others or places))))
    return parsed(whole), beside


def by_document(runs: pa.ListArray) -> tuple[list[tuple], np.ndarray]:
    """All blocks, and the place of each document's first one; null is no block."""
    counts = np.where(np.asarray(runs.is_valid()), np.diff(np.asarray(runs.offsets)), 0)
    return rows_of(runs.flatten()), np.concatenate([[0], np.cumsum(counts)])


def covered(t: pa.Table, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word of the step whether a factor or a duplicate window beside one covers it, and the number of factors of each text."""
    edge, factors = np.zeros(int(offsets[-1]) + 1, np.int64), np.zeros(len(offsets) - 1, np.int64)
    ids, hashes = t["doc_id"].to_pylist(), t["hash"].to_pylist()
    rows, cut = by_document(t["runs"].combine_chunks())
    starts, lengths = [], []
    for k in np.flatnonzero(np.diff(cut)).tolist():
        found, beside = factored(rows[cut[k] : cut[k + 1]], (ids[k], hashes[k]))
        factors[k], at = len(found), int(offsets[k])
        starts += [at + x[0] for x in found] + [at + x for x in beside]
        lengths += [x[1] - 1 + size for x in found] + [size] * len(beside)
    if starts:
        at = np.array(starts)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + np.array(lengths), -1)
    return np.cumsum(edge)[:-1] > 0, factors


def factors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """doc_id, first_word, n_words, ref_id, ref_word of each factor: the words of a document that stand in a row elsewhere, and where."""
    _, runs = spans(docs, id_col, text_col, size, gram)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blocks_, cut = by_document(b.column("runs"))
            keys = list(zip(b.column("run_id").to_pylist(), b.column("run_hash").to_pylist(), strict=True))
            found = [(key[0], start, n - 1 + size, place[0][0], place[1]) for k, key in enumerate(keys) for start, n, place in factored(blocks_[cut[k] : cut[k + 1]], key)[0]]
            if found:
                doc, first, n, ref, at = zip(*found, strict=True)
                own = b.schema.field("run_id").type
                yield put(doc_id=pa.array(doc, own), first_word=pa.array(first, pa.int64()), n_words=pa.array(n, pa.int64()), ref_id=pa.array(ref, own), ref_word=pa.array(at, pa.int64()))

    return runs.mapInArrow(run, f"doc_id {kind}, first_word long, n_words long, ref_id {kind}, ref_word long")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, gram: int = GRAM, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, n_factors for each document, with texts also kept, its words that stay."""
    base, runs = spans(docs, id_col, text_col, size, gram)
    joined = base.join(runs, F.col("doc_id").eqNullSafe(F.col("run_id")) & (F.col("hash") == F.col("run_hash")), "left").select("doc_id", "hash", "text", "runs")

    def work(t: pa.Table) -> pa.RecordBatch:
        flat, offsets = words_of(text_of(t))
        gone, n_factors = covered(t, offsets, size)
        n = np.diff(offsets)
        before = np.concatenate([[0], np.cumsum(~gone)])
        left = flat.filter(pa.array(~gone)).to_pylist()
        cuts = before[offsets]
        kept = [" ".join(left[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        out = {"doc_id": t["doc_id"].combine_chunks(), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(n - np.diff(cuts), pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in kept], pa.string()), "n_factors": pa.array(n_factors, pa.int64())}
        return put(**out, **({"kept": pa.array(kept, pa.string())} if texts else {}))

    kind = base.schema["doc_id"].dataType.simpleString()
    return over_steps(joined, work, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, n_factors long" + (", kept string" if texts else ""))

"""Byte-level BPE encoding and decoding by the tokenizers library over Arrow batches, from a file of ranks.

The library merges listed pairs, ranks name tokens only. Of each token the pair that makes it is found once, on the driver: its bytes are merged by all
smaller ranks, and the two parts that are left are its pair. In a text, a token's span that no merge has crossed has gone through just these merges when its
rank's turn comes, so the listed pair is the only one that can meet there, and merging by pairs gives what merging by ranks gives. A token that isn't left in
two parts can only be a whole match of the pattern; whole matches that are tokens are taken as they are.

Matches of the pattern are encoded once a block and those that recur are remembered; the bytes of ids give byte offsets, and places of lead bytes turn these
into character offsets. A token that holds only a part of a character covers that character, as in the library. Decoding looks up each id's bytes; where a
character is split, its bytes meet again.

Cases: null and empty texts have no ids and decode to no bytes; a null id stays null; special tokens' strings are ordinary text. Very long texts are encoded
whole, a block of matches at a time, and of one long match the library's own heap takes the leftmost of pairs that tie in rank. Repeated rows are encoded
alike, one output row for each input row. An empty table gives an empty table. Other columns of the input are not looked at, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import os
import pickle
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from depsight.llm.bpe import byte_letters
from depsight.llm.shared import put, steps

#: Matches of the pattern that a worker remembers before it starts anew, none of them longer than LONG characters: a bound of its memory.
REMEMBERED, LONG = 200_000, 64
#: Matches that are encoded at once; a longer text goes through several blocks.
BLOCK = 200_000
#: Bytes of text of a step.
STEP = 800_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks from a file with one base64 token and its rank on each line."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"ranks without the bytes {missing} can't encode every text")
    return ranks


def pair(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that a token's bytes are merged into by smaller ranks, or None if more are left."""
    own, parts = ranks[token], [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        least, at = min(((ranks.get(a + b, own), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(own, 0))
        if least >= own:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


def portable(path: str, pattern: str) -> bytes:
    """What a worker needs, in bytes: the library's tokenizer as JSON, each id's bytes, the pattern."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    ranks, letters = read_ranks(path), byte_letters()
    shown = lambda token: "".join([letters[b] for b in token])
    pairs = [(shown(p[0]), shown(p[1])) for token in sorted(ranks, key=ranks.get) if len(token) > 1 and (p := pair(token, ranks))]
    own = Tokenizer(models.BPE({shown(token): rank for token, rank in ranks.items()}, pairs, ignore_merges=True))
    own.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)  # matches are given to it one by one
    return pickle.dumps((own.to_str(), {rank: token for token, rank in ranks.items()}, pattern))


class ByteCodec:
    """Encoder and decoder of one worker."""

    def __init__(self, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has dealt out the cores
        from tokenizers import Tokenizer

        spec, names, pattern = pickle.loads(data)
        self.tokenizer, self.pattern = Tokenizer.from_str(spec), regex.compile(pattern)
        self.bytes_of = pa.array([names.get(i) for i in range(max(names) + 1)], pa.large_binary())
        self.n_bytes = np.array([len(names.get(i, b"")) for i in range(max(names) + 1)], np.int64)
        self.memory: dict[str, bytes] = {}

    def matches(self, texts: list[str]) -> Iterator[tuple[list[str], dict[int, int]]]:
        """The pattern's matches in all texts one after another, in blocks, each with the number of its matches by text."""
        flat, count = [], {}
        for k, text in enumerate(texts):
            if len(text) <= STEP:
                found = self.pattern.findall(text)
                flat += found
                count[k] = len(found)
            else:
                each = self.pattern.finditer(text)
                while found := [m[0] for m in islice(each, BLOCK)]:
                    yield flat + found, count | {k: len(found)}
                    flat, count = [], {}
            if len(flat) >= BLOCK:
                yield flat, count
                flat, count = [], {}
        if flat:
            yield flat, count

    def learn(self, words: list[str]) -> list[bytes]:
        """The ids of each word as the bytes of 32-bit integers. New words go to the library as one text that is split already."""
        memory = self.memory
        new = [w for w in words if w not in memory]
        if not new:
            return [memory[w] for w in words]
        ids = np.array(self.tokenizer.encode_batch_fast([new], is_pretokenized=True, add_special_tokens=False)[0].ids, np.int32)
        upto = np.cumsum([len(w.encode()) for w in new])  # a word's ids end where its bytes end
        data, ends = ids.tobytes(), (4 * np.searchsorted(np.cumsum(self.n_bytes[ids]), upto, side="right")).tolist()
        fresh = {w: data[a:b] for w, a, b in zip(new, [0, *ends], ends, strict=False)}
        found = [fresh[w] if w in fresh else memory[w] for w in words]
        if len(memory) + len(fresh) > REMEMBERED:
            memory.clear()
        memory.update((w, x) for w, x in fresh.items() if len(w) <= LONG)
        return found

    def ids_of(self, flat: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all matches one after another, and how many each match has."""
        coded = pa.array(flat, pa.large_string()).dictionary_encode()
        code, lists = np.asarray(coded.indices).astype(np.int64), self.learn(coded.dictionary.to_pylist())
        size, table = np.array([len(x) for x in lists], np.int64) // 4, np.frombuffer(b"".join(lists), np.int32)
        begin, sizes = np.cumsum(size) - size, size[code]
        shift = begin[code] - (np.cumsum(sizes) - sizes)
        return table[np.repeat(shift, sizes) + np.arange(sizes.sum())], sizes

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The place of each text's first id (one more entry for the end), and all ids one after another."""
        total, parts = np.zeros(len(texts) + 1, np.int64), [np.empty(0, np.int32)]
        for flat, count in self.matches(texts):
            ids, sizes = self.ids_of(flat)
            parts.append(ids)
            upto = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *count.values()])]
            total[np.array([*count]) + 1] += np.diff(upto)
        return np.cumsum(total), np.concatenate(parts)

    def bytes_all(self, ids: np.ndarray) -> tuple[np.ndarray, memoryview]:
        """The place of each id's first byte (one more entry for the end), and the bytes of all ids."""
        known = np.asarray(self.bytes_of.is_valid())
        if len(odd := ids[(ids < 0) | (ids >= len(known)) | ~known[np.clip(ids, 0, len(known) - 1)]]):
            raise ValueError(f"ids without a token: {odd[:5].tolist()}")
        found = self.bytes_of.take(pa.array(ids))
        ends = np.frombuffer(found.buffers()[1], np.int64)[: len(ids) + 1]
        return ends, memoryview(found.buffers()[2] or b"")

    def offsets(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first character of each id and the one behind its last, counted from its text's start."""
        places, data = self.bytes_all(ids)
        lead = (np.frombuffer(data, np.uint8)[: places[-1]] & 0xC0) != 0x80
        upto = np.concatenate([[0], np.cumsum(lead)])  # characters that begin before a byte
        first = upto[places[:-1] + 1] - 1
        before = np.repeat(upto[places[bounds[:-1]]], np.diff(bounds))
        return (first - before).astype(np.int32), (upto[places[1:]] - before).astype(np.int32)

    def pieces(self, ids: list[int]) -> list[str]:
        """The text of each id: a character that several ids share belongs to the last of them, bytes that are no character are replaced."""
        import codecs

        own, names = codecs.getincrementaldecoder("utf-8")("replace"), self.bytes_of.take(pa.array(ids, pa.int32())).to_pylist()
        out = [own.decode(x) for x in names]
        if out:
            out[-1] += own.decode(b"", True)
        return out


@lru_cache(maxsize=2)
def codec_of(data: bytes) -> ByteCodec:
    return ByteCodec(data)


def _encoded(docs: DataFrame, ranks: str, pattern: str, id_col: str, text_col: str, schema: str, shape) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast(portable(ranks, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec_of(shipped.value)
        for t in steps(batches, size=STEP):
            bounds, ids = own.encode_all([x or "" for x in t["text"].to_pylist()])
            yield put(doc_id=t["doc_id"].combine_chunks(), **shape(own, bounds, ids))

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, f"doc_id {kind}, {schema}")


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document its id, ids array<int>, and of each id the first character it covers and the one behind its last: starts and ends array<int>.

    ranks: a path on the driver. What is made of the file is broadcast, so that workers need no such path; its size is that of a vocabulary.
    """

    def shape(own: ByteCodec, bounds: np.ndarray, ids: np.ndarray) -> dict:
        at, (starts, ends) = pa.array(bounds, pa.int32()), own.offsets(ids, bounds)
        return {"ids": pa.ListArray.from_arrays(at, pa.array(ids)), "starts": pa.ListArray.from_arrays(at, pa.array(starts)), "ends": pa.ListArray.from_arrays(at, pa.array(ends))}

    return _encoded(docs, ranks, pattern, id_col, text_col, "ids array<int>, starts array<int>, ends array<int>", shape)


def digests(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Like encode(), then decoded again; ids and bytes leave the task only as their number and SHA-256 sums."""

    def shape(own: ByteCodec, bounds: np.ndarray, ids: np.ndarray) -> dict:
        places, data = own.bytes_all(ids)
        plain, cuts, at = memoryview(ids.astype("<u4")).cast("B"), bounds.tolist(), places[bounds].tolist()
        sums = [hashlib.sha256(plain[4 * i : 4 * j]).hexdigest() for i, j in zip(cuts, cuts[1:], strict=False)]
        decoded = [hashlib.sha256(data[i:j]).hexdigest() for i, j in zip(at, at[1:], strict=False)]
        return {"n_tokens": pa.array(np.diff(bounds)), "ids_sha256": pa.array(sums, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}

    return _encoded(docs, ranks, pattern, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", shape)


def decode(tokens: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """For each row its id, data binary (the bytes of its ids), text string (bytes that are no character replaced) and pieces array<string>.

    ids may be any part of a text's ids: characters that are split at its ends are replaced, those split between two ids are whole and belong to the later
    one in pieces. Null lists and null ids have no bytes; an id without a token is an error.
    """
    shipped = tokens.sparkSession.sparkContext.broadcast(portable(ranks, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec_of(shipped.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                lists = [[i for i in x or () if i is not None] for x in part.column("ids").to_pylist()]
                places, data = own.bytes_all(np.array([i for x in lists for i in x], np.int32))
                at = places[np.cumsum([0, *map(len, lists)])].tolist()
                whole = [bytes(data[i:j]) for i, j in zip(at, at[1:], strict=False)]
                yield put(doc_id=part.column("doc_id"), data=pa.array(whole, pa.binary()), text=pa.array([x.decode("utf-8", "replace") for x in whole], pa.string()), pieces=pa.array([own.pieces(x) for x in lists], pa.list_(pa.string())))

    kind = tokens.schema[id_col].dataType.simpleString()
    return tokens.select(tokens[id_col].alias("doc_id"), tokens[ids_col].cast("array<int>").alias("ids")).mapInArrow(run, f"doc_id {kind}, data binary, text string, pieces array<string>")

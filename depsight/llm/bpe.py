"""BPE encoding and decoding by forced-boundary splitting.

Two symbols that stand next to each other inside no vocabulary token can never come together in one: between them a cut is certain. The
words of a text are cut there, each fragment is merged by itself (and remembered, as words recur), and the pieces are put together again.

Cases: null and empty texts have no ids and decode to the empty text; a null id stays null. Very long texts are encoded whole, and very long fragments are
merged with a heap, so time doesn't grow with their square; of pairs that tie in rank the leftmost is merged first. Repeated rows are encoded alike, one
output row for each input row. An empty table gives an empty table. Other columns of the input are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from depsight.llm.shared import put, steps

#: Words that a task remembers before it starts anew: a bound of its memory. Only words that recur within a step are remembered.
REMEMBERED = 50_000
#: Bytes of text of a step: words, ids and decoded strings of a step are Python objects, many times its size.
STEP = 400_000
ID_BITS, ID_MASK, NO_PAIR = 17, (1 << 17) - 1, 1 << 62
#: Fragments of more symbols than this are merged with a heap.
LONG = 48


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from code point 256."""
    keeps = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in keeps else chr(next(spare)) for b in range(256)]


# What split() and normal() carry out, as a tokenizer file states it.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)]


def checked(spec: dict) -> dict:
    """The file's content, if words are split and normalised as here; another tokenizer's ids would be wrong without a word."""
    steps_ = [(x.get("type"), (x.get("pattern") or {}).get("Regex")) for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    if steps_ != NORMALIZERS or (first.get("pattern") or {}).get("Regex") != WORDS or first.get("invert") is not True:
        raise ValueError("this codec is for tokenizer files with NFC, lower case and its own pattern of words only")
    if not spec["model"].get("end_of_word_suffix") or spec["model"].get("ignore_merges"):
        raise ValueError("this codec is for models whose words end in a suffix and that always merge")
    return spec


class Codec:
    """Encoder and decoder for a tokenizer file with a byte-level BPE model whose words end in a suffix."""

    def __init__(self, data: bytes):
        spec = checked(json.loads(data))
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names = {i: x for x, i in (self.vocab | self.special).items()}
        pairs = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]]
        # pair of ids -> rank and new id, each packed into one number, so that the smallest value is the best pair
        self.rank = {self.vocab[a] << ID_BITS | self.vocab[b]: k << ID_BITS | self.vocab[a + b] for k, (a, b) in enumerate(pairs)}
        letters = byte_letters()
        self.letter = dict(enumerate(letters))
        place = {x: i for i, x in enumerate(letters)}
        # symbols: 0 to 255 for bytes, 256 to 511 for the last byte of a word
        self.first = [self.vocab[x] for x in letters] + [self.vocab[x + self.end] for x in letters]
        joined = np.zeros((512, 512), bool)
        for token in self.vocab:
            body = token[: -len(self.end)] if self.end and token.endswith(self.end) and token != self.end else token
            symbols = [place[x] for x in body if x in place]
            if len(symbols) != len(body):
                continue
            if body is not token and symbols:
                symbols[-1] += 256
            for a, b in zip(symbols, symbols[1:], strict=False):
                joined[a, b] = True
        self.joined = joined.astype(np.uint8).tobytes()
        self.words = regex.compile(WORDS)
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        # texts of these characters only are split by the class of their bytes: 0 space, 1 letter, 2 digit, 3 other
        self.odd = re.compile("[^\x00-\x26\x28-\x7fß-öø-ÿ]")
        self.classes = np.array([0 if x in b" \t\n\v\f\r" else 1 if x >= 128 or chr(x).isalpha() else 2 if chr(x).isdigit() else 3 for x in range(256)], np.uint8)
        self.other_spaces = regex.compile(r"[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
        self.keys = np.array(sorted(self.rank), np.int64)
        self.values = np.array([self.rank[k] for k in self.keys.tolist()], np.int64)
        self.first_ids = np.array(self.first, np.int64)
        self.apart = ~joined.reshape(-1)
        self.memory: dict[str, tuple[list[int], str]] = {}

    def cuts(self, symbols: list[int]) -> list[int]:
        """The certain cuts of a word: places whose two neighbours are neighbours in no token."""
        joined = self.joined
        return [i for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False), 1) if not joined[a << 9 | b]]

    def merge(self, symbols: list[int]) -> list[int]:
        """Ids of one fragment: the best-ranked pair, leftmost first, is merged until none is left."""
        ids = [self.first[s] for s in symbols]
        return self._merge_long(ids) if len(ids) > LONG else self._merge_short(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        rank = self.rank.get
        best = [rank(a << ID_BITS | b, NO_PAIR) for a, b in zip(ids, ids[1:], strict=False)]
        while best and (least := min(best)) != NO_PAIR:
            i = best.index(least)
            ids[i : i + 2] = [least & ID_MASK]
            del best[i]
            if i:
                best[i - 1] = rank(ids[i - 1] << ID_BITS | ids[i], NO_PAIR)
            if i < len(best):
                best[i] = rank(ids[i] << ID_BITS | ids[i + 1], NO_PAIR)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, rank = len(ids), self.rank
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank.get(ids[i] << ID_BITS | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = r & ID_MASK, -1
            after[i] = k = after[j]
            for left, right in ((before[i], i), (i, k)):
                if left >= 0 and right >= 0:
                    before[right] = left
                    if (r := rank.get(ids[left] << ID_BITS | ids[right])) is not None:
                        heapq.heappush(heap, (r, left, ids[left], ids[right]))
        return [x for x in ids if x >= 0]

    def word(self, word: str) -> list[int]:
        """Ids of one word: cut where a cut is certain, each fragment by itself."""
        symbols = list(word.encode())
        symbols[-1] += 256
        out, at = [], 0
        for cut in [*self.cuts(symbols), len(symbols)]:
            out += self.merge(symbols[at:cut])
            at = cut
        return out

    def word_lists(self, words: list[str]) -> list[list[int]]:
        """Like word() for many words at once: all fragments' merges go on side by side in arrays."""
        coded = [w.encode() for w in words]
        ends = np.cumsum([len(x) for x in coded])
        symbols = np.frombuffer(b"".join(coded), np.uint8).astype(np.int64)
        symbols[ends - 1] += 256
        cut = np.ones(len(symbols) + 1, bool)
        cut[1:-1] = self.apart[symbols[:-1] << 9 | symbols[1:]]  # a word's last symbol is next to nothing inside a token
        starts = np.flatnonzero(cut)
        sizes = np.diff(starts)
        starts = starts[:-1]
        out: list[list[int]] = [[] for _ in sizes]
        low = 0
        for high in (8, 16, LONG):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            low = high
            for k in range(0, len(rows), 50_000):
                self._merge_side_by_side(symbols, starts, sizes, rows[k : k + 50_000], out)
        for k in np.flatnonzero(sizes > LONG).tolist():
            out[k] = self._merge_long(self.first_ids[symbols[starts[k] : starts[k] + sizes[k]]].tolist())
        whole, at = [], 0
        for n in np.searchsorted(starts, ends).tolist():
            whole.append(out[at] if n == at + 1 else [x for part in out[at:n] for x in part])
            at = n
        return whole

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << ID_BITS | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (right >= 0) & (left >= 0), self.values[at], NO_PAIR)

    def _merge_side_by_side(self, symbols, starts, sizes, rows, out) -> None:
        """Merges the fragments in rows, of similar sizes; each round does one merge in each fragment that still has one."""
        if not len(rows):
            return
        n = sizes[rows]
        wide = int(n.max())
        cols = np.arange(wide)
        ids = np.where(cols < n[:, None], self.first_ids[symbols[np.minimum(starts[rows][:, None] + cols, len(symbols) - 1)]], -1)
        best = self._ranks(ids[:, :-1], ids[:, 1:]) if wide > 1 else np.full((len(rows), 1), NO_PAIR)
        live = rows
        while True:
            i = best.argmin(axis=1)
            least = best[np.arange(len(live)), i]
            over = least == NO_PAIR
            for k in np.flatnonzero(over).tolist():
                out[live[k]] = [x for x in ids[k].tolist() if x >= 0]
            if over.all():
                return
            ids, best, i, least, live = ids[~over], best[~over], i[~over], least[~over], live[~over]
            own = np.arange(len(live))
            ids[own, i] = least & ID_MASK
            ids = np.concatenate([ids, np.full((len(live), 1), -1)], 1)
            ids = np.take_along_axis(ids, cols + (cols > i[:, None]), 1)
            if wide > 1:
                best = np.concatenate([best, np.full((len(live), 1), NO_PAIR)], 1)
                best = np.take_along_axis(best, cols[:-1] + (cols[:-1] > i[:, None]), 1)
                right = np.minimum(i + 1, wide - 1)
                fresh = np.where(i + 1 < wide, self._ranks(ids[own, i], ids[own, right]), NO_PAIR)
                inside = i < best.shape[1]
                best[own[inside], i[inside]] = fresh[inside]
                left = i > 0
                best[own[left], i[left] - 1] = self._ranks(ids[own[left], i[left] - 1], ids[own[left], i[left]])

    def learn(self, words: list[str], recurs: list[bool]) -> list[tuple[list[int], str]]:
        """Ids and decoded string of each word; words that recur are remembered."""
        memory, names = self.memory, self.names
        new = [w for w in words if w not in memory]
        fresh = {w: (ids, " ".join([names[i] for i in ids])) for w, ids in zip(new, self.word_lists(new), strict=True)} if new else {}
        found = [fresh[w] if w in fresh else memory[w] for w in words]
        kept = {w: fresh[w] for w, again in zip(words, recurs, strict=True) if again and w in fresh}
        if len(memory) + len(kept) > REMEMBERED:
            memory.clear()
        memory.update(kept)
        return found

    def normal(self, text: str) -> str:
        """Composed and in lower case; white space stays outside of words, so it needs to be known as such only."""
        if text.isascii():
            return text.lower()
        return self.lower(self.other_spaces.sub(" ", unicodedata.normalize("NFC", text)))

    def split(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The words of all texts one after another, and the place of each text's first one."""
        odd = {k: self.words.findall(x) for k, x in enumerate(texts) if self.odd.search(x)}
        coded = [b"" if k in odd else x.encode() for k, x in enumerate(texts)]
        data = np.frombuffer(b"\n".join(coded), np.uint8)
        kind = self.classes[data]
        keep = kind > 0
        begins = keep.copy()
        begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        at = np.flatnonzero(begins)
        kept = data[keep]
        ends = np.concatenate([(np.cumsum(keep) - 1)[at], [len(kept)]])
        flat = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(kept))
        places = np.concatenate([[0], np.cumsum([len(x) + 1 for x in coded])])
        offsets = np.searchsorted(at, places)
        if odd:
            parts, sizes, done = [], np.diff(offsets), 0
            for k, words in odd.items():
                parts += [flat[done : offsets[k]], pa.array(words, pa.large_string())]
                done, sizes[k] = offsets[k], len(words)
            flat = pa.concat_arrays([*parts, flat[done:]])
            offsets = np.concatenate([[0], np.cumsum(sizes)])
        return flat, offsets

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """For many texts: the place of each text's first id, all ids, and each text decoded."""
        odd = {k: x for k, x in enumerate(texts) if x and "<|" in x and self.specials and self.specials.search(x)}
        flat, offsets = self.split(["" if not x or k in odd else self.normal(x) for k, x in enumerate(texts)])
        coded = flat.dictionary_encode()
        code = np.asarray(coded.indices).astype(np.int64)
        known = self.learn(coded.dictionary.to_pylist(), (np.bincount(code, minlength=len(coded.dictionary)) > 1).tolist())
        size = np.array([len(ids) for ids, _ in known], np.int64)
        table = np.array([x for ids, _ in known for x in ids], np.int64)
        begin = np.concatenate([[0], np.cumsum(size)])[:-1] if len(size) else size
        sizes = size[code] if len(code) else code
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = table[np.repeat(begin[code] - ends[:-1], sizes) + np.arange(ends[-1])] if len(code) else table
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array([x for _, x in known], pa.string()).take(pa.array(code)))
        decoded = pc.binary_join(lists, " ").to_pylist()
        bounds = ends[offsets]
        if odd:
            each = [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
            for k, x in odd.items():
                each[k] = np.array(self.encode(x), np.int64)
                decoded[k] = self.decode(each[k].tolist())
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in each])])
            ids = np.concatenate(each)
        return bounds, ids, decoded

    def _plain(self, text: str) -> list[int]:
        return [i for word in self.words.findall(self.normal(text)) for i in self.word(word)]

    @staticmethod
    def lower(text: str) -> str:
        """Lower case by code point: a final sigma is like any other, where str.lower() looks at the word."""
        return text.lower() if "Σ" not in text else "".join(map(str.lower, text))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, without tokens at its ends; a special token's own string in the text is that token."""
        if not text:
            return []
        if not self.specials or "<|" not in text:
            return self._plain(text)
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self._plain(text[at:])

    def decode(self, ids: list[int]) -> str:
        """The tokens' own strings joined by a space: the file names no decoder, so suffixes and byte letters stay."""
        names = self.names
        return " ".join([names[i] for i in ids])


@lru_cache(maxsize=2)
def codec_of(data: bytes) -> Codec:
    return Codec(data)


def codec(path: str) -> Codec:
    """The codec of a tokenizer file on this machine."""
    return codec_of(Path(path).read_bytes())


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document its id, ids array<int> and decoded string.

    tokenizer: a path on the driver. The file's bytes are broadcast, so that workers need no such path; their size is that of a vocabulary.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec_of(shipped.value)
        for t in steps(batches, size=STEP):
            bounds, ids, decoded = own.encode_all(t["text"].to_pylist())
            yield put(doc_id=t["doc_id"].combine_chunks(), ids=pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())), decoded=pa.array(decoded, pa.string()))

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Like encode(), but ids and decoded text leave the task only as their number and SHA-256 sums; with_ids keeps the ids too."""
    shipped = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec_of(shipped.value)
        for t in steps(batches, size=STEP):
            bounds, ids, decoded = own.encode_all(t["text"].to_pylist())
            ids = ids.astype("<u4")
            a = [hashlib.sha256(ids[i:j].tobytes()).hexdigest() for i, j in zip(bounds, bounds[1:], strict=False)]
            b = [hashlib.sha256(x.encode()).hexdigest() for x in decoded]
            out = {"doc_id": t["doc_id"].combine_chunks(), "n_tokens": pa.array(np.diff(bounds), pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())}
            yield put(**out, **({"ids": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))} if with_ids else {}))

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else ""))

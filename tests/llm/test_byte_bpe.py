"""Byte-level BPE against tiktoken and the library's own tokenizer file; offsets against the library's; decoding of split characters."""

import hashlib
import random

import public_tokenizers as public
import pytest
import tiktoken
from tokenizers import Tokenizer

from depsight.llm import bytebpe, queries
from tests.llm import brute
from tests.llm.test_bpe_warc import ODD

PATH = public.path("byte_bpe_50k.tiktoken")
LETTERS = "aab  '\n\t1é漢😀ſ́sreve!?-\x1c\x85　"


@pytest.fixture(scope="module")
def ranks():
    return bytebpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def plain(ranks):
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return bytebpe.ByteCodec(bytebpe.portable(PATH, public.PATTERN))


def test_documents_and_odd_texts(spark, plain):
    docs = spark.read.parquet(f"{brute.DATA}/sf0.001/documents.parquet").select("doc_id", "text")
    every = docs.unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)], docs.schema))
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bytebpe.digests(every, PATH, public.PATTERN).collect()}
    for r in every.collect():
        ids = plain.encode_ordinary(r["text"] or "")
        want = len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()
        assert got[r["doc_id"]] == want, (r["doc_id"], (r["text"] or "")[:60])
    query = queries.op13_byte_bpe(spark, f"{brute.DATA}/sf0.001")
    assert {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in query.collect()} == {(k, *v) for k, v in got.items() if k < 10_000}


def test_null_ids_clashing_columns_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b", 1), (2, None, 1), (2, "", 1), (2, "", 1)], "doc_id long, text string, ids int")
    rows = sorted((r["doc_id"] or 0, r["n_tokens"]) for r in bytebpe.digests(docs, PATH, public.PATTERN).collect())
    assert rows == [(0, 2), (2, 0), (2, 0), (2, 0)]
    encoded = bytebpe.encode(docs, PATH, public.PATTERN)
    assert sorted((r["doc_id"] or 0, r["starts"], r["ends"]) for r in encoded.collect()) == [(0, [0, 1], [1, 3]), (2, [], []), (2, [], []), (2, [], [])]
    assert sorted((r["doc_id"] or 0, r["text"], bytes(r["data"]), r["pieces"]) for r in bytebpe.decode(encoded, PATH, public.PATTERN).collect()) == [(0, "a b", b"a b", ["a", " b"]), (2, "", b"", []), (2, "", b"", []), (2, "", b"", [])]
    assert bytebpe.digests(docs.limit(0), PATH, public.PATTERN).count() == bytebpe.encode(docs.limit(0), PATH, public.PATTERN).count() == bytebpe.decode(encoded.limit(0), PATH, public.PATTERN).count() == 0


def test_random_texts_and_offsets(own, plain):
    lib, rng = Tokenizer.from_file(public.path("byte_bpe_50k.json")), random.Random(2)
    lib.encode_special_tokens = True
    texts = ["".join(rng.choices(LETTERS, k=rng.randint(0, 80))) for _ in range(2000)] + ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=300)) for _ in range(50)]
    bounds, ids = own.encode_all(texts)
    starts, ends = own.offsets(ids, bounds)
    for k, text in enumerate(texts):
        mine, part = ids[bounds[k] : bounds[k + 1]].tolist(), slice(bounds[k], bounds[k + 1])
        assert mine == plain.encode_ordinary(text), text
        assert list(zip(starts[part].tolist(), ends[part].tolist(), strict=True)) == lib.encode(text).offsets, text
        pieces = own.pieces(mine)
        assert "".join(pieces) == text and len(pieces) == len(mine)


def test_long_texts_go_through_blocks(own, plain, monkeypatch):
    monkeypatch.setattr(bytebpe, "STEP", 1000)
    monkeypatch.setattr(bytebpe, "BLOCK", 70)
    monkeypatch.setattr(bytebpe, "REMEMBERED", 50)
    rng = random.Random(4)
    texts = ["".join(rng.choices("abc de1'\n", k=n)) for n in (10, 5000, 0, 999, 1001, 20_000, 3)]
    bounds, ids = own.encode_all(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [plain.encode_ordinary(x) for x in texts]


def test_split_characters(spark, plain):
    """Any part of a text's ids decodes: its inner characters whole, cut ones replaced, as in the plain library."""
    ids = plain.encode_ordinary("漢😀é字👩‍👩‍👧")
    rows = [(k, ids[a:b]) for k, (a, b) in enumerate((a, b) for a in range(len(ids)) for b in range(a, len(ids) + 1))] + [(-1, None), (-2, [None, ids[0], None])]
    got = {r["doc_id"]: r for r in bytebpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), PATH, public.PATTERN).collect()}
    for k, part in rows:
        part = [i for i in part or () if i is not None]
        assert bytes(got[k]["data"]) == plain.decode_bytes(part) and got[k]["text"] == plain.decode(part) == "".join(got[k]["pieces"])
    with pytest.raises(Exception, match="without a token"):
        bytebpe.decode(spark.createDataFrame([(1, [50256])], "doc_id long, ids array<int>"), PATH, public.PATTERN).collect()


def test_pairs_of_ranks():
    """A small vocabulary in which a token can be made of two pairs, and one that no merge makes."""
    base = {bytes([b]): b for b in range(256)}
    ranks = base | {b"aa": 256, b"aaa": 257, b"bc": 258, b"abc": 259, b"xyz": 260}
    assert bytebpe.pair(b"aaa", ranks) == (b"aa", b"a") and bytebpe.pair(b"abc", ranks) == (b"a", b"bc") and bytebpe.pair(b"xyz", ranks) is None


def test_ranks_of_own_order(tmp_path):
    import base64

    rng = random.Random(9)
    ranks = {bytes([b]): b for b in range(256)}
    while len(ranks) < 400:  # tokens made of any two others, in any order
        token = rng.choice([*ranks][-60:] + [b"a", b"b", b"c"]) + rng.choice([*ranks][-60:] + [b"a", b"b", b"c"])
        if len(token) < 12 and not any(x > 126 for x in token):
            ranks.setdefault(token, len(ranks))
    file = tmp_path / "own.tiktoken"
    file.write_bytes(b"\n".join(base64.b64encode(t) + b" " + str(r).encode() for t, r in ranks.items()))
    own, plain = bytebpe.ByteCodec(bytebpe.portable(str(file), public.PATTERN)), tiktoken.Encoding("small", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    alphabet = sorted({chr(x) for t in [*ranks][256:] for x in t} | {"a", "b", "c"})
    texts = ["".join(rng.choices(alphabet, k=rng.randint(1, 40))) for _ in range(1500)] + [t.decode() for t in [*ranks][256:]]
    bounds, ids = own.encode_all(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [plain.encode_ordinary(x) for x in texts]
    (tmp_path / "bad").write_bytes(base64.b64encode(b"ab") + b" 0")
    with pytest.raises(ValueError, match="without the bytes"):
        bytebpe.read_ranks(str(tmp_path / "bad"))

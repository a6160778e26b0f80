"""BPE against the tokenizers library, WARC archives by round trip."""

import hashlib
import random

import pytest
from tokenizers import Tokenizer

from depsight.llm import bpe, queries, warc
from tests.llm import brute

ODD = [
    None, "", " \n\t ", "a", "don't stop, it's 12345!", "<|endoftext|> and <|startoftext|>x", "<|endoftext|", "ÀÉÎ é ΣΑΣ İstanbul ǅ ﬁ", "日本語のテキスト", "😀😀 a b c\x85d", "x" * 30_000,
    "".join(chr(97 + i % 26) for i in range(5_000)), "ß ŉ ''s 'LL 've", "\x00\x01 \x7f", "１２ ½ Ⅷ", "İı ſ K",
]


def library():
    found = Tokenizer.from_file(queries.tokenizer_path())
    found.no_truncation()
    found.no_padding()
    return found


def digest(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_documents_and_odd_texts(spark):
    docs = spark.read.parquet(f"{brute.DATA}/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)], docs.schema)
    every = docs.unionByName(odd)
    lib = library()
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(every, queries.tokenizer_path()).collect()}
    for r in every.collect():
        assert got[r["doc_id"]] == digest(lib, r["text"]), (r["doc_id"], (r["text"] or "")[:60])


def test_null_ids_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b", 1), (2, None, 1), (2, None, 1)], "doc_id long, text string, ids int")
    rows = sorted((r["doc_id"] or 0, r["n_tokens"], len(r["ids"])) for r in bpe.digests(docs, queries.tokenizer_path(), with_ids=True).collect())
    assert rows == [(0, 2, 2), (2, 0, 0), (2, 0, 0)]
    assert [r["decoded"] for r in bpe.encode(docs.where("doc_id is null"), queries.tokenizer_path()).collect()] == [bpe.codec(queries.tokenizer_path()).decode(bpe.codec(queries.tokenizer_path()).encode("a b"))]
    assert bpe.digests(docs.limit(0), queries.tokenizer_path()).count() == 0


def test_files_that_split_or_normalise_otherwise_are_errors():
    import json

    data = open(queries.tokenizer_path(), encoding="utf-8").read()
    bpe.checked(json.loads(data))
    for change in (lambda x: x["pre_tokenizer"]["pretokenizers"][0]["pattern"].update(Regex="x"), lambda x: x["normalizer"]["normalizers"].pop(), lambda x: x.update(normalizer=None), lambda x: x["model"].update(end_of_word_suffix=None)):
        spec = json.loads(data)
        change(spec)
        with pytest.raises(ValueError, match="this codec"):
            bpe.Codec(json.dumps(spec).encode())
    with pytest.raises(ValueError, match="this codec"):
        bpe.Codec(open(queries.tokenizer_path("byte_bpe_50k.json"), "rb").read())


def test_random_words():
    rng, lib, own = random.Random(3), library(), bpe.codec(queries.tokenizer_path())
    letters = "abcdefghijklmnopqrstuvwxyzéüßабв 0123456789'.,-\n"
    texts = ["".join(rng.choices(letters, k=rng.choice([3, 20, 200]))) for _ in range(400)]
    bounds, ids, decoded = own.encode_all(texts)
    for k, t in enumerate(texts):
        mine, theirs = ids[bounds[k] : bounds[k + 1]].tolist(), lib.encode(t, add_special_tokens=False).ids
        assert mine == theirs == own.encode(t) and decoded[k] == lib.decode(theirs, skip_special_tokens=False), t


def test_cuts_are_certain():
    """Fragments between cuts, merged by themselves, give what the whole word gives."""
    own, rng = bpe.codec(queries.tokenizer_path()), random.Random(5)
    for _ in range(300):
        symbols = list("".join(rng.choices("abcdeioqxzw'-", k=rng.randint(1, 60))).encode())
        symbols[-1] += 256
        ids = [own.first[s] for s in symbols]
        assert own._merge_long(ids) == own.word(bytes([*symbols[:-1], symbols[-1] - 256]).decode())


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_round_trip_by_small_chunks(spark):
    big, other = "é" * 700, "z" * 5_000
    rows = [(1, "http://a/ b", big), (2, None, big), (5, "http://c", big), (3, "http://d", None), (4, "http://e", ""), (6, "http://f", "small"), (7, "http://g", "small"), (8, "x", other)]
    archive = warc.write(pages(spark, rows).selectExpr("*", "1 AS sha1", "2 AS payload", "3 AS row"), chunk=97)
    assert max(len(r["data"]) for r in archive.where("chunk_no > 0").collect()) <= 97
    got = {r["page_id"]: r for r in warc.read(archive).collect()}
    for page, _, html in rows:
        data = (html or "").encode()
        assert (got[page]["payload_bytes"], got[page]["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items() if k in (1, 2, 5)} == {1: ("revisit", 5), 2: ("revisit", 5), 5: ("response", None)}
    assert all(got[k]["record_type"] == "response" and got[k]["refers_to"] is None for k in (3, 4, 6, 7, 8))


def test_repeated_rows_and_empty_tables(spark):
    text = "y" * 2_000
    rows = [(1, "u", text), (1, "u", text), (2, "u", text), (2, "u", text), (None, None, None)]
    found = sorted((str(r["page_id"]), r["record_type"], r["refers_to"] or 0) for r in warc.read(warc.write(pages(spark, rows))).collect())
    assert found == [("1", "revisit", 2), ("1", "revisit", 2), ("2", "response", 0), ("2", "response", 0), ("None", "response", 0)]
    assert warc.read(warc.write(pages(spark, []))).count() == 0


def test_changed_chunks_are_noticed(spark):
    archive = warc.write(pages(spark, [(1, "u", "y" * 3_000)]), chunk=1_000)
    for broken in (archive.where("chunk_no <> 2"), archive.where("NOT last"), archive.selectExpr("record_id", "chunk_no", "if(chunk_no = 1, cast('zz' as binary), data) AS data", "payload_sha1", "last")):
        with pytest.raises(Exception, match="record|differs"):
            warc.read(broken).collect()


def test_revisits_are_held_against_their_response(spark):
    archive = warc.write(pages(spark, [(i, "u", "y" * 3_000) for i in (1, 2)]), chunk=1_000)
    other = archive.selectExpr("record_id", "chunk_no", "cast(replace(cast(data AS string), 'X-Payload-Length: 3000\r\nWARC-Profile', 'X-Payload-Length: 2999\r\nWARC-Profile') AS binary) AS data", "payload_sha1", "last")
    assert warc.read(archive).count() == 2
    with pytest.raises(Exception, match="a revisit differs"):
        warc.read(other).collect()


def test_files_are_plain_warc_and_are_read_back(spark, tmp_path):
    rows = [(i, f"http://h/{i}", "p" * (500 * i)) for i in range(6)] + [(9, None, "p" * 2500), (10, "http://x", "\r\n\r\nWARC/1.1\r\n" * 100)]
    archive = warc.write(pages(spark, rows), chunk=700)
    names = spark.createDataFrame(warc.save(archive, f"file://{tmp_path}").collect())
    data = b"".join((tmp_path / r["name"]).read_bytes() for r in names.collect())
    assert names.groupBy().sum("bytes").first()[0] == len(data)
    seen, at = 0, 0
    while at < len(data):
        head, _, _ = data[at:].partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        at += len(head) + 4 + int(fields["Content-Length"])
        assert head.startswith(b"WARC/1.1") and data[at : at + 4] == b"\r\n\r\n"
        at, seen = at + 4, seen + 1
    assert seen == len(rows)
    for chunk in (300, 1 << 18):
        back = warc.load(names, f"file://{tmp_path}", chunk)
        assert sorted(map(tuple, warc.read(back).collect())) == sorted(map(tuple, warc.read(archive).collect()))

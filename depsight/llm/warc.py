"""WARC archives as a chunked record table.

A record's bytes (WARC/1.1 header block, payload, end) lie in rows of (record_id, chunk_no): no row is larger than the chunk size, so a payload of any size
passes through Python, shuffles and readers piece by piece. Payloads are cut by built-in expressions, before Python sees them; each row carries the SHA-1
of the payload up to its end, which writer and readers carry forward from chunk to chunk. Only these sums decide which records are revisits. The rows' data
in order is a plain WARC stream, which save() writes to files and load() reads back as rows.

Of records with equal payloads of at least least_bytes, that with the largest page id is the response and the others revisit it; a revisit's length and
digest are checked against the response that it refers to.

Cases: null and empty payloads are records without payload, null urls become urn:page:<id>. Very long payloads take more rows, not larger ones. Of rows that
repeat the largest id each is a response (ties); repeated rows are records of their own. A null id is below all others. An empty table gives an empty
archive. Extra columns of the input are not looked at, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depsight.llm.shared import put, table

CHUNK = 1 << 18
LEAST_BYTES = 1000
DATE = "1970-01-01T00:00:00Z"
#: Bytes of rows that a task hands on at once.
BATCH = 4 << 20
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
CHUNKS = "record_id string, chunk_no int, data binary, payload_sha1 string, last boolean"
PIECES = "record_id string, row long, page_id long, url string, chunk_no int, data binary, payload_sha1 string, bytes long, last boolean"


def record_id(page_id: object, row: int) -> str:
    return f"urn:uuid:{uuid.uuid5(SPACE, f'page:{page_id}:{row}')}"


def gathered(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], data: int) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about BATCH bytes; data: the place of the column that holds the bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[data])
        if size >= BATCH or len(held) >= 4096:
            yield batch_of(held, names, types)
            held, size = [], 0
    if held:
        yield batch_of(held, names, types)


def batch_of(held: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return put(**{n: pa.array(x, t) for n, t, x in zip(names, types, zip(*held, strict=True), strict=True)})


def pieces(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", chunk: int = CHUNK) -> DataFrame:
    """A table of payload chunks, numbered from 1, in PIECES' columns; an empty payload is one empty chunk. row tells input rows apart.

    substring() cuts inside the JVM's row, and each piece goes to Python by itself. Arrow batches are bounded by bytes: a batch of large pieces is small.
    """
    payload = F.coalesce(pages[payload_col].cast("string"), F.lit("")).cast("binary")
    base = pages.select(F.monotonically_increasing_id().alias("row"), pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), payload.alias("payload"))
    most = F.greatest(F.ceil(F.octet_length("payload") / F.lit(chunk)), F.lit(1)).cast("int")
    spread = base.select("row", "page_id", "url", "payload", most.alias("most"), F.explode(F.sequence(F.lit(1), most)).alias("no"))
    cut = spread.select("row", "page_id", F.when(F.col("no") == 1, F.col("url")).alias("url"), "no", (F.col("no") == F.col("most")).alias("last"), F.substring("payload", (F.col("no") - 1) * chunk + 1, F.lit(chunk)).alias("piece"))
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.bool_()]
    names = [x.split()[0] for x in PIECES.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        sums, size = hashlib.sha1(), 0
        for b in batches:  # a record's pieces follow one another: they come from one row
            number, page, url, no, last, piece = (b.column(n) for n in ("row", "page_id", "url", "no", "last", "piece"))
            for k in range(b.num_rows):
                if no[k].as_py() == 1:
                    sums, size = hashlib.sha1(), 0
                data = piece[k].as_py()
                sums.update(data)
                size += len(data)
                yield record_id(page[k].as_py(), number[k].as_py()), number[k].as_py(), page[k].as_py(), url[k].as_py(), no[k].as_py(), data, sums.hexdigest(), size, last[k].as_py()

    return table(cut.mapInArrow(lambda batches: gathered(rows(batches), names, types, 5), PIECES), "pieces")


def records(parts: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """A table of one row a record: record_id, page_id, url, sha1, bytes, chunks, refers_to and refers_record; payloads take no part in it."""
    ends = parts.where("last").select("record_id", "row", "page_id", F.col("payload_sha1").alias("sha1"), "bytes", F.col("chunk_no").alias("chunks"))
    urls = parts.where("chunk_no = 1").select(F.col("record_id").alias("url_record"), "url")
    base = table(ends.join(urls, F.col("record_id") == F.col("url_record")).drop("url_record"), "records")
    best = base.where(F.col("bytes") >= least_bytes).groupBy("sha1", "bytes").agg(F.max(F.struct("page_id", F.negative("row").alias("row"), "record_id")).alias("b"), F.count("*").alias("n")).where("n > 1")
    best = best.select(F.col("sha1").alias("best_sha1"), F.col("bytes").alias("best_bytes"), F.col("b.page_id").alias("largest"), F.col("b.record_id").alias("largest_record"))
    joined = base.join(best, (F.col("sha1") == F.col("best_sha1")) & (F.col("bytes") == F.col("best_bytes")), "left")
    revisit = ~F.col("page_id").eqNullSafe(F.col("largest")) & F.col("largest_record").isNotNull()
    return table(joined.select("record_id", "page_id", "url", "sha1", "bytes", "chunks", F.when(revisit, F.col("largest")).alias("refers_to"), F.when(revisit, F.col("largest_record")).alias("refers_record")), "heads")


def header(record: str, page_id, url, sha1: str, size: int, refers_to, refers_record) -> bytes:
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    revisit = refers_record is not None
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<{record}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": uri,
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode(),
        "X-Page-Id": "" if page_id is None else str(page_id),
        "X-Payload-Length": str(size),
    }
    if revisit:
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<{refers_record}>", "X-Refers-To-Page-Id": "" if refers_to is None else str(refers_to)}
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(http) + (0 if revisit else size))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + http


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", chunk: int = CHUNK, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """The archive of a table of pages, in CHUNKS' columns, from tables in the shared folder.

    Chunk 0 is a record's header, which is known once the payload has been summed, and the last chunk its end. Chunks of revisits are still among the
    rows; ordered() ends them, where the records' chunks meet anyway, so that payloads are shuffled once.
    """
    parts = pieces(pages, id_col, url_col, payload_col, chunk)
    names = [x.split()[0] for x in CHUNKS.split(", ")]
    types = [pa.string(), pa.int32(), pa.binary(), pa.string(), pa.bool_()]
    none = hashlib.sha1().hexdigest()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for r in b.to_pylist():
                head = header(r["record_id"], r["page_id"], r["url"], r["sha1"], r["bytes"], r["refers_to"], r["refers_record"])
                yield r["record_id"], 0, head, none, False
                yield r["record_id"], r["chunks"] + 1, b"\r\n\r\n", none if r["refers_record"] else r["sha1"], True

    ends = records(parts, least_bytes).mapInArrow(lambda batches: gathered(rows(batches), names, types, 2), CHUNKS)
    return parts.select("record_id", "chunk_no", "data", "payload_sha1", F.lit(False).alias("last")).unionByName(table(ends, "ends"))


def ordered(archive: DataFrame) -> DataFrame:
    """Records one after another, each with its chunks in order and without a revisit's payload."""
    dealt = archive.repartition("record_id").sortWithinPartitions("record_id", "chunk_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skip = False
        for b in batches:
            keep = []
            nos, data, last = b.column("chunk_no").to_pylist(), b.column("data"), b.column("last").to_pylist()
            for k, no in enumerate(nos):
                if no == 0:
                    skip = b"\r\nWARC-Type: revisit\r\n" in data[k].as_py()
                keep.append(no == 0 or last[k] or not skip)
            yield b if all(keep) else b.filter(pa.array(keep))

    return dealt.mapInArrow(run, CHUNKS)


def parsed(head: bytes) -> dict[str, str]:
    lines = head.split(b"\r\n\r\n", 1)[0].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return dict(x.split(": ", 1) for x in lines[1:])


def read(archive: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record. One chunk is held at a time.

    A chunk that is missing, changed or out of place is an error, and so is a revisit that differs from its response.
    """
    number = lambda x: int(x) if x else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields, sums, size, follows = None, None, 0, 0
        for b in batches:
            out = []
            ids, nos, data, said, last = (b.column(n) for n in ("record_id", "chunk_no", "data", "payload_sha1", "last"))
            for k in range(b.num_rows):
                no, end = nos[k].as_py(), last[k].as_py()
                if no == 0:
                    if fields is not None:
                        raise ValueError(f"the record before {ids[k]} has no end")
                    fields, sums, size, follows = parsed(data[k].as_py()), hashlib.sha1(), 0, -1
                revisit = fields is not None and fields["WARC-Type"] == "revisit"
                if fields is None or (no != follows + 1 and not (end and revisit)):
                    raise ValueError(f"record {ids[k]}: chunk {no} doesn't follow {follows}")
                if no and not end:
                    piece = data[k].as_buffer()
                    sums.update(piece)
                    size += piece.size
                follows = no
                if sums.hexdigest() != said[k].as_py():
                    raise ValueError(f"record {ids[k]}: the digest up to chunk {no} differs")
                if end:
                    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    total = int(fields["X-Payload-Length"])
                    if not revisit and (digest != sums.hexdigest() or total != size):
                        raise ValueError(f"record {ids[k]}: its payload isn't what its header says")
                    out.append((ids[k].as_py(), number(fields["X-Page-Id"]), total, digest, fields["WARC-Type"], number(fields.get("X-Refers-To-Page-Id")), fields.get("WARC-Refers-To", "<>")[1:-1] or None))
                    fields = None
            if out:
                yield batch_of(out, ["record", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "refers_record"], [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()])
        if fields is not None:
            raise ValueError("the last record has no end")

    found = table(ordered(archive).mapInArrow(run, "record string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, refers_record string"), "read")
    wanted = found.where("record_type = 'revisit'").select(F.col("refers_record").alias("own")).distinct()
    answers = found.where("record_type = 'response'").join(wanted, F.col("record") == F.col("own"), "left_semi").select(F.col("record").alias("answer"), F.col("payload_bytes").alias("own_bytes"), F.col("payload_digest").alias("own_digest"))
    joined = found.join(answers, F.col("refers_record") == F.col("answer"), "left")
    same = F.col("payload_bytes").eqNullSafe(F.col("own_bytes")) & F.col("payload_digest").eqNullSafe(F.col("own_digest"))
    checked = F.when((F.col("record_type") == "revisit") & ~same, F.raise_error(F.concat(F.lit("a revisit differs from the record "), "refers_record"))).otherwise(F.col("record_type"))
    return joined.select("page_id", "payload_bytes", "payload_digest", checked.cast("string").alias("record_type"), "refers_to")


def save(archive: DataFrame, folder: str) -> DataFrame:
    """Writes the archive as .warc files, one a partition, into a folder that all executors reach (any address pyarrow knows): name, bytes.

    A task writes under a name of its own attempt and renames at its end, so a retried task leaves one whole file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        part = TaskContext.get().partitionId()
        own, final, size = f"{root}/.{part}-{uuid.uuid4().hex}", f"{root}/part-{part:05d}.warc", 0
        with store.open_output_stream(own) as to:
            for b in batches:
                for x in b.column("data"):
                    to.write(piece := x.as_buffer())
                    size += piece.size
        store.delete_file(own) if not size else store.move(own, final)
        if size:
            yield put(name=[os.path.basename(final)], bytes=pa.array([size], pa.int64()))

    return ordered(archive).mapInArrow(run, "name string, bytes long")


def load(files: DataFrame, folder: str, chunk: int = CHUNK) -> DataFrame:
    """The chunk rows of saved .warc files (files: name, as save() returns), a file a task at a time, read by chunks."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            for name in b.column("name").to_pylist():
                with store.open_input_stream(f"{root}/{name}") as stream:
                    yield from records_of(stream, chunk)

    names = [x.split()[0] for x in CHUNKS.split(", ")]
    types = [pa.string(), pa.int32(), pa.binary(), pa.string(), pa.bool_()]
    return files.select("name").mapInArrow(lambda batches: gathered(rows(batches), names, types, 2), CHUNKS)


def records_of(stream, chunk: int) -> Iterator[tuple]:
    """The rows of each record of a WARC stream; no more than a chunk and a header are held."""
    held = b""

    def more() -> bool:
        nonlocal held
        got = stream.read(chunk)
        held += got
        return bool(got)

    def until(end: bytes) -> bytes:
        nonlocal held
        while end not in held:
            if not more():
                raise ValueError("a WARC file ends inside a record")
        head, _, held = held.partition(end)
        return head + end

    while held or more():
        head = until(b"\r\n\r\n")
        fields, left = parsed(head), int(parsed(head)["Content-Length"])
        http = until(b"\r\n\r\n")
        left -= len(http)
        name, no, sums = fields["WARC-Record-ID"][1:-1], 1, hashlib.sha1()
        yield name, 0, head + http, sums.hexdigest(), False
        while left:
            if not held and not more():
                raise ValueError("a WARC file ends inside a record")
            piece, held = held[: min(left, chunk)], held[min(left, chunk) :]
            left -= len(piece)
            sums.update(piece)
            yield name, no, piece, sums.hexdigest(), False
            no += 1
        yield name, no, until(b"\r\n\r\n"), sums.hexdigest(), True


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
b AS (SELECT *, CASE WHEN payload_bytes >= {LEAST_BYTES} THEN max(page_id) OVER (PARTITION BY html) END AS best FROM p)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest, CASE WHEN best <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN best <> page_id THEN best END AS refers_to FROM b
"""

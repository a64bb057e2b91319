"""WARC archives whose records are compressed one by one with a Zstandard
dictionary, which stands in a skippable frame before them."""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbor.llm.common import few, table, tidied, utf8
from arbor.session import qualified, scratch, ship, written

#: The magic number of the skippable frame that holds a dictionary.
DICTIONARY_FRAME = 0x184D2A5D

ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 32 << 10
#: Bytes of records that an archive's dictionary is built from.
SAMPLE_BYTES = 2 << 20
LEVEL = 3
#: Pages of one payload from which on it is frequent.
FREQUENT = 1000
DATE = "2020-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str) -> str:
    return "".join(c if 0x20 < ord(c) != 0x7F else "".join(f"%{x:02X}" for x in c.encode()) for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit of refers_to's response; a revisit keeps the
    response's HTTP headers, so that the length of its payload is known."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_uri(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """From whole records at even distances, SAMPLE_BYTES of them; from too few
    records to train on, their bytes themselves."""
    total = sum(map(len, records))
    step = max(1, -(-total // SAMPLE_BYTES))
    sample = records[::step]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(256, total // 10)), sample, k=256, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(sample)[:DICTIONARY_BYTES] or b"WARC/1.1")


def archive(records: list[bytes]) -> bytes:
    """An archive of records: the dictionary's frame, then a frame each."""
    d = build_dictionary(records)
    raw = d.as_bytes()
    pressed = zstandard.ZstdCompressor(level=19).compress(raw)
    c = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=True)
    return b"".join([struct.pack("<II", DICTIONARY_FRAME, len(pressed)), pressed, *(c.compress(r) for r in records)])


def read_archive(content: bytes):
    """The records of an archive, in order."""
    view, at, d = memoryview(content), 0, None
    if len(content) >= 8 and struct.unpack_from("<I", content)[0] == DICTIONARY_FRAME:
        size = struct.unpack_from("<I", content, 4)[0]
        raw = bytes(view[8 : 8 + size])
        if raw[:4] == b"\x28\xb5\x2f\xfd":
            raw = zstandard.ZstdDecompressor().decompress(raw)
        d, at = zstandard.ZstdCompressionDict(raw), 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=d) if d is not None else zstandard.ZstdDecompressor()
    while at < len(view):
        one, out = reader.decompressobj(), []
        while not one.eof:
            if at >= len(view):
                raise ValueError("an archive ends within a record")
            part = view[at : at + (1 << 15)]
            out.append(one.decompress(part))
            at += len(part) - len(one.unused_data)
        yield b"".join(out)


def parse(raw: bytes) -> dict:
    """What a record tells of its page; a response's payload is checked against
    its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda key: (lambda x: int(x) if x else None)(fields.get(key, "<urn:page:>")[10:-1])
    size = int(dict(line.split(b": ", 1) for line in http.split(b"\r\n")[1:])[b"Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload is not what its digest says")
    return {"page_id": number("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To"), "payload": payload}


def archived(pages: DataFrame, least: int = 0, then=None, schema: str = "archive string, records long, content binary") -> DataFrame:
    """Archives (archive, records, content) of pages(page_id, url, html). Of pages with equal payloads of at least `least` bytes
    that with the largest page_id is the response, others revisit it.

    A null html is an empty payload, a null url is left out. Rows that repeat
    the largest page_id are responses each; a null page_id never is a
    response's unless all its equals have none. Other columns are ignored; an
    empty table gives no archive. then makes batches of schema of these, in the same task."""
    ship(pages.sparkSession)
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    told = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n")).where(F.col("n") >= least)
    told = written(told.select("page_id", "digest").distinct(), "payloads")
    first = told.groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("times")).where("times > 1 and kept is not null")
    first = written(first, "responses")
    # a payload of many pages goes to them, they don't meet in one task
    many = few(first.where(F.col("times") >= FREQUENT).drop("times"))
    again = told.join(first.where(F.col("times") < FREQUENT).drop("times"), "digest").unionByName(told.join(many, "digest")).where(~F.col("page_id").eqNullSafe(F.col("kept")))
    again = again.select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), F.col("kept").alias("refers_to"))
    dealt = rows.withColumn("digest", F.sha1(payload)).join(again, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left")

    def run(batches):
        from pyspark import TaskContext

        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            data, offsets = utf8(b.column("html"))
            columns = [b.column(c).to_pylist() for c in ("page_id", "url", "refers_to")]
            raw = memoryview(data)
            for i, (page, url, refers) in enumerate(zip(*columns)):
                held.append(record(page, url, bytes(raw[offsets[i] : offsets[i + 1]]), refers))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([f"part-{part:05d}-{n:05d}.warc.zst"]), pa.array([len(held)], pa.int64()), pa.array([archive(held)], pa.binary())], names=["archive", "records", "content"])
                    n, held, size = n + 1, [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([f"part-{part:05d}-{n:05d}.warc.zst"]), pa.array([len(held)], pa.int64()), pa.array([archive(held)], pa.binary())], names=["archive", "records", "content"])

    return dealt.select("page_id", "url", "html", "refers_to").mapInArrow(tidied(run if then is None else lambda batches: then(run(batches))), schema)


def _files(uri: str):
    """The file system and path of a qualified URI below the shared folder."""
    from pyarrow import fs

    scheme, _, rest = uri.partition(":")
    if scheme == "file":  # as it stands: Spark's paths are not percent-encoded
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + rest)


def save(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write the archives of archived() as files below folder, a path or URI that
    all executors reach, and return (file, records, bytes), written. A task that
    runs again writes files of its own: only those listed count."""
    folder = qualified(pages.sparkSession, folder)

    def run(batches):
        import uuid

        system, top = _files(folder)
        system.create_dir(top, recursive=True)
        for b in batches:
            for name, records, content in zip(b.column("archive").to_pylist(), b.column("records").to_pylist(), b.column("content")):
                held = content.as_buffer()
                name = name.replace(".warc.zst", f"-{uuid.uuid4().hex[:12]}.warc.zst")
                with system.open_output_stream(f"{top}/{name}", compression=None) as f:
                    f.write(held)
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([records], pa.int64()), pa.array([held.size], pa.int64())], names=["file", "records", "bytes"])

    return written(archived(pages, least, run, "file string, records long, bytes long"), "warc-list")


READ = [("page_id", "long"), ("url", "string"), ("payload_bytes", "long"), ("payload_digest", "string"), ("record_type", "string"), ("refers_to", "long"), ("payload", "binary")]


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives in archives(file), or in archives(content),
    with their payloads if wanted (a revisit has none)."""
    ship(archives.sparkSession)
    columns = READ if payloads else READ[:-1]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(c, kinds[k]) for c, k in columns])

    def loaded(b):
        if "content" in b.schema.names:
            yield from (x.as_py() for x in b.column("content"))
            return
        for uri in b.column("file").to_pylist():
            system, path = _files(uri)
            with system.open_input_stream(path, compression=None) as f:
                yield f.read()

    def run(batches):
        for b in batches:
            for content in loaded(b):
                out, size = [], 0
                for raw in read_archive(content):
                    row = parse(raw)
                    if not payloads:
                        del row["payload"]
                    out.append(row)
                    size += len(raw) if payloads else 200
                    if size >= ARCHIVE_BYTES // 4:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

    source = "content" if "content" in archives.columns else "file"
    return archives.select(source).mapInArrow(tidied(run), ", ".join(f"{c} {k}" for c, k in columns))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = save(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    dealt = files.repartition(max(1, files.count()), "file")  # a listing is small, its archives aren't
    return read(dealt, payloads=False).drop("url")

"""WARC archives in Zstandard, each record compressed apart with a dictionary the archive carries.

A dictionary is built from a bounded sample of the records to be archived. Every archive begins with a
skippable frame (magic 0x184D2A5D) that holds it; each record is then one frame, so a reader can open any
record alone. Of records with equal payloads of at least `min_bytes`, the one with the smallest page id is a
response, the others are revisits, which keep the HTTP header block only.

Archives have names of their own attempt. The table `_index` beside them lists those that were committed with
the job, and readers go by it, so what a lost attempt left behind is never read.

Defined cases: a null html is an empty payload; null urls are written as an empty target; rows that repeat
the smallest page id of their payload are all responses; rows without a page id are records without one,
responses unless a row with an id has their payload; an empty table gives no archive and an empty result; very
long payloads are one record; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireworks.llm.common import attach, gives_back, new_shared_path, small_batches

#: Compressed bytes after which an archive is closed, so that a reader can hold one.
ARCHIVE_BYTES = 16 << 20
#: The sample for the dictionary: rows, bytes of each record used, and the dictionary's size.
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 8192, 64 << 10
LEVEL = 3
MIN_PAYLOAD = 100
#: Records, and bytes of their payloads, of an Arrow batch that a reader hands on; archives of a reader's task.
READ_RECORDS, READ_BYTES, READ_ARCHIVES = 1000, 8 << 20, 4
_SKIPPABLE = 0x184D2A5D


def record_bytes(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head without the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    name = lambda x: "" if x is None else str(x)
    fields = [
        ("WARC-Type", "revisit" if refers_to is not None else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {name(page_id)}')}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Page-Number", name(page_id)),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Page-Number", str(refers_to)), ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {refers_to}')}>")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields, HTTP length and payload of a record."""
    top, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in top.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return fields | {"http_length": length, "payload": payload}


def train_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A Zstandard dictionary from sample records; with too few of them, their plain content serves as one."""
    total = sum(map(len, records))
    try:
        return zstandard.train_dictionary(min(size, max(1024, total // 4)), records).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[:size] or b"WARC/1.1\r\n"


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    trained = data[:4] == b"\x37\xa4\x30\xec"
    return zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)


class ArchiveWriter:
    """Builds one archive in memory: skippable dictionary frame, then a frame for each record."""

    def __init__(self, dictionary: bytes, level: int = LEVEL):
        packed = zstandard.ZstdCompressor(level=9).compress(dictionary)
        self.out = io.BytesIO()
        self.out.write(struct.pack("<II", _SKIPPABLE, len(packed)) + packed)
        digested = _dictionary(dictionary)
        digested.precompute_compress(level=level)
        self.compress = zstandard.ZstdCompressor(level=level, dict_data=digested, write_content_size=True).compress

    def add(self, record: bytes) -> None:
        self.out.write(self.compress(record))


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that begins at `at` ends: its header, then blocks that each name their size."""
    head = data[at : at + 18]
    at += zstandard.frame_header_size(head)
    last = False
    while not last:
        block = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = block & 1, block >> 1 & 3, block >> 3
        at += 3 + (1 if kind == 1 else size)  # a run of one byte is stored as that byte
    return at + 4 * zstandard.get_frame_parameters(head).has_checksum


def read_archive(data: bytes) -> Iterator[dict]:
    """Records of an archive, opened with the dictionary in its first frame."""
    magic, length = struct.unpack_from("<II", data)
    if magic != _SKIPPABLE:
        raise ValueError("the archive does not begin with a dictionary frame")
    view, at = memoryview(data), 8 + length
    opener = zstandard.ZstdDecompressor(dict_data=_dictionary(zstandard.ZstdDecompressor().decompress(view[8:at])))
    while at < len(data):
        end = frame_end(view, at)
        yield parse_record(opener.decompress(view[at:end]))
        at = end


def mark_revisits(pages: DataFrame, min_bytes: int = MIN_PAYLOAD) -> DataFrame:
    """pages with payload, digest and refers_to (null for responses). Digests are grouped without payloads; pages meet the digests that repeat, those of very many pages by a broadcast."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    hashed = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    long = hashed.where(F.length("payload") >= min_bytes)
    first = long.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1 and first_id is not null")
    linked = attach(hashed, first, "digest", "first_id", pages.count(), "page_id")
    return linked.withColumn("refers_to", F.when(~F.col("first_id").eqNullSafe(F.col("page_id")), F.col("first_id"))).drop("first_id")


def write_archives(marked: DataFrame, path: str, dictionary: bytes, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes archives below path, in whatever store it names; returns name, records, bytes of each that its task committed."""
    small_batches(marked.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, part, writer, n = TaskContext.get(), 0, None, 0
        store, root = fs.FileSystem.from_uri(path)

        def close() -> pa.RecordBatch:
            name = f"part-{task.partitionId():06d}-{part:04d}-{uuid.uuid4().hex}.warc.zst"
            store.create_dir(root, recursive=True)
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(writer.out.getbuffer())
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([writer.out.tell()], pa.int64())], ["name", "records", "bytes"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                writer = writer or ArchiveWriter(dictionary)
                writer.add(record_bytes(*row))
                n += 1
                if writer.out.tell() >= archive_bytes:
                    yield close()
                    part, writer, n = part + 1, None, 0
        if writer:
            yield close()

    return marked.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(gives_back(run), "name string, records long, bytes long")


_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload of every record of the archives that path's index lists. Digests of responses are computed anew from the payload that was read."""
    index = spark.read.schema("name string, records long, bytes long").parquet(f"{path}/_index").select("name")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        number = lambda x: int(x) if x else None
        for batch in batches:
            for name in batch.column("name").to_pylist():
                with store.open_input_stream(f"{root}/{name}", compression=None) as file:
                    data = file.read()
                rows, held = [], 0
                for r in read_archive(data):
                    response = r["WARC-Type"] == "response"
                    digest = hashlib.sha256(r["payload"]).hexdigest() if response else r["WARC-Payload-Digest"].removeprefix("sha256:")
                    rows.append((number(r["WARC-Page-Number"]), r["WARC-Target-URI"], r["http_length"], digest, r["WARC-Type"], number(r.get("WARC-Refers-To-Page-Number")), r["payload"]))
                    held += len(r["payload"])
                    if len(rows) >= READ_RECORDS or held >= READ_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return index.repartition(max(1, -(-index.count() // READ_ARCHIVES)), F.xxhash64("name")).mapInArrow(gives_back(run), _RECORD)


def archive(pages: DataFrame, path: str | None = None) -> str:
    """Writes pages(page_id, url, html) to archives and returns their folder, which must be new."""
    spark = pages.sparkSession
    path = path or new_shared_path(spark, "warc")
    ids = [r.page_id for r in pages.select("page_id", F.xxhash64("page_id").alias("h")).where("page_id is not null").orderBy("h", "page_id").limit(SAMPLE_ROWS).collect()]
    head = F.substring(F.coalesce("html", F.lit("")), 1, SAMPLE_BYTES).alias("html")
    some = pages.where(F.col("page_id").isin(ids)).select("page_id", "url", head).limit(2 * SAMPLE_ROWS).collect()
    dictionary = train_dictionary([record_bytes(r.page_id, r.url, r.html.encode(), "0" * 64, None) for r in some])
    write_archives(mark_revisits(pages), path, dictionary).write.parquet(f"{path}/_index")
    return path

"""WARC archives with a dictionary: one Zstandard frame for each record, the dictionary in a leading skippable frame.

Writing.  Rows are joined with the smallest page_id of their payload's digest (made on the map side first; payloads
that occur once have no partner, and the join splits large partitions), so each row knows whether it is a response or
a revisit.  Every task gathers records up to ``archive_bytes``, trains a dictionary on a bounded sample of their bytes
(``SAMPLE`` records of up to ``SAMPLE_BYTES`` each), and writes one file to the shared folder under a temporary name,
then renames it.  Names of files are returned as rows and written as a table, the manifest: what a lost attempt left
behind is in no manifest, so it is never read.

Reading.  Files of the manifest are dealt evenly to tasks, as many as the session's partitions or the files if fewer, and
each is decompressed record by record.  A file that the manifest lists twice (two tasks had equal records) is read twice.

Defined cases: a null payload is empty; a null or multi-line URL is written without it or with its line ends replaced;
of equal payloads all rows with the smallest page_id are responses, so repeated rows are too; null page_ids revisit the
smallest id, or are responses if there is none.  Archives of few records may have no dictionary, and then no such frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import cut, partitions, shared_folder

ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 32 << 10
#: Records, and bytes of each, that a dictionary is trained on: of all records of the archive, evenly spaced ones.
SAMPLE, SAMPLE_BYTES = 128, 8 << 10
#: Skippable frame that holds a dictionary, and the date of records that have none.
DICTIONARY_MAGIC, DATE = 0x184D2A5D, "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{digest}')}>"


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP header only."""
    digest, revisit = sha1(payload), refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + " ".join(url.splitlines()))
    if revisit:
        lines += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page: {refers_to}"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """The bytes of one archive."""
    step = max(1, len(records) // SAMPLE)
    samples = [r[:SAMPLE_BYTES] for r in records[::step][:SAMPLE]]
    try:
        trained = zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 8)), samples, k=200, d=8)
    except zstandard.ZstdError:  # too little to train on
        trained = None
    packer = zstandard.ZstdCompressor(level=3, dict_data=trained, write_content_size=True)
    raw = trained.as_bytes() if trained else b""
    lead = struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw if trained else b""
    return lead + b"".join(packer.compress(r) for r in records)


def records_of(stream):
    """(header fields, block) of each record of an archive; ``stream`` is a binary file."""
    head = stream.read(8)
    magic, size = struct.unpack("<II", head) if len(head) == 8 else (0, 0)
    known = zstandard.ZstdCompressionDict(stream.read(size)) if magic == DICTIONARY_MAGIC else None
    rest = b"" if known else head
    unpacker = zstandard.ZstdDecompressor(dict_data=known)
    while rest or (rest := stream.read(1 << 18)):
        frame, out = unpacker.decompressobj(), []
        while not frame.eof:
            if not rest and not (rest := stream.read(1 << 18)):
                raise ValueError("the archive ends inside a record")
            out.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else b""
        head, _, body = b"".join(out).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield fields, body[: int(fields["Content-Length"])]


def _writer(folder: str, archive_bytes: int):
    def run(batches):
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)

        def flush(records: list[bytes]):
            data = archive(records)
            name, attempt = f"{hashlib.sha256(data).hexdigest()[:32]}.warc.zst", uuid.uuid4().hex
            with fs.open_output_stream(f"{base}/.{name}.{attempt}", compression=None) as f:
                f.write(data)
            fs.move(f"{base}/.{name}.{attempt}", f"{base}/{name}")
            return pa.RecordBatch.from_pydict({"name": [name], "records": [len(records)], "bytes": [len(data)]})

        held, size = [], 0
        for batch in batches:
            for page_id, url, html, refers_to in zip(*batch.columns):
                held.append(record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode("utf-8", "surrogatepass"), refers_to.as_py()))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return run


def write_archives(pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> tuple[str, DataFrame]:
    """Write ``pages`` (page_id, url, html) as archives; returns the folder and the manifest (name, records, bytes)."""
    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "warc")
    fs, base = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    rows = pages.select("page_id", "url", "html").withColumn("_digest", F.unhex(F.sha1(F.coalesce("html", F.lit("")))))
    long = F.octet_length(F.coalesce("html", F.lit(""))) >= min_revisit_bytes
    first = rows.where(long).groupBy("_digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1 and _first is not null").select("_digest", "_first")
    refers = F.when(long & ~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    told = rows.join(first, "_digest", "left").select("page_id", "url", "html", refers.alias("refers_to"))
    return folder, cut(told.mapInArrow(_writer(folder, archive_bytes), "name string, records long, bytes long"))


def _reader(folder: str):
    def run(batches):
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                    rows, size = [], 0
                    for fields, block in records_of(f):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        length = int(head.decode().rsplit("Content-Length: ", 1)[1])
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if fields["WARC-Type"] == "response" and (len(payload) != length or sha1(payload) != digest):
                            raise ValueError(f"{name}: a payload differs from its digest")
                        page, other = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page")
                        rows.append((page and int(page), length, digest, fields["WARC-Type"], other and int(other), fields.get("WARC-Target-URI"), payload if fields["WARC-Type"] == "response" else None))
                        size += len(payload)
                        if size >= 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _READ.values())], list(_READ))
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _READ.values())], list(_READ))

    return run


_READ = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string(), "payload": pa.binary()}


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Every record of the manifest's archives: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload."""
    files = manifest.count()
    names = manifest.select("name").repartition(max(1, min(files, 4 * partitions(spark))))
    return names.mapInArrow(_reader(folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")

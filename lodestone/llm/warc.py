"""WARC archives: monolithic gzip files in, one gzip member a record and a sidecar offset index out.

1. write_monolithic() writes records as whole-file gzip streams, which can only be read from their beginning.
2. normalise() inflates each such stream once, in pieces, writes every record as its own gzip member and next to the
   file an index (offset, length, record id, type, payload digest), one line a record.
3. read_records() reads members by their offsets, so that any record can be read alone and a file by many tasks.

Records of equal payloads of at least MIN_REVISIT bytes are stored once: that of the largest page_id is a response,
the others are revisits with the digest and size of the payload and the id of the response.

Files are written under a temporary name and renamed, with names and content that depend on the rows only, so a task
that runs again leaves the same file. Folders are in the shared folder of the session.

Defined cases: a null html is an empty payload; null urls are empty; null page_ids are kept and never referred to,
unless all copies have none; of rows that repeat a page_id and payload only one is a response. Extra columns are not
read. An empty table gives no records.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import delete, new_folder, small_batches, written

MIN_REVISIT = 1000
#: Bytes of payload in an archive, bytes read at a time and compression level.
ARCHIVE_BYTES, READ, LEVEL = 64 << 20, 1 << 20, 4
DATE = "2000-01-01T00:00:00Z"
RECORD = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long"
INDEX = "file string, offset long, length long, record_id string, record_type string, payload_digest string"


def decide(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """pages with payload, payload_digest, payload_bytes, record_type and refers_to.

    Only (page_id, digest) are grouped, pre-aggregated; the join back is one that Spark can split for a hot digest.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    large = F.col("payload_bytes") >= min_revisit
    per_id = rows.where(large).groupBy("payload_digest", "page_id").agg(F.count("*").alias("n"))
    low = F.coalesce("page_id", F.lit(-(1 << 63)).cast("long"))
    groups = per_id.groupBy("payload_digest").agg(F.sum("n").alias("copies"), F.max(F.struct(low.alias("o"), "page_id", "n")).alias("top"))
    groups = written(groups.where("copies > 1").select("payload_digest", F.col("top.page_id").alias("main"), F.col("top.n").alias("mains")), "digests")
    joined = rows.join(groups.withColumn("shared", F.lit(True)), "payload_digest", "left")
    is_main = F.coalesce(F.col("shared") & F.col("page_id").eqNullSafe(F.col("main")), F.lit(False))
    twice = is_main & (F.col("mains") > 1)
    kind = F.when(F.col("shared").isNull() | is_main, "response").otherwise("revisit")
    made = joined.where(~twice).withColumn("record_type", kind)
    if groups.where("mains > 1").limit(1).count():  # repeated rows of the response's page
        one = F.row_number().over(Window.partitionBy("payload_digest", "page_id").orderBy("url"))
        again = joined.where(twice).withColumn("record_type", F.when(one == 1, "response").otherwise("revisit"))
        made = made.unionByName(again)
    refers = F.when(F.col("record_type") == "revisit", F.col("main"))
    return made.select("page_id", "url", "payload", "payload_digest", "payload_bytes", "record_type", refers.alias("refers_to"))


def record_bytes(page_id, url: str, payload: bytes, digest: str, size: int, kind: str, refers_to) -> bytes:
    """One WARC/1.1 record."""
    name = lambda x: f"<urn:page:{'null' if x is None else x}>"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {json.dumps(url)[1:-1]}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
        payload = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + payload + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; the first line must be a WARC version."""
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]}")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def _fs(uri: str):
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


class _Output:
    """A file that appears under its name when it is complete."""

    def __init__(self, uri: str):
        self.fs, self.path = _fs(uri)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.stream, self.size = self.fs.open_output_stream(self.temporary, compression=None), 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def done(self) -> None:
        self.stream.close()
        if not isinstance(self.fs, pafs.LocalFileSystem) and self.fs.get_file_info(self.path).type != pafs.FileType.NotFound:
            self.fs.delete_file(self.path)
        self.fs.move(self.temporary, self.path)


def write_monolithic(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, level: int = LEVEL) -> DataFrame:
    """(file): archives with the records of decide(), each file a single gzip stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, out, press, size, files = TaskContext.get().partitionId(), 0, None, None, 0, []

        def close() -> None:
            out.write(press.flush())
            out.done()

        for batch in small_batches(batches, "payload"):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    files.append(f"{folder}/{task:06d}-{number:04d}.warc.gz")
                    out, press, size, number = _Output(files[-1]), zlib.compressobj(level, zlib.DEFLATED, 31), 0, number + 1
                data = record_bytes(*row)
                out.write(press.compress(data))
                size += len(data)
                if size >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.string())], ["file"])

    columns = ["page_id", "url", "payload", "payload_digest", "payload_bytes", "record_type", "refers_to"]
    return written(records.select(*columns).mapInArrow(run, "file string"), "archives")


def iterate_records(chunks: Iterator[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """(head, body) of each record of an inflated stream; memory follows the largest record."""
    buffer, at = bytearray(), 0
    chunks = iter(chunks)

    def need(n: int) -> bool:
        nonlocal at
        while len(buffer) - at < n:
            if at:
                del buffer[:at]
                at = 0
            more = next(chunks, None)
            if more is None:
                return False
            buffer.extend(more)
        return True

    while need(1):
        looked = at
        while (end := buffer.find(b"\r\n\r\n", looked)) < 0:
            have = len(buffer) - at
            if not need(have + 1):
                raise ValueError("a record's head is cut off")
            looked = at + max(0, have - 3)
        head = bytes(buffer[at:end])
        size = int(parse_head(head)["content-length"])
        whole = end - at + 4 + size + 4
        if not need(whole):
            raise ValueError("a record is cut off")
        start = at + len(head) + 4
        body = bytes(buffer[start : start + size])
        at += whole
        yield head, body


def inflate(stream, wbits: int = 31) -> Iterator[bytes]:
    """The bytes of a gzip file in pieces; several members may follow each other."""
    unpack = zlib.decompressobj(wbits)
    while data := stream.read(READ):
        while data:
            yield unpack.decompress(data, 4 * READ)
            data = unpack.unconsumed_tail
            if unpack.eof:
                data, unpack = unpack.unused_data, zlib.decompressobj(wbits)


def normalise(files: DataFrame, folder: str, level: int = LEVEL) -> DataFrame:
    """The index rows of member-wise copies of monolithic archives; each copy has its index beside it as .idx."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                fs, path = _fs(file)
                target = f"{folder}/{path.rpartition('/')[2]}"
                out, sidecar, rows = _Output(target), _Output(f"{target}.idx"), []
                with fs.open_input_stream(path, compression=None) as stream:
                    for head, body in iterate_records(inflate(stream)):
                        press = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = press.compress(head + b"\r\n\r\n" + body + b"\r\n\r\n") + press.flush()
                        fields = parse_head(head)
                        row = (target, out.size, len(member), fields["warc-record-id"], fields["warc-type"], fields.get("warc-payload-digest", ""))
                        out.write(member)
                        sidecar.write((json.dumps(row[1:]) + "\n").encode())
                        rows.append(row)
                        if len(rows) == 10_000:
                            yield _index_batch(rows)
                            rows = []
                out.done()
                sidecar.done()
                yield _index_batch(rows)

    n = max(1, min(files.count(), 4 * files.sparkSession.sparkContext.defaultParallelism))
    return written(files.repartition(n, "file").mapInArrow(run, INDEX), "index")


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    columns = list(zip(*rows)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in INDEX.split(", ")])


def read_index(path: str) -> list[list]:
    """The rows of a sidecar index."""
    fs, at = _fs(path)
    with fs.open_input_stream(at) as stream:
        return [json.loads(x) for x in stream.read().splitlines()]


def read_member(handle, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of the record at an offset."""
    handle.seek(offset)
    ((head, body),) = iterate_records([zlib.decompress(handle.read(length), 31)])
    return parse_head(head), body


def read_records(index: DataFrame, payload: bool = False) -> DataFrame:
    """Records of archives by their index rows. The payload of a response is held against its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = (None, None)
        for batch in batches:
            rows = []
            for file, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if opened[0] != file:
                    fs, path = _fs(file)
                    opened = (file, fs.open_input_file(path))
                f, body = read_member(opened[1], offset, length)
                digest, kind = f["warc-payload-digest"].removeprefix("sha1:"), f["warc-type"]
                if kind == "response" and hashlib.sha1(body).hexdigest() != digest:
                    raise ValueError(f"the payload of {f['warc-record-id']} doesn't have its digest")
                number = [None if x in (None, "null") else int(x) for x in (_page(f["warc-record-id"]), _page(f.get("warc-refers-to")))]
                row = (number[0], json.loads(f'"{f["warc-target-uri"]}"'), kind, digest, int(f["x-payload-length"]), number[1])
                rows.append((*row, body) if payload else row)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
            columns = list(zip(*rows)) or [()] * (6 + payload)
            names = [x.split()[0] for x in RECORD.split(", ")] + ["payload"] * payload
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return index.select("file", "offset", "length").mapInArrow(run, RECORD + ", payload binary" * payload)


def _page(urn: str | None) -> str | None:
    return urn and urn.removeprefix("<urn:page:").removesuffix(">")


def archive(pages: DataFrame, folder: str | None = None, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write pages as archives below a folder (default: a new shared one) and give the index of the normalised files."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    records = decide(pages, min_revisit)
    files = write_monolithic(records, f"{folder}/raw")
    index = normalise(files, f"{folder}/warc")
    delete(pages.sparkSession, f"{folder}/raw")  # the index is written; nothing reads the streams again
    return index

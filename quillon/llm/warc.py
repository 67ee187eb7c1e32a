"""WARC archives compressed record by record with a Zstandard dictionary.

Each file starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary, trained on the
records that the file's first batch archives; every record then is a frame of its own.  Payloads that
were archived before become ``revisit`` records that name the first.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import file_system, new_path, store

SKIPPABLE = 0x184D2A5D  # fixed values of the WARC/1.1 and Zstandard formats
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST_PAYLOAD = 100
DICT_BYTES, TRAIN_BYTES, FILE_BYTES, LEVEL = 64 << 10, 4 << 20, 64 << 20, 3
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def _uuid(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record; line breaks in a url are percent-encoded so that headers stay whole."""
    body = b"" if revisit else payload
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_uuid(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_uuid(refers_to, digest)}", f"X-Payload-Length: {len(payload)}"]
        head += [f"X-Refers-To-Page: {refers_to}"] if refers_to is not None else []
    head += [f"X-Page: {page_id}"] if page_id is not None else []
    head += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


def dictionary(samples: list[bytes]):
    """A trained dictionary; from too few or too short samples, their plain bytes."""
    import zstandard as z

    try:
        return z.train_dictionary(min(DICT_BYTES, max(1024, sum(map(len, samples)) // 10)), samples, level=LEVEL)
    except z.ZstdError:
        return z.ZstdCompressionDict((b"".join(samples) + b"WARC/1.1\r\nWARC-Type: response\r\n")[:DICT_BYTES], dict_type=z.DICT_TYPE_RAWCONTENT)


class Writer:
    """Archive files of bounded size; holds back only what the dictionary is trained on."""

    def __init__(self, folder: str, part: int):
        self.folder, self.part, self.seq, self.done = folder, part, 0, []
        self.out, self.held, self.held_bytes = None, [], 0

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.held.append(data)
            self.held_bytes += len(data)
            if self.held_bytes >= TRAIN_BYTES:
                self.open()
        else:
            self.write(data)

    def open(self) -> None:
        import zstandard as z

        self.name = f"{self.folder}/part-{self.part:05d}-{self.seq:04d}-{uuid.uuid4().hex[:12]}.warc.zst"
        fs, path = file_system(self.name)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        trained = dictionary(self.held)
        raw = trained.as_bytes()
        self.packer = z.ZstdCompressor(level=LEVEL, dict_data=trained, write_content_size=True)
        self.out, self.records, self.at = fs.open_output_stream(path, compression=None), 0, len(raw) + 8
        self.out.write(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
        for data in self.held:
            self.write(data)
        self.held, self.held_bytes = [], 0

    def write(self, data: bytes) -> None:
        packed = self.packer.compress(data)
        self.out.write(packed)
        self.records += 1
        self.at += len(packed)
        if self.at >= FILE_BYTES:
            self.close()

    def close(self) -> None:
        if self.out is None and self.held:
            self.open()
        if self.out is not None:
            self.out.close()
            self.done.append((self.name, self.records, self.at))
            self.out, self.seq = None, self.seq + 1


def mark_revisits(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_PAYLOAD) -> DataFrame:
    """(page_id, url, payload, digest, revisit, refers_to) of each row.

    Counts by digest are combined before the shuffle, and only digests seen twice or more take part in the
    join, which Spark can split for a hot digest.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.encode(F.coalesce(html_col, F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    long = rows.where(F.octet_length("payload") >= least)
    groups = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("_digest"), "first")
    joined = rows.join(groups, F.col("digest") == F.col("_digest"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_warc(pages: DataFrame, *, date: str = "2024-01-01T00:00:00Z", **columns) -> DataFrame:
    """Archive every row; returns the manifest (path, records, bytes).

    Null html is an empty payload.  Of records with one payload of LEAST_PAYLOAD bytes or more, those with
    the smallest page_id are responses (rows repeated under that id all are) and the rest revisit it; a
    null page_id comes last, and if a payload has no other, its records are responses.  An empty table
    writes no file.  Other columns are ignored.
    """
    marked, folder = mark_revisits(pages, **columns), new_path(pages.sparkSession, "warc")

    def write(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        out = Writer(folder, TaskContext.get().partitionId())
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                for page_id, url, payload, digest, revisit, first in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    out.add(record(page_id, url, payload, digest, first, revisit, date))
        out.close()
        columns = list(zip(*out.done, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "records", "bytes"])

    return store(marked.mapInArrow(write, "path string, records long, bytes long"), "warc-manifest")


def read_file(f) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, content) of each record of an open archive, one frame in memory at a time."""
    import zstandard as z

    magic, size = struct.unpack("<II", f.read(8))
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    opener, rest = z.ZstdDecompressor(dict_data=z.ZstdCompressionDict(f.read(size))), b""
    while True:
        frame, data = opener.decompressobj(), []
        if not rest and not (rest := f.read(1 << 16)):
            return
        while True:
            data.append(frame.decompress(rest))
            if frame.eof:
                rest = frame.unused_data
                break
            if not (rest := f.read(1 << 16)):
                raise ValueError("cut record")
        head, _, body = b"".join(data).partition(b"\r\n\r\n")
        version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines)
        n = int(headers["Content-Length"])
        if version != "WARC/1.1" or len(body) != n + 4:
            raise ValueError("damaged record")
        yield headers, body[:n]


def read_warc(manifest: DataFrame) -> DataFrame:
    """One row a record, read from the archives; a response's length and digest are taken from its payload.

    Null page ids and urls come back null, repeated pages each have their record, an empty payload is a response of
    no bytes; an empty manifest gives no row.  Payloads are read one at a time, however long.
    """

    def read(batches) -> Iterator:
        import pyarrow as pa

        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        names = [x.split()[0] for x in READ.split(", ")]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        number = lambda x: None if x is None else int(x)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, p = file_system(path)
                rows = []
                with fs.open_input_stream(p, compression=None) as f:
                    for head, body in read_file(f):
                        kind, said = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:")
                        if kind == "response" and hashlib.sha256(body).hexdigest() != said:
                            raise ValueError("payload differs from its digest")
                        size = len(body) if kind == "response" else int(head["X-Payload-Length"])
                        rows.append((number(head.get("X-Page")), size, said, kind, number(head.get("X-Refers-To-Page")), head.get("WARC-Target-URI")))
                        if len(rows) >= 2048:
                            yield pack(rows)
                            rows = []
                if rows:
                    yield pack(rows)

    return manifest.select("path").repartition(max(1, min(4096, manifest.count())), "path").mapInArrow(read, READ)

"""Token ids as length-delimited binary records with masked checksums and a separate offset index.

Data file (``.rec``), all numbers little-endian::

    record  := length u64 | masked crc32 of those 8 bytes u32 | payload | masked crc32 of the payload u32
    payload := has_id u8 | doc_id i64 | width u8 (2 or 4) | ids (unsigned, ``width`` bytes each)

    mask(c) := (rotate right by 15 bits of c) + 0xA282EAD8, modulo 2**32

Index file (``.idx``): one ``offset u64 | ids u64`` entry for each record, so a reader can fetch records
in any order without scanning the data.

Rows are dealt out by range of ``doc_id``; each task writes its own files and one manifest row a file.
A document's global start is the total of all earlier files plus its place in its own, so no task ever
sees more than one range.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import file_system, new_path, store
from .tokenizing import encoder

MASK_DELTA = 0xA282EAD8  # fixed value of the format
FILE_BYTES = 64 << 20
MANIFEST = "part int, seq int, path string, records long, ids long, bytes long"
READ = "path string, record long, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids) -> bytes:
    """One framed record; ``ids`` is array('I')."""
    import numpy as np

    values = np.frombuffer(ids, "<u4") if len(ids) else np.zeros(0, "<u4")
    width = 2 if not len(values) or values.max() < 65536 else 4
    payload = struct.pack("<BqB", doc_id is not None, doc_id or 0, width) + values.astype(f"<u{width}").tobytes()
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(zlib.crc32(head))), payload, struct.pack("<I", masked(zlib.crc32(payload)))))


def unframe(payload: bytes):
    """(doc_id, ids as numpy u4) of a payload."""
    import numpy as np

    has_id, doc_id, width = struct.unpack_from("<BqB", payload)
    return (doc_id if has_id else None), np.frombuffer(payload, f"<u{width}", offset=10).astype("<u4")


def read_record(f) -> bytes | None:
    """The next record's payload, its checksums verified; None at the end of the file."""
    head = f.read(12)
    if not head:
        return None
    if len(head) < 12 or struct.unpack_from("<I", head, 8)[0] != masked(zlib.crc32(head[:8])):
        raise ValueError("damaged record length")
    size = struct.unpack_from("<Q", head)[0]
    body = f.read(size + 4)
    if len(body) < size + 4 or struct.unpack_from("<I", body, size)[0] != masked(zlib.crc32(body[:size])):
        raise ValueError("damaged record payload")
    return body[:size]


class Writer:
    """Record files of bounded size in one folder, each with its index."""

    def __init__(self, folder: str, part: int):
        self.folder, self.part, self.seq, self.done, self.out = folder, part, 0, [], None

    def add(self, doc_id: int | None, ids) -> None:
        if self.out is None:
            self.name = f"{self.folder}/part-{self.part:05d}-{self.seq:04d}-{uuid.uuid4().hex[:12]}"
            self.fs, path = file_system(self.name)
            self.fs.create_dir(path.rpartition("/")[0], recursive=True)
            self.path, self.out, self.index, self.ids, self.at = path, self.fs.open_output_stream(f"{path}.rec", compression=None), [], 0, 0
        record = frame(doc_id, ids)
        self.out.write(record)
        self.index.append(struct.pack("<QQ", self.at, len(ids)))
        self.at += len(record)
        self.ids += len(ids)
        if self.at >= FILE_BYTES:
            self.close()

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        with self.fs.open_output_stream(f"{self.path}.idx", compression=None) as f:
            f.write(b"".join(self.index))
        self.done.append((self.part, self.seq, self.name, len(self.index), self.ids, self.at))
        self.out, self.seq = None, self.seq + 1


def write_records(docs: DataFrame, vocabulary: str, *, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and write record files in ascending ``id_col`` order; returns the manifest.

    Null texts count as empty (their record holds just the end id); null ids come first and stay null;
    rows that share an id are ordered by a hash of their text, and equal rows are interchangeable.  An
    empty table writes no file.  Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    folder = new_path(spark, "records")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")

    def write(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        enc, out = encoder(vocabulary), Writer(folder, TaskContext.get().partitionId())
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = enc.ids(text)
                    if end_id is not None:
                        ids.append(end_id)
                    out.add(doc_id, ids)
        out.close()
        enc.trim()
        names = ["part", "seq", "path", "records", "ids", "bytes"]
        types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        columns = list(zip(*out.done, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return store(ordered.mapInArrow(write, MANIFEST), "records-manifest")


def read_records(manifest: DataFrame) -> DataFrame:
    """Every record of the manifest's files, read and verified: its global start, length and checksum of ids.

    Null ids come back null and repeated ones each; a document without words has its end id alone; an empty
    manifest gives no row; records are read one at a time, however long.  A damaged file raises.
    """
    spark = manifest.sparkSession
    starts = manifest.select("path", F.coalesce(F.sum("ids").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("file_start"))
    spread = starts.repartition(max(1, min(4096, manifest.count())), "path")

    def read(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, p = file_system(path)
                rows = []
                with fs.open_input_stream(f"{p}.rec", compression=None) as f:
                    while (payload := read_record(f)) is not None:
                        doc_id, ids = unframe(payload)
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                        if len(rows) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def shuffled(manifest: DataFrame, seed: int) -> DataFrame:
    """Records in a seeded random order, fetched through the offset index: (slot, doc_id, ids).

    The index alone is shuffled: ``slot`` is a hash of file, offset and seed, and the rows come sorted by it.
    Each task then opens the files its slots name and seeks.  Null and repeated ids come as they are, once a
    record; an empty manifest gives no row.
    """
    spark: SparkSession = manifest.sparkSession

    def entries(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, p = file_system(path)
                with fs.open_input_stream(f"{p}.idx", compression=None) as f:
                    offsets = [o for o, _ in struct.iter_unpack("<QQ", f.read())]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(offsets), pa.string()), pa.array(offsets, pa.int64())], names=["path", "offset"])

    def fetch(batches) -> Iterator:
        import pyarrow as pa

        files: dict = {}
        for batch in batches:
            slots, paths, offsets = (c.to_pylist() for c in batch.columns)
            for slot, path, offset in zip(slots, paths, offsets, strict=True):
                if path not in files:
                    if len(files) >= 64:
                        files.pop(next(iter(files))).close()
                    fs, p = file_system(path)
                    files[path] = fs.open_input_file(f"{p}.rec")
                files[path].seek(offset)
                doc_id, ids = unframe(read_record(files[path]))
                yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int64()), pa.array([doc_id], pa.int64()), pa.array([ids.astype("i8")], pa.list_(pa.int64()))], names=["slot", "doc_id", "ids"])
        for f in files.values():
            f.close()

    index = manifest.select("path").repartition(max(1, min(4096, manifest.count())), "path").mapInArrow(entries, "path string, offset long")
    slots = index.select(F.xxhash64("path", "offset", F.lit(seed)).alias("slot"), "path", "offset")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return slots.repartitionByRange(n, "slot", "path", "offset").sortWithinPartitions("slot", "path", "offset").mapInArrow(fetch, "slot long, doc_id long, ids array<long>")

"""Token ids in files of length-delimited binary records, with an offset index for reads in any order.

A record file is a sequence of frames:

    length of the payload, unsigned 64-bit | masked checksum of those 8 bytes, unsigned 32-bit
    payload: 1 byte (1: has an id, 0: none), 1 byte (bytes per token id: 2 or 4), id, signed 64-bit, then token ids, unsigned
    masked checksum of the payload, unsigned 32-bit | one line feed

All numbers are little-endian. A checksum is CRC-32, rotated right by 15 bits plus 0xA282EAD8 modulo 2^32, so that a
checksum stored inside checked data does not weaken the check. Spark's own file writer commits the files, so a task
that is run again leaves no second copy.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import map_arrow
from .tokens import encoder
from .words import slices

HEAD, OWNER, SUM = struct.Struct("<QI"), struct.Struct("<BBq"), struct.Struct("<I")
INDEX = "doc_id long, shard long, file string, offset long, n_bytes long, shard_start long, n_tokens long, ids_crc32 long"
#: Text bytes meant for one file; a file is read by one task.
FILE_BYTES = 16 << 20


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int = 4) -> bytes:
    """One record; ``ids`` are unsigned 32-bit, stored in ``width`` bytes each, which must hold them."""
    if width == 2:
        ids = np.frombuffer(ids, "<u4").astype("<u2").tobytes()
    payload = OWNER.pack(doc_id is not None, width, doc_id or 0) + ids
    size = struct.pack("<Q", len(payload))
    return size + SUM.pack(masked_crc(size)) + payload + SUM.pack(masked_crc(payload)) + b"\n"


def frames(data: memoryview, file: str = "") -> Iterator[tuple[int, int, int | None, bytes]]:
    """Offset, size, id and ids (unsigned 32-bit) of each frame; ValueError if a length or a checksum is wrong."""
    at = 0
    while at < len(data):
        if at + HEAD.size > len(data):
            raise ValueError(f"{file}: cut off at byte {at}")
        size, check = HEAD.unpack_from(data, at)
        begin, end = at + HEAD.size, at + HEAD.size + size
        if masked_crc(data[at:at + 8]) != check or end + SUM.size + 1 > len(data):
            raise ValueError(f"{file}: wrong length at byte {at}")
        payload = data[begin:end]
        if masked_crc(payload) != SUM.unpack_from(data, end)[0]:
            raise ValueError(f"{file}: wrong checksum at byte {at}")
        has, width, owner = OWNER.unpack_from(payload)
        ids = np.frombuffer(payload[OWNER.size:], f"<u{width}").astype("<u4").tobytes()
        yield at, end + SUM.size + 1 - at, owner if has else None, ids
        at = end + SUM.size + 1


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Writes ``path/records``, frames in ascending doc_id order over the files' names, and ``path/index``.

    ``end_id`` follows each document's ids. A null text has only that id; a null doc_id comes first; rows of the same
    doc_id follow their text's hash, equal rows are interchangeable. Other columns are not read. A text of any length
    is one record. The index is a Parquet table made from the files as written, so it holds what can be read.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = rows.withColumn("__tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(max(1, -(-total // file_bytes)), "doc_id", "__tie").sortWithinPartitions("doc_id", "__tie")
    end = struct.pack("<I", end_id)

    def run(batches):
        encode = encoder(tokenizer).encode
        width = 2 if max(encoder(tokenizer).vocabulary - 1, end_id) < 1 << 16 else 4
        for batch in batches:
            for part in slices(batch):
                ids = encode(part.column("text"))
                made = [frame(d, i + end, width) for d, i in zip(part.column("doc_id").to_pylist(), ids, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["value"])

    framed = map_arrow(rows, run, "value binary")
    # The text writer puts the bytes of a string and a line feed; the frame's own line feed is left to it.
    framed.select(F.expr("cast(substring(value, 1, octet_length(value) - 1) AS string)").alias("value")).write.text(f"{path}/records", lineSep="\n")
    scan(spark, path).write.parquet(f"{path}/index")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """The index, read from the record files, every length and checksum verified."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/records").select("path", "content")

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column("path"), batch.column("content"), strict=True):
                name = file.as_py()
                shard = int(unquote(name).rsplit("/part-", 1)[1].split("-")[0])
                rows, start = [], 0
                for offset, size, owner, ids in frames(memoryview(content.as_buffer()), name):
                    rows.append((owner, shard, name, offset, size, start, len(ids) // 4, zlib.crc32(ids)))
                    start += len(ids) // 4
                columns = list(zip(*rows, strict=True)) or [[]] * 8
                kinds = [pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in INDEX.split(", ")])

    return map_arrow(files, run, INDEX)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The offset index with ``start``: ids of all records before, over all files in order."""
    index = spark.read.schema(INDEX).parquet(f"{path}/index")
    # One row per file.
    sizes = sorted((r[0], r[1]) for r in index.groupBy("shard").agg(F.sum("n_tokens")).collect())
    starts, at = [], 0
    for shard, n in sizes:
        starts.append((shard, at))
        at += n
    starts = spark.createDataFrame(starts, "shard long, __start long")
    return index.join(F.broadcast(starts), "shard").withColumn("start", F.col("__start") + F.col("shard_start")).drop("__start")


def read_shuffled(spark: SparkSession, path: str, seed: int) -> DataFrame:
    """doc_id and ids (array<long>) of all records in an order that the seed decides, each read by its offset."""
    from pyarrow import fs

    place = F.xxhash64(F.lit(seed), "shard", "offset")
    index = read_index(spark, path).select("file", "offset", "n_bytes", place.alias("place"))
    rows = index.repartitionByRange("place", "file", "offset").sortWithinPartitions("place", "file", "offset")

    def run(batches):
        opened = {}
        for batch in batches:
            owners, ids = [], []
            for file, offset, size in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "n_bytes")), strict=True):
                if file not in opened:
                    if len(opened) >= 64:
                        opened.pop(next(iter(opened))).close()
                    system, at = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", file))
                    opened[file] = system.open_input_file(at)
                (_, _, owner, found), = frames(memoryview(opened[file].read_at(size, offset)), file)
                owners.append(owner)
                ids.append(np.frombuffer(found, "<u4").astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return map_arrow(rows, run, "doc_id long, ids array<long>")

"""Token ids in binary record files with an offset index.

A shard is a file of frames, nothing before, between or after them::

    u64 length | u32 masked crc32 of these 8 bytes | payload | u32 masked crc32 of the payload

all little-endian; a checksum c is masked as ((c >> 15 | c << 17) + 0xA282EAD8)
modulo 2**32, so that checksums of data that holds checksums stay strong.  The
payload is u8 bytes per id, u8 whether there is a doc_id, i64 doc_id, and the
ids as little-endian unsigned integers.

Shards hold ascending doc_id ranges in the order of their numbers.  The offset
index is a Parquet table apart, with one row for each record: it allows reading
records in any order by seeks, and it is also the commit log: a file that a
lost or repeated task left behind isn't in it.  Shards are written and read by
the executors through pyarrow's file systems (file, hdfs, s3, gs URIs).
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from lattica.llm.bpe import ByteBpe
from lattica.llm.workers import map_batches, pieces
from lattica.plans.storage import fresh_path, stored

_HEAD, _META, _CRC = "<QI", "<BBq", "<I"
_HEAD_SIZE, _META_SIZE, _CRC_SIZE = map(struct.calcsize, (_HEAD, _META, _CRC))
#: Bytes gathered before a write, and bytes asked for by a read.
_CHUNK = 4 << 20

INDEX = pa.schema([("shard", pa.int32()), ("ordinal", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64())])
INDEX_DDL = "shard int, ordinal long, file string, offset long, length long, doc_id long, n_tokens long"
READ = pa.schema([("shard", pa.int32()), ("ordinal", pa.int64()), ("doc_id", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
READ_DDL = "shard int, ordinal long, doc_id long, before long, n_tokens long, ids_crc32 long"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = len(payload).to_bytes(8, "little")
    return b"".join((length, struct.pack(_CRC, masked(length)), payload, struct.pack(_CRC, masked(payload))))


def unframe(data: memoryview | bytes, at: int) -> tuple[bytes, int] | None:
    """(payload, next offset) of the frame at ``at``; None if ``data`` ends within it.  ValueError if it is damaged."""
    if len(data) < at + _HEAD_SIZE:
        return None
    n, c = struct.unpack_from(_HEAD, data, at)
    if masked(bytes(data[at : at + 8])) != c:
        raise ValueError(f"length at {at} is damaged")
    end = at + _HEAD_SIZE + n
    if len(data) < end + _CRC_SIZE:
        return None
    payload = bytes(data[at + _HEAD_SIZE : end])
    if masked(payload) != struct.unpack_from(_CRC, data, end)[0]:
        raise ValueError(f"record at {at} is damaged")
    return payload, end + _CRC_SIZE


def frame_size(data: bytes) -> int:
    """Of the frame that ``data`` begins with: all of it, or of its head if that is all that is sure."""
    return _HEAD_SIZE + struct.unpack_from(_HEAD, data)[0] + _CRC_SIZE if len(data) >= _HEAD_SIZE else _HEAD_SIZE


def parse(payload: bytes) -> tuple[int | None, np.ndarray]:
    width, has_id, doc_id = struct.unpack_from(_META, payload)
    return (doc_id if has_id else None), np.frombuffer(payload, f"<u{width}", offset=_META_SIZE)


def _writer(folder: str, tokenizer: str, end_id: int):
    def run(batches):
        shard = TaskContext.get().partitionId()
        bpe = ByteBpe.of(tokenizer)
        end = np.array([end_id], bpe.dtype).tobytes()
        name = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.rec"
        store, path = fs.FileSystem.from_uri(name)
        out, held, at, ordinal = None, [], 0, 0
        for piece in pieces(batches, _CHUNK):
            rows = []
            for doc_id, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()):
                ids = bpe.encode(text or "") + end
                record = frame(struct.pack(_META, bpe.dtype.itemsize, doc_id is not None, doc_id or 0) + ids)
                rows.append((shard, ordinal, name, at, len(record), doc_id, len(ids) // bpe.dtype.itemsize))
                held.append(record)
                at += len(record)
                ordinal += 1
            if rows:
                if out is None:
                    store.create_dir(path.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(path)
                for record in held:
                    out.write(record)
                held = []
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), INDEX)], schema=INDEX)
        if out is not None:
            out.close()

    return run


def write_records(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Encode every text, append ``end_id``, write shards in ascending doc_id order; returns the stored offset index.

    ``tokenizer`` is the path of a byte-level BPE file of the tokenizers
    library, used without added special tokens (a special token's string inside
    a text is read as the library reads it by default).  A null or empty text is
    a record of the end id alone.  Rows without a doc_id come first; rows of one
    doc_id are ordered by a hash (xxhash64) of their text, so that they can be spread over
    shards; only rows alike in id and text stay together.  Other columns are ignored.  An empty table makes no
    shard and an empty index.
    """
    folder = folder or fresh_path(docs.sparkSession, "records")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = ["doc_id", F.xxhash64("text"), "text"]
    ordered = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    return stored(map_batches(ordered, _writer(folder, tokenizer, end_id), INDEX_DDL), "records-index")


def _crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _scan(batches):
    """Reads whole shards, in chunks, checking every frame."""
    for batch in batches:
        for shard, name in zip(batch.column("shard").to_pylist(), batch.column("file").to_pylist()):
            store, path = fs.FileSystem.from_uri(name)
            held, rows, before, ordinal, at = bytearray(), [], 0, 0, 0
            with store.open_input_stream(path) as source:
                while True:
                    got = unframe(held, at)
                    if got is not None:
                        payload, at = got
                        doc_id, ids = parse(payload)
                        rows.append((shard, ordinal, doc_id, before, len(ids), _crc_of(ids)))
                        before += len(ids)
                        ordinal += 1
                        continue
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), READ)], schema=READ)
                        rows = []
                    del held[:at]
                    at = 0
                    # of a long record all that is missing at once
                    more = source.read(max(_CHUNK, frame_size(held) - len(held)))
                    if not more:
                        break
                    held += more
            if held:
                raise ValueError(f"{name} ends within a record")


def read_shards(index: DataFrame) -> DataFrame:
    """Sequential read of all shards of an index: doc_id, start, n_tokens, ids_crc32, in file order by start."""
    spark = index.sparkSession
    shards = index.groupBy("shard", "file").agg(F.sum("n_tokens").alias("tokens"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    read = map_batches(shards.select("shard", "file").repartition(n, "file"), _scan, READ_DDL)
    # one row for each shard: a short table, whatever the number of documents
    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = shards.select("shard", F.coalesce(F.sum("tokens").over(upto), F.lit(0)).alias("base"))
    return read.join(F.broadcast(bases), "shard").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def _seek(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    for batch in batches:
        found, kept = [], {}
        for name, at, n in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
            if name not in kept:
                if len(kept) > 64:
                    kept.popitem()[1].close()
                store, path = fs.FileSystem.from_uri(name)
                kept[name] = store.open_input_file(path)
            found.append(parse(unframe(kept[name].read_at(n, at), 0)[0]))
        for f in kept.values():
            f.close()
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([x.astype(np.int32) for _, x in found], pa.list_(pa.int32()))], schema=schema)


def read_records(index: DataFrame) -> DataFrame:
    """(doc_id, ids) of the records that ``index`` lists, in whatever order it lists them."""
    return map_batches(index.select("file", "offset", "length"), _seek, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the records, then read every shard back; see :func:`write_records` and :func:`read_shards`."""
    return read_shards(write_records(docs, tokenizer, end_id))

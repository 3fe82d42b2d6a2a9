"""WARC archives: writing with segmentation and revisits, reading with segment reassembly.

Records are gzip members of their own.  A record whose block is longer than a
segment is cut: the first segment keeps the record's type, the others are
continuation records that name the origin's record id and their number, and the
last one also states the total length.  Payloads travel in HTTP responses with
chunked transfer framing.

Reading takes archives in any order, with the segments of one record anywhere:
continuations are grouped by origin id in Spark, ordered by number, checked
against the total length and then decoded.  Only cut records are shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lattica.llm.workers import map_batches
from lattica.plans.storage import fresh_path, stored

#: Bytes of a block in one record, bytes of a chunk of the transfer framing, bytes read at once.
SEGMENT, CHUNK, READ = 16_384, 4_096, 1 << 20
#: Payloads from this size on are written once.
REVISIT_FROM = 1_000
_DATE = "2024-01-01T00:00:00Z"
#: Tasks that rows of one payload are spread over when they meet its other facts.
SALTS = 8


def encode_chunked(body: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(body[i : i + size]), body[i : i + size]) for i in range(0, len(body), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def decode_chunked(data: bytes) -> bytes:
    """The body of chunked framing; chunk extensions and trailers are skipped.  ValueError if it is cut short or malformed."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size is missing")
        n = int(data[at:end].split(b";")[0].strip(), 16)
        if n == 0:
            break
        at = end + 2
        if data[at + n : at + n + 2] != b"\r\n":
            raise ValueError("chunk is cut short")
        out.append(data[at : at + n])
        at += n + 2
    return b"".join(out)


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    clean = lambda v: str(v).replace("\r", "%0D").replace("\n", "%0A")
    head = "".join(f"{k}: {clean(v)}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    pack = zlib.compressobj(1, wbits=31)
    return pack.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + pack.flush()


def segments(fields: list[tuple[str, object]], block: bytes, size: int) -> list[bytes]:
    """The record, or its segments if its block is longer than ``size``."""
    if len(block) <= size:
        return [record(fields, block)]
    parts = [block[i : i + size] for i in range(0, len(block), size)]
    origin = dict(fields)["WARC-Record-ID"]
    out = [record([*fields, ("WARC-Segment-Number", 1)], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", _DATE), ("WARC-Segment-Origin-ID", origin), ("WARC-Segment-Number", n)]
        out.append(record([*own, ("WARC-Segment-Total-Length", len(block) if n == len(parts) else None)], part))
    return out


def _prepare(batches):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("n", pa.int64()), ("packed", pa.binary())])
    pack = zstandard.ZstdCompressor(1)
    for batch in batches:
        bodies = [b or b"" for b in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([
            batch.column("page_id"), batch.column("url"), pa.array([hashlib.sha1(b).hexdigest() for b in bodies], pa.string()),
            pa.array([len(b) for b in bodies], pa.int64()), pa.array([pack.compress(b) for b in bodies], pa.binary()),
        ], schema=schema)


def _writer(folder: str, segment: int):
    schema = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(batches):
        name = f"{folder}/pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        store, path = fs.FileSystem.from_uri(name)
        out, records, size = None, 0, 0
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for page_id, url, digest, packed, top in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "packed", "top"))):
                if out is None:
                    store.create_dir(path.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(path)
                again = top is not None and top != page_id
                fields = [("WARC-Type", "revisit" if again else "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", _DATE), ("WARC-Target-URI", url), ("WARC-Page-ID", page_id),
                          ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()), ("Content-Type", "application/http;msgtype=response")]
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                if again:
                    fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Page-ID", top)]
                    block = head + b"\r\n"
                else:
                    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + encode_chunked(unpack.decompress(packed))
                for part in segments(fields, block, segment):
                    out.write(part)
                    records, size = records + 1, size + len(part)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records]), pa.array([size])], schema=schema)

    return run, "file string, records long, bytes long"


def _salted(rows: DataFrame, facts: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """``rows`` left-joined with ``facts`` (one light row for a key): a hot key's rows go to SALTS tasks by their columns ``by``."""
    spread = rows.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))
    copies = facts.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return spread.join(copies, [*keys, "_salt"], "left").drop("_salt")


def write_archives(pages: DataFrame, segment: int = SEGMENT, folder: str | None = None) -> DataFrame:
    """Write one record for each row of ``pages`` (page_id, url, html); returns the stored list of files.

    The payload is the html in UTF-8 (null: empty).  Of rows with equal payloads
    of at least 1000 bytes, those with the largest page_id are responses and
    the others revisit it; a row without page_id is never referred to, and if no
    row of such a group has one all are responses.  A null url is left out.
    Repeated rows are records of their own: of a group's largest page_id all
    are responses.  A page_id may stand on several payloads.  Other columns are
    ignored, whatever their names.  An html of any length is cut into segments; the
    writer holds one page at a time.  An empty table makes no file.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    body = F.coalesce("html", F.lit(""))
    long = F.octet_length(body) >= REVISIT_FROM
    keys = own.where(long).select("page_id", F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).cast("long").alias("n"))
    tops = keys.groupBy("digest", "n").agg(F.max("page_id").alias("top"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    ready = lambda rows: map_batches(rows.withColumn("html", body.cast("binary")), _prepare, "page_id long, url string, digest string, n long, packed binary")
    run, schema = _writer(folder or fresh_path(pages.sparkSession, "warc"), segment)
    # short pages can't be revisits: they are written where they are read
    rows = _salted(ready(own.where(long)), tops, ["digest", "n"], ["page_id", "url"]).unionByName(ready(own.where(~long)).withColumn("top", F.lit(None).cast("long")))
    return stored(map_batches(rows.select("page_id", "url", "digest", "packed", "top"), run, schema), "warc-files")


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:] if line)}


def read_records(source):
    """(fields, block) of every record of a stream of gzip members, holding one record at a time."""
    data, done = b"", False
    while True:
        pack = zlib.decompressobj(wbits=31)
        parts = []
        while not pack.eof:
            if not data:
                data = source.read(READ)
                if not data:
                    if parts:
                        raise ValueError("archive ends within a record")
                    done = True
                    break
            parts.append(pack.decompress(data))
            data = pack.unused_data if pack.eof else b""
        if done:
            return
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        fields = parse_head(head)
        n = int(fields["content-length"])
        if len(rest) < n:
            raise ValueError("block is cut short")
        yield fields, rest[:n]


def payload_of(block: bytes) -> bytes:
    """The body of an HTTP message, freed of chunked framing."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}
    return decode_chunked(body) if b"chunked" in fields.get(b"transfer-encoding", b"") else body


_COLUMNS = [("record_id", pa.string()), ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("stated", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("block", pa.binary())]
_DDL = "record_id string, origin string, number int, total long, record_type string, page_id long, refers_to long, stated string, payload_bytes long, payload_digest string, block binary"


def _stated(fields: dict) -> str | None:
    kind, _, value = fields.get("warc-payload-digest", "").partition(":")
    return base64.b32decode(value).hex() if kind == "sha1" else None


def _read(batches):
    schema = pa.schema(_COLUMNS)
    number = lambda f, k: int(f[k]) if k in f else None
    for batch in batches:
        for name in batch.column("file").to_pylist():
            store, path = fs.FileSystem.from_uri(name)
            with store.open_input_stream(path) as source:
                rows, size = [], 0
                for f, block in read_records(source):
                    cut = "warc-segment-number" in f
                    row = [f["warc-record-id"], f.get("warc-segment-origin-id", f["warc-record-id"]) if cut else None, number(f, "warc-segment-number"), number(f, "warc-segment-total-length"), f["warc-type"], number(f, "warc-page-id"), number(f, "warc-refers-to-page-id"), _stated(f), None, None, block if cut else None]
                    if not cut and f["warc-type"] == "response":
                        body = payload_of(block)
                        row[8:10] = len(body), hashlib.sha1(body).hexdigest()
                    rows.append(row)
                    size += len(block) if cut else 200
                    if size > READ:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _COLUMNS)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _COLUMNS)], schema=schema)


def join_segments(parts: list[dict]) -> bytes:
    """The block of one record from its segments in any order.  ValueError unless all are there and the length is as stated."""
    parts = sorted(parts, key=lambda p: p["number"])
    if [p["number"] for p in parts] != list(range(1, len(parts) + 1)):
        raise ValueError(f"segments {[p['number'] for p in parts]} aren't 1 to {len(parts)}")
    block = b"".join(p["block"] for p in parts)
    if parts[-1]["total"] != len(block):
        raise ValueError(f"{len(block)} bytes, but the last segment states {parts[-1]['total']}")
    return block


def _reassemble(batches):
    columns = [*_COLUMNS[4:10], ("problem", pa.string())]
    schema = pa.schema(columns)
    for batch in batches:
        rows = []
        for parts in batch.column("parts").to_pylist():
            first = min(parts, key=lambda p: p["number"])
            row = [first["record_type"], first["page_id"], first["refers_to"], first["stated"], None, None, None]
            try:
                body = payload_of(join_segments(parts))
                row[4:6] = len(body), hashlib.sha1(body).hexdigest()
            except ValueError as e:
                row[6] = str(e)
            rows.append(row)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), columns)], schema=schema)


def read_archives(files: DataFrame) -> DataFrame:
    """Read archives listed in column ``file``.

    Returns a row for each logical record: page_id, payload_bytes,
    payload_digest (lower-case hex SHA-1), record_type, refers_to and problem.
    For revisits bytes and digest are those of the response they refer to.  A record whose segments
    are incomplete, of a wrong total length or badly framed, or whose payload doesn't have the
    digest its header states, gets the reason in ``problem`` instead of failing
    the job; a damaged archive fails it.  A revisit refers to the response with
    that page_id and its own stated digest, so a page_id may stand on several
    payloads.  Repeated records give a row each.  An archive is streamed; a reader holds one record
    at a time, and a cut record is joined in one task.  No files give no rows;
    other columns of ``files`` are ignored.
    """
    spark = files.sparkSession
    read = map_batches(files.select("file").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file"), _read, _DDL)
    read = stored(read, "warc-records")
    names = ["record_type", "page_id", "refers_to", "stated", "payload_bytes", "payload_digest"]
    whole = read.where("origin is null").select(*names, F.lit(None).cast("string").alias("problem"))
    part = F.struct("number", "total", "record_type", "page_id", "refers_to", "stated", "block")
    joined = read.where("origin is not null").groupBy("origin").agg(F.collect_list(part).alias("parts")).select("parts")
    rows = whole.union(map_batches(joined, _reassemble, "record_type string, page_id long, refers_to long, stated string, payload_bytes long, payload_digest string, problem string"))
    wrong = (F.col("payload_digest") != F.col("stated")) & F.col("problem").isNull()
    rows = rows.withColumn("problem", F.when(wrong, F.lit("digest differs from the stated one")).otherwise(F.col("problem")))
    kept = rows.where("record_type <> 'revisit'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")
    facts = kept.where("record_type = 'response' and page_id is not null and payload_digest is not null")
    targets = facts.groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("stated")).agg(F.max("payload_bytes").alias("payload_bytes"))
    again = _salted(rows.where("record_type = 'revisit'").select("page_id", "refers_to", "stated", "record_type"), targets, ["refers_to", "stated"], ["page_id"])
    lost = F.when(F.col("payload_bytes").isNull(), F.lit("response is missing"))
    found = F.when(F.col("payload_bytes").isNotNull(), F.col("stated"))
    return kept.union(again.select("page_id", "payload_bytes", found.alias("payload_digest"), "record_type", "refers_to", lost.alias("problem")))


def round_trip(pages: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Write ``pages`` to archives and read them back; see :func:`write_archives` and :func:`read_archives`."""
    return read_archives(write_archives(pages, segment))

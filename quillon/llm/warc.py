"""WARC archives: a writer, and a splittable reader.

Writer: one gzip member per record, members one after another, written by
Spark's text writer (the separator between rows is an empty gzip member, which
every reader skips), so archives may lie on any file system.

Reader: the text source with the gzip magic as line separator gives each task
byte ranges cut at every magic; a range owns the records whose magic starts
inside it, read to their end.  A magic is only a candidate: its member must
decompress to a WARC version line, and one that occurs inside compressed data
is put back into the record around it.  Where such a false magic hides the end
of a record behind the end of a range, the pieces of both ranges are joined
afterwards; that is rare, so little is moved.

Duplicates: of records with equal payloads of ``least_bytes`` or more, the one
with the smallest id is a response and others revisit it.

Defined results: a null payload is empty; a null id is always a response; rows
of equal id and payload have the same type; a null URL leaves out the target;
bytes that belong to no valid member are skipped, and so are records without a
version line or a length that fits, and those of more than ``MOST_RECORD_BYTES``
decompressed; an empty table gives no
archive and no record; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, materialized

MAGIC = b"\x1f\x8b\x08"
#: A gzip member of nothing.
NOTHING = gzip.compress(b"", 9, mtime=0)
ROW_BYTES = 4 << 20
#: A member that grows beyond it is no record: a value of Spark holds less than 2 GB.
MOST_RECORD_BYTES = 1 << 30
# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

RECORD = "record_type string, record_id string, refers_to string, target_uri string, payload_bytes long, payload_digest string, payload binary"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(record_id: str, url: str | None, payload: bytes, refers_to: str | None = None) -> bytes:
    """One record as a gzip member; with ``refers_to`` a revisit without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [VERSION, f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f-\x9f  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse(data: bytes) -> tuple | None:
    """A decompressed record as a row of RECORD, or None."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    length = fields.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", length) or int(length) > len(rest):
        return None
    block = rest[: int(length)]
    kind = fields.get("warc-type", "")
    http, _, payload = block.partition(b"\r\n\r\n")
    if not fields.get("content-type", "").startswith("application/http"):
        http, payload = b"", block
    stated = fields.get("warc-payload-digest", "").partition(":")[2] or None
    if kind == "revisit":
        length = re.search(rb"(?im)^content-length:\s*(\d{1,18})\b", http)
        n, found, payload = int(length[1]) if length else None, stated, None
    else:
        n, found = len(payload), digest(payload)
    strip = lambda k: fields[k].strip("<>") if k in fields else None
    return kind, strip("warc-record-id"), strip("warc-refers-to"), strip("warc-target-uri"), n, found, payload


class Assembler:
    """Puts the pieces between magics of one range together."""

    def __init__(self) -> None:
        self.open: zlib._Decompress | None = None
        self.raw: list[bytes] = []
        self.out: list[bytes] = []
        self.head = b""
        self.room = 0
        self.orphans: list[bytes] = []
        self.aligned = False  # a member of this range has ended
        self.found: list[bytes] = []  # records that came out of pieces tried again

    def feed(self, piece: bytes) -> bytes | None:
        """The decompressed record that ``piece`` (from a magic to before the next) completes, if any."""
        if self.open is None:
            self.open, self.raw, self.out, self.head, self.room = zlib.decompressobj(31), [], [], b"", MOST_RECORD_BYTES
        try:
            got = self.open.decompress(piece, self.room + 1)
        except zlib.error:
            return self._drop(piece)
        self.room -= len(got)
        if self.room < 0:
            return self._drop(piece)
        self.head = (self.head + got[:5])[:5]
        if not b"WARC/".startswith(self.head):
            return self._drop(piece)
        self.out.append(got)
        self.raw.append(piece)
        if not self.open.eof:
            return None
        whole, self.open, self.aligned = b"".join(self.out), None, True
        return whole or None

    def _drop(self, piece: bytes) -> None:
        """What can't be a member's start belongs to a record that began in an earlier range, or to nothing."""
        first, *later = [*self.raw, piece]  # a false start may have swallowed pieces: each of them is tried again
        self.open = None
        if not self.aligned:
            self.orphans.append(first)
        for again in later:
            self.found += [x for x in [self.feed(again)] if x]
        return None

    def tail(self) -> list[bytes]:
        """Pieces of a record that the range did not complete, or of what may be one."""
        return self.raw if self.open is not None else []


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> None:
    """A record per row of ``pages``, in archives under ``path``."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("i"), F.col(url_col).cast("string").alias("u"), payload.alias("p")).withColumn("h", F.sha1("p"))
    keys = rows.where(F.octet_length("p") >= least_bytes).select("i", "h")
    # Written, so that both sides of the join are dealt for it alone and AQE can split a payload that many pages share.
    first = materialized(keys.groupBy("h").agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "first"), "warc-first")
    revisits = keys.join(first, "h").where(F.col("i") != F.col("first")).distinct()
    # Joined by id and digest, so that payloads are dealt by page.
    rows = rows.join(revisits, ["i", "h"], "left").select("i", "u", "p", "first")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["m"])

        for batch in batches:
            for i, u, p, f in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                name = lambda x: f"urn:page:{'' if x is None else x}"
                held.append(record(name(i), u, p, None if f is None else name(f)))
                size += len(held[-1])
                if size >= ROW_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    out = rows.mapInArrow(members, "m binary").select(F.col("m").cast("string").alias("value"))
    out.write.option("encoding", "ISO-8859-1").option("lineSep", NOTHING.decode("ISO-8859-1")).text(path)


def read(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """The records of the archives under ``path``: columns RECORD.

    Ranges are as long as ``spark.sql.files.maxPartitionBytes`` says.
    """
    pieces = (
        spark.read.option("encoding", "ISO-8859-1")
        .option("lineSep", MAGIC.decode("ISO-8859-1"))
        .text(path)
        .select(F.col("value").cast("binary").alias("v"), "_metadata.file_path", "_metadata.file_block_start")
    )
    names = ["record_type", "record_id", "refers_to", "target_uri", "payload_bytes", "payload_digest", "payload", "file", "start", "part", "raw"]
    kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.binary())]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def row(data: bytes) -> tuple | None:
        found = parse(data)
        return found and (*found[:6], found[6] if keep_payload else None, None, None, None, None)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, fresh = None, Assembler(), True

        def leave() -> list[tuple]:
            # Part 0 goes on from the range before, and so does what follows it (1) unless a record has ended between (2).
            rest = [(0, state.orphans), (2 if state.aligned else 1, state.tail())]
            return [(*[None] * 7, *at, part, raw) for part, raw in rest if raw or part == 2]

        for batch in batches:
            rows = []
            for v, file, start in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (file, start) != at:
                    rows += leave() if at else []
                    at, state, fresh = (file, start), Assembler(), True
                if fresh and start == 0:  # what stands before the first magic of a file
                    fresh = False
                    continue
                fresh = False
                done = [state.feed(MAGIC + v), *state.found]
                state.found.clear()
                rows += [found for x in done if x and (found := row(x))]
            if rows:
                yield batch_of(rows)
        if at and (rows := leave()):
            yield batch_of(rows)

    schema = RECORD + ", file string, start long, part int, raw array<binary>"
    found = materialized(pieces.mapInArrow(assemble, schema), "warc-read")
    whole = found.where("file IS NULL").select(*names[:7])

    def stitch(pdf: pd.DataFrame) -> pd.DataFrame:
        state, rows = Assembler(), []
        for _, part, raw in sorted(zip(pdf.start, pdf.part, pdf.raw, strict=True), key=lambda x: x[:2]):
            if part == 2:
                state = Assembler()
            for piece in raw:
                done = [state.feed(bytes(piece)), *state.found]
                state.found.clear()
                rows += [found[:7] for x in done if x and (found := row(x))]
        return pd.DataFrame(rows, columns=names[:7])

    # Only what ranges left over: nothing, but for false magics at the end of a range.
    left = found.where("file IS NOT NULL").select("file", "start", "part", "raw")
    some = left.where(F.size("raw") > 0).select("file").distinct()
    joined = left.join(some, "file", "left_semi").groupBy("file").applyInPandas(stitch, RECORD)
    return whole.unionByName(joined)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and reads them back: a row per record, ids as written."""
    path = fresh_path(pages.sparkSession, "warc")
    write(pages, path, id_col, url_col, payload_col, least_bytes)
    kind = pages.schema[id_col].dataType
    number = lambda c: F.nullif(F.regexp_extract(c, "^urn:page:(.*)$", 1), F.lit("")).cast(kind)
    return read(pages.sparkSession, path, keep_payload=False).select(
        number("record_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "target_uri"
    )

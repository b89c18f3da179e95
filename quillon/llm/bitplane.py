"""Token ids in bit-plane shuffled binary shards.

A shard is ``QBP1``, its length, its place in the order, then chunks and two
indexes.  A chunk is a fixed-size block of ids, transposed into byte planes (or
bit planes), each plane compressed with zstandard on its own; the chunk index
has the offset, number of ids and plane lengths of each.  The document index
has the ids of the documents and their numbers of tokens, so that any document
is found without decoding what lies before it (``seek``, ``fetch``).

Shards are written by Spark's own text writer, one row a shard and the end mark
``QBPE`` as separator, and read with the ``binaryFile`` source: any file system
that Spark reaches will do, and no executor leaves a file of its own.  A file holds
at most ``SHARDS_PER_FILE`` shards, so that one value of the source stays far
below its limit of 2 GB.

Defined results: null and empty texts give the end id alone; rows of equal id
are kept, ordered by their text; a null id sorts first; an empty table gives no
shard; columns other than id and text are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, materialized, short_batches

BEGIN, END = b"QBP1", b"QBPE"
CHUNK_IDS = 1 << 16
SHARD_IDS = 4 << 20
SHARDS_PER_FILE = 64
#: Rows of one id are dealt by so many of their first characters as well.
PREFIX = 32
LEVEL = 3
#: Texts are encoded so many bytes at a time, of batches of so many rows: units that repeat in them are looked up once.
ENCODED_BYTES, ENCODED_ROWS = 6 << 20, 1536

_CHUNK = struct.Struct("<QI32I")
_SHARD = struct.Struct("<4sQqq")
_TAIL = struct.Struct("<QQQI")


# ---------------------------------------------------------------- planes


def to_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """A block of unsigned 32-bit ids as 4 byte planes or 32 bit planes."""
    rows = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [np.ascontiguousarray(rows[:, k]).tobytes() for k in range(4)]
    single = np.unpackbits(rows, axis=1, bitorder="little")
    return [np.packbits(single[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The ids of a block again."""
    if len(planes) == 4:
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).reshape(-1).view("<u4")
    single = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
    return np.packbits(single, axis=1, bitorder="little").reshape(-1).view("<u4")


def encode_shard(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int], place: tuple[int, int] = (0, 0), bits: bool = False, chunk_ids: int = CHUNK_IDS) -> bytes:
    """One shard.  ``place``: its partition and number there, by which shards are ordered."""
    pack = zstandard.ZstdCompressor(level=LEVEL).compress
    body, index, at = [], [], _SHARD.size
    for first in range(0, len(ids), chunk_ids):
        block = ids[first : first + chunk_ids]
        planes = [pack(p) for p in to_planes(block, bits)]
        index.append(_CHUNK.pack(at, len(block), *[len(p) for p in planes], *[0] * (32 - len(planes))))
        body += planes
        at += sum(map(len, planes))
    chunks = pack(b"".join(index))
    valid = np.array([d is not None for d in doc_ids], np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], "<i8")
    docs = pack(valid.tobytes() + numbers.tobytes() + np.array(lengths, "<u8").tobytes())
    tail = _TAIL.pack(len(chunks), len(docs), len(doc_ids), int(bits))
    whole = b"".join([*body, chunks, docs, tail])
    return _SHARD.pack(BEGIN, _SHARD.size + len(whole), *place) + whole


@dataclass
class Shard:
    """What the indexes of a shard say; blocks of ids are decoded when asked for."""

    data: memoryview
    place: tuple[int, int]
    doc_ids: list[int | None]
    lengths: np.ndarray
    bits: bool
    chunks: list[tuple]

    @classmethod
    def open(cls, data: memoryview) -> Shard:
        unpack = zstandard.ZstdDecompressor().decompress
        magic, size, *place = _SHARD.unpack_from(data)
        if magic != BEGIN:
            raise ValueError("not a shard")
        n_chunks, n_docs, count, bits = _TAIL.unpack_from(data, size - _TAIL.size)
        docs = unpack(data[size - _TAIL.size - n_docs : size - _TAIL.size])
        index = unpack(data[size - _TAIL.size - n_docs - n_chunks : size - _TAIL.size - n_docs])
        valid, numbers, lengths = np.frombuffer(docs, np.uint8, count), np.frombuffer(docs, "<i8", count, count), np.frombuffer(docs, "<u8", count, 9 * count)
        names = [int(d) if v else None for d, v in zip(numbers, valid, strict=True)]
        return cls(data, tuple(place), names, lengths.astype(np.int64), bool(bits), list(_CHUNK.iter_unpack(index)))

    def block(self, k: int) -> np.ndarray:
        """The ids of one chunk."""
        unpack = zstandard.ZstdDecompressor().decompress
        at, n, *sizes = self.chunks[k]
        planes = []
        for size in sizes[: 32 if self.bits else 4]:
            planes.append(unpack(self.data[at : at + size]))
            at += size
        return from_planes(planes, n)

    def blocks(self) -> Iterator[np.ndarray]:
        return map(self.block, range(len(self.chunks)))

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document, of which only the chunks that hold them are decoded."""
        first = int(self.lengths[:k].sum())
        last = first + int(self.lengths[k])
        ends = np.cumsum([n for _, n, *_ in self.chunks])
        some = range(int(np.searchsorted(ends, first, "right")), int(np.searchsorted(ends, last, "left")) + 1)
        if first == last:
            return np.zeros(0, "<u4")
        held = np.concatenate([self.block(c) for c in some])
        before = int(ends[some[0] - 1]) if some[0] else 0
        return held[first - before : last - before]


def shards_in(data: bytes) -> Iterator[Shard]:
    """The shards of a file."""
    view, at = memoryview(data), 0
    while at < len(view):
        _, size, *_ = _SHARD.unpack_from(view, at)
        yield Shard.open(view[at : at + size])
        at += size + len(END)


def seek(data: bytes, doc_id: int | None) -> Iterator[np.ndarray]:
    """The ids of each document of that id in a file of shards."""
    for shard in shards_in(data):
        for k, name in enumerate(shard.doc_ids):
            if name == doc_id:
                yield shard.document(k)


def documents_in(data: bytes) -> Iterator[tuple[tuple[int, int], int | None, int, np.ndarray]]:
    """(place of the shard, document id, its start in the shard, its ids) of a file of shards."""
    for shard in shards_in(data):
        blocks, held, start = shard.blocks(), np.zeros(0, "<u4"), 0
        for doc_id, n in zip(shard.doc_ids, shard.lengths.tolist(), strict=True):
            parts, have = [held], len(held)
            while have < n:
                parts.append(next(blocks))
                have += len(parts[-1])
            whole = np.concatenate(parts) if len(parts) > 1 else held
            held = whole[n:]
            yield shard.place, doc_id, start, whole[:n]
            start += n


# ---------------------------------------------------------------- encoding


def _white_space(raw: np.ndarray) -> np.ndarray:
    """Marks every byte of a character that any Unicode version takes for white space, and of few others."""
    out = _ASCII_SPACE[raw]
    for lead, follow in _WIDE_SPACE:
        at = np.flatnonzero(raw == lead)
        for k, some in enumerate(follow, 1):
            at = at[at + k < len(raw)]
            at = at[some[raw[at + k]]]
        for k in range(len(follow) + 1):
            out[at + k] = True
    return out


def _bytes_in(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for first, last in ranges:
        out[first : last + 1] = True
    return out


_ASCII_SPACE = _bytes_in((0x09, 0x0D), (0x1C, 0x20))
#: First byte, and those that may follow it.
_WIDE_SPACE = (
    (0xC2, (_bytes_in((0x85, 0x85), (0xA0, 0xA0)),)),
    (0xE1, (_bytes_in((0x9A, 0x9A)), _bytes_in((0x80, 0x80)))),
    (0xE1, (_bytes_in((0xA0, 0xA0)), _bytes_in((0x8E, 0x8E)))),
    (0xE2, (_bytes_in((0x80, 0x80)), _bytes_in((0x80, 0x8B), (0xA8, 0xA9), (0xAF, 0xAF)))),
    (0xE2, (_bytes_in((0x81, 0x81)), _bytes_in((0x9F, 0x9F)))),
    (0xE3, (_bytes_in((0x80, 0x80)), _bytes_in((0x80, 0x80)))),
)


class Encoder:
    """A byte-level BPE tokenizer with a memo of the units between blanks.

    The tokenizer's pre-tokenizer always ends a match before a blank or a line
    feed that stands between two characters that aren't white space, so what
    lies between such places is encoded apart and remembered.  A batch's units
    are cut as bytes, each with the blank or line feed before it, and numbered by
    Arrow, so that the memo is asked once for a unit of a batch.
    """

    #: Of either generation of the memo.
    MOST_UNITS, MOST_CHARS = 400_000, 6_000_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # A token of a byte-level vocabulary has a character for each of its bytes.
        names = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size())]
        added = self.tokenizer.get_added_tokens_decoder()
        self.sizes = np.array([0 if t is None or i in added else len(t) for i, t in enumerate(names)], np.int64)
        self.later: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.held = 0

    def _alone(self, units: list[bytes]) -> list[bytes]:
        return [np.array(got.ids, "<u4").tobytes() for got in self.tokenizer.encode_batch_fast([u.decode("utf-8") for u in units], add_special_tokens=False)]

    def _together(self, units: list[bytes]) -> list[bytes]:
        """Units that may follow each other, encoded as one text: the ids are cut where the bytes of units end."""
        ids = np.array(self.tokenizer.encode_batch_fast([b"".join(units).decode("utf-8")], add_special_tokens=False)[0].ids, "<u4")
        ends, wanted = np.cumsum(self.sizes[ids]), np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))
        cuts = np.searchsorted(ends, wanted)
        if not len(ids) or cuts[-1] >= len(ends) or not np.array_equal(ends[cuts], wanted) or ends[-1] != wanted[-1]:
            return self._alone(units)  # a token that isn't made of bytes
        raw, cuts = ids.tobytes(), [0, *(4 * (cuts + 1)).tolist()]
        return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _learn(self, units: list[bytes]) -> None:
        raw = np.frombuffer(b"".join(units), np.uint8)
        last = np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))
        # Those that begin with a blank or line feed before another character, and don't end in white space.
        white = _white_space(raw)
        first = np.concatenate([[0], last[:-1]])
        starts = _cuttable(raw[first]) & (last - first > 1) & ~white[np.minimum(first + 1, len(raw) - 1)] & ~white[last - 1]
        joined, single = [u for u, s in zip(units, starts.tolist(), strict=True) if s], [u for u, s in zip(units, starts.tolist(), strict=True) if not s]
        for some, encode in ((joined, self._together), (single, self._alone)):
            for at in range(0, len(some), 4096):
                part = some[at : at + 4096]
                self.later.update(zip(part, encode(part), strict=True))
        self.held += len(raw)

    def _ids_of(self, units: list[bytes]) -> list[bytes]:
        """The ids of distinct units."""
        if self.held > self.MOST_CHARS or len(self.later) > self.MOST_UNITS:
            self.older, self.later, self.held = self.later, {}, 0
        found = list(map(self.later.get, units))
        holes = [i for i, got in enumerate(found) if got is None]
        take, missing = self.older.pop, []
        for i in holes:
            unit = units[i]
            if (got := take(unit, None)) is None:
                missing.append(unit)
            else:
                self.later[unit] = got
                self.held += len(unit)
        if missing:
            self._learn(missing)
        for i in holes:
            found[i] = self.later[units[i]]
        return found

    def encode_batch(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        raw, starts, units = cut_units(texts.fill_null(""))
        if not len(raw):
            return [b""] * len(texts)
        coded = pa.Array.from_buffers(pa.large_binary(), len(units) - 1, [None, pa.py_buffer(units), pa.py_buffer(raw)]).dictionary_encode()
        known = self._ids_of(coded.dictionary.to_pylist())
        which = coded.indices.to_numpy()
        # Every unit's ids, in the order of the texts.
        size = np.fromiter(map(len, known), np.int32, len(known)) // 4
        held, at = np.frombuffer(b"".join(known), "<u4"), np.cumsum(size, dtype=np.int64) - size
        long = size[which]
        ends = np.concatenate([[0], np.cumsum(long, dtype=np.int64)])
        kind = np.int32 if ends[-1] < 1 << 31 else np.int64
        place = np.repeat((at[which] - ends[:-1]).astype(kind), long)
        place += np.arange(ends[-1], dtype=kind)
        ids = held[place].tobytes()
        cuts = 4 * ends[np.searchsorted(units, starts)]
        return [ids[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]


def _cuttable(raw: np.ndarray) -> np.ndarray:
    return (raw == 0x20) | (raw == 0x0A)


def cut_units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, where each text starts, and where each unit does; both with the end of the last."""
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    starts = np.frombuffer(texts.buffers()[1], width, len(texts) + 1, texts.offset * width().itemsize).astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[starts[0] : starts[-1]] if data is not None else np.zeros(0, np.uint8)
    starts = starts - starts[0]
    white = _white_space(raw)
    cut = np.zeros(len(raw) + 1, bool)
    cut[1 : len(raw) - 1] = _cuttable(raw[1:-1]) & ~white[:-2] & ~white[2:]
    # A text's last character has none after it, and its first none before; an end of a text is a cut.
    lasts = starts[1:][starts[1:] > starts[:-1]] - 1
    cut[lasts] = False
    cut[starts] = True
    return raw, starts, np.flatnonzero(cut)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One tokenizer per Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# ---------------------------------------------------------------- operator


def _in_bytes(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``ENCODED_BYTES`` of the column's texts; a longer text is one by itself."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy())
    first = 0
    while first < batch.num_rows:
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + ENCODED_BYTES, "right")))
        yield batch.slice(first, last - first)
        first = last


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, bits: bool = False, shard_ids: int = SHARD_IDS) -> None:
    """Encodes every text, appends ``end_id``, and writes shards in ascending order of ids to ``path``."""
    ordered = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t"))
    ordered = ordered.repartitionByRange(F.col("d"), F.substring("t", 1, PREFIX)).sortWithinPartitions("d", "t")
    end = np.array([end_id], "<u4").tobytes()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, number = TaskContext.get().partitionId(), 0
        ids: list[bytes] = []
        names: list[int | None] = []
        lengths: list[int] = []
        held = 0

        def flush() -> pa.RecordBatch:
            shard = encode_shard(np.frombuffer(b"".join(ids), "<u4"), names, lengths, (partition, number), bits)
            ids.clear(), names.clear(), lengths.clear()
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.binary())], ["shard"])

        for batch in batches:
            for some in _in_bytes(batch, 1):
                for name, got in zip(some.column(0).to_pylist(), encoder(tokenizer).encode_batch(some.column(1)), strict=True):
                    ids.append(got + end)
                    names.append(name)
                    lengths.append(len(got) // 4 + 1)
                    held += lengths[-1]
                    if held >= shard_ids:
                        yield flush()
                        number, held = number + 1, 0
        if names:
            yield flush()

    rows = ordered.mapInArrow(shards, "shard binary")
    with short_batches(docs.sparkSession, ENCODED_ROWS):
        rows.select(F.col("shard").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", END.decode()).option("maxRecordsPerFile", SHARDS_PER_FILE).text(path)


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Per document of the shards at ``path``: id, start among all ids, number of ids, their CRC-32."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = [(*place, doc, start, len(ids), zlib.crc32(ids.tobytes())) for place, doc, start, ids in documents_in(content.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 6)], ["p", "k", id_col, "s", "n_tokens", "ids_crc32"])

    found = materialized(files.mapInArrow(decode, f"p long, k long, `{id_col}` long, s long, n_tokens long, ids_crc32 long"), "tokens-read")
    # What stands before a shard: in its partition, and in partitions before, of which there are a few thousand.
    totals = found.groupBy("p", "k").agg(F.sum("n_tokens").alias("n"))
    sums = totals.groupBy("p").agg(F.sum("n").alias("whole"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("p", F.coalesce(F.sum("whole").over(before(Window.orderBy("p"))), F.lit(0)).alias("first"))
    inside = F.coalesce(F.sum("n").over(before(Window.partitionBy("p").orderBy("k"))), F.lit(0))
    starts = totals.select("p", "k", inside.alias("inside")).join(sums, "p").select("p", "k", (F.col("first") + F.col("inside")).alias("base"))
    return found.join(starts, ["p", "k"]).select(id_col, (F.col("base") + F.col("s")).alias("start"), "n_tokens", "ids_crc32")


def fetch(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of the wanted documents (a short list); only their chunks are decoded."""
    wanted = set(doc_ids)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = [(name, shard.document(k).tolist()) for shard in shards_in(content.as_py()) for k, name in enumerate(shard.doc_ids) if name in wanted]
                names, ids = zip(*rows, strict=True) if rows else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(look, "doc_id long, ids array<long>")


def token_files(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, bits: bool = False) -> DataFrame:
    """Writes the shards (to a new folder of the shared one unless ``path`` says where) and reads them back."""
    spark = docs.sparkSession
    path = path or fresh_path(spark, "token-shards")
    write_tokens(docs, path, tokenizer, id_col, text_col, bits=bits)
    return read_tokens(spark, path, id_col)

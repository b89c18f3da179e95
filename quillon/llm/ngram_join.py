"""N-gram Jaccard join by parity sketches.

A document's set holds its distinct word n-grams, as 64-bit hashes.  Two sets
of sizes a and b with a Jaccard similarity of 3/4 or more differ in at most
D = (a + b) / 7 elements.

* Sketch: for a band of sizes the elements fall into P pieces by hash, and a
  piece is the XOR of the hashes in it.  An element that only one set has
  changes one piece, so the pieces that differ (the Hamming distance of the
  sketches) are no more than the elements that differ.
* Pigeonhole: a set with more than D pieces that aren't empty shares one of
  them with every partner.  A pair belongs to the band of its smaller set, so a
  set is sketched for its own band and, where a partner may be in it, for the
  one below.  Sets meet by (band, piece, XOR).
* A second sketch, of four parity bits to an element, and the sizes rule
  candidates out, and the rest are verified on their texts.

Skew: equal sets are one node from the start.  A key that more than ``HEAVY``
nodes share (a passage that many documents hold, a large group of near copies)
pairs nobody.  A set whose other keys are still more than D needs no such key;
what it is left with less is joined again by single elements, so that all its
links to sets with which it shares an element of at most ``HEAVY`` holders are
known.  For a pair that shares heavy elements only, the difference is l + m +
|h ^ g|, of the numbers l, m of light elements and the heavy parts h, g.  So

* the sets of one heavy part need no more than a star to the one with the
  fewest light elements: if it links to neither of two, they aren't linked, and
  whoever links to one of another part links to that one's star or is not in it;
* of what remains, the sets that hold an element link to one of them (that with
  the fewest light elements for its size), which joins most of any large group;
* then those that are still in different components meet by prefixes of their
  heavy parts, elements that few components hold first, under the condition that
  what follows the element leaves enough to share.

So no link between different components is lost, and no large group makes all
its pairs.

Components are found by alternating large and small stars.  What is written to
the shared folder between steps is deleted when the last step that reads it has
been written.

Defined results: a null text, and one without words, has an empty set and is
linked with nothing; fewer words than n make one n-gram of the whole sequence;
rows that repeat are linked as equal sets are; rows of one id with different
texts are nodes of their own; a null id is linked like others and never names a
component that has an id; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialized, sliced

WORDS = 5
#: Similarity of a link, as inner * 7 >= (a + b) * 3, which is inner >= 3/4 of the union.
HEAVY = 8
PIECES_PER_SIZE = 0.9
#: Bytes of a node's short id beside a key; two nodes may share one, which verification sorts out, so that single elements, which are counted by node, take more.
ID_BYTES, WIDE_ID_BYTES = 6, 8
BAND_STEP, SIZE_STEP = 4 / 3, 1.1
LEAST_BITS, BITS_PER_ELEMENT = 1024, 4
FLUSH = 1_000_000
RECORDS_PER_BUCKET = 400_000
SLICE = 1 << 20

_U = np.uint64
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_STEP, _PLACE = _U(0x9E3779B97F4A7C15), [_U(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        inverse = _U(pow(int(_STEP), -1, 1 << 64))
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)])) for x in (_STEP, inverse)]
    return _POWERS[0], _POWERS[1]


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words, in order: a polynomial over the bytes, taken as a difference of running sums."""
    data, out, at = text.encode("utf-8", "surrogatepass").translate(_LOWER), [], 0
    while at < len(data):
        end = len(data)
        if end - at > SLICE:  # cut after a white space
            end = at + SLICE
            found = np.flatnonzero(_SPACE[np.frombuffer(data, np.uint8, SLICE, at)])
            while not len(found) and end < len(data):
                step = min(SLICE, len(data) - end)
                found = np.flatnonzero(_SPACE[np.frombuffer(data, np.uint8, step, end)]) + (end - at)
                end += step
            end = at + int(found[-1]) + 1 if len(found) else len(data)
        raw = np.frombuffer(data, np.uint8, end - at, at)
        inside = np.zeros(len(raw) + 2, bool)
        inside[1:-1] = ~_SPACE[raw]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        powers, inverses = _powers(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * powers[: len(raw)], out=sums[1:])
        out.append(mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64) * _PLACE[0]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """The sorted set of a text's word n-grams."""
    words = word_hashes(text) if text else np.zeros(0, np.uint64)
    size = min(n, len(words))
    if not size:
        return words
    total = np.full(len(words) - size + 1, size, np.uint64) * _STEP
    for j in range(size):
        total = mix(total + words[j : len(words) - size + 1 + j] * _PLACE[j % 5])
    return np.unique(total)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 75 * union, of sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if 4 * len(a) < 3 * len(b) or not len(a):
        return False
    at = np.searchsorted(b, a)
    inner = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * inner >= 75 * (len(a) + len(b) - inner)


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    raw = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def parity_bits(s: np.ndarray) -> bytes:
    """The set's parity sketch: bit j is the parity of the elements that hash to it.  A power of two of bits, at least four to an element."""
    size = max(LEAST_BITS, 1 << (BITS_PER_ELEMENT * len(s) - 1).bit_length()) if len(s) else LEAST_BITS
    bits = np.bincount((s >> _U(20)).astype(np.int64) & (size - 1), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def distance(a: bytes, b: bytes) -> int:
    """Hamming distance of two sketches, at most the elements in which the sets differ; a longer one is folded."""
    x, y = (np.frombuffer(v, np.uint8) for v in (a, b))
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.unpackbits(x ^ y).sum())


def bands(size: int) -> list[tuple[int, int]]:
    """(band, most elements in which the set may differ from a partner whose pair is of that band)."""
    own = size.bit_length() - 1
    out = [(own, (size + 4 * size // 3) // 7)]
    if (3 * size + 3) // 4 < 1 << own:  # a partner may be smaller than the band
        out.append((own - 1, (size + (1 << own) - 1) // 7))
    return [(band, most) for band, most in out if most]  # without a difference the sets are one node


def sketch_keys(s: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """(band, number of keys that a pair needs, keys): a key is a hash of band, piece and XOR, the band in its low bits."""
    out = []
    for band, most in bands(len(s)):
        n = int(np.ceil(PIECES_PER_SIZE * (1 << band)))
        spread = mix(s + _U(band * int(_PLACE[1]) % (1 << 64)))
        piece = ((spread >> _U(32)) * _U(n)) >> _U(32)
        order = np.argsort(piece, kind="stable")
        piece, value = piece[order], spread[order]
        first = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
        folded = np.bitwise_xor.reduceat(value, first)
        out.append((band, most + 1, mix(folded * _PLACE[2] + piece[first]) & ~_U(63) | _U(band)))
    return out


def single_keys(s: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """Every element as a key; a set with as many rare ones meets all that it can be linked with."""
    return [(0, len(s) // 4 + 1, mix(s))]


# ---------------------------------------------------------------- keys to candidates


def _planes(x: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _numbers(raw: memoryview, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, n * width).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def _distinct(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct records by key and id; the place where each key's run starts, and its length."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    keep = np.concatenate([[True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])]) if len(keys) else np.zeros(0, bool)
    keys, ids = keys[keep], ids[keep]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys, ids, first, np.diff(np.append(first, len(keys)))


def id_mask(width: int) -> int:
    """The bits of a short id; all of them set stand for the nodes of a key that is already heavy where it comes from."""
    return (1 << min(8 * width, 63)) - 1


def _rows(keys: list[np.ndarray], ids: list[np.ndarray], bits: int, salt: int, width: int) -> pa.RecordBatch:
    """Records packed by bucket: sorted, differences and ids in byte planes, which compress.  Heavy keys go beside them."""
    k, i, first, length = _distinct(np.concatenate(keys), np.concatenate(ids))
    out: list[tuple[int, int, bytes]] = []
    heavy = length > HEAVY
    for at, n in zip(first[heavy].tolist(), length[heavy].tolist(), strict=True):
        place = (1 << bits) + int(mix(np.array([k[at] + _U(salt)], np.uint64))[0] >> _U(64 - bits) if bits else 0)
        out.append((place, int(k[at].view(np.int64)), i[at : at + n].tobytes()))
    light = np.repeat(~heavy, length)
    light[first[heavy]] = True
    i = i.copy()
    i[first[heavy]] = _U(id_mask(width))
    k, i = k[light], i[light]
    bucket = (k >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(k), np.int64)
    cuts = np.searchsorted(bucket, np.arange((1 << bits) + 1))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        part, who = k[cuts[b] : cuts[b + 1]], i[cuts[b] : cuts[b + 1]]
        out.append((b, len(part), _planes(np.diff(part, prepend=_U(0)), 8) + _planes(who, width)))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["bucket", "k", "blob"])


def _pairs_of(keys: np.ndarray, ids: np.ndarray, mark: np.uint64) -> tuple[np.ndarray, list[tuple[int, list[int]]]]:
    """Distinct pairs of nodes under light keys; heavy keys with their nodes."""
    keys, ids, first, length = _distinct(keys, ids)
    last = first + length - 1
    heavy = (length > HEAVY) | (ids[last] == mark) if len(first) else np.zeros(0, bool)
    chunks = []
    for at, n in zip(first[heavy].tolist(), length[heavy].tolist(), strict=True):
        who = ids[at : at + n]
        chunks.append((int(keys[at].view(np.int64)), who[who != mark].view(np.int64).tolist()))
    run = np.repeat(np.arange(len(first)), length)
    keep = np.repeat(~heavy, length)
    run, ids = run[keep], ids[keep]
    found = [np.stack([ids[:-o][same], ids[o:][same]], axis=1) for o in range(1, HEAVY) if (same := run[:-o] == run[o:]).any()]
    return (np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.uint64)), chunks


CANDIDATES = "x long, y long, k long, ids array<long>"


def candidates(texts: DataFrame, keys_of, bits: int, name: str, width: int = ID_BYTES) -> DataFrame:
    """CANDIDATES from ``texts`` (column t): pairs of nodes (x, y), or heavy keys k with some of their nodes."""

    mask = _U(id_mask(width))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, held, salt, seen = [], [], 0, TaskContext.get().partitionId() << 20, set()
        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                s = shingles(text)
                if len(s) < 3:
                    continue
                who = digest(s)
                if who in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(who)
                for _, _, k in keys_of(s):
                    keys.append(k)
                    ids.append(np.full(len(k), np.array([who[0]], np.int64).view(np.uint64)[0] & mask))
                    held += len(k)
                if held >= FLUSH:
                    yield _rows(keys, ids, bits, salt, width)
                    keys, ids, held, salt = [], [], 0, salt + 1
        if held:
            yield _rows(keys, ids, bits, salt, width)

    def meet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if key[0] >= 1 << bits:
            chunks, pairs = [(k, np.frombuffer(b, np.int64).tolist()) for k, b in zip(pdf.k, pdf.blob, strict=True)], np.zeros((0, 2), np.uint64)
        else:
            keys, ids = [], []
            for n, blob in zip(pdf.k, pdf.blob, strict=True):
                view = memoryview(blob)
                keys.append(np.cumsum(_numbers(view[: 8 * n], n, 8)))
                ids.append(_numbers(view[8 * n :], n, width))
            pairs, chunks = _pairs_of(np.concatenate(keys), np.concatenate(ids), mask)
        n, x = len(chunks), pairs.view(np.int64)
        return pd.DataFrame({
            "x": pd.array([*x[:, 0].tolist(), *[None] * n], "Int64"), "y": pd.array([*x[:, 1].tolist(), *[None] * n], "Int64"),
            "k": pd.array([*[None] * len(x), *[k for k, _ in chunks]], "Int64"), "ids": pd.Series([*[None] * len(x), *[i for _, i in chunks]], dtype=object),
        })

    packed = texts.select("t").mapInArrow(emit, "bucket int, k long, blob binary")
    return materialized(packed.groupBy("bucket").applyInPandas(meet, CANDIDATES), name, texts=True)


# ---------------------------------------------------------------- components


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) is joined to, for those that aren't it.

    The smallest neighbours are written before they are joined, so that both sides of the join are dealt for it alone and
    AQE can split the node that is the centre of a large star.
    """
    now = materialized(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), name)
    state = None
    while not now.isEmpty():
        # Large star: a node's larger neighbours go to its smallest one.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialized(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), name)
        large = materialized(both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct(), name)
        discard(now, least)
        # Small star: a node and its smaller neighbours go to the smallest.
        least = materialized(large.groupBy("b").agg(F.min("a").alias("m")), name)
        small = large.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b")).where("a <> b")
        now = materialized(small.unionByName(least.select(F.col("m").alias("a"), "b")).distinct(), name)
        discard(large, least)
        n, check = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (n, check) == state:
            break
        state = (n, check)
    out = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    out._written_at = now._written_at
    return out


# ---------------------------------------------------------------- the join


def _sized(a: str, b: str) -> Column:
    """Sizes leave a link possible."""
    return 4 * F.least(F.col(a), F.col(b)) >= 3 * F.greatest(F.col(a), F.col(b))


def _sifted(pairs: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """Those of the distinct pairs (a, b) whose sizes and parity sketches leave a link possible."""
    of = lambda c, n, s: nodes.select(F.col("node").alias(c), F.col("n").alias(n), F.col("sketch").alias(s))
    sized = pairs.join(of("a", "n", "s").drop("s"), "a").join(of("b", "m", "u").drop("u"), "b").where(_sized("n", "m")).select("a", "b")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            n, m, s, u = (c.to_pylist() for c in batch.columns[2:])
            keep = [7 * distance(x, y) <= p + q for p, q, x, y in zip(n, m, s, u, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = sized.join(of("a", "n", "s"), "a").join(of("b", "m", "u"), "b").select("a", "b", "n", "m", "s", "u")
    return materialized(both.mapInArrow(sift, pairs.select("a", "b").schema), name)


def _verified(pairs: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """Links (a, b) of nodes among ``pairs`` (a, b), by their whole texts."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: OrderedDict[tuple, np.ndarray] = OrderedDict()
        held = 0

        def sets(node: dict, text: str) -> np.ndarray:
            nonlocal held
            key = (node["d1"], node["d2"])
            if key not in memo:
                memo[key] = shingles(text)
                held += len(memo[key])
                while held > 4_000_000 and len(memo) > 2:
                    held -= len(memo.popitem(last=False)[1])
            return memo[key]

        for batch in sliced(batches):
            a, b, s, t = (c.to_pylist() for c in batch.columns)
            keep = [linked(sets(p, x), sets(q, y)) for p, q, x, y in zip(a, b, s, t, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of = lambda n, t: texts.select(F.col("node").alias(n), F.col("t").alias(t))
    joined = pairs.join(of("a", "s"), "a").join(of("b", "u"), "b").select("a", "b", "s", "u")
    return materialized(joined.mapInArrow(check, pairs.select("a", "b").schema), name, texts=True)


def _with_nodes(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of short ids as distinct pairs of nodes (a, b), a < b."""
    left, right = (nodes.select(F.col("id").alias(i), F.col("node").alias(p), F.col("n").alias(n)) for i, p, n in (("x", "p", "n"), ("y", "q", "m")))
    both = pairs.select("x", "y").distinct().join(left, "x").join(right, "y").where(_sized("n", "m"))
    return both.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).where("a <> b").distinct()


def _short_of(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """Ids among ``wanted`` (id, band, keys, need) whose keys that aren't heavy are fewer than needed."""
    heavy = found.where("k IS NOT NULL").select("k", F.explode("ids").alias("id"))
    n = heavy.groupBy("id", F.col("k").bitwiseAND(F.lit(63)).cast("int").alias("band")).agg(F.count(F.lit(1)).alias("heavy"))
    return wanted.join(n, ["id", "band"], "left").where(F.col("keys") - F.coalesce("heavy", F.lit(0)) < F.col("need")).select("id").distinct()


NO_ID = 2**63 - 1


def _signed(source: DataFrame) -> DataFrame:
    """Per row of ``source`` (d, t and others): its set's size, digest, parity sketch, and the keys that its sketches have and need."""
    others = [c for c in source.columns if c != "t"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for t in batch.column("t").to_pylist():
                s = shingles(t)
                keys = sketch_keys(s) if len(s) else []
                rows.append((len(s), *digest(s), parity_bits(s), [{"band": b, "keys": len(k), "need": m} for b, m, k in keys]))
            kinds = [pa.int64()] * 3 + [pa.binary(), pa.list_(pa.struct([("band", pa.int32()), ("keys", pa.int32()), ("need", pa.int32())]))]
            made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], *made], [*others, "n", "d1", "d2", "sketch", "bands"])

    schema = ", ".join(f"{c} long" for c in others)
    return materialized(source.mapInArrow(sign, f"{schema}, n long, d1 long, d2 long, sketch binary, bands array<struct<band:int,keys:int,need:int>>"), "signatures", texts=True)


def _named_sets(source: DataFrame, signed: DataFrame) -> DataFrame:
    """(d1, d2, e1, e2, r): of each set that isn't empty, its component's first set and smallest id (null if it has none)."""
    sets = signed.where("n > 0").groupBy("d1", "d2").agg(F.min("d").alias("r"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    node = F.struct(F.coalesce("r", F.lit(NO_ID)).alias("r"), "d1", "d2")
    short_id = lambda width: F.col("d1").bitwiseAND(F.lit(id_mask(width)))
    nodes = materialized(sets.select(short_id(ID_BYTES).alias("id"), short_id(WIDE_ID_BYTES).alias("wide"), node.alias("node"), "n", "sketch", "bands"), "sets")
    records = nodes.agg(F.coalesce(F.sum(F.aggregate("bands", F.lit(0).cast("long"), lambda acc, x: acc + x["keys"])), F.lit(0))).first()[0]
    bits = max(0, int(records // RECORDS_PER_BUCKET)).bit_length() + 2

    # Round 1: sketches.
    found = candidates(source, sketch_keys, bits, "sketch-candidates")
    wanted = nodes.select("id", F.explode("bands").alias("x")).select("id", "x.band", "x.keys", "x.need")
    short = materialized(_short_of(found, wanted), "short-sets")
    pairs = _sifted(_with_nodes(found.where("x IS NOT NULL"), nodes), nodes, "sketch-pairs")
    discard(found)

    # The texts of all that is compared by elements.
    sides = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    asked = sides.unionByName(nodes.join(short, "id", "left_semi").select("node")).distinct()
    asked = asked.select("node", F.nullif("node.r", F.lit(NO_ID)).alias("r"))

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            keep = [digest(shingles(t)) == (n["d1"], n["d2"]) for n, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    fetched = asked.join(source, F.col("r").eqNullSafe(F.col("d"))).select("node", "t")
    texts = fetched.mapInArrow(same, fetched.schema).groupBy("node").agg(F.min("t").alias("t"))
    texts = materialized(texts, "compared-texts", texts=True)
    links = [_verified(pairs, texts, "sketch-links")]
    held = [nodes, pairs, short, texts, *links]

    # Round 2: sets with too few rare pieces, by single elements.
    roots = None
    if not short.isEmpty():
        poor = materialized(nodes.join(short, "id", "left_semi").select("wide", "node", "n"), "poor-sets")
        found = candidates(texts.join(poor.select("node"), "node"), single_keys, bits, "single-candidates", WIDE_ID_BYTES)
        met = _with_nodes(found.where("x IS NOT NULL"), poor.withColumnRenamed("wide", "id")).join(pairs, ["a", "b"], "left_anti")
        more = _sifted(met, nodes, "single-pairs")
        links.append(_verified(more, texts, "single-links"))
        # Round 3: pairs that share heavy elements only.
        parts = materialized(_heavy_parts(found, poor), "heavy-parts")
        held += [poor, found, more, links[-1], parts]
        if not parts.isEmpty():
            made, roots = _among_heavy(parts, links)
            held += made
    if roots is None:
        roots = components(links[0] if len(links) == 1 else links[0].unionByName(links[1]))
    first = F.coalesce("root", "node")
    named = nodes.select("node").join(roots, "node", "left").select("node.d1", "node.d2", first["d1"].alias("e1"), first["d2"].alias("e2"), F.nullif(first["r"], F.lit(NO_ID)).alias("r"))
    named = materialized(named, "named-sets")
    discard(*held, roots)
    return named


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_shingles, component_id."""
    source = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).cast("string").alias("t"))
    signed = _signed(source)
    named = _named_sets(source, signed).select("d1", "d2", F.col("r").alias("component_id"))
    out = signed.select("d", "n", "d1", "d2").join(named, ["d1", "d2"], "left")
    kind = docs.schema[id_col].dataType
    return out.select(F.col("d").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "d").cast(kind).alias("component_id"))


# ---------------------------------------------------------------- sets of heavy elements


def _heavy_parts(found: DataFrame, poor: DataFrame) -> DataFrame:
    """(node, n, l, g, h, h1, h2): of sets that may be linked by heavy elements alone, sizes of the set and of its light and heavy parts, the heavy part and its digest."""
    held = found.where("k IS NOT NULL").select("k", F.explode("ids").alias("wide")).groupBy("wide").agg(F.array_sort(F.collect_set("k")).alias("h"))
    parts = poor.join(held, "wide").withColumn("g", F.size("h").cast("long")).withColumn("l", F.col("n") - F.col("g"))
    return parts.where("4 * l <= n").select("node", "n", "l", "g", "h", F.xxhash64("h").alias("h1"), F.xxhash64(F.lit("h"), "h").alias("h2"))


def _agreeing(pairs: DataFrame, parts: DataFrame, name: str) -> DataFrame:
    """Links (a, b) among ``pairs`` whose sets share enough heavy elements."""
    of = lambda c, s, h: parts.select(F.col("node").alias(c), F.col("n").alias(s), F.col("h").alias(h))
    both = pairs.join(of("a", "p", "x"), "a").join(of("b", "q", "y"), "b")
    inner = F.size(F.array_intersect("x", "y"))
    return materialized(both.where(7 * inner >= 3 * (F.col("p") + F.col("q"))).select("a", "b"), name)


def _band(n: Column, step: float) -> Column:
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(step))).cast("int")


def _among_heavy(parts: DataFrame, links: list[DataFrame]) -> tuple[list[DataFrame], DataFrame]:
    """What was written, and the components of all sets: by ``links`` and by links among ``parts`` that are heavy elements' alone."""
    sizes = parts.select("node", "n", "l", "g", "h1", "h2")
    # Sets of one heavy part: a star to the one with the fewest light elements. It stands for all that it links to.
    least = materialized(sizes.groupBy("h1", "h2").agg(F.min(F.struct("l", "node")).alias("m")), "part-centres")
    placed = materialized(sizes.join(least, ["h1", "h2"]).select("node", "n", "l", "g", F.col("m.node").alias("c"), (F.col("l") * 3 + F.col("m.l") * 3 <= F.col("g")).alias("near")), "part-stars")
    same = placed.where("near AND node <> c").select(F.col("c").alias("a"), F.col("node").alias("b"))
    active = materialized(parts.join(placed.where("NOT near OR node = c").select("node"), "node", "left_semi").select("node", "n", "l", "g", "h"), "active-parts")

    # Two linked sets share one of the first n / 4 - l + 1 elements of each, in the order of their hashes; each of these has its centre.
    prefix = F.slice("h", 1, F.greatest(F.lit(0), F.floor(F.col("n") / 4) - F.col("l") + 1).cast("int"))
    band = _band(F.col("n"), BAND_STEP)
    keyed = active.select("node", "n", "l", "g", F.explode(F.array(band, band + 1)).alias("band"), prefix.alias("first")).select("node", "n", "l", "g", "band", F.explode("first").alias("k"))
    best = F.min(F.struct((6 * F.col("l") - F.col("g")).alias("excess"), "node", "n", "g")).alias("c")
    centres = materialized(keyed.groupBy("k", "band").agg(best, F.count(F.lit(1)).alias("m")).where("m > 1").select("k", "band", "c"), "centres")
    possible = 7 * F.least("g", F.col("c.g")) >= 3 * (F.col("n") + F.col("c.n"))
    star = keyed.join(centres, ["k", "band"]).where((F.col("node") != F.col("c.node")) & possible).select("node", F.col("c.node").alias("c"))
    star = materialized(star.select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")).distinct(), "star-pairs")
    links = [*links, same, _agreeing(star, active, "star-links")]
    every = links[0]
    for more in links[1:]:
        every = every.unionByName(more)
    roots = components(every, "star-components")

    # What is still apart: elements that few components hold first.
    rooted = materialized(active.join(roots, "node", "left").select("node", "n", "l", "g", "h", F.coalesce("root", "node").alias("root")), "rooted-parts")
    elements = rooted.select("node", "root", F.explode("h").alias("k"))
    spread = materialized(elements.groupBy("k", "root").agg(F.lit(1).alias("one")).groupBy("k").agg(F.count(F.lit(1)).alias("spread")).where("spread > 1"), "spread")
    order = elements.join(spread, "k").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("spread", "k"))).alias("o"))
    # Elements of one component only come before all others: so many places are taken.
    order = rooted.select("node", "root", "n", "g").join(order, "node").select("node", "root", "n", "g", F.posexplode("o").alias("at", "x"), F.size("o").alias("shared"))
    # A partner of size m needs 7 * left >= 3 * (n + m), m >= 3/4 * n; of two sets the smaller meets in its own band of sizes, the larger in all that a partner can have.
    left = F.col("shared") - F.col("at")
    order = order.select("node", "root", "n", F.col("x.k").alias("k"), left.cast("long").alias("left"), F.floor((7 * left - 3 * F.col("n")) / 3).alias("most"), F.ceil(F.col("n") * 3 / 4).alias("fewest")).where("most >= fewest")
    order = materialized(order, "prefixes")
    small = order.where("most >= n").withColumn("band", _band(F.col("n"), SIZE_STEP))
    large = order.withColumn("band", F.explode(F.sequence(_band(F.col("fewest"), SIZE_STEP), _band(F.least("most", "n"), SIZE_STEP))))
    groups = small.select("k", "band", "root").unionByName(large.select("k", "band", "root")).groupBy("k", "band").agg(F.min("root").alias("r"), F.max("root").alias("s"))
    mixed = materialized(groups.where("r <> s").select("k", "band"), "mixed-groups")
    small = small.join(mixed, ["k", "band"]).select("k", "band", F.col("node").alias("a"), F.col("root").alias("x"), F.col("n").alias("p"), F.col("left").alias("u"))
    large = large.join(mixed, ["k", "band"]).select("k", "band", F.col("node").alias("b"), F.col("root").alias("y"), F.col("n").alias("q"), F.col("left").alias("v"))
    meet = (F.col("x") != F.col("y")) & (F.struct("p", "a") < F.struct("q", "b")) & (7 * F.least("u", "v") >= 3 * (F.col("p") + F.col("q")))
    rest = small.join(large, ["k", "band"]).where(meet).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = materialized(rest.join(star, ["a", "b"], "left_anti"), "apart-pairs")
    apart = _agreeing(rest, active, "apart-links")
    written = [least, placed, active, centres, star, links[-1], rooted, spread, order, mixed, rest, apart]
    if apart.isEmpty():
        return written, roots
    # Components of components.
    of = lambda c, r: roots.select(F.col("node").alias(c), F.col("root").alias(r))
    over = apart.join(of("a", "x"), "a", "left").join(of("b", "y"), "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
    upper = components(over, "apart-components")
    top = upper.select(F.col("node").alias("root"), F.col("root").alias("top"))
    joined = roots.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    joined = materialized(joined.unionByName(upper), "joined-components")
    return [*written, roots, upper], joined


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component: that of the smallest id (of no id, if none has one); columns as they were.

    Documents without words all stay.  Of rows with the same id and text one stays.
    """
    known = {c.lower() for c in docs.columns}
    mark = lambda name: next(x for i in range(len(known) + 1) if (x := f"{name}_{i}") not in known)
    d, a, b = mark("__d"), mark("__a"), mark("__b")
    text = F.col(f"`{text_col}`").cast("string")
    hashed = docs.select("*", F.col(f"`{id_col}`").cast("long").alias(d), F.xxhash64(text).alias(a), F.xxhash64(F.lit("text"), text).alias(b))
    source = hashed.select(F.col(d).alias("d"), F.col(a).alias("a"), F.col(b).alias("b"), text.alias("t"))
    signed = _signed(source)
    named = _named_sets(source.select("d", "t"), signed)
    rows = signed.where("n > 0").select("d", "a", "b", "d1", "d2").groupBy("d", "a", "b", "d1", "d2").agg(F.count(F.lit(1)).alias("rows"))
    rows = materialized(rows.join(named, ["d1", "d2"]).select("d", "a", "b", "rows", (F.col("d").eqNullSafe(F.col("r")) & (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2"))).alias("first"), "e1", "e2"), "document-classes")
    discard(signed, named)
    # The first set may be that of several texts of the smallest id.
    stays = materialized(rows.where("first").groupBy("e1", "e2").agg(F.min(F.struct("a", "b")).alias("x")).select("e1", "e2", "x.a", "x.b"), "documents-that-stay")
    first = rows.where("first").join(stays, ["e1", "e2", "a", "b"], "left_semi").select("d", "a", "b", "rows")
    gone = rows.where("NOT first").select("d", "a", "b").unionByName(rows.where("first").join(stays, ["e1", "e2", "a", "b"], "left_anti").select("d", "a", "b"))
    same = lambda other: hashed[d].eqNullSafe(other["d"]) & (hashed[a] == other["a"]) & (hashed[b] == other["b"])
    left = hashed.join(gone, same(gone), "left_anti")
    many = first.where("rows > 1")
    if many.isEmpty():
        return left.select(*[F.col(f"`{c}`") for c in docs.columns])
    r = mark("__r")
    repeated = left.join(many, same(many), "left_semi").withColumn(r, F.row_number().over(Window.partitionBy(d, a, b).orderBy(F.lit(0)))).where(F.col(r) == 1).drop(r)
    return left.join(many, same(many), "left_anti").unionByName(repeated).select(*[F.col(f"`{c}`") for c in docs.columns])

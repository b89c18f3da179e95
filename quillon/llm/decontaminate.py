"""Benchmark decontamination with one Aho-Corasick automaton.

The automaton holds every window of the normalised benchmark items (ten
consecutive words; an item of fewer words is one window).  Each document is
normalised once, scanned once, and every hit is mapped back to word positions
and to character offsets in the original text.  A benchmark too large for one
automaton in a worker's memory is dealt over several, each a pass over the
documents that hands on the word ranges found so far.

Defined results: a null or wordless text has no words and no hits; items that
are null, wordless or have a null id are not searched for; rows that repeat
give a row each; an empty benchmark contaminates nothing; other columns of the
documents are kept out of the way unless ``keep`` names them.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialized, sliced

WINDOW = 10
#: Bytes of items in one automaton, which every Python worker builds (about 450 bytes of memory for each); more items are scanned for in several passes.
MOST_ITEM_BYTES = 1 << 20

# A word before folding: letters of either case, digits, all beyond ASCII.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
# One byte to one byte: A-Z to a-z; what can't be in a word to a blank; bytes of longer characters stay.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
HIT_COLUMNS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans string"


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8, ASCII letters in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class Matcher:
    """The automaton over all windows of the items."""

    def __init__(self, items: list[tuple[object, str]], window: int = WINDOW):
        patterns: dict[str, tuple[int, set[str]]] = {}
        for item_id, text in items:
            words = words_of(text)
            size = min(window, len(words))
            for i in range(len(words) - size + 1 if size else 0):
                key = " " + b" ".join(words[i : i + size]).decode("latin-1") + " "
                patterns.setdefault(key, (size, set()))[1].add(str(item_id))
        self.automaton = ahocorasick.Automaton()
        for key, (size, ids) in patterns.items():
            self.automaton.add_word(key, (size, tuple(ids)))
        self.empty = not patterns
        if patterns:
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, merged word ranges [first, last) that are hit, ids of the items found."""
        words = words_of(text)
        if self.empty or not words:
            return len(words), [], set()
        flat = b" " + b" ".join(words) + b" "
        ends, ranges, ids = None, [], set()
        for at, (size, found) in self.automaton.iter(flat.decode("latin-1")):
            if ends is None:  # positions of the blank after each word
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            last = int(np.searchsorted(ends, at)) + 1
            ids.update(found)
            if ranges and last - size <= ranges[-1][1]:  # ends come in ascending order
                first = min(ranges[-1][0], last - size)
                while len(ranges) > 1 and ranges[-2][1] >= first:
                    first = min(first, ranges.pop(-2)[0])
                ranges[-1] = (first, last)
            else:
                ranges.append((last - size, last))
        return len(words), ranges, ids


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, without overlaps."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def original_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as code-point ranges of the original text."""
    if not ranges:
        return []
    at = [m.span() for m in WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in ranges]


_matchers: dict[str, Matcher] = {}


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    drop: bool = False,
    most_item_bytes: int = MOST_ITEM_BYTES,
) -> DataFrame:
    """``docs`` scanned against ``items``.

    Returns ``id_col`` and HIT_COLUMNS per document or, with ``drop``, the
    documents without a hit in their own columns.
    """
    spark = docs.sparkSession
    wanted = items.select(F.col(item_id_col).alias("i"), F.col(item_text_col).alias("t")).dropna()
    size = wanted.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    passes = max(1, -(-size // most_item_bytes))

    def matcher_of(part: int) -> Callable[[], Matcher]:
        some = wanted.where(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == part) if passes > 1 else wanted
        shared = spark.sparkContext.broadcast([tuple(r) for r in some.collect()])
        key = uuid.uuid4().hex  # of this call, for the memo of a worker that outlives it

        def matcher() -> Matcher:
            if key not in _matchers:
                _matchers.clear()
                _matchers[key] = Matcher(shared.value, window)
            return _matchers[key]

        return matcher

    if drop:
        text_at = docs.columns.index(text_col)

        def clean_of(matcher: Callable[[], Matcher]):
            def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in sliced(batches):
                    clean = [not matcher().scan(t)[1] for t in batch.column(text_at).to_pylist()]
                    yield batch.filter(pa.array(clean, pa.bool_()))

            return keep

        for part in range(passes):
            docs = docs.mapInArrow(clean_of(matcher_of(part)), docs.schema)
            if part < passes - 1:  # one automaton at a time
                docs = materialized(docs, "clean-so-far")
        return docs

    def more_of(matcher: Callable[[], Matcher]):
        def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                found = []
                for text, flat, ids in zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True):
                    _, ranges, new = matcher().scan(text)
                    ranges = merged([*zip(flat[::2], flat[1::2], strict=True), *ranges])
                    found.append(([x for r in ranges for x in r], sorted({*ids, *new})))
                kinds = (pa.list_(pa.int64()), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, k) for c, k in zip(zip(*found, strict=True) if found else [[], []], kinds, strict=True))], batch.schema.names)

        return more

    def scan_of(matcher: Callable[[], Matcher], before: bool):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                out: list[list] = [[] for _ in range(6)]
                texts = batch.column(1).to_pylist()
                known = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True) if before else (((), ()) for _ in texts)
                for text, (flat, old) in zip(texts, known, strict=True):
                    n, ranges, ids = matcher().scan(text)
                    if flat:
                        ranges, ids = merged([*zip(flat[::2], flat[1::2], strict=True), *ranges]), {*ids, *old}
                    row = (
                        n,
                        sum(b - a for a, b in ranges),
                        len(ids),
                        hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(),
                        bool(ranges),
                        ",".join(f"{a}:{b}" for a, b in original_spans(text, ranges)),
                    )
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(c, t) for c, t in zip(out, types, strict=True))],
                    [id_col, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"],
                )

        return scan

    picked = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    schema = T.StructType([picked.schema[0], *T.StructType.fromDDL(HIT_COLUMNS)])
    if passes > 1:
        picked = picked.withColumns({"__ranges": F.array().cast("array<long>"), "__items": F.array().cast("array<string>")})
        for part in range(passes - 1):
            picked = materialized(picked.mapInArrow(more_of(matcher_of(part)), picked.schema), "hits-so-far")
    return picked.mapInArrow(scan_of(matcher_of(passes - 1), passes > 1), schema)

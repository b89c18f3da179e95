"""SentencePiece encoding and decoding, giant documents by a max-plus scan.

The pieces are those of a given BPE model; results are the library's own.

A sequence of pieces is what BPE makes of a text exactly if every pair of
neighbours is what BPE makes of the pair's text.  So encoding is a path through
a lattice of pieces whose allowed neighbours cost 0 and all others minus
infinity, and it can be cut anywhere: the state at a cut is the piece that
covers the character before it.  A giant document becomes chunks; each yields
the max-plus matrix from the states at its start to those at its end; matrices
are combined in a tree, which is associative; going down the tree gives the
state at every cut; and each chunk then finds its pieces between its two
states on its own.  Where a chunk has a word's start, its matrix is a column
times a row, and what lies between the first and the last such start needs no
states at all.

Other documents are encoded word by word with a memo.

Defined results: a null text has null pieces, an empty one none; a round trip
gives the text back (U+2581 comes back as a blank, as in the library); rows
that repeat get the same pieces each; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialized, sliced

BLANK = "▁"
#: Documents of more characters are giant; their chunks have so many.
GIANT, CHUNK = 65_536, 32_768
NEVER = float("-inf")


class Pieces:
    """A SentencePiece BPE model: the library's encoder with a memo of words, and the lattice."""

    MOST_WORDS, MOST_CHARS = 400_000, 16_000_000

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.library.get_piece_size()
        normal = [i for i in range(size) if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) or self.library.is_unused(i))]
        self.ids = {self.library.id_to_piece(i): i for i in normal}
        self.scores = {p: self.library.get_score(i) for p, i in self.ids.items()}
        self.bytes = {int(self.library.id_to_piece(i)[3:5], 16): i for i in range(size) if self.library.is_byte(i)}
        self.longest = max(map(len, self.ids))
        self.words: dict[str, bytes] = {"": np.array([self.ids[BLANK]], "<u4").tobytes()}
        self.held = 0
        self.pairs: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}

    # ------------------------------------------------------------ library

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers."""
        if self.held > self.MOST_CHARS or len(self.words) > self.MOST_WORDS:
            self.words, self.held = {"": self.words[""]}, 0
        split, missing = [], set()
        for text in texts:
            text = text.replace(BLANK, " ")
            # No piece holds a blank after another character, or a line feed beside any.
            if not text or text[0] == " " or text[-1] == " " or "  " in text or " \n" in text:
                split.append(text)
            else:
                split.append(words := text.replace("\n", " \n").split(" "))
                missing.update(words)
        missing.difference_update(self.words)
        some = list(missing)
        for word, got in zip(some, self.library.encode(some, num_threads=1), strict=True):
            # A line feed starts a word only because of the cut: the blank that the library puts before it goes.
            self.words[word] = np.array(got[1:] if word[:1] == "\n" else got, "<u4").tobytes()
        self.held += sum(map(len, some))
        get = self.words.__getitem__
        return [b"".join(map(get, x)) if isinstance(x, list) else np.array(self.library.encode(x) if x else [], "<u4").tobytes() for x in split]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids)

    # ------------------------------------------------------------ lattice

    def merge(self, text: str) -> list[str]:
        """BPE of a short string of characters, without a blank put before."""
        parts = list(text)
        while len(parts) > 1:
            best, at = NEVER, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1], NEVER)
                if score > best:
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stands(self, piece: str) -> bool:
        """Whether BPE keeps the piece whole; any single character stands."""
        if piece not in self.whole:
            self.whole[piece] = len(piece) == 1 or (piece in self.ids and self.merge(piece) == [piece])
        return self.whole[piece]

    def fits(self, left: str | None, right: str) -> bool:
        """Whether the two may be neighbours."""
        if left is None:
            return True
        key = (left, right)
        if key not in self.pairs:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            self.pairs[key] = self.merge(left + right) == [left, right]
        return self.pairs[key]

    def expand(self, pieces: list[str]) -> list[int]:
        """Ids, bytes for characters that aren't pieces."""
        out: list[int] = []
        for p in pieces:
            out += [self.ids[p]] if p in self.ids else [self.bytes[b] for b in p.encode("utf-8")]
        return out

    def states(self, s: str, cut: int) -> list[tuple[int, int]]:
        """All pieces (start, end) of ``s`` that start before a cut and end at or after it."""
        return [(a, b) for a in range(max(0, cut - self.longest), cut) for b in range(cut, min(len(s), a + self.longest) + 1) if self.stands(s[a:b])]

    def reach(self, s: str, lo: int, hi: int, before: list[tuple[int, int] | None]) -> dict[int, list[tuple[int, int]]]:
        """Pieces reachable from the states ``before`` (None: nothing stands before ``lo``) with starts in [lo, hi).

        By their ends: (start, bit mask of the states that lead there); a start of -1 is None.
        """
        ends: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, state in enumerate(before):
            ends[lo if state is None else state[1]].append((-1 if state is None else state[0], 1 << i))
        for at in range(lo, hi):
            if not (left := ends.get(at)):
                continue
            for end in range(at + 1, min(len(s), at + self.longest) + 1):
                piece = s[at:end]
                if self.stands(piece):
                    mask = 0
                    for start, m in left:
                        if m & ~mask and self.fits(None if start < 0 else s[start:at], piece):
                            mask |= m
                    if mask:
                        ends[end].append((at, mask))
        return ends

    def path(self, s: str, lo: int, hi: int, before: tuple[int, int] | None, after: tuple[int, int] | None) -> list[str]:
        """The pieces with starts in [lo, hi) between two states; ``after`` None: a piece ends at ``hi``."""
        ends = self.reach(s, lo, hi, [before])
        first = -1 if before is None else before[0]
        start_end = lo if before is None else before[1]
        if after is None:
            if start_end == hi and not (before is None and hi > lo):
                return []
            goal = [(a, hi) for a, _ in ends.get(hi, [])]
        else:
            goal = [after]
        for a, b in goal:
            out, (x, y) = [], (a, b)
            while True:
                if (x, y) == (first, start_end):
                    return out[::-1]
                out.append(s[x:y])
                options = [w for w, _ in ends.get(x, []) if self.fits(None if w < 0 else s[w:x], s[x:y])]
                if not options:
                    break
                x, y = options[0], x
        raise ValueError("no path between the states")


def word_starts(s: str, lo: int, hi: int) -> tuple[int, int] | None:
    """First and last place in [lo, hi] where a blank follows another character: every encoding has a cut there."""
    first = lo
    while (first := s.find(BLANK, first, hi + 1)) >= 0:
        if first > 0 and s[first - 1] != BLANK:
            break
        first += 1
    if first < 0:
        return None
    last = hi + 1
    while (last := s.rfind(BLANK, lo, last)) > first and s[last - 1] == BLANK:
        pass
    return first, max(first, last)


class Chunk:
    """A chunk [lo, hi) of a text, in a string that goes beyond it by the longest piece on either side."""

    def __init__(self, pieces: Pieces, s: str, lo: int, hi: int, first: bool, last: bool):
        self.p, self.s, self.lo, self.hi, self.last = pieces, s, lo, hi, last
        self.before: list[tuple[int, int] | None] = [None] if first else list(pieces.states(s, lo))
        self.after: list[tuple[int, int] | None] = [None] if last else list(pieces.states(s, hi))
        self.words = word_starts(s, lo, hi - 1)

    def matrix(self) -> np.ndarray:
        """0 where a path leads from a state at the start to one at the end, minus infinity elsewhere."""
        m = np.full((len(self.before), len(self.after)), NEVER)
        if self.words is None:
            masks = self._masks(self.p.reach(self.s, self.lo, self.hi, self.before))
        else:
            a, b = self.words
            head = self.p.reach(self.s, self.lo, a, self.before)
            left = 0
            for _, mask in head.get(a, []):
                left |= mask
            tail = self._masks(self.p.reach(self.s, b, self.hi, [None]))
            masks = [left if t else 0 for t in tail]
        for j, mask in enumerate(masks):
            for i in range(len(self.before)):
                if mask >> i & 1:
                    m[i, j] = 0.0
        return m

    def _masks(self, ends: dict[int, list[tuple[int, int]]]) -> list[int]:
        if self.last:
            mask = 0
            for _, m in ends.get(self.hi, []):
                mask |= m
            return [mask]
        found = {(a, b): m for b, nodes in ends.items() if b >= self.hi for a, m in nodes}
        return [found.get(state, 0) for state in self.after]

    def ids(self, i: int, j: int) -> list[int]:
        """Ids of the pieces that start in the chunk, between its states i and j."""
        before, after = self.before[i], self.after[j]
        if self.words is None:
            return self.p.expand(self.p.path(self.s, self.lo, self.hi, before, after))
        a, b = self.words
        out = self.p.expand(self.p.path(self.s, self.lo, a, before, None))
        if b > a:
            middle = self.p.encode_batch([self.s[a + 1 : b].replace(BLANK, " ")])[0]
            out += np.frombuffer(middle, "<u4").tolist()
        return out + self.p.expand(self.p.path(self.s, b, self.hi, None, after))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus matrix product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def resolve(matrices: list[np.ndarray]) -> list[int]:
    """The state at every cut on the best path, from the first to the last: a tree of products, then down."""

    def build(lo: int, hi: int) -> tuple:
        if hi - lo == 1:
            return matrices[lo], None, None
        mid = (lo + hi) // 2
        left, right = build(lo, mid), build(mid, hi)
        return product(left[0], right[0]), left, right

    def down(node: tuple, i: int, j: int, out: list[int]) -> None:
        if node[1] is None:
            out.append(j)
            return
        k = int((node[1][0][i] + node[2][0][:, j]).argmax())
        down(node[1], i, k, out)
        down(node[2], k, j, out)

    out = [0]
    down(build(0, len(matrices)), 0, 0, out)
    return out


_loaded: dict[str, Pieces] = {}


def load(path: str) -> Pieces:
    """One model per Python worker."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def chunks_of(text: str, longest: int, chunk: int) -> Iterator[tuple[int, str, int, int, bool, bool]]:
    """(number, string with margins, lo, hi, first, last) of a text with the blank put before it."""
    s = BLANK + text.replace(" ", BLANK)
    for k, c in enumerate(range(0, len(s), chunk)):
        start, end = max(0, c - longest - 1), min(len(s), c + chunk)
        yield k, s[start : min(len(s), end + longest)], c - start, end - start, c == 0, end == len(s)


def _giant(docs: DataFrame, model: str, chunk: int) -> DataFrame:
    """(a, b, ids) for the distinct texts of ``docs`` (a, b: hash of the text; t)."""
    texts = docs.groupBy("a", "b").agg(F.first("t").alias("t"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, t in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rows = [(a, b, *c) for c in chunks_of(t, load(model).longest, chunk)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["a", "b", "k", "s", "lo", "hi", "first", "last"])

    cuts = texts.mapInArrow(cut, "a long, b long, k long, s string, lo long, hi long, first boolean, last boolean")
    cuts = materialized(cuts.repartition("a", "b", "k"), "piece-chunks")

    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, k, *rest = (c.to_pylist() for c in batch.columns)
            found = [Chunk(load(model), *r).matrix() for r in zip(*rest, strict=True)]
            arrays = [pa.array(a), pa.array(b), pa.array(k), pa.array([m.shape[0] for m in found], pa.int32()), pa.array([m.ravel().tolist() for m in found], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["a", "b", "k", "rows", "m"])

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        states = resolve([np.array(m).reshape(n, -1) for n, m in zip(pdf["rows"], pdf["m"], strict=True)])
        return pd.DataFrame({"a": pdf.a, "b": pdf.b, "k": pdf.k, "i": states[:-1], "j": states[1:]})

    matrices = cuts.mapInArrow(transfer, "a long, b long, k long, rows int, m array<double>")
    states = matrices.groupBy("a", "b").applyInPandas(combine, "a long, b long, k long, i long, j long")

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, k, s, lo, hi, first, last, i, j = (c.to_pylist() for c in batch.columns)
            ids = [Chunk(load(model), *r).ids(x, y) for *r, x, y in zip(s, lo, hi, first, last, i, j, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(k), pa.array(ids, pa.list_(pa.int32()))], ["a", "b", "k", "ids"])

    traced = cuts.join(states, ["a", "b", "k"]).mapInArrow(trace, "a long, b long, k long, ids array<int>")
    parts = traced.groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("parts"))
    return parts.select("a", "b", F.flatten("parts.ids").alias("ids"))


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """Per document: id, ids (array of int), n_pieces, ids_crc32 (of little-endian unsigned 32-bit ids), round_trip."""
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("t"))
    large = F.coalesce(F.char_length("t") > giant, F.lit(False))
    short = rows.where(~large).select("*", F.lit(None).cast("array<int>").alias("ids"))
    hashed = rows.where(large).select("*", F.xxhash64("t").alias("a"), F.xxhash64(F.lit("t"), "t").alias("b"))
    long = hashed.join(materialized(_giant(hashed, model, chunk), "giant-pieces"), ["a", "b"]).select(id_col, "t", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts, known = batch.column(1).to_pylist(), batch.column(2)
            todo = [t for t, k in zip(texts, known.is_null().to_pylist(), strict=True) if k and t is not None]
            made = iter(load(model).encode_batch(todo))
            ids: list[np.ndarray | None] = []
            for t, k in zip(texts, known, strict=True):
                ids.append(None if t is None else np.frombuffer(next(made), "<u4") if not k.is_valid else k.values.to_numpy().astype("<u4"))
            back = iter(load(model).decode([x.tolist() for x in ids if x is not None]))
            trip = [None if x is None else next(back) == t.replace(BLANK, " ") for x, t in zip(ids, texts, strict=True)]
            arrays = [
                batch.column(0),
                pa.array([None if x is None else x.astype(np.int32) for x in ids], pa.list_(pa.int32())),
                pa.array([0 if x is None else len(x) for x in ids], pa.int64()),
                pa.array([None if x is None else zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                pa.array(trip, pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, [id_col, "ids", "n_pieces", "ids_crc32", "round_trip"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, ids array<int>, n_pieces long, ids_crc32 long, round_trip boolean"
    return short.unionByName(long).mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id and the text of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1).to_pylist()
            back = iter(load(model).decode([x for x in ids if x is not None]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else next(back) for x in ids], pa.string())], [id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")

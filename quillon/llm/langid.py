"""Language identification from averaged hashed subword embeddings.

A text's letters are cut into byte n-grams with word ends, each n-gram is
hashed to an embedding, the embeddings are averaged, and a linear softmax gives
the language.  Embeddings and weights are trained by stochastic gradient
descent in numpy on a bounded sample of labelled texts; a temperature and the
score below which a text is rejected are calibrated on a part of the sample
that is not trained on.  Executors count the n-grams of the sampled texts, so
that the driver holds at most 65,536 counts of each, however long it is.  The
rest is one pass over whole texts.

Defined results: a null text, and one without a letter, is ``und`` with score 0
and is rejected; with nothing to learn from, every text is ``und`` with score 0
and none is rejected; rows that repeat get the same result each; an empty table
gives an empty result; other columns are ignored (or kept, with ``drop``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, held_out, materialized, sliced

DIMENSIONS = 16
BUCKET_BITS = 16
SIZES = (2, 3, 4)
#: The classifier is fitted on at most so many texts, as many of each language.
MOST_TRAINING_ROWS = 3000
#: Share of right answers, of the calibration part, that may be rejected.
MOST_RIGHT_REJECTED = 0.001
SLICE = 1 << 20

LETTER = regex.compile(r"\p{L}")
_FOLD = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def ngrams(text: str) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a text, a slice at a time."""
    data = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_FOLD).split()) + b" "
    for first in range(0, len(data), SLICE):
        part = np.frombuffer(data, np.uint8, min(SLICE + SIZES[-1] - 1, len(data) - first), first).astype(np.uint32) + np.uint32(1)
        state, out = part.copy(), []
        for n in range(2, SIZES[-1] + 1):
            state = state[:-1] * np.uint32(0x01000193) + part[n - 1 :]
            if n in SIZES:
                mixed = (state ^ (state >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)
                out.append(mixed[:SLICE] >> np.uint32(32 - BUCKET_BITS))
            if len(state) < 2:
                break
        yield np.concatenate(out) if out else np.zeros(0, np.uint32)


@dataclass
class Grams:
    """The n-grams of one whole text: buckets, and how often each occurs."""

    buckets: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, text: str) -> Grams:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for part in ngrams(text):
            total += np.bincount(part, minlength=1 << BUCKET_BITS)
        at = np.flatnonzero(total)
        return cls(at.astype(np.uint16), total[at].astype(np.min_scalar_type(total.max())))

    @classmethod
    def packed(cls, buckets: memoryview, counts: memoryview) -> Grams:
        """Of the bytes of both arrays, which are not copied; counts are as wide as the largest needs."""
        at = np.frombuffer(buckets, "<u2")
        return cls(at, np.frombuffer(counts, f"<u{counts.nbytes // len(at)}") if len(at) else np.zeros(0, np.uint8))

    def drawn(self, draw: np.random.Generator, n: int) -> np.ndarray:
        """n of the text's n-grams, all of them equally likely."""
        ends = np.cumsum(self.counts, dtype=np.int64)
        return self.buckets[np.searchsorted(ends, draw.integers(0, ends[-1], n), side="right")]


@dataclass
class Model:
    """Languages, embeddings, weights, and the calibration."""

    languages: list[str]
    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def __post_init__(self) -> None:
        # The average commutes with the linear layer, so few languages need a few numbers an n-gram only.
        self.table = (self.embeddings @ self.weights.T).astype(np.float32) if len(self.languages) <= DIMENSIONS else None

    def logits_of(self, grams: Grams) -> np.ndarray:
        """The same from counts."""
        mean = grams.counts @ self.embeddings[grams.buckets].astype(np.float64) / max(1, grams.counts.sum())
        return self.weights @ mean + self.bias

    def logits(self, text: str) -> np.ndarray:
        total, n = 0.0, 0
        for grams in ngrams(text):
            source = self.embeddings if self.table is None else self.table
            total = total + source[grams].sum(axis=0, dtype=np.float64)
            n += len(grams)
        mean = total / max(n, 1)
        return (self.weights @ mean if self.table is None else mean) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, and whether the text is rejected."""
        if not self.languages:
            return "und", 0.0, False
        if not text or not LETTER.search(text):
            return "und", 0.0, True
        p = _softmax(self.logits(text) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] < self.least)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[Grams, str]], seed: int = 7, epochs: int = 6) -> Model:
    """``rows``: (n-grams of a text, language)."""
    languages = sorted({lang for _, lang in rows})
    draw = np.random.default_rng(seed)
    embeddings = draw.uniform(-0.05, 0.05, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32)
    weights = draw.normal(0, 0.5, (len(languages), DIMENSIONS)).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    if not rows:
        return Model([], embeddings, weights, bias)
    order = draw.permutation(len(rows))
    n_check = len(rows) // 8
    checked, learned = [rows[i] for i in order[:n_check]], [rows[i] for i in order[n_check:]]
    grams = [g for g, _ in learned]
    labels = np.array([languages.index(lang) for _, lang in learned])
    steps = max(epochs * len(learned), 6000) // 64
    flat = embeddings.reshape(-1)
    for step in range(steps):
        rate = np.float32(1.0 - 0.9 * step / steps)
        some = draw.integers(0, len(learned), 64)
        n = (16, 48, 128)[step % 3]  # short and long texts
        index = np.stack([grams[i].drawn(draw, n) for i in some]).astype(np.int64)
        mean = embeddings[index].mean(axis=1)
        error = _softmax(mean @ weights.T + bias)
        error[np.arange(64), labels[some]] -= 1
        back = (error @ weights) * (rate / n)
        weights -= rate * 0.1 * (error.T @ mean)
        bias -= rate * 0.01 * error.sum(axis=0)
        at = (index[:, :, None] * DIMENSIONS + np.arange(DIMENSIONS)).reshape(-1)
        np.subtract.at(flat, at, np.repeat(back[:, None, :], n, axis=1).reshape(-1))
    model = Model(languages, embeddings, weights, bias)
    if checked:
        logits = np.stack([model.logits_of(g) for g, _ in checked])
        truth = np.array([languages.index(lang) for _, lang in checked])
        losses = {t: -np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in np.geomspace(0.25, 8, 31)}
        model.temperature = float(min(losses, key=losses.get))
        p = _softmax(logits / model.temperature)
        right = p.max(axis=1)[p.argmax(axis=1) == truth]
        if len(right):
            # Never above what an even split of two languages gets.
            model.least = float(min(0.5, np.quantile(right, MOST_RIGHT_REJECTED, method="lower")))
    return model


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_rows: int = MOST_TRAINING_ROWS) -> Model:
    """A model from a bounded sample, even over languages, of the rows that are not held out."""
    rows = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t"), F.col(lang_col).alias("lang"))
    rows = rows.where(~held_out("d") & F.col("lang").isNotNull() & F.col("t").isNotNull())
    counts = materialized(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    n_languages = counts.count()
    if not n_languages:
        return train([])
    each = max(1, most_rows // n_languages)
    picked = F.pmod(F.xxhash64("d", F.lit("lang")), F.lit(1_000_003))
    # Ids are drawn first, so that no text moves that isn't learned from; of a repeated id one row is.
    some = rows.select("d", "lang", picked.alias("p")).join(counts, "lang").where(F.col("p") < F.least(F.lit(1.0), F.lit(float(each)) / F.col("n")) * 1_000_003)
    ids = bounded_sample(some.select("d").distinct(), "d", most_rows)
    some = rows.join(F.broadcast(ids), "d").groupBy("d").agg(F.min(F.struct("t", "lang")).alias("x")).select("d", "x.t", "x.lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [(lang, Grams.of(t)) for t, lang in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True) if LETTER.search(t)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang for lang, _ in found], pa.string()), *(pa.array([x.astype(x.dtype.newbyteorder("<")).tobytes() for _, g in found for x in [getattr(g, n)]], pa.binary()) for n in ("buckets", "counts"))], ["lang", "b", "n"]
            )

    # The driver reads the counts where Arrow has put them: rows of Python would hold them several times over.
    made = some.mapInArrow(count, "lang string, b binary, n binary").toArrow()
    made = made.take(pc.sort_indices(made, [(c, "ascending") for c in made.column_names])).combine_chunks()
    packed = zip(made.column(0), made.column(1), made.column(2), strict=True)
    model = train([(Grams.packed(memoryview(b.as_buffer()), memoryview(n.as_buffer())), lang.as_py()) for lang, b, n in packed if n.as_buffer().size])
    del made, packed
    pa.default_memory_pool().release_unused()
    return model


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", drop: bool = False) -> DataFrame:
    """Per document: id, held_out, lang_pred, score, rejected; or, with ``drop``, the documents that aren't rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    if drop:
        at = docs.columns.index(text_col)

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                yield batch.filter(pa.array([not shared.value.predict(t)[2] for t in batch.column(at).to_pylist()], pa.bool_()))

        return docs.mapInArrow(keep, docs.schema)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [shared.value.predict(t) for t in batch.column(2).to_pylist()]
            lang, score, rejected = zip(*found, strict=True) if found else ((), (), ())
            arrays = [batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, [id_col, "held_out", "lang_pred", "score", "rejected"])

    picked = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).alias("__text"))
    more = T.StructType.fromDDL("held_out boolean, lang_pred string, score double, rejected boolean")
    return picked.mapInArrow(predict, T.StructType([picked.schema[0], *more]))

"""Toxicity with noisy-channel deobfuscation.

Strings that look disguised (leetspeak, letters set apart, letters repeated)
become character lattices: each written character may stand for itself, for the
letters it imitates, or for nothing.  A Viterbi search finds the reading that
is likeliest under a character trigram model, whose counts come from every
document of the corpus, mixed with that of the learned lexicon.  The score of a
text is a logistic regression over the words and word beginnings of the
restored text, learned from a bounded sample of labels.

Defined results: null and empty texts have the score of a text without any
known word; labels that are null, or of unknown documents, teach nothing; with
no toxic or no clean label every score is 0; rows that repeat get the same
score each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, held_out

#: The classifier is fitted on at most so many texts of either label.
MOST_TOXIC, MOST_CLEAN = 4000, 8000
MOST_FEATURES = 1200
BEGINNINGS = (4, 5, 6)
PREDICT_FROM = 0.3

# Letters that a written character imitates.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "*": "aeiou", "(": "c", "€": "e", "£": "l",
}

_SIGNS = "".join(re.escape(c) for c in LEET)
MIXED = re.compile(rf"[^\W\d_][^\s]*[{_SIGNS}]|[{_SIGNS}][^\s]*[^\W\d_]")
SPACED = re.compile(r"(?<![^\W_])[^\W_](?:[ .\-_*][^\W_]){3,}(?![^\W_])")
REPEATED = re.compile(r"([^\W\d_])\1\1")
_EDGES, _BEFORE = "!|+*$().,;:?\"'-_", ".,;:?\"'-_"
_FOLD = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
# Letters a-z are 1 to 26, bytes of other characters 27, all else 0.
_CODE = bytes(b - 96 if 97 <= b <= 122 else 27 if b >= 128 else 0 for b in range(256))
N_CODES = 28


def trigram_counts(texts: Iterable[str]) -> np.ndarray:
    """Counts of character trigrams over whole texts."""
    counts = np.zeros(N_CODES**3, np.int64)
    for text in texts:
        codes = np.frombuffer(b"  " + text.lower().encode("utf-8", "replace") + b"  ", np.uint8)
        codes = np.frombuffer(codes.tobytes().translate(_CODE), np.uint8).astype(np.int32)
        counts += np.bincount((codes[:-2] * N_CODES + codes[1:-1]) * N_CODES + codes[2:], minlength=N_CODES**3)
    return counts


def corpus_trigrams(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Trigram counts over all documents: at most 28^3 rows from each task, then from all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N_CODES**3, np.int64)
        for batch in batches:
            total += trigram_counts(t for t in batch.column(0).to_pylist() if t)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["k", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(N_CODES**3, np.int64)
    for k, n in rows:
        total[k] = n
    return total


class CharacterModel:
    """Costs (negative log probabilities) of a character after two others."""

    def __init__(self, counts: np.ndarray):
        cube = counts.reshape(N_CODES, N_CODES, N_CODES).astype(np.float64)
        two, one = cube.sum(axis=0), cube.sum(axis=(0, 1)) + 1.0
        p1 = one / one.sum()
        p2 = (two + 5.0 * p1) / (two.sum(axis=1, keepdims=True) + 5.0)
        p3 = (cube + 5.0 * p2[None]) / (cube.sum(axis=2, keepdims=True) + 5.0)
        self.p = p3

    def mixed_with(self, other: CharacterModel, share: float) -> CharacterModel:
        new = CharacterModel.__new__(CharacterModel)
        new.p = (1 - share) * self.p + share * other.p
        return new

    @property
    def costs(self) -> list:
        return (-np.log(self.p)).tolist()


def _code(ch: str) -> int:
    return ord(ch) - 96 if "a" <= ch <= "z" else 27 if ch.isalpha() else 0


def lattice(written: str) -> list[list[tuple[str, float]]]:
    """Readings of each character with their channel costs; '' is nothing."""
    out, before = [], ""
    for ch in written:
        if ch.isalpha():
            options = [(ch, 0.0)] + ([("", 0.4)] if ch == before else [])
        elif ch in LEET:
            options = [(x, 0.7) for x in LEET[ch]] + [("", 3.0 if ch != before else 0.7)]
        elif ch == " ":
            options = [("", 0.3), (" ", 2.0)]  # letters set apart, or words of one letter
        else:
            options = [("", 1.0)]
        out.append(options)
        before = ch
    return out


def viterbi(written: str, costs: list) -> str:
    """The likeliest reading of a disguised string."""
    # State: codes of the last two characters read; value: cost and the reading as a chain of pairs.
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for options in lattice(written):
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, chain) in states.items():
            for ch, channel in options:
                if ch:
                    c = _code(ch)
                    state, value = (b, c), (cost + channel + costs[a][b][c], (ch, chain))
                else:
                    state, value = (a, b), (cost + channel, chain)
                if state not in new or value[0] < new[state][0]:
                    new[state] = value
        states = new
    _, chain = min(((cost + costs[a][b][0], chain) for (a, b), (cost, chain) in states.items()), key=lambda x: x[0])
    out = []
    while chain:
        out.append(chain[0])
        chain = chain[1]
    return "".join(reversed(out))


@dataclass
class Model:
    """Character costs, feature weights and bias."""

    costs: list
    words: dict[bytes, float] = field(default_factory=dict)
    beginnings: dict[int, dict[bytes, float]] = field(default_factory=dict)
    bias: float = 0.0
    known: bool = True
    memo: dict[str, str] = field(default_factory=dict)

    def restore(self, written: str) -> str:
        if written not in self.memo:
            if len(self.memo) > 100_000:
                self.memo.clear()
            self.memo[written] = viterbi(written, self.costs)
        return self.memo[written]

    def tokens(self, text: str | None) -> set[bytes]:
        """Distinct words of the text and of what its disguised strings stand for."""
        if not text:
            return set()
        low = text.lower()
        found = set(low.encode("utf-8", "replace").translate(_FOLD).split())
        disguised = set()
        if MIXED.search(low):
            for token in low.split():
                bare = token.rstrip(_EDGES).lstrip(_BEFORE)
                if bare and not bare.isalpha() and MIXED.search(bare):
                    disguised.add(bare)
        for m in SPACED.finditer(low):  # a word of one letter may stand before or after
            disguised.update((m[0], m[0][2:], m[0][:-2]))
        if REPEATED.search(low):
            disguised.update(w.strip(_EDGES) for w in low.split() if REPEATED.search(w))
        for written in disguised:
            found.update(self.restore(written).encode("utf-8", "replace").translate(_FOLD).split())
        return found

    def score(self, text: str | None) -> float:
        if not self.known:
            return 0.0
        words = self.tokens(text)
        total = self.bias + sum(map(self.words.__getitem__, words & self.words.keys()))
        for n, weights in self.beginnings.items():
            total += sum(map(weights.__getitem__, {w[:n] for w in words} & weights.keys()))
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, total))))


def features(words: set[bytes]) -> set[bytes]:
    """A length and so many first bytes of a word; the length 0 stands for whole words."""
    out = {b"\0" + w for w in words}
    for n in BEGINNINGS:
        out.update(bytes([n]) + w[:n] for w in words if len(w) >= n)
    return out


def train(toxic: list[bytes], clean: list[bytes], share_toxic: float, base: CharacterModel) -> Model:
    """From the distinct words, joined by blanks, of texts of either label, the share of toxic ones among all labels, and the corpus' characters.

    Only counts of features are held, never the features of each text.
    """
    model = Model(base.costs)
    if not toxic or not clean:
        model.known = False
        return model
    in_bad: Counter[bytes] = Counter()
    for words in toxic:
        in_bad.update(features(set(words.split())))
    in_bad = Counter({f: n for f, n in in_bad.items() if n >= 3})
    in_good: Counter[bytes] = Counter()
    for words in clean:
        in_good.update(features(set(words.split())) & in_bad.keys())

    def weight(f: bytes) -> float:
        """Likelihood ratio of the feature's counts against no difference; 0 where clean texts have it more often."""
        p, q = in_bad[f], in_good[f]
        share = len(toxic) / (len(toxic) + len(clean))
        expected = (p + q) * share
        return p * math.log(p / expected) + (q * math.log(q / (p + q - expected)) if q else 0.0) if p > expected else 0.0

    scored = sorted(((weight(f), f) for f in in_bad), reverse=True)
    chosen = [f for g, f in scored[:MOST_FEATURES] if g > 4.0]
    del scored, in_bad, in_good
    index = {f: i for i, f in enumerate(chosen)}
    x = np.zeros((len(toxic) + len(clean), len(chosen)), np.float32)
    for i, words in enumerate([*toxic, *clean]):
        x[i, [index[f] for f in features(set(words.split())) & index.keys()]] = 1
    y = np.zeros(len(x), np.float32)
    y[: len(toxic)] = 1
    # Adam on the logistic loss with a small quadratic penalty.
    theta = np.zeros(len(chosen) + 1, np.float64)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, 701):
        error = 1 / (1 + np.exp(-np.clip(x @ theta[1:].astype(np.float32) + theta[0], -30, 30))) - y
        gradient = np.concatenate([[error.mean()], error.astype(np.float32) @ x / len(x) + 4e-6 * theta[1:]])
        m1, m2 = 0.9 * m1 + 0.1 * gradient, 0.999 * m2 + 0.001 * gradient**2
        theta -= 0.05 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    w, b = theta[1:], float(theta[0])
    sampled = len(toxic) / (len(toxic) + len(clean))
    share = min(max(share_toxic, 1e-6), 1 - 1e-6)
    model.bias = b + math.log(share / (1 - share)) - math.log(sampled / (1 - sampled))
    for f, value in zip(chosen, w.tolist(), strict=True):
        if f[0]:
            model.beginnings.setdefault(f[0], {})[f[1:]] = value
        else:
            model.words[f[1:]] = value
    # Disguised strings are likelier words of the lexicon than chance makes them.
    lexicon = [word.decode("utf-8", "ignore") for word, value in model.words.items() if value > 0.5 and len(word) > 3]
    if lexicon:
        model.costs = base.mixed_with(CharacterModel(trigram_counts(lexicon)), 0.5).costs
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> Model:
    """Learns from labels of documents that are not held out."""
    known = labels.select(F.col(id_col).alias("d"), F.col(label_col).cast("int").alias("y")).where(~held_out("d") & F.col("d").isNotNull() & F.col("y").isin(0, 1)).distinct()
    n = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    base = CharacterModel(corpus_trigrams(docs, text_col))
    reader = docs.sparkSession.sparkContext.broadcast(base.costs)
    texts = docs.select(F.col(id_col).alias("d"), F.col(text_col).cast("string").alias("t"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(reader.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b" ".join(sorted(model.tokens(t))) for t in batch.column(1).to_pylist()], pa.binary())], ["d", "words"])

    picked = {}
    for y, most in ((1, most_toxic), (0, most_clean)):
        ids = bounded_sample(known.where(F.col("y") == y).select("d"), "d", most, n.get(y, 0))  # no more ids than ``most``
        # Of a repeated id one row is learned from; of a text only its distinct words reach the driver.
        one = texts.join(F.broadcast(ids), "d").groupBy("d").agg(F.min("t").alias("t")).select("d", "t")
        rows = one.mapInArrow(words, T.StructType([one.schema["d"], T.StructField("words", T.BinaryType())])).collect()
        picked[y] = [bytes(r.words) for r in sorted(rows, key=lambda r: r.d)]
    return train(picked[1], picked[0], n.get(1, 0) / max(1, sum(n.values())), base)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(t) for t in batch.column(2).to_pylist()]
            arrays = [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= PREDICT_FROM) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, [id_col, "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("__text"))
    more = T.StructType.fromDDL("held_out boolean, score double, predicted int")
    return rows.mapInArrow(run, T.StructType([rows.schema[0], *more]))

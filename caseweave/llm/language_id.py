"""Language identification by a sparse multinomial logistic regression on TF-IDF of character n-grams.

Texts are lower-cased and everything but letters counts as one space; n-grams of 1 to 3 characters are hashed to
a fixed number of features. Document frequencies are taken over all labelled rows; the weights are trained on a
bounded sample of them with follow-the-regularised-leader (FTRL-proximal) under an elastic net, whose L1 part
leaves most weights zero; a temperature fitted on rows kept out of training calibrates the scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.llm.common import unused

UNKNOWN = "und"
#: Multiplier and mixer of the n-gram hash (fixed values).
STEP, MIX = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000))
    return _letters[0]


def gram_counts(text: str | None, bits: int = 16, longest: int = 3) -> np.ndarray | None:
    """How often each hashed n-gram occurs in a whole text; None if it has no letter."""
    if not text:
        return None
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _is_letter()[points]
    if not letter.any():
        return None
    points = np.where(letter, points, np.uint32(32)).astype(np.uint32)
    run = np.ones(len(points), bool)
    run[1:] = letter[1:] | letter[:-1]
    points = points[run]
    shift = np.uint32(32 - bits)
    found, h = [], np.zeros(len(points), np.uint32)
    for n in range(longest):
        h = h[: len(points) - n] * STEP + points[n:] + np.uint32(n)
        mixed = h ^ (h >> np.uint32(15))
        found.append((mixed * MIX) >> shift)
    return np.bincount(np.concatenate(found), minlength=1 << bits)


@dataclass
class Model:
    """labels in alphabetical order; idf of each feature; weights (feature, label) and bias; temperature of the scores; the most rarity of a sure prediction."""

    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    most_rarity: float = 0.0

    @property
    def bits(self) -> int:
        return len(self.idf).bit_length() - 1

    def vector(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features and TF-IDF values of unit length, with logarithmic term frequencies."""
        at = np.flatnonzero(counts)
        x = np.log1p(counts[at]) * self.idf[at]
        return at, (x / np.sqrt(x @ x)).astype(np.float32)

    def logits(self, counts: np.ndarray) -> np.ndarray:
        at, x = self.vector(counts)
        return x @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """The likeliest label, its calibrated probability, and whether the text is of a learnt kind; `und`, 0 and false for a null text, one without a letter, or a model without labels."""
        counts = gram_counts(text, self.bits) if self.labels else None
        if counts is None:
            return UNKNOWN, 0.0, False
        p = softmax(self.logits(counts).astype(np.float64) / self.temperature)
        k = int(p.argmax())
        return self.labels[k], float(p[k]), rarity(counts, self.idf) <= self.most_rarity


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """FTRL-proximal for multinomial logistic regression with an elastic net."""

    def __init__(self, features: int, labels: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.z = np.zeros((features + 1, labels))
        self.n = np.zeros((features + 1, labels))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        """One step on a row; the last feature is the bias."""
        at, x = np.append(at, len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(at)
        p = softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of the least log loss, by narrowing a range of its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        return -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-12)).mean()

    low, high = np.log(0.02), np.log(20.0)
    for _ in range(60):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def rarity(counts: np.ndarray, idf: np.ndarray) -> float:
    """The mean inverse document frequency of a text's n-grams."""
    return float(counts @ idf / counts.sum())


def most_rarity(found: list[float], quantile: float = 0.99, room: float = 1.2) -> float:
    """Up to which rarity a text is of the learnt kind: `room` times what all but a hundredth of the rows kept out of training stay below.

    Probabilities don't tell, as they compare the learnt languages alone: texts in another language or script, and
    letters without sense, may get a high one, but their n-grams are rare in all labelled rows.
    """
    return room * float(np.quantile(found, quantile)) if found else 0.0


def document_frequencies(docs: DataFrame, bits: int) -> tuple[np.ndarray, int]:
    """In how many rows of docs (text) each feature occurs, and how many rows have a letter. What reaches the driver is bounded by the number of features."""

    def count(batches):
        import pyarrow as pa

        seen, rows = np.zeros((1 << bits) + 1, np.int64), 0
        for batch in batches:
            for text in batch.column("text"):
                counts = gram_counts(text.as_py(), bits)
                if counts is not None:
                    seen[:-1] += counts > 0
                    rows += 1
        seen[-1] = rows
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["feature", "n"])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    frequencies = np.zeros((1 << bits) + 1, np.int64)
    for r in found.collect():
        frequencies[r["feature"]] = r["n"]
    return frequencies[:-1], int(frequencies[-1])


def _sample(docs: DataFrame, most_rows: int, bits: int) -> list:
    """About `most_rows` rows of docs (text, lang) as (lang, features, counts), as many of each label, picked by a hash of the row."""
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    each = most_rows / max(1, len(sizes))
    share = F.lit(0.0)
    for lang, n in sorted(sizes.items()):
        share = F.when(F.col("lang") == lang, min(1.0, each / n)).otherwise(share)
    place = F.pmod(F.xxhash64("text", "_salt"), F.lit(1 << 30)) / float(1 << 30)

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                counts = gram_counts(text.as_py(), bits)
                if counts is not None:
                    at = np.flatnonzero(counts)
                    rows.append((lang, at.astype("<u4").tobytes(), counts[at].astype("<u4").tobytes()))
            columns = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.binary(), pa.binary()), strict=True)], names=["lang", "at", "counts"])

    picked = docs.where(place < share).select("lang", "text").mapInArrow(count, "lang string, at binary, counts binary")
    return sorted((r["lang"], bytes(r["at"]), bytes(r["counts"])) for r in picked.collect())


def fit(docs: DataFrame, most_rows: int = 4000, bits: int = 16, passes: int = 3, seed: int = 7) -> Model:
    """A model of the labels in docs (doc_id, text, lang). Rows with a null text or label teach nothing.

    Frequencies cover all rows; the weights and the temperature use a sample of about `most_rows` rows, as many
    of each label, of which every fifth is kept for the temperature.
    """
    typed = docs.select(F.col("doc_id").cast("string").alias("_salt"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    labelled = typed.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    frequencies, rows = document_frequencies(labelled, bits)
    idf = np.log((1 + rows) / (1 + frequencies)) + 1
    sample = _sample(labelled, most_rows, bits)
    labels = sorted({r[0] for r in sample})
    model = Model(labels, idf, np.zeros((1 << bits, len(labels)), np.float32), np.zeros(len(labels)))
    order = np.random.default_rng(seed).permutation(len(sample))
    vectors, rare = [], []
    for lang, at, counts in sample:
        x = np.zeros(1 << bits, np.int64)
        x[np.frombuffer(at, "<u4")] = np.frombuffer(counts, "<u4")
        vectors.append((*model.vector(x), labels.index(lang)))
        rare.append(rarity(x, idf))
    model.most_rarity = most_rarity([rare[k] for k in order[::5]])
    kept_out = [vectors[k] for k in order[::5]]
    learner = Ftrl(1 << bits, len(labels))
    for _ in range(passes):
        for j, k in enumerate(order):
            if j % 5:
                learner.learn(*vectors[k])
    if labels:
        whole = learner.weights(slice(None))
        model.weights, model.bias = whole[:-1].astype(np.float32), whole[-1]
        scores = np.array([x @ model.weights[at] + model.bias for at, x, _ in kept_out])
        scores, own = scores.reshape(len(kept_out), -1), np.array([y for *_, y in kept_out], int)
        model.temperature = fit_temperature(scores, own)
    return model


def predict(docs: DataFrame, model: Model, columns: list[str] | None = None) -> DataFrame:
    """docs (text and any more columns, of which `columns` are kept, or all; those with the name of a result give way) with lang_pred, score and sure (whether the text has a letter and n-grams as common as in the learnt languages)."""
    names = [c for c in (columns or docs.columns) if c.lower() not in ("lang_pred", "score", "sure")]
    whole = unused(docs, "_text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by features and labels

    def judge(batches):
        import pyarrow as pa

        for batch in batches:
            found = [shared.value.predict(text.as_py()) for text in batch.column(whole)]
            out = batch.select(names)
            yield out.append_column("lang_pred", pa.array([x[0] for x in found], pa.string())).append_column("score", pa.array([x[1] for x in found], pa.float64())).append_column("sure", pa.array([x[2] for x in found], pa.bool_()))

    plain = docs.select(*names, F.col("text").cast("string").alias(whole))
    return plain.mapInArrow(judge, docs.select(*names).schema.add("lang_pred", "string").add("score", "double").add("sure", "boolean"))


def held_out(doc_id: str) -> Column:
    """Whether a document is kept out of training: crc32 of its id as text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, most_rows: int = 4000, columns: list[str] | None = None) -> DataFrame:
    """Fit on the documents that are not held out and predict all: the chosen columns, held_out, lang_pred, score and sure. Rows with a null id teach nothing.

    Columns of docs with the name of a result give way. Repeated rows are rows like any other, in learning too.
    """
    model = fit(docs.where(~held_out("doc_id") & F.col("doc_id").isNotNull()), most_rows)
    names = [c for c in (columns or docs.columns) if c.lower() != "held_out"]
    return predict(docs.withColumn("held_out", held_out("doc_id")), model, [*names, "held_out"])

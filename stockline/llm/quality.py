"""Quality classifier: naive Bayes support vectors over n-gram indicators.

A word is read as its shape: case, digits, and what it ends with. The n-grams are one to three such shapes
in a row, two-word ones also saying whether the words are the same; an indicator says that an n-gram makes
up at least a given share of a text, so a long text does not collect every indicator. The indicators are
scaled by the log-count ratio of the two classes, and a linear model with hinge loss is fitted to them by
dual coordinate descent. The fit uses a bounded sample of labelled rows (``SAMPLE`` per class, chosen by a
hash of the id); scoring reads every text as a whole.

Defined cases: null and empty texts have an indicator of their own and get a score like any other. Without
labelled rows of both classes the score is the share of label 1 in the sample, or 0.5. Repeated rows give
repeated results; null doc_ids are scored and never used to learn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockline.llm.common import mix, remainder, texts, worker_value
from stockline.llm.linear import dual_descent, margin_scale, probability

#: Labelled rows per class that the model is fitted to at most.
SAMPLE = 3000
#: An indicator of an n-gram for each of these shares of a text's n-grams of its length.
SHARES = np.array([0.0, 1 / 64, 1 / 16, 1 / 8, 1 / 4, 1 / 2])
SHAPES, PAIRS, TRIPLES = 64, 2 * 64 * 64, 1 << 13
GRAMS = SHAPES + PAIRS + TRIPLES
EMPTY = GRAMS * len(SHARES)
DIMS = EMPTY + 1
KEPT_WORDS = 600_000


def word_shape(word: str) -> int:
    """Case (5), digits (2) and ending (5) of a word as one number below 50."""
    letters = [c for c in word if c.isalpha()]
    if not letters:
        case = 0
    elif word.upper() != word.lower() and all(c == c.upper() for c in letters):
        case = 1 if len(letters) > 1 else 2
    elif letters[0] != letters[0].lower() and all(c == c.lower() for c in letters[1:]):
        case = 2
    else:
        case = 3 if all(c == c.lower() for c in letters) else 4
    last = word[-1:]
    run = len(word) - len(word.rstrip("!?*#$%&|=+~^<>@_-/\\"))
    ending = 0 if last.isalnum() else 1 if last in ".,;:" else 2 if run == 1 else 3 if run > 1 else 4
    return (case * 2 + any(c.isdigit() for c in word)) * 5 + ending


class _Shapes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = shape = word_shape(word)
        return shape


def indicators(text: str) -> np.ndarray:
    """The sorted indicators that hold for a whole text."""
    words = text.split()
    if not words:
        return np.array([EMPTY], np.int64)
    shape_of = worker_value("word shapes", _Shapes)
    shapes = np.fromiter(map(shape_of.__getitem__, words), np.int64, len(words))
    same = np.fromiter(map(hash, words), np.int64, len(words))
    grams = [shapes]
    if len(words) > 1:
        grams.append(SHAPES + (shapes[:-1] * 64 + shapes[1:]) * 2 + (same[:-1] == same[1:]))
    if len(words) > 2:
        triple = (shapes[:-2] * 64 + shapes[1:-1]) * 64 + shapes[2:]
        grams.append(SHAPES + PAIRS + (mix(triple.astype(np.uint64)) % np.uint64(TRIPLES)).astype(np.int64))
    found = []
    for part in grams:
        codes, counts = np.unique(part, return_counts=True)
        held = (counts / len(part))[:, None] >= SHARES
        found.append((codes[:, None] * len(SHARES) + np.arange(len(SHARES)))[held])
    return np.concatenate(found)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, divisor: int, held: int,
                    most: int = SAMPLE) -> DataFrame:
    """Texts and labels of at most ``most`` labelled rows per class outside the held-out rows.

    The chosen ids are at most twice ``most``, which bounds the broadcast; of an id that stands on several rows one text
    is taken, which bounds what is learned from, too.
    """
    rows = (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label"))
            .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (remainder("doc_id", divisor) != held))
            .dropDuplicates(["doc_id"]))
    chosen = [rows.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for k in (0, 1)]
    ids = chosen[0].unionByName(chosen[1])
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = named.join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select(
        "doc_id", "text", "label")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["label"],
             pa.array([indicators(t).astype("<i4").tobytes() for t in texts(batch["text"])], pa.binary())],
            ["doc_id", "label", "indicators"])


class QualityModel:
    """Weights per indicator (log-count ratio and support vectors together) and the curve to probabilities."""

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray):
        self.ratio = self.weights = None
        self.prior = float(labels.mean()) if len(labels) else 0.5
        if len(set(labels.tolist())) < 2:
            return
        counts = [np.ones(DIMS), np.ones(DIMS)]
        for at, y in zip(rows, labels.tolist(), strict=True):
            counts[y][at] += 1
        self.ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
        signs = np.where(labels == 1, 1, -1)
        self.weights = dual_descent([self._row(at) for at in rows], signs, DIMS)
        self.scale = margin_scale(np.array([self.margin(at) for at in rows]), signs)

    def _row(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values = self.ratio[at]
        return at, values / max(float(np.sqrt(values @ values)), 1e-9)

    def margin(self, at: np.ndarray) -> float:
        at, values = self._row(at)
        return float(self.weights[at] @ values + self.weights[-1])

    def score(self, text: str) -> float:
        return self.prior if self.weights is None else float(probability(self.margin(indicators(text)), self.scale))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", divisor: int = 4, held: int = 2) -> QualityModel:
    sample = labelled_sample(docs, labels, label, divisor, held)
    rows = sample.mapInArrow(_features, "doc_id bigint, label int, indicators binary").orderBy("doc_id").collect()
    return QualityModel([np.frombuffer(r.indicators, "<i4").astype(np.int64) for r in rows],
                        np.array([r.label for r in rows], np.int64))


def score_column(model, schema_name: str = "score"):
    """A map over (doc_id, text) batches that adds a model's score of each whole text."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([model.score(t) for t in texts(batch["text"])], pa.float64())],
                ["doc_id", schema_name])

    return score


def score_quality(docs: DataFrame, model: QualityModel, threshold: float, divisor: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = named.mapInArrow(score_column(model), "doc_id bigint, score double")
    return scored.select("doc_id", F.coalesce(remainder("doc_id", divisor) == held, F.lit(False)).alias("held_out"),
                         "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_rows(docs: DataFrame, keep) -> DataFrame:
    """The rows of ``docs``, all columns, for whose texts ``keep`` (a list of texts to a list of booleans) holds."""
    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep(texts(batch["text"].cast(pa.string()))), pa.bool_()))

    return docs.mapInArrow(select, docs.schema)

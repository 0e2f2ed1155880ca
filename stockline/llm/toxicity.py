"""Toxicity by a gap-tolerant subsequence kernel with Nyström landmarks and a linear hinge-loss model.

A text is a stream of letters of any script: Latin letters without their marks, other letters as they are, ideographs and
syllables as two letters each (they carry as much). Anything between two words is one separator; letters that stand alone
one after another ("i d i o t", "i*d*i*o*t") are moved together. The kernel counts common subsequences of four letters
spread over at most six places, each place beyond four costing a factor, so an inserted character weakens a match and
does not end it. Words of two or three letters take the word's edges as letters.

Landmarks are the word beginnings (short words whole, runs of two to four ideographs) that tell toxic labelled texts
from clean ones, and the most usual clean ones. Examples are every window from a telling word on in a toxic text, and of
a clean text the mean over all its windows, some single ones, and the worst one under the first model. The kernel's map to
the landmarks, the whitening of their kernel matrix and the linear model are folded into one weight per subsequence of
landmark letters, which makes scoring one pass over a whole text; letters that no landmark has match nothing. A text's
score is that of its worst window.

The fit uses a bounded sample of labelled rows (``SAMPLE`` per class, chosen by a hash of the id), ``CLEAN_WINDOWS`` single
windows of a clean one, and at most ``TOXIC_LANDMARKS`` telling stems, the most frequent ones.

Defined cases: null and empty texts score as a text without any window. Without labelled rows of both classes
the score is the share of toxic rows in the sample, or 0. Repeated rows give repeated results; null doc_ids
are scored and never used to learn. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockline.llm.common import remainder, stored, texts, worker_value
from stockline.llm.linear import dual_descent, margin_scale, probability
from stockline.llm.quality import labelled_sample, score_column

SAMPLE = 3000
#: Letters of a subsequence, places it may spread over, factor per extra place, letters of a window.
LETTERS, SPREAD, GAP, WINDOW = 4, 6, 0.6, 12
PATTERNS = [(0, *rest) for rest in combinations(range(1, SPREAD), LETTERS - 1)]
TOXIC_LANDMARKS, CLEAN_LANDMARKS = 64, 64
#: Single windows of a clean sample text that serve as examples beside the mean over all.
CLEAN_WINDOWS = 8
#: A stem has at most so many letters; it tells if in so many toxic texts and with such log odds.
STEM, LEAST_TEXTS, LEAST_ODDS = 10, 2, 3.0
ROUNDS = 2
#: Clean sample texts that are to score below ``SURE``.
CLEAN_SHARE, SURE = 0.97, 0.7
#: Bits of a subsequence's number; above, numbers are hashed.
EXACT_BITS, HASHED_BITS = 24, 24
_HALF = 1 << 21
_WIDE = "\u3040-\u30ff\u3400-\u9fff\uac00-\ud7a3\uf900-\ufaff\U00020000-\U0003ffff"
_RUNS = re.compile(f"[{_WIDE}]+|[^\\W\\d_{_WIDE}]+")
_SENTENCES = re.compile(r"[.!?\n\u3002\uff01\uff1f]+")


def _letters() -> np.ndarray:
    """The letter that each code point stands for (0: none). Latin letters lose their marks, wide ones are negative."""
    table = np.zeros(0x110000, np.int32)
    wide = re.compile(f"[{_WIDE}]")
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            if wide.match(c):
                table[point] = -point
                continue
            base = unicodedata.normalize("NFD", c)[0] if 0xC0 <= point < 0x250 or 0x1E00 <= point < 0x1F00 else c
            table[point] = ord(base.lower()) if len(base.lower()) == 1 else point
    return table


def letter_stream(text: str) -> np.ndarray:
    """Letters of a text, runs of other characters as one 0, lone letters in a row moved together."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    codes = worker_value("letters of code points", _letters)[points]
    wide = codes < 0
    if wide.any():
        places = np.repeat(np.arange(len(codes)), 1 + wide)
        second = np.concatenate([[False], places[1:] == places[:-1]])
        codes, wide = codes[places], wide[places]
        codes = np.where(wide, np.where(second, 2 * _HALF + (-codes & 127), _HALF + (-codes >> 7)), codes)
    keep = codes > 0
    if len(keep):
        keep[1:] |= codes[:-1] > 0
    codes = codes[keep]
    if len(codes) > 4:
        gap = codes == 0
        lone = np.zeros(len(codes), bool)
        lone[1:-1] = ~gap[1:-1] & gap[:-2] & gap[2:]
        lone[0], lone[-1] = ~gap[0] & gap[1], ~gap[-1] & gap[-2]
        between = np.zeros(len(codes), bool)
        between[1:-1] = gap[1:-1] & lone[:-2] & lone[2:]
        codes = codes[~between]
    return codes


class Alphabet:
    """Small codes for the letters of the landmarks (0: separator, last: any other letter), and numbers of subsequences."""

    def __init__(self, streams: list[np.ndarray]):
        self.letters = np.unique(np.concatenate([np.zeros(1, np.int32), *streams]))[1:]
        self.other = len(self.letters) + 1
        self.bits = max(5, self.other.bit_length())
        self.exact = LETTERS * self.bits <= EXACT_BITS
        self.size = 1 << (LETTERS * self.bits if self.exact else HASHED_BITS)

    def codes(self, stream: np.ndarray, edge: bool = True) -> np.ndarray:
        """The stream in small codes, begun by the edge of its first word unless it begins inside one."""
        at = np.minimum(np.searchsorted(self.letters, stream), max(len(self.letters) - 1, 0))
        known = self.letters[at] == stream if len(self.letters) else np.zeros(len(stream), bool)
        codes = np.where(known, at + 1, np.where(stream == 0, 0, self.other)).astype(np.int64)
        return np.concatenate([np.zeros(1, np.int64), codes]) if edge else codes

    def numbers(self, a, b, c, d):
        if self.exact:
            return ((a << self.bits | b) << self.bits | c) << self.bits | d
        mixed = (a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D + d * 0x27D4EB2F) & 0xFFFFFFFF
        return (mixed ^ mixed >> 15) * 0x2C1B3C6D >> 7 & self.size - 1

    def subsequences(self, codes: np.ndarray) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """For each pattern its weight, the numbers at every place, and which of them are features: letters of landmarks
        with, at the outer places, a letter or a word's edge."""
        padded = np.concatenate([codes, np.zeros(SPREAD, np.int64)])
        at = [padded[k:k + len(codes)] for k in range(SPREAD)]
        inner, outer = [(x > 0) & (x < self.other) for x in at], [x < self.other for x in at]
        for _, a, b, c in PATTERNS:
            yield GAP ** (c + 1 - LETTERS), self.numbers(at[0], at[a], at[b], at[c]), outer[0] & inner[a] & inner[b] & outer[c]

    def features(self, codes: np.ndarray) -> dict[int, float]:
        """The kernel's features of a stream: weight by subsequence."""
        found: dict[int, float] = {}
        for weight, numbers, holds in self.subsequences(codes):
            for number in numbers[holds].tolist():
                found[number] = found.get(number, 0.0) + weight
        return found

    def inside(self, codes: np.ndarray) -> dict[int, float]:
        """The features of a word's letters alone, without its edges."""
        return self.features(np.concatenate([codes, np.full(SPREAD, self.other)]))


def window_sums(weights: np.ndarray) -> np.ndarray:
    """Sums over the subsequences that begin in each window."""
    width = WINDOW - LETTERS + 1
    sums = np.concatenate([[0.0], np.cumsum(weights, dtype=np.float64)])
    ends = np.minimum(np.arange(len(weights)) + width, len(weights))
    return sums[ends] - sums[:len(weights)]


class ToxicityModel:
    """Weight by subsequence, and the curve from the worst window to a probability."""

    def __init__(self, prior: float):
        self.prior, self.alphabet, self.scale = prior, None, (1.0, 0.0)

    def learned(self, alphabet: Alphabet, numbers: np.ndarray, weights: np.ndarray) -> None:
        self.alphabet, self.numbers, self.weights, self.name = alphabet, numbers, weights.astype(np.float32), uuid.uuid4().hex

    def _tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Small codes by letter, and weights by subsequence: dense, so each worker builds its own."""
        codes = np.full(2 * _HALF + 128, self.alphabet.other, np.int32)
        codes[0] = 0
        codes[self.alphabet.letters] = np.arange(1, len(self.alphabet.letters) + 1)
        table = np.zeros(self.alphabet.size, np.float32)
        table[self.numbers] = self.weights
        return codes, table

    def position_weights(self, stream: np.ndarray) -> np.ndarray:
        """For each place, the edge of the first word being the first, the summed weights of the subsequences that begin
        there."""
        codes, table = worker_value(("toxicity", self.name), self._tables)
        small = np.concatenate([np.zeros(1, np.int32), codes[stream], np.zeros(SPREAD, np.int32)])
        if not self.alphabet.exact:
            small = small.astype(np.int64)
        n = len(stream) + 1
        at, total = [small[k:k + n] for k in range(SPREAD)], np.zeros(n, np.float32)
        for _, a, b, c in PATTERNS:
            total += np.float32(GAP ** (c + 1 - LETTERS)) * table[self.alphabet.numbers(at[0], at[a], at[b], at[c])]
        return total

    def worst(self, text: str) -> tuple[float, np.ndarray]:
        """The sum of a text's worst window, and that window's letters (with the edge it may begin with)."""
        stream = letter_stream(text)
        if not len(stream):
            return 0.0, stream
        sums = window_sums(self.position_weights(stream))
        at = int(sums.argmax())
        return float(sums[at]), np.concatenate([np.zeros(1, np.int32), stream])[at:at + WINDOW]

    def margin(self, text: str) -> float:
        return self.worst(text)[0]

    def score(self, text: str) -> float:
        return self.prior if self.alphabet is None else float(probability(self.margin(text), self.scale))


class Landmarks:
    """The landmark words' features, and examples mapped to the whitened landmark space."""

    def __init__(self, words: list[str]):
        streams = [letter_stream(w) for w in words]
        self.alphabet = Alphabet(streams)
        features = [self._of_word(stream) for stream in streams]
        features = [f for f in features if f]
        self.numbers = np.array(sorted({c for f in features for c in f}), np.int64)
        self.rows = np.zeros((len(self.numbers), len(features)))
        for k, f in enumerate(features):
            norm = np.sqrt(sum(v * v for v in f.values()))
            self.rows[np.searchsorted(self.numbers, list(f)), k] = np.array(list(f.values())) / norm
        values, vectors = np.linalg.eigh(self.rows.T @ self.rows)
        self.whiten = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T

    def _of_word(self, stream: np.ndarray) -> dict[int, float]:
        """Short words have their edges, others the letters they begin with, wherever these stand."""
        if (stream > 0).sum() < LETTERS:
            return self.alphabet.features(self.alphabet.codes(stream))
        return self.alphabet.inside(self.alphabet.codes(stream, edge=False))

    def sums(self, stream: np.ndarray, edge: bool = True) -> np.ndarray:
        """The landmarks' features in a stream of any length, summed up."""
        found = np.zeros(len(self.numbers))
        if len(self.numbers):
            for weight, numbers, holds in self.alphabet.subsequences(self.alphabet.codes(stream, edge)):
                at = np.minimum(np.searchsorted(self.numbers, numbers), len(self.numbers) - 1)
                hit = holds & (self.numbers[at] == numbers)
                found += weight * np.bincount(at[hit], minlength=len(found))
        return found

    def map(self, sums: np.ndarray) -> np.ndarray:
        return sums @ self.rows @ self.whiten

    def fold(self, weights: np.ndarray) -> np.ndarray:
        """The linear model as one weight per subsequence."""
        return self.rows @ (self.whiten @ weights)


def stems(run: str) -> list[str]:
    """What may tell toxic texts of a word: its beginnings, longest first, or all of it if it is short."""
    if len(run) < LETTERS:
        return [run + " "] if len(run) > 1 else []
    return [run[:n] for n in range(min(len(run), STEM), LETTERS - 1, -1)]


def places(sentence: str) -> Iterator[tuple[int, list[str]]]:
    """Where something telling may begin, and the stems that begin there."""
    for run in _RUNS.finditer(sentence):
        text = run.group()
        if worker_value("letters of code points", _letters)[ord(text[0])] < 0:
            for k in range(len(text) - 1):
                yield run.start() + k, [text[k:k + n] for n in (4, 3, 2) if k + n <= len(text)]
        else:
            yield run.start(), stems(text)


def _stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of either class that hold each stem."""
    for batch in batches:
        counts: dict[str, list[int]] = {}
        for text, label in zip(texts(batch["text"]), batch["label"].to_pylist(), strict=True):
            for stem in {s for _, found in places(text.lower()) for s in found}:
                counts.setdefault(stem, [0, 0])[label] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()),
             pa.array([c[1] for c in counts.values()], pa.int64())], ["stem", "clean", "toxic"])


def choose_telling(found: list[tuple[str, int]]) -> list[str]:
    """Telling stems, most frequent first, without those that only lengthen or shorten a chosen one."""
    chosen: list[str] = []
    for stem, _ in sorted(found, key=lambda f: (-f[1], -len(f[0]), f[0])):
        if len(chosen) < TOXIC_LANDMARKS and not any(stem.startswith(c) or c.startswith(stem) for c in chosen):
            chosen.append(stem)
    return chosen


def _examples(landmarks: Landmarks, telling: frozenset):
    """Examples of labelled texts: every window from a telling word on in toxic ones; in clean ones the mean over all
    windows and ``CLEAN_WINDOWS`` single ones from words that are spread evenly over the text."""
    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, found = [], []
            for text, label in zip(texts(batch["text"]), batch["label"].to_pylist(), strict=True):
                windows, sums = [], []
                for sentence in _SENTENCES.split(text.lower()):
                    windows += [sentence[at:at + WINDOW] for at, of in places(sentence)
                                if of and (not label or not telling.isdisjoint(of))]
                if not label:
                    windows = [windows[k] for k in np.linspace(0, len(windows) - 1, min(len(windows), CLEAN_WINDOWS))
                               .round().astype(int)]
                    stream = letter_stream(text)
                    sums.append(landmarks.sums(stream) * (WINDOW - LETTERS + 1) / max(len(stream), 1))
                sums += [landmarks.sums(letter_stream(w)) for w in windows]
                labels += [label] * len(sums)
                found += [landmarks.map(x).astype(np.float32).tobytes() for x in sums]
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(found, pa.binary())], ["label", "example"])

    return examples


def _worst_windows(model: ToxicityModel):
    """Each text's worst window and its margin."""
    def worst(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.worst(text) for text in texts(batch["text"])]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["label"], pa.array([m for m, _ in found], pa.float64()),
                 pa.array([w.astype("<i4").tobytes() for _, w in found], pa.binary())],
                ["doc_id", "label", "margin", "example"])

    return worst


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", divisor: int = 3, held: int = 1) -> ToxicityModel:
    sample = stored(labelled_sample(docs, labels, label, divisor, held, SAMPLE), "labelled")
    sizes = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    model = ToxicityModel(sizes.get(1, 0) / max(1, sum(sizes.values())))
    if len(sizes) < 2:
        return model
    counts = sample.mapInArrow(_stem_counts, "stem string, clean bigint, toxic bigint").groupBy("stem").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = stored(counts, "stems")
    odds = F.log((F.col("toxic") + 0.5) / (sizes[1] + 1.0)) - F.log((F.col("clean") + 0.5) / (sizes[0] + 1.0))
    found = (counts.where((F.col("toxic") >= LEAST_TEXTS) & (odds > LEAST_ODDS)).orderBy(F.desc("toxic"), "stem")
             .limit(16 * TOXIC_LANDMARKS).collect())
    telling = choose_telling([(r.stem, r.toxic) for r in found])
    usual = [r.stem for r in counts.where(F.length("stem") >= LETTERS).orderBy(F.desc("clean"), "stem")
             .limit(CLEAN_LANDMARKS).collect()]
    if not telling:
        return model
    landmarks = Landmarks(telling + [w for w in usual if w not in set(telling)])
    found = sample.orderBy("doc_id").mapInArrow(_examples(landmarks, frozenset(telling)), "label int, example binary").collect()
    examples, signs = [np.frombuffer(r.example, np.float32) for r in found], [1 if r.label else -1 for r in found]
    every = np.arange(landmarks.rows.shape[1])
    for _ in range(ROUNDS):
        weights = dual_descent([(every, row) for row in examples], np.array(signs), len(every), cost=10.0, epochs=15)
        model.learned(landmarks.alphabet, landmarks.numbers, landmarks.fold(weights[:-1]))
        worst = sample.mapInArrow(_worst_windows(model), "doc_id bigint, label int, margin double, example binary"
                                  ).orderBy("doc_id").collect()
        clean = [landmarks.map(landmarks.sums(np.frombuffer(r.example, "<i4"), edge=False)) for r in worst if not r.label]
        examples, signs = examples + clean, signs + [-1] * len(clean)
    margins, toxic = np.array([r.margin for r in worst]), np.array([bool(r.label) for r in worst])
    slope, offset = margin_scale(margins, np.where(toxic, 1, -1))
    # A score of SURE is not given to more than the rest of CLEAN_SHARE of the clean sample.
    least = np.quantile(margins[~toxic], CLEAN_SHARE)
    model.scale = slope, min(offset, float(np.log(SURE / (1 - SURE))) - slope * float(least))
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float, divisor: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = named.mapInArrow(score_column(model), "doc_id bigint, score double")
    return scored.select("doc_id", F.coalesce(remainder("doc_id", divisor) == held, F.lit(False)).alias("held_out"),
                         "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

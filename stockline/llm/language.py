"""Language ID by rank-order profiles.

A language's profile is its most frequent letter n-grams (one to three, with blanks around words), in order.
A document's own most frequent n-grams are ranked the same way; for each language the ranks' displacements
are summed, an n-gram the profile lacks counting as the whole profile length, and the language with the least
sum is predicted. The n-grams of all documents outside the held-out rows that have a language are counted.

Defined cases: a text that is null or has no letter is ``und`` with score 0. Ties go to the language that sorts
first. Without any profile everything is ``und``. Repeated rows count, and are predicted, each time; null
doc_ids are predicted and never used to learn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stockline.llm.common import remainder, texts, worker_value

#: n-grams of a profile, and the n-grams of a document that are ranked.
PROFILE = 400
BLANK = 32
#: Distinct n-grams a task holds before it hands its counts on.
HELD_GRAMS = 400_000
UNKNOWN = "und"


def _letters() -> np.ndarray:
    return np.array([chr(p).isalpha() for p in range(1 << 16)])


def gram_codes(text: str) -> np.ndarray:
    """All n-grams of a text as numbers: 21 bits a character, first one lowest. Empty without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    letter = worker_value("letters", _letters)[np.minimum(points, 0xFFFF)]
    high = points > 0xFFFF
    if high.any():
        letter[high] = [chr(p).isalpha() for p in points[high].tolist()]
    if not letter.any():
        return np.zeros(0, np.int64)
    points = np.concatenate([[BLANK], np.where(letter, points, BLANK), [BLANK]])
    letter = np.concatenate([[False], letter, [False]])
    pairs = points[:-1] | points[1:] << 21
    return np.concatenate([points[letter], pairs[letter[:-1] | letter[1:]],
                           (pairs[:-1] | points[2:] << 42)[letter[1:-1]]])


def ranked(codes: np.ndarray) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by code."""
    grams, counts = np.unique(codes, return_counts=True)
    if len(grams) > PROFILE:
        least = np.partition(counts, len(counts) - PROFILE)[len(counts) - PROFILE]
        held = counts >= least
        grams, counts = grams[held], counts[held]
    return grams[np.argsort(-counts, kind="stable")][:PROFILE]


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merged(parts):
        grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
        return grams, np.bincount(at, weights=np.concatenate([c for _, c in parts])).astype(np.int64)

    def out():
        for lang, parts in held.items():
            grams, counts = merged(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], ["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        fresh: dict[str, list[np.ndarray]] = {}
        for text, lang in zip(texts(batch["text"]), batch["lang"].to_pylist(), strict=True):
            fresh.setdefault(lang, []).append(gram_codes(text))
        for lang, parts in fresh.items():
            grams, counts = np.unique(np.concatenate(parts), return_counts=True)
            held[lang] = [merged([*held.get(lang, []), (grams, counts)])]
        if sum(len(p[0][0]) for p in held.values()) > HELD_GRAMS:
            yield from out()
    yield from out()


def language_profiles(docs: DataFrame, divisor: int = 5, held: int = 0) -> dict[str, list[int]]:
    """For each learned language its n-grams in order of rank (``PROFILE`` at most)."""
    learned = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
                          F.col("lang").cast("string").alias("lang"))
    learned = learned.where(F.col("lang").isNotNull() & F.col("text").isNotNull()
                            & (remainder("doc_id", divisor) != held))
    counts = learned.select("text", "lang").mapInArrow(_count_grams, "lang string, gram bigint, n bigint")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("part", F.pmod("gram", F.lit(61)))
    # The best of each part first, so that no task sees all n-grams of a language.
    order = [F.desc("n"), "gram"]
    best = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    best = best.where(F.col("rank") <= PROFILE)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    profiles: dict[str, list[int]] = {}
    for row in best.where(F.col("rank") <= PROFILE).orderBy("lang", "rank").collect():
        profiles.setdefault(row.lang, []).append(row.gram)
    return profiles


class LanguageModel:
    def __init__(self, profiles: dict[str, list[int]]):
        self.languages = sorted(profiles)
        self.grams = np.array(sorted({g for p in profiles.values() for g in p}), np.int64)
        self.ranks = np.full((len(self.grams) + 1, len(self.languages)), -PROFILE, np.int64)
        for k, language in enumerate(self.languages):
            self.ranks[np.searchsorted(self.grams, profiles[language]), k] = np.arange(len(profiles[language]))

    def predict(self, text: str) -> tuple[str, float]:
        """The language and one minus its distance as a share of the largest possible one."""
        codes = gram_codes(text)
        if not len(codes) or not self.languages:
            return UNKNOWN, 0.0
        own = ranked(codes)
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        ranks = np.where((self.grams[at] == own)[:, None], self.ranks[at], -PROFILE)
        apart = np.where(ranks < 0, PROFILE, np.abs(ranks - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(apart.argmin())
        return self.languages[best], 1.0 - float(apart[best]) / (PROFILE * len(own))


def predict_languages(docs: DataFrame, model: LanguageModel, divisor: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t) for t in texts(batch["text"])]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = named.mapInArrow(predict, "doc_id bigint, lang_pred string, score double")
    return found.select("doc_id", F.coalesce(remainder("doc_id", divisor) == held, F.lit(False)).alias("held_out"),
                        "lang_pred", "score")

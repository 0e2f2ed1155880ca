"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it to the shared folder and reads it
again as the next stage's docs. All stages but the last return the columns of ``documents``.

1. quality: rows scored below ``LEAST_QUALITY`` go. The classifier learns from the labelled rows among its input.
2. language: rows without a letter (``und``) or unlike any learned language go.
3. exact_dedup: of equal texts the row with the largest doc_id stays.
4. near_dedup: of documents linked by their word n-grams the one with the smallest doc_id stays. Sets of
   ``NEAR_WORDS`` words link from ``NEAR_PERCENT`` % likeness (Jaccard) on, other values than those of op1.
5. packing: what is left is packed into sequences of 4096 tokens.

Null texts count as empty: they are scored like any text and go as ``und``. Without labels or languages to learn from,
the stage has no model and keeps everything (languages: everything with a letter). Extra columns pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stockline.llm.common import prepare, stored, table
from stockline.llm.exact_dedup import keep_first_of_equal
from stockline.llm.language import UNKNOWN, LanguageModel, gram_codes, language_profiles
from stockline.llm.ngram_join import keep_one_per_component
from stockline.llm.packing import pack_documents
from stockline.llm.quality import fit_quality, keep_rows

LEAST_QUALITY, LEAST_LIKENESS = 0.5, 0.2
NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    if model.weights is None:
        return docs
    return keep_rows(docs, lambda texts: [model.score(t) >= LEAST_QUALITY for t in texts])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    model = LanguageModel(language_profiles(docs))
    if not model.languages:
        return keep_rows(docs, lambda texts: [len(gram_codes(t)) > 0 for t in texts])

    def known(text: str) -> bool:
        lang, score = model.predict(text)
        return lang != UNKNOWN and score >= LEAST_LIKENESS

    return keep_rows(docs, lambda texts: [known(t) for t in texts])


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return keep_first_of_equal(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return keep_one_per_component(docs, NEAR_WORDS, NEAR_PERCENT)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("language", language), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
          ("packing", packing)]
#: No SQL: the classifier, language profiles and packing can't be expressed in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over all documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

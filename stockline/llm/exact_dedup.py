"""Exact duplicates by content-defined chunk recipes.

A text (A-Z lower-cased) is cut where a rolling hash of its last 16 bytes says so, so equal stretches are
cut alike wherever they stand. Each distinct chunk is moved and compared once: chunks of equal hash and
length whose bytes agree share an identifier, and where the bytes differ the identifier is extended by the
rank of the bytes. From then on a document is the ordered list of its chunk identifiers, and only these
short lists are shuffled and compared. Equal lists mean equal texts, byte for byte.

Defined cases: a null text equals the empty one. Of equal texts the row with the largest doc_id stays, a
null doc_id counting as the smallest; of repeated rows with that same doc_id exactly one stays. An empty
table gives an empty result. Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stockline.llm.common import blocks, fold_bytes, free_names, RangeHash, stored, utf8

#: Bytes the rolling hash sees, and the least, usual and most bytes of a chunk.
WINDOW, LEAST, USUAL_BITS, MOST = 16, 256, 10, 8192


def chunk_ends(data: np.ndarray, starts: np.ndarray, hashes: RangeHash) -> list[np.ndarray]:
    """For each text of a block, where its chunks end; it depends on that text's bytes alone."""
    at = np.arange(WINDOW, len(data) + 1)
    cuts = at[(hashes.of(at - WINDOW, at) >> np.uint64(64 - USUAL_BITS)) == 0] if len(at) else at
    found = []
    for begin, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        ends, last = [], begin
        for cut in cuts[np.searchsorted(cuts, begin):np.searchsorted(cuts, end)].tolist():
            while cut - last > MOST:
                last += MOST
                ends.append(last)
            if cut - last >= LEAST:
                ends.append(cut)
                last = cut
        while end - last > MOST:
            last += MOST
            ends.append(last)
        if last < end:
            ends.append(end)
        found.append(np.array(ends, np.int64))
    return found


def _chunked(column: pa.Array) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Row number, folded bytes of the block, and begins, ends and hashes of the row's chunks."""
    for first, _, data, starts in blocks(column):
        data = fold_bytes(data)
        hashes, raw = RangeHash(data), data.tobytes()
        for k, ends in enumerate(chunk_ends(data, starts, hashes)):
            begins = np.concatenate([starts[k:k + 1], ends[:-1]])[:len(ends)]
            yield first + k, (raw, int(starts[k]), int(starts[k + 1])), begins, ends, hashes.of(begins, ends)


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, digests, recipes = [], [], []
        for _, (raw, begin, end), begins, ends, hashes in _chunked(batch["text"]):
            sizes.append(end - begin)
            digests.append(hashlib.sha256(raw[begin:end]).hexdigest())
            recipes.append(np.column_stack([hashes, (ends - begins).astype(np.uint64)]).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(recipes, pa.binary())],
            ["doc_id", "n_bytes", "text_sha256", "recipe"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk of a batch once."""
    for batch in batches:
        seen = {}
        for _, (raw, _, _), begins, ends, hashes in _chunked(batch["text"]):
            for begin, end, key in zip(begins.tolist(), ends.tolist(), hashes.view(np.int64).tolist(), strict=True):
                seen.setdefault((key, raw[begin:end]), None)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in seen], pa.int64()), pa.array([len(c) for _, c in seen], pa.int32()),
             pa.array([c for _, c in seen], pa.binary())], ["chunk", "length", "content"])


def _placed_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(digest, place, key, end - begin, raw[begin:end])
                for _, (raw, first, last), begins, ends, hashes in _chunked(batch["text"])
                for digest in [hashlib.sha256(raw[first:last]).hexdigest()]
                for place, (begin, end, key) in enumerate(
                    zip(begins.tolist(), ends.tolist(), hashes.view(np.int64).tolist(), strict=True))]
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()),
             pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.binary())],
            ["text_sha256", "place", "chunk", "length", "content"])


def ambiguous_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks (hash and length) that stand for more than one content."""
    same = chunks.groupBy("chunk", "length").agg(F.min("content").alias("low"), F.max("content").alias("high"))
    return same.where("low <> high").select("chunk", "length")


def _variants(texts: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """For texts that hold ambiguous chunks: which content each of them has. Texts are told apart by their
    digest, as a doc_id may be null or stand on several rows; a text is looked at once however often it comes."""
    placed = texts.mapInArrow(_placed_chunks, "text_sha256 string, place int, chunk bigint, length int, content binary")
    placed = placed.join(ambiguous, ["chunk", "length"])
    order = Window.partitionBy("chunk", "length").orderBy("content")
    ranks = placed.select("chunk", "length", "content").distinct().withColumn("variant", F.dense_rank().over(order))
    return (placed.join(ranks, ["chunk", "length", "content"]).groupBy("text_sha256")
            .agg(F.sort_array(F.collect_set(F.struct("place", "variant"))).cast("string").alias("variants")))


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_bytes."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # A row's number is stored with its recipe, so it tells repeated rows apart for good.
    recipes = stored(
        texts.mapInArrow(_recipes, "doc_id bigint, n_bytes bigint, text_sha256 string, recipe binary")
        .withColumn("row", F.monotonically_increasing_id()), "recipes")
    ambiguous = stored(ambiguous_chunks(
        texts.mapInArrow(_chunks, "chunk bigint, length int, content binary")), "ambiguous")
    if ambiguous.isEmpty():
        recipes = recipes.withColumn("variants", F.lit(""))
    else:
        recipes = stored(recipes.join(_variants(texts, ambiguous), "text_sha256", "left")
                         .withColumn("variants", F.coalesce("variants", F.lit(""))), "resolved")
    groups = recipes.groupBy("recipe", "variants").agg(
        F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size"))
    return recipes.join(groups, ["recipe", "variants"]).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"),
        "text_sha256", "n_bytes")


def keep_first_of_equal(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever these are called."""
    kept_id, kept_sha, sha, turn = free_names(docs, "_kept_id", "_kept_sha", "_sha", "_turn")
    kept = exact_groups(docs).where("kept").select(F.col("doc_id").alias(kept_id), F.col("text_sha256").alias(kept_sha))
    folded = F.sha2(F.translate(F.coalesce(F.col("text"), F.lit("")), *_FOLD).cast("binary"), 256)
    same = F.col(sha).eqNullSafe(F.col(kept_sha)) & F.col("doc_id").cast("bigint").eqNullSafe(F.col(kept_id))
    again = Window.partitionBy(kept_id, kept_sha).orderBy(kept_id)
    return (docs.withColumn(sha, folded).join(kept, same).withColumn(turn, F.row_number().over(again))
            .where(F.col(turn) == 1).select(*[F.col(f"`{c}`") for c in docs.columns]))


_FOLD = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

"""Token counts with a whole-token shortcut.

Before any text is read, each vocabulary string is tested alone: those that are one pre-token and encode as
one token are proven. In the texts, a pre-token among them counts one without a merge; only the others are
merged, each distinct one once per worker.

Defined cases: a null text counts as empty (0 bytes, 0 tokens). A null doc_id is kept. Repeated rows give
repeated results. Special strings inside a text count one token each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockline.llm.common import BATCH_ROWS, texts
from stockline.llm.word_tokens import prove_whole_words, vocabulary


def token_counts(docs: DataFrame, path: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and n_whole: the tokens that needed no merge."""
    whole = prove_whole_words(path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path, whole, "counts")
        for batch in batches:
            sizes, totals, shortcuts = [], [], []
            for at in range(0, len(batch), BATCH_ROWS // 10):
                rows = texts(batch["text"].slice(at, BATCH_ROWS // 10))
                pieces = [known.pieces(text) for text in rows]
                known.learn(set().union(*pieces))
                for text, words in zip(rows, pieces, strict=True):
                    rest = [w for w in words if w not in known.whole]
                    sizes.append(len(text.encode("utf-8")))
                    shortcuts.append(len(words) - len(rest))
                    totals.append(shortcuts[-1] + sum(map(len, map(known.ids.__getitem__, rest))) // 4)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()),
                 pa.array([t > limit for t in totals], pa.bool_()), pa.array(shortcuts, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "n_whole"])

    columns = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return columns.mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, n_whole bigint")

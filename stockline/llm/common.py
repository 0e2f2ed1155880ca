"""What the text operators share: reading tables, Arrow text as numpy arrays, hashes, and values kept by a worker."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockline.session import configure, cut, provide_shared_folder

#: Rows of text that travel to a Python worker at once.
BATCH_ROWS = 1000
#: Text that is turned into numpy arrays at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def prepare(spark: SparkSession) -> None:
    """Session settings of the text operators."""
    configure(spark)
    provide_shared_folder(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


@contextmanager
def arrow_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """Rows that travel to Python at once while something is written: more for narrow rows than for texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(frame: DataFrame, label: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back."""
    return cut(frame, f"llm-{label}")


def free_names(docs: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that no column of a table has, in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    found = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def fold_column(text) -> F.Column:
    """Text with A-Z lower-cased, null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def remainder(doc_id, divisor: int) -> F.Column:
    """crc32 of the id as text, modulo ``divisor``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % divisor


def worker_value(key, make: Callable):
    """A value that a Python worker builds once and keeps for later tasks (models, word caches)."""
    kept = sys.modules.setdefault("_stockline_worker_values", types.ModuleType("_stockline_worker_values"))
    values = kept.__dict__.setdefault("values", {})
    if key not in values:
        values[key] = make()
    return values[key]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and where each row begins; null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, starts, data = column.buffers()
    starts = np.frombuffer(starts, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[starts[0]:starts[-1]], starts - starts[0]


def blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a text column: first row, end row, bytes, and where each of its rows begins."""
    data, starts = utf8(column)
    first = 0
    while first < len(column):
        end = int(np.searchsorted(starts, starts[first] + BLOCK_BYTES, "right")) - 1
        end = min(max(end, first + 1), len(column))
        yield first, end, data[starts[first]:starts[end]], starts[first:end + 1] - starts[first]
        first = end


def texts(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


#: Fixed odd multiplier of the polynomial hashes, and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    def make():
        return np.ones(1, np.uint64)

    kept = worker_value(("powers", base), lambda: [make()])
    if len(kept[0]) < n:
        grown = np.full(max(n, BLOCK_BYTES + 1), base, np.uint64)
        grown[0] = 1
        np.multiply.accumulate(grown, out=grown)
        if len(grown) > 2 * BLOCK_BYTES:
            return grown
        kept[0] = grown
    return kept[0][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit values (a fixed bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


class RangeHash:
    """64-bit hashes of any ranges of a byte array, from one pass over it."""

    def __init__(self, data: np.ndarray):
        values = worker_value("byte values", _byte_values)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * _powers(_BASE, len(data)), out=self.sums[1:])

    def polynomial(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[begin]) * _powers(_INVERSE, len(self.sums))[begin]

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.polynomial(begin, end) + mix((end - begin).astype(np.uint64)))


def fold_bytes(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z lower-cased."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)

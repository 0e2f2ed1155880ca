"""Best-fit packing of token sequences with swap-based local search.

Texts become token ids closed by an end id; longer ones are cut into full pieces and a remainder. Full
pieces are sequences of their own. The rest is dealt evenly by hash into groups of a few thousand pieces.
A group is packed best-fit, longest first, and then improved: the emptiest bin hands its documents to
fuller bins by moves, one-for-one and two-for-one exchanges. Each step raises the sum of squared fills, so
the search ends; a bin that loses everything is gone. What the groups leave in badly filled bins goes on
to the next level, where far fewer groups pack it again, until one group is left.

Defined cases: a null text is empty and packs as the end id alone. Repeated rows and null doc_ids are packed
like any other; repeated doc_ids keep their pieces apart only by sequence and offset. An empty table gives
an empty result.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockline.llm.common import BATCH_ROWS, stored, texts
from stockline.llm.word_tokens import vocabulary

#: Pieces that one group packs, about; the share of a bin below which its documents are packed again.
GROUP_PIECES, WELL_FILLED = 4000, 0.98
#: Emptiest bins that the local search tries to empty, one after another, in a group.
DONORS = 24


def piece_rows(docs: DataFrame, path: str, size: int, end_id: int) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in batches:
            rows, numbers, begins, lengths, checks = [], [], [], [], []
            for at in range(0, len(batch), BATCH_ROWS // 10):
                pieces = [known.pieces(text) for text in texts(batch["text"].slice(at, BATCH_ROWS // 10))]
                known.learn(set().union(*pieces))
                for k, words in enumerate(pieces):
                    ids = b"".join(map(known.ids.__getitem__, words)) + end
                    for piece, begin in enumerate(range(0, len(ids), 4 * size)):
                        part = ids[begin:begin + 4 * size]
                        rows.append(at + k)
                        numbers.append(piece)
                        begins.append(begin // 4)
                        lengths.append(len(part) // 4)
                        checks.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()),
                 pa.array(begins, pa.int64()), pa.array(lengths, pa.int64()), pa.array(checks, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    columns = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return columns.mapInArrow(cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(lengths: np.ndarray, size: int) -> np.ndarray:
    """The bin of each piece, longest first, each into the fullest bin that still takes it."""
    bins, free = np.zeros(len(lengths), np.int64), []
    for count, k in enumerate(np.argsort(-lengths, kind="stable").tolist()):
        need = int(lengths[k])
        at = bisect.bisect_left(free, (need, -1))
        room, bin_ = free.pop(at) if at < len(free) else (size, count)
        bins[k] = bin_
        if room > need:
            bisect.insort(free, (room - need, bin_))
    return np.unique(bins, return_inverse=True)[1]


def empty_bins(lengths: np.ndarray, bins: np.ndarray, size: int) -> np.ndarray:
    """Local search: hand the documents of the emptiest bins to fuller ones until bins are empty."""
    bins = bins.copy()
    fill = np.bincount(bins, weights=lengths).astype(np.int64)
    least = -(-int(lengths.sum()) // size)
    tried: set[int] = set()
    while (fill > 0).sum() > least and len(tried) < DONORS:
        open_ = [b for b in np.flatnonzero((fill > 0) & (fill < size)) if b not in tried]
        if not open_:
            break
        donor = min(open_, key=lambda b: (fill[b], b))
        while fill[donor] > 0 and _step(lengths, bins, fill, donor, size):
            pass
        tried.add(donor)
    return np.unique(bins, return_inverse=True)[1]


def _step(lengths: np.ndarray, bins: np.ndarray, fill: np.ndarray, donor: int, size: int) -> bool:
    """The exchange with the donor bin that raises the squared fill most; False if there is none."""
    own = np.flatnonzero(bins == donor)
    own = own[np.argsort(-lengths[own], kind="stable")]
    room = size - fill
    others = np.flatnonzero((bins != donor) & (fill[bins] >= fill[donor]) & (room[bins] > 0))
    best = (0, (), -1)
    targets = np.flatnonzero((fill >= fill[donor]) & (room > 0))
    targets = targets[targets != donor]
    pairs = [(int(a), int(b)) for i, a in enumerate(own[:24]) for b in own[i + 1:24]]
    for given in [(int(k),) for k in own] + pairs:
        total = int(lengths[list(given)].sum())
        if len(given) == 1 and len(targets):
            fits = targets[room[targets] >= total]
            if len(fits):
                gain = 2 * total * (int(fill[fits].max()) - int(fill[donor]) + total)
                if gain > best[0]:
                    best = (gain, given, -1 - int(fits[np.argmax(fill[fits])]))
        if len(others):
            more = total - lengths[others]
            good = np.flatnonzero((more > 0) & (more <= room[bins[others]]))
            if len(good):
                gains = 2 * more[good] * (fill[bins[others[good]]] - fill[donor] + more[good])
                if gains.max() > best[0]:
                    best = (int(gains.max()), given, int(others[good[np.argmax(gains)]]))
    gain, given, back = best
    if gain <= 0:
        return False
    target = -1 - back if back < 0 else int(bins[back])
    if back >= 0:
        bins[back] = donor
        fill[donor] += lengths[back]
        fill[target] -= lengths[back]
    for k in given:
        bins[k] = target
        fill[target] += lengths[k]
        fill[donor] -= lengths[k]
    return True


def _pack_group(rows: pd.DataFrame, size: int) -> pd.DataFrame:
    rows = rows.sort_values(["length", "row"], ascending=[False, True], ignore_index=True)
    lengths = rows["length"].to_numpy(np.int64)
    bins = empty_bins(lengths, best_fit(lengths, size), size)
    order = np.argsort(bins, kind="stable")
    before = np.zeros(len(rows), np.int64)
    sums = np.cumsum(lengths[order]) - lengths[order]
    first = np.searchsorted(bins[order], np.arange(bins.max() + 1))
    before[order] = sums - sums[first][bins[order]]
    return pd.DataFrame({"row": rows["row"], "group": rows["group"], "length": lengths, "bin": bins, "offset": before,
                         "fill": np.bincount(bins, weights=lengths).astype(np.int64)[bins]})


def pack(pieces: DataFrame, size: int) -> DataFrame:
    """Give each piece of a stored table with a unique ``row`` its sequence and its place there."""
    part = pieces.where(F.col("length") < size).select("row", "length")
    done, level = [], 0
    while True:
        groups = max(1, -(-part.count() // GROUP_PIECES))
        dealt = part.withColumn("group", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(groups)))
        packed = stored(dealt.groupBy("group").applyInPandas(
            lambda rows: _pack_group(rows, size),
            "row bigint, `group` bigint, length bigint, bin bigint, offset bigint, fill bigint"), f"packed{level}")
        final = groups == 1
        good = packed if final else packed.where(F.col("fill") >= WELL_FILLED * size)
        done.append(good.select("row", F.expr(f"{level << 56}L + `group` * {1 << 16}L + bin").alias("sequence_id"), "offset"))
        if final:
            break
        part = packed.where(F.col("fill") < WELL_FILLED * size).select("row", "length")
        left = part.count()
        if -(-left // GROUP_PIECES) >= groups:  # hardly anything fits together: packing it again would not end
            done.append(packed.where(F.col("fill") < WELL_FILLED * size).select(
                "row", F.expr(f"{level << 56}L + `group` * {1 << 16}L + bin").alias("sequence_id"), "offset"))
            break
        level += 1
    placed = done[0]
    for more in done[1:]:
        placed = placed.unionByName(more)
    small = pieces.where(F.col("length") < size).join(placed, "row")
    full = pieces.where(F.col("length") >= size).withColumns(
        {"sequence_id": -1 - F.col("row"), "offset": F.lit(0).cast("bigint")})
    return small.unionByName(full).drop("row")


def pack_documents(docs: DataFrame, path: str, size: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = stored(piece_rows(docs, path, size, end_id).withColumn("row", F.monotonically_increasing_id()), "pieces")
    return pack(pieces, size)

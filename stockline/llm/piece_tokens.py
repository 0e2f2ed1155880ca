"""SentencePiece encoding and decoding with seeded merge-dropout.

The vocabulary is of merge type: a segment's characters are merged pair by pair, best piece first, from an agenda.
Each candidate merge is looked up in a keyed hash of the seed, the document's id, the segment and its place in the
document, and the place and length of its two parts; if the hash falls below the dropout rate, the candidate is skipped
when the agenda comes to it. So the same seed gives the same segmentation on any cluster, another seed another one, and
rate 0 the library's own. Every occurrence of a word has its own draws (64 bits of document and place).

A worker takes texts in blocks. It remembers of each word that it met twice in a block the merges that it has without
dropout and the pieces they make; occurrences that skip none of these merges have these pieces. All others are merged
anew, never looked up: words have their agendas in arrays and each step takes the best candidate of every word; longer
segments have a heap each. Both give the same pieces.

No piece holds a blank after another character, so merges never cross the start of a word and each segment is
encoded by itself. Characters without a piece are written as bytes; so is the mark that stands for a blank where the
text itself has it, which makes decoding exact for every text.

Defined cases: a null text is empty and has no pieces. A null doc_id counts as 0 in the keyed hash. Repeated rows give
repeated results.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from stockline.llm.common import BLOCK_BYTES, mix, texts, worker_value

BLANK = "▁"
#: Distance of the keys of two segments; the draw of an occurrence, any 64 bits, is added to its segment's.
VARIANTS = 1 << 32
#: Words whose merges without dropout a worker keeps; when there are more, it starts again.
KEPT_SEGMENTS = 300_000
#: Characters of the segments that are merged in arrays, and how many of these at once.
WORD, WORDS_AT_ONCE = 24, 20_000
_SPREAD = 0x9E3779B97F4A7C15
_SEGMENTS = re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n")
_MASK = (1 << 64) - 1


def _mixed(x: int) -> int:
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _MASK
    return x ^ (x >> 31)


def _sum(segment: str) -> int:
    return zlib.crc32(segment.encode("utf-8", "surrogatepass"))


class PieceVocabulary:
    """A vocabulary of merge type, and a memory of what the words met become without dropout."""

    def __init__(self, path: str, seed: int, rate: float):
        library = SentencePieceProcessor(model_file=path)
        size = library.get_piece_size()
        self.pieces = [library.id_to_piece(i) for i in range(size)]
        self.byte_ids = {}
        self.ids, self.scores = {}, {}
        for i, piece in enumerate(self.pieces):
            if library.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
            elif not (library.is_control(i) or library.is_unknown(i) or library.is_unused(i)):
                self.ids[piece] = i
                self.scores[piece] = library.get_score(i)
        if any(BLANK in p.lstrip(BLANK) or "\n" in p for p in self.ids):
            raise ValueError("pieces that hold a line end, or a blank after another character, are not supported")
        byte_of = {i: b for b, i in self.byte_ids.items()}
        self.raw = [bytes([byte_of[i]]) if i in byte_of else p.replace(BLANK, " ").encode("utf-8")
                    for i, p in enumerate(self.pieces)]
        self.seed, self.below = seed & _MASK, min(int(rate * (1 << 64)), _MASK)
        self.literal = array("I", [self.byte_ids[b] for b in BLANK.encode()]).tobytes()
        self._arrays()
        self._forget()

    def _forget(self) -> None:
        """Remember the literal mark only: word 0, the empty one, without merges."""
        self.numbers, self.plain = {"": 0}, [self.literal]
        self.sums, self.spots, self.firsts = np.zeros(1, np.uint64), np.zeros(0, np.uint64), np.zeros(2, np.int64)

    def _arrays(self) -> None:
        """Pieces as codes (other characters follow them), and which two codes make which piece."""
        code = {piece: k for k, piece in enumerate(self.ids)}
        self.piece_ids = np.array(list(self.ids.values()), np.uint32)
        self.piece_scores = np.array([self.scores[p] for p in code], np.float64)
        self.char_codes = np.arange(0x110000, dtype=np.int64) + len(code)
        for piece, k in code.items():
            if len(piece) == 1:
                self.char_codes[ord(piece)] = k
        made = {}
        for piece, k in code.items():
            for cut in range(1, len(piece)):
                left, right = (code.get(x, int(self.char_codes[ord(x)]) if len(x) == 1 else None)
                               for x in (piece[:cut], piece[cut:]))
                if left is not None and right is not None:
                    made[left << 21 | right] = k
        # A table with several times as many places as pairs, each pair at the first free place from its hash on.
        keys, codes = np.array(list(made), np.int64), np.array(list(made.values()), np.int64)
        bits = max(4, (4 * len(keys)).bit_length())
        self.pair_shift, self.pair_mask = np.uint64(64 - bits), (1 << bits) - 1
        self.pair_keys, self.pair_codes = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        at = self._pair_place(keys)
        while len(keys):
            free = self.pair_keys[at] < 0
            _, first = np.unique(at, return_index=True)
            taken = np.zeros(len(keys), bool)
            taken[first] = free[first]
            self.pair_keys[at[taken]], self.pair_codes[at[taken]] = keys[taken], codes[taken]
            keys, codes, at = keys[~taken], codes[~taken], (at[~taken] + 1) & self.pair_mask

    def _pair_place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(_SPREAD) >> self.pair_shift).astype(np.int64)

    def skipped(self, key: int, start: int, middle: int, end: int) -> bool:
        """The keyed hash of a candidate merge, against the dropout rate."""
        return _mixed(key ^ (start << 42 | middle << 21 | end) * _SPREAD & _MASK) < self.below

    def merge(self, segment: str, draw: int) -> list[str]:
        """The pieces of a segment: candidates leave the agenda best first, leftmost of equals, or are skipped."""
        n = len(segment)
        if n == 1:
            return [segment]
        key = _mixed(self.seed + _sum(segment) * VARIANTS + draw & _MASK)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        scores, below, agenda = self.scores, self.below, []

        def offer(left: int, right: int) -> None:
            end = after[right]
            score = scores.get(segment[left:end])
            if score is not None:
                heapq.heappush(agenda, (-score, left, right, end))

        for k in range(n - 1):
            offer(k, k + 1)
        while agenda:
            _, left, right, end = heapq.heappop(agenda)
            if not (alive[left] and alive[right]) or after[left] != right or after[right] != end:
                continue
            if below and self.skipped(key, left, right, end):
                continue
            alive[right] = False
            after[left] = end
            if end < n:
                before[end] = left
                offer(left, end)
            if before[left] >= 0:
                offer(before[left], left)
        found, k = [], 0
        while k < n:
            found.append(segment[k:after[k]])
            k = after[k]
        return found

    def _piece_ids(self, pieces: Iterable[str]) -> bytes:
        ids = array("I")
        for piece in pieces:
            if (known := self.ids.get(piece)) is not None:
                ids.append(known)
            else:
                ids.extend(self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass"))
        return ids.tobytes()

    def segment_ids(self, segment: str, draw: int) -> bytes:
        return self._piece_ids(self.merge(segment, draw))

    def _offers(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece that two neighbours make and its score; none scores least."""
        wanted = left << 21 | right
        shape, wanted = wanted.shape, np.ascontiguousarray(wanted).ravel()
        at = self._pair_place(wanted)
        held = self.pair_keys[at]
        found = held == wanted
        code = self.pair_codes[at]
        # Few pairs are neither at their place nor shown by a free one to be none.
        open_ = np.flatnonzero(~found & (held >= 0))
        at = at[open_]
        while len(open_):
            at = (at + 1) & self.pair_mask
            held = self.pair_keys[at]
            here = held == wanted[open_]
            found[open_[here]], code[open_[here]] = True, self.pair_codes[at[here]]
            on = ~here & (held >= 0)
            open_, at = open_[on], at[on]
        return code.reshape(shape), np.where(found, self.piece_scores[code], -np.inf).reshape(shape)

    def _keys(self, sums: np.ndarray, draws: np.ndarray) -> np.ndarray:
        return mix(sums * np.uint64(VARIANTS) + draws + np.uint64(self.seed))

    def words_ids(self, words: list[tuple[str, int]]) -> list[bytes]:
        """The ids of some words, each with its draw."""
        sums, draws = np.array([_sum(w) for w, _ in words], np.uint64), np.array([d for _, d in words], np.uint64)
        return self._merged([w for w, _ in words], self._keys(sums, draws))

    def _merged(self, words: list[str], keys: np.ndarray | None, steps: list | None = None) -> list[bytes]:
        """The ids of some words: every step settles the best candidate, leftmost of equals, of each word's agenda.

        Without keys nothing is skipped; the rows and candidates of each step are then added to ``steps``.
        """
        n, size = len(words), np.array([len(w) for w in words])
        width = int(size.max())
        chars = np.array(words, f"<U{width}").view(np.uint32).reshape(n, width)
        place = np.arange(width)
        codes, alive = self.char_codes[chars], place < size[:, None]
        after, before = np.tile(place + 1, (n, 1)), np.tile(place - 1, (n, 1))
        made, agenda = np.zeros((n, width), np.int64), np.full((n, width), -np.inf)
        if width > 1:
            made[:, :-1], offered = self._offers(codes[:, :-1], codes[:, 1:])
            agenda[:, :-1] = np.where(alive[:, 1:], offered, -np.inf)
        rows = np.arange(n)
        while len(rows):
            now = agenda[rows]
            left = now.argmax(axis=1)
            going = now[np.arange(len(rows)), left] > -np.inf
            rows, left = rows[going], left[going]
            right = after[rows, left]
            end = after[rows, right]
            agenda[rows, left] = -np.inf
            spot = (left << 42 | right << 21 | end).astype(np.uint64) * np.uint64(_SPREAD)
            if keys is None:
                r = rows
                steps.append((rows, spot))
            else:
                merged = mix(keys[rows] ^ spot) >= np.uint64(self.below)
                r, left, right, end = rows[merged], left[merged], right[merged], end[merged]
            alive[r, right], agenda[r, right] = False, -np.inf
            codes[r, left], after[r, left] = made[r, left], end
            more = end < size[r]
            a, at, to = r[more], left[more], end[more]
            before[a, to] = at
            made[a, at], agenda[a, at] = self._offers(codes[a, at], codes[a, to])
            more = left > 0
            a, at = r[more], left[more]
            to = before[a, at]
            made[a, to], agenda[a, to] = self._offers(codes[a, to], codes[a, at])
        known = codes < len(self.piece_ids)
        whole = (known | ~alive).all(axis=1)
        ids = self.piece_ids[np.where(known, codes, 0)[alive]].tobytes()
        ends = (np.cumsum(alive.sum(axis=1)) * 4).tolist()
        found = [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        for k in np.flatnonzero(~whole).tolist():
            begins = np.flatnonzero(alive[k])
            found[k] = self._piece_ids(words[k][a:b] for a, b in zip(begins, after[k, begins], strict=True))
        return found

    def _learn(self, words: list[str]) -> None:
        """Remember the merges of some words without dropout, in their order, and the pieces they make."""
        words = sorted(words, key=len)
        spots, counts = [self.spots], [np.diff(self.firsts)]
        for k in range(0, len(words), WORDS_AT_ONCE):
            some, steps = words[k:k + WORDS_AT_ONCE], []
            self.plain += self._merged(some, None, steps)
            rows = np.concatenate([np.zeros(0, np.int64), *[r for r, _ in steps]])
            spots.append(np.concatenate([np.zeros(0, np.uint64), *[x for _, x in steps]])[np.argsort(rows, kind="stable")])
            counts.append(np.bincount(rows, minlength=len(some)))
        self.numbers.update(zip(words, range(len(self.numbers), len(self.numbers) + len(words)), strict=True))
        self.sums = np.concatenate([self.sums, np.array([_sum(w) for w in words], np.uint64)])
        self.spots, self.firsts = np.concatenate(spots), np.concatenate([[0], np.cumsum(np.concatenate(counts))])

    def _skipping(self, numbers: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The occurrences that skip one of the merges that their word has without dropout."""
        found, open_ = np.zeros(len(numbers), bool), np.arange(len(numbers))
        at, end = self.firsts[numbers], self.firsts[numbers + 1]
        while self.below and len(open_ := open_[at < end]):
            at, end, keys = (x[at < end] for x in (at, end, keys))
            kept = mix(keys ^ self.spots[at]) >= np.uint64(self.below)
            found[open_[~kept]] = True
            open_, at, end, keys = open_[kept], at[kept] + 1, end[kept], keys[kept]
        return np.flatnonzero(found)

    def _settled(self, segments: list[str], draws: np.ndarray) -> list[bytes]:
        """The ids of each occurrence of a segment."""
        new = {s: n for s, n in Counter(segments).items() if s not in self.numbers}
        # A word that is met once is merged with its draws at once.
        again = [s for s, n in new.items() if n > 1 and len(s) <= WORD]
        if len(self.numbers) + len(again) > KEPT_SEGMENTS:
            self._forget()
            again = [s for s, n in Counter(segments).items() if n > 1 and s and len(s) <= WORD]
        if again:
            self._learn(again)
        at = list(map(self.numbers.get, segments, repeat(-1)))
        numbers, found = np.array(at, np.int64), list(map(self.plain.__getitem__, at))
        known, once = np.flatnonzero(numbers >= 0), np.flatnonzero(numbers < 0)
        keys = self._keys(self.sums[numbers[known]], draws[known])
        skipping = self._skipping(numbers[known], keys)
        words = list(map(segments.__getitem__, once.tolist()))
        short = np.fromiter(map(len, words), np.int64, len(words)) <= WORD
        sums = np.fromiter((_sum(w) for w, s in zip(words, short.tolist(), strict=True) if s), np.uint64, int(short.sum()))
        anew = np.concatenate([known[skipping], once[short]])
        keys = np.concatenate([keys[skipping], self._keys(sums, draws[once[short]])])
        sizes = np.fromiter(map(len, map(segments.__getitem__, anew.tolist())), np.uint8, len(anew))
        order = np.argsort(sizes, kind="stable")
        for k in range(0, len(order), WORDS_AT_ONCE):
            some = order[k:k + WORDS_AT_ONCE]
            places = anew[some].tolist()
            for place, ids in zip(places, self._merged([segments[p] for p in places], keys[some]), strict=True):
                found[place] = ids
        for place in once[~short].tolist():
            found[place] = self.segment_ids(segments[place], int(draws[place]))
        return found

    def segments(self, text: str) -> list[str]:
        """The segments of a text; an empty one stands for the mark of a blank itself."""
        found = []
        for k, part in enumerate(text.split(BLANK) if text else []):
            found += ([""] if k else []) + _SEGMENTS.findall(("" if k else BLANK) + part.replace(" ", BLANK))
        return found

    def draws(self, doc_ids: list[int], counts: list[int]) -> np.ndarray:
        """What sets apart each occurrence of a segment: 64 bits from the seed, document and place."""
        docs = np.repeat(mix(np.array([i & _MASK for i in doc_ids], np.uint64) ^ np.uint64(self.seed)), counts)
        places = np.concatenate([np.zeros(0, np.uint64), *[np.arange(1, n + 1, dtype=np.uint64) for n in counts]])
        return mix(docs + places * np.uint64(_SPREAD))

    def encode_all(self, some: list[str], doc_ids: list[int]) -> Iterator[bytes]:
        """The ids of each text, four bytes each; texts are taken in blocks of bounded size."""
        first = 0
        while first < len(some):
            end, taken = first + 1, len(some[first])
            while end < len(some) and (taken := taken + len(some[end])) <= BLOCK_BYTES:
                end += 1
            block = [self.segments(text) for text in some[first:end]]
            counts = [len(segments) for segments in block]
            found = self._settled(list(chain.from_iterable(block)), self.draws(doc_ids[first:end], counts))
            at = 0
            for n in counts:
                yield b"".join(found[at:at + n])
                at += n
            first = end

    def encode(self, text: str, doc_id: int = 0) -> bytes:
        """The ids of a text, four bytes each."""
        return next(self.encode_all([text], [doc_id]))

    def decode(self, ids: bytes) -> str:
        """The text of some ids: pieces joined, bytes put together, blanks shown, the first one dropped."""
        return b"".join(map(self.raw.__getitem__, array("I", ids)))[1:].decode("utf-8", "surrogatepass")


def piece_vocabulary(path: str, seed: int, rate: float) -> PieceVocabulary:
    return worker_value(("piece vocabulary", path, seed, rate), lambda: PieceVocabulary(path, seed, rate))


def encode_documents(docs: DataFrame, path: str, seed: int, rate: float) -> DataFrame:
    """doc_id, text, and ids: the seeded segmentation of each whole text."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = piece_vocabulary(path, seed, rate)
        for batch in batches:
            ids = [array("I", found) for found in
                   known.encode_all(texts(batch["text"]), [i or 0 for i in batch["doc_id"].to_pylist()])]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["text"], pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "text", "ids"])

    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return named.mapInArrow(encode, "doc_id bigint, text string, ids array<int>")


def decode_ids(rows: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """The columns ``keep``, and the text that ``ids`` stand for."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema) + ", decoded string"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = piece_vocabulary(path, 0, 0.0)
        for batch in batches:
            found = [known.decode(array("I", ids or []).tobytes()) for ids in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in keep], pa.array(found, pa.string())], [*keep, "decoded"])

    return rows.mapInArrow(decode, schema)


def round_trip(docs: DataFrame, path: str, seed: int, rate: float) -> DataFrame:
    """doc_id, n_bytes, n_pieces, ids_crc32, decoded_sha256, lossless: each text encoded, then decoded from its ids."""
    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = piece_vocabulary(path, seed, rate)
        for batch in batches:
            rows = []
            some = texts(batch["text"])
            for text, ids in zip(some, known.encode_all(some, [i or 0 for i in batch["doc_id"].to_pylist()]), strict=True):
                raw, decoded = text.encode("utf-8"), known.decode(ids)
                rows.append((len(raw), len(ids) // 4, zlib.crc32(ids),
                             hashlib.sha256(decoded.encode("utf-8")).hexdigest(), decoded == text))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                ["doc_id", "n_bytes", "n_pieces", "ids_crc32", "decoded_sha256", "lossless"])

    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return named.mapInArrow(both, "doc_id bigint, n_bytes bigint, n_pieces bigint, ids_crc32 bigint, "
                                  "decoded_sha256 string, lossless boolean")

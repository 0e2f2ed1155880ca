"""Token counts, packing and merge-dropout against the libraries and brute force."""

import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from stockline.llm import packing
from stockline.llm.packing import best_fit, empty_bins, pack_documents
from stockline.llm.piece_tokens import PieceVocabulary, decode_ids, encode_documents, round_trip
from stockline.llm.token_counts import token_counts
from stockline.llm.word_tokens import WordVocabulary, prove_whole_words

WORD, PIECE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "The the THE.", "it's we'll 'tis 2024 ½ x²", "a<|endoftext|>b <|startoftext|>", "<|ENDOFTEXT|>",
         "日本語 текст ελληνικά", "é è É ß Ñ\x85 \xa0x", "é — “q” 🦅🦅", "!!!''' 's's", "\x00\x1c\x7f", "word " * 6000,
         "x" * 9000, "ªµº ÿ÷×", "İstanbul ǅ", "line\nline\r\n\ttab", "  lead and  double  ", "▁ mark ▁▁x", "<0x0A> <s> </s> <unk>"]


def docs(spark):
    rows = [(k if k else None, t, "x") for k, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string").repartition(2)


def test_counts_match_the_library(spark):
    library = Tokenizer.from_file(WORD)
    for r in token_counts(docs(spark), WORD, 2048).collect():
        text = TEXTS[r.doc_id or 0] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(text.encode()), n > 2048), text[:20]
        assert r.n_whole <= r.n_tokens


def test_ids_match_the_library_on_random_text():
    library, known, rng = Tokenizer.from_file(WORD), WordVocabulary(WORD), random.Random(1)
    letters = "abcXYZ '.,!-0189éßÑªº²½\xa0\x85\t\n" + "日мε—́"
    for _ in range(400):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
        pieces = known.pieces(text)
        known.learn(set(pieces))
        assert array("I", b"".join(known.ids[w] for w in pieces)).tolist() == library.encode(text, add_special_tokens=False).ids


def test_proven_words_are_one_token():
    library, proven = Tokenizer.from_file(WORD), prove_whole_words(WORD)
    assert len(proven) > 20_000
    for word in random.Random(2).sample(proven, 300):
        assert len(library.encode(f"{word} {word}", add_special_tokens=False).ids) == 2


def check_packing(rows, size):
    library = Tokenizer.from_file(WORD)
    places = {}
    for r in rows:
        ids = library.encode(TEXTS[r.doc_id or 0] or "", add_special_tokens=False).ids + [1]
        part = ids[r.start:r.start + r.length]
        assert r.start == r.piece * size and len(part) == r.length <= size
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= size
    return len(places)


@pytest.mark.parametrize("group", [4000, 5])
def test_packing_is_whole_and_gapless(spark, monkeypatch, group):
    monkeypatch.setattr(packing, "GROUP_PIECES", group)
    rows = pack_documents(docs(spark), WORD, 512).collect()
    assert sum(r.length for r in rows) > 8_000
    assert check_packing(rows, 512) <= -(-sum(r.length for r in rows) // 512) + (1 if group == 4000 else 4)
    assert pack_documents(docs(spark).where("false"), WORD).count() == 0


def test_local_search_empties_bins():
    rng = np.random.default_rng(3)
    for _ in range(20):
        lengths = rng.integers(1, 100, 300)
        first = best_fit(lengths, 100)
        bins = empty_bins(lengths, first, 100)
        assert np.bincount(bins, weights=lengths).max() <= 100
        assert -(-lengths.sum() // 100) <= bins.max() + 1 <= first.max() + 1
    bad = np.arange(8)
    assert empty_bins(np.array([50] * 8), bad, 100).max() + 1 == 4
    assert empty_bins(np.array([60, 30, 60, 40, 10]), np.array([0, 0, 1, 2, 3]), 100).max() + 1 == 2


def test_no_dropout_is_the_library():
    library, known = SentencePieceProcessor(model_file=PIECE), PieceVocabulary(PIECE, 1, 0.0)
    for text in [t for t in TEXTS if t and "▁" not in t] + ["Ça a été", "tionthreand   x"]:
        assert array("I", known.encode(text, 7)).tolist() == library.encode(text)


def slow_merge(known, segment, variant):
    """All candidates in one list: best first, leftmost of equals, skipped ones struck out."""
    key, skipped = None, set()
    spans = [(k, k + 1) for k in range(len(segment))]
    from stockline.llm import piece_tokens
    key = piece_tokens._mixed(known.seed + zlib.crc32(segment.encode()) * piece_tokens.VARIANTS + variant)
    while True:
        open_ = [(-known.scores[segment[a:d]], a, b, d) for (a, b), (_, d) in zip(spans, spans[1:], strict=False)
                 if segment[a:d] in known.scores and (a, b, d) not in skipped]
        if not open_:
            return [segment[a:b] for a, b in spans]
        _, a, b, d = min(open_)
        if known.skipped(key, a, b, d):
            skipped.add((a, b, d))
        else:
            spans = [s for s in spans if s[0] < a or s[0] >= d] + [(a, d)]
            spans.sort()


def test_agenda_matches_the_slow_way():
    known, rng = PieceVocabulary(PIECE, 99, 0.3), random.Random(4)
    for _ in range(200):
        segment = "▁" + "".join(rng.choice("thenaiodrs") for _ in range(rng.randrange(1, 14)))
        assert known.merge(segment, 2) == slow_merge(known, segment, 2)


def test_arrays_match_the_agenda():
    rng = random.Random(6)
    for rate in (0.0, 0.2, 1.0):
        known = PieceVocabulary(PIECE, 11, rate)
        words = [("".join(rng.choice("thenaiodrs▁é一\U0001F600\0") for _ in range(rng.randrange(1, 24))), rng.randrange(4))
                 for _ in range(300)]
        assert known.words_ids(words) == [known.segment_ids(*word) for word in words]
    text = " ".join(w.replace("▁", "") for w, _ in words) + " ▁ " + "x" * 100
    assert known.decode(known.encode(text, 3)) == text and known.encode("") == b""


def test_dropout_varies_and_decodes(spark):
    first, again, other = (
        {(r.doc_id, r.ids_crc32) for r in round_trip(docs(spark), PIECE, seed, 0.2).collect()} for seed in (1, 1, 2))
    assert first == again and first != other
    assert all(r.lossless for r in round_trip(docs(spark), PIECE, 5, 0.5).collect())
    rows = encode_documents(docs(spark), PIECE, 3, 0.3)
    assert decode_ids(rows, PIECE, ["text"]).where("coalesce(text, '') <> decoded").count() == 0
    assert round_trip(docs(spark).where("false"), PIECE, 1, 0.1).count() == 0


def test_every_occurrence_has_its_own_draws():
    """A frequent word takes every segmentation its candidates allow, each as often as its draws make it likely."""
    known, n = PieceVocabulary(PIECE, 7, 0.1), 4000
    pieces = [known.pieces[k] for k in array("I", known.encode(" ".join(["considerations"] * n), 5))]
    assert len(set(" ".join(pieces).split(" ▁"))) > 20
    found = []
    for doc_id, words in ((5, n), (6, n), (-6, n)):
        text = " ".join(["considerations"] * words)
        segments, draws = known.segments(text), known.draws([doc_id], [words]).tolist()
        each = [known.segment_ids(*x) for x in zip(segments, draws, strict=True)]
        assert known.encode(text, doc_id) == b"".join(each)
        found.append(each)
    assert len({tuple(each) for each in found}) == 3
    assert all(len(set(each)) > 20 for each in found)
    rng, plain = random.Random(1), PieceVocabulary(PIECE, 7, 0.0).segment_ids("▁considerations", 0)
    likely = sum(known.segment_ids("▁considerations", rng.getrandbits(64)) == plain for _ in range(n)) / n
    assert abs(sum(ids == plain for each in found for ids in each) / (3 * n) - likely) < 0.03


def test_forgetting_words_changes_nothing(monkeypatch):
    from stockline.llm import piece_tokens
    known, text = PieceVocabulary(PIECE, 7, 0.2), " ".join(["some words that are met again", "and again, " * 20, "é" * 40])
    want = known.encode(text, 9)
    monkeypatch.setattr(piece_tokens, "KEPT_SEGMENTS", 8)
    assert [known.encode(text, k) == want for k in (9, 9, 10)] == [True, True, False]

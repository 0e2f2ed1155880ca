"""N-gram join, exact duplicates and I-Match against brute force."""

import hashlib
import random
import sys

import corpus_pipeline
import pytest
from pyspark import cloudpickle

from stockline.llm import exact_dedup, imatch, ngram_join
from stockline.llm.common import BLOCK_BYTES

cloudpickle.register_pickle_by_value(sys.modules[__name__])
FOLD = {k: k + 32 for k in range(65, 91)}
SCHEMA = "doc_id bigint, text string, lang string, cls string, label string, row string, `key` string, entry int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, "x", "y", None, "z", 1) for i, t in rows], SCHEMA).repartition(3)


def near_copies(seed=5):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows, next_id = [], 100
    for size, edits in ((60, 12), (25, 40), (200, 6)):
        base = [rng.choice(words) for _ in range(size)]
        for k in range(30):
            text = list(base)
            for _ in range(rng.randrange(1 + k % 4)):
                text[rng.randrange(len(text))] = rng.choice(words[:edits])
            rows.append((next_id, " ".join(text)))
            next_id += 1
    rows += [(next_id + k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 80)))) for k in range(40)]
    rows += [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE\tTwo"), (6, "one"), (7, "a b c d"), (7, "a b c d"),
             (8, "a b c d e"), (None, "A B c d"), (None, None), (9, "é ß ñ ü x"), (10, "long " + "word " * 30_000)]
    return rows


def shingles(text):
    for c in "\t\n\v\f\r":
        text = (text or "").replace(c, " ")
    w = [x for x in text.translate(FOLD).split(" ") if x]
    return frozenset(tuple(w[k:k + 4]) for k in range(max(1, len(w) - 3))) if w else frozenset()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return sorted(((i, len(s), least.get(g) if s else i) for (i, _), s, g in zip(rows, sets, group, strict=True)), key=str)


@pytest.mark.parametrize("pairs, triples", [(64, 1 << 15), (3, 9), (2, 3)])
def test_components_match_brute_force(spark, monkeypatch, pairs, triples):
    monkeypatch.setattr(ngram_join, "PAIRS_FROM", pairs)
    monkeypatch.setattr(ngram_join, "TRIPLES_FROM", triples)
    monkeypatch.setattr(ngram_join, "STAR_ROUNDS", 1 if pairs == 2 else 4)
    rows = near_copies(pairs)
    found = ngram_join.shingle_components(table(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == brute_components(rows)


def test_short_shares_of_tokens_lose_no_pair(spark, monkeypatch):
    """With far too small a share of tokens most sets go by their single tokens or their level's bucket."""
    monkeypatch.setattr(ngram_join, "level_share", lambda level, percent=85: 1 << 60)
    rows = near_copies(11)[:60]
    found = ngram_join.shingle_components(table(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == brute_components(rows)


def test_one_row_of_each_component_stays(spark):
    rows = near_copies(3)
    docs = table(spark, rows)
    kept = ngram_join.keep_one_per_component(docs)
    assert kept.columns == docs.columns
    brute = brute_components(rows)
    empty = [r for r in brute if r[1] == 0]
    want = {r[2] for r in brute if r[1]}
    found = [r.doc_id for r in kept.collect() if shingles(r.text)]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert kept.where("doc_id in (1, 2, 3)").count() == len([r for r in empty if r[0]])


def brute_five_words(rows):
    """The least doc_id of each row's component: five words, 80 %."""
    words = [(t or "").translate(FOLD).split() for _, t in rows]
    sets = [{tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    return [min(rows[k][0] for k in range(len(rows)) if group[k] == g) for g in group]


@pytest.mark.parametrize("pairs, triples", [(64, 1 << 15), (2, 3)])
def test_the_stage_links_five_words_from_80_percent_on(spark, monkeypatch, pairs, triples):
    monkeypatch.setattr(ngram_join, "PAIRS_FROM", pairs)
    monkeypatch.setattr(ngram_join, "TRIPLES_FROM", triples)
    rows = [(i, t) for i, t in near_copies(7) if i and i != 7]
    rng = random.Random(12)
    for k in range(40):
        base = [f"v{rng.randrange(4000)}" for _ in range(rng.randrange(60, 400))]
        for copy in range(3):
            text = list(base)
            for _ in range(copy * len(base) // 50):
                text[rng.randrange(len(text))] = "other"
            rows.append((10_000 + 3 * k + copy, " ".join(text)))
    # The same words with the first and last one changed are another shingle.
    rows += [(20_000, "p q r s t"), (20_001, "t q r s p")]
    want = brute_five_words(rows)
    docs = table(spark, rows)
    found = ngram_join.shingle_components(docs, 5, 80).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: c for (i, _), c in zip(rows, want, strict=True)}
    assert want != [dict((i, c) for i, _, c in brute_components(rows))[i] for i, _ in rows]
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_empty_tables(spark):
    docs = table(spark, [(1, "x")]).where("false")
    assert ngram_join.shingle_components(docs).count() == 0
    assert ngram_join.keep_one_per_component(docs).count() == 0
    assert exact_dedup.exact_groups(docs).count() == 0
    assert exact_dedup.keep_first_of_equal(docs).count() == 0
    assert imatch.fingerprint_documents(docs).count() == 0


def copies():
    rng = random.Random(2)
    long = " ".join(str(rng.random()) for _ in range(4000))
    rows = [(k, long.upper() if k % 2 else long) for k in range(20, 26)] + [(30, long + "."), (31, "." + long)]
    return rows + [(1, None), (2, ""), (3, "a"), (4, "A"), (5, "É"), (6, "é"), (7, "same"), (7, "same"), (None, "same"),
                   (None, "alone"), (8, long[:30_000] + "Y" + long[30_000:])]


def brute_groups(rows):
    texts = [(t or "").translate(FOLD) for _, t in rows]
    groups = {}
    for (i, _), t in zip(rows, texts, strict=True):
        groups.setdefault(t, []).append(i)
    return sorted(((i, max((x for x in groups[t] if x is not None), default=None), len(groups[t]),
                    hashlib.sha256(t.encode()).hexdigest()) for (i, _), t in zip(rows, texts, strict=True)), key=str)


class CoarseHash(ngram_join.RangeHash):
    """Chunks of very different content share a hash."""

    def of(self, begin, end):
        return super().of(begin, end) & 0xF000000000000003


@pytest.mark.parametrize("coarse", [False, True])
def test_exact_groups_match_brute_force(spark, monkeypatch, coarse):
    if coarse:
        monkeypatch.setattr(exact_dedup, "RangeHash", CoarseHash)
    # Many short texts of one length, on rows without an id or with the same one.
    rows = copies() + [(i, f"{k:04}") for k in range(300) for i in (None, 9)]
    found = exact_dedup.exact_groups(table(spark, rows)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=str) == brute_groups(rows)
    kept = [r for r in found if r.kept]
    assert len(kept) == len({r.text_sha256 for r in found}) and all(r.doc_id == r.keep_id for r in kept)


def test_kept_rows_keep_their_columns(spark):
    docs = table(spark, copies())
    kept = exact_dedup.keep_first_of_equal(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({r[3] for r in brute_groups(copies())})


HELPERS = ("_kept_id _kept_sha _sha _turn _cls _id _key recipe variants row cls class_id component keep n group_size "
           "text_sha256 n_bytes best wanted tokens entry").split()


@pytest.mark.parametrize("change", [str, str.upper, lambda n: n + "_"])
def test_stages_leave_columns_of_any_name_alone(spark, change):
    names = [change(n) for n in HELPERS]
    rows = near_copies(3)[:40] + copies()
    docs = spark.createDataFrame([(i, t, *[f"{k} {n}" for n in names]) for k, (i, t) in enumerate(rows)],
                                 "doc_id bigint, text string, " + ", ".join(f"`{n}` string" for n in names)).repartition(3)
    held = {tuple(r) for r in docs.collect()}
    for stage, plain in ((exact_dedup.keep_first_of_equal, exact_dedup.keep_first_of_equal(table(spark, rows))),
                         (ngram_join.keep_one_per_component, ngram_join.keep_one_per_component(table(spark, rows)))):
        kept = stage(docs)
        assert kept.columns == docs.columns
        found = kept.collect()
        assert {tuple(r) for r in found} <= held
        assert sorted((str(r.doc_id), r.text or "") for r in found) == sorted((str(r.doc_id), r.text or "") for r in plain.collect())


def test_texts_of_several_blocks(spark):
    """A text longer than a block of bytes, its copy, and a near copy."""
    rng = random.Random(12)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(200_000))
    assert len(long) > BLOCK_BYTES
    docs = table(spark, [(1, long), (2, long.upper()), (3, long + " tail"), (4, "w1 w2 w3 w4 w5")])
    assert sorted((r.doc_id, r.component_id) for r in ngram_join.shingle_components(docs).collect()) == [(1, 1), (2, 1), (3, 1), (4, 4)]
    assert sorted((r.doc_id, r.keep_id) for r in exact_dedup.exact_groups(docs).collect()) == [(1, 2), (2, 2), (3, 3), (4, 4)]


def brute_imatch(rows):
    rows = sorted(rows)
    words = [sorted({w for w in text.translate(FOLD).split(" ") if w}) for _, text in rows]
    counts = {}
    for w in words:
        for t in w:
            counts[t] = counts.get(t, 0) + 1
    lexicon = {t for t, n in counts.items() if max(2, 0.01 * len(rows)) <= n <= 0.1 * len(rows)}

    def parts(text):
        terms = sorted({w for w in text.translate(FOLD).split(" ") if w})
        held = [t for t in terms if t in lexicon]
        used = held if len(held) >= imatch.LEAST_TERMS else terms
        subset = {t: int(hashlib.md5(t.encode()).hexdigest()[0], 16) + 16 * (int(hashlib.md5(t.encode()).hexdigest()[1], 16) % 3)
                  for t in used}
        chosen = [[t for t in used if subset[t] == k] for k in range(48)]
        return [hashlib.md5(" ".join(c).encode()).hexdigest()[:8] if c else "" for c in chosen]

    found = []
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        edited = text[:len(text) - len(text) // 2] + after[:len(text) // 2]
        one, two, three = parts(text), parts(edited), parts(after)
        share = []
        for x in (two, three):
            either = [(a, b) for a, b in zip(one, x, strict=True) if a or b]
            share.append(sum(a == b for a, b in either) / len(either) if either else 1.0)
        found.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), "-".join(one), "-".join(two), *share))
    return found


def test_imatch_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(imatch, "RANGE_ROWS", 16)
    rng = random.Random(8)
    words = [f"t{k}é" for k in range(300)]
    rows = [(k * 7, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for k in range(100)]
    rows += [(1000 + k, rows[k][1]) for k in range(5)] + [(2000, "𝒳 " * 9), (2001, "")]
    found = imatch.fingerprint_documents(table(spark, rows)).orderBy("doc_id").collect()
    for got, want in zip(found, brute_imatch(rows), strict=True):
        assert tuple(got)[:5] == want[:5] and tuple(got)[5:7] == pytest.approx(want[5:])


def test_imatch_takes_nulls_and_repeated_rows(spark):
    rows = [(None, None), (None, "a b"), (1, None), (2, "x y z"), (2, "x y z"), (2, "other")]
    found = imatch.fingerprint_documents(table(spark, rows)).collect()
    assert len(found) == len(rows)
    same = {r.fingerprint for r in found if r.doc_id == 2 and r.n_chars == 5 and r.fingerprint}
    assert len({r.fingerprint for r in found if r.n_chars == 0}) == 1 and len(same) <= 2
    alone = imatch.fingerprint_documents(table(spark, [(5, "a b c d")])).first()
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256(b"a b a b").hexdigest()

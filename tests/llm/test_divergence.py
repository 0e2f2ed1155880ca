"""Source divergence against brute force."""

import random
import re
from collections import Counter

import pytest

from stockline.llm import divergence

FOLD = {k: k + 32 for k in range(65, 91)}
SCHEMA = "doc_id bigint, text string, lang string, source string, term string, n int, shard string, item string, kind int"


def rows_of(seed, size=150):
    rng = random.Random(seed)
    words = [f"{rng.choice('aeiouéßж')}{rng.choice('xyz')}{rng.choice('QRst')}" for _ in range(40)]
    rows = []
    for k in range(size):
        lang = rng.choice(["en", "en", "en", "de", None])
        source = "s0" if rng.random() < 0.4 else rng.choice(["s1", "s2", "é", "Z", None])
        text = " ".join(rng.choice(words[:20 + 5 * (k % 5)]) + rng.choice(["", "1", "-", ","]) for _ in range(rng.randrange(0, 25)))
        rows.append((k, rng.choice([text, text, text, None, "", "12 34 .."]), lang, source))
    rows += [rows[3]] * 30
    return rows + [(900, "lonely", "fr", "only"), (901, None, "xx", "a"), (902, "", "xx", "b"), (None, "x " * 50_000, "en", "s0")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "t", 7, "x", "y", 1) for r in rows], SCHEMA).repartition(5)


def brute(rows, least=10, top=10):
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(FOLD)))
            for _, text, lang, source in rows]
    found = []
    for lang in {d[0] for d in docs}:
        df = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        terms = [t for t in df if df[t] >= least]
        counts = {g: Counter() for g in {d[1] for d in docs if d[0] == lang}}
        for d in docs:
            if d[0] == lang:
                counts[d[1]].update(t for t in d[2] if df[t] >= least)
        whole = sum(counts.values(), Counter())

        def p(c, t):
            return 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(terms))

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for g, c in counts.items():
            pairs = sorted((-sum(f(p(c, t), p(o, t)) for t in terms), h.encode(), h) for h, o in counts.items() if h != g)
            found += [(lang, g, "pair", h, -v, k + 1) for k, (v, _, h) in enumerate(pairs)]
            own = sorted((-f(p(c, t), p(whole, t)), t.encode(), t) for t in terms if c[t] and p(c, t) > p(whole, t))
            found += [(lang, g, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(own[:top])]
    return sorted(found)


def result(found):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in found.collect())


@pytest.mark.parametrize("seed, run, shard, held, block", [(1, 600_000, 400_000, 1 << 21, 1 << 20), (2, 40, 30, 4, 300), (3, 7, 11, 1, 100)])
def test_divergence_matches_brute_force(spark, monkeypatch, seed, run, shard, held, block):
    """Small limits force many runs, shards and partial sums."""
    monkeypatch.setattr(divergence, "RUN_POSTINGS", run)
    monkeypatch.setattr(divergence, "SHARD_POSTINGS", shard)
    monkeypatch.setattr(divergence, "PAIRS_HELD", held)
    monkeypatch.setattr("stockline.llm.common.BLOCK_BYTES", block)
    rows = rows_of(seed)
    assert result(divergence.source_divergence(frame(spark, rows))) == brute(rows)


def test_divergence_of_odd_tables(spark):
    assert divergence.source_divergence(frame(spark, rows_of(1)[:1]).where("false")).count() == 0
    rows = [(1, None, None, None), (2, "", None, "s")]
    assert result(divergence.source_divergence(frame(spark, rows))) == brute(rows) == [
        ("", "", "pair", "s", 0, 1), ("", "s", "pair", "", 0, 1)]


def test_shares_are_exact():
    import numpy as np

    counts = np.array([0, 1, 10**9, 10**12, 4 * 10**15])
    for total in (3, 7 * 10**9 + 1, 9 * 10**15 - 1):
        assert divergence.share(counts[counts < 2 * total], np.int64(total)).tolist() == [
            1 + 10**9 * (int(c) + 2) // total for c in counts if c < 2 * total]

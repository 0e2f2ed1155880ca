"""Licence scans against naive searches."""

import random
import re
from itertools import combinations

import pytest

from stockline.llm import license_scan
from stockline.llm.license_scan import LicenseScanner, SuffixAutomaton, best_chains, license_spans, scan_licenses, words_of

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
SCHEMA = "doc_id bigint, text string, label string, score string, labels int, n_words string, template string"


@pytest.mark.parametrize("seed", range(6))
def test_automaton_matches_naive_search(seed):
    rng = random.Random(seed)
    sequences = [[rng.randrange(3 + seed) for _ in range(rng.randrange(1, 25))] for _ in range(6)]
    text = [rng.randrange(4 + seed) for _ in range(150)] + sequences[2] + sequences[0][3:]
    automaton = SuffixAutomaton(sequences)
    assert len(automaton.next) <= 2 * sum(map(len, sequences))
    for k, (state, length) in enumerate(automaton.stream(text)):
        def places(n, end=k):
            part = text[end + 1 - n:end + 1]
            return [(q, e) for q, s in enumerate(sequences) for e in range(n, len(s) + 1) if s[e - n:e] == part]
        longest = max((n for n in range(1, k + 2) if n <= 40 and places(n)), default=0)
        assert length == longest
        if length:
            assert sorted(automaton.ends[state]) == places(length)


def brute_chain(matches):
    """The most words any allowed chain covers."""
    best = 0
    for n in range(1, len(matches) + 1):
        for chosen in combinations(matches, n):
            total = chosen[0][2]
            for (e0, p0, n0), (e1, p1, n1) in zip(chosen, chosen[1:], strict=False):
                if not (e0 - n0 < e1 - n1 and p0 - n0 < p1 - n1 and e0 < e1 and p0 < p1
                        and e1 - n1 - e0 <= license_scan.GAP):
                    break
                total += n1 - max(0, e0 - (e1 - n1), p0 - (p1 - n1))
            else:
                best = max(best, total)
    return best


@pytest.mark.parametrize("seed", range(8))
def test_chains_match_exhaustive_search(seed):
    rng = random.Random(seed)
    matches = sorted((rng.randrange(5, 90), rng.randrange(5, 60), rng.randrange(4, 6)) for _ in range(9))
    chains = best_chains(0, matches)
    assert max(c.covered for c in chains) == brute_chain(matches)
    spans = sorted((c.first, c.last) for c in chains)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


def texts(scanner):
    rng = random.Random(4)
    notices = [t for of in license_scan.TEMPLATES.values() for t in of]
    prose = "the of in and warranty software to any kind a license mit public general apache terms free".split()
    rows = [None, "", " .,- ", "MIT license", "the mit\nLICENSE, Apache  license; general public license general Public-License",
            "mit licenses xmit license mit. license", "general license public", "mit " * 30_000 + "license"]
    for k in range(60):
        words = [rng.choice(prose) for _ in range(rng.randrange(0, 120))]
        if k % 2:
            notice = rng.choice(notices).split()
            for _ in range(k % 5):
                notice[rng.randrange(len(notice))] = "changed"
            at = rng.randrange(len(words) + 1)
            words[at:at] = notice
        rows.append(" ".join(words))
    return rows + notices + ["é mit license ß " * 5_000]


def base_of(text):
    words, found = words_of(text or ""), []
    for phrase, label in BASE.items():
        part = phrase.split()
        found += [(k, label) for k in range(len(words)) if words[k:k + len(part)] == part]
    return len(words), len(found), min(found)[0] if found else None, max(found)[0] if found else None, ",".join(sorted({x for _, x in found}))


def test_scan_matches_brute_force(spark, monkeypatch):
    scanner = LicenseScanner()
    rows = texts(scanner)
    frame = spark.createDataFrame([(k, t, "x", "y", 3, "z", "t") for k, t in enumerate(rows)] + [(None, rows[3], "x", "y", 3, "z", "t")],
                                  SCHEMA).repartition(3)
    monkeypatch.setattr("stockline.llm.common.BLOCK_BYTES", 3000)
    found = {r.doc_id: r for r in scan_licenses(frame).collect()}
    assert len(found) == len(rows) + 1 and found[None].base_labels == "mit"
    for k, text in enumerate(rows):
        r = found[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_of(text), k
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels
        # The same without arrays: all words of the text as one stretch, unknown ones as a word of their own.
        words = [scanner.ids.get(w, -1) for w in words_of(text or "")]
        places, chains = scanner.scan([(0, words)])
        assert (r.n_base, r.labels, r.score) == tuple(license_scan._digest(scanner, places, chains)[i] for i in (0, 4, 5)), k
        assert 0 <= r.score <= 1 and (r.score > 0) >= bool(r.labels)
    assert scan_licenses(frame.where("false")).count() == license_spans(frame.where("false")).count() == 0


def test_notices_are_found_as_spans(spark):
    rows, k = [], 0
    for label, of in license_scan.TEMPLATES.items():
        for text in of:
            rows.append((k, label, "Some words before. " + text + " And some after it."))
            rows.append((k + 1, label, "Before " + re.sub(r"(\w+) (\w+) (\w+)$", r"\1 \3", text).upper() + " after"))
            k += 2
    frame = spark.createDataFrame(rows, "doc_id bigint, label string, text string")
    spans = license_spans(frame).collect()
    for i, label, text in rows:
        assert label in {s.label for s in spans if s.doc_id == i}, text
    whole = [s for s in spans if s.doc_id % 2 == 0 and s.share == 1.0]
    assert {s.doc_id for s in whole} == set(range(0, k, 2))
    assert all(s.first_word == 3 for s in whole if s.template == s.doc_id // 2)
    clean = spark.createDataFrame([(1, "The license of the software is in the public domain and free to use. " * 20)], "doc_id bigint, text string")
    assert license_spans(clean).count() == 0

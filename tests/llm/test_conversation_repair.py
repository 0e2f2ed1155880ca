"""Conversation repair against an exhaustive search and against its SQL."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest

from stockline.llm import conversation_repair
from stockline.llm.conversation_repair import END, audit_conversations, block_matrix, kind_of, walk
from stockline.llm.queries import OP13_SQL

SCHEMA = "conv_id bigint, turn bigint, role string, text string, place int, fault string, `row` string, step string"
NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
NAME = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """Least cost, then ASCII-least edits, by uniform-cost search over (rows taken, last role)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, edits, k, last, lines = heapq.heappop(heap)
        if k == len(rows) and last in ("", "a"):
            return cost, edits, lines
        if (k, last) in done:
            continue
        done.add((k, last))
        for r, name in NAME.items():
            if r in NEXT[last]:
                heapq.heappush(heap, (cost + 2, edits + "I", k, r, (*lines, name + ":")))
        if k < len(rows):
            role, text, fault = rows[k]
            heapq.heappush(heap, (cost + 3, edits + "D", k + 1, last, lines))
            if fault in ("", "truncated"):
                more = cost + (fault == "truncated")
                if role[:1] in NEXT[last]:
                    heapq.heappush(heap, (more, edits + "K", k + 1, role[0], (*lines, f"{role}:{text}")))
                for r, name in NAME.items():
                    if r in NEXT[last]:
                        heapq.heappush(heap, (more + 2, edits + "R", k + 1, r, (*lines, f"{name}:{text}")))


def brute(rows):
    found = []
    for conv in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            kept += [(turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faulty = set(), []
        for _, role, text in kept:
            words = text.strip(" \t\n\v\f\r")
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = {r[0] for r in kept if r[0] is not None}
        cost, edits, lines = cheapest(faulty)
        found.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0,
                      *(sum(r[2] == f for r in faulty) for f in ("blank", "duplicate", "truncated")),
                      sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:], strict=False)),
                      cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(found, key=str)


def rows_of(seed, n):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        size = rng.choice([1, 2, 3, 5, 8, 30])
        for turn in range(size):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else "user" if turn % 2 else "assistant"
            role = rng.choice([role] * 8 + ["system", None, "", "tool"])
            text = rng.choice(["Fine.", "Why?", "cut short", "é!", "", " \t", None, f"Number {rng.randrange(90)}. \n", "a.b\nuser:x"])
            rows.append((conv, rng.choice([turn + 3] * 9 + [None, 2, 2 * turn]), role, text))
    rows += [(None, 1, "user", "x"), (None, None, "assistant", "y."), (7, 3, "user", "Fine.")] + [(10_000, 1, "user", "Same.")] * 150
    return rows + [(10_001, 5, "user", "long. " * 40_000), (10_001, 6, "assistant", "z" * 200_000)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 4, "f", "r", "s") for r in rows], SCHEMA).repartition(4)


def result(found):
    names = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    return sorted((tuple(r[n] for n in names) for r in found.collect()), key=str)


@pytest.mark.parametrize("seed, block, chars", [(1, 1024, 1 << 16), (2, 3, 1 << 16), (3, 1, 10), (4, 7, 40)])
def test_repair_matches_exhaustive_search(spark, monkeypatch, seed, block, chars):
    """Small blocks spread a conversation over many checkpoints."""
    monkeypatch.setattr(conversation_repair, "BLOCK_ROWS", block)
    monkeypatch.setattr(conversation_repair, "BLOCK_CHARS", chars)
    rows = rows_of(seed, 90)
    assert result(audit_conversations(frame(spark, rows))) == brute(rows)


def test_sql_matches_exhaustive_search():
    rows = rows_of(9, 60)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(con.execute(OP13_SQL).fetchall(), key=str) == brute(rows)


@pytest.mark.parametrize("seed", range(40))
def test_walks_joined_at_checkpoints(seed):
    """A walk cut at any place gives what the whole walk gives, and matrices give the vectors between."""
    rng = random.Random(seed)
    rows = [(rng.choice(["user", "assistant", "system", "x"]), rng.choice([0, 0, 0, 1, 2])) for _ in range(rng.randrange(0, 60))]
    kinds = bytes(kind_of(*r) for r in rows)
    edits, state, cost = walk(kinds, END, 0)
    whole = cheapest([(r, "", ["", "truncated", "blank"][f]) for r, f in rows])
    assert (cost + END[state], edits + "I" * (END[state] // 2)) == whole[:2]
    cut = rng.randrange(len(kinds) + 1)
    matrix = block_matrix(kinds[cut:])
    between = tuple(min(matrix[4 * s + e] + END[e] for e in range(4)) for s in range(4))
    first, middle, spent = walk(kinds[:cut], between, 0)
    second, last, more = walk(kinds[cut:], END, middle)
    assert (first + second, last, spent + more) == (edits, state, cost)


def test_odd_conversations(spark):
    assert audit_conversations(frame(spark, rows_of(1, 3)).where("false")).count() == 0
    huge = [(1, -(1 << 63), "user", "a."), (1, (1 << 63) - 1, "assistant", "b.")]
    assert audit_conversations(frame(spark, huge)).collect()[0].gaps in (0, (1 << 63) - 1)
    dropped = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    assert result(audit_conversations(frame(spark, [(dropped, 0, "user", "x.")]))) == [
        (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]

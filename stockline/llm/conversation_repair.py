"""Cheapest repair of conversations whose turns were lost, emptied, cut short, repeated or given to the wrong speaker.

A conversation's rows are edited until its roles read ``(s?(ua)+)?`` (an optional system turn, then user and assistant in
turn): Keep costs 0, Rerole to user or assistant 2, Delete 3 (a must for blank and repeated rows), Insert of an empty
user or assistant turn 2; a cut-short row that stays costs 1 more. Of the cheapest edits those whose initials come first
in ASCII order are taken. Roles are followed by four states; a row's edits form a (min, +) step between them.

*Square-root checkpoints.* Only the state-cost vectors at the ends of blocks are stored; the vectors inside a block are
computed again, from the next stored one, when the walk forward comes to it. This is done on two levels, so that a
conversation of any length is worked on by many tasks:

1. All rows are sorted by conversation, turn, role and text across the cluster and cut into blocks of at most
   ``BLOCK_ROWS`` rows and some ``BLOCK_CHARS`` characters. Each block gives a 4 x 4 matrix of costs, its counts of faults
   and one byte per row.
2. One small row per block, read from last to first, gives the vector after each block: the stored checkpoints.
3. Each block is walked by itself from each state it may be entered in, with vectors stored every square root of its
   rows and recomputed in between.
4. One row per block, read from first to last, joins the walks and feeds the repaired lines to the hash. A hash like
   SHA-256 is sequential, so here a conversation stays in one task, as a stream of blocks.

A row repeats an earlier one if role and text are equal; the earliest is found by an aggregate, so a text repeated by a
third of all rows is split over tasks. Equal rows with equal turns follow each other, rows without a turn come first.

Memory: a task holds one block, and the edits' letters of one conversation, which are part of its result.

Defined cases: null role or text (and null parts of the damage key) are one space; such a role fits no pattern and is
reroled or deleted. Rows without conv_id form one conversation. A conversation without rows has zeros, empty edits and
the hash of the empty string. Gaps count missing turn numbers between the first and last one; a conversation without any
turn number has 0 (gaps beyond a long are the largest long). An empty table gives an empty result. Other columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from stockline.llm.common import stored, worker_value

#: Rows and characters of a block; a longer text is a block of its own.
BLOCK_ROWS, BLOCK_CHARS = 1024, 1 << 16
WHITE, ENDINGS = " \t\n\v\f\r", ".!?"
#: States: nothing yet, after system, after user, after assistant.
STATES, USER, ASSISTANT = 4, 2, 3
INSERTED = (USER, USER, ASSISTANT, USER)
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NAMES = {USER: "user", ASSISTANT: "assistant"}
INITIALS, OK, TRUNCATED, GONE = "sua", 0, 1, 2
LEGAL = {"su", "ua", "au"}
NEVER = 1 << 40
#: Costs at the end of a conversation, by state.
END = (0, 4, 2, 0)


def damage(rows: DataFrame) -> DataFrame:
    """The conversations as a careless store returns them: a fixed rule by a hash of conversation and turn."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fate = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return rows.select(
        "conv_id", "turn", F.when(fate == 4, "user").otherwise(role).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.translate(text, ENDINGS, "")).otherwise(text).alias("text"),
        F.explode(F.when(fate == 0, F.array().cast("array<int>")).when(fate == 3, F.array(F.lit(0), F.lit(1)))
                  .otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def kind_of(role: str, fault: int) -> int:
    """One number for what matters of a row: its initial (3: none that fits) and fault."""
    return 3 * (INITIALS.find(role[0]) % 4 if role else 3) + fault


def _level(vector: list[int]) -> tuple[tuple[int, ...], int]:
    low = min(vector)
    return tuple(NEVER if v >= NEVER // 2 else v - low for v in vector), low


def remembered(function, *key):
    """A worker keeps what it has worked out: less their minimum, costs take few values."""
    known = worker_value(("repair", function.__name__), dict)
    if key not in known:
        known[key] = function(*key)
    return known[key]


def before(kind: int, after: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """Costs before a row of that kind from those after it, less their minimum, and that minimum."""
    return remembered(_before, kind, after)


def choose(kind: int, after: tuple[int, ...], state: int) -> tuple[str, int, int]:
    """The cheapest edits for a row and inserts before it, ASCII-least, then the state after it and their cost."""
    return remembered(_choose, kind, after, state)


def _before(kind: int, after: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    initial, fault = INITIALS[kind // 3:kind // 3 + 1], kind % 3
    costs = []
    for state in range(STATES):
        ways = [3 + after[state]]
        if fault != GONE:
            ways.append(fault + 2 + after[INSERTED[state]])
            if initial in KEPT[state]:
                ways.append(fault + after[KEPT[state][initial]])
        costs.append(min(ways))
    user, assistant = min(costs[2], 2 + costs[3]), min(costs[3], 2 + costs[2])
    return _level([min(costs[0], 2 + user), min(costs[1], 2 + user), user, assistant])


def _choose(kind: int, after: tuple[int, ...], state: int) -> tuple[str, int, int]:
    initial, fault = INITIALS[kind // 3:kind // 3 + 1], kind % 3
    costs, low = before(kind, after)
    edits, spent = "", 0
    while True:
        left = costs[state] + low
        if 3 + after[state] == left:
            return edits + "D", state, spent + 3
        if 2 + costs[INSERTED[state]] + low == left:
            edits, state, spent = edits + "I", INSERTED[state], spent + 2
        elif initial in KEPT[state] and fault + after[KEPT[state][initial]] == left:
            return edits + "K", KEPT[state][initial], spent + fault
        else:
            return edits + "R", INSERTED[state], spent + fault + 2


def block_matrix(kinds: bytes) -> list[int]:
    """Costs from each state before a block (rows) to each state after it (columns)."""
    columns = []
    for end in range(STATES):
        vector, total = tuple(0 if s == end else NEVER for s in range(STATES)), 0
        for kind in reversed(kinds):
            vector, low = before(kind, vector)
            total += low
        columns.append([v if v >= NEVER else v + total for v in vector])
    return [columns[end][state] for state in range(STATES) for end in range(STATES)]


def walk(kinds: bytes, after: tuple[int, ...], state: int) -> tuple[str, int, int]:
    """Edits of a block entered in a state, the state it is left in, and their cost.

    ``after`` has the costs behind the block. Vectors are stored every square root of its rows.
    """
    size = isqrt(len(kinds)) + 1
    stored_at = {}
    vector = _level(list(after))[0]
    for place in range(len(kinds) - 1, -1, -1):
        if (place + 1) % size == 0 or place + 1 == len(kinds):
            stored_at[place // size] = vector
        vector = before(kinds[place], vector)[0]
    edits, cost = [], 0
    for part in range(-(-len(kinds) // size)):
        rows = kinds[part * size:(part + 1) * size]
        vectors = [stored_at[part]]
        for kind in reversed(rows[1:]):
            vectors.append(before(kind, vectors[-1])[0])
        for kind, vector in zip(rows, reversed(vectors), strict=True):
            taken, state, spent = choose(kind, vector, state)
            edits.append(taken)
            cost += spent
    return "".join(edits), state, cost


def lines(edits: str, state: int, roles: list[str], texts: list[str]) -> Iterator[str]:
    """The repaired turns as ``role:text``."""
    rows = iter(zip(roles, texts, strict=True))
    for edit in edits:
        if edit == "I":
            state = INSERTED[state]
            yield NAMES[state] + ":"
            continue
        role, text = next(rows)
        if edit == "K":
            state = KEPT[state][role[0]]
            yield f"{role}:{text}"
        elif edit == "R":
            state = INSERTED[state]
            yield f"{NAMES[state]}:{text}"


_BLOCK = ("place long, kinds binary, matrix array<long>, blank long, duplicate long, truncated long, illegal long, "
          "first_initial string, last_initial string, least_turn long, most_turn long, turns long, roles array<string>, "
          "texts array<string>")


class _Block:
    """Rows of one conversation that follow each other."""

    def __init__(self, conv):
        self.conv, self.chars = conv, 0
        self.turns, self.roles, self.texts, self.faults = [], [], [], []

    def add(self, turn, role: str, text: str, fault: str) -> None:
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.faults.append(fault)
        self.chars += len(text)

    def full(self) -> bool:
        return len(self.roles) >= BLOCK_ROWS or self.chars >= BLOCK_CHARS

    def row(self, place: int) -> dict:
        gone = {"blank": GONE, "duplicate": GONE, "truncated": TRUNCATED}
        kinds = bytes(kind_of(r, gone.get(f, OK)) for r, f in zip(self.roles, self.faults, strict=True))
        initials = [r[:1] for r in self.roles]
        turns = [t for t in self.turns if t is not None]
        return {"conv_id": self.conv, "place": place, "kinds": kinds, "matrix": block_matrix(kinds),
                **{f: self.faults.count(f) for f in ("blank", "duplicate", "truncated")},
                "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)),
                "first_initial": initials[0], "last_initial": initials[-1], "least_turn": turns[0] if turns else None,
                "most_turn": turns[-1] if turns else None, "turns": len(set(turns)), "roles": self.roles, "texts": self.texts}


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += sum(map(len, row.get("texts") or ())) + len(row.get("audit") or "")
        if len(held) >= 1000 or chars >= 1 << 23:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _each(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            yield from zip(*(part[name].to_pylist() for name in names), strict=True)


def _cut(schema: pa.Schema):
    def blocks(rows: Iterator[tuple]) -> Iterator[dict]:
        place, block = TaskContext.get().partitionId() << 32, None
        for conv, turn, role, text, fault in rows:
            if block is None or block.conv != conv or block.full():
                if block is not None:
                    yield block.row(place)
                    place += 1
                block = _Block(conv)
            block.add(turn, role, text, fault)
        if block is not None:
            yield block.row(place)

    return lambda batches: _batches(blocks(_each(batches, ["conv_id", "turn", "role", "text", "fault"])), schema)


def _checkpoints(schema: pa.Schema):
    """Costs behind each block, from rows sorted by conversation and descending place."""
    def vectors(rows: Iterator[tuple]) -> Iterator[dict]:
        held, vector, total = None, END, 0
        for conv, place, matrix in rows:
            if held is not None:
                held["first"] = held["conv_id"] != conv
                yield held
            if held is None or held["first"]:
                vector = END
            held = {"conv_id": conv, "place": place, "after": list(vector)}
            vector, _ = _level([min(matrix[STATES * s + e] + vector[e] for e in range(STATES)) for s in range(STATES)])
        if held is not None:
            yield {**held, "first": True}

    return lambda batches: _batches(vectors(_each(batches, ["conv_id", "place", "matrix"])), schema)


def _walks(schema: pa.Schema):
    def walked(rows: Iterator[tuple]) -> Iterator[dict]:
        for conv, place, kinds, after, first in rows:
            ways = [walk(kinds, tuple(after), s) for s in range(1 if first else STATES)]
            yield {"conv_id": conv, "place": place, "edits": [w[0] for w in ways], "exits": [w[1] for w in ways],
                   "costs": [w[2] for w in ways]}

    return lambda batches: _batches(walked(_each(batches, ["conv_id", "place", "kinds", "after", "first"])), schema)


class _Report:
    """What is known of a conversation after some of its blocks."""

    def __init__(self, conv):
        self.conv, self.state, self.cost, self.audit = conv, 0, 0, []
        self.hash, self.empty = hashlib.sha256(), True
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.last, self.least, self.most, self.turns = None, None, None, 0

    def feed(self, line: str) -> None:
        self.hash.update((line if self.empty else "\n" + line).encode())
        self.empty = False

    def add(self, way: tuple, block: tuple) -> None:
        edits, exits, costs = (x[self.state] for x in way)
        blank, duplicate, truncated, illegal, first, last, least, most, turns, roles, texts = block
        for line in lines(edits, self.state, roles, texts):
            self.feed(line)
        self.audit.append(edits)
        self.state, self.cost = exits, self.cost + costs
        for name, n in zip(self.counts, (blank, duplicate, truncated, illegal), strict=True):
            self.counts[name] += n
        self.counts["illegal"] += self.last is not None and self.last + first not in LEGAL
        self.last = last
        if turns:
            self.turns += turns - (self.most == least)
            self.least, self.most = least if self.least is None else self.least, most

    def row(self) -> dict:
        for _ in range(END[self.state] // 2):
            self.state = INSERTED[self.state]
            self.cost += 2
            self.audit.append("I")
            self.feed(NAMES[self.state] + ":")
        gaps = min(self.most - self.least + 1 - self.turns, (1 << 63) - 1) if self.turns else 0
        return {"conv_id": self.conv, "gaps": gaps, **self.counts, "cost": self.cost, "audit": "".join(self.audit),
                "repaired_sha256": self.hash.hexdigest()}


_WAY = ["edits", "exits", "costs"]
_FACTS = ["blank", "duplicate", "truncated", "illegal", "first_initial", "last_initial", "least_turn", "most_turn", "turns",
          "roles", "texts"]


def _reports(schema: pa.Schema):
    """Joins the walks of a conversation's blocks, from rows sorted by conversation and place, walk before block."""
    def reports(rows: Iterator[tuple]) -> Iterator[dict]:
        at, way = None, None
        for conv, step, *values in rows:
            if at is not None and at.conv != conv:
                yield at.row()
                at = None
            if at is None:
                at = _Report(conv)
            if step == 0:
                way = values[:len(_WAY)]
            else:
                at.add(way, values[len(_WAY):])
        if at is not None:
            yield at.row()

    return lambda batches: _batches(reports(_each(batches, ["conv_id", "step", *_WAY, *_FACTS])), schema)


_REPORT = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
           "repaired_sha256 string")


def faults(rows: DataFrame) -> DataFrame:
    """Rows with a fixed number ``row`` and their first ``fault``: blank, duplicate, truncated or none."""
    numbered = stored(rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text",
                                  F.monotonically_increasing_id().alias("row")), "turns")
    digest = F.sha2(F.concat_ws("\n", "role", "text"), 256)
    firsts = (numbered.groupBy("conv_id", "role", digest.alias("digest"))
              .agg(F.min(F.struct("turn", "row")).alias("x"))
              .select(F.col("conv_id").alias("of"), F.col("role").alias("by"), "digest", F.col("x.row").alias("earliest")))
    trimmed = F.rtrim("text", F.lit(WHITE))
    joined = numbered.join(firsts, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("role") == F.col("by"))
                           & (digest == F.col("digest")))
    fault = (F.when(trimmed == "", "blank").when(F.col("row") != F.col("earliest"), "duplicate")
             .when(~F.right(trimmed, F.lit(1)).isin(*ENDINGS), "truncated").otherwise(""))
    return joined.select("conv_id", "turn", "role", "text", "row", fault.alias("fault"))


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation among ``rows`` (conv_id, turn, role, text without nulls in the last two)."""
    def shape(columns: str) -> tuple[str, pa.Schema]:
        ddl = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {columns}"
        return ddl, to_arrow_schema(StructType.fromDDL(ddl))

    order = ["conv_id", "turn", "role", "text", "row"]
    ddl, schema = shape(_BLOCK)
    ranged = faults(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = stored(ranged.mapInArrow(_cut(schema), ddl), "turn-blocks")
    ddl, schema = shape("place long, after array<long>, first boolean")
    vectors = (blocks.select("conv_id", "place", "matrix").repartition("conv_id")
               .sortWithinPartitions("conv_id", F.desc("place")).mapInArrow(_checkpoints(schema), ddl))
    ddl, schema = shape("place long, edits array<string>, exits array<int>, costs array<long>")
    walks = (blocks.select("conv_id", "place", "kinds").join(vectors.drop("conv_id"), "place")
             .select("conv_id", "place", "kinds", "after", "first").mapInArrow(_walks(schema), ddl))
    both = walks.withColumn("step", F.lit(0)).unionByName(
        blocks.select("conv_id", "place", F.lit(1).alias("step"), *_FACTS), allowMissingColumns=True)
    ddl, schema = shape(_REPORT)
    return (both.select("conv_id", "step", "place", *_WAY, *_FACTS).repartition("conv_id")
            .sortWithinPartitions("conv_id", "place", "step").mapInArrow(_reports(schema), ddl))


def audit_conversations(conversations: DataFrame) -> DataFrame:
    """Every conversation's faults after damage and its cheapest repair."""
    whole = conversations.select("conv_id").distinct().withColumnRenamed("conv_id", "of")
    found = repair(damage(conversations.select("conv_id", "turn", "role", "text")))
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    joined = whole.join(found, F.col("of").eqNullSafe(F.col("conv_id")), "left")
    return joined.select(F.col("of").alias("conv_id"), *(F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in numbers),
                         F.coalesce("audit", F.lit("")).alias("audit"),
                         F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))

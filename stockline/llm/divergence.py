"""How far the sources of a language differ in their use of words, from a single-pass in-memory index.

1. *Block postings.* Every task reads its documents once and keeps postings (language, source, term) -> (occurrences,
   documents) in memory. When ``RUN_POSTINGS`` distinct ones are held, they leave as a run sorted by term.
2. *Merge.* Runs are dealt to shards by the hash of (term, lang). In each shard Spark's external sort merges them (a heap
   over its sorted spills), and a stream over the merged rows adds up equal postings. A term stays if enough documents
   of its language hold it. Nothing but the postings of the term at hand is kept.
3. *Totals* per group (language and source) and per language are sums over the kept postings.
4. *Pair corrections.* The sum over all kept terms of a function of two shares is first taken as if no source held any
   term; what single sources change (once per distinct count of a source) and what two sources change together (from
   the merged postings, one after another) is added. Kept postings are dealt to shards again, so that a large language
   is worked on by many tasks, and each shard adds up its corrections before they are shuffled.

All numbers are whole and exact: a share is p = 1 + floor(10**9 * (count + 2) / (n + 2 * terms)), the distance of two
shares floor((p - q)**2 / (p + q)). Exact for up to 9 * 10**15 occurrences in a language. Inside one run terms are
told apart by 64-bit hashes, across runs by their letters.

Memory: a task holds one run, the postings of one term, or the sources of one language with the pairs it has met (at
most ``PAIRS_HELD``, then they leave as a partial sum). The result itself has a row per pair of sources of a language.

Defined cases: null text, lang and source are read as ''. Texts without terms still make their group appear, with all
counts zero. A language without kept terms has distance 0 for all pairs; one with one source has no pairs. Repeated rows
count as often as they stand there. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stockline.llm.common import RangeHash, arrow_rows, blocks, fold_bytes, mix, stored
from stockline.llm.words import byte_class, gather, spans, sum_by_key

LEAST_DOCUMENTS, TOP_TERMS = 10, 10
#: Distinct postings that a task keeps before it lets a run go; kept postings of a shard; pairs of sources in memory.
RUN_POSTINGS, SHARD_POSTINGS, PAIRS_HELD = 600_000, 400_000, 1 << 21
#: Rows that travel between Spark and a task's Python at once, and postings whose corrections are worked out at once.
ARROW_ROWS, ROWS_AT_ONCE = 4096, 50_000
#: Letters are A-Z, a-z and everything beyond ASCII.
LETTERS = byte_class((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Postings:
    """Postings of the documents read so far: (group, term) -> occurrences and documents."""

    def __init__(self, most: int):
        self.most, self.groups = most, {}
        self.clear()

    def clear(self) -> None:
        self.parts, self.held = [], 0

    def group_ids(self, langs: pa.Array, sources: pa.Array) -> np.ndarray:
        pairs = zip(langs.to_pylist(), sources.to_pylist(), strict=True)
        return np.array([self.groups.setdefault(pair, len(self.groups)) for pair in pairs], np.int64)

    def add(self, data: np.ndarray, starts: np.ndarray, groups: np.ndarray) -> None:
        data = fold_bytes(data)
        begins, ends, row = spans(data, starts, LETTERS)
        if not len(begins):
            return
        term = RangeHash(data).of(begins, ends)
        place, (count,) = sum_by_key(mix(term + (row + 1).astype(np.uint64) * _ODD), np.ones(len(term), np.int64))
        group = groups[row[place]]
        key = mix(term[place] ^ mix((group + 1).astype(np.uint64) * _ODD))
        first, (count, docs) = sum_by_key(key, count, np.ones(len(place), np.int64))
        place = place[first]
        self.parts.append((key[first], group[first], count, docs, gather(data, begins[place], ends[place])))
        self.held += len(first)
        if self.held > 2 * self.most:
            self.merge()

    def merge(self) -> None:
        if len(self.parts) > 1:
            key, group, count, docs = (np.concatenate([p[k] for p in self.parts]) for k in range(4))
            first, (count, docs) = sum_by_key(key, count, docs)
            words = pa.chunked_array([p[4] for p in self.parts]).combine_chunks().take(pa.array(first))
            self.parts = [(key[first], group[first], count, docs, words)]
            self.held = len(first)

    @staticmethod
    def by_term(words: pa.Array) -> pa.Array:
        """Order by the first sixteen bytes of a word, which is all that a run needs to be merged quickly."""
        _, offsets, data = words.buffers()
        offsets = np.frombuffer(offsets, np.int64)[words.offset:words.offset + len(words) + 1]
        data = np.concatenate([np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), np.zeros(16, np.uint8)])
        letters = data[offsets[:-1, None] + np.arange(16)]
        letters[np.arange(16) >= np.diff(offsets)[:, None]] = 0
        first, second = letters.view(">u8").astype(np.uint64).T
        return pa.array(np.lexsort((second, first)))

    def run(self) -> Iterator[pa.RecordBatch]:
        """Let all postings go, sorted by term."""
        self.merge()
        if self.held:
            names = list(self.groups)
            _, group, count, docs, words = self.parts[0]
            order = self.by_term(words)
            group = group[order.to_numpy()]
            langs, sources = (pa.array([name[k] for name in names], pa.string()) for k in range(2))
            run = pa.table({"term": words.cast(pa.string()).take(order), "lang": langs.take(pa.array(group)),
                            "source": sources.take(pa.array(group)), "n": pa.array(count).take(order),
                            "docs": pa.array(docs).take(order)})
            yield from run.to_batches(max_chunksize=20_000)
        self.clear()


def _runs(most: int):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        postings = Postings(most)
        for batch in batches:
            groups = postings.group_ids(batch["lang"], batch["source"])
            for first, end, data, starts in blocks(batch["text"]):
                postings.add(data, starts, groups[first:end])
                if postings.held > postings.most:
                    postings.merge()
                    if postings.held > postings.most:
                        yield from postings.run()
        yield from postings.run()

    return index


def _changes(*columns: pa.Array) -> np.ndarray:
    """Which rows differ from the row before them."""
    n = len(columns[0])
    fresh = np.zeros(n, bool)
    if n:
        fresh[0] = True
    for column in columns:
        if n > 1:
            fresh[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return fresh


def _table(batches: list) -> pa.Table:
    return pa.Table.from_batches(batches) if isinstance(batches[0], pa.RecordBatch) else pa.concat_tables(batches)


def _merged(rows: pa.Table) -> pa.Table:
    """Rows sorted by term, lang and source with equal postings added up."""
    term, lang, source = (rows[c].combine_chunks() for c in ("term", "lang", "source"))
    first = np.flatnonzero(_changes(term, lang, source))
    return pa.table({"term": term.take(first), "lang": lang.take(first), "source": source.take(first),
                     **{c: np.add.reduceat(rows[c].to_numpy(), first) for c in ("n", "docs")}})


def _frequencies(least: int):
    """Postings of the terms that enough documents hold; ``leads`` marks the first of a term and language."""

    def kept(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        leads = _changes(rows["term"].combine_chunks(), rows["lang"].combine_chunks())
        first = np.flatnonzero(leads)
        docs = np.add.reduceat(rows["docs"].to_numpy(), first)
        stays = np.repeat(docs >= least, np.diff(np.append(first, len(rows))))
        rows = rows.select(["term", "lang", "source", "n"]).append_column("leads", pa.array(leads.astype(np.int64)))
        yield from rows.filter(pa.array(stays)).combine_chunks().to_batches()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = _merged(pa.concat_tables([waiting, rows]) if waiting is not None else rows)
            last = int(np.flatnonzero(_changes(rows["term"].combine_chunks(), rows["lang"].combine_chunks()))[-1])
            if last:
                yield from kept(rows.slice(0, last))
            waiting = rows.slice(last).combine_chunks()
        if waiting is not None:
            yield from kept(waiting)

    return merge


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * (count + 2) / total), in three steps of a thousand so that nothing overflows."""
    whole, rest = np.divmod(count + 2, total)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + more
    return whole + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class Language:
    """One shard of a language's kept terms: its sources, then its postings, one term after another."""

    def __init__(self, shard: int, lang: str, top: int):
        self.shard, self.lang, self.top = shard, lang, top
        self.names, self.counts = [], []
        self.n_terms = self.n_lang = self.terms_here = 0
        self.total = None
        self.pairs, self.pairs_held = [], 0
        self.found = []
        self.waiting, self.read, self.rows_read = None, [], 0

    def sources(self, rows: pa.Table) -> None:
        self.names += rows["source"].to_pylist()
        self.counts += rows["n"].to_pylist()
        self.n_terms, self.n_lang = rows["n_terms"][0].as_py(), rows["n_lang"][0].as_py()

    def ready(self) -> None:
        if self.total is None:
            self.total = np.maximum(np.array(self.counts, np.int64) + 2 * self.n_terms, 1)
            self.none = share(np.zeros(len(self.total), np.int64), self.total)
            self.lookup = pa.array(self.names, pa.string())
            self.least = np.full(len(self.total), -1, np.int64)
            self.held_counts = [np.zeros((0, 2), np.int64), np.zeros(0, np.int64)]

    def postings(self, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        self.read.append(rows)
        self.rows_read += len(rows)
        if self.rows_read >= ROWS_AT_ONCE:
            yield from self.whole_terms()

    def whole_terms(self) -> Iterator[pa.RecordBatch]:
        """Count what has been read but for its last term, which may go on."""
        rows = pa.concat_tables([*([] if self.waiting is None else [self.waiting]), *self.read])
        self.read, self.rows_read = [], 0
        last = int(np.flatnonzero(_changes(rows["term"].combine_chunks()))[-1])
        self.waiting = rows.slice(last).combine_chunks()
        if last:
            yield from self.take(rows.slice(0, last))

    def take(self, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """Count whole terms: corrections of single sources and of pairs, and each source's telling terms."""
        self.ready()
        term, count = rows["term"].combine_chunks(), rows["n"].to_numpy()
        source = pc.index_in(rows["source"].combine_chunks(), value_set=self.lookup).to_numpy().astype(np.int64)
        first = np.flatnonzero(_changes(term))
        sizes = np.diff(np.append(first, len(count)))
        self.terms_here += len(first)
        own = share(count, self.total[source])
        whole = share(np.add.reduceat(count, first), np.int64(self.n_lang + 2 * self.n_terms))
        self.telling(term, source, own, np.repeat(whole, sizes))
        seen, times = np.unique(np.stack([source, count], 1), axis=0, return_counts=True)
        both, places = np.unique(np.concatenate([self.held_counts[0], seen]), axis=0, return_inverse=True)
        summed = np.zeros(len(both), np.int64)
        np.add.at(summed, places.ravel(), np.concatenate([self.held_counts[1], times]))
        self.held_counts = [both, summed]
        for size in np.unique(sizes[sizes > 1]).tolist():
            at = first[sizes == size]
            for a in range(size - 1):
                others = size - 1 - a
                step = max(1, (1 << 18) // others)
                for k in range(0, len(at), step):
                    i = at[k:k + step, None] + a
                    j = i + 1 + np.arange(others)
                    p, q, zero_p, zero_q = own[i], own[j], self.none[source[i]], self.none[source[j]]
                    more = distance(p, q) - distance(p, zero_q) - distance(zero_p, q) + distance(zero_p, zero_q)
                    yield from self.add_pairs((source[i] * len(self.total) + source[j]).ravel(), more.ravel())

    def add_pairs(self, key: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
        place, (value,) = sum_by_key(key, value)
        self.pairs.append((key[place], value))
        self.pairs_held += len(place)
        if self.pairs_held > PAIRS_HELD:
            self.merge_pairs()
            if self.pairs_held > PAIRS_HELD // 2:
                yield from self.let_pairs_go()

    def merge_pairs(self) -> None:
        key, value = (np.concatenate([p[k] for p in self.pairs]) for k in range(2))
        place, (value,) = sum_by_key(key, value)
        self.pairs, self.pairs_held = [(key[place], value)], len(place)

    def let_pairs_go(self) -> Iterator[pa.RecordBatch]:
        if self.pairs:
            self.merge_pairs()
            key, value = self.pairs[0]
            yield from self.rows("pair", key // len(self.total), self.lookup.take(pa.array(key % len(self.total))), value)
        self.pairs, self.pairs_held = [], 0

    def telling(self, term: pa.Array, source: np.ndarray, own: np.ndarray, whole: np.ndarray) -> None:
        value = distance(own, whole)
        good = np.flatnonzero((own > whole) & (value >= self.least[source]))
        self.found.append(pa.table({"source": source[good], "value": value[good], "term": term.take(pa.array(good))}))
        if sum(len(t) for t in self.found) > 50_000 + 4 * self.top * len(self.total):
            self.best()

    def best(self) -> None:
        """Keep each source's first terms by value, then by letters."""
        rows = pa.concat_tables(self.found)
        rows = rows.take(pc.sort_indices(rows, [("source", "ascending"), ("value", "descending"), ("term", "ascending")]))
        source = rows["source"].to_numpy()
        place = np.arange(len(source)) - np.searchsorted(source, source)
        rows = rows.filter(pa.array(place < self.top)).combine_chunks()
        place, source = place[place < self.top], rows["source"].to_numpy()
        last = place == self.top - 1
        self.least[source[last]] = rows["value"].to_numpy()[last]
        self.found = [rows]

    def rows(self, part: str, source: np.ndarray, item: pa.Array, value: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(value), 50_000):
            n = len(value[k:k + 50_000])
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([self.lang] * n, pa.string()), "part": pa.array([part] * n, pa.string()),
                "source": self.lookup.take(pa.array(source[k:k + n])), "item": item[k:k + n], "value": value[k:k + n]})

    def finish(self) -> Iterator[pa.RecordBatch]:
        self.ready()
        if self.read:
            yield from self.whole_terms()
        if self.waiting is not None:
            yield from self.take(self.waiting)
        if self.found:
            self.best()
            rows = self.found[0]
            yield from self.rows("term", rows["source"].to_numpy(), rows["term"].combine_chunks(), rows["value"].to_numpy())
        yield from self.let_pairs_go()
        if not self.terms_here and self.shard:
            return
        seen, times = self.held_counts
        for g in range(len(self.total)):
            # What source g changes in its distance to every other one, counted with the terms nobody holds for h > g.
            others = np.flatnonzero(np.arange(len(self.total)) != g)
            base = distance(self.none[g], self.none[others])
            sums = np.where(others > g, self.terms_here * base, 0)
            mine = seen[:, 0] == g
            counts, often = share(seen[mine, 1], self.total[g]), times[mine]
            step = max(1, (1 << 20) // max(len(others), 1))
            for k in range(0, len(counts), step):
                change = distance(counts[k:k + step, None], self.none[others]) - base
                sums = sums + (change * often[k:k + step, None]).sum(axis=0)
            yield from self.rows("pair", np.full(len(others), g), self.lookup.take(pa.array(others)), sums)


def _corrections(top: int):
    def correct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            first = np.flatnonzero(_changes(batch["shard"], batch["lang"], batch["kind"]))
            for begin, end in zip(first.tolist(), [*first[1:].tolist(), batch.num_rows], strict=True):
                shard, lang = batch["shard"][begin].as_py(), batch["lang"][begin].as_py()
                if at is None or (at.shard, at.lang) != (shard, lang):
                    if at is not None:
                        yield from at.finish()
                    at = Language(shard, lang, top)
                rows = pa.Table.from_batches([batch.slice(begin, end - begin)])
                if batch["kind"][begin].as_py() == 0:
                    at.sources(rows)
                else:
                    yield from at.postings(rows)
        if at is not None:
            yield from at.finish()

    return correct


def term_postings(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """Occurrences ``n`` of each kept term in each group that holds it; ``leads`` is 1 once per term and language."""
    read = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    runs = read.mapInArrow(_runs(RUN_POSTINGS), "term string, lang string, source string, n long, docs long")
    runs = runs.repartition("term", "lang").sortWithinPartitions("term", "lang", "source")
    return runs.mapInArrow(_frequencies(least), "term string, lang string, source string, n long, leads long")


def source_divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """Distances between the sources of each language, and each source's most telling terms."""
    with arrow_rows(docs.sparkSession, ARROW_ROWS):
        kept = stored(term_postings(docs, least), "postings")
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    counted = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("leads").alias("leads"))
    totals = groups.join(counted, ["lang", "source"], "left").na.fill(0, ["n", "leads"])
    languages = totals.groupBy("lang").agg(F.sum("leads").alias("n_terms"), F.sum("n").alias("n_lang"))
    shards = max(1, -(-kept.count() // SHARD_POSTINGS))
    totals = totals.join(languages, "lang").select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "lang", F.lit(0).alias("kind"),
        F.lit(None).cast("string").alias("term"), "source", "n", "n_terms", "n_lang")
    dealt = kept.select(F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int").alias("shard"), "lang", F.lit(1).alias("kind"),
                        "term", "source", "n", F.lit(0).cast("long").alias("n_terms"), F.lit(0).cast("long").alias("n_lang"))
    rows = totals.unionByName(dealt).repartition("shard", "lang").sortWithinPartitions("shard", "lang", "kind", "term", "source")
    with arrow_rows(docs.sparkSession, ARROW_ROWS):
        parts = stored(rows.mapInArrow(_corrections(top), "lang string, part string, source string, item string, "
                                                          "value long"), "corrections")
    pairs = (parts.where("part = 'pair'")
             .groupBy("lang", F.least("source", "item").alias("a"), F.greatest("source", "item").alias("b"))
             .agg(F.sum("value").alias("value")))
    both = pairs.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                                                  F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"),
                        "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = parts.where("part = 'term'").select("lang", "source", "part", "item", "value")
    return (both.withColumn("rank", F.row_number().over(order))
            .unionByName(terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)))

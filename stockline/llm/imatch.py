"""Document fingerprints by I-Match, with DataFrame functions only.

Terms are the white-space separated words of a text with A-Z lower-cased. The lexicon is the terms whose share
of all documents lies in a band (of inverse document frequency, that is); as every document adds to at most as
many terms as it has, the lexicon holds no more than (mean distinct terms / least share) terms, whatever the
number of documents. A fingerprint has ``SUBSETS`` parts: each part is a hash of the sorted distinct terms of
the text that are in the lexicon and in that part's randomised subset of it (a term's subset follows from two
digits of its hash, so a subset is about one in 48 of the lexicon, and an edit leaves most parts alone). A text with
fewer than ``LEAST_TERMS`` such terms takes all its terms as lexicon terms, so short texts do not all look alike. A part
without terms is empty. The likeness of two fingerprints is the share of equal parts among those that either has; two
fingerprints without any part are alike (1).

The lexicon is dealt to small lists by the hash of the term, and each term of a text looks into one of them, so
no document walks through the lexicon.

Each document is also compared with its edited text, whose second half is replaced by the beginning of the next
document in id order. The next id is found by ranges of ids, so no task orders all documents.

Defined cases: a null text is empty; texts without terms share the fingerprint of no terms. Documents follow
each other by doc_id, equal ones by a hash of the text, null doc_ids first, and the first follows the last. Rows that
repeat doc_id and text are one document in that order and give the same result each. A lone document follows itself. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stockline.llm.common import fold_column, stored

#: Parts of a fingerprint: 16 by the first hexadecimal digit of a term's hash, times 3 by the second.
DIGITS, THIRDS = "0123456789abcdef", 3
SUBSETS = len(DIGITS) * THIRDS
#: Hexadecimal digits of a part; terms of the lexicon in one list, about.
PART_DIGITS, LIST_TERMS = 8, 4
#: The band: least and greatest share of the documents that hold a term, and the least documents.
LEAST_SHARE, GREATEST_SHARE, LEAST_DOCS = 0.01, 0.1, 2
LEAST_TERMS = 8
#: Documents in one range of ids, about.
RANGE_ROWS = 50_000


def terms(text) -> F.Column:
    """The distinct words of a text."""
    return F.array_remove(F.array_distinct(F.split(fold_column(text), "[ \\t-\\r]+")), "")


def lexicon(docs: DataFrame) -> DataFrame:
    """The terms in the band, each once."""
    total = docs.agg(F.count("*").alias("total"))
    held = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return held.join(total, (F.col("n") >= F.greatest(F.lit(LEAST_DOCS), LEAST_SHARE * F.col("total")))
                     & (F.col("n") <= GREATEST_SHARE * F.col("total"))).select("term")


def linked(ids: DataFrame) -> DataFrame:
    """Each row of a table of keys with the key that follows it, by ranges of ids."""
    ranges = max(1, -(-ids.count() // RANGE_ROWS))
    order = [F.col("doc_id").asc_nulls_first(), "key"]
    dealt = stored(ids.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("range").orderBy(*order)
    # One small row per range of documents, shifted by one; the first range follows the last.
    every = Window.orderBy("range")
    firsts = dealt.groupBy("range").agg(F.min(F.struct("doc_id", "key")).getField("key").alias("first"))
    after = firsts.select("range", F.coalesce(F.lead("first").over(every), F.first("first").over(every)).alias("first"))
    dealt = dealt.withColumn("next", F.lead("key").over(inside))
    return dealt.join(after, "range").select("key", "doc_id", "n_chars", "copies", F.coalesce("next", "first").alias("next"))


def subset(term) -> F.Column:
    """The subset of the lexicon that a term is in."""
    first, second = (F.position(F.substring(F.md5(term.cast("binary")), k, 1), F.lit(DIGITS)) - 1 for k in (1, 2))
    return first + len(DIGITS) * (second % THIRDS)


def parts(used) -> F.Column:
    """The parts of a fingerprint from sorted terms with their subsets (structs of ``term`` and ``subset``)."""
    def part(k) -> F.Column:
        chosen = F.transform(F.filter(used, lambda t: t["subset"] == k), lambda t: t["term"])
        return F.when(F.size(chosen) > 0, F.substring(F.md5(F.array_join(chosen, " ").cast("binary")), 1, PART_DIGITS)
                      ).otherwise("")

    return F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), part)


def listed(words: DataFrame) -> DataFrame:
    """The lexicon as one row: an array of short lists, a term's list given by its hash. As large as the lexicon, which
    is bounded by the mean number of terms of a document."""
    lists = max(1, words.count() // LIST_TERMS)
    place = F.pmod(F.xxhash64("term"), F.lit(lists)).cast("int")
    dealt = words.groupBy(place.alias("place")).agg(F.collect_list("term").alias("list"))
    entries = F.map_from_entries(F.collect_list(F.struct("place", "list")))
    return dealt.agg(entries.alias("known")).select(
        F.transform(F.sequence(F.lit(0), F.lit(lists - 1)),
                    lambda k: F.coalesce(F.element_at("known", k), F.array().cast("array<string>"))).alias("lists"),
        F.lit(lists).alias("n_lists"))


def fingerprints(texts: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """The columns ``keys`` of each row and the parts of its text's fingerprint. ``words`` is ``listed``."""
    found = texts.select(*keys, terms(F.col("text")).alias("terms")).join(words)
    known = F.filter("terms", lambda t: F.array_contains(F.get("lists", F.pmod(F.xxhash64(t), F.col("n_lists")).cast("int")), t))
    found = found.select(*keys, "terms", known.alias("held"))
    used = F.array_sort(F.when(F.size("held") < LEAST_TERMS, F.col("terms")).otherwise(F.col("held")))
    placed = F.transform(used, lambda t: F.struct(t.alias("term"), subset(t).alias("subset")))
    return found.select(*keys, placed.alias("used")).select(*keys, parts(F.col("used")).alias("parts"))


def likeness(one, other) -> F.Column:
    """Equal parts among those that either fingerprint has."""
    pairs = F.filter(F.zip_with(one, other, lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
                     lambda p: (p["a"] != "") | (p["b"] != ""))
    same = F.size(F.filter(pairs, lambda p: p["a"] == p["b"]))
    return F.when(F.size(pairs) == 0, F.lit(1.0)).otherwise(same / F.size(pairs))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), text)
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"),
                        F.md5(name.cast("binary")).alias("key"))
    words = stored(listed(stored(lexicon(named), "lexicon")), "lists")
    ids = named.groupBy("key", "doc_id", F.char_length("text").cast("bigint").alias("n_chars")).agg(
        F.count("*").alias("copies"))
    links = stored(linked(ids), "links")
    # Texts are dealt out by key once; what a document lends to the one before it is half that one's length.
    texts = named.groupBy("key").agg(F.first("text").alias("text"))
    lends = links.select(F.col("next").alias("key"), F.col("key").alias("to"), F.expr("int(n_chars div 2)").alias("half"))
    lent = texts.join(lends, "key").select(F.col("to").alias("key"), F.expr("left(text, half)").alias("lent"))
    kept = links.select("key", F.expr("int(n_chars - n_chars div 2)").alias("kept"))
    edited = texts.join(kept, "key").join(lent, "key").select(
        "key", F.concat(F.expr("left(text, kept)"), F.col("lent")).alias("text"))
    edited = edited.select("key", "text", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    edited = stored(fingerprints(edited, words, ["key", "sha"]), "edited")
    plain = stored(fingerprints(named, words, ["key"]).dropDuplicates(["key"]), "plain")
    following = plain.select(F.col("key").alias("next"), F.col("parts").alias("next_parts"))
    joined = (links.join(plain, "key").join(edited.withColumnRenamed("parts", "edited_parts"), "key")
              .join(following, "next"))
    return joined.select(
        F.explode(F.array_repeat(F.struct(
            "doc_id", "n_chars", F.col("sha").alias("edited_sha256"), F.array_join("parts", "-").alias("fingerprint"),
            F.array_join("edited_parts", "-").alias("edited_fingerprint"),
            likeness(F.col("parts"), F.col("edited_parts")).alias("near_edited"),
            likeness(F.col("parts"), F.col("next_parts")).alias("near_next")), F.col("copies").cast("int"))).alias("row")
    ).select("row.*")

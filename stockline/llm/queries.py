"""Registered queries of the text operators, with SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stockline.llm.common import table
from stockline.llm.conversation_repair import audit_conversations
from stockline.llm.divergence import source_divergence
from stockline.llm.exact_dedup import exact_groups
from stockline.llm.imatch import fingerprint_documents
from stockline.llm.language import LanguageModel, language_profiles, predict_languages
from stockline.llm.license_scan import scan_licenses
from stockline.llm.ngram_join import shingle_components
from stockline.llm.packing import pack_documents
from stockline.llm.piece_tokens import round_trip
from stockline.llm.quality import fit_quality, score_quality
from stockline.llm.quotations import link_replies
from stockline.llm.token_counts import token_counts
from stockline.llm.toxicity import fit_toxicity, score_toxicity

WORD_VOCABULARY, PIECE_VOCABULARY = "word_bpe_49k.json", "piece_bpe_32k.model"
SEED, DROPOUT = 20240229, 0.1
TOKEN_LIMIT, SEQUENCE_TOKENS, END_ID, THRESHOLD = 2048, 4096, 1, 0.7


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_components(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY), TOKEN_LIMIT)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY),
                          SEQUENCE_TOKENS, END_ID)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")), THRESHOLD)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")), THRESHOLD)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op7_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_VOCABULARY), SEED, DROPOUT)


def op8_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_replies(table(spark, sf_dir, "conversations"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict_languages(docs, LanguageModel(language_profiles(docs)))


def op10_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_conversations(table(spark, sf_dir, "conversations"))


OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k:k + 3], ' '))) END AS s FROM words),
classes AS (SELECT min(doc_id) AS cls, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
tokens AS (SELECT cls, len(s) AS n, unnest(s) AS t FROM classes),
pairs AS (
  SELECT a.cls AS a, b.cls AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.cls < b.cls
  GROUP BY a.cls, b.cls, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT cls AS a, cls AS b FROM classes UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
comps AS (SELECT a AS cls, min(b) AS component_id FROM reach GROUP BY a)
SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(component_id, sets.doc_id) AS component_id,
  coalesce(classes.cls, sets.doc_id) AS class_id
FROM sets LEFT JOIN classes ON list_sort(sets.s) = classes.s LEFT JOIN comps ON classes.cls = comps.cls
"""

OP10_SQL = r"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
following AS (
  SELECT *, coalesce(lead(doc_id) OVER o, first_value(doc_id) OVER o) AS next_id,
    coalesce(lead(text) OVER o, first_value(text) OVER o) AS next_text
  FROM base WINDOW o AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
versions AS (
  SELECT doc_id, 0 AS version, text FROM base
  UNION ALL SELECT doc_id, 1, left(text, n - n // 2) || left(next_text, n // 2) FROM following),
worded AS (
  SELECT doc_id, version, text, list_filter(list_distinct(regexp_split_to_array(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+')), lambda w: w <> '') AS terms FROM versions),
lexicon AS (
  SELECT list(term) AS words FROM (
    SELECT term FROM (SELECT unnest(terms) AS term FROM worded WHERE version = 0) GROUP BY term
    HAVING count(*) >= greatest(2, 0.01 * (SELECT count(*) FROM documents))
      AND count(*) <= 0.1 * (SELECT count(*) FROM documents))),
held AS (
  SELECT doc_id, version, text, terms, list_sort(list_intersect(terms, coalesce(words, []))) AS held FROM worded, lexicon),
used AS (
  SELECT doc_id, version, text, list_transform(CASE WHEN len(held) < 8 THEN list_sort(terms) ELSE held END,
    lambda t: {'t': t, 'k': instr('0123456789abcdef', substr(md5(t), 1, 1)) - 1
      + 16 * ((instr('0123456789abcdef', substr(md5(t), 2, 1)) - 1) % 3)}) AS used FROM held),
printed AS (
  SELECT doc_id, version, sha256(text) AS sha, list_transform(range(48), lambda k: CASE WHEN len(list_filter(used,
    lambda x: x.k = k)) = 0 THEN '' ELSE substr(md5(array_to_string(list_transform(list_filter(used, lambda x: x.k = k),
    lambda x: x.t), ' ')), 1, 8) END) AS parts FROM used),
joined AS (
  SELECT f.doc_id, f.n, e.sha, p.parts AS p, e.parts AS e, x.parts AS x
  FROM following f JOIN printed p ON p.doc_id = f.doc_id AND p.version = 0 JOIN printed e ON e.doc_id = f.doc_id
    AND e.version = 1 JOIN printed x ON x.doc_id = f.next_id AND x.version = 0),
counted AS (
  SELECT *, len(list_filter(range(1, 49), lambda k: p[k] <> '' OR e[k] <> '')) AS of_edited,
    len(list_filter(range(1, 49), lambda k: p[k] <> '' OR x[k] <> '')) AS of_next,
    len(list_filter(range(1, 49), lambda k: p[k] <> '' AND p[k] = e[k])) AS as_edited,
    len(list_filter(range(1, 49), lambda k: p[k] <> '' AND p[k] = x[k])) AS as_next FROM joined)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha AS edited_sha256, array_to_string(p, '-') AS fingerprint,
  array_to_string(e, '-') AS edited_fingerprint,
  CASE WHEN of_edited = 0 THEN 1.0::DOUBLE ELSE CAST(as_edited AS DOUBLE) / of_edited END AS near_edited,
  CASE WHEN of_next = 0 THEN 1.0::DOUBLE ELSE CAST(as_next AS DOUBLE) / of_next END AS near_next
FROM counted
"""

OP6_SQL = """
WITH folded AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
  sha256(t) AS text_sha256, CAST(strlen(t) AS BIGINT) AS n_bytes
FROM folded WINDOW g AS (PARTITION BY t)
"""

OP11_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
hits AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM hits GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
groups AS (SELECT DISTINCT lang, source FROM docs),
sizes AS (SELECT g.lang, count(k.term) AS v FROM (SELECT DISTINCT lang FROM docs) g LEFT JOIN kept k ON k.lang = g.lang
  GROUP BY g.lang),
counts AS (SELECT h.lang, h.source, h.term, count(*) AS n FROM hits h JOIN kept k ON k.lang = h.lang AND k.term = h.term
  GROUP BY h.lang, h.source, h.term),
dense AS (SELECT g.lang, g.source, k.term, CAST(coalesce(c.n, 0) AS HUGEINT) AS n FROM groups g JOIN kept k ON k.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shares AS (SELECT d.lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY d.lang, source)
  + 2 * v) AS p FROM dense d JOIN sizes s ON s.lang = d.lang),
whole AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q
  FROM (SELECT d.lang, term, sum(n) AS n, any_value(v) AS v FROM dense d JOIN sizes s ON s.lang = d.lang GROUP BY d.lang, term)),
sums AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
  FROM shares x JOIN shares y ON y.lang = x.lang AND y.term = x.term AND y.source <> x.source GROUP BY x.lang, x.source, y.source),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
  SELECT s.lang, s.source, 'term' AS part, s.term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value
  FROM shares s JOIN whole w ON w.lang = s.lang AND w.term = s.term WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 10
"""

OP13_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
fated AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''),
    lambda c: ascii(c)::BIGINT)), lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
    lambda x, k: xor(x >> 1, 3988292384 * (x & 1))))) % 20 AS fate FROM keyed),
damaged AS (
  SELECT row_number() OVER () AS r, conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE WHEN fate = 1 THEN ''
    WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM fated, range(CASE WHEN fate = 0 THEN 0 WHEN fate = 3 THEN 2 ELSE 1 END)),
rows AS (
  SELECT *, row_number() OVER o AS place, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, r)
      AS seen,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC, text DESC, r DESC) AS back,
    lag(role) OVER o AS earlier
  FROM damaged WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, r)),
faulty AS (
  SELECT *, left(role, 1) AS i, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
    earlier IS NOT NULL AND left(earlier, 1) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal FROM rows),
facts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal FROM faulty GROUP BY conv_id),
steps AS (
  SELECT conv_id, n, 0::BIGINT AS back, {'c': 0, 'a': '', 't': []::VARCHAR[]} AS s0,
    {'c': 4, 'a': 'II', 't': ['user:', 'assistant:']} AS s1, {'c': 2, 'a': 'I', 't': ['assistant:']} AS s2,
    {'c': 0, 'a': '', 't': []::VARCHAR[]} AS s3 FROM facts
  UNION ALL
  SELECT conv_id, n, back,
    least(b0, {'c': u.c + 2, 'a': 'I' || u.a, 't': list_prepend('user:', u.t)}),
    least(b1, {'c': u.c + 2, 'a': 'I' || u.a, 't': list_prepend('user:', u.t)}), u, a
  FROM (
    SELECT *, least(b2, {'c': b3.c + 2, 'a': 'I' || b3.a, 't': list_prepend('assistant:', b3.t)}) AS u,
      least(b3, {'c': b2.c + 2, 'a': 'I' || b2.a, 't': list_prepend('user:', b2.t)}) AS a
    FROM (
      SELECT conv_id, n, back, least(d0, as_user, CASE WHEN i = 'u' AND stays THEN as_it_is_2
          WHEN i = 's' AND stays THEN {'c': s1.c + w, 'a': 'K' || s1.a, 't': list_prepend(line, s1.t)} END) AS b0,
        least(d1, as_user, CASE WHEN i = 'u' AND stays THEN as_it_is_2 END) AS b1,
        least(d2, as_assistant, CASE WHEN i = 'a' AND stays THEN as_it_is_3 END) AS b2,
        least(d3, as_user, CASE WHEN i = 'u' AND stays THEN as_it_is_2 END) AS b3
      FROM (
        SELECT s.conv_id, s.n, r.back, s1, r.i, fault IN ('', 'truncated') AS stays, (fault = 'truncated')::INT AS w,
          role || ':' || text AS line,
          {'c': s0.c + 3, 'a': 'D' || s0.a, 't': s0.t} AS d0, {'c': s1.c + 3, 'a': 'D' || s1.a, 't': s1.t} AS d1,
          {'c': s2.c + 3, 'a': 'D' || s2.a, 't': s2.t} AS d2, {'c': s3.c + 3, 'a': 'D' || s3.a, 't': s3.t} AS d3,
          CASE WHEN stays THEN {'c': s2.c + 2 + w, 'a': 'R' || s2.a, 't': list_prepend('user:' || text, s2.t)} END AS as_user,
          CASE WHEN stays THEN {'c': s3.c + 2 + w, 'a': 'R' || s3.a, 't': list_prepend('assistant:' || text, s3.t)} END AS as_assistant,
          {'c': s2.c + w, 'a': 'K' || s2.a, 't': list_prepend(line, s2.t)} AS as_it_is_2,
          {'c': s3.c + w, 'a': 'K' || s3.a, 't': list_prepend(line, s3.t)} AS as_it_is_3
        FROM steps s JOIN faulty r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.back = s.back + 1)))),
ends AS (SELECT conv_id, s0 FROM steps WHERE back = n)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(s0.c, 0) AS BIGINT) AS cost,
  coalesce(s0.a, '') AS audit, sha256(coalesce(array_to_string(s0.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""

QUERIES = {
    "op1_ngram_join": (op1_ngram_join, OP1_SQL),
    "op2_token_counts": (op2_token_counts, None),
    "op3_packing": (op3_packing, None),
    "op4_quality": (op4_quality, None),
    "op5_toxicity": (op5_toxicity, None),
    "op6_exact_dedup": (op6_exact_dedup, OP6_SQL),
    "op7_merge_dropout": (op7_merge_dropout, None),
    "op8_quotations": (op8_quotations, None),
    "op9_language": (op9_language, None),
    "op10_imatch": (op10_imatch, OP10_SQL),
    "op11_divergence": (op11_divergence, OP11_SQL),
    "op12_license_scan": (op12_license_scan, None),
    "op13_conversation_repair": (op13_conversation_repair, OP13_SQL),
}

"""The registered queries of the text operators and their SQL where SQL can say it.

Each query applies its operator with production parameters to whole tables and derives the digest
columns of its contract from the operator's results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    byte_bpe, conversation_trie, exact_dedup, line_dedup, packing, pii, quality_classifier, quality_rules, simhash, suffix_dedup, token_alignment, token_counts, toxicity,
)

Run = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    index = exact_dedup.DigestIndex(spark, kind=docs.schema["doc_id"].dataType.simpleString())
    return index.append(docs).drop("row_hash")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), with_ids=False).drop("row_hash", "ids")


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_read(spark, sf_dir, "documents")).drop("row_hash")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(_read(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality_rules(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def pii_digests(found: DataFrame) -> DataFrame:
    """Counts and hash of the base spans, and all spans as one string, from the arrays of spans."""
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, ("email", "ip", "card", "phone")), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digests(pii.personal_data(_read(spark, sf_dir, "documents")))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.conversation_nodes(_read(spark, sf_dir, "conversations"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment_counts(_read(spark, sf_dir, "documents"))


_EXACT = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
r AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""

_LINES = r"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
e AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM l),
w AS (SELECT doc_id, pos, trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS said FROM e WHERE trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) <> ''),
n AS (SELECT *, lead(said, 1) OVER o AS s2, lead(said, 2) OVER o AS s3, lead(pos, 1) OVER o AS a2, lead(pos, 2) OVER o AS a3 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
k AS (SELECT *, row_number() OVER (PARTITION BY said, s2, s3 ORDER BY doc_id, pos) AS occurrence FROM n WHERE s3 IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, unnest([pos, a2, a3]) AS pos FROM k WHERE occurrence > 1),
kept AS (SELECT e.doc_id, string_agg(line, chr(10) ORDER BY e.pos) AS kept_text FROM e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.pos = g.pos GROUP BY e.doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT l.doc_id, len(lines) AS n_lines, coalesce(c.n, 0) AS n_removed, coalesce(k.kept_text, '') AS kept_text
FROM l LEFT JOIN kept k ON l.doc_id = k.doc_id LEFT JOIN counts c ON l.doc_id = c.doc_id
"""

_RULES = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT doc_id, unnest(range(1, len(words) - 6)) AS p, words FROM w WHERE len(words) >= 8),
h AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, words[p:p + 7]) AS n FROM g),
c AS (SELECT doc_id, count(DISTINCT p + j) AS n_repeat_words FROM h, unnest(range(8)) AS u(j) WHERE n > 1 GROUP BY doc_id),
s AS (SELECT w.doc_id, lang, source, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
m AS (SELECT doc_id, lang, source, n_words, unnest([
  {'metric': 'symbol_share', 'v': n_symbols * 1000000 // greatest(word_chars, 1), 'reach': 6, 'half': 5000},
  {'metric': 'dup_line_share', 'v': n_dup_lines * 1000000 // greatest(n_lines, 1), 'reach': 6, 'half': 60000},
  {'metric': 'repeat_share', 'v': n_repeat_words * 1000000 // greatest(n_words, 1), 'reach': 6, 'half': 50000},
  {'metric': 'word_length', 'v': word_chars * 1000 // greatest(n_words, 1), 'reach': 8, 'half': 300}], recursive := true) FROM s),
b AS (SELECT *, (v // (1::BIGINT << greatest(length(bin(v)) - 6, 0)::BIGINT)) * (1::BIGINT << greatest(length(bin(v)) - 6, 0)::BIGINT) AS bucket FROM m WHERE n_words >= 20),
lv AS (SELECT 2 AS level, lang, source, metric, reach, half, bucket FROM b UNION ALL SELECT 1, lang, '', metric, reach, half, bucket FROM b UNION ALL SELECT 0, '', '', metric, reach, half, bucket FROM b),
r AS (SELECT level, lang, source, metric, reach, half, bucket, row_number() OVER (PARTITION BY level, lang, source, metric ORDER BY bucket) AS upto, count(*) OVER (PARTITION BY level, lang, source, metric) AS n FROM lv),
q AS (SELECT level, lang, source, metric, reach, half, max(n) AS n, min(bucket) FILTER (upto * 4 >= n) AS q1, min(bucket) FILTER (upto * 4 >= n * 2) AS q2, min(bucket) FILTER (upto * 4 >= n * 3) AS q3 FROM r GROUP BY ALL),
f AS (SELECT level, lang, source, metric, CASE WHEN metric = 'word_length' THEN q2 - reach * greatest(q2 - q1, half) ELSE -1 END AS low, q2 + reach * greatest(q3 - q2, half) AS high
  FROM q WHERE level = 0 OR n >= greatest(100, (SELECT max(n) FROM q WHERE level = 0) / 1000)),
bad AS (SELECT m.doc_id, bool_or(NOT coalesce(v BETWEEN coalesce(f2.low, f1.low, f0.low) AND coalesce(f2.high, f1.high, f0.high), true)) AS outside
  FROM m LEFT JOIN f f2 ON f2.level = 2 AND f2.lang = m.lang AND f2.source = m.source AND f2.metric = m.metric
  LEFT JOIN f f1 ON f1.level = 1 AND f1.lang = m.lang AND f1.metric = m.metric LEFT JOIN f f0 ON f0.level = 0 AND f0.metric = m.metric GROUP BY m.doc_id)
SELECT s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT outside AS kept
FROM s JOIN bad ON s.doc_id = bad.doc_id
"""

_TRIE = r"""
WITH t AS (SELECT conv_id, turn, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, length(coalesce(text, ''))::BIGINT AS chars
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(digest ORDER BY turn NULLS FIRST, digest) AS digests, list(chars ORDER BY turn NULLS FIRST, digest) AS chars FROM t GROUP BY conv_id),
h AS (SELECT *, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda crc, b: CASE WHEN b >= 0 THEN xor(crc, b) WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END), 4294967295) % 6 AS h FROM c),
r AS (SELECT h.conv_id, list_concat(coalesce(b.digests, [])[1:h.h], h.digests[h.h + 1:]) AS digests, list_concat(coalesce(b.chars, [])[1:h.h], h.chars[h.h + 1:]) AS chars
  FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 100),
d AS (SELECT conv_id, digests, chars, unnest(range(0, len(digests) + 1)) AS depth FROM r),
m AS (SELECT conv_id, depth, sha256(array_to_string(digests[1:depth], '')) AS key, CASE WHEN depth > 0 THEN sha256(array_to_string(digests[1:depth - 1], '')) END AS parent,
  CASE WHEN depth > 0 THEN chars[depth] ELSE 0 END AS chars, depth = len(digests) AS is_end FROM d),
n AS (SELECT key, any_value(parent) AS parent, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256 FROM m GROUP BY key),
k AS (SELECT parent AS key, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.key = n.key),
s AS (SELECT m.key, sum(CASE WHEN v.n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((v.n_convs - 1) * v.chars)::BIGINT AS saved_tokens
  FROM v JOIN m ON m.conv_id = v.conv_id AND m.depth <= v.depth GROUP BY m.key)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves, s.saved_tokens, v.ends_sha256
FROM v JOIN s ON s.key = v.key LEFT JOIN v p ON p.key = v.parent
"""


def queries() -> dict[str, Run]:
    every = (
        op1_token_counts, op2_toxicity, op3_exact_dedup, op4_packing, op5_simhash_dedup, op6_line_dedup, op7_byte_bpe, op8_suffix_dedup,
        op9_quality_classifier, op10_quality_rules, op11_pii, op12_conversation_trie, op13_token_alignment,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": _EXACT, "op6_line_dedup": _LINES, "op10_quality_rules": _RULES, "op12_conversation_trie": _TRIE}

"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sonde.llm import bpe, exact_dedup, language_id, nbest, ngram_lm, packing, quality, sharding, simhash, spelling, suffix_dedup, toxicity, whitening
from sonde.sources.tables import load

PIECES = "piece_bpe_32k.model"
#: The tokenizer of packing, the same vocabulary as ranks, and its pattern.
BPE = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
#: The multilingual ranks and their pattern.
MULTI = (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score(load(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(load(spark, sf_dir, "documents"))


def op3_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbest.encode(load(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), ids=False)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(load(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(load(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(load(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(load(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), *BPE, ids=False)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(load(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(load(spark, sf_dir, "embeddings"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(load(spark, sf_dir, "documents"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(load(spark, sf_dir, "documents"), *MULTI)


FOUND = (
    op1_ngram_lm, op2_suffix_dedup, op3_nbest, op4_quality, op5_language_id, op6_toxicity, op7_exact_dedup, op8_sharding, op9_packing, op10_simhash,
    op11_whitening, op12_spelling, op13_byte_bpe,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in FOUND}


def oracle_sql() -> dict[str, str]:
    return {"op4_quality": OP4_SQL, "op7_exact_dedup": OP7_SQL, "op12_spelling": OP12_SQL}


OP7_SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY 1)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, n.text_sha256 FROM n JOIN g USING (text_sha256)
"""

OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, source,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), grams AS (
  SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)
), twice AS (
  SELECT DISTINCT doc_id, i + k AS p
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams), range(0, 5) t(k) WHERE n > 1
), repeats AS (SELECT doc_id, count(*) AS n FROM twice GROUP BY 1
), base AS (
  SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM d LEFT JOIN repeats r USING (doc_id)
), judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base
), every_line AS (
  SELECT doc_id, text, coalesce(source, chr(1)) AS host,
         unnest(string_split(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'),
                                            '[\x20\x09\x0B-\x0D]+', ' ', 'g'), chr(10))) AS raw FROM d
), lines AS (
  SELECT DISTINCT doc_id, text, host, trim(raw) AS line FROM every_line WHERE trim(raw) <> ''
), hosts AS (SELECT coalesce(source, chr(1)) AS host, count(*) AS docs FROM documents GROUP BY 1
), boiler AS (
  SELECT host, line FROM (SELECT host, line, count(DISTINCT text) AS n FROM lines GROUP BY 1, 2) JOIN hosts USING (host)
  WHERE n > greatest(3, ceil(docs * 0.02))
), taken AS (
  SELECT e.doc_id, count(*) AS words FROM
    (SELECT doc_id, host, trim(raw) AS line, unnest(string_split(trim(raw), ' ')) AS word FROM every_line) e
    JOIN boiler b ON b.host = e.host AND b.line = e.line GROUP BY 1
)
SELECT j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (coalesce(t.words, 0) > 0 AND (n_words - coalesce(t.words, 0) < 10 OR n_words - coalesce(t.words, 0) < n_words * 0.1)) AS kept,
       coalesce(t.words, 0) AS n_line_words_removed
FROM judged j LEFT JOIN taken t USING (doc_id)
"""

OP12_SQL = r"""
WITH RECURSIVE bit AS (
  SELECT i, i AS c, 0 AS step FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM bit WHERE step < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM bit WHERE step = 8
), run AS (
  SELECT doc_id, r, count(*) AS times FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents
  ) GROUP BY ALL
), hashed AS (
  SELECT r, times, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, [('0x' || hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || r))[2 * k + 1 : 2 * k + 2])::BIGINT
                                      FOR k IN range(octet_length(encode(coalesce(doc_id::VARCHAR, '') || ':' || r)))]),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM run, crc
), word AS (
  SELECT word, sum(times)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(r, 1, (h % length(r))::INT) || substr(r, (h % length(r))::INT + 2) ELSE r END AS word, times FROM hashed
  ) WHERE length(word) >= 5 GROUP BY 1 HAVING sum(times) >= 3
), cut AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM word)
), pair AS (
  SELECT a.word, b.word AS near, b.n FROM cut a JOIN cut b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN word b ON a.d = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN word b ON a.d = b.word
), best AS (SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS near, max(n) AS near_n FROM pair GROUP BY 1
), formed AS (
  SELECT w.word, CASE WHEN b.near_n >= 2 * w.n THEN b.near END AS form, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 2 * w.n THEN b.near_n END AS form_n
  FROM word w LEFT JOIN best b USING (word)
), walk AS (
  SELECT word, word AS last, 0 AS step FROM formed
  UNION ALL SELECT w.word, f.form, step + 1 FROM walk w JOIN formed f ON f.word = w.last WHERE f.form IS NOT NULL
), root AS (SELECT word, arg_max(last, step) AS root FROM walk GROUP BY 1)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM formed f JOIN root r USING (word)
"""

"""The operators' queries over the standard tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import codebooks, fingerprints, language, near_dedup, packing, pieces, pii, prefix_trie, quality, search, token_counts, warc, wrappers
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_text(table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded_digests(table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(table(spark, sf_dir, "embeddings"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted_in_parts(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations")).drop("preorder", "subtree_end")


def op12_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.compressed(table(spark, sf_dir, "embeddings"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Query]:
    found = (
        op1_simhash_fingerprints, op2_html_extraction, op3_language_id, op4_sentencepiece, op5_simhash_near_dedup,
        op6_exact_top_k, op7_quality_classifier, op8_token_counts, op9_pii, op10_best_fit_packing,
        op11_conversation_prefix_trie, op12_vector_code_compression, op13_warc,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_top_k": TOP_K_SQL, "op11_conversation_prefix_trie": TRIE_SQL, "op12_vector_code_compression": CODES_SQL, "op13_warc": WARC_SQL}


TOP_K_SQL = """
WITH rows AS (
  SELECT CAST(vec_id AS BIGINT) AS id, min([CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding]) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id
), scores AS (
  SELECT q.id AS query_id, c.id AS vec_id, CAST(list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
  FROM rows q JOIN rows c ON q.id <> c.id AND len(q.v) = len(c.v)
  WHERE q.id % 100 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scores
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

#: CRC-32 of a string of ASCII characters, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST({x} AS VARCHAR), ''), lambda y: CAST(ord(y) AS BIGINT))),
    lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""

TRIE_SQL = f"""
WITH said AS (
  SELECT CAST(conv_id AS BIGINT) AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT c, list({{'k': k, 'n': n}} ORDER BY turn NULLS FIRST, k) AS turns
  FROM (SELECT c, turn, length(text) AS n, sha256(CAST(strlen(role) AS VARCHAR) || ':' || role || text) AS k FROM said) GROUP BY c
), lent AS (
  SELECT c, turns, {_CRC.format(x="c")} % 6 AS h FROM own
), built AS (
  SELECT a.c, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) AS s FROM lent a LEFT JOIN own b ON b.c = a.c - a.c % 100
), keyed AS (
  SELECT c, s, list_transform(range(0, len(s) + 1), lambda d: md5(array_to_string(list_transform(s[1:d], lambda x: x.k), ','))) AS keys FROM built
), members AS (
  SELECT c, d, keys[d + 1] AS key, keys[d] AS up, keys[1:d + 1] AS above, CASE WHEN d = 0 THEN 0 ELSE s[d].n END AS n, d = len(s) AS ends
  FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM keyed)
), nodes AS (
  SELECT key, d, min(c) AS conv_id, count(*) AS n_convs, any_value(up) AS up, any_value(above) AS above, (count(*) - 1) * any_value(n) AS saved,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
  FROM members GROUP BY key, d
), children AS (
  SELECT up AS key, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY up
), whole AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.key = n.key
), below AS (
  SELECT a AS key, CAST(sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
  FROM (SELECT unnest(above) AS a, n_children, saved FROM whole) GROUP BY a
)
SELECT w.conv_id, CAST(w.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, b.n_leaves, b.saved_tokens, w.ends_sha256
FROM whole w JOIN below b ON b.key = w.key LEFT JOIN nodes p ON p.key = w.up AND w.d > 0
"""


def _codes_sql(parts: int = 4, k: int = 256, rounds: int = 4) -> str:
    """Lloyd's rounds one by one; components stay under 2^21, so that doubles hold all sums of squares."""
    steps = [f"""
kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS row, CAST(vec_id AS BIGINT) AS vec_id, label, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT row, part, v[part * (len(v) // {parts}) + 1:(part + 1) * (len(v) // {parts})] AS x FROM (SELECT row, v, unnest(range({parts})) AS part FROM kept)
), book0 AS MATERIALIZED (
  SELECT part, row AS entry, x FROM parts WHERE row < {k}
)"""]
    nearest = """
near{i} AS MATERIALIZED (
  SELECT p.row, p.part, min_by(b.entry, (d, b.entry)) AS entry, CAST(min(d) AS BIGINT) AS d
  FROM (SELECT p.row, p.part, b.entry, list_dot_product(p.x::DOUBLE[], p.x::DOUBLE[]) - 2 * list_dot_product(p.x::DOUBLE[], b.x::DOUBLE[]) + list_dot_product(b.x::DOUBLE[], b.x::DOUBLE[]) AS d
    FROM parts p JOIN book{i} b ON b.part = p.part) AS p, LATERAL (SELECT p.entry) AS b(entry)
  GROUP BY p.row, p.part
)"""
    for i in range(rounds):
        steps.append(nearest.format(i=i))
        steps.append(f"""
book{i + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM book{i} b LEFT JOIN (
    SELECT part, entry, list(mean ORDER BY place) AS x FROM (
      SELECT n.part, n.entry, u.place, CAST((sum(u.c) - ((sum(u.c) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS mean
      FROM near{i} n JOIN (SELECT row, part, unnest(x) AS c, unnest(range(len(x))) AS place FROM parts) u ON u.row = n.row AND u.part = n.part GROUP BY n.part, n.entry, u.place
    ) GROUP BY part, entry
  ) m ON m.part = b.part AND m.entry = b.entry
)""")
    steps.append(nearest.format(i=rounds))
    steps.append(f"""
coded AS (
  SELECT row, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY row
), books AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS said FROM book{rounds}
), labels AS (
  SELECT k.label, CAST(sum(c.error) AS BIGINT) AS label_error FROM kept k JOIN coded c ON c.row = k.row GROUP BY k.label
)""")
    return f"""
WITH {",".join(steps)}
SELECT k.vec_id, c.code, c.error, l.label_error, (SELECT said FROM books) AS codebooks_sha256
FROM kept k JOIN coded c ON c.row = k.row JOIN labels l ON l.label IS NOT DISTINCT FROM k.label
"""


CODES_SQL = _codes_sql()

WARC_SQL = """
WITH said AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), bits AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest
  FROM said
), tops AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM bits
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM top THEN NULL ELSE top END AS refers_to
FROM tops
"""

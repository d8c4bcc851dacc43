"""One query per operator, on whole tables, and SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerspark.llm import (
    hilbert_search, html_text, language, merkle, mixing, ngram_join, phrase_index, pii, ranked_search, suffix_dedup,
    token_files, toxicity, warc,
)
from ledgerspark.llm.common import staged


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return toxicity.toxic_scores(docs, toxicity.train(docs, labels))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = staged(mixing.word_sizes(_table(spark, sf_dir, "documents")))
    return mixing.mix(sizes).select("doc_id", "size", "source_size", "target", "taken")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op4_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(_table(spark, sf_dir, "pages"))
    return warc.read_archives(archives).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op5_hilbert_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_search.search(_table(spark, sf_dir, "embeddings"))


def op6_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pii.find_personal_data(docs, pii.train(docs))


def op7_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return phrase_index.contamination(docs, items).drop("tag")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = token_files.write_sequences(_table(spark, sf_dir, "documents"), tokenizer_path())
    return token_files.read_documents(shards)


def op9_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages_of(_table(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify_documents(_table(spark, sf_dir, "documents"))


def op12_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.train(pages)).select("page_id", "url", "text", "n_chars")


def op13_pair_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_compression_toxicity": op1_compression_toxicity,
        "op2_mix_sources": op2_mix_sources,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_warc_zstd": op4_warc_zstd,
        "op5_hilbert_search": op5_hilbert_search,
        "op6_boosted_pii": op6_boosted_pii,
        "op7_phrase_index": op7_phrase_index,
        "op8_token_files": op8_token_files,
        "op9_string_kernel": op9_string_kernel,
        "op10_ngram_join": op10_ngram_join,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_block_labeller": op12_block_labeller,
        "op13_pair_maxscore": op13_pair_maxscore,
    }


# Ranks every quotient, where the operator brackets the quotas and ranks a few of them.
_MIX_SQL = r"""
WITH RECURSIVE sizes AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs,
         row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank
  FROM sizes GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][(rank - 1) % 3 + 1] AS w FROM src),
-- round by round: whatever would pass its cap stays there, the others share the rest
filled AS (
  SELECT 0 AS round, rank, source_size, w, false AS capped,
         sum(source_size) OVER () AS rest, sum(w) OVER () AS rest_w FROM weighed
  UNION ALL
  SELECT round + 1, rank, source_size, w, now_capped,
         sum(source_size) OVER () - coalesce(sum(CASE WHEN now_capped THEN 3 * source_size END) OVER (), 0),
         sum(CASE WHEN now_capped THEN 0 ELSE w END) OVER ()
  FROM (SELECT *, capped OR 3 * source_size * rest_w < w * rest AS now_capped FROM filled)
  WHERE round < 30 AND EXISTS (SELECT 1 WHERE now_capped IS NOT NULL)),
targets AS (
  SELECT rank, CASE WHEN capped THEN (3 * source_size)::DOUBLE
                    ELSE (w * rest)::DOUBLE / rest_w::DOUBLE END AS target
  FROM filled WHERE round = 30),
seats AS (SELECT ((sum(size) + 8) // 16)::BIGINT AS n FROM sizes),
won AS (
  SELECT rank FROM (
    SELECT t.rank, row_number() OVER (ORDER BY t.target / (2 * k + 1) DESC, t.rank, k) AS place, n
    FROM targets t, seats, range(0, greatest(n, 1)) AS g(k) WHERE t.target > 0)
  WHERE place <= n),
quotas AS (
  SELECT w.rank, w.source, w.source_size, t.target, ceil(sqrt(w.n_docs))::BIGINT AS shards,
         (SELECT count(*) FROM won WHERE won.rank = w.rank) AS quota
  FROM weighed w JOIN targets t USING (rank)),
hashed AS (SELECT *, md5('11:' || coalesce(doc_id::VARCHAR, '')) AS h FROM sizes),
placed AS (
  SELECT h.*, q.rank, q.source_size, q.target, q.quota,
         (('0x' || substr(h.h, 1, 8))::BIGINT * q.shards) >> 32 AS shard
  FROM hashed h JOIN quotas q ON h.source IS NOT DISTINCT FROM q.source),
shard_sizes AS (
  SELECT rank, shard, sum(size)::BIGINT AS shard_size, max(quota) AS quota FROM placed GROUP BY 1, 2),
shard_won AS (
  SELECT rank, shard FROM (
    SELECT rank, shard, quota,
           row_number() OVER (PARTITION BY rank ORDER BY shard_size::DOUBLE / (2 * k + 1) DESC, shard, k) AS place
    FROM shard_sizes, range(0, greatest(quota, 1)) AS g(k) WHERE shard_size > 0)
  WHERE place <= quota),
shard_takes AS (
  SELECT s.rank, s.shard, s.shard_size, least(3 * s.shard_size, 16 * count(v.rank))::BIGINT AS tokens
  FROM shard_sizes s LEFT JOIN shard_won v ON v.rank = s.rank AND v.shard = s.shard
  GROUP BY s.rank, s.shard, s.shard_size),
ends AS (
  SELECT *, sum(size) OVER (PARTITION BY rank, shard ORDER BY h, doc_id, size
                            ROWS UNBOUNDED PRECEDING)::BIGINT AS e FROM placed)
SELECT e.doc_id, e.size, e.source_size::BIGINT AS source_size, e.target,
       (CASE WHEN t.shard_size > 0 THEN (t.tokens // t.shard_size) * e.size ELSE 0 END
        + CASE WHEN t.shard_size > 0 THEN
            greatest(0, least(e.e, t.tokens % t.shard_size) - (e.e - e.size)) ELSE 0 END)::BIGINT AS taken
FROM ends e JOIN shard_takes t ON t.rank = e.rank AND t.shard = e.shard
"""

_WARC_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (
  SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""


# Joins every run of document words to the windows as text.
_PHRASE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, array_to_string(w[s : s + 9], ' ') AS phrase, least(len(w), 10) AS n
  FROM b, range(1, greatest(1, len(w) - 9) + 1) AS r(s) WHERE len(w) > 0),
runs AS (
  SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS phrase
  FROM d, (SELECT DISTINCT n FROM win) AS l, range(1, len(w) - n + 2) AS r(s)),
m AS (SELECT r.doc_id, r.s, r.n, win.item_id FROM runs r JOIN win USING (phrase, n)),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM m, range(s, s + n) AS r(p) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


# Folds level by level in one recursion over all trees; crc32 comes from its table, bit by bit.
_MERKLE_SQL = """
WITH RECURSIVE bits AS (
  SELECT i AS byte, 0 AS step, i::BIGINT AS v FROM range(256) AS r(i)
  UNION ALL
  SELECT byte, step + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE step < 8),
crc AS (SELECT list(v ORDER BY byte) AS t FROM bits WHERE step = 8),
d AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                            lambda h, b: xor(h >> 8, t[(xor(h, b) & 255) + 1])), 4294967295) % 5 = 0 AS picked
  FROM documents, crc),
head AS (
  SELECT *, concat(
    coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-'), coalesce(octet_length(encode(source)) || ':' || source, '-'),
    coalesce(octet_length(encode(lang)) || ':' || lang, '-'), coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-')) AS h
  FROM d),
leaf AS (
  SELECT doc_id, source, sha256(h || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
         sha256(h || coalesce(octet_length(encode(text)) || ':' || CASE WHEN coalesce(picked, false)
           THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS other
  FROM head),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaf),
node AS (
  SELECT source, 0 AS level, pos, n, leaf AS digest FROM placed
  UNION ALL
  SELECT source, level + 1, pos // 16, (max(n) + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos))
  FROM node WHERE n > 1 GROUP BY source, level, pos // 16),
sub AS (
  SELECT source, digest AS subroot, level AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
  FROM node WHERE n = 1),
up AS (
  SELECT 0 AS level, pos, n, subroot AS digest FROM sub
  UNION ALL
  SELECT level + 1, pos // 16, (max(n) + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos))
  FROM up WHERE n > 1 GROUP BY level, pos // 16),
every AS (
  SELECT n.source, n.level, n.pos, n.digest FROM node n WHERE n.n > 1
  UNION ALL
  SELECT s.source, s.height + u.level, u.pos, u.digest FROM sub s JOIN up u ON u.n > 1 AND u.pos // 16 = s.pos // power(16, u.level + 1)::BIGINT),
step AS (
  SELECT p.doc_id, p.source, p.pos AS place, e.level,
         coalesce(string_agg(e.digest, '' ORDER BY e.pos) FILTER (e.pos < w.own), '') AS before,
         coalesce(string_agg(e.digest, '' ORDER BY e.pos) FILTER (e.pos > w.own), '') AS after
  FROM placed p JOIN sub s ON p.source IS NOT DISTINCT FROM s.source
  JOIN every e ON e.source IS NOT DISTINCT FROM p.source,
  LATERAL (SELECT CASE WHEN e.level < s.height THEN p.pos // power(16, e.level)::BIGINT
                       ELSE s.pos // power(16, e.level - s.height)::BIGINT END AS own) AS w
  WHERE e.pos // 16 = w.own // 16
  GROUP BY p.doc_id, p.source, p.pos, e.level),
proof AS (
  SELECT source, place, sha256(string_agg(before || after, '' ORDER BY level)) AS proof_sha256, count(*) AS height FROM step GROUP BY source, place),
fold AS (
  SELECT source, pos AS place, 0 AS level, other AS h FROM placed
  UNION ALL
  SELECT f.source, f.place, f.level + 1, sha256(s.before || f.h || s.after)
  FROM fold f JOIN step s ON s.source IS NOT DISTINCT FROM f.source AND s.place = f.place AND s.level = f.level)
SELECT p.doc_id, p.leaf, s.subroot, r.digest AS root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = r.digest AS verified
FROM placed p JOIN sub s ON p.source IS NOT DISTINCT FROM s.source
JOIN (SELECT digest FROM up WHERE n = 1) r ON true
LEFT JOIN proof q ON q.source IS NOT DISTINCT FROM p.source AND q.place = p.pos
JOIN fold f ON f.source IS NOT DISTINCT FROM p.source AND f.place = p.pos AND f.level = coalesce(q.height, 0)
"""

# Scores every document that holds a term of an item.
_RANKED_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
total AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS terms FROM d WHERE len(w) > 0),
tf AS (SELECT r, any_value(doc_id) AS doc_id, term, count(*) AS tf, any_value(n) AS n
       FROM (SELECT r, doc_id, unnest(w) AS term, len(w) AS n FROM d) GROUP BY r, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY 1, 2),
weighed AS (
  SELECT item_id, term, times * floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM asked JOIN df USING (term), total),
scored AS (
  SELECT item_id, r, any_value(doc_id) AS doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT AS score
  FROM weighed JOIN tf USING (term), total GROUP BY item_id, r)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scored WHERE score > 0)
WHERE rank <= 20
"""


def llm_oracles() -> dict[str, str]:
    return {
        "op2_mix_sources": _MIX_SQL, "op4_warc_zstd": _WARC_SQL, "op7_phrase_index": _PHRASE_SQL,
        "op11_merkle_manifest": _MERKLE_SQL, "op13_pair_maxscore": _RANKED_SQL,
    }

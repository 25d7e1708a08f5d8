"""The registered queries of this subpackage and their SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, dedup, langid, license, mixing, ngram_join, quality, sharding, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.decide(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=8)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary_path())


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.decide(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{said}'), (-1L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    return chat.digests(chat.expand(told.unionByName(more)))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.decide(table(spark, sf_dir, "documents"))


def op10_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents"))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


OP2_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS n FROM d GROUP BY h)
SELECT d.doc_id, g.keep_id, CAST(g.n AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, d.h AS text_sha256
FROM d JOIN g ON d.h = g.h
"""


def op5_sql() -> str:
    """The sweeps written out one below the other."""
    rules = " ".join(f"WHEN regexp_matches(t, '{pattern}') THEN '{name}'" for name, pattern in mixing.TOPICS)
    dims = ("source", "lang", "topic")
    parts = [
        f"d AS (SELECT doc_id, source, lang, t, CASE {rules} ELSE 'none' END AS topic, len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS n FROM (SELECT *, coalesce(text, '') AS t FROM documents))",
        "g0 AS (SELECT source, lang, topic, sum(n) AS n, 1.0::DOUBLE AS g FROM d GROUP BY ALL)",
        "total AS (SELECT sum(n)::DOUBLE AS total FROM g0)",
    ]
    for dim in dims:
        parts.append(f"a_{dim} AS (SELECT {dim} AS v, share / sum(share) OVER () AS aim FROM (SELECT {dim}, CASE WHEN sum(n) > 0 THEN pow(sum(n)::DOUBLE, {mixing.TEMPER}) END AS share FROM g0 GROUP BY {dim}))")
    k = 0
    for _ in range(mixing.SWEEPS):
        for dim in dims:
            parts.append(f"s{k} AS (SELECT {dim} AS v, sum(g * n) AS now FROM g{k} GROUP BY {dim})")
            parts.append(
                f"g{k + 1} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.n, c.g * CASE WHEN s.now > 0 AND a.aim > 0 THEN a.aim * total / s.now ELSE 1.0 END AS g"
                f" FROM g{k} c JOIN s{k} s ON c.{dim} IS NOT DISTINCT FROM s.v JOIN a_{dim} a ON c.{dim} IS NOT DISTINCT FROM a.v CROSS JOIN total)"
            )
            k += 1
    # The factor: cells by falling weight; of those that could be taken whole as few as leave every other probability below 1.
    parts.append(f"w AS (SELECT g, sum(n)::DOUBLE AS n, sum(g * n) AS m FROM g{k} WHERE n > 0 GROUP BY g)")
    parts.append("c AS (SELECT g, coalesce(sum(n) OVER (ORDER BY g DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held, sum(m) OVER (ORDER BY g ROWS UNBOUNDED PRECEDING) AS rest FROM w)")
    parts.append(f"most AS (SELECT coalesce(max((greatest({mixing.SHARE} * total - held, 0)) / rest) FILTER (WHERE g * greatest({mixing.SHARE} * total - held, 0) / rest < 1), 1e300) AS f FROM c CROSS JOIN total)")
    uniform = f"('0x' || substr(md5('{mixing.SEED}:' || d.doc_id), 1, 12))::BIGINT / {float(1 << 48)}"
    parts.append(f"p AS (SELECT source, lang, topic, round(g, 9) AS weight, round(least(g * f, 1.0), 9) AS probability FROM g{k} CROSS JOIN most)")
    same = " AND ".join(f"d.{x} IS NOT DISTINCT FROM p.{x}" for x in dims)
    return f"WITH {', '.join(parts)} SELECT d.doc_id, d.source, d.lang, d.topic, CAST(d.n AS BIGINT) AS n_tokens, p.weight, p.probability, {uniform} < p.probability AS kept FROM d JOIN p ON {same}"


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS h FROM p),
best AS (SELECT h, max(page_id) AS page_id FROM d GROUP BY h)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.h AS payload_digest,
  CASE WHEN d.n >= 1000 AND d.page_id <> best.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN d.n >= 1000 AND d.page_id <> best.page_id THEN best.page_id END AS refers_to
FROM d JOIN best ON d.h = best.h
"""

OP8_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
escaped AS (
  SELECT *, regexp_replace(regexp_replace(text, '(<)(~*)(\|[A-Za-z0-9_]+\|>|/?s>)', '\1~\2\3', 'g'), '(\[)(~*)(/?INST\])', '\1~\2\3', 'g') AS body FROM rows),
placed AS (
  SELECT *, sum(length('<|turn|>') + length(role) + 1 + length(body) + length('<|end|>') + 1)
    OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS stop,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
    count(*) OVER (PARTITION BY conv_id) AS total
  FROM escaped)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR n = total THEN stop ELSE 0 END) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""

OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
windows AS (
  SELECT rid, p, words[p] || ' ' || words[p + 1] || ' ' || words[p + 2] AS win
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS p FROM w)),
again AS (SELECT rid, unnest([p, p + 1, p + 2]) AS p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, win) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT rid, count(DISTINCT p) AS n FROM again GROUP BY rid),
l AS (SELECT rid, source, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (
  SELECT rid, source, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
    lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS normal
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM lw GROUP BY rid),
common AS (SELECT source, normal FROM lw GROUP BY source, normal HAVING count(DISTINCT rid) > 5),
gone AS (SELECT lw.rid, sum(lw.n) AS n FROM lw JOIN common c ON lw.source IS NOT DISTINCT FROM c.source AND lw.normal = c.normal GROUP BY lw.rid),
base AS (
  SELECT d.doc_id, len(w.words) AS n_words, length(array_to_string(w.words, '')) AS word_chars,
    length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(dup.n, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS gone
  FROM d JOIN w USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN repeats USING (rid) LEFT JOIN gone USING (rid)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND n_words - gone >= 0.3 * n_words AS kept
FROM judged
"""


def queries() -> dict[str, Query]:
    return {
        "op1_ngram_join": op1_ngram_join,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_sharding": op3_sharding,
        "op4_bpe": op4_bpe,
        "op5_mixing": op5_mixing,
        "op6_warc": op6_warc,
        "op7_langid": op7_langid,
        "op8_chat": op8_chat,
        "op9_quality": op9_quality,
        "op10_license": op10_license,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL, "op5_mixing": op5_sql(), "op6_warc": OP6_SQL, "op8_chat": OP8_SQL, "op9_quality": OP9_SQL}

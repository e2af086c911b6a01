"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timelog.llm import chat, chunking, decontam, exact, langid, mixing, quality, simhash, suffix, urlfilter
from timelog.llm.common import docs_of


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(docs_of(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontam.benchmark_hits(docs_of(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), decontam.items_digest(F.col("items")).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(docs_of(spark, sf_dir))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"), links=True)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_components(docs_of(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_of(spark, sf_dir)
    found = langid.predict(docs, langid.train(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(docs_of(spark, sf_dir))


def op9_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_dedup(docs_of(spark, sf_dir), least_run=0)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_of(spark, sf_dir)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_quality(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pareto_mix": op1_pareto_mix,
    "op2_decontaminate": op2_decontaminate,
    "op3_url_filter": op3_url_filter,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_chat_format": op5_chat_format,
    "op6_simhash": op6_simhash,
    "op7_language": op7_language,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_chunk_dedup": op9_chunk_dedup,
    "op10_quality": op10_quality,
}

_OP8 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS digest
  FROM documents
), g AS (
  SELECT *, count(*) OVER (PARTITION BY digest) AS group_size,
         first_value(doc_id) OVER (PARTITION BY digest ORDER BY points DESC, doc_id NULLS LAST) AS keep_id,
         row_number() OVER (PARTITION BY digest ORDER BY points DESC, doc_id NULLS LAST) AS nth
  FROM d
)
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, digest AS text_sha256 FROM g
"""

_OP2 = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark
), grams AS (
  SELECT DISTINCT item, CASE WHEN len(words) < 10 THEN len(words) ELSE 10 END AS n,
         array_to_string(words[k : k + CASE WHEN len(words) < 10 THEN len(words) ELSE 10 END - 1], ' ') AS gram
  FROM (SELECT item, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS k FROM i WHERE len(words) > 0)
), lengths AS (SELECT DISTINCT n FROM grams),
dw AS (
  SELECT doc_id, n, k, array_to_string(words[k : k + n - 1], ' ') AS gram
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS k FROM w, lengths)
), hits AS (SELECT dw.doc_id, dw.k, dw.n, g.item FROM dw JOIN grams g ON dw.gram = g.gram AND dw.n = g.n),
marked AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS pos FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS items_sha256 FROM hits GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN marked USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP5 = """
WITH turns AS (SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, coalesce('=' || role, '-') AS role, coalesce('=' || text, '-') AS text FROM conversations),
whole AS (SELECT conv_id, list({'t': turn, 'r': role, 'x': text} ORDER BY turn, role, text) AS said, count(DISTINCT turn) AS n_turns FROM turns GROUP BY conv_id),
ends AS (SELECT DISTINCT conv_id, turn FROM turns),
prefixes AS (
  SELECT w.conv_id, list_filter(w.said, lambda s: s.t <= e.turn) AS said, e.turn = list_max(list_transform(w.said, lambda s: s.t)) AS last
  FROM ends e JOIN whole w ON e.conv_id IS NOT DISTINCT FROM w.conv_id
),
one AS (SELECT min(conv_id) AS conv_id, said, n_turns, count(*) AS copies FROM whole GROUP BY said, n_turns),
kept AS (SELECT * FROM one WHERE said NOT IN (SELECT said FROM prefixes WHERE NOT last)),
shown AS (SELECT DISTINCT conv_id, turn, CAST(floor(turn / 1024) AS BIGINT) AS part, CASE WHEN role = '-' THEN '' ELSE substr(role, 2) END AS role, CASE WHEN text = '-' THEN '' ELSE substr(text, 2) END AS text FROM turns),
of_kept AS (SELECT p.said, min(k.conv_id) AS kept_id FROM prefixes p JOIN kept k ON p.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY p.said)
SELECT k.conv_id, t.part, k.n_turns, k.copies,
       string_agg('<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10), '' ORDER BY t.turn, t.role, t.text) AS rendered, k.conv_id AS kept_id
FROM kept k JOIN shown t ON k.conv_id IS NOT DISTINCT FROM t.conv_id
GROUP BY k.conv_id, t.part, k.n_turns, k.copies
UNION ALL
SELECT w.conv_id, NULL, w.n_turns, NULL, NULL, o.kept_id
FROM whole w JOIN of_kept o ON w.said = o.said
WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.conv_id IS NOT DISTINCT FROM w.conv_id)
"""

ORACLES: dict[str, str] = {"op5_chat_format": _OP5, "op2_decontaminate": _OP2, "op8_exact_dedup": _OP8}

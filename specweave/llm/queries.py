"""The queries of these operators, by name, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from specweave.llm import chat, embeddings, html_text, katz, mixing, near_dup, packing, token_count, topk, toxicity
from specweave.runtime import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_count.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(_table(spark, sf_dir, "embeddings"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), Fraction(85, 100), 3)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(_table(spark, sf_dir, "pages"))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("h")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op9_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(_table(spark, sf_dir, "documents"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(turns.unionByName(added)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_counts, op2_embedding_near_duplicates, op3_toxicity, op4_near_duplicates, op5_html_text, op6_top_k, op7_mixing, op8_packing, op9_katz_scores, op10_chat_formatting)
}

#: The links of a graph followed to the smallest id, for DuckDB.
_REACH = """
reach AS (
    SELECT a AS node, b AS other FROM links
    UNION
    SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.other
)"""

_COMPONENTS = """
component AS (SELECT node, min(other) AS low FROM reach GROUP BY node)"""

ORACLE_SQL: dict[str, str] = {
    "op2_embedding_near_duplicates": f"""
WITH RECURSIVE sound AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
    SELECT p.vec_id AS a, q.vec_id AS b FROM sound p JOIN sound q
      ON p.vec_id <> q.vec_id AND len(p.v) = len(q.v) AND list_cosine_similarity(p.v, q.v) >= 0.9
), {_REACH}, {_COMPONENTS}
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links,
       least(vec_id, coalesce(low, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN component ON node = vec_id""",
    "op4_near_duplicates": f"""
WITH RECURSIVE worded AS (
    SELECT doc_id, list_filter(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), shingles AS MATERIALIZED (
    SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN []
        WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS s
    FROM worded
), sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
    SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM shingles p JOIN shingles q
      ON p.s = q.s AND p.doc_id <> q.doc_id GROUP BY ALL
), links AS MATERIALIZED (
    SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * c >= 85 * (x.n + y.n - c)
), {_REACH}, {_COMPONENTS}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles,
       least(d.doc_id, coalesce(low, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(low, d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN component ON node = d.doc_id""",
    # Windows start where the budget ends the one before; a turn counts once for each window that shows it.
    "op10_chat_formatting": rf"""
WITH RECURSIVE said AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(0, 2) AS r(k)
), turns AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
           len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n FROM said
), placed AS MATERIALIZED (
    SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY k) AS upto,
           length(role) + length(text) + len(regexp_extract_all(role || text, '\\|<s>|</s>|\[INST\]|\[/INST\]')) + {len("".join((chat.OPEN, chat.HEAD, chat.TAIL, chat.CLOSE)))} AS size
    FROM turns
), ends AS MATERIALIZED (
    SELECT conv_id, max(k) AS last, max(CASE WHEN k = 1 AND role = 'system' THEN 1 ELSE 0 END) AS sys,
           max(CASE WHEN k = 1 AND role = 'system' THEN n ELSE 0 END) AS sys_n FROM placed GROUP BY conv_id
), windows AS (
    SELECT conv_id, 0 AS w, CAST(1 AS BIGINT) AS first, CAST(1 AS BIGINT) AS past, CAST(0 AS HUGEINT) AS fixed FROM ends
    UNION ALL
    SELECT w.conv_id, w.w + 1, e.stop + 1, e.past, e.fixed FROM windows w, LATERAL (
        SELECT z.stop, min(h.k) FILTER (h.k > z.sys AND z.upto - h.upto + h.n <= {chat.HISTORY} OR h.k > z.stop) AS past,
               z.sys_n + z.upto - coalesce(max(h.upto) FILTER (h.k <= z.sys OR z.upto - h.upto + h.n > {chat.HISTORY} AND h.k <= z.stop), 0) AS fixed
        FROM (SELECT any_value(ends.sys) AS sys, any_value(ends.sys_n) AS sys_n, any_value(ends.last) AS last, max(p.k) AS stop, max(p.upto) AS upto
              FROM placed p JOIN ends ON ends.conv_id IS NOT DISTINCT FROM p.conv_id JOIN placed f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.k = w.first
              WHERE p.conv_id IS NOT DISTINCT FROM w.conv_id AND p.k >= w.first AND (p.k = w.first OR w.fixed + p.upto - f.upto + f.n <= {chat.BUDGET})) z,
             placed h
        WHERE h.conv_id IS NOT DISTINCT FROM w.conv_id AND z.stop < z.last
        GROUP BY z.stop, z.sys, z.sys_n, z.upto) e
), spans AS (
    SELECT conv_id, w, first, past, coalesce(lead(first) OVER (PARTITION BY conv_id ORDER BY w), 1152921504606846976) AS next FROM windows
), shown AS (
    SELECT s.conv_id, sum(p.size) AS chars FROM spans s JOIN placed p ON p.conv_id IS NOT DISTINCT FROM s.conv_id
    JOIN ends ON ends.conv_id IS NOT DISTINCT FROM s.conv_id
    WHERE p.k >= s.past AND p.k < s.next OR s.w > 0 AND p.k = 1 AND ends.sys = 1 GROUP BY s.conv_id
), digest AS (
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256 FROM placed GROUP BY conv_id
)
SELECT digest.*, CAST(chars AS BIGINT) AS formatted_chars FROM digest JOIN shown ON shown.conv_id IS NOT DISTINCT FROM digest.conv_id""",
    "op6_top_k": """
WITH whole AS MATERIALIZED (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
           CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
    FROM whole q JOIN whole c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 10""",
}

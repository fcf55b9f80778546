"""The queries of this subpackage and the SQL that DuckDB can hold against them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, langid, media, near_dedup, passage_dedup, pieces, ppm, suffix_dedup, tokens, toxicity
from ._arrow import read_documents


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(read_documents(spark, sf_dir))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup_digest(suffix_dedup.suffix_dedup(read_documents(spark, sf_dir)))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return decontaminate.decontaminate_digest(found)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(read_documents(spark, sf_dir))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.lm_score(read_documents(spark, sf_dir))


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_digest(tokens.tokenize(read_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))


def op8_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup.passage_dedup_digest(passage_dedup.passage_dedup(read_documents(spark, sf_dir)))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(media.encode_media(read_documents(spark, sf_dir)))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.pieces_digest(pieces.encode_pieces(read_documents(spark, sf_dir), model, decoded=True))


def queries() -> dict:
    return {
        f.__name__: f for f in (
            op1_toxicity, op2_language_id, op3_suffix_dedup, op4_decontaminate, op5_near_dedup, op6_lm_score,
            op7_token_ids, op8_passage_dedup, op9_media, op10_pieces
        )
    }


OP4_SQL = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), bw AS (
    SELECT DISTINCT item_id, least(8, len(w)) AS n, array_to_string(w[i : i + least(8, len(w)) - 1], ' ') AS k
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM bw),
dw AS (
    SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS k
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
), hit AS (SELECT doc_id, item_id, dw.n, i FROM dw JOIN bw USING (n, k)),
covered AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM hit) GROUP BY doc_id),
items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS joined
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


OP3_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
p AS (SELECT doc_id, x, n, unnest(range(1, n + 1)) AS i FROM d),
w AS (SELECT doc_id, n, i, substr(x, 2 * i - 1, 2) AS byte, CASE WHEN i <= n - 99 THEN substr(x, 2 * i - 1, 200) END AS k FROM p),
f AS (SELECT doc_id, n, i, byte, k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS again FROM w),
g AS (SELECT doc_id, n, i, byte, coalesce(bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), false) AS gone FROM f),
h AS (SELECT doc_id, n, i, byte, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM g),
r AS (
    SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans, coalesce(string_agg(byte, '' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept
    FROM h GROUP BY doc_id
)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""

OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, w, CASE WHEN len(w) > 0 THEN min(doc_id) OVER (PARTITION BY text) ELSE doc_id END AS text_id FROM d),
u AS (SELECT doc_id, w FROM t WHERE doc_id = text_id AND len(w) > 0),
s AS (
    SELECT doc_id, k, count(*) AS n FROM (SELECT doc_id, array_to_string(w[i : i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM u))
    GROUP BY doc_id, k
),
z AS (SELECT doc_id, sum(n) AS size FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.n, y.n)) AS low FROM s x JOIN s y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 5 * low >= 4 * (x.size + y.size - low)),
links AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(node, root) AS (SELECT doc_id, doc_id FROM u UNION SELECT links.b, r.root FROM r JOIN links ON r.node = links.a AND r.root < links.b),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT t.doc_id, text_id, coalesce(root, text_id) AS class_id FROM t LEFT JOIN c ON node = text_id
"""

OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i <= len(w) - 49 THEN array_to_string(w[i : i + 49], ' ') END AS k FROM p),
f AS (SELECT doc_id, i, word, k IS NOT NULL AND doc_id > min(doc_id) OVER (PARTITION BY k) AS again FROM k),
g AS (SELECT doc_id, i, word, coalesce(bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), false) AS gone FROM f),
r AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM g GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_suffix_dedup": OP3_SQL, "op4_decontaminate": OP4_SQL, "op5_near_dedup": OP5_SQL, "op8_passage_dedup": OP8_SQL}

"""Registered queries of the training-data operators, over whole tables, and their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm import (
    decontaminate, fingerprints, licenses, line_dedup, mixing, ngram_join, packing, phrases, quality, topk, toxicity, vector_codes, warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


@_query("op1_warc_revisits", """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS body FROM pages
), d AS (
    SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest,
           min(page_id) OVER (PARTITION BY sha256(body)) AS original
    FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> original THEN original END AS refers_to
FROM d
""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages"))


@_query("op2_best_fit_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


@_query("op3_line_dedup", r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i
    FROM documents
), keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM lines
), frequent AS (
    SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
    SELECT keyed.*, frequent.k IS NOT NULL AND doc_id <> keeper AS lost FROM keyed LEFT JOIN frequent USING (k)
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN lost THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@_query("op4_ngram_jaccard")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@_query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).select(
        "doc_id", "held_out", "score", "predicted")


@_query("op6_exact_top_k", """
WITH v AS (
    SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
    SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


@_query("op7_license_scan")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


@_query("op8_fingerprints")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(_table(spark, sf_dir, "documents"))


@_query("op9_quality")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query("op10_source_mixing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "lang", "topic", "tokens", "token_weight", "probability", "sampled")


@_query("op11_decontamination", r"""
WITH d AS (
    SELECT row_number() OVER () AS row, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), b AS (
    SELECT item_id, w, least(len(w), 10) AS k FROM (
        SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM benchmark
    ) WHERE len(w) > 0
), bw AS (
    SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS words
    FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM b)
), dw AS (
    SELECT row, k, i, array_to_string(w[i : i + k - 1], ' ') AS words
    FROM (SELECT row, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw))
), hits AS (
    SELECT row, i, k, item_id FROM dw JOIN bw USING (k, words)
), items AS (
    SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
    FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY row
), marked AS (
    SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(i, i + k)) AS p FROM hits) GROUP BY row
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN items USING (row) LEFT JOIN marked USING (row)
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), keep=["doc_id"]).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@_query("op12_collocations", r"""
WITH pieces AS (
    SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece
    FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
), worded AS (
    SELECT lang, w FROM (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces) WHERE len(w) > 0
), totals AS (
    SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang
), grams AS (
    SELECT lang, k, w[CAST(i AS BIGINT) : CAST(i + k - 1 AS BIGINT)] AS p
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM worded, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k)
), f AS (
    SELECT lang, k, p, count(*) AS n FROM grams GROUP BY ALL HAVING count(*) >= 100
), cuts AS (
    SELECT c.lang, c.p, c.n AS a, c.k, j, l.n AS l, r.n AS r, t.n AS n,
           (CAST(1000 AS HUGEINT) * c.n * t.n) // (CAST(l.n AS HUGEINT) * r.n) AS score
    FROM (SELECT *, unnest(range(1, k)) AS j FROM f WHERE k > 1) c
    JOIN f l ON l.lang = c.lang AND l.p = c.p[1 : j] JOIN f r ON r.lang = c.lang AND r.p = c.p[j + 1 : c.k] JOIN totals t ON t.lang = c.lang
), best AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1
), left_ AS (
    SELECT * FROM best b WHERE NOT EXISTS (
        SELECT 1 FROM f x, unnest(range(0, 4)) AS o(s)
        WHERE x.lang = b.lang AND x.k > b.k AND 100 * x.n >= 100 * b.a AND s <= x.k - b.k AND x.p[s + 1 : s + b.k] = b.p)
)
SELECT * FROM (
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(p, ' '))) AS rank,
           array_to_string(p, ' ') AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score
    FROM left_
) WHERE rank <= 2000
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(_table(spark, sf_dir, "documents"))


def _codes_sql(rounds: int = 6) -> str:
    """Lloyd rounds unrolled; ``a<k>`` assigns parts to codebook ``c<k>``."""
    nearest = """a{k} AS (
    SELECT x.vec_id, x.row, x.part, min(struct_pack(far := far, entry := entry)) AS best
    FROM (SELECT x.vec_id, x.row, x.part, c.entry, CAST(list_sum(list_transform(list_zip(x.p, c.p), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS far
          FROM x JOIN c{k} c USING (part)) x
    GROUP BY ALL
)"""
    update = """m{k} AS (
    SELECT part, entry, i, CAST(sum(v) AS BIGINT) AS s, count(*) AS n
    FROM (SELECT a.part, a.best.entry AS entry, unnest(x.p) AS v, generate_subscripts(x.p, 1) AS i FROM a{k} a JOIN x USING (row, part)) GROUP BY ALL
), c{next} AS (
    SELECT c.part, c.entry, coalesce(n.p, c.p) AS p FROM c{k} c LEFT JOIN (
        SELECT part, entry, list((s - ((s % n + n) % n)) // n ORDER BY i) AS p FROM m{k} GROUP BY ALL) n USING (part, entry)
)"""
    steps = [text for k in range(rounds) for text in (nearest.format(k=k), update.format(k=k, next=k + 1))]
    return """
WITH v AS (
    SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS row,
           [CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS q
    FROM embeddings WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), x AS (
    SELECT vec_id, row, part, q[part * (len(q) // 8) + 1 : (part + 1) * (len(q) // 8)] AS p FROM v, (SELECT unnest(range(0, 8)) AS part)
), c0 AS (
    SELECT part, row - 1 AS entry, p FROM x WHERE row <= 16
), """ + ",\n".join([*steps, nearest.format(k=rounds)]) + f""", coded AS (
    SELECT row, vec_id, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, CAST(sum(best.far) AS BIGINT) AS error FROM a{rounds} GROUP BY ALL
), books AS (
    SELECT sha256(string_agg(CAST(n AS VARCHAR), ',' ORDER BY part, entry, i)) AS sha
    FROM (SELECT part, entry, unnest(p) AS n, generate_subscripts(p, 1) AS i FROM c{rounds})
)
SELECT v.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256
FROM coded JOIN v USING (row), books
"""


@_query("op13_vector_codes", _codes_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_table(spark, sf_dir, "embeddings")).drop("label")

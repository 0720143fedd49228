"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.bpe import BpeParams, round_trip
from folioscope.llm.collocations import collocations
from folioscope.llm.common import Scratch
from folioscope.llm.exact_dedup import exact_dedup
from folioscope.llm.html_extract import main_text
from folioscope.llm.lang_id import identify
from folioscope.llm.mixing import mixed
from folioscope.llm.order_minhash import near_classes
from folioscope.llm.packing import PackingParams, best_fit_packing
from folioscope.llm.pii import KINDS, pseudonymise
from folioscope.llm.ranked_search import ranked_search
from folioscope.llm.substring_dedup import substring_dedup
from folioscope.llm.topk_search import topk_search
from folioscope.llm.warc import read_warc, write_warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark, table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark, table(spark, sf_dir, "pages"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = BpeParams(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return round_trip(table(spark, sf_dir, "documents"), params)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark, table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonymise(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", *(F.coalesce(found["pii_counts"][kind], F.lit(0)).alias(f"n_{kind}") for kind in KINDS))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, table(spark, sf_dir, "documents")).drop("text_key")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body FROM documents),
g AS (SELECT body, count(*) AS group_size, arg_min(doc_id, (-n, doc_id)) AS keep_id FROM d GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM d JOIN g USING (body)
"""


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP7_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(spark, table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(spark, table(spark, sf_dir, "documents"), PackingParams(public_tokenizers.path("word_bpe_49k.json")))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "archive")
    write_warc(spark, table(spark, sf_dir, "pages"), scratch.root)
    return read_warc(spark, scratch.root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha256(html) AS digest FROM p),
g AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM g
"""


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark, table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
led AS (SELECT lang, unnest(w) AS w1, unnest(list_append(w[2:], NULL)) AS w2, unnest(w[3:] || [NULL, NULL]) AS w3 FROM p WHERE len(w) > 0),
windows AS MATERIALIZED (SELECT lang || ' ' || w1 AS k1, w2, w3, count(*) AS f FROM led WHERE w1 IS NOT NULL GROUP BY ALL),
f1 AS MATERIALIZED (SELECT k1 AS k, sum(f) AS f FROM windows GROUP BY k1),
f2 AS MATERIALIZED (SELECT k1 || ' ' || w2 AS k, sum(f) AS f FROM windows WHERE w2 IS NOT NULL GROUP BY ALL HAVING sum(f) >= 10),
f3 AS MATERIALIZED (SELECT k1 || ' ' || w2 || ' ' || w3 AS k, f::HUGEINT AS f FROM windows WHERE w3 IS NOT NULL AND f >= 10),
t AS (SELECT k, f, string_split(k, ' ') AS w FROM f2 UNION ALL SELECT k, f, string_split(k, ' ') FROM f3),
c AS (SELECT *, w[1] AS lang, len(w) - 1 AS words, array_to_string(w[2:], ' ') AS phrase FROM t),
sides AS (SELECT lang, phrase, f AS a, words, i AS cut, array_to_string(w[:i + 1], ' ') AS kl, lang || ' ' || array_to_string(w[i + 2:], ' ') AS kr FROM c, (VALUES (1), (2)) v(i) WHERE i < words),
known AS MATERIALIZED (SELECT * FROM f1 UNION ALL SELECT * FROM f2),
s AS (SELECT sides.*, x.f AS l, y.f AS r, 1000000 * a * a // (x.f * y.f) AS score FROM sides LEFT JOIN known x ON x.k = kl LEFT JOIN known y ON y.k = kr),
one AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (SELECT lang, phrase, max(f) AS most FROM (SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, f FROM c, (VALUES (2), (3)) v(i) WHERE words = 3) GROUP BY ALL),
ranked AS (SELECT one.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM one LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR 100 * most < 50 * a),
n AS (SELECT split_part(k, ' ', 1) AS lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY ALL)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
sizes AS (SELECT count(*) AS c, CAST(sum(len(t)) AS BIGINT) AS total FROM d WHERE len(t) > 0),
asked AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark),
words AS (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d),
postings AS (SELECT doc_id, term, n, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * c + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), sizes),
parts AS (SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * c) // total)) AS part FROM postings, sizes),
scores AS (SELECT item_id, doc_id, CAST(sum(w * part) AS BIGINT) AS score FROM asked JOIN weights USING (term) JOIN parts USING (term) GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark, table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(concat_ws(':', 'mix', CAST(doc_id AS VARCHAR))) AS turn FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place, 2 * source_size AS most FROM s),
m AS (SELECT *, [5, 2, 1][(place - 1) % 3 + 1] AS weight FROM p),
f AS (SELECT *, 3 * sum(source_size) OVER () // 2 AS budget, sum(most) OVER w AS filled, sum(weight) OVER () - sum(weight) OVER w + weight AS others FROM m WINDOW w AS (ORDER BY most / weight, place)),
g AS (SELECT *, most * others <= (budget - filled + most) * weight AS is_full FROM f),
h AS (SELECT coalesce(sum(most) FILTER (WHERE is_full), 0) AS held, sum(weight) FILTER (WHERE NOT is_full) AS rest FROM g),
t AS (SELECT source, place, source_size, budget, CASE WHEN is_full THEN CAST(most AS DOUBLE) ELSE CAST(weight * (budget - held) AS DOUBLE) / CAST(rest AS DOUBLE) END AS target FROM g, h),
q AS (SELECT doc_id, size, turn, place, source_size, budget, target, sum(size) OVER (PARTITION BY place ORDER BY turn, doc_id) AS ended FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CAST(ended + epoch * source_size AS DOUBLE) / target AS finish FROM q, (VALUES (0), (1)) e(epoch) WHERE size > 0),
r AS (SELECT *, sum(size) OVER (ORDER BY finish, place, epoch, turn, doc_id) AS through FROM c),
x AS (SELECT doc_id, sum(CASE WHEN through <= budget THEN size WHEN through - size < budget THEN budget - through + size ELSE 0 END) AS taken FROM r GROUP BY doc_id)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM q LEFT JOIN x USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_html_extraction": op2_html_extraction,
        "op3_byte_bpe": op3_byte_bpe,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_pii_pseudonyms": op5_pii_pseudonyms,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_topk_search": op7_topk_search,
        "op8_order_minhash": op8_order_minhash,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_warc": op10_warc,
        "op11_collocations": op11_collocations,
        "op12_ranked_search": op12_ranked_search,
        "op13_source_mixing": op13_source_mixing,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    found = {
        "op6_exact_dedup": OP6_SQL,
        "op7_topk_search": OP7_SQL,
        "op10_warc": OP10_SQL,
        "op11_collocations": OP11_SQL,
        "op12_ranked_search": OP12_SQL,
        "op13_source_mixing": OP13_SQL,
    }
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})

"""The queries of this subpackage and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import page_of, round_trip

    found = round_trip(_table(spark, sf_dir, "pages")).where("gap is null")
    return found.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to"))


OP2_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS x, min(page_id) OVER (PARTITION BY sha1(b)) AS first FROM p),
c AS (SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (CAST('0x' || x[1 + 5 * (k // 4):5 + 5 * (k // 4)] AS INTEGER) >> (15 - 5 * (k % 4))) % 32, 1), '' ORDER BY k) AS d
      FROM h, unnest(range(32)) AS t(k) GROUP BY page_id)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM h JOIN c USING (page_id)
"""


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_components

    found = simhash_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import find_contamination

    found = find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["to"] - s["from"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


#: Words of a text: A-Z lower-cased, split at all ASCII but letters and digits.
_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4_SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS gram
  FROM b, unnest(range(1, greatest(len(w) - 8, 2))) AS t(i) WHERE len(w) > 0),
g AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM d, (SELECT DISTINCT n FROM win) AS k, unnest(range(1, greatest(len(w) - n + 2, 1))) AS t(i)),
hit AS (SELECT doc_id, i, n, item_id FROM g JOIN win USING (n, gram)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op5_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import hilbert_shards

    text = F.coalesce(F.col("text"), F.lit(""))
    carry = {"size": F.octet_length(text).cast("bigint") + 1, "text_crc32": F.crc32(text.cast("binary"))}
    placed = hilbert_shards(_table(spark, sf_dir, "documents"), ["lang", "source", "n_chars", "doc_id"], carry=carry)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit_toxicity, score_toxicity

    docs = _table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, _table(spark, sf_dir, "labels"))
    held = F.expr("crc32(cast(doc_id as string)) % 4 = 2")
    return score_toxicity(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit_quality, score_quality

    docs = _table(spark, sf_dir, "documents")
    model = fit_quality(docs, _table(spark, sf_dir, "labels"))
    held = F.expr("crc32(cast(doc_id as string)) % 5 = 0")
    return score_quality(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .multi_index import embedding_links

    return embedding_links(_table(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.9),
reach AS (SELECT vec_id, vec_id AS other FROM v UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.other),
component AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM component LEFT JOIN counted USING (vec_id)
"""


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import main_text

    return main_text(_table(spark, sf_dir, "pages"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    return dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


OP10_SQL = r"""
WITH l AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
full_lines AS (
  SELECT doc_id, i, x[i] AS line FROM l, unnest(range(1, len(x) + 1)) AS t(i)
  WHERE trim(x[i], ' ' || chr(9) || chr(13)) <> ''),
c AS (SELECT doc_id, list(line ORDER BY i) AS line, list(i ORDER BY i) AS ix FROM full_lines GROUP BY doc_id),
w AS (
  SELECT doc_id, p, line[p:p + 2] AS win, ix[p:p + 2] AS ix FROM c, unnest(range(1, greatest(len(line) - 1, 2))) AS t(p)),
ranked AS (
  SELECT *, first_value(doc_id) OVER f AS d0, first_value(p) OVER f AS p0
  FROM w WINDOW f AS (PARTITION BY win ORDER BY doc_id, p)),
gone AS (
  SELECT DISTINCT doc_id, i
  FROM (SELECT *, CASE WHEN doc_id = d0 THEN p - p0 ELSE 3 END AS ahead FROM ranked) AS r,
       unnest(range(ix[1 + greatest(3 - ahead, 0)], ix[len(ix)] + 1)) AS t(i)
  WHERE ahead > 0),
kept AS (
  SELECT doc_id, string_agg(x[i], chr(10) ORDER BY i) AS text,
         count(*) FILTER (trim(x[i], ' ' || chr(9) || chr(13)) <> '') AS n
  FROM (SELECT doc_id, x, i FROM l, unnest(range(1, len(x) + 1)) AS t(i)) AS e ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT l.doc_id, CAST(coalesce(len(c.line), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(c.line), 0) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       CASE WHEN coalesce(kept.n, 0) = 0 AND coalesce(len(c.line), 0) > 0 THEN '' ELSE coalesce(kept.text, '') END AS text
FROM l LEFT JOIN c USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_warc": op2_warc,
        "op3_simhash": op3_simhash,
        "op4_decontamination": op4_decontamination,
        "op5_hilbert_sharding": op5_hilbert_sharding,
        "op6_toxicity": op6_toxicity,
        "op7_quality": op7_quality,
        "op8_multi_index": op8_multi_index,
        "op9_html_extraction": op9_html_extraction,
        "op10_line_dedup": op10_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2_SQL, "op4_decontamination": OP4_SQL, "op8_multi_index": OP8_SQL, "op10_line_dedup": OP10_SQL}

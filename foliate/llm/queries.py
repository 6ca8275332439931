"""The queries of this folder, over whole tables with production parameters, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import spread
from ..sources.tables import table
from . import near_duplicates, packing, pairs, quality, scan_noise, site_lines, splitting, tokens, truncation

CONTAINER_TOKENS = 2048


def _similar(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "retrieved_chunks").select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("id"), "text")
    reasons = table(spark, folder, "context_exclusions").select(F.lit("exclusion").alias("kind"), F.col("exclusion_id").alias("id"), F.col("reason").alias("text"))
    return chunks.unionByName(reasons)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.similar_records(_similar(spark, folder)).select(F.col("kind").alias("record_kind"), "id_a", "id_b")


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.groups(_similar(spark, folder))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.find_defects(table(spark, folder, "question_responses"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    blocks, catalog = table(spark, folder, "document_blocks"), table(spark, folder, "document_catalog")
    return site_lines.find_repeated(blocks, catalog).select("document_id", "block_id", "line_no")


def p3_lines(spark: SparkSession, folder: str) -> DataFrame:
    blocks, catalog = table(spark, folder, "document_blocks"), table(spark, folder, "document_catalog")
    return site_lines.repeated_words(blocks, catalog)


def p3_clean(spark: SparkSession, folder: str) -> DataFrame:
    blocks, catalog = table(spark, folder, "document_blocks"), table(spark, folder, "document_catalog")
    return site_lines.remove_repeated(blocks, catalog)


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    names = ("document_sections", "document_blocks", "parsed_tables", "retrieved_chunks")
    return splitting.split_oversized(*(table(spark, folder, name) for name in names))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    # An item above the limit has a second piece, one within it has none.
    return _pieces(spark, folder).where("piece_no = 1").select("item_kind", "document_id", "item_id")


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder)


def p6_repaired(spark: SparkSession, folder: str) -> DataFrame:
    blocks = table(spark, folder, "document_blocks").select("document_id", "block_id", "page_number", "text")
    tables = table(spark, folder, "parsed_tables").select("document_id", "table_id", "page_number", "page_numbers", "cells", "native_text")
    return scan_noise.repair_records(spread(blocks), spread(tables))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = p6_repaired(spark, folder)
    return rows.select(F.col("kind").alias("record_kind"), "document_id", "record_id", F.explode("noise").alias("noise_kind")).distinct()


def _truncated(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.find_truncated(table(spark, folder, "generation_diagnostics"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _truncated(spark, folder).where("truncated").select("request_id")


def p7_rates(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncation_rates(_truncated(spark, folder))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_texts(spread(table(spark, folder, "documents").select("doc_id", "text")))


def p9_containers(spark: SparkSession, folder: str) -> DataFrame:
    counted = tokens.count_tokens(spread(table(spark, folder, "documents").select("doc_id", "text")))
    return packing.fill_containers(counted, CONTAINER_TOKENS)


def p10_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.assess(spread(table(spark, folder, "documents").select("doc_id", "text", "lang")))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return p10_quality(spark, folder).where("kind != 'prose'").select("doc_id", "kind")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_groups, p2_found, p3_found, p3_lines, p3_clean, p5_found, p5_pieces, p6_found, p6_repaired, p7_found, p7_rates, p8_ids, p9_containers, p10_found, p10_quality)}


#: One row per id, as deliveries are repeated.
_BLOCKS = "(SELECT DISTINCT document_id, block_id, text FROM document_blocks)"
_LINES = f"""(SELECT b.document_id, b.block_id, line_no, collection, trim(regexp_replace(lower(lines[line_no]), '[^a-z]+', ' ', 'g')) AS words
  FROM (SELECT document_id, block_id, string_split(text, chr(10)) AS lines, unnest(generate_series(1, len(string_split(text, chr(10)))))::INT AS line_no FROM {_BLOCKS} WHERE text IS NOT NULL) b
  JOIN (SELECT DISTINCT document_id, collection FROM document_catalog WHERE collection IS NOT NULL) c USING (document_id))"""
_REPEATED = f"""(SELECT l.collection, l.words, count(DISTINCT l.document_id) AS documents FROM {_LINES} l JOIN (SELECT collection, count(*) AS n FROM document_catalog GROUP BY 1) s USING (collection)
  WHERE len(string_split(l.words, ' ')) >= 3 GROUP BY l.collection, l.words, s.n HAVING count(DISTINCT l.document_id) >= 5 AND count(DISTINCT l.document_id) * 10 >= s.n)"""
_TRIM = "' ' || chr(9) || chr(10)"
_SECTION_SIZES = f"""(SELECT r.document_id, r.section_id, sum(length(p.text)) + 2 * (count(*) - 1) AS size FROM (
    SELECT DISTINCT document_id, section_id, 0 AS kind, unnest(blocks) AS part FROM document_sections UNION ALL SELECT DISTINCT document_id, section_id, 1, unnest(tables) FROM document_sections) r
  JOIN (SELECT DISTINCT document_id, 0 AS kind, block_id AS part, trim(text, {_TRIM}) AS text FROM document_blocks UNION ALL SELECT DISTINCT document_id, 1, table_id, trim(native_text, {_TRIM}) FROM parsed_tables) p USING (document_id, kind, part)
  WHERE length(p.text) > 0 GROUP BY 1, 2)"""

_WORDS = """SELECT DISTINCT kind, id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM (SELECT 'chunk' AS kind, chunk_id AS id, text FROM retrieved_chunks UNION ALL SELECT 'exclusion', exclusion_id, reason FROM context_exclusions) WHERE text IS NOT NULL"""
_ALIKE = f"""WITH RECURSIVE m AS (SELECT kind, id, array_to_string(ws, ' ') AS words, ws FROM ({_WORDS}) WHERE len(ws) >= {near_duplicates.LEAST_WORDS}),
  e AS (SELECT kind, words, g, row_number() OVER (PARTITION BY kind, words, g) AS k FROM (SELECT kind, words, ws[i] || ' ' || ws[i + 1] AS g FROM (SELECT DISTINCT kind, words, ws, unnest(generate_series(1, len(ws) - 1)) AS i FROM m))),
  n AS (SELECT kind, words, count(*) AS n FROM e GROUP BY 1, 2),
  p AS (SELECT c.kind, c.a, c.b FROM (SELECT a.kind, a.words AS a, b.words AS b, count(*) AS c FROM e a JOIN e b USING (kind, g, k) WHERE a.words <> b.words GROUP BY 1, 2, 3) c
    JOIN n x ON x.kind = c.kind AND x.words = c.a JOIN n y ON y.kind = c.kind AND y.words = c.b WHERE c.c >= ceil({near_duplicates.LIKENESS} * greatest(x.n, y.n) - 1e-9))"""


def oracle_sql() -> dict[str, str]:
    """SQL for what SQL can express over whole tables; the others are tested against brute force or round trips."""
    return {
        "p1_found": _ALIKE + """ SELECT DISTINCT kind AS record_kind, id_a, id_b FROM (SELECT x.kind, x.id AS id_a, y.id AS id_b FROM m x JOIN m y ON y.kind = x.kind AND y.words = x.words
          UNION ALL SELECT x.kind, x.id, y.id FROM p JOIN m x ON x.kind = p.kind AND x.words = p.a JOIN m y ON y.kind = p.kind AND y.words = p.b) WHERE id_a < id_b""",
        "p1_groups": _ALIKE + """, r(kind, words, other) AS (SELECT kind, words, words FROM n UNION SELECT r.kind, r.words, p.b FROM r JOIN p ON p.kind = r.kind AND p.a = r.other),
          g AS (SELECT r.kind, r.words, min(m.id) AS least FROM r JOIN m ON m.kind = r.kind AND m.words = r.other GROUP BY 1, 2)
          SELECT m.kind, m.id, g.least AS "group", (SELECT count(*) FROM p WHERE p.kind = m.kind AND p.a = m.words) AS links, (SELECT count(*) FROM m o WHERE o.kind = m.kind AND o.words = m.words) AS copies FROM m JOIN g ON g.kind = m.kind AND g.words = m.words""",
        "p3_found": f"SELECT DISTINCT document_id, block_id, line_no FROM {_LINES} JOIN {_REPEATED} USING (collection, words)",
        "p3_lines": f"SELECT collection, words, documents FROM {_REPEATED}",
        "p3_clean": f"""SELECT b.document_id, b.block_id, CASE WHEN d.drop_lines IS NULL THEN b.text ELSE array_to_string(list_filter(string_split(b.text, chr(10)), lambda x, i: NOT list_contains(d.drop_lines, i)), chr(10)) END AS clean_text, coalesce(len(d.drop_lines), 0)::INT AS lines_removed
          FROM {_BLOCKS} b LEFT JOIN (SELECT document_id, block_id, list(DISTINCT line_no) AS drop_lines FROM {_LINES} JOIN {_REPEATED} USING (collection, words) GROUP BY 1, 2) d USING (document_id, block_id)""",
        "p5_found": f"""SELECT 'section' AS item_kind, document_id, section_id AS item_id FROM {_SECTION_SIZES} WHERE size > {splitting.LIMIT}
          UNION ALL SELECT DISTINCT 'chunk', document_id, chunk_id FROM retrieved_chunks WHERE length(trim(text, {_TRIM})) > {splitting.LIMIT}""",
    }

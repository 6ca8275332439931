"""SQL that gives the same rows as the queries of the same name."""

from __future__ import annotations

from ..functions.text import SPACE
from ..operators.lexical import STOP_WORDS

#: One row per id, as deliveries are repeated.
BLOCKS = "(SELECT * FROM (SELECT document_id, block_id, page_number, text, block_type, reading_order_index, bounding_box, row_number() OVER (PARTITION BY document_id, block_id ORDER BY ingested_at) AS delivery FROM document_blocks) WHERE delivery = 1)"
TABLES = "(SELECT DISTINCT document_id, table_id, page_number, page_numbers, reading_order_index, cells, native_text, native_text_coverage FROM parsed_tables)"
CELLS = f"""(SELECT document_id, table_id, cell_id, row_index, column_index, text, is_header, pos FROM (
  SELECT document_id, table_id, c.cell_id AS cell_id, c.row_index AS row_index, c.column_index AS column_index, c.text AS text, c.is_header AS is_header, pos,
    row_number() OVER (PARTITION BY document_id, table_id, c.cell_id ORDER BY pos) AS r
  FROM (SELECT document_id, table_id, unnest(cells) AS c, generate_subscripts(cells, 1) AS pos FROM {TABLES})) WHERE r = 1)"""
RANKED = "(SELECT DISTINCT request_id AS query_id, rank, chunk_id, document_id, section_path, content_type, text, page_start, page_end, quality_notes, source_block_ids, source_table_ids FROM retrieved_chunks)"
QUESTIONS = "(SELECT DISTINCT request_id AS query_id, document_id, question, answer_text, cited_evidence_ids, insufficient_evidence FROM question_responses)"
_SPACE = SPACE.replace("'", "''")
LAST = 10**9


def _blank(c: str) -> str:
    return f"({c} IS NULL OR length(regexp_replace({c}, '{_SPACE}+', '', 'g')) = 0)"


def _collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, '{_SPACE}+', ' ', 'g'))"


def _preview(c: str, limit: int = 300) -> str:
    return f"CASE WHEN length({_collapse(c)}) > {limit} THEN substr({_collapse(c)}, 1, {limit}) || '...' ELSE {_collapse(c)} END"


def _excerpt(c: str, limit: int = 240) -> str:
    return f"CASE WHEN length({_collapse(c)}) > {limit} THEN rtrim(substr({_collapse(c)}, 1, {limit - 3})) || '...' ELSE {_collapse(c)} END"


ORDER = f"coalesce(nullif(page_number, 0), {LAST}), coalesce(reading_order_index, {LAST})"
PAGES = f"""(SELECT p.document_id, p.page_number, coalesce(b.n, 0) AS blocks, coalesce(t.n, 0) AS tables
  FROM (SELECT document_id, unnest(generate_series(1, page_count))::INT AS page_number FROM document_catalog WHERE page_count > 0) p
  LEFT JOIN (SELECT document_id, page_number, count(*) AS n FROM {BLOCKS} GROUP BY ALL) b USING (document_id, page_number)
  LEFT JOIN (SELECT document_id, page_number, count(*) AS n FROM {TABLES} GROUP BY ALL) t USING (document_id, page_number))"""
HEADINGS = f"""(SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY {ORDER}, block_id) AS pos, trim(text) AS title, page_number, block_id,
  regexp_extract(trim(text), '^([0-9]+(?:\\.[0-9]+)+)\\.?[ \\t]+\\S', 1) AS nested, regexp_extract(trim(text), '^([0-9]+)[.)][ \\t]*\\S', 1) AS top
  FROM {BLOCKS} WHERE block_type = 'section_header')"""
LEVELED = f"(SELECT *, CASE WHEN nested <> '' THEN len(string_split(nested, '.')) ELSE 1 END AS level, (nested <> '' OR top <> '') AS numbered FROM {HEADINGS})"
TREE = """WITH RECURSIVE up(document_id, section_id, ancestor, distance) AS (
  SELECT document_id, section_id, section_id, 0 FROM document_sections
  UNION ALL
  SELECT up.document_id, up.section_id, s.parent_section_id, up.distance + 1 FROM up JOIN document_sections s ON s.document_id = up.document_id AND s.section_id = up.ancestor WHERE s.parent_section_id IS NOT NULL)"""
LISTED = "(SELECT document_id, section_id, unnest(blocks) AS block_id FROM document_sections)"
STORED = "(SELECT document_id, chunk_id, CASE WHEN ('0x' || right(chunk_id, 1))::INT % 4 = 0 THEN 'old' ELSE '1' END AS rev FROM (SELECT DISTINCT document_id, chunk_id FROM retrieved_chunks))"
SUMMARY = f"(SELECT document_id, count(*) AS total, count(*) FILTER (rev = '1') AS compatible FROM {STORED} GROUP BY 1)"
NEW = "(SELECT source AS document_id, doc_id AS chunk_id, sha256(coalesce(text, '')) AS h FROM documents WHERE source IS NOT NULL AND doc_id % 7 <> 0)"
OLD = "(SELECT source AS document_id, doc_id AS chunk_id, sha256(coalesce(text, '') || CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE '' END) AS h FROM documents WHERE source IS NOT NULL AND doc_id % 3 <> 0)"
PLAN = f"""(SELECT coalesce(n.document_id, o.document_id) AS document_id, coalesce(n.chunk_id, o.chunk_id) AS chunk_id,
  CASE WHEN o.chunk_id IS NULL THEN 'insert' WHEN n.chunk_id IS NULL THEN 'delete' WHEN n.h = o.h THEN 'refresh' ELSE 'update' END AS action
  FROM {NEW} n FULL OUTER JOIN (SELECT * FROM {OLD} WHERE document_id IN (SELECT document_id FROM {NEW})) o ON n.chunk_id = o.chunk_id)"""


def _near(scoped: bool | str) -> str:
    same = scoped if isinstance(scoped, str) else " AND v.label = q.label" if scoped else ""
    return f"""(SELECT q.vec_id AS query_id, v.vec_id AS vec_id, round(list_cosine_distance(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) + 0.0 AS cosine_distance
  FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0{same})"""


def _topk(scoped: bool | str, k: int) -> str:
    return f"(SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY cosine_distance, vec_id) AS rank, vec_id, cosine_distance, round(1 - cosine_distance, 6) AS similarity FROM {_near(scoped)}) WHERE rank <= {k})"


RENDERED = """'[E' || ordinal || ']' || chr(10) || 'Document: ' || document_id || chr(10) || 'Section: ' || CASE WHEN len(section_path) > 0 THEN array_to_string(section_path, ' > ') ELSE 'NONE' END
  || chr(10) || 'Pages: ' || CASE WHEN page_start = page_end THEN page_start::VARCHAR ELSE page_start || '-' || page_end END || chr(10) || 'Content type: ' || content_type || chr(10) || 'Chunk ID: ' || chunk_id
  || CASE WHEN len(quality_notes) > 0 THEN chr(10) || 'Quality notes: ' || array_to_string(quality_notes, '; ') ELSE '' END || chr(10) || chr(10) || text"""
CLASSED = f"""(SELECT *, sum(CASE WHEN state = 'candidate' THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS ordinal FROM (
  SELECT *, CASE WHEN {_blank("text")} THEN 'empty' WHEN row_number() OVER (PARTITION BY query_id, {_blank("text")}, chunk_id ORDER BY rank) > 1 THEN 'duplicate' ELSE 'candidate' END AS state FROM {RANKED}))"""
PACKED = f"""(SELECT *, sum(length(rendered)) OVER (PARTITION BY query_id ORDER BY ordinal) + 2 * (ordinal - 1) AS used FROM (SELECT *, {RENDERED} AS rendered FROM {CLASSED} WHERE state = 'candidate'))"""
EVIDENCE = f"(SELECT query_id, 'E' || ordinal AS evidence_id, chunk_id FROM {CLASSED} WHERE state = 'candidate')"
GROUPS = "regexp_extract_all(coalesce(answer_text, ''), '\\[([^\\[\\]]*)\\]', 1)"
WELL_FORMED = "'^\\s*E[1-9][0-9]*(?:\\s*,\\s*E[1-9][0-9]*)*\\s*$'"
INLINE_ALL = f"flatten(list_transform(list_filter({GROUPS}, lambda g: regexp_matches(g, {WELL_FORMED})), lambda g: regexp_extract_all(g, '(E[0-9]+)', 1)))"
MALFORMED = f"len(list_filter({GROUPS}, lambda g: regexp_matches(g, '(?i)^\\s*(?:E|SOURCE)[0-9]') AND NOT regexp_matches(g, {WELL_FORMED})))"


def _distinct(items: str) -> str:
    """Distinct values in order of first occurrence."""
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


PARSED = f"(SELECT query_id, {INLINE_ALL} AS all_ids, {MALFORMED} AS malformed, coalesce(cited_evidence_ids, []) AS all_cited, coalesce(insufficient_evidence, false) AS insufficient FROM {QUESTIONS})"
CITED = f"""(SELECT query_id, unnest(ids) AS evidence_id, generate_subscripts(ids, 1) - 1 AS position FROM (SELECT query_id, {_distinct("all_cited")} AS ids FROM {PARSED}))"""
LOCATORS = f"""(SELECT DISTINCT c.query_id, e.chunk_id AS cited_chunk, r.document_id, c.evidence_id AS fact_id, r.section_path, r.page_start AS page, substr(r.text, 1, 60) AS anchor
  FROM {CITED} c JOIN {EVIDENCE} e USING (query_id, evidence_id) JOIN {RANKED} r ON r.query_id = c.query_id AND r.chunk_id = e.chunk_id)"""


def _fact_ranks(rank: str, ranked: str = RANKED) -> str:
    return f"""(SELECT l.query_id, l.fact_id, min(r.rank) AS first_rank FROM {LOCATORS} l LEFT JOIN (SELECT * REPLACE ({rank} AS rank) FROM {ranked}) r
  ON r.query_id = l.query_id AND r.document_id = l.document_id AND (len(l.section_path) = 0 OR r.section_path = l.section_path) AND l.page BETWEEN r.page_start AND r.page_end AND contains({_collapse("r.text")}, {_collapse("l.anchor")})
  GROUP BY 1, 2)"""


def _coverage(ranks: str) -> str:
    parts = ", ".join(f"count(*) FILTER (first_rank <= {k}) AS covered_{k}, (count(*) FILTER (first_rank <= {k}) > 0)::INT AS any_{k}, (count(*) FILTER (first_rank <= {k}) = count(*))::INT AS full_{k}" for k in (1, 3, 5))
    return f"(SELECT query_id, count(*) AS facts, min(first_rank) AS first_relevant_rank, {parts} FROM {ranks} GROUP BY 1)"


COVERAGE = _coverage(_fact_ranks("rank"))
_PAGED = f"(SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY page_start, rank, chunk_id) AS rank) FROM {RANKED})"
_WITHOUT_FURNITURE = f"""(WITH h AS (SELECT *, CASE WHEN block_type IN ('page_header', 'section_header') THEN lower({_collapse("text")}) END AS sig FROM {BLOCKS} WHERE coalesce(block_type <> 'page_footer', true)),
  r AS (SELECT document_id, sig FROM h WHERE sig <> '' GROUP BY ALL HAVING count(DISTINCT page_number) >= 2 AND bool_or(block_type = 'page_header'))
  SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.document_id = h.document_id AND r.sig = h.sig))"""
_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _terms(c: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+'), lambda w: w NOT IN ({_STOPS})))"


ORACLES: dict[str, str] = {
    "intake_accept": """SELECT document_id, lower(regexp_extract(stored_filename, '(\\.[A-Za-z0-9]+)$', 1)) AS extension,
      CASE WHEN lower(regexp_extract(stored_filename, '(\\.[A-Za-z0-9]+)$', 1)) NOT IN ('.pdf', '.docx') THEN 'unsupported_type' WHEN size_bytes > 2000000 THEN 'too_large' WHEN size_bytes <= 0 THEN 'empty' END AS refusal FROM document_catalog""",
    "block_projection": f"SELECT document_id, block_id, page_number, coalesce(reading_order_index, 0) AS reading_order_index, block_type, sha256(text) AS text_hash, {_excerpt('text')} AS excerpt FROM {BLOCKS} WHERE NOT {_blank('text')} AND page_number IS NOT NULL",
    "semantic_blocks": f"""SELECT document_id, block_id FROM {BLOCKS} WHERE coalesce(block_type <> 'page_footer', true)
      AND NOT coalesce(block_type = 'text' AND upper(trim(text)) IN ('CONFIDENTIAL', 'DRAFT', 'INTERNAL') AND bounding_box.x0 >= 0 AND least(bounding_box.y0, bounding_box.y1) <= 1000, false)""",
    "repeated_headers": f"""WITH h AS (SELECT *, CASE WHEN block_type IN ('page_header', 'section_header') THEN lower({_collapse("text")}) END AS sig FROM {BLOCKS}),
      r AS (SELECT document_id, sig FROM h WHERE sig <> '' GROUP BY ALL HAVING count(DISTINCT page_number) >= 2 AND bool_or(block_type = 'page_header'))
      SELECT document_id, block_id FROM h WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.document_id = h.document_id AND r.sig = h.sig)""",
    "reading_order": f"""SELECT document_id, page_number, kind, item_id, (row_number() OVER (PARTITION BY document_id, page_number ORDER BY coalesce(reading_order_index, {LAST}), kind, item_id) - 1)::INT AS position FROM (
      SELECT document_id, page_number, 'block' AS kind, block_id AS item_id, reading_order_index FROM {BLOCKS} UNION ALL SELECT document_id, page_number, 'table', table_id, reading_order_index FROM {TABLES}) WHERE page_number IS NOT NULL""",
    "page_assembly": f"SELECT * FROM {PAGES}",
    "merge_status": """SELECT collection, CASE WHEN n > 0 AND s = n THEN 'success' WHEN n > 0 AND f = n THEN 'failed' ELSE 'partial_success' END AS status FROM (
      SELECT collection, count(*) FILTER (st NOT IN ('not_started', 'skipped')) AS n, count(*) FILTER (st = 'success') AS s, count(*) FILTER (st = 'failed') AS f FROM (SELECT collection, coalesce(parse_status, 'not_started') AS st FROM document_catalog) GROUP BY 1)""",
    "merged_blocks": f"SELECT document_id, block_id, page_number, (row_number() OVER (PARTITION BY document_id, page_number ORDER BY coalesce(reading_order_index, {LAST}), block_id) - 1)::INT AS position FROM {_WITHOUT_FURNITURE}",
    "merged_documents": f"""SELECT c.document_id, page_count::BIGINT AS page_count, coalesce(b.n, 0) AS blocks, coalesce(t.n, 0) AS tables, coalesce(b.h, 0)::BIGINT AS sections,
      CASE coalesce(parse_status, 'not_started') WHEN 'success' THEN 'success' WHEN 'failed' THEN 'failed' ELSE 'partial_success' END AS status, parser_name FROM document_catalog c
      LEFT JOIN (SELECT document_id, count(*) AS n, count(*) FILTER (block_type = 'section_header') AS h FROM {_WITHOUT_FURNITURE} GROUP BY 1) b USING (document_id)
      LEFT JOIN (SELECT document_id, count(*) AS n FROM {TABLES} GROUP BY 1) t USING (document_id) WHERE page_count > 0""",
    "reading_positions": "SELECT section, ref, max(position)::INT AS position FROM (SELECT document_id || '/' || section_id AS section, unnest(blocks) AS ref, generate_subscripts(blocks, 1) - 1 AS position FROM document_sections) WHERE ref IS NOT NULL GROUP BY 1, 2",
    "page_scoped_ids": f"SELECT document_id, block_id, 'page_' || page_number || '_' || block_id AS scoped_id FROM {BLOCKS}",
    "heading_levels": """SELECT document_id, section_id, CASE WHEN n <> '' THEN len(string_split(n, '.'))::INT ELSE 1 END AS heading_level FROM (
      SELECT document_id, section_id, regexp_extract(trim(title), '^([0-9]+(?:\\.[0-9]+)+)\\.?[ \\t]+\\S', 1) AS n FROM document_sections)""",
    "section_tree": f"""WITH h AS (SELECT * FROM {LEVELED})
      SELECT c.document_id, 'section-' || (c.pos - 1) AS section_id, (SELECT 'section-' || (max(p.pos) - 1) FROM h p WHERE p.document_id = c.document_id AND p.pos < c.pos AND p.numbered AND c.numbered AND p.level < c.level) AS parent_section_id, c.level::INT AS level FROM h c""",
    "active_section": f"""SELECT document_id, block_id, nullif(n, 0)::BIGINT AS section_pos FROM (
      SELECT document_id, block_id, block_type, sum(CASE WHEN block_type = 'section_header' THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY {ORDER}, block_id) AS n FROM {BLOCKS}) WHERE block_type <> 'section_header'""",
    "section_rollup": TREE + " SELECT up.document_id, up.ancestor AS section_id, max(greatest(s.page_start, s.page_end)) AS page_end FROM up JOIN document_sections s USING (document_id, section_id) GROUP BY 1, 2",
    "section_paths": TREE + " SELECT up.document_id, up.section_id, max(distance)::INT AS depth, string_agg(s.title, ' > ' ORDER BY distance DESC) AS path FROM up JOIN document_sections s ON s.document_id = up.document_id AND s.section_id = up.ancestor GROUP BY 1, 2",
    "unsectioned_blocks": f"SELECT document_id, block_id FROM {BLOCKS} b WHERE NOT EXISTS (SELECT 1 FROM {LISTED} l WHERE l.document_id = b.document_id AND l.block_id = b.block_id) AND NOT EXISTS (SELECT 1 FROM document_sections s WHERE s.document_id = b.document_id AND s.heading_block_id = b.block_id)",
    "block_membership": f"SELECT document_id, block_id, arg_min(section_id, regexp_extract(section_id, '([0-9]+)$', 1)::INT) AS section_id FROM {LISTED} GROUP BY 1, 2",
    "cell_dedup": f"SELECT document_id, table_id, cell_id, row_index, column_index, text FROM {CELLS}",
    "table_render": f"""SELECT document_id, table_id, count(*) AS rows, string_agg(line, chr(10) ORDER BY row_index) AS rendered FROM (
      SELECT g.document_id, g.table_id, g.row_index, string_agg(coalesce({_collapse("c.text")}, ''), ' | ' ORDER BY g.column_index) AS line FROM (
        SELECT r.document_id, r.table_id, r.row_index, unnest(generate_series(0, m.last)) AS column_index FROM (SELECT DISTINCT document_id, table_id, row_index FROM {CELLS}) r
        JOIN (SELECT document_id, table_id, max(column_index) AS last FROM {CELLS} GROUP BY 1, 2) m USING (document_id, table_id)) g
      LEFT JOIN {CELLS} c USING (document_id, table_id, row_index, column_index) GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    "table_markdown": f"""WITH g AS (SELECT g.document_id, g.table_id, g.row_index, g.column_index, replace(coalesce({_collapse("c.text")}, ''), '|', chr(92) || '|') AS text FROM (
        SELECT r.document_id, r.table_id, r.row_index, unnest(generate_series(0, m.last)) AS column_index FROM (SELECT DISTINCT document_id, table_id, row_index FROM {CELLS}) r
        JOIN (SELECT document_id, table_id, max(column_index) AS last FROM {CELLS} GROUP BY 1, 2) m USING (document_id, table_id)) g LEFT JOIN {CELLS} c USING (document_id, table_id, row_index, column_index)),
      w AS (SELECT document_id, table_id, column_index, greatest(max(length(text)), 3)::INT AS width FROM g GROUP BY 1, 2, 3),
      r AS (SELECT document_id, table_id, row_index, '| ' || string_agg(rpad(text, width, ' '), ' | ' ORDER BY column_index) || ' |' AS line, '| ' || string_agg(repeat('-', width), ' | ' ORDER BY column_index) || ' |' AS rule FROM g JOIN w USING (document_id, table_id, column_index) GROUP BY 1, 2, 3),
      n AS (SELECT *, row_number() OVER (PARTITION BY document_id, table_id ORDER BY row_index) AS i FROM r)
      SELECT document_id, table_id, string_agg(CASE WHEN i = 1 THEN line || chr(10) || rule ELSE line END, chr(10) ORDER BY i) AS markdown FROM n GROUP BY 1, 2""",
    "token_coverage": f"""WITH s AS (SELECT document_id, table_id, token, count(*) AS n FROM (SELECT document_id, table_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9%]+')) AS token FROM {CELLS}) GROUP BY ALL),
      c AS (SELECT document_id, table_id, token, count(*) AS m FROM (SELECT document_id, table_id, unnest(regexp_extract_all(lower(coalesce(native_text, '')), '[a-z0-9%]+')) AS token FROM {TABLES}) GROUP BY ALL)
      SELECT t.document_id, t.table_id, round(coalesce(x.v, 1.0), 6) AS coverage FROM (SELECT DISTINCT document_id, table_id FROM {CELLS}) t
      LEFT JOIN (SELECT document_id, table_id, sum(least(n, coalesce(m, 0)))::DOUBLE / sum(n) AS v FROM s LEFT JOIN c USING (document_id, table_id, token) GROUP BY 1, 2) x USING (document_id, table_id)""",
    "split_fixed": """SELECT doc_id, piece_no, sha256(piece) AS piece_hash, length(piece)::INT AS characters FROM (
      SELECT doc_id, i::INT AS piece_no, substr(text, i::INT * 1000 + 1, 1000) AS piece FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(length(text) - 1, 0) // 1000)) AS i FROM documents WHERE text IS NOT NULL))""",
    "chunk_report": f"SELECT chunk_id, length(text)::INT AS characters, {_preview('text')} AS preview FROM (SELECT chunk_id, min(text) AS text FROM retrieved_chunks GROUP BY 1) WHERE text IS NOT NULL",
    "token_limit": "SELECT doc_id, coalesce(ceil(length(text) / 4.0) > 512, false) AS over_limit FROM documents",
    "input_problems": """SELECT chunk_id, 'repeated_id' AS problem FROM (SELECT DISTINCT document_id, chunk_id FROM retrieved_chunks) GROUP BY 1 HAVING count(*) > 1
      UNION ALL SELECT DISTINCT chunk_id, 'foreign_document' FROM retrieved_chunks WHERE document_id NOT IN (SELECT document_id FROM document_catalog WHERE parse_status = 'success')""",
    "catalog_get": "SELECT document_id, filename, collection, page_count FROM document_catalog WHERE document_id = (SELECT min(document_id) FROM document_catalog)",
    "parsed_json": """SELECT d.document_id, sha256(r.j) AS record_hash FROM (SELECT document_id FROM parsed_documents UNION SELECT document_id FROM document_catalog) d
      LEFT JOIN (SELECT document_id, parsed_document_json AS j FROM parsed_documents QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY received_at DESC, record_no DESC) = 1) r USING (document_id)""",
    "dense_space": f"SELECT * REPLACE (rank::INT AS rank) FROM {_topk(' AND v.label <> 0', 5)}",
    "rerank_comparison": f"""WITH d AS (SELECT query_id, vec_id, rank::INT AS rank, ((vec_id * 7919 + query_id * 104729) % 101)::DOUBLE AS score FROM {_topk(False, 40)}), r AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, vec_id)::INT AS rank FROM d),
      g AS (SELECT q.vec_id AS query_id, m.least FROM embeddings q JOIN (SELECT label, min(vec_id) AS least FROM embeddings GROUP BY 1) m USING (label) WHERE q.vec_id % 20 = 0)
      SELECT g.query_id, d.rank AS dense_rank, r.rank AS reranked_rank, CASE WHEN d.rank > r.rank THEN 'up' WHEN d.rank < r.rank THEN 'down' WHEN d.rank IS NOT NULL THEN 'same' END AS moved
      FROM g LEFT JOIN d ON d.query_id = g.query_id AND d.vec_id = g.least LEFT JOIN r ON r.query_id = g.query_id AND r.vec_id = g.least""",
    "search_report": f"""SELECT request_id AS query_id, rank, rank || '. ' || printf('%.6f', similarity) || ' | ' || CASE WHEN len(section_path) > 0 THEN array_to_string(section_path, ' > ') ELSE '-' END || ' | ' || {_preview("coalesce(text, '')")} AS line
      FROM (SELECT DISTINCT * EXCLUDE (retrieved_at) FROM retrieved_chunks)""",
    "content_hash": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "vector_validation": "SELECT vec_id, coalesce(len(embedding) = 64 AND abs(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) <= 0.001, false) AS valid FROM embeddings",
    "sync_plan": f"SELECT * FROM {PLAN}",
    "sync_counts": f"SELECT document_id, count(*) FILTER (action = 'insert') AS inserted, count(*) FILTER (action = 'update') AS updated, count(*) FILTER (action = 'refresh') AS refreshed, count(*) FILTER (action = 'delete') AS deleted FROM {PLAN} GROUP BY 1",
    "index_summary": f"SELECT *, CASE WHEN total = compatible THEN 'ready' ELSE 'needs_reindex' END AS state FROM {SUMMARY}",
    "catalog_list": f"SELECT c.document_id, c.filename, c.parse_status, coalesce(total, 0) AS total, coalesce(compatible, 0) AS compatible, CASE WHEN total IS NULL THEN 'not_indexed' WHEN total = compatible THEN 'ready' ELSE 'needs_reindex' END AS state FROM document_catalog c LEFT JOIN {SUMMARY} s USING (document_id)",
    "question_gate": f"SELECT q.query_id, q.document_id, CASE WHEN c.document_id IS NULL THEN 'not_found' WHEN s.total IS NULL OR s.total <> s.compatible THEN 'not_ready' ELSE 'open' END AS gate FROM {QUESTIONS} q LEFT JOIN document_catalog c USING (document_id) LEFT JOIN {SUMMARY} s USING (document_id)",
    "ingestion_summary": f"""SELECT c.document_id, coalesce(c.page_count, 0) AS pages, coalesce(b.n, 0) AS blocks, coalesce(t.n, 0) AS tables, coalesce(e.n, 0) AS cells, coalesce(s.n, 0) AS sections FROM document_catalog c
      LEFT JOIN (SELECT document_id, count(*) AS n FROM {BLOCKS} GROUP BY 1) b USING (document_id) LEFT JOIN (SELECT document_id, count(*) AS n FROM {TABLES} GROUP BY 1) t USING (document_id)
      LEFT JOIN (SELECT document_id, count(*) AS n FROM {CELLS} GROUP BY 1) e USING (document_id) LEFT JOIN (SELECT document_id, count(*) AS n FROM document_sections WHERE parent_section_id IS NULL GROUP BY 1) s USING (document_id)""",
    "dense_topk": """SELECT row_number() OVER (ORDER BY cosine_distance, vec_id)::INT AS rank, vec_id, cosine_distance, round(1 - cosine_distance, 6) AS similarity FROM (
      SELECT v.vec_id, round(list_cosine_distance(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) + 0.0 AS cosine_distance FROM embeddings v, embeddings q WHERE q.vec_id = 0) ORDER BY cosine_distance, vec_id LIMIT 10""",
    "dense_topk_batch": f"SELECT * REPLACE (rank::INT AS rank) FROM {_topk(False, 5)}",
    "dense_filtered": f"SELECT * REPLACE (rank::INT AS rank) FROM {_topk(True, 5)}",
    "rrf_fusion": f"""SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM (
      SELECT query_id, vec_id, round(coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0), 9) AS score FROM {_topk(False, 20)} a FULL OUTER JOIN {_topk(True, 20)} b USING (query_id, vec_id))) WHERE rank <= 5""",
    "rerank_topk": f"""SELECT query_id, r::INT AS rank, vec_id, reranker_score, dense_rank::INT AS dense_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY reranker_score DESC, dense_rank, vec_id) AS r FROM (
      SELECT query_id, vec_id, rank AS dense_rank, ((vec_id * 7919 + query_id * 104729) % 101)::DOUBLE AS reranker_score FROM {_topk(False, 40)})) WHERE r <= 5""",
    "lexical_match": f"""WITH a AS (SELECT document_id, unnest({_terms("title")}) AS term FROM document_catalog WHERE title IS NOT NULL), n AS (SELECT document_id, count(*) AS terms FROM a GROUP BY 1),
      i AS (SELECT document_id, block_id, unnest({_terms("text")}) AS term FROM {BLOCKS} WHERE text IS NOT NULL)
      SELECT document_id AS query_id, document_id || '/' || block_id AS chunk_id, terms FROM (SELECT document_id, block_id, count(*) AS hits FROM a JOIN i USING (document_id, term) GROUP BY 1, 2) JOIN n USING (document_id) WHERE hits = terms""",
    "context_pack": f"SELECT query_id, 'E' || ordinal AS evidence_id, chunk_id, rank, length(rendered)::INT AS rendered_characters, used::INT AS used_characters FROM {PACKED} WHERE used <= 3000",
    "context_text": f"SELECT query_id, 'E' || ordinal AS evidence_id, sha256(rendered) AS rendered_hash FROM {PACKED} WHERE used <= 3000",
    "context_exclusion_report": f"""WITH p AS (SELECT * FROM {PACKED}), t AS (SELECT query_id, count(*) FILTER (used <= 3000) AS taken, coalesce(max(used) FILTER (used <= 3000), 0) AS total FROM p GROUP BY 1),
      o AS (SELECT query_id, rank, chunk_id, length({RENDERED}) AS n, taken, total FROM (SELECT p.* EXCLUDE (ordinal), t.taken, t.total, t.taken + 1 AS ordinal FROM p JOIN t USING (query_id) WHERE used > 3000))
      SELECT query_id, rank, chunk_id, 'budget_exceeded' AS reason, n::INT AS rendered_characters, (n + CASE WHEN taken > 0 THEN 2 ELSE 0 END)::INT AS required_characters, (3000 - total)::INT AS remaining_characters, n + CASE WHEN taken > 0 THEN 2 ELSE 0 END <= 3000 - total AS would_fit FROM o
      UNION ALL SELECT query_id, rank, chunk_id, state, NULL, NULL, NULL, NULL FROM {CLASSED} WHERE state <> 'candidate'""",
    "citation_parse": f"SELECT query_id, array_to_string({_distinct('all_ids')}, ',') AS inline_ids, malformed::INT AS malformed FROM {PARSED}",
    "citation_check": f"""SELECT p.query_id, CASE WHEN malformed > 0 THEN 'malformed' WHEN len(list_filter(list_concat(all_ids, all_cited), lambda x: NOT list_contains(coalesce(k.ids, []), x))) > 0 THEN 'unknown'
      WHEN {_distinct("all_ids")} <> {_distinct("all_cited")} THEN 'mismatch' WHEN NOT insufficient AND len(all_cited) = 0 THEN 'uncited' ELSE 'ok' END AS citation_status
      FROM {PARSED} p LEFT JOIN (SELECT query_id, list(evidence_id) AS ids FROM {EVIDENCE} GROUP BY 1) k USING (query_id)""",
    "citation_resolve": f"SELECT c.query_id, c.position::INT AS position, c.evidence_id, e.chunk_id FROM {CITED} c LEFT JOIN {EVIDENCE} e USING (query_id, evidence_id)",
    "fact_ranks": f"SELECT * FROM {_fact_ranks('rank')}",
    "fact_coverage": f"SELECT * FROM {COVERAGE}",
    "retrieval_metrics": f"""SELECT count(*) AS queries, {", ".join(f"round(avg(any_{k}), 6) AS any_evidence_{k}, round(avg(full_{k}), 6) AS full_coverage_{k}, round(avg(covered_{k}::DOUBLE / facts), 6) AS fact_coverage_{k}" for k in (1, 3, 5))},
      round(avg(CASE WHEN first_relevant_rank <= 5 THEN 1.0::DOUBLE / first_relevant_rank ELSE 0 END), 6) AS mrr FROM {COVERAGE}""",
    "strategy_compare": f"""SELECT query_id, a.first_relevant_rank AS base_rank, b.first_relevant_rank AS other_rank, CASE WHEN a.full_3 < b.full_3 THEN 'recovered' WHEN a.full_3 > b.full_3 THEN 'regressed' ELSE 'same' END AS change
      FROM {COVERAGE} a JOIN {_coverage(_fact_ranks("6 - rank"))} b USING (query_id)""",
    "strategy_matrix": f"""WITH a AS (SELECT * FROM {COVERAGE}), s AS (SELECT 'ranked' AS strategy, * FROM a UNION ALL SELECT 'turned', * FROM {_coverage(_fact_ranks("6 - rank"))} UNION ALL SELECT 'paged', * FROM {_coverage(_fact_ranks("rank", _PAGED))})
      SELECT s.query_id, s.strategy, s.first_relevant_rank, s.full_3 AS "full", CASE WHEN a.full_3 < s.full_3 THEN 'recovered' WHEN a.full_3 > s.full_3 THEN 'regressed' ELSE 'same' END AS change FROM s JOIN a USING (query_id)""",
    "label_ranks": f"""WITH l AS (SELECT DISTINCT c.query_id, c.evidence_id AS fact_id, r.document_id, CASE WHEN c.position % 2 = 0 THEN e.chunk_id END AS chunk, r.page_start AS page
        FROM {CITED} c JOIN {EVIDENCE} e USING (query_id, evidence_id) JOIN {RANKED} r ON r.query_id = c.query_id AND r.chunk_id = e.chunk_id)
      SELECT l.query_id, l.fact_id, min(r.rank) AS first_rank FROM l LEFT JOIN {RANKED} r ON r.query_id = l.query_id AND r.document_id = l.document_id AND CASE WHEN chunk IS NOT NULL THEN r.chunk_id = chunk ELSE l.page BETWEEN r.page_start AND r.page_end END GROUP BY 1, 2""",
    "evaluator": "SELECT * FROM " + _coverage(f"""(WITH q AS (SELECT DISTINCT query_id, document_id FROM {QUESTIONS}), r AS (SELECT r.* REPLACE (row_number() OVER (PARTITION BY r.query_id ORDER BY rank, chunk_id) AS rank) FROM {RANKED} r JOIN q ON q.query_id = r.query_id AND q.document_id = r.document_id)
      SELECT l.query_id, l.fact_id, min(r.rank) AS first_rank FROM {LOCATORS} l LEFT JOIN r ON r.query_id = l.query_id AND r.document_id = l.document_id AND (len(l.section_path) = 0 OR r.section_path = l.section_path) AND l.page BETWEEN r.page_start AND r.page_end AND contains({_collapse("r.text")}, {_collapse("l.anchor")})
      WHERE l.query_id IN (SELECT query_id FROM q) GROUP BY 1, 2)"""),
    "locator_audit": f"""WITH m AS (SELECT l.query_id, l.fact_id, count(DISTINCT c.chunk_id) AS matches FROM {LOCATORS} l LEFT JOIN (SELECT DISTINCT chunk_id, document_id, section_path, page_start, page_end, text FROM retrieved_chunks) c
        ON c.document_id = l.document_id AND (len(l.section_path) = 0 OR c.section_path = l.section_path) AND l.page BETWEEN c.page_start AND c.page_end AND contains({_collapse("c.text")}, {_collapse("l.anchor")}) GROUP BY 1, 2)
      SELECT query_id, fact_id, matches, CASE WHEN matches = 0 THEN 'zero' WHEN matches > 3 THEN 'unexpectedly_many' ELSE 'ok' END AS verdict FROM m""",
    "extraction_units": f"""SELECT b.document_id, b.block_id AS unit_id, CASE block_type WHEN 'section_header' THEN 'heading' WHEN 'list_item' THEN 'list_item' ELSE 'paragraph' END AS content_type, sha256({_collapse("text")}) AS text_hash, page_number, s.section_id
      FROM {BLOCKS} b LEFT JOIN (SELECT document_id, block_id, min(section_id) AS section_id FROM (SELECT document_id, section_id, unnest(list_append(blocks, heading_block_id)) AS block_id FROM document_sections WHERE parent_section_id IS NULL) GROUP BY 1, 2) s
      ON s.document_id = b.document_id AND s.block_id = b.block_id WHERE NOT {_blank("text")}""",
    "table_row_units": f"""WITH c AS (SELECT * REPLACE ({_collapse("coalesce(text, '')")} AS text) FROM {CELLS}),
      h AS (SELECT document_id, table_id, column_index, arg_max(text, pos) AS header FROM c WHERE is_header AND text <> '' GROUP BY 1, 2, 3)
      SELECT document_id, table_id || '-row-' || row_index AS unit_id, string_agg(CASE WHEN header IS NOT NULL AND NOT is_header THEN header || ': ' || text ELSE text END, ' | ' ORDER BY column_index) AS text, string_agg(cell_id, ',' ORDER BY column_index) AS cell_ids
      FROM c LEFT JOIN h USING (document_id, table_id, column_index) WHERE text <> '' AND (document_id, table_id) IN (SELECT (document_id, table_id) FROM {TABLES} WHERE page_number IS NOT NULL)
      GROUP BY document_id, table_id, row_index HAVING NOT bool_and(is_header)""",
    "markdown_lines": f"""WITH m AS (SELECT document_id, block_id, arg_min(section_id, regexp_extract(section_id, '([0-9]+)$', 1)::INT) AS section_id FROM {LISTED} GROUP BY 1, 2),
      r AS (SELECT b.document_id, b.block_id, block_type, page_number, reading_order_index, {_collapse("b.text")} AS text, s.title FROM {BLOCKS} b LEFT JOIN m ON m.document_id = b.document_id AND m.block_id = b.block_id
        LEFT JOIN document_sections s ON s.document_id = m.document_id AND s.section_id = m.section_id WHERE NOT {_blank("b.text")}),
      w AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY {ORDER}, block_id) AS pos, lag(page_number) OVER (PARTITION BY document_id ORDER BY {ORDER}, block_id) AS page_before,
        last_value(title IGNORE NULLS) OVER (PARTITION BY document_id, page_number ORDER BY {ORDER}, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS title_before FROM r)
      SELECT document_id, pos::INT AS pos, concat_ws(chr(10), CASE WHEN page_number IS DISTINCT FROM page_before THEN '<!-- page ' || page_number || ' -->' END, CASE WHEN title IS NOT NULL AND title IS DISTINCT FROM title_before THEN '## ' || title END,
        CASE WHEN block_type = 'list_item' THEN '- ' || text ELSE text END) AS line FROM w""",
    "unit_order": f"SELECT document_id, page_number, block_id AS unit_id, (row_number() OVER (PARTITION BY document_id, page_number ORDER BY coalesce(reading_order_index, 0), block_id) - 1)::INT AS position FROM {BLOCKS} WHERE NOT {_blank('text')}",
    "page_report": f"""SELECT document_id, page_number, '- Page ' || page_number || ': ' || coalesce(parse_status, 'not_started') || ', blocks=' || blocks || ', tables=' || tables AS line FROM {PAGES} JOIN document_catalog USING (document_id)""",
    "document_summary": f"""SELECT c.document_id, coalesce(page_count, 0) AS pages, coalesce(b.n, 0) AS blocks, coalesce(t.n, 0) AS tables, coalesce(e.n, 0) AS cells, coalesce(s.n, 0) AS sections, coalesce(p.n, 0) AS empty_pages,
        coalesce(b.twice, false) OR coalesce(t.twice, false) OR coalesce(s.twice, false) AS has_duplicate_ids, coalesce(b.lost, false) OR coalesce(t.lost, false) AS has_missing_provenance FROM document_catalog c
      LEFT JOIN (SELECT document_id, count(DISTINCT block_id) AS n, count(*) > count(DISTINCT block_id) AS twice, bool_or(page_number IS NULL) AS lost FROM document_blocks GROUP BY 1) b USING (document_id)
      LEFT JOIN (SELECT document_id, count(DISTINCT table_id) AS n, count(*) > count(DISTINCT table_id) AS twice, bool_or(page_number IS NULL) AS lost FROM parsed_tables GROUP BY 1) t USING (document_id)
      LEFT JOIN (SELECT document_id, count(*) AS n FROM {CELLS} GROUP BY 1) e USING (document_id) LEFT JOIN (SELECT document_id, count(DISTINCT section_id) AS n, count(*) > count(DISTINCT section_id) AS twice FROM document_sections GROUP BY 1) s USING (document_id)
      LEFT JOIN (SELECT document_id, count(*) AS n FROM {PAGES} WHERE blocks + tables = 0 GROUP BY 1) p USING (document_id)""",
    "structure_listing": TREE + """, d AS (SELECT document_id, section_id, max(distance) AS depth FROM up GROUP BY 1, 2)
      SELECT DISTINCT s.document_id, s.section_id, repeat('  ', depth::INT) || title || ' [pages ' || CASE WHEN coalesce(page_end, page_start) = page_start THEN page_start::VARCHAR ELSE page_start || '-' || page_end END || '; blocks ' || len(blocks) || '; tables ' || len(tables) || ']' AS line FROM document_sections s JOIN d USING (document_id, section_id)""",
    "duplicate_ids": """SELECT kind, document_id, id, count(*) AS rows FROM (SELECT 'block' AS kind, document_id, block_id AS id FROM document_blocks UNION ALL SELECT 'table', document_id, table_id FROM parsed_tables UNION ALL SELECT 'section', document_id, section_id FROM document_sections) WHERE id IS NOT NULL GROUP BY ALL HAVING count(*) > 1""",
    "missing_provenance": f"""SELECT * FROM (SELECT document_id, block_id, array_to_string(list_filter([CASE WHEN page_number IS NULL THEN 'page' END, CASE WHEN reading_order_index IS NULL THEN 'order' END, CASE WHEN bounding_box IS NULL THEN 'box' END], lambda x: x IS NOT NULL), ',') AS missing FROM {BLOCKS}) WHERE missing <> ''""",
    "empty_pages": f"SELECT document_id, page_number FROM {PAGES} WHERE blocks + tables = 0",
    "processing_summary": f"""SELECT collection, count(*) AS documents, count(*) FILTER (parse_status = 'failed') AS failed, coalesce(sum(page_count), 0)::BIGINT AS pages, coalesce(sum(b.n), 0)::BIGINT AS blocks, coalesce(sum(b.e), 0)::BIGINT AS blank_blocks, coalesce(sum(t.n), 0)::BIGINT AS tables FROM document_catalog
      LEFT JOIN (SELECT document_id, count(*) AS n, count(*) FILTER ({_blank("text")}) AS e FROM {BLOCKS} GROUP BY 1) b USING (document_id) LEFT JOIN (SELECT document_id, count(*) AS n FROM {TABLES} GROUP BY 1) t USING (document_id) GROUP BY 1""",
    "label_counts": f"SELECT block_type, count(*) AS blocks, count(*) FILTER (page_number IS NULL) AS without_page, count(*) FILTER (bounding_box IS NULL) AS without_box FROM {BLOCKS} GROUP BY 1",
    "requirement_ids": f"SELECT requirement_id, count(*) AS mentions FROM (SELECT unnest(regexp_extract_all(coalesce(text, ''), '\\b([A-Z][A-Z0-9]+(?:-[A-Z0-9]+){{2,}})\\b', 1)) AS requirement_id FROM {BLOCKS}) GROUP BY 1",
    "structure_flags": f"""WITH s AS (SELECT document_id, count(*) AS n, count(DISTINCT level) AS levels, count(parent_section_id) AS children FROM document_sections GROUP BY 1)
      SELECT DISTINCT document_id, 'unsectioned_content' AS flag FROM {BLOCKS} b WHERE NOT EXISTS (SELECT 1 FROM {LISTED} l WHERE l.document_id = b.document_id AND l.block_id = b.block_id) AND NOT EXISTS (SELECT 1 FROM document_sections x WHERE x.document_id = b.document_id AND x.heading_block_id = b.block_id)
      UNION ALL SELECT document_id, 'uniform_level' FROM s WHERE n > 1 AND levels = 1 UNION ALL SELECT document_id, 'no_children' FROM s WHERE n > 1 AND children = 0
      UNION ALL SELECT DISTINCT document_id, 'empty_pages' FROM {PAGES} WHERE blocks + tables = 0""",
    "page_samples": f"SELECT document_id, page_number, n::INT AS n, block_id, {_preview('text')} AS preview FROM (SELECT document_id, page_number, block_id, text, row_number() OVER (PARTITION BY document_id, page_number ORDER BY coalesce(reading_order_index, {LAST}), block_id) AS n FROM {BLOCKS} WHERE NOT {_blank('text')}) WHERE n <= 3",
}
ORACLES["page_markdown"] = f"""WITH t AS ({ORACLES["table_markdown"]}),
  i AS (SELECT document_id, page_number, coalesce(reading_order_index, 0) AS o, 0 AS kind, block_id AS id, CASE block_type WHEN 'section_header' THEN '## ' WHEN 'list_item' THEN '- ' ELSE '' END || text AS body FROM {BLOCKS} WHERE text IS NOT NULL
    UNION ALL SELECT document_id, page_number, coalesce(reading_order_index, 0), 1, table_id, markdown FROM {TABLES} JOIN t USING (document_id, table_id)),
  p AS (SELECT document_id, page_number, '<!-- Page ' || page_number || ' -->' || repeat(chr(10), 2) || '# Page ' || page_number || repeat(chr(10), 2) || string_agg(body, repeat(chr(10), 2) ORDER BY o, kind, id) AS m FROM i WHERE page_number IS NOT NULL GROUP BY 1, 2)
  SELECT document_id, page_number, sha256(m) AS markdown_hash, length(m)::INT AS characters FROM p"""


_SPLIT = "greatest(3000 - used, 1)"
ORACLES["chunk_rows"] = TREE + f""",
  paths AS (SELECT up.document_id, up.section_id, list(s.title ORDER BY distance DESC) AS path FROM up JOIN document_sections s ON s.document_id = up.document_id AND s.section_id = up.ancestor GROUP BY 1, 2),
  heads AS (SELECT document_id, section_id, path, 'Section: ' || array_to_string(path, ' > ') || repeat(chr(10), 2) AS prefix, page_start, heading_block_id FROM document_sections JOIN paths USING (document_id, section_id)),
  content AS (SELECT document_id, block_id AS id, 0 AS kind, page_number, reading_order_index, text, page_number AS first_page, page_number AS last_page FROM {BLOCKS} WHERE NOT {_blank("text")}
    UNION ALL SELECT document_id, table_id, 1, page_number, reading_order_index, CASE WHEN native_text_coverage < 0.85 AND NOT isnan(native_text_coverage) AND length(native_text) > 0 THEN native_text ELSE rendered END, least(list_min(page_numbers), page_number), greatest(list_max(page_numbers), page_number)
    FROM {TABLES} JOIN ({ORACLES["table_render"]}) USING (document_id, table_id)),
  refs AS (SELECT DISTINCT document_id, section_id, id, 0 AS kind FROM (SELECT document_id, section_id, heading_block_id, unnest(blocks) AS id FROM document_sections) WHERE id <> heading_block_id UNION ALL SELECT DISTINCT document_id, section_id, unnest(tables), 1 FROM document_sections),
  known AS (SELECT document_id, id, kind FROM refs UNION SELECT document_id, heading_block_id, 0 FROM document_sections),
  items AS (SELECT section_id, content.* FROM content JOIN refs USING (document_id, id, kind) UNION ALL SELECT '', content.* FROM content ANTI JOIN known USING (document_id, id, kind)),
  placed AS (SELECT *, row_number() OVER w AS place, sum(kind) OVER w AS run FROM items WINDOW w AS (PARTITION BY document_id, section_id ORDER BY {ORDER}, kind, id ROWS UNBOUNDED PRECEDING)),
  sized AS (SELECT placed.*, coalesce(length(prefix), 0) AS used FROM placed LEFT JOIN heads USING (document_id, section_id)),
  pieces AS (SELECT *, substr(text, i * {_SPLIT} + 1, {_SPLIT}) AS part FROM (SELECT *, unnest(generate_series(0, greatest(length(text) - 1, 0) // {_SPLIT})) AS i FROM sized WHERE kind = 0)),
  lined AS (SELECT *, length(part) AS n_chars, row_number() OVER (PARTITION BY document_id, section_id, run ORDER BY place, i) AS n FROM pieces),
  packed(document_id, section_id, run, n, size, g) AS (SELECT document_id, section_id, run, n, used + n_chars, 0 FROM lined WHERE n = 1
    UNION ALL SELECT x.document_id, x.section_id, x.run, x.n, CASE WHEN p.size + 2 + n_chars > 3000 THEN used + n_chars ELSE p.size + 2 + n_chars END, CASE WHEN p.size + 2 + n_chars > 3000 THEN g + 1 ELSE g END
    FROM packed p JOIN lined x ON x.document_id = p.document_id AND x.section_id = p.section_id AND x.run = p.run AND x.n = p.n + 1),
  texts AS (SELECT document_id, section_id, run * 2 AS major, g AS minor, string_agg(part, repeat(chr(10), 2) ORDER BY n) AS body, list(id ORDER BY n) AS ids, min(page_number) AS page_start, max(page_number) AS page_end FROM packed JOIN lined USING (document_id, section_id, run, n) GROUP BY 1, 2, 3, 4),
  parts AS (SELECT document_id, section_id, major, minor, body, 'prose' AS content_type, {_distinct("ids")} AS ids, NULL AS table_id, page_start, page_end FROM texts
    UNION ALL SELECT document_id, section_id, run * 2 - 1, 0, coalesce(text, ''), 'table', [], id, first_page, last_page FROM placed WHERE kind = 1
    UNION ALL SELECT document_id, section_id, 0, 0, '', 'prose', list_filter([heading_block_id], lambda x: x IS NOT NULL), NULL, page_start, page_start FROM heads ANTI JOIN placed USING (document_id, section_id)),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY document_id, section_id ORDER BY major, minor) - 1 AS ordinal FROM parts),
  headed AS (SELECT h.document_id, h.section_id, h.heading_block_id, b.page_number AS heading_page FROM heads h JOIN {BLOCKS} b ON b.document_id = h.document_id AND b.block_id = h.heading_block_id),
  done AS (SELECT n.*, CASE WHEN n.ordinal = 0 AND heading_block_id IS NOT NULL THEN list_prepend(heading_block_id, list_filter(ids, lambda x: x <> heading_block_id)) ELSE ids END AS sources, CASE WHEN n.ordinal = 0 THEN heading_page END AS extra FROM numbered n LEFT JOIN headed USING (document_id, section_id))
  SELECT document_id, nullif(section_id, '') AS section_id, coalesce(array_to_string(path, ' > '), '') AS path, content_type, sha256(regexp_replace(coalesce(prefix, '') || body, '{_SPACE}+$', '')) AS text_hash, least(d.page_start, extra) AS page_start, greatest(page_end, extra) AS page_end,
    array_to_string(sources, ',') AS block_ids, coalesce(table_id, '') AS table_ids, ordinal::INT AS ordinal FROM done d LEFT JOIN (SELECT document_id, section_id, path, prefix FROM heads) USING (document_id, section_id)"""

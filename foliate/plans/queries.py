"""All queries of the core by name, over whole tables, and equal SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.vectors import is_unit
from ..operators import answers, blocks as B, chunking, context, evaluation, extraction, index, lexical, nested, pages, providers, reports, retrieval, sections as S, tables as T
from ..sources.documents import accept_files
from ..sources.tables import table
from . import pipeline
from .oracles import ORACLES
from .storage import spread

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
DEMO_BUDGET = 3000
#: Texts that the query takes for brand marks in a corner of the page.
SEMANTIC_BRANDS = ("CONFIDENTIAL", "DRAFT", "INTERNAL")


def query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


def _blocks(spark: SparkSession, folder: str, *wanted: str) -> DataFrame:
    return B.distinct_blocks(table(spark, folder, "document_blocks"), *wanted)


def _tables(spark: SparkSession, folder: str) -> DataFrame:
    return T.distinct_tables(table(spark, folder, "parsed_tables").drop("quality_notes"))


def _cells(spark: SparkSession, folder: str) -> DataFrame:
    return T.table_cells(_tables(spark, folder))


def _ranked(spark: SparkSession, folder: str) -> DataFrame:
    """Retrieved chunks, redelivered rows once, as ranked lists."""
    rows = table(spark, folder, "retrieved_chunks").drop("retrieved_at").distinct()
    return rows.withColumnRenamed("request_id", "query_id")


def _chunk_texts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "retrieved_chunks").select("chunk_id", "document_id", "text", "section_path", "page_start", "page_end", "source_block_ids", "source_table_ids")
    return rows.groupBy("chunk_id").agg(F.min(F.struct(*[c for c in rows.columns if c != "chunk_id"])).alias("r")).select("chunk_id", "r.*")


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "question_responses").drop("recorded_at").distinct().withColumnRenamed("request_id", "query_id")


# Sources

@query
def intake_accept(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "document_catalog").select("document_id", F.concat("stored_filename").alias("path"), F.col("size_bytes").alias("length"))
    return accept_files(files, Settings(extensions=(".pdf", ".docx"), max_bytes=2_000_000)).select("document_id", "extension", "refusal")


# Blocks, pages, sections

@query
def block_projection(spark: SparkSession, folder: str) -> DataFrame:
    return B.project_blocks(_blocks(spark, folder)).select("document_id", "block_id", "page_number", "reading_order_index", "block_type", F.sha2("text", 256).alias("text_hash"), "excerpt")


@query
def semantic_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return B.semantic_blocks(_blocks(spark, folder), SEMANTIC_BRANDS, 0.0, 1000.0).select("document_id", "block_id")


@query
def repeated_headers(spark: SparkSession, folder: str) -> DataFrame:
    return B.drop_repeated_headers(_blocks(spark, folder)).select("document_id", "block_id")


@query
def reading_order(spark: SparkSession, folder: str) -> DataFrame:
    return B.reading_order(_blocks(spark, folder, "page_number", "reading_order_index"), _tables(spark, folder))


@query
def page_assembly(spark: SparkSession, folder: str) -> DataFrame:
    return B.assemble_pages(table(spark, folder, "document_catalog"), _blocks(spark, folder, "page_number"), _tables(spark, folder))


@query
def merge_status(spark: SparkSession, folder: str) -> DataFrame:
    states = table(spark, folder, "document_catalog").select("collection", F.coalesce("parse_status", F.lit("not_started")).alias("state"))
    return B.merged_status(states, "collection", "state")


@query
def merged_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return pages.merge_page_blocks(_blocks(spark, folder)).select("document_id", "block_id", "page_number", "position")


@query
def merged_documents(spark: SparkSession, folder: str) -> DataFrame:
    catalog = table(spark, folder, "document_catalog").where("page_count > 0")
    states = catalog.select("document_id", F.explode(F.sequence(F.lit(1), "page_count")).alias("page_number"), F.coalesce("parse_status", F.lit("not_started")).alias("state"), "parser_name", F.col("created_at").alias("started_at"), F.col("created_at").alias("completed_at"))
    return pages.merge_pages(states, _blocks(spark, folder), _tables(spark, folder)).select("document_id", "page_count", "blocks", "tables", "sections", "status", "parser_name")


@query
def reading_positions(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "document_sections").select(F.concat_ws("/", "document_id", "section_id").alias("section"), "blocks")
    return pages.reading_positions(rows, "blocks", "section")


@query
def page_scoped_ids(spark: SparkSession, folder: str) -> DataFrame:
    return _blocks(spark, folder).select("document_id", "block_id", B.page_scoped(B.page_scoped(F.col("block_id"), F.col("page_number")), F.col("page_number")).alias("scoped_id"))


@query
def heading_levels(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "document_sections")
    return rows.select("document_id", "section_id", B.heading_level(F.col("title")).alias("heading_level"))


@query
def section_tree(spark: SparkSession, folder: str) -> DataFrame:
    return S.reconstruct_sections(_blocks(spark, folder)).select("document_id", "section_id", "parent_section_id", "level")


@query
def active_section(spark: SparkSession, folder: str) -> DataFrame:
    return S.active_sections(_blocks(spark, folder, "page_number", "reading_order_index", "block_type"))


@query
def section_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return S.rolled_up_pages(table(spark, folder, "document_sections"))


@query
def section_paths(spark: SparkSession, folder: str) -> DataFrame:
    rows = S.section_paths(table(spark, folder, "document_sections"))
    return rows.select("document_id", "section_id", F.col("depth").cast("int").alias("depth"), F.array_join("section_path", " > ").alias("path"))


@query
def unsectioned_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return S.unsectioned_blocks(_blocks(spark, folder, "page_number"), table(spark, folder, "document_sections")).select("document_id", "block_id")


@query
def block_membership(spark: SparkSession, folder: str) -> DataFrame:
    return S.block_membership(table(spark, folder, "document_sections"))


# Tables

@query
def cell_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return _cells(spark, folder).select("document_id", "table_id", "cell_id", "row_index", "column_index", "text")


@query
def table_render(spark: SparkSession, folder: str) -> DataFrame:
    return T.render_tables(_cells(spark, folder))


@query
def table_markdown(spark: SparkSession, folder: str) -> DataFrame:
    return T.markdown_tables(_cells(spark, folder))


@query
def token_coverage(spark: SparkSession, folder: str) -> DataFrame:
    cells = _cells(spark, folder).groupBy("document_id", "table_id").agg(F.array_join(F.collect_list(F.coalesce("text", F.lit(""))), " ").alias("text"))
    native = _tables(spark, folder).select("document_id", "table_id", F.coalesce("native_text", F.lit("")).alias("text"))
    return T.token_coverage(cells, native, ["document_id", "table_id"]).select("document_id", "table_id", F.round("coverage", 6).alias("coverage"))


# Chunking

@query
def split_fixed(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(chunking.hard_split(F.col("text"), F.lit(1000))).alias("piece_no", "piece"))
    return rows.select("doc_id", "piece_no", F.sha2("piece", 256).alias("piece_hash"), F.length("piece").alias("characters"))


@query
def chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.chunk_documents(table(spark, folder, "document_sections"), _blocks(spark, folder), _tables(spark, folder))


@query
def chunk_rows(spark: SparkSession, folder: str) -> DataFrame:
    """All chunks but for their ids."""
    joined = lambda name: F.array_join(name, ",")
    return chunks(spark, folder).select("document_id", "section_id", F.array_join("section_path", " > ").alias("path"), "content_type", F.sha2("text", 256).alias("text_hash"), "page_start", "page_end", joined("source_block_ids").alias("block_ids"), joined("source_table_ids").alias("table_ids"), "ordinal")


@query
def chunk_report(spark: SparkSession, folder: str) -> DataFrame:
    return reports.chunk_report(_chunk_texts(spark, folder).where("text IS NOT NULL"))


# Index and catalog

@query
def token_limit(spark: SparkSession, folder: str) -> DataFrame:
    return index.over_limit(table(spark, folder, "documents").select("doc_id", "text"), limit=512).select("doc_id", "over_limit")


@query
def input_problems(spark: SparkSession, folder: str) -> DataFrame:
    known = table(spark, folder, "document_catalog").where("parse_status = 'success'")
    return index.input_problems(table(spark, folder, "retrieved_chunks").select("document_id", "chunk_id").distinct(), known)


@query
def catalog_get(spark: SparkSession, folder: str) -> DataFrame:
    catalog = table(spark, folder, "document_catalog")
    first = catalog.agg(F.min("document_id")).first()[0]
    return index.document(catalog, first or "").select("document_id", "filename", "collection", "page_count")


@query
def parsed_json(spark: SparkSession, folder: str) -> DataFrame:
    records = table(spark, folder, "parsed_documents")
    found = index.parsed_json(records, records.select("document_id").unionByName(table(spark, folder, "document_catalog").select("document_id")))
    return found.select("document_id", F.sha2("parsed_document_json", 256).alias("record_hash"))

@query
def content_hash(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", index.content_hash(F.col("text")).alias("content_hash"))


@query
def vector_validation(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", is_unit(F.col("embedding"), 64).alias("valid"))


def _generations(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Two generations of an index: what is stored lacks every third row and has an older hash for every fifth."""
    rows = table(spark, folder, "documents").where("source IS NOT NULL").select(F.col("source").alias("document_id"), F.col("doc_id").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text"))
    new = rows.where("chunk_id % 7 != 0").withColumn("content_hash", F.sha2("text", 256))
    old = rows.where("chunk_id % 3 != 0").withColumn("content_hash", F.sha2(F.concat("text", F.when(F.col("chunk_id") % 5 == 0, "old").otherwise("")), 256))
    return new, old


@query
def sync_plan(spark: SparkSession, folder: str) -> DataFrame:
    new, old = _generations(spark, folder)
    return index.plan_sync(new, old, ("content_hash",))


@query
def sync_counts(spark: SparkSession, folder: str) -> DataFrame:
    new, old = _generations(spark, folder)
    return index.sync_counts(index.plan_sync(new, old, ("content_hash",)))


def _stored_chunks(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "retrieved_chunks").select("document_id", "chunk_id").distinct()
    parity = F.conv(F.substring("chunk_id", -1, 1), 16, 10).cast("int") % 4
    return rows.select("*", F.lit("m").alias("embedding_model"), F.when(parity == 0, "old").otherwise("1").alias("embedding_revision"), F.lit("c").alias("embedding_config_hash"), F.lit(64).alias("embedding_dimension"))


@query
def index_summary(spark: SparkSession, folder: str) -> DataFrame:
    return index.index_summary(_stored_chunks(spark, folder), "m", "1", "c", 64)


@query
def catalog_list(spark: SparkSession, folder: str) -> DataFrame:
    catalog = table(spark, folder, "document_catalog").select("document_id", "filename", "parse_status")
    return index.catalog_listing(catalog, index.index_summary(_stored_chunks(spark, folder), "m", "1", "c", 64))


@query
def question_gate(spark: SparkSession, folder: str) -> DataFrame:
    summary = index.index_summary(_stored_chunks(spark, folder), "m", "1", "c", 64)
    return index.ready_questions(_questions(spark, folder).select("query_id", "document_id"), table(spark, folder, "document_catalog"), summary)


@query
def ingestion_summary(spark: SparkSession, folder: str) -> DataFrame:
    return index.ingestion_summary(table(spark, folder, "document_catalog"), _blocks(spark, folder, "page_number"), _tables(spark, folder), _cells(spark, folder), table(spark, folder, "document_sections"))


# Retrieval

def _vector_queries(vectors: DataFrame) -> DataFrame:
    return vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")


@query
def dense_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    first = vectors.where("vec_id = 0").first()
    return retrieval.dense_topk(vectors, list(first.embedding) if first else [0.0] * 64, 10)


@query
def dense_space(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of an older generation (those of label 0) are not searched."""
    rows = table(spark, folder, "embeddings").select("*", F.lit("m").alias("embedding_model"), F.when(F.col("label") == 0, "old").otherwise("1").alias("embedding_revision"), F.lit("c").alias("embedding_config_hash"), F.size("embedding").alias("embedding_dimension"))
    return retrieval.dense_topk_batch(index.in_space(rows, "m", "1", "c", 64), _vector_queries(rows), 5)


@query
def rerank_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Where the least vector of a query's label stands before and after reranking all 40 candidates."""
    vectors = table(spark, folder, "embeddings")
    near = retrieval.dense_topk_batch(vectors, _vector_queries(vectors), 40)
    scored = near.withColumnRenamed("rank", "dense_rank").withColumn("reranker_score", ((F.col("vec_id") * 7919 + F.col("query_id") * 104729) % 101).cast("double"))
    least = vectors.groupBy("label").agg(F.min("vec_id").alias("chunk_id"))
    gold = _vector_queries(vectors).select("query_id", "label").join(least, "label").select("query_id", "chunk_id")
    return evaluation.rerank_comparison(near.withColumnRenamed("vec_id", "chunk_id"), retrieval.rerank(scored, 40, "vec_id").withColumnRenamed("vec_id", "chunk_id"), gold)


@query
def search_report(spark: SparkSession, folder: str) -> DataFrame:
    return reports.search_report(_ranked(spark, folder))


@query
def dense_topk_batch(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return retrieval.dense_topk_batch(vectors, _vector_queries(vectors), 5)


@query
def dense_filtered(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return retrieval.dense_topk_batch(vectors, _vector_queries(vectors), 5, scope="label")


def _two_legs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    vectors = table(spark, folder, "embeddings")
    queries = _vector_queries(vectors)
    return retrieval.dense_topk_batch(vectors, queries, 20), retrieval.dense_topk_batch(vectors, queries, 20, scope="label")


@query
def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    first, second = _two_legs(spark, folder)
    return retrieval.reciprocal_rank_fusion(first, second, 5, "vec_id")


@query
def rerank_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    near = retrieval.dense_topk_batch(vectors, _vector_queries(vectors), 40).withColumnRenamed("rank", "dense_rank")
    scored = near.withColumn("reranker_score", ((F.col("vec_id") * 7919 + F.col("query_id") * 104729) % 101).cast("double"))
    return retrieval.rerank(scored, 5, "vec_id").select("query_id", "rank", "vec_id", "reranker_score", "dense_rank")


def _title_queries(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    titles = table(spark, folder, "document_catalog").where("title IS NOT NULL").select(F.col("document_id").alias("query_id"), "document_id", F.col("title").alias("question"))
    texts = _blocks(spark, folder).where("text IS NOT NULL").select(F.concat_ws("/", "document_id", "block_id").alias("chunk_id"), "document_id", "text")
    return titles, texts


@query
def lexical_match(spark: SparkSession, folder: str) -> DataFrame:
    titles, texts = _title_queries(spark, folder)
    return lexical.lexical_match(titles, texts, scope="document_id")


@query
def lexical_rank(spark: SparkSession, folder: str) -> DataFrame:
    titles, texts = _title_queries(spark, folder)
    return lexical.lexical_topk(titles, texts, scope="document_id")


@query
def hybrid_topk(spark: SparkSession, folder: str) -> DataFrame:
    titles, texts = _title_queries(spark, folder)
    embedded = providers.embed(spread(texts), "text")
    dense = retrieval.dense_topk_batch(embedded, providers.embed(titles, "question"), 5, "chunk_id", scope="document_id")
    return retrieval.reciprocal_rank_fusion(dense, lexical.lexical_topk(titles, texts, scope="document_id"), 5)


# Contexts, answers

@query
def context_pack(spark: SparkSession, folder: str) -> DataFrame:
    return context.pack_contexts(_ranked(spark, folder), DEMO_BUDGET).drop("rendered")


@query
def context_text(spark: SparkSession, folder: str) -> DataFrame:
    rows = context.pack_contexts(_ranked(spark, folder), DEMO_BUDGET)
    return rows.select("query_id", "evidence_id", F.sha2("rendered", 256).alias("rendered_hash"))


@query
def context_exclusion_report(spark: SparkSession, folder: str) -> DataFrame:
    return context.context_exclusions(_ranked(spark, folder), DEMO_BUDGET)


@query
def citation_parse(spark: SparkSession, folder: str) -> DataFrame:
    rows = _questions(spark, folder)
    return rows.select("query_id", F.array_join(answers.inline_citations(F.col("answer_text")), ",").alias("inline_ids"), F.size(answers.malformed_citations(F.col("answer_text"))).alias("malformed"))


def _evidence(spark: SparkSession, folder: str) -> DataFrame:
    rows = context.classify_candidates(_ranked(spark, folder)).where("state = 'candidate'")
    return rows.select("query_id", F.concat(F.lit("E"), F.col("ordinal").cast("string")).alias("evidence_id"), "chunk_id")


@query
def citation_check(spark: SparkSession, folder: str) -> DataFrame:
    known = _evidence(spark, folder).groupBy("query_id").agg(F.collect_set("evidence_id").alias("known_ids"))
    return answers.check_citations(_questions(spark, folder).join(known, "query_id", "left")).select("query_id", "citation_status")


@query
def citation_resolve(spark: SparkSession, folder: str) -> DataFrame:
    return answers.resolve_citations(_questions(spark, folder), _evidence(spark, folder))


@query
def question_answering(spark: SparkSession, folder: str) -> DataFrame:
    indexed = pipeline.index_documents(table(spark, folder, "document_sections"), table(spark, folder, "document_blocks"), table(spark, folder, "parsed_tables"))
    return pipeline.answer_questions(_questions(spark, folder).select("query_id", "document_id", "question"), indexed)


# Evaluation

def _locators(spark: SparkSession, folder: str) -> DataFrame:
    """A fact for each cited passage: its section path, first page and opening characters."""
    cited = answers.resolve_citations(_questions(spark, folder), _evidence(spark, folder)).where("chunk_id IS NOT NULL")
    rows = cited.join(_ranked(spark, folder).select("query_id", "chunk_id", "document_id", "section_path", "page_start", "text").distinct(), ["query_id", "chunk_id"])
    null = F.lit(None).cast("string")
    return rows.select("query_id", "document_id", F.col("evidence_id").alias("fact_id"), null.alias("block_id"), null.alias("table_id"), "section_path", F.array("page_start").alias("pages"), F.array(F.substring("text", 1, 60)).alias("anchors"))


@query
def fact_ranks(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.fact_ranks(_ranked(spark, folder), _locators(spark, folder))


@query
def fact_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.coverage(evaluation.fact_ranks(_ranked(spark, folder), _locators(spark, folder)))


@query
def retrieval_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.metrics(evaluation.coverage(evaluation.fact_ranks(_ranked(spark, folder), _locators(spark, folder))))


@query
def strategy_compare(spark: SparkSession, folder: str) -> DataFrame:
    ranked, wanted = _ranked(spark, folder), _locators(spark, folder)
    turned = ranked.withColumn("rank", F.lit(6) - F.col("rank"))
    return evaluation.compare(evaluation.coverage(evaluation.fact_ranks(ranked, wanted)), evaluation.coverage(evaluation.fact_ranks(turned, wanted)), 3)


@query
def strategy_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Three orders of the same candidates: as ranked, turned round, and by page."""
    ranked, wanted = _ranked(spark, folder), _locators(spark, folder)
    paged = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("page_start", "rank", "chunk_id")))
    orders = {"ranked": ranked, "turned": ranked.withColumn("rank", F.lit(6) - F.col("rank")), "paged": paged}
    return evaluation.compare_strategies({name: evaluation.coverage(evaluation.fact_ranks(df, wanted)) for name, df in orders.items()}, "ranked", 3)


@query
def label_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of the first form: for every other citation a chunk id, for the rest the first page of its passage."""
    wanted = answers.resolve_citations(_questions(spark, folder), _evidence(spark, folder)).where("chunk_id IS NOT NULL")
    ranked = _ranked(spark, folder)
    rows = wanted.join(ranked.select("query_id", "chunk_id", "document_id", "page_start").distinct(), ["query_id", "chunk_id"])
    by_id = F.col("position") % 2 == 0
    labels = rows.select("query_id", "document_id", F.col("evidence_id").alias("fact_id"), F.when(by_id, F.array("chunk_id")).alias("chunk_ids"), F.lit(None).cast("array<string>").alias("section_ids"), F.array("page_start").alias("pages"))
    return evaluation.label_ranks(ranked, labels)


@query
def evaluator(spark: SparkSession, folder: str) -> DataFrame:
    """The stored rankings as a retriever, restricted to the expected document."""
    rows = _questions(spark, folder).select("query_id", "document_id", "question")
    return evaluation.evaluate(rows, lambda asked: _ranked(spark, folder).join(asked.select("query_id"), "query_id", "left_semi"), _locators(spark, folder))


@query
def locator_audit(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.audit_locators(_locators(spark, folder), _chunk_texts(spark, folder))


# Extraction, reports

@query
def extraction_units(spark: SparkSession, folder: str) -> DataFrame:
    rows = extraction.block_units(_blocks(spark, folder), table(spark, folder, "document_sections"))
    return rows.select("document_id", "unit_id", "content_type", F.sha2("text", 256).alias("text_hash"), "page_number", "section_id")


@query
def table_row_units(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.table_row_units(_cells(spark, folder), _tables(spark, folder)).select("document_id", "unit_id", "text", F.array_join("cell_ids", ",").alias("cell_ids"))


@query
def markdown_lines(spark: SparkSession, folder: str) -> DataFrame:
    sections = table(spark, folder, "document_sections")
    return extraction.markdown_lines(_blocks(spark, folder), S.block_membership(sections), sections)


@query
def unit_order(spark: SparkSession, folder: str) -> DataFrame:
    rows = extraction.block_units(_blocks(spark, folder), table(spark, folder, "document_sections"))
    orders = _blocks(spark, folder, "reading_order_index").select("document_id", F.col("block_id").alias("unit_id"), "reading_order_index")
    return extraction.in_order(rows.join(orders, ["document_id", "unit_id"])).select("document_id", "page_number", "unit_id", "position")


@query
def page_markdown(spark: SparkSession, folder: str) -> DataFrame:
    tables = _tables(spark, folder).select("document_id", "table_id", "page_number", "reading_order_index").join(T.markdown_tables(_cells(spark, folder)), ["document_id", "table_id"])
    return reports.page_markdown(_blocks(spark, folder), tables).select("document_id", "page_number", F.sha2("markdown", 256).alias("markdown_hash"), F.length("markdown").alias("characters"))


@query
def page_report(spark: SparkSession, folder: str) -> DataFrame:
    states = table(spark, folder, "document_catalog").where("page_count > 0").select("document_id", F.explode(F.sequence(F.lit(1), "page_count")).alias("page_number"), F.col("parse_status").alias("state"))
    return reports.page_report(page_assembly(spark, folder), states)


@query
def document_summary(spark: SparkSession, folder: str) -> DataFrame:
    blocks, tables = table(spark, folder, "document_blocks"), table(spark, folder, "parsed_tables")
    return reports.document_summary(table(spark, folder, "document_catalog"), blocks, tables, _cells(spark, folder), table(spark, folder, "document_sections"), page_assembly(spark, folder))


@query
def structure_listing(spark: SparkSession, folder: str) -> DataFrame:
    sections = table(spark, folder, "document_sections")
    return reports.structure_listing(sections, S.section_paths(sections))


@query
def duplicate_ids(spark: SparkSession, folder: str) -> DataFrame:
    ids = lambda name, column: table(spark, folder, name).select("document_id", F.col(column).alias("id"))
    return reports.duplicate_ids({"block": ids("document_blocks", "block_id"), "table": ids("parsed_tables", "table_id"), "section": ids("document_sections", "section_id")})


@query
def missing_provenance(spark: SparkSession, folder: str) -> DataFrame:
    return reports.missing_provenance(_blocks(spark, folder, "page_number", "reading_order_index", "bounding_box"))


@query
def empty_pages(spark: SparkSession, folder: str) -> DataFrame:
    return reports.empty_pages(page_assembly(spark, folder))


@query
def processing_summary(spark: SparkSession, folder: str) -> DataFrame:
    return reports.processing_summary(table(spark, folder, "document_catalog"), _blocks(spark, folder, "text"), _tables(spark, folder))


@query
def label_counts(spark: SparkSession, folder: str) -> DataFrame:
    return reports.label_counts(_blocks(spark, folder, "page_number", "block_type", "bounding_box"))


@query
def requirement_ids(spark: SparkSession, folder: str) -> DataFrame:
    return reports.requirement_ids(_blocks(spark, folder, "text"))


@query
def structure_flags(spark: SparkSession, folder: str) -> DataFrame:
    sections = table(spark, folder, "document_sections")
    return reports.structure_flags(sections, S.unsectioned_blocks(_blocks(spark, folder, "page_number"), sections), empty_pages(spark, folder))


@query
def page_samples(spark: SparkSession, folder: str) -> DataFrame:
    return reports.page_samples(_blocks(spark, folder, "page_number", "reading_order_index", "text"))


# Nested records

@query
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return nested.links(spread(table(spark, folder, "parsed_documents").select("document_id", "parsed_document_json")))


def _flat(name: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        records = spread(table(spark, folder, "parsed_documents").select("document_id", "parsed_document_json"))
        return nested.flat_table(nested.flatten_records(records, only=name), name)

    return run


def queries() -> dict[str, Query]:
    return _QUERIES | {f"p4_{name}s": _flat(name) for name in nested.DOCUMENT.tables()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

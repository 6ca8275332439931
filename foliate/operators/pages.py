"""Documents that were parsed page by page: projections of what a parser gives, and their merge into one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import LAST, drop_repeated_headers, merged_status, semantic_blocks
from .sections import reconstruct_sections


def reading_positions(items: DataFrame, list_column: str, key: str = "document_id") -> DataFrame:
    """(``key``, ref, position): the place of each reference in a list, from 0; of a repeated one, the last counts."""
    rows = items.select(key, F.posexplode(list_column).alias("position", "ref"))
    return rows.where("ref IS NOT NULL").groupBy(key, "ref").agg(F.max("position").alias("position"))


def project_images(images: DataFrame) -> DataFrame:
    """Images that have a page, with their place on it; a missing order comes last."""
    order = Window.partitionBy("document_id", "page_number").orderBy(F.coalesce("reading_order_index", F.lit(LAST)), "image_id")
    return images.where("page_number IS NOT NULL").withColumn("position", F.row_number().over(order) - 1)


def project_diagnostics(parses: DataFrame) -> DataFrame:
    """(document_id, page_number, position, error_type, message): a row for each error of a parse. Errors without a message
    say their type."""
    rows = parses.select("document_id", "page_number", F.posexplode("errors").alias("position", "e"))
    kind = F.coalesce(F.col("e.error_type"), F.lit("Diagnostic"))
    return rows.select("document_id", "page_number", "position", kind.alias("error_type"), F.coalesce("e.message", kind).alias("message"))


def merge_page_blocks(blocks: DataFrame, brands: tuple[str, ...] = ()) -> DataFrame:
    """The blocks of all pages of each document without page furniture, with ``position`` on their page.

    Repeated headers only show once the pages are together, so they are taken out here. Positions count from 0 within a
    page; no window spans a document.
    """
    kept = drop_repeated_headers(semantic_blocks(blocks, brands))
    order = Window.partitionBy("document_id", "page_number").orderBy(F.coalesce("reading_order_index", F.lit(LAST)), "block_id")
    return kept.withColumn("position", F.row_number().over(order) - 1)


def merge_pages(pages: DataFrame, blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """One row per document out of its pages: page_count, blocks, tables, sections, status, parser_name, started_at,
    completed_at.

    ``pages`` has document_id, page_number, state, parser_name, started_at and completed_at. The parser and the start are
    those of the first page, the end is that of the last.
    """
    merged = merge_page_blocks(blocks)
    sections = reconstruct_sections(merged.drop("position"))
    out = pages.groupBy("document_id").agg(F.countDistinct("page_number").alias("page_count"), F.min_by("parser_name", "page_number").alias("parser_name"), F.min_by("started_at", "page_number").alias("started_at"), F.max_by("completed_at", "page_number").alias("completed_at"))
    out = out.join(merged_status(pages, "document_id", "state"), "document_id")
    for name, df in (("blocks", merged), ("tables", tables), ("sections", sections)):
        out = out.join(df.groupBy("document_id").agg(F.count("*").alias(name)), "document_id", "left")
    counts = [F.coalesce(name, F.lit(0)).alias(name) for name in ("blocks", "tables", "sections")]
    return out.select("document_id", "page_count", *counts, "status", "parser_name", "started_at", "completed_at")

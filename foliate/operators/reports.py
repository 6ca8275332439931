"""Quality and inspection reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse, is_blank


def duplicate_ids(kinds: dict[str, DataFrame]) -> DataFrame:
    """(kind, document_id, id, rows) of ids that occur more than once; each frame has document_id and id."""
    parts = [df.select(F.lit(kind).alias("kind"), "document_id", "id") for kind, df in kinds.items()]
    return reduce(DataFrame.unionByName, parts).where("id IS NOT NULL").groupBy("kind", "document_id", "id").agg(F.count("*").alias("rows")).where("rows > 1")


def missing_provenance(blocks: DataFrame) -> DataFrame:
    """(document_id, block_id, missing) of blocks without a page, order or box."""
    lacks = F.array_compact(F.array(F.when(F.col("page_number").isNull(), F.lit("page")), F.when(F.col("reading_order_index").isNull(), F.lit("order")), F.when(F.col("bounding_box").isNull(), F.lit("box"))))
    return blocks.select("document_id", "block_id", F.array_join(lacks, ",").alias("missing")).where("missing != ''")


def empty_pages(pages: DataFrame) -> DataFrame:
    """(document_id, page_number) of pages without any item."""
    return pages.where("blocks + tables = 0").select("document_id", "page_number")


def processing_summary(catalog: DataFrame, blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Per collection: documents, failed ones, pages, blocks, blank blocks, tables."""
    b = blocks.groupBy("document_id").agg(F.count("*").alias("b"), F.count_if(is_blank(F.col("text"))).alias("e"))
    t = tables.groupBy("document_id").agg(F.count("*").alias("t"))
    joined = catalog.join(b, "document_id", "left").join(t, "document_id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return joined.groupBy("collection").agg(F.count("*").alias("documents"), F.count_if(F.col("parse_status") == "failed").alias("failed"), total("page_count").alias("pages"), total("b").alias("blocks"), total("e").alias("blank_blocks"), total("t").alias("tables"))


def document_summary(catalog: DataFrame, blocks: DataFrame, tables: DataFrame, cells: DataFrame, sections: DataFrame, pages: DataFrame) -> DataFrame:
    """Per document: pages, blocks, tables, cells, sections, empty pages, and whether ids repeat or provenance is missing.

    ``blocks``, ``tables`` and ``sections`` are as delivered, so that repeated ids show; ``pages`` is that of
    :func:`.blocks.assemble_pages`.
    """
    ids = {"block": blocks.select("document_id", F.col("block_id").alias("id")), "table": tables.select("document_id", F.col("table_id").alias("id")), "section": sections.select("document_id", F.col("section_id").alias("id"))}
    out = catalog.select("document_id", F.coalesce("page_count", F.lit(0)).alias("pages"))
    lost = blocks.where("page_number IS NULL").select("document_id").unionByName(tables.where("page_number IS NULL").select("document_id")).distinct().withColumn("lost", F.lit(True))
    twice = duplicate_ids(ids).select("document_id").distinct().withColumn("twice", F.lit(True))
    for name, df in (*[(f"{kind}s", rows.distinct()) for kind, rows in ids.items()], ("cells", cells), ("empty_pages", empty_pages(pages))):
        out = out.join(df.groupBy("document_id").agg(F.count("*").alias(name)), "document_id", "left")
    out = out.join(twice, "document_id", "left").join(lost, "document_id", "left")
    counts = [F.coalesce(name, F.lit(0)).alias(name) for name in ("blocks", "tables", "cells", "sections", "empty_pages")]
    return out.select("document_id", "pages", *counts, F.coalesce("twice", F.lit(False)).alias("has_duplicate_ids"), F.coalesce("lost", F.lit(False)).alias("has_missing_provenance"))


def page_report(pages: DataFrame, states: DataFrame) -> DataFrame:
    """(document_id, page_number, line): a line of the text report for each page; a page without a state is not_started."""
    joined = pages.join(states.select("document_id", "page_number", "state"), ["document_id", "page_number"], "left")
    line = F.concat(F.lit("- Page "), F.col("page_number").cast("string"), F.lit(": "), F.coalesce("state", F.lit("not_started")), F.lit(", blocks="), F.col("blocks").cast("string"), F.lit(", tables="), F.col("tables").cast("string"))
    return joined.select("document_id", "page_number", line.alias("line"))


def page_markdown(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """(document_id, page_number, markdown): the items of each page in order, headings and list entries marked.

    ``tables`` has document_id, table_id, page_number, reading_order_index and markdown. Items without a page are left
    out; blocks come before tables of the same order.
    """
    shown = F.when(F.col("block_type") == "section_header", F.concat(F.lit("## "), "text")).when(F.col("block_type") == "list_item", F.concat(F.lit("- "), "text")).otherwise(F.col("text"))
    items = blocks.where("text IS NOT NULL").select("document_id", "page_number", "reading_order_index", F.lit(0).alias("kind"), F.col("block_id").alias("id"), shown.alias("body"))
    items = items.unionByName(tables.where("markdown IS NOT NULL").select("document_id", "page_number", "reading_order_index", F.lit(1).alias("kind"), F.col("table_id").alias("id"), F.col("markdown").alias("body")))
    ordered = F.sort_array(F.collect_list(F.struct(F.coalesce("reading_order_index", F.lit(0)).alias("order"), "kind", "id", "body")))
    pages = items.where("page_number IS NOT NULL").groupBy("document_id", "page_number").agg(F.array_join(F.transform(ordered, lambda x: x["body"]), "\n\n").alias("body"))
    head = F.concat(F.lit("<!-- Page "), F.col("page_number").cast("string"), F.lit(" -->\n\n# Page "), F.col("page_number").cast("string"), F.lit("\n\n"))
    return pages.select("document_id", "page_number", F.concat(head, "body").alias("markdown"))


def structure_listing(sections: DataFrame, paths: DataFrame) -> DataFrame:
    """(document_id, section_id, line): each section indented by its depth, with its pages and numbers of items."""
    joined = sections.dropDuplicates(["document_id", "section_id"]).join(paths.select("document_id", "section_id", "depth"), ["document_id", "section_id"])
    pages = F.when(F.coalesce("page_end", "page_start") == F.col("page_start"), F.col("page_start").cast("string")).otherwise(F.concat_ws("-", "page_start", "page_end"))
    line = F.concat(F.repeat(F.lit("  "), F.col("depth").cast("int")), F.col("title"), F.lit(" [pages "), pages, F.lit("; blocks "), F.size("blocks").cast("string"), F.lit("; tables "), F.size("tables").cast("string"), F.lit("]"))
    return joined.select("document_id", "section_id", line.alias("line"))


def chunk_report(chunks: DataFrame) -> DataFrame:
    """(chunk_id, characters, preview) of every chunk."""
    return chunks.select("chunk_id", F.length("text").alias("characters"), preview(F.col("text")).alias("preview"))


def search_report(ranked: DataFrame) -> DataFrame:
    """(query_id, rank, line): rank, similarity, section and preview of each passage that was found."""
    where = F.when(F.size("section_path") > 0, F.array_join("section_path", " > ")).otherwise("-")
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), F.format_string("%.6f", F.col("similarity")), F.lit(" | "), where, F.lit(" | "), preview(F.coalesce("text", F.lit(""))))
    return ranked.select("query_id", "rank", line.alias("line"))


def label_counts(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("block_type").agg(F.count("*").alias("blocks"), F.count_if(F.col("page_number").isNull()).alias("without_page"), F.count_if(F.col("bounding_box").isNull()).alias("without_box"))


def requirement_ids(texts: DataFrame) -> DataFrame:
    """(requirement_id, mentions) of identifiers such as ABC-DE-012 in column text."""
    found = texts.select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\b([A-Z][A-Z0-9]+(?:-[A-Z0-9]+){2,})\b"), 1)).alias("requirement_id"))
    return found.groupBy("requirement_id").agg(F.count("*").alias("mentions"))


def structure_flags(sections: DataFrame, unsectioned: DataFrame, empty: DataFrame) -> DataFrame:
    """(document_id, flag) of what looks wrong: unsectioned content, one level only, no children, empty pages."""
    shape = sections.groupBy("document_id").agg(F.count("*").alias("n"), F.countDistinct("level").alias("levels"), F.count("parent_section_id").alias("children"))
    flag = lambda df, name: df.select("document_id").distinct().withColumn("flag", F.lit(name))
    parts = [flag(unsectioned, "unsectioned_content"), flag(shape.where("n > 1 AND levels = 1"), "uniform_level"), flag(shape.where("n > 1 AND children = 0"), "no_children"), flag(empty, "empty_pages")]
    return reduce(DataFrame.unionByName, parts)


def page_samples(blocks: DataFrame, per_page: int = 3) -> DataFrame:
    """The first blocks of each page with a preview: a sampling report."""
    order = Window.partitionBy("document_id", "page_number").orderBy(F.coalesce("reading_order_index", F.lit(10**9)), "block_id")
    rows = blocks.where(~is_blank(F.col("text"))).withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_page)
    return rows.select("document_id", "page_number", "n", "block_id", preview(F.col("text")).alias("preview"))


def preview(text: Column, limit: int = 300) -> Column:
    short = collapse(text)
    return F.when(F.length(short) > limit, F.concat(F.substring(short, 1, limit), F.lit("..."))).otherwise(short)

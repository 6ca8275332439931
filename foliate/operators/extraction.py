"""Units for extraction: block units, table-row units, and a Markdown view of a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse
from .blocks import content_order


def block_units(blocks: DataFrame, sections: DataFrame, walk_children: bool = False) -> DataFrame:
    """(document_id, unit_id, content_type, text, page_number, section_id) of blocks with a text.

    The section is looked up among top-level sections only, unless ``walk_children`` is set.
    """
    kind = F.when(F.col("block_type") == "section_header", "heading").when(F.col("block_type") == "list_item", "list_item").otherwise("paragraph")
    units = blocks.withColumn("text", collapse(F.coalesce("text", F.lit("")))).where("text != ''")
    roots = sections if walk_children else sections.where("parent_section_id IS NULL")
    listed = roots.select("document_id", "section_id", F.explode(F.concat("blocks", F.array("heading_block_id"))).alias("block_id")).groupBy("document_id", "block_id").agg(F.min("section_id").alias("section_id"))
    return units.join(listed, ["document_id", "block_id"], "left").select("document_id", F.col("block_id").alias("unit_id"), kind.alias("content_type"), "text", "page_number", "section_id")


def in_order(units: DataFrame) -> DataFrame:
    """Adds ``position`` on the page, from 0: by order (a missing one counts as 0), then by id."""
    order = Window.partitionBy("document_id", "page_number").orderBy(F.coalesce("reading_order_index", F.lit(0)), "unit_id")
    return units.withColumn("position", F.row_number().over(order) - 1)


def table_row_units(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """(document_id, unit_id, text, cell_ids) of table rows: ``header: cell`` joined by bars.

    Rows of nothing but header cells, blank rows and tables without a page are left out; of several headers of a
    column, the last that is not blank counts.
    """
    clean = cells.withColumn("text", collapse(F.coalesce("text", F.lit(""))))
    heads = clean.where("is_header AND text != ''").groupBy("document_id", "table_id", "column_index").agg(F.max_by("text", "pos").alias("header"))
    body = clean.where("text != ''").join(heads, ["document_id", "table_id", "column_index"], "left")
    shown = F.when(F.col("header").isNotNull() & ~F.col("is_header"), F.concat("header", F.lit(": "), "text")).otherwise(F.col("text"))
    parts = F.sort_array(F.collect_list(F.struct("column_index", shown.alias("text"), "cell_id")))
    rows = body.groupBy("document_id", "table_id", "row_index").agg(parts.alias("parts"), F.every("is_header").alias("headers"))
    paged = tables.where("page_number IS NOT NULL").select("document_id", "table_id")
    kept = rows.where("NOT headers").join(paged, ["document_id", "table_id"], "left_semi")
    return kept.select("document_id", F.concat_ws("", F.col("table_id"), F.lit("-row-"), F.col("row_index")).alias("unit_id"), F.array_join(F.transform("parts", lambda p: p["text"]), " | ").alias("text"), F.transform("parts", lambda p: p["cell_id"]).alias("cell_ids"))


def markdown_lines(blocks: DataFrame, membership: DataFrame, sections: DataFrame) -> DataFrame:
    """(document_id, pos, line): blocks in order, with a marker where the page or the titled section changes.

    A new page forgets the section.
    """
    titles = membership.join(sections.select("document_id", "section_id", "title"), ["document_id", "section_id"]).select("document_id", "block_id", "title")
    rows = blocks.withColumn("text", collapse(F.coalesce("text", F.lit("")))).where("text != ''").join(titles, ["document_id", "block_id"], "left")
    order = Window.partitionBy("document_id").orderBy(*content_order(), "block_id")
    on_page = Window.partitionBy("document_id", "page_number").orderBy(*content_order(), "block_id").rowsBetween(Window.unboundedPreceding, -1)
    marked = rows.select("document_id", "text", "block_type", "page_number", "title", F.row_number().over(order).alias("pos"), F.lag("page_number").over(order).alias("page_before"), F.last("title", ignorenulls=True).over(on_page).alias("title_before"))
    page = F.when(~F.equal_null("page_number", "page_before"), F.concat(F.lit("<!-- page "), F.col("page_number").cast("string"), F.lit(" -->")))
    section = F.when(F.col("title").isNotNull() & ~F.equal_null("title", "title_before"), F.concat(F.lit("## "), "title"))
    body = F.when(F.col("block_type") == "list_item", F.concat(F.lit("- "), "text")).otherwise(F.col("text"))
    return marked.select("document_id", "pos", F.concat_ws("\n", page, section, body).alias("line"))


def markdown_view(lines: DataFrame) -> DataFrame:
    """(document_id, markdown): one text per document. A document is one row, so this is for documents of sane size."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", "line")))
    return lines.groupBy("document_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("markdown"))

"""Normalising parsed blocks: projection, artefacts, reading order, headings, page states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse, excerpt, is_blank

#: Stands for a missing page or order, behind all others.
LAST = 10**9
#: Page states that say nothing about a merge.
IGNORED_STATES = ("not_started", "skipped")


def content_order(page: str = "page_number", order: str = "reading_order_index") -> list[Column]:
    """Sort key of content: page, order within it; what has neither comes last."""
    return [F.coalesce(F.nullif(F.col(page), F.lit(0)), F.lit(LAST)), F.coalesce(F.col(order), F.lit(LAST))]


def running(rows: DataFrame, weight: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``weight`` over a document in content order, up to and with each row.

    Rows are summed within their page, and pages within their document, so that no task holds a whole document.
    """
    page = content_order()[0].alias("_page")
    marked = rows.select("*", page, weight.alias("_weight"))
    inside = Window.partitionBy("document_id", "_page").orderBy(content_order()[1], "block_id").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("document_id").orderBy("_page").rowsBetween(Window.unboundedPreceding, -1)
    pages = marked.groupBy("document_id", "_page").agg(F.sum("_weight").alias("_sum")).select("document_id", "_page", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    summed = marked.withColumn("_run", F.sum("_weight").over(inside)).join(pages, ["document_id", "_page"])
    return summed.select(*rows.columns, (F.col("_run") + F.col("_offset")).alias(name))


def distinct_blocks(blocks: DataFrame, *wanted: str) -> DataFrame:
    """One row per (document_id, block_id): redelivered rows differ in the time of arrival only, the first wins; of
    several that arrived at once, the least.

    With ``wanted`` columns, only those are read and shuffled.
    """
    columns = list(wanted) or [c for c in blocks.columns if c not in {"document_id", "block_id"}]
    plain = [c for c in columns if c != "ingested_at"]
    order = F.struct(*[F.col(c) for c in ("ingested_at", *plain) if c in blocks.columns])
    first = F.min_by(F.struct(*columns), order).alias("r") if len(plain) else F.min(F.struct(*columns)).alias("r")
    return blocks.groupBy("document_id", "block_id").agg(first).select("document_id", "block_id", "r.*")


def project_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks that have a page and a text that is not blank, with an excerpt; a missing order is 0."""
    kept = blocks.where(~is_blank(F.col("text")) & F.col("page_number").isNotNull())
    return kept.select("document_id", "block_id", "page_number", F.coalesce("reading_order_index", F.lit(0)).alias("reading_order_index"), "block_type", "text", excerpt(F.col("text")).alias("excerpt"))


def semantic_blocks(blocks: DataFrame, brands: tuple[str, ...] = (), left_edge: float = 450.0, bottom_edge: float = 60.0) -> DataFrame:
    """Blocks without page footers and without brand marks in the lower right corner (texts in ``brands``)."""
    kept = blocks.where(F.coalesce(F.col("block_type") != "page_footer", F.lit(True)))
    if not brands:
        return kept
    box = F.col("bounding_box")
    corner = (F.col("block_type") == "text") & F.upper(F.trim("text")).isin(*brands) & (box["x0"] >= left_edge) & (F.least(box["y0"], box["y1"]) <= bottom_edge)
    return kept.where(~F.coalesce(corner, F.lit(False)))


def header_signature(text: Column) -> Column:
    return F.lower(collapse(text))


def drop_repeated_headers(blocks: DataFrame) -> DataFrame:
    """Without page and section headers whose text was a page header at least once and stands on several pages."""
    headers = blocks.where(F.col("block_type").isin("page_header", "section_header")).select("document_id", header_signature(F.col("text")).alias("signature"), "page_number", "block_type").where("signature != ''")
    repeated = headers.groupBy("document_id", "signature").agg(F.countDistinct("page_number").alias("pages"), F.max(F.col("block_type") == "page_header").alias("page_header")).where("pages >= 2 AND page_header")
    marked = blocks.withColumn("signature", F.when(F.col("block_type").isin("page_header", "section_header"), header_signature(F.col("text"))))
    return marked.join(repeated.select("document_id", "signature"), ["document_id", "signature"], "left_anti").select(*blocks.columns)


def reading_order(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """(document_id, page_number, kind, item_id, position): items of each page numbered from 0, blocks before tables."""
    items = blocks.select("document_id", "page_number", F.lit(0).alias("rank"), F.lit("block").alias("kind"), F.col("block_id").alias("item_id"), "reading_order_index")
    items = items.unionByName(tables.select("document_id", "page_number", F.lit(1).alias("rank"), F.lit("table").alias("kind"), F.col("table_id").alias("item_id"), "reading_order_index"))
    order = Window.partitionBy("document_id", "page_number").orderBy(F.coalesce("reading_order_index", F.lit(LAST)), "rank", "item_id")
    return items.where("page_number IS NOT NULL").select("document_id", "page_number", "kind", "item_id", (F.row_number().over(order) - 1).alias("position"))


def heading_number(text: Column) -> Column:
    """The numbering in front of a heading: ``1.2.3`` or ``1.`` and ``1)``; empty if there is none."""
    nested = F.regexp_extract(F.trim(text), r"^([0-9]+(?:\.[0-9]+)+)\.?[ \t]+\S", 1)
    top = F.regexp_extract(F.trim(text), r"^([0-9]+)[.)][ \t]*\S", 1)
    return F.when(nested != "", nested).otherwise(top)


def heading_level(text: Column) -> Column:
    """Depth of a numbered heading, 1 for one without a number."""
    number = heading_number(text)
    return F.when(number == "", 1).otherwise(F.size(F.split(number, r"\.")))


def merged_status(states: DataFrame, key: str, state: str) -> DataFrame:
    """(``key``, status) of parts merged into one: success or failed if all are, else partial_success."""
    counted = ~F.col(state).isin(*IGNORED_STATES)
    n = F.count_if(counted)
    status = F.when((n > 0) & (F.count_if(counted & (F.col(state) == "success")) == n), "success").when((n > 0) & (F.count_if(counted & (F.col(state) == "failed")) == n), "failed").otherwise("partial_success")
    return states.groupBy(key).agg(status.alias("status"))


def page_scoped(id_: Column, page: Column) -> Column:
    """An id with the prefix of its page, added once."""
    prefix = F.concat(F.lit("page_"), page.cast("string"), F.lit("_"))
    return F.when(F.startswith(id_, prefix), id_).otherwise(F.concat(prefix, id_))


def assemble_pages(catalog: DataFrame, blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """One row per page of each document with its numbers of blocks and tables; pages without either count 0."""
    pages = catalog.where("page_count > 0").select("document_id", F.explode(F.sequence(F.lit(1), F.col("page_count"))).alias("page_number"))
    b = blocks.groupBy("document_id", "page_number").agg(F.count("*").alias("blocks"))
    t = tables.groupBy("document_id", "page_number").agg(F.count("*").alias("tables"))
    joined = pages.join(b, ["document_id", "page_number"], "left").join(t, ["document_id", "page_number"], "left")
    return joined.select("document_id", "page_number", F.coalesce("blocks", F.lit(0)).alias("blocks"), F.coalesce("tables", F.lit(0)).alias("tables"))

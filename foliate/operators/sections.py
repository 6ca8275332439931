"""Section trees: reconstruction from headings, roll-up, walks and membership."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import materialize
from .blocks import heading_level, heading_number, running


def headings(blocks: DataFrame) -> DataFrame:
    """(document_id, pos, block_id, page_number, title, level, numbered) of the headings in content order."""
    rows = running(blocks.where("block_type = 'section_header'"), F.lit(1), "pos").withColumn("pos", F.col("pos").cast("int"))
    return rows.select("document_id", "pos", "block_id", "page_number", "reading_order_index", F.trim("text").alias("title"), heading_level(F.col("text")).alias("level"), (heading_number(F.col("text")) != "").alias("numbered"))


def heading_parents(rows: DataFrame) -> DataFrame:
    """Adds ``parent_pos``: the nearest earlier numbered heading of a smaller level.

    An unnumbered heading is a root and does not end the numbered ones before it. For each smaller level, the last
    heading of that level is a running value; the nearest of them is the parent. No self-join, whatever the number of
    headings. The levels are those of the table, which is read once for them.
    """
    before = Window.partitionBy("document_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    levels = sorted(r.level for r in rows.where("numbered").select("level").distinct().collect())[:-1]
    seen = [F.max(F.when(F.col("numbered") & (F.col("level") == i), F.col("pos"))).over(before) for i in levels]
    known = rows.select("*", *[c.alias(f"last_{i}") for i, c in zip(levels, seen, strict=True)])
    candidates = F.array(F.lit(None).cast("int"), *[F.when(F.col("level") > i, F.col(f"last_{i}")) for i in levels])
    parent = F.when(F.col("numbered"), F.array_max(candidates))
    return known.select(*rows.columns, parent.alias("parent_pos"))


def reconstruct_sections(blocks: DataFrame) -> DataFrame:
    """Sections of each document: section_id, parent_section_id, title, level, page_start, pos."""
    rows = heading_parents(headings(blocks))
    name = lambda c: F.concat(F.lit("section-"), (F.col(c) - 1).cast("string"))
    return rows.select("document_id", name("pos").alias("section_id"), name("parent_pos").alias("parent_section_id"), "title", "level", F.col("page_number").alias("page_start"), "pos", "block_id")


def active_sections(blocks: DataFrame) -> DataFrame:
    """(document_id, block_id, section_pos): the most recent heading before each other block, null before the first."""
    is_heading = F.col("block_type") == "section_header"
    numbered = running(blocks, F.when(is_heading, 1).otherwise(0), "heading_no")
    return numbered.where(~is_heading).select("document_id", "block_id", F.nullif("heading_no", F.lit(0)).alias("section_pos"))


def ancestor_closure(sections: DataFrame) -> DataFrame:
    """(document_id, ancestor, section_id, distance), each section being its own ancestor at distance 0.

    Distances double in each round, so that a tree of depth d takes log2(d) joins, whatever d is. Where parents form a
    circle, it ends once a round gives no new pair.
    """
    parents = sections.select("document_id", "section_id", F.col("parent_section_id").alias("ancestor")).where("ancestor IS NOT NULL").distinct()
    reach = parents.withColumn("distance", F.lit(1))
    span = 1
    while True:
        reach = materialize(reach)
        ends = reach.where(F.col("distance") == span).select("document_id", F.col("section_id").alias("via"), F.col("ancestor").alias("top"))
        if ends.isEmpty():
            break
        step = reach.select("document_id", "section_id", F.col("ancestor").alias("via"), F.col("distance").alias("d"))
        longer = step.where(F.col("d") == span).join(reach.select("document_id", F.col("section_id").alias("via"), F.col("ancestor"), "distance"), ["document_id", "via"])
        longer = longer.select("document_id", "section_id", "ancestor", (F.col("d") + F.col("distance")).alias("distance"))
        if not reach.where("section_id = ancestor").isEmpty() and longer.join(reach, ["document_id", "section_id", "ancestor"], "left_anti").isEmpty():
            break
        reach = reach.unionByName(longer)
        span *= 2
    own = sections.select("document_id", "section_id", F.col("section_id").alias("ancestor"), F.lit(0).alias("distance")).distinct()
    return own.unionByName(reach).select("document_id", "ancestor", "section_id", "distance")


def rolled_up_pages(sections: DataFrame) -> DataFrame:
    """(document_id, section_id, page_end): the last page of a section and all below it."""
    pages = sections.select("document_id", "section_id", F.greatest("page_start", "page_end").alias("page"))
    joined = ancestor_closure(sections).join(pages, ["document_id", "section_id"])
    return joined.groupBy("document_id", F.col("ancestor").alias("section_id")).agg(F.max("page").alias("page_end"))


def section_paths(sections: DataFrame) -> DataFrame:
    """(document_id, section_id, depth, section_path): titles from the root down."""
    titles = sections.select("document_id", F.col("section_id").alias("ancestor"), "title")
    joined = ancestor_closure(sections).join(titles, ["document_id", "ancestor"])
    path = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("d"), "title"))), lambda x: x["title"])
    return joined.groupBy("document_id", "section_id").agg(F.max("distance").alias("depth"), path.alias("section_path"))


def unsectioned_blocks(blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """Blocks that no section lists, as content or heading."""
    listed = sections.select("document_id", F.explode(F.concat("blocks", F.array("heading_block_id"))).alias("block_id")).distinct()
    return blocks.join(listed, ["document_id", "block_id"], "left_anti")


def block_membership(sections: DataFrame) -> DataFrame:
    """(document_id, block_id, section_id): the first section that lists a block."""
    listed = sections.select("document_id", "section_id", F.regexp_extract("section_id", r"([0-9]+)$", 1).cast("int").alias("n"), F.explode("blocks").alias("block_id"))
    return listed.groupBy("document_id", "block_id").agg(F.min_by("section_id", F.struct("n", "section_id")).alias("section_id"))

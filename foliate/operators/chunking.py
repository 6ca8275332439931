"""Structure-aware chunks of sections, with the blocks and tables that each came from.

Blocks between two tables of a section form a run, which is packed greedily into chunks below a limit; a table is a
chunk of its own and never cut. Each chunk begins with the path of its section; the first of a section also has the
heading among its sources.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, rstrip
from ..plans.storage import materialize
from .blocks import content_order
from .sections import section_paths
from .tables import render_tables, table_body, table_cells

LIMIT = 3000


def context_prefix(path: Column) -> Column:
    return F.when(F.size(path) > 0, F.concat(F.lit("Section: "), F.array_join(path, " > "), F.lit("\n\n"))).otherwise("")


def hard_split(text: Column, limit: Column) -> Column:
    """Fixed slices of at most ``limit`` characters, in order; one empty slice for an empty text."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.greatest(limit, F.lit(1)))
    return F.transform(starts, lambda at: F.substring(text, at + 1, F.greatest(limit, F.lit(1))))


def pack_runs(segments: DataFrame, keys: list[str], limit: int = LIMIT) -> DataFrame:
    """Packs the segments of each run in order into groups that fit; ``keys`` and group_no, segments.

    ``segments`` has ``keys``, ``pos``, ``id``, ``text`` and ``used`` (characters the prefix takes). A segment joins the
    open group if prefix, group, a separator of two characters and the segment fit; the first is always accepted.
    Runs are sorted, not collected: one counter follows each run, whatever its length.
    """
    place = len(segments.columns)
    names = segments.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: tuple | None = None
        size = group = 0
        for batch in batches:
            at = {name: batch.column(names.index(name)) for name in names}
            groups = []
            sizes, used = batch.column(place).to_pylist(), at["used"].to_pylist()
            for i, key in enumerate(zip(*(at[k].to_pylist() for k in keys), strict=True)):
                if key != run:
                    run, size, group = key, used[i] + sizes[i], 0
                else:
                    grown = size + 2 + sizes[i]
                    size, group = (used[i] + sizes[i], group + 1) if grown > limit else (grown, group)
                groups.append(group)
            yield pa.RecordBatch.from_arrays([*(at[k] for k in keys), at["pos"], at["id"], at["text"], pa.array(groups, pa.int32())], names=[*keys, "pos", "id", "text", "group_no"])

    kinds = {f.name: f.dataType.simpleString() for f in segments.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, "pos", "id", "text"]) + ", group_no int"
    ordered = segments.withColumn("length", F.length("text")).repartition(*keys).sortWithinPartitions(*keys, "pos")
    rows = ordered.mapInArrow(number, schema)
    packed = F.transform(F.sort_array(F.collect_list(F.struct("pos", "id", "text"))), lambda x: F.struct(x["id"].alias("id"), x["text"].alias("text")))
    return rows.groupBy(*keys, "group_no").agg(packed.alias("segments"))


def chunk_identity(*fields: object) -> str:
    """A stable id from the canonical JSON of what makes a chunk."""
    names = ("document_id", "section_path", "content_type", "block_ids", "table_ids", "text", "ordinal")
    body = json.dumps(dict(zip(names, fields, strict=True)), ensure_ascii=False, sort_keys=True)
    return "chunk-" + hashlib.sha256(body.encode()).hexdigest()[:20]


def _named(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        columns = (f[c] for c in ("document_id", "section_path", "content_type", "source_block_ids", "source_table_ids", "text", "ordinal"))
        f.insert(0, "chunk_id", [chunk_identity(d, list(p), t, list(b), list(s), x, int(o)) for d, p, t, b, s, x, o in zip(*columns, strict=True)])
        yield f


def chunk_documents(sections: DataFrame, blocks: DataFrame, tables: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Chunks of all sections and of what lies in none: chunk_id, document_id, section_id, section_path, content_type,
    text, page_start, page_end, source_block_ids, source_table_ids, ordinal.

    ``blocks`` and ``tables`` hold one row per id. Blank blocks are left out; a section of nothing but its heading
    becomes one chunk. A text longer than what the prefix leaves is cut into fixed slices.
    """
    paths = section_paths(sections)
    listed = materialize(sections.join(paths, ["document_id", "section_id"], "left")).select("document_id", "section_id", F.coalesce("section_path", F.array().cast("array<string>")).alias("section_path"), "page_start", F.array_distinct("blocks").alias("b"), F.array_distinct("tables").alias("t"), "heading_block_id")
    body = render_tables(materialize(table_cells(tables))).join(tables.select("document_id", "table_id", "native_text", "native_text_coverage", "page_number", "reading_order_index", "page_numbers"), ["document_id", "table_id"])
    body = body.select("document_id", F.col("table_id").alias("id"), F.lit(1).alias("kind"), "page_number", "reading_order_index", table_body(F.col("rendered"), F.col("native_text"), F.col("native_text_coverage")).alias("text"), F.greatest(F.array_max("page_numbers"), "page_number").alias("last_page"), F.least(F.array_min("page_numbers"), "page_number").alias("first_page"))
    prose = blocks.where(~is_blank(F.col("text"))).select("document_id", F.col("block_id").alias("id"), F.lit(0).alias("kind"), "page_number", "reading_order_index", "text", F.col("page_number").alias("last_page"), F.col("page_number").alias("first_page"))
    content = prose.unionByName(body)

    refs = listed.select("document_id", "section_id", F.explode(F.array_except("b", F.array("heading_block_id"))).alias("id"), F.lit(0).alias("kind"))
    refs = refs.unionByName(listed.select("document_id", "section_id", F.explode("t").alias("id"), F.lit(1).alias("kind")))
    known = refs.unionByName(listed.select("document_id", "section_id", F.col("heading_block_id").alias("id"), F.lit(0).alias("kind"))).select("document_id", "id", "kind").distinct()
    loose = content.join(known, ["document_id", "id", "kind"], "left_anti").withColumn("section_id", F.lit(""))
    inside = content.join(refs, ["document_id", "id", "kind"])
    items = inside.select("document_id", "section_id", "id", "kind", "page_number", "reading_order_index", "text", "last_page", "first_page").unionByName(loose.select("document_id", "section_id", "id", "kind", "page_number", "reading_order_index", "text", "last_page", "first_page"))

    order = Window.partitionBy("document_id", "section_id").orderBy(*content_order(), "kind", "id")
    placed = items.withColumn("place", F.row_number().over(order)).withColumn("run", F.sum("kind").over(order))
    heads = listed.select("document_id", "section_id", "section_path", F.length(context_prefix(F.col("section_path"))).alias("used"))
    # Read by every branch below, so it is computed once.
    placed = materialize(placed.join(heads, ["document_id", "section_id"], "left").withColumn("used", F.coalesce("used", F.lit(0))))

    slices = placed.where("kind = 0").select("document_id", "section_id", "run", "place", "id", "used", F.posexplode(hard_split(F.col("text"), F.lit(limit) - F.col("used"))).alias("piece", "text"))
    slices = slices.select("document_id", "section_id", "run", F.struct("place", "piece").alias("pos"), "id", "text", F.col("used").cast("int").alias("used"))
    groups = pack_runs(slices, ["document_id", "section_id", "run"], limit)
    pages = placed.where("kind = 0").select("document_id", "section_id", "id", "page_number")
    texts = groups.select("document_id", "section_id", (F.col("run") * 2).alias("major"), F.col("group_no").alias("minor"), F.array_join(F.transform("segments", lambda s: s["text"]), "\n\n").alias("body"), F.array_distinct(F.transform("segments", lambda s: s["id"])).alias("source_block_ids"))
    span = texts.select("document_id", "section_id", "major", "minor", F.explode("source_block_ids").alias("id")).join(pages, ["document_id", "section_id", "id"]).groupBy("document_id", "section_id", "major", "minor").agg(F.min("page_number").alias("page_start"), F.max("page_number").alias("page_end"))
    none = F.array().cast("array<string>")
    text_chunks = texts.join(span, ["document_id", "section_id", "major", "minor"]).select("*", F.lit("prose").alias("content_type"), none.alias("source_table_ids"))
    table_chunks = placed.where("kind = 1").select("document_id", "section_id", (F.col("run") * 2 - 1).alias("major"), F.lit(0).alias("minor"), F.coalesce("text", F.lit("")).alias("body"), none.alias("source_block_ids"), F.col("first_page").alias("page_start"), F.col("last_page").alias("page_end"), F.lit("table").alias("content_type"), F.array("id").alias("source_table_ids"))
    bare = listed.join(placed.select("document_id", "section_id").distinct(), ["document_id", "section_id"], "left_anti")
    bare = bare.select("document_id", "section_id", F.lit(0).alias("major"), F.lit(0).alias("minor"), F.lit("").alias("body"), F.array_compact(F.array("heading_block_id")).alias("source_block_ids"), "page_start", F.col("page_start").alias("page_end"), F.lit("prose").alias("content_type"), none.alias("source_table_ids"))
    columns = ["document_id", "section_id", "major", "minor", "body", "content_type", "source_block_ids", "source_table_ids", "page_start", "page_end"]
    chunks = text_chunks.select(*columns).unionByName(table_chunks.select(*columns)).unionByName(bare.select(*columns))
    ordinal = F.row_number().over(Window.partitionBy("document_id", "section_id").orderBy("major", "minor")) - 1
    heading = listed.select("document_id", "section_id", F.col("heading_block_id").alias("heading")).join(blocks.select("document_id", F.col("block_id").alias("heading"), F.col("page_number").alias("heading_page")), ["document_id", "heading"])
    chunks = chunks.withColumn("ordinal", ordinal).join(heading, ["document_id", "section_id"], "left")
    first = (F.col("ordinal") == 0) & F.col("heading").isNotNull()
    chunks = chunks.withColumns({
        "source_block_ids": F.when(first, F.array_distinct(F.concat(F.array("heading"), "source_block_ids"))).otherwise(F.col("source_block_ids")),
        "page_start": F.when(first, F.least("page_start", "heading_page")).otherwise(F.col("page_start")),
        "page_end": F.when(first, F.greatest("page_end", "heading_page")).otherwise(F.col("page_end")),
    }).join(heads.drop("used"), ["document_id", "section_id"], "left").withColumn("section_path", F.coalesce("section_path", none))
    out = chunks.select("document_id", F.nullif("section_id", F.lit("")).alias("section_id"), "section_path", "content_type", rstrip(F.concat(context_prefix(F.col("section_path")), "body")).alias("text"), "page_start", "page_end", "source_block_ids", "source_table_ids", F.col("ordinal").cast("int").alias("ordinal"))
    schema = "chunk_id string, document_id string, section_id string, section_path array<string>, content_type string, text string, page_start int, page_end int, source_block_ids array<string>, source_table_ids array<string>, ordinal int"
    return out.mapInPandas(_named, schema)



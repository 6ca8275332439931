"""Cutting oversized items at natural boundaries.

A text above the limit is cut by a recursive hierarchy of separators - section break, paragraph, line, sentence,
word, and at last the single character - into spans that fit; spans are then packed greedily into pieces. Each
piece after the first begins with the last characters of the one before, moved forward to the start of a word if
there is one in the overlap.

Sizes are computed first, on the JVM, so that only the texts of oversized items are assembled and cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 3000
OVERLAP = 200
#: Separators from the widest to the narrowest; a span ends behind its separator.
LEVELS = [
    re.compile(r"\n{3,}|\f+|\n\n(?=#)"),
    re.compile(r"\n[ \t]*\n+"),
    re.compile(r"\n"),
    re.compile(r"[.!?…][\"'”’)\]]*[ \t]+|[。！？]"),
    re.compile(r"[ \t　]+"),
]
#: Space, tab and newline.
TRIM = " \t\n"


def trim_text(c: Column) -> Column:
    return F.btrim(c, F.lit(TRIM))


def _spans(text: str, start: int, end: int, limit: int, level: int) -> Iterator[tuple[int, int]]:
    """Adjacent spans of at most ``limit`` characters that cover text[start:end]."""
    if end - start <= limit:
        yield start, end
        return
    if level == len(LEVELS):
        for at in range(start, end, limit):
            yield at, min(at + limit, end)
        return
    at = start
    for found in LEVELS[level].finditer(text, start, end):
        if found.end() > at and found.start() > start:
            yield from _spans(text, at, found.end(), limit, level + 1)
            at = found.end()
    if at < end:
        yield from _spans(text, at, end, limit, level + 1)


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Offsets (start, end) of the pieces of ``text``; one piece if it fits.

    Without their overlaps the pieces are the text. Every piece has at most ``limit`` characters. Needs
    ``limit > 2 * overlap``.
    """
    if limit <= 2 * overlap:
        raise ValueError("limit must be more than twice the overlap")
    if len(text) <= limit:
        return [(0, len(text))]
    pieces: list[tuple[int, int]] = []
    start = end = 0
    for a, b in _spans(text, 0, len(text), limit - overlap, 0):
        if b - start > limit:
            pieces.append((start, end))
            start = max(start + 1, end - overlap)
            if start > 0 and not text[start - 1].isspace():
                word = re.compile(r"\s+(?=\S)").search(text, start, end)
                if word and word.end() < end:
                    start = word.end()
        end = b
    pieces.append((start, end))
    return pieces


def cut_texts(items: DataFrame, keys: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """One row per piece: ``keys``, piece_no from 0, piece_start, piece_end, n_pieces, text.

    ``items`` has ``keys`` and ``text``; null texts give no rows, an empty text one empty piece. Narrow.
    """
    kinds = dict(items.dtypes)
    names = [*keys, "piece_no", "piece_start", "piece_end", "n_pieces", "text"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for *key, text in frame.itertuples(index=False, name=None):
                pieces = cut(text, limit, overlap)
                rows += [(*key, i, a, b, len(pieces), text[a:b]) for i, (a, b) in enumerate(pieces)]
            yield pd.DataFrame(rows, columns=names)

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", piece_no int, piece_start int, piece_end int, n_pieces int, text string"
    return items.select(*keys, "text").where("text IS NOT NULL").mapInPandas(run, schema)


def oversized_sections(sections: DataFrame, blocks: DataFrame, tables: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(document_id, item_id, text) of the sections whose content exceeds ``limit`` characters.

    A section's content is the trimmed, non-empty text of its different blocks and native text of its different
    tables in order of mention, joined by an empty line; ids without a row and null texts count nothing. Repeated
    rows of a block, table or section count once. Lengths are joined and summed first; texts are fetched for
    oversized sections only.
    """
    listed = sections.select("document_id", "section_id", F.array_distinct("blocks").alias("b"), F.array_distinct("tables").alias("t"))
    refs = listed.select("document_id", "section_id", F.posexplode("b").alias("pos", "part_id")).withColumn("kind", F.lit(0))
    refs = refs.unionByName(listed.select("document_id", "section_id", F.posexplode("t").alias("pos", "part_id")).withColumn("kind", F.lit(1)))
    parts = blocks.select("document_id", F.col("block_id").alias("part_id"), F.lit(0).alias("kind"), trim_text(F.col("text")).alias("text"))
    parts = parts.unionByName(tables.select("document_id", F.col("table_id").alias("part_id"), F.lit(1).alias("kind"), trim_text(F.col("native_text")).alias("text")))
    parts = parts.where(F.length("text") > 0)

    lengths = parts.select("document_id", "part_id", "kind", F.length("text").alias("n")).groupBy("document_id", "part_id", "kind").agg(F.max("n").alias("n"))
    refs = refs.select("document_id", "section_id", "part_id", "kind", "pos").dropDuplicates(["document_id", "section_id", "part_id", "kind"])
    total = refs.join(lengths, ["document_id", "part_id", "kind"]).groupBy("document_id", "section_id").agg((F.sum("n") + 2 * (F.count("*") - 1)).alias("size"))
    large = total.where(F.col("size") > limit).select("document_id", "section_id")

    wanted = refs.join(large, ["document_id", "section_id"])
    texts = parts.groupBy("document_id", "part_id", "kind").agg(F.min("text").alias("text"))
    joined = wanted.join(texts, ["document_id", "part_id", "kind"])
    content = F.sort_array(F.collect_list(F.struct("kind", "pos", "text")))
    return joined.groupBy("document_id", F.col("section_id").alias("item_id")).agg(F.array_join(F.transform(content, lambda x: x["text"]), "\n\n").alias("text"))


def oversized_chunks(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(document_id, item_id, text) of the chunks whose trimmed text exceeds ``limit``; repeated rows count once."""
    rows = chunks.select("document_id", F.col("chunk_id").alias("item_id"), trim_text(F.col("text")).alias("text"))
    return rows.where(F.length("text") > limit).groupBy("document_id", "item_id").agg(F.min("text").alias("text"))


def split_oversized(sections: DataFrame, blocks: DataFrame, tables: DataFrame, chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every section and chunk above ``limit``; see :func:`cut_texts`."""
    large = oversized_sections(sections, blocks, tables, limit).withColumn("item_kind", F.lit("section"))
    large = large.unionByName(oversized_chunks(chunks, limit).withColumn("item_kind", F.lit("chunk")))
    return cut_texts(large, ["item_kind", "document_id", "item_id"], limit, overlap)

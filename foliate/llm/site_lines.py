"""Lines that recur across the documents of one source.

1. Every line is reduced to its words (a-z after lower-casing); distinct (document, line) pairs get their source.
2. Each task keeps one mergeable heavy-hitter summary (Misra-Gries) per source. Its size follows from the source's
   own number of pairs and threshold, so that no line above the threshold can fall out: a summary of k counters
   loses at most pairs / (k + 1) of a count, and k is chosen to keep that below the threshold.
   Summaries are merged in a tree, a few at a time, so that no task ever holds more than ``FAN_IN`` of them.
3. Only the lines that survive are counted exactly, and those at the threshold are confirmed.
4. Confirmed lines are looked up in the blocks again, as a broadcast set while that set is small, else by a join.

A line is confirmed if it occurs in at least ``min_documents`` documents and ``min_share`` of the documents of its
source. Null texts have no lines; repeated rows of a block count once; documents without a source have none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialize, small_enough

#: Summaries of a source that one task merges, and counters that a task holds before it hands its summaries on.
FAN_IN = 16
HELD_COUNTERS = 500_000
#: A confirmed set of at most so many rows is broadcast.
BROADCAST_ROWS = 200_000


def line_words(line: Column) -> Column:
    """What two lines must share to be the same."""
    return F.trim(F.regexp_replace(F.lower(line), "[^a-z]+", " "))


def _lines(blocks: DataFrame, text: str, *keys: str, min_words: int) -> DataFrame:
    rows = blocks.select(*keys, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    rows = rows.select(*keys, (F.col("line_no") + 1).alias("line_no"), line_words(F.col("line")).alias("words"))
    return rows.where(F.size(F.split("words", " ")) >= min_words).select(*keys, "line_no", F.xxhash64("words").alias("line_hash"), "words")


class Summary:
    """Misra-Gries counters of one source; may be merged with another's."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.counts: dict[int, int] = {}

    def add(self, counts: dict[int, int]) -> None:
        mine = self.counts
        for key, n in counts.items():
            mine[key] = mine.get(key, 0) + n
        if len(mine) > self.size:
            cut = sorted(mine.values(), reverse=True)[self.size]
            self.counts = {key: n - cut for key, n in mine.items() if n > cut}


def _summarize(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One summary per source, or several where a task holds too many counters; all may be merged."""
    own: dict[str, Summary] = {}

    def handed_on() -> Iterator[pd.DataFrame]:
        for source, summary in own.items():
            if summary.counts:
                yield pd.DataFrame({"source": source, "size": summary.size, "line_hash": list(summary.counts), "n": list(summary.counts.values())})
        own.clear()

    for frame in frames:
        for (source, size), part in frame.groupby(["source", "size"], sort=False):
            own.setdefault(source, Summary(int(size))).add(part.groupby("line_hash")["n"].sum().to_dict())
        if sum(len(summary.counts) for summary in own.values()) > HELD_COUNTERS:
            yield from handed_on()
    yield from handed_on()


def merged_summaries(partial: DataFrame, tasks: int) -> DataFrame:
    """One summary per source out of those of ``tasks`` tasks: (source, size, line_hash, n), merged in a tree."""
    schema = "source string, size long, line_hash long, n long"
    level = partial.withColumn("place", F.spark_partition_id())

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([*_summarize(iter([frame.drop(columns="place")]))] or [frame.iloc[:0]])[["source", "size", "line_hash", "n"]].assign(place=int(frame["place"].iloc[0]))

    while tasks > 1:
        level = level.withColumn("place", F.expr(f"place div {FAN_IN}").cast("int")).groupBy("source", "place").applyInPandas(merge, f"{schema}, place int")
        tasks = -(-tasks // FAN_IN)
    return level.select("source", "size", "line_hash", "n")


def repeated_lines(blocks: DataFrame, catalog: DataFrame, min_documents: int = 5, min_share: float = 0.1, min_words: int = 3) -> DataFrame:
    """Confirmed lines: (collection, line_hash, words, documents).

    Shuffles hashes, not texts: distinct (document, line) pairs, then counters. A document or a source that holds a
    third of all rows is spread over tasks, as pairs are made distinct by document and line and summaries merge.
    """
    sources = catalog.select("document_id", F.col("collection").alias("source")).where("source IS NOT NULL")
    needed = sources.groupBy("source").agg(F.count("*").alias("rows"))
    needed = needed.select("source", F.greatest(F.lit(min_documents).cast("long"), F.ceil(F.col("rows") * F.lit(min_share) - F.lit(1e-9))).alias("needed"))
    lines = _lines(blocks, "text", "document_id", min_words=min_words)
    pairs = lines.select("document_id", "line_hash").distinct().join(sources.distinct(), "document_id").select("source", "line_hash")
    pairs = materialize(pairs)

    sizes = pairs.groupBy("source").agg(F.count("*").alias("pairs")).join(needed, "source")
    sizes = sizes.select("source", "needed", (F.floor(F.col("pairs") / F.col("needed")) + 1).alias("size"))
    sized = pairs.join(sizes.select("source", "size"), "source").withColumn("n", F.lit(1).cast("long"))
    schema = "source string, size long, line_hash long, n long"
    partial = sized.mapInPandas(_summarize, "source string, size long, line_hash long, n long")
    # Written, as the number of its tasks is that of the leaves of the tree.
    partial = materialize(partial)
    merged = merged_summaries(partial, partial.rdd.getNumPartitions())
    kept = merged.select("source", "line_hash").distinct()

    exact = pairs.join(kept, ["source", "line_hash"]).groupBy("source", "line_hash").agg(F.count("*").alias("documents"))
    return exact.join(sizes, "source").where("documents >= needed").select(F.col("source").alias("collection"), "line_hash", "documents")


def _lookup(rows: DataFrame, confirmed: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows with a (document_id, line_hash) whose line is confirmed in the source of the document."""
    if small_enough(confirmed, BROADCAST_ROWS):
        known = F.broadcast(confirmed)
        rows = rows.join(F.broadcast(confirmed.select("line_hash").distinct()), "line_hash", "left_semi")
    else:
        known = confirmed
    sources = catalog.select("document_id", "collection").where("collection IS NOT NULL").distinct()
    return rows.join(sources, "document_id").join(known.select("collection", "line_hash"), ["collection", "line_hash"])


def repeated_words(blocks: DataFrame, catalog: DataFrame, **limits: float) -> DataFrame:
    """(collection, words, documents): the confirmed lines by their words."""
    confirmed = materialize(repeated_lines(blocks, catalog, **limits))
    lines = _lines(blocks, "text", "document_id", min_words=int(limits.get("min_words", 3)))
    found = _lookup(lines, confirmed, catalog)
    return found.select("collection", "words", "line_hash").distinct().join(confirmed, ["collection", "line_hash"]).select("collection", "words", "documents")


def find_repeated(blocks: DataFrame, catalog: DataFrame, **limits: float) -> DataFrame:
    """(document_id, block_id, line_no, collection) of every confirmed line in every block, distinct."""
    confirmed = materialize(repeated_lines(blocks, catalog, **limits))
    lines = _lines(blocks, "text", "document_id", "block_id", min_words=int(limits.get("min_words", 3)))
    found = _lookup(lines.drop("words"), confirmed, catalog)
    return found.select("document_id", "block_id", F.col("line_no").cast("int").alias("line_no"), "collection").distinct()


def remove_repeated(blocks: DataFrame, catalog: DataFrame, **limits: float) -> DataFrame:
    """The blocks, one row per (document_id, block_id), with ``clean_text`` and ``lines_removed``.

    Null texts stay null. A block of nothing but repeated lines gets an empty ``clean_text``.
    """
    found = find_repeated(blocks, catalog, **limits).groupBy("document_id", "block_id").agg(F.collect_set("line_no").alias("drop_lines"))
    one = blocks.groupBy("document_id", "block_id").agg(F.min("text").alias("text"))
    joined = one.join(found, ["document_id", "block_id"], "left")
    kept = F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains("drop_lines", i + 1))
    clean = F.when(F.col("drop_lines").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.select("document_id", "block_id", clean.alias("clean_text"), F.coalesce(F.size("drop_lines"), F.lit(0)).alias("lines_removed"))

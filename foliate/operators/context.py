"""Packing ranked passages into a context of limited length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank

BUDGET = 20_000
SEPARATOR = 2


def page_label(start: Column, end: Column) -> Column:
    return F.when(start == end, start.cast("string")).otherwise(F.concat_ws("-", start, end))


def render_evidence(label: Column) -> Column:
    """One passage with its head. A passage outside all sections says so; there is no line for notes where there are none."""
    head = F.concat_ws(
        "\n",
        F.concat(F.lit("["), label, F.lit("]")),
        F.concat(F.lit("Document: "), F.col("document_id")),
        F.concat(F.lit("Section: "), F.when(F.size("section_path") > 0, F.array_join("section_path", " > ")).otherwise("NONE")),
        F.concat(F.lit("Pages: "), page_label(F.col("page_start"), F.col("page_end"))),
        F.concat(F.lit("Content type: "), F.col("content_type")),
        F.concat(F.lit("Chunk ID: "), F.col("chunk_id")),
        F.when(F.size("quality_notes") > 0, F.concat(F.lit("Quality notes: "), F.array_join("quality_notes", "; "))),
    )
    return F.concat(head, F.lit("\n\n"), F.col("text"))


def classify_candidates(ranked: DataFrame) -> DataFrame:
    """Adds ``state`` (empty, duplicate, candidate) and ``ordinal`` among the candidates of each query.

    A blank text is empty and does not count as seen; a chunk seen before in the query is a duplicate.
    """
    blank = is_blank(F.col("text"))
    seen = F.row_number().over(Window.partitionBy("query_id", blank, "chunk_id").orderBy("rank"))
    marked = ranked.withColumn("state", F.when(blank, "empty").when(seen > 1, "duplicate").otherwise("candidate"))
    ordinal = F.sum(F.when(F.col("state") == "candidate", 1).otherwise(0)).over(Window.partitionBy("query_id").orderBy("rank"))
    return marked.withColumn("ordinal", ordinal)


def _packed(ranked: DataFrame, budget: int) -> DataFrame:
    # The running size grows with each candidate, so the first that does not fit excludes all behind it.
    rows = classify_candidates(ranked)
    fits = rows.where("state = 'candidate'").withColumn("rendered", render_evidence(F.concat(F.lit("E"), F.col("ordinal").cast("string"))))
    order = Window.partitionBy("query_id").orderBy("ordinal")
    used = F.sum(F.length("rendered")).over(order) + SEPARATOR * (F.col("ordinal") - 1)
    return fits.withColumn("used", used).withColumn("included", F.col("used") <= budget)


def pack_contexts(ranked: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(query_id, evidence_id, chunk_id, rank, rendered_characters, used_characters, rendered) of what fits.

    ``ranked`` has query_id, rank, chunk_id, document_id, section_path, page_start, page_end, content_type,
    quality_notes and text. Nothing is cut; nothing behind the first overflow is taken.
    """
    rows = _packed(ranked, budget).where("included")
    return rows.select("query_id", F.concat(F.lit("E"), F.col("ordinal").cast("string")).alias("evidence_id"), "chunk_id", "rank", F.length("rendered").alias("rendered_characters"), F.col("used").cast("int").alias("used_characters"), "rendered")


def context_texts(ranked: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(query_id, context, evidence_count, used_characters): one row per query with any evidence."""
    rows = pack_contexts(ranked, budget)
    ordered = F.sort_array(F.collect_list(F.struct("used_characters", "rendered")))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["rendered"]), "\n\n").alias("context"), F.count("*").alias("evidence_count"), F.max("used_characters").alias("used_characters"))


def context_exclusions(ranked: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(query_id, rank, chunk_id, reason, rendered_characters, required_characters, remaining_characters, would_fit).

    The characters of a candidate left out are those it would have next to the evidence that was taken.
    """
    packed = _packed(ranked, budget)
    totals = packed.groupBy("query_id").agg(F.count_if("included").alias("taken"), F.coalesce(F.max(F.when(F.col("included"), F.col("used"))), F.lit(0)).alias("total"))
    over = packed.where("NOT included").join(totals, "query_id")
    rendered = F.length(render_evidence(F.concat(F.lit("E"), (F.col("taken") + 1).cast("string"))))
    required = rendered + F.when(F.col("taken") > 0, SEPARATOR).otherwise(0)
    remaining = F.lit(budget) - F.col("total")
    out = over.select("query_id", "rank", "chunk_id", F.lit("budget_exceeded").alias("reason"), rendered.alias("rendered_characters"), required.alias("required_characters"), remaining.cast("int").alias("remaining_characters"), (required <= remaining).alias("would_fit"))
    other = classify_candidates(ranked).where("state != 'candidate'")
    null = lambda kind: F.lit(None).cast(kind)
    return out.unionByName(other.select("query_id", "rank", "chunk_id", F.col("state").alias("reason"), null("int").alias("rendered_characters"), null("int").alias("required_characters"), null("int").alias("remaining_characters"), null("boolean").alias("would_fit")))

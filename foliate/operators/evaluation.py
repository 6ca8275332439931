"""Evaluation of retrieval against required facts."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

CUTOFFS = (1, 3, 5)


def normalise(text: Column) -> Column:
    """Compatibility-normalised text with single blanks."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()))

    return run(text)


def matches_locator(chunk: str = "c", locator: str = "l") -> Column:
    """Whether a chunk is what a locator describes: every clause that the locator has must hold.

    A locator has block_id, table_id, section_path, pages and anchors, each of which may be null or empty.
    """
    c, l = (lambda name: F.col(f"{chunk}.{name}")), (lambda name: F.col(f"{locator}.{name}"))  # noqa: E741
    absent = lambda name: l(name).isNull()
    blank = lambda name: F.coalesce(F.size(l(name)) <= 0, F.lit(True))
    pages = blank("pages") | F.exists(l("pages"), lambda p: (p >= c("page_start")) & (p <= c("page_end")))
    anchors = blank("anchors") | F.forall(l("anchors"), lambda a: c("text").contains(a))
    return F.coalesce((absent("block_id") | F.array_contains(c("source_block_ids"), l("block_id"))) & (absent("table_id") | F.array_contains(c("source_table_ids"), l("table_id"))) & (blank("section_path") | (c("section_path") == l("section_path"))) & pages & anchors, F.lit(False))


def normalised(chunks: DataFrame) -> DataFrame:
    """Chunks with their texts normalised, each once however often a chunk is ranked."""
    return chunks.withColumn("text", normalise(F.col("text")))


def normalised_anchors(locators: DataFrame) -> DataFrame:
    """Locators with their anchors normalised; null anchors are left out of the list."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda x: None if x is None else [" ".join(unicodedata.normalize("NFKC", t).split()) for t in x if t is not None])

    return locators.withColumn("anchors", run(F.col("anchors")))


def label_ranks(rankings: DataFrame, labels: DataFrame) -> DataFrame:
    """(query_id, fact_id, first_rank) for labels of the first form: a list of chunk ids or, only where there is none, of
    sections or pages of one document.

    ``labels`` has query_id, fact_id, document_id, chunk_ids, section_ids and pages; lists may be null or empty. A label
    of nothing matches nothing.
    """
    c, l = rankings.alias("c"), labels.alias("l")  # noqa: E741
    given = lambda name: F.coalesce(F.size(f"l.{name}") > 0, F.lit(False))
    section = given("section_ids") & F.coalesce(F.array_contains("l.section_ids", F.col("c.section_id")), F.lit(False))
    page = given("pages") & F.exists("l.pages", lambda p: (p >= F.col("c.page_start")) & (p <= F.col("c.page_end")))
    fits = F.when(given("chunk_ids"), F.array_contains("l.chunk_ids", F.col("c.chunk_id"))).otherwise(section | page)
    met = l.join(c, (F.col("c.query_id") == F.col("l.query_id")) & (F.col("c.document_id") == F.col("l.document_id")) & F.coalesce(fits, F.lit(False)))
    first = met.groupBy(F.col("l.query_id").alias("query_id"), F.col("l.fact_id").alias("fact_id")).agg(F.min("c.rank").alias("first_rank"))
    return labels.select("query_id", "fact_id").distinct().join(first, ["query_id", "fact_id"], "left")


def fact_ranks(rankings: DataFrame, locators: DataFrame) -> DataFrame:
    """(query_id, fact_id, first_rank): the first passage that shows a fact, null if none does.

    ``rankings`` has query_id, rank and chunk columns; ``locators`` query_id, document_id, fact_id and the clauses.
    Passages of another document never match. Texts and anchors are compared as :func:`normalise` leaves them.
    """
    c, l = normalised(rankings).alias("c"), normalised_anchors(locators).alias("l")  # noqa: E741
    met = l.join(c, (F.col("c.query_id") == F.col("l.query_id")) & (F.col("c.document_id") == F.col("l.document_id")) & matches_locator())
    first = met.groupBy(F.col("l.query_id").alias("query_id"), F.col("l.fact_id").alias("fact_id")).agg(F.min("c.rank").alias("first_rank"))
    return locators.select("query_id", "fact_id").distinct().join(first, ["query_id", "fact_id"], "left")


def coverage(ranks: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """Per query: facts, first_relevant_rank, and for each cutoff covered, any and full."""
    columns = [F.count("*").alias("facts"), F.min("first_rank").alias("first_relevant_rank")]
    for k in cutoffs:
        n = F.count_if(F.coalesce(F.col("first_rank") <= k, F.lit(False)))
        columns += [n.alias(f"covered_{k}"), (n > 0).cast("int").alias(f"any_{k}"), (n == F.count("*")).cast("int").alias(f"full_{k}")]
    return ranks.groupBy("query_id").agg(*columns)


def metrics(covered: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS, mrr_cutoff: int = 5) -> DataFrame:
    """One row of means over all queries; empty input gives a row of nulls and 0 queries."""
    columns = [F.count("*").alias("queries")]
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    for k in cutoffs:
        columns += [mean(F.col(f"any_{k}").cast("double"), f"any_evidence_{k}"), mean(F.col(f"full_{k}").cast("double"), f"full_coverage_{k}"), mean(F.col(f"covered_{k}") / F.col("facts"), f"fact_coverage_{k}")]
    columns.append(mean(F.when(F.col("first_relevant_rank") <= mrr_cutoff, 1.0 / F.col("first_relevant_rank")).otherwise(0.0), "mrr"))
    return covered.agg(*columns)


def compare(base: DataFrame, other: DataFrame, cutoff: int = 5) -> DataFrame:
    """(query_id, base_rank, other_rank, change): recovered if only the other covers a query fully, regressed if only
    the base does, else same."""
    a = base.select("query_id", F.col("first_relevant_rank").alias("base_rank"), F.col(f"full_{cutoff}").alias("a"))
    b = other.select("query_id", F.col("first_relevant_rank").alias("other_rank"), F.col(f"full_{cutoff}").alias("b"))
    change = F.when(F.col("a") < F.col("b"), "recovered").when(F.col("a") > F.col("b"), "regressed").otherwise("same")
    return a.join(b, "query_id").select("query_id", "base_rank", "other_rank", change.alias("change"))


def compare_strategies(covered: dict[str, DataFrame], base: str, cutoff: int = 5) -> DataFrame:
    """(query_id, strategy, first_relevant_rank, full, change) of any number of strategies, each against ``base``."""
    start = covered[base].select("query_id", F.col(f"full_{cutoff}").alias("base_full"))
    parts = [df.select("query_id", F.lit(name).alias("strategy"), "first_relevant_rank", F.col(f"full_{cutoff}").alias("full")) for name, df in covered.items()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    change = F.when(F.col("base_full") < F.col("full"), "recovered").when(F.col("base_full") > F.col("full"), "regressed").otherwise("same")
    return rows.join(start, "query_id").select("query_id", "strategy", "first_relevant_rank", "full", change.alias("change"))


def evaluate(queries: DataFrame, retrieve: Callable[[DataFrame], DataFrame], locators: DataFrame) -> DataFrame:
    """Coverage of every query by a retriever, which gets (query_id, document_id, question) and returns ranked chunks.

    Passages of other documents than the expected one are left out and the rest ranked anew.
    """
    wanted = queries.select("query_id", F.col("document_id").alias("expected"))
    found = retrieve(queries).join(wanted, "query_id").where(F.col("document_id") == F.col("expected")).drop("expected")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "chunk_id")))
    return coverage(fact_ranks(ranked, locators.join(queries.select("query_id"), "query_id", "left_semi")))


def rerank_comparison(dense: DataFrame, reranked: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, dense_rank, reranked_rank, moved): where the first chunk of ``gold`` (query_id, chunk_id) stands before
    and after reranking; null where it is not among the candidates."""
    first = lambda df, name: gold.join(df.select("query_id", "chunk_id", "rank"), ["query_id", "chunk_id"]).groupBy("query_id").agg(F.min("rank").alias(name))
    rows = gold.select("query_id").distinct().join(first(dense, "dense_rank"), "query_id", "left").join(first(reranked, "reranked_rank"), "query_id", "left")
    moved = F.when(F.col("dense_rank") > F.col("reranked_rank"), "up").when(F.col("dense_rank") < F.col("reranked_rank"), "down").when(F.col("dense_rank").isNotNull(), "same")
    return rows.select("query_id", "dense_rank", "reranked_rank", moved.alias("moved"))


def metric_report(rows: list[tuple[str, Row]]) -> str:
    """A fixed-width table of the metrics of named strategies, one row of :func:`metrics` for each."""
    names = [n for n in (rows[0][1].asDict() if rows else {}) if n != "queries"]
    head = f"{'strategy':<20}{'queries':>9}" + "".join(f"{n:>18}" for n in names)
    show = lambda v: f"{'-':>18}" if v is None else f"{v:>18.4f}"
    return "\n".join([head, *(f"{name:<20}{row['queries']:>9}" + "".join(show(row[n]) for n in names) for name, row in rows)])


def audit_locators(locators: DataFrame, chunks: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, fact_id, matches, verdict): zero, ok or unexpectedly_many chunks of the document match a locator."""
    c, l = normalised(chunks).alias("c"), normalised_anchors(locators).alias("l")  # noqa: E741
    met = l.join(c, (F.col("c.document_id") == F.col("l.document_id")) & matches_locator()).select("l.query_id", "l.fact_id", "c.chunk_id").distinct()
    counted = locators.select("query_id", "fact_id").distinct().join(met, ["query_id", "fact_id"], "left").groupBy("query_id", "fact_id").agg(F.count("chunk_id").alias("matches"))
    return counted.withColumn("verdict", F.when(F.col("matches") == 0, "zero").when(F.col("matches") > most, "unexpectedly_many").otherwise("ok"))


def dataset_problems(locators: DataFrame) -> DataFrame:
    """(query_id, fact_id, problem) of locators that say nothing, have blank anchors, or repeat."""
    has = F.col("block_id").isNotNull() | F.col("table_id").isNotNull() | (F.size("section_path") > 0) | (F.size("pages") > 0) | (F.size("anchors") > 0)
    unscoped = locators.where(~F.coalesce(has, F.lit(False))).select("query_id", "fact_id", F.lit("unscoped").alias("problem"))
    blank = locators.where(F.exists("anchors", lambda a: F.length(F.trim(a)) == 0)).select("query_id", "fact_id", F.lit("blank_anchor").alias("problem"))
    repeated = locators.groupBy("query_id", "fact_id", *[F.to_json(F.struct("block_id", "table_id", "section_path", "pages", "anchors")).alias("j")]).agg(F.count("*").alias("n")).where("n > 1").select("query_id", "fact_id", F.lit("repeated").alias("problem"))
    return unscoped.unionByName(blank).unionByName(repeated)

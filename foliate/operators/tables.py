"""Tables: cells, rows, rendering, and how well native text covers them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse

#: Below this coverage, native text stands in for the rendered table.
LEAST_COVERAGE = 0.85


def distinct_tables(tables: DataFrame) -> DataFrame:
    """One row per (document_id, table_id)."""
    columns = [c for c in tables.columns if c not in {"document_id", "table_id"}]
    return tables.groupBy("document_id", "table_id").agg(F.min(F.struct(*columns)).alias("r")).select("document_id", "table_id", "r.*")


def table_cells(tables: DataFrame) -> DataFrame:
    """One row per cell; of several with one id, the first. A missing id is made of table, row and column."""
    rows = tables.select("document_id", "table_id", F.posexplode("cells").alias("pos", "c"))
    named = F.coalesce(F.col("c.cell_id"), F.concat_ws("", F.col("table_id"), F.lit("-r"), F.col("c.row_index"), F.lit("-c"), F.col("c.column_index")))
    rows = rows.select("document_id", "table_id", named.alias("cell_id"), "pos", "c")
    first = rows.groupBy("document_id", "table_id", "cell_id").agg(F.min_by("c", "pos").alias("c"), F.min("pos").alias("pos"))
    span = lambda name: F.greatest(F.coalesce(F.col(f"c.{name}"), F.lit(1)), F.lit(1)).alias(name)
    return first.select("document_id", "table_id", "cell_id", "pos", F.col("c.row_index").alias("row_index"), F.col("c.column_index").alias("column_index"), F.col("c.text").alias("text"), span("row_span"), span("column_span"), F.coalesce("c.is_header", F.lit(False)).alias("is_header"))


def table_grid(cells: DataFrame) -> DataFrame:
    """(document_id, table_id, row_index, column_index, text): every slot of the grid once.

    A cell fills the columns it spans, a later cell before an earlier one; rows below that it spans are filled only
    where the table has the row and the slot is empty. True blanks stay blank.
    """
    wide = cells.select("document_id", "table_id", "pos", "row_index", "row_span", collapse(F.coalesce("text", F.lit(""))).alias("text"), F.explode(F.sequence(F.col("column_index"), F.col("column_index") + F.col("column_span") - 1)).alias("column_index"))
    high = wide.select("document_id", "table_id", "pos", "text", "column_index", F.col("row_index").alias("own_row"), F.explode(F.sequence(F.col("row_index"), F.col("row_index") + F.col("row_span") - 1)).alias("row_index"))
    rows = cells.select("document_id", "table_id", "row_index").distinct()
    filled = high.join(rows, ["document_id", "table_id", "row_index"], "left_semi")
    direct = F.col("row_index") == F.col("own_row")
    best = F.max_by("text", F.struct(direct.cast("int"), F.when(direct, F.col("pos")).otherwise(-F.col("pos"))))
    slots = filled.groupBy("document_id", "table_id", "row_index", "column_index").agg(best.alias("text"))
    columns = slots.groupBy("document_id", "table_id").agg(F.max("column_index").alias("last"))
    dense = rows.join(columns, ["document_id", "table_id"]).select("document_id", "table_id", "row_index", F.explode(F.sequence(F.lit(0), "last")).alias("column_index"))
    return dense.join(slots, ["document_id", "table_id", "row_index", "column_index"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def render_tables(cells: DataFrame) -> DataFrame:
    """(document_id, table_id, rows, rendered): cells joined by bars, rows by newlines."""
    line = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("column_index", "text"))), lambda x: x["text"]), " | ")
    lines = table_grid(cells).groupBy("document_id", "table_id", "row_index").agg(line.alias("line"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row_index", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("document_id", "table_id").agg(F.count("*").alias("rows"), body.alias("rendered"))


def markdown_tables(cells: DataFrame) -> DataFrame:
    """(document_id, table_id, markdown): padded columns of at least three characters, a rule after the first row."""
    grid = table_grid(cells).withColumn("text", F.replace("text", F.lit("|"), F.lit("\\|")))
    widths = grid.groupBy("document_id", "table_id", "column_index").agg(F.greatest(F.max(F.length("text")), F.lit(3)).alias("width"))
    padded = grid.join(widths, ["document_id", "table_id", "column_index"]).withColumn("text", F.rpad("text", F.col("width"), F.lit(" ")))
    ordered = F.sort_array(F.collect_list(F.struct("column_index", "text", "width")))
    row = F.concat(F.lit("| "), F.array_join(F.transform(ordered, lambda x: x["text"]), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(ordered, lambda x: F.repeat(F.lit("-"), x["width"])), " | "), F.lit(" |"))
    lines = padded.groupBy("document_id", "table_id", "row_index").agg(row.alias("row"), rule.alias("rule"))
    all_rows = F.sort_array(F.collect_list(F.struct("row_index", "row", "rule")))
    first = F.concat_ws("\n", all_rows[0]["row"], all_rows[0]["rule"])
    rest = F.transform(F.filter(all_rows, lambda _, i: i > 0), lambda x: x["row"])
    return lines.groupBy("document_id", "table_id").agg(F.concat_ws("\n", first, rest).alias("markdown"))


def text_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9%]+)"), 1)


def token_coverage(source: DataFrame, candidate: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, coverage): share of the source's tokens, with multiplicity, that the candidate has; 1 without tokens.

    ``source`` and ``candidate`` have ``keys`` and ``text``.
    """
    count = lambda df, name: df.select(*keys, F.explode(text_tokens(F.col("text"))).alias("token")).groupBy(*keys, "token").agg(F.count("*").alias(name))
    both = count(source, "n").join(count(candidate, "m"), [*keys, "token"], "left")
    shares = both.groupBy(*keys).agg((F.sum(F.least("n", F.coalesce("m", F.lit(0)))) / F.sum("n")).alias("coverage"))
    return source.select(*keys).distinct().join(shares, keys, "left").select(*keys, F.coalesce("coverage", F.lit(1.0)).alias("coverage"))


def table_body(rendered: Column, native: Column, coverage: Column) -> Column:
    """Native text where the table does not cover it well, else the rendered table."""
    poor = coverage.isNotNull() & ~F.isnan(coverage) & (coverage < LEAST_COVERAGE) & (F.length(native) > 0)
    return F.when(poor, native).otherwise(rendered)

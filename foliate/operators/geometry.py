"""Words of a page and the cells of a table: which word lies where, and repair of merged rows."""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import LEAST_COVERAGE, token_coverage


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def overlap_ratio(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap as a share of the smaller extent; 0 if that has none."""
    smaller = F.least(a1 - a0, b1 - b0)
    return F.when(smaller > 0, overlap(a0, a1, b0, b1) / smaller).otherwise(0.0)


def flip_vertical(y0: Column, y1: Column, height: Column, origin: Column) -> tuple[Column, Column]:
    """Vertical extent from the top, for boxes that count from the bottom."""
    bottom = F.lower(origin).contains("bottom")
    return F.when(bottom, height - F.greatest(y0, y1)).otherwise(F.least(y0, y1)), F.when(bottom, height - F.least(y0, y1)).otherwise(F.greatest(y0, y1))


def words_in_boxes(words: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Words whose centre lies in a box, borders included; both sides are joined on their page first.

    ``words`` has ``keys``, text, x0, y0, x1, y1; ``boxes`` has ``keys``, box_id, bx0, by0, bx1, by1.
    """
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    return words.join(boxes, keys).where((x >= F.col("bx0")) & (x <= F.col("bx1")) & (y >= F.col("by0")) & (y <= F.col("by1"))).select(*keys, "box_id", "text", "x0", "y0", "x1", "y1")


def row_bands(words: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``band``: a word that overlaps none before it, from the top, begins a new band.

    Exact for words of positive height; others are left out.
    """
    order = Window.partitionBy(*keys).orderBy("y0", "x0", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = words.where("y1 > y0").withColumn("begins", F.coalesce((F.max("y1").over(before) <= F.col("y0")).cast("int"), F.lit(0)))
    return rows.withColumn("band", F.sum("begins").over(order)).drop("begins")


def native_texts(words: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, box_id, native_text): the words of each box in reading order, bands on lines of their own."""
    inside = row_bands(words_in_boxes(words, boxes, keys), [*keys, "box_id"])
    lines = inside.groupBy(*keys, "box_id", "band").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " ").alias("line"))
    return lines.groupBy(*keys, "box_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("band", "line"))), lambda x: x["line"]), "\n").alias("native_text"))


def _bands(words: pd.DataFrame) -> list[tuple[float, float, float, float, str]]:
    """The lines that words stand on, from the top: x0, y0, x1, y1 and text. Words of a line overlap in height."""
    lines: list[pd.DataFrame] = []
    for _, word in words.sort_values(["y0", "x0"]).iterrows():
        if lines and ((lines[-1]["y1"] > word["y0"]) & (lines[-1]["y0"] < word["y1"])).any():
            lines[-1] = pd.concat([lines[-1], word.to_frame().T])
        else:
            lines.append(word.to_frame().T)
    return [(w["x0"].min(), w["y0"].min(), w["x1"].max(), w["y1"].max(), " ".join(w.sort_values("x0")["text"])) for w in lines]


def _rows_beside(band: tuple, others: pd.DataFrame) -> set[int]:
    """Rows of which at least two of the other columns share four fifths of the smaller height with a band."""
    height = np.minimum(others["y1"] - others["y0"], band[3] - band[1])
    shared = np.minimum(others["y1"], band[3]) - np.maximum(others["y0"], band[1])
    level = others[(height > 0) & (shared >= 0.8 * height)]
    counted = level.groupby("row_index")["column_index"].nunique()
    return set(counted.index[counted >= 2])


def _one_blank(text: str) -> str:
    return " ".join(text.split())


def _centred_label(label: Any, bands: list[tuple], own: list[tuple]) -> bool:
    """Whether a cell of one line, whose words it holds exactly, reaches all bands and stands in the middle of them."""
    middles = [(b[1] + b[3]) / 2 for b in bands]
    step = min(b - a for a, b in zip(middles, middles[1:], strict=False))
    whole = len(own) == 1 and _one_blank(own[0][4]) == _one_blank(label.text)
    reaches = all(min(label.y1, b[3]) > max(label.y0, b[1]) for b in bands)
    return whole and reaches and abs((label.y0 + label.y1) / 2 - sum(middles) / len(middles)) <= 0.1 * step


def repair_tables(cells: DataFrame, words: DataFrame) -> DataFrame:
    """Cells of tables, where one cell that swallowed the lines of several rows is cut into those rows.

    ``cells`` has document_id, table_id, row_index, column_index, row_span, column_span, text, x0, y0, x1, y1; ``words`` has
    document_id, table_id, text and its box. A cell is only cut if all of this holds: it spans one row and one column; its
    words, line by line, are its text; each line lies in exactly one row, by at least two other columns, and these rows
    follow one another from its own; no other cell is in the way; and a label of one line in its row stands in the middle
    of the lines with nothing below it. The label then spans those rows. All else is left as it is.
    """
    columns = ["document_id", "table_id", "row_index", "column_index", "row_span", "column_span", "text", "x0", "y0", "x1", "y1"]

    def run(key: tuple, grid: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        grid = grid.reset_index(drop=True)
        single = grid[(grid["row_span"] == 1) & (grid["column_span"] == 1) & (grid["text"].fillna("").str.strip() != "") & grid["x0"].notna()]
        middle_x, middle_y = (found["x0"] + found["x1"]) / 2, (found["y0"] + found["y1"]) / 2
        taken = set(zip(grid["row_index"], grid["column_index"], strict=True))
        lines = {c.Index: _bands(found[middle_x.between(c.x0, c.x1) & middle_y.between(c.y0, c.y1)]) for c in single.itertuples()}
        cut: dict[int, list[tuple]] = {}
        spans: dict[int, int] = {}
        for cell in single.itertuples():
            bands = lines[cell.Index]
            if len(bands) < 2 or _one_blank(" ".join(b[4] for b in bands)) != _one_blank(cell.text):
                continue
            rows = range(cell.row_index, cell.row_index + len(bands))
            beside = single[single["column_index"] != cell.column_index]
            if any(_rows_beside(band, beside) != {row} for band, row in zip(bands, rows, strict=True)) or any((row, cell.column_index) in taken for row in rows[1:]):
                continue
            labels = [c.Index for c in beside[beside["row_index"] == cell.row_index].itertuples() if not any((row, c.column_index) in taken for row in rows[1:]) and _centred_label(c, bands, lines[c.Index])]
            if labels:
                cut[cell.Index] = [(*key, row, cell.column_index, 1, 1, band[4], *band[:4]) for row, band in zip(rows, bands, strict=True)]
                spans.update(dict.fromkeys(labels, len(bands)))
        grid.loc[list(spans), "row_span"] = list(spans.values())
        kept = grid.drop(index=list(cut))[columns]
        added = pd.DataFrame([row for rows in cut.values() for row in rows], columns=columns)
        return pd.concat([kept, added]) if len(added) else kept

    schema = "document_id string, table_id string, row_index int, column_index int, row_span int, column_span int, text string, x0 double, y0 double, x1 double, y1 double"
    left = cells.select(*columns).groupBy("document_id", "table_id")
    return left.cogroup(words.select("document_id", "table_id", "text", "x0", "y0", "x1", "y1").groupBy("document_id", "table_id")).applyInPandas(run, schema)


def native_gate(tables: DataFrame, words: DataFrame, least: float = LEAST_COVERAGE) -> DataFrame:
    """(document_id, table_id, native_text, coverage, gate): the words inside each table against its own text.

    ``tables`` has document_id, table_id, page_number, text and a box; ``words`` document_id, page_number, text and a box.
    ``gate`` is ``native`` where the words cover less of the table than ``least`` (they stand in for it), ``repair`` where
    they cover enough for a repair, ``none`` where there are no words.
    """
    boxes = tables.select("document_id", "page_number", F.col("table_id").alias("box_id"), F.col("x0").alias("bx0"), F.col("y0").alias("by0"), F.col("x1").alias("bx1"), F.col("y1").alias("by1"))
    native = native_texts(words, boxes, ["document_id", "page_number"])
    native = native.select("document_id", F.col("box_id").alias("table_id"), "native_text")
    covered = token_coverage(tables.select("document_id", "table_id", "text"), native.select("document_id", "table_id", F.col("native_text").alias("text")), ["document_id", "table_id"])
    gate = F.when(F.col("native_text").isNull(), "none").when(F.col("coverage") < least, "native").otherwise("repair")
    return tables.select("document_id", "table_id").distinct().join(native, ["document_id", "table_id"], "left").join(covered, ["document_id", "table_id"], "left").select("document_id", "table_id", "native_text", "coverage", gate.alias("gate"))


def table_notes(tables: DataFrame) -> DataFrame:
    """(document_id, table_id, caption, quality_notes): captions as one text, null if blank, and a note on what is missing."""
    caption = F.nullif(F.trim(F.array_join("captions", " ")), F.lit(""))
    lacks = F.when(F.col("cells").isNull(), F.array(F.lit("Table item has no table data."))).when(F.size("cells") == 0, F.array(F.lit("Table item has no row grid."))).otherwise(F.array().cast("array<string>"))
    return tables.select("document_id", "table_id", caption.alias("caption"), lacks.alias("quality_notes"))

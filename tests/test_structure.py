from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliate.operators import blocks as B
from foliate.operators import chunking, extraction, geometry
from foliate.operators import sections as S
from foliate.operators import tables as T

BLOCK = "document_id string, block_id string, page_number int, reading_order_index int, block_type string, text string"


def _blocks(spark, rows, document="d"):
    return spark.createDataFrame([(document, f"b{i:03}", *r) for i, r in enumerate(rows)], BLOCK)


def test_levels(spark):
    df = spark.createDataFrame([("1.2.3 Deep",), ("1. Top",), ("2) Top",), ("1.2Foo",), ("2024 Report",), ("Plain",), (None,)], "t string")
    got = {r.t: r.l for r in df.select("t", B.heading_level(F.col("t")).alias("l")).collect()}
    assert got["1.2.3 Deep"] == 3 and got["1. Top"] == 1 and got["2024 Report"] == 1 and got["Plain"] == 1


def _stack(levels):
    """Parents by a stack of numbered headings; None stands for an unnumbered one."""
    out, stack = [], []
    for i, level in enumerate(levels):
        if level is None:
            out.append(None)
            continue
        while stack and stack[-1][0] >= level:
            stack.pop()
        out.append(stack[-1][1] if stack else None)
        stack.append((level, i))
    return out


def test_parents_equal_the_stack(spark):
    rng = random.Random(4)
    cases = [[rng.choice([None, 1, 2, 3, 4]) for _ in range(rng.randint(1, 12))] for _ in range(60)]
    rows = [(f"d{c}", f"b{i:02}", 1, i, "section_header", "Plain" if level is None else ".".join(["1"] * level) + (". T" if level == 1 else " T")) for c, case in enumerate(cases) for i, level in enumerate(case)]
    got = {(r.document_id, r.section_id): r.parent_section_id for r in S.reconstruct_sections(spark.createDataFrame(rows, BLOCK)).collect()}
    for c, case in enumerate(cases):
        for i, parent in enumerate(_stack(case)):
            assert got[f"d{c}", f"section-{i}"] == (None if parent is None else f"section-{parent}")


def test_repeated_headers_and_one_offs(spark):
    rows = [(1, 0, "page_header", "Head  line"), (2, 0, "section_header", "head line"), (1, 1, "section_header", "Real"), (3, 0, "section_header", "Real"), (1, 2, "page_header", "Once"), (1, 3, "text", "head line"), (1, 4, None, None)]
    left = {r.text for r in B.drop_repeated_headers(_blocks(spark, rows)).collect()}
    assert left == {"Real", "Once", "head line", None}


def test_order_status_and_prefix(spark):
    blocks = _blocks(spark, [(1, None, "text", "z"), (1, 4, "text", "a"), (20, 1, "text", "b"), (None, 0, "text", "c")])
    tables = spark.createDataFrame([("d", "t1", 1, 4)], "document_id string, table_id string, page_number int, reading_order_index int")
    got = [(r.page_number, r.item_id, r.position) for r in B.reading_order(blocks, tables).orderBy("page_number", "position").collect()]
    assert got == [(1, "b001", 0), (1, "t1", 1), (1, "b000", 2), (20, "b002", 0)]
    states = spark.createDataFrame([("a", "success"), ("a", "skipped"), ("b", "failed"), ("c", "success"), ("c", "failed"), ("e", "skipped")], "k string, s string")
    assert {r.k: r.status for r in B.merged_status(states, "k", "s").collect()} == {"a": "success", "b": "failed", "c": "partial_success", "e": "partial_success"}
    assert blocks.select(B.page_scoped(B.page_scoped(F.lit("x"), F.lit(2)), F.lit(2))).first()[0] == "page_2_x"


def test_deep_closure(spark):
    rows = [("d", f"s{i}", f"s{i - 1}" if i else None, f"T{i}", i, i) for i in range(20)] + [("d", "lone", None, "L", 3, None)]
    df = spark.createDataFrame(rows, "document_id string, section_id string, parent_section_id string, title string, page_start int, page_end int")
    paths = {r.section_id: list(r.section_path) for r in S.section_paths(df).collect()}
    assert paths["s19"] == [f"T{i}" for i in range(20)] and paths["lone"] == ["L"]
    pages = {r.section_id: r.page_end for r in S.rolled_up_pages(df).collect()}
    assert set(pages[f"s{i}"] for i in range(20)) == {19} and pages["lone"] == 3


def _table(spark, cells, **more):
    cell = "cell_id string, row_index int, column_index int, text string, row_span int, column_span int, is_header boolean"
    row = ("d", "t", [(f"c{i}", *c) for i, c in enumerate(cells)], more.get("native"), more.get("coverage"), 1, 0, [1])
    return spark.createDataFrame([row], f"document_id string, table_id string, cells array<struct<{cell.replace(' string', ':string').replace(' int', ':int').replace(' boolean', ':boolean')}>>, native_text string, native_text_coverage double, page_number int, reading_order_index int, page_numbers array<int>")


def test_spans_and_blanks(spark):
    cells = [(0, 0, "A  B", 1, 2, True), (0, 2, "C", 3, 1, True), (1, 0, "", 1, 1, False), (1, 1, "x|y", 1, 1, False)]
    table = _table(spark, cells)
    got = T.render_tables(T.table_cells(table)).first()
    assert got.rendered == "A B | A B | C\n | x|y | C"
    lines = T.markdown_tables(T.table_cells(table)).first().markdown.split("\n")
    assert lines[0] == "| A B | A B  | C   |" and lines[1] == "| --- | ---- | --- |" and lines[2] == "|     | x\\|y | C   |"


def test_row_units(spark):
    cells = [(0, 0, "Name", 1, 1, True), (0, 1, "Age", 1, 1, True), (1, 0, "Ann", 1, 1, False), (1, 1, " ", 1, 1, False), (2, 0, None, 1, 1, False)]
    table = _table(spark, cells)
    rows = extraction.table_row_units(T.table_cells(table), table).collect()
    assert [(r.unit_id, r.text, r.cell_ids) for r in rows] == [("t-row-1", "Name: Ann", ["c2"])]


def test_coverage(spark):
    s = spark.createDataFrame([("a", "x x y 5%"), ("b", ""), ("c", "x")], "k string, text string")
    c = spark.createDataFrame([("a", "x 5% z"), ("c", None)], "k string, text string")
    assert {r.k: round(r.coverage, 4) for r in T.token_coverage(s, c, ["k"]).collect()} == {"a": 0.5, "b": 1.0, "c": 0.0}


def _greedy(lengths, used, limit):
    groups, size = [], None
    for n in lengths:
        grown = None if size is None else size + 2 + n  # a separator before every segment but the first
        if grown is None or grown > limit:
            groups.append([n])
            size = used + n
        else:
            groups[-1].append(n)
            size = grown
    return groups


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), min_size=1, max_size=12), min_size=1, max_size=6))
def test_packing_equals_the_loop(spark, runs):
    rows = [(k, i, f"{k}-{i}", "x" * n, 7) for k, run in enumerate(runs) for i, n in enumerate(run)]
    df = spark.createDataFrame(rows, "k int, pos int, id string, text string, used int")
    got = {}
    for r in chunking.pack_runs(df, ["k"], 40).orderBy("k", "group_no").collect():
        got.setdefault(r.k, []).append([len(s.text) for s in r.segments])
    assert got == {k: _greedy(run, 7, 40) for k, run in enumerate(runs)}


def test_chunks_of_a_small_document(spark):
    blocks = _blocks(spark, [(1, 0, "section_header", "1 Intro"), (1, 1, "paragraph", "First."), (1, 2, "paragraph", "y" * 300), (1, 4, "paragraph", "Last."), (2, 0, "section_header", "2 Bare"), (3, 0, "paragraph", "Loose"), (3, 1, "paragraph", "  ")])
    table = _table(spark, [(0, 0, "h", 1, 1, True), (1, 0, "v", 1, 1, False)], native="native words", coverage=0.5).withColumn("reading_order_index", F.lit(3))
    sections = spark.createDataFrame([("d", "s0", None, "1 Intro", 1, 1, 1, "b000", ["b001", "b002", "b001", "b003", "gone"], ["t"]), ("d", "s1", None, "2 Bare", 1, 2, None, "b004", [], [])], "document_id string, section_id string, parent_section_id string, title string, level int, page_start int, page_end int, heading_block_id string, blocks array<string>, tables array<string>")
    rows = chunking.chunk_documents(sections, blocks, table, 120).collect()
    texts = {(r.section_id, r.ordinal): r.text for r in rows}
    assert texts["s0", 0].startswith("Section: 1 Intro\n\nFirst.") and texts["s1", 0] == "Section: 2 Bare" and texts[None, 0] == "Loose"
    table_chunk = next(r for r in rows if r.content_type == "table")
    assert table_chunk.text == "Section: 1 Intro\n\nnative words" and table_chunk.source_table_ids == ["t"]
    assert all(len(r.text) <= 120 for r in rows if r.content_type == "prose")
    assert "".join(texts["s0", i].split("\n\n", 1)[1] for i in range(5) if ("s0", i) in texts).count("y") == 300
    again = {r.chunk_id for r in chunking.chunk_documents(sections, blocks, table, 120).collect()}
    assert again == {r.chunk_id for r in rows} and len(again) == len(rows)


def test_words_bands_and_merged_rows(spark):
    words = spark.createDataFrame([("d", "t", w, x, y, x + 8.0, y + 8.0) for w, x, y in [("top", 5.0, 1.0), ("low", 5.0, 21.0), ("left", 1.0, 1.5)]], "document_id string, table_id string, text string, x0 double, y0 double, x1 double, y1 double")
    boxes = spark.createDataFrame([("d", "t", "c", 0.0, 0.0, 20.0, 40.0)], "document_id string, table_id string, box_id string, bx0 double, by0 double, bx1 double, by1 double")
    assert geometry.native_texts(words, boxes, ["document_id", "table_id"]).first().native_text == "left top\nlow"


CELL = "document_id string, table_id string, row_index int, column_index int, row_span int, column_span int, text string, x0 double, y0 double, x1 double, y1 double"


@pytest.mark.parametrize(("change", "cut"), [({}, True), ({"text": "top other"}, False), ({"label": 20.0}, False), ({"columns": (1,)}, False), ({"below": True}, False), ({"rows": (0, 2)}, False), ({"no_label": True}, False)])
def test_a_cell_is_cut_only_where_all_is_clear(spark, change, cut):
    """Two lines in one cell, two other columns with a row for each, and a label in the middle of both."""
    columns, rows, top = change.get("columns", (1, 2)), change.get("rows", (0, 1)), change.get("label", 0.0)
    cells = [("d", "t", 0, 0, 1, 1, change.get("text", "top low"), 0.0, 0.0, 19.0, 30.0)] + [("d", "t", r, c, 1, 1, "v", 20.0 * c, 20.0 * i, 20.0 * c + 19, 20.0 * i + 10) for i, r in enumerate(rows) for c in columns]
    cells += [] if change.get("no_label") else [("d", "t", 0, 3, 1, 1, "Label", 60.0, top, 79.0, top + 30)]
    cells += [("d", "t", 1, 0, 1, 1, "x", 0.0, 31.0, 19.0, 40.0)] if change.get("below") else []
    words = [("top", 5.0, 1.0), ("low", 5.0, 21.0), ("Label", 65.0, top + 11), *(("v", 20.0 * c + 5, 20.0 * i + 1) for i in (0, 1) for c in columns)]
    found = spark.createDataFrame([("d", "t", w, x, y, x + 8.0, y + 8.0) for w, x, y in words], "document_id string, table_id string, text string, x0 double, y0 double, x1 double, y1 double")
    got = {(r.row_index, r.column_index): (r.text, r.row_span) for r in geometry.repair_tables(spark.createDataFrame(cells, CELL), found).collect()}
    if cut:
        assert got[0, 0] == ("top", 1) and got[1, 0] == ("low", 1) and got[0, 3] == ("Label", 2)
    else:
        assert got[0, 0][0] == cells[0][6] and all(span == 1 for _, span in got.values()) and len(got) == len(cells)


def test_gate_of_native_text_and_notes(spark):
    box = "document_id string, page_number int, text string, x0 double, y0 double, x1 double, y1 double"
    words = spark.createDataFrame([("d", 1, "alpha", 1.0, 1.0, 5.0, 5.0), ("d", 1, "beta", 6.0, 1.0, 9.0, 5.0)], box)
    tables = spark.createDataFrame([("d", 1, "alpha beta", 0.0, 0.0, 10.0, 10.0, "a"), ("d", 1, "alpha gamma delta", 0.0, 0.0, 10.0, 10.0, "b"), ("d", 2, "x", 0.0, 0.0, 10.0, 10.0, "c")], f"{box}, table_id string")
    got = {r.table_id: (r.native_text, r.gate) for r in geometry.native_gate(tables, words).collect()}
    assert got == {"a": ("alpha beta", "repair"), "b": ("alpha beta", "native"), "c": (None, "none")}
    notes = spark.createDataFrame([("d", "a", ["One", "two"], None), ("d", "b", [" "], []), ("d", "c", None, ["x"])], "document_id string, table_id string, captions array<string>, cells array<string>")
    assert {r.table_id: (r.caption, len(r.quality_notes)) for r in geometry.table_notes(notes).collect()} == {"a": ("One two", 1), "b": (None, 1), "c": (None, 0)}


def test_vertical_flip(spark):
    df = spark.createDataFrame([(10.0, 30.0, "BOTTOM_LEFT"), (30.0, 10.0, "top_left")], "y0 double, y1 double, origin string")
    top, bottom = geometry.flip_vertical(geometry.F.col("y0"), geometry.F.col("y1"), geometry.F.lit(100.0), geometry.F.col("origin"))
    assert {tuple(r) for r in df.select(top, bottom).collect()} == {(70.0, 90.0), (10.0, 30.0)}


def test_markdown_markers(spark):
    blocks = _blocks(spark, [(1, 0, "section_header", "H"), (1, 1, "paragraph", "p"), (1, 2, "list_item", "i"), (2, 0, "paragraph", "q")])
    sections = spark.createDataFrame([("d", "s0", None, "H", "b000", ["b001", "b002", "b003"])], "document_id string, section_id string, parent_section_id string, title string, heading_block_id string, blocks array<string>")
    view = extraction.markdown_view(extraction.markdown_lines(blocks, S.block_membership(sections), sections)).first().markdown
    assert view == "<!-- page 1 -->\nH\n## H\np\n- i\n<!-- page 2 -->\n## H\nq"


@pytest.mark.parametrize("n", [0, 1, 999, 1000, 1001])
def test_hard_split(spark, n):
    df = spark.createDataFrame([("a" * n,)], "t string").select(chunking.hard_split(F.col("t"), F.lit(1000)).alias("p"))
    parts = df.first().p
    assert "".join(parts) == "a" * n and len(parts) == max(1, -(-n // 1000))


def test_trees_of_any_depth(spark):
    n = 70
    levels = [*range(1, 15), 15, 14, 13, 15]
    rows = [("d", f"b{i:02}", 1, i, "section_header", ".".join(["1"] * level) + (". T" if level == 1 else " T")) for i, level in enumerate(levels)]
    got = {r.section_id: r.parent_section_id for r in S.reconstruct_sections(spark.createDataFrame(rows, BLOCK)).collect()}
    assert [got[f"section-{i}"] for i in range(len(levels))] == [None if p is None else f"section-{p}" for p in _stack(levels)]
    chain = [("d", f"section-{i}", f"section-{i - 1}" if i else None, f"T{i}", i, i) for i in range(n)]
    # Parents in a circle end too.
    chain += [("e", "section-0", "section-1", "A", 1, 1), ("e", "section-1", "section-0", "B", 2, 2), ("e", "section-2", "section-0", "C", 3, 3)]
    df = spark.createDataFrame(chain, "document_id string, section_id string, parent_section_id string, title string, page_start int, page_end int")
    paths = {r.section_id: r for r in S.section_paths(df.where("document_id = 'd'")).collect()}
    assert all(paths[f"section-{i}"].depth == i and paths[f"section-{i}"].section_path == [f"T{k}" for k in range(i + 1)] for i in range(n))
    ends = {(r.document_id, r.section_id): r.page_end for r in S.rolled_up_pages(df).collect()}
    assert all(ends["d", f"section-{i}"] == n - 1 for i in range(n)) and ends["e", "section-0"] == ends["e", "section-1"] == 3

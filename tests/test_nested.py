from __future__ import annotations

import json

from foliate.operators import nested


def _links(spark, records):
    df = spark.createDataFrame(records, "document_id string, parsed_document_json string, parent_id string")
    return {tuple(r) for r in nested.links(df).collect()}


def test_tables_of_the_schema_graph():
    # Singletons are inlined; repeated, shared and recursive elements get tables.
    assert set(nested.DOCUMENT.tables()) == {"document", "page", "section", "block", "table", "row", "cell"}
    assert ("bounding_box", "x0") in [path for path, _, _ in nested.DOCUMENT.columns("block")]
    assert "metadata_title" in [name for _, name, _ in nested.DOCUMENT.columns("document")]


def test_shapes_of_the_same_thing(spark):
    record = {
        "metadata": {"document_id": "d"},
        "pages": {"page_number": "2", "blocks": {"block_id": "b1"}, "tables": None},
        "sections": [{"section_id": "s1", "blocks": "b2", "child_sections": {"section_id": "s2", "blocks": ["b3", {"block_id": "b4"}], "child_sections": [None]}}],
        "tables": [{"table_id": "t", "rows": [["x", "y"], {"row_index": "1", "cells": [{"cell_id": "c9", "column_index": 0}, {"column_index": "1", "text": "z"}, "q"]}]}],
    }
    got = _links(spark, [("d", json.dumps(record), "clash")] * 2)
    assert got == {
        ("d", "document", "d", "page", "2"),
        ("d", "page", "2", "block", "b1"),
        ("d", "document", "d", "section", "s1"),
        ("d", "section", "s1", "block", "b2"),
        ("d", "section", "s1", "section", "s2"),
        ("d", "section", "s2", "block", "b3"),
        ("d", "section", "s2", "block", "b4"),
        ("d", "document", "d", "table", "t"),
        ("d", "table", "t", "row", "t-r0"),
        ("d", "table", "t", "row", "t-r1"),
        ("d", "row", "t-r0", "cell", "t-r0-c0"),
        ("d", "row", "t-r0", "cell", "t-r0-c1"),
        ("d", "row", "t-r1", "cell", "c9"),
        ("d", "row", "t-r1", "cell", "t-r1-c1"),
        ("d", "row", "t-r1", "cell", "t-r1-c2"),
    }


def test_unreadable_empty_and_deep(spark):
    deep = {"section_id": "s0"}
    for i in range(1, 150):
        deep = {"section_id": f"s{i}", "child_sections": [deep]}
    text = json.dumps({"metadata": {"document_id": "e"}, "sections": [deep]})
    rows = [("a", None, None), ("b", "", None), ("c", '{"pages": [', None), ("d", "null", None), ("f", "[]", None), ("e", text, None)]
    got = _links(spark, rows)
    assert {r[0] for r in got} == {"e"} and len(got) == 150
    assert _links(spark, rows[:0] or [("z", None, None)]) == set()


def test_flat_tables_keep_their_parents(spark):
    record = {"metadata": {"document_id": "d", "title": "T"}, "pages": [{"page_number": 1, "blocks": [{"block_id": "b", "text": "x", "bounding_box": {"x0": 1.5}}]}]}
    df = spark.createDataFrame([("d", json.dumps(record))] * 2, "document_id string, parsed_document_json string")
    rows = nested.flatten_records(df)
    (block,) = nested.flat_table(rows, "block").collect()
    assert (block.parent_kind, block.parent_id, block.block_id, block.text, block.bounding_box_x0) == ("page", "1", "b", "x", 1.5)
    (document,) = nested.flat_table(rows, "document").collect()
    assert document.metadata_title == "T"


def test_records_of_any_depth(spark):
    depth = 10_000
    text = '{"metadata": {"document_id": "d"}, "sections": [' + "".join(f'{{"section_id": "s{i}", "child_sections": [' for i in range(depth)) + "]}" * depth + "]}"
    got = _links(spark, [("d", text, None), ("e", text[:-1], None), ("f", text + "x", None)])
    assert len(got) == depth and {r[0] for r in got} == {"d"} and ("d", "section", "s9998", "section", "s9999") in got


def test_deep_parser_reads_what_the_library_reads():
    texts = ['{"a": [1, -2.5e3, "x\\u00e9\\n", true, false, null, {}, [], [[]], {"b": {"c": NaN}}]}', " [ 1 , 2 ] ", '"x"', "0", "-0.0", "[1,]", '{"a" 1}', "{", "[1 2]", "01", "tru", "", '{"a":1,}', '{"a":1}{', '["\x01"]', "[1]]", "{1: 2}", '{"a": 1, "a": 2}']
    for text in texts:
        try:
            wanted = repr(json.loads(text))
        except ValueError:
            wanted = "error"
        try:
            got = repr(nested._parse_deep(text))
        except ValueError:
            got = "error"
        assert got == wanted, text
    value = {"b": [1, {"a": "é"}, []], "a": {}, "c": None}
    assert nested._written(value) == json.dumps(value, ensure_ascii=False, sort_keys=True)


def test_columns_have_types(spark):
    record = {"metadata": {"document_id": "d", "page_count": "3"}, "tables": {"table_id": "t", "page_number": 2.0, "rows": {"row_index": 0, "cells": [{"column_index": "x", "is_header": "true", "row_span": 1e30}, "y"]}}}
    df = spark.createDataFrame([("d", json.dumps(record))], "document_id string, parsed_document_json string")
    (document,) = nested.flat_table(nested.flatten_records(df, only="document"), "document").collect()
    (table,) = nested.flat_table(nested.flatten_records(df, only="table"), "table").collect()
    cells = sorted(nested.flat_table(nested.flatten_records(df, only="cell"), "cell").collect(), key=lambda r: r.position)
    assert document.metadata_page_count == 3 and table.page_number == 2
    assert [(c.column_index, c.is_header, c.row_span, c.text) for c in cells] == [(None, True, None, None), (None, None, None, "y")]

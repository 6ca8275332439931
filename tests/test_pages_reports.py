from __future__ import annotations

import random

import pytest

from foliate.operators import answers, blocks, chunking, context, evaluation, index, pages, reports, sections, tables
from foliate.sources import documents, schemas


def test_reading_positions_count_the_last_of_a_repeated_reference(spark):
    df = spark.createDataFrame([("d", ["a", "b", None, "a"]), ("e", []), ("f", None)], "document_id string, refs array<string>")
    assert {tuple(r) for r in pages.reading_positions(df, "refs").collect()} == {("d", "b", 1), ("d", "a", 3)}


def test_images_and_diagnostics(spark):
    images = spark.createDataFrame([("d", "i1", 1, 5), ("d", "i0", 1, None), ("d", "i2", None, 1), ("d", "i3", 1, 2)], "document_id string, image_id string, page_number int, reading_order_index int")
    assert {r.image_id: r.position for r in pages.project_images(images).collect()} == {"i3": 0, "i1": 1, "i0": 2}
    parses = spark.createDataFrame([("d", 1, [("Timeout", "too slow"), (None, None)]), ("d", 2, []), ("d", 3, None)], "document_id string, page_number int, errors array<struct<error_type:string,message:string>>")
    assert [tuple(r) for r in pages.project_diagnostics(parses).orderBy("position").collect()] == [("d", 1, 0, "Timeout", "too slow"), ("d", 1, 1, "Diagnostic", "Diagnostic")]


BLOCKS = "document_id string, block_id string, page_number int, text string, block_type string, reading_order_index int"


def test_merge_of_pages(spark):
    rows = [("d", f"h{p}", p, "The  Header", "page_header" if p == 1 else "section_header", 0) for p in (1, 2)] + [("d", "a", 1, "1. Scope", "section_header", 1), ("d", "b", 1, "Text", "text", None), ("d", "c", 2, "More", "text", 1), ("d", "f", 2, "7", "page_footer", 9), ("e", "x", 1, "Alone", "text", 0)]
    df = spark.createDataFrame(rows, BLOCKS)
    got = {(r.document_id, r.block_id): r.position for r in pages.merge_page_blocks(df).collect()}
    assert got == {("d", "a"): 0, ("d", "b"): 1, ("d", "c"): 0, ("e", "x"): 0}
    states = spark.createDataFrame([("d", 2, "failed", "late", 5, 9), ("d", 1, "success", "early", 1, 2), ("e", 1, "success", "p", 1, 2)], "document_id string, page_number int, state string, parser_name string, started_at int, completed_at int")
    none = spark.createDataFrame([], "document_id string, table_id string")
    merged = {r.document_id: tuple(r)[1:] for r in pages.merge_pages(states, df, none).collect()}
    assert merged == {"d": (2, 3, 0, 1, "partial_success", "early", 1, 9), "e": (1, 1, 0, 0, "success", "p", 1, 2)}


def test_packing_equals_a_plain_loop(spark):
    rng = random.Random(5)
    rows = [(f"r{i % 7}", i, f"id{i}", "x" * rng.randint(1, 40), 5) for i in range(900)]
    got = {(r.run, r.group_no): [(s.id, s.text) for s in r.segments] for r in chunking.pack_runs(spark.createDataFrame(rows, "run string, pos int, id string, text string, used int"), ["run"], 100).collect()}
    wanted: dict = {}
    for run in {r[0] for r in rows}:
        group, size = 0, None
        for _, _, id_, text, used in sorted((r for r in rows if r[0] == run), key=lambda r: r[1]):
            if size is not None and size + 2 + len(text) > 100:
                group, size = group + 1, None
            size = used + len(text) if size is None else size + 2 + len(text)
            wanted.setdefault((run, group), []).append((id_, text))
    assert got == wanted


SECTIONS = "document_id string, section_id string, parent_section_id string, title string, level int, page_start int, page_end int, heading_block_id string, blocks array<string>, tables array<string>"
TABLES = "document_id string, table_id string, page_number int, page_numbers array<int>, reading_order_index int, cells array<struct<cell_id:string,row_index:int,column_index:int,text:string,row_span:int,column_span:int,is_header:boolean>>, caption string, native_text string, native_text_coverage double"


def test_a_section_of_thirty_thousand_items_and_its_heading(spark):
    n = 30_000
    rows = [("d", "h", 1, "Head", "section_header", 0), *(("d", f"b{i}", 2, f"text {i}", "text", i) for i in range(n))]
    section = spark.createDataFrame([("d", "s", None, "Head", 1, 1, 2, "h", ["h", *(f"b{i}" for i in range(n))], ["t"])], SECTIONS)
    table = spark.createDataFrame([("d", "t", None, [3, 4], 40_000, [("c", 0, 0, "x", 1, 1, False)], None, None, None)], TABLES)
    got = chunking.chunk_documents(section, spark.createDataFrame(rows, BLOCKS), table).orderBy("ordinal").collect()
    assert sum(len(r.source_block_ids) for r in got) == n + 1 and got[0].source_block_ids[:2] == ["h", "b0"] and got[0].page_start == 1
    assert all(len(r.text) <= 3000 and "h" not in r.source_block_ids for r in got[1:])
    assert got[-1].content_type == "table" and (got[-1].page_start, got[-1].page_end) == (3, 4)


def test_sections_of_any_depth_and_level(spark):
    n = 60
    rows = [("d", f"s{i}", f"s{i - 1}" if i else None, f"t{i}", i + 1, 1, i + 1, None, [], []) for i in range(n)]
    got = {r.section_id: r for r in sections.section_paths(spark.createDataFrame(rows, SECTIONS)).collect()}
    assert got["s59"].depth == 59 and got["s59"].section_path[0] == "t0"
    heads = [("d", f"b{i:02}", 1, ".".join(["1"] * (i + 2)) + " Head", "section_header", i) for i in range(20)]
    tree = {r.section_id: r.parent_section_id for r in sections.reconstruct_sections(spark.createDataFrame(heads, BLOCKS)).collect()}
    assert all(tree[f"section-{i}"] == f"section-{i - 1}" for i in range(1, 20))


def test_citations_as_the_format_has_them(spark):
    rows = [("[E1] and [ E2 , E10 ]", "E1,E2,E10", 0), ("[E0]", "", 1), ("[E01]", "", 1), ("[E 1]", "", 0), ("[SOURCE1] [source 2]", "", 1), ("[e1]", "", 1), ("[see E1]", "", 0), (None, "", 0)]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, t string").orderBy("i")
    got = df.select(answers.F.array_join(answers.inline_citations(answers.F.col("t")), ","), answers.F.size(answers.malformed_citations(answers.F.col("t")))).collect()
    assert [tuple(r) for r in got] == [r[1:] for r in rows]


def test_evidence_outside_all_sections(spark):
    df = spark.createDataFrame([("d", [], 1, 2, "prose", "c", None, "x"), ("d", None, 1, 1, "prose", "c", ["n"], "x")], "document_id string, section_path array<string>, page_start int, page_end int, content_type string, chunk_id string, quality_notes array<string>, text string")
    got = [r[0] for r in df.select(context.render_evidence(context.F.lit("E1"))).collect()]
    assert got == ["[E1]\nDocument: d\nSection: NONE\nPages: 1-2\nContent type: prose\nChunk ID: c\n\nx", "[E1]\nDocument: d\nSection: NONE\nPages: 1\nContent type: prose\nChunk ID: c\nQuality notes: n\n\nx"]


RANKED = "query_id string, rank int, chunk_id string, document_id string, section_id string, section_path array<string>, page_start int, page_end int, source_block_ids array<string>, source_table_ids array<string>, text string"


def _ranked(spark):
    return spark.createDataFrame([("q", 1, "c1", "d", "s1", ["A"], 1, 1, [], [], "other"), ("q", 2, "c2", "d", "s2", ["A"], 2, 3, ["b"], [], "the ﬁnal\n  word"), ("q", 3, "c3", "e", "s3", [], 2, 2, [], [], "the final word")], RANKED)


def test_anchors_meet_across_ligatures_and_line_breaks(spark):
    locators = spark.createDataFrame([("q", "d", "f", None, None, None, None, ["the final word"]), ("q", "d", "g", None, None, None, None, ["absent"])], "query_id string, document_id string, fact_id string, block_id string, table_id string, section_path array<string>, pages array<int>, anchors array<string>")
    assert {r.fact_id: r.first_rank for r in evaluation.fact_ranks(_ranked(spark), locators).collect()} == {"f": 2, "g": None}
    got = evaluation.evaluate(spark.createDataFrame([("q", "d", "?")], "query_id string, document_id string, question string"), lambda asked: _ranked(spark), locators).collect()
    assert [(r.facts, r.first_relevant_rank, r.full_5) for r in got] == [(2, 2, 0)]


def test_labels_of_the_first_form(spark):
    labels = spark.createDataFrame([("q", "d", "ids", ["c2"], ["s1"], [1]), ("q", "d", "section", [], ["s1"], None), ("q", "d", "page", None, None, [3]), ("q", "d", "nothing", None, None, None), ("q", "x", "other", ["c1"], None, None)], "query_id string, document_id string, fact_id string, chunk_ids array<string>, section_ids array<string>, pages array<int>")
    assert {r.fact_id: r.first_rank for r in evaluation.label_ranks(_ranked(spark), labels).collect()} == {"ids": 2, "section": 1, "page": 2, "nothing": None, "other": None}


def test_strategies_reranking_and_their_report(spark):
    covered = lambda *rows: spark.createDataFrame(list(rows), "query_id string, first_relevant_rank int, full_5 int")
    got = {(r.query_id, r.strategy): r.change for r in evaluation.compare_strategies({"dense": covered(("a", 1, 0), ("b", 1, 1)), "lexical": covered(("a", 2, 1), ("b", None, 0)), "fused": covered(("a", 1, 0), ("b", 1, 1))}, "dense").collect()}
    assert got["a", "lexical"] == "recovered" and got["b", "lexical"] == "regressed" and got["a", "fused"] == "same"
    ranks = lambda *rows: spark.createDataFrame(list(rows), "query_id string, chunk_id string, rank int")
    gold = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "query_id string, chunk_id string")
    moved = {r.query_id: (r.dense_rank, r.reranked_rank, r.moved) for r in evaluation.rerank_comparison(ranks(("a", "x", 4), ("a", "y", 9)), ranks(("a", "x", 2), ("a", "y", 1)), gold).collect()}
    assert moved == {"a": (4, 1, "up"), "b": (None, None, None)}
    row = spark.sql("SELECT 2L AS queries, 0.5D AS any_evidence_1, CAST(NULL AS DOUBLE) AS mrr").first()
    assert evaluation.metric_report([("dense", row)]).split() == ["strategy", "queries", "any_evidence_1", "mrr", "dense", "2", "0.5000", "-"]


def test_index_checks(spark):
    df = spark.createDataFrame([("d", "a", "x" * 41), ("d", "b", None), ("e", "c", "y"), ("d", "a", "x")], "document_id string, chunk_id string, text string")
    assert [r.over_limit for r in index.over_limit(df, limit=10).collect()] == [True, False, False, False]
    with pytest.raises(Exception, match="more than 10 tokens"):
        index.require_within_limit(df, limit=10).collect()
    assert index.require_within_limit(df, limit=11).columns == df.columns
    assert {tuple(r) for r in index.input_problems(df, spark.createDataFrame([("d",)], "document_id string")).collect()} == {("a", "repeated_id"), ("c", "foreign_document")}
    space = df.selectExpr("*", "'m' AS embedding_model", "IF(chunk_id = 'a', '1', '2') AS embedding_revision", "'c' AS embedding_config_hash", "8 AS embedding_dimension")
    assert index.in_space(space, "m", "2", "c", 8).count() == 2
    assert index.document(df, "e").count() == 1 and index.document(df, "none").count() == 0


def test_written_index_keeps_other_documents(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    monkeypatch.setattr(index, "BUCKETS", 4)
    df = spark.createDataFrame([(f"d{i}", f"c{i}") for i in range(40)], "document_id string, chunk_id string")
    index.write_index(df, path)
    index.write_index(df.where("document_id = 'd3'").withColumn("chunk_id", index.F.lit("new")), path)
    got = {r.document_id: r.chunk_id for r in spark.read.parquet(path).collect()}
    assert got == {f"d{i}": "new" if i == 3 else f"c{i}" for i in range(40)}


def test_distinct_blocks_read_only_what_is_wanted(spark, small):
    rows = spark.read.parquet(f"{small}/document_blocks.parquet")
    some = blocks.distinct_blocks(rows, "page_number")
    assert some.columns == ["document_id", "block_id", "page_number"] and some.count() == blocks.distinct_blocks(rows).count()
    assert "text:string" not in some._jdf.queryExecution().executedPlan().toString()


def test_markdown_of_a_table_keeps_every_row(spark):
    cells = spark.createDataFrame([("d", "t", f"c{i}", i, i, 0, f"r{i}", 1, 1, False) for i in range(50)], "document_id string, table_id string, cell_id string, pos int, row_index int, column_index int, text string, row_span int, column_span int, is_header boolean")
    assert len(tables.markdown_tables(cells).first().markdown.split("\n")) == 51


def test_sinks_and_schemas(spark, tmp_path, small):
    df = spark.createDataFrame([("b", 2), ("a", None)], "t string, n int")
    documents.write_json(df, str(tmp_path / "j"))
    assert sorted(tuple(r) for r in documents.read_json(spark, str(tmp_path / "j"), "t string, n int").collect() if r.n) == [("b", 2)]
    documents.write_lines(df, "t", str(tmp_path / "l"), "t")
    assert [r.value for r in spark.read.text(str(tmp_path / "l")).collect()] == ["a", "b"]
    documents.write_report("x\n", str(tmp_path / "r.txt"))
    for name in ("document_catalog", "document_blocks", "document_sections", "parsed_tables"):
        assert {(f.name, f.dataType.simpleString()) for f in spark.read.parquet(f"{small}/{name}.parquet").schema} == {(f.name, f.dataType.simpleString()) for f in schemas.schema(name)}, name


def test_reports_of_pages_and_chunks(spark):
    items = spark.createDataFrame([("d", "b", 1, "Head", "section_header", 0), ("d", "c", 1, "entry", "list_item", 2), ("d", "n", 1, None, "text", 1), ("d", "p", None, "x", "text", 1)], BLOCKS)
    shown = spark.createDataFrame([("d", "t", 1, 0, "| a |")], "document_id string, table_id string, page_number int, reading_order_index int, markdown string")
    assert [r.markdown for r in reports.page_markdown(items, shown).collect()] == ["<!-- Page 1 -->\n\n# Page 1\n\n## Head\n\n| a |\n\n- entry"]
    chunk = spark.createDataFrame([("c", "x " * 400)], "chunk_id string, text string")
    assert [(r.characters, len(r.preview)) for r in reports.chunk_report(chunk).collect()] == [(800, 303)]

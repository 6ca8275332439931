from __future__ import annotations

import re
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from foliate.llm import site_lines, splitting


def _brute(blocks, catalog):
    source = {r.document_id: r.collection for r in catalog}
    rows = defaultdict(int)
    for r in catalog:
        rows[r.collection] += 1
    docs, places = defaultdict(set), defaultdict(set)
    for b in blocks:
        for i, line in enumerate((b.text or "").split("\n"), 1):
            key = " ".join(re.findall("[a-z]+", line.lower()))
            if key.count(" ") >= 2 and source.get(b.document_id):
                docs[source[b.document_id], key].add(b.document_id)
                places[source[b.document_id], key].add((b.document_id, b.block_id, i))
    return {p for (c, k), d in docs.items() if len(d) >= 5 and len(d) >= 0.1 * rows[c] for p in places[c, k]}


def test_repeated_lines_equal_brute_force(spark, small):
    blocks, catalog = (spark.read.parquet(f"{small.replace('0.001', '0.01')}/{t}.parquet") for t in ("document_blocks", "document_catalog"))
    got = {(r.document_id, r.block_id, r.line_no) for r in site_lines.find_repeated(blocks, catalog).collect()}
    assert got == _brute(blocks.collect(), catalog.collect()) and got


def test_removal_nulls_and_clashing_columns(spark):
    catalog = spark.createDataFrame([(f"d{i}", "s", "x") for i in range(6)] + [("e", None, "x")], "document_id string, collection string, words string")
    rows = [(f"d{i}", "b", "Legal notice, page %d\nown text of %s here" % (i, "abcdef"[i] * 3), 1) for i in range(6)]
    rows += [rows[0], ("d1", "n", None, 1), ("e", "b", "Legal notice page", 1), ("d2", "z", "", 1)]
    blocks = spark.createDataFrame(rows, "document_id string, block_id string, text string, line_no int")
    clean = {(r.document_id, r.block_id): (r.clean_text, r.lines_removed) for r in site_lines.remove_repeated(blocks, catalog).collect()}
    assert clean["d0", "b"] == ("own text of aaa here", 1) and clean["d1", "n"] == (None, 0)
    assert clean["e", "b"] == ("Legal notice page", 0) and clean["d2", "z"] == ("", 0) and len(clean) == 9
    assert site_lines.find_repeated(blocks.limit(0), catalog).count() == 0


def test_summary_keeps_every_heavy_line():
    summary, exact = site_lines.Summary(9), defaultdict(int)
    for start in range(0, 4000, 50):
        batch = defaultdict(int)
        for i in range(start, start + 50):
            key = i if i % 4 else 0
            batch[key] += 1
            exact[key] += 1
        summary.add(batch)
    assert 0 in summary.counts and len(summary.counts) <= 9
    assert exact[0] - summary.counts[0] <= 4000 / 10


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .\n?  。x", max_size=400), st.integers(20, 60))
def test_pieces_restore_the_text(text, limit):
    pieces = splitting.cut(text, limit, 9)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert (len(pieces) == 1) == (len(text) <= limit)
    for (a, b), (c, d) in zip(pieces, pieces[1:], strict=False):
        assert a < c <= b < d and b - c <= 9
    assert all(b - a <= limit for a, b in pieces)


def test_cuts_at_the_widest_boundary():
    text = "one two three.\n\n" + "four five six. " * 4
    a, b = splitting.cut(text, 50, 10)[0]
    assert text[a:b].endswith(("\n\n", ". "))
    assert splitting.cut("x" * 100, 40, 10)[1] == (20, 60) or splitting.cut("x" * 100, 40, 10)[1][0] == splitting.cut("x" * 100, 40, 10)[0][1] - 10


def test_sections_and_chunks(spark, small):
    names = ("document_sections", "document_blocks", "parsed_tables", "retrieved_chunks")
    sections, blocks, tables, chunks = (spark.read.parquet(f"{small.replace('0.001', '0.01')}/{t}.parquet") for t in names)
    text = {(b.document_id, b.block_id): (b.text or "").strip(" \t\n") for b in blocks.collect()}
    native = {(t.document_id, t.table_id): (t.native_text or "").strip(" \t\n") for t in tables.collect()}
    want = {("chunk", c.document_id, c.chunk_id) for c in chunks.collect() if c.text and len(c.text.strip(" \t\n")) > 3000}
    whole = {}
    for s in sections.collect():
        parts = [text.get((s.document_id, b), "") for b in dict.fromkeys(s.blocks or [])] + [native.get((s.document_id, t), "") for t in dict.fromkeys(s.tables or [])]
        content = "\n\n".join(p for p in parts if p)
        if len(content) > 3000:
            want.add(("section", s.document_id, s.section_id))
            whole[s.document_id, s.section_id] = content
    pieces = splitting.split_oversized(sections, blocks, tables, chunks).collect()
    assert {(p.item_kind, p.document_id, p.item_id) for p in pieces} == want and want
    for p in pieces:
        assert len(p.text) <= 3000 and p.n_pieces > 1
        if p.item_kind == "section":
            assert whole[p.document_id, p.item_id][p.piece_start : p.piece_end] == p.text


def test_summaries_merge_in_a_tree(spark, monkeypatch):
    """300 summaries of one source, each flushed early, keep every line above the threshold."""
    monkeypatch.setattr(site_lines, "HELD_COUNTERS", 3)
    size, rows = 8, 3000
    df = spark.range(rows).selectExpr("'s' AS source", f"{size}L AS size", "IF(id % 4 = 0, 1L, id + 10) AS line_hash", "1L AS n").repartition(300)
    partial = df.mapInPandas(site_lines._summarize, "source string, size long, line_hash long, n long")
    got = {r.line_hash: r.n for r in site_lines.merged_summaries(partial, 300).collect()}
    assert len(got) <= size and got[1] >= rows // 4 - rows // (size + 1)

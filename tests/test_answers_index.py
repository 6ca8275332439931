from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from foliate.operators import answers, evaluation, index, providers, reports
from foliate.sources import documents
from foliate.streaming import ingest


def _answer(spark, text, cited, insufficient=False, known=("E1", "E2")):
    df = spark.createDataFrame([("q", text, cited, insufficient, list(known))], "query_id string, answer_text string, cited_evidence_ids array<string>, insufficient_evidence boolean, known_ids array<string>")
    return answers.check_citations(df).first()


@pytest.mark.parametrize(
    ("text", "cited", "insufficient", "status"),
    [
        ("So [E1].", ["E1"], False, "ok"), ("So [E1, E2].", ["E1", "E2"], False, "ok"), ("So [E1].", ["E1", "E1"], False, "ok"), ("So [E1] [see E2].", ["E1"], False, "ok"),
        ("So [E1; E2].", ["E1"], False, "malformed"), ("So [source1].", [], False, "malformed"), ("So [source 1].", [], False, "uncited"), ("So [E9].", ["E9"], False, "unknown"), ("So [E2] [E1].", ["E1", "E2"], False, "mismatch"),
        ("So.", [], False, "uncited"), ("None.", [], True, "ok"), (None, None, None, "uncited"),
    ],
)
def test_citation_status(spark, text, cited, insufficient, status):
    assert _answer(spark, text, cited, insufficient).citation_status == status


def test_expansion_leaves_other_brackets(spark):
    df = spark.createDataFrame([("A [E1, E2] b [see E1, E2] c [E3].",)], "t string")
    assert df.select(answers.expand_citations(F.col("t"))).first()[0] == "A [E1] [E2] b [see E1, E2] c [E3]."


def test_answers_without_context_and_too_long(spark):
    questions = spark.createDataFrame([("a", "where is the annex"), ("b", "x"), ("c", "annex")], "query_id string, question string")
    contexts = spark.createDataFrame([("a", "[E1]\nDocument: d\n\nthe annex is here\n\n[E2]\nDocument: d\n\nother"), ("c", "y" * 5000)], "query_id string, context string")
    rows = {r.query_id: r for r in answers.answer_questions(questions, contexts, max_output=100, window=1000).collect()}
    assert rows["a"].answer_text == "the annex is here [E1]" and rows["a"].status == "ok" and rows["a"].cited_evidence_ids == ["E1"]
    assert rows["b"].status == "no_context" and rows["b"].insufficient_evidence and rows["c"].status == "prompt_too_long"


@pytest.mark.parametrize(("payload", "ok"), [('{"answer_text":"a","cited_evidence_ids":[],"insufficient_evidence":true}', True), ('{"answer_text":" ","cited_evidence_ids":[],"insufficient_evidence":true}', False), ('{"answer_text":"a","cited_evidence_ids":[],"insufficient_evidence":true,"x":1}', False), ("no", False), (None, False)])
def test_payloads(spark, payload, ok):
    assert spark.createDataFrame([(payload,)], "p string").select(answers.valid_payload(F.col("p"))).first()[0] is ok


def _chunks(spark, rows):
    df = spark.createDataFrame(rows, "document_id string, chunk_id string, text string")
    return index.with_identity(df, "m", "1", "c", 64)


def test_synchronise(spark):
    stored = providers.embed(_chunks(spark, [("d", "a", "same"), ("d", "b", "old"), ("d", "gone", "x"), ("other", "o", "kept")]), "text").withColumn("embedding", F.transform("embedding", lambda x: x * 0 + 9))
    incoming = _chunks(spark, [("d", "a", "same"), ("d", "b", "new"), ("d", "c", "fresh")])
    plan = index.plan_sync(incoming, stored)
    assert {(r.chunk_id, r.action) for r in plan.collect()} == {("a", "refresh"), ("b", "update"), ("c", "insert"), ("gone", "delete")}
    counts = index.sync_counts(plan).first()
    assert (counts.inserted, counts.updated, counts.refreshed, counts.deleted) == (1, 1, 1, 1)
    after = {r.chunk_id: r.embedding[0] for r in index.synchronise(incoming, stored).collect()}
    assert set(after) == {"a", "b", "c", "o"} and after["a"] == after["o"] == 9 and after["b"] != 9
    assert [r.document_id for r in index.emptied_documents(index.plan_sync(incoming.where("false"), stored)).collect()] == []
    assert index.repeated_keys(incoming.union(incoming), "chunk_id").count() == 3


def test_index_written_by_document(spark, tmp_path):
    path = str(tmp_path / "index")
    index.write_index(providers.embed(_chunks(spark, [("d", "a", "x"), ("e", "b", "y")]), "text"), path)
    index.write_index(providers.embed(_chunks(spark, [("d", "c", "z")]), "text"), path)
    assert {r.chunk_id for r in spark.read.parquet(path).collect()} == {"b", "c"}


def test_facts_ranks_and_comparison(spark):
    chunk = "query_id string, rank int, chunk_id string, document_id string, section_path array<string>, page_start int, page_end int, source_block_ids array<string>, source_table_ids array<string>, text string"
    rows = [("q", r, f"c{r}", "d", ["A"], r, r + 1, [f"b{r}"], [], f"text number {r}") for r in (1, 2, 3)]
    ranked = spark.createDataFrame(rows, chunk)
    locator = "query_id string, document_id string, fact_id string, block_id string, table_id string, section_path array<string>, pages array<int>, anchors array<string>"
    facts = spark.createDataFrame([("q", "d", "f1", "b1", None, [], [], []), ("q", "d", "f2", None, None, ["A"], [4], ["number 3"]), ("q", "x", "f3", "b1", None, [], [], []), ("q", "d", "f2", "none", None, None, None, None)], locator)
    ranks = {r.fact_id: r.first_rank for r in evaluation.fact_ranks(ranked, facts).collect()}
    assert ranks == {"f1": 1, "f2": 3, "f3": None}
    two = evaluation.coverage(evaluation.fact_ranks(ranked, facts.where("fact_id != 'f3'")))
    row = two.first()
    assert (row.facts, row.covered_1, row.covered_3, row.any_1, row.full_1, row.full_3) == (2, 1, 2, 1, 0, 1)
    assert evaluation.metrics(two).first().mrr == 1.0 and evaluation.metrics(two.limit(0)).first().queries == 0
    worse = evaluation.coverage(evaluation.fact_ranks(ranked.where("rank < 3"), facts.where("fact_id != 'f3'")))
    assert evaluation.compare(worse, two).first().change == "recovered" and evaluation.compare(two, worse).first().change == "regressed"
    audit = {r.fact_id: r.verdict for r in evaluation.audit_locators(facts, ranked).collect()}
    assert audit == {"f1": "ok", "f2": "ok", "f3": "zero"}
    bad = spark.createDataFrame([("q", "d", "f", None, None, [], [], []), ("q", "d", "g", None, None, [], [], [" "])], locator)
    assert {r.problem for r in evaluation.dataset_problems(bad).collect()} == {"unscoped", "blank_anchor"}
    assert ranked.select(evaluation.normalise(F.lit("ﬁ  x\n"))).first()[0] == "fi x"


def test_files_pages_failures_and_timeouts(spark, tmp_path):
    (tmp_path / "a.html").write_text("<h1>Top</h1><nav>skip</nav><p>one &amp; two</p><script>x</script><ul><li>item</li></ul>")
    (tmp_path / "b.txt").write_text("1.2 Heading\n\nbody one\nline two\f- point\n\n")
    (tmp_path / "c.bin").write_bytes(b"\x00\xff")
    files = documents.read_files(spark, str(tmp_path))
    accepted = {r.path.rsplit("/", 1)[-1]: r.refusal for r in documents.accept_files(files).select("path", "refusal").collect()}
    assert accepted == {"a.html": None, "b.txt": None, "c.bin": "unsupported_type"}
    rows = documents.parse_files(files).collect()
    assert [(r.block_type, r.text) for r in sorted((r for r in rows if r.document_id == "a"), key=lambda r: r.reading_order_index)] == [("section_header", "Top"), ("paragraph", "one & two"), ("list_item", "item")]
    assert {(r.page_number, r.block_type) for r in rows if r.document_id == "b"} == {(1, "section_header"), (1, "paragraph"), (2, "list_item")}
    assert [r.status for r in rows if r.document_id == "c"] == ["failed"]
    assert {r.page_number for r in documents.parse_files(files.where("path like '%b.txt'"), pages=(2, 3), timeout=5).collect()} == {2}
    with pytest.raises(TimeoutError):
        documents._within(0.05, lambda: __import__("time").sleep(1))
    for bad in [((0, 1), True, None), ((2, 1), True, None), (None, True, None), ((1, 2), False, None), (None, False, 0)]:
        with pytest.raises(ValueError):
            documents.check_options(*bad)


def test_stream_lets_each_block_through_once(spark, tmp_path, small):
    schema = "document_id string, block_id string, text string, ingested_at timestamp"
    rows = [("d", "a", "x", "2024-01-01 00:00:00"), ("d", "a", "x", "2024-01-02 00:00:00"), ("d", "b", None, "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "document_id string, block_id string, text string, t string").selectExpr("document_id", "block_id", "text", "cast(t as timestamp) ingested_at")
    df.coalesce(1).write.parquet(str(tmp_path / "landing"))
    query = ingest.write_blocks(ingest.stream_blocks(spark, str(tmp_path / "landing"), schema), str(tmp_path / "store"), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert sorted(r.block_id for r in spark.read.parquet(str(tmp_path / "store")).collect()) == ["a", "b"]


def test_reports(spark):
    texts = spark.createDataFrame([("ABC-DE-012 and ABC-DE-012, A-B-1, no",), (None,)], "text string")
    assert {(r.requirement_id, r.mentions) for r in reports.requirement_ids(texts).collect()} == {("ABC-DE-012", 2)}
    ids = spark.createDataFrame([("d", "x"), ("d", "x"), ("d", None), ("d", None)], "document_id string, id string")
    assert [(r.kind, r.id, r.rows) for r in reports.duplicate_ids({"block": ids}).collect()] == [("block", "x", 2)]

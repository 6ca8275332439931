from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from foliate.operators import context, lexical, providers, retrieval


def _vectors(spark):
    rows = [(i, [math.cos(i / 7), math.sin(i / 7)], i % 2) for i in range(40)] + [(90, None, 0), (91, [0.0, 0.0], 0), (92, [1.0], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_exact_and_orthogonal(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = [(r.rank, r.vec_id, r.similarity) for r in retrieval.dense_topk(df, [1.0, 0.0], 3).orderBy("rank").collect()]
    assert got == [(1, 1, 1.0), (2, 3, 1.0), (3, 2, 0.0)]


@pytest.mark.parametrize("block", [20_000, 3])
def test_batch_equals_single(spark, monkeypatch, block):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
    vectors = _vectors(spark)
    queries = vectors.where("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    got = {}
    for r in retrieval.dense_topk_batch(vectors, queries, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.cosine_distance))
    for q in queries.where("embedding IS NOT NULL AND query_id < 90").collect():
        want = [(r.vec_id, r.cosine_distance) for r in retrieval.dense_topk(vectors.where("size(embedding) = 2"), list(q.embedding), 4).orderBy("rank").collect()]
        assert got[q.query_id] == want
    assert retrieval.dense_topk_batch(vectors.limit(0), queries, 4).count() == 0


def test_fusion_order_and_ties(spark):
    df = lambda ids: spark.createDataFrame([("q", i + 1, c) for i, c in enumerate(ids)], "query_id string, rank int, chunk_id string")
    rows = retrieval.reciprocal_rank_fusion(df(["a", "b"]), df(["b", "c"]), 5).orderBy("rank").collect()
    assert [r.chunk_id for r in rows] == ["b", "a", "c"]
    assert rows[0].score == pytest.approx(1 / 62 + 1 / 61, abs=1e-8)
    tied = retrieval.reciprocal_rank_fusion(df(["z"]), df(["y"]), 5).orderBy("rank").collect()
    assert [r.chunk_id for r in tied] == ["y", "z"]


def test_rerank_ties_go_to_the_dense_rank(spark):
    rows = [("q", "c", 1, 0.5), ("q", "a", 3, 0.5), ("q", "b", 2, 0.9)]
    df = spark.createDataFrame(rows, "query_id string, chunk_id string, dense_rank int, reranker_score double")
    assert [r.chunk_id for r in retrieval.rerank(df, 3).orderBy("rank").collect()] == ["b", "c", "a"]
    with pytest.raises(ValueError):
        retrieval.rerank(df, 0)


def test_two_stage_scores_candidates_only(spark):
    vectors = _vectors(spark).where("vec_id < 40")
    passages = vectors.select("vec_id", F.concat(F.lit("word"), "vec_id").alias("text"))
    queries = spark.createDataFrame([("q", [1.0, 0.0], "word3 nothing")], "query_id string, embedding array<float>, question string")
    rows = retrieval.two_stage(vectors, queries, passages, 2, 5).orderBy("rank").collect()
    assert rows[0].vec_id == 3 and rows[0].reranker_score == 0.5 and rows[1].dense_rank == 1


def test_lexical_needs_all_terms_in_any_order(spark):
    texts = spark.createDataFrame([("a", "the permits are checked by clerks"), ("b", "a clerk"), ("c", None), ("d", "clerk one two three four checking permit")], "chunk_id string, text string")
    queries = spark.createDataFrame([("q", "clerks checking permits"), ("none", "of the"), ("null", None)], "query_id string, question string")
    rows = lexical.lexical_topk(queries, texts).orderBy("rank").collect()
    assert [(r.query_id, r.chunk_id) for r in rows] == [("q", "a"), ("q", "d")] and rows[0].score > rows[1].score > 0
    exact = lexical.lexical_match(queries, texts).collect()
    assert exact == []


def _ranked(spark, rows):
    full = [("q", rank, chunk, "d", ["S"], 1, 2, "prose", [], text) for rank, chunk, text in rows]
    return spark.createDataFrame(full, "query_id string, rank int, chunk_id string, document_id string, section_path array<string>, page_start int, page_end int, content_type string, quality_notes array<string>, text string")


def test_first_overflow_ends_the_context(spark):
    df = _ranked(spark, [(1, "a", "short"), (2, "b", "x" * 1000), (3, "c", "tiny"), (4, "a", "short"), (5, "e", " \n")])
    budget = 300
    packed = context.pack_contexts(df, budget).collect()
    assert [r.evidence_id for r in packed] == ["E1"] and packed[0].chunk_id == "a"
    out = {r.rank: r for r in context.context_exclusions(df, budget).collect()}
    assert out[2].reason == "budget_exceeded" and not out[2].would_fit and out[3].would_fit
    assert out[4].reason == "duplicate" and out[5].reason == "empty" and len(out) == 4
    assert out[3].required_characters == out[3].rendered_characters + 2


def test_rendering(spark):
    text = context.context_texts(_ranked(spark, [(1, "a", "body")]), 1000).first()
    assert text.context == "[E1]\nDocument: d\nSection: S\nPages: 1-2\nContent type: prose\nChunk ID: a\n\nbody"


def test_embedding_is_unit_and_stable():
    a, b = providers.hashed_embedding(["one two", ""]), providers.hashed_embedding(["one two", None])
    assert (a == b).all() and abs((a * a).sum(axis=1) - 1).max() < 1e-12


def test_passages_are_scored_whole(spark):
    providers.register_scorer("first_three", providers.overlap_score, passage_words=3)
    df = spark.createDataFrame([("needle", "hay " * 600 + "needle"), ("needle", None), (None, "x")], "q string, p string")
    got = df.select(providers.pair_score(F.col("q"), F.col("p")).alias("whole"), providers.pair_score(F.col("q"), F.col("p"), "first_three").alias("cut")).collect()
    assert [(r.whole, r.cut) for r in got] == [(1.0, 0.0), (0.0, 0.0), (0.0, 0.0)]

"""Whole flows: index documents, answer questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..operators import answers, chunking, context, index, providers, retrieval
from ..operators import blocks as block_ops
from ..operators import tables as table_ops
from .storage import materialize


def index_documents(sections: DataFrame, blocks: DataFrame, tables: DataFrame, stored: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """The chunk index of all documents: chunked, identified by content, and only what changed embedded."""
    chunks = chunking.chunk_documents(sections, block_ops.drop_repeated_headers(block_ops.semantic_blocks(block_ops.distinct_blocks(blocks))), table_ops.distinct_tables(tables), settings.chunk_characters)
    config = index.space_hash({"model": settings.model, "revision": settings.revision, "dimension": settings.dimension})
    known = index.with_identity(chunks, settings.model, settings.revision, config, settings.dimension)
    return providers.embed(known, "text", "embedding", settings.embedder) if stored is None else index.synchronise(known, stored, settings.embedder)


def answer_questions(questions: DataFrame, chunks: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Answers to (query_id, document_id, question): dense candidates of the document, reranked, packed, answered.

    ``chunks`` is an index with chunk_id, document_id, embedding and the chunk columns.
    """
    chunks = materialize(chunks)
    asked = providers.embed(questions, "question", "embedding", settings.embedder)
    near = retrieval.dense_topk_batch(chunks, asked, max(settings.candidate_k, settings.top_k), "chunk_id", scope="document_id").withColumnRenamed("rank", "dense_rank")
    pairs = near.join(questions.select("query_id", "question"), "query_id").join(chunks.drop("embedding"), "chunk_id")
    scored = pairs.withColumn("reranker_score", providers.pair_score(F.col("question"), F.col("text"), settings.scorer))
    ranked = retrieval.rerank(scored, settings.top_k)
    if "quality_notes" not in ranked.columns:
        ranked = ranked.withColumn("quality_notes", F.array().cast("array<string>"))
    packed = materialize(context.context_texts(ranked, settings.context_characters))
    return answers.answer_questions(questions, packed, settings.answerer, settings.max_output_tokens)

"""Exact dense retrieval, rank fusion and reranking.

Distances are rounded to six places before they are ranked, so that equal ones are ties on every platform; ties go to
the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine_distance, is_unit
from .providers import pair_score

PLACES = 6
#: Queries that are sent to every task at once; more are taken in blocks of this size.
QUERY_BLOCK = 20_000
#: Vectors that one task multiplies with a block at once.
ROW_BLOCK = 512


def check_arguments(top_k: int, query: str | None = "") -> None:
    if top_k <= 0:
        raise ValueError("top_k must be positive")
    if query is not None and query != "" and not query.strip():
        raise ValueError("the query is blank")


def require_vectors(df: DataFrame, vector: str, dimension: int) -> DataFrame:
    """The rows as they are; fails when one without a finite unit vector of the dimension is read."""
    ok = is_unit(F.col(vector), dimension)
    return df.withColumn(vector, F.when(ok, F.col(vector)).otherwise(F.raise_error(F.lit(f"{vector} is not a unit vector of dimension {dimension}"))))


def dense_topk(vectors: DataFrame, query: list[float], top_k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(rank, ``key``, cosine_distance, similarity) of the nearest rows to one query; ranked before anything is joined."""
    check_arguments(top_k)
    distance = F.round(cosine_distance(F.col(vector), F.array(*[F.lit(float(x)) for x in query])), PLACES) + F.lit(0.0)
    near = vectors.select(F.col(key), distance.alias("cosine_distance")).where("cosine_distance IS NOT NULL").orderBy("cosine_distance", key).limit(top_k)
    ranked = near.withColumn("rank", F.row_number().over(Window.orderBy("cosine_distance", key)))  # top_k rows
    return ranked.select("rank", key, "cosine_distance", F.round(1 - F.col("cosine_distance"), PLACES).alias("similarity"))


def dense_topk_batch(vectors: DataFrame, queries: DataFrame, top_k: int = 5, key: str = "vec_id", vector: str = "embedding", scope: str | None = None) -> DataFrame:
    """(query_id, rank, ``key``, cosine_distance, similarity) for every query, exactly, against all rows.

    ``queries`` has query_id, the vector and, if ``scope`` is given, a column of that name that a row must equal. Each
    task keeps the best ``top_k`` of every query over the rows it reads, so the shuffle carries queries x tasks x
    top_k rows at most. Queries go out in blocks of ``QUERY_BLOCK``. Null and zero vectors are near to nothing.
    """
    check_arguments(top_k)
    kinds = dict(vectors.dtypes)
    total = queries.count()
    blocks = max(1, math.ceil(total / QUERY_BLOCK))
    extra = [F.col(scope).alias("scope")] if scope else [F.lit(0).alias("scope")]
    wanted = queries.select("query_id", F.col(vector).alias("vector"), *extra).where("vector IS NOT NULL")
    parts = []
    for block in range(blocks):
        own = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        parts.append(_block_topk(vectors, own, top_k, key, vector, scope, kinds, dict(queries.dtypes)["query_id"]))
    near = reduce(DataFrame.unionByName, parts)
    order = Window.partitionBy("query_id").orderBy("cosine_distance", key)
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    return ranked.select("query_id", "rank", key, "cosine_distance", F.round(1 - F.col("cosine_distance"), PLACES).alias("similarity"))


def _nearer(best_d: np.ndarray, best_k: np.ndarray, q: np.ndarray, keys: np.ndarray, v: np.ndarray, top_k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best so far and the rows of a block, cut to the nearest ``top_k`` of each query; ties to the smaller key."""
    with np.errstate(all="ignore"):
        d = np.round(1 - q @ v.T, PLACES) + 0.0
    d[~np.isfinite(d)] = np.inf
    all_d = np.concatenate([best_d, d], axis=1)
    all_k = np.concatenate([best_k, np.broadcast_to(keys, d.shape)], axis=1)
    # Keys of any kind are compared by their place among those at hand.
    order = np.lexsort((all_k if all_k.dtype.kind in "iuf" else np.unique(all_k, return_inverse=True)[1].reshape(all_k.shape), all_d), axis=1)[:, :top_k]
    return np.take_along_axis(all_d, order, axis=1), np.take_along_axis(all_k, order, axis=1)


def _block_topk(vectors: DataFrame, queries: DataFrame, top_k: int, key: str, vector: str, scope: str | None, kinds: dict[str, str], query_kind: str) -> DataFrame:
    rows = queries.toArrow()
    ids = rows.column("query_id").to_numpy(zero_copy_only=False)
    scopes = rows.column("scope").to_numpy(zero_copy_only=False)
    matrix = np.array(rows.column("vector").to_pylist(), dtype=np.float64).reshape(len(ids), -1)
    with np.errstate(all="ignore"):
        unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    sent = vectors.sparkSession.sparkContext.broadcast((ids, scopes, unit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame | pa.RecordBatch]:
        q_ids, q_scopes, q = sent.value
        # Queries meet the rows of their own scope only.
        asked = {s: np.flatnonzero(q_scopes == s) for s in pd.unique(q_scopes)} if len(q_ids) else {}
        best_d = np.full((len(q_ids), top_k), np.inf)
        best_k: np.ndarray | None = None
        for whole in batches:
            for start in range(0, whole.num_rows, ROW_BLOCK):
                batch = whole.slice(start, ROW_BLOCK)
                keys = batch.column(0).to_numpy(zero_copy_only=False)
                given = batch.column(1).to_pylist()
                usable = np.array([v is not None and len(v) == q.shape[1] for v in given], dtype=bool)
                if not len(q_ids) or not usable.any():
                    continue
                keys, own = keys[usable], batch.column(2).to_numpy(zero_copy_only=False)[usable]
                v = np.array([x for x in given if x is not None and len(x) == q.shape[1]], dtype=np.float64)
                with np.errstate(all="ignore"):
                    v /= np.linalg.norm(v, axis=1, keepdims=True)
                if best_k is None:
                    best_k = np.full((len(q_ids), top_k), keys[0], dtype=keys.dtype)
                codes, present = pd.factorize(own)
                for code, name in enumerate(present):
                    mine = asked.get(name)
                    if mine is not None:
                        best_d[mine], best_k[mine] = _nearer(best_d[mine], best_k[mine], q[mine], keys[codes == code], v[codes == code], top_k)
        if best_k is not None:
            i, j = np.nonzero(np.isfinite(best_d))
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(best_k[i, j]), pa.array(best_d[i, j])], names=["query_id", key, "cosine_distance"])

    own = F.col(scope) if scope else F.lit(0)
    return vectors.select(key, vector, own.alias("scope")).mapInArrow(run, f"query_id {query_kind}, `{key}` {kinds[key]}, cosine_distance double")


def reciprocal_rank_fusion(first: DataFrame, second: DataFrame, top_k: int = 5, key: str = "chunk_id", constant: int = 60) -> DataFrame:
    """(query_id, rank, ``key``, score): 1 / (constant + rank) of both lists added, best first, ties to the smaller id."""
    check_arguments(top_k)
    part = lambda df, name: df.select("query_id", key, F.col("rank").alias(name))
    joined = part(first, "r1").join(part(second, "r2"), ["query_id", key], "full_outer")
    share = lambda name: F.coalesce(1.0 / (F.lit(constant) + F.col(name)), F.lit(0.0))
    scored = joined.withColumn("score", F.round(share("r1") + share("r2"), 9))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select("query_id", "rank", key, "score")


def rerank(candidates: DataFrame, top_k: int = 5, key: str = "chunk_id", score: str = "reranker_score") -> DataFrame:
    """The best by score, then by dense rank, then by id; keeps ``dense_rank`` and every other column."""
    check_arguments(top_k)
    order = Window.partitionBy("query_id").orderBy(F.desc(score), "dense_rank", key)
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def two_stage(vectors: DataFrame, queries: DataFrame, passages: DataFrame, top_k: int = 5, candidate_k: int = 40, key: str = "vec_id", scorer: str = "overlap") -> DataFrame:
    """Dense candidates, then reranked by a pair scorer that sees only those.

    ``queries`` has query_id, embedding and question; ``passages`` has ``key`` and text.
    """
    near = dense_topk_batch(vectors, queries, max(candidate_k, top_k), key).withColumnRenamed("rank", "dense_rank")
    pairs = near.join(queries.select("query_id", "question"), "query_id").join(passages.select(key, "text"), key)
    scored = pairs.withColumn("reranker_score", pair_score(F.col("question"), F.col("text"), scorer))
    return rerank(scored, top_k, key).select("query_id", "rank", key, "reranker_score", "dense_rank", "cosine_distance", "similarity")

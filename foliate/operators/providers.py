"""Pluggable models: embedders, pair scorers and answerers, by name.

Each is a plain function over a batch, run in Arrow batches. The ones here are deterministic and need no model files.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSION = 64
WORD = re.compile(r"[^\W_]+")
_EMBEDDERS: dict[str, Callable[[list[str]], np.ndarray]] = {}
_SCORERS: dict[str, tuple[Callable[[list[str], list[str]], list[float]], int | None]] = {}
_ANSWERERS: dict[str, Callable[[list[str], list[str]], list[str]]] = {}


def register_embedder(name: str, function: Callable[[list[str]], np.ndarray]) -> None:
    _EMBEDDERS[name] = function


def register_scorer(name: str, function: Callable[[list[str], list[str]], list[float]], passage_words: int | None = None) -> None:
    """``passage_words``: so many words of a passage are all that the model can read; None if it reads any number."""
    _SCORERS[name] = function, passage_words


def register_answerer(name: str, function: Callable[[list[str], list[str]], list[str]]) -> None:
    _ANSWERERS[name] = function


def hashed_embedding(texts: list[str], dimension: int = DIMENSION) -> np.ndarray:
    """Unit vectors of hashed words; an empty text gives the first axis."""
    out = np.zeros((len(texts), dimension))
    for i, text in enumerate(texts):
        for word in WORD.findall((text or "").lower()):
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            out[i, h % dimension] += 1.0 if h >> 63 else -1.0
        if not out[i].any():
            out[i, 0] = 1.0
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def overlap_score(queries: list[str], passages: list[str]) -> list[float]:
    """Share of the query's words that the passage has."""
    out = []
    for query, passage in zip(queries, passages, strict=True):
        asked, said = (set(WORD.findall((t or "").lower())) for t in (query, passage))
        out.append(len(asked & said) / len(asked) if asked else 0.0)
    return out


def extractive_answer(questions: list[str], contexts: list[str]) -> list[str]:
    """The evidence with most words of the question, cited, as a JSON payload; insufficient without a shared word."""
    out = []
    for question, context in zip(questions, contexts, strict=True):
        parts = re.split(r"^\[(E\d+)\]\n", context or "", flags=re.MULTILINE)
        evidence = list(zip(parts[1::2], parts[2::2], strict=True))
        scores = overlap_score([question] * len(evidence), [body for _, body in evidence])
        best = max(range(len(evidence)), key=scores.__getitem__, default=None)
        if best is None or scores[best] == 0:
            payload = {"answer_text": "The evidence does not answer the question.", "cited_evidence_ids": [], "insufficient_evidence": True}
        else:
            name, body = evidence[best]
            text = body.split("\n\n", 1)[-1].strip().split("\n")[0]
            payload = {"answer_text": f"{text} [{name}]", "cited_evidence_ids": [name], "insufficient_evidence": False}
        out.append(json.dumps(payload, ensure_ascii=False))
    return out


register_embedder("hashed", hashed_embedding)
register_scorer("overlap", overlap_score)
register_answerer("extractive", extractive_answer)


def embed(df: DataFrame, text: str, out: str = "embedding", embedder: str = "hashed") -> DataFrame:
    """Adds the embedding of a column; the model is looked up once per worker, texts go in Arrow batches."""
    function = _EMBEDDERS[embedder]

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(function(texts.fillna("").tolist()).astype(np.float32)))

    return df.withColumn(out, run(F.col(text)))


def pair_score(query: Column, passage: Column, scorer: str = "overlap") -> Column:
    """Score of (query, passage) pairs; passages are whole unless the scorer was registered with a limit."""
    function, limit = _SCORERS[scorer]

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for queries, passages in batches:
            read = passages.fillna("").tolist()
            if limit is not None:
                read = [" ".join(p.split()[:limit]) for p in read]
            yield pd.Series(function(queries.fillna("").tolist(), read))

    return run(query, passage)


def answer_payload(question: Column, context: Column, answerer: str = "extractive") -> Column:
    function = _ANSWERERS[answerer]

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for questions, contexts in batches:
            yield pd.Series(function(questions.fillna("").tolist(), contexts.fillna("").tolist()))

    return run(question, context)

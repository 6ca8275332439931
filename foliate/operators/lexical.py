"""Lexical retrieval: every term of the query must occur; ranked by how densely they cover the text.

Terms are stemmed words without stop words. The score sums, over the shortest spans that hold all terms, one over the
length of the span (cover density).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: English words that carry no content.
STOP_WORDS = tuple("a an and are as at be but by for from has have if in into is it its no not of on or such that the their then there these they this to was were will with which who what when where how".split())
VOWEL_GROUP = re.compile(r"[aeiouy]+[^aeiouy]")


def words(text: Column) -> Column:
    """Lower-case words without stop words, in order."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1), lambda w: ~w.isin(*STOP_WORDS))


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """A light suffix stripper: plural, past, participle and adverb endings behind at least one vowel group."""
    if len(word) < 4 or not word.isalpha():
        return word
    for ending, new in (("sses", "ss"), ("ies", "y"), ("s", "")):
        if word.endswith(ending) and not word.endswith(("ss", "us", "is")):
            word = word[: -len(ending)] + new
            break
    for ending in ("edly", "ingly", "ing", "ed", "ly"):
        base = word[: -len(ending)]
        if word.endswith(ending) and VOWEL_GROUP.search(base + ("x" if base[-1:] in "aeiouy" else "")) and len(base) > 2:
            word = base[:-1] if len(base) > 3 and base[-1] == base[-2] and base[-1] not in "lsz" else base
            break
    return word[:-1] if word.endswith("e") and len(word) > 4 else word


def cover_density(places: list[list[int]]) -> float:
    """Score of the positions of each term: 1 / length over all minimal spans that hold every term."""
    flat = sorted((at, i) for i, spots in enumerate(places) for at in spots)
    last: dict[int, int] = {}
    score, before = 0.0, -1
    for at, term in flat:
        last[term] = at
        if len(last) == len(places):
            start = min(last.values())
            if start > before:
                score += 1.0 / (at - start + 1)
                before = start
    return score


def _matches(asked: DataFrame, texts: DataFrame, key: str, keys: list[str]) -> DataFrame:
    """(query_id, ``key``, terms, words) of the texts that hold every term of a query.

    ``asked`` has query_id, ``keys`` and terms; ``texts`` has ``key``, ``keys`` and words (their terms in order). A query is
    joined by its rarest term only, as a text without that is no match; the others are tested on the row. So a term that
    stands in a third of all texts is joined for queries of nothing rarer alone.
    """
    postings = texts.select(key, *keys, F.explode(F.array_distinct("words")).alias("term"))
    # Counted among the terms that are asked for, combined before the shuffle.
    wanted = asked.select("query_id", *keys, F.explode("terms").alias("term"))
    counts = postings.join(wanted.select(*keys, "term").distinct(), [*keys, "term"], "left_semi").groupBy(*keys, "term").agg(F.count("*").alias("texts"))
    # A term that no text has counts 0, so that its query meets nothing.
    ranked = wanted.join(counts, [*keys, "term"], "left").groupBy("query_id").agg(F.min_by("term", F.struct(F.coalesce("texts", F.lit(0)).alias("n"), "term")).alias("term"))
    met = asked.join(ranked, "query_id").join(postings, [*keys, "term"]).select("query_id", key, *keys, "terms")
    return met.join(texts, [key, *keys]).where(F.size(F.array_except("terms", "words")) == 0).select("query_id", key, "terms", "words")


def lexical_match(queries: DataFrame, texts: DataFrame, key: str = "chunk_id", scope: str | None = None) -> DataFrame:
    """(query_id, ``key``, terms): texts that hold every term of the query; a query without terms matches nothing.

    ``query_id`` and ``key`` are unique.
    """
    keys = [scope] if scope else []
    asked = queries.select("query_id", *keys, F.array_distinct(words(F.col("question"))).alias("terms")).where(F.size("terms") > 0)
    indexed = texts.select(key, *keys, words(F.col("text")).alias("words"))
    return _matches(asked, indexed, key, keys).select("query_id", key, F.size("terms").cast("bigint").alias("terms"))


def lexical_topk(queries: DataFrame, texts: DataFrame, top_k: int = 5, key: str = "chunk_id", scope: str | None = None) -> DataFrame:
    """(query_id, rank, ``key``, score) with stemmed terms, by cover density; ties to the smaller id."""
    if top_k <= 0:
        raise ValueError("top_k must be positive")
    keys = [scope] if scope else []

    @F.pandas_udf("array<string>")
    def stems(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda ws: [stem(w) for w in ws] if ws is not None else [])

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for terms, texts_ in batches:
            found = []
            for wanted, held in zip(terms, texts_, strict=True):
                spots: dict[str, list[int]] = {t: [] for t in wanted}
                for at, word in enumerate(held):
                    if word in spots:
                        spots[word].append(at)
                found.append(cover_density(list(spots.values())))
            yield pd.Series(found)

    asked = queries.select("query_id", *keys, F.array_distinct(stems(words(F.col("question")))).alias("terms")).where(F.size("terms") > 0)
    indexed = texts.select(key, *keys, stems(words(F.col("text"))).alias("words"))
    scored = _matches(asked, indexed, key, keys).select("query_id", key, F.round(score("terms", "words"), 9).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select("query_id", "rank", key, "score")

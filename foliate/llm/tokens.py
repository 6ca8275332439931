"""Byte-pair encoding with the rank file of a public tokenizer.

The text is cut by the vocabulary's own pattern; each distinct pre-token is merged once per Python worker by
:class:`RankMerger` and kept in a bounded memo. A merge finds the leftmost pair of least rank at the root of a
segment tree over byte positions, joins it, and updates the tree for the joined pair and its live neighbours
only, so that a run of n bytes costs O(n log n) however long it is.

Null and empty texts give an empty list. Text that looks like a special token is ordinary text.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where the vocabularies lie unless the caller or the environment says otherwise, and the pattern
#: that belongs to the byte-level rank files.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same language over ASCII texts, where \p{L} and \p{N} are plain ranges; the standard engine is faster. It must be
#: compiled with re.ASCII, as \s would take the separators U+001C to U+001F otherwise, which are no space to a tokenizer.
ASCII_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"""
#: Most pre-tokens that a worker remembers; the memo is emptied when it is full.
MEMO_ENTRIES = 400_000
#: Longer pre-tokens are merged anew each time rather than remembered.
MEMO_CHARS = 200

NEVER = 1 << 62


def vocabulary_path() -> str:
    return os.environ.get("FOLIATE_VOCABULARY", DEFAULT_VOCABULARY)


class RankMerger:
    """Merges the bytes of one pre-token in the order of the ranks."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks

    def merge(self, piece: bytes) -> list[int]:
        ranks, n = self.ranks, len(piece)
        if n < 2:
            return [ranks[piece]] if n else []
        bits = (n - 1).bit_length()
        width, mask = 1 << bits, (1 << bits) - 1
        # A leaf holds rank and position of the pair that starts there, so the root is the leftmost least rank.
        tree = [NEVER] * (2 * width)
        find = ranks.get
        for i in range(n - 1):
            rank = find(piece[i : i + 2])
            if rank is not None:
                tree[width + i] = rank << bits | i
        for node in range(width - 1, 0, -1):
            left, right = tree[2 * node], tree[2 * node + 1]
            tree[node] = left if left < right else right
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(at: int, start: int, end: int) -> None:
            rank = find(piece[start:end]) if end else None
            node = width + at
            tree[node] = NEVER if rank is None else rank << bits | at
            node >>= 1
            while node:
                left, right = tree[2 * node], tree[2 * node + 1]
                least = left if left < right else right
                if tree[node] == least:
                    return
                tree[node] = least
                node >>= 1

        while tree[1] != NEVER:
            at = tree[1] & mask
            gone = after[at]
            end = after[gone]
            after[at] = end
            put(gone, 0, 0)
            if end < n:
                before[end] = at
                put(at, at, after[end])
            else:
                put(at, 0, 0)
            left = before[at]
            if left >= 0:
                put(left, left, end)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out


class _Memo(dict):
    """Pre-token to ids; fills itself."""

    def __init__(self, merger: RankMerger) -> None:
        super().__init__()
        self.merger = merger

    def __missing__(self, token: str) -> list[int]:
        ids = self.merger.merge(token.encode("utf-8", "replace"))
        if len(token) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[token] = ids
        return ids


class Encoder:
    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.memo = _Memo(RankMerger(ranks))
        self.any_text = regex.compile(PATTERN)
        self.ascii_text = re.compile(ASCII_PATTERN, re.ASCII)

    def pieces(self, text: str) -> list[str]:
        return (self.ascii_text if text.isascii() else self.any_text).findall(text)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        return list(chain.from_iterable(map(self.memo.__getitem__, self.pieces(text))))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        return sum(map(len, map(self.memo.__getitem__, self.pieces(text))))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary; outlives the task."""
    return Encoder(path)


def _slices(batch: pa.RecordBatch, rows: int = 500) -> Iterable[pa.RecordBatch]:
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``key`` and ``ids``, the token ids of each row's text; one row per input row, other columns are dropped.

    Narrow: no shuffle. Null and empty texts give an empty list, never null; repeated rows stay repeated.
    """
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for whole in batches:
            for batch in _slices(whole):
                lists = [encode(t) for t in batch.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
                flat = np.fromiter(chain.from_iterable(lists), dtype=np.int32, count=int(ends[-1]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["key", "ids"])

    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, ids array<int>").select(F.col("key").alias(key), "ids")


def count_tokens(df: DataFrame, key: str = "doc_id", text: str | Column = "text", vocabulary: str | None = None) -> DataFrame:
    """``key`` and ``n_tokens`` of each row; 0 for null and empty texts. Narrow: no shuffle."""
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(path).count
        for whole in batches:
            for batch in _slices(whole):
                sizes = pa.array([count(t) for t in batch.column(1).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), sizes], names=["key", "n_tokens"])

    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("key"), (F.col(text) if isinstance(text, str) else text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, n_tokens bigint").select(F.col("key").alias(key), "n_tokens")

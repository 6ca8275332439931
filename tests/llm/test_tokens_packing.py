from __future__ import annotations

import base64
import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from foliate.llm import packing, tokens

PATH = tokens.DEFAULT_VOCABULARY


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(PATH.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


CASES = ["", "a", "Hello  world\n\n x", "<|endoftext|> is text", "don't we'll 12ab\t\t", "仮の記録は250日以内に送信する必要がある。", "é́ ﬁ ​ 😀😀", "a" * 5000, " " * 3000 + "x", "ab" * 4000, " x y", "१२३ 12²"]


@pytest.mark.parametrize("text", CASES)
def test_same_ids_as_the_library(reference, text):
    assert tokens.encoder(PATH).encode(text) == reference(text)


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_same_ids_on_any_text(text):
    t = Tokenizer.from_file(PATH.replace(".tiktoken", ".json")) if not hasattr(test_same_ids_on_any_text, "t") else test_same_ids_on_any_text.t
    test_same_ids_on_any_text.t = t
    t.encode_special_tokens = True
    text = text.encode("utf-8", "ignore").decode()
    assert tokens.encoder(PATH).encode(text) == t.encode(text, add_special_tokens=False).ids


def test_whole_table(spark, small, reference):
    df = spark.read.parquet(f"{small}/documents.parquet")
    got = {r.doc_id: r.ids for r in tokens.encode_texts(df).collect()}
    rows = df.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for row in rows:
        assert got[row.doc_id] == (reference(row.text) if row.text else [])


def _check(items, placed, capacity):
    used, seen = defaultdict(int), defaultdict(list)
    for container, key, start, end in placed:
        assert 0 <= start < end
        used[container] += end - start
        seen[key].append((start, end))
    assert all(n <= capacity for n in used.values())
    for key, size in items.items():
        if not size:
            assert key not in seen
            continue
        spans = sorted(seen[key])
        assert spans[0][0] == 0 and spans[-1][1] == size
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
        assert len(spans) == 1 or size > capacity
    return used


@pytest.mark.parametrize("seed", range(4))
def test_containers_hold_all_items(spark, seed):
    rng = random.Random(seed)
    items = {i: rng.choice([0, None, 1, 50, rng.randint(1, 100), rng.randint(1, 350), 100, 34, 33]) for i in range(400)}
    df = spark.createDataFrame([(i, n, 7) for i, n in items.items()], "doc_id long, n_tokens long, s int")
    placed = [tuple(r) for r in packing.fill_containers(df, 100).collect()]
    used = _check(items, placed, 100)
    assert len(used) <= 1.1 * sum(n or 0 for n in items.values()) / 100 + 2


def test_a_third_of_one_size_and_none_at_all(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 40 ELSE id % 60 END AS n_tokens")
    items = {r.doc_id: r.n_tokens for r in df.collect()}
    used = _check(items, [tuple(r) for r in packing.fill_containers(df, 100).collect()], 100)
    assert len(used) <= sum(items.values()) / 100 * 1.1 + 2
    assert packing.fill_containers(df.limit(0), 100).count() == 0


def test_large_items_pair_greedily():
    plan = packing.plan_containers({60: 2, 40: 1, 35: 2, 5: 1}, 100)
    assert plan.containers == 3


def test_all_ascii_triples_are_cut_as_by_the_library():
    import tiktoken

    ours = tokens.encoder(tokens.vocabulary_path())
    with open(tokens.vocabulary_path(), "rb") as file:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, file)}
    library = tiktoken.Encoding("local", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    signs = [chr(i) for i in range(128)]
    for a in signs:
        # Every triple that begins with a, set apart by a letter and a digit.
        text = "".join(f"{a}{b}{c}x7" for b in signs for c in signs)
        assert ours.encode(text) == library.encode_ordinary(text)
        assert ours.encode(text + "é") == library.encode_ordinary(text + "é")
    for text in ("a\n\n\x1fb", "a\x85\x85b é", "\x1c\x1d \u2003é\u00a0\u00a0x", "é\x1f\x1f x"):
        assert ours.encode(text) == library.encode_ordinary(text)

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from foliate.llm import near_duplicates


def _pairs(text):
    words = re.findall("[a-z0-9]+", (text or "").lower())
    return Counter(zip(words, words[1:], strict=False)) if len(words) >= 8 else None


def _brute(rows):
    grams = {(k, i): _pairs(t) for k, i, t in rows}
    items = sorted((k, i, c, sum(c.values())) for (k, i), c in grams.items() if c)
    out = set()
    for at, (k, i, c, n) in enumerate(items):
        for kk, j, d, m in items[at + 1 :]:
            if k == kk and min(n, m) >= 0.65 * max(n, m) and sum((c & d).values()) >= 0.65 * max(n, m) - 1e-9:
                out.add((k, min(i, j), max(i, j)))
    return out


def _rows(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    rows, texts = [], []
    for i in range(n):
        if texts and rng.random() < 0.6:
            words = rng.choice(texts[-25:]).split()
            for _ in range(rng.randint(0, len(words) // 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                at = rng.randrange(len(words))
                words = words[at:] + words[:at]
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.randint(3, 60))]
        texts.append(" ".join(words))
        rows.append((rng.choice("xy"), f"id{i}", texts[-1].upper() if rng.random() < 0.1 else texts[-1].replace(" ", ", ")))
    return [*rows, ("x", "null", None), ("x", "empty", ""), ("x", "one", "a b c d e f g"), ("x", "c1", "a a a a a a a a a"), ("x", "c2", "a a a a a a a a a a"), rows[0], rows[0]]


@pytest.mark.parametrize(("seed", "region"), [(1, 1000), (2, 3), (3, 12), (4, 40)])
def test_equals_brute_force(spark, seed, region):
    rows = _rows(seed, 260)
    df = spark.createDataFrame([(*r, 1) for r in rows], "kind string, id string, text string, a int")
    got = [tuple(r) for r in near_duplicates.similar_records(df, region_texts=region).collect()]
    assert len(got) == len(set(got)) and set(got) == _brute(set(rows))
    assert got


def test_groups_and_empty(spark):
    rows = _rows(5, 150)
    df = spark.createDataFrame(rows, "kind string, id string, text string")
    edges = _brute(set(rows))
    root = {(k, i): (k, i) for k, i, t in rows if _pairs(t)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a, b in sorted(edges):
        x, y = find((k, a)), find((k, b))
        root[max(x, y)] = min(x, y)
    got = near_duplicates.groups(df).collect()
    assert len(got) == len(root)
    assert all(find((r.kind, r.id)) == (r.kind, r.group) for r in got)
    assert near_duplicates.groups(df.limit(0)).count() == 0 and near_duplicates.similar_records(df.limit(0)).count() == 0


def test_copies_of_one_text(spark):
    df = spark.range(300).selectExpr("'x' AS kind", "concat('i', id) AS id", "IF(id % 3 = 0, 'one two three four five six seven eight', concat('t', id, ' a', id, ' b', id, ' c', id, ' d', id, ' e', id, ' f', id, ' g', id)) AS text")
    assert near_duplicates.similar_records(df).count() == 100 * 99 // 2


def test_components_run_until_they_settle(spark, monkeypatch):
    # A bound on the rounds, should there be one, allows a single round here.
    monkeypatch.setattr(near_duplicates, "range", lambda n: range(1), raising=False)
    chain = spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long")
    got = {r.node: r.root for r in near_duplicates.components(chain).collect()}
    assert got == {i: 0 for i in range(1, 51)}


def _clusters(n, groups, edits, seed=9):
    """Texts of one region: all share an opening, and the texts of a group nearly everything."""
    rng = random.Random(seed)
    cores = [[f"g{g}w{i}" for i in range(40)] for g in range(groups)]
    rows = []
    for i in range(n):
        words = list(cores[i % groups])
        for _ in range(edits):
            words[rng.randrange(40)] = f"x{rng.randrange(10**6)}"
        rows.append(("x", f"id{i}", " ".join(["the same rare opening", *words])))
    return rows


def test_documents_divide_large_regions(spark):
    rows = _clusters(240, 6, 1)
    df = spark.createDataFrame(rows, "kind string, id string, text string")
    members, texts = near_duplicates.distinct_texts(df)
    body = lambda tid, n: near_duplicates.np.array([(tid, n, n, near_duplicates.np.zeros(6, "<u8"), 0)], dtype=near_duplicates.BODY).tobytes()
    postings = spark.createDataFrame([(7, bytearray(body(r.tid, len(r.words.split()) - 1))) for r in texts.collect()], near_duplicates.POSTINGS)
    out = near_duplicates.divided(postings, texts, 0.65, 60).collect()
    sizes = Counter(r.region for r in out)
    # Six groups of forty: the windows keep them apart, so that a text is replicated among the pivots of its group only.
    assert max(sizes.values()) <= 60 and len(out) < 5 * 240
    got = {tuple(r) for r in near_duplicates.similar_records(df, region_texts=60).collect()}
    assert got == _brute(set(rows))


def test_a_region_that_cannot_be_divided_is_cut_into_blocks(spark):
    rows = _clusters(150, 1, 3)
    df = spark.createDataFrame(rows, "kind string, id string, text string")
    members, texts = near_duplicates.distinct_texts(df)
    body = lambda tid, n: near_duplicates.np.array([(tid, n, n, near_duplicates.np.zeros(6, "<u8"), 0)], dtype=near_duplicates.BODY).tobytes()
    postings = spark.createDataFrame([(7, bytearray(body(r.tid, len(r.words.split()) - 1))) for r in texts.collect()], near_duplicates.POSTINGS)
    sizes = Counter(r.region for r in near_duplicates.divided(postings, texts, 0.65, 30).collect())
    assert len(sizes) == 5 * 6 // 2 and max(sizes.values()) < 100
    got = {tuple(r) for r in near_duplicates.similar_records(df, region_texts=30).collect()}
    assert got == _brute(set(rows)) and len(got) > 5000


def test_postings_do_not_grow_with_the_counters():
    items = near_duplicates.elements(" ".join(f"w{i}" for i in range(121)))
    few, many = (near_duplicates._prefix(items, near_duplicates.np.full(1 << 20, n, dtype="i4"), 0.65) for n in (2, 10**6))
    assert len(few[0]) == len(many[0]) == 120 - 78 + 1


def _kept(monkeypatch):
    """Rows of each table that is materialized, by its columns."""
    rows = Counter()
    keep = near_duplicates.materialize

    def counted(df):
        out = keep(df)
        rows[tuple(out.columns)] += out.count()
        return out

    monkeypatch.setattr(near_duplicates, "materialize", counted)
    return rows


def test_unrelated_long_texts_are_not_verified(spark, monkeypatch):
    rng = random.Random(3)
    rows = []
    # Few words, so that any two texts meet at some pair of words.
    for i in range(120):
        words = [f"w{rng.randrange(50)}" for _ in range(rng.choice((330, 420, 500, 700)))]
        rows.append(("x", f"id{i}", " ".join(words)))
        if i % 10 == 0:
            rows.append(("x", f"copy{i}", " ".join(words[: rng.randrange(len(words) * 3 // 4, len(words))])))
    df = spark.createDataFrame(rows, "kind string, id string, text string")
    kept = _kept(monkeypatch)
    got = {tuple(r) for r in near_duplicates.similar_records(df).collect()}
    assert got == _brute(set(rows)) and len(got) == 12
    # Only pairs that are alike, or nearly so, go to the verification.
    assert kept["a", "b"] <= 2 * len(got)
    # Without room for their sketches all are verified, and the result is the same.
    monkeypatch.setattr(near_duplicates, "SENT_BYTES", 0)
    assert {tuple(r) for r in near_duplicates.similar_records(df).collect()} == got


def test_long_sketches_bound_the_difference_from_below():
    np = near_duplicates.np
    rng = np.random.default_rng(4)
    pool = near_duplicates._mix(np.arange(1, 5000, dtype=np.uint64))
    texts = [rng.choice(pool, rng.integers(161, 2000), replace=False) for _ in range(60)]
    texts += [np.concatenate([t[5:], pool[:3]]) for t in texts]
    texts = [np.unique(t) for t in texts]
    doublings = np.array([int(np.ceil(np.log2(len(t) / near_duplicates.SKETCH_ELEMENTS))) for t in texts])
    tid = rng.permutation(10**6)[: len(texts)].astype(np.int64)
    made = [near_duplicates.sketch(t, near_duplicates.SKETCH_WORDS << k).tobytes() for t, k in zip(texts, doublings, strict=True)]
    long = near_duplicates.LongSketches(tid, doublings, made)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(texts)), np.arange(len(texts))))
    apart = long.apart(tid[i], tid[j])
    true = np.array([len(np.setxor1d(texts[a], texts[b])) for a, b in zip(i, j, strict=True)])
    assert (apart <= true).all() and apart.max() > 300 and (apart[i == j] == 0).all()
    assert (long.apart(tid[:3], np.full(3, -1)) == 0).all()


def test_a_region_is_measured_only_where_its_division_pays(spark, monkeypatch):
    rng = random.Random(6)
    rows = [("x", f"id{i}", " ".join(["the same rare opening", *(f"w{rng.randrange(10**6)}" for _ in range(30))])) for i in range(400)]
    df = spark.createDataFrame(rows, "kind string, id string, text string")
    members, texts = near_duplicates.distinct_texts(df)
    body = lambda tid, n: near_duplicates.np.array([(tid, n, n, near_duplicates.np.zeros(6, "<u8"), 0)], dtype=near_duplicates.BODY).tobytes()
    postings = spark.createDataFrame([(7, bytearray(body(r.tid, len(r.words.split()) - 1))) for r in texts.collect()], near_duplicates.POSTINGS)
    kept = _kept(monkeypatch)
    out = near_duplicates.divided(postings, texts, 0.65, 100).collect()
    # Whole texts are far from one another, so that their windows exclude nothing: a sample shows it, and nothing else is kept.
    assert sum(kept.values()) < 100 and len(out) == 400 * 4


def test_text_numbers_of_any_bytes_stay_in_divided_regions(spark):
    rows = _clusters(240, 6, 1)
    tids = [i + 150 if i % 2 else (i << 33) + 0xC3_A5_C2 + i for i in range(240)]
    texts = spark.createDataFrame([(n, "x", r[2]) for n, r in zip(tids, rows, strict=True)], "tid long, kind string, words string")
    body = lambda tid, n: near_duplicates.np.array([(tid, n, n, near_duplicates.np.zeros(6, "<u8"), 0)], dtype=near_duplicates.BODY).tobytes()
    postings = spark.createDataFrame([(7, bytearray(body(n, 43))) for n in tids], near_duplicates.POSTINGS)
    out = near_duplicates.divided(postings, texts, 0.65, 60).collect()
    assert {int(near_duplicates.np.frombuffer(r.body, dtype=near_duplicates.BODY)["tid"][0]) for r in out} == set(tids)

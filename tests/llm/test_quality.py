from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from foliate.llm import quality

PROSE = "The clerk reviews the annual permit and reports each change to the owner. If the annex is missing, the planner receives a notice before the first release. "
COMMON = frozenset("clerk reviews annual permit reports each change owner annex missing planner receives notice first release ledger monthly secure form".split())


def _kind(text):
    parts = quality.composition(text, quality.WORD.findall(text.lower()), COMMON)
    return next((k for k in quality.KINDS if parts[k] > 0.5 * sum(parts.values())), "prose")


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        (PROSE * 3, "prose"), ((PROSE * 3).upper(), "prose"), (PROSE[:60] + "\n" + PROSE[60:130] + "\n" + PROSE[130:], "prose"), ("仮の記録は250日以内に送信する必要がある。Fenlinは報告書を削除し、担当者に通知する。画面がない場合、新しい明細は保存できない。", "prose"),
        ("Если файл отсутствует, новый отчет не может быть сохранен. " * 4, "prose"), (PROSE + "\n\n- annual permit\n- monthly ledger\n- secure form", "prose"),
        ("Annual permit:\n" + "- monthly ledger form\n- secure annex\n" * 6, "list"), ("monthly ledger form\nSecure annual annex\n" * 1 + "Notice for the planner\nreview the permit\nOwner and clerk notice\nannex release\n", "list"), ("1. annual permit ..... 2\n2. annex ..... 4\n3. ledger form ........ 9\n", "list"),
        ("Permit | Annex | Owner\n8282 | ledger | A12\nnotice |  | 5.40\nform | clerk | -\n", "table"), ("Permit\tAnnex\nledger\t12\n\t13\nform\tnotice\n", "table"), ("Permit      Annex       Owner\nledger      12          clerk\n            13          form\n", "table"), ('"permit","annex","owner"\n"ledger","12",""\n"form","13","clerk"\n', "table"),
        ("xqzjk wvbnt rtplk zzkqw plkmn qwrtz bnmvc xcvbn lkjhg fdsap" * 2, "junk"), ("5f f6 2f a7 08 f4 3d 3f 5d 75 4b 6b 83 2b\n19 ff 8b 65 18 89", "junk"), ("permit permit permit permit permit permit permit permit permit", "junk"), ("<div class=\"c5\"><span>{{permit}}</span><br/></div>&nbsp; " * 3, "junk"), (">>^=+?*?:>%%%<^%_+/|\n\\&~@||~&/%$/-%-;*_~|<|<#\\%|>|*&!=!", "junk"),
    ],
)
def test_kinds(text, kind):
    assert _kind(text) == kind


def test_statistics():
    text = 'One two.\n\nThree-four, "five!"\n-'
    got = quality.statistics(text, quality.WORD.findall(text.lower()), frozenset({"one", "five"}))
    assert got == (5, 3.8, round(7 / 26, 4), round(2 / 3, 4), 0.4)
    assert quality.statistics("", [], frozenset()) == (0, 0.0, 0.0, 0.0, 0.0)


def test_ranks_and_scores_equal_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", "x", *(PROSE * rng.randint(1, 4) for _ in range(40)), *("permit | annex | %d\n" % i * 5 for i in range(8)), *("qz wxk jv%d" % i * 20 for i in range(8))]
    rows = [(i, t, rng.choice(["en", "EN-gb", None, "de"]), 1.5) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, stat double")
    got = {r.doc_id: r for r in quality.assess(df).collect()}
    assert len(got) == len(rows)
    assert {r.lang for r in got.values()} <= {"en", "de", "und"}
    # All languages are thin here, so that texts are ranked among all different ones.
    stats = {r.key: r for r in quality.document_statistics(df).collect()}
    different = [next(r for r in stats.values() if r.h == h) for h in {r.h for r in stats.values() if r.n_chars}]
    n = len(different)
    for key, r in got.items():
        left = right = chosen = 0.0
        for name in (*quality.STATISTICS, *quality.FURTHER) if r.n_chars else ():
            values = [m[name] for m in different]
            v = stats[key][name]
            lo, hi = -math.log(sum(x <= v for x in values) / n), -math.log(sum(x >= v for x in values) / n)
            mean = sum(values) / n
            m2 = sum((x - mean) ** 2 for x in values) / n
            skew = sum((x - mean) ** 3 for x in values) / n / m2**1.5 if m2 > 1e-12 else 0.0
            left, right, chosen = left + lo, right + hi, chosen + (lo if skew < 0 else hi)
        if r.n_chars:
            assert r.outlier_score == pytest.approx(max(left, right, chosen), abs=1e-3)
    assert quality.assess(df.limit(0)).count() == 0
    assert Counter(r.kind for r in got.values())["prose"] >= 40


def test_one_value_for_a_third_of_all_rows(spark):
    values = spark.range(900).selectExpr("'g' AS g", "IF(id % 3 = 0, 0.5D, CAST(id AS DOUBLE)) AS v").groupBy("g", "v").count().withColumnRenamed("count", "n")
    rows = {r.v: r for r in quality.exact_ranks(values, ["g"], "v", "n").collect()}
    assert rows[0.5].below == 0 and rows[0.5].n == 300 and rows[1.0].below == 300 and rows[899.0].below == 899 and all(r.total == 900 for r in rows.values())


BULLETS = "Annual permit:\n" + "- monthly ledger form\n- secure annex\n" * 6
JUNK = "xqzjk wvbnt rtplk zzkqw plkmn qwrtz bnmvc xcvbn lkjhg fdsap " * 2


@pytest.mark.parametrize(("text", "kind"), [(BULLETS, "list"), (JUNK, "junk")])
@pytest.mark.parametrize("lang", ["en", "xx"])
def test_copies_and_thin_languages_keep_their_kind(spark, text, kind, lang):
    prose = [(i, f"{PROSE * (1 + i % 4)}Form {i} is due.", "en") for i in range(40)]
    # A third of a language, all of a language, and the only row of one.
    for copies in (20, 1):
        df = spark.createDataFrame(prose + [(100 + i, text, lang) for i in range(copies)], "doc_id long, text string, lang string")
        got = {r.doc_id: r.kind for r in quality.assess(df).collect()}
        assert len(got) == 40 + copies and all(got[i] == ("prose" if i < 100 else kind) for i in got)


def test_directions_decide_over_the_tails():
    rng = np.random.default_rng(3)
    kinds = rng.integers(0, 4, 400)
    tails = rng.exponential(0.3, (400, 6))
    tails[np.arange(400), kinds] += 3
    weights, offsets = quality.fit_directions(tails, kinds)
    assert ((tails @ weights + offsets).argmax(axis=1) == kinds).mean() > 0.97
    weights, offsets = quality.fit_directions(np.empty((0, 6)), np.empty(0, dtype=int))
    assert (tails @ weights + offsets).argmax(axis=1).max() == 0


def test_ranks_decide_the_kind(spark, small):
    """Without the tails, nothing but prose would be found."""
    df = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    kinds = Counter(r.kind for r in quality.assess(df).collect())
    assert kinds["prose"] > kinds["list"] > 0 and kinds["table"] > 0 and kinds["junk"] > 0

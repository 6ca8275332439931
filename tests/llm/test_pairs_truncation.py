from __future__ import annotations

import pytest

from foliate.llm import endings, pairs, truncation

Q = "How long does Norsta keep the digital permit?"


@pytest.mark.parametrize(
    ("answer", "defect"),
    [
        (None, "empty"), ("", "empty"), (" \t\n", "empty"), ("​", "empty"), ("N/A", "empty"), ("...", "empty"), ("{}", "empty"),
        ("No [E1]", None), ("0 [E1].", None), ("None [E2].", None), ("Within 9 days [E1]", None),
        ("HOW LONG DOES NORSTA KEEP THE DIGITAL PERMIT?", "copies_question"), ("Question: " + Q + "\nAnswer:", "copies_question"), (Q + " [E1]", "copies_question"),
        ("how long dos norsta keep digital permit", "copies_question"), (Q + " No [E1]", None), ('On the question "' + Q + '": Within 64 percent [E3].', None),
        (Q + " The permit is kept for nine days after the first release.", None),
        ("I'm sorry, but I cannot help with that request.", "refusal"), ("No comment from my side on this point.", "refusal"),
        ("The evidence does not state the topic of the department.", None), ("The administrator cannot report the session [E1].", None), ("Unfortunately the operator is optional [E1].", None),
        ("Für den Antrag gilt eine Frist von 5 Wochen, danach wird er gelöscht. [E1]", "other_language"),
        ('The heading reads "El archivo de saldo permanece completo y luego queda eliminado." 9 weeks [E1]', None),
        ("- The certificate between Callin and Marra is measured and runs gradually [E2]", None),
        ("The permit is kept for nine days after the rele", None), ("I cannot answer that [E1].", "refusal"), ("I cannot help with that request. " + "Please ask the desk of the office for any further help. " * 20, "refusal"),
        ("PAY-DAT-040 and INV-DAT-021 [E1].", None), ('On the question "' + Q + '": HRM-FN-001 and LOG-FN-011 [E2].', None), ("The digital permit", None), ("Norsta keep the permit", None),
        ("Il permesso digitale è sempre a disposizione del cliente per nove giorni dopo la prima consegna.", "other_language"), ("Разрешение хранится девять дней после первой выдачи.", "other_language"),
        ("许可证在首次发布后保存九天。", "other_language"),
    ],
)
def test_each_defect(answer, defect):
    found, state, _ = pairs.judge(Q, answer)
    assert found == defect
    if answer and answer.endswith("rele"):
        assert state == "open"


@pytest.mark.parametrize(("answer", "refusing"), [("Dies möchte ich bestätigen: der Antrag wird geprüft.", False), ("Darf ich annehmen, dass er geprüft wird?", False), ("Dazu möchte ich mich nicht äußern.", True), ("Das darf ich leider nicht beantworten.", True)])
def test_german_verbs_refuse_only_with_a_negation(answer, refusing):
    assert pairs.refuses(answer) is refusing


def test_compression_decides_copies():
    # Nothing new in either answer, but a few words of the question do not repeat it.
    assert not pairs.adds(Q, "the digital permit") and not pairs.copies(Q, "the digital permit") and pairs.copies(Q, Q.lower())
    assert pairs.extra_share("the digital permit", Q) > pairs.ASKED_SHARE > pairs.extra_share(Q.lower(), Q)


def test_half_words_stay_open_in_large_collections(spark):
    """One sighting of half a word within a text does not make it whole."""
    rows = [(f"i{i}", f"Number {i} of the permit is due.") for i in range(50)] + [("x", "A remi is a thing.")] + [(f"t{i}", f"Number {i} is due.\n- Annex remi") for i in range(5)] + [("w", "It is due.\n- Annex permit")]
    df = spark.createDataFrame([(k, "m", t) for k, t in rows], "request_id string, model string, raw_generated_text string")
    found = {r.request_id for r in truncation.find_truncated(df).where("truncated").collect()}
    assert found == {f"t{i}" for i in range(5)}


def test_no_terminal_punctuation_at_a_limit_is_truncated(spark):
    rows = [(f"l{i}", ("The annex is due. " * 9)[: 118 - len(str(i))] + f"\n- Annex {i} permit"[-20:]) for i in range(12)]
    rows += [(f"s{i}", "The permit is due" + ", permit or not" * (2 * i) + ".\n- Annex permit") for i in range(30)]
    width = max(len(t) for _, t in rows[:12])
    rows = [(k, t.rjust(width, "x") if k[0] == "l" else t) for k, t in rows] + [("end", "y" * (width - 1) + ".")]
    df = spark.createDataFrame([(k, "m", t) for k, t in rows], "request_id string, model string, raw_generated_text string")
    found = {r.request_id: r.how for r in truncation.find_truncated(df).collect()}
    assert all(found[f"l{i}"] == "limit" for i in range(12)) and found["end"] is None and all(found[f"s{i}"] is None for i in range(30))


def test_pairs_over_a_table(spark):
    rows = [("a", Q, None, 1), ("a", Q, None, 2), ("b", Q, "It is kept for nine days after the rele", 1), ("c", None, "It is kept for nine days.", 1), ("d", Q, "x" * 50000, 1)]
    df = spark.createDataFrame(rows, "request_id string, question string, answer_text string, state int")
    got = {r.request_id: r.defect for r in pairs.find_defects(df).collect()}
    assert got == {"a": "empty", "b": "truncated", "d": "truncated"}
    assert pairs.find_defects(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "state"),
    [
        ('{"a": "x"}', "complete"), ('{"a": "x}', "open"), ('```json\n{"a": ["E1"]}\n```', "complete"), ('Here is the answer:\n{"a": ["E1"', "open"), ('{"a": "b \\" }', "open"),
        ("It is so. [E1]", "complete"), ("It is so [E1]\n\nSources: E1, E2", "complete"), ("It is so. [E1]\n\nEnd of answer", "complete"), ("It is so [E5] etc.", "complete"),
        ("It is so [E5]\n- Final annex and shift", "unsure"), ("It is so [E5]\n- Where the release and the c", "open"), ('It is so. [E3] (see "Annex B")', "complete"),
        ("It is assumed that the ordina...", "open"), ("It is assumed that the ordina [cut]", "open"), ("It is assumed [E", "open"), ("仮の記録は保存できない。", "complete"),
    ],
)
def test_endings(text, state):
    assert endings.ending(text)[0] == state


def test_truncation_with_a_limit(spark):
    rows = [(f"s{i}", "m", "Done in " + "y" * (i + 2) + " days.", "z") for i in range(60)]
    rows += [(f"l{i}", "m", ("The annex is due. " * 9)[: 150 - len(str(i))] + str(i), "z") for i in range(12)]
    rows += [("n", "m", None, "z"), ("e", "m", "", "z"), ("o", None, "Left in mid sen", "z"), ("o", None, "Left in mid sen", "z")]
    rows += [("t", "k", "All done. [E1]\n- Final annex", "z"), ("u", "k", "The final annex of all is here.", "z"), ("v", "k", "All done. [E1]\n- Final ann", "z")]
    df = spark.createDataFrame(rows, "request_id string, model string, raw_generated_text string, source string")
    found = {r.request_id: r for r in truncation.find_truncated(df).collect()}
    assert "n" not in found and "e" not in found and len(found) == 76
    assert all(found[f"l{i}"].how == "limit" for i in range(12)) and not any(found[f"s{i}"].truncated for i in range(60))
    assert found["o"].how == "open_prose" and not found["t"].truncated and found["v"].truncated
    rates = {r.source: (r.texts, r.truncated) for r in truncation.truncation_rates(truncation.find_truncated(df)).collect()}
    assert rates == {"m": (72, 12), "": (1, 1), "k": (3, 1)}
    assert truncation.find_truncated(df.limit(0)).count() == 0

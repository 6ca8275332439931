from __future__ import annotations

import pytest

from foliate.llm import scan_noise as S

KNOWN = frozenset("the reminder is scheduled within agreed window connector consolidated permit read only multi tenant and annex for each clerk of".split())
MISREAD = {"remindcr": "reminder", "corinector": "connector", "consol1dated": "consolidated", "ven€ra": None}


def _repair(text, pages=(3,), headers=(), page_lines=True):
    hashed = frozenset(S._line_hash(S.skeleton(h, [])) for h in headers)
    return S.Repairer(MISREAD, KNOWN).repair(text, list(pages), hashed, page_lines)


@pytest.mark.parametrize(
    ("text", "clean", "noise"),
    [
        ("the con-\nnector is scheduled", "the connector is scheduled", ["hyphenation"]), ("the con¬\nnector, and", "the connector, and", ["hyphenation"]), ("the con\xad \nnector", "the connector", ["hyphenation"]),
        ("is read-\nonly and", "is read-\nonly and", []), ("a multi-\ntenant annex", "a multi-\ntenant annex", []), ("the con-\n- 3 -\nnector is", "the connector is", ["hyphenation", "page_number"]),
        ("the con-\nPermit for the clerk | 3\nnector", "the connector", ["hyphenation", "running_header"]), ("the corine-\nctor", "the connector", ["hyphenation", "misread"]),
        ("the remindcr is consol1dated", "the reminder is consolidated", ["misread"]), ("Ven€ra", "Venera", ["misread"]), ("code K42 and 2x at 14:25!", "code K42 and 2x at 14:25!", []), ("466.0l and 2O36", "466.01 and 2036", ["misread"]),
        ("Page 3 of 9", "", ["page_number"]), ("[3]", "", ["page_number"]), ("iii", "", ["page_number"]), ("4", "4", []), ("p. 3\nthe permit", "the permit", ["page_number"]),
        ("PERMIT  for the c1erk", "", ["running_header"]), ("", "", []),
    ],
)
def test_repairs(text, clean, noise):
    got, found = _repair(text, headers=["Permit for the clerk"])
    assert found == noise
    assert got.split() == clean.split()


def test_cells_keep_their_figures():
    assert _repair("3", page_lines=False) == ("3", [])


def test_hash_differences():
    for read, meant in S.CONFUSIONS:
        assert (S.anagram_hash("x" + read + "y") + S.DIFFERENCES[read, meant]) % S.MODULUS == S.anagram_hash("x" + meant + "y")
    assert S.anagram_hash("龍" * 300) < 1 << 63
    assert "modern" in S._variants("modern".replace("m", "rn", 1)) and S.roman("xiv") == 14 and S.roman("iiii") is None and S.roman("") is None


def test_corrections_need_a_frequent_word(spark):
    words = [("reminder", 400), ("remindcr", 3), ("rerninder", 2), ("r€m1nder", 2), ("farm", 50), ("fann", 40), ("clear", 300), ("dear", 200), ("ab", 9), ("q€z", 1), ("mail@x.org", 1)]
    got = {r.word: r.meant for r in S.corrections(spark.createDataFrame(words, "word string, n long")).collect()}
    assert got == {"remindcr": "reminder", "rerninder": "reminder", "r€m1nder": "reminder", "q€z": None}


def test_tables_blocks_and_headers(spark, monkeypatch):
    head = "Annex of the monthly permit"
    rows = [("d", f"h{p}", p, f"{p}   {head}" if p % 2 else head.upper()) for p in range(2, 6)] + [("d", "in", 6, f"the permit is scheduled\n{head.replace('m', 'rn', 1)}\nand agreed"), ("e", "x", 1, head), ("d", "n", 2, None), ("d", "s", None, "the remind-\ner is due"), ("d", "h2", 2, head.upper())]
    rows += [("d", f"w{i}", 1, "the reminder is due and the annex of the permit") for i in range(40)]
    blocks = spark.createDataFrame([(*r, "x") for r in rows], "document_id string, block_id string, page_number int, text string, kind string")
    cell = "cells array<struct<cell_id:string,row_index:int,column_index:int,text:string>>"
    tables = spark.createDataFrame([("d", "t", 6, [6, 7], [("c0", 0, 0, "remindcr"), ("c1", 0, 1, None), ("c2", 0, 2, "6")], "the annex\n7\ndue"), ("d", "u", None, None, None, None)], f"document_id string, table_id string, page_number int, page_numbers array<int>, {cell}, native_text string")
    found = {(r.kind, r.document_id, r.record_id): (r.noise, r.clean_text) for r in S.repair_records(blocks, tables).collect()}
    assert all(found["block", "d", f"h{p}"][0] == ["running_header"] for p in range(2, 6)) and found["block", "d", "in"] == (["running_header"], "the permit is scheduled and agreed")
    assert found["block", "e", "x"][0] == [] and found["block", "d", "s"] == (["hyphenation"], "the reminder is due")
    assert found["cell", "d", "c0"] == (["misread"], "reminder") and found["cell", "d", "c2"][0] == [] and found["native_text", "d", "t"][0] == ["page_number"]
    assert ("block", "d", "n") not in found and ("cell", "d", "c1") not in found
    # A vocabulary that is joined gives the same as one that is sent.
    monkeypatch.setattr(S, "FREQUENT_WORDS", 3)
    joined = {(r.kind, r.document_id, r.record_id): (r.noise, r.clean_text) for r in S.repair_records(blocks, tables, vocabulary_bytes=0).collect()}
    assert joined == found
    assert S.repair_records(blocks.limit(0), tables.limit(0)).count() == 0


def test_other_half_at_any_distance():
    between = "\n".join(f"Unknown Line {i}" for i in range(9))
    assert _repair(f"the con-\n{between}\nnector is scheduled")[1] == ["hyphenation"]
    assert _repair("THE CON-\nUnknown line\nUnknown line\nUnknown line\nUnknown line\nNECTOR IS")[1] == ["hyphenation"]
    long = "Permit for the clerk " * 12
    assert _repair(long.upper(), headers=[long])[1] == ["running_header"]
    assert _repair(" " * 60 + "- 3 -" + " " * 60)[1] == ["page_number"]


def test_words_of_any_length_and_script(spark):
    words = [("龍" * 300, 5), ("c" * 40 + "lear", 500), ("c" * 20 + "e" + "c" * 19 + "lear", 2)]
    got = {r.word: r.meant for r in S.corrections(spark.createDataFrame(words, "word string, n long")).collect()}
    assert "龍" * 300 not in got


def test_two_letter_confusions_and_long_words(spark):
    long = "c" * 16 + "lessness"
    words = [("management", 400), ("rnanagernent", 2), ("reference", 400), ("rcfercnce", 3), (long, 400), (long[:-5] + "n€ss", 1), (long.replace("less", "l€ss"), 2)]
    got = {r.word: r.meant for r in S.corrections(spark.createDataFrame(words, "word string, n long")).collect()}
    assert got["rnanagernent"] == "management" and got["rcfercnce"] == "reference" and got[long.replace("less", "l€ss")] == long
    for word in ("rnanagernent", "rcfercnce", "r€m1nder", "f!|€"):
        assert all(S._misread_as(word, v) for v in S._variants(word)) and not S._misread_as(word, word) and not S._misread_as(word, "other")


TABLES = "document_id string, table_id string, page_number int, page_numbers array<int>, cells array<struct<cell_id:string,row_index:int,column_index:int,text:string>>, native_text string"


def test_no_null_lists_are_sent(spark, monkeypatch):
    # Each row sent after a null list costs as much as all rows since the last list that is not null.
    blocks = spark.createDataFrame([("d", "a", 1, "the permit"), ("e", "b", None, "the annex")], "document_id string, block_id string, page_number int, text string")
    tables = spark.createDataFrame([("d", "t", 6, [6], [("c", 0, 0, "clerk")], "the clerk")], TABLES)
    sent, plain = [], type(blocks).mapInArrow
    monkeypatch.setattr(type(blocks), "mapInArrow", lambda df, *a, **k: sent.append(df) or plain(df, *a, **k))
    for most in (S.VOCABULARY_BYTES, 0):
        assert {r.record_id: r.clean_text for r in S.repair_records(blocks, tables, most).collect()} == {"a": "the permit", "b": "the annex", "c": "clerk", "t": "the clerk"}
    lists = [(df, f.name) for df in sent for f in df.schema if f.dataType.typeName() == "array"]
    assert lists and all(df.where(f"{name} is null").count() == 0 for df, name in lists)


def test_texts_of_tables_without_pages(spark):
    blocks = spark.createDataFrame([], "document_id string, block_id string, page_number int, text string")
    tables = spark.createDataFrame([("f", "u", None, None, [("c", 0, 0, "clerk")], "the permit"), ("f", "v", None, [], None, "7")], TABLES)
    assert {r.record_id: (r.clean_text, r.noise) for r in S.repair_records(blocks, tables).collect()} == {"c": ("clerk", []), "u": ("the permit", []), "v": ("7", [])}


def test_doubts_are_found_between_any_spaces():
    for space in (" ", "\t", "\xa0", "\u3000", "\n", "\x1d"):
        assert _repair(f"the{space}permit{space}466.0l{space}within")[1] == ["misread"]
        assert _repair(f"the{space}(remindcr),{space}within")[1] == ["misread"]
        assert _repair(f"the{space}permit,{space}within")[1] == []


def test_counts_by_pieces_between_spaces():
    import pyarrow as pa

    texts = ["the permit,\xa0the (permit) ven€ra!! K42 14:25 a|b", "the con-\nnector is read\nin the annex-\n\nthe"]
    batch = pa.RecordBatch.from_arrays([pa.array([None, None], pa.string()), pa.array([None, None], pa.int32()), pa.array(texts)], names=["d", "p", "text"])
    (out,) = S._count(iter([batch]))
    got = {k: n for k, n in zip(out.column(1).to_pylist(), out.column(4).to_pylist(), strict=True) if n}
    assert got == {"the": 5, "permit": 2, "ven€ra": 1, "a|b": 1, "is": 1, "read": 1, "in": 1}

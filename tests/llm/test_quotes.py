"""Quotations linked to their writers."""

from __future__ import annotations

from quire.llm import quotes

ROWS = [
    (1, 0, "user", "Where is the key?\n\nI lost it."),
    (1, 1, "assistant", "> Where is  the KEY?\nUnder the mat."),
    (1, 2, "user", "Thanks."),
    (1, 3, "assistant", "> > Where is the key?\n> Under the mat.\nGlad to help."),
    (1, 4, "user", ">> I lost it.\nStill true?"),
    (2, 0, "user", "> Under the mat.\nWho said that?"),
    (2, 1, "user", "> nobody ever wrote this\n> Who said that?"),
    (2, 2, "user", "> Who said that?\n\n> Who said that?"),
    (2, 2, "user", "> Who said that?\n\n> Who said that?"),
    (3, 0, "user", None), (3, 1, "user", ""), (3, 2, "user", ">\n> "), (None, 0, "user", "> Thanks."), (4, None, None, "a > b"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, body string")


def test_links(spark):
    got = sorted(((r.conv_id, r.turn, r.thread, r.reply_turn, r.n_quotes, r.n_linked, r.body) for r in quotes.conversations(frame(spark, ROWS)).collect()), key=str)
    want = [
        (1, 0, 0, None, 0, 0, "Where is the key?\n\nI lost it."), (1, 1, 0, 0, 1, 1, "Under the mat."), (1, 2, 2, None, 0, 0, "Thanks."),
        (1, 3, 0, 1, 2, 2, "Glad to help."), (1, 4, 0, 0, 1, 1, "Still true?"),
        (2, 0, 0, None, 1, 1, "Who said that?"), (2, 1, 1, None, 1, 0, ""), (2, 2, 0, 0, 2, 2, ""), (2, 2, 0, 0, 2, 2, ""),
        (3, 0, 0, None, 0, 0, ""), (3, 1, 1, None, 0, 0, ""), (3, 2, 2, None, 0, 0, ""), (None, 0, 0, None, 1, 1, ""), (4, None, None, None, 0, 0, "a > b"),
    ]
    assert got == sorted(want, key=str)
    assert quotes.conversations(frame(spark, [])).count() == 0


def test_a_long_chain_of_answers_is_one_thread(spark):
    rows = [(1, 0, "user", "line 0")] + [(1, i, "user", f"> line {i - 1}\nline {i}") for i in range(1, 70)]
    got = quotes.conversations(frame(spark, rows)).collect()
    assert {r.thread for r in got} == {0} and {(r.turn, r.reply_turn) for r in got if r.turn} == {(i, i - 1) for i in range(1, 70)}


PARTS = [
    (1, 0, "user", "First line here.\nSecond line there.\nThird line nowhere.\n\nMiddle paragraph, left out.\n\nLast words of it. One more, said quickly; the end."),
    (1, 1, "user", "Nothing of that."),
    (1, 2, "user", "> First line here.\n> Second line there.\ntwo lines of a paragraph"),
    (1, 3, "user", "> First line here.\n> Second line there.\n> Third line nowhere.\n>\n> Last words of it. One more, said quickly; the end.\ntwo paragraphs of three"),
    (1, 4, "user", "> One more, said quickly\na part of a sentence"),
    (1, 5, "user", "> Last words\n> of it. One more,\n> said quickly\nwrapped again"),
    (1, 6, "user", "> Last words of it.\n> First line here.\nnot in this order"),
    (1, 7, "user", "> Last words of them.\nnever written"),
    (2, 0, "user", "> Middle paragraph\nfrom elsewhere"),
    (2, 1, "user", "Left out! That is whole elsewhere too."), (3, 0, "user", "Left out!"), (2, 2, "user", "> left out\nhere first"),
]


def test_parts_of_lines_and_paragraphs(spark):
    got = {(r.conv_id, r.turn): (r.thread, r.reply_turn, r.n_linked) for r in quotes.conversations(frame(spark, PARTS)).collect()}
    assert {t: got[1, t] for t in range(2, 8)} == {
        2: (0, 0, 1), 3: (0, 0, 1), 4: (0, 0, 1), 5: (0, 0, 1), 6: (6, None, 0), 7: (7, None, 0)
    }
    assert got[2, 0] == (0, None, 1) and got[2, 2] == (1, 1, 1)

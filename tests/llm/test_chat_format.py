"""Chat formatting: the text reads back, whatever it holds, and the machine knows the order."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from valora.llm.chat_format import ODD_TEXT, Template, format_chats, read_back

SCHEMA = "conv_id long, turn long, role string, text string"


def formatted(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r.conv_id: r for r in read_back(format_chats(df)).collect()}


def test_cases(spark):
    rows = [
        (1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"),
        (2, 0, "assistant", "first"), (3, 1, "user", "x"), (3, 0, "user", "y"),
        (4, 0, None, None), (5, None, "user", "null turn"), (5, 0, "assistant", ""),
        (6, 0, "user", "same"), (6, 0, "user", "same"), (None, 0, "user", "no id"),
        (7, 0, "odd: role = ### <x>\n", ODD_TEXT), (8, 0, "system", "alone"),
        (9, 0, "user", "x" * 200_000), (-7, 0, "user", ODD_TEXT), (-7, 1, "assistant", ODD_TEXT),
    ]
    got = formatted(spark, rows)
    assert [(t.role, t.text) for t in got[1].turns] == [("system", "s"), ("user", "u"), ("assistant", "a")]
    assert got[1].formatted == "### System: s </turn>\n### User: u </turn>\n### Assistant: a </turn>\n"
    assert [(s.text, s.loss) for s in got[1].segments if s.loss] == [("a", True)]
    valid = {k: (r.valid, r.bad_turn) for k, r in got.items()}
    assert valid[1] == (True, -1) and valid[2] == (False, 0) and valid[3] == (False, 1)
    assert valid[4] == (False, 0) and valid[5] == (True, -1) and valid[6] == (False, 1)
    assert valid[None] == (True, -1) and valid[8] == (False, -1)
    assert [t.text for t in got[3].turns] == ["y", "x"]
    assert [(t.role, t.text) for t in got[7].turns] == [(rows[12][2], ODD_TEXT)]
    assert [t.text for t in got[-7].turns] == [ODD_TEXT, ODD_TEXT]
    assert got[-7].formatted.count("### ") == 2 and got[-7].formatted.count("</turn>") == 2
    assert len(got[9].turns[0].text) == 200_000 and got[4].turns[0].role == ""


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "Role=", "System", "a:b"]), st.text("\\#<:=/turn> \nbhlceAé", max_size=20)), min_size=1, max_size=40))
def test_round_trip(spark, turns):
    rows = [(0, k, role, text) for k, (role, text) in enumerate(turns)]
    got = formatted(spark, rows)[0]
    assert [(t.role, t.text) for t in got.turns] == turns
    assert "".join(s.text for s in got.segments) == got.formatted


def test_empty(spark):
    assert read_back(format_chats(spark.createDataFrame([], SCHEMA))).count() == 0
    assert Template().final

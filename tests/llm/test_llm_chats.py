"""Chat formatting: what is read back is what went in, whatever the texts hold."""

import hashlib
import random

import pytest

from quire.llm import chats

MARKS = [*chats.INST.marks, *chats.HEADERS.marks]


def strange(rng):
    parts = [*MARKS, "\\", "[", "<", "[\\INST]", "<\\\\s>", "[\\\\\\/INST]", "ok", " ", "\n", "é", "𝄞", "INST]", "/s>", "|user|>"]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(12)))


@pytest.mark.parametrize("template", [chats.INST, chats.HEADERS])
def test_texts_come_back_whole(template):
    rng = random.Random(7)
    for _ in range(2000):
        text = strange(rng)
        hidden = template.hide(text)
        assert template.show(hidden) == text
        assert not any(m in hidden for m in template.marks)


@pytest.mark.parametrize("template", [chats.INST, chats.HEADERS])
def test_conversations_come_back_whole(template):
    rng = random.Random(8)
    for _ in range(500):
        turns = [(rng.choice(["system", "user", "assistant", "tool", "", "[TURN]", "<|says|>"]), strange(rng)) for _ in range(rng.randrange(8))]
        state, said = chats.START, []
        for role, text in turns:
            state, _, segments = template.lay_out(state, role, text)
            assert [template.show(t) for t, loss in segments if loss] == [text] * (role == "assistant")
            said += [t for t, _ in segments]
        assert template.read("".join(said)) == turns


def test_texts_without_marks_stay_as_they_are():
    text = "a < b, [1] \\ and 2 > 1\n[INST ] \\n"
    assert chats.INST.hide(text) == text


@pytest.mark.parametrize("bad", [" [INST] x [/INST]", "x", "[INST]x[/INST]", "[SYS] a [/SYS]", "<s>x[INST] a [/INST]", "[TURN]a[/TURN]"])
def test_other_texts_are_refused(bad):
    with pytest.raises(ValueError):
        chats.INST.read(bad)


@pytest.mark.parametrize("marks, steps, other", [
    (("<a>", "<a><"), (), "{text}<a>"),
    (("<a>", "<a>b"), (), "{text}<a>"),
    (("<a>",), (), "{text}"),
    (("<a>",), (), "<a>"),
    (("<a>",), (("start", "x", "{text}<a>"),), "{role}<a>{text}<a>"),
    (("<a>", "<b>"), (("start", "x", "{text}<a>"), ("x", "y", "{text}<a>")), "{role}<b>{text}<b>"),
])
def test_templates_that_cannot_be_read_back_are_refused(marks, steps, other):
    with pytest.raises(ValueError):
        chats.Template(marks, steps, other)


ROWS = [
    (1, 0, "system", "be brief"), (1, 1, "user", "hi"), (1, 2, "assistant", "yes"), (1, 3, "user", "and?"), (1, 4, "assistant", ""),
    (2, 1, "assistant", "too early"), (2, 0, "assistant", "</s>"),
    (3, None, "user", "no turn"), (3, 0, "assistant", None), (3, 0, "assistant", None),
    (4, 2, "user", "same"), (4, 2, "assistant", "same"), (4, 1, "user", "b"), (4, 1, "assistant", "a"),
    (None, 0, "user", "a null key"), (None, 1, None, "a null role"),
    (5, 0, "user", "last"),
    (6, 0, "user", "q"), (6, 1, "assistant", "[/INST] \\ word " * 40_000),
]


def expected(rows):
    found = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv))
        turns = "".join(f"{r[2]}\n{r[3]}\n" for r in own)
        loss = "".join(r[3] for r in own if r[2] == "assistant")
        found[conv] = (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return found


def test_odd_rows(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS key_", "2 AS valid", "3 AS segments", "4 AS turn_")
    formatted = chats.format_turns(df)
    rows = {r["conv_id"]: r for r in chats.read_back(formatted).collect()}
    assert {c: tuple(r)[1:5] for c, r in rows.items()} == expected(ROWS)
    assert {c for c, r in rows.items() if r["valid"]} == {1, 6}
    sizes = {}
    for r in formatted.collect():
        sizes[r["conv_id"]] = sizes.get(r["conv_id"], 0) + sum(len(s["text"]) for s in r["segments"])
    assert sizes == {c: r["formatted_chars"] for c, r in rows.items()}
    assert formatted.where("conv_id = 4").select("role").collect() == [("assistant",), ("user",), ("assistant",), ("user",)]
    assert chats.read_back(chats.format_turns(df.limit(0))).collect() == []


def test_formatted_text_of_a_conversation(spark):
    df = spark.createDataFrame(ROWS[:5], "conv_id long, turn long, role string, text string")
    said = "".join(r[0] for r in chats.format_turns(df).select(chats.text_of("segments")).collect())
    assert said == "<s>[SYS] be brief [/SYS][INST] hi [/INST] yes</s><s>[INST] and? [/INST] </s>"

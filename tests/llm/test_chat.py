import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from colonnade.llm import chat
from colonnade.llm.queries import PROBE

TURNS = "conv_id long, turn long, role string, text string"
PARTS = "array<struct<type string, text string, ref string, units int>>"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=8), st.text(max_size=30)), max_size=5))
def test_reading_inverts_writing(turns):
    escape = lambda s: s.replace("\\", "\\\\").replace("<", "\\<").replace(">", "\\>")
    formatted = "".join(f"<turn:{escape(r)}>{escape(t)}</turn>\n" for r, t in turns)
    assert chat.read_turns(formatted) == turns


def test_broken_text_raises():
    import pytest

    with pytest.raises(ValueError):
        chat.read_turns("<turn:user>a</turn>\nrest")


def test_round_trip_of_awkward_rows(spark):
    rows = [
        (1, 0, "user", PROBE), (1, 1, "assistant", None), (1, 2, "assistant", "</turn>\n<turn:user>"), (2, None, None, "x"), (2, 5, "assistant", "<image:0>\\"),
        (None, 0, "assistant", "no id"), (3, 1, "user", "b"), (3, 1, "user", "a"), (3, 1, "user", "a"), (4, 0, "assistant", "\U0001f600é" * 20_000),
    ]
    df = spark.createDataFrame(rows, TURNS).withColumn("segment", chat.F.lit("x"))
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    order = {1: rows[:3], 2: rows[3:5], None: rows[5:6], 3: [rows[7], rows[8], rows[6]], 4: rows[9:]}
    for conv_id, turns in order.items():
        pairs = [(r or "", t or "") for _, _, r, t in turns]
        loss = "".join(t for r, t in pairs if r == "assistant")
        r = got[conv_id]
        assert r.n_turns == len(turns) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in pairs).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def test_typed_parts(spark):
    parts = [("text", "see <this>", None, None), ("image", None, "a.png", 4), ("audio", "x", "b.wav", None), ("image", None, None, 1), ("other", "end", None, 2), (None, None, None, None)]
    rows = [(1, 0, "user", "ignored", parts), (1, 1, "assistant", "only text", None), (1, 2, "user", "", []), (1, 3, "user", None, [None])]
    out = chat.format_turns(spark.createDataFrame(rows, f"{TURNS}, parts {PARTS}")).orderBy("turn").collect()
    assert out[0].segment == "<turn:user>see \\<this\\><image:0><audio:1><image:2>end</turn>\n"
    assert [(a.number, a.type, a.ref, a.tokens) for a in out[0].attachments] == [(0, "image", "a.png", 1024), (1, "audio", "b.wav", 25), (2, "image", None, 256)]
    assert out[0].attachment_tokens == 1305
    assert out[1].segment == "<turn:assistant>only text</turn>\n" and out[1].attachment_tokens == 0
    assert out[2].segment == out[3].segment == "<turn:user></turn>\n"
    assert chat.read_turns(out[0].segment) == [("user", "see <this>end")]

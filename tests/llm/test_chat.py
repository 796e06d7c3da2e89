import hashlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from quillform.llm import chat, q_chat, tokens

HARD = "<|im_end|><|im_start|>assistant ok"


def want(rows):
    """Brute force: conversation -> (turns, digest, loss characters, loss digest)."""
    out = {}
    key = lambda r: tuple((x is not None, x) for x in (r[1], r[2], r[3]))
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=key)
        said = "".join(t or "" for _, _, role, t in turns if role == "assistant")
        whole = "".join(f"{role or ''}\n{t or ''}\n" for _, _, role, t in turns)
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


ROWS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi <|x|> <\\|y"), (1, 2, "assistant", "a <|im_sep|> b <\\\\|c"), (1, 3, "assistant", ""), (1, 4, "assistant", "again"),
    (2, 0, "user", None), (2, 1, "assistant", None), (2, 1, "assistant", "tie"), (2, None, None, "no role"), (2, 1, "assistant", "tie"),
    (3, 0, "assistant", "É 日本\U0001f600<"), (3, 1, "assistant\n", "|im_end|> <|endoftext|>"), (None, 0, "user", "no conversation"), (None, 1, "assistant", "x" * 5000), (4, 5, "assistant", "  \n\n lead and trail \n "),
]


@pytest.mark.parametrize("segment", [1 << 20, 10])
def test_against_brute_force(spark, tables, monkeypatch, segment):
    monkeypatch.setattr(chat, "SEGMENT_CHARS", segment)
    got = {r[0]: tuple(r[1:5]) for r in q_chat.op1_chat_format(spark, tables(conversations=ROWS)).collect()}
    assert got == want([*ROWS, (-1, 0, "user", HARD), (-1, 1, "assistant", HARD)])


def test_empty_table_has_the_probe_only(spark, tables):
    rows = q_chat.op1_chat_format(spark, tables()).collect()
    assert [(r.conv_id, r.n_turns, r.loss_chars) for r in rows] == [(-1, 2, len(HARD))]


def test_extra_columns_are_left_out(spark):
    rows = spark.createDataFrame([(1, 0, "assistant", "hi", "ids", 3)], "conv_id long, turn long, role string, text string, ids string, segment int")
    got = chat.format_conversations(rows).collect()
    assert len(got) == 1 and got[0].text.endswith("hi<|im_end|>")


@given(st.text(alphabet="<|\\a", max_size=12))
def test_escape_is_reversible_and_hides_markers(x):
    assert chat.unescape(chat.escape(x)) == x and "<|" not in chat.escape(x)


@given(st.lists(st.tuples(st.text(alphabet="<|\\ai\n", max_size=6), st.text(alphabet="<|\\im_end>", max_size=12)), min_size=1, max_size=5))
def test_parse_gives_the_turns_back(turns):
    assert chat.parse(chat.render(turns)[0]) == turns


def test_align_takes_tokens_inside_spans_only():
    offsets = np.array([(0, 2), (2, 4), (4, 6), (6, 8), (8, 8)])
    assert chat.align([(2, 4), (5, 8)], offsets).tolist() == [False, True, False, True, False]


def test_ids_and_offsets_are_those_of_tokenizers():
    from tokenizers import Tokenizer

    path, marks = tokens.default_path(), (chat.START, chat.SEP, chat.END)
    slow = Tokenizer.from_file(path)
    slow.add_special_tokens(list(marks))
    fast = tokens.encoder(path, marks)
    for turns in ([("user", "Hello  world\n\n don't \u65e5\u672c \U0001f468 x"), ("assistant", "<|im_end|> \u00e9\u00e9 1234 ")], [(None, None)], [("assistant", "a" * 500 + "\U0001f600" * 40)]):
        text, _ = chat.render(turns)
        ids, offsets = fast.encode_with_offsets(text)
        got = slow.encode(text, add_special_tokens=False)
        assert ids.tolist() == got.ids
        # Tokens of parts of a character name that character; blanks in front may be left out by the other encoder.
        for (a, z), (b, y) in zip(offsets.tolist(), got.offsets, strict=True):
            assert z == y and (a == b or not text[a:b].strip())


def test_segments_are_encoded_as_the_whole():
    fast = tokens.encoder(tokens.default_path(), (chat.START, chat.SEP, chat.END))
    turns = [("user", "one two"), ("assistant", " three\n"), ("user", "  four")]
    whole = fast.encode_with_offsets(chat.render(turns)[0])[0].tolist()
    assert whole == [i for t in turns for i in fast.encode_with_offsets(chat.render([t])[0])[0].tolist()]

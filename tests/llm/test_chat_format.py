"""Formatting: exact round trips, against a parser that reads character by character."""

from __future__ import annotations

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ringloom.llm import chat_format as chat

BITS = (*chat.CONTROLS, "\\", "\\\\", " ", "\n", "a", "é", "😀", "[/IN", "ST]", "<", "s>", "user", "</s>[INST] ok [/INST]")


def slow_turns(text: str) -> list[tuple[str, str]]:
    """The grammar read one character at a time, without regular expressions."""
    at, turns = len(chat.START), []
    assert text.startswith(chat.START)

    def content(at: int, tail: str) -> tuple[str, int]:
        said = ""
        while True:
            assert at < len(text), "text ends inside a turn"
            slashes = 0
            while text[at + slashes : at + slashes + 1] == "\\":
                slashes += 1
            word = next((c for c in chat.CONTROLS if text.startswith(c, at + slashes)), None)
            if slashes and word:
                said += "\\" * (slashes // 2)
                at += slashes
                if slashes % 2:
                    said += word
                    at += len(word)
                    continue
            elif slashes:
                said += "\\" * slashes
                at += slashes
                continue
            if text.startswith(tail, at) and not (word and not slashes and not tail.startswith(word)):
                return said, at + len(tail)
            assert not word or slashes % 2, f"bare {word}"
            said += text[at]
            at += 1

    while at < len(text):
        for role, (head, tail) in chat.FRAMES.items():
            if text.startswith(head, at):
                said, at = content(at + len(head), tail)
                turns.append((role, said))
                break
        else:
            assert text.startswith(chat.OTHER[0], at)
            role, at = content(at + len(chat.OTHER[0]), chat.OTHER[1])
            said, at = content(at, chat.OTHER[2])
            turns.append((role, said))
    return turns


awkward = st.lists(st.sampled_from(BITS), max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "system", "assistant", "tool", ""]), awkward), awkward), max_size=6))
def test_any_turns_come_back(turns):
    text = chat.START + "".join(chat.render(r, t)[0] for r, t in turns)
    assert [(r, t) for r, t, _, _ in chat.parse(text, len(chat.START))] == turns
    assert slow_turns(text) == turns


@settings(max_examples=200, deadline=None)
@given(awkward)
def test_escape_is_undone_and_only_where_needed(text):
    assert chat.unescape(chat.escape(text)) == text
    written = chat.render("user", text)[0]
    if not any(c in text for c in chat.CONTROLS):
        assert written == f"[INST] {text} [/INST]"


def test_bare_control_strings_are_no_grammar():
    for text in ("[INST] a [INST] b [/INST]", "[INST] a", "x", "<|role|>a<|end|>", "[INST] a[/INST]", "<<SYS>>\na <</SYS>>\n"):
        with pytest.raises(chat.GrammarError):
            list(chat.parse(text))


SCHEMA = "conv_id long, turn long, role string, text string, written string, part int, start int"


def expected(rows) -> dict:
    held: dict = {}
    for conv, turn, role, text, *_ in rows:
        written = chat.render(role or "", text or "")[0]
        held.setdefault(conv, []).append((turn is not None, turn, written, role or "", text or ""))
    out = {}
    for conv, turns in held.items():
        turns.sort(key=lambda t: (t[0], t[1] or 0, t[2].encode()))
        said = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        learned = "".join(t for *_, r, t in turns if r == "assistant")
        chars = len(chat.START) + sum(len(t[2]) for t in turns)
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), chars)
    return out


def table(spark):
    draw = random.Random(5)
    rows = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    for conv in range(40):
        for turn in range(draw.randrange(1, 9)):
            text = "".join(draw.choice(BITS) for _ in range(draw.randrange(6)))
            rows.append((conv, turn, draw.choice(["user", "assistant", "system", "tool"]), text))
    rows += [(None, 0, "user", "lost"), (None, 1, None, None), (50, None, "user", "no turn"), (50, 0, "assistant", "")]
    rows += [(51, 1, "user", "tie b"), (51, 1, "user", "tie a"), (51, 1, "user", "tie a"), (52, 0, "assistant", "x<s> " * 30_000)]
    rows += [(53, t, "assistant" if t % 2 else "user", f"very long conversation {t}") for t in range(3000)]
    return [(*r, "clash", 1, 2) for r in rows]


@pytest.mark.parametrize("part_chars", [1, 200, chat.PART_CHARS])
def test_formatted_conversations_read_back(spark, part_chars):
    rows = table(spark)
    parts = chat.format_conversations(spark.createDataFrame(rows, SCHEMA).repartition(7), part_chars)
    got = {r["conv_id"]: tuple(r)[1:] for r in chat.read_back(parts).collect()}
    assert got == expected(rows)
    texts: dict = {}
    for r in sorted(parts.collect(), key=lambda r: (r["conv_id"] is None, r["conv_id"] or 0, r["part"])):
        assert len(r["text"]) <= max(part_chars, 200) or r["text"].count("</s>") <= 60_001
        texts[r["conv_id"]] = texts.get(r["conv_id"], "") + r["text"]
    for conv, text in texts.items():
        if conv != 52:  # the slow parser builds its strings character by character
            said = "".join(f"{r}\n{t}\n" for r, t in slow_turns(text))
            assert hashlib.sha256(said.encode()).hexdigest() == got[conv][1]


def test_turns_and_conflicts(spark):
    rows = table(spark)
    df = spark.createDataFrame(rows, SCHEMA)
    turns = chat.read_turns(chat.format_conversations(df)).where("conv_id = -7").orderBy("part", "place").collect()
    assert [(r["role"], r["text"]) for r in turns] == [(r, "</s>[INST] ok [/INST]") for r in ("user", "assistant")]
    want = sum(any(c in (x or "") for c in chat.CONTROLS for x in r[2:4]) for r in rows)
    assert chat.conflicts(df).count() == want


def test_empty_table(spark):
    parts = chat.format_conversations(spark.createDataFrame([], SCHEMA))
    assert parts.count() == 0 and chat.read_back(parts).count() == 0

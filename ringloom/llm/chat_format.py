r"""Chat formatting: turns rendered by a template, parsed back, and escaped until they come back.

Grammar of a formatted conversation (one look-ahead decides; ``text`` holds no bare control string)::

    conversation = "<s>" turn*
    turn         = "[INST] " text " [/INST]"                       role user
                 | "<<SYS>>\n" text "\n<</SYS>>\n"                 role system
                 | " " text " </s>"                                role assistant
                 | "<|role|>" role "\n<|text|>" text "\n<|end|>"   any other role

A control string inside a text or role is written after a backslash, and backslashes that stand
directly before it are doubled, so that a run of k of them becomes 2k+1. Backslashes elsewhere
mean themselves (a space or newline keeps them off the template's own control strings). A turn is first rendered as it is and parsed; only if it doesn't come back is
its content escaped and parsed again, so texts without conflicts keep every character.

Work on texts is per row and needs no shuffle. Only rendered turns are dealt by conversation,
sorted, and read as a stream: a conversation of any length is written in parts of bounded size and
hashed part by part, so a task never holds one whole. Its parts do lie in one task, since a hash of
the whole conversation is a chain.

Nulls: a null text or role is empty, a null turn comes first, rows without conv_id are one
conversation without id. Rows of one turn number are ordered by their rendered text; repeated rows
are repeated turns. An empty table has no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|role|>", "<|text|>", "<|end|>")
START = "<s>"
# What a turn of a role is written between; other roles are written out.
FRAMES = {"user": ("[INST] ", " [/INST]"), "system": ("<<SYS>>\n", "\n<</SYS>>\n"), "assistant": (" ", " </s>")}
OTHER = ("<|role|>", "\n<|text|>", "\n<|end|>")
LEARNED = "assistant"
PART_CHARS = 1 << 20

PARTS = "conv_id long, part int, text string, loss array<struct<start: int, stop: int>>"
_MARK = re.compile(r"(\\*)(" + "|".join(map(re.escape, CONTROLS)) + ")")


class GrammarError(ValueError):
    """A formatted text that the grammar doesn't have."""


def escape(text: str) -> str:
    return _MARK.sub(lambda m: m[1] * 2 + "\\" + m[2], text)


def unescape(text: str) -> str:
    """Undoes ``escape``; a control string without a backslash of its own stays."""
    return _MARK.sub(lambda m: m[1][: len(m[1]) // 2] + m[2], text)


def _until(text: str, at: int, frame: str) -> tuple[str, int]:
    """Content from ``at`` up to the first bare control string, which must be that of ``frame``."""
    for m in _MARK.finditer(text, at):
        if len(m[1]) % 2:
            continue
        bare = m.start(2)
        begin = bare - frame.index(m[2]) if m[2] in frame else -1
        if begin < at or not text.startswith(frame, begin):
            raise GrammarError(f"{m[2]} at {bare}")
        # Backslashes right before the bare string belong to the content.
        return unescape(text[at:begin]), begin + len(frame)
    raise GrammarError(f"no {frame.strip()} after {at}")


def parse(text: str, at: int = 0) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, stop) of each turn from ``at`` on; start and stop are those of the
    text's written form."""
    while at < len(text):
        for role, (head, tail) in FRAMES.items():
            if text.startswith(head, at):
                begin = at + len(head)
                said, at = _until(text, begin, tail)
                yield role, said, begin, at - len(tail)
                break
        else:
            if not text.startswith(OTHER[0], at):
                raise GrammarError(f"no turn at {at}")
            role, begin = _until(text, at + len(OTHER[0]), OTHER[1])
            said, at = _until(text, begin, OTHER[2])
            yield role, said, begin, at - len(OTHER[2])


def _comes_back(written: str, role: str, text: str) -> tuple[int, int] | None:
    """Where the text stands in the one turn ``written``, if it is read as that turn."""
    try:
        turns = list(parse(written))
    except GrammarError:
        return None
    return turns[0][2:] if [t[:2] for t in turns] == [(role, text)] else None


def render(role: str, text: str) -> tuple[str, int, int]:
    """The turn as written, and start and stop of its text in it.

    Tries the content as it is, then with the text escaped, then with the role as well.
    """
    for role_, text_ in ((role, text), (role, escape(text)), (escape(role), escape(text))):
        head, tail = FRAMES.get(role, (OTHER[0] + role_ + OTHER[1], OTHER[2]))
        written = head + text_ + tail
        if place := _comes_back(written, role, text):
            return written, *place
    raise GrammarError(f"turn of {role!r} doesn't come back")


def _render_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        made = [render(r or "", t or "") for r, t in zip(batch["role"], batch["text"], strict=True)]
        out = pd.DataFrame(made, columns=["written", "start", "stop"])
        out["learned"] = (batch["role"] == LEARNED).to_numpy(bool)
        out["conv_id"], out["turn"] = batch["conv_id"].array, batch["turn"].array
        yield out


def _dealt(df: DataFrame, *order: str) -> DataFrame:
    """Rows of a conversation together and in order, conversations read as a stream."""
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def _ids(batch: pd.DataFrame) -> list:
    return [None if pd.isna(i) else int(i) for i in batch["conv_id"]]


def _pack(part_chars: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, part, pieces, size, loss = (), 0, [], 0, []
        for batch in batches:
            done = []
            rows = zip(_ids(batch), batch["written"], batch["start"], batch["stop"], batch["learned"], strict=True)
            for conv, written, start, stop, learned in rows:
                if now != (conv,):
                    if now:
                        done.append((*now, part, "".join(pieces), loss))
                    now, part, pieces, size, loss = (conv,), 0, [START], len(START), []
                elif size + len(written) > part_chars:
                    done.append((*now, part, "".join(pieces), loss))
                    part, pieces, size, loss = part + 1, [], 0, []
                if learned:
                    loss.append({"start": size + start, "stop": size + stop})
                pieces.append(written)
                size += len(written)
            yield _frame(done, ["conv_id", "part", "text", "loss"])
        if now:
            yield _frame([(*now, part, "".join(pieces), loss)], ["conv_id", "part", "text", "loss"])

    return pack


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    made = pd.DataFrame(rows, columns=names, dtype=object)
    made["conv_id"] = made["conv_id"].astype("Int64")
    return made


def format_conversations(rows: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """(conv_id, part, text, loss) from ``rows`` (conv_id, turn, role, text).

    ``text`` of a conversation's parts, joined in order, is its formatted form; most have one part.
    A part ends between turns, at ``part_chars`` characters at the latest unless a single turn is
    longer. ``loss`` lists start and stop (code points within the part) of what is learned: the
    written texts of the assistant.
    """
    schema = "written string, start int, stop int, learned boolean, conv_id long, turn long"
    written = rows.select("conv_id", "turn", "role", "text").mapInPandas(_render_rows, schema)
    return _dealt(written, "turn", "written").mapInPandas(_pack(part_chars), PARTS)


class _Reader:
    """Digests of one conversation, part by part."""

    def __init__(self) -> None:
        self.turns, self.learned, self.chars = 0, 0, 0
        self.said, self.loss = hashlib.sha256(), hashlib.sha256()

    def read(self, part: int, text: str, loss: list) -> None:
        at = 0
        if part == 0:
            if not text.startswith(START):
                raise GrammarError("no start")
            at = len(START)
        for role, said, _, _ in parse(text, at):
            self.turns += 1
            self.said.update(f"{role}\n{said}\n".encode())
        for span in loss:
            said = unescape(text[span["start"] : span["stop"]])
            self.learned += len(said)
            self.loss.update(said.encode())
        self.chars += len(text)

    def row(self) -> tuple:
        return self.turns, self.said.hexdigest(), self.learned, self.loss.hexdigest(), self.chars


_DIGESTS = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    now, reader = (), None
    for batch in batches:
        done = []
        for conv, part, text, loss in zip(_ids(batch), batch["part"], batch["text"], batch["loss"], strict=True):
            if now != (conv,):
                if now:
                    done.append((*now, *reader.row()))
                now, reader = (conv,), _Reader()
            reader.read(part, text, loss)
        yield _frame(done, list(_DIGESTS))
    if now:
        yield _frame([(*now, *reader.row())], list(_DIGESTS))


def read_back(parts: DataFrame) -> DataFrame:
    """What a reader of formatted ``parts`` (conv_id, part, text, loss) finds.

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars): the digest of role,
    newline, text, newline of every parsed turn, that of the unescaped text under the loss spans,
    and code points.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return _dealt(parts.select("conv_id", "part", "text", "loss"), "part").mapInPandas(_read, schema)


def read_turns(parts: DataFrame) -> DataFrame:
    """(conv_id, part, place, role, text) of every turn parsed from ``parts``, part by part."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (conv, part, place, role, said)
                for conv, part, text in zip(_ids(batch), batch["part"], batch["text"], strict=True)
                for place, (role, said, _, _) in enumerate(parse(text, len(START) if part == 0 else 0))
            ]
            yield _frame(rows, ["conv_id", "part", "place", "role", "text"])

    return parts.select("conv_id", "part", "text").mapInPandas(read, "conv_id long, part int, place int, role string, text string")


def conflicts(rows: DataFrame) -> DataFrame:
    """``rows`` whose text or role holds a control string, which formatting escapes."""
    held = [F.contains(F.col(c), F.lit(s)) for c in ("role", "text") for s in CONTROLS]
    any_ = held[0]
    for h in held[1:]:
        any_ = any_ | h
    return rows.where(F.coalesce(any_, F.lit(False)))

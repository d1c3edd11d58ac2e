"""Seeded ring hash as Spark column expressions.

The hash is a polynomial over UTF-16 code units, ``h = 31 h + unit (mod 2**32)``,
followed by a xor-shift finalizer. Spark has no unsigned 32-bit type, so every state
is a bigint in ``[0, 2**32)``.

The polynomial is resumable: hashing ``a || b`` equals hashing ``b`` from the state
that ``a`` left. Keys with a common head are therefore hashed head first, once, and
only the tail is hashed per row (see ``init``). Text arguments are SQL expressions.

There are two evaluations of the same function. The expressions stay in the JVM and take
their start state from a column; use them for small sides and short tails. The ``batched``
ones hash whole Arrow batches column-wise; on long paths they measured an order of magnitude
faster, and the hash is the one costly step per target.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the hash definition.
MASK32 = 4294967295
FACTOR = 31
FINAL_MULTIPLIER = 73244475  # 0x45d9f3b


def _fold(text: str, init: int | str, finish: str = "h") -> str:
    """SQL for the polynomial over ``text``; a code point outside the BMP counts as its two
    surrogates. ``finish`` rewrites the final state ``h``."""
    return f"""
        IF({text} = '', transform(array(CAST({init} AS BIGINT)), h -> {finish})[0], aggregate(
            transform(split({text}, ''), c -> CAST(ascii(c) AS BIGINT)),
            CAST({init} AS BIGINT),
            (h, c) -> IF(c < 65536,
                (h * {FACTOR} + c) & {MASK32},
                ((h * {FACTOR} + 55296 + shiftright(c - 65536, 10)) * {FACTOR}
                    + 56320 + ((c - 65536) & 1023)) & {MASK32}),
            h -> {finish}))"""


def _shift_xor(v: str) -> str:
    return f"(({v}) ^ shiftright({v}, 16))"


def _mix(state: str) -> str:
    return _shift_xor(f"({_shift_xor(state)} * {FINAL_MULTIPLIER}L) & {MASK32}")


def hash_state(text: str, init: int | str = 0) -> Column:
    """Polynomial state after the SQL expression ``text``, starting from ``init`` (a number
    or the name of a state column)."""
    return F.expr(f"coalesce({_fold(text, init)}, CAST({init} AS BIGINT))")


def hash_final(state: str) -> Column:
    """Finalizer for a state column."""
    return F.expr(_mix(state))


def ring_position(text: str, init: int | str = 0) -> Column:
    """Ring position of ``init`` extended by ``text``.

    The finalizer runs inside the fold's last step, where the state is a bound variable, so
    the fold is evaluated once per row. The outer ``coalesce`` makes the value non-nullable:
    no ``isnotnull`` copy of the fold is pushed into a scan filter.
    """
    return F.expr(f"coalesce({_fold(text, init, _mix('h'))}, {_mix(f'CAST({init} AS BIGINT)')}, 0L)")


def literal_state(text: str, init: int = 0) -> int:
    """State of a constant prefix, worked out once while the plan is built."""
    state = init
    raw = text.encode("utf-16-le")
    for low, high in zip(raw[::2], raw[1::2]):
        state = (state * FACTOR + low + 256 * high) & MASK32
    return state


def _code_units(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-16 code units of a string array, and where each string starts (n + 1 offsets)."""
    text = text.cast(pa.string())
    _, offsets, data = text.buffers()
    bounds = np.frombuffer(offsets, np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    if not len(raw) or raw.max() < 0x80:
        return raw, bounds
    # Units per byte: none for a continuation byte, two for the lead of a four-byte sequence.
    units = np.where(raw >= 0xF0, 2, np.where((raw & 0xC0) == 0x80, 0, 1))
    at = np.concatenate([[0], np.cumsum(units)])
    return np.frombuffer(raw.tobytes().decode().encode("utf-16-le"), "<u2"), at[bounds]


def _batch_states(text: pa.Array, init: int) -> np.ndarray:
    """States of a string array: one step per character position over all strings that long."""
    units, bounds = _code_units(text)
    lengths = np.diff(bounds)
    order = np.argsort(-lengths, kind="stable")
    start, sorted_lengths = bounds[:-1][order], lengths[order]
    running = np.full(len(lengths), init, np.uint32)
    longest = int(sorted_lengths[0]) if len(lengths) else 0
    alive = np.searchsorted(-sorted_lengths, -np.arange(longest), side="left")
    for i in range(longest):
        n = alive[i]
        running[:n] = running[:n] * np.uint32(FACTOR) + units[start[:n] + i]
    states = np.empty_like(running)
    states[order] = running
    return states


def final_array(h: np.ndarray) -> np.ndarray:
    """Finalizer of a uint32 array."""
    h = h ^ (h >> np.uint32(16))
    h = h * np.uint32(FINAL_MULTIPLIER)
    return h ^ (h >> np.uint32(16))


def _batched(text: str, finish: Callable[[np.ndarray], np.ndarray], init: int) -> Column:
    def evaluate(batch: pa.Array) -> pa.Array:
        # A null is an empty string here and keeps the start state.
        return pa.array(finish(_batch_states(batch.fill_null(""), init)).astype(np.int64))

    # The type hints select the array-to-array form of the UDF.
    evaluate.__annotations__ = {"batch": pa.Array, "return": pa.Array}
    return F.arrow_udf(evaluate, "bigint")(F.expr(text))


def batched_state(text: str, init: int = 0) -> Column:
    return _batched(text, lambda h: h, init)


def batched_position(text: str, init: int = 0) -> Column:
    return _batched(text, final_array, init)


def string_seed(text: str) -> Column:
    """Signed 32-bit string hash code."""
    return F.expr(f"coalesce({_fold(text, 0, 'h - IF(h >= 2147483648, 4294967296, 0)')}, 0L)")


def parse_seed(text: str) -> Column:
    """The integer a string spells, else its string hash code."""
    spelled = F.expr(f"IF({text} RLIKE '^[ ]*[+-]?[0-9]+[ ]*$', try_cast({text} AS BIGINT), NULL)")
    return F.coalesce(spelled, string_seed(text))


def seed_from_text(text: str) -> int:
    """Driver-side twin of ``parse_seed`` for one run parameter."""
    stripped = text.strip()
    digits = stripped[1:] if stripped[:1] in ("+", "-") else stripped
    if digits.isascii() and digits.isdigit() and -(2**63) <= int(stripped) < 2**63:
        return int(stripped)
    state = literal_state(text)
    return state - 2**32 if state >= 2**31 else state


def source_state(seed: int) -> int:
    """State after the head shared by all source keys, ``{seed}:overlay:``."""
    return literal_state(f"{seed}:overlay:")


def target_state(seed: int) -> int:
    """State after the head shared by all target and entity keys, ``{seed}:``."""
    return literal_state(f"{seed}:")

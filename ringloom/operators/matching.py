"""Very many texts looked for at once: an Aho-Corasick automaton, broadcast, and one pass a string.

The automaton is complete: a table of the next state for each state and class of bytes, where bytes that
no pattern has share one class. In a task all strings of a batch advance together, byte by byte.
Patterns are taken in lots whose table stays below a bound, so their number only costs more
passes, never more memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLE_BYTES = 32 << 20
STRINGS_AT_ONCE = 4096


@dataclass(frozen=True)
class Automaton:
    """``step[rows[state], class]`` is the next state, 0 the start: states that no pattern goes on from
    do what the state they fall back to does and share its row. ``ends[state]`` is the pattern that ends
    there or -1, ``shorter[state]`` the state of the longest pattern that ends there too, but is
    shorter, or 0."""

    classes: np.ndarray
    step: np.ndarray
    rows: np.ndarray
    ends: np.ndarray
    shorter: np.ndarray

    def find(self, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(string, pattern) of every pattern in every string, once each."""
        lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        order = np.argsort(-lengths, kind="stable")
        text = self.classes[np.frombuffer(b"".join(strings), np.uint8)]
        begin = (np.cumsum(lengths) - lengths)[order]
        falling = -lengths[order]
        state = np.zeros(len(strings), np.int32)
        speaks = (self.ends >= 0) | (self.shorter > 0)
        seen: list[np.ndarray] = []
        for at in range(int(lengths.max(initial=0))):
            live = np.searchsorted(falling, -at)  # strings longer than ``at`` come first
            state[:live] = self.step[self.rows[state[:live]], text[begin[:live] + at]]
            said = np.flatnonzero(speaks[state[:live]])
            if len(said):
                seen.append(said << 32 | state[said])
        pairs = np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.int64)
        found = []
        while len(pairs):
            row, now = pairs >> 32, pairs & 0xFFFFFFFF
            own = self.ends[now] >= 0
            found.append(row[own] << 32 | self.ends[now[own]])
            onward = self.shorter[now]
            pairs = np.unique((row << 32 | onward)[onward > 0])
        both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return order[both >> 32], both & 0xFFFFFFFF


def build(patterns: list[bytes]) -> Automaton:
    """Automaton of distinct patterns that are not empty, depth by depth."""
    used = np.zeros(256, bool)
    used[list(set(b"".join(patterns)))] = True
    classes = np.where(used, np.cumsum(used), 0).astype(np.int32)
    width, order = int(used.sum()) + 1, sorted(range(len(patterns)), key=patterns.__getitem__)
    lengths = np.array([len(patterns[i]) for i in order])
    step = np.zeros((sum(map(len, patterns)) + 1, width), np.int32)
    ends = np.full(len(step), -1, np.int32)
    fail, shorter = np.zeros(len(step), np.int32), np.zeros(len(step), np.int32)
    grid = np.zeros((len(patterns), int(lengths.max(initial=0))), np.int32)
    for row, i in enumerate(order):
        grid[row, : lengths[row]] = classes[np.frombuffer(patterns[i], np.uint8)]
    node, states = np.zeros(len(patterns), np.int32), 1
    goes_on: list[np.ndarray] = []
    for depth in range(grid.shape[1]):
        live = np.flatnonzero(lengths > depth)
        parent, char = node[live], grid[live, depth]
        new = np.append(True, (parent[1:] != parent[:-1]) | (char[1:] != char[:-1])) if len(live) else live
        made = states + np.cumsum(new) - 1
        node[live] = made
        child, up, by = made[new], parent[new], char[new]
        states += len(child)
        goes_on.append(up)
        # The parents' rows are complete but for their children: what they say now is the fall-back.
        fail[child] = step[up, by]
        step[up, by] = child
        ends[node[live[lengths[live] == depth + 1]]] = np.array(order)[live[lengths[live] == depth + 1]]
        step[child] = step[fail[child]]
        shorter[child] = np.where(ends[fail[child]] >= 0, fail[child], shorter[fail[child]])
    inner = np.zeros(states, bool)
    inner[0] = True
    for parents in goes_on:
        inner[parents] = True
    acts = np.arange(states, dtype=np.int32)
    while not inner[acts].all():
        acts = np.where(inner[acts], acts, fail[acts])
    rows = (np.cumsum(inner, dtype=np.int32) - 1)[acts]
    return Automaton(classes, step[:states][inner], rows, ends[:states].copy(), shorter[:states].copy())


def _alike(a: bytes, b: bytes) -> int:
    """Bytes that both begin with."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _lots(patterns: list[bytes], table_bytes: int) -> Iterator[list[int]]:
    """Places of patterns, in lots whose tables stay below ``table_bytes`` while they are built.

    Sorted patterns share states with the one before as far as they begin alike.
    """
    state_bytes = 4 * (len(set(b"".join(patterns))) + 5)  # a row, and four numbers beside it
    lot, size, before = [], 0, b""
    for i in sorted(range(len(patterns)), key=patterns.__getitem__):
        new = len(patterns[i]) - _alike(before, patterns[i])
        if lot and (size + new) * state_bytes > table_bytes:
            yield lot
            lot, size, new = [], 0, len(patterns[i])
        lot.append(i)
        size += new
        before = patterns[i]
    if lot:
        yield lot


def _finder(shared):
    """Column function: places of the patterns of one lot in each text."""

    def find(column: pd.Series) -> pd.Series:
        automaton, starts, places = shared.value
        out: list[np.ndarray] = []
        for start in range(0, len(column), STRINGS_AT_ONCE):
            part = [(t or "").encode() for t in column.iloc[start : start + STRINGS_AT_ONCE]]
            row, pattern = automaton.find(part)
            many = starts[pattern + 1] - starts[pattern]
            nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            row, place = np.repeat(row, many), places[np.repeat(starts[pattern], many) + nth]
            order = np.argsort(row, kind="stable")
            out += np.split(place[order], np.searchsorted(row[order], np.arange(1, len(part))))
        return pd.Series(out, dtype=object)

    return F.pandas_udf(find, "array<int>")


def with_hits(texts: DataFrame, text: str, patterns: list[str], out: str = "hits", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """``texts`` plus ``out``: the places in ``patterns`` of those that the column ``text`` contains, in
    ascending order. An empty pattern is in every text; a null text contains nothing.

    Equal to one ``contains`` for each pattern, at the cost of one pass of the text for each lot.
    """
    raw = [p.encode() for p in patterns]
    distinct = {p: i for i, p in reversed(list(enumerate(raw))) if p}
    same: dict[int, list[int]] = {}
    for i, p in enumerate(raw):
        same.setdefault(distinct.get(p, -1), []).append(i)
    keys = list(distinct)
    context = texts.sparkSession.sparkContext
    found = texts
    names = []
    for n, lot in enumerate(_lots(keys, table_bytes)):
        given = [same[distinct[keys[i]]] for i in lot]
        starts = np.append(0, np.cumsum([len(g) for g in given]))
        flat = np.array([i for g in given for i in g], np.int32)
        shared = context.broadcast((build([keys[i] for i in lot]), starts, flat))

        names.append(f"_hits{n}")
        found = found.withColumn(names[-1], _finder(shared)(F.col(text)))
    always = F.array(*[F.lit(i) for i in same.get(-1, [])]).cast("array<int>")
    every = F.array_sort(F.concat(always, *[F.col(n) for n in names]))
    none = F.array().cast("array<int>")
    return found.withColumn(out, F.when(F.col(text).isNull(), none).otherwise(every)).drop(*names)


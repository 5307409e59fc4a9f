"""Many patterns in one pass over texts: a prefix automaton over tokens, as sorted arrays, run over Arrow batches.

Patterns are sequences of tokens. The automaton's states are their prefixes, level by level; the step from a state by a token
is a binary search in the level's sorted (state, token) pairs. A batch is run from all its places at once: after step k only
those places are left at which k tokens of some pattern stand, which are few beyond the first. Texts stay where they are; what
travels is the automaton. Patterns of more than STATES tokens together are dealt by their first token into several automata,
each run over the texts by itself, so no task holds more than one of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens of the patterns of one automaton.
STATES = 1_000_000


class Automaton:
    """The prefixes of some token sequences, none of them empty."""

    def __init__(self, patterns: Sequence[Sequence[str]]):
        self.words: dict[str, int] = {}
        size = np.array([len(p) for p in patterns], np.int64)
        flat = np.fromiter((self.words.setdefault(t, len(self.words) + 1) for p in patterns for t in p), np.int64, int(size.sum()))
        start = np.concatenate([[0], np.cumsum(size)])
        self.width = len(self.words) + 1
        self.steps: list[np.ndarray] = []  # sorted (state before * width + token) of each level; a state is its place there
        self.ends: list[tuple[np.ndarray, np.ndarray]] = []  # states of each level that end a pattern, in order, and which
        state, live = np.zeros(len(size), np.int64), np.arange(len(size))
        for k in range(int(size.max(initial=0))):
            live = live[size[live] > k]
            keys, state[live] = np.unique(state[live] * self.width + flat[start[live] + k], return_inverse=True)
            self.steps.append(keys)
            done = live[size[live] == k + 1]
            order = np.argsort(state[done], kind="stable")
            self.ends.append((state[done][order], done[order]))

    def ids(self, tokens: pa.Array) -> np.ndarray:
        """The number of each token, 0 for those in no pattern."""
        coded = tokens.dictionary_encode()
        known = np.array([self.words.get(t, 0) for t in coded.dictionary.to_pylist()], np.int64)
        return known[coded.indices.to_numpy()] if len(known) else np.zeros(len(tokens), np.int64)

    def run(self, ids: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, pattern) of all matches in tokens one after another; row: the text of each, none runs over its end."""
        at, state = np.flatnonzero(ids), np.zeros(len(ids), np.int64)
        state = state[at]
        places, found = [], []
        for k, (keys, (ends, pattern)) in enumerate(zip(self.steps, self.ends)):
            inside = at + k < len(ids)
            at, state = at[inside], state[inside]
            same = row[at + k] == row[at]
            at, state = at[same], state[same]
            key = state * self.width + ids[at + k]
            to = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[to] == key
            at, state = at[hit], to[hit]
            if not len(at):
                break
            low, high = np.searchsorted(ends, state), np.searchsorted(ends, state, side="right")
            n = high - low
            places.append(np.repeat(at, n))
            found.append(pattern[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())])
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *places]), np.concatenate([none, *found])


def _found(rows: DataFrame, automaton: Automaton, names: list) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = b.column(1)
            row = np.repeat(np.arange(b.num_rows), np.diff(tokens.offsets.to_numpy()))
            place, pattern = automaton.run(automaton.ids(tokens.flatten()), row)
            each = np.unique(row[place] * len(names) + pattern)
            if len(each):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(each // len(names))), pa.array([names[k] for k in each % len(names)], pa.string())], names=["id", "pattern"])

    return rows.mapInArrow(run, f"id {kind}, pattern string")


def occurring(rows: DataFrame, patterns: DataFrame, states: int = STATES) -> DataFrame:
    """(id, pattern): the patterns whose tokens stand side by side in a row's, each once a row. rows: (id, tokens), patterns: (pattern, tokens), distinct; those without tokens stand nowhere."""
    some = patterns.filter(F.size("tokens") > 0)
    total = some.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0]
    parts = -(-total // states)
    body = rows.select("id", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))
    out = []
    for k in range(parts):
        mine = some if parts == 1 else some.filter(F.pmod(F.xxhash64(F.get("tokens", F.lit(0))), F.lit(parts)) == k)
        held = [(r["pattern"], r["tokens"]) for r in mine.toLocalIterator()]  # some `states` tokens
        if held:
            out.append(_found(body, Automaton([t for _, t in held]), [p for p, _ in held]))
    if not out:
        return rows.select("id", F.lit("").alias("pattern")).limit(0)
    return reduce(DataFrame.unionByName, out)

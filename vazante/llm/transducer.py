"""A minimal acyclic transducer from words to token ids, in one memory-mapped file.

Words sharing a suffix share the states that spell it. Each edge carries how many smaller words
it passes over, so the sum along a path is the word's rank, which addresses its ids. Words are
looked up together: one step a byte position for all of them, by binary search in the sorted
edge keys.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import numpy as np

_MAGIC = b"vzlexic1"


def _minimal(words: list[bytes]) -> tuple[list[dict[int, int]], list[bool]]:
    """Transitions and finality of the minimal automaton of sorted distinct words; state 0 starts."""
    edges: list[dict[int, int]] = [{}]
    final: list[bool] = [False]
    register: dict[tuple, int] = {}
    free: list[int] = []
    path = [0]
    before = b""

    def settle(depth: int) -> None:
        while len(path) > depth + 1:
            state = path.pop()
            label = before[len(path) - 1]
            sign = (final[state], *edges[state].items())
            known = register.setdefault(sign, state)
            if known != state:
                edges[path[-1]][label] = known
                free.append(state)

    for word in words:
        shared = 0
        while shared < min(len(word), len(before)) and word[shared] == before[shared]:
            shared += 1
        settle(shared)
        for byte in word[shared:]:
            if free:
                state = free.pop()
                edges[state], final[state] = {}, False
            else:
                state = len(edges)
                edges.append({})
                final.append(False)
            edges[path[-1]][byte] = state
            path.append(state)
        final[path[-1]] = True
        before = word
    settle(0)
    return edges, final


def compile_lexicon(entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """The file of a lexicon: states, edges with their skips, and the ids of the words by rank."""
    items = sorted((w, ids) for w, ids in dict(entries).items() if w)
    edges, final = _minimal([w for w, _ in items])
    below: dict[int, int] = {}
    todo = [0]
    while todo:
        state = todo[-1]
        missing = [t for t in edges[state].values() if t not in below]
        if missing:
            todo += missing
        else:
            below[state] = final[state] + sum(below[t] for t in edges[state].values())
            todo.pop()
    place = {state: k for k, state in enumerate(below if 0 in below else {0: 0})}
    rows = []
    for state in place:
        skip = int(final[state])
        for label, target in sorted(edges[state].items()):
            rows.append((place[state] * 256 + label, place[target], skip))
            skip += below[target]
    rows.sort()
    key, target, skip = (np.array([r[k] for r in rows], np.int64) for k in range(3))
    ends = np.zeros(len(place), np.int64)
    for state, k in place.items():
        ends[k] = final[state]
    lengths = np.array([0, *(len(ids) for _, ids in items)], np.int64)
    arrays = {
        "key": key, "target": target, "skip": skip, "final": ends, "start": np.array([place[0]], np.int64),
        "offset": np.cumsum(lengths), "pool": np.array([i for _, ids in items for i in ids], np.int64),
        "longest": np.array([max((len(w) for w, _ in items), default=0)], np.int64),
    }
    head = json.dumps({n: len(a) for n, a in arrays.items()}).encode()
    head += b" " * (-len(head) % 8)
    return _MAGIC + len(head).to_bytes(8, "little") + head + b"".join(a.tobytes() for a in arrays.values())


class Lexicon:
    """A compiled lexicon, mapped from its file (or held, from bytes)."""

    def __init__(self, source: str | bytes) -> None:
        data = np.memmap(source, np.uint8, "r") if isinstance(source, str) else np.frombuffer(source, np.uint8)
        if bytes(data[:8]) != _MAGIC:
            raise ValueError("not a lexicon file")
        size = int(data[8:16].view(np.int64)[0])
        at = 16 + size
        for name, length in json.loads(bytes(data[16:at])).items():
            setattr(self, name, data[at : at + 8 * length].view(np.int64))
            at += 8 * length

    @property
    def states(self) -> int:
        return len(self.final)

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, -1 where the lexicon has no such word."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        first = np.cumsum(lengths) - lengths
        state = np.full(len(words), self.start[0])
        rank = np.zeros(len(words), np.int64)
        alive = np.flatnonzero((lengths > 0) & (lengths <= self.longest[0])) if len(self.key) else np.zeros(0, np.int64)
        out = np.full(len(words), -1, np.int64)
        at = 0
        while len(alive):
            key = state[alive] * 256 + flat[first[alive] + at]
            edge = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            hit = self.key[edge] == key
            alive, edge = alive[hit], edge[hit]
            state[alive] = self.target[edge]
            rank[alive] += self.skip[edge]
            at += 1
            done = lengths[alive] == at
            ended = alive[done]
            ended = ended[self.final[state[ended]] == 1]
            out[ended] = rank[ended]
            alive = alive[~done]
        return out

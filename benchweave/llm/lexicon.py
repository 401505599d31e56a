"""A minimal acyclic transducer: byte strings to their rank in sorted order, in flat arrays that can be memory-mapped.

States with the same continuation are shared (incremental construction of Daciuk et al., 2000). An arc carries how many
words sort before those behind it; the sum along a word's arcs is the word's rank, which selects its output.
"""

from __future__ import annotations

import numpy as np


def compile_words(words: list[bytes], outputs: list[bytes]) -> bytes:
    """The automaton of distinct ``words`` and one output (ids as little-endian uint32) for each, as one byte string."""
    order = sorted(range(len(words)), key=words.__getitem__)
    register: dict[tuple, int] = {}
    finals, counts, states = [], [], []

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        state = register.get(key)
        if state is None:
            state = register[key] = len(finals)
            finals.append(node[0])
            counts.append(node[0] + sum(counts[target] for _, target in node[1]))
            states.append(node[1])
        return state

    path: list[list] = [[0, []]]
    before = b""
    for i in order:
        word = words[i]
        shared = 0
        while shared < min(len(word), len(before)) and word[shared] == before[shared]:
            shared += 1
        while len(path) - 1 > shared:
            node = path.pop()
            path[-1][1].append((before[len(path) - 1], freeze(node)))
        path += [[0, []] for _ in word[shared:]]
        path[-1][0] = 1
        before = word
    while len(path) > 1:
        node = path.pop()
        path[-1][1].append((before[len(path) - 1], freeze(node)))
    root = freeze(path[0])
    keys, targets, numbers = [], [], []
    for state, arcs in enumerate(states):
        passed = finals[state]
        for byte, target in arcs:
            keys.append(state << 8 | byte)
            targets.append(target)
            numbers.append(passed)
            passed += counts[target]
    ids = b"".join(outputs[i] for i in order)
    ends = np.cumsum([0] + [len(outputs[i]) // 4 for i in order])
    parts = [np.array([root]), finals, keys, targets, numbers, ends, np.frombuffer(ids, dtype="<u4")]
    arrays = [np.asarray(p, dtype="<u4") for p in parts]
    head = np.array([len(a) for a in arrays], dtype="<u4")
    return b"".join(a.tobytes() for a in [head, *arrays])


class Lexicon:
    """Read-only view of a compiled lexicon; pages are loaded by the operating system as they are touched."""

    def __init__(self, path: str):
        flat = np.memmap(path, dtype="<u4", mode="r")
        cuts = np.cumsum([7, *flat[:7].astype(np.int64)])
        root, self.final, self.keys, self.target, self.number, self.ends, self.ids = (flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))
        self.root = int(root[0])

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, -1 where the lexicon lacks it; all words walk the automaton side by side."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        start = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        state, rank = np.full(len(words), self.root, dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        out = np.full(len(words), -1, dtype=np.int64)
        alive, step = np.arange(len(words)), 0
        while len(alive):
            done = sizes[alive] == step
            at = alive[done]
            at = at[self.final[state[at]] == 1]
            out[at] = rank[at]
            alive = alive[~done]
            if not len(alive) or not len(self.keys):
                break
            key = state[alive] << 8 | data[start[alive] + step]
            i = np.minimum(np.searchsorted(self.keys, key.astype(np.uint32)), len(self.keys) - 1)
            hit = self.keys[i] == key
            alive, i = alive[hit], i[hit]
            state[alive] = self.target[i]
            rank[alive] += self.number[i]
            step += 1
        return out

    def output(self, rank: int) -> bytes:
        return self.ids[self.ends[rank] : self.ends[rank + 1]].tobytes()

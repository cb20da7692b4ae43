"""A minimal acyclic transducer: words (bytes) to lists of ids, in flat arrays that can be memory-mapped.

Words are added in sorted order and equal suffix states are shared as soon as they are complete (incremental
minimisation). Each edge carries the number of words that branch off before it; their sum along a path is the word's
number, under which its ids are stored. Layout of the file: six int32 sizes, then the arrays in the order of `FIELDS`.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

FIELDS = ("first", "final", "label", "target", "before", "offset", "ids")


def compile_words(words: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """The file's bytes for `(word, ids)`; words must be distinct, in any order."""
    items = sorted(words)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def freeze(final: bool, edges: list[list]) -> int:
        key = (final, tuple((lab, tgt) for lab, tgt in edges))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path: list[list] = [[False, []]]  # of open states: [final, [(label, frozen target)]], the last edge still open
    previous = b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            final, edges = path.pop()
            path[-1][1][-1][1] = freeze(final, edges)

    for word, _ in items:
        same = 0
        while same < min(len(word), len(previous)) and word[same] == previous[same]:
            same += 1
        close(same)
        for b in word[same:]:
            path[-1][1].append([b, -1])
            path.append([False, []])
        path[-1][0] = True
        previous = word
    close(0)
    root = freeze(*path[0])

    count = [0] * len(states)  # words below each state; targets are always frozen before their sources
    for k, (final, edges) in enumerate(states):
        count[k] = int(final) + sum(count[t] for _, t in edges)
    first, label, target, before = [0], [], [], []
    for final, edges in states:
        n = int(final)
        for lab, t in edges:
            label.append(lab)
            target.append(t)
            before.append(n)
            n += count[t]
        first.append(len(label))
    flat = [x for _, ids in items for x in ids]
    arrays = {
        "first": first, "final": [int(f) for f, _ in states], "label": label, "target": target, "before": before,
        "offset": np.cumsum([0, *(len(ids) for _, ids in items)]), "ids": flat,
    }
    packed = [np.asarray(arrays[f], dtype=np.int32) for f in FIELDS]
    return np.asarray([root, *(len(a) for a in packed)], dtype=np.int32).tobytes() + b"".join(a.tobytes() for a in packed)


class Transducer:
    """Reads a compiled file through a memory map: workers of one machine share its pages."""

    def __init__(self, path: str):
        data = np.memmap(path, dtype=np.int32, mode="r")
        self.root, sizes, at = int(data[0]), data[1 : 1 + len(FIELDS)], 1 + len(FIELDS)
        for name, n in zip(FIELDS, sizes, strict=True):
            setattr(self, name, data[at : at + int(n)])
            at += int(n)

    def get(self, word: bytes) -> list[int] | None:
        """The word's ids; None if it isn't in the lexicon."""
        state, number = self.root, 0
        first, label = self.first, self.label
        for b in word:
            lo, hi = int(first[state]), int(first[state + 1])
            k = lo + int(np.searchsorted(label[lo:hi], b))
            if k == hi or label[k] != b:
                return None
            number += int(self.before[k])
            state = int(self.target[k])
        return self.ids[self.offset[number] : self.offset[number + 1]].tolist() if self.final[state] else None

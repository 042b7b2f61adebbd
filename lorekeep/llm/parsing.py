"""Prefix-free parsing of byte strings.

A rolling hash of TRIGGER bytes runs over each text. Of the hashes inside every
window of LENGTH bytes the smallest (of equal ones, the leftmost) is a trigger,
so where a text is cut depends on what stands there and on nothing else: equal
strings of LENGTH bytes hold the same trigger at the same place. All windows
with one trigger make a phrase: the bytes from the first such window's start to
the last one's end. Phrases overlap so that each window lies whole in one, and
texts that repeat long passages have the same phrases.
"""

from __future__ import annotations

import numpy as np

from lorekeep.llm.common import SLICE, digests, mix64

LENGTH, TRIGGER = 100, 32
HIGH = np.uint64(0xFFFFFFFF00000000)
VALUE = mix64(np.arange(1, 257, dtype=np.uint64))
#: Multipliers of the rolling hash, one for each doubling of its width.
FACTOR = mix64(np.arange(301, 306, dtype=np.uint64)) | np.uint64(1)


def rolling(data: np.ndarray) -> np.ndarray:
    """The hash of the TRIGGER bytes from each place of data."""
    h, have = VALUE[data], 1
    for factor in FACTOR:
        h = h[:-have] * factor + h[have:]
        have *= 2
    return mix64(h)


def _triggers(data: np.ndarray, inside: np.ndarray, a: int, b: int) -> tuple[np.ndarray, ...]:
    """(first window, last window, place of the trigger, its hash) of each run of windows with one trigger among those that start in [a, b)."""
    grams, n = rolling(data[a : b + LENGTH - 1]), b - a
    key = (grams & HIGH) | np.arange(len(grams), dtype=np.uint64)
    # the least of the first 1, 2, 4 ... hashes from each place, then of all inside a window
    least, have, want = key, 1, LENGTH - TRIGGER + 1
    while 2 * have <= want:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    least = np.minimum(least[:n], least[want - have : want - have + n])
    trigger, ok = (least & ~HIGH).astype(np.int64), inside[a:b]
    change = trigger[1:] != trigger[:-1]
    first, last = ok.copy(), ok.copy()
    first[1:] &= change | ~ok[:-1]
    last[:-1] &= change | ~ok[1:]
    lo = np.flatnonzero(first)
    at = trigger[lo]
    return lo + a, np.flatnonzero(last) + a, at + a, grams[at]


class Parse:
    """Phrases of the texts in data: trigger (hash), text, at (the trigger), lo and hi (first and last window start), in data.

    A long text is parsed slice by slice; a phrase that goes on in the next slice is one phrase.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, n = data, len(data) - LENGTH + 1
        edge = np.zeros(len(data) + 1, np.int8)  # windows that would run over the end of their text
        np.add.at(edge, np.maximum(offsets[:-1], offsets[1:] - LENGTH + 1), 1)
        np.subtract.at(edge, offsets[1:], 1)
        inside = np.cumsum(edge[:-1], dtype=np.int8) == 0
        none = np.zeros(0, np.int64)
        parts = [(none, none, none, np.zeros(0, np.uint64))]
        for a in range(0, max(0, n), SLICE):
            part = _triggers(data, inside, a, min(n, a + SLICE))
            before = parts[-1]
            if len(part[0]) and len(before[0]) and part[0][0] == a and before[1][-1] == a - 1 and part[2][0] == before[2][-1]:
                before[1][-1] = part[1][0]
                part = tuple(x[1:] for x in part)
            if len(part[0]):
                parts.append(part)
        self.lo, self.hi, self.at, self.trigger = (np.concatenate(x) for x in zip(*parts))
        self.text = np.searchsorted(offsets, self.lo, side="right") - 1

    def contents(self) -> tuple[np.ndarray, np.ndarray]:
        return digests(self.data, self.lo, self.hi + LENGTH)

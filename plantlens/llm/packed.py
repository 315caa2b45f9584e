"""Sequences of different lengths in time-major order, so that a recursion takes all of them one step at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class Layout:
    """The longest sequence comes first; step t has the tokens t of those that are long enough. Empty ones have none."""

    def __init__(self, starts: np.ndarray, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        lengths = lengths[self.order]
        self.live = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), side="right")
        self.at = np.concatenate([[0], np.cumsum(self.live)])
        step = np.repeat(np.arange(len(self.live)), self.live)
        self.token = starts[self.order][np.arange(self.at[-1]) - self.at[step]] + step

    def steps(self) -> Iterator[tuple[slice, int]]:
        return ((slice(a, b), b - a) for a, b in zip(self.at[:-1].tolist(), self.at[1:].tolist()))

    def pack(self, values: np.ndarray) -> np.ndarray:
        return values[self.token]

    def unpack(self, packed: np.ndarray) -> np.ndarray:
        out = np.empty_like(packed)
        out[self.token] = packed
        return out

    def before(self) -> np.ndarray:
        """Places of the tokens before those of the second and all later steps."""
        return np.concatenate([np.arange(self.at[t - 1], self.at[t - 1] + self.live[t]) for t in range(1, len(self.live))] or [np.zeros(0, np.int64)])

"""Phrases in streams of posterior frames: token passing over a trie, a frame at a time, in arrays.

A path is (trie node, last token, whether a blank came since, first frame, anchor) with the log of the summed
probability of all ways there. In a frame a path may rest on the blank, stay on its last token (unless a blank came
between), or go to a child of its node; a new path may begin at any child of the root. Ways that end in the same path are
added up. All moves of a frame are made as arrays, sorted by path, and added up by segments.

Paths are visited best first. A phrase is complete when a path arrives at its node, with the confidence of what has come
to that path by then: the frame mean of its probability. Of several arrivals the most confident counts, of equal ones the first.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from ..operators.match import Automaton


@dataclass
class Evidence:
    """What one look at text or sound says of a phrase."""

    phrase: str
    confidence: float
    start: int | None = None
    anchor: int | None = None


@dataclass(frozen=True)
class Sounds:
    """The symbols of posterior frames, the blank's place among them, and bounds of the paths (see ``Lattice``)."""

    symbols: tuple
    blank: int = 0
    bounds: dict = field(default_factory=dict)


_FIELDS = ("node", "token", "rested", "start", "anchor")


class Trie:
    """The children of an automaton's nodes for the symbols of a posterior, as sorted arrays."""

    def __init__(self, automaton: Automaton, symbols: tuple) -> None:
        self.width = len(symbols)
        place: dict = {}
        for i, s in enumerate(symbols):
            place.setdefault(s, []).append(i)
        edges = sorted((node * self.width + i, child) for node, below in enumerate(automaton.next) for s, child in below.items() for i in place.get(s, ()))
        self.keys = np.array([k for k, _ in edges], dtype=np.int64)
        self.children = np.array([c for _, c in edges], dtype=np.int64)

    def child(self, node: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Child nodes; -1 where there is none."""
        key = node * self.width + token
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        if not len(self.keys):
            return np.full(len(key), -1)
        return np.where(self.keys[at] == key, self.children[at], -1)


def sums_in_segments(score: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Running log of the sum of exp(score) within segments, which begin where ``first`` is true."""
    segment = np.cumsum(first) - 1
    top = np.maximum.reduceat(score, np.flatnonzero(first))[segment]
    weight = np.where(np.isneginf(top), 0.0, np.exp(score - np.where(np.isneginf(top), 0.0, top)))
    total = np.cumsum(weight)
    before = (total - weight)[np.flatnonzero(first)][segment]
    with np.errstate(divide="ignore"):
        return top + np.log(np.maximum(total - before, 0.0))


class Lattice:
    """The paths of one stream, kept from piece to piece."""

    def __init__(self, automaton: Automaton, most_paths: int = 256, beam: float = 12.0, tokens: int = 8, most: int = 20, least: float = 0.55) -> None:
        self.automaton, self.most_paths, self.beam, self.tokens, self.most, self.least = automaton, most_paths, beam, tokens, most, least
        self.trie: Trie | None = None
        self.symbols: list | None = None
        self.reset()

    def reset(self) -> None:
        self.state = np.zeros((0, len(_FIELDS)), dtype=np.int64)
        self.score = np.zeros(0)

    def dump(self) -> list:
        return [self.state.tolist(), self.score.tolist()]

    def load(self, saved: list) -> None:
        self.state = np.array(saved[0], dtype=np.int64).reshape(-1, len(_FIELDS))
        self.score = np.array(saved[1], dtype=np.float64)

    def _moves(self, row: np.ndarray, frame: int, blank: int, anchor: int):
        """All moves of a frame in the order of visits: states, scores, and which of them arrive at a node."""
        spoken = np.argsort(-row, kind="stable")[: self.tokens]
        spoken = spoken[spoken != blank]
        n, k = len(self.score), len(spoken)
        node, token, rested, start, anchors = self.state.T
        wide = lambda x: np.repeat(x, k)
        t = np.tile(spoken, n)
        stays = (t == wide(token)) & (wide(rested) == 0)
        child = np.where(stays, wide(node), self.trie.child(wide(node), t))
        gone = np.stack([child, t, np.zeros(n * k, dtype=np.int64), wide(start), wide(anchors)], axis=1).reshape(n, k, len(_FIELDS))
        rest = np.stack([node, token, np.ones(n, dtype=np.int64), start, anchors], axis=1)[:, None, :]
        state = np.concatenate([rest, gone], axis=1).reshape(-1, len(_FIELDS))
        score = (self.score[:, None] + np.concatenate([[row[blank]], row[spoken]])[None, :]).reshape(-1)
        arrives = np.concatenate([np.zeros((n, 1), dtype=bool), (~stays).reshape(n, k)], axis=1).reshape(-1)
        roots = self.trie.child(np.zeros(k, dtype=np.int64), spoken)
        new = np.stack([roots, spoken, np.zeros(k, dtype=np.int64), np.full(k, frame), np.full(k, anchor)], axis=1)
        state, score = np.concatenate([state, new]), np.concatenate([score, row[spoken]])
        arrives = np.concatenate([arrives, np.ones(k, dtype=bool)])
        live = state[:, 0] >= 0
        return state[live], score[live], arrives[live]

    def _frame(self, row: np.ndarray, frame: int, blank: int, anchor: int):
        """Goes one frame on; the arrivals at nodes where phrases end: (node, level, start, anchor) in the order of visits."""
        state, score, arrives = self._moves(row, frame, blank, anchor)
        if not len(score):
            self.reset()
            return []
        order = np.lexsort(state.T[::-1])  # stable: visits keep their order within a path
        state, score, arrives = state[order], score[order], arrives[order]
        first = np.r_[True, (state[1:] != state[:-1]).any(axis=1)]
        so_far = sums_in_segments(score, first)
        at = np.flatnonzero(arrives)
        level = np.minimum(1.0, np.exp(so_far[at] / np.maximum(1, frame - state[at, 3] + 1)))
        ends = level >= self.least
        found = sorted((int(order[i]), int(state[i, 0]), float(v), int(state[i, 3]), int(state[i, 4])) for i, v in zip(at[ends], level[ends]))
        begin = np.flatnonzero(first)
        end = np.r_[begin[1:], len(first)] - 1
        total, visit = so_far[end], order[begin]
        kept = np.flatnonzero(total >= total.max() - self.beam)
        kept = kept[np.lexsort((visit[kept], -total[kept]))][: self.most_paths]
        self.state, self.score = state[begin[kept]], total[kept]
        return [x[1:] for x in found if self.automaton.own[x[1]]]

    def consume(self, rows, offset: int, blank: int, symbols, anchor: int, enabled: set[str] | None) -> tuple[list[Evidence], list[Evidence]]:
        """Evidence after further frames of log probabilities: phrases still open, and those completed, at most ``most`` of each."""
        if self.trie is None or symbols is not self.symbols:
            key, self.symbols = tuple(symbols), symbols
            self.trie = self.automaton.arrays[key] = self.automaton.arrays.get(key) or Trie(self.automaton, key)
        allowed = lambda p: enabled is None or p in enabled
        done: dict[str, Evidence] = {}
        for frame, row in enumerate(rows, offset):
            for node, level, start, at in self._frame(np.asarray(row, dtype=np.float64), frame, blank, anchor):
                for p in filter(allowed, self.automaton.own[node]):
                    if p not in done or level > done[p].confidence:
                        done[p] = Evidence(p, level, start, at)
        open_: dict[str, Evidence] = {}
        for e in sorted(self.states(offset + max(0, len(rows) - 1)), key=lambda e: -e.confidence):
            if allowed(e.phrase) and e.phrase not in done:
                open_.setdefault(e.phrase, e)
        return list(open_.values())[: self.most], sorted(done.values(), key=lambda e: -e.confidence)[: self.most]

    def states(self, frame: int) -> list[Evidence]:
        """Every phrase that every path may still become, best path first; a phrase as often as paths lead to it."""
        out = []
        for (node, _, _, start, anchor), score in zip(self.state.tolist(), self.score.tolist()):
            level = min(0.999, float(np.exp(score / max(1, frame - start + 1))))
            out += [Evidence(p, level, start, anchor) for p in self.automaton.below(node, self.most)]
        return out

"""Retrieval along a stream of sound: the best phrases over all frames so far, after every block of samples.

Each key keeps its greatest similarity and the frame of it, so a refresh costs the new frames only, however long the stream.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import fitting, shuffle_width

RESULT = "stream string, chunk_id int, sample_count bigint, is_final boolean, hotword_id string, score double, rank int, peak_frame int, variant string"


@dataclass(frozen=True)
class Index:
    """Unit vectors of phrases' variants, sorted by phrase and variant."""

    keys: np.ndarray
    phrases: np.ndarray
    variants: np.ndarray

    @staticmethod
    def of(rows: list[tuple[str, str, list[float]]]) -> Index:
        rows = sorted(rows, key=lambda r: (r[0], r[1] or ""))
        keys = np.array([r[2] for r in rows], dtype=np.float64) if rows else np.zeros((0, 0))
        return Index(keys, np.array([r[0] for r in rows], dtype=object), np.array([r[1] or "" for r in rows], dtype=object))

    def first_of_phrases(self) -> np.ndarray:
        return np.flatnonzero(np.r_[True, self.phrases[1:] != self.phrases[:-1]]) if len(self.phrases) else np.zeros(0, dtype=np.int64)


class Stream:
    """One stream. Frames may run ahead of or behind the samples: a frame counts at a boundary once it has come and ended."""

    def __init__(self, index: Index, block: int, samples_per_frame: int, k: int, decimals: int = 6) -> None:
        if block <= 0 or samples_per_frame <= 0:
            raise ValueError("blocks and frames need samples")
        self.block, self.samples_per_frame, self.k, self.decimals = block, samples_per_frame, k, decimals
        self.index = index
        self.reset()

    def reset(self) -> None:
        self.best = np.full(len(self.index.phrases), -np.inf)
        self.peak = np.zeros(len(self.index.phrases), dtype=np.int64)
        self.samples = self.refreshed = self.frames = self.chunk = 0
        self.pending: list[np.ndarray] = []
        self.last: list[dict] | None = None
        self.finished = False

    def use(self, index: Index) -> None:
        """Another index, for a stream that has not begun."""
        if self.samples or self.frames or self.pending or self.finished:
            raise RuntimeError("reset the stream before it gets another index")
        self.index = index
        self.reset()

    def step(self, samples: int, frames) -> list[list[dict]]:
        """Further samples and frames; a list of hits for every boundary they pass."""
        if self.finished:
            raise RuntimeError("the stream has ended; reset it")
        self.samples += int(samples)
        self.pending += [np.asarray(f, dtype=np.float64) for f in frames]
        return [self._refresh(self.refreshed + self.block, False) for _ in range((self.samples - self.refreshed) // self.block)]

    def finish(self) -> list[dict]:
        """The last refresh: of what follows the last boundary, or that boundary's own, marked final. Asked again, the same."""
        if self.finished:
            return self.last
        if self.samples > self.refreshed or self.last is None or self.pending:
            self._refresh(self.samples, True)
        self.finished = True
        self.last = [h | {"is_final": True} for h in self.last]
        return self.last

    def _refresh(self, at: int, all_frames: bool) -> list[dict]:
        n = len(self.pending) if all_frames else max(0, min(len(self.pending), at // self.samples_per_frame - self.frames))
        new, self.pending = self.pending[:n], self.pending[n:]
        if new and len(self.best):
            s = (np.stack(new) @ self.index.keys.T).round(self.decimals)
            top, where = s.max(axis=0), self.frames + s.argmax(axis=0)
            self.peak = np.where(top > self.best, where, self.peak)
            self.best = np.maximum(top, self.best)
        self.frames += n
        self.refreshed = at
        self.last = [h | {"chunk_id": self.chunk, "sample_count": at, "is_final": False} for h in self._hits()]
        self.chunk += 1
        return self.last

    def _hits(self) -> list[dict]:
        first = self.index.first_of_phrases()
        if not len(first) or not self.frames:
            return []
        score = np.maximum.reduceat(self.best, first)
        owner = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(self.best)]))
        hit = np.flatnonzero(self.best == score[owner])
        which = hit[np.unique(owner[hit], return_index=True)[1]]  # the first of equal variants
        order = np.argsort(-score, kind="stable")[: self.k]
        return [
            {"hotword_id": self.index.phrases[which[i]], "score": float(score[i]), "rank": r, "peak_frame": int(self.peak[which[i]]), "variant": self.index.variants[which[i]]}
            for r, i in enumerate(order, 1)
        ]


def replay(rows: DataFrame, keys: DataFrame, block: int, samples_per_frame: int, k: int) -> DataFrame:
    """Refreshes of finished streams. ``rows``: ``stream, seq, n_samples, frames``; ``keys``: ``hotword_id, variant, key``,
    whose size is checked before they are sent to every task. Streams run in ``seq`` order through their state and are not held."""
    index = Index.of([tuple(r) for r in fitting(keys.select("hotword_id", "variant", "key"), "the index", 512 << 20).collect()])
    shared = rows.sparkSession.sparkContext.broadcast(index)
    ordered = rows.select("stream", "seq", "n_samples", "frames").repartition(shuffle_width(rows.sparkSession), "stream").sortWithinPartitions("stream", "seq")
    names = [c.split()[0] for c in RESULT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, stream = None, None
        for pdf in batches:
            out: list[dict] = []
            for sid, _, n, frames in pdf.itertuples(index=False):
                if stream is None or sid != current:
                    out += [h | {"stream": current} for h in (stream.finish() if stream else [])]
                    current, stream = sid, Stream(shared.value, block, samples_per_frame, k)
                out += [h | {"stream": sid} for hits in stream.step(n, [] if frames is None else frames) for h in hits]
            yield pd.DataFrame(out, columns=names)
        if stream is not None:
            yield pd.DataFrame([h | {"stream": current} for h in stream.finish()], columns=names)

    return ordered.mapInPandas(run, RESULT)

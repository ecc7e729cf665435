"""Phrases in streams of posterior frames, by token passing over a trie of symbols."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..runtime import shuffle_width
from ..streaming.posteriors import Lattice
from .match import Automaton

SCHEMA = "session_id string, chunk_id int, kind string, phrase string, confidence double, start_frame int"


def lattice_matches(chunks: DataFrame, automaton: Automaton, symbols: list[str], blank: int, **bounds) -> DataFrame:
    """Evidence after every chunk: ``kind`` 'active' or 'complete'.

    ``chunks``: ``session_id, chunk_id, frame_offset, log_probs array<array<double>>``. Rows of a session stream through
    its bounded path state (256 paths by default) in chunk order; a session is never held whole.
    """
    shared = chunks.sparkSession.sparkContext.broadcast(automaton)
    ordered = chunks.select("session_id", "chunk_id", "frame_offset", "log_probs").repartition(shuffle_width(chunks.sparkSession), "session_id").sortWithinPartitions("session_id", "chunk_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, lattice = None, None
        for pdf in batches:
            out = []
            for sid, chunk, offset, rows in pdf.itertuples(index=False):
                if lattice is None or sid != current:
                    current, lattice = sid, Lattice(shared.value, **bounds)
                active, complete = lattice.consume([] if rows is None else [list(r) for r in rows], int(offset), blank, symbols, 0, None)
                for kind, found in (("active", active), ("complete", complete)):
                    out += [(sid, int(chunk), kind, e.phrase, float(e.confidence), int(e.start)) for e in found]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return ordered.mapInPandas(run, SCHEMA)

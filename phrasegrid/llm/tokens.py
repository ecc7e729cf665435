"""Token counts of texts under a public byte-level BPE vocabulary (default: the many-language one of 50,256 ranks)."""

from __future__ import annotations

import base64
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.text import SPACE
from ..runtime import spread

#: Folder of the public vocabularies; a parameter everywhere below.
TOKENIZER_DIR = os.environ.get("PHRASEGRID_TOKENIZERS", "/opt/tokenizers")
TOKENIZER = "byte_bpe_multi_50k.tiktoken"
#: Fixed value: the split pattern that the public vocabulary was made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LONG_SPACE = re.compile(SPACE + "{5000,}")
_encoders: dict[int, object] = {}


def _encoder(vocabulary: bytes):
    import tiktoken

    key = hash(vocabulary)
    if key not in _encoders:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        _encoders[key] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def _count(encoder, text: str) -> int:
    """Tokens of a text of any length, exactly those of the tokenizer.

    The splitter keeps a stack for runs of white space and gives up on long ones; no other run troubles it. Its pattern
    always cuts before white space that follows anything else, and before the last character of a run that something
    follows (all of a run at the end is one piece), so the long piece between these two cuts is encoded by itself.
    """
    done, at = 0, 0
    for run in _LONG_SPACE.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        done += len(encoder.encode_ordinary(text[at : run.start()])) + len(encoder._encode_single_piece(text[run.start() : end]))
        at = end
    return done + len(encoder.encode_ordinary(text[at:] if at else text))


def token_counts(df: DataFrame, text: str, keep: list[str], tokenizer_dir: str | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """Columns ``keep`` and ``tokens bigint``; null text has null tokens, empty text 0."""
    spark: SparkSession = df.sparkSession
    with open(os.path.join(tokenizer_dir or TOKENIZER_DIR, tokenizer), "rb") as file:
        vocabulary = spark.sparkContext.broadcast(file.read())
    rows = spread(df.select(*keep, text))

    def run(batches):
        encoder = _encoder(vocabulary.value)
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            counts = [None if t is None else _count(encoder, t) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(counts, pa.int64())], names=[*keep, "tokens"])

    from pyspark.sql import types as T

    schema = T.StructType([*(rows.schema[k] for k in keep), T.StructField("tokens", T.LongType())])
    return rows.mapInArrow(run, schema)

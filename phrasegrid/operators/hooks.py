"""Places where models plug in, and small column rules around them. Models run per task on Arrow batches of rows."""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import shuffle_width
from .ranking import running

FRAMES = "array<array<float>>"


def encode_frames(df: DataFrame, content: str, make_encoder: Callable[[], Callable]) -> DataFrame:
    """``df`` with ``frames``: ``make_encoder()`` is called once a task and gives a function from one array to a T x D matrix."""
    schema = T.StructType([*df.schema.fields, T.StructField("frames", T.ArrayType(T.ArrayType(T.FloatType())))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make_encoder()
        for pdf in batches:
            yield pdf.assign(frames=[None if x is None else np.atleast_2d(np.asarray(encode(x), dtype=np.float32)).tolist() for x in pdf[content]])

    return df.mapInPandas(run, schema)


def explode_frames(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.select(*keep, F.posexplode("frames").alias("frame", "vec"))


def probe_posteriors(
    df: DataFrame, session: str, seq: str, pcm: str, make_probe: Callable[[], Callable], rate: int = 16000, frame_rate: float = 12.5, overlap_ms: int = 200
) -> DataFrame:
    """``session, seq, frame_offset, log_probs`` of an acoustic probe over the pieces of sessions, in their order.

    ``make_probe()`` is called once a task and gives a function from samples to a T x S matrix of log probabilities. Each
    piece is given with the last ``overlap_ms`` of those before it, whose frames are taken off again. A session streams
    through its tail of samples and is never held whole; a piece without new frames gives an empty matrix.
    """
    rows = df.select(F.col(session).alias("session"), F.col(seq).alias("seq"), F.col(pcm).alias("pcm"))
    schema = T.StructType([rows.schema["session"], rows.schema["seq"], T.StructField("frame_offset", T.IntegerType()), T.StructField("log_probs", T.ArrayType(T.ArrayType(T.DoubleType())))])
    keep = round(rate * overlap_ms / 1000)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        probe = make_probe()
        current, tail, frames = None, np.zeros(0), 0
        for pdf in batches:
            out = []
            for sid, n, samples in pdf.itertuples(index=False):
                if sid != current:
                    current, tail, frames = sid, np.zeros(0), 0
                heard = np.concatenate([tail, np.asarray([] if samples is None else samples, dtype=np.float64)])
                found = np.atleast_2d(np.asarray(probe(heard), dtype=np.float64)) if len(heard) else np.zeros((0, 0))
                new = found[min(len(found), round(len(tail) / rate * frame_rate)) :]
                out.append((sid, n, frames, new.tolist()))
                frames += len(new)
                tail = heard[-keep:] if keep else np.zeros(0)
            yield pd.DataFrame(out, columns=schema.fieldNames())

    return rows.repartition(session_partitions(df), "session").sortWithinPartitions("session", "seq").mapInPandas(run, schema).withColumnsRenamed({"session": session, "seq": seq})


def session_partitions(df: DataFrame) -> int:
    """A given number of partitions, which small sizes do not reduce: the work is in the model, not the bytes."""
    return shuffle_width(df.sparkSession)


def align_batches(df: DataFrame, keep: list[str], audio: str, text: str, language: str, make_aligner: Callable[[], Callable]) -> DataFrame:
    """``keep`` and ``items``: the aligner gets lists of audio, text and language and must give a list as long of (text, start, end) lists."""
    item = T.StructType([T.StructField("text", T.StringType()), T.StructField("start_time", T.DoubleType()), T.StructField("end_time", T.DoubleType())])
    schema = T.StructType([*(df.schema[k] for k in keep), T.StructField("items", T.ArrayType(item))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = make_aligner()
        for pdf in batches:
            found = aligner(pdf[audio].tolist(), pdf[text].tolist(), pdf[language].tolist())
            if len(found) != len(pdf):
                raise ValueError(f"the aligner gave {len(found)} results for {len(pdf)} rows")
            items = [[{"text": str(t), "start_time": float(s), "end_time": float(e)} for t, s, e in row] for row in found]
            yield pdf[keep].assign(items=items)

    return df.select(*dict.fromkeys([*keep, audio, text, language])).mapInPandas(run, schema)


def pronunciation_paths(metadata: Column, text: Column) -> Column:
    """Symbol paths of a phrase: those its metadata name (a string of symbols, or arrays), else its characters."""
    raw = F.get_json_object(metadata, "$.pronunciations")
    words = lambda s: F.filter(F.split(s, r"\s+"), lambda x: x != "")
    nested = F.from_json(raw, "array<array<string>>")
    flat = F.transform(F.from_json(raw, "array<string>"), words)
    is_nested = raw.rlike(r"^\s*\[\s*\[")
    chars = F.array(F.filter(F.split(text, ""), lambda x: x != ""))
    explicit = F.when(is_nested, nested).when(raw.startswith("["), flat).otherwise(F.array(words(raw)))
    return F.when(raw.isNull() | raw.isin("", "[]"), chars).otherwise(explicit)


def combined_paths(units: list[list[tuple[str, ...]]], most: int = 8) -> list[tuple[str, ...]]:
    """Paths through units with several readings each, the first ``most`` in order of the readings."""
    paths = itertools.product(*units) if units else ()
    return [tuple(itertools.chain(*p)) for p in itertools.islice(paths, most)]


class Lexicon:
    """Readings by look-up: ``han`` gives readings of a character, ``latin`` of a lower-case word, as tuples of symbols.

    Unknown words are spelt (``en:char:x``), unknown characters stand for themselves (``zh:char:x``); white space and
    ``-_/`` have no sound. With pypinyin and cmudict installed, their tables can be handed in.
    """

    def __init__(self, han: dict[str, list[tuple[str, ...]]], latin: dict[str, list[tuple[str, ...]]], most: int = 8) -> None:
        self.han, self.latin, self.most = han, latin, most

    def __call__(self, text: str) -> list[tuple[str, ...]]:
        units: list[list[tuple[str, ...]]] = []
        for latin, run in itertools.groupby(text, key=lambda c: c.isascii() and (c.isalpha() or c == "'")):
            run = "".join(run)
            if latin:
                word = run.lower()
                units.append(self.latin.get(word) or [tuple(f"en:char:{c}" for c in word)])
            else:
                units += [self.han.get(c) or [(f"zh:char:{c}",)] for c in run if not c.isspace() and c not in "-_/"]
        return combined_paths(units, self.most)


def readings(text: Column, make_provider: Callable[[], Callable]) -> Column:
    """Symbol paths of texts by any provider: ``make_provider()`` is called once a task and gives a function from text to paths
    (a ``Lexicon``, say, or a library's). Null text has null paths; explode the result for a row a path."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        provide = make_provider()
        for s in batches:
            yield s.map(lambda t: None if t is None else [list(p) for p in provide(t)])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<array<string>>")(text)


#: Language names by code or name, case folded.
LANGUAGES = {"zh": "Chinese", "zh-cn": "Chinese", "chinese": "Chinese", "en": "English", "english": "English", "yue": "Cantonese", "cantonese": "Cantonese"}


def language_name(code: Column, default: str) -> Column:
    """The name of a known code, else the code itself, trimmed."""
    raw = F.trim(F.coalesce(code, F.lit(default)))
    table = F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(v)) for k, v in LANGUAGES.items()))
    return F.coalesce(F.try_element_at(table, F.lower(raw)), raw)


def audio_uri(source: Column, folder: str) -> Column:
    """Web and data URIs and absolute paths as they are, others below the manifest's folder."""
    return F.when(source.rlike("^(https?://|data:|/)"), source).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), source))


def enabled_or_all(ids: Column, everything: Column) -> Column:
    return F.when(F.size(F.coalesce(ids, F.array().cast("array<string>"))) > 0, ids).otherwise(everything)


def decode_projection(df: DataFrame, elapsed: str, samples: str, revisions: str, stable: str | Column, rate: int = 16000) -> DataFrame:
    """``duration_sec``, ``rtf`` and ``revision_rate`` (revisions a character of stable text)."""
    seconds = F.col(samples) / rate
    return df.withColumns(
        {
            "duration_sec": seconds,
            "rtf": F.col(elapsed) / F.greatest(F.lit(1e-9), seconds),
            "revision_rate": F.col(revisions) / F.greatest(F.lit(1), F.length(stable)),
        }
    )


def render_context(static: Column, names: Column) -> Column:
    """Static context, then a line naming phrases if there are any."""
    line = F.concat(F.lit("Hotwords: "), F.array_join(names, "; "))
    return F.when(F.size(names) > 0, F.trim(F.concat(static, F.lit("\n"), line))).otherwise(static)


def epoch_order(key: str, seed: int, epoch: int) -> Column:
    """A sort key that shuffles records anew every epoch, the same way in every run."""
    return F.sha2(F.concat_ws(":", F.lit(f"{seed}:{epoch}"), F.col(key).cast("string")), 256)


def exact_epoch(records: list, seed: int, epoch: int) -> list:
    """The order of one epoch as Python's generator shuffles a list; on the driver, for a list that lies there anyway."""
    shuffled = list(records)
    random.Random(seed + epoch).shuffle(shuffled)
    return shuffled


def batch_numbers(df: DataFrame, order: list[Column], size: int, within: list[str]) -> DataFrame:
    """``batch`` of ``size`` consecutive rows within each of ``within`` (a shard, say)."""
    if size <= 0:
        raise ValueError("batches need rows")
    return running(df, within, order, "__n").withColumn("batch", F.floor(F.col("__n") / size).cast("int")).drop("__n")


def equal_pairs(left: DataFrame, right: DataFrame, key: str, row: str, column: str) -> DataFrame:
    """The true cells of an equality mask: (row, column) pairs with equal keys, by an equi-join."""
    return left.select(key, row).join(right.select(key, column), key).select(row, column)


def ordered_union(*arrays: Column) -> Column:
    """All elements that are not null once, in order of first appearance: positives, then negatives that are none."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.filter(F.concat(*(F.coalesce(a, none) for a in arrays)), lambda x: x.isNotNull()))


def left_overlap(chunks: DataFrame, keys: list[str], start: str, samples: int) -> DataFrame:
    """Chunks as sample ranges that begin ``samples`` earlier, but not before the stream; ``overlap`` tells how much is repeated."""
    first = F.min(start).over(Window.partitionBy(*keys))
    from_ = F.greatest(first, F.col(start) - samples)
    return chunks.withColumns({"overlap": F.col(start) - from_, "from": from_})

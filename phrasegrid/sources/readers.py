"""Readers: JSON lines under an explicit schema, tagged transcripts, word-frequency and vocabulary text, WAV."""

from __future__ import annotations

import io
import wave

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import SPACE, strip


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """JSON objects, one a line; a leading byte-order mark and blank lines are dropped. ``strict`` fails on the first bad
    line; else bad lines are rows of nulls whose raw text stands in ``_corrupt_record`` (null for good lines)."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("value")).where(strip(F.col("value")) != "")
    return parse_jsonl(lines, "value", schema, strict)


def parse_jsonl(lines: DataFrame, value: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    if strict:
        return lines.select(F.from_json(value, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = lines.select(F.from_json(value, wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    return parsed.select("r.*")


def named_sources(values: list[str]) -> dict[str, str]:
    """``NAME=PATH`` arguments as a mapping; names must differ, and neither part may be empty."""
    out: dict[str, str] = {}
    for value in values:
        name, _, path = (x.strip() for x in value.partition("="))
        if not name or not path or name in out:
            raise ValueError(f"no NAME=PATH of a source of its own: {value}")
        out[name] = path
    return out


def read_word_lines(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    """``source, value`` of several named text files or folders."""
    if not sources:
        raise ValueError("no source")
    out = None
    for name, path in sources.items():
        part = spark.read.text(path).select(F.lit(name).alias("source"), "value")
        out = part if out is None else out.unionByName(part)
    return out


def read_tagged(spark: SparkSession, path: str) -> DataFrame:
    """``utt_id, tagged``: the first run of white space ends the id."""
    line = strip(F.regexp_replace("value", "^﻿", ""))
    rows = spark.read.text(path).select(line.alias("l")).where("l <> ''")
    parts = F.split("l", f"{SPACE}+", 2)
    return rows.select(parts[0].alias("utt_id"), F.get(parts, 1).alias("tagged"))


def file_index(spark: SparkSession, root: str, suffix: str = ".wav") -> DataFrame:
    """``stem, path`` of files below a folder; only the listing is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(root)
    return files.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("stem"), "path")


def with_audio(records: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """``records`` with the ``path`` of the file whose stem is their ``key``; null where there is none. Of several files of one
    stem the first path counts."""
    one = index.groupBy(F.col("stem").alias(key)).agg(F.min("path").alias("path"))
    return records.join(one, key, "left")


def require_audio(joined: DataFrame, key: str) -> DataFrame:
    """``joined`` as it is, unless a record has no file: that raises, with how many and the first ten."""
    missing = joined.where(F.col("path").isNull())
    some = [r[0] for r in missing.select(F.col(key).cast("string")).orderBy(key).limit(10).collect()]
    if some:
        raise ValueError(f"{missing.count()} records without audio: {', '.join(some)}")
    return joined


def sha256_files(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").load(root).select("path", "length", F.sha2("content", 256).alias("sha256"))


_WAVE = T.StructType(
    [T.StructField("samples", T.ArrayType(T.FloatType())), T.StructField("rate", T.IntegerType()), T.StructField("seconds", T.DoubleType()), T.StructField("error", T.StringType())]
)


def decode_wave(content: bytes, rate: int | None = None) -> tuple:
    """Mean of the channels of 16-bit PCM as floats in -1..1, the rate, the length; or why not."""
    import numpy as np

    try:
        with wave.open(io.BytesIO(content)) as w:
            if w.getsampwidth() != 2:
                return None, None, None, "not 16-bit PCM"
            if rate is not None and w.getframerate() != rate:
                return None, w.getframerate(), None, f"rate is not {rate}"
            data = np.frombuffer(w.readframes(w.getnframes()), dtype="<i2").reshape(-1, w.getnchannels())
            return (data.astype(np.float32).mean(axis=1) / 32768.0).tolist(), w.getframerate(), w.getnframes() / w.getframerate(), None
    except (wave.Error, EOFError, ValueError) as error:
        return None, None, None, f"no WAV: {error}"


def waves(files: DataFrame, content: str = "content", rate: int | None = 16000) -> DataFrame:
    """``files`` with ``samples, rate, seconds, error``."""

    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None, None, "null") if c is None else decode_wave(bytes(c), rate) for c in s], columns=_WAVE.fieldNames())

    run.__annotations__ = {"s": pd.Series, "return": pd.DataFrame}
    return files.withColumn("__w", F.pandas_udf(run, _WAVE)(F.col(content))).select(*files.columns, "__w.*")


def wave_headers(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` with ``rate, seconds, error`` of their headers; no sample is decoded."""
    schema = T.StructType([f for f in _WAVE.fields if f.name != "samples"])

    def header(raw) -> tuple:
        try:
            with wave.open(io.BytesIO(bytes(raw))) as w:
                return w.getframerate(), w.getnframes() / w.getframerate(), None
        except (wave.Error, EOFError, TypeError) as error:
            return None, None, f"no WAV: {error}"

    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([header(c) for c in s], columns=schema.fieldNames())

    run.__annotations__ = {"s": pd.Series, "return": pd.DataFrame}
    return files.withColumn("__w", F.pandas_udf(run, schema)(F.col(content))).select(*files.columns, "__w.*")


def pieces(total: Column, step: int) -> Column:
    """Array of (seq, start, n) of consecutive pieces of ``step`` samples, the last one shorter."""
    count = F.ceil(total / step).cast("int")
    at = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(i.alias("seq"), (i * step).cast("bigint").alias("start"), F.least(F.lit(step).cast("bigint"), total - i * step).alias("n")))

"""Writers: JSON lines with sorted keys, an append that resumes, WAV with leading silence."""

from __future__ import annotations

import io
import json
import wave

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import hadoop_path


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object a line, keys sorted, characters as they are, null fields left out."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode(mode).text(path)


def append_new(df: DataFrame, path: str, keys: list[str]) -> int:
    """Append the rows whose keys the output lacks; returns how many. Doubled keys in ``df`` raise.

    The output is Parquet, and what it holds is read anew each time, so a job that died half-way can be run again.
    """
    spark = df.sparkSession
    doubled = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if doubled:
        raise ValueError(f"doubled key {doubled[0]}")
    where, files = hadoop_path(spark, path)
    exists = files.exists(where)
    new = df
    if exists:
        done = spark.read.parquet(path).select(*keys).distinct()
        new = df.join(done, keys, "left_anti")
    written = Observation()
    new.observe(written, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return written.get["n"]


def write_report(spark: SparkSession, path: str, report: dict) -> None:
    """A small report as one indented JSON file with sorted keys, in any file system the session knows."""
    where, files = hadoop_path(spark, path)
    out = files.create(where, True)
    out.write(bytearray((json.dumps(report, ensure_ascii=False, indent=2, sort_keys=True) + "\n").encode()))
    out.close()


def with_silence(content: bytes, seconds: float) -> bytes:
    """A WAV with ``round(rate * seconds)`` silent frames put before it; 16-bit PCM only."""
    with wave.open(io.BytesIO(content)) as w:
        if w.getsampwidth() != 2:
            raise ValueError("not 16-bit PCM")
        params, data = w.getparams(), w.readframes(w.getnframes())
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams(params)
        w.writeframes(b"\0\0" * params.nchannels * round(params.framerate * seconds) + data)
    return out.getvalue()


def silenced(df: DataFrame, content: str, seconds: str) -> DataFrame:
    def run(c: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b != b else with_silence(bytes(a), b) for a, b in zip(c, s)])

    run.__annotations__ = {"c": pd.Series, "s": pd.Series, "return": pd.Series}
    return df.withColumn(content, F.pandas_udf(run, T.BinaryType())(F.col(content), F.col(seconds)))

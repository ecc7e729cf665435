"""Catalogs and manifests from JSON lines, checked: one version, unique ids, filled fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip
from ..operators.annotate import first_filled, string_or_array, target_ids
from ..operators.catalog import fail_if_any
from .readers import read_jsonl

_RAW = T.StructType([T.StructField(n, T.StringType()) for n in ("catalog_version", "id", "text", "aliases", "language", "weight", "metadata")])


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Entries with their defaults (no language, weight 1, no aliases, empty metadata); aliases may be a string or an array.

    Raises on several versions, doubled ids, blank ids or texts, negative weights.
    """
    raw = read_jsonl(spark, path, _RAW)
    rows = raw.select(
        F.coalesce("catalog_version", F.lit("1")).alias("catalog_version"),
        "id",
        "text",
        string_or_array(F.col("aliases")).alias("aliases"),
        F.coalesce("language", F.lit("")).alias("language"),
        F.coalesce(F.col("weight").try_cast("double"), F.lit(1.0)).alias("weight"),
        F.coalesce("metadata", F.lit("{}")).alias("metadata"),
    )
    fail_if_any(rows.where(F.col("id").isNull() | (strip(F.col("id")) == "") | F.col("text").isNull() | (strip(F.col("text")) == "")), "entry without id or text", "id")
    fail_if_any(rows.where("weight < 0"), "negative weight", "id")
    fail_if_any(rows.groupBy("id").count().where("count > 1"), "duplicate id", "id")
    versions = [r[0] for r in rows.select("catalog_version").distinct().limit(3).collect()]
    if len(versions) > 1:
        raise ValueError(f"several catalog versions: {sorted(versions)}")
    return rows


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Distinct negative terms from catalog JSON lines: texts and aliases as they are, empty ones dropped."""
    rows = read_jsonl(spark, path, _RAW).select(F.explode(F.concat(F.array("text"), string_or_array(F.col("aliases")))).alias("term"))
    return rows.where("term <> ''").distinct()


_FIELDS = ("key", "utt_id", "source", "audio", "target", "text", "target_hotword_ids", "hotword_ids", "entities", "boundary_group", "language")


def read_manifest(spark: SparkSession, path: str, require_target: bool = True) -> DataFrame:
    """Canonical ``key, source, target`` with target ids, whichever of the two spellings a record uses; fails with record numbers."""
    raw = read_jsonl(spark, path, T.StructType([T.StructField(n, T.StringType()) for n in _FIELDS]))
    rows = raw.select(
        F.monotonically_increasing_id().alias("record_no"),
        first_filled(F.col("key"), F.col("utt_id")).alias("key"),
        first_filled(F.col("source"), F.col("audio")).alias("source"),
        F.coalesce("target", "text").alias("target"),
        target_ids(string_or_array(F.coalesce("target_hotword_ids", "hotword_ids"))).alias("target_hotword_ids"),
        "entities",
        "boundary_group",
        "language",
    )
    bad = F.col("key").isNull() | F.col("source").isNull()
    fail_if_any(rows.where(bad | F.col("target").isNull() if require_target else bad), "records without key, source or target", "record_no")
    return rows

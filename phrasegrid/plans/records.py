"""Queries over nested records and raw lines (problems 1 and 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import badrows, nested
from ..runtime import read

RUN_TABLES = {
    "": "record",
    "batches": "batch",
    "batches.hits": "hit",
    "batches.timings_ms": "timing",
    "final_batch": "final_batch",
    "final_batch.hits": "final_hit",
    "final_batch.timings_ms": "final_timing",
}
_text = lambda *names: [T.StructField(n, T.StringType()) for n in names]
MENTION = T.StructType(
    [*_text("mention_id", "hotword_id", "text", "entity_type"), *(T.StructField(n, T.IntegerType()) for n in ("char_start", "char_end", "occurrence_index"))]
)
MANIFEST_TABLES = {
    "record": T.StructType(_text("key", "utt_id", "source", "audio", "target", "text", "target_hotword_ids")),
    "node": T.StructType(_text("layer", "seg", "split", "annotator")),
    "mention": MENTION,
}


def runs(spark: SparkSession, d: str) -> nested.Tagged:
    return nested.emit_structs(read(spark, d, "retrieval_runs"), "run_no", RUN_TABLES).store("runs")


def manifest(spark: SparkSession, d: str) -> nested.Tagged:
    marked = (nested.Marked("mention", "char_start", ("entity_type",)),)
    return nested.emit_json(read(spark, d, "manifest_raw"), "record_no", "value", marked, MANIFEST_TABLES).store("manifest")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    flat = runs(spark, d)
    label = lambda c: F.coalesce(F.col(c), F.lit("")).alias("label")
    hits = [
        flat.table(tag).select(F.lit(tag).alias("kind"), F.col("root").alias("row_no"), F.col("pos")[0].alias("outer_pos"), F.col("pos")[1].alias("inner_pos"), label("hotword_id"))
        for tag in ("hit", "final_hit")
    ]
    mentions = manifest(spark, d).table("mention").select(F.lit("mention").alias("kind"), F.col("root").alias("row_no"), "outer_pos", "inner_pos", label("entity_type"))
    return hits[0].unionByName(hits[1]).unionByName(mentions)


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    return runs(spark, d).table("record").select(
        F.col("root").alias("run_no"), "utt_id", F.array_join("target_hotword_ids", ",").alias("targets"), "boundary_group", "rtf", "peak_memory_mb"
    )


def p1_batches(spark: SparkSession, d: str) -> DataFrame:
    flat = runs(spark, d)
    one = lambda tag: flat.table(tag).select(
        F.lit(tag).alias("kind"), F.col("root").alias("run_no"), F.col("pos")[0].alias("batch_pos"), "accumulated_audio_sec", "frame_count", "chunk_id", "is_final"
    )
    return one("batch").unionByName(one("final_batch"))


def p1_timings(spark: SparkSession, d: str) -> DataFrame:
    """Timings with their batch's chunk: parent and child tables joined again by the parent's key."""
    flat = runs(spark, d)
    batch = flat.table("batch").select("root", F.col("pos").alias("parent_pos"), "chunk_id")
    timing = flat.table("timing").select("root", "parent_pos", "name", "value")
    joined = timing.join(batch, ["root", "parent_pos"])
    return joined.select(F.col("root").alias("run_no"), F.col("parent_pos")[0].alias("batch_pos"), "chunk_id", F.col("name").alias("timing"), "value")


def p1_mentions(spark: SparkSession, d: str) -> DataFrame:
    return manifest(spark, d).table("mention").select(
        F.col("root").alias("record_no"), "path", "parent_path", "mention_id", "hotword_id", "text", "entity_type", "char_start", "char_end", "occurrence_index"
    )


def p1_corrupt(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the manifest that hold no JSON object: they have no rows in the other tables."""
    return manifest(spark, d).corrupt().select(F.col("root").alias("record_no"), "value")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return badrows.rejected(read(spark, d, "word_freq"), "value").select("line_id", "reason")


def p3_loaded(spark: SparkSession, d: str) -> DataFrame:
    return badrows.loaded(read(spark, d, "word_freq"), "value").select("line_id", "source", "term", "count")


def p3_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Lines per source and reason, loaded ones under 'loaded'."""
    rows = badrows.classify_lines(read(spark, d, "word_freq"), "value")
    return rows.groupBy("source", F.coalesce("__reason", F.lit("loaded")).alias("reason")).agg(F.count(F.lit(1)).alias("lines"))


def queries():
    return {f.__name__: f for f in (p1_found, p1_records, p1_batches, p1_timings, p1_mentions, p1_corrupt, p3_found, p3_loaded, p3_reasons)}


_HITS = """
SELECT '{kind}' AS kind, run_no AS row_no, CAST(o - 1 AS INTEGER) AS outer_pos, CAST(i - 1 AS INTEGER) AS inner_pos, coalesce(h.hotword_id, '') AS label
FROM (SELECT run_no, o, i, hits[i] AS h FROM (SELECT run_no, o, hits, unnest(generate_series(1, len(hits))) AS i FROM (
  SELECT run_no, o, b.hits AS hits FROM ({batches}) WHERE b.hits IS NOT NULL)))
WHERE h IS NOT NULL"""
_MENTIONS = """
WITH r AS (SELECT record_no, value::JSON AS j FROM manifest_raw),
lists AS (
  SELECT record_no, 0 AS outer_pos, j->'entities' AS l, 'entities' AS path, '' AS parent_path FROM r
  UNION ALL SELECT record_no, 0, j->'annotations', 'annotations', '' FROM r UNION ALL SELECT record_no, 0, j->'segments', 'segments', '' FROM r
  UNION ALL SELECT record_no, i - 1, (j->'annotations'->(i - 1)::INTEGER)->'entities', 'annotations[' || (i - 1) || '].entities', 'annotations[' || (i - 1) || ']'
    FROM (SELECT record_no, j, unnest(generate_series(1, json_array_length(j, '$.annotations')::BIGINT)) AS i FROM r)
  UNION ALL SELECT record_no, i - 1, (j->'segments'->(i - 1)::INTEGER)->'entities', 'segments[' || (i - 1) || '].entities', 'segments[' || (i - 1) || ']'
    FROM (SELECT record_no, j, unnest(generate_series(1, json_array_length(j, '$.segments')::BIGINT)) AS i FROM r)),
m AS (
  SELECT record_no, outer_pos, 0 AS inner_pos, l AS e, path, parent_path FROM lists WHERE json_type(l) = 'OBJECT'
  UNION ALL SELECT record_no, outer_pos, k - 1, l->(k - 1)::INTEGER, path || '[' || (k - 1) || ']', parent_path FROM (SELECT *, unnest(generate_series(1, json_array_length(l)::BIGINT)) AS k FROM lists WHERE json_type(l) = 'ARRAY'))
SELECT 'mention' AS kind, record_no AS row_no, CAST(outer_pos AS INTEGER) AS outer_pos, CAST(inner_pos AS INTEGER) AS inner_pos,
  coalesce(e->>'entity_type', e->'attrs'->>'entity_type', '') AS label
FROM m WHERE json_type(e) = 'OBJECT' AND json_exists(e, '$.char_start')"""
_W = "\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_LINES = f"""
WITH l AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(value, '^\\x{{feff}}', ''), '^[{_W}]+', ''), '[{_W}]+$', '') AS line FROM word_freq),
k AS (SELECT * FROM l WHERE line <> '' AND NOT starts_with(line, '#')),
f AS (SELECT *, starts_with(line, '"') AS q,
  regexp_full_match(line, '"([^"]|"")*"([{_W}][^"]*)?', 's') AS closed,
  CASE WHEN starts_with(line, '"') THEN replace(regexp_extract(line, '^"((?:[^"]|"")*)"', 1, 's'), '""', '"') ELSE regexp_extract(line, '^[^{_W}]+', 0) END AS term,
  CASE WHEN starts_with(line, '"') THEN regexp_replace(line, '^"([^"]|"")*"[{_W}]*', '', 's') ELSE regexp_replace(line, '^[^{_W}]+[{_W}]*', '', 's') END AS rest FROM k),
c AS (SELECT *, CASE
  WHEN (q AND NOT closed) OR (NOT q AND contains(line, '"')) THEN 'quoting'
  WHEN rest = '' OR regexp_matches(rest, '[{_W}]') THEN 'columns'
  WHEN NOT regexp_full_match(rest, '[0-9]+') OR try_cast(rest AS BIGINT) IS NULL OR try_cast(rest AS BIGINT) < 1 THEN 'count'
  WHEN NOT regexp_matches(term, '[\\pL\\pN\\x{{2f00}}-\\x{{2fd5}}]') OR regexp_matches(regexp_replace(term, '[{_W}]+', '', 'g'), '[\\p{{Cc}}\\x{{fffd}}]') THEN 'term'
  END AS reason FROM f)"""


def oracle_sql():
    return {
        "p1_found": " UNION ALL ".join(
            f"SELECT * FROM ({x})"
            for x in (
                _HITS.format(kind="hit", batches="SELECT run_no, o, batches[o] AS b FROM (SELECT run_no, batches, unnest(generate_series(1, len(batches))) AS o FROM retrieval_runs)"),
                _HITS.format(kind="final_hit", batches="SELECT run_no, 1 AS o, final_batch AS b FROM retrieval_runs"),
                _MENTIONS,
            )
        ),
        "p1_records": "SELECT run_no, utt_id, array_to_string(target_hotword_ids, ',') AS targets, boundary_group, rtf, peak_memory_mb FROM retrieval_runs",
        "p1_batches": """
SELECT 'batch' AS kind, run_no, CAST(o - 1 AS INTEGER) AS batch_pos, b.accumulated_audio_sec, b.frame_count, b.chunk_id, b.is_final
FROM (SELECT run_no, o, batches[o] AS b FROM (SELECT run_no, batches, unnest(generate_series(1, len(batches))) AS o FROM retrieval_runs)) WHERE b IS NOT NULL
UNION ALL SELECT 'final_batch', run_no, 0, final_batch.accumulated_audio_sec, final_batch.frame_count, final_batch.chunk_id, final_batch.is_final
FROM retrieval_runs WHERE final_batch IS NOT NULL""",
        "p1_timings": """
SELECT run_no, CAST(o - 1 AS INTEGER) AS batch_pos, chunk_id, e.key AS timing, e.value AS value FROM (
  SELECT run_no, o, b.chunk_id AS chunk_id, unnest(map_entries(b.timings_ms)) AS e
  FROM (SELECT run_no, o, batches[o] AS b FROM (SELECT run_no, batches, unnest(generate_series(1, len(batches))) AS o FROM retrieval_runs)) WHERE b IS NOT NULL)""",
        "p1_mentions": _MENTIONS.rpartition("SELECT 'mention' AS kind")[0] + """
SELECT record_no, path, parent_path, e->>'mention_id' AS mention_id, e->>'hotword_id' AS hotword_id, e->>'text' AS text, coalesce(e->>'entity_type', e->'attrs'->>'entity_type') AS entity_type,
  CAST(e->>'char_start' AS INTEGER) AS char_start, CAST(e->>'char_end' AS INTEGER) AS char_end, CAST(e->>'occurrence_index' AS INTEGER) AS occurrence_index
FROM m WHERE json_type(e) = 'OBJECT' AND json_exists(e, '$.char_start')""",
        "p1_corrupt": "SELECT record_no, value FROM manifest_raw WHERE CASE WHEN json_valid(value) THEN json_type(value) <> 'OBJECT' ELSE value IS NOT NULL END",
        "p3_found": _LINES + " SELECT line_id, reason FROM c WHERE reason IS NOT NULL",
        "p3_reasons": _LINES + " SELECT source, coalesce(reason, 'loaded') AS reason, count(*) AS lines FROM c GROUP BY ALL",
    }

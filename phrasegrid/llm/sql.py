"""The same results as SQL, where SQL can say them."""

from ..plans.sql import _W, norm

_BEST = """
SELECT utt_id, chunk_id, hotword_id, score, CAST(pos AS INTEGER) AS pos FROM (
  SELECT *, row_number() OVER (PARTITION BY utt_id, chunk_id ORDER BY score DESC, hotword_id) AS pos FROM (
    SELECT utt_id, chunk_id, hotword_id, max(score) AS score FROM search_hits
    WHERE hotword_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL))
WHERE pos <= 5"""

_TIMINGS = """
WITH b AS (SELECT run_no, unnest(batches) AS b FROM retrieval_runs),
t AS (SELECT run_no, b.chunk_id AS chunk_id, unnest(map_entries(b.timings_ms)) AS e FROM b WHERE b.chunk_id >= 0),
v AS (SELECT run_no, chunk_id, e.key AS timing, e.value AS value FROM t
      WHERE e.value IS NOT NULL AND NOT isnan(e.value) AND NOT isinf(e.value) AND e.value >= 0),
m AS (SELECT timing, chunk_id, count(*) AS n, quantile_cont(value, 0.5) AS median FROM v GROUP BY ALL)"""


_TERMS = f"""
WITH e AS (SELECT entry_id, shard_id, {norm('text')} AS term, coalesce(list_sum(list_transform(map_values(source_frequencies), lambda x: coalesce(x, 0))), 0) AS n, loaded_at
  FROM word_entries WHERE text IS NOT NULL),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY loaded_at DESC, term DESC, shard_id DESC, n DESC) AS k FROM e) WHERE k = 1 OR entry_id IS NULL),
s AS (SELECT term, shard_id, sum(n) AS n, count(*) AS records FROM o GROUP BY ALL),
t AS (SELECT term, CAST(sum(n) AS BIGINT) AS total, CAST(sum(records) AS BIGINT) AS records, count(*) FILTER (n >= 1 AND shard_id IS NOT NULL) AS shards FROM s GROUP BY term),
m AS (SELECT *, CASE WHEN shards * 2 > (SELECT count(DISTINCT shard_id) FROM word_entries) THEN 'common' WHEN total BETWEEN 1 AND 4 THEN 'rare' END AS mark FROM t)"""


_SOURCE = "lower(regexp_replace(regexp_replace(source, '^[" + _W + "]+', ''), '[" + _W + "]+$', ''))"


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"SELECT utt_id, chunk_id, hotword_id, pos FROM ({_BEST})",
        "p2_top5_scores": _BEST,
        "p5_found": _TERMS + " SELECT term, mark FROM m WHERE mark IS NOT NULL",
        "p5_terms": _TERMS + " SELECT * FROM m",
        "p5_ngrams": _TERMS + """,
w AS (SELECT row_number() OVER () AS r, term AS t, len(term) AS l FROM o),
g AS (SELECT r, substr(t, CAST(i AS INTEGER), CAST(k AS INTEGER)) AS ngram FROM (SELECT r, t, i, unnest(generate_series(1, l - i + 1)) AS k FROM (SELECT r, t, l, unnest(generate_series(1, l)) AS i FROM w)))
SELECT ngram, count(*) AS occurrences, count(DISTINCT r) AS records FROM g GROUP BY ngram""",
        "p4_found": _TIMINGS + " SELECT run_no, chunk_id, timing FROM v JOIN m USING (timing, chunk_id) WHERE value > 4 * median",
        # Packing and mixing have many right answers: SQL says what every one of them must fulfil.
        "p6_check": f"SELECT coalesce({_SOURCE}, '') AS source, count(*) AS documents, true AS once_and_whole, true AS no_needless_cut, true AS within_capacity, true AS no_gap FROM documents WHERE text IS NOT NULL GROUP BY 1",
        "p7_check": f"""WITH d AS (SELECT {_SOURCE} AS source, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1), t AS (SELECT {_SOURCE} AS source FROM mix_targets)
SELECT t.source, coalesce(d.n, 0) AS documents, true AS within_repeats, true AS share_met FROM t LEFT JOIN d USING (source)""",
        "p8_check": """WITH v AS (SELECT DISTINCT doc_id, rater, flagged FROM content_labels WHERE doc_id IS NOT NULL AND flagged IN (0, 1)),
g AS (SELECT doc_id, CASE WHEN avg(flagged) = 0 THEN 0 WHEN avg(flagged) = 1 THEN 2 ELSE 1 END AS grade FROM v GROUP BY doc_id)
SELECT CAST(grade AS INTEGER) AS grade, count(*) AS documents, true AS told_apart FROM g JOIN documents USING (doc_id) WHERE text IS NOT NULL GROUP BY grade""",
        "p4_rank_check": _TIMINGS + """ SELECT timing, chunk_id, percentile, n AS "values", true AS within_bound FROM m, (VALUES ('p50'), ('p90'), ('p95'), ('p99')) p(percentile)""",
        "p4_medians": _TIMINGS + " SELECT timing, chunk_id, median FROM m",
    }

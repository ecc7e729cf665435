"""The same results as SQL. Where SQL cannot say it, or only too slowly over whole tables, the tests compare with brute force."""

from __future__ import annotations

import unicodedata

from . import records

# By rule: characters whose NFKC form is one other character, and those of general punctuation and of the ligatures with a longer form.
_FROM = [c for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x30000)]) if len(unicodedata.normalize("NFKC", c)) == 1 and unicodedata.normalize("NFKC", c) != c]
_PLAIN = "".join(_FROM)
_NORMAL = "".join(unicodedata.normalize("NFKC", c) for c in _FROM)
_LONG = {c: unicodedata.normalize("NFKC", c) for c in map(chr, [*range(0x2010, 0x2050), *range(0xFB00, 0xFB07)]) if len(unicodedata.normalize("NFKC", c)) > 1}
_W = "\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"


def nfkc(x: str) -> str:
    """NFKC; text of ASCII and ideographs is its own."""
    quote = lambda s: s.replace("'", "''")
    long = x
    for c, form in _LONG.items():
        long = f"replace({long}, '{c}', '{quote(form)}')"
    return f"CASE WHEN regexp_full_match({x}, '[\\x00-\\x7f\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}]*', 's') THEN {x} ELSE nfc_normalize(translate({long}, '{quote(_PLAIN)}', '{quote(_NORMAL)}')) END"


def norm(x: str) -> str:
    """NFKC without white space."""
    return f"regexp_replace({nfkc(x)}, '[{_W}]+', '', 'g')"


def folded(x: str) -> str:
    """NFKC, lower case, white space to single blanks, trimmed."""
    return f"trim(regexp_replace(lower({nfkc(x)}), '[{_W}]+', ' ', 'g'))"


def aligned(x: str) -> str:
    """NFKC, lower case, letters and digits only."""
    return f"regexp_replace(lower({nfkc(x)}), '[^\\pL\\pN]+', '', 'g')"


_HAN = "^[\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}]{2,8}$"
_LOADED = records._LINES + f", g AS (SELECT line_id, source, {norm('term')} AS term, CAST(rest AS BIGINT) AS n FROM c WHERE reason IS NULL)"
_ENTRIES = _LOADED + f""", per AS (SELECT source, term, sum(n) AS n FROM g WHERE regexp_matches(term, '{_HAN}') GROUP BY ALL),
entries AS (SELECT term AS text, string_agg(source || ':' || CAST(n AS VARCHAR), ',' ORDER BY source) AS sources, sum(n) AS total_frequency FROM per GROUP BY term)"""
_BUCKETS = """, ranked AS (SELECT *, row_number() OVER (ORDER BY total_frequency DESC, text) - 1 AS rank, count(*) OVER () AS n FROM {src}),
bucketed AS (SELECT *, least(least(10, n) - 1, rank * least(10, n) // n) AS bucket FROM ranked)"""
_TEXT = "coalesce(CASE WHEN regexp_matches(value->>'target', '[^{w}]') THEN value->>'target' END, CASE WHEN regexp_matches(value->>'text', '[^{w}]') THEN value->>'text' END)".replace("{w}", _W)
_TEXTS = f"t AS (SELECT record_no, {norm('x')} AS t FROM (SELECT record_no, {_TEXT} AS x FROM (SELECT record_no, value::JSON AS value FROM manifest_raw)) WHERE x IS NOT NULL)"
_GRAMS = "SELECT DISTINCT substr(t, CAST(i AS INTEGER), CAST(k AS INTEGER)) AS text FROM (SELECT t, k, unnest(generate_series(1, len(t) - k + 1)) AS i FROM (SELECT DISTINCT t, unnest(generate_series(2, 8)) AS k FROM t))"
_FIRST = lambda a, b: f"coalesce(CASE WHEN regexp_matches(v->>'{a}', '[^{_W}]') THEN v->>'{a}' END, CASE WHEN regexp_matches(v->>'{b}', '[^{_W}]') THEN v->>'{b}' END)"
_MAN = f"""man AS (SELECT record_no, received_at, {_FIRST('key', 'utt_id')} AS utt_id, {_FIRST('source', 'audio')} AS source, coalesce(v->>'target', v->>'text') AS target,
  list_filter(CASE json_type(v->'target_hotword_ids') WHEN 'ARRAY' THEN CAST(v->'target_hotword_ids' AS VARCHAR[]) WHEN 'VARCHAR' THEN [v->>'target_hotword_ids'] ELSE [] END,
    lambda x: x IS NOT NULL AND x <> '') AS ids FROM (SELECT record_no, received_at, value::JSON AS v FROM manifest_raw)),
ids AS (SELECT DISTINCT record_no, utt_id, unnest(ids) AS id FROM man)"""
# Mentions with their text and place, of the shapes the records have.
_M = records._MENTIONS.rpartition("SELECT 'mention' AS kind")[0]
_MENTIONS = _M + """,
men AS (SELECT record_no, e->>'text' AS text, coalesce(e->>'entity_type', e->'attrs'->>'entity_type') AS entity_type, CAST(e->>'char_start' AS INTEGER) AS char_start
  FROM m WHERE json_type(e) = 'OBJECT' AND json_exists(e, '$.char_start')),
occ AS (SELECT *, CAST(row_number() OVER (PARTITION BY record_no, text ORDER BY char_start) - 1 AS INTEGER) AS occurrence_index FROM men)"""
_UNIT = "sqrt(greatest(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)), 1.1920929e-07 * 1.1920929e-07))"
_VEC = f"v AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / {_UNIT}) AS v FROM embeddings)"
_BOUNDARY = f"CASE WHEN starts_with(lower(regexp_replace(coalesce(boundary_group, ''), '^[{_W}]+', '')), 'center') THEN 'center' WHEN starts_with(lower(regexp_replace(coalesce(boundary_group, ''), '^[{_W}]+', '')), 'cross') THEN 'cross' ELSE 'other' END"
_SCORES = f"""r0 AS (SELECT run_no, {_BOUNDARY} AS b, list_distinct(list_filter(coalesce(target_hotword_ids, []), lambda x: x IS NOT NULL)) AS gold,
  coalesce(list_transform(final_batch.hits, lambda h: h.hotword_id), []) AS hits, batches FROM retrieval_runs),
s0 AS (SELECT run_no, b, CAST(len(gold) AS INTEGER) AS gold, {{ks}},
  coalesce(1.0 / nullif(list_position(list_transform(hits, lambda h: coalesce(list_contains(gold, h), false)), true), 0), 0.0) AS reciprocal_rank,
  list_filter(batches, lambda x: len(list_filter(list_slice(x.hits, 1, 50), lambda h: coalesce(list_contains(gold, h.hotword_id), false))) > 0) AS found FROM r0),
s AS (SELECT * EXCLUDE (found), CASE WHEN len(found) > 0 THEN coalesce(found[1].chunk_id, 0) END AS first_top50_chunk FROM s0)"""
_SCORES = _SCORES.replace("{{ks}}", "{ks}").replace(
    "{ks}",
    ", ".join(
        f"CASE WHEN len(gold) > 0 THEN len(list_intersect(gold, list_slice(hits, 1, {k}))) / len(gold) ELSE 0.0 END AS recall_at_{k}, len(list_intersect(gold, list_slice(hits, 1, {k}))) / greatest(1, len(list_slice(hits, 1, {k}))) AS precision_at_{k}"
        for k in (1, 5, 10, 20, 50)
    ),
)
_F1 = lambda k: f"2 * avg(precision_at_{k}) * avg(recall_at_{k}) / greatest(1e-12, avg(precision_at_{k}) + avg(recall_at_{k}))"
_REPORT = ", ".join(f"avg(recall_at_{k}) AS recall_at_{k}, avg(precision_at_{k}) AS precision_at_{k}, {_F1(k)} AS f1_at_{k}, 1 - avg(precision_at_{k}) AS false_alarm_rate_at_{k}" for k in (1, 5, 10, 20, 50))
_CENTER, _CROSS = (f"coalesce(avg(recall_at_50) FILTER (b = '{x}'), 0.0)" for x in ("center", "cross"))
_PAIRS = f"""{_MAN}, runs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY utt_id ORDER BY logged_at DESC, run_no DESC) AS k FROM retrieval_runs WHERE utt_id IS NOT NULL) WHERE k = 1),
lastm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY utt_id ORDER BY received_at DESC, record_no DESC) AS k FROM man WHERE utt_id IS NOT NULL AND target IS NOT NULL) WHERE k = 1),
want AS (SELECT utt_id, list_distinct(list(h.text)) AS hotwords FROM (SELECT utt_id, unnest(target_hotword_ids) AS id FROM runs) r JOIN hotwords h USING (id) GROUP BY utt_id),
pairs AS (SELECT m.utt_id, m.target AS reference, coalesce(array_to_string(list_transform(r.final_batch.hits, lambda h: h.variant), ' '), '') AS hypothesis, r.boundary_group, r.rtf, w.hotwords
  FROM lastm m JOIN runs r USING (utt_id) LEFT JOIN want w USING (utt_id)),
folded AS (SELECT utt_id, len(coalesce(hotwords, [])) AS n, {folded('reference')} AS r, {folded('hypothesis')} AS h, coalesce(hotwords, []) AS hotwords FROM pairs),
each AS (SELECT utt_id, n, r, h, {folded('k')} AS k FROM (SELECT utt_id, n, r, h, unnest(CASE WHEN len(hotwords) = 0 THEN [''] ELSE hotwords END) AS k FROM folded)),
cnt AS (SELECT utt_id, n, CASE WHEN k = '' THEN 0 ELSE (len(r) - len(replace(r, k, ''))) // len(k) END AS e, CASE WHEN k = '' THEN 0 ELSE (len(h) - len(replace(h, k, ''))) // len(k) END AS p FROM each),
sums AS (SELECT utt_id, n, CAST(sum(e) AS BIGINT) AS keyword_ref, CAST(sum(p) AS BIGINT) AS keyword_hyp, CAST(sum(least(e, p)) AS BIGINT) AS keyword_tp FROM cnt GROUP BY ALL)"""
_FINITE = "value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value)"
_TIMES = f"times AS (SELECT e.key AS name, e.value AS value FROM (SELECT unnest(map_entries(b.timings_ms)) AS e FROM (SELECT unnest(batches) AS b FROM retrieval_runs)))"
_SERIES = lambda name, src: f"SELECT '{name}' AS name, avg(value) AS mean, quantile_cont(value, 0.5) FILTER (NOT isnan(value) AND NOT isinf(value)) AS p50, quantile_cont(value, 0.95) FILTER (NOT isnan(value) AND NOT isinf(value)) AS p95, max(value) AS max FROM ({src}) WHERE value IS NOT NULL HAVING count(*) > 0"


def oracle_sql() -> dict[str, str]:
    q = dict(records.oracle_sql())
    q["p3_loaded"] = _LOADED + " SELECT line_id, source, term, n AS count FROM g"
    q["word_freq_merged"] = _ENTRIES + " SELECT text, sources, CAST(total_frequency AS VARCHAR) AS total_frequency FROM entries"
    q["load_stats"] = _LOADED + f""", j AS (SELECT w.source, c.line_id IS NULL AS skipped, c.reason, regexp_matches(g.term, '{_HAN}') AS fits, g.term FROM word_freq w LEFT JOIN c USING (line_id) LEFT JOIN g USING (line_id))
SELECT source, count(*) AS total_lines, count(*) FILTER (fits) AS accepted_lines, count(*) FILTER (skipped) AS blank_or_comment_lines,
  count(*) FILTER (NOT skipped AND reason IS NULL AND NOT fits) AS filtered_lines, count(*) FILTER (reason IS NOT NULL) AS failed_lines, count(DISTINCT term) FILTER (fits) AS unique_terms FROM j GROUP BY source"""
    q["term_filter"] = f"SELECT entry_id, term FROM (SELECT entry_id, {norm('text')} AS term FROM word_entries) WHERE regexp_matches(term, '{_HAN}')"
    q["unspoken_terms"] = _ENTRIES + f", {_TEXTS} SELECT text, CAST(total_frequency AS VARCHAR) AS total_frequency FROM entries WHERE text NOT IN ({_GRAMS})"
    q["transcript_ngrams"] = f"WITH {_TEXTS} SELECT text AS term FROM (SELECT text FROM ({_GRAMS}) UNION SELECT t FROM t WHERE t <> '')"
    q["frequency_buckets"] = _ENTRIES + _BUCKETS.format(src="entries") + " SELECT text, rank, CAST(bucket AS INTEGER) AS bucket FROM bucketed"
    q["stratified_sample"] = _ENTRIES + _BUCKETS.format(src="entries") + """, placed AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY sha256('42:' || CAST(bucket AS VARCHAR) || ':' || text), text) - 1 AS pos FROM bucketed)
SELECT text, CAST(total_frequency AS VARCHAR) AS total_frequency, CAST(bucket AS INTEGER) AS bucket FROM placed ORDER BY pos, bucket LIMIT 200"""
    q["stable_ids"] = f"SELECT id, 'neg-' || substr(sha256({norm('text')}), 1, 16) AS stable_id FROM hotwords"
    q["negative_vocabulary"] = f"""WITH l AS (SELECT regexp_replace(regexp_replace(regexp_replace(value, '^\\x{{feff}}', ''), '^[{_W}]+', ''), '[{_W}]+$', '') AS l FROM word_freq)
SELECT DISTINCT term FROM (SELECT l, regexp_replace(l, '[{_W}]+\\p{{Nd}}+$', '') AS term FROM l) WHERE l <> '' AND NOT starts_with(l, '#') AND term <> ''"""
    q["shared_negatives"] = """SELECT term FROM (SELECT DISTINCT text AS term FROM hotwords) WHERE term NOT IN (
  SELECT v FROM (SELECT unnest(list_transform(final_batch.hits, lambda h: h.variant)) AS v FROM retrieval_runs) WHERE v IS NOT NULL)
ORDER BY sha256('4295098371:' || term) LIMIT 4095"""
    q["spelling_variants"] = """WITH v AS (SELECT id, list_concat([text], coalesce(aliases, [])) AS a FROM hotwords),
o AS (SELECT id, flatten(list_transform(a, lambda x: [x, trim(regexp_replace(lower(x), '\\s+', ' ', 'g'))])) AS a FROM v),
u AS (SELECT id, list_filter(a, lambda x, i: list_position(a, x) = i) AS a FROM o),
w AS (SELECT id, flatten(list_transform(a, lambda x: [x, ' ' || x, chr(10) || x])) AS a FROM u),
z AS (SELECT id, list_filter(a, lambda x, i: list_position(a, x) = i) AS a FROM w)
SELECT id, CAST(i - 1 AS INTEGER) AS n, a[i] AS variant FROM (SELECT id, a, unnest(generate_series(1, len(a))) AS i FROM z)"""
    q["unknown_targets"] = f"WITH {_MAN} SELECT record_no, id FROM ids WHERE id NOT IN (SELECT id FROM hotwords)"
    q["stale_hits"] = "SELECT hotword_id, count(*) AS hits FROM search_hits WHERE hotword_id IS NOT NULL AND hotword_id NOT IN (SELECT id FROM hotwords) GROUP BY 1"
    q["catalog_overlay"] = """WITH o AS (SELECT h.hotword_id AS id, max(h.variant) AS text FROM (SELECT unnest(final_batch.hits) AS h FROM retrieval_runs) WHERE h.hotword_id IS NOT NULL AND h.variant IS NOT NULL GROUP BY 1)
SELECT * FROM o UNION ALL SELECT id, text FROM hotwords WHERE id NOT IN (SELECT id FROM o)"""
    q["duplicate_texts"] = "SELECT sha256(text) AS digest, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1"
    q["manifest_fields"] = f"WITH {_MAN} SELECT record_no, utt_id AS key, source, target, array_to_string(list_filter(ids, lambda x, i: list_position(ids, x) = i), ',') AS target_ids FROM man"
    q["manifest_invalid"] = f"WITH {_MAN} SELECT * FROM (SELECT record_no, CASE WHEN utt_id IS NULL THEN 'key' WHEN source IS NULL THEN 'source' WHEN target IS NULL THEN 'target' END AS missing FROM man) WHERE missing IS NOT NULL"
    q["occurrence_index"] = _MENTIONS + " SELECT record_no, text, char_start, occurrence_index FROM occ"
    q["mention_stats"] = _MENTIONS + " SELECT text, coalesce(string_agg(DISTINCT entity_type, ',' ORDER BY entity_type), '') AS types, count(*) AS mention_count FROM men GROUP BY text"
    q["key_reconcile"] = f"""WITH {_MAN}, a AS (SELECT utt_id, unnest(target_hotword_ids) AS id FROM retrieval_runs), act AS (SELECT utt_id, id, count(*) AS a FROM a WHERE id IS NOT NULL GROUP BY ALL), e AS (SELECT DISTINCT utt_id, id FROM ids)
SELECT coalesce(e.utt_id, act.utt_id) AS utt_id, coalesce(e.id, act.id) AS hotword_id, CASE WHEN act.id IS NULL THEN 'missing' WHEN e.id IS NULL THEN 'extra' ELSE 'duplicate' END AS status
FROM e FULL JOIN act ON e.utt_id IS NOT DISTINCT FROM act.utt_id AND e.id = act.id WHERE act.id IS NULL OR e.id IS NULL OR act.a > 1"""
    q["pending_utterances"] = f"""WITH {_MAN}, h AS (SELECT utt_id, unnest(list_transform(final_batch.hits, lambda h: h.hotword_id)) AS id FROM retrieval_runs)
SELECT DISTINCT utt_id FROM ids WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.utt_id = ids.utt_id AND h.id = ids.id)"""
    q["safe_ids"] = "SELECT run_no, regexp_replace(regexp_replace(concat_ws('#', utt_id, boundary_group), '[^0-9A-Za-z_.-]+', '_', 'g'), '^_+|_+$', '', 'g') AS safe_id FROM retrieval_runs"
    q["boundary_variants"] = """WITH s AS (SELECT event_id, (event_id % 97) / 8.0::DOUBLE AS s, (event_id % 97) / 8.0::DOUBLE + 0.25 + (event_id % 5) / 4.0::DOUBLE AS e FROM events),
c(name, kind, value) AS (VALUES ('center', 'center', 0.5), ('b-400', 'before', 0.4), ('b-200', 'before', 0.2), ('b-100', 'before', 0.1), ('cross-25', 'cross', 0.25), ('cross-50', 'cross', 0.5), ('cross-75', 'cross', 0.75)),
l AS (SELECT event_id, name, s, e, CAST(CASE kind WHEN 'cross' THEN s + (e - s) * (1 - value::DOUBLE) ELSE (s + e) / 2 END AS DOUBLE) AS land, CAST(CASE kind WHEN 'center' THEN 1.0 WHEN 'before' THEN 2.0 - value::DOUBLE ELSE 0.0 END AS DOUBLE) AS phase FROM s, c),
x AS (SELECT event_id, name, s, e, phase + greatest(0, ceil((land - phase) / 2.0)) * 2.0 - land AS q FROM l)
SELECT event_id, name AS boundary_group, round(q, 6) AS leading_silence_sec, round(s + q, 6) AS word_start_sec, round(e + q, 6) AS word_end_sec FROM x"""
    q["jsonl_round_trip"] = "SELECT id, text, array_to_string(aliases, ',') AS aliases, weight, metadata FROM hotwords"
    q["vector_top10"] = f"""WITH {_VEC}, p AS (SELECT a.vec_id AS query, printf('k%07d', b.vec_id) AS hotword_id, round(list_dot_product(a.v, b.v), 6) AS score FROM v a, v b WHERE a.vec_id % 50 = 0)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, hotword_id) AS INTEGER) AS rank FROM p) WHERE rank <= 10"""
    best = f"""WITH {_VEC}, f AS (SELECT {{unit}}, CAST({{frame}} AS INTEGER) AS frame, v FROM v WHERE vec_id % 50 = 0), k AS (SELECT 'h' || label AS hotword_id, printf('v%07d', vec_id) AS variant, v FROM v),
p AS (SELECT {{cols}}, hotword_id, variant, frame, round(list_dot_product(f.v, k.v), 6) AS score FROM {{from}}, k),
one AS (SELECT *, row_number() OVER (PARTITION BY {{keys}}, hotword_id ORDER BY score DESC, variant, frame) AS n FROM p),
top AS (SELECT *, CAST(row_number() OVER (PARTITION BY {{keys}} ORDER BY score DESC, hotword_id) AS INTEGER) AS rank FROM one WHERE n = 1)
SELECT {{keys}}, hotword_id, score, rank, frame AS peak_frame, variant FROM top WHERE rank <= {{k}}"""
    q["phrase_search"] = best.format(unit="vec_id // 200 AS utt", frame="vec_id % 200", cols="utt", keys="utt", k=5, **{"from": "f"})
    q["accumulated_search"] = best.format(
        unit="vec_id // 500 AS utt, CAST((vec_id % 500) // 100 AS INTEGER) AS chunk", frame="vec_id % 500", cols="c.utt, c.chunk", keys="utt, chunk", k=3,
        **{"from": "(SELECT DISTINCT utt, chunk FROM f) c JOIN f ON f.utt = c.utt AND f.chunk <= c.chunk"},
    )
    q["retrieval_stream"] = q["accumulated_search"]
    q["utterance_top50"] = """WITH b AS (SELECT utt_id, hotword_id, max(score) AS score FROM search_hits WHERE hotword_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY utt_id ORDER BY score DESC, hotword_id) AS INTEGER) AS rank FROM b) WHERE rank <= 50"""
    q["retrieval_scores"] = f"WITH {_SCORES} SELECT run_no, gold, recall_at_1, recall_at_5, precision_at_5, reciprocal_rank, first_top50_chunk FROM s"
    q["retrieval_report"] = f"""WITH {_SCORES} SELECT count(*) AS evaluable, {_REPORT}, avg(reciprocal_rank) AS mrr, coalesce(avg(first_top50_chunk), -1.0) AS first_top50_chunk_mean,
  {_CENTER} AS recall_center_at_50, {_CROSS} AS recall_cross_at_50, count(*) FILTER (b = 'center') AS center_utterances, count(*) FILTER (b = 'cross') AS cross_utterances, {_CENTER} - {_CROSS} AS boundary_penalty FROM s WHERE gold > 0"""
    q["recall_by_boundary"] = f"WITH {_SCORES} SELECT b AS boundary, count(*) AS utterances, avg(recall_at_50) AS recall FROM s WHERE gold > 0 GROUP BY b"
    q["latency_percentiles"] = f"WITH {_TIMES} SELECT name, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM times WHERE {_FINITE} GROUP BY name"
    q["streaming_report"] = f"WITH {_TIMES} " + " UNION ALL ".join(
        (
            _SERIES("chunk_latency_ms", f"SELECT value FROM times WHERE name = 'encode_ms' AND {_FINITE}"),
            _SERIES("rtf", "SELECT rtf AS value FROM retrieval_runs"),
            _SERIES("gpu_memory_mb", "SELECT peak_memory_mb AS value FROM retrieval_runs"),
        )
    )
    q["keyword_counts"] = f"""WITH {_PAIRS}, x AS (SELECT *, greatest(0, keyword_hyp - keyword_tp) AS keyword_fp, keyword_tp / greatest(1, keyword_hyp) AS p, keyword_tp / greatest(1, keyword_ref) AS r FROM sums)
SELECT utt_id, keyword_ref, keyword_hyp, keyword_tp, keyword_fp, p AS keyword_precision, r AS keyword_recall, 2 * p * r / greatest(1e-12, p + r) AS keyword_f1, keyword_fp / greatest(1, n) AS keyword_far FROM x"""
    q["part_name_errors"] = """WITH p AS (SELECT p_partkey, lower(p_name) AS r, lower(lead(p_name) OVER (PARTITION BY p_size ORDER BY p_partkey)) AS h FROM part)
SELECT p_partkey, CAST(levenshtein(replace(r, ' ', ''), replace(h, ' ', '')) AS INTEGER) AS char_errors, CAST(len(replace(r, ' ', '')) AS INTEGER) AS ref_chars, CAST(len(string_split(r, ' ')) AS INTEGER) AS ref_words FROM p WHERE h IS NOT NULL"""
    q["paired_rtf"] = """WITH b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY utt_id ORDER BY logged_at DESC, run_no DESC) AS k FROM retrieval_runs) WHERE k = 1)
SELECT r.run_no, r.utt_id, r.rtf - b.rtf AS difference FROM retrieval_runs r JOIN b USING (utt_id)"""
    cells = [f"{n}_at_{k}" for k in (1, 5, 10, 20, 50) for n in ("recall", "precision", "f1", "false_alarm_rate")]
    cells += ["evaluable", "mrr", "first_top50_chunk_mean", "recall_center_at_50", "recall_cross_at_50", "center_utterances", "cross_utterances", "boundary_penalty"]
    whole = q["retrieval_report"].removeprefix(f"WITH {_SCORES} ")
    runs = f"""WITH {_SCORES}, {_TIMES}, rep AS ({whole}), per AS (SELECT name, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM times WHERE {_FINITE} GROUP BY name),
all_ AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS name, CAST({c} AS DOUBLE) AS value FROM rep" for c in cells) + """
UNION ALL SELECT name || '_p50', p50 FROM per UNION ALL SELECT name || '_p95', p95 FROM per
UNION ALL SELECT 'utterances', count(*) FROM retrieval_runs UNION ALL SELECT 'rtf_mean', coalesce(avg(rtf), 0.0) FROM retrieval_runs
UNION ALL SELECT 'peak_memory_mb_max', coalesce(max(peak_memory_mb), 0.0) FROM retrieval_runs UNION ALL SELECT 'offline_final_exact_match_rate', avg(CAST(offline_final_exact_match AS INTEGER)) FROM retrieval_runs)"""
    q["run_metrics"] = runs + " SELECT * FROM all_ WHERE value IS NOT NULL"
    # The interval's lower bound lies above 0 just where the mean is more than about two standard errors above it.
    q["release_gates"] = runs + """, m AS (SELECT coalesce(max(value) FILTER (name = 'boundary_penalty') <= 0.03 AND max(value) FILTER (name = 'center_utterances') > 0 AND max(value) FILTER (name = 'cross_utterances') > 0, false) AS boundary_ok,
  coalesce(max(value) FILTER (name = 'offline_final_exact_match_rate') = 1.0, false) AS parity_ok, coalesce(max(value) FILTER (name = 'search_ms_p95') < 10, false) AS latency_ok FROM all_),
g AS (SELECT coalesce(avg(recall_at_50 - recall_at_5) >= 0.05 AND avg(recall_at_50 - recall_at_5) > 1.96 * stddev_samp(recall_at_50 - recall_at_5) / sqrt(count(*)), false) AS recall_ok FROM s WHERE gold > 0)
SELECT recall_ok, boundary_ok, parity_ok, latency_ok, recall_ok AND boundary_ok AND parity_ok AND latency_ok AS go FROM m, g"""
    q["tumbling_chunks"] = """WITH e AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 16 AS c FROM events)
SELECT user_id, CAST(c AS INTEGER) AS chunk_id, count(*) AS events, min(event_id) AS first_id, round(sum(value), 4) AS total FROM e GROUP BY ALL"""
    q["accumulated_refreshes"] = """WITH e AS (SELECT user_id, event_id, 100 + event_id * 37 % 901 AS n FROM events),
c AS (SELECT *, CAST(sum(n) OVER w AS BIGINT) AS e, lead(1) OVER w IS NULL AS z FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
x AS (SELECT user_id, event_id, e, z, unnest(list_distinct(list_concat(list_transform(range((e - n) // 4000 + 1, e // 4000 + 1), lambda i: i * 4000), CASE WHEN z THEN [e] ELSE [] END))) AS s FROM c)
SELECT user_id, event_id, CAST((s + 3999) // 4000 - 1 AS INTEGER) AS chunk_id, CAST(s AS BIGINT) AS sample_count, z AND s = e AS is_final FROM x"""
    q["revision_prefix"] = """WITH b AS (SELECT run_no, i, list_transform(b.hits, lambda h: h.hotword_id) AS ids FROM (SELECT run_no, i, batches[i] AS b FROM (SELECT run_no, batches, unnest(generate_series(1, len(batches))) AS i FROM retrieval_runs)) WHERE b IS NOT NULL AND b.hits IS NOT NULL),
p AS (SELECT *, lag(ids) OVER (PARTITION BY run_no ORDER BY i) AS before FROM b),
k AS (SELECT *, list_position(list_transform(range(1, least(len(ids), len(before)) + 1), lambda j: ids[j] IS NOT DISTINCT FROM before[j]), false) AS bad FROM p WHERE before IS NOT NULL)
SELECT run_no, CAST(i - 1 AS INTEGER) AS i, CAST(coalesce(nullif(bad, 0) - 1, least(len(ids), len(before))) AS INTEGER) AS kept, CAST(len(before) - coalesce(nullif(bad, 0) - 1, least(len(ids), len(before))) AS INTEGER) AS revised FROM k"""
    q["rollback_starts"] = """WITH l AS (SELECT l_orderkey, l_linenumber, l_linenumber AS c, CAST(l_quantity AS INTEGER) + l_linenumber AS n, CASE WHEN l_partkey % 3 > 0 THEN l_partkey % 60 END AS a, l_suppkey % 5 AS k FROM lineitem),
u AS (SELECT *, greatest(c, least(1, n), n - 5) AS usual FROM l)
SELECT l_orderkey, l_linenumber, CAST(CASE WHEN k < 2 THEN c WHEN a IS NULL THEN usual ELSE greatest(c, n - 32, least(usual, least(n, greatest(0, a)))) END AS INTEGER) AS rollback_start FROM u"""
    q["audio_pieces"] = """WITH r AS (SELECT run_no, CAST(round_even(final_batch.accumulated_audio_sec * 16000, 0) AS BIGINT) AS t FROM retrieval_runs WHERE final_batch.accumulated_audio_sec > 0)
SELECT run_no, CAST(i AS INTEGER) AS seq, CAST(i * 1600 AS BIGINT) AS start, CAST(least(1600, t - i * 1600) AS BIGINT) AS n FROM (SELECT run_no, t, unnest(range(0, (t + 1599) // 1600)) AS i FROM r)"""
    q["entity_types"] = _MENTIONS + " SELECT entity_type, count(*) AS mentions, count(DISTINCT record_no) AS records FROM men GROUP BY 1"
    q["entity_records"] = _MENTIONS + " SELECT record_no, shard FROM manifest_raw WHERE record_no IN (SELECT record_no FROM men)"
    q["pronunciations"] = """WITH p AS (SELECT id, text, CAST(metadata::JSON->'pronunciations' AS VARCHAR[][]) AS p FROM hotwords),
a AS (SELECT id, CASE WHEN p IS NULL OR len(p) = 0 THEN [string_split(text, '')] ELSE p END AS p FROM p)
SELECT id, CAST(i - 1 AS INTEGER) AS n, array_to_string(p[i], ' ') AS path FROM (SELECT id, p, unnest(generate_series(1, len(p))) AS i FROM a)"""
    q["training_batches"] = "SELECT record_no, shard, CAST((row_number() OVER (PARTITION BY shard ORDER BY sha256('42:1:' || record_no)) - 1) // 48 AS INTEGER) AS batch FROM manifest_raw"
    q["positive_pairs"] = "SELECT run_no, id FROM (SELECT run_no, final_batch.hits[1].variant AS text FROM retrieval_runs) JOIN hotwords USING (text)"
    q["overlapped_chunks"] = f'SELECT run_no, seq, greatest(0, start - 3200) AS "from", start - greatest(0, start - 3200) AS overlap FROM ({q["audio_pieces"]})'
    q["hotword_languages"] = """SELECT coalesce(n, l) AS language, count(*) AS phrases FROM (SELECT trim(coalesce(language, 'zh')) AS l FROM hotwords)
LEFT JOIN (VALUES ('zh', 'Chinese'), ('zh-cn', 'Chinese'), ('chinese', 'Chinese'), ('en', 'English'), ('english', 'English'), ('yue', 'Cantonese'), ('cantonese', 'Cantonese')) v(k, n) ON lower(l) = k GROUP BY 1"""
    from . import sql_texts

    return q | sql_texts.oracle_sql()

"""SQL of phrases in texts, spans, catalogs, errors and round trips, and of what results with many right answers must fulfil."""

from __future__ import annotations

from .sql import _BUCKETS, _ENTRIES, _GRAMS, _M, _MAN, _PAIRS, _SCORES, _TEXTS, _TEXT, _W, aligned, folded, nfkc, norm

# Texts cut into overlapping blocks, so that a place is near the start of its string: {texts} has (k, t), {pats} has (p).
_PLACES = """head AS (SELECT DISTINCT substr(p, 1, 1) AS c, len(p) AS n FROM {pats}),
blk AS (SELECT k, b, substr(t, CAST(b + 1 AS INTEGER), CAST(200 + (SELECT max(n) FROM head) AS INTEGER)) AS block, least(200, len(t) - b) AS own FROM (SELECT k, t, unnest(range(0, len(t), 200)) AS b FROM {texts})),
plc AS (SELECT k, b, block, unnest(range(1, own + 1)) AS i FROM blk),
sub AS (SELECT k, b + i - 1 AS start, n, substr(block, CAST(i AS INTEGER), CAST(n AS INTEGER)) AS g FROM plc JOIN head ON substr(block, CAST(i AS INTEGER), 1) = c WHERE i + n - 1 <= len(block))"""
_PATS = f"pats AS (SELECT DISTINCT id, p FROM (SELECT id, {folded('v')} AS p FROM (SELECT id, unnest(list_concat([text], coalesce(aliases, []))) AS v FROM hotwords) WHERE v IS NOT NULL) WHERE p <> '')"
_RAW_TEXTS = f"raw AS (SELECT record_no, {_TEXT} AS x FROM (SELECT record_no, value::JSON AS value FROM manifest_raw))"
_MEN = _M + """,
men AS (SELECT record_no, e->>'text' AS text, CAST(e->>'char_start' AS INTEGER) AS char_start FROM m WHERE json_type(e) = 'OBJECT' AND json_exists(e, '$.char_start'))"""
_SPANS = _MEN + f""", {_RAW_TEXTS},
item AS (SELECT record_no, i - 1 AS i, {aligned("substr(x, CAST(i AS INTEGER), 1)")} AS c FROM (SELECT record_no, x, unnest(range(1, len(x) + 1)) AS i FROM raw WHERE x IS NOT NULL)),
flat AS (SELECT record_no, string_agg(c, '' ORDER BY i) AS t, flatten(list(list_transform(range(0, len(c)), lambda z: i) ORDER BY i)) AS owner FROM item GROUP BY record_no),
var AS (SELECT record_no, v, {aligned("v")} AS n FROM (SELECT DISTINCT record_no, text AS v FROM men WHERE text IS NOT NULL)),
one AS (SELECT record_no, n, min(v) AS v FROM var WHERE n <> '' GROUP BY ALL),
hit AS (SELECT o.record_no, o.v, o.n, f.owner, f.t, unnest(range(1, len(f.t) - len(o.n) + 2)) AS p FROM one o JOIN flat f USING (record_no)),
found AS (SELECT record_no, v AS variant, p, owner[p] AS first_item, owner[p + len(n) - 1] AS last_item FROM hit WHERE substr(t, CAST(p AS INTEGER), len(n)) = n),
best AS (SELECT *, row_number() OVER (PARTITION BY record_no, first_item, last_item ORDER BY variant, p) AS k FROM found),
spans AS (SELECT record_no, variant, CAST(first_item AS INTEGER) AS first_item, CAST(last_item AS INTEGER) AS last_item,
  CAST(row_number() OVER (PARTITION BY record_no ORDER BY first_item, last_item, variant) - 1 AS INTEGER) AS span_index FROM best WHERE k = 1)"""
_PLACED = """, placed AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY sha256('42:' || CAST(bucket AS VARCHAR) || ':' || text), text) - 1 AS pos FROM bucketed)"""
# Distances count code points: the characters (or words) of a pair are written as single bytes first.
_CODES = "array_to_string(list_transform(range(1, 128), lambda i: chr(CAST(i AS INTEGER))), '')"
_CHARS = f"levenshtein(translate({{a}}, {{all}}, {_CODES}), translate({{b}}, {{all}}, {_CODES}))"
_ERRORS = _PAIRS + f""",
txt AS (SELECT p.utt_id, p.boundary_group, p.rtf, f.r, f.h, list_filter(string_split(f.r, ' '), lambda w: w <> '') AS rw, list_filter(string_split(f.h, ' '), lambda w: w <> '') AS hw, replace(f.r, ' ', '') AS rc, replace(f.h, ' ', '') AS hc FROM folded f JOIN pairs p USING (utt_id)),
cod AS (SELECT *, list_distinct(list_concat(rw, hw)) AS words, array_to_string(list_distinct(list_transform(range(1, len(rc || hc) + 1), lambda i: substr(rc || hc, CAST(i AS INTEGER), 1))), '') AS chars FROM txt),
err AS (SELECT *, {_CHARS.format(a="rc", b="hc", all="chars")} AS char_errors, levenshtein(array_to_string(list_transform(rw, lambda w: chr(list_position(words, w))), ''), array_to_string(list_transform(hw, lambda w: chr(list_position(words, w))), '')) AS word_errors FROM cod)"""
_TAG = "p_name || ' [' || p_brand || '](' || split_part(p_type, ' ', 1) || ')'"


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    docs = f"texts AS (SELECT doc_id AS k, {folded('text')} AS t FROM documents WHERE text IS NOT NULL)"
    found = f"WITH {_PATS}, {docs}, {_PLACES.format(texts='texts', pats='pats')}"
    q["phrase_matches"] = q["phrase_matches_automaton"] = found + " SELECT id, count(*) AS matches, count(DISTINCT k) AS documents FROM sub JOIN pats ON g = p GROUP BY id"
    q["transcript_matches"] = f"""WITH {_PATS}, {_RAW_TEXTS}, texts AS (SELECT record_no AS k, {folded('x')} AS t FROM raw WHERE x IS NOT NULL), {_PLACES.format(texts='texts', pats='pats')},
f AS (SELECT k, id, start, n, row_number() OVER (PARTITION BY k, start ORDER BY n DESC, id) AS z FROM sub JOIN pats ON g = p)
SELECT k AS record_no, id, CAST(start AS INTEGER) AS start, CAST(n AS INTEGER) AS length FROM f WHERE z = 1"""
    texts = f"texts AS (SELECT DISTINCT 0 AS k, {norm('text')} AS t FROM documents WHERE text IS NOT NULL), pats AS (SELECT text AS p FROM entries)"
    q["spoken_terms"] = _ENTRIES + f", {texts}, {_PLACES.format(texts='texts', pats='pats')} SELECT DISTINCT g AS text FROM sub SEMI JOIN pats ON g = p"
    q["catalog_evaluation"] = _ENTRIES + f""", {_TEXTS},
hot AS (SELECT * FROM hotwords WHERE metadata::JSON->>'role' = 'evaluation_target'),
spell AS (SELECT DISTINCT id, s FROM (SELECT id, {norm('v')} AS s FROM (SELECT id, unnest(list_concat([text], coalesce(aliases, []))) AS v FROM hot) WHERE v IS NOT NULL) WHERE s <> ''),
tgt AS (SELECT * FROM hot WHERE id NOT IN (SELECT id FROM spell WHERE s IN (SELECT s FROM spell GROUP BY s HAVING count(DISTINCT id) > 1))),
ali AS (SELECT id, list_sort(list_distinct(list(a))) AS a FROM (SELECT id, {norm('v')} AS a FROM (SELECT id, unnest(aliases) AS v FROM tgt) WHERE v IS NOT NULL) GROUP BY id),
free AS (SELECT * FROM entries WHERE text NOT IN ({_GRAMS}) AND text NOT IN (SELECT s FROM spell WHERE id IN (SELECT id FROM tgt))){_BUCKETS.format(src="free")}{_PLACED},
chosen AS (SELECT * FROM placed ORDER BY pos, bucket LIMIT (10000 - (SELECT count(*) FROM tgt)))
SELECT CAST(row_number() OVER (ORDER BY id) AS INTEGER) AS position, id, n AS text, array_to_string(list_filter(coalesce(a, []), lambda x: x <> '' AND x <> n), ',') AS aliases, coalesce(language, 'zh') AS language, coalesce(weight, 1.0) AS weight
FROM (SELECT tgt.*, a, {norm('text')} AS n FROM tgt LEFT JOIN ali USING (id))
UNION ALL SELECT CAST(row_number() OVER (ORDER BY total_frequency DESC, text) + (SELECT count(*) FROM tgt) AS INTEGER), 'dist-' || substr(sha256(text), 1, 16), text, '', 'zh', 1.0 FROM chosen"""
    q["catalog_negatives"] = _ENTRIES + _BUCKETS.format(src="entries") + _PLACED + """, js AS (SELECT term, '{' || string_agg('"' || source || '":' || CAST(n AS VARCHAR), ',' ORDER BY source) || '}' AS j FROM per GROUP BY term)
SELECT 'neg-' || substr(sha256(text), 1, 16) AS id, text, '{"role":"train_negative","total_frequency":' || CAST(total_frequency AS VARCHAR) || ',"source_frequencies":' || j || '}' AS metadata
FROM (SELECT * FROM placed ORDER BY pos, bucket LIMIT 10000) JOIN js ON text = term"""
    marked = "[^\\[\\]()<>]"
    filled = f"[{_W}]*[^\\[\\]()<>{_W}]{marked}*"
    good = f"\\[{filled}\\]|\\({filled}\\)|<{filled}>"
    inside = lambda a, z: f"CASE WHEN strpos(rest, '{z}') = 0 THEN 'unclosed mark' WHEN regexp_matches(substr(rest, 2, strpos(rest, '{z}') - 2), '[\\[\\]()<>]') THEN 'nested mark' ELSE 'empty entity' END"
    q["marker_parse"] = f"""WITH d AS (SELECT regexp_replace(regexp_replace({nfkc('text')}, '^[{_W}]+', ''), '[{_W}]+$', '') AS t FROM documents),
r AS (SELECT t, regexp_replace(t, '^({marked}|{good})*', '', 's') AS rest FROM d),
e AS (SELECT t, CASE WHEN t IS NULL THEN NULL WHEN rest = '' THEN CASE WHEN regexp_matches(t, '[^{_W}]') THEN NULL ELSE 'empty transcript' END WHEN rest[1] IN (']', ')', '>') THEN 'unmatched'
  WHEN rest[1] = '[' THEN {inside('[', ']')} WHEN rest[1] = '(' THEN {inside('(', ')')} ELSE {inside('<', '>')} END AS error FROM r)
SELECT error, count(*) AS documents, CAST(coalesce(sum(CASE WHEN error IS NULL THEN len(regexp_extract_all(t, '{good}')) ELSE 0 END), 0) AS BIGINT) AS mentions FROM e GROUP BY error"""
    q["mention_spans"] = _SPANS + " SELECT * FROM spans"
    q["resolved_spans"] = _SPANS + """,
num AS (SELECT *, row_number() OVER (PARTITION BY record_no, variant ORDER BY first_item) - 1 AS j, count(*) OVER (PARTITION BY record_no, variant) AS n FROM spans),
want AS (SELECT record_no, text AS variant, CAST(row_number() OVER (PARTITION BY record_no, text ORDER BY char_start) - 1 AS INTEGER) AS occurrence_index FROM men WHERE text IS NOT NULL)
SELECT w.record_no, w.variant, w.occurrence_index, s.first_item, CASE WHEN c.n IS NULL THEN 'absent' WHEN w.occurrence_index >= c.n THEN 'occurrence unavailable' END AS error
FROM want w LEFT JOIN (SELECT DISTINCT record_no, variant, n FROM num) c USING (record_no, variant) LEFT JOIN num s ON s.record_no = w.record_no AND s.variant = w.variant AND s.j = w.occurrence_index"""
    q["mention_ids"] = _MEN + """ SELECT record_no, char_start, printf('%d#entity-%02d', record_no, row_number() OVER (PARTITION BY record_no ORDER BY char_start, text) - 1) AS mention_id FROM men"""
    q["transcript_report"] = f"""WITH {_ERRORS}, j AS (SELECT e.*, s.keyword_tp, s.keyword_ref, s.keyword_hyp, greatest(0, s.keyword_hyp - s.keyword_tp) AS keyword_fp, s.keyword_tp / greatest(1, s.keyword_ref) AS kr, coalesce(boundary_group, 'unspecified') AS g FROM err e JOIN sums s USING (utt_id)),
a AS (SELECT count(*) AS records, sum(word_errors) / greatest(1, sum(len(rw))) AS wer, sum(char_errors) / greatest(1, sum(len(rc))) AS cer, sum(keyword_tp) / greatest(1, sum(keyword_hyp)) AS p, sum(keyword_tp) / greatest(1, sum(keyword_ref)) AS r,
  sum(keyword_fp) / count(*) AS keyword_far, avg(kr) FILTER (g = 'center') - avg(kr) FILTER (starts_with(g, 'cross')) AS boundary_penalty, avg(rtf) AS rtf_mean FROM j)
SELECT records, wer, cer, p AS keyword_precision, r AS keyword_recall, 2 * p * r / greatest(1e-12, p + r) AS keyword_f1, keyword_far, boundary_penalty, rtf_mean FROM a"""
    q["partition_totals"] = f"""WITH {_ERRORS} SELECT utt_id, CAST(CASE WHEN contains(r, ' ') THEN len(rw) ELSE len(rc) END AS BIGINT) AS units, CAST(CASE WHEN contains(r, ' ') THEN word_errors ELSE char_errors END AS BIGINT) AS errors FROM err"""
    q["session_check"] = """WITH r AS (SELECT run_no, batches FROM retrieval_runs WHERE len(batches) > 0)
SELECT CAST(run_no AS VARCHAR) AS session_id, CAST(len(batches) + 1 AS BIGINT) AS results, array_to_string(list_transform(batches, lambda b: coalesce(b.hits[1].variant, '')), '') AS final_text, true AS prefix_grows, true AS deltas_add_up, true AS one_end FROM r"""
    q["session_lookahead"] = "SELECT CAST(run_no AS VARCHAR) AS session_id, CAST(16000 * len(batches) AS BIGINT) AS audio_samples, true AS sizes_fit FROM retrieval_runs WHERE len(batches) > 0"
    q["session_acoustic"] = "SELECT 'l' || label AS session_id, CAST(ceil(count(*) / 25.0) + 1 AS BIGINT) AS results, true AS heard, true AS bounded, true AS paths_bounded, true AS prompted FROM embeddings GROUP BY label"
    q["jsonl_lenient"] = "SELECT record_no % 7 <> 0 AS good, count(*) AS lines FROM manifest_raw GROUP BY 1"
    q["catalog_round_trip"] = "SELECT id, text, array_to_string(coalesce(aliases, []), ',') AS aliases, coalesce(language, '') AS language, coalesce(weight, 1.0) AS weight FROM hotwords WHERE catalog_version = (SELECT max(catalog_version) FROM hotwords)"
    q["manifest_round_trip"] = f"""WITH {_MAN} SELECT utt_id AS key, source, target, array_to_string(list_filter(ids, lambda x, i: list_position(ids, x) = i), ',') AS target_ids, count(*) AS copies
FROM man WHERE utt_id IS NOT NULL AND source IS NOT NULL AND target IS NOT NULL GROUP BY ALL"""
    q["word_lines"] = "SELECT 's' || (p_size % 3) AS source, p_name || ' ' || p_size AS value, count(*) AS lines FROM part GROUP BY ALL"
    q["decoded_rows"] = """SELECT run_no, round(final_batch.accumulated_audio_sec, 9) AS duration_sec, round(final_batch.accumulated_audio_sec * 0.25 / greatest(1e-9, final_batch.accumulated_audio_sec), 9) AS rtf,
  round(coalesce(len(batches), 0) / greatest(1, len(coalesce(utt_id, ''))), 9) AS revision_rate FROM retrieval_runs WHERE final_batch.accumulated_audio_sec IS NOT NULL"""
    q["contexts"] = """WITH r AS (SELECT run_no, list_filter(coalesce(target_hotword_ids, []), lambda x: x IS NOT NULL) AS ids FROM retrieval_runs)
SELECT run_no, CASE WHEN len(ids) > 0 THEN 'Talk.' || chr(10) || 'Hotwords: ' || array_to_string(ids, '; ') ELSE 'Talk.' END AS wanted,
  'Talk.' || chr(10) || 'Hotwords: ' || CASE WHEN len(ids) > 0 THEN array_to_string(ids, '; ') ELSE 'all; phrases' END AS enabled FROM r"""
    q["aligned_mentions"] = q["resolved_spans"].replace("SELECT w.record_no, w.variant", ", res AS (SELECT w.record_no, w.variant", 1) + """)
SELECT CAST(record_no AS VARCHAR) AS source_utt_id, CASE WHEN count(*) OVER (PARTITION BY record_no) > 1 THEN record_no || '__mention_m_' || record_no || '_' || first_item ELSE CAST(record_no AS VARCHAR) END AS utt_id,
  '#m ' || record_no || '/' || first_item AS mention, round_even(first_item * 0.1005::DOUBLE, 3) AS hotword_start_sec, round_even(first_item * 0.1005::DOUBLE + 0.5, 3) AS hotword_end_sec FROM res WHERE error IS NULL"""
    # The alignment is the table of costs row by row, then the way back: diagonal before deletion before insertion.
    q["partitioned_errors"] = f"""WITH RECURSIVE {_ERRORS},
u AS (SELECT utt_id, CASE WHEN contains(r, ' ') THEN rw ELSE list_transform(range(1, len(rc) + 1), lambda i: substr(rc, CAST(i AS INTEGER), 1)) END AS a,
  CASE WHEN contains(r, ' ') THEN hw ELSE list_transform(range(1, len(hc) + 1), lambda i: substr(hc, CAST(i AS INTEGER), 1)) END AS b, contains(r, ' ') AS w FROM err),
k AS (SELECT utt_id, list_distinct(flatten(list(CASE WHEN w THEN string_split(k, ' ') ELSE list_transform(range(1, len(k) + 1), lambda i: substr(k, CAST(i AS INTEGER), 1)) END))) AS units FROM each JOIN u USING (utt_id) GROUP BY utt_id),
t AS (SELECT utt_id, a, b, 0 AS i, CAST(range(0, len(b) + 1) AS INTEGER[]) AS cost, CAST([] AS INTEGER[][]) AS moves FROM u
  UNION ALL SELECT utt_id, a, b, i + 1, list_transform(m, lambda x, j: list_min(m[1:j]) + j), list_append(moves, list_transform(range(1, len(b) + 1), lambda j:
    CASE WHEN list_min(m[1:j + 1]) + j + 1 = cost[j] + CAST(b[j] <> a[i + 1] AS INTEGER) THEN 0 WHEN list_min(m[1:j + 1]) + j + 1 = cost[j + 1] + 1 THEN 1 ELSE 2 END))
  FROM (SELECT *, list_prepend(i + 1 - 1, list_transform(range(1, len(b) + 1), lambda j: least(cost[j] + CAST(b[j] <> a[i + 1] AS INTEGER), cost[j + 1] + 1) - CAST(j + 1 AS INTEGER))) AS m FROM t WHERE i < len(a))),
s0 AS (SELECT utt_id, a, b, moves, units FROM t JOIN k USING (utt_id) WHERE i = len(a)),
back AS (SELECT utt_id, len(a) AS i, len(b) AS j, 0 AS br, 0 AS be, 0 AS ur, 0 AS ue, a, b, moves, units FROM s0
  UNION ALL SELECT utt_id, i - CAST(mv < 2 AS INTEGER), j - CAST(mv <> 1 AS INTEGER), br + CAST(own AND mv < 2 AS INTEGER), be + CAST(own AND bad AS INTEGER), ur + CAST(NOT own AND mv < 2 AS INTEGER), ue + CAST(NOT own AND bad AS INTEGER), a, b, moves, units
  FROM (SELECT *, list_contains(units, CASE WHEN mv < 2 THEN a[i] ELSE b[j] END) AS own, CASE WHEN mv = 0 THEN a[i] <> b[j] ELSE true END AS bad
    FROM (SELECT *, CASE WHEN i = 0 THEN 2 WHEN j = 0 THEN 1 ELSE moves[i][j] END AS mv FROM back WHERE i > 0 OR j > 0)))
SELECT utt_id, CAST(br AS BIGINT) AS biased_ref, CAST(be AS BIGINT) AS biased_errors, CAST(ur AS BIGINT) AS unbiased_ref, CAST(ue AS BIGINT) AS unbiased_errors FROM back WHERE i = 0 AND j = 0"""
    q["partitioned_report"] = f"SELECT sum(biased_errors) / greatest(1, sum(biased_ref)) AS bwer, sum(unbiased_errors) / greatest(1, sum(unbiased_ref)) AS uwer FROM ({q['partitioned_errors']})"
    q["index_round_trip"] = "SELECT printf('h%d', label) AS hotword_id, printf('v%07d', vec_id) AS variant, CAST(len(embedding) AS INTEGER) AS dim, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings"
    q["append_resumed"] = "SELECT event_id, CAST(1 AS BIGINT) AS copies FROM events"
    q["wave_round_trip"] = "SELECT n_nationkey, 16000 AS rate, CAST(1600 + n_nationkey + 800 * (n_nationkey % 3) AS INTEGER) AS samples, CAST(800 * (n_nationkey % 3) AS INTEGER) AS silent, round((1600 + n_nationkey + 800 * (n_nationkey % 3)) / 16000.0::DOUBLE, 6) AS seconds FROM nation"
    q["tagged_transcripts"] = f"""SELECT CAST(p_partkey AS VARCHAR) AS utt_id, {_TAG} AS tagged, replace(p_name || p_brand || split_part(p_type, ' ', 1), ' ', '') AS transcript, p_brand AS first_entity,
  CAST(len(replace(p_name, ' ', '')) AS INTEGER) AS first_start, CAST(2 AS INTEGER) AS mentions FROM part"""
    q["audio_joined"] = "SELECT CAST(n_nationkey AS VARCHAR) AS utt_id, n_nationkey % 5 <> 0 AS has_audio FROM nation"
    q["training_candidates"] = """WITH n AS (SELECT list(text ORDER BY id) AS n FROM (SELECT id, text FROM hotwords ORDER BY id LIMIT 20)),
p AS (SELECT run_no, list_concat(list_filter(coalesce(list_transform(final_batch.hits, lambda h: h.variant), []), lambda x: x IS NOT NULL), n) AS a FROM retrieval_runs, n)
SELECT run_no, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), ',') AS candidates FROM p"""
    q["aligned_faults"] = """WITH a AS (SELECT CAST(user_id AS VARCHAR) AS u, CAST(event_id AS VARCHAR) AS m, CASE WHEN event_id % 11 = 0 THEN NULL ELSE 'h' || (event_id % 7) END AS h, event_id % 13 AS s, event_id % 17 AS e, event_id % 5 AS t FROM events WHERE event_id % 19 <> 0),
f AS (SELECT u, m, CASE WHEN h IS NULL THEN 'missing key' WHEN h NOT IN ('h0', 'h1', 'h2', 'h3', 'h4', 'h5') THEN 'unknown phrase' WHEN t = 0 THEN 'other targets' WHEN s >= e THEN 'invalid span' WHEN e > 15 THEN 'span beyond the audio' END AS fault FROM a)
SELECT u AS source_utt_id, m AS aligned_mention_id, fault FROM f WHERE fault IS NOT NULL UNION ALL SELECT CAST(user_id AS VARCHAR), CAST(event_id AS VARCHAR), 'missing' FROM events WHERE event_id % 19 = 0"""
    q["catalog_report"] = _ENTRIES + f""", hot AS (SELECT * FROM hotwords WHERE metadata::JSON->>'role' = 'evaluation_target'),
spell AS (SELECT DISTINCT id, s FROM (SELECT id, {norm('v')} AS s FROM (SELECT id, unnest(list_concat([text], coalesce(aliases, []))) AS v FROM hot) WHERE v IS NOT NULL) WHERE s <> ''),
tgt AS (SELECT id FROM hot WHERE id NOT IN (SELECT id FROM spell WHERE s IN (SELECT s FROM spell GROUP BY s HAVING count(DISTINCT id) > 1)))
SELECT 'target_records' AS name, count(*) AS value FROM tgt UNION ALL SELECT 'target_spellings', count(DISTINCT s) FROM spell WHERE id IN (SELECT id FROM tgt)
UNION ALL SELECT 'evaluation_manifest_records', count(*) FROM manifest_raw UNION ALL SELECT 'merged_unique_distractor_terms', count(*) FROM entries"""
    q["bootstrap_check"] = f"""WITH {_SCORES}, g AS (SELECT avg(recall_at_50 - recall_at_5) AS m FROM s WHERE gold > 0) SELECT round(m, 9) AS mean, true AS ordered, true AS as_wide_as_normal FROM g"""
    return {k: v for k, v in q.items() if v}

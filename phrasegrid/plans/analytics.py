"""Queries over catalogs, manifests, retrieval runs, transcripts, embeddings and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import common_prefix, match_text, nfkc_term, safe_id, script_term, stable_id
from ..operators import annotate, badrows, catalog, hooks, lattice, match, metrics, search
from ..runtime import fitting, hadoop_path, materialize, read, scratch_path
from ..sources import catalogs, readers, writers
from ..streaming import kernel, posteriors, retrieval, sessions
from . import records

NO_IDS = "array<string>"


# Catalogs


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """Merged word frequencies of all sources: text, source_frequencies, total_frequency."""
    lines = badrows.loaded(read(spark, d, "word_freq"), "value")
    return materialize(catalog.merge_sources(catalog.word_counts(lines)), "entries")


def _total():
    """As text: sums pass the range of bigint."""
    return F.col("total_frequency").cast("string").alias("total_frequency")


def _targets(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation targets whose spellings no other target shares."""
    hot = read(spark, d, "hotwords").where(F.get_json_object("metadata", "$.role") == "evaluation_target")
    shared = catalog.spellings(hot).groupBy("spelling").agg(F.count_distinct("id").alias("n")).where("n > 1")
    owners = catalog.spellings(hot).join(shared, "spelling").select("id").distinct()
    return hot.join(owners, "id", "left_anti")


def _transcripts(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "manifest_raw")
    return rows.select(annotate.first_filled(F.get_json_object("value", "$.target"), F.get_json_object("value", "$.text")).alias("text"))


def catalog_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Targets, then stratified distractors that nobody speaks, up to a catalog of 10,000 (or all that is left)."""
    return catalog.evaluation_catalog(_targets(spark, d), _entries(spark, d), _transcripts(spark, d), "text", 10_000, "eval-1", fill=False).select(
        "position", "id", "text", F.array_join("aliases", ",").alias("aliases"), "language", "weight"
    )


def catalog_negatives(spark: SparkSession, d: str) -> DataFrame:
    entries = _entries(spark, d)
    return catalog.negative_catalog(entries, min(10_000, entries.count())).select("id", "text", "metadata")


def word_freq_merged(spark: SparkSession, d: str) -> DataFrame:
    pairs = F.array_join(F.transform(F.map_entries("source_frequencies"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return _entries(spark, d).select("text", pairs.alias("sources"), _total())


def load_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = badrows.classify_lines(read(spark, d, "word_freq"), "value", keep_skipped=True)
    return catalog.load_stats(rows.select("source", F.col("__skipped").alias("skipped"), F.col("__reason").alias("reason"), F.col("__term").alias("term")))


def term_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "word_entries").select("entry_id", nfkc_term(F.col("text")).alias("term"))
    return rows.where(script_term(F.col("term")))


def spoken_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms of the word-frequency sources that stand in some document (whole texts)."""
    return catalog.spoken_terms(read(spark, d, "documents"), "text", _entries(spark, d))


def unspoken_terms(spark: SparkSession, d: str) -> DataFrame:
    entries = _entries(spark, d)
    return entries.join(catalog.spoken_terms(_transcripts(spark, d), "text", entries), "text", "left_anti").select("text", _total())


def transcript_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """All distinct substrings of 2 to 8 characters of transcripts, and the transcripts."""
    return catalog.ngrams(_transcripts(spark, d), "text", 2, 8)


def frequency_buckets(spark: SparkSession, d: str) -> DataFrame:
    return catalog.frequency_buckets(_entries(spark, d)).select("text", F.col("__rank").cast("bigint").alias("rank"), "bucket")


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    entries = _entries(spark, d)
    return catalog.select_stratified(entries, 200).select("text", _total(), "bucket")


def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "hotwords").select("id", stable_id("neg", nfkc_term(F.col("text"))).alias("stable_id"))


def negative_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return catalog.negative_vocabulary(read(spark, d, "word_freq"))


def shared_negatives(spark: SparkSession, d: str) -> DataFrame:
    vocabulary = read(spark, d, "hotwords").select(F.col("text").alias("term"))
    spoken = read(spark, d, "retrieval_runs").select(F.explode("final_batch.hits.variant").alias("term"))
    return catalog.shared_negatives(vocabulary, spoken, 4095, seed=1, epoch=2, step=3)


def local_positives(spark: SparkSession, d: str) -> DataFrame:
    """One substring of every transcript, the same in every run."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"record_no": pdf["record_no"], "positive": [catalog.local_positive(t, k, 0, 42) for k, t in zip(pdf["k"], pdf["t"])]})

    j = lambda n: F.get_json_object("value", f"$.{n}")
    key = F.coalesce(annotate.first_filled(j("key"), j("utt_id")), F.lit(""))
    rows = read(spark, d, "manifest_raw").select("record_no", key.alias("k"), nfkc_term(annotate.first_filled(j("target"), j("text"))).alias("t")).where("t <> ''")
    return rows.mapInPandas(run, "record_no bigint, positive string")


def spelling_variants(spark: SparkSession, d: str) -> DataFrame:
    hot = read(spark, d, "hotwords")
    v = catalog.text_variants(F.col("text"), F.col("aliases"), lambda x: F.trim(F.regexp_replace(F.lower(x), r"\s+", " ")))
    return hot.select("id", F.posexplode(catalog.tokenizer_variants(v)).alias("n", "variant"))


def unknown_targets(spark: SparkSession, d: str) -> DataFrame:
    """Ids that the manifest names and the catalog lacks."""
    ids = annotate.string_or_array(F.get_json_object("value", "$.target_hotword_ids"))
    rows = read(spark, d, "manifest_raw").select("record_no", annotate.target_ids(ids).alias("target_hotword_ids"))
    return catalog.unknown_targets(rows, read(spark, d, "hotwords")).select("record_no", "id")


def stale_hits(spark: SparkSession, d: str) -> DataFrame:
    """Ids of search hits that the catalog lacks, and their rows."""
    hits = read(spark, d, "search_hits").where(F.col("hotword_id").isNotNull()).groupBy("hotword_id").agg(F.count(F.lit(1)).alias("hits"))
    return hits.join(read(spark, d, "hotwords").select(F.col("id").alias("hotword_id")), "hotword_id", "left_anti")


def catalog_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Spellings last retrieved (by name) replace those of the catalog."""
    over = read(spark, d, "retrieval_runs").select(F.explode("final_batch.hits").alias("h")).where("h.hotword_id is not null and h.variant is not null")
    over = over.groupBy(F.col("h.hotword_id").alias("id")).agg(F.max("h.variant").alias("text"))
    return catalog.overlay(read(spark, d, "hotwords").select("id", "text"), over)


def duplicate_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts that several documents hold, by digest."""
    docs = read(spark, d, "documents").where(F.col("text").isNotNull()).select(F.sha2("text", 256).alias("digest"))
    return catalog.duplicates(docs, ["digest"])


# Manifests


def manifest_fields(spark: SparkSession, d: str) -> DataFrame:
    j = lambda n: F.get_json_object("value", f"$.{n}")
    return read(spark, d, "manifest_raw").select(
        "record_no",
        annotate.first_filled(j("key"), j("utt_id")).alias("key"),
        annotate.first_filled(j("source"), j("audio")).alias("source"),
        F.coalesce(j("target"), j("text")).alias("target"),
        F.array_join(annotate.target_ids(annotate.string_or_array(j("target_hotword_ids"))), ",").alias("target_ids"),
    )


def manifest_invalid(spark: SparkSession, d: str) -> DataFrame:
    rows = manifest_fields(spark, d)
    missing = F.when(F.col("key").isNull(), "key").when(F.col("source").isNull(), "source").when(F.col("target").isNull(), "target")
    return rows.select("record_no", missing.alias("missing")).where("missing is not null")


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    m = records.manifest(spark, d).table("mention")
    return m.select(F.col("root").alias("record_no"), "path", "hotword_id", "text", "entity_type", "char_start", "char_end")


def occurrence_index(spark: SparkSession, d: str) -> DataFrame:
    rows = annotate.occurrence_index(_mentions(spark, d), "record_no")
    return rows.select("record_no", "text", "char_start", F.col("occurrence_index").cast("int").alias("occurrence_index"))


def mention_stats(spark: SparkSession, d: str) -> DataFrame:
    return annotate.mention_stats(_mentions(spark, d)).select("text", F.array_join("entity_types", ",").alias("types"), "mention_count")


def marker_parse(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose bracketed marks parse or not: mentions, and the kind of error."""
    rows = annotate.parse_annotated(read(spark, d, "documents").select("doc_id", "text"), "text")
    kind = F.regexp_replace("error", "[^a-z]+(at [0-9]+)?", " ")
    return rows.groupBy(F.trim(kind).alias("error")).agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(F.size("mentions")), F.lit(0)).alias("mentions"))


def _spans(spark: SparkSession, d: str, mentions: DataFrame) -> DataFrame:
    items = F.transform(F.split("text", ""), lambda c, i: F.struct(c.alias("text"), (i / 10.0).alias("start_time"), ((i + 1) / 10.0).alias("end_time")))
    transcripts = _transcript_rows(spark, d).select("record_no", items.alias("items")).where("items is not null")
    wanted = mentions.where("text is not null").groupBy("record_no").agg(F.sort_array(F.collect_set("text")).alias("variants"))
    return annotate.find_spans(transcripts.join(wanted, "record_no"), ["record_no"]).select("record_no", "variant", "first_item", "last_item", "span_index")


def mention_spans(spark: SparkSession, d: str) -> DataFrame:
    """Every place of a mention's text among the characters of its transcript, a tenth of a second each."""
    return _spans(spark, d, _mentions(spark, d))


def resolved_spans(spark: SparkSession, d: str) -> DataFrame:
    mentions = materialize(_mentions(spark, d), "mentions")
    spans = _spans(spark, d, mentions).withColumns({"start_time": F.col("first_item") / 10.0, "end_time": (F.col("last_item") + 1) / 10.0}).drop("span_index")
    w = Window.partitionBy("record_no", "variant").orderBy("first_item")
    spans = materialize(spans.withColumn("span_index", F.row_number().over(w) - 1), "spans")
    wanted = annotate.occurrence_index(mentions, "record_no").select("record_no", F.col("text").alias("variant"), F.col("occurrence_index").cast("int").alias("occurrence_index"))
    wanted = wanted.where("variant is not null")
    return annotate.resolve_spans(spans, wanted, ["record_no", "variant"]).select("record_no", "variant", "occurrence_index", "first_item", "error")


def mention_ids(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("record_no").orderBy("char_start", "text")
    rows = _mentions(spark, d).withColumn("i", F.row_number().over(w) - 1)
    return annotate.mention_ids(rows, "record_no", "i").select("record_no", "char_start", "mention_id")


def aligned_faults(spark: SparkSession, d: str) -> DataFrame:
    """Events as aligned rows, of which some lack keys, name unknown phrases or other targets, or have spans that cannot be."""
    id_ = F.col("event_id")
    rows = read(spark, d, "events").select(
        F.col("user_id").cast("string").alias("source_utt_id"), id_.cast("string").alias("aligned_mention_id"), "event_id",
        F.when(id_ % 11 != 0, F.concat(F.lit("h"), id_ % 7)).alias("aligned_hotword_id"), (id_ % 13).cast("double").alias("hotword_start_sec"), (id_ % 17).cast("double").alias("hotword_end_sec"),
    )
    rows = rows.withColumn("target_hotword_ids", F.when(id_ % 5 == 0, F.array(F.lit("other"), F.lit("h1"))).otherwise(F.array("aligned_hotword_id")))
    known = spark.range(6).select(F.concat(F.lit("h"), F.col("id")).alias("id"))
    seconds = rows.select("source_utt_id").distinct().withColumn("seconds", F.lit(15.0))
    return annotate.check_aligned(rows.where("event_id % 19 <> 0"), rows.select("source_utt_id", "aligned_mention_id"), known, seconds)


def key_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """(utterance, phrase) pairs that the manifest expects and the runs lack, or the other way round, or doubled."""
    j = lambda n: F.get_json_object("value", f"$.{n}")
    ids = annotate.target_ids(annotate.string_or_array(j("target_hotword_ids")))
    expected = read(spark, d, "manifest_raw").select(annotate.first_filled(j("key"), j("utt_id")).alias("utt_id"), F.explode(ids).alias("hotword_id"))
    actual = read(spark, d, "retrieval_runs").select("utt_id", F.explode("target_hotword_ids").alias("hotword_id")).where("hotword_id is not null")
    return annotate.reconcile(expected, actual, ["utt_id", "hotword_id"])


def pending_utterances(spark: SparkSession, d: str) -> DataFrame:
    """Utterances with a target that no final batch has hit yet."""
    j = lambda n: F.get_json_object("value", f"$.{n}")
    ids = annotate.target_ids(annotate.string_or_array(j("target_hotword_ids")))
    source = read(spark, d, "manifest_raw").select(annotate.first_filled(j("key"), j("utt_id")).alias("utt_id"), F.explode(ids).alias("hotword_id"))
    done = read(spark, d, "retrieval_runs").select("utt_id", F.explode("final_batch.hits.hotword_id").alias("hotword_id"))
    return annotate.pending(source, done, ["utt_id", "hotword_id"], ["utt_id"])


def safe_ids(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "retrieval_runs").select("run_no", safe_id(F.concat_ws("#", "utt_id", "boundary_group")).alias("safe_id"))


def boundary_variants(spark: SparkSession, d: str) -> DataFrame:
    spans = read(spark, d, "events").select("event_id", ((F.col("event_id") % 97) / 8.0).alias("s")).withColumn("e", F.col("s") + 0.25 + (F.col("event_id") % 5) / 4.0)
    rows = annotate.boundary_variants(spans, 2.0, "s", "e")
    return rows.select("event_id", "boundary_group", *(F.round(c, 6).alias(c) for c in ("leading_silence_sec", "word_start_sec", "word_end_sec")))


def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Catalog written as JSON lines with sorted keys and read back under its schema."""
    path = scratch_path(spark, "catalog-jsonl")
    writers.write_jsonl(read(spark, d, "hotwords"), path)
    return readers.read_jsonl(spark, path, catalog.ENTRY).select("id", "text", F.array_join("aliases", ",").alias("aliases"), "weight", "metadata")


def index_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Embedding keys saved as an index and loaded again."""
    path = scratch_path(spark, "index")
    keys = read(spark, d, "embeddings").select(F.format_string("h%d", "label").alias("hotword_id"), F.format_string("v%07d", "vec_id").alias("variant"), F.col("embedding").alias("key"))
    search.save_index(keys, path, "v1")
    return search.load_index(spark, path).select("hotword_id", "variant", F.size("key").alias("dim"), F.round(F.col("key")[0].cast("double"), 6).alias("first"))


def append_resumed(spark: SparkSession, d: str) -> DataFrame:
    """Half of the events, then all of them, appended to one output, and once more: each stands there once."""
    path = scratch_path(spark, "appended")
    events = read(spark, d, "events").select("event_id", "ts")
    counts = [writers.append_new(part, path, ["event_id"]) for part in (events.where("event_id % 2 = 0"), events, events)]
    if counts[2]:
        raise ValueError(f"{counts[2]} rows were appended again")
    return spark.read.parquet(path).groupBy("event_id").agg(F.count(F.lit(1)).alias("copies"))


def _tone(n: int) -> bytes:
    import io
    import wave

    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((1, 2, 16000, 0, "NONE", ""))
        w.writeframes((1000).to_bytes(2, "little") * n)
    return out.getvalue()


def wave_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A recording for every nation, with silence put before it, decoded."""
    import pandas as pd

    def tones(n: pd.Series) -> pd.Series:
        return n.map(lambda k: _tone(1600 + int(k)))

    tones.__annotations__ = {"n": pd.Series, "return": pd.Series}
    rows = read(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") % 3 * 0.05).alias("s"))
    files = rows.withColumn("content", F.pandas_udf(tones, "binary")(F.col("n_nationkey")))
    heard = readers.waves(writers.silenced(files, "content", "s"))
    silent = F.size(F.filter("samples", lambda x: x == 0))
    return heard.select("n_nationkey", "rate", F.size("samples").alias("samples"), silent.alias("silent"), F.round("seconds", 6).alias("seconds"))


def audio_joined(spark: SparkSession, d: str) -> DataFrame:
    """Utterances (one a nation) and the recordings that lie in a folder by their names; every fifth has none."""
    folder = scratch_path(spark, "audio")
    for k in [r[0] for r in read(spark, d, "nation").select("n_nationkey").where("n_nationkey % 5 <> 0").limit(100).collect()]:
        where, files = hadoop_path(spark, f"{folder}/part{k % 2}/{k}.wav")
        out = files.create(where)
        out.write(bytearray(_tone(16)))
        out.close()
    rows = read(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("utt_id"))
    return readers.with_audio(rows, readers.file_index(spark, folder), "utt_id").select("utt_id", F.col("path").isNotNull().alias("has_audio"))


def tagged_transcripts(spark: SparkSession, d: str) -> DataFrame:
    """Parts as lines of tagged text, written, read and parsed."""
    path = scratch_path(spark, "tagged")
    tagged = F.concat("p_name", F.lit(" ["), "p_brand", F.lit("]("), F.split("p_type", " ")[0], F.lit(")"))
    read(spark, d, "part").select(F.concat_ws(" ", F.col("p_partkey").cast("string"), tagged).alias("value")).write.text(path)
    rows = annotate.parse_annotated(readers.read_tagged(spark, path), "tagged")
    first = F.col("mentions")[0]
    return rows.select("utt_id", "tagged", "transcript", first["text"].alias("first_entity"), first["char_start"].alias("first_start"), F.size("mentions").alias("mentions"))


def catalog_report(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the report that goes with the evaluation catalog, written as JSON and read back."""
    path = scratch_path(spark, "report") + ".json"
    report = catalog.catalog_report(_targets(spark, d), read(spark, d, "manifest_raw"), _entries(spark, d), load_stats(spark, d), purpose="evaluation", seed=42)
    writers.write_report(spark, path, report)
    counts = [k for k, v in report.items() if k.startswith(("target_", "evaluation_", "merged_"))]
    back = spark.read.option("multiLine", "true").json(path)
    return back.select(F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.col(k).alias("value")) for k in counts))).alias("e")).select("e.*")


def jsonl_lenient(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the manifest, every seventh cut short, read leniently: how many are good, and how many are kept as raw text."""
    lines = read(spark, d, "manifest_raw").select(F.when(F.col("record_no") % 7 == 0, F.expr("substring(value, 1, length(value) - 1)")).otherwise(F.col("value")).alias("value"))
    rows = readers.parse_jsonl(lines, "value", T.StructType([T.StructField("key", T.StringType()), T.StructField("text", T.StringType())]), strict=False)
    return rows.groupBy(F.col("_corrupt_record").isNull().alias("good")).agg(F.count(F.lit(1)).alias("lines"))


def catalog_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Catalog written as JSON lines and read with its checks and defaults."""
    path = scratch_path(spark, "catalog-checked")
    hot = read(spark, d, "hotwords")
    version = hot.agg(F.max("catalog_version")).first()[0]  # a catalog has one
    writers.write_jsonl(hot.where(F.col("catalog_version") == version), path)
    return catalogs.read_catalog(spark, path).select("id", "text", F.array_join("aliases", ",").alias("aliases"), "language", "weight")


def manifest_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Complete manifest lines written as text and read under either spelling of their fields."""
    path = scratch_path(spark, "manifest-lines")
    good = read(spark, d, "manifest_raw").join(manifest_invalid(spark, d).select("record_no"), "record_no", "left_anti")
    good.select("value").write.text(path)
    rows = catalogs.read_manifest(spark, path)
    return rows.groupBy("key", "source", "target", F.array_join("target_hotword_ids", ",").alias("target_ids")).agg(F.count(F.lit(1)).alias("copies"))


def word_lines(spark: SparkSession, d: str) -> DataFrame:
    """Names of parts as several named text sources."""
    paths = {f"s{k}": scratch_path(spark, f"words-{k}") for k in range(3)}
    for k, path in enumerate(paths.values()):
        read(spark, d, "part").where(F.col("p_size") % 3 == k).select(F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("value")).write.text(path)
    return readers.read_word_lines(spark, paths).groupBy("source", "value").agg(F.count(F.lit(1)).alias("lines"))


def decoded_rows(spark: SparkSession, d: str) -> DataFrame:
    """Output columns of decoded runs: seconds, real-time factor, revisions a character."""
    sec = F.col("final_batch.accumulated_audio_sec")
    rows = read(spark, d, "retrieval_runs").where("final_batch.accumulated_audio_sec is not null").select(
        "run_no", (sec * 16000).alias("samples"), (sec * 0.25).alias("elapsed"), F.size(F.coalesce("batches", F.slice("batches", 1, 0))).alias("revisions"), "utt_id"
    )
    out = hooks.decode_projection(rows.withColumn("revisions", F.greatest("revisions", F.lit(0))), "elapsed", "samples", "revisions", F.coalesce("utt_id", F.lit("")))
    return out.select("run_no", *(F.round(c, 9).alias(c) for c in ("duration_sec", "rtf", "revision_rate")))


def contexts(spark: SparkSession, d: str) -> DataFrame:
    """What a decoder is told of each run: the phrases wanted, or the first of the catalog where none is."""
    ids = F.filter(F.coalesce("target_hotword_ids", F.array().cast(NO_IDS)), lambda x: x.isNotNull())
    rows = read(spark, d, "retrieval_runs").select("run_no", ids.alias("ids"))
    both = [("wanted", F.col("ids")), ("enabled", hooks.enabled_or_all(F.col("ids"), F.array(F.lit("all"), F.lit("phrases"))))]
    return rows.select("run_no", *(hooks.render_context(F.lit("Talk."), c).alias(n) for n, c in both))


def aligned_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Records of resolved mentions, one an occurrence: own names where a record has several, times in milliseconds."""
    rows = resolved_spans(spark, d).where("error is null")
    n = F.count(F.lit(1)).over(Window.partitionBy("record_no"))
    rows = rows.select(
        F.col("record_no").cast("string").alias("source_utt_id"), F.concat(F.lit("#m "), F.col("record_no"), F.lit("/"), F.col("first_item")).alias("mention"), n.alias("n"),
        (F.col("first_item") * 0.1005).alias("start_time"), (F.col("first_item") * 0.1005 + 0.5).alias("end_time"),
    )
    out = annotate.aligned_records(rows, "source_utt_id", "mention", "n")
    return out.select("source_utt_id", "utt_id", "mention", F.round("hotword_start_sec", 3).alias("hotword_start_sec"), F.round("hotword_end_sec", 3).alias("hotword_end_sec"))


# Matching


def _patterns(spark: SparkSession, d: str) -> DataFrame:
    hot = read(spark, d, "hotwords")
    return hot.select("id", F.explode(F.concat(F.array("text"), F.coalesce("aliases", F.array().cast(NO_IDS)))).alias("pattern"))


def phrase_matches(spark: SparkSession, d: str) -> DataFrame:
    """How often every catalog phrase stands in documents, over whole texts: an n-gram equi-join."""
    found = match.ngram_matches(read(spark, d, "documents"), "doc_id", "text", _patterns(spark, d))
    return found.groupBy("id").agg(F.count(F.lit(1)).alias("matches"), F.count_distinct("doc_id").alias("documents"))


def phrase_matches_automaton(spark: SparkSession, d: str) -> DataFrame:
    """The same by a broadcast automaton (the catalog table has a fixed 10,000 rows)."""
    pats = _patterns(spark, d).select("id", match_text(F.col("pattern")).alias("p")).where("p <> ''").distinct()
    pats = fitting(pats, "the automaton's phrases").collect()
    found = match.automaton_matches(read(spark, d, "documents"), "doc_id", "text", [(r.id, r.p) for r in pats])
    return found.groupBy("id").agg(F.count(F.lit(1)).alias("matches"), F.count_distinct("doc_id").alias("documents"))


def transcript_matches(spark: SparkSession, d: str) -> DataFrame:
    """Longest catalog phrase at every place of every transcript."""
    found = match.longest_matches(match.ngram_matches(_transcript_rows(spark, d), "record_no", "text", _patterns(spark, d)), "record_no")
    return found.select("record_no", "id", F.col("start").cast("int").alias("start"), "length")


def _transcript_rows(spark: SparkSession, d: str) -> DataFrame:
    text = annotate.first_filled(F.get_json_object("value", "$.target"), F.get_json_object("value", "$.text"))
    return read(spark, d, "manifest_raw").select("record_no", text.alias("text"))


def lattice_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as posterior frames (log softmax over 64 symbols) of one session a label; phrases are pairs of symbols."""
    automaton = match.Automaton()
    for i in range(1, 63):
        automaton.add((f"s{i}", f"s{i + 1}"), f"p{i:02d}")
    found = lattice.lattice_matches(_posteriors(spark, d), automaton.freeze(), [f"s{i}" for i in range(64)], 0, least=0.02)
    return found.select("session_id", "chunk_id", "kind", "phrase", F.round("confidence", 9).alias("confidence"), "start_frame")


def _posteriors(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings of a label as the frames of a session, 25 a chunk."""
    rows = read(spark, d, "embeddings").withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1)
    scaled = F.transform("embedding", lambda x: x.cast("double") * 12)
    total = F.log(F.aggregate(F.transform(scaled, F.exp), F.lit(0.0), lambda a, x: a + x))
    frames = rows.select(F.concat(F.lit("l"), F.col("label")).alias("session_id"), F.floor(F.col("n") / 25).cast("int").alias("chunk_id"), "n", F.transform(scaled, lambda x: x - total).alias("row"))
    return frames.groupBy("session_id", "chunk_id").agg(F.min("n").alias("frame_offset"), F.transform(F.sort_array(F.collect_list(F.struct("n", "row"))), lambda r: r["row"]).alias("log_probs"))


# Search


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select("vec_id", "label", search.l2_normalize(F.col("embedding")).alias("v"))


def vector_top10(spark: SparkSession, d: str) -> DataFrame:
    """The 10 nearest of all vectors for every vector whose id is divisible by 50."""
    v = _vectors(spark, d)
    frames = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.lit(0).alias("frame"), F.col("v").alias("vec"))
    keys = v.select(F.format_string("k%07d", "vec_id").alias("hotword_id"), F.lit("").alias("variant"), F.col("v").alias("key"))
    return search.search_blocks(frames, keys, ["query"], 10).select("query", "hotword_id", "score", "rank")


def phrase_search(spark: SparkSession, d: str) -> DataFrame:
    """Labels as phrases with many variants, utterances of several frames: greatest over frames, best variant, top 5."""
    v = _vectors(spark, d)
    frames = v.where("vec_id % 50 = 0").select(F.expr("vec_id div 200").alias("utt"), F.expr("int(vec_id % 200)").alias("frame"), F.col("v").alias("vec"))
    keys = v.select(F.format_string("h%d", "label").alias("hotword_id"), F.format_string("v%07d", "vec_id").alias("variant"), F.col("v").alias("key"))
    return search.search_blocks(frames, keys, ["utt"], 5)


def accumulated_search(spark: SparkSession, d: str) -> DataFrame:
    """The same after every chunk of an utterance, over all its frames so far."""
    v = _vectors(spark, d)
    frames = v.where("vec_id % 50 = 0").select(
        F.expr("vec_id div 500").alias("utt"), F.expr("int((vec_id % 500) div 100)").alias("chunk"), F.expr("int(vec_id % 500)").alias("frame"), F.col("v").alias("vec")
    )
    keys = v.select(F.format_string("h%d", "label").alias("hotword_id"), F.format_string("v%07d", "vec_id").alias("variant"), F.col("v").alias("key"))
    return search.search_blocks(frames, keys, ["utt", "chunk"], 3, growing=True)


def retrieval_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same as streams, two frames a block: the refreshes at the boundaries, without the last one that repeats the end."""
    v = _vectors(spark, d)
    rows = v.where("vec_id % 50 = 0").select(F.expr("vec_id div 500").cast("string").alias("stream"), F.expr("vec_id % 500").alias("seq"), F.lit(1).alias("n_samples"), F.array("v").alias("frames"))
    keys = v.select(F.format_string("h%d", "label").alias("hotword_id"), F.format_string("v%07d", "vec_id").alias("variant"), F.col("v").alias("key"))
    found = retrieval.replay(rows, keys, 2, 1, 3)
    return found.select(F.col("stream").cast("bigint").alias("utt"), F.col("chunk_id").alias("chunk"), "hotword_id", "score", "rank", (F.col("peak_frame") * 50).alias("peak_frame"), "variant").distinct()


def utterance_top50(spark: SparkSession, d: str) -> DataFrame:
    """Best 50 phrases of an utterance over all its refreshes: greatest score, its first frame, ties by id."""
    rows = read(spark, d, "search_hits").where("hotword_id is not null and score is not null and not isnan(score)")
    best = rows.groupBy("utt_id", "hotword_id").agg(F.max(F.struct("score", (-F.col("peak_frame")).alias("f"))).alias("b"))
    w = Window.partitionBy("utt_id").orderBy(F.col("b.score").desc(), "hotword_id")
    ranked = best.withColumn("rank", F.row_number().over(w)).where("rank <= 50")
    return ranked.select("utt_id", "hotword_id", F.col("b.score").alias("score"), "rank")


# Metrics


def _hit_scores(spark: SparkSession, d: str) -> DataFrame:
    return metrics.hit_scores(read(spark, d, "retrieval_runs"), ["run_no", "boundary_group"])


def retrieval_scores(spark: SparkSession, d: str) -> DataFrame:
    return _hit_scores(spark, d).select("run_no", "gold", "recall_at_1", "recall_at_5", "precision_at_5", "reciprocal_rank", "first_top50_chunk")


def retrieval_report(spark: SparkSession, d: str) -> DataFrame:
    return metrics.retrieval_report(_hit_scores(spark, d))


def recall_by_boundary(spark: SparkSession, d: str) -> DataFrame:
    rows = _hit_scores(spark, d).where("gold > 0")
    return rows.groupBy(metrics.boundary(F.col("boundary_group")).alias("boundary")).agg(F.count(F.lit(1)).alias("utterances"), F.avg("recall_at_50").alias("recall"))


def _times(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "retrieval_runs").select(F.explode("batches").alias("b")).select(F.explode("b.timings_ms").alias("name", "value"))


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return metrics.exact_percentiles(_times(spark, d), ["name"], "value", {"p50": 0.5, "p95": 0.95})


def streaming_report(spark: SparkSession, d: str) -> DataFrame:
    runs = read(spark, d, "retrieval_runs")
    times = F.filter(F.transform("batches", lambda b: b["timings_ms"]["encode_ms"]), metrics.finite)
    return metrics.streaming_aggregates(runs.select(times.alias("chunk_processing_ms"), "rtf", F.col("peak_memory_mb").alias("gpu_memory_mb")))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Last manifest record and last run of an utterance: transcript, what was retrieved, the phrases wanted."""
    runs = metrics.last_by_key(read(spark, d, "retrieval_runs").where("utt_id is not null"), ["utt_id"], ["logged_at", "run_no"])
    j = lambda n: F.get_json_object("value", f"$.{n}")
    man = read(spark, d, "manifest_raw").select(annotate.first_filled(j("key"), j("utt_id")).alias("utt_id"), F.coalesce(j("target"), j("text")).alias("reference"), "received_at", "record_no")
    man = metrics.last_by_key(man.where("utt_id is not null and reference is not null"), ["utt_id"], ["received_at", "record_no"])
    hits = F.array_join(F.transform(F.coalesce("final_batch.hits", F.slice("final_batch.hits", 1, 0)), lambda h: h["variant"]), " ")
    hot = read(spark, d, "hotwords").select(F.col("id"), F.col("text").alias("w"))
    wanted = runs.select("utt_id", F.explode("target_hotword_ids").alias("id")).join(hot, "id").groupBy("utt_id").agg(F.sort_array(F.collect_set("w")).alias("hotwords"))
    pairs = man.select("utt_id", "reference").join(runs.select("utt_id", F.coalesce(hits, F.lit("")).alias("hypothesis"), "boundary_group", "rtf"), "utt_id")
    return materialize(pairs.join(wanted, "utt_id", "left"), "pairs")


def keyword_counts(spark: SparkSession, d: str) -> DataFrame:
    return metrics.keyword_counts(_pairs(spark, d), ["utt_id"])


def transcript_report(spark: SparkSession, d: str) -> DataFrame:
    return metrics.transcript_report(_pairs(spark, d), ["utt_id"])


def partitioned_errors(spark: SparkSession, d: str) -> DataFrame:
    return metrics.partitioned_errors(_pairs(spark, d), ["utt_id"])


def partitioned_report(spark: SparkSession, d: str) -> DataFrame:
    return metrics.partitioned_report(metrics.partitioned_errors(_pairs(spark, d), ["utt_id"]))


def part_name_errors(spark: SparkSession, d: str) -> DataFrame:
    """Character errors between the names of a part and the next one."""
    rows = read(spark, d, "part").select("p_partkey", F.col("p_name").alias("reference"), F.lead("p_name").over(Window.partitionBy("p_size").orderBy("p_partkey")).alias("hypothesis"))
    return metrics.edit_counts(rows.where("hypothesis is not null")).select("p_partkey", "char_errors", "ref_chars", "ref_words")


def paired_rtf(spark: SparkSession, d: str) -> DataFrame:
    """Real-time factor of each run less that of the last run logged for its utterance."""
    runs = read(spark, d, "retrieval_runs").select("run_no", "utt_id", "rtf", "logged_at")
    return metrics.paired_differences(runs.select("run_no", "utt_id", "rtf"), runs, ["utt_id"], ["logged_at", "run_no"], "rtf").select("run_no", "utt_id", "difference")


def partition_totals(spark: SparkSession, d: str) -> DataFrame:
    """What partitioned errors add up to: the units of the reference, and its edit distance."""
    rows = metrics.partitioned_errors(_pairs(spark, d), ["utt_id"])
    return rows.select("utt_id", (F.col("biased_ref") + F.col("unbiased_ref")).alias("units"), (F.col("biased_errors") + F.col("unbiased_errors")).alias("errors"))


def bootstrap_check(spark: SparkSession, d: str) -> DataFrame:
    """The interval's mean, whether it lies between the bounds, and whether these are as far apart as under the normal law, to a
    quarter: few gains differ from 0, so the bounds themselves are skewed."""
    gains = _hit_scores(spark, d).where("gold > 0").select((F.col("recall_at_50") - F.col("recall_at_5")).alias("g"))
    error = gains.select(F.lit("error").alias("name"), "g").groupBy("name").agg((F.stddev_samp("g") / F.sqrt(F.count("g"))).alias("value"))
    bounds = bootstrap_recall(spark, d)
    named = bounds.select(F.explode(F.create_map(*(x for c in bounds.columns for x in (F.lit(c), F.col(c))))).alias("name", "value")).unionByName(error)
    one = named.agg(*(F.max(F.when(F.col("name") == c, F.col("value"))).alias(c) for c in ("mean", "low", "high", "error")))
    width = (F.col("high") - F.col("low")) / (2 * 1.96 * F.col("error"))
    return one.select(F.round("mean", 9).alias("mean"), ((F.col("low") <= F.col("mean")) & (F.col("mean") <= F.col("high"))).alias("ordered"), width.between(0.75, 1.25).alias("as_wide_as_normal"))


def bootstrap_recall(spark: SparkSession, d: str) -> DataFrame:
    """Interval of the mean gain of recall at 50 over recall at 5."""
    rows = _hit_scores(spark, d).where("gold > 0").select("run_no", (F.col("recall_at_50") - F.col("recall_at_5")).alias("gain"))
    return metrics.bootstrap_ci(rows, "gain", "run_no")


def run_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.run_metrics(read(spark, d, "retrieval_runs"))


def release_gates(spark: SparkSession, d: str) -> DataFrame:
    """Gates over all measurements; the gain is that of recall at 50 over recall at 5 of the same record, with its interval."""
    gain = bootstrap_recall(spark, d).select(F.explode(F.create_map(F.lit("recall_gain"), F.col("mean"), F.lit("recall_gain_low"), F.col("low"))).alias("name", "value"))
    return metrics.verdict(run_metrics(spark, d).unionByName(gain))


# Streams


def tumbling_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = sessions.tumbling_chunks(read(spark, d, "events"), ["user_id"], ["ts", "event_id"], 16)
    return rows.groupBy("user_id", "chunk_id").agg(F.count(F.lit(1)).alias("events"), F.min("event_id").alias("first_id"), F.round(F.sum("value"), 4).alias("total"))


def accumulated_refreshes(spark: SparkSession, d: str) -> DataFrame:
    """Events as pieces of 100 to 1,000 samples of a user's stream, refreshed every 4,000 samples."""
    rows = read(spark, d, "events").select("user_id", "event_id", (100 + F.col("event_id") * 37 % 901).alias("n"))
    return sessions.refreshes(rows, ["user_id"], "event_id", "n", 4000).select("user_id", "event_id", "chunk_id", "sample_count", "is_final")


def revision_prefix(spark: SparkSession, d: str) -> DataFrame:
    """How much of the hit list of a batch stays in the next one, from the top."""
    rows = read(spark, d, "retrieval_runs").select("run_no", F.posexplode("batches").alias("i", "b")).where("b is not null and b.hits is not null")
    ids = F.transform("b.hits", lambda h: h["hotword_id"])
    w = Window.partitionBy("run_no").orderBy("i")
    rows = rows.select("run_no", "i", ids.alias("ids"), F.lag(ids).over(w).alias("before")).where("before is not null")
    return rows.select("run_no", "i", common_prefix(F.col("before"), F.col("ids")).alias("kept"), (F.size("before") - common_prefix(F.col("before"), F.col("ids"))).alias("revised"))


def rollback_starts(spark: SparkSession, d: str) -> DataFrame:
    """The rollback rule over line items as (committed, tokens, anchor, chunk)."""
    l = read(spark, d, "lineitem")  # noqa: E741
    count = F.col("l_quantity").cast("int") + F.col("l_linenumber")
    anchor = F.when(F.col("l_partkey") % 3 > 0, (F.col("l_partkey") % 60).cast("int"))
    chunk = (F.col("l_suppkey") % 5).cast("int")
    start = sessions.rollback_column(F.col("l_linenumber"), count, anchor, chunk)
    return l.select("l_orderkey", "l_linenumber", start.cast("int").alias("rollback_start"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Growing hypotheses: after each batch of a run, the best phrases of its batches so far; control rows every 50th run."""
    rows = read(spark, d, "retrieval_runs").where("size(batches) > 0").select("run_no", "batches", "target_hotword_ids")
    words = F.transform("batches", lambda b: F.coalesce(F.get(b["hits"], 0)["variant"], F.lit("")))
    rows = rows.select(F.col("run_no").cast("string").alias("session_id"), words.alias("w"), F.posexplode("batches").alias("i", "b"), "run_no", "target_hotword_ids")
    ids = F.filter(F.coalesce("target_hotword_ids", F.array().cast(NO_IDS)), lambda x: x.isNotNull())
    return rows.select(
        "session_id", F.col("i").cast("bigint").alias("seq"), F.array_join(F.slice("w", 1, F.col("i") + 1), "").alias("hypothesis"), F.lit(16000).cast("bigint").alias("n_samples"),
        F.when((F.col("run_no") % 50 == 0) & (F.col("i") == 1), ids).alias("enabled"), (F.col("i") == F.size("w") - 1).alias("end"),
    )


def _session_catalog(spark: SparkSession, d: str) -> kernel.Catalog:
    rows = read(spark, d, "hotwords").select("id", "text", "aliases", "weight").where("id is not null and text is not null")
    rows = fitting(rows, "the sessions' catalog").collect()
    seen = {r.id: r.asDict() for r in rows}
    # A control row may name ids the catalog no longer has; those are kept out of filters.
    return kernel.Catalog.build(list(seen.values()), sessions.folded)


def _known(rows: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    """Control rows keep the ids that the catalog has."""
    control = rows.where("enabled is not null")
    ids = control.select("session_id", "seq", F.explode("enabled").alias("id")).join(read(spark, d, "hotwords").select("id"), "id", "left_semi")
    kept = ids.groupBy("session_id", "seq").agg(F.sort_array(F.collect_set("id")).alias("__e"))
    wide = control.join(kept, ["session_id", "seq"], "left").withColumn("enabled", F.coalesce("__e", F.array().cast(NO_IDS))).select(*rows.columns)
    return rows.where("enabled is null").unionByName(wide)


def session_replay(spark: SparkSession, d: str) -> DataFrame:
    out = sessions.replay(_known(_chunks(spark, d), spark, d), _session_catalog(spark, d), kernel.Policy())
    return _session_columns(out)


def _session_columns(out: DataFrame) -> DataFrame:
    return out.select(
        "session_id", "seq", "chunk_id", "stable_text", "committed_delta", F.array_join("active_ids", ",").alias("active"), F.array_join("confirmed_ids", ",").alias("confirmed"),
        "rollback_start", "revisions", "is_final",
    )


def session_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same sessions as a stream of files, with keyed state and a trace sink; the trace read back."""
    path = scratch_path(spark, "chunks")
    _known(_chunks(spark, d), spark, d).repartition(2).write.parquet(path)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
        trace, checkpoint = scratch_path(spark, "trace"), scratch_path(spark, "stream-state")
        query = sessions.write_trace(sessions.stream(rows, _session_catalog(spark, d), kernel.Policy()), trace, checkpoint)
        query.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    lines = spark.read.option("recursiveFileLookup", "true").text(f"{trace}/*")
    return _session_columns(lines.select(F.from_json("value", sessions.RESULT).alias("r")).select("r.*"))


def session_check(spark: SparkSession, d: str) -> DataFrame:
    """Per session: results, its last text, and whether what is committed only grows, adds up to that text, and ends once."""
    w = Window.partitionBy("session_id").orderBy("seq", "is_final")
    rows = session_replay(spark, d).withColumn("before", F.coalesce(F.lag("stable_text").over(w), F.lit("")))
    ordered = F.sort_array(F.collect_list(F.struct("seq", "is_final", "committed_delta")))
    last = F.max(F.when(F.col("is_final"), F.col("stable_text")))
    sums = rows.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("results"), last.alias("final_text"), F.every(F.col("stable_text").startswith(F.col("before"))).alias("prefix_grows"),
        (F.array_join(F.transform(ordered, lambda x: x["committed_delta"]), "") == last).alias("deltas_add_up"), (F.count_if("is_final") == 1).alias("one_end"),
    )
    return sums


def session_lookahead(spark: SparkSession, d: str) -> DataFrame:
    """The same sessions, with chunks that wait for 200 ms more while a candidate is neither likely nor unlikely: all sound is
    processed, in chunks of one size or the other but for the last."""
    policy = kernel.Policy(lookahead_samples=3200)
    out = sessions.replay(_known(_chunks(spark, d), spark, d), _session_catalog(spark, d), policy).where("not is_final")
    w = Window.partitionBy("session_id").orderBy("chunk_id")
    rows = out.select("session_id", "audio_samples", (F.col("audio_samples") - F.coalesce(F.lag("audio_samples").over(w), F.lit(0))).alias("n"), F.lead("chunk_id").over(w).isNull().alias("last"))
    return rows.groupBy("session_id").agg(F.max("audio_samples").alias("audio_samples"), F.every(F.col("n").isin(16000, 19200) | F.col("last")).alias("sizes_fit"))


def session_acoustic(spark: SparkSession, d: str) -> DataFrame:
    """Sessions without text: candidates come from posterior frames alone (see ``lattice_evidence``)."""
    phrases = [{"id": f"p{i:02d}", "text": f"phrase {i}", "weight": 1.0, "paths": [[f"s{i}", f"s{i + 1}"]]} for i in range(1, 63)]
    rows = _posteriors(spark, d)
    last = Window.partitionBy("session_id")
    rows = rows.select(
        "session_id", F.col("chunk_id").cast("bigint").alias("seq"), F.lit("").alias("hypothesis"), F.lit(16000).cast("bigint").alias("n_samples"), F.lit(None).cast(NO_IDS).alias("enabled"),
        (F.col("chunk_id") == F.max("chunk_id").over(last)).alias("end"), "log_probs",
    )
    sounds = posteriors.Sounds(tuple(f"s{i}" for i in range(64)), 0, {"least": 0.02})
    out = sessions.replay(rows, kernel.Catalog.build(phrases, sessions.folded), kernel.Policy(enter=0.02, leave=0.01), sounds)
    heard = F.size("active_ids") + F.size("confirmed_ids")
    return out.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("results"), (F.max(heard) > 0).alias("heard"), F.every(heard <= 20).alias("bounded"), F.every(F.col("open_paths") <= 256).alias("paths_bounded"),
        F.every((F.col("prompt") == "") | F.col("prompt").startswith("Hotwords: phrase ")).alias("prompted"),
    )


def audio_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Final audio of every run cut into pieces of 100 ms at 16 kHz."""
    rows = read(spark, d, "retrieval_runs").where("final_batch.accumulated_audio_sec > 0")
    total = F.rint(F.col("final_batch.accumulated_audio_sec") * 16000).cast("bigint")
    return rows.select("run_no", F.explode(readers.pieces(total, 1600)).alias("p")).select("run_no", "p.seq", "p.start", "p.n")


def entity_types(spark: SparkSession, d: str) -> DataFrame:
    """Mentions and records per entity type."""
    return _mentions(spark, d).groupBy("entity_type").agg(F.count(F.lit(1)).alias("mentions"), F.count_distinct("record_no").alias("records"))


def entity_records(spark: SparkSession, d: str) -> DataFrame:
    """Manifest records with at least one mention."""
    return read(spark, d, "manifest_raw").select("record_no", "shard").join(_mentions(spark, d).select("record_no").distinct(), "record_no", "left_semi")


def pronunciations(spark: SparkSession, d: str) -> DataFrame:
    paths = hooks.pronunciation_paths(F.col("metadata"), F.col("text"))
    return read(spark, d, "hotwords").select("id", F.posexplode(paths).alias("n", "path")).select("id", "n", F.array_join("path", " ").alias("path"))


def training_batches(spark: SparkSession, d: str) -> DataFrame:
    """Records of every shard in the shuffled order of one epoch, in batches of 48."""
    rows = read(spark, d, "manifest_raw").select("record_no", "shard")
    return hooks.batch_numbers(rows, [hooks.epoch_order("record_no", 42, 1)], 48, ["shard"])


def training_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Phrases a run is trained against: what it hit, then shared negatives that it did not hit."""
    shared = [r[0] for r in read(spark, d, "hotwords").orderBy("id").limit(20).select("text").collect()]
    hits = F.transform("final_batch.hits", lambda h: h["variant"])
    return read(spark, d, "retrieval_runs").select("run_no", F.array_join(hooks.ordered_union(hits, F.array(*map(F.lit, shared))), ",").alias("candidates"))


def positive_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Batches of a run and phrases of the catalog that spell their best hit alike."""
    hits = read(spark, d, "retrieval_runs").select("run_no", F.get("final_batch.hits", F.lit(0))["variant"].alias("text")).where("text is not null")
    return hooks.equal_pairs(hits, read(spark, d, "hotwords").select("text", "id"), "text", "run_no", "id")


def overlapped_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of final audio that begin 200 ms early."""
    return hooks.left_overlap(audio_pieces(spark, d), ["run_no"], "start", 3200).select("run_no", "seq", "from", "overlap")


def hotword_languages(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "hotwords").groupBy(hooks.language_name(F.col("language"), "zh").alias("language")).agg(F.count(F.lit(1)).alias("phrases"))


def queries():
    names = (
        catalog_evaluation, catalog_negatives, word_freq_merged, load_stats, term_filter, spoken_terms, unspoken_terms, transcript_ngrams, frequency_buckets,
        stratified_sample, stable_ids, negative_vocabulary, shared_negatives, local_positives, spelling_variants, unknown_targets, stale_hits, catalog_overlay,
        duplicate_texts, manifest_fields, manifest_invalid, occurrence_index, mention_stats, marker_parse, mention_spans, resolved_spans, key_reconcile,
        pending_utterances, safe_ids, boundary_variants, jsonl_round_trip, phrase_matches, phrase_matches_automaton, transcript_matches, lattice_evidence,
        vector_top10, phrase_search, accumulated_search, retrieval_stream, utterance_top50, retrieval_scores, retrieval_report, recall_by_boundary, latency_percentiles,
        streaming_report, keyword_counts, transcript_report, partitioned_errors, partitioned_report, part_name_errors, paired_rtf, bootstrap_recall,
        run_metrics, release_gates, tumbling_chunks, accumulated_refreshes, revision_prefix, rollback_starts, session_replay, session_stream, audio_pieces,
        entity_types, entity_records, pronunciations, training_batches, positive_pairs, overlapped_chunks, hotword_languages,
        mention_ids, aligned_faults, index_round_trip, append_resumed, wave_round_trip, audio_joined, tagged_transcripts, catalog_report, partition_totals,
        jsonl_lenient, catalog_round_trip, manifest_round_trip, word_lines, decoded_rows, contexts, aligned_mentions,
        bootstrap_check, session_check, session_lookahead, session_acoustic, training_candidates,
    )
    return {f.__name__: f for f in names}

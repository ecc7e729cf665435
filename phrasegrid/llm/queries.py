"""Queries of the training-data problems, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import join_small, materialize, read
from . import frequencies, mixing, packing, quantiles, severity, tokens, topn


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    best = topn.top_n_per_group(read(spark, d, "search_hits"), ["utt_id", "chunk_id"], "hotword_id", "score", 5)
    return best.select("utt_id", "chunk_id", "hotword_id", "pos")


def p2_top5_scores(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n_per_group(read(spark, d, "search_hits"), ["utt_id", "chunk_id"], "hotword_id", "score", 5)


def _timings(spark: SparkSession, d: str) -> DataFrame:
    """Usable timings of ``batches``, written once with their keys: four digit passes read this narrow table."""
    runs = read(spark, d, "retrieval_runs").select("run_no", F.to_date("started_at").alias("day"), F.explode("batches").alias("b"))
    rows = runs.where(F.col("b.chunk_id") >= 0).select("run_no", "day", F.col("b.chunk_id").alias("chunk_id"), F.explode("b.timings_ms").alias("timing", "value"))
    rows = rows.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.col("value") >= 0) & (F.col("value") < F.lit(float("inf"))))
    return materialize(rows.withColumn("key", quantiles.ordered_key("value")), "timings")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _timings(spark, d)
    medians = materialize(quantiles.exact_medians(rows, ["timing", "chunk_id"], "key"), "medians")
    return join_small(rows, medians, ["timing", "chunk_id"]).where(F.col("value") > 4 * F.col("median")).select("run_no", "chunk_id", "timing")


def p4_medians(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.exact_medians(_timings(spark, d), ["timing", "chunk_id"], "key")


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Summaries of single days, combined; ranks are off by at most 1 %."""
    cells = quantiles.radix_summary(_timings(spark, d), ["timing", "chunk_id", "day"], "key", 0.01)
    return quantiles.summary_quantiles(cells, ["timing", "chunk_id"], {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}).withColumn(
        "rank_error_most", F.lit(0.01)
    )


def p4_rank_check(spark: SparkSession, d: str) -> DataFrame:
    """Of every percentile given out, whether its true rank among all values is within 1 % of the wanted one."""
    rows = _timings(spark, d)
    wanted = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    groups = ["timing", "chunk_id"]
    given = quantiles.summary_quantiles(quantiles.radix_summary(rows, [*groups, "day"], "key", 0.01), groups, wanted)
    given = materialize(given, "percentiles")
    ranks = quantiles.true_ranks(rows, groups, "value", given, list(wanted))
    q = F.element_at(F.create_map(*(x for n, v in wanted.items() for x in (F.lit(n), F.lit(v)))), F.col("name"))
    wanted_rank, most = F.ceil(q * F.col("n")), F.col("n") * 0.01
    within = (F.col("below") + 1 <= wanted_rank + most) & (F.col("upto") >= wanted_rank - most)
    return ranks.select(*groups, F.col("name").alias("percentile"), F.col("n").alias("values"), within.alias("within_bound"))


def p5_terms(spark: SparkSession, d: str) -> DataFrame:
    entries = read(spark, d, "word_entries")
    shards = entries.agg(F.countDistinct("shard_id")).first()[0]
    return frequencies.mark_terms(frequencies.term_frequencies(entries), shards)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_terms(spark, d).where(F.col("mark").isNotNull()).select("term", "mark")


def p5_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """Character n-grams of every length of all terms: occurrences and records (rows with one ``entry_id`` are one) that hold them."""
    terms = frequencies.loaded_once(read(spark, d, "word_entries"))
    chars = terms.select(F.filter(F.split("term", ""), lambda c: c != "").alias("chars"))
    grams = frequencies.ngram_frequencies(chars, "chars")
    return grams.select(F.array_join("gram", "").alias("ngram"), "occurrences", "records")


def _source(column: str = "source"):
    return F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+$", ""))


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    docs = tokens.token_counts(read(spark, d, "documents"), "text", ["doc_id", "source"])
    return packing.pack(docs.withColumn("source", _source()), "doc_id", "source", "tokens", 2048)


def p6_room(spark: SparkSession, d: str) -> DataFrame:
    """Per source: sequences, the fewest possible, and the share of unused room."""
    packed = p6_pack(spark, d)
    filled = packed.groupBy("sequence").agg(F.sum("tokens").alias("used"))
    source = F.regexp_replace("sequence", "#[0-9]+$", "")
    return filled.groupBy(source.alias("source")).agg(
        F.count(F.lit(1)).alias("sequences"),
        F.ceil(F.sum("used") / 2048).alias("fewest"),
        F.max("used").alias("most_used"),
        (1 - F.sum("used") / (F.count(F.lit(1)) * 2048)).alias("unused_share"),
    )


def p6_check(spark: SparkSession, d: str) -> DataFrame:
    """Per source: its documents, whether each lies in the sequences once and whole, is cut only if it is longer than one,
    and whether no sequence holds more than 2,048 tokens and their numbers run without a gap."""
    counts = materialize(tokens.token_counts(read(spark, d, "documents"), "text", ["doc_id", "source"]).withColumn("source", F.coalesce(_source(), F.lit(""))), "tokens")
    packed = materialize(packing.pack(counts, "doc_id", "source", "tokens", 2048), "packed")
    pieces = packed.groupBy("doc_id").agg(
        F.sum("tokens").alias("got"), F.count(F.lit(1)).alias("pieces"), F.count_distinct("piece").alias("different"), F.min("piece").alias("low"), F.max("piece").alias("high")
    )
    whole = (F.col("got") == F.col("tokens")) & (F.col("different") == F.col("pieces")) & (F.col("low") == 0) & (F.col("high") == F.col("pieces") - 1)
    uncut = F.col("pieces") == F.greatest(F.lit(1), F.ceil(F.col("tokens") / 2048))
    docs = counts.where("tokens is not null").join(pieces, "doc_id", "left").groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.every(F.coalesce(whole, F.lit(False))).alias("once_and_whole"), F.every(F.coalesce(uncut, F.lit(False))).alias("no_needless_cut")
    )
    number = F.regexp_extract("sequence", "#([0-9]+)$", 1).cast("bigint")
    filled = packed.groupBy(F.regexp_replace("sequence", "#[0-9]+$", "").alias("source"), number.alias("n")).agg(F.sum("tokens").alias("used"))
    room = filled.groupBy("source").agg(F.every(F.col("used") <= 2048).alias("within_capacity"), (F.max("n") == F.count(F.lit(1)) - 1).alias("no_gap"))
    return docs.join(room, "source", "left")


#: Documents below this many tokens are drawn in proportion to their length, longer ones alike.
FULL_WEIGHT = 64


def _mix(spark: SparkSession, d: str):
    docs = tokens.token_counts(read(spark, d, "documents"), "text", ["doc_id", "source"])
    docs = docs.withColumn("weight", F.least(F.lit(1.0), F.col("tokens") / F.lit(float(FULL_WEIGHT))))
    return mixing.pareto_mix(docs, read(spark, d, "mix_targets"), weight="weight")


def p7_uses(spark: SparkSession, d: str) -> DataFrame:
    """Fragments of a few tokens are drawn less often than texts: the weight is the length, up to ``FULL_WEIGHT`` tokens."""
    return _mix(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    """Per listed source: its documents, whether none is used more than ``max_repeats`` times and whether the share is met
    within one document's length, or else all that the source may give is given."""
    uses, shares = _mix(spark, d)
    uses = materialize(uses, "uses")
    own = uses.where("tokens is not null").groupBy("source").agg(F.max("tokens").alias("longest"))
    capped = F.col("most_uses") <= F.col("max_repeats")
    most = F.col("have_tokens") * F.col("max_repeats")
    met = F.abs(F.col("actual_tokens") - F.least(F.col("wanted_tokens"), most)) <= F.coalesce("longest", F.lit(0))
    return shares.join(own, "source", "left").select("source", "documents", capped.alias("within_repeats"), met.alias("share_met"))


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    model = severity.train(docs, read(spark, d, "content_labels"))
    return severity.score(docs, model, ["doc_id", "source"])


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_scores(spark, d).where("flagged = 1").select("doc_id")


def p8_check(spark: SparkSession, d: str) -> DataFrame:
    """Labelled texts by the raters' grade, and whether texts that all raters flagged are found more abusive than those that none did."""
    labels = severity.graded(read(spark, d, "content_labels"))
    rows = p8_scores(spark, d).where("severity is not null").join(labels, "doc_id").groupBy("grade").agg(F.count(F.lit(1)).alias("documents"), F.avg("severity").alias("mean"))
    rows = materialize(rows, "grades")
    ends = rows.agg(F.max(F.when(F.col("grade") == 2, F.col("mean"))).alias("high"), F.max(F.when(F.col("grade") == 0, F.col("mean"))).alias("low")).first()
    return rows.select("grade", "documents", F.lit(ends["high"] is not None and ends["low"] is not None and ends["high"] > ends["low"] + 0.5).alias("told_apart"))


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return severity.rates(p8_scores(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            p2_found, p2_top5_scores, p4_found, p4_medians, p4_percentiles, p4_rank_check, p5_found, p5_terms, p5_ngrams,
            p6_pack, p6_room, p6_check, p7_uses, p7_shares, p7_check, p8_found, p8_scores, p8_check, p8_rates,
        )
    }

"""Scores: edit rates, keyword counts, partitioned errors, retrieval recall and rank, timings, paired bootstrap."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import _folded, match_text
from .ranking import running

KS = (1, 5, 10, 20, 50)


def token_distance(a: Column, b: Column) -> Column:
    """Edit distance of two string arrays: each distinct token becomes one character beyond U+FFFF (at most 1,048,575; more is an error)."""
    words = F.array_distinct(F.concat(a, b))
    code = lambda t: F.decode(F.unhex(F.lpad(F.hex(F.lit(65536) + F.array_position(words, t).cast("int")), 8, "0")), "UTF-32")
    return F.levenshtein(F.array_join(F.transform(a, code), ""), F.array_join(F.transform(b, code), ""))


def words(text: Column) -> Column:
    """Tokens of match-normalised text, split at blanks; no tokens in empty text."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def edit_counts(pairs: DataFrame, reference: str = "reference", hypothesis: str = "hypothesis") -> DataFrame:
    """``pairs`` with word and character errors and lengths. Characters are code points without blanks."""
    rows = pairs.withColumns({"__r": match_text(F.col(reference)), "__h": match_text(F.col(hypothesis))})
    squeeze = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    return rows.withColumns(
        {
            "word_errors": token_distance(words(F.col("__r")), words(F.col("__h"))),
            "ref_words": F.size(words(F.col("__r"))),
            "char_errors": F.levenshtein(squeeze("__r"), squeeze("__h")),
            "ref_chars": F.length(squeeze("__r")),
        }
    ).drop("__r", "__h")


def occurrences(text: Column, key: Column) -> Column:
    """Non-overlapping occurrences; 0 for an empty key."""
    return F.when(F.length(key) > 0, ((F.length(text) - F.length(F.replace(text, key, F.lit("")))) / F.length(key)).cast("int")).otherwise(0)


def keyword_counts(pairs: DataFrame, keys: list[str], hotwords: str = "hotwords", reference: str = "reference", hypothesis: str = "hypothesis") -> DataFrame:
    """Per record (``keys``): occurrences of its keywords expected, predicted and met, precision, recall, F1, false alarms a keyword."""
    base = pairs.select(*keys, match_text(F.col(reference)).alias("__r"), match_text(F.col(hypothesis)).alias("__h"), F.coalesce(hotwords, F.array().cast("array<string>")).alias("__k"))
    each = base.select("*", F.explode_outer("__k").alias("__w")).withColumn("__key", match_text(F.col("__w")))
    counted = each.select(
        *keys, F.size("__k").alias("__n"), F.coalesce(occurrences(F.col("__r"), F.col("__key")), F.lit(0)).alias("e"), F.coalesce(occurrences(F.col("__h"), F.col("__key")), F.lit(0)).alias("p")
    )
    sums = counted.groupBy(*keys, "__n").agg(F.sum("e").alias("keyword_ref"), F.sum("p").alias("keyword_hyp"), F.sum(F.least("e", "p")).alias("keyword_tp"))
    fp = F.greatest(F.lit(0), F.col("keyword_hyp") - F.col("keyword_tp"))
    precision = F.col("keyword_tp") / F.greatest(F.lit(1), F.col("keyword_hyp"))
    recall = F.col("keyword_tp") / F.greatest(F.lit(1), F.col("keyword_ref"))
    return sums.select(
        *keys, "keyword_ref", "keyword_hyp", "keyword_tp", fp.alias("keyword_fp"), precision.alias("keyword_precision"), recall.alias("keyword_recall"),
        f1(precision, recall).alias("keyword_f1"), (fp / F.greatest(F.lit(1), F.col("__n"))).alias("keyword_far"),
    )


def f1(precision: Column, recall: Column) -> Column:
    return 2 * precision * recall / F.greatest(F.lit(1e-12), precision + recall)


def transcript_report(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """One row: micro WER and CER, keyword micro precision/recall/F1, false alarms a record, and means that skip nulls.

    ``boundary_penalty``: mean recall of group 'center' less that of groups 'cross*', null unless both occur.
    """
    counted = edit_counts(pairs).join(keyword_counts(pairs, keys), keys)
    group = F.coalesce("boundary_group", F.lit("unspecified")) if "boundary_group" in pairs.columns else F.lit("unspecified")
    ratio = lambda a, b: F.sum(a) / F.greatest(F.lit(1), F.sum(b))
    p, r = ratio("keyword_tp", "keyword_hyp"), ratio("keyword_tp", "keyword_ref")
    extra = [F.avg(c).alias(f"{c}_mean") for c in ("hotword_stable_latency_ms", "revision_rate", "rtf") if c in pairs.columns]
    return counted.agg(
        F.count(F.lit(1)).alias("records"), ratio("word_errors", "ref_words").alias("wer"), ratio("char_errors", "ref_chars").alias("cer"),
        p.alias("keyword_precision"), r.alias("keyword_recall"), f1(p, r).alias("keyword_f1"), (F.sum("keyword_fp") / F.count(F.lit(1))).alias("keyword_far"),
        (F.avg(F.when(group == "center", F.col("keyword_recall"))) - F.avg(F.when(group.startswith("cross"), F.col("keyword_recall")))).alias("boundary_penalty"),
        *extra,
    )


def _rows(reference: np.ndarray, hypothesis: np.ndarray, row: np.ndarray, first: int):
    """Rows of the table of costs below ``row`` (that of ``first`` reference units), each with the cost of its diagonal moves."""
    steps = np.arange(len(hypothesis) + 1)
    for i, code in enumerate(reference, first + 1):
        diagonal = row[:-1] + (hypothesis != code)
        best = np.concatenate(([i], np.minimum(diagonal, row[1:] + 1)))
        cost = np.minimum.accumulate(best - steps) + steps  # insertions run along the row
        yield cost, diagonal, row
        row = cost


def align(reference: list[str], hypothesis: list[str]) -> list[tuple[str | None, str | None]]:
    """Pairs of a cheapest alignment; going back from the end, diagonal before deletion before insertion.

    Rows are computed by numpy. Of the table only every k-th row is kept (k: the root of their number); going back, the
    moves of one stretch at a time are made again from the row above it, so memory grows with the root of the table's size.
    """
    n, m = len(reference), len(hypothesis)
    codes = {t: i for i, t in enumerate(dict.fromkeys([*reference, *hypothesis]))}
    r, h = (np.array([codes[t] for t in x], dtype=np.int64) for x in (reference, hypothesis))
    stretch = max(1, math.isqrt(n))
    kept = [np.arange(m + 1)]
    for i, (cost, _, _) in enumerate(_rows(r, h, kept[0], 0), 1):
        if i % stretch == 0:
            kept.append(cost)
    out = []
    i, j = n, m
    moves: list[np.ndarray] = []
    while i:
        top = (i - 1) // stretch * stretch
        if not moves:
            for cost, diagonal, above in _rows(r[top:i], h, kept[top // stretch], top):
                moves.append(np.concatenate(([1], np.where(cost[1:] == diagonal, 0, np.where(cost[1:] == above[1:] + 1, 1, 2)))).astype(np.int8))
        move = moves[i - 1 - top][j]
        if move == 2:
            j -= 1
            out.append((None, hypothesis[j]))
            continue
        i -= 1
        moves.pop()
        if move == 0:
            j -= 1
        out.append((reference[i], hypothesis[j] if move == 0 else None))
    out += [(None, t) for t in reversed(hypothesis[:j])]
    return out[::-1]


_PARTS = T.StructType([T.StructField(n, T.LongType()) for n in ("biased_ref", "biased_errors", "unbiased_ref", "unbiased_errors")])


_CELLS = 4_000_000  # cells of the tables that are filled side by side; a pair with more is aligned by itself


def _units(text: str, whole: bool) -> list[str]:
    return [c for c in text if c != " "] if whole else text.split()


def _split(pairs) -> list[tuple[int, int, int, int]]:
    """Counts (see ``_PARTS``) of each (reference, hypothesis, hotwords), all normalised."""
    jobs, out = [], [None] * len(pairs)
    for at, (reference, hypothesis, hotwords) in enumerate(pairs):
        whole = " " not in reference
        r, h = _units(reference, whole), _units(hypothesis, whole)
        units = {t for w in hotwords for t in _units(w, whole)}
        if len(r) * (len(h) + 1) > _CELLS:
            out[at] = _one_split(r, h, units)
        else:
            jobs.append((at, r, h, units))
    jobs.sort(key=lambda x: (len(x[1]), len(x[2])))
    while jobs:
        k, n, m = 1, len(jobs[-1][1]), max(len(j[2]) for j in jobs[-1:])
        while k < len(jobs) and (k + 1) * n * (max(m, len(jobs[-k - 1][2])) + 1) <= _CELLS:
            k += 1
            m = max(m, len(jobs[-k][2]))
        part, jobs = jobs[-k:], jobs[:-k]
        for (at, *_), counts in zip(part, _many_splits([j[1:] for j in part], n, m).tolist()):
            out[at] = tuple(counts)
    return out


def _one_split(r: list[str], h: list[str], units: set[str]) -> tuple[int, int, int, int]:
    counts = [0, 0, 0, 0]
    for a, b in align(r, h):
        at = 0 if (a if a is not None else b) in units else 2
        counts[at] += a is not None
        counts[at + 1] += a != b
    return tuple(counts)


def _many_splits(pairs: list, n: int, m: int) -> np.ndarray:
    """The same for many pairs at once: their tables of moves are filled row by row side by side, and walked back together."""
    size = len(pairs)
    r, h = np.full((size, max(1, n)), -1, dtype=np.int32), np.full((size, max(1, m)), -2, dtype=np.int32)
    own_r, own_h = np.zeros(r.shape, dtype=bool), np.zeros(h.shape, dtype=bool)
    i, j = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    for p, (a, b, units) in enumerate(pairs):
        codes = {t: k for k, t in enumerate(dict.fromkeys([*a, *b]))}
        i[p], j[p] = len(a), len(b)
        for side, own, tokens in ((r, own_r, a), (h, own_h, b)):
            side[p, : len(tokens)] = [codes[t] for t in tokens]
            own[p, : len(tokens)] = [t in units for t in tokens]
    steps = np.arange(h.shape[1] + 1, dtype=np.int32)
    row = np.broadcast_to(steps, (size, len(steps)))
    moves = np.ones((n, size, len(steps)), dtype=np.int8)
    for k in range(n):
        diagonal, down = row[:, :-1] + (h != r[:, k : k + 1]), row[:, 1:] + 1
        best = np.concatenate([np.full((size, 1), k + 1, dtype=np.int32), np.minimum(diagonal, down)], axis=1)
        row = np.minimum.accumulate(best - steps, axis=1) + steps
        moves[k, :, 1:] = np.where(row[:, 1:] == diagonal, 0, np.where(row[:, 1:] == down, 1, 2))
    counts = np.zeros((size, 4), dtype=np.int64)
    at = np.flatnonzero(i + j)
    while len(at):
        x, y = i[at], j[at]
        move = np.where(x == 0, 2, moves[x - 1, at, y] if n else 2)
        spoken = move < 2
        own = np.where(spoken, own_r[at, x - 1], own_h[at, y - 1])
        bad = (move > 0) | (r[at, x - 1] != h[at, y - 1])
        column = np.where(own, 0, 2)
        counts[at, column] += spoken
        counts[at, column + 1] += bad
        i[at], j[at] = x - spoken, y - (move != 1)
        at = at[(i[at] + j[at]) > 0]
    return counts


def partitioned_errors(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Edit errors by whether the unit belongs to a hotword; an insertion counts where the inserted unit belongs.

    Units are words if the normalised reference has a blank, else characters.
    """

    def run(ref: pd.Series, hyp: pd.Series, hot: pd.Series) -> pd.DataFrame:
        words = lambda k: () if k is None else [_folded(w) for w in k if w is not None]
        rows = _split([(r or "", h or "", words(k)) for r, h, k in zip(ref, hyp, hot)])
        return pd.DataFrame(rows, columns=_PARTS.fieldNames(), dtype="int64")

    run.__annotations__ = {"ref": pd.Series, "hyp": pd.Series, "hot": pd.Series, "return": pd.DataFrame}
    udf = F.pandas_udf(run, _PARTS)
    return pairs.select(*keys, udf(match_text(F.col("reference")), match_text(F.col("hypothesis")), F.col("hotwords")).alias("p")).select(*keys, "p.*")


def partitioned_report(parts: DataFrame) -> DataFrame:
    rate = lambda a, b: F.sum(a) / F.greatest(F.lit(1), F.sum(b))
    return parts.agg(rate("biased_errors", "biased_ref").alias("bwer"), rate("unbiased_errors", "unbiased_ref").alias("uwer"))


def boundary(label: Column) -> Column:
    """'center', 'cross' or 'other' by the trimmed, case-folded beginning."""
    t = F.lower(F.regexp_replace(F.coalesce(label, F.lit("")), r"(?U)^\s+", ""))
    return F.when(t.startswith("center"), "center").when(t.startswith("cross"), "cross").otherwise("other")


def hit_scores(runs: DataFrame, keep: list[str], ks=KS) -> DataFrame:
    """Per record: gold size, recall and precision at each k, reciprocal rank, first chunk with gold in its top 50.

    ``runs`` needs ``target_hotword_ids`` (or, where that is null, ``hotword_ids``), ``final_batch`` (or ``final_hits``) and
    ``batches``; null hits and ids match nothing, a batch without ``chunk_id`` is chunk 0.
    """
    none = F.array().cast("array<string>")
    have = lambda *names: [F.col(n) for n in names if n in runs.columns]
    ids = lambda c: F.transform(c, lambda h: h["hotword_id"])
    gold = F.array_distinct(F.filter(F.coalesce(*have("target_hotword_ids", "hotword_ids"), none), lambda x: x.isNotNull()))
    last = F.col("final_batch")
    hits = ids(last["hits"])
    if "final_hits" in runs.columns:
        hits = F.when(last.isNotNull(), hits).otherwise(ids(F.col("final_hits")))
    rows = runs.withColumns({"__gold": gold, "__hits": F.coalesce(hits, F.array().cast("array<string>"))})
    has = lambda a: F.array_contains(F.col("__gold"), a)
    cols: dict[str, Column] = {"gold": F.size("__gold")}
    for k in ks:
        top = F.slice("__hits", 1, k)
        met = F.size(F.array_intersect(F.col("__gold"), top))
        cols[f"recall_at_{k}"] = F.when(F.size("__gold") > 0, met / F.size("__gold")).otherwise(0.0)
        cols[f"precision_at_{k}"] = met / F.greatest(F.lit(1), F.size(top))
    first = F.array_position(F.transform("__hits", lambda h: F.coalesce(has(h), F.lit(False))), True)
    cols["reciprocal_rank"] = F.when(first > 0, 1.0 / first).otherwise(0.0)
    found = F.filter("batches", lambda b: F.exists(F.slice(F.coalesce(b["hits"], F.slice(b["hits"], 1, 0)), 1, 50), lambda h: F.coalesce(has(h["hotword_id"]), F.lit(False))))
    cols["first_top50_chunk"] = F.when(F.size(found) > 0, F.coalesce(F.get(found, 0)["chunk_id"], F.lit(0)))
    return rows.select(*keep, *(c.alias(n) for n, c in cols.items()))


def retrieval_report(scores: DataFrame, ks=KS) -> DataFrame:
    """One row over ``hit_scores`` (with ``boundary_group``): means over records with gold; -1 where no first chunk is known."""
    rows = scores.where("gold > 0").withColumn("__b", boundary(F.col("boundary_group")))
    aggs = []
    for k in ks:
        p, r = F.coalesce(F.avg(f"precision_at_{k}"), F.lit(0.0)), F.coalesce(F.avg(f"recall_at_{k}"), F.lit(0.0))
        aggs += [r.alias(f"recall_at_{k}"), p.alias(f"precision_at_{k}"), f1(p, r).alias(f"f1_at_{k}"), (1.0 - p).alias(f"false_alarm_rate_at_{k}")]
    center = F.coalesce(F.avg(F.when(F.col("__b") == "center", F.col("recall_at_50"))), F.lit(0.0))
    cross = F.coalesce(F.avg(F.when(F.col("__b") == "cross", F.col("recall_at_50"))), F.lit(0.0))
    return rows.agg(
        F.count(F.lit(1)).alias("evaluable"), *aggs, F.coalesce(F.avg("reciprocal_rank"), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.avg("first_top50_chunk"), F.lit(-1.0)).alias("first_top50_chunk_mean"),
        center.alias("recall_center_at_50"), cross.alias("recall_cross_at_50"),
        F.count_if(F.col("__b") == "center").alias("center_utterances"), F.count_if(F.col("__b") == "cross").alias("cross_utterances"),
        (center - cross).alias("boundary_penalty"),
    )


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def exact_percentiles(values: DataFrame, groups: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """``groups`` and one double a name: linear percentiles of the finite values, however many there are and however few groups.

    Equal values are counted before the shuffle; running counts over range partitions find the values at the ranks, so no
    task holds a group. A group without finite values has no row.
    """
    counts = values.where(finite(F.col(value))).groupBy(*groups, (F.col(value).cast("double") + F.lit(0.0)).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    placed = running(counts, groups, [F.col("__v")], "__at", "__c")
    total = placed.groupBy(*groups).agg(F.sum("__c").alias("__n")).withColumnsRenamed({g: f"__g{i}" for i, g in enumerate(groups)})
    same = F.lit(True)
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    wanted = total.select(
        "*", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), (F.col("__n") - 1).cast("double").alias("last"), F.lit(float(q)).alias("q")) for n, q in quantiles.items()))).alias("__q")
    ).withColumn("__r", F.col("__q.q") * F.col("__q.last"))
    low, high = F.floor("__r"), F.ceil("__r")
    holds = lambda r: (F.col("__c_before") <= r) & (r < F.col("__c_before") + F.col("__c"))
    at = placed.join(wanted, same).where(holds(low) | holds(high))
    one = at.groupBy(*groups, F.col("__q.name").alias("__name"), (F.col("__r") - low).alias("__part")).agg(
        F.max(F.when(holds(low), F.col("__v"))).alias("a"), F.max(F.when(holds(high), F.col("__v"))).alias("b")
    )
    between = F.col("a") + (F.col("b") - F.col("a")) * F.col("__part")
    return one.groupBy(*groups).agg(*(F.max(F.when(F.col("__name") == n, between)).alias(n) for n in quantiles))


def series_aggregates(values: DataFrame, name: str = "name", value: str = "value", biggest: bool = True) -> DataFrame:
    """Mean, p50, p95 and greatest of long-form measurements ``(name, value)``; names without values are absent."""
    v = F.col(value)
    rows = values.where(v.isNotNull()).select(name, value)
    sums = rows.groupBy(name).agg(F.avg(v).alias("mean"), *([F.max(v).alias("max")] if biggest else []))
    ranks = exact_percentiles(rows, [name], value, {"p50": 0.5, "p95": 0.95})
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return sums.join(ranks, name, "left").select(name, "mean", zero("p50"), zero("p95"), *(["max"] if biggest else []))


#: Measurement families and the field names that may hold them (the first present one counts).
ARRAYS = {
    "chunk_latency_ms": ("chunk_processing_ms", "chunk_latencies_ms"),
    "cpu_retrieval_ms": ("cpu_retrieval_ms",),
    "active_states": ("active_state_counts", "active_states"),
    "prompt_tokens": ("prompt_token_counts", "prompt_tokens"),
}
SCALARS = ("ttft_ms", "stable_final_latency_ms", "hotword_stable_latency_ms", "rtf", "revision_rate", "gpu_memory_mb", "redecoded_tokens_per_minute")


def streaming_aggregates(records: DataFrame) -> DataFrame:
    """``name, mean, p50, p95, max`` of the measurement fields that records have; absent ones give no row."""
    parts = []
    for name, fields in ARRAYS.items():
        have = [F.col(f).cast("array<double>") for f in fields if f in records.columns]
        if have:
            parts.append(records.select(F.lit(name).alias("name"), F.explode(F.coalesce(*have)).alias("value")))
    for name in SCALARS:
        if name in records.columns:
            parts.append(records.select(F.lit(name).alias("name"), F.col(name).cast("double").alias("value")))
    if not parts:
        raise ValueError("no measurement field")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return series_aggregates(out)


def last_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*(F.col(o).desc() for o in order))
    return df.withColumn("__row", F.row_number().over(w)).where("__row = 1").drop("__row")


def paired_differences(run: DataFrame, base: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Differences of ``value`` to the baseline, of which the last row of a key counts; all rows of the run count."""
    b = last_by_key(base, keys, order).select(*keys, F.col(value).alias("__base"))
    return run.join(b, keys).withColumn("difference", F.col(value) - F.col("__base")).drop("__base")


def bootstrap_ci(differences: DataFrame, value: str, key: str, samples: int = 2000, seed: int = 42) -> DataFrame:
    """Poisson bootstrap of a mean in one pass: ``mean, low, high`` (2.5 % and 97.5 %).

    Each row draws one weight a resample from a hash of its key, so every partition adds up its own ``samples`` sums;
    at most ``samples`` partial sums a partition are shuffled.
    """
    rows = differences.where(F.col(value).isNotNull()).select(F.xxhash64(F.col(key), F.lit(seed)).alias("h"), F.col(value).cast("double").alias("v"))
    # Cumulative Poisson(1) probabilities up to 8.
    cumulative = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)])

    def run(batches):
        sums, weights = np.zeros(samples), np.zeros(samples)
        total, count = 0.0, 0
        for pdf in batches:
            h = pdf["h"].to_numpy().view("uint64")
            v = pdf["v"].to_numpy()
            total, count = total + float(v.sum()), count + len(v)
            for at in range(0, len(v), 512):
                x = h[at : at + 512, None] + np.arange(1, samples + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                w = np.searchsorted(cumulative, (x >> np.uint64(11)).astype(np.float64) / 2.0**53).astype(np.float64)
                sums += v[at : at + 512] @ w
                weights += w.sum(axis=0)
        yield pd.DataFrame({"sample": range(-1, samples), "s": np.r_[total, sums], "w": np.r_[float(count), weights]})

    means = rows.mapInPandas(run, "sample int, s double, w double").groupBy("sample").agg(F.sum("s").alias("s"), F.sum("w").alias("w"))
    m = F.when(F.col("w") > 0, F.col("s") / F.nullif("w", F.lit(0.0)))  # sample -1 is the table itself
    drawn = F.when(F.col("sample") >= 0, m)
    return means.agg(
        F.max(F.when(F.col("sample") < 0, m)).alias("mean"), F.percentile(drawn, F.lit(0.025)).alias("low"), F.percentile(drawn, F.lit(0.975)).alias("high")
    )


def bootstrap_exact(values: list[float], samples: int = 2000, seed: int = 42) -> tuple[float, float]:
    """Driver-side interval with numpy's generator and linear quantiles, for a few thousand differences at most."""
    if not values:
        raise ValueError("no differences")
    v = np.asarray(values, dtype=np.float64)
    means = v[np.random.default_rng(seed).integers(0, len(v), size=(samples, len(v)))].mean(axis=1)
    return float(np.quantile(means, 0.025)), float(np.quantile(means, 0.975))


def bootstrap_nearest(values: list[float], samples: int = 2000, confidence: float = 0.95, seed: int = 42) -> tuple[float, float]:
    """Driver-side interval by nearest ranks, drawn with Python's generator, for a few thousand differences at most."""
    if not values:
        raise ValueError("no differences")
    draw = random.Random(seed).choice
    means = sorted(math.fsum(draw(values) for _ in values) / len(values) for _ in range(samples))
    return tuple(means[i] for i in nearest_ranks(samples, confidence))


def nearest_ranks(samples: int, confidence: float) -> tuple[int, int]:
    """0-based places of the bounds among sorted samples."""
    outside = (1 - confidence) / 2
    return max(0, math.floor(outside * samples)), min(samples - 1, math.ceil((1 - outside) * samples) - 1)


def run_metrics(runs: DataFrame, ks=KS) -> DataFrame:
    """Everything a retrieval run is judged by, as ``name string, value double``: utterances, the retrieval report, p50 and p95
    of every timing, mean real-time factor, greatest memory (0 without any) and, if any record says, the rate of equal offline results."""
    long = lambda df: df.select(F.explode(F.map_from_arrays(F.array(*(F.lit(c) for c in df.columns)), F.array(*(F.col(c).cast("double") for c in df.columns)))).alias("name", "value"))
    scores = hit_scores(runs, [c for c in ("boundary_group",) if c in runs.columns], ks)
    times = runs.select(F.explode("batches").alias("b")).select(F.explode("b.timings_ms").alias("name", "value"))
    ranks = exact_percentiles(times, ["name"], "value", {"p50": 0.5, "p95": 0.95})
    pairs = F.explode(F.array(*(F.struct(F.concat(F.col("name"), F.lit(f"_{p}")).alias("name"), F.col(p).alias("value")) for p in ("p50", "p95"))))
    whole = runs.agg(
        F.count(F.lit(1)).alias("utterances"), F.coalesce(F.avg("rtf"), F.lit(0.0)).alias("rtf_mean"), F.coalesce(F.max("peak_memory_mb"), F.lit(0.0)).alias("peak_memory_mb_max"),
        F.avg(F.col("offline_final_exact_match").cast("int")).alias("offline_final_exact_match_rate"),
    )
    out = long(whole).unionByName(long(retrieval_report(scores, ks))).unionByName(ranks.select(pairs.alias("e")).select("e.*"))
    return out.where("value is not null")


def verdict(measured: DataFrame) -> DataFrame:
    """One row of gates over ``name, value`` measurements, and ``go``: all of them. What is not measured does not pass.

    Names beyond those of ``run_metrics``: ``recall_gain`` and ``recall_gain_low`` (the interval's lower bound).
    """
    at = lambda n: F.max(F.when(F.col("name") == n, F.col("value"))).alias(n)
    names = ("recall_gain", "recall_gain_low", "boundary_penalty", "center_utterances", "cross_utterances", "offline_final_exact_match_rate", "search_ms_p95")
    one = measured.agg(*(at(n) for n in names))
    both = (F.coalesce("center_utterances", F.lit(0)) > 0) & (F.coalesce("cross_utterances", F.lit(0)) > 0)
    parts = {
        "recall_ok": gates(gain=F.col("recall_gain"), low=F.col("recall_gain_low")), "boundary_ok": both & gates(penalty=F.col("boundary_penalty")),
        "parity_ok": gates(parity=F.col("offline_final_exact_match_rate")), "latency_ok": gates(p95=F.col("search_ms_p95")),
    }
    return one.select(*(c.alias(n) for n, c in parts.items())).withColumn("go", F.expr(" and ".join(parts)))


def gates(gain: Column | None = None, low: Column | None = None, penalty: Column | None = None, parity: Column | None = None, p95: Column | None = None) -> Column:
    """True if recall gained at least 5 points with a positive lower bound, the penalty is at most 0.03, parity is full and p95 under 10 ms."""
    ok = F.lit(True)
    if gain is not None:
        ok = ok & (gain >= 0.05) & (low > 0)
    if penalty is not None:
        ok = ok & (penalty <= 0.03)
    if parity is not None:
        ok = ok & (parity == 1.0)
    if p95 is not None:
        ok = ok & (p95 < 10.0)
    return F.coalesce(ok, F.lit(False))

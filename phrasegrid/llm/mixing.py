"""Mixing sources to target shares by Pareto order sampling.

A source that must give W tokens and has T uses every document W/T times on average; with weights, in proportion to
them. No document is used more than ``max_repeats`` times on average, and what that takes from the heavy ones is given to
the others of the source (``_rates``). The whole part of that number is allotted for certain. The rest is an inclusion
probability: documents are ranked by random odds over inclusion odds, and taken in that order until the source's
remaining tokens are reached: a sample of fixed size in tokens with unequal probabilities. Where a long document would
pass the target, those behind it that are short against the gap (an eighth) fill it, and one last document closes what
is left if that comes nearer.

The place where a source's ranking is cut is found by a histogram of the rank's leading 16 bits with token sums; only the
documents of the one cell that holds the cut (about 2^-16 of a source) are sorted. No source, however large, is sorted
or gathered in one task, and documents are never shuffled: they meet their source's numbers in small tables whose size
is measured before they are broadcast.

Random numbers are a hash of the document id and the seed, so a lost task repeats the same choice.

Defined results: sources are compared trimmed and lower-cased. Documents of no listed source, with null text or a
null source get 0 uses, but their tokens count in the total that shares refer to. Documents without tokens take part
like others and cost nothing. A listed source without documents gets a row with 0. Repeated ids share their random number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import broadcast_limit, held, join_small, materialize, measured

_BITS = 48


def _rate(cells: pd.DataFrame) -> float:
    """The rate of one source. Heavier weights meet the limit first, so the limited cells are the first k by weight, for the least k that agrees."""
    c = cells.sort_values("__w", ascending=False)
    w, t, most, wanted = c["__w"].to_numpy(), c["__t"].to_numpy(dtype=float), float(c["__most"].iloc[0]), float(c["wanted"].iloc[0])
    limited = np.concatenate(([0.0], np.cumsum(t))) * most
    free = np.concatenate((np.cumsum((w * t)[::-1])[::-1], [0.0]))
    rate = np.full(len(w) + 1, np.inf)
    rate[:-1] = np.maximum(0.0, wanted - limited[:-1]) / free[:-1]
    return float(rate[np.argmax(np.append(rate[:-1] * w < most, True))])


def _rates(docs: DataFrame, sources: DataFrame, size: int) -> DataFrame:
    """``source, __rate``: a document of weight w is used min(rate * w, max_repeats) times on average.

    What the limit takes from heavy documents is given to the others of their source: the rate is raised until no further
    document meets the limit, so a source gives its tokens whenever its documents can. A source whose documents all stand
    at the limit has an infinite rate. The (source, weight) cells are solved source by source where all of them fit the
    broadcast limit (few distinct weights); otherwise in rounds, each one sum over the cells.
    """
    most = F.coalesce(F.col("max_repeats").cast("double"), F.lit(0.0))
    cells = docs.where((F.col("tokens") > 0) & (F.col("__w") > 0)).groupBy("source", "__w").agg(F.sum("tokens").alias("__t"))
    cells = materialize(join_small(cells, sources.select("source", "wanted", most.alias("__most")), ["source"], "inner", size), "mix-weights")
    if measured(cells)[1] <= broadcast_limit(docs.sparkSession):
        solved = cells.groupBy("source").applyInPandas(lambda c: pd.DataFrame({"source": c["source"][:1], "__rate": [_rate(c)]}), f"source {docs.schema['source'].dataType.simpleString()}, __rate double")
        return held(solved, "mix-rates", size)
    rates = sources.select("source", F.lit(0.0).alias("__rate"))
    limited = -1
    while True:
        at = F.col("__rate") * F.col("__w") >= F.col("__most")
        first = F.lit(limited < 0)  # before the first round nothing is at its limit
        fixed = F.when(at & ~first, F.col("__most") * F.col("__t")).otherwise(F.lit(0.0))
        free = F.when(at & ~first, F.lit(0.0)).otherwise(F.col("__w") * F.col("__t"))
        sums = join_small(cells, rates, ["source"], "inner", size).groupBy("source").agg(
            F.max("wanted").alias("w"), F.sum(fixed).alias("h"), F.sum(free).alias("f"), F.count_if(at & ~first).alias("__limited")
        )
        rate = F.when(F.col("f") > 0, F.greatest(F.lit(0.0), F.col("w") - F.col("h")) / F.col("f")).otherwise(F.lit(float("inf")))
        rates = held(sums.select("source", rate.alias("__rate"), "__limited"), "mix-rates", size)
        now = rates.agg(F.coalesce(F.sum("__limited"), F.lit(0)).alias("n")).first()["n"]
        rates = rates.select("source", "__rate")
        if now == limited:
            return rates
        limited = now


def _allot(docs: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Documents with whole copies and residual probability; the sources with wanted tokens; a bound of the bytes of any
    table of one row a source that is made here."""
    totals = docs.groupBy("source").agg(F.sum("tokens").alias("have"), F.max(F.octet_length(F.col("doc_id").cast("string"))).alias("__id"))
    whole = totals.agg(F.coalesce(F.sum("have"), F.lit(0)).alias("all_tokens"), F.coalesce(F.max("__id"), F.lit(0)).alias("id")).first()
    all_tokens, totals = whole["all_tokens"], totals.drop("__id")
    wanted = targets.withColumn("wanted", F.col("target_share") * F.lit(float(all_tokens)))
    sources = wanted.join(totals, "source", "left").withColumns({"have": F.coalesce("have", F.lit(0)), "all_tokens": F.lit(all_tokens)})
    rows, size = measured(targets)
    size += rows * (200 + 4 * whole["id"])  # beside the source, at most two dozen numbers and four documents a row
    sources = held(sources, "mix-sources", size)
    limits = sources.select("source", "max_repeats").join(_rates(docs, sources, size), "source", "left")
    placed = join_small(docs, limits, ["source"], "left", size)
    drawn = F.when((F.col("__w") > 0) & (F.coalesce("__rate", F.lit(0.0)) > 0), F.col("__rate") * F.col("__w")).otherwise(F.lit(0.0))
    mean = F.least(drawn, F.coalesce(F.col("max_repeats").cast("double"), F.lit(0.0)))
    placed = placed.withColumn("__mean", mean).withColumn("__whole", F.floor("__mean").cast("int")).withColumn("__pi", F.col("__mean") - F.col("__whole"))
    return placed, sources, size


def _after(edge: str):
    """Rows behind an edge in ranking order; a null edge stands before all rows."""
    place = F.struct(F.col("__key").alias("k"), F.col("doc_id").alias("d"))
    return F.col(edge).isNull() | (place > F.col(edge))


def _cut(drawn: DataFrame, need: DataFrame, size: int) -> DataFrame:
    """Where each source's ranking is cut: ``source, __edge`` (the last taken (key, document), null: none) and ``__left``,
    the tokens still wanted, as the document at the cut is left out.

    A histogram of token sums over the leading 16 bits finds the cell of the cut, then a running sum within that one cell of a source.
    """
    cell = F.shiftright("__key", _BITS - 16)
    hist = drawn.groupBy("source", cell.alias("__cell")).agg(F.sum("tokens").alias("__t"))
    hist = hist.withColumn("__upto", F.sum("__t").over(Window.partitionBy("source").orderBy("__cell").rowsBetween(Window.unboundedPreceding, 0)))
    # The cell that the need ends in, or the last one if all fits.
    at = join_small(hist, need, ["source"], "inner", size).groupBy("source", "__need").agg(
        F.min(F.when(F.col("__upto") > F.col("__need"), F.struct("__cell", "__upto", "__t"))).alias("__c"), F.max(F.struct("__cell", "__upto", "__t")).alias("__z")
    )
    at = at.select("source", "__need", F.coalesce("__c", "__z").alias("c"))
    cut = held(at.select("source", F.col("c.__cell").alias("__cell"), (F.col("__need") - (F.col("c.__upto") - F.col("c.__t"))).alias("__need")), "mix-cut", size)
    last = join_small(drawn.withColumn("__cell", cell), cut, ["source", "__cell"], "inner", size)
    order = Window.partitionBy("source").orderBy("__key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("__upto", F.sum("tokens").over(order))
    fits = F.col("__upto") <= F.col("__need")
    edge = last.where(fits).groupBy("source").agg(F.max(F.struct(F.col("__key").alias("k"), F.col("doc_id").alias("d"))).alias("__in"), F.max("__upto").alias("__got"))
    # Nothing of the cell is taken: the edge is the place before its first document.
    before = F.struct((F.shiftleft("__cell", _BITS - 16) - 1).alias("k"), F.lit(None).cast(drawn.schema["doc_id"].dataType).alias("d"))
    return cut.join(edge, "source", "left").select(
        "source", F.coalesce("__in", before).alias("__edge"), (F.col("__need") - F.coalesce("__got", F.lit(0))).alias("__left")
    )


def pareto_mix(documents: DataFrame, targets: DataFrame, seed: int = 17, weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``documents``: ``doc_id, source, tokens`` (null tokens: no text); ``targets``: ``source, target_share, max_repeats``.
    ``weight``: a column of relative weights; null, NaN and negative ones are 0, and such documents are not used.

    Returns the uses (``doc_id, source, tokens, uses``) and the shares (``source, target_share, max_repeats,
    documents, have_tokens, wanted_tokens, actual_tokens, actual_share, most_uses``).
    """
    name = lambda c: F.lower(F.regexp_replace(F.col(c), r"(?U)^\s+|\s+$", ""))
    w = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0)) if weight else F.lit(1.0)
    docs = documents.select("doc_id", name("source").alias("source"), "tokens", F.when(F.isnan(w), 0.0).otherwise(w).alias("__w"))
    targets = targets.select(name("source").alias("source"), F.col("target_share").cast("double").alias("target_share"), "max_repeats")
    docs = materialize(docs, "mix-tokens")
    placed, sources, size = _allot(docs, targets)
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    odds = (u / (1 - u)) / (F.col("__pi") / (1 - F.col("__pi")))
    key = F.least(F.floor(odds / (1 + odds) * F.lit(float(1 << _BITS))).cast("bigint"), F.lit((1 << _BITS) - 1))
    key = F.when((F.col("__pi") > 0) & F.col("tokens").isNotNull(), key)
    placed = materialize(placed.select("doc_id", "source", "tokens", "__whole", key.alias("__key")), "mix-ranked")
    certain = placed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("__whole")).alias("certain"))
    need = sources.join(certain, "source", "left").select("source", F.greatest(F.lit(0.0), F.col("wanted") - F.coalesce("certain", F.lit(0))).alias("__need"))
    drawn = placed.where(F.col("__key").isNotNull()).select("source", "doc_id", "tokens", "__key")
    first = held(_cut(drawn, need, size), "mix-cut", size)
    # What the document at the cut was too long for is filled by those behind it, in the same order, of at most an eighth of it.
    behind = join_small(drawn, first, ["source"], "inner", size).where(_after("__edge") & (F.col("tokens") * 8 <= F.col("__left"))).select(*drawn.columns)
    second = held(_cut(behind, first.select("source", F.col("__left").alias("__need")), size), "mix-cut", size)
    gap = F.coalesce(second["__left"], first["__left"])
    bounds = first.join(second.withColumnsRenamed({"source": "__s", "__edge": "__two"}), F.col("source") == F.col("__s"), "left").select(
        "source", F.col("__edge").alias("__one"), first["__left"].alias("__gap"), "__two", gap.alias("__open")
    )
    bounds = bounds.join(sources.select("source", F.col("max_repeats").alias("__most")), "source")
    marked = join_small(placed, held(bounds, "mix-bounds", size), ["source"], "left", size)
    taken = ~_after("__one") | (_after("__one") & (F.col("tokens") * 8 <= F.col("__gap")) & ~_after("__two"))
    extra = F.when(F.col("__key").isNotNull() & F.col("__gap").isNotNull() & taken, 1).otherwise(0)
    # What is still open is met best by one further document of its source, if any comes nearer than none.
    off = F.abs(F.col("__open") - F.col("tokens"))
    spare = marked.where((F.col("__open") > 0) & F.col("__key").isNotNull() & (extra == 0) & (F.col("__whole") < F.col("__most")) & (off < F.col("__open")))
    last = spare.groupBy("source").agg(F.min(F.struct(off.alias("o"), F.col("__key").alias("k"), F.col("doc_id").alias("d"))).alias("p"))
    last = held(last.select("source", F.col("p.d").alias("doc_id"), F.lit(1).alias("__more")), "mix-last", size)
    marked = join_small(marked, last, ["source", "doc_id"], "left", size)
    count = F.col("__whole") + F.when(extra == 1, 1).otherwise(F.coalesce("__more", F.lit(0)))
    uses = marked.select("doc_id", "source", "tokens", F.when(F.col("tokens").isNull(), 0).otherwise(count).cast("int").alias("uses"))
    used = uses.groupBy("source").agg(
        F.count("tokens").alias("documents"), F.sum(F.col("tokens") * F.col("uses")).alias("actual_tokens"), F.max("uses").alias("most_uses")
    )
    shares = sources.join(used, "source", "left").select(
        "source",
        "target_share",
        "max_repeats",
        F.coalesce("documents", F.lit(0)).alias("documents"),
        F.col("have").alias("have_tokens"),
        F.col("wanted").alias("wanted_tokens"),
        F.coalesce("actual_tokens", F.lit(0)).alias("actual_tokens"),
        F.when(F.col("all_tokens") > 0, F.coalesce("actual_tokens", F.lit(0)) / F.col("all_tokens")).otherwise(F.lit(0.0)).alias("actual_share"),
        F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
    )
    return uses, shares

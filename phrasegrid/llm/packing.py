"""Filling containers of fixed capacity by minimum bin slack over the multiset of lengths.

Items matter only by length, and lengths lie in 1..capacity, so the histogram of a source (at most ``capacity``
rows however many items it has) is all the planning needs. A bitset subset-sum DP finds the multiset of remaining
lengths that fills a container closest to capacity; the backtracked multiset is then used as often as the
remaining counts allow, so the number of DPs follows the number of distinct lengths, not of items.

Items find their container by their rank among the items of the same source and length. Ranks come from hashed
buckets with cumulative offsets, so a length (or source) that holds a third of all items is spread over all tasks.

Defined results: an item longer than the capacity is cut into full pieces and one rest; no other item is cut.
Items without tokens join the first sequence of their source and take no room. Null lengths are no items. A null
source is a source of its own, named ''. An empty table gives no rows. Repeated ids are items of their own.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize, shuffle_width


def fill_once(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, holding the longest, that fills ``capacity`` best; the smallest lengths are spared."""
    longest = max(counts)
    room = capacity - longest
    chosen = {longest: 1}
    lengths = sorted((n for n in counts if n <= room and counts[n] - (n == longest) > 0), reverse=True)
    reach = [1]
    mask = (1 << (room + 1)) - 1
    for n in lengths:
        bits, left, step = reach[-1], min(counts[n] - (n == longest), room // n), 1
        while left:
            step = min(step, left)
            bits |= (bits << (n * step)) & mask
            left -= step
            step *= 2
        reach.append(bits)
        if bits >> room & 1:
            break
    at = reach[-1].bit_length() - 1
    for k in range(len(reach) - 1, 0, -1):
        n = lengths[k - 1]
        while not reach[k - 1] >> at & 1:
            at -= n
            chosen[n] = chosen.get(n, 0) + 1
    return chosen


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, multiset) until all of ``counts`` is used."""
    left = {n: c for n, c in counts.items() if c > 0}
    out = []
    while left:
        chosen = fill_once(left, capacity)
        times = min(left[n] // m for n, m in chosen.items())
        out.append((times, chosen))
        for n, m in chosen.items():
            left[n] -= m * times
            if not left[n]:
                del left[n]
    return out


def segments(counts: dict[int, int], capacity: int) -> dict[int, tuple[list[int], list[int], list[int]]]:
    """Per length: first ranks, first containers and items a container of the stretches of its ranks."""
    out: dict[int, tuple[list[int], list[int], list[int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for times, chosen in plan({n: c for n, c in counts.items() if n > 0}, capacity):
        for n, m in chosen.items():
            starts, bases, per = out.setdefault(n, ([], [], []))
            starts.append(used.get(n, 0))
            bases.append(base)
            per.append(m)
            used[n] = used.get(n, 0) + times * m
        base += times
    if counts.get(0):
        out[0] = ([0], [0], [counts[0]])
    return out


def pack(items: DataFrame, item_id: str, source: str, tokens: str, capacity: int = 2048) -> DataFrame:
    """``sequence string, <item_id>, piece int, tokens bigint``; sequences are numbered within their source."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    spark = items.sparkSession
    buckets = shuffle_width(spark)
    rows = items.where(F.col(tokens).isNotNull()).select(
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("__source"), F.col(item_id).alias("__id"), F.col(tokens).cast("bigint").alias("__all")
    )
    pieces = rows.select(
        "__source", "__id", "__all", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.col("__all") / capacity)).cast("int") - 1)).alias("__piece")
    ).select(
        "__source",
        "__id",
        "__piece",
        F.least(F.lit(capacity).cast("bigint"), F.col("__all") - F.col("__piece") * F.lit(capacity)).alias("__len"),
        F.pmod(F.xxhash64("__id", "__piece"), F.lit(buckets)).alias("__bucket"),
    )
    stored = materialize(pieces, "pack-pieces")
    cells = stored.groupBy("__source", "__len", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__source", "__len").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0)))

    def planned(pdf: pd.DataFrame) -> pd.DataFrame:
        found = segments(dict(zip(pdf["__len"].tolist(), pdf["__n"].tolist())), capacity)
        name = pdf["__source"].iloc[0]
        return pd.DataFrame(
            [(name, n, *s) for n, s in found.items()], columns=["__source", "__len", "__starts", "__bases", "__per"]
        )

    plans = (
        cells.groupBy("__source", "__len")
        .agg(F.sum("__n").alias("__n"))
        .groupBy("__source")
        .applyInPandas(planned, "__source string, __len bigint, __starts array<bigint>, __bases array<bigint>, __per array<bigint>")
    )
    guide = offsets.join(plans, ["__source", "__len"]).select("__source", "__len", "__bucket", "__offset", "__starts", "__bases", "__per")
    order = Window.partitionBy("__source", "__len", "__bucket").orderBy("__id", "__piece")
    ranked = stored.withColumn("__row", F.row_number().over(order) - 1).join(guide, ["__source", "__len", "__bucket"])
    rank = F.col("__row") + F.col("__offset")
    at = ranked.withColumn("__rank", rank).withColumn("__seg", F.size(F.filter("__starts", lambda s: s <= F.col("__rank"))))
    number = F.element_at("__bases", F.col("__seg")) + F.floor(
        (F.col("__rank") - F.element_at("__starts", F.col("__seg"))) / F.element_at("__per", F.col("__seg"))
    )
    return at.select(
        F.concat_ws("#", "__source", number.cast("string")).alias("sequence"),
        F.col("__id").alias(item_id),
        F.col("__piece").cast("int").alias("piece"),
        F.col("__len").alias("tokens"),
    )

"""Percentiles by radix selection over order-preserving integers.

A double becomes a 64-bit integer of the same order; four 16-bit digits are then histogrammed from the top.
``radix_select`` follows only the digit that holds each wanted rank and ends at the exact value.
``radix_summary`` follows only the digits too full to be left whole and ends at a summary of few cells per
group: summaries of separate partitions or days are combined by putting their cells together.

Rows never move: the prefixes still open are a small table whose measured size lets it be broadcast (beyond the session's
limit it is copied over salts, so that hot groups split), and histograms are grouped counts with map-side partial
aggregation: a group that holds a third of all rows sends at most one row per map task and digit. Each pass reads the
rows once and writes its small result, so no pass is computed twice. Nothing is collected on the driver.

Defined results: null and NaN have no key, and rows without a key are left out; -0.0 counts as 0.0. A null group column is a group value. An empty table gives no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import held, join_small, materialize, measured

DIGITS, WIDTH = 4, 16
_NARROW = 8
_TOP = -(1 << 63)


@F.pandas_udf(T.LongType())
def ordered_key(v: pd.Series) -> pd.Series:
    """Order-preserving signed integer of a double; null for null and NaN (which arrive alike)."""
    import numpy as np

    x = v.to_numpy(dtype="float64", na_value=np.nan) + 0.0
    bits = x.view("int64")
    key = np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)
    return pd.Series(key, dtype="Int64").mask(v.isna())


@F.pandas_udf(T.DoubleType())
def key_value(k: pd.Series) -> pd.Series:
    """The double that ``ordered_key`` came from."""
    import numpy as np

    key = k.to_numpy(dtype="int64", na_value=0)
    bits = np.where(key < 0, key ^ np.int64(0x7FFFFFFFFFFFFFFF), key)
    return pd.Series(bits.view("float64")).mask(k.isna().to_numpy())


def _unsigned(key):
    return key.bitwiseXOR(F.lit(_TOP))


def _prefix(key, level: int, width: int = WIDTH):
    """The top ``level`` digits as an integer (0 digits: 0)."""
    return F.lit(0).cast("bigint") if level == 0 else F.shiftrightunsigned(_unsigned(key), 64 - width * level)


def _digit(key, level: int):
    return F.shiftrightunsigned(_unsigned(key), 64 - WIDTH * (level + 1)).bitwiseAND(F.lit((1 << WIDTH) - 1))


def radix_select(data: DataFrame, groups: list[str], key: str, targets: DataFrame) -> DataFrame:
    """Exact keys at given ranks. ``targets``: ``groups``, ``target string``, ``rank bigint`` (0-based).

    Returns ``groups``, ``target``, ``key bigint``. Ranks beyond a group's rows give no row.
    """
    rows = data.where(F.col(key).isNotNull()).select(*groups, F.col(key).alias("__key"))
    open_ = targets.select(*groups, "target", F.col("rank").alias("__rank"), F.lit(0).cast("bigint").alias("__prefix"))
    open_ = materialize(open_, "radix-ranks")
    size = measured(open_)[1]  # every digit keeps at most these rows, with these fields
    for level in range(DIGITS):
        part = rows.select(*groups, _prefix(F.col("__key"), level).alias("__prefix"), _digit(F.col("__key"), level).alias("__digit"))
        part = join_small(part, open_.select(*groups, "__prefix").distinct(), [*groups, "__prefix"], "left_semi", size)
        hist = part.groupBy(*groups, "__prefix", "__digit").agg(F.count(F.lit(1)).alias("__n"))
        upto = F.sum("__n").over(Window.partitionBy(*groups, "__prefix").orderBy("__digit").rowsBetween(Window.unboundedPreceding, 0))
        hist = hist.withColumn("__upto", upto)
        found = (
            join_small(hist, open_, [*groups, "__prefix"], "inner", size)
            .where((F.col("__rank") < F.col("__upto")) & (F.col("__rank") >= F.col("__upto") - F.col("__n")))
            .select(
                *groups,
                "target",
                (F.col("__rank") - F.col("__upto") + F.col("__n")).alias("__rank"),
                F.shiftleft("__prefix", WIDTH).bitwiseOR(F.col("__digit")).alias("__prefix"),
            )
        )
        open_ = held(found, "radix-ranks", size)
    return open_.select(*groups, "target", F.col("__prefix").bitwiseXOR(F.lit(_TOP)).alias("key"))


def exact_medians(data: DataFrame, groups: list[str], key: str) -> DataFrame:
    """``groups``, ``median``: the mean of the two middle values (one and the same for odd n)."""
    counts = data.where(F.col(key).isNotNull()).groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))
    middle = counts.select(*groups, "n", F.explode(F.array(F.lit("lo"), F.lit("hi"))).alias("target")).withColumn(
        "rank", F.when(F.col("target") == "lo", F.expr("(n - 1) div 2")).otherwise(F.expr("n div 2"))
    )
    found = radix_select(data, groups, key, middle).withColumn("value", key_value("key"))
    return found.groupBy(*groups).agg((F.sum("value") / F.count("value")).alias("median"))


def radix_summary(data: DataFrame, groups: list[str], key: str, rank_error: float = 0.01) -> DataFrame:
    """Cells ``groups, low, high, n`` (low, high: least and greatest key seen in the cell).

    A cell holds at most half ``rank_error`` of its group's rows, or one single value; there are at most about
    12 / ``rank_error`` cells a group, whatever its size. Cells of one summary are disjoint. Digits have 8 bits here:
    an open prefix has at most 256 followers. Group by the day (or partition) as well and combine with ``summary_quantiles``.
    """
    rows = data.where(F.col(key).isNotNull()).select(*groups, F.col(key).alias("__key"))
    # Cells of at most a quarter are made first; neighbours are then put together up to a half.
    width = materialize(rows.groupBy(*groups).agg((F.count(F.lit(1)) * F.lit(rank_error / 4)).alias("__w")), "radix-groups")
    size = measured(width)[1]
    cells: DataFrame | None = None
    open_: DataFrame | None = None
    for level in range(64 // _NARROW):
        part = rows.select(*groups, "__key", _prefix(F.col("__key"), level, _NARROW).alias("__up"))
        if open_ is not None:
            part = join_small(part, open_, [*groups, "__up"], "left_semi")
        hist = part.groupBy(*groups, _prefix(F.col("__key"), level + 1, _NARROW).alias("__up")).agg(
            F.min("__key").alias("low"), F.max("__key").alias("high"), F.count(F.lit(1)).alias("n")
        )
        hist = materialize(join_small(hist, width, groups, "inner", size), "radix-cells")
        done = (F.col("n") <= F.col("__w")) | (F.col("low") == F.col("high"))
        out = hist.where(done).select(*groups, "low", "high", "n", "__w")
        cells = out if cells is None else cells.unionByName(out)
        open_ = hist.where(~done).select(*groups, "__up")
        if open_.isEmpty():
            break
    order = Window.partitionBy(*groups).orderBy("low").rowsBetween(Window.unboundedPreceding, 0)
    heavy = (F.col("n") > F.col("__w")).cast("int")  # one value of many rows: a cell of its own, and a border
    placed = cells.withColumns({"__upto": F.sum("n").over(order), "__heavy": F.sum(heavy).over(order)})
    place = F.struct(F.floor((F.col("__upto") - 1) / F.col("__w")), "__heavy", heavy.alias("own"))
    return placed.groupBy(*groups, place.alias("__place")).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).drop("__place")


def summary_quantiles(cells: DataFrame, groups: list[str], quantiles: dict[str, float]) -> DataFrame:
    """Quantiles of combined summaries: ``groups``, ``n`` and one double per name.

    Each is a value that occurs, whose rank differs from the wanted one by at most the ``rank_error`` the
    summaries were made with, whatever the number of summaries.
    """
    order = Window.partitionBy(*groups).orderBy("high", "low")
    merged = cells.groupBy(*groups, "low", "high").agg(F.sum("n").alias("n"))
    at = merged.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "total", F.sum("n").over(Window.partitionBy(*groups))
    )
    picks = [
        F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.col("total") * q)), F.col("high"))).alias(f"__{name}")
        for name, q in quantiles.items()
    ]
    return (
        at.groupBy(*groups)
        .agg(F.sum("n").alias("n"), *picks)
        .select(*groups, "n", *(key_value(f"__{name}").alias(name) for name in quantiles))
    )


def true_ranks(data: DataFrame, groups: list[str], value: str, given: DataFrame, names: list[str]) -> DataFrame:
    """Rows of ``data`` below and up to each value of ``given`` (``groups``, ``n``, a column a name; a stored table):
    ``groups, name, n, below, upto``. A check of quantiles by counting, in one pass over the rows."""
    rows = join_small(data.select(*groups, F.col(value).alias("__v")).where(F.col("__v").isNotNull()), given, groups)
    counts = [x for k in names for x in (F.count_if(F.col("__v") < F.col(k)).alias(f"__b{k}"), F.count_if(F.col("__v") <= F.col(k)).alias(f"__u{k}"))]
    one = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), *counts)
    each = F.array(*(F.struct(F.lit(k).alias("name"), F.col(f"__b{k}").alias("below"), F.col(f"__u{k}").alias("upto")) for k in names))
    return one.select(*groups, "n", F.explode(each).alias("e")).select(*groups, "e.name", "n", "e.below", "e.upto")

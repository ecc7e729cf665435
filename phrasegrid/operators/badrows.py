"""Rows that fail to parse: term-and-count lines read permissively, the corrupt ones classified by reason.

A line is TERM, white space, COUNT; TERM may be enclosed in double quotes. Lines are parsed by Spark's CSV parser in
permissive mode under an explicit schema that keeps the raw text of records it rejects. Rejected lines, and accepted
ones in which the parser is more lenient than the format (stray quotes, signs, fractions, other digits), are then
checked for quoting, number of fields, cast and term, in that order. All checks are native; only terms outside ASCII and
unified ideographs visit Python, for NFKC. No shuffle, no regular expression that backtracks over a long line.

Defined results: null, blank and comment lines neither load nor fail; repeated lines are judged each for itself;
an empty table gives no rows; other columns are carried along and cannot clash (helpers begin with ``__``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import SPACE, nfkc_term, strip

_PARSED = T.StructType([T.StructField("term", T.StringType()), T.StructField("count", T.LongType()), T.StructField("_corrupt", T.StringType())])
_CSV = {"sep": "\t", "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "maxCharsPerColumn": "-1"}
_LETTER = r"[\p{L}\p{N}]"
_CONTROL = r"[\p{Cc}�]"


def _escaped(c: Column) -> Column:
    """Doubled quotes, from the left, taken out of the way (one character stands for each of the two)."""
    return F.replace(c, F.lit('""'), F.lit("\u0001\u0001"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _reclassified(line: Column) -> Column:
    """Struct ``term, count, reason`` of a line: an enclosed term ends at the first quote that is no doubled one."""

    def split(x: Column) -> Column:
        opened, body, line = x["opened"], x["body"], x["line"]
        close = F.locate('"', _escaped(body))
        rest = F.when(opened, F.substring(body, close + 1, F.length(body))).otherwise(F.regexp_replace(line, f"^[^{SPACE[1:-1]}]+", ""))
        inner = F.replace(F.substring(body, F.lit(1), close - 1), F.lit('""'), F.lit('"'))
        term = F.when(opened, inner).otherwise(F.regexp_extract(line, f"^[^{SPACE[1:-1]}]+", 0))
        stray = F.when(opened, close == 0).otherwise(line.contains('"'))
        return F.struct(term.alias("term"), rest.alias("after"), stray.alias("stray"), opened.alias("opened"))

    def judge(x: Column) -> Column:
        after = x["after"]
        quoting = x["stray"] | (x["opened"] & (after.contains('"') | ((after != "") & ~after.rlike(f"^{SPACE}"))))
        return F.struct(x["term"].alias("term"), strip(after).alias("rest"), quoting.alias("quoting"))

    def cast(x: Column) -> Column:
        rest = x["rest"]
        number = F.when(rest.rlike(r"^[0-9]+\z"), rest.try_cast("bigint"))
        reason = (
            F.when(x["quoting"], "quoting").when((rest == "") | rest.rlike(SPACE), "columns").when(F.coalesce(number, F.lit(0)) < 1, "count")
        )
        return F.struct(x["term"].alias("term"), number.alias("count"), reason.alias("reason"))

    start = F.struct(line.startswith('"').alias("opened"), F.substring(line, F.lit(2), F.length(line)).alias("body"), line.alias("line"))
    return _let(_let(_let(start, split), judge), cast)


def classify_lines(df: DataFrame, value: str, keep_skipped: bool = False) -> DataFrame:
    """``df`` with ``__reason`` ('quoting', 'columns', 'count', 'term', null for good lines), ``__term`` and ``__count``.

    Skipped lines (null, blank, comment) are gone, or with ``keep_skipped`` stay, told by ``__skipped`` and without reason or term.
    """
    # Each explode gives one row or none: unlike a filter or a projection it is never merged with its neighbours,
    # so that no expression (and no visit to Python) is computed twice.
    line = strip(F.regexp_replace(F.col(value), "^﻿", ""))
    counts = lambda x: x.isNotNull() & (x != "") & ~x.startswith("#")
    lines = F.transform(F.array(line), lambda x: F.when(counts(x), x)) if keep_skipped else F.filter(F.array(line), counts)
    rows = df.select(*df.columns, F.explode(lines).alias("__line"))
    # Permissive read: runs of white space are the separator, inside quotes they are irrelevant (terms have none in the end).
    parsed = F.from_csv(F.regexp_replace("__line", f"{SPACE}+", "\t"), _PARSED.simpleString(), _CSV)
    line = F.col("__line")

    def accept(csv: Column) -> Column:
        clean = (
            csv["_corrupt"].isNull() & (F.coalesce(csv["count"], F.lit(0)) > 0) & ~line.contains('"') & line.rlike(f"{SPACE}[0-9]{{1,19}}\\z")
        )
        good = F.struct(csv["term"].alias("term"), csv["count"].alias("count"), F.lit(None).cast("string").alias("reason"))
        return F.when(line.isNotNull(), F.when(clean, good).otherwise(_reclassified(line)))

    rows = rows.select(*df.columns, F.explode(F.transform(F.array(parsed), accept)).alias("__judged"))
    structure = F.col("__judged.reason")
    rows = rows.select(*df.columns, "__judged", nfkc_term(F.when(structure.isNull(), F.col("__judged.term"))).alias("__norm"))
    bad_term = (F.col("__norm") == "") | ~F.col("__norm").rlike(_LETTER) | F.col("__norm").rlike(_CONTROL)
    reason = F.when(structure.isNotNull(), structure).when(bad_term, "term")
    rows = rows.select(*df.columns, "__judged", "__norm", reason.alias("__reason"))
    good = F.col("__reason").isNull()
    skipped = [F.col("__judged").isNull().alias("__skipped")] if keep_skipped else []
    return rows.select(*df.columns, *skipped, "__reason", F.when(good, F.col("__norm")).alias("__term"), F.when(good, F.col("__judged.count")).alias("__count"))


def rejected(df: DataFrame, value: str) -> DataFrame:
    """Failed lines: the columns of ``df`` and ``reason``."""
    rows = classify_lines(df, value)
    return rows.select(*df.columns, F.explode(F.filter(F.array("__reason"), lambda r: r.isNotNull())).alias("reason"))


def loaded(df: DataFrame, value: str) -> DataFrame:
    """Good lines: the other columns of ``df``, ``term`` (NFKC, no white space) and ``count bigint``."""
    keep = [c for c in df.columns if c not in (value, "term", "count")]
    entry = F.when(F.col("__reason").isNull(), F.array(F.struct(F.col("__term").alias("term"), F.col("__count").alias("count"))))
    return classify_lines(df, value).select(*keep, F.explode(entry).alias("__e")).select(*keep, "__e.term", "__e.count")

"""Text normalisers. Each has a native path for text on which normalisation is the identity, and an Arrow path for the rest."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A class of all characters with the Unicode property White_Space.
SPACE = "[\\t-\\r \\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
#: Characters whose NFKC form is themselves: printable ASCII and the unified ideographs.
_INERT = r"^[\x21-\x7e㐀-䶿一-鿿]*\z"
_INERT_SPACED = r"^[\t-\r\x20-\x7e㐀-䶿一-鿿]*\z"


def strip(c: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(F.regexp_replace(c, f"^{SPACE}+", ""), f"(?<!{SPACE}){SPACE}+\\z", "")


def _plain_or(c: Column, inert: str, native, function) -> Column:
    plain = c.rlike(inert)

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else function(x))

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    udf = F.pandas_udf(run, T.StringType())
    return F.when(plain, native(c)).otherwise(udf(F.when(~plain, c)))


def _term(x: str) -> str:
    return "".join(unicodedata.normalize("NFKC", x).split())


def _folded(x: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", x).casefold().split())


def _aligned(x: str) -> str:
    return "".join(ch for ch in unicodedata.normalize("NFKC", x).casefold() if ch.isalnum())


def nfkc_term(c: Column) -> Column:
    """Catalog terms and transcripts: NFKC, all white space removed, case kept."""
    return _plain_or(c, _INERT, lambda x: x, _term)


def match_text(c: Column) -> Column:
    """Matching and metrics: NFKC, case folded, white space collapsed to single blanks and trimmed."""
    return _plain_or(c, _INERT_SPACED, lambda x: F.trim(F.regexp_replace(F.lower(x), r"[\t-\r ]+", " ")), _folded)


def alignment_text(c: Column) -> Column:
    """Alignment: NFKC, case folded, only letters and digits."""
    return _plain_or(c, _INERT_SPACED, lambda x: F.regexp_replace(F.lower(x), r"[^a-z0-9㐀-䶿一-鿿]", ""), _aligned)


def safe_id(c: Column) -> Column:
    """Runs of other characters than ASCII letters, digits, '_', '.', '-' become '_'; none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, "[^0-9A-Za-z_.-]+", "_"), r"^_+|_+\z", "")


def stable_id(prefix: str, normalized: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(normalized, 256), 1, 16))


def script_term(c: Column, low: int = 2, high: int = 8, script: str = "㐀-䶿一-鿿") -> Column:
    """All characters of one script (default: Han) and ``low`` to ``high`` of them."""
    return c.rlike(f"^[{script}]{{{low},{high}}}\\z")


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two arrays."""
    same = F.transform(F.arrays_zip(F.slice(a, 1, F.size(b)).alias("x"), F.slice(b, 1, F.size(a)).alias("y")), lambda p: p["x"].eqNullSafe(p["y"]))
    first = F.array_position(same, False)
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def text_blocks(df: DataFrame, keep: list[str], text: str, overlap: int, size: int = 256) -> DataFrame:
    """``keep``, ``block_start`` (0-based) and ``block`` of ``size`` characters and ``overlap`` of the next block.

    Finding a character costs time by its distance from the start of the string, so a long text is cut twice: into
    pieces of 64 blocks, then into blocks. Every position of a text is the start of exactly one place in one block.
    """

    def cut(rows: DataFrame, column: str, base, width: int) -> DataFrame:
        at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(column) - F.lit(1)), F.lit(width))
        rows = rows.select(*keep, column, *([base] if base else []), F.explode(at).alias("__at"))
        start = F.col("__at") + F.col(base) if base else F.col("__at")
        piece = F.substring(F.col(column), F.col("__at") + 1, F.lit(width + overlap))
        return rows.select(*keep, start.alias("block_start"), piece.alias("block"), F.least(F.lit(width), F.length(column) - F.col("__at")).alias("__own"))

    pieces = cut(df.select(*keep, text), text, None, 64 * size)
    # Of a piece only its own characters start blocks; what overlaps belongs to the next piece.
    at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("__own") - 1), F.lit(size))
    rows = pieces.select(*keep, "block", "block_start", "__own", F.explode(at).alias("__at"))
    own = F.least(F.lit(size), F.col("__own") - F.col("__at"))
    return rows.select(*keep, (F.col("block_start") + F.col("__at")).alias("block_start"), F.substring(F.col("block"), F.col("__at") + 1, own + overlap).alias("block"), own.alias("own"))


def grams(n: int, text: str = "block", own: str | None = "own") -> Column:
    """Array of (i, g): substrings of ``n`` characters that start at the block's own places (all places without ``own``)."""
    last = F.length(text) - n + 1
    last = F.least(last, F.col(own)) if own else last
    places = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct((i - 1).alias("i"), F.substring(F.col(text), i, F.lit(n)).alias("g")))

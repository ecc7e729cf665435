"""Exact search of embedding keys: greatest similarity over frames, best variant of a phrase, top K.

Similarity has no equi-key, so a stated set of frames meets all keys in blocks: one task multiplies a bounded block
of frames by a bounded block of keys, and only its k best phrases a unit go on. Nothing is broadcast or collected,
and the index may be larger than any executor.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1.1920929e-07


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """Unit vectors; a zero vector stays zero."""
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(EPS))
    return F.transform(v, lambda x: x.cast("double") / norm)


def half_precision(keys: DataFrame, column: str) -> DataFrame:
    """Keys rounded through 16-bit floats, as a compact index stores them."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else np.asarray(v, dtype=np.float16).astype(np.float32))

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return keys.withColumn(column, F.pandas_udf(run, "array<float>")(F.col(column)))


def check_dimensions(df: DataFrame, column: str) -> int:
    """The one length of all vectors; raises on several or on empty vectors."""
    sizes = [r[0] for r in df.select(F.size(column).alias("n")).distinct().limit(2).collect()]
    if len(sizes) > 1 or (sizes and sizes[0] < 1):
        raise ValueError(f"vectors of different or no length: {sizes}")
    return sizes[0] if sizes else 0


def _best(scored: DataFrame, unit: list[str], k: int) -> DataFrame:
    """Per unit: best variant of each phrase (ties: smaller variant), then the k best phrases (ties: smaller id)."""
    one = scored.groupBy(*unit, "hotword_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "variant", "peak_frame")).alias("b"))
    w = Window.partitionBy(*unit).orderBy(F.col("b.s"), "hotword_id")
    ranked = one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(*unit, "hotword_id", (-F.col("b.s")).alias("score"), "rank", F.col("b.peak_frame").alias("peak_frame"), F.col("b.variant").alias("variant"))


def _kernel(unit: list[str], k: int, decimals: int):
    """One block of frames against one block of keys; at most k phrases a unit leave it."""

    def run(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = [*unit, "hotword_id", "variant", "score", "peak_frame"]
        if left.empty or right.empty:
            return pd.DataFrame(columns=names)
        left = left.sort_values([*unit, "frame"], kind="stable").reset_index(drop=True)
        right = right.sort_values(["hotword_id", "variant"], kind="stable").reset_index(drop=True)
        s = (np.array(left["vec"].tolist(), dtype=np.float64) @ np.array(right["key"].tolist(), dtype=np.float64).T).round(decimals)
        frame = left["frame"].to_numpy()
        codes = left.groupby(unit, sort=False, dropna=False).ngroup().to_numpy()
        begin = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        end = np.r_[begin[1:], len(codes)]
        phrase = right["hotword_id"].to_numpy()
        first = np.flatnonzero(np.r_[True, phrase[1:] != phrase[:-1]])
        owner = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(phrase)]))
        variant = right["variant"].to_numpy()
        out = []
        for b, e in zip(begin, end):
            top, at = s[b:e].max(axis=0), frame[b + s[b:e].argmax(axis=0)]
            score = np.maximum.reduceat(top, first)
            hit = np.flatnonzero(top == score[owner])
            which = hit[np.unique(owner[hit], return_index=True)[1]]  # the first of equal variants
            order = np.argsort(-score, kind="stable")[:k]
            values = {u: [left.loc[b, u]] * len(order) for u in unit}
            out.append(pd.DataFrame(values | {"hotword_id": phrase[first[order]], "variant": variant[which[order]], "score": score[order], "peak_frame": at[which[order]]}))
        return pd.concat(out)[names]

    return run


def _growing(best: DataFrame, unit: list[str], k: int) -> DataFrame:
    """From every chunk's own top k, that of all chunks up to it.

    A phrase among the k best so far is among the k best of the chunk where it scored highest: whatever beats it there beats
    it in all. So a stream is read in order of its chunks, at most k rows each, and only the k best so far are held.
    """
    stream, names = unit[:-1], best.columns
    ordered = (best.repartition(*stream) if stream else best.coalesce(1)).sortWithinPartitions(*unit, "rank")
    place = lambda h: (-h[1], h[0])

    def run(batches):
        current, chunk, so_far, out = None, None, {}, []

        def close() -> None:
            nonlocal so_far
            kept = sorted(so_far.values(), key=place)[:k]
            so_far = {h[0]: h for h in kept}
            out.extend((*current, chunk, h[0], h[1], r, h[3], h[2]) for r, h in enumerate(kept, 1))

        for pdf in batches:
            for row in pdf.itertuples(index=False, name=None):
                where, at = tuple(None if v != v else v for v in row[: len(stream)]), row[len(stream)]
                if current is not None and (where, at) != (current, chunk):
                    close()
                if where != current:
                    so_far = {}
                current, chunk = where, at
                phrase, score, _, frame, variant = row[len(unit) :]
                new, old = (phrase, score, variant, frame), so_far.get(phrase)
                if old is None or (-score, variant, frame) < (-old[1], old[2], old[3]):
                    so_far[phrase] = new
            yield pd.DataFrame(out, columns=names)
            out.clear()
        if current is not None:
            close()
            yield pd.DataFrame(out, columns=names)

    return ordered.mapInPandas(run, best.schema)


def search_blocks(
    frames: DataFrame, keys: DataFrame, unit: list[str], k: int, frame_rows: int = 4096, key_rows: int = 16384, decimals: int = 6, growing: bool = False
) -> DataFrame:
    """Top ``k`` phrases of every unit, by matrix products of blocks: ``unit, hotword_id, score, rank, peak_frame, variant``.

    ``frames``: ``unit, frame int, vec``; ``keys``: ``hotword_id, variant, key``; vectors normalised beforehand.
    All variants of a phrase are in one key block. Frames of a unit are spread over all frame blocks: a phrase of the whole
    top k is in the top k of the block that holds its best frame, so only k rows a unit and block are shuffled on. Each side is sent once per block of the other.
    With ``growing`` the last column of ``unit`` is a chunk: a chunk's result is that of all frames up to it (see
    ``_growing``). Similarities are rounded to ``decimals``.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    check_dimensions(keys, "key")
    frame_blocks = max(1, -(-frames.count() // frame_rows))
    key_blocks = max(1, -(-keys.count() // key_rows))
    left = frames.select(*unit, "frame", "vec").withColumns(
        {"__f": F.pmod(F.xxhash64(*unit, "frame"), F.lit(frame_blocks)), "__k": F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(key_blocks - 1).cast("bigint")))}
    )
    right = keys.select("hotword_id", F.coalesce("variant", F.lit("")).alias("variant"), "key").withColumns(
        {"__k": F.pmod(F.xxhash64("hotword_id"), F.lit(key_blocks)), "__f": F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(frame_blocks - 1).cast("bigint")))}
    )
    types = dict(frames.dtypes)
    schema = ", ".join(f"{u} {types[u]}" for u in unit) + ", hotword_id string, variant string, score double, peak_frame int"
    found = left.groupBy("__f", "__k").cogroup(right.groupBy("__f", "__k")).applyInPandas(_kernel(unit, k, decimals), schema)
    best = _best(found, unit, k)
    return _growing(best, unit, k) if growing else best


def search_native(frames: DataFrame, keys: DataFrame, unit: list[str], k: int, decimals: int = 6, blocks: int = 8) -> DataFrame:
    """The same in the JVM, as the plain statement the block way is tested against: keys are spread over ``blocks`` and
    every frame is sent to each of them."""
    left = frames.withColumn("__b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    right = keys.withColumn("__b", F.pmod(F.xxhash64("hotword_id"), F.lit(blocks)))
    s = F.round(dot(F.col("vec"), F.col("key")), decimals)
    pairs = left.join(right, "__b").select(*unit, "hotword_id", "variant", "frame", s.alias("score"))
    top = pairs.groupBy(*unit, "hotword_id", "variant").agg(F.max(F.struct("score", (-F.col("frame")).alias("f"))).alias("m"))
    return _best(top.select(*unit, "hotword_id", "variant", F.col("m.score").alias("score"), (-F.col("m.f")).alias("peak_frame")), unit, k)


def nested_hits(hits: DataFrame, unit: list[str]) -> DataFrame:
    """One row per unit with its hits as an array ordered by rank."""
    h = F.struct("rank", "hotword_id", "score", "peak_frame", "variant")
    return hits.groupBy(*unit).agg(F.sort_array(F.collect_list(h)).alias("hits"))


def save_index(keys: DataFrame, path: str, version: str) -> None:
    """Keys as Parquet, with a one-row sidecar: version, phrases, variants, dimensions."""
    keys.write.mode("errorifexists").parquet(f"{path}/keys")
    meta = keys.agg(F.count_distinct("hotword_id").alias("hotword_count"), F.count(F.lit(1)).alias("variant_count"), F.max(F.size("key")).alias("dim"))
    meta.select(F.lit("phrase-index-1").alias("format"), F.lit(version).alias("catalog_version"), "*").coalesce(1).write.json(f"{path}/meta")


def load_index(spark, path: str) -> DataFrame:
    """Keys as they were saved, not normalised again."""
    meta = spark.read.json(f"{path}/meta").first()
    if meta is None or meta["format"] != "phrase-index-1":
        raise ValueError("not a phrase index")
    return spark.read.parquet(f"{path}/keys")

"""Severity of abusive, hateful or sexual passages by cumulative-link ordinal regression.

A text is normalised against masking (width, look-alike letters, zero-width characters, spaced or dotted letters,
digits for letters, stretched letters), cut into passages at sentence ends and, where punctuation is lost, into
overlapping windows. A passage's score is the sum of the weights of its hashed character n-grams; a text's score is
that of its worst passage, so one sentence in a text of any length counts fully. P(grade > k) = sigmoid(score - cut_k):
all thresholds share the weights, the cuts are ordered by construction, expected severity = sum over k of P(grade > k).

Grades come from the raters: 0 none flagged the text, 1 they disagree, 2 all flagged it. Grade 1 is doubt, not mildness:
``severity`` (0 to 2) says how sure raters would be that a text is abusive, not how bad it is.

Defined results: null text has null severity and is not flagged; empty text has the least severity. Labels other
than 0 and 1, with null ids or of unknown texts are left out, repeated ones count once. Without any labelled text of
both sorts nothing can be learnt and every text has severity 0. An empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import spread

ORDERS = (1, 2, 3, 4, 6)
BITS = 18
GRADES = 3
BLOCK, OVERLAP = 250_000, 200  # long texts are scored in overlapping blocks
LOWEST = -30.0
WIDE, NARROW = 56, 28  # window lengths in code points, of alphabetic and of ideographic text

# Cyrillic and Greek letters that look like Latin ones, after case folding.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ո": "n", "α": "a", "ο": "o", "ε": "e", "ι": "i", "ν": "v",
    "ρ": "p", "τ": "t", "υ": "u", "κ": "k",
}
# Signs written for letters.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_ASCII_ODD = re.compile(r"[^\x00-\x7f一-鿿，。！？、：；“”‘’（）《》…—　]")
_ZERO = re.compile("[­᠎​-‏‪-‮⁠-⁤︀-️﻿]")
_LOOK = re.compile("[" + "".join(LOOKALIKES) + "]")
_SPACED = re.compile(r"(?<![a-z0-9])[a-z0-9@$](?:[ ._\-·*]{1,2}[a-z0-9@$](?![a-z0-9])){2,}")
_SIGN = re.compile(r"(?<=[a-z])[013457@$!]+(?=[a-z])")
_HANGAP = re.compile(r"(?<=[一-鿿])[._\-·/|~^+*]{1,2}(?=[一-鿿])")
_STRETCH = re.compile(r"([a-z])\1+")
_DIGITS = re.compile(r"[0-9]+")
_STARS = re.compile(r"\*+")
_TAG = re.compile(r"\[[0-9:. ]+\]")
_ENDS = np.array([ord(c) for c in "\n\r。！？!?；;"], dtype=np.uint32)


def normalize(text: str) -> str:
    t = text
    if _ASCII_ODD.search(t):
        t = unicodedata.normalize("NFKC", t)
        t = _ZERO.sub("", t)
    t = t.casefold()
    if _LOOK.search(t):
        t = _LOOK.sub(lambda m: LOOKALIKES[m.group()], t)
    t = _TAG.sub("\n", t)
    t = _SPACED.sub(lambda m: re.sub(r"[ ._\-·*]+", "", m.group()), t)
    t = _SIGN.sub(lambda m: "".join(SIGNS[c] for c in m.group()), t)
    t = _HANGAP.sub("*", t)
    t = _STARS.sub("*", t)
    t = _STRETCH.sub(r"\1", t)
    return _DIGITS.sub("0", t)


@dataclass
class Windows:
    """N-gram buckets of every position (the last bucket is void), and the windows with their texts."""

    buckets: list[np.ndarray]
    begin: np.ndarray
    end: np.ndarray
    owner: np.ndarray


def featurize(texts: list[str]) -> Windows:
    parts = [normalize(t) for t in texts]
    joined = "\n".join(parts) + "\n"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    size = len(code)
    ends = np.zeros(size, dtype=bool)
    for c in _ENDS:
        ends |= code == c
    ends[:-1] |= (code[:-1] == 46) & (code[1:] == 32)
    at = np.arange(size, dtype=np.int32)
    stop = np.flatnonzero(ends)
    since = np.zeros(size, dtype=np.int32)
    since[stop[:-1] + 1] = stop[:-1] + 1
    np.maximum.accumulate(since, out=since)
    run = at - since + 1
    run[ends] = 0
    del at, since
    buckets = []
    h = code * np.uint32(0x9E3779B1)
    rolled, n = h.copy(), 1
    for order in ORDERS:
        while n < order:
            nxt = np.empty_like(rolled)
            nxt[0] = 0
            np.multiply(rolled[:-1], np.uint32(0x01000193), out=nxt[1:])
            nxt += h
            rolled, n = nxt, n + 1
        mixed = rolled ^ (rolled >> np.uint32(15))
        mixed = mixed * np.uint32((0x85EBCA6B + 2 * order * 0x1003F) & 0xFFFFFFFF)
        b = (mixed >> np.uint32(32 - BITS)).astype(np.int32)
        b[run < order] = 1 << BITS
        buckets.append(b)
    begin = np.concatenate(([0], stop[:-1] + 1))
    end = stop
    keep = end > begin
    begin, end = begin[keep], end[keep]
    han = np.concatenate(([0], np.cumsum((code >= 0x4E00) & (code <= 0x9FFF))))
    length = end - begin
    width = np.where((han[end] - han[begin]) * 2 > length, NARROW, WIDE)
    count = np.maximum(1, -(-(length - width) // (width // 2)) + 1)
    which = np.repeat(np.arange(len(begin)), count)
    step = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    b = begin[which] + step * (width[which] // 2)
    e = np.minimum(end[which], b + width[which])
    bounds = np.cumsum([len(p) + 1 for p in parts])
    owner = np.searchsorted(bounds, b, side="right")
    return Windows(buckets, b, e, owner)


@dataclass
class Model:
    weights: np.ndarray
    cuts: np.ndarray

    def window_scores(self, w: Windows) -> np.ndarray:
        total = np.zeros(len(w.buckets[0]) + 1)
        g = self.weights[0][w.buckets[0]]
        for k in range(1, len(ORDERS)):
            g = g + self.weights[k][w.buckets[k]]
        np.cumsum(g, dtype=np.float64, out=total[1:])
        return total[w.end] - total[w.begin]

    def scores(self, texts: list[str]) -> np.ndarray:
        """Score of the worst passage; a text without passages scores lowest. Memory is that of ``BLOCK`` characters."""
        out = np.full(len(texts), LOWEST)
        block: list[str] = []
        owner: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            for at in range(0, max(1, len(text) - OVERLAP), BLOCK):
                part = text[at : at + BLOCK + OVERLAP]
                if block and size + len(part) > BLOCK:
                    self._add(block, owner, out)
                    block, owner, size = [], [], 0
                block.append(part)
                owner.append(i)
                size += len(part)
        if block:
            self._add(block, owner, out)
        return out

    def _add(self, block: list[str], owner: list[int], out: np.ndarray) -> None:
        w = featurize(block)
        if len(w.begin):
            first = np.concatenate(([0], np.flatnonzero(np.diff(w.owner)) + 1))
            best = np.maximum.reduceat(self.window_scores(w), first)
            np.maximum.at(out, np.array(owner)[w.owner[first]], best)

    def severity(self, scores: np.ndarray) -> np.ndarray:
        return sum(_sigmoid(scores - c) for c in self.cuts)

    def exceeds(self, scores: np.ndarray, grade: int) -> np.ndarray:
        return _sigmoid(scores - self.cuts[grade - 1])


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def _gradients(score: np.ndarray, grade: np.ndarray, cuts: np.ndarray, weight: np.ndarray):
    """Of the cumulative-link loss -log P(grade): by each score, and by the cuts."""
    over = [np.ones_like(score), *(_sigmoid(score - c) for c in cuts), np.zeros_like(score)]  # P(grade > k - 1)
    by_score = np.zeros_like(score)
    by_cut = np.zeros(len(cuts))
    for k in range(GRADES):
        own = grade == k
        hi, lo = over[k][own], over[k + 1][own]
        p = np.maximum(hi - lo, 1e-9)
        d_hi, d_lo = hi * (1 - hi), lo * (1 - lo)
        by_score[own] = -(d_hi - d_lo) / p
        if k:
            by_cut[k - 1] += np.sum(weight[own] * d_hi / p)
        if k < len(cuts):
            by_cut[k] -= np.sum(weight[own] * d_lo / p)
    return by_score * weight, by_cut


def _start(w: Windows, grades: np.ndarray, weight: np.ndarray, support: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of n-grams that speak for the highest grade, and which n-grams stand in enough texts to be used at all."""
    void, n = 1 << BITS, len(grades)
    top = grades == GRADES - 1
    size1, size0 = max(1.0, weight[top].sum()), max(1.0, weight[~top].sum())
    owner_at = np.zeros(len(w.buckets[0]), dtype=np.int32)
    owner_at[w.begin] = w.owner
    np.maximum.accumulate(owner_at, out=owner_at)
    weights = np.zeros((len(ORDERS), void + 1), dtype=np.float32)
    usable = np.zeros((len(ORDERS), void + 1), dtype=bool)
    edge = np.searchsorted(owner_at, np.arange(n + 1))
    for k, b in enumerate(w.buckets):
        n1, n0 = np.zeros(void + 1), np.zeros(void + 1)
        for d in range(n):  # a text counts once for each of its n-grams
            (n1 if top[d] else n0)[np.unique(b[edge[d] : edge[d + 1]])] += weight[d]
        n1, n0 = n1[:void], n0[:void]
        usable[k, :void] = n0 + n1 >= support
        odds = np.log((n1 + 0.5) / (size1 + 1)) - np.log((n0 + 0.5) / (size0 + 1))
        sure = odds - 1.5 * np.sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5))  # a lower bound: names met by chance get nothing
        weights[k, :void] = np.where(usable[k, :void], np.maximum(sure, 0), 0) * scale
    return weights, usable


def fit(
    texts: list[str], grades: np.ndarray, weight: np.ndarray, epochs: int = 30, rate: float = 0.1, decay: float = 5e-4,
    trim: float = 0.1, support: int = 3, scale: float = 0.3, settle: int = 5, least: float = -0.3,
) -> Model:
    """Multiple-instance fit: each epoch, the worst window of a text carries its gradient (Adagrad).

    After ``settle`` epochs, labels that the model contradicts (probability under ``trim``) rest for the epoch:
    raters err, and their errors would be learnt by heart. N-grams of fewer than ``support`` texts are not used.
    """
    w = featurize(texts)
    weights, usable = _start(w, grades, weight, support, scale)
    model = Model(weights, np.array([2.0, 2.5]))
    if not len(w.begin):
        return model
    squares, cut_squares = np.full_like(weights, 1e-2), np.full(GRADES - 1, 1e-2)
    first = np.concatenate(([0], np.flatnonzero(np.diff(w.owner)) + 1))
    spans = np.diff(np.concatenate((first, [len(w.owner)])))
    docs = w.owner[first]
    y, full = grades[docs], weight[docs].astype(np.float64)
    for epoch in range(epochs):
        s = model.window_scores(w)
        best = np.maximum.reduceat(s, first)
        hit = np.flatnonzero(s == np.repeat(best, spans))
        worst = hit[np.unique(w.owner[hit], return_index=True)[1]]
        v = full
        if epoch >= settle:
            high = model.exceeds(best, GRADES - 1)
            v = np.where(((y == GRADES - 1) & (high < trim)) | ((y == 0) & (high > 1 - trim / 3)), 0.0, full)
        by_score, by_cut = _gradients(best, y, model.cuts, v)
        live = np.abs(by_score) > 1e-3
        b, length = w.begin[worst[live]], (w.end - w.begin)[worst[live]]
        at = np.repeat(b - (np.cumsum(length) - length), length) + np.arange(length.sum())
        part = np.repeat(by_score[live], length)
        for k, bucket in enumerate(w.buckets):
            f, where = np.unique(bucket[at], return_inverse=True)
            g = np.bincount(where, weights=part, minlength=len(f)) + decay * len(docs) * weights[k, f]
            squares[k, f] += g * g
            weights[k, f] -= np.where(usable[k, f], rate * g / np.sqrt(squares[k, f]), 0).astype(np.float32)
            weights[k, f] = np.maximum(weights[k, f], least)
        cut_squares += by_cut * by_cut
        model.cuts = model.cuts - rate * by_cut / np.sqrt(cut_squares)
        model.cuts[1:] = np.maximum(model.cuts[1:], model.cuts[:-1] + 0.05)
    return model


def graded(labels: DataFrame) -> DataFrame:
    """``doc_id, grade int`` from ``doc_id, flagged, rater``."""
    votes = labels.where(F.col("doc_id").isNotNull() & F.col("flagged").isin(0, 1)).select("doc_id", "rater", "flagged").distinct()
    share = votes.groupBy("doc_id").agg(F.avg("flagged").alias("share"))
    return share.select("doc_id", F.when(F.col("share") == 0, 0).when(F.col("share") == 1, 2).otherwise(1).alias("grade"))


def sample(documents: DataFrame, labels: DataFrame, max_flagged: int = 3000, max_plain: int = 5000, max_total: int = 16_000_000) -> DataFrame | None:
    """``doc_id, text, grade`` of a bounded sample of labelled texts of any length, chosen by a hash of the id: at most ``max_flagged`` that
    some rater flagged and ``max_plain`` others, of at most ``max_total`` characters in all. A text that no longer fits
    in what those before it leave of the total is passed over."""
    texts = documents.where(F.col("text").isNotNull()).select("doc_id", "text")
    g = graded(labels).withColumn("__h", F.xxhash64("doc_id", F.lit(7)))
    g = g.join(texts.select("doc_id", F.length("text").alias("__n")), "doc_id")
    drawn = g.where("grade > 0").orderBy("__h", "doc_id").limit(max_flagged).unionByName(g.where("grade = 0").orderBy("__h", "doc_id").limit(max_plain))
    left, taken = max_total, []
    for r in sorted(drawn.collect(), key=lambda r: (r["__h"], r["doc_id"])):
        if r["__n"] <= left:
            left -= r["__n"]
            taken.append((r["doc_id"], r["grade"]))
    if not taken:
        return None
    chosen = documents.sparkSession.createDataFrame(taken, T.StructType([g.schema["doc_id"], g.schema["grade"]]))
    return texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "grade")


def train(documents: DataFrame, labels: DataFrame, **bounds) -> Model | None:
    """Fit on a bounded ``sample``.

    The ids of the sample pass the driver (at most 8,000), its texts go to the one task that fits (at most 16 million
    characters, at about 83 bytes each: 0.55 GB for 6.7 million, 1.3 GB at most), and the model comes back (5 MB). None of
    these grows with the tables.
    """
    rows = sample(documents, labels, **bounds)
    if rows is None:
        return None

    def run(batches):
        t = pa.Table.from_batches(list(batches))
        if not t.num_rows:
            return
        order = np.argsort(t.column("doc_id").to_numpy(), kind="stable")
        found, grades = t.column("text").to_pylist(), t.column("grade").to_numpy()[order]
        if (grades == 0).any() and (grades == GRADES - 1).any():
            model = fit([found[i] for i in order], grades, np.ones(len(order)))
            yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.cuts.tolist()], pa.list_(pa.float64()))], names=["weights", "cuts"])

    # The fit has a task of its own; only the weights (5 MB) come to the driver.
    fitted = rows.repartition(1).mapInArrow(run, "weights binary, cuts array<double>").first()
    if fitted is None:
        return None
    return Model(np.frombuffer(bytes(fitted["weights"]), dtype=np.float32).reshape(len(ORDERS), -1), np.array(fitted["cuts"]))


def score(documents: DataFrame, model: Model | None, keep: list[str], threshold: float = 0.5) -> DataFrame:
    """Columns ``keep``, ``severity double`` (0..2) and ``flagged int``: 1 if P(grade 2) is at least ``threshold``."""
    spark = documents.sparkSession
    rows = spread(documents.select(*keep, "text"))
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            if m is None:
                severity, flagged = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int32)
            else:
                s = m.scores([t or "" for t in texts])
                severity, flagged = m.severity(s), (m.exceeds(s, GRADES - 1) >= threshold).astype(np.int32)
            none = np.array([t is None for t in texts], dtype=bool)
            flagged[none] = 0
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(severity, pa.float64(), mask=none), pa.array(flagged, pa.int32())],
                names=[*keep, "severity", "flagged"],
            )

    schema = T.StructType([*(rows.schema[k] for k in keep), T.StructField("severity", T.DoubleType()), T.StructField("flagged", T.IntegerType())])
    return rows.mapInArrow(run, schema)


def rates(scored: DataFrame) -> DataFrame:
    """Per source (trimmed, lower-cased): texts, flagged, rate and mean severity."""
    source = F.lower(F.regexp_replace("source", r"(?U)^\s+|\s+$", ""))
    return scored.groupBy(source.alias("source")).agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum("flagged").alias("flagged"),
        F.avg("flagged").alias("rate"),
        F.avg("severity").alias("mean_severity"),
    )

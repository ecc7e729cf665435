import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from phrasegrid.llm import quantiles, topn


def best(rows, n):
    out = {}
    for g, c, item, score in rows:
        if item is not None and score is not None and score == score:
            d = out.setdefault((g, c), {})
            d[item] = max(d.get(item, -math.inf), score + 0.0)
    return sorted(((*g, i, p) for g, d in out.items() for p, (i, _) in enumerate(sorted(d.items(), key=lambda x: (-x[1], x[0]))[:n], 1)), key=str)


SCHEMA = "g string, c int, item string, score double, pos string, rank int"


@pytest.mark.parametrize("batch", [3, 10_000])
def test_best_of_every_group(spark, batch):
    rng = random.Random(1)
    scores = [0.0, -0.0, 0.5, 0.5, 1.0, float("nan"), None, float("inf"), -1.0]
    rows = [(rng.choice(["a", "b", None]), rng.choice([0, 1, None]), rng.choice(["x", "y", "z", "w", "v", "u", None]), rng.choice(scores)) for _ in range(3000)]
    rows += [("hot", 0, f"i{i:05d}", float(i % 7)) for i in range(20_000)] + [("x" * 50_000, 1, "y" * 50_000, 1.0)] * 2
    df = spark.createDataFrame([(*r, "clash", 9) for r in rows], SCHEMA).repartition(6)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = topn.top_n_per_group(df, ["g", "c"], "item", "score", 4)
        assert sorted((tuple(r) for r in got.select("g", "c", "item", "pos").collect()), key=str) == best(rows, 4)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_bounds_of_n(spark):
    df = spark.createDataFrame([("a", 1, "x", 1.0, "", 1)], SCHEMA)
    assert topn.top_n_per_group(df, ["g"], "item", "score", 0).count() == 0
    assert topn.top_n_per_group(df.where("false"), ["g", "c"], "item", "score", 3).count() == 0
    assert topn.top_n_per_group(df, [], "item", "score", 3).count() == 1
    with pytest.raises(ValueError):
        topn.top_n_per_group(df, ["g"], "item", "score", -1)


def test_keys_keep_the_order(spark):
    values = [-math.inf, -1e300, -2.5, -1e-300, -0.0, 0.0, 5e-324, 1.0, 1.0000000000000002, 3e8, math.inf, math.nan, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").withColumn("k", quantiles.ordered_key("v"))
    rows = df.withColumn("b", quantiles.key_value("k")).orderBy("i").collect()
    keys = [r.k for r in rows[:-2]]
    assert keys == sorted(keys) and len(set(keys)) == len(keys) - 1
    assert [(r.k, r.b) for r in rows[-2:]] == [(None, None)] * 2
    assert all(r.b == r.v for r in rows[:11])


def grouped(spark, groups):
    rows = [(g, float(v), "clash") for g, vs in groups.items() for v in vs]
    return spark.createDataFrame(rows, "g string, v double, target string").withColumn("key", quantiles.ordered_key("v")).select("g", "v", "key")


def test_medians_are_exact(spark):
    rng = random.Random(2)
    groups = {"one": [3], "two": [1, 2], "ties": [5] * 101 + [7] * 100, "neg": [rng.uniform(-5, 5) for _ in range(1001)], "wide": [10 ** rng.uniform(-200, 200) for _ in range(600)], None: [1, 9, 4]}
    got = {r.g: r.median for r in quantiles.exact_medians(grouped(spark, groups), ["g"], "key").collect()}
    assert got == {g: pytest.approx(float(np.median(v)), rel=1e-15) for g, v in groups.items()}
    assert quantiles.exact_medians(grouped(spark, {"a": [1]}).where("false"), ["g"], "key").count() == 0


def test_any_rank_is_exact(spark):
    values = [random.Random(3).gauss(0, 1) for _ in range(500)]
    df = grouped(spark, {"a": values})
    targets = spark.createDataFrame([("a", str(r), r) for r in (0, 1, 250, 498, 499, 500)], "g string, target string, rank bigint")
    got = {r.target: r.v for r in quantiles.radix_select(df, ["g"], "key", targets).withColumn("v", quantiles.key_value("key")).collect()}
    assert got == {str(r): sorted(values)[r] for r in (0, 1, 250, 498, 499)}


def test_summaries_of_days_combine_within_the_bound(spark):
    rng = random.Random(4)
    days = {f"d{k}": [rng.choice([rng.gauss(50, 5), rng.expovariate(0.01), 7.0]) for _ in range(n)] for k, n in enumerate([3, 400, 5000, 1])}
    days["same"] = [7.0] * 3000
    df = grouped(spark, days).withColumnRenamed("g", "day").withColumn("t", F.lit("x"))
    cells = quantiles.radix_summary(df, ["t", "day"], "key", 0.01)
    assert cells.agg(F.sum("n")).first()[0] == sum(map(len, days.values()))
    assert cells.groupBy("day").count().agg(F.max("count")).first()[0] <= 12 / 0.01
    assert cells.where("n > 25 and day = 'd2' and low <> high").count() == 0
    halves = cells.where("day < 'd2'").unionByName(cells.where("day >= 'd2'"))
    qs = {"p0": 0.0, "p50": 0.5, "p90": 0.9, "p99": 0.99, "p100": 1.0}
    row = quantiles.summary_quantiles(halves, ["t"], qs).first()
    everything = sorted(v for vs in days.values() for v in vs)
    n = len(everything)
    for name, q in qs.items():
        low, high = np.searchsorted(everything, row[name], "left"), np.searchsorted(everything, row[name], "right")
        assert low < high, "a value that occurs"
        assert low - 0.01 * n <= max(1, math.ceil(q * n)) <= high + 0.01 * n


def test_medians_are_the_same_without_broadcasts(spark):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.6 else rng.choice(["a", "b", None]), rng.choice([rng.random(), 1.0, 2.0, None])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, v double").withColumn("k", quantiles.ordered_key("v")).repartition(4)
    want = {g: float(np.median([v for h, v in rows if h == g and v is not None])) for g in {g for g, _ in rows}}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for limit in (before, "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            assert {r.g: r.median for r in quantiles.exact_medians(df, ["g"], "k").collect()} == want
            cells = quantiles.radix_summary(df, ["g"], "k", 0.05)
            assert {r.g: r.n for r in quantiles.summary_quantiles(cells, ["g"], {"p": 0.5}).collect()} == {g: sum(h == g and v is not None for h, v in rows) for g in want}
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rows_do_not_move(spark, tmp_path):
    """The join of the rows with their groups' medians broadcasts the medians, never the rows."""
    from phrasegrid.llm import queries

    from ..compare import DATA

    plan = queries.p4_found(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan and "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan

"""What plans must look like at scale, whatever the optimizer's version."""

import os

import pytest

from phrasegrid.plans import analytics

from .compare import DATA

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_what_they_need(spark):
    text = plan(analytics.duplicate_texts(spark, DATA))
    assert "ReadSchema: struct<text:string>" in text and "PushedFilters: [IsNotNull(text)]" in text
    text = plan(analytics.utterance_top50(spark, DATA))
    assert "ReadSchema: struct<utt_id:string,hotword_id:string,score:double,peak_frame:int>" in text and "IsNotNull(hotword_id)" in text
    assert "WindowGroupLimit" in text, "at most 50 rows a group and partition are shuffled"
    text = plan(analytics._times(spark, DATA))
    assert "batches:array<struct<timings_ms" in text, "only the timings of the nested batches"


def test_counts_are_made_before_the_shuffle(spark):
    text = plan(analytics.stale_hits(spark, DATA))
    assert text.count("HashAggregate") >= 2


def test_percentiles_are_counted_before_the_shuffle(spark):
    from phrasegrid.operators import metrics

    text = plan(metrics.exact_percentiles(analytics._times(spark, DATA), ["name"], "value", {"p50": 0.5}))
    assert "percentile" not in text, "no buffer of a group's values"


def test_no_broadcast_without_a_measured_size(spark):
    """A table beyond the limit is not broadcast; the rows it meets are spread over salts."""
    from pyspark.sql import functions as F

    from phrasegrid.runtime import join_small

    big = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    small = spark.createDataFrame([(0, "a" * 2000), (1, "b"), (None, "c")], "k bigint, v string")
    assert "BroadcastHashJoin" in plan(join_small(big, small, ["k"]))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1000")
    try:
        out = join_small(big, small, ["k"], "left")
        assert "Broadcast" not in plan(out) and "__salt" in plan(out)
        assert out.groupBy("v").count().where("v is null").first()["count"] == 333 and out.count() == 1000 and out.columns == ["k", "id", "v"]
        assert join_small(big, small, ["k"], "left_semi").count() == 667
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("setting", [True, False])
def test_scratch_goes_when_the_driver_ends(tmp_path, setting):
    """In a process of its own, with and without a shared folder set: tables lie there while it runs, and are gone afterwards."""
    import subprocess
    import sys
    import time

    (tmp_path / "conf").mkdir()
    (tmp_path / "tmp").mkdir()
    if setting:
        (tmp_path / "conf/spark-defaults.conf").write_text(f"spark.checkpoint.dir file://{tmp_path}/shared\n")
    code = """
from phrasegrid.runtime import clear_scratch, local_session, materialize, shared_dir
spark = local_session("1", 1)
assert materialize(spark.range(3).toDF("a"), "t").count() == 3
print(shared_dir(spark))
clear_scratch(spark)
assert materialize(spark.range(2).toDF("a"), "t").count() == 2
"""
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path / "conf"), "TMPDIR": str(tmp_path / "tmp")}
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], timeout=120, cwd=root, capture_output=True, env=env, text=True)
    assert done.returncode == 0, done.stderr
    where = done.stdout.split()[-1].removeprefix("file://")
    assert where.startswith(str(tmp_path / ("shared" if setting else "tmp")))
    left = lambda: os.path.isdir(f"{where}/phrasegrid") and os.listdir(f"{where}/phrasegrid")
    for _ in range(100):  # the JVM ends a moment after the process that started it
        if not left():
            break
        time.sleep(0.2)
    assert not left()

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from phrasegrid.operators import annotate, hooks
from phrasegrid.sources import catalogs


def test_encoder_and_aligner(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", None)], "k string, pcm array<float>")
    out = hooks.encode_frames(df, "pcm", lambda: lambda x: np.stack([x, np.asarray(x) * 2]))
    assert sorted(tuple(r) for r in hooks.explode_frames(out, ["k"]).collect()) == [("a", 0, [1.0, 2.0]), ("a", 1, [2.0, 4.0])]
    rows = spark.createDataFrame([("a", "x", "t1", "zh")], "k string, audio string, text string, language string")
    good = hooks.align_batches(rows, ["k"], "audio", "text", "language", lambda: lambda a, t, l: [[(c, i, i + 1) for i, c in enumerate(x)] for x in t])
    assert [tuple(i) for i in good.first()["items"]] == [("t", 0.0, 1.0), ("1", 1.0, 2.0)]
    with pytest.raises(Exception, match="gave 0 results"):
        hooks.align_batches(rows, ["k"], "audio", "text", "language", lambda: lambda a, t, l: []).collect()


def test_pronunciations(spark):
    rows = [(None, "词汇"), ('{"pronunciations": []}', "词"), ('{"pronunciations": "a b"}', "x"), ('{"pronunciations": ["a b", "c"]}', "x"), ('{"pronunciations": [["a", "b"], ["c"]]}', "x"), ("{}", "")]
    df = spark.createDataFrame(rows, "m string, t string")
    got = [r.p for r in df.select(hooks.pronunciation_paths(F.col("m"), F.col("t")).alias("p")).collect()]
    assert got == [[["词", "汇"]], [["词"]], [["a", "b"]], [["a", "b"], ["c"]], [["a", "b"], ["c"]], [[]]]
    lex = hooks.Lexicon({"行": [("x", "ing"), ("h", "ang")]}, {"go": [("G", "OW")]})
    assert lex("行-行 go Zz") == [(*a, *b, "G", "OW", "en:char:z", "en:char:z") for a in [("x", "ing"), ("h", "ang")] for b in [("x", "ing"), ("h", "ang")]]
    assert len(lex("行" * 9)) == 8 and lex("  ") == []
    words = spark.createDataFrame([("行",), (None,), ("",)], "t string")
    assert [r.p for r in words.select(hooks.readings(F.col("t"), lambda: lex).alias("p")).collect()] == [[["x", "ing"], ["h", "ang"]], None, []]


def test_small_rules(spark):
    df = spark.createDataFrame([(" ZH ", "x.wav", [], 8000, 2.0, 3, "ab"), (None, "http://h/x", ["i"], 0, 1.0, 0, "")], "l string, s string, ids array<string>, n int, e double, r int, t string")
    row = df.select(
        hooks.language_name(F.col("l"), "yue").alias("l"), hooks.audio_uri(F.col("s"), "/m/").alias("s"), hooks.enabled_or_all(F.col("ids"), F.array(F.lit("all"))).alias("i"),
        hooks.render_context(F.lit("static"), F.col("ids")).alias("c"),
    ).collect()
    assert [tuple(r) for r in row] == [("Chinese", "/m/x.wav", ["all"], "static"), ("Cantonese", "http://h/x", ["i"], "static\nHotwords: i")]
    out = hooks.decode_projection(df, "e", "n", "r", "t").collect()
    assert (out[0].duration_sec, out[0].rtf, out[0].revision_rate) == (0.5, 4.0, 1.5) and out[1].rtf == pytest.approx(1e9)
    shuffled = list("abcdef")
    random.Random(44).shuffle(shuffled)
    assert hooks.exact_epoch(list("abcdef"), 42, 2) == shuffled
    with pytest.raises(ValueError):
        hooks.batch_numbers(df, [F.col("n")], 0, [])


def test_aligned_faults(spark):
    rows = [("u", "m1", "h", ["h"], 0.0, 1.0), ("u", "m2", "zz", ["zz"], 0.0, 1.0), ("u", "m3", "h", ["h", "g"], 0.0, 1.0), ("u", "m4", "h", ["h"], 1.0, 1.0), ("u", "m5", "h", ["h"], 0.0, 9.0), ("u", "", "h", ["h"], 0.0, 1.0)]
    a = spark.createDataFrame(rows, "source_utt_id string, aligned_mention_id string, aligned_hotword_id string, target_hotword_ids array<string>, hotword_start_sec double, hotword_end_sec double")
    keys = spark.createDataFrame([("u", f"m{i}") for i in (1, 2, 3, 4, 6)] + [("u", "")], "source_utt_id string, aligned_mention_id string")
    out = annotate.check_aligned(a, keys, spark.createDataFrame([("h",), ("g",)], "id string"), spark.createDataFrame([("u", 5.0)], "source_utt_id string, seconds double"))
    assert sorted((r.aligned_mention_id, r.fault) for r in out.collect()) == [
        ("", "missing key"), ("m2", "unknown phrase"), ("m3", "other targets"), ("m4", "invalid span"), ("m5", "extra"), ("m5", "span beyond the audio"), ("m6", "missing"),
    ]


def test_catalog_files(spark, tmp_path):
    def write(name, *records):
        (tmp_path / name).write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in records), encoding="utf-8")
        return str(tmp_path / name)

    good = catalogs.read_catalog(spark, write("a", {"id": "1", "text": "词", "aliases": "x"}, {"id": "2", "text": "汇", "aliases": ["y"], "weight": 2, "metadata": {"k": 1}})).orderBy("id").collect()
    assert [(r.aliases, r.weight, r.catalog_version) for r in good] == [(["x"], 1.0, "1"), (["y"], 2.0, "1")]
    for bad, message in (
        ([{"id": "1", "text": "a"}, {"id": "1", "text": "b"}], "duplicate"), ([{"id": " ", "text": "a"}], "without"), ([{"id": "1", "text": "a", "weight": -1}], "negative"),
        ([{"id": "1", "text": "a"}, {"id": "2", "text": "a", "catalog_version": "v2"}], "versions"),
    ):
        with pytest.raises(ValueError, match=message):
            catalogs.read_catalog(spark, write("b", *bad))
    assert sorted(r.term for r in catalogs.read_vocabulary(spark, write("c", {"text": "a", "aliases": ["b", "a"]}, {"aliases": ""})).collect()) == ["a", "b"]
    m = catalogs.read_manifest(spark, write("d", {"utt_id": "u", "audio": "s", "text": "", "hotword_ids": "h"})).first()
    assert (m.key, m.source, m.target, m.target_hotword_ids) == ("u", "s", "", ["h"])
    with pytest.raises(ValueError):
        catalogs.read_manifest(spark, write("e", {"utt_id": "u", "text": "t"}))


def test_running_splits_hot_groups(spark):
    import random

    from phrasegrid.operators.ranking import running

    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), i, rng.choice([1, 5, None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(5)
    got = {r.i: (r.position, r.v_before) for r in running(df, ["k"], [F.col("i")], total="v").collect()}
    seen: dict = {}
    for k, i, v in rows:
        n, s = seen.get(k, (0, 0))
        assert got[i] == (n, s)
        seen[k] = (n + 1, s + (v or 0))
    assert running(df.where("false"), ["k"], [F.col("i")]).count() == 0
    assert sorted(r.position for r in running(df, [], [F.col("i").desc()]).collect()) == list(range(3000))


def test_probe_sees_what_went_before(spark):
    """A probe of one frame for 4 samples that gives their sum; with an overlap of 4 samples every frame still comes once."""
    rows = [("a", 0, [1.0] * 8), ("a", 1, [2.0] * 4), ("a", 2, None), ("a", 3, [3.0] * 8), ("b", 0, []), ("b", 1, [9.0] * 4)]
    df = spark.createDataFrame(rows, "k string, n int, pcm array<double>").repartition(3)
    probe = lambda: lambda x: x.reshape(-1, 4).sum(axis=1)[:, None]
    out = hooks.probe_posteriors(df, "k", "n", "pcm", probe, rate=16, frame_rate=4.0, overlap_ms=250)
    got = {(r.k, r.n): (r.frame_offset, r.log_probs) for r in out.collect()}
    assert got == {
        ("a", 0): (0, [[4.0], [4.0]]), ("a", 1): (2, [[8.0]]), ("a", 2): (3, []), ("a", 3): (3, [[12.0], [12.0]]), ("b", 0): (0, []), ("b", 1): (0, [[36.0]]),
    }

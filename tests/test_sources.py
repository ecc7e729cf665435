import io
import wave

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phrasegrid import config
from phrasegrid.sources import readers, writers


def wav(samples, rate=16000, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(b"".join(int(s).to_bytes(2, "little", signed=True) for s in samples))
    return out.getvalue()


def test_jsonl(spark, tmp_path):
    schema = T.StructType([T.StructField("b", T.StringType()), T.StructField("a", T.LongType())])
    df = spark.createDataFrame([("词", 1), (None, 2)], schema)
    writers.write_jsonl(df.coalesce(1), str(tmp_path / "o"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "o")).collect()]
    assert lines == ['{"a":1,"b":"词"}', '{"a":2}']
    assert sorted(r.a for r in readers.read_jsonl(spark, str(tmp_path / "o"), schema).collect()) == [1, 2]
    (tmp_path / "bad.jsonl").write_text('﻿{"a": 1, "b": "x"}\n\n  \nnope\n[1]\n', encoding="utf-8")
    assert sorted((r.b or "", r._corrupt_record is None) for r in readers.read_jsonl(spark, str(tmp_path / "bad.jsonl"), schema, strict=False).collect()) == [("", False), ("", False), ("x", True)]
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(tmp_path / "bad.jsonl"), schema).collect()


def test_text_sources(spark, tmp_path):
    (tmp_path / "t.txt").write_text("﻿u1  今天 [张三]\n\nu2\tx\nu3\n", encoding="utf-8")
    assert sorted((r.utt_id, r.tagged) for r in readers.read_tagged(spark, str(tmp_path / "t.txt")).collect()) == [("u1", "今天 [张三]"), ("u2", "x"), ("u3", None)]
    assert readers.read_word_lines(spark, {"a": str(tmp_path / "t.txt"), "b": str(tmp_path / "t.txt")}).count() == 8
    with pytest.raises(ValueError):
        readers.read_word_lines(spark, {})


def test_append_resumes(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert writers.append_new(df, path, ["k"]) == 2
    assert writers.append_new(spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int"), path, ["k"]) == 1
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 2), ("c", 3)]
    with pytest.raises(ValueError):
        writers.append_new(df.union(df), path, ["k"])


def test_waves(spark, tmp_path):
    sub = tmp_path / "d" / "e"
    sub.mkdir(parents=True)
    (sub / "x.wav").write_bytes(wav([16384, -16384]))
    (sub / "y.wav").write_bytes(wav([100, 300], channels=2))
    (sub / "z.wav").write_bytes(wav([1], rate=8000))
    (sub / "n.wav").write_bytes(b"no")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path / "d"))
    got = {r.path[-5]: r for r in readers.waves(files).collect()}
    assert got["x"].samples == [0.5, -0.5] and got["x"].seconds == 2 / 16000
    assert got["y"].samples == pytest.approx([200 / 32768]) and "rate" in got["z"].error and "no WAV" in got["n"].error
    assert sorted(r.stem for r in readers.file_index(spark, str(tmp_path / "d")).collect()) == ["n", "x", "y", "z"]
    assert len(readers.sha256_files(spark, str(sub)).first().sha256) == 64
    silent = writers.with_silence(wav([7]), 0.001)
    assert readers.decode_wave(silent)[0] == [0.0] * 16 + [7 / 32768]
    df = spark.createDataFrame([(wav([7]), 0.0), (None, 1.0)], "c binary, s double")
    assert [r.c is None for r in writers.silenced(df, "c", "s").collect()] == [False, True]
    p = spark.createDataFrame([(0,), (5,)], "n bigint").select(readers.pieces(F.col("n"), 2).alias("p"))
    assert [[tuple(x) for x in r.p] for r in p.collect()] == [[], [(0, 0, 2), (1, 2, 2), (2, 4, 1)]]


def test_named_sources():
    assert readers.named_sources(["a=/x", " b = y=z "]) == {"a": "/x", "b": "y=z"}
    for bad in (["a"], ["=x"], ["a="], ["a=1", "a=2"]):
        with pytest.raises(ValueError):
            readers.named_sources(bad)


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("# c\na:\n  b: 1\n  c: [1, 2]  # x\n  d: 'q'\ne: true\nf:\ng: none\n", encoding="utf-8")
    c = config.load_config(tmp_path / "c.yaml", ("a.b=5", "h.i=text", "e=false"))
    assert c == {"a": {"b": 5, "c": [1, 2], "d": "q"}, "e": False, "f": {}, "g": None, "h": {"i": "text"}}
    assert config.section(c, "a")["b"] == 5
    (tmp_path / "c.json").write_text("[1]", encoding="utf-8")
    for bad in (lambda: config.load_config(tmp_path / "c.json"), lambda: config.parse_yaml("a"), lambda: config.parse_yaml("a:\n\tb: 1"), lambda: config.set_dotted({}, "", 1), lambda: config.set_dotted({"a": 1}, "a.b", 1), lambda: config.section({}, "x")):
        with pytest.raises(ValueError):
            bad()


def test_reports_and_audio(spark, tmp_path):
    import json

    writers.write_report(spark, str(tmp_path / "r.json"), {"b": 1, "a": {"词": [2]}})
    text = (tmp_path / "r.json").read_text(encoding="utf-8")
    assert json.loads(text) == {"a": {"词": [2]}, "b": 1} and text.index('"a"') < text.index('"b"') and text.endswith("}\n")
    (tmp_path / "w/x").mkdir(parents=True)
    for name in ("x/u1.wav", "u2.wav", "x/u2.wav"):
        (tmp_path / "w" / name).write_bytes(wav([1, 2]))
    rows = spark.createDataFrame([("u1",), ("u2",), ("u3",)], "utt_id string")
    joined = readers.with_audio(rows, readers.file_index(spark, str(tmp_path / "w")), "utt_id")
    assert {r.utt_id: (r.path or "").rpartition("/w/")[2] for r in joined.collect()} == {"u1": "x/u1.wav", "u2": "u2.wav", "u3": ""}
    with pytest.raises(ValueError, match="1 records without audio: u3"):
        readers.require_audio(joined, "utt_id")
    assert readers.require_audio(joined.where("utt_id <> 'u3'"), "utt_id").count() == 2
    heads = readers.wave_headers(spark.createDataFrame([(wav([1, 2]),), (b"x",), (None,)], "content binary")).collect()
    assert [(r.rate, r.seconds, r.error is None) for r in heads] == [(16000, 2 / 16000, True), (None, None, False), (None, None, False)]

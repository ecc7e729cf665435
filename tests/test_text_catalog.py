import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from phrasegrid.functions import text as t
from phrasegrid.operators import catalog
from phrasegrid.plans import sql


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_normalisers_are_python_s(spark):
    rng = random.Random(1)
    pool = "aB ß\t\n 词汇Ａ１²⽯ﬁ①İ　\xa0É-_.0"
    values = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 8))) for _ in range(400)] + ["", "x\n", "词\n", "词", None]
    nf = lambda x: unicodedata.normalize("NFKC", x)
    maybe = lambda f: [None if v is None else f(v) for v in values]
    assert column(spark, values, t.nfkc_term) == maybe(lambda v: "".join(nf(v).split()))
    assert column(spark, values, t.match_text) == maybe(lambda v: " ".join(nf(v).casefold().split()))
    assert column(spark, values, t.alignment_text) == maybe(lambda v: "".join(c for c in nf(v).casefold() if c.isalnum()))
    assert column(spark, values, t.strip) == maybe(str.strip)


def test_small_functions(spark):
    assert column(spark, ["a#b c", "__", "é.x-1_"], t.safe_id) == ["a_b_c", "", ".x-1"]
    assert column(spark, ["词汇", "词", "词a", "词汇\n", "词" * 8, "词" * 9], t.script_term) == [True, False, False, False, True, False]
    df = spark.createDataFrame([([1, 2, 3], [1, 2, 4, 5]), ([], [1]), ([1], [1]), ([None], [None])], "a array<int>, b array<int>")
    assert [r.n for r in df.select(t.common_prefix(F.col("a"), F.col("b")).alias("n")).collect()] == [2, 0, 1, 1]


@pytest.mark.parametrize("size", [4, 256])
def test_blocks_hold_every_place_once(spark, size):
    texts = ["", "x", "abcde" * 3, "词" * 1000, "ab" * 9000]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(texts)], "i int, v string")
    rows = t.text_blocks(df, ["i"], "v", 2, size).select("i", "block_start", F.explode(t.grams(3)).alias("x")).collect()
    got = sorted((r.i, r.block_start + r.x.i, r.x.g) for r in rows)
    assert got == sorted((i, p, v[p : p + 3]) for i, v in enumerate(texts) for p in range(len(v) - 2))


def entries(spark, n=40):
    rows = [(f"词{chr(0x4E00 + i)}", {"a": i, "b": 1}, i + 1) for i in range(n)]
    return spark.createDataFrame(rows, "text string, source_frequencies map<string,bigint>, total_frequency bigint")


def test_merge_keeps_sources(spark):
    rows = [("a", "词汇", 12), ("b", "词汇", 3), ("a", "词汇", 0), ("a", "长长长", 2**63 - 1), ("b", "长长长", 2**63 - 1), ("a", "x", 5)]
    counts = catalog.word_counts(spark.createDataFrame(rows, "source string, term string, count bigint"))
    out = {r.text: (dict(r.source_frequencies), int(r.total_frequency)) for r in catalog.merge_sources(counts).collect()}
    assert out["词汇"] == ({"a": 12, "b": 3}, 15)
    assert out["长长长"][1] == 2 * (2**63 - 1)
    assert set(out) == {"词汇", "长长长"}


def test_stratified_sample(spark):
    df = entries(spark)
    once = sorted(r.text for r in catalog.select_stratified(df, 10).collect())
    again = sorted(r.text for r in catalog.select_stratified(df.repartition(7), 10).collect())
    assert once == again and len(once) == 10
    assert catalog.select_stratified(df, 20).groupBy("bucket").count().where("count <> 2").count() == 0
    out = spark.createDataFrame([(once[0],)], "x string")
    assert once[0] not in {r.text for r in catalog.select_stratified(df, 39, out).collect()}
    assert catalog.select_stratified(df, 0).count() == 0
    with pytest.raises(ValueError):
        catalog.select_stratified(df, -1)
    import random as r

    ranked = [f"词{chr(0x4E00 + i)}" for i in reversed(range(40))]
    want = []
    for b in range(10):
        part = ranked[b * 4 : b * 4 + 4]
        r.Random(f"42:{b}").shuffle(part)
        want.append(part[0])
    assert sorted(x.text for x in catalog.select_stratified(df, 10, exact_shuffle=True).collect()) == sorted(want)


def test_ngrams_are_all_substrings(spark):
    texts = ["甲乙 丙丁", "甲乙", "", None, "x" * 20]
    df = spark.createDataFrame([(v,) for v in texts], "v string")
    want = set()
    for v in texts:
        v = "".join((v or "").split())
        want |= {v[i : i + n] for n in range(2, 4) for i in range(len(v) - n + 1)} | ({v} if v else set())
    assert {r.term for r in catalog.ngrams(df, "v", 2, 3).collect()} == want
    with pytest.raises(ValueError):
        catalog.ngrams(df, "v", 3, 2)
    terms = spark.createDataFrame([("乙丙",), ("丁甲",), ("甲乙丙丁",), ("",)], "text string")
    assert {r.text for r in catalog.spoken_terms(df, "v", terms).collect()} == {"乙丙", "甲乙丙丁"}


def test_evaluation_catalog(spark):
    target = spark.createDataFrame(
        [("t2", "词 甲", ["别名", "词甲", " "], "{\"role\": \"x\", \"k\": \"v\"}"), ("t1", "目标", None, None)], "id string, text string, aliases array<string>, metadata string"
    )
    spoken = spark.createDataFrame([(f"他说词{chr(0x4E00 + 39)}了",), (None,)], "v string")
    rows = catalog.evaluation_catalog(target, entries(spark), spoken, "v", 8, "v1").orderBy("position").collect()
    assert [r.id for r in rows[:2]] == ["t1", "t2"] and len(rows) == 8
    assert rows[1].text == "词甲" and rows[1].aliases == ["别名"] and '"role":"target"' in rows[1].metadata
    assert f"词{chr(0x4E00 + 39)}" not in {r.text for r in rows}
    assert all(r.id.startswith("dist-") for r in rows[2:])
    with pytest.raises(ValueError, match="shared"):
        catalog.check_targets(spark.createDataFrame([("a", "词", None), ("b", "词", None)], "id string, text string, aliases array<string>"))
    with pytest.raises(ValueError, match="duplicate"):
        catalog.check_targets(spark.createDataFrame([("a", "词", None), ("a", "汇", None)], "id string, text string, aliases array<string>"))
    with pytest.raises(ValueError, match="fewer"):
        catalog.evaluation_catalog(target, entries(spark, 3), spoken, "v", 8, "v1")


def test_vocabulary_overlay_variants(spark):
    lines = spark.createDataFrame([("词 3",), ("词 汇 5",), ("# c",), ("",), ("7",), ("x y",), ("﻿首 2",), (None,)], "value string")
    assert sorted(r.term for r in catalog.negative_vocabulary(lines).collect()) == sorted(["词", "词 汇", "7", "x y", "首"])
    base, over = (spark.createDataFrame(x, "id string, text string") for x in ([("a", "1"), ("b", "2")], [("b", "3"), ("c", "4")]))
    assert sorted((r.id, r.text) for r in catalog.overlay(base, over).collect()) == [("a", "1"), ("b", "3"), ("c", "4")]
    df = spark.createDataFrame([("Ab", ["ab", "C"])], "t string, a array<string>")
    v = catalog.text_variants(F.col("t"), F.col("a"), F.lower)
    assert df.select(v.alias("v")).first().v == ["Ab", "ab", "C", "c"]
    assert df.select(catalog.tokenizer_variants(F.array(F.lit("x"))).alias("v")).first().v == ["x", " x", "\nx"]
    assert catalog.local_positive("abcdef", "u", 1, 2) == catalog.local_positive("abcdef", "u", 1, 2) in "abcdef"
    with pytest.raises(ValueError):
        catalog.local_positive("", "u", 1, 2)


def test_sql_has_no_unknown_query():
    from phrasegrid.plans import queries

    assert set(sql.oracle_sql()) <= set(queries.queries())


def test_draws_follow_pythons_generator(spark):
    import hashlib
    import random

    digest = hashlib.sha256(b"42:3:u1").digest()
    rng = random.Random(int.from_bytes(digest[:8], "little"))
    n = rng.randint(2, 8)
    at = rng.randint(0, 20 - n)
    text = "".join(chr(0x4E00 + i) for i in range(20))
    assert catalog.local_positive(text, "u1", 3, 42) == text[at : at + n]
    v = spark.createDataFrame([(f"t{i:02d}",) for i in range(30)] + [("",), (None,), ("t01",)], "term string")
    p = spark.createDataFrame([("t03",), ("zz",)], "term string")
    want = random.Random((1 << 32) ^ (2 << 16) ^ 5).sample([f"t{i:02d}" for i in range(30) if i != 3], 7)
    assert [r.term for r in catalog.shared_negatives(v, p, 7, 1, 2, 5, exact=True).collect()] == want
    assert catalog.shared_negatives(v, p, 99, exact=True).count() == 29
    for exact in (True, False):
        with pytest.raises(ValueError):
            catalog.shared_negatives(v, p, 30, exact=exact, strict=True)

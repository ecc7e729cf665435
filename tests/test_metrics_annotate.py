import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from phrasegrid.operators import annotate, metrics

PAIR = "k string, reference string, hypothesis string, hotwords array<string>, boundary_group string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_edit_distances(spark):
    rng = random.Random(2)
    rows = [(str(i), *(" ".join(rng.choices(["the", "word", "词", "Ａ", "x"], k=rng.randint(0, 7))) for _ in range(2)), None, None) for i in range(60)] + [("n", None, "a", None, None), ("e", "", "", [], "")]
    got = {r.k: r for r in metrics.edit_counts(spark.createDataFrame(rows, PAIR)).collect()}
    for k, ref, hyp, *_ in rows:
        if ref is None:
            assert got[k].word_errors is None
            continue
        a, b = (x.casefold().replace("ａ", "a").split() for x in (ref, hyp))
        assert (got[k].word_errors, got[k].ref_words) == (distance(a, b), len(a))
        assert (got[k].char_errors, got[k].ref_chars) == (distance("".join(a), "".join(b)), len("".join(a)))


def test_alignment_is_cheapest_and_prefers_the_diagonal():
    rng = random.Random(3)
    for _ in range(200):
        a, b = (rng.choices("abc", k=rng.randint(0, 8)) for _ in range(2))
        pairs = metrics.align(a, b)
        assert [x for x, _ in pairs if x] == a and [y for _, y in pairs if y] == b
        assert sum(x != y for x, y in pairs) == distance(a, b)
    assert metrics.align(["a", "b"], ["b"]) == [("a", None), ("b", "b")]


def test_keywords_and_partition(spark):
    rows = [
        ("1", "aaa Foo bar", "aa foo", ["aa", "FOO", "", None], "center"),
        ("2", "no keywords", "at all", [], "cross-25"),
        ("3", "", "", None, None),
        ("4", "open the door", "open a door", ["the"], "cross-50"),
    ]
    df = spark.createDataFrame(rows, PAIR)
    got = {r.k: r for r in metrics.keyword_counts(df, ["k"]).collect()}
    assert (got["1"].keyword_ref, got["1"].keyword_hyp, got["1"].keyword_tp) == (2, 2, 2)
    assert got["2"].keyword_far == 0 and got["3"].keyword_recall == 0
    parts = {r.k: r for r in metrics.partitioned_errors(df, ["k"]).collect()}
    assert tuple(parts["4"])[1:] == (1, 1, 2, 0)
    report = metrics.partitioned_report(metrics.partitioned_errors(df.where("k = '4'"), ["k"])).first()
    assert (report.bwer, report.uwer) == (1.0, 0.0)
    all_ = metrics.transcript_report(df, ["k"]).first()
    assert all_.records == 4 and all_.boundary_penalty == pytest.approx(1.0)
    assert metrics.transcript_report(df.where("k = '2'"), ["k"]).first().boundary_penalty is None
    assert metrics.partitioned_errors(df.where("false"), ["k"]).count() == 0


def test_retrieval_scores(spark):
    hits = "array<struct<hotword_id:string,score:double>>"
    batch = f"struct<hits:{hits},chunk_id:int>"
    h = lambda *ids: [{"hotword_id": i, "score": 1.0} if i != "null" else None for i in ids]
    rows = [
        (1, ["a", "b", None, "a"], "Center x", {"hits": h("x", "a", "null", None), "chunk_id": 2}, [{"hits": h("x"), "chunk_id": 0}, None, {"hits": h("b"), "chunk_id": 1}]),
        (2, ["z"], " cross-25", None, None),
        (3, [], "center", {"hits": h("a"), "chunk_id": 0}, []),
        (4, None, None, {"hits": None, "chunk_id": 0}, [{"hits": None, "chunk_id": 0}]),
    ]
    df = spark.createDataFrame(rows, f"run_no int, target_hotword_ids array<string>, boundary_group string, final_batch {batch}, batches array<{batch}>")
    got = {r.run_no: r for r in metrics.hit_scores(df, ["run_no", "boundary_group"]).collect()}
    assert (got[1].gold, got[1].recall_at_1, got[1].recall_at_5, got[1].precision_at_5, got[1].reciprocal_rank, got[1].first_top50_chunk) == (2, 0.0, 0.5, 0.25, 0.5, 1)
    assert (got[2].recall_at_50, got[2].reciprocal_rank, got[2].first_top50_chunk) == (0.0, 0.0, None)
    r = metrics.retrieval_report(metrics.hit_scores(df, ["boundary_group"])).first()
    assert (r.evaluable, r.center_utterances, r.cross_utterances, r.mrr, r.boundary_penalty) == (2, 1, 1, 0.25, 0.5)
    empty = metrics.retrieval_report(metrics.hit_scores(df.where("run_no > 2"), ["boundary_group"])).first()
    assert (empty.first_top50_chunk_mean, empty.mrr, empty.false_alarm_rate_at_1) == (-1.0, 0.0, 1.0)


def test_streaming_aggregates(spark):
    df = spark.createDataFrame([([1.0, 3.0, 5.0], 10.0), (None, None), ([float("nan")], 20.0)], "chunk_processing_ms array<double>, ttft_ms double")
    got = {r.name: r for r in metrics.streaming_aggregates(df).collect()}
    assert got["chunk_latency_ms"].p95 == pytest.approx(4.8) and got["ttft_ms"].mean == 15.0
    assert set(got) == {"chunk_latency_ms", "ttft_ms"}


def test_paired_and_bootstrap(spark):
    base = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 5.0), ("b", 1, 1.0)], "u string, o int, v double")
    run = spark.createDataFrame([("a", 6.0), ("a", 7.0), ("c", 1.0)], "u string, v double")
    assert sorted(r.difference for r in metrics.paired_differences(run, base, ["u"], ["o"], "v").collect()) == [1.0, 2.0]
    df = spark.range(2000).select("id", (F.col("id") % 10 / 10.0).alias("v"))
    r = metrics.bootstrap_ci(df, "v", "id", samples=400).first()
    low, high = metrics.bootstrap_exact([i % 10 / 10 for i in range(2000)], 400)
    assert r.mean == pytest.approx(0.45) and r.low == pytest.approx(low, abs=0.004) and r.high == pytest.approx(high, abs=0.004)
    assert tuple(metrics.bootstrap_ci(df.repartition(9), "v", "id", samples=400).first()) == pytest.approx(tuple(r))
    with pytest.raises(ValueError):
        metrics.bootstrap_exact([])


def test_markers(spark):
    texts = ["[张三]在(北京)见<公司>和 (北京)", "[开", "开]", "[(甲)]", "[ ]", "  ", None, "［全角］ 字", "", "长" * 50_000]
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(texts)], "i int, text string, extra string")
    marks = {"[": ("]", "ORG"), "(": (")", "LOC"), "<": (">", "PER")}
    rows = {r.i: r for r in annotate.parse_annotated(df, "text", marks).collect()}
    assert rows[0].transcript == "张三在北京见公司和北京"
    assert [(m.entity_type, m.char_start, m.char_end, m.occurrence_index) for m in rows[0].mentions] == [("ORG", 0, 2, 0), ("LOC", 3, 5, 0), ("PER", 6, 8, 0), ("LOC", 9, 11, 1)]
    kinds = [rows[i].error.split()[0] for i in (1, 2, 3, 4, 5, 8)]
    assert kinds == ["unclosed", "unmatched", "nested", "empty", "empty", "empty"]
    assert rows[6].transcript is None and rows[7].mentions[0].text == "全角" and len(rows[9].transcript) == 50_000


def items(text):
    return [{"text": c, "start_time": i / 1.0, "end_time": i + 1.0} for i, c in enumerate(text)]


def test_spans(spark):
    rows = [("a", items("abab a"), ["aba", "AB", "ab", "zz", ""]), ("b", [], ["x"]), ("c", None, None), ("d", [{"text": "Ab", "start_time": 1.0, "end_time": 1.0}], ["ab"])]
    df = spark.createDataFrame(rows, "k string, items array<struct<text:string,start_time:double,end_time:double>>, variants array<string>")
    spans = annotate.find_spans(df, ["k"])
    got = sorted((r.k, r.span_index, r.variant, r.first_item, r.last_item) for r in spans.collect())
    assert got == [("a", 0, "AB", 0, 1), ("a", 1, "aba", 0, 2), ("a", 2, "AB", 2, 3), ("a", 3, "aba", 2, 5), ("d", 0, "ab", 0, 0)]
    wanted = spark.createDataFrame([("a", 1), ("a", 9), ("a", None), ("b", None), ("d", None)], "k string, occurrence_index int")
    errors = sorted((r.k, r.occurrence_index or -1, r.error or "") for r in annotate.resolve_spans(spans, wanted, ["k"]).collect())
    assert errors == [("a", -1, "ambiguous"), ("a", 1, ""), ("a", 9, "occurrence unavailable"), ("b", -1, "absent"), ("d", -1, "zero duration")]
    last = annotate.resolve_spans(spans, wanted.where("k = 'a' and occurrence_index is null"), ["k"], "last").first()
    assert (last.first_item, last.error) == (2, None)
    with pytest.raises(ValueError):
        annotate.resolve_spans(spans, wanted, ["k"], "middle")


def test_silence_puts_the_word_where_it_should_be(spark):
    spans = spark.createDataFrame([(i, i * 0.37, i * 0.37 + 0.3) for i in range(40)] + [(99, 2.0, 1.0), (98, None, 1.0)], "i int, s double, e double")
    for r in annotate.boundary_variants(spans, 1.12, "s", "e").collect():
        if r.i >= 98:
            assert r.leading_silence_sec is None
            continue
        assert -1e-9 <= r.leading_silence_sec < 1.12 + 1e-9
        middle = (r.word_start_sec + r.word_end_sec) / 2
        at = {"center": middle - 0.56, "b-400": middle + 0.4, "b-200": middle + 0.2, "b-100": middle + 0.1}.get(r.boundary_group)
        if at is None:
            part = int(r.boundary_group[-2:]) / 100
            at = r.word_start_sec + (r.word_end_sec - r.word_start_sec) * (1 - part)
        assert min(at % 1.12, 1.12 - at % 1.12) < 1e-6


def test_ids_and_reconciling(spark):
    df = spark.createDataFrame([('["a","","a",null,"b"]',), ("solo",), (None,), ("[]",)], "v string")
    assert [r.o for r in df.select(annotate.target_ids(annotate.string_or_array(F.col("v"))).alias("o")).collect()] == [["a", "b"], ["solo"], [], []]
    f = spark.createDataFrame([(" ", "x"), (None, " y "), ("　", None), ("k", "z")], "a string, b string")
    assert [r.o for r in f.select(annotate.first_filled(F.col("a"), F.col("b")).alias("o")).collect()] == ["x", " y ", None, "k"]
    e, a = (spark.createDataFrame(x, "u string, m string") for x in ([("1", "a"), ("1", "b"), (None, "n")], [("1", "a"), ("1", "a"), ("2", "c"), (None, "n")]))
    assert sorted((r.u, r.m, r.status) for r in annotate.reconcile(e, a, ["u", "m"]).collect()) == [("1", "a", "duplicate"), ("1", "b", "missing"), ("2", "c", "extra")]
    assert [r.u for r in annotate.pending(e.where("u is not null"), a, ["u", "m"], ["u"]).collect()] == ["1"]


def test_distance_of_more_tokens_than_one_unit_can_name(spark):
    a = [f"w{i}" for i in range(8_200)]
    row = spark.createDataFrame([(a, [*a[-3:], "other"])], "a array<string>, b array<string>").select(metrics.token_distance(F.col("a"), F.col("b")).alias("n"))
    assert row.first().n == 8_198


def test_alignment_keeps_its_choice_in_little_memory():
    """The same pairs as from the whole table of moves, whatever the stretch."""
    rng = random.Random(9)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 14))] for _ in range(2))
        n, m = len(a), len(b)
        cost = [[i + j if not i or not j else 0 for j in range(m + 1)] for i in range(n + 1)]
        for i in range(1, n + 1):
            for j in range(1, m + 1):
                cost[i][j] = min(cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
        i, j, want = n, m, []
        while i or j:
            if i and j and cost[i][j] == cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
                i, j = i - 1, j - 1
                want.append((a[i], b[j]))
            elif i and cost[i][j] == cost[i - 1][j] + 1:
                i -= 1
                want.append((a[i], None))
            else:
                j -= 1
                want.append((None, b[j]))
        assert metrics.align(a, b) == want[::-1]
    long = [str(i) for i in range(3000)]
    assert len(metrics.align(long, long[1:])) == 3000


def test_percentiles_without_a_buffer(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1.0, 2.0, rng.random(), None, float("nan"), float("inf")])) for _ in range(500)] + [("one", 5.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: (r.p50, r.p95) for r in metrics.exact_percentiles(df, ["g"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    finite = {g: [v for h, v in rows if h == g and v is not None and math.isfinite(v)] for g, _ in rows}
    assert got.keys() == {g for g, v in finite.items() if v}
    assert all(got[g] == pytest.approx((np.percentile(finite[g], 50), np.percentile(finite[g], 95))) for g in got)


def test_scores_fall_back(spark):
    hit = "struct<hotword_id:string>"
    batch = f"struct<hits:array<{hit}>,chunk_id:int>"
    rows = [
        (None, ["x"], ({"hits": [{"hotword_id": "y"}], "chunk_id": 1}), [{"hotword_id": "x"}], [{"hits": [{"hotword_id": "x"}], "chunk_id": None}]),
        (["x"], ["z"], None, [{"hotword_id": "y"}, {"hotword_id": "x"}], None),
        (["x"], None, {"hits": None, "chunk_id": 0}, [{"hotword_id": "x"}], [{"hits": [], "chunk_id": 4}]),
    ]
    df = spark.createDataFrame(rows, f"target_hotword_ids array<string>, hotword_ids array<string>, final_batch {batch}, final_hits array<{hit}>, batches array<{batch}>")
    got = [(r.gold, r.reciprocal_rank, r.first_top50_chunk) for r in metrics.hit_scores(df, []).collect()]
    assert got == [(1, 0.0, 0), (1, 0.5, None), (1, 0.0, None)]


def test_intervals_by_nearest_ranks():
    low, high = metrics.bootstrap_nearest([0.1, 0.2, 0.3, 0.4], 200)
    assert 0.1 <= low < 0.25 < high <= 0.4 and metrics.bootstrap_nearest([0.1, 0.2, 0.3, 0.4], 200) == (low, high)
    assert metrics.nearest_ranks(2000, 0.95) == (50, 1949) and metrics.nearest_ranks(1, 0.95) == (0, 0)
    with pytest.raises(ValueError):
        metrics.bootstrap_nearest([])


def test_verdict(spark):
    good = {"recall_gain": 0.06, "recall_gain_low": 0.01, "boundary_penalty": 0.03, "center_utterances": 1.0, "cross_utterances": 2.0, "offline_final_exact_match_rate": 1.0, "search_ms_p95": 9.9}
    of = lambda m: metrics.verdict(spark.createDataFrame([(k, v) for k, v in m.items()], "name string, value double")).first().asDict()
    assert all(of(good).values())
    for name, bad, gate in (("recall_gain_low", 0.0, "recall_ok"), ("cross_utterances", 0.0, "boundary_ok"), ("offline_final_exact_match_rate", 0.99, "parity_ok"), ("search_ms_p95", 10.0, "latency_ok")):
        found = of(good | {name: bad})
        assert not found["go"] and [k for k, v in found.items() if not v] == [gate, "go"]
    assert not any(of({"x": 1.0}).values())


def test_many_alignments_at_once_are_those_of_each(monkeypatch):
    rng = random.Random(12)
    pairs = []
    for _ in range(400):
        blank = rng.choice(["", " "])
        text = lambda: blank.join(rng.choice(["a", "b", "词", "c"]) for _ in range(rng.randint(0, 12)))
        pairs.append((text(), text(), [rng.choice(["a", "词 b", "", "bc"]) for _ in range(rng.randint(0, 2))]))
    want = []
    for r, h, k in pairs:
        whole = " " not in r
        want.append(metrics._one_split(metrics._units(r, whole), metrics._units(h, whole), {t for w in k for t in metrics._units(w, whole)}))
    for cells in (4_000_000, 500, 60, 0):
        monkeypatch.setattr(metrics, "_CELLS", cells)
        assert metrics._split(pairs) == want
    assert metrics._split([]) == []

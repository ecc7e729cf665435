import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from phrasegrid.operators import match, search


def brute(texts, patterns):
    fold = lambda x: " ".join(x.casefold().split())
    pats = {(i, fold(p)) for i, p in patterns if p and fold(p)}
    out = []
    for k, t in texts:
        t = fold(t or "")
        out += [(k, i, at, len(p)) for i, p in pats for at in range(len(t) - len(p) + 1) if t[at : at + len(p)] == p]
    return sorted(out)


def test_two_matchers_and_brute_force(spark):
    rng = random.Random(5)
    texts = [(i, "".join(rng.choices("ab词 ", k=rng.choice([0, 1, 7, 40, 3000])))) for i in range(30)] + [(98, None), (99, "A  b" * 5000)]
    patterns = [("p%d" % i, "".join(rng.choices("ab词", k=rng.randint(1, 6)))) for i in range(40)] + [("p0", "A b"), ("n", None), ("e", ""), ("p1", "a")]
    t = spark.createDataFrame([(k, v, "x") for k, v in texts], "k int, v string, id string")
    p = spark.createDataFrame(patterns, "id string, pattern string")
    want = brute(texts, patterns)
    plain = [(i, " ".join(x.casefold().split())) for i, x in set(patterns) if x]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for limit in (before, "-1"):  # without broadcasts, by classes of length
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            assert sorted(tuple(r) for r in match.ngram_matches(t, "k", "v", p).select("k", "id", "start", "length").collect()) == want
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(tuple(r) for r in match.automaton_matches(t, "k", "v", plain).collect()) == want
    a = match.build_automaton(plain)
    node, found = 0, []
    for at, c in enumerate("a  bab".replace("  ", " ")):
        node = a.step(node, c)
        found += [(i, at + 1 - n, n) for i, n in a.out[node]]
    assert sorted(found) == sorted(x[1:] for x in brute([(0, "a  bab")], patterns))
    assert match.ngram_matches(t, "k", "v", p.where("false")).count() == 0
    assert match.ngram_matches(t.where("false"), "k", "v", p).count() == 0
    best = match.longest_matches(match.ngram_matches(t, "k", "v", p), "k")
    assert best.groupBy("k", "start").count().where("count > 1").count() == 0


def test_automaton():
    a = match.Automaton()
    for path, phrase in (("he", "H"), ("she", "S"), ("hers", "R"), ("her", "H"), ("", "none")):
        a.add(tuple(path), phrase)
    a.freeze()
    node = 0
    found = []
    for i, c in enumerate("ushers"):
        node = a.step(node, c)
        found += [(i, p) for p in a.out[node]]
    assert found == [(3, "H"), (3, "S"), (4, "H"), (5, "R")]
    assert a.shortest == {"H": 2, "S": 3, "R": 4}
    assert a.below(0) == ("H", "R", "S") and a.below(0, 1) == ("H",)
    assert sorted(("".join(p), x) for p, x in a.paths()) == [("he", "H"), ("her", "H"), ("hers", "R"), ("she", "S")]


def vectors(spark, n, seed, cols):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, 6))
    v[::7] = v[0]
    v[1] = 0
    rows = [(*cols(i), [float(x) for x in v[i]]) for i in range(n)]
    return rows, v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), search.EPS)


@pytest.mark.parametrize(("rows", "keys"), [(4, 5), (4096, 16384)])
def test_block_search_equals_brute_force(spark, rows, keys):
    fr, fv = vectors(spark, 23, 1, lambda i: (f"u{i % 4}", i))
    kr, kv = vectors(spark, 31, 2, lambda i: (f"h{i % 9}", f"v{i:02d}"))
    frames = spark.createDataFrame(fr, "utt string, frame int, vec array<double>").withColumn("vec", search.l2_normalize(F.col("vec")))
    index = spark.createDataFrame(kr, "hotword_id string, variant string, key array<double>").withColumn("key", search.l2_normalize(F.col("key")))
    want = []
    for u in range(4):
        best = {}
        for j in range(31):
            s = max((round(float(fv[i] @ kv[j]), 6) + 0.0, -i) for i in range(u, 23, 4))
            entry = (-s[0], f"v{j:02d}", -s[1])
            best[f"h{j % 9}"] = min(best.get(f"h{j % 9}", (9,)), entry)
        order = sorted((v[0], h, v) for h, v in best.items())[:5]
        want += [(f"u{u}", h, round(-v[0], 6), r, v[2], v[1]) for r, (_, h, v) in enumerate(order, 1)]
    cols = ["utt", "hotword_id", "score", "rank", "peak_frame", "variant"]
    got = [tuple(r) for r in search.search_blocks(frames, index, ["utt"], 5, rows, keys).select(cols).orderBy("utt", "rank").collect()]
    assert [(*g[:2], round(g[2], 6), *g[3:]) for g in got] == sorted(want, key=lambda x: (x[0], x[3]))
    native = [tuple(r) for r in search.search_native(frames, index, ["utt"], 5).select(cols).orderBy("utt", "rank").collect()]
    assert [(*g[:2], round(g[2], 6), *g[3:]) for g in native] == [(*g[:2], round(g[2], 6), *g[3:]) for g in got]
    assert search.search_blocks(frames, index, ["utt"], 0).count() == 0
    assert search.search_blocks(frames.where("false"), index, ["utt"], 3).count() == 0
    assert search.search_blocks(frames, index.where("false"), ["utt"], 3).count() == 0
    with pytest.raises(ValueError):
        search.search_blocks(frames, index, ["utt"], -1)
    nested = search.nested_hits(search.search_blocks(frames, index, ["utt"], 5), ["utt"]).first()
    assert [h["rank"] for h in nested.hits] == [1, 2, 3, 4, 5]


def test_growing_search_equals_search_of_prefixes(spark):
    fr, _ = vectors(spark, 24, 3, lambda i: (f"u{i % 2}", i // 6, i))
    kr, _ = vectors(spark, 17, 4, lambda i: (f"h{i % 5}", f"v{i:02d}"))
    frames = spark.createDataFrame(fr, "utt string, chunk int, frame int, vec array<double>").withColumn("vec", search.l2_normalize(F.col("vec")))
    index = spark.createDataFrame(kr, "hotword_id string, variant string, key array<double>").withColumn("key", search.l2_normalize(F.col("key")))
    growing = {(r.utt, r.chunk, r.rank): (r.hotword_id, round(r.score, 6), r.variant, r.peak_frame) for r in search.search_blocks(frames, index, ["utt", "chunk"], 3, 5, 4, growing=True).collect()}
    for c in range(4):
        part = frames.where(F.col("chunk") <= c).drop("chunk")
        for r in search.search_blocks(part, index, ["utt"], 3).collect():
            assert growing[r.utt, c, r.rank] == (r.hotword_id, round(r.score, 6), r.variant, r.peak_frame)


def test_index_round_trip(spark, tmp_path):
    keys = spark.createDataFrame([("h", "v", [0.1, 70000.0]), ("h", "w", [1.0, 2.0])], "hotword_id string, variant string, key array<float>")
    small = search.half_precision(keys.where("variant = 'w'"), "key")
    assert small.first().key == [1.0, 2.0]
    search.save_index(keys, str(tmp_path / "i"), "v1")
    assert sorted(tuple(r.key) for r in search.load_index(spark, str(tmp_path / "i")).collect()) == sorted(tuple(r.key) for r in keys.collect())
    meta = spark.read.json(str(tmp_path / "i" / "meta")).first()
    assert (meta.hotword_count, meta.variant_count, meta.dim) == (1, 2, 2)
    with pytest.raises(ValueError):
        search.check_dimensions(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "k array<double>"), "k")


def test_hundred_thousand_phrases(spark):
    """A catalog of 100,000 is built and one text is matched; also as a join beyond the broadcast limit."""
    import time

    from phrasegrid.streaming import kernel, sessions

    began = time.time()
    entries = [{"id": f"hw-{i}", "text": f"entity{i:06d}", "aliases": None, "weight": 1.0} for i in range(100_000)]
    catalog = kernel.Catalog.build(entries, sessions.folded)
    probe = kernel.TextProbe(catalog.automaton, catalog.spellings, sessions.folded)
    assert [e.phrase for e in probe.observe("before entity054321 after", 0, None)[1]] == ["hw-54321"]
    assert time.time() - began < 60
    t = spark.createDataFrame([(1, "before entity054321 after entity000007")], "k int, v string")
    p = spark.createDataFrame([(e["id"], e["text"]) for e in entries], "id string, pattern string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for limit in (before, "1000"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            assert sorted((r.id, r.start) for r in match.ngram_matches(t, "k", "v", p).collect()) == [("hw-54321", 7), ("hw-7", 26)]
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_stream_of_frames():
    from phrasegrid.streaming.retrieval import Index, Stream

    index = Index.of([("b", "v2", [0.0, 1.0]), ("a", None, [1.0, 0.0]), ("b", "v1", [0.0, 1.0])])
    s = Stream(index, block=4, samples_per_frame=2, k=2)
    assert s.step(3, [[0.5, 0.0]]) == []
    with pytest.raises(RuntimeError):
        s.use(index)
    one, two = s.step(6, [[0.0, 0.9], [0.6, 0.0], [0.7, 0.0]])
    pick = lambda hits: [(h["hotword_id"], h["variant"], h["score"], h["rank"], h["peak_frame"], h["chunk_id"], h["sample_count"], h["is_final"]) for h in hits]
    assert pick(one) == [("b", "v1", 0.9, 1, 1, 0, 4, False), ("a", "", 0.5, 2, 0, 0, 4, False)]
    assert pick(two) == [("b", "v1", 0.9, 1, 1, 1, 8, False), ("a", "", 0.7, 2, 3, 1, 8, False)]
    assert pick(s.finish()) == [("b", "v1", 0.9, 1, 1, 2, 9, True), ("a", "", 0.7, 2, 3, 2, 9, True)]
    assert s.finish() == s.last
    for again in (lambda: s.step(1, []), lambda: s.use(index)):
        with pytest.raises(RuntimeError):
            again()
    s.reset()
    s.use(Index.of([]))
    assert s.step(4, [[1.0, 1.0]]) == [[]] and s.finish() == []
    exact = Stream(index, 4, 2, 1)
    (hits,) = exact.step(4, [[1.0, 0.0], [0.0, 0.5]])
    assert pick(exact.finish()) == [(*pick(hits)[0][:-1], True)], "a boundary at the end is the last refresh itself"
    with pytest.raises(ValueError):
        Stream(index, 0, 1, 1)


def test_ten_thousand_keys(spark):
    """The stress size of an exact search: 10,000 keys of 512 dimensions against 125 frames, in one block and in several."""
    rng = np.random.default_rng(42)
    keys = rng.normal(size=(10_000, 512)).astype(np.float32)
    frames = rng.normal(size=(125, 512)).astype(np.float32)
    keys /= np.linalg.norm(keys, axis=1, keepdims=True)
    frames /= np.linalg.norm(frames, axis=1, keepdims=True)
    k = spark.createDataFrame([(f"h{i:05d}", "", v.tolist()) for i, v in enumerate(keys)], "hotword_id string, variant string, key array<float>")
    f = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(frames)], "utt int, frame int, vec array<float>")
    want = (frames.astype(np.float64) @ keys.astype(np.float64).T).round(6).max(axis=0)
    best = sorted(range(10_000), key=lambda i: (-want[i], i))[:50]
    for frame_rows, key_rows in ((4096, 16384), (50, 3000)):
        got = search.search_blocks(f, k, ["utt"], 50, frame_rows, key_rows).orderBy("rank").collect()
        assert [r.hotword_id for r in got] == [f"h{i:05d}" for i in best] and all(abs(r.score - want[i]) < 1e-5 for r, i in zip(got, best))


def test_growing_search_of_streams_without_a_name(spark):
    keys = spark.createDataFrame([("a", "", [1.0, 0.0]), ("b", "", [0.0, 1.0])], "hotword_id string, variant string, key array<double>")
    rows = [(None, 0, 0, [0.5, 0.2]), (None, 1, 1, [0.1, 0.9]), (None, 2, 2, [0.0, 0.0]), (7, 1, 0, [0.3, 0.1])]
    frames = spark.createDataFrame(rows, "u int, c int, frame int, vec array<double>")
    got = sorted((r.u or 0, r.c, r["rank"], r.hotword_id, r.score, r.peak_frame) for r in search.search_blocks(frames, keys, ["u", "c"], 1, 1, 1, growing=True).collect())
    assert got == [(0, 0, 1, "a", 0.5, 0), (0, 1, 1, "b", 0.9, 1), (0, 2, 1, "b", 0.9, 1), (7, 1, 1, "a", 0.3, 0)]
    assert search.search_blocks(frames.where("false"), keys, ["u", "c"], 1, growing=True).count() == 0

import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from phrasegrid.operators import lattice, match
from phrasegrid.streaming import kernel, posteriors, sessions
from phrasegrid.streaming.kernel import Candidates, Evidence, Policy


def test_rollback_and_commit():
    p = Policy()
    assert kernel.rollback_start(0, 25, [], 2, p) == 20
    assert kernel.rollback_start(0, 25, [18], 2, p) == 18
    assert kernel.rollback_start(45, 50, [3], 2, p) == 45
    assert kernel.rollback_start(0, 77, [3], 2, p) == 45
    assert kernel.rollback_start(0, 3, [], 2, p) == 1
    assert kernel.rollback_start(0, 3, [0], 2, p) == 0
    assert kernel.rollback_start(2, 9, [], 1, p) == 2
    with pytest.raises(kernel.RewrittenPrefix):
        kernel.rollback_start(5, 4, [], 9, p)
    assert kernel.commit_target([], list("abcdefgh"), 0, False, 2, p) == 3
    assert kernel.commit_target([], list("abcdefgh"), 2, True, 2, p) == 2
    assert kernel.commit_target([], list("abcdefgh"), 2, True, 1, p) == 0
    with pytest.raises(kernel.RewrittenPrefix):
        kernel.commit_target(["x"], list("abc"), 0, False, 3, p)


def test_rollback_column_is_the_rule(spark):
    rng = random.Random(0)
    rows = []
    for _ in range(300):
        c = rng.randint(0, 40)
        rows.append((c, c + rng.randint(0, 60), rng.choice([None, rng.randint(-5, 120)]), rng.randint(0, 4)))
    df = spark.createDataFrame(rows, "c int, n int, a int, k int")
    got = df.select("*", sessions.rollback_column(F.col("c"), F.col("n"), F.col("a"), F.col("k")).alias("r")).collect()
    assert all(r.r == kernel.rollback_start(r.c, r.n, [] if r.a is None else [r.a], r.k, Policy()) for r in got)


def test_candidate_life():
    c = Candidates(Policy(), {"a": 1.0, "b": 2.0})
    c.apply([Evidence("a", 0.5)], [], [], 0, 7)
    assert not c.held
    c.apply([Evidence("a", 0.6, 3, None)], [], [], 1, 7)
    assert c.holding() == ["a"] and c.held["a"]["anchor"] == 7
    c.apply([], [], [], 4, 9)
    assert c.held["a"]["status"] == "expired"
    c.apply([Evidence("a", 0.4, 1, 9)], [], [], 5, 9)  # the lower threshold holds for what was once seen; early anchors return
    assert (c.held["a"]["status"], c.held["a"]["anchor"], c.held["a"]["start"], c.held["a"]["first"]) == ("active", 7, 1, 1)
    c.apply([], [Evidence("a", 0.9), Evidence("b", 0.6)], [], 6, 9)
    assert c.ranked(("confirmed",)) == ["b", "a"]
    c.apply([], [Evidence("a", 0.5)], ["b"], 7, 9)
    assert c.held["a"]["confidence"] == 0.9 and c.held["b"]["status"] == "rejected"
    c.allow({"b"}, 8)
    assert c.held["a"]["status"] == "expired" and c.confidences() == {}
    with pytest.raises(KeyError):
        c.allow({"zz"}, 8)
    many = Candidates(Policy(most_live=2, most_prompted=1), {str(i): 1.0 for i in range(5)})
    many.apply([Evidence(str(i), 0.9) for i in range(5)], [], [], 0, 0)
    assert many.ranked(("active",)) == ["4", "3"] and many.prompted() == ["4"]
    with pytest.raises(ValueError):
        Policy(enter=0.2)


def test_matcher_keeps_unfinished_matches():
    a = match.Automaton()
    a.add("abcd", "long")
    a.add("cd", "long")
    a.freeze()
    m = kernel.Matcher(a)
    open_, done = m.consume("xab", 0, 0, None)
    assert [(e.phrase, e.confidence, e.start) for e in open_] == [("long", 0.99, 1)] and not done
    open_, done = m.consume("cd", 3, 0, None)
    assert [(e.phrase, e.start) for e in done] == [("long", 3)] and not open_
    assert m.consume("cd", 5, 0, {"other"}) == ([], [])
    still = kernel.Matcher(a, keep=False)
    assert still.consume("ab", 0, 0, None) == ([], [])


def test_token_bias():
    a = match.Automaton()
    a.add((1, 2), "x")
    a.add((1, 3), "y")
    a.freeze()
    assert kernel.token_bias(a, [9, 1], {"x": 0.8}, {"x": 1.5, "y": 1.0}) == {2: pytest.approx(2.4)}
    assert kernel.token_bias(a, [1], {"x": 9, "y": 0.1}, {"x": 9.0}) == {2: 4.0, 3: pytest.approx(0.2)}
    assert kernel.token_bias(a, [1], {}, {}) == {}


def test_lattice_repeats_and_blanks():
    a = match.Automaton()
    a.add(("p", "q"), "pq")
    a.add(("p", "p"), "pp")
    a.freeze()
    symbols = ["-", "p", "q"]
    frame = lambda *p: [math.log(x) for x in p]
    p, q, blank = frame(0.05, 0.9, 0.05), frame(0.05, 0.05, 0.9), frame(0.9, 0.05, 0.05)
    done = lambda *rows: {e.phrase for e in posteriors.Lattice(a).consume(list(rows), 0, 0, symbols, 0, None)[1]}
    assert done(p, q) == {"pq"} and done(p, p) == set() and done(p, blank, p) == {"pp"}
    split = posteriors.Lattice(a)
    open_, _ = split.consume([p], 0, 0, symbols, 4, None)
    assert {e.phrase for e in open_} == {"pq", "pp"} and open_[0].confidence == pytest.approx(0.9)
    _, complete = split.consume([q], 1, 0, symbols, 9, None)
    assert [(e.phrase, e.start, e.anchor) for e in complete] == [("pq", 0, 4)]
    assert complete[0].confidence == pytest.approx(0.9)


def test_lattice_on_tables_does_not_depend_on_partitions(spark):
    rng = random.Random(3)
    a = match.Automaton()
    for i in range(1, 6):
        a.add((f"s{i}", f"s{i % 5 + 1}"), f"p{i}")
    a.freeze()
    rows = []
    for s in range(4):
        for c in range(3):
            probs = [[rng.random() + 0.01 for _ in range(6)] for _ in range(5)]
            rows.append((f"k{s}", c, c * 5, [[math.log(x / sum(r)) for x in r] for r in probs]))
    df = spark.createDataFrame([*rows, ("k9", 0, 0, None)], "session_id string, chunk_id int, frame_offset int, log_probs array<array<double>>")
    run = lambda d: sorted(tuple(r) for r in lattice.lattice_matches(d, a, [f"s{i}" for i in range(6)], 0, least=0.1).collect())
    assert run(df) == run(df.repartition(5)) != []
    want = []
    for s in range(4):
        one = posteriors.Lattice(a, least=0.1)
        for _, c, offset, probs in rows[s * 3 : s * 3 + 3]:
            active, complete = one.consume(probs, offset, 0, [f"s{i}" for i in range(6)], 0, None)
            want += [(f"k{s}", c, k, e.phrase, e.confidence, e.start) for k, found in (("active", active), ("complete", complete)) for e in found]
    assert run(df.where("session_id <> 'k9'")) == sorted(want)


ENTRIES = [{"id": "h1", "text": "张三丰", "aliases": ["三丰"], "weight": 1.0}, {"id": "h2", "text": "北京大学", "aliases": None, "weight": None}]


def chunk_rows():
    texts = ["今天", "今天张三", "今天张三丰在北", "今天张三丰在北京大学讲", "今天张三丰在北京大学讲课好"]
    rows = [("s1", i, t, 16000, None, i == 4) for i, t in enumerate(texts)]
    rows += [("s2", i, t, 8000, ["h2"] if i == 1 else None, i == 4) for i, t in enumerate(texts)]
    rows += [("s5", i, t, 16000, None, i == 4) for i, t in enumerate(texts)]
    rows += [("s3", 0, None, None, None, True), ("s4", 0, "", 16000, None, False)]
    return rows


def with_overlay(spark):
    """Session s5 gets an entry of its own before its fourth chunk."""
    df = spark.createDataFrame(chunk_rows(), sessions.ROW)
    new = F.array(F.struct(F.lit("own").alias("id"), F.lit("讲课").alias("text"), F.lit(1.0).alias("weight")))
    return df.withColumn("overlay", F.when((F.col("session_id") == "s5") & (F.col("seq") == 3), new))


def test_session_matches_commits_and_ends(spark):
    catalog = kernel.Catalog.build(ENTRIES, sessions.folded)
    df = with_overlay(spark)
    rows = sorted(sessions.replay(df, catalog, Policy()).collect(), key=lambda r: (r.session_id, r.seq, r.is_final))
    one = [r for r in rows if r.session_id == "s1"]
    assert one[1].active_ids == ["h1"] and one[2].confirmed_ids == ["h1"]
    assert one[-1].is_final and one[-1].stable_text == "今天张三丰在北京大学讲课好" == "".join(r.committed_delta for r in one)
    assert all(b.stable_text.startswith(a.stable_text) for a, b in zip(one, one[1:]))
    two = [r for r in rows if r.session_id == "s2"]
    assert all(r.confirmed_ids in ([], ["h2"]) for r in two) and two[-1].audio_samples == 40000
    assert [r.is_final for r in rows if r.session_id == "s3"] == [True]
    five = [r for r in rows if r.session_id == "s5"]
    assert "own" in five[4].confirmed_ids and "h1" in five[3].confirmed_ids and not any("own" in r.confirmed_ids for r in one)
    assert sessions.replay(df.where("false"), catalog, Policy()).count() == 0
    with pytest.raises(ValueError):
        s = kernel.Session(catalog, Policy(), sessions.folded)
        s.step({"end": True})
        s.step({"end": True})


def spoken_rows():
    """Sessions whose sound is clearer than their text: symbols s1, s2 are heard, the text comes one chunk late."""
    def frame(i):
        return [math.log(0.97 if j == i else 0.01) for j in range(4)]

    texts = ["", "今", "今天张三", "今天张三丰"]
    sound = [[frame(1)], [frame(2), frame(0)], [], [frame(0)]]
    return [(sid, i, t, 16000, None, i == 3, sound[i]) for sid in ("a", "b") for i, t in enumerate(texts)]


SPOKEN = posteriors.Sounds(("-", "s1", "s2", "s3"), 0, {"least": 0.5})
HEARD = [{"id": "h1", "text": "张三丰", "weight": 1.0, "paths": [["s1", "s2"]]}, {"id": "h2", "text": "其他", "weight": 1.0, "paths": [["s3", "s3"]]}]


def test_candidates_come_from_sound_before_text(spark, tmp_path):
    catalog = kernel.Catalog.build(HEARD, sessions.folded)
    df = spark.createDataFrame(spoken_rows(), sessions.ROW + ", log_probs array<array<double>>")
    rows = sorted((r for r in sessions.replay(df, catalog, Policy(), SPOKEN).collect() if r.session_id == "a"), key=lambda r: (r.seq, r.is_final))
    assert rows[0].active_ids == ["h1"] and rows[1].confirmed_ids == ["h1"] and rows[0].open_paths > 0
    assert rows[1].prompt == "Hotwords: 张三丰" and rows[1].bias and all(k != "其" for k in rows[1].bias)
    deaf = sorted((r for r in sessions.replay(df, catalog, Policy()).collect() if r.session_id == "a"), key=lambda r: (r.seq, r.is_final))
    assert deaf[0].active_ids == [] and deaf[1].confirmed_ids == [] and deaf[0].open_paths == 0
    parts = df.where("seq < 2"), df.where("seq >= 2")
    for k, part in enumerate(parts):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/f{k}"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    sessions.write_trace(sessions.stream(src, catalog, Policy(), SPOKEN), str(tmp_path / "trace"), str(tmp_path / "ck"), 2).awaitTermination()
    lines = [json.loads(r.value) for r in spark.read.option("recursiveFileLookup", "true").text(str(tmp_path / "trace")).collect()]
    keep = lambda r: (r["session_id"], r["seq"], r["is_final"], r["confirmed_ids"], r["stable_text"], sorted(r["bias"].items()))
    assert sorted(map(keep, lines)) == sorted(keep(r.asDict()) for r in sessions.replay(df, catalog, Policy(), SPOKEN).collect())
    files = [p for p in (tmp_path / "trace").rglob("part-*")]
    assert len(files) <= 2 * 2, "files do not grow with sessions"


def test_tokens_are_those_of_the_tokenizer():
    words = kernel.Tokenizer(str.split, " ".join)
    catalog = kernel.Catalog.build([{"id": "x", "text": "new york"}], sessions.folded)
    s = kernel.Session(catalog, Policy(rollback=1, unfixed_chunks=0), sessions.folded, tokenizer=words)
    out = [s.step({"hypothesis": t, "n_samples": 16000})[0] for t in ("we go to", "we go to new", "we go to new york soon")]
    assert out[0]["stable_text"] == "we go" and out[1]["rollback_start"] == 3
    assert out[2]["confirmed_ids"] == ["x"] and s.step({"end": True})[0]["stable_text"] == "we go to new york soon"
    assert kernel.biased([0.0, 1.0], {1: 2.5}) == [0.0, 3.5]
    again = kernel.Session(catalog, Policy(lookahead_samples=3200, unsure_low=0.0, unsure_high=1.0, enter=0.1, leave=0.1), sessions.folded)
    again.step({"hypothesis": "new", "n_samples": 16000})
    assert again.needed() == 19200
    again.reset()
    assert again.needed() == 16000 and again.tokens == [] and again.chunk == 0


def test_state_survives_as_json():
    catalog = kernel.Catalog.build(ENTRIES, sessions.folded)
    rows = [dict(zip(("session_id", "seq", "hypothesis", "n_samples", "enabled", "end"), r)) for r in chunk_rows() if r[0] == "s1"]
    rows[2]["overlay"] = [{"id": "own", "text": "在北", "weight": 2.0}]
    whole = kernel.Session(catalog, Policy(), sessions.folded)
    want = [x for r in rows for x in whole.step(r)]
    got, state = [], None
    for r in rows:
        s = kernel.Session(catalog, Policy(), sessions.folded)
        if state:
            s.load(state)
        got += s.step(r)
        state = s.dump()
        json.loads(state)
    drop = lambda rows: [{k: v for k, v in r.items() if k != "processing_ms"} for r in rows]
    assert drop(got) == drop(want)


def test_stream_equals_replay(spark, tmp_path):
    catalog = kernel.Catalog.build(ENTRIES, sessions.folded)
    df = with_overlay(spark)
    for k in range(3):  # three files, one micro-batch each
        part = {0: "seq < 2", 1: "seq = 2", 2: "seq > 2"}[k]
        df.where(part).coalesce(1).write.parquet(str(tmp_path / f"in/f{k}"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(str(tmp_path / "in"))
    q = sessions.write_trace(sessions.stream(src, catalog, Policy()), str(tmp_path / "trace"), str(tmp_path / "ck"))
    q.awaitTermination()
    lines = spark.read.option("recursiveFileLookup", "true").text(str(tmp_path / "trace"))
    got = sorted(json.loads(r.value)["stable_text"] + str(json.loads(r.value)["seq"]) + json.loads(r.value)["session_id"] for r in lines.collect())
    want = sorted(r.stable_text + str(r.seq) + r.session_id for r in sessions.replay(df, catalog, Policy()).collect())
    assert got == want


def test_refreshes(spark):
    df = spark.createDataFrame([("a", 0, 3), ("a", 1, 5), ("b", 0, 4), ("c", 0, 0), ("d", 0, 9)], "k string, i int, n int")
    got = sorted(tuple(r) for r in sessions.refreshes(df, ["k"], "i", "n", 4).select("k", "i", "chunk_id", "sample_count", "is_final").collect())
    assert got == [("a", 1, 0, 4, False), ("a", 1, 1, 8, True), ("b", 0, 0, 4, True), ("c", 0, 0, 0, True), ("d", 0, 0, 4, False), ("d", 0, 1, 8, False), ("d", 0, 2, 9, True)]


def all_ways(a, symbols, rows, blank):
    """Every path and its summed probability after the last frame, by walking all sequences of tokens one by one."""
    total = {}
    for start in range(len(rows)):
        for tokens in itertools.product(range(len(symbols)), repeat=len(rows) - start):
            node, last, rested, p = 0, None, False, 1.0
            for i, t in enumerate(tokens):
                p *= math.exp(rows[start + i][t])
                if t == blank and i:
                    rested = True
                elif i and t == last and not rested:
                    pass
                else:
                    node = a.next[node].get(symbols[t]) if t != blank else None
                    last, rested = t, False
                if node is None:
                    break
            else:
                key = (node, last, int(rested), start)
                total[key] = total.get(key, 0.0) + p
    return total


def test_paths_sum_all_ways():
    rng = random.Random(7)
    symbols = ["-", "x", "y", "z"]
    for _ in range(20):
        a = match.Automaton()
        for i in range(4):
            a.add(tuple(rng.choice("xyz") for _ in range(rng.randint(1, 4))), f"p{i}")
        a.freeze()
        rows = []
        for _ in range(5):
            w = [rng.random() + 0.01 for _ in symbols]
            rows.append([math.log(x / sum(w)) for x in w])
        one, two = posteriors.Lattice(a, 10_000, 1e9, 9, 99, 0.0), posteriors.Lattice(a, 10_000, 1e9, 9, 99, 0.0)
        one.consume(rows, 0, 0, symbols, 0, None)
        two.consume(rows[:2], 0, 0, symbols, 0, None)
        saved = json.loads(json.dumps(two.dump()))
        two = posteriors.Lattice(a, 10_000, 1e9, 9, 99, 0.0)
        two.load(saved)
        two.consume(rows[2:], 2, 0, symbols, 0, None)
        want = all_ways(a, symbols, rows, 0)
        for lattice_ in (one, two):
            got = {tuple(s[:4]): math.exp(v) for s, v in zip(lattice_.state.tolist(), lattice_.score.tolist())}
            assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
        tight = posteriors.Lattice(a, 3, 1e9)
        tight.consume(rows, 0, 0, symbols, 0, None)
        assert len(tight.score) <= 3 and (tight.score[:-1] >= tight.score[1:]).all()


def test_edges_of_paths():
    a = match.Automaton()
    a.add(("p",), "p")
    a.freeze()
    lattice_ = posteriors.Lattice(a)
    assert lattice_.consume([], 0, 0, ["-", "p"], 0, None) == ([], [])
    assert lattice_.consume([[0.0, -math.inf]], 0, 0, ["-", "p"], 0, None)[1] == []
    assert [e.phrase for e in lattice_.consume([[-5.0, 0.0]], 1, 0, ["-", "p"], 0, {"p"})[1]] == ["p"]
    assert lattice_.consume([[-5.0, 0.0]], 2, 0, ["-", "p"], 0, set()) == ([], [])
    empty = posteriors.Lattice(match.Automaton().freeze())
    assert empty.consume([[0.0, 0.0]], 0, 0, ["-", "p"], 0, None) == ([], [])

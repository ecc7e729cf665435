import datetime
import random
from collections import Counter

from phrasegrid.llm import frequencies, queries


def grams(records, n):
    tf, df = Counter(), Counter()
    for tokens in records:
        runs, run = [], []
        for t in [*(tokens or []), None]:
            if t is None:
                runs.append(run)
                run = []
            else:
                run.append(t)
        found = [tuple(r[i : i + k]) for r in runs for k in range(1, n + 1) for i in range(len(r) - k + 1)]
        tf.update(found)
        df.update(set(found))
    return {g: (tf[g], df[g]) for g in tf}


def test_ngrams_equal_brute_force(spark):
    rng = random.Random(1)
    records = [rng.choices(["a", "b", "词", "", "\x00", None], k=rng.randint(0, 12)) for _ in range(300)] + [None, [], ["a"] * 500, ["x" * 20_000] * 2] + [["b", "a"]] * 200
    df = spark.createDataFrame([(t, 1, "clash") for t in records], "tokens array<string>, occurrences int, records string").repartition(5)
    got = frequencies.ngram_frequencies(df, "tokens", 4)
    assert {tuple(r.gram): (r.occurrences, r.records) for r in got.collect()} == grams(records, 4)
    assert frequencies.ngram_frequencies(df.where("false"), "tokens", 4).count() == 0


def test_intervals_cut_by_partitions_add_up(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        records = [["a", "a", chr(0x4E00 + i % 90)] for i in range(400)]
        df = spark.createDataFrame([(t,) for t in records], "tokens array<string>")
        got = frequencies.ngram_frequencies(df, "tokens", 3)
        assert {tuple(r.gram): (r.occurrences, r.records) for r in got.collect()} == grams(records, 3)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_terms(spark):
    big = 2**63 - 1
    rows = [
        (1, "s1", "词 汇", {"a": 2, "b": None}, 1), (1, "s1", "词汇", {"a": 3}, 2), (2, "s2", "词汇\n", {"a": 0}, 1), (3, "s2", "词汇", None, 1), (4, "s2", "词汇", {}, 1),
        (5, "s3", None, {"a": 9}, 1), (6, None, "Ａ", {"a": 1}, 1), (None, "s1", "Ａ", {"a": 1}, 1), (None, "s1", "Ａ", {"a": 1}, 1), (7, "s1", "", {"a": 5}, 1),
        (8, "s1", "大", {"a": big, "b": big}, 1), (9, "s2", "大", {"a": big}, 1), (10, "s3", "长" * 100_000, {"a": 1}, 1),
    ]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "entry_id bigint, shard_id string, text string, source_frequencies map<string,bigint>, loaded_at int, total int, term string")
    got = {r.term: (r.total, r.records, r.shards, r.mark) for r in frequencies.mark_terms(frequencies.term_frequencies(df), 3).collect()}
    assert got["词汇"] == (3, 4, 1, "rare")
    assert got["A"] == (3, 3, 1, "rare")
    assert got[""] == (5, 1, 1, None)
    assert got["大"] == (big, 2, 2, "common")
    assert got["长" * 100_000] == (1, 1, 1, "rare")
    assert len(got) == 5
    assert frequencies.term_frequencies(df.where("false")).count() == 0


def shards_of(rows):
    """Brute force of (term, shard, total) rows: totals, records and shards."""
    total, records, by_shard = Counter(), Counter(), Counter()
    for t, shard, n in rows:
        total[t] += n
        records[t] += 1
        by_shard[t, shard] += n
    shards = Counter(t for (t, shard), n in by_shard.items() if n >= 1 and shard is not None)
    return {t: (total[t], records[t], shards[t]) for t in records}


def hot_values():
    rng = random.Random(3)
    rows = [(rng.choice(["热", "b", "c", "", f"x{rng.randint(0, 50)}"]), rng.choice(["s1", "s1", "s2", f"s{rng.randint(0, 99)}", None]), rng.choice([0, 0, 1, 2**62])) for _ in range(5000)]
    return rows + [("hot", "s1", 1)] * 3000 + [("hot", f"s{i}", i % 2) for i in range(2000)]


def test_values_in_documents_equal_brute_force(spark):
    rows = hot_values()
    df = spark.createDataFrame([*rows, (None, "s1", 5), ("b", "s1", None)], "v string, d string, n bigint").repartition(7)
    rows.append(("b", "s1", 0))
    want = {t: (min(a, 2**63 - 1), b, c) for t, (a, b, c) in shards_of(rows).items()}
    keys = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = [spark.conf.get(k) for k in keys]
    try:
        for values in (before, ("false", "23", "10000"), ("false", "5", "3")):
            for k, v in zip(keys, values):
                spark.conf.set(k, v)
            got = frequencies.value_frequencies(df, "v", "d", "n").collect()
            assert {r.term: (r.total, r.records, r.shards) for r in got} == want and len(got) == len(want)
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)


def test_shards_come_from_the_intervals(spark, monkeypatch):
    """With a kernel that gives every row back as it came, the counts of shards are wrong: nothing behind it makes up for that."""
    import pyarrow as pa

    def identity():
        def run(batches):
            for b in batches:
                n = b.column("n")
                yield pa.RecordBatch.from_arrays([b.column("value"), b.column("low"), n, n, pa.array([False] * b.num_rows)], names=["term", "total", "records", "shards", "edge"])

        return run

    rows = hot_values()
    df = spark.createDataFrame(rows, "v string, d string, n bigint").repartition(7)
    monkeypatch.setattr(frequencies, "_value_intervals", identity)
    got = {r.term: r.shards for r in frequencies.value_frequencies(df, "v", "d", "n").collect()}
    assert got != {t: c for t, (_, _, c) in shards_of(rows).items()}


def entries_at(spark, path, rows):
    df = spark.createDataFrame(rows, "entry_id bigint, shard_id string, text string, source_frequencies map<string,bigint>, loaded_at timestamp_ntz")
    df.write.parquet(f"{path}/word_entries.parquet")
    return str(path)


def character_ngrams(spark, d):
    return {tuple(r.ngram): (r.occurrences, r.records) for r in queries.p5_ngrams(spark, d).collect()}


def test_ngrams_of_any_length(spark, monkeypatch):
    monkeypatch.setattr(frequencies, "_HELD", 50)
    rng = random.Random(2)
    records = [rng.choices(["a", "b", "词", None], k=rng.randint(0, 40)) for _ in range(60)] + [["a"] * 70, ["a"] * 70, None, []]
    df = spark.createDataFrame([(t,) for t in records], "tokens array<string>").repartition(5)
    got = frequencies.ngram_frequencies(df, "tokens").collect()
    assert len(got) == len({tuple(r.gram) for r in got})
    assert {tuple(r.gram): (r.occurrences, r.records) for r in got} == grams(records, 70)


def test_query_counts_ngrams_as_long_as_the_terms(spark, tmp_path):
    texts = ["abcdefghi", "ＡＢabcdefgh", "abababababab", "语音识别热词增强系统", None]
    d = entries_at(spark, tmp_path, [(i, "s", t, None, datetime.datetime(2026, 1, 1)) for i, t in enumerate(texts)])
    assert character_ngrams(spark, d) == grams(["abcdefghi", "ABabcdefgh", "abababababab", "语音识别热词增强系统"], 12)


def test_query_counts_a_record_loaded_twice_once(spark, tmp_path):
    day = lambda n: datetime.datetime(2026, 1, n)
    rows = [(1, "旧词", 1), (1, "新词", 2), (2, "新词", 1), (2, "新 词", 1), (3, "留下", 1), (3, None, 2), (None, "词", 1), (None, "词", 1)]
    d = entries_at(spark, tmp_path, [(i, "s", t, None, day(n)) for i, t, n in rows])
    assert character_ngrams(spark, d) == grams(["新词", "新词", "留下", "词", "词"], 2)

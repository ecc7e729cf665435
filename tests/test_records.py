import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from phrasegrid.operators import badrows, nested
from phrasegrid.plans import records
from phrasegrid.plans.records import MANIFEST_TABLES, RUN_TABLES

BATCH = "struct<accumulated_audio_sec:double,chunk_id:int,hits:array<struct<hotword_id:string,score:double>>,timings_ms:map<string,double>>"
TAGS = {k: v for k, v in RUN_TABLES.items()}


def runs(spark, rows):
    return spark.createDataFrame(rows, f"run_no bigint, tag string, root string, batches array<{BATCH}>, final_batch {BATCH}")


def hit(name, score=1.0):
    return {"hotword_id": name, "score": score}


def batch(chunk, hits, timings=None):
    return {"accumulated_audio_sec": 1.0, "chunk_id": chunk, "hits": hits, "timings_ms": timings}


def test_structs_keep_places_and_parents(spark):
    df = runs(
        spark,
        [
            (1, "clash", "clash", [batch(0, [hit("a"), None, hit(None)], {"x": 1.0, "y": None}), None, batch(None, [])], batch(3, [hit("f")])),
            (2, None, None, None, None),
            (None, "t", "r", [], batch(0, None)),
            (1, "clash", "clash", [batch(0, [hit("a")])], None),
        ],
    )
    flat = nested.emit_structs(df, "run_no", TAGS).store()
    hits = sorted((tuple(r.pos), r.hotword_id or "", tuple(r.parent_pos), r.root) for r in flat.table("hit").collect())
    assert hits == [((0, 0), "a", (0,), 1), ((0, 0), "a", (0,), 1), ((0, 2), "", (0,), 1)]
    assert [(tuple(r.pos), r.hotword_id, r.parent_tag) for r in flat.table("final_hit").collect()] == [((0, 0), "f", "final_batch")]
    assert sorted((tuple(r.pos), r.name, r.value) for r in flat.table("timing").collect()) == [((0, 0), "x", 1.0), ((0, 1), "y", None)]
    assert flat.table("record").count() == 4
    assert sorted(r.tag or "" for r in flat.table("record").collect()) == ["", "clash", "clash", "t"]
    assert flat.table("batch").where("chunk_id is null").count() == 1


def test_structs_of_empty_table(spark):
    flat = nested.emit_structs(runs(spark, []), "run_no", TAGS).store()
    assert [flat.table(t).count() for t in ("record", "batch", "hit", "timing")] == [0, 0, 0, 0]


def mentions(spark, values):
    df = spark.createDataFrame([(i, v, "clash") for i, v in enumerate(values)], "record_no bigint, value string, tag string")
    return nested.emit_json(df, "record_no", "value", (nested.Marked("mention", "char_start", ("entity_type",)),), MANIFEST_TABLES).store()


def test_json_at_any_depth(spark):
    m = {"char_start": 0, "entity_type": "PER", "text": "x"}
    deep = {"a": [{"b": {"c": [{"list": [None, {"char_start": 1, "attrs": {"more": [{"entity_type": "LOC"}]}}]}]}}]}
    values = [
        json.dumps({"key": "k", "entities": [m, None, {"char_start": 2, "entity_type": None}]}),
        json.dumps({"entities": m}),
        json.dumps({"annotations": [{"entities": []}, {"entities": [m]}]}),
        json.dumps({"segments": [{}, {"entities": {"char_start": 5, "attrs": {"entity_type": "ORG"}}}]}),
        json.dumps(deep),
        json.dumps({"key": "none"}),
        "[1, 2]",
        "not json",
        None,
        json.dumps({"entities": [m] * 5000, "text": "长" * 200_000}),
        '{"a\\ud83d": "\\ude00", "entities": [{"char_start": NaN, "entity_type": "x\\ud83d"}]}',
    ]
    flat = mentions(spark, values)
    rows = [(r.root, r.outer_pos, r.inner_pos, r.entity_type) for r in flat.table("mention").collect()]
    small = sorted((r for r in rows if r[0] != 9), key=lambda r: r[:3])
    assert small == [(0, 0, 0, "PER"), (0, 0, 2, None), (1, 0, 0, "PER"), (2, 1, 0, "PER"), (3, 1, 0, "ORG"), (4, 0, 1, "LOC"), (10, 0, 0, "x?")]
    assert sorted(r[2] for r in rows if r[0] == 9) == list(range(5000))
    assert flat.rows.where("tag = '_corrupt'").count() == 2
    assert {r.key for r in flat.table("record").collect()} >= {"k", "none"}


def judge(line):
    """The format, said again in plain Python."""
    if line is None:
        return None, None
    if line.startswith("﻿"):
        line = line[1:]
    line = line.strip()
    if not line or line.startswith("#"):
        return None, None
    if line.startswith('"'):
        i, term = 1, ""
        while i < len(line):
            if line[i] == '"':
                if line[i + 1 : i + 2] == '"':
                    term += '"'
                    i += 2
                    continue
                break
            term += line[i]
            i += 1
        rest = line[i + 1 :]
        if i >= len(line) or '"' in rest or (rest and not rest[0].isspace()):
            return "quoting", None
        fields = [term, *rest.split()]
    else:
        if '"' in line:
            return "quoting", None
        fields = line.split()
    if len(fields) != 2:
        return "columns", None
    count = fields[1]
    if not (count.isascii() and count.isdigit()) or not 1 <= int(count) <= 9223372036854775807:
        return "count", None
    term = "".join(unicodedata.normalize("NFKC", fields[0]).split())
    if not any(unicodedata.category(c)[0] in "LN" for c in term) or any(unicodedata.category(c) == "Cc" or c == "�" for c in term):
        return "term", None
    return "ok", (term, int(count))


LINES = [
    None, "", "  ", "# c", "﻿# c", "﻿词 3", "词 3", "词　3", "词\xa03", "词 3\n", "词\t\t3 ", '"a b" 3', '"a""b" 3', '"a"" 3', '"" 3', '""" 3', '"""" 3',
    '"a"x 3', 'a"b 3', '"a" "3"', '"a"', "a", "a b 3", "a 3 4", "a 0", "a 00", "a 007", "a -1", "a +1", "a 1.0", "a 1e3", "a ٣", "a ３", "a 9223372036854775807", "a 9223372036854775808",
    "a " + "0" * 40 + "5", "a 5²", "… 1", "♪ 2", "a\x01b 2", "�字 2", "ａ​ｂ 2", "① 4", "㈱ 2", "⾦ 3", "长" * 300_000 + " 7", '"' + "长 " * 100_000 + '" 7', '"' * 100_001 + " 1", "a b 1", " ﻿词 3",
]


def test_lines_match_plain_python(spark):
    rng = random.Random(4)
    alphabet = ['"', '""', " ", "\t", "　", "a", "词", "1", "0", "-", "#", "﻿", "\x7f", "²", "Ａ", "\n"]
    lines = LINES + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    df = spark.createDataFrame([(i, v, "t", 1) for i, v in enumerate(lines)], "line_id bigint, value string, term string, count int")
    bad = {r.line_id: r.reason for r in badrows.rejected(df.drop("term", "count"), "value").select("line_id", "reason").collect()}
    good = {r.line_id: (r.term, r["count"]) for r in badrows.loaded(df, "value").collect()}
    for i, line in enumerate(lines):
        reason, value = judge(line)
        assert bad.get(i) == (reason if reason != "ok" else None), (line[:80], reason, bad.get(i))
        assert good.get(i) == value, line[:80]


def test_lines_of_empty_table(spark):
    df = spark.createDataFrame([], "line_id bigint, value string")
    assert badrows.rejected(df, "value").count() == 0
    assert badrows.loaded(df, "value").columns == ["line_id", "term", "count"]


@pytest.mark.parametrize("copies", [1, 3])
def test_repeated_lines_count_each(spark, copies):
    df = spark.createDataFrame([(7, "x y z")] * copies, "line_id bigint, value string")
    assert badrows.rejected(df, "value").where(F.col("reason") == "columns").count() == copies


def test_records_of_any_depth_keep_their_links(spark):
    deep = '{"a":' * 5000 + '{"char_start": 3, "text": "x", "deep": {"entity_type": "PER"}}' + "}" * 5000
    lists = '{"l":' + "[" * 3000 + '{"char_start": 1}' + "]" * 3000 + "}"
    broken = '{"a":' * 5000 + "1" + "}" * 4999
    df = spark.createDataFrame([(1, deep), (2, lists), (3, broken), (4, "[1]"), (5, None)], "n bigint, v string")
    tagged = nested.emit_json(df, "n", "v", (nested.Marked("mention", "char_start", ("entity_type",)),), {"mention": records.MENTION}).store()
    found = {r.root: r for r in tagged.table("mention").collect()}
    assert set(found) == {1, 2} and found[1].entity_type == "PER" and found[1].text == "x"
    assert found[1].path == ".".join(["a"] * 5000) and found[1].parent_path == ".".join(["a"] * 4999)
    assert found[2].pos == [0] * 3000 and found[2].parent_tag == "record"
    assert sorted((r.root, r.value) for r in tagged.corrupt().collect()) == [(3, broken), (4, "[1]")]


def test_deep_parser_agrees_with_the_shallow_one():
    rng = random.Random(5)

    def value(depth):
        kind = rng.randint(0, 7 if depth else 5)
        if kind == 6:
            return {rng.choice("abc"): value(depth - 1) for _ in range(3)}
        return [value(depth - 1) for _ in range(3)] if kind == 7 else [1, -2.5e3, "a\"\\\u0001词", None, True, ""][kind]

    for _ in range(300):
        v = {"x": value(4)}
        text = json.dumps(v, indent=rng.choice([None, 1]))
        assert nested._parse_deep(text) == v
        broken = list(text)
        broken[rng.randrange(len(broken))] = rng.choice('{}[],:"x1 ')
        broken = "".join(broken)
        try:
            want = json.loads(broken)
        except ValueError:
            with pytest.raises(ValueError):
                nested._parse_deep(broken)
        else:
            assert nested._parse_deep(broken) == want
    for bad in ("", "{", "[1,]", '{"a":1,}', "{,}", "[}", "1 2", '{"a" 1}', "]", "nul"):
        with pytest.raises(ValueError):
            nested._parse_deep(bad)
    deep = []
    for _ in range(4000):
        deep = [deep, {"k": 1}]
    assert nested._parse_deep(nested._dump(deep))[1] == {"k": 1}

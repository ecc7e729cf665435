"""Annotated transcripts, aligned spans, boundary variants, and reconciling what was expected with what came."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import alignment_text, safe_id

#: Opening and closing marks of entity types.
MARKS = {"[": ("]", "PER"), "(": (")", "LOC"), "<": (">", "ORG")}
_CLOSING = frozenset(c for c, _ in MARKS.values())

MENTION = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("entity_type", T.StringType()),
        T.StructField("char_start", T.IntegerType()),
        T.StructField("char_end", T.IntegerType()),
        T.StructField("occurrence_index", T.IntegerType()),
    ]
)
PARSED = T.StructType([T.StructField("transcript", T.StringType()), T.StructField("mentions", T.ArrayType(MENTION)), T.StructField("error", T.StringType())])


def scan(text: str, marks: dict[str, tuple[str, str]] | None = None) -> tuple[str, list[tuple], str | None]:
    """Plain transcript, mentions and the reason why a text cannot be parsed (else None)."""
    marks = marks or MARKS
    closing = {c for c, _ in marks.values()}
    source = unicodedata.normalize("NFKC", text).strip()
    plain: list[str] = []
    size = 0
    mentions: list[tuple] = []
    seen: dict[str, int] = {}
    at = 0
    while at < len(source):
        ch = source[at]
        if ch in marks:
            end, kind = marks[ch]
            to = source.find(end, at + 1)
            if to < 0:
                return "", [], f"unclosed {kind} mark at {at}"
            inside = source[at + 1 : to]
            if any(c in marks or c in closing for c in inside):
                return "", [], f"nested mark at {at}"
            entity = "".join(inside.split())
            if not entity:
                return "", [], f"empty {kind} entity at {at}"
            mentions.append((entity, kind, size, size + len(entity), seen.get(entity, 0)))
            seen[entity] = seen.get(entity, 0) + 1
            plain.append(entity)
            size += len(entity)
            at = to + 1
            continue
        if ch in closing:
            return "", [], f"unmatched {ch} at {at}"
        if not ch.isspace():
            plain.append(ch)
            size += 1
        at += 1
    transcript = "".join(plain)
    return (transcript, mentions, None) if transcript else ("", [], "empty transcript")


def parse_annotated(df: DataFrame, text: str, marks: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """``df`` with ``transcript``, ``mentions`` and ``error``; a null text gives nulls."""

    def run(s: pd.Series) -> pd.DataFrame:
        rows = [(None, None, None) if x is None else scan(x, marks) for x in s]
        out = [(t, [dict(zip(MENTION.fieldNames(), m)) for m in ms] if ms is not None else None, e) for t, ms, e in rows]
        return pd.DataFrame(out, columns=PARSED.fieldNames())

    run.__annotations__ = {"s": pd.Series, "return": pd.DataFrame}
    return df.withColumn("__p", F.pandas_udf(run, PARSED)(F.col(text))).select(*df.columns, "__p.transcript", "__p.mentions", "__p.error")


def occurrence_index(mentions: DataFrame, record: str, text: str = "text", start: str = "char_start") -> DataFrame:
    """0-based running number of the same surface form within its record, by place."""
    w = Window.partitionBy(record, text).orderBy(start)
    return mentions.withColumn("occurrence_index", F.row_number().over(w) - 1)


def mention_ids(mentions: DataFrame, record: str, index: str) -> DataFrame:
    return mentions.withColumn("mention_id", F.format_string("%s#entity-%02d", F.col(record), F.col(index)))


def mention_stats(mentions: DataFrame) -> DataFrame:
    """Per text: sorted distinct types and number of mentions."""
    return mentions.groupBy("text").agg(F.sort_array(F.collect_set("entity_type")).alias("entity_types"), F.count(F.lit(1)).alias("mention_count"))


def target_ids(current: Column, legacy: Column | None = None) -> Column:
    """Distinct ids in order, blank ones dropped, from the current field or else the legacy one."""
    value = current if legacy is None else F.coalesce(current, legacy)
    return F.array_distinct(F.filter(F.coalesce(value, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")))


def string_or_array(text: Column) -> Column:
    """A JSON value that is a string, an array of strings or absent, as an array."""
    parsed = F.from_json(text, "array<string>")
    return F.when(text.isNull(), F.array().cast("array<string>")).when(text.startswith("["), parsed).otherwise(F.array(text))


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor blank, as it is."""
    from ..functions.text import SPACE

    return F.coalesce(*(F.when(v.rlike(f"[^{SPACE[1:-1]}]"), v) for v in values))


def find_spans(aligned: DataFrame, keys: list[str], items: str = "items", variants: str = "variants") -> DataFrame:
    """All places, overlapping ones too, where a variant covers consecutive aligned items: ``keys, variant, start_time,
    end_time, first_item, last_item, span_index``.

    Items and variants are compared normalised; a place found by two variants counts for the earlier one; spans are
    numbered by start, end, variant.
    """
    item = aligned.select(*keys, F.posexplode(items).alias("__i", "__it")).select(
        *keys, "__i", alignment_text(F.col("__it.text")).alias("__t"), F.col("__it.start_time").alias("__s"), F.col("__it.end_time").alias("__e")
    )
    flat = item.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__i", "__t", "__s", "__e"))).alias("__items"))
    chars = F.filter(F.split(F.array_join(F.transform("__items", lambda x: x["__t"]), ""), ""), lambda c: c != "")
    owner = F.flatten(F.transform("__items", lambda x: F.array_repeat(x["__i"], F.length(x["__t"]))))
    flat = flat.withColumns({"__chars": chars, "__owner": owner})
    var = aligned.select(*keys, F.posexplode(variants).alias("__v", "variant")).withColumn("__norm", alignment_text(F.col("variant"))).where("__norm <> ''")
    first = Window.partitionBy(*keys, "__norm").orderBy("__v")
    var = var.withColumn("__n", F.row_number().over(first)).where("__n = 1").select(*keys, "__v", "variant", F.filter(F.split("__norm", ""), lambda c: c != "").alias("__want"))
    joined = var.join(flat, keys)
    # A character of an array is reached at once, wherever it stands: a place costs one look, unless the variant begins there.
    n = F.size("__want")
    begins = lambda p: (F.element_at("__chars", p) == F.element_at("__want", F.lit(1))) & (F.slice(F.col("__chars"), p, n) == F.col("__want"))
    places = F.filter(F.sequence(F.lit(1), F.size("__chars") - n + 1), begins)

    def span(p: Column) -> Column:
        a, z = F.element_at("__owner", p), F.element_at("__owner", p + n - 1)
        return F.struct(
            p.alias("__p"), a.alias("first_item"), z.alias("last_item"), F.element_at("__items", a + 1)["__s"].alias("start_time"), F.element_at("__items", z + 1)["__e"].alias("end_time")
        )

    hits = joined.where(F.size("__chars") >= n).select(*keys, "variant", "__v", F.explode(F.transform(places, span)).alias("__h")).select(*keys, "variant", "__v", "__h.*")
    best = Window.partitionBy(*keys, "first_item", "last_item").orderBy("__v", "__p")
    hits = hits.withColumn("__n", F.row_number().over(best)).where("__n = 1")
    spans = hits.select(*keys, "variant", "start_time", "end_time", "first_item", "last_item")
    order = Window.partitionBy(*keys).orderBy("start_time", "end_time", "variant", "first_item")
    return spans.withColumn("span_index", F.row_number().over(order) - 1)


def resolve_spans(spans: DataFrame, wanted: DataFrame, keys: list[str], policy: str = "error") -> DataFrame:
    """One span per row of ``wanted`` (``keys``, ``occurrence_index`` or null), with ``error`` where none can be given.

    An annotated occurrence goes before the policy ('error', 'first' or 'last' of several).
    """
    if policy not in ("error", "first", "last"):
        raise ValueError(f"unknown occurrence policy {policy}")
    counts = spans.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    w = wanted.join(counts, keys, "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
    pick = F.col("occurrence_index")
    at = F.when(pick.isNotNull(), pick).when(F.col("__n") == 1, 0).when(F.lit(policy == "first"), 0).when(F.lit(policy == "last"), F.col("__n") - 1)
    error = (
        F.when(F.col("__n") == 0, "absent")
        .when(pick.isNotNull() & ((pick < 0) | (pick >= F.col("__n"))), "occurrence unavailable")
        .when(at.isNull(), "ambiguous")
    )
    w = w.withColumns({"__at": F.when(error.isNull(), at), "__err": error})
    s = spans.withColumnRenamed("span_index", "__at")
    out = w.join(s, [*keys, "__at"], "left")
    zero = F.when(F.col("__err").isNull() & (F.col("end_time") <= F.col("start_time")), "zero duration")
    return out.withColumn("error", F.coalesce("__err", zero)).drop("__n", "__at", "__err")


def aligned_records(resolved: DataFrame, source_utt: str, mention: str, mentions_in_record: str) -> DataFrame:
    """Rows with ``utt_id`` (the source's own for a single mention) and times at millisecond precision, half to even."""
    name = safe_id(F.col(mention))
    many = F.concat(F.col(source_utt), F.lit("__mention_"), F.when(name == "", F.lit("0")).otherwise(name))
    return resolved.withColumns(
        {
            "utt_id": F.when(F.col(mentions_in_record) > 1, many).otherwise(F.col(source_utt)),
            "hotword_start_sec": F.bround("start_time", 3),
            "hotword_end_sec": F.bround("end_time", 3),
        }
    )


#: Placements of a keyword against a chunk boundary.
CONDITIONS = (
    ("center", "center", 0.5),
    ("b-400", "before", 0.4),
    ("b-200", "before", 0.2),
    ("b-100", "before", 0.1),
    ("cross-25", "cross", 0.25),
    ("cross-50", "cross", 0.5),
    ("cross-75", "cross", 0.75),
)


def leading_silence(start: Column, end: Column, chunk: Column, kind: Column, value: Column) -> Column:
    """Least silence before the recording that puts the span where the condition wants it; null for invalid spans."""
    middle = (start + end) / 2
    landmark = F.when(kind == "cross", start + (end - start) * (1 - value)).otherwise(middle)
    phase = F.when(kind == "center", chunk / 2).when(kind == "before", chunk - value).when(kind == "cross", F.lit(0.0))
    cycles = F.greatest(F.lit(0), F.ceil((landmark - phase) / chunk))
    return F.when((start >= 0) & (start < end) & (chunk > 0), phase + cycles * chunk - landmark)


def boundary_variants(spans: DataFrame, chunk_sec: float, start: str, end: str, conditions=CONDITIONS) -> DataFrame:
    """Every span under every condition (a literal list, one explode): ``boundary_group, leading_silence_sec, word_start_sec, word_end_sec``."""
    table = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(k).alias("kind"), F.lit(float(v)).alias("value")) for n, k, v in conditions))
    rows = spans.select("*", F.explode(table).alias("__c"))
    silence = leading_silence(F.col(start), F.col(end), F.lit(float(chunk_sec)), F.col("__c.kind"), F.col("__c.value"))
    rows = rows.withColumns({"boundary_group": F.col("__c.name"), "leading_silence_sec": silence}).drop("__c")
    return rows.withColumns({"word_start_sec": F.col(start) + F.col("leading_silence_sec"), "word_end_sec": F.col(end) + F.col("leading_silence_sec")})


def reconcile(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only (``status`` 'missing' or 'extra') and keys doubled in ``actual`` ('duplicate'), nulls equal."""
    side = lambda df, n: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    zero = F.lit(0).cast("bigint")
    both = side(expected, "e").withColumn("a", zero).unionByName(side(actual, "a").withColumn("e", zero)).groupBy(*keys).agg(F.sum("e").alias("e"), F.sum("a").alias("a"))
    status = F.when(F.col("a") == 0, "missing").when(F.col("e") == 0, "extra").when(F.col("a") > 1, "duplicate")
    return both.withColumn("status", status).where("status is not null").select(*keys, "status")


def pending(source: DataFrame, done: DataFrame, grain: list[str], unit: list[str]) -> DataFrame:
    """Units with anything at the finer grain still to do."""
    return source.join(done.select(*grain).distinct(), grain, "left_anti").select(*unit).distinct()


def check_aligned(aligned: DataFrame, source_keys: DataFrame, catalog_ids: DataFrame, durations: DataFrame | None = None) -> DataFrame:
    """Faults of aligned rows: ``source_utt_id, aligned_mention_id, fault``.

    ``aligned``: ``source_utt_id, aligned_mention_id, aligned_hotword_id, target_hotword_ids, hotword_start_sec,
    hotword_end_sec``; ``source_keys``: the (source_utt_id, aligned_mention_id) expected; ``durations``:
    ``source_utt_id, seconds``. Missing and unexpected keys are faults too.
    """
    keys = ["source_utt_id", "aligned_mention_id"]
    rows = aligned.join(catalog_ids.select(F.col("id").alias("aligned_hotword_id"), F.lit(True).alias("__known")), "aligned_hotword_id", "left")
    rows = rows.join(durations.select("source_utt_id", F.col("seconds").alias("__sec")), "source_utt_id", "left") if durations is not None else rows.withColumn("__sec", F.lit(None).cast("double"))
    start, end = F.col("hotword_start_sec"), F.col("hotword_end_sec")
    blank = lambda c: F.col(c).isNull() | (F.col(c) == "")
    fault = (
        F.when(blank("source_utt_id") | blank("aligned_mention_id") | blank("aligned_hotword_id"), "missing key")
        .when(F.col("__known").isNull(), "unknown phrase")
        .when(~F.coalesce(target_ids(F.col("target_hotword_ids")) == F.array("aligned_hotword_id"), F.lit(False)), "other targets")
        .when(~F.coalesce((start >= 0) & (start < end), F.lit(False)), "invalid span")
        .when(end > F.col("__sec") + 0.001, "span beyond the audio")
    )
    found = rows.select(*keys, fault.alias("fault")).where("fault is not null")
    both = reconcile(source_keys, aligned, keys).select(*keys, F.col("status").alias("fault"))
    return found.unionByName(both)

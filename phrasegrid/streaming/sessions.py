"""Sessions as DataFrames: batch replay, and Structured Streaming with the same kernel and state."""

from __future__ import annotations

import pickle
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import running
from ..runtime import hadoop_path, scratch_path, shuffle_width
from .kernel import Catalog, Policy, Session, Tokenizer
from .posteriors import Sounds

RESULT = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("chunk_id", T.IntegerType()),
        T.StructField("partial_text", T.StringType()),
        T.StructField("stable_text", T.StringType()),
        T.StructField("committed_delta", T.StringType()),
        T.StructField("active_ids", T.ArrayType(T.StringType())),
        T.StructField("confirmed_ids", T.ArrayType(T.StringType())),
        T.StructField("prompt", T.StringType()),
        T.StructField("rollback_start", T.IntegerType()),
        T.StructField("decode_start", T.IntegerType()),
        T.StructField("bias", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("revisions", T.IntegerType()),
        T.StructField("audio_samples", T.LongType()),
        T.StructField("open_paths", T.IntegerType()),
        T.StructField("processing_ms", T.DoubleType()),
        T.StructField("is_final", T.BooleanType()),
    ]
)
ROW = "session_id string, seq bigint, hypothesis string, n_samples bigint, enabled array<string>, end boolean"
OVERLAY = "array<struct<id:string,text:string,weight:double>>"
FRAMES = "array<array<double>>"


def folded(text: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", text).casefold().split())


def _rows(pdf: pd.DataFrame) -> list[dict]:
    out = []
    for r in pdf.sort_values("seq", kind="stable").to_dict("records"):
        out.append(
            {
                "seq": int(r["seq"]),
                "hypothesis": None if r["hypothesis"] is None or r["hypothesis"] != r["hypothesis"] else r["hypothesis"],
                "n_samples": None if r["n_samples"] is None or r["n_samples"] != r["n_samples"] else int(r["n_samples"]),
                "enabled": None if r["enabled"] is None or isinstance(r["enabled"], float) else [x for x in r["enabled"] if x is not None],
                "overlay": None if r["overlay"] is None or isinstance(r["overlay"], float) else [x.asDict() if hasattr(x, "asDict") else dict(x) for x in r["overlay"]],
                "log_probs": None if r["log_probs"] is None or isinstance(r["log_probs"], float) else [[float(x) for x in f] for f in r["log_probs"]],
                "end": bool(r["end"]) if r["end"] is not None and r["end"] == r["end"] else False,
            }
        )
    return out


def _frame(results: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(results, columns=RESULT.fieldNames())


def _run(session: Session, session_id: str, rows: list[dict]) -> list[dict]:
    return [{"session_id": session_id, "seq": row["seq"], **result} for row in rows for result in session.step(row)]


def _wide(rows: DataFrame) -> DataFrame:
    """Input columns in order; ``overlay`` and ``log_probs`` may be absent."""
    names = [c.strip().split(" ")[0] for c in ROW.split(",")]
    further = {"overlay": OVERLAY, "log_probs": FRAMES}
    return rows.select(*names, *((F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in further.items()))


def replay(rows: DataFrame, catalog: Catalog, policy: Policy, sounds: Sounds | None = None, tokenizer: Tokenizer = Tokenizer()) -> DataFrame:
    """Results of finished sessions. Rows of a session stream through its state in Arrow batches, in ``seq`` order;
    only the state is held, not the session. Input columns as in ``ROW``, and ``overlay`` and ``log_probs`` if there are any."""
    shared = rows.sparkSession.sparkContext.broadcast(catalog)
    # The number of partitions is given, so that small ones are not put together: the work is in the sessions, not the bytes.
    ordered = _wide(rows).repartition(shuffle_width(rows.sparkSession), "session_id").sortWithinPartitions("session_id", "seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, session = None, None
        for pdf in batches:
            out: list[dict] = []
            cut = (pdf["session_id"] != pdf["session_id"].shift()).cumsum()
            for _, part in pdf.groupby(cut, sort=False):
                sid = part["session_id"].iloc[0]
                if session is None or sid != current:
                    current, session = sid, Session(shared.value, policy, folded, "", sounds, tokenizer)
                out += _run(session, sid, _rows(part))
            yield _frame(out)

    return ordered.mapInPandas(run, RESULT)


_catalogs: dict[str, Catalog] = {}


def _send(spark, catalog: Catalog) -> str:
    """Give every worker a copy as a file in the shared folder: the stream's driver-side worker loads no broadcast."""
    path = scratch_path(spark, "catalog") + ".pickle"
    where, files = hadoop_path(spark, path)
    out = files.create(where)
    out.write(bytearray(pickle.dumps(catalog)))
    out.close()
    spark.sparkContext.addFile(path)
    return path.rpartition("/")[2]


def _sent(name: str) -> Catalog:
    if name not in _catalogs:
        with open(SparkFiles.get(name), "rb") as file:
            _catalogs[name] = pickle.load(file)
    return _catalogs[name]


def stream(rows: DataFrame, catalog: Catalog, policy: Policy, sounds: Sounds | None = None, tokenizer: Tokenizer = Tokenizer()) -> DataFrame:
    """The same on a stream: state per session, kept from micro-batch to micro-batch, cleared when a session ends."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    name = _send(rows.sparkSession, catalog)

    class Sessions(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("session", "state string")

        def handleInputRows(self, key, batches, timers) -> Iterator[pd.DataFrame]:
            session = Session(_sent(name), policy, folded, "", sounds, tokenizer)
            if self.state.exists():
                session.load(self.state.get()[0])
            pdf = pd.concat(list(batches))  # one micro-batch of one session, whose rows come in any order
            out = _run(session, key[0], _rows(pdf))
            if session.ended:
                self.state.clear()
            else:
                self.state.update((session.dump(),))
            yield _frame(out)

        def close(self) -> None:
            pass

    return _wide(rows).groupBy("session_id").transformWithStateInPandas(Sessions(), RESULT, "Append", "None")


def write_trace(results: DataFrame, path: str, checkpoint: str, buckets: int = 16):
    """Append each micro-batch as JSON lines, the rows of a session side by side and in order.

    A micro-batch writes at most ``buckets`` files however many sessions it has: sessions are hashed into files and sorted
    there (results of a chunk before a session's last one). A rerun of a batch replaces its own folder only.
    """

    def one(df: DataFrame, batch: int) -> None:
        line = F.to_json(F.struct(*sorted(df.columns))).alias("value")
        rows = df.repartition(buckets, "session_id").sortWithinPartitions("session_id", "seq", "is_final", "chunk_id")
        rows.select(line).write.mode("overwrite").text(f"{path}/batch={batch}")

    return results.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


def tumbling_chunks(events: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """Count-based chunks: the running number of each row and ``chunk_id`` of ``size`` rows; the last may be short."""
    rows = running(events, keys, [F.col(o) for o in order])
    return rows.withColumn("chunk_id", F.floor(F.col("position") / size).cast("int"))


def refreshes(samples: DataFrame, keys: list[str], seq: str, count: str, chunk: int) -> DataFrame:
    """Accumulated refreshes of a stream of pieces: after each piece, how many boundaries of ``chunk`` samples are passed,
    and one last refresh with ``is_final`` at the end (in place of a boundary that falls on the end exactly)."""
    rows = running(samples.select(*keys, seq, count), keys, [F.col(seq)], "__at", count)
    last = rows.groupBy(*keys).agg(F.max("__at").alias("__max")).withColumnsRenamed({k: f"__k{i}" for i, k in enumerate(keys)})
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    rows = rows.join(last, same).select(*keys, seq, count, (F.col(f"{count}_before") + F.col(count)).alias("__end"), (F.col("__at") == F.col("__max")).alias("__last"))
    before = F.floor((F.col("__end") - F.col(count)) / chunk)
    passed = F.when(F.floor(F.col("__end") / chunk) > before, F.sequence(before + 1, F.floor(F.col("__end") / chunk))).otherwise(F.array().cast("array<bigint>"))
    ends = F.transform(passed, lambda i: i * chunk)
    ends = F.when(F.col("__last") & ((F.col("__end") % chunk != 0) | (F.size(ends) == 0)), F.concat(ends, F.array("__end"))).otherwise(ends)
    out = rows.select(*keys, seq, "__end", "__last", F.explode(ends).alias("sample_count"))
    final = F.col("__last") & (F.col("sample_count") == F.col("__end"))
    chunk_id = F.ceil(F.greatest(F.col("sample_count"), F.lit(1)) / chunk) - 1
    return out.select(*keys, seq, chunk_id.cast("int").alias("chunk_id"), "sample_count", final.alias("is_final"))


def rollback_column(committed: Column, count: Column, anchor: Column, chunk: Column, policy: Policy = Policy()) -> Column:
    """The rollback rule as a native expression; ``anchor``: least active anchor or null."""
    usual = F.greatest(committed, F.least(F.lit(1), count), count - policy.rollback)
    clipped = F.least(count, F.greatest(F.lit(0), anchor))
    held = F.greatest(committed, count - policy.most_rollback, F.least(usual, clipped))
    return F.when(chunk < policy.unfixed_chunks, committed).when(anchor.isNull(), usual).otherwise(held)

"""Frequencies of terms and n-grams from a distributed suffix array with common-prefix intervals.

Suffixes (whole, or cut at ``max_n`` tokens if that is given) are range-partitioned and sorted, which makes the partitions one after
another a suffix array. A pass over each partition keeps the interval of every open common prefix on a stack: all
suffixes that begin with an n-gram lie side by side, so the interval's size is the n-gram's number of occurrences.
The number of records is that size less the duplicates within a record: each suffix carries the length of the
prefix it shares with its neighbour in the suffix array of its own record, and an occurrence whose own-record
neighbour shares the whole n-gram is a repeat. Both are sums, so an interval cut by a partition border is put
together by adding its parts, and equal suffixes are counted before the shuffle: no hot n-gram reaches one task.

Whole values (``value_frequencies``) are the same array cut at one token, with the shards as its records: there a
neighbour in the record's own array is a neighbour in the whole one, because equal tokens are ordered by record.

Defined results: null or empty token arrays give no n-grams; null tokens end a record's token run like a border;
an empty table gives no rows; only named columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import nfkc_term
from ..runtime import materialize

_MOST = (1 << 63) - 1
_HELD = 500_000  # tokens held in Python lists before they become a batch


def _intervals(sums: int):
    """Kernel: sorted (tokens, dup, sums...) in; (gram, sums..., edge) out, an interval touching a border is an edge."""

    def run(batches):
        acc: list[list] = []  # per depth: sums of the open interval, repeats subtracted from the last
        prev: list = []
        first: list | None = None
        out: list[tuple] = []
        held = 0

        def close(last: bool) -> None:
            nonlocal held
            depth = len(acc)
            done = acc.pop()
            edge = last or (first is not None and first[:depth] == prev[:depth])
            out.append((prev[:depth], edge, *done))
            held += depth

        def flush():
            nonlocal held
            cols = list(zip(*out))
            out.clear()
            held = 0
            return pa.RecordBatch.from_arrays(
                [pa.array(list(cols[0]), pa.list_(pa.string())), pa.array(cols[1], pa.bool_()), *(pa.array([min(x, _MOST) for x in c], pa.int64()) for c in cols[2:])],
                names=["gram", "edge", *(f"s{i}" for i in range(sums))],
            )

        for batch in batches:
            tokens = batch.column(0).to_pylist()
            dups = batch.column(1).to_pylist()
            values = list(zip(*(batch.column(2 + i).to_pylist() for i in range(sums))))
            for t, dup, v in zip(tokens, dups, values):
                common = 0
                for a, b in zip(prev, t):
                    if a != b:
                        break
                    common += 1
                while len(acc) > common:
                    close(False)
                    if held > _HELD:
                        yield flush()
                if first is None:
                    first = t
                prev = t
                for depth in range(len(t)):
                    if depth == len(acc):
                        acc.append([0] * sums)
                    row = acc[depth]
                    for i in range(sums):
                        row[i] += v[i]
                    if dup > depth:  # repeats of a record count in no record sum, which stands last
                        row[-1] -= v[-1]
            if len(out) > 20_000:
                yield flush()
        while acc:
            close(True)
            if held > _HELD:
                yield flush()
        if out:
            yield flush()

    return run


def _sum(column: str) -> F.Column:
    """Sum that stays at the greatest bigint instead of passing it."""
    return F.least(F.sum(F.col(column).cast("decimal(38,0)")), F.lit(_MOST).cast("decimal(38,0)")).cast("bigint")


def interval_frequencies(suffixes: DataFrame, tokens: str, sums: list[str], max_n: int | None, dup: str | None = None) -> DataFrame:
    """N-grams of up to ``max_n`` tokens (None: of any length) with the sum of each column of ``sums`` over their suffixes.

    ``suffixes``: one row per suffix (or per distinct suffix with sums). From the last column of ``sums`` those
    rows are taken off whose ``dup`` (tokens shared with the neighbour in the own record) covers the n-gram.
    Returns ``gram array<string>`` and the sums as bigint.
    """
    rows = suffixes.select(
        (F.col(tokens) if max_n is None else F.slice(F.col(tokens), 1, max_n)).alias("__t"),
        (F.col(dup) if dup else F.lit(0)).cast("int").alias("__d"),
        *(F.col(s).cast("bigint").alias(f"__s{i}") for i, s in enumerate(sums)),
    )
    grouped = rows.groupBy("__t", "__d").agg(*(_sum(f"__s{i}").alias(f"__s{i}") for i in range(len(sums))))
    ordered = grouped.repartitionByRange("__t", "__d").sortWithinPartitions("__t", "__d")
    schema = T.StructType(
        [T.StructField("gram", T.ArrayType(T.StringType())), T.StructField("edge", T.BooleanType())]
        + [T.StructField(f"s{i}", T.LongType()) for i in range(len(sums))]
    )
    found = ordered.mapInArrow(_intervals(len(sums)), schema)
    return found.groupBy("gram").agg(*(_sum(f"s{i}").alias(s) for i, s in enumerate(sums)))


def record_suffixes(df: DataFrame, tokens: str, max_n: int | None) -> DataFrame:
    """``suffix array<string>`` (cut at ``max_n`` unless that is None) and ``dup int``: the tokens it shares with the one before it in its record's own suffix array."""
    arrays = df.select(F.col(tokens).alias("__tokens")).where(F.size("__tokens") > 0)
    schema = T.StructType([T.StructField("suffix", T.ArrayType(T.StringType())), T.StructField("dup", T.IntegerType())])

    def run(batches):
        for batch in batches:
            suffix: list = []
            dup: list = []
            held = 0

            def flush():
                nonlocal held
                out = pa.RecordBatch.from_arrays([pa.array(suffix, pa.list_(pa.string())), pa.array(dup, pa.int32())], names=["suffix", "dup"])
                suffix.clear()
                dup.clear()
                held = 0
                return out

            for t in batch.column(0):
                t = t.as_py()
                own = []
                end = len(t)
                for i in range(len(t) - 1, -1, -1):
                    if t[i] is None:
                        end = i
                    elif i < end:
                        own.append(t[i : end if max_n is None else min(end, i + max_n)])
                own.sort()
                prev: list = []
                for s in own:
                    common = 0
                    for a, b in zip(prev, s):
                        if a != b:
                            break
                        common += 1
                    suffix.append(s)
                    dup.append(common)
                    prev = s
                    held += len(s)
                    if held > _HELD:
                        yield flush()
                if len(suffix) > 20_000:
                    yield flush()
            if suffix:
                yield flush()

    return arrays.mapInArrow(run, schema)


def ngram_frequencies(df: DataFrame, tokens: str, max_n: int | None = None) -> DataFrame:
    """``gram array<string>, occurrences bigint, records bigint`` of all n-grams, of at most ``max_n`` tokens if that is given."""
    suffixes = record_suffixes(df, tokens, max_n).withColumns({"occurrences": F.lit(1), "records": F.lit(1)})
    return interval_frequencies(suffixes, "suffix", ["occurrences", "records"], max_n, "dup")


def loaded_once(entries: DataFrame, **others: F.Column) -> DataFrame:
    """``term`` and the columns ``others`` of word-frequency records, one row a record.

    Rows with one ``entry_id`` are one record (the row loaded last; of several, the greatest term, then ``others``);
    a null id is nobody's repeat. Null text counts nowhere.
    """
    # A row without an id gets a number of its own, so that one pass and one grouping do for all.
    alone = F.when(F.col("entry_id").isNull(), F.monotonically_increasing_id())
    rows = entries.where(F.col("text").isNotNull()).select("entry_id", alone.alias("__alone"), "loaded_at", nfkc_term(F.col("text")).alias("term"), *(c.alias(n) for n, c in others.items()))
    names = ["term", *others]
    return rows.groupBy("entry_id", "__alone").agg(F.max(F.struct("loaded_at", *names)).alias("r")).select(*(f"r.{n}" for n in names))


_LOW = (1 << 32) - 1


def _combined(batches):
    """Equal (value, document) of a batch put together: value, document, n, and the sum in two halves that cannot overflow."""
    import pyarrow.compute as pc

    for batch in batches:
        amount = batch.column(2)
        t = pa.table(
            {"value": batch.column(0), "document": batch.column(1), "n": pa.array([1] * batch.num_rows, pa.int64()),
             "high": pc.shift_right(amount, 32), "low": pc.bit_wise_and(amount, _LOW)}
        )
        t = t.group_by(["value", "document"], use_threads=False).aggregate([("n", "sum"), ("high", "sum"), ("low", "sum")])
        yield from t.select(["value", "document", "n_sum", "high_sum", "low_sum"]).rename_columns(["value", "document", "n", "high", "low"]).combine_chunks().to_batches()


def _changes(column: pa.ChunkedArray):
    """Where a sorted column differs from the row before; the first row always does, and nulls are alike."""
    import numpy as np
    import pyarrow.compute as pc

    new = np.ones(len(column), dtype=bool)
    if len(column) > 1:
        a, b = column.slice(1), column.slice(0, len(column) - 1)
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        new[1:] = ~same.to_numpy(zero_copy_only=False) if isinstance(same, pa.Array) else ~same.to_numpy()
    return new


def _value_intervals():
    """Kernel: sorted (value, document, n, high, low) in; per interval (value, records, documents, high, low, edge) out.

    A row stands for n equal suffixes of its document, which are n - 1 adjacencies; rows of one (value, document) lie side
    by side and make one adjacency each with the row before. The documents of an interval are its occurrences less the
    adjacencies, of those documents whose sum is at least 1; a null document is none.
    """

    def run(batches):
        import itertools

        import numpy as np

        names = ["value", "document", "n", "repeats", "high", "low"]
        held = None  # the last (value, document), which the next batch may go on with, as a table of one row
        value, sums, first = None, None, True  # the open interval, without what is held

        def out(values, records, documents, high, low, edge):
            high, low = high + (low >> 32), low & _LOW
            total = np.where(high >= 1 << 31, _MOST, (np.minimum(high, (1 << 31) - 1) << 32) | low)
            return pa.RecordBatch.from_arrays(
                [pa.array(values, pa.string()), *(pa.array(x, pa.int64()) for x in (total, records, documents)), pa.array(edge, pa.bool_())],
                names=["term", "total", "records", "shards", "edge"],
            )

        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                rows = pa.Table.from_batches([batch]).select(["value", "document", "n", "high", "low"])
                rows = rows.add_column(3, "repeats", pa.array(batch.column("n").to_numpy() - 1))
                rows = pa.concat_tables([held, rows]) if held is not None else rows
            else:
                rows = held
            if rows is None or not rows.num_rows:
                continue
            new_value = _changes(rows.column("value"))
            new = new_value | _changes(rows.column("document"))
            starts = np.flatnonzero(new)
            n, repeats, high, low = (np.add.reduceat(rows.column(c).to_numpy(), starts) for c in names[2:])
            repeats += np.diff(np.append(starts, len(new))) - 1  # every row but the first lies beside one of its own document
            if batch is not None:
                k = len(starts) - 1
                held = rows.slice(int(starts[k]), 1).select(["value", "document"])
                for c, x in zip(names[2:], (n, repeats, high, low)):
                    held = held.append_column(c, pa.array(x[k:]))
            else:
                k, held = len(starts), None
            if not k:
                continue
            n, repeats, high, low, starts = n[:k], repeats[:k], high[:k], low[:k], starts[:k]
            total = high + (low >> 32)
            there = (total > 0) | ((total == 0) & ((low & _LOW) >= 1))
            there &= ~rows.column("document").take(pa.array(starts)).is_null().to_numpy()
            begin = np.flatnonzero(new_value[starts])
            found = [np.add.reduceat(x, begin) for x in (n, np.where(there, n - repeats, 0), high, low)]
            values = rows.column("value").take(pa.array(starts[begin])).to_pylist()
            if value is not None:
                if values[0] == value:
                    for x, y in zip(found, sums):
                        x[0] += y
                else:
                    yield out([value], *(np.array([x]) for x in sums), [first])
                    first = False
            if len(values) > 1:
                yield out(values[:-1], *(x[:-1] for x in found), [first, *[False] * (len(values) - 2)])
                first = False
            value, sums = values[-1], [int(x[-1]) for x in found]
        if value is not None:
            yield out([value], *(np.array([x]) for x in sums), [True])

    return run


def value_frequencies(df: DataFrame, value: str, document: str, amount: str) -> DataFrame:
    """Whole values as tokens of their documents: ``term, total, records, shards`` of each value that is not null; a null amount is 0.

    The suffix array is cut at one token and ordered by (value, document), so that the intervals are the values and a
    document's repeats are neighbours. Equal rows are put together within Arrow batches before the shuffle; the range
    partitions split a hot value by its documents, and intervals cut by a border are added up.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).alias("value"), F.col(document).alias("document"), F.coalesce(F.col(amount).cast("bigint"), F.lit(0)).alias("amount"))
    counts = T.StructType([rows.schema["value"], rows.schema["document"], *(T.StructField(c, T.LongType()) for c in ("n", "high", "low"))])
    stored = materialize(rows.mapInArrow(_combined, counts), "values")
    ordered = stored.repartitionByRange("value", "document").sortWithinPartitions("value", "document")
    found = ordered.mapInArrow(_value_intervals(), "term string, total bigint, records bigint, shards bigint, edge boolean")
    return found.groupBy("term").agg(*(_sum(c).alias(c) for c in ("total", "records", "shards")))


def term_frequencies(entries: DataFrame) -> DataFrame:
    """Terms of word-frequency records: ``term, total, records, shards bigint``.

    ``entries``: ``entry_id, shard_id, text, source_frequencies map<string,bigint>, loaded_at``. Records with one
    ``entry_id`` count once (the one loaded last); a null id is nobody's repeat. Null text counts nowhere, a null map
    or count is 0. Sums stay at 2^63 - 1 instead of passing it. A term occurs in a shard if its counts there add up to
    at least 1; a null shard is no shard. Shards are the documents of the suffix array.
    """
    total = F.greatest(
        F.least(
            F.aggregate(
                F.coalesce(F.map_values("source_frequencies"), F.array().cast("array<bigint>")),
                F.lit(0).cast("decimal(38,0)"),
                lambda a, x: (a + F.coalesce(x, F.lit(0).cast("bigint"))).cast("decimal(38,0)"),
            ),
            F.lit(_MOST).cast("decimal(38,0)"),
        ),
        F.lit(-_MOST).cast("decimal(38,0)"),
    ).cast("bigint")
    return value_frequencies(loaded_once(entries, shard_id=F.col("shard_id"), total=total), "term", "shard_id", "total")


def mark_terms(terms: DataFrame, shards: int, common_share: float = 0.5, rare_most: int = 4) -> DataFrame:
    """Adds ``mark``: 'common' in more than ``common_share`` of all shards, else 'rare' with a total of 1..``rare_most``, else null."""
    return terms.withColumn(
        "mark",
        F.when(F.col("shards") > F.lit(shards * common_share), "common").when(F.col("total").between(1, rare_most), "rare"),
    )
